from datetime import datetime, timedelta

from plumbline.operators.integrity import RAW_COMPONENTS
from plumbline.streaming.keyed import stream_first_contents, stream_frames

SCHEMA = "capture_id string, component string, frame_id string, sha256 string, ts timestamp"
PARTS = ("raw_depth", "rgb", "raw_camera", "raw_confidence")
WITHOUT_RGB = ",".join(c for c in RAW_COMPONENTS if c != "rgb")


def write(spark, path, *rows):
    spark.createDataFrame([(*r, datetime(2024, 1, d)) for *r, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_frames_as_they_fill_up(spark, tmp_path):
    frames_fill_up(spark, tmp_path, 1 << 13)


def test_frames_that_share_a_state_entry(spark, tmp_path):
    frames_fill_up(spark, tmp_path, 1)


def frames_fill_up(spark, tmp_path, shelves):
    source = tmp_path / "in"
    seen: list = []

    def run(*rows):
        write(spark, source, *rows)
        out = stream_frames(spark.readStream.schema(SCHEMA).parquet(str(source)), late_for=timedelta(days=20), shelves=shelves).writeStream.format("parquet")
        running = out.option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        running.awaitTermination()
        rows = spark.read.parquet(str(tmp_path / "out")).collect()
        new = sorted((r.kind, r.frame_id, r.component, r.arrivals, r.complete, r.missing) for r in rows)
        fresh = list(new)
        for x in seen:
            fresh.remove(x)
        seen[:] = new
        return fresh

    # complete in its first batch: reported at once, long before its window ends
    assert run(*[("a", c, "1", "x", 2) for c in PARTS], ("a", "rgb", "2", "x", 2)) == [("frame", "1", None, 4, True, "")]
    # a restart: frame 2 completes over two batches, frame 1 gets a late piece
    assert run(*[("a", c, "2", "x", 3) for c in PARTS if c != "rgb"], ("a", "rgb", "1", "y", 3), ("a", "rgb", "3", "x", 3)) == [
        ("frame", "2", None, 4, True, ""), ("late", "1", "rgb", None, None, None)]
    # time passes the window of frame 3
    assert run(("a", "other", "9", "x", 20)) == [("frame", "3", None, 1, False, WITHOUT_RGB)]
    # pieces of reported frames are late, known from the same state; a frame first met after its timer is reported at once
    assert run(("a", "raw_depth", "3", "x", 3), ("a", "rgb", "4", "x", 3)) == [
        ("frame", "4", None, 1, False, WITHOUT_RGB), ("late", "3", "raw_depth", None, None, None)]


def contents(spark, table, part):
    rows = spark.read.option("recursiveFileLookup", True).schema("capture_id string, sha256 string").parquet(f"{table}/{part}").collect()
    return sorted((str(r.capture_id), str(r.sha256)) for r in rows)


def test_first_contents_over_runs(spark, tmp_path):
    first_contents_over_runs(spark, tmp_path, 1 << 18)


def test_first_contents_that_share_a_state_entry(spark, tmp_path):
    first_contents_over_runs(spark, tmp_path, 1)


def first_contents_over_runs(spark, tmp_path, shelves):
    source, table = tmp_path / "in", str(tmp_path / "table")

    def run(state):
        stream_first_contents(spark.readStream.schema(SCHEMA).parquet(str(source)), table, str(tmp_path / state), shelves=shelves).awaitTermination()
        return contents(spark, table, "accepted"), contents(spark, table, "rejected")

    write(spark, source, ("a", "rgb", "1", "x", 2), ("a", "rgb", "1", "w", 3), ("a", "rgb", "1", "x", 1), (None, "rgb", "1", None, 1))
    assert run("one") == ([("None", "None"), ("a", "x")], [("a", "w")])
    write(spark, source, ("a", "rgb", "1", "x", 5), ("a", "rgb", "1", "y", 5), ("b", "rgb", "1", "y", 5))
    assert run("one") == ([("None", "None"), ("a", "x"), ("b", "y")], [("a", "w"), ("a", "y")])
    # a fresh checkpoint reads all files again, knows what was accepted and accepts nothing twice
    write(spark, source, ("c", "rgb", "1", "z", 6))
    assert run("two")[0] == [("None", "None"), ("a", "x"), ("b", "y"), ("c", "z")]


def test_batches_do_not_read_history(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")
    for k in range(20):
        write(spark, source, *[(f"c{k}-{j}", "rgb", "1", "x", 1 + k) for j in range(5)], ("c0-0", "rgb", "1", "x", 1 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(source))
    running = stream_first_contents(stream, table, state)
    running.awaitTermination()
    batches = [p for p in running.recentProgress if p["numInputRows"]]
    assert len(batches) == 20
    assert all(p["numInputRows"] == 6 for p in batches)  # the arrivals alone, in the first batch as in the last
    assert all(p["stateOperators"][0]["numRowsUpdated"] <= 6 for p in batches)
    assert batches[-1]["stateOperators"][0]["numRowsTotal"] == 100
    assert len(contents(spark, table, "accepted")) == 100 and contents(spark, table, "rejected") == []
