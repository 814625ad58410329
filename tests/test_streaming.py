from datetime import datetime

from plumbline.streaming.jobs import stream_frame_completeness, stream_intake, stream_late_arrivals

SCHEMA = "capture_id string, component string, frame_id string, sha256 string, ts timestamp"


def write(spark, path, *rows):
    spark.createDataFrame([(*r, datetime(2024, 1, d)) for *r, d in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(path))


def test_repeat_intake_across_runs(spark, tmp_path):
    source, table, state = tmp_path / "in", str(tmp_path / "table"), str(tmp_path / "state")

    def run():
        stream_intake(spark.readStream.schema(SCHEMA).parquet(str(source)), table, state).awaitTermination()
        read = lambda part: spark.read.option("recursiveFileLookup", True).schema("capture_id string, sha256 string").parquet(f"{table}/{part}")
        return sorted((r.capture_id, r.sha256) for r in read("accepted").collect()), sorted((r.capture_id, r.sha256) for r in read("rejected").collect())

    write(spark, source, ("a", "raw_depth", "1", "x", 1), ("a", "raw_depth", "1", "x", 2))
    assert run() == ([("a", "x")], [])
    write(spark, source, ("a", "raw_depth", "1", "x", 3), ("a", "raw_depth", "1", "y", 3), ("b", "raw_depth", "1", "y", 3))
    assert run() == ([("a", "x"), ("b", "y")], [("a", "y")])  # changed bytes need a new capture id


def test_fresh_checkpoint_loses_nothing(spark, tmp_path):
    source, table = tmp_path / "in", str(tmp_path / "table")

    def run(state):
        stream_intake(spark.readStream.schema(SCHEMA).parquet(str(source)), table, str(tmp_path / state)).awaitTermination()
        return sorted((r.capture_id, r.sha256) for r in spark.read.schema("capture_id string, sha256 string").parquet(f"{table}/accepted").collect())

    write(spark, source, ("a", "raw_depth", "1", "x", 1))
    assert run("one") == [("a", "x")]
    write(spark, source, ("b", "raw_depth", "1", "y", 1), ("a", "raw_depth", "1", "z", 2))
    assert run("two") == [("a", "x"), ("b", "y")]  # both files again, on a new checkpoint


def test_frames_and_late_rows(spark, tmp_path):
    source, late, state = tmp_path / "in", str(tmp_path / "late"), str(tmp_path / "late-state")
    read = lambda: spark.readStream.schema(SCHEMA).parquet(str(source))
    parts = [("raw_depth",), ("rgb",), ("raw_camera",), ("raw_confidence",)]

    def run():
        stream_late_arrivals(read(), late, state).awaitTermination()
        out = stream_frame_completeness(read()).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state"))
        out.outputMode("append").trigger(availableNow=True).start().awaitTermination()

    write(spark, source, *[("a", c, "1", "x", 2) for c, in parts], ("a", "rgb", "2", "x", 2))
    run()
    write(spark, source, ("a", "rgb", "9", "x", 30))
    run()
    write(spark, source, ("a", "raw_depth", "2", "x", 3), ("a", "rgb", "3", "x", 29))
    run()
    got = spark.read.schema("frame_id string, complete boolean, missing string").parquet(str(tmp_path / "out"))
    assert sorted((r.frame_id, r.complete, r.missing) for r in got.collect()) == [("1", True, ""), ("2", False, "raw_camera,raw_depth,raw_confidence")]
    rows = spark.read.schema(SCHEMA).parquet(f"{late}/late").collect()
    assert [(r.frame_id, r.component) for r in rows] == [("2", "raw_depth")]
