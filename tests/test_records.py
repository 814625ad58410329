import io
import json
import zipfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import rules
from plumbline.functions import png
from plumbline.operators import checks as C
from plumbline.operators import coverage as V
from plumbline.operators import hierarchy as H
from plumbline.operators import integrity as I
from plumbline.session import BATCH_BYTES
from plumbline.sources import archives, documents, frames, sinks


def components(spark, *rows):
    return spark.createDataFrame([("cap", f, c) for f, c in rows], "capture_id string, frame_id string, component string")


ALL = [("1", c) for c in I.RAW_COMPONENTS]


def test_completeness(spark, rows):
    assert I.component_completeness(components(spark, *ALL)).count() == 0
    got = rows(I.component_completeness(components(spark, *[r for r in ALL if r[1] != "raw_depth"])), "component", "kind")
    assert got == [("raw_depth", "missing")]
    got = rows(I.component_completeness(components(spark, *ALL, ("2", "raw_depth"), ("1", "clean_depth"))), "frame_id", "component", "kind")
    assert got == [("1", "clean_confidence", "missing"), ("2", "raw_depth", "orphan")]
    assert rows(I.component_completeness(components(spark, ("1", "raw_depth"))), "kind") == [("no_rgb",)]
    both = components(spark, *ALL, *[("1", c) for c in ("clean_depth", "clean_confidence", "corrected_camera")])
    assert I.variant_matrix_audit(both).where("usable").count() == 4


def test_two_sided_checks(spark, rows):
    make = lambda *r: spark.createDataFrame(list(r), "path string, sha256 string")
    out = I.artifact_verify(make(("a", "1"), ("b", "2"), ("c", None)), make(("a", "1"), ("b", "3"), ("c", None), ("d", "4")))
    assert rows(out) == [("b", "changed"), ("d", "undeclared")]
    old, new = (spark.createDataFrame([(v,)], "version string") for v in ("1", "2"))
    assert I.snapshots_comparable(old, new, ["version"]).count() == 2 and I.snapshots_comparable(old, old, ["version"]).count() == 0


def test_set_identity_ignores_order_and_sees_changes(spark):
    make = lambda n, last: spark.createDataFrame([("s", str(i), "a" * 64 if i < n - 1 else last) for i in range(n)], "k string, name string, sha string")
    ident = lambda df: I.set_identity_hash(df, ["k"], "name", "sha").collect()[0].identity
    df = make(50, "b" * 64)
    assert ident(df) == ident(df.orderBy(F.rand(1)).repartition(7)) == ident(df.union(df)) != ident(make(50, "c" * 64))


def test_cycle_is_an_error_and_deep_chain_works(spark):
    chain = spark.createDataFrame([(i, i - 1) for i in range(1, 40)], "id int, parent_id int")
    pairs = H.ancestors(chain)
    assert pairs.count() == 39 * 40 // 2 and pairs.where("id - ancestor <> depth").count() == 0
    with pytest.raises(ValueError, match="cycle"):
        H.ancestors(spark.createDataFrame([(1, 2), (2, 1)], "id int, parent_id int"))


def test_original_behind_a_derivative(spark):
    fields = ("source_id", "sha256")
    ident = lambda s: {"source_id": s, "sha256": s * 3}
    schema = "source_id string, kind string, identity map<string,string>, uncertainty string, image string, original_source_id string"
    upright = ("up", "qualified-upright", ident("up"), "none", "up.png", "orig")
    original = ("orig", "original", ident("orig"), "none", "orig.png", None)
    images = spark.createDataFrame([(f"{s}.png", s * 3, ident(s)) for s in ("up", "orig")], "image string, sha256 string, metadata map<string,string>")
    cite = spark.createDataFrame([("wall", "up")], "object_id string, source_id string")
    found, audited = I.evidence_closure(cite, spark.createDataFrame([upright, original], schema), images, fields, fields)
    assert found.count() == 0 and {r.source_id for r in audited.collect()} == {"up", "orig"}
    found, _ = I.evidence_closure(cite, spark.createDataFrame([upright], schema), images, fields, fields)
    assert [r.rule for r in found.collect()] == ["original_missing"]
    found, _ = I.evidence_closure(cite, spark.createDataFrame([upright, original], schema), images.where("image <> 'orig.png'"), fields, fields)
    assert [(r.rule, r.entity_id) for r in found.collect()] == [("image_absent", "orig")]


def test_feature_must_be_met_in_one_sample(spark):
    feature = spark.createDataFrame([("f", ["o"], ["walk"], "x", 10, 5.0)], "feature_id string, object_ids array<string>, view_intents array<string>, finding_id string, minimum_visible_pixels long, minimum_projected_area_px2 double")
    samples = spark.createDataFrame([("a", "walk"), ("b", "walk")], "frame_id string, intent string")
    found = spark.createDataFrame([("a", "x", "pass"), ("b", "x", "pass")], "frame_id string, finding_id string, status string")
    vis = lambda *r: spark.createDataFrame(list(r), "frame_id string, object_id string, visible_pixels long, projected_area_px2 double")
    assert V.feature_coverage(feature, samples, vis(("a", "o", 20, 1.0), ("b", "o", 5, 9.0)), found).count() == 1
    assert V.feature_coverage(feature, samples, vis(("a", "o", 20, 1.0), ("b", "o", 10, 5.0)), found).count() == 0
    # wanted rows are read past a list per combination: not joined to themselves, not shuffled, not broadcast; repeated ones stay
    wanted = feature.unionByName(feature).unionByName(feature.withColumn("finding_id", F.lit(None).cast("string")))
    found = V.feature_coverage(wanted, samples, vis(("a", "o", 20, 1.0), ("b", "o", 5, 9.0)), found)
    assert found.count() == 3 and "LeftAnti" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_raster_colocation(spark):
    grid = spark.createDataFrame([("v", y, x, 1, 1) for y in range(4) for x in range(4)], "view_id string, y int, x int, object_idx int, material_idx int")
    for material, pixels in ((1, 16), (2, 0)):
        assigned = spark.createDataFrame([("v", 1, material)], "view_id string, object_idx int, material_idx int")
        assert V.object_material_colocation(grid, assigned).collect()[0].material_pixels == pixels


def test_rollup(spark):
    declared = spark.createDataFrame([("a",), ("b",)], "rule string")
    found = spark.createDataFrame([("a", "1", None)], "rule string, entity_id string, detail string")
    checks = rules.checks_rollup(found, declared)
    assert {(r.rule, r.passed) for r in checks.collect()} == {("a", False), ("b", True)}
    assert rules.overall_status(checks).collect()[0].passed is False
    with pytest.raises(ValueError):
        rules.require_clean(found)


# --- files ------------------------------------------------------------------


def filtered_png(grid: np.ndarray, kind: int) -> bytes:
    """A 16-bit gray PNG whose rows all use one filter."""
    import struct
    import zlib

    raw = grid.astype(">u2").tobytes()
    stride = grid.shape[1] * 2
    lines = [np.frombuffer(raw[i:i + stride], np.uint8).astype(int) for i in range(0, len(raw), stride)]
    above, out = np.zeros(stride, int), b""
    for line in lines:
        left, corner = np.r_[0, 0, line[:-2]], np.r_[0, 0, above[:-2]]
        p = left + above - corner
        near = np.select([(abs(p - left) <= abs(p - above)) & (abs(p - left) <= abs(p - corner)), abs(p - above) <= abs(p - corner)], [left, above], corner)
        guess = [0 * line, left, above, (left + above) // 2, near][kind]
        out += bytes([kind]) + ((line - guess) % 256).astype(np.uint8).tobytes()
        above = line
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    head = struct.pack(">IIBBBBB", grid.shape[1], grid.shape[0], 16, 0, 0, 0, 0)
    return png.SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(out)) + chunk(b"IEND", b"")


@pytest.mark.parametrize("kind", range(5))
def test_depth_filters(kind):
    grid = np.random.default_rng(kind).integers(0, 65536, size=(7, 9))
    grid[0, :3] = [0, 255, 65535]
    assert (png.decode(filtered_png(grid, kind), 16, 0)[:, :, 0] == grid).all()


def test_other_encodings_are_refused(spark):
    grid = np.zeros((2, 2, 3), np.uint16)
    for depth, color in ((8, 0), (8, 2), (8, 6), (16, 2)):
        data = png.encode(np.zeros((2, 2, png.SAMPLES_PER_PIXEL[color])), depth, color)
        with pytest.raises(png.UnsupportedImage):
            png.decode(data, 16, 0)
    with pytest.raises(png.UnsupportedImage):
        png.decode(b"II*\0" + bytes(100), 16, 0)
    images = spark.createDataFrame([("ok", png.encode(grid[:, :, :1], 16, 0)), ("bad", png.encode(grid[:, :, :1], 8, 0)), ("tiff", b"II*\0" + bytes(100))], "id string, content binary")
    assert {r.entity_id for r in frames.check_depth_images(images, F.col("id"), ["id"]).collect()} == {"bad", "tiff"}
    assert {r.id for r in frames.scan_depth(images, ["id"]).collect()} == {"ok"}


def test_capture_tree_on_disk(spark, tmp_path):
    base = tmp_path / "cap"
    for folder in ("images", "depth", "confidence", "cameras"):
        (base / "keyframes" / folder).mkdir(parents=True)
    depth = np.array([[0, 1, 255], [256, 65535, 1000]])
    (base / "keyframes/depth/7.png").write_bytes(png.encode(depth[:, :, None], 16, 0))
    (base / "keyframes/confidence/7.png").write_bytes(png.encode(np.full((2, 3, 1), 255), 8, 0))
    (base / "keyframes/cameras/7.json").write_text(json.dumps({"width": 6, "height": True, "fx": 6, "fy": 4.5, "cx": 2, "cy": 0} | {f"t_{i}{j}": float(i == j) for i in range(3) for j in range(4)}))
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(6, 4, 1)
    for x in range(6):
        for y in range(4):
            image.setRGB(x, y, (80 << 16) + (120 << 8) + 160)
    jvm.javax.imageio.ImageIO.write(image, "jpg", jvm.java.io.File(str(base / "keyframes/images/7.jpg")))
    files = frames.read_files(spark, str(tmp_path))
    index = frames.scan_frame_index(files)
    assert {r.component for r in index.collect()} == set(I.RAW_COMPONENTS)
    rows = index.where("component = 'raw_depth'")
    assert {(r.v, r.u): r.depth_mm for r in frames.scan_depth(rows, ["frame_id"]).collect()} == {(v, u): int(depth[v, u]) for v in range(2) for u in range(3)}
    cam = frames.scan_camera(index.where("component = 'raw_camera'").select("frame_id", F.decode("content", "UTF-8").alias("text"))).collect()[0]
    assert (cam.width, cam.height, cam.fy, cam.pose[15]) == (6.0, None, 4.5, 1.0)
    photo = frames.scan_rgb(spark, str(base / "keyframes/images")).collect()
    assert len(photo) == 24 and all(abs(r.r - 80) <= 3 and abs(r.g - 120) <= 3 and abs(r.b - 160) <= 3 for r in photo)


def zipped(*members) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        for name, data in members:
            z.writestr(zipfile.ZipInfo(name), data)
    return buffer.getvalue()


def test_archives(spark, rows):
    good = zipped(("scan/keyframes/images/1.jpg", b"x"), ("scan/notes.txt", b"y"))
    bad = zipped(("../up.txt", b"x"), ("a/keyframes/1", b"1"), ("A/keyframes/2", b"2"), ("b/keyframes", b"3"), ("b/keyframes/4", b"4"), ("overview/x", b"5"))
    df = spark.createDataFrame([("good", good), ("bad", bad)], "archive_id string, content binary")
    members = archives.scan_archive_members(df)
    unsafe = C.check_archive_paths(members)
    assert {(r.rule, r.entity_id) for r in unsafe.collect()} == {("unsafe_path", "bad/../up.txt"), ("reserved_root", "bad/overview/x")}
    assert {(r.archive_id, r.single) for r in C.single_root(members).collect()} == {("good", True), ("bad", False)}
    assert rows(C.alias_conflict(members), "alias") == [("a",), ("a/keyframes",)] and rows(C.file_dir_conflict(members), "alias") == [("b/keyframes",)]
    manifest = archives.archive_manifest(archives.expand_archive(df.where("archive_id = 'good'")))
    assert {(r.path, r.is_dir) for r in manifest.collect()} == {("scan/keyframes/images/1.jpg", False), ("scan/notes.txt", False), ("scan", True), ("scan/keyframes", True), ("scan/keyframes/images", True)}


def test_images_of_one_size_are_decoded_together(monkeypatch):
    random = np.random.default_rng(5)
    grids = [random.integers(0, 1 << 16, (h, w, 1)) for h, w in [(4, 6)] * 5 + [(3, 2)] * 2 + [(4, 6)]]
    contents = [png.encode(g, 16, 0, np.arange(len(g)) % 5) for g in grids]
    contents.insert(2, contents[0][:-20])
    calls, whole = [], png._unfiltered
    monkeypatch.setattr(png, "_unfiltered", lambda filters, body: calls.append(len(body)) or whole(filters, body))
    batch = pd.DataFrame({"k": np.arange(len(contents)), "content": contents})
    got = pd.concat(frames._pixel_rows(["k"], 16, 0, ["d"])(iter([batch, batch[:0]])))
    assert calls == [5, 2, 1]
    for k, grid in zip((0, 1, 3, 4, 5, 6, 7, 8), grids):
        mine = got[got["k"] == k]
        assert [tuple(r) for r in mine[["v", "u", "d"]].to_numpy()] == [(v, u, grid[v, u, 0]) for v in range(grid.shape[0]) for u in range(grid.shape[1])]
    assert len(got) == sum(g.size for g in grids)


def test_archives_reach_python_in_small_batches(spark):
    for name in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{name}")
    good = zipped(("a/b.txt", b"x" * 3_000_000), ("a/b.txt", b"x" * 3_000_000), ("c.txt", b"y"), ("a/d.txt", b"z" * 7_000_000))
    df = spark.createDataFrame([(k, good) for k in range(4)], "archive_id int, content binary")
    members = archives.expand_archive(df)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= BATCH_BYTES
    assert members.groupBy("name").count().collect() and members.count() == 16
    manifest = archives.archive_manifest(members).groupBy("path", "is_dir").count().collect()
    assert {tuple(r) for r in manifest} == {("a/b.txt", False, 8), ("c.txt", False, 4), ("a/d.txt", False, 4), ("a", True, 4)}


def test_manifest_reads_members_once(spark):
    df = spark.createDataFrame([(1, zipped(("a/b.txt", b"x")))], "archive_id int, content binary")
    plan = archives.archive_manifest(archives.expand_archive(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1


def test_unicode_alias(spark):
    df = spark.createDataFrame([("Straße",), ("café",)], "n string")
    assert [r.f for r in df.select(C.nfc_casefold("n").alias("f")).collect()] == ["strasse", "café"]


def test_strict_json(spark):
    texts = ['{"a": 1}', '{"a": 1, "a": 2}', '{"a": NaN}', '[1]', '{"a": ', '{"a": {"b": 1, "b": 1}}']
    out = documents.scan_strict_json(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")).orderBy("i").collect()
    assert [r.valid for r in out] == [True, False, False, False, False, False]


def test_output_must_be_fresh(spark, tmp_path):
    path = sinks.sink_fresh_only(spark.range(3), str(tmp_path / "out"))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        sinks.sink_fresh_only(spark.range(1), path)
    assert spark.read.parquet(path).count() == 3


def test_ids_end_at_the_end(spark):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(["ok-1.a", "ok\n", "", "-x", "a/b"])], "k int, id string")
    assert sorted(int(r.entity_id) for r in C.check_ids(df, "k", ids=("id",)).collect()) == [1, 2, 3, 4]


def test_repeated_keys_are_findings(spark, rows):
    make = lambda *r: spark.createDataFrame(list(r), "path string, sha256 string")
    old, new = make(("a", "1"), ("a", "2"), ("b", "1")), make(("a", "2"), ("b", "1"))
    assert rows(I.artifact_verify(old, new), "path", "kind") == [("a", "duplicate")]
    assert rows(I.artifact_verify(new, old), "path", "kind") == [("a", "duplicate")]
    assert rows(I.preservation_check(old, new, ["path"], "sha256"), "path", "kind") == [("a", "duplicate")]
    assert rows(I.inventory_diff(old, new, ["path"], "sha256"), "path", "change") == [("a", "duplicate")]
    assert rows(I.membership_receipt(old, new, ["path"], "sha256"), "path", "kind") == [("a", "duplicate")]


def test_nodes_without_a_root(spark, rows):
    unit = [1.0, 0.0, 0.0, 1.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0]
    tree = [(1, None), (2, 1), (3, 3), (4, 3), (5, 99), (6, 5), (7, 8), (8, 7)] + [(k, k - 1 if k > 1000 else 2) for k in range(1000, 1300)]
    world, bad = H.hierarchy_transforms(spark.createDataFrame([(i, p, unit) for i, p in tree], "id int, parent_id int, matrix array<double>"))
    x = {r["id"]: r["world"][3] for r in world.collect()}
    assert x == {1: 1.0, 2: 2.0} | {k: k - 997.0 for k in range(1000, 1300)}
    assert rows(bad, "rule", "entity_id", "detail") == [
        ("cycle", "3", None), ("cycle", "4", None), ("cycle", "7", None), ("cycle", "8", None), ("unknown_parent", "5", "99"), ("unknown_parent", "6", "99")]


def test_cycles_end_early(spark, rows, monkeypatch):
    """Rounds follow depth and cycle length, not the number of nodes."""
    from plumbline.operators import hierarchy

    unit, rounds, cut = [1.0] * 16, [], hierarchy.cut_lineage
    tree = [(k, 0 if k else None) for k in range(5000)] + [(5001, 5003), (5002, 5001), (5003, 5002), (5004, 5003), (5000, 5004), (5005, 9000)]
    nodes = spark.createDataFrame([(i, p, unit) for i, p in tree], "id int, parent_id int, matrix array<double>")
    monkeypatch.setattr(hierarchy, "cut_lineage", lambda df: rounds.append(1) or cut(df))
    want = [("cycle", str(k), None) for k in range(5000, 5005)] + [("unknown_parent", "5005", "9000")]
    assert rows(H.hierarchy_transforms(nodes)[1], "rule", "entity_id", "detail") == want
    assert len(rounds) < 10
    assert rows(H.hierarchy_findings(nodes), "rule", "entity_id", "detail") == want


def test_text_forms(spark):
    import json

    from plumbline.functions import text as T

    numbers = [0.0, -0.0, 1.0, 100.0, 123456789012345.0, 1234567890123456.0, 1e15, 999999999999999.9, 1e-4, 1e-5, 0.1, 1 / 3, -2.5e-7, 1e100, 3e-200, float("inf"), float("-inf"), float("nan")]
    frame = spark.createDataFrame([(i, x) for i, x in enumerate(numbers)], "i int, x double")
    assert [r.s for r in frame.orderBy("i").select(T.fifteen_digits(F.col("x")).alias("s")).collect()] == [format(x, ".15g") for x in numbers]
    texts = {"b": 'q"\\/', "a": "\u00e9\U0001d518\x01\n", "": "\x7f", "c": None}
    frame = spark.createDataFrame([(texts,)], "m map<string,string>")
    assert frame.select(T.canonical_json(F.col("m")).alias("j")).first().j == json.dumps(texts, sort_keys=True)
    frame = spark.createDataFrame([("My Scan.v2.zip", "ab" * 32, False), ("My Scan", "x", True), (".zip", "cd" * 32, False), ("a\n", "x", True)], "n string, h string, d boolean")
    assert [r.c for r in frame.select(T.capture_id(F.col("n"), F.col("h"), F.col("d")).alias("c")).collect()] == ["my-scan.v2-abababab", "my-scan", None, None]


def test_buffer_hash(spark):
    import hashlib

    import numpy as np

    data = [(k % 3, k, k * 0.5, -k / 3) for k in range(50)] + [(7, 0, float("nan"), 0.0), (8, 0, 1e300, 0.0)]
    frame = spark.createDataFrame(data, "g int, i int, x double, y double").repartition(4)
    got = {r.g: r.buffer_sha256 for r in I.buffer_hash(frame, ["g"], ["i"], ["x", "y"]).collect()}
    want = {g: hashlib.sha256(np.array([[x, y] for h, _, x, y in data if h == g], "<f4").tobytes()).hexdigest() for g in range(3)}
    assert got == want | {7: None, 8: None}
