"""Registered queries: files, archives, documents, sinks and streams built from the tables."""

from __future__ import annotations

import io
import zipfile
from datetime import timedelta

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import png
from plumbline.operators import integrity as I
from plumbline.operators import pixels as P
from plumbline.plans import views as W
from plumbline.plans.pixel_queries import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import with_views
from plumbline.session import cut_lineage, fresh_path, small_batches
from plumbline.sources import archive_ranges as AR
from plumbline.sources import archives as A
from plumbline.sources import documents as D
from plumbline.sources import frames as S
from plumbline.sources import sinks as K
from plumbline.streaming import jobs as J
from plumbline.streaming import keyed as KS

# --- file listings and cameras ----------------------------------------------


@query("""SELECT user_id AS capture_id, CASE event_type WHEN 'click' THEN 'rgb' WHEN 'view' THEN 'raw_camera' WHEN 'purchase' THEN 'clean_depth' WHEN 'signup' THEN 'raw_confidence' ELSE 'corrected_camera' END AS component,
 CAST(event_id AS VARCHAR) AS frame_id FROM events WHERE event_id % 10 <> 0""")
def scan_frame_index(spark, sf):
    """Capture file paths built from events; a tenth are other files."""
    e = F.col("event_type")
    name = F.col("event_id").cast("string")
    inner = (F.when(F.col("event_id") % 10 == 0, F.concat(F.lit("keyframes/thumbs/"), name, F.lit(".jpg"))).when(e == "click", F.concat(F.lit("keyframes/images/"), name, F.lit(".jpg")))
             .when(e == "view", F.concat(F.lit("keyframes/cameras/"), name, F.lit(".json"))).when(e == "purchase", F.concat(F.lit("keyframes/depth/"), name, F.lit(".Clean.png")))
             .when(e == "signup", F.concat(F.lit("keyframes/confidence/"), name, F.lit(".png"))).otherwise(F.concat(F.lit("keyframes/corrected_cameras/"), name, F.lit(".json"))))
    files = W.table(spark, sf, "events").select(F.concat(F.lit("file:/data/"), F.col("user_id").cast("string"), F.lit("/"), inner).alias("path"))
    found = S.scan_frame_index(files)
    return found.select(F.element_at(F.split("capture_root", "/"), -1).cast("long").alias("capture_id"), "component", "frame_id")


@query("""SELECT s_suppkey AS frame_id, CAST(384 AS DOUBLE) AS width, CAST(300 + s_nationkey AS DOUBLE) AS fx, CASE WHEN s_suppkey % 6 <> 0 THEN CAST(192 AS DOUBLE) END AS cx, s_acctbal AS tx, CAST(1 AS DOUBLE) AS last,
 CASE WHEN s_suppkey % 4 <> 0 AND s_suppkey % 5 > 2 THEN CAST(s_suppkey % 3 AS INTEGER) END AS tracking_segment FROM supplier""")
def scan_camera(spark, sf):
    """Camera JSON text per supplier; some name cx as a string, some have no segment or one that is text, a boolean or a fraction."""
    k = F.col("s_suppkey")
    text = F.format_string(
        '{"width": 384, "height": 256, "fx": %s, "fy": 300.0, "cx": %s, "cy": 128, "t_00": 1, "t_01": 0, "t_02": 0, "t_03": %s, "t_10": 0, "t_11": 1, "t_12": 0, "t_13": 1.5, "t_20": 0, "t_21": 0, "t_22": 1, "t_23": 2.5%s}',
        (300 + F.col("s_nationkey")).cast("string"), F.when(k % 6 == 0, '"192"').otherwise("192.0"), F.col("s_acctbal").cast("string"),
        F.when(k % 4 == 0, "").otherwise(F.concat(F.lit(', "tracking_segment": '),
            F.when(k % 5 == 0, '"2"').when(k % 5 == 1, "true").when(k % 5 == 2, "1.7").otherwise((k % 3).cast("string")))))
    cams = S.scan_camera(W.table(spark, sf, "supplier").select(k.alias("frame_id"), text.alias("text")))
    return cams.select("frame_id", "width", "fx", "cx", F.col("pose")[3].alias("tx"), F.col("pose")[15].alias("last"), "tracking_segment")


# --- images -----------------------------------------------------------------


def _encoded(spark, sf, column: str, bit_depth: int, color_type: int, where: str = "true"):
    """One PNG per frame of the small tiles, its rows under all five filters; a frame has at most 24x16 pixels, 32 frames are coded at a time."""
    width, height = W.TILE_SIZE

    def build(part: pd.DataFrame) -> pd.DataFrame:
        frames, at = np.unique(part["frame_id"], return_inverse=True)
        grid = np.zeros((len(frames), height, width, png.SAMPLES_PER_PIXEL[color_type]), np.uint16)
        values = part[column].to_numpy()
        for channel in range(grid.shape[3]):
            grid[at, part["v"], part["u"], channel] = (values + channel) % (1 << bit_depth)
        return pd.DataFrame({"capture_id": part["capture_id"].iloc[0], "frame_id": frames, "content": png.encode_all(grid, bit_depth, color_type, np.arange(height) % 5)})

    tiles = W.tile(spark, sf).where(where).withColumn("shelf", F.floor(F.col("frame_id") / 32))
    return tiles.groupBy("capture_id", "shelf").applyInPandas(build, "capture_id string, frame_id long, content binary")


FRAME = ["capture_id", "frame_id"]
# every pixel of every frame; those that no table row gives are 0
_GRID = f"""FROM (SELECT DISTINCT capture_id, frame_id FROM tile) f CROSS JOIN (SELECT unnest(range({W.TILE_SIZE[1]})) AS v) gv CROSS JOIN (SELECT unnest(range({W.TILE_SIZE[0]})) AS u) gu
 LEFT JOIN tile t ON t.capture_id = f.capture_id AND t.frame_id = f.frame_id AND t.v = gv.v AND t.u = gu.u"""
_PLACE = "SELECT f.capture_id, f.frame_id, CAST(gv.v AS INTEGER) AS v, CAST(gu.u AS INTEGER) AS u"


@query(with_views("tile", f"{_PLACE}, CAST(coalesce(depth_mm, 0) AS INTEGER) AS depth_mm {_GRID}"))
def scan_depth(spark, sf):
    """16-bit depth PNGs coded from the pixel table and decoded again."""
    return S.scan_depth(_encoded(spark, sf, "depth_mm", 16, 0), FRAME)


@query(with_views("tile", f"{_PLACE}, CAST(coalesce(confidence, 0) AS INTEGER) AS confidence {_GRID}"))
def scan_confidence(spark, sf):
    return S.scan_confidence(_encoded(spark, sf, "confidence", 8, 0), FRAME)


@query(with_views("tile", f"""{_PLACE}, CAST(coalesce(confidence, 0) AS INTEGER) AS r, CAST(coalesce((confidence + 1) % 256, 0) AS INTEGER) AS g,
 CAST(coalesce((confidence + 2) % 256, 0) AS INTEGER) AS b {_GRID}"""))
def scan_rgb(spark, sf):
    return S.scan_rgb_png(_encoded(spark, sf, "confidence", 8, 2), FRAME)


@query(with_views("tile", """SELECT DISTINCT 'image_not_decodable' AS rule, capture_id || '/' || CAST(frame_id AS VARCHAR) AS entity_id FROM tile WHERE frame_id % 7 < 2"""))
def scan_depth_findings(spark, sf):
    """Some images end early, some are no images: a finding each, and no pixels."""
    images = _encoded(spark, sf, "depth_mm", 16, 0)
    broken = F.when(F.col("frame_id") % 7 == 0, F.substring("content", 1, F.length("content") - 30)).when(F.col("frame_id") % 7 == 1, F.lit(b"none")).otherwise(F.col("content"))
    return S.check_image_bytes(images.withColumn("content", broken), FRAME, 16, 0).select("rule", "entity_id")


@query(with_views("tile", "SELECT DISTINCT 'depth_not_16_bit_gray' AS rule, capture_id || '/' || CAST(frame_id AS VARCHAR) AS entity_id, '8/0' AS detail FROM tile WHERE capture_id = 'N'"))
def check_depth_images(spark, sf):
    """One capture delivers 8-bit depth images, which must be refused."""
    good = _encoded(spark, sf, "depth_mm", 16, 0, "capture_id <> 'N'")
    bad = _encoded(spark, sf, "confidence", 8, 0, "capture_id = 'N'")
    return S.check_depth_images(good.unionByName(bad), F.concat_ws("/", "capture_id", F.col("frame_id").cast("string")), FRAME)


# --- archives ---------------------------------------------------------------


def _archives(spark, sf):
    """A ZIP per twenty documents."""

    def build(part: pd.DataFrame) -> pd.DataFrame:
        buffer = io.BytesIO()
        with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as archive:
            archive.writestr(zipfile.ZipInfo("scan/"), b"")
            for row in part.sort_values("doc_id").itertuples(index=False):
                info = zipfile.ZipInfo(f"scan/{row.lang}/{row.doc_id}.txt")
                info.external_attr = 0o100644 << 16
                archive.writestr(info, row.text.encode())
        return pd.DataFrame({"archive_id": [part["archive_id"].iloc[0]], "content": [buffer.getvalue()]})

    small_batches(spark)
    docs = W.table(spark, sf, "documents").select(F.floor(F.col("doc_id") / 20).alias("archive_id"), "doc_id", "lang", "text")
    return docs.groupBy("archive_id").applyInPandas(build, "archive_id long, content binary")


@query("""SELECT doc_id // 20 AS archive_id, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, false AS is_dir, CAST(33188 AS INTEGER) AS mode, octet_length(encode(text)) AS size FROM documents
UNION ALL SELECT DISTINCT doc_id // 20, 'scan/', true, CAST(0 AS INTEGER), 0 FROM documents""")
def scan_archive_members(spark, sf):
    members = A.scan_archive_members(_archives(spark, sf))
    return members.withColumn("mode", F.when(F.col("is_dir"), 0).otherwise(F.col("mode")))


@query("SELECT doc_id // 20 AS archive_id, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, sha256(text) AS sha256 FROM documents")
def expand_archive(spark, sf):
    return A.expand_archive(_archives(spark, sf)).select("archive_id", "name", "sha256")


@query("""SELECT doc_id // 20 AS archive_id, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS path, false AS is_dir, sha256(text) AS sha256 FROM documents
UNION ALL SELECT DISTINCT doc_id // 20, 'scan/' || lang, true, NULL FROM documents UNION ALL SELECT DISTINCT doc_id // 20, 'scan', true, NULL FROM documents""")
def archive_manifest(spark, sf):
    return A.archive_manifest(A.expand_archive(_archives(spark, sf)))


@query("""SELECT DISTINCT CASE WHEN doc_id // 20 % 3 = 0 THEN 'broken_archive' ELSE 'empty_archive' END AS rule, CAST(doc_id // 20 AS VARCHAR) AS entity_id FROM documents WHERE doc_id // 20 % 3 < 2""")
def scan_archive_findings(spark, sf):
    """Every third archive is cut, every third is empty."""
    k = F.col("archive_id") % 3
    empty = F.lit(b"PK\x05\x06" + bytes(18))
    content = F.when(k == 0, F.substring("content", 1, 40)).when(k == 1, empty).otherwise(F.col("content"))
    return A.check_archives(_archives(spark, sf).withColumn("content", content)).select("rule", "entity_id")


def _archive_files(spark, sf, archives):
    """The archives as files of the shared folder, named by their id."""
    folder = fresh_path(spark, "archives")

    def write(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                path = f"{folder}/{row.archive_id}.zip"
                store, inner = AR.store_of(folder)
                store.create_dir(inner, recursive=True)
                with store.open_output_stream(f"{inner}/{row.archive_id}.zip") as out:
                    out.write(row.content)
                yield pd.DataFrame({"archive_id": [row.archive_id], "path": [path]})

    return cut_lineage(archives.mapInPandas(write, "archive_id long, path string"))


@query("""SELECT doc_id // 20 AS archive_id, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, false AS is_dir, CAST(33188 AS INTEGER) AS mode, octet_length(encode(text)) AS size FROM documents
UNION ALL SELECT DISTINCT doc_id // 20, 'scan/', true, CAST(0 AS INTEGER), 0 FROM documents""")
def archive_directories(spark, sf):
    """Members of archive files, from the directory at each file's end."""
    files = _archive_files(spark, sf, _archives(spark, sf))
    members = AR.archive_directories(files).join(files, "path")
    return members.select("archive_id", "name", "is_dir", F.when(F.col("is_dir"), 0).otherwise(F.col("mode")).alias("mode"), "size")


@query("SELECT doc_id // 20 AS archive_id, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, octet_length(encode(text)) AS size, sha256(text) AS sha256 FROM documents")
def expand_members(spark, sf):
    """Files of archive files by byte ranges: groups of 256 KB here, so that an archive is several groups."""
    files = _archive_files(spark, sf, _archives(spark, sf))
    members = cut_lineage(AR.archive_directories(files))
    return AR.expand_members(members, 256 << 10).join(files, "path").select("archive_id", "name", "size", "sha256")


@query("SELECT doc_id // 20 AS archive_id, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS name, 0 AS piece, sha256(text) AS sha256 FROM documents")
def member_pieces(spark, sf):
    """Contents of archive files in pieces; no document here is longer than one."""
    files = _archive_files(spark, sf, _archives(spark, sf))
    pieces = AR.member_pieces(AR.archive_directories(files)).join(files, "path")
    return pieces.select("archive_id", "name", "piece", F.sha2("content", 256).alias("sha256"))


@query("""WITH a AS (SELECT DISTINCT doc_id // 20 AS k FROM documents)
SELECT CASE k % 4 WHEN 0 THEN 'broken_archive' ELSE 'empty_archive' END AS rule, k AS archive_id, CAST(NULL AS VARCHAR) AS name FROM a WHERE k % 4 < 2
UNION ALL SELECT 'broken_member', k, 'scan/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' FROM documents, a
WHERE k = doc_id // 20 AND k % 4 = 2 AND doc_id = (SELECT min(d.doc_id) FROM documents d WHERE d.doc_id // 20 = k)""")
def archive_file_findings(spark, sf):
    """A quarter of the archives is cut, a quarter is empty, and in a quarter the local header of the first file is overwritten."""
    k = F.col("archive_id") % 4
    empty = F.lit(b"PK\x05\x06" + bytes(18))
    start = len("scan/") + AR.HEADER  # the first file follows the header and name of its directory
    spoiled = F.concat(F.substring("content", 1, start), F.lit(bytes(4)), F.expr(f"substring(content, {start + 5}, length(content))"))
    content = F.when(k == 0, F.substring("content", 1, 40)).when(k == 1, empty).when(k == 2, spoiled).otherwise(F.col("content"))
    files = _archive_files(spark, sf, _archives(spark, sf).withColumn("content", content))
    members = cut_lineage(AR.archive_directories(files))
    found = AR.check_archive_files(members, AR.expand_members(members))
    return found.join(files, found.entity_id == files.path).select("rule", "archive_id", F.col("detail").alias("name"))



# --- JSON documents ---------------------------------------------------------


@query("""SELECT event_id, event_id % 4 = 3 AS valid, CASE WHEN event_id % 4 = 3 THEN CAST(json_extract(props, '$.k') AS BIGINT) END AS k FROM events""")
def scan_strict_json(spark, sf):
    """Event properties, some with a repeated key, a NaN, or an array instead of an object."""
    k = F.col("event_id") % 4
    rest = F.expr("substring(props, 2)")
    text = F.when(k == 0, F.concat(F.lit('{"k": 1, '), rest)).when(k == 1, F.concat(F.lit('{"x": NaN, '), rest)).when(k == 2, F.concat(F.lit("["), F.col("props"), F.lit("]"))).otherwise(F.col("props"))
    out = D.scan_strict_json(W.table(spark, sf, "events").select("event_id", text.alias("text")))
    return out.select("event_id", "valid", F.try_variant_get("doc", "$.k", "long").alias("k"))


@query("""SELECT p_size AS scene_id, 'part-' || CAST(p_partkey AS VARCHAR) AS object_id, i AS vertex, CASE WHEN i IN (1, 2) THEN 1 ELSE 0 END * p_retailprice AS x, CAST(CASE WHEN i >= 2 THEN p_size ELSE 0 END AS DOUBLE) AS y, CAST(0 AS DOUBLE) AS z
FROM part, (SELECT unnest([0, 1, 2, 3]) AS i)""")
def scan_scene_records(spark, sf):
    """Scene documents of parts by size; vertices read back from the JSON text."""
    p, s, o = F.col("p_retailprice"), F.col("p_size").cast("double"), F.lit(0.0)
    ring = F.array(F.array(o, o, o), F.array(p, o, o), F.array(p, s, o), F.array(o, s, o))
    ints = lambda *v: F.array(*[F.lit(x) for x in v])
    tri = F.array(F.struct(ints(0, 1, 2).alias("vertex_indices"), F.lit(0).alias("polygon_index")), F.struct(ints(0, 2, 3).alias("vertex_indices"), F.lit(0).alias("polygon_index")))
    record = F.struct(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("name"), ring.alias("vertices_world_m"), F.array(ints(0, 1, 2, 3)).alias("polygons"), tri.alias("loop_triangles"))
    # one document per object record keeps documents bounded whatever the table size
    scenes = W.table(spark, sf, "part").select(F.col("p_size").alias("scene_id"), F.to_json(F.struct(F.array(record).alias("objects"))).alias("text"))
    return D.scan_scene_records(scenes, ["scene_id"])[0]


def _mixed_scenes(spark, sf):
    """Scene documents of a record that may be out of place and a sound one; with a repeated key, without objects, with an index or a vertex out of place."""
    k = F.col("p_partkey") % 11
    record = lambda name, vertices, ring: f'{{"name": "{name}", "vertices_world_m": {vertices}, "polygons": [{ring}], "loop_triangles": [{{"vertex_indices": [0, 1, 2], "polygon_index": 0}}]}}'
    flat, ring = "[[0,0,0],[1,0,0],[0,1,0]]", "[0, 1, 2]"
    whole = lambda v=flat, r=ring: f'{{"objects": [{record("a", v, r)}, {record("b", flat, ring)}]}}'
    text = (F.when(k == 0, whole()[:-1] + ', "objects": []}').when(k == 1, '{"other": 1}').when(k == 2, whole(r="[0, 1, 3]")).when(k == 3, whole(v="[[0,0,0],[1,0],[0,1,0]]"))
            .when(k == 4, whole(r="[0, 1]")).otherwise(whole()))
    return W.table(spark, sf, "part").select("p_partkey", text.alias("text"))


@query("""SELECT CASE p_partkey % 11 WHEN 0 THEN 'not_strict_json' WHEN 1 THEN 'no_objects' ELSE 'record_does_not_fit' END AS rule, CAST(p_partkey AS VARCHAR) AS entity_id,
 CASE WHEN p_partkey % 11 > 1 THEN '0' END AS detail FROM part WHERE p_partkey % 11 < 5""")
def scan_scene_findings(spark, sf):
    return D.check_scene_documents(_mixed_scenes(spark, sf), ["p_partkey"])


@query("""WITH r AS (SELECT p_partkey, unnest(CASE WHEN p_partkey % 11 < 2 THEN [] WHEN p_partkey % 11 < 5 THEN ['b'] ELSE ['a', 'b'] END) AS object_id FROM part)
SELECT 'vertex' AS part, p_partkey, object_id, i AS place FROM r, (SELECT unnest([0, 1, 2]) AS i)
UNION ALL SELECT 'face', p_partkey, object_id, 0 FROM r UNION ALL SELECT 'triangle', p_partkey, object_id, 0 FROM r""")
def scan_scene_records_mixed(spark, sf):
    """All three tables: sound records stay where their neighbour is refused, and nothing of refused ones comes out."""
    vertices, faces, triangles = D.scan_scene_records(_mixed_scenes(spark, sf), ["p_partkey"])
    out = [df.select(F.lit(part).alias("part"), "p_partkey", "object_id", F.col(part).alias("place")) for part, df in (("vertex", vertices), ("face", faces), ("triangle", triangles))]
    return out[0].unionByName(out[1]).unionByName(out[2])


# --- sinks ------------------------------------------------------------------


@query(with_views("px cam pts", """SELECT capture_id, frame_id, count(*) AS points, round(min(x), 6) AS min_x, round(max(z), 6) AS max_z FROM pts GROUP BY 1, 2"""))
def sink_reference_cloud(spark, sf):
    """Written to the shared folder and read back with its frame metadata."""
    _, frames = K.sink_reference_cloud(W.pts(spark, sf).select("capture_id", "frame_id", "v", "u", "x", "y", "z"), fresh_path(spark, "cloud"))
    return rounded(spark.read.parquet(frames).select("capture_id", "frame_id", "points", "min_x", "max_z"), "min_x", "max_z")


@query(with_views("components", """SELECT capture_id, count(DISTINCT frame_id) FILTER (WHERE component = 'rgb') AS rgb FROM components GROUP BY 1"""))
def sink_intake_records(spark, sf):
    components = W.components(spark, sf)
    index = components.where("component = 'rgb'").select("capture_id", "frame_id").distinct()
    _, inventory = K.sink_intake_records(index, I.component_counts(components), fresh_path(spark, "intake"))
    return spark.read.schema("capture_id long, rgb long").json(inventory)


@query(with_views("px", "SELECT capture_id, frame_id, count(*) AS native_patch_pixels FROM px GROUP BY 1, 2"))
def sink_measurements(spark, sf):
    px = W.px(spark, sf)
    patches = px.groupBy("capture_id", "frame_id").agg(F.count("*").alias("native_patch_pixels"))
    comparisons = patches.groupBy("capture_id").agg(F.count("*").alias("patches"))
    written = K.sink_measurements(patches, P.eligible_pixels(px), comparisons, fresh_path(spark, "measurements"))
    return spark.read.parquet(written[0])


@query("SELECT p_type AS level, count(*) AS object_count FROM part GROUP BY 1 HAVING count(*) FILTER (WHERE p_size % 5 NOT IN (3, 4)) > 0")
def sink_model_catalog(spark, sf):
    from plumbline.operators.coverage import sink_catalog
    from plumbline.plans.coverage_queries import _objects

    objects = _objects(spark, sf)
    viewpoints = P.bounds(W.pts(spark, sf), ["capture_id"])
    written = K.sink_model_catalog(viewpoints, sink_catalog(objects), objects, fresh_path(spark, "catalog"))
    return spark.read.schema("level string, object_count long").json(written[1])


@query("SELECT s_suppkey AS id, s_name AS name, true AS refused FROM supplier")
def sink_fresh_only(spark, sf):
    """A second write to the same place must be refused and leave the first intact."""
    df = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    path = K.sink_fresh_only(df, fresh_path(spark, "fresh"))
    try:
        K.sink_fresh_only(df.where("id < 0"), path)
        refused = False
    except Exception as error:  # the analysis error of an existing path
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return spark.read.parquet(path).withColumn("refused", F.lit(refused))


# --- streams ----------------------------------------------------------------


def _event_stream(spark, sf):
    schema = W.table(spark, sf, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return stream.select(
        F.col("user_id").alias("capture_id"), W.component_name(F.col("event_type")).alias("component"),
        F.floor(W.epoch_seconds("ts") / 604800).alias("frame_id"), F.sha2("props", 256).alias("sha256"), F.col("ts").cast("timestamp").alias("ts"))


def _run_to_end(stream, path: str, checkpoint: str):
    running = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    running.awaitTermination()


def _daily_frames(spark, sf):
    """Three frames a week: the frame is the day modulo three, so a window holds several frames."""
    return _event_stream(spark, sf).withColumn("frame_id", F.floor(F.unix_timestamp("ts") / 86400) % 3)


_FRAMES = """SELECT user_id AS capture_id, CAST(floor(epoch(ts) / 86400) AS BIGINT) % 3 AS frame_id, CAST(floor(floor(epoch(ts)) / 604800) AS BIGINT) AS week, event_id, ts FROM events"""


@query(with_views("components", f""", e AS ({_FRAMES}), w AS (SELECT e.capture_id, e.frame_id, week, count(*) AS arrivals, bool_or(component = 'rgb') AS a, bool_or(component = 'raw_camera') AS b,
 bool_or(component = 'raw_depth') AS c, bool_or(component = 'raw_confidence') AS d FROM e JOIN components USING (event_id) GROUP BY 1, 2, 3)
SELECT capture_id, frame_id, week, arrivals, a AND b AND c AND d AS complete, array_to_string(list_filter([CASE WHEN NOT a THEN 'rgb' END, CASE WHEN NOT b THEN 'raw_camera' END, CASE WHEN NOT c THEN 'raw_depth' END, CASE WHEN NOT d THEN 'raw_confidence' END], lambda x: x IS NOT NULL), ',') AS missing
FROM w WHERE (week + 1) * 604800 <= (SELECT floor(epoch(max(ts)) * 1000) / 1000 - 86400 FROM events)"""))
def stream_frame_completeness(spark, sf):
    """The event table as a stream: windows the watermark has passed, complete or not."""
    out = J.stream_frame_completeness(_daily_frames(spark, sf))
    path = fresh_path(spark, "completeness")
    _run_to_end(out, path, fresh_path(spark, "completeness-state"))
    rows = spark.read.schema("capture_id long, frame_id long, window_start timestamp, arrivals long, complete boolean, missing string").parquet(path)
    return rows.select("capture_id", "frame_id", F.floor(F.unix_timestamp("window_start") / 604800).alias("week"), "arrivals", "complete", "missing")


_INTAKE = """, v AS (SELECT e.user_id AS capture_id, c.component, c.frame_id, sha256(e.props) AS sha256, min(e.ts) AS ts FROM events e JOIN components c USING (event_id) GROUP BY 1, 2, 3, 4),
f AS (SELECT *, first_value(sha256) OVER (PARTITION BY capture_id, component, frame_id ORDER BY ts, sha256) AS kept FROM v)
"""


def _intake(spark, sf):
    path = fresh_path(spark, "intake-stream")
    J.stream_intake(_event_stream(spark, sf), path, fresh_path(spark, "intake-state")).awaitTermination()
    return path


@query(with_views("components", _INTAKE + "SELECT capture_id, component, frame_id, sha256 FROM f WHERE sha256 = kept"))
def stream_intake(spark, sf):
    """First content per component wins; repeats of it are absorbed."""
    rows = spark.read.option("recursiveFileLookup", True).schema("capture_id long, component string, frame_id long, sha256 string").parquet(f"{_intake(spark, sf)}/accepted")
    return rows


@query(with_views("components", _INTAKE + "SELECT capture_id, component, frame_id, sha256, kept AS kept_sha256 FROM f WHERE sha256 <> kept"))
def stream_intake_rejected(spark, sf):
    """Changed content under a known key needs a new capture id."""
    return spark.read.option("recursiveFileLookup", True).schema("capture_id long, component string, frame_id long, sha256 string, kept_sha256 string").parquet(f"{_intake(spark, sf)}/rejected")


# --- streams with state by key -----------------------------------------------


@query(with_views("components", f""", e AS ({_FRAMES}), w AS (SELECT e.capture_id, e.frame_id, week, count(*) AS arrivals, bool_or(component = 'rgb') AS a, bool_or(component = 'raw_camera') AS b,
 bool_or(component = 'raw_depth') AS c, bool_or(component = 'raw_confidence') AS d FROM e JOIN components USING (event_id) GROUP BY 1, 2, 3)
SELECT capture_id, frame_id, week, arrivals, a AND b AND c AND d AS complete, array_to_string(list_filter([CASE WHEN NOT a THEN 'rgb' END, CASE WHEN NOT b THEN 'raw_camera' END, CASE WHEN NOT c THEN 'raw_depth' END, CASE WHEN NOT d THEN 'raw_confidence' END], lambda x: x IS NOT NULL), ',') AS missing
FROM w WHERE (a AND b AND c AND d) OR (week + 1) * 604800 <= (SELECT floor(epoch(max(ts)) * 1000) / 1000 - 86400 FROM events)"""))
def stream_frames(spark, sf):
    """Complete frames at once, whatever their window; the others when their timer fires."""
    return _frame_rows(_frame_runs(spark, sf, 1))


def _frame_runs(spark, sf, runs: int):
    """The events in ``runs`` arrivals by their id, each taken up by a new start of the stream on one checkpoint."""
    source, path, state = (fresh_path(spark, f"frames-{n}") for n in ("in", "out", "state"))
    events = cut_lineage(_batch_frames(spark, sf))
    for k in range(runs):
        events.where(F.col("event_id") % runs == k).drop("event_id").write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.drop("event_id").schema).parquet(source)
        _run_to_end(KS.stream_frames(stream, late_for=timedelta(days=60)), path, state)
    return spark.read.schema("capture_id long, frame_id long, window_ms long, kind string, component string, ts timestamp, arrivals long, complete boolean, missing string").parquet(path)


def _batch_frames(spark, sf):
    """Three frames a week as in the daily stream, with the event's id."""
    return W.table(spark, sf, "events").select(
        F.col("user_id").alias("capture_id"), W.component_name(F.col("event_type")).alias("component"), (F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 86400) % 3).alias("frame_id"),
        F.col("ts").cast("timestamp").alias("ts"), "event_id")


def _frame_rows(rows):
    return rows.where("kind = 'frame'").select("capture_id", "frame_id", F.floor(F.col("window_ms") / 604800000).alias("week"), "arrivals", "complete", "missing")


_RUNS = f""", e AS ({_FRAMES}), p AS (SELECT e.*, event_id % 3 AS run, component FROM e JOIN components USING (event_id)),
clock AS (SELECT r.run, (SELECT floor(epoch(max(p.ts)) * 1000) / 1000 - 86400 FROM p WHERE p.run <= r.run) AS passed FROM range(3) r(run)),
upto AS (SELECT capture_id, frame_id, week, c.run, count(*) AS arrivals, bool_or(component = 'rgb') AS a, bool_or(component = 'raw_camera') AS b, bool_or(component = 'raw_depth') AS c,
 bool_or(component = 'raw_confidence') AS d, (week + 1) * 604800 <= any_value(passed) AS closed FROM p JOIN clock c ON p.run <= c.run GROUP BY 1, 2, 3, 4),
told AS (SELECT * FROM upto WHERE closed OR (a AND b AND c AND d) QUALIFY row_number() OVER (PARTITION BY capture_id, frame_id, week ORDER BY run) = 1)
"""


@query(with_views("components", _RUNS + """SELECT capture_id, frame_id, week, arrivals, a AND b AND c AND d AS complete, array_to_string(list_filter([CASE WHEN NOT a THEN 'rgb' END, CASE WHEN NOT b THEN 'raw_camera' END,
 CASE WHEN NOT c THEN 'raw_depth' END, CASE WHEN NOT d THEN 'raw_confidence' END], lambda x: x IS NOT NULL), ',') AS missing FROM told"""))
def stream_frames_restarted(spark, sf):
    """A third of the events at a time, with a restart between: each frame is reported once."""
    return _frame_rows(_frame_runs(spark, sf, 3))


@query(with_views("components", _RUNS + """SELECT capture_id, frame_id, week, component, epoch_us(p.ts) AS at_us FROM p JOIN told t USING (capture_id, frame_id, week) WHERE p.run > t.run"""))
def stream_late_pieces(spark, sf):
    """The pieces of the same three runs that came after their frame's report."""
    rows = _frame_runs(spark, sf, 3).where("kind = 'late'")
    return rows.select("capture_id", "frame_id", F.floor(F.col("window_ms") / 604800000).alias("week"), "component", F.unix_micros("ts").alias("at_us"))


_RUN_CONTENTS = """, v AS (SELECT e.user_id AS capture_id, c.component, c.frame_id, sha256(e.props) AS sha256, event_id % 3 AS run, min(e.ts) AS ts FROM events e JOIN components c USING (event_id) GROUP BY 1, 2, 3, 4, 5),
f AS (SELECT *, first_value(sha256) OVER (PARTITION BY capture_id, component, frame_id ORDER BY run, ts, sha256) AS kept FROM v)
"""


def _content_runs(spark, sf):
    """The events in three arrivals, each taken up by a new start of the stream on one checkpoint."""
    source, path, state = (fresh_path(spark, f"contents-{n}") for n in ("in", "out", "state"))
    rows = cut_lineage(W.components(spark, sf).join(W.table(spark, sf, "events").select("event_id", F.sha2("props", 256).alias("sha256")), "event_id")
                       .select("capture_id", "component", "frame_id", "sha256", F.col("ts").cast("timestamp").alias("ts"), "event_id"))
    for k in range(3):
        rows.where(F.col("event_id") % 3 == k).drop("event_id").write.mode("append").parquet(source)
        KS.stream_first_contents(spark.readStream.schema(rows.drop("event_id").schema).parquet(source), path, state).awaitTermination()
    return path


@query(with_views("components", _RUN_CONTENTS + "SELECT DISTINCT capture_id, component, frame_id, sha256 FROM f WHERE sha256 = kept"))
def stream_first_contents(spark, sf):
    """First content per component over three runs; repeats of it are absorbed by the state."""
    return spark.read.option("recursiveFileLookup", True).schema("capture_id long, component string, frame_id long, sha256 string").parquet(f"{_content_runs(spark, sf)}/accepted")


@query(with_views("components", _RUN_CONTENTS + "SELECT capture_id, component, frame_id, sha256, kept AS kept_sha256 FROM f WHERE sha256 <> kept"))
def stream_refused_contents(spark, sf):
    """Other contents under a known key, once per run that brings them."""
    return spark.read.option("recursiveFileLookup", True).schema("capture_id long, component string, frame_id long, sha256 string, kept_sha256 string").parquet(f"{_content_runs(spark, sf)}/rejected")
