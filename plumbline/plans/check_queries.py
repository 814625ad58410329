"""Registered queries: row rules with planted defects."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plumbline.operators import checks as C
from plumbline.plans import views as W
from plumbline.plans.registry import query
from plumbline.plans.views import with_views
from plumbline.session import spread_out


def _union(*parts: str) -> str:
    return " UNION ALL ".join(f"SELECT '{rule}' AS rule, CAST({entity} AS VARCHAR) AS entity_id FROM {source}" for rule, entity, source in
                              (p.split("|") for p in parts))


def _pose(k, bend=0.0, mirror=None):
    """Exact-rational yaw; optionally bent off orthonormal or mirrored."""
    zero, one = F.lit(0.0), F.lit(1.0)
    flip = one if mirror is None else F.when(mirror, -1.0).otherwise(1.0)
    return F.array(F.lit(0.6) + bend, zero, F.lit(0.8), zero, zero, flip, zero, F.lit(1.5), F.lit(-0.8), zero, F.lit(0.6), zero, zero, zero, zero, one)


@query(_union("width_not_positive|s_suppkey|supplier WHERE s_suppkey % 11 = 0", "fx_not_finite|s_suppkey|supplier WHERE s_suppkey % 13 = 0",
              "height_not_integer|s_suppkey|supplier WHERE s_suppkey % 17 = 0", "cx_not_finite|s_suppkey|supplier WHERE s_suppkey % 19 = 0",
              "pose_incomplete|s_suppkey|supplier WHERE s_suppkey % 7 = 0", "pose_not_rigid|s_suppkey|supplier WHERE s_suppkey % 7 <> 0 AND s_suppkey % 5 = 0",
              "pose_not_proper|s_suppkey|supplier WHERE s_suppkey % 7 <> 0 AND (s_suppkey % 3 = 0 OR s_suppkey % 5 = 0)"))
def check_camera(spark, sf):
    k = F.col("s_suppkey")
    bent = F.when(k % 5 == 0, 0.01).otherwise(0.00001)
    pose = F.when(k % 7 == 0, F.slice(_pose(k), 1, 15)).otherwise(_pose(k, bent, k % 3 == 0))
    cameras = W.table(spark, sf, "supplier").select(
        k.alias("frame_id"), F.when(k % 11 == 0, 0.0).otherwise(384.0).alias("width"), F.when(k % 17 == 0, 256.5).otherwise(256.0).alias("height"),
        F.when(k % 13 == 0, float("nan")).otherwise(300.0).alias("fx"), F.lit(300.0).alias("fy"), F.when(k % 19 != 0, 192.0).alias("cx"), F.lit(128.0).alias("cy"), pose.alias("pose"))
    return C.check_camera(cameras).select("rule", "entity_id")


@query(_union("pose_not_rigid|o_orderkey|orders WHERE o_orderkey % 9 IN (2, 3)", "pose_not_proper|o_orderkey|orders WHERE o_orderkey % 9 IN (2, 3, 4)",
              "pose_not_homogeneous|o_orderkey|orders WHERE o_orderkey % 9 = 5"))
def check_rigid(spark, sf):
    """Bends of 1e-7 pass, larger ones and mirrors do not."""
    k = F.col("o_orderkey") % 9
    m = _pose(k, F.when(k == 1, 1e-7).when(k == 2, 1e-5).when(k == 3, 0.1).otherwise(0.0), k == 4)
    m = F.when(k == 5, F.concat(F.slice(m, 1, 15), F.array(F.lit(1.001)))).otherwise(m)
    return C.check_rigid(W.table(spark, sf, "orders").select("o_orderkey", m.alias("matrix")), "o_orderkey").select("rule", "entity_id")


@query(_union("depth_empty|l_suppkey|(SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 9 = 0", "confidence_size|l_suppkey|(SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 8 = 0 OR l_suppkey % 9 = 0",
              "aspect_ratio|l_suppkey|(SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 7 = 0 OR l_suppkey % 9 = 0", "rgb_size|l_suppkey|(SELECT DISTINCT l_suppkey FROM lineitem) WHERE l_suppkey % 5 = 0"))
def check_depth_frame(spark, sf):
    k = F.col("l_suppkey")
    frames = W.table(spark, sf, "lineitem").select("l_suppkey").distinct().select(
        k.alias("frame_id"), F.when(k % 9 == 0, 0).otherwise(192).alias("depth_width"), F.when(k % 7 == 0, 127).otherwise(128).alias("depth_height"),
        F.when(k % 8 == 0, 191).otherwise(192).alias("confidence_width"), F.when(k % 7 == 0, 127).otherwise(128).alias("confidence_height"),
        F.when(k % 5 == 0, 383).otherwise(384).alias("rgb_width"), F.lit(256).alias("rgb_height"), F.lit(384).alias("width"), F.lit(256).alias("height"))
    return C.check_depth_frame(frames).select("rule", "entity_id")


@query(_union("ring_not_finite|p_partkey|part WHERE p_partkey % 7 = 1", "ring_degenerate|p_partkey|part WHERE p_partkey % 7 = 2", "ring_not_coplanar|p_partkey|part WHERE p_partkey % 7 = 3",
              "ring_not_simple|p_partkey|part WHERE p_partkey % 7 = 4"))
def check_polygon_ring(spark, sf):
    """Sound rings, and rings with two points, no area, a lifted corner or a crossing."""
    k = F.col("p_partkey")
    w, h, z = (F.col("p_size") % 5 + 2).cast("double"), (k % 4 + 3).cast("double"), (k % 3).cast("double")
    p = lambda x, y, up=z: F.array(x, y, up)
    o = F.lit(0.0)
    good = F.array(p(o, o), p(w, o), p(w, h), p(w / 2, h / 2), p(o, h))
    ring = (F.when(k % 7 == 1, F.array(p(o, o), p(w, o))).when(k % 7 == 2, F.array(p(o, o), p(w, o), p(w * 2, o)))
            .when(k % 7 == 3, F.array(p(o, o), p(w, o), p(w, h, z + 0.001), p(o, h))).when(k % 7 == 4, F.array(p(o, o), p(w, h), p(w, o), p(o, h + 1))).otherwise(good))
    return C.check_polygon_ring(W.table(spark, sf, "part").select(k.alias("polygon_id"), ring.alias("vertices"))).select("rule", "entity_id")


@query("SELECT 'ring_not_simple' AS rule, CAST(p_partkey AS VARCHAR) AS entity_id FROM part WHERE p_partkey % 3 = 1")
def check_long_rings(spark, sf):
    """Cogs of 80 to 120 edges around a part, a third of them with a tooth that crosses the far side."""
    k = F.col("p_partkey")
    teeth = 40 + F.col("p_size") % 21
    angle = lambda i: i * (2 * math.pi) / (2 * teeth)
    corner = lambda i: F.array(F.cos(angle(i)) * F.when(i % 2 == 0, 5.0).otherwise(4.5), F.sin(angle(i)) * F.when(i % 2 == 0, 5.0).otherwise(4.5), F.lit(1.0))
    ring = F.transform(F.sequence(F.lit(0), 2 * teeth - 1), corner)
    thrust = F.transform(ring, lambda p, i: F.when((k % 3 == 1) & (i == 7), F.array(p[0] * -2, p[1] * -2, p[2])).otherwise(p))
    parts = spread_out(W.table(spark, sf, "part").select("p_partkey", "p_size"))  # a small file is one task, and each of its rows becomes a hundred edges
    return C.check_polygon_ring(parts.select(k.alias("polygon_id"), thrust.alias("vertices"))).select("rule", "entity_id")


def _observations(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, "point").when(k % 4 == 1, "polyline").when(k % 4 == 2, "polygon").otherwise("circle")
    pt = lambda u, v: F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))
    coords = F.array(pt(c % 384, k % 256), pt((c * 3) % 384, (k * 3) % 256), pt((c * 5) % 390, (k * 5) % 256))
    coords = F.slice(coords, F.lit(1), (1 + c % 3).cast("int"))
    end = lambda i, kd, b: F.struct(F.lit(i).alias("index"), F.lit(kd).alias("kind"), F.lit(b).alias("basis"))
    none = F.array().cast("array<struct<index:int,kind:string,basis:string>>")
    ends = (F.when(k % 10 == 0, F.lit(None)).when(k % 4 != 1, F.when(k % 7 == 0, F.array(end(0, "occlusion", "x"))).otherwise(none))
            .when(c % 5 == 0, F.array(end(0, "occlusion", "x"))).when(c % 5 == 1, F.array(end(0, "occlusion", "x"), end(-1, "corner", "y")))
            .when(c % 5 == 2, F.array(end(-1, "occlusion", " "), end(0, "unknown", "y"))).otherwise(F.array(end(0, "image boundary", "a"), end(-1, "unknown", "b"))))
    return W.table(spark, sf, "orders").select(
        k.alias("id"), kind.alias("mark_type"), F.when(c % 29 == 0, "").otherwise("edge").alias("meaning"), coords.alias("coords"), ends.alias("endpoints"),
        F.lit(384).alias("width"), F.lit(256).alias("height"))


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey AS c, o_orderkey % 4 AS t, 1 + o_custkey % 3 AS n FROM orders) " + _union(
    "mark_type|id|o WHERE t = 3", "mark_meaning|id|o WHERE c % 29 = 0", "too_few_coordinates|id|o WHERE t < 3 AND n < t + 1", "point_has_several|id|o WHERE t = 0 AND n > 1",
    "coordinate_outside|id|o WHERE n = 3 AND (c * 5) % 390 > 383"))
def check_marks(spark, sf):
    return C.check_marks(_observations(spark, sf)).select("rule", "entity_id")


@query("WITH o AS (SELECT o_orderkey AS id, o_custkey % 5 AS c, o_orderkey % 4 = 1 AS line, o_orderkey % 10 = 0 AS gone FROM orders) " + _union(
    "endpoints_missing|id|o WHERE gone", "endpoints_on_other_mark|id|o WHERE NOT gone AND NOT line AND id % 7 = 0", "endpoint_indexes|id|o WHERE NOT gone AND line AND c = 0",
    "endpoint_kind|id|o WHERE NOT gone AND line AND c = 1", "endpoint_basis|id|o WHERE NOT gone AND line AND c = 2"))
def check_endpoints(spark, sf):
    return C.check_endpoints(_observations(spark, sf)).select("rule", "entity_id")


@query("""SELECT 'id_not_safe' AS rule, CAST(doc_id AS VARCHAR) AS entity_id FROM documents WHERE doc_id % 2 = 0 AND NOT regexp_full_match(text, '[A-Za-z0-9][A-Za-z0-9._-]*')
UNION ALL SELECT 'sha_not_sha256', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT 'lang_empty', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 8 = 0
UNION ALL SELECT 'score_not_finite', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 7 = 0 UNION ALL SELECT 'n_chars_below_minimum', CAST(doc_id AS VARCHAR) FROM documents WHERE n_chars < 500""")
def check_ids(spark, sf):
    k = F.col("doc_id")
    sha = F.sha2("text", 256)
    docs = W.table(spark, sf, "documents").select(
        "doc_id", F.when(k % 2 == 0, F.col("text")).otherwise(F.concat("source", F.lit("-"), k.cast("string"))).alias("id"), F.when(k % 9 == 0, F.upper(sha)).otherwise(sha).alias("sha"), F.when(k % 8 == 0, "  ").otherwise(F.col("lang")).alias("lang"),
        F.when(k % 7 == 0, float("inf")).otherwise(F.col("n_chars").cast("double")).alias("score"), "n_chars")
    docs = docs.withColumn("sha", F.when(k % 9 == 0, F.concat(F.lit("Z"), F.col("sha"))).otherwise(F.col("sha")))
    return C.check_ids(docs, "doc_id", ids=("id",), hashes=("sha",), filled=("lang",), numbers=("score",), minima={"n_chars": 500}).select("rule", "entity_id")


# --- archives ---------------------------------------------------------------

W.SQL["member"] = """SELECT p_partkey % 50 AS archive_id, p_partkey AS k, CASE WHEN p_partkey % 97 = 1 THEN '../' WHEN p_partkey % 97 = 2 THEN '/' WHEN p_partkey % 97 = 3 THEN 'c:' WHEN p_partkey % 97 = 4 THEN 'All/' ELSE 'scan/' END
 || CASE WHEN p_partkey % 5 = 0 THEN 'keyframes/' ELSE 'Keyframes/' END || CASE WHEN p_partkey % 83 = 0 THEN 'b\\' ELSE '' END || 'f' || CAST(p_size AS VARCHAR) || '.png' AS name,
 CASE WHEN p_partkey % 61 = 0 THEN 41471 WHEN p_partkey % 59 = 0 THEN 4516 ELSE 33188 END AS mode FROM part"""


def members(spark, sf):
    """Archive members from parts: unsafe paths, links, devices, reserved roots, case aliases, repeats."""
    k = F.col("p_partkey")
    head = F.when(k % 97 == 1, "../").when(k % 97 == 2, "/").when(k % 97 == 3, "c:").when(k % 97 == 4, "All/").otherwise("scan/")
    folder = F.when(k % 5 == 0, "keyframes/").otherwise("Keyframes/")
    name = F.concat(head, folder, F.when(k % 83 == 0, "b\\").otherwise(""), F.lit("f"), F.col("p_size").cast("string"), F.lit(".png"))
    return W.table(spark, sf, "part").select(
        (k % 50).alias("archive_id"), name.alias("name"), F.lit(False).alias("is_dir"), F.when(k % 61 == 0, 41471).when(k % 59 == 0, 4516).otherwise(33188).alias("mode"))


@query(with_views("member", ", e AS (SELECT *, CAST(archive_id AS VARCHAR) || '/' || name AS e FROM member) " + _union(
    "unsafe_path|e|e WHERE k % 97 IN (1, 2, 3) OR k % 83 = 0", "symlink|e|e WHERE k % 61 = 0", "special_file|e|e WHERE k % 61 <> 0 AND k % 59 = 0", "reserved_root|e|e WHERE k % 97 = 4")))
def check_archive_paths(spark, sf):
    return C.check_archive_paths(members(spark, sf)).select("rule", "entity_id")


_PREFIX = """, pre AS (SELECT archive_id, string_split(name, '/') AS parts, name FROM member),
lev AS (SELECT archive_id, array_to_string(parts[1:i], '/') AS prefix, i = len(parts) AS is_file FROM (SELECT *, unnest(range(1, len(parts) + 1)) AS i FROM pre))
"""


@query("SELECT doc_id, sha256(replace(lower(nfc_normalize(text)), 'ß', 'ss')) AS folded_sha256 FROM documents")
def nfc_casefold(spark, sf):
    """Whole document texts folded; sharp s is the one letter where folding is more than lowering here."""
    return W.table(spark, sf, "documents").select("doc_id", F.sha2(C.nfc_casefold("text"), 256).alias("folded_sha256"))


@query(with_views("member", _PREFIX + """SELECT archive_id, lower(prefix) AS alias, 'alias' AS kind FROM lev GROUP BY archive_id, lower(prefix) HAVING count(DISTINCT prefix) > 1
UNION ALL SELECT archive_id, lower(name), 'duplicate' FROM member GROUP BY archive_id, lower(name) HAVING count(*) > 1"""))
def alias_conflict(spark, sf):
    return C.alias_conflict(members(spark, sf))


@query(with_views("member", _PREFIX + """, d AS (SELECT archive_id, prefix, is_file FROM lev UNION ALL SELECT archive_id, array_to_string(parts[1:2], '/') || '/f1.png', false FROM pre WHERE archive_id % 2 = 0
 UNION ALL SELECT archive_id, array_to_string(parts[1:2], '/'), false FROM pre WHERE archive_id % 2 = 0)
SELECT archive_id, lower(prefix) AS alias FROM d GROUP BY archive_id, lower(prefix) HAVING bool_or(is_file) AND bool_or(NOT is_file)"""))
def file_dir_conflict(spark, sf):
    """Even archives also hold a directory called f1.png in every folder."""
    m = members(spark, sf)
    parts = F.split("name", "/")
    extra = m.where("archive_id % 2 = 0").select("archive_id", F.concat(F.array_join(F.slice(parts, 1, 2), "/"), F.lit("/f1.png/")).alias("name"), F.lit(True).alias("is_dir"), F.lit(16877).alias("mode"))
    return C.file_dir_conflict(m.unionByName(extra))


@query(with_views("member", """, r AS (SELECT archive_id, CASE WHEN list_contains(string_split(name, '/'), 'keyframes') THEN array_to_string(string_split(name, '/')[1:list_position(string_split(name, '/'), 'keyframes') - 1], '/') END AS root FROM member)
SELECT archive_id, CASE WHEN count(DISTINCT root) = 1 THEN min(root) END AS root, count(DISTINCT root) = 1 AS single FROM r GROUP BY archive_id"""))
def single_root(spark, sf):
    return C.single_root(members(spark, sf))


@query("""SELECT 'path_absolute' AS rule, CAST(doc_id AS VARCHAR) AS entity_id FROM documents WHERE doc_id % 11 = 0
UNION ALL SELECT 'path_escapes', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 11 = 1 UNION ALL SELECT 'path_missing', CAST(doc_id AS VARCHAR) FROM documents WHERE doc_id % 11 NOT IN (0, 1) AND doc_id % 6 = 0""")
def check_relative_paths(spark, sf):
    k = F.col("doc_id")
    name = F.concat(F.lit("a/../d"), k.cast("string"))
    docs = W.table(spark, sf, "documents").select("doc_id", F.lit("/out").alias("root"), F.when(k % 11 == 0, F.concat(F.lit("/"), name)).when(k % 11 == 1, F.concat(F.lit("../"), name)).otherwise(name).alias("path"))
    files = W.table(spark, sf, "documents").where("doc_id % 6 <> 0").select(F.concat(F.lit("/out//d"), k.cast("string")).alias("path"))
    return C.check_relative_paths(docs, "doc_id", "path", files).select("rule", "entity_id")


@query("""WITH p AS (SELECT o_orderkey AS patch_id, CASE WHEN o_orderkey % 3 <> 0 THEN o_custkey % 4 END AS seg, CASE WHEN s_suppkey % 5 <> 0 THEN s_suppkey % 4 END AS cam FROM orders LEFT JOIN supplier ON s_suppkey = o_custkey % 100)
SELECT 'segment_unavailable' AS rule, CAST(patch_id AS VARCHAR) AS entity_id FROM p WHERE seg IS NOT NULL AND cam IS NULL UNION ALL SELECT 'segment_differs', CAST(patch_id AS VARCHAR) FROM p WHERE seg <> cam""")
def check_tracking_scope(spark, sf):
    patches = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("patch_id"), (F.col("o_custkey") % 100).alias("frame_id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_custkey") % 4).alias("tracking_segment"))
    cameras = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("frame_id"), F.when(F.col("s_suppkey") % 5 != 0, F.col("s_suppkey") % 4).alias("tracking_segment"))
    return C.check_tracking_scope(patches, cameras).select("rule", "entity_id")


# --- contracts --------------------------------------------------------------

@query("""WITH j AS (SELECT c_custkey AS id, c_custkey % 10 AS t, c_custkey % 3 AS s FROM customer), o AS (SELECT o_custkey AS job, o_orderkey AS id, o_orderkey % 10 AS t FROM orders)
SELECT 'units' AS rule, CAST(id AS VARCHAR) AS entity_id FROM j WHERE t = 1 UNION ALL SELECT 'title', CAST(id AS VARCHAR) FROM j WHERE t = 2 UNION ALL SELECT 'deliverables', CAST(id AS VARCHAR) FROM j WHERE t IN (3, 4, 5)
UNION ALL SELECT 'interpolation_undeclared', CAST(id AS VARCHAR) FROM j WHERE t = 6 UNION ALL SELECT 'geometry_status', CAST(id AS VARCHAR) FROM j WHERE t = 7 UNION ALL SELECT 'model_scope', CAST(id AS VARCHAR) FROM j WHERE t = 8
UNION ALL SELECT 'views_required', CAST(id AS VARCHAR) FROM j WHERE t IN (4, 9) AND id % 4 = 1
UNION ALL SELECT 'object_name', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 1 UNION ALL SELECT 'object_place', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 2
UNION ALL SELECT 'object_name_repeated', CAST(job AS VARCHAR) || '/' || n FROM (SELECT job, CASE WHEN t = 1 THEN ' ' WHEN t = 3 THEN 'same' ELSE 'o' || CAST(id AS VARCHAR) END AS n FROM o) GROUP BY job, n HAVING count(*) > 1
UNION ALL SELECT 'appearance_method', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 4
UNION ALL SELECT 'color', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 5 UNION ALL SELECT 'roughness_range', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 6
UNION ALL SELECT 'source_identities', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 7 UNION ALL SELECT 'mapping_axes', CAST(job AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 8
UNION ALL SELECT 'interpolation_unauthorized', CAST(job AS VARCHAR) || '/' || CAST(o.id AS VARCHAR) FROM o LEFT JOIN j ON j.id = job WHERE (j.id IS NULL OR j.t = 6 OR j.s = 0) AND o.t IN (4, 8)
UNION ALL SELECT 'view_minimum_pixels', CAST(id AS VARCHAR) || '/v' FROM j WHERE id % 4 <> 1 AND t = 3 UNION ALL SELECT 'view_subjects', CAST(id AS VARCHAR) || '/v' FROM j WHERE id % 4 <> 1 AND t = 5
UNION ALL SELECT 'exclusion_in_full_model', CAST(id AS VARCHAR) || '/same' FROM j WHERE s = 1 AND t <> 0 UNION ALL SELECT 'exclusion_declared', CAST(id AS VARCHAR) || '/same' FROM j WHERE s = 1 AND id IN (SELECT job FROM o WHERE t = 3)""")
def check_contract(spark, sf):
    """Customers as delivery jobs, orders as their objects and materials."""
    k = F.col("c_custkey")
    t, s = k % 10, k % 3
    text = lambda *v: F.array(*map(F.lit, v))
    customer = W.table(spark, sf, "customer")
    jobs = customer.select(
        k.alias("job_id"), F.lit(1).alias("schema_version"), F.when(t == 1, "mm").otherwise("m").alias("units"), F.when(t == 2, " ").otherwise("Hall").alias("title"),
        F.when(t == 3, text("native", "film")).when(t == 4, text("stills", "stills")).when(t == 5, F.array().cast("array<string>")).when(t == 9, text("viewer")).otherwise(text("native", "glb")).alias("deliverables"),
        F.when(t != 6, s != 0).alias("interpolation_authorized"), F.lit("brief").alias("basis"), F.when(t == 7, "guessed").otherwise("accepted").alias("geometry_status"), F.lit("limits").alias("metric_status"),
        F.when(t == 8, "half").when(t == 0, "selected-objects").otherwise("full-model").alias("model_scope"))
    o = F.col("o_orderkey")
    u = o % 10
    orders = W.table(spark, sf, "orders")
    objects = orders.select(F.col("o_custkey").alias("job_id"), o.alias("id"), F.when(u == 1, " ").when(u == 3, "same").otherwise(F.concat(F.lit("o"), o.cast("string"))).alias("name"),
                            F.lit("hall").alias("room"), F.when(u == 2, "").otherwise("0").alias("level"), F.lit("wall").alias("role"))
    num = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    materials = orders.select(
        F.col("o_custkey").alias("job_id"), o.alias("id"), F.when(u == 4, "painted").when(u == 8, "repeated-photo").otherwise("matched-color").alias("method"), F.when(u == 5, num(0, 300, 0)).otherwise(num(9, 9, 9)).alias("color"),
        F.lit("photo").alias("basis"), F.when(u == 7, F.array().cast("array<string>")).otherwise(text("s")).alias("sources"), F.when(u == 6, 1.5).otherwise(0.6).alias("roughness"), F.lit(0.0).alias("metallic"),
        F.lit(None).cast("double").alias("transmission"), num(1, 0, 0).alias("mapping_u"), F.when(u == 8, num(0, 1.1, 0)).otherwise(num(0, 1, 0)).alias("mapping_v"), num(1, 2).alias("size_m"))
    views = customer.where("c_custkey % 4 <> 1").select(k.alias("job_id"), F.lit("v").alias("id"), F.lit("cam").alias("camera"),
                                                       F.when(t == 5, F.array().cast("array<string>")).otherwise(text("x")).alias("required_objects"), F.when(t == 3, 0).otherwise(64).alias("minimum_pixels"))
    excluded = customer.where("c_custkey % 3 = 1").select(k.alias("job_id"), F.lit("same").alias("name"), F.lit("furniture").alias("reason"))
    return C.check_contract(jobs, objects, materials, views, excluded).select("rule", "entity_id")


@query("""WITH c AS (SELECT c_custkey AS id, c_custkey % 10 AS t FROM customer), o AS (SELECT o_custkey AS con, o_orderkey AS id, o_orderkey % 7 AS t FROM orders)
SELECT 'mode' AS rule, CAST(id AS VARCHAR) AS entity_id FROM c WHERE t = 1 UNION ALL SELECT 'eye_not_positive', CAST(id AS VARCHAR) FROM c WHERE t = 2 UNION ALL SELECT 'eye_range', CAST(id AS VARCHAR) FROM c WHERE t = 3
UNION ALL SELECT 'engines', CAST(id AS VARCHAR) FROM c WHERE t IN (4, 5) UNION ALL SELECT 'material_mode', CAST(id AS VARCHAR) FROM c WHERE t = 6 UNION ALL SELECT 'schema_version', CAST(id AS VARCHAR) FROM c WHERE t = 7
UNION ALL SELECT 'no_eligible_object', CAST(id AS VARCHAR) FROM c WHERE id NOT IN (SELECT con FROM o WHERE t > 2)
UNION ALL SELECT 'disposition', CAST(con AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t = 0
UNION ALL SELECT 'minimum_visible_pixels', CAST(con AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE id % 11 = 0 UNION ALL SELECT 'minimum_projected_area', CAST(con AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE id % 13 = 0
UNION ALL SELECT 'feature_finding', CAST(con AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE id % 17 = 0 UNION ALL SELECT 'feature_intents', CAST(con AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE id % 19 = 0
UNION ALL SELECT 'feature_object_not_eligible', CAST(con AS VARCHAR) || '/' || CAST(id AS VARCHAR) FROM o WHERE t <= 2""")
def check_presentation_contract(spark, sf):
    k = F.col("c_custkey")
    t = k % 10
    text = lambda *v: F.array(*map(F.lit, v))
    none = F.array().cast("array<string>")
    contracts = W.table(spark, sf, "customer").select(
        k.alias("contract_id"), F.when(t == 7, 2).otherwise(1).alias("schema_version"), F.when(t == 1, "fly").otherwise("cutaway-orbit").alias("mode"), F.when(t == 2, -1.0).when(t == 3, 1.8).otherwise(1.45).alias("eye_minimum"),
        F.lit(1.75).alias("eye_maximum"), F.when(t == 4, text("CYCLES", "OTHER")).when(t == 5, none).otherwise(text("CYCLES")).alias("engines"), F.when(t == 6, "solid").otherwise("materials-and-textures").alias("material_mode"))
    o = F.col("o_orderkey")
    u = o % 7
    orders = W.table(spark, sf, "orders")
    objects = orders.select(F.col("o_custkey").alias("contract_id"), o.alias("id"), F.when(u == 0, "lost").when(u == 1, "retired").when(u == 2, "excluded-source").otherwise("current-eligible").alias("disposition"))
    features = orders.select(
        F.col("o_custkey").alias("contract_id"), o.alias("id"), F.array(o).alias("object_ids"), F.when(o % 19 == 0, none).otherwise(text("walk")).alias("view_intents"), F.when(o % 17 == 0, "").otherwise("f").alias("finding_id"),
        F.when(o % 11 == 0, 0).otherwise(64).alias("minimum_visible_pixels"), F.when(o % 13 == 0, 0.0).otherwise(9.5).alias("minimum_projected_area_px2"))
    return C.check_presentation_contract(contracts, objects, features).select("rule", "entity_id")
