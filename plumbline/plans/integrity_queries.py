"""Registered queries: completeness, membership, diffs, references, closures."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline import rules
from plumbline.functions import text as T
from plumbline.operators import hierarchy as H
from plumbline.operators import integrity as I
from plumbline.plans import views as W
from plumbline.plans.registry import query
from plumbline.plans.views import with_views

_FLAGS = """, flags AS (SELECT capture_id, frame_id, bool_or(component = 'rgb') AS rgb, bool_or(component = 'raw_camera') AS raw_camera,
 bool_or(component = 'raw_depth') AS raw_depth, bool_or(component = 'raw_confidence') AS raw_confidence,
 bool_or(component = 'corrected_camera') AS corrected_camera FROM components GROUP BY capture_id, frame_id),
caps AS (SELECT capture_id, bool_or(rgb) AS has_rgb, bool_or(corrected_camera) AS has_corrected FROM flags GROUP BY capture_id)
"""


@query(with_views("components", _FLAGS + """, need AS (
 SELECT f.*, has_rgb, has_corrected, unnest(['raw_camera', 'raw_depth', 'raw_confidence', 'corrected_camera']) AS component,
  unnest([raw_camera, raw_depth, raw_confidence, corrected_camera]) AS present FROM flags f JOIN caps USING (capture_id))
SELECT capture_id, frame_id, component, CASE WHEN rgb THEN 'missing' ELSE 'orphan' END AS kind FROM need
WHERE has_rgb AND (component <> 'corrected_camera' OR has_corrected) AND present <> rgb
UNION ALL SELECT capture_id, NULL, 'rgb', 'no_rgb' FROM caps WHERE NOT has_rgb"""))
def component_completeness(spark, sf):
    return I.component_completeness(W.components(spark, sf))


@query(with_views("components", """SELECT capture_id, count(DISTINCT frame_id) FILTER (WHERE component = 'rgb') AS rgb,
 count(DISTINCT frame_id) FILTER (WHERE component = 'raw_camera') AS raw_camera, count(DISTINCT frame_id) FILTER (WHERE component = 'raw_depth') AS raw_depth,
 count(DISTINCT frame_id) FILTER (WHERE component = 'raw_confidence') AS raw_confidence, CAST(0 AS BIGINT) AS clean_depth, CAST(0 AS BIGINT) AS clean_confidence,
 count(DISTINCT frame_id) FILTER (WHERE component = 'corrected_camera') AS corrected_camera, 'raw' AS depth_variants,
 CASE WHEN bool_or(component = 'corrected_camera') THEN 'raw,corrected' ELSE 'raw' END AS pose_variants
FROM components GROUP BY capture_id"""))
def component_counts(spark, sf):
    return I.component_counts(W.components(spark, sf))


@query(with_views("components", _FLAGS + """SELECT capture_id, frame_id, 'raw' AS depth_variant, 'raw' AS pose_variant,
 raw_camera AND raw_depth AND raw_confidence AS usable FROM flags WHERE rgb
UNION ALL SELECT capture_id, frame_id, 'raw', 'corrected', corrected_camera AND raw_depth AND raw_confidence
FROM flags JOIN caps USING (capture_id) WHERE rgb AND has_corrected"""))
def variant_matrix_audit(spark, sf):
    return I.variant_matrix_audit(W.components(spark, sf))


@query(with_views("components", _FLAGS + """SELECT capture_id, frame_id FROM flags WHERE rgb AND raw_camera AND raw_depth AND raw_confidence"""))
def assemble_frames(spark, sf):
    return I.assemble_frames(W.components(spark, sf))[0]


@query(with_views("components", _FLAGS + """SELECT 'missing_component' AS rule, CAST(capture_id AS VARCHAR) || '/' || CAST(frame_id AS VARCHAR) AS entity_id,
 array_to_string(list_filter([CASE WHEN NOT rgb THEN 'rgb' END, CASE WHEN NOT raw_camera THEN 'raw_camera' END,
  CASE WHEN NOT raw_depth THEN 'raw_depth' END, CASE WHEN NOT raw_confidence THEN 'raw_confidence' END], lambda x: x IS NOT NULL), ',') AS detail
FROM flags WHERE NOT (rgb AND raw_camera AND raw_depth AND raw_confidence) AND (rgb OR raw_camera OR raw_depth OR raw_confidence)"""))
def assemble_frames_findings(spark, sf):
    return I.assemble_frames(W.components(spark, sf))[1]


@query("""SELECT key, CASE WHEN side = 'o' THEN 'missing' ELSE 'orphan' END AS kind FROM (
 (SELECT o_orderkey AS key, 'o' AS side FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem))
 UNION ALL (SELECT DISTINCT l_orderkey, 'l' FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)))""")
def missing_orphan(spark, sf):
    orders = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("key"))
    lines = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("key"))
    return I.missing_orphan(orders, lines, ["key"])


@query("""SELECT doc_id, CASE WHEN source = 'd' THEN 'missing' ELSE 'undeclared' END AS kind FROM (
 SELECT doc_id, 'd' AS source FROM documents WHERE doc_id % 3 <> 0 AND doc_id NOT IN (SELECT doc_id FROM labels)
 UNION ALL SELECT DISTINCT doc_id, 'l' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE doc_id % 3 <> 0))""")
def exact_membership(spark, sf):
    declared = W.table(spark, sf, "documents").where("doc_id % 3 <> 0").select("doc_id")
    return I.exact_membership(declared, W.table(spark, sf, "labels").select("doc_id"), ["doc_id"])


@query("""SELECT DISTINCT c_custkey AS id FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def required_subset(spark, sf):
    return I.required_subset(W.table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
                             W.table(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")), ["id"])


W.SQL["old_inv"] = """SELECT o_orderpriority AS grp, o_orderkey AS name, sha256(o_orderstatus || CAST(o_custkey AS VARCHAR)) AS record_sha256 FROM orders WHERE o_orderkey % 10 <> 0"""
W.SQL["new_inv"] = """SELECT o_orderpriority AS grp, o_orderkey AS name, sha256(o_orderstatus || CAST(o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END AS VARCHAR)) AS record_sha256
 FROM orders WHERE o_orderkey % 7 <> 0"""


def inventories(spark, sf):
    o = W.table(spark, sf, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")

    def snap(df, cust):
        return df.select(F.col("o_orderpriority").alias("grp"), k.alias("name"), F.sha2(F.concat("o_orderstatus", cust.cast("string")), 256).alias("record_sha256"))

    return snap(o.where(k % 10 != 0), c), snap(o.where(k % 7 != 0), c + F.when(k % 11 == 0, 1).otherwise(0))


@query(with_views("old_inv new_inv", """SELECT coalesce(o.grp, n.grp) AS grp, coalesce(o.name, n.name) AS name,
 CASE WHEN o.name IS NULL THEN 'added' WHEN n.name IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM old_inv o FULL OUTER JOIN new_inv n ON o.grp = n.grp AND o.name = n.name WHERE o.record_sha256 IS DISTINCT FROM n.record_sha256"""))
def inventory_diff(spark, sf):
    return I.inventory_diff(*inventories(spark, sf), keys=["grp", "name"])


@query(with_views("old_inv", "SELECT grp, name, record_sha256 FROM old_inv"))
def name_order(spark, sf):
    return I.name_order(inventories(spark, sf)[0], ["grp", "name"])


@query(with_views("old_inv new_inv", """SELECT name, CASE WHEN n.name IS NULL THEN 'lost' ELSE 'changed' END AS kind
FROM old_inv o LEFT JOIN new_inv n USING (name) WHERE o.record_sha256 IS DISTINCT FROM n.record_sha256"""))
def preservation_check(spark, sf):
    before, after = inventories(spark, sf)
    return I.preservation_check(before, after, ["name"], "record_sha256")


@query(with_views("old_inv new_inv", """SELECT coalesce(o.name, n.name) AS name, CASE WHEN o.name IS NULL THEN 'undeclared' WHEN n.name IS NULL THEN 'missing' ELSE 'changed' END AS kind
FROM old_inv o FULL OUTER JOIN new_inv n USING (name) WHERE o.record_sha256 IS DISTINCT FROM n.record_sha256"""))
def artifact_verify(spark, sf):
    recorded, present = inventories(spark, sf)
    return I.artifact_verify(recorded, present, ["name"], "record_sha256")


@query(with_views("old_inv new_inv", """SELECT n.name, n.record_sha256 AS sha256, o.record_sha256 AS archive_sha256
FROM new_inv n LEFT JOIN old_inv o USING (name) WHERE o.record_sha256 IS DISTINCT FROM n.record_sha256"""))
def join_component_manifest(spark, sf):
    archive, present = inventories(spark, sf)
    rename = lambda df: df.select("name", F.col("record_sha256").alias("sha256"))
    return I.join_component_manifest(rename(present), rename(archive), ["name"])


@query("""WITH m AS (SELECT DISTINCT 'p/' || CAST(p_size AS VARCHAR) || '/' || p_name AS path, false AS is_dir FROM part WHERE p_partkey % 5 <> 0
 UNION SELECT DISTINCT 'p/' || CAST(p_size AS VARCHAR), true FROM part),
e AS (SELECT DISTINCT 'p/' || CAST(p_size AS VARCHAR) || '/' || p_name AS path, p_partkey % 13 = 0 AS is_dir FROM part WHERE p_partkey % 3 <> 0)
SELECT path, is_dir, 'missing' AS kind FROM (SELECT * FROM m EXCEPT SELECT * FROM e) UNION ALL SELECT path, is_dir, 'stale' FROM (SELECT * FROM e EXCEPT SELECT * FROM m)""")
def tree_equal(spark, sf):
    part = W.table(spark, sf, "part")
    folder = F.concat(F.lit("p/"), F.col("p_size").cast("string"))
    path = F.concat_ws("/", folder, "p_name")
    manifest = part.where("p_partkey % 5 <> 0").select(path.alias("path"), F.lit(False).alias("is_dir")).unionByName(
        part.select(folder.alias("path"), F.lit(True).alias("is_dir")))
    extracted = part.where("p_partkey % 3 <> 0").select(path.alias("path"), (F.col("p_partkey") % 13 == 0).alias("is_dir"))
    return I.tree_equal(manifest, extracted)


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1")
def duplicate_ids(spark, sf):
    return I.duplicate_ids(W.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def content_hash(spark, sf):
    return I.content_hash(W.table(spark, sf, "documents"), "text").select("doc_id", "sha256")


@query("""WITH leaf AS (SELECT DISTINCT source, sha256(sha256(text) || ':' || CAST(doc_id AS VARCHAR)) AS h FROM documents),
a AS (SELECT source, h[1:5] AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM leaf GROUP BY source, h[1:5]),
b AS (SELECT source, p[1:2] AS q, sha256(string_agg(h, '' ORDER BY p)) AS h FROM a GROUP BY source, p[1:2])
SELECT source, sha256(string_agg(h, '' ORDER BY q)) AS identity FROM b GROUP BY source""")
def set_identity_hash(spark, sf):
    docs = I.content_hash(W.table(spark, sf, "documents"), "text")
    return I.set_identity_hash(docs, ["source"], "doc_id", "sha256")


@query("""SELECT 'unknown_source' AS rule, CAST(id AS VARCHAR) AS entity_id, CAST(source_id AS VARCHAR) AS detail FROM (
 SELECT doc_id AS id, (doc_id * 7) % 1200 AS source_id FROM labels) WHERE source_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'unknown_observation', CAST(conv_id AS VARCHAR), CAST(conv_id * 8 + turn AS VARCHAR) FROM conversations WHERE conv_id * 8 + turn NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT 'duplicate_observation', CAST(doc_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM labels GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_source', CAST(doc_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM documents GROUP BY doc_id HAVING count(*) > 1
UNION ALL SELECT 'duplicate_feature_observation', CAST(conv_id AS VARCHAR), CAST(count(*) AS VARCHAR) FROM conversations GROUP BY conv_id, conv_id * 8 + turn HAVING count(*) > 1""")
def observation_fk(spark, sf):
    """Labels as observations of documents; conversation turns as features of observations."""
    observations = W.table(spark, sf, "labels").select(F.col("doc_id").alias("id"), ((F.col("doc_id") * 7) % 1200).alias("source_id"))
    sources = W.table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    features = W.table(spark, sf, "conversations").select(F.col("conv_id").alias("feature_id"), (F.col("conv_id") * 8 + F.col("turn")).alias("observation_id"))
    return I.observation_fk(observations, sources, features)


W.SQL["job_objects"] = """SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_size % 60 END AS material, [p_partkey % 130, p_size] AS sources FROM part"""
W.SQL["job_materials"] = """SELECT n_nationkey AS id, [n_nationkey * 6, n_regionkey] AS sources FROM nation"""
W.SQL["job_sources"] = "SELECT s_suppkey AS id FROM supplier"
W.SQL["job_views"] = """SELECT c_custkey AS id, [c_custkey * 2, c_nationkey] AS required_objects FROM customer"""


def job(spark, sf):
    """A delivery job: parts as objects, nations as materials, suppliers as photo sources, customers as views."""
    part, nation, customer = (W.table(spark, sf, t) for t in ("part", "nation", "customer"))
    long = lambda e: F.expr(e).cast("long")
    objects = part.select(F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size") % 60).cast("long").alias("material"),
                          F.array(long("p_partkey % 130"), long("p_size")).alias("sources"))
    materials = nation.select(long("n_nationkey").alias("id"), F.array(long("n_nationkey * 6"), long("n_regionkey")).alias("sources"))
    sources = W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"))
    job_views = customer.select(F.col("c_custkey").alias("id"), F.array(long("c_custkey * 2"), long("c_nationkey")).alias("required_objects"))
    return objects, materials, sources, job_views


@query(with_views("job_objects job_materials job_sources job_views", """
SELECT 'unknown_object_material' AS rule, CAST(id AS VARCHAR) AS entity_id, CAST(material AS VARCHAR) AS detail FROM job_objects WHERE material IS NOT NULL AND material NOT IN (SELECT id FROM job_materials)
UNION ALL SELECT 'unknown_object_source', CAST(id AS VARCHAR), CAST(ref AS VARCHAR) FROM (SELECT id, unnest(sources) AS ref FROM job_objects) WHERE ref NOT IN (SELECT id FROM job_sources)
UNION ALL SELECT 'unknown_material_source', CAST(id AS VARCHAR), CAST(ref AS VARCHAR) FROM (SELECT id, unnest(sources) AS ref FROM job_materials) WHERE ref NOT IN (SELECT id FROM job_sources)
UNION ALL SELECT 'unknown_view_object', CAST(id AS VARCHAR), CAST(ref AS VARCHAR) FROM (SELECT id, unnest(required_objects) AS ref FROM job_views) WHERE ref NOT IN (SELECT id FROM job_objects)"""))
def contract_fk(spark, sf):
    objects, materials, sources, job_views = job(spark, sf)
    return I.contract_fk(objects, materials, sources, job_views)


@query(with_views("job_objects job_materials job_sources", """SELECT id FROM job_sources WHERE id IN (SELECT unnest(sources) FROM job_objects)
 OR id IN (SELECT unnest(sources) FROM job_materials)"""))
def used_source_closure(spark, sf):
    objects, materials, sources, _ = job(spark, sf)
    return I.used_source_closure(sources, objects, materials)


W.SQL["members"] = """SELECT o_custkey % 40 AS room_id, o_orderpriority AS grp, row_number() OVER (PARTITION BY o_custkey % 40, o_orderpriority ORDER BY o_orderkey) - 1 AS ordinal, 'object-' || CAST(o_orderkey AS VARCHAR) AS target_name FROM orders"""


def members(spark, sf):
    """Rooms, groups and ordered targets from orders; ordinals by blocks of order keys."""
    from plumbline.functions.ranking import bucketed_rank

    orders = W.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("room_id"), F.col("o_orderpriority").alias("grp"), "o_orderkey")
    ranked = bucketed_rank(orders, ["room_id", "grp"], F.floor(F.col("o_orderkey") / 65536), [F.col("o_orderkey")], "ordinal")
    return ranked.withColumn("target_name", F.concat(F.lit("object-"), F.col("o_orderkey").cast("string")))


@query(with_views("members", """, received AS (SELECT room_id, grp, ordinal, CASE WHEN ordinal % 9 = 4 THEN target_name || '.001' ELSE target_name END AS target_name FROM members WHERE ordinal % 17 <> 3
 UNION ALL SELECT room_id, grp, ordinal + 100000, target_name FROM members WHERE ordinal = 0)
SELECT coalesce(m.room_id, r.room_id) AS room_id, coalesce(m.grp, r.grp) AS grp, coalesce(m.ordinal, r.ordinal) AS ordinal, m.target_name AS declared, r.target_name AS received,
 CASE WHEN r.room_id IS NULL THEN 'missing' WHEN m.room_id IS NULL THEN 'extra' ELSE 'renamed' END AS kind
FROM members m FULL OUTER JOIN received r ON m.room_id = r.room_id AND m.grp = r.grp AND m.ordinal = r.ordinal WHERE m.target_name IS DISTINCT FROM r.target_name"""))
def membership_receipt(spark, sf):
    m = members(spark, sf).select("room_id", "grp", "ordinal", "target_name")
    renamed = F.when(F.col("ordinal") % 9 == 4, F.concat("target_name", F.lit(".001"))).otherwise(F.col("target_name"))
    received = m.where("ordinal % 17 <> 3").withColumn("target_name", renamed).unionByName(
        m.where("ordinal = 0").withColumn("ordinal", F.col("ordinal") + 100000))
    return I.membership_receipt(m, received, keys=["room_id", "grp", "ordinal"])


@query("""WITH m AS (SELECT o_custkey % 40 AS room_id, o_orderpriority AS grp, 'object-' || CAST(o_orderkey - o_orderkey % 50 // 49 AS VARCHAR) AS target_name FROM orders),
r AS (SELECT room_id, count(DISTINCT target_name) AS unique_targets, count(*) AS total FROM m GROUP BY room_id),
d AS (SELECT room_id, count(*) FILTER (WHERE n > 1) AS duplicate_names FROM (SELECT room_id, target_name, count(*) AS n FROM m GROUP BY ALL) GROUP BY room_id),
g AS (SELECT room_id, grp, count(*) AS target_count FROM m GROUP BY room_id, grp)
SELECT g.room_id, g.grp, target_count, unique_targets, duplicate_names, total - room_id % 2 AS total_native_targets,
 (total - room_id % 2 = unique_targets AND duplicate_names = 0) AS total_matches FROM g JOIN r USING (room_id) JOIN d USING (room_id)""")
def group_target_counts(spark, sf):
    """Room totals off by one for odd rooms; a few target names repeat."""
    name = F.concat(F.lit("object-"), (F.col("o_orderkey") - F.floor(F.col("o_orderkey") % 50 / 49)).cast("string"))
    m = W.table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("room_id"), F.col("o_orderpriority").alias("group"), name.alias("target_name"))
    totals = m.groupBy("room_id").agg((F.count("*") - F.first(F.col("room_id") % 2)).alias("total_native_targets"))
    return I.group_target_counts(m, totals).withColumnRenamed("group", "grp")


@query("""WITH d AS (SELECT l_orderkey, l_linenumber, max(l_partkey) AS obj, max(l_suppkey) AS orig, max(l_quantity) AS rend FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS (SELECT l_orderkey, l_linenumber, obj, orig, rend + CASE WHEN l_orderkey % 23 = 0 THEN 1 ELSE 0 END AS rend FROM d WHERE l_linenumber <> 5 OR l_orderkey % 2 = 0)
SELECT l_orderkey, l_linenumber, CASE WHEN r.obj IS NULL THEN 'missing' ELSE 'different' END AS kind FROM d LEFT JOIN r USING (l_orderkey, l_linenumber) WHERE r.obj IS NULL OR r.rend <> d.rend""")
def material_override_match(spark, sf):
    d = W.table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.max("l_partkey").alias("object_id"), F.max("l_suppkey").alias("original_material_id"), F.max("l_quantity").alias("render_material_id"))
    d = d.withColumn("intent", F.lit("review"))
    r = d.where("l_linenumber <> 5 OR l_orderkey % 2 = 0").withColumn(
        "render_material_id", F.col("render_material_id") + F.when(F.col("l_orderkey") % 23 == 0, 1).otherwise(0))
    return I.material_override_match(d, r, keys=["l_orderkey", "l_linenumber"])


@query("""SELECT s_suppkey AS capture_id, '/data/cap-' || CAST(s_suppkey AS VARCHAR) AS source, CASE WHEN s_suppkey % 3 <> 0 THEN sha256(s_name) END AS source_sha256 FROM supplier""")
def scan_manifest(spark, sf):
    """Manifests declare roots with dots and doubled slashes; a third of the captures has none."""
    s = W.table(spark, sf, "supplier")
    key = F.col("s_suppkey").cast("string")
    captures = s.select(F.col("s_suppkey").alias("capture_id"), F.concat(F.lit("/data//cap-"), key, F.lit("/")).alias("source"))
    manifests = s.where("s_suppkey % 3 <> 0").select(
        F.concat(F.lit("/data/./tmp/../cap-"), key).alias("capture_root"), F.sha2("s_name", 256).alias("source_sha256"))
    return I.scan_manifest(captures, manifests).select("capture_id", "source", "source_sha256")


@query("""SELECT doc_id, '/jobs/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.png' AS resolved_path,
 CASE WHEN doc_id % 17 = 0 THEN 'missing' WHEN doc_id % 13 = 0 THEN 'hash_mismatch' ELSE 'ok' END AS status FROM documents""")
def scan_job_inputs(spark, sf):
    """Every document declared as a job input; some missing, some altered."""
    docs = W.table(spark, sf, "documents")
    key = F.col("doc_id").cast("string")
    declared = docs.select("doc_id", F.concat(F.lit("/jobs/"), "lang", F.lit("/sub")).alias("job_dir"),
                           F.concat(F.lit("../"), key, F.lit(".png")).alias("path"), F.sha2("text", 256).alias("sha256"))
    files = docs.where("doc_id % 17 <> 0").select(
        F.concat(F.lit("/jobs/"), "lang", F.lit("/"), key, F.lit(".png")).alias("path"),
        F.sha2(F.when(F.col("doc_id") % 13 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")), 256).alias("sha256"))
    return I.scan_job_inputs(declared, files).select("doc_id", "resolved_path", "status")


_FIELDS = ("source_id", "capture_id", "sha256")
W.SQL["ev"] = """SELECT s_suppkey AS source_id, CASE s_suppkey % 5 WHEN 2 THEN 'qualified-upright' WHEN 3 THEN 'documentary-unlocated' WHEN 4 THEN 'sketch' ELSE 'original' END AS kind,
 CASE WHEN s_suppkey % 5 = 2 THEN CASE WHEN s_suppkey % 10 = 7 THEN s_suppkey + 1000000 ELSE s_suppkey - 1 END END AS original_source_id,
 s_suppkey % 11 <> 0 AS certain FROM supplier"""


@query(with_views("ev", """, b AS (SELECT DISTINCT l_partkey AS object_id, l_suppkey AS source_id FROM lineitem WHERE l_suppkey % 5 <> 1),
cited AS (SELECT DISTINCT source_id FROM b),
audited AS (SELECT source_id FROM cited UNION SELECT e.original_source_id FROM ev e JOIN cited USING (source_id) JOIN ev o ON o.source_id = e.original_source_id AND o.kind = 'original' WHERE e.kind = 'qualified-upright' AND e.certain),
ch AS (SELECT ev.* FROM ev JOIN audited USING (source_id) WHERE certain)
SELECT 'unresolved_source' AS rule, CAST(object_id AS VARCHAR) AS entity_id, CAST(source_id AS VARCHAR) AS detail FROM b WHERE source_id NOT IN (SELECT source_id FROM ev WHERE certain)
UNION ALL SELECT 'identity_missing', CAST(source_id AS VARCHAR), 'capture_id' FROM ch WHERE kind <> 'sketch' AND source_id % 7 = 0
UNION ALL SELECT 'image_metadata_differs', CAST(source_id AS VARCHAR), 'capture_id' FROM ch WHERE kind IN ('original', 'qualified-upright') AND source_id % 7 = 0 AND source_id % 9 <> 0
UNION ALL SELECT 'image_absent', CAST(source_id AS VARCHAR), 'img' || CAST(source_id AS VARCHAR) FROM ch WHERE kind IN ('original', 'qualified-upright') AND source_id % 9 = 0
UNION ALL SELECT 'image_bytes_differ', CAST(source_id AS VARCHAR), 'img' || CAST(source_id AS VARCHAR) FROM ch WHERE kind IN ('original', 'qualified-upright') AND source_id % 9 <> 0 AND source_id % 13 = 0
UNION ALL SELECT 'original_missing', CAST(source_id AS VARCHAR), CAST(original_source_id AS VARCHAR) FROM ch WHERE kind = 'qualified-upright' AND source_id IN (SELECT source_id FROM cited)
 AND original_source_id NOT IN (SELECT source_id FROM ev WHERE kind = 'original')
UNION ALL SELECT 'invented_image', CAST(source_id AS VARCHAR), 'img' || CAST(source_id AS VARCHAR) FROM ch WHERE kind = 'documentary-unlocated' AND source_id % 4 = 0
UNION ALL SELECT 'unsupported_kind', CAST(source_id AS VARCHAR), kind FROM ch WHERE kind = 'sketch'"""))
def evidence_closure(spark, sf):
    """Parts cite suppliers as photo sources; defects planted by key arithmetic."""
    s = W.table(spark, sf, "supplier")
    k = F.col("s_suppkey")
    sha = F.sha2("s_name", 256)
    image = F.concat(F.lit("img"), k.cast("string"))
    kind = F.when(k % 5 == 2, "qualified-upright").when(k % 5 == 3, "documentary-unlocated").when(k % 5 == 4, "sketch").otherwise("original")
    documentary = k % 5 == 3
    capture = F.when(k % 7 == 0, F.lit("")).otherwise("cap")

    def identity(capture_id):
        return F.create_map(F.lit("source_id"), k.cast("string"), F.lit("capture_id"), capture_id, F.lit("sha256"), sha,
                            F.lit("locator"), F.lit("unlocated"))

    sources = s.select(
        k.alias("source_id"), kind.alias("kind"), identity(capture).alias("identity"),
        F.when(k % 11 != 0, "no metric calibration").alias("uncertainty"),
        F.when(~documentary | (k % 4 == 0), image).alias("image"),
        F.when(k % 10 == 7, k + 1000000).when(k % 5 == 2, k - 1).alias("original_source_id"))
    images = s.where("s_suppkey % 9 <> 0").select(
        image.alias("image"), F.when(k % 13 == 0, F.sha2(F.concat("s_name", F.lit("?")), 256)).otherwise(sha).alias("sha256"),
        identity(F.lit("cap")).alias("metadata"))
    bindings = W.table(spark, sf, "lineitem").where("l_suppkey % 5 <> 1").select(
        F.col("l_partkey").alias("object_id"), F.col("l_suppkey").alias("source_id")).distinct()
    return I.evidence_closure(bindings, sources, images, _FIELDS, ("source_id", "capture_id"))[0]


_PART_EDGES = "edges AS (SELECT p_partkey AS id, CAST(floor(p_partkey / 2.0) AS BIGINT) AS parent_id FROM part WHERE p_partkey <> 0)"


def part_edges(spark, sf):
    return W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 2).alias("parent_id"))


@query(f"""WITH RECURSIVE {_PART_EDGES}, up AS (SELECT id, parent_id AS ancestor, CAST(1 AS BIGINT) AS depth FROM edges
 UNION ALL SELECT up.id, e.parent_id, up.depth + 1 FROM up JOIN edges e ON e.id = up.ancestor)
SELECT id, ancestor, depth FROM up""")
def ancestor_pairs(spark, sf):
    return H.ancestors(part_edges(spark, sf))


@query(f"""WITH RECURSIVE {_PART_EDGES}, up AS (SELECT id, parent_id AS ancestor, 1 AS depth FROM edges
 UNION ALL SELECT up.id, e.parent_id, up.depth + 1 FROM up JOIN edges e ON e.id = up.ancestor)
SELECT id, string_agg(CAST(ancestor AS VARCHAR), ',' ORDER BY depth) AS chain FROM up GROUP BY id""")
def parent_chain(spark, sf):
    chains = H.parent_chain(part_edges(spark, sf))
    return chains.select("id", F.array_join(F.col("chain").cast("array<string>"), ",").alias("chain"))


@query(f"""WITH RECURSIVE {_PART_EDGES}, shown AS (SELECT p_partkey AS id FROM part WHERE NOT (p_size % 10 = 0 AND p_partkey <> 0)),
down AS (SELECT CAST(0 AS BIGINT) AS id UNION ALL SELECT e.id FROM down JOIN edges e ON e.parent_id = down.id JOIN shown s ON s.id = e.id)
SELECT DISTINCT id FROM down""")
def collection_closure(spark, sf):
    """Parts as collections; a tenth is hidden and hides everything below."""
    hidden = (F.col("p_size") % 10 == 0) & (F.col("p_partkey") != 0)
    collections = W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), hidden.alias("hide_render"))
    links = part_edges(spark, sf).select("parent_id", F.col("id").alias("child_id"))
    return H.collection_closure(collections, links, 0)


@query(f"""WITH RECURSIVE {_PART_EDGES}, shown AS (SELECT p_partkey AS id FROM part WHERE NOT (p_size % 10 = 0 AND p_partkey <> 0)),
down AS (SELECT CAST(0 AS BIGINT) AS id UNION ALL SELECT e.id FROM down JOIN edges e ON e.parent_id = down.id JOIN shown s ON s.id = e.id)
SELECT DISTINCT c_custkey AS object_id FROM customer WHERE c_acctbal >= 0 AND c_custkey IN (SELECT id FROM down)""")
def renderable_objects(spark, sf):
    hidden = (F.col("p_size") % 10 == 0) & (F.col("p_partkey") != 0)
    collections = W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), hidden.alias("hide_render"))
    links = part_edges(spark, sf).select("parent_id", F.col("id").alias("child_id"))
    objects = W.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("object_id"), F.col("c_custkey").alias("collection_id"), (F.col("c_acctbal") < 0).alias("hide_render"))
    return H.renderable_objects(H.collection_closure(collections, links, 0), objects)


_WORLDS = """WITH RECURSIVE n AS (SELECT p_partkey AS id, CASE WHEN p_partkey = 0 THEN NULL ELSE CAST(floor(p_partkey / 2.0) AS BIGINT) END AS parent_id,
 p_partkey % 4 AS k, p_size AS x, p_partkey % 5 AS y, 1 AS z FROM part),
w AS (SELECT id, k AS k, x AS x, y AS y, CAST(z AS BIGINT) AS z FROM n WHERE parent_id IS NULL
 UNION ALL SELECT n.id, (w.k + n.k) % 4, w.x + CASE w.k WHEN 0 THEN n.x WHEN 1 THEN -n.y WHEN 2 THEN -n.x ELSE n.y END,
  w.y + CASE w.k WHEN 0 THEN n.y WHEN 1 THEN n.x WHEN 2 THEN -n.y ELSE -n.x END, w.z + n.z FROM w JOIN n ON n.parent_id = w.id)
SELECT id, CAST(CASE k WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS BIGINT) AS m00, CAST(CASE k WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS BIGINT) AS m10,
 CAST(x AS BIGINT) AS tx, CAST(y AS BIGINT) AS ty, CAST(z AS BIGINT) AS tz FROM w"""


@query(_WORLDS)
def hierarchy_transforms(spark, sf):
    """Quarter turns and integer shifts down the part tree, so products are exact."""
    part = F.col("p_partkey")
    return _worlds(H.hierarchy_transforms(_turned_parts(spark, sf, F.when(part != 0, F.floor(part / 2))))[0])


def _worlds(w):
    entry = lambda i, name: F.col("world")[i].cast("long").alias(name)
    return w.select("id", entry(0, "m00"), entry(4, "m10"), entry(3, "tx"), entry(7, "ty"), entry(11, "tz"))


def _repeated_parts(spark, sf):
    """The part tree with every ninth part twice, once from a parent and matrix that are later in order."""
    nodes = _turned_parts(spark, sf, F.when(F.col("p_partkey") != 0, F.floor(F.col("p_partkey") / 2)))
    return nodes.unionByName(nodes.where("id % 9 = 4").withColumn("parent_id", F.col("parent_id") + 1))


@query(_WORLDS)
def hierarchy_transforms_repeated(spark, sf):
    """Repeated ids neither multiply the rows below them nor move them."""
    return _worlds(H.hierarchy_transforms(_repeated_parts(spark, sf))[0])


@query("SELECT 'duplicate' AS rule, CAST(p_partkey AS VARCHAR) AS entity_id, '2' AS detail FROM part WHERE p_partkey % 9 = 4")
def hierarchy_duplicates(spark, sf):
    return H.hierarchy_findings(_repeated_parts(spark, sf))


def _turned_parts(spark, sf, parent):
    k = F.col("p_partkey") % 4
    c = F.when(k == 0, 1.0).when(k == 2, -1.0).otherwise(0.0)
    s = F.when(k == 1, 1.0).when(k == 3, -1.0).otherwise(0.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(c, -s, zero, F.col("p_size").cast("double"), s, c, zero, (F.col("p_partkey") % 5).cast("double"),
                     zero, zero, one, one, zero, zero, zero, one)
    return W.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), parent.alias("parent_id"), matrix.alias("matrix"))


_BROKEN_TREE = """CASE WHEN p_partkey % 50 = 1 THEN NULL WHEN p_partkey % 50 = 20 THEN -p_partkey WHEN p_partkey % 50 = 30 THEN p_partkey + 2
 ELSE p_partkey - 1 END"""


@query(f"""WITH RECURSIVE n AS (SELECT p_partkey AS id, {_BROKEN_TREE} AS parent_id FROM part),
down AS (SELECT id FROM n WHERE parent_id IS NULL UNION ALL SELECT n.id FROM down JOIN n ON n.parent_id = down.id),
lost AS (SELECT n.id, n.parent_id AS missing FROM n WHERE n.parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM n m WHERE m.id = n.parent_id)
 UNION ALL SELECT n.id, lost.missing FROM lost JOIN n ON n.parent_id = lost.id)
SELECT CASE WHEN l.id IS NULL THEN 'cycle' ELSE 'unknown_parent' END AS rule, CAST(n.id AS VARCHAR) AS entity_id, CAST(l.missing AS VARCHAR) AS detail
FROM n LEFT JOIN lost l ON l.id = n.id WHERE n.id NOT IN (SELECT id FROM down)""")
def hierarchy_findings(spark, sf):
    """Chains of fifty parts, with a cycle and an absent parent in each."""
    return H.hierarchy_findings(_turned_parts(spark, sf, F.expr(_BROKEN_TREE)))


@query(with_views("components", _FLAGS + """, f AS (
 SELECT component AS rule FROM (SELECT f.*, has_rgb, has_corrected, unnest(['raw_camera', 'raw_depth', 'raw_confidence', 'corrected_camera']) AS component,
  unnest([raw_camera, raw_depth, raw_confidence, corrected_camera]) AS present FROM flags f JOIN caps USING (capture_id))
 WHERE has_rgb AND (component <> 'corrected_camera' OR has_corrected) AND present <> rgb)
SELECT r.rule, (SELECT count(*) FROM f WHERE f.rule = r.rule) AS findings, (SELECT count(*) FROM f WHERE f.rule = r.rule) = 0 AS passed
FROM (SELECT unnest(['raw_camera', 'raw_depth', 'raw_confidence', 'corrected_camera', 'clean_depth']) AS rule) r"""))
def checks_rollup(spark, sf):
    """Pass or fail per completeness rule over all captures."""
    found = I.component_completeness(W.components(spark, sf)).where("kind <> 'no_rgb'").withColumnRenamed("component", "rule")
    names = F.explode(F.array(*[F.lit(n) for n in ("raw_camera", "raw_depth", "raw_confidence", "corrected_camera", "clean_depth")]))
    return rules.checks_rollup(found, W.table(spark, sf, "region").select(names.alias("rule")))


# --- text forms and buffers --------------------------------------------------


@query("""SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN lower(replace(p_name, ' ', '-')) WHEN p_partkey % 4 = 1 THEN NULL
 ELSE lower(replace(p_name, ' ', '-')) || '.tar-' || sha256(p_name)[:8] END AS capture_id FROM part""")
def capture_ids(spark, sf):
    """Folders, files with two suffixes, and names that begin with a character no id may begin with."""
    k = F.col("p_partkey") % 4
    part = W.table(spark, sf, "part")
    name = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("_"), F.col("p_name"), F.lit(".zip"))).otherwise(F.concat("p_name", F.lit(".tar.gz")))
    return part.select("p_partkey", T.capture_id(name, F.sha2("p_name", 256), k == 0).alias("capture_id"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, format('{:.15g}', l_extendedprice / 7 * CASE l_linenumber % 4 WHEN 0 THEN -1 WHEN 1 THEN 1e-9 WHEN 2 THEN 1e13 ELSE 1 END) AS shown FROM lineitem""")
def fifteen_digit_numbers(spark, sf):
    """Fixed and scientific forms, negative and large."""
    n = F.col("l_linenumber") % 4
    scale = F.when(n == 0, -1.0).when(n == 1, 1e-9).when(n == 2, 1e13).otherwise(1.0)
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.fifteen_digits(F.col("l_extendedprice") / 7 * scale).alias("shown"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber % 3 <> 0 THEN format('{:.15g}', l_extendedprice / 7) END AS shown FROM lineitem""")
def fifteen_digit_nulls(spark, sf):
    """A number that is missing stays missing."""
    return W.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", T.fifteen_digits(F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice") / 7)).alias("shown"))


@query("""SELECT p_partkey, '{"a b": "' || p_name || '", "brand": "x\\"' || p_brand || '\\\\", "z": "\\u00e9\\n"}' AS dumped FROM part""")
def canonical_dump(spark, sf):
    """Keys come out sorted, quotes, line ends and non-ASCII characters escaped."""
    entries = F.create_map(F.lit("z"), F.lit("\u00e9\n"), F.lit("brand"), F.concat(F.lit('x"'), F.col("p_brand"), F.lit("\\")), F.lit("a b"), F.col("p_name"))
    return W.table(spark, sf, "part").select("p_partkey", T.canonical_json(entries).alias("dumped"))


@query()
def buffer_hash(spark, sf):
    """Vectors of each label as one buffer of 32-bit numbers, in id order."""
    e = lambda i: F.element_at("embedding", i).alias(f"e{i}")
    rows = W.table(spark, sf, "embeddings").select("label", "vec_id", e(1), e(2), e(3))
    return I.buffer_hash(rows, ["label"], ["vec_id"], ["e1", "e2", "e3"])
