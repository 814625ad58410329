"""Registered queries: rasters, shots, samples, features, reviews, catalogs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import png
from plumbline.operators import coverage as C
from plumbline.plans import views as W
from plumbline.plans.pixel_queries import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import with_views
from plumbline.sources.frames import image_facts

W.SQL["raster"] = """SELECT l_suppkey % 20 AS view_id, l_orderkey % 240 AS y, l_partkey % 320 AS x, max(l_linenumber % 7) AS object_idx, max(CAST(l_quantity AS INTEGER) % 5) AS material_idx
 FROM lineitem GROUP BY 1, 2, 3"""
W.SQL["rcount"] = "SELECT view_id, object_idx AS idx, count(*) AS pixels FROM raster WHERE object_idx <> 0 GROUP BY 1, 2"


def raster(spark, sf):
    """Object and material index grids of twenty views from line items."""
    return W.table(spark, sf, "lineitem").groupBy(
        (F.col("l_suppkey") % 20).alias("view_id"), (F.col("l_orderkey") % 240).alias("y"), (F.col("l_partkey") % 320).alias("x")).agg(
        F.max(F.col("l_linenumber") % 7).alias("object_idx"), F.max(F.col("l_quantity").cast("int") % 5).alias("material_idx"))


def register(spark, sf):
    """Names of raster ids from nations; ids above five stay undeclared in odd views."""
    nation = W.table(spark, sf, "nation").where("n_nationkey BETWEEN 1 AND 6").select(F.col("n_nationkey").alias("idx"), F.concat(F.lit("object-"), F.col("n_nationkey").cast("string")).alias("name"))
    supplier_views = W.table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("view_id")).distinct()
    # at most 20 views times 6 ids: pairs made by exploding a list, not by joining
    listed = supplier_views.withColumn("idx", F.explode(F.sequence(F.lit(1), F.lit(6)))).where("view_id % 2 = 0 OR idx <= 5")
    return listed.join(nation, "idx")


@query(with_views("raster", "SELECT view_id, y, x, object_idx AS idx FROM raster"))
def scan_id_rasters(spark, sf):
    return C.scan_id_rasters(raster(spark, sf), "object")


@query(with_views("raster rcount", "SELECT * FROM rcount"))
def raster_counts(spark, sf):
    return C.raster_counts(raster(spark, sf), "object")


@query(with_views("raster rcount", """SELECT view_id, idx, pixels, CASE WHEN view_id % 2 = 0 OR idx <= 5 THEN 'object-' || CAST(idx AS VARCHAR) END AS name, NOT (view_id % 2 = 0 OR idx <= 5) AS undeclared FROM rcount"""))
def raster_register_join(spark, sf):
    return C.raster_register_join(C.raster_counts(raster(spark, sf), "object"), register(spark, sf))


@query(with_views("raster rcount", """, req AS (SELECT DISTINCT s_suppkey % 20 AS view_id, s_nationkey % 7 AS idx, 400 + s_suppkey % 20 * 5 AS minimum_pixels FROM supplier)
SELECT r.view_id, 'object-' || CAST(r.idx AS VARCHAR) AS object_id, minimum_pixels, coalesce(pixels, 0) AS pixels, coalesce(pixels, 0) >= minimum_pixels AS passed
FROM req r LEFT JOIN rcount c ON c.view_id = r.view_id AND c.idx = r.idx AND (r.view_id % 2 = 0 OR r.idx <= 5)"""))
def required_visibility(spark, sf):
    counts = C.raster_register_join(C.raster_counts(raster(spark, sf), "object"), register(spark, sf)).where("NOT undeclared")
    k = F.col("s_suppkey") % 20
    required = W.table(spark, sf, "supplier").select(k.alias("view_id"), F.concat(F.lit("object-"), (F.col("s_nationkey") % 7).cast("string")).alias("object_id"), (400 + k * 5).alias("minimum_pixels")).distinct()
    return C.required_visibility(counts, required)


@query(with_views("raster", """SELECT view_id, object_idx, count(*) AS object_pixels, count(*) FILTER (WHERE material_idx = (view_id + object_idx) % 5) AS material_pixels
FROM raster WHERE object_idx <> 0 GROUP BY 1, 2"""))
def object_material_colocation(spark, sf):
    r = raster(spark, sf)
    views = W.table(spark, sf, "supplier").select((F.col("s_suppkey") % 20).alias("view_id")).distinct()
    assigned = views.withColumn("object_idx", F.explode(F.sequence(F.lit(1), F.lit(6)))).withColumn("material_idx", (F.col("view_id") + F.col("object_idx")) % 5)
    return C.object_material_colocation(r, assigned)


W.SQL["vis"] = """SELECT l_orderkey AS frame_id, l_partkey % 60 AS object_id, CAST(sum(l_quantity) AS BIGINT) * 20 AS visible_pixels, CAST(sum(CAST(l_quantity * 10 AS BIGINT)) AS DOUBLE) AS projected_area_px2,
 count(*) AS n FROM lineitem GROUP BY 1, 2"""


def visibility(spark, sf):
    q = F.col("l_quantity")
    return W.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 60).alias("object_id")).agg(
        (F.sum(q).cast("long") * 20).alias("visible_pixels"), F.sum((q * 10).cast("long")).cast("double").alias("projected_area_px2"), F.count("*").alias("n"))


@query(with_views("vis", """SELECT o_orderkey AS frame_id, coalesce(sum(visible_pixels), 0) AS visible, CAST(40 * (40 + o_custkey % 60) AS BIGINT) AS budget, count(object_id) FILTER (WHERE visible_pixels > 0) AS objects,
 coalesce(sum(visible_pixels), 0) <= 40 * (40 + o_custkey % 60) AS within FROM orders LEFT JOIN vis ON frame_id = o_orderkey GROUP BY o_orderkey, o_custkey"""))
def pixel_budget(spark, sf):
    frames = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("frame_id"), F.lit(40).alias("width"), (40 + F.col("o_custkey") % 60).alias("height"))
    return C.pixel_budget(visibility(spark, sf), frames)


@query(with_views("vis", """, r AS (SELECT DISTINCT l_orderkey AS frame_id, l_partkey % 61 AS object_id FROM lineitem)
SELECT frame_id, object_id, 'missing' AS kind FROM (SELECT * FROM r EXCEPT SELECT frame_id, object_id FROM vis) UNION ALL SELECT frame_id, object_id, 'undeclared' FROM (SELECT frame_id, object_id FROM vis EXCEPT SELECT * FROM r)"""))
def visible_set_check(spark, sf):
    reported = W.table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("frame_id"), (F.col("l_partkey") % 61).alias("object_id"))
    return C.visible_set_check(reported, visibility(spark, sf))


@query("""WITH s AS (SELECT conv_id AS route_id, turn AS ordinal, conv_id * 100 + turn AS shot_id FROM conversations),
p AS (SELECT route_id, ordinal, shot_id, shot_id + 1 AS next_id FROM s WHERE (route_id, ordinal + 1) IN (SELECT route_id, ordinal FROM s)),
t AS (SELECT route_id, ordinal, shot_id AS f, CASE WHEN shot_id % 7 = 0 THEN shot_id + 2 ELSE shot_id + 1 END AS g, CASE WHEN shot_id % 11 = 0 THEN 'fade' ELSE 'cut' END AS type FROM s WHERE shot_id % 13 <> 0)
SELECT coalesce(p.route_id, t.route_id) AS route_id, coalesce(p.ordinal, t.ordinal) AS ordinal,
 CASE WHEN t.route_id IS NULL THEN 'missing' WHEN p.route_id IS NULL THEN 'extra' WHEN f <> shot_id OR g <> next_id THEN 'out_of_order' ELSE 'not_cut' END AS kind
FROM p FULL OUTER JOIN t ON p.route_id = t.route_id AND p.ordinal = t.ordinal WHERE t.route_id IS NULL OR p.route_id IS NULL OR f <> shot_id OR g <> next_id OR type <> 'cut'""")
def adjacent_shots(spark, sf):
    """Conversation turns as the shots of a route."""
    shot = F.col("conv_id") * 100 + F.col("turn")
    shots = W.table(spark, sf, "conversations").select(F.col("conv_id").alias("route_id"), F.col("turn").alias("ordinal"), shot.alias("shot_id"))
    s = F.col("shot_id")
    transitions = shots.where("shot_id % 13 <> 0").select(
        "route_id", "ordinal", s.alias("from_shot_id"), F.when(s % 7 == 0, s + 2).otherwise(s + 1).alias("to_shot_id"), F.when(s % 11 == 0, "fade").otherwise("cut").alias("type"))
    return C.adjacent_shots(shots, transitions)


@query("""WITH s AS (SELECT DISTINCT l_suppkey AS shot_id FROM lineitem WHERE l_suppkey % 9 <> 0 UNION SELECT DISTINCT l_suppkey + 100000 FROM lineitem WHERE l_suppkey % 10 = 0)
SELECT shot_id, 'unknown_shot' AS kind FROM s WHERE shot_id NOT IN (SELECT s_suppkey FROM supplier) UNION ALL SELECT s_suppkey, 'not_sampled' FROM supplier WHERE s_suppkey NOT IN (SELECT shot_id FROM s)""")
def frame_shot_join(spark, sf):
    k = F.col("l_suppkey")
    lines = W.table(spark, sf, "lineitem")
    samples = lines.where("l_suppkey % 9 <> 0").select(k.alias("shot_id")).unionByName(lines.where("l_suppkey % 10 = 0").select((k + 100000).alias("shot_id")))
    return C.frame_shot_join(samples, W.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("shot_id")))


@query("""WITH s AS (SELECT o_orderkey AS id, 1.4 + (o_custkey % 100) * 0.005 AS shot, 1.4 + (o_custkey % 100) * 0.005 + CASE WHEN o_orderkey % 11 = 0 THEN 0.002 ELSE 0 END AS eye, o_orderkey % 13 = 0 AS off FROM orders)
SELECT 'eye_not_floor_relative' AS rule, CAST(id AS VARCHAR) AS entity_id FROM s WHERE off UNION ALL SELECT 'eye_differs_from_shot', CAST(id AS VARCHAR) FROM s WHERE id % 11 = 0
UNION ALL SELECT 'eye_out_of_range', CAST(id AS VARCHAR) FROM s WHERE eye < 1.4525 OR eye > 1.7475""")
def check_eye_height(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = 1.4 + (c % 100) * 0.005
    eye = base + F.when(k % 11 == 0, 0.002).otherwise(0.0)
    samples = W.table(spark, sf, "orders").select(
        k.alias("frame_id"), k.alias("shot_id"), (F.lit(2.0) + eye + F.when(k % 13 == 0, 0.01).otherwise(0.0)).alias("camera_elevation_m"), F.lit(2.0).alias("floor_elevation_m"), eye.alias("eye_height_m"))
    shots = W.table(spark, sf, "orders").select(k.alias("shot_id"), base.alias("eye_height_m"))
    return C.check_eye_height(samples, shots, 1.4525, 1.7475).select("rule", "entity_id")


@query(with_views("vis", """SELECT 'bounds_inverted' AS rule, CAST(frame_id AS VARCHAR) || '/' || CAST(object_id AS VARCHAR) AS entity_id FROM vis WHERE object_id % 8 = 3 AND frame_id % 10 <> 4
UNION ALL SELECT 'bounds_incomplete', CAST(frame_id AS VARCHAR) || '/' || CAST(object_id AS VARCHAR) FROM vis WHERE frame_id % 10 = 4 UNION ALL SELECT 'area_negative', CAST(frame_id AS VARCHAR) || '/' || CAST(object_id AS VARCHAR) FROM vis WHERE n = 2"""))
def check_projected_bounds(spark, sf):
    low = F.lit(10.0)
    high = F.when(F.col("object_id") % 8 == 3, 9.0).otherwise(30.0)
    last = F.when(F.col("frame_id") % 10 == 4, float("nan")).otherwise(20.0)
    v = visibility(spark, sf).withColumn("bounds", F.array(low, low, high, last)).withColumn(
        "projected_area_px2", F.when(F.col("n") == 2, -F.col("projected_area_px2")).otherwise(F.col("projected_area_px2")))
    return C.check_projected_bounds(v).select("rule", "entity_id")


_FEATURES = """, feat AS (SELECT p_partkey AS feature_id, [p_partkey % 60, (p_partkey * 7) % 60] AS objects, ['1-URGENT', '5-LOW'] AS intents, p_size % 4 AS finding, 200 + p_size * 30 AS px, CAST(p_size * 12 AS DOUBLE) AS area FROM part),
w AS (SELECT feature_id, finding, px, area, object_id, unnest(intents) AS intent FROM (SELECT *, unnest(objects) AS object_id FROM feat)),
sm AS (SELECT o_orderkey AS frame_id, o_orderpriority AS intent, o_custkey % 4 AS finding, o_orderkey % 3 <> 0 AS pass FROM orders)
"""


@query(with_views("vis", _FEATURES + """SELECT feature_id, object_id, intent FROM w WHERE NOT EXISTS (SELECT 1 FROM vis v JOIN sm s ON s.frame_id = v.frame_id AND s.pass
 WHERE s.intent = w.intent AND s.finding = w.finding AND v.object_id = w.object_id AND v.visible_pixels >= w.px AND v.projected_area_px2 >= w.area)"""))
def feature_coverage(spark, sf):
    """Parts as features, orders as samples with a finding, line items as visibility."""
    k, z = F.col("p_partkey"), F.col("p_size")
    features = W.table(spark, sf, "part").select(
        k.alias("feature_id"), F.array(k % 60, (k * 7) % 60).alias("object_ids"), F.array(F.lit("1-URGENT"), F.lit("5-LOW")).alias("view_intents"), (z % 4).cast("long").alias("finding_id"),
        (200 + z * 30).alias("minimum_visible_pixels"), (z * 12).cast("double").alias("minimum_projected_area_px2"))
    orders = W.table(spark, sf, "orders")
    samples = orders.select(F.col("o_orderkey").alias("frame_id"), F.col("o_orderpriority").alias("intent"))
    found = orders.select(F.col("o_orderkey").alias("frame_id"), (F.col("o_custkey") % 4).alias("finding_id"), F.when(F.col("o_orderkey") % 3 != 0, "pass").otherwise("fail").alias("status"))
    return C.feature_coverage(features, samples, visibility(spark, sf), found)


@query("""SELECT p_partkey AS feature_id, intent FROM (SELECT p_partkey, unnest([p_type, p_brand]) AS intent FROM part) WHERE intent NOT IN (SELECT p_type FROM part WHERE p_size > 5 UNION SELECT p_brand FROM part WHERE p_partkey % 50 = 0) GROUP BY 1, 2""")
def missing_intents(spark, sf):
    part = W.table(spark, sf, "part")
    features = part.select(F.col("p_partkey").alias("feature_id"), F.array("p_type", "p_brand").alias("view_intents"))
    shots = part.where("p_size > 5").select(F.col("p_type").alias("intent")).unionByName(part.where("p_partkey % 50 = 0").select(F.col("p_brand").alias("intent")))
    return C.missing_intents(features, shots)


@query("""WITH v AS (SELECT doc_id AS id, sha256(text) AS sha, doc_id % 9 <> 0 AS passed FROM documents WHERE doc_id % 10 <> 0),
r AS (SELECT l.doc_id AS id, CASE WHEN l.doc_id % 7 = 0 THEN 'x' ELSE sha256(d.text) END AS sha, quality = 1 AS ok FROM labels l JOIN documents d USING (doc_id)),
j AS (SELECT coalesce(v.id, r.id) AS id, v.id IS NOT NULL AS hv, r.id IS NOT NULL AS hr, v.sha AS vs, r.sha AS rs, passed, ok FROM v FULL OUTER JOIN r ON v.id = r.id)
SELECT id AS view_id, 'unexpected' AS kind FROM j WHERE NOT hv UNION ALL SELECT id, 'not_reviewed' FROM j WHERE NOT hr UNION ALL SELECT id, 'incomplete' FROM j WHERE hv AND hr AND NOT ok
UNION ALL SELECT id, 'image_changed' FROM j WHERE hv AND hr AND vs <> rs UNION ALL SELECT id, 'subject_not_visible' FROM j WHERE hv AND hr AND NOT passed""")
def review_join(spark, sf):
    """Documents as rendered views, labels as their reviews."""
    docs = W.table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("sha"))
    views = docs.where("doc_id % 10 <> 0").select(F.col("doc_id").alias("view_id"), F.col("sha").alias("image_sha256"), (F.col("doc_id") % 9 != 0).alias("passed"))
    reviews = W.table(spark, sf, "labels").join(docs, "doc_id").select(
        F.col("doc_id").alias("view_id"), F.when(F.col("doc_id") % 7 == 0, "x").otherwise(F.col("sha")).alias("image_sha256"),
        F.when(F.col("quality") == 1, "pass").otherwise("fail").alias("finding"), F.lit("seen").alias("note"), F.lit("m").alias("model_sha256"))
    return C.review_join(views, reviews)


@query("""SELECT o_custkey AS contract_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS eligible_objects, count(*) FILTER (WHERE o_orderstatus = 'O') AS retired_objects, count(*) FILTER (WHERE o_orderstatus = 'P') AS excluded_source_objects
FROM orders GROUP BY 1""")
def disposition_counts(spark, sf):
    status = F.col("o_orderstatus")
    objects = W.table(spark, sf, "orders").select(F.col("o_custkey").alias("contract_id"), F.when(status == "F", "current-eligible").when(status == "O", "retired").otherwise("excluded-source").alias("disposition"))
    return C.disposition_counts(objects, ["contract_id"])


@query("SELECT p_type AS method, count(*) AS materials FROM part GROUP BY 1")
def appearance_rollup(spark, sf):
    return C.appearance_rollup(W.table(spark, sf, "part").select(F.col("p_type").alias("method")))


@query("SELECT o_custkey % 30 AS room, o_orderpriority AS status, count(*) AS surfaces, count(*) FILTER (WHERE o_orderstatus <> 'F') AS open_actions FROM orders GROUP BY 1, 2")
def coverage_atlas_rollup(spark, sf):
    atlas = W.table(spark, sf, "orders").select((F.col("o_custkey") % 30).alias("room"), F.col("o_orderpriority").alias("status"), F.when(F.col("o_orderstatus") != "F", "visit").alias("next_action"))
    return C.coverage_atlas_rollup(atlas)


@query("SELECT p_partkey AS object_id FROM part WHERE p_type = 'LARGE' AND p_size % 5 NOT IN (3, 4)")
def visible_in_view(spark, sf):
    return C.visible_in_view(_objects(spark, sf), "LARGE").select("object_id")


def _objects(spark, sf):
    z = F.col("p_size") % 5
    return W.table(spark, sf, "part").select(F.col("p_partkey").alias("object_id"), F.col("p_type").alias("level"), F.when(z == 3, "roof").when(z == 4, "ceiling").otherwise("wall").alias("role"))


@query("""SELECT p_type AS level, count(*) AS object_count FROM part GROUP BY 1 HAVING count(*) FILTER (WHERE p_size % 5 NOT IN (3, 4)) > 0""")
def model_levels(spark, sf):
    return C.sink_catalog(_objects(spark, sf))


@query("""WITH d AS (SELECT doc_id AS id, doc_id % 12 AS t FROM documents) SELECT 'file_missing' AS rule, CAST(id AS VARCHAR) AS entity_id FROM d WHERE t = 1 UNION ALL SELECT 'size_differs', CAST(id AS VARCHAR) FROM d WHERE t = 2
UNION ALL SELECT 'sha256_differs', CAST(id AS VARCHAR) FROM d WHERE t = 3 UNION ALL SELECT 'not_decodable', CAST(id AS VARCHAR) FROM d WHERE t = 4 UNION ALL SELECT 'fully_transparent', CAST(id AS VARCHAR) FROM d WHERE t = 5""")
def check_sample_images(spark, sf):
    """A small RGBA image per document, some cut and some transparent: declared size and hash against the bytes."""

    def build(batches):
        for batch in batches:
            out = []
            for k in batch["doc_id"]:
                grid = np.full((3, 4, 4), k % 251, np.uint16)
                grid[:, :, 3] = 0 if k % 12 == 5 else 1 + k % 255
                data = png.encode(grid, 8, 6, np.arange(3) + k % 3)
                out.append((k, data[:-25] if k % 12 == 4 else data))
            yield pd.DataFrame(out, columns=["path", "content"])

    t = F.col("path") % 12
    images = image_facts(W.table(spark, sf, "documents").select("doc_id").mapInPandas(build, "path long, content binary"))
    declared = images.select(F.col("path").alias("frame_id"), "path", (F.col("length") + F.when(t == 2, 1).otherwise(0)).alias("bytes"), F.when(t == 3, "0").otherwise(F.col("sha256")).alias("sha256"))
    return C.check_sample_images(declared, images.where(t != 1)).select("rule", "entity_id")
