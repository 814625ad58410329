"""Registered queries: rectangles, texels, photo visibility and blending, ceilings."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import appearance as A
from plumbline.operators import pixels as P
from plumbline.operators import shapes as S
from plumbline.plans import views as W
from plumbline.plans.pixel_queries import PIXEL, rounded
from plumbline.plans.registry import query
from plumbline.plans.views import with_views

# --- rectangles -------------------------------------------------------------

W.SQL["rect4"] = """SELECT o_custkey AS assembly_id, o_orderkey AS id, o_custkey % 2 = 0 AS fit, CASE o_custkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.6 ELSE 0.8 END AS c, CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.8 ELSE 0.6 END AS s,
 CAST(o_orderkey % 50 AS DOUBLE) AS px, CAST(o_orderkey % 30 AS DOUBLE) AS py, CAST(2 + o_orderkey % 5 AS DOUBLE) AS w, CAST(1 + o_orderkey % 3 AS DOUBLE) AS h, (o_orderkey % 7) * 0.01 AS e FROM orders"""
_CORNERS = """, k AS (SELECT *, px AS x0, py AS y0, px + w * c AS x1, py + w * s AS y1, px + w * c - h * s + e AS x2, py + w * s + h * c AS y2, px - h * s AS x3, py + h * c + e AS y3 FROM rect4),
m AS (SELECT *, (x0 + x1 + x2 + x3) / 4 AS cx, (y0 + y1 + y2 + y3) / 4 AS cy, (-x0 + x1 + x2 - x3) / 4 AS hx, (-y0 + y1 + y2 - y3) / 4 AS hy, (-x0 - x1 + x2 + x3) / 4 AS vx, (-y0 - y1 + y2 + y3) / 4 AS vy FROM k),
t AS (SELECT assembly_id, bool_and(fit) AS fit, atan2(2 * sum(hx * hy - vx * vy), sum(hx * hx + vy * vy) - sum(hy * hy + vx * vx)) / 2 AS a, max(c) AS c, max(s) AS s FROM m GROUP BY assembly_id),
ax AS (SELECT assembly_id, CASE WHEN fit THEN cos(a) * CASE WHEN cos(a) * c + sin(a) * s < 0 THEN -1 ELSE 1 END ELSE c END AS ux, CASE WHEN fit THEN sin(a) * CASE WHEN cos(a) * c + sin(a) * s < 0 THEN -1 ELSE 1 END ELSE s END AS uy FROM t)
"""


def rectangles(spark, sf):
    """Slightly bent rectangles, one assembly per customer; even assemblies fit their orientation."""
    k, a = F.col("o_orderkey"), F.col("o_custkey")
    c = F.when(a % 4 == 0, 1.0).when(a % 4 == 1, 0.6).otherwise(0.8)
    s = F.when(a % 4 == 0, 0.0).when(a % 4 == 1, 0.8).otherwise(0.6)
    d = lambda e: e.cast("double")
    x, y, w, h, e = d(k % 50), d(k % 30), d(2 + k % 5), d(1 + k % 3), (k % 7) * 0.01
    controls = F.array(F.array(x, y), F.array(x + w * c, y + w * s), F.array(x + w * c - h * s + e, y + w * s + h * c), F.array(x - h * s, y + h * c + e))
    orders = W.table(spark, sf, "orders")
    rect = orders.select(a.alias("assembly_id"), k.alias("id"), controls.alias("controls"))
    frames = orders.select(a.alias("assembly_id"), F.array(F.lit(0.0), F.lit(0.0)).alias("origin"), F.array(c, s).alias("u_axis"), (a % 2 == 0).alias("fit_orientation")).distinct()
    return rect, frames


@query(with_views("rect4", _CORNERS + "SELECT assembly_id, round(ux, 6) + 0.0 AS ux, round(uy, 6) + 0.0 AS uy, true AS resolved FROM ax"))
def shared_orientation_fit(spark, sf):
    out = S.shared_orientation_fit(*rectangles(spark, sf))
    zeroed = {n: F.round(n, 6) + 0.0 for n in ("ux", "uy")}
    return out.select("assembly_id", "ux", "uy", "resolved").withColumns(zeroed)


@query(with_views("rect4", _CORNERS + """, f AS (SELECT m.*, ux, uy, hx * ux + hy * uy AS hu, vy * ux - vx * uy AS hv FROM m JOIN ax USING (assembly_id))
SELECT assembly_id, id, round(2 * hu, 6) AS width, round(2 * hv, 6) AS height, round(cx, 6) AS center_x, round(cy, 6) AS center_y,
 round(sqrt((cx - hu * ux + hv * uy - x0) * (cx - hu * ux + hv * uy - x0) + (cy - hu * uy - hv * ux - y0) * (cy - hu * uy - hv * ux - y0)), 6) AS error_0 FROM f"""))
def rectangle_fit(spark, sf):
    out = S.rectangle_fit(*rectangles(spark, sf))
    return rounded(out.select("assembly_id", "id", "width", "height", "center_x", "center_y", F.col("errors")[0].alias("error_0")), "width", "height", "center_x", "center_y", "error_0")


@query("""SELECT 'controls_not_convex' AS rule, CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) AS entity_id FROM orders WHERE o_orderkey % 12 = 5
UNION ALL SELECT 'controls_not_finite', CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderkey % 12 = 7
UNION ALL SELECT 'axis_not_unit', CAST(c AS VARCHAR) FROM (SELECT DISTINCT o_custkey AS c FROM orders) WHERE c % 9 = 0
UNION ALL SELECT 'corner_order', CAST(o_custkey AS VARCHAR) || '/' || CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_custkey % 2 = 1 AND o_orderkey % 12 NOT IN (5, 7) AND o_custkey % 4 = 3""")
def check_rectangles(spark, sf):
    """Crossed corners, missing numbers, axes that are not unit, axes pointing backwards."""
    rect, frames = rectangles(spark, sf)
    k = F.col("id") % 12
    swapped = F.array(*[F.col("controls")[i] for i in (0, 2, 1, 3)])
    broken = F.array(F.array(F.lit(float("nan")), F.lit(0.0)), *[F.col("controls")[i] for i in (1, 2, 3)])
    rect = rect.withColumn("controls", F.when(k == 5, swapped).when(k == 7, broken).otherwise(F.col("controls")))
    a = F.col("assembly_id")
    axis = F.when(a % 9 == 0, F.transform("u_axis", lambda x: x * 1.5)).otherwise(F.when(a % 4 == 3, F.transform("u_axis", lambda x: -x)).otherwise(F.col("u_axis")))
    axis = F.when((a % 9 == 0) & (a % 4 == 3), F.transform("u_axis", lambda x: x * -1.5)).otherwise(axis)
    found = S.check_rectangles(rect, frames.withColumn("u_axis", axis)).where("rule <> 'corner_order' OR CAST(split(entity_id, '/')[0] AS BIGINT) % 2 = 1")
    crossed = rect.where(k == 5).select(F.concat_ws("/", a.cast("string"), F.col("id").cast("string")).alias("entity_id"))
    # a crossed quad can also fail the order rule; the check counts sound quads only
    order = found.where("rule = 'corner_order'").join(crossed, "entity_id", "left_anti").select("rule", "entity_id")
    return found.where("rule <> 'corner_order'").select("rule", "entity_id").unionByName(order)


# --- faces and texels -------------------------------------------------------

W.SQL["wall"] = """SELECT p_partkey AS object_id, CAST(1 + p_size % 6 AS DOUBLE) AS w, CAST(1 + p_partkey % 4 AS DOUBLE) AS h, CAST(p_partkey % 9 AS DOUBLE) AS x0, CAST(p_partkey % 3 = 0 AS BOOLEAN) AS tri FROM part"""


def walls(spark, sf):
    """Upright rectangles and right triangles."""
    k = F.col("p_partkey")
    w, h, x0, o = (1 + F.col("p_size") % 6).cast("double"), (1 + k % 4).cast("double"), (k % 9).cast("double"), F.lit(0.0)
    p = lambda x, z: F.array(x, o, z)
    ring = F.when(k % 3 == 0, F.array(p(x0, o), p(x0 + w, o), p(x0, h))).otherwise(F.array(p(x0, o), p(x0 + w, o), p(x0 + w, h), p(x0, h)))
    return W.table(spark, sf, "part").select(k.alias("object_id"), F.lit(0).alias("face"), ring.alias("polygon"))


@query(with_views("wall", """SELECT object_id, true AS usable, round(CASE WHEN tri THEN w * h / 2 ELSE w * h END, 6) AS area, round(CASE WHEN tri THEN sqrt(w * w + h * h) ELSE greatest(w, h) END, 6) AS extent_u,
 round(CASE WHEN tri THEN w * h / sqrt(w * w + h * h) ELSE least(w, h) END, 6) AS extent_v, CAST(-1 AS DOUBLE) AS normal_y FROM wall"""))
def face_frame(spark, sf):
    out = A.face_frame(walls(spark, sf))
    return rounded(out.select("object_id", "usable", "area", "extent_u", "extent_v", F.round(F.col("normal")[1], 6).alias("normal_y")), "area", "extent_u", "extent_v")


@query(with_views("wall", """, d AS (SELECT object_id, w, h, tri, CASE WHEN tri THEN sqrt(w * w + h * h) ELSE greatest(w, h) END AS eu, CASE WHEN tri THEN w * h / sqrt(w * w + h * h) ELSE least(w, h) END AS ev FROM wall),
g AS (SELECT *, greatest(2, CAST(ceil(eu * 3) AS INTEGER)) AS nc, greatest(2, CAST(ceil(ev * 3) AS INTEGER)) AS nr FROM d)
SELECT object_id, CAST(nc * nr AS BIGINT) AS texels, CASE WHEN NOT tri THEN CAST(nc * nr AS BIGINT) END AS inside_rect, round(CASE WHEN NOT tri THEN 1 END, 1) AS share FROM g"""))
def texel_grid(spark, sf):
    """Texel counts; every texel of a rectangle lies inside it."""
    t = A.texel_grid(A.face_frame(walls(spark, sf)), 3.0).groupBy("object_id").agg(F.count("*").alias("texels"), F.count_if("inside").alias("n"))
    rect = F.col("object_id") % 3 != 0
    return t.select("object_id", "texels", F.when(rect, F.col("n")).alias("inside_rect"), F.when(rect, F.round(F.col("n") / F.col("texels"), 1)).alias("share"))


@query("""WITH v AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 20 AS x, CAST(embedding[2] AS DOUBLE) * 20 AS y, CAST(embedding[3] AS DOUBLE) * 20 AS z FROM embeddings),
l AS (SELECT vec_id, (0.6 * (x - label) + 0.8 * z) / 1.5 AS a, (y - 0.5) / (1 + label % 3) AS b FROM v)
SELECT vec_id, round((1 - abs(a - 2 * floor(a / 2) - 1)) * 63, 6) AS tile_x, round((1 - abs(b - 2 * floor(b / 2) - 1)) * 31, 6) AS tile_y FROM l""")
def repeat_coordinates(spark, sf):
    e = lambda i: F.element_at("embedding", i).cast("double") * 20
    points = W.table(spark, sf, "embeddings").select("vec_id", "label", e(1).alias("x"), e(2).alias("y"), e(3).alias("z"))
    num = lambda *v: F.array(*[F.lit(float(x)) if not hasattr(x, "cast") else x.cast("double") for x in v])
    mapping = W.table(spark, sf, "embeddings").select("label").distinct().select(
        "label", num(F.col("label"), 0.5, 0).alias("map_origin"), num(0.6, 0, 0.8).alias("map_u"), num(0, 1, 0).alias("map_v"), num(1.5, 1 + F.col("label") % 3).alias("size_m"),
        F.lit(64).alias("tile_width"), F.lit(32).alias("tile_height"))
    return rounded(A.repeat_coordinates(points, mapping, ["label"]).select("vec_id", "tile_x", "tile_y"), "tile_x", "tile_y")


# --- visibility and blending ------------------------------------------------

@query(with_views("px cam pts", """, o AS (SELECT p.capture_id, p.frame_id, p.v, p.u, p.depth_mm / 1000.0 AS d, q.depth_mm AS mm, q.confidence AS conf FROM pts p
 LEFT JOIN px q ON q.capture_id = CASE p.capture_id WHEN 'A' THEN 'N' WHEN 'N' THEN 'R' ELSE 'A' END AND q.frame_id = p.frame_id AND q.v = p.v AND q.u = p.u)
SELECT capture_id, frame_id, v, u, coalesce(conf = 255 AND mm > 0 AND abs(mm / 1000.0 - d) <= 1.5, false) AS accepted, round(abs(mm / 1000.0 - d), 9) AS residual_m FROM o"""))
def depth_visibility(spark, sf):
    """Points of one capture checked against the depth another capture saw at that pixel."""
    points = W.pts(spark, sf).withColumn("other", F.when(F.col("capture_id") == "A", "N").when(F.col("capture_id") == "N", "R").otherwise("A"))
    projected = P.project_to_camera(points, W.cam(spark, sf), ["frame_id"])
    depth = W.px(spark, sf).withColumnRenamed("capture_id", "other")
    out = A.depth_visibility(projected, depth, ["other", "frame_id"], W.DEPTH_SIZE, W.RGB_SIZE, tolerance_m=1.5)
    return rounded(out.select(*PIXEL, "accepted", "residual_m"), "residual_m", places=9)


@query("""WITH img AS (SELECT l_suppkey % 10 AS image_id, l_orderkey % 16 AS v, l_partkey % 16 AS u, max(CAST(l_quantity AS INTEGER)) AS r FROM lineitem GROUP BY 1, 2, 3),
s AS (SELECT o_orderkey AS id, o_custkey % 10 AS image_id, (o_orderkey % 160) / CAST(10 AS DOUBLE) AS pu, (o_custkey % 150) / CAST(10 AS DOUBLE) AS pv FROM orders),
c AS (SELECT id, image_id, least(pu, 15) AS pu, least(pv, 15) AS pv FROM s),
n AS (SELECT id, image_id, CAST(floor(pu) AS BIGINT) + d.du AS u, CAST(floor(pv) AS BIGINT) + d.dv AS v, (CASE WHEN d.du = 1 THEN pu - floor(pu) ELSE 1 - pu + floor(pu) END) * (CASE WHEN d.dv = 1 THEN pv - floor(pv) ELSE 1 - pv + floor(pv) END) AS w
 FROM c, (VALUES (0, 0), (1, 0), (0, 1), (1, 1)) d(du, dv))
SELECT id, CASE WHEN count(*) = count(r) THEN round(sum(w * r), 6) END AS r FROM n LEFT JOIN img USING (image_id, v, u) WHERE w > 0 GROUP BY id""")
def bilinear_sample(spark, sf):
    pixels = W.table(spark, sf, "lineitem").groupBy((F.col("l_suppkey") % 10).alias("image_id"), (F.col("l_orderkey") % 16).alias("v"), (F.col("l_partkey") % 16).alias("u")).agg(
        F.max(F.col("l_quantity").cast("int")).alias("r"))
    samples = W.table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 10).alias("image_id"), ((F.col("o_orderkey") % 160) / F.lit(10.0)).alias("px_u"), ((F.col("o_custkey") % 150) / F.lit(10.0)).alias("px_v"))
    return rounded(A.bilinear_sample(samples, pixels, ["image_id"], (16, 16), ["id"], ["r"]), "r")


W.SQL["con"] = """SELECT l_orderkey AS texel_id, l_suppkey AS source_id, l_quantity * 5 AS r, 255 - l_linenumber AS g, l_partkey % 256 AS b, 0.05 + l_partkey % 50 * CAST(0.1 AS DOUBLE) AS d, l_linenumber / CAST(7 AS DOUBLE) AS c, l_tax AS e,
 l_discount < 0.08 AS ok FROM lineitem"""
_WEIGHT = """, w AS (SELECT *, CASE WHEN ok AND c > 0.3 AND least(r, g, b) < 248 THEN pow(c, 4) / greatest(d, 0.1) * exp(-pow(e / 0.1, 2)) ELSE 0 END AS wt FROM con)
"""


def contributions(spark, sf):
    """Line items as photo samples of order texels."""
    return W.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("texel_id"), F.col("l_suppkey").alias("source_id"), (F.col("l_quantity") * 5).alias("r"), (255 - F.col("l_linenumber")).alias("g"), (F.col("l_partkey") % 256).alias("b"),
        (0.05 + F.col("l_partkey") % 50 * 0.1).alias("distance_m"), (F.col("l_linenumber") / F.lit(7.0)).alias("cosine"), F.col("l_tax").alias("residual_m"), (F.col("l_discount") < 0.08).alias("accepted"), F.lit(True).alias("inside"))


@query(with_views("con", _WEIGHT + """SELECT texel_id, CASE WHEN sum(wt) > 0 THEN round(sum(wt * r) / sum(wt), 6) END AS r, CASE WHEN sum(wt) > 0 THEN round(sum(wt * b) / sum(wt), 6) END AS b, CASE WHEN sum(wt) > 0 THEN round(sum(wt * g) / sum(wt), 6) END AS g, sum(wt) > 0 AS covered,
 count(*) FILTER (WHERE wt > 0) AS contributions FROM w GROUP BY texel_id"""))
def photo_blend(spark, sf):
    return rounded(A.photo_blend(contributions(spark, sf), ["texel_id"]), "r", "g", "b")


@query(with_views("con", _WEIGHT + """, c AS (SELECT texel_id, sum(wt) > 0 AS covered FROM w GROUP BY texel_id)
SELECT o_custkey AS face, count(*) FILTER (WHERE o_orderstatus <> 'P') AS inside, count(*) FILTER (WHERE o_orderstatus <> 'P' AND covered) AS covered,
 round(count(*) FILTER (WHERE o_orderstatus <> 'P' AND covered) / CAST(greatest(count(*) FILTER (WHERE o_orderstatus <> 'P'), 1) AS DOUBLE), 6) AS photo_coverage
FROM orders LEFT JOIN c ON texel_id = o_orderkey GROUP BY o_custkey"""))
def photo_coverage(spark, sf):
    texels = W.table(spark, sf, "orders").select(F.col("o_custkey").alias("face"), F.col("o_orderkey").alias("texel_id"), (F.col("o_orderstatus") != "P").alias("inside"))
    owner = texels.select("face", "texel_id")
    blended = A.photo_blend(contributions(spark, sf), ["texel_id"]).join(owner, "texel_id")
    return rounded(A.photo_coverage(texels, blended, ["face"], ["texel_id"]), "photo_coverage")


@query(with_views("con", _WEIGHT + "SELECT texel_id % 50 AS face, source_id, count(*) FILTER (WHERE wt > 0) AS texels FROM w GROUP BY 1, 2"))
def source_contributions(spark, sf):
    c = contributions(spark, sf).withColumn("face", F.col("texel_id") % 50)
    return A.source_contributions(c, ["face"])


# --- ceilings ---------------------------------------------------------------

W.SQL["roofs"] = """SELECT CAST(o_orderkey % 40 AS DOUBLE) AS x0, CAST((o_orderkey * 7) % 30 AS DOUBLE) AS y0, CAST(2 + o_custkey % 4 AS DOUBLE) AS w, CAST(1 + o_custkey % 3 AS DOUBLE) AS h, CAST(o_custkey % 9 AS DOUBLE) AS z, CAST(o_orderkey % 3 AS DOUBLE) AS rise, o_custkey % 4 AS scene FROM orders WHERE o_orderkey % 5 <> 0"""
W.SQL["spots"] = """SELECT c_custkey AS point_id, c_custkey % 43 + 0.37 AS x, (c_custkey * 3) % 33 + 0.61 AS y, CAST(c_custkey % 6 AS DOUBLE) AS floor_z, c_custkey // 10 % 4 AS scene FROM customer"""
_CEILING = """, h AS (SELECT point_id, min(z + rise * (x - x0) / w) AS ceiling_z FROM spots s JOIN roofs r ON r.scene = s.scene AND x > x0 AND x < x0 + w AND y > y0 AND y < y0 + h AND z + rise * (x - x0) / w > floor_z GROUP BY point_id)
"""


def roofs(spark, sf):
    """Sloped rectangles of four scenes in the same coordinates; every fifth is upright and must be ignored."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda e: e.cast("double")
    x0, y0, w, h, z, rise = d(k % 40), d((k * 7) % 30), d(2 + c % 4), d(1 + c % 3), d(c % 9), d(k % 3)
    upright = F.array(F.array(x0, y0, z), F.array(x0 + w, y0, z), F.array(x0 + w, y0, z + 2))
    slope = F.array(F.array(x0, y0, z), F.array(x0 + w, y0, z + rise), F.array(x0 + w, y0 + h, z + rise), F.array(x0, y0 + h, z))
    return W.table(spark, sf, "orders").select((c % 4).alias("scene"), F.when(k % 5 == 0, upright).otherwise(slope).alias("polygon"))


def spots(spark, sf):
    k = F.col("c_custkey")
    return W.table(spark, sf, "customer").select((F.floor(k / 10) % 4).alias("scene"), k.alias("point_id"), (k % 43 + 0.37).alias("x"), ((k * 3) % 33 + 0.61).alias("y"), (k % 6).cast("double").alias("floor_z"))


@query(with_views("roofs spots", _CEILING + "SELECT s.point_id, round(ceiling_z, 6) AS ceiling_z FROM spots s LEFT JOIN h USING (point_id)"))
def ceiling_above(spark, sf):
    return rounded(A.ceiling_above(spots(spark, sf), roofs(spark, sf), scene=["scene"]).select("point_id", "ceiling_z"), "ceiling_z")


@query(with_views("roofs spots", _CEILING + """SELECT s.point_id AS light_id, round(ceiling_z - 0.25, 6) AS light_z, coalesce(ceiling_z - 0.25 > floor_z, false) AS placed FROM spots s LEFT JOIN h USING (point_id)"""))
def lowest_above(spark, sf):
    lights = spots(spark, sf).withColumnRenamed("point_id", "light_id").withColumn("clearance", F.lit(0.25))
    return rounded(A.lowest_above(lights, roofs(spark, sf), scene=["scene"]).select("light_id", "light_z", "placed"), "light_z")
