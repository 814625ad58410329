"""Registered queries: clipping, cutting, shared edges, view emission."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.joins import by_shuffle
from plumbline.operators import drawing as D
from plumbline.plans import views as W
from plumbline.plans.pixel_queries import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import with_views

# --- axis-aligned boxes cut by axis planes ----------------------------------

W.SQL["quad"] = """SELECT o_orderkey AS id, o_custkey % 3 AS plane_axis, CAST(o_orderkey % 20 AS DOUBLE) AS x0, CAST((o_orderkey * 7) % 15 AS DOUBLE) AS y0,
 CAST(1 + o_custkey % 9 AS DOUBLE) AS w, CAST(1 + o_orderkey % 8 AS DOUBLE) AS h, CAST(o_custkey % 11 AS DOUBLE) AS z, CAST(o_custkey % 24 AS DOUBLE) + 0.25 AS value, o_orderkey % 2 = 0 AS below FROM orders"""


def quads(spark, sf):
    """Rectangles in the XY plane at several heights, with a clip value each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    d = lambda e: e.cast("double")
    x0, y0, w, h, z = d(k % 20), d((k * 7) % 15), d(1 + c % 9), d(1 + k % 8), d(c % 11)
    ring = F.array(F.array(x0, y0, z), F.array(x0 + w, y0, z), F.array(x0 + w, y0 + h, z), F.array(x0, y0 + h, z))
    return W.table(spark, sf, "orders").select(k.alias("id"), ring.alias("polygon"), (d(c % 24) + 0.25).alias("value"), (k % 2 == 0).alias("below"))


def _area_xy(polygon):
    from plumbline.functions import vectors as V

    return V.let(V.fan_normal(polygon), lambda n: F.abs(n[2]) / 2)


@query(with_views("quad", """SELECT id, CASE WHEN below THEN CASE WHEN x0 + w <= value THEN 4 WHEN x0 > value THEN 0 ELSE 4 END ELSE CASE WHEN x0 >= value THEN 4 WHEN x0 + w < value THEN 0 ELSE 4 END END AS corners,
 round(CASE WHEN below THEN greatest(0, least(x0 + w, value) - x0) ELSE greatest(0, x0 + w - greatest(x0, value)) END * h, 6) AS area FROM quad"""))
def clip_halfspace(spark, sf):
    df = quads(spark, sf)
    clipped = df.withColumn("c", D.clip_halfspace(F.col("polygon"), F.lit(0), F.col("value"), F.col("below")))
    return rounded(clipped.select("id", F.size("c").alias("corners"), _area_xy(F.col("c")).alias("area")), "area")


@query(with_views("quad", """SELECT id, CASE WHEN x0 < value AND value < x0 + w THEN 2 ELSE 0 END AS points, CASE WHEN x0 < value AND value < x0 + w THEN h END AS length FROM quad"""))
def intersect_plane(spark, sf):
    cut = quads(spark, sf).withColumn("c", D.intersect_plane(F.col("polygon"), F.lit(0), F.col("value")))
    length = F.when(F.size("c") == 2, F.abs(F.get("c", F.lit(1))[1] - F.get("c", F.lit(0))[1]))
    return cut.select("id", F.size("c").alias("points"), length.alias("length"))


@query(with_views("quad", """SELECT id, i AS pos, round(CASE i WHEN 0 THEN x0 WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w ELSE x0 END * 0.6 + z * 0.8, 6) AS r,
 CASE i WHEN 0 THEN y0 WHEN 1 THEN y0 WHEN 2 THEN y0 + h ELSE y0 + h END AS u FROM quad, (SELECT unnest([0, 1, 2, 3]) AS i)"""))
def project_drawing(spark, sf):
    right, up = F.array(F.lit(0.6), F.lit(0.0), F.lit(0.8)), F.array(F.lit(0.0), F.lit(1.0), F.lit(0.0))
    flat = quads(spark, sf).select("id", F.posexplode(D.project_drawing(F.col("polygon"), right, up)).alias("pos", "p"))
    return rounded(flat.select("id", "pos", F.col("p")[0].alias("r"), F.col("p")[1].alias("u")), "r")


@query(with_views("quad", """SELECT id, i AS pos, CASE i WHEN 0 THEN x0 WHEN 1 THEN x0 + w WHEN 2 THEN x0 + w ELSE x0 END AS ax, CASE i WHEN 0 THEN x0 + w WHEN 1 THEN x0 + w WHEN 2 THEN x0 ELSE x0 END AS bx,
 CASE i WHEN 0 THEN y0 WHEN 1 THEN y0 + h WHEN 2 THEN y0 + h ELSE y0 END AS by_ FROM quad, (SELECT unnest([0, 1, 2, 3]) AS i)"""))
def polygon_segments(spark, sf):
    parts = quads(spark, sf).select("id", F.posexplode(D.polygon_segments(F.col("polygon"))).alias("pos", "s"))
    return parts.select("id", "pos", F.col("s.a")[0].alias("ax"), F.col("s.b")[0].alias("bx"), F.col("s.b")[1].alias("by_"))


W.SQL["lines"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_orderkey % 30 AS DOUBLE) AS x0, CAST(l_partkey % 20 AS DOUBLE) AS y0,
 CAST(l_orderkey % 30 + l_linenumber - 4 AS DOUBLE) AS x1, CAST(l_partkey % 20 + l_suppkey % 5 - 2 AS DOUBLE) AS y1 FROM lineitem"""
LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


def lines(spark, sf):
    d = lambda e: F.expr(e).cast("double")
    return W.table(spark, sf, "lineitem").select(
        *LINE, d("l_orderkey % 30").alias("x0"), d("l_partkey % 20").alias("y0"),
        d("l_orderkey % 30 + l_linenumber - 4").alias("x1"), d("l_partkey % 20 + l_suppkey % 5 - 2").alias("y1"))


@query(with_views("lines", """, k AS (SELECT *, CASE WHEN x1 = x0 THEN CASE WHEN x0 BETWEEN 5 AND 22.5 THEN 0 ELSE 2 END ELSE least((5 - x0) / (x1 - x0), (22.5 - x0) / (x1 - x0)) END AS ax,
 CASE WHEN x1 = x0 THEN 1 ELSE greatest((5 - x0) / (x1 - x0), (22.5 - x0) / (x1 - x0)) END AS bx,
 CASE WHEN y1 = y0 THEN CASE WHEN y0 BETWEEN 3 AND 15.25 THEN 0 ELSE 2 END ELSE least((3 - y0) / (y1 - y0), (15.25 - y0) / (y1 - y0)) END AS ay,
 CASE WHEN y1 = y0 THEN 1 ELSE greatest((3 - y0) / (y1 - y0), (15.25 - y0) / (y1 - y0)) END AS by_ FROM lines)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0, least(1, bx, by_) - greatest(0, ax, ay)) * sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)), 6) AS length FROM k"""))
def segment_length_in_bounds(spark, sf):
    box = F.array(F.lit(5.0), F.lit(22.5), F.lit(3.0), F.lit(15.25))
    return rounded(lines(spark, sf).select(*LINE, D.segment_length_in_bounds(*[F.col(c) for c in ("x0", "y0", "x1", "y1")], box).alias("length")), "length")


@query(with_views("lines", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (x1 - x0 = y1 - y0 AND x0 = y0 AND least(x0, x1) >= 2 AND greatest(x0, x1) <= 16) AS contained FROM lines"""))
def segment_is_subsegment(spark, sf):
    source = [F.lit(v) for v in (2.0, 2.0, 16.0, 16.0)]
    return lines(spark, sf).select(*LINE, D.segment_is_subsegment([F.col(c) for c in ("x0", "y0", "x1", "y1")], source).alias("contained"))


@query("""SELECT l_suppkey AS object_id, l_orderkey % 50 AS selection, true AS finite, count(DISTINCT (l_quantity, l_discount, l_linenumber)) AS unique_point_count,
 count(DISTINCT (l_quantity, l_discount, l_linenumber)) = 1 AS all_vertices_coincident FROM lineitem GROUP BY 1, 2""")
def point_collapse(spark, sf):
    corners = W.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("object_id"), (F.col("l_orderkey") % 50).alias("selection"),
        F.col("l_quantity").alias("x"), F.col("l_discount").alias("y"), F.col("l_linenumber").cast("double").alias("z"))
    return D.point_collapse(corners, ["object_id", "selection"])


# --- view pipeline ----------------------------------------------------------

W.SQL["slab"] = """SELECT p_partkey AS object_id, CAST(p_partkey % 23 AS DOUBLE) AS x0, CAST((p_partkey * 3) % 17 AS DOUBLE) AS y0, CAST(1 + p_size % 6 AS DOUBLE) AS w, CAST(p_partkey % 4 AS DOUBLE) AS h, CAST(p_partkey % 5 AS DOUBLE) AS z,
 1 + p_partkey % 4 AS view_id FROM part"""
# the four views: a plan clipped above z, a section at x = 6.5, an elevation clipped to x <= 12, a plan with a spatial clip
_VIEW_SEGMENTS = """, face AS (SELECT *, view_id AS v FROM slab WHERE h > 0 OR true),
vis AS (SELECT object_id, v, x0, CASE WHEN v = 4 THEN least(x0 + w, 10.5) ELSE x0 + w END AS x1, y0, y0 + h AS y1, z FROM face
 WHERE (v IN (1, 4) AND z <= 2.5 AND (v <> 4 OR x0 <= 10.5)) OR (v = 3)),
ends AS (
 SELECT v, object_id, x0 AS ax, y0 AS ay, x1 AS bx, y0 AS by_ FROM vis WHERE v IN (1, 4) UNION ALL SELECT v, object_id, x1, y0, x1, y1 FROM vis WHERE v IN (1, 4)
 UNION ALL SELECT v, object_id, x1, y1, x0, y1 FROM vis WHERE v IN (1, 4) UNION ALL SELECT v, object_id, x0, y1, x0, y0 FROM vis WHERE v IN (1, 4)
 UNION ALL SELECT v, object_id, x0, z, x1, z FROM vis WHERE v = 3 UNION ALL SELECT v, object_id, x1, z, x0, z FROM vis WHERE v = 3)
"""


def view_tables(spark, sf):
    """Horizontal slabs (some without depth) drawn in a plan, an x section, an elevation and a clipped plan."""
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    k = F.col("p_partkey")
    d = lambda e: e.cast("double")
    x0, y0, w, h, z = d(k % 23), d((k * 3) % 17), d(1 + F.col("p_size") % 6), d(k % 4), d(k % 5)
    corner = [F.array(x0, y0, z), F.array(x0 + w, y0, z), F.array(x0 + w, y0 + h, z), F.array(x0, y0 + h, z)]
    part = W.table(spark, sf, "part")
    polygons = part.select(k.alias("object_id"), F.lit(0).alias("face"), F.array(*corner).alias("polygon"))
    tri = lambda *i: F.array(*[corner[j] for j in i])
    triangles = part.select(k.alias("object_id"), F.lit(0).alias("face"), F.explode(F.array(tri(0, 1, 2), tri(0, 2, 3))).alias("polygon"))
    none = F.array().cast("array<struct<axis:int,value_m:double,keep_below:boolean>>")
    subjects = part.select((1 + k % 4).alias("view_id"), k.alias("object_id"), F.lit(0).alias("face"), none.alias("clips"))
    number = (F.col("r_regionkey") + 1).cast("long")
    cut = lambda axis, value: F.struct(F.lit(axis).alias("axis"), F.lit(value).alias("value_m"), F.lit(True).alias("keep_below"))
    is_view = lambda i: F.col("view_id") == i
    region = W.table(spark, sf, "region").where("r_regionkey < 4").select(number.alias("view_id"))
    views = region.select(
        "view_id", F.when(is_view(2), "section").when(is_view(3), "elevation").otherwise("plan").alias("kind"),
        F.when(is_view(2), vec(0, 1, 0)).otherwise(vec(1, 0, 0)).alias("right_frame"),
        F.when(is_view(2) | is_view(3), vec(0, 0, 1)).otherwise(vec(0, 1, 0)).alias("up_frame"),
        F.when(is_view(2), cut(0, 6.5)).when(~is_view(3), cut(2, 2.5)).alias("cut"),
        F.when(is_view(4), F.array(cut(0, 10.5))).otherwise(none).alias("clips"), vec(2, 15.5, 1, 12).alias("bounds"))
    return views, subjects, polygons, triangles


_SEGMENTS = _VIEW_SEGMENTS + """, sec AS (SELECT view_id AS v, object_id, y0 AS ax, z AS ay, y0 + h AS bx, z AS by_ FROM slab WHERE view_id = 2 AND x0 < 6.5 AND x0 + w > 6.5 AND h > 0),
seg AS (SELECT * FROM ends WHERE ax <> bx OR ay <> by_)
"""


@query(with_views("slab", _SEGMENTS + """SELECT v AS view_id, object_id, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 6) AS length FROM seg GROUP BY 1, 2
UNION ALL SELECT v, object_id, round(sum(sqrt((bx - ax) * (bx - ax) + (by_ - ay) * (by_ - ay))), 6) FROM sec GROUP BY 1, 2"""))
def view_cut_pipeline(spark, sf):
    """Drawn length per view and object."""
    segments = D.view_cut_pipeline(*view_tables(spark, sf))
    length = F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"))
    return rounded(segments.groupBy("view_id", "object_id").agg(F.sum(length).alias("length")), "length")


_INSIDE = """, allseg AS (SELECT * FROM seg UNION ALL SELECT * FROM sec),
ins AS (SELECT *, CASE WHEN ax = bx THEN CASE WHEN ax BETWEEN 2 AND 15.5 THEN greatest(0, least(greatest(ay, by_), 12) - greatest(least(ay, by_), 1)) ELSE 0 END
 ELSE CASE WHEN ay BETWEEN 1 AND 12 THEN greatest(0, least(greatest(ax, bx), 15.5) - greatest(least(ax, bx), 2)) ELSE 0 END END AS len FROM allseg),
obj AS (SELECT v, object_id, count(*) AS segments, sum(len) AS emitted, max(len) AS best FROM ins GROUP BY 1, 2)
"""


@query(with_views("slab", _SEGMENTS + _INSIDE + """SELECT s.view_id, s.object_id, CASE WHEN o.v IS NULL THEN 'selected_faces_emitted_no_segments_after_cuts_or_clips'
 WHEN best <= 1e-9 THEN 'selected_faces_have_no_segments_inside_declared_bounds' ELSE 'drawn' END AS status, round(coalesce(emitted, 0), 6) AS emitted_m FROM slab s LEFT JOIN obj o ON o.v = s.view_id AND o.object_id = s.object_id"""))
def view_emission(spark, sf):
    views, subjects, polygons, triangles = view_tables(spark, sf)
    segments = D.view_cut_pipeline(views, subjects, polygons, triangles)
    corners = subjects.join(by_shuffle(polygons), ["object_id", "face"]).select("view_id", "object_id", F.explode("polygon").alias("p")).select(
        "view_id", "object_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"), F.col("p")[2].alias("z"))
    collapsed = D.point_collapse(corners, ["view_id", "object_id"]).where("all_vertices_coincident")
    objects, _ = D.view_emission(views, subjects, segments, collapsed)
    return rounded(objects.select("view_id", "object_id", "status", "emitted_m"), "emitted_m")


# --- shared edges -----------------------------------------------------------

W.SQL["tiles"] = """SELECT DISTINCT CAST(o_orderkey // 40 % 12 AS BIGINT) AS g, o_orderkey % 40 AS y, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey % 60 // 2 * 2 ELSE o_custkey % 60 END AS x,
 CASE WHEN o_orderkey % 2 = 0 THEN 2 ELSE 1 END AS w FROM orders"""
W.SQL["unit_edges"] = """SELECT g, e.o AS o, e.a AS a, e.b AS b FROM (SELECT g, unnest(list_concat(
 list_transform(range(0, w), lambda i: {'o': 'h', 'a': x + i, 'b': y}), list_transform(range(0, w), lambda i: {'o': 'h', 'a': x + i, 'b': y + 1}),
 [{'o': 'v', 'a': x, 'b': y}, {'o': 'v', 'a': x + w, 'b': y}])) AS e FROM tiles)"""


def tiles(spark, sf):
    """Rows of one- and two-wide tiles with gaps, so neighbours meet at T-junctions."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    even = k % 2 == 0
    t = W.table(spark, sf, "orders").select(
        (F.floor(k / 40) % 12).alias("group_id"), (k % 40).alias("y"), F.when(even, F.floor(c % 60 / 2) * 2).otherwise(c % 60).alias("x"), F.when(even, 2).otherwise(1).alias("w")).distinct()
    point = lambda x, y: F.array(x.cast("double"), y.cast("double"), F.col("group_id").cast("double"))
    x0, x1, y0, y1 = F.col("x"), F.col("x") + F.col("w"), F.col("y"), F.col("y") + 1
    return t.select("group_id", (F.col("y") * 1000 + F.col("x")).alias("piece_id"), F.array(point(x0, y0), point(x1, y0), point(x1, y1), point(x0, y1)).alias("polygon"))


@query(with_views("tiles unit_edges", """SELECT g AS group_id, o, a, b FROM unit_edges GROUP BY g, o, a, b HAVING count(*) = 1"""))
def shared_edge_match(spark, sf):
    """The outer boundary, written as unit edges."""
    boundary, _ = D.shared_edge_match(tiles(spark, sf), cell_m=2.0)
    horizontal = F.col("py") == F.col("qy")
    steps = F.when(horizontal, F.sequence(F.col("px").cast("long"), F.col("qx").cast("long") - 1)).otherwise(F.sequence(F.col("py").cast("long"), F.col("qy").cast("long") - 1))
    unit = boundary.select("group_id", F.when(horizontal, "h").otherwise("v").alias("o"), "px", "py", F.explode(steps).alias("i"))
    return unit.select("group_id", "o", F.when(F.col("o") == "h", F.col("i")).otherwise(F.col("px").cast("long")).alias("a"),
                       F.when(F.col("o") == "h", F.col("py").cast("long")).otherwise(F.col("i")).alias("b"))


@query(with_views("tiles unit_edges", """, own AS (SELECT t.g, t.y * 1000 + t.x AS piece, u.o, u.a, u.b FROM tiles t JOIN (SELECT g, o, a, b FROM unit_edges GROUP BY g, o, a, b HAVING count(*) = 1) u
 ON u.g = t.g AND ((u.o = 'h' AND u.a >= t.x AND u.a < t.x + t.w AND (u.b = t.y OR u.b = t.y + 1)) OR (u.o = 'v' AND u.b = t.y AND (u.a = t.x OR u.a = t.x + t.w))))
SELECT g AS group_id, piece AS piece_id, CAST(count(*) AS DOUBLE) AS length_m FROM own GROUP BY 1, 2"""))
def boundary_owner(spark, sf):
    boundary, _ = D.shared_edge_match(tiles(spark, sf), cell_m=2.0)
    return rounded(D.boundary_owner(boundary).select("group_id", "piece_id", "length_m"), "length_m")


# --- declarations -----------------------------------------------------------

def view_declarations(spark, sf):
    """One view per order: exact frames, some skewed, scaled, mirrored or badly reflected."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    reflected = k % 5 == 4
    kind = F.when(k % 5 == 0, "section").when(k % 5 == 1, "plan").when(reflected | (k % 50 == 2), "reflected_ceiling").otherwise("elevation")
    up = F.when(c % 13 == 0, vec(0, 2, 0)).when(c % 17 == 0, vec(0.6, 0.8, 0)).otherwise(vec(0, 1, 0))
    right = F.when(reflected, F.when(c % 7 == 0, vec(-1, 0, 0)).otherwise(vec(1, 0, 0))).otherwise(F.when(c % 7 == 0, vec(1, 0, 0)).otherwise(vec(-1, 0, 0)))
    return W.table(spark, sf, "orders").select(
        k.alias("view_id"), kind.alias("kind"), reflected.alias("reflected"), right.alias("right_frame"), up.alias("up_frame"), vec(0, 0, 1).alias("view_direction_frame"),
        F.struct((c % 3).cast("int").alias("axis"), (c % 10).cast("double").alias("value_m"), F.lit(True).alias("keep_below")).alias("cut"))


@query("""WITH v AS (SELECT o_orderkey AS view_id, o_orderkey % 5 = 4 AS refl, o_custkey % 13 = 0 AS long, o_custkey % 13 <> 0 AND o_custkey % 17 = 0 AS skew, o_custkey % 7 = 0 AS mirrored, o_orderkey % 50 = 2 AS undeclared FROM orders)
SELECT 'frame_not_unit' AS rule, CAST(view_id AS VARCHAR) AS entity_id FROM v WHERE long
UNION ALL SELECT 'frame_not_orthogonal', CAST(view_id AS VARCHAR) FROM v WHERE skew
UNION ALL SELECT 'right_not_cross', CAST(view_id AS VARCHAR) FROM v WHERE long OR skew OR mirrored
UNION ALL SELECT 'reflection_undeclared', CAST(view_id AS VARCHAR) FROM v WHERE undeclared""")
def check_view_frame(spark, sf):
    return D.check_view_frame(view_declarations(spark, sf)).select("rule", "entity_id")


def _marks(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    point = lambda x, y: F.array(F.lit(float(x)) if not hasattr(x, "cast") else x.cast("double"), y.cast("double") if hasattr(y, "cast") else F.lit(float(y)))
    return W.table(spark, sf, "orders").select(
        k.alias("mark_id"), (k - k % 4).alias("section_id"), (c % 3).cast("int").alias("axis"), F.when(k % 9 == 0, -1.0).otherwise((c % 10).cast("double")).alias("value_m"),
        point(1, 1).alias("arrow_from"), point(2 + k % 2, 1 + c % 2).alias("arrow_to"))


def _sections(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    vec = lambda *v: F.array(*[F.lit(float(x)) for x in v])
    return W.table(spark, sf, "orders").select(
        k.alias("view_id"), F.when(k % 8 == 0, "section").otherwise("plan").alias("kind"), vec(1, 0, 0).alias("view_direction_frame"),
        F.struct((c % 3).cast("int").alias("axis"), (c % 10).cast("double").alias("value_m"), F.lit(True).alias("keep_below")).alias("cut"))


@query("""WITH m AS (SELECT m.o_orderkey AS id, m.o_orderkey - m.o_orderkey % 4 AS sec, m.o_custkey AS c, s.o_custkey AS sc, m.o_orderkey % 9 = 0 AS moved, (m.o_orderkey - m.o_orderkey % 4) % 8 = 0 AS found FROM orders m LEFT JOIN orders s ON s.o_orderkey = m.o_orderkey - m.o_orderkey % 4)
SELECT 'section_not_found' AS rule, CAST(id AS VARCHAR) AS entity_id, CAST(sec AS VARCHAR) AS detail FROM m WHERE NOT found
UNION ALL SELECT 'cut_differs', CAST(id AS VARCHAR), CAST(sec AS VARCHAR) FROM m WHERE found AND (c % 3 <> sc % 3 OR c % 10 <> sc % 10 OR moved)
UNION ALL SELECT 'not_plan_axis', CAST(id AS VARCHAR), '2' FROM m WHERE found AND c % 3 = 2
UNION ALL SELECT 'arrow_direction', CAST(id AS VARCHAR), CAST(sec AS VARCHAR) FROM m WHERE found AND c % 2 = 1""")
def check_section_mark(spark, sf):
    return D.check_section_marks(_marks(spark, sf), _sections(spark, sf))


@query("SELECT o_orderkey AS mark_id, o_orderkey - o_orderkey % 4 AS section_id, CAST((o_orderkey - o_orderkey % 4) % 8 = 0 AS BIGINT) AS matches FROM orders")
def section_mark_join(spark, sf):
    return D.section_mark_join(_marks(spark, sf), _sections(spark, sf)).select("mark_id", "section_id", "matches")
