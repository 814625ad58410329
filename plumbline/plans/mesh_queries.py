"""Registered queries: mesh topology, overlaps, exported models."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.joins import by_shuffle
from plumbline.operators import mesh as M
from plumbline.plans import views as W
from plumbline.plans.pixel_queries import rounded
from plumbline.plans.registry import query
from plumbline.plans.views import with_views

# --- lattice faces: shared edges --------------------------------------------

W.SQL["faces"] = """SELECT o_custkey % 20 AS object_id, o_orderkey AS face, CASE WHEN o_orderkey % 3 = 0
 THEN [v, v + 1, v + 1001, v + 1000] ELSE [v, v + 1000, v + 1001, v + 1] END AS vertices
 FROM (SELECT *, (o_orderkey % 97) * 1000 + (o_orderkey * 7) % 89 AS v FROM orders)"""
W.SQL["uses"] = """SELECT object_id, least(a, b) AS low, greatest(a, b) AS high, count(*) AS uses, count(*) FILTER (WHERE a < b) AS forward
 FROM (SELECT object_id, unnest(vertices) AS a, unnest(list_concat(vertices[2:], [vertices[1]])) AS b FROM faces) GROUP BY 1, 2, 3"""


def lattice_faces(spark, sf):
    """Unit squares of one lattice, some reversed, so edges are shared, repeated or opposed."""
    v = (F.col("o_orderkey") % 97) * 1000 + (F.col("o_orderkey") * 7) % 89
    return W.table(spark, sf, "orders").select(
        (F.col("o_custkey") % 20).alias("object_id"), F.col("o_orderkey").alias("face"),
        F.when(F.col("o_orderkey") % 3 == 0, F.array(v, v + 1, v + 1001, v + 1000)).otherwise(F.array(v, v + 1000, v + 1001, v + 1)).alias("vertices"))


@query(with_views("faces uses", "SELECT * FROM uses WHERE uses > 2 OR (uses = 2 AND forward <> 1)"))
def edge_use_audit(spark, sf):
    return M.edge_use_audit(lattice_faces(spark, sf))


@query(with_views("faces", """SELECT object_id, face, i - 1 AS pos, vertices[i] AS a, vertices[i % 4 + 1] AS b FROM faces, (SELECT unnest([1, 2, 3, 4]) AS i)"""))
def ring_edges(spark, sf):
    return M.ring_edges(lattice_faces(spark, sf))


# --- boxes: closed meshes ---------------------------------------------------

# fixed values: the twelve triangles of a box whose corners are numbered by x + 2y + 4z
BOX_TRIANGLES = ((0, 2, 3), (0, 3, 1), (4, 5, 7), (4, 7, 6), (0, 1, 5), (0, 5, 4), (2, 6, 7), (2, 7, 3), (0, 4, 6), (0, 6, 2), (1, 3, 7), (1, 7, 5))


def boxes(spark, sf):
    """One box per part; every third inside out, every seventh open, some not finite."""
    k = F.col("p_partkey")
    part = W.table(spark, sf, "part").select(
        k.alias("object_id"), (k % 50).alias("x0"), (k % 31).alias("y0"), (k % 3 + 1).alias("w"), (k % 5 + 1).alias("h"), F.col("p_size").alias("d"))
    corner = part.withColumn("vertex", F.explode(F.array(*map(F.lit, range(8)))))
    bit = lambda i: F.shiftright("vertex", i).bitwiseAND(F.lit(1))
    x = (F.col("x0") + bit(0) * F.col("w")).cast("double")
    vertices = corner.select("object_id", "vertex", F.when((F.col("object_id") % 41 == 0) & (F.col("vertex") == 3), F.lit(float("nan"))).otherwise(x).alias("x"),
                             (F.col("y0") + bit(1) * F.col("h")).cast("double").alias("y"), (bit(2) * F.col("d")).cast("double").alias("z"))
    listed = F.array(*[F.array(*map(F.lit, t)) for t in BOX_TRIANGLES])
    tri = part.select("object_id", F.posexplode(listed).alias("triangle", "t")).where("object_id % 7 <> 0 OR triangle < 11")
    turned = F.when(F.col("object_id") % 3 == 0, F.reverse("t")).otherwise(F.col("t"))
    triangles = tri.select("object_id", F.col("triangle").alias("face"), "triangle", turned.alias("vertices"))
    return vertices, triangles


@query("SELECT p_partkey AS object_id FROM part WHERE p_partkey % 41 = 0")
def nonfinite_mesh(spark, sf):
    return M.nonfinite_mesh(boxes(spark, sf)[0])


@query("""SELECT p_partkey AS object_id, CASE WHEN p_partkey % 41 <> 0 THEN round(CASE WHEN p_partkey % 3 = 0 THEN -1 ELSE 1 END * (p_partkey % 5 + 1) * p_size
 * ((p_partkey % 3 + 1) - CASE WHEN p_partkey % 7 = 0 THEN (p_partkey % 50 + p_partkey % 3 + 1) / 6.0 ELSE 0 END), 6) END AS volume FROM part""")
def signed_volume(spark, sf):
    """Closed boxes, open ones (their sum lacks one triangle), and NULL for those that are not finite."""
    vertices, triangles = boxes(spark, sf)
    volumes = rounded(M.signed_volume(triangles, vertices), "volume")
    return volumes.withColumn("volume", F.when(~F.isnan("volume"), F.col("volume")))


@query("SELECT p_partkey AS object_id FROM part WHERE p_partkey % 3 = 0 AND p_partkey % 7 <> 0 AND p_partkey % 41 <> 0")
def inverted_closed_mesh(spark, sf):
    vertices, triangles = boxes(spark, sf)
    broken = M.nonfinite_mesh(vertices)
    drop = lambda df: df.join(by_shuffle(broken), "object_id", "left_anti")
    faces = triangles.select("object_id", "face", "vertices")
    return M.inverted_closed_mesh(drop(faces), drop(triangles), drop(vertices)).select("object_id")


# --- rectangles on parallel planes: overlaps --------------------------------

W.SQL["rects"] = """SELECT o_orderkey AS object_id, o_custkey % 12 AS plane, o_orderkey % 97 AS x0, (o_orderkey * 7) % 89 AS y0,
 o_orderkey % 97 + o_custkey % 4 AS x1, (o_orderkey * 7) % 89 + 1 + o_orderkey % 2 AS y1, o_orderkey % 3 = 0 AS flipped, o_orderkey % 5 AS scene FROM orders"""


def rectangles(spark, sf):
    """Integer rectangles on twelve planes of five scenes in the same coordinates; a quarter has no width."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rect = W.table(spark, sf, "orders").select(
        (k % 5).alias("scene"), k.alias("object_id"), (c % 12).alias("plane"), (k % 97).alias("x0"), ((k * 7) % 89).alias("y0"), (c % 4).alias("w"), (1 + k % 2).alias("h"))
    at = lambda i, x, y: F.struct(F.lit(i).alias("vertex"), x.cast("double").alias("x"), y.cast("double").alias("y"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    corners = F.array(at(0, x0, y0), at(1, x1, y0), at(2, x1, y1), at(3, x0, y1))
    vertices = rect.select("scene", "object_id", F.explode(corners).alias("c"), F.col("plane").cast("double").alias("z")).select("scene", "object_id", "c.*", "z")
    flipped = F.col("object_id") % 3 == 0
    ring = F.when(flipped, F.array(*map(F.lit, (3, 2, 1, 0)))).otherwise(F.array(*map(F.lit, (0, 1, 2, 3))))
    faces = rect.select("object_id", F.lit(0).alias("face"), ring.alias("vertices"))
    pair = lambda *t: F.array(*[F.array(*map(F.lit, x)) for x in t])
    tri = F.when(flipped, pair((3, 2, 1), (3, 1, 0))).otherwise(pair((0, 1, 2), (0, 2, 3)))
    triangles = rect.select("scene", "object_id", F.lit(0).alias("face"), F.posexplode(tri).alias("triangle", "vertices"))
    return vertices, faces, triangles


_OVERLAP = """, o AS (SELECT a.object_id AS object_a, b.object_id AS object_b, a.flipped <> b.flipped AS opposed,
 (least(a.x1, b.x1) - greatest(a.x0, b.x0)) * (least(a.y1, b.y1) - greatest(a.y0, b.y0)) AS area
 FROM rects a JOIN rects b ON a.scene = b.scene AND a.plane = b.plane AND a.object_id < b.object_id AND a.x0 < b.x1 AND b.x0 < a.x1 AND a.y0 < b.y1 AND b.y0 < a.y1
 WHERE a.x1 > a.x0 AND b.x1 > b.x0) """


@query(with_views("rects", _OVERLAP + "SELECT object_a, CAST(0 AS INTEGER) AS face_a, object_b, CAST(0 AS INTEGER) AS face_b, opposed, CAST(area AS DOUBLE) AS area_m2 FROM o"))
def coplanar_overlap_area(spark, sf):
    vertices, _, triangles = rectangles(spark, sf)
    return rounded(M.coplanar_overlap_area(triangles, vertices, cell_m=4.0, scene=["scene"]), "area_m2").drop("scene")


@query(with_views("rects", """SELECT p.object_id AS p_object_id, q.object_id AS q_object_id FROM rects p JOIN rects q ON p.scene = q.scene AND p.plane = q.plane AND p.object_id <> q.object_id
 AND (p.x0 < q.x0 OR (p.x0 = q.x0 AND p.object_id < q.object_id)) AND p.x0 <= q.x1 AND q.x0 <= p.x1 AND p.y0 <= q.y1 AND q.y0 <= p.y1 WHERE p.x1 > p.x0 AND q.x1 > q.x0"""))
def coplanar_overlap_pairs(spark, sf):
    """Touching rectangle pairs: the screening step before clipping. An object has one face, so pairs of faces are pairs of objects."""
    vertices, _, triangles = rectangles(spark, sf)
    return M.coplanar_overlap_pairs(triangles, vertices, cell_m=4.0, scene=["scene"]).select("p_object_id", "q_object_id")


@query(with_views("rects", _OVERLAP + "SELECT object_a, object_b, CAST(area AS DOUBLE) AS area_m2 FROM o WHERE NOT opposed"))
def sorted_overlaps(spark, sf):
    vertices, _, triangles = rectangles(spark, sf)
    return rounded(M.sorted_overlaps(triangles, vertices, cell_m=4.0, scene=["scene"]), "area_m2").select("object_a", "object_b", "area_m2")


@query(with_views("rects", "SELECT object_id, CAST(0 AS INTEGER) AS face FROM rects WHERE x1 = x0"))
def degenerate_faces(spark, sf):
    vertices, faces, _ = rectangles(spark, sf)
    return M.degenerate_faces(faces, vertices)


@query(with_views("rects", _OVERLAP + """SELECT 'degenerate_face' AS rule, CAST(object_id AS VARCHAR) || '/0' AS entity_id FROM rects WHERE x1 = x0
 UNION ALL SELECT 'coplanar_overlap', CAST(object_a AS VARCHAR) || '/0/' || CAST(object_b AS VARCHAR) || '/0' FROM o WHERE NOT opposed"""))
def review_meshes(spark, sf):
    found, _ = M.review_meshes(*rectangles(spark, sf), cell_m=4.0, scene=["scene"])
    return found.select("rule", "entity_id")


# --- exported models --------------------------------------------------------

W.SQL["ev_vertices"] = """SELECT l_suppkey AS object_id, l_orderkey % 50 AS x, l_partkey % 40 AS y, l_linenumber AS z, l_quantity AS q FROM lineitem"""


@query("""WITH v AS (SELECT DISTINCT l_suppkey AS object_id, l_orderkey % 50 AS x, l_partkey % 40 AS y, l_linenumber AS z FROM lineitem),
m AS (SELECT *, x = 0 AND y = 0 AS moved, x = 7 AND y = 3 AS dropped FROM v)
SELECT object_id, CASE WHEN count(*) FILTER (WHERE NOT moved AND NOT dropped) = 0 THEN NULL WHEN bool_or(z = 3 AND NOT moved AND NOT dropped) THEN 0.00001 ELSE 0 END AS max_vertex_error_m,
 count(*) FILTER (WHERE moved OR dropped) AS native_unmatched, count(*) FILTER (WHERE moved AND NOT dropped) AS exported_unmatched FROM m GROUP BY object_id""")
def nearest_vertex_match(spark, sf):
    """Exported copies: some shifted within tolerance, some far away, some lost."""
    v = W.table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("object_id"), (F.col("l_orderkey") % 50).cast("double").alias("x"), (F.col("l_partkey") % 40).cast("double").alias("y"),
        F.col("l_linenumber").cast("double").alias("z"))
    shift = F.when((F.col("x") == 0) & (F.col("y") == 0), 0.25).when(F.col("z") == 3, 1e-5).otherwise(0.0)
    exported = v.where("NOT (x = 7 AND y = 3)").withColumn("x", F.col("x") + shift)
    return rounded(M.nearest_vertex_match(v, exported), "max_vertex_error_m", places=9)


@query("""WITH t AS (SELECT o_orderkey AS object_id, o_custkey % 7 AS i, o_custkey % 5 AS j, o_orderkey % 4 AS k FROM orders),
c AS (SELECT object_id, list_min([[i, j, k], [j, k, i], [k, i, j]]) AS e, CASE WHEN object_id % 9 = 0 THEN list_min([[i, k, j], [k, j, i], [j, i, k]]) ELSE list_min([[i, j, k], [j, k, i], [k, i, j]]) END AS a FROM t),
u AS (SELECT object_id, e AS tri, 1 AS e, 0 AS a FROM c UNION ALL SELECT object_id, a, 0, 1 FROM c)
SELECT object_id, tri[1] AS i, tri[2] AS j, tri[3] AS k, CAST(sum(e) AS BIGINT) AS expected, CAST(sum(a) AS BIGINT) AS actual FROM u GROUP BY object_id, tri HAVING sum(e) <> sum(a)""")
def triangle_multiset_equal(spark, sf):
    """The second copy is rotated; every ninth triangle is also turned over."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    t = W.table(spark, sf, "orders").select(k.alias("object_id"), (c % 7).alias("i"), (c % 5).alias("j"), (k % 4).alias("k"))
    turned = F.col("object_id") % 9 == 0
    actual = t.select("object_id", F.when(turned, F.col("k")).otherwise(F.col("j")).alias("i"), F.when(turned, F.col("j")).otherwise(F.col("k")).alias("j"), F.col("i").alias("k"))
    return M.triangle_multiset_equal(t, actual)


@query("""WITH d AS (SELECT p_partkey AS id, p_brand AS room, p_type AS level, p_size AS role FROM part WHERE p_partkey % 11 <> 0),
e AS (SELECT p_partkey AS id, p_brand AS room, CASE WHEN p_partkey % 13 = 0 THEN 'X' ELSE p_type END AS level, p_size + p_partkey % 17 // 16 AS role FROM part WHERE p_partkey % 19 <> 0)
SELECT id AS object_id, 'unknown' AS kind FROM e WHERE id NOT IN (SELECT id FROM d) UNION ALL SELECT id, 'missing' FROM d WHERE id NOT IN (SELECT id FROM e)
UNION ALL SELECT d.id, 'level_differs' FROM d JOIN e USING (id) WHERE d.level <> e.level UNION ALL SELECT d.id, 'role_differs' FROM d JOIN e USING (id) WHERE d.role <> e.role
UNION ALL SELECT id, 'duplicate' FROM e WHERE id % 100 = 0""")
def exported_identity_check(spark, sf):
    part = W.table(spark, sf, "part")
    k = F.col("p_partkey")
    declared = part.where("p_partkey % 11 <> 0").select(k.alias("object_id"), F.col("p_brand").alias("room"), F.col("p_type").alias("level"), F.col("p_size").cast("long").alias("role"))
    exported = part.where("p_partkey % 19 <> 0").select(
        k.alias("object_id"), F.col("p_brand").alias("room"), F.when(k % 13 == 0, "X").otherwise(F.col("p_type")).alias("level"),
        (F.col("p_size") + F.floor(k % 17 / 16)).alias("role"))
    exported = exported.unionByName(exported.where("object_id % 100 = 0"))
    return M.exported_identity_check(exported, declared)


@query("""SELECT o_orderkey AS surface_id, CASE WHEN o_custkey % 30 >= 25 OR o_custkey % 30 = 7 OR o_custkey % 30 % 5 = 3 AND o_custkey % 30 > 20 THEN 'unbound'
 WHEN o_orderkey % 6 = 0 THEN 'wrong_image' WHEN o_orderkey % 10 = 1 THEN 'no_texture_coordinates' END AS kind FROM orders
WHERE o_custkey % 30 >= 25 OR o_custkey % 30 = 7 OR o_custkey % 30 % 5 = 3 AND o_custkey % 30 > 20 OR o_orderkey % 6 = 0 OR o_orderkey % 10 = 1""")
def texture_binding_check(spark, sf):
    """Orders as surfaces, nations as materials and textures, regions as images."""
    nation, region = W.table(spark, sf, "nation"), W.table(spark, sf, "region")
    n = F.col("n_nationkey").cast("long")
    materials = nation.where("n_nationkey <> 7").select(n.alias("material_id"), n.alias("texture_id"))
    textures = nation.select(n.alias("texture_id"), F.when(~((n % 5 == 3) & (n > 20)), F.col("n_regionkey")).alias("image_id"))
    images = region.select(F.col("r_regionkey").alias("image_id"), F.lit("atlas").alias("sha256"))
    k = F.col("o_orderkey")
    surfaces = W.table(spark, sf, "orders").select(
        k.alias("surface_id"), (F.col("o_custkey") % 30).alias("material_id"), F.when(k % 6 == 0, "other").otherwise("atlas").alias("expected_sha256"), (k % 10 != 1).alias("has_uv"))
    return M.texture_binding_check(surfaces, materials, textures, images)


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_linenumber = 6 THEN 'missing' WHEN l_partkey % 10 = 0 THEN 'material_differs' ELSE 'uv_differs' END AS kind
FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem) WHERE l_linenumber = 6 OR l_partkey % 10 = 0 OR l_suppkey % 9 = 0""")
def material_readback_check(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    base = W.table(spark, sf, "lineitem").groupBy(*keys).agg(F.min("l_discount").alias("u"), F.max("l_tax").alias("v"))
    assigned = base.withColumn("material", F.lit("brick"))
    saved = assigned.where("l_linenumber <> 6").withColumns({
        "material": F.when(F.col("l_partkey") % 10 == 0, "plaster").otherwise("brick"),
        "u": F.col("u") + F.when(F.col("l_suppkey") % 9 == 0, 1e-3).otherwise(1e-8)})
    return M.material_readback_check(assigned, saved, keys)


@query("""SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 8) AS x, round(CAST(embedding[3] AS DOUBLE), 8) AS y, round(-CAST(embedding[2] AS DOUBLE), 8) AS z FROM embeddings""")
def axes_to_web(spark, sf):
    e = lambda i: F.element_at("embedding", i).cast("double")
    points = W.table(spark, sf, "embeddings").select("vec_id", e(1).alias("x"), e(2).alias("y"), e(3).alias("z"))
    return rounded(M.axes_to_web(points), "x", "y", "z", places=8)
