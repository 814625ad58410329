"""Mesh topology and overlap audits over vertex, face and triangle tables.

``vertices(object_id, vertex, x, y, z)``, ``faces(object_id, face, vertices)`` and
``triangles(object_id, face, triangle, vertices)``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from plumbline.functions import grid, vectors as V
from plumbline.functions.joins import by_shuffle, measured
from plumbline.session import cut_lineage, spread_out

TOLERANCE = 1e-5
OPPOSED = -0.99999  # fixed value: outward normals this opposite are a contact, not an overlap


def nonfinite_mesh(vertices: DataFrame) -> DataFrame:
    """Objects with a NULL, NaN or infinite coordinate; other checks leave them out."""
    bad = ~(V.finite(F.col("x")) & V.finite(F.col("y")) & V.finite(F.col("z")))
    return vertices.groupBy("object_id").agg(F.bool_or(bad).alias("__bad")).where("__bad").select("object_id")


def ring_edges(faces: DataFrame) -> DataFrame:
    """Directed edges ``(object_id, face, pos, a, b)`` of every face, closing the ring."""
    exploded = faces.select("object_id", "face", F.col("vertices"), F.posexplode("vertices").alias("pos", "a"))
    following = F.get("vertices", (F.col("pos") + 1) % F.size("vertices"))
    return exploded.select("object_id", "face", "pos", "a", following.alias("b"))


def edge_uses(faces: DataFrame) -> DataFrame:
    """Use counts per undirected edge and how many run forward."""
    return ring_edges(faces).groupBy("object_id", F.least("a", "b").alias("low"), F.greatest("a", "b").alias("high")).agg(
        F.count("*").alias("uses"), F.count_if(F.col("a") < F.col("b")).alias("forward"))


def edge_use_audit(faces: DataFrame) -> DataFrame:
    """Edges used more than twice, or twice in the same direction."""
    wrong = (F.col("uses") > 2) | ((F.col("uses") == 2) & (F.col("forward") != 1))
    return edge_uses(faces).where(wrong)


def face_polygons(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their coordinates as ``polygon array<array<double>>`` in ring order."""
    corners = faces.select("object_id", "face", F.posexplode("vertices").alias("pos", "vertex"))
    placed = corners.join(by_shuffle(vertices), ["object_id", "vertex"])
    ring = F.array_sort(F.collect_list(F.struct("pos", F.array("x", "y", "z").alias("p"))))
    return placed.groupBy("object_id", "face").agg(F.transform(ring, lambda e: e["p"]).alias("polygon"))


def degenerate_faces(faces: DataFrame, vertices: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Faces whose area vector is no longer than ``tolerance`` squared."""
    sized = face_polygons(faces, vertices).select(
        "object_id", "face", V.let(V.fan_normal(F.col("polygon")), lambda n: V.norm(V.items(n))).alias("length"))
    return sized.where(F.col("length") <= tolerance**2).select("object_id", "face")


def triangle_points(triangles: DataFrame, vertices: DataFrame, scene: Sequence[str] = ()) -> DataFrame:
    """Triangles with corner coordinates ``ax..cz``; one join, one aggregation."""
    corners = triangles.select(*scene, "object_id", "face", "triangle", F.posexplode("vertices").alias("pos", "vertex"))
    placed = corners.join(by_shuffle(vertices), [*scene, "object_id", "vertex"])
    return placed.groupBy(*scene, "object_id", "face", "triangle").agg(*[
        F.max(F.when(F.col("pos") == i, F.col(c))).alias(f"{p}{c}") for i, p in enumerate("abc") for c in "xyz"])


def _corner(p: str) -> tuple[Column, ...]:
    return V.cols(*[f"{p}{c}" for c in "xyz"])


def signed_volume(triangles: DataFrame, vertices: DataFrame) -> DataFrame:
    """Signed volume per object; positive when faces point outwards."""
    part = V.dot(_corner("a"), V.cross(_corner("b"), _corner("c"))) / 6
    return triangle_points(triangles, vertices).groupBy("object_id").agg(F.sum(part).alias("volume"))


def inverted_closed_mesh(faces: DataFrame, triangles: DataFrame, vertices: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """Closed objects (every edge used exactly twice) with negative volume."""
    closed = edge_uses(faces).groupBy("object_id").agg(F.bool_and(F.col("uses") == 2).alias("__closed")).where("__closed")
    volumes = signed_volume(triangles, vertices).where(F.col("volume") < -(tolerance**3))
    return volumes.join(by_shuffle(closed.select("object_id")), "object_id", "left_semi")


CORNERS = [f"{p}{k}" for p in "abc" for k in "xyz"]


TILE_BITS = 8
TILE = 1 << TILE_BITS  # shapes next to each other whose faces are written out together
PIECE = 1024  # copies of one face that are written out together


def face_shapes(triangles: DataFrame, vertices: DataFrame, tolerance: float = TOLERANCE, scene: Sequence[str] = (), cell_m: float = 1.0) -> DataFrame:
    """Distinct faces of each scene, stored: ``shape`` (triangles that have an area), ``objects`` and ``faces`` (those that are exact copies) and a ``shape_id``.

    Numbers follow scene, plane and place, so shapes whose numbers differ in the last bits only (``TILE``) lie next to each other.
    The list of copies is as bounded as the result: m copies of one face overlap in m * (m - 1) / 2 pairs.
    """
    points = triangle_points(triangles, vertices, scene)
    a, b, c = _corner("a"), _corner("b"), _corner("c")
    points = points.where(V.norm(V.cross(V.sub(b, a), V.sub(c, a))) > tolerance**2)
    faces = points.groupBy(*scene, "object_id", "face").agg(F.sort_array(F.collect_list(F.struct(*CORNERS))).alias("shape"))
    shapes = faces.groupBy(*scene, "shape").agg(F.collect_list(F.struct("object_id", "face")).alias("__m"))
    shapes = shapes.select(*scene, "shape", F.col("__m.object_id").alias("objects"), F.col("__m.face").alias("faces"))
    # the plane and place of the first triangle, step by step: merged into one expression they are more code than Java takes
    a, b, c = ([F.col("__t")[f"{p}{k}"] for k in "xyz"] for p in "abc")
    placed = V.once(V.once(shapes, {"__t": F.col("shape")[0]}), {f"__n{k}": x for k, x in zip("xyz", V.cross(V.sub(b, a), V.sub(c, a)))})
    n = V.cols("__nx", "__ny", "__nz")
    side = F.signum(F.coalesce(*[F.when(F.abs(x) == F.greatest(*[F.abs(y) for y in n]), x) for x in n])) / V.norm(n)
    placed = V.once(placed, {"__side": side})
    near = {f"__k{k}": F.bround(x * F.col("__side"), 2) for k, x in zip("xyz", n)}
    near["__off"] = F.floor(V.dot(a, n) * F.col("__side") / 0.1)
    near |= {f"__i{k}": grid.cell_of(x, cell_m) for k, x in zip("xyz", a)}
    ordered = V.once(placed, near).repartitionByRange(*scene, *near).sortWithinPartitions(*scene, *near)
    ordered = ordered.select(*scene, "shape", "objects", "faces", F.monotonically_increasing_id().alias("shape_id"))
    return spread_out(cut_lineage(ordered))


def meeting_triangles(shapes: DataFrame, tolerance: float = TOLERANCE, cell_m: float = 1.0, scene: Sequence[str] = (),
                      offset_m: float = 0.01, with_area: bool = False) -> DataFrame:
    """Triangle pairs of ``face_shapes`` that share a plane and whose boxes touch, ``p`` before ``q`` in an x sweep.
    ``with_area`` leaves out most that only touch: pairs whose boxes share too little for an area above ``tolerance`` squared.

    A shape meets itself if it has copies; such a pair of two triangles is returned once and stands for both ways.
    Triangles meet only inside the same scene, rounded normal, bin of the plane's offset along that normal, and grid cell; the pair is kept
    by the one bin and cell that own it.  ``cell_m`` should be near the triangle size.

    Offsets are taken along the rounded normal, which both triangles share; it is off by 1e-4 at most, so a triangle's
    offsets are widened by that share of its own size and no pair is lost between bins.
    """
    points = shapes.select(*scene, "shape_id", (F.size("objects") > 1).alias("copied"), F.posexplode("shape").alias("triangle", "__t"))
    points = points.select(*scene, "shape_id", "copied", "triangle", "__t.*")
    a, b, c = _corner("a"), _corner("b"), _corner("c")
    n = V.cross(V.sub(b, a), V.sub(c, a))
    sized = points.withColumns({f"__n{k}": e for k, e in zip("xyz", n)}).withColumn("__len", V.norm(V.cols("__nx", "__ny", "__nz")))
    unit = [V.over(F.col(f"__n{k}"), F.col("__len")) for k in "xyz"]
    size = [F.abs(u) for u in unit]
    leading = F.when((size[0] >= size[1]) & (size[0] >= size[2]), unit[0]).when(size[1] >= size[2], unit[1]).otherwise(unit[2])
    sized = sized.withColumn("outward", F.when(leading < 0, -1).otherwise(1))
    sized = sized.withColumns({f"n{k}": u * F.col("outward") for k, u in zip("xyz", unit)})
    rows = sized.select(
        *scene, "shape_id", "copied", "triangle", "outward", "nx", "ny", "nz", *CORNERS,
        *[F.bround(F.col(f"n{k}") * 10_000).cast("long").alias(f"__k{k}") for k in "xyz"],
        *[F.least(*[F.col(f"{p}{k}") for p in "abc"]).alias(f"lo{k}") for k in "xyz"],
        *[F.greatest(*[F.col(f"{p}{k}") for p in "abc"]).alias(f"hi{k}") for k in "xyz"])
    along = [sum((F.col(f"__k{k}") / 10_000 * F.col(f"{p}{k}") for k in "yz"), F.col("__kx") / 10_000 * F.col(f"{p}x")) for p in "abc"]
    pad = tolerance + 1e-4 * V.norm([F.col(f"hi{k}") - F.col(f"lo{k}") for k in "xyz"])
    rows = rows.withColumns({"loo": F.least(*along) - pad, "hio": F.greatest(*along) + pad})
    # what a box must share with this one along an axis for an area above tolerance squared: the shared piece of plane is as long as the shared
    # stretch, drawn out by the plane's slope, and no wider than this box is long; the other triangle may lie ``tolerance`` off the plane
    across = V.norm([F.col(f"hi{k}") - F.col(f"lo{k}") for k in "xyz"])
    slope = {k: F.sqrt(F.greatest(1 - F.col(f"n{k}") * F.col(f"n{k}"), F.lit(0.0))) for k in "xyz"}
    rows = rows.withColumns({f"need{k}": tolerance**2 * slope[k] / across - 2 * tolerance * F.abs(F.col(f"n{k}")) for k in "xyz"})
    # none is null; saying so halves the code of the join, and a longer method than Java compiles takes ten times as long
    rows = rows.withColumns({x: F.coalesce(x, F.lit(0).cast(t)) for x, t in rows.dtypes if t in ("double", "bigint", "int") and x not in scene})
    rows = spread_out(cut_lineage(rows))  # both sides of the self-join read these rows, not their derivation
    lows, highs = [F.col(f"lo{k}") - tolerance for k in "xyz"], [F.col(f"hi{k}") + tolerance for k in "xyz"]
    celled = grid.cover(rows, lows, highs, cell_m, ["__ix", "__iy", "__iz"])
    celled = grid.cover(celled, [F.col("loo")], [F.col("hio")], offset_m, ["__io"], grid.ORIGIN)
    keys = ["__kx", "__ky", "__kz", "__io", "__ix", "__iy", "__iz"]
    # a bit per axis where the box begins in this cell: of two boxes that share a cell, one begins there on every axis of the owner cell
    begins = [grid.cell_of(low, cell_m) == F.col(f"__i{k}") for k, low in zip("xyz", lows)]
    begins.append(grid.cell_of(F.col("loo"), offset_m, grid.ORIGIN) == F.col("__io"))
    celled = celled.withColumn("begins", sum((F.when(e, 1 << i).otherwise(0) for i, e in enumerate(begins)), F.lit(0)))
    own = ["shape_id", "copied", "triangle", "outward", "begins", *[f"{e}{k}" for e in ("lo", "hi", "need", "n") for k in "xyz"], *CORNERS]
    first = celled.select(*scene, *keys, *[F.col(x).alias(f"p_{x}") for x in own])
    second = celled.select(*scene, *keys, *[F.col(x).alias(f"q_{x}") for x in own])
    met = first.join(second, [*scene, *keys])
    for k in "xyz":
        met = met.where((F.col(f"p_hi{k}") >= F.col(f"q_lo{k}") - tolerance) & (F.col(f"q_hi{k}") >= F.col(f"p_lo{k}") - tolerance))
    met = met.where(F.col("p_begins").bitwiseOR(F.col("q_begins")) == 15)
    # q is the later of the two in an x sweep: its plane and basis are used
    same, level = F.col("p_shape_id") == F.col("q_shape_id"), F.col("p_lox") == F.col("q_lox")
    tie = (F.col("p_shape_id") < F.col("q_shape_id")) | (same & (F.col("p_triangle") <= F.col("q_triangle")))
    met = met.where((F.col("p_lox") < F.col("q_lox")) | (level & tie)).where(~same | F.col("p_copied"))
    normal, origin = V.cols("q_nx", "q_ny", "q_nz"), V.cols("q_ax", "q_ay", "q_az")
    for x in "abc":
        met = met.where(F.abs(V.dot(V.sub(V.cols(*[f"p_{x}{k}" for k in "xyz"]), origin), normal)) <= tolerance)
    if with_area:
        for k in "xyz":
            met = met.where(F.least(f"p_hi{k}", f"q_hi{k}") - F.greatest(f"p_lo{k}", f"q_lo{k}") > F.col(f"q_need{k}"))
    return met


def _lists(wanted: DataFrame, shapes: DataFrame, tile: str, side: str, scene: Sequence[str]) -> DataFrame:
    """For each pair of tiles the faces of the wanted shapes (``low_tile, high_tile, at``), as an array by place in the tile (``side``); long lists in pieces of ``PIECE``."""
    cut = F.transform(F.sequence(F.lit(0), F.floor((F.size("objects") - 1) / PIECE).cast("int")), lambda i: F.struct(
        *scene, *[F.slice(x, i * PIECE + 1, F.lit(PIECE)).alias(x) for x in ("objects", "faces")]))
    pieces = shapes.select("shape_id", F.posexplode(cut).alias("piece", "own"))
    wanted = wanted.withColumn("shape_id", F.col(tile) * TILE + F.col("at"))
    # a number of parts that adaptive execution keeps: it counts the bytes of lists, not the pairs made of them
    spark = shapes.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    found = wanted.join(by_shuffle(pieces), "shape_id").repartition(parts, "low_tile", "high_tile")
    listed = found.groupBy("low_tile", "high_tile", "piece").agg(F.array_sort(F.collect_list(F.struct("at", "own"))).alias("__l"))
    before = lambda i: F.when(i > 0, F.get("__l", i - 1)["at"]).otherwise(-1)
    nothing = F.lit(None).cast(listed.schema["__l"].dataType.elementType["own"].dataType)
    filled = F.flatten(F.transform("__l", lambda e, i: F.concat(F.array_repeat(nothing, e["at"] - before(i) - 1), F.array(e["own"]))))
    return listed.select("low_tile", "high_tile", filled.alias(side))


def _tile_and_place(shape: str) -> tuple[Column, Column]:
    return F.shiftright(shape, TILE_BITS), F.col(shape).bitwiseAND(F.lit(TILE - 1)).cast("int")


def _before(first: str, second: str) -> Column:
    """Whether one face comes before another: by its object, then by its number."""
    a, b = ((F.col(f"{x}_object"), F.col(f"{x}_face")) for x in (first, second))
    return (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))


def of_members(pairs: DataFrame, shapes: DataFrame, first: str, second: str, scene: Sequence[str] = ()) -> DataFrame:
    """Pairs of shapes written out for their faces, as ``first_object``, ``first_face``, ``second_object`` and ``second_face``; nothing is shuffled after that.

    Pairs are gathered by the tiles of their shapes, so a list of faces travels once to each pair of tiles that needs it and not with every pair of shapes.
    A row holds at most ``TILE`` squared pairs of shapes and as many lists of ``PIECE`` faces as two tiles have shapes, however many copies a face has.
    """
    rest = [c for c in pairs.columns if c not in (first, second)]
    (low_tile, low), (high_tile, high) = _tile_and_place(first), _tile_and_place(second)
    tiles = pairs.groupBy(low_tile.alias("low_tile"), high_tile.alias("high_tile")).agg(F.collect_list(F.struct((low * TILE + high).alias("code"), *rest)).alias("__p"))
    tiles = cut_lineage(tiles.select("low_tile", "high_tile", F.col("__p.code").alias("codes"), *[F.col(f"__p.{c}").alias(f"__{c}s") for c in rest]))
    wanted = lambda place: tiles.select("low_tile", "high_tile", F.explode(F.array_distinct(F.transform("codes", place))).alias("at"))
    lows = _lists(wanted(lambda c: F.shiftright(c, TILE_BITS)), shapes, "low_tile", "lows", scene)
    highs = _lists(wanted(lambda c: c.bitwiseAND(F.lit(TILE - 1))), shapes, "high_tile", "highs", scene)
    met = tiles.join(by_shuffle(lows), ["low_tile", "high_tile"]).join(by_shuffle(highs), ["low_tile", "high_tile"])
    same_tile = F.col("low_tile") == F.col("high_tile")

    def of_code(code: Column, i: Column) -> Column:
        low, high = F.shiftright(code, TILE_BITS), code.bitwiseAND(F.lit(TILE - 1))
        return F.struct((same_tile & (low == high)).alias("same"), *[F.get(f"__{c}s", i).alias(c) for c in rest], F.get("lows", low).alias("a"), F.get("highs", high).alias("b"))

    # inside the generator: a row per pair must not carry the lists of both tiles
    met = met.select(F.explode(F.transform("codes", of_code)).alias("__p")).select("__p.*")
    kept = ["same", *rest, *scene]
    met = met.select("same", *rest, *[F.col(f"a.{c}").alias(c) for c in scene], "b", F.col("a.faces").alias("__f"), F.posexplode("a.objects").alias("__i", "first_object"))
    met = met.select(*kept, "first_object", F.get("__f", F.col("__i")).alias("first_face"), F.col("b.faces").alias("__f"), F.posexplode("b.objects").alias("__i", "second_object"))
    return met.select(*kept, "first_object", "first_face", "second_object", F.get("__f", F.col("__i")).alias("second_face"))


def coplanar_overlap_pairs(triangles: DataFrame, vertices: DataFrame, tolerance: float = TOLERANCE, cell_m: float = 1.0,
                           scene: Sequence[str] = (), offset_m: float = 0.01) -> DataFrame:
    """Ordered pairs of different faces with triangles that share a plane and whose boxes touch, each once.

    Face ``p`` has such a triangle before ``q``'s in an x sweep (then by object and face); where both faces have one, both orders are returned.
    Faces that are exact copies are searched once and written out at the end.
    """
    shapes = face_shapes(triangles, vertices, tolerance, scene, cell_m)
    met = meeting_triangles(shapes, tolerance, cell_m, scene, offset_m)
    p, q, ahead = F.col("p_shape_id"), F.col("q_shape_id"), F.col("p_lox") < F.col("q_lox")
    found = met.groupBy(F.least(p, q).alias("__low"), F.greatest(p, q).alias("__high")).agg(
        F.bool_or(ahead & (p <= q)).alias("__before"), F.bool_or(ahead & (p >= q)).alias("__after"), F.bool_or(~ahead).alias("__level"))
    one_way = lambda a, b, always: F.struct(F.col(a).alias("__p"), F.col(b).alias("__q"), F.col(always).alias("always"))
    there = F.when(F.col("__before") | F.col("__level"), one_way("__low", "__high", "__before"))
    back = F.when((F.col("__low") != F.col("__high")) & (F.col("__after") | F.col("__level")), one_way("__high", "__low", "__after"))
    ways = found.select(F.explode(F.array(there, back)).alias("way")).where("way IS NOT NULL").select("way.*")
    pairs = of_members(ways, shapes, "__p", "__q", scene).where(_before("first", "second") | (F.col("always") & _before("second", "first")))
    return pairs.select(*scene, *[F.col(f"{f}_{x}").alias(f"{s}_{y}") for s, f in (("p", "first"), ("q", "second")) for x, y in (("object", "object_id"), ("face", "face"))])


def clip_areas(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Overlap areas of ``n`` counterclockwise triangle pairs, all clipped at once.

    A corner outside an edge is moved onto the edge's line instead of being dropped: the ring then runs to and fro on that line,
    which encloses nothing, and every pair keeps the same number of corners.
    """
    x, y = (np.ascontiguousarray(first[:, :, k].T) for k in (0, 1))
    for edge in range(3):
        (ax, ay), (bx, by) = second[:, edge].T, second[:, (edge + 1) % 3].T
        ex, ey = bx - ax, by - ay
        here = ex * (y - ay) - ey * (x - ax)
        there, inside = np.roll(here, -1, axis=0), here >= 0
        crossing = inside != np.roll(inside, -1, axis=0)
        share = np.divide(here, here - there, out=np.zeros_like(here), where=crossing)
        out = np.minimum(here, 0) / (ex * ex + ey * ey)
        ring = []
        for old, moved in ((x, x + out * ey), (y, y - out * ex)):
            cut = np.where(crossing, old + share * (np.roll(old, -1, axis=0) - old), moved)
            ring.append(np.stack([moved, cut], axis=1).reshape(-1, old.shape[1]))
        x, y = ring
    return np.abs((x * np.roll(y, -1, axis=0) - y * np.roll(x, -1, axis=0)).sum(axis=0)) / 2


@F.arrow_udf(T.DoubleType())
def clip_area(subject: pa.Array, clip: pa.Array) -> pa.Array:
    """Overlap area of two coplanar triangles, each given as its normal and three corners, in the plane of the second."""
    p, q = (s.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 3) for s in (subject, clip))
    normal, origin = q[:, 0], q[:, 1]
    along = q[:, 2] - origin
    u = along / np.linalg.norm(along, axis=1, keepdims=True)
    axes = np.stack([u, np.cross(normal, u)], axis=2)
    p, q = ((t[:, 1:] - origin[:, None]) @ axes for t in (p, q))
    def counterclockwise(t: np.ndarray) -> np.ndarray:
        v, w = t[:, 1] - t[:, 0], t[:, 2] - t[:, 0]
        return np.where((v[:, 0] * w[:, 1] - v[:, 1] * w[:, 0] < 0)[:, None, None], t[:, ::-1], t)

    return pa.array(clip_areas(counterclockwise(q), counterclockwise(p)))


def _shape_areas(triangles: DataFrame, vertices: DataFrame, tolerance: float, cell_m: float, scene: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Overlap area per pair of shapes, ``opposed`` contacts apart from real overlaps, and the shapes."""
    shapes = face_shapes(triangles, vertices, tolerance, scene, cell_m)
    met = meeting_triangles(shapes, tolerance, cell_m, scene, with_area=True)
    p, q = F.col("p_shape_id"), F.col("q_shape_id")
    plane = lambda s: [F.col(f"{s}_{x}") for x in ("nx", "ny", "nz", *CORNERS)]
    facing = V.dot(plane("p")[:3], plane("q")[:3]) * F.col("p_outward") * F.col("q_outward")
    both_ways = F.when((p == q) & (F.col("p_triangle") != F.col("q_triangle")), 2).otherwise(1)
    areas = met.select(F.least(p, q).alias("__low"), F.greatest(p, q).alias("__high"), (facing < OPPOSED).alias("opposed"), both_ways.alias("__ways"),
                       clip_area(F.array(*plane("p")), F.array(*plane("q"))).alias("area"))
    areas = areas.where(F.col("area") > tolerance**2).groupBy("__low", "__high", "opposed").agg(F.sum(F.col("area") * F.col("__ways")).alias("area_m2"))
    return areas, shapes


def coplanar_overlap_area(triangles: DataFrame, vertices: DataFrame, tolerance: float = TOLERANCE, cell_m: float = 1.0,
                          scene: Sequence[str] = ()) -> DataFrame:
    """Overlap area per scene and face pair, ``opposed`` contacts apart from real overlaps; copies are clipped once and written out at the end."""
    areas, shapes = _shape_areas(triangles, vertices, tolerance, cell_m, scene)
    out = of_members(areas, shapes, "__low", "__high", scene).withColumn("ahead", _before("first", "second")).where("ahead OR NOT same")
    pick = lambda x, low: F.when(F.col("ahead"), F.col(f"{'first' if low else 'second'}_{x}")).otherwise(F.col(f"{'second' if low else 'first'}_{x}"))
    return out.select(*scene, *[pick(x, low).alias(f"{x}_{s}") for s, low in (("a", True), ("b", False)) for x in ("object", "face")], "opposed", "area_m2")


def sorted_overlaps(triangles: DataFrame, vertices: DataFrame, tolerance: float = TOLERANCE, cell_m: float = 1.0,
                    scene: Sequence[str] = (), by: Sequence[str] = ()) -> DataFrame:
    """Overlap findings (``object_a, face_a, object_b, face_b, area_m2``) ordered by columns ``by`` of the scene and the face pair.

    What is shuffled for the order is not a row per overlap but, for each face and pair of tiles, the list of later faces that it overlaps;
    lists are made once for all copies of a face. They are written out and sorted where their range of faces is.
    """
    areas, shapes = _shape_areas(triangles, vertices, tolerance, cell_m, scene)
    way = lambda a, b: F.struct(F.col(a).alias("from"), F.col(b).alias("to"), F.col("area_m2").alias("area"))
    back = F.when(F.col("__low") != F.col("__high"), way("__high", "__low"))
    ways = areas.where("NOT opposed").select(F.explode(F.array(way("__low", "__high"), back)).alias("way")).where("way IS NOT NULL").select("way.*")
    (low_tile, at), (high_tile, to) = _tile_and_place("from"), _tile_and_place("to")
    ways = ways.select(low_tile.alias("low_tile"), high_tile.alias("high_tile"), at.alias("at"), to.alias("to"), "area").repartition("low_tile", "high_tile")
    met = ways.groupBy("low_tile", "high_tile", "at").agg(F.collect_list(F.struct("to", "area")).alias("__w"))
    met = cut_lineage(met.select("low_tile", "high_tile", "at", F.col("__w.to").alias("to"), F.col("__w.area").alias("area")))
    lows = _lists(met.select("low_tile", "high_tile", "at"), shapes, "low_tile", "lows", scene)
    highs = _lists(met.select("low_tile", "high_tile", F.explode("to").alias("at")).distinct(), shapes, "high_tile", "highs", ())
    met = met.join(by_shuffle(lows), ["low_tile", "high_tile"]).join(by_shuffle(highs), ["low_tile", "high_tile"])
    met = met.select(F.get("lows", F.col("at")).alias("a"), "highs", "to", "area").where("a IS NOT NULL")

    def faces_of(b: Column, area: Column) -> Column:
        return F.transform(b["objects"], lambda o, j: F.struct(o.alias("object"), F.get(b["faces"], j).alias("face"), area.alias("area")))

    lists = F.transform("to", lambda t, i: faces_of(F.get("highs", t), F.get("area", i)))
    met = V.once(met, {"__b": F.array_sort(F.flatten(F.filter(lists, lambda x: x.isNotNull())))})
    own = {"__objects": F.col("a.objects"), "__faces": F.col("a.faces"), **{f"__s{c}": F.col(f"a.{c}") for c in scene}}
    met = V.once(met.select("a", "__b"), {"__o": F.col("__b.object"), "__f": F.col("__b.face"), "__m": F.col("__b.area"), **own}).drop("a", "__b")
    met = met.select(*[F.col(f"__s{c}").alias(c) for c in scene], "__faces", "__o", "__f", "__m", F.posexplode("__objects").alias("__i", "object_a"))
    met = met.withColumn("face_a", F.get("__faces", F.col("__i")))
    earlier = F.filter("__o", lambda o, i: (o < F.col("object_a")) | ((o == F.col("object_a")) & (F.get("__f", i) <= F.col("face_a"))))
    met = V.once(met, {"__n": F.size(earlier)}).where("__n < size(__o)")
    rest = [F.slice(x, F.col("__n") + 1, F.size("__o") - F.col("__n")).alias(x) for x in ("__o", "__f", "__m")]
    first = [*by, "object_a", "face_a"]
    kept = list(dict.fromkeys([*scene, *first]))
    ranged = met.select(*kept, *rest).repartitionByRange(*first)
    rows = ranged.select(*kept, "__f", "__m", F.posexplode("__o").alias("__i", "object_b"))
    rows = rows.select(*kept, "object_b", F.get("__f", F.col("__i")).alias("face_b"), F.get("__m", F.col("__i")).alias("area_m2"))
    return rows.sortWithinPartitions(*first, "object_b", "face_b")


def review_meshes(vertices: DataFrame, faces: DataFrame, triangles: DataFrame, tolerance: float = TOLERANCE,
                  cell_m: float = 1.0, scene: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """All mesh findings, and opposed contacts that need a look but do not fail.

    ``object_id`` names one object over all scenes; ``scene`` keeps overlaps apart.
    """
    broken = cut_lineage(nonfinite_mesh(vertices))
    few = measured(broken)  # nothing is shuffled to leave out the few objects that are not finite
    faces, triangles, vertices = (d.join(few if few is not broken else by_shuffle(broken), "object_id", "left_anti") for d in (faces, triangles, vertices))

    def rows(df: DataFrame, rule: str, entity: Sequence[str], detail: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *[F.col(c).cast("string") for c in entity]).alias("entity_id"), detail.cast("string").alias("detail"))

    areas = coplanar_overlap_area(triangles, vertices, tolerance, cell_m, scene)
    pair = ["object_a", "face_a", "object_b", "face_b"]
    out = rows(broken, "nonfinite_vertices", ["object_id"], F.lit(None))
    out = out.unionByName(rows(degenerate_faces(faces, vertices, tolerance), "degenerate_face", ["object_id", "face"], F.lit(None)))
    out = out.unionByName(rows(edge_use_audit(faces), "inconsistent_winding_or_nonmanifold", ["object_id", "low", "high"], F.col("uses")))
    out = out.unionByName(rows(inverted_closed_mesh(faces, triangles, vertices, tolerance), "inverted_closed_mesh", ["object_id"], F.lit(None)))
    out = out.unionByName(rows(areas.where("NOT opposed"), "coplanar_overlap", pair, F.round("area_m2", 9)))
    return out, areas.where("opposed")


# --- exported models --------------------------------------------------------

def axes_to_web(df: DataFrame, x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    """Z-up model axes to Y-up viewer axes."""
    return df.withColumns({x: F.col(x), y: F.col(z), z: -F.col(y)})


def nearest_vertex_match(native: DataFrame, exported: DataFrame, tolerance: float = 2e-5, key: str = "object_id") -> DataFrame:
    """Per object: largest nearest-vertex error both ways and vertices without a counterpart.

    Positions repeat in exported files, so both sides are reduced to distinct positions in one aggregation; a position
    of both sides has its nearest vertex in itself. Only the others are searched, in neighbour cells of the other side, both ways in one join.
    """
    axes, cells = ["x", "y", "z"], ["__ix", "__iy", "__iz"]
    size = 32 * tolerance
    sides = native.select(key, *axes, F.lit(True).alias("a"), F.lit(False).alias("b")).unionByName(
        exported.select(key, *axes, F.lit(False).alias("a"), F.lit(True).alias("b")))
    places = cut_lineage(sides.groupBy(key, *axes).agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b")))
    whole = V.finite(F.col("x")) & V.finite(F.col("y")) & V.finite(F.col("z"))
    alike = F.col("a") & F.col("b") & whole & F.col(key).isNotNull()
    alone = places.where(~alike & whole & F.col(key).isNotNull()).select(key, F.col("a").alias("of_native"), *[F.col(c).alias(f"e{c}") for c in axes])
    around = grid.neighbours(alone, [F.col(f"e{c}") for c in axes], tolerance, size, cells)
    home = places.where(whole).withColumns({n: grid.cell_of(F.col(c), size) for n, c in zip(cells, axes)})
    gap = V.norm(V.sub(V.cols(*axes), V.cols("ex", "ey", "ez")))
    other = F.when(F.col("of_native"), F.col("b")).otherwise(F.col("a"))
    close = around.join(home, [key, *cells]).where(other).withColumn("gap", gap).where(F.col("gap") < tolerance)
    nearest = close.groupBy(key, "of_native", "ex", "ey", "ez").agg(F.min("gap").alias("gap"))
    count = lambda c: F.count_if(c).alias
    found = nearest.groupBy(key).agg(F.max("gap").alias("gap"), count(F.col("of_native"))("m1"), count(~F.col("of_native"))("m2"))
    totals = places.groupBy(key).agg(
        count(F.col("a") & ~alike)("n1"), count(F.col("b") & ~alike)("n2"), F.max(F.when(alike, 0.0)).alias("same"))
    joined = totals.join(found, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return joined.select(
        key, F.greatest("same", "gap").alias("max_vertex_error_m"),
        (F.col("n1") - zero("m1")).alias("native_unmatched"), (F.col("n2") - zero("m2")).alias("exported_unmatched"))


def oriented_triangle(i: Column, j: Column, k: Column) -> tuple[Column, Column, Column]:
    """Rotate a triangle so its smallest label leads; winding is kept."""
    low = F.least(i, j, k)
    # on repeated labels the smallest rotation is the one that compares lowest
    rotations = F.array_min(F.array(F.array(i, j, k), F.array(j, k, i), F.array(k, i, j)))
    return F.when(low.isNotNull(), rotations[0]), rotations[1], rotations[2]


def triangle_multiset_equal(expected: DataFrame, actual: DataFrame, key: str = "object_id",
                            corners: Sequence[str] = ("i", "j", "k")) -> DataFrame:
    """Oriented triangles whose number of uses differs, with both counts."""
    def counted(df: DataFrame, side: int) -> DataFrame:
        i, j, k = oriented_triangle(*[F.col(c) for c in corners])
        return df.select(key, i.alias("i"), j.alias("j"), k.alias("k"), F.lit(1 - side).alias("e"), F.lit(side).alias("a"))

    merged = counted(expected, 0).unionByName(counted(actual, 1)).groupBy(key, "i", "j", "k").agg(
        F.sum("e").alias("expected"), F.sum("a").alias("actual"))
    return merged.where(F.col("expected") != F.col("actual"))


def exported_identity_check(exported: DataFrame, declared: DataFrame, fields: Sequence[str] = ("room", "level", "role"),
                            key: str = "object_id") -> DataFrame:
    """Findings: unknown, duplicate (on either side) or missing exported ids and fields that differ."""
    from plumbline.operators.integrity import both_sides

    sides = both_sides(declared, exported, [key], fields)
    problems = [F.when(~F.col("in_left"), "unknown"), F.when(~F.col("in_right"), "missing"), F.when(F.col("repeated"), "duplicate")]
    both = F.col("in_left") & F.col("in_right")
    problems += [F.when(both & ~F.col(f"left_{f}").eqNullSafe(F.col(f"right_{f}")), f"{f}_differs") for f in fields]
    return sides.select(key, F.explode(F.array_compact(F.array(*problems))).alias("kind"))


def texture_binding_check(surfaces: DataFrame, materials: DataFrame, textures: DataFrame, images: DataFrame) -> DataFrame:
    """Surfaces whose chain material→texture→image does not end in the expected bytes.

    ``surfaces(surface_id, material_id, expected_sha256, has_uv)``,
    ``materials(material_id, texture_id)``, ``textures(texture_id, image_id)``,
    ``images(image_id, sha256)``.
    """
    chain = surfaces.join(materials, "material_id", "left").join(textures, "texture_id", "left").join(images, "image_id", "left")
    kind = (F.when(F.col("sha256").isNull(), "unbound").when(F.col("sha256") != F.col("expected_sha256"), "wrong_image")
            .when(~F.coalesce("has_uv", F.lit(False)), "no_texture_coordinates"))
    return chain.select("surface_id", kind.alias("kind")).where("kind IS NOT NULL")


def material_readback_check(assigned: DataFrame, saved: DataFrame, keys: Sequence[str] = ("object_id", "face", "corner"),
                            tolerance: float = 1e-6) -> DataFrame:
    """Corners whose saved material or UV differs from what was assigned (``material, u, v``)."""
    from plumbline.operators.integrity import both_sides

    sides = both_sides(assigned, saved, keys, ["material", "u", "v"])
    # relative part: a UV far from zero may differ by its own rounding
    apart = lambda c: F.abs(F.col(f"left_{c}") - F.col(f"right_{c}")) > tolerance + 1e-5 * F.abs(F.col(f"right_{c}"))
    kind = (F.when(F.col("repeated"), "duplicate").when(~F.col("in_right"), "missing").when(~F.col("in_left"), "extra")
            .when(~F.col("left_material").eqNullSafe(F.col("right_material")), "material_differs")
            .when(F.coalesce(apart("u") | apart("v"), F.lit(True)), "uv_differs"))
    return sides.select(*keys, kind.alias("kind")).where("kind IS NOT NULL")
