"""Photo appearance: texels on faces, visibility against depth, blending, ceilings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import grid, vectors as V
from plumbline.functions.joins import by_shuffle
from plumbline.operators.surfaces import UNROLLED, edges_of, few_edges, inside_edges
from plumbline.session import cut_lineage, spread_out

# fixed values: acceptance of a photo sample
MIN_COSINE, MAX_DARKEST, MIN_DISTANCE = 0.3, 248, 0.1


def face_frame(faces: DataFrame) -> DataFrame:
    """Plane frame of planar faces ``(object_id, face, polygon)``.

    ``basis_u`` follows the longest edge (the first of equals); ``ring`` holds local
    coordinates from the lower corner; ``extent_u, extent_v`` and ``area`` in metres.
    Degenerate or bent faces have ``usable`` false.
    """
    rows = V.once(faces, {"__n": V.fan_normal(F.col("polygon"))})
    longest = F.aggregate(
        V.ring_edges(F.col("polygon")), F.struct(F.lit(-1.0).alias("len"), F.array(*[F.lit(0.0)] * 3).alias("dir")),
        lambda acc, e: V.let(F.zip_with(e["b"], e["a"], lambda x, y: x - y), lambda d: F.when(
            V.norm(V.items(d)) > acc["len"], F.struct(V.norm(V.items(d)).alias("len"), d.alias("dir"))).otherwise(acc)))
    rows = V.once(rows, {"__len": V.norm(V.items("__n")), "__e": longest})
    rows = V.once(rows, {
        "normal": F.array(*[V.over(c, F.col("__len")) for c in V.items("__n")]),
        "basis_u": F.array(*[V.over(c, F.col("__e.len")) for c in V.items(F.col("__e.dir"))])})
    rows = V.once(rows.drop("__n", "__e"), {"basis_v": F.array(*V.cross(V.items("normal"), V.items("basis_u")))})
    first = V.items(F.col("polygon")[0])
    local = F.transform("polygon", lambda p: F.struct(
        V.dot(V.sub(V.items(p), first), V.items("basis_u")).alias("x"), V.dot(V.sub(V.items(p), first), V.items("basis_v")).alias("y")))
    bend = F.array_max(F.transform("polygon", lambda p: F.abs(V.dot(V.sub(V.items(p), first), V.items("normal")))))
    rows = V.once(rows, {"__ring": local, "usable": F.coalesce((F.col("__len") > 1e-10) & (bend < 1e-5), F.lit(False))})
    low = [F.array_min(F.col(f"__ring.{c}")) for c in "xy"]
    high = [F.array_max(F.col(f"__ring.{c}")) for c in "xy"]
    rows = rows.withColumns({"__lx": low[0], "__ly": low[1], "extent_u": high[0] - low[0], "extent_v": high[1] - low[1]})
    origin = [first[i] + F.col("__lx") * F.col("basis_u")[i] + F.col("__ly") * F.col("basis_v")[i] for i in range(3)]
    ring = F.transform("__ring", lambda p: F.struct((p["x"] - F.col("__lx")).alias("x"), (p["y"] - F.col("__ly")).alias("y")))
    return rows.withColumns({"origin": F.array(*origin), "ring": ring, "area": F.col("__len") / 2}).drop("__len", "__ring", "__lx", "__ly")


def texel_grid(frames: DataFrame, density: float) -> DataFrame:
    """Texel centres ``(col, row)`` of every usable face with world position and inside flag."""
    size = lambda e: F.greatest(F.lit(2), F.ceil(F.col(e) * density)).cast("int")
    faces = frames.where("usable").withColumns({"tex_width": size("extent_u"), "tex_height": size("extent_v"), "__edges": edges_of(F.col("ring"))})
    texels = faces.withColumn("row", F.explode(F.sequence(F.lit(0), F.col("tex_height") - 1))).withColumn(
        "col", F.explode(F.sequence(F.lit(0), F.col("tex_width") - 1)))
    s = (F.col("col") + 0.5) / F.col("tex_width") * F.col("extent_u")
    t = (F.col("row") + 0.5) / F.col("tex_height") * F.col("extent_v")
    place = {a: F.col("origin")[i] + s * F.col("basis_u")[i] + t * F.col("basis_v")[i] for i, a in enumerate("xyz")}
    return texels.withColumns({**place, "inside": inside_edges(s, t, F.col("__edges"))}).select(
        "object_id", "face", "col", "row", "x", "y", "z", "normal", "inside")


def repeat_coordinates(points: DataFrame, mapping: DataFrame, on: Sequence[str]) -> DataFrame:
    """World points to mirrored tile coordinates ``tile_x, tile_y`` in pixels.

    ``mapping(on.., map_origin, map_u, map_v, size_m, tile_width, tile_height)``.
    """
    j = points.join(mapping, list(on))
    rel = V.sub(V.cols("x", "y", "z"), V.items("map_origin"))

    def mirrored(axis: str, i: int, pixels: str) -> Column:
        local = V.over(V.dot(rel, V.items(axis)), F.col("size_m")[i])
        return (1 - F.abs(F.pmod(local, F.lit(2.0)) - 1)) * (F.col(pixels) - 1)

    return j.withColumns({"tile_x": mirrored("map_u", 0, "tile_width"), "tile_y": mirrored("map_v", 1, "tile_height")}).drop(
        "map_origin", "map_u", "map_v", "size_m", "tile_width", "tile_height")


def depth_visibility(
    projected: DataFrame, depth: DataFrame, on: Sequence[str], depth_size: tuple[int, int], image_size: tuple[int, int],
    tolerance_m: float = 0.1, confidence_value: int = 255, mask: DataFrame | None = None,
) -> DataFrame:
    """Keep-or-drop flag ``accepted`` and ``residual_m`` of projected points.

    ``projected`` carries ``px_u, px_v, depth_m, visible``; ``depth(on.., v, u,
    depth_mm, confidence)``.  The optional ``mask(on.., v, u)`` lists usable photo pixels.
    Depths are compared to the nanometre, so that the last bits of a projection do not decide at the tolerance.
    """
    def pixel(name: str, i: int, size: tuple[int, int]) -> Column:
        scaled = F.rint(F.col(name) * F.lit(size[i] / image_size[i]))
        return V.clamp(scaled, 0.0, float(size[i] - 1)).cast("long")

    rows = projected.withColumns({"__u": pixel("px_u", 0, depth_size), "__v": pixel("px_v", 1, depth_size)})
    seen = depth.select(*on, F.col("v").cast("long").alias("__v"), F.col("u").cast("long").alias("__u"), F.col("depth_mm").alias("__mm"), F.col("confidence").alias("__conf"))
    j = rows.join(seen, [*on, "__v", "__u"], "left").withColumn("residual_m", F.abs(F.col("__mm") / F.lit(1000.0) - F.round("depth_m", 9)))
    accepted = F.col("visible") & (F.col("__conf") == confidence_value) & (F.col("__mm") > 0) & (F.col("residual_m") <= tolerance_m)
    out = j.withColumn("accepted", F.coalesce(accepted, F.lit(False))).drop("__u", "__v", "__mm", "__conf")
    if mask is not None:
        out = out.withColumns({"__u": pixel("px_u", 0, image_size), "__v": pixel("px_v", 1, image_size)})
        usable = mask.select(*on, F.col("v").cast("long").alias("__v"), F.col("u").cast("long").alias("__u"), F.lit(True).alias("__ok")).distinct()
        out = out.join(usable, [*on, "__v", "__u"], "left").withColumn("accepted", F.col("accepted") & F.col("__ok").isNotNull()).drop("__u", "__v", "__ok")
    return out


def bilinear_sample(samples: DataFrame, pixels: DataFrame, on: Sequence[str], size: tuple[int, int], keys: Sequence[str],
                    channels: Sequence[str] = ("r", "g", "b")) -> DataFrame:
    """Bilinear lookup at ``px_u, px_v`` with edges repeated; NULL where a pixel is missing.

    Each sample becomes its (at most four) neighbours with weights, meets its pixels in
    one equi-join and is summed back.
    """
    u = V.clamp(F.col("px_u"), 0.0, float(size[0] - 1))
    v = V.clamp(F.col("px_v"), 0.0, float(size[1] - 1))
    fu, fv = u - F.floor(u), v - F.floor(v)
    corner = lambda du, dv, w: F.struct((F.floor(u) + du).cast("long").alias("u"), (F.floor(v) + dv).cast("long").alias("v"), w.alias("w"))
    corners = F.array(corner(0, 0, (1 - fu) * (1 - fv)), corner(1, 0, fu * (1 - fv)), corner(0, 1, (1 - fu) * fv), corner(1, 1, fu * fv))
    parts = samples.select(*keys, *[c for c in on if c not in keys], F.explode(F.filter(corners, lambda c: c["w"] > 0)).alias("c")).select(
        *keys, *[c for c in on if c not in keys], F.col("c.u").alias("u"), F.col("c.v").alias("v"), F.col("c.w").alias("__w"))
    looked = parts.join(pixels.select(*on, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"), *channels), [*on, "v", "u"], "left")
    whole = F.count("*") == F.count(channels[0])
    return looked.groupBy(*keys).agg(*[F.when(whole, F.sum(F.col("__w") * F.col(c))).alias(c) for c in channels])


def photo_weights(contributions: DataFrame, tolerance_m: float = 0.1) -> DataFrame:
    """Weight of each photo sample of a texel; zero when it is not usable.

    ``contributions`` carries ``accepted, inside, distance_m, cosine, residual_m, r, g, b``.
    """
    ok = (F.col("accepted") & F.col("inside") & (F.col("cosine") > MIN_COSINE) & (F.least("r", "g", "b") < MAX_DARKEST))
    weight = F.pow("cosine", F.lit(4.0)) / F.greatest(F.col("distance_m"), F.lit(MIN_DISTANCE)) * F.exp(-F.pow(F.col("residual_m") / tolerance_m, F.lit(2.0)))
    return contributions.withColumn("weight", F.when(F.coalesce(ok, F.lit(False)), weight).otherwise(0.0))


def photo_blend(contributions: DataFrame, keys: Sequence[str], tolerance_m: float = 0.1) -> DataFrame:
    """Weighted color per texel; ``covered`` texels only have a color from photos.

    Uncovered texels keep NULL: their declared color is not replaced by neighbours.
    """
    w = photo_weights(contributions, tolerance_m)
    total = F.sum("weight")
    return w.groupBy(*keys).agg(
        *[F.when(total > 0, F.sum(F.col("weight") * F.col(c)) / F.greatest(total, F.lit(1e-12))).alias(c) for c in "rgb"],
        (total > 0).alias("covered"), F.count_if(F.col("weight") > 0).alias("contributions"))


def photo_coverage(texels: DataFrame, blended: DataFrame, keys: Sequence[str], texel: Sequence[str]) -> DataFrame:
    """Covered share of the inside texels per face."""
    hit = blended.where("covered").select(*keys, *texel, F.lit(True).alias("__c"))
    j = texels.join(hit, [*keys, *texel], "left")
    inside = F.count_if(F.col("inside"))
    return j.groupBy(*keys).agg(
        inside.alias("inside"), F.count_if(F.col("inside") & F.col("__c").isNotNull()).alias("covered"),
        (F.count_if(F.col("inside") & F.col("__c").isNotNull()) / F.greatest(inside, F.lit(1))).alias("photo_coverage"))


def source_contributions(contributions: DataFrame, keys: Sequence[str], tolerance_m: float = 0.1) -> DataFrame:
    """Texels each photo contributes to, per face and source."""
    return photo_weights(contributions, tolerance_m).groupBy(*keys, "source_id").agg(F.count_if(F.col("weight") > 0).alias("texels"))


def ceiling_above(points: DataFrame, faces: DataFrame, point_key: str = "point_id", cell_m: float = 1.0, scene: Sequence[str] = (),
                  slab_m: float = 1.0) -> DataFrame:
    """Lowest face height above ``floor_z`` at ``x, y``; NULL when no face covers the point.

    ``faces(polygon)``; near-vertical faces are ignored.  Faces lie in a quadtree of their scene (columns named in
    ``scene``, on both tables): a face is kept on the level of its size, in 25 cells at most, and on the level of its
    rise, in two slabs of height at most.  A point first meets the slab of its floor and the next one; what it finds within
    ``slab_m`` above its floor is the lowest there is.  Only points that found nothing so near meet all faces of their cells.
    """
    rows = faces.select(*scene, "polygon").distinct()
    rows = V.once(rows, {"__n": V.fan_normal(F.col("polygon"))})
    rows = V.once(rows, {"__len": V.norm(V.items("__n"))}).where(F.col("__len") > 1e-10)
    xs, ys, zs = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1]), F.transform("polygon", lambda p: p[2])
    flat = rows.select(
        *scene, *[F.col("polygon")[0][i].alias(f"__o{c}") for i, c in enumerate("xyz")], *[V.over(F.col("__n")[i], F.col("__len")).alias(f"__n{c}") for i, c in enumerate("xyz")],
        *[f(v).alias(f"__{c}{e}") for c, v in zip("xyz", (xs, ys, zs)) for e, f in ((0, F.array_min), (1, F.array_max))],
        edges_of(F.transform("polygon", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).alias("__edges")).where(F.abs("__nz") >= 0.01)
    flat = spread_out(cut_lineage(flat))  # plain numbers, read several times below
    celled = grid.level_cover(flat, [F.col("__x0"), F.col("__y0")], [F.col("__x1"), F.col("__y1")], cell_m, ["__i", "__j"], "__level")
    # a polygon that is not quite flat can reach its plane a little outside its corners' heights
    slack = 1e-6 + 1e-9 * F.greatest(F.abs("__z0"), F.abs("__z1"))
    slabbed = grid.level_cover(celled, [F.col("__z0") - slack], [F.col("__z1") + slack], slab_m, ["__slab"], "__rise", 1)
    place = [*scene, "x", "y", "floor_z"]  # points of one place share their ceiling
    sought = spread_out(cut_lineage(points.select(*place).distinct()))
    x, y = F.col("x"), F.col("y")
    height = F.col("__oz") - V.over((x - F.col("__ox")) * F.col("__nx") + (y - F.col("__oy")) * F.col("__ny"), F.col("__nz"))

    def lowest(located: DataFrame, sides: DataFrame, keys: Sequence[str]) -> DataFrame:
        met = located.join(sides, [*scene, *keys]).where((x >= F.col("__x0")) & (x <= F.col("__x1")) & (y >= F.col("__y0")) & (y <= F.col("__y1")))
        met = met.withColumn("__h", height).where((F.col("__h") > F.col("floor_z")) & strictly_inside(x, y, F.col("__edges")))
        return met.groupBy(*place).agg(F.min("__h").alias("__h"))

    def on_levels(rows: DataFrame, names: Sequence[str]) -> DataFrame:
        used = grid.levels_of(slabbed if len(names) > 1 else celled, *names)
        every = F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(u, names)]) for u in used]) if used else F.array().cast(
            "array<struct<" + ",".join(f"{n}:int" for n in names) + ">>")
        return grid.level_points(rows.select("*", F.inline(every)), [x, y], cell_m, ["__i", "__j"], "__level")

    floor_slab = grid.cell_of(F.col("floor_z"), slab_m * F.pow(F.lit(2.0), F.col("__rise")), grid.ORIGIN)
    near = on_levels(sought, ["__level", "__rise"]).withColumn("__slab", F.explode(F.array(floor_slab, floor_slab + 1)))
    found = lowest(near, slabbed, ["__level", "__i", "__j", "__rise", "__slab"])
    found = spread_out(cut_lineage(sought.join(found, place, "left")))
    close = F.coalesce(F.col("__h") <= F.col("floor_z") + slab_m, F.lit(False))
    far = lowest(on_levels(found.where(~close).select(*place), ["__level"]), celled, ["__level", "__i", "__j"])
    best = found.where(close).select(*place, F.col("__h").alias("ceiling_z")).unionByName(far.withColumnRenamed("__h", "ceiling_z"))
    return points.join(by_shuffle(best), place, "left")


def strictly_inside(x: Column, y: Column, edges: Column) -> Column:
    """Even-odd crossing rule without the inclusive boundary."""
    def crossing(e: Column) -> Column:
        at = e["ax"] + V.over((y - e["ay"]) * (e["bx"] - e["ax"]), e["by"] - e["ay"])
        return F.when(((e["ay"] > y) != (e["by"] > y)) & (x < at), 1).otherwise(0)

    count, odd, _ = few_edges(edges, crossing)
    return F.when(count <= UNROLLED, odd).otherwise(F.aggregate(edges, F.lit(0), lambda acc, e: acc + crossing(e)) % 2 == 1)


def lowest_above(lights: DataFrame, faces: DataFrame, clearance: str = "clearance", cell_m: float = 1.0, scene: Sequence[str] = ()) -> DataFrame:
    """Light positions below the lowest ceiling; ``placed`` is false without one or below the floor."""
    found = ceiling_above(lights, faces, "light_id", cell_m, scene)
    z = F.col("ceiling_z") - F.col(clearance)
    return found.withColumns({"light_z": z, "placed": F.coalesce(z > F.col("floor_z"), F.lit(False))})
