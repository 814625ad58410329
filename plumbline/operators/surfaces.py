"""Surface patches: pixel selection, plane fits, support polygons, repeat comparison."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import grid, vectors as V
from plumbline.functions.joins import join_model
from plumbline.functions.hulls import hulls, inside_hull
from plumbline.functions.linalg import eig3
from plumbline.functions.quantiles import exact_quantiles, residual_stats
from plumbline.operators.pixels import display_pixel
from plumbline.rules import findings
from plumbline.session import cut_lineage, spread_out

# fixed values: fit acceptance
MIN_INLIERS = 30
MIN_SPAN = 1e-8
FIT_ROUNDS = 5


def edges_of(ring: Column) -> Column:
    """Edges ``{ax, ay, bx, by}`` of an array of ``{x, y}``; computed once per polygon."""
    n = F.size(ring)
    return F.transform(ring, lambda p, i: F.struct(
        p["x"].alias("ax"), p["y"].alias("ay"),
        ring[(i + 1) % n]["x"].alias("bx"), ring[(i + 1) % n]["y"].alias("by")))


def inside_edges(x: Column, y: Column, edges: Column, tolerance: float = 1e-9) -> Column:
    """Even-odd test of a 2-D point against ring edges; the boundary counts as inside.

    Longer rings bind the point as a one-element array, so its expressions run once
    per row and not once per edge.
    """
    def crossing(px: Column, py: Column, e: Column) -> Column:
        straddles = (e["ay"] > py) != (e["by"] > py)
        at = e["ax"] + (py - e["ay"]) * (e["bx"] - e["ax"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0))
        return F.when(straddles & (px < at), 1).otherwise(0)

    def touching(px: Column, py: Column, e: Column) -> Column:
        dx, dy = e["bx"] - e["ax"], e["by"] - e["ay"]
        length = dx * dx + dy * dy
        t = F.when(length == 0, 0.0).otherwise(
            V.clamp(((px - e["ax"]) * dx + (py - e["ay"]) * dy) / F.nullif(length, F.lit(0.0)), 0.0, 1.0))
        return F.hypot(px - e["ax"] - t * dx, py - e["ay"] - t * dy) <= tolerance

    def holds(q: Column) -> Column:
        odd = F.aggregate(edges, F.lit(0), lambda acc, e: acc + crossing(q["x"], q["y"], e)) % 2 == 1
        return odd | F.exists(edges, lambda e: touching(q["x"], q["y"], e))

    count, odd, near = few_edges(edges, lambda e: crossing(x, y, e), lambda e: touching(x, y, e))
    many = F.exists(F.array(F.struct(x.alias("x"), y.alias("y"))), holds)
    return F.when(count <= UNROLLED, odd | near).otherwise(many)


UNROLLED = 4  # rings of up to this many edges run as compiled expressions


def few_edges(edges: Column, crossing: Callable[[Column], Column], touching: Callable[[Column], Column] | None = None) -> tuple[Column, Column, Column]:
    """Edge count, odd-crossings flag and any-touch flag over the first few edges.

    Triangles and quads are nearly all rings, and a lambda over an array is
    interpreted: unrolled, the same test is compiled.
    """
    count, crossings, near = F.size(edges), F.lit(0), F.lit(False)
    for i in range(UNROLLED):
        e = F.get(edges, F.lit(i))
        crossings = crossings + F.when(count > i, crossing(e)).otherwise(0)
        if touching is not None:
            near = near | F.when(count > i, touching(e)).otherwise(False)
    return count, crossings % 2 == 1, near


def inside_ring(x: Column, y: Column, ring: Column, tolerance: float = 1e-9) -> Column:
    """:func:`inside_edges` for a ring of ``{x, y}`` vertices."""
    return inside_edges(x, y, edges_of(ring), tolerance)


def polygon_select_pixels(px: DataFrame, patches: DataFrame, keys: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """Depth pixels whose mapped RGB pixel lies in a patch polygon, one row per patch and pixel.

    ``px`` carries ``rgb_u, rgb_v``; ``patches`` carries ``patch_id``, the displayed
    ``polygon`` (array of ``{x, y}``), ``orientation`` and ``rgb_height``.  The exact
    even-odd rule with an inclusive boundary replaces a rasterised mask.
    """
    limits = [f(F.col(f"polygon.{c}")).alias(f"__{s}{c}") for s, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"]
    joined = px.join(patches.select(*keys, "patch_id", "orientation", "rgb_height", edges_of(F.col("polygon")).alias("__edges"), *limits), list(keys))
    x, y = display_pixel(F.col("rgb_u"), F.col("rgb_v"), F.col("orientation"), F.col("rgb_height"))
    x, y = x.cast("double"), y.cast("double")
    box = (x >= F.col("__minx")) & (x <= F.col("__maxx")) & (y >= F.col("__miny")) & (y <= F.col("__maxy"))
    return joined.where(box & inside_edges(x, y, F.col("__edges"))).drop(
        "orientation", "rgb_height", "__edges", "__minx", "__maxx", "__miny", "__maxy")


def check_patch_polygons(patches: DataFrame) -> DataFrame:
    """Findings: polygons that are no ring of finite corners, or leave the image as it is shown.

    ``patches`` as in :func:`polygon_select_pixels`, with ``rgb_width``; an upright image swaps width and height.  The image is
    half open: a corner at its width or height is outside.  Patches named here give no pixels that can be trusted.
    """
    turned = F.col("orientation") == "upright90cw"
    width = F.when(turned, F.col("rgb_height")).otherwise(F.col("rgb_width"))
    height = F.when(turned, F.col("rgb_width")).otherwise(F.col("rgb_height"))
    ring = F.coalesce((F.size("polygon") >= 3) & F.forall("polygon", lambda p: V.finite(p["x"]) & V.finite(p["y"])), F.lit(False))
    inside = F.forall("polygon", lambda p: (p["x"] >= 0) & (p["y"] >= 0) & (p["x"] < width) & (p["y"] < height))
    return findings(patches, F.col("patch_id"), {
        "polygon_invalid": (~ring, None),
        "polygon_outside_image": (ring & ~F.coalesce(inside, F.lit(False)), F.concat_ws("x", width.cast("string"), height.cast("string")))})


def check_support_normals(polygons: DataFrame, group: Sequence[str], source_normal: Sequence[float], tolerance: float = 1e-12) -> DataFrame:
    """Findings: polygons whose normal is at right angles to the source normal, so that a distance from them has no sign."""
    framed = polygon_frames(polygons)
    facing = V.dot(V.items("normal"), [F.lit(float(c)) for c in source_normal])
    entity = F.concat_ws("/", *[F.col(c).cast("string") for c in (*group, "polygon_ordinal")])
    return findings(framed, entity, {"normal_at_right_angles": (F.abs(facing) <= tolerance, None)})


def patch_summary(selected: DataFrame, confidence_value: int = 255, max_depth_m: float = 5.0) -> DataFrame:
    """Native and eligible pixel counts per patch."""
    from plumbline.operators.pixels import eligible

    kept = F.count_if(eligible(confidence_value, max_depth_m))
    return selected.groupBy("patch_id").agg(
        F.count("*").alias("native_patch_pixels"), kept.alias("eligible_pixels"), (kept / F.count("*")).alias("eligible_fraction"))


def transform_points(points: DataFrame, transforms: DataFrame, on: Sequence[str]) -> DataFrame:
    """Apply a rigid ``matrix`` per key to ``x, y, z``; keys without one are left out, ``rules.unmatched`` names them."""
    x, y, z = V.apply_rigid(F.col("__m"), V.cols("x", "y", "z"))
    joined = points.join(transforms.select(*on, F.col("matrix").alias("__m")), list(on))
    return joined.withColumns({"x": x, "y": y, "z": z}).drop("__m")


def transform_plane(planes: DataFrame, transforms: DataFrame, on: Sequence[str]) -> DataFrame:
    """Move planes ``normal · p = offset`` (``nx, ny, nz, plane_offset``) with a rigid matrix.

    Planes without one are left out; ``rules.unmatched`` names their keys.
    """
    joined = planes.join(transforms.select(*on, F.col("matrix").alias("__m")), list(on))
    n = V.rotate(F.col("__m"), V.cols("nx", "ny", "nz"))
    shifted = F.col("plane_offset") + V.dot(n, V.translation(F.col("__m")))
    return joined.withColumns({"nx": n[0], "ny": n[1], "nz": n[2], "plane_offset": shifted}).drop("__m")


def _moments(points: DataFrame, keys: Sequence[str], keep: Column, extra: Sequence[Column] = ()) -> DataFrame:
    """Count, mean and centred second moments of the kept points; stable and combinable."""
    kept = {a: F.when(keep, F.col(a)) for a in "xyz"}
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return points.groupBy(*keys).agg(
        F.count("*").alias("n"), F.count_if(keep).alias("kept"),
        F.avg(kept["x"]).alias("cx"), F.avg(kept["y"]).alias("cy"), F.avg(kept["z"]).alias("cz"),
        F.array(*[F.covar_pop(kept[a], kept[b]) for a, b in pairs]).alias("__s"), *extra)


def _solved(moments: DataFrame, keys: Sequence[str], min_inliers: int) -> DataFrame:
    """Plane model per key from its moments, with the status of failed fits."""
    eigen = moments.withColumn("__e", eig3("__s"))
    e = F.col("__e")
    # moments resolve a relative spread of about 1e-7; below that the points are a line
    flat = (F.sqrt(F.greatest(F.col("kept") * e[1], F.lit(0.0))) < MIN_SPAN) | (e[1] <= e[2] * 1e-14)
    status = (F.when(F.col("status").isNotNull(), F.col("status"))
              .when(F.col("kept") < min_inliers, "too_few_inliers")
              .when(F.coalesce(flat, F.lit(True)), "no_span"))
    return eigen.select(
        *keys, "n", "kept", "cx", "cy", "cz", e[3].alias("nx"), e[4].alias("ny"), e[5].alias("nz"),
        F.array(e[9], e[10], e[11]).alias("basis_u"), F.array(e[6], e[7], e[8]).alias("basis_v"), status.alias("status"))


_MODEL = ("cx", "cy", "cz", "nx", "ny", "nz", "status")


def _distance() -> Column:
    return F.abs(V.dot(V.sub(V.cols("x", "y", "z"), V.cols("cx", "cy", "cz")), V.cols("nx", "ny", "nz")))


def plane_fit(points: DataFrame, keys: Sequence[str], rejection_m: float = 0.02, min_inliers: int = MIN_INLIERS,
              up: Sequence[float] = (0.0, 1.0, 0.0), materialize: bool = True) -> DataFrame:
    """Least-squares plane per key with up to five rejection rounds and a final refit.

    Each round is one aggregation of moments over all points and a join of the model
    table back to them; the model is broadcast when its counted size allows, so points
    are scanned but not shuffled and a patch of any size is spread over the cluster.
    A patch whose round kept as many points and moved the plane by no more than rounding
    is settled, as is a failed one; only the others are read again.  ``status`` is ``fitted``, ``too_few_samples``, ``no_span`` or
    ``too_few_inliers``; model columns are NULL unless fitted.
    """
    keys = list(keys)
    cloud = points.select(*keys, "x", "y", "z")
    if materialize:
        cloud = cut_lineage(cloud)  # six passes read the points, not their derivation
    first = _moments(cloud, keys, F.lit(True), [F.lit(None).cast("string").alias("status")])
    model = _solved(first.withColumn("status", F.when(F.col("n") < min_inliers, "too_few_samples")), keys, min_inliers)
    active, settled = cut_lineage(model), []
    before = [F.col(c).alias(f"__{c}") for c in ("kept", "cx", "cy", "cz", "nx", "ny", "nz")]
    for turn in range(FIT_ROUNDS):
        placed = join_model(cloud, active.select(*keys, *_MODEL), keys)
        keep = F.col("status").isNull() & (_distance() <= rejection_m)
        solved = _solved(_moments(placed, keys, keep, [F.max("status").alias("status")]), keys, min_inliers)
        moved = F.greatest(*[F.abs(F.col(c) - F.col(f"__{c}")) / (F.lit(1.0) + F.abs(f"__{c}")) for c in ("cx", "cy", "cz")],
                           F.lit(1.0) - F.abs(V.dot(V.cols("nx", "ny", "nz"), V.cols("__nx", "__ny", "__nz"))))
        done = F.col("status").isNotNull() | F.coalesce((F.col("kept") == F.col("__kept")) & (moved <= 1e-12), F.lit(False))
        solved = cut_lineage(solved.join(active.select(*keys, *before), keys).withColumn("__done", done).drop(*[f"__{c}" for c in ("kept", "cx", "cy", "cz", "nx", "ny", "nz")]))
        settled.append(solved.where("__done").drop("__done"))
        active = solved.where("NOT __done").drop("__done")
        if turn == FIT_ROUNDS - 1 or active.isEmpty():
            settled.append(active)
            break
    model = cut_lineage(reduce(DataFrame.unionByName, settled)).drop("kept")
    placed = join_model(cloud, model.select(*keys, *_MODEL), keys)
    final = placed.groupBy(*keys).agg(F.count_if(F.col("status").isNull() & (_distance() <= rejection_m)).alias("inliers"))
    out = model.join(final, keys)
    status = F.coalesce(F.col("status"), F.when(F.col("inliers") < min_inliers, "too_few_inliers"), F.lit("fitted"))
    flip = F.when(F.col("nx") * up[0] + F.col("ny") * up[1] + F.col("nz") * up[2] < 0, -1.0).otherwise(1.0)
    fitted = F.col("status") == "fitted"
    out = out.withColumn("status", status).withColumns({f"n{a}": F.col(f"n{a}") * flip for a in "xyz"})
    out = out.withColumn("plane_offset", V.dot(V.cols("cx", "cy", "cz"), V.cols("nx", "ny", "nz")))
    nullable = ["cx", "cy", "cz", "nx", "ny", "nz", "plane_offset", "basis_u", "basis_v"]
    return out.select(
        *keys, "n", "status", *[F.when(fitted, F.col(c)).alias(c) for c in nullable],
        F.when(fitted, F.col("inliers")).alias("inlier_count"), F.when(fitted, F.col("n") - F.col("inliers")).alias("rejected_count"))


def plane_residuals(points: DataFrame, planes: DataFrame, keys: Sequence[str], rejection_m: float = 0.02) -> DataFrame:
    """Points of fitted patches with ``residual_m`` and the ``inlier`` flag."""
    model = planes.where("status = 'fitted'").select(*keys, "cx", "cy", "cz", "nx", "ny", "nz")
    placed = points.join(model, list(keys)).withColumn("residual_m", _distance())
    return placed.withColumn("inlier", F.col("residual_m") <= rejection_m).drop("cx", "cy", "cz", "nx", "ny", "nz")


def plane_attributes(points: DataFrame, planes: DataFrame, keys: Sequence[str], rejection_m: float = 0.02,
                     up: Sequence[float] = (0.0, 1.0, 0.0)) -> DataFrame:
    """Tilt, inlier counts and bounds, and residual statistics of all and of inlier points."""
    keys, planes = list(keys), cut_lineage(planes)  # one row a patch; its rounds are not run again for every use
    placed = cut_lineage(plane_residuals(points, planes, keys, rejection_m).select(*keys, "x", "y", "z", "residual_m", "inlier"))
    inlier = F.col("inlier")
    totals = placed.groupBy(*keys).agg(
        F.max("residual_m").cast("double").alias("all_max"), F.max(F.when(inlier, F.col("residual_m"))).cast("double").alias("inlier_max"),
        F.count_if(inlier).alias("__inliers"), *[f(F.when(inlier, F.col(a))).alias(f"{s}_{a}") for s, f in (("min", F.min), ("max", F.max)) for a in "xyz"])
    # inliers are the least residuals, so their quantiles are other ranks of the same order
    shares = {f"{p}_{n}": at for p in ("all", "inlier") for n, at in (("median", 0.5), ("p95", 0.95))}
    spread = exact_quantiles(placed, keys, "residual_m", shares, upto={f"inlier_{n}": rejection_m for n in ("median", "p95")})
    tilt = F.degrees(F.acos(V.clamp(F.abs(V.dot(V.cols("nx", "ny", "nz"), [F.lit(float(c)) for c in up])), 0.0, 1.0)))
    base = planes.where("status = 'fitted'").select(*keys, "inlier_count", "rejected_count", tilt.alias("tilt_degrees"))
    out = base.join(totals.where("__inliers > 0"), keys).join(spread, keys)
    stats = [f"{p}_{n}" for p in ("all", "inlier") for n in ("median", "p95", "max")]
    return out.select(*keys, "inlier_count", "rejected_count", "tilt_degrees", *stats, *[f"{s}_{a}" for s in ("min", "max") for a in "xyz"])


def _entries(points: str, i: int) -> Column:
    return F.transform(points, lambda p: p[i])


def polygon_frames(polygons: DataFrame) -> DataFrame:
    """Adds the plane frame of 3-D rings: origin, unit normal, in-plane axes, 2-D ring."""
    raw = V.once(polygons.withColumnRenamed("vertices", "__v"), {"vertices": F.col("__v")}).drop("__v")
    raw = V.once(raw, {"__area": V.fan_normal(F.col("vertices"))})
    raw = V.once(raw, {"normal": F.array(*V.unit(V.items("__area")))})
    n = V.items("normal")
    size = [F.abs(c) for c in n]
    axis = (F.when((size[0] <= size[1]) & (size[0] <= size[2]), F.array(*map(F.lit, (1.0, 0.0, 0.0))))
            .when(size[1] <= size[2], F.array(*map(F.lit, (0.0, 1.0, 0.0)))).otherwise(F.array(*map(F.lit, (0.0, 0.0, 1.0)))))
    raw = V.once(raw, {"__axis": axis})
    raw = V.once(raw, {"along": F.array(*V.unit(V.cross(V.items("__axis"), n)))})
    raw = V.once(raw, {"across": F.array(*V.cross(n, V.items("along")))})
    origin = V.items(F.col("vertices")[0])

    def flat(p: Column) -> Column:
        rel = V.sub(V.items(p), origin)
        return F.struct(V.dot(rel, V.items("along")).alias("x"), V.dot(rel, V.items("across")).alias("y"))

    return V.once(raw, {"origin": F.col("vertices")[0], "ring": F.transform("vertices", flat)}).drop("__area", "__axis")


_FRAME = [f"{v}_{a}" for v in ("normal", "origin", "along", "across") for a in "xyz"]
_LIMITS = [f"__{s}{c}" for s in ("min", "max") for c in "xy"]


def nearest_support_polygon(
    points: DataFrame, polygons: DataFrame, group: Sequence[str], point_key: Sequence[str],
    source_normal: Sequence[float] | None = None, boundary_tolerance: float = 1e-9, cells: int = 32, first_reach: float | None = None,
) -> DataFrame:
    """Closest supporting polygon per point, signed distance kept, unmatched points kept.

    A point is supported when its orthogonal projection falls in the polygon.  Nearest first: a polygon sweeps a
    short prism of ``first_reach`` to both sides of its plane (by default a quarter of the length of its group's usual polygon, a 64th of the points' bounding box at
    most), kept in at most 27 cells on the level of its size, and a point that finds a polygon within that reach is done.  Only the others meet
    the whole prisms, swept through the bounding box and cut into cells half as long as the polygon (a 32nd of the prism at least).
    So cells follow the polygons and not the extent of the points, and points outside the box of all prisms meet nothing.
    Both are equi-joins, however many points one group holds.  Ties go to the lower ``polygon_ordinal``.  The points are stored once.
    """
    group, point_key = list(group), list(point_key)
    points = cut_lineage(points)
    whole = V.finite(F.col("x")) & V.finite(F.col("y")) & V.finite(F.col("z"))  # others project into nothing
    box = points.where(whole).groupBy(*group).agg(*[f(a).alias(f"__{s}{a}") for s, f in (("lo", F.min), ("hi", F.max)) for a in "xyz"])
    box = cut_lineage(box.withColumn("__cell", F.greatest(*[F.col(f"__hi{a}") - F.col(f"__lo{a}") for a in "xyz"], F.lit(1e-6)) / cells))
    # of exact copies in a group the lowest ordinal wins every tie, so only that one can support a point
    polygons = polygons.groupBy(*group, "vertices").agg(F.min("polygon_ordinal").alias("polygon_ordinal"))
    framed = polygon_frames(polygons)
    limits = [f(F.col(f"ring.{c}")).alias(f"__{s}{c}") for s, f in (("min", F.array_min), ("max", F.array_max)) for c in "xy"]
    spans = [f(_entries("vertices", i)).alias(f"__{s}{a}") for s, f in (("low", F.array_min), ("high", F.array_max)) for i, a in enumerate("xyz")]
    scalars = [F.col(v)[i].alias(f"{v}_{a}") for v in ("normal", "origin", "along", "across") for i, a in enumerate("xyz")]
    n, o = V.cols(*[f"normal_{a}" for a in "xyz"]), V.cols(*[f"origin_{a}" for a in "xyz"])
    sign = F.lit(1.0)
    if source_normal is not None:
        sign = F.when(V.dot(n, [F.lit(float(c)) for c in source_normal]) < 0, -1.0).otherwise(1.0)
    # written out once as plain numbers: the rows below read the frame many times
    framed = framed.select(*group, "polygon_ordinal", *scalars, *spans, *limits, edges_of(F.col("ring")).alias("__edges")).withColumn("__sign", sign).join(box, group)
    framed = cut_lineage(_swept(framed, boundary_tolerance))
    extent = F.greatest(*[F.col(f"__high{a}") - F.col(f"__low{a}") for a in "xyz"])
    reach = F.lit(float(first_reach)) if first_reach else F.least(F.first("__cell") / 2, F.exp(F.avg(F.ln(F.when(extent > 0, extent)))) / 4)
    scale = cut_lineage(framed.groupBy(*group).agg(
        reach.alias("__reach"), *[f(f"__{s}{a}").alias(f"__{s}{a}") for s, f in (("from", F.min), ("to", F.max)) for a in "xyz"]))
    framed = spread_out(cut_lineage(framed.join(scale.select(*group, "__reach"), group)))
    reached = whole
    for a in "xyz":
        reached = reached & F.col(a).between(F.col(f"__from{a}"), F.col(f"__to{a}"))
    points = spread_out(points)
    located = points.select(*group, *point_key, "x", "y", "z").join(scale, group).where(reached).select(*group, *point_key, "x", "y", "z", "__reach")

    near = _supports(*_short_prisms(located, framed, group), boundary_tolerance)
    near = closest_support(near, [*group, *point_key])
    close = F.abs("residual_m") <= F.col("__reach")
    near = near.join(scale.select(*group, "__reach"), group).where(close).drop("__reach")
    near = cut_lineage(near)
    rest = located.join(near.select(*group, *point_key), [*group, *point_key], "left_anti")
    far = _supports(*_whole_prisms(rest, framed, group, boundary_tolerance, cells), boundary_tolerance)
    best = near.unionByName(closest_support(far, [*group, *point_key]))
    chosen = best.withColumnRenamed("polygon_ordinal", "supporting_polygon")
    return points.join(chosen, [*group, *point_key], "left").withColumn("overlap", F.col("supporting_polygon").isNotNull())


def _swept(framed: DataFrame, tolerance: float) -> DataFrame:
    """Polygons whose prism, swept through the box of their group's points, meets that box, with ``__from`` and ``__to`` of the part inside.

    ``__pad`` is what bounds are widened by: the tolerance, and rounding of coordinates far from the origin.
    """
    n, o = V.cols(*[f"normal_{a}" for a in "xyz"]), V.cols(*[f"origin_{a}" for a in "xyz"])
    far_out = F.greatest(*[F.abs(f"__{s}{a}") for s in ("lo", "hi", "low", "high") for a in "xyz"])
    framed = framed.withColumn("__pad", F.lit(tolerance) + 1e-12 * far_out)
    half = [(F.col(f"__hi{a}") - F.col(f"__lo{a}")) / 2 for a in "xyz"]
    mid = [(F.col(f"__hi{a}") + F.col(f"__lo{a}")) / 2 for a in "xyz"]
    middle = V.dot(n, V.sub(mid, o))
    reach = sum((F.abs(c) * h for c, h in zip(n[1:], half[1:])), F.abs(n[0]) * half[0])
    near, far = middle - reach, middle + reach
    for i, a in enumerate("xyz"):
        low = F.col(f"__low{a}") + F.least(n[i] * near, n[i] * far) - F.col("__pad")
        high = F.col(f"__high{a}") + F.greatest(n[i] * near, n[i] * far) + F.col("__pad")
        framed = framed.withColumns({f"__from{a}": F.greatest(low, F.col(f"__lo{a}")), f"__to{a}": F.least(high, F.col(f"__hi{a}"))})
    for a in "xyz":
        framed = framed.where(F.col(f"__from{a}") <= F.col(f"__to{a}"))
    return framed


def _supports(located: DataFrame, prisms: DataFrame, keys: Sequence[str], tolerance: float) -> DataFrame:
    """Points with the polygons of their cell that they project into, with ``residual_m``."""
    n, o = V.cols(*[f"normal_{a}" for a in "xyz"]), V.cols(*[f"origin_{a}" for a in "xyz"])
    met = located.join(prisms, list(keys))
    rel = V.sub(V.cols("x", "y", "z"), o)
    at = {"residual_m": V.dot(rel, n) * F.col("__sign"), **{f"__p{c}": V.dot(rel, V.cols(*[f"{axis}_{a}" for a in "xyz"])) for c, axis in (("x", "along"), ("y", "across"))}}
    met = met.withColumns(at)
    for c in "xy":  # plain comparisons first: the ring test is the costly part
        met = met.where((F.col(f"__p{c}") >= F.col(f"__min{c}") - tolerance) & (F.col(f"__p{c}") <= F.col(f"__max{c}") + tolerance))
    return met.where(inside_edges(F.col("__px"), F.col("__py"), F.col("__edges"), tolerance))


_CARRIED = ["polygon_ordinal", *_FRAME, "__sign", "__edges", *_LIMITS]


def _on_levels(located: DataFrame, placed: DataFrame, group: Sequence[str], names: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points on every level that polygons use, the polygons, and the keys they meet by."""
    used = grid.levels_of(placed, "__level")
    levels = F.array(*[F.lit(k) for k, in used]) if used else F.array().cast("array<int>")
    spread = grid.level_points(located.withColumn("__level", F.explode(levels)), V.cols("x", "y", "z"), F.col("__reach"), names, "__level")
    keys = [*group, "__level", *names]
    return spread.drop("__reach"), placed.select(*keys, *_CARRIED), keys


def _short_prisms(located: DataFrame, framed: DataFrame, group: Sequence[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and polygons by the cells of levels of size, polygons swept by their reach."""
    names = ["__cx", "__cy", "__cz"]
    lows = [F.col(f"__low{a}") - F.abs(f"normal_{a}") * F.col("__reach") - F.col("__pad") for a in "xyz"]
    highs = [F.col(f"__high{a}") + F.abs(f"normal_{a}") * F.col("__reach") + F.col("__pad") for a in "xyz"]
    placed = cut_lineage(grid.level_cover(framed, lows, highs, F.col("__reach"), names, "__level", 2))
    return _on_levels(located, placed, group, names)


def _whole_prisms(located: DataFrame, framed: DataFrame, group: Sequence[str], tolerance: float, cells: int) -> tuple[DataFrame, DataFrame, list[str]]:
    """Points and polygons by the cells that polygons cut when swept through the points' box, on the level of half the polygon or a part of the prism."""
    names, o = ["__cx", "__cy", "__cz"], V.cols(*[f"origin_{a}" for a in "xyz"])
    across = F.greatest(*[F.col(f"__high{a}") - F.col(f"__low{a}") for a in "xyz"]) / 2
    length = F.greatest(*[F.col(f"__to{a}") - F.col(f"__from{a}") for a in "xyz"]) / cells
    least = F.greatest(across, length)
    level = F.ceil(F.log2(F.when(least > 0, least / F.col("__reach"))))
    prisms = framed.withColumn("__level", F.greatest(F.coalesce(level, F.lit(0)), F.lit(0)).cast("int"))
    size = F.col("__reach") * F.pow(F.lit(2.0), F.col("__level"))
    prisms = grid.cover(prisms, V.cols(*[f"__from{a}" for a in "xyz"]), V.cols(*[f"__to{a}" for a in "xyz"]), size, names, grid.ORIGIN)
    # the cells of a tilted prism's bounding box are mostly outside the prism: keep those it can cut
    centre = V.sub([(F.col(c) + (0.5 - grid.ORIGIN)) * size for c in names], o)
    for axis, c in (("along", "x"), ("across", "y")):
        ext = size / 2 * (F.abs(f"{axis}_x") + F.abs(f"{axis}_y") + F.abs(f"{axis}_z")) + 2 * F.col("__pad") + 1e-9 * size
        at = V.dot(centre, V.cols(*[f"{axis}_{a}" for a in "xyz"]))
        prisms = prisms.where((at >= F.col(f"__min{c}") - ext) & (at <= F.col(f"__max{c}") + ext))
    return _on_levels(located, cut_lineage(prisms.select(*group, "__level", *names, *_CARRIED)), group, names)


def closest_support(candidates: DataFrame, keys: Sequence[str], residual: str = "residual_m", ordinal: str = "polygon_ordinal") -> DataFrame:
    """The candidate with the smallest absolute residual per key; ties go to the lower ordinal.

    An aggregation with map-side combining, not a window: a key with very many
    candidates is reduced where its rows are.
    """
    best = F.min(F.struct(F.abs(residual).alias("d"), F.col(ordinal).alias("o"), F.col(residual).alias("r")))
    return candidates.groupBy(*keys).agg(best.alias("__b")).select(*keys, F.col("__b.o").alias(ordinal), F.col("__b.r").alias(residual))


def convex_overlap(first: DataFrame, second: DataFrame, key: str, tolerance: float = 1e-9) -> DataFrame:
    """Rows of ``first(key, px, py)`` inside the convex hull of ``second(key, px, py)``.

    Hull corners are merged as a tree and points meet one edge of their key's ring, see
    :mod:`plumbline.functions.hulls`.  Hulls without area select nothing; NULL is a key.
    """
    rings = hulls(second.select(F.col(key).alias("key"), "px", "py"))
    return inside_hull(first, rings, key, tolerance)


def compare_patches(pairs: DataFrame, planes: DataFrame, inliers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Repeat measurements of one physical surface.

    ``pairs(pair_id, first, second)``; ``planes(patch_id, physical_surface,
    analysis_frame, cx..cz, nx..nz, basis_u, basis_v)``; ``inliers(patch_id, x, y, z)``.
    The overlap is directional: samples of the first patch inside the hull of the
    second, in the first patch's plane.  Returns measurements and findings; a pair
    with an unfitted patch is ``not measured``.
    """
    side = lambda p: planes.select(*[F.col(c).alias(f"{p}_{c}") for c in planes.columns])
    both = pairs.join(side("a"), F.col("first") == F.col("a_patch_id"), "left").join(side("b"), F.col("second") == F.col("b_patch_id"), "left")
    measured = F.col("a_nx").isNotNull() & F.col("b_nx").isNotNull()
    same_frame = F.col("a_analysis_frame").eqNullSafe(F.col("b_analysis_frame"))
    same_surface = F.col("a_physical_surface").eqNullSafe(F.col("b_physical_surface"))
    both = both.withColumn("problem", F.when(measured & ~same_frame, "different_analysis_frame").when(measured & ~same_surface, "different_surface"))
    broken = both.where("problem IS NOT NULL").select(
        F.col("problem").alias("rule"), F.col("pair_id").cast("string").alias("entity_id"), F.concat_ws("/", "first", "second").alias("detail"))
    sound = both.where(measured & F.col("problem").isNull())
    frame_cols = ["pair_id", "a_cx", "a_cy", "a_cz", "a_basis_u", "a_basis_v"]

    def flat(which: str) -> DataFrame:
        rows = inliers.withColumnRenamed("patch_id", which).join(sound.select(which, *frame_cols), which)
        rel = V.sub(V.cols("x", "y", "z"), V.cols("a_cx", "a_cy", "a_cz"))
        return rows.select("pair_id", V.dot(rel, V.items("a_basis_u")).alias("px"), V.dot(rel, V.items("a_basis_v")).alias("py"))

    shared = convex_overlap(flat("first"), flat("second"), "pair_id")
    model = sound.select(*frame_cols, "b_cx", "b_cy", "b_cz", "b_nx", "b_ny", "b_nz")
    site = [F.col("px") * F.col("a_basis_u")[i] + F.col("py") * F.col("a_basis_v")[i] + F.col(f"a_c{a}") for i, a in enumerate("xyz")]
    gap = F.abs(V.dot(V.sub(site, V.cols("b_cx", "b_cy", "b_cz")), V.cols("b_nx", "b_ny", "b_nz")))
    gaps = shared.join(model, "pair_id").select("pair_id", gap.alias("gap"))
    stats = residual_stats(gaps, ["pair_id"], "gap").select(
        "pair_id", F.col("n").alias("overlap_samples"), F.col("median").alias("separation_median_m"),
        F.col("p95").alias("separation_p95_m"), F.col("max").alias("separation_max_m"))
    angle = F.degrees(F.acos(V.clamp(F.abs(V.dot(V.cols("a_nx", "a_ny", "a_nz"), V.cols("b_nx", "b_ny", "b_nz"))), 0.0, 1.0)))
    out = both.where("problem IS NULL").join(stats, "pair_id", "left").select(
        "pair_id", "first", "second", F.when(measured, "measured").otherwise("not measured").alias("status"),
        F.when(measured, F.coalesce("overlap_samples", F.lit(0))).alias("overlap_samples"),
        "separation_median_m", "separation_p95_m", "separation_max_m", F.when(measured, angle).alias("normal_angle_degrees"))
    return out, broken
