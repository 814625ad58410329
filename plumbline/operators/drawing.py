"""Drawing views: clipping, cutting, projecting, shared edges, emission accounts.

A polygon is ``array<array<double>>`` in ring order.  Column functions bind the
polygon once (:func:`plumbline.functions.vectors.let`), so chains of clips stay
linear in size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import grid, vectors as V
from plumbline.functions.joins import by_shuffle
from plumbline.rules import findings
from plumbline.session import cut_lineage

# fixed values: drawing tolerances in metres
EPS = 2e-5
PLANE_DISTANCE = 1e-6
MERGE_DISTANCE = 1e-7
MIN_SEGMENT = 1e-7
MIN_EMITTED = 1e-9
SECTION, PLAN, REFLECTED = "section", "plan", "reflected_ceiling"


def _between(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + t * (y - x))


def clip_halfspace(polygon: Column, axis: Column, value: Column, keep_below: Column) -> Column:
    """The part of a closed polygon on one side of an axis plane."""
    def side(d: Column) -> Column:
        return F.when(keep_below, d <= EPS).otherwise(d >= -EPS)

    def edge(e: Column) -> Column:
        da, db = F.get(e["a"], axis) - value, F.get(e["b"], axis) - value
        kept = F.when(side(da), F.array(e["a"])).otherwise(F.array().cast("array<array<double>>"))
        crosses = (side(da) != side(db)) & (F.abs(da - db) > 1e-12)
        cut = F.when(crosses, F.array(_between(e["a"], e["b"], V.over(da, da - db)))).otherwise(F.array().cast("array<array<double>>"))
        return F.concat(kept, cut)

    return V.let(polygon, lambda p: F.flatten(F.transform(V.ring_edges(p), edge)))


def clip_all(polygon: Column, clips: Column) -> Column:
    """Apply ``array<struct<axis,value_m,keep_below>>`` clips in order; stops below two points."""
    return F.aggregate(clips, polygon, lambda acc, c: F.when(F.size(acc) < 2, acc).otherwise(
        clip_halfspace(acc, c["axis"], c["value_m"], c["keep_below"])))


def intersect_plane(polygon: Column, axis: Column, value: Column) -> Column:
    """Cut points of a convex polygon with an axis plane, near-duplicates merged in order."""
    none = F.array().cast("array<array<double>>")

    def edge(e: Column) -> Column:
        va, vb = F.get(e["a"], axis) - value, F.get(e["b"], axis) - value
        on = F.when(F.abs(va) <= EPS, F.array(e["a"])).otherwise(none)
        through = F.when(va * vb < -EPS * EPS, F.array(_between(e["a"], e["b"], V.over(va, va - vb)))).otherwise(none)
        return F.concat(on, through)

    def merge(acc: Column, p: Column) -> Column:
        return F.when(F.exists(acc, lambda q: V.distance(p, q) < MERGE_DISTANCE), acc).otherwise(F.concat(acc, F.array(p)))

    points = V.let(polygon, lambda p: F.flatten(F.transform(V.ring_edges(p), edge)))
    return F.aggregate(points, none, merge)


def project_drawing(polygon: Column, right: Column, up: Column) -> Column:
    """3-D points to drawing coordinates ``[right, up]``."""
    r, u = V.items(right), V.items(up)
    return F.transform(polygon, lambda p: F.array(V.dot(V.items(p), r), V.dot(V.items(p), u)))


def polygon_segments(points: Column) -> Column:
    """Boundary segments ``{a, b}``: a ring for three or more points, one segment for two."""
    none = F.array().cast("array<struct<a:array<double>,b:array<double>>>")
    return V.let(points, lambda p: F.when(F.size(p) < 2, none).when(
        F.size(p) == 2, F.array(F.struct(p[0].alias("a"), p[1].alias("b")))).otherwise(V.ring_edges(p)))


def segment_length_in_bounds(x0: Column, y0: Column, x1: Column, y1: Column, bounds: Column) -> Column:
    """Length of a 2-D segment inside ``[xmin, xmax, ymin, ymax]``."""
    first, last, outside = F.lit(0.0), F.lit(1.0), F.lit(False)
    for start, end, low, high in ((x0, x1, bounds[0], bounds[1]), (y0, y1, bounds[2], bounds[3])):
        delta = end - start
        flat = F.abs(delta) <= 1e-15
        near, far = V.over(low - start, delta), V.over(high - start, delta)
        outside = outside | (flat & ((start < low) | (start > high)))
        first = F.when(flat, first).otherwise(F.greatest(first, F.least(near, far)))
        last = F.when(flat, last).otherwise(F.least(last, F.greatest(near, far)))
    return F.when(outside | (first >= last), 0.0).otherwise(F.hypot(x1 - x0, y1 - y0) * (last - first))


def segment_is_subsegment(segment: Sequence[Column], source: Sequence[Column], tolerance: float = 1e-7) -> Column:
    """True when both ends of ``(x0, y0, x1, y1)`` lie on the source segment."""
    dx, dy = source[2] - source[0], source[3] - source[1]
    length = dx * dx + dy * dy
    inside = length > tolerance * tolerance
    for x, y in (segment[:2], segment[2:]):
        t = V.over((x - source[0]) * dx + (y - source[1]) * dy, length)
        gap = F.hypot(x - source[0] - t * dx, y - source[1] - t * dy)
        inside = inside & (t >= -tolerance) & (t <= 1 + tolerance) & (gap <= tolerance)
    return F.coalesce(inside, F.lit(False))


def point_collapse(selected: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct finite vertices per selection; one distinct vertex means nothing to draw.

    ``selected`` has one row per selected face corner with ``x, y, z``.
    """
    finite = V.finite(F.col("x")) & V.finite(F.col("y")) & V.finite(F.col("z"))
    points = selected.groupBy(*keys, "x", "y", "z").agg(F.bool_and(finite).alias("__ok"))
    out = points.groupBy(*keys).agg(F.count("*").alias("unique_point_count"), F.bool_and("__ok").alias("finite"))
    return out.select(*keys, "finite", F.when(F.col("finite"), F.col("unique_point_count")).otherwise(0).alias("unique_point_count"),
                      (F.col("finite") & (F.col("unique_point_count") == 1)).alias("all_vertices_coincident"))


def view_cut_pipeline(views: DataFrame, subjects: DataFrame, polygons: DataFrame, triangles: DataFrame) -> DataFrame:
    """Drawn segments per view, object and face.

    ``views(view_id, kind, right_frame, up_frame, cut, clips)``, ``subjects(view_id,
    object_id, face, clips)``, ``polygons(object_id, face, polygon)`` and
    ``triangles(object_id, face, polygon)`` in the drawing frame.  A section cuts
    triangles unless the face lies in the cut plane; plans and reflected ceilings
    clip at the cut; other views only project.
    """
    v = views.select("view_id", "kind", "right_frame", "up_frame", "cut", F.col("clips").alias("__view_clips"))
    chosen = subjects.join(v, "view_id").withColumn("__clips", F.concat("__view_clips", "clips")).drop("__view_clips", "clips")
    faces = chosen.join(by_shuffle(polygons), ["object_id", "face"])
    off_plane = F.exists("polygon", lambda p: F.abs(F.get(p, F.col("cut")["axis"]) - F.col("cut")["value_m"]) > EPS)
    split = F.coalesce((F.col("kind") == SECTION) & off_plane, F.lit(False))
    whole = faces.where(~split)
    parts = faces.where(split).drop("polygon").join(by_shuffle(triangles), ["object_id", "face"])
    pieces = whole.unionByName(parts.select(whole.columns))
    cut = F.col("cut")
    shaped = (
        F.when(F.col("kind") == SECTION, intersect_plane(F.col("__p"), cut["axis"], cut["value_m"]))
        .when(F.col("kind").isin(PLAN, REFLECTED), clip_halfspace(F.col("__p"), cut["axis"], cut["value_m"], cut["keep_below"]))
        .otherwise(F.col("__p")))
    clipped = pieces.withColumn("__p", clip_all(F.col("polygon"), F.col("__clips"))).where(F.size("__p") >= 2)
    flat = clipped.withColumn("__f", shaped).where(F.size("__f") >= 2)
    segments = flat.select("view_id", "object_id", "face", F.explode(
        polygon_segments(project_drawing(F.col("__f"), F.col("right_frame"), F.col("up_frame")))).alias("s"))
    ends = segments.select("view_id", "object_id", "face", F.col("s.a")[0].alias("x0"), F.col("s.a")[1].alias("y0"),
                           F.col("s.b")[0].alias("x1"), F.col("s.b")[1].alias("y1"))
    return ends.where(F.hypot(F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")) > MIN_SEGMENT)


def unique_segments(segments: DataFrame, keys: Sequence[str], places: int = 7) -> DataFrame:
    """Segments without repeats, ends rounded and ordered."""
    a = F.struct(F.bround("x0", places).alias("x"), F.bround("y0", places).alias("y"))
    b = F.struct(F.bround("x1", places).alias("x"), F.bround("y1", places).alias("y"))
    return segments.select(*keys, F.least(a, b).alias("p"), F.greatest(a, b).alias("q")).dropDuplicates()


def view_emission(views: DataFrame, subjects: DataFrame, segments: DataFrame, collapsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per view and object: drawn, omitted or non-drawable; and per view: emitted length.

    ``subjects(view_id, object_id)`` rows as selected, ``collapsed(view_id,
    object_id)`` the point-collapsed ones.
    """
    inside = segments.join(views.select("view_id", "bounds"), "view_id").withColumn(
        "len", segment_length_in_bounds(*V.cols("x0", "y0", "x1", "y1"), F.col("bounds")))
    per_face = inside.groupBy("view_id", "object_id", "face").agg(F.sum("len").alias("len"), F.max("len").alias("best"), F.count("*").alias("n"))
    per_object = per_face.groupBy("view_id", "object_id").agg(
        F.sum("n").alias("segments"), F.sum("len").alias("emitted_m"), F.count_if(F.col("best") > MIN_EMITTED).alias("faces_used"))
    flagged = collapsed.select("view_id", "object_id", F.lit(True).alias("__collapsed")).distinct()
    rows = subjects.select("view_id", "object_id").distinct().join(by_shuffle(per_object), ["view_id", "object_id"], "left").join(
        by_shuffle(flagged), ["view_id", "object_id"], "left")
    status = (F.when(F.col("__collapsed"), "selected_polygon_vertices_coincident")
              .when(F.col("segments").isNull(), "selected_faces_emitted_no_segments_after_cuts_or_clips")
              .when(F.col("faces_used") == 0, "selected_faces_have_no_segments_inside_declared_bounds").otherwise("drawn"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    objects = rows.select("view_id", "object_id", status.alias("status"), zero("segments").alias("segments"), zero("emitted_m").cast("double").alias("emitted_m"))
    totals = objects.groupBy("view_id").agg(F.sum("emitted_m").alias("emitted_m"))
    per_view = views.select("view_id").join(totals, "view_id", "left").select(
        "view_id", zero("emitted_m").cast("double").alias("emitted_m"), (zero("emitted_m") > MIN_EMITTED).alias("emits"))
    return objects, per_view


def piece_edges(pieces: DataFrame, tolerance: float) -> DataFrame:
    """Edges ``(group_id, piece_id, edge, ax..bz)`` longer than the tolerance; two points make one edge."""
    edges = pieces.select("group_id", "piece_id", F.posexplode(polygon_segments(F.col("polygon"))).alias("edge", "s"))
    flat = edges.select("group_id", "piece_id", "edge", *[F.col(f"s.{e}")[i].alias(f"{e}{c}") for e in "ab" for i, c in enumerate("xyz")])
    return flat.where(V.norm(V.sub(V.cols("bx", "by", "bz"), V.cols("ax", "ay", "az"))) > tolerance)


def split_at_junctions(edges: DataFrame, tolerance: float, cell_m: float) -> DataFrame:
    """Cut every edge where a corner of another piece lies on it.

    Corners meet only the edges passing through their grid cell.
    """
    a, b = V.cols("ax", "ay", "az"), V.cols("bx", "by", "bz")
    cells = ["__ix", "__iy", "__iz"]
    corner = F.explode(F.array(*[F.struct(*[F.col(f"{e}{c}").alias(f"p{c}") for c in "xyz"]) for e in "ab"]))
    # a corner shared by many pieces is one row: it splits an edge when any owner is another piece
    ends = edges.select("group_id", "piece_id", corner.alias("p")).groupBy("group_id", "p.px", "p.py", "p.pz").agg(
        F.min("piece_id").alias("__first"), F.max("piece_id").alias("__last"))
    shift = 0.381966 * cell_m  # keeps corners on round coordinates away from cell borders
    p = V.cols("px", "py", "pz")
    ends = ends.withColumns({n: grid.cell_of(c + shift, cell_m) for n, c in zip(cells, p)})
    lows, highs = [F.least(x, y) - tolerance for x, y in zip(a, b)], [F.greatest(x, y) + tolerance for x, y in zip(a, b)]
    covered = grid.cover(edges, [c + shift for c in lows], [c + shift for c in highs], cell_m, cells)
    met = covered.join(ends, ["group_id", *cells]).where(
        (F.col("__first") != F.col("piece_id")) | (F.col("__last") != F.col("piece_id")))
    for c, low, high in zip(p, lows, highs):
        met = met.where((c >= low) & (c <= high))
    delta, rel = V.sub(b, a), V.sub(p, a)
    t = V.over(V.dot(rel, delta), V.dot(delta, delta))

    def on_edge(t: Column) -> Column:
        return (t >= -tolerance) & (t <= 1 + tolerance) & (V.norm(V.sub(rel, V.scale(delta, t))) <= tolerance)

    met = met.where(V.let(t, on_edge)).withColumn("__t", t)
    inner = F.when(V.norm(rel) <= tolerance, 0.0).when(V.norm(V.sub(p, b)) <= tolerance, 1.0).otherwise(V.clamp(F.col("__t"), 0.0, 1.0))
    marks = met.select("group_id", "piece_id", "edge", F.round(inner, 12).alias("t")).distinct()
    listed = marks.groupBy("group_id", "piece_id", "edge").agg(F.collect_list("t").alias("ts"))
    joined = edges.join(listed, ["group_id", "piece_id", "edge"], "left")
    stops = F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0.0), F.lit(1.0)), F.coalesce("ts", F.array().cast("array<double>")))))
    joined = joined.withColumn("ts", stops)
    spans = joined.select("*", F.posexplode(F.slice("ts", 1, F.size("ts") - 1)).alias("part", "t0")).withColumn("t1", F.get("ts", F.col("part") + 1))
    at = lambda t, e: [(x + F.col(t) * (y - x)).alias(f"{e}{c}") for c, x, y in zip("xyz", a, b)]
    pieces = spans.select("group_id", "piece_id", *at("t0", "a"), *at("t1", "b"))
    return pieces.where(V.norm(V.sub(V.cols("bx", "by", "bz"), V.cols("ax", "ay", "az"))) > tolerance)


def shared_edge_match(pieces: DataFrame, tolerance: float = 1e-7, line_tolerance: float | None = None, cell_m: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Outer boundary of coplanar pieces ``(group_id, piece_id, polygon)`` with the owning piece.

    Edges used by two pieces cancel.  Returns boundary segments and findings for
    edges used by more than two pieces or twice by one.  Exact copies are counted
    before the neighbour join, so a pile of identical edges is one row there.
    """
    line_tolerance = tolerance if line_tolerance is None else line_tolerance
    parts = split_at_junctions(cut_lineage(piece_edges(pieces, tolerance)), tolerance, cell_m)
    a, b = (F.struct(*[F.col(f"{e}{c}").alias(c) for c in "xyz"]) for e in "ab")
    ordered = parts.select("group_id", "piece_id", F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))
    uses = ordered.groupBy("group_id", "p", "q").agg(
        F.count("*").alias("n"), F.min("piece_id").alias("owner"), F.max("piece_id").alias("last_owner"))
    flat = uses.select("group_id", "n", "owner", "last_owner", *[F.col(f"{s}.{c}").alias(f"{s}{c}") for s in "pq" for c in "xyz"])
    flat = cut_lineage(flat)
    cells, size = ["__ix", "__iy", "__iz"], 64 * tolerance
    middle = lambda s: [(F.col(f"{s}p{c}") + F.col(f"{s}q{c}")) / 2 for c in "xyz"]
    home = flat.withColumns({n: grid.cell_of(m, size) for n, m in zip(cells, middle(""))})
    other = flat.select("group_id", *[F.col(c).alias(f"o_{c}") for c in flat.columns if c != "group_id"])
    around = grid.neighbours(other, middle("o_"), tolerance, size, cells)
    close = home.join(around, ["group_id", *cells])
    end = lambda prefix, s: V.cols(*[f"{prefix}{s}{c}" for c in "xyz"])
    gap = lambda s, o: V.norm(V.sub(end("", s), end("o_", o)))
    same = F.greatest(gap("p", "p"), gap("q", "q")) <= tolerance
    turned = F.greatest(gap("p", "q"), gap("q", "p")) <= tolerance
    line = V.sub(end("o_", "q"), end("o_", "p"))
    off = [V.over(V.norm(V.cross(V.sub(end("", s), end("o_", "p")), line)), V.norm(line)) for s in "pq"]
    matched = close.where((same | turned) & (F.greatest(*off) <= line_tolerance))
    keys = ["group_id", *[f"{s}{c}" for s in "pq" for c in "xyz"]]
    total = matched.groupBy(*keys).agg(  # a segment always meets itself
        F.sum("o_n").alias("uses"), F.min("o_owner").alias("first_piece"), F.max("o_last_owner").alias("last_piece"),
        F.max(F.when(same & (gap("p", "p") == 0) & (gap("q", "q") == 0), F.col("o_owner"))).alias("owner"))
    boundary = total.where("uses = 1").select("group_id", F.col("owner").alias("piece_id"), *keys[1:])
    bad = total.where((F.col("uses") > 2) | ((F.col("uses") == 2) & (F.col("first_piece") == F.col("last_piece"))))
    return boundary, bad.select(F.lit("non_manifold_edge").alias("rule"), F.col("group_id").cast("string").alias("entity_id"), F.col("uses").cast("string").alias("detail"))


def boundary_owner(boundary: DataFrame) -> DataFrame:
    """Boundary length per owning piece."""
    length = V.norm(V.sub(V.cols("qx", "qy", "qz"), V.cols("px", "py", "pz")))
    return boundary.groupBy("group_id", "piece_id").agg(F.count("*").alias("segments"), F.sum(length).alias("length_m"))


# --- checks on view declarations --------------------------------------------

def check_view_frame(views: DataFrame, tolerance: float = 1e-7) -> DataFrame:
    """Unit, orthogonal frames with right = direction × up (negated when reflected)."""
    r, u, d = V.items("right_frame"), V.items("up_frame"), V.items("view_direction_frame")
    whole = F.lit(True)
    for name in ("right_frame", "up_frame", "view_direction_frame"):
        whole = whole & V.finite_array(F.col(name), 3)
    reflected = F.coalesce("reflected", F.lit(False))
    off_unit = F.greatest(*[F.abs(V.norm(v) - 1) for v in (r, u, d)]) > tolerance + 1e-5
    off_square = F.greatest(*[F.abs(V.dot(*p)) for p in ((r, u), (r, d), (u, d))]) > tolerance
    sign = F.when(reflected, -1.0).otherwise(1.0)
    # relative part as in a closeness test against the expected component
    wrong = F.greatest(*[F.abs(x - e * sign) - 1e-5 * F.abs(e) for x, e in zip(r, V.cross(d, u))]) > tolerance
    upward = F.greatest(F.abs(d[0]), F.abs(d[1]), F.abs(d[2] - 1) - 1e-5) <= tolerance
    return findings(views, F.col("view_id"), {
        "frame_not_finite": (~whole, None),
        "frame_not_unit": (whole & off_unit, None),
        "frame_not_orthogonal": (whole & off_square, None),
        "reflection_kind": (reflected & (F.col("kind") != REFLECTED), F.col("kind")),
        "reflection_direction": (reflected & whole & ~upward, None),
        "right_not_cross": (whole & wrong, None),
        "reflection_undeclared": ((F.col("kind") == REFLECTED) & ~reflected, None),
    })


def check_section_marks(marks: DataFrame, views: DataFrame) -> DataFrame:
    """Each mark names exactly one section view whose cut and direction it repeats."""
    sections = views.where(F.col("kind") == SECTION).groupBy(F.col("view_id").alias("section_id")).agg(
        F.count("*").alias("__n"), F.max(F.struct("cut.axis", "cut.value_m")).alias("__cut"), F.max("view_direction_frame").alias("__dir"))
    j = marks.join(sections, "section_id", "left")
    matched = F.coalesce(F.col("__n") == 1, F.lit(False))
    dx, dy = F.col("arrow_to")[0] - F.col("arrow_from")[0], F.col("arrow_to")[1] - F.col("arrow_from")[1]
    px, py = F.col("__dir")[0], F.col("__dir")[1]
    finite = V.finite_array(F.col("arrow_from"), 2) & V.finite_array(F.col("arrow_to"), 2)
    length, reach = F.hypot(dx, dy), F.hypot(px, py)
    same_cut = (F.col("axis") == F.col("__cut.axis")) & (F.abs(F.col("value_m") - F.col("__cut.value_m")) <= 1e-9)
    follows = (length > 1e-12) & (reach > 1e-12) & (F.abs(dx * py - dy * px) <= 1e-7 * length * reach) & (dx * px + dy * py > 0)
    return findings(j, F.col("mark_id"), {
        "section_not_found": (~matched, F.col("section_id")),
        "cut_differs": (matched & ~F.coalesce(same_cut, F.lit(False)), F.col("section_id")),
        "not_plan_axis": (matched & ~F.col("axis").isin(0, 1), F.col("axis")),
        "arrow_not_finite": (~finite, None),
        "arrow_direction": (matched & finite & ~F.coalesce(follows, F.lit(False)), F.col("section_id")),
    })


def section_mark_join(marks: DataFrame, views: DataFrame) -> DataFrame:
    """Marks with the number of section views they match."""
    sections = views.where(F.col("kind") == SECTION).groupBy(F.col("view_id").alias("section_id")).agg(F.count("*").alias("matches"))
    return marks.join(sections, "section_id", "left").withColumn("matches", F.coalesce("matches", F.lit(0)))
