"""Row rules on cameras, frames, marks, archives, contracts: findings, not exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

import pandas as pd

from plumbline.functions import grid, vectors as V
from plumbline.rules import findings

# fixed values: accepted vocabularies, id patterns and tolerances
ID_PATTERN = r"\A[A-Za-z0-9][A-Za-z0-9._-]*\z"
SHA256_PATTERN = r"\A[0-9a-f]{64}\z"
ENDPOINT_KINDS = ("visible physical termination", "occlusion", "image boundary", "annotation boundary", "unknown")
MARK_MINIMUM = {"point": 1, "polyline": 2, "polygon": 3}
DELIVERABLES = ("native", "glb", "stills", "viewer", "sources")
APPEARANCE_METHODS = ("matched-color", "photo-projection", "repeated-photo", "inferred")
DISPOSITIONS = ("current-eligible", "retired", "excluded-source")
PRESENTATION_MODES = ("first-person-walkthrough", "cutaway-orbit")
RENDER_ENGINES = ("BLENDER_EEVEE", "CYCLES")
MATERIAL_MODE = "materials-and-textures"
CAMERA_RIGID, PLANE_RIGID, JOB_RIGID = 1e-4, 1e-6, 1e-5
GENERATED_ROOTS = ("all", "overview", ".source-manifest.json")


def blank(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def rigid_rules(matrix: Column, tolerance: float, homogeneous: float = 1e-7) -> dict[str, tuple[Column, None]]:
    """Finite, homogeneous, orthonormal, proper — one rule set, the tolerance is the caller's."""
    whole = V.finite_array(matrix, 16)
    return {
        "pose_incomplete": (~whole, None),
        "pose_not_homogeneous": (whole & (V.homogeneous_error(matrix) > homogeneous), None),
        "pose_not_rigid": (whole & (V.gram_error(matrix) > tolerance), None),
        "pose_not_proper": (whole & (F.abs(V.determinant3(matrix) - 1) > tolerance), None),
    }


def check_rigid(df: DataFrame, entity: str, matrix: str = "matrix", tolerance: float = PLANE_RIGID) -> DataFrame:
    return findings(df, F.col(entity), rigid_rules(F.col(matrix), tolerance))


def check_camera(cameras: DataFrame, entity: str = "frame_id") -> DataFrame:
    """Finite positive intrinsics, whole image size, complete proper rigid pose."""
    rules = {}
    for name in ("width", "height", "fx", "fy", "cx", "cy"):
        value = F.col(name).cast("double")
        rules[f"{name}_not_finite"] = (~V.finite(value), value)
        if name in ("width", "height", "fx", "fy"):
            rules[f"{name}_not_positive"] = (V.finite(value) & (value <= 0), value)
        if name in ("width", "height"):
            rules[f"{name}_not_integer"] = (V.finite(value) & (value != F.floor(value)), value)
    return findings(cameras, F.col(entity), rules | rigid_rules(F.col("pose"), CAMERA_RIGID))


def check_depth_frame(frames: DataFrame, entity: str = "frame_id") -> DataFrame:
    """Depth, confidence and photo sizes of one frame must agree.

    ``frames(depth_width, depth_height, confidence_width, confidence_height,
    rgb_width, rgb_height, width, height)``.
    """
    c = F.col
    return findings(frames, F.col(entity), {
        "depth_empty": ((c("depth_width") <= 0) | (c("depth_height") <= 0), None),
        "confidence_size": ((c("confidence_width") != c("depth_width")) | (c("confidence_height") != c("depth_height")), None),
        "aspect_ratio": (c("depth_width").cast("long") * c("height") != c("depth_height").cast("long") * c("width"), None),
        "rgb_size": ((c("rgb_width") != c("width")) | (c("rgb_height") != c("height")), None),
    })


SHORT_RING = 1024  # rings of up to this many edges are judged inside their row


def check_polygon_ring(polygons: DataFrame, entity: str = "polygon_id", planarity: float = 1e-7, boundary: float = 1e-9, short: int = SHORT_RING) -> DataFrame:
    """At least three finite, coplanar vertices forming a simple, non-degenerate ring.

    Rings of up to ``short`` edges are read once and judged in Arrow batches, their edges meeting in a sweep; what is stored of them is the verdict. Edges of
    longer rings are rows that meet in cells of their mean length, so their cost grows with their edges and not with their pairs.
    """
    from plumbline.functions import rings as R
    from plumbline.session import cut_lineage, small_batches

    small_batches(polygons.sparkSession)
    # rings that are still an expression would be computed again for every use
    polygons = V.once(polygons.select(entity, F.col("vertices").alias("__v")), {"vertices": F.col("__v")}).drop("__v")
    long = F.coalesce(F.size("vertices") > short, F.lit(False))
    judged = cut_lineage(polygons.select(
        entity, R.faults_of(planarity, boundary)(F.when(~long, F.col("vertices"))).alias("__faults"), F.when(long, F.col("vertices")).alias("vertices")))
    has = lambda fault: (F.col("__faults").bitwiseAND(F.lit(fault)) != 0, None)
    found = findings(judged.where("vertices IS NULL"), F.col(entity), {
        "ring_not_finite": has(R.NOT_FINITE), "ring_degenerate": has(R.DEGENERATE), "ring_not_coplanar": has(R.NOT_COPLANAR), "ring_not_simple": has(R.NOT_SIMPLE)})
    longer = judged.where("vertices IS NOT NULL").select(entity, "vertices")
    return found if longer.isEmpty() else found.unionByName(_check_long_rings(longer, entity, planarity, boundary))


def _check_long_rings(polygons: DataFrame, entity: str, planarity: float, boundary: float) -> DataFrame:
    """Findings of stored rings whose edges are rows."""
    from plumbline.functions import rings as R
    from plumbline.functions.joins import by_shuffle
    from plumbline.operators.surfaces import polygon_frames
    from plumbline.session import cut_lineage, spread_out

    finite = F.coalesce((F.size("vertices") >= 3) & F.forall("vertices", lambda p: V.finite_array(p, 3)), F.lit(False))
    shape = findings(polygons, F.col(entity), {"ring_not_finite": (~finite, None)})
    usable = polygons.where(finite).withColumn("__area", V.let(V.fan_normal(F.col("vertices")), lambda n: V.norm(V.items(n))))
    longest = F.array_max(F.transform(V.ring_edges(F.col("vertices")), lambda e: V.distance(e["a"], e["b"])))
    usable = cut_lineage(usable.withColumn("__flat", F.col("__area") <= 1e-12 * longest * longest))
    degenerate = findings(usable, F.col(entity), {"ring_degenerate": (F.col("__flat"), None)})
    framed = polygon_frames(usable.where(~F.col("__flat")).select(entity, "vertices"))
    framed = cut_lineage(framed.withColumn("__ring_id", F.monotonically_increasing_id()))
    off = F.array_max(F.transform("vertices", lambda p: F.abs(V.dot(V.sub(V.items(p), V.items("origin")), V.items("normal")))))
    n = F.size("ring")
    edges = F.transform("ring", lambda p, i: F.struct(i.alias("i"), p.alias("a"), F.col("ring")[(i + 1) % n].alias("b")))

    def apart(first: Column, second: Column, count: Column) -> Column:
        """Two edges of the ring that are not neighbours."""
        gap = second["i"] - first["i"]
        return (gap > 1) & ~((first["i"] == 0) & (second["i"] == count - 1))

    flat = F.coalesce(off <= planarity, F.lit(False))
    ring = findings(framed, F.col(entity), {"ring_not_coplanar": (~flat, None)})

    span = F.greatest(*[F.array_max(F.transform("ring", lambda p: p[c])) - F.array_min(F.transform("ring", lambda p: p[c])) for c in "xy"])
    around = F.aggregate(edges, F.lit(0.0), lambda acc, e: acc + F.hypot(e["b"]["x"] - e["a"]["x"], e["b"]["y"] - e["a"]["y"]))
    cell = F.greatest(around / n, span / n, F.lit(4 * boundary))
    rings = V.once(framed.where(flat), {"__n": n, "__cell": cell, "__edges": edges})  # not once per edge
    rows = spread_out(cut_lineage(rings.select("__ring_id", entity, "__n", "__cell", F.explode("__edges").alias("e"))))
    # an edge lies in the cells of its pieces, each no longer than a cell: all edges together have at most twice as many pieces as edges
    pieces = F.greatest(F.ceil(F.hypot(F.col("e.b.x") - F.col("e.a.x"), F.col("e.b.y") - F.col("e.a.y")) / F.col("__cell")), F.lit(1)).cast("int")
    rows = rows.select("*", pieces.alias("__m"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("__k"))
    ends = {c: [F.col("e.a")[c] + (F.col("e.b")[c] - F.col("e.a")[c]) * (F.col("__k") + j) / F.col("__m") for j in (0, 1)] for c in "xy"}
    pad = boundary + F.col("__cell") * 1e-6
    low = [F.least(*ends[c]) - pad for c in "xy"]
    high = [F.greatest(*ends[c]) + pad for c in "xy"]
    celled = grid.cover(rows, low, high, F.col("__cell"), ["__cx", "__cy"])
    celled = celled.drop("__k", "__m")
    other = celled.select("__ring_id", "__cx", "__cy", F.col("e").alias("g"))
    met = celled.join(by_shuffle(other), ["__ring_id", "__cx", "__cy"]).where(apart(F.col("e"), F.col("g"), F.col("__n")))
    corners = [F.col(f"{e}.{p}.{c}") for e in "eg" for p in "ab" for c in "xy"]
    for i in (0, 1):  # plain comparisons first: most edges of a cell do not even have boxes that meet
        (a, b), (c, d) = corners[i:4:2], corners[4 + i::2]
        met = met.where((F.least(a, b) <= F.greatest(c, d) + 2 * pad) & (F.least(c, d) <= F.greatest(a, b) + 2 * pad))
    crossed = met.where(R.touch_of(boundary)(F.array(*corners))).select("__ring_id", entity).distinct()
    long = crossed.select(F.lit("ring_not_simple").alias("rule"), F.col(entity).cast("string").alias("entity_id"), F.lit(None).cast("string").alias("detail"))
    return shape.unionByName(degenerate).unionByName(ring).unionByName(long)


def check_marks(observations: DataFrame) -> DataFrame:
    """Mark type, coordinate count, finite pairs and native bounds.

    ``observations(id, mark_type, meaning, coords array<struct<u,v>>, width, height)``.
    """
    size = F.coalesce(F.size("coords"), F.lit(0))
    least = F.coalesce(*[F.when(F.col("mark_type") == k, n) for k, n in MARK_MINIMUM.items()])
    finite = F.coalesce(F.forall("coords", lambda p: V.finite(p["u"]) & V.finite(p["v"])), F.lit(False))
    inside = F.forall("coords", lambda p: (p["u"] >= 0) & (p["u"] <= F.col("width") - 1) & (p["v"] >= 0) & (p["v"] <= F.col("height") - 1))
    return findings(observations, F.col("id"), {
        "mark_type": (least.isNull(), F.col("mark_type")),
        "mark_meaning": (blank(F.col("meaning")), None),
        "too_few_coordinates": (least.isNotNull() & (size < least), size),
        "point_has_several": ((F.col("mark_type") == "point") & (size > 1), size),
        "coordinate_not_finite": (~finite, None),
        "coordinate_outside": (finite & ~F.coalesce(inside, F.lit(False)), None),
    })


def check_endpoints(observations: DataFrame) -> DataFrame:
    """Polylines declare both ends with a known kind and a basis; other marks declare none."""
    line = F.col("mark_type") == "polyline"
    ends = F.col("endpoints")
    indexes = F.array_sort(F.transform(ends, lambda e: e["index"]))
    return findings(observations, F.col("id"), {
        "endpoints_missing": (ends.isNull(), None),
        "endpoints_on_other_mark": (~line & (F.coalesce(F.size(ends), F.lit(0)) > 0), F.col("mark_type")),
        "endpoint_indexes": (line & F.coalesce(indexes != F.array(F.lit(-1), F.lit(0)), F.lit(False)), F.array_join(indexes.cast("array<string>"), ",")),
        "endpoint_kind": (line & F.coalesce(F.exists(ends, lambda e: ~F.coalesce(e["kind"].isin(*ENDPOINT_KINDS), F.lit(False))), F.lit(False)), None),
        "endpoint_basis": (line & F.coalesce(F.exists(ends, lambda e: blank(e["basis"])), F.lit(False)), None),
    })


def check_ids(df: DataFrame, entity: str, ids: tuple[str, ...] = (), hashes: tuple[str, ...] = (), filled: tuple[str, ...] = (),
              numbers: tuple[str, ...] = (), minima: dict[str, int] | None = None) -> DataFrame:
    """Safe ids, lowercase SHA-256, non-empty strings, finite numbers, integer minima."""
    rules = {f"{c}_not_safe": (~F.col(c).rlike(ID_PATTERN), F.col(c)) for c in ids}
    rules |= {f"{c}_not_sha256": (~F.col(c).rlike(SHA256_PATTERN), F.col(c)) for c in hashes}
    rules |= {f"{c}_empty": (blank(F.col(c)), None) for c in filled}
    rules |= {f"{c}_not_finite": (~V.finite(F.col(c).cast("double")), F.col(c)) for c in numbers}
    rules |= {f"{c}_below_minimum": (F.col(c) < low, F.col(c)) for c, low in (minima or {}).items()}
    return findings(df, F.col(entity), rules)


@F.pandas_udf(T.StringType())
def nfc_casefold(text: pd.Series) -> pd.Series:
    """Unicode NFC then full case folding, which no built-in does."""
    return text.str.normalize("NFC").str.casefold()


def check_archive_paths(members: DataFrame) -> DataFrame:
    """Unsafe member names (NUL included), links, special files and reserved roots.

    ``members(archive_id, name, is_dir, mode)``; ``mode`` is the Unix mode.
    """
    name, kind = F.col("name"), F.shiftright("mode", 12).bitwiseAND(F.lit(15))
    bare = F.regexp_replace(name, "/+$", "")
    parts = F.split(bare, "/", -1)
    trailing = name != F.concat(bare, F.when(F.col("is_dir"), "/").otherwise(""))
    unsafe = (
        (name == "") | name.contains("\\") | name.contains("\0") | name.startswith("/") | name.rlike("^[A-Za-z]:") | trailing
        | F.exists(parts, lambda p: p.isin("", ".", "..")))
    return findings(members, F.concat_ws("/", F.col("archive_id").cast("string"), name), {
        "unsafe_path": (unsafe, None),
        "symlink": (kind == 10, None),
        "special_file": (~kind.isin(0, 4, 8, 10), kind),
        "reserved_root": (nfc_casefold(F.get(parts, F.lit(0))).isin(*GENERATED_ROOTS), None),
    })


def member_prefixes(members: DataFrame) -> DataFrame:
    """Every leading path of every member with its folded form: one folding call per name."""
    bare = F.regexp_replace("name", "/+$", "")
    pairs = members.select("archive_id", "is_dir", bare.alias("path"), nfc_casefold(bare).alias("folded"))
    depth = F.size(F.split("path", "/"))
    levels = pairs.select("*", depth.alias("depth"), F.explode(F.sequence(F.lit(1), depth)).alias("level"))
    return levels.select(
        "archive_id", F.array_join(F.slice(F.split("path", "/"), 1, F.col("level")), "/").alias("prefix"),
        F.array_join(F.slice(F.split("folded", "/"), 1, F.col("level")), "/").alias("alias"),
        ((F.col("level") == F.col("depth")) & ~F.col("is_dir")).alias("is_file"))


def alias_conflict(members: DataFrame) -> DataFrame:
    """Names that differ but fold to the same alias, or that repeat."""
    prefixes = member_prefixes(members).groupBy("archive_id", "alias").agg(F.min("prefix").alias("one"), F.max("prefix").alias("other"))
    spelled = prefixes.where("one <> other").select("archive_id", "alias", F.lit("alias").alias("kind"))
    bare = members.select("archive_id", nfc_casefold(F.regexp_replace("name", "/+$", "")).alias("alias"))
    repeated = bare.groupBy("archive_id", "alias").agg(F.count("*").alias("n")).where("n > 1").select("archive_id", "alias", F.lit("duplicate").alias("kind"))
    return spelled.unionByName(repeated)


def file_dir_conflict(members: DataFrame) -> DataFrame:
    """Folded names used both as a file and as a directory."""
    used = member_prefixes(members).groupBy("archive_id", "alias").agg(F.bool_or("is_file").alias("f"), F.bool_or(~F.col("is_file")).alias("d"))
    return used.where("f AND d").select("archive_id", "alias")


def single_root(members: DataFrame, marker: str = "keyframes") -> DataFrame:
    """The directory that holds ``keyframes`` per archive; exactly one is acceptable."""
    parts = F.split(F.regexp_replace("name", "/+$", ""), "/")
    at = F.filter(F.sequence(F.lit(1), F.size("parts")), lambda i: F.get("parts", i - 1) == marker)
    roots = members.select("archive_id", parts.alias("parts")).select("archive_id", F.explode_outer(
        F.transform(at, lambda i: F.array_join(F.slice("parts", 1, i - 1), "/"))).alias("root"))
    merged = roots.groupBy("archive_id").agg(F.min("root").alias("root"), F.max("root").alias("other"))
    ok = F.coalesce(F.col("root") == F.col("other"), F.lit(False))
    return merged.select("archive_id", F.when(ok, F.col("root")).alias("root"), ok.alias("single"))


def check_relative_paths(df: DataFrame, entity: str, path: str, files: DataFrame, root: str = "root") -> DataFrame:
    """Paths must be relative, stay inside their root and exist among ``files(path)``."""
    from plumbline.operators.integrity import normal_path

    resolved = normal_path(F.concat_ws("/", F.col(root), F.col(path)))
    inside = resolved.startswith(F.concat(normal_path(F.col(root)), F.lit("/")))
    known = files.select(normal_path(F.col("path")).alias("__resolved"), F.lit(True).alias("__exists")).distinct()
    j = df.withColumn("__resolved", resolved).withColumn("__inside", inside).join(known, "__resolved", "left")
    absolute = F.col(path).startswith("/")
    return findings(j, F.col(entity), {
        "path_absolute": (absolute, F.col(path)),
        "path_escapes": (~absolute & ~F.col("__inside"), F.col(path)),
        "path_missing": (~absolute & F.col("__inside") & F.col("__exists").isNull(), F.col(path)),
    })


def check_tracking_scope(patches: DataFrame, cameras: DataFrame, on: tuple[str, ...] = ("frame_id",)) -> DataFrame:
    """A declared tracking segment must equal the raw camera's; an unknown one stays NULL."""
    actual = cameras.select(*on, F.col("tracking_segment").alias("camera_segment"))
    j = patches.join(actual, list(on), "left")
    declared = F.col("tracking_segment").isNotNull()
    return findings(j, F.col("patch_id"), {
        "segment_unavailable": (declared & F.col("camera_segment").isNull(), F.col("tracking_segment")),
        "segment_differs": (declared & F.col("camera_segment").isNotNull() & (F.col("camera_segment") != F.col("tracking_segment")), F.col("camera_segment")),
    })


def check_contract(jobs: DataFrame, objects: DataFrame, materials: DataFrame, views: DataFrame, excluded: DataFrame) -> DataFrame:
    """Declared-value rules of delivery jobs (references are :func:`contract_fk`'s).

    ``jobs(job_id, schema_version, units, title, deliverables, interpolation_authorized,
    basis, geometry_status, metric_status, model_scope)``; ``objects(job_id, id, name,
    room, level, role)``; ``materials(job_id, id, method, color, basis, sources,
    roughness, metallic, transmission, mapping_u, mapping_v, size_m)``; ``views(job_id,
    id, camera, required_objects, minimum_pixels)``; ``excluded(job_id, name, reason)``.
    """
    c = F.col
    named = lambda *p: F.concat_ws("/", *[c(x).cast("string") for x in p])
    unit_range = lambda x: F.coalesce(~c(x).between(0, 1), F.lit(False))
    view_count = views.groupBy("job_id").agg(F.count("*").alias("__views"))
    job_rows = jobs.join(view_count, "job_id", "left").withColumn("__views", F.coalesce("__views", F.lit(0)))
    out = findings(job_rows, c("job_id"), {
        "schema_version": (c("schema_version") != 1, c("schema_version")),
        "units": (c("units") != "m", c("units")),
        "title": (blank(c("title")), None),
        "deliverables": ((F.size("deliverables") == 0) | (F.size(F.array_distinct("deliverables")) != F.size("deliverables"))
                         | (F.size(F.array_except("deliverables", F.array(*map(F.lit, DELIVERABLES)))) > 0), F.array_join("deliverables", ",")),
        "interpolation_undeclared": (c("interpolation_authorized").isNull(), None),
        "basis": (blank(c("basis")), None),
        "geometry_status": (~c("geometry_status").isin("tentative", "accepted"), c("geometry_status")),
        "metric_status": (blank(c("metric_status")), None),
        "model_scope": (~c("model_scope").isin("full-model", "selected-objects"), c("model_scope")),
        "views_required": ((c("__views") == 0) & (F.array_contains("deliverables", "stills") | F.array_contains("deliverables", "viewer")), None),
    })
    out = out.unionByName(findings(objects, named("job_id", "id"), {
        "object_id": (~c("id").cast("string").rlike(ID_PATTERN), c("id")),
        "object_name": (blank(c("name")), None),
        "object_place": (blank(c("room")) | blank(c("level")) | blank(c("role")), None),
    }))
    names = objects.groupBy("job_id", "name").agg(F.count("*").alias("n")).where("n > 1")
    out = out.unionByName(names.select(F.lit("object_name_repeated").alias("rule"), named("job_id", "name").alias("entity_id"), c("n").cast("string").alias("detail")))
    m = materials.join(jobs.select("job_id", "interpolation_authorized"), "job_id", "left")
    repeated = c("method") == "repeated-photo"
    mu, mv = V.items("mapping_u"), V.items("mapping_v")
    square = F.greatest(F.abs(V.dot(mu, mu) - 1), F.abs(V.dot(mv, mv) - 1), F.abs(V.dot(mu, mv))) <= 1e-6 + 1e-5
    out = out.unionByName(findings(m, named("job_id", "id"), {
        "appearance_method": (~c("method").isin(*APPEARANCE_METHODS), c("method")),
        "color": (~(V.finite_array(c("color"), 3) & F.forall("color", lambda v: v.between(0, 255))), None),
        "material_basis": (blank(c("basis")), None),
        "source_identities": ((c("method") != "inferred") & (F.size("sources") == 0), None),
        "interpolation_unauthorized": (~F.coalesce("interpolation_authorized", F.lit(False)) & (c("method") != "matched-color"), c("method")),
        **{f"{x}_range": (unit_range(x), c(x)) for x in ("roughness", "metallic", "transmission")},
        "mapping_axes": (repeated & ~F.coalesce(square, F.lit(False)), None),
        "sample_size": (repeated & ~F.coalesce(F.forall("size_m", lambda v: v > 0), F.lit(False)), None),
    }))
    out = out.unionByName(findings(views, named("job_id", "id"), {
        "view_reserved": (c("id").cast("string") == "exterior", None),
        "view_camera": (blank(c("camera")), None),
        "view_subjects": (F.size("required_objects") == 0, None),
        "view_minimum_pixels": (c("minimum_pixels") <= 0, c("minimum_pixels")),
    }))
    e = excluded.join(jobs.select("job_id", "model_scope"), "job_id", "left").join(
        objects.select("job_id", "name", F.lit(True).alias("__declared")).distinct(), ["job_id", "name"], "left")
    return out.unionByName(findings(e, named("job_id", "name"), {
        "exclusion_unexplained": (blank(c("name")) | blank(c("reason")), None),
        "exclusion_in_full_model": (c("model_scope") != "selected-objects", c("model_scope")),
        "exclusion_declared": (c("__declared").isNotNull(), None),
    }))


def check_presentation_contract(contracts: DataFrame, objects: DataFrame, features: DataFrame) -> DataFrame:
    """Mode, eye range, renderer, dispositions, and what every feature may demand.

    ``contracts(contract_id, schema_version, mode, eye_minimum, eye_maximum, engines,
    material_mode)``; ``objects(contract_id, id, disposition)``; ``features(contract_id,
    id, object_ids, view_intents, finding_id, minimum_visible_pixels,
    minimum_projected_area_px2)``.
    """
    c = F.col
    named = lambda *p: F.concat_ws("/", *[c(x).cast("string") for x in p])
    counts = objects.groupBy("contract_id").agg(F.count_if(c("disposition") == "current-eligible").alias("__eligible"))
    rows = contracts.join(counts, "contract_id", "left")
    out = findings(rows, c("contract_id"), {
        "schema_version": (c("schema_version") != 1, c("schema_version")),
        "mode": (~c("mode").isin(*PRESENTATION_MODES), c("mode")),
        "eye_not_finite": (~(V.finite(c("eye_minimum")) & V.finite(c("eye_maximum"))), None),
        "eye_not_positive": (c("eye_minimum") <= 0, c("eye_minimum")),
        "eye_range": (c("eye_minimum") > c("eye_maximum"), None),
        "engines": ((F.size("engines") == 0) | (F.size(F.array_except("engines", F.array(*map(F.lit, RENDER_ENGINES)))) > 0), F.array_join("engines", ",")),
        "material_mode": (c("material_mode") != MATERIAL_MODE, c("material_mode")),
        "no_eligible_object": (F.coalesce("__eligible", F.lit(0)) == 0, None),
    })
    out = out.unionByName(findings(objects, named("contract_id", "id"), {"disposition": (~c("disposition").isin(*DISPOSITIONS), c("disposition"))}))
    out = out.unionByName(findings(features, named("contract_id", "id"), {
        "feature_objects": (F.size("object_ids") == 0, None),
        "feature_intents": (F.size("view_intents") == 0, None),
        "feature_finding": (blank(c("finding_id")), None),
        "minimum_visible_pixels": (c("minimum_visible_pixels") < 1, c("minimum_visible_pixels")),
        "minimum_projected_area": (~V.finite(c("minimum_projected_area_px2")) | (c("minimum_projected_area_px2") <= 0), c("minimum_projected_area_px2")),
    }))
    eligible = objects.where(c("disposition") == "current-eligible").select("contract_id", c("id").alias("object_id"))
    wanted = features.select("contract_id", "id", F.explode("object_ids").alias("object_id"))
    ineligible = wanted.join(eligible, ["contract_id", "object_id"], "left_anti")
    return out.unionByName(ineligible.select(
        F.lit("feature_object_not_eligible").alias("rule"), named("contract_id", "id").alias("entity_id"), c("object_id").cast("string").alias("detail")))
