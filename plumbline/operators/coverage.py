"""Presentation coverage: rasters, shots, samples, features, reviews."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions import vectors as V
from plumbline.functions.joins import measured
from plumbline.rules import findings
from plumbline.session import cut_lineage

EYE_TOLERANCE = 1e-6  # fixed value, metres


def scan_id_rasters(raster: DataFrame, kind: str) -> DataFrame:
    """One kind of index grid (``object`` or ``material``); only that column is read."""
    return raster.select("view_id", "y", "x", F.col(f"{kind}_idx").alias("idx"))


def raster_counts(raster: DataFrame, kind: str) -> DataFrame:
    """Pixels per view and id; index 0 is background."""
    return scan_id_rasters(raster, kind).where("idx <> 0").groupBy("view_id", "idx").agg(F.count("*").alias("pixels"))


def raster_register_join(counts: DataFrame, register: DataFrame) -> DataFrame:
    """Names for raster ids; ids the register does not declare keep a NULL name and a flag.

    Joins counts, not pixels: one row per id and view.
    """
    named = counts.join(register.select("view_id", "idx", "name"), ["view_id", "idx"], "left")
    return named.withColumn("undeclared", F.col("name").isNull())


def required_visibility(counts: DataFrame, required: DataFrame) -> DataFrame:
    """Every required object against its minimum pixel count.

    ``counts(view_id, name, pixels)``, ``required(view_id, object_id, minimum_pixels)``.
    """
    seen = counts.select("view_id", F.col("name").alias("object_id"), "pixels")
    j = required.join(seen, ["view_id", "object_id"], "left").withColumn("pixels", F.coalesce("pixels", F.lit(0)))
    return j.withColumn("passed", F.col("pixels") >= F.col("minimum_pixels"))


def object_material_colocation(raster: DataFrame, assignments: DataFrame) -> DataFrame:
    """Pixels per view and object where the material index is the assigned one.

    ``assignments(view_id, object_idx, material_idx)``.  Pixels are counted per
    index pair before the join.
    """
    pairs = raster.where("object_idx <> 0").groupBy("view_id", "object_idx", "material_idx").agg(F.count("*").alias("pixels"))
    expected = assignments.select("view_id", "object_idx", F.col("material_idx").alias("__expected"))
    j = pairs.join(expected, ["view_id", "object_idx"])
    return j.groupBy("view_id", "object_idx").agg(
        F.sum("pixels").alias("object_pixels"),
        F.sum(F.when(F.col("material_idx") == F.col("__expected"), F.col("pixels")).otherwise(0)).alias("material_pixels"))


def pixel_budget(visibility: DataFrame, frames: DataFrame) -> DataFrame:
    """Visible pixels may not exceed the image.

    ``visibility(frame_id, object_id, visible_pixels)``, ``frames(frame_id, width, height)``.
    """
    totals = visibility.groupBy("frame_id").agg(F.sum("visible_pixels").alias("visible"), F.count_if(F.col("visible_pixels") > 0).alias("objects"))
    j = frames.join(totals, "frame_id", "left")
    budget = F.col("width").cast("long") * F.col("height")
    visible = F.coalesce("visible", F.lit(0))
    return j.select("frame_id", visible.alias("visible"), budget.alias("budget"), F.coalesce("objects", F.lit(0)).alias("objects"), (visible <= budget).alias("within"))


def visible_set_check(reported: DataFrame, visibility: DataFrame) -> DataFrame:
    """Reported visible ids must be exactly those with pixels."""
    from plumbline.operators.integrity import exact_membership

    return exact_membership(reported.select("frame_id", "object_id"), visibility.where("visible_pixels > 0").select("frame_id", "object_id"), ["frame_id", "object_id"])


def adjacent_shots(shots: DataFrame, transitions: DataFrame, route: Sequence[str] = ("route_id",)) -> DataFrame:
    """Transitions must cut between each consecutive pair of shots, in order.

    ``shots(route.., ordinal, shot_id)``, ``transitions(route.., ordinal, from_shot_id,
    to_shot_id, type)``.  Neighbours are found by an equi-join on ``ordinal + 1``, so a
    long route is not sorted in one task.
    """
    keys = [*route, "ordinal"]
    following = shots.select(*route, (F.col("ordinal") - 1).alias("ordinal"), F.col("shot_id").alias("next_id"))
    pairs = shots.join(following, keys)
    j = pairs.select(*keys, "shot_id", "next_id", F.lit(True).alias("__p")).join(transitions.withColumn("__t", F.lit(True)), keys, "full")
    kind = (
        F.when(F.col("__t").isNull(), "missing").when(F.col("__p").isNull(), "extra")
        .when(~(F.col("from_shot_id").eqNullSafe(F.col("shot_id")) & F.col("to_shot_id").eqNullSafe(F.col("next_id"))), "out_of_order")
        .when(~F.col("type").eqNullSafe(F.lit("cut")), "not_cut"))
    return j.select(*keys, kind.alias("kind")).where("kind IS NOT NULL")


def frame_shot_join(samples: DataFrame, shots: DataFrame) -> DataFrame:
    """Samples of unknown shots, and shots without a sample."""
    from plumbline.operators.integrity import both_sides

    sides = both_sides(samples.select("shot_id"), shots.select("shot_id"), ["shot_id"]).where(F.col("in_left") != F.col("in_right"))
    return sides.select("shot_id", F.when(F.col("in_left"), "unknown_shot").otherwise("not_sampled").alias("kind"))


def check_eye_height(samples: DataFrame, shots: DataFrame, low: float, high: float, walkthrough: bool = True) -> DataFrame:
    """Camera minus floor equals the eye height, the shot's eye height, and lies in range."""
    j = samples.join(shots.select("shot_id", F.col("eye_height_m").alias("__shot")), "shot_id", "left")
    # closeness as relative 1e-9 of the larger value, at least the absolute tolerance
    close = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(EYE_TOLERANCE), 1e-9 * F.greatest(F.abs(a), F.abs(b)))
    eye = F.col("eye_height_m")
    rules = {
        "eye_not_floor_relative": (~close(F.col("camera_elevation_m") - F.col("floor_elevation_m"), eye), eye),
        "eye_differs_from_shot": (~close(eye, F.col("__shot")), eye),
    }
    if walkthrough:
        rules["eye_out_of_range"] = (~eye.between(low, high), eye)
    return findings(j, F.col("frame_id"), rules)


def check_projected_bounds(visibility: DataFrame) -> DataFrame:
    """Four finite bounds, not inverted; areas not negative."""
    b = F.col("bounds")
    whole = V.finite_array(b, 4)
    return findings(visibility, F.concat_ws("/", F.col("frame_id").cast("string"), F.col("object_id").cast("string")), {
        "bounds_incomplete": (~whole, None),
        "bounds_inverted": (whole & ((b[2] < b[0]) | (b[3] < b[1])), None),
        "area_negative": (~V.finite(F.col("projected_area_px2")) | (F.col("projected_area_px2") < 0), F.col("projected_area_px2")),
    })


def feature_coverage(features: DataFrame, samples: DataFrame, visibility: DataFrame, sample_findings: DataFrame) -> DataFrame:
    """Feature × object × intent combinations no single sample satisfies.

    One sample must pass the finding and both thresholds at once.  ``features(feature_id,
    object_ids, view_intents, finding_id, minimum_visible_pixels,
    minimum_projected_area_px2)``, ``samples(frame_id, intent)``, ``visibility(frame_id,
    object_id, visible_pixels, projected_area_px2)``, ``sample_findings(frame_id,
    finding_id, status)``.
    """
    wanted = features.select(
        "feature_id", "finding_id", "minimum_visible_pixels", "minimum_projected_area_px2",
        F.explode("object_ids").alias("object_id"), "view_intents").withColumn("intent", F.explode("view_intents")).drop("view_intents")
    seen = visibility.join(samples.select("frame_id", "intent"), "frame_id").join(
        sample_findings.where("status = 'pass'").select("frame_id", "finding_id"), "frame_id")
    # Only evidence no other sample beats on both counts can decide.  Visible pixels are
    # bounded by the image, so the window sees at most one row per pixel count.
    combo = ["object_id", "intent", "finding_id"]
    levels = seen.groupBy(*combo, "visible_pixels").agg(F.max("projected_area_px2").alias("projected_area_px2"))
    larger = Window.partitionBy(*combo).orderBy(F.col("visible_pixels").desc()).rowsBetween(Window.unboundedPreceding, -1)
    evidence = levels.withColumn("__best", F.max("projected_area_px2").over(larger)).where(
        F.col("__best").isNull() | (F.col("projected_area_px2") > F.col("__best"))).drop("__best")
    # what is left of a combination is one short list, so wanted rows meet one row each and are not shuffled
    fronts = cut_lineage(evidence.groupBy(*combo).agg(F.collect_list(F.struct("visible_pixels", "projected_area_px2")).alias("__front")))
    met = F.exists("__front", lambda e: (e["visible_pixels"] >= F.col("minimum_visible_pixels")) & (e["projected_area_px2"] >= F.col("minimum_projected_area_px2")))
    return wanted.join(measured(fronts), combo, "left").where(~F.coalesce(met, F.lit(False))).select("feature_id", "object_id", "intent")


def missing_intents(features: DataFrame, shots: DataFrame) -> DataFrame:
    """Feature intents no shot of the route has."""
    wanted = features.select("feature_id", F.explode("view_intents").alias("intent"))
    return wanted.join(shots.select("intent").distinct(), "intent", "left_anti").select("feature_id", "intent").distinct()


def review_join(views: DataFrame, reviews: DataFrame, model_sha256: str | None = None) -> DataFrame:
    """Every expected view needs exactly one passing review bound to its image.

    ``views(view_id, image_sha256, passed)``, ``reviews(view_id, image_sha256, finding,
    note, model_sha256)``.
    """
    per_view = reviews.groupBy("view_id").agg(
        F.count("*").alias("reviews"), F.max(F.struct("image_sha256", "finding", "note", "model_sha256")).alias("r"))
    j = views.select("view_id", F.col("image_sha256").alias("__sha"), "passed", F.lit(True).alias("__v")).join(per_view, "view_id", "full")
    both = F.col("__v").isNotNull() & F.col("reviews").isNotNull()
    problems = [
        F.when(F.col("__v").isNull(), "unexpected"), F.when(F.col("reviews").isNull(), "not_reviewed"),
        F.when(F.col("reviews") > 1, "reviewed_twice"),
        F.when(both & ((F.coalesce(F.col("r.finding"), F.lit("")) != "pass") | (F.coalesce(F.trim("r.note"), F.lit("")) == "")), "incomplete"),
        F.when(both & ~F.col("r.image_sha256").eqNullSafe(F.col("__sha")), "image_changed"),
        F.when(both & ~F.coalesce("passed", F.lit(False)), "subject_not_visible"),
    ]
    if model_sha256 is not None:
        problems.append(F.when(both & ~F.col("r.model_sha256").eqNullSafe(F.lit(model_sha256)), "other_model"))
    return j.select("view_id", F.explode(F.array_compact(F.array(*problems))).alias("kind"))


def disposition_counts(objects: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Eligible, retired and excluded objects."""
    d = F.col("disposition")
    return objects.groupBy(*keys).agg(
        F.count_if(d == "current-eligible").alias("eligible_objects"), F.count_if(d == "retired").alias("retired_objects"),
        F.count_if(d == "excluded-source").alias("excluded_source_objects"))


def appearance_rollup(materials: DataFrame) -> DataFrame:
    """Materials per appearance method."""
    return materials.groupBy("method").agg(F.count("*").alias("materials"))


def coverage_atlas_rollup(atlas: DataFrame, keys: Sequence[str] = ("room",)) -> DataFrame:
    """Surfaces per room and status, and how many still need an action."""
    open_rows = F.coalesce(F.trim("next_action"), F.lit("")) != ""
    return atlas.groupBy(*keys, "status").agg(F.count("*").alias("surfaces"), F.count_if(open_rows).alias("open_actions"))


def visible_in_view(objects: DataFrame, level: str = "all", roof_visible: bool = True) -> DataFrame:
    """Objects a viewer shows for a level filter and the roof switch."""
    shown = objects if level == "all" else objects.where(F.col("level") == level)
    if level != "all" or not roof_visible:
        shown = shown.where(~F.col("role").isin("roof", "ceiling"))
    return shown


def sink_catalog(objects: DataFrame) -> DataFrame:
    """Levels of a model with object counts; levels of only roofs and ceilings are left out."""
    kept = objects.groupBy("level").agg(F.count("*").alias("object_count"), F.count_if(~F.col("role").isin("roof", "ceiling")).alias("__n"))
    return kept.where("__n > 0").select("level", "object_count")


def check_sample_images(declared: DataFrame, images: DataFrame) -> DataFrame:
    """Size and hash as declared; decodable and not fully transparent.

    ``declared(frame_id, path, bytes, sha256)``, ``images(path, length, sha256,
    decoded, max_alpha)``.
    """
    actual = images.select("path", F.col("length").alias("__length"), F.col("sha256").alias("__sha"), "decoded", "max_alpha")
    j = declared.join(actual, "path", "left")
    there = F.col("__sha").isNotNull()
    return findings(j, F.col("frame_id"), {
        "file_missing": (~there, F.col("path")),
        "size_differs": (there & (F.col("__length") != F.col("bytes")), F.col("__length")),
        "sha256_differs": (there & (F.col("__sha") != F.col("sha256")), None),
        "not_decodable": (there & ~F.coalesce("decoded", F.lit(False)), None),
        "fully_transparent": (there & F.coalesce("decoded", F.lit(False)) & (F.coalesce("max_alpha", F.lit(255)) == 0), None),
    })
