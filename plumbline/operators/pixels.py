"""Depth pixels: eligibility, unprojection, sampling and color lookup.

Pixel rows are ``(capture_id, frame_id, v, u, depth_mm, confidence)``; cameras are
``(frame_id, width, height, fx, fy, cx, cy, pose)`` with a row-major camera-to-world
``pose`` of 16 doubles.  Cameras look along negative Z with +Y up.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions import vectors as V
from plumbline.functions.ranking import bucketed_rank, range_rank

FRAME = ("capture_id", "frame_id")
EDGE_PX = 1e-6  # fixed value: what projecting a border pixel's own point may miss it by, a kilometre from the origin


def eligible(confidence_value: int = 255, max_depth_m: float = 5.0) -> Column:
    """Predicate: confidence equals the value and depth is in ``(0, max]``."""
    return (
        (F.col("confidence") == confidence_value)
        & (F.col("depth_mm") > 0)
        & (F.col("depth_mm") <= max_depth_m * 1000)
    )


def eligible_pixels(px: DataFrame, confidence_value: int = 255, max_depth_m: float = 5.0) -> DataFrame:
    return px.where(eligible(confidence_value, max_depth_m))


def join_depth_confidence(depth: DataFrame, confidence: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """One pixel row from separately decoded depth and confidence grids.

    A pixel that one grid lacks has no row; ``rules.unmatched`` in both directions names its frame.
    """
    return depth.join(confidence, [*keys, "v", "u"])


def unproject(
    px: DataFrame,
    cameras: DataFrame,
    depth_size: tuple[int, int] | None = None,
    on: Sequence[str] = FRAME,
) -> DataFrame:
    """Pixel rows to world points ``x, y, z`` in metres.

    Pixels without a camera have no point; ``rules.unmatched`` names their frames.

    Intrinsics are scaled from the camera image to the depth grid; ``depth_size``
    is ``(width, height)``, or the cameras carry ``depth_width, depth_height``.
    The camera side is small per frame; Catalyst broadcasts it when its measured
    size allows and otherwise shuffles both sides by frame.
    """
    if depth_size is not None:
        cameras = cameras.withColumns({"depth_width": F.lit(depth_size[0]), "depth_height": F.lit(depth_size[1])})
    sx = F.col("depth_width") / F.col("width")
    sy = F.col("depth_height") / F.col("height")
    intrinsics = cameras.select(
        *on,
        (F.col("fx") * sx).alias("__fx"), (F.col("fy") * sy).alias("__fy"),
        (F.col("cx") * sx).alias("__cx"), (F.col("cy") * sy).alias("__cy"),
        F.col("pose").alias("__pose"),
    )
    depth = F.col("depth_mm") / F.lit(1000.0)
    local = (
        (F.col("u") - F.col("__cx")) * depth / F.col("__fx"),
        -(F.col("v") - F.col("__cy")) * depth / F.col("__fy"),
        -depth,
    )
    x, y, z = V.apply_rigid(F.col("__pose"), local)
    joined = px.join(intrinsics, list(on))
    return joined.withColumns({"x": x, "y": y, "z": z}).drop("__fx", "__fy", "__cx", "__cy", "__pose")


def map_depth_to_rgb_pixel(df: DataFrame, depth_size: tuple[int, int], rgb_size: tuple[int, int]) -> DataFrame:
    """Nearest RGB pixel ``(rgb_v, rgb_u)``: ties to even, clipped to the image."""

    def mapped(name: str, i: int) -> Column:
        return V.clamp(F.rint(F.col(name) * F.lit(float(rgb_size[i])) / F.lit(float(depth_size[i]))),
                       0.0, float(rgb_size[i] - 1)).cast("int")

    return df.withColumns({"rgb_u": mapped("u", 0), "rgb_v": mapped("v", 1)})


def join_point_color(points: DataFrame, rgb: DataFrame, keys: Sequence[str] = FRAME) -> DataFrame:
    """Colors for points already mapped to RGB pixels; ``rgb`` rows are ``keys, v, u, r, g, b``."""
    colors = rgb.select(*keys, F.col("v").alias("rgb_v"), F.col("u").alias("rgb_u"), "r", "g", "b")
    return points.join(colors, [*keys, "rgb_v", "rgb_u"], "left")


def sample_every_nth_point(df: DataFrame, step: int, keys: Sequence[str] = FRAME) -> DataFrame:
    """Every ``step``-th row per frame in row-major order, after filtering.

    Ranks inside an image row (at most one image width) and prefix-sums row
    counts, so no task holds more than one image row of one frame.
    """
    if step < 1:
        raise ValueError("step must be a positive integer")
    ranked = bucketed_rank(df, keys, F.col("v"), [F.col("u")], "__rank")
    return ranked.where(F.col("__rank") % step == 0).drop("__rank")


def frame_key(frame_id: Column) -> tuple[Column, Column, Column]:
    """Sort key: all-digit ids first by value, then the rest as text."""
    digits = frame_id.rlike(r"\A[0-9]+\z")
    return (~digits), F.when(digits, frame_id.cast("decimal(38,0)")), frame_id


def frame_order(frames: DataFrame, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    """Frames in capture order."""
    return frames.orderBy(*keys, *frame_key(F.col("frame_id").cast("string")))


def frame_ordinals(frames: DataFrame, keys: Sequence[str] = ("capture_id",), name: str = "ordinal") -> DataFrame:
    """0-based ordinal per frame in capture order."""
    order = frame_key(F.col("frame_id").cast("string"))
    return range_rank(frames, keys, order, name)


def sample_every_nth_frame(frames: DataFrame, step: int, keys: Sequence[str] = ("capture_id",)) -> DataFrame:
    if step < 1:
        raise ValueError("step must be a positive integer")
    return frame_ordinals(frames, keys, "ordinal").where(F.col("ordinal") % step == 0)


def bounds(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Axis-aligned bounds, centre and extent of ``x, y, z`` per key."""
    spans = df.groupBy(*keys).agg(
        *[f(axis).alias(f"{side}_{axis}") for side, f in (("min", F.min), ("max", F.max)) for axis in "xyz"]
    )
    extras = {}
    for axis in "xyz":
        low, high = F.col(f"min_{axis}"), F.col(f"max_{axis}")
        extras[f"center_{axis}"] = (low + high) / 2
        extras[f"extent_{axis}"] = high - low
    return spans.withColumns(extras)


def frame_sampling_counts(
    px: DataFrame, step: int, keys: Sequence[str] = FRAME, confidence_value: int = 255, max_depth_m: float = 5.0
) -> DataFrame:
    """Native, eligible and sampled pixel counts per frame.

    Sampling keeps ranks 0, step, 2*step..., so the sampled count follows from the
    eligible count and needs no second pass.
    """
    native = F.count("*")
    kept = F.count_if(eligible(confidence_value, max_depth_m))
    return px.groupBy(*keys).agg(
        native.alias("native"), kept.alias("eligible"),
        F.ceil(kept / F.lit(step)).cast("long").alias("sampled"),
        F.coalesce(kept / native, F.lit(0.0)).alias("eligible_fraction"),
    )


def depth_class_counts(px: DataFrame, keys: Sequence[str], max_depth_m: float = 5.0) -> DataFrame:
    """Zero, nonzero, in-range and out-of-range depth counts."""
    in_range = (F.col("depth_mm") > 0) & (F.col("depth_mm") <= max_depth_m * 1000)
    return px.groupBy(*keys).agg(
        F.count_if(F.col("depth_mm") == 0).alias("zero"),
        F.count_if(F.col("depth_mm") != 0).alias("nonzero"),
        F.count_if(in_range).alias("in_range"),
        F.count_if(~in_range).alias("out_of_range"),
    )


def confidence_histogram(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Pixel count per confidence value, one row per value."""
    return px.groupBy(*keys, "confidence").agg(F.count("*").alias("n"))


def confidence_map(px: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same histogram as one map per key; at most 256 entries each."""
    return confidence_histogram(px, keys).groupBy(*keys).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("confidence", "n")))).alias("histogram")
    )


def project_to_camera(
    points: DataFrame, cameras: DataFrame, on: Sequence[str], near_m: float = 0.001
) -> DataFrame:
    """World points to image ``px_u, px_v``, ``depth_m`` and the in-image flag ``visible``.

    Points without a camera are left out; ``rules.unmatched`` names their keys.
    """
    pose = F.col("__pose")
    cam = cameras.select(*on, *[F.col(c).alias(f"__{c}") for c in ("width", "height", "fx", "fy", "cx", "cy", "pose")])
    local = V.rotate_back(pose, V.sub(V.cols("x", "y", "z"), V.translation(pose)))
    joined = points.join(cam, list(on)).withColumns({"__lx": local[0], "__ly": local[1], "depth_m": -local[2]})
    safe = F.when(F.col("depth_m") > near_m, F.col("depth_m")).otherwise(1.0)
    joined = joined.withColumns({
        "px_u": F.col("__fx") * F.col("__lx") / safe + F.col("__cx"),
        "px_v": F.col("__cy") - F.col("__fy") * F.col("__ly") / safe,
    })
    visible = (
        (F.col("depth_m") > near_m) & (F.col("px_u") >= -EDGE_PX) & (F.col("px_v") >= -EDGE_PX)
        & (F.col("px_u") <= F.col("__width") - 1 + EDGE_PX) & (F.col("px_v") <= F.col("__height") - 1 + EDGE_PX)
    )
    return joined.withColumn("visible", visible).drop(
        "__lx", "__ly", *[f"__{c}" for c in ("width", "height", "fx", "fy", "cx", "cy", "pose")])


def clip_camera_segment(df: DataFrame, near_depth_m: Column | float) -> DataFrame:
    """Near-plane clip of camera-space segments ``start, end`` (arrays of 3).

    Adds ``visible``, ``camera_plane_clipped``, ``t0``, ``t1`` and the clipped
    ``clip_start, clip_end``; all but the flags are NULL when nothing survives.
    Visible means the segment reaches past the near depth, not that it is in view.
    """
    near = near_depth_m if isinstance(near_depth_m, Column) else F.lit(float(near_depth_m))
    first, last = -F.col("start")[2], -F.col("end")[2]
    usable = V.finite_array(F.col("start"), 3) & V.finite_array(F.col("end"), 3) & V.finite(near) & (near > 0)
    crossing = (near - first) / F.nullif(last - first, F.lit(0.0))
    t0 = F.when(first < near, crossing).otherwise(0.0)
    t1 = F.when(last < near, crossing).otherwise(1.0)
    shown = F.coalesce(usable & (F.greatest(first, last) >= near) & (t0 <= t1), F.lit(False))
    out = df.withColumns({"visible": shown, "t0": F.when(shown, t0), "t1": F.when(shown, t1)})

    def at(t: str) -> Column:
        return F.when(F.col("visible"), F.array(*[
            F.col("start")[i] + F.col(t) * (F.col("end")[i] - F.col("start")[i]) for i in range(3)]))

    clipped = F.coalesce((F.col("t0") != 0.0) | (F.col("t1") != 1.0), F.lit(False))
    return out.withColumns({"camera_plane_clipped": clipped, "clip_start": at("t0"), "clip_end": at("t1")})


def display_pixel(u: Column, v: Column, orientation: Column, height: Column) -> tuple[Column, Column]:
    """Native to displayed pixel centre; ``upright90cw`` images are shown rotated."""
    raw = orientation == "raw"
    return F.when(raw, u).otherwise(height - 1 - v), F.when(raw, v).otherwise(u)


def native_pixel(u: Column, v: Column, orientation: Column, height: Column) -> tuple[Column, Column]:
    """Inverse of :func:`display_pixel`."""
    raw = orientation == "raw"
    return F.when(raw, u).otherwise(v), F.when(raw, v).otherwise(height - 1 - u)


def native_to_display_pixel(df: DataFrame) -> DataFrame:
    """Adds ``display_u, display_v`` and the round-trip flag for ``u, v`` pixel centres."""
    du, dv = display_pixel(F.col("u"), F.col("v"), F.col("orientation"), F.col("height"))
    upright = F.col("orientation") == "upright90cw"
    out = df.withColumns({
        "display_u": du, "display_v": dv,
        "display_width": F.when(upright, F.col("height")).otherwise(F.col("width")),
        "display_height": F.when(upright, F.col("width")).otherwise(F.col("height")),
    })
    bu, bv = native_pixel(F.col("display_u"), F.col("display_v"), F.col("orientation"), F.col("height"))
    return out.withColumn("round_trip", (F.abs(bu - F.col("u")) <= 1e-12) & (F.abs(bv - F.col("v")) <= 1e-12))


def nearest_pixel(df: DataFrame) -> DataFrame:
    """Nearest native pixel ``near_u, near_v``, NULL outside the image.

    The rounded centre of an outside mark is kept in ``outside_u, outside_v``.
    """
    nu, nv = F.floor(F.col("u") + 0.5), F.floor(F.col("v") + 0.5)
    inside = (nu >= 0) & (nu < F.col("width")) & (nv >= 0) & (nv < F.col("height"))
    return df.withColumns({
        "near_u": F.when(inside, nu), "near_v": F.when(inside, nv),
        "outside_u": F.when(~inside, nu), "outside_v": F.when(~inside, nv),
    })


REVIEW_PADDING_PX = 32  # fixed value: margin of a review crop


def review_bounds(df: DataFrame, padding: int = REVIEW_PADDING_PX) -> DataFrame:
    """Padded, clipped pixel-edge box of a mark's displayed coordinates.

    ``coords`` is an array of ``{u, v}`` displayed pixel centres.
    """
    us = F.transform("coords", lambda p: p["u"] + 0.5)
    vs = F.transform("coords", lambda p: p["v"] + 0.5)
    return df.withColumns({
        "left": F.greatest(F.lit(0), F.floor(F.array_min(us) - padding)),
        "top": F.greatest(F.lit(0), F.floor(F.array_min(vs) - padding)),
        "right": F.least(F.col("display_width"), F.ceil(F.array_max(us) + padding)),
        "bottom": F.least(F.col("display_height"), F.ceil(F.array_max(vs) + padding)),
    })


def union_clouds(*clouds: DataFrame) -> DataFrame:
    """Concatenate clouds of the same columns."""
    out = clouds[0]
    for cloud in clouds[1:]:
        out = out.unionByName(cloud)
    return out
