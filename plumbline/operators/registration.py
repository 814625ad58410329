"""Landmark registration: rigid fits, residuals, accepted scopes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.functions import vectors as V
from plumbline.functions.linalg import eig3, rotation_from_covariance
from plumbline.functions.quantiles import residual_stats

SOURCE = ("sx", "sy", "sz")
TARGET = ("tx", "ty", "tz")
_PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]


def rigid_fit(landmarks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Unit-scale rigid transform per key from landmarks whose ``role`` is ``fit``.

    One aggregation sums means and covariances; the 3x3 decomposition then runs on
    one row per transform.  ``status`` is ``fitted``, ``too_few``, ``collinear`` or
    ``not_finite`` (a coordinate is NULL, NaN or infinite).
    """
    fit = landmarks.where(F.col("role") == "fit")
    cov = lambda a, b: F.covar_pop(F.col(a), F.col(b))
    number = F.lit(True)
    for c in SOURCE + TARGET:
        number = number & V.finite(F.col(c))
    m = fit.groupBy(*keys).agg(
        F.count("*").alias("n"), F.bool_and(F.coalesce(number, F.lit(False))).alias("__number"),
        *[F.avg(c).alias(f"mean_{c}") for c in SOURCE + TARGET],
        F.array(*[cov(s, t) for s in SOURCE for t in TARGET]).alias("__c"),
        F.array(*[cov(SOURCE[i], SOURCE[j]) for i, j in _PAIRS]).alias("__a"),
        F.array(*[cov(TARGET[i], TARGET[j]) for i, j in _PAIRS]).alias("__b"),
    )
    m = m.withColumns({"__r": rotation_from_covariance("__c"), "__ea": eig3("__a"), "__eb": eig3("__b")})
    spread = lambda e: F.coalesce((F.col(e)[2] > 0) & (F.col(e)[1] > F.col(e)[2] * 1e-14), F.lit(False))
    status = F.when(F.col("n") < 3, "too_few").when(~F.col("__number"), "not_finite").when(~(spread("__ea") & spread("__eb")), "collinear").otherwise("fitted")
    r = F.col("__r")
    rows = [tuple(r[3 * i + j] for j in range(3)) for i in range(3)]
    mean = V.cols(*[f"mean_{c}" for c in SOURCE])
    shift = [F.col(f"mean_{t}") - V.dot(row, mean) for t, row in zip(TARGET, rows)]
    zero, one = F.lit(0.0), F.lit(1.0)
    matrix = F.array(*rows[0], shift[0], *rows[1], shift[1], *rows[2], shift[2], zero, zero, zero, one)
    return m.withColumn("status", status).select(*keys, "n", "status", F.when(F.col("status") == "fitted", matrix).alias("matrix"))


def landmark_residuals(landmarks: DataFrame, transforms: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Residual vector ``rx, ry, rz`` and ``error_m`` of every landmark under its transform; NULL where there is none."""
    joined = landmarks.join(transforms.where(F.col("matrix").isNotNull()).select(*keys, F.col("matrix").alias("__m")), list(keys), "left")
    residual = V.sub(V.apply_rigid(F.col("__m"), V.cols(*SOURCE)), V.cols(*TARGET))
    out = joined.withColumns(dict(zip(("rx", "ry", "rz"), residual))).drop("__m")
    return out.withColumn("error_m", V.norm(V.cols("rx", "ry", "rz")))


def residual_summary_by_role(residuals: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Count, median, p95 and maximum error per transform and role, over landmarks that have one."""
    return residual_stats(residuals.where(F.col("error_m").isNotNull()), [*keys, "role"], "error_m")


def apply_registration_scope(frames: DataFrame, ledger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Use a transform only where the exact ``(capture_id, tracking_segment)`` is accepted.

    Frames without an accepted scope, or without a known segment, become findings;
    there is no fallback.
    """
    accepted = ledger.where("accepted").select("capture_id", "tracking_segment", "target_frame", "matrix")
    scoped = frames.join(accepted, ["capture_id", "tracking_segment"])
    outside = frames.join(accepted.select("capture_id", "tracking_segment"), ["capture_id", "tracking_segment"], "left_anti")
    return scoped, outside.select(
        F.lit("no_accepted_scope").alias("rule"),
        F.concat_ws("/", F.col("capture_id").cast("string"), F.col("frame_id").cast("string")).alias("entity_id"),
        F.col("tracking_segment").cast("string").alias("detail"))


def check_landmarks(landmarks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Findings on ids, roles, evidence and finite coordinates."""
    from plumbline.rules import findings

    entity = F.concat_ws("/", *[F.col(k).cast("string") for k in (*keys, "id")])
    number_ok = F.lit(True)
    for c in SOURCE + TARGET:
        number_ok = number_ok & V.finite(F.col(c))
    rows = findings(landmarks, entity, {
        "role": (~F.col("role").isin("fit", "check"), F.col("role")),
        "evidence": (F.coalesce(F.trim("evidence"), F.lit("")) == "", None),
        "not_finite": (~number_ok, None),
    })
    repeated = landmarks.groupBy(*keys, "id").agg(F.count("*").alias("n")).where("n > 1")
    return rows.unionByName(repeated.select(F.lit("duplicate_id").alias("rule"), entity.alias("entity_id"), F.col("n").cast("string").alias("detail")))
