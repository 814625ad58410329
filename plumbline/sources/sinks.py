"""Sinks: written once, never over an existing output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def sink_fresh_only(df: DataFrame, path: str, format: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write and fail when the output exists; returns the path."""
    df.write.mode("errorifexists").format(format).partitionBy(*partition_by).save(path)
    return path


def sink_reference_cloud(points: DataFrame, path: str, keys: Sequence[str] = ("capture_id", "frame_id")) -> tuple[str, str]:
    """Cloud partitioned by capture, and one metadata row per frame beside it.

    Rows are grouped by frame before writing so a capture's files stay large; a big
    capture is still split over many tasks by its frames.
    """
    cloud = sink_fresh_only(points.repartition(*keys), f"{path}/points", partition_by=keys[:1])
    written = points.sparkSession.read.parquet(cloud)
    frames = written.groupBy(*keys).agg(
        F.count("*").alias("points"), *[f(a).alias(f"{s}_{a}") for s, f in (("min", F.min), ("max", F.max)) for a in "xyz"])
    return cloud, sink_fresh_only(frames, f"{path}/frames")


def sink_intake_records(frames: DataFrame, inventory: DataFrame, path: str) -> tuple[str, str]:
    """Frame index and capture inventory as JSON lines."""
    return sink_fresh_only(frames, f"{path}/index", "json"), sink_fresh_only(inventory, f"{path}/inventory", "json")


def sink_measurements(patches: DataFrame, samples: DataFrame, comparisons: DataFrame, path: str) -> tuple[str, str, str]:
    """The three tables of a surface measurement."""
    return tuple(sink_fresh_only(df, f"{path}/{name}") for name, df in (("patches", patches), ("samples", samples), ("comparisons", comparisons)))


def sink_model_catalog(viewpoints: DataFrame, levels: DataFrame, objects: DataFrame, path: str) -> tuple[str, str, str]:
    """Viewpoints, levels and objects of a model as JSON lines."""
    return tuple(sink_fresh_only(df, f"{path}/{name}", "json") for name, df in (("viewpoints", viewpoints), ("levels", levels), ("objects", objects)))
