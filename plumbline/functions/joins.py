"""Joins that broadcast only what has been measured."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from plumbline.session import cut_lineage

BROADCAST_BYTES = 32 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether all rows of ``df``, written as JSON, take at most ``limit`` bytes. Reads ``df`` once: give it a stored one."""
    size = F.octet_length(F.to_json(F.struct(*[df[c] for c in df.columns])))
    return (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit


def measured(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """A stored ``df`` marked for broadcast if it is small; a larger one is joined by shuffling both sides, where adaptive execution splits hot keys."""
    return F.broadcast(df) if small(df, limit) else df


def join_model(rows: DataFrame, model: DataFrame, on: Sequence[str], limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join a per-key model table to its many rows. The model is written out and measured first."""
    return rows.join(measured(cut_lineage(model), limit), list(on))


def by_shuffle(df: DataFrame) -> DataFrame:
    """``df`` marked to be joined by sorting both sides. Spark guesses sizes from files, which say little about arrays and exploded rows made of them."""
    return df.hint("merge")
