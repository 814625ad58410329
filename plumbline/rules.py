"""Findings tables: one row per broken rule instead of the first exception."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

FINDING_COLUMNS = ("rule", "entity_id", "detail")


def findings(df: DataFrame, entity: Column, rules: dict[str, tuple[Column, Column | None]]) -> DataFrame:
    """Evaluate ``{rule: (is_broken, detail)}`` in one pass over ``df``.

    A NULL condition counts as broken: a rule that cannot be evaluated is not met.
    All rules share one scan; the broken ones are exploded from an array.
    """
    verdicts = [
        F.when(
            F.coalesce(broken, F.lit(True)),
            F.struct(F.lit(rule).alias("rule"), (F.lit(None) if detail is None else detail).cast("string").alias("detail")),
        )
        for rule, (broken, detail) in rules.items()
    ]
    return (
        df.select(entity.cast("string").alias("entity_id"), F.explode(F.array_compact(F.array(*verdicts))).alias("f"))
        .select(F.col("f.rule").alias("rule"), "entity_id", F.col("f.detail").alias("detail"))
    )


def unmatched(rows: DataFrame, lookup: DataFrame, keys: Sequence[str], rule: str) -> DataFrame:
    """A finding per key of ``rows`` that ``lookup`` lacks, with the number of rows it would cost an inner join.

    Rows are counted per key before anything is joined, so a key with very many rows is one row here. NULL keys match nothing.
    """
    keys = list(keys)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("__n"))
    lost = counted.join(lookup.select(*keys).distinct(), keys, "left_anti")
    entity = F.concat_ws("/", *[F.coalesce(F.col(k).cast("string"), F.lit("NULL")) for k in keys])
    return lost.select(F.lit(rule).alias("rule"), entity.alias("entity_id"), F.col("__n").cast("string").alias("detail"))


def union_findings(*frames: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def checks_rollup(findings_df: DataFrame, rules: DataFrame) -> DataFrame:
    """Pass or fail per declared rule; a rule with no finding passes.

    ``rules`` is the one-column list ``rule`` of everything that was checked, so a
    rule that produced nothing is still reported.
    """
    counted = findings_df.groupBy("rule").agg(F.count("*").alias("findings"))
    return rules.select("rule").distinct().join(counted, "rule", "left").select(
        "rule",
        F.coalesce("findings", F.lit(0)).cast("long").alias("findings"),
        F.col("findings").isNull().alias("passed"),
    )


def overall_status(checks: DataFrame) -> DataFrame:
    """Overall pass only when every check passed."""
    return checks.agg(
        F.count("*").alias("checks"),
        F.coalesce(F.bool_and("passed"), F.lit(False)).alias("passed"),
    )


def require_clean(findings_df: DataFrame) -> None:
    """Raise when any finding exists; only a short sample reaches the driver."""
    sample = findings_df.limit(5).collect()
    if sample:
        raise ValueError("findings present, for example: " + "; ".join(f"{r.rule}:{r.entity_id}" for r in sample))
