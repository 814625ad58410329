"""Exact interpolated quantiles that never hold one large group in one task.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.  Here small
groups are sorted as they are, and large ones go through distributed selection: rounds of
counted histograms narrow a bracket around each wanted rank until a fixed number of rows is left.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.joins import measured
from plumbline.session import cut_lineage

GROUP_ROWS = 10_000  # rows of one group that are sorted together; beyond, brackets are narrowed first
BINS = 1024
WIDE = 16.0  # a bracket whose ends differ by more than this factor is divided by magnitude, else evenly


def _magnitude(v: Column) -> Column:
    """A number that grows with ``v`` and spreads its orders of magnitude evenly; infinities and NaN have their places at the ends."""
    size = F.ln(F.abs(v)) + 800.0
    finite = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0.0))
    return F.when(F.isnan(v), 1700.0).when(v == float("inf"), 1600.0).when(v == float("-inf"), -1600.0).otherwise(finite)


def _bin(v: Column, low: Column, high: Column) -> Column:
    """The bin of ``v`` between ``low`` and ``high``: never falls as ``v`` grows, and differs for the two ends."""
    even = ((low > 0) & (high <= low * WIDE) | (high < 0) & (low >= high * WIDE)) & (F.abs(low) < 1e300) & (F.abs(high) < 1e300)

    def share(of) -> Column:
        return F.floor((of(v) - of(low)) / (of(high) - of(low)) * BINS)

    # the smallest numbers are taken as they are: their logarithms and differences lose digits
    tiny = (F.abs(low) < 1e-300) & (F.abs(high) < 1e-300)
    scaled = F.floor((v * 1e300 * 1e8 - low * 1e300 * 1e8) / (high * 1e300 * 1e8 - low * 1e300 * 1e8) * BINS)
    place = F.when(tiny, scaled).when(even, share(lambda x: x)).otherwise(share(_magnitude))
    # the ends have bins of their own, so that every round takes something away
    return F.when(v == low, -1).when(v == high, BINS).otherwise(F.greatest(F.least(place, F.lit(BINS - 1)), F.lit(0))).cast("int")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on keys of which null ones are keys too; the keys come once."""
    other = right.withColumnsRenamed({k: f"__k{i}" for i, k in enumerate(keys)})
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(other[f"__k{i}"]) for i, k in enumerate(keys)])
    return left.join(other, on, how).drop(*[f"__k{i}" for i in range(len(keys))])


def order_statistics(data: DataFrame, ranks: DataFrame, keys: Sequence[str], value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """The values at given ranks: ``ranks(*keys, __rank)``, counted from 0, gain ``__value``.

    Each round counts the rows of every open bracket in ``BINS`` bins with map-side combining; the bin that holds the
    rank becomes the bracket, with the bin's own least and greatest value as ends. What is left of a bracket when it
    holds ``group_rows`` rows or one value is sorted. ``value`` is a double without nulls.
    """
    v, by = F.col("__v"), [*keys, "__rank"]
    rows = data.select(*keys, F.col(value).alias("__v"))
    ends = rows.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi"))
    open_ = cut_lineage(_null_safe(ranks.select(*by).distinct(), ends, keys).withColumn("__below", F.lit(0).cast("long")))
    settled, done = [], (F.col("__n") <= group_rows) | (F.col("__lo") == F.col("__hi"))
    while True:
        settled.append(open_.where(done))
        open_ = open_.where(~done)
        if open_.isEmpty():
            break
        bins = (_null_safe(rows, measured(open_), keys).where((v >= F.col("__lo")) & (v <= F.col("__hi")))
                .groupBy(*by, "__below", _bin(v, F.col("__lo"), F.col("__hi")).alias("__bin"))
                .agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"), F.max("__v").alias("__hi")))
        upto = Window.partitionBy(*by).orderBy("__bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS + 2 rows
        bins = bins.withColumn("__start", F.col("__below") + F.coalesce(F.sum("__n").over(upto), F.lit(0)))
        held = (F.col("__rank") >= F.col("__start")) & (F.col("__rank") < F.col("__start") + F.col("__n"))
        open_ = cut_lineage(bins.where(held).select(*by, "__n", "__lo", "__hi", F.col("__start").alias("__below")))
    brackets = reduce(DataFrame.unionByName, settled)
    single = brackets.where("__lo = __hi").select(*by, F.col("__lo").alias("__value"))
    rest = brackets.where("__lo != __hi")
    counted = (_null_safe(rows, measured(rest), keys).where((v >= F.col("__lo")) & (v <= F.col("__hi")))
               .groupBy(*by, "__below", "__v").agg(F.count("*").alias("__c")))
    upto = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # at most group_rows rows
    ranked = counted.withColumn("__end", F.col("__below") + F.sum("__c").over(upto))
    found = ranked.where((F.col("__rank") < F.col("__end")) & (F.col("__rank") >= F.col("__end") - F.col("__c")))
    return single.unionByName(found.select(*by, F.col("__v").alias("__value")))


def exact_quantiles(df: DataFrame, keys: Sequence[str], value: str, probabilities: dict[str, float], group_rows: int = GROUP_ROWS,
                    upto: dict[str, float] | None = None) -> DataFrame:
    """``keys`` + one column per ``{name: probability}``, linear interpolation.

    NULL values are ignored, NaN is above all numbers; groups without values are absent, a NULL key is a key. Groups of up to
    ``group_rows`` rows are sorted each in a list; larger ones by :func:`order_statistics`, of which there are at most rows / group_rows.
    A name in ``upto`` is the quantile of the values up to that bound, NULL if there are none; all names are found in the same rounds.
    """
    if not keys:
        whole = df.select(F.lit(0).alias("__all"), F.col(value))
        return exact_quantiles(whole, ["__all"], value, probabilities, group_rows, upto).drop("__all")
    keys, names, upto = list(keys), list(probabilities), upto or {}
    bounds = {b: f"__n{i}" for i, b in enumerate(sorted(set(upto.values())))}
    data = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__v"))
    held = [F.count_if(F.col("__v") <= b).alias(c) for b, c in bounds.items()]
    large = cut_lineage(data.groupBy(*keys).agg(F.count("*").alias("__n"), *held).where(F.col("__n") > group_rows))

    def between(low: Column, high: Column, at: Column) -> Column:
        return F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at)))

    def sorted_whole(rows: DataFrame) -> DataFrame:
        every = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("__v")).alias("__s"))
        for b, c in bounds.items():
            every = every.withColumn(c, F.size(F.filter("__s", lambda x: x <= F.lit(b))))
        among = {n: F.col(bounds[upto[n]]) if n in upto else F.size("__s") for n in names}
        at = {n: F.when(among[n] > 0, F.lit(probabilities[n]) * (among[n] - 1)) for n in names}
        return every.select(*keys, *[between(F.get("__s", F.floor(a).cast("int")), F.get("__s", F.ceil(a).cast("int")), a).alias(n) for n, a in at.items()])

    if large.isEmpty():
        return sorted_whole(data)
    named = measured(large.select(*keys))
    small = sorted_whole(_null_safe(data, named, keys, "left_anti"))
    most = cut_lineage(_null_safe(data, named, keys, "left_semi"))  # read once a round
    among = {n: F.col(bounds[upto[n]] if n in upto else "__n") for n in names}
    spots = [F.struct(F.lit(n).alias("__name"), F.when(among[n] > 0, F.lit(probabilities[n]) * (among[n] - 1)).alias("__at")) for n in names]
    wanted = large.select(*keys, F.inline(F.array(*spots))).where("__at IS NOT NULL")
    wanted = wanted.select(*keys, "__name", "__at", F.explode(F.array(F.floor("__at"), F.ceil("__at"))).alias("__rank"))
    found = order_statistics(most, wanted, keys, "__v", group_rows)
    valued = _null_safe(wanted, found, [*keys, "__rank"])
    picked = valued.groupBy(*keys).agg(*[between(F.min(F.when(F.col("__name") == n, F.col("__value"))), F.max(F.when(F.col("__name") == n, F.col("__value"))),
                                                 F.max(F.when(F.col("__name") == n, F.col("__at")))).alias(n) for n in names])
    return small.unionByName(picked)


def residual_stats(df: DataFrame, keys: Sequence[str], value: str, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``n, median, p95, max`` of ``value`` per key; NULL statistics for empty groups."""
    if not keys:
        whole = df.select(F.lit(0).alias("__all"), F.col(value))
        return residual_stats(whole, ["__all"], value, group_rows).drop("__all")
    totals = df.groupBy(*keys).agg(F.count(value).alias("n"), F.max(value).cast("double").alias("max"))
    quantiles = exact_quantiles(df, keys, value, {"median": 0.5, "p95": 0.95}, group_rows)
    return _null_safe(totals, quantiles, list(keys), "left").select(*keys, "n", "median", "p95", "max")


def counted_stats(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Like :func:`residual_stats` for an integer column of bounded domain.

    A 16-bit sensor column has at most 65,536 distinct values per group, so the
    built-in exact ``percentile`` over value counts stays small for any row count.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("__c"))
    return counts.groupBy(*keys).agg(
        F.sum("__c").alias("n"),
        F.percentile(F.col(value), 0.5, F.col("__c")).alias("median"),
        F.percentile(F.col(value), 0.95, F.col("__c")).alias("p95"),
        F.max(value).cast("double").alias("max"),
    )
