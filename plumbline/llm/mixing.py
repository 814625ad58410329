"""Mixing sources to target weights by a time-varying curriculum.

Each source has a weight schedule over training time t in [0, 1]. Its integral is the
source's share of the mix; targets beyond ``max_epochs`` times the source's size are cut
there and the excess is reshared by weight. Within a source, documents follow one another in
the order of a digest of their id; a document that begins after ``c`` words of its source is
trained at the time when the source's cumulative demand reaches ``c``. Repeats continue the
stream, so the second copy of a document lies one source size further on.

Only DataFrame functions. Prefix sums are taken in two levels, (source, digest bucket) and
buckets of a source, so a source that holds a third of all rows is many small windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import WORD, stored

# knots of (t, factor); the factor multiplies the source's weight, linear between knots
FLAT = ((0.0, 1.0), (1.0, 1.0))
FADING = ((0.0, 1.5), (1.0, 0.5))
RISING = ((0.0, 0.5), (1.0, 1.5))
SLOTS = 1_024  # cuts of training time by which whole texts are dealt out


def words_of(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+`` of the whole text; null has 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def integral(knots: Sequence[tuple[float, float]]) -> float:
    return sum((t1 - t0) * (f0 + f1) / 2 for (t0, f0), (t1, f1) in zip(knots, knots[1:]))


def time_at(share: Column, knots: Sequence[tuple[float, float]]) -> Column:
    """The t at which the schedule's integral reaches ``share`` of its whole."""
    whole, done, pieces = integral(knots), 0.0, []
    for (t0, f0), (t1, f1) in zip(knots, knots[1:]):
        area = (t1 - t0) * (f0 + f1) / 2
        slope = (f1 - f0) / (t1 - t0)
        need = F.greatest(share * F.lit(whole) - F.lit(done), F.lit(0.0))
        # need = f0 x + slope x^2 / 2, written so that a flat piece divides by f0 only
        root = F.sqrt(F.greatest(F.lit(f0 * f0) + F.lit(2 * slope) * need, F.lit(0.0)))
        step = F.when(F.lit(f0) + root > 0, F.lit(2.0) * need / (F.lit(f0) + root)).otherwise(F.lit(0.0))
        pieces.append((done + area, F.lit(t0) + F.least(step, F.lit(t1 - t0))))
        done += area
    out = pieces[-1][1]
    for upto, value in reversed(pieces[:-1]):
        out = F.when(share * F.lit(whole) < F.lit(upto), value).otherwise(out)
    return out


def source_targets(sized: DataFrame, weights: Sequence[float] = (5, 2, 1),
                   schedules: Sequence = (FADING, FLAT, RISING), max_epochs: int = 3) -> DataFrame:
    """One row per source: ``source_key, source_size, schedule, target``.

    Sources rank by code point, null last, and take the weights in turn. ``target`` is
    ``min(max_epochs * size, level * weight)`` with the level at which all targets sum to all
    sizes. The windows run over one row per source.
    """
    factor = [w * integral(k) for w, k in zip(weights, schedules, strict=True)]
    per = sized.groupBy("source_key").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source_key.is_null"), F.col("source_key.value"))) - 1
    turn = (F.col("rank") % len(weights)).cast("int")
    per = (per.withColumn("rank", rank)
           .withColumn("schedule", turn)
           .withColumn("weight", F.element_at(F.array(*map(F.lit, factor)), turn + 1))
           .withColumn("ceiling", F.col("source_size").cast("double") * max_epochs)
           .withColumn("ratio", F.col("ceiling") / F.col("weight")))
    upto = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total, heavy = F.sum("source_size").over(whole), F.sum("weight").over(whole)
    at_ratio = F.sum("ceiling").over(upto) + F.col("ratio") * (heavy - F.sum("weight").over(upto))
    per = per.withColumn("full", at_ratio <= total).withColumn("total", total)
    spare = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("ceiling"))).over(whole), F.lit(0.0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(whole)
    target = F.when(F.col("full"), F.col("ceiling")).otherwise(spare * F.col("weight") / open_weight)
    return per.select("source_key", "source_size", "schedule", target.alias("target"))


def _source_and_digest(id_col: str, source_col: str) -> tuple[Column, Column]:
    key = F.struct(F.col(source_col).isNull().alias("is_null"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("value"))
    return key.alias("source_key"), F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")).alias("digest")


def _taken() -> Column:
    rest = F.col("whole") - F.col("rounds") * F.col("source_size")
    return F.col("rounds") * F.col("size") + F.least(F.greatest(rest - F.col("start"), F.lit(0)), F.col("size"))


def _placed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: Sequence[float] = (5, 2, 1), schedules: Sequence = (FADING, FLAT, RISING), max_epochs: int = 3) -> DataFrame:
    """:func:`plan_mix` with ``source_key, digest, whole, rounds``. Texts are read once; what is dealt out is a few numbers a document."""
    base = docs.select(F.col(id_col).alias("doc_id"), *_source_and_digest(id_col, source_col), words_of(F.col(text_col)).alias("size"))
    base = stored(base.withColumn("bucket", F.substring("digest", 1, 3)), "mix-sizes")
    buckets = stored(base.groupBy("source_key", "bucket").agg(F.sum("size").alias("size")), "mix-buckets")
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = (buckets.withColumn("bucket_start", F.coalesce(F.sum("size").over(before), F.lit(0)))
              .drop("size")
              .join(source_targets(buckets, weights, schedules, max_epochs), "source_key"))
    within = (Window.partitionBy("source_key", "bucket").orderBy("digest", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    whole = F.round("target").cast("long")
    rounds = F.when(F.col("source_size") > 0, F.floor(F.col("whole") / F.col("source_size"))).otherwise(0).cast("long")
    return (base.join(places, ["source_key", "bucket"])
            .withColumn("start", F.col("bucket_start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
            .withColumn("whole", whole).withColumn("rounds", rounds).withColumn("taken", _taken()))


def plan_mix(docs: DataFrame, **options) -> DataFrame:
    """Every document with its place in the mix.

    Returns ``doc_id, size, source_size, target, taken, start, schedule``. ``taken`` counts the words
    the mix takes from the document, repeats included; the document at a source's boundary is
    taken in part, so that the words taken are the rounded target. Null texts and texts without words have
    size 0 and are never taken. Equal ids keep separate places, ordered by size; rows equal in
    both are interchangeable. Empty input gives an empty result. Options: ``id_col, text_col, source_col, weights, schedules, max_epochs``.
    """
    return _placed(docs, **options).select("doc_id", "size", "source_size", "target", "taken", "start", "schedule")


def _begins(epoch: Column, schedules: Sequence) -> Column:
    """The training time at which a copy begins."""
    share = (F.col("start") + epoch * F.col("source_size")) / F.col("target")
    at = F.lit(None).cast("double")
    for k, knots in enumerate(schedules):
        at = F.when(F.col("schedule") == k, time_at(share, knots)).otherwise(at)
    return at


def with_positions(plan: DataFrame, schedules: Sequence = (FADING, FLAT, RISING)) -> DataFrame:
    """The plan with ``positions``: the training time in [0, 1] at which each copy of the document begins, first copy first.

    A document that is not taken has an empty list.
    """
    many = F.ceil(F.col("taken") / F.col("size")).cast("int")
    epochs = F.when(F.col("taken") > 0, F.sequence(F.lit(0), many - 1)).otherwise(F.array().cast("array<int>"))
    return plan.withColumn("positions", F.transform(epochs, lambda epoch: _begins(epoch, schedules)))


def copies(plan: DataFrame, schedules: Sequence = (FADING, FLAT, RISING)) -> DataFrame:
    """One row per copy that the mix takes: the plan's columns with ``epoch, position, words``.

    ``position`` is the training time in [0, 1] at which the copy begins; ``words`` is below the
    document's size only for the copy at the boundary of its source.
    """
    kept = [c for c in plan.columns if c != "positions"]
    return (with_positions(plan, schedules).select(*kept, F.posexplode("positions").alias("epoch", "position"))
            .withColumn("words", F.least("size", F.col("taken") - F.col("epoch") * F.col("size"))))


def mix_in_order(docs: DataFrame, **options) -> DataFrame:
    """The plan of every document, range-sorted by the position of its first copy; documents that are not taken come last.

    Adds ``copies`` and ``first_position, last_position`` (null if not taken) to ``plan_mix``. Ties go by ``doc_id``.
    """
    placed = with_positions(plan_mix(docs, **options), options.get("schedules", (FADING, FLAT, RISING)))
    placed = (placed.withColumn("copies", F.size("positions").cast("long"))
              .withColumn("first_position", F.get("positions", F.lit(0)))
              .withColumn("last_position", F.get("positions", F.size("positions") - 1)).drop("positions"))
    order = (F.col("first_position").asc_nulls_last(), F.col("doc_id").asc_nulls_last())
    return placed.repartitionByRange(*order).sortWithinPartitions(*order)


def _stretches(docs: DataFrame, schedules: Sequence, slots: int, options: dict) -> DataFrame:
    """Where copies lie: a row per source and first two digits of the digest, with ``units(slot, epoch, first, last, start)``.

    Training time is cut into ``slots``. Inside a source and epoch, time follows the digest, so a unit is a range of digests
    and the words before it. Copies of one digest (equal ids) stay in one slot: a cut that would part them is left out.
    """
    kept = copies(_placed(docs, **options), schedules).filter(2 * F.col("words") >= F.col("size"))
    slot = F.least(F.floor(F.col("position") * slots), F.lit(slots - 1)).cast("int")
    per_source = F.first(F.struct("source_size", "target", "schedule", "whole", "rounds")).alias("mix")
    digests = stored(kept.withColumn("slot", slot).groupBy("source_key", "epoch", "digest").agg(
        F.min("slot").alias("slot"), F.max("slot").alias("last_slot"), F.min("start").alias("start"), per_source), "mix-digests")
    parting = digests.filter("slot < last_slot").select(F.explode(F.sequence(F.col("slot") + 1, F.col("last_slot"))).alias("slot")).distinct()
    left_out = {r["slot"] for r in parting.collect()}  # fewer than ``slots``
    if left_out:
        joined = list(range(slots))
        for k in sorted(left_out):
            joined[k] = joined[k - 1]
        digests = digests.withColumn("slot", F.get(F.array(*map(F.lit, joined)), F.col("slot")))
    units = digests.groupBy("source_key", F.substring("digest", 1, 2).alias("prefix"), "slot", "epoch").agg(
        F.min("digest").alias("first"), F.max("digest").alias("last"), F.min("start").alias("start"), F.first("mix").alias("mix"))
    return units.groupBy("source_key", "prefix").agg(F.first("mix").alias("mix"), F.collect_list(F.struct("slot", "epoch", "first", "last", "start")).alias("units"))


def mixed_documents(docs: DataFrame, columns: Sequence[str] = ("doc_id", "text", "lang", "source", "n_chars"), slots: int = SLOTS, **options) -> DataFrame:
    """The mix itself: a row per copy taken, range-sorted by training position. Columns other than the named ones are left out.

    Texts stay whole: the copy at its source's boundary comes if at least half of its words are taken, so a source's words
    differ from its target by at most half a document, and a source of one document whose target is below half of it is absent.

    Texts are dealt out once, by slots of training time that their digests give away; places inside a slot are counted there.
    The table of slots is sent to all tasks: about ``slots`` + 256 digest ranges per source and epoch.
    """
    schedules = options.get("schedules", (FADING, FLAT, RISING))
    id_col, text_col, source_col = (options.get(f"{k}_col", d) for k, d in (("id", "doc_id"), ("text", "text"), ("source", "source")))
    carried = F.struct(*dict.fromkeys([*columns, id_col, text_col])).alias("carried")
    rows = docs.select(carried, *_source_and_digest(id_col, source_col)).withColumn("prefix", F.substring("digest", 1, 2))
    met = F.filter("units", lambda u: (u["first"] <= F.col("digest")) & (F.col("digest") <= u["last"]))
    dealt = (rows.join(F.broadcast(_stretches(docs, schedules, slots, options)), ["source_key", "prefix"])
             .select("carried", "source_key", "prefix", "digest", "mix", F.explode(met).alias("unit"))
             .select("carried", "source_key", "prefix", "digest", "mix.*", "unit.slot", "unit.epoch", "unit.start")
             .repartitionByRange("slot")
             .withColumn("size", words_of(F.col(f"carried.{text_col}"))))
    within = Window.partitionBy("slot", "source_key", "prefix", "epoch").orderBy("digest", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = (dealt.withColumn("start", F.col("start") + F.coalesce(F.sum("size").over(within), F.lit(0)))
              .filter((F.col("size") > 0) & (2 * F.least(F.col("size"), _taken() - F.col("epoch") * F.col("size")) >= F.col("size"))))
    return (placed.select(_begins(F.col("epoch"), schedules).alias("position"), "epoch", "carried")
            .sortWithinPartitions("position", f"carried.{id_col}", "epoch").select(*[F.col(f"carried.{c}").alias(c) for c in columns]))
