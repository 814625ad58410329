"""How sources of a language diverge in their terms, by Gustavson row accumulation.

A group is a (language, source); its row holds how often it uses each term, smoothed and scaled to whole
numbers: ``p = 1 + floor(scale * (count + 1) / (N + V))``. Two groups are compared by
``f = floor((p - q)^2 / q)`` summed over all V terms of the language.

Rows are sparse, so a sum is split into what absent terms would give (the baseline, from a histogram of each row's values against the
peers' value of an absent term) and a correction for terms that both groups hold:

    f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0)

The corrections come from the term-major index: a block of terms lies in a task, each group walks through its terms,
reads the postings of each and scatters into one dense accumulator over the peers. No pair of postings ever leaves a task; a block gives one
number per pair of groups. All arithmetic is on whole numbers and exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.common import slices, stored

SCALE = 1_000_000_000
# A-Z lower-cased, every other ASCII character that is no letter a blank, all else as it is
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
HELD_TERMS = 300_000  # counts that a task holds before it hands them on
BLOCK_POSTINGS = 500_000


def terms_of(text: bytes) -> list[bytes]:
    """The matches of ``[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`` in UTF-8, A-Z lower-cased."""
    return text.translate(FOLD).split()


def count_terms(batches: Iterator[pa.RecordBatch], held_terms: int = HELD_TERMS) -> Iterator[pa.RecordBatch]:
    """``lang, source, term, n, df`` for the rows of a task, given ``lang, text, source``; a key comes again where the held counts were handed on."""
    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0

    def hand_on() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in held.items():
            terms = sorted(n)
            if terms:
                m = len(terms)
                yield pa.RecordBatch.from_arrays(
                    [pa.DictionaryArray.from_arrays(pa.array(np.zeros(m, np.int32)), pa.array([name], pa.string())).dictionary_decode() for name in (lang, source)]
                    + [pa.array(terms, pa.binary()), pa.array([n[t] for t in terms], pa.int64()), pa.array([df[t] for t in terms], pa.int64())],
                    ["lang", "source", "term", "n", "df"])
        held.clear()

    for batch in batches:
        for some in slices(batch):
            for lang, text, source in zip(*(c.to_pylist() for c in some.columns)):
                n, df = held.setdefault((lang, source), (Counter(), Counter()))
                before = len(n)
                terms = terms_of(text)
                n.update(terms)
                df.update(set(terms))
                size += len(n) - before
                if size > held_terms:
                    yield from hand_on()
                    size = 0
    yield from hand_on()


def smoothed(count: Column, total: Column, kept: Column) -> Column:
    """``1 + floor(SCALE * (count + 1) / (total + kept))`` in decimals, so that no size overflows; 1 if there are no terms."""
    up = F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)")
    return F.when(kept > 0, 1 + F.call_function("div", up, (total + kept).cast("decimal(20,0)"))).otherwise(F.lit(1)).cast("long")


def distance(p, q):
    """``floor((p - q)^2 / q)`` of whole-number arrays; p and q are at most SCALE + 1, so squares fit."""
    d = p - q
    return d * d // q


def term_index(base: DataFrame, least_docs: int, held_terms: int = HELD_TERMS) -> DataFrame:
    """The term-major index: ``lang, term, postings (source, n), total`` of terms in at least ``least_docs`` documents of their language."""
    partial = base.mapInArrow(lambda batches: count_terms(batches, held_terms), "lang string, source string, term binary, n long, df long")
    dealt = partial.repartition("lang", "term")  # one exchange serves both groupings
    per = dealt.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    return (per.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("postings"), F.sum("n").alias("total"), F.sum("df").alias("df"))
            .filter(F.col("df") >= least_docs).drop("df"))


def group_table(base: DataFrame, index: DataFrame) -> DataFrame:
    """Every group: ``lang, source, no, kept, lang_total, total, p0``; ``no`` counts the sources of a language in byte order."""
    every = base.select("lang", "source").distinct()
    totals = index.select("lang", F.inline("postings")).groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = index.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("total").alias("lang_total"))
    return (every.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0, ["total", "kept", "lang_total"])
            .withColumn("no", F.row_number().over(Window.partitionBy("lang").orderBy("source")))
            .withColumn("p0", smoothed(F.lit(0), F.col("total"), F.col("kept"))))


def accumulate_rows(batches: Iterator[pa.RecordBatch], block_postings: int = BLOCK_POSTINGS) -> Iterator[pa.RecordBatch]:
    """Gustavson over postings ``lang, term, no, p, p0`` sorted by language and term: ``lang, no, peer, value`` per block of whole terms."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def block(table: pa.Table) -> Iterator[pa.RecordBatch]:
        names = np.array(table.column("lang").to_pylist(), object)
        same = np.flatnonzero(np.r_[True, names[1:] != names[:-1]])
        for lo, hi in zip(same, np.r_[same[1:], len(names)]):
            yield from language(names[lo], table.slice(lo, hi - lo))

    def language(name: str, table: pa.Table) -> Iterator[pa.RecordBatch]:
        term = table.column("term").combine_chunks().dictionary_encode()
        if isinstance(term, pa.ChunkedArray):
            term = term.chunk(0)
        term = np.asarray(term.indices)  # numbered as they come, and sorted, so postings of a term lie together
        no, p, p0 = (table.column(c).to_numpy() for c in ("no", "p", "p0"))
        starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        lengths = np.diff(np.r_[starts, len(term)])
        groups, code = np.unique(no, return_inverse=True)
        base = np.zeros(len(groups), np.int64)
        base[code] = p0
        by_row = np.argsort(code, kind="stable")
        edges = np.searchsorted(code[by_row], np.arange(len(groups) + 1))
        for g in range(len(groups)):
            mine = by_row[edges[g]:edges[g + 1]]
            accumulator = np.zeros(len(groups), np.int64)
            touched = np.zeros(len(groups), bool)
            reach = np.cumsum(lengths[term[mine]])
            at = 0
            while at < len(mine):  # a bounded number of postings at a time
                to = max(at + 1, int(np.searchsorted(reach, (reach[at - 1] if at else 0) + block_postings, "right")))
                some = mine[at:to]
                many = lengths[term[some]]
                ends = np.cumsum(many)
                posting = np.repeat(starts[term[some]] - (ends - many), many) + np.arange(ends[-1])
                own, peer = np.repeat(p[some], many), code[posting]
                theirs, absent = p[posting], base[peer]
                np.add.at(accumulator, peer, distance(own, theirs) - distance(own, absent) - distance(base[g], theirs) + distance(base[g], absent))
                touched[peer] = True
                at = to
            touched[g] = False
            peers = groups[touched]
            if len(peers):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(peers), pa.string()), pa.array(np.full(len(peers), groups[g])), pa.array(peers),
                                                  pa.array(accumulator[touched])], ["lang", "no", "peer", "value"])

    for batch in batches:
        while batch.num_rows:
            if rows >= block_postings:  # close the block where the next term begins
                last = held[-1].slice(held[-1].num_rows - 1)
                key = last.column(0)[0].as_py(), last.column(1)[0].as_py()
                go_on = 0
                while go_on < batch.num_rows and (batch.column(0)[go_on].as_py(), batch.column(1)[go_on].as_py()) == key:
                    go_on += 1
                if go_on:
                    held.append(batch.slice(0, go_on))
                    rows += go_on
                    batch = batch.slice(go_on)
                if batch.num_rows:
                    yield from block(pa.Table.from_batches(held))
                    held, rows = [], 0
            else:
                take = min(batch.num_rows, block_postings - rows)
                held.append(batch.slice(0, take))
                rows += take
                batch = batch.slice(take)
    if held:
        yield from block(pa.Table.from_batches(held))


def baselines(batches: Iterator[pa.RecordBatch], block: int = BLOCK_POSTINGS) -> Iterator[pa.RecordBatch]:
    """Per group ``lang, no, kept, p0, values (p, m), peers (no, p0)``: its whole row against each peer's absent term, for the
    pair (group, peer), and each peer's absent term against its row less the absent terms, for the pair (peer, group)."""
    for batch in batches:
        for row in batch.to_pylist():
            values = row["values"] or []
            p, m = (np.array([v[c] for v in values], np.int64) for c in ("p", "m"))
            absent = row["kept"] - m.sum()
            peers = np.array([x["no"] for x in row["peers"]], np.int32)
            theirs = np.array([x["p0"] for x in row["peers"]], np.int64)
            step = max(1, block // max(1, len(p)))
            whole, back = [], []
            for lo in range(0, len(peers), step):
                q = theirs[lo:lo + step]
                whole.append((distance(p[None, :], q[:, None]) * m).sum(axis=1) + absent * distance(row["p0"], q))
                back.append((distance(q[:, None], p[None, :]) * m).sum(axis=1) - m.sum() * distance(q, np.int64(row["p0"])))
            other = peers != row["no"]
            peers, whole, back = peers[other], np.concatenate(whole)[other], np.concatenate(back)[other]
            me = np.full(len(peers), row["no"], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([row["lang"]] * (2 * len(peers)), pa.string()), pa.array(np.r_[me, peers]), pa.array(np.r_[peers, me]),
                 pa.array(np.r_[whole, back])], ["lang", "no", "peer", "value"])


def divergence(docs: DataFrame, least_docs: int = 3, top: int = 200, lang_col: str = "lang", source_col: str = "source", text_col: str = "text",
               held_terms: int = HELD_TERMS, block_postings: int = BLOCK_POSTINGS) -> DataFrame:
    """``lang, source, part, item, value, rank``: each group's distance to its peers, and the terms that set it apart from its language.

    Part ``pair``: item is another source of the language, all ranks. Part ``term``: item is a kept term that the group uses more than its
    language does, ``top`` ranks. Ranks go by value, larger first, then by the item's bytes.

    Null texts, languages and sources read as ''. Repeated rows count each. A language without kept terms has values 0. Other columns
    are not read. Empty input gives an empty result. Counts are combined per task before they are dealt by term, so a group with a third of
    all rows is no hot key; only tables of groups are ever gathered by group. ``held_terms`` and ``block_postings`` bound what a task holds, and change no result.
    """
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    base = docs.select(text(lang_col).alias("lang"), text(text_col).cast("binary").alias("text"), text(source_col).alias("source"))
    index = stored(term_index(base, least_docs, held_terms), "divergence-index")
    groups = stored(group_table(base, index), "divergence-groups")
    rows = (index.select("lang", "term", F.col("total").alias("all"), F.inline("postings"))
            .join(groups, ["lang", "source"])
            .withColumn("p", smoothed(F.col("n"), F.col("total"), F.col("kept"))))

    q = smoothed(F.col("all"), F.col("lang_total"), F.col("kept"))
    apart = F.col("p") - F.col("q")
    terms = (rows.withColumn("q", q).filter("p > q")
             .select("lang", "source", "term", F.expr("(p - q) * (p - q) div q").alias("value")))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    terms = (terms.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
             .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank"))

    names = "lang string, no int, peer int, value long"
    shared = (rows.select("lang", "term", "no", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "no")
              .mapInArrow(lambda batches: accumulate_rows(batches, block_postings), names))
    values = rows.groupBy("lang", "no", "p").agg(F.count(F.lit(1)).alias("m"))
    values = values.groupBy("lang", "no").agg(F.collect_list(F.struct("p", "m")).alias("values"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("no", "p0")).alias("peers"))
    alone = (groups.select("lang", "no", "kept", "p0").join(values, ["lang", "no"], "left").join(peers, "lang")
             .select("lang", "no", "kept", "p0", "values", "peers").mapInArrow(lambda batches: baselines(batches, block_postings), names))
    sums = (shared.unionByName(alone).groupBy("lang", "no", "peer").agg(F.sum(F.col("value").cast("decimal(38,0)")).cast("long").alias("value")))
    own = groups.select("lang", "no", "source")
    pairs = sums.join(own, ["lang", "no"]).join(own.select("lang", F.col("no").alias("peer"), F.col("source").alias("item")), ["lang", "peer"])
    nearest = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(nearest).alias("rank"))
    return pairs.unionByName(terms)
