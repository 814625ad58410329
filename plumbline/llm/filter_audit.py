"""What filters do to a corpus in every order, from one pass over the texts.

Each document gets a mask of the filters that it fails. Documents of a part (a source) fall into mask cells with
counts; everything else follows from the cells. Which documents survive a set of filters depends on the set alone, so a part
has 2^n states for n filters. A Gray code visits them: consecutive sets differ in one filter, and only the
cells that fail this filter change. Each cell has a counter of the active filters that it fails; a counter that
leaves 0 takes its cell out of the running survivors, one that returns to 0 puts it back. Steps of an order are differences
of two states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.llm.common import slices, stored

FILTERS = "ABCDE"
COPY = 16  # the bit of filter E
# fixed values of the filters
FEW_WORDS, DISTINCT_SHARE, CAPITAL_SHARE = 200, 50, 2
CAPITALS, SIGNS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
INNER_BYTES = bytes(range(0x80, 0xC0))  # UTF-8 bytes that begin no code point


def own_failures(text: bytes) -> int:
    """Filters A to D as bits 1, 2, 4, 8: what a text fails by itself."""
    words = text.split()  # on \x20 and \x09-\x0D
    points = len(text.translate(None, INNER_BYTES))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    return ((len(words) < FEW_WORDS)
            | (100 * len(set(words)) < DISTINCT_SHARE * len(words)) << 1
            | (100 * capitals > CAPITAL_SHARE * points) << 2
            | (len(text.translate(None, SIGNS)) < len(text)) << 3)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``doc_id, part, mask, digest`` of every document: its own failures and the SHA-256 of its whole text."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("text"),
                       F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("part"))
    ddl = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in slices(batch):
                texts = some.column(1).to_pylist()
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), some.column(2), pa.array([own_failures(t) for t in texts], pa.int32()),
                     pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "part", "mask", "digest"])

    return rows.mapInArrow(run, ddl)


def cells(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``part, mask, docs, good, toxic``: documents by the filters that they fail, at most 32 rows a part.

    A copy fails E if an equal text has a smaller id; a document without an id has no smaller one and is none. Rows
    equal in everything are counted before they are dealt by id, and the smallest id of a text is a map-side minimum, so neither a text
    nor an id that holds a third of all rows gathers in one task. An id that ``labels`` holds several times is good, or toxic, if one row says so.
    """
    marks = stored(judged(docs, id_col, text_col, source_col), "filter-marks")
    counted = marks.groupBy("doc_id", "part", "mask", "digest").agg(F.count(F.lit(1)).alias("n"))
    first = marks.groupBy("digest").agg(F.min("doc_id").alias("first_id")).filter("first_id IS NOT NULL")
    named = labels.select(F.col("doc_id").alias("label_id"), (F.col("quality") == 1).alias("quality"), (F.col("toxic") == 1).alias("toxic"))
    named = named.groupBy("label_id").agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    rows = (counted.join(named, F.col("doc_id") == F.col("label_id"), "left")
            .join(first.withColumnRenamed("digest", "first_digest"),
                  (F.col("digest") == F.col("first_digest")) & (F.col("doc_id") == F.col("first_id")), "left"))
    copy = F.col("doc_id").isNotNull() & F.col("first_id").isNull()
    return (rows.groupBy("part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"))
            .agg(F.sum("n").alias("docs"), F.sum(F.when(F.col("quality"), F.col("n")).otherwise(0)).alias("good"),
                 F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic")))


def gray_states(table: np.ndarray) -> np.ndarray:
    """Survivors of every set of filters, from cell counts whose first axis is the mask; one state per set on the first axis."""
    size = len(table)
    failing = np.arange(size)
    active = np.zeros(size, np.int64)  # per mask cell: active filters that it fails
    survivors = table.sum(axis=0)
    states = np.empty_like(table)
    states[0] = survivors
    chosen = 0
    for step in range(1, size):
        bit = step & -step
        chosen ^= bit
        touched = failing[(failing & bit) > 0]
        if chosen & bit:
            survivors = survivors - table[touched[active[touched] == 0]].sum(axis=0)
            active[touched] += 1
        else:
            active[touched] -= 1
            survivors = survivors + table[touched[active[touched] == 0]].sum(axis=0)
        states[chosen] = survivors
    return states


def steps_of(states: np.ndarray, failing: np.ndarray, alone: np.ndarray, filters: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The steps of all orders for the parts on the second axis: orders, step numbers, and per (order and step, part) the seven counts."""
    orders, numbers, before, at = [], [], [], []
    for order in permutations(range(len(filters))):
        chosen = 0
        for k, f in enumerate(order):
            orders.append("".join(filters[x] for x in order))
            numbers.append(k + 1)
            before.append(chosen)
            at.append(f)
            chosen |= 1 << f
    before, at = np.array(before), np.array(at)
    lost = states[before] - states[before | (1 << at)]  # (step, part, docs|good|toxic)
    removed = lost[:, :, 0]
    shapley = np.stack([removed[at == f].sum(axis=0) for f in range(len(filters))])
    counts = np.stack([states[before | (1 << at)][:, :, 0], removed, failing[at] - removed, alone[at], lost[:, :, 1], lost[:, :, 2], shapley[at]], axis=2)
    return orders, np.array(numbers, np.int32), counts


COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, filters: str = FILTERS, **columns: str) -> DataFrame:
    """Every step of every order of the filters, per part: ``part, filter_order, step`` and the counts of ``COUNTS``.

    ``kept`` survive the step, ``removed`` go at it, ``redundant`` fail its filter but went before, ``unique_fails`` fail its filter alone,
    ``good_lost`` and ``toxic_lost`` go at it and are labelled so, ``shapley`` is what its filter removes summed over all orders. Null
    texts are empty, a null source is the part ''. Repeated rows count each. Documents without labels are neither good nor toxic; columns other than those named are
    not read. Empty input gives an empty result.
    """
    cell = F.struct("mask", "docs", "good", "toxic")
    parts = cells(docs, labels, **columns).groupBy("part").agg(F.collect_list(cell).alias("cells"))  # 32 at most
    size = 1 << len(filters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                some = batch.slice(lo, 64)
                names = some.column(0).to_pylist()
                table = np.zeros((size, len(names), 3), np.int64)
                for k, held in enumerate(some.column(1).to_pylist()):
                    for c in held:
                        table[c["mask"], k] = c["docs"], c["good"], c["toxic"]
                bits = [1 << f for f in range(len(filters))]
                failing = np.stack([table[(np.arange(size) & b) > 0, :, 0].sum(axis=0) for b in bits])
                orders, numbers, counts = steps_of(gray_states(table), failing, table[bits][:, :, 0], filters)
                for k, name in enumerate(names):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(orders), pa.string()), pa.array(orders, pa.string()), pa.array(numbers),
                         *(pa.array(counts[:, k, c]) for c in range(len(COUNTS)))], ["part", "filter_order", "step", *COUNTS])

    return parts.mapInArrow(run, "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS))
