"""MinHash near-duplicates: universal hash minima, banding, verification, connected components.

1. A document's set of word shingles is hashed; ``bands * rows`` strongly universal hash functions give its minima. Equal sets
   are one node, named by its smallest id.
2. Minima are cut into bands; a band's values are a bucket. At a similarity of 0.8, bands of 5 rows miss a link with
   a chance of 3e-6.
3. Members of a bucket are held against its smallest id, signature first, then word by word on whole texts. Links give components by
   alternating large-star and small-star.
4. A bucket whose members then lie in several components is looked at again: its guests (members outside its largest
   component) are held against that component, and against each other. That completes step 3 without
   all pairs of a group: members already joined are never compared, and comparisons run in blocks inside tasks, which return links only.

Texts are shuffled only for ids that share a bucket. Hot buckets, components and copies are cut into blocks by their counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import slices, stored

BANDS, ROWS = 32, 5
BLOCK = 256
SCREEN = 0.15  # below the threshold, in shared minima: 4.7 standard deviations of 160 minima at 0.8
MASK = (1 << 64) - 1


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lowered; byte methods know just these."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingle_set(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    """Distinct shingles; a shorter text is one shingle, a text without words none."""
    words = words_of(text)
    if 0 < len(words) < size:
        return {tuple(words)}
    return set(zip(*(words[k:] for k in range(size))))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(texts: list[str | None], size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; word hashes are computed once per slice."""
    words = [words_of(t) for t in texts]
    flat = [w for ws in words for w in ws]
    hashes = pd.util.hash_array(np.array(flat, dtype=object), categorize=True) if flat else np.empty(0, np.uint64)
    at = 0
    for ws in words:
        h = hashes[at:at + len(ws)]
        at += len(ws)
        span = min(size, len(h))
        if not span:
            yield h
            continue
        out = np.full(len(h) - span + 1, span, dtype=np.uint64)
        for k in range(span):
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k:len(h) - span + 1 + k])
        yield np.unique(out)


def coefficients(count: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = np.random.default_rng(seed)
    return random.integers(0, MASK, count, dtype=np.uint64, endpoint=True), random.integers(0, MASK, count, dtype=np.uint64, endpoint=True)


def minima(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of ``(a x + b) >> 32`` over the 32-bit ``x`` of the set, for each pair of coefficients."""
    low = None
    for k in range(0, len(hashes), 2048):
        x = (hashes[k:k + 2048] >> np.uint64(32))[:, None] * a
        x += b
        part = x.min(axis=0)
        low = part if low is None else np.minimum(low, part)
    return low >> np.uint64(32)


def marks(docs: DataFrame, size: int, bands: int, rows: int, seed: int) -> DataFrame:
    """``doc_id, n_shingles, mark`` (a digest of the set), ``keys`` (a bucket per band), ``minima`` (a byte of each) of every document; null marks for empty sets."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("mark", pa.binary()), ("keys", pa.list_(pa.int64())), ("minima", pa.binary())])
    ddl = "doc_id long, n_shingles long, mark binary, keys array<long>, minima binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = coefficients(bands * rows, seed)
        salt = mixed(np.arange(1, bands + 1, dtype=np.uint64))
        for batch in batches:
            for part in slices(batch):
                out = {"n": [], "mark": [], "keys": [], "minima": []}
                for hashes in shingle_hashes(part.column(1).to_pylist(), size):
                    out["n"].append(len(hashes))
                    if not len(hashes):
                        for name in ("mark", "keys", "minima"):
                            out[name].append(None)
                        continue
                    low = minima(hashes, a, b)
                    key = salt.copy()
                    for value in low.reshape(bands, rows).T:
                        key = mixed(key * np.uint64(0x9E3779B97F4A7C15) + value)
                    out["mark"].append(blake2b(hashes.tobytes(), digest_size=16).digest())
                    out["keys"].append(key.view(np.int64))
                    out["minima"].append(low.astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["mark"], pa.binary()),
                                                  pa.array(out["keys"], pa.list_(pa.int64())), pa.array(out["minima"], pa.binary())], schema=schema)

    return docs.mapInArrow(run, ddl)


def stars(edges: DataFrame) -> DataFrame:
    """``node, root`` of every node in an edge, by alternating large-star and small-star until nothing changes.

    ``edges`` has columns ``u, v``. Each round is written to the shared folder. ``root`` is the component's smallest node.
    """
    def state(e: DataFrame):
        r = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % F.lit(1 << 40)), F.sum(F.col("v") % F.lit(1 << 40))).first()
        return tuple(r)

    edges = stored(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    seen = state(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.join(low, "u").filter("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        edges = stored(small, "small-star")
        now = state(edges)
        if now == seen:
            break
        seen = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def linked(a: set, b: set, share: int) -> bool:
    """``100 * |a & b| >= share * |a | b|``."""
    if 100 * min(len(a), len(b)) < share * max(len(a), len(b)):
        return False
    both = len(a & b)
    return 100 * both >= share * (len(a) + len(b) - both)


def compare(cells: DataFrame, texts: DataFrame, size: int, share: int) -> DataFrame:
    """Links ``u, v`` found in cells of ``cell, left, id, root``: rows on the left against rows on the right, of unequal roots.

    Pairs are screened by their minima, confirmed on whole texts, and skipped once their roots are joined in the cell.
    """
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        left, right = rows[rows["left"]].reset_index(drop=True), rows[~rows["left"]].reset_index(drop=True)
        out = []
        if len(left) and len(right):
            parent: dict[int, int] = {}

            def top(x: int) -> int:
                while parent.get(x, x) != x:
                    x = parent[x]
                return x

            sets: dict[int, set] = {}

            def shingles(rows: pd.DataFrame, k: int) -> set:
                name = int(rows["id"][k])
                if name not in sets:
                    sets[name] = shingle_set(rows["text"][k], size)
                return sets[name]

            count = len(left["minima"][0])
            lows = np.frombuffer(b"".join(left["minima"]), np.uint8).reshape(-1, count)
            roots, ids, n = left["root"].to_numpy(), left["id"].to_numpy(), left["n_shingles"].to_numpy()
            for k in range(len(right)):
                shared = (lows == np.frombuffer(right["minima"][k], np.uint8)).sum(axis=1)
                m = right["n_shingles"][k]
                fit = (shared >= (share / 100 - SCREEN) * count) & (100 * np.minimum(n, m) >= share * np.maximum(n, m)) & (ids != right["id"][k])
                order = np.flatnonzero(fit)
                for j in order[np.argsort(-shared[order], kind="stable")]:
                    one, two = top(int(roots[j])), top(int(right["root"][k]))
                    if one != two and linked(shingles(left, j), shingles(right, k), share):
                        parent[max(one, two)] = min(one, two)
                        out.append((int(ids[j]), int(right["id"][k])))
        return pd.DataFrame(out, columns=["u", "v"])

    return cells.join(texts, "id").groupBy("cell").applyInPandas(run, "u long, v long")


def chunk_of(chunks: str) -> Column:
    return F.pmod(F.xxhash64("id"), F.col(chunks))


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, share: int = 80,
               bands: int = BANDS, rows: int = ROWS, seed: int = 3) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` of every document.

    Documents with ``100 * |intersection| >= share * |union|`` of their shingle sets are linked; ``component_id`` is the smallest id reachable,
    ``kept`` marks the document that has it. Empty and null texts are linked with nothing. Rows that repeat an id count as one document with the
    links of all its texts. Rows without an id are compared too but never kept. Empty input gives an empty result.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    every = stored(marks(base, size, bands, rows, seed), "minhash")
    first = every.filter("mark is not null and doc_id is not null").groupBy("mark").agg(F.min("doc_id").alias("id"))
    first = stored(first, "minhash-sets")
    nodes = every.join(first.withColumnRenamed("mark", "m"), (F.col("mark") == F.col("m")) & (F.col("doc_id") == F.col("id"))).dropDuplicates(["m", "id"]).select("id", "n_shingles", "minima", "keys")
    nodes = stored(nodes, "minhash-nodes")
    member = nodes.select("id", "n_shingles", F.explode("keys").alias("key"))
    shared = member.groupBy("key").agg(F.min("id").alias("center"), F.max("id").alias("other")).filter("center < other").select("key", "center")
    member = stored(member.join(shared, "key").select("key", "id", "center"), "minhash-buckets")
    involved = member.select("id").distinct()
    low = nodes.select("id", "n_shingles", "minima").join(involved, "id")
    texts = base.select(F.col("doc_id").alias("id"), "text", F.xxhash64("text").alias("h")).join(low, "id").dropDuplicates(["id", "h"]).drop("h")
    texts = stored(texts, "minhash-texts")

    # each bucket's members against its smallest id
    pairs = stored(member.filter("id <> center").select("center", "id").distinct(), "minhash-pairs")
    per = pairs.groupBy("center").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("chunks"))
    right = pairs.join(per, "center").select(F.struct("center", chunk_of("chunks").alias("chunk")).alias("cell"), F.lit(False).alias("left"), "id", F.col("id").alias("root"))
    left = per.select(F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"), "center")
    left = left.select(F.struct("center", "chunk").alias("cell"), F.lit(True).alias("left"), F.col("center").alias("id"), F.col("center").alias("root"))
    links = stored(compare(left.unionByName(right), texts, size, share), "minhash-links")
    roots = stored(stars(links), "minhash-roots")

    # buckets that still hold several components
    known = member.select("key", "id").join(roots.withColumnRenamed("node", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    known = stored(known, "minhash-known")
    split = known.groupBy("key", "root").agg(F.count("*").alias("n"))
    split = split.groupBy("key").agg(F.max(F.struct("n", -F.col("root"))).alias("top"), F.count("*").alias("roots")).filter("roots > 1")
    split = split.select("key", (-F.col("top.col2")).alias("host"), "roots")
    guest = stored(known.join(split, "key").filter("root <> host").select("key", "id", "root", "host", "roots"), "minhash-guests")

    # guests against the whole component, both in blocks
    def blocks(n: str) -> Column:
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))

    asked = guest.select("host", "id", "root").distinct()
    guests = asked.groupBy("host").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("guest_chunks"))
    inside = known.select(F.col("root").alias("host"), "id").distinct().join(guests, "host")
    per = inside.groupBy("host").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("chunks"), F.first("guest_chunks").alias("guest_chunks"))
    cell = F.struct("host", "a", "b").alias("cell")
    left = inside.join(per.select("host", "chunks"), "host").withColumn("a", chunk_of("chunks")).withColumn("b", blocks("guest_chunks"))
    left = left.select(cell, F.lit(True).alias("left"), "id", F.col("host").alias("root"))
    right = asked.join(per, "host").withColumn("b", chunk_of("guest_chunks")).withColumn("a", blocks("chunks"))
    right = right.select(cell, F.lit(False).alias("left"), "id", "root")
    # guests of one bucket against each other
    again = guest.filter("roots > 2")
    per = again.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("long").alias("chunks"))
    again = again.join(per, "key").withColumn("mine", chunk_of("chunks")).withColumn("other", blocks("chunks"))
    cell = F.struct(F.col("key").alias("host"), F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")).alias("cell")
    sides = F.when(F.col("mine") == F.col("other"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.col("mine") < F.col("other")))
    again = again.select(cell, F.explode(sides).alias("left"), "id", "root")
    more = compare(left.unionByName(right), texts, size, share).unionByName(compare(again, texts, size, share))
    more = stored(more, "minhash-more")
    if not more.isEmpty():
        roots = stored(stars(roots.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more)), "minhash-final")

    return (every.select("doc_id", "n_shingles", "mark").join(first, "mark", "left")
            .join(roots.withColumnRenamed("node", "id"), "id", "left")
            .select("doc_id", "n_shingles", F.coalesce("root", "id", "doc_id").alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False))))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents with one of each component, the one with its smallest id, and all their columns.

    Of rows that repeat an id one stays; rows without an id cannot be told apart and all stay.
    """
    kept = components(docs, id_col, text_col, **options).filter("kept").select(F.col("doc_id").alias("_kept_id")).distinct()
    named = docs.filter(docs[id_col].isNotNull())
    one = named.join(kept, named[id_col].cast("long") == kept["_kept_id"], "left_semi").dropDuplicates([id_col])
    return one.unionByName(docs.filter(docs[id_col].isNull()))
