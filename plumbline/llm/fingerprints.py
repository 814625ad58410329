"""Document fingerprints: a Merkle tree of leaves, paragraphs, sections and a root.

A text is sections (ended by blank lines), each of paragraphs (lines), each of leaves. Leaves are cut at content: after
white space that follows a character whose code is 1 modulo 4, after a line end, or after 128
characters, so an edit changes the leaves it touches and no others. Every character, line ends included, is in one leaf.
A paragraph is hashed over its leaves' characters, a section over its paragraphs' hashes, the root over its
sections' hashes: equal roots mean equal texts, and walking down unequal nodes locates the edit.

A fingerprint is text: ``root:section|section``, a section ``hash=paragraph;paragraph``, a paragraph ``hash,leaves`` with four
base64 characters a leaf. It is about a sixth of the text.
"""

from __future__ import annotations

import re
from base64 import urlsafe_b64encode
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b, sha256

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, functions as F

ENDS = "".join(re.escape(chr(c)) for c in range(33, 0x250) if c % 4 == 1)
LEAF = re.compile(rf"(?s).{{0,127}}?(?:[{ENDS}][ \t]|\n|\Z)|.{{128}}")
SECTION = re.compile(r"(?s).+?(?:\n(?:[ \t\r]*\n)+|\Z)")
PARAGRAPH = re.compile(r"[^\n]*\n|[^\n]+")
EMPTY = sha256(b"").hexdigest()[:32] + ":"


def digest(data: bytes, size: int) -> str:
    return urlsafe_b64encode(blake2b(data, digest_size=size).digest()).decode()


def fingerprint(text: str | None) -> str:
    """The tree of the whole text; null counts as empty, whose tree has no sections."""
    if not text:
        return EMPTY
    sections, tops = [], []
    for section in SECTION.findall(text):
        paragraphs, nodes = [], []
        for paragraph in PARAGRAPH.findall(section):
            data = paragraph.encode("utf-8", "surrogatepass")
            node = blake2b(data, digest_size=24).digest()
            leaves = "".join(digest(leaf.encode("utf-8", "surrogatepass"), 3) for leaf in LEAF.findall(paragraph) if leaf)
            nodes.append(node)
            paragraphs.append(f"{urlsafe_b64encode(node[:6]).decode()},{leaves}")
        top = blake2b(b"".join(nodes), digest_size=24).digest()
        tops.append(top)
        sections.append(f"{urlsafe_b64encode(top[:6]).decode()}=" + ";".join(paragraphs))
    root = sha256(b"".join(tops)).hexdigest()[:32]
    return f"{root}:" + "|".join(sections)


def leaves_of(mark: str) -> list[str]:
    out = []
    for section in filter(None, mark[33:].split("|")):
        for paragraph in section.partition("=")[2].split(";"):
            leaves = paragraph.partition(",")[2]
            out += [leaves[i:i + 4] for i in range(0, len(leaves), 4)]
    return out


def likeness(a: str, b: str) -> float:
    """1 for equal roots, else the Dice share of common leaves (counted with repeats), always below 1."""
    if a[:32] == b[:32]:
        return 1.0
    one, two = leaves_of(a), leaves_of(b)
    if not one or not two:
        return 0.0
    few = Counter(one)
    common = 0
    for leaf in two:
        if few.get(leaf, 0):
            few[leaf] -= 1
            common += 1
    return min(2 * common / (len(one) + len(two)), 1 - 1 / (1 + len(one) + len(two)))


def differing(a: str, b: str) -> list[tuple[int, int]]:
    """``(section, paragraph)`` positions of ``b`` whose branch is absent at that place in ``a``; unequal branches only are walked."""
    if a[:32] == b[:32]:
        return []
    one, two = (list(filter(None, m[33:].split("|"))) for m in (a, b))
    out = []
    for i, section in enumerate(two):
        old = one[i] if i < len(one) else ""
        if old.partition("=")[0] == section.partition("=")[0]:
            continue
        was, now = (x.partition("=")[2].split(";") for x in (old, section))
        out += [(i, j) for j, p in enumerate(now) if j >= len(was) or was[j].partition(",")[0] != p.partition(",")[0]]
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of every whole text; null texts count as empty. Repeated rows stay."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "n_chars": [len(t) for t in texts], "fingerprint": [fingerprint(t) for t in texts]})

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInPandas(run, f"doc_id {kind}, n_chars long, fingerprint string")


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows dealt by falling id into parts, each part followed by a copy of the row that comes next.

    Returns ``part, ghost, doc_id, text``, sorted within its partitions. Null ids come last; equal ids are
    ordered by text. Bounds are approximate quantiles of the ids, one part per shuffle partition;
    only the parts' first ids pass through the driver.
    """
    spark = docs.sparkSession
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = base.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (4 * n)) if n > 1 else []
    cuts = sorted(set(cuts), reverse=True)
    # falling ids: part 0 lies above the highest cut, nulls go to the last part
    if cuts:
        binned = Bucketizer(splits=[float("-inf"), *reversed(cuts), float("inf")], inputCol="place", outputCol="bin", handleInvalid="keep")
        base = binned.transform(base.withColumn("place", F.col("doc_id").cast("double")))
        part = F.when(F.col("doc_id").isNull(), len(cuts)).otherwise(F.lit(len(cuts)) - F.col("bin"))
    else:
        part = F.lit(0)
    base = base.select("doc_id", "text", part.cast("int").alias("part"))
    firsts = base.groupBy("part").agg(F.max("doc_id").alias("first_id")).orderBy("part").collect()
    parts = [r["part"] for r in firsts]
    before = [(parts[k - 1], r["first_id"], r["part"]) for k, r in enumerate(firsts)]
    ghosts = spark.createDataFrame(before, "to_part int, first_id long, part int")
    copied = (base.join(F.broadcast(ghosts), (base["part"] == ghosts["part"]) & base["doc_id"].eqNullSafe(ghosts["first_id"]))
              .select(F.col("to_part").alias("part"), F.lit(True).alias("ghost"), "doc_id", "text"))
    rows = base.select("part", F.lit(False).alias("ghost"), "doc_id", "text").unionByName(copied)
    return (rows.repartitionById(max(1, len(cuts) + 1), F.col("part"))
            .sortWithinPartitions("part", "ghost", F.col("doc_id").desc_nulls_last(), "text"))


def edited(text: str, following: str) -> str:
    """The last half (rounded down) replaced by as many leading characters of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare_with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses.

    Returns ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A single
    document is its own next. Each partition is read once in order and holds two rows at a time.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # part, id, text, fingerprint
        for rows in batches:
            out = []
            for part, ghost, doc_id, text in zip(rows["part"], rows["ghost"], rows["doc_id"], rows["text"]):
                if held is None and ghost:  # further copies of the first id
                    continue
                mark = fingerprint(text)
                if held is not None:
                    other = edited(held[2], text)
                    changed = fingerprint(other)
                    out.append((held[1], len(held[2]), sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), held[3], changed,
                                likeness(held[3], changed), likeness(held[3], mark)))
                held = None if ghost else (part, None if pd.isna(doc_id) else int(doc_id), text, mark)
            frame = pd.DataFrame(out, columns=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])
            frame["doc_id"] = frame["doc_id"].astype("Int64")
            yield frame

    return with_next(docs, id_col, text_col).mapInPandas(
        run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
