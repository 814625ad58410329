"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of a whole text: densities of a lexicon, nearness of its words to second-person words, capitals, punctuation and
obfuscation. The lexicon is a short general word list and what one part of the labelled texts teaches: words and word
beginnings that mark label 1 far above chance. The trees learn from a second part and the calibration from a third, so that no part
judges itself. Labels, ids, languages and sources are no features.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.common import share_of, slices, stored, with_features

# fixed values: general word lists
INSULTS = frozenset("""idiot idiots moron morons stupid dumb loser losers scum trash garbage pathetic worthless disgusting clown fool fools
    vermin filth scumbag imbecile cretin dimwit jerk bastard retard ugly subhuman idiota imbécile imbecil estúpido stupide dumm dummkopf
    arschloch connard basura basta tonto inútil""".split())
SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine ihr euch sie ihnen tu te toi ton ta vous votre usted ustedes ti tus vosotros".split())
LEET = str.maketrans("013457@$!|", "oieastasil")
EDGES = "!?.,;:*#|()[]\"'"  # marks around a word that spell no letter of it

WORD = re.compile(r"[^\W\d_]+")
TOKEN = re.compile(r"\S+")
MIXED = re.compile(r"[^\W\d_][0-9@$!|*#]+[^\W\d_]")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")
STEMS = (4, 5, 6, 7)
NEAR = 5
FEATURES = ("hit_density", "hit_log", "distinct_log", "odds_top", "odds_density", "listed_density", "near_second_person", "second_person_density",
            "capitals", "punctuation", "exclamations", "obfuscated", "stretched", "words_log")


def grams(words: Iterable[str]) -> set[str]:
    """Distinct words and beginnings (``stem*``) of longer words."""
    out = set(words)
    return out | {w[:k] + "*" for w in out for k in STEMS if len(w) > k}


def learned(labelled: DataFrame, least: int = 3, odds: float = 3.0, terms: int = 2000) -> dict[str, float]:
    """Log odds of the words and beginnings that at least ``least`` positive texts hold.

    ``labelled`` has ``text, label`` and is a bounded sample; the strongest ``terms`` of them come to the driver.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, batch.column(0)):
                one, all_ = Counter(), Counter()
                for text, label in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    g = grams(WORD.findall((text or "").lower()))
                    all_.update(g)
                    if label:
                        one.update(g)
                # what no positive text here holds matters only if one elsewhere does; both counts are summed below
                yield pa.RecordBatch.from_pydict({"term": list(all_), "one": [one[t] for t in all_], "n": list(all_.values())},
                                                 pa.schema([("term", pa.string()), ("one", pa.int64()), ("n", pa.int64())]))

    sizes = labelled.agg(F.sum("label"), F.count("*")).first()
    ones, rows = float(sizes[0] or 0), float(sizes[1] or 0)
    counts = labelled.select("text", "label").mapInArrow(run, "term string, one long, n long").groupBy("term").agg(F.sum("one").alias("one"), F.sum("n").alias("n"))
    value = F.log((F.col("one") + 0.5) / (ones + 1.0)) - F.log((F.col("n") - F.col("one") + 0.5) / (rows - ones + 1.0))
    best = counts.filter(F.col("one") >= least).withColumn("odds", value).filter(F.col("odds") >= odds).orderBy(F.desc("odds"), "term").limit(terms).collect()
    return {r["term"]: r["odds"] for r in best}


def features(text: str, odds: dict[str, float]) -> list[float]:
    """One row of FEATURES; an empty text is all zeros."""
    words = WORD.findall(text)
    if not words:
        marks = sum(text.count(c) for c in "!?.,;:")
        n = max(1, len(text))
        return [0.0] * 9 + [marks / n, text.count("!") / n, 0.0, 0.0, 0.0]
    n, chars = len(words), len(text)
    lower = text.lower()
    tokens = WORD.findall(lower)
    mixed = MIXED.findall(text)
    if mixed:
        tokens += [w for t in TOKEN.findall(lower) if MIXED.search(t) for w in WORD.findall(t.strip(EDGES).translate(LEET))]
    weight: dict[str, float] = {}
    for w in set(tokens):
        v = max([odds.get(w, 0.0), *(odds.get(w[:k] + "*", 0.0) for k in STEMS if len(w) > k)])
        if w in INSULTS:
            v = max(v, 5.0)
        if v > 0:
            weight[w] = v
    hits = [k for k, w in enumerate(tokens) if w in weight] if weight else []
    second = [k for k, w in enumerate(tokens) if w in SECOND_PERSON]
    near, at = 0, 0
    for k in hits:
        while at < len(second) and second[at] < k - NEAR:
            at += 1
        near += at < len(second) and second[at] <= k + NEAR
    upper = sum(len(w) > 1 and w.isupper() for w in words)
    points = sum(text.count(c) for c in "!?.,;:")
    return [1000 * len(hits) / n, math.log1p(len(hits)), math.log1p(len(weight)), max(weight.values(), default=0.0), sum(weight[tokens[k]] for k in hits) / n,
            1000 * sum(tokens[k] in INSULTS for k in hits) / n, near / len(hits) if hits else 0.0, 1000 * len(second) / n, upper / n, points / chars, text.count("!") / chars,
            1000 * len(mixed) / n, 1000 * sum(1 for _ in STRETCHED.finditer(text)) / n, math.log1p(n)]


def scored(docs: DataFrame, labels: DataFrame, learnable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
           max_labelled: int = 12_000, trees: int = 20, depth: int = 3, seed: int = 5) -> DataFrame:
    """``row`` (the input row as a struct) and ``score`` of every document: the chance of label 1.

    Labels are learned from rows where ``learnable`` (an expression over ``doc_id``) holds, from at most ``max_labelled`` of them by a hash of the
    id. The words for one half of the learned texts' features come from the other half, those for calibration and scoring from both. Ids labelled
    twice count as 1 if any label does; null labels and ids do not count. With labels of one kind only, the score is its share; without labels 0.
    Null and empty texts are scored as empty. Repeated rows are scored each.
    """
    known = (labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label is not null").filter(learnable)
             .groupBy("doc_id").agg((F.max("label") > 0).cast("double").alias("label"))
             .join(docs.select(F.col(id_col).alias("doc_id")).distinct(), "doc_id", "left_semi")
             .withColumn("share", share_of(F.col("doc_id"), f"sample{seed}")).orderBy("share", "doc_id").limit(max_labelled))
    known = known.withColumn("part", share_of(F.col("doc_id"), f"part{seed}")).drop("share")
    known = stored(known.withColumn("part", F.when(F.col("part") < 0.4, "one").when(F.col("part") < 0.8, "two").otherwise("held")), "toxic-labels")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = stored(base.join(F.broadcast(known), "doc_id"), "toxic-texts")  # at most max_labelled ids
    count = {(r["part"], r["label"]): r["n"] for r in texts.groupBy("part", "label").agg(F.count("*").alias("n")).collect()}
    if len({label for _, label in count}) < 2:
        share = sum(n * label for (_, label), n in count.items()) / max(1, sum(count.values()))
        return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.lit(float(share)).alias("score"))
    one, two, odds = (learned(texts.filter(where)) for where in ("part = 'one'", "part = 'two'", "part <> 'held'"))

    def vectors(rows: DataFrame, text: str, terms: dict[str, float]) -> DataFrame:
        return with_features(rows, text, ("x",), lambda t, _: (features(t, terms),)).withColumn("features", array_to_vector("x")).drop("x")

    train = vectors(texts.filter("part = 'one'"), "text", two).unionByName(vectors(texts.filter("part = 'two'"), "text", one))
    if len({label for part, label in count if part != "held"}) < 2:  # too few labels to keep some back
        train = vectors(texts, "text", odds)
    train = stored(train.select("row.label", "features"), "toxic-features")
    model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, minInstancesPerNode=3).fit(train)

    def rated(rows: DataFrame) -> DataFrame:
        return model.transform(rows).withColumn("p", vector_to_array("probability")[1])

    out = rated(vectors(docs, text_col, odds)).select("row", "p")
    value = F.col("p")
    if count.get(("held", 0.0)) and count.get(("held", 1.0)):
        held = rated(vectors(texts.filter("part = 'held'"), "text", odds)).select("row.label", "p")
        out = IsotonicRegression(featuresCol="p", labelCol="label", predictionCol="level").fit(held).transform(out)
        value = F.col("level") * 0.98 + F.col("p") * 0.02  # a trace of the trees' own probability keeps the order inside a level
    return out.select("row", F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)).alias("score"))


def clean_documents(docs: DataFrame, labels: DataFrame, learnable: Column, **options) -> DataFrame:
    """The documents with a score below 0.5, with all their columns."""
    return scored(docs, labels, learnable, **options).filter("score < 0.5").select("row.*")
