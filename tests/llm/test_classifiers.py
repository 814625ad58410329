import random

import pytest
from pyspark.sql import functions as F

from plumbline.llm import cotraining as co, toxicity as tox

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def test_toxicity_held_out(spark, tables):
    documents, labels = tables
    fold = F.pmod(F.xxhash64("doc_id"), F.lit(3))
    got = tox.scored(documents, labels, fold != 0).select("row.doc_id", "score").join(labels, "doc_id").filter(fold == 0).collect()
    assert len(got) > 100 and all(0 <= r["score"] <= 1 for r in got)
    right = sum((r["score"] >= 0.5) == bool(r["toxic"]) for r in got)
    assert right / len(got) >= 0.93
    assert sum(r["score"] >= 0.5 and not r["toxic"] for r in got) <= 0.03 * len(got)


def test_toxicity_edges(spark, tables, docs):
    _, labels = tables
    rows = docs([(1, None), (2, ""), (3, "fine words here"), (3, "fine words here"), (None, "you stupid idiot")])
    none = spark.createDataFrame([(1, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = tox.scored(rows, none, F.lit(True))
    assert [r["score"] for r in got.collect()] == [0.0] * 5 and got.select("row.*").columns == rows.columns
    few = spark.createDataFrame([(1, 0), (2, 0), (3, 1)], "doc_id long, toxic int")
    assert all(0 <= r["score"] <= 1 for r in tox.scored(rows, few, F.lit(True)).collect())
    assert tox.scored(docs([]), labels, F.lit(True)).count() == 0


def test_toxic_features():
    x = dict(zip(tox.FEATURES, tox.features("YOU are an id1ot!!! stuuuupid you", {})))
    assert x["distinct_log"] > 0 and x["near_second_person"] == 1 and x["obfuscated"] > 0 and x["stretched"] > 0 and x["capitals"] > 0
    assert tox.features("", {}) == [0.0] * len(tox.FEATURES) and len(tox.features("!!", {})) == len(tox.FEATURES)
    assert tox.features("réeuxpa x", {"réeux*": 4.0})[3] == 4.0


def test_quality_held_out(spark, tables):
    documents, labels = tables
    learn = labels.filter("doc_id % 3 <> 0")
    got = co.scored(documents, learn).select("row.doc_id", "score").join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    assert sum((r["score"] >= 0.5) == bool(r["quality"]) for r in got) / len(got) >= 0.97


def test_views_teach_each_other(spark):
    """Few labels, many unlabelled documents: the view that sees nothing at first learns from the other."""
    random.seed(8)
    rows = []
    for k in range(900):
        good = k % 2
        text = " ".join(random.choices("plain words that people write in order".split(), k=40)) if good else " ".join(w + "***" for w in random.choices("noise junk".split(), k=40))
        rows.append((k, text, "en", "good.example" if good else "bad.example", len(text)))
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id long, quality int")
    got = co.scored(frame, labels).select("row.doc_id", "meta_score", "score").collect()
    assert all((r["score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got)
    assert sum((r["meta_score"] >= 0.5) == bool(r["doc_id"] % 2) for r in got) >= 0.95 * len(got)


def test_every_source_hands_over_pseudo_labels(spark):
    """A small source beside a hot one, all of one confidence, is drawn from; another draw takes other documents."""
    rows = [(k, 0, 0 if k % 500 else 1, [1.0], [1.0], "text_view", 1.0) for k in range(20_000)]
    sure = spark.createDataFrame(rows, "doc_id long, lang int, source int, text_view array<double>, meta_view array<double>, view string, label double").repartition(4)
    one, two = ([(r["doc_id"], r["source"]) for r in co.drawn(sure, 400, 20, salt).collect()] for salt in ("turn 0", "turn 1"))
    assert all(10 <= sum(s for _, s in x) <= 40 and 300 <= len(x) <= 520 for x in (one, two))
    assert len({k for k, _ in one} & {k for k, _ in two}) < 100


def test_the_pool_is_every_unlabelled_document(spark, docs, monkeypatch):
    seen = []
    confident = co.confident
    monkeypatch.setattr(co, "confident", lambda pool, *rest: (seen.append(pool.count()), confident(pool, *rest))[1])
    words = "plain words that people write in order".split()
    rows = docs([(k, " ".join(words[(k + j) % 7] + ("" if k % 2 else "***") for j in range(5)), f"s{k % 3}") for k in range(14_000)])
    co.scored(rows, spark.createDataFrame([(k, k % 2) for k in range(100)], "doc_id long, quality int"), keep=("doc_id",))
    assert seen == [13_900] * 3


def test_quality_edges(spark, docs):
    rows = docs([(1, None), (2, ""), (3, "fine words"), (3, "fine words"), (None, "x")]).withColumn("source", F.lit(None).cast("string"))
    none = spark.createDataFrame([(1, None), (None, 1)], "doc_id long, quality int")
    assert {r["score"] for r in co.scored(rows, none).collect()} == {0.5}
    assert co.good_documents(rows, none).count() == 5 and co.good_documents(rows, none).columns == rows.columns
    assert co.scored(docs([]), none).count() == 0


def test_good_documents_are_those_that_score(spark):
    rows = [(k, None if k % 17 == 0 else "" if k % 13 == 0 else f"word{k} and more words, {k}. " * (k % 9 + 1), None if k % 11 == 0 else "en", "s" if k % 3 else None, 7, 8, "x") for k in range(120)]
    rows += rows[:20] + [(None, "a text without an id", "en", "s", 7, 8, "x"), (5, "another text of id 5", "en", "s", 7, 8, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, one long, two long, row string")
    labels = spark.createDataFrame([(k, int(k % 9 > 3)) for k in range(0, 120, 2)], "doc_id long, quality int")
    got = co.good_documents(docs, labels)
    assert got.columns == docs.columns
    scores = co.scored(docs, labels)
    want = scores.filter("score >= 0.5").select("row.*")
    assert 0 < want.count() < len(rows)
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
    assert co.good_documents(docs.limit(0), labels).count() == 0
