import collections

import corpus_pipeline as pipeline
from plumbline.llm import minhash, mixing
from plumbline.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def test_stages_and_their_decisions(spark):
    assert [name for name, _ in pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mixing", "tokens"]
    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        rows = docs.collect()
        if name != "tokens":
            assert docs.columns == list(pipeline.COLUMNS)
        if name == "near_duplicates":
            left = [minhash.shingle_set(r["text"], 5) for r in rows]
            assert not any(minhash.linked(a, b, 80) for i, a in enumerate(left) for b in left[i + 1:] if a and b)
            for r in before:  # what went has a kept relative, or a chain of gone ones leads to it
                assert r["doc_id"] in {x["doc_id"] for x in rows} or any(minhash.linked(minhash.shingle_set(r["text"], 5), minhash.shingle_set(x["text"], 5), 80) for x in before if x["doc_id"] != r["doc_id"])
        if name == "mixing":
            size = collections.Counter()
            for r in before:
                size[r["source"]] += len((r["text"] or "").split())
            taken = collections.Counter()
            for r in rows:
                taken[r["source"]] += len(r["text"].split())
            longest = max(len((r["text"] or "").split()) for r in before)
            assert sum(taken.values()) <= sum(size.values()) + len(size) * longest and all(taken[s] <= 3 * size[s] for s in size)
            assert {(r["doc_id"], r["text"]) for r in rows} <= {(r["doc_id"], r["text"]) for r in before}
        if name == "tokens":
            assert len(rows) == len(before)
        before = rows


def test_pages_and_tokens_queries(spark):
    assert QUERIES["op1_html_extraction"](spark, SF).filter("n_chars = 0").count() == 0
    assert QUERIES["op2_piece_tokens"](spark, SF).filter("not round_trip").count() == 0


def test_words_agree():
    assert len("a\u00a0b\x0bc  d".encode().split()) == 3 and mixing.WORD == r"[^\x20\x09-\x0D]+"
