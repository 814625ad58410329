import collections
import hashlib
import itertools
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.llm import chat_format, divergence, filter_audit

CLASHING = "doc_id long, text string, lang string, source string, p long, q long, term string, no int, value double, mask int, part string, n long"


def documents(spark, rows):
    return spark.createDataFrame([(k, *r, 1, 2, "t", 3, 0.5, 7, "x", 9) for k, r in enumerate(rows)], CLASHING)


def brute_divergence(rows, least=3, top=200):
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [tuple(x or "" for x in r) for r in rows]  # text, lang, source
    out = []
    for lang in {r[1] for r in rows}:
        docs = [(s, [w.translate(lower) for w in term.findall(t)]) for t, la, s in rows if la == lang]
        df = collections.Counter(w for _, words in docs for w in set(words))
        kept = {w for w in df if df[w] >= least}
        count = collections.defaultdict(collections.Counter)
        for s, words in docs:
            count[s].update(w for w in words if w in kept)
        whole = sum(count.values(), collections.Counter())

        def value(c, w):
            return 1 + 10**9 * (c[w] + 1) // (sum(c.values()) + len(kept))

        for s in count:
            pairs = [(x, sum((value(count[s], w) - value(count[x], w)) ** 2 // value(count[x], w) for w in kept)) for x in count if x != s]
            terms = [(w, (value(count[s], w) - value(whole, w)) ** 2 // value(whole, w)) for w in kept
                     if count[s][w] and value(count[s], w) > value(whole, w)]
            for part, found, limit in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, v, k) for k, (item, v) in enumerate(found[:limit], 1)]
    return sorted(out)


TEXTS = [
    ("the cat and the dog", "en", "a"), ("The CAT sat; the-cat 12 sat", "en", "b"), ("cat cat cat éa ÉA éa", "en", "a"), ("éa sat on", "en", "c"),
    ("éa sat on", "en", "c"), ("", "en", "d"), (None, "en", "e"), ("12 34 _", None, "a"), ("und und", "de", None), ("und", "de", ""), ("und", "de", "x"),
    ("sat " * 3000 + "cat", "en", "b"), ("alone", "fr", "z"), (None, None, None),
]


def test_divergence_equals_brute_force(spark):
    got = divergence.divergence(documents(spark, TEXTS))
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(TEXTS)


@pytest.mark.parametrize("held, block", [(3, 2), (1, 1), (50, 7)])
def test_divergence_in_small_blocks(spark, held, block):
    rng = np.random.default_rng(5)
    rows = [(" ".join(rng.choice(["aa", "bb", "cc", "dd", "ee", "ff", "gg"], 9)), "en", f"s{k % 5}") for k in range(40)]
    got = divergence.divergence(documents(spark, rows), top=3, held_terms=held, block_postings=block)
    assert sorted(tuple(r) for r in got.collect()) == brute_divergence(rows, top=3)


def test_row_accumulation_alone_is_the_sparse_correction():
    import pyarrow as pa

    rows = [("l", b"t1", 1, 500, 10), ("l", b"t1", 2, 300, 20), ("l", b"t2", 1, 70, 10), ("m", b"t1", 1, 9, 1), ("m", b"t1", 3, 4, 2)]
    table = pa.table({"lang": [r[0] for r in rows], "term": pa.array([r[1] for r in rows], pa.binary()), "no": pa.array([r[2] for r in rows], pa.int32()),
                      "p": [r[3] for r in rows], "p0": [r[4] for r in rows]})
    got = sorted(tuple(x.values()) for b in divergence.accumulate_rows(iter(table.to_batches())) for x in b.to_pylist())
    f = lambda p, q: (p - q) ** 2 // q
    assert got == [("l", 1, 2, f(500, 300) - f(500, 20) - f(10, 300) + f(10, 20)), ("l", 2, 1, f(300, 500) - f(300, 10) - f(20, 500) + f(20, 10)),
                   ("m", 1, 3, f(9, 4) - f(9, 2) - f(1, 4) + f(1, 2)), ("m", 3, 1, f(4, 9) - f(4, 1) - f(2, 9) + f(2, 1))]


def test_large_counts_stay_exact(spark):
    big = spark.createDataFrame([(9_000_000_000_000, 9_500_000_000_000, 123_456)], "n long, total long, kept long")
    got = big.select(divergence.smoothed(F.col("n"), F.col("total"), F.col("kept"))).first()[0]
    assert got == 1 + 10**9 * 9_000_000_000_001 // (9_500_000_000_000 + 123_456)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(documents(spark, TEXTS).limit(0)).count() == 0
    one = divergence.divergence(documents(spark, [("a b", "en", "s"), ("c", "en", "t")])).collect()  # no kept term: V is 0
    assert sorted(tuple(r) for r in one) == [("en", "s", "pair", "t", 0, 1), ("en", "t", "pair", "s", 0, 1)]


# ---- chat

def turns_of(spark, rows):
    return spark.createDataFrame([(*r, "f", "g", 1) for r in rows], "conv_id long, turn long, role string, text string, formatted string, turns string, row int")


HARD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>", "[", "<", "</s", "s>", "[NEXT]", "[\\NEXT]", "", "\\", "a\nb\\", "[[/INST]]", "<<s>", "é😀[INST]", "<s></s>", "[INST", "/INST]"]


def test_chat_round_trip_of_control_strings(spark):
    rows = [(k, 0, "user", t) for k, t in enumerate(HARD)] + [(k, 1, "assistant", t) for k, t in enumerate(HARD[::-1])]
    rows += [(100 + k, j, ["user", "tool[/INST]", "assistant", "assistant", None][(j + k) % 5], HARD[(j * 7 + k) % len(HARD)]) for k in range(12) for j in range(9)]
    out = chat_format.format_conversations(turns_of(spark, rows))
    read = out.select("conv_id", "formatted", chat_format.read_turns(F.col("formatted")).alias("turns"),
                      chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()
    for r in read:
        want = [(x[2] or "", x[3]) for x in sorted(x for x in rows if x[0] == r["conv_id"]) if True] if r["conv_id"] < 100 else \
            [(x[2] or "", x[3]) for x in rows if x[0] == r["conv_id"]]
        assert [tuple(t) for t in r["turns"]] == want
        assert r["loss"] == "".join(t for role, t in want if role == "assistant")
        opened = sum(1 for k, (role, _) in enumerate(want) if not k or want[k - 1][0] != role)
        assert r["formatted"].count("[INST]") == r["formatted"].count("</s>") == opened and r["formatted"].count("<s>") == 1


def test_adjacent_turns_of_a_role_become_one_run(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", None), (1, 4, "user", "d")]
    got = chat_format.format_conversations(turns_of(spark, rows)).collect()[0]
    assert got["formatted"] == "<s>[INST]user[/INST]a[NEXT]b</s>[INST]assistant[/INST]c[NEXT]</s>[INST]user[/INST]d</s>"
    spans = [got["formatted"][s["start"]:s["start"] + s["length"]] for s in got["loss_spans"]]
    assert spans == ["c", ""]


def test_chat_digests_and_edges(spark):
    rows = [(1, 1, "assistant", "y"), (1, 0, "user", "x"), (2, 0, "user", None), (2, 0, "user", None), (None, None, None, "z"), (None, 3, "assistant", "<s>")]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_conversations(turns_of(spark, rows))).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert set(got) == {1, 2, None}
    assert (got[1]["n_turns"], got[1]["turns_sha256"], got[1]["loss_sha256"], got[1]["loss_chars"]) == (2, sha("user\nx\nassistant\ny\n"), sha("y"), 1)
    assert (got[2]["n_turns"], got[2]["turns_sha256"], got[2]["loss_sha256"], got[2]["loss_chars"]) == (2, sha("user\n\nuser\n\n"), sha(""), 0)
    assert (got[None]["turns_sha256"], got[None]["loss_sha256"]) == (sha("\nz\nassistant\n<s>\n"), sha("<s>"))
    assert chat_format.read_back(chat_format.format_conversations(turns_of(spark, rows).limit(0))).count() == 0


def test_a_conversation_of_many_turns(spark):
    rows = [(5, k, ["user", "assistant"][k // 3 % 2], f"text {k}") for k in range(3000)]
    got = chat_format.read_back(chat_format.format_conversations(turns_of(spark, rows))).first()
    assert got["n_turns"] == 3000
    assert got["loss_sha256"] == hashlib.sha256("".join(t for _, _, role, t in rows if role == "assistant").encode()).hexdigest()


def test_chat_uses_spark_expressions_only(spark):
    plan = chat_format.read_back(chat_format.format_conversations(turns_of(spark, [(1, 0, "user", "a")])))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# ---- filters

def brute_audit(rows, labels):
    """rows (doc_id, text, source) -> (part, order, step) and the seven counts."""
    word = re.compile(r"[^\x20\x09-\x0D]+")
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    marks = []
    for d, text, source in rows:
        t = text or ""
        words = word.findall(t)
        own = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
               "D": bool(re.search(r"[#$%&*|]", t)), "E": d is not None and any(x[0] is not None and x[0] < d and (x[1] or "") == t for x in rows)}
        marks.append((d, source or "", {f for f in own if own[f]}))
    out = {}
    for part in {m[1] for m in marks}:
        mine = [m for m in marks if m[1] == part]
        shapley = collections.Counter()
        steps = []
        for order in itertools.permutations("ABCDE"):
            gone = set()
            for k, f in enumerate(order):
                here = [i for i, m in enumerate(mine) if f in m[2] and i not in gone]
                redundant = sum(1 for i, m in enumerate(mine) if f in m[2] and i in gone)
                gone |= set(here)
                shapley[f] += len(here)
                steps.append((part, "".join(order), k + 1, f, len(mine) - len(gone), len(here), redundant, sum(m[2] == {f} for m in mine),
                              sum(mine[i][0] in good for i in here), sum(mine[i][0] in toxic for i in here)))
        out |= {s[:3]: (*s[4:], shapley[s[3]]) for s in steps}
    return out


def test_filter_audit_equals_brute_force(spark):
    long = " ".join(f"w{k}" for k in range(250))
    rows = [(5, long, "a"), (3, long, "b"), (9, long, "a"), (9, long, "a"), (4, "same " * 250, "a"), (2, "SHOUT " * 220, None), (1, "SHOUT " * 220, ""), (7, None, "a"),
            (8, "", "b"), (6, long + " #tag", "c"), (10, long.upper(), "c"), (None, long, "c"), (None, long, "c"), (11, "é " * 300 + "A" * 6, "c"), (12, "A b\x0bc", "d")]
    labels = [(5, 1, 0), (9, 1, 1), (9, 0, 0), (4, None, 1), (8, 0, None), (99, 1, 1), (None, 1, 1)]
    docs = spark.createDataFrame([(*r, 1, "m", 2, None) for r in rows], "doc_id long, text string, source string, mask int, part string, n int, digest binary")
    got = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got.collect()} == brute_audit(rows, labels)
    assert filter_audit.audit(docs.limit(0), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).count() == 0


def test_gray_walk_visits_every_set():
    rng = np.random.default_rng(2)
    table = rng.integers(0, 50, (32, 4, 3))
    states = filter_audit.gray_states(table)
    for chosen in range(32):
        assert (states[chosen] == table[[m for m in range(32) if not m & chosen]].sum(axis=0)).all()
