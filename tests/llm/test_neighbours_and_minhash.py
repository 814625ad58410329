import collections
import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.llm import cross_polytope as cp, minhash as mh


def exact(rows, queries, k=5):
    ids, data = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], dtype=float)
    norm = np.sqrt((data * data).sum(axis=1))
    out = {}
    for q in queries:
        at = int(np.flatnonzero(ids == q)[0])
        score = (data * data[at]).sum(axis=1) / (norm * norm[at])
        out[q] = [int(ids[j]) for j in np.lexsort((ids, -score)) if ids[j] != q][:k]
    return out


def test_recall_against_brute_force(spark):
    random.seed(2)
    rng = np.random.default_rng(2)
    near = rng.normal(size=48)
    rows = [(k, (rng.normal(size=48) if k % 3 else near + 0.05 * rng.normal(size=48)).astype(np.float32).tolist()) for k in range(1500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = collections.defaultdict(list)
    for r in cp.nearest(frame, F.col("vec_id") % 50 == 0, cell_rows=100, cell_queries=5).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = exact(rows, [k for k in range(0, 1500, 50)])
    assert set(got) == set(want) and all(len(x) == 5 for x in got.values())
    assert sum(len(set(got[q]) & set(want[q])) for q in want) / (5 * len(want)) >= 0.95


def test_vectors_that_take_no_part_and_ties(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(0, v), (1, v), (2, [2.0, 4.0, 6.0]), (3, v), (3, v), (4, None), (5, [0.0, 0.0, 0.0]), (6, [1.0, None, 1.0]), (7, [1.0, float("nan"), 1.0]), (8, [float("inf"), 1.0, 1.0]), (None, v), (9, [1.0, 2.0]),
            (10, []), (11, [-1.0, -2.0, -3.0]), (50, [1.0, 0.0, 0.0])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rank int")
    got = [(r["query_id"], r["rank"], r["vec_id"]) for r in cp.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 3), (0, 4, 50), (0, 5, 11), (50, 1, 0), (50, 2, 1), (50, 3, 2), (50, 4, 3), (50, 5, 11)]
    assert cp.nearest(frame.limit(0), F.lit(True)).count() == 0
    same = cp.nearest(spark.createDataFrame([(k, v) for k in range(9, -1, -1)], "vec_id long, embedding array<float>"), F.col("vec_id") == 0)
    assert [r["vec_id"] for r in same.orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_repeats_take_no_places(spark):
    rng = np.random.default_rng(4)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(60)]
    query = np.array(rows[0][1])
    near = [(100 + k, (query + 0.01 * (k + 1) * rng.normal(size=8)).tolist()) for k in range(3)]
    several = [(200, (query + 0.001 * rng.normal(size=8)).tolist()) for _ in range(40)]  # one id, many vectors
    frame = spark.createDataFrame(rows + near * 12 + several, "vec_id long, embedding array<double>")
    for cells in (4096, 7):
        got = [(r["vec_id"], r["score"]) for r in cp.nearest(frame, F.col("vec_id") == 0, probes=16, cell_rows=cells).orderBy("rank").collect()]
        best = {}
        for k, v in rows[1:] + near + several:
            best[k] = max(best.get(k, -2), float(np.dot(v, query) / np.linalg.norm(v) / np.linalg.norm(query)))
        want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:5]
        assert [k for k, _ in got] == [k for k, _ in want] and np.allclose([x for _, x in got], [x for _, x in want])


def test_vectors_of_one_id_are_spread():
    data = np.random.default_rng(1).normal(size=(700, 4)).astype(np.float32).astype(float)
    counts = np.bincount(cp.places(np.full(700, 5), data) % 7, minlength=7)
    assert counts.min() > 50 and counts.max() < 160


def test_rotation_keeps_lengths():
    x = np.random.default_rng(0).normal(size=(5, 48))
    y = cp.rotated(x, 3, 1)
    assert y.shape == (5, 64) and np.allclose((x * x).sum(1), (y * y).sum(1))


def brute(rows, size):
    sets = collections.defaultdict(list)
    for name, text in rows:
        sets[name].append(mh.shingle_set(text, size))
    ids = sorted(sets)
    root = {k: k for k in ids}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            if any(x and y and mh.linked(x, y, 80) for x in sets[a] for y in sets[b]):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {k: top(k) for k in ids}


def corpus():
    random.seed(5)
    words = [f"w{k}" for k in range(400)]
    rows, base = [], [random.choices(words, k=60) for _ in range(4)]
    for k in range(500):
        text = list(base[k % 4])
        for _ in range(random.choice([0, 0, 1, 2, 3, 4, 6, 9])):
            text[random.randrange(60)] = random.choice(words)
        rows.append((k, " ".join(text)))
    rows += [(600 + k, " ".join(random.choices(words, k=random.randint(1, 30)))) for k in range(100)]
    return rows + [(800, None), (801, ""), (802, " \t"), (803, "One"), (804, "one"), (805, "two"), (806, "A b"), (807, "a\x0bB"), (808, "a\u00a0b")]


def test_components_by_brute_force(spark, docs, monkeypatch):
    monkeypatch.setattr(mh, "BLOCK", 40)  # several blocks a group
    rows = corpus()
    got = {r["doc_id"]: r for r in mh.components(docs(rows).repartition(5), size=2).collect()}
    want = brute(rows, 2)
    assert {k: r["component_id"] for k, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == k) and r["n_shingles"] == len(mh.shingle_set(dict(rows)[k], 2)) for k, r in got.items())
    assert got[806]["component_id"] == got[807]["component_id"] == 806 and got[804]["component_id"] == 803 and got[801]["component_id"] == 801


def test_repeats_nulls_and_empty(spark, docs):
    rows = [(2, "a b c d e f"), (2, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (3, None), (None, None)]
    got = [(r["doc_id"], r["component_id"], r["kept"]) for r in mh.components(docs(rows)).collect()]
    assert sorted(got, key=str) == sorted([(2, 1, False), (2, 1, False), (1, 1, True), (None, 1, False), (3, 3, True), (None, None, False)], key=str)
    assert mh.components(docs([])).count() == 0
    kept = mh.deduplicated(docs(rows))
    assert kept.columns == docs(rows).columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 0, 1, 3]


def test_stars_on_paths_and_hubs(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(k, 500) for k in range(501, 560)] + [(7, 7)]
    random.seed(0)
    random.shuffle(edges)
    got = {r["node"]: r["root"] for r in mh.stars(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {k: 100 for k in range(100, 161)} | {k: 500 for k in range(500, 560)}


def test_minima_estimate_similarity():
    a, b = mh.coefficients(4000, 1)
    one, two = list(mh.shingle_hashes([" ".join(map(str, range(200))), " ".join(map(str, range(20, 200)))], 2))
    share = (mh.minima(one, a, b) == mh.minima(two, a, b)).mean()
    assert abs(share - len(np.intersect1d(one, two)) / len(np.union1d(one, two))) < 0.03
