"""Rings of bounded length are judged inside their row; longer ones, as rows of edges, get the same verdicts."""

import numpy as np
from pyspark.sql import functions as F

from plumbline.functions import rings as R
from plumbline.operators import checks as C


def some_rings():
    rng, out = np.random.default_rng(7), []
    for k in range(120):
        n = int(rng.integers(3, 60))
        turn = np.sort(rng.uniform(0, 2 * np.pi, n))
        flat = [rng.integers(0, 7, (n, 2)).astype(float), np.stack([np.cos(turn), np.sin(turn)], 1) * rng.uniform(3, 5, (n, 1)), rng.uniform(-5, 5, (n, 2))][k % 3]
        ring = np.column_stack([flat, 0.5 * flat[:, 0] + (k % 11 == 0) * rng.uniform(0, 1, n)]).tolist()
        if k % 13 == 0:
            ring[1][2] = None if k % 2 else float("nan")
        if k % 17 == 0:
            ring = [[float(i), 2.0 * i, 1.0] for i in range(n)]
        out.append((k, ring))
    return out + [(900, None), (901, []), (902, [[0.0, 0.0, 0.0], None, [1.0, 0.0, 0.0], [1.0, 1.0, 0.0]]), (903, [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0]])]


def test_rings_inside_a_row_and_as_rows_of_edges_agree(spark):
    rings = spark.createDataFrame(some_rings(), "polygon_id int, vertices array<array<double>>").repartition(4)
    verdicts = [sorted(tuple(r) for r in C.check_polygon_ring(rings, short=short).collect()) for short in (4, C.SHORT_RING)]
    assert verdicts[0] == verdicts[1] and len({v[0] for v in verdicts[0]}) == 4


def test_a_sweep_finds_what_every_pair_of_edges_shows(monkeypatch):
    rings = [np.array(r)[:, :2] for k, r in some_rings() if k < 900 and k % 13]
    points, size = np.concatenate(rings), np.array([len(r) for r in rings])
    want = []
    for ring in rings:
        i, j = np.triu_indices(len(ring), 2)
        i, j = i[(j - i) != len(ring) - 1], j[(j - i) != len(ring) - 1]
        after = np.roll(ring, -1, 0)
        want.append(bool(R.segments_touch(ring[i], after[i], ring[j], after[j], 1e-9).any()))
    for held in (40, 1 << 20):
        monkeypatch.setattr(R, "MET_AT_ONCE", held)
        assert R.crossed_rings(points, np.repeat(np.arange(len(size)), size), size, 1e-9).tolist() == want


def test_edges_of_rings_of_a_hundred_corners_are_not_rows(spark):
    at = lambda i: F.array(F.cos(i * 0.0628), F.sin(i * 0.0628), F.lit(0.0))
    rings = spark.range(5).select(F.col("id").alias("polygon_id"), F.transform(F.sequence(F.lit(0), F.lit(99)), at).alias("vertices"))
    found = C.check_polygon_ring(rings)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert found.isEmpty() and "Join" not in plan and "Exchange" not in plan
