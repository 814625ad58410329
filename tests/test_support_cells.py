"""Cells of a support search follow the polygons, not the extent of the points."""

import numpy as np

from plumbline.operators import surfaces as S


def test_points_far_away_do_not_widen_the_cells(spark, monkeypatch):
    met, supports = [], S._supports
    monkeypatch.setattr(S, "_supports", lambda located, prisms, keys, *rest: met.append(located.join(prisms, list(keys)).count()) or supports(located, prisms, keys, *rest))
    rng = np.random.default_rng(3)
    # level and sloping squares of a 40 m floor, points around them, and a few points kilometres away
    tiles = [(7 * (i % 6), 7 * (i // 6), float(rng.uniform(0, 2)), float(rng.choice([0.0, 0.0, 0.4])), 2 * i) for i in range(36)]
    rings = [("g", k, [[x + dx, y + dy, z + slope * dx] for dx, dy in ((0.0, 0.0), (3.0, 0.0), (3.0, 3.0), (0.0, 3.0))]) for x, y, z, slope, k in tiles]
    near = [(i, *map(float, p)) for i, p in enumerate(rng.uniform([-1, -1, -3], [42, 42, 5], (600, 3)))]
    away = [(1000 + i, *map(float, p)) for i, p in enumerate([(9e3, 1.0, 1.0), (1.0, -9e3, 1.0), (1.0, 1.0, 40.0), (float("nan"), 1.0, 1.0)])] + [(2000, None, 1.0, 1.0)]
    points = spark.createDataFrame([("g", *p) for p in near + away], "g string, id int, x double, y double, z double")
    polygons = spark.createDataFrame(rings, "g string, polygon_ordinal int, vertices array<array<double>>")
    got = {r.id: (r.supporting_polygon, r.residual_m) for r in S.nearest_support_polygon(points, polygons, ["g"], ["id"]).collect()}
    want = {}
    for i, *p in near + away[:3]:
        found = []
        for x, y, z, slope, k in tiles:
            normal = np.array([-slope, 0.0, 1.0]) / np.hypot(slope, 1.0)
            residual = float((np.array(p) - [x, y, z]) @ normal)
            foot = np.array(p) - residual * normal
            if x <= foot[0] <= x + 3 and y <= foot[1] <= y + 3:
                found.append((abs(residual), k, residual))
        want[i] = min(found)[1:] if found else (None, None)
    assert set(got) == set(want) | {1003, 2000} and got[1003] == got[2000] == (None, None)
    for i, (polygon, residual) in want.items():
        assert got[i][0] == polygon and (polygon is None or abs(got[i][1] - residual) < 1e-9)
    assert max(met) < 5_000  # every point with every polygon: 21,780; prisms of sloping squares are kilometres long
