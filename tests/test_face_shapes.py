"""Coplanar faces that are exact copies are searched and clipped once, and every pair of faces is still returned."""

import numpy as np
import pytest

from plumbline.operators import mesh as M


def tables(spark, faces):
    """``faces``: object to a list of triangles, each three corners of three numbers."""
    vertices = [(k, 3 * t + i, *map(float, p)) for k, face in faces.items() for t, corners in enumerate(face) for i, p in enumerate(corners)]
    triangles = [(k, 0, t, [3 * t, 3 * t + 1, 3 * t + 2]) for k, face in faces.items() for t in range(len(face))]
    return (spark.createDataFrame(triangles, "object_id int, face int, triangle int, vertices array<int>"),
            spark.createDataFrame(vertices, "object_id int, vertex int, x double, y double, z double"))


def test_copies_are_one_shape(spark, monkeypatch):
    sizes, spread = [], M.spread_out
    monkeypatch.setattr(M, "spread_out", lambda df: sizes.append(df.count()) or spread(df))
    square = [[(0, 0, 1), (2, 0, 1), (2, 2, 1)], [(0, 0, 1), (2, 2, 1), (0, 2, 1)]]
    areas = M.coplanar_overlap_area(*tables(spark, {k: square for k in range(40)})).collect()
    assert sizes == [1, 2]  # shapes, their triangles
    assert len(areas) == 780 and {(r.object_a < r.object_b, r.opposed, round(r.area_m2, 9)) for r in areas} == {(True, False, 4.0)}
    pairs = M.coplanar_overlap_pairs(*tables(spark, {k: square for k in range(40)}))
    assert sorted((r.p_object_id, r.q_object_id) for r in pairs.collect()) == [(i, j) for i in range(40) for j in range(i + 1, 40)]


def test_shapes_with_copies_against_every_pair_of_triangles(spark):
    rng = np.random.default_rng(4)
    shapes = []
    for _ in range(14):
        z, corners = int(rng.integers(0, 2)), rng.integers(0, 5, (2, 3, 2)).astype(float)
        shapes.append([[(x, y, z) for x, y in t] for t in corners])
    faces = {k: shapes[k % 14] for k in range(34)}
    area2 = lambda t: (t[1][0] - t[0][0]) * (t[2][1] - t[0][1]) - (t[1][1] - t[0][1]) * (t[2][0] - t[0][0])
    flat = lambda t: np.array([[p[:2] for p in (t if area2(t) > 0 else t[::-1])]])
    areas, pairs = {}, set()
    for i in faces:
        for j in faces:
            for s, p in enumerate(faces[i]):
                for t, q in enumerate(faces[j]):
                    (p0, p1), (q0, q1) = ((np.min(x, 0), np.max(x, 0)) for x in (p, q))
                    if i == j or not area2(p) or not area2(q) or (p0 > q1).any() or (q0 > p1).any():
                        continue
                    if (p0[0], i) < (q0[0], j):
                        pairs.add((i, j))
                    area = M.clip_areas(flat(p), flat(q))[0]
                    if i < j and area > 1e-10:
                        key = (i, j, area2(p) * area2(q) < 0)
                        areas[key] = areas.get(key, 0) + area
    got = M.coplanar_overlap_area(*tables(spark, faces), cell_m=2.0).collect()
    assert {(r.object_a, r.object_b, r.opposed): r.area_m2 for r in got} == pytest.approx(areas) and len(got) == len(areas)
    met = [(r.p_object_id, r.q_object_id) for r in M.coplanar_overlap_pairs(*tables(spark, faces), cell_m=2.0).collect()]
    assert len(met) == len(set(met)) and set(met) == pairs


def test_tilted_faces_that_touch_or_overlap(spark):
    u, w = np.array([0.6, 0.0, 0.8]), np.array([0.0, 1.0, 0.0])
    face = lambda s, t: [[tuple(900 + (s + i) * u + (t + j) * w) for i, j in ring] for ring in (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))]
    faces = {0: face(0, 0), 1: face(1, 0), 2: face(0.5, 0.25), 3: face(0, 0), 4: face(0, 0.999)}
    got = {(r.object_a, r.object_b): r.area_m2 for r in M.coplanar_overlap_area(*tables(spark, faces)).collect()}
    want = {(0, 2): 0.375, (0, 3): 1.0, (0, 4): 0.001, (1, 2): 0.375, (2, 3): 0.375, (2, 4): 0.5 * 0.251, (3, 4): 0.001}
    assert got == pytest.approx(want, abs=1e-8)
