"""Pairs of shapes are written out tile by tile: lists of faces travel once to a pair of tiles, in pieces of bounded length."""

import numpy as np
import pytest
from test_face_shapes import tables

from plumbline.operators import mesh as M


def rectangles(n, seed):
    """Faces of two triangles on two planes, many of them exact copies: object to (x0, y0, x1, y1, z)."""
    rng = np.random.default_rng(seed)
    shapes = [(*p, *(p + rng.integers(1, 4, 2)), z) for p, z in zip(rng.integers(0, 12, (n // 5, 2)), rng.integers(0, 2, n // 5))]
    return {k: tuple(float(v) for v in shapes[int(rng.integers(len(shapes)))]) for k in range(n)}


def faces_of(rects):
    return {k: [[(x0, y0, z), (x1, y0, z), (x1, y1, z)], [(x0, y0, z), (x1, y1, z), (x0, y1, z)]] for k, (x0, y0, x1, y1, z) in rects.items()}


@pytest.mark.parametrize("bits, piece", [(8, 1024), (2, 3), (0, 1)])
def test_pairs_and_areas_of_small_tiles_and_short_pieces(spark, monkeypatch, bits, piece):
    for name, value in (("TILE_BITS", bits), ("TILE", 1 << bits), ("PIECE", piece)):
        monkeypatch.setattr(M, name, value)
    rects = rectangles(90, 11)
    areas, pairs = {}, set()
    for i, p in rects.items():
        for j, q in rects.items():
            w, h = (min(p[k + 2], q[k + 2]) - max(p[k], q[k]) for k in (0, 1))
            if i == j or p[4] != q[4] or w < 0 or h < 0:
                continue
            if (p[0], i) < (q[0], j):
                pairs.add((i, j))
            if i < j and w * h > 0:
                areas[i, j] = w * h
    got = M.coplanar_overlap_area(*tables(spark, faces_of(rects)), cell_m=2.0).collect()
    assert {(r.object_a, r.object_b): r.area_m2 for r in got} == pytest.approx(areas) and len(got) == len(areas)
    met = [(r.p_object_id, r.q_object_id) for r in M.coplanar_overlap_pairs(*tables(spark, faces_of(rects)), cell_m=2.0).collect()]
    assert len(met) == len(set(met)) and set(met) == pairs


def test_pairs_of_shapes_are_gathered_by_tiles(spark, monkeypatch):
    stored, cut = [], M.cut_lineage
    monkeypatch.setattr(M, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    rects = {k: (0.0, 0.0, 1.0 + k % 30, 1.0, 0.0) for k in range(60)}  # 30 shapes, each pair of which overlaps
    assert M.coplanar_overlap_area(*tables(spark, faces_of(rects))).count() == 60 * 59 // 2
    assert stored[-1].count() == 1 and len(stored[-1].first()["codes"]) == 30 * 31 // 2


@pytest.mark.parametrize("bits, piece", [(8, 1024), (1, 2)])
def test_overlaps_are_ordered_by_shuffling_lists(spark, monkeypatch, bits, piece):
    for name, value in (("TILE_BITS", bits), ("TILE", 1 << bits), ("PIECE", piece)):
        monkeypatch.setattr(M, name, value)
    triangles, vertices = tables(spark, faces_of(rectangles(80, 5)))
    # the same faces as another face of some objects of a second scene
    triangles = triangles.selectExpr("0 AS scene", "*").unionByName(triangles.where("object_id < 40").selectExpr("1 AS scene", "object_id % 7 AS object_id", "object_id AS face", "triangle", "transform(vertices, v -> v + 10 * object_id) AS vertices"))
    vertices = vertices.selectExpr("0 AS scene", "*").unionByName(vertices.where("object_id < 40").selectExpr("1 AS scene", "object_id % 7 AS object_id", "vertex + 10 * object_id AS vertex", "x", "y", "z"))
    ordered = M.sorted_overlaps(triangles, vertices, cell_m=2.0, scene=["scene"], by=["scene"])
    columns = ["scene", "object_a", "face_a", "object_b", "face_b", "area_m2"]
    got = [tuple(r) for r in ordered.select(*columns).collect()]
    want = sorted(tuple(r) for r in M.coplanar_overlap_area(triangles, vertices, cell_m=2.0, scene=["scene"]).where("NOT opposed").select(*columns).collect())
    assert got == want and len({r[:1] for r in got}) == 2 and any(r[1] == r[3] for r in got)
    plan = ordered._jdf.queryExecution().executedPlan().toString()
    assert 0 <= plan.find("Generate posexplode(__o") < plan.find("rangepartitioning")  # lists are shuffled, rows made of them afterwards


def test_few_broken_objects_are_left_out_without_a_shuffle(spark, monkeypatch):
    plans, shapes = [], M.face_shapes
    monkeypatch.setattr(M, "face_shapes", lambda triangles, *rest: plans.append(triangles._jdf.queryExecution().sparkPlan().toString()) or shapes(triangles, *rest))
    triangles, vertices = tables(spark, {**faces_of({0: (0.0, 0.0, 2.0, 1.0, 0.0), 1: (1.0, 0.0, 3.0, 1.0, 0.0)}), 2: [[(0, 0, float("inf")), (1, 0, 0), (1, 1, 0)]]})
    faces = triangles.where("triangle = 0").select("object_id", "face", "vertices")
    found = {(r.rule, r.entity_id) for r in M.review_meshes(vertices, faces, triangles)[0].collect()}
    assert {("nonfinite_vertices", "2"), ("coplanar_overlap", "0/0/1/0")} == found
    assert "BroadcastHashJoin" in plans[0] and "SortMergeJoin" not in plans[0]
