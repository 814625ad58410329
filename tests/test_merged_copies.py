"""Exact copies are searched once and still answer for every row."""

from plumbline.operators import appearance as A, surfaces as S

SQUARE = [[0.0, 0.0, 2.0], [4.0, 0.0, 2.0], [4.0, 4.0, 2.0], [0.0, 4.0, 2.0]]


def counted(monkeypatch, module):
    sizes, spread = [], module.spread_out
    monkeypatch.setattr(module, "spread_out", lambda df: sizes.append(df.count()) or spread(df))
    return sizes


def test_copies_of_a_support_are_one_polygon_with_the_lowest_ordinal(spark, monkeypatch):
    sizes = counted(monkeypatch, S)
    points = spark.createDataFrame([("g", i, 1.0 + i / 100, 1.0, 2.5) for i in range(20)], "g string, id int, x double, y double, z double")
    rings = spark.createDataFrame([("g", 7 + i, SQUARE) for i in range(40)] + [("h", 1, SQUARE)], "g string, polygon_ordinal int, vertices array<array<double>>")
    out = S.nearest_support_polygon(points, rings, ["g"], ["id"]).collect()
    assert {(r.supporting_polygon, r.residual_m) for r in out} == {(7, 0.5)} and len(out) == 20
    assert sizes[0] == 1  # the polygons; a group without points has none


def test_copies_of_faces_and_places_are_searched_once(spark, monkeypatch):
    sizes = counted(monkeypatch, A)
    points = spark.createDataFrame([(s, i, 1.0, 1.0 + s, 0.0) for s in (1, 2) for i in range(30)] + [(1, 99, None, 1.0, 0.0)],
                                   "scene int, point_id int, x double, y double, floor_z double")
    faces = spark.createDataFrame([(1, SQUARE)] * 50, "scene int, polygon array<array<double>>")
    out = A.ceiling_above(points, faces, scene=["scene"]).collect()
    assert sorted((r.scene, r.ceiling_z or 0.0) for r in out) == [(1, 0.0)] + [(1, 2.0)] * 30 + [(2, 0.0)] * 30
    assert sizes[:2] == [1, 3]  # faces, places
