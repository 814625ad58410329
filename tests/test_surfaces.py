import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.linalg import hull_ring
from plumbline.operators import pixels as P
from plumbline.operators import registration as R
from plumbline.operators import surfaces as S

POLY = "g int, polygon_ordinal int, vertices array<array<double>>"


def polygons(spark, *rings):
    return spark.createDataFrame([(0, i, [[float(c) for c in p] for p in ring]) for i, ring in enumerate(rings)], POLY)


def points(spark, *ps):
    return spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(ps)], "g int, id int, x double, y double, z double")


def support(spark, ps, rings, **kw):
    out = S.nearest_support_polygon(points(spark, *ps), polygons(spark, *rings), ["g"], ["id"], **kw).orderBy("id").collect()
    return [r.supporting_polygon for r in out], [r.residual_m for r in out]


L = [(0, 0, 0), (10, 0, 0), (10, 1, 0), (1, 1, 0), (1, 10, 0), (0, 10, 0)]


def test_concave_support(spark):
    idx, res = support(spark, [(.5, .5, .2), (2, 2, .2), (8, .5, .2)], [L])
    assert idx == [0, None, 0] and res[0] == pytest.approx(.2)


def test_closest_plane_wins_and_stats(spark):
    square = lambda z: [(0, 0, z), (2, 0, z), (2, 2, z), (0, 2, z)]
    idx, res = support(spark, [(1, 1, .1), (1, 1, .45)], [square(0), square(.5)])
    assert idx == [0, 1] and res == pytest.approx([.1, -.05])


def test_tie_takes_first_polygon_and_boundary_counts(spark):
    square = lambda z: [(0, 0, z), (2, 0, z), (2, 2, z), (0, 2, z)]
    idx, _ = support(spark, [(1, 1, .25), (2, 2, .1), (2.001, 2, .1)], [square(0), square(.5)])
    assert idx == [0, 0, None]


def test_source_normal_flips_sign(spark):
    ring = [(0, 0, 0), (0, 2, 0), (2, 2, 0), (2, 0, 0)]
    assert support(spark, [(1, 1, .25)], [ring])[1] == pytest.approx([-.25])
    assert support(spark, [(1, 1, .25)], [ring], source_normal=(0, 0, 1))[1] == pytest.approx([.25])


def test_support_is_rigid_invariant(spark):
    """Random points and oblique pentagons: same answer before and after a motion, and as brute force."""
    rng = np.random.default_rng(4)
    a = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    a *= np.sign(np.linalg.det(a))
    angles = np.arange(5) * 2 * np.pi / 5
    base = np.stack([np.cos(angles), np.sin(angles), np.zeros(5)], axis=1)
    rings = [base * (1 + i) + [i, 0, i * .5] for i in range(4)]
    ps = rng.uniform(-3, 6, size=(200, 3))
    first = support(spark, ps, rings)
    second = support(spark, ps @ a.T + 5, [r @ a.T + 5 for r in rings])
    assert first[0] == second[0]
    brute = []
    for p in ps:
        best = None
        for i, r in enumerate(rings):
            e = np.roll(r, -1, axis=0) - r
            if (e[:, 0] * (p[1] - r[:, 1]) - e[:, 1] * (p[0] - r[:, 0]) >= 0).all():
                d = abs(p[2] - r[0, 2])
                best = min(best or (d, i), (d, i))
        brute.append(None if best is None else best[1])
    assert first[0] == brute


def patch_case(spark):
    """An 8x8 wall: one zero, one too far, two of low confidence."""
    rows = []
    for v in range(8):
        for u in range(8):
            depth = 0 if (u, v) == (1, 1) else 6000 if (u, v) == (2, 1) else 2000
            rows.append(("c", "f", v, u, depth, 128 if (u, v) in ((3, 3), (4, 3)) else 255))
    return spark.createDataFrame(rows, "capture_id string, frame_id string, v int, u int, depth_mm int, confidence int")


def test_patch_fit_counts(spark):
    px = patch_case(spark)
    cam = spark.createDataFrame([("f", 8, 8, 8.0, 8.0, 4.0, 4.0, [float(i % 5 == 0) for i in range(16)])],
                                "frame_id string, width int, height int, fx double, fy double, cx double, cy double, pose array<double>")
    cloud = P.unproject(P.eligible_pixels(px), cam, (8, 8), ["frame_id"]).withColumn("patch_id", F.lit("wide"))
    small = cloud.where("v = 0 AND u < 2").withColumn("patch_id", F.lit("small"))
    fits = {r.patch_id: r for r in S.plane_fit(cloud.unionByName(small), ["patch_id"]).collect()}
    assert (fits["wide"].status, fits["wide"].n, fits["wide"].inlier_count) == ("fitted", 60, 60)
    assert abs(fits["wide"].nz) == pytest.approx(1) and fits["small"].status == "too_few_samples" and fits["small"].nx is None


def test_polygon_selection_both_orientations(spark):
    px = spark.createDataFrame([("c", "f", v, u) for v in range(2) for u in range(3)], "capture_id string, frame_id string, v int, u int")
    mapped = P.map_depth_to_rgb_pixel(px, (3, 2), (6, 4))
    ring = lambda w, h: [(0.0, 0.0), (w - 1.0, 0.0), (w - 1.0, h - 1.0), (0.0, h - 1.0)]
    patches = spark.createDataFrame([("c", "f", "raw", ring(6, 4), "raw", 4), ("c", "f", "turned", ring(4, 6), "upright90cw", 4), ("c", "f", "part", [(0.0, 0.0), (3.0, 0.0), (3.0, 1.0), (0.0, 1.0)], "raw", 4)],
                                    "capture_id string, frame_id string, patch_id string, polygon array<struct<x:double,y:double>>, orientation string, rgb_height int")
    counts = {r.patch_id: r["count"] for r in S.polygon_select_pixels(mapped, patches).groupBy("patch_id").count().collect()}
    assert counts == {"raw": 6, "turned": 6, "part": 2}


def test_outliers_are_rejected_and_collinear_is_reported(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1, size=(300, 2))
    z = .2 * xy[:, 0] + rng.normal(scale=.002, size=300)
    z[:20] += .5
    rows = [("wall", *map(float, (x, y, h))) for (x, y), h in zip(xy, z)] + [("line", float(i), float(i), float(i)) for i in range(50)]
    fits = {r.id: r for r in S.plane_fit(spark.createDataFrame(rows, "id string, x double, y double, z double"), ["id"]).collect()}
    assert fits["line"].status == "no_span"
    # the same rounds with a dense decomposition
    p, keep = np.column_stack([xy, z]), np.ones(300, bool)
    for _ in range(6):
        c = p[keep].mean(0)
        n = np.linalg.svd(p[keep] - c)[2][-1]
        keep = np.abs((p - c) @ n) <= .02
    assert fits["wall"].inlier_count == keep.sum()
    assert abs(np.dot((fits["wall"].nx, fits["wall"].ny, fits["wall"].nz), n)) == pytest.approx(1, abs=1e-9)


def test_hull_and_overlap(spark):
    square = [(0, 0), (4, 0), (4, 4), (0, 4), (2, 2), (2, 0)]
    assert len(hull_ring(np.array(square, float))) == 4
    first = spark.createDataFrame([(0, 1.0, 1.0), (0, 4.0, 4.0), (0, 4.1, 1.0)], "k int, px double, py double")
    second = spark.createDataFrame([(0, float(x), float(y)) for x, y in square], "k int, px double, py double")
    assert sorted((r.px, r.py) for r in S.convex_overlap(first, second, "k").collect()) == [(1.0, 1.0), (4.0, 4.0)]


def landmarks(spark, rows):
    return spark.createDataFrame([("t", str(i), role, *map(float, s), *map(float, t), "photo") for i, (role, s, t) in enumerate(rows)],
                                 "transform_id string, id string, role string, sx double, sy double, sz double, tx double, ty double, tz double, evidence string")


def test_translation_fit_and_checks(spark):
    marks = landmarks(spark, [("fit", (0, 0, 0), (2, 1, 0)), ("fit", (1, 0, 0), (3, 1, 0)), ("fit", (0, 2, 0), (2, 3, 0)), ("check", (1, 2, 1), (3, 3, 1))])
    fit = R.rigid_fit(marks, ["transform_id"])
    assert np.allclose(fit.collect()[0].matrix, [1, 0, 0, 2, 0, 1, 0, 1, 0, 0, 1, 0, 0, 0, 0, 1], atol=1e-12)
    summary = {r.role: r for r in R.residual_summary_by_role(R.landmark_residuals(marks, fit, ["transform_id"]), ["transform_id"]).collect()}
    assert summary["fit"].n == 3 and summary["check"].n == 1 and summary["check"].max < 1e-12


def test_rotation_fit_never_mirrors(spark):
    rng = np.random.default_rng(3)
    source = rng.normal(size=(20, 3))
    q = np.linalg.qr(rng.normal(size=(3, 3)))[0]
    q *= np.sign(np.linalg.det(q))
    mirrored = source * [1, 1, -1]
    for target, exact in ((source @ q.T + 1, True), (mirrored, False)):
        m = np.array(R.rigid_fit(landmarks(spark, [("fit", s, t) for s, t in zip(source, target)]), ["transform_id"]).collect()[0].matrix).reshape(4, 4)
        assert np.linalg.det(m[:3, :3]) == pytest.approx(1)
        assert np.allclose(m[:3, :3], q) == exact


def test_too_few_and_collinear(spark):
    two = landmarks(spark, [("fit", (0, 0, 0), (0, 0, 0)), ("fit", (1, 0, 0), (1, 0, 0))])
    line = landmarks(spark, [("fit", (i, i, i), (i, 0, 0)) for i in range(5)])
    assert R.rigid_fit(two, ["transform_id"]).collect()[0].status == "too_few"
    assert R.rigid_fit(line, ["transform_id"]).collect()[0].status == "collinear"


def test_landmark_rules(spark, rows):
    marks = landmarks(spark, [("fit", (0, 0, 0), (0, 0, 0)), ("both", (0, 0, float("nan")), (0, 0, 0))]).withColumn("id", F.lit("same"))
    assert {r.rule for r in R.check_landmarks(marks, ["transform_id"]).collect()} == {"role", "not_finite", "duplicate_id"}
