import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.functions.quantiles import exact_quantiles, residual_stats
from plumbline.functions.ranking import bucketed_rank, range_rank
from plumbline.operators import pixels as P

# a pose turned by 90 degrees about z, then shifted
POSE = [0.0, -1, 0, -7, 1, 0, 0, 11, 0, 0, 1, 5, 0, 0, 0, 1]
DEPTH = [[700, 0, 31, 4200], [5000, 5001, 12, 900]]
CONFIDENCE = [[255, 255, 255, 54], [255, 255, 0, 255]]


def frame(spark):
    px = spark.createDataFrame(
        [("c", "f", v, u, DEPTH[v][u], CONFIDENCE[v][u]) for v in range(2) for u in range(4)],
        "capture_id string, frame_id string, v int, u int, depth_mm int, confidence int")
    cam = spark.createDataFrame([("c", "f", 12, 10, 9.0, 15.0, 4.5, 2.5, [float(x) for x in POSE])],
                                "capture_id string, frame_id string, width int, height int, fx double, fy double, cx double, cy double, pose array<double>")
    return px, cam


def test_unproject_by_the_camera_model(spark, rows):
    px, cam = frame(spark)
    points = P.unproject(P.eligible_pixels(px, max_depth_m=5.0), cam, (4, 2))
    got = {(r.u, r.v): (r.x, r.y, r.z) for r in points.collect()}
    kept = [(u, v) for v in range(2) for u in range(4) if CONFIDENCE[v][u] == 255 and 0 < DEPTH[v][u] <= 5000]
    assert sorted(got) == sorted(kept)
    pose = np.array(POSE).reshape(4, 4)
    for u, v in kept:
        z = DEPTH[v][u] / 1000
        local = [(u - 4.5 * 4 / 12) * z / (9 * 4 / 12), -(v - 2.5 * 2 / 10) * z / (15 * 2 / 10), -z, 1]
        assert np.allclose(got[u, v], (pose @ local)[:3], atol=1e-12)
    assert P.eligible_pixels(px, max_depth_m=70).count() == len(kept) + 1


def test_rint_breaks_ties_to_even(spark, rows):
    df = spark.createDataFrame([(v,) for v in range(6)], "u int").withColumn("v", F.lit(0))
    got = P.map_depth_to_rgb_pixel(df, (6, 1), (3, 1)).orderBy("u")
    assert [r.rgb_u for r in got.collect()] == [0, 0, 1, 2, 2, 2]


def test_clip_camera_segment(spark):
    cases = {"kept": ([0, 0, -2], [1, 1, -3]), "hidden": ([0, 0, 1], [1, 1, .2]), "first": ([0, 0, .5], [1, 1, -2]),
             "second": ([1, 1, -2], [0, 0, .5]), "origin": ([0, 0, 0], [1, 1, -1])}
    df = spark.createDataFrame([(k, [float(x) for x in a], [float(x) for x in b]) for k, (a, b) in cases.items()], "id string, start array<double>, end array<double>")
    got = {r.id: r for r in P.clip_camera_segment(df, 0.1).collect()}
    assert (got["kept"].t0, got["kept"].t1, got["kept"].camera_plane_clipped) == (0.0, 1.0, False)
    assert not got["hidden"].visible and got["hidden"].t0 is None and got["hidden"].clip_start is None
    assert got["first"].t0 == pytest.approx(.24) and got["second"].t1 == pytest.approx(.76) and got["origin"].t0 == pytest.approx(.1)


def test_frame_order_is_numeric_first(spark):
    df = spark.createDataFrame([("c", x) for x in ["10", "9", "b", "a", "2", "010"]], "capture_id string, frame_id string")
    got = P.frame_ordinals(df).orderBy("ordinal").collect()
    assert [r.frame_id for r in got] == ["2", "9", "010", "10", "a", "b"]


def test_ranks_match_a_plain_window(spark):
    df = spark.range(0, 5000).select((F.col("id") % 3).alias("k"), ((F.col("id") * 7919) % 5003).alias("o"))
    df = df.withColumn("k", F.when(F.col("o") < 3500, 0).otherwise(F.col("k")))  # one hot key
    pdf = df.toPandas()
    want = {(r.k, r.o): i for _, g in pdf.sort_values("o").groupby("k") for i, r in enumerate(g.itertuples())}
    for ranked in (bucketed_rank(df, ["k"], F.floor(F.col("o") / 100), [F.col("o")], "r"), range_rank(df, ["k"], [F.col("o")], "r")):
        assert {(r.k, r.o): r.r for r in ranked.collect()} == want


@pytest.mark.parametrize("n", [1, 2, 37, 400, 9000])
def test_exact_quantiles_against_numpy(spark, n):
    rng = np.random.default_rng(n)
    values = np.round(rng.exponential(size=n) ** 3, 3)
    df = spark.createDataFrame([(0 if i % 3 else 1, float(v)) for i, v in enumerate(values)], "k int, v double")
    got = {r.k: r for r in residual_stats(df, ["k"], "v", group_rows=500).collect()}
    for k in got:
        part = np.array([v for i, v in enumerate(values) if (0 if i % 3 else 1) == k])
        assert got[k].n == len(part)
        assert got[k].median == pytest.approx(np.median(part), abs=1e-12)
        assert got[k].p95 == pytest.approx(np.percentile(part, 95), abs=1e-12)
        assert got[k].max == part.max()


def test_quantiles_of_heavy_ties_and_whole_frame(spark):
    df = spark.createDataFrame([(1.0,)] * 4000 + [(2.0,)] * 3000 + [(float(i),) for i in range(3, 30)], "v double")
    got = exact_quantiles(df, [], "v", {"q": 0.5, "r": 0.999}, group_rows=200).collect()[0]
    want = np.array([1.0] * 4000 + [2.0] * 3000 + list(range(3, 30)))
    assert got.q == np.percentile(want, 50) and got.r == pytest.approx(np.percentile(want, 99.9))


def test_nearest_pixel_and_orientation(spark):
    df = spark.createDataFrame([(0, 5.5, 2.4, "raw", 6, 4), (1, 1.2, 0.6, "upright90cw", 6, 4)], "id int, u double, v double, orientation string, width int, height int")
    near = {r.id: r for r in P.nearest_pixel(df).collect()}
    assert near[0].near_u is None and (near[0].outside_u, near[0].outside_v) == (6, 2) and (near[1].near_u, near[1].near_v) == (1, 1)
    shown = {r.id: r for r in P.native_to_display_pixel(df).collect()}
    assert (shown[1].display_u, shown[1].display_v) == (4 - 1 - 0.6, 1.2) and shown[1].round_trip
