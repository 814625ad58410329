"""Registered queries: depth pixels, unprojection, sampling, projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.quantiles import counted_stats, residual_stats as stats_of
from plumbline.operators import pixels as P
from plumbline.plans import views as W
from plumbline.plans.registry import query
from plumbline.plans.views import with_views
from plumbline.rules import unmatched

PIXEL = ("capture_id", "frame_id", "v", "u")


def rounded(df, *names, places=6):
    return df.withColumns({n: F.round(n, places) for n in names})


@query(with_views("px", """SELECT * FROM px WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000"""))
def eligible_pixels(spark, sf):
    return P.eligible_pixels(W.px(spark, sf))


@query(with_views("px cam pts", """SELECT capture_id, frame_id, v, u, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM pts"""))
def unproject(spark, sf):
    return rounded(W.pts(spark, sf).select(*PIXEL, "x", "y", "z"), "x", "y", "z")


@query(with_views("px cam", """SELECT 'no_camera' AS rule, CAST(frame_id AS VARCHAR) AS entity_id, CAST(count(*) AS VARCHAR) AS detail FROM px
WHERE frame_id NOT IN (SELECT frame_id FROM cam WHERE frame_id % 3 <> 0) GROUP BY frame_id"""))
def unmatched_cameras(spark, sf):
    """Frames whose pixels would have no point, a third of the cameras being absent."""
    return unmatched(W.px(spark, sf), W.cam(spark, sf).where("frame_id % 3 <> 0"), ["frame_id"], "no_camera")


@query(with_views("px", """, ranked AS (
 SELECT *, row_number() OVER (PARTITION BY capture_id, frame_id ORDER BY v, u) - 1 AS r
 FROM px WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000)
SELECT capture_id, frame_id, v, u, depth_mm FROM ranked WHERE r % 4 = 0"""))
def sample_every_nth_point(spark, sf):
    return P.sample_every_nth_point(P.eligible_pixels(W.px(spark, sf)), 4).select(*PIXEL, "depth_mm")


@query(with_views("px cam pts", """, ranked AS (
 SELECT *, row_number() OVER (PARTITION BY capture_id, frame_id ORDER BY v, u) - 1 AS r FROM pts)
SELECT capture_id, count(*) AS points, CAST(count(DISTINCT frame_id) AS BIGINT) AS frames,
 round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(min(z), 6) AS min_z,
 round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, round(max(z), 6) AS max_z
FROM ranked WHERE r % 4 = 0 GROUP BY capture_id"""))
def reference_cloud(spark, sf):
    """The headline path: eligible pixels, stride, unprojection, cloud bounds."""
    sampled = P.sample_every_nth_point(P.eligible_pixels(W.px(spark, sf)), 4)
    cloud = P.unproject(sampled, W.cam(spark, sf), W.DEPTH_SIZE, ["frame_id"])
    axes = [f"{side}_{a}" for side in ("min", "max") for a in "xyz"]
    # frames are counted from per-frame partial counts, so no task sees a capture's points
    spans = cloud.groupBy("capture_id", "frame_id").agg(
        F.count("*").alias("n"), *[f(a).alias(f"{s}_{a}") for s, f in (("min", F.min), ("max", F.max)) for a in "xyz"])
    whole = spans.groupBy("capture_id").agg(
        F.sum("n").alias("points"), F.count("*").alias("frames"),
        *[(F.min if n.startswith("min") else F.max)(n).alias(n) for n in axes])
    return rounded(whole, *axes)


@query(with_views("px cam pts", """SELECT capture_id,
 round(min(x), 6) AS min_x, round(min(y), 6) AS min_y, round(min(z), 6) AS min_z,
 round(max(x), 6) AS max_x, round(max(y), 6) AS max_y, round(max(z), 6) AS max_z,
 round((min(x) + max(x)) / 2, 6) AS center_x, round((min(y) + max(y)) / 2, 6) AS center_y, round((min(z) + max(z)) / 2, 6) AS center_z,
 round(max(x) - min(x), 6) AS extent_x, round(max(y) - min(y), 6) AS extent_y, round(max(z) - min(z), 6) AS extent_z
FROM pts GROUP BY capture_id"""))
def bounds(spark, sf):
    out = P.bounds(W.pts(spark, sf), ["capture_id"])
    return rounded(out, *[c for c in out.columns if c != "capture_id"])


@query(with_views("px", """SELECT capture_id, frame_id, count(*) AS native,
 count(*) FILTER (WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000) AS eligible,
 CAST(ceil(count(*) FILTER (WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000) / 4.0) AS BIGINT) AS sampled,
 round(count(*) FILTER (WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000) / CAST(count(*) AS DOUBLE), 6) AS eligible_fraction
FROM px GROUP BY capture_id, frame_id"""))
def frame_sampling_counts(spark, sf):
    return rounded(P.frame_sampling_counts(W.px(spark, sf), 4), "eligible_fraction")


@query(with_views("px", """SELECT capture_id, frame_id,
 count(*) FILTER (WHERE depth_mm = 0) AS zero, count(*) FILTER (WHERE depth_mm <> 0) AS nonzero,
 count(*) FILTER (WHERE depth_mm > 0 AND depth_mm <= 5000) AS in_range,
 count(*) FILTER (WHERE NOT (depth_mm > 0 AND depth_mm <= 5000)) AS out_of_range
FROM px GROUP BY capture_id, frame_id"""))
def depth_class_counts(spark, sf):
    return P.depth_class_counts(W.px(spark, sf), P.FRAME)


@query(with_views("px", "SELECT capture_id, frame_id, confidence, count(*) AS n FROM px GROUP BY capture_id, frame_id, confidence"))
def confidence_histogram(spark, sf):
    return P.confidence_histogram(W.px(spark, sf), P.FRAME)


@query(with_views("px", """SELECT capture_id, count(*) AS n, round(quantile_cont(depth_mm, 0.5), 6) AS median,
 round(quantile_cont(depth_mm, 0.95), 6) AS p95, CAST(max(depth_mm) AS DOUBLE) AS max FROM px GROUP BY capture_id"""))
def depth_stats(spark, sf):
    """Statistics of a 16-bit column: exact percentile over value counts."""
    return rounded(counted_stats(W.px(spark, sf), ["capture_id"], "depth_mm"), "median", "p95")


@query(with_views("px cam pts", """SELECT capture_id, count(*) AS n, round(quantile_cont(abs(y - 1.5), 0.5), 6) AS median,
 round(quantile_cont(abs(y - 1.5), 0.95), 6) AS p95, round(max(abs(y - 1.5)), 6) AS max FROM pts GROUP BY capture_id"""))
def residual_stats(spark, sf):
    """Median, p95 and maximum distance of the points from the plane y = 1.5."""
    points = W.pts(spark, sf).withColumn("residual", F.abs(F.col("y") - 1.5))
    return rounded(stats_of(points, ["capture_id"], "residual"), "median", "p95", "max")


@query(with_views("px", """SELECT capture_id, frame_id, v, u,
 CAST(least(greatest(round_even(u * 96.0 / 192.0, 0), 0), 95) AS INTEGER) AS rgb_u,
 CAST(least(greatest(round_even(v * 63.0 / 128.0, 0), 0), 62) AS INTEGER) AS rgb_v FROM px"""))
def map_depth_to_rgb_pixel(spark, sf):
    """Half-size image: every odd column is a tie and must round to even."""
    return P.map_depth_to_rgb_pixel(W.px(spark, sf), W.DEPTH_SIZE, (96, 63)).select(*PIXEL, "rgb_u", "rgb_v")


W.SQL["rgb"] = """SELECT l_returnflag AS capture_id, l_suppkey AS frame_id, l_partkey % 128 AS v, l_orderkey % 192 AS u,
 max(CAST(l_quantity AS INTEGER)) AS r, max(CAST(l_discount * 1000 AS INTEGER)) AS g, max(l_linenumber) AS b
 FROM lineitem GROUP BY l_returnflag, l_suppkey, l_partkey % 128, l_orderkey % 192"""


def rgb(spark, sf):
    """A second, transposed pixel grid that stands for the color image."""
    return W.table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("capture_id"), F.col("l_suppkey").alias("frame_id"),
        (F.col("l_partkey") % 128).alias("v"), (F.col("l_orderkey") % 192).alias("u"),
    ).agg(
        F.max(F.col("l_quantity").cast("int")).alias("r"),
        F.max(F.rint(F.col("l_discount") * 1000).cast("int")).alias("g"),
        F.max("l_linenumber").alias("b"),
    )


@query(with_views("px rgb", """SELECT p.capture_id, p.frame_id, p.v, p.u, c.r, c.g, c.b FROM px p
 LEFT JOIN rgb c ON c.capture_id = p.capture_id AND c.frame_id = p.frame_id AND c.v = p.v AND c.u = p.u
 WHERE p.confidence = 255 AND p.depth_mm > 0 AND p.depth_mm <= 5000"""))
def join_point_color(spark, sf):
    points = P.map_depth_to_rgb_pixel(P.eligible_pixels(W.px(spark, sf)), W.DEPTH_SIZE, W.DEPTH_SIZE)
    return P.join_point_color(points, rgb(spark, sf)).select(*PIXEL, "r", "g", "b")


@query(with_views("px rgb", """SELECT p.capture_id, p.frame_id, p.v, p.u, p.depth_mm, c.r AS confidence FROM px p JOIN rgb c
 ON c.capture_id = p.capture_id AND c.frame_id = p.frame_id AND c.v = p.v AND c.u = p.u"""))
def join_depth_confidence(spark, sf):
    depth = W.px(spark, sf).select(*PIXEL, "depth_mm")
    confidence = rgb(spark, sf).select(*PIXEL, F.col("r").alias("confidence"))
    return P.join_depth_confidence(depth, confidence)


@query(with_views("px cam pts", """, t AS (SELECT capture_id, frame_id, v, u, (frame_id + 1) AS target, x, y, z FROM pts),
l AS (SELECT t.*, cam.fx, cam.fy, cam.cx, cam.cy, c * (x - tx) - s * (z - tz) AS lx, y - ty AS ly, -(s * (x - tx) + c * (z - tz)) AS d
 FROM t JOIN cam ON cam.frame_id = t.target),
q AS (SELECT *, fx * lx / (CASE WHEN d > 0.001 THEN d ELSE 1 END) + cx AS px_u, cy - fy * ly / (CASE WHEN d > 0.001 THEN d ELSE 1 END) AS px_v FROM l)
SELECT capture_id, frame_id, v, u, round(d, 9) AS depth_m, round(px_u, 8) AS px_u, round(px_v, 8) AS px_v,
 (d > 0.001 AND px_u >= 0 AND px_v >= 0 AND px_u <= 383 AND px_v <= 255) AS visible FROM q"""))
def project_to_camera(spark, sf):
    """Every point seen from the next frame's camera."""
    points = W.pts(spark, sf).withColumn("target", F.col("frame_id") + 1)
    cameras = W.cam(spark, sf).withColumnRenamed("frame_id", "target")
    out = P.project_to_camera(points, cameras, ["target"]).select(*PIXEL, "depth_m", "px_u", "px_v", "visible")
    return rounded(rounded(out, "depth_m", places=9), "px_u", "px_v", places=8)


W.SQL["segs"] = """SELECT vec_id, CAST(embedding[1] AS DOUBLE) * 4 AS ax, CAST(embedding[2] AS DOUBLE) * 4 AS ay, CAST(embedding[3] AS DOUBLE) * 4 AS az,
 CAST(embedding[4] AS DOUBLE) * 4 AS bx, CAST(embedding[5] AS DOUBLE) * 4 AS by, CAST(embedding[6] AS DOUBLE) * 4 AS bz FROM embeddings"""


def segments(spark, sf):
    """Camera-space segments from the first six embedding coordinates."""
    e = lambda i: F.element_at("embedding", i).cast("double") * 4
    return W.table(spark, sf, "embeddings").select(
        "vec_id", F.array(e(1), e(2), e(3)).alias("start"), F.array(e(4), e(5), e(6)).alias("end"))


@query(with_views("segs", """, k AS (SELECT *, -az AS d0, -bz AS d1, (0.1 - -az) / nullif(-bz - -az, 0) AS t FROM segs),
c AS (SELECT *, greatest(d0, d1) >= 0.1 AS visible, CASE WHEN d0 < 0.1 THEN t ELSE 0 END AS t0, CASE WHEN d1 < 0.1 THEN t ELSE 1 END AS t1 FROM k)
SELECT vec_id, visible, visible AND (t0 <> 0 OR t1 <> 1) AS camera_plane_clipped,
 CASE WHEN visible THEN round(t0, 6) END AS t0, CASE WHEN visible THEN round(t1, 6) END AS t1,
 CASE WHEN visible THEN round(ax + t0 * (bx - ax), 6) END AS start_x, CASE WHEN visible THEN round(az + t1 * (bz - az), 6) END AS end_z FROM c"""))
def clip_camera_segment(spark, sf):
    out = P.clip_camera_segment(segments(spark, sf), 0.1)
    return rounded(out.select("vec_id", "visible", "camera_plane_clipped", "t0", "t1",
                              F.col("clip_start")[0].alias("start_x"), F.col("clip_end")[2].alias("end_z")),
                   "t0", "t1", "start_x", "end_z")


W.SQL["marks"] = """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (l_partkey % 384) + l_discount * 10 AS u, (l_orderkey % 256) + l_tax * 10 AS v,
 CASE WHEN l_returnflag = 'R' THEN 'raw' ELSE 'upright90cw' END AS orientation, 384 AS width, 256 AS height FROM lineitem"""


def marks(spark, sf):
    """Photo marks in native pixel coordinates, some rounding outside the image."""
    return W.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        (F.col("l_partkey") % 384 + F.col("l_discount") * 10).alias("u"), (F.col("l_orderkey") % 256 + F.col("l_tax") * 10).alias("v"),
        F.when(F.col("l_returnflag") == "R", "raw").otherwise("upright90cw").alias("orientation"),
        F.lit(384).alias("width"), F.lit(256).alias("height"))


MARK = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query(with_views("marks", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
 round(CASE WHEN orientation = 'raw' THEN u ELSE 255 - v END, 6) AS display_u, round(CASE WHEN orientation = 'raw' THEN v ELSE u END, 6) AS display_v,
 CASE WHEN orientation = 'raw' THEN 384 ELSE 256 END AS display_width, CASE WHEN orientation = 'raw' THEN 256 ELSE 384 END AS display_height,
 true AS round_trip FROM marks"""))
def native_to_display_pixel(spark, sf):
    out = P.native_to_display_pixel(marks(spark, sf))
    return rounded(out.select(*MARK, "display_u", "display_v", "display_width", "display_height", "round_trip"), "display_u", "display_v")


@query(with_views("marks", """, r AS (SELECT *, CAST(floor(u + 0.5) AS BIGINT) AS nu, CAST(floor(v + 0.5) AS BIGINT) AS nv FROM marks),
i AS (SELECT *, nu >= 0 AND nu < width AND nv >= 0 AND nv < height AS ok FROM r)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN ok THEN nu END AS near_u, CASE WHEN ok THEN nv END AS near_v,
 CASE WHEN NOT ok THEN nu END AS outside_u, CASE WHEN NOT ok THEN nv END AS outside_v FROM i"""))
def nearest_pixel(spark, sf):
    return P.nearest_pixel(marks(spark, sf)).select(*MARK, "near_u", "near_v", "outside_u", "outside_v")


@query("""WITH m AS (SELECT o_orderkey, o_custkey % 300 AS u0, (o_orderkey * 7) % 200 AS v0, 300 - o_custkey % 290 AS u1, o_orderkey % 250 AS v1 FROM orders)
SELECT o_orderkey, CAST(greatest(0, floor(least(u0, u1) + 0.5 - 32)) AS BIGINT) AS "left", CAST(greatest(0, floor(least(v0, v1) + 0.5 - 32)) AS BIGINT) AS top,
 CAST(least(384, ceil(greatest(u0, u1) + 0.5 + 32)) AS BIGINT) AS "right", CAST(least(256, ceil(greatest(v0, v1) + 0.5 + 32)) AS BIGINT) AS bottom FROM m""")
def review_bounds(spark, sf):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    point = lambda u, v: F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))
    df = W.table(spark, sf, "orders").select(
        "o_orderkey", F.array(point(c % 300, (k * 7) % 200), point(300 - c % 290, k % 250)).alias("coords"),
        F.lit(384).alias("display_width"), F.lit(256).alias("display_height"))
    return P.review_bounds(df).select("o_orderkey", *[F.col(n).cast("long").alias(n) for n in ("left", "top", "right", "bottom")])


W.SQL["frames"] = """SELECT s_nationkey AS capture_id, CASE WHEN s_suppkey % 7 = 0 THEN 'f' || CAST(s_suppkey AS VARCHAR) ELSE CAST(s_suppkey AS VARCHAR) END AS frame_id FROM supplier"""


def frames(spark, sf):
    """Frame ids, mostly numeric, some textual."""
    k = F.col("s_suppkey")
    return W.table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("capture_id"),
        F.when(k % 7 == 0, F.concat(F.lit("f"), k.cast("string"))).otherwise(k.cast("string")).alias("frame_id"))


_ORDINALS = """, o AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY (CASE WHEN regexp_full_match(frame_id, '[0-9]+') THEN 0 ELSE 1 END),
 TRY_CAST(frame_id AS BIGINT), frame_id) - 1 AS ordinal FROM frames) """


@query(with_views("frames", _ORDINALS + "SELECT capture_id, frame_id, ordinal FROM o"))
def frame_ordinals(spark, sf):
    return P.frame_ordinals(frames(spark, sf)).select("capture_id", "frame_id", "ordinal")


@query(with_views("frames", _ORDINALS + "SELECT capture_id, frame_id, ordinal FROM o WHERE ordinal % 3 = 0"))
def sample_every_nth_frame(spark, sf):
    return P.sample_every_nth_frame(frames(spark, sf), 3).select("capture_id", "frame_id", "ordinal")


@query(with_views("frames", "SELECT capture_id, frame_id FROM frames"))
def frame_order(spark, sf):
    return P.frame_order(frames(spark, sf))


@query(with_views("px", "SELECT capture_id, frame_id, v, u, depth_mm, confidence FROM px"))
def union_clouds(spark, sf):
    """One cloud per confidence class put back together."""
    px = W.px(spark, sf)
    return P.union_clouds(px.where("confidence = 255"), px.where("confidence = 128"), px.where("confidence = 0"))
