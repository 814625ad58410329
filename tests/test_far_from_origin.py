"""Rounding of projected points and empty groups, as larger tables bring them."""

from pyspark.sql import functions as F

from plumbline.operators import appearance as A, pixels as P, shapes as S


def test_assembly_without_a_sound_member_is_not_unresolved(spark):
    nan = float("nan")
    rect = spark.createDataFrame([(1, 1, [[nan, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]])], "assembly_id int, id int, controls array<array<double>>")
    frames = spark.createDataFrame([(1, [0.0, 0.0], [1.0, 0.0], True)], "assembly_id int, origin array<double>, u_axis array<double>, fit_orientation boolean")
    assert [r.rule for r in S.check_rectangles(rect, frames).collect()] == ["controls_not_finite"]


def _far_camera(spark):
    pose = [0.6, 0.0, 0.8, 3.1, 0.0, 1.0, 0.0, 1.5, -0.8, 0.0, 0.6, 6000.1, 0.0, 0.0, 0.0, 1.0]
    return spark.createDataFrame([(1, 384, 256, 313.0, 300.0, 192.0, 128.0, pose)],
                                 "frame_id int, width int, height int, fx double, fy double, cx double, cy double, pose array<double>")


def test_points_of_border_pixels_are_visible_far_from_the_origin(spark):
    cams = _far_camera(spark)
    px = spark.range(128).select(F.lit("A").alias("capture_id"), F.lit(1).alias("frame_id"), F.col("id").alias("v"), F.lit(0).alias("u"),
                                 (70 + F.col("id") * 31).alias("depth_mm"), F.lit(255).alias("confidence"))
    seen = P.project_to_camera(P.unproject(px, cams, (192, 128), ["frame_id"]), cams, ["frame_id"])
    assert seen.where("NOT visible").count() == 0


def test_a_difference_of_exactly_the_tolerance_is_accepted(spark):
    cams = _far_camera(spark)
    px = spark.range(1, 128).select(F.lit("A").alias("capture_id"), F.lit(1).alias("frame_id"), F.col("id").alias("v"), F.lit(9).alias("u"),
                                    (F.col("id") * 500).alias("depth_mm"), F.lit(255).alias("confidence"))
    depth = px.withColumn("depth_mm", F.col("depth_mm") + 1500).drop("capture_id")
    out = A.depth_visibility(P.project_to_camera(P.unproject(px, cams, (192, 128), ["frame_id"]), cams, ["frame_id"]),
                             depth, ["frame_id"], (192, 128), (384, 256), tolerance_m=1.5)
    assert out.where("NOT accepted").count() == 0
