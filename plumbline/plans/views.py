"""Scan-shaped views over the driver's tables, for Spark and for the check SQL.

Each view exists twice: a DataFrame function and a named SQL subquery in ``SQL``.
``with_views`` puts the subqueries a check needs in front of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

DEPTH_SIZE = (192, 128)
RGB_SIZE = (384, 256)
TILE_SIZE = (24, 16)

SQL: dict[str, str] = {}


def with_views(names: str, body: str, recursive: bool = False) -> str:
    """``WITH <views> <body>``; a body that starts its own CTEs begins with a comma."""
    parts = ",\n".join(f"{n} AS ({SQL[n]})" for n in names.split())
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}\n{body}"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _pixels(spark: SparkSession, sf: str, width: int, height: int) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.col("l_returnflag").alias("capture_id"),
            F.col("l_suppkey").alias("frame_id"),
            (F.col("l_orderkey") % height).alias("v"),
            (F.col("l_partkey") % width).alias("u"),
        )
        .agg(
            F.max(F.when(F.col("l_quantity") == 1, 0).otherwise(F.floor(F.col("l_extendedprice") / 13))).alias("depth_mm"),
            F.max(F.when(F.col("l_linestatus") == "F", 255).when(F.col("l_discount") < 0.03, 128).otherwise(0)).alias("confidence"),
        )
    )


_PIXEL_SQL = """SELECT l_returnflag AS capture_id, l_suppkey AS frame_id, l_orderkey % {h} AS v, l_partkey % {w} AS u,
 max(CASE WHEN l_quantity = 1 THEN 0 ELSE CAST(floor(l_extendedprice / 13) AS BIGINT) END) AS depth_mm,
 max(CASE WHEN l_linestatus = 'F' THEN 255 WHEN l_discount < 0.03 THEN 128 ELSE 0 END) AS confidence
 FROM lineitem GROUP BY l_returnflag, l_suppkey, l_orderkey % {h}, l_partkey % {w}"""


def px(spark: SparkSession, sf: str) -> DataFrame:
    """Depth pixels of 192x128 frames."""
    return _pixels(spark, sf, *DEPTH_SIZE)


SQL["px"] = _PIXEL_SQL.format(w=DEPTH_SIZE[0], h=DEPTH_SIZE[1])


def tile(spark: SparkSession, sf: str) -> DataFrame:
    """The same pixels on small 24x16 frames, used where whole images are coded."""
    return _pixels(spark, sf, *TILE_SIZE)


SQL["tile"] = _PIXEL_SQL.format(w=TILE_SIZE[0], h=TILE_SIZE[1])


def cam(spark: SparkSession, sf: str) -> DataFrame:
    """One camera per frame id with an exact-rational yaw."""
    k = F.col("s_suppkey") % 4
    c = F.when(k == 0, 1.0).when(k == 1, 0.6).when(k == 2, 0.8).otherwise(0.0)
    s = F.when(k == 0, 0.0).when(k == 1, 0.8).when(k == 2, 0.6).otherwise(1.0)
    zero, one = F.lit(0.0), F.lit(1.0)
    pose = F.array(
        c, zero, s, F.col("s_acctbal") / 1000,
        zero, one, zero, F.lit(1.5),
        -s, zero, c, F.col("s_suppkey") / F.lit(10.0),
        zero, zero, zero, one,
    )
    return table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("frame_id"),
        F.lit(RGB_SIZE[0]).alias("width"), F.lit(RGB_SIZE[1]).alias("height"),
        (F.lit(300.0) + F.col("s_nationkey")).alias("fx"), F.lit(300.0).alias("fy"),
        F.lit(192.0).alias("cx"), F.lit(128.0).alias("cy"), pose.alias("pose"),
    )


SQL["cam"] = """SELECT s_suppkey AS frame_id, 384 AS width, 256 AS height,
 CAST(300 + s_nationkey AS DOUBLE) AS fx, CAST(300 AS DOUBLE) AS fy, CAST(192 AS DOUBLE) AS cx, CAST(128 AS DOUBLE) AS cy,
 CAST(CASE s_suppkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 0.6 WHEN 2 THEN 0.8 ELSE 0 END AS DOUBLE) AS c,
 CAST(CASE s_suppkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 0.8 WHEN 2 THEN 0.6 ELSE 1 END AS DOUBLE) AS s,
 s_acctbal / 1000 AS tx, CAST(1.5 AS DOUBLE) AS ty, s_suppkey / CAST(10 AS DOUBLE) AS tz
 FROM supplier"""

# eligible pixels in the world, the input of most geometry checks
SQL["pts"] = """SELECT p.capture_id, p.frame_id, p.v, p.u, p.depth_mm, p.confidence,
 c.c * lx + c.s * lz + c.tx AS x, ly + c.ty AS y, -c.s * lx + c.c * lz + c.tz AS z
 FROM (SELECT px.*, (u - 96.0) * (depth_mm / 1000.0) / (cam.fx / 2) AS lx,
  -(v - 64.0) * (depth_mm / 1000.0) / 150.0 AS ly, -(depth_mm / 1000.0) AS lz
  FROM px JOIN cam USING (frame_id) WHERE confidence = 255 AND depth_mm > 0 AND depth_mm <= 5000) p
 JOIN cam c USING (frame_id)"""


def pts(spark: SparkSession, sf: str) -> DataFrame:
    from plumbline.operators.pixels import eligible_pixels, unproject

    return unproject(eligible_pixels(px(spark, sf)), cam(spark, sf), DEPTH_SIZE, ["frame_id"])


def components(spark: SparkSession, sf: str) -> DataFrame:
    """Component arrivals: user = capture, week = frame, event type = component."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("capture_id"),
        F.floor(epoch_seconds("ts") / 604800).alias("frame_id"),
        component_name(F.col("event_type")).alias("component"),
        F.col("ts"), F.col("event_id"),
    )


def epoch_seconds(column: str) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session time zone."""
    return F.expr(f"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', CAST({column} AS TIMESTAMP_NTZ))")


# fixed values: how the driver's event types stand for components
COMPONENT_OF_EVENT = {
    "click": "rgb", "view": "raw_camera", "purchase": "raw_depth", "signup": "raw_confidence", "error": "corrected_camera",
}


def component_name(event_type: Column) -> Column:
    out = F.lit("other")
    for event, component in COMPONENT_OF_EVENT.items():
        out = F.when(event_type == event, component).otherwise(out)
    return out


SQL["components"] = (
    "SELECT user_id AS capture_id, CAST(floor(epoch(ts) / 604800) AS BIGINT) AS frame_id, CASE event_type "
    + " ".join(f"WHEN '{e}' THEN '{c}'" for e, c in COMPONENT_OF_EVENT.items())
    + " ELSE 'other' END AS component, ts, event_id FROM events"
)
