"""Incremental intake and frame completeness as Structured Streaming jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from plumbline.operators.integrity import RAW_COMPONENTS


def stream_intake(arrivals: DataFrame, table_path: str, checkpoint: str, available_now: bool = True,
                  keys: Sequence[str] = ("capture_id", "component", "frame_id"), buckets: int = 64) -> StreamingQuery:
    """Append new components; content that changed under a known key goes to ``rejected``.

    ``arrivals`` is a stream with ``keys`` and ``sha256``.  Unchanged repeats are
    dropped.  Folders are named by the stream's own id, which lives in its checkpoint,
    and the batch: a replayed batch overwrites its own folder, so results are exactly
    once, and a stream begun on a fresh checkpoint overwrites nothing and still knows
    what earlier ones accepted.  Accepted rows are kept by key bucket; a batch reads
    the buckets of its own keys only.
    """
    keys = list(keys)
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int").alias("bucket")

    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        # one row per key and content: exact repeats inside the batch collapse first
        distinct = batch.groupBy(*keys, "sha256").agg(F.min("ts").alias("ts")).persist()
        touched = [r["bucket"] for r in distinct.select(bucket).distinct().collect()]  # at most ``buckets`` numbers
        first = distinct.groupBy(*keys).agg(F.min(F.struct("ts", "sha256")).alias("f"))
        known = spark.read.schema(f"{_ddl(batch, keys)}, sha256 string, run string, batch long, bucket int").parquet(f"{table_path}/accepted")
        known = known.where(F.col("bucket").isin(touched) & ((F.col("run") != run) | (F.col("batch") < batch_id))).select(*keys, F.col("sha256").alias("known_sha256"))
        judged = distinct.join(first.select(*keys, F.col("f.sha256").alias("first_sha256")), keys).join(known, keys, "left").persist()
        reference = F.coalesce("known_sha256", "first_sha256")
        fresh = judged.where(F.col("known_sha256").isNull() & (F.col("sha256") == F.col("first_sha256"))).select(*keys, "sha256", "ts", bucket)
        changed = judged.where(F.col("sha256") != reference).select(*keys, "sha256", "ts", reference.alias("kept_sha256"))
        fresh.write.mode("overwrite").partitionBy("bucket").parquet(f"{table_path}/accepted/run={run}/batch={batch_id}")
        changed.write.mode("overwrite").parquet(f"{table_path}/rejected/run={run}/batch={batch_id}")
        judged.unpersist()
        distinct.unpersist()

    _ensure(arrivals, f"{table_path}/accepted/run=none/batch=-1/bucket=-1", f"{_ddl(arrivals, keys)}, sha256 string, ts timestamp")
    writer = arrivals.select(*keys, "sha256", "ts").writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _ddl(df: DataFrame, keys: Sequence[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _ensure(df: DataFrame, path: str, schema: str) -> None:
    """An empty table of the schema, so the first batch has something to read."""
    df.sparkSession.createDataFrame([], schema).write.mode("overwrite").parquet(path)


def stream_frame_completeness(arrivals: DataFrame, window: str = "7 days", delay: str = "1 day", required: Sequence[str] = RAW_COMPONENTS,
                              frame: Sequence[str] = ("capture_id", "frame_id")) -> DataFrame:
    """Per frame and arrival window: which components came and whether all did.

    Windows are emitted once the watermark passes, complete or not, so frames that
    never fill up are reported too.  State per frame is one flag per component.  Rows
    that come after their window was emitted are in :func:`stream_late_arrivals`.
    """
    flags = [F.max(F.when(F.col("component") == c, 1).otherwise(0)).alias(c) for c in required]
    grouped = arrivals.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), *frame).agg(F.count("*").alias("arrivals"), *flags)
    complete = F.lit(True)
    for c in required:
        complete = complete & (F.col(c) == 1)
    missing = F.array_join(F.array_compact(F.array(*[F.when(F.col(c) == 0, c) for c in required])), ",")
    return grouped.select(*frame, F.col("w.start").alias("window_start"), "arrivals", complete.alias("complete"), missing.alias("missing"))


def stream_late_arrivals(arrivals: DataFrame, table_path: str, checkpoint: str, window: str = "7 days", delay: str = "1 day",
                         available_now: bool = True) -> StreamingQuery:
    """The side table of completeness: rows whose window the watermark had passed when their batch began.

    The watermark of a batch is the latest time in earlier batches less ``delay``. Each batch
    writes its own latest time and its late rows under the stream's id, so a replay writes the same.
    """
    def absorb(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        run = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        times = spark.read.schema("latest timestamp, run string, batch long").parquet(f"{table_path}/times")
        passed = times.where((F.col("run") == run) & (F.col("batch") < batch_id)).agg((F.max("latest") - F.expr(f"INTERVAL {delay}")).alias("passed"))
        ends = batch.withColumn("__end", F.window("ts", window)["end"])
        late = ends.crossJoin(F.broadcast(passed)).where(F.col("__end") <= F.col("passed")).drop("__end", "passed")  # one row on the right
        late.write.mode("overwrite").parquet(f"{table_path}/late/run={run}/batch={batch_id}")
        batch.agg(F.max("ts").alias("latest")).where("latest IS NOT NULL").write.mode("overwrite").parquet(f"{table_path}/times/run={run}/batch={batch_id}")

    _ensure(arrivals, f"{table_path}/times/run=none/batch=-1", "latest timestamp")
    _ensure(arrivals, f"{table_path}/late/run=none/batch=-1", ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in arrivals.schema))
    writer = arrivals.writeStream.foreachBatch(absorb).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
