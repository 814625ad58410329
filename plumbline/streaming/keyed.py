"""Streaming jobs that keep state by key: frames as they fill up, and first contents of components.

Both keep their state in Spark's state store, so a batch looks up its own keys and nothing else, and a
restart goes on from the checkpoint. A few keys share an entry (a shelf, by their hash), since every look-up
is a message between Python and Spark; columns of keys must be plain values (no arrays or structs).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from plumbline.operators.integrity import RAW_COMPONENTS

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed_state(spark: SparkSession) -> None:
    """State by key with timers needs the RocksDB store; queries started from here on use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def _ms(span: timedelta) -> int:
    return int(span.total_seconds() * 1000)


def _shelf(columns: Sequence[str], shelves: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(shelves)).alias("__shelf")


def _getter(row: Row, columns: Sequence[str]) -> Callable[[Row], tuple]:
    at = [row.__fields__.index(c) for c in columns]
    return lambda r: tuple(r[k] for k in at)


class FrameState(StatefulProcessor):
    """The frames of a shelf in one arrival window: which components came, and whether the frame was reported."""

    def __init__(self, required: Sequence[str], window_ms: int, late_ms: int, frame: T.StructType, columns: Sequence[str]) -> None:
        self.required, self.window_ms, self.late_ms = list(required), window_ms, late_ms
        self.frame, self.out = frame, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        one = T.StructType([*self.frame.fields, T.StructField("__arrivals", T.LongType()), T.StructField("__seen", T.LongType()), T.StructField("__reported", T.BooleanType())])
        # ``waiting``: a timer for the report of frames that are not complete is set
        self.state = handle.getValueState("frames", T.StructType([T.StructField("waiting", T.BooleanType()), T.StructField("frames", T.ArrayType(one))]))

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held, end = self.state.get(), key[-1] + self.window_ms
        waiting, frames = (False, {}) if held is None else (held[0], {tuple(f[:-3]): list(f[-3:]) for f in held[1]})
        late, touched, of = {f for f, (_, _, reported) in frames.items() if reported}, {}, None
        for row in rows:
            of = of or _getter(row, self.frame.names)
            frame = of(row)
            if frame in late:
                yield self.out(*frame, key[-1], "late", row.component, row.ts, None, None, None)
                continue
            state = touched[frame] = frames.setdefault(frame, [0, 0, False])
            state[0] += 1
            if row.component in self.required:
                state[1] |= 1 << self.required.index(row.component)
        for frame, state in touched.items():
            if state[1] == (1 << len(self.required)) - 1:
                state[2] = True
                yield self._frame(frame, key, state)
        if held is None:
            self.handle.registerTimer(end)
        if self.late_ms and not waiting and not all(reported for _, _, reported in frames.values()):
            self.handle.registerTimer(end - self.late_ms)
            waiting = True
        self._keep(waiting, frames)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:
        held = self.state.get()
        if held is None:
            return
        frames = {tuple(f[:-3]): list(f[-3:]) for f in held[1]}
        for frame, state in frames.items():
            if not state[2]:
                state[2] = True
                yield self._frame(frame, key, state)
        if expiredTimerInfo.getExpiryTimeInMs() >= key[-1] + self.window_ms:
            self.state.clear()  # Spark lets no row of this window through any more
        else:
            self._keep(False, frames)

    def _keep(self, waiting: bool, frames: dict) -> None:
        self.state.update((waiting, [(*frame, *state) for frame, state in frames.items()]))

    def _frame(self, frame: tuple, key: Any, state: list) -> Row:
        missing = [c for k, c in enumerate(self.required) if not state[1] >> k & 1]
        return self.out(*frame, key[-1], "frame", None, None, state[0], not missing, ",".join(missing))


def stream_frames(arrivals: DataFrame, window: timedelta = timedelta(days=7), delay: timedelta = timedelta(days=1),
                  late_for: timedelta = timedelta(days=7), required: Sequence[str] = RAW_COMPONENTS,
                  frame: Sequence[str] = ("capture_id", "frame_id"), shelves: int = 1 << 13) -> DataFrame:
    """Frames as soon as their last component arrives, the others at a timer, and pieces that come after.

    ``arrivals(*frame, component, ts)``; a frame counts per arrival window of ``ts``. Returns ``*frame, window_ms, kind, component, ts,
    arrivals, complete, missing``. Kind ``frame`` comes once per frame: in the batch that completes it, else once the latest
    time seen is ``delay`` past the window's end. Kind ``late`` is a piece in a later batch than its frame's report. State is three numbers a
    frame; it is dropped ``delay + late_for`` after the window, and pieces later than that are dropped by Spark's watermark and counted
    in the query's progress (``numRowsDroppedByWatermark``). A frame first met after its timer is reported at once.
    The frames of a window share ``shelves`` state entries by their hash. Rows without a ``ts`` belong to no window and are left out. Components that are not required count as arrivals only.
    """
    keyed_state(arrivals.sparkSession)
    frame, span = list(frame), _ms(window)
    start = (F.floor(F.unix_millis("ts") / span) * span).cast("long").alias("window_ms")
    rows = (arrivals.where(F.col("ts").isNotNull()).withWatermark("ts", f"{_ms(delay) + _ms(late_for)} milliseconds")
            .select(*frame, "component", "ts", start, _shelf(frame, shelves)))
    fields = [rows.schema[c] for c in (*frame, "window_ms")]
    out = T.StructType([*(T.StructField(f.name, f.dataType) for f in fields), T.StructField("kind", T.StringType()), T.StructField("component", T.StringType()),
                        T.StructField("ts", T.TimestampType()), T.StructField("arrivals", T.LongType()), T.StructField("complete", T.BooleanType()),
                        T.StructField("missing", T.StringType())])
    held = T.StructType([T.StructField(f.name, f.dataType) for f in fields[:-1]])
    return rows.groupBy("__shelf", "window_ms").transformWithState(FrameState(required, span, _ms(late_for), held, out.names), out, "append", "EventTime")


class FirstContent(StatefulProcessor):
    """The first contents of the components of a shelf; every other content of them is refused."""

    def __init__(self, keys: T.StructType, columns: Sequence[str]) -> None:
        self.keys, self.out = keys, Row(*columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        one = T.StructType([*self.keys.fields, T.StructField("__sha256", T.StringType())])
        self.state = handle.getValueState("kept", T.StructType([T.StructField("kept", T.ArrayType(one))]))

    def handleInitialState(self, key: Any, initialState: Row, timerValues: Any) -> None:
        self.state.update(([tuple(k[c] for c in (*self.keys.names, "sha256")) for k in initialState.kept],))  # Arrow hands structs over as dicts

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        contents: dict = {}  # distinct contents of each component in this batch, each with its first time
        of = None
        for row in rows:
            of = of or _getter(row, self.keys.names)
            mine, at = contents.setdefault(of(row), {}), (row.ts is not None, row.ts)
            if row.sha256 not in mine or at < mine[row.sha256]:
                mine[row.sha256] = at
        held = self.state.get()
        kept = {} if held is None else {tuple(k[:-1]): k[-1] for k in held[0]}
        fresh = [component for component in contents if component not in kept]
        for component in fresh:
            mine = contents[component]
            kept[component] = min(mine, key=lambda c: (mine[c], c is not None, c))
        if fresh:
            self.state.update(([(*component, content) for component, content in kept.items()],))
        fresh = set(fresh)
        for component, mine in contents.items():
            first = kept[component]
            for content, (_, ts) in mine.items():
                if content != first:
                    yield self.out(*component, content, ts, first, False)
                elif component in fresh:
                    yield self.out(*component, content, ts, first, True)


def stream_first_contents(arrivals: DataFrame, table_path: str, checkpoint: str, available_now: bool = True,
                          keys: Sequence[str] = ("capture_id", "component", "frame_id"), shelves: int = 1 << 18) -> StreamingQuery:
    """Accepted and rejected components as tables, with accepted contents in the state store.

    ``arrivals`` is a stream with ``keys``, ``sha256`` and ``ts``. The earliest content of a key goes to ``accepted``; unchanged repeats are absorbed; other
    contents go to ``rejected`` with ``kept_sha256``. Components share ``shelves`` state entries by their hash. A batch reads its own rows and the state of its own keys, never what was
    written. Folders are named by the stream's own id and the batch, so a replay overwrites itself. A stream on a fresh checkpoint
    takes what earlier streams accepted in this table as its initial state, once.
    """
    spark, keys = arrivals.sparkSession, list(keys)
    keyed_state(spark)
    rows = arrivals.select(*keys, "sha256", "ts", _shelf(keys, shelves))
    key_fields = [T.StructField(k, rows.schema[k].dataType) for k in keys]
    accepted = T.StructType([*key_fields, T.StructField("sha256", T.StringType()), T.StructField("ts", T.TimestampType())])
    spark.createDataFrame([], accepted).write.mode("overwrite").parquet(f"{table_path}/accepted/run=none/batch=-1")
    known = spark.read.schema(T.StructType([*accepted.fields, T.StructField("run", T.StringType()), T.StructField("batch", T.LongType())])).parquet(f"{table_path}/accepted")
    own = _stream_id(spark, checkpoint)
    if own is not None:  # a first batch that is replayed must not find its own rows
        known = known.where(F.col("run") != own)
    known = known.groupBy(*keys).agg(F.min_by("sha256", F.struct("ts", "sha256")).alias("sha256"))
    known = known.groupBy(_shelf(keys, shelves)).agg(F.collect_list(F.struct(*keys, "sha256")).alias("kept"))
    out = T.StructType([*accepted.fields, T.StructField("kept_sha256", T.StringType()), T.StructField("accepted", T.BooleanType())])
    judged = rows.groupBy("__shelf").transformWithState(FirstContent(T.StructType(key_fields), out.names), out, "append", "None", initialState=known.groupBy("__shelf"))

    def write(batch: DataFrame, batch_id: int) -> None:
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.persist()
        batch.where("accepted").select(*keys, "sha256", "ts").write.mode("overwrite").parquet(f"{table_path}/accepted/run={run}/batch={batch_id}")
        batch.where("NOT accepted").select(*keys, "sha256", "ts", "kept_sha256").write.mode("overwrite").parquet(f"{table_path}/rejected/run={run}/batch={batch_id}")
        batch.unpersist()

    writer = judged.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def _stream_id(spark: SparkSession, checkpoint: str) -> str | None:
    """The id of the stream that the checkpoint belongs to, if there is one."""
    try:
        row = spark.read.schema("id string").json(f"{checkpoint}/metadata").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return row["id"] if row else None
