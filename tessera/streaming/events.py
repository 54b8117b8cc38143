"""Event-bus checks. The functions take batch or streaming DataFrames; those with state name the batch form that says what they mean."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQueryListener

from ..functions.paths import micros


def match_events(events: DataFrame, event_type: str, fields: dict[str, str] | None = None, expected: int | None = None) -> DataFrame:
    """How many events match a type (a trailing ``*`` matches any ending) and fields of the JSON value, and whether that is as expected (1 or more)."""
    kind = F.col("event_type").startswith(event_type[:-1]) if event_type.endswith("*") else F.col("event_type") == event_type
    ok = kind
    for path, value in (fields or {}).items():
        ok = ok & F.get_json_object("value", f"$.{path}").eqNullSafe(F.lit(value))
    out = events.agg(F.count_if(ok).alias("matched"), F.count("*").alias("total"))
    return out.withColumn("passed", F.col("matched") == expected if expected is not None else F.col("matched") >= 1)


def dedup_events(events: DataFrame, window_s: int = 86_400, key: str = "idempotency_id", late: str = "1 hour") -> DataFrame:
    """Streaming: the events that ``dedup_events_batch`` calls unique. The state is the latest time of each key, kept for the window; an event that comes
    after a later one of its key counts as its duplicate."""
    schema, cols = events.schema, events.columns

    def step(_: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["_us", "msg_offset"])
        before = rows["_us"].shift(1)
        if state.exists:
            before = before.fillna(state.get[0]).clip(lower=state.get[0])
        last = int(max(rows["_us"].max(), state.get[0] if state.exists else rows["_us"].max()))
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + window_s * 1000, state.getCurrentWatermarkMs()) + 1)
        yield rows.loc[~(rows["_us"] - before <= window_s * 1_000_000), cols]

    rows = events.withWatermark("ts", late).withColumn("_us", micros(F.col("ts")))
    return rows.groupBy(key).applyInPandasWithState(step, schema, "last long", "append", "EventTimeTimeout")


def dedup_events_batch(events: DataFrame, window_s: int = 86_400, key: str = "idempotency_id") -> DataFrame:
    """Batch form: an event is a duplicate if the one before it of its key is no older than the window."""
    w = Window.partitionBy(key).orderBy("ts", "msg_offset")
    gap = micros(F.col("ts")) - F.lag(micros(F.col("ts"))).over(w)
    return events.withColumn("state", F.when(gap <= window_s * 1_000_000, "duplicate").otherwise("unique"))


def check_keys(events: DataFrame, wanted: DataFrame, key: str = "idempotency_id") -> DataFrame:
    """wanted(key) to whether events hold it: ``not_found``, ``unique`` or ``duplicate`` (more than once)."""
    n = events.join(wanted.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count("*").alias("_n"))
    state = F.when(F.col("_n").isNull(), "not_found").when(F.col("_n") > 1, "duplicate").otherwise("unique")
    return wanted.select(key).distinct().join(n, key, "left").select(key, state.alias("state"))


def validate_events(events: DataFrame, required: dict[str, str], minimum: dict[str, float] | None = None, enum: list[str] | None = None, min_length: dict[str, int] | None = None) -> DataFrame:
    """events with an error code (null if valid): invalid JSON, a missing field, a wrong type (``number``, ``string``), below a minimum or a least length, an
    unknown event type."""
    parsed = F.expr("try_parse_json(value)").isNotNull()
    error = F.when(F.col("value").isNull() | ~parsed, "INVALID_JSON")
    for name, kind in required.items():
        v = F.get_json_object("value", f"$.{name}")
        error = error.when(v.isNull(), f"MISSING_{name.upper()}")
        if kind == "number":
            error = error.when(~v.rlike(r"^-?[0-9]+(\.[0-9]+)?$"), f"TYPE_{name.upper()}")
        if kind == "string":
            error = error.when(F.expr(f"schema_of_variant(try_variant_get(try_parse_json(value), '$.{name}', 'variant'))") != "STRING", f"TYPE_{name.upper()}")
    for name, least in (minimum or {}).items():
        error = error.when(F.expr(f"try_cast(get_json_object(value, '$.{name}') AS double)") < least, f"MINIMUM_{name.upper()}")
    for name, least in (min_length or {}).items():
        error = error.when(F.length(F.get_json_object("value", f"$.{name}")) < least, f"MINLENGTH_{name.upper()}")
    if enum:
        error = error.when(~F.col("event_type").isin(*enum), "UNKNOWN_TYPE")
    return events.withColumn("error_code", error)


def route_events(checked: DataFrame, retries: Column, cap: int = 3) -> DataFrame:
    """Where a checked event goes: ok, dead letters, or another try while it failed for a transient reason less than cap times."""
    transient = F.col("error_code").isin("TIMEOUT", "UNAVAILABLE")
    return checked.withColumn("route", F.when(F.col("error_code").isNull(), "ok").when(transient & (retries < cap), "retry").otherwise("dlq"))


def write_batch(checked: DataFrame, batch_id: int, ok_path: str, dlq_path: str) -> None:
    """Valid events and dead letters of one micro-batch, each to the batch's own folder, which a batch that comes again overwrites."""
    checked.persist()
    checked.filter("error_code IS NULL").drop("error_code").write.mode("overwrite").parquet(f"{ok_path}/batch={batch_id}")
    checked.filter("error_code IS NOT NULL").write.mode("overwrite").parquet(f"{dlq_path}/batch={batch_id}")
    checked.unpersist()


def write_checked(checked: DataFrame, ok_path: str, dlq_path: str, checkpoint: str):
    """Streaming sink: valid events and dead letters to their folders, per micro-batch; a replayed batch replaces itself."""
    sink = lambda batch, batch_id: write_batch(batch, batch_id, ok_path, dlq_path)
    return checked.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dlq_depth(dlq: DataFrame, alert: int = 100, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Dead letters per topic and hour, and whether that many call for an alert."""
    rows = dlq.withWatermark("ts", late) if dlq.isStreaming else dlq
    out = rows.groupBy("topic", F.window("ts", window).alias("w")).agg(F.count("*").alias("depth"))
    return out.select("topic", F.col("w.start").alias("start"), "depth", (F.col("depth") > alert).alias("alert"))


def order_violations(events: DataFrame, key: str = "idempotency_id") -> DataFrame:
    """Batch: events of a key whose time goes back in offset order."""
    w = Window.partitionBy(key).orderBy("msg_offset")
    return events.withColumn("_last", F.max("ts").over(w.rowsBetween(Window.unboundedPreceding, -1))).filter("ts < _last").drop("_last")


def order_violations_stream(events: DataFrame, key: str = "idempotency_id", late: str = "7 days") -> DataFrame:
    """Streaming: the same among events no later than ``late``, with the latest time of each key as state. The state falls once the watermark has passed
    that time: what would lie before it is then too late to be read at all. A trigger's rows of one key are compared in one array operation."""
    out = T.StructType([T.StructField(key, T.StringType()), T.StructField("msg_offset", T.LongType())])

    def step(k: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values("msg_offset", kind="stable")
        us = np.concatenate([[state.get[0] if state.exists else np.iinfo(np.int64).min], rows["us"].to_numpy(np.int64)])
        latest = np.maximum.accumulate(us)
        state.update((int(latest[-1]),))
        state.setTimeoutTimestamp(max(int(latest[-1]) // 1000, state.getCurrentWatermarkMs()) + 1)
        bad = rows["msg_offset"].to_numpy()[us[1:] < latest[:-1]]
        yield pd.DataFrame({key: [k[0]] * len(bad), "msg_offset": bad})

    rows = events.withWatermark("ts", late).select(key, "msg_offset", "ts", micros(F.col("ts")).alias("us"))
    return rows.groupBy(key).applyInPandasWithState(step, out, "last long", "append", "EventTimeTimeout")


def partition_skew(events: DataFrame, window: str = "1 day", spread: int = 100_000) -> DataFrame:
    """Events per partition and window, the spread between the fullest and the emptiest, and whether it is too wide."""
    per = events.groupBy("topic", F.window("ts", window)["start"].alias("start"), "part_no").agg(F.count("*").alias("n"))
    out = per.groupBy("topic", "start").agg(F.sum("n").alias("n"), (F.max("n") - F.min("n")).alias("spread"))
    return out.withColumn("skewed", F.col("spread") > spread)


def consumer_lag(events: DataFrame, committed: DataFrame, alert: float = 0.5) -> DataFrame:
    """High-water mark less committed offset of each partition; an alert when more than half is unread."""
    high = events.groupBy("topic", "part_no").agg((F.max("msg_offset") + 1).alias("high"), F.min("msg_offset").alias("low"))
    out = high.join(committed, ["topic", "part_no"], "left").withColumn("lag", F.col("high") - F.coalesce("committed", "low"))
    return out.select("topic", "part_no", "lag", (F.col("lag") > alert * (F.col("high") - F.col("low"))).alias("alert"))


class _Progress(StreamingQueryListener):
    """Input rows of each run, over all of its progress reports."""

    def __init__(self) -> None:
        self.rows: Counter[str] = Counter()
        self.ended: set[str] = set()
        self.news = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.rows[str(event.progress.runId)] += event.progress.numInputRows

    def onQueryTerminated(self, event) -> None:
        with self.news:
            self.ended.add(str(event.runId))
            self.news.notify_all()

    def total(self, run: str, seconds: float = 60.0) -> int:
        with self.news:
            if not self.news.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"no end of streaming run {run} was reported")
        return self.rows[run]


def incremental_consume(spark: SparkSession, source: str, schema: T.StructType, sink: str, checkpoint: str) -> int:
    """Each run appends to the sink only what came since the last one's committed offset; returns how many rows that was."""
    progress = _Progress()
    spark.streams.addListener(progress)
    try:
        query = spark.readStream.schema(schema).parquet(source).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return progress.total(str(query.runId))
    finally:
        spark.streams.removeListener(progress)
