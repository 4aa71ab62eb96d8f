"""Incremental forms of the batch operators on Structured Streaming; each equals its batch form on the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..shipping import ship
from ..operators.chunking import chunk_rows


def table_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet files as a stream."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def signal_windows(events: DataFrame, window: str = "1 day", slide: str | None = None, late: str = "2 days") -> DataFrame:
    """Rolled-up signals (ts, event_type, value) for each window; a stream drops what comes later than ``late``."""
    ts = F.col("ts").cast("timestamp")
    rows = events.withColumn("ts", ts)
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return rows.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


def sessions(events: DataFrame, gap: str = "6 hours", late: str = "2 days") -> DataFrame:
    """Sessions of each user: events closer than ``gap`` belong together."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    rows = rows.withWatermark("ts", late) if events.isStreaming else rows
    s = rows.groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n"))
    return s.select("user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def fresh_captures(rows: DataFrame, time_col: str, late: str = "2 days") -> DataFrame:
    """Rows whose content hash hasn't come within the watermark; in batch, one row for each hash."""
    keyed = rows.withColumn("content_hash", F.sha2(T.text_or_empty("text"), 256))
    if rows.isStreaming:
        return keyed.withWatermark(time_col, late).dropDuplicatesWithinWatermark(["content_hash"])
    return keyed.dropDuplicates(["content_hash"])


def index_documents(stream: DataFrame, index_path: str, checkpoint: str, target: int = 1800) -> Callable[[], None]:
    """Chunk new documents (doc_id, text, strategy) into ``index_path`` until the stream's input is used up.

    Each batch writes its own folder and replaces it when it is repeated, so a restart neither loses nor
    doubles chunks.
    """

    def write(batch: DataFrame, number: int) -> None:
        rows = chunk_rows(batch, target)
        rows.write.mode("overwrite").parquet(f"{index_path}/batch={number}")

    def run() -> None:
        query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    return run


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Run a stream over what is there and write its rows as Parquet (append) or keep the last state (complete)."""
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    else:
        keep = lambda batch, _: batch.write.mode("overwrite").parquet(path)
        query = stream.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()


def freshness_alerts(captures: DataFrame, window_days: int = 30, late: str = "1 hour") -> DataFrame:
    """(source_id, last, status) whenever a source is captured (fresh) or its window passes without (stale).

    ``captures`` is a stream of (source_id, ts). One timestamp of state is kept for each source; a timer in event
    time fires when the watermark passes the window's end.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    import pandas as pd

    def update(key: tuple, batches, state: GroupState):
        if state.hasTimedOut:
            (last,) = state.get
            state.remove()
            yield pd.DataFrame({"source_id": [key[0]], "last": [pd.Timestamp(last, unit="ms")], "status": ["stale"]})
            return
        last = state.get[0] if state.exists else 0
        for pdf in batches:
            last = max(last, int(pdf["ts"].max().timestamp() * 1000))
        state.update((last,))
        due = last + window_days * 86_400_000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"source_id": [key[0]], "last": [pd.Timestamp(last, unit="ms")], "status": ["fresh"]})

    rows = captures.select("source_id", F.col("ts").cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("source_id").applyInPandasWithState(
        update, "source_id string, last timestamp, status string", "last long", "append", GroupStateTimeout.EventTimeTimeout
    )


ship(__name__)
