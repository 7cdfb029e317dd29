"""Arriving data.  Every stream has a batch twin and gives the same rows once its input is used up.

Results go to a table; aggregates are written per micro-batch under the batch
number, which makes a repeated batch overwrite itself, and the newest value of a
key counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import DEFAULT, Settings
from ..operators import dedup, scan
from ..session import checkpoint_dir


def read_table(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A Parquet folder (or one file) as a stream; the schema is taken from the files that are there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory():
        folder, name = path.rsplit("/", 1)
        reader, path = reader.option("pathGlobFilter", name), folder
    df = reader.parquet(path)
    naive = [f.name for f in df.schema.fields if f.dataType.typeName() == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in naive}) if naive else df


def work_path(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def run_append(stream: DataFrame, path: str) -> DataFrame:
    """Use up the available input, append the output to a table, and return the table."""
    query = (stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", f"{path}/_state")
             .option("path", f"{path}/rows").trigger(availableNow=True).start())
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def run_update(stream: DataFrame, keys: list[str], path: str) -> DataFrame:
    """As ``run_append`` for aggregates in update mode: of each key the row of its last batch."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (stream.writeStream.outputMode("update").option("checkpointLocation", f"{path}/_state")
             .foreachBatch(write).trigger(availableNow=True).start())
    query.awaitTermination()
    rows = stream.sparkSession.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows")
    values = [c for c in rows.columns if c not in (*keys, "_batch")]
    last = F.max_by(F.struct(*values), "_batch").alias("v")
    return rows.groupBy(*keys).agg(last).select(*keys, *[F.col(f"v.{c}").alias(c) for c in values])


def run_ingest(arrivals: DataFrame, path: str, content: Column, keys: tuple[str, ...] = ("case_id", "sha256"),
               order: str = "evidence_id") -> DataFrame:
    """Accept each content once per case: first in the batch, and not in an earlier batch.

    The history is the accepted table itself, so no state grows in memory; a
    repeated batch replaces its own part.
    """
    spark = arrivals.sparkSession
    columns = [*dict.fromkeys([order, *keys])]

    def accept(batch: DataFrame, number: int) -> None:
        hashed = dedup.with_digests(batch, content)
        first = dedup.first_of_group(hashed, list(keys), order)
        if number:
            kept = spark.read.schema(first.select(*columns).schema.add("batch", "long")).parquet(f"{path}/rows")
            first = dedup.not_seen(first, kept.where(F.col("batch") < number), keys)
        first.select(*columns).write.mode("overwrite").parquet(f"{path}/rows/batch={number}")

    query = (arrivals.writeStream.option("checkpointLocation", f"{path}/_state").foreachBatch(accept)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/rows")


def recent_duplicates_dropped(arrivals: DataFrame, at: str, keys: list[str], delay: str) -> DataFrame:
    """Bounded variant: copies that arrive within the delay of each other are dropped."""
    return arrivals.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def latest_status(events: DataFrame, key: list[str], at: str, keep: list[str]) -> DataFrame:
    """Newest state per feed (update mode)."""
    newest = F.max(F.struct(at, *keep)).alias("_l")
    return events.groupBy(*key).agg(newest).select(*key, *[F.col(f"_l.{c}").alias(c) for c in (at, *keep)])


def stuck(latest: DataFrame, now: Column, at: str = "at", minutes: int = 30) -> DataFrame:
    """Feeds whose newest state is PROCESSING for longer than the threshold, failed with a message."""
    late = (F.col("status") == "PROCESSING") & (F.col(at) < now - F.make_dt_interval(mins=F.lit(minutes)))
    return failed(latest.filter(late))


def failed(stuck_feeds: DataFrame) -> DataFrame:
    """The fields of a job that ran out of time at ``stage``: status, message, error details."""
    return stuck_feeds.withColumns({
        "status": F.lit("FAILED"),
        "stage_message": F.concat(F.lit("Job timed out while processing at stage '"), "stage", F.lit("'.")),
        "error_info": F.to_json(F.struct(F.lit("no progress before the time limit").alias("error"),
                                         F.col("stage").alias("stage_at_timeout"),
                                         F.lit("auto_reset_to_failed").alias("cleanup_action")))})


def cleanup_audit(stuck_feeds: DataFrame, key: str) -> DataFrame:
    """One audit row for each job that was failed."""
    return stuck_feeds.select(
        key, F.lit("STUCK_JOB_CLEANUP").alias("action"),
        F.concat(F.lit("Job "), F.col(key).cast("string"), F.lit(" failed: stuck at stage '"), "stage", F.lit("'.")).alias("description"))


def stuck_by_timer(feed: DataFrame, key: str, at: str, order: str, minutes: int = 30, delay: str = "10 minutes") -> DataFrame:
    """key, t (microseconds), stage of every feed whose newest state stays PROCESSING for longer than the threshold.

    A timer on event time stands for each feed: it fires when the watermark (the newest
    time seen less ``delay``) has passed the newest state by ``minutes``, and every newer
    state sets it again.  ``order`` (a long) breaks ties of time.  A feed that ended is
    forgotten when its timer fires, so that state holds the feeds of the last minutes.
    """
    kind = feed.schema[key].dataType.simpleString()

    def step(k: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        newest = tuple(state.get) if state.exists else None
        fires = state.hasTimedOut
        if not fires:
            for b in batches:
                for row in b[["t", "o", "status", "stage"]].itertuples(index=False, name=None):
                    newest = row if newest is None or row[:2] >= newest[:2] else newest
            ends = int(newest[0]) // 1000 + minutes * 60_000
            fires = ends <= state.getCurrentWatermarkMs()
            if not fires:
                state.update((int(newest[0]), int(newest[1]), newest[2], newest[3]))
                state.setTimeoutTimestamp(ends)
                return
        if state.exists:
            state.remove()
        if newest[2] == "PROCESSING":
            yield pd.DataFrame({key: [k[0]], "t": [int(newest[0])], "stage": [newest[3]]})

    rows = feed.withWatermark(at, delay).select(key, at, F.unix_micros(at).alias("t"), F.col(order).cast("long").alias("o"), "status", "stage")
    return rows.groupBy(key).applyInPandasWithState(
        step, f"{key} {kind}, t long, stage string", "t long, o long, status string, stage string", "append", "EventTimeTimeout")


def daily_counts(events: DataFrame, at: str = "ts", delay: str = "1 day") -> DataFrame:
    """Events per day; a day later than the watermark allows is dropped, as the delay says."""
    w = F.window(at, "1 day")
    return (events.withWatermark(at, delay).groupBy(w.alias("w")).agg(F.count("*").alias("n"))
            .select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "n"))


def alert_pairs(alerts: DataFrame, events: DataFrame, settings: Settings = DEFAULT, delay: str = "1 hour") -> DataFrame:
    """Alerts joined to the events of the same entity inside the window, as both streams arrive.

    Watermarks on both sides and the bound on the distance let Spark drop what can
    no longer meet; only alerts are paired, never all events of an entity.
    """
    window = f"INTERVAL {settings.window_seconds} SECONDS"
    a = alerts.select(*[F.col(c).alias(f"a_{c}") for c in alerts.columns]).withWatermark("a_timestamp", delay)
    b = events.select(*[F.col(c).alias(f"b_{c}") for c in events.columns]).withWatermark("b_timestamp", delay)
    return a.join(b, F.expr(
        "a_case_id = b_case_id AND a_entity_value = b_entity_value AND a_id <> b_id "
        f"AND b_timestamp > a_timestamp - {window} AND b_timestamp < a_timestamp + {window}"))


def sessions(events: DataFrame, key: str, at: str, gap: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Gap sessions per key; a session comes out when the watermark has passed its end.

    Sessions are merged inside each task before the shuffle, so that a busy key
    sends sessions and not rows.
    """
    events.sparkSession.conf.set("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
    return (events.withWatermark(at, delay).groupBy(key, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n"))
            .select(key, F.unix_micros("s.start").alias("first_t"), F.unix_micros("s.end").alias("end_t"), "n"))


def sessions_batch(rows: DataFrame, keys: list[str], at: str, gap: int) -> DataFrame:
    """The same sessions of a table (``at`` in microseconds) without one task per key."""
    points = rows.groupBy(*keys, at).agg(F.count("*").alias("n"))
    points = scan.ordered_scan(points, keys, at, {"_prev": ("max", F.col(at))}, "before")
    starts = points.withColumn("_start", F.when(F.col("_prev").isNull() | (F.col(at) - F.col("_prev") >= gap), F.col(at)))
    member = scan.ordered_scan(starts, keys, at, {"first_t": ("max", F.col("_start"))}, "upto")
    return member.groupBy(*keys, "first_t").agg((F.max(at) + gap).alias("end_t"), F.sum("n").alias("n"))
