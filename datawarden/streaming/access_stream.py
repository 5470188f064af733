"""The access log as a stream: intake, daily counts, Value after events and Value as time goes by.

Every sink writes one folder per micro-batch and replaces it when the batch is repeated, so a
restart neither loses nor doubles rows. Events later than the watermark are dropped; the batch
recompute over the whole log is the correction path.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from datawarden.config import Settings
from datawarden.functions.scalars import utc_day
from datawarden.operators.catalog import trackable
from datawarden.operators.maintenance import recompute_value, score_snapshots
from datawarden.operators.score import value_from_windows
from datawarden.sources.catalog_store import LOGS, CatalogStore


def access_stream(
    spark: SparkSession, folder: str, schema: str, files_per_batch: int | None = None
) -> DataFrame:
    """A folder of parquet files as a stream of access events, oldest files first."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return with_event_time(reader.parquet(folder))


def with_event_time(events: DataFrame) -> DataFrame:
    # A watermark needs TIMESTAMP; zone-less times are UTC.
    return events.withColumn("occurred_at", F.col("occurred_at").cast("timestamp"))


def deduplicated(events: DataFrame, delay: str) -> DataFrame:
    """Repeated event ids within `delay` dropped; state is bounded by the delay."""
    return events.withWatermark("occurred_at", delay).dropDuplicatesWithinWatermark(["event_id"])


def daily_counts(events: DataFrame, delay: str | None = "2 days") -> DataFrame:
    """Running counts per UTC day, dataset and access type.

    Days older than the watermark leave the state, and events for them are dropped. Without a
    `delay` the events must carry a watermark of their own.
    """
    marked = events if delay is None else events.withWatermark("occurred_at", delay)
    return (
        marked.groupBy(F.window("occurred_at", "1 day").alias("w"), "dataset_id", "access_type")
        .agg(F.expr("count(1) AS n"))
        .selectExpr("dataset_id", f"{utc_day('w.start')} AS date", "access_type", "n")
    )


def _start(
    df: DataFrame,
    sink: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str,
    available_now: bool,
    every: str,
) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(sink).outputMode(mode)
    writer = writer.option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return writer.trigger(**trigger).start()


def start_daily_usage(
    events: DataFrame,
    target: str,
    checkpoint: str,
    mode: str = "update",
    available_now: bool = False,
    every: str = "1 minute",
    delay: str | None = "2 days",
    unit: str = "day",
) -> StreamingQuery:
    """Daily counts to `target`, one folder per day (or month, for sparse long histories) and batch that
    changed it.

    A batch merges its keys into the present counts of the days it touches and writes their folders
    anew; of the older ones one is kept for readers that began before. A day behind the watermark
    gets no more counts, so its folder stays as it is: closed days are not written or read again
    by the stream. A repeated batch replaces its own folders.
    """
    if unit not in ("day", "month"):
        raise ValueError("unit must be day or month")
    folder = "date" if unit == "day" else "trunc(date, 'MM')"

    def sink(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        changes = f"{target}-changes"
        batch.withColumn("folder", F.expr(folder)).write.mode("overwrite").parquet(changes)
        changed = spark.read.schema(f"{_DAILY}, folder date").parquet(changes)
        touched = sorted(r["folder"] for r in changed.select("folder").distinct().collect())
        if not touched:
            return
        merged, before = changed, {f: e for f, e in _epochs(spark, target).items() if f in touched}
        last = {f: max(x for x in e if x < batch_id) for f, e in before.items() if min(e) < batch_id}
        if last:
            old = _folders(spark, target, last).drop("epoch")
            merged = changed.unionByName(old.join(changed, ["dataset_id", "date", "access_type"], "left_anti"))
        rows = merged.withColumn("epoch", F.lit(batch_id).cast("bigint")).hint("rebalance", "folder")
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder", "epoch").parquet(target)
        system, path = _file_system(spark, target)
        for f, epochs in before.items():
            for epoch in sorted(e for e in epochs if e < batch_id)[:-1]:
                system.delete(path(f"{target}/folder={f}/epoch={epoch}"), True)

    return _start(daily_counts(events, delay), sink, checkpoint, mode, available_now, every)


_DAILY = "dataset_id string, date date, access_type string, n bigint"


def _file_system(spark: SparkSession, target: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def _epochs(spark: SparkSession, target: str) -> dict[date, list[int]]:
    """The batches that wrote each folder, from one listing of the folders' names."""
    system, path = _file_system(spark, target)
    out: dict[date, list[int]] = {}
    for entry in system.globStatus(path(f"{target}/folder=*/epoch=*")) or []:
        folder, epoch = (x.split("=")[1] for x in entry.getPath().toString().rsplit("/", 2)[1:])
        out.setdefault(date.fromisoformat(folder), []).append(int(epoch))
    return out


def _folders(spark: SparkSession, target: str, epochs: dict[date, int]) -> DataFrame:
    paths = sorted(f"{target}/folder={f}/epoch={e}" for f, e in epochs.items())
    return spark.read.schema(f"{_DAILY}, folder date, epoch bigint").option("basePath", target).parquet(*paths)


def read_daily_usage(spark: SparkSession, target: str) -> DataFrame:
    """The present count per key: the latest folder of each day or month is read, and no other."""
    last = {f: max(e) for f, e in _epochs(spark, target).items()}
    if not last:
        return spark.createDataFrame([], _DAILY)
    return _folders(spark, target, last).drop("folder", "epoch")


def start_intake(
    events: DataFrame,
    store: CatalogStore,
    checkpoint: str,
    available_now: bool = False,
    every: str = "1 minute",
    datasets: Callable[[], DataFrame] | None = None,
) -> StreamingQuery:
    """Append events(event_id, dataset_id, access_type, source, occurred_at) to the store's log.

    With `datasets` (dataset_id, status), only READY ones record events.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        allowed = batch if datasets is None else trackable(batch, datasets())
        store.append("access_events", allowed, batch=f"stream-{batch_id}")

    return _start(events, sink, checkpoint, "append", available_now, every)


def start_value(
    events: DataFrame,
    store: CatalogStore,
    scores: Callable[[], DataFrame],
    clock: Callable[[], datetime],
    checkpoint: str,
    settings: Settings = Settings(),
    available_now: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Per batch: log the events of scored datasets, recompute the Value of those they touch, append
    snapshots and publish the new scores and recommendations.

    `scores` gives the present scores of READY datasets; events of others are not recorded. What is
    read back are daily counts and the events of the four days in which a window begins or ends.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        allowed = batch.join(scores().select("dataset_id"), "dataset_id", "left_semi")
        store.append("access_events", allowed, batch=f"value-{batch_id}")
        # The clock of a batch is the same when the batch is repeated only if the caller's is.
        now = clock()
        folder = f"{store.root}/access_events/batch=value-{batch_id}"
        written = store.spark.read.schema(LOGS["access_events"]).parquet(folder)
        if written.isEmpty():
            return
        touched = written.select("dataset_id").distinct()
        current = scores().join(touched, "dataset_id", "left_semi")
        recent = store.usage(now).join(touched, "dataset_id", "left_semi")
        fresh = recompute_value(current, recent, now, settings)
        run = store.write_values(fresh, now, f"value-{batch_id:012d}")  # later batches win ties
        stored = store.spark.read.parquet(f"{store.root}/dataset_scores/run_id={run}")
        store.append("score_snapshots", score_snapshots(stored, now), batch=f"value-{batch_id}")

    return _start(events, sink, checkpoint, "append", available_now, every)


# --------------------------------------------------------------------------- Value without events
_WINDOWS = (
    "dataset_id string, captured_us bigint, accesses_90d bigint, accesses_last30 bigint, "
    "accesses_prev30 bigint, last_accessed_us bigint"
)
_RING = "days array<bigint>, counts array<bigint>, lasts array<bigint>, before bigint, done bigint"


def _ageing(every: int):
    """The step of one dataset: takes its events in and gives its windows at the instants passed.

    The state is a ring of daily counts with the last access of each day. A day here ends with its
    midnight: an event at midnight belongs to the day before it, as windows are closed above. Days
    before the longest window (and one instant more) leave the ring; the last access stays.
    """

    def step(key, batches, state):
        import numpy as np
        import pandas as pd

        day, window = 86_400_000_000, 90
        if key[0] is None:  # heartbeats move the watermark and nothing else
            for _ in batches:
                pass
            return
        days = counts = lasts = np.zeros(0, dtype=np.int64)
        before, done = None, None
        if state.exists:
            held = state.get
            days, counts, lasts = (np.array(x, dtype=np.int64) for x in held[:3])
            before, done = held[3], held[4]
        new = [batch["at_us"].to_numpy(dtype=np.int64) for batch in batches]
        if new:
            at = np.concatenate(new)
            of = np.concatenate([days, (at - 1) // day])
            number = np.concatenate([counts, np.ones(len(at), dtype=np.int64)])
            last = np.concatenate([lasts, at])
            days, place = np.unique(of, return_inverse=True)
            counts, lasts = np.zeros(len(days), dtype=np.int64), np.full(len(days), -(1 << 62), dtype=np.int64)
            np.add.at(counts, place, number)
            np.maximum.at(lasts, place, last)
        if done is None:
            done = int(days[0]) // every * every
        # a boundary D is the midnight that ends day D - 1
        mark = state.getCurrentWatermarkMs() * 1000 // day
        bounds = np.arange(done + every, mark + 1, every, dtype=np.int64)
        if len(bounds):
            summed = np.concatenate([[0], np.cumsum(counts)])

            def between(low, high):
                return summed[np.searchsorted(days, high)] - summed[np.searchsorted(days, low)]

            whole = between(bounds - window, bounds)
            shown = (whole > 0) | (between(bounds - window - every, bounds - every) > 0)
            upto = np.searchsorted(days, bounds)
            newest = np.maximum.accumulate(np.concatenate([[-(1 << 62) if before is None else before], lasts]))[upto]
            if shown.any():
                yield pd.DataFrame(
                    {
                        "dataset_id": key[0],
                        "captured_us": (bounds * day)[shown],
                        "accesses_90d": whole[shown],
                        "accesses_last30": between(bounds - 30, bounds)[shown],
                        "accesses_prev30": between(bounds - 60, bounds - 30)[shown],
                        "last_accessed_us": newest[shown],
                    }
                )
            done = int(bounds[-1])
            old = days < done - window - every
            if old.any():
                before = int(max(lasts[old].max(), -(1 << 62) if before is None else before))
                days, counts, lasts = days[~old], counts[~old], lasts[~old]
            if whole[-1] == 0 and not (days >= done).any():
                state.remove()  # silent for 90 days: nothing changes until the next event
                return
        state.update((days.tolist(), counts.tolist(), lasts.tolist(), before, done))
        state.setTimeoutTimestamp(int((max(done, mark // every * every) + every) * day // 1000))

    return step


def ageing_windows(events: DataFrame, every_days: int = 1) -> DataFrame:
    """Access windows (captured_at and the columns of `windows_at`) of each dataset at every
    `every_days`-th UTC midnight that the watermark passes, whether or not events came for it.

    A timer for each dataset wakes it at the next such midnight. A dataset is given from its first event
    until its windows are empty, that instant included; its next event wakes it again. `events`
    carry a watermark; rows without dataset_id are heartbeats that only move it.
    """
    keyed = events.selectExpr("dataset_id", "occurred_at", "unix_micros(occurred_at) AS at_us")
    aged = keyed.groupBy("dataset_id").applyInPandasWithState(
        _ageing(every_days), _WINDOWS, _RING, "append", GroupStateTimeout.EventTimeTimeout
    )
    return aged.selectExpr(
        "dataset_id", "timestamp_micros(captured_us) AS captured_at", "accesses_90d", "accesses_last30",
        "accesses_prev30", "timestamp_micros(last_accessed_us) AS last_accessed_at",
        "greatest(0D, (captured_us - last_accessed_us) / 86400000000D) AS days_since_last_access",
    )


def start_ageing_value(
    events: DataFrame,
    store: CatalogStore,
    checkpoint: str,
    settings: Settings = Settings(),
    scores: Callable[[], DataFrame] | None = None,
    every_days: int = 1,
    available_now: bool = False,
    every: str = "1 minute",
) -> StreamingQuery:
    """Value and recommendation of every dataset day by day, appended to the store's `value_log`.

    With `scores` (the present scores), the newest Value of each dataset a batch has aged is also
    published, so that a silent dataset moves to ARCHIVE and RETIRE by itself.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        store.append("value_log", batch.select("dataset_id", "captured_at", "value", "recommendation"), batch=f"age-{batch_id}")
        if scores is None:
            return
        aged = store.spark.read.schema(LOGS["value_log"]).parquet(f"{store.root}/value_log/batch=age-{batch_id}")
        if aged.isEmpty():
            return
        newest = aged.groupBy("dataset_id").agg(F.max_by(F.struct("value", "recommendation", "captured_at"), "captured_at").alias("now"))
        current = scores()
        fresh = current.drop("value", "recommendation").join(
            newest.selectExpr("dataset_id", "now.value", "now.recommendation"), "dataset_id"
        )
        at = aged.agg(F.expr("date_format(max(captured_at), \"yyyy-MM-dd'T'HH:mm:ss'Z'\") AS at")).first()["at"]
        store.write_values(fresh.select(*current.columns), at, f"age-{batch_id:012d}")

    valued = value_from_windows(ageing_windows(events, every_days), settings)
    return _start(valued, sink, checkpoint, "append", available_now, every)
