"""Catalogue tables as append-only parquet with a publish step.

A run writes its rows of each table below ``<table>/run_id=<id>``. Publishing it writes a new version
of the catalogue's state: one small table (dataset_id, table_name, run_id, published_at) with the
run that holds each dataset's present rows. Readers open the newest complete version and the
runs it names, whatever number of runs there were. A repeated run overwrites its own folders, so
lost executors or a retried job leave nothing twice. There is one writer at a time; readers and
compaction need no stop, as versions and their runs stay until `vacuum` removes those that the
last `KEEP_VERSIONS` do not name.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from datawarden.config import Settings
from datawarden.functions.scalars import DAY_MICROS, instant, micros, text, utc_day
from datawarden.operators import sketch
from datawarden.operators.maintenance import (
    apply_overrides,
    load_settings,
    recompute_scores,
    remap_tags,
    retrust,
    tombstones_by_name,
    valid_overrides,
    without_deleted,
)
from datawarden.operators.profile import union_all
from datawarden.operators.usage import daily_rollup, edge_days

_SHARES = "frequency: double, recency: double, trend: double"
VALUE_TYPE = (
    f"struct<score: double, inputs: struct<{_SHARES}>, weights: struct<{_SHARES}>, raw: struct<accesses_90d: bigint, "
    "accesses_last30: bigint, accesses_prev30: bigint, days_since_last_access: double, freq_cap: int, half_life: double>>"
)
LOGS = {
    "tombstones": "dataset_id string, deleted_at timestamp",
    "settings_log": "key string, json_value string, updated_at timestamp",
    "tag_overrides": "dataset_id string, position int, category string, sensitivity string, "
    "requested_at timestamp",
    "score_snapshots": "dataset_id string, quality_score double, trust_score double, "
    "value_score double, captured_at timestamp",
    "value_log": f"dataset_id string, captured_at timestamp, value {VALUE_TYPE}, recommendation string",
    "column_sketches": f"{sketch.SCHEMA}, profiled_at timestamp",
    "access_events": "event_id bigint, dataset_id string, access_type string, source string, "
    "occurred_at timestamp, event_date date",
}
DAILY = "dataset_id string, access_type string, date date, n bigint, first_at timestamp, last_at timestamp"
TOTALS = "dataset_id string, access_type string, n bigint, first_at timestamp, last_at timestamp"
STATE = "dataset_id string, table_name string, run_id string, published_at timestamp"
KEEP_VERSIONS = 3
#: Events of a batch that one task sorts into folders.
EVENTS_A_TASK = 500_000
TABLES = ("datasets", "columns", "tags", "quality_checks", "dataset_scores", "preview_rows")


def new_run_id() -> str:
    return f"run-{uuid.uuid4().hex}"


def _totals(rows: DataFrame) -> DataFrame:
    return rows.groupBy("dataset_id", "access_type").agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at")
    )


class CatalogStore:
    """`log_unit` sizes the folders of the access log: day, or month for a sparse long history."""

    def __init__(self, spark: SparkSession, root: str, log_unit: str = "day"):
        if log_unit not in ("day", "month"):
            raise ValueError("log_unit must be day or month")
        self.spark = spark
        self.root = root.rstrip("/")
        self.log_unit = log_unit

    def _log_folder(self, at: str) -> str:
        return utc_day(at) if self.log_unit == "day" else f"trunc({utc_day(at)}, 'MM')"

    # ------------------------------------------------------------------ folders
    def _path(self, name: str):
        """A path below the root and its file system, as Spark's own writers see them."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _exists(self, name: str) -> bool:
        path, system = self._path(name)
        return system.exists(path)

    def _remove(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    def _folders(self, name: str) -> list[str]:
        """Values of the partition folders of a table, in order, from the file system's listing."""
        path, system = self._path(name)
        if not system.exists(path):
            return []
        names = [entry.getPath().getName() for entry in system.listStatus(path) if entry.isDirectory()]
        return sorted(x.split("=", 1)[1] for x in names if "=" in x)

    # ------------------------------------------------------------------ published tables
    def write(self, table: str, df: DataFrame, run_id: str) -> None:
        if table not in TABLES:
            raise ValueError(f"table must be one of {TABLES}")
        df.write.mode("overwrite").parquet(f"{self.root}/{table}/run_id={run_id}")

    def of_run(self, table: str, run_id: str) -> DataFrame:
        """The rows that a run wrote, published or not."""
        return self.spark.read.parquet(f"{self.root}/{table}/run_id={run_id}")

    def publish(
        self,
        run_id: str,
        datasets: DataFrame,
        at: datetime | str,
        tables: tuple[str, ...] = TABLES,
    ) -> None:
        """Makes a run's rows of `tables` the present ones of its datasets, unless a later run has
        them already."""
        if not run_id[:1].isalpha():
            raise ValueError("a run id begins with a letter")  # partition values must stay text
        listing = ", ".join(text(t) for t in tables)
        covered = datasets.selectExpr(
            "dataset_id", f"explode(array({listing})) AS table_name", f"{text(run_id)} AS run_id",
            f"{instant(at)} AS published_at",
        )
        state = self._state().unionByName(covered).groupBy("dataset_id", "table_name").agg(
            F.expr("max(struct(published_at, run_id)) AS run")
        )
        versions = self._versions()
        target = f"{self.root}/state/version={int(versions[-1] if versions else 0) + 1:012d}"
        state.selectExpr("dataset_id", "table_name", "run.run_id", "run.published_at").write.mode("overwrite").parquet(target)

    def _versions(self) -> list[str]:
        """Complete versions of the state, oldest first."""
        return [v for v in self._folders("state") if self._exists(f"state/version={v}/_SUCCESS")]

    def _state(self) -> DataFrame:
        versions = self._versions()
        if not versions:
            return self.spark.createDataFrame([], STATE)
        return self.spark.read.schema(STATE).parquet(f"{self.root}/state/version={versions[-1]}")

    def _read(self, name: str, schema: str | None = None) -> DataFrame:
        try:
            return self.spark.read.parquet(f"{self.root}/{name}")
        except AnalysisException as error:
            missing = error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA")
            if schema is None or not missing:
                raise
            return self.spark.createDataFrame([], schema)

    def latest_runs(self, table: str) -> DataFrame:
        """(dataset_id, run_id) of the latest published run that covers the table, for datasets
        not deleted since."""
        latest = self._state().filter(f"table_name = '{table}'").drop("table_name")
        alive = without_deleted(latest, self.log("tombstones"), "published_at")
        return alive.select("dataset_id", "run_id")

    def read(self, table: str) -> DataFrame:
        """The present rows of a table: latest run per dataset, deleted datasets left out.

        The driver gets the ids of the runs that hold present rows; no other run is listed or read.
        """
        live = self.latest_runs(table)
        runs = sorted(r["run_id"] for r in live.select("run_id").distinct().collect())
        if not runs:
            return self._read(table).drop("run_id").limit(0)
        reader = self.spark.read.option("basePath", f"{self.root}/{table}")
        rows = reader.parquet(*(f"{self.root}/{table}/run_id={run}" for run in runs))
        return rows.join(live, ["dataset_id", "run_id"], "left_semi").drop("run_id")

    # ------------------------------------------------------------------ logs
    def append(self, log: str, df: DataFrame, batch: str | None = None) -> None:
        """Append to a log. A named batch may be repeated; it replaces only itself."""
        if log not in LOGS:
            raise ValueError(f"log must be one of {tuple(LOGS)}")
        batch = batch or new_run_id()
        target = f"{self.root}/{log}/batch={batch}"
        if log == "access_events":
            dated = df.selectExpr(
                "event_id", "dataset_id", "access_type", "source", "occurred_at",
                f"{self._log_folder('occurred_at')} AS event_date",
            )
            # The batch is written as it comes and counted, then sorted into its folders in ranges of
            # days: few files a folder, also for batches of a stream, and no more rows in a task than
            # EVENTS_A_TASK, whether days are many or one is hot.
            arrived = f"{self.root}/arriving/batch={batch}"
            dated.write.mode("overwrite").parquet(arrived)
            rows = self.spark.read.schema(dated.schema).parquet(arrived)
            tasks = 1 + rows.count() // EVENTS_A_TASK
            rows.repartitionByRange(tasks, "event_date", "dataset_id", "occurred_at", "event_id").write.mode(
                "overwrite"
            ).partitionBy("event_date").parquet(target)
            self._roll_batch(batch, tasks)
            self._remove(f"arriving/batch={batch}")
        else:
            df.write.mode("overwrite").parquet(target)

    def log(self, log: str) -> DataFrame:
        return self._read(log, LOGS[log]).drop("batch")

    def access_events(self, since: datetime | str | None = None) -> DataFrame:
        """The access log; `since` prunes the day folders that are read."""
        events = self.log("access_events")
        if since is not None:
            events = events.filter(
                f"event_date >= {self._log_folder(instant(since))} "
                f"AND occurred_at >= {instant(since)}"
            )
        return without_deleted(events, self.log("tombstones"), "occurred_at")

    # ------------------------------------------------------------------ usage roll-up
    def _roll_batch(self, batch: str, tasks: int) -> None:
        """Keeps the daily counts of a written batch, and adds its older days to the totals.

        Totals that already hold an earlier write of the batch would count it twice; they go, and
        the daily counts answer in their place.
        """
        written = self.spark.read.schema(LOGS["access_events"]).parquet(f"{self.root}/access_events/batch={batch}")
        target = f"{self.root}/usage_daily/batch={batch}"
        daily = daily_rollup(written, "event_date").repartitionByRange(tasks, "event_date", "dataset_id")
        daily.write.mode("overwrite").partitionBy("event_date").parquet(target)
        for until in self._folders("usage_totals"):
            held = self.spark.read.parquet(f"{self.root}/usage_totals_batches/until={until}")
            if not held.filter(F.col("batch") == batch).isEmpty():
                self._remove(f"usage_totals/until={until}")
                continue
            late = self.spark.read.schema(DAILY).parquet(target).filter(f"date < DATE'{until}'")
            added = _totals(late)
            added.write.mode("overwrite").parquet(f"{self.root}/usage_totals/until={until}/part={batch}")

    def _daily(self) -> DataFrame:
        """Daily counts of all batches, in the folders of the log's unit."""
        return self._typed("usage_daily", f"{DAILY}, event_date date")

    def _typed(self, name: str, schema: str) -> DataFrame:
        if not self._folders(name):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _days(self, days: list[date]) -> str:
        """A filter on the log for some days, pruning its folders."""
        if not days:
            return "false"
        folders = sorted({d if self.log_unit == "day" else d.replace(day=1) for d in days})
        listed = [", ".join(f"DATE'{x}'" for x in part) for part in (folders, days)]
        return f"event_date IN ({listed[0]}) AND {utc_day('occurred_at')} IN ({listed[1]})"

    def _weighted(self, until: date | None, edges: list[date]) -> DataFrame:
        """(dataset_id, access_type, first_at, occurred_at, n, event_date) for all usage: totals of the days
        before `until`, daily counts from there on, and the events of the `edges` one by one.

        A tombstone hides a row if it is not older than the row's last event. A day on which it lies
        between a dataset's events is read event by event; totals in which it does are replaced
        by daily counts.
        """
        log, daily = self.log("access_events"), self._daily()
        dead = self.log("tombstones").groupBy("dataset_id").agg(F.max("deleted_at").alias("deleted_at"))
        deletes = bool(self._folders("tombstones"))
        torn = "first_at <= deleted_at AND deleted_at < last_at"
        split: list[date] = []
        if deletes:
            days = daily.join(dead, "dataset_id").filter(torn).select("date").distinct()
            split = sorted(r["date"] for r in days.collect())  # days on which a deleted dataset had events
        single, kept = sorted({*edges, *split}), ("dataset_id", "access_type")
        known = f"date NOT IN ({', '.join(f"DATE'{d}'" for d in single)})" if single else "true"

        def folded(rows: DataFrame) -> DataFrame:
            alive = without_deleted(rows, self.log("tombstones"), "last_at") if deletes else rows
            return alive.selectExpr(*kept, "first_at", "last_at AS occurred_at", "n", "event_date")

        def one_by_one(rows: DataFrame) -> DataFrame:
            alive = without_deleted(rows, self.log("tombstones"), "occurred_at") if deletes else rows
            return alive.selectExpr(*kept, "occurred_at AS first_at", "occurred_at", "1L AS n", "event_date")

        if until is None:
            return folded(daily.filter(known)).unionByName(one_by_one(log.filter(self._days(single))))
        folder = until if self.log_unit == "day" else until.replace(day=1)
        later = f"event_date >= DATE'{folder}' AND date >= DATE'{until}'"
        totals = self.spark.read.schema(TOTALS).parquet(f"{self.root}/usage_totals/until={until}")
        totals = totals.withColumn("event_date", F.lit(until - timedelta(days=1)))
        parts = [
            folded(daily.filter(f"{later} AND {known}")),
            one_by_one(log.filter(self._days([d for d in single if d >= until]))),
        ]
        if deletes:
            stale = totals.join(dead, "dataset_id").filter(torn).select("dataset_id").distinct()
            before = daily.filter(f"event_date <= DATE'{until}' AND date < DATE'{until}' AND {known}")
            old = log.filter(self._days([d for d in single if d < until]))
            parts += [
                folded(before.join(stale, "dataset_id", "left_semi")),
                one_by_one(old.join(stale, "dataset_id", "left_semi")),
            ]
            totals = totals.join(stale, "dataset_id", "left_anti")
        return union_all([*parts, folded(totals)])

    def usage(self, now: datetime | str, days: int = 90) -> DataFrame:
        """The access log as weighted events, for windows that end at `now`, for the series of its
        last `days` days and for all-time facts. Deleted datasets are left out.

        What is read does not grow with the events: one row for each dataset, type and day, older
        days summed up where `roll_up` has done so, and the events of four days.
        """
        first = min(edge_days(now)[0], edge_days(now)[-1] - timedelta(days=days - 1))
        fitting = [u for u in map(date.fromisoformat, self._folders("usage_totals")) if u <= first]
        return self._weighted(max(fitting, default=None), edge_days(now)).drop("first_at")

    def roll_up(self, until: datetime | str) -> None:
        """Sums up the days before `until`'s. It starts from earlier totals, and batches that come
        later add to it by themselves; the totals before the previous ones are removed."""
        day = date(1970, 1, 1) + timedelta(days=micros(until) // DAY_MICROS)
        have = [u for u in map(date.fromisoformat, self._folders("usage_totals")) if u < day]
        rows = self._weighted(max(have, default=None), []).filter(f"{utc_day('occurred_at')} < DATE'{day}'")
        batches = [(b,) for b in self._folders("usage_daily")]
        listed = self.spark.createDataFrame(batches, "batch string")
        totals = f"{self.root}/usage_totals/until={day}"
        listed.write.mode("overwrite").parquet(f"{self.root}/usage_totals_batches/until={day}")
        _totals(rows.withColumnRenamed("occurred_at", "last_at")).write.mode("overwrite").parquet(f"{totals}/part=base")
        for old in sorted(have)[:-1]:
            self._remove(f"usage_totals/until={old}")

    def column_sketches(self) -> DataFrame:
        """Merged profile parts per column; a part is appended for each file or run."""
        parts = without_deleted(self.log("column_sketches"), self.log("tombstones"), "profiled_at")
        return sketch.merge_sketches(parts)

    def score_snapshots(self) -> DataFrame:
        kept = without_deleted(self.log("score_snapshots"), self.log("tombstones"), "captured_at")
        return kept.orderBy("dataset_id", "captured_at")

    # ------------------------------------------------------------------ changes
    def _republish(self, at: datetime | str, run_id: str | None, **tables: DataFrame) -> str:
        """A run of some tables only; readers take the others from earlier runs."""
        run = run_id or new_run_id()
        for name, rows in tables.items():
            self.write(name, rows, run)
        ids = None
        for name in tables:
            mine = self.spark.read.parquet(f"{self.root}/{name}/run_id={run}").select("dataset_id")
            ids = mine if ids is None else ids.unionByName(mine)
        self.publish(run, ids.distinct(), at, tuple(tables))
        return run

    def settings(self) -> Settings:
        """The settings in force, from the log."""
        return load_settings(self.log("settings_log"))

    def apply_logged_overrides(self, at: datetime | str, run_id: str | None = None) -> str:
        """Publishes the tags after all logged overrides, and Trust after their coverage, for the
        datasets they name."""
        settings, columns, tags = self.settings(), self.read("columns"), self.read("tags")
        chosen = valid_overrides(self.log("tag_overrides"), columns, settings)
        touched = chosen.select("dataset_id").distinct()

        def mine(df: DataFrame) -> DataFrame:
            return df.join(touched, "dataset_id", "left_semi")

        changed = apply_overrides(mine(tags), chosen)
        names = columns.select("dataset_id", "position", "name")
        full = changed.join(names, ["dataset_id", "position"], "left").selectExpr(
            "dataset_id", "position", "name", "category", "sensitivity", "confidence", "source",
            "overridden", "false AS needs_review",
        )
        scores = retrust(mine(self.read("dataset_scores")), self.read("datasets"), changed, settings)
        return self._republish(at, run_id, tags=full, dataset_scores=scores)

    def rescore(self, at: datetime | str, run_id: str | None = None) -> str:
        """Publishes all scores and automatic tags again under the logged settings."""
        settings = self.settings()
        scores = recompute_scores(self.read("dataset_scores"), self.usage(at), at, settings)
        tags = remap_tags(self.read("tags"), settings).drop("changed")
        return self._republish(at, run_id, dataset_scores=scores, tags=tags)

    def write_values(self, scores: DataFrame, at: datetime | str, run_id: str | None = None) -> str:
        """Publishes scores whose Value was recomputed, for their datasets alone."""
        return self._republish(at, run_id, dataset_scores=scores)

    def compact(self, at: datetime | str) -> str:
        """The present state as one run, published now. Readers before and after see the same rows;
        `vacuum` removes the runs it replaces."""
        run, present = new_run_id(), []
        for table in TABLES:
            if not self._folders(table):
                continue
            self.write(table, self.read(table), run)
            present.append(table)
        self.publish(run, self.read("datasets"), at, tuple(present))
        return run

    def vacuum(self, keep: int = KEEP_VERSIONS) -> None:
        """Removes all but the last `keep` versions, and the runs that none of these names."""
        versions = self._versions()
        kept = versions[-keep:]
        if not kept:
            return
        named = self.spark.read.schema(STATE).parquet(*(f"{self.root}/state/version={v}" for v in kept))
        live = {(r["table_name"], r["run_id"]) for r in named.select("table_name", "run_id").distinct().collect()}
        for version in versions[:-keep]:
            self._remove(f"state/version={version}")
        for table in TABLES:
            for run in self._folders(table):
                if (table, run) not in live:
                    self._remove(f"{table}/run_id={run}")

    # ------------------------------------------------------------------ deletes
    def delete_all(self, at: datetime | str) -> None:
        self.append(
            "tombstones",
            self.read("datasets").selectExpr("dataset_id", f"{instant(at)} AS deleted_at"),
        )

    def delete_named(self, names: list[str], at: datetime | str) -> None:
        self.append("tombstones", tombstones_by_name(self.read("datasets"), names, at))

    def delete_one(self, dataset_id: str, at: datetime | str) -> None:
        one = self.read("datasets").filter(F.col("dataset_id") == dataset_id)
        self.append("tombstones", one.selectExpr("dataset_id", f"{instant(at)} AS deleted_at"))


