"""Recurring drift checks over all enabled monitors at once."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tabletrust.operators import drift
from tabletrust.session import materialize
from tabletrust.sources.sinks import VersionedTable
from tabletrust.streaming import heartbeat


def run_check(
    monitors: DataFrame,
    base_columns: DataFrame,
    current_columns: DataFrame,
    base_indexes: DataFrame,
    current_indexes: DataFrame,
    checked_at: Column,
) -> tuple[DataFrame, DataFrame]:
    """(events, checks) of one sweep over `monitors(monitor, enabled, error, last_score)`.

    `error` says why a monitor's current catalog could not be read. Such a monitor is recorded
    with its last score and no events, and does not keep the others from being checked.
    """
    enabled = monitors.where("enabled")
    readable = enabled.where(F.col("error").isNull()).select("monitor")

    def kept(df: DataFrame) -> DataFrame:
        return df.join(readable, "monitor", "left_semi")

    events = drift.diff_catalogs(
        drift.structural(kept(base_columns)),
        drift.structural(kept(current_columns)),
        kept(base_indexes),
        kept(current_indexes),
    )
    events = materialize(events, "drift-events")
    checks = drift.check_results(enabled, events, checked_at).join(
        enabled.select("monitor", "error", "last_score"), "monitor"
    )
    failed = F.col("error").isNotNull()
    score = F.when(failed, F.coalesce("last_score", F.lit(0))).otherwise(F.col("health_score"))
    return events, checks.withColumn("health_score", score.cast("int")).drop("last_score")


def as_monitors(names: DataFrame) -> DataFrame:
    """Enabled, readable monitors from a column of names."""
    return names.select("monitor").distinct().select(
        "monitor",
        F.lit(True).alias("enabled"),
        F.lit(None).cast("string").alias("error"),
        F.lit(None).cast("int").alias("last_score"),
    )


COLUMN_FIELDS = ["monitor", "table", "column", "type", "nullable", "default"]
INDEX_FIELDS = ["monitor", "table", "index", "unique"]


def snapshot_rows(columns: DataFrame, indexes: DataFrame, monitors: DataFrame) -> DataFrame:
    """One frame that holds a whole snapshot of each monitor.

    A row is a column (`index` null), an index (`index` set), or, with `table` null, the sign that
    the monitor reported at all. The last tells an emptied database from one that sent nothing.
    """
    signs = monitors.select("monitor").distinct()
    return signs.unionByName(columns.select(*COLUMN_FIELDS), allowMissingColumns=True).unionByName(
        indexes.select(*INDEX_FIELDS), allowMissingColumns=True
    )


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    there = rows.where(F.col("table").isNotNull())
    return (
        there.where(F.col("index").isNull()).select(*COLUMN_FIELDS),
        there.where(F.col("index").isNotNull()).select(*INDEX_FIELDS),
    )


#: Kinds of the events that are no drift.
FIRST_SIGHT, OVERDUE = "baseline_created", "sweep_overdue"


def overdue(reports: DataFrame, every: int, delay: str = "0 seconds") -> DataFrame:
    """A stream of overdue events from `reports(monitor, ts)`: monitors silent for `every` seconds.

    Each monitor has a timer in keyed state, in event time, that its reports set anew; a monitor that
    reports again after its event can become overdue again.
    """
    beats = reports.select(F.col("monitor").alias("job"), F.lit("executing").alias("status"), "ts")
    late = heartbeat.watch(beats, delay, every)
    return late.select(
        F.col("job").alias("monitor"), F.lit("warning").alias("severity"),
        F.lit(OVERDUE).alias("kind"), F.lit(f"no snapshot for {every} seconds").alias("detail"),
        "last_beat",
    )


@dataclass
class DriftSweep:
    """Compares each arriving catalog snapshot with the stored baselines.

    The first snapshot of a monitor becomes its baseline, and is reported as such. The baselines are the
    sweep's state per monitor; they are replaced only after the batch's events are written, and a
    batch that runs again finds by its own events which monitors were new to it.
    """

    baseline: VersionedTable  # rows as in `snapshot_rows`
    events_path: str
    checks_path: str
    checkpoint: str

    def start(self, snapshots: DataFrame) -> StreamingQuery:
        """`snapshots` has the rows of `snapshot_rows`.

        A snapshot must be one file: a batch takes whole files, so it never sees half of one.
        """
        return (
            snapshots.writeStream.foreachBatch(self.check_batch)
            .option("checkpointLocation", self.checkpoint)
            .trigger(availableNow=True)
            .start()
        )

    def check_batch(self, snapshot: DataFrame, batch_id: int) -> None:
        # Only the monitors that sent a snapshot in this batch are compared.
        arrived = materialize(snapshot.select("monitor").distinct(), "arrived-monitors")
        new = materialize(self._new_monitors(arrived, batch_id), "new-monitors")
        old = arrived.join(new, "monitor", "left_anti")
        base = snapshot.limit(0)
        if self.baseline.exists():
            base = self.baseline.read().join(old, "monitor", "left_semi")
        base_columns, base_indexes = _parts(base)
        columns, indexes = _parts(snapshot.join(old, "monitor", "left_semi"))
        now = F.current_timestamp()
        events, checks = run_check(
            as_monitors(base), base_columns, columns, base_indexes, indexes, now
        )
        first = _parts(snapshot.join(new, "monitor", "left_semi"))[0].groupBy("monitor").count()
        first = new.join(first, "monitor", "left").select(
            "monitor", F.lit("info").alias("severity"), F.lit(FIRST_SIGHT).alias("kind"),
            F.format_string("baseline of %s columns taken", F.coalesce("count", F.lit(0))).alias("detail"),
        )
        events = events.unionByName(first, allowMissingColumns=True)
        none = drift.check_results(new, events.limit(0), now)
        checks = checks.unionByName(none, allowMissingColumns=True)
        # A batch that runs again replaces its own folder, so nothing is counted twice.
        events.write.mode("overwrite").parquet(f"{self.events_path}/batch={batch_id}")
        checks.write.mode("overwrite").parquet(f"{self.checks_path}/batch={batch_id}")
        if not new.isEmpty():
            self.rebaseline(snapshot.join(new, "monitor", "left_semi"))

    def _new_monitors(self, arrived: DataFrame, batch_id: int) -> DataFrame:
        """Monitors without a baseline, or whose baseline an earlier run of this batch took."""
        new = arrived
        if self.baseline.exists():
            new = arrived.join(self.baseline.read().select("monitor").distinct(), "monitor", "left_anti")
        if self.baseline.holds(self.events_path, f"batch={batch_id}"):
            before = arrived.sparkSession.read.parquet(f"{self.events_path}/batch={batch_id}")
            taken = before.where(F.col("kind") == FIRST_SIGHT).select("monitor")
            new = new.unionByName(taken.join(arrived, "monitor", "left_semi")).distinct()
        return new

    def rebaseline(self, snapshot: DataFrame) -> None:
        """Accept the snapshots of these monitors as the new normal; others keep their baselines."""
        new = drift.structural(snapshot)
        if self.baseline.exists():
            kept = self.baseline.read().join(new.select("monitor").distinct(), "monitor", "left_anti")
            new = kept.unionByName(new)
        self.baseline.replace(new)
