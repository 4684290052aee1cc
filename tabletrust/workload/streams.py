"""Copies and checks that run on streams, driven to completion over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.operators import report
from tabletrust.operators.mapping import ColumnMap, TableMap
from tabletrust.session import fresh_path
from tabletrust.sources.sinks import VersionedTable
from tabletrust.streaming import heartbeat
from tabletrust.streaming.copy import CopyJob
from tabletrust.streaming.recurring import FIRST_SIGHT, DriftSweep, overdue, snapshot_rows
from tabletrust.workload.drifting import CATALOGS, EVENTS_SQL
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import table, tables, with_views

COPY_MAP = TableMap(
    "loose_events",
    "events_copy",
    (
        ColumnMap("event_id", "id"),
        ColumnMap("user_id", "user_id"),
        ColumnMap("flag", "flag", "BOOLEAN", "to_boolean"),
        ColumnMap("amount", "amount", "DOUBLE PRECISION", "to_float"),
    ),
)


#: Bytes of a row group of the arriving files: a task can start at any, however few files a batch has.
ROW_GROUP = 4 << 20


def _split_files(df: DataFrame, path: str, files: int) -> None:
    rows = df.repartition(files).write.mode("append")
    rows.option("parquet.block.size", ROW_GROUP).parquet(path)


def _copy(spark, folder) -> CopyJob:
    """First the errors and views arrive and are copied, then the rest and the errors again."""
    events = table(spark, folder, "loose_events")
    base = fresh_path(spark, "stream")
    early = events.where("flag IN ('Yes', '0')")
    late = events.where("flag IS NULL OR flag <> '0'")
    job = CopyJob(
        f"{base}/in", events.schema, f"{base}/out", f"{base}/checkpoint", COPY_MAP, "id",
        rejects=f"{base}/rejects", log=f"{base}/log", files_per_batch=2, rows_per_bucket=1 << 14,
    )
    _split_files(early, job.source, 3)
    job.run(spark)
    _split_files(late, job.source, 3)
    job.run(spark)
    return job


@query(
    "stream_copy_resume",
    with_views(
        """
        SELECT event_id AS id, user_id,
          CASE WHEN flag IS NOT NULL THEN lower(trim(flag)) IN ('1', 'true', 't', 'yes', 'y') END AS flag,
          TRY_CAST(amount AS DOUBLE) AS amount
        FROM loose_events WHERE amount <> 'n/k'
        """,
        "loose_events",
    ),
)
def stream_copy_resume(spark, folder):
    return _copy(spark, folder).table(spark).read()


@query(
    "stream_rejects",
    with_views(
        """
        SELECT event_id, amount FROM loose_events WHERE amount = 'n/k' AND flag IN ('Yes', '0')
        UNION ALL SELECT event_id, amount FROM loose_events
        WHERE amount = 'n/k' AND (flag IS NULL OR flag <> '0')
        """,
        "loose_events",
    ),
)
def stream_rejects(spark, folder):
    """Every rejected row, as often as it arrived."""
    return spark.read.parquet(_copy(spark, folder).rejects).select("event_id", "amount")


@query(
    "stream_progress",
    with_views(
        """
        SELECT 'loose_events' AS "table",
          count(*) FILTER (WHERE flag IN ('Yes', '0'))
            + count(*) FILTER (WHERE flag IS NULL OR flag <> '0') AS rows_read,
          count(*) FILTER (WHERE amount <> 'n/k') AS rows_in_target
        FROM loose_events
        """,
        "loose_events",
    ),
)
def stream_progress(spark, folder):
    log = spark.read.parquet(_copy(spark, folder).log)
    return log.groupBy("table").agg(
        F.sum("rows_read").alias("rows_read"), F.max("rows_in_target").alias("rows_in_target")
    )


# Each event is a heartbeat of its user's job.
STATUS_SQL = """
CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'view' THEN 'executing'
  WHEN 'click' THEN 'profiling' ELSE 'validating' END
"""


def _beats(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    status = (
        F.when(kind == "error", "failed")
        .when(kind == "purchase", "completed")
        .when(kind == "view", "executing")
        .when(kind == "click", "profiling")
        .otherwise("validating")
    )
    return table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("job"), status.alias("status"), "ts"
    )


@query(
    "stale_sweep",
    f"""
    WITH beats AS (SELECT CAST(user_id AS VARCHAR) AS job, {STATUS_SQL.strip()} AS status, ts FROM events),
    latest AS (SELECT job, max(ts) AS last_beat, arg_max(status, (ts, status)) AS status FROM beats GROUP BY job)
    SELECT job, last_beat,
      status IN ('analyzing', 'profiling', 'planning', 'executing', 'validating')
        AND last_beat < TIMESTAMP '2024-01-30 23:55:00' AS stale,
      CASE WHEN stale THEN 'failed' ELSE status END AS status
    FROM latest
    """,
)
def stale_sweep(spark, folder):
    now = F.lit("2024-01-31 00:00:00").cast("timestamp")
    return heartbeat.sweep(_beats(spark, folder), now)


@query(
    "job_totals",
    f"""
    WITH beats AS (SELECT user_id AS job, {STATUS_SQL.strip()} AS status, ts FROM events),
    latest AS (SELECT job, arg_max(status, (ts, status)) AS status, count(*) AS n FROM beats GROUP BY job)
    SELECT count(*) FILTER (WHERE status IN ('analyzing', 'profiling', 'planning', 'executing', 'validating'))
        AS running,
      count(*) FILTER (WHERE status = 'completed') AS completed, CAST(sum(n) AS BIGINT) AS rows_migrated
    FROM latest
    """,
)
def job_totals(spark, folder):
    """The dashboard line: every event is a row its user's job moved."""
    jobs = _beats(spark, folder).groupBy("job").agg(
        F.max_by("status", F.struct("ts", "status")).alias("status"), F.count(F.lit(1)).alias("rows")
    )
    return report.job_totals(jobs, heartbeat.ACTIVE)


@query(
    "stale_watch",
    f"""
    WITH beats AS (SELECT CAST(user_id AS VARCHAR) AS job, {STATUS_SQL.strip()} AS status, ts FROM events),
    latest AS (SELECT job, max(ts) AS last_beat, arg_max(status, (ts, status)) AS status FROM beats GROUP BY job)
    SELECT job, 'failed' AS status FROM latest
    WHERE status IN ('analyzing', 'profiling', 'planning', 'executing', 'validating')
      AND last_beat <= (SELECT max(ts) FROM beats) - INTERVAL 5 MINUTE
    """,
)
def stale_watch(spark, folder):
    """The same as a stream: timers go off once event time has passed them."""
    base = fresh_path(spark, "beats")
    beats = _beats(spark, folder).withColumn("ts", F.col("ts").cast("timestamp"))
    beats.write.parquet(f"{base}/in")
    arriving = spark.readStream.schema(beats.schema).parquet(f"{base}/in")
    run = (
        heartbeat.watch(arriving)
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    found = spark.read.schema("job string, status string, last_beat timestamp").parquet(f"{base}/out")
    return found.select("job", "status")


# Brand#1 has lost everything, and says so; the others report as they are.
_LIVE_SQL = EVENTS_SQL.replace("current_catalog", "live_catalog").replace(
    "current_indexes", "live_indexes"
)


@query(
    "stream_drift",
    with_views(
        f"""
        WITH live_catalog AS (SELECT * FROM current_catalog WHERE monitor <> 'Brand#1'),
        live_indexes AS (SELECT * FROM current_indexes WHERE monitor <> 'Brand#1'),
        {_LIVE_SQL.strip()}
        SELECT monitor, kind, severity, count(*) AS events FROM events
        WHERE monitor IN (SELECT monitor FROM base_catalog UNION SELECT monitor FROM base_indexes)
        GROUP BY monitor, kind, severity
        """,
        *CATALOGS,
    ),
)
def stream_drift(spark, folder):
    sweep, _ = _sweep(spark, folder)
    events = spark.read.parquet(sweep.events_path)
    return events.groupBy("monitor", "kind", "severity").agg(F.count(F.lit(1)).alias("events"))


def _sweep(spark, folder, unknown: tuple[str, ...] = ()):
    """A sweep over the present catalogs; `unknown` monitors have no baseline yet."""
    base = fresh_path(spark, "sweep")
    sweep = DriftSweep(
        VersionedTable(spark, f"{base}/baseline"), f"{base}/events", f"{base}/checks", f"{base}/checkpoint"
    )
    data = tables(spark, folder, *CATALOGS)
    monitors = data["base_catalog"].select("monitor").union(data["base_indexes"].select("monitor"))
    known = snapshot_rows(data["base_catalog"], data["base_indexes"], monitors)
    sweep.rebaseline(known.where(~F.col("monitor").isin(*unknown)))
    alive = F.col("monitor") != "Brand#1"
    live = snapshot_rows(
        data["current_catalog"].where(alive), data["current_indexes"].where(alive), monitors
    )
    live.coalesce(1).write.parquet(f"{base}/snapshots")
    arriving = spark.readStream.schema(live.schema).parquet(f"{base}/snapshots")
    sweep.start(arriving).awaitTermination()
    return sweep, live


@query(
    "stream_first_sight",
    with_views(
        f"""
        WITH live_catalog AS (SELECT * FROM current_catalog WHERE monitor <> 'Brand#1'),
        live_indexes AS (SELECT * FROM current_indexes WHERE monitor <> 'Brand#1'),
        {_LIVE_SQL.strip()}
        SELECT monitor, kind, severity, '-' AS detail, count(*) AS events FROM events
        WHERE monitor IN (SELECT monitor FROM base_catalog UNION SELECT monitor FROM base_indexes)
          AND monitor NOT IN ('Brand#2', 'Brand#3')
        GROUP BY ALL
        UNION ALL
        SELECT monitor, 'baseline_created', 'info', 'baseline of ' || count(*) || ' columns taken', 1
        FROM live_catalog WHERE monitor IN ('Brand#2', 'Brand#3') GROUP BY monitor
        """,
        *CATALOGS,
    ),
)
def stream_first_sight(spark, folder):
    """Two monitors are new: they are reported, and the next sweep compares them like the others."""
    sweep, live = _sweep(spark, folder, ("Brand#2", "Brand#3"))
    sweep.check_batch(live, 7)
    events = spark.read.parquet(sweep.events_path).where("batch < 7 OR monitor IN ('Brand#2', 'Brand#3')")
    detail = F.when(F.col("kind") == FIRST_SIGHT, F.col("detail")).otherwise("-").alias("detail")
    return events.groupBy("monitor", "kind", "severity", detail).agg(F.count(F.lit(1)).alias("events"))


@query(
    "stream_overdue",
    """
    SELECT CAST(user_id AS VARCHAR) AS monitor, 'warning' AS severity, 'sweep_overdue' AS kind,
      'no snapshot for 21600 seconds' AS detail
    FROM events GROUP BY user_id
    HAVING max(ts) <= (SELECT max(ts) FROM events) - INTERVAL 6 HOUR
    """,
)
def stream_overdue(spark, folder):
    """Each event is a snapshot of its user's monitor; those silent for six hours are overdue."""
    base = fresh_path(spark, "reports")
    reports = table(spark, folder, "events").select(
        F.col("user_id").cast("string").alias("monitor"), F.col("ts").cast("timestamp").alias("ts")
    )
    reports.write.parquet(f"{base}/in")
    late = overdue(spark.readStream.schema(reports.schema).parquet(f"{base}/in"), 6 * 3600)
    run = (
        late.writeStream.format("parquet").option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
    )
    run.awaitTermination()
    return spark.read.schema(late.schema).parquet(f"{base}/out").drop("last_beat")


@query(
    "rebaseline_one",
    with_views(
        """
        SELECT monitor, count(*) AS "columns" FROM (
          SELECT monitor FROM base_catalog WHERE monitor <> 'Brand#2'
          UNION ALL SELECT monitor FROM current_catalog WHERE monitor = 'Brand#2')
        GROUP BY monitor
        """,
        "base_catalog",
        "current_catalog",
    ),
)
def rebaseline_one(spark, folder):
    """One of many monitors accepts its present catalog."""
    sweep, live = _sweep(spark, folder)
    sweep.rebaseline(live.where("monitor = 'Brand#2'"))
    columns = sweep.baseline.read().where("table is not null and index is null")
    return columns.groupBy("monitor").agg(F.count(F.lit(1)).alias("columns"))
