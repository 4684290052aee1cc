"""Schema drift over many monitored databases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabletrust.functions import rules
from tabletrust.operators import drift
from tabletrust.session import materialize
from tabletrust.streaming.recurring import as_monitors, run_check
from tabletrust.workload.profile_sql import quoted
from tabletrust.workload.registry import query
from tabletrust.workload.scenario import table, tables, with_views

CATALOGS = ["base_catalog", "current_catalog", "base_indexes", "current_indexes"]


def _found(text: str, rows: list, pick: int) -> str:
    branches = " ".join(
        f"WHEN regexp_matches({text}, {quoted('(?i)' + r[0])}) THEN {quoted(r[pick])}" for r in rows
    )
    return f"CASE {branches} END"


NARROW_SQL = (
    "("
    + " OR ".join(
        f"(regexp_matches(b.\"type\", {quoted('(?i)' + w)}) AND regexp_matches(c.\"type\", {quoted('(?i)' + n)}))"
        for w, n in rules.NARROWING
    )
    + """) AND NOT coalesce(
    TRY_CAST(regexp_extract(c."type", '(?i)^VARCHAR\\((\\d+)\\)', 1) AS INT)
    >= TRY_CAST(regexp_extract(b."type", '(?i)^VARCHAR\\((\\d+)\\)', 1) AS INT), false)"""
)
LIKELY_SQL = f"coalesce({_found('c.\"column\"', rules.NAME_HINTS, 1)}, {_found('c.\"type\"', rules.TYPE_HINTS, 1)})"
ADVICE_SQL = f"coalesce({_found('c.\"column\"', rules.NAME_HINTS, 2)}, {_found('c.\"type\"', rules.TYPE_HINTS, 2)})"
EVENTS_SQL = f"""
bt AS (SELECT DISTINCT monitor, "table" FROM base_catalog),
ct AS (SELECT DISTINCT monitor, "table" FROM current_catalog),
shared AS (SELECT * FROM bt INTERSECT SELECT * FROM ct),
b AS (SELECT base_catalog.* FROM base_catalog SEMI JOIN shared USING (monitor, "table")),
c AS (SELECT current_catalog.* FROM current_catalog SEMI JOIN shared USING (monitor, "table")),
bi AS (SELECT i.* FROM base_indexes i WHERE NOT EXISTS (SELECT 1 FROM
  ((SELECT * FROM bt EXCEPT SELECT * FROM ct) UNION ALL (SELECT * FROM ct EXCEPT SELECT * FROM bt)) m
  WHERE m.monitor = i.monitor AND m."table" = i."table")),
ci AS (SELECT i.* FROM current_indexes i WHERE NOT EXISTS (SELECT 1 FROM
  ((SELECT * FROM bt EXCEPT SELECT * FROM ct) UNION ALL (SELECT * FROM ct EXCEPT SELECT * FROM bt)) m
  WHERE m.monitor = i.monitor AND m."table" = i."table")),
events(monitor, severity, kind, "table", "column", detail, likely_type, advice) AS (
  SELECT monitor, 'critical', 'table_dropped', "table", NULL, 'table is gone', NULL, NULL
    FROM (SELECT * FROM bt EXCEPT SELECT * FROM ct)
  UNION ALL SELECT monitor, 'info', 'table_added', "table", NULL, 'new table', NULL, NULL
    FROM (SELECT * FROM ct EXCEPT SELECT * FROM bt)
  UNION ALL SELECT b.monitor, 'critical', 'column_dropped', b."table", b."column", 'column is gone', NULL, NULL
    FROM b ANTI JOIN c USING (monitor, "table", "column")
  UNION ALL SELECT c.monitor, CASE WHEN NOT c.nullable AND c."default" IS NULL THEN 'warning' ELSE 'info' END,
    'column_added', c."table", c."column",
    'new column ' || c."type" || CASE WHEN NOT c.nullable AND c."default" IS NULL
      THEN ', NOT NULL without a default' ELSE '' END,
    {LIKELY_SQL}, {ADVICE_SQL}
    FROM c ANTI JOIN b USING (monitor, "table", "column")
  UNION ALL SELECT b.monitor, CASE WHEN {NARROW_SQL} THEN 'critical' ELSE 'warning' END, 'type_changed',
    b."table", b."column", b."type" || ' to ' || c."type"
      || CASE WHEN {NARROW_SQL} THEN ', can lose data' ELSE '' END, NULL, NULL
    FROM b JOIN c ON b.monitor = c.monitor AND b."table" = c."table" AND b."column" = c."column"
    WHERE upper(b."type") <> upper(c."type")
  UNION ALL SELECT b.monitor, 'critical', 'not_null_dropped', b."table", b."column",
    'nulls can now enter', NULL, NULL
    FROM b JOIN c ON b.monitor = c.monitor AND b."table" = c."table" AND b."column" = c."column"
    WHERE NOT b.nullable AND c.nullable
  UNION ALL SELECT b.monitor, 'warning', 'not_null_added', b."table", b."column",
    'existing nulls would block this', NULL, NULL
    FROM b JOIN c ON b.monitor = c.monitor AND b."table" = c."table" AND b."column" = c."column"
    WHERE b.nullable AND NOT c.nullable
  UNION ALL SELECT monitor, 'warning', 'index_dropped', "table", NULL, 'index dropped: ' || "index"
      || CASE WHEN "unique" THEN ', uniqueness no longer enforced' ELSE '' END, NULL, NULL
    FROM bi ANTI JOIN ci USING (monitor, "table", "index")
  UNION ALL SELECT monitor, 'info', 'index_added', "table", NULL, 'new index: ' || "index", NULL, NULL
    FROM ci ANTI JOIN bi USING (monitor, "table", "index"))
"""
CHECKS_SQL = """
checks AS (SELECT m.monitor, CAST(count(*) FILTER (WHERE severity = 'critical') AS BIGINT) AS critical,
  count(*) FILTER (WHERE severity = 'warning') AS warning,
  count(*) FILTER (WHERE severity = 'info') AS info,
  count(severity) > 0 AS has_drift,
  CAST(greatest(0, 100 - 25 * count(*) FILTER (WHERE severity = 'critical')
    - 8 * count(*) FILTER (WHERE severity = 'warning')) AS INT) AS health_score
  FROM (SELECT DISTINCT monitor FROM base_catalog) m
  LEFT JOIN events e ON e.monitor = m.monitor GROUP BY m.monitor)
"""
RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END"


def _sql(body: str) -> str:
    return with_views(f"WITH {EVENTS_SQL.strip()}{body}", *CATALOGS)


def _events(spark, folder) -> DataFrame:
    return drift.diff_catalogs(*[table(spark, folder, name) for name in CATALOGS])


@query(
    "schema_drift",
    _sql(
        """ SELECT monitor, severity, kind, "table", coalesce("column", '-') AS "column", detail,
        coalesce(likely_type, '-') AS likely_type, coalesce(advice, '-') AS advice FROM events"""
    ),
)
def schema_drift(spark, folder):
    events = drift.in_order(_events(spark, folder))
    return events.fillna("-", ["column", "likely_type", "advice"])


@query(
    "catalog_presence",
    _sql(
        """ SELECT coalesce(x.monitor, y.monitor) AS monitor, coalesce(x."table", y."table") AS "table",
        coalesce(x."column", y."column") AS "column",
        CASE WHEN y.monitor IS NULL THEN 'baseline' WHEN x.monitor IS NULL THEN 'current' ELSE 'both' END AS "where"
        FROM base_catalog x FULL JOIN current_catalog y
          ON x.monitor = y.monitor AND x."table" = y."table" AND x."column" = y."column" """
    ),
)
def catalog_presence(spark, folder):
    data = tables(spark, folder, *CATALOGS)
    keys = ["monitor", "table", "column"]
    return drift.presence(data["base_catalog"], data["current_catalog"], keys)


@query("drift_health", _sql(f", {CHECKS_SQL.strip()} SELECT * FROM checks"))
def drift_health(spark, folder):
    """One recurring check of every monitor."""
    data = tables(spark, folder, *CATALOGS)
    monitors = as_monitors(data["base_catalog"])
    _, checks = run_check(monitors, *[data[name] for name in CATALOGS], F.current_timestamp())
    return checks.drop("checked_at", "error")


@query(
    "drift_digest",
    _sql(
        f""" SELECT monitor, position, '[' || upper(severity) || '] ' || concat_ws('.', "table", "column")
          || ': ' || detail AS line, greatest(0, n - 15) AS more
        FROM (SELECT *, CAST(row_number() OVER (PARTITION BY monitor ORDER BY {RANK_SQL}, "table",
            coalesce("column", ''), kind, detail) AS INT) AS position,
          count(*) OVER (PARTITION BY monitor) AS n FROM events) WHERE position <= 15"""
    ),
)
def drift_digest(spark, folder):
    return drift.digest(materialize(_events(spark, folder), "drift-events"))


@query(
    "new_semantic_issues",
    _sql(
        """ SELECT monitor, position, "table", "column", likely_type, advice FROM (SELECT *,
          CAST(row_number() OVER (PARTITION BY monitor ORDER BY "table", "column") AS INT) AS position
          FROM events WHERE likely_type IS NOT NULL)"""
    ),
)
def new_semantic_issues(spark, folder):
    return drift.new_semantic_issues(_events(spark, folder))


@query(
    "semantic_issue_digest",
    _sql(
        """ SELECT monitor, string_agg("table" || '.' || "column" || ' may be ' || likely_type, '; '
            ORDER BY position) FILTER (WHERE position <= 2) AS "lines",
          greatest(0, count(*) - 2) AS more
          FROM (SELECT *, row_number() OVER (PARTITION BY monitor ORDER BY "table", "column") AS position
            FROM events WHERE likely_type IS NOT NULL) GROUP BY monitor"""
    ),
)
def semantic_issue_digest(spark, folder):
    return drift.issue_digest(drift.new_semantic_issues(_events(spark, folder)), limit=2)


# Each event is one check of the user it names; its type and value say what the check found.
HISTORY_SQL = """
history AS (SELECT user_id AS monitor, ts AS checked_at,
  CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS critical,
  CASE WHEN event_type = 'view' THEN CAST(floor("value" / 20) AS INT) ELSE 0 END AS warning,
  CASE WHEN event_type = 'click' THEN 2 ELSE 0 END AS info FROM events),
scored AS (SELECT *, CAST(greatest(0, 100 - 25 * critical - 8 * warning) AS INT) AS health_score FROM history)
"""


def _history(spark, folder) -> DataFrame:
    kind = F.col("event_type")
    checks = table(spark, folder, "events").select(
        F.col("user_id").alias("monitor"),
        F.col("ts").alias("checked_at"),
        F.when(kind == "error", 1).otherwise(0).alias("critical"),
        F.when(kind == "view", F.floor(F.col("value") / 20).cast("int")).otherwise(0).alias("warning"),
        F.when(kind == "click", 2).otherwise(0).alias("info"),
    )
    score = 100 - 25 * F.col("critical") - 8 * F.col("warning")
    return checks.withColumn("health_score", F.greatest(F.lit(0), score).cast("int"))


@query(
    "health_rollup",
    f"""
    WITH {HISTORY_SQL.strip()}
    SELECT monitor, count(*) AS checks_run, CAST(sum(critical + warning + info) AS BIGINT) AS drift_events,
      CAST(sum(critical) AS BIGINT) AS critical_events, CAST(sum(warning) AS BIGINT) AS warning_events,
      round(avg(health_score), 1) AS health_score,
      CASE WHEN sum(critical) > 0 THEN CAST(sum(critical) AS BIGINT) || ' critical changes need attention'
        ELSE 'no action needed' END AS recommendation,
      'mean health ' || format('{{:.1f}}', round(avg(health_score), 1)) AS headline
    FROM scored GROUP BY monitor
    """,
)
def health_rollup(spark, folder):
    return drift.health_rollup(_history(spark, folder))


@query(
    "drift_timeline",
    f"""
    WITH {HISTORY_SQL.strip()}
    SELECT monitor, position, checked_at, critical, warning, info, health_score, position = 1 AS latest
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY monitor ORDER BY checked_at DESC, critical DESC,
        warning DESC, info DESC) AS INT) AS position
      FROM scored) WHERE position <= 50
    """,
)
def drift_timeline(spark, folder):
    return drift.timeline(_history(spark, folder))
