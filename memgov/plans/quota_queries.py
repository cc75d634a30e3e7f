"""Queries over quotas, capacity and throttles."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgov import fixed
from memgov.operators import logs, quota
from memgov.plans import inputs
from memgov.plans.access_queries import _LOG_SQL, _LOGGED_SQL, access_log, log_events
from memgov.plans.catalog import query
from memgov.plans.item_queries import _evidence

HOUR = 3_600_000
# The log is sparse: about fourteen requests an hour per 10,000 rows, so windows are days.
DAY = 24 * HOUR


@query("offered_load", f"""
WITH {inputs.EVENTS_SQL}
SELECT request_id, count(*) OVER (PARTITION BY writer_id ORDER BY ts_ms RANGE BETWEEN {DAY - 1} PRECEDING AND CURRENT ROW) AS offered FROM reqs""")
def offered_load(spark, d):
    return quota.offered_load(inputs.event_requests(spark, d), "writer_id", DAY).select("request_id", "offered")


# Requests of each key numbered in order; the recursion carries the admitted times of the window.
def recursive_sql(numbered: str, limit: int, window: int) -> str:
    return f"""
numbered AS MATERIALIZED ({numbered}),
steps AS (
  SELECT k, n, request_id, true AS admitted, [ts_ms] AS live FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.k, x.n, x.request_id, len(list_filter(s.live, lambda t: t > x.ts_ms - {window})) < {limit},
    CASE WHEN len(list_filter(s.live, lambda t: t > x.ts_ms - {window})) < {limit}
      THEN list_append(list_filter(s.live, lambda t: t > x.ts_ms - {window}), x.ts_ms)
      ELSE list_filter(s.live, lambda t: t > x.ts_ms - {window}) END
  FROM steps s JOIN numbered x ON x.k = s.k AND x.n = s.n + 1)"""


_BY_WRITER = "SELECT writer_id AS k, request_id, ts_ms, row_number() OVER (PARTITION BY writer_id ORDER BY ts_ms, request_id) AS n FROM reqs"


@query("writer_quota", f"""
WITH RECURSIVE {inputs.EVENTS_SQL}, {recursive_sql(_BY_WRITER, 2, DAY)}
SELECT request_id, admitted, CASE WHEN admitted THEN 0 ELSE 86400 END AS retry_after_s FROM steps""")
def writer_quota(spark, d):
    """Two requests per writer and day, refused ones costing nothing."""
    out = quota.admit_quota(inputs.event_requests(spark, d), 2, 0, DAY)
    return out.select("request_id", "admitted", F.coalesce("retry_after_s", F.lit(0)).alias("retry_after_s"))


@query("shared_quota")
def shared_quota(spark, d):
    """A cap per writer and one over all writers, taken together; tested against one ordered pass."""
    out = quota.admit_quota(inputs.event_requests(spark, d), 3, 200, DAY)
    return out.groupBy("admitted").agg(F.count("*").alias("requests"))


@query("unbound_shared_quota", f"""
WITH RECURSIVE {inputs.EVENTS_SQL}, {recursive_sql(_BY_WRITER, 3, DAY)}
SELECT k AS writer_id, count(*) FILTER (WHERE admitted) AS admitted, count(*) FILTER (WHERE NOT admitted) AS refused FROM steps GROUP BY ALL""")
def unbound_shared_quota(spark, d):
    """An overall cap that the load never reaches leaves the writers independent."""
    out = quota.admit_quota(inputs.event_requests(spark, d), 3, 10_000_000, DAY)
    return out.groupBy("writer_id").agg(F.count_if("admitted").alias("admitted"), F.count_if(~F.col("admitted")).alias("refused"))


@query("identity_quota", f"""
WITH RECURSIVE {inputs.EVENTS_SQL},
numbered AS MATERIALIZED (SELECT writer_id AS k, event_type AS f, request_id, ts_ms, row_number() OVER (PARTITION BY writer_id ORDER BY ts_ms, request_id) AS n FROM reqs),
steps AS (
  SELECT k, n, request_id, true AS admitted, [{{'f': f, 't': ts_ms}}] AS live FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.k, x.n, x.request_id,
    len(list_filter(s.live, lambda e: e.t > x.ts_ms - {2 * DAY} AND e.f <> x.f)) < 2 OR len(list_filter(s.live, lambda e: e.t > x.ts_ms - {2 * DAY} AND e.f = x.f)) > 0,
    CASE WHEN len(list_filter(s.live, lambda e: e.t > x.ts_ms - {2 * DAY} AND e.f <> x.f)) < 2 OR len(list_filter(s.live, lambda e: e.t > x.ts_ms - {2 * DAY} AND e.f = x.f)) > 0
      THEN list_append(list_filter(s.live, lambda e: e.t > x.ts_ms - {2 * DAY} AND e.f <> x.f), {{'f': x.f, 't': x.ts_ms}})
      ELSE list_filter(s.live, lambda e: e.t > x.ts_ms - {2 * DAY}) END
  FROM steps s JOIN numbered x ON x.k = s.k AND x.n = s.n + 1)
SELECT request_id, admitted FROM steps""")
def identity_quota(spark, d):
    """At most two different kinds of request per writer in two days."""
    rows = inputs.event_requests(spark, d).withColumnRenamed("writer_id", "scope").withColumnRenamed("event_type", "identity")
    return quota.admit_distinct(rows, 2, 2 * DAY).select("request_id", "admitted")


_ADMIN = f"""SELECT CASE WHEN method = 'GET' THEN 'read' ELSE 'write' END AS k, lpad(event_id::VARCHAR, 12, '0') AS request_id, ts_ms,
  row_number() OVER (PARTITION BY CASE WHEN method = 'GET' THEN 'read' ELSE 'write' END ORDER BY ts_ms, event_id) AS n
  FROM log WHERE route_class = 'admin'"""


@query("admin_budget", f"""
WITH RECURSIVE {_LOG_SQL}, {recursive_sql(_ADMIN, 5, 6 * HOUR)}
SELECT k AS budget, admitted, count(*) AS calls FROM steps GROUP BY ALL""")
def admin_budget(spark, d):
    limits = fixed.TrafficLimits(admin_reads=5, admin_writes=5, window_ms=6 * HOUR)
    calls = access_log(spark, d).filter(F.col("path").startswith("/admin/"))
    return quota.admit_admin(calls, limits).groupBy("budget", "admitted").agg(F.count("*").alias("calls"))


_AUTH = """SELECT CASE WHEN route_class = 'admin' THEN 'admin' ELSE 'router' END AS k, lpad(event_id::VARCHAR, 12, '0') AS request_id, ts_ms,
  row_number() OVER (PARTITION BY CASE WHEN route_class = 'admin' THEN 'admin' ELSE 'router' END ORDER BY ts_ms, event_id) AS n
  FROM log WHERE status = 401"""


@query("auth_failure_budget", f"""
WITH RECURSIVE {_LOG_SQL}, {recursive_sql(_AUTH, 4, 6 * HOUR)}
SELECT request_id, admitted FROM steps""")
def auth_failure_budget(spark, d):
    from memgov.functions.paths import resolve_routes

    failed = resolve_routes(access_log(spark, d)).filter("status = 401").withColumn(
        "route_group", F.when(F.col("route_class") == "admin", "admin").otherwise("router"))
    return quota.admit_keyed(failed, "route_group", 4, 6 * HOUR).select("request_id", "admitted")


@query("charge_routes", """
WITH c AS (SELECT event_id, user_id, event_type, event_id % 3 = 0 AS known, event_id % 5 = 0 AS auth FROM events)
SELECT event_id, CASE WHEN known AND auth THEN 'requarantine:auth-audit' WHEN known THEN 'requarantine'
  WHEN auth THEN 'writes:auth-audit' WHEN event_type = 'click' THEN 'writes:writer:unknown-writer,writes'
  ELSE concat('writes:writer:', user_id, ',writes') END AS budgets FROM c""")
def charge_routes(spark, d):
    n = F.col("event_id")
    rows = inputs.table(spark, d, "events").select(
        "event_id", (n % 3 == 0).alias("known"), F.col("user_id").cast("string").alias("writer_id"),
        F.when(n % 5 == 0, "auth_failed").when(F.col("event_type") == "click", "unknown_writer").otherwise("suspicious_content").alias("reason"))
    budgets = rows.withColumn("b", quota.charge_keys())
    return budgets.select("event_id", F.array_join(F.col("b")["key"], ",").alias("budgets"))


@query("capacity_by_count", """
WITH c AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS t, event_type = 'error' AS free FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) AS r FROM c),
k AS (SELECT * FROM r WHERE free OR r <= 8),
g AS (SELECT event_id, row_number() OVER (ORDER BY t, event_id) AS g FROM k)
SELECT c.event_id, CASE WHEN g.g <= 500 THEN '-' WHEN k.event_id IS NOT NULL THEN 'quarantine_capacity_exceeded'
  ELSE 'quarantine_writer_capacity_exceeded' END AS code
FROM c LEFT JOIN k ON c.event_id = k.event_id LEFT JOIN g ON c.event_id = g.event_id""")
def capacity_by_count(spark, d):
    from memgov.operators.quarantine import ITEM_SCHEMA

    rows = inputs.event_requests(spark, d).select(
        "request_id", "ts_ms", "writer_id", F.lit("suspicious_content").alias("reason"),
        F.when(F.col("event_type") == "error", "security_event").otherwise("retain_request").alias("kind"))
    limits = fixed.QuarantineLimits(pending_items=500, pending_per_writer=8)
    out = quota.admit_counts(rows, spark.createDataFrame([], ITEM_SCHEMA), inputs.at(), limits)
    return out.select(F.col("request_id").cast("long").alias("event_id"), F.coalesce("code", F.lit("-")).alias("code"))


@query("evidence_admission")
def evidence_admission(spark, d):
    """Write budgets and capacity in arrival order; tested against one ordered pass."""
    limits = fixed.QuarantineLimits(
        item_bytes=5_000, pending_items=20_000, pending_per_writer=900, encrypted_bytes=1 << 40,
        writes_per_writer=2, writes_global=40, families=2, requarantine_ops=60, window_ms=DAY)
    rows = _evidence(spark, d).withColumns({"family_scope": F.concat_ws(":", "kind", "reason", "writer_id"), "family": F.col("sha256").substr(1, 1)})
    out = quota.admit_evidence(rows, inputs.items(spark, d), inputs.at(), limits)
    return out.groupBy("kind", F.coalesce("code", F.lit("-")).alias("code")).agg(F.count("*").alias("candidates"))


def throttle_sql(numbered: str, interval: int) -> str:
    return f"""
numbered AS MATERIALIZED ({numbered}),
steps AS (
  SELECT k, n, id, ts_ms AS last, 0 AS held, true AS emitted, 0 AS suppressed FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.k, x.n, x.id, CASE WHEN x.ts_ms - s.last >= {interval} THEN x.ts_ms ELSE s.last END,
    CASE WHEN x.ts_ms - s.last >= {interval} THEN 0 ELSE s.held + 1 END, x.ts_ms - s.last >= {interval},
    CASE WHEN x.ts_ms - s.last >= {interval} THEN s.held ELSE 0 END
  FROM steps s JOIN numbered x ON x.k = s.k AND x.n = s.n + 1)"""


_FREE = "('application_started', 'runtime_message', 'no such event')"
_LOG_KEYS = f"""SELECT concat_ws('|', event, route_class, coalesce(error_kind, 'unexpected')) AS k, event_id AS id, ts_ms,
  row_number() OVER (PARTITION BY event, route_class, coalesce(error_kind, 'unexpected') ORDER BY ts_ms, event_id) AS n
  FROM l WHERE event NOT IN {_FREE}"""


@query("log_throttle", f"""
WITH RECURSIVE {_LOGGED_SQL}, {throttle_sql(_LOG_KEYS, 12 * HOUR)}
SELECT id AS event_id, suppressed::BIGINT AS suppressed FROM steps WHERE emitted
UNION ALL SELECT event_id, 0 FROM l WHERE event IN {_FREE}""")
def log_throttle(spark, d):
    events = logs.sanitize_log_fields(log_events(spark, d)).drop("request_id").withColumnRenamed("rid", "request_id")
    return logs.throttle_log(events, 12 * HOUR).select("event_id", "suppressed")


_NOISE_KEYS = """SELECT event_id % 9 AS k, event_id AS id, (epoch_us(ts) // 1000) AS ts_ms,
  row_number() OVER (PARTITION BY event_id % 9 ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events
  WHERE event_id % 9 IN (0, 1, 8) AND event_type NOT IN ('view', 'click')"""


@query("noise_throttle", f"""
WITH RECURSIVE {throttle_sql(_NOISE_KEYS, 6 * HOUR)}
SELECT id AS event_id, suppressed::BIGINT AS suppressed FROM steps WHERE emitted
UNION ALL SELECT event_id, 0 FROM events WHERE NOT (event_id % 9 IN (0, 1, 8) AND event_type NOT IN ('view', 'click'))""")
def noise_throttle(spark, d):
    from memgov.plans.access_queries import MESSAGES

    rows = inputs.event_requests(spark, d).select(
        "request_id", "ts_ms", inputs.pick(MESSAGES, F.col("request_id").cast("long")).alias("message"),
        F.when(F.col("event_type") == "view", "critical").when(F.col("event_type") == "click", "info").otherwise("warning").alias("level"))
    return logs.throttle_noise(rows, 6 * HOUR).select(F.col("request_id").cast("long").alias("event_id"), "suppressed")


@query("health_transitions", f"""
WITH RECURSIVE p AS (SELECT event_type AS k, event_id AS id, (epoch_us(ts) // 1000) AS ts_ms, value < 12 AS ok,
    row_number() OVER (PARTITION BY event_type ORDER BY (epoch_us(ts) // 1000), event_id) AS n FROM events),
numbered AS MATERIALIZED (SELECT *, n > 1 AND ok = lag(ok) OVER (PARTITION BY k ORDER BY n) AS pair FROM p),
steps AS (
  SELECT k, n, id, NULL::BOOLEAN AS healthy, NULL::BIGINT AS told, NULL::VARCHAR AS transition FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.k, x.n, x.id, CASE WHEN x.pair THEN x.ok ELSE s.healthy END,
    CASE WHEN x.pair AND NOT x.ok AND (s.healthy IS DISTINCT FROM false OR s.told IS NULL OR x.ts_ms - s.told >= {HOUR}) THEN x.ts_ms ELSE s.told END,
    CASE WHEN NOT x.pair THEN NULL WHEN x.ok THEN CASE WHEN s.healthy = false THEN 'recovered' END
      WHEN s.healthy IS DISTINCT FROM false OR s.told IS NULL OR x.ts_ms - s.told >= {HOUR} THEN 'failed' END
  FROM steps s JOIN numbered x ON x.k = s.k AND x.n = s.n + 1)
SELECT id AS event_id, transition FROM steps WHERE transition IS NOT NULL""")
def health_transitions(spark, d):
    probes = inputs.event_requests(spark, d).select(
        "request_id", "ts_ms", F.col("event_type").alias("component"), (F.col("value") < 12).alias("ok"),
        F.when(F.col("value") >= 12, "timeout").alias("error_kind"))
    return quota.health_transitions(probes, HOUR).select(F.col("request_id").cast("long").alias("event_id"), "transition")
