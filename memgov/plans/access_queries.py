"""Queries over access logs and log events."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgov.functions import identity, paths
from memgov.operators import logs, policy
from memgov.plans import inputs
from memgov.plans.catalog import query

# (method, path template around a segment ~, operation, route class)
CALLS = (
    ("POST", "/v1/default/banks/~/memories", "retain", "memory"),
    ("POST", "/v1/default/banks/~/memories/recall", "recall", "memory"),
    ("PUT", "/v1/default/banks/~", "bank", "facade"),
    ("PATCH", "/v1/default/banks/~/config", "config", "facade"),
    ("GET", "/v1/default/banks/~/mental-models", "mental-models.list", "facade"),
    ("POST", "/v1/default/banks/~/mental-models", "mental-models.create", "facade"),
    ("DELETE", "/v1/default/banks/w/mental-models/~", "mental-models.delete", "facade"),
    ("POST", "/v1/default/banks/~/reflect", "reflect", "facade"),
    ("GET", "/admin/quarantine/queue", "queue", "admin"),
    ("GET", "/admin/quarantine/items/~", "read_item", "admin"),
    ("POST", "/admin/quarantine/items/~/approve", "approve", "admin"),
    ("POST", "/admin/quarantine/cleanup", "cleanup", "admin"),
    ("POST", "/admin/none/~", "admin_not_found", "admin"),
    ("GET", "/version", "version", "version"),
    ("GET", "/health/ready", "denied", "readiness"),
    ("GET", "/health/live", "denied", "liveness"),
    ("GET", "/v1/default/banks/~/memories", "denied", "memory"),
    ("TRACE", "/Files/~/", "denied", "unmatched"),
    ("GET", "/v1/x/../default/banks/~/./mental-models", "mental-models.list", "facade"),
    ("PUT", "/v1/default/%2e%2E/default/banks/~/memories/..", "denied", "facade"),
)
N = len(CALLS)
_STATUS = (200, 401, 404, 200, 429)


def access_log(spark, d):
    """Events as calls: the user is the path segment, the event number picks method and path."""
    n = F.col("event_id")
    path = F.replace(inputs.pick(tuple(c[1] for c in CALLS), n), F.lit("~"), F.concat(F.lit("u%20"), F.col("user_id").cast("string")))
    status = F.get(F.array(*map(F.lit, _STATUS)), (n % 5).cast("int"))
    return inputs.table(spark, d, "events").select(
        "event_id", F.lpad(n.cast("string"), 12, "0").alias("request_id"), "user_id",
        inputs.pick(tuple(c[0] for c in CALLS), n).alias("method"), path.alias("path"), status.alias("status"),
        F.unix_millis("ts").alias("ts_ms"), (n % 4 == 0).alias("token_recognized"))


_LOG_SQL = f"""
log AS (SELECT event_id, user_id, (epoch_us(ts) // 1000) AS ts_ms, {inputs.sql_pick(tuple(c[0] for c in CALLS), 'event_id')} AS method,
    {inputs.sql_pick(tuple(c[1] for c in CALLS), 'event_id')} AS template, {inputs.sql_pick(tuple(c[2] for c in CALLS), 'event_id')} AS operation,
    {inputs.sql_pick(tuple(c[3] for c in CALLS), 'event_id')} AS route_class,
    ({list(_STATUS)})[event_id % 5 + 1]::INT AS status, event_id % 4 = 0 AS token_recognized FROM events)"""


@query("route_resolution", f"""
WITH {_LOG_SQL}
SELECT event_id, operation, route_class,
  CASE WHEN operation IN ('denied','queue','cleanup','admin_not_found','version','read_item','approve') THEN '-'
    WHEN operation = 'mental-models.delete' THEN 'w' ELSE concat('u ', user_id) END AS writer_id,
  CASE WHEN operation IN ('read_item','approve','mental-models.delete') THEN concat('u ', user_id) ELSE '-' END AS item_id,
  CASE WHEN route_class <> 'admin' THEN '-' WHEN method = 'GET' THEN 'read' WHEN operation = 'cleanup' THEN 'cleanup' ELSE 'review' END AS admin_scope
FROM log""")
def route_resolution(spark, d):
    out = paths.resolve_routes(access_log(spark, d))
    cols = [F.coalesce(c, F.lit("-")).alias(c) for c in ("writer_id", "item_id", "admin_scope")]
    return out.select("event_id", "operation", "route_class", *cols)


@query("route_report", f"""
WITH {_LOG_SQL} SELECT route_class, status, count(*) AS requests FROM log GROUP BY ALL""")
def route_report(spark, d):
    return logs.route_report(access_log(spark, d))


@query("page_paths", """
WITH p AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path, url FROM pages)
SELECT page_id, path AS normalized, concat('GET:', CASE WHEN rtrim(lower(path), '/') = '' THEN '/' ELSE rtrim(lower(path), '/') END) AS event_key,
  CASE WHEN page_id % 2 = 0 THEN concat('é', path) ELSE '-' END AS decoded FROM p""")
def page_paths(spark, d):
    """Page paths with dot segments put in, an event key of the full path, and percent escapes."""
    page = inputs.table(spark, d, "pages").withColumn("tail", F.regexp_extract("url", "^https?://[^/]+(.*)$", 1))
    bare = F.regexp_replace("tail", "[?#].*", "")
    dotted = F.concat(F.lit("/x/../%2E/."), bare)
    coded = F.concat(F.when(F.col("page_id") % 2 == 0, "%C3%A9").otherwise("%C3"), F.replace(bare, F.lit("/"), F.lit("%2F")))
    return page.select("page_id", paths.normalize_path(dotted).alias("normalized"),
                       identity.security_event_key(F.lit("get"), F.col("tail")).alias("event_key"),
                       F.coalesce(paths.decode_segment(coded), F.lit("-")).alias("decoded"))


_DENIED_SQL = f"""
{_LOG_SQL},
denied AS (SELECT *, concat('anonymous:', method, ':', CASE WHEN template LIKE '/health%' THEN template
    WHEN template LIKE '/Files%' THEN concat('/files/u%20', user_id)
    WHEN template LIKE '/v1/default/\\%%' ESCAPE '\\' THEN concat('/v1/default/banks/u%20', user_id)
    ELSE concat('/v1/default/banks/u%20', user_id, '/memories') END) AS scoped FROM log WHERE operation = 'denied'),
seen AS (SELECT scoped, row_number() OVER (ORDER BY min(ts_ms), scoped) AS r FROM denied GROUP BY scoped)"""


@query("denied_endpoints", f"""
WITH {_DENIED_SQL}
SELECT CASE WHEN r <= 64 THEN scoped ELSE 'aggregate' END AS dedupe_key, count(*) AS calls FROM denied JOIN seen USING (scoped) GROUP BY ALL""")
def denied_endpoints(spark, d):
    log = access_log(spark, d)
    resolved = policy.denied_endpoints(log.drop("writer_id"))
    return resolved.groupBy("dedupe_key").agg(F.count("*").alias("calls"))


@query("auth_failures", f"""
WITH {_LOG_SQL}
SELECT CASE WHEN route_class = 'admin' THEN 'admin' ELSE 'router' END AS route_group, count(*) AS failures,
  min(ts_ms) AS first_ms, max(ts_ms) AS last_ms FROM log WHERE status = 401 AND NOT token_recognized GROUP BY ALL""")
def auth_failures(spark, d):
    return policy.auth_failures(access_log(spark, d)).select("route_group", "failures", "first_ms", "last_ms")


FACADE_STEPS = ("known_writer", "request_safe", "bound", "admitted", "upstream", "response_safe", "response_ok")


@query("facade_decisions", """
WITH c AS (SELECT event_id, event_id % 8 AS n FROM events)
SELECT event_id, (['unknown_writer','suspicious_content','recall_query_too_large','rate_limited','timeout',
    'upstream_unsafe_response','upstream_invalid_response','-'])[n + 1] AS code,
  ([404, 422, 413, 429, 504, 502, 502, 200])[n + 1]::INT AS http_status,
  (['facade_unknown_writer','facade_suspicious_request','-','-','-','facade_suspicious_response','-','-'])[n + 1] AS audit_reason FROM c""")
def facade_decisions(spark, d):
    """Calls that fail at step n and at every later step: the first failure decides."""
    return _facade(spark, d).select("event_id", F.coalesce("code", F.lit("-")).alias("code"), "http_status",
                                    F.coalesce("audit_reason", F.lit("-")).alias("audit_reason"))


def _facade(spark, d):
    n = F.col("event_id") % 8
    calls = inputs.table(spark, d, "events").select(
        "event_id", F.col("user_id").cast("string").alias("writer_id"), (n != 0).alias("known_writer"), (n > 1).alias("request_safe"),
        F.when(n <= 2, "recall_query_too_large").alias("bound_code"), (n > 3).alias("admitted"),
        F.when(n <= 4, "timeout").alias("upstream_kind"), (n > 5).alias("response_safe"), (n > 6).alias("response_ok"),
        F.col("props").alias("evidence"))
    return policy.decide_facade(calls)


@query("facade_audit_rows", """
SELECT event_id, concat((['facade_unknown_writer','facade_suspicious_request','','','','facade_suspicious_response'])[event_id % 8 + 1],
  ':', user_id, ':', sha256(replace(props, ': ', ':'))) AS dedupe_key FROM events WHERE event_id % 8 IN (0, 1, 5)""")
def facade_audit_rows(spark, d):
    return policy.facade_audit(_facade(spark, d)).select("event_id", "dedupe_key")


LOGGED = ("bank_unavailable", "request_failed", "runtime_message", "no such event", "application_started",
          "quarantine_write_unavailable", "authentication_failed")


def log_events(spark, d):
    """Events as log records; some names, fields and values break the contract."""
    n = F.col("event_id")
    return inputs.table(spark, d, "events").select(
        "event_id", F.lpad(n.cast("string"), 12, "0").alias("rid"), inputs.pick(LOGGED, n).alias("event"),
        F.lit("warning").alias("level"), F.lit("app.main").alias("logger"),
        F.when(n % 13 == 0, "bad kind").when(n % 3 == 0, "timeout").when(n % 3 == 1, "http").alias("error_kind"),
        F.when(n % 5 == 0, "oops").otherwise("failed").alias("outcome"),
        F.when(n % 2 == 0, "server_started").otherwise("else").alias("reason"),
        F.lit(None).cast("string").alias("error_fingerprint"),
        F.when(n % 7 == 0, "bad id!").otherwise(F.concat(F.lit("r-"), n.cast("string"))).alias("request_id"),
        F.when(n % 11 == 0, F.concat(F.lit("w é"), F.col("user_id").cast("string"))).otherwise(F.col("user_id").cast("string")).alias("writer_id"),
        F.when(n % 2 == 0, "memory").otherwise("nowhere").alias("route_class"),
        F.when(n % 2 == 0, "recall").otherwise("dance").alias("operation"), F.lit("post").alias("request_method"),
        F.when(n % 4 == 0, -1).otherwise(n.cast("int")).alias("http_status"),
        F.when(n % 6 == 0, F.lit("NaN").cast("double")).otherwise(F.lit(1.5)).alias("request_duration_ms"),
        F.unix_millis("ts").alias("ts_ms"), (n % 17 == 0).alias("reserved"))


_LOGGED_SQL = f"""
l AS (SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms, user_id, {inputs.sql_pick(LOGGED, 'event_id')} AS event,
    CASE WHEN event_id % 13 = 0 THEN 'unexpected' WHEN event_id % 3 = 0 THEN 'timeout' WHEN event_id % 3 = 1 THEN 'http' END AS error_kind,
    CASE WHEN event_id % 2 = 0 THEN 'memory' ELSE 'unmatched' END AS route_class FROM events)"""


@query("event_contract", f"""
WITH {_LOGGED_SQL}
SELECT event_id, CASE WHEN event = 'no such event' OR event_id % 17 = 0 THEN 'logging_contract_violation' ELSE event END AS event,
  CASE WHEN event = 'no such event' OR event_id % 17 = 0 THEN 'error' ELSE 'warning' END AS level,
  CASE WHEN event_id % 17 = 0 THEN 'reserved-field' WHEN event = 'no such event' THEN 'unregistered-event'
    WHEN event_id % 2 = 0 THEN 'server_started' ELSE 'else' END AS reason,
  CASE WHEN event = 'no such event' OR event_id % 17 = 0 THEN concat('site:', sha256('app.main')[1:16]) ELSE '-' END AS error_fingerprint
FROM l""")
def event_contract(spark, d):
    out = logs.apply_event_contract(log_events(spark, d), reserved="reserved")
    return out.select("event_id", "event", "level", "reason", F.coalesce("error_fingerprint", F.lit("-")).alias("error_fingerprint"))


@query("safe_log_fields", f"""
WITH {_LOGGED_SQL}
SELECT event_id, coalesce(error_kind, '-') AS error_kind, 'failed' AS outcome,
  CASE WHEN event_id % 2 = 0 THEN 'server-started' ELSE 'runtime-other' END AS reason,
  CASE WHEN event_id % 7 = 0 THEN '-' ELSE concat('r-', event_id) END AS request_id,
  CASE WHEN event_id % 11 = 0 THEN concat('writer:', sha256(concat('w é', user_id))[1:16]) ELSE user_id::VARCHAR END AS writer_id,
  route_class, CASE WHEN event_id % 2 = 0 THEN 'recall' ELSE '-' END AS operation, 'POST' AS request_method,
  CASE WHEN event_id % 4 = 0 THEN -9 ELSE event_id END::INT AS http_status, event_id % 6 <> 0 AS has_duration FROM l""")
def safe_log_fields(spark, d):
    out = logs.sanitize_log_fields(log_events(spark, d))
    texts = [F.coalesce(c, F.lit("-")).alias(c) for c in ("error_kind", "outcome", "reason", "request_id", "writer_id",
                                                          "route_class", "operation", "request_method")]
    return out.select("event_id", *texts, F.coalesce("http_status", F.lit(-9)).alias("http_status"),
                      F.col("request_duration_ms").isNotNull().alias("has_duration"))


@query("log_lines", f"""
WITH {_LOGGED_SQL}
SELECT concat('{{"error_kind":"', error_kind, '","event":"', event, '","route_class":"', route_class, '"}}') AS value FROM l
WHERE error_kind IS NOT NULL
UNION ALL SELECT concat('{{"event":"', event, '","route_class":"', route_class, '"}}') FROM l WHERE error_kind IS NULL""")
def log_lines(spark, d):
    from memgov.sources.tables import log_lines as lines

    return lines(logs.sanitize_log_fields(log_events(spark, d)).select("event", "route_class", "error_kind"))


MESSAGES = ("Invalid HTTP request received.", "Exception in ASGI application", "Started server process [1]",
            "Uvicorn running on x", "Waiting for application startup.", "Shutting down", "Application shutdown complete.",
            "Finished server process [1]", "something else")
REASON_OF = ("http-protocol-error", "asgi-application-error", "server-started", "server-running", "application-startup",
             "server-stopping", "application-shutdown", "server-finished", "runtime-other")


@query("runtime_reasons", f"""
SELECT {inputs.sql_pick(REASON_OF, 'event_id')} AS reason, event_type, count(*) AS n FROM events GROUP BY ALL""")
def runtime_reasons(spark, d):
    events = inputs.table(spark, d, "events")
    message = F.concat_ws(" ", inputs.pick(MESSAGES, F.col("event_id")), "event_type")
    return events.groupBy(logs.runtime_reason(message).alias("reason"), "event_type").agg(F.count("*").alias("n"))


@query("degradations", """
SELECT event_id, (['capacity','capacity','rate-limit','payload-too-large','conflict','conflict','odd'])[event_id % 7 + 1] AS error_kind,
  CASE WHEN event_id % 2 = 0 THEN 'error' ELSE 'warning' END AS level FROM events""")
def degradations(spark, d):
    codes = ("quarantine_capacity_exceeded", "quarantine_writer_capacity_exceeded", "quarantine_rate_limited",
             "quarantine_item_too_large", "quarantine_request_in_review", "quarantine_item_in_review", "odd")
    n = F.col("event_id")
    rows = inputs.table(spark, d, "events").select(
        "event_id", inputs.pick(codes, n).alias("code"),
        F.when(n % 2 == 0, "recall_supplemental_audit_unavailable").otherwise("quarantine_write_unavailable").alias("event"))
    return policy.map_degradation(rows).select("event_id", "error_kind", "level")


@query("operations_report", f"""
WITH {inputs.ITEMS_SQL}, {_LOGGED_SQL}
SELECT event AS metric, coalesce(error_kind, '-') AS label, count(*) AS value FROM l
  WHERE event IN ('bank_unavailable', 'quarantine_write_unavailable', 'request_failed') GROUP BY ALL
UNION ALL SELECT 'quarantine_items', status, count(*) FROM items GROUP BY ALL
UNION ALL SELECT 'stuck_side_effects', status, count(*) FROM items WHERE status IN ('review_side_effect_started', 'review_side_effect_completed')
  AND updated_at <= TIMESTAMP '{inputs.AT}' - INTERVAL 1 HOUR GROUP BY ALL""")
def operations_report(spark, d):
    events = logs.sanitize_log_fields(log_events(spark, d))
    return logs.ops_report(events, inputs.items(spark, d), inputs.at())
