"""Queries that run a stream over a given table to its end and return what its sink holds."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgov.operators.quarantine import ITEM_SCHEMA
from memgov.plans import inputs
from memgov.plans.catalog import query
from memgov.plans.item_queries import _EVIDENCE_SQL, _evidence
from memgov.plans.quota_queries import DAY, HOUR, _BY_WRITER, recursive_sql
from memgov.plans.scan_queries import _DECIDE_SQL
from memgov.session import new_scratch
from memgov.sources.requests import checked_bodies
from memgov.sources.tables import save_items
from memgov.streaming import gate


def _stream(spark, d, name):
    """The table as a file stream."""
    schema = spark.read.parquet(f"{d}/{name}.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/{name}*.parquet")
    return rows.withColumns({c: F.col(c).cast("timestamp") for c, t in rows.dtypes if t == "timestamp_ntz"})


def _requests(spark, d):
    return _stream(spark, d, "events").select(
        F.lpad(F.col("event_id").cast("string"), 12, "0").alias("request_id"), F.col("user_id").cast("string").alias("writer_id"),
        "event_type", F.unix_millis("ts").alias("ts_ms"), "ts")


def _in_turns(frames, path: str, run) -> None:
    """Each frame written in as many files as it has partitions, the stream run to its end after each."""
    for frame in frames:
        frame.write.mode("append").option("compression", "zstd").parquet(path)
        run(frame.sparkSession.readStream.schema(frame.schema).parquet(path)).awaitTermination()


def _disordered(spark, d, label, fold_stream):
    """The fold over events that arrive up to three days late, in parts of six days by arrival.

    A last row of no event, far ahead, moves the watermark past all of them.
    """
    root = new_scratch(spark, label)
    events = inputs.event_requests(spark, d).select("request_id", "writer_id", "event_type", "ts_ms")
    arrival = F.col("ts_ms") + F.pmod(F.xxhash64("request_id"), F.lit(3 * DAY))
    edges = events.agg(F.min("ts_ms"), F.max("ts_ms")).first()
    last = events.limit(0)
    parts = []
    if edges[0] is not None:
        parts = [events.filter(F.floor((arrival - edges[0]) / (6 * DAY)) == k) for k in range((edges[1] + 3 * DAY - edges[0]) // (6 * DAY) + 1)]
        ahead = edges[1] + 60 * DAY
        last = spark.range(1).select(F.lit("").alias("request_id"), F.lit("").alias("writer_id"), F.lit("").alias("event_type"), F.lit(ahead).alias("ts_ms"))
    _in_turns([*parts, last], f"{root}/in", lambda rows: gate.write_once(
        fold_stream(rows), f"{root}/out", f"{root}/checkpoint", settle=True))
    return spark.read.parquet(f"{root}/out")


def _finish(stream, spark, label):
    """Run to the end and read the sink."""
    root = new_scratch(spark, label)
    gate.write_once(stream, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("stream_writer_quota", f"""
WITH RECURSIVE {inputs.EVENTS_SQL}, {recursive_sql(_BY_WRITER, 2, DAY)} SELECT request_id, admitted FROM steps""")
def stream_writer_quota(spark, d):
    """The stream admits what the batch admits."""
    out = _finish(gate.stream_quota(_requests(spark, d), 2, DAY), spark, "stream-quota")
    return out.select("request_id", F.col("verdict").alias("admitted"))


_THROTTLE_SQL = f"""
WITH RECURSIVE {inputs.EVENTS_SQL},
numbered AS MATERIALIZED (SELECT event_type AS k, request_id AS id, ts_ms, row_number() OVER (PARTITION BY event_type ORDER BY ts_ms, request_id) AS n FROM reqs),
steps AS (
  SELECT k, n, id, ts_ms AS last, 0 AS held, true AS emitted, 0 AS suppressed FROM numbered WHERE n = 1
  UNION ALL
  SELECT x.k, x.n, x.id, CASE WHEN x.ts_ms - s.last >= {2 * HOUR} THEN x.ts_ms ELSE s.last END,
    CASE WHEN x.ts_ms - s.last >= {2 * HOUR} THEN 0 ELSE s.held + 1 END, x.ts_ms - s.last >= {2 * HOUR},
    CASE WHEN x.ts_ms - s.last >= {2 * HOUR} THEN s.held ELSE 0 END
  FROM steps s JOIN numbered x ON x.k = s.k AND x.n = s.n + 1)
SELECT id AS request_id, suppressed::BIGINT AS suppressed FROM steps WHERE emitted"""


@query("stream_log_throttle", _THROTTLE_SQL)
def stream_log_throttle(spark, d):
    out = gate.stream_throttle(_requests(spark, d), F.col("event_type"), F.lit(False), 2 * HOUR)
    return _finish(out, spark, "stream-throttle").select("request_id", "suppressed")


@query("stream_quota_disordered", f"""
WITH RECURSIVE {inputs.EVENTS_SQL}, {recursive_sql(_BY_WRITER, 2, DAY)} SELECT request_id, admitted FROM steps""")
def stream_quota_disordered(spark, d):
    """Requests of one window spread over several micro-batches in wrong order get the verdicts of the batch."""
    out = _disordered(spark, d, "stream-quota", lambda rows: gate.stream_quota(rows, 2, DAY, "4 days"))
    return out.select("request_id", F.col("verdict").alias("admitted"))


@query("stream_throttle_disordered", _THROTTLE_SQL)
def stream_throttle_disordered(spark, d):
    """The same of the log throttle."""
    out = _disordered(spark, d, "stream-throttle", lambda rows: gate.stream_throttle(rows, F.col("event_type"), F.lit(False), 2 * HOUR, "4 days"))
    return out.select("request_id", "suppressed")


@query("stream_first_seen", """
SELECT DISTINCT user_id::VARCHAR AS writer_id, event_type FROM events""")
def stream_first_seen(spark, d):
    rows = gate.stream_dedupe(_requests(spark, d), ["writer_id", "event_type"], "ts", "60 days")
    return _finish(rows, spark, "stream-dedupe").select("writer_id", "event_type")


@query("stream_gate", f"""
WITH {_DECIDE_SQL} SELECT request_id, coalesce(reason, '-') AS reason FROM decided""")
def stream_gate(spark, d):
    """The request stream split into allowed and refused folders."""
    turns = _stream(spark, d, "conversations")
    requests = checked_bodies(inputs.requests_of_turns(turns)).select("request_id", "writer_id", "op", "body", "parse_error")
    root = new_scratch(spark, "stream-gate")
    gate.stream_gate(requests, inputs.writers(spark, d), f"{root}/allowed", f"{root}/refused", f"{root}/checkpoint").awaitTermination()
    allowed, refused = (spark.read.parquet(f"{root}/{side}") for side in ("allowed", "refused"))
    return allowed.unionByName(refused).select("request_id", F.coalesce("reason", F.lit("-")).alias("reason"))


@query("stream_candidates", f"""
WITH {_DECIDE_SQL} SELECT request_id, reason, coalesce(write_bank, '-') AS target_bank FROM decided WHERE reason IS NOT NULL""")
def stream_candidates(spark, d):
    """The evidence that the gate writes beside its allowed and refused requests, from the same decisions."""
    turns = _stream(spark, d, "conversations")
    requests = checked_bodies(inputs.requests_of_turns(turns)).select(
        "request_id", "writer_id", "op", "body", "parse_error", F.lit("2024-01-01T00:00:00.000Z").alias("at"))
    root = new_scratch(spark, "stream-candidates")
    gate.stream_gate(requests, inputs.writers(spark, d), f"{root}/allowed", f"{root}/refused", f"{root}/checkpoint", f"{root}/candidates").awaitTermination()
    return spark.read.parquet(f"{root}/candidates").select("request_id", "reason", F.coalesce("target_bank", F.lit("-")).alias("target_bank"))


def _merged_stream(spark, d) -> str:
    """The evidence of line items merged in three micro-batches, in the order of time."""
    root = new_scratch(spark, "stream-quarantine")
    save_items(inputs.items(spark, d), f"{root}/items/version={0:012d}")
    candidates = _evidence(spark, d)
    parts = [candidates.filter(F.year("at").between(a, b)) for a, b in ((0, 1996), (1997, 1998), (1999, 9999))]
    _in_turns(parts, f"{root}/candidates", lambda rows: gate.stream_quarantine(
        rows, root, f"{root}/checkpoint", at=inputs.at(), keep_versions=False))
    return root


@query("stream_conflicts", f"""
WITH {_EVIDENCE_SQL} SELECT old_id AS quarantine_id, n::BIGINT AS n,
  CASE WHEN action = 'conflict_request' THEN 'quarantine_request_in_review' ELSE 'quarantine_item_in_review' END AS code
FROM acts WHERE action LIKE 'conflict%'""")
def stream_conflicts(spark, d):
    """What the merged stream could not merge, over all micro-batches."""
    rows = spark.read.parquet(f"{_merged_stream(spark, d)}/conflicts")
    return rows.groupBy("quarantine_id", "code").agg(F.sum("n").cast("long").alias("n"))


@query("stream_late_rows", """
WITH edges AS (SELECT g, max(max(ts)) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen
  FROM (SELECT ts, event_id % 3 AS g FROM events) GROUP BY g)
SELECT event_id, coalesce(ts < seen - INTERVAL 10 DAY, false) AS late FROM events JOIN edges ON event_id % 3 = g""")
def stream_late_rows(spark, d):
    """Events arriving in three parts that overlap in time; those ten days behind are set aside."""
    root = new_scratch(spark, "stream-late")
    events = inputs.table(spark, d, "events").select("event_id", "ts")
    _in_turns([events.filter(F.col("event_id") % 3 == k) for k in range(3)], f"{root}/events",
              lambda rows: gate.stream_on_time(rows, "ts", 10 * 24 * 3600, root, f"{root}/checkpoint"))
    sides = [spark.read.schema("event_id long, ts timestamp").parquet(f"{root}/{side}").select("event_id", F.lit(side == "late").alias("late"))
             for side in ("on_time", "late")]
    return sides[0].unionByName(sides[1])


@query("stream_quarantine", f"""
WITH {_EVIDENCE_SQL}
SELECT status, count(*) AS items, sum(requarantine_count)::BIGINT AS repeats FROM (
  SELECT CASE WHEN action = 'refresh' THEN status ELSE 'pending' END AS status,
    coalesce(requarantine_count, 0) + n - CASE WHEN action = 'insert' THEN 1 ELSE 0 END AS requarantine_count
  FROM acts WHERE action NOT LIKE 'conflict%'
  UNION ALL SELECT i.status, i.requarantine_count FROM items i WHERE i.o_orderkey NOT IN
    (SELECT l_orderkey FROM acts WHERE returned AND action NOT LIKE 'conflict%')) GROUP BY ALL""")
def stream_quarantine(spark, d):
    """Evidence merged into the item table batch by batch, replays being harmless."""
    root = _merged_stream(spark, d)
    latest = spark.read.parquet(f"{root}/items").agg(F.max("version")).first()[0]
    final = spark.read.schema(ITEM_SCHEMA).parquet(f"{root}/items/version={latest:012d}")
    return final.groupBy("status").agg(F.count("*").alias("items"), F.sum("requarantine_count").alias("repeats"))


@query("late_requests", """
SELECT ts < TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 10 MINUTE AS late, count(*) AS requests FROM events GROUP BY ALL""")
def late_requests(spark, d):
    rows = inputs.event_requests(spark, d)
    on_time, late = gate.split_late(rows, "ts", F.lit("2024-01-20").cast("timestamp"), 600)
    both = on_time.withColumn("late", F.lit(False)).unionByName(late.withColumn("late", F.lit(True)))
    return both.groupBy("late").agg(F.count("*").alias("requests"))
