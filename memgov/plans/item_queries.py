"""Queries over quarantine items, events, merges, reviews and maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgov.operators import quarantine, review, routing
from memgov.plans import inputs
from memgov.plans.catalog import query
from memgov.plans.scan_queries import _DECIDE_SQL
from memgov.streaming.gate import run_maintenance

_AT = f"TIMESTAMP '{inputs.AT}'"
_OPEN = "status IN ('pending', 'postponed')"
_PAST = f"coalesce(expires_at <= {_AT}, false)"
_LIVE = f"({_OPEN} AND NOT {_PAST})"
_SCOPE = """CASE WHEN reason = 'unknown_writer' THEN 'unknown' WHEN writer_id IS NOT NULL THEN concat('writer:', writer_id)
  ELSE concat('kind:', kind) END"""
_W = f"WITH {inputs.ITEMS_SQL}"


@query("quarantine_stats", f"""
{_W} SELECT count(*) AS total_items, count(*) FILTER (WHERE {_LIVE} AND status = 'pending') AS pending_items,
  count(*) FILTER (WHERE {_LIVE} AND status = 'postponed') AS postponed_items,
  count(*) FILTER (WHERE {_OPEN} AND {_PAST}) AS expired_items,
  count(*) FILTER (WHERE status = 'reviewed_allowed') AS reviewed_allowed_items,
  count(*) FILTER (WHERE status = 'reviewed_blocked') AS reviewed_blocked_items,
  coalesce(sum(encrypted_bytes) FILTER (WHERE NOT ({_OPEN} AND {_PAST})), 0)::BIGINT AS encrypted_bytes,
  (SELECT count(*) FROM lineitem) AS event_count FROM items""")
def quarantine_stats(spark, d):
    return quarantine.quarantine_stats(inputs.items(spark, d), inputs.item_events(spark, d), inputs.at())


@query("queue_total", f"{_W} SELECT count(*) FILTER (WHERE {_LIVE}) AS total FROM items")
def queue_total(spark, d):
    return quarantine.queue_total(inputs.items(spark, d), inputs.at())


@query("capacity_totals", f"""
{_W} SELECT count(*) FILTER (WHERE {_LIVE}) AS pending_count,
  coalesce(sum(encrypted_bytes) FILTER (WHERE NOT ({_OPEN} AND {_PAST})), 0)::BIGINT AS encrypted_bytes FROM items""")
def capacity_totals(spark, d):
    return quarantine.capacity_totals(inputs.items(spark, d), inputs.at())


@query("scoped_pending", f"{_W} SELECT {_SCOPE} AS scope, count(*) AS pending FROM items WHERE {_LIVE} GROUP BY ALL")
def scoped_pending(spark, d):
    return quarantine.scoped_pending(inputs.items(spark, d), inputs.at())


_CLEAN = ["unknown_writer", "denied_endpoint"]
_CLEAN_SQL = "reason IN ('unknown_writer', 'denied_endpoint') AND created_at < TIMESTAMP '2000-01-01'"


def _older():
    return F.lit("2000-01-01 00:00:00").cast("timestamp")


@query("cleanup_preview", f"""
{_W} SELECT 'pending' AS scope, count(*) AS count, coalesce(sum(encrypted_bytes), 0)::BIGINT AS encrypted_bytes FROM items
  WHERE {_OPEN} AND {_CLEAN_SQL}
UNION ALL SELECT 'all', count(*), coalesce(sum(encrypted_bytes), 0)::BIGINT FROM items
  WHERE status NOT IN ('review_in_progress', 'review_side_effect_started', 'review_side_effect_completed',
    'reviewed_allowed', 'reviewed_blocked')""")
def cleanup_preview(spark, d):
    items = inputs.items(spark, d)
    some = quarantine.preview_cleanup(items, quarantine.cleanup_selector("pending", _CLEAN, _older()))
    every = quarantine.preview_cleanup(items, quarantine.cleanup_selector("all"))
    return some.withColumn("scope", F.lit("pending")).unionByName(every.withColumn("scope", F.lit("all")))


@query("cleanup_run", f"""
{_W} SELECT 'kept' AS side, status AS label, count(*) AS n FROM items WHERE NOT ({_OPEN} AND {_CLEAN_SQL}) GROUP BY status
UNION ALL SELECT 'event', 'cleanup', count(*) FROM items WHERE {_OPEN} AND {_CLEAN_SQL}""")
def cleanup_run(spark, d):
    items = inputs.items(spark, d)
    selector = quarantine.cleanup_selector("pending", _CLEAN, _older())
    expected = quarantine.preview_cleanup(items, selector).first()["count"]
    done = review.run_cleanup(items, inputs.at(), "cleanup", "pending", _CLEAN, _older(), expected)
    return _sides(done)


@query("queue_page", f"""
{_W} SELECT quarantine_id, status FROM items WHERE {_LIVE} ORDER BY created_at, quarantine_id LIMIT 100 OFFSET 50""")
def queue_page(spark, d):
    return quarantine.queue_page(inputs.items(spark, d), inputs.at(), 100, 50).select("quarantine_id", "status")


@query("reviewable_items", f"{_W} SELECT quarantine_id, status, reason FROM items WHERE {_LIVE}")
def reviewable_items(spark, d):
    return quarantine.reviewable(inputs.items(spark, d), inputs.at()).select("quarantine_id", "status", "reason")


@query("item_summaries", f"""
{_W} SELECT quarantine_id, concat_ws(',', 'quarantine_id', 'created_at', 'updated_at', 'kind', 'reason',
  CASE WHEN writer_id IS NOT NULL THEN 'writer_id' END, 'source', CASE WHEN source_bank IS NOT NULL THEN 'source_bank' END,
  CASE WHEN source_memory_id IS NOT NULL THEN 'source_memory_id' END, CASE WHEN dedupe_key IS NOT NULL THEN 'dedupe_key' END,
  'sha256', 'status', 'postpone_count', 'requarantine_count') AS shown, reason FROM items""")
def item_summaries(spark, d):
    out = quarantine.item_summary(inputs.items(spark, d))
    return out.select("quarantine_id", F.array_join(F.json_object_keys("summary"), ",").alias("shown"),
                      F.get_json_object("summary", "$.reason").alias("reason"))


@query("item_read_view", f"""
{_W} SELECT quarantine_id, o_orderkey::VARCHAR AS sealed, postpone_count::INT AS postpone_count FROM items WHERE o_orderstatus <> 'F'""")
def item_read_view(spark, d):
    out = quarantine.read_items(inputs.items(spark, d))
    return out.select("quarantine_id", F.variant_get("encrypted", "$.sha256", "string").alias("sealed"), "postpone_count")


@query("expired_batch", f"""
{_W} SELECT quarantine_id, epoch_ms(expires_at) AS expires_ms FROM items WHERE {_OPEN} AND {_PAST}
ORDER BY expires_at, quarantine_id LIMIT 1000""")
def expired_batch(spark, d):
    out = review.expired_batch(inputs.items(spark, d), inputs.at(), 1000)
    return out.select("quarantine_id", F.unix_millis("expires_at").alias("expires_ms"))


@query("expiry_sweep", f"""
{_W} SELECT 'kept' AS side, status AS label, count(*) AS n FROM items WHERE NOT ({_OPEN} AND {_PAST}) GROUP BY status
UNION ALL SELECT 'event', 'cleanup', count(*) FROM items WHERE {_OPEN} AND {_PAST}""")
def expiry_sweep(spark, d):
    done = review.sweep_expired(inputs.items(spark, d), inputs.at(), "sweep")
    return _sides(done)


def _sides(done):
    kept = done.items.groupBy(F.lit("kept").alias("side"), F.col("status").alias("label")).agg(F.count("*").alias("n"))
    events = done.events.groupBy(F.lit("event").alias("side"), F.col("event_type").alias("label")).agg(F.count("*").alias("n"))
    return kept.unionByName(events)


_STALE = f"(status = 'review_in_progress' AND updated_at <= {_AT} - INTERVAL 60 SECOND)"


@query("stale_claims", f"""
{_W}, s AS (SELECT *, {_STALE} AS hit, {_PAST} AS past FROM items)
SELECT 'kept' AS side, CASE WHEN hit THEN 'postponed' ELSE status END AS label, count(*) AS n FROM s WHERE NOT (hit AND past) GROUP BY ALL
UNION ALL SELECT 'event', CASE WHEN past THEN 'expired' ELSE 'review_interrupted' END, count(*) FROM s WHERE hit GROUP BY ALL""")
def stale_claims(spark, d):
    return _sides(review.recover_stale(inputs.items(spark, d), inputs.at(), "recover"))


@query("event_retention", """
SELECT 'kept' AS side, count(*) AS n FROM lineitem WHERE NOT l_shipdate < TIMESTAMP '1998-01-01'
UNION ALL SELECT 'pruned', count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01'""")
def event_retention(spark, d):
    cutoff = F.lit("1998-01-01").cast("timestamp")
    out = review.prune_events(inputs.item_events(spark, d), cutoff, inputs.at(), "prune")
    summary = F.col("event_type") == "retention_pruned"
    n = F.coalesce(F.max(F.when(summary, F.get_json_object("details", "$.pruned_events").cast("long"))), F.lit(0))
    return out.agg(F.count_if(~summary).alias("kept"), n.alias("pruned")).select(
        F.explode(F.map_from_arrays(F.array(F.lit("kept"), F.lit("pruned")), F.array("kept", "pruned"))).alias("side", "n"))


@query("maintenance_run", f"""
{_W}, s AS (SELECT *, {_STALE} AS hit, {_PAST} AS past FROM items)
SELECT 'kept' AS side, CASE WHEN hit THEN 'postponed' ELSE status END AS label, count(*) AS n FROM s
  WHERE NOT (hit AND past) AND NOT ({_OPEN} AND past) GROUP BY ALL
UNION ALL SELECT 'event', CASE WHEN past THEN 'expired' ELSE 'review_interrupted' END, count(*) FROM s WHERE hit GROUP BY ALL
UNION ALL SELECT 'event', 'cleanup', count(*) FROM s WHERE {_OPEN} AND past
UNION ALL SELECT 'event', CASE l_returnflag WHEN 'A' THEN 'postponed' WHEN 'N' THEN 'quarantined' ELSE 'requarantined' END, count(*)
  FROM lineitem WHERE l_shipdate >= {_AT} - INTERVAL 90 DAY GROUP BY ALL
UNION ALL SELECT 'event', 'retention_pruned', 1""")
def maintenance_run(spark, d):
    return _sides(run_maintenance(inputs.items(spark, d), inputs.item_events(spark, d), inputs.at(), "run"))


@query("audit_trail", f"""
{_W} SELECT i.quarantine_id, i.status, count(l_orderkey) AS events, coalesce(epoch_ms(max(l_shipdate)), 0) AS last_ms
FROM items i LEFT JOIN lineitem l ON i.o_orderkey = l.l_orderkey GROUP BY ALL""")
def audit_trail(spark, d):
    trail = routing.audit_trail(inputs.items(spark, d), inputs.item_events(spark, d))
    return trail.groupBy("quarantine_id", "status").agg(
        F.count("event_id").alias("events"), F.coalesce(F.max(F.unix_millis("occurred_at")), F.lit(0)).alias("last_ms"))


@query("schema_upgrade", f"""
{_W} SELECT quarantine_id, 0::INT AS requarantine_count, '-' AS dedupe_key FROM items""")
def schema_upgrade(spark, d):
    from memgov.sources.tables import upgrade_items

    old = inputs.items(spark, d).drop("dedupe_key", "requarantine_count", "expires_at")
    return upgrade_items(old).select("quarantine_id", "requarantine_count", F.coalesce("dedupe_key", F.lit("-")).alias("dedupe_key"))


def _evidence(spark, d):
    """Line items as repeated evidence: returned lines about orders on file, others about new ones."""
    order = F.col("l_orderkey")
    text = F.when(F.col("l_returnflag") == "R", order.cast("string")).otherwise(F.concat(F.lit("n"), order.cast("string")))
    orders = inputs.table(spark, d, "orders").select("o_orderkey", "o_orderpriority")
    rows = inputs.table(spark, d, "lineitem").join(orders, order == F.col("o_orderkey"))
    kind = F.expr(inputs._case("o_orderpriority", inputs.PRIORITY_KIND))
    reason = F.expr(inputs._case("o_orderpriority", inputs.PRIORITY_REASON))
    memory, none = kind == "recalled_memory", F.lit(None).cast("string")
    tie = F.concat_ws("|", F.lpad(F.col("l_linenumber").cast("string"), 2, "0"), "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_tax", "l_discount")
    return rows.select(
        F.concat_ws("|", text, tie).alias("request_id"), F.col("l_shipdate").alias("at"),
        F.unix_millis("l_shipdate").alias("ts_ms"),
        F.concat(F.lit("q_"), text, F.lit("_0123456789abcdef")).alias("quarantine_id"),
        kind.alias("kind"), reason.alias("reason"), F.concat(F.lit("NATION_"), (order % 25).cast("string")).alias("writer_id"),
        F.lit("application").alias("source"), F.when(memory, F.lit("bank")).otherwise(none).alias("source_bank"),
        F.when(memory, text).otherwise(none).alias("source_memory_id"),
        F.when(memory, F.sha2(text, 256)).otherwise(none).alias("source_content_sha256"),
        F.when(memory, none).otherwise(F.concat(F.lit("k"), text)).alias("dedupe_key"),
        F.sha2(tie, 256).alias("sha256"), F.lit("{}").alias("encrypted_envelope"),
        F.col("l_partkey").alias("encrypted_bytes"), F.col("l_partkey").alias("item_bytes"))


# The candidates per identity and what the stored item makes of them.
_EVIDENCE_SQL = f"""
{inputs.ITEMS_SQL},
groups AS (SELECT CASE WHEN l_returnflag = 'R' THEN l_orderkey::VARCHAR ELSE concat('n', l_orderkey) END AS id,
    l_returnflag = 'R' AS returned, l_orderkey, count(*) AS n, min(l_shipdate) AS first_at, max(l_shipdate) AS last_at
  FROM lineitem GROUP BY ALL),
merged_groups AS (SELECT id, returned, l_orderkey, sum(n)::BIGINT AS n, min(first_at) AS first_at, max(last_at) AS last_at FROM groups GROUP BY ALL),
acts AS (SELECT g.*, i.quarantine_id AS old_id, coalesce(i.kind, {inputs._case('o.o_orderpriority', inputs.PRIORITY_KIND)}) AS kind,
    i.status, i.expires_at, i.requarantine_count,
    CASE WHEN i.quarantine_id IS NULL THEN 'insert'
      WHEN i.kind IN ('retain_request', 'recall_request') AND NOT {_OPEN} THEN 'conflict_request'
      WHEN i.status LIKE 'review\\_%' ESCAPE '\\' THEN 'conflict_item'
      WHEN {_OPEN} AND {_PAST} THEN 'reopen_expired'
      WHEN i.kind = 'recalled_memory' AND i.status = 'reviewed_allowed' THEN 'reopen_memory'
      ELSE 'refresh' END AS action
  FROM merged_groups g JOIN orders o ON g.l_orderkey = o.o_orderkey
    LEFT JOIN items i ON g.returned AND i.o_orderkey = g.l_orderkey)"""


@query("merge_actions", f"""
WITH {_EVIDENCE_SQL} SELECT action, kind, count(*) AS identities, sum(n)::BIGINT AS candidates FROM acts GROUP BY ALL""")
def merge_actions(spark, d):
    groups = quarantine.classify(_evidence(spark, d), inputs.items(spark, d), inputs.at())
    return groups.groupBy("action", F.col("first.kind").alias("kind")).agg(
        F.count("*").alias("identities"), F.sum(F.col("n").cast("long")).alias("candidates"))


@query("merged_items", f"""
WITH {_EVIDENCE_SQL},
changed AS (SELECT concat('q_', id, '_0123456789abcdef') AS quarantine_id,
    CASE WHEN action = 'refresh' THEN status ELSE 'pending' END AS status,
    coalesce(requarantine_count, 0) + n - CASE WHEN action = 'insert' THEN 1 ELSE 0 END AS requarantine_count,
    epoch_ms(last_at) AS updated_ms,
    epoch_ms(CASE WHEN action = 'refresh' THEN expires_at ELSE first_at + INTERVAL 30 DAY END) AS expires_ms
  FROM acts WHERE action NOT LIKE 'conflict%')
SELECT quarantine_id, status, requarantine_count::INT AS requarantine_count, updated_ms, coalesce(expires_ms, 0) AS expires_ms FROM changed
UNION ALL SELECT quarantine_id, status, requarantine_count::INT, epoch_ms(updated_at), coalesce(epoch_ms(expires_at), 0) FROM items
  WHERE quarantine_id NOT IN (SELECT quarantine_id FROM changed)""")
def merged_items(spark, d):
    out = quarantine.merge_candidates(inputs.items(spark, d), _evidence(spark, d), inputs.at(), "b1").items
    return out.select("quarantine_id", "status", "requarantine_count", F.unix_millis("updated_at").alias("updated_ms"),
                      F.coalesce(F.unix_millis("expires_at"), F.lit(0)).alias("expires_ms"))


@query("merge_events", f"""
WITH {_EVIDENCE_SQL}
SELECT concat('q_', id, '_0123456789abcdef') AS quarantine_id, count(*) AS events, count(*) FILTER (WHERE fresh) AS first_kinds
FROM (SELECT id, unnest(range(n)) = 0 AND action IN ('insert', 'reopen_memory') AS fresh FROM acts WHERE action NOT LIKE 'conflict%')
GROUP BY id""")
def merge_events(spark, d):
    out = quarantine.merge_candidates(inputs.items(spark, d), _evidence(spark, d), inputs.at(), "b1").events
    return out.groupBy("quarantine_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") != "requarantined").alias("first_kinds"))


@query("merge_conflicts", f"""
WITH {_EVIDENCE_SQL} SELECT old_id AS quarantine_id, n::INT AS n,
  CASE WHEN action = 'conflict_request' THEN 'quarantine_request_in_review' ELSE 'quarantine_item_in_review' END AS code
FROM acts WHERE action LIKE 'conflict%'""")
def merge_conflicts(spark, d):
    out = quarantine.merge_candidates(inputs.items(spark, d), _evidence(spark, d), inputs.at(), "b1").conflicts
    return out.select("quarantine_id", "n", "code")


@query("known_identities", f"""
WITH {_EVIDENCE_SQL} SELECT old_id IS NOT NULL AS known, sum(n)::BIGINT AS candidates FROM acts GROUP BY ALL""")
def known_identities(spark, d):
    out = routing.flag_known(_evidence(spark, d), inputs.items(spark, d))
    return out.groupBy("known").agg(F.count("*").alias("candidates"))


@query("existing_matches", f"""
WITH {_EVIDENCE_SQL} SELECT kind, coalesce(status, 'new') AS status, sum(n)::BIGINT AS candidates FROM acts GROUP BY ALL""")
def existing_matches(spark, d):
    out = routing.match_existing(_evidence(spark, d), inputs.items(spark, d))
    return out.groupBy("kind", F.coalesce("existing_status", F.lit("new")).alias("status")).agg(F.count("*").alias("candidates"))


ACTIONS = ("postpone", "reject_request", "claim_memory", "claim_retain_effect", "mark_allowed", "effect_done",
           "approve_retain", "approve_memory", "reject_memory", "interrupt", "claim_memory_effect")


def _decisions(spark, d):
    """One decision per item, the action chosen by its number."""
    items = inputs.items(spark, d)
    n = F.regexp_extract("quarantine_id", "^q_([0-9]+)_", 1).cast("long")
    return items.select(
        F.concat(F.lit("d"), "quarantine_id").alias("decision_id"), "quarantine_id",
        inputs.pick(ACTIONS, F.floor(n / 4)).alias("action"), inputs.at().alias("at"),
        F.when(n % 9 == 0, F.lit("changed")).otherwise(F.col("sha256")).alias("expected_sha256"),
        F.lit("pending").alias("prior_status"))


_JUDGE_SQL = f"""
{inputs.ITEMS_SQL},
asked AS (SELECT *, ({list(ACTIONS)})[(o_orderkey // 4) % {len(ACTIONS)} + 1] AS action, o_orderkey % 9 = 0 AS changed, {_PAST} AS past FROM items),
judged AS (SELECT *, action IN ('postpone','reject_request','claim_memory','claim_retain_effect','claim_memory_effect','mark_allowed') AS opening,
    {_STALE} AND action IN ('postpone','reject_request','claim_memory','claim_retain_effect','claim_memory_effect') AS stale FROM asked),
coded AS (SELECT *, CASE
    WHEN action = 'effect_done' AND (status <> 'review_side_effect_started' OR changed) THEN 'quarantine_review_changed'
    WHEN action IN ('approve_retain', 'reject_memory') AND (status <> 'review_side_effect_completed' OR changed) THEN 'quarantine_review_changed'
    WHEN action = 'approve_memory' AND (status <> 'review_in_progress' OR changed) THEN 'quarantine_review_changed'
    WHEN action IN ('claim_memory','claim_retain_effect','claim_memory_effect','mark_allowed') AND changed THEN 'quarantine_review_changed'
    WHEN opening AND stale AND past THEN 'quarantine_expired'
    WHEN opening AND NOT stale AND NOT {_OPEN} THEN 'quarantine_already_finalized'
    WHEN opening AND past THEN 'quarantine_expired'
    WHEN action IN ('claim_memory','claim_memory_effect','mark_allowed','approve_memory') AND kind <> 'recalled_memory' THEN 'invalid_review_action'
    WHEN action = 'claim_retain_effect' AND kind <> 'retain_request' THEN 'invalid_review_action'
    WHEN action = 'postpone' AND postpone_count >= 3 THEN 'postpone_limit_reached' END AS code FROM judged)"""


@query("review_errors", f"""
WITH {_JUDGE_SQL} SELECT quarantine_id, code FROM coded WHERE code IS NOT NULL""")
def review_errors(spark, d):
    done = review.apply_decisions(inputs.items(spark, d), _decisions(spark, d), "r1")
    return done.errors.select("quarantine_id", "code")


@query("reviewed_items", f"""
WITH {_JUDGE_SQL}
SELECT quarantine_id, CASE WHEN code IS NOT NULL THEN status WHEN action = 'postpone' THEN 'postponed'
    WHEN action = 'claim_memory' THEN 'review_in_progress' WHEN action IN ('claim_retain_effect','claim_memory_effect') THEN 'review_side_effect_started'
    WHEN action = 'mark_allowed' OR action = 'approve_memory' THEN 'reviewed_allowed' WHEN action = 'reject_memory' THEN 'reviewed_blocked'
    WHEN action = 'effect_done' THEN 'review_side_effect_completed' ELSE status END AS status,
  CASE WHEN code IS NULL AND action IN ('mark_allowed','approve_memory','reject_memory') THEN 0 ELSE encrypted_bytes END AS encrypted_bytes,
  (postpone_count + CASE WHEN code IS NULL AND action = 'postpone' THEN 1 ELSE 0 END)::INT AS postpone_count
FROM coded WHERE NOT (code IS NULL AND action IN ('reject_request', 'approve_retain')) AND NOT (stale AND past)""")
def reviewed_items(spark, d):
    done = review.apply_decisions(inputs.items(spark, d), _decisions(spark, d), "r1")
    return done.items.select("quarantine_id", "status", "encrypted_bytes", "postpone_count")


@query("review_events", f"""
WITH {_JUDGE_SQL},
own AS (SELECT CASE action WHEN 'postpone' THEN 'postponed' WHEN 'reject_request' THEN 'rejected'
    WHEN 'claim_retain_effect' THEN 'review_side_effect_started' WHEN 'claim_memory_effect' THEN 'review_side_effect_started'
    WHEN 'effect_done' THEN 'review_side_effect_completed' WHEN 'approve_retain' THEN 'approved'
    WHEN 'approve_memory' THEN 'reviewed_allowed' WHEN 'mark_allowed' THEN 'reviewed_allowed' WHEN 'reject_memory' THEN 'reviewed_blocked' END AS event_type
  FROM coded WHERE code IS NULL),
rec AS (SELECT CASE WHEN past THEN 'expired' WHEN code IS NULL THEN 'review_interrupted' END AS event_type FROM coded WHERE stale)
SELECT event_type, count(*) AS n FROM (SELECT * FROM own UNION ALL SELECT * FROM rec) WHERE event_type IS NOT NULL GROUP BY ALL""")
def review_events(spark, d):
    done = review.apply_decisions(inputs.items(spark, d), _decisions(spark, d), "r1")
    return done.events.groupBy("event_type").agg(F.count("*").alias("n"))


@query("decision_matches", f"""
{_W} SELECT quarantine_id, CASE WHEN o_orderstatus = 'F' THEN 'quarantine_payload_unavailable'
  WHEN o_orderkey % 5 = 0 THEN 'quarantine_hash_mismatch'
  WHEN o_orderkey % 3 = 0 THEN 'quarantine_metadata_mismatch' ELSE '-' END AS code FROM items""")
def decision_matches(spark, d):
    items = inputs.items(spark, d)
    n = F.regexp_extract("quarantine_id", "^q_([0-9]+)_", 1).cast("long")
    asked = items.select("quarantine_id", F.when(n % 5 == 0, "x").otherwise(F.col("sha256")).alias("sha256"), "reason",
                         F.when(n % 3 == 0, "someone").otherwise(F.col("writer_id")).alias("writer_id"), "source")
    out = routing.match_decisions(asked, items)
    return out.select("quarantine_id", F.coalesce("match_code", F.lit("-")).alias("code"))


@query("source_mismatches", f"""
{_W} SELECT quarantine_id, o_orderkey % 4 = 0 AS mismatch FROM items WHERE kind = 'recalled_memory'""")
def source_mismatches(spark, d):
    items = inputs.items(spark, d).filter("kind = 'recalled_memory'")
    n = F.col("source_memory_id").cast("long")
    rows = items.select("quarantine_id", F.col("source_bank").alias("item_bank"), F.col("source_memory_id").alias("item_memory_id"),
                        F.when(n % 4 == 0, "other").otherwise("bank").alias("bank_id"), F.col("source_memory_id").alias("memory_id"))
    return routing.source_match(rows).select("quarantine_id", F.col("source_code").isNotNull().alias("mismatch"))


@query("rejected_memories", f"""
{_W} SELECT o_orderkey::VARCHAR AS memory_id, CASE WHEN kind = 'recalled_memory' AND status = 'reviewed_blocked' THEN 'invalidated' ELSE 'valid' END AS state,
  CASE WHEN kind = 'recalled_memory' AND status = 'reviewed_blocked' THEN concat('Rejected by quarantine review ', quarantine_id) ELSE '-' END AS why
FROM items""")
def rejected_memories(spark, d):
    items = inputs.items(spark, d)
    bank = inputs.table(spark, d, "orders").select(
        F.lit("bank").alias("bank_id"), F.col("o_orderkey").cast("string").alias("memory_id"), F.lit("valid").alias("state"))
    out = review.invalidate_memories(bank, items.filter("kind = 'recalled_memory' and status = 'reviewed_blocked'"))
    return out.select("memory_id", "state", F.coalesce("state_reason", F.lit("-")).alias("why"))


@query("approval_gate", f"""
WITH {_DECIDE_SQL}
SELECT request_id, CASE WHEN NOT known THEN 'writer_not_registered'
  WHEN reason IS NOT NULL AND turn % 2 = 0 THEN 'quarantine_security_review_required' ELSE '-' END AS gate_code FROM decided""")
def approval_gate(spark, d):
    from memgov.operators.policy import gate_approvals

    asked = inputs.turn_requests(spark, d).withColumns(
        {"reason": F.when(F.col("turn") % 2 == 0, "unknown_writer").otherwise("suspicious_content"), "ok": F.lit(True),
         "error_code": F.lit(None).cast("string"), "item_count": F.lit(1), "value_bytes": F.octet_length("body")})
    out = gate_approvals(asked, inputs.writers(spark, d))
    return out.select("request_id", F.coalesce("gate_code", F.lit("-")).alias("gate_code"))


@query("legacy_import", """
WITH q AS (SELECT o_orderkey, o_orderstatus, CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'P' THEN 'postponed' ELSE 'promoted' END AS decision,
    o_orderkey % 11 = 0 AS no_id, o_orderpriority = '5-LOW' AS on_file FROM orders)
SELECT 'imported' AS measure, count(*) FILTER (WHERE decision <> 'promoted' AND NOT no_id AND NOT on_file) AS n FROM q
UNION ALL SELECT 'skipped_existing', count(*) FILTER (WHERE decision <> 'promoted' AND NOT no_id AND on_file) FROM q
UNION ALL SELECT 'skipped_finalized', count(*) FILTER (WHERE decision = 'promoted') FROM q
UNION ALL SELECT 'skipped_without_payload', count(*) FILTER (WHERE decision <> 'promoted' AND no_id) FROM q
UNION ALL SELECT 'postponed_items', count(*) FILTER (WHERE decision = 'postponed' AND NOT no_id AND NOT on_file) FROM q
UNION ALL SELECT 'replayed', coalesce(sum(CASE WHEN decision = 'postponed' AND NOT no_id AND NOT on_file THEN greatest(1, o_orderkey % 3) END), 0)::BIGINT FROM q""")
def legacy_import(spark, d):
    """Orders as lines of an old review queue; some carry no id, some are on file already."""
    from memgov.sources.tables import OUTCOMES, import_legacy, migration_summary, parse_legacy_queue

    orders = inputs.table(spark, d, "orders")
    key = F.col("o_orderkey")
    qid = F.concat(F.lit("q_"), key.cast("string"), F.lit("_0123456789abcdef"))
    decision = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "P", "postponed").otherwise("promoted")
    count = F.when(F.col("o_orderstatus") == "P", (key % 3).cast("int")).otherwise(0)
    lines = orders.select(F.to_json(F.struct(
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("timestamp"), F.lit("unknown_writer").alias("reason"),
        decision.alias("decision"), F.when(key % 11 != 0, qid).alias("quarantine_id"), count.alias("postpone_count"))).alias("value"))
    good, _ = parse_legacy_queue(lines)
    objects = orders.select(
        qid.alias("quarantine_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
        F.lit("unknown_writer").alias("reason"), F.lit("w").alias("writer_id"), F.lit(None).cast("string").alias("source"),
        F.lit("retain").alias("action"), F.sha2(qid, 256).alias("sha256"), F.lit("{}").alias("envelope"))
    on_file = orders.filter("o_orderpriority = '5-LOW'").select(qid.alias("quarantine_id"))
    outcomes, new, events = import_legacy(good, objects, on_file, "import")
    summary = migration_summary(outcomes)
    counted = summary.select(F.explode(F.create_map(*[v for o in OUTCOMES for v in (F.lit(o), F.col(o))])).alias("measure", "n"))
    postponed = new.agg(F.count_if(F.col("status") == "postponed").alias("n")).select(F.lit("postponed_items").alias("measure"), "n")
    replayed = events.agg(F.count_if(F.col("event_type") == "postponed").alias("n")).select(F.lit("replayed").alias("measure"), "n")
    return counted.unionByName(postponed).unionByName(replayed)


@query("legacy_rejects", """
SELECT (['invalid_json', 'not_an_object', 'invalid_decision', 'no_timestamp', 'no_reason'])[o_orderkey % 5 + 1] AS reject_reason, count(*) AS lines
FROM orders GROUP BY ALL""")
def legacy_rejects(spark, d):
    from memgov.sources.tables import parse_legacy_queue

    shapes = ('{"decision":~', '[~]', '{"decision":"later","timestamp":"t","reason":"r","n":~}',
              '{"decision":"pending","reason":"r","n":~}', '{"decision":"pending","timestamp":"t","reason":"","n":~}')
    orders = inputs.table(spark, d, "orders")
    lines = orders.select(F.replace(inputs.pick(shapes, F.col("o_orderkey")), F.lit("~"), F.col("o_orderkey").cast("string")).alias("value"))
    _, bad = parse_legacy_queue(lines)
    return bad.groupBy("reject_reason").agg(F.count("*").alias("lines"))


@query("interrupted_items", f"""
WITH {inputs.ITEMS_SQL}
SELECT quarantine_id, CASE WHEN status = 'review_in_progress' OR (status = 'review_side_effect_started'
    AND (o_orderkey % 4 IN (0, 1) OR o_orderkey % 4 = 2 AND o_orderkey % 3 = 0)) THEN 'postponed' ELSE status END AS status FROM items""")
def interrupted_items(spark, d):
    """Every item interrupted at its last change: what surely failed goes back, what may have happened stays."""
    items, key = inputs.items(spark, d), F.split("quarantine_id", "_")[1].cast("long")
    kind = F.when(key % 4 == 2, "http").when(key % 4 == 3, "timeout")
    decisions = items.select(
        F.concat(F.lit("d"), "quarantine_id").alias("decision_id"), "quarantine_id", F.lit("interrupt").alias("action"),
        F.col("updated_at").alias("at"), F.lit("postponed").alias("prior_status"), kind.alias("error_kind"),
        F.when(key % 3 == 0, 404).otherwise(503).alias("error_status"))
    return review.apply_decisions(items, decisions, "b1").items.select("quarantine_id", "status")


@query("approved_bank_rows", f"""
WITH {inputs.ITEMS_SQL}, {inputs.WRITERS_SQL}
SELECT quarantine_id, write_bank AS target_bank, concat('note ', o_orderkey) AS content, 'approved' AS decision
FROM items JOIN writers USING (writer_id) WHERE kind = 'retain_request' AND status = 'review_side_effect_completed'""")
def approved_bank_rows(spark, d):
    """Write requests whose side effect is done, approved: their items reach the writer's bank with stamps."""
    items, key = inputs.items(spark, d), F.split("quarantine_id", "_")[1]
    decisions = items.select(F.concat(F.lit("d"), "quarantine_id").alias("decision_id"), "quarantine_id",
                             F.lit("approve_retain").alias("action"), inputs.at().alias("at"))
    bodies = items.select("quarantine_id", F.concat(F.lit('{"items":[{"content":"note '), key, F.lit('"}]}')).alias("body"))
    rows = review.approved_bank_rows(items, decisions, bodies, inputs.writers(spark, d))
    return rows.select("quarantine_id", "target_bank", "content", F.col("metadata")["router_decision"].alias("decision"))
