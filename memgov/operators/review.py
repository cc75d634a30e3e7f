"""Review decisions, maintenance and legacy kinds as merges over the item and event tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgov import fixed
from memgov.functions import identity
from memgov.operators.quarantine import (
    ITEM_COLUMNS, cleanup_selector, is_expired, is_past, is_stale,
)
from memgov.operators.policy import ITEM, stamp_items
from memgov.operators.routing import distinct_first, minus_ids, route_writers

# action -> kind it applies to (None: any)
ACTIONS = {
    "postpone": None,
    "reject_request": None,
    "claim_memory": "recalled_memory",
    "claim_retain_effect": "retain_request",
    "claim_memory_effect": "recalled_memory",
    "mark_allowed": "recalled_memory",
    "mark_blocked": "recalled_memory",
    "effect_done": None,
    "interrupt": None,
    "approve_retain": None,
    "approve_memory": "recalled_memory",
    "reject_memory": None,
}
OPENING = ("postpone", "reject_request", "claim_memory", "claim_retain_effect", "claim_memory_effect",
           "mark_allowed", "mark_blocked")
# Actions of a running review and the state they need.
NEEDED = {
    "effect_done": "review_side_effect_started",
    "approve_retain": "review_side_effect_completed",
    "reject_memory": "review_side_effect_completed",
    "approve_memory": "review_in_progress",
}
MAX_POSTPONES = 3


@dataclass(frozen=True)
class Reviewed:
    items: DataFrame
    events: DataFrame
    errors: DataFrame


def guard_codes(judged: DataFrame) -> Column:
    """First broken guard of a decision row joined to its item."""
    action = F.col("action")
    opening = action.isin(*OPENING)
    needed = F.create_map(*[F.lit(v) for pair in NEEDED.items() for v in pair])
    kinds = F.create_map(*[F.lit(v) for k, v2 in ACTIONS.items() if v2 for v in (k, v2)])
    snapshot = (
        (F.col("expected_sha256").isNotNull() & ~F.col("sha256").eqNullSafe(F.col("expected_sha256")))
        | (F.col("expected_updated_at").isNotNull()
           & ~F.col("updated_at").eqNullSafe(F.col("expected_updated_at")))
    )
    running = action.isin(*NEEDED) & (
        F.col("status").isNull()
        | ~F.col("status").eqNullSafe(F.try_element_at(needed, action))
        | snapshot
    )
    claims = action.isin("claim_memory", "claim_retain_effect", "claim_memory_effect",
                         "mark_allowed", "mark_blocked")
    wrong_kind = F.coalesce(F.col("kind") != F.try_element_at(kinds, action), F.lit(False))
    return (
        F.when(~action.isin(*ACTIONS), "invalid_review_action")
        .when(running, "quarantine_review_changed")
        .when(opening & F.col("status").isNull(), "quarantine_not_found")
        .when(claims & snapshot, "quarantine_review_changed")
        .when(opening & F.col("_stale") & F.col("_past"), "quarantine_expired")
        .when(opening & ~F.col("_state").isin(*fixed.REVIEWABLE), "quarantine_already_finalized")
        .when(opening & F.col("_past"), "quarantine_expired")
        .when(wrong_kind, "invalid_review_action")
        .when((action == "postpone") & (F.coalesce("postpone_count", F.lit(0)) >= MAX_POSTPONES),
              "postpone_limit_reached")
    )


def judge(items: DataFrame, decisions: DataFrame, stale_seconds: int = 60) -> DataFrame:
    """Decisions joined to their items with the guard code.

    A decision has decision_id, quarantine_id, action and at, and may name expected_sha256,
    expected_updated_at, prior_status, error_kind, error_status, writer_id and target_bank. The earliest
    decision per item counts; later ones of the batch get `superseded_decision`.
    """
    asked = decisions
    for name, kind in (("expected_sha256", "string"), ("expected_updated_at", "timestamp"),
                       ("prior_status", "string"), ("error_kind", "string"), ("error_status", "int"),
                       ("target_bank", "string"), ("target_writer", "string")):
        if name not in asked.columns:
            asked = asked.withColumn(name, F.lit(None).cast(kind))
    first = distinct_first(asked, ["quarantine_id"], ["at", "decision_id"])
    joined = first.join(items.select(*ITEM_COLUMNS), "quarantine_id", "left")
    # A marked review and a stale claim on the same item: the claim is first recovered.
    stale = F.coalesce(is_stale(F.col("at"), stale_seconds), F.lit(False)) & ~F.col("action").isin(
        "mark_allowed", "mark_blocked")
    joined = (
        joined.withColumn("_stale", stale & F.col("action").isin(*OPENING))
        .withColumn("_past", F.coalesce(is_past(F.col("at")), F.lit(False)))
        .withColumn("_state", F.when(F.col("_stale") & ~F.col("_past"), F.lit("postponed")).otherwise(F.col("status")))
    )
    judged = joined.withColumn("code", guard_codes(joined))
    # An interrupted review restores its state only if nobody else touched it, and a side effect surely
    # did not happen; else nothing happens, and the claim waits until it is stale.
    uncertain = F.col("status").eqNullSafe("review_side_effect_started") & ~failure_is_definite(F.col("error_kind"), F.col("error_status"))
    idle = (F.col("action") == "interrupt") & ~(
        ~uncertain &
        F.coalesce(F.col("status").isin("review_in_progress", "review_side_effect_started"), F.lit(False))
        & F.col("updated_at").eqNullSafe(F.col("at"))
        & F.coalesce(F.col("prior_status").isin(*fixed.REVIEWABLE), F.lit(False))
    )
    return judged.withColumn("_idle", idle)


def _events(judged: DataFrame, batch_id: str) -> DataFrame:
    action = F.col("action")
    done = F.col("code").isNull() & ~F.col("_idle")
    count = F.coalesce("postpone_count", F.lit(0)) + 1
    source = F.to_json(F.struct("source_bank", "source_memory_id", "source_content_sha256"),
                       {"ignoreNullFields": "false"})
    own = (
        F.when(action == "postpone", F.struct(F.lit("postponed").alias("t"),
               F.to_json(F.struct(count.alias("postpone_count"))).alias("d")))
        .when(action == "reject_request", F.struct(F.lit("rejected").alias("t"), F.lit("{}").alias("d")))
        .when(action.isin("claim_retain_effect", "claim_memory_effect"),
              F.struct(F.lit("review_side_effect_started").alias("t"),
                       F.to_json(F.struct(F.col("_state").alias("previous_status"))).alias("d")))
        .when(action == "effect_done",
              F.struct(F.lit("review_side_effect_completed").alias("t"), F.lit("{}").alias("d")))
        .when(action == "interrupt",
              F.struct(F.lit("review_interrupted").alias("t"),
                       F.to_json(F.struct(F.lit("restored").alias("outcome"),
                                          F.col("prior_status").alias("status"),
                                          F.coalesce("error_kind", F.lit("unknown")).alias("error_kind"))).alias("d")))
        .when(action == "approve_retain",
              F.struct(F.lit("approved").alias("t"),
                       F.to_json(F.struct(F.col("target_writer").alias("writer_id"), "target_bank")).alias("d")))
        .when(action.isin("approve_memory", "mark_allowed"),
              F.struct(F.lit("reviewed_allowed").alias("t"), source.alias("d")))
        .when(action.isin("reject_memory", "mark_blocked"),
              F.struct(F.lit("reviewed_blocked").alias("t"), source.alias("d")))
    )
    recovered = F.when(
        F.col("_stale"),
        F.when(F.col("_past"), F.struct(
            F.lit("expired").alias("t"),
            F.lit('{"recovered":true,"previous_status":"review_in_progress"}').alias("d")))
        .otherwise(F.when(F.col("code").isNull(), F.struct(
            F.lit("review_interrupted").alias("t"),
            F.lit('{"outcome":"postponed","recovered":true}').alias("d")))),
    )
    both = F.array_compact(F.array(recovered, F.when(done, own)))
    return judged.select("quarantine_id", "decision_id", "at", F.explode(both).alias("e")).select(
        identity.event_id(F.concat(F.lit(f"{batch_id}:"), F.col("decision_id")), F.col("quarantine_id"),
                          F.col("e.t")).alias("event_id"),
        "quarantine_id", F.col("at").alias("occurred_at"), F.col("e.t").alias("event_type"),
        F.col("e.d").alias("details"),
    )


def apply_decisions(items: DataFrame, decisions: DataFrame, batch_id: str,
                    stale_seconds: int = 60) -> Reviewed:
    """Fold one batch of decisions into new item and event rows."""
    judged = judge(items, decisions, stale_seconds)
    action = F.col("action")
    done = F.col("code").isNull() & ~F.col("_idle")
    gone = (done & action.isin("reject_request", "approve_retain")) | (F.col("_stale") & F.col("_past"))
    final = F.when(action.isin("approve_memory", "mark_allowed"), "reviewed_allowed").when(
        action.isin("reject_memory", "mark_blocked"), "reviewed_blocked")
    status = (
        F.when(final.isNotNull(), final)
        .when(action == "postpone", "postponed")
        .when(action == "claim_memory", "review_in_progress")
        .when(action.isin("claim_retain_effect", "claim_memory_effect"), "review_side_effect_started")
        .when(action == "effect_done", "review_side_effect_completed")
        .when(action == "interrupt", F.col("prior_status"))
    )
    changed = judged.filter(done & ~gone).select(
        "quarantine_id", "created_at", F.col("at").alias("updated_at"), "kind", "reason", "writer_id",
        "source", "source_bank", "source_memory_id", "source_content_sha256", "dedupe_key", "sha256",
        F.when(final.isNull(), F.col("encrypted_envelope")).alias("encrypted_envelope"),
        F.when(final.isNull(), F.col("encrypted_bytes")).otherwise(0).alias("encrypted_bytes"),
        status.alias("status"),
        F.when(action == "postpone", F.coalesce("postpone_count", F.lit(0)) + 1)
        .otherwise(F.coalesce("postpone_count", F.lit(0))).alias("postpone_count"),
        "requarantine_count", "expires_at",
    )
    touched = judged.filter((done & F.col("status").isNotNull()) | gone).select("quarantine_id")
    firsts = judged.select("quarantine_id", F.col("decision_id").alias("_first"))
    late = decisions.select("decision_id", "quarantine_id").join(firsts, "quarantine_id").filter(
        F.col("decision_id") != F.col("_first")
    ).select("decision_id", "quarantine_id", F.lit("superseded_decision").alias("code"))
    errors = judged.filter(F.col("code").isNotNull()).select("decision_id", "quarantine_id", "code")
    return Reviewed(
        minus_ids(items.select(*ITEM_COLUMNS), touched).unionByName(changed),
        _events(judged, batch_id),
        errors.unionByName(late),
    )


def approved_bank_rows(items: DataFrame, decisions: DataFrame, bodies: DataFrame, writers: DataFrame,
                       stale_seconds: int = 60) -> DataFrame:
    """The memory items of approved write requests as rows for the writers' banks, stamped `approved`.

    bodies holds quarantine_id and the opened request body. Requests of unregistered writers and bodies
    that are no JSON give no rows.
    """
    judged = judge(items, decisions, stale_seconds)
    done = judged.filter(F.col("code").isNull() & (F.col("action") == "approve_retain") & (F.col("kind") == "retain_request"))
    routed = route_writers(done.select("quarantine_id", "writer_id", F.col("source").alias("own_source")).join(bodies, "quarantine_id"), writers)
    parsed = routed.filter("known_writer").withColumn("items", F.from_json(F.get_json_object("body", "$.items"), f"array<{ITEM}>"))
    stamped = parsed.withColumn("items", stamp_items(
        F.col("items"), F.col("writer_id"), F.coalesce("own_source", F.lit("quarantine_review")), F.col("write_bank"), "approved"))
    rows = stamped.select("quarantine_id", F.col("write_bank").alias("target_bank"), F.posexplode("items").alias("item_pos", "item"))
    return rows.select("quarantine_id", "target_bank", "item_pos", "item.*")


def invalidate_memories(bank: DataFrame, rejected: DataFrame) -> DataFrame:
    """Bank rows with state and reason set for rejected memories."""
    marks = rejected.select(
        F.col("source_bank").alias("bank_id"), F.col("source_memory_id").alias("memory_id"),
        F.concat(F.lit("Rejected by quarantine review "), F.col("quarantine_id")).alias("_why"),
    )
    return (
        bank.join(marks, ["bank_id", "memory_id"], "left")
        .withColumn("state", F.when(F.col("_why").isNotNull(), "invalidated").otherwise(F.col("state")))
        .withColumn("state_reason", F.col("_why"))
        .drop("_why")
    )


def failure_is_definite(kind: Column, status: Column) -> Column:
    """A failed side effect surely did not happen: local failure, or an upstream 4xx."""
    return kind.isNull() | ((kind == "http") & F.coalesce(status.between(400, 499), F.lit(False)))


def _no_errors(items: DataFrame) -> DataFrame:
    """Nothing, in the columns of decision errors."""
    none = F.lit(None).cast("string")
    return items.limit(0).select(none.alias("decision_id"), "quarantine_id", none.alias("code"))


# --- maintenance ------------------------------------------------------------------------------------------


def _maintenance_events(rows: DataFrame, at: Column, kind: Column, details: Column, batch_id: str) -> DataFrame:
    return rows.select(
        identity.event_id(F.lit(batch_id), F.col("quarantine_id"), kind).alias("event_id"),
        "quarantine_id", at.alias("occurred_at"), kind.alias("event_type"), details.alias("details"),
    )


def recover_stale(items: DataFrame, at: Column, batch_id: str, seconds: int = 60) -> Reviewed:
    """Abandoned claims go back to postponed, or are removed if their time is over."""
    stale = is_stale(at, seconds)
    over = is_past(at)
    hit = F.coalesce(stale, F.lit(False))
    status = F.when(hit, F.lit("postponed")).otherwise(F.col("status"))
    touched = F.when(hit, at).otherwise(F.col("updated_at"))
    kept = (
        items.filter(~(hit & over))
        .withColumn("_s", status).withColumn("_u", touched)
        .withColumn("status", F.col("_s")).withColumn("updated_at", F.col("_u")).drop("_s", "_u")
    )
    kind = F.when(over, F.lit("expired")).otherwise(F.lit("review_interrupted"))
    details = F.when(over, F.lit('{"recovered":true,"previous_status":"review_in_progress"}')).otherwise(
        F.lit('{"outcome":"postponed","recovered":true}'))
    events = _maintenance_events(items.filter(hit), at, kind, details, batch_id)
    return Reviewed(kept, events, _no_errors(items))


def expired_batch(items: DataFrame, at: Column, size: int | None = None) -> DataFrame:
    """Items to sweep; a size gives the oldest expiries first."""
    due = items.filter(is_expired(at))
    return due if size is None else due.orderBy("expires_at", "quarantine_id").limit(size)


def sweep_expired(items: DataFrame, at: Column, batch_id: str) -> Reviewed:
    due = expired_batch(items, at)
    details = F.to_json(F.struct(F.lit("expired").alias("reason"), "expires_at"))
    events = _maintenance_events(due, at, F.lit("cleanup"), details, batch_id)
    return Reviewed(items.filter(~is_expired(at)), events, _no_errors(items))


def run_cleanup(items: DataFrame, at: Column, batch_id: str, scope: str = "pending",
                reasons: list[str] | None = None, older_than: Column | None = None,
                expected: int | None = None) -> Reviewed:
    """Delete a selection whose size must equal the one previewed."""
    if not isinstance(expected, int) or isinstance(expected, bool) or expected < 0:
        raise ValueError("expected_count_required")
    chosen = F.coalesce(cleanup_selector(scope, reasons, older_than), F.lit(False))
    if items.filter(chosen).count() != expected:
        raise RuntimeError("quarantine_cleanup_changed")
    parts = [F.lit(scope).alias("scope")]
    if reasons:
        parts.append(F.array(*map(F.lit, reasons)).alias("reasons"))
    if older_than is not None:
        parts.append(older_than.alias("older_than"))
    details = F.to_json(F.struct(F.struct(*parts).alias("filter")))
    events = _maintenance_events(items.filter(chosen), at, F.lit("cleanup"), details, batch_id)
    return Reviewed(items.filter(~chosen), events, _no_errors(items))


def prunable_events(events: DataFrame, cutoff: Column) -> DataFrame:
    return events.filter(F.col("occurred_at") < cutoff)


def retention_summary(events: DataFrame, cutoff: Column, at: Column, batch_id: str) -> DataFrame:
    """One event naming how many were pruned; none if there were none."""
    pruned = prunable_events(events, cutoff).agg(F.count("*").alias("n")).filter("n > 0")
    details = F.to_json(F.struct(F.col("n").alias("pruned_events"), cutoff.alias("older_than")))
    return pruned.select(
        identity.event_id(F.lit(batch_id), F.lit("quarantine_retention"), F.lit("retention_pruned")).alias("event_id"),
        F.lit("quarantine_retention").alias("quarantine_id"), at.alias("occurred_at"),
        F.lit("retention_pruned").alias("event_type"), details.alias("details"),
    )


def prune_events(events: DataFrame, cutoff: Column, at: Column, batch_id: str) -> DataFrame:
    kept = events.filter(~(F.col("occurred_at") < cutoff))
    return kept.unionByName(retention_summary(events, cutoff, at, batch_id))


# --- legacy rows --------------------------------------------------------------------------------------------


def legacy_kind(action: Column) -> Column:
    return F.when(action == "retain", "retain_request").when(action == "recall", "recall_request")


def legacy_postpones(decision: Column, count: Column) -> Column:
    """Postponements to replay: at least one for a postponed record."""
    n = F.greatest(F.coalesce(count, F.lit(0)), F.lit(0))
    return F.when(decision == "postponed", F.greatest(n, F.lit(1))).otherwise(n)
