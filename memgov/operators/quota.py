"""Quotas, offered load, capacity and throttles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memgov import fixed
from memgov.operators import ordered_fold as folds
from memgov.operators.quarantine import capacity_totals, is_live, is_past, scope_key, scoped_pending
from memgov.operators.routing import match_key


def offered_load(requests: DataFrame, key: str | None, window_ms: int, slice_ms: int | None = None) -> DataFrame:
    """`offered`: rows of the same key in (ts_ms - window, ts_ms], refused ones included.

    Rows are counted per key and millisecond first and windows run per (key, time slice) with the
    last window of the previous slice as context, so no task holds more than one slice of a key.
    """
    step = max(slice_ms or 0, 10 * window_ms)
    by = F.col(key) if key else F.lit("")
    ticks = requests.groupBy(by.alias("_key"), F.col("ts_ms").alias("_ts")).agg(F.count("*").alias("_n"))
    slot = F.floor(F.col("_ts") / step)
    next_start = (slot + 1) * step
    placed = ticks.withColumn(
        "_slots",
        F.when(F.col("_ts") > next_start - window_ms, F.array(slot, slot + 1)).otherwise(F.array(slot)),
    ).select("_key", "_ts", "_n", slot.alias("_own"), F.explode("_slots").alias("_slot"))
    # A tick adds its rows at its time and takes them away one window later, so that one running
    # sum gives the load; a sliding frame would add up the whole window again for every row.
    change = F.array(
        F.struct(F.col("_ts").alias("at"), F.col("_n").alias("delta"), F.lit(True).alias("tick")),
        F.struct((F.col("_ts") + window_ms).alias("at"), (-F.col("_n")).alias("delta"), F.lit(False).alias("tick")),
    )
    moves = placed.select("_key", "_own", "_slot", F.inline(change))
    running = Window.partitionBy("_key", "_slot").orderBy("at").rangeBetween(
        Window.unboundedPreceding, Window.currentRow)
    loads = moves.withColumn("offered", F.sum("delta").over(running)).filter(
        F.col("tick") & (F.col("_own") == F.col("_slot"))
    ).select("_key", F.col("at").alias("_ts"), "offered")
    same = by.eqNullSafe(F.col("_key")) & (F.col("ts_ms") == F.col("_ts"))
    return requests.join(loads, same).drop("_key", "_ts")


def admit_quota(requests: DataFrame, per_writer: int, overall: int, window_ms: int,
                rows_per_block: int | None = None) -> DataFrame:
    """Adds `admitted` and, for refused rows, `retry_after_s`. Needs request_id, writer_id, ts_ms.

    Where the whole load never reaches the overall cap within a window, that cap cannot refuse and
    writers are independent; otherwise all writers are folded together.
    """
    shared = overall > 0
    if shared:
        peak = offered_load(requests.select("ts_ms"), None, window_ms).agg(F.max("offered")).first()[0]
        shared = (peak or 0) > overall
    if shared:
        fold, key = folds.SharedQuota(per_writer, overall, window_ms), None
    else:
        fold, key = folds.KeyedQuota(per_writer, window_ms), "writer_id"
    verdicts = folds.ordered_fold(requests, fold, "boolean", key, rows_per_block=rows_per_block)
    return _with_retry(requests, verdicts, window_ms)


def _with_retry(requests: DataFrame, verdicts: DataFrame, window_ms: int) -> DataFrame:
    seconds = max(1, -(-window_ms // 1000))
    joined = requests.join(
        verdicts.select("request_id", F.col("verdict").alias("admitted")), "request_id")
    return joined.withColumn("retry_after_s", F.when(~F.col("admitted"), F.lit(seconds)))


def admit_keyed(requests: DataFrame, key: str, limit: int, window_ms: int) -> DataFrame:
    """One cap per key: administration reads and writes, failed authentications per route group."""
    verdicts = folds.ordered_fold(requests, folds.KeyedQuota(limit, window_ms), "boolean", key)
    return _with_retry(requests, verdicts, window_ms)


def admit_admin(access: DataFrame, limits: fixed.TrafficLimits = fixed.TrafficLimits()) -> DataFrame:
    """Administration calls under separate read and write budgets."""
    reads = F.col("method").isin("GET", "HEAD")
    marked = access.withColumn("budget", F.when(reads, "read").otherwise("write"))
    fold = BudgetByClass({"read": limits.admin_reads, "write": limits.admin_writes}, limits.window_ms)
    verdicts = folds.ordered_fold(marked, fold, "boolean", "budget")
    return _with_retry(marked, verdicts, limits.window_ms)


class BudgetByClass(folds.KeyedQuota):
    """A keyed quota whose cap depends on the key."""

    columns = ("budget",)

    def __init__(self, limits: dict[str, int], window_ms: int):
        super().__init__(0, window_ms)
        self.limits = limits

    def feed(self, state, now, row_id, budget):
        self.limit = self.limits[budget]
        return super().feed(state, now, row_id)


def admit_distinct(requests: DataFrame, limit: int, window_ms: int, scope: str = "scope",
                   rows_per_block: int | None = None) -> DataFrame:
    """At most `limit` different identities per scope and window. Needs an `identity` column."""
    verdicts = folds.ordered_fold(requests, folds.DistinctQuota(limit, window_ms), "boolean", scope,
                                  rows_per_block=rows_per_block)
    return _with_retry(requests, verdicts, window_ms)


def charge_keys(limits: fixed.QuarantineLimits = fixed.QuarantineLimits()) -> Column:
    """Budgets a quarantine write is charged to: array of (key, cap, window_ms)."""

    def budget(key, cap):
        return F.struct(key.alias("key"), F.lit(cap).alias("cap"), F.lit(limits.window_ms).alias("window_ms"))

    audit = F.col("reason") == "auth_failed"
    writer = F.when(F.col("reason") == "unknown_writer", "unknown-writer").otherwise(
        F.coalesce(F.when(F.col("writer_id") != "", F.col("writer_id")), F.lit("unknown-writer")))
    none = F.array().cast("array<struct<key:string,cap:int,window_ms:int>>")
    fresh = none if limits.writes_per_writer <= 0 else F.when(
        audit, F.array(budget(F.lit("writes:auth-audit"), limits.writes_global))
    ).otherwise(
        F.array(budget(F.concat(F.lit("writes:writer:"), writer), limits.writes_per_writer),
                budget(F.lit("writes"), limits.writes_global)))
    return F.when(
        F.col("known"),
        F.array(budget(F.when(audit, "requarantine:auth-audit").otherwise("requarantine"),
                       limits.requarantine_ops)),
    ).otherwise(fresh)


def admit_counts(candidates: DataFrame, items: DataFrame, at: Column,
                 limits: fixed.QuarantineLimits = fixed.QuarantineLimits()) -> DataFrame:
    """Capacity by counts for new items: ranks within the scope, then over the kept rows.

    Equal to admitting one by one while byte caps cannot bind: security events are free of the
    writer cap but fill the scope, so ranks count them. Ranks past a cap are cut map-side,
    so a scope with most rows costs one task no more than the cap per partition.
    """
    scoped = candidates.withColumn("scope", scope_key())
    used = scoped_pending(items, at).withColumnRenamed("pending", "_used")
    narrow = scoped.select("request_id", "ts_ms", "kind", "scope")
    allowance = limits.writer_allowance
    per_scope = Window.partitionBy("scope").orderBy("ts_ms", "request_id")
    free_kind = (F.col("kind") == "security_event") | F.lit(allowance <= 0)
    capped = (
        narrow.withColumn("_r", F.row_number().over(per_scope))
        .filter(F.col("_r") <= allowance)
        .filter(~free_kind)
        .join(used, "scope", "left")
        .filter(F.col("_r") + F.coalesce("_used", F.lit(0)) <= allowance)
        .select("request_id", "ts_ms")
    )
    kept = capped.unionByName(narrow.filter(free_kind).select("request_id", "ts_ms"))
    pending = capacity_totals(items, at).first()["pending_count"]
    first = (
        kept.orderBy("ts_ms", "request_id").limit(limits.pending_items)
        .withColumn("_g", F.row_number().over(Window.orderBy("ts_ms", "request_id")))
        .filter(F.col("_g") + F.lit(pending) <= limits.pending_items)
        .select("request_id", F.lit(True).alias("_in"))
    )
    passed = kept.select("request_id", F.lit(True).alias("_scope_ok"))
    code = F.when(F.col("_in"), None).when(F.col("_scope_ok"), "quarantine_capacity_exceeded").otherwise(
        "quarantine_writer_capacity_exceeded")
    return (
        scoped.join(passed, "request_id", "left").join(first, "request_id", "left")
        .withColumn("code", code).drop("_in", "_scope_ok")
    )


def admit_evidence(candidates: DataFrame, items: DataFrame, at: Column,
                   limits: fixed.QuarantineLimits = fixed.QuarantineLimits(),
                   rows_per_block: int | None = None) -> DataFrame:
    """Budgets and capacity together, in arrival order: adds `code`, null where admitted.

    Needs request_id, ts_ms, item_bytes and the evidence columns; family_scope and family name the
    request family (null for other kinds).
    """
    keyed = candidates.withColumn("match_key", match_key(candidates)).withColumn("scope", scope_key())
    stored = items.select(
        match_key(items).alias("match_key"), F.col("status").alias("old_status"),
        (~is_past(at) & F.col("status").isin(*fixed.REVIEWABLE)).alias("old_live"),
        F.col("encrypted_bytes").alias("old_bytes"),
        scope_key().alias("old_scope"),
    )
    used = items.filter(is_live(at)).groupBy(scope_key().alias("scope")).agg(F.count("*").alias("scope_pending"))
    totals = capacity_totals(items, at).first()
    rows = keyed.join(stored, "match_key", "left").join(used, "scope", "left").withColumn(
        "scope_pending", F.coalesce("scope_pending", F.lit(0)))
    for name, known in (("fresh", False), ("known", True)):
        rows = rows.withColumn("known", F.lit(known)).withColumn(f"{name}_budgets", F.to_json(charge_keys(limits))).drop("known")
    fold = folds.EvidenceAdmission(limits, int(totals["pending_count"]), int(totals["encrypted_bytes"]))
    verdicts = folds.ordered_fold(rows, fold, "string", None, rows_per_block=rows_per_block)
    return keyed.drop("match_key", "scope").join(
        verdicts.select("request_id", F.col("verdict").alias("code")), "request_id")


# --- throttles -----------------------------------------------------------------------------------------


def throttle(records: DataFrame, key: Column, exempt: Column, interval_ms: int = 60_000,
             rows_per_block: int | None = None) -> DataFrame:
    """Records let through, with `suppressed`: how many of the key were held back before."""
    marked = records.withColumn("_key", key).withColumn("exempt", exempt)
    verdicts = folds.ordered_fold(marked, folds.Throttle(interval_ms), "long", "_key",
                                  rows_per_block=rows_per_block)
    passed = verdicts.filter("verdict >= 0").select("request_id", F.col("verdict").alias("suppressed"))
    return marked.join(passed, "request_id").drop("_key", "exempt")


def health_transitions(probes: DataFrame, interval_ms: int = 60_000,
                       rows_per_block: int | None = None) -> DataFrame:
    """State changes and repeated failures per component. Needs request_id, ts_ms, component, ok,
    error_kind."""
    verdicts = folds.ordered_fold(probes, folds.HealthTransitions(interval_ms), "string", "component",
                                  rows_per_block=rows_per_block)
    told = verdicts.filter("verdict is not null").select("request_id", F.col("verdict").alias("transition"))
    return probes.join(told, "request_id")
