"""Joins and lookups. No side is hinted: the planner broadcasts what its size check allows,
and adaptive execution splits skewed writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def route_writers(requests: DataFrame, writers: DataFrame) -> DataFrame:
    """Registry columns next to each request; `known_writer` is false where there is no rule."""
    rules = writers.select("writer_id", "source", "write_bank", "read_banks", F.lit(True).alias("_known"))
    joined = requests.join(rules, "writer_id", "left")
    return joined.withColumn("known_writer", F.coalesce("_known", F.lit(False))).drop("_known")


def fan_out(requests: DataFrame) -> DataFrame:
    """One row per request and read bank, bank order kept in bank_pos."""
    return requests.select("*", F.posexplode("read_banks").alias("bank_pos", "bank_id"))


def with_memory_state(results: DataFrame, items: DataFrame) -> DataFrame:
    """Review status and stored digest of each recalled memory."""
    state = items.filter(F.col("source_memory_id").isNotNull()).select(
        F.col("source_bank").alias("bank_id"), F.col("source_memory_id").alias("memory_id"),
        F.col("status").alias("state"), F.col("source_content_sha256").alias("state_sha256"),
    )
    return results.join(state, ["bank_id", "memory_id"], "left")


def match_key(df: DataFrame) -> Column:
    """Identity under which evidence is merged: memory, request or id."""
    return (
        F.when(
            F.col("kind") == "recalled_memory",
            F.to_json(F.array(F.lit("memory"), F.col("source_bank"), F.col("source_memory_id"))),
        )
        .when(
            F.col("kind").isin("retain_request", "recall_request") & F.col("dedupe_key").isNotNull(),
            F.to_json(F.array(F.lit("request"), F.col("dedupe_key"))),
        )
        .otherwise(F.to_json(F.array(F.lit("id"), F.col("quarantine_id"))))
    )


def match_existing(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """Candidates with the id and status of the stored item they would merge into."""
    stored = items.select(
        match_key(items).alias("match_key"), F.col("quarantine_id").alias("existing_id"),
        F.col("status").alias("existing_status"),
    )
    return candidates.withColumn("match_key", match_key(candidates)).join(stored, "match_key", "left")


def flag_known(candidates: DataFrame, items: DataFrame) -> DataFrame:
    """`known` is true where the identity is already on file."""
    stored = items.select(match_key(items).alias("match_key"), F.lit(True).alias("_on_file"))
    joined = candidates.withColumn("match_key", match_key(candidates)).join(stored, "match_key", "left")
    return joined.withColumn("known", F.coalesce("_on_file", F.lit(False))).drop("_on_file")


def minus_ids(items: DataFrame, ids: DataFrame) -> DataFrame:
    return items.join(ids.select("quarantine_id"), "quarantine_id", "left_anti")


def audit_trail(items: DataFrame, events: DataFrame) -> DataFrame:
    """Events of each item in time order; items without events keep one row."""
    return (
        items.select("quarantine_id", "kind", "status")
        .join(events, "quarantine_id", "left")
        .orderBy("quarantine_id", "occurred_at", "event_id")
    )


def match_decisions(decisions: DataFrame, items: DataFrame) -> DataFrame:
    """Decisions with their item and the first mismatch code of digest or metadata."""
    fields = ("reason", "writer_id", "source")
    stored = items.select(
        "quarantine_id", "kind", "status", F.col("sha256").alias("item_sha256"),
        F.col("source_bank").alias("item_bank"), F.col("source_memory_id").alias("item_memory_id"),
        F.col("encrypted_envelope").isNotNull().alias("has_payload"),
        *[F.col(f).alias(f"item_{f}") for f in fields],
    )
    joined = decisions.join(stored, "quarantine_id", "left")
    same = F.lit(True)
    for f in fields:
        same = same & F.col(f).eqNullSafe(F.col(f"item_{f}"))
    code = (
        F.when(F.col("status").isNull(), "quarantine_not_found")
        .when(~F.col("has_payload"), "quarantine_payload_unavailable")
        .when(F.col("sha256") != F.col("item_sha256"), "quarantine_hash_mismatch")
        .when(~same, "quarantine_metadata_mismatch")
    )
    return joined.withColumn("match_code", code)


def source_match(df: DataFrame) -> DataFrame:
    """Recalled memories whose payload names another bank or memory than the item."""
    ok = F.col("bank_id").eqNullSafe(F.col("item_bank")) & F.col("memory_id").eqNullSafe(
        F.col("item_memory_id")
    )
    return df.withColumn("source_code", F.when(~ok, "quarantine_source_mismatch"))


def distinct_first(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """First row per key, merged map-side, so that a hot key costs one row per partition."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*order)).alias("_first")
    return df.groupBy(*keys).agg(first).select(*keys, "_first.*")


def ranked(df: DataFrame, key: str, ts_ms: str, tie: str, width_ms: int = 3_600_000) -> DataFrame:
    """`rank` of each row within its key by (ts_ms, tie), also for a key that holds most rows.

    Rows are numbered per (key, time slice); the slices of a key are then offset by their counts.
    """
    from pyspark.sql import Window

    sliced = df.withColumn("_slice", F.floor(F.col(ts_ms) / width_ms))
    counts = sliced.groupBy(key, "_slice").count()
    before = Window.partitionBy(key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        F.col(key).alias("_k"), F.col("_slice").alias("_s"),
        F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"),
    )
    inside = Window.partitionBy(key, "_slice").orderBy(ts_ms, tie)
    numbered = sliced.withColumn("_n", F.row_number().over(inside))
    return (
        numbered.join(offsets, F.col(key).eqNullSafe(F.col("_k")) & (F.col("_slice") == F.col("_s")))
        .withColumn("rank", (F.col("_n") + F.col("_offset")).cast("long"))
        .drop("_k", "_s", "_slice", "_n", "_offset")
    )


def cap_identities(events: DataFrame, scoped: str = "scoped", at: str = "ts_ms", cap: int = 64) -> DataFrame:
    """The first `cap` identities keep their key; all later ones share `aggregate`.

    First-seen times are merged map-side; the kept table has at most `cap` rows.
    """
    seen = events.groupBy(F.col(scoped).alias("_id")).agg(F.min(at).alias("_seen"))
    kept = seen.orderBy("_seen", "_id").limit(cap).select("_id", F.lit(True).alias("_kept"))
    joined = events.join(F.broadcast(kept), F.col(scoped) == F.col("_id"), "left")
    return joined.withColumn(
        "dedupe_key", F.when(F.col("_kept"), F.col(scoped)).otherwise(F.lit("aggregate"))
    ).drop("_id", "_kept")
