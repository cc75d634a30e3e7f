"""Quarantine items: views, predicates, statistics, capacity and merging of new evidence."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgov import fixed
from memgov.functions import identity
from memgov.functions.times import age_seconds, plus_days
from memgov.operators.routing import match_key
from memgov.session import cut_lineage

ITEM_SCHEMA = T.StructType(
    [T.StructField("quarantine_id", T.StringType()), T.StructField("created_at", T.TimestampType()),
     T.StructField("updated_at", T.TimestampType())]
    + [T.StructField(n, T.StringType()) for n in (
        "kind", "reason", "writer_id", "source", "source_bank", "source_memory_id",
        "source_content_sha256", "dedupe_key", "sha256", "encrypted_envelope")]
    + [T.StructField("encrypted_bytes", T.LongType()), T.StructField("status", T.StringType()),
       T.StructField("postpone_count", T.IntegerType()),
       T.StructField("requarantine_count", T.IntegerType()),
       T.StructField("expires_at", T.TimestampType())]
)
EVENT_SCHEMA = T.StructType(
    [T.StructField("event_id", T.StringType()), T.StructField("quarantine_id", T.StringType()),
     T.StructField("occurred_at", T.TimestampType()), T.StructField("event_type", T.StringType()),
     T.StructField("details", T.StringType())]
)
ITEM_COLUMNS = ITEM_SCHEMA.fieldNames()
# File and row of a stored item, for tables read with them: rows are then told apart without moving.
PLACE = ("_item_file", "_item_row")
BITMAP_ROWS = 32_768


# --- predicates and views --------------------------------------------------------------------------


def is_open(status: Column | None = None) -> Column:
    return (F.col("status") if status is None else status).isin(*fixed.REVIEWABLE)


def is_past(at: Column) -> Column:
    return F.coalesce(F.col("expires_at") <= at, F.lit(False))


def is_expired(at: Column) -> Column:
    return is_open() & is_past(at)


def is_live(at: Column) -> Column:
    return is_open() & ~is_past(at)


def is_stale(at: Column, seconds: int = 60) -> Column:
    """A review claim untouched for this long; an unknown time is not stale."""
    age = age_seconds(F.col("updated_at"), at)
    return (F.col("status") == "review_in_progress") & F.coalesce(age >= seconds, F.lit(False))


def reviewable(items: DataFrame, at: Column) -> DataFrame:
    return items.filter(is_live(at))


def queue_page(items: DataFrame, at: Column, limit: int = 100, offset: int = 0) -> DataFrame:
    """Oldest first, the id breaking ties."""
    if not 1 <= limit <= 500 or offset < 0:
        raise ValueError("limit must be 1..500 and offset >= 0")
    return reviewable(items, at).orderBy("created_at", "quarantine_id").offset(offset).limit(limit)


SUMMARY = ("quarantine_id", "created_at", "updated_at", "kind", "reason", "writer_id", "source",
           "source_bank", "source_memory_id", "dedupe_key", "sha256", "status", "postpone_count",
           "requarantine_count")


def item_summary(items: DataFrame) -> DataFrame:
    """The public columns as JSON, null ones left out; the envelope is never shown."""
    return items.select(
        "quarantine_id", F.to_json(F.struct(*SUMMARY), {"ignoreNullFields": "true"}).alias("summary")
    )


def read_items(items: DataFrame) -> DataFrame:
    """Items that still hold evidence, with the envelope parsed and counters never null."""
    return (
        items.filter(F.col("encrypted_envelope").isNotNull())
        .withColumn("encrypted", F.try_parse_json("encrypted_envelope"))
        .withColumn("postpone_count", F.coalesce("postpone_count", F.lit(0)))
        .withColumn("requarantine_count", F.coalesce("requarantine_count", F.lit(0)))
        .drop("encrypted_envelope")
    )


def scope_key() -> Column:
    """Capacity scope: unknown writers share one; else the writer; else the kind."""
    return (
        F.when(F.col("reason") == "unknown_writer", F.lit("unknown"))
        .when(F.col("writer_id").isNotNull(), F.concat(F.lit("writer:"), F.col("writer_id")))
        .otherwise(F.concat(F.lit("kind:"), F.col("kind")))
    )


def cleanup_selector(scope: str = "pending", reasons: list[str] | None = None,
                     older_than: Column | None = None) -> Column:
    """Rows a cleanup may delete; items in review or decided are never among them."""
    if scope not in ("pending", "all"):
        raise ValueError("scope must be pending or all")
    chosen = is_open() if scope == "pending" else ~F.col("status").isin(*fixed.UNDER_REVIEW, *fixed.FINAL)
    if reasons:
        chosen = chosen & F.col("reason").isin(*reasons)
    if older_than is not None:
        chosen = chosen & (F.col("created_at") < older_than)
    return chosen


# --- statistics --------------------------------------------------------------------------------------


def _count(test: Column) -> Column:
    return F.count_if(F.coalesce(test, F.lit(False)))


def _bytes(test: Column) -> Column:
    return F.coalesce(F.sum(F.when(test, F.col("encrypted_bytes"))), F.lit(0))


def quarantine_stats(items: DataFrame, events: DataFrame, at: Column) -> DataFrame:
    """One row over all items in one pass, next to the number of events."""
    totals = items.agg(
        F.count("*").alias("total_items"),
        _count(is_live(at) & (F.col("status") == "pending")).alias("pending_items"),
        _count(is_live(at) & (F.col("status") == "postponed")).alias("postponed_items"),
        _count(is_expired(at)).alias("expired_items"),
        _count(F.col("status") == "reviewed_allowed").alias("reviewed_allowed_items"),
        _count(F.col("status") == "reviewed_blocked").alias("reviewed_blocked_items"),
        _bytes(~is_expired(at)).alias("encrypted_bytes"),
    )
    counted = events.agg(F.count("*").alias("event_count"))
    both = totals.unionByName(counted, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])


def queue_total(items: DataFrame, at: Column) -> DataFrame:
    return items.agg(_count(is_live(at)).alias("total"))


def preview_cleanup(items: DataFrame, selector: Column) -> DataFrame:
    return items.filter(selector).agg(
        F.count("*").alias("count"), F.coalesce(F.sum("encrypted_bytes"), F.lit(0)).alias("encrypted_bytes")
    )


def capacity_totals(items: DataFrame, at: Column) -> DataFrame:
    return items.agg(
        _count(is_live(at)).alias("pending_count"), _bytes(~is_expired(at)).alias("encrypted_bytes")
    )


def scoped_pending(items: DataFrame, at: Column) -> DataFrame:
    return items.filter(is_live(at)).groupBy(scope_key().alias("scope")).agg(F.count("*").alias("pending"))


# --- merging -------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Merged:
    items: DataFrame
    events: DataFrame
    conflicts: DataFrame


EVIDENCE = ("kind", "reason", "writer_id", "source", "source_bank", "source_memory_id",
            "source_content_sha256", "dedupe_key", "sha256", "encrypted_envelope", "encrypted_bytes")


# What a merge needs of a stored item: all but what the last candidate replaces.
_OLD = ("quarantine_id", "kind", "source_bank", "source_memory_id", "dedupe_key", "source_content_sha256", "status",
        "created_at", "expires_at", "postpone_count", "requarantine_count")


def classify(candidates: DataFrame, items: DataFrame, at: Column) -> DataFrame:
    """One row per identity of the batch: first and last candidate, count, stored item, action.

    First and last are merged map-side, so that an identity with a third of the rows costs one
    row per partition. Evidence does not come along: `last` names the row that holds it.
    """
    order = F.struct("at", "request_id", "sha256")
    keyed = candidates.withColumn("match_key", match_key(candidates))
    groups = keyed.groupBy("match_key").agg(
        F.min_by(F.struct("quarantine_id", "at", "kind", "dedupe_key"), order).alias("first"),
        F.max(order).alias("last"),
        F.count("*").cast("int").alias("n"),
        F.count_if(F.col("reason") != "auth_failed").cast("int").alias("audited"),
    )
    stored = items.select(match_key(items).alias("match_key"), F.struct(*_OLD).alias("old"))
    joined = groups.join(stored, "match_key", "left")
    status, kind = F.col("old.status"), F.col("first.kind")
    over = status.isin(*fixed.REVIEWABLE) & F.coalesce(F.col("old.expires_at") <= at, F.lit(False))
    action = (
        F.when(F.col("old").isNull(), "insert")
        .when(kind.isin(*fixed.REQUEST_KINDS) & F.col("first.dedupe_key").isNotNull()
              & ~status.isin(*fixed.REVIEWABLE), "conflict_request")
        .when(status.isin(*fixed.UNDER_REVIEW), "conflict_item")
        .when(over, "reopen_expired")
        .when((kind == "recalled_memory") & (status == "reviewed_allowed"), "reopen_memory")
        .otherwise("refresh")
    )
    return joined.withColumn("action", action)


def _merged_item(ttl_days: int) -> Column:
    """The item after all candidates of its identity, in order."""
    fresh = F.col("action").isin("insert", "reopen_expired", "reopen_memory")
    expires = plus_days(F.col("first.at"), ttl_days) if ttl_days > 0 else F.lit(None).cast("timestamp")
    # Reopening an approved memory keeps its kind and source; a later refresh sets them again.
    kept_source = (F.col("action") == "reopen_memory") & (F.col("n") == 1)
    keep_old = {"kind", "source_bank", "source_memory_id", "dedupe_key"}
    parts = [
        F.coalesce(F.col("old.quarantine_id"), F.col("first.quarantine_id")).alias("quarantine_id"),
        F.when(fresh, F.col("first.at")).otherwise(F.col("old.created_at")).alias("created_at"),
        F.col("last.at").alias("updated_at"),
    ]
    for name in EVIDENCE[:-1]:
        value = F.col(f"last.{name}")
        if name in keep_old:
            value = F.when(kept_source, F.col(f"old.{name}")).otherwise(value)
        parts.append(value.alias(name))
    repeats = F.col("n") - F.when(F.col("action") == "insert", 1).otherwise(0)
    parts += [
        F.col("last.encrypted_bytes").alias("encrypted_bytes"),
        F.when(fresh, F.lit("pending")).otherwise(F.col("old.status")).alias("status"),
        F.when(fresh, F.lit(0)).otherwise(F.coalesce("old.postpone_count", F.lit(0))).alias("postpone_count"),
        (F.coalesce("old.requarantine_count", F.lit(0)) + repeats).alias("requarantine_count"),
        F.when(fresh, expires).otherwise(F.col("old.expires_at")).alias("expires_at"),
    ]
    return F.struct(*parts)


def merge_candidates(items: DataFrame, candidates: DataFrame, at: Column, batch_id: str,
                     ttl_days: int = 30, actions_path: str | None = None) -> Merged:
    """Insert, refresh, reopen or refuse new evidence. Candidates need `request_id` and `at`.

    Repeats within the batch act in order: the first decides the action, later ones refresh. The actions, a
    narrow table, are written once for all three outputs, to `actions_path` or a scratch folder; evidence is
    fetched for the last candidates only.
    """
    # The last candidate comes with its evidence later, so its digest and id need not be kept here.
    groups = classify(candidates, items, at).drop("last")
    if actions_path is None:
        groups = cut_lineage(groups, "merge-actions")
    else:
        groups.write.mode("overwrite").option("compression", "zstd").parquet(actions_path)
        groups = items.sparkSession.read.schema(groups.schema).parquet(actions_path)
    refused = F.col("action").startswith("conflict")
    changed = groups.filter(~refused)
    new_items = _with_evidence(changed, candidates).select(_merged_item(ttl_days).alias("i")).select("i.*")
    touched = changed.filter(F.col("old").isNotNull()).select(F.col("old.quarantine_id").alias("quarantine_id"))
    kept = _untouched(items, touched)
    return Merged(
        kept.unionByName(new_items.select(*ITEM_COLUMNS)),
        _merge_events(candidates, groups, batch_id),
        groups.filter(refused).select(
            "match_key", "old.quarantine_id", "n",
            F.when(F.col("action") == "conflict_request", "quarantine_request_in_review")
            .otherwise("quarantine_item_in_review").alias("code"),
        ),
    )


def _untouched(items: DataFrame, touched: DataFrame) -> DataFrame:
    """The items whose id is not among `touched`.

    Where the items' places are known only ids and places move; a bitmap of the touched rows of each file, one bit a
    row, goes to every task and the rest of the rows stay where they are.
    """
    if not set(PLACE) <= set(items.columns):
        return items.select(*ITEM_COLUMNS).join(touched, "quarantine_id", "left_anti")
    file, row = PLACE
    part, bit = F.floor(F.col(row) / BITMAP_ROWS).alias("_part"), F.pmod(row, F.lit(BITMAP_ROWS))
    hit = items.select("quarantine_id", *PLACE).join(touched, "quarantine_id", "left_semi")
    maps = hit.select(file, part, bit.alias("_bit")).groupBy(file, "_part").agg(F.bitmap_construct_agg("_bit").alias("_bitmap"))
    there = F.expr("shiftright(cast(conv(hex(substring(_bitmap, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int), cast(_bit % 8 as int)) & 1")
    placed = items.select("*", part, bit.alias("_bit")).join(F.broadcast(maps), [file, "_part"], "left")
    return placed.filter(F.coalesce(there == 0, F.lit(True))).select(*ITEM_COLUMNS)


def _with_evidence(changed: DataFrame, candidates: DataFrame) -> DataFrame:
    """`last` is the last candidate of each identity with its evidence; of equal ones one is kept. Candidates are
    merged map-side, so that an identity costs one row per partition, however frequent."""
    rows = candidates.select(
        match_key(candidates).alias("match_key"), "request_id", F.struct("at", *EVIDENCE).alias("_row"))
    order = F.struct("_row.at", "request_id", "_row.sha256")
    last = rows.groupBy("match_key").agg(F.max_by("_row", order).alias("last"))
    return changed.dropDuplicates(["match_key"]).join(last, "match_key")


_DIGESTS = ("sha256", "source_content_sha256")
# Identities with up to this many candidates in a batch are numbered in one sort.
ONE_SORT = 100_000


def _numbered(candidates: DataFrame, groups: DataFrame) -> DataFrame:
    """`rank` of each candidate within its identity by (milliseconds, request id); without a time it has none.

    Digests move as bytes. One shuffle numbers the rows of all identities but the few very frequent ones, which go by time slices.
    """
    from memgov.operators.routing import ranked

    rows = candidates.select(match_key(candidates).alias("match_key"), "request_id", "at", "kind", "reason",
                             *[identity.packed_hex(F.col(c)).alias(c) for c in _DIGESTS])
    frequent = groups.filter(F.col("n") > ONE_SORT).select("match_key").distinct()
    sliced = None
    if not frequent.isEmpty():
        at_ms = F.unix_millis("at")
        sliced = ranked(rows.join(frequent, "match_key", "left_semi").withColumn("_ms", at_ms), "match_key", "_ms",
                        "request_id").drop("_ms")
        rows = rows.join(frequent, "match_key", "left_anti")
    inside = Window.partitionBy("match_key").orderBy(F.unix_millis("at"), "request_id")
    plain = rows.withColumn("rank", F.row_number().over(inside).cast("long")).filter("at is not null")
    numbered = plain if sliced is None else plain.unionByName(sliced)
    return numbered.withColumns({c: identity.unpacked_hex(F.col(c)) for c in _DIGESTS})


def _merge_events(candidates: DataFrame, groups: DataFrame, batch_id: str) -> DataFrame:
    """One event per accepted candidate, but none for repeated authentication failures."""
    changed = groups.filter(~F.col("action").startswith("conflict"))
    order = _numbered(candidates, groups)
    info = changed.select(
        "match_key", "action",
        F.coalesce(F.col("old.quarantine_id"), F.col("first.quarantine_id")).alias("quarantine_id"),
        F.coalesce(F.col("old.requarantine_count"), F.lit(0)).alias("_count"),
        F.col("old.source_content_sha256").alias("_old_sha"),
    )
    rows = order.join(info, "match_key")
    first = F.col("rank") == 1
    kind = (
        F.when(first & (F.col("action") == "insert"), "quarantined")
        .when(first & (F.col("action") == "reopen_memory"),
              F.when(F.col("_old_sha").eqNullSafe(F.col("source_content_sha256")), "safety_reopened")
              .otherwise("content_changed"))
        .otherwise("requarantined")
    )
    plain = (F.col("event_type") == "requarantined") & ~(first & (F.col("action") == "reopen_expired"))
    count = F.col("_count") + F.col("rank") - F.when(F.col("action") == "insert", 1).otherwise(0)
    details = F.to_json(
        F.struct(
            "kind",
            F.when(~F.col("event_type").isin("content_changed", "safety_reopened"), F.col("reason")).alias("reason"),
            "sha256",
            F.when(plain, count.cast("int")).alias("requarantine_count"),
            F.when((F.col("event_type") == "requarantined") & ~plain, F.lit(True)).alias("expired"),
        )
    )
    rows = rows.withColumn("event_type", kind)
    silent = plain & (F.col("reason") == "auth_failed")
    batch = F.concat(F.lit(f"{batch_id}:"), F.col("request_id"))
    return rows.filter(~silent).select(
        identity.event_id(batch, F.col("quarantine_id"), F.col("event_type")).alias("event_id"),
        "quarantine_id", F.col("at").alias("occurred_at"), "event_type", details.alias("details"),
    )
