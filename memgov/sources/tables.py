"""Item and event tables, log files and legacy files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memgov import fixed
from memgov.functions import identity
from memgov.functions.steps import held
from memgov.operators.quarantine import EVENT_SCHEMA, ITEM_COLUMNS, ITEM_SCHEMA, PLACE
from memgov.operators.review import legacy_kind, legacy_postpones
from memgov.session import cut_lineage


def upgrade_items(items: DataFrame) -> DataFrame:
    """Old item tables gain dedupe_key, requarantine_count and expires_at."""
    empty = items.sparkSession.createDataFrame([], ITEM_SCHEMA)
    full = items.unionByName(empty, allowMissingColumns=True)
    return full.withColumn("requarantine_count", F.coalesce("requarantine_count", F.lit(0))).select(
        *ITEM_COLUMNS, *[c for c in PLACE if c in items.columns])


def load_items(spark: SparkSession, path: str, placed: bool = False) -> DataFrame:
    """The stored items; with `placed` also where each row lies (see `quarantine.PLACE`)."""
    rows = spark.read.option("mergeSchema", "true").parquet(path)
    if placed:
        rows = rows.select("*", F.col("_metadata.file_name").alias(PLACE[0]), F.col("_metadata.row_index").alias(PLACE[1]))
    return upgrade_items(rows)


def save_items(items: DataFrame, path: str) -> None:
    """A new version of the table; Parquet has no merge, so each batch writes its own folder."""
    items.select(*ITEM_COLUMNS).write.mode("overwrite").option("compression", "zstd").parquet(path)


def load_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT_SCHEMA).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append-only; the date folders let retention drop or skip whole days."""
    dated = events.withColumn("event_date", F.to_date("occurred_at"))
    dated.write.mode("append").partitionBy("event_date").parquet(path)


def event_rows(rows: DataFrame, batch_id: str, details: Column) -> DataFrame:
    """Event rows with compact JSON details and an id that a replay repeats."""
    return rows.select(
        identity.event_id(F.lit(batch_id), F.col("quarantine_id"), F.col("event_type")).alias("event_id"),
        "quarantine_id", "occurred_at", "event_type", F.to_json(details).alias("details"),
    )


def log_lines(events: DataFrame) -> DataFrame:
    """One JSON object per log event: fields in name order, nulls left out."""
    return events.select(F.to_json(F.struct(*sorted(events.columns))).alias("value"))


def write_log_events(events: DataFrame, path: str) -> None:
    log_lines(events).write.mode("append").text(path)


# --- legacy review queue --------------------------------------------------------------------------

LEGACY = ("timestamp string, reason string, decision string, quarantine_id string, "
          "postpone_count int, decided_at string")
DECISIONS = ("pending", "postponed", "rejected", "promoted")


def parse_legacy_queue(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good records and rejected lines with a reason; blank lines are skipped. Needs `value`."""
    rows = held(lines.filter(F.trim("value") != ""), _v=F.try_parse_json("value"))

    def text_of(name):
        value = F.variant_get("_v", f"$.{name}", "variant")
        return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))

    # Only a string counts as an id.
    rows = held(rows, _id=text_of("quarantine_id"), _d=text_of("decision"), _t=text_of("timestamp"), _n=text_of("reason"))
    rows = held(rows, reject_reason=(
        F.when(F.col("_v").isNull(), "invalid_json")
        .when(~F.schema_of_variant("_v").startswith("OBJECT"), "not_an_object")
        .when(~F.coalesce(F.col("_d").isin(*DECISIONS), F.lit(False)), "invalid_decision")
        .when(F.coalesce("_t", F.lit("")) == "", "no_timestamp")
        .when(F.coalesce("_n", F.lit("")) == "", "no_reason")))
    rows = held(rows, _r=F.when(F.col("reject_reason").isNull(), F.from_json("value", LEGACY)))
    good = rows.filter("reject_reason is null").select(
        *[c for c in rows.columns if c not in ("value", "_v", "_r", "_id", "_d", "_t", "_n", "reject_reason")],
        "_r.timestamp", "_r.reason", "_r.decision", F.col("_id").alias("quarantine_id"),
        "_r.postpone_count", "_r.decided_at")
    bad = rows.filter("reject_reason is not null").select(
        F.sha2("value", 256).alias("line_sha256"), "reject_reason")
    return good, bad


def read_legacy_queue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_path"))
    return parse_legacy_queue(lines)


def read_legacy_objects(spark: SparkSession, folder: str) -> DataFrame:
    """One stored envelope per file, named by a valid item id."""
    files = spark.read.option("pathGlobFilter", "*.enc.json").text(folder, wholetext=True)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.enc\.json$", "")
    return files.select(name.alias("quarantine_id"), F.col("value").alias("envelope")).filter(
        F.col("quarantine_id").rlike(fixed.QUARANTINE_ID))


def import_legacy(queue: DataFrame, objects: DataFrame, items: DataFrame, batch_id: str):
    """(outcomes, new items, events). `objects` holds opened evidence: quarantine_id, created_at,
    reason, writer_id, source, action, sha256, envelope. Running it twice imports nothing new.

    Records of one id are merged map-side: the earliest is imported, the others count as existing.
    Outcomes carry the number of `records` they stand for. The queue and what was judged are written once to
    the scratch folder, since every result reads them.
    """
    queue = cut_lineage(queue.select("quarantine_id", "timestamp", "decision", "postpone_count", "decided_at"), "legacy-queue")
    is_open = F.col("decision").isin("pending", "postponed")
    first = F.min_by(F.struct("timestamp", "decision", "postpone_count", "decided_at"),
                     F.struct("timestamp", "decision", "postpone_count"))
    ids = queue.filter(is_open & F.col("quarantine_id").isNotNull()).groupBy("quarantine_id").agg(
        first.alias("_f"), F.count("*").alias("_n_records")).select("quarantine_id", "_n_records", "_f.*")
    stored = items.select("quarantine_id", F.lit(True).alias("_stored"))
    opened = objects.select(
        "quarantine_id", F.col("created_at").alias("_created"), F.col("reason").alias("_reason"),
        "writer_id", "source", "action", "sha256", "envelope", F.lit(True).alias("_opened"))
    judged = ids.join(stored, "quarantine_id", "left").join(opened, "quarantine_id", "left")
    outcome = (
        F.when(F.col("_stored"), "skipped_existing")
        .when(F.col("_opened").isNull() | legacy_kind(F.col("action")).isNull(), "rejected")
        .otherwise("imported")
    )
    judged = cut_lineage(judged.withColumn("outcome", outcome).drop("_stored", "_opened"), "legacy-judged")
    whole = F.col("outcome") != "imported"
    aside = queue.filter(~(is_open & F.col("quarantine_id").isNotNull())).select(
        "quarantine_id", F.when(is_open, "skipped_without_payload").otherwise("skipped_finalized").alias("outcome"),
        F.lit(1).cast("long").alias("records"))
    decided = judged.select(
        "quarantine_id", "outcome", F.when(whole, F.col("_n_records")).otherwise(1).alias("records"))
    repeats = judged.filter(~whole & (F.col("_n_records") > 1)).select(
        "quarantine_id", F.lit("skipped_existing").alias("outcome"), (F.col("_n_records") - 1).alias("records"))
    fresh = judged.filter("outcome = 'imported'").withColumn(
        "_n", legacy_postpones(F.col("decision"), F.col("postpone_count")))
    moment = F.to_timestamp(F.coalesce("decided_at", "timestamp"))
    none = F.lit(None).cast("string")
    new = fresh.select(
        "quarantine_id", F.to_timestamp("_created").alias("created_at"),
        F.when(F.col("_n") > 0, moment).otherwise(F.to_timestamp("_created")).alias("updated_at"),
        legacy_kind(F.col("action")).alias("kind"), F.col("_reason").alias("reason"), "writer_id", "source",
        none.alias("source_bank"), none.alias("source_memory_id"), none.alias("source_content_sha256"),
        none.alias("dedupe_key"), "sha256", F.col("envelope").alias("encrypted_envelope"),
        F.octet_length("envelope").cast("long").alias("encrypted_bytes"),
        F.when(F.col("_n") > 0, "postponed").otherwise("pending").alias("status"),
        F.col("_n").cast("int").alias("postpone_count"), F.lit(0).alias("requarantine_count"),
        F.lit(None).cast("timestamp").alias("expires_at"),
    )
    inserted = fresh.select(
        identity.event_id(F.lit(batch_id), F.col("quarantine_id"), F.lit("quarantined")).alias("event_id"),
        "quarantine_id", F.to_timestamp("_created").alias("occurred_at"),
        F.lit("quarantined").alias("event_type"),
        F.to_json(F.struct(legacy_kind(F.col("action")).alias("kind"), F.col("_reason").alias("reason"),
                           "sha256")).alias("details"))
    replayed = fresh.filter("_n > 0").select(
        "quarantine_id", moment.alias("occurred_at"), F.explode(F.sequence(F.lit(1), F.col("_n"))).alias("k"),
    ).select(
        identity.event_id(F.concat(F.lit(batch_id + ":"), F.col("k").cast("string")), F.col("quarantine_id"),
                          F.lit("postponed")).alias("event_id"),
        "quarantine_id", "occurred_at", F.lit("postponed").alias("event_type"),
        F.to_json(F.struct(F.col("k").alias("postpone_count"))).alias("details"))
    return decided.unionByName(repeats).unionByName(aside), new, inserted.unionByName(replayed)


OUTCOMES = ("imported", "skipped_existing", "skipped_finalized", "skipped_without_payload")


def migration_summary(outcomes: DataFrame) -> DataFrame:
    records = F.col("records")
    return outcomes.agg(*[
        F.coalesce(F.sum(F.when(F.col("outcome") == o, records)), F.lit(0)).alias(o) for o in OUTCOMES])


# --- sealed evidence ---------------------------------------------------------------------------------


def _bound_metadata() -> Column:
    """Metadata the cipher text is bound to, as canonical JSON."""
    fields = ("created_at", "quarantine_id", "reason", "sha256", "source", "writer_id")
    return F.to_json(F.struct(*fields))


def seal_evidence(df: DataFrame, key: Column, record: str = "record", iv: Column | None = None) -> DataFrame:
    """Digest and AES-256-GCM cipher text of canonical evidence; the data key comes from the caller."""
    from memgov.functions.jsontext import canonical_json

    nonce = F.unhex(F.substring(F.sha2(F.concat(F.uuid(), F.uuid()), 256), 1, 24)) if iv is None else iv
    df = df.withColumn("_plain", canonical_json(F.col(record))).withColumn("sha256", F.sha2("_plain", 256))
    df = df.withColumn("iv", nonce).withColumn("_aad", _bound_metadata())
    sealed = F.aes_encrypt(F.col("_plain").cast("binary"), key, F.lit("GCM"), F.lit("DEFAULT"),
                           F.col("iv"), F.col("_aad"))
    return df.withColumn("ciphertext_b64", F.base64(sealed)).drop("_plain", "_aad", "iv", record)


def open_evidence(df: DataFrame, key: Column) -> DataFrame:
    """Adds `record` and `open_error`: a failed tag, another digest, or metadata that differ."""
    plain = F.try_aes_decrypt(F.unbase64("ciphertext_b64"), key, F.lit("GCM"), F.lit("DEFAULT"),
                              F.col("_aad")).cast("string")
    df = df.withColumn("_aad", _bound_metadata()).withColumn("record", plain)
    parsed = F.try_parse_json("record")
    same = F.lit(True)
    for name in ("quarantine_id", "created_at", "reason", "writer_id", "source"):
        same = same & F.try_variant_get(parsed, f"$.{name}", "string").eqNullSafe(F.col(name))
    error = (
        F.when(F.col("record").isNull(), "decrypt_failed")
        .when(F.sha2("record", 256) != F.col("sha256"), "digest_mismatch")
        .when(~same, "metadata_mismatch")
    )
    return df.withColumn("open_error", error).drop("_aad")
