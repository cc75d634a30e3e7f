"""Digests, keys and ids derived from rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from memgov.functions.jsontext import canonical_json, family_forms, sha256_text


def json_text(text: Column) -> Column:
    """A JSON string, or the word null."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNull(), F.lit("null")).otherwise(
        F.substring(wrapped, F.lit(6), F.length(wrapped) - 6)
    )


def request_dedupe_key(kind: Column, writer: Column, target: Column, payload: Column) -> Column:
    """Digest of kind, writer, target and payload; key order is irrelevant, text is exact."""
    whole = F.concat(
        F.lit('{"kind":'), json_text(kind),
        F.lit(',"payload":'), payload,
        F.lit(',"target":'), json_text(target),
        F.lit(',"writer_id":'), json_text(writer), F.lit("}"),
    )
    return sha256_text(canonical_json(whole))


def request_payload(action: str, writer: Column, body: Column) -> Column:
    return F.concat(
        F.lit(f'{{"action":"{action}","body":'), body, F.lit(',"writer_id":'), json_text(writer),
        F.lit("}"),
    )


def recall_target(read_banks: Column) -> Column:
    return F.when(F.size(read_banks) > 0, F.array_join(F.array_sort(read_banks), ","))


def security_event_key(method: Column, path: Column) -> Column:
    bare = F.rtrim(F.lower(F.regexp_replace(path, r"(?s)[?#].*", "")), F.lit("/"))
    return F.concat(F.upper(method), F.lit(":"), F.when(bare == "", F.lit("/")).otherwise(bare))


def split_digest_id(prefix: str, key: Column) -> Column:
    digest = sha256_text(key)
    return F.concat(F.lit(prefix), F.substring(digest, 1, 48), F.lit("_"), F.substring(digest, 49, 16))


def quarantine_id(
    kind: Column, dedupe_key: Column, bank: Column, memory_id: Column, at: Column
) -> Column:
    """Stable id from the identity of the evidence; only items without one get a random suffix."""
    stamp = F.regexp_replace(at, "[^0-9A-Za-z]", "")
    suffix = F.substring(F.replace(F.uuid(), F.lit("-"), F.lit("")), 1, 16)
    return (
        F.when((kind == "security_event") & dedupe_key.isNotNull() & (dedupe_key != ""),
               split_digest_id("q_security", dedupe_key))
        .when(kind.isin("retain_request", "recall_request") & dedupe_key.isNotNull()
              & (dedupe_key != ""),
              split_digest_id("q_request", dedupe_key))
        .when((kind == "recalled_memory") & bank.isNotNull() & memory_id.isNotNull(),
              split_digest_id("q_memory", F.concat(bank, F.lit(":"), memory_id)))
        .otherwise(F.concat(F.lit("q_"), stamp, F.lit("_"), suffix))
    )


def recalled_digest(memory_id: Column, text: Column) -> Column:
    """Digest of id and text; fields that change between reads are left out."""
    return sha256_text(
        canonical_json(F.concat(F.lit('{"id":'), json_text(memory_id), F.lit(',"text":'),
                                json_text(text), F.lit("}")))
    )


def request_family(kind: Column, reason: Column, writer: Column, payload: Column) -> Column:
    """(scope, digest) of near-identical requests; null for other kinds."""
    owner = F.when(reason == "unknown_writer", F.lit("unknown-writer")).otherwise(
        F.coalesce(F.when(writer != "", writer), F.lit("anonymous"))
    )
    forms = family_forms(F.when(kind.isin("retain_request", "recall_request"), payload))

    def digest(index: int) -> Column:
        return sha256_text(
            F.concat(F.lit('{"kind":'), json_text(kind), F.lit(',"payload":'), forms[index],
                     F.lit(',"reason":'), json_text(reason), F.lit("}"))
        )

    return F.when(
        forms.isNotNull(),
        F.struct(
            F.concat_ws(":", kind, reason, owner).alias("scope"),
            sha256_text(F.concat(digest(0), F.lit(":"), digest(1))).alias("digest"),
        ),
    )


def opaque_id(text: Column, prefix: str) -> Column:
    return F.concat(F.lit(f"{prefix}:"), F.substring(sha256_text(F.substring(text, 1, 512)), 1, 16))


def site_fingerprint(source: Column) -> Column:
    return F.concat(F.lit("site:"), F.substring(sha256_text(source), 1, 16))


def event_id(batch_id: Column, item_id: Column, event_type: Column) -> Column:
    """Replaying a batch gives the same event ids."""
    return sha256_text(F.concat_ws("|", batch_id, item_id, event_type))


def packed_hex(text: Column) -> Column:
    """Text that is lower-case hex as bytes, which a shuffle cannot compress otherwise; other text as it is."""
    exact = F.lower(F.hex(F.unhex(text))).eqNullSafe(text)
    return F.struct(F.when(exact, F.unhex(text)).alias("bytes"), F.when(~exact, text).alias("text"))


def unpacked_hex(packed: Column) -> Column:
    return F.coalesce(F.lower(F.hex(packed["bytes"])), packed["text"])
