"""Policy decisions over tables of requests, results and access rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgov import fixed
from memgov.functions import identity
from memgov.functions.jsontext import audit_digest, is_representable, too_deep, well_formed, with_value_bytes
from memgov.functions.paths import resolve_routes
from memgov.operators import routing
from memgov.operators.quota import admit_quota
from memgov.operators.scan import is_safe, scan
from memgov.operators.validate import check_retain_bounds, item_count, validate_retain
from memgov.operators.walk import json_entries, walk_extras, walk_result, with_units
from memgov.session import cut_lineage
from memgov.sources.requests import checked_bodies

STAMPS = ("router_writer_id", "router_source", "router_decision", "router_target_bank")


def stamp_items(items: Column, writer: Column, source: Column, bank: Column, decision: str) -> Column:
    """Provenance in the metadata of every memory item; stamped keys win over the caller's."""
    stamp = F.create_map(
        F.lit(STAMPS[0]), writer, F.lit(STAMPS[1]), source,
        F.lit(STAMPS[2]), F.lit(decision), F.lit(STAMPS[3]), bank,
    )

    def one(item: Column) -> Column:
        own = F.map_filter(item["metadata"], lambda k, v: ~k.isin(*STAMPS))
        merged = F.when(own.isNull(), stamp).otherwise(F.map_concat(own, stamp))
        return item.withField("metadata", merged)

    return F.transform(items, one)


def _evidence(action: str) -> Column:
    return identity.request_payload(action, F.col("writer_id"), F.col("body"))


def _refused(requests: DataFrame, units: str | None) -> DataFrame:
    """Adds error_code: why a body is not decided at all. A `parse_error` or `refusal` column goes first; a
    body that is missing or no JSON is refused as well, whoever read it."""
    codes = [F.col(c) for c in ("parse_error", "refusal") if c in requests.columns]
    if units is None:
        codes.append(F.when(~F.coalesce(well_formed(F.col("body")), F.lit(False)), "invalid_json"))
    return requests.withColumn("error_code", F.coalesce(*codes, F.lit(None).cast("string")))


def decide_retain(requests: DataFrame, writers: DataFrame, units: str | None = None) -> DataFrame:
    """Write requests: allowed into the write bank, quarantined with reason and findings, or invalid.

    Invalid requests have an error_code, are not scanned and name no bank. `units` names a column of
    scan units made beforehand; otherwise the JSON body is walked.
    """
    routed = routing.route_writers(_refused(requests, units), writers)
    if units is None:
        routed, units = with_units(routed, "body", "retain"), "units"
    # Unknown writers are refused unseen, so their text is not scanned.
    seen = F.col("known_writer") & F.col("error_code").isNull()
    scanned = scan(routed.withColumn(units, F.when(seen, F.col(units))), units)
    return (
        _decided(scanned, "suspicious_content", "allowed")
        .withColumn("target_bank", F.when(seen, F.col("write_bank")))
        .drop(units)
    )


def _decided(scanned: DataFrame, suspicious: str, passed: str) -> DataFrame:
    invalid = F.col("error_code").isNotNull()
    reason = F.when(invalid, F.lit(None)).when(~F.col("known_writer"), "unknown_writer").when(~is_safe(), suspicious)
    decision = F.when(invalid, "invalid").when(F.col("reason").isNotNull(), "quarantined").otherwise(passed)
    return scanned.withColumn("reason", reason.cast("string")).withColumn("decision", decision)


def decide_recall(requests: DataFrame, writers: DataFrame, units: str | None = None) -> DataFrame:
    """Read requests: fan out, an empty answer and a quarantined request, or invalid with an error_code."""
    routed = routing.route_writers(_refused(requests, units), writers)
    if units is None:
        routed, units = with_units(routed, "body", "recall"), "units"
    seen = F.col("known_writer") & F.col("error_code").isNull()
    scanned = scan(routed.withColumn(units, F.when(seen, F.col(units))), units)
    return (
        _decided(scanned, "suspicious_query", "fan_out")
        .withColumn("target_bank", F.when(seen, identity.recall_target(F.col("read_banks"))))
        .drop(units)
    )


ITEM = ("struct<content:string,context:string,document_id:string,metadata:map<string,string>,tags:array<string>,"
        "timestamp:string,update_mode:string>")


@dataclass(frozen=True)
class RetainOutcome:
    """What becomes of write requests: one decision each, rows for the banks, evidence for quarantine."""

    decisions: DataFrame
    bank_rows: DataFrame
    candidates: DataFrame


def retain_chain(requests: DataFrame, writers: DataFrame, limits: fixed.TrafficLimits = fixed.TrafficLimits(),
                 at: str = "at") -> RetainOutcome:
    """Write requests from raw body to outcome: parse, shape, bounds, route, scan, quota, stamp.

    Needs request_id, writer_id, ts_ms, the raw body and an ISO text `at`. A decision is invalid or
    quarantined (with code or reason), rate_limited, or allowed. Only allowed requests use quota. Bank rows
    are the items of allowed requests with their stamps.
    """
    shaped = validate_retain(checked_bodies(requests)).withColumnRenamed("error_code", "shape_code")
    sized = with_value_bytes(shaped.withColumn("item_count", item_count(F.col("body"))))
    bounded = check_retain_bounds(sized, limits).withColumn("refusal", F.coalesce("shape_code", "bound_code"))
    decided = cut_lineage(decide_retain(bounded, writers), "retain-chain")
    allowed = decided.filter(F.col("decision") == "allowed")
    quota = admit_quota(allowed.select("request_id", "writer_id", "ts_ms"), limits.retain_writer, limits.retain_global, limits.window_ms)
    judged = decided.join(quota.select("request_id", "admitted", "retry_after_s"), "request_id", "left")
    judged = cut_lineage(judged.withColumn("decision", F.when(F.col("admitted") == F.lit(False), "rate_limited").otherwise(F.col("decision"))),
                         "retain-judged")
    items = F.from_json(F.get_json_object("body", "$.items"), f"array<{ITEM}>")
    stamped = judged.filter(F.col("decision") == "allowed").withColumn("items", items)
    stamped = stamped.withColumn("items", stamp_items(F.col("items"), F.col("writer_id"), F.col("source"), F.col("target_bank"), "allowed"))
    rows = stamped.select("request_id", "target_bank", F.posexplode("items").alias("item_pos", "item"))
    return RetainOutcome(judged, rows.select("request_id", "target_bank", "item_pos", "item.*"),
                         quarantine_candidates(judged, "retain_request", at))


def quarantine_candidates(decided: DataFrame, kind: str, at: str = "at") -> DataFrame:
    """Evidence rows of refused requests, keyed so that repeats merge. Needs an `at` ISO text."""
    action = "retain" if kind == "retain_request" else "recall"
    refused = decided.filter(F.col("decision") == "quarantined").withColumn("payload", _evidence(action))
    key = identity.request_dedupe_key(
        F.lit(kind), F.col("writer_id"), F.col("target_bank"), F.col("payload")
    )
    nothing = F.lit(None).cast("string")
    return (
        refused.withColumn("kind", F.lit(kind))
        .withColumn("dedupe_key", key)
        .withColumn("source_bank", nothing).withColumn("source_memory_id", nothing)
        .withColumn("source_content_sha256", nothing)
        .withColumn(
            "quarantine_id",
            identity.quarantine_id(F.col("kind"), F.col("dedupe_key"), nothing, nothing, F.col(at)),
        )
    )


# --- recalled memories ---------------------------------------------------------------------------


def decide_recalled(results: DataFrame, items: DataFrame) -> DataFrame:
    """Each recalled memory: allow, suppress or requarantine, by state, digest and scan; invalid if the
    result is no JSON or nested too deep, which ends neither the job nor the other results.

    Rows whose outcome does not depend on a scan are not scanned; approved text is not scanned
    again, but its other fields are.
    """
    df = routing.with_memory_state(results, items)
    readable = F.coalesce(well_formed(F.col("result")) & ~too_deep(F.col("result")), F.lit(False))
    df = df.withColumn("content_sha256", identity.recalled_digest(F.col("memory_id"), F.col("text")))
    same = F.col("state_sha256").eqNullSafe(F.col("content_sha256"))
    closed = F.col("state").isin("reviewed_blocked", *fixed.UNDER_REVIEW)
    approved = F.col("state") == "reviewed_allowed"
    waiting = F.col("state").isin(*fixed.REVIEWABLE)
    mode = (
        F.when(~readable, "invalid")
        .when(closed, "closed")
        .when(approved & same, "extras")
        .when(approved, "changed")
        .when(waiting & same, "waiting")
        .when(waiting, "changed")
        .otherwise("whole")
    )
    df = df.withColumn("_mode", mode)
    df = df.withColumn("_whole", walk_result(F.when(F.col("_mode").isin("whole", "changed"), F.col("result"))))
    df = df.withColumn("_extras", walk_extras(F.when(F.col("_mode") == "extras", F.col("result"))))
    df = scan(df.withColumn("units", F.coalesce("_whole", "_extras")).drop("_whole", "_extras"))
    safe = is_safe()
    outcome = (
        F.when(F.col("_mode") == "invalid", "invalid")
        .when(F.col("_mode").isin("closed", "waiting"), "suppress")
        .when(F.col("_mode") == "changed", "requarantine")
        .when(safe, "allow")
        .when(F.col("_mode") == "extras", "requarantine")
        .otherwise("quarantine")
    )
    return df.withColumn("outcome", outcome).drop("_mode", "units")


SUPPLEMENTS = ("chunks", "entities", "source_facts")


def filter_supplementals(responses: DataFrame) -> DataFrame:
    """Entries of the side maps with a verdict; the trace is one entry with a null key.

    Unsafe entries carry the digest and key for their audit row.
    """
    def entry(field: str, key: Column, value: Column) -> Column:
        return F.struct(F.lit(field).alias("field"), key.alias("key"), value.alias("value"))

    # One pass over the answers: all maps and the trace become one list of entries.
    parts = responses
    for name in SUPPLEMENTS:
        parts = parts.withColumn(f"_{name}", json_entries(F.col(name)))
    nothing = F.array().cast("array<struct<key:string,value:string>>")

    def listed(field: str) -> Column:
        return F.transform(F.coalesce(f"_{field}", nothing), lambda e: entry(field, e["key"], e["value"]))

    lists = [listed(name) for name in SUPPLEMENTS]
    is_map = F.coalesce(F.col("trace").startswith("{") & well_formed(F.col("trace")), F.lit(False))
    lists.append(F.when(is_map, F.array(entry("trace", F.lit(None).cast("string"), F.col("trace"))))
                 .otherwise(F.array().cast("array<struct<field:string,key:string,value:string>>")))
    entries = parts.select("request_id", "bank_id", "bank_pos", F.inline(F.concat(*lists)))
    of_map = F.concat(F.lit('{"'), F.col("field"), F.lit('":{'), identity.json_text(F.col("key")), F.lit(":"), F.col("value"), F.lit("}}"))
    entries = entries.withColumn("evidence", F.when(F.col("field") == "trace", F.concat(F.lit('{"trace":'), F.col("value"), F.lit("}"))).otherwise(of_map))
    scanned = scan(with_units(entries, "evidence", "recalled_memory")).drop("units")
    digest = audit_digest(F.when(~is_safe(), F.col("evidence")))
    return scanned.withColumn("safe", is_safe()).withColumn("content_sha256", digest).withColumn(
        "dedupe_key",
        F.when(
            ~F.col("safe"),
            F.concat_ws(":", F.lit("recalled-supplemental"), "bank_id", "field",
                        F.coalesce(F.when(F.col("key") != "", F.col("key")), F.lit("-")),
                        "content_sha256"),
        ),
    )


def assemble_response(responses: DataFrame, results: DataFrame, entries: DataFrame) -> DataFrame:
    """Answer per request: allowed results in bank order, side maps with the later bank winning.

    A request's answer is bounded by the size limit on bank responses. `has_*` tells an absent
    field from one that was null everywhere; a map whose entries were all dropped is empty.
    """
    per_request = responses.groupBy("request_id").agg(
        *[F.max(F.col(n).isNotNull()).alias(f"has_{n}") for n in (*SUPPLEMENTS, "trace")],
        *[F.coalesce(F.max(F.col(n).startswith("{")), F.lit(False)).alias(f"_map_{n}")
          for n in (*SUPPLEMENTS, "trace")],
    )
    allowed = results.filter(F.col("outcome") == "allow")
    texts = allowed.groupBy("request_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("bank_pos", "pos", "result"))), lambda r: r["result"]
        ).alias("results")
    )
    # The whole trace of a bank is merged key by key as well.
    safe = entries.filter("safe")
    traced = safe.filter("field = 'trace'").withColumn("_t", json_entries(F.col("value")))
    flat = safe.filter("field <> 'trace'").select("request_id", "bank_pos", "field", "key", "value").unionByName(
        traced.select("request_id", "bank_pos", "field", F.explode("_t").alias("_e")).select(
            "request_id", "bank_pos", "field", "_e.key", "_e.value")
    )
    last = flat.groupBy("request_id", "field", "key").agg(F.max_by("value", "bank_pos").alias("value"))
    maps = last.groupBy("request_id").pivot("field", [*SUPPLEMENTS, "trace"]).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value"))))
    )
    empty = F.array().cast("array<string>")
    nothing = F.create_map().cast("map<string,string>")
    merged = {n: F.when(F.col(f"_map_{n}"), F.coalesce(F.col(n), nothing)) for n in (*SUPPLEMENTS, "trace")}
    return (
        per_request.join(texts, "request_id", "left")
        .join(maps, "request_id", "left")
        .withColumns({"results": F.coalesce("results", empty), **merged})
        .drop(*[f"_map_{n}" for n in merged])
    )


# --- fixed values: upstream failures ---------------------------------------------------------------
UPSTREAM = (
    ("timeout", "upstream_timeout", "Upstream memory service timed out", 504),
    ("http", "upstream_http_error", "Upstream memory service request failed", 502),
    ("invalid-response", "upstream_invalid_response",
     "Upstream memory service returned an invalid response", 502),
    ("network", "upstream_unavailable", "Upstream memory service is unavailable", 502),
    ("response-too-large", "upstream_response_too_large",
     "Upstream memory service response exceeded the size limit", 502),
)


def map_upstream_error(df: DataFrame, kind: str = "error_kind") -> DataFrame:
    """Code, message and status of an upstream failure kind."""
    code = F.create_map(*[F.lit(v) for k, c, _, _ in UPSTREAM for v in (k, c)])
    text = F.create_map(*[F.lit(v) for k, _, m, _ in UPSTREAM for v in (k, m)])
    return (
        df.withColumn("error_code", F.try_element_at(code, F.col(kind)))
        .withColumn("error_message", F.try_element_at(text, F.col(kind)))
        .withColumn("http_status", F.when(F.col(kind) == "timeout", 504).when(F.col(kind).isNotNull(), 502))
    )


# --- fixed values: degraded error kinds ---------------------------------------------------------------
DEGRADED = (
    ("quarantine_capacity_exceeded", "capacity"),
    ("quarantine_writer_capacity_exceeded", "capacity"),
    ("quarantine_rate_limited", "rate-limit"),
    ("quarantine_item_too_large", "payload-too-large"),
    ("quarantine_request_in_review", "conflict"),
    ("quarantine_item_in_review", "conflict"),
)


def map_degradation(df: DataFrame, code: str = "code", event: str = "event") -> DataFrame:
    """Short error kind and severity of a degraded answer; unknown codes stay as they are."""
    kinds = F.create_map(*[F.lit(v) for pair in DEGRADED for v in pair])
    return df.withColumn("error_kind", F.coalesce(F.try_element_at(kinds, F.col(code)), F.col(code))).withColumn(
        "level",
        F.when(F.col(event) == "recall_supplemental_audit_unavailable", "error").otherwise("warning"),
    )


def isolate_bank_errors(responses: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Answers of the banks that worked, and one degradation row per bank that failed."""
    good = responses.filter(F.col("error_kind").isNull())
    failed = map_upstream_error(responses.filter(F.col("error_kind").isNotNull()))
    return good, failed.select(
        "request_id", "bank_id", "error_kind", "error_code", "http_status",
        F.lit("bank_unavailable").alias("event"), F.lit("warning").alias("level"),
    )


# --- sizes and placeholders ------------------------------------------------------------------------------


def sealed_bytes(plain_bytes: Column, quarantine_id: Column, created_at: Column, reason: Column,
                 writer: Column, source: Column, key_bytes: int = 256) -> Column:
    """Stored size of an envelope, before anything is encrypted."""
    frame = (
        '{"version":1,"quarantine_id":"","created_at":"","reason":"","sha256":"","encryption":'
        '{"algorithm":"AES-256-GCM","key_wrap":"RSA-OAEP-SHA256","aad":"metadata-v1",'
        '"wrapped_key_b64":"","iv_b64":"","tag_b64":""},"ciphertext_b64":""}'
    )
    fixed_part = len(frame) + 64 + 16 + 24 + 4 * ((key_bytes + 2) // 3)

    def optional(name, value):
        size = F.octet_length(identity.json_text(value)) + len(f',"{name}":')
        return F.when(value.isNull(), 0).otherwise(size)

    cipher = F.floor((plain_bytes + 2) / 3) * 4
    named = F.octet_length(quarantine_id) + F.octet_length(created_at) + F.octet_length(reason)
    return F.lit(fixed_part) + cipher + named + optional("writer_id", writer) + optional("source", source)


def plain_record(payload: Column) -> Column:
    """JSON text of an evidence record before it is sealed."""
    from memgov.functions.identity import json_text

    def optional(name, value):
        return F.when(value.isNull(), F.lit("")).otherwise(
            F.concat(F.lit(f'"{name}":'), json_text(value), F.lit(","))
        )

    return F.concat(
        F.lit('{"quarantine_id":'), json_text(F.col("quarantine_id")),
        F.lit(',"created_at":'), json_text(F.col("created_at")),
        F.lit(',"reason":'), json_text(F.col("reason")), F.lit(","),
        optional("writer_id", F.col("writer_id")), optional("source", F.col("source")),
        F.lit('"payload":'), payload, F.lit("}"),
    )


def placeholder_reason(size: Column, body: Column, limit: int = fixed.QuarantineLimits.item_bytes) -> Column:
    """Why evidence can only be kept as a digest: too large, or without a canonical form."""
    return F.when(~is_representable(body), "not_canonical").when(size > limit, "too_large")


def placeholder_rows(df: DataFrame, kind: str, payload: str = "body") -> DataFrame:
    """Digest-only security events in place of evidence that cannot be stored."""
    digest = audit_digest(F.col(payload))
    if kind == "recalled_memory":
        action, head = "recalled_memory_too_large", F.concat_ws(
            ":", F.lit("oversized-recalled"), "bank_id", F.coalesce("memory_id", F.lit("unknown")))
    else:
        action, head = "recall_request_too_large", F.concat_ws(
            ":", F.lit("oversized-recall"), "writer_id", "reason")
    key = F.concat(head, F.lit(":"), F.col("content_sha256"))
    nothing = F.lit(None).cast("string")
    return (
        df.withColumn("content_sha256", digest)
        .withColumn("kind", F.lit("security_event"))
        .withColumn("action", F.lit(action))
        .withColumn("dedupe_key", key)
        .withColumn("quarantine_id", identity.split_digest_id("q_security", F.col("dedupe_key")))
        .withColumn("source_bank", nothing).withColumn("source_memory_id", nothing)
        .drop(payload)
    )


# --- access rows -------------------------------------------------------------------------------------------


def denied_endpoints(access: DataFrame, cap: int = 64) -> DataFrame:
    """Unsupported calls as security events; past 64 identities they share one."""
    denied = resolve_routes(access).filter(F.col("operation") == "denied")
    scoped = F.concat(F.lit("anonymous:"), identity.security_event_key(F.col("method"), F.col("path")))
    capped = routing.cap_identities(denied.withColumn("scoped", scoped), cap=cap)
    return capped.withColumn("kind", F.lit("security_event")).withColumn(
        "reason", F.lit("denied_endpoint")
    ).withColumn("quarantine_id", identity.split_digest_id("q_security", F.col("dedupe_key")))


def auth_failures(access: DataFrame) -> DataFrame:
    """One event per route group with its count; recognised tokens of another scope are not kept."""
    routed = resolve_routes(access).filter(F.col("status") == 401)
    group = F.when(F.col("route_class") == "admin", "admin").otherwise("router")
    kept = routed.filter(~F.col("token_recognized")) if "token_recognized" in access.columns else routed
    key = F.concat(F.lit("auth_failed:"), F.col("route_group"))
    return (
        kept.withColumn("route_group", group)
        .groupBy("route_group")
        .agg(F.count("*").alias("failures"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"))
        .withColumn("dedupe_key", key)
        .withColumn("quarantine_id", identity.split_digest_id("q_security", F.col("dedupe_key")))
    )


# --- facade calls --------------------------------------------------------------------------------------------


def decide_facade(calls: DataFrame) -> DataFrame:
    """First failure of a facade call as code and status.

    Needs known_writer, request_safe, bound_code, admitted, upstream_kind, response_safe and
    response_ok, as the operators before this one leave them.
    """
    code = (
        F.when(~F.col("known_writer"), "unknown_writer")
        .when(~F.col("request_safe"), "suspicious_content")
        .when(F.col("bound_code").isNotNull(), F.col("bound_code"))
        .when(~F.col("admitted"), "rate_limited")
        .when(F.col("upstream_kind").isNotNull(), F.col("upstream_kind"))
        .when(~F.col("response_safe"), "upstream_unsafe_response")
        .when(~F.col("response_ok"), "upstream_invalid_response")
    )
    status = (
        F.when(~F.col("known_writer"), 404)
        .when(~F.col("request_safe"), 422)
        .when(F.col("bound_code").isNotNull(), 413)
        .when(~F.col("admitted"), 429)
        .when(F.col("upstream_kind") == "timeout", 504)
        .when(F.col("upstream_kind").isNotNull() | ~F.col("response_safe") | ~F.col("response_ok"), 502)
        .otherwise(200)
    )
    audit = (
        F.when(~F.col("known_writer"), "facade_unknown_writer")
        .when(~F.col("request_safe"), "facade_suspicious_request")
        .when((F.col("bound_code").isNull()) & F.col("admitted") & F.col("upstream_kind").isNull()
              & ~F.col("response_safe"), "facade_suspicious_response")
    )
    return calls.withColumn("code", code).withColumn("http_status", status).withColumn("audit_reason", audit)


def facade_audit(calls: DataFrame, evidence: str = "evidence") -> DataFrame:
    """Audit rows of blocked facade calls: reason, writer and digest, never the text."""
    blocked = calls.filter(F.col("audit_reason").isNotNull())
    digest = audit_digest(F.col(evidence))
    key = F.concat_ws(":", "audit_reason", "writer_id", "content_sha256")
    return (
        blocked.withColumn("content_sha256", digest)
        .withColumn("dedupe_key", key)
        .withColumn("quarantine_id", identity.split_digest_id("q_security", F.col("dedupe_key")))
        .drop(evidence)
    )


# --- approvals ----------------------------------------------------------------------------------------------


def gate_approvals(decisions: DataFrame, writers: DataFrame, items_limit: int = 100,
                   bytes_limit: int = 524_288) -> DataFrame:
    """Approvals of write requests: registered writer, valid body, rescan, bounds.

    Needs writer_id, body, reason, ok, error_code, item_count and value_bytes. An unsafe body
    passes only if it was quarantined for its content.
    """
    routed = routing.route_writers(decisions, writers)
    scanned = scan(with_units(routed, "body", "retain")).drop("units")
    code = (
        F.when(F.coalesce(F.col("writer_id"), F.lit("")) == "", "invalid_request")
        .when(~F.col("known_writer"), "writer_not_registered")
        .when(~F.col("ok"), F.col("error_code"))
        .when(~is_safe() & (F.col("reason") != "suspicious_content"),
              "quarantine_security_review_required")
        .when(F.col("item_count") > items_limit, "retain_item_limit_exceeded")
        .when(F.col("value_bytes") > bytes_limit, "retain_content_too_large")
    )
    return scanned.withColumn("gate_code", code)


