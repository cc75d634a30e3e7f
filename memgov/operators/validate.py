"""Body checks: each gives an ok row, or the code and message of the first broken rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgov import fixed
from memgov.functions.base64text import is_strict
from memgov.functions.jsontext import is_representable, too_deep
from memgov.functions.steps import held
from memgov.functions.text import is_blank


def kind_of(value: Column) -> Column:
    """string, boolean, integer, number, list, object, null, or SQL null where absent."""
    name = F.schema_of_variant(value)
    return (
        F.when(value.isNull(), None)
        .when(name == "VOID", "null")
        .when(name == "STRING", "string")
        .when(name == "BOOLEAN", "boolean")
        .when(name == "BIGINT", "integer")
        .when(name.startswith("ARRAY"), "list")
        .when(name.startswith("OBJECT"), "object")
        .otherwise("number")
    )


def _at(value: Column, key: str) -> Column:
    return F.variant_get(value, f"$.{key}", "variant")


def _items(value: Column) -> Column:
    """Elements of a list, or null for anything else."""
    return F.when(kind_of(value) == "list", F.try_variant_get(value, "$", "array<variant>"))


def _text(value: Column) -> Column:
    return F.try_variant_get(value, "$", "string")


def _not(value: Column, *allowed: str) -> Column:
    """Present, but of another kind."""
    return ~F.coalesce(kind_of(value).isin(*allowed), F.lit(True))


def _bad_strings(value: Column, *also: str) -> Column:
    """Neither a list of strings nor one of the kinds given; absent is fine."""
    entries = F.exists(_items(value), lambda v: kind_of(v) != "string")
    return _not(value, "list", *also) | F.coalesce(entries, F.lit(False))


def _bad_string_map(value: Column) -> Column:
    """Neither an object of strings nor null; absent is fine."""
    entries = F.when(
        kind_of(value) == "object", F.map_values(F.try_variant_get(value, "$", "map<string,variant>"))
    )
    wrong = F.exists(entries, lambda v: kind_of(v) != "string")
    return _not(value, "object", "null") | F.coalesce(wrong, F.lit(False))


def _bad_choice(value: Column, allowed: tuple[str, ...], *also: str) -> Column:
    choice = (kind_of(value) == "string") & ~_text(value).isin(*allowed)
    return _not(value, "string", *also) | F.coalesce(choice, F.lit(False))


def _item_error(item: Column, index: Column) -> Column:
    content = _at(item, "content")
    bad_content = (
        ~kind_of(content).eqNullSafe("string") | F.coalesce(is_blank(_text(content)), F.lit(True))
    )
    place = F.concat(F.lit("memory item "), index.cast("string"))
    return (
        F.when(kind_of(item) != "object", F.concat(place, F.lit(" must be an object")))
        .when(bad_content, F.concat(place, F.lit(" content must be a non-empty string")))
        .when(_not(_at(item, "context"), "string", "null"), F.lit("context must be a string or null"))
        .when(_not(_at(item, "document_id"), "string", "null"),
              F.lit("document_id must be a string or null"))
        .when(_bad_string_map(_at(item, "metadata")), F.lit("metadata must map strings to strings"))
        .when(_bad_strings(_at(item, "tags"), "null"), F.lit("tags must contain strings"))
        .when(_not(_at(item, "timestamp"), "string", "null"),
              F.lit("timestamp must be a string or null"))
        .when(_bad_choice(_at(item, "update_mode"), ("replace", "append"), "null"),
              F.lit("update_mode must be replace or append"))
    )


def _with_verdict(df: DataFrame, message: Column, code: str) -> DataFrame:
    return (
        df.withColumn("error_message", message)
        .withColumn("error_code", F.when(F.col("error_message").isNotNull(), F.lit(code)))
        .withColumn("ok", F.col("error_message").isNull())
        .drop("_value", "_items")
    )


def validate_retain(df: DataFrame, body: str = "body") -> DataFrame:
    """Shape of a write request. Adds ok, error_code and error_message."""
    df = held(df, _value=F.try_parse_json(body))
    df = held(df, _items=_items(_at(F.col("_value"), "items")))
    value = F.col("_value")
    first_bad = F.get(
        F.filter(
            F.transform(F.col("_items"), lambda item, i: _item_error(item, i)),
            lambda m: m.isNotNull(),
        ),
        F.lit(0),
    )
    message = (
        F.when(~kind_of(value).eqNullSafe("object"), "retain body must be an object")
        .when(~is_representable(F.col(body)), "retain body contains an unsupported JSON value")
        .when(F.coalesce(F.size("_items"), F.lit(0)) < 1,
              "retain body requires at least one memory item")
        .when(first_bad.isNotNull(), first_bad)
        .when(_not(_at(value, "async"), "boolean"), "async must be a boolean")
        .when(_bad_strings(_at(value, "document_tags")), "document_tags must contain strings")
    )
    return _with_verdict(df, message, "invalid_retain_body")


def validate_recall(df: DataFrame, body: str = "body") -> DataFrame:
    """Shape of a read request. Adds ok, error_code and error_message."""
    df = held(df, _value=F.try_parse_json(body))
    value = F.col("_value")
    query = _at(value, "query")
    limit = _at(value, "max_tokens")
    message = (
        F.when(~kind_of(value).eqNullSafe("object"), "recall body must be an object")
        .when(~is_representable(F.col(body)), "recall body contains an unsupported JSON value")
        .when(~kind_of(query).eqNullSafe("string") | F.coalesce(is_blank(_text(query)), F.lit(True)),
              "recall query must be a non-empty string")
        .when(_not(limit, "integer")
              | F.coalesce(F.try_variant_get(limit, "$", "bigint") <= 0, F.lit(False)),
              "max_tokens must be a positive integer")
        .when(_bad_choice(_at(value, "budget"), ("low", "mid", "high")),
              "budget must be low, mid, or high")
        .when(_bad_strings(_at(value, "types"), "null"), "types must contain strings")
        .when(_bad_strings(_at(value, "tags"), "null"), "tags must contain strings")
        .when(_not(_at(value, "tags_match"), "string"), "tags_match must be a string")
        .when(_not(_at(value, "trace"), "boolean"), "trace must be a boolean")
    )
    return _with_verdict(df, message, "invalid_recall_body")


def validate_bank_response(df: DataFrame, body: str = "body") -> DataFrame:
    """A recall answer: results of id and text strings; maps are objects or null."""
    df = held(df, _value=F.try_parse_json(body))
    value = F.col("_value")
    results = _items(_at(value, "results"))
    broken = F.exists(
        results,
        lambda r: ~kind_of(_at(r, "id")).eqNullSafe("string")
        | ~kind_of(_at(r, "text")).eqNullSafe("string"),
    )
    message = F.when(too_deep(F.col(body)) | ~is_representable(F.col(body)), "unsupported JSON value").when(
        ~kind_of(value).eqNullSafe("object") | results.isNull() | broken, "invalid results"
    )
    for name in ("chunks", "entities", "source_facts", "trace"):
        message = message.when(_not(_at(value, name), "object", "null"), f"invalid {name}")
    return _with_verdict(df, message, "upstream_invalid_response")


# --- fixed values: required response fields by method and resource -----------------------------
FACADE_FIELDS = (
    ("PUT", "", False, (("bank_id", "string"), ("name", "string"), ("disposition", "object"),
                        ("mission", "string"))),
    ("PATCH", "config", False, (("bank_id", "string"), ("config", "object"), ("overrides", "object"))),
    ("POST", "mental-models", False, (("operation_id", "string"),)),
    ("GET", "mental-models", True, (("id", "string"), ("bank_id", "string"), ("name", "string"))),
    ("PATCH", "mental-models", True, (("id", "string"), ("bank_id", "string"), ("name", "string"))),
    ("POST", "reflect", None, (("text", "string"),)),
)


def validate_facade_response(df: DataFrame, body: str = "response") -> DataFrame:
    """Response contract by method, resource and presence of an item id."""
    df = held(df, _value=F.try_parse_json(body))
    value, method, resource = F.col("_value"), F.col("method"), F.col("resource")
    with_item = F.col("item_id").isNotNull()

    def lacks(source: Column, fields) -> Column:
        test = ~kind_of(source).eqNullSafe("object")
        for name, kind in fields:
            test = test | ~kind_of(_at(source, name)).eqNullSafe(kind)
        return test

    deleted = (method == "DELETE") & (resource == "mental-models") & with_item
    listed = (method == "GET") & (resource == "mental-models") & ~with_item
    model = (("id", "string"), ("bank_id", "string"), ("name", "string"))
    entries = _items(_at(value, "items"))
    bad_list = (
        ~kind_of(value).eqNullSafe("object")
        | entries.isNull()
        | F.coalesce(F.exists(entries, lambda e: lacks(e, model)), F.lit(True))
    )
    bad = F.when(deleted, ~F.coalesce(kind_of(value).isin("object", "null"), F.lit(True))).when(
        listed, bad_list
    )
    for verb, name, item, fields in FACADE_FIELDS:
        here = (method == verb) & (resource == name)
        if item is not None:
            here = here & (with_item if item else ~with_item)
        wrong = lacks(value, fields)
        if name == "mental-models" and verb == "POST":
            wrong = wrong | _not(_at(value, "mental_model_id"), "string", "null")
        bad = bad.when(here, wrong)
    bad = bad.otherwise(F.lit(True))
    return _with_verdict(df, F.when(bad, "invalid facade response"), "upstream_invalid_response")


# --- bounds --------------------------------------------------------------------------------------


def item_count(body: Column) -> Column:
    return F.size(F.try_variant_get(F.try_parse_json(body), "$.items", "array<variant>"))


def check_retain_bounds(
    df: DataFrame, limits: fixed.TrafficLimits = fixed.TrafficLimits(),
    items: str = "item_count", size: str = "value_bytes",
) -> DataFrame:
    """Adds bound_code: too many items or too many bytes."""
    code = F.when(F.col(items) > limits.retain_items, "retain_item_limit_exceeded").when(
        F.col(size) > limits.retain_bytes, "retain_content_too_large"
    )
    return df.withColumn("bound_code", code)


def check_recall_bounds(
    df: DataFrame, limits: fixed.TrafficLimits = fixed.TrafficLimits(),
    query: str = "query", max_tokens: str = "max_tokens",
) -> DataFrame:
    code = F.when(F.octet_length(query) > limits.query_bytes, "recall_query_too_large").when(
        F.col(max_tokens) > limits.max_tokens, "recall_max_tokens_exceeded"
    )
    return df.withColumn("bound_code", code)


# --- evidence and envelopes ------------------------------------------------------------------------

EXTRA_REASONS = (
    "recalled_suspicious_supplemental",
    "facade_unknown_writer",
    "facade_suspicious_request",
    "facade_suspicious_response",
)


def validate_evidence(df: DataFrame, record: str = "record") -> DataFrame:
    """A quarantine record before sealing; our audit reasons are accepted too."""
    df = held(df, _value=F.try_parse_json(record))
    value = F.col("_value")

    def missing(name):
        return F.coalesce(_text(_at(value, name)), F.lit("")) == ""

    def not_text(name):
        return ~kind_of(_at(value, name)).eqNullSafe("string") | missing(name)

    message = F.when(~kind_of(value).eqNullSafe("object"),
                     "decrypted quarantine object must be an object")
    for name in ("quarantine_id", "created_at", "reason"):
        message = message.when(not_text(name), f"{name} must be a non-empty string")
    message = message.when(
        ~_text(_at(value, "reason")).isin(*fixed.EVIDENCE_REASONS, *EXTRA_REASONS),
        "invalid quarantine reason",
    ).when(_at(value, "payload").isNull(), "decrypted quarantine payload is missing")
    for name in ("writer_id", "source"):
        message = message.when(_at(value, name).isNotNull() & not_text(name),
                               f"{name} must be a non-empty string")
    return _with_verdict(df, message, "invalid_decrypted_quarantine")


def validate_envelope(df: DataFrame, envelope: str = "envelope") -> DataFrame:
    """The stored form: versions, algorithms, id, digest and strict base64 parts."""
    df = held(df, _value=F.try_parse_json(envelope))
    value = F.col("_value")
    box = _at(value, "encryption")

    def same(name, text):
        return _text(_at(box, name)).eqNullSafe(text)

    def loose(source, name):
        part = _text(_at(source, name))
        return ~kind_of(_at(source, name)).eqNullSafe("string") | ~F.coalesce(is_strict(part), F.lit(False))

    def size(name):
        part = _text(_at(box, name))
        return F.octet_length(F.unbase64(F.when(is_strict(part), part)))

    message = (
        F.when(~kind_of(box).eqNullSafe("object"), "encrypted quarantine envelope must be an object")
        .when(~F.try_variant_get(value, "$.version", "int").eqNullSafe(1),
              "unsupported quarantine envelope version")
        .when(~same("algorithm", "AES-256-GCM"), "unsupported quarantine encryption algorithm")
        .when(~same("key_wrap", "RSA-OAEP-SHA256"), "unsupported quarantine key wrapping algorithm")
        .when(~F.coalesce(kind_of(_at(box, "aad")) == "null", F.lit(True)) & ~same("aad", "metadata-v1"),
              "unsupported quarantine AAD format")
        .when(~F.coalesce(_text(_at(value, "quarantine_id")).rlike(fixed.QUARANTINE_ID), F.lit(False)),
              "invalid quarantine_id")
        .when(~F.coalesce(_text(_at(value, "reason")).isin(*fixed.EVIDENCE_REASONS, *EXTRA_REASONS),
                          F.lit(False)), "invalid quarantine reason")
        .when(~F.coalesce(_text(_at(value, "sha256")).rlike("^[0-9a-f]{64}$"), F.lit(False)),
              "invalid quarantine object digest")
    )
    for name in ("wrapped_key_b64", "iv_b64", "tag_b64"):
        message = message.when(loose(box, name), f"{name} must be valid base64")
    message = (
        message.when(~size("iv_b64").eqNullSafe(12), "invalid AES-GCM initialization vector length")
        .when(~size("tag_b64").eqNullSafe(16), "invalid AES-GCM authentication tag length")
        .when(loose(value, "ciphertext_b64"), "ciphertext_b64 must be valid base64")
    )
    return _with_verdict(df, message, "invalid_envelope")
