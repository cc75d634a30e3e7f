"""Queries over bodies: checks, bounds, canonical form, digests and families."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgov.functions import identity, jsontext, text as texts
from memgov.operators import validate
from memgov.plans import inputs
from memgov.plans.catalog import query
from memgov.sources.requests import checked_bodies
from memgov.sources.registry import read_bank_rows, registry_errors

# JSON texts by kind, around a JSON string ~.
KINDS = {"string": "~", "null": "null", "boolean": "true", "integer": "7", "decimal": "0.25", "strings": "[~]", "mixed": "[~,3]",
         "object": '{"of":"~~"}'.replace('"~~"', "~"), "numbers": '{"of":4}'}
# Fields with the kinds they may hold and what is said otherwise.
ITEM_FIELDS = (
    ("tags", ("strings", "null"), "tags must contain strings"), ("metadata", ("object", "null"), "metadata must map strings to strings"),
    ("timestamp", ("string", "null"), "timestamp must be a string or null"), ("context", ("string", "null"), "context must be a string or null"),
    ("document_id", ("string", "null"), "document_id must be a string or null"),
)
BODY_FIELDS = (("document_tags", ("strings",), "document_tags must contain strings"), ("async", ("boolean",), "async must be a boolean"))
QUERY_FIELDS = (
    ("trace", ("boolean",), "trace must be a boolean"), ("tags", ("strings", "null"), "tags must contain strings"),
    ("types", ("strings", "null"), "types must contain strings"), ("tags_match", ("string",), "tags_match must be a string"),
    ("max_tokens", ("integer",), "max_tokens must be a positive integer"),
)


def cases_of(shape: str, fields) -> list[tuple[str, str | None]]:
    """Every field with every kind: (body, message or None). `shape` holds the field at @."""
    return [(shape.replace("@", f'"{name}":{text}'), None if kind in good else message)
            for name, good, message in fields for kind, text in KINDS.items()]


# (body around a JSON string ~, message)
RETAIN = tuple(
    cases_of('{"items":[{@,"content":~}]}', ITEM_FIELDS) + cases_of('{@,"items":[{"content":~,"more":1}]}', BODY_FIELDS)
    + [(f'{{"items":[{{"content":~}},{text}]}}', "memory item 1 must be an object") for kind, text in KINDS.items() if kind not in ("object", "numbers")]
    + [(f'{{"items":[{{"content":{text}}}]}}', None if kind == "string" else "memory item 0 content must be a non-empty string") for kind, text in KINDS.items()]
    + [(text, "retain body must be an object") for kind, text in KINDS.items() if kind not in ("object", "numbers")]
    + [(f'{{"items":{text}}}', "retain body requires at least one memory item") for text in ("[]", "null", "~")]
    + [('{"items":[{"content":~,"update_mode":"sometimes"}]}', "update_mode must be replace or append"),
       ('{"at":-9007199254740992,"items":[{"content":~}]}', "retain body contains an unsupported JSON value")])
RECALL = tuple(
    cases_of('{@,"query":~}', QUERY_FIELDS) + [('{"query":~,"budget":"lots"}', "budget must be low, mid, or high"), ('{"budget":"high","query":~}', None),
                                               ('{"max_tokens":-1,"query":~}', "max_tokens must be a positive integer")]
    + [(f'{{"query":{text}}}', None if kind == "string" else "recall query must be a non-empty string") for kind, text in KINDS.items()]
    + [(text, "recall body must be an object") for kind, text in KINDS.items() if kind not in ("object", "numbers")])


def _bodies(spark, d, cases):
    turns = inputs.table(spark, d, "conversations")
    n = F.col("conv_id") * 8 + F.col("turn")
    shape = inputs.pick(tuple(c[0] for c in cases), n)
    return turns.select(
        F.concat_ws(":", "conv_id", "turn").alias("request_id"), n.alias("n"), "text",
        F.replace(shape, F.lit("~"), identity.json_text(F.col("text"))).alias("body"))


def _expected(cases) -> str:
    return inputs.sql_pick(tuple(c[1] or "-" for c in cases), "conv_id * 8 + turn")


def _verdict_sql(cases, code: str) -> str:
    return f"""
WITH e AS (SELECT concat(conv_id, ':', turn) AS request_id, {_expected(cases)} AS message FROM conversations)
SELECT request_id, message = '-' AS ok, CASE WHEN message <> '-' THEN '{code}' END AS error_code, message FROM e"""


@query("retain_validation", _verdict_sql(RETAIN, "invalid_retain_body"))
def retain_validation(spark, d):
    out = validate.validate_retain(_bodies(spark, d, RETAIN))
    return out.select("request_id", "ok", "error_code", F.coalesce("error_message", F.lit("-")).alias("message"))


@query("recall_validation", _verdict_sql(RECALL, "invalid_recall_body"))
def recall_validation(spark, d):
    out = validate.validate_recall(_bodies(spark, d, RECALL))
    return out.select("request_id", "ok", "error_code", F.coalesce("error_message", F.lit("-")).alias("message"))


RAW = (('{"a":~}', None), ("", None), ('{"a":~', "invalid_json"), ('{"a":NaN,"b":~}', "invalid_json"),
       ("[" * 63 + "~" + "]" * 63, None), ("[" * 64 + "~" + "]" * 64, "json_too_deep"))


@query("raw_body_checks", f"""
SELECT concat(conv_id, ':', turn) AS request_id, {_expected(RAW)} AS parse_error FROM conversations""")
def raw_body_checks(spark, d):
    out = checked_bodies(_bodies(spark, d, RAW))
    return out.select("request_id", F.coalesce("parse_error", F.lit("-")).alias("parse_error"))


@query("json_depth_turns", """
SELECT concat(conv_id, ':', turn) AS request_id, (turn + 2)::INT AS depth FROM conversations""")
def json_depth_turns(spark, d):
    turns = inputs.table(spark, d, "conversations")
    n = F.col("turn").cast("int") + 1
    body = F.concat(F.repeat(F.lit("["), n), identity.json_text(F.col("text")), F.repeat(F.lit("]"), n))
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"),
                        jsontext.json_depth(body).alias("depth"))


@query("representable_numbers", """
SELECT o_orderkey, NOT (o_orderkey % 3 = 0 OR o_orderkey % 5 = 0) AS ok FROM orders""")
def representable_numbers(spark, d):
    """Integers past 2^53-1 and decimals past the double range are refused."""
    orders = inputs.table(spark, d, "orders")
    big = F.when(F.col("o_orderkey") % 3 == 0, F.lit(9007199254740992)).otherwise(F.lit(9007199254740991)) + F.when(
        F.col("o_orderkey") % 3 == 0, F.col("o_orderkey")).otherwise(-F.col("o_orderkey"))
    exp = F.when(F.col("o_orderkey") % 5 == 0, "1e999").otherwise("1e300")
    body = F.concat(F.lit('{"a":'), big.cast("string"), F.lit(',"b":'), exp, F.lit("}"))
    return orders.select("o_orderkey", jsontext.is_representable(body).alias("ok"))


@query("canonical_digests", """
SELECT concat(conv_id, ':', turn) AS request_id,
  sha256(concat('{"a":[', turn, ',true,null],"text":', to_json(text), '}')) AS digest FROM conversations""")
def canonical_digests(spark, d):
    """Key order, white space and escapes do not matter, text does."""
    turns = inputs.table(spark, d, "conversations")
    body = F.concat(F.lit('{ "text" : '), identity.json_text(F.col("text")), F.lit(' , "\\u0061":[ '),
                    F.col("turn").cast("string"), F.lit(".0, true ,null] }"))
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("request_id"),
                        jsontext.content_sha256(body).alias("digest"))


@query("canonical_numbers", """
SELECT o_orderkey, sha256(concat('[', (o_orderkey * 4 + 1)::VARCHAR, '.25,', o_orderkey::VARCHAR, ']')) AS digest FROM orders""")
def canonical_numbers(spark, d):
    orders = inputs.table(spark, d, "orders")
    body = F.concat(F.lit("[ "), (F.col("o_orderkey") * 4 + 1).cast("string"), F.lit(".2500 , "),
                    F.col("o_orderkey").cast("string"), F.lit("e0]"))
    return orders.select("o_orderkey", jsontext.content_sha256(body).alias("digest"))


@query("audit_digests", """
SELECT o_orderkey, sha256(CASE WHEN o_orderkey % 2 = 0 THEN concat('{"k":', o_orderkey, '}')
  ELSE concat('{"k": 9007199254740993', o_orderkey, '}') END) AS digest FROM orders""")
def audit_digests(spark, d):
    orders = inputs.table(spark, d, "orders")
    body = F.concat(F.lit('{"k": '), F.when(F.col("o_orderkey") % 2 == 0, F.lit("")).otherwise("9007199254740993"),
                    F.col("o_orderkey").cast("string"), F.lit("}"))
    return orders.select("o_orderkey", jsontext.audit_digest(body).alias("digest"))


@query("string_projection_events", """
SELECT event_id, concat('{"e":"', event_type, '","n":null,"p":["', user_id, '",null]}') AS kept FROM events""")
def string_projection_events(spark, d):
    events = inputs.table(spark, d, "events")
    body = F.to_json(F.struct(F.col("event_type").alias("e"), F.col("value").alias("n")))
    body = F.concat(F.regexp_replace(body, r"\}$", ""), F.lit(',"p":["'),
                    F.col("user_id").cast("string"), F.lit('",true]}'))
    return events.select("event_id", F.replace(F.replace(jsontext.string_projection(body), F.lit(": "), F.lit(":")),
                                               F.lit(", "), F.lit(",")).alias("kept"))


@query("retain_bounds", """
WITH b AS (SELECT doc_id, len(regexp_split_to_array(text, ' '))::INT AS item_count,
    octet_length(encode(replace(text, ' ', '')))::BIGINT AS value_bytes FROM documents)
SELECT doc_id, item_count, value_bytes, CASE WHEN item_count > 100 THEN 'retain_item_limit_exceeded'
  WHEN value_bytes > 500 THEN 'retain_content_too_large' ELSE '-' END AS bound_code FROM b""")
def retain_bounds(spark, d):
    """Each word of a document as one item, against 100 items and a small byte bound."""
    from memgov.fixed import TrafficLimits

    docs = inputs.table(spark, d, "documents")
    words = F.split("text", " ")
    counted = docs.select("doc_id", F.size(words).alias("item_count"), jsontext.string_bytes(words).alias("value_bytes"))
    out = validate.check_retain_bounds(counted, TrafficLimits(retain_bytes=500))
    return out.withColumn("bound_code", F.coalesce("bound_code", F.lit("-")))


@query("request_bytes_turns", f"""
WITH {inputs.TURNS_SQL}
SELECT request_id, 1::INT AS items, octet_length(encode(concat(content, context, role)))::BIGINT AS bytes FROM turns""")
def request_bytes_turns(spark, d):
    sized = jsontext.with_value_bytes(inputs.turn_requests(spark, d))
    return sized.select("request_id", validate.item_count(F.col("body")).alias("items"), F.col("value_bytes").alias("bytes"))


@query("request_bytes_wide", """
SELECT doc_id, 150::INT AS items, (150 * octet_length(encode(concat('ＡＢ', text))))::BIGINT AS bytes FROM documents WHERE n_chars < 2000""")
def request_bytes_wide(spark, d):
    """Bodies of more strings than a scan looks at, with letters that normalising would shorten."""
    docs = inputs.dealt(inputs.table(spark, d, "documents").filter("n_chars < 2000").select("doc_id", "text"))
    item = F.struct(F.concat(F.lit("ＡＢ"), F.col("text")).alias("content"))
    body = docs.select("doc_id", F.to_json(F.struct(F.array_repeat(item, 150).alias("items"))).alias("body"))
    sized = jsontext.with_value_bytes(body)
    return sized.select("doc_id", validate.item_count(F.col("body")).alias("items"), F.col("value_bytes").alias("bytes"))


@query("request_bytes_whole", """
SELECT doc_id, 150::INT AS items, (149 * 6 + octet_length(encode(concat('ＡＢ', text))))::BIGINT AS bytes FROM documents""")
def request_bytes_whole(spark, d):
    """As above for every document, however long: its text once, beside 149 short strings."""
    def item(text):
        return F.struct(F.concat(F.lit("ＡＢ"), text).alias("content"))

    items = F.concat(F.array_repeat(item(F.lit("")), 149), F.array(item(F.coalesce("text", F.lit("")))))
    body = inputs.table(spark, d, "documents").select("doc_id", F.to_json(F.struct(items.alias("items"))).alias("body"))
    sized = jsontext.with_value_bytes(body)
    return sized.select("doc_id", validate.item_count(F.col("body")).alias("items"), F.col("value_bytes").alias("bytes"))


@query("recall_bounds", """
SELECT item_id, CASE WHEN octet_length(encode(text)) > 400 THEN 'recall_query_too_large'
  WHEN item_id * 400 > 8192 THEN 'recall_max_tokens_exceeded' ELSE '-' END AS bound_code FROM benchmark""")
def recall_bounds(spark, d):
    from memgov.fixed import TrafficLimits

    asked = inputs.table(spark, d, "benchmark").select(
        "item_id", F.col("text").alias("query"), (F.col("item_id") * 400).alias("max_tokens"))
    out = validate.check_recall_bounds(asked, TrafficLimits(query_bytes=400))
    return out.select("item_id", F.coalesce("bound_code", F.lit("-")).alias("bound_code"))


@query("bank_response_validation", """
SELECT doc_id, doc_id % 4 = 0 AS ok FROM documents""")
def bank_response_validation(spark, d):
    shapes = ('{"results":[{"id":"1","text":~,"x":7}],"trace":{}}', '{"results":[{"id":1,"text":~}]}',
              '{"text":~}', '{"results":[{"id":"1","text":~}],"chunks":[1]}')
    docs = inputs.table(spark, d, "documents")
    body = F.replace(inputs.pick(shapes, F.col("doc_id")), F.lit("~"), identity.json_text(F.col("text")))
    return validate.validate_bank_response(docs.select("doc_id", body.alias("body"))).select("doc_id", "ok")


FACADE = (
    ("PUT", "", None, '{"bank_id":"b","name":~,"disposition":{},"mission":"m"}', True),
    ("PUT", "", None, '{"bank_id":"b","name":~}', False),
    ("PATCH", "config", None, '{"bank_id":~,"config":{},"overrides":{}}', True),
    ("GET", "mental-models", None, '{"items":[{"id":"1","bank_id":"b","name":~}]}', True),
    ("GET", "mental-models", None, '{"items":[{"id":"1","name":~}]}', False),
    ("GET", "mental-models", "m1", '{"id":"1","bank_id":"b","name":~}', True),
    ("POST", "mental-models", None, '{"operation_id":~}', True),
    ("POST", "reflect", None, '{"text":~}', True),
    ("POST", "reflect", None, '{"answer":~}', False),
    ("DELETE", "mental-models", "m1", "{}", True),
    ("DELETE", "reflect", None, "{}", False),
)


@query("facade_response_validation", f"""
SELECT doc_id, ({[c[4] for c in FACADE]})[doc_id % {len(FACADE)} + 1] AS ok FROM documents""".replace("True", "true").replace("False", "false"))
def facade_response_validation(spark, d):
    docs = inputs.table(spark, d, "documents")
    n = F.col("doc_id")
    call = docs.select(
        "doc_id", inputs.pick(tuple(c[0] for c in FACADE), n).alias("method"),
        inputs.pick(tuple(c[1] for c in FACADE), n).alias("resource"),
        F.nullif(inputs.pick(tuple(c[2] or "" for c in FACADE), n), F.lit("")).alias("item_id"),
        F.replace(inputs.pick(tuple(c[3] for c in FACADE), n), F.lit("~"), identity.json_text(F.col("text"))).alias("response"))
    return validate.validate_facade_response(call).select("doc_id", "ok")


EVIDENCE = (
    ('{"quarantine_id":"q","created_at":"t","reason":"auth_failed","payload":~}', "-"),
    ('{"quarantine_id":"q","created_at":"t","reason":"auth_failed","payload":~,"source":""}', "source must be a non-empty string"),
    ('{"quarantine_id":"q","created_at":"t","reason":"other","payload":~}', "invalid quarantine reason"),
    ('{"quarantine_id":"q","created_at":"t","reason":"auth_failed","note":~}', "decrypted quarantine payload is missing"),
    ('{"quarantine_id":"q","created_at":5,"reason":"auth_failed","payload":~}', "created_at must be a non-empty string"),
)


@query("evidence_validation", f"""
SELECT doc_id, {inputs.sql_pick(tuple(e[1] for e in EVIDENCE), 'doc_id')} AS message FROM documents""")
def evidence_validation(spark, d):
    docs = inputs.table(spark, d, "documents")
    record = F.replace(inputs.pick(tuple(e[0] for e in EVIDENCE), F.col("doc_id")), F.lit("~"), identity.json_text(F.col("text")))
    out = validate.validate_evidence(docs.select("doc_id", record.alias("record")))
    return out.select("doc_id", F.coalesce("error_message", F.lit("-")).alias("message"))


@query("envelope_validation", """
SELECT doc_id, (['-', 'unsupported quarantine envelope version', 'invalid AES-GCM initialization vector length',
  'tag_b64 must be valid base64', 'invalid quarantine_id', 'invalid quarantine object digest'])[doc_id % 6 + 1] AS message
FROM documents""")
def envelope_validation(spark, d):
    docs = inputs.table(spark, d, "documents")
    n = F.col("doc_id") % 6
    text = F.base64(F.col("text").cast("binary"))
    text = F.regexp_replace(text, r"\s", "")
    body = F.concat(
        F.lit('{"version":'), F.when(n == 1, "2").otherwise("1"),
        F.lit(',"quarantine_id":"'), F.when(n == 4, "q_../x").otherwise("q_a1_0123456789abcdef"),
        F.lit('","created_at":"t","reason":"auth_failed","sha256":"'),
        F.when(n == 5, "zz").otherwise(F.sha2("text", 256)),
        F.lit('","encryption":{"algorithm":"AES-256-GCM","key_wrap":"RSA-OAEP-SHA256","aad":"metadata-v1",'
              '"wrapped_key_b64":"QUJD","iv_b64":"'), F.when(n == 2, "QUJD").otherwise("A" * 16),
        F.lit('","tag_b64":"'), F.when(n == 3, "QU JD").otherwise("A" * 22 + "=="),
        F.lit('"},"ciphertext_b64":"'), text, F.lit('"}'))
    out = validate.validate_envelope(docs.select("doc_id", body.alias("envelope")))
    return out.select("doc_id", F.coalesce("error_message", F.lit("-")).alias("message"))


@query("registry_rows", f"""
WITH {inputs.WRITERS_SQL}
SELECT writer_id, bank_id, (pos - 1)::INT AS bank_pos FROM writers,
  LATERAL (SELECT unnest(read_banks) AS bank_id, generate_subscripts(read_banks, 1) AS pos)""")
def registry_rows(spark, d):
    return read_bank_rows(inputs.writers(spark, d)).select("writer_id", "bank_id", "bank_pos")


@query("registry_validation", """
SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN 'invalid_writer_id' WHEN c_custkey % 5 = 2 THEN 'blank_write_bank'
  WHEN c_custkey % 5 = 3 THEN 'blank_read_bank' ELSE 'invalid_default_action' END AS error
FROM customer WHERE c_custkey % 5 <> 0""")
def registry_validation(spark, d):
    """Customers as registry rows, four in five broken in one way each."""
    n = F.col("c_custkey") % 5
    rules = inputs.table(spark, d, "customer").select(
        "c_custkey", F.when(n == 1, F.concat("c_name", F.lit(" x"))).otherwise(F.replace("c_name", F.lit("#"), F.lit("-"))).alias("writer_id"),
        F.lit("agent").alias("role"), F.lit("application").alias("source"),
        F.when(n == 2, " ").otherwise(F.col("c_mktsegment")).alias("write_bank"),
        F.array("c_mktsegment", F.when(n == 3, "").otherwise("SHARED")).alias("read_banks"),
        F.lit("review_queue").alias("unknown_writer_action"),
        F.when(n == 4, "drop").otherwise("review_queue").alias("suspicious_content_action"))
    return registry_errors(rules).select("c_custkey", "error")


@query("payload_shapes_documents", """
WITH n AS (SELECT doc_id, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, (length(t) // 32)::BIGINT AS length_bucket,
  (CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, ' ')) END // 4)::BIGINT AS token_bucket FROM n""")
def payload_shapes_documents(spark, d):
    norm = inputs.table(spark, d, "documents").withColumn("t", texts.normalize_text(F.col("text")))
    shaped = norm.withColumn("s", texts.text_shape(F.col("t")))
    return shaped.select("doc_id", F.col("s.text_length_bucket").alias("length_bucket"),
                         F.col("s.token_count_bucket").alias("token_bucket"))


@query("request_families", """
WITH n AS (SELECT doc_id, source, trim(regexp_replace(replace(lower(text), 'ß', 'ss'), '\\s+', ' ', 'g')) AS t FROM documents),
f AS (SELECT source, sha256(concat(
    sha256(concat('{"kind":"retain_request","payload":{"tags":["a","b"],"text":', to_json(t), '},"reason":"suspicious_content"}')), ':',
    sha256(concat('{"kind":"retain_request","payload":{"tags":[{"text_length_bucket":0,"token_count_bucket":0},{"text_length_bucket":0,"token_count_bucket":0}],"text":{"text_length_bucket":',
      length(t) // 32, ',"token_count_bucket":', CASE WHEN t = '' THEN 0 ELSE len(regexp_split_to_array(t, ' ')) END // 4,
      '}},"reason":"suspicious_content"}')))) AS digest FROM n)
SELECT concat('retain_request:suspicious_content:', source) AS scope, digest, count(*) AS requests FROM f GROUP BY ALL""")
def request_families(spark, d):
    """Near-identical requests fall into one family per scope."""
    docs = inputs.table(spark, d, "documents")
    tags = F.when(F.col("doc_id") % 2 == 0, '["B","a"]').otherwise('["a"," b "]')
    payload = F.concat(F.lit('{"text":'), identity.json_text(F.col("text")), F.lit(',"tags":'), tags, F.lit("}"))
    family = identity.request_family(F.lit("retain_request"), F.lit("suspicious_content"), F.col("source"), payload)
    return docs.select(family.alias("f")).groupBy("f.scope", "f.digest").agg(F.count("*").alias("requests"))


@query("recalled_digests", """
SELECT doc_id, sha256(concat('{"id":"', doc_id, '","text":', to_json(text), '}')) AS digest FROM documents""")
def recalled_digests(spark, d):
    docs = inputs.table(spark, d, "documents")
    return docs.select("doc_id", identity.recalled_digest(F.col("doc_id").cast("string"), F.col("text")).alias("digest"))


@query("quarantine_ids", """
WITH d AS (SELECT doc_id, doc_id % 3 AS n, sha256(concat(lang, ':', doc_id)) AS h FROM documents)
SELECT doc_id, concat((['q_security','q_request','q_memory'])[n + 1], h[1:48], '_', h[49:64]) AS quarantine_id FROM d""")
def quarantine_ids(spark, d):
    docs = inputs.table(spark, d, "documents")
    n = F.col("doc_id") % 3
    key = F.concat_ws(":", "lang", "doc_id")
    kind = F.when(n == 0, "security_event").when(n == 1, "retain_request").otherwise("recalled_memory")
    rows = docs.select("doc_id", kind.alias("kind"), F.when(n != 2, key).alias("key"), F.col("lang").alias("bank"),
                       F.col("doc_id").cast("string").alias("mem"))
    return rows.select("doc_id", identity.quarantine_id(
        F.col("kind"), F.col("key"), F.col("bank"), F.col("mem"), F.lit("2024-01-01")).alias("quarantine_id"))


@query("sealed_evidence", """
SELECT doc_id, sha256(concat('{"created_at":"t","payload":', to_json(text), ',"quarantine_id":"q', doc_id,
  '","reason":"suspicious_content","writer_id":"', source, '"}')) AS sha256,
  CASE WHEN doc_id % 2 = 0 THEN '-' ELSE 'decrypt_failed' END AS open_error FROM documents""")
def sealed_evidence(spark, d):
    """Seal every document, tamper with the metadata of every second one, and open them again."""
    from memgov.sources.tables import open_evidence, seal_evidence

    docs = inputs.table(spark, d, "documents")
    rows = docs.select(
        "doc_id", F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("quarantine_id"),
        F.lit("t").alias("created_at"), F.lit("suspicious_content").alias("reason"),
        F.col("source").alias("writer_id"), F.lit(None).cast("string").alias("source"), F.col("text"))
    record = F.to_json(F.struct("quarantine_id", "created_at", "reason", "writer_id", F.col("text").alias("payload")))
    key = F.unhex(F.lit("00112233445566778899aabbccddeeff" * 2))
    sealed = seal_evidence(rows.withColumn("record", record).drop("text"), key)
    tampered = sealed.withColumn("writer_id", F.when(F.col("doc_id") % 2 == 0, F.col("writer_id")).otherwise("x"))
    out = open_evidence(tampered, key)
    return out.select("doc_id", "sha256", F.coalesce("open_error", F.lit("-")).alias("open_error"))


@query("sealed_sizes", """
SELECT doc_id, (691 + 4 * ((octet_length(encode(text)) + 2) // 3) + length(concat('q', doc_id)) + 1
  + length('suspicious_content') + length(source))::BIGINT AS sealed_bytes FROM documents""")
def sealed_sizes(spark, d):
    from memgov.operators.policy import sealed_bytes

    docs = inputs.table(spark, d, "documents")
    size = sealed_bytes(F.octet_length("text"), F.concat(F.lit("q"), F.col("doc_id").cast("string")), F.lit("t"),
                        F.lit("suspicious_content"), F.col("source"), F.lit(None).cast("string"))
    return docs.select("doc_id", size.cast("long").alias("sealed_bytes"))


@query("oversize_placeholders", """
SELECT doc_id, concat('oversized-recalled:', lang, ':', doc_id, ':', sha256(to_json(text))) AS dedupe_key
FROM documents WHERE octet_length(encode(text)) > 4000""")
def oversize_placeholders(spark, d):
    """Evidence past the item size is kept as a digest only."""
    from memgov.operators.policy import placeholder_reason, placeholder_rows

    docs = inputs.table(spark, d, "documents").select(
        "doc_id", F.col("lang").alias("bank_id"), F.col("doc_id").cast("string").alias("memory_id"),
        F.octet_length("text").alias("size"), identity.json_text(F.col("text")).alias("body"))
    large = docs.filter(placeholder_reason(F.col("size"), F.col("body"), 4000) == "too_large")
    return placeholder_rows(large, "recalled_memory").select("doc_id", "dedupe_key")


@query("noncanonical_placeholders", """
SELECT o_orderkey, concat('oversized-recall:w:suspicious_query:', sha256(concat('{"n": 90071992547409', 93 + o_orderkey, '}'))) AS dedupe_key
FROM orders""")
def noncanonical_placeholders(spark, d):
    from memgov.operators.policy import placeholder_reason, placeholder_rows

    rows = inputs.table(spark, d, "orders").select(
        "o_orderkey", F.lit("w").alias("writer_id"), F.lit("suspicious_query").alias("reason"),
        F.concat(F.lit('{"n": 90071992547409'), (F.col("o_orderkey") + 93).cast("string"), F.lit("}")).alias("body"))
    bad = rows.filter(placeholder_reason(F.lit(0), F.col("body")) == "not_canonical")
    return placeholder_rows(bad, "recall_request").select("o_orderkey", "dedupe_key")
