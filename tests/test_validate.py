import json

import pytest
from pyspark.sql import functions as F

from memgov.functions import identity, jsontext, paths
from memgov.functions.text import escape_json_for_review
from memgov.operators.validate import (validate_bank_response, validate_envelope, validate_evidence,
                                       validate_facade_response, validate_recall, validate_retain)
from memgov.sources.requests import checked_bodies

# Sample values by kind; each field with the kinds it takes and the message otherwise.
VALUES = {"text": "w", "nothing": None, "flag": False, "count": 3, "fraction": 2.5, "texts": ["w"], "mixed": ["w", 3], "map": {"w": "w"}, "counts": {"w": 3}}
ITEM = {"context": ({"text", "nothing"}, "context must be a string or null"), "document_id": ({"text", "nothing"}, "document_id must be a string or null"),
        "timestamp": ({"text", "nothing"}, "timestamp must be a string or null"), "tags": ({"texts", "nothing"}, "tags must contain strings"),
        "metadata": ({"map", "nothing"}, "metadata must map strings to strings"), "anything": (set(VALUES), None),
        "content": ({"text"}, "memory item 0 content must be a non-empty string")}
BODY = {"async": ({"flag"}, "async must be a boolean"), "document_tags": ({"texts"}, "document_tags must contain strings"),
        "items": (set(), "retain body requires at least one memory item"), "other": (set(VALUES), None)}
QUERY = {"query": ({"text"}, "recall query must be a non-empty string"), "max_tokens": ({"count"}, "max_tokens must be a positive integer"),
         "types": ({"texts", "nothing"}, "types must contain strings"), "tags": ({"texts", "nothing"}, "tags must contain strings"),
         "tags_match": ({"text"}, "tags_match must be a string"), "trace": ({"flag"}, "trace must be a boolean"),
         "budget": (set(), "budget must be low, mid, or high"), "other": (set(VALUES), None)}


def combined(fields, around):
    return [(around({name: value}), None if kind in good else message)
            for name, (good, message) in fields.items() for kind, value in VALUES.items()]


def numbered(position):
    return lambda own: {"items": [{"content": "c"}] * position + [{"content": "c", **own}]}


RETAIN = combined(ITEM, numbered(0)) + [
    (body, message) for body, message in combined(BODY, lambda own: {"items": [{"content": "c"}], **own})
    if not isinstance(body["items"], list) or len(body["items"]) == 1 and isinstance(body["items"][0], dict)]
RETAIN += [({"items": [{"content": "c"}, value]}, "memory item 1 must be an object") for value in VALUES.values() if not isinstance(value, dict)]
RETAIN += [(value, "retain body must be an object") for value in VALUES.values() if not isinstance(value, dict)]
RETAIN += [({"items": []}, "retain body requires at least one memory item"), (numbered(0)({"content": "\n "}), ITEM["content"][1]),
           (numbered(0)({"update_mode": "append"}), None), (numbered(0)({"update_mode": "later"}), "update_mode must be replace or append"),
           (numbered(0)({"big": -(2**53)}), "retain body contains an unsupported JSON value")]
RECALL = combined(QUERY, lambda own: {"query": "q", **own})
RECALL += [(value, "recall body must be an object") for value in VALUES.values() if not isinstance(value, dict)]
RECALL += [({"query": "q", "budget": b}, None) for b in ("low", "mid", "high")] + [({"query": "q", "max_tokens": n}, QUERY["max_tokens"][1]) for n in (0, -4)]


def frame(spark, values):
    return spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "n int, body string")


@pytest.mark.parametrize("check,cases", [(validate_retain, RETAIN), (validate_recall, RECALL)])
def test_bodies(spark, check, cases):
    rows = check(frame(spark, [c[0] for c in cases])).orderBy("n").collect()
    assert [r["error_message"] for r in rows] == [c[1] for c in cases]
    assert all(r["ok"] == (r["error_code"] is None) for r in rows)


def test_bank_response(spark):
    good = {"results": [{"id": "1", "text": "ok", "type": 7}], "chunks": None, "trace": {}}
    deep = {"results": [], "trace": json.loads('{"a":' * 70 + "1" + "}" * 70)}
    values = [good, {"results": [{"id": 1, "text": "x"}]}, {}, {"results": [], "trace": []}, deep, {"results": [], "trace": {"n": 2**60}}]
    rows = validate_bank_response(frame(spark, values)).orderBy("n").collect()
    assert [r["ok"] for r in rows] == [True] + [False] * 5


def test_facade_response(spark):
    m = {"id": "1", "bank_id": "b", "name": "n"}
    cases = [
        ("PUT", "", None, {"bank_id": "b", "name": "n", "disposition": {}, "mission": "m"}, True),
        ("PUT", "", None, {"bank_id": "b"}, False),
        ("PATCH", "config", None, {"bank_id": "b", "config": {}, "overrides": {}}, True),
        ("GET", "mental-models", None, {"items": [m]}, True),
        ("GET", "mental-models", None, {"items": [{"id": "1"}]}, False),
        ("GET", "mental-models", "7", m, True),
        ("POST", "mental-models", None, {"operation_id": "o", "mental_model_id": None}, True),
        ("POST", "mental-models", None, {"operation_id": "o", "mental_model_id": 4}, False),
        ("POST", "reflect", None, {"text": "t"}, True),
        ("DELETE", "mental-models", "7", None, True),
        ("DELETE", "mental-models", "7", [1], False),
        ("DELETE", "reflect", None, {}, False),
    ]
    df = spark.createDataFrame(
        [(i, a, b, c, None if d is None else json.dumps(d)) for i, (a, b, c, d, _) in enumerate(cases)],
        "n int, method string, resource string, item_id string, response string")
    rows = validate_facade_response(df).orderBy("n").collect()
    assert [r["ok"] for r in rows] == [c[4] for c in cases]


def envelope(**changes):
    box = {"algorithm": "AES-256-GCM", "key_wrap": "RSA-OAEP-SHA256", "aad": "metadata-v1",
           "wrapped_key_b64": "QUJD", "iv_b64": "A" * 16, "tag_b64": "A" * 22 + "=="}
    box.update(changes.pop("box", {}))
    value = {"version": 1, "quarantine_id": "q_a1_0123456789abcdef", "created_at": "t",
             "reason": "auth_failed", "sha256": "0" * 64, "encryption": box, "ciphertext_b64": "QUJD"}
    value.update(changes)
    return value


def test_envelope(spark):
    cases = [
        (envelope(), None), (envelope(box={"aad": None}), None),
        (envelope(version=2), "unsupported quarantine envelope version"),
        (envelope(box={"iv_b64": "QUJD"}), "invalid AES-GCM initialization vector length"),
        (envelope(box={"tag_b64": "QUJD"}), "invalid AES-GCM authentication tag length"),
        (envelope(box={"tag_b64": "QU JD"}), "tag_b64 must be valid base64"),
        (envelope(box={"aad": "x"}), "unsupported quarantine AAD format"),
        (envelope(quarantine_id="q_../x"), "invalid quarantine_id"),
        (envelope(reason="other"), "invalid quarantine reason"),
        (envelope(sha256="zz"), "invalid quarantine object digest"),
        (envelope(encryption=3), "encrypted quarantine envelope must be an object"),
        (envelope(ciphertext_b64="%%"), "ciphertext_b64 must be valid base64"),
    ]
    df = frame(spark, [c[0] for c in cases]).withColumnRenamed("body", "envelope")
    rows = validate_envelope(df).orderBy("n").collect()
    assert [r["error_message"] for r in rows] == [c[1] for c in cases]


def test_evidence(spark):
    good = {"quarantine_id": "q", "created_at": "t", "reason": "auth_failed", "payload": None}
    cases = [(good, None), ({**good, "reason": "x"}, "invalid quarantine reason"),
             ({**good, "source": ""}, "source must be a non-empty string"),
             ({k: v for k, v in good.items() if k != "payload"},
              "decrypted quarantine payload is missing"),
             ({**good, "created_at": 1}, "created_at must be a non-empty string")]
    df = frame(spark, [c[0] for c in cases]).withColumnRenamed("body", "record")
    rows = validate_evidence(df).orderBy("n").collect()
    assert [r["error_message"] for r in rows] == [c[1] for c in cases]


def test_checked_bodies(spark):
    cases = {"": ("{}", None), "{": (None, "invalid_json"), '{"a":NaN}': (None, "invalid_json"),
             '{"a":1,"a":2}': ('{"a": 2}', None), "[" * 64 + "]" * 64: ("[" * 64 + "]" * 64, None),
             "[" * 64 + "1" + "]" * 64: ("[" * 64 + "1" + "]" * 64, "json_too_deep"),
             '"' + "x" * 1048576 + '"': (None, "payload_too_large")}
    df = spark.createDataFrame([(i, b) for i, b in enumerate(cases)], "n int, body string")
    rows = checked_bodies(df).orderBy("n").collect()
    assert [(r["body"], r["parse_error"]) for r in rows] == list(cases.values())


def test_depth_and_numbers(spark):
    cases = [("1", 1, True), ("[]", 1, True), ("[1]", 2, True), ('{"a":{"b":[]}}', 3, True),
             ('{"a":[{"b":"]]]"}]}', 4, True), ("[9007199254740991]", 2, True),
             ("[-9007199254740992]", 2, False), ("[1e999]", 2, False), ("[1e20, 2.5]", 2, True),
             ('["9007199254740993"]', 2, True), ('["\\ud800"]', 2, False),
             ('["\\ud83d\\ude00"]', 2, True), ('["\\\\ud800"]', 2, True)]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "n int, b string")
    rows = df.select("n", jsontext.json_depth(F.col("b")).alias("d"),
                     jsontext.is_representable(F.col("b")).alias("r")).orderBy("n").collect()
    assert [(r["d"], r["r"]) for r in rows] == [(c[1], c[2]) for c in cases]


def test_canonical(spark):
    cases = {'{"b":1,"a":[2,"x"]}': '{"a":[2,"x"],"b":1}', "1.0": "1", "1e21": "1e+21", "1e-7": "1e-7",
             "0.000001": "0.000001", "1.5e-6": "0.0000015", "100000000000000000000.0": "100000000000000000000",
             '"\\u001f\\u00e9/"': '"\\u001fé/"', "-0.0": "0", '{"\\ud83d\\ude00":1,"ﬀ":2}':
             '{"😀":1,"ﬀ":2}', "9007199254740993": None, "-5": "-5", "true": "true", "333.25": "333.25"}
    df = spark.createDataFrame([(k,) for k in cases], "b string")
    rows = df.select("b", jsontext.canonical_json(F.col("b")).alias("c")).collect()
    assert {r["b"]: r["c"] for r in rows} == cases


def test_value_bytes(spark):
    values = [{"a": "é" * 300, "k": ["xy", {"deep": "z"}], "n": 5}, ["w"] * 1000, 'with "quotes" and \\ backslash', {"ＡＢ": "Ｃ"}]
    df = spark.createDataFrame([(i, json.dumps(v, ensure_ascii=i == 3)) for i, v in enumerate(values)], "n int, body string")
    got = jsontext.with_value_bytes(df).orderBy("n").collect()
    assert [r["value_bytes"] for r in got] == [603, 1000, len(values[2]), 3]


def test_nested_escapes(spark):
    body = json.dumps({"a\u200b": ["\n", {"b\x07": "plain"}], "n": 1.5})
    df = spark.createDataFrame([(body,), ("{",), (None,)], "b string")
    got = [r[0] for r in df.select(escape_json_for_review("b")).collect()]
    assert json.loads(got[0]) == {"a\\u200B": ["\\n", {"b\\u0007": "plain"}], "n": 1.5} and got[1:] == [None, None]


def test_identity(spark):
    df = spark.createDataFrame([("get", "/A/b/?x=1"), ("POST", "/#f")], "m string, p string")
    keys = [r[0] for r in df.select(identity.security_event_key(F.col("m"), F.col("p"))).collect()]
    assert keys == ["GET:/a/b", "POST:/"]
    one = spark.createDataFrame(
        [("w", '{"items":[{"content":"Hello  World","tags":["b","a"]}]}'),
         ("w", '{"items":[{"tags":["a","b"],"content":" hello world "}]}'),
         ("w", '{"items":[{"tags":["a","b"],"content":"hello there"}]}')], "w string, b string")
    rows = one.select(
        identity.request_dedupe_key(F.lit("retain_request"), F.col("w"), F.lit(None).cast("string"),
                                    identity.request_payload("retain", F.col("w"), F.col("b"))).alias("k"),
        identity.request_family(F.lit("retain_request"), F.lit("unknown_writer"), F.col("w"),
                                F.col("b")).alias("f")).collect()
    assert len({r["k"] for r in rows}) == 3
    assert rows[0]["f"] == rows[1]["f"] != rows[2]["f"]
    assert rows[0]["f"]["scope"] == "retain_request:unknown_writer:unknown-writer"


def test_paths(spark):
    cases = {"/a/./b": "/a/b", "/a/../b": "/b", "/../b": "/b", "/a/%2E%2e/b": "/b", "/a/b/..": "/a/",
             "/a/.": "/a/", "/a/b": "/a/b", "/..": "/", "/a/.b": "/a/.b"}
    df = spark.createDataFrame([(k,) for k in cases], "p string")
    rows = df.select("p", paths.normalize_path(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == cases
    segments = {"a%20b": "a b", "a+b": "a+b", "%zz": None, "%FF": None, "%C3%A9x": "éx", "é%41": "éA",
                "%": None}
    df = spark.createDataFrame([(k,) for k in segments], "p string")
    rows = df.select("p", paths.decode_segment(F.col("p")).alias("n")).collect()
    assert {r["p"]: r["n"] for r in rows} == segments


def test_routes(spark):
    cases = [
        ("POST", "/v1/default/banks/w/memories", "retain", "w", None, None),
        ("POST", "/v1/default/banks/w%20x/memories/recall", "recall", "w x", None, None),
        ("GET", "/v1/default/banks/w/memories", "denied", None, None, None),
        ("PATCH", "/v1/default/banks/w/mental-models/m%2F1", "mental-models.update", "w", "m/1", None),
        ("GET", "/admin/quarantine/items/q_1", "read_item", None, "q_1", "read"),
        ("POST", "/admin/quarantine/items/q_1/approve", "approve", None, "q_1", "review"),
        ("POST", "/admin/quarantine/cleanup", "cleanup", None, None, "cleanup"),
        ("POST", "/admin/other", "admin_not_found", None, None, "review"),
        ("GET", "/version", "version", None, None, None),
    ]
    df = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "n int, method string, path string")
    rows = paths.resolve_routes(df).orderBy("n").collect()
    assert [(r["method"], r["operation"], r["writer_id"], r["item_id"], r["admin_scope"]) for r in rows] == [
        (c[0], c[2], c[3], c[4], c[5]) for c in cases]


def test_large_bodies_of_one_row_group_are_dealt_to_several_tasks(spark, tmp_path):
    import memgov.plans.body_queries as bodies

    rows = [(i if i % 7 else None, None if i == 9 else f'say "{i}"\nand é' if i % 2 else f"plain {i}", None if i == 5 else 10) for i in range(64)]
    spark.createDataFrame(rows, "doc_id long, text string, n_chars int").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    out = bodies.request_bytes_wide(spark, str(tmp_path))
    assert out.select(F.spark_partition_id()).distinct().count() > 1
    want = [(i, 150, 150 * len(f"ＡＢ{text}".encode()) if text is not None else 0) for i, text, n in rows if n]
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
