import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from memgov.operators import quarantine, review
from memgov.operators.quarantine import ITEM_SCHEMA
from memgov.sources import tables

T0 = dt.datetime(2024, 1, 1, 12)


def item(qid, status="pending", kind="retain_request", **over):
    row = dict(quarantine_id=qid, created_at=T0, updated_at=T0, kind=kind, reason="suspicious_content",
               writer_id="w", source="app", source_bank=None, source_memory_id=None,
               source_content_sha256=None, dedupe_key=f"k-{qid}", sha256=f"s-{qid}", encrypted_envelope="{}",
               encrypted_bytes=10, status=status, postpone_count=0, requarantine_count=0,
               expires_at=T0 + dt.timedelta(days=30))
    if kind == "recalled_memory":
        row.update(dedupe_key=None, source_bank="b", source_memory_id=qid, source_content_sha256="old")
    row.update(over)
    return tuple(row[f] for f in ITEM_SCHEMA.fieldNames())


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), ITEM_SCHEMA)


def lit(t):
    return F.lit(t.isoformat(sep=" ")).cast("timestamp")


def evidence(spark, *rows):
    """(request_id, minutes, quarantine_id, kind, reason, content digest)"""
    data = []
    for rid, minutes, qid, kind, reason, content in rows:
        memory = kind == "recalled_memory"
        data.append((rid, T0 + dt.timedelta(minutes=minutes), qid, kind, reason, "w2", "app", "b" if memory else None,
                     qid if memory else None, content, None if memory else f"k-{qid}", f"n-{rid}", "{new}", 20))
    return spark.createDataFrame(
        data, "request_id string, at timestamp, quarantine_id string, kind string, reason string, writer_id string, "
        "source string, source_bank string, source_memory_id string, source_content_sha256 string, "
        "dedupe_key string, sha256 string, encrypted_envelope string, encrypted_bytes long")


def test_merge(spark):
    past = T0 - dt.timedelta(days=1)
    items = frame(
        spark, item("q_open"), item("q_past", expires_at=past, postpone_count=2, status="postponed"),
        item("q_claimed", "review_in_progress", "security_event"), item("q_done", "reviewed_allowed"),
        item("q_mem", "reviewed_allowed", "recalled_memory"), item("q_same", "reviewed_allowed", "recalled_memory"),
        item("q_other"))
    news = evidence(
        spark, ("r1", 1, "q_open", "retain_request", "suspicious_content", None),
        ("r2", 2, "q_open", "retain_request", "suspicious_content", None),
        ("r3", 1, "q_past", "retain_request", "suspicious_content", None),
        ("r4", 1, "q_claimed", "security_event", "denied_endpoint", None),
        ("r5", 1, "q_done", "retain_request", "suspicious_content", None),
        ("r6", 1, "q_mem", "recalled_memory", "recalled_suspicious_memory", "new"),
        ("r7", 1, "q_same", "recalled_memory", "recalled_suspicious_memory", "old"),
        ("r8", 1, "q_new", "security_event", "auth_failed", None),
        ("r9", 2, "q_new", "security_event", "auth_failed", None))
    # Security events match by id, so the claimed item keeps its id as key.
    items = items.withColumn("dedupe_key", F.when(F.col("kind") != "security_event", F.col("dedupe_key")))
    merged = quarantine.merge_candidates(items, news, lit(T0), "b1")
    got = {r["quarantine_id"]: r for r in merged.items.collect()}
    assert len(got) == 8
    assert got["q_open"]["requarantine_count"] == 2 and got["q_open"]["created_at"] == T0
    assert got["q_open"]["sha256"] == "n-r2" and got["q_open"]["writer_id"] == "w2"
    assert (got["q_past"]["status"], got["q_past"]["postpone_count"]) == ("pending", 0)
    assert got["q_past"]["expires_at"] == T0 + dt.timedelta(days=30, minutes=1)
    assert got["q_mem"]["status"] == "pending" and got["q_mem"]["source_bank"] == "b"
    assert got["q_new"]["requarantine_count"] == 1
    assert {(r["quarantine_id"], r["code"]) for r in merged.conflicts.collect()} == {
        ("q_claimed", "quarantine_item_in_review"), ("q_done", "quarantine_request_in_review")}
    events = sorted((r["quarantine_id"], r["event_type"], r["details"]) for r in merged.events.collect())
    kinds = [(q, t) for q, t, _ in events]
    assert kinds == [("q_mem", "content_changed"), ("q_new", "quarantined"), ("q_open", "requarantined"),
                     ("q_open", "requarantined"), ("q_past", "requarantined"), ("q_same", "safety_reopened")]
    assert sorted(json.loads(d)["requarantine_count"] for q, _, d in events if q == "q_open") == [1, 2]
    assert json.loads(events[4][2])["expired"] is True
    again = quarantine.merge_candidates(items, news, lit(T0), "b1").events.collect()
    assert {r["event_id"] for r in again} == {r["event_id"] for r in merged.events.collect()}


def decide(spark, items, *rows):
    """(quarantine_id, action, minutes, extra)"""
    base = dict(expected_sha256=None, expected_updated_at=None, prior_status=None, error_kind=None, error_status=None)
    data = []
    for i, (qid, action, minutes, extra) in enumerate(rows):
        v = {**base, **extra}
        data.append((f"d{i}", qid, action, T0 + dt.timedelta(minutes=minutes), v["expected_sha256"],
                     v["expected_updated_at"], v["prior_status"], v["error_kind"], v["error_status"]))
    df = spark.createDataFrame(
        data, "decision_id string, quarantine_id string, action string, at timestamp, expected_sha256 string, "
        "expected_updated_at timestamp, prior_status string, error_kind string, error_status int")
    done = review.apply_decisions(items, df, "b")
    return ({r["quarantine_id"]: r for r in done.items.collect()},
            sorted((r["quarantine_id"], r["event_type"]) for r in done.events.collect()),
            {(r["decision_id"], r["code"]) for r in done.errors.collect()})


def test_review_actions(spark):
    mem = "recalled_memory"
    past = T0 - dt.timedelta(days=1)
    items = frame(
        spark, item("a"), item("b", postpone_count=3, status="postponed"), item("c", expires_at=past),
        item("d", "review_in_progress"), item("e", "review_in_progress", expires_at=past),
        item("f", kind=mem), item("g", "review_in_progress", mem), item("h", "review_side_effect_completed"),
        item("i", "review_side_effect_completed", mem), item("j", "reviewed_blocked", mem),
        item("k", "review_side_effect_started"), item("l"), item("m", "review_side_effect_started"), item("n", "review_side_effect_started"))
    got, events, errors = decide(
        spark, items, ("a", "postpone", 1, {}), ("b", "postpone", 1, {}), ("c", "reject_request", 1, {}),
        ("d", "postpone", 5, {}), ("e", "reject_request", 5, {}),
        ("f", "claim_memory", 1, {"expected_sha256": "s-f"}), ("g", "approve_memory", 1, {"expected_updated_at": T0}),
        ("h", "approve_retain", 1, {"expected_sha256": "s-h"}), ("i", "reject_memory", 1, {}),
        ("j", "claim_memory", 1, {}), ("k", "effect_done", 1, {}), ("l", "claim_memory", 1, {"expected_sha256": "zzz"}),
        ("m", "interrupt", 0, {"prior_status": "postponed", "error_kind": "http", "error_status": 404}), ("zz", "postpone", 1, {}),
        ("a", "reject_request", 2, {}), ("n", "interrupt", 0, {"prior_status": "postponed", "error_kind": "http"}))
    assert got["a"]["status"] == "postponed" and got["a"]["postpone_count"] == 1
    assert got["d"]["status"] == "postponed" and "e" not in got and "h" not in got and "c" in got
    assert got["f"]["status"] == "review_in_progress" and got["f"]["encrypted_envelope"] == "{}"
    assert got["g"]["status"] == "reviewed_allowed" and got["g"]["encrypted_envelope"] is None
    assert got["g"]["encrypted_bytes"] == 0 and got["i"]["status"] == "reviewed_blocked"
    assert got["k"]["status"] == "review_side_effect_completed" and got["m"]["status"] == "postponed"
    # Without a status nobody knows whether the side effect happened.
    assert got["n"]["status"] == "review_side_effect_started"
    assert errors == {("d1", "postpone_limit_reached"), ("d2", "quarantine_expired"), ("d4", "quarantine_expired"),
                      ("d9", "quarantine_already_finalized"), ("d11", "quarantine_review_changed"),
                      ("d13", "quarantine_not_found"), ("d14", "superseded_decision")}
    assert events == [("a", "postponed"), ("d", "postponed"), ("d", "review_interrupted"), ("e", "expired"),
                      ("g", "reviewed_allowed"), ("h", "approved"), ("i", "reviewed_blocked"),
                      ("k", "review_side_effect_completed"), ("m", "review_interrupted")]


def test_cleanup_needs_the_previewed_count(spark):
    items = frame(spark, item("a"), item("b", "reviewed_allowed"))
    with pytest.raises(ValueError):
        review.run_cleanup(items, lit(T0), "b", expected=None)
    with pytest.raises(RuntimeError):
        review.run_cleanup(items, lit(T0), "b", expected=2)
    done = review.run_cleanup(items, lit(T0), "b", scope="all", expected=1)
    assert [r["quarantine_id"] for r in done.items.collect()] == ["b"]
    assert json.loads(done.events.first()["details"]) == {"filter": {"scope": "all"}}
    with pytest.raises(ValueError):
        quarantine.queue_page(items, lit(T0), 501)


def test_definite_failures(spark):
    df = spark.createDataFrame([(None, None), ("http", 404), ("http", 500), ("timeout", None)], "k string, s int")
    got = [r[0] for r in df.select(review.failure_is_definite(F.col("k"), F.col("s"))).collect()]
    assert got == [True, True, False, False]


def test_tables_round_trip(spark, tmp_path):
    items = frame(spark, item("a"), item("b"))
    tables.save_items(items, str(tmp_path / "items"))
    old = items.drop("dedupe_key", "requarantine_count", "expires_at")
    old.write.parquet(str(tmp_path / "old"))
    assert tables.load_items(spark, str(tmp_path / "items")).count() == 2
    assert tables.load_items(spark, str(tmp_path / "old")).first()["requarantine_count"] == 0
    swept = review.sweep_expired(frame(spark, item("c", expires_at=T0)), lit(T0), "x")
    tables.append_events(swept.events, str(tmp_path / "events"))
    assert tables.load_events(spark, str(tmp_path / "events")).first()["event_type"] == "cleanup"


def test_legacy_files(spark, tmp_path):
    lines = [
        {"timestamp": "2024-01-01T00:00:00Z", "reason": "r", "decision": "postponed", "quarantine_id": "q_a_0123456789abcdef",
         "postpone_count": 2, "decided_at": "2024-01-02T00:00:00Z"},
        {"timestamp": "2024-01-01T00:00:00Z", "reason": "r", "decision": "promoted", "quarantine_id": "q_b_0123456789abcdef"},
        {"timestamp": "2024-01-01T00:00:00Z", "reason": "r", "decision": "pending"}]
    (tmp_path / "queue.jsonl").write_text("\n".join(map(json.dumps, lines)) + "\n\n[1]\n{oops\n")
    good, bad = tables.read_legacy_queue(spark, str(tmp_path / "queue.jsonl"))
    assert sorted(r["reject_reason"] for r in bad.collect()) == ["invalid_json", "not_an_object"]
    objects = tmp_path / "objects"
    objects.mkdir()
    (objects / "q_a_0123456789abcdef.enc.json").write_text('{"x":\n1}')
    (objects / "bad name.enc.json").write_text("{}")
    files = tables.read_legacy_objects(spark, str(objects))
    assert [r["quarantine_id"] for r in files.collect()] == ["q_a_0123456789abcdef"]
    opened = files.select("quarantine_id", F.lit("2024-01-01T00:00:00Z").alias("created_at"),
                          F.lit("unknown_writer").alias("reason"), F.lit("w").alias("writer_id"),
                          F.lit(None).cast("string").alias("source"), F.lit("retain").alias("action"),
                          F.lit("s").alias("sha256"), "envelope")
    outcomes, new, events = tables.import_legacy(good, opened, frame(spark, item("q_z")), "i")
    assert tables.migration_summary(outcomes).first().asDict() == {
        "imported": 1, "skipped_existing": 0, "skipped_finalized": 1, "skipped_without_payload": 1}
    row = new.first()
    assert (row["status"], row["postpone_count"], row["kind"]) == ("postponed", 2, "retain_request")
    assert sorted(r["event_type"] for r in events.collect()) == ["postponed", "postponed", "quarantined"]
    again, _, _ = tables.import_legacy(good, opened, new, "i")
    assert tables.migration_summary(again).first()["skipped_existing"] == 1


def test_legacy_queue_is_parsed_once(spark):
    lines = spark.createDataFrame([('{"timestamp":"2024-01-01T00:00:00Z","reason":"unknown_writer","decision":"pending","quarantine_id":"q_1"}',)], "value string")
    good, _ = tables.parse_legacy_queue(lines)
    objects = spark.createDataFrame([("q_1", "2024-01-01T00:00:00Z", "unknown_writer", "w", None, "retain", "s", "{}")],
                                    "quarantine_id string, created_at string, reason string, writer_id string, source string,"
                                    " action string, sha256 string, envelope string")
    none = spark.createDataFrame([], "quarantine_id string")

    def parses(df):
        return "parse" in df._jdf.queryExecution().optimizedPlan().toString().lower()

    assert parses(good) and not any(map(parses, tables.import_legacy(good, objects, none, "i")))


def test_merge_fetches_the_last_evidence(spark):
    """Repeats at one moment, a repeated row and a third of the rows in one identity: the last row's evidence."""
    fields = ("request_id string, at timestamp, kind string, reason string, writer_id string, source string, source_bank string,"
              " source_memory_id string, source_content_sha256 string, dedupe_key string, sha256 string, encrypted_envelope string,"
              " encrypted_bytes long, quarantine_id string")
    keys = ["hot" if i % 3 == 0 else f"k{i % 13}" for i in range(90)]
    rows = [(f"r{i:03d}", f"2024-01-0{1 + i // 60}", "retain_request", "suspicious_content", "w", "s", None, None, None, k,
             f"h{i}", f"envelope {i}", i, f"q_{k}") for i, k in enumerate(keys)]
    rows.append(rows[-1])
    df = spark.createDataFrame([(r[0], None, *r[2:]) for r in rows], fields).drop("at").join(
        spark.createDataFrame([(r[0], r[1]) for r in rows[:-1]], "request_id string, at string"), "request_id")
    df = df.withColumn("at", F.col("at").cast("timestamp"))
    items = spark.createDataFrame([], quarantine.ITEM_SCHEMA)
    moment = F.lit("2024-02-01").cast("timestamp")
    out = {r["dedupe_key"]: r for r in quarantine.merge_candidates(items, df, moment, "b").items.collect()}
    last = {r[9]: r for r in sorted(rows, key=lambda r: (r[1], r[0]))}
    assert {k: (r["encrypted_envelope"], r["encrypted_bytes"], r["sha256"]) for k, r in out.items()} == {
        k: (r[11], r[12], r[10]) for k, r in last.items()}
    assert {k: r["requarantine_count"] + 1 for k, r in out.items()} == {k: sum(r[9] == k for r in rows) for k in last}
    plan = quarantine.classify(df, items, moment)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = next(line for line in plan.splitlines() if "Aggregate [" in line and "min_by" in line)
    assert "encrypted_envelope" not in aggregate


def _repeats(spark):
    """Candidates of a hot and some other identities in no order of time, the last of each with its own evidence."""
    fields = ("request_id string, ms long, kind string, reason string, writer_id string, source string, source_bank string,"
              " source_memory_id string, source_content_sha256 string, dedupe_key string, sha256 string, encrypted_envelope string,"
              " encrypted_bytes long, quarantine_id string")
    rows = []
    for i in range(90):
        k, ms = "hot" if i % 3 == 0 else f"k{i % 13}", None if i == 7 else (i * 37 % 90) * 1_000_000
        rows.append((f"r{i:03d}", ms, "retain_request", "suspicious_content", "w", "s", None, None, None, k, f"h{i}",
                     f"envelope {i}", i, f"q_{k}"))
    return rows, spark.createDataFrame(rows, fields).withColumn("at", F.timestamp_millis("ms")).drop("ms")


def test_events_of_frequent_identities_are_numbered_as_others(spark, monkeypatch):
    rows, df = _repeats(spark)
    items, moment = spark.createDataFrame([], quarantine.ITEM_SCHEMA), F.lit("2024-02-01").cast("timestamp")

    def events():
        return quarantine.merge_candidates(items, df, moment, "b").events

    whole = events()
    plan = whole._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Window [") == 1, "one sort numbers the rows, with no second pass over counts"
    want = sorted(whole.collect())
    monkeypatch.setattr(quarantine, "ONE_SORT", 10)
    assert sorted(events().collect()) == want and len(want) == 89


def test_evidence_is_merged_before_it_moves(spark):
    rows, df = _repeats(spark)
    items, moment = spark.createDataFrame([], quarantine.ITEM_SCHEMA), F.lit("2024-02-01").cast("timestamp")
    out = quarantine.merge_candidates(items, df, moment, "b").items
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert any("partial_max_by" in line for line in plan.splitlines())
    last = {r[9]: r for r in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))}
    assert {r["dedupe_key"]: r["encrypted_envelope"] for r in out.collect()} == {k: r[11] for k, r in last.items()}
