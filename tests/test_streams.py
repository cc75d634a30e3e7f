import datetime as dt
import json
import random

import pandas as pd
from pyspark.sql import functions as F

from memgov.operators import logs, quota
from memgov.operators import ordered_fold as folds
from memgov.sources.registry import read_registry
from memgov.sources.requests import stream_requests
from memgov.streaming import gate


def test_gate_splits_requests(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    lines = [{"request_id": "1", "writer_id": "main", "op": "retain", "ts_ms": 1, "body": {"items": [{"content": "hi"}]}},
             {"request_id": "2", "writer_id": "main", "op": "recall", "ts_ms": 2, "body": {"query": "exfiltrate"}},
             {"request_id": "3", "writer_id": "who", "op": "recall", "ts_ms": 3, "body": {"query": "x"}}]
    (source / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    gate.stream_gate(stream_requests(spark, str(source)), read_registry(spark), str(tmp_path / "ok"),
                     str(tmp_path / "no"), str(tmp_path / "cp")).awaitTermination()
    assert [r["request_id"] for r in spark.read.parquet(str(tmp_path / "ok")).collect()] == ["1"]
    refused = {r["request_id"]: r["reason"] for r in spark.read.parquet(str(tmp_path / "no")).collect()}
    assert refused == {"2": "suspicious_query", "3": "unknown_writer"}


def test_quota_state_lives_between_batches(spark, tmp_path):
    source, out, cp = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "cp")
    schema = "request_id string, writer_id string, ts_ms long"

    def feed(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        gate.write_once(gate.stream_quota(stream, 2, 100), out, cp).awaitTermination()

    feed([("a", "w", 10), ("b", "w", 20)])
    feed([("c", "w", 30), ("d", "w", 110), ("e", "v", 30)])
    got = {r["request_id"]: r["verdict"] for r in spark.read.parquet(out).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": True}


def test_log_events(spark, tmp_path):
    rows = [("nope", "info", "app", "bad_kind"), ("request_failed", "warning", "not a name!", "timeout")]
    df = spark.createDataFrame(rows, "event string, level string, logger string, error_kind string").withColumns(
        {"reason": F.lit(None).cast("string"), "error_fingerprint": F.lit(None).cast("string")})
    out = logs.sanitize_log_fields(logs.apply_event_contract(df)).collect()
    assert (out[0]["event"], out[0]["level"], out[0]["reason"], out[0]["error_kind"]) == (
        "logging_contract_violation", "error", "unregistered-event", "unexpected")
    assert out[1]["logger"].startswith("logger:") and len(out[1]["logger"]) == 23


def test_write_log_events(spark, tmp_path):
    from memgov.sources.tables import write_log_events

    df = spark.createDataFrame([("e", None, 1)], "event string, reason string, http_status int")
    write_log_events(df, str(tmp_path / "log"))
    assert spark.read.text(str(tmp_path / "log")).first()[0] == '{"event":"e","http_status":1}'


def _disordered(spark, tmp_path, make, parts, settle_at):
    """The stream over parts, one run each, and a last row far ahead. Returns what came out after each run."""
    source, out, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema, seen = "request_id string, writer_id string, ts_ms long", []
    for part in [*parts, [("end", "end", settle_at)]]:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = make(spark.readStream.schema(schema).parquet(source))
        gate.write_once(stream, out, cp, settle=True).awaitTermination()
        seen.append({r["request_id"]: r[-1] for r in spark.read.schema(stream.schema).parquet(out).collect()})
    return seen


def test_one_window_over_several_micro_batches(spark, tmp_path):
    """Rows of a window in wrong order, a third of them of one key, some without a key: the batch's verdicts."""
    rnd = random.Random(4)
    rows = [(f"r{i:03d}", "hot" if i % 3 == 0 else None if i % 7 == 0 else f"w{i % 5}", 1_000_000 + rnd.randrange(20_000)) for i in range(240)]
    parts = [sorted(rows, key=lambda r: r[2] + random.Random(r[0]).randrange(4_000))[k:k + 60] for k in range(0, 240, 60)]
    assert max(r[2] for r in parts[0]) > min(r[2] for r in parts[1])
    df = spark.createDataFrame(rows, "request_id string, writer_id string, ts_ms long")
    want = {r["request_id"]: r["admitted"] for r in quota.admit_quota(df, 2, 0, 1_000).collect()}
    seen = _disordered(spark, tmp_path / "q", lambda s: gate.stream_quota(s, 2, 1_000, "5 seconds"), parts, 2_000_000)
    assert seen[-1] == want and len(seen[1]) > 0
    held = {r["request_id"]: r["suppressed"] for r in quota.throttle(df, F.col("writer_id"), F.lit(False), 700).collect()}
    out = _disordered(spark, tmp_path / "t", lambda s: gate.stream_throttle(s, F.col("writer_id"), F.lit(False), 700, "5 seconds"),
                      parts, 2_000_000)
    assert out[-1] == held


def test_quota_state_goes_after_its_window(spark, tmp_path):
    parts = [[("a", "w", 1_000_000), ("b", "v", 1_000_100)], [("c", "x", 1_900_000)]]
    _disordered(spark, tmp_path, lambda s: gate.stream_quota(s, 2, 1_000, "5 seconds"), parts, 1_901_500)

    def stored(name, **options):
        return spark.read.format("statestore").option("stateVarName", name).options(**options).load(str(tmp_path / "cp"))

    with gate._settings(spark, gate.STATE_SETTINGS):
        kept = {r["key"]["writer_id"] for r in stored("fold").collect()}
        first = {r["key"]["writer_id"] for r in stored("fold", batchId=2).collect()}
        waiting = {r["key"]["writer_id"] for r in stored("waiting").collect()}
    assert (kept, waiting) == (set(), {"x", "end"}) and first <= {"w", "v"}


def test_many_waiting_rows_of_a_key_lie_in_slices(spark, tmp_path):
    """A key beyond the number held together and one below it: the verdicts of the batch, and nothing left waiting."""
    rnd = random.Random(8)
    rows = [(f"r{i:04d}", "hot" if i % 60 else "cold", 1_000_000 + rnd.randrange(30_000)) for i in range(2 * gate.TOGETHER + 600)]
    rows.sort(key=lambda r: r[2] + random.Random(r[0]).randrange(4_000))
    parts = [rows[:gate.TOGETHER + 300], rows[gate.TOGETHER + 300:]]
    df = spark.createDataFrame(rows, "request_id string, writer_id string, ts_ms long")
    want = {r["request_id"]: r["admitted"] for r in quota.admit_quota(df, 2, 0, 1_000).collect()}
    seen = _disordered(spark, tmp_path, lambda s: gate.stream_quota(s, 2, 1_000, "5 seconds"), parts, 2_000_000)
    assert seen[-1] == want and 0 < len(seen[0]) < len(rows)


class _Value:
    """A state variable in memory that counts what a state store would be asked."""

    def __init__(self):
        self.held, self.calls = {}, 0

    def get(self):
        self.calls += 1
        return self.held.get(0)

    def update(self, value):
        self.calls += 1
        self.held[0] = value

    def clear(self):
        self.calls += 1
        self.held.clear()

    def keys(self):
        self.calls += 1
        return list(self.held)

    def updateValue(self, key, value):
        self.calls += 1
        self.held[key] = value

    def getValue(self, key):
        self.calls += 1
        return self.held[key]

    def removeKey(self, key):
        self.calls += 1
        del self.held[key]

    exists = containsKey = get


def test_few_waiting_rows_take_few_calls_to_the_state_store():
    """Forty rows of one key in as many slices: calls per key and micro-batch, not per slice."""
    states = []

    class Handle:
        def getValueState(self, *args):
            states.append(_Value())
            return states[-1]

        getMapState = getValueState

        def registerTimer(self, at):
            pass

    class Times:
        def getCurrentWatermarkInMs(self):
            return 10_000

    processor = gate.OrderedFoldProcessor(folds.KeyedQuota(2, 400), 100, 400, ["writer_id", "request_id", "ts_ms"])
    processor.init(Handle())
    rows = pd.DataFrame({"writer_id": "w", "request_id": [f"r{i:02d}" for i in range(40)], "ts_ms": [100 * i + 7 for i in range(40)]})
    list(processor.handleInputRows(("w",), iter([rows]), None))
    out = pd.concat(list(processor.handleExpiredTimer(("w",), Times(), None)))
    assert out["request_id"].tolist() == rows["request_id"].tolist()
    assert sum(s.calls for s in states) <= 8


def test_merge_stream_drops_superseded_versions(spark, tmp_path):
    from memgov.operators.quarantine import EVIDENCE, ITEM_SCHEMA
    from memgov.sources.tables import save_items

    root, incoming = str(tmp_path / "root"), str(tmp_path / "in")
    save_items(spark.createDataFrame([], ITEM_SCHEMA), f"{root}/items/version={0:012d}")
    types = dict(spark.createDataFrame([], ITEM_SCHEMA).dtypes)
    schema = "request_id string, at timestamp, quarantine_id string, " + ", ".join(f"{c} {types[c]}" for c in EVIDENCE)
    for turn in range(3):
        rows = [(f"r{turn}{i}", dt.datetime(2024, 1, 1 + turn), f"q{i}", "security_event", "denied_endpoint", None, "application",
                 None, None, None, None, f"Digest {turn}", "{}", 1) for i in range(turn, turn + 2)]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(incoming)
        gate.stream_quarantine(spark.readStream.schema(schema).parquet(incoming), root, f"{root}/checkpoint",
                               keep_versions=False).awaitTermination()
    assert sorted(p.name for p in (tmp_path / "root/items").glob("version=*")) == [f"version={n:012d}" for n in (2, 3)]
    final = spark.read.parquet(f"{root}/items/version={3:012d}").collect()
    assert sorted((r["quarantine_id"], r["requarantine_count"], r["sha256"]) for r in final) == [
        ("q0", 0, "Digest 0"), ("q1", 1, "Digest 1"), ("q2", 1, "Digest 2"), ("q3", 0, "Digest 2")]
    details = [r["details"] for r in spark.read.parquet(f"{root}/events").collect()]
    assert sorted(json.loads(d)["sha256"] for d in details) == sorted(f"Digest {t}" for t in (0, 0, 1, 1, 2, 2))


def test_untouched_items_stay_in_place(spark, tmp_path):
    from memgov.operators.quarantine import _untouched
    from memgov.sources.tables import load_items

    path = str(tmp_path / "items")
    spark.createDataFrame([(None if i % 50 == 0 else f"q{i // 2}", f"k{i}") for i in range(300)], "quarantine_id string, dedupe_key string") \
        .repartition(3).write.parquet(path)
    touched = spark.createDataFrame([(f"q{i}",) for i in range(0, 150, 3)] + [(None,), ("other",)], "quarantine_id string")
    placed = load_items(spark, path, placed=True)
    out = _untouched(placed, touched)
    plain = _untouched(load_items(spark, path), touched)
    assert sorted(r["dedupe_key"] for r in out.collect()) == sorted(r["dedupe_key"] for r in plain.collect())
    assert 150 < out.count() < 300
    assert _untouched(placed, touched.limit(0)).count() == 300


def test_digests_survive_packing(spark):
    from memgov.functions.identity import packed_hex, unpacked_hex

    texts = ["ab" * 32, "AB" * 32, "abc", "0abc", "", None, "not hex", "aB"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    packed = df.withColumn("p", packed_hex(F.col("t")))
    assert [r[0] for r in packed.select(unpacked_hex(F.col("p"))).collect()] == texts
    assert packed.filter("t = '" + "ab" * 32 + "'").select(F.octet_length("p.bytes")).first()[0] == 32
