import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from memgov.fixed import QuarantineLimits
from memgov.operators import ordered_fold as folds
from memgov.operators import quota
from memgov.operators.quarantine import ITEM_SCHEMA


def requests(seed, n=400, writers=5, span=3000, hot=0.4):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        w = "w0" if rnd.random() < hot else f"w{rnd.randrange(writers)}"
        rows.append((f"r{i:05d}", w, rnd.randrange(span)))
    return rows


def brute(rows, per_writer, overall, window):
    admitted, seen = set(), []
    for rid, w, t in sorted(rows, key=lambda r: (r[2], r[0])):
        live = [s for s in seen if s[1] > t - window]
        mine = sum(1 for s in live if s[0] == w)
        if (overall > 0 and len(live) >= overall) or (per_writer > 0 and mine >= per_writer):
            continue
        seen.append((w, t))
        admitted.add(rid)
    return admitted


@pytest.mark.parametrize("per_writer,overall,window,block", [
    (3, 0, 100, 10_000), (3, 0, 100, 40), (4, 9, 150, 10_000), (4, 9, 150, 37), (1, 0, 50, 25),
    (2, 500, 60, 50)])
def test_quota_equals_one_pass(spark, per_writer, overall, window, block):
    rows = requests(per_writer * 7 + window)
    df = spark.createDataFrame(rows, "request_id string, writer_id string, ts_ms long")
    out = quota.admit_quota(df, per_writer, overall, window, rows_per_block=block).collect()
    assert len(out) == len(rows)
    assert {r["request_id"] for r in out if r["admitted"]} == brute(rows, per_writer, overall, window)


def test_window_edge_and_retry(spark):
    df = spark.createDataFrame([("a", "w", 10), ("b", "w", 10), ("c", "w", 20)],
                               "request_id string, writer_id string, ts_ms long")
    out = {r["request_id"]: r for r in quota.admit_quota(df, 1, 0, 10).collect()}
    assert [out[k]["admitted"] for k in "abc"] == [True, False, True]
    assert out["b"]["retry_after_s"] == 1


def test_offered_load(spark):
    rows = requests(5, n=300, span=5000)
    df = spark.createDataFrame(rows, "request_id string, writer_id string, ts_ms long")
    got = {r["request_id"]: r["offered"] for r in quota.offered_load(df, "writer_id", 70).collect()}
    want = {rid: sum(1 for _, w2, t2 in rows if w2 == w and t - 70 < t2 <= t) for rid, w, t in rows}
    assert got == want


@pytest.mark.parametrize("block", [10_000, 30])
def test_distinct(spark, block):
    rnd = random.Random(3)
    rows = [(f"r{i:04d}", f"s{rnd.randrange(2)}", f"f{rnd.randrange(6)}", rnd.randrange(900))
            for i in range(200)]
    df = spark.createDataFrame(rows, "request_id string, scope string, identity string, ts_ms long")
    out = quota.admit_distinct(df, 2, 60, rows_per_block=block).collect()
    state, want = {}, set()
    for rid, scope, fam, t in sorted(rows, key=lambda r: (r[3], r[0])):
        cur = {f: x for f, x in state.get(scope, {}).items() if x > t - 60}
        if fam in cur or len(cur) < 2:
            cur[fam] = t
            want.add(rid)
        state[scope] = cur
    assert {r["request_id"] for r in out if r["admitted"]} == want


@pytest.mark.parametrize("block", [10_000, 40])
def test_throttle(spark, block):
    rnd = random.Random(9)
    rows = [(f"r{i:04d}", f"k{rnd.randrange(3)}", rnd.randrange(2000)) for i in range(250)]
    df = spark.createDataFrame(rows, "request_id string, k string, ts_ms long")
    out = quota.throttle(df, F.col("k"), F.lit(False), 60, rows_per_block=block).collect()
    last, held, want = {}, {}, {}
    for rid, k, t in sorted(rows, key=lambda r: (r[2], r[0])):
        if k in last and t - last[k] < 60:
            held[k] = held.get(k, 0) + 1
        else:
            want[rid], last[k], held[k] = held.get(k, 0), t, 0
    assert {r["request_id"]: r["suppressed"] for r in out} == want


def test_health(spark):
    seq = [(True, None), (False, "timeout"), (True, None), (False, "timeout"), (False, "timeout"),
           (False, "timeout"), (False, "network"), (True, None), (True, None)]
    rows = [(f"p{i}", "store", i * 10_000, ok, kind) for i, (ok, kind) in enumerate(seq)]
    df = spark.createDataFrame(rows, "request_id string, component string, ts_ms long, ok boolean, error_kind string")
    out = {r["request_id"]: r["transition"] for r in quota.health_transitions(df).collect()}
    assert out == {"p4": "failed", "p6": "failed", "p8": "recovered"}


def candidates(seed, n):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choice(["retain_request", "recall_request", "security_event"])
        w = rnd.choice(["w0", "w0", "w1", "w2", None])
        reason = rnd.choice(["unknown_writer", "suspicious_content"]) if kind != "security_event" else "denied_endpoint"
        key = f"k{rnd.randrange(n // 2)}"
        rows.append((f"r{i:05d}", rnd.randrange(4000), kind, reason, w, None, None, key, f"q_{kind[0]}{key}",
                     rnd.randrange(1, 60), f"{kind}:{reason}:{w}", f"f{rnd.randrange(4)}"))
    return rows

SCHEMA = ("request_id string, ts_ms long, kind string, reason string, writer_id string, source_bank string, "
          "source_memory_id string, dedupe_key string, quarantine_id string, item_bytes long, "
          "family_scope string, family string")


def test_evidence_blocks_equal_one_pass(spark):
    rows = candidates(4, 300)
    df = spark.createDataFrame(rows, SCHEMA)
    items = spark.createDataFrame([], ITEM_SCHEMA)
    limits = QuarantineLimits(item_bytes=60, pending_items=40, pending_per_writer=12, encrypted_bytes=900,
                              writes_per_writer=3, writes_global=8, families=2, window_ms=300)
    at = F.lit("2024-01-01").cast("timestamp")
    one = {r["request_id"]: r["code"] for r in quota.admit_evidence(df, items, at, limits).collect()}
    many = {r["request_id"]: r["code"]
            for r in quota.admit_evidence(df, items, at, limits, rows_per_block=45).collect()}
    assert one == many and len(one) == 300
    assert {"quarantine_rate_limited", "quarantine_capacity_exceeded", None} <= set(one.values())


def test_counts_equal_sequence(spark):
    rnd = random.Random(8)
    rows = [(f"r{i:04d}", rnd.randrange(500), rnd.choice(["retain_request", "security_event"]), "suspicious_content",
             rnd.choice(["a", "a", "b", "c"])) for i in range(120)]
    df = spark.createDataFrame(rows, "request_id string, ts_ms long, kind string, reason string, writer_id string")
    items = spark.createDataFrame([], ITEM_SCHEMA)
    limits = QuarantineLimits(pending_items=30, pending_per_writer=8)
    out = {r["request_id"]: r["code"] for r in
           quota.admit_counts(df, items, F.lit("2024-01-01").cast("timestamp"), limits).collect()}
    total, scopes, want = 0, {}, {}
    for rid, _, kind, _, w in sorted(rows, key=lambda r: (r[1], r[0])):
        if total >= 30:
            want[rid] = "quarantine_capacity_exceeded"
        elif kind != "security_event" and scopes.get(w, 0) >= 8:
            want[rid] = "quarantine_writer_capacity_exceeded"
        else:
            want[rid] = None
            total += 1
            scopes[w] = scopes.get(w, 0) + 1
    assert {k for k, v in out.items() if v is None} == {k for k, v in want.items() if v is None}


def test_fold_keeps_bounded_state():
    fold = folds.KeyedQuota(2, 10)
    state = fold.start()
    for t in range(100):
        fold.feed(state, t, "x")
        assert len(state) <= 2
    assert fold.dump(state, 1000) is None


def admit_one_by_one(rows, limits):
    """The store's rules for evidence that is all new at the start, in arrival order."""
    times, families, stored, verdicts = {}, {}, {}, {}
    for rid, t, kind, reason, writer, _, _, key, _, size, scope, family in sorted(rows, key=lambda r: (r[1], r[0])):
        edge = t - limits.window_ms
        ident = (kind == "security_event", kind[0] + key if kind == "security_event" else key)
        known = ident in stored
        if known:
            budgets = [("ops", limits.requarantine_ops)]
        else:
            name = "unknown-writer" if reason == "unknown_writer" else writer or "unknown-writer"
            budgets = [("w:" + name, limits.writes_per_writer), ("all", limits.writes_global)]
        if any(sum(1 for x in times.get(n, []) if x > edge) >= cap for n, cap in budgets):
            verdicts[rid] = "quarantine_rate_limited"
            continue
        if not known and kind != "security_event":
            live = {f for f, x in families.get(scope, {}).items() if x > edge}
            if family not in live and len(live) >= limits.families:
                verdicts[rid] = "quarantine_rate_limited"
                continue
            families.setdefault(scope, {})[family] = t
        elif not known and family is not None:
            live = {f for f, x in families.get(scope, {}).items() if x > edge}
            if family not in live and len(live) >= limits.families:
                verdicts[rid] = "quarantine_rate_limited"
                continue
            families.setdefault(scope, {})[family] = t
        for n, _ in budgets:
            times.setdefault(n, []).append(t)
        room = "unknown" if reason == "unknown_writer" else f"writer:{writer}" if writer else f"kind:{kind}"
        old = stored.get(ident)
        pending = len(stored) - (old is not None) + 1
        held = sum(s for s, _ in stored.values()) - (old[0] if old else 0) + size
        if pending > limits.pending_items or held > limits.encrypted_bytes:
            verdicts[rid] = "quarantine_capacity_exceeded"
            continue
        if kind != "security_event":
            same = sum(1 for k, (_, r) in stored.items() if r == room and not (k == ident))
            if same + 1 > limits.writer_allowance:
                verdicts[rid] = "quarantine_writer_capacity_exceeded"
                continue
        stored[ident] = (size, room)
        verdicts[rid] = None
    return verdicts


@pytest.mark.parametrize("seed", [1, 2])
def test_evidence_equals_one_by_one(spark, seed):
    rows = candidates(seed, 250)
    df = spark.createDataFrame(rows, SCHEMA)
    limits = QuarantineLimits(item_bytes=60, pending_items=60, pending_per_writer=12, encrypted_bytes=1500,
                              writes_per_writer=4, writes_global=9, families=2, requarantine_ops=5, window_ms=300)
    at = F.lit("2024-01-01").cast("timestamp")
    items = spark.createDataFrame([], ITEM_SCHEMA)
    got = {r["request_id"]: r["code"] for r in quota.admit_evidence(df, items, at, limits, rows_per_block=90).collect()}
    want = admit_one_by_one(rows, limits)
    assert {k: (got[k], want[k]) for k in want if got[k] != want[k]} == {}
    assert len(set(got.values())) >= 3


@pytest.mark.parametrize("kind", ["quota", "throttle"])
def test_blocks_with_null_and_hot_keys(spark, kind):
    """A third of the rows has one key, some have none; blocks are folded at most twice."""
    rows = [(f"{i:05d}", None if i % 7 == 0 else "hot" if i % 3 == 0 else f"w{i % 11}", 10 * i + (5_000 if i > 300 else 0), False)
            for i in range(500)]
    df = spark.createDataFrame(rows, "request_id string, writer_id string, ts_ms long, exempt boolean")
    fold = folds.KeyedQuota(3, 400) if kind == "quota" else folds.Throttle(300)
    verdicts, runs = folds.fold_with_runs(df, fold, "boolean" if kind == "quota" else "long", "writer_id", rows_per_block=40)
    blocks, folded = runs[0].filter("last").count(), sum(r.filter("last").count() for r in runs)
    assert blocks >= 8 and folded <= 2 * blocks
    want, states = {}, {}
    for request_id, writer, ts, exempt in sorted(rows, key=lambda r: (r[2], r[0])):
        state = states.setdefault(writer, fold.start())
        want[request_id] = fold.feed(state, ts, request_id, *([exempt] if kind == "throttle" else []))
    assert {r["request_id"]: r["verdict"] for r in verdicts.collect()} == want


def test_quiet_stretches_begin_new_chains(spark):
    df = spark.createDataFrame([(f"{i:04d}", "w", 1_000 * i) for i in range(200)], "request_id string, writer_id string, ts_ms long")
    _, runs = folds.fold_with_runs(df, folds.KeyedQuota(1, 500), "boolean", "writer_id", rows_per_block=20)
    assert len(runs) == 1


def test_one_chain_runs_each_block_once(spark):
    """A fold without key and reach; some rows have no time, and blocks begin and end with them."""
    rows = [(f"{i:04d}", None if i % 5 == 0 else 100 * i, i % 7 > 2, "timeout") for i in range(300)]
    df = spark.createDataFrame(rows, "request_id string, ts_ms long, ok boolean, error_kind string")
    fold = folds.HealthTransitions(1_000)
    verdicts, runs = folds.fold_with_runs(df, fold, "string", rows_per_block=40)
    blocks = verdicts.count() // 40
    assert sum(r.filter("last").count() for r in runs) == runs[-1].filter("last").first()["_block"] + 1 >= blocks
    state, want = fold.start(), {}
    for request_id, ts, ok, kind in sorted(rows, key=lambda r: (r[1] is None, r[1] or 0, r[0])):
        want[request_id] = fold.feed(state, float("nan") if ts is None else ts, request_id, ok, kind)
    assert {r["request_id"]: r["verdict"] for r in verdicts.collect()} == want


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_evidence_batches_equal_single_rows(seed):
    rng = random.Random(seed)
    limits = QuarantineLimits(item_bytes=60, pending_items=40, pending_per_writer=12, encrypted_bytes=1500,
                              writes_per_writer=3, writes_global=7, families=2, requarantine_ops=4, window_ms=50)
    rows, t = [], 0
    for i in range(2_000):
        t += rng.choice([0, 0, 0, 1, 30])
        writer, old = f"w{rng.randrange(4)}", rng.random() < 0.1
        budget = [("writes:writer:" + writer, 3), ("writes", 7)]
        texts = [json.dumps([{"key": k, "cap": c} for k, c in some]) for some in (budget, [("requarantine", 4)])]
        rows.append((t, f"{i:05d}", f"m{rng.randrange(200)}" if not old else f"old{i}", "retain_request", "suspicious_content", writer, 0,
                     writer, rng.choice("abc"), rng.randrange(60), "pending" if old else None, old, 5 if old else None, writer if old else None, *texts))
    fold = folds.EvidenceAdmission(limits, 3, 20)
    one, many = fold.start(), fold.start()
    want = [fold.feed(one, *r) for r in rows]
    got = []
    for at in range(0, len(rows), 170):
        times, *rest = zip(*rows[at:at + 170], strict=True)
        got += fold.feed_batch(many, list(times), [pa.array(list(c)) for c in rest])
    assert got == want and None in want and len(set(want)) >= 3
    assert one["items"] == many["items"] and one["pending"] == many["pending"] and one["bytes"] == many["bytes"]


def test_a_batch_of_evidence_is_not_walked_row_by_row(monkeypatch):
    """Only rows whose budgets have a place cost a step each."""
    steps = []
    step = folds._Block._next
    monkeypatch.setattr(folds._Block, "_next", lambda self, *row: (steps.append(row), step(self, *row)))
    limits = QuarantineLimits(writes_per_writer=2, writes_global=3, requarantine_ops=1, window_ms=100)
    block = folds._Block(folds.EvidenceAdmission(limits, 0, 0), 0, None)
    n = 5_000
    budgets = ['[{"key":"w","cap":2}]', '[{"key":"again","cap":1}]']
    row = {"match_key": "m", "kind": "security_event", "reason": "r", "scope": "s", "scope_pending": 0, "family_scope": None, "family": None,
           "item_bytes": 1, "old_status": None, "old_live": None, "old_bytes": None, "old_scope": None}
    columns = {"ts_ms": pa.array([0] * (n - 1) + [None], pa.int64()), "id": pa.array([f"{i:05d}" for i in range(n)])}
    strings = {"family_scope", "family", "old_status", "old_scope"}
    for name, value in row.items():
        values = [f"m{i % 9}" for i in range(n)] if name == "match_key" else [value] * n
        columns[name] = pa.array(values, pa.string() if name in strings else pa.bool_() if name == "old_live" else pa.int64() if value is None else None)
    columns |= {"fresh_budgets": pa.array([budgets[0]] * n), "known_budgets": pa.array([budgets[1]] * n)}
    early = {name: c.slice(0, n - 1) for name, c in columns.items()}
    verdicts = block.feed(["k"] * (n - 1), list(early.values()))
    # Two new items, and the first of them once more.
    assert [i for i, v in enumerate(verdicts) if v is None] == [0, 1, 9]
    assert len(steps) == 1 and block.at == 0
    assert block.feed(["k"], [c.slice(n - 1) for c in columns.values()]) == ["quarantine_rate_limited"]
    assert block.at == 0


def test_columns_become_lists_as_to_pylist_makes_them():
    import datetime

    arrays = [pa.array(["a", None, ""]), pa.array([True, None, False]), pa.array([1, 2, 3]), pa.array([1, None, 3]), pa.array([1.5, 2.0]),
              pa.array([datetime.datetime(2024, 1, 1), None]), pa.array([], pa.string()), pa.array(["a", "b", None, "c"]).slice(1)]
    for array in arrays:
        got = folds._listed(array)
        assert got == array.to_pylist() and [type(v) for v in got] == [type(v) for v in array.to_pylist()]
