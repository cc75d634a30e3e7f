"""Exact order-dependent decisions over tables too large for one task.

Rows are range-partitioned by (key, time, id) into blocks and each block is folded on its own, row by row as
they come from the sort, so that a worker holds one batch and the fold's state. What a block
needs from its predecessor is a small bounded state (for a quota: the admitted times of the last window),
and only if it goes on with the same key within the fold's reach. Blocks first run without it. Then, of each
chain of blocks that depend on each other, the first that ran with another state than its predecessor
leaves runs again: its predecessor is final, so no block runs more than twice, though a chain takes as many
rounds as it has such blocks. A round reads the folders of its blocks only. A key may span any number of
blocks; after a quiet stretch longer than the reach a new chain begins. A fold without key and reach is one
chain, whose blocks run once, one after the other.
"""

from __future__ import annotations

import functools
import heapq
import itertools
import json
from collections import defaultdict, deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memgov.session import cut_lineage, new_scratch

ROWS_PER_BLOCK = 500_000
# Without a key nearly all blocks wait for each other, so fewer and longer ones cost fewer rounds.
ROWS_PER_LONE_BLOCK = 4_000_000
# A key as text that sorts alike everywhere; null is a key of its own.
_KEY = "_fold_key"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_VERDICTS = {"boolean": pa.bool_(), "long": pa.int64(), "string": pa.string()}


def _listed(column) -> list:
    """to_pylist, in one conversion for the kinds of columns that folds take."""
    kind = column.type
    if pa.types.is_string(kind) or pa.types.is_boolean(kind) or not column.null_count and (
            pa.types.is_integer(kind) or pa.types.is_floating(kind)):
        return column.to_numpy(zero_copy_only=False).tolist()
    return column.to_pylist()


class _Block:
    """One block while its rows pass: the fold's state and the ends that the next block asks for."""

    def __init__(self, fold, number, used):
        self.fold, self.number, self.used = fold, number, used
        self.state = self.first_key = self.first_at = self.key = self.at = None

    def feed(self, keys, columns):
        """The verdicts of the next rows. Missing numbers are NaN."""
        columns = [c.cast(pa.float64()).fill_null(float("nan")) if c.null_count and (pa.types.is_integer(c.type) or pa.types.is_floating(c.type))
                   else c for c in columns]
        times, verdicts, at = _listed(columns[0]), [], 0
        if not hasattr(self.fold, "feed_batch"):
            for k, now, *row in zip(keys, times, *(_listed(c) for c in columns[1:]), strict=True):
                self._next(k, now)
                verdicts.append(self.fold.feed(self.state, now, *row))
            return verdicts
        for k, same in itertools.groupby(keys):
            end = at + sum(1 for _ in same)
            self._next(k, times[at])
            verdicts += self.fold.feed_batch(self.state, times[at:end], [c.slice(at, end - at) for c in columns[1:]])
            # The last moment that is not missing.
            self.at = next((int(now) for now in reversed(times[at:end]) if now == now), self.at)
            at = end
        return verdicts

    def _next(self, key, now):
        if self.state is None or key != self.key:
            self._begin(key, now)
        if now == now:
            self.at = int(now)

    def _begin(self, key, now):
        if self.state is None:
            self.first_key, self.first_at = key, int(now) if now == now else None
            self.state = self.fold.start() if self.used is None else self.fold.load(self.used)
        else:
            self.state = self.fold.start()
        self.key, self.at = key, None

    def ends(self):
        left = self.fold.dump(self.state, float("nan") if self.at is None else self.at)
        return [True, self.first_key, self.first_at, self.key, self.at, left, self.used]


def ordered_fold(rows: DataFrame, fold, verdict: str, key: str | None = None,
                 order: tuple[str, str] = ("ts_ms", "request_id"),
                 rows_per_block: int | None = None) -> DataFrame:
    """(order columns, verdict) of every row, decided in (key, time, id) order."""
    verdicts, _ = fold_with_runs(rows, fold, verdict, key, order, rows_per_block)
    return verdicts


def fold_with_runs(rows: DataFrame, fold, verdict: str, key: str | None = None,
                   order: tuple[str, str] = ("ts_ms", "request_id"),
                   rows_per_block: int | None = None) -> tuple[DataFrame, list[DataFrame]]:
    """The same, and what each round of block runs left."""
    spark = rows.sparkSession
    own = F.lit("k") if key is None else F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("n"))
    used_columns = list(dict.fromkeys([*order, *fold.columns]))
    # Written once: counting, finding the edges and dealing would each work the rows out again.
    narrow = cut_lineage(rows.withColumn(_KEY, own).select(*used_columns, _KEY), "fold-rows")
    per_block = rows_per_block or (ROWS_PER_LONE_BLOCK if key is None else ROWS_PER_BLOCK)
    blocks = max(1, -(-narrow.count() // per_block))
    types = dict(narrow.dtypes)
    out = ", ".join(f"`{c}` {types[c]}" for c in order) + f", verdict {verdict}"
    path = new_scratch(spark, "fold-blocks")
    in_place = [F.col(c).asc_nulls_last() for c in (_KEY, *order)]
    numbered = narrow.repartitionByRange(blocks, *in_place).withColumn("_block", F.spark_partition_id().cast("long"))
    numbered.write.partitionBy("_block").parquet(path)
    ranged = spark.read.schema(numbered.schema).parquet(path)
    # A run leaves a block's verdicts and one row (last = true) with its ends, what it was given and what
    # it hands on.
    fields = out + (", _block long, last boolean, first_key string, first_at long, out_key string, out_at long,"
                    " out_state string, used string")
    names = [*order, "verdict", "_block", "last", "first_key", "first_at", "out_key", "out_at", "out_state", "used"]
    kinds = [_VERDICTS[verdict], pa.int64(), pa.bool_(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]

    def fold_blocks(batches):
        def made(given, *columns):
            n = len(given[0])
            rest = [pa.array(c if isinstance(c, list) else [c] * n, k) for c, k in zip(columns, kinds, strict=True)]
            return pa.RecordBatch.from_arrays([*given, *rest], names)

        def end():
            return made([pa.nulls(1, k) for k in order_kinds], None, block.number, *block.ends())

        block = None
        for batch in batches:
            order_kinds = [batch.column(c).type for c in order]
            rest = batch.column("_rest").to_pylist()
            starts = [i for i, r in enumerate(rest) if not r]
            for lo, hi in zip([0, *starts], [*starts, len(rest)], strict=True):
                part = batch.slice(lo, hi - lo)
                if lo < hi and not rest[lo]:
                    if block is not None and block.state is not None:
                        yield end()
                    block = _Block(fold, part.column("_block")[0].as_py(), part.column("wanted")[0].as_py())
                    part = part.slice(1)
                if not part.num_rows:
                    continue
                verdicts = block.feed(_listed(part.column(_KEY)), [part.column(c) for c in (*order, *fold.columns)])
                yield made([part.column(c) for c in order], verdicts, block.number, False, *[None] * 6)
        if block is not None and block.state is not None:
            yield end()

    def run(targets, first, last):
        """Fold the blocks named in `targets` (_block, wanted), all from `first` to `last`."""
        given = targets.select("_block", "wanted", F.lit(False).alias("_rest"), F.lit("").alias(_KEY))
        chosen = ranged.filter(F.col("_block").between(first, last))
        if first < last:
            chosen = chosen.join(given.select("_block"), "_block", "left_semi")
        # Each block in a task of its own, what it was handed first. A single one needs no dealing.
        marked = given.unionByName(chosen.withColumn("_rest", F.lit(True)), allowMissingColumns=True)
        dealt = marked.coalesce(1) if first == last else marked.repartitionById(last - first + 1, (F.col("_block") - first).cast("int"))
        # Sorting is quick if the first column differs between rows.
        first_time = F.when(F.col("_rest"), F.coalesce(order[0], F.lit(2**63 - 1))).otherwise(F.lit(-(2**63)))
        places = [first_time, in_place[2]] if key is None else in_place
        folded = dealt.sortWithinPartitions(*places).mapInArrow(fold_blocks, fields)
        made = new_scratch(spark, "fold-run")
        # The rows are narrow, so a batch may hold more of them than one of texts.
        batch = spark.conf.get(_BATCH)
        spark.conf.set(_BATCH, "10000")
        try:
            folded.write.partitionBy("last").parquet(made)
        finally:
            spark.conf.set(_BATCH, batch)
        return spark.read.schema(folded.schema).parquet(made)

    def ends_of(number):
        """One row per block of a run, from a folder of its own next to the verdicts."""
        handed = runs[number].filter("last").select("_block", *names[5:])
        return handed.withColumn("_run", F.lit(number))

    reach = getattr(fold, "reach", None)
    none = F.lit(None).cast("string")
    if key is None and reach is None:
        runs = []
        for number in range(blocks):
            # An empty block hands nothing on; the block before it does.
            before = spark.range(1).select(F.lit(-1).cast("long").alias("_block"), none.alias("out_state"))
            for done in range(len(runs)):
                before = before.unionByName(ends_of(done).select("_block", "out_state"))
            wanted = before.agg(F.max_by("out_state", "_block").alias("wanted"))
            runs.append(run(wanted.select(F.lit(number).cast("long").alias("_block"), "wanted"), number, number))
        verdicts = functools.reduce(DataFrame.unionByName, [r.filter(~F.col("last")).select(*order, "verdict") for r in runs])
        return verdicts, runs
    runs = [run(spark.range(blocks).select(F.col("id").alias("_block"), none.alias("wanted")), 0, blocks - 1)]
    ends = ends_of(0)
    # From here on one row per block: the only orderings over all data.
    in_order = Window.orderBy("_block")
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = F.lit(True) if reach is None else F.coalesce(F.col("first_at") - F.lag("out_at").over(in_order) < reach, F.lit(True))
    while True:
        goes_on = F.coalesce((F.lag("out_key").over(in_order) == F.col("first_key")) & near, F.lit(False))
        chained = ends.withColumns({"_on": goes_on, "wanted": F.when(goes_on, F.lag("out_state").over(in_order))})
        chained = chained.withColumn("_chain", F.sum((~F.col("_on")).cast("long")).over(so_far))
        stale = chained.filter(~F.col("wanted").eqNullSafe(F.col("used")))
        first = stale.groupBy("_chain").agg(F.min_by(F.struct("_block", "wanted"), "_block").alias("b"))
        again = cut_lineage(first.select("b._block", "b.wanted"), "fold-again")
        lowest, highest = again.agg(F.min("_block"), F.max("_block")).first()
        if lowest is None:
            break
        runs.append(run(again, lowest, highest))
        settled = ends.join(again.select("_block"), "_block", "left_anti")
        ends = cut_lineage(settled.unionByName(ends_of(len(runs) - 1)), "fold-ends")
    # A block's verdicts are those of its latest run.
    verdicts = None
    for number, done in enumerate(runs):
        current = ends.filter(F.col("_run") == number).select("_block")
        part = done.filter(~F.col("last")).join(current, "_block", "left_semi").select(*order, "verdict")
        verdicts = part if verdicts is None else verdicts.unionByName(part)
    return verdicts, runs


# --- folds. A state that holds nothing any more is dumped as None. ------------------------------------


class KeyedQuota:
    """At most `limit` admitted per window and key; a refused row uses no budget."""

    columns: tuple[str, ...] = ()

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window = limit, window_ms
        self.reach = window_ms

    def start(self):
        return deque()

    def load(self, text):
        return deque(json.loads(text))

    def dump(self, state, now):
        live = [t for t in state if t > now - self.window]
        return json.dumps(live) if live else None

    def feed(self, state, now, _id):
        while state and state[0] <= now - self.window:
            state.popleft()
        if self.limit > 0 and len(state) >= self.limit:
            return False
        state.append(now)
        return True


class SharedQuota:
    """A cap per writer and one over all writers, taken together or not at all."""

    columns = ("writer_id",)

    def __init__(self, per_writer: int, overall: int, window_ms: int):
        self.per_writer, self.overall, self.window = per_writer, overall, window_ms
        self.reach = window_ms

    def start(self):
        return {"line": deque(), "by": {}}

    def load(self, text):
        state = self.start()
        for now, writer in json.loads(text):
            self._add(state, now, writer)
        return state

    def dump(self, state, now):
        live = [e for e in state["line"] if e[0] > now - self.window]
        return json.dumps(live) if live else None

    @staticmethod
    def _add(state, now, writer):
        state["line"].append((now, writer))
        state["by"][writer] = state["by"].get(writer, 0) + 1

    def feed(self, state, now, _id, writer):
        line, by = state["line"], state["by"]
        while line and line[0][0] <= now - self.window:
            gone = line.popleft()[1]
            by[gone] -= 1
            if not by[gone]:
                del by[gone]
        if 0 < self.overall <= len(line) or 0 < self.per_writer <= by.get(writer, 0):
            return False
        self._add(state, now, writer)
        return True


class DistinctQuota:
    """At most `limit` different identities per window and scope; repeats refresh their time."""

    columns = ("identity",)

    def __init__(self, limit: int, window_ms: int):
        self.limit, self.window = limit, window_ms
        self.reach = window_ms

    def start(self):
        return {}

    def load(self, text):
        return json.loads(text)

    def dump(self, state, now):
        live = {k: t for k, t in state.items() if t > now - self.window}
        return json.dumps(live, sort_keys=True) if live else None

    def feed(self, state, now, _id, identity):
        for name in [k for k, t in state.items() if t <= now - self.window]:
            del state[name]
        if 0 < self.limit <= len(state) and identity not in state:
            return False
        state[identity] = now
        return True


class Throttle:
    """One record per key and interval. The verdict is -1 for a suppressed record, else the number
    suppressed since the last one let through. Exempt records always pass and change nothing."""

    columns = ("exempt",)

    def __init__(self, interval_ms: int = 60_000):
        self.interval = interval_ms

    def start(self):
        return {"last": None, "held": 0}

    def load(self, text):
        return json.loads(text)

    def dump(self, state, now):
        over = state["last"] is None or not state["held"] and now - state["last"] >= self.interval
        return None if over else json.dumps(state, sort_keys=True)

    def feed(self, state, now, _id, exempt):
        if exempt:
            return 0
        if state["last"] is not None and now - state["last"] < self.interval:
            state["held"] += 1
            return -1
        held, state["last"], state["held"] = state["held"], now, 0
        return held


class HealthTransitions:
    """A state flips after two equal observations; a failure is reported again per kind and
    interval. The verdict is `failed`, `recovered` or null."""

    columns = ("ok", "error_kind")

    def __init__(self, interval_ms: int = 60_000):
        self.interval = interval_ms

    def start(self):
        return {"healthy": None, "candidate": None, "run": 0, "told": {}}

    def load(self, text):
        return json.loads(text)

    def dump(self, state, now):
        return json.dumps(state, sort_keys=True)

    def feed(self, state, now, _id, ok, kind):
        ok = bool(ok)
        state["run"] = state["run"] + 1 if state["candidate"] == ok else 1
        state["run"] = min(state["run"], 2)
        state["candidate"] = ok
        if state["run"] < 2:
            return None
        if ok:
            verdict = "recovered" if state["healthy"] is False else None
            state["healthy"] = True
            return verdict
        told = state["told"].get(kind)
        verdict = None
        if state["healthy"] is not False or told is None or now - told >= self.interval:
            state["told"][kind] = now
            verdict = "failed"
        state["healthy"] = False
        return verdict


@functools.lru_cache(65_536)
def _budgets(text: str) -> tuple[tuple[str, int], ...]:
    """(key, cap) of the budgets that bind, from their JSON; few texts recur over all rows."""
    return tuple((b["key"], b["cap"]) for b in json.loads(text) if b["cap"] > 0)


def _coded(column) -> tuple[np.ndarray, list]:
    """The number of each row's text among the different ones, and these."""
    coded = column.dictionary_encode(null_encoding="encode")
    return np.asarray(coded.indices), coded.dictionary.to_pylist()


class EvidenceAdmission:
    """Write budgets and capacity of the quarantine store in arrival order.

    The verdict is null for admitted evidence, else the refusal code. A budget stays spent when
    capacity refuses the item afterwards. What a row would be charged to, as a new item and as a known one, comes
    with it. Stored totals at the start are given once; what is
    on file for a row's identity comes with the row, later changes are kept in the state.
    """

    columns = ("match_key", "kind", "reason", "scope", "scope_pending", "family_scope", "family", "item_bytes",
               "old_status", "old_live", "old_bytes", "old_scope", "fresh_budgets", "known_budgets")

    def __init__(self, limits, pending: int, stored_bytes: int):
        self.limits, self.pending, self.bytes = limits, pending, stored_bytes

    def start(self):
        return {"times": {}, "families": {}, "items": {}, "scopes": {}, "pending": self.pending,
                "bytes": self.bytes}

    def load(self, text):
        state = json.loads(text)
        return {**state, "times": {k: deque(v) for k, v in state["times"].items()}}

    def dump(self, state, now):
        edge = now - self.limits.window_ms
        times = {k: [t for t in v if t > edge] for k, v in state["times"].items()}
        families = {k: {f: t for f, t in v.items() if t > edge} for k, v in state["families"].items()}
        return json.dumps({**state, "times": {k: v for k, v in times.items() if v},
                           "families": {k: v for k, v in families.items() if v}}, sort_keys=True)

    def _charge(self, state, now, known, reason, budgets, family_scope, family):
        edge = now - self.limits.window_ms
        for name, cap in budgets:
            line = state["times"].setdefault(name, deque())
            while line and line[0] <= edge:
                line.popleft()
            if len(line) >= cap:
                return False
        count_family = (family is not None and not known and reason != "auth_failed"
                        and self.limits.writes_per_writer > 0 and self.limits.families > 0)
        if count_family:
            seen = state["families"].setdefault(family_scope, {})
            if family not in seen or seen[family] <= edge:
                live = {f: t for f, t in seen.items() if t > edge}
                if len(live) >= self.limits.families:
                    return False
                state["families"][family_scope] = seen = live
            seen[family] = now
        for name, _ in budgets:
            state["times"][name].append(now)
        return True

    def feed(self, state, now, _id, match_key, kind, reason, scope, scope_pending, family_scope, family, item_bytes,
             old_status, old_live, old_bytes, old_scope, fresh_budgets, known_budgets):
        limits = self.limits
        if match_key in state["items"]:
            old_status, old_live, old_bytes, old_scope = state["items"][match_key]
        known = old_status is not None
        budgets = _budgets(known_budgets if known else fresh_budgets)
        if not self._charge(state, now, known, reason, budgets, family_scope, family):
            return "quarantine_rate_limited"
        request = kind in ("retain_request", "recall_request")
        if request and known and old_status not in ("pending", "postponed"):
            return "quarantine_request_in_review"
        if known and old_status.startswith("review_"):
            return "quarantine_item_in_review"
        waiting = bool(known and old_live and old_status in ("pending", "postponed"))
        freed = int(old_bytes or 0) if known and (old_live or old_status not in ("pending", "postponed")) else 0
        if (state["pending"] - waiting + 1 > limits.pending_items
                or state["bytes"] - freed + item_bytes > limits.encrypted_bytes):
            return "quarantine_capacity_exceeded"
        allowed = limits.writer_allowance
        if kind != "security_event" and allowed > 0:
            held = scope_pending + state["scopes"].get(scope, 0)
            same = waiting and old_scope == scope
            if held - same + 1 > allowed:
                return "quarantine_writer_capacity_exceeded"
        stays_closed = known and not waiting and old_status == "reviewed_blocked"
        now_open = not stays_closed
        state["pending"] += now_open - waiting
        state["bytes"] += item_bytes - freed
        if waiting:
            state["scopes"][old_scope] = state["scopes"].get(old_scope, 0) - 1
        if now_open:
            state["scopes"][scope] = state["scopes"].get(scope, 0) + 1
        status = old_status if stays_closed or waiting else "pending"
        state["items"][match_key] = [status, now_open, item_bytes, scope]
        return None

    def _full_until(self, state, budgets, now):
        """When the last of the full budgets has a place again; null if none is full."""
        until = None
        for name, cap in budgets:
            line = state["times"].get(name, ())
            while line and line[0] <= now - self.limits.window_ms:
                line.popleft()
            if len(line) >= cap:
                free = line[len(line) - cap] + self.limits.window_ms
                until = free if until is None else max(until, free)
        return until

    def feed_batch(self, state, times, columns):
        """What `feed` says of each row in turn. A refusal for full budgets changes nothing, so rows charged to the
        same budgets are passed over up to the moment when these have a place again."""
        named = dict(zip(("id", *self.columns), columns, strict=True))

        def fed(i):
            return self.feed(state, times[i], *(c[i].as_py() for c in columns))

        if times[-1] != times[-1]:
            return [fed(i) for i in range(len(times))]
        items = state["items"]
        keys = _listed(named["match_key"])
        known = np.asarray(named["old_status"].is_valid()) | np.fromiter(map(items.__contains__, keys), bool, len(keys))
        # Rows by the budgets they are charged to, in order; the next of each waits in a heap. Few texts recur.
        fresh_codes, fresh_texts = _coded(named["fresh_budgets"])
        known_codes, known_texts = _coded(named["known_budgets"])
        texts = list(dict.fromkeys([*fresh_texts, *known_texts]))
        number = {text: n for n, text in enumerate(texts)}
        codes = np.where(known, np.array([number[t] for t in known_texts])[known_codes], np.array([number[t] for t in fresh_texts])[fresh_codes])
        at = np.asarray(times)
        sorted_rows = np.argsort(codes, kind="stable")
        found, starts = np.unique(codes[sorted_rows], return_index=True)
        groups = {texts[n]: rows for n, rows in zip(found.tolist(), np.split(sorted_rows, starts[1:]), strict=True)}
        moments = {text: at[rows] for text, rows in groups.items()}
        waiting = [(int(rows[0]), text, 0) for text, rows in groups.items()]
        heapq.heapify(waiting)
        places, changed = None, set()
        verdicts = ["quarantine_rate_limited"] * len(times)
        while waiting:
            i, text, spot = heapq.heappop(waiting)
            # A place of None: a row whose identity came on file within the batch.
            until = None
            if spot is None or i not in changed:
                until = self._full_until(state, _budgets(text), times[i])
                if until is None:
                    verdicts[i] = fed(i)
                    if not known[i] and keys[i] in items and i not in changed:
                        if places is None:
                            places = defaultdict(list)
                            for j in np.flatnonzero(~known).tolist():
                                places[keys[j]].append(j)
                        for j in places[keys[i]]:
                            if j > i and j not in changed:
                                changed.add(j)
                                heapq.heappush(waiting, (j, known_texts[known_codes[j]], None))
            if spot is None:
                continue
            spot = spot + 1 if until is None else max(spot + 1, int(np.searchsorted(moments[text], until)))
            if spot < len(groups[text]):
                heapq.heappush(waiting, (int(groups[text][spot]), text, spot))
        return verdicts
