"""Structured Streaming: the same operators over request and log streams."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memgov.operators import ordered_fold as folds
from memgov.operators.policy import decide_recall, decide_retain, quarantine_candidates
from memgov.operators.quarantine import merge_candidates
from memgov.operators.review import Reviewed, prune_events, recover_stale, sweep_expired
from memgov.session import let_shuffles_go, remove_folder
from memgov.sources.tables import load_items, save_items

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# State larger than memory lives in RocksDB. Empty micro-batches are off, because a query with
# processing-time expiry would otherwise run them for ever and never reach the end of its input.
STATE_SETTINGS = {
    "spark.sql.streaming.stateStore.providerClass": ROCKSDB,
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


@contextmanager
def _settings(spark, values: dict[str, str]):
    """Session settings for the start of one query, which keeps its own copy of them."""
    before = {name: spark.conf.get(name, None) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)


# Idle state is dropped by the wall clock, so this must exceed any delay of the stream behind its
# events; what a decision sees is bounded by the window itself.
IDLE_MS = 7 * 24 * 3_600_000


class FoldProcessor(StatefulProcessor):
    """Runs one of the ordered folds per key, with its state kept between micro-batches.

    Rows of a micro-batch are taken in (time, id) order; the batch size bounds what a key brings.
    State untouched for `ttl_ms` of processing time is dropped.
    """

    def __init__(self, fold, ttl_ms: int, columns: list[str]):
        self.fold, self.ttl_ms, self.columns = fold, ttl_ms, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("fold", "value string", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(["ts_ms", "request_id"], kind="stable")
        state = self.fold.load(self.state.get()[0]) if self.state.exists() else self.fold.start()
        used = [pdf[c].tolist() for c in ("ts_ms", "request_id", *self.fold.columns)]
        verdicts = [self.fold.feed(state, *row) for row in zip(*used)]
        left = self.fold.dump(state, used[0][-1])
        if left is None:
            self.state.clear()
        else:
            self.state.update((left,))
        yield pdf[self.columns].assign(verdict=pd.Series(verdicts, index=pdf.index, dtype=object))

    def close(self) -> None:
        pass


# Waiting rows of a key up to this many are one value of its state; beyond it they lie in slices of time.
TOGETHER = 2_000


class OrderedFoldProcessor(StatefulProcessor):
    """Runs one of the ordered folds per key in event time, however rows are spread over micro-batches.

    Rows wait in state until the watermark has passed the end of their slice of time; a timer there feeds them
    in (time, id) order. Each call to the state store costs a round trip, so a key with few waiting rows keeps
    them in one value; when they are more than `TOGETHER`, they go to a map by slice.
    So that many and one slice of a key are the most that is held at once. What the fold keeps goes by a timer as
    well, `hold_ms` of event time after the key's last row, once it cannot change a verdict.
    """

    def __init__(self, fold, slice_ms: int, hold_ms: int, columns: list[str], together: int = TOGETHER):
        self.fold, self.slice_ms, self.hold_ms, self.columns, self.together = fold, slice_ms, hold_ms, columns, together
        self.order = [columns.index("ts_ms"), columns.index("request_id")]
        self.given = [columns.index(c) for c in fold.columns]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "value string")
        # The rows that wait together, parts written to slices so far, whether some still lie there, and the
        # earliest slice with a timer: a key has one at a time.
        self.waiting = handle.getValueState("waiting", "rows string, parts long, sliced boolean, first long")
        self.slices = handle.getMapState("slices", "slot long, part long", "rows string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        few, part, sliced, first = self._waiting()
        before = first
        for pdf in rows:
            columns = [pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in self.columns]
            few += map(list, zip(*columns, strict=True))
            slot = int(pdf["ts_ms"].min()) // self.slice_ms
            first = slot if first is None else min(first, slot)
            if len(few) > self.together:
                for slot, some in self._by_slot(few).items():
                    self.slices.updateValue((slot, part), (json.dumps(some),))
                    part += 1
                few, sliced = [], True
        if first != before:
            self.handle.registerTimer(self._end(first))
        self.waiting.update((json.dumps(few), part, sliced, first))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        edge = timerValues.getCurrentWatermarkInMs()
        few, part, sliced, first = self._waiting()
        kept = self.state.get()
        together = self._by_slot(few)
        parts = sorted(tuple(k) for k in self.slices.keys()) if sliced else []
        slots = sorted({*together, *(k[0] for k in parts)})
        due = [slot for slot in slots if self._end(slot) <= edge]
        state = self.fold.load(kept[0]) if kept is not None else self.fold.start()
        last, out = None, []
        for slot in due:
            rows = together.pop(slot, [])
            for k in (k for k in parts if k[0] == slot):
                rows += json.loads(self.slices.getValue(k)[0])
                self.slices.removeKey(k)
            rows.sort(key=lambda r: [r[i] for i in self.order])
            out += [[*r, self.fold.feed(state, *(r[i] for i in (*self.order, *self.given)))] for r in rows]
            last = rows[-1][self.order[0]]
            if len(out) >= self.together:
                yield self._frame(out)
                out = []
        if out:
            yield self._frame(out)
        # No row before this moment is still to come.
        to_come = slots[len(due):]
        settled = min([edge, *(slot * self.slice_ms - 1 for slot in to_come)])
        left = self.fold.dump(state, settled if last is None else max(last, settled))
        if left is not None:
            self.state.update((left,))
            if last is not None:
                self.handle.registerTimer(last + self.hold_ms)
        elif kept is not None:
            self.state.clear()
        if not due:
            return
        if not to_come:
            self.waiting.clear()
            return
        self.handle.registerTimer(self._end(to_come[0]))
        few = [row for slot in sorted(together) for row in together[slot]]
        still = any(k[0] in to_come for k in parts)
        self.waiting.update((json.dumps(few), part, still, to_come[0]))

    def _waiting(self):
        held = self.waiting.get()
        return ([], 0, False, None) if held is None else (json.loads(held[0]), *held[1:])

    def _by_slot(self, rows: list[list]) -> dict[int, list[list]]:
        slots: dict[int, list[list]] = {}
        for row in rows:
            slots.setdefault(row[self.order[0]] // self.slice_ms, []).append(row)
        return slots

    def _frame(self, rows: list[list]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=[*self.columns, "verdict"], dtype=object)

    def _end(self, slot: int) -> int:
        return (slot + 1) * self.slice_ms - 1

    def close(self) -> None:
        pass


def _fold_stream(rows: DataFrame, key: str, fold, verdict: str, hold_ms: int, delay: str | None) -> DataFrame:
    """Verdicts of a fold. Without `delay` rows are decided as they arrive, in order within a micro-batch;
    with it in event-time order, once the watermark, `delay` behind the latest row, has passed them."""
    columns = list(dict.fromkeys([key, "request_id", "ts_ms", *fold.columns]))
    types = dict(rows.dtypes)
    schema = ", ".join(f"`{c}` {types[c]}" for c in columns) + f", verdict {verdict}"
    if delay is None:
        processor = FoldProcessor(fold, max(IDLE_MS, 2 * hold_ms), columns)
        return rows.select(*columns).groupBy(key).transformWithStateInPandas(processor, schema, "append", "ProcessingTime")
    processor = OrderedFoldProcessor(fold, max(1, hold_ms // 4), hold_ms, columns)
    timed = rows.select(*columns, F.timestamp_millis("ts_ms").alias("_at")).filter("_at is not null")
    return timed.withWatermark("_at", delay).groupBy(key).transformWithStateInPandas(processor, schema, "append", "EventTime")


def stream_quota(requests: DataFrame, per_writer: int, window_ms: int, delay: str | None = None) -> DataFrame:
    """Per-writer admission of a stream. The overall cap is one key by nature: see `stream_overall`.

    With `delay` the verdicts are those of the batch operator over all rows that come no later than the delay
    behind the latest; rows later than that, or without a time, have no verdict (`stream_on_time` keeps them).
    """
    fold = folds.KeyedQuota(per_writer, window_ms)
    return _fold_stream(requests, "writer_id", fold, "boolean", window_ms, delay)


def stream_overall(requests: DataFrame, overall: int, per_writer: int, window_ms: int, delay: str | None = None) -> DataFrame:
    """Both caps in one serial stage; all writers share one key. `delay` as in `stream_quota`."""
    fold = folds.SharedQuota(per_writer, overall, window_ms)
    return _fold_stream(requests.withColumn("_all", F.lit("all")), "_all", fold, "boolean", window_ms, delay)


def stream_throttle(events: DataFrame, key: Column, exempt: Column, interval_ms: int = 60_000,
                    delay: str | None = None) -> DataFrame:
    """Log records let through, with the number held back before each. `delay` as in `stream_quota`."""
    marked = events.withColumn("throttle_key", key).withColumn("exempt", exempt)
    out = _fold_stream(marked, "throttle_key", folds.Throttle(interval_ms), "long", interval_ms, delay)
    return out.filter("verdict >= 0").withColumnRenamed("verdict", "suppressed").drop("exempt")


def stream_dedupe(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """First row per key; repeats within the delay are dropped, state is bounded by it."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def write_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
               settle: bool = False) -> StreamingQuery:
    """Process what is there and stop. With `settle` a last batch without rows runs the event-time timers
    that the rows of this run made due."""
    settings = {**STATE_SETTINGS, "spark.sql.streaming.noDataMicroBatches.enabled": str(settle).lower()}
    with _settings(stream.sparkSession, settings):
        return (
            stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
            .outputMode(mode).trigger(availableNow=True).start()
        )


def stream_gate(requests: DataFrame, writers: DataFrame, allowed_path: str, refused_path: str,
                checkpoint: str, candidates_path: str | None = None, at: str = "at",
                trigger: dict | None = None) -> StreamingQuery:
    """Requests split into allowed and refused folders, one sub-folder per micro-batch, so that a
    replayed batch overwrites its own output. Every request comes out: bodies that were refused on
    reading and operations that are none are invalid, with an error_code. With `candidates_path` the
    evidence of quarantined requests is written as well, at the time in `at`."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        other = batch.filter("op is null or op not in ('recall', 'retain')").withColumn("refusal", F.lit("unsupported_operation"))
        # Decided once, with their evidence; every output reads the rows kept here.
        reads = decide_recall(batch.filter("op = 'recall'"), writers).persist(StorageLevel.DISK_ONLY)
        writes = decide_retain(batch.filter("op = 'retain'"), writers).persist(StorageLevel.DISK_ONLY)
        columns = ["request_id", "writer_id", "op", "decision", "reason", "error_code", "target_bank", "findings"]
        decided = writes.select(*columns)
        for frame in (reads, decide_retain(other, writers)):
            decided = decided.unionByName(frame.select(*columns))
        try:
            part = f"batch={batch_id:012d}"
            passed = F.col("decision").isin("allowed", "fan_out")
            decided.filter(passed).write.mode("overwrite").parquet(f"{allowed_path}/{part}")
            decided.filter(~passed).write.mode("overwrite").parquet(f"{refused_path}/{part}")
            if candidates_path is not None:
                kept = ["kind", "dedupe_key", "quarantine_id", "request_id", "writer_id", "target_bank", "reason", "payload", at]
                rows = [quarantine_candidates(f, kind, at).select(*kept)
                        for f, kind in ((writes, "retain_request"), (reads, "recall_request"))]
                rows[0].unionByName(rows[1]).write.mode("overwrite").parquet(f"{candidates_path}/{part}")
        finally:
            reads.unpersist()
            writes.unpersist()

    return (
        requests.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_quarantine(candidates: DataFrame, root: str, checkpoint: str, ttl_days: int = 30,
                      at: Column | None = None, trigger: dict | None = None, keep_versions: bool = True) -> StreamingQuery:
    """Merge each micro-batch into the item table. Batch n reads version n and writes n + 1, and
    its events and conflicts go to folders of their own, so a replay repeats instead of adding. Expiry is
    judged at `at`, or at the latest time in the batch. Without `keep_versions` batch n removes version n - 1, which
    no replay reads any more, since the batch before it is committed."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        if batch_id and not keep_versions:
            remove_folder(spark, f"{root}/items/version={batch_id - 1:012d}")
        items = load_items(spark, f"{root}/items/version={batch_id:012d}", placed=True)
        latest = batch.agg(F.max("at")).first()[0]
        if latest is None:
            save_items(items, f"{root}/items/version={batch_id + 1:012d}")
            return
        moment = F.lit(latest) if at is None else at
        merged = merge_candidates(items, batch, moment, f"stream-{batch_id}", ttl_days, f"{root}/actions")
        let_shuffles_go(spark)
        save_items(merged.items, f"{root}/items/version={batch_id + 1:012d}")
        let_shuffles_go(spark)
        merged.events.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/events/batch={batch_id:012d}")
        let_shuffles_go(spark)
        merged.conflicts.write.mode("overwrite").option("compression", "zstd").parquet(f"{root}/conflicts/batch={batch_id:012d}")

    return (
        candidates.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def stream_on_time(rows: DataFrame, time: str, delay_seconds: int, root: str, checkpoint: str,
                   trigger: dict | None = None) -> StreamingQuery:
    """Rows in time and late rows of a stream, in the folders on_time and late. A row is late if its time lies
    more than the delay before the latest time of earlier micro-batches; that edge is kept per batch next to
    them, so that a replayed batch splits as it did before."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        spark, part = batch.sparkSession, f"batch={batch_id:012d}"
        seen = spark.createDataFrame([], "batch long, latest timestamp")
        if batch_id:
            seen = spark.read.parquet(f"{root}/seen").select("batch", "latest")
        latest = seen.filter(F.col("batch") < batch_id).agg(F.max("latest")).first()[0]
        batch = batch.persist()
        try:
            on_time, late = split_late(batch, time, F.lit(latest).cast("timestamp"), delay_seconds)
            on_time.write.mode("overwrite").parquet(f"{root}/on_time/{part}")
            late.write.mode("overwrite").parquet(f"{root}/late/{part}")
            (batch.agg(F.max(time).cast("timestamp").alias("latest"))
             .write.mode("overwrite").parquet(f"{root}/seen/{part}"))
        finally:
            batch.unpersist()

    return (
        rows.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True})).start()
    )


def run_maintenance(items: DataFrame, events: DataFrame, at: Column, batch_id: str,
                    stale_seconds: int = 60, retention_days: int = 90) -> Reviewed:
    """Recover abandoned claims, sweep expired items, prune old events: the periodic job."""
    recovered = recover_stale(items, at, batch_id + ":recover", stale_seconds)
    swept = sweep_expired(recovered.items, at, batch_id + ":sweep")
    all_events = events.unionByName(recovered.events).unionByName(swept.events)
    if retention_days > 0:
        cutoff = at - F.make_dt_interval(F.lit(retention_days))
        all_events = prune_events(all_events, cutoff, at, batch_id + ":prune")
    return Reviewed(swept.items, all_events, swept.errors)


def split_late(batch: DataFrame, time: str, seen_until: Column, delay_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(on time, late) rows against the latest time seen before this batch."""
    edge = seen_until - F.make_dt_interval(secs=F.lit(delay_seconds))
    late = F.coalesce(F.col(time) < edge, F.lit(False))
    return batch.filter(~late), batch.filter(late)

