"""Ranked lexical search the other way round: the index is over the items, the documents stream by.

The items' terms make an inverted index of bounded size that goes to every task. A first pass counts, for
the terms of the index, the documents that hold them, and the terms of all documents. In the second pass
each document's term counts run through the postings, and every item that the document reaches
offers it to the item's heap of the k best. Heaps are merged by groups of tasks, then over all groups.

Texts never move. Items beyond the bound of one index go in further blocks, each with two passes of its
own; every document is read by every block.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memgov.session import cut_lineage

POSTINGS = 1 << 18  # terms of items in one index, about; one item is never split
HEAPS = 64  # groups in which the tasks' heaps are merged first
NO_ID = 2**63 - 1  # a null doc_id: after all others
DOCUMENTS, TERMS = -1, -2  # in place of a term: documents with terms, terms of all documents
FOUND = "item int, item_id long, doc_id long, score long"
_TERM_BYTES = {*b"0123456789", *b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", *b"abcdefghijklmnopqrstuvwxyz", *range(128, 256)}
# Letters in lower case, all other ASCII as a space.
_FOLD = bytes(b | 32 if 65 <= b <= 90 else b if b in _TERM_BYTES else 32 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    """Runs of ASCII letters, digits and all other code points beyond ASCII; only A to Z are lower-cased."""
    return text.encode().translate(_FOLD).split()


class Index:
    """term -> the numbers of the items that hold it."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]]):
        self.item_ids = [item_id for item_id, _ in items]
        holders: dict[bytes, list[int]] = {}
        for number, (_, terms) in enumerate(items):
            for term in set(terms):
                holders.setdefault(term, []).append(number)
        self.number = {term: i for i, term in enumerate(holders)}
        self.start = np.cumsum([0, *(len(h) for h in holders.values())])
        self.items = np.array([i for h in holders.values() for i in h], np.int32)


def _documents(batches):
    for batch in batches:
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            terms = terms_of(text.as_py() or "")
            if terms:
                yield doc_id, terms


def statistics(docs: DataFrame, index) -> dict[int, int]:
    """Documents per term of the broadcast index, and DOCUMENTS and TERMS: bounded by the index."""

    def count(batches):
        number = index.value.number
        holding = np.zeros(len(number) + 1, np.int64)
        seen = total = 0
        for _, terms in _documents(batches):
            seen, total = seen + 1, total + len(terms)
            held = set(map(number.get, terms))
            held.discard(None)
            holding[list(held)] += 1
        held = np.flatnonzero(holding)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*held.tolist(), DOCUMENTS, TERMS], pa.int32()), pa.array([*holding[held].tolist(), seen, total], pa.int64())],
            ["term", "n"])

    rows = docs.mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {r["term"]: r["n"] for r in rows}


class Heaps:
    """The k best documents of each item of an index: highest score, then smallest id."""

    def __init__(self, items: int, k: int):
        self.k = k
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a score below this changes nothing

    def offer(self, scores: np.ndarray, doc_id: int) -> None:
        for item in np.flatnonzero(scores >= self.least).tolist():
            heap, entry = self.best[item], (int(scores[item]), -doc_id)
            if len(heap) < self.k:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.k:
                self.least[item] = heap[0][0]


def _search(docs: DataFrame, index, weights, documents: int, terms_total: int, k: int) -> DataFrame:
    def stream(batches):
        held = index.value
        weight = weights.value
        scores = np.zeros(len(held.item_ids), np.int64)
        heaps = Heaps(len(scores), k)
        for doc_id, terms in _documents(batches):
            counts = Counter(map(held.number.get, terms))
            counts.pop(None, None)
            if not counts:
                continue
            term = np.fromiter(counts.keys(), np.int64, len(counts))
            tf = np.fromiter(counts.values(), np.int64, len(counts))
            m = 100 - 90 + (90 * len(terms) * documents) // terms_total
            worth = weight[term] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))
            long = held.start[term + 1] - held.start[term]
            at = np.arange(long.sum()) + np.repeat(held.start[term] - (np.cumsum(long) - long), long)
            scores[:] = 0
            np.add.at(scores, held.items[at], np.repeat(worth, long))
            heaps.offer(scores, NO_ID if doc_id is None else doc_id)
        rows = [(item, held.item_ids[item], None if -doc == NO_ID else -doc, score)
                for item, heap in enumerate(heaps.best) for score, doc in heap]
        for at in range(0, len(rows), 10_000):
            some = list(zip(*rows[at:at + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(some[0], pa.int32()), *(pa.array(column, pa.int64()) for column in some[1:])],
                ["item", "item_id", "doc_id", "score"])

    found = docs.mapInArrow(stream, FOUND)
    ahead = (F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    some = found.withColumn("_heap", F.pmod(F.spark_partition_id(), F.lit(HEAPS)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "_heap").orderBy(*ahead))).filter(F.col("rank") <= k)
    return (some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*ahead))).filter(F.col("rank") <= k)
            .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


def best_documents(docs: DataFrame, items: DataFrame, k: int = 10, postings: int = POSTINGS) -> DataFrame:
    """The k highest-scoring documents of each item: item_id, rank, doc_id, score.

    Every row of docs is a document, rows that repeat others too; equal scores go by ascending doc_id, a
    null one last. Null texts and texts without a term take no part. Rows of items that repeat both item_id
    and text are one item; rows of one item_id (or none) with different texts are items of their own. Items
    that no document reaches with a score above 0 have no rows.
    """
    spark = docs.sparkSession

    def cut(batches):
        for batch in batches:
            found = [(i, sorted(set(terms_of(t)))) for i, t in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True)]
            found = [(i, terms) for i, terms in found if terms]
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([t for _, t in found], pa.list_(pa.binary()))],
                                             ["item_id", "terms"])

    asked = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).dropna(subset="text").distinct()
    asked = cut_lineage(asked.mapInArrow(cut, "item_id long, terms array<binary>").withColumn("spot", F.xxhash64("item_id", "terms")), "items")
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, math.ceil(total / postings))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = []
    for number in range(blocks):
        # About `postings` terms come to the driver.
        rows = asked.filter(F.pmod("spot", F.lit(blocks)) == number).select("item_id", "terms").collect()
        held = Index([(r["item_id"], [bytes(t) for t in r["terms"]]) for r in rows])
        index = spark.sparkContext.broadcast(held)
        counts = statistics(texts, index)
        documents, terms_total = counts.get(DOCUMENTS, 0), counts.get(TERMS, 0)
        weights = np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * counts.get(t, 0) + 1))) for t in range(len(held.number))], np.int64)
        one = _search(texts, index, spark.sparkContext.broadcast(weights), documents, terms_total, k)
        found.append(cut_lineage(one, "best") if blocks > 1 else one)
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out
