"""Exact top-k inner products by best-first search in M-trees.

Vectors become integers; one more coordinate lifts all of them to the same length, so that the largest
inner product with a query is the smallest distance to it. The vectors are dealt to shards by the
nearest of a bounded number of pivots, a crowded pivot to several, and each shard gets an M-tree of
bounded size: pages of entries with a routing object, its covering radius and the distance to the
routing object of the page above. Queries go to the shards in blocks. A search keeps the best pages
in a queue, uses the stored distances to leave out entries before their distance is computed, and ends
when no page can hold anything better than the k-th result. A bounded sample of the vectors gives each
query its first bound.
"""

from __future__ import annotations

import heapq
import io
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memgov.session import cut_lineage

SCALE = 64
SHARD = 8192  # vectors in a tree, about
PIVOTS = 1024  # at most; crowded pivots are split
SAMPLE = 2048  # vectors that give queries their first bound, at most
LEAF = 512
FAN = 16
BLOCK = 256  # queries searched together, about
BATCH_ROWS = 4  # a row holds a whole tree and a block of queries
NO_ID = 2**63 - 1  # a null id: after all others
_EXACT = 2.0 ** 53


def pack(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def unpack(data: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(data)) as file:
        return {k: file[k] for k in file.files}


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer inner products of rows of a with rows of b: in floating point where that is exact."""
    if a.size and b.size and float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[-1] < _EXACT:
        return np.rint(a.astype(float) @ b.T.astype(float)).astype(np.int64)
    return a @ b.T


class MTree:
    """Nodes in arrays. Inner nodes list children, leaves list entries; both know their parent distance."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, rows: np.ndarray, longest: float, **built):
        self.vectors, self.ids, self.rows, self.longest = vectors, ids, rows, longest
        self.real = vectors.astype(float)
        self.lift = np.sqrt(np.maximum(longest - (self.real ** 2).sum(1), 0))
        if built:
            self.__dict__.update(built)
            self.settle()
            return
        self.order, self.entry_distance = [], []
        self.routing, self.radius, self.above, self.first, self.last, self.leaf = [], [], [], [], [], []
        # Level by level, so that children of a node are numbered in a row.
        waiting = [(self._centre(np.arange(len(vectors))), np.arange(len(vectors)), 0.0)]
        number, spots = 1, 0
        while waiting:
            following = []
            for routing, members, above in waiting:
                away = self._distance(routing, members)
                self.routing.append(routing)
                self.radius.append(float(away.max()))
                self.above.append(above)
                if len(members) <= LEAF:
                    self.leaf.append(True)
                    self.first.append(spots)
                    spots += len(members)
                    self.last.append(spots)
                    self.order.append(members)
                    self.entry_distance.append(away)
                else:
                    parts = self._split(members)
                    self.leaf.append(False)
                    self.first.append(number)
                    number += len(parts)
                    self.last.append(number)
                    for part in parts:
                        centre = self._centre(part)
                        following.append((centre, part, float(self._distance(centre, np.array([routing]))[0])))
            waiting = following
        self.order, self.entry_distance = np.concatenate(self.order), np.concatenate(self.entry_distance)
        for name in ("routing", "radius", "above", "first", "last", "leaf"):
            setattr(self, name, np.array(getattr(self, name)))
        self.settle()

    def _distance(self, one: int, many: np.ndarray) -> np.ndarray:
        square = ((self.real[many] - self.real[one]) ** 2).sum(1) + (self.lift[many] - self.lift[one]) ** 2
        return np.sqrt(square)

    def _centre(self, members: np.ndarray) -> int:
        middle = self.real[members].mean(0)
        return int(members[np.argmin(((self.real[members] - middle) ** 2).sum(1))])

    def _split(self, members: np.ndarray) -> list[np.ndarray]:
        """Up to FAN parts around members that lie far from each other; equal parts where that fails."""
        seeds, near = [members[0]], self._distance(members[0], members)
        owner = np.zeros(len(members), np.int64)
        for k in range(1, min(FAN, max(2, math.ceil(len(members) / LEAF * 1.5)))):
            seed = members[int(np.argmax(near))]
            away = self._distance(seed, members)
            owner[away < near] = k
            near = np.minimum(near, away)
            seeds.append(seed)
        parts = [members[owner == k] for k in range(len(seeds))]
        parts = [p for p in parts if len(p)]
        if max(map(len, parts)) > 0.9 * len(members):
            parts = np.array_split(members, min(FAN, math.ceil(len(members) / LEAF)))
        return parts

    def dump(self) -> bytes:
        return pack(vectors=self.vectors, ids=self.ids, rows=self.rows, longest=np.array(self.longest), order=self.order,
                    entry_distance=self.entry_distance, routing=self.routing, radius=self.radius, above=self.above,
                    first=self.first, last=self.last, leaf=self.leaf)

    @classmethod
    def load(cls, data: bytes) -> MTree:
        parts = unpack(data)
        return cls(parts.pop("vectors"), parts.pop("ids"), parts.pop("rows"), float(parts.pop("longest")), **parts)

    def settle(self) -> None:
        """Lay the entries out in the order of the leaves, in the narrowest type whose sums are exact."""
        top = float(np.abs(self.vectors).max()) if self.vectors.size else 0.0
        whole = top * top * self.vectors.shape[1]
        kind = np.float32 if whole < 2.0 ** 24 else np.float64 if whole < _EXACT else np.int64
        self.entries, self.largest = self.vectors[self.order].astype(kind), top
        self.entry_ids, self.entry_rows = self.ids[self.order], self.rows[self.order]
        self.centres = self.real[self.routing]

    def search(self, query: np.ndarray, own_row: int, k: int, bound: float) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the best k entries with a score of `bound` or more, the query's own row left out."""
        real = query.astype(float)
        level = float(real @ real) + self.longest  # squared distance = level - 2 * inner product
        slack = 1e-9 * (level + 1)
        exact = float(np.abs(query).max(initial=0)) <= self.largest
        own, entries = (query.astype(self.entries.dtype), self.entries) if exact else (query, self.entries.astype(np.int64))
        scores, ids = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def reach(lower):
            """The largest score at a distance of `lower` or more."""
            return (level - np.maximum(lower, 0) ** 2) / 2 + slack

        away = math.sqrt(max(level - 2 * float(self.centres[0] @ real), 0))
        queue = [(-float(reach(away - self.radius[0])), 0, away)]
        while queue:
            best, node, away = heapq.heappop(queue)
            if -best < bound:
                break
            first, last = self.first[node], self.last[node]
            if self.leaf[node]:
                hope = reach(np.abs(away - self.entry_distance[first:last])) >= bound
                here = np.arange(first, last)[hope] if not hope.all() else slice(first, last)
                got = entries[here] @ own
                keep = np.flatnonzero(got >= bound)
                if not len(keep):
                    continue
                keep = keep[self.entry_rows[here][keep] != own_row]
                scores = np.concatenate([scores, got[keep].astype(np.int64)])
                ids = np.concatenate([ids, self.entry_ids[here][keep]])
                if len(scores) > k:
                    top = np.lexsort((ids, -scores))[:k]
                    scores, ids = scores[top], ids[top]
                if len(scores) >= k:
                    bound = max(bound, float(scores.min()))
            else:
                children = np.arange(first, last)
                children = children[reach(np.abs(away - self.above[first:last]) - self.radius[first:last]) >= bound]
                if not len(children):
                    continue
                each = np.sqrt(np.maximum(level - 2 * (self.centres[children] @ real), 0))
                for child, far, hope in zip(children.tolist(), each.tolist(), reach(each - self.radius[children]).tolist(), strict=True):
                    if hope >= bound:
                        heapq.heappush(queue, (-hope, child, far))
        return scores, ids


def as_matrix(components: pd.Series, width: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    out = np.zeros((len(components), width), np.int64)
    for i, row in enumerate(components):
        out[i, :len(row)] = row
    return out


def narrow(vectors: np.ndarray) -> np.ndarray:
    top = int(np.abs(vectors).max()) if vectors.size else 0
    return vectors.astype(np.int16 if top < 2 ** 15 else np.int64)


def whole_numbers(embeddings: DataFrame) -> DataFrame:
    """vec_id and parts, floor(64 * x) of each component; only vectors without nulls and with finite ones."""
    x = F.col("embedding")
    finite = F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return (embeddings.filter(x.isNotNull() & finite)
            .select(F.col("vec_id").cast("long"), F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c.cast("double")).cast("long")).alias("parts")))


def top_products(embeddings: DataFrame, every: int = 20, k: int = 20) -> DataFrame:
    """The k best inner products of each query: query_id, rank, vec_id, score.

    Queries are the rows whose vec_id is divisible by `every`; candidates are all other rows, rows with
    the same vec_id or an equal vector included. Vectors that are null or hold null or non-finite components take no
    part. Scores have to fit a long. Of vectors of unequal lengths the shorter count as filled up with zeros. Ties go to the
    smaller vec_id, a null vec_id comes last. Fewer candidates than k give fewer rows.
    """
    spark = embeddings.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    asks = F.coalesce(F.col("vec_id") % every == 0, F.lit(False))
    made = cut_lineage(whole_numbers(embeddings).select(
        F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "parts", asks.alias("asks"),
        F.monotonically_increasing_id().alias("row")), "vectors")
    square = F.aggregate("parts", F.lit(0.0), lambda a, b: a + b.cast("double") * b.cast("double"))
    total = made.agg(F.count(F.lit(1)), F.max(square), F.max(F.size("parts"))).first()
    count, longest, width = total[0], float(total[1] or 0), max(total[2] or 0, 1)
    # At most SAMPLE rows come to the driver.
    sample = as_matrix(pd.Series([r[0] for r in made.orderBy(F.xxhash64("row"), "row").select("parts").limit(SAMPLE).collect()]), width)
    sample_rows = sample.astype(float)
    pivots = sample_rows[:min(PIVOTS, max(1, math.ceil(count / SHARD)))]
    pivot_lift = np.sqrt(np.maximum(longest - (pivots ** 2).sum(1), 0))

    def nearest(parts: pd.Series) -> pd.Series:
        own = as_matrix(parts, width).astype(float)
        squares = (own ** 2).sum(1)
        lift = np.sqrt(np.maximum(longest - squares, 0))
        away = squares[:, None] + (pivots ** 2).sum(1) - 2 * own @ pivots.T + (lift[:, None] - pivot_lift) ** 2
        return pd.Series(away.argmin(1).astype(np.int32))

    if not count:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dealt = cut_lineage(made.withColumn("pivot", F.pandas_udf(nearest, "int")("parts")), "dealt")
    sizes, shards, blocks = [], 0, 0
    for r in dealt.groupBy("pivot").agg(F.count(F.lit(1)).alias("n"), F.count_if("asks").alias("q")).orderBy("pivot").collect():
        many, groups = math.ceil(r["n"] / SHARD), math.ceil(r["q"] / BLOCK)
        sizes.append((r["pivot"], many, shards, max(groups, 1), blocks))
        shards, blocks = shards + many, blocks + groups
    plan = F.broadcast(spark.createDataFrame(sizes, "pivot int, many int, shard_base int, groups int, block_base int"))  # PIVOTS rows at most
    spread = F.xxhash64("row", F.lit("spread"))
    placed = dealt.join(plan, "pivot").select(
        "vec_id", "row", "parts", "asks", (F.col("shard_base") + F.pmod(spread, "many")).cast("int").alias("shard"),
        (F.col("block_base") + F.pmod(spread, "groups")).cast("int").alias("block"))

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = narrow(as_matrix(frame["parts"], width))
        return pd.DataFrame({"shard": [int(frame["shard"].iloc[0])], "tree": [MTree(vectors, frame["vec_id"].to_numpy(np.int64), frame["row"].to_numpy(np.int64), longest).dump()]})

    def block(frame: pd.DataFrame) -> pd.DataFrame:
        vectors = as_matrix(frame["parts"], width)
        known = products(vectors, sample)
        # The query itself may be in the sample, so one more is looked at.
        bound = np.partition(known, -(k + 1), axis=1)[:, -(k + 1)].astype(float) if len(sample) > k else np.full(len(vectors), -np.inf)
        return pd.DataFrame({"queries": [pack(vectors=narrow(vectors), ids=frame["vec_id"].to_numpy(np.int64),
                                              rows=frame["row"].to_numpy(np.int64), bound=bound)]})

    trees = cut_lineage(placed.groupBy("shard").applyInPandas(build, "shard int, tree binary"), "trees")
    asked = (placed.filter("asks").groupBy("block").applyInPandas(block, "queries binary")
             .select("queries", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")))

    def search(batches):
        at, tree = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for shard, data, queries in zip(*(batch.column(c) for c in ("shard", "tree", "queries")), strict=True):
                if shard.as_py() != at:
                    at, tree = shard.as_py(), MTree.load(data.as_py())
                q = unpack(queries.as_py())
                for vector, query_id, row, bound in zip(q["vectors"].astype(np.int64), q["ids"].tolist(), q["rows"].tolist(), q["bound"].tolist(), strict=True):
                    scores, ids = tree.search(vector, row, k, bound)
                    out[0].append(np.full(len(ids), query_id, np.int64))
                    out[1].append(np.full(len(ids), row, np.int64))
                    out[2].append(ids)
                    out[3].append(scores)
            columns = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in out]
            yield pa.RecordBatch.from_arrays(
                [pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2], mask=columns[2] == NO_ID), pa.array(columns[3])],
                ["query_id", "query_row", "vec_id", "score"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    found = (asked.join(trees, "shard").select("shard", "tree", "queries")
             .mapInArrow(search, "query_id long, query_row long, vec_id long, score long"))
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), F.col("vec_id").asc_nulls_last())
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
            .select("query_id", F.col("rank").cast("int"), "vec_id", "score"))
