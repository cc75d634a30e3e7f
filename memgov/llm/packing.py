"""Packing of token sequences by non-negative least squares over a length histogram.

Every document gives full windows and one remainder. The histogram of remainders has one bin per
length, whatever the data. Shallow combinations of lengths that fill a window exactly are the columns
of a non-negative least squares problem: how often should each be used so that its lengths add up
to the histogram? The solution is rounded within what is left of every length. Remainders that no
combination takes are packed greedily, largest piece first: cut at powers of two, such pieces fill
windows without a gap.

Which remainder goes where follows from its rank among the remainders of its length, a number that
comes from counts per task; no step needs an order over all documents. Pieces that can be cut have
their checksums taken when the text is tokenised, so texts and ids never move.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memgov.llm.common import own_text
from memgov.llm.tokens import encoder
from memgov.session import cut_lineage

WINDOW = 2048
END_ID = 1
NNLS_STEPS = 300
FEWER_PARTS = 1 << 19  # parts of texts kept per worker where earlier stages fill an executor's memory
CUT = ("doc_id long, part int, doc_tokens long, full_crc array<long>, full_rank long, rest int,"
       " rest_rank long, rest_crc long, bit_crc array<long>")
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long,"
          " offset long")


def bits_of(rest: int) -> list[int]:
    """The powers of two that add up to rest, largest first."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def combinations(window: int, counts: np.ndarray) -> np.ndarray:
    """Combinations of up to three lengths, and runs of one length with one other, that fill the window.

    Rows are lengths padded with zeros; only lengths that occur are used.
    """
    there = counts > 0
    rows = []
    lengths = np.flatnonzero(there)
    pairs = lengths[lengths * 2 <= window]
    pairs = pairs[there[window - pairs]]
    rows.append(np.stack([pairs, window - pairs, np.zeros_like(pairs)], 1).astype(np.int32))
    for a in lengths[lengths * 3 <= window]:
        b = np.arange(a, (window - a) // 2 + 1)
        b = b[there[b] & there[window - a - b]]
        rows.append(np.stack([np.full_like(b, a), b, window - a - b], 1).astype(np.int32))
    width = max([3, *(window // lengths + 1)]) if len(lengths) else 3
    width = min(width, 16)
    out = np.zeros((sum(map(len, rows)), width), np.int32)
    out[:, :3] = np.concatenate(rows)
    runs = []
    for a in lengths[(lengths * 3 < window)]:
        times = window // a
        last = window - times * a
        row = [int(a)] * int(times) + ([int(last)] if last else [])
        if 3 < len(row) <= width and (not last or there[last]):
            runs.append(row + [0] * (width - len(row)))
    return np.concatenate([out, np.array(runs, out.dtype)]) if runs else out


def solve_counts(combos: np.ndarray, counts: np.ndarray, steps: int = NNLS_STEPS) -> np.ndarray:
    """Non-negative x with the least squared distance between the lengths used and the histogram.

    Accelerated projected gradient; the matrix is kept as the combinations themselves. Nearly all of them have
    up to three lengths; those ahead of the first longer one are kept in three columns.
    """
    n = len(combos)
    longer = np.flatnonzero(combos[:, 3:].any(1))
    few = int(longer[0]) if len(longer) else n
    narrow, wide = [np.ascontiguousarray(c) for c in combos[:few, :3].T], combos[few:]
    lengths = np.concatenate([combos[:few, :3].ravel(), wide.ravel()]).astype(np.intp)

    def used(x):
        """How often each length is used; what is said of length 0, the padding, has no meaning."""
        return np.bincount(lengths, np.concatenate([np.repeat(x[:few], 3), np.repeat(x[few:], combos.shape[1])]), len(counts))

    def along(values):
        """The sum over the lengths of each combination."""
        values[0] = 0
        return np.concatenate([values[narrow[0]] + values[narrow[1]] + values[narrow[2]], values[wide].sum(1)])

    # The largest eigenvalue of the normal matrix, by power iteration.
    v, top = np.ones(n), 1.0
    for _ in range(20):
        w = along(used(v))
        top = float(np.linalg.norm(w)) or 1.0
        v = w / top
    x = y = np.zeros(n)
    t = 1.0
    for _ in range(steps):
        slope = along(used(y) - counts)
        new = np.maximum(y - slope / top, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        y = new + (t - 1) / t_new * (new - x)
        x, t = new, t_new
    return x


def round_counts(combos: np.ndarray, x: np.ndarray, counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Whole numbers of uses, most used first, never more than what is left of a length."""
    left, plan = counts.astype(int).copy(), []
    for i in np.argsort(-x, kind="stable"):
        if x[i] <= 1e-6:
            break
        lengths = tuple(int(v) for v in combos[i] if v)
        need = defaultdict(int)
        for v in lengths:
            need[v] += 1
        times = min(int(np.ceil(x[i])), *(left[v] // m for v, m in need.items()))
        if times > 0:
            for v, m in need.items():
                left[v] -= times * m
            plan.append((lengths, times))
    return plan


class Layout:
    """Where each remainder goes, by its length and its rank among remainders of that length."""

    def __init__(self, counts: np.ndarray, window: int = WINDOW):
        self.window, self.counts = window, counts.astype(np.int64)
        combos = combinations(window, counts)
        plan = round_counts(combos, solve_counts(combos, counts), counts) if len(combos) else []
        # For each length: ranks from `edge` on go to a combination used `times` times from `base` on.
        self.edge, self.base, self.many, self.spots = ([[] for _ in range(window)] for _ in range(4))
        self.taken = np.zeros(window, np.int64)
        sequence = 0
        for lengths, times in plan:
            spots, at = defaultdict(list), 0
            for v in lengths:
                spots[v].append(at)
                at += v
            for v, own in spots.items():
                self.edge[v].append(int(self.taken[v]))
                self.base[v].append(sequence)
                self.many[v].append(len(own))
                self.spots[v].append(own)
                self.taken[v] += times * len(own)
            sequence += times
        self.greedy_base = sequence
        rest = self.counts - self.taken
        bits = max(1, (window - 1).bit_length())
        holds = (np.arange(window)[:, None] >> np.arange(bits) & 1) * rest[:, None]
        self.ahead = np.cumsum(holds, 0) - holds
        totals = holds.sum(0)
        sizes = totals << np.arange(bits)
        self.start = sizes[::-1].cumsum()[::-1] - sizes
        self.sequences = sequence + -(-int(sizes.sum()) // window)

    def place(self, rest: int, rank: int) -> list[tuple[int, int, int]]:
        """(length, sequence, offset) of each piece of this remainder, in the order of its ids."""
        if rank < self.taken[rest]:
            i = int(np.searchsorted(self.edge[rest], rank, "right")) - 1
            turn, spot = divmod(rank - self.edge[rest][i], self.many[rest][i])
            return [(rest, self.base[rest][i] + turn, self.spots[rest][i][spot])]
        own, out = rank - int(self.taken[rest]), []
        for size in bits_of(rest):
            b = size.bit_length() - 1
            at = int(self.start[b]) + (int(self.ahead[rest, b]) + own) * size
            out.append((size, self.greedy_base + at // self.window, at % self.window))
        return out


def cut_texts(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep: int | None = None) -> DataFrame:
    """Tokenise whole texts; per document the checksums of its pieces and its ranks within its task."""
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, full_seen, rest_seen = TaskContext.get().partitionId(), 0, defaultdict(int)
        own = encoder(path, keep)
        for batch in batches:
            cols = defaultdict(list)
            for coded in own.encode_batch(batch.column("text").to_pylist()):
                ids = memoryview(coded + end)
                n = len(ids) // 4
                full, rest = divmod(n, window)
                crc = [zlib.crc32(ids[i * 4 * window:(i + 1) * 4 * window]) for i in range(full)]
                tail, at, bit_crc = ids[full * 4 * window:], 0, []
                for size in bits_of(rest):
                    bit_crc.append(zlib.crc32(tail[at * 4:(at + size) * 4]))
                    at += size
                for name, value in (("doc_tokens", n), ("full_crc", crc), ("full_rank", full_seen), ("rest", rest),
                                    ("rest_rank", rest_seen[rest]), ("rest_crc", zlib.crc32(tail)), ("bit_crc", bit_crc)):
                    cols[name].append(value)
                full_seen += full
                rest_seen[rest] += 1
            longs = pa.list_(pa.int64())
            kinds = {"doc_tokens": pa.int64(), "full_crc": longs, "full_rank": pa.int64(), "rest": pa.int32(),
                     "rest_rank": pa.int64(), "rest_crc": pa.int64(), "bit_crc": longs}
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([part] * batch.num_rows, pa.int32()),
                 *(pa.array(cols[c], kind) for c, kind in kinds.items())], ["doc_id", "part", *kinds])

    return docs.select(F.col("doc_id").cast("long"), own_text(docs).alias("text")).mapInArrow(run, CUT)


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int = END_ID, keep: int | None = None) -> DataFrame:
    """Pieces of all documents and their places in sequences of at most `window` tokens.

    A document is its ids and the end id, so an empty or null text is one token. Documents at least a
    window long give full sequences; of the remainder at most one sequence in the whole result is left
    partly filled. Rows with null or repeated doc_id are packed like any other. Returns doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id (from 0, without gaps) and offset. keep bounds the parts of texts
    that a worker remembers, and so its memory.
    """
    cut = cut_lineage(cut_texts(docs, path, window, end_id, keep), "packing")
    counts = np.zeros(window, np.int64)
    for row in cut.groupBy("rest").count().collect():  # one row per length
        counts[row["rest"]] = row["count"]
    counts[0] = 0
    layout = Layout(counts, window)

    by_part = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    fulls = (cut.groupBy("part").agg(F.sum(F.size("full_crc")).cast("long").alias("n"))
             .select("part", F.coalesce(F.sum("n").over(by_part), F.lit(0)).alias("full_base")))
    before = Window.partitionBy("rest").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    rests = (cut.groupBy("part", "rest").agg(F.count(F.lit(1)).alias("n"))
             .select("part", "rest", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("rest_base"))
             .join(fulls, "part"))

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(7)]
            for r in batch.to_pylist():
                base = layout.sequences + r["full_base"] + r["full_rank"]
                pieces = [(i * window, window, crc, base + i, 0) for i, crc in enumerate(r["full_crc"])]
                if r["rest"]:
                    at = len(r["full_crc"]) * window
                    placed = layout.place(r["rest"], r["rest_base"] + r["rest_rank"])
                    crcs = [r["rest_crc"]] if len(placed) == 1 else r["bit_crc"]
                    for (length, sequence, offset), crc in zip(placed, crcs, strict=True):
                        pieces.append((at, length, crc, sequence, offset))
                        at += length
                for start, length, crc, sequence, offset in pieces:
                    for column, value in zip(out, (r["doc_id"], start, length, crc, r["doc_tokens"], sequence, offset), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in out],
                ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return cut.join(rests, ["part", "rest"]).mapInArrow(run, PIECES)
