"""Document fingerprints: threshold-scaled sketches of word shingles.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so its size follows the
text's, the union of two sketches filtered by the threshold is the sketch of both texts together,
and containment of a short text in a very long one can be read off directly. A sketch that would be
empty keeps its one smallest hash; this merges as well, as the smallest of two smallest hashes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgov.llm.common import own_text, shuffle_width

SHINGLE = 5
FRACTION = 8  # one hash of so many is kept
DIGITS = 12  # hexadecimal digits of a hash: 48 bits
LIMIT = np.uint64((1 << 4 * DIGITS) // FRACTION)
KEPT_WORDS = 1 << 19
SLICES = 4  # of the id range, per shuffle partition
_STEP = np.uint64(0x9E3779B97F4A7C15)

COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string,"
           " near_edited double, near_next double")


class Sketcher:
    """Sketches of texts; hashes of words are kept in a bounded table per worker."""

    def __init__(self):
        self.kept: dict[str, int] = {}

    def _hash(self, word: str) -> int:
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            found = self.kept[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return found

    def sketch(self, text: str) -> np.ndarray:
        """Sorted kept hashes of the five-word shingles; fewer words make one shingle, none an empty sketch."""
        words = text.lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        own = np.fromiter(map(self._hash, words), np.uint64, len(words))
        span = min(SHINGLE, len(own))
        mixed = np.zeros(len(own) - span + 1, np.uint64)
        for k in range(span):
            mixed = (mixed ^ own[k:k + len(mixed)]) * _STEP
            mixed ^= mixed >> np.uint64(29)
        mixed >>= np.uint64(64 - 4 * DIGITS)
        kept = np.unique(mixed[mixed < LIMIT])
        return kept if len(kept) else mixed.min(keepdims=True)


@functools.lru_cache(1)
def sketcher() -> Sketcher:
    return Sketcher()


def as_text(sketch: np.ndarray) -> str:
    return "".join([f"{h:0{DIGITS}x}" for h in sketch.tolist()])


def as_sketch(text: str) -> np.ndarray:
    return np.array([int(text[i:i + DIGITS], 16) for i in range(0, len(text), DIGITS)], np.uint64)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The sketch of two texts' shingles together, from their sketches."""
    both = np.union1d(a, b)
    below = both[both < LIMIT]
    return below if len(below) else both[:1]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity; two empty sketches are alike, an empty and a filled one are not."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    common = len(np.intersect1d(a, b, assume_unique=True))
    return common / (len(a) + len(b) - common)


def containment(a: np.ndarray, b: np.ndarray) -> float | None:
    """Estimated share of a's shingles that b holds; None, not known, where a's only hash is not below the limit."""
    if len(a) == 1 and a[0] >= LIMIT:
        return None
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a) if len(a) else 1.0


def edit(text: str, following: str) -> str:
    """The last third of the text replaced by the start of the following one."""
    third = len(text) // 3
    return text[:len(text) - third] + following[:third]


def in_slices(docs: DataFrame) -> DataFrame:
    """doc_id, text, slice and role, where each slice holds a range of ids and the first row after it.

    Slices come from quantiles of the ids alone. The first row of a slice is also dealt to the slice
    before it in descending order (role 1), and the first of all to the last, so that each slice can be
    read on its own. Rows of one id are in one slice; null ids make the last one.
    """
    spark = docs.sparkSession
    own = docs.select(F.col("doc_id").cast("long"), own_text(docs).alias("text"))
    ids = own.select("doc_id")
    shares = [i / (SLICES * shuffle_width(spark)) for i in range(1, SLICES * shuffle_width(spark))]
    edges = ids.agg(F.percentile_approx("doc_id", shares, 10_000)).first()[0]
    edges = np.unique(np.array(edges or [], np.int64))

    def number(doc_id: pd.Series) -> pd.Series:
        there = doc_id.notna().to_numpy()
        out = np.full(len(doc_id), -1, np.int32)
        out[there] = np.searchsorted(edges, doc_id[there].astype("int64").to_numpy(), "right")
        return pd.Series(out)

    slice_of = F.pandas_udf(number, "int")
    # The largest id of each slice: as many rows as slices.
    heads = sorted(((r[0], r[1]) for r in ids.groupBy(slice_of("doc_id").alias("slice")).agg(F.max("doc_id")).collect()),
                   key=lambda r: -r[0])
    chain = {head: heads[(i - 1) % len(heads)][0] for i, (_, head) in enumerate(heads)}

    def copies(doc_id: pd.Series, own_slice: pd.Series) -> pd.Series:
        return pd.Series([[int(s), chain[None if pd.isna(d) else int(d)]] if (None if pd.isna(d) else int(d)) in chain else [int(s)]
                          for d, s in zip(doc_id, own_slice, strict=True)])

    dealt = own.withColumn("slice", slice_of("doc_id"))
    return (dealt.select("doc_id", "text", F.posexplode(F.pandas_udf(copies, "array<int>")("doc_id", "slice")))
            .withColumnsRenamed({"pos": "role", "col": "slice"}))


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they and the next document's are.

    Null texts count as empty; equal texts have equal fingerprints; empty texts have an empty one. The
    next document is the next lower doc_id; after the lowest comes the highest. Rows of one id follow
    each other in the order of their texts' hashes, null ids come last. A single row is followed by itself.
    """
    def run(batches):
        own = sketcher()
        out: list[list] = [[] for _ in range(7)]
        before = None  # (slice, doc_id, text, sketch) of the row that waits for the one after it

        def add(row, text, sketch):
            edited = edit(row[2], text)
            own_edited = row[3] if edited == row[2] else own.sketch(edited)
            values = (row[1], len(row[2]), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), as_text(row[3]),
                      as_text(own_edited), likeness(row[3], own_edited), likeness(row[3], sketch))
            for column, value in zip(out, values, strict=True):
                column.append(value)

        def batch_of():
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            names = [c.split()[0] for c in COLUMNS.split(", ")]
            made = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names)
            for column in out:
                column.clear()
            return made

        for batch in batches:
            for doc_id, text, at, role in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "slice", "role")), strict=True):
                if role and before is None:
                    continue  # a further row of the id that follows a slice
                sketch = own.sketch(text)
                if before is not None:
                    add(before, text, sketch)
                before = None if role else (at, doc_id, text, sketch)
            yield batch_of()

    tie = F.xxhash64("text")
    return (in_slices(docs).withColumn("tie", tie).repartition(shuffle_width(docs.sparkSession), "slice")
            .sortWithinPartitions("slice", "role", F.col("doc_id").desc_nulls_last(), "tie")
            .select("doc_id", "text", "slice", "role").mapInArrow(run, COLUMNS))
