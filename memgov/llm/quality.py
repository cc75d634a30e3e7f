"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

A document is a sparse row: its words hashed into buckets, one bucket per bin of each structure
statistic, and one for the recorded length. The machine adds a bias, linear weights and the
interactions of all pairs of features through low-rank factors. By the identity
sum over pairs = half of (square of sum - sum of squares), scoring takes time linear in the features.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgov.llm.common import by_hash, held_out, sample_share

WORD_BUCKETS = 1 << 15
BINS = 12
TRAIN_DOCS = 6_000  # labelled documents the machine is fitted on, at most, about
RANK = 8
EPOCHS = 12
MINIBATCH = 128
RATE = 0.05
DECAY = 1e-5
THRESHOLD = 0.7
KEPT_WORDS = 1 << 18
STATS = ("chars", "words", "word_length", "distinct", "top_word", "repeats", "upper", "digits", "marks", "symbols",
         "lines", "line_length", "same_lines", "sentence_ends", "short_words", "long_words", "recorded")
SIZE = WORD_BUCKETS + len(STATS) * BINS
_SYMBOLS = np.zeros(128, bool)
_SYMBOLS[[ord(c) for c in "#$%&*+<=>@\\^_`{|}~!"]] = True
_ENDS = re.compile(r"[.!?](?:\s|$)")


def _spread(value: float) -> int:
    """A share between 0 and 1 as a bin, finer near both ends."""
    return int(np.searchsorted((0.001, 0.005, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.7, 0.9, 0.98), value, "right"))


def _size(value: float) -> int:
    return min(BINS - 1, int(value).bit_length())


class Features:
    """Sparse rows of documents; bucket numbers of words are kept in a bounded table."""

    def __init__(self):
        self.kept: dict[str, int] = {}

    def _bucket(self, word: str) -> int:
        found = self.kept.get(word)
        if found is None:
            if len(self.kept) >= KEPT_WORDS:
                self.kept.clear()
            found = self.kept[word] = zlib.crc32(word.encode("utf-8", "surrogatepass")) & (WORD_BUCKETS - 1)
        return found

    def row(self, text: str, recorded: int | None) -> tuple[np.ndarray, np.ndarray]:
        words = text.split()
        counts = Counter(words)
        index = np.fromiter(map(self._bucket, counts), np.int32, len(counts))
        value = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
        norm = float(np.sqrt((value * value).sum()))
        value = value / norm if norm else value
        stats = self._stats(text, words, counts, recorded)
        bins = WORD_BUCKETS + np.arange(len(STATS)) * BINS + np.array(stats)
        return (np.concatenate([index, bins.astype(np.int32)]),
                np.concatenate([value, np.full(len(STATS), 0.5)]).astype(np.float32))

    @staticmethod
    def _stats(text: str, words: list[str], counts: Counter, recorded: int | None) -> list[int]:
        n, w = len(text), len(words)
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        ascii_counts = np.bincount(points[points < 128], minlength=128)
        letters = int(ascii_counts[65:91].sum() + ascii_counts[97:123].sum()) + int((points >= 128).sum())
        upper, digits = int(ascii_counts[65:91].sum()), int(ascii_counts[48:58].sum())
        symbols = int(ascii_counts[_SYMBOLS].sum())
        marks = int(ascii_counts[33:].sum()) - upper - digits - int(ascii_counts[97:123].sum())
        lines = text.split("\n")
        lengths = np.fromiter(map(len, words), np.int64, w)
        return [
            _size(n / 8), _size(w), min(BINS - 1, int(lengths.mean())) if w else 0, _spread(len(counts) / w if w else 0),
            _spread(max(counts.values()) / w if w else 0),
            _spread(sum(a == b for a, b in zip(words, words[1:], strict=False)) / w if w else 0),
            _spread(upper / max(letters, 1)), _spread(digits / max(n, 1)), _spread(marks / max(n, 1)),
            _spread(symbols / max(n, 1)), _size(len(lines)), _size(n / len(lines) / 4),
            _spread(1 - len(set(lines)) / len(lines)), _spread(len(_ENDS.findall(text)) / max(w, 1)),
            _spread(float((lengths <= 2).mean()) if w else 0), _spread(float((lengths > 12).mean()) if w else 0),
            _size(recorded / 8) if recorded is not None and recorded >= 0 else BINS - 1,
        ]


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, offsets, axis=0)


@dataclass
class FactorisationMachine:
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def raw(self, index: np.ndarray, value: np.ndarray, offsets: np.ndarray):
        """Scores before the logistic of rows laid end to end, and the factor sums."""
        scaled = self.factor[index] * value[:, None]
        sums = _sums(scaled, offsets)
        pairs = 0.5 * ((sums * sums).sum(1) - _sums((scaled * scaled).sum(1), offsets))
        return self.bias + _sums(self.weight[index] * value, offsets) + pairs, scaled, sums

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        offsets = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
        z = self.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), offsets)[0]
        return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> FactorisationMachine:
    """Logistic loss, AdaGrad steps over minibatches in a fixed random order."""
    rng = np.random.default_rng(7)
    rate = (labels.sum() + 1) / (len(labels) + 2)
    fm = FactorisationMachine(float(np.log(rate / (1 - rate))), np.zeros(SIZE), rng.normal(0, 0.05, (SIZE, RANK)))
    seen_w, seen_f, seen_b = np.full(SIZE, 1e-3), np.full((SIZE, RANK), 1e-3), 1e-3
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), MINIBATCH):
            pick = order[at:at + MINIBATCH]
            lengths = np.array([len(rows[i][0]) for i in pick])
            offsets = np.cumsum(lengths) - lengths
            index = np.concatenate([rows[i][0] for i in pick])
            value = np.concatenate([rows[i][1] for i in pick]).astype(float)
            z, scaled, sums = fm.raw(index, value, offsets)
            error = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[pick]) / len(pick)
            each = np.repeat(error, lengths) * value
            touched, inverse = np.unique(index, return_inverse=True)
            gw = np.bincount(inverse, each, len(touched)) + DECAY * fm.weight[touched]
            push = each[:, None] * (np.repeat(sums, lengths, 0) - scaled)
            gf = np.stack([np.bincount(inverse, push[:, k], len(touched)) for k in range(RANK)], 1) + DECAY * fm.factor[touched]
            gb = float(error.sum())
            seen_w[touched] += gw * gw
            seen_f[touched] += gf * gf
            seen_b += gb * gb
            fm.weight[touched] -= RATE * gw / np.sqrt(seen_w[touched])
            fm.factor[touched] -= RATE * gf / np.sqrt(seen_f[touched])
            fm.bias -= RATE * gb / seen_b ** 0.5
    return fm


def recorded_length(docs: DataFrame):
    """The n_chars column if there is one: the only metadata besides the ones no score may use."""
    return (F.col("n_chars") if "n_chars" in docs.columns else F.lit(None)).cast("long")


def train(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> FactorisationMachine | None:
    """Fit on about `bound` labelled documents that are not held out, picked by a hash of their id.

    A document with several labels counts as 0 if any is 0; other values than 0 and 1 are left out.
    Returns None if no labelled document is there.
    """
    usable = (labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
              .groupBy(F.col("doc_id").cast("long").alias("labelled_id")).agg(F.min("quality").alias("label")))
    share = sample_share(usable.count(), bound)
    picked = usable.filter(by_hash(share, "labelled_id"))  # about `bound` rows of two numbers
    sample = (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                          recorded_length(docs).alias("recorded"))
              .join(F.broadcast(picked), F.col("doc_id") == F.col("labelled_id"))
              .select("text", "recorded", F.col("label").cast("int")))

    def rows_of(batches):
        features = Features()
        for batch in batches:
            rows = [features.row(t, r) for t, r in zip(batch.column("text").to_pylist(), batch.column("recorded").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("label"), pa.array([r[0] for r in rows], pa.list_(pa.int32())),
                 pa.array([r[1] for r in rows], pa.list_(pa.float32()))], ["label", "index", "value"])

    got = sample.mapInArrow(rows_of, "label int, index array<int>, value array<float>").toArrow()
    if not got.num_rows:
        return None
    index, value = (got.column(c).combine_chunks() for c in ("index", "value"))
    rows = [(i.values.to_numpy(), v.values.to_numpy()) for i, v in zip(index, value, strict=True)]
    # The order of rows from a cluster varies; a fixed one makes the fit repeatable.
    order = sorted(range(len(rows)), key=lambda i: (zlib.crc32(rows[i][0].tobytes()), zlib.crc32(rows[i][1].tobytes())))
    return fit([rows[i] for i in order], got.column("label").to_numpy()[order].astype(float))


def scorer(docs: DataFrame, model: FactorisationMachine | None):
    """A column function from (text, recorded length) to a score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fm, features = shared.value, Features()
        for text, recorded in batches:
            if fm is None:
                yield pd.Series(np.full(len(text), 0.5))
                continue
            out, rows, held = [], [], 0
            for t, r in zip(text, recorded, strict=True):
                rows.append(features.row(t if isinstance(t, str) else "", None if pd.isna(r) else int(r)))
                held += len(rows[-1][0])
                if held > 100_000:
                    out.append(fm.score(rows))
                    rows, held = [], 0
            out.append(fm.score(rows))
            yield pd.Series(np.concatenate(out))

    return F.pandas_udf(score, "double")


def score_quality(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score (0 to 1) and predicted (1 from a score of 0.7) for every row.

    Null texts count as empty. Without any labelled document every score is 0.5. Null and repeated ids
    come back as they are.
    """
    score = scorer(docs, train(docs, labels, bound))(F.col("text").cast("string"), recorded_length(docs))
    return (docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """The rows that score 0.7 or more, columns unchanged; all rows if there is nothing to learn from."""
    model = train(docs, labels, bound)
    if model is None:
        return docs
    return docs.filter(scorer(docs, model)(F.col("text").cast("string"), recorded_length(docs)) >= THRESHOLD)
