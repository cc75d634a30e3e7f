"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of n-grams of one to three characters go into a fixed number of buckets per language. The
matrix of log probabilities is small and of fixed height, so it is broadcast; scoring turns a batch
of texts into one sparse row layout (bucket numbers with row offsets) and sums gathered matrix rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgov.llm.common import by_hash, held_out, sample_share

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
TRAIN_DOCS = 20_000  # documents that the counts are taken from, at most, about
TRAIN_TASKS = 8
SMOOTHING = 0.1
UNDETERMINED = "und"
STRETCH = 1 << 18  # characters looked at together
_MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_LETTER = regex.compile(r"\p{L}")


def stretches(text: str):
    """The text in parts that share order - 1 characters, so that no n-gram is lost or doubled."""
    for at in range(0, max(len(text), 1), STRETCH):
        yield text[at:at + STRETCH], text[max(0, at - max(ORDERS) + 1):at]


def buckets_of(text: str) -> list[np.ndarray]:
    """Bucket numbers of all n-grams of the lower-cased text, one array per part and order."""
    out = []
    for part, before in stretches(text):
        points = np.frombuffer((before + part).lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        lead = len(before.lower())
        for n in ORDERS:
            first = max(0, lead - n + 1)
            count = len(points) - n + 1 - first
            if count <= 0:
                continue
            mixed = np.full(count, n, np.uint32)
            for k in range(n):
                mixed = (mixed ^ points[first + k:first + k + count]) * _MULTIPLIERS[k]
                mixed ^= mixed >> np.uint32(15)
            out.append((mixed & np.uint32(BUCKETS - 1)).astype(np.int64))
    return out


@dataclass
class LanguageModel:
    languages: list[str]
    prior: np.ndarray
    log_p: np.ndarray  # buckets by languages

    def score(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Most likely language and its posterior; `und` and 0 without a letter or without a model."""
        names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
        rows, parts, held = [], [], 0

        def flush():
            nonlocal rows, parts, held
            if parts:
                sums = np.zeros((rows[-1] - rows[0] + 1, len(self.languages)))
                offsets = np.cumsum([0, *(len(p) for p in parts[:-1])])
                per_part = np.add.reduceat(self.log_p[np.concatenate(parts)], offsets, axis=0)
                np.add.at(sums, np.array(rows) - rows[0], per_part)
                for row in dict.fromkeys(rows):
                    total[row] = total.get(row, self.prior) + sums[row - rows[0]]
            rows, parts, held = [], [], 0

        total: dict[int, np.ndarray] = {}
        for i, text in enumerate(texts):
            if text is None or not self.languages or not _LETTER.search(text):
                continue
            for own in buckets_of(text):
                rows.append(i)
                parts.append(own)
                held += len(own)
                if held > STRETCH:
                    flush()
        flush()
        for i, sums in total.items():
            best = int(np.argmax(sums))
            names[i] = self.languages[best]
            scores[i] = float(1 / np.exp(sums - sums[best]).sum())
        return names, scores


def train(docs: DataFrame, bound: int = TRAIN_DOCS) -> LanguageModel:
    """Counts from documents with a language and a text whose id is not held out.

    About `bound` documents, picked by a hash of their id, take part. Without any the model knows no
    language and everything is `und`.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    share = sample_share(labelled.count(), bound)
    sample = labelled.filter(by_hash(share, "doc_id")).select("text", "lang").repartition(TRAIN_TASKS)

    def count(batches):
        counts: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                own = counts.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] = seen.get(lang, 0) + 1
                for buckets in buckets_of(text):
                    own += np.bincount(buckets, minlength=BUCKETS)
        for lang, own in counts.items():
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang]), pa.array([seen[lang]], pa.int64()), pa.array([there.tolist()], pa.list_(pa.int32())),
                 pa.array([own[there].tolist()], pa.list_(pa.int64()))], ["lang", "docs", "bucket", "n"])

    totals: dict[str, np.ndarray] = {}
    docs_of: dict[str, int] = {}
    # At most TRAIN_TASKS rows per language, each of at most BUCKETS counts.
    for row in sample.mapInArrow(count, "lang string, docs long, bucket array<int>, n array<long>").toLocalIterator():
        own = totals.setdefault(row["lang"], np.zeros(BUCKETS))
        own[row["bucket"]] += row["n"]
        docs_of[row["lang"]] = docs_of.get(row["lang"], 0) + row["docs"]
    languages = sorted(totals)
    if not languages:
        return LanguageModel([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    counts = np.stack([totals[x] for x in languages], 1) + SMOOTHING
    prior = np.log(np.array([docs_of[x] for x in languages], float) / sum(docs_of.values()))
    return LanguageModel(languages, prior, np.log(counts / counts.sum(0)).astype(np.float32))


def predictor(docs: DataFrame, model: LanguageModel):
    """A column function from text to (lang_pred, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(text: pd.Series) -> pd.DataFrame:
        names, scores = shared.value.score([t if isinstance(t, str) else None for t in text])
        return pd.DataFrame({"lang_pred": names, "score": scores})

    return F.pandas_udf(predict, "lang_pred string, score double")


def predict_languages(docs: DataFrame, bound: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, lang_pred and score (posterior, 0 to 1) for every row.

    Null texts and texts without a letter are `und` with score 0. Rows with null or repeated ids come
    back as they are. Languages tie in alphabetical order.
    """
    found: Column = predictor(docs, train(docs, bound))(F.col("text").cast("string"))
    return (docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), found.alias("found"))
            .select("doc_id", "held_out", "found.lang_pred", "found.score"))


def keep_known_language(docs: DataFrame, least: float = 0.5, bound: int = TRAIN_DOCS) -> DataFrame:
    """The rows whose language is determined with a posterior of at least `least`, columns unchanged."""
    found = predictor(docs, train(docs, bound))(F.col("text").cast("string"))
    return docs.filter((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least))
