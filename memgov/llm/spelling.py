"""Spelling variants: words one edit apart, found by dynamic programming over sorted lists.

Words are counted on the JVM. Two words one edit apart are equal but for one place, which lies in some window of the
shorter one's positions: outside of the window their beginnings and ends agree. So each word is dealt to the two
halves of its own length and of the length one less, under what lies outside. A list of words with one key is
sorted by what lies inside the window. All words of the list ask at once: adjacent words share the
rows of the edit matrix up to their longest common prefix, rows are a band of three cells, and a range of the list
is left as soon as no cell of its shared prefix is within one edit of the asking word.

A list longer than a bound is dealt anew under windows half as wide, until windows are one position
wide; a window that narrow admits at most one or two free characters, so no list is long for good.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memgov.llm.common import shuffle_width
from memgov.session import cut_lineage

LETTERS = "A-Za-zÀ-ÿ"
LENGTH = 5  # code points of a word, at least
OCCURRENCES = 3  # at least
RATIO = 2  # a form occurs so many times as often as the word, at least
DAMAGE = 97  # one run in so many loses a code point
LIST = 2048  # words of a list before it is dealt anew
BATCH = 8192  # words searched together, about
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_FAR = 9


def words_of(docs: DataFrame, damage: int | None = None, length: int = LENGTH) -> DataFrame:
    """One row per word of at least `length` code points: maximal runs of letters, A to Z in lower case.

    With damage, a run loses a code point wherever the checksum of "<doc_id>:<run>" is divisible by it; a null
    doc_id is written as nothing. Null texts have no words.
    """
    found = F.regexp_extract_all(docs["text"].cast("string"), F.lit(f"[{LETTERS}]{{{length},}}"), F.lit(0))
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(found).alias("word"))
    # Most words have no capitals at all, and that is cheap to tell.
    runs = runs.withColumn("word", F.when(F.lower("word") == F.col("word"), F.col("word")).otherwise(F.translate("word", _UPPER, _LOWER)))
    if damage is None:
        return runs.select("word")
    check = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary"))
    at = F.pmod(check, F.char_length("word")).cast("int")
    less = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
    return runs.select(F.when(check % damage == 0, less).otherwise(F.col("word")).alias("word")).filter(F.char_length("word") >= length)


def vocabulary(words: DataFrame, occurrences: int = OCCURRENCES) -> DataFrame:
    """word, n: words that occur often enough."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= occurrences)


def _keyed(frame: DataFrame) -> DataFrame:
    """frame: word, n, m (length of the shorter word of a pair), lo, hi (the window). Adds key and inner."""
    tail = F.col("m") - F.col("hi")
    size = F.char_length("word")
    key = F.concat_ws(":", "m", "lo", "hi", F.substring(F.col("word"), F.lit(1), F.col("lo")), F.substring(F.col("word"), size - tail + 1, tail))
    return frame.withColumns({"key": key, "inner": F.substring(F.col("word"), F.col("lo") + 1, size - tail - F.col("lo"))})


def _halved(lo: Column, hi: Column) -> Column:
    mid = F.floor((lo + hi) / 2).cast("int")
    return F.array(F.struct(lo.alias("lo"), mid.alias("hi")), F.struct(mid.alias("lo"), hi.alias("hi")))


def lists(words: DataFrame, length: int = LENGTH, bound: int = LIST) -> DataFrame:
    """word, n, m, lo, hi, key, inner: every word under each window that its partners can differ in."""
    size = F.char_length("word")
    shorter = F.filter(F.array(size, size - 1), lambda m: m >= length)
    dealt = words.select("word", "n", F.explode(shorter).alias("m"))
    done, crowded = [], dealt.withColumns({"lo": F.lit(0), "hi": F.col("m")})
    while True:
        halves = crowded.select("word", "n", "m", F.explode(_halved(F.col("lo"), F.col("hi"))).alias("w")).select("word", "n", "m", "w.*").filter("lo < hi")
        halves = cut_lineage(_keyed(halves), "lists")
        long = cut_lineage(halves.groupBy("key").agg(F.count(F.lit(1)).alias("many")).filter(F.col("many") > bound).select("key"), "long-lists")
        stays = halves.join(long, "key", "left_anti").unionByName(halves.filter("hi - lo < 2").join(long, "key", "left_semi"))
        done.append(stays)
        crowded = halves.filter("hi - lo > 1").join(long, "key", "left_semi").select("word", "n", "m", "lo", "hi")
        if crowded.isEmpty():
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def scan_lists(group: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, k), i < k, of rows of one group whose words are one edit apart.

    Rows are sorted by group, then word; a group's words are distinct. The lists are walked level by level: a node is a range of
    rows with one prefix, an asking row and a node hold three cells of the edit matrix, around the diagonal.
    """
    n = len(words)
    sizes = np.fromiter(map(len, words), np.int64, n)
    width = int(sizes.max(initial=0)) + 1
    codes = np.zeros((n, width + 2), np.uint32)
    if n and width > 1:
        codes[:, :width] = np.array(words, f"U{width}").view(np.uint32).reshape(n, width)
    new_group = np.ones(n, bool)
    new_group[1:] = group[1:] != group[:-1]
    unlike = codes[1:, :width] != codes[:-1, :width]
    common = np.concatenate([[0], np.where(unlike.any(1), unlike.argmax(1), width)]) if n else np.zeros(0, np.int64)
    common[new_group] = -1
    heads = np.flatnonzero(new_group)
    ends = np.append(heads[1:], n)
    many = ends - heads
    asks = np.arange(n)
    start, stop = np.repeat(heads, many), np.repeat(ends, many)
    cells = np.tile(np.array([_FAR, 0, 1], np.int8), (n, 1))
    cells[sizes == 0, 2] = _FAR
    lefts, rights = [], []
    for depth in range(width):
        # Children of the nodes: rows whose prefix of depth + 1 characters is not that of the row before.
        edge = np.append(np.flatnonzero(common <= depth), n)
        first, last = np.searchsorted(edge, start), np.searchsorted(edge, stop)
        fan = last - first
        origin = np.repeat(np.arange(len(asks)), fan)
        child = np.arange(fan.sum()) - np.repeat(np.cumsum(fan) - fan, fan) + first[origin]
        start, stop = edge[child], edge[child + 1]
        wanted = stop - 1 > asks[origin]
        origin, start, stop = origin[wanted], start[wanted], stop[wanted]
        asks, old = asks[origin], cells[origin]
        size = sizes[asks]
        mark = codes[start, depth]
        over = mark == 0
        if over.any():
            # A word ends here; a character of 0 stands for its end.
            at = size[over] - depth + 1
            inside = (at >= 0) & (at <= 2)
            away = np.where(inside, old[over][np.arange(len(at)), np.clip(at, 0, 2)], _FAR)
            hit = (away == 1) & (start[over] > asks[over])
            lefts.append(asks[over][hit])
            rights.append(start[over][hit])
            go = ~over
            asks, old, start, stop, size, mark = asks[go], old[go], start[go], stop[go], size[go], mark[go]
        below = old[:, 0] + (codes[asks, depth - 1] != mark) if depth else np.full(len(asks), _FAR, np.int8)
        one = np.minimum(below, old[:, 1] + 1)
        one[size < depth] = _FAR
        two = np.minimum(np.minimum(old[:, 2] + 1, one + 1), old[:, 1] + (codes[asks, depth] != mark))
        two[size < depth + 1] = _FAR
        three = np.minimum(two + 1, old[:, 2] + (codes[asks, depth + 1] != mark))
        three[size < depth + 2] = _FAR
        cells = np.minimum(np.stack([one, two, three], 1), _FAR).astype(np.int8)
        near = cells.min(1) <= 1
        asks, start, stop, cells = asks[near], start[near], stop[near], cells[near]
        if not len(asks):
            break
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *lefts]), np.concatenate([none, *rights])


def _searched(batches, limit: int = BATCH):
    """word, near, near_n, both ways, from lists that come one after the other, each sorted."""
    kept: list[pa.RecordBatch] = []

    def flush(table: pa.Table):
        size = table.num_rows
        if size < 2:
            return
        _, group = np.unique(table["key"].to_numpy(zero_copy_only=False), return_inverse=True)
        inner = table["inner"].to_pylist()
        i, k = scan_lists(group, inner)
        words = table["word"].to_numpy(zero_copy_only=False)
        m, lo, hi = (table[c].to_numpy() for c in ("m", "lo", "hi"))
        # Each pair once: with the length of its shorter word, in the window of its first difference.
        long = np.fromiter(map(len, words), np.int64, size)
        first = np.fromiter((_common(inner[a], inner[b]) for a, b in zip(i.tolist(), k.tolist(), strict=True)), np.int64, len(i)) + lo[i]
        right = (np.minimum(long[i], long[k]) == m[i]) & ((first < hi[i]) | (hi[i] == m[i]))
        i, k = i[right], k[right]
        n = table["n"].to_numpy()
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([words[i], words[k]]), pa.string()), pa.array(np.concatenate([words[k], words[i]]), pa.string()),
             pa.array(np.concatenate([n[k], n[i]]), pa.int64())], ["word", "near", "near_n"])

    for batch in batches:
        kept.append(batch)
        if sum(b.num_rows for b in kept) >= limit:
            table = pa.Table.from_batches(kept)
            keys = table["key"]
            last, cut = keys[-1].as_py(), table.num_rows - 1
            while cut > 0 and keys[cut - 1].as_py() == last:
                cut -= 1
            if cut:
                yield from flush(table.slice(0, cut))
                kept = table.slice(cut).to_batches()
    if kept:
        yield from flush(pa.Table.from_batches(kept))


def _common(a: str, b: str) -> int:
    for at, (x, y) in enumerate(zip(a, b)):
        if x != y:
            return at
    return min(len(a), len(b))


def near_words(words: DataFrame, length: int = LENGTH, bound: int = LIST) -> DataFrame:
    """word, near, near_n for all pairs of words that differ by one inserted, deleted or replaced code point."""
    dealt = lists(words, length, bound).select("key", "inner", "word", "n", "m", "lo", "hi")
    placed = dealt.repartition(shuffle_width(words.sparkSession), "key").sortWithinPartitions("key", "inner")
    return placed.mapInArrow(_searched, "word string, near string, near_n long")


def variants(words: DataFrame, ratio: int = RATIO, length: int = LENGTH, bound: int = LIST) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of (word, n).

    A word's form is the most frequent of its near words (ties: the first in code-point order) if that
    occurs at least `ratio` times as often, else null. Its root is where the forms lead to, the word itself
    without one. A form is more frequent than its word, so forms make no cycle for a ratio above 1. Words have at least
    `length` (1 or more) code points and are distinct; an empty table gives an empty table.
    """
    words = cut_lineage(words.select("word", "n"), "vocabulary")
    best = near_words(words, length, bound).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left")
    far = F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False))
    formed = cut_lineage(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(far, F.col("best.near")).alias("form"), F.when(far, -F.col("best.less")).alias("form_n")), "forms")
    # Each round doubles the steps that a word has taken.
    steps = formed.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        ahead = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        moved = cut_lineage(steps.join(ahead, F.col("root") == F.col("_at"), "left")
                            .select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("moved")), "roots")
        steps = moved.select("word", "root")
        if moved.filter("moved").isEmpty():
            break
    return (formed.join(steps, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"))


def spelling_variants(docs: DataFrame, damage: int | None = None) -> DataFrame:
    """The variants of the words of whole texts; see words_of and variants."""
    return variants(vocabulary(words_of(docs, damage)))
