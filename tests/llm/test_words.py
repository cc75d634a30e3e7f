"""Spelling variants, the mix of sources and ranked search, each against a plain version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from memgov.llm import mixing, reversed_search, spelling

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
NATIVE = ("Python", "Arrow", "Pandas", "ExternalRDD", "MapElements")


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts):
    found = {}
    for w, n in counts.items():
        near = [(-counts[v], v) for v in counts if one_apart(v, w)]
        best = min(near, default=None)
        found[w] = (best[1], len(near), -best[0]) if best and -best[0] >= 2 * n else (None, len(near), None)
    out = {}
    for w, n in counts.items():
        root = w
        while found[root][0]:
            root = found[root][0]
        out[w] = (found[w][0], root, n, found[w][1], found[w][2])
    return out


def as_rows(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("letters,bound", [("ab", 3), ("abc", 2048), ("aé\U0001f600", 5)])
def test_variants_of_crowded_lists(spark, letters, bound):
    """Few letters put most words in one list, which is then dealt anew down to single positions."""
    some = random.Random(4)
    counts = {"".join(some.choices(letters, k=some.randint(5, 9))): some.randint(3, 4000) for _ in range(220)}
    got = as_rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), bound=bound))
    assert got == plain_variants(counts)


def test_variants_of_short_words(spark):
    counts = {"a": 3, "b": 1, "ab": 40, "ba": 2, "aab": 100, "x": 7}
    got = as_rows(spelling.variants(spark.createDataFrame(list(counts.items()), "word string, n long"), length=1, bound=2))
    assert got == plain_variants(counts)
    assert as_rows(spelling.variants(spark.createDataFrame([], "word string, n long"))) == {}


def plain_words(rows, damage):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % damage == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= 5:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 3}


def test_spelling_of_documents(spark, docs_of):
    some = random.Random(5)
    stems = ["".join(some.choices("étÀxyzQ", k=some.randint(5, 8))) for _ in range(60)]
    rows = [(None if i % 9 == 0 else i, " ".join(some.choices(stems, k=40)) + ("-Ärgernis÷" * i)) for i in range(60)]
    rows += [(7, None), (8, ""), (9, "a1b2 ...")] + rows[:5]
    got = as_rows(spelling.spelling_variants(docs_of([(i, t, "en") for i, t in rows]), damage=3))
    want = plain_variants(plain_words(rows, 3))
    assert got == want and any(v[0] for v in want.values())
    assert as_rows(spelling.spelling_variants(docs_of([(1, None, None)]))) == {}


def plain_targets(sizes, weights, share, times):
    """Reshare what is over a cap, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    left, full, target = sum(sizes.values()) * share, set(), {}
    while True:
        free = [s for s in order if s not in full]
        rest = left - sum(times * sizes[s] for s in full)
        target = {s: rest * weight[s] / sum(weight[f] for f in free) for s in free}
        over = {s for s in free if target[s] >= times * sizes[s]}
        if not over:
            return target | {s: float(times * sizes[s]) for s in full}
        full |= over


def mixed(spark, rows, **more):
    frame = spark.createDataFrame([(*r, 1, 2.0, "x") for r in rows], "doc_id long, text string, source string, pos long, finish double, tie string")
    return mixing.mix(frame, **more)


def test_mix_of_sources(spark):
    some = random.Random(6)
    rows = [(i, " ".join(["w"] * some.randint(0, 40)), some.choice(["a", "a", "a", "ß", "\U0001f600", None, "b", ""])) for i in range(900)]
    rows += [(1000 + i, "v " * 30, "z") for i in range(3)] + [(5000, None, "only"), (None, "x y", "a"), (None, "x y", "a")]
    out = mixed(spark, rows).collect()
    again = mixed(spark, rows[::-1]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))
    assert sorted((str(r["doc_id"]), r["size"]) for r in out) == sorted((str(i), len((t or "").split())) for i, t, _ in rows)
    source = {i: s for i, _, s in rows}
    sizes, taken, targets = defaultdict(int), defaultdict(int), {}
    for _, text, s in rows:
        sizes[s] += len((text or "").split())
    for r in out:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["taken"] in (0, r["size"], 2 * r["size"])
        taken[s] += r["taken"]
        targets[s] = r["target"]
    want = plain_targets(sizes, (3, 1, 2), 1.5, 2)
    for s, target in targets.items():
        assert math.isclose(target, want[s], rel_tol=1e-9, abs_tol=1e-9)
        assert abs(taken[s] - target) <= 41
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())


def test_mix_of_nothing(spark):
    assert mixed(spark, []).collect() == []
    rows = [tuple(r) for r in mixed(spark, [(1, None, None), (2, "", "a"), (None, " \n\x0b\t", "a")]).orderBy("doc_id").collect()]
    assert rows == [(None, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_mix_repeats_and_shares(spark):
    rows = [(1, "a b c", "s")] * 6 + [(2, "a " * 12, "t")]
    out = [tuple(r) for r in mixed(spark, rows, weights=(1, 1), share=(1, 2), times=1).collect()]
    assert sum(r[4] for r in out if r[0] == 1) == 12 and all(r[3] == 7.5 for r in out)
    long = [(i, "w " * (50_000 if i == 3 else 3), "s" if i % 3 else "t") for i in range(30)]
    assert all(r["taken"] <= 2 * r["size"] for r in mixed(spark, long).collect())


def test_mix_is_native(spark, data):
    plan = mixing.mix(spark.read.parquet(f"{data}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(name in plan for name in NATIVE)


def terms(text):
    return [t.translate(LOWER) for t in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_best(docs, items, k=10):
    cut = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    total, n_docs = sum(sum(c.values()) for _, c in cut), len(cut)
    df = Counter(t for _, c in cut for t in c)
    out = []
    for item_id, text in {(i, t) for i, t in items if t}:
        scored = []
        for doc_id, counts in cut:
            m = 10 + (90 * sum(counts.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10 ** 9 * counts[t]) // (1000 * counts[t] + 8 * m))
                        for t in set(terms(text)) if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        out += [(item_id, rank, s[3], -s[0]) for rank, s in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings", [1 << 18, 20])
def test_best_documents(spark, docs_of, postings):
    some = random.Random(7)
    vocabulary = ["the", "The", "été", "ÉTÉ", "x1", "2", "日本語", "naïve", "a_b", "q\x00r", "zz"] + [f"w{i}" for i in range(60)]
    docs = [(None if i % 11 == 0 else i // 2, ", ".join(some.choices(vocabulary, k=some.randint(0, 50)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, " -- "), *docs[:20], (503, "the " * 20_000)]
    items = [(i, " ".join(some.choices(vocabulary, k=some.randint(1, 12)))) for i in range(25)]
    items += [(3, "another text w1"), (None, "w2 w3"), (40, None), (41, "!!"), (42, "unseen words"), items[0]]
    asked = spark.createDataFrame([(i, t, 1, 5) for i, t in items], "item_id long, text string, score long, rank int")
    out = reversed_search.best_documents(docs_of([(i, t, "en") for i, t in docs]), asked, postings=postings)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == plain_best(docs, items)


def test_best_documents_of_nothing(spark, docs_of):
    no_items = spark.createDataFrame([], "item_id long, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert reversed_search.best_documents(docs_of([(1, "a b", "en")]), no_items).collect() == []
    assert reversed_search.best_documents(docs_of([]), items).collect() == []
    assert reversed_search.best_documents(docs_of([(1, None, "en")]), items).collect() == []


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_source_mix", "op13_best_documents"])
def test_new_queries_equal_sql(spark, data, name):
    import __spark_entry__ as entry
    from oracle_check import check

    assert check(spark, data, name, entry.queries()[name], entry.oracle_sql()[name]) is None
