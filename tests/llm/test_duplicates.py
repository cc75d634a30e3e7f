"""Fingerprints, near duplicates and lines against brute force."""

import hashlib
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from memgov.llm import components, fingerprints, lines, neardup

VOCAB = [f"w{i}" for i in range(400)]


def sentence(rng, n):
    return " ".join(rng.choice(VOCAB) for _ in range(n))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(None, 3), (7, 7)]
    parent = {i: i for a, b in links if a is not None for i in (a, b)}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        if a is not None:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    got = dict(map(tuple, components.components(spark.createDataFrame(links, "a long, b long")).collect()))
    linked = {i for a, b in links if a is not None and a != b for i in (a, b)}
    assert got == {i: root(i) for i in linked}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_simhash_equals_its_definition():
    for text in ("", " \t", "One", "A b", "a B c D e É é x\ty\x0bz\x1cq", " ".join(map(str, range(300)))):
        words = bytes(text, "utf-8").lower().split()
        shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
        hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
        want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))
        assert neardup.simhash(text) == want
    assert neardup.majority(np.arange(200_000, dtype=np.uint64), part=1000) == neardup.majority(np.arange(200_000, dtype=np.uint64))


@pytest.mark.parametrize("size", [1, 2, 9, 70, 600])
def test_gray_index_equals_brute_force(size):
    rng = np.random.default_rng(size)
    base = rng.integers(0, 2**63, size // 4 + 1, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, len(base)).astype(np.uint64)) for _ in range(3)]))
    index = neardup.GrayIndex(codes)
    got = {(int(index.codes[q]), int(index.codes[c])) for qs, cs in index.near(index.codes) for q, c in zip(qs, cs, strict=True)}
    near = np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 3
    assert got == {(int(codes[a]), int(codes[b])) for a, b in zip(*np.nonzero(near), strict=True)}


def brute_components(codes):
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in range(len(codes)):
        for b in range(a):
            if bin(codes[a] ^ codes[b]).count("1") <= 3:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("page", [2, 2048])
def test_links_connect_what_brute_force_connects(spark, monkeypatch, page):
    monkeypatch.setattr(neardup, "PAGE", page)
    rng = random.Random(page)
    codes = {0}
    for _ in range(25):  # chains of codes one to three bits apart
        code = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            codes.add(code)
            for _ in range(rng.randint(1, 3)):
                code ^= 1 << rng.randrange(64)
    codes = sorted(codes)
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    found = neardup.links(spark.createDataFrame([(c,) for c in signed], "fp long"))
    group = dict(map(tuple, components.components(found).collect()))
    want = brute_components(codes)
    got = [group.get(c, c) for c in signed]
    assert len(set(want)) == len(set(got)) == len(set(zip(want, got, strict=True)))


def near_cases():
    rng = random.Random(8)
    long = sentence(rng, 900)
    rows = [(40, long, "en"), (10, long, "en"), (30, long + " tail", "en"), (31, long.upper(), "en"), (5, sentence(rng, 50), "en"),
            (None, long, "en"), (70, None, None), (71, "", None), (72, " \n ", None), (5, sentence(rng, 60), "en"), (80, "x " * 30_000, "en"),
            (90, "same", "en"), (90, "same", "en")]
    return rows


def test_near_duplicates(docs_of):
    rows = near_cases()
    got = neardup.near_duplicates(docs_of(rows)).collect()
    codes = [neardup.simhash(t or "") for _, t, _ in rows]
    group = brute_components(codes)
    want = []
    for (i, _, _), code, g in zip(rows, codes, group, strict=True):
        ids = [j for (j, _, _), h in zip(rows, group, strict=True) if h == g and j is not None]
        want.append((i, f"{code:016x}", min(ids) if ids else None))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert neardup.near_duplicates(docs_of([])).count() == 0
    assert neardup.near_duplicates(docs_of([(None, "alone here", None)])).first()["component_id"] is None


def test_one_of_each_group_stays(docs_of):
    docs = docs_of(near_cases())
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    groups = {r["component_id"] for r in neardup.near_duplicates(docs).collect()}
    # Two unlike rows share id 5, so two groups do.
    assert sorted(set(ids)) == sorted(groups) and sorted(ids) == [5, 5, 10, 70, 80, 90]


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_fingerprints(docs_of):
    rng = random.Random(3)
    rows = [(i * 3, sentence(rng, rng.choice([0, 2, 30, 400])), "en") for i in range(60)]
    rows += [(500, None, None), (501, "é" * 10, None), (502, sentence(rng, 4000), "en"), (600, rows[7][1], "en"), (7, rows[7][1], "en")]
    got = {r["doc_id"]: r for r in fingerprints.fingerprint(docs_of(rows).repartition(3)).collect()}
    order = sorted(rows, key=lambda r: -r[0])
    assert len(got) == len(rows)
    errors = []
    for (i, text, _), (_, following, _) in zip(order, order[1:] + order[:1], strict=True):
        text, following, row = text or "", following or "", got[i]
        third = len(text) // 3
        edited = text[:len(text) - third] + following[:third]
        assert row["n_chars"] == len(text)
        assert row["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert row["fingerprint"] == fingerprints.as_text(fingerprints.sketcher().sketch(text))
        assert row["edited_fingerprint"] == fingerprints.as_text(fingerprints.sketcher().sketch(edited))
        assert 0 <= row["near_edited"] <= 1 and 0 <= row["near_next"] <= 1
        a, b = shingles(text), shingles(edited)
        if len(a) > 200:
            errors.append(row["near_edited"] - len(a & b) / len(a | b))
    assert abs(np.mean(errors)) < 0.1 and np.abs(errors).max() < 0.3
    assert got[600]["fingerprint"] == got[7]["fingerprint"] != ""
    assert got[500]["fingerprint"] == "" and got[500]["near_edited"] == 1.0


def test_containment_of_a_lone_hash_above_the_limit_is_not_known():
    lone, many = np.array([fingerprints.LIMIT + np.uint64(5)], np.uint64), np.array([3, 9], np.uint64)
    assert fingerprints.containment(lone, many) is None and fingerprints.containment(lone, lone) is None
    assert fingerprints.containment(many[:1], many) == 1.0 and fingerprints.containment(many, lone) == 0.0


def test_sketches_merge_and_tell_containment():
    rng = random.Random(4)
    own = fingerprints.sketcher()
    short, long = sentence(rng, 300), sentence(rng, 5000)
    a, b = own.sketch(short), own.sketch(long + " " + short)
    assert fingerprints.containment(a, b) > 0.9 > 0.2 > fingerprints.containment(b, a)
    merged = fingerprints.merge(own.sketch("one two three"), own.sketch("four five six"))
    assert len(merged) in (1, 2)
    assert np.array_equal(fingerprints.as_sketch(fingerprints.as_text(b)), b)
    assert fingerprints.likeness(a, a) == 1.0


def test_fingerprints_of_few_and_odd_rows(docs_of):
    assert fingerprints.fingerprint(docs_of([])).count() == 0
    one = fingerprints.fingerprint(docs_of([(4, "a b c d e f g h i", None)])).first()
    assert one["near_next"] == 1.0
    rows = fingerprints.fingerprint(docs_of([(4, "a b", None), (4, "c d", None), (None, "e f", None), (None, None, None)])).collect()
    assert len(rows) == 4


def normal(line):
    return " ".join(line.lower().split())


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_simhash(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "line string")
    rows = lines.with_simhash(frame.withColumn("norm", lines.normal(F.col("line"))), ["line"]).collect()
    return {r["line"]: r["fp"] & (1 << 64) - 1 for r in rows}


@pytest.mark.parametrize("part", [2, 7])
def test_line_simhash(spark, monkeypatch, part):
    monkeypatch.setattr(lines, "SLICE", part)
    monkeypatch.setattr(lines, "TURN", 20)
    texts = ["one two three", "a a b", "x", "p q", "w " * 300 + "z", " ".join(f"v{i}" for i in range(500))]
    got = line_simhash(spark, texts)
    for t in texts:
        hashes = [xxhash.xxh64_intdigest(w, 42) for w in set(t.split())]
        assert got[t] == sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def line_cases():
    rng = random.Random(11)
    base = sentence(rng, 120)
    words = base.split()
    near = [" ".join(words[:i] + ["changed"] + words[i + 1:]) for i in (3, 50, 90)]
    other = [sentence(rng, 30) for _ in range(20)]
    spaced = f"  {other[0].upper().replace(' ', '  ')} "
    docs = [(1, f"{base}\n\n{other[0]}\n{other[1]}", "en"), (2, f"{near[0]}\n{other[2]}\n{spaced}", "en"), (3, None, None), (4, "", None),
            (5, "\n".join([other[1], near[1], near[2], other[3], other[3]]), "en"), (None, f"{other[4]}\n{base}", "en"),
            (6, other[4], "en"), (7, f"{other[5]}\nsame", "en"), (7, f"{other[5]}\nsame", "en"), (8, "\n \n", "en")]
    return docs + [(20 + i, f"{sentence(rng, 25)}\n{other[6]}", "en") for i in range(30)]


def brute_lines(spark, rows):
    found = {}
    for i, text, _ in rows:
        if text is not None:
            for pos, line in enumerate(text.split("\n")):
                if normal(line):
                    found.setdefault(normal(line), []).append((i is None, i or 0, xxhash.xxh64_intdigest(text, 42), pos))
    signed = {n: [(a, i, t - (1 << 64) if t >> 63 else t, p) for a, i, t, p in at] for n, at in found.items()}
    names, codes = list(found), line_simhash(spark, list(found))
    parent = {n: n for n in names}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            if bin(codes[x] ^ codes[y]).count("1") <= 3 and distance(x, y) <= int(0.2 * max(len(x), len(y))):
                parent[root(x)] = root(y)
    first = {}
    for n in names:
        first[root(n)] = min(first.get(root(n), min(signed[n])), min(signed[n]))
    out = []
    for i, text, _ in rows:
        if text is None:
            out.append((i, None))
            continue
        tie = xxhash.xxh64_intdigest(text, 42)
        tie = tie - (1 << 64) if tie >> 63 else tie
        keep = [line for pos, line in enumerate(text.split("\n"))
                if not normal(line) or first[root(normal(line))] == (i is None, i or 0, tie, pos)]
        out.append((i, "\n".join(keep)))
    return out


def test_lines_equal_brute_force(spark, docs_of):
    rows = line_cases()
    docs = docs_of(rows)
    got = lines.dedup_lines(docs)
    assert got.columns == docs.columns
    made = got.collect()
    assert sorted([(r["doc_id"], r["text"]) for r in made], key=str) == sorted(brute_lines(spark, rows), key=str)
    assert all(r["n_chars"] == len(r["text"]) for r in made if r["text"] is not None)
    report = {r["doc_id"]: r for r in lines.line_report(docs).collect()}
    assert report[3]["n_lines"] == 0 and report[3]["text"] is None and report[5]["n_removed"] >= 2


def test_lines_of_nothing(docs_of):
    assert lines.dedup_lines(docs_of([])).count() == 0
    assert lines.dedup_lines(docs_of([(1, None, None), (2, "", None)])).count() == 2


def test_native_plan(docs_of):
    plan = lines.line_report(docs_of([(1, "a\nb", None)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_of_repeated_rows(docs_of):
    rng = random.Random(21)
    texts = [sentence(rng, n) for n in (9, 40, 120)]
    rows = [(1, t, "en") for t in texts] + [(i, t, "en") for t in texts for i in [None] * 2 + [5] * 5]
    found = lines.occurrences(docs_of(rows).coalesce(1)).select("h1", "fp").distinct()
    assert found.count() == len(texts)


def test_line_near_that_of_repeated_rows(docs_of):
    rng = random.Random(22)
    words = sentence(rng, 120).split()
    near = " ".join(words[:60] + ["changed"] + words[61:])
    rows = [(1, near, "en")] + [(2, " ".join(words), "en")] * 3
    assert {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs_of(rows).coalesce(1)).collect()} == {1: near, 2: ""}


def test_near_lines_are_found_whatever_their_bits(docs_of):
    """Links against brute force at edit similarity 0.8 without a limit of bits."""
    rng = random.Random(23)
    texts = ["Read more here", "Read more here!", "All rights reserved 2021", "All rights reserved 2022", "contact us", "contact us."]
    for n in (6, 10, 20, 30, 45):
        for _ in range(8):
            words = sentence(rng, n).split()
            other = list(words)
            for at in rng.sample(range(n), max(1, n // 8)):
                other[at] = rng.choice(VOCAB)
            texts += [" ".join(words), " ".join(other)]
    texts = sorted({normal(t) for t in texts})
    near = [(a, b) for i, a in enumerate(texts) for b in texts[:i]
            if abs(len(a) - len(b)) <= 0.2 * max(len(a), len(b)) and distance(a, b) <= int(0.2 * max(len(a), len(b)))]
    docs = docs_of([(i, t, "en") for i, t in enumerate(texts)])
    found = lines.occurrences(docs)
    kept = {r["at"]["doc_id"]: r["kept"]["doc_id"] for r in found.join(lines.line_groups(docs, found), ["h1", "h2"]).select("at", "kept").collect()}
    place = {t: i for i, t in enumerate(texts)}
    linked = sum(place[a] in kept and kept[place[a]] == kept.get(place[b]) for a, b in near)
    assert len(near) > 30 and linked >= 0.95 * len(near)


def test_short_lines_are_compared_as_they_meet(docs_of, monkeypatch):
    """Unlike lines of the same few syllables share many keys; only pairs of longer lines go on to be verified with their texts."""
    rng = random.Random(29)
    parts = ["the", "er", "tion", "an", "st", "of"]
    texts = {" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 5))) for _ in range(250)}
    texts = sorted(normal(t) for t in texts if len(t) <= lines.SHORT)
    texts += [texts[0] + "s", "x" + texts[1], " ".join(sentence(rng, 30).split())]
    sent, verified = [], lines.verified

    def counted(pairs, docs, unique):
        sent.append(pairs.count())
        return verified(pairs, docs, unique)

    monkeypatch.setattr(lines, "verified", counted)
    found = lines.occurrences(docs := docs_of([(i, t, "en") for i, t in enumerate(texts)]))
    kept = {r["at"]["doc_id"]: r["kept"]["doc_id"] for r in found.join(lines.line_groups(docs, found), ["h1", "h2"]).select("at", "kept").collect()}
    assert sum(sent) == 0
    assert kept[len(texts) - 3] == kept[0] and kept[len(texts) - 2] == kept[1]
    parent = list(range(len(texts)))

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a in range(len(texts)):
        for b in range(a):
            if distance(texts[a], texts[b]) <= int(0.2 * max(len(texts[a]), len(texts[b])) + 1e-9):
                parent[root(a)] = root(b)
    assert all(root(a) == root(b) for a, b in kept.items())


def test_pair_keys_leave_out_what_only_one_line_has(spark):
    rows = [(1, [1, 2, 3]), (2, [2, 3, 4]), (3, [3, 9]), (4, [7]), (5, [7]), (6, [])]
    frame = spark.createDataFrame(rows, "uid long, threes array<int>")
    whole = frame.select("uid", F.explode(lines.piece_keys("threes", 1, 2, 6)).alias("key")).filter("key is not null")
    again = {r["key"] for r in whole.groupBy("key").count().filter("count > 1").collect()}
    made = {(r["uid"], r["key"]) for r in lines.pair_keys(frame, "threes", 1, 6).collect()}
    assert {x for x in map(tuple, whole.collect()) if x[1] in again} == {x for x in made if x[1] in again} and len(again) == 2
    assert made <= set(map(tuple, whole.collect())) and len(made) == 4


def test_near_copies_by_five_words_go(docs_of):
    """Recall against brute force at a Jaccard similarity of 0.8 of five-word shingles."""
    rng = random.Random(31)
    texts = []
    for n in (30, 60, 120, 400):
        for _ in range(8):
            words = sentence(rng, n).split()
            texts.append(" ".join(words))
            for _ in range(max(1, n // 60)):
                words[rng.randrange(n)] = "changed"
            texts.append(" ".join(words))
    sets = [shingles(t) for t in texts]
    near = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    kept = {r["doc_id"] for r in neardup.keep_one(docs_of([(i, t, "en") for i, t in enumerate(texts)])).collect()}
    assert len(near) > 15 and sum(i not in kept for i, _ in near) >= 0.95 * len(near)
    assert all(j in kept for j in range(0, len(texts), 2))
