"""BPE, token files and packing against the tokenizers library."""

import hashlib
import random
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memgov.llm import bpe, packing, token_files
from memgov.llm.tokens import PartEncoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = ["", " ", "a   y", "x  \n\n<|endoftext|> foo", "don't I'll 's 't5 ½5²x", "\x1c\x1d a\x85b\x0bc", "<|startoftext|>A,<|endoftext|>!",
       "日本語 テキスト。 ça va? éé", "é ́x Σας ΣΑΣ İx ﬁ", "🙂🙂 👩‍👩‍👧", "foo.bar(baz)!!'s x'", "<|ENDOFTEXT|> Ab", "word " * 3000, "x" * 20_000]


def texts(n=400):
    rng = random.Random(5)
    signs = [*"aAbB é'’s.,!½5²\n\t   \x1c\x85Σ<|>日́", "<|endoftext|>", "'s", " Word", "the "]
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 50))) for _ in range(n)]


def expected(path, rows):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(rows, add_special_tokens=False)]


def test_own_codec_equals_the_library():
    rows, library = texts(), Tokenizer.from_file(BYTE)
    own = bpe.BytePairCodec(BYTE)
    for text, ids in zip(rows, expected(BYTE, rows), strict=True):
        assert own.encode(text) == ids
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([own.first[0xC3]]) == "�"


def test_full_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_CHUNKS", 4)
    monkeypatch.setattr("memgov.llm.tokens.KEPT_PARTS", 4)
    rows = texts(50)
    own, parts = bpe.BytePairCodec(BYTE), PartEncoder(BYTE)
    assert [own.encode(t) for t in rows] == expected(BYTE, rows)
    assert [np.frombuffer(b, "<u4").tolist() for b in parts.encode_batch(rows)] == expected(BYTE, rows)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_parts_give_the_ids_of_the_whole(path):
    rows = texts()
    assert [np.frombuffer(b, "<u4").tolist() for b in PartEncoder(path).encode_batch(rows)] == expected(path, rows)


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_words_skip_normalising_and_cutting(path, monkeypatch):
    rows = ["Zürich, the déjà-vu\nOnce more... ǆungla ƻ aƻ ŉx", "İstanbul ǅ Ab\x1cCd", "\n\nTwo\n Three\tfour\r\nFive \u00a0six\x85seven  eight"]
    own, whole = PartEncoder(path), []
    monkeypatch.setattr(own, "_whole", lambda part, ask=own._whole: whole.append(part) or ask(part))
    assert [np.frombuffer(b, "<u4").tolist() for b in own.encode_batch(rows)] == expected(path, rows)
    assert own.words and not {"Zürich", " the", "Once", " more", "zürich", "the", "once", "more"} & set(whole)


def cases():
    return [(5, "one two", "en"), (3, None, "en"), (9, "", None), (None, "no id", "en"), (5, "twice", "en"), (7, "long " * 9000, "en")]


def test_round_trip_digests(docs_of):
    rows = bpe.round_trip_digests(docs_of(cases()), BYTE).collect()
    want = []
    for i, text, _ in cases():
        ids = expected(BYTE, [text or ""])[0]
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert bpe.round_trip_digests(docs_of([]), BYTE).count() == 0


def test_token_files(spark, docs_of, tmp_path):
    out = str(tmp_path / "tokens")
    token_files.write_token_files(docs_of(cases()), out, WORD)
    stored = token_files.read_token_files(spark, out)
    got = sorted(map(tuple, token_files.layout_digests(stored).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, 3, 5, 5, 7, 9]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1]]
    for i, _, n, crc in got:
        options = [np.array([*expected(WORD, [t or ""])[0], 1], "<u4") for j, t, _ in cases() if i == j]
        assert (n, crc) in [(len(o), zlib.crc32(o.tobytes())) for o in options]
    assert stored.filter("doc_id = 7").count() == 1
    plan = stored.filter("doc_id = 7")._jdf.queryExecution().toString()
    assert "EqualTo(doc_id,7)" in plan


def test_token_files_of_nothing(spark, docs_of, tmp_path):
    out = str(tmp_path / "none")
    token_files.write_token_files(docs_of([]), out, WORD)
    assert token_files.layout_digests(token_files.read_token_files(spark, out)).count() == 0


def check_packing(rows, docs):
    ids = {}
    for i, text, _ in docs:
        ids.setdefault(i, []).append(np.array([*expected(BYTE, [text or ""])[0], 1], "<u4"))
    assert rows["length"].sum() == sum(len(x) for own in ids.values() for x in own)
    for _, own in rows.sort_values("offset").groupby("sequence_id"):
        assert own["offset"].tolist() == [0, *own["length"].cumsum()[:-1]]
        assert own["length"].sum() <= packing.WINDOW
    for i, own in rows.groupby("doc_id"):
        if len(ids[i]) == 1:
            own = own.sort_values("start")
            assert own["start"].tolist() == [0, *own["length"].cumsum()[:-1]]
            crc = [zlib.crc32(ids[i][0][a:a + n].tobytes()) for a, n in zip(own["start"], own["length"], strict=True)]
            assert own["ids_crc32"].tolist() == crc
            assert set(own["doc_tokens"]) == {len(ids[i][0])}
    assert sorted(rows["sequence_id"].unique()) == list(range(rows["sequence_id"].nunique()))


def test_packing(docs_of):
    rng = random.Random(3)
    docs = [(i, "w " * rng.choice([3, 40, 700, 1023, rng.randint(0, 5000)]), "en") for i in range(150)] + cases()
    docs = [(None if i is None else i + 1000 * (k >= 150), t, x) for k, (i, t, x) in enumerate(docs)]
    rows = packing.pack(docs_of(docs).repartition(3), BYTE).toPandas()
    rows = rows.assign(doc_id=rows["doc_id"].fillna(-1).astype("int64"))
    check_packing(rows, [(-1 if i is None else i, t, x) for i, t, x in docs])
    sizes = rows.groupby("sequence_id")["length"].sum()
    assert (sizes.map(lambda n: n & (n - 1) != 0)).sum() <= 1


def test_packing_of_little(docs_of):
    assert packing.pack(docs_of([]), BYTE).count() == 0
    one = packing.pack(docs_of([(1, None, None)]), BYTE).toPandas()
    assert one[["doc_id", "start", "length", "doc_tokens", "offset"]].values.tolist() == [[1, 0, 1, 1, 0]]


def test_least_squares_uses_up_what_fits():
    counts = np.zeros(2048, int)
    counts[[1000, 1048, 500, 24]] = [300, 310, 40, 20]
    combos = packing.combinations(2048, counts)
    assert (combos.sum(1) == 2048).all()
    plan = packing.round_counts(combos, packing.solve_counts(combos, counts), counts)
    used = np.zeros(2048, int)
    for lengths, times in plan:
        np.add.at(used, list(lengths), times)
    assert (used <= counts).all() and used[1000] >= 290


def test_least_squares_holds_no_padded_matrix():
    counts = np.minimum(np.arange(1024), 1)
    combos = packing.combinations(1024, counts)
    tracemalloc.start()
    packing.solve_counts(combos, counts, 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert combos.shape[1] == 16 and peak < 1.5 * 8 * combos.size


def test_every_rank_gets_its_own_place():
    rng = np.random.default_rng(1)
    counts = np.zeros(2048, int)
    np.add.at(counts, rng.integers(1, 2048, 900), 1)
    layout = packing.Layout(counts)
    filled = pd.Series(0, index=range(layout.sequences))
    for length in np.flatnonzero(counts):
        for rank in range(counts[length]):
            pieces = layout.place(int(length), rank)
            assert sum(p[0] for p in pieces) == length
            for size, sequence, offset in pieces:
                assert offset + size <= 2048
                filled[sequence] += size
    assert filled.sum() == (counts * np.arange(2048)).sum()
    assert (filled.sort_index() != 2048).sum() <= 1
