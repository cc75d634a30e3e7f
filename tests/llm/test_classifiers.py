"""Language and quality: edge cases, and accuracy on documents that were held out."""

import zlib

import numpy as np
import pytest

from memgov.llm import language, quality

WORDS = {"de": "der die und nicht schon über straße größe wenn auch", "en": "the and with which there would should about these",
         "fr": "les des être où très après même français leçon"}


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def sentences(n=240):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(n):
        lang = sorted(WORDS)[i % 3]
        rows.append((i, " ".join(rng.choice(WORDS[lang].split(), 12)), lang))
    return rows


def test_languages_of_held_out_documents(docs_of, by_id):
    rows = sentences()
    odd = [(1000, None, "en"), (1001, "", "en"), (1002, "123 !?", "en"), (1003, "les " * 200_000, None), (None, "the with", None)]
    got = by_id(language.predict_languages(docs_of(rows + odd)))
    for i, _, lang in rows:
        assert got[i]["held_out"] == held(i)
        if held(i):
            assert got[i]["lang_pred"] == lang
        assert 0 <= got[i]["score"] <= 1
    assert [(got[i]["lang_pred"], got[i]["score"]) for i in (1000, 1001, 1002)] == [("und", 0.0)] * 3
    assert got[1003]["lang_pred"] == "fr" and got[None]["lang_pred"] == "en" and got[None]["held_out"] is False


def test_language_of_a_document_is_no_input(docs_of, by_id):
    rows = sentences()
    one = by_id(language.predict_languages(docs_of(rows)))
    changed = [(i, t, "xx" if held(i) else x) for i, t, x in rows]
    assert by_id(language.predict_languages(docs_of(changed))) == one


def test_language_scores_equal_plain_sums(docs_of):
    docs = docs_of(sentences(60))
    model = language.train(docs)
    text = "Der große über"
    names, scores = model.score([text])
    low = text.lower()
    sums = model.prior.copy()
    for n in language.ORDERS:
        for i in range(len(low) - n + 1):
            bucket = language.buckets_of(low[i:i + n])[n - 1]
            assert len(bucket) == 1
            sums = sums + model.log_p[bucket[0]]
    assert names == [model.languages[int(np.argmax(sums))]]
    assert scores[0] == pytest.approx(1 / np.exp(sums - sums.max()).sum(), rel=1e-4)


def test_parts_of_long_texts_lose_no_ngram(monkeypatch):
    text = "abc def ghij klm nop" * 5
    whole = np.sort(np.concatenate(language.buckets_of(text)))
    monkeypatch.setattr(language, "STRETCH", 7)
    assert np.array_equal(np.sort(np.concatenate(language.buckets_of(text))), whole)


def test_nothing_to_learn_from(docs_of, spark, by_id):
    assert language.predict_languages(docs_of([])).count() == 0
    got = by_id(language.predict_languages(docs_of([(1, "text", None)])))
    assert (got[1]["lang_pred"], got[1]["score"]) == ("und", 0.0)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = by_id(quality.score_quality(docs_of([(1, "text", None), (2, None, None)]), none))
    assert (got[1]["score"], got[1]["predicted"]) == (0.5, 0)
    assert quality.keep_good(docs_of([(1, "text", None)]), none).count() == 1
    assert quality.score_quality(docs_of([]), none).count() == 0


def test_filters_keep_columns(docs_of):
    docs = docs_of(sentences(90) + [(500, "123", "en"), (501, None, "en")])
    kept = language.keep_known_language(docs)
    assert kept.columns == docs.columns and kept.count() == 90


def graded(n=300):
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(n):
        good = i % 4 != 0
        words = [rng.choice(WORDS["en"].split()) for _ in range(60)]
        rows.append((i, " ".join(words) + "." if good else " ".join(f"{w}###" for w in words), "en"))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_of_held_out_documents(docs_of, spark, by_id):
    rows, labels = graded()
    odd = [(900, None, None), (901, "", None), (902, "word " * 100_000, None), (None, "the and", None)]
    frame = spark.createDataFrame([*labels, (900, None, 1), (3, 1, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    got = by_id(quality.score_quality(docs_of(rows + odd), frame))
    assert len(got) == len(rows) + 4
    for i, label, _ in labels:
        assert got[i]["held_out"] == held(i) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)
        if held(i):
            assert got[i]["predicted"] == label
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = quality.keep_good(docs_of(rows), frame)
    assert kept.columns == docs_of([]).columns and kept.count() < len(rows)


def test_pair_sums_equal_the_double_loop():
    rng = np.random.default_rng(0)
    fm = quality.FactorisationMachine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    rows = [quality.Features().row(t, len(t)) for t in ("one two two three", "", "a b c d e f")]
    for (index, value), score in zip(rows, fm.score(rows), strict=True):
        z = fm.bias + (fm.weight[index] * value).sum()
        for a in range(len(index)):
            for b in range(a):
                z += float(fm.factor[index[a]] @ fm.factor[index[b]]) * value[a] * value[b]
        assert score == pytest.approx(1 / (1 + np.exp(-np.clip(z, -35, 35))), rel=1e-6)
