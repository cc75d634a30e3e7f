import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, uid long, gone string, block int"


@pytest.fixture
def docs_of(spark):
    """A documents table from (doc_id, text, lang) rows, with columns whose names the operators use themselves."""
    from memgov.llm.common import prepare

    prepare(spark)

    def make(rows):
        full = [(i, text, lang, "s", None if text is None else len(text), 0.5, 7, 7, "x", 1) for i, text, lang in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


@pytest.fixture
def by_id():
    def rows(df):
        return {r["doc_id"]: r for r in df.collect()}

    return rows
