"""The whole pipeline over the smallest tables, and the registered queries."""

import sys
import pathlib

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[2]))
import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402


def test_every_operator_is_registered():
    names = entry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_stages(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns == columns, name
        after = docs.count()
        assert 0 < after <= before and (after == before or name != "line_dedup")
        before = after


def test_run(spark, data):
    rows = entry.queries()["pipeline"](spark, data).toPandas()
    assert set(rows.columns) == {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert rows.groupby("doc_id")["length"].sum().equals(rows.groupby("doc_id")["doc_tokens"].first().rename("length"))


@pytest.mark.parametrize("empty", ["documents", "labels"])
def test_empty_tables(spark, data, tmp_path, empty):
    for name in ("documents", "labels"):
        frame = spark.read.parquet(f"{data}/{name}.parquet")
        (frame.limit(0) if name == empty else frame.limit(30)).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).count()
    assert (rows == 0) == (empty == "documents")


def test_top_products_equal_sql(spark, data):
    from oracle_check import check

    assert check(spark, data, "op9", entry.queries()["op9_top_products"], entry.oracle_sql()["op9_top_products"]) is None
