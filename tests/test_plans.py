"""Plans that must hold at scale: no shuffle in the scan, ranks cut early, columns pruned."""

import contextlib
import io

from pyspark.sql import functions as F

from memgov.fixed import QuarantineLimits
from memgov.operators import quarantine, quota, scan
from memgov.operators.quarantine import ITEM_SCHEMA
from memgov.operators.walk import with_text_unit, with_units
from memgov.plans import catalog, inputs

catalog.load_all()


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def test_scan_does_not_shuffle(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    assert "Exchange" not in plan(scan.scan(with_text_unit(docs, "text")))
    bodies = docs.select(F.to_json(F.struct("text")).alias("body"))
    assert "Exchange" not in plan(scan.scan(with_units(bodies, "body", "recall")))


def test_ranks_are_cut_before_the_shuffle(spark, data):
    rows = inputs.event_requests(spark, data).select(
        "request_id", "ts_ms", "writer_id", F.lit("suspicious_content").alias("reason"), F.lit("retain_request").alias("kind"))
    items = spark.createDataFrame([], ITEM_SCHEMA)
    assert "WindowGroupLimit" in plan(quota.admit_counts(rows, items, inputs.at(), QuarantineLimits()))


def test_statistics_read_few_columns(spark, data):
    text = plan(quarantine.scoped_pending(inputs.items(spark, data), inputs.at()))
    assert "o_totalprice" not in text and "PushedFilters" in text


def test_no_cartesian_products(spark, data):
    for name in ("quarantine_stats", "cleanup_preview", "merged_items", "reviewed_items", "legacy_import",
                 "capacity_by_count", "retain_decisions", "denied_endpoints"):
        text = plan(catalog.QUERIES[name](spark, data))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_request_bytes_of_long_and_unmeasured_texts(spark, tmp_path):
    from memgov.plans import catalog

    texts = ["", "é" * 5000, "a\"b\\\n", None, "ﬁ" * 30_000]
    rows = [(i, t, "en", "s", None if i % 2 else len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["items"], r["bytes"]) for r in catalog.QUERIES["request_bytes_whole"](spark, str(tmp_path)).collect()}
    assert got == {i: (150, 900 + len((t or "").encode())) for i, t in enumerate(texts)}


def test_queries_bound_their_arrow_batches(spark, data):
    """A worker holds one batch of bodies, so its rows are few."""
    from memgov.plans import catalog

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    catalog.QUERIES["recalled_digests"](spark, data)
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) == catalog.BATCH_ROWS <= 1_000
