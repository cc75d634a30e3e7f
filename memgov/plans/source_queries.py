"""Queries over sources and sinks: given tables written in a source's own format, and read back through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgov.plans import inputs
from memgov.plans.catalog import query
from memgov.session import new_scratch
from memgov.sources.registry import read_registry
from memgov.sources.requests import explode_results, read_bank_responses
from memgov.sources.tables import event_rows


@query("registry_source", f"""
WITH {inputs.WRITERS_SQL}
SELECT writer_id, source, write_bank, array_to_string(read_banks, ',') AS read_banks FROM writers""")
def registry_source(spark, d):
    """Nations as one registry document of JSON, and its writers."""
    path = new_scratch(spark, "registry")
    rule = F.struct("role", "source", "write_bank", "read_banks")
    document = inputs.writers(spark, d).agg(F.to_json(F.struct(
        F.map_from_entries(F.collect_list(F.struct("writer_id", rule.alias("rule")))).alias("writers"),
        F.struct(F.lit("review_queue").alias("unknown_writer_action"), F.lit("review_queue").alias("suspicious_content_action")).alias("defaults"),
    )).alias("value"))
    document.write.text(path)
    return read_registry(spark, path).select("writer_id", "source", "write_bank", F.array_join("read_banks", ",").alias("read_banks"))


@query("bank_answer_results", """
SELECT conv_id::VARCHAR AS request_id, concat('bank', turn) AS bank_id, 0 AS pos, concat(conv_id, ':', turn) AS memory_id, text FROM conversations
UNION ALL SELECT conv_id::VARCHAR, concat('bank', turn), 1, role, NULL FROM conversations""")
def bank_answer_results(spark, d):
    """Turns as bank answers in JSON lines, and one row for each of their results."""
    path = new_scratch(spark, "bank-answers")
    turns = inputs.table(spark, d, "conversations")
    found = F.array(F.to_json(F.struct(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")), F.to_json(F.struct(F.col("role").alias("id"))))
    turns.select(F.to_json(F.struct(
        F.col("conv_id").cast("string").alias("request_id"), F.concat(F.lit("bank"), F.col("turn").cast("string")).alias("bank_id"),
        found.alias("results"))).alias("value")).write.text(path)
    return explode_results(read_bank_responses(spark, path)).select("request_id", "bank_id", "pos", "memory_id", "text")


@query("event_details", """
SELECT concat('q_', l_orderkey, '_0123456789abcdef') AS quarantine_id, l_shipdate AS occurred_at,
  concat('{"line":', l_linenumber, ',"flag":', to_json(l_returnflag), '}') AS details, count(*) AS events
FROM lineitem GROUP BY ALL""")
def event_details(spark, d):
    """Line items as event rows with details."""
    lines = inputs.table(spark, d, "lineitem").select(
        F.concat(F.lit("q_"), F.col("l_orderkey").cast("string"), F.lit("_0123456789abcdef")).alias("quarantine_id"),
        F.col("l_shipdate").alias("occurred_at"), F.lit("requarantined").alias("event_type"), "l_linenumber", "l_returnflag")
    details = F.struct(F.col("l_linenumber").alias("line"), F.col("l_returnflag").alias("flag"))
    return event_rows(lines, "lines", details).groupBy("quarantine_id", "occurred_at", "details").agg(F.count(F.lit(1)).alias("events"))
