"""Request bodies as raw JSON, and bank responses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgov import fixed
from memgov.functions.jsontext import last_key_wins, too_deep

REQUEST_LINE = "request_id string, writer_id string, op string, ts_ms bigint, body string"
BANK_LINE = (
    "request_id string, bank_id string, error_kind string, results array<string>, "
    "chunks string, entities string, source_facts string, trace string"
)


def checked_bodies(df: DataFrame, max_bytes: int = fixed.MAX_BODY_BYTES) -> DataFrame:
    """Keep every row: `body` is strict JSON or null, `parse_error` tells why it was refused.

    An empty body counts as {}. Repeated keys keep the last value. NaN and Infinity are refused.
    """
    raw = F.when(F.coalesce(F.col("body"), F.lit("")) == "", F.lit("{}")).otherwise(F.col("body"))
    large = F.octet_length(F.col("body")) > max_bytes
    df = df.withColumn("_large", F.coalesce(large, F.lit(False))).withColumn("body", raw)
    strict = F.when(~F.col("_large"), F.try_parse_json("body")).isNotNull()
    df = df.withColumn("_strict", strict)
    retry = last_key_wins(F.when(~F.col("_strict") & ~F.col("_large"), F.col("body")))
    df = df.withColumn("_retry", retry)
    body = F.when(F.col("_strict"), F.col("body")).otherwise(F.col("_retry"))
    df = df.withColumn("body", body)
    error = (
        F.when(F.col("_large"), "payload_too_large")
        .when(F.col("body").isNull(), "invalid_json")
        .when(too_deep(F.col("body")), "json_too_deep")
    )
    return df.withColumn("parse_error", error).drop("_large", "_strict", "_retry")


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of request_id, writer_id, op, ts_ms and body; the body stays raw text."""
    lines = spark.read.text(path)
    row = F.from_json("value", REQUEST_LINE).alias("r")
    return checked_bodies(lines.select(row).select("r.*"))


def stream_requests(spark: SparkSession, path: str) -> DataFrame:
    lines = spark.readStream.text(path)
    return checked_bodies(lines.select(F.from_json("value", REQUEST_LINE).alias("r")).select("r.*"))


def read_bank_responses(spark: SparkSession, path: str) -> DataFrame:
    """One row per request and bank; results, maps and trace stay raw JSON for scans and digests."""
    lines = spark.read.text(path)
    return lines.select(F.from_json("value", BANK_LINE).alias("r")).select("r.*")


def explode_results(responses: DataFrame) -> DataFrame:
    """One row per result of a bank, with id, text and the raw result."""
    one = responses.select("request_id", "bank_id", F.posexplode("results").alias("pos", "result"))
    value = F.try_parse_json("result")
    return one.withColumn("memory_id", F.try_variant_get(value, "$.id", "string")).withColumn(
        "text", F.try_variant_get(value, "$.text", "string")
    )
