"""Writer registry: who writes where, and which banks each writer reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgov import fixed

_RULE = "struct<role:string,source:string,write_bank:string,read_banks:array<string>>"
REGISTRY = (
    f"writers map<string,{_RULE}>, "
    "defaults struct<unknown_writer_action:string,suspicious_content_action:string>"
)
# --- fixed value: the registry used when none is given ----------------------------------------
DEFAULT_REGISTRY = (
    '{"writers":{"main":{"role":"default","source":"application","write_bank":"main",'
    '"read_banks":["main"]}},"defaults":{"unknown_writer_action":"review_queue",'
    '"suspicious_content_action":"review_queue"}}'
)


def read_registry(spark: SparkSession, path: str | None = None) -> DataFrame:
    """One row per writer: writer_id, role, source, write_bank, read_banks and both defaults."""
    if path:
        text = spark.read.text(path, wholetext=True)
    else:
        text = spark.range(1).select(F.lit(DEFAULT_REGISTRY).alias("value"))
    parsed = text.select(F.from_json("value", REGISTRY).alias("r"))
    return parsed.select(
        F.explode("r.writers").alias("writer_id", "w"), F.col("r.defaults").alias("d")
    ).select(
        "writer_id", "w.role", "w.source", "w.write_bank", "w.read_banks",
        "d.unknown_writer_action", "d.suspicious_content_action",
    )


def registry_errors(writers: DataFrame) -> DataFrame:
    """Rows that break a rule, with the first broken rule."""

    def blank(c):
        return F.trim(F.coalesce(c, F.lit(""))) == ""

    def empty(c):
        return F.coalesce(c, F.lit("")) == ""

    error = (
        F.when(~F.col("writer_id").rlike(fixed.WRITER_ID), "invalid_writer_id")
        .when(empty(F.col("role")) | empty(F.col("source")), "missing_field")
        .when(blank(F.col("write_bank")), "blank_write_bank")
        .when(F.col("read_banks").isNull(), "missing_field")
        .when(F.exists("read_banks", blank), "blank_read_bank")
        .when(
            ~F.col("unknown_writer_action").eqNullSafe("review_queue")
            | ~F.col("suspicious_content_action").eqNullSafe("review_queue"),
            "invalid_default_action",
        )
    )
    return writers.withColumn("error", error).filter("error is not null")


def read_bank_rows(writers: DataFrame) -> DataFrame:
    """One row per writer and read bank, bank order kept."""
    return writers.select("writer_id", F.posexplode("read_banks").alias("bank_pos", "bank_id"))
