"""Small helpers of the operators in this folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Texts differ in length by four orders of magnitude; a small batch keeps a worker's memory bounded.
BATCH_ROWS = 512


def prepare(spark: SparkSession) -> None:
    """Session settings that the queries of this folder count on."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text leaves remainder 2 by 4; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def own_text(df: DataFrame) -> Column:
    """The text, empty where it is null."""
    return F.coalesce(df["text"].cast("string"), F.lit(""))


def sample_share(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def by_hash(share: float, *columns: str) -> Column:
    """Pick about this share of the rows by a hash of the columns: the same rows on every run."""
    spot = F.shiftrightunsigned(F.xxhash64(F.lit("sample"), *columns), 11)
    return spot < F.lit(int(share * 2**53))
