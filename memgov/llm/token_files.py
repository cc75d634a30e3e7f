"""Token ids in ORC files: stripes, row indexes and Bloom filters on document ids.

Documents are range-partitioned by id and tokenised in that order, so each file holds a range of
ids and its stripes carry tight minimum and maximum ids: a reader that wants some documents prunes
files, stripes and row groups by metadata, and the Bloom filter settles single ids. ORC run-length
encodes the integers. Each row also holds its file's number and the ids before it in that file, so
that starts over all files need one sum per file and no ordering of documents.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memgov.llm.common import own_text, shuffle_width
from memgov.llm.tokens import encoder

STRIPE_BYTES = 16 << 20
INDEX_STRIDE = 2_000
END_ID = 1
STORED = "doc_id long, part int, before long, n_tokens long, ids array<int>"
CHECKED = "doc_id long, part int, before long, n_tokens long, ids_crc32 long"


def int_lists(coded: list[bytes]) -> pa.ListArray:
    """Lists of 32-bit integers from their bytes, without Python numbers."""
    offsets = np.zeros(len(coded) + 1, np.int32)
    np.cumsum([len(c) // 4 for c in coded], out=offsets[1:])
    values = np.frombuffer(b"".join(coded), "<i4")
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def write_token_files(docs: DataFrame, out: str, path: str, end_id: int = END_ID) -> None:
    """Tokenise whole texts, end each with end_id, and write them as ORC in ascending doc_id order.

    Null texts are empty and give the end id alone. A null doc_id comes first. Rows with the same
    doc_id follow each other in the order of their texts' hashes; a doc_id with very many rows spreads
    over several files. Other columns are not read.
    """
    spark = docs.sparkSession
    end = int(end_id).to_bytes(4, "little")

    def run(batches):
        from pyspark import TaskContext

        part, before = TaskContext.get().partitionId(), 0
        own = encoder(path)
        for batch in batches:
            coded = [c + end for c in own.encode_batch(batch.column("text").to_pylist())]
            counts = np.array([len(c) // 4 for c in coded], np.int64)
            starts = before + np.cumsum(counts) - counts
            before += int(counts.sum())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.full(len(coded), part, np.int32)), pa.array(starts),
                 pa.array(counts), int_lists(coded)], ["doc_id", "part", "before", "n_tokens", "ids"])

    ordered = (
        docs.select(F.col("doc_id").cast("long"), own_text(docs).alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(shuffle_width(spark), "doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
    )
    (ordered.drop("tie").mapInArrow(run, STORED).write.format("orc")
     .option("orc.compress", "ZSTD").option("orc.stripe.size", STRIPE_BYTES)
     .option("orc.row.index.stride", INDEX_STRIDE)
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", 0.01)
     .save(out))


def read_token_files(spark: SparkSession, out: str) -> DataFrame:
    """Every stored document: doc_id, part, before, n_tokens, ids. Filters on doc_id prune by metadata."""
    return spark.read.schema(STORED).option("mergeSchema", "false").orc(out)


def layout_digests(stored: DataFrame) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens and the crc32 of its ids."""
    def run(batches):
        for batch in batches:
            ids = batch.column("ids")
            values = np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")
            at = ids.offsets.to_numpy()
            crc = [zlib.crc32(values[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "part", "before", "n_tokens")] + [pa.array(crc, pa.int64())],
                ["doc_id", "part", "before", "n_tokens", "ids_crc32"])

    sizes = stored.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"))
    # One row per file: the only ordering over all data.
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("part", F.coalesce(F.sum("ids_in_part").over(ahead), F.lit(0)).alias("base"))
    return (
        stored.mapInArrow(run, CHECKED).join(bases, "part")
        .select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")
    )
