"""Mixing sources to target weights by weighted fair queueing, in DataFrame functions only.

Each source's documents are shuffled by a hash and served again and again in that order. A serving's
virtual finish time is the number of the source's tokens up to its end, divided by the source's target. All
servings are range-sorted by that time and cut off where the budget of the whole mix ends, so every source
has come equally far towards its target.

Running totals come from range partitions: sums within a partition, and one total for each partition
before it. A source with a third of all rows lies in many partitions. Texts are read once and stay
where they are; one number per document decides.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memgov.llm.common import shuffle_width
from memgov.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = (3, 2)  # the mix as a fraction of all sizes
TIMES = 2  # a document is taken so many times at most
_WIDE = "decimal(38,0)"


def with_running(frame: DataFrame, order: list[Column], totals: dict[str, Column], label: str) -> DataFrame:
    """Adds, for each name, the sum of its column over all rows before this one in the given order.

    The order has to be strict. Rows of one range partition are summed in one task; from all other
    partitions comes one row each.
    """
    parted = frame.repartitionByRange(shuffle_width(frame.sparkSession), *order)
    parted = cut_lineage(parted.withColumn("_part", F.spark_partition_id()), label)
    sums = parted.groupBy("_part").agg(*[F.sum(total).alias(f"_{name}") for name, total in totals.items()])
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each partition of the shuffle.
    sums = sums.select("_part", *[F.coalesce(F.sum(f"_{name}").over(ahead), F.lit(0)).alias(f"_{name}") for name in totals])
    inside = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = parted.select("*", *[F.coalesce(F.sum(total).over(inside), F.lit(0)).alias(name) for name, total in totals.items()])
    return (own.join(F.broadcast(sums), "_part").withColumns({name: F.col(name) + F.col(f"_{name}") for name in totals})
            .drop("_part", *[f"_{name}" for name in totals]))


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, and what puts them in a random but fixed order: spot, then doc_id, tie and row."""
    text = docs["text"].cast("string")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                      F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
                      F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("tie"))
    mark = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "tie").cast("binary"))
    return own.withColumns({"spot": F.conv(F.substring(mark, 1, 15), 16, 10).cast("long"), "row": F.monotonically_increasing_id()})


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, times: int = TIMES) -> DataFrame:
    """sizes: (source, source_size), one row a source. Adds target, first (tokens of the sources before it).

    Sources take the weights in turn, by code point, null last. Filling all sources at the pace of their
    weights, a source is full at level cap / weight. Those that are full before the mix has its share keep
    their cap, the others divide the rest by weight; full ones are a prefix in order of that level.
    """
    by_name = [F.col("source").asc_nulls_last()]
    named = with_running(sizes, by_name, {"number": F.lit(1), "first": F.col("source_size")}, "sources")
    turn = F.pmod("number", F.lit(len(weights))).cast("int")
    lcm = math.lcm(*weights)
    named = named.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), turn))
    named = named.withColumn("level", F.col("source_size").cast(_WIDE) * (F.lit(lcm) / F.col("weight")).cast("int"))
    levelled = with_running(named, [F.col("level"), F.col("number")], {"full": F.col("source_size"), "lighter": F.col("weight")}, "levels")
    total, heavy = levelled.agg(F.sum("source_size"), F.sum("weight")).first()
    total, heavy = int(total or 0), int(heavy or 0)
    top, bottom = share
    # What all sources hold when this one is full, against the share; both sides times bottom * weight.
    filled = (F.col("weight") * (times * F.col("full")).cast(_WIDE) + (times * F.col("source_size")).cast(_WIDE) * (F.lit(heavy) - F.col("lighter"))) * bottom
    levelled = levelled.withColumn("is_full", filled <= F.lit(top * total).cast(_WIDE) * F.col("weight"))
    done, kept = levelled.filter("is_full").agg(F.sum("source_size"), F.sum("weight")).first()
    rest = top * total - bottom * times * int(done or 0)
    pace = max(bottom * (heavy - int(kept or 0)), 1)
    share_of = (F.col("weight") * F.lit(rest).cast(_WIDE)).cast("double") / F.lit(float(pace))
    target = F.when(F.col("is_full"), (times * F.col("source_size")).cast("double")).otherwise(share_of)
    return levelled.select("source", "source_size", target.alias("target"), F.col("first").cast("long").alias("first"), "number")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, times: int = TIMES) -> DataFrame:
    """doc_id, size, source_size, target and taken (words the mix takes of it, repeats counted), one row for each row.

    Size is the number of words; a null or empty text has size 0 and nothing taken. A null source is a source of its own,
    the last one. Rows that repeat others are documents of their own: how many of them are taken is fixed, which
    of them is not told apart. The mix ends before the serving that would pass its budget, so a source's
    words stay within about one document of its target.
    """
    rows = cut_lineage(sized(docs), "sized")
    sizes = cut_lineage(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    targets = cut_lineage(source_targets(sizes, weights, share, times), "targets")
    order = [F.col("source").asc_nulls_last(), F.col("spot"), F.col("doc_id").asc_nulls_last(), F.col("tie"), F.col("row")]
    placed = with_running(rows, order, {"before": F.col("size"), "pos": F.lit(1)}, "shuffled")
    known = targets.select(F.col("source").alias("_source"), "source_size", "target", "first")
    placed = placed.join(known, F.col("source").eqNullSafe(F.col("_source"))).select(
        "doc_id", "size", "source_size", "target", "pos", (F.col("before") - F.col("first") + F.col("size")).alias("upto"))
    placed = cut_lineage(placed, "placed")

    def finish(serving: int) -> Column:
        return (serving * F.col("source_size") + F.col("upto")).cast("double") / F.when(F.col("target") > 0, F.col("target"))

    served = placed.filter("size > 0").select("size", "pos", F.explode(F.array(*[
        F.struct(finish(i).alias("finish"), F.lit(i).alias("serving")) for i in range(times)])).alias("s")).select("size", "pos", "s.*")
    total = int(sizes.agg(F.sum("source_size")).first()[0] or 0)
    served = with_running(served, [F.col("finish"), F.col("pos"), F.col("serving")], {"ahead": F.col("size")}, "servings")
    fits = F.col("ahead") + F.col("size") <= share[0] * total // share[1]
    end = served.filter(fits).agg(F.max(F.struct("finish", "pos", "serving"))).first()[0]

    def taken(serving: int) -> Column:
        if end is None:
            return F.lit(0)
        inside = F.struct(finish(serving), F.col("pos"), F.lit(serving)) <= F.struct(F.lit(end[0]), F.lit(end[1]).cast("long"), F.lit(end[2]))
        return F.when((F.col("size") > 0) & inside, F.col("size")).otherwise(F.lit(0))

    many = sum((taken(i) for i in range(times)), F.lit(0))
    return placed.select("doc_id", "size", "source_size", "target", many.cast("long").alias("taken"))
