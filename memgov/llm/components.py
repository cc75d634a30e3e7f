"""Connected components of a link table by alternating star contraction.

Each round every node passes the smallest id it knows to its larger neighbours, then to its smaller
ones, so paths shrink to stars in few rounds. Links live in tables of the shared folder; only a
count of changed links comes to the driver. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memgov.session import cut_lineage


def _rewire(near: DataFrame) -> DataFrame:
    """near: (u, v). Joins each u to the smallest of itself and its v."""
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return near.join(least, "u")


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return (_rewire(both).filter(F.col("v") > F.col("u"))
            .select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    joined = _rewire(down)
    return (joined.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(joined.select("u", F.col("m").alias("v"))))


def _proper(links: DataFrame) -> DataFrame:
    return links.filter(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """(node, component) for every node with a link: the smallest node that can be reached.

    links has two long columns; direction, repeats, loops and null ends do not matter.
    """
    u, v = links.columns
    links = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).dropna()
    links = cut_lineage(_proper(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))), label)
    while True:
        stars = cut_lineage(_proper(_small_star(_proper(_large_star(links)))), label)
        # Done once the links are stars: nobody is both a centre and a leaf, nobody has two centres.
        leaves = stars.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        middle = stars.join(leaves.select(F.col("u").alias("v")), "v", "left_semi")
        if leaves.filter("n > 1").isEmpty() and middle.isEmpty():
            break
        links = stars
    centres = stars.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(centres)
