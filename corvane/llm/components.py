"""Connected components of a graph of any size, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.shared import cut, forget


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, component (the least node reachable) for each node of edges(a, b).

    Alternates two steps until nothing changes: every node's larger neighbours move to its least neighbour, then its
    smaller ones do. Both keep components connected and end in stars around the least nodes, after a number of rounds
    that grows with the logarithm of the component's size. A hub's neighbours are never gathered: its least one comes
    from an aggregation, and a join carries it to the others. Rows with a null end and self links add nothing; an
    empty table gives an empty result.
    """
    spark = edges.sparkSession
    pairs = edges.where("a is not null and b is not null and a <> b")
    current = cut(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)

    def moved(links: DataFrame, both: bool) -> DataFrame:
        """Neighbours v of u (all of them, or only the smaller) are linked to u's least one, where that is smaller than v."""
        around = links.select(F.col("a").alias("u"), F.col("b").alias("v"))
        if both:
            around = around.unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        joined = around.join(least, "u")
        new = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if both else joined.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(joined.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return new.where("a <> b").distinct()

    marks = F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")
    before = current.agg(*marks).first()
    while True:
        large = cut(moved(current, True), name)
        small = cut(moved(large, False), name)
        after = small.agg(*marks).first()
        forget(spark, current, large)
        current = small
        if after == before:
            break
        before = after
    leaves = current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return leaves.unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
