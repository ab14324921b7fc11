"""Connected components of links, as rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from careframe.llm.common import free_shuffles, stored


def components(links: DataFrame) -> DataFrame:
    """(member, root): every node of ``links`` (a, b) that is not its component's smallest, with the smallest.

    Each round hangs all larger neighbours of a node on its smallest one (large star), then all smaller
    neighbours likewise (small star), until a round changes nothing; the number of rounds grows with the logarithm
    of the longest path.  Minima are taken map-side first and the joins are inner, so that a node with very many neighbours
    can be split.  Every round is a job whose result is written to the shared folder.
    """
    spark = links.sparkSession
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct(), "links")
    mark = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(
            F.struct("a", F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("x")).select(
            "x.a", "x.b").filter("a != b").distinct()
        edges = stored(small, "links")
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first()
        free_shuffles(spark)
        if now == mark or not now[0]:
            return edges.select(F.col("a").alias("member"), F.col("b").alias("root"))
        mark = now
