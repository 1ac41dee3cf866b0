"""Connected components of a graph held in a table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Rounds after which something must be wrong: each at least halves the longest path.
MOST_ROUNDS = 60
#: Links that one task handles at least.
TASK_LINKS = 200_000


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b): root is the smallest node of its component.

    Alternates large-star and small-star steps, which keep as many rows as there are links
    at most and need a number of rounds that grows with the logarithm of the size. Minima
    are aggregated before the shuffle and joined back, so a node with very many links
    never comes to one task as a group. A node without links has no row.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "links")
    # a graph that is small needs few tasks; without this, each of the many steps writes as many files as there are partitions
    few = lambda df: df.coalesce(1 + edges_now // TASK_LINKS)
    before, edges_now = None, edges.count()
    for _ in range(MOST_ROUNDS):
        edges = edges.coalesce(1 + edges_now // TASK_LINKS)
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = few(both.groupBy("a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least")))
        large = few(few(both.join(least, "a")).filter("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct())
        small = few(large.groupBy("a").agg(F.min("b").alias("least")))
        joined = few(large.join(small, "a"))
        edges = joined.select(F.col("b").alias("a"), F.col("least").alias("b")).filter("a <> b").union(joined.select("a", F.col("least").alias("b"))).distinct()
        edges = written(few(edges), "stars")
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")).first()
        if now == before:
            roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return few(edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(few(roots)))
        before, edges_now = now, now["n"]
    raise RuntimeError("the components did not settle")
