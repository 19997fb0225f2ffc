"""Connected components of an edge table by alternating star contraction.

Each round is joins and group-bys on node ids; nothing is collected but one
number, and each round's edges are written to the shared checkpoint folder.
Large stars are linked through minima, which Spark pre-aggregates by task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from wayfold.llm.common import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for every node of an edge; the component is its smallest node.

    Self-loops and repeated edges are allowed; without edges the result is empty.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    pairs, before = _counted(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # large star: every larger neighbour of a node is linked to its smallest neighbour;
        # minima are written before the join, so a star's rows may be split among tasks there
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = materialize(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")))
        # small star: a node and its smaller neighbours are linked to the smallest of them
        least = materialize(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        pairs, now = _counted(small.where("a <> b").distinct())
        if now == before:
            break
        before = now
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(pairs.select(F.col("b"), F.col("b")).distinct())


def _counted(pairs: DataFrame) -> tuple[DataFrame, tuple]:
    """The pairs, written, with their number and the sum of their hashes, taken on the way."""
    seen = Observation()
    pairs = materialize(pairs.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)")).alias("sum")))
    return pairs, tuple(seen.get.values())
