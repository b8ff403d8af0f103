"""Connected components of a graph of long identifiers, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import materialise


def components(edges: DataFrame) -> DataFrame:
    """id, root of each node of ``edges`` (a, b): root is the smallest identifier of its component.

    Alternates large-star and small-star steps (Kiveris et al. 2014) until nothing changes; each round is written to the shared
    folder.  Minima are partly aggregated before shuffles and written, so that joins on a node with very many neighbours can be split.
    """
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = None
    while True:
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == before or not state[0]:
            return now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("id"), "root").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
        before = state
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = materialise(both.groupBy("a").agg(F.min("b").alias("m")), "least")
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b"))
        large = large.where("a <> b").distinct()
        large = materialise(large, "large")
        low = materialise(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = materialise(small.where("a <> b").distinct(), "edges")
