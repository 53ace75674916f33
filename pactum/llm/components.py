"""Connected components of links between integer nodes, without gathering links anywhere.

Rounds of two steps, as in Kiveris and others, "Connected Components in MapReduce
and Beyond": each node first ties its larger neighbours to its least one, then ties
its smaller neighbours and itself to the least of them. Each round's links are
written, which cuts lineage; the rounds end when the links no longer change.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import materialize


def _large(links: DataFrame) -> DataFrame:
    both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    tied = both.join(least, "u").filter("v > u").select(F.col("v").alias("a"), F.least("m", "u").alias("b"))
    return tied.distinct()


def _small(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    tied = links.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("b", "a"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node with a link to another: the least node that it reaches. links: columns a, b."""
    now = materialize(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = _state(now)
    while state[0]:
        now = materialize(_small(_large(now)), "links", rows=state[0])  # a round never adds links
        before, state = state, _state(now)
        if state == before:
            break
    roots = now.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
