"""Comprehensions over tables, rewritten to relational operators.

The grouping idiom (a scan per key) becomes one aggregate with map-side combining,
and a count in a nested scan becomes an aggregate and a left join: both are linear
where the nested form is a product.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.plans.expr import E, Range


def product(a: DataFrame, b: DataFrame, where: Column) -> DataFrame:
    """for x in a for y in b if where: a join, by its equalities where it has any."""
    return a.join(b, where)


def flat_map(df: DataFrame, array: str, keep: Sequence[str], item: str = "item") -> DataFrame:
    return df.select(*keep, F.explode(array).alias(item))


def over_range(df: DataFrame, lo: E, hi: E, name: str, open: bool = True) -> DataFrame:
    return df.withColumn(name, F.explode(Range(lo, hi, open).values().v))


def build_map(df: DataFrame, parent: Sequence[str], key: Column, value: Column, order: Sequence[Column]) -> DataFrame:
    """{k: v for …} for each parent, from the first of equal keys; a repeated key is E5004, reported and not raised."""
    per_key = df.groupBy(*parent, key.alias("_k")).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*order, value.alias("_v"))).alias("_first"))
    entries = F.sort_array(F.collect_list(F.struct(F.col("_k"), F.col("_first._v"))))
    grouped = per_key.groupBy(*parent).agg(entries.alias("_e"), F.max("_n").alias("_most"))
    return grouped.select(*parent, F.map_from_entries("_e").alias("map"), F.when(F.col("_most") > 1, F.lit("E5004")).alias("code"))


def group(df: DataFrame, key: Column, **aggregates: Column) -> DataFrame:
    """{k: agg([x for x in xs if x.g == k]) for k in unique keys}"""
    return df.groupBy(key.alias("key")).agg(*[a.alias(n) for n, a in aggregates.items()])


def correlated_count(outer: DataFrame, key: str, inner: DataFrame, inner_key: str, name: str = "n") -> DataFrame:
    """outer with count([y for y in inner if y.k == x.k])"""
    counts = inner.groupBy(F.col(inner_key).alias("_k")).agg(F.count(F.lit(1)).alias("_n"))
    return outer.join(counts, outer[key] == counts["_k"], "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_k", "_n")


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each group: an aggregate over one row's struct where the order is ascending, so tasks send one row a group."""
    from pyspark.sql.window import Window

    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def concat(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def members_of(df: DataFrame, column: str, collection: DataFrame, key: str, negate: bool = False) -> DataFrame:
    """[x for x in df if x in collection], or not in it; rows of df keep their number."""
    right = collection.select(F.col(key).alias("_k"))
    return df.join(right, df[column] == F.col("_k"), "left_anti" if negate else "left_semi")
