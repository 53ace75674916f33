"""References between collections of records: reading through, integrity, reverse queries, and rounds.

Collections are tables keyed by canonical paths (or by any key that names a place).
Joins carry no hint: adaptive execution broadcasts a side only below its threshold
and splits skewed partitions of the others.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.storage import materialize

#: Rounds after which a relationship that still changes is reported.
MOST_ROUNDS = 8


def deref(df: DataFrame, ref: str, targets: DataFrame, place: str, prefix: str = "") -> DataFrame:
    """df with the members of what ref names, their names prefixed; null where nothing is there."""
    right = targets.select(*[F.col(c).alias(f"{prefix}{c}") for c in targets.columns])
    return df.join(right, df[ref] == right[f"{prefix}{place}"], "left")


def dangling(df: DataFrame, ref: str, targets: DataFrame, place: str) -> DataFrame:
    """The rows whose ref is set and names nothing (E6002)."""
    right = targets.select(F.col(place).alias("_place"))
    return df.filter(F.col(ref).isNotNull()).join(right, df[ref] == F.col("_place"), "left_anti")


def referrers(targets: DataFrame, place: str, sources: DataFrame, ref: str, source_place: str, order: Column | None = None, name: str = "referrers") -> DataFrame:
    """targets with the distinct places of the sources that refer to each, in order. ref: a reference, or an array of them."""
    single = dict(sources.dtypes)[ref].startswith("array")
    edges = sources.select(F.explode(ref).alias("_to") if single else F.col(ref).alias("_to"), F.col(source_place).alias("_from"), (F.col(source_place) if order is None else order).alias("_order")).filter("_to is not null").distinct()
    gathered = edges.groupBy("_to").agg(F.sort_array(F.collect_list(F.struct("_order", "_from"))).alias("_found"))
    out = targets.join(gathered, targets[place] == gathered["_to"], "left")
    return out.withColumn(name, F.coalesce(F.transform("_found", lambda x: x["_from"]), F.array().cast(f"array<{dict(sources.dtypes)[source_place]}>"))).drop("_to", "_found")


def fan_in(targets: DataFrame, place: str, sources: DataFrame, ref: str, name: str = "fan_in") -> DataFrame:
    """targets with the number of sources that refer to each: counted before the join, so no list is made."""
    counts = sources.filter(F.col(ref).isNotNull()).groupBy(F.col(ref).alias("_to")).agg(F.count(F.lit(1)).alias("_n"))
    return targets.join(counts, targets[place] == counts["_to"], "left").withColumn(name, F.coalesce("_n", F.lit(0)).cast("long")).drop("_to", "_n")


def fingerprint(edges: DataFrame) -> tuple:
    """Equal for equal sets of edges, whatever their order."""
    h = F.xxhash64(*edges.columns)
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first())


def settle(start: DataFrame, step: Callable[[DataFrame], DataFrame], most: int = MOST_ROUNDS) -> tuple[DataFrame, int, str | None]:
    """Repeat edges -> edges until they no longer change.

    Gives the last edges, the number of rounds, and E5009 if they repeat without
    settling or still change after the last round. Each round is written, which cuts
    its lineage; only fingerprints come to the driver.
    """
    now = materialize(start, "round")
    seen = [fingerprint(now)]
    for n in range(1, most + 1):
        now = materialize(step(now), "round")
        mark = fingerprint(now)
        if mark == seen[-1]:
            return now, n, None
        if mark in seen:
            return now, n, "E5009"
        seen.append(mark)
    return now, most, "E5009"


def grow(start: DataFrame, step: Callable[[DataFrame], DataFrame], key: str, most: int | None = None) -> tuple[DataFrame, int, str | None]:
    """Rows that follow from start, a round at a time, each key once: where it is found first.

    step gives what follows from the rows that the last round added; only those are
    looked at again. Gives all rows, the number of rounds, and E5009 if rows are still
    added after `most` rounds.
    """
    new = materialize(start, "round")
    rounds, found = 0, [new]
    while most is None or rounds < most:
        known = found[0].select(key)
        for part in found[1:]:
            known = known.unionByName(part.select(key))
        new = materialize(step(new).dropDuplicates([key]).join(known, key, "left_anti").select(*start.columns), "round")
        if not new.limit(1).count():
            break
        rounds += 1
        found.append(new)
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    still = most is not None and rounds == most and step(new).join(every.select(key), key, "left_anti").limit(1).count() > 0
    return every, rounds, "E5009" if still else None


def on_cycles(waits: DataFrame, place: str, ref: str) -> DataFrame:
    """The places that are reached again from themselves, where each place refers to one other at most.

    Each round doubles the number of references that an edge stands for, and keeps the
    places at which an edge ends. What refers to a cycle from outside goes, so the rounds
    grow with the logarithm of the longest way into a cycle. If none goes, every place
    that is left is the end of exactly one edge, and so on a cycle. Each round is written,
    never larger than the last; only counts come to the driver.
    """
    now = materialize(waits.select(F.col(place).alias("a"), F.col(ref).alias("b")).filter("a is not null and b is not null").distinct(), "cycle")
    left = now.count()
    while left:
        kept = now.join(now.select(F.col("b").alias("a")).distinct(), "a", "left_semi")
        now = materialize(kept.join(now.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")), "cycle")
        before, left = left, now.count()
        if left == before:
            break
    return now.select(F.col("a").alias(place))
