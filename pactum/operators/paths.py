"""Canonical paths: their text, their segments, and their order.

A path is root(.member | [index] | ["key"])*. Paths order segment by segment,
indices as numbers and before names, a prefix before what extends it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SEGMENT = r'(\["(?:[^"\\]|\\.)*"\]|\[[0-9]+\]|\.?[A-Za-z_$][A-Za-z0-9_$]*)'


def segments(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(_SEGMENT), F.lit(1))


def path_key(path: Column) -> Column:
    """An array of (n, s) that Spark orders as paths are ordered: n is an index, or a number above all indices; s a name or key."""
    number = lambda s: F.regexp_extract(s, r"^\[([0-9]+)\]$", 1)
    name = lambda s: F.regexp_replace(s, r'^\.|^\["|"\]$', "")
    return F.transform(segments(path), lambda s: F.when(number(s) != "", F.struct(number(s).cast("long").alias("n"), F.lit("").alias("s"))).otherwise(F.struct(F.lit(-1).cast("long").alias("n"), name(s).alias("s"))))


def index(parent: Column, i: Column) -> Column:
    return F.concat(parent, F.lit("["), i.cast("string"), F.lit("]"))


def key(parent: Column, k: Column) -> Column:
    return F.concat(parent, F.lit('["'), F.regexp_replace(F.regexp_replace(k, r"\\", r"\\\\"), '"', '\\\\"'), F.lit('"]'))


def member(parent: Column, name: str) -> Column:
    return F.concat(parent, F.lit(f".{name}"))


def is_canonical(path: Column) -> Column:
    return path.rlike(rf"^[A-Za-z_$][A-Za-z0-9_$]*(?:{_SEGMENT})*\z")


def under(path: Column, root: Column) -> Column:
    """Whether a path lies below another, or is it."""
    return (path == root) | F.startswith(path, F.concat(root, F.lit("."))) | F.startswith(path, F.concat(root, F.lit("[")))
