"""Quality rules with thresholds that adapt to each language and source.

Each document gets counts (DataFrame functions only). For each ratio of counts a
mergeable quantile sketch is kept per (language, source): logarithmic buckets with
counts, so that sketches merge by adding counts, in any order and with the same
result. A group's thresholds are Tukey fences read from its sketch, to which that of
its language is added with the weight of `prior` documents; to that one, in turn,
that of all documents is added so. The coarser sketches are the sums of the finer
ones. The verdict joins documents with thresholds. Weights are whole numbers, so
thresholds are the same in any order of summing.

Defined results: null text has no words and fails the base rules; null lang or
source form groups of their own; rows that repeat a doc_id are judged one by one;
an empty table gives an empty result; other columns, whatever their names, are
ignored by `score` and kept by `filter_documents`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.common import SPACES, checked_broadcast, materialize, text_or_empty

WORDS_PER_WINDOW = 5


@dataclass(frozen=True)
class Ratio:
    """A measured ratio; slack is the least width of the fence, for groups whose values hardly differ."""

    name: str
    over: str
    under: str
    slack: float
    low: bool = False


RATIOS = (
    Ratio("symbols", "n_symbols", "n_words", 0.1),
    Ratio("shouts", "n_shouts", "n_words", 0.1),
    Ratio("capitals", "n_capitals", "word_chars", 0.1),
    Ratio("repeats", "n_repeat_words", "n_words", 0.05),
    Ratio("same_lines", "n_dup_lines", "n_lines", 0.1),
    Ratio("word_length", "word_chars", "n_words", 2.0, low=True),
)


@dataclass(frozen=True)
class Rules:
    """Base limits, and how fences are drawn: quartiles plus `reach` times their distance (or slack). A document weighs `unit`."""

    min_words: int = 10
    max_repeat_percent: int = 20
    reach: float = 3.0
    prior: int = 200
    unit: int = 1000
    accuracy: float = 0.01
    smallest: float = 1e-4
    broadcast_rows: int = 50_000


def _count(text: Column, other: str) -> Column:
    """The code points of text that the class `other` does not hold."""
    return F.length(F.regexp_replace(text, f"{other}+", "")).cast("long")


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """`row`, which holds the columns of docs, and beside it the counts, named `_q_<count>`. Nothing shuffles.

    The steps stand in columns of their own, so that each is worked out once a row.
    """
    k = WORDS_PER_WINDOW
    t = docs.select(F.struct("*").alias("row"), text_or_empty(text).alias("_q_text"))
    t = t.withColumns(
        {
            "_q_words": F.array_remove(F.split("_q_text", f"{SPACES}+"), ""),
            "_q_lines": F.filter(F.split("_q_text", "\n"), lambda x: x.rlike("[^ \\x09-\\x0D]")),
        }
    )
    t = t.withColumns({"_q_hash": F.transform("_q_words", lambda w: F.xxhash64(w)), "_q_last": F.size("_q_words") - k})
    h = F.col("_q_hash")
    t = t.withColumn("_q_windows", F.when(F.col("_q_last") > 0, F.transform(F.sequence(F.lit(0), "_q_last"), lambda i: F.xxhash64(*[F.get(h, i + j) for j in range(k)]))))
    # Equal hashes only lead to the comparison of the words themselves.
    t = t.withColumn(
        "_q_keyed",
        F.when(
            F.size(F.array_distinct("_q_windows")) < F.size("_q_windows"),
            F.sort_array(F.transform(F.sequence(F.lit(0), "_q_last"), lambda i: F.struct(F.concat_ws(" ", F.slice("_q_words", i + 1, k)).alias("k"), i.alias("p")))),
        ),
    )
    key = lambda i: F.get(F.col("_q_keyed"), i)["k"]
    t = t.withColumn(
        "_q_found",
        F.sort_array(F.transform(F.filter(F.sequence(F.lit(0), F.size("_q_keyed") - 1), lambda i: F.coalesce((key(i) == key(i - 1)) | (key(i) == key(i + 1)), F.coalesce(key(i) == key(i + 1), F.lit(False)))), lambda i: F.get(F.col("_q_keyed"), i)["p"])),
    )
    covered = F.aggregate(
        "_q_found",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["n"] + p + k - F.greatest(acc["end"], p)).alias("n"), (p + k).alias("end")),
        lambda acc: acc["n"].cast("long"),
    )
    text_of = F.col("_q_text")
    counts = {
        "n_words": F.size("_q_words").cast("long"),
        "word_chars": F.length(F.regexp_replace(text_of, f"{SPACES}+", "")).cast("long"),
        "n_symbols": _count(text_of, "[^#*$%&|<>]"),
        "n_shouts": _count(text_of, "[^!?]"),
        "n_capitals": _count(text_of, "[^\\p{Lu}]"),
        "n_lines": F.size("_q_lines").cast("long"),
        "n_dup_lines": (F.size("_q_lines") - F.size(F.array_distinct("_q_lines"))).cast("long"),
        "n_repeat_words": F.when(F.col("_q_keyed").isNull(), F.lit(0)).otherwise(covered).cast("long"),
    }
    return t.select("row", *[c.alias(f"_q_{n}") for n, c in counts.items()])


COUNTS = ("n_words", "word_chars", "n_symbols", "n_shouts", "n_capitals", "n_lines", "n_dup_lines", "n_repeat_words")


def base_failed(rules: Rules) -> Column:
    return (F.col("_q_n_words") < rules.min_words) | (100 * F.col("_q_n_repeat_words") > rules.max_repeat_percent * F.col("_q_n_words"))


def _value(r: Ratio) -> Column:
    return F.coalesce(F.try_divide(F.col(f"_q_{r.over}").cast("double"), F.col(f"_q_{r.under}").cast("double")), F.lit(0.0))


def sketches(counted: DataFrame, rules: Rules, lang: str = "lang", source: str = "source") -> DataFrame:
    """(lang, source, ratio, bucket, n): the mergeable sketches, of documents that pass the base rules. lang and source are columns of `row`.

    Bucket 0 holds values up to `smallest`, bucket i those up to smallest * gamma ** i.
    Counts are summed on the map side first, so a hot group sends each task's buckets only.
    """
    gamma = (1 + rules.accuracy) / (1 - rules.accuracy)
    entries = F.array(*[F.struct(F.lit(i).alias("ratio"), F.greatest(F.lit(0), F.ceil(F.log(F.greatest(_value(r), F.lit(rules.smallest)) / rules.smallest) / math.log(gamma))).cast("int").alias("bucket")) for i, r in enumerate(RATIOS)])
    rows = counted.filter(~base_failed(rules)).select(F.col("row")[lang].alias("lang"), F.col("row")[source].alias("source"), F.explode(entries).alias("e"))
    return rows.groupBy("lang", "source", F.col("e.ratio").alias("ratio"), F.col("e.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _blended(sketch: DataFrame, coarser: DataFrame | None, keys: list[str], rules: Rules) -> DataFrame:
    """(keys, ratio, bucket, w): the sketches of the groups that keys tell apart, with `prior` documents' worth of the coarser one.

    Rows are groups times buckets, whatever the number of documents.
    """
    own = sketch.groupBy(*keys, "ratio", "bucket").agg((F.sum("n") * rules.unit).alias("w"))
    if coarser is None:
        return own
    up = keys[:-1]
    total = F.sum("w").over(Window.partitionBy(*up, "ratio"))  # as many rows as a sketch has buckets
    share = coarser.withColumn("of", total).select(*[F.col(k).alias(f"c_{k}") for k in up], "ratio", "bucket", F.expr(f"(CAST({rules.prior * rules.unit} AS DECIMAL(20,0)) * CAST(w AS DECIMAL(18,0))) div of").alias("w"))
    groups = own.select(*keys).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"c_{k}")) for k in up]
    added = groups.join(share, on or F.lit(True)).select(*keys, "ratio", "bucket", "w")
    return own.unionByName(added).groupBy(*keys, "ratio", "bucket").agg(F.sum("w").alias("w"))


def _fences(merged: DataFrame, keys: list[str], rules: Rules) -> DataFrame:
    """A row for each group: the fences of every ratio, read from the sketch's cumulative weights."""
    gamma = (1 + rules.accuracy) / (1 - rules.accuracy)
    group = Window.partitionBy(*keys, "ratio")  # as many rows as a sketch has buckets
    summed = merged.withColumns({"upto": F.sum("w").over(group.orderBy("bucket")), "of": F.sum("w").over(group)})
    value = F.when(F.col("bucket") == 0, F.lit(0.0)).otherwise(F.lit(rules.smallest) * F.pow(F.lit(gamma), F.col("bucket")))
    quart = lambda n: F.min(F.when(4 * F.col("upto") >= n * F.col("of"), value))
    read = summed.groupBy(*keys, "ratio").agg(quart(1).alias("q1"), quart(3).alias("q3"))
    slack = F.element_at(F.array(*[F.lit(r.slack) for r in RATIOS]), F.col("ratio") + 1)
    width = rules.reach * F.greatest(F.col("q3") - F.col("q1"), slack)
    return read.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("ratio", F.struct((F.col("q1") - width).alias("low"), (F.col("q3") + width).alias("high"))))).alias("fences"))


def thresholds(sketch: DataFrame, rules: Rules) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The fences by (lang, source), by lang, and of everything. The coarser ones serve groups of which no document passes the base rules."""
    everything = _blended(sketch, None, [], rules)
    by_lang = materialize(_blended(sketch, everything, ["lang"], rules), "sketches_by_lang")
    return _fences(_blended(sketch, by_lang, ["lang", "source"], rules), ["lang", "source"], rules), _fences(by_lang, ["lang"], rules), _fences(everything, [], rules)


def judge(counted: DataFrame, rules: Rules = Rules(), lang: str = "lang", source: str = "source") -> DataFrame:
    """counted with `_q_base_failed` and `_q_kept`. `counted` is read twice: give a written table."""
    sketch = materialize(sketches(counted, rules, lang, source), "sketches")
    fine, by_lang, overall = thresholds(sketch, rules)
    t = counted
    for n, (side, keys) in enumerate(((fine, {"lang": lang, "source": source}), (by_lang, {"lang": lang}))):
        side = side.select(*[F.col(k).alias(f"_q_key_{k}") for k in keys], F.col("fences").alias(f"_q_fences_{n}"))
        on = [F.col(f"_q_key_{k}").eqNullSafe(F.col("row")[c]) for k, c in keys.items()]
        t = t.join(checked_broadcast(side, rules.broadcast_rows), on, "left").drop(*[f"_q_key_{k}" for k in keys])
    t = t.join(F.broadcast(overall.select(F.col("fences").alias("_q_fences_2"))), F.lit(True), "left")  # one row at most
    t = t.withColumn("_q_fences", F.coalesce("_q_fences_0", "_q_fences_1", "_q_fences_2"))
    outside = F.lit(False)
    for i, r in enumerate(RATIOS):
        fence = F.element_at(F.col("_q_fences"), F.lit(i))
        beyond = _value(r) > fence["high"]
        if r.low:
            beyond = beyond | (_value(r) < fence["low"])
        outside = outside | F.coalesce(beyond, F.lit(False))
    failed = base_failed(rules)
    return t.withColumns({"_q_base_failed": failed, "_q_kept": ~failed & ~outside}).drop("_q_fences", "_q_fences_0", "_q_fences_1", "_q_fences_2")


def score(docs: DataFrame, rules: Rules = Rules(), key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """A row for each row of docs: its key, its counts, `base_failed` and `kept`."""
    slim = docs.select(F.col(key).alias("key"), F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(source).alias("source"))
    counted = materialize(features(slim).withColumn("row", F.col("row").dropFields("text")), "counts")
    judged = judge(counted, rules)
    return judged.select(F.col("row.key").alias(key), *[F.col(f"_q_{c}").alias(c) for c in COUNTS], F.col("_q_base_failed").alias("base_failed"), F.col("_q_kept").alias("kept"))


def filter_documents(docs: DataFrame, rules: Rules = Rules(), text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """The rows of docs that are kept, with their own columns."""
    counted = materialize(features(docs, text), "counted")
    return judge(counted, rules, lang, source).filter("_q_kept").select("row.*")
