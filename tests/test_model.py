"""Records: one defect makes one report, in the right order."""

import pytest
from pyspark.sql import functions as F

from pactum.functions import std
from pactum.operators import model as M
from pactum.operators import paths, relations
from pactum.plans.expr import lift

CONFIG = M.Record(
    "Config",
    {
        "port": M.Member("defaulted", M.rng(1, 65535), lambda m: 8080),
        "workers": M.Member("defaulted", M.rng(1, 256), lambda m: 4),
        "host": M.Member("required", M.pattern("[a-z.]+")),
        "twice": M.Member("derived", M.prim("int"), lambda m: m["workers"] * 2),
        "share": M.Member("derived", None, lambda m: lift(100) / (m["workers"] - 4)),
    },
    [
        M.Assert("few_workers", lambda m: m["workers"] <= 64, severity="warn"),
        M.Assert("share_fits", lambda m: m["share"] < 50),
        M.Assert("open_port", lambda m: m["port"] > 1024, when=lambda m: m["host"] == "localhost"),
    ],
)
SCHEMA = "id int, port long, workers long, host string, twice long"


def reports(spark, *row, record=CONFIG):
    df = spark.createDataFrame([row], SCHEMA)
    return [(r.code, r.id, r.path) for r in M.in_order(record.diagnostics(df, F.lit("c"))).collect()]


def test_clean(spark):
    assert reports(spark, 1, None, 8, "localhost", 16) == []
    v = CONFIG.evaluate(spark.createDataFrame([(1, None, 8, "h", None)], SCHEMA), F.lit("c")).first()
    assert (v.port, v.workers, v.twice, v.share) == (8080, 8, 16, 25)


@pytest.mark.parametrize(
    ("row", "expected"),
    [
        ((1, 70000, 8, "h", None), [("E4001", None, "c.port")]),
        ((1, None, 8, None, None), [("E4002", None, "c.host")]),
        ((1, None, 999, "h", None), [("E4001", None, "c.workers")]),  # what depends on it is silent
        ((1, None, 8, "h", 17), [("E4005", None, "c.twice")]),
        ((1, None, None, "h", None), [("E5001", None, "c.share")]),  # the default makes the division fail, once
        ((1, None, 100, "h", None), [("W6001", "Config.few_workers", "c")]),
        ((1, None, 5, "h", None), [("E6001", "Config.share_fits", "c")]),
        ((1, 80, 8, "localhost", None), [("E6001", "Config.open_port", "c")]),
        ((1, 0, 300, None, None), [("E4002", None, "c.host"), ("E4001", None, "c.port"), ("E4001", None, "c.workers")]),
    ],
)
def test_one_defect_one_report(spark, row, expected):
    assert reports(spark, *row) == expected


def test_cycle_and_weakening(spark):
    r = M.Record("R", {"a": M.Member("derived", None, lambda m: m["b"]), "b": M.Member("derived", None, lambda m: m["a"])})
    with pytest.raises(ValueError, match="E4113"):
        r.order()
    with pytest.raises(TypeError, match="E4032"):
        CONFIG.extend("Loose", {"host": M.Member("optional", M.prim("string"))})


def test_hidden_and_unknown(spark):
    r = M.Record("R", {"x": M.Member("hidden", None, lambda m: lift(1))})
    df = spark.createDataFrame([(5,)], "x int")
    assert [x.code for x in r.diagnostics(df, F.lit("r")).collect()] == ["E4006"]
    assert r.evaluate(df, F.lit("r"), ["x"]).columns == ["x"]
    closed = M.Record("R", {"y": M.Member("optional", M.prim("int"))})
    found = closed.diagnostics(df, F.lit("r"), unknown=F.array(F.lit("y"), F.lit("z"))).collect()
    assert [(x.code, x.path) for x in found] == [("E4003", "r.z")]


def test_paths_order_by_segment(spark):
    names = ["a", "a.b", "a[2]", "a[10]", 'a["k"]', "a.b[1]", "b", 'a["k"].x']
    df = spark.createDataFrame([(n,) for n in names], "p string").repartition(4)
    got = [r.p for r in df.orderBy(paths.path_key(F.col("p"))).collect()]
    assert got.index("a") == 0 and got.index("a[2]") < got.index("a[10]") and got[-1] == "b" and got.index('a["k"]') < got.index('a["k"].x')
    under = {r.p: r.u for r in df.select("p", paths.under(F.col("p"), F.lit("a.b")).alias("u")).collect()}
    assert under["a.b"] and under["a.b[1]"] and not under["a"] and not under['a["k"]']


def test_rounds(spark):
    start = spark.createDataFrame([(1,)], "k long")
    grow = lambda d: d.unionByName(d.select((F.col("k") + 1).alias("k"))).filter("k <= 4").distinct()
    done, n, code = relations.settle(start, grow)
    assert sorted(r.k for r in done.collect()) == [1, 2, 3, 4] and n == 4 and code is None
    flip = lambda d: d.select((3 - F.col("k")).alias("k"))
    assert relations.settle(start, flip)[1:] == (2, "E5009")
    assert relations.settle(start, lambda d: d.select((F.col("k") + 1).alias("k")), most=3)[1:] == (3, "E5009")


def test_predicates(spark):
    t = M.prim("int").where("even", lambda x: x % 2 == 0).where("at_least(4)", std.at_least(4))
    df = spark.createDataFrame([(1,), (2,), (4,), (None,)], "x long")
    assert [r.bad for r in df.select(t.refuses(F.col("x")).alias("bad")).collect()] == [True, True, False, True]
    assert [r.bad for r in df.select(t.opt().refuses(F.col("x")).alias("bad")).collect()] == [True, True, False, False]


def test_an_error_that_is_met_twice_is_reported_once(spark):
    r = M.Record("R", {"x": M.Member("required", M.prim("int")), "y": M.Member("derived", None, lambda m: lift(1) / m["x"] + lift(2) / m["x"])}, [M.Assert("a", lambda m: m["y"] > 0)])
    df = spark.createDataFrame([(0,)], "x long")
    assert [(d.code, d.path) for d in r.diagnostics(df, F.lit("r")).collect()] == [("E5001", "r.y")]
