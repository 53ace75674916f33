"""Documents against nested records, unions, maps and references, and what extends or narrows them."""

import json

import pytest
from pyspark.sql import functions as F

from pactum.functions import std
from pactum.operators import model as M
from pactum.operators import nested as N
from pactum.operators import relations
from pactum.plans import emit
from pactum.plans.expr import E, template

PORT = M.Record(
    "Port",
    {
        "kind": M.Member("required", M.literal("eth", "opt")),
        "speed": M.Member("required", M.rng(1, 400)),
        "fast": M.Member("derived", None, lambda m: m["speed"] > m["limit"]),
        "where": M.Member("derived", None, lambda m: m["$path"]),
        "up": M.Member("derived", None, lambda m: m["$parent"]["name"]),
    },
    [M.Assert("odd", lambda m: m["speed"] != 13, severity="warn")],
)
SERIAL = M.Record("Serial", {"kind": M.Member("required", M.literal("ser")), "baud": M.Member("optional", M.prim("int"))}, open=True)
NODE = M.Record(
    "Node",
    {
        "n": M.Member("derived", M.prim("int"), lambda m: std.count(m["ports"])),
        "name": M.Member("required", M.pattern("[a-z]+")),
        "limit": M.Member("defaulted", M.prim("int"), lambda m: 100),
        "ports": M.Member("required", N.Arr(N.Union((PORT, N.Union((SERIAL,)))), 1, 3)),
        "tags": M.Member("optional", N.MapOf(M.pattern("[a-z]+"), M.prim("int"))),
        "main": M.Member("optional", PORT),
        "peer": M.Member("optional", N.Ref(("$.nodes",))),
    },
)
GOOD = '{"name":"ab","ports":[{"kind":"eth","speed":200},{"kind":"ser","x":1,"baud":9}],"tags":{"a":1},"peer":"$.nodes[1]"}'


def bound(spark, *docs):
    return N.bind_text(spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "id int, text string"), "text", NODE)


def test_values(spark):
    r = bound(spark, GOOD).select(F.to_json("bound.value").alias("v"), "bound.bad").first()
    v = json.loads(r.v)
    assert not r.bad and (v["n"], v["limit"], v["peer"], v["tags"]) == (2, 100, "doc.nodes[1]", {"a": 1})
    assert v["ports"][0]["value"] == {"fast": True, "kind": "eth", "speed": 200, "up": "ab", "where": "doc.ports[0]"}
    assert v["ports"][1]["value"] == {"baud": 9, "extras": {"x": 1}, "kind": "ser"}


CASES = [
    (GOOD, []),
    ('{"name":"A","ports":[{"kind":"eth","speed":13},{"kind":"zzz"},{"kind":"opt","speed":"x","w":1}]}', [("E4001", "doc.name"), ("W6001", "doc.ports[0]"), ("E4001", "doc.ports[1]"), ("E4001", "doc.ports[2].speed"), ("E4003", "doc.ports[2].w")]),
    ('{"name":"a","ports":[{"kind":"ser"}],"tags":{"a":"q","B":2},"main":{"kind":"eth"},"peer":"$.x"}', [("E4001", 'doc.tags["B"]'), ("E4001", 'doc.tags["a"]'), ("E4002", "doc.main.speed"), ("E6002", "doc.peer")]),
    ('{"ports":[],"extra":null,"n":7,"main":5}', [("E4002", "doc.name"), ("E4001", "doc.ports"), ("E4001", "doc.main"), ("E4003", "doc.extra")]),
    ('{"name":"a","ports":[{"kind":"ser","baud":1.0}],"n":3}', [("E4001", "doc.ports[0].baud")]),  # a bad port makes n silent
    ('{"name":"a","ports":[{"kind":"ser"}],"n":3}', [("E4005", "doc.n")]),
    ("[1]", [("E4001", "doc")]),
    ("null", [("E4001", "doc")]),
    *[(x, [("E6004", "doc")]) for x in ("", "{bad", GOOD + ",", GOOD + "]", GOOD + "}", GOOD + ' , "x": 1', "1 2", '{"a":1,"a":2}', None)],
]


def test_reports_at_nested_paths(spark):
    rows = N.reports(bound(spark, *[d for d, _ in CASES]), ["id"]).orderBy("id", "seq").collect()
    for i, (doc, expected) in enumerate(CASES):
        assert [(r.code, r.path) for r in rows if r.id == i] == expected, doc


def test_check_and_render(spark):
    assert N.Model({"a": NODE}).check() == []
    twice = N.Union((PORT, M.Record("Other", {"kind": M.Member("required", M.literal("eth"))})))
    alike = N.Union((PORT, M.Record("Other", {"x": M.Member("required", M.literal("eth"))})))
    assert N.Model({"a": twice, "b": M.Record("R", {"x": M.Member("required", N.Arr(alike))})}).check() == ["E4014", "E4013"]
    docs = spark.createDataFrame([(1, '{"size":[1,2],"who":"x"}'), (2, "{}")], "id int, text string")
    r = M.Record("R", {"who": M.Member("required", M.prim("string")), "size": M.Member("required", N.Arr(M.prim("int"))), "none": M.Member("optional", M.prim("int"))})
    assert [(x.id, x.rendered) for x in N.Model({"r": r}).render({"r": docs}, "r").collect()] == [(1, '{"who":"x","size":[1,2]}')]
    with pytest.raises(KeyError, match="E5006"):
        N.Model({"r": r}).validate({})


def test_members_wait_for_what_they_read(spark):
    r = M.Record("R", {"sum": M.Member("derived", None, lambda m: (m["net"] + 1) + m["extra"]), "net": M.Member("derived", None, lambda m: m["x"] * 2), "extra": M.Member("derived", None, lambda m: m["net"] + m["x"]), "x": M.Member("required", M.prim("int"))})
    assert r.order() == ["x", "net", "extra", "sum"]
    assert r.evaluate(spark.createDataFrame([(3,)], "x long"), F.lit("d")).first()["sum"] == 16
    with pytest.raises(ValueError, match="E4113: a -> b -> a"):
        M.Record("R", {"a": M.Member("derived", None, lambda m: m["b"]), "b": M.Member("derived", None, lambda m: m["a"])}).order()


def test_extend_only_narrows():
    base = M.Record("B", {"n": M.Member("required", M.rng(0, 10)), "e": M.Member("required", M.prim("int").where("even", lambda x: x % 2 == 0))})
    assert base.extend("S", {"n": M.Member("required", M.rng(2, 5))}).members["n"].type.name == "2..5"
    for wrong in (M.prim("string"), M.rng(0, 11), M.prim("int"), None):
        with pytest.raises(TypeError, match="E4031"):
            base.extend("S", {"n": M.Member("required", wrong)})
    with pytest.raises(TypeError, match="E4031"):
        base.extend("S", {"e": M.Member("required", M.prim("int"))})


def test_generics(spark):
    bounded = M.generic("Bounded", {"t": M.prim("int"), "n": M.rng(0, 9)}, lambda t, n: t & M.rng(0, n))
    assert bounded(t=M.prim("int"), n=3) is bounded(t=M.prim("int"), n=3)
    for args in ({"t": M.prim("string"), "n": 3}, {"t": M.prim("int"), "n": 10}):
        with pytest.raises(TypeError, match="E4027"):
            bounded(**args)


def test_update_and_templates(spark):
    large = M.Diagnostic("large", lambda n: template("got ", n), "info")
    r = M.Record("R", {"n": M.Member("required", M.prim("int")), "d": M.Member("derived", None, lambda m: m["n"] * 2)}, [M.Assert("small", lambda m: m["d"] < 5, template=large, args=lambda m: (m["d"],))])
    df = spark.createDataFrame([(1, 4, None), (2, 1, 2)], "id int, n long, d long")
    assert [tuple(x) for x in r.update(df, {"n": lambda m: m["n"] + m["d"]}, F.lit("p"), ["id"]).orderBy("id").collect()] == [(1, 12, 24), (2, 3, 6)]
    assert [(x.code, x.message) for x in r.diagnostics(df, F.lit("p")).collect()] == [("I6001", "got 8")]
    with pytest.raises(TypeError, match="E4034"):
        r.update(df, {"d": 1}, F.lit("p"))


def test_canonical_json_of_any_value(spark):
    df = spark.createDataFrame([(["a", 'b"c', None], [1e21, 0.5], {"k": [1]}, (1, None, True))], "xs array<string>, fs array<double>, m map<string,array<int>>, s struct<a:int,b:int,c:boolean>")
    doc = {n: E(F.col(n), k) for n, k in (("xs", "array"), ("fs", "array"), ("m", "map"), ("s", "record"))}
    assert df.select(emit.canonical(doc, df).alias("d")).first().d == '{"xs":["a","b\\"c",null],"fs":[1e+21,0.5],"m":{"k":[1]},"s":{"a":1,"c":true}}'


def test_growth_is_bounded_by_rounds_or_by_itself(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(12)], "a long, b long")
    start = spark.createDataFrame([(0,)], "k long")
    step = lambda found: found.join(edges, found["k"] == edges["a"]).select(F.col("b").alias("k"))
    rows, rounds, code = relations.grow(start, step, "k")
    assert (rows.count(), rounds, code) == (13, 12, None)
    assert relations.grow(start, step, "k", 8)[1:] == (8, "E5009") and relations.grow(start, step, "k", 12)[2] is None
