"""Values, absence, and errors of expressions, on rows that are written out here."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pactum.functions import std
from pactum.functions import units as U
from pactum.plans.expr import E, Range, col, float_text, if_, lift, match, optional, template


def one(spark, e, **values):
    schema = ", ".join(f"{n} {t}" for n, (t, _) in values.items()) or "x int"
    df = spark.createDataFrame([tuple(v for _, v in values.values()) or (1,)], schema)
    r = df.select(e.v.alias("v"), e.code.alias("code"), e.is_absent.alias("absent"), e.is_bad.alias("bad")).first()
    return r.v, r.code, r.absent, r.bad


@pytest.mark.parametrize(
    ("e", "v", "code"),
    [
        (lambda: lift(-7) / 2, -3, None),
        (lambda: lift(-7) % 2, -1, None),
        (lambda: lift(7) / 0, None, "E5001"),
        (lambda: lift(1.0) / 0.0, None, "E5001"),
        (lambda: lift(1e308) * 10.0, None, "E5002"),
        (lambda: lift(1 << 62) * 4, None, "LIMIT"),
        (lambda: lift(1 << 62).wide() * 4, Decimal(1 << 64), None),
        (lambda: lift(1 << 64) * -(1 << 62) + 1, Decimal(1 - (1 << 126)), "LIMIT" if 1 << 126 >= 10**38 else None),
        (lambda: lift(10**37) * 100, None, "LIMIT"),
        (lambda: lift(-(10**30) - 7) / 10, Decimal(-(10**29)), None),
        (lambda: lift(-(10**30) - 7) % 10, Decimal(-7), None),
        (lambda: lift(10**37) / -1, Decimal(-(10**37)), None),
        (lambda: lift(10**30) / 0, None, "E5001"),
        (lambda: lift(10**30) > 5, True, None),
        (lambda: lift(3) << 4, 48, None),
        (lambda: lift(3) << -1, None, "E5003"),
        (lambda: lift(1) << 63, None, "LIMIT"),
        (lambda: lift(-5) >> 1, -3, None),
        (lambda: ~lift(5), -6, None),
        (lambda: std.clog2(lift(1)), 0, None),
        (lambda: std.clog2(lift(8)), 3, None),
        (lambda: std.clog2(lift(9)), 4, None),
        (lambda: std.clog2(lift(0)), None, "E5008"),
        (lambda: std.round_(lift(2.5)), 2, None),
        (lambda: std.round_(lift(-3.5)), -4, None),
        (lambda: std.int_of(lift(1.5)), None, "E5008"),
        (lambda: std.int_of(lift(2.0)), 2, None),
        (lambda: std.floor(lift(-1.5)), -2, None),
        (lambda: std.sum_(E(F.array().cast("array<double>"), "array"), "float"), 0.0, None),
        (lambda: std.join(std.split(lift("a.b..c"), "."), "|"), "a|b||c", None),
        (lambda: std.split(lift("ab"), lift("")), None, "E5008"),
        (lambda: lift([1, 2]).at(2, "int"), None, "E5005"),
        (lambda: std.count(Range(lift(3), lift(0)).values()), 0, None),
        (lambda: if_(lift(True), 1, lift(1) / 0), 1, None),
        (lambda: lift(False).and_(lift(1) / 0 > 1), False, None),
        (lambda: lift(True).or_(lift(1) / 0 > 1), True, None),
        (lambda: match(lift("b"), [("a", 1), (["b", "c"], 2)], 3), 2, None),
        (lambda: template("x=", 1, " ", 2.0, " ", True), "x=1 2.0 true", None),
        (lambda: lift("a\n").matches("a"), False, None),
        (lambda: std.length(lift("é🙂")), 2, None),
        (lambda: std.join(std.sort_by(lift(["bb", "a", "cc", "d"]), std.length, "string"), ""), "adbbcc", None),
        (lambda: std.join(std.unique(lift([3, 1, 3, 2, 1])), ""), "312", None),
        (lambda: lift(None) == None, True, None),  # noqa: E711
    ],
)
def test_values_and_codes(spark, e, v, code):
    got = one(spark, e())
    assert got[:2] == (v, code)


def test_root_cause_only(spark):
    bad = lift(1) / 0
    e = (bad + 1) * 2
    assert one(spark, e) == (None, "E5001", False, True)


def test_absence_is_not_null(spark):
    x = optional("x", "int")
    assert one(spark, x, x=("int", None)) == (None, None, True, False)
    assert one(spark, x.else_(5), x=("int", None))[0] == 5
    assert one(spark, x.present(), x=("int", 3))[0] is True
    m = E(F.create_map(F.lit("a"), F.lit(None).cast("int")), "map")
    assert one(spark, m.at("a"))[2] is False and one(spark, m.at("b"))[2] is True


def test_absence_must_be_narrowed(spark):
    x = optional("x", "int")
    with pytest.raises(TypeError, match="E4050"):
        x + 1
    e = x.present().and_(x.known() > 3)
    assert one(spark, e, x=("int", None))[0] is False and one(spark, e, x=("int", 5))[0] is True
    assert one(spark, if_(x.present(), x.known() * 2, 0), x=("int", None))[0] == 0


def test_plan_time_refusals(spark):
    with pytest.raises(TypeError, match="E4072"):
        U.unit(1, "m") + U.unit(1, "s")
    with pytest.raises(TypeError, match="E4020"):
        lift(1) + lift(1.0)
    with pytest.raises(ValueError, match="E4101"):
        match(col("x", "string"), [("a", 1), ("a", 2)])
    with pytest.raises(ValueError, match="E5004"):
        std.spread({"a": lift(1)}, {"a": lift(2)})


def test_float_text(spark):
    known = {1.0: "1.0", 1e21: "1e+21", 1e20: "100000000000000000000.0", 123456789.5: "123456789.5", 1e-6: "0.000001", 1.5e-7: "1.5e-7", -0.5: "-0.5", 1.25e10: "12500000000.0", 0.1: "0.1", -1.5e300: "-1.5e+300", 0.0: "0.0", 12345678.9: "12345678.9"}
    df = spark.createDataFrame([(k,) for k in known], "x double")
    assert {r.x: r.t for r in df.select("x", float_text(F.col("x")).alias("t")).collect()} == known


def test_unit_catalogue():
    c = U.catalogue()
    assert len(c) == 7 + 9 + 3 + 16 * 20 + 24 - 1
    assert c["ms"][1] == 1e-3 and c["GiB"][1] == 8 * 2**30 and c["mg"] == ((("Mass", 1),), 1e-6) and c["daN"][1] == 10.0
    assert "kkg" not in c and "mB" not in c


def test_ranges_beyond_64_bits(spark):
    """A declared range that needs them gives a member 38 digits, in tables and in documents."""
    from pactum.operators import model as M
    from pactum.operators import nested

    member = M.rng(0, 1 << 64, open=True)
    assert member.kind == "wide" and M.width(64, signed=False).kind == "wide" and M.width(64).kind == "int"
    record = M.Record("R", {"n": M.Member("required", member), "twice": M.Member("derived", None, lambda m: m["n"] * 2)})
    df = spark.sql("select 1 as k, cast('18446744073709551615' as decimal(38,0)) as n union all select 2, cast('18446744073709551616' as decimal(38,0)) union all select 3, 5")
    got = {r.k: (r.n, r.twice) for r in record.evaluate(df, F.lit("doc"), ["k"]).collect()}
    assert got == {1: (Decimal((1 << 64) - 1), Decimal((1 << 65) - 2)), 2: (None, None), 3: (Decimal(5), Decimal(10))}
    assert [(r.k, r.code, r.path) for r in record.diagnostics(df, F.lit("doc"), keep=["k"]).collect()] == [(2, "E4001", "doc.n")]
    texts = spark.createDataFrame([('{"n": 18446744073709551615}',), ('{"n": 7}',), ('{"n": 1.5}',)], "text string")
    bound = nested.bind_text(texts, "text", record).select("bound.value.twice", "bound.bad").collect()
    assert [tuple(r) for r in bound] == [(Decimal((1 << 65) - 2), False), (Decimal(14), False), (None, True)]
