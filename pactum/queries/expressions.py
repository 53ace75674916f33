"""Expression operators and standard functions over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.functions import std
from pactum.functions import units as U
from pactum.plans.expr import E, Range, col, if_, lift, match, template
from pactum.queries.registry import query


def KEY():
    return col("p_partkey", "int")


def SIZE():
    return col("p_size", "int")


def PRICE():
    return col("p_retailprice", "float")


def TYPE():
    return col("p_type", "string")


def NAME():
    return col("p_name", "string")

# A member that is absent in every fifth row or so.

def FIFTH():
    return E(F.nullif(F.col("p_size") % 5, F.lit(0)), "int", F.col("p_size") % 5 == 0)


def part(t, **columns: E | object):
    return t.part.select("p_partkey", *[(c.v if isinstance(c, E) else c).alias(n) for n, c in columns.items()])


@query("exp_int_arith", "SELECT p_partkey, CAST(p_size AS BIGINT) + p_partkey AS a, p_size - p_partkey AS b, CAST(p_size AS BIGINT) * p_partkey - 7 AS c FROM part")
def _(t):
    return part(t, a=SIZE() + KEY(), b=SIZE() - KEY(), c=SIZE() * KEY() - 7)


WIDE = """
WITH p AS (SELECT p_partkey, (p_partkey::HUGEINT + 4611686018427387904) * (p_size + 1099511627776) AS n FROM part)
SELECT p_partkey, CAST(n AS VARCHAR) AS product, CAST(-n // 1000000007 AS VARCHAR) AS quotient, CAST(-n % 1000000007 AS VARCHAR) AS remainder, CAST(NULL AS VARCHAR) AS beyond, 'LIMIT' AS code FROM p
"""


@query("exp_int_wide", WIDE)
def _(t):
    n = (KEY() + (1 << 62)).wide() * (SIZE() + (1 << 40))
    over = n * 10**20
    return part(t, product=std.string_of(n), quotient=std.string_of(-n / 1000000007), remainder=std.string_of(-n % 1000000007), beyond=std.string_of(over), code=over.code)


@query("exp_float_arith", "SELECT p_partkey, p_retailprice + 0.25::DOUBLE AS a, p_retailprice - 1.5::DOUBLE AS b, p_retailprice * p_retailprice AS c, CAST(NULL AS DOUBLE) AS d, 'E5002' AS code FROM part")
def _(t):
    over = (PRICE() + 1.0) * 1e308 * 1e308
    return part(t, a=PRICE() + 0.25, b=PRICE() - 1.5, c=PRICE() * PRICE(), d=over, code=over.code)


@query("exp_concat", "SELECT p_partkey, p_name || '/' || p_type AS s FROM part")
def _(t):
    return part(t, s=NAME() + "/" + TYPE())


@query("exp_int_div", "SELECT p_partkey, CAST(trunc((p_size - 25) / 7.0) AS BIGINT) AS q, CASE WHEN p_size % 3 <> 0 THEN CAST(p_size // (p_size % 3) AS BIGINT) END AS r, CASE WHEN p_size % 3 = 0 THEN 'E5001' END AS code FROM part")
def _(t):
    r = SIZE() / (SIZE() % 3)
    return part(t, q=(SIZE() - 25) / 7, r=r, code=r.code)


@query("exp_mod", "SELECT p_partkey, CAST((p_size - 25) % 7 AS BIGINT) AS m, CASE WHEN p_size % 4 = 0 THEN 'E5001' END AS code FROM part")
def _(t):
    bad = SIZE() % (SIZE() % 4)
    return part(t, m=(SIZE() - 25) % 7, code=bad.code)


@query("exp_float_div", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_retailprice / CAST(p_size % 5 AS DOUBLE) END AS q, CASE WHEN p_size % 5 = 0 THEN 'E5001' END AS code FROM part")
def _(t):
    q = PRICE() / std.float_of(SIZE() % 5)
    return part(t, q=q, code=q.code)


@query("exp_unary", "SELECT p_partkey, -CAST(p_size AS BIGINT) AS a, ~CAST(p_size AS BIGINT) AS b, NOT (p_size > 10) AS c, -p_retailprice AS d FROM part")
def _(t):
    return part(t, a=-SIZE(), b=~SIZE(), c=~(SIZE() > 10), d=-PRICE())


@query("exp_bitwise", "SELECT p_partkey, p_partkey & p_size AS a, p_partkey | p_size AS b, xor(p_partkey, CAST(p_size AS BIGINT)) AS c FROM part")
def _(t):
    return part(t, a=KEY().bits("&", SIZE()), b=KEY().bits("|", SIZE()), c=KEY().bits("^", SIZE()))


@query("exp_shift", "SELECT p_partkey, p_partkey * CAST(pow(2, p_size % 8) AS BIGINT) AS a, p_partkey >> (p_size % 8) AS b, CASE WHEN p_size < 10 THEN 'E5003' WHEN p_size > 43 THEN NULL END AS code FROM part")
def _(t):
    neg = lift(1) << (SIZE() - 10)
    return part(t, a=KEY() << (SIZE() % 8), b=KEY() >> (SIZE() % 8), code=neg.code)


@query("exp_compare", "SELECT p_partkey, p_size < 10 AS a, p_size <= 10 AS b, p_retailprice > 1000 AS c, p_name >= p_type AS d FROM part")
def _(t):
    return part(t, a=SIZE() < 10, b=SIZE() <= 10, c=PRICE() > 1000.0, d=NAME() >= TYPE())


@query("exp_equality", "SELECT o_orderkey, (o_custkey = o_orderkey) AS a, TRUE AS b, (o_orderstatus = 'F') AS c FROM orders")
def _(t):
    rec = lambda a, b: E(F.struct(F.col(a).alias("x"), F.col(b).alias("y")), "record")
    m = lambda *ks: E(F.map_from_arrays(F.array(*[F.lit(k) for k in ks]), F.array(*[F.lit(ord(k)) for k in ks])), "map")
    return t.orders.select("o_orderkey", (rec("o_orderkey", "o_custkey") == rec("o_custkey", "o_orderkey")).v.alias("a"), (m("a", "b") == m("b", "a")).v.alias("b"), (col("o_orderstatus", "string") == "F").v.alias("c"))


@query("exp_place_equality", "SELECT o_orderkey, o_custkey % 10 = o_orderkey % 10 AS same FROM orders")
def _(t):
    place = lambda c: E(F.concat(F.lit("doc.items["), (F.col(c) % 10).cast("string"), F.lit("]")), "string")
    return t.orders.select("o_orderkey", (place("o_custkey") == place("o_orderkey")).v.alias("same"))


@query("exp_in_array", "SELECT p_partkey, p_size IN (1, 5, 9, 33) AS a, p_type IN ('x', 'y') AS b FROM part")
def _(t):
    return part(t, a=std.int_of(SIZE()).is_in([1, 5, 9, 33]), b=TYPE().is_in(["x", "y"]))


@query("exp_in_range", "SELECT p_partkey, p_size BETWEEN 5 AND 40 AS a, p_size >= 5 AND p_size < 40 AS b FROM part")
def _(t):
    return part(t, a=SIZE().is_in(Range(lift(5), lift(40))), b=SIZE().is_in(Range(lift(5), lift(40), open=True)))


@query("exp_in_map", "SELECT o_orderkey, o_orderstatus IN ('F', 'O') AS a FROM orders")
def _(t):
    names = E(F.create_map(F.lit("F"), F.lit("final"), F.lit("O"), F.lit("open")), "map")
    return t.orders.select("o_orderkey", col("o_orderstatus", "string").is_in(names).v.alias("a"))


@query("exp_presence", "SELECT p_partkey, p_size % 5 <> 0 AS here FROM part")
def _(t):
    return part(t, here=FIFTH().present())


@query("exp_matches", "SELECT p_partkey, regexp_full_match(p_type, '[A-Z]+ [A-Z]+.*') AS a, regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS b FROM part")
def _(t):
    return part(t, a=TYPE().matches("[A-Z]+ [A-Z]+.*"), b=col("p_brand", "string").matches("Brand#[0-9]{2}"))


@query("exp_short_circuit", "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN FALSE ELSE 10 // (p_size % 3) > 5 END AS a, CASE WHEN p_size % 3 = 0 THEN TRUE ELSE 10 // (p_size % 3) > 5 END AS b, CAST(NULL AS VARCHAR) AS code FROM part")
def _(t):
    m = SIZE() % 3
    a = (m != 0).and_(lift(10) / m > 5)
    b = (m == 0).or_(lift(10) / m > 5)
    return part(t, a=a, b=b, code=F.coalesce(a.code, b.code))


@query("exp_nullish", "SELECT p_partkey, CAST(coalesce(nullif(p_size % 5, 0), 9) AS BIGINT) AS v FROM part")
def _(t):
    return part(t, v=E(FIFTH().v.cast("long"), "int", FIFTH().absent).else_(9))


@query("exp_if", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'even' ELSE 'odd' END AS s, CASE WHEN p_size % 3 = 0 THEN 0 ELSE CAST(100 // (p_size % 3) AS BIGINT) END AS v, CAST(NULL AS VARCHAR) AS code FROM part")
def _(t):
    v = if_(SIZE() % 3 == 0, 0, lift(100) / (SIZE() % 3))
    return part(t, s=if_(SIZE() % 2 == 0, "even", "odd"), v=v, code=v.code)


EVENT = """CASE event_type WHEN 'purchase' THEN {p} WHEN 'click' THEN {c} ELSE {e} END"""


@query("exp_match_union", f"SELECT event_id, {EVENT.format(p='value', c='0.5::DOUBLE', e='0.0::DOUBLE')} AS weight FROM events")
def _(t):
    kind = col("event_type", "string")
    return t.events.select("event_id", match(kind, [("purchase", col("value", "float")), ("click", 0.5), (["view", "signup", "error"], 0.0)]).v.alias("weight"))


@query("exp_match_literal", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1::BIGINT WHEN 'O' THEN 2 ELSE 0 END AS n FROM orders")
def _(t):
    return t.orders.select("o_orderkey", match(col("o_orderstatus", "string"), [("F", 1), ("O", 2)], 0).v.alias("n"))


@query("exp_template", "SELECT p_partkey, 'part ' || p_partkey || ' of size ' || p_size || ': ' || (p_size > 10)::VARCHAR AS s FROM part")
def _(t):
    return part(t, s=template("part ", KEY(), " of size ", SIZE(), ": ", SIZE() > 10))


@query("exp_range_iter", "SELECT p_partkey, coalesce(list_sum(range(3, p_size % 7)), 0)::BIGINT AS s, len(range(3, p_size % 7)) AS n FROM part")
def _(t):
    xs = Range(lift(3), SIZE() % 7, open=True).values()
    return part(t, s=std.sum_(xs, "int"), n=std.count(xs))


@query("exp_unit_literal", "SELECT p_partkey, CAST(p_size AS DOUBLE) * (10.0::DOUBLE * 0.001::DOUBLE) AS v FROM part")
def _(t):
    return part(t, v=std.float_of(SIZE()) * U.unit(10, "ms"))


@query("exp_quantity_add", "SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000.0::DOUBLE + 5.0::DOUBLE AS v, CAST(p_size AS DOUBLE) * 1000.0::DOUBLE < 20000.0::DOUBLE AS near FROM part")
def _(t):
    d = U.quantity(SIZE(), "km")
    return part(t, v=d + U.unit(5, "m"), near=d < U.unit(20, "km"))


@query("exp_quantity_mul", "SELECT p_partkey, CAST(p_size AS DOUBLE) * 1000.0::DOUBLE / 60.0::DOUBLE AS speed, CAST(p_size AS DOUBLE) * 1000.0::DOUBLE / 1000.0::DOUBLE AS ratio FROM part")
def _(t):
    d = U.quantity(SIZE(), "km")
    ratio = d / U.unit(1, "km")
    assert ratio.kind == "float" and (d / U.unit(60, "s")).dim == U.dimension(Length=1, Time=-1)
    return part(t, speed=d / U.unit(60, "s"), ratio=ratio)


@query("exp_pipeline", "SELECT p_partkey, greatest(abs(p_size - 25), 3)::BIGINT AS v FROM part")
def _(t):
    return part(t, v=(SIZE() - 25).pipe(std.abs_).pipe(std.max_, 3))


@query("exp_func_call", "SELECT p_partkey, CAST(p_size AS BIGINT) * p_size + 1 AS v FROM part")
def _(t):
    square = lambda x: x * x
    return part(t, v=square(SIZE()) + 1)


@query("exp_lambda", "SELECT p_partkey, list_sum(list_transform([1, 2, 3], lambda x: x * p_size))::BIGINT AS v FROM part")
def _(t):
    return part(t, v=std.sum_(std.map_(lift([1, 2, 3]), lambda x: x * SIZE(), "int"), "int"))


# -- standard functions ------------------------------------------------------------


@query("fn_abs", "SELECT p_partkey, abs(p_size - 25)::BIGINT AS a, abs(p_retailprice - 1000.0::DOUBLE) AS b FROM part")
def _(t):
    return part(t, a=std.abs_(SIZE() - 25), b=std.abs_(PRICE() - 1000.0))


@query("fn_min_max", "SELECT p_partkey, least(p_size, 20)::BIGINT AS a, greatest(p_size, 20)::BIGINT AS b FROM part")
def _(t):
    wide = E(SIZE().v.cast("long"), "int")
    return part(t, a=std.min_(wide, 20), b=std.max_(wide, 20))


@query("fn_clog2", "SELECT p_partkey, CASE WHEN p_size = 1 THEN 0 ELSE length(trim(leading '0' FROM bin(p_size - 1))) END::BIGINT AS k, CASE WHEN p_size - 3 < 1 THEN 'E5008' END AS code FROM part")
def _(t):
    return part(t, k=std.clog2(SIZE()), code=std.clog2(SIZE() - 3).code)


@query("fn_floor_ceil", "SELECT p_partkey, floor(p_retailprice / 7.0::DOUBLE)::BIGINT AS f, ceil(p_retailprice / -7.0::DOUBLE)::BIGINT AS c FROM part")
def _(t):
    return part(t, f=std.floor(PRICE() / 7.0), c=std.ceil(PRICE() / -7.0))


@query("fn_round_even", "SELECT p_partkey, CAST(round_even(p_size / 2.0, 0) AS BIGINT) AS r FROM part")
def _(t):
    return part(t, r=std.round_(std.float_of(SIZE()) / 2.0))


@query("fn_int_of", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size // 2 END::BIGINT AS v, CASE WHEN p_size % 2 = 1 THEN 'E5008' END AS code FROM part")
def _(t):
    v = std.int_of(std.float_of(SIZE()) / 2.0)
    return part(t, v=v, code=v.code)


@query("fn_at_least", "SELECT p_partkey, p_size >= 10 AS a, p_size <= 10 AS b FROM part")
def _(t):
    return part(t, a=std.at_least(10)(SIZE()), b=std.at_most(10)(SIZE()))


@query("fn_float_of", "SELECT p_partkey, CAST(p_size AS DOUBLE) AS v FROM part")
def _(t):
    return part(t, v=std.float_of(SIZE()))


@query("fn_string_of", "SELECT p_partkey, p_size::VARCHAR AS a, (p_size > 10)::VARCHAR AS b, (p_size // 2)::VARCHAR || CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '.0' END AS c FROM part")
def _(t):
    return part(t, a=std.string_of(SIZE()), b=std.string_of(SIZE() > 10), c=std.string_of(std.float_of(SIZE()) / 2.0))


@query("fn_length", "SELECT doc_id, length(text) AS n FROM documents")
def _(t):
    return t.documents.select("doc_id", std.length(col("text", "string")).v.alias("n"))


@query("fn_join", "SELECT p_partkey, p_brand || '-' || p_type || '-' || p_name AS s, '' AS empty FROM part")
def _(t):
    xs = E(F.array("p_brand", "p_type", "p_name"), "array")
    return part(t, s=std.join(xs, "-"), empty=std.join(E(F.array().cast("array<string>"), "array"), "-"))


@query("fn_affix", "SELECT p_partkey, starts_with(p_name, 'part') AS a, ends_with(p_type, 'L') AS b, contains(p_name, '1') AS c FROM part")
def _(t):
    return part(t, a=std.starts_with(NAME(), "part"), b=std.ends_with(TYPE(), "L"), c=std.contains(NAME(), "1"))


@query("fn_split", "SELECT doc_id, len(string_split(text, '. ')) AS n, string_split(text, '. ')[1] AS head FROM documents")
def _(t):
    parts = std.split(col("text", "string"), ". ")
    return t.documents.select("doc_id", std.count(parts).v.alias("n"), parts.at(0, "string").v.alias("head"))


@query("fn_map_views", "SELECT p_partkey, 'brand,type' AS ks, p_brand || ',' || p_type AS vs, 2::BIGINT AS n FROM part")
def _(t):
    m = E(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type")), "map")
    return part(t, ks=std.join(std.keys(m), ","), vs=std.join(std.values(m), ","), n=std.count(std.entries(m)))


@query("fn_array_filter", "SELECT p_partkey, coalesce(list_sum(list_filter([3, 8, 13, 40], lambda x: x < p_size)), 0)::BIGINT AS s FROM part")
def _(t):
    return part(t, s=std.sum_(std.filter_(lift([3, 8, 13, 40]), lambda x: x < SIZE(), "int"), "int"))


# -- units -------------------------------------------------------------------------


def _catalogue_sql() -> str:
    """The prefixes' rule in SQL: base and named symbols first, then each with each prefix, then the units of data."""
    quoted = lambda d: " ".join(f"{x}^{n}" for x, n in d)
    plain = [(s, quoted(((d, 1),)), 1.0) for s, d in U.BASE.items()] + [("g", "Mass^1", 1e-3)] + [(s, quoted(U.dimension(**p)), 1.0) for s, p in U.NAMED.items()]
    rows = ", ".join(f"({i}, '{s}', '{d}', {f!r}::DOUBLE)" for i, (s, d, f) in enumerate(plain))
    prefixes = ", ".join(f"({i}, '{p}', {float(f'1e{n}')!r}::DOUBLE)" for i, (p, n) in enumerate(U.PREFIXES.items()))
    data = ", ".join(f"('{s}', {f!r}::DOUBLE)" for s, f in (("bit", 1.0), ("B", 8.0)))
    steps = ", ".join([f"('{p}', {1024.0**n!r}::DOUBLE)" for p, n in U.BINARY.items()] + [f"('{p}', {10.0**n!r}::DOUBLE)" for p, n in U.BYTES.items()] + ["('', 1.0::DOUBLE)"])
    return f"""
WITH plain(i, symbol, dimension, factor) AS (VALUES {rows}),
prefix(j, p, times) AS (VALUES {prefixes}),
data(symbol, bits) AS (VALUES {data}), step(p, times) AS (VALUES {steps}),
units AS (
  SELECT step.p || symbol AS symbol, 'DataSize^1' AS dimension, bits * times AS factor, 0 AS first, 0 AS i, 0 AS j FROM data, step
  UNION ALL SELECT symbol, dimension, factor, 1, i, 0 FROM plain
  UNION ALL SELECT p || symbol, dimension, times * factor, 2, i, j FROM plain, prefix WHERE symbol <> 'kg'
)
SELECT symbol, dimension, factor FROM units QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY first, i, j) = 1
"""


@query("unt_catalogue", _catalogue_sql())
def _(t):
    return U.table(t.spark)


@query("unt_convert", "SELECT p_partkey, CAST(p_size AS DOUBLE) * 1073741824.0::DOUBLE * 8 AS bits, CAST(p_size AS DOUBLE) * 0.001::DOUBLE AS seconds FROM part")
def _(t):
    return part(t, bits=U.quantity(SIZE(), "GiB"), seconds=U.quantity(SIZE(), "ms"))


@query("unt_normalise", "SELECT p_partkey, CAST(p_size AS DOUBLE) * 3.0::DOUBLE = CAST(p_size AS DOUBLE) * 1000.0::DOUBLE AS same, CAST(p_size AS DOUBLE) * 1000.0::DOUBLE / 1000.0::DOUBLE AS km FROM part")
def _(t):
    return part(t, same=U.quantity(SIZE() * 3, "m") == U.quantity(SIZE(), "km"), km=U.in_unit(U.quantity(SIZE(), "km"), "km"))

