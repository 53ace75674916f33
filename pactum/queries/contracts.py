"""Types, members, sources, sinks and diagnostics over the driver's tables."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.functions import std
from pactum.functions import units as U
from pactum.operators import model as M
from pactum.operators import nested as N
from pactum.operators import paths
from pactum.plans import emit
from pactum.plans.expr import E, col, float_text, lift, template
from pactum.queries.registry import query
from pactum.sources import jsondoc


def PART():
    return paths.index(F.lit("doc.parts"), F.col("p_partkey"))


def ORDER():
    return paths.index(F.lit("doc.orders"), F.col("o_orderkey"))


def refused(df: DataFrame, key: str, column, type_: M.Type) -> DataFrame:
    """The keys of values that a type refuses."""
    return df.filter(type_.refuses(F.col(column) if isinstance(column, str) else column)).select(key)


# -- types -------------------------------------------------------------------------


@query("typ_prim", "SELECT event_id, value, CASE WHEN value <> floor(value) THEN 'E4001' END AS code FROM events")
def _(t):
    v = std.int_of(col("value", "float"))
    return t.events.select("event_id", "value", F.when(v.is_bad, "E4001").alias("code"))


@query("typ_literal", "SELECT o_orderkey FROM orders WHERE o_orderstatus NOT IN ('F', 'O')")
def _(t):
    return refused(t.orders, "o_orderkey", "o_orderstatus", M.literal("F", "O"))


@query("typ_range", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 40")
def _(t):
    return refused(t.part, "p_partkey", "p_size", M.rng(5, 40))


@query("typ_width_int", "SELECT p_partkey FROM part WHERE p_size * 7 NOT BETWEEN -128 AND 127")
def _(t):
    return refused(t.part, "p_partkey", F.col("p_size") * 7, M.width(8))


@query("typ_pattern", "SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#[0-4][0-3]')")
def _(t):
    return refused(t.part, "p_partkey", "p_brand", M.pattern("Brand#[0-4][0-3]"))


@query("typ_pattern_interp", "SELECT p_partkey FROM part WHERE NOT regexp_full_match(p_brand, 'Brand#(1|2|3)[0-9]')")
def _(t):
    return refused(t.part, "p_partkey", "p_brand", M.pattern(M.interpolate("Brand#${n}[0-9]", n=M.rng(1, 3))))


@query("typ_predicate", "SELECT p_partkey FROM part WHERE p_size % 8 <> 0 OR p_size > 40")
def _(t):
    aligned = M.prim("int").where("divisible_by(8)", lambda x: x % 8 == 0).where("at_most(40)", std.at_most(40))
    return refused(t.part, "p_partkey", "p_size", aligned)


@query("typ_nullable", "SELECT p_partkey FROM part WHERE nullif(p_size, 7) > 30")
def _(t):
    return refused(t.part, "p_partkey", F.nullif(F.col("p_size"), F.lit(7)), M.rng(1, 30).opt())


@query("typ_array_size", "SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) NOT BETWEEN 1 AND 4 OR max(l_linenumber) > 6")
def _(t):
    xs = t.lineitem.groupBy("l_orderkey").agg(F.collect_list("l_linenumber").alias("xs"))
    return refused(xs, "l_orderkey", "xs", M.array(M.rng(1, 6), 1, 4))


@query("typ_map_keys", "SELECT p_partkey FROM part WHERE p_size > 30 OR NOT regexp_full_match(p_brand, 'Brand#[1-3].*')")
def _(t):
    return refused(t.part, "p_partkey", F.create_map("p_brand", "p_size"), M.map_of(M.pattern("Brand#[1-3].*"), M.rng(1, 30)))


def props(t) -> DataFrame:
    return jsondoc.nodes(t.events, "props", ["event_id"], "props")


@query("typ_record_closed", "SELECT event_id, 'E4003' AS code, 'props.' || key AS path FROM (SELECT event_id, unnest(json_keys(props)) AS key FROM events) WHERE key <> 'j'")
def _(t):
    r = M.Record("Props", {"j": M.Member("optional", M.prim("int"))})
    return N.reports(N.bind_text(N.dealt(t.events.select("event_id", "props")), "props", r, "props"), ["event_id"]).select("event_id", "code", "path")


@query("typ_record_open", "SELECT event_id, replace(props, ' ', '') AS extras, FALSE AS bad FROM events")
def _(t):
    r = M.Record("Props", {"j": M.Member("optional", M.prim("int"))}, open=True)
    return N.bind_text(N.dealt(t.events.select("event_id", "props")), "props", r).select("event_id", F.to_json("bound.value.extras").alias("extras"), F.col("bound.bad").alias("bad"))


@query("typ_union_kind", "SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN p_size > 40 ELSE length(p_name) > 20 END AS refused FROM part")
def _(t):
    either = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string")).otherwise(emit.json_string(F.col("p_name")))
    docs = t.part.select("p_partkey", either.alias("doc"))
    return N.bind_text(docs, "doc", N.Union((N.Value(M.rng(0, 40)), N.Value(M.pattern(".{0,20}"))))).select("p_partkey", F.col("bound.bad").alias("refused"))


def event_arm(kind: str, value: M.Type) -> M.Record:
    return M.Record(kind, {"kind": M.Member("required", M.literal(kind)), "value": M.Member("required", value)})


@query("typ_union_discriminated", "SELECT event_id, CASE event_type WHEN 'purchase' THEN value < 50 WHEN 'click' THEN value > 90 ELSE event_type NOT IN ('view', 'signup') END AS refused FROM events")
def _(t):
    quiet = N.Union((event_arm("view", M.prim("float")), event_arm("signup", M.prim("float"))), "Quiet")
    event = N.Union((event_arm("purchase", M.rng(50.0, 1e300, kind="float")), event_arm("click", M.rng(-1e300, 90.0, kind="float")), quiet), "Event")
    docs = N.dealt(t.events.select("event_id", "event_type", "value")).select("event_id", emit.canonical({"kind": col("event_type", "string"), "value": col("value", "float")}).alias("doc"))
    return N.bind_text(docs, "doc", event).select("event_id", F.col("bound.bad").alias("refused"))


@query("typ_intersection", "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 5 AND 40 OR p_size NOT IN (1, 6, 12, 18, 45)")
def _(t):
    return refused(t.part, "p_partkey", "p_size", M.rng(5, 40) & M.literal(1, 6, 12, 18, 45))


SIZED = M.Record("Sized", {"p_partkey": M.Member("required", M.prim("int")), "p_size": M.Member("required", M.rng(1, 50))})


@query("typ_inheritance", "SELECT p_partkey, 'E4001' AS code, 'doc.parts[' || p_partkey || '].p_size' AS path FROM part WHERE p_size > 20")
def _(t):
    small = SIZED.extend("Small", {"p_size": M.Member("required", M.rng(1, 20))})
    return small.diagnostics(t.part, PART(), keep=["p_partkey"]).select("p_partkey", "code", "path")


BOUNDED = M.generic("Bounded", {"element": M.prim("int"), "n": M.rng(0, 100)}, lambda element, n: M.array(element & M.rng(0, n), 1, 2))


@query("typ_generic", "SELECT p_partkey FROM part WHERE p_size > 30")
def _(t):
    return refused(t.part, "p_partkey", F.array("p_size"), BOUNDED(element=M.prim("int"), n=30))


@query("typ_quantity_bind", "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN CAST(p_size AS DOUBLE) * 0.001::DOUBLE WHEN 1 THEN CAST(p_size AS DOUBLE) END AS v, CASE WHEN p_size % 3 = 2 THEN 'E4001' END AS code FROM part")
def _(t):
    unit = F.element_at(F.array(F.lit("ms"), F.lit("s"), F.lit("kg")), F.col("p_size") % 3 + 1)
    q = U.bind(F.col("p_size"), unit, U.dimension(Time=1))
    return t.part.select("p_partkey", q.v.alias("v"), q.code.alias("code"))


@query("typ_ref_bind", "SELECT o_orderkey, CASE WHEN o_custkey % 11 = 0 OR o_custkey % 7 = 0 THEN 'E6002' END AS code FROM orders")
def _(t):
    from pactum.operators import relations

    order = M.Record("Order", {"customer": M.Member("required", N.Ref(("doc.customers",)))})
    text = F.concat(F.lit('{"customer":"$.customers['), F.when(F.col("o_custkey") % 11 == 0, F.lit("x")).otherwise(F.col("o_custkey").cast("string")), F.lit(']"}'))
    bound = N.bind_text(t.orders.select("o_orderkey", text.alias("doc")), "doc", order)
    there = t.customer.filter("c_custkey % 7 <> 0").select(paths.index(F.lit("doc.customers"), F.col("c_custkey")).alias("path"))
    refs = bound.select("o_orderkey", F.col("bound.value.customer").alias("ref"), F.get("bound.reports", 0)["code"].alias("own"))
    return relations.deref(refs, "ref", there, "path").select("o_orderkey", F.coalesce("own", F.when(F.col("path").isNull(), "E6002")).alias("code"))


TREE = """
WITH RECURSIVE t(id, depth) AS (
  SELECT p_partkey, 0 FROM part WHERE p_partkey = 1
  UNION ALL SELECT p_partkey, depth + 1 FROM t JOIN part ON p_partkey // 3 = id AND p_partkey > 1 
) SELECT id, depth::BIGINT AS depth FROM t
"""


@query("typ_recursive_tree", TREE)
def _(t):
    nodes = t.part.filter("p_partkey > 1").select(F.col("p_partkey").alias("id"), F.floor(F.col("p_partkey") / 3).alias("parent"))
    root = t.part.filter("p_partkey = 1").select(F.col("p_partkey").alias("id"), F.lit(0).cast("long").alias("depth"))
    return N.check_tree(nodes, root, "id", "parent", lambda level: level.select(F.col("child_id").alias("id"), (F.col("depth") + 1).alias("depth")))[0]


@query("typ_else_message", "SELECT p_partkey, 'size must be small' AS message FROM part WHERE p_size > 40")
def _(t):
    small = M.Record("P", {"p_size": M.Member("required", M.rng(1, 40).else_("size must be small"))})
    return small.diagnostics(t.part, PART(), keep=["p_partkey"]).select("p_partkey", "message")


@query("typ_map_to_record", "SELECT p_partkey, p_brand AS brand, CASE WHEN p_size % 6 <> 0 THEN p_size::BIGINT END AS size, CASE WHEN p_size % 6 = 0 THEN 'E4002' END AS code FROM part")
def _(t):
    sized = M.Record("Sized", {"brand": M.Member("required", M.prim("string")), "size": M.Member("required", M.pattern("[0-9]+"))})
    m = F.when(F.col("p_size") % 6 == 0, F.create_map(F.lit("brand"), F.col("p_brand"))).otherwise(F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("size"), F.col("p_size").cast("string")))
    bound = t.part.withColumn("b", N.bind_map(m, sized, F.lit("doc")))
    return bound.select("p_partkey", "b.value.brand", F.col("b.value.size").cast("bigint").alias("size"), F.get("b.reports", 0)["code"].alias("code"))


@query("typ_record_to_map", "SELECT p_partkey, unnest(['p_brand', 'p_type']) AS key, unnest([p_brand, p_type]) AS value FROM part")
def _(t):
    r = M.Record("R", {"p_brand": M.Member("required", M.prim("string")), "p_type": M.Member("required", M.prim("string")), "none": M.Member("optional", M.prim("string"))})
    values = r.evaluate(t.part, PART(), ["p_partkey"]).select("p_partkey", F.struct(*r.members).alias("r"))
    return values.select("p_partkey", F.explode(N.to_map(F.col("r"), list(r.members))))


# -- members -----------------------------------------------------------------------


def FIFTH():
    return F.col("p_size") % 5 == 0


def given(t) -> DataFrame:
    """Parts whose `size` is absent in every fifth size."""
    return t.part.withColumn("size", F.when(~FIFTH(), F.col("p_size").cast("long")))


@query("mem_required", "SELECT p_partkey, 'E4002' AS code, 'doc.parts[' || p_partkey || '].size' AS path FROM part WHERE p_size % 5 = 0")
def _(t):
    return M.Record("P", {"size": M.Member("required", M.prim("int"))}).diagnostics(given(t), PART(), keep=["p_partkey"]).select("p_partkey", "code", "path")


@query("mem_optional", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_size::BIGINT END AS size, p_size % 5 <> 0 AS here FROM part")
def _(t):
    r = M.Record("P", {"size": M.Member("optional", M.prim("int")), "here": M.Member("derived", None, lambda m: m["size"].present())})
    return r.evaluate(given(t), PART(), ["p_partkey"])


@query("mem_default", "SELECT p_partkey, coalesce(nullif(p_size % 5, 0), 9)::BIGINT AS v FROM part")
def _(t):
    df = t.part.withColumn("v", F.nullif(F.col("p_size") % 5, F.lit(0)).cast("long"))
    return M.Record("P", {"v": M.Member("defaulted", M.prim("int"), lambda m: 9)}).evaluate(df, PART(), ["p_partkey"])


DERIVE = {
    "l_quantity": M.Member("required", M.prim("float")),
    "l_extendedprice": M.Member("required", M.prim("float")),
    "l_discount": M.Member("required", M.prim("float")),
    "l_tax": M.Member("required", M.prim("float")),
    "total": M.Member("derived", None, lambda m: m["net"] + m["net"] * m["l_tax"]),
    "net": M.Member("derived", None, lambda m: m["l_extendedprice"] - m["l_extendedprice"] * m["l_discount"]),
    "unit_price": M.Member("derived", None, lambda m: m["l_extendedprice"] / m["l_quantity"]),
    "bulk": M.Member("derived", None, lambda m: m["l_quantity"] >= 30.0),
}

def LINE():
    return paths.index(F.lit("doc.lines"), F.col("l_orderkey"))


@query("mem_derived", "SELECT l_orderkey, l_linenumber, l_extendedprice - l_extendedprice * l_discount AS net, (l_extendedprice - l_extendedprice * l_discount) + (l_extendedprice - l_extendedprice * l_discount) * l_tax AS total, CASE WHEN l_quantity <> 0 THEN l_extendedprice / l_quantity END AS unit_price, l_quantity >= 30 AS bulk FROM lineitem")
def _(t):
    return M.Record("Line", DERIVE).evaluate(t.lineitem, LINE(), ["l_orderkey", "l_linenumber"]).select("l_orderkey", "l_linenumber", "net", "total", "unit_price", "bulk")


@query("mem_restatement", "SELECT p_partkey, 'E4005' AS code FROM part WHERE p_size % 4 = 1")
def _(t):
    df = t.part.withColumn("twice", F.when(F.col("p_size") % 4 == 1, F.lit(-1).cast("long")).when(F.col("p_size") % 4 == 2, F.col("p_size").cast("long") * 2))
    r = M.Record("P", {"p_size": M.Member("required", M.prim("int")), "twice": M.Member("derived", M.prim("int"), lambda m: m["p_size"] * 2)})
    return r.diagnostics(df, PART(), keep=["p_partkey"]).select("p_partkey", "code")


@query("mem_hidden", "SELECT p_partkey, p_size::BIGINT * 4 AS four, CASE WHEN p_size % 5 <> 0 THEN 'E4006' END AS code FROM part")
def _(t):
    r = M.Record("P", {"p_size": M.Member("required", M.prim("int")), "size": M.Member("hidden", None, lambda m: m["p_size"] * 2), "four": M.Member("derived", None, lambda m: m["size"] * 2)})
    found = r.diagnostics(given(t), PART(), keep=["p_partkey"]).select("p_partkey", "code")
    return r.evaluate(given(t), PART(), ["p_partkey"]).select("p_partkey", "four").join(found, "p_partkey", "left")


@query("mem_access", "SELECT p_partkey, p_brand AS brand FROM part")
def _(t):
    rec = std.record({"inner": {"brand": col("p_brand", "string")}})
    return t.part.select("p_partkey", rec.get("inner", "record").get("brand", "string").v.alias("brand"))


@query("mem_safe_access", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN p_brand END AS brand FROM part")
def _(t):
    rec = E(F.when(~FIFTH(), F.struct(F.col("p_brand").alias("brand"))), "record", FIFTH())
    return t.part.select("p_partkey", rec.get("brand", "string").v.alias("brand"))


@query("mem_index", "SELECT p_partkey, CASE WHEN p_size % 5 < 3 THEN [10, 20, 30][p_size % 5 + 1]::BIGINT END AS v, CASE WHEN p_size % 5 >= 3 THEN 'E5005' END AS code, p_type = 'STANDARD' AS known FROM part")
def _(t):
    v = lift([10, 20, 30]).at(col("p_size", "int") % 5, "int")
    m = E(F.create_map(F.lit("STANDARD"), F.lit(1)), "map").at(col("p_type", "string"), "int")
    return t.part.select("p_partkey", v.v.alias("v"), v.code.alias("code"), m.present().v.alias("known"))


@query("mem_construct", "SELECT p_partkey, p_brand || '/' || p_size AS s FROM part")
def _(t):
    rec = std.record({"a": col("p_brand", "string"), "b": col("p_size", "int")})
    return t.part.select("p_partkey", template(rec.get("a", "string"), "/", rec.get("b", "int")).v.alias("s"))


@query("mem_spread", "SELECT p_partkey, p_brand AS a, p_size AS b, 'new' AS c FROM part")
def _(t):
    base = {"a": col("p_brand", "string"), "b": col("p_size", "int")}
    return t.part.select("p_partkey", *[e.v.alias(n) for n, e in std.spread(base, {"c": lift("new")}).items()])


@query("mem_array_spread", "SELECT p_partkey, '1,2,' || p_size AS v FROM part")
def _(t):
    xs = std.concat([1, 2], E(F.col("p_size").cast("long"), "int"))
    return t.part.select("p_partkey", F.array_join(F.transform(xs.v, lambda x: x.cast("string")), ",").alias("v"))


@query("mem_with", "SELECT p_partkey, p_size::BIGINT + 100 AS size, (p_size::BIGINT + 100) * 2 AS twice FROM part")
def _(t):
    r = M.Record("P", {"size": M.Member("required", M.prim("int"), supplied="p_size"), "twice": M.Member("derived", None, lambda m: m["size"] * 2)})
    return r.update(t.part, {"size": lambda m: m["size"] + 100}, PART(), ["p_partkey"])


@query("mem_merge", "SELECT p_partkey, CASE WHEN p_size % 5 <> 0 THEN 'patch' ELSE p_brand END AS brand, p_type AS type, 'z' AS deep FROM part")
def _(t):
    base = {"brand": col("p_brand", "string"), "type": col("p_type", "string"), "in": {"deep": lift("y")}}
    patch = {"brand": E(F.when(~FIFTH(), F.lit("patch")), "string", FIFTH()), "in": {"deep": lift("z")}}
    out = std.merge(base, patch)
    return t.part.select("p_partkey", out["brand"].v.alias("brand"), out["type"].v.alias("type"), out["in"]["deep"].v.alias("deep"))


def with_lines(t, line: M.Record) -> DataFrame:
    """Orders as documents with their lines in them, bound, and a row for each line."""
    member = lambda name, x: F.concat(F.lit(f'"{name}":'), x)
    one = F.concat(F.lit("{"), F.concat_ws(",", member("number", F.col("l_linenumber").cast("string")), member("price", float_text(F.col("l_extendedprice")))), F.lit("}"))
    lines = t.lineitem.groupBy("l_orderkey").agg(F.concat_ws(",", F.collect_list(one)).alias("lines"))
    joined = t.orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    doc = F.concat(F.lit("{"), F.concat_ws(",", member("o_orderpriority", emit.json_string(F.col("o_orderpriority"))), member("total", float_text(F.col("o_totalprice"))), member("lines", F.concat(F.lit("["), F.col("lines"), F.lit("]")))), F.lit("}"))
    order = M.Record("Order", {"o_orderpriority": M.Member("required", M.prim("string")), "total": M.Member("required", M.prim("float")), "lines": M.Member("required", N.Arr(line, 1))})
    bound = N.bind_text(joined.select("l_orderkey", doc.alias("doc")), "doc", order)
    return bound.select("l_orderkey", F.explode("bound.value.lines").alias("line"))


def line_record(**derived) -> M.Record:
    return M.Record("Line", {"number": M.Member("required", M.prim("int")), "price": M.Member("required", M.prim("float")), **{n: M.Member("derived", None, f) for n, f in derived.items()}})


@query("mem_enclosing_scope", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_orderpriority FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    rows = with_lines(t, line_record(priority=lambda m: m["o_orderpriority"]))  # the order's, as a line has none
    return rows.select("l_orderkey", F.col("line.number").alias("l_linenumber"), F.col("line.priority").alias("o_orderpriority"))


@query("mem_parent", "SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, o_totalprice > l_extendedprice AS below FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def _(t):
    rows = with_lines(t, line_record(below=lambda m: m["$parent"]["total"] > m["price"]))
    return rows.select("l_orderkey", F.col("line.number").alias("l_linenumber"), F.col("line.below").alias("below"))


@query("mem_key", "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS key FROM orders")
def _(t):
    xs = t.orders.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("xs"))
    return xs.select("o_custkey", F.posexplode("xs").alias("key", "o_orderkey")).select("o_custkey", "o_orderkey", F.col("key").cast("long").alias("key"))


@query("mem_path", "SELECT l_orderkey, l_linenumber, 'doc.orders[' || l_orderkey || '].lines[\"n' || l_linenumber || '\"]' AS path FROM lineitem")
def _(t):
    lines = paths.member(paths.index(F.lit("doc.orders"), F.col("l_orderkey")), "lines")
    return t.lineitem.select("l_orderkey", "l_linenumber", paths.key(lines, F.concat(F.lit("n"), F.col("l_linenumber").cast("string"))).alias("path"))


# -- sources -----------------------------------------------------------------------


@query("src_json_bind", "SELECT event_id, CASE WHEN event_id % 7 <> 0 THEN CAST(props->>'$.k' AS BIGINT) END AS k, CASE WHEN event_id % 7 = 0 THEN 'E6004' END AS code FROM events")
def _(t):
    texts = t.events.select("event_id", F.when(F.col("event_id") % 7 == 0, F.concat(F.col("props"), F.lit(","))).otherwise(F.col("props")).alias("doc"))
    bound = N.bind_text(texts, "doc", M.Record("Props", {"k": M.Member("required", M.prim("int"))}, open=True))
    return bound.select("event_id", "bound.value.k", F.get("bound.reports", 0)["code"].alias("code"))


@query("src_json_nodes", "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events")
def _(t):
    return props(t).filter("parent = 'props' and key = 'k'").select("event_id", jsondoc.typed("int").alias("k"))


def machines(t) -> tuple[N.Model, dict[str, DataFrame]]:
    """Two inputs, parts and suppliers, as documents."""
    part = M.Record("Part", {"size": M.Member("required", M.rng(1, 45)), "twice": M.Member("derived", None, lambda m: m["size"] * 2)}, [M.Assert("even", lambda m: m["size"] % 2 == 0, severity="info")])
    supplier = M.Record("Supplier", {"name": M.Member("required", M.prim("string")), "balance": M.Member("defaulted", M.rng(0.0, 1e9, kind="float"), lambda m: 0.0)})
    model = N.Model({"parts": part, "suppliers": supplier}, {"parts": lambda: paths.index(F.lit("parts"), F.col("id")), "suppliers": lambda: paths.index(F.lit("suppliers"), F.col("id"))})
    parts = t.part.select(F.col("p_partkey").alias("id"), emit.canonical({"size": col("p_size", "int")}).alias("text"))
    balance = E(F.col("s_acctbal"), "float", F.col("s_suppkey") % 10 == 0)
    suppliers = t.supplier.select(F.col("s_suppkey").alias("id"), emit.canonical({"name": col("s_name", "string"), "balance": balance}).alias("text"))
    return model, {"parts": parts, "suppliers": suppliers}


@query("api_evaluate", "SELECT s_suppkey AS id, s_name AS name, CASE WHEN s_suppkey % 10 = 0 THEN 0.0::DOUBLE WHEN s_acctbal >= 0 THEN s_acctbal END AS balance, s_acctbal < 0 AND s_suppkey % 10 <> 0 AS bad FROM supplier")
def _(t):
    model, inputs = machines(t)
    assert model.check() == []
    return model.evaluate(inputs)[0]["suppliers"].select("id", "value.name", "value.balance", "bad")


API_REPORT = """
SELECT row_number() OVER (ORDER BY root, id, code)::BIGINT AS n, root || '[' || id || ']' || member AS path, code FROM (
  SELECT 'parts' AS root, p_partkey AS id, '.size' AS member, 'E4001' AS code FROM part WHERE p_size > 45
  UNION ALL SELECT 'parts', p_partkey, '', 'I6001' FROM part WHERE p_size <= 45 AND p_size % 2 = 1
  UNION ALL SELECT 'suppliers', s_suppkey, '.balance', 'E4001' FROM supplier WHERE s_acctbal < 0 AND s_suppkey % 10 <> 0
)
"""


@query("api_validate", API_REPORT)
def _(t):
    model, inputs = machines(t)
    return M.numbered(model.validate(inputs)).select("n", "path", "code")


@query("api_render", "SELECT p_partkey AS id, '{\"size\":' || p_size || ',\"twice\":' || (p_size * 2) || '}' AS rendered FROM part WHERE p_size <= 45")
def _(t):
    model, inputs = machines(t)
    return model.render(inputs, "parts").select("id", "rendered")


@query("src_table_bind", "SELECT c_custkey, c_name FROM customer WHERE c_acctbal >= 0")
def _(t):
    r = M.Record("C", {"c_name": M.Member("required", M.prim("string")), "c_acctbal": M.Member("required", M.rng(0.0, 1e9, kind="float"))})
    good = t.customer.filter(~r.members["c_acctbal"].type.refuses(F.col("c_acctbal")))
    return r.evaluate(good, F.lit("doc"), ["c_custkey"]).select("c_custkey", "c_name")


@query("src_input_fallback", "SELECT n_nationkey, 'none' AS note, 'E5006' AS code FROM nation")
def _(t):
    from pactum.sources.table import Inputs

    inputs = Inputs({"notes": lambda: t.nation.select(F.col("n_nationkey").alias("k"), F.lit("none").alias("note"))})
    notes, missing = inputs.demand("notes"), inputs.code("other")
    return t.nation.join(notes, F.col("n_nationkey") == F.col("k")).select("n_nationkey", "note", F.lit(missing).alias("code"))


@query("src_const", "SELECT p_partkey, p_size * 12 AS v FROM part")
def _(t):
    dozen = lift(12)
    return t.part.select("p_partkey", (col("p_size", "int") * dozen).v.cast("int").alias("v"))


@query("src_generate_sweep", "SELECT c, p, (c * 16 + p)::BIGINT AS id, [64, 128, 256, 512][p % 4 + 1] AS size_bytes, p % 8 AS priority FROM range(32) AS cs(c), range(16) AS ps(p)")
def _(t):
    grid = t.spark.range(32).withColumnRenamed("id", "c").withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))))
    size = F.element_at(F.array(*[F.lit(n) for n in (64, 128, 256, 512)]), (F.col("p") % 4 + 1).cast("int"))
    return grid.select("c", "p", (F.col("c") * 16 + F.col("p")).alias("id"), size.alias("size_bytes"), (F.col("p") % 8).alias("priority"))


# -- sinks -------------------------------------------------------------------------


@query("snk_canonical_json", """SELECT p_partkey, '{"name":"' || p_name || '","size":' || p_size || ',"half":' || (p_size // 2) || CASE WHEN p_size % 2 = 1 THEN '.5' ELSE '.0' END || CASE WHEN p_size % 5 <> 0 THEN ',"odd":' || (p_size % 5) ELSE '' END || ',"none":null,"in":{"brand":"' || p_brand || '"},"texts":["' || p_type || '","q\\"",null],"floats":[1e+21,0.5,' || p_size || '.0],"map":{"' || p_brand || '":[' || p_size || ']},"record":{"a":' || CASE WHEN p_size > 25 THEN 'true' ELSE 'false' END || '}}' AS doc FROM part""")
def _(t):
    doc = {
        "name": col("p_name", "string"),
        "size": col("p_size", "int"),
        "half": std.float_of(col("p_size", "int")) / 2.0,
        "odd": E(F.col("p_size") % 5, "int", FIFTH()),
        "none": lift(None),
        "in": {"brand": col("p_brand", "string")},
        "texts": E(F.array(F.col("p_type"), F.lit('q"'), F.lit(None)), "array"),
        "floats": E(F.array(F.lit(1e21), F.lit(0.5), F.col("p_size").cast("double")), "array"),
        "map": E(F.create_map("p_brand", F.array("p_size")), "map"),
        "record": E(F.struct((F.col("p_size") > 25).alias("a"), F.lit(None).cast("int").alias("b")), "record"),
    }
    return t.part.select("p_partkey", emit.canonical(doc, t.part).alias("doc"))


@query("snk_fanout_paths", "SELECT p_partkey, p_brand || '/' || p_size || '.json' AS file_path, CASE WHEN count(*) OVER (PARTITION BY p_brand, p_size) > 1 THEN 'E7005' END AS code FROM part")
def _(t):
    return emit.fan_out(t.part, F.concat_ws("", "p_brand", F.lit("/"), F.col("p_size").cast("string"), F.lit(".json"))).select("p_partkey", "file_path", "code")


@query("snk_diagnostics", "SELECT row_number() OVER (ORDER BY p_partkey)::BIGINT AS n, 'E4001' AS code, 'doc.parts[' || p_partkey || '].p_size' AS path FROM part WHERE p_size > 45")
def _(t):
    found = M.Record("P", {"p_size": M.Member("required", M.rng(1, 45))}).diagnostics(t.part, PART())
    return M.numbered(found).select("n", "code", "path")


@query("snk_settable_projection", "SELECT p_partkey, p_name FROM part")
def _(t):
    r = M.Record("P", {"p_name": M.Member("required", M.prim("string")), "upper": M.Member("derived", None, lambda m: m["p_name"] + "!")})
    settable = [n for n, m in r.members.items() if m.kind in ("required", "optional", "defaulted")]
    return r.evaluate(t.part, PART(), ["p_partkey"]).select("p_partkey", *settable)


def DOC():
    return F.to_json(F.struct(F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.struct(F.col("p_brand").alias("brand")).alias("in")))


def written(t, form) -> DataFrame:
    """Each part's document in a form that a driver-side text function gives, in Arrow batches."""
    @F.pandas_udf("string")
    def write(docs: pd.Series) -> pd.Series:
        return docs.map(lambda d: form(json.loads(d)))

    return t.part.select("p_partkey", write(DOC()).alias("text"))


@query("snk_indented_json", """SELECT p_partkey, '{' || chr(10) || '  "name": "' || p_name || '",' || chr(10) || '  "size": ' || p_size || ',' || chr(10) || '  "in": {' || chr(10) || '    "brand": "' || p_brand || '"' || chr(10) || '  }' || chr(10) || '}' AS text FROM part""")
def _(t):
    return written(t, emit.indented)


@query("snk_yaml", """SELECT p_partkey, 'name: ' || CASE WHEN contains(p_name, '#') THEN '"' || p_name || '"' ELSE p_name END || chr(10) || 'size: ' || p_size || chr(10) || 'in:' || chr(10) || '  brand: "' || p_brand || '"' || chr(10) AS text FROM part""")
def _(t):
    return written(t, emit.yaml)


@query("snk_template", "SELECT p_partkey, 'part ' || p_name || CASE WHEN p_size > 25 THEN ' (large)' ELSE '' END || ': ' || CASE WHEN p_size % 3 = 0 THEN 'none' WHEN p_size % 3 = 1 THEN '0' ELSE '0, 1' END AS text FROM part")
def _(t):
    from pactum.plans import template as templates

    text = "part {{ name }}{% if size > 25 %} (large){% endif %}: {% for i in 0..<size % 3 %}{{ i }}{% if !loop.last %}, {% endif %}{% else %}none{% endfor %}"
    return t.part.select("p_partkey", templates.render_column(text, DOC()).alias("text"))


@query("src_yaml", "SELECT p_partkey, p_name AS name, p_size::BIGINT AS size FROM part")
def _(t):
    from pactum.sources import yamldoc

    @F.pandas_udf("string")
    def read(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: json.dumps(yamldoc.read(x)))

    doc = F.concat(F.lit("# a part\nname: "), F.col("p_name"), F.lit("\nsizes:\n  - 0\n  - "), F.col("p_size").cast("string"), F.lit("\n"))
    json_text = read(doc)
    return t.part.select("p_partkey", json_text.alias("j")).select("p_partkey", F.get_json_object("j", "$.name").alias("name"), F.get_json_object("j", "$.sizes[1]").cast("bigint").alias("size"))


@query("snk_round_trip", "SELECT p_partkey, TRUE AS same FROM part")
def _(t):
    doc = {"name": col("p_name", "string"), "half": std.float_of(col("p_size", "int")) / 2.0, "size": col("p_size", "int")}
    texts = t.part.select("p_partkey", emit.canonical(doc).alias("doc"))
    got = jsondoc.nodes(texts, "doc", ["p_partkey", "doc"])
    pick = lambda name, kind: F.max(F.when(F.col("key") == name, jsondoc.typed(kind)))
    bound = got.groupBy("p_partkey", "doc").agg(pick("name", "string").alias("name"), pick("half", "float").alias("half"), pick("size", "int").alias("size"))
    again = emit.canonical({"name": col("name", "string"), "half": col("half", "float"), "size": col("size", "int")})
    return bound.select("p_partkey", (again == F.col("doc")).alias("same"))


# -- diagnostics -------------------------------------------------------------------


def asserting(df: DataFrame, key: str, path, *asserts: M.Assert, **members: M.Member) -> DataFrame:
    return M.Record("R", members, asserts).diagnostics(df, path, keep=[key])


TOTAL = {"o_totalprice": M.Member("required", M.prim("float")), "o_orderstatus": M.Member("required", M.prim("string"))}


@query("dia_assert", "SELECT o_orderkey, 'E6001' AS code, 'R.affordable' AS id, 'doc.orders[' || o_orderkey || ']' AS path FROM orders WHERE o_totalprice > 400000")
def _(t):
    return asserting(t.orders, "o_orderkey", ORDER(), M.Assert("affordable", lambda m: m["o_totalprice"] <= 400000.0), **TOTAL).select("o_orderkey", "code", "id", "path")


@query("dia_when", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 300000")
def _(t):
    return asserting(t.orders, "o_orderkey", ORDER(), M.Assert("final", lambda m: m["o_totalprice"] <= 300000.0, when=lambda m: m["o_orderstatus"] == "F"), **TOTAL).select("o_orderkey")


@query("dia_severity", "SELECT o_orderkey, unnest(['W6001', 'I6001']) AS code, unnest(['warn', 'info']) AS severity FROM orders WHERE o_totalprice > 450000")
def _(t):
    a = lambda name, severity: M.Assert(name, lambda m: m["o_totalprice"] <= 450000.0, severity=severity)
    return asserting(t.orders, "o_orderkey", ORDER(), a("one", "warn"), a("two", "info"), **TOTAL).select("o_orderkey", "code", "severity")


@query("dia_message", "SELECT p_partkey, 'size ' || p_size || ' is large for ' || p_type AS message FROM part WHERE p_size > 45")
def _(t):
    a = M.Assert("small", lambda m: m["p_size"] <= 45, lambda m: template("size ", m["p_size"], " is large for ", m["p_type"]))
    return asserting(t.part, "p_partkey", PART(), a, p_size=M.Member("required", M.prim("int")), p_type=M.Member("required", M.prim("string"))).select("p_partkey", "message")


TOO_LARGE = M.Diagnostic("too_large", lambda size, limit: template(size, " exceeds ", limit), "warn")


@query("dia_template", "SELECT p_partkey, p_size || ' exceeds 45' AS message, 'W6001' AS code FROM part WHERE p_size > 45")
def _(t):
    a = M.Assert("small", lambda m: m["p_size"] <= 45, template=TOO_LARGE, args=lambda m: (m["p_size"], 45))
    return asserting(t.part, "p_partkey", PART(), a, p_size=M.Member("required", M.prim("int"))).select("p_partkey", "message", "code")


@query("dia_taint", "SELECT p_partkey, 'E4001' AS code FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, 'E6001' FROM part WHERE p_size <= 40 AND p_size * 2 > 70")
def _(t):
    a = M.Assert("half", lambda m: m["twice"] <= 70)
    return asserting(t.part, "p_partkey", PART(), a, p_size=M.Member("required", M.rng(1, 40)), twice=M.Member("derived", None, lambda m: m["p_size"] * 2)).select("p_partkey", "code")


@query("dia_eval_error", "SELECT p_partkey, 'E5001' AS code, 'doc.parts[' || p_partkey || '].share' AS path FROM part WHERE p_size % 6 = 0")
def _(t):
    return asserting(t.part, "p_partkey", PART(), p_size=M.Member("required", M.prim("int")), share=M.Member("derived", None, lambda m: lift(100) / (m["p_size"] % 6)), more=M.Member("derived", None, lambda m: m["share"] + 1)).select("p_partkey", "code", "path")


# Each part names the next by a rule over all parts; a value that waits for itself is E5007.
CYCLE = """
WITH RECURSIVE waits AS (
  SELECT p_partkey AS a, (p_partkey * p_partkey + 1) % (SELECT count(*) FROM part) AS b FROM part
), walk(a, b) AS (
  SELECT a, b FROM waits
  UNION
  SELECT walk.a, waits.b FROM walk JOIN waits ON waits.a = walk.b
)
SELECT a, 'E5007' AS code FROM walk WHERE a = b
"""


@query("dia_cycle", CYCLE)
def _(t):
    from pactum.operators import relations

    key = F.col("p_partkey")
    waits = t.part.select(key.alias("a"), ((key * key + 1) % F.lit(t.part.count())).alias("b"))
    return relations.on_cycles(waits, "a", "b").select("a", F.lit("E5007").alias("code"))


@query("dia_unique", "SELECT l_orderkey, l_linenumber, count(*) AS n, 'E6001' AS code, 'Line.once' AS id FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return M.unique(t.lineitem, ["l_orderkey", "l_linenumber"], "Line.once", LINE()).select("l_orderkey", "l_linenumber", "n", "code", "id")


@query("dia_cross_entity", "SELECT o_orderkey, 'E6001' AS code FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice > 300000 AND c_acctbal < 0")
def _(t):
    from pactum.operators import relations

    linked = relations.deref(t.orders, "o_custkey", t.customer, "c_custkey")
    a = M.Assert("solvent", lambda m: (m["o_totalprice"] <= 300000.0).or_(m["c_acctbal"] >= 0.0))
    return asserting(linked, "o_orderkey", ORDER(), a, o_totalprice=M.Member("required", M.prim("float")), c_acctbal=M.Member("required", M.prim("float"))).select("o_orderkey", "code")


