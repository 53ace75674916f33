"""Comprehensions, aggregates, orders and sets, over nested arrays and over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pactum.functions import std
from pactum.operators import collect as C
from pactum.plans.expr import E, col, lift
from pactum.queries.registry import query


def KEY():
    return col("p_partkey", "int")


def SIZE():
    return col("p_size", "int")


def lines(t) -> DataFrame:
    """Each order's lines as an ordered array: made of integers, so any order of arrival gives the same."""
    item = F.struct(F.col("l_linenumber").cast("long").alias("i"), F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))
    return t.lineitem.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(item)).alias("xs"))


LINES = "SELECT l_orderkey, list(struct_pack(i := l_linenumber::BIGINT, part := l_partkey, qty := l_quantity) ORDER BY l_linenumber, l_partkey, l_quantity) AS xs FROM lineitem GROUP BY 1"


def over(df: DataFrame, key: str, **columns) -> DataFrame:
    return df.select(key, *[(c if isinstance(c, Column) else c.v).alias(n) for n, c in columns.items()])


def XS():
    return E(F.col("xs"), "array")


def QTY():
    return std.map_(XS(), lambda x: x.get("qty", "float"))


def PARTS():
    return std.map_(XS(), lambda x: x.get("part", "int"))


@query("cmp_map", f"SELECT l_orderkey, array_to_string(list_transform(xs, lambda x: x.part * 2 + 1), ',') AS v FROM ({LINES})")
def _(t):
    return over(lines(t), "l_orderkey", v=std.join(std.map_(PARTS(), lambda p: p * 2 + 1, "int"), ","))


@query("cmp_filter", f"SELECT l_orderkey, array_to_string(list_transform(list_filter(xs, lambda x: x.qty > 20 AND x.part % 2 = 0), lambda x: x.part), ',') AS v FROM ({LINES})")
def _(t):
    kept = std.filter_(XS(), lambda x: (x.get("qty", "float") > 20.0).and_(x.get("part", "int") % 2 == 0))
    return over(lines(t), "l_orderkey", v=std.join(std.map_(kept, lambda x: x.get("part", "int")), ","))


@query("cmp_join_equi", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(t):
    return C.product(t.nation, t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_name", "r_name")


@query("cmp_join_theta", "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a, supplier b WHERE a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal")
def _(t):
    a = t.supplier.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("an"), F.col("s_acctbal").alias("ab"))
    b = t.supplier.select(F.col("s_suppkey").alias("b"), F.col("s_nationkey").alias("bn"), F.col("s_acctbal").alias("bb"))
    return C.product(a, b, (F.col("an") == F.col("bn")) & (F.col("ab") < F.col("bb"))).select("a", "b")


@query("cmp_flatmap", f"SELECT l_orderkey, u.x.part AS part FROM (SELECT l_orderkey, unnest(xs) AS x FROM ({LINES})) AS u WHERE u.x.qty > 10")
def _(t):
    return C.flat_map(lines(t), "xs", keep=["l_orderkey"]).filter("item.qty > 10").select("l_orderkey", F.col("item.part").alias("part"))


@query("cmp_range", "SELECT p_partkey, unnest(range(0, p_size % 4))::BIGINT AS i FROM part")
def _(t):
    return C.over_range(t.part, lift(0), SIZE() % 4, "i").select("p_partkey", "i")


@query("cmp_map_build", "SELECT l_orderkey, count(DISTINCT l_linenumber) AS n, CASE WHEN count(*) > count(DISTINCT l_linenumber) THEN 'E5004' END AS code FROM lineitem GROUP BY 1")
def _(t):
    return C.build_map(t.lineitem, ["l_orderkey"], F.col("l_linenumber"), F.col("l_partkey"), order=[F.col("l_partkey")]).select("l_orderkey", F.size("map").cast("long").alias("n"), "code")


@query("cmp_group_idiom", "SELECT p_type AS key, count(*) AS n, sum(p_size)::BIGINT AS total FROM part GROUP BY 1")
def _(t):
    return C.group(t.part, F.col("p_type"), n=F.count(F.lit(1)), total=F.sum("p_size").cast("long"))


@query("cmp_correlated_count", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return C.correlated_count(t.customer, "c_custkey", t.orders, "o_custkey").select("c_custkey", "n")


@query("cmp_map_entries", "SELECT p_partkey, unnest(['brand', 'type']) AS key, unnest([p_brand, p_type]) AS value FROM part")
def _(t):
    m = F.create_map(F.lit("brand"), F.col("p_brand"), F.lit("type"), F.col("p_type"))
    return t.part.select("p_partkey", F.explode(F.map_entries(m)).alias("e")).select("p_partkey", "e.key", "e.value")


# -- aggregates --------------------------------------------------------------------


@query("agg_count", f"SELECT l_orderkey, len(xs) AS n FROM ({LINES})")
def _(t):
    return over(lines(t), "l_orderkey", n=std.count(XS()))


@query("agg_sum", f"SELECT l_orderkey, list_sum(list_transform(xs, lambda x: x.part))::BIGINT AS a, list_reduce(list_transform(xs, lambda x: x.qty), lambda a, x: a + x, 0.0::DOUBLE) AS b FROM ({LINES})")
def _(t):
    return over(lines(t), "l_orderkey", a=std.sum_(PARTS(), "int"), b=std.sum_(QTY(), "float"))


@query("agg_fold", f"SELECT l_orderkey, list_reduce(list_transform(xs, lambda x: x.part), lambda a, x: (a * 31 + x) % 1000003, 7::BIGINT) AS h FROM ({LINES})")
def _(t):
    return over(lines(t), "l_orderkey", h=std.fold(PARTS(), 7, lambda a, x: (a * 31 + x) % 1000003, "int"))


@query("agg_fold_max", f"SELECT l_orderkey, list_max(list_transform(xs, lambda x: x.qty)) AS most, list_min(list_transform(xs, lambda x: x.part)) AS least FROM ({LINES})")
def _(t):
    most = std.fold(QTY(), -1.0, std.max_, "float")
    least = std.fold(PARTS(), 1 << 62, std.min_, "int")
    return over(lines(t), "l_orderkey", most=most, least=least)


@query("agg_all", "SELECT l_orderkey, bool_and(l_quantity < 45) AS v FROM lineitem GROUP BY 1")
def _(t):
    return over(lines(t), "l_orderkey", v=std.all_(XS(), lambda x: x.get("qty", "float") < 45.0))


@query("agg_any", "SELECT l_orderkey, bool_or(l_quantity > 45) AS v FROM lineitem GROUP BY 1")
def _(t):
    return over(lines(t), "l_orderkey", v=std.any_(XS(), lambda x: x.get("qty", "float") > 45.0))


@query("agg_all_distinct", "SELECT l_orderkey, count(*) = count(DISTINCT l_linenumber) AS v FROM lineitem GROUP BY 1")
def _(t):
    return over(lines(t), "l_orderkey", v=std.all_distinct(std.map_(XS(), lambda x: x.get("i", "int"))))


@query("agg_count_distinct", "SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY 1")
def _(t):
    return C.group(t.orders, F.col("o_custkey"), n=F.count_distinct("o_orderpriority")).withColumnRenamed("key", "o_custkey")


# -- orders ------------------------------------------------------------------------


@query("ord_sort", f"SELECT l_orderkey, array_to_string(list_sort(list_transform(xs, lambda x: x.part)), ',') AS v FROM ({LINES})")
def _(t):
    return over(lines(t), "l_orderkey", v=std.join(std.sort(PARTS()), ","))


@query("ord_sort_by", "SELECT l_orderkey, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_partkey % 10, l_linenumber, l_partkey, l_quantity) AS v FROM lineitem GROUP BY 1")
def _(t):
    return over(lines(t), "l_orderkey", v=std.join(std.sort_by(PARTS(), lambda p: p % 10, "int"), ","))


@query("ord_reverse", f"SELECT l_orderkey, array_to_string(list_reverse(list_transform(xs, lambda x: x.part)), ',') AS v FROM ({LINES})")
def _(t):
    return over(lines(t), "l_orderkey", v=std.join(std.reverse(PARTS()), ","))


@query("ord_path", "SELECT o_custkey, string_agg('doc.orders[' || o_orderkey || ']', ' ' ORDER BY o_orderkey) AS v FROM orders GROUP BY 1")
def _(t):
    from pactum.operators.paths import index, path_key

    placed = t.orders.select("o_custkey", index(F.lit("doc.orders"), F.col("o_orderkey")).alias("path"))
    return placed.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct(path_key(F.col("path")).alias("k"), "path"))).alias("ps")).select("o_custkey", F.array_join(F.transform("ps", lambda p: p["path"]), " ").alias("v"))


@query("ord_top1", "SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey FROM orders GROUP BY 1")
def _(t):
    return C.first_by(t.orders, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey")


# -- sets --------------------------------------------------------------------------


@query("set_union_all", "SELECT c_custkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_suppkey, 's' FROM supplier")
def _(t):
    return C.concat(t.customer.select(F.col("c_custkey").alias("k"), F.lit("c").alias("side")), t.supplier.select(F.col("s_suppkey").alias("k"), F.lit("s").alias("side")))


@query("set_distinct_first", "SELECT event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) = 1")
def _(t):
    return C.first_by(t.events, ["event_type"], [F.col("event_id")]).select("event_type", "event_id")


@query("set_intersect", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    return C.members_of(t.orders, "o_custkey", t.customer.filter("c_acctbal > 5000"), "c_custkey").select("o_orderkey")


@query("set_except", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 5000)")
def _(t):
    return C.members_of(t.orders, "o_custkey", t.customer.filter("c_acctbal > 5000"), "c_custkey", negate=True).select("o_orderkey")


