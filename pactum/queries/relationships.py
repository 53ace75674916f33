"""References, reverse queries, and rounds."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.operators import paths, relations
from pactum.queries.registry import query


@query("rel_deref_join", "SELECT o_orderkey, c_name FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    return relations.deref(t.orders, "o_custkey", t.customer, "c_custkey").select("o_orderkey", "c_name")


@query("rel_multi_hop", "SELECT o_orderkey, r_name FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey")
def _(t):
    step = relations.deref(t.orders, "o_custkey", t.customer, "c_custkey")
    step = relations.deref(step, "c_nationkey", t.nation, "n_nationkey")
    return relations.deref(step, "n_regionkey", t.region, "r_regionkey").select("o_orderkey", "r_name")


@query("rel_dangling", "SELECT o_orderkey, 'E6002' AS code FROM orders o WHERE NOT EXISTS (SELECT 1 FROM customer c WHERE c_custkey = o_custkey AND c_custkey % 7 <> 0)")
def _(t):
    return relations.dangling(t.orders, "o_custkey", t.customer.filter("c_custkey % 7 <> 0"), "c_custkey").select("o_orderkey", F.lit("E6002").alias("code"))


@query("rel_canonical_path", "SELECT o_orderkey, o_custkey % 3 <> 1 AS found FROM orders")
def _(t):
    at = t.customer.select(paths.index(F.lit("doc.customers"), F.col("c_custkey")).alias("path"))
    written = F.when(F.col("o_custkey") % 3 == 1, paths.key(F.lit("doc.customers"), F.col("o_custkey").cast("string"))).otherwise(paths.index(F.lit("doc.customers"), F.col("o_custkey")))
    return relations.deref(t.orders.withColumn("ref", written), "ref", at, "path").select("o_orderkey", F.col("path").isNotNull().alias("found"))


@query("rel_place", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN 'doc.orders[' || o_orderkey || '].customer' ELSE 'doc.orders[' || o_orderkey || '].clerk' END AS place FROM orders")
def _(t):
    own = paths.index(F.lit("doc.orders"), F.col("o_orderkey"))
    return t.orders.select("o_orderkey", F.when(F.col("o_totalprice") > 100000, paths.member(own, "customer")).otherwise(paths.member(own, "clerk")).alias("place"))


@query("rel_deref_copy", "SELECT o_orderkey, c_name || '|' || c_mktsegment AS copy FROM orders JOIN customer ON c_custkey = o_custkey")
def _(t):
    whole = t.customer.select("c_custkey", F.struct("c_name", "c_mktsegment").alias("value"))
    return relations.deref(t.orders, "o_custkey", whole, "c_custkey").select("o_orderkey", F.concat_ws("|", "value.c_name", "value.c_mktsegment").alias("copy"))


@query("rel_referrers", "SELECT c_custkey, coalesce(string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey), '') AS inbound FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(t):
    return relations.referrers(t.customer, "c_custkey", t.orders, "o_custkey", "o_orderkey").select("c_custkey", F.array_join(F.transform("referrers", lambda x: x.cast("string")), ",").alias("inbound"))


@query("rel_fan_in_count", "SELECT n_nationkey, n_name, count(c_custkey) AS fan_in FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2")
def _(t):
    return relations.fan_in(t.nation, "n_nationkey", t.customer, "c_nationkey").select("n_nationkey", "n_name", "fan_in")


# A customer is reached if it has a large order, or if the customer whose number is a hundredth of its own is reached.
ROUNDS = """
WITH RECURSIVE r0 AS (
  SELECT DISTINCT o_custkey AS k FROM orders WHERE o_totalprice > 400000
), step(k, n) AS (
  SELECT k, 0 FROM r0
  UNION ALL
  SELECT c_custkey, n + 1 FROM step JOIN customer ON c_custkey // 100 = k AND c_custkey <> k
)
SELECT k, min(n)::BIGINT AS n FROM step GROUP BY 1
"""


@query("rel_rounds_fixpoint", ROUNDS)
def _(t):
    above = t.customer.select(F.col("c_custkey").alias("own"), F.floor(F.col("c_custkey") / 100).alias("above")).filter("own <> above")
    start = t.orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("k")).distinct().withColumn("n", F.lit(0).cast("long"))
    step = lambda found: found.join(above, found["k"] == above["above"]).select(F.col("own").alias("k"), (F.col("n") + 1).alias("n"))
    reached, _, code = relations.grow(start, step, "k", relations.MOST_ROUNDS)
    if code:
        raise RuntimeError(f"{code}: the relationship still grows after {relations.MOST_ROUNDS} rounds")
    return reached


@query("rel_ref_path", "SELECT o_orderkey, 'doc.customers[' || o_custkey || ']' AS path FROM orders")
def _(t):
    return t.orders.select("o_orderkey", paths.index(F.lit("doc.customers"), F.col("o_custkey")).alias("path"))


@query("rel_subtree", "SELECT l_orderkey, l_linenumber, l_orderkey % 10 = 3 AS inside FROM lineitem")
def _(t):
    path = F.concat(F.lit("doc.shards["), (F.col("l_orderkey") % 10).cast("string"), F.lit("].orders["), F.col("l_orderkey").cast("string"), F.lit("]"))
    return t.lineitem.select("l_orderkey", "l_linenumber", paths.under(path, F.lit("doc.shards[3]")).alias("inside"))


@query("rel_cross_root", "SELECT k, name FROM (SELECT 'c' || c_custkey AS k, n_name AS name FROM customer JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 's' || s_suppkey, n_name FROM supplier JOIN nation ON n_nationkey = s_nationkey)")
def _(t):
    places = t.nation.select(paths.index(F.lit("world.nations"), F.col("n_nationkey")).alias("path"), "n_name")
    refs = lambda df, tag, key, ref: df.select(F.concat(F.lit(tag), F.col(key).cast("string")).alias("k"), paths.index(F.lit("world.nations"), F.col(ref)).alias("ref"))
    both = refs(t.customer, "c", "c_custkey", "c_nationkey").unionByName(refs(t.supplier, "s", "s_suppkey", "s_nationkey"))
    return relations.deref(both, "ref", places, "path").select("k", F.col("n_name").alias("name"))
