"""Queries over sessions: edits of whole tables, and what values come from."""

from __future__ import annotations

from pyspark.sql import functions as F

from pactum.operators import model as M
from pactum.operators import paths
from pactum.queries.registry import query
from pactum.streaming.revalidate import Session

ORDER = M.Record("R", {"o_totalprice": M.Member("required", M.prim("float"))}, [M.Assert("affordable", lambda m: m["o_totalprice"] <= 400000.0)])

EDITED = """
WITH now AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_totalprice * 2 ELSE o_totalprice END AS total
  FROM orders WHERE NOT (o_orderstatus = 'F' AND o_totalprice > 450000)
  UNION ALL
  SELECT -1 - c_custkey, c_acctbal * 50 FROM customer
)
SELECT o_orderkey, 'E6001' AS code, 'R.affordable' AS id FROM now WHERE total > 400000
"""


@query("ses_edit", EDITED)
def _(t):
    orders = t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")
    s = Session(ORDER, orders, "o_orderkey", paths.index(F.lit("doc.orders"), F.col("o_orderkey")))
    before = s.validate()
    s.update(orders.filter("o_orderstatus = 'P'").withColumn("o_totalprice", F.col("o_totalprice") * 2))
    s.remove(orders.filter("o_orderstatus = 'F' and o_totalprice > 450000"))
    s.create(t.customer.select((-1 - F.col("c_custkey")).alias("o_orderkey"), F.lit("O").alias("o_orderstatus"), (F.col("c_acctbal") * 50).alias("o_totalprice")))
    s.remove(orders.filter("o_orderstatus = 'O'"))
    s.undo()
    return s.revalidate(before, s.edited()).select("o_orderkey", "code", "id")


PART = M.Record(
    "Part",
    {
        "size": M.Member("required", M.rng(1, 40), supplied="p_size"),
        "twice": M.Member("derived", M.prim("int"), lambda m: m["size"] * 2),
        "unread": M.Member("derived", M.prim("int"), lambda m: m["size"] + 100),
        "both": M.Member("derived", M.prim("int"), lambda m: m["twice"] + m["size"]),
    },
)

TRACE = """
WITH v AS (SELECT p_partkey, p_size, p_size NOT BETWEEN 1 AND 40 AS bad FROM part)
SELECT p_partkey, 0 AS seq, 0 AS depth, 'both' AS member, 'derived' AS kind, CASE WHEN NOT bad THEN CAST(p_size * 3 AS VARCHAR) END AS value, bad FROM v
UNION ALL SELECT p_partkey, 1, 1, 'size', 'required', CASE WHEN NOT bad THEN CAST(p_size AS VARCHAR) END, bad FROM v
UNION ALL SELECT p_partkey, 2, 1, 'twice', 'derived', CASE WHEN NOT bad THEN CAST(p_size * 2 AS VARCHAR) END, bad FROM v
UNION ALL SELECT p_partkey, 3, 2, 'size', 'above', CASE WHEN NOT bad THEN CAST(p_size AS VARCHAR) END, bad FROM v
"""


@query("ses_trace", TRACE)
def _(t):
    return Session(PART, t.part, "p_partkey", paths.index(F.lit("doc.parts"), F.col("p_partkey"))).trace("both")


@query("ses_partial", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 40 THEN p_size::BIGINT * 2 END AS twice FROM part")
def _(t):
    done = Session(PART, t.part, "p_partkey", paths.index(F.lit("doc.parts"), F.col("p_partkey"))).evaluate(["twice"])
    return done.select("p_partkey", F.col("twice").cast("long").alias("twice"))
