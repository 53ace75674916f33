"""DuckDB SQL for the queries that SQL can express on whole tables."""

from __future__ import annotations

import math

from pactum.llm import quality

SPACE = r"[^\x20\x09-\x0D]+"

OP9 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{SPACE}') AS ws FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')))
                      WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh
  FROM w
), s AS (
  SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM sets
), e AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM s AS a JOIN s AS b ON a.x = b.x AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n
  HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, e.b FROM reach JOIN e ON e.a = reach.r
)
SELECT doc_id, any_value(len(sh)) AS n_shingles, min(r) AS component_id, doc_id = min(r) AS kept
FROM sets JOIN reach USING (doc_id) GROUP BY doc_id
"""


def op7(rules: quality.Rules = quality.Rules()) -> str:
    gamma = (1 + rules.accuracy) / (1 - rules.accuracy)
    value = lambda r: f"CASE WHEN {r.under} = 0 THEN 0.0::DOUBLE ELSE {r.over}::DOUBLE / {r.under}::DOUBLE END"
    bucket = lambda v: f"greatest(0, ceil(ln(greatest({v}, {rules.smallest}::DOUBLE) / {rules.smallest}::DOUBLE) / {math.log(gamma)!r}::DOUBLE))::INTEGER"
    ratios = ", ".join(f"struct_pack(ratio := {i}, v := {value(r)})" for i, r in enumerate(quality.RATIOS))
    slack = "[" + ", ".join(f"{r.slack}::DOUBLE" for r in quality.RATIOS) + "]"
    low = "[" + ", ".join(str(r.low).lower() for r in quality.RATIOS) + "]"

    def blended(name: str, keys: list[str], coarser: str) -> str:
        """The weights of the groups that keys tell apart, with `prior` documents' worth of the coarser ones."""
        k, up = "".join(f"{x}, " for x in keys), keys[:-1]
        own = f"SELECT {k}ratio, bucket, {rules.unit} * sum(n) AS w FROM sketch GROUP BY {k}ratio, bucket"
        if not coarser:
            return f"{name}_m AS ({own})"
        of = "".join(f"{x}, " for x in up)
        on = " AND ".join(f"g.{x} IS NOT DISTINCT FROM s.{x}" for x in up) or "TRUE"
        return f"""
{name}_o AS ({own}),
{name}_s AS (SELECT {of}ratio, bucket, ({rules.prior * rules.unit} * w) // sum(w) OVER (PARTITION BY {of}ratio) AS w FROM {coarser}_m),
{name}_g AS (SELECT DISTINCT {", ".join(keys)} FROM {name}_o),
{name}_m AS (SELECT {k}ratio, bucket, sum(w) AS w FROM (
    SELECT * FROM {name}_o UNION ALL SELECT {"".join(f"g.{x}, " for x in keys)}s.ratio, s.bucket, s.w FROM {name}_g AS g JOIN {name}_s AS s ON {on}) GROUP BY {k}ratio, bucket)"""

    def fences(name: str, keys: list[str]) -> str:
        k = "".join(f"{x}, " for x in keys)
        return f"""
{name}_c AS (SELECT *, sum(w) OVER (PARTITION BY {k}ratio ORDER BY bucket) AS upto, sum(w) OVER (PARTITION BY {k}ratio) AS whole,
    CASE WHEN bucket = 0 THEN 0.0::DOUBLE ELSE {rules.smallest}::DOUBLE * pow({gamma!r}::DOUBLE, bucket) END AS v FROM {name}_m),
{name}_q AS (SELECT {k}ratio, min(v) FILTER (4 * upto >= whole) AS q1, min(v) FILTER (4 * upto >= 3 * whole) AS q3 FROM {name}_c GROUP BY {k}ratio),
{name} AS (SELECT {k}ratio, q1 - {rules.reach}::DOUBLE * greatest(q3 - q1, ({slack})[ratio + 1]) AS lo, q3 + {rules.reach}::DOUBLE * greatest(q3 - q1, ({slack})[ratio + 1]) AS hi FROM {name}_q)"""

    return rf"""
WITH t AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS x, regexp_extract_all(coalesce(text, ''), '{SPACE}') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '{SPACE}')) AS ls
  FROM documents
), win AS (
  SELECT doc_id, u.i AS i, array_to_string(ws[u.i:u.i + 4], ' ') AS k FROM t, unnest(range(1, len(ws) - 3)) AS u(i)
), dup AS (
  SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM dup, range(5) AS r(j) GROUP BY doc_id
), c AS (
  SELECT t.doc_id, lang, source, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
         length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, length(regexp_replace(x, '[^!?]+', '', 'g')) AS n_shouts,
         length(regexp_replace(x, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM t LEFT JOIN rep USING (doc_id)
), f AS (
  SELECT *, n_words < {rules.min_words} OR 100 * n_repeat_words > {rules.max_repeat_percent} * n_words AS base_failed, [{ratios}] AS rs FROM c
), sketch AS (
  SELECT lang, source, r.ratio AS ratio, {bucket("r.v")} AS bucket, count(*) AS n
  FROM (SELECT lang, source, unnest(rs) AS r FROM f WHERE NOT base_failed) GROUP BY 1, 2, 3, 4
), {blended("whole", [], "")}, {blended("mid", ["lang"], "whole")}, {blended("fine", ["lang", "source"], "mid")},
{fences("fine", ["lang", "source"])}, {fences("mid", ["lang"])}, {fences("whole", [])},
v AS (
  SELECT doc_id, bool_or(r.v > coalesce(fine.hi, mid.hi, whole.hi) OR (({low})[r.ratio + 1] AND r.v < coalesce(fine.lo, mid.lo, whole.lo))) AS outside
  FROM (SELECT doc_id, lang, source, unnest(rs) AS r FROM f) AS d
  LEFT JOIN fine ON fine.lang IS NOT DISTINCT FROM d.lang AND fine.source IS NOT DISTINCT FROM d.source AND fine.ratio = d.r.ratio
  LEFT JOIN mid ON mid.lang IS NOT DISTINCT FROM d.lang AND mid.ratio = d.r.ratio
  LEFT JOIN whole ON whole.ratio = d.r.ratio
  GROUP BY doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT coalesce(outside, FALSE) AS kept
FROM f JOIN v USING (doc_id)
"""


OP7 = op7()
