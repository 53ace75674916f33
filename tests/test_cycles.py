"""Members of cycles against walks from every place."""

import random

import pytest

import pactum.queries as Q
from pactum.operators import relations


def brute(waits):
    out = set()
    for start in waits:
        at, seen = waits[start], set()
        while at in waits and at != start and at not in seen:
            seen.add(at)
            at = waits[at]
        if at == start:
            out.add(start)
    return sorted(out)


def ring(first, n):
    return {first + i: first + (i + 1) % n for i in range(n)}


CASES = {
    "random": {i: random.Random(i).randrange(400) for i in range(400)},
    "gaps": {i: random.Random(i).randrange(1000) for i in range(0, 1000, 2)},
    "rings": ring(0, 1) | ring(10, 2) | ring(20, 37) | ring(100, 64) | {i: i + 1 for i in range(200, 500)} | {500: 20},
    "long way out": {i: i + 1 for i in range(700)},
    "empty": {},
}


@pytest.mark.parametrize("name", CASES)
def test_members_are_those_that_walks_find(spark, name):
    rows = [*CASES[name].items(), (5000, None), (None, 5000)]
    random.Random(1).shuffle(rows)
    found = relations.on_cycles(spark.createDataFrame(rows, "k long, to long"), "k", "to")
    assert found.columns == ["k"] and sorted(r.k for r in found.collect()) == brute(CASES[name])


def test_query_seeks_cycles_in_the_whole_table(spark, tmp_path):
    n = 3000
    spark.range(n).withColumnRenamed("id", "p_partkey").write.parquet(f"{tmp_path}/part.parquet")
    found = sorted(r.a for r in Q.QUERIES["dia_cycle"](spark, str(tmp_path)).collect())
    assert found == brute({a: (a * a + 1) % n for a in range(n)}) and found[-1] > 1500
