"""The trees against brute force."""

import math

import numpy as np
import pytest

from pactum.llm import mtree

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(ids, v, query_id, q, k):
    scores = v.astype(np.int64) @ q.astype(np.int64)
    return sorted([(int(s), int(i)) for s, i in zip(scores, ids) if i != query_id], key=lambda x: (-x[0], x[1]))[:k]


@pytest.mark.parametrize("kind", ["spread", "clustered", "copies", "zero"])
def test_one_tree(kind):
    rng = np.random.default_rng(2)
    n, d = 3000, 8
    v = {"spread": rng.normal(0, 300, (n, d)), "clustered": rng.normal(0, 300, (20, d))[rng.integers(0, 20, n)] + rng.normal(0, 15, (n, d)), "copies": np.repeat(rng.normal(0, 300, (3, d)), n // 3, axis=0), "zero": np.zeros((n, d))}[kind]
    v = np.floor(v).astype(np.int64)
    ids = rng.permutation(n) * 3
    tree = mtree.MTree(ids, v, int((v**2).sum(axis=1).max()), mtree.Tree(page=16))
    for i in range(0, n, 300):
        assert tree.search(int(ids[i]), v[i], 10) == brute(ids, v, ids[i], v[i], 10)
    if kind == "clustered":
        assert tree.distances < 0.6 * n * 10  # the bounds spare most


def test_query_set(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 6)], "") for i in range(700)]
    rows += [(700 + i, [0.5] * 6, "") for i in range(300)]
    odd = [(None, [0.1] * 6, ""), (2000, None, ""), (2001, [0.1, None] * 3, ""), (2002, [float("nan")] * 6, ""), (2003, [float("inf")] * 6, ""), (2005, [float("-inf"), 0.0], "")]
    frame = spark.createDataFrame(rows + odd, SCHEMA)
    v = np.floor(1024 * np.array([r[1] for r in rows], np.float32).astype(np.float64)).astype(np.int64)
    ids = np.arange(len(rows))
    for tree in (mtree.Tree(), mtree.Tree(page=8, shard=100, block=3), mtree.Tree(page=4, shard=7, block=2, largest_shard=9, largest_block=2, pivots=5)):
        got = {}
        for r in mtree.top_k(frame, frame.filter("vec_id % 100 = 0"), tree=tree).collect():
            got.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
        assert sorted(got) == list(range(0, 1000, 100))
        for q in got:
            assert [got[q][i] for i in range(1, 11)] == brute(ids, v, q, v[q], 10)


def test_few_rows_and_none(spark):
    two = spark.createDataFrame([(0, [1.0, 0.0], ""), (1, [0.5, 0.5], ""), (1, [0.5, 0.5], "")], SCHEMA)
    assert [(r.rank, r.vec_id) for r in mtree.top_k(two, two.filter("vec_id = 0")).orderBy("rank").collect()] == [(1, 1), (2, 1)]
    empty = spark.createDataFrame([], SCHEMA)
    assert mtree.top_k(empty, empty).count() == 0 and mtree.top_k(two, empty).count() == 0


def whole(rows, k):
    """query id -> its k best over all rows and all rows of the query, in integers of any size."""
    ints = lambda v: [min(mtree.HIGHEST, max(mtree.LOWEST, math.floor(1024 * x))) for x in v]
    vectors = [(i, ints(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = {}
    for q, a in vectors:
        if q % 100 == 0:
            found = [(min(mtree.HIGHEST, max(mtree.LOWEST, sum(x * y for x, y in zip(a, b, strict=False)))), i) for i, b in vectors if i != q]
            out.setdefault(q, []).extend(found)
    return {q: sorted(found, key=lambda x: (-x[0], x[1]))[:k] for q, found in out.items()}


def test_large_components_other_lengths_and_repeated_queries(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in rng.normal(0, 1, int(rng.integers(0, 5)))]) for i in range(250)]
    rows += [(100, [1e5, -7e4, 3.0]), (100, [2.0, 3.0]), (300, [70000.0, 1.0]), (301, [70000.0, 1.0]), (302, [1e12, -1e13, 4.0]), (400, [1e15, 1e15]), (401, [-1e15, 1e15]), (402, [3e300]), (500, [-3e300]), (303, []), (600, [])]
    rows += [(None, [1.0]), (700, None), (701, [None, 1.0]), (800, [float("nan")])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = whole(rows, 10)
    for tree in (mtree.Tree(), mtree.Tree(page=4, shard=20, block=2, pivots=6)):
        got = {}
        for r in mtree.top_k(frame, frame.filter("vec_id % 100 = 0"), tree=tree).orderBy("query_id", "rank").collect():
            got.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert got == want
