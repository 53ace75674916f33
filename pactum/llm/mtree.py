"""Exact top-k search by inner product with M-trees.

Vectors become integers, floor(scale * x). An added coordinate brings all to one
length L, the greatest of the corpus, so that the largest inner product with a query
is the nearest neighbour in Euclidean distance, which is a metric:
|q - x|**2 = |q|**2 + L**2 - 2 * q.x.

Rows are dealt to cells by the nearest of a bounded number of pivots, and a cell's
rows of one vector length into shards. Each shard is an M-tree of pages, which is
built and stored once. A page holds entries: routing vectors with covering radii, or,
in leaves, vectors; every entry stores the distance to its page's routing vector.
Best-first search keeps pages in a heap by their least possible distance. An entry
whose distance is bounded away by its stored distance to the parent,
|d(q, parent) - d(entry, parent)| - radius > limit, costs no distance; the others'
distances are worked out together, and leaves give exact integer inner products.
Bounds are widened by more than the rounding of the distances.

A query first searches a shard of its nearest cell. With the k-th score found there
it goes on to the cells whose covering radius does not exclude them, in blocks of
queries; the k best of each shard are merged by query.

Defined results: vectors that are null, or hold null or a value that is not finite,
take no part, nor do rows with a null id. Vectors of different lengths meet in the
components that both have, so an empty one scores 0. Integers and scores stop at the
ends of 64 bits. Equal scores go to the smaller id. Rows that repeat an id count one
by one as candidates; a query leaves out all rows of its own id, and rows of queries
that repeat an id share one ranking of all their candidates. An empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from pactum.llm.common import materialize


@dataclass(frozen=True)
class Tree:
    """page: entries of a page; shard, block: vectors of a shard and queries of a block, at least; largest_*: at most, about.

    pivots: cells at most, whose pivots and radii every task gets. With shards and
    blocks that grow to their bounds, a corpus is copied once for each `largest_block`
    queries, and a query once for each `largest_shard` vectors that it is not kept from.
    """

    page: int = 256
    shard: int = 4096
    block: int = 4096
    largest_shard: int = 1 << 17
    largest_block: int = 1 << 16
    pivots: int = 1024
    seed: int = 5


#: Squared distances are trusted to this part of the squared lengths that they come from, and distances to SLACK of the length.
ROUNDING, SLACK = 1e-11, 1e-9
LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1


def usable(v: Column) -> Column:
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return v.isNotNull() & F.forall(v, finite)


def quantize(vectors: DataFrame, scale: int, key: str, vector: str) -> DataFrame:
    """(id, v): the usable vectors as integers, worked out in doubles."""
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("id").isNotNull() & usable(F.col("x")))
    return rows.select("id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))


def _square(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))


def _greatest(v: np.ndarray) -> float:
    return float(np.abs(v.astype(np.float64)).max(initial=0))


def exact_scores(v: np.ndarray, q: np.ndarray, fits: bool) -> list[int]:
    """Inner products of rows with q: in 64 bits where they are sure to fit, else in integers of any size, cut to 64 bits."""
    if fits:
        return (v @ q).tolist()
    big = [int(x) for x in q]
    return [min(HIGHEST, max(LOWEST, sum(int(a) * b for a, b in zip(row, big, strict=True)))) for row in v.tolist()]


# --- the tree -----------------------------------------------------------------


class _Page:
    """center, entries: rows of the tree; radii, away: covering radii, and distances to center; children: a leaf has none."""

    __slots__ = ("away", "center", "children", "entries", "radii")

    def __init__(self, center: int, entries: np.ndarray, radii: np.ndarray, away: np.ndarray, children: list[_Page] | None):
        self.center, self.entries, self.radii, self.away, self.children = center, entries, radii, away, children


class MTree:
    """A bulk-loaded M-tree of integer vectors brought to one length, given squared."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, squared_length: float, tree: Tree):
        self.ids, self.v, self.squared_length, self.tree = ids, v, squared_length, tree
        self._place()
        self.rng = np.random.default_rng(tree.seed)
        self.root, self.radius = self._build(np.arange(len(ids)))

    def _place(self) -> None:
        real = self.v.astype(np.float64)
        self.points = np.column_stack([real, np.sqrt(np.maximum(0.0, self.squared_length - (real**2).sum(axis=1)))])
        self.greatest = _greatest(self.v)
        self.distances = 0  # worked out in searches

    def __getstate__(self) -> tuple:
        return self.ids, self.v, self.squared_length, self.tree, self.root, self.radius

    def __setstate__(self, state: tuple) -> None:
        self.ids, self.v, self.squared_length, self.tree, self.root, self.radius = state
        self._place()

    def _build(self, rows: np.ndarray) -> tuple[_Page, float]:
        points = self.points[rows]
        center = int(rows[int(np.argmin(((points - points.mean(axis=0)) ** 2).sum(axis=1)))])
        away = np.sqrt(((points - self.points[center]) ** 2).sum(axis=1))
        if len(rows) <= self.tree.page:
            return _Page(center, rows, np.zeros(len(rows)), away, None), float(away.max(initial=0.0))
        built = [self._build(group) for group in self._split(rows)]
        centers = np.array([child.center for child, _ in built])
        to_center = np.sqrt(((self.points[centers] - self.points[center]) ** 2).sum(axis=1))
        return _Page(center, centers, np.array([r for _, r in built]), to_center, [child for child, _ in built]), float(away.max())

    def _split(self, rows: np.ndarray) -> list[np.ndarray]:
        """Groups around chosen vectors, none too large; where all vectors are alike, equal parts."""
        fan = min(self.tree.page, -(-len(rows) // (self.tree.page // 2)))
        limit = -(-2 * len(rows) // fan)
        chosen = self.points[self.rng.choice(rows, fan, replace=False)]
        points = self.points[rows]
        d = (points**2).sum(axis=1)[:, None] - 2 * points @ chosen.T + (chosen**2).sum(axis=1)
        nearest = d.argmin(axis=1)
        out = []
        for g in range(fan):
            mine = np.flatnonzero(nearest == g)
            mine = mine[np.argsort(d[mine, g], kind="stable")]
            out += [rows[mine[i : i + limit]] for i in range(0, len(mine), limit)]
        return out

    def search(self, query_id: int, q: np.ndarray, k: int, least: int | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), best first. least: a score below which candidates may be left out."""
        q = np.concatenate([q, np.zeros(self.v.shape[1], np.int64)])[: self.v.shape[1]]
        fits = len(q) * self.greatest * _greatest(q) < 2.0**62
        point = np.append(q.astype(np.float64), 0.0)
        at_once = float((point**2).sum()) + self.squared_length
        slack = SLACK * np.sqrt(at_once)
        reach = lambda score: float(np.sqrt(max(0.0, (1 + ROUNDING) * at_once - 2.0 * score))) + slack if score > LOWEST else np.inf
        limit = np.inf if least is None else reach(least)
        best: list[tuple[int, int]] = []  # heap of (score, -id): the worst on top
        first = float(np.sqrt(((point - self.points[self.root.center]) ** 2).sum()))
        order, pages = 0, [(first - self.radius, 0, self.root, first)]
        while pages:
            bound, _, page, to_center = heapq.heappop(pages)
            if bound > limit:
                break
            near = np.flatnonzero(np.abs(to_center - page.away) - page.radii <= limit)
            self.distances += len(near)
            rows = page.entries[near]
            if page.children is None:
                for score, i in zip(exact_scores(self.v[rows], q, fits), self.ids[rows].tolist(), strict=True):
                    if i == query_id:
                        continue
                    if len(best) < k:
                        heapq.heappush(best, (score, -i))
                    elif (score, -i) > best[0]:
                        heapq.heapreplace(best, (score, -i))
                if len(best) == k:
                    limit = min(limit, reach(best[0][0]))
            else:
                d = np.sqrt(((self.points[rows] - point) ** 2).sum(axis=1))
                bounds = d - page.radii[near]
                for n, b, to in zip(near.tolist(), bounds.tolist(), d.tolist(), strict=True):
                    if b <= limit:
                        order += 1
                        heapq.heappush(pages, (b, order, page.children[n], to))
        return [(s, -i) for s, i in sorted(best, key=lambda x: (-x[0], -x[1]))]


# --- cells --------------------------------------------------------------------


class _Cells:
    """Pivots with their added coordinate, and, once known, the covering radius and home shard of each cell."""

    def __init__(self, pivots: list[list[int]], squared_length: float):
        self.width = max(map(len, pivots))
        self.real = np.zeros((len(pivots), self.width))
        for row, p in zip(self.real, pivots, strict=True):
            row[: len(p)] = p
        self.squared_length = squared_length
        self.extra = np.sqrt(np.maximum(0.0, squared_length - (self.real**2).sum(axis=1)))
        self.radii = np.full(len(pivots), -np.inf)

    def squared_distances(self, v: np.ndarray, squared: np.ndarray, extra: np.ndarray) -> np.ndarray:
        """Of rows v with added coordinates `extra` and squared lengths (these included) `squared` to the pivots."""
        w = min(v.shape[1], self.width)
        return np.maximum(0.0, squared[:, None] + self.squared_length - 2 * (v[:, :w].astype(np.float64) @ self.real[:, :w].T + extra[:, None] * self.extra))


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, their vectors) for each length of vector."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets, flat = np.array(column.offsets), np.array(column.values, np.int64)
    sizes = np.diff(offsets)
    for w in np.unique(sizes):
        rows = np.flatnonzero(sizes == w)
        yield rows, flat[offsets[rows][:, None] + np.arange(w)].reshape(len(rows), int(w))


SLICE = 4096


def _deal(cells, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds each row's nearest cell and its distance to the pivot, widened by its rounding."""
    c: _Cells = cells.value
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            cell, away = np.zeros(piece.num_rows, np.int32), np.zeros(piece.num_rows)
            for rows, v in _by_width(piece.column(1)):
                square = (v.astype(np.float64) ** 2).sum(axis=1)
                extra = np.sqrt(np.maximum(0.0, c.squared_length - square))
                d = c.squared_distances(v, square + extra**2, extra)
                cell[rows] = d.argmin(axis=1)
                away[rows] = np.sqrt(d.min(axis=1) + 4 * ROUNDING * c.squared_length)
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(cell), pa.array(away)], names=[*piece.schema.names, "cell", "away"])


def _visits(cells, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(uid, cell): the nearest cell of each query, or, where it has a k-th score `least`, all that may hold as much."""
    c: _Cells = cells.value
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            uid, least = np.array(piece.column("uid")), piece.column("least").to_pylist()
            for rows, v in _by_width(piece.column("v")):
                square = (v.astype(np.float64) ** 2).sum(axis=1)
                d = np.sqrt(c.squared_distances(v, square, np.zeros(len(rows))))
                at_once = square + c.squared_length
                score = np.array([LOWEST if least[i] is None else least[i] for i in rows], np.float64)
                reach = np.sqrt(np.maximum(0.0, (1 + 4 * ROUNDING) * at_once - 2 * score)) + SLACK * np.sqrt(at_once)
                open_cells = (d - c.radii <= reach[:, None]) | (score <= LOWEST)[:, None]
                at, cell = np.nonzero(open_cells & np.isfinite(c.radii))
                nearest = np.where(np.isfinite(c.radii), d, np.inf).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(uid[rows][at]), pa.array(cell.astype(np.int32)), pa.array(cell == nearest[at])], names=["uid", "cell", "nearest"])


# --- the search ---------------------------------------------------------------


def _build(squared_length: float, tree: Tree, t):
    [(_, v)] = _by_width(t.column("v"))
    index = MTree(np.array(t.column("id")), v, squared_length, tree)
    key = [t.column(c).slice(0, 1) for c in ("cell", "width", "part")]
    return pa.Table.from_arrays([*key, pa.array([pickle.dumps(index)], pa.binary())], names=["cell", "width", "part", "tree"])


FOUND = "uid long, query_id long, vec_id long, score long"


def _search(k: int, left, right):
    """One stored shard against a block of queries."""
    out: tuple[list, list, list, list] = ([], [], [], [])
    if left.num_rows and right.num_rows:
        index: MTree = pickle.loads(left.column("tree")[0].as_py())
        uids, queries, least = (right.column(c).to_pylist() for c in ("uid", "query_id", "least"))
        for rows, v in _by_width(right.column("v")):
            for i, q in zip(rows.tolist(), v, strict=True):
                for score, found in index.search(queries[i], q, k, least[i]):
                    for column, x in zip(out, (uids[i], queries[i], found, score), strict=True):
                        column.append(x)
    return pa.table(dict(zip(("uid", "query_id", "vec_id", "score"), (pa.array(x, pa.int64()) for x in out), strict=True)))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, scale: int = 1024, tree: Tree = Tree(), key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k largest integer inner products with the other rows of vectors."""
    spark = vectors.sparkSession
    corpus = materialize(quantize(vectors, scale, key, vector), "corpus")
    n, longest = corpus.agg(F.count(F.lit(1)), F.max(_square(F.col("v")))).first()
    asked = quantize(queries, scale, key, vector).select(F.monotonically_increasing_id().alias("uid"), F.col("id").alias("query_id"), "v")
    asked = materialize(asked, "queries")
    n_asked = asked.count()
    if not n or not n_asked:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shard = min(tree.largest_shard, max(tree.shard, -(-n // tree.pivots)))
    blocks = -(-n_asked // min(tree.largest_block, max(tree.block, n_asked // 8)))

    # A bounded sample gives the pivots; which they are matters to speed alone.
    sample = corpus.select("v").orderBy(F.xxhash64("id", F.lit(tree.seed)), "id", "v").limit(min(tree.pivots, -(-n // shard)))
    cells = _Cells([r.v for r in sample.collect()], longest)
    dealt = corpus.mapInArrow(partial(_deal, spark.sparkContext.broadcast(cells)), "id long, v array<long>, cell int, away double").withColumn("width", F.size("v"))
    dealt = materialize(dealt, "dealt")
    for cell, radius in dealt.groupBy("cell").agg(F.max("away")).collect():  # one for each pivot
        cells.radii[cell] = radius
    cells_now = spark.sparkContext.broadcast(cells)

    # A cell's rows of one length are dealt by hash into as many shards as they need, however many lie in one place.
    sizes = dealt.groupBy("cell", "width").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts"))
    parted = dealt.join(sizes, ["cell", "width"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")).cast("int"))
    place = ["cell", "width", "part"]
    trees = materialize(parted.select(*place, "id", "v").groupBy(*place).applyInArrow(partial(_build, longest, tree), "cell int, width int, part int, tree binary"), "trees")
    homes = trees.groupBy("cell").agg(F.min(F.struct("width", "part")).alias("home"))
    shards = materialize(trees.select(*place).join(homes, "cell").select(*place, (F.struct("width", "part") == F.col("home")).alias("home")), "shards")

    def searched(visits: DataFrame) -> DataFrame:
        """visits: shard, block and query."""
        grid = ["block", *place]
        left = trees.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        pairs = left.groupBy(*grid).cogroup(visits.groupBy(*grid))
        return materialize(pairs.applyInArrow(partial(_search, k), FOUND), "found")

    def visits(wanted: DataFrame, at_home: bool) -> DataFrame:
        """Where queries (uid, query_id, v, least) go: to the home shard of their nearest cell, or wherever else the bounds allow."""
        cell = wanted.select("uid", "least", "v").mapInArrow(partial(_visits, cells_now), "uid long, cell int, nearest boolean")
        to = cell.filter("nearest").join(shards.filter("home"), "cell") if at_home else cell.join(shards, "cell").filter("not (nearest and home)")
        return to.select("uid", *place).join(wanted, "uid").withColumn("block", F.pmod(F.xxhash64("uid"), F.lit(blocks)).cast("int"))

    first = searched(visits(asked.withColumn("least", F.lit(None).cast("long")), at_home=True))
    known = first.groupBy("uid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("low")).select("uid", F.when(F.col("n") >= k, F.col("low")).alias("least"))
    rest = searched(visits(asked.join(known, "uid", "left"), at_home=False))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")  # k rows of each shard at most
    return first.unionByName(rest).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
