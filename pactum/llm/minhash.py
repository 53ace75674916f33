"""Near-duplicate documents by circulant MinHash, banding and exact verification.

A document's set is its distinct shingles of five words. A shingle's hash is a
place in a universe of 2**22 (the first permutation); the second permutation is a
fixed table, and signature coordinate k is the least table entry `k` places further
round than the places of the set: one table, circularly shifted, gives all
coordinates. Bands of coordinates make bucket keys. At the limit of similarity 0.75
a linked pair shares no bucket with a probability of (1 - 0.75**6)**64, about 4e-6.

Documents with the same words form one node (equal 128-bit digests of the words),
which has a number of its own. No bucket is expanded into pairs:
1. Every member is compared with its bucket's least node, and components of the
   confirmed links are found. A bucket within one component is done.
2. In a bucket that spans components, only members of different components are
   paired. The members of a large bucket are dealt into blocks, and each pair of
   blocks is a task's work of its own.
Pairs are confirmed on the full sets. Before that, pairs that cannot be linked are
left out by two exact bounds: their sizes, and their parity sketches. A sketch has a
bit for each of 2048 classes of hashes, set if the class holds an odd number of the
set's shingles; two sketches differ in no more bits than the sets in shingles. The
second step's join works the bounds out as part of its condition, so a pair that
they rule out is never made. Nothing is capped.

Defined results: null or empty text, and text of white space, has no shingles and
links with nothing; fewer than five words are one shingle; an empty table gives an
empty result. A null doc_id is linked with nothing, has a null component and is kept.

Rows that repeat a doc_id are one document in `near_duplicates`: their texts, if they
differ, are linked with each other by their id. `deduplicate` goes by texts: of each
group of linked texts one row stays, that with the least doc_id (ties: the least
digest of the words, then the row that is least as JSON), so no text goes unless a near
duplicate of it, or of one that leads to it, stays. Rows without words or without a
doc_id all stay. Other columns, whatever their names, are ignored by the first and
kept by the second.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import free_name, kept, materialize, task
from pactum.llm.components import components

WORDS = 5
SLICE = 256
UNIVERSE_BITS = 22
PARITY_BITS = 2048
#: Words whose hashes a worker remembers, and shingles whose table rows are read at once.
REMEMBERED, ROWS_AT_ONCE = 400_000, 1024


@dataclass(frozen=True)
class MinHash:
    """block: members of a bucket that are paired by one task, about."""

    bands: int = 64
    rows: int = 6
    percent: int = 75
    seed: int = 2024
    block: int = 4096


def words_of(text: str | None) -> list[bytes]:
    """The words of a text with A-Z in lower case: bytes.split() cuts at the six ASCII white-space characters."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(words: list[bytes]) -> set:
    if len(words) < WORDS:
        return {tuple(words)} if words else set()
    return set(zip(*(words[i:] for i in range(WORDS)), strict=False))


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = xxhash.xxh3_64_intdigest(word)
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = h
        return h


class Signer:
    """Signatures of word lists; one a process."""

    def __init__(self, m: MinHash):
        self.m, self.size = m, m.bands * m.rows
        rng = np.random.default_rng(m.seed)
        table = rng.permutation(1 << UNIVERSE_BITS).astype(np.uint32)
        self.table = np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[: self.size - 1]]), self.size)
        self.odd = rng.integers(1, 1 << 63, WORDS + m.rows + 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.of_word = _WordHashes()

    @classmethod
    def of(cls, m: MinHash) -> Signer:
        return kept((cls, m), lambda: cls(m))

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Distinct 64-bit hashes of the shingles."""
        h = np.fromiter(map(self.of_word.__getitem__, words), np.uint64, len(words))
        span = min(WORDS, len(words))
        n = len(words) - span + 1
        s = np.full(n, len(words) if span < WORDS else WORDS, np.uint64)
        for j in range(span):
            s = (s ^ (s >> np.uint64(29))) * self.odd[j] + h[j : j + n]
        s ^= s >> np.uint64(32)
        s *= self.odd[WORDS]
        return np.unique(s)

    def parity(self, hashes: np.ndarray) -> np.ndarray:
        """The parity sketch, as 64-bit integers."""
        odd = np.bincount((hashes % np.uint64(PARITY_BITS)).astype(np.int64), minlength=PARITY_BITS) & 1
        return np.packbits(odd.astype(np.uint8)).view(np.int64)

    def bands(self, hashes: np.ndarray) -> np.ndarray:
        places = (hashes >> np.uint64(64 - UNIVERSE_BITS)).astype(np.int64)
        least = np.full(self.size, 1 << 31, np.uint32)
        for first in range(0, len(places), ROWS_AT_ONCE):
            np.minimum(least, self.table[places[first : first + ROWS_AT_ONCE]].min(axis=0), out=least)
        grid = least.reshape(self.m.bands, self.m.rows).astype(np.uint64)
        key = np.arange(1, self.m.bands + 1, dtype=np.uint64) * self.odd[WORDS + 1]
        for j in range(self.m.rows):
            key = (key ^ (key >> np.uint64(31))) * self.odd[WORDS + 2 + j] + grid[:, j]
        key ^= key >> np.uint64(32)
        return (key * self.odd[0]).view(np.int64)


@task("minhash signatures")
def _sign(m: MinHash, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    signer, longs = Signer.of(m), pa.list_(pa.int64())
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            sizes, digests, bands, parities = [], [], [], []
            for text in piece.column(1).to_pylist():
                words = words_of(text)
                if not words:
                    sizes.append(0)
                    digests.append(None)
                    bands.append([])
                    parities.append([])
                    continue
                hashes = signer.hashes(words)
                sizes.append(len(hashes))
                digests.append(digest_of(words))
                bands.append(signer.bands(hashes))
                parities.append(signer.parity(hashes))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(bands, longs), pa.array(parities, longs)], names=["doc_id", "n", "digest", "bands", "parity"])


def digest_of(words: list[bytes]) -> bytes | None:
    return blake2b(b" ".join(words), digest_size=16).digest() if words else None


@task("minhash texts")
def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch, of which the last is a text, and the digest of its words."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            found = pa.array([digest_of(words_of(t)) for t in piece.column(piece.num_columns - 1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*piece.columns, found], names=[*piece.schema.names, "digest"])


@task("minhash texts")
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds to each pair the sizes of its sets' intersection and union. Sets of the nodes seen last are kept."""
    kept: OrderedDict[int, set] = OrderedDict()

    def of(node: int, text: str | None) -> set:
        if node not in kept:
            kept[node] = shingles(words_of(text))
            if len(kept) > 4:
                kept.popitem(last=False)
        else:
            kept.move_to_end(node)
        return kept[node]

    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            a, b, ta, tb = (c.to_pylist() for c in piece.columns)
            common, union = [], []
            for y, tx, ty in zip(b, ta, tb, strict=True):
                two, one = of(y, ty), shingles(words_of(tx))
                n = len(one & two)
                common.append(n)
                union.append(len(one) + len(two) - n)
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(common, pa.int64()), pa.array(union, pa.int64())], names=["a", "b", "common", "union"])


def _verify(pairs: DataFrame, texts: DataFrame, m: MinHash) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets.

    pairs: a, b, and where their texts are, a_at and b_at; texts: at, text. b's text comes last, so that its set is built once a run.
    """
    side = lambda name: texts.select(F.col("at").alias(f"{name}_at"), F.col("text").alias(f"t{name}"))
    joined = pairs.join(side("a"), "a_at").join(side("b"), "b_at").select("a", "b", "ta", "tb")
    sizes = joined.mapInArrow(_compare, "a long, b long, common long, union long")
    return sizes.filter((100 * F.col("common") >= m.percent * F.col("union")) & (F.col("union") > 0)).select("a", "b")


def _may_link(one: str, two: str, m: MinHash):
    """Whether sets of these sizes can be linked: the smaller is within the larger at best. The arguments are prefixes of columns."""
    return 100 * F.least(F.col(f"{one}n"), F.col(f"{two}n")) >= m.percent * F.greatest(F.col(f"{one}n"), F.col(f"{two}n"))


def _parities_allow(one: str, two: str, m: MinHash):
    """Whether the sketches differ in few enough bits: linked sets differ in (100 - percent) / (100 + percent) of their shingles at most."""
    bits = [F.bit_count(F.get(F.col(f"{one}parity"), i).bitwiseXOR(F.get(F.col(f"{two}parity"), i))) for i in range(PARITY_BITS // 64)]
    return (100 + m.percent) * sum(bits[1:], bits[0]) <= (100 - m.percent) * (F.col(f"{one}n") + F.col(f"{two}n"))


def _signed(docs: DataFrame, m: MinHash, key: str, text: str) -> DataFrame:
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return materialize(rows.mapInArrow(partial(_sign, m), "doc_id long, n long, digest binary, bands array<long>, parity array<long>"), "signed")


def _repeating(rows: DataFrame) -> DataFrame:
    """The doc_ids of rows that have different texts."""
    h = F.xxhash64("digest")
    return rows.groupBy("doc_id").agg(F.min(h).alias("low"), F.max(h).alias("high")).filter("low <> high").select("doc_id")


def _in_blocks(rows: DataFrame, block: int) -> DataFrame:
    """rows of buckets (key, node, …) once for each pair of blocks, low and high, that a row's own `block` is of. Most buckets are one block."""
    sizes = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = rows.join(sizes, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda i: F.struct(F.least(i, "block").alias("low"), F.greatest(i, "block").alias("high")))
    return dealt.withColumn("of", F.explode(pairs)).select(*rows.columns, "block", "of.low", "of.high")


def _classes(signed: DataFrame, docs: DataFrame, m: MinHash, key: str, text: str, by_id: bool) -> DataFrame:
    """(digest, group, component): each text's class, by a number of its own and by the least doc_id of its texts' rows. by_id: texts of one doc_id are linked."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null")
    usable = signed.filter("n > 0 and doc_id is not null")
    # The rows of a digest have the same words, so the same signature: any of them will do, and each task sends one.
    found = usable.groupBy("digest").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "bands", "parity")])
    nodes = materialize(found.withColumn("node", F.monotonically_increasing_id()), "nodes")
    repeating = materialize(_repeating(usable), "repeating")
    ambiguous = repeating.limit(1).count() > 0
    if ambiguous:  # an id does not tell which text is meant
        held = rows.select("text").mapInArrow(_digests, "text string, digest binary").join(nodes.select("digest", F.col("node").alias("at")), "digest")
        texts, at = materialize(held.dropDuplicates(["at"]).select("at", "text"), "texts"), F.col("node")
    else:
        texts, at = rows.select(F.col("doc_id").alias("at"), "text"), F.col("least")

    slots = nodes.select(F.explode("bands").alias("key"), "node", "n")
    least = slots.groupBy("key").agg(F.min(F.struct("node", "n")).alias("hub"), F.count(F.lit(1)).alias("size")).filter("size > 1").select("key", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    members = materialize(slots.join(least, "key"), "members")

    facts = nodes.select("node", "n", "parity", at.alias("at"))
    side = lambda name: facts.select(*[F.col(c).alias(f"{name}_{c}") for c in facts.columns])
    star = members.filter((F.col("node") != F.col("hub")) & _may_link("", "hub_", m)).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    # Nothing here asks for the rows of a hub together, so a hub's many rows can be split.
    likely = star.join(side("a"), F.col("a") == F.col("a_node")).join(side("b"), (F.col("b") == F.col("b_node")) & _parities_allow("a_", "b_", m)).select("a", "b", "a_at", "b_at")
    links = _verify(likely, texts, m)
    if by_id and ambiguous:
        tied = usable.join(repeating, "doc_id").select("doc_id", "digest").distinct().join(nodes.select("digest", "node"), "digest")
        hubs = tied.groupBy("doc_id").agg(F.min("node").alias("b"))
        links = links.unionByName(tied.join(hubs, "doc_id").select(F.col("node").alias("a"), "b"))
    first = components(links)

    labelled = members.join(first.withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    mixed = labelled.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
    open_rows = materialize(labelled.join(mixed, "key").filter("node <> hub").join(facts.drop("n"), "node").select("key", "node", "n", "label", "parity", "at"), "open")
    dealt = _in_blocks(open_rows, m.block)
    end = lambda name: dealt.select(*[F.col(c).alias(f"{name}_{c}") for c in dealt.columns])
    together = [F.col(f"a_{c}") == F.col(f"b_{c}") for c in ("key", "low", "high")]
    once = (F.col("a_block") != F.col("b_block")) | (F.col("a_low") == F.col("a_high"))
    possible = once & (F.col("a_label") != F.col("b_label")) & (F.col("a_node") > F.col("b_node")) & _may_link("a_", "b_", m) & _parities_allow("a_", "b_", m)
    joined = end("a").join(end("b"), together[0] & together[1] & together[2] & possible)
    pairs = joined.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"), "a_at", "b_at").distinct()
    more = _verify(pairs, texts, m)

    # Within a component of the first step it does not matter which of its links are known.
    final = components(more.unionByName(first.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    named = nodes.select("node", "digest", "least").join(final, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.groupBy("component").agg(F.min("least").alias("name"))
    return named.join(names, "component").select("digest", F.col("component").alias("group"), F.col("name").alias("component"))


def near_duplicates(docs: DataFrame, m: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each row of docs: doc_id, n_shingles, component_id, kept."""
    signed = _signed(docs, m, key, text)
    out = signed.select("doc_id", "n", "digest").join(_classes(signed, docs, m, key, text, by_id=True), "digest", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def _without(docs: DataFrame, key: str, ids: DataFrame) -> DataFrame:
    own = free_name(docs, "gone")
    return docs.join(ids.select(F.col("doc_id").alias(own)), F.col(key).cast("long") == F.col(own), "left_anti")


def deduplicate(docs: DataFrame, m: MinHash = MinHash(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs that stay: one of each class of texts."""
    signed = _signed(docs, m, key, text)
    usable = signed.filter("n > 0 and doc_id is not null").select("doc_id", "digest")
    classes = materialize(_classes(signed, docs, m, key, text, by_id=False), "classes")
    several = materialize(signed.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").select("doc_id"), "several")
    if not several.limit(1).count():
        return _without(docs, key, usable.join(classes, "digest").filter(F.col("doc_id") != F.col("component")).select("doc_id"))
    # An id does not tell its rows apart: those of ids with several rows are told by their digests.
    placed = usable.join(classes.select("digest", "group"), "digest")
    first = placed.groupBy("group").agg(F.min("doc_id").alias("doc_id"))
    winners = placed.join(first, ["group", "doc_id"]).groupBy("group", "doc_id").agg(F.min("digest").alias("digest")).select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"))
    gone = placed.join(first, ["group", "doc_id"], "left_anti").select("doc_id").unionByName(several).distinct()
    once = _without(docs, key, gone)
    rows = docs.select(F.struct("*").alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text")).join(several, F.col("id") == several.doc_id, "left_semi")
    told = rows.mapInArrow(_digests, T.StructType([*rows.schema.fields, T.StructField("digest", T.BinaryType())]))
    told = materialize(told.drop("text"), "told")
    stay = told.join(winners, (F.col("id") == F.col("kept_id")) & (F.col("digest") == F.col("kept_digest"))).groupBy("id", "digest").agg(F.min_by("row", F.to_json("row")).alias("row"))
    return once.unionByName(stay.select("row.*")).unionByName(told.filter("digest is null").select("row.*"))
