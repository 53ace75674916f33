"""Files of token ids: frequency-ranked, byte-aligned variable-length codes with separate control bytes.

Ids are replaced by their rank among all ids of the corpus (most frequent first,
ties to the smaller id), so that frequent ids have small codes. Four codes share a
control byte with two bits for each code's number of bytes less one; the codes'
bytes follow the control bytes. Decoding looks up each control byte in a table of
shuffle positions, in numpy, without a loop over codes.

A file is a sequence of blocks in ascending doc_id order, each closed by a line
end. A block is a header (see HEADER), the documents' ids and token counts, the
control bytes and the code bytes. It says how many ids all earlier documents have,
so any block can be read alone. The table of ranks is written beside the files.

Files are written by Spark's own committing writer, in the shared folder: a task
that is lost or repeated leaves no second copy.

Defined results: null text has no ids but the end id; rows that repeat a doc_id
are written one after the other, in any order among them; a null doc_id comes
first and is read back as null; an empty table gives no files and no rows; other
columns are ignored.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from pactum.llm.common import materialize, new_path, task
from pactum.llm.tokens import Encoder

MAGIC = b"PTK1"
#: magic, first id position, shard, block, documents, ids, code bytes
HEADER = struct.Struct("<4sQIIIII")
#: Ids that a block holds before it is closed (a longer document has a block of its own).
BLOCK_IDS = 1 << 20
NO_ID = -(1 << 63)
#: Texts that are handled at once in a worker.
SLICE = 256


# --- the code -----------------------------------------------------------------


def pack_codes(codes: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and code bytes of unsigned 32-bit codes."""
    n = len(codes)
    kind, width = ("<u2", 2) if codes.max(initial=0) <= 0xFFFF else ("<u4", 4)
    padded = np.zeros(-(-n // 4) * 4, kind)
    padded[:n] = codes
    used = np.ones((len(padded), width), bool)  # which of a code's bytes are written
    for byte in range(1, width):
        used[:, byte] = padded >= 1 << 8 * byte
    more = used[:, 1:].sum(axis=1, dtype=np.uint8).reshape(-1, 4) if width > 2 else used[:, 1].astype(np.uint8).reshape(-1, 4)
    control = more[:, 0] | more[:, 1] << 2 | more[:, 2] << 4 | more[:, 3] << 6
    return control.tobytes(), padded[:n].view(np.uint8)[used[:n].reshape(-1)].tobytes()


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each control byte the sizes of its four codes; for each size the bits that a code of it has."""
    sizes = (np.arange(256, dtype=np.uint8)[:, None] >> np.array([0, 2, 4, 6], np.uint8) & 3) + np.uint8(1)
    return sizes, np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], "<u4")


def unpack_codes(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n codes, by table lookup: control bytes give sizes, their sums places, and each place four bytes to mask."""
    sizes, bits = _tables()
    size = sizes[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    place = np.cumsum(size, dtype=np.int64) - size
    held = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(4, np.uint8)])
    words = np.lib.stride_tricks.as_strided(held.view("<u4") if len(held) % 4 == 0 else held[: len(held) // 4 * 4].view("<u4"), (len(held) - 3,), (1,))
    return words[place] & bits[size]


# --- encoding -----------------------------------------------------------------

_RAW = T.StructType([T.StructField(n, t) for n, t in (("shard", T.IntegerType()), ("block", T.IntegerType()), ("before", T.LongType()), ("n_ids", T.LongType()), ("doc_ids", T.BinaryType()), ("counts", T.BinaryType()), ("ids", T.BinaryType()), ("seen", T.BinaryType()), ("times", T.BinaryType()))])


@task("token ids")
def _encode_blocks(path: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder = Encoder.of(path)
    end = np.array([end_id], encoder.kind)
    shard, block, before = TaskContext.get().partitionId(), 0, 0
    docs: list[int] = []
    counts: list[int] = []
    parts: list[np.ndarray] = []

    def close() -> pa.RecordBatch:
        ids = np.concatenate(parts)
        times = np.bincount(ids)
        seen = np.flatnonzero(times)
        row = [shard, block, before, len(ids), np.array(docs, "<i8").tobytes(), np.array(counts, "<i8").tobytes(), ids.tobytes(), seen.astype("<u4").tobytes(), times[seen].astype("<i8").tobytes()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), *[pa.binary()] * 5), strict=True)], names=_RAW.names)

    held = 0
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            for doc_id, ids in zip(piece.column(0).to_pylist(), encoder.ids_of_many(piece.column(1).to_pylist()), strict=True):
                docs.append(NO_ID if doc_id is None else doc_id)
                counts.append(len(ids) + 1)
                parts += [ids, end]
                held += len(ids) + 1
                if held >= BLOCK_IDS:
                    yield close()
                    block, before, held = block + 1, before + held, 0
                    docs, counts, parts = [], [], []
    if docs:
        yield close()


def encode_sorted(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Blocks of raw ids in ascending order of key; the texts are dealt by ranges of key and sorted there."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(partial(_encode_blocks, path, end_id), _RAW)


# --- files --------------------------------------------------------------------


@task("token files")
def _count_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of its blocks' counts."""
    total = np.zeros(0, np.int64)
    for batch in batches:
        for seen, times in zip(*batch.columns, strict=True):
            ids = np.frombuffer(seen.as_buffer(), "<u4")
            if len(ids) and ids[-1] >= len(total):
                total = np.concatenate([total, np.zeros(int(ids[-1]) + 1 - len(total), np.int64)])
            total[ids] += np.frombuffer(times.as_buffer(), "<i8")
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])


@task("token files")
def _write_blocks(kind: str, rank_of, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ranks = np.frombuffer(rank_of.value, "<u4")
    for batch in batches:
        for place in range(batch.num_rows):  # a block at a time, as each has some megabytes
            row = batch.slice(place, 1).to_pylist()[0]
            codes = ranks[np.frombuffer(row["ids"], kind)]
            control, data = pack_codes(codes)
            n_docs = len(row["doc_ids"]) // 8
            head = HEADER.pack(MAGIC, row["base"] + row["before"], row["shard"], row["block"], n_docs, len(codes), len(data))
            yield pa.RecordBatch.from_arrays([pa.array([row["shard"]], pa.int32()), pa.array([b"".join((head, row["doc_ids"], row["counts"], control, data))], pa.binary())], names=["shard", "bytes"])


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, key: str = "doc_id", text: str = "text") -> None:
    """Encode docs and write `ranks` and the files `ids/shard=*/…` below path."""
    spark = docs.sparkSession
    encoder = Encoder.of(vocabulary)
    raw = materialize(encode_sorted(docs, vocabulary, end_id, key, text), "raw_ids")
    counts = raw.select("seen", "times").mapInArrow(_count_ids, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    # As many rows as the vocabulary has ids, whatever the corpus holds.
    order = [r.id for r in counts.orderBy(F.desc("n"), "id").select("id").collect()]
    spark.createDataFrame([(bytes(np.array(order, "<u4").tobytes()),)], "ids binary").coalesce(1).write.parquet(f"{path}/ranks")
    ranks = np.zeros(max(order, default=0) + 1, "<u4")
    ranks[order] = np.arange(len(order))
    # One number for each shard, and a shard for each task that encoded.
    shards = raw.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    base = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    blocks = raw.drop("seen", "times").join(F.broadcast(base), "shard").mapInArrow(partial(_write_blocks, encoder.kind, spark.sparkContext.broadcast(ranks.tobytes())), "shard int, bytes binary")
    # The text writer puts a value's bytes into the file as they are.
    blocks.select("shard", F.col("bytes").cast("string").alias("value")).write.partitionBy("shard").text(f"{path}/ids")


@task("token files")
def _read_blocks(order: bytes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    id_of = np.frombuffer(order, "<u4")
    for batch in batches:
        for content in batch.column(0):
            for base, docs, counts, ids in blocks_of(memoryview(content.as_buffer()), id_of):
                ends = np.cumsum(counts)
                starts = ends - counts
                held = pa.array([ids[a:b].tobytes() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64(), mask=docs == NO_ID), pa.array(starts + base, pa.int64()), pa.array(counts, pa.int64()), held], names=["doc_id", "start", "n_tokens", "ids"])


def blocks_of(content, id_of: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(position of the first id, doc ids, id counts, ids as unsigned 32-bit) of each block in a file's bytes."""
    at = 0
    while at < len(content):
        magic, base, _, _, n_docs, n_ids, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        docs = np.frombuffer(content, "<i8", n_docs, at)
        counts = np.frombuffer(content, "<i8", n_docs, at + 8 * n_docs)
        at += 16 * n_docs
        n_control = -(-n_ids // 4)
        codes = unpack_codes(content[at : at + n_control], content[at + n_control : at + n_control + n_data], n_ids)
        at += n_control + n_data + 1
        yield base, docs, counts, id_of[codes].astype("<u4", copy=False)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each document of the files: doc_id, start, n_tokens and its ids as little-endian unsigned 32-bit integers."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    order = bytes(ranks[0].ids)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/ids").select("content")
    return files.mapInArrow(partial(_read_blocks, order), "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0) -> DataFrame:
    """Write docs into new files in the shared folder and read them back."""
    path = new_path(docs.sparkSession, "token_files")
    write(docs, path, vocabulary, end_id)
    return read(docs.sparkSession, path)
