"""Order-preserving packing of documents into training sequences by dynamic programming.

Documents, in order of their key, make one stream of token ids. A window is a
sequence of at most `length` ids; cuts may fall at the ends of documents (free),
at the ends of all sentences (`sentence_penalty`), or, where neither is near, anywhere
(`hard_penalty`). A sentence ends with a line, with a mark before white space, or with
an ideographic mark. Over the candidate cuts, with stream positions p, the least cost is

    f[j] = penalty[j] + min over i of f[i] + padding of the windows from p[i] to p[j]

where one window pads length - (p[j] - p[i]), and two windows, of which the first is
full and ends in a hard cut, pad 2 * length - (p[j] - p[i]). Both are constants plus
f[i] + p[i], so a monotone queue for each of the two spans gives the minimum over a
sliding range, and each candidate enters and leaves a queue once.

The stream is dealt by ranges of the key. A worker keeps about `buffer` ids: it cuts
them, gives out all but the last two windows, and goes on with those.

Defined results: null text counts as empty, and has the end id alone; rows that
repeat a key are separate documents, one after the other; rows with a null key come
first; an empty table gives no pieces; other columns are ignored. A text of any
length is cut; no id is dropped or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import task
from pactum.llm.tokens import Encoder

SLICE = 256
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


@dataclass(frozen=True)
class Packing:
    """shard_bits: bits of sequence_id below the shard's number."""

    length: int = 2048
    sentence_penalty: int = 4
    hard_penalty: int = 24
    buffer: int = 1 << 20
    shard_bits: int = 32


def best_cuts(at: np.ndarray, penalty: np.ndarray, length: int, hard_penalty: int) -> list[int]:
    """The cut positions of least cost. at: candidate positions, ascending, from 0 to the end, no two over `length` apart."""
    p, pen = at.tolist(), penalty.tolist()
    n = len(p)
    best = [0] * n  # f[i] + p[i]
    back = [0] * n
    # One queue for windows that span up to one length, one for up to two; each holds candidates of ascending f + p.
    one, two = [0], [0]
    head1 = head2 = 0
    double = 2 * length
    for j in range(1, n):
        pj = p[j]
        low = pj - length
        while p[one[head1]] < low:
            head1 += 1
        low -= length
        while p[two[head2]] < low:
            head2 += 1
        i, k = one[head1], two[head2]
        cost, other = best[i] + length, best[k] + double + hard_penalty
        if other < cost:
            i, cost = k, other
        cost += pen[j]
        best[j], back[j] = cost, i
        while len(one) > head1 and best[one[-1]] >= cost:
            one.pop()
        one.append(j)
        while len(two) > head2 and best[two[-1]] >= cost:
            two.pop()
        two.append(j)
    cuts, j = [p[-1]], n - 1
    while j:
        i = back[j]
        if p[j] - p[i] > length:
            cuts.append(p[i] + length)
        cuts.append(p[i])
        j = i
    return cuts[::-1]


def candidates(ids: np.ndarray, doc_ends: np.ndarray, ends: np.ndarray, starts: np.ndarray, alone: np.ndarray, k: Packing) -> tuple[np.ndarray, np.ndarray]:
    """Positions where the stream may be cut, and their penalties."""
    total = len(ids)
    sentence = np.flatnonzero(ends[ids[:-1]] & starts[ids[1:]] | alone[ids[:-1]]) + 1
    known = np.unique(np.concatenate([[0], sentence, doc_ends, [total]]))
    gaps = np.diff(known)
    wide = np.flatnonzero(gaps > k.length)
    filled = [np.arange(known[i] + k.length, known[i + 1], k.length) for i in wide]
    at = np.unique(np.concatenate([known, *filled])) if filled else known
    penalty = np.full(len(at), k.hard_penalty)
    penalty[np.searchsorted(at, sentence)] = k.sentence_penalty
    penalty[np.searchsorted(at, doc_ends)] = 0
    penalty[-1] = 0
    return at, penalty


def sentence_marks(encoder: Encoder) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each id: whether its text can end a sentence, whether it can begin what follows one, and whether it ends one whatever follows."""
    ends, starts, alone = (np.zeros(encoder.size + 1, bool) for _ in range(3))
    for i in range(encoder.size):
        text = encoder.decode([i])
        ends[i] = text.endswith("\n") or text.rstrip().endswith((".", "!", "?", "…"))
        starts[i] = text[:1].isspace() or ends[i] and text.startswith("\n")
        alone[i] = text.endswith(("。", "！", "？"))
    return ends, starts, alone


_marks: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}


class _Stream:
    """The ids that are held, and which document each belongs to."""

    def __init__(self, shard: int, k: Packing, marks: tuple[np.ndarray, np.ndarray, np.ndarray]):
        self.k, self.marks = k, marks
        self.next_sequence = shard << k.shard_bits
        self.parts: list[np.ndarray] = []
        self.docs: list[tuple[int | None, int, int, int]] = []  # key, ids before, ids held, all its ids
        self.held = 0

    def add(self, key: int | None, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.docs.append((key, 0, len(ids), len(ids)))
        self.held += len(ids)

    def cut(self, last: bool) -> pa.RecordBatch | None:
        if not self.held:
            return None
        ids = np.concatenate(self.parts)
        sizes = np.array([d[2] for d in self.docs], np.int64)
        doc_ends = np.cumsum(sizes)
        doc_starts = doc_ends - sizes
        bounds = np.array(best_cuts(*candidates(ids, doc_ends, *self.marks, self.k), self.k.length, self.k.hard_penalty), np.int64)
        if not last:
            bounds = bounds[: max(1, len(bounds) - 2)]
        end = int(bounds[-1])
        at = np.unique(np.concatenate([bounds, doc_starts[doc_starts < end]]))
        begin, size = at[:-1], np.diff(at)
        doc = np.searchsorted(doc_starts, begin, "right") - 1
        sequence = np.searchsorted(bounds, begin, "right") - 1
        before = np.array([d[1] for d in self.docs], np.int64)
        wide = ids.astype("<u4")
        batch = pa.RecordBatch.from_arrays(
            [
                pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()),
                pa.array(begin - doc_starts[doc] + before[doc]),
                pa.array(size),
                pa.array(np.array([d[3] for d in self.docs], np.int64)[doc]),
                pa.array(sequence + self.next_sequence),
                pa.array(begin - bounds[sequence]),
                pa.array([wide[a : a + n].tobytes() for a, n in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary()),
            ],
            names=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"],
        )
        self.next_sequence += len(bounds) - 1
        first = int(np.searchsorted(doc_ends, end, "right"))  # the first document with ids left
        left = []
        for i in range(first, len(self.docs)):
            key, gone, n, all_ids = self.docs[i]
            used = max(0, end - int(doc_starts[i]))
            left.append((key, gone + used, n - used, all_ids))
        self.docs, self.parts, self.held = left, [ids[end:]], len(ids) - end
        return batch


@task("packing")
def _pack(path: str, end_id: int, k: Packing, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder = Encoder.of(path)
    if path not in _marks:
        _marks[path] = sentence_marks(encoder)
    stream = _Stream(TaskContext.get().partitionId(), k, _marks[path])
    end = np.array([end_id], encoder.kind)
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            for key, ids in zip(piece.column(0).to_pylist(), encoder.ids_of_many(piece.column(1).to_pylist()), strict=True):
                stream.add(key, np.concatenate([ids, end]))
                if stream.held >= k.buffer:
                    yield stream.cut(last=False)
    if (rest := stream.cut(last=True)) is not None:
        yield rest


def pack(docs: DataFrame, vocabulary: str, end_id: int = 1, packing: Packing = Packing(), key: str = "doc_id", text: str = "text") -> DataFrame:
    """A row for each piece of a document in a sequence, with its ids as little-endian unsigned 32-bit integers."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return ordered.mapInArrow(partial(_pack, vocabulary, end_id, packing), SCHEMA)
