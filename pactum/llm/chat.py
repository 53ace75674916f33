"""Chat formatting, assembled from tokens.

Each turn is a segment of its own: a reserved id for its role, the ids of its text,
and a reserved id for its end. Reserved ids follow the vocabulary, so no text can
make one; where the output is read as text they stand for the marks in MARKS.
Marks that occur inside a text are escaped all the same: a run of backslashes
before a mark, of none or more, gets one more, and loses one when read. A role
without a mark of its own is written as a segment between two reserved ids.

The loss mask covers the ids of assistants' texts. It is derived from the segments'
lengths by prefix sums: plus one where a masked segment begins, minus one after it.
Ids are stored as little-endian unsigned 32-bit integers, the mask as a byte for each.

Turns are rows: a conversation of any length is formatted and read in a stream, in
order of conversation and turn, and no conversation is gathered in one row.

Defined results: null text and null role are empty; a null turn comes first; rows
that repeat a turn follow each other by role and text; a null conv_id is a
conversation of its own; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache, partial
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.tokens import Encoder

#: The marks of reserved ids, in the order of the ids. Fixed values.
MARKS = ("### System:\n", "### User:\n", "### Assistant:\n", "### Tool:\n", "### Role ", ":\n", "\n</turn>\n")
ROLES = ("system", "user", "assistant", "tool")
OPEN_ROLE, CLOSE_ROLE, END = 4, 5, 6
LOSS_ROLE = "assistant"
#: What is escaped in texts: the marks' words.
CONTROL = r"(?:###[ \t\r\n]*(?:System|User|Assistant|Tool|Role)|</turn>)"
SLICE = 256

FORMATTED = "conv_id long, turn_no long, position long, ids binary, loss binary"
READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


@lru_cache(maxsize=2)
def _spelling(path: str) -> list[bytes]:
    """The bytes of each id, the reserved ones included."""
    return [*Encoder.of(path, special=False).bytes_of_ids(), *(m.encode() for m in MARKS)]


def escape(text: str) -> str:
    """text with one more backslash before each mark. A run of backslashes counts as a whole."""
    return re.sub(rf"(?<!\\)(\\*)({CONTROL})", r"\1\\\2", text)


def unescape(text: str) -> str:
    return re.sub(rf"(?<!\\)\\(\\*)({CONTROL})", r"\1\2", text)


def assemble(segments: list[np.ndarray], marked: list[bool]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of all segments, the mask of those that are marked, by prefix sums over the segments' bounds, and the segments' ends."""
    ends = np.cumsum(np.fromiter(map(len, segments), np.int64, len(segments)))
    of = np.array(marked, np.int8)
    change = np.zeros(int(ends[-1]) + 1, np.int8)
    # Empty segments may share a bound, so changes are added up.
    np.add.at(change, np.concatenate([[0], ends[:-1]]), of)
    np.subtract.at(change, ends, of)
    return np.concatenate(segments), np.cumsum(change[:-1], dtype=np.int8), ends


def _format(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path, special=False)
    reserved = [np.array([encoder.size + i], "<u4") for i in range(len(MARKS))]
    now: tuple = ()
    turn = position = 0
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            convs, roles, texts = (c.to_pylist() for c in piece.columns)
            segments: list[np.ndarray] = []
            marked: list[bool] = []
            last = []  # the number of segments up to each turn's end
            for role, text in zip(roles, texts, strict=True):
                role = role or ""
                if role in ROLES:
                    segments.append(reserved[ROLES.index(role)])
                else:
                    segments += [reserved[OPEN_ROLE], encoder.ids(escape(role)).astype("<u4"), reserved[CLOSE_ROLE]]
                segments += [encoder.ids(escape(text or "")).astype("<u4"), reserved[END]]
                marked += [False] * (len(segments) - len(marked) - 2) + [role == LOSS_ROLE, False]
                last.append(len(segments) - 1)
            ids, loss, ends = assemble(segments, marked)
            bounds = [0, *ends[last].tolist()]
            held, mask = ids.tobytes(), loss.tobytes()
            turns, positions = [], []
            for conv, a, b in zip(convs, bounds, bounds[1:], strict=False):
                if now != (conv,):
                    now, turn, position = (conv,), 0, 0
                turns.append(turn)
                positions.append(position)
                turn, position = turn + 1, position + b - a
            out = (convs, turns, positions, [held[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:], strict=False)], [mask[a:b] for a, b in zip(bounds, bounds[1:], strict=False)])
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["conv_id", "turn_no", "position", "ids", "loss"])


def format_turns(turns: DataFrame, vocabulary: str, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each turn: its place in the conversation, its ids, and their loss mask."""
    rows = turns.select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.select("conv_id", "role", "text").mapInArrow(partial(_format, vocabulary), FORMATTED)


class _Conversation:
    def __init__(self, conv: int | None):
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(path: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encoder = Encoder.of(path, special=False)
    spell = _spelling(path).__getitem__
    text_of = lambda ids: b"".join(map(spell, ids)).decode("utf-8")
    now: _Conversation | None = None
    done: list[tuple] = []

    def flush() -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], t) for i, t in enumerate(kinds)], names=names)
        done.clear()
        return batch

    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            convs, all_ids, masks = (c.to_pylist() for c in piece.columns)
            for conv, held, mask in zip(convs, all_ids, masks, strict=True):
                ids = memoryview(held).cast("I").tolist()
                if now is None or now.conv != conv:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv)
                mark = ids[0] - encoder.size
                start = 1
                if mark == OPEN_ROLE:
                    start = ids.index(encoder.size + CLOSE_ROLE) + 1
                    role = unescape(text_of(ids[1 : start - 1]))
                else:
                    role = ROLES[mark]
                body = text_of(ids[start:-1])
                text = unescape(body)
                now.turns += 1
                now.chars += len(text_of(ids[:start])) + len(body) + len(text_of(ids[-1:]))
                now.all.update(f"{role}\n{text}\n".encode())
                if 1 in mask:
                    under = list(compress(ids, mask))
                    covered = text if under == ids[start:-1] else unescape(text_of(under))
                    now.loss_chars += len(covered)
                    now.loss.update(covered.encode())
            if done:
                yield flush()
    if now is not None:
        done.append(now.row())
        yield flush()


def read_back(formatted: DataFrame, vocabulary: str) -> DataFrame:
    """A row for each conversation, read from ids and masks alone."""
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn_no")
    return ordered.select("conv_id", "ids", "loss").mapInArrow(partial(_read, vocabulary), READ)


def render(ids: bytes, vocabulary: str) -> str:
    """The formatted text of a turn's ids."""
    return b"".join(map(_spelling(vocabulary).__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8")
