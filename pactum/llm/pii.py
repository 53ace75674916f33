"""Personal data, by rules and a skip-chain conditional random field.

Rules find the base spans: e-mail addresses, IPv4 addresses, card numbers and phone
numbers. The field then labels every mention of a document: the base spans, and the
stretches between them that look like one (digits enough, or an @). A mention's own
potential is a table over its shape; neighbouring mentions share a chain potential;
and mentions with the same digits or the same address, wherever they stand, share a
skip potential, through one common node for each such group, so that a thousand
repetitions make a thousand edges and not half a million. Loopy belief propagation
gives each mention its belief; base spans are observed, so they stay, and a mention
between them with a label's belief over one half becomes a further span.

A mention that repeats a base span of its document is not known to be no personal
data, so its shape says nothing about it: it is left out of the tables of shapes and
its own potential is flat. Its group's common node is observed where all base spans
of the group are of one kind. So neither the number of mentions of its shape in the
corpus nor that of its repetitions in the document outweighs the base span.

The tables are trained piecewise on all documents: each is the logarithm of smoothed
counts, and counts of tasks add up. A message passes at most `rounds` times.

Defined results: null text is empty and has no spans; overlong digit runs, repeated
rows and texts of any length are handled by passes that are linear in the text; an
empty table gives an empty result; other columns are kept by `find` and `mask`.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pactum.llm.common import free_name, task

KINDS = ("email", "ip", "card", "phone")
OTHER = len(KINDS)
SLICE = 256

# The base rules. The local part of an address is the run before an @; a look-behind
# keeps a run of digits from being tried again at each of its digits.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
# What the field looks at between base spans.
_NUMBERS = re.compile(r"\(?[0-9](?:[ ().-]{0,2}[0-9])+")
_RUN = re.compile(r"[^\s@]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the e-mail pattern finds, leftmost and without overlap, from each @ outwards."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last))


def _octet(digits: str) -> bool:
    value = digits.lstrip("0")
    return len(value) < 4 and int(value or "0") <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind), ordered by start and then kind. Spans of different kinds may overlap."""
    found = [(a, b, 0) for a, b in _emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        if "." in text:
            found += [(*m.span(), 1) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
                found.append((*m.span(), 2))
        if "+" in text:
            found += [(*m.span(), 3) for m in _PHONE.finditer(text) if 10 <= len(_NOT_DIGIT.sub("", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


# --- mentions -----------------------------------------------------------------


def _between(text: str, spans: list[tuple[int, int, int]]) -> Iterator[tuple[int, int]]:
    at = 0
    for start, end, _ in spans:
        if start > at:
            yield at, start
        at = max(at, end)
    if at < len(text):
        yield at, len(text)


def _around_at(text: str, first: int, end: int) -> Iterator[tuple[int, int]]:
    """The runs without white space that hold an @, leftmost and without overlap. Each character is passed twice at most, as an @ ends a run."""
    last, at = first, text.find("@", first, end)
    while at >= 0:
        start = at
        while start > last and text[start - 1] != "@" and not text[start - 1].isspace():
            start -= 1
        if start < at and (m := _RUN.match(text, at + 1, end)):
            yield start, m.end()
            last = m.end()
        at = text.find("@", max(at + 1, last), end)


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(start, end, kind or OTHER): the base spans, and what looks like one between them."""
    out = list(spans)
    has_at, has_digit = "@" in text, _DIGIT.search(text)
    if has_at or has_digit:
        for first, end in _between(text, spans):
            if has_digit:
                for m in _NUMBERS.finditer(text, first, end):
                    parts = [m.span()]
                    if len(_NOT_DIGIT.sub("", m.group())) > 19:  # several numbers side by side
                        parts = [(m.start() + w.start(), m.start() + w.end()) for w in re.finditer(r"[^ ]+", m.group())]
                    out += [(a, b, OTHER) for a, b in parts if len(_NOT_DIGIT.sub("", text[a:b])) >= 7]
            if has_at:
                out += [(a, b, OTHER) for a, b in _around_at(text, first, end)]
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def shape(s: str) -> str:
    """The class of a mention's own potential: what it is made of, whether it passes a kind's arithmetic."""
    if "@" in s:
        return f"at {bool(_DOMAIN.search(s, s.index('@')))}"
    digits = _NOT_DIGIT.sub("", s)
    dots, groups = s.count("."), len(re.findall(r"[0-9]+", s))
    quad = dots == 3 and groups == 4 and all(map(_octet, re.findall(r"[0-9]+", s)))
    return f"{min(len(digits), 20)} {'+' if s.startswith('+') else '('if '(' in s else ''} {min(groups, 5)} {'quad' if quad else ''} {14 <= len(digits) <= 19 and luhn(digits)}"


def same_key(s: str) -> str:
    """Mentions with equal keys share a skip potential: the address, or up to the last ten digits and their number's class."""
    if "@" in s:
        return s.lower().strip(".,;:!?<>()[]\"'")
    digits = _NOT_DIGIT.sub("", s)
    return digits[-10:] if len(digits) < 14 else digits


# --- training -----------------------------------------------------------------


@dataclass(frozen=True)
class Field:
    """shapes: a row of log potentials for each known shape; chain and skip: the reward for equal labels."""

    shapes: dict[str, tuple[float, ...]]
    chain: float = 0.0
    skip: float = 0.0
    rounds: int = 20


#: The pairs of mentions with equal keys that count as seen with equal labels before any is, and how near neighbours must
#: be to share a chain potential. A hundred pairs outweigh two neighbours' chain potentials in a corpus without such pairs.
ALIKE, NEAR = 100, 64


def repeated(found: list[tuple[int, int, int]], keys: list[str]) -> dict[str, set[int]]:
    """The kinds of the base spans of each key that has some."""
    out: dict[str, set[int]] = {}
    for (_, _, kind), key in zip(found, keys, strict=True):
        if kind != OTHER:
            out.setdefault(key, set()).add(kind)
    return out


@task("pii")
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, int]] = Counter()
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            for text in batch.column(0).slice(first, SLICE).to_pylist():
                if not text:
                    continue
                found = mentions(text, base_spans(text))
                keys = [same_key(text[start:end]) for start, end, _ in found]
                base = repeated(found, keys)
                firsts: dict[str, tuple[int, int]] = {}
                known = []  # each mention's label, or None
                for (start, end, kind), key in zip(found, keys, strict=True):
                    kinds = base.get(key)
                    if kind == OTHER and kinds:
                        known.append(next(iter(kinds)) if len(kinds) == 1 else None)
                        continue
                    known.append(kind)
                    counts[f"shape {shape(text[start:end])}", kind] += 1
                    if kind != OTHER:
                        first_end, first_kind = firsts.setdefault(key, (end, kind))
                        if start >= first_end:  # not another reading of the same stretch
                            counts["skip", kind == first_kind] += 1
                for (_, a, _), (b, _, _), k, j in zip(found, found[1:], known, known[1:], strict=False):
                    if b - a <= NEAR and k is not None and j is not None:
                        counts["chain", k == j] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([int(v) for _, v in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["table", "label", "n"])


def train(docs: DataFrame, text: str = "text") -> Field:
    """Potentials from the counts of all rows. Their number is that of the shapes, which digits, groups and marks bound."""
    counts = docs.select(F.col(text).alias("text")).mapInArrow(_count, "table string, label int, n long").groupBy("table", "label").agg(F.sum("n").alias("n"))
    tables: dict[str, Counter] = {}
    for r in counts.collect():
        tables.setdefault(r.table, Counter())[r.label] += r.n
    pair = lambda name, alike: math.log((tables.get(name, {}).get(1, 0) + alike) / (tables.get(name, {}).get(0, 0) + 1))
    shapes = {}
    for name, c in tables.items():
        if name.startswith("shape "):
            total = sum(c.values())
            shapes[name[6:]] = tuple(math.log((c.get(k, 0) + 0.1) / (total + 0.1 * (OTHER + 1))) for k in range(OTHER + 1))
    return Field(shapes, max(0.0, min(1.0, pair("chain", 1))), max(0.0, pair("skip", ALIKE)))


# --- inference ----------------------------------------------------------------


def _messages(own: np.ndarray, edges: np.ndarray, reward: np.ndarray, rounds: int) -> np.ndarray:
    """Beliefs of nodes with log potentials `own`, by sum-product over edges whose potentials reward equal labels."""
    n, k = own.shape
    to, of = np.concatenate([edges[:, 1], edges[:, 0]]), np.concatenate([edges[:, 0], edges[:, 1]])
    gain = np.expm1(np.concatenate([reward, reward]))[:, None]
    back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
    sent = np.zeros((len(to), k))
    for _ in range(rounds):
        gathered = own.copy()
        np.add.at(gathered, to, sent)
        given = gathered[of] - sent[back]
        p = np.exp(given - given.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        new = np.log1p(gain * p)
        change = np.abs(new - sent).max(initial=0)
        sent = 0.5 * (sent + new)
        if change < 1e-6:
            break
    gathered = own.copy()
    np.add.at(gathered, to, sent)
    p = np.exp(gathered - gathered.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def label(texts: list[str | None], field: Field) -> list[list[tuple[int, int, int, bool]]]:
    """For each text its spans (start, end, kind, whether it is a base span). The documents' fields are solved side by side."""
    unseen = tuple([math.log(0.1 / 1.1)] * OTHER + [math.log(1 / 1.1)])
    flat = (0.0,) * (OTHER + 1)
    observed = [tuple(0.0 if k == kind else -math.inf for k in range(OTHER + 1)) for kind in range(OTHER)]
    out: list[list[tuple[int, int, int, bool]]] = []
    own, edges, reward, asked = [], [], [], []
    for i, text in enumerate(texts):
        if not text:
            out.append([])
            continue
        spans = base_spans(text)
        out.append([(*s, True) for s in spans])
        found = mentions(text, spans)
        if len(found) == len(spans):
            continue  # every mention is observed
        keys = [same_key(text[start:end]) for start, end, _ in found]
        base = repeated(found, keys)
        groups: dict[str, list[int]] = {}
        for m, (start, end, kind) in enumerate(found):
            node = len(own)
            if kind == OTHER:
                own.append(flat if keys[m] in base else field.shapes.get(shape(text[start:end]), unseen))
                asked.append((node, i, start, end))
            else:
                own.append(observed[kind])
            if m and start - found[m - 1][1] <= NEAR:
                edges.append((node - 1, node))
                reward.append(field.chain)
            groups.setdefault(keys[m], []).append(node)
        for key, nodes in groups.items():
            if len(nodes) > 1:
                hub = len(own)
                kinds = base.get(key, ())
                own.append(observed[next(iter(kinds))] if len(kinds) == 1 else flat)
                edges += [(node, hub) for node in nodes]
                reward += [field.skip] * len(nodes)
    if asked:
        belief = _messages(np.array(own), np.array(edges, np.int64).reshape(-1, 2), np.array(reward), field.rounds)
        touched = set()
        for node, i, start, end in asked:
            kind = int(belief[node].argmax())
            if kind != OTHER and belief[node, kind] > 0.5:
                out[i].append((start, end, kind, False))
                touched.add(i)
        for i in touched:
            out[i].sort(key=lambda s: (s[0], s[2]))
    return out


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("base", T.BooleanType())]))
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))


def _masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    """text with each stretch of spans that touch replaced by the name of the first one's kind."""
    if not spans:
        return text
    out, at = [], 0
    for start, end, kind, _ in spans:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


@task("pii")
def _find(field, masked: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch, of which the last, a text, gives way to what is found in it."""
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            texts = piece.column(piece.num_columns - 1).to_pylist()
            found = label(texts, field.value)
            if masked:
                added = pa.array([_masked(t, s) for t, s in zip(texts, found, strict=True)], pa.string())
            else:
                added = pa.array([[{"kind": KINDS[k], "start": a, "end": b, "base": base} for a, b, k, base in spans] for spans in found], _ARROW_SPANS)
            yield pa.RecordBatch.from_arrays([*piece.columns[:-1], added], names=piece.schema.names)


def _apply(docs: DataFrame, field: Field, text: str, masked: bool, name: str) -> DataFrame:
    """docs and what is found in their text, as a last column of that name."""
    rows = docs.withColumn(name, F.col(text))
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.StringType() if masked else SPANS)])
    return rows.mapInArrow(partial(_find, docs.sparkSession.sparkContext.broadcast(field), masked), schema)


def find(docs: DataFrame, field: Field, text: str = "text") -> DataFrame:
    """docs with its columns and `spans`: (kind, start, end, base) by start, in code points; replaces a column of that name."""
    own = free_name(docs, "found")
    return _apply(docs, field, text, False, own).select(*[c for c in docs.columns if c != "spans"], F.col(own).alias("spans"))


def mask(docs: DataFrame, field: Field, text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs with its columns, every span in its text replaced by its kind in brackets; `n_chars`, if there, counts anew."""
    own = free_name(docs, "found")
    out = _apply(docs, field, text, True, own)
    changed = {text: F.col(own)} | ({n_chars: F.length(own).cast(docs.schema[n_chars].dataType)} if n_chars in docs.columns else {})
    return out.select(*[changed[c].alias(c) if c in changed else F.col(c) for c in docs.columns])


def joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
