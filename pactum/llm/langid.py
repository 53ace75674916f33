"""Language identification by hyperdimensional profiles.

Every letter has a random vector of plus and minus ones, drawn from a generator
seeded by its code point. An n-gram's vector binds its letters' vectors, each
permuted (rotated) by its place, by multiplication; a document's vector bundles its
n-grams' vectors by addition. A language's prototype bundles the unit vectors of all
documents of that language, and a document has the language whose prototype has the
greatest cosine with it; the cosine is the score.

Text is lower-cased, and what lies between letters counts as one blank. Prototypes
are sums of integers (unit vectors scaled and rounded), so they are the same for any
order and dealing of the rows.

Text in a language that was not learned has a greatest cosine well above chance, as
it shares n-grams and blanks with the others. What still counts as a language is
therefore learned from the cosines of its own training rows (`limits`), each with
the prototype of the others.

Defined results: null text, and text without a letter, is `und` with score 0; rows
with a null label teach nothing; equal cosines go to the smaller label; where nothing
is learned all is `und`; rows that repeat a key are judged one by one; an empty table
gives an empty result; other columns are kept by `predict`.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pactum.llm.common import free_name, kept, task

UNKNOWN = "und"
SLICE = 256
#: n-gram vectors that a worker remembers.
REMEMBERED = 40_000
SCALE = 1 << 20
#: The share of a language's training rows that may lie below its limit, the rows from which it is read, and the steps of a cosine.
LOW, ENOUGH, STEPS = 0.01, 100, 1000
#: Labels that a model can have, a vector each on the driver: there are fewer languages.
MOST_LABELS = 10_000


@dataclass(frozen=True)
class Space:
    size: int = 512
    n: int = 3
    seed: int = 11


@lru_cache(maxsize=1)
def _is_letter() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


class Bundler:
    """Document vectors; one a process and space."""

    def __init__(self, space: Space):
        self.space = space
        self.letters: dict[int, np.ndarray] = {}
        self.row_of: dict[int, int] = {}
        self.table = np.empty((REMEMBERED, space.size), np.float32)

    @classmethod
    def of(cls, space: Space) -> Bundler:
        return kept((cls, space), lambda: cls(space))

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            self.letters[code] = np.random.default_rng([self.space.seed, code]).integers(0, 2, self.space.size).astype(np.int8) * 2 - 1
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        """The vector of an n-gram, given as its code points, 21 bits each."""
        v = np.ones(self.space.size, np.int8)
        for place in range(self.space.n):
            v = v * np.roll(self.letter(gram >> 21 * place & 0x1FFFFF), place)
        return v

    def grams(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams and their counts; none if the text has no letter."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _is_letter()[points]
        if not letter.any():
            return none, none
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # of blanks in a row, the first
        x = np.concatenate([[32], np.where(letter, points, 32)[keep], [32]]).astype(np.int64)
        if x[-2] == 32:
            x = x[:-1]
        if len(x) < self.space.n:
            x = np.concatenate([x, np.full(self.space.n - len(x), 32)])
        m = len(x) - self.space.n + 1
        codes = np.zeros(m, np.int64)
        for place in range(self.space.n):
            codes |= x[place : place + m] << 21 * place
        return np.unique(codes, return_counts=True)

    def vector(self, text: str | None) -> np.ndarray | None:
        grams, counts = self.grams(text)
        if not len(grams):
            return None
        out = np.zeros(self.space.size, np.float64)
        for first in range(0, len(grams), 4096):
            part = grams[first : first + 4096].tolist()
            missing = [g for g in part if g not in self.row_of]
            if len(self.row_of) + len(missing) > REMEMBERED:
                self.row_of.clear()
                missing = part
            for g in missing:
                self.table[len(self.row_of)] = self.bound(g)
                self.row_of[g] = len(self.row_of)
            rows = np.fromiter(map(self.row_of.__getitem__, part), np.int64, len(part))
            out += counts[first : first + 4096].astype(np.float32) @ self.table[rows]
        return out

    def unit(self, text: str | None) -> np.ndarray | None:
        v = self.vector(text)
        if v is None or not (norm := np.linalg.norm(v)):
            return None
        return v / norm


@task("langid")
def _bundle(space: Space, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b = Bundler.of(space)
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            for label, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                unit = b.unit(text)
                if unit is not None:
                    if label not in sums:
                        sums[label] = np.zeros(space.size, np.int64)
                    sums[label] += np.rint(unit * SCALE).astype(np.int64)
    for label, total in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([label]), pa.array([total], pa.list_(pa.int64()))], names=["lang", "total"])


@task("langid")
def _own_cosines(space: Space, labels: list[str], sums, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    b, place = Bundler.of(space), {label: i for i, label in enumerate(labels)}
    counts: Counter[tuple[str, int]] = Counter()
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            for label, text in zip(piece.column(0).to_pylist(), piece.column(1).to_pylist(), strict=True):
                unit = b.unit(text)
                if unit is None:
                    continue
                others = sums.value[place[label]] - np.rint(unit * SCALE)
                if norm := np.linalg.norm(others):
                    counts[label, int(np.floor(np.rint(others @ unit / norm * 1e9) / 1e9 * STEPS))] += 1
    keys = list(counts)
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.int32()), pa.array([counts[k] for k in keys], pa.int64())], names=["lang", "step", "n"])


@task("langid")
def _predict(space: Space, labels: list[str], prototypes, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The columns of each batch, of which the last is a text, and the text's language and score."""
    b = Bundler.of(space)
    p = prototypes.value
    for batch in batches:
        for first in range(0, batch.num_rows, SLICE):
            piece = batch.slice(first, SLICE)
            found, scores = [], []
            for text in piece.column(piece.num_columns - 1).to_pylist():
                unit = b.unit(text) if labels else None
                if unit is None:
                    found.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                cosines = np.rint(p @ unit * 1e9) / 1e9
                best = int(cosines.argmax())
                found.append(labels[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([*piece.columns, pa.array(found, pa.string()), pa.array(scores, pa.float64())], names=[*piece.schema.names, "lang_pred", "score"])


@dataclass(frozen=True)
class Model:
    """labels, ascending, and their unit prototypes: a vector for each language of the training rows. sums: before they were made units."""

    space: Space
    labels: list[str]
    prototypes: np.ndarray
    sums: np.ndarray


def learn(labelled: DataFrame, space: Space = Space(), text: str = "text", lang: str = "lang") -> Model:
    """Bundle all rows of labelled. Each task sends one vector for each language, and the driver gets one for each language: more than MOST_LABELS fail."""
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    sums = rows.mapInArrow(partial(_bundle, space), "lang string, total array<long>")
    totals = sums.select("lang", F.posexplode("total").alias("place", "x")).groupBy("lang", "place").agg(F.sum("x").alias("x"))
    by_lang = totals.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("xs"))
    found = sorted((r.lang, [v.x for v in r.xs]) for r in by_lang.limit(MOST_LABELS + 1).collect())
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels: the column does not hold languages")
    p = np.array([v for _, v in found], np.float64).reshape(len(found), space.size)
    return Model(space, [label for label, _ in found], p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-300), p)


def limits(labelled: DataFrame, model: Model, text: str = "text", lang: str = "lang") -> dict[str, float]:
    """The least cosine for each language, from the rows that model was learned from.

    It is the low quantile of the rows' cosines with the other rows' prototype, less one
    standard deviation of chance, and up to another the fewer rows tell the quantile. A language of few rows takes the quantile of all
    languages' rows. The driver gets counts, whose number the steps of a cosine bound.
    """
    rows = labelled.filter(F.col(lang).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    shared = labelled.sparkSession.sparkContext.broadcast(model.sums)
    counts = rows.mapInArrow(partial(_own_cosines, model.space, model.labels, shared), "lang string, step int, n long").groupBy("lang", "step").agg(F.sum("n").alias("n"))
    own: dict[str, Counter] = {label: Counter() for label in model.labels}
    for r in counts.collect():
        own[r.lang][r.step] += r.n
    everything = sum(own.values(), Counter())

    def low(c: Counter) -> float:
        rank, seen = int(LOW * c.total()), 0
        for step in sorted(c):
            seen += c[step]
            if seen > rank:
                return step / STEPS - model.space.size**-0.5 * (1 + (ENOUGH / c.total()) ** 0.5)
        return 0.0

    return {label: low(c if c.total() >= ENOUGH else everything) for label, c in own.items()}


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with its columns, `lang_pred` and `score`; columns of docs with these names are replaced."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    # The text is the last column, as _predict has it, and goes to the workers once.
    rows = docs.select(*[c for c in kept if c != text], F.col(text).alias(text if text in kept else free_name(docs, "of")))
    schema = rows.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema
    shared = docs.sparkSession.sparkContext.broadcast(model.prototypes)
    return rows.mapInArrow(partial(_predict, model.space, model.labels, shared), schema).select(*kept, "lang_pred", "score")


def held_out(key: str = "doc_id"):
    """Whether a row is kept from training: the CRC-32 of its key's text leaves 1 when divided by 3. A null key's row is not, but teaches nothing either."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.filter(F.crc32(F.col(key).cast("string")) % 3 != 1)


def filter_documents(docs: DataFrame, min_score: float | None = None, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of docs in a learned language, with their own columns: by a cosine of at least min_score, or of the language's own limit."""
    taught = training_rows(docs, key)
    model = learn(taught, text=text, lang=lang)
    own = [f"_{i}" for i in range(len(docs.columns))]  # no column of docs is taken for a result of predict
    at = docs.columns.index(text) if text in docs.columns else [c.lower() for c in docs.columns].index(text.lower())
    judged = predict(docs.toDF(*own), model, own[at])
    least = F.lit(min_score)
    if min_score is None:
        known = limits(taught, model, text, lang)
        least = F.element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), F.col("lang_pred")) if known else F.lit(0.0)
    return judged.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)).select(*[F.col(o).alias(c) for o, c in zip(own, docs.columns, strict=True)])
