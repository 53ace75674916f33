"""Samples against all segmentations of short texts, and round trips."""

import math
from collections import Counter

import numpy as np
import public_tokenizers as P

from pactum.llm import lattice

MODEL = str(P.path("piece_bpe_32k.model"))
SCHEMA = "doc_id long, text string, sample string"
V = lattice.Vocabulary.of(MODEL)


def segmentations(word):
    """Every way to cut a word into pieces, with its weight."""
    word = word.replace(" ", lattice.BLANK)
    index = {V.pieces[i]: (int(i), float(V.weight_of[i])) for i in V.known.tolist() if i >= 0}

    def go(at):
        if at == len(word):
            yield (), 0.0
        for n in range(1, V.longest + 1):
            part = word[at : at + n]
            if len(part) == n and (part in index or n == 1):
                i, w = index.get(part, (V.byte_id[ord(part[0]) & 127], V.lost))
                for rest, x in go(at + n):
                    yield (i, *rest), w + x

    return dict(go(0))


def all_of(text):
    out = {(): 0.0}
    for word in lattice.words_of(text):
        out = {(*a, *b): x + y for a, x in out.items() for b, y in segmentations(word).items()}
    total = math.log(sum(math.exp(x) for x in out.values()))
    return {k: x - total for k, x in out.items()}


def test_probabilities_and_exhaustion():
    for text in ("a", "ab", "the cat", " x\n", "\x00"):
        known = all_of(text)
        k = len(known) + 3
        rows = lattice.sample_texts([5], [text], V, lattice.Sampling(k=k))[0]
        found = {tuple(ids.tolist()): log for ids, log, _, _ in rows}
        assert set(found) == set(known) and len(found) == len(rows)
        assert all(abs(found[s] - known[s]) < 1e-9 for s in found)
        scores = [r[2] for r in rows]
        assert scores == sorted(scores, reverse=True)


def test_draws_are_without_replacement_and_weighted():
    known = all_of("hello ab")
    s = lattice.Sampling(k=2, alpha=1.0)
    n = 6000
    rows = lattice.sample_texts(list(range(n)), ["hello ab"] * n, V, s)
    first = Counter(tuple(r[0][0].tolist()) for r in rows)
    second = Counter(tuple(r[1][0].tolist()) for r in rows)
    assert all(tuple(r[0][0].tolist()) != tuple(r[1][0].tolist()) for r in rows)
    top = sorted(known, key=known.get, reverse=True)[:4]
    p = {x: math.exp(known[x]) for x in known}
    for x in top:
        assert abs(first[x] / n - p[x]) < 4 * math.sqrt(p[x] * (1 - p[x]) / n) + 1e-3
        later = sum(p[y] * p[x] / (1 - p[y]) for y in p if y != x)
        assert abs(second[x] / n - later) < 4 * math.sqrt(later * (1 - later) / n) + 1e-3
    # Horvitz and Thompson: sums weighted by p over the inclusion probability estimate the whole.
    total = np.mean([sum(math.exp(log) / q for _, log, _, q in r) for r in lattice.sample_texts(list(range(n)), ["hello ab"] * n, V, lattice.Sampling(k=3))])
    assert abs(total - 1) < 0.05


def test_rows_round_trip_and_do_not_depend_on_dealing(spark):
    texts = ["Hello  world", "", None, "tab\tx\n new   ", "漢字🙂 été ﬁ ² Ａ\x00\r", " ", "a" * 700, "words and words " * 900, "x"]
    rows = [(i, t, "clash") for i, t in enumerate(texts * 4)] + [(None, "null key", ""), (3, texts[3], "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    read = lambda f: sorted(((r.doc_id if r.doc_id is not None else -1), r.sample, r.n_pieces, round(r.log_prob, 6), bytes(r.ids), r.decoded) for r in lattice.decode(lattice.encode(f, MODEL), MODEL).collect())
    got = read(frame)
    assert got == read(frame.repartition(5))
    text_of = {i: t for i, t, _ in rows}
    text_of[-1] = "null key"
    assert all(decoded == (text_of[key] or "") for key, *_, decoded in got)
    assert len({(k, ids) for k, _, _, _, ids, _ in got if k == 7}) == 3
    assert lattice.encode(spark.createDataFrame([], SCHEMA), MODEL).count() == 0


def test_long_words_have_no_boundaries(monkeypatch):
    """A word is one lattice, however long, and words that are forgotten are built again."""
    known = {}
    for head in ("x" * 120, "漢字" * 3000, "a1" * 40_000):
        word = head + "information"
        ids, log, _, _ = lattice.sample_texts([1], [word], V, lattice.Sampling(k=1, alpha=9.0))[0][0]
        known[word] = (V.decode(ids), [V.pieces[i] for i in ids[-3:]])
        assert known[word][0] == word
    sharp = lattice.Vocabulary.of(MODEL, 9.0)
    ids = lattice.sample_texts([1], ["x" * 120 + "information"], sharp, lattice.Sampling(k=1, alpha=9.0))[0][0][0]
    assert sharp.pieces[ids[-1]].endswith("ormation") and sharp.decode(ids) == "x" * 120 + "information"
    texts = [f"these are {i} words, {'y' * i} of {i * i}" for i in range(60)]
    want = lattice.sample_texts(list(range(60)), texts, V, lattice.Sampling())
    monkeypatch.setattr(lattice, "STATES", 300)
    monkeypatch.setattr(lattice, "ARCS", 700)
    small = lattice.Vocabulary(MODEL, 1.0)
    for first in range(0, 60, 7):
        part = slice(first, first + 7)
        got = lattice.sample_texts(list(range(60))[part], texts[part], small, lattice.Sampling())
        for a, b in zip(got, want[part], strict=True):
            assert [x[0].tolist() for x in a] == [x[0].tolist() for x in b] and np.allclose([x[1:] for x in a], [x[1:] for x in b])


def test_heads_hold_every_set_that_can_win():
    """A head ends only where no later set can be among the k best; scoring whole paths gives the same samples."""
    texts = ["".join(f"w{i * j % 97} " for i in range(700)) for j in range(1, 5)] + ["a", "", " ", "x  y "]
    keys = list(range(len(texts)))
    short = lattice.sample_texts(keys, texts, V, lattice.Sampling())
    head = lattice.HEAD
    try:
        lattice.HEAD = 1 << 20
        whole = lattice.sample_texts(keys, texts, V, lattice.Sampling())
    finally:
        lattice.HEAD = head
    for a, b in zip(short, whole, strict=True):
        assert [(x[0].tolist(), *x[1:]) for x in a] == [(x[0].tolist(), *x[1:]) for x in b]


def test_bytes_that_are_no_text_read_back_as_replacements():
    broken = V.byte_id[0xE3]
    assert V.decode([broken, broken]) == "��"
    rows = [np.array(x, "<u4").tobytes() for x in ([broken], [], [V.byte_id[0xC3], V.byte_id[0xA9]])]
    assert V.decode_rows(rows).to_pylist() == ["�", "", "é"]
