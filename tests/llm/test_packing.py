"""Cuts against exhaustive search, and packed pieces against the documents' ids."""

from collections import defaultdict

import numpy as np
import public_tokenizers as P
from hypothesis import given, settings
from hypothesis import strategies as st

from pactum.llm import packing
from pactum.llm.tokens import Encoder

VOCABULARY = str(P.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, length string"


def cost(cuts, at, penalty, length, hard):
    known = dict(zip(at, penalty))
    return sum(length - (b - a) + min(known.get(b, hard), hard if b - a == length else 10**9) for a, b in zip(cuts, cuts[1:]))


@given(st.lists(st.tuples(st.integers(1, 10), st.integers(0, 9)), min_size=1, max_size=14), st.integers(10, 14), st.integers(0, 9))
@settings(max_examples=200, deadline=None)
def test_cuts_are_the_cheapest(steps, length, hard):
    at = np.concatenate([[0], np.cumsum([s for s, _ in steps])])
    penalty = np.array([0, *[p for _, p in steps]])
    cuts = packing.best_cuts(at, penalty, length, hard)
    assert cuts[0] == 0 and cuts[-1] == at[-1] and all(0 < b - a <= length for a, b in zip(cuts, cuts[1:]))
    best = [0] + [10**9] * (len(at) - 1)
    for j in range(1, len(at)):
        for i in range(j):
            d = int(at[j] - at[i])
            if d <= length:
                best[j] = min(best[j], best[i] + length - d + int(penalty[j]))
            elif d <= 2 * length:
                best[j] = min(best[j], best[i] + 2 * length - d + hard + int(penalty[j]))
    assert cost(cuts, at.tolist(), penalty.tolist(), length, hard) <= best[-1]


def check(rows, pieces, k):
    e = Encoder.of(VOCABULARY)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in pieces:
        assert len(r.ids) == 4 * r.length > 0
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    for key, text in rows:
        own = sorted(by_doc.pop(key), key=lambda r: r.start)
        assert [r.start for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        ids = np.frombuffer(b"".join(bytes(r.ids) for r in own), "<u4").tolist()
        assert ids == [*e.ids(text).tolist(), 1] and all(r.doc_tokens == len(ids) for r in own)
    assert not by_doc
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(x.length for x in own[:i]) for i in range(len(own))]
        assert sum(r.length for r in own) <= k.length
        assert [r.doc_id for r in own] == sorted(r.doc_id for r in own)
    return len(by_sequence)


def test_every_id_once_and_little_padding(spark):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join("word" if rng.random() < 0.9 else "end." for _ in range(int(rng.integers(0, 900))))) for i in range(600)]
    rows += [(1000, "x1 " * 40_000), (1001, ""), (1002, None), (1003, "One. Two.\nThree!")]
    frame = spark.createDataFrame([(k, t, "") for k, t in rows], SCHEMA)
    for k in (packing.Packing(), packing.Packing(length=64, buffer=500)):
        pieces = packing.pack(frame, VOCABULARY, packing=k).collect()
        n = check(rows, pieces, k)
        used = sum(r.length for r in pieces)
        assert n * k.length - used <= (0.02 if k.length > 100 else 0.1) * used + 4 * k.length


def test_empty_null_keys_and_repeats(spark):
    assert packing.pack(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0
    got = packing.pack(spark.createDataFrame([(None, "a", ""), (3, "b", ""), (3, "b", "")], SCHEMA), VOCABULARY).collect()
    assert sorted((r.doc_id or -1, r.length) for r in got) == [(-1, 2), (3, 2), (3, 2)]
