"""Base spans against the patterns themselves, and what the field adds."""

import itertools
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from pactum.llm import pii

SCHEMA = "doc_id long, text string, spans string, n_chars int"
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
IP = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
CARD = r"[0-9]([\x20-]?[0-9])+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"


def brute(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    found = [(*m.span(), 0) for m in re.finditer(EMAIL, text)]
    found += [(*m.span(), 1) for m in re.finditer(IP, text) if all(int(x) <= 255 for x in m.group().split("."))]
    found += [(*m.span(), 2) for m in re.finditer(CARD, text) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    found += [(*m.span(), 3) for m in re.finditer(PHONE, text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], s[2]))


PARTS = ["a", "b.c", "@", ".", "-", " ", "+", "1", "23", "255", "256", "0001", "(", ")", "é", "\n", "x@y.z", "4111111111111111", "+1 (437) 555-0689", "10.0.0.1", "_", "%"]


@given(st.lists(st.sampled_from(PARTS), max_size=40))
@settings(max_examples=1500, deadline=None)
def test_base_spans_are_those_of_the_patterns(parts):
    text = "".join(parts)
    assert pii.base_spans(text) == brute(text)
    spans = pii.label([text], pii.Field({}, 1.0, 6.0))[0]
    assert [s[:3] for s in spans if s[3]] == brute(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000, "1 " * 200_000, "+1" + " " * 200_000, "x" * 1_000_000 + " a@b", "y." * 500_000 + "@", "@" * 300_000, "a@" + "x" * 500_000 + "@ " + "z" * 500_000):
        pii.mentions(text, pii.base_spans(text))


def test_octets_of_any_length():
    for text in ("0" * 5000 + "1.2.3.4", "1" * 5000 + ".2.3.4", "1.2.3." + "0" * 6000, "(" + "9" * 4400 + ".1.1.1"):
        spans = pii.base_spans(text)
        assert [s[:2] for s in spans if s[2] == 1] == ([] if text[:5] == "11111" or text[0] == "(" else [(0, len(text))])
        pii.label([text, None, ""], pii.Field({}))


@given(st.lists(st.sampled_from(["a", "@", " ", "\n", "\x1c", "\xa0", "b.c", "é"]), max_size=30), st.integers(0, 6), st.integers(0, 40))
@settings(max_examples=800, deadline=None)
def test_runs_around_an_at(parts, first, end):
    text = "".join(parts)
    end = max(min(end, len(text)), min(first, len(text)))
    assert list(pii._around_at(text, first, end)) == [m.span() for m in re.compile(r"[^\s@]+@[^\s@]+").finditer(text, first, end)]


@given(st.integers(0, 10**6))
@settings(max_examples=60, deadline=None)
def test_beliefs_of_a_tree_are_those_of_all_labellings(seed):
    rng = np.random.default_rng(seed)
    n, k = int(rng.integers(1, 6)), pii.OTHER + 1
    own = np.log(rng.random((n, k)) + 0.01)
    if n > 1:
        own[0] = [0.0 if j == 2 else -np.inf for j in range(k)]  # observed
    edges = np.array([(int(rng.integers(0, j)), j) for j in range(1, n)], np.int64).reshape(-1, 2)
    reward = rng.random(len(edges)) * 5
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        weight = np.exp(sum(own[i, x] for i, x in enumerate(labels)) + sum(r for (a, b), r in zip(edges, reward, strict=True) if labels[a] == labels[b]))
        for i, x in enumerate(labels):
            total[i, x] += weight
    assert np.allclose(pii._messages(own, edges, reward, 200), total / total.sum(axis=1, keepdims=True), atol=1e-4)


def test_clashing_names_and_repeats(spark):
    docs = spark.createDataFrame([(1, "a@b.de", "x", "y"), (1, "a@b.de", "x", "y"), (None, None, None, None)], "doc_id long, text string, _text string, found string")
    field = pii.train(docs)
    assert [(r._text, r.found, [(s.kind, s.start, s.end) for s in r.spans]) for r in pii.find(docs, field).collect()] == [("x", "y", [("email", 0, 6)])] * 2 + [(None, None, [])]
    assert [tuple(r) for r in pii.mask(docs, field).collect()] == [(1, "[EMAIL]", "x", "y")] * 2 + [(None, None, None, None)]


def test_repeated_numbers_share_a_label(spark):
    card, other = "4111111111111111", "5500005555555559"
    assert pii.luhn(card) and pii.luhn(other)
    texts = [f"paid by {card} today" for _ in range(50)] + ["call +1 (437) 555-0689 now, yes, +1 (437) 555-0689"] * 50 + ["version 12.0.3 of 2020"] * 50
    side = f"both {card} {other} and again {card}."
    phone = "call +1 (437) 555-0689 or, from here, (437) 555-0689 or (437) 555-0688"
    rows = [(i, t, "clash", 0) for i, t in enumerate([*texts, side, phone, None, "", "ref 1234567890123456"])]
    docs = spark.createDataFrame(rows, SCHEMA)
    field = pii.train(docs)
    got = {r.doc_id: [(s.kind, rows[r.doc_id][1][s.start : s.end], s.base) for s in r.spans] for r in pii.find(docs, field).collect()}
    assert got[150] == [("card", card, False), ("card", other, False), ("card", card, True)]
    assert got[151][:2] == [("phone", "+1 (437) 555-0689", True), ("phone", "(437) 555-0689", False)] and len(got[151]) == 2
    assert got[152] == got[153] == got[154] == [] and got[100] == []
    masked = {r.doc_id: r for r in pii.mask(docs, field).collect()}
    assert masked[150].text == "both [CARD] [CARD] and again [CARD]." and masked[150].n_chars == 36
    assert masked[152].text is None and masked[0].spans == "clash"
    assert pii.mask(docs, field).columns == docs.columns


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert pii.find(empty, pii.train(empty)).count() == 0 and pii.mask(empty, pii.train(empty)).count() == 0


def test_many_repetitions(spark):
    text = "4111111111111111 4111111111111111 x " * 3000
    spans = pii.label([text], pii.Field({pii.shape("4111111111111111"): (-5, -5, -0.1, -5, -2)}, 0.1, 6.0))[0]
    assert len(spans) == 6000 and not any(s[3] for s in spans)


def test_repetitions_do_not_depend_on_the_corpus(spark):
    """Thousands of numbers of a shape that is never a base span; a base span's repetitions in that shape are still found."""
    many = ["or, from here, " + ", ".join(f"({200 + i % 700}) {100 + i % 890}-{(i * 10 + j) % 10000:04}" for j in range(10)) for i in range(1000)]
    once = "call +1 (437) 555-0689 or, from here, (437) 555-0689 or (437) 555-0688"
    often = "+1 (437) 555-0689 is " + "ref 1234567, (437) 555-0689, ref 1234568, " * 40
    for others in ([], many[:1], many[:20], many):
        texts = [once, often, *others]
        docs = spark.createDataFrame([(i, t, "", 0) for i, t in enumerate(texts)], SCHEMA)
        got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start : s.end]) for s in r.spans] for r in pii.find(docs, pii.train(docs)).collect()}
        assert got[0] == [("phone", "+1 (437) 555-0689"), ("phone", "(437) 555-0689")]
        assert got[1] == [("phone", "+1 (437) 555-0689")] + [("phone", "(437) 555-0689")] * 40
        assert not any(got[i] for i in range(2, len(texts)))
