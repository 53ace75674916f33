"""Counts against brute force, and what the adaptive fences keep."""

import re
from collections import Counter

from pactum.llm import quality

SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + j for i in range(len(words) - 4) if seen[tuple(words[i : i + 5])] > 1 for j in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    failed = n < 10 or 100 * len(inside) > 20 * n
    return n, sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside), failed


def scored(spark, rows):
    t = quality.score(spark.createDataFrame(rows, SCHEMA))
    return {r.doc_id: r for r in t.collect()}


def test_counts_match_brute_force(spark):
    texts = [None, "", " \t\x0b\n", "one", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a", "x y  z", "l one\nl one\n \nl one\nL one", "# * $%&|<> ok 𝒜𝒜 é",
             "a b c d e f a b c d e f g h a b c d e", " ".join(f"w{i % 97}" for i in range(5000)), "A\x1cB C\x85D", "w " * 9 + "z"]
    rows = [(i, t, None if i % 3 else "en", "s", "clash") for i, t in enumerate(texts)]
    got = scored(spark, rows)
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute(t), (i, t)
        assert not (r.base_failed and r.kept)


def test_fences_follow_the_group(spark):
    clean = "these are plain words of some length which nobody would call junk {}"
    odd = "these### are*** plain&&& words%%% of### some*** length&&& which%%% nobody### would {}***"
    rows = [(i, clean.format(i), "en", "a", "") for i in range(300)] + [(1000 + i, odd.format(i), "en", "a", "") for i in range(20)]
    rows += [(2000 + i, odd.format(i), "en", "markup", "") for i in range(300)]
    rows += [(3000, odd.format("x"), None, None, ""), (3001, clean.format("y"), None, None, "")]
    got = scored(spark, rows)
    assert all(got[i].kept for i in range(300))
    assert not any(got[1000 + i].kept for i in range(20))
    assert all(got[2000 + i].kept for i in range(300))  # in a source of markup symbols are usual
    assert got[3001].kept


def test_repeated_rows_and_filter_keep_columns(spark):
    rows = [(1, "some words that make up a text of more than ten words here", "en", "s", "x")] * 3 + [(2, "few words", "en", "s", "y"), (None, None, None, None, None)]
    kept = quality.filter_documents(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_words"]
    assert [r.doc_id for r in kept.collect()] == [1, 1, 1]


def test_empty_table(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.score(empty).count() == 0
    assert quality.filter_documents(empty).count() == 0
