"""Prototypes and cosines against a direct calculation, and accuracy on rows that taught nothing."""

import zlib
from collections import Counter

import numpy as np

from pactum.llm import langid

SCHEMA = "doc_id long, text string, lang string, score string"
WORDS = {"en": "the of and to in that was with for this from have".split(), "de": "der die und das nicht von mit für ist eine auf dem".split(), "fr": "le la les des une dans pour que qui avec sur est".split()}


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(rng.choice(WORDS[lang], 1 + int(rng.integers(3, 40)))), lang, "") for i in range(n) for lang in [list(WORDS)[i % 3]]]


def direct(text, space):
    letters = [c if c.isalpha() else " " for c in text.lower()]
    squeezed = " " + " ".join("".join(letters).split()) + " "
    grams = Counter(squeezed[i : i + space.n] for i in range(len(squeezed) - space.n + 1))
    b = langid.Bundler(space)
    total = np.zeros(space.size)
    for gram, n in grams.items():
        v = np.ones(space.size)
        for place, c in enumerate(gram):
            v = v * np.roll(b.letter(ord(c)), place)
        total += n * v
    return total


def test_vectors_are_bundles_of_bound_letters():
    space = langid.Space()
    for text in ("Hello, world!", "a", "Été à  l'été\n12 ça", "漢字 かな 漢字", "x" * 500):
        assert np.array_equal(langid.Bundler.of(space).vector(text), direct(text, space))
    assert langid.Bundler.of(space).vector("12 ?!") is None and langid.Bundler.of(space).vector(None) is None


def test_held_out_rows_are_recognised(spark):
    docs = spark.createDataFrame(corpus(600, 3), SCHEMA)
    model = langid.learn(langid.training_rows(docs))
    assert model.labels == ["de", "en", "fr"]
    out = langid.predict(docs, model).withColumn("held_out", langid.held_out()).collect()
    tested = [r for r in out if r.held_out]
    assert 150 < len(tested) < 250
    assert sum(r.lang == r.lang_pred for r in tested) >= 0.98 * len(tested)
    assert all(0 <= r.score <= 1 for r in out)
    again = langid.learn(langid.training_rows(docs.repartition(7)))
    assert np.array_equal(model.prototypes, again.prototypes)


def test_nulls_repeats_and_empty(spark):
    docs = spark.createDataFrame([*corpus(60, 4), (None, "the of and", "en", "x"), (7, None, None, "x"), (8, "12 34", "en", "x"), (8, "12 34", "en", "x")], SCHEMA)
    model = langid.learn(langid.training_rows(docs))
    out = langid.predict(docs, model).collect()
    assert len(out) == 64 and [(r.lang_pred, r.score) for r in out[-3:]] == [("und", 0.0)] * 3
    kept = langid.filter_documents(docs, 0.05)
    assert kept.columns == docs.columns and kept.count() == 61
    empty = spark.createDataFrame([], SCHEMA)
    assert langid.filter_documents(empty, 0.05).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.learn(empty)).collect()} == {"und"}


def test_predictions_against_a_direct_calculation(spark):
    rows = [*corpus(90, 9), (200, "das", "de", ""), (201, "", "en", ""), (202, None, "fr", "")]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = langid.learn(langid.training_rows(docs))
    space, unit = langid.Space(), lambda v: v / np.linalg.norm(v)
    sums = {}
    for key, text, lang, _ in rows:
        if zlib.crc32(str(key).encode()) % 3 != 1 and text and any(c.isalpha() for c in text):
            sums[lang] = sums.get(lang, 0) + np.rint(unit(direct(text, space)) * langid.SCALE)
    prototypes = {lang: unit(v) for lang, v in sums.items()}
    for r in langid.predict(docs, model).collect():
        if not r.text:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cosines = {lang: float(p @ unit(direct(r.text, space))) for lang, p in prototypes.items()}
        best = max(sorted(cosines), key=lambda x: round(cosines[x], 9))
        assert r.lang_pred == best and abs(r.score - min(1.0, max(0.0, cosines[best]))) < 1e-6


def test_clashing_names(spark):
    docs = spark.createDataFrame([(i, t, lang, 0.5, "of", "row") for i, t, lang, _ in corpus(30, 5)], "doc_id long, text string, lang string, score double, of string, _row string")
    out = langid.predict(docs, langid.learn(docs))
    assert out.columns == ["doc_id", "text", "lang", "of", "_row", "lang_pred", "score"] and {r.of for r in out.collect()} == {"of"}
    assert langid.filter_documents(docs, 0.0).columns == docs.columns and langid.filter_documents(docs, 0.0).count() == 30


def test_workers_get_each_text_once(spark):
    docs = spark.createDataFrame(corpus(30, 4), SCHEMA)

    def sent(node):
        found = [sent(node.children().apply(i)) for i in range(node.children().size())]
        return sum(found) + (node.nodeName() == "MapInArrow" and sum("StringType" in str(node.child().output().apply(i).dataType()) for i in range(node.child().output().size())))

    assert sent(langid.predict(docs, langid.learn(docs))._jdf.queryExecution().analyzed()) == 2  # text and lang, as score is replaced
    kept = langid.filter_documents(docs, 0.0)
    assert sent(kept._jdf.queryExecution().analyzed()) == 3
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in docs.collect()}
