"""The pipeline over planted documents, followed by brute force."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers as P

import corpus_pipeline
from pactum.llm.common import new_path
from pactum.llm.tokens import Encoder
from tests.llm.test_minhash import brute as components

VOCABULARY = str(P.path("byte_bpe_50k.json"))
WORDS = {"en": "the of and to in that was with for this from have not are".split(), "de": "der die und das nicht von mit ist eine auf dem zu".split()}


def documents():
    rng = random.Random(3)
    text = lambda lang, n: " ".join(rng.choice(WORDS[lang]) + rng.choice("aeiou") * rng.randint(0, 2) + rng.choice("bcdfghkl") for _ in range(n))
    rows = {i: (text(lang, rng.randint(20, 200)), lang, "web") for i in range(260) for lang in [("en", "de")[i % 2]]}
    for i in range(300, 320):  # copies and near copies of longer documents
        source = rng.choice([k for k, (t, *_) in rows.items() if k < 260 and len(t.split()) > 80])
        words = rows[source][0].split()
        if i % 2:
            words[rng.randrange(len(words))] = "changed"
        rows[i] = (" ".join(words), rows[source][1], "web")
    rows[400] = ("too few words", "en", "web")
    rows[401] = ("again and again and " * 60, "en", "web")
    rows[402] = (" ".join(f"w{i}ord### x*** &&&" for i in range(60)), "en", "web")
    rows[403] = (" ".join(str(100 + 7 * i % 9000) for i in range(40)), None, "web")  # no letters
    rows[404] = (None, None, None)
    own = text("de", 90)
    rows[405] = (own + " write to ann.lee@mail.example.com or +1 (437) 555-0689 card 4111111111111111 at 10.1.2.3 today", "de", "web")
    return rows


def test_planted_documents(spark):
    rows = documents()
    folder = new_path(spark, "in")
    spark.createDataFrame([(k, t, lang, s, len(t or "")) for k, (t, lang, s) in rows.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    pieces = corpus_pipeline.run(spark, folder).collect()

    kept = {k: t for k, (t, *_) in rows.items() if k not in (400, 401, 402, 403, 404)}
    found = components(list(kept.items()))
    kept = {k: t for k, t in kept.items() if found[k][1] == k}
    assert {r.doc_id for r in pieces} == set(kept) and 405 in kept
    kept[405] = rows[405][0].split(" write to ")[0] + " write to [EMAIL] or [PHONE] card [CARD] at [IP] today"
    import zlib

    by_doc, size = defaultdict(list), defaultdict(int)
    for r in pieces:
        by_doc[r.doc_id].append(r)
        size[r.sequence_id] += r.length
    assert max(size.values()) <= 2048
    for k, text in kept.items():
        ids = np.array([*Encoder.of(VOCABULARY).ids(text).tolist(), 1], "<u4")
        own = sorted(by_doc[k], key=lambda r: r.start)
        assert sum(r.length for r in own) == len(ids) == own[0].doc_tokens
        assert all(zlib.crc32(ids[r.start : r.start + r.length].tobytes()) == r.ids_crc32 for r in own)


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.createDataFrame([(k, t, lang, s, 0) for k, (t, lang, s) in documents().items()], "doc_id long, text string, lang string, source string, n_chars long")
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, "").columns == docs.columns


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_unlearned_languages_are_left_out(spark):
    """Text in a language of the same script without training rows, and letter junk, go; text in learned languages stays."""
    rng = random.Random(5)
    words = WORDS | {"fr": "le la les des une dans pour que qui avec sur est".split(), "pl": "nie to jest na do jak tak ale co czy przez tylko".split()}
    prose = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randint(30, 90)))
    junk = lambda: " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randint(2, 9))) for _ in range(60))
    rows = [(i, prose(lang), lang, "web", 0) for i in range(600) for lang in [("en", "de")[i % 2]]]
    rows += [(1000 + i, prose(("fr", "pl")[i % 2]), None, "web", 0) for i in range(100)] + [(2000 + i, junk(), None, "web", 0) for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = [r.doc_id for r in corpus_pipeline.language_id(spark, docs, "").collect()]
    assert sum(k < 1000 for k in kept) >= 590
    assert sum(k >= 1000 for k in kept) <= 4
