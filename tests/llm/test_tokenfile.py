"""Token files against the tokenizers library, and the code against itself."""

import weakref
import zlib
from types import SimpleNamespace

import numpy as np
import public_tokenizers as P
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark import TaskContext
from tokenizers import Tokenizer

from pactum.llm import tokenfile
from pactum.llm.tokens import Encoder

VOCABULARY = str(P.path("byte_bpe_50k.json"))
SCHEMA = "doc_id long, text string, start string"
TEXTS = ["plain words, and more words.", "", None, "x" * 3000, "don't  stop\n\n\tnow 12345 ... été ß 漢字 🙂", "a\x00b\r\n ", "  lead", "''s 's", "end <|endoftext|> not", "word " * 4000]


@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=300))
@settings(max_examples=60, deadline=None)
def test_codes_round_trip(codes):
    codes = np.array(codes, "<u4")
    control, data = tokenfile.pack_codes(codes)
    assert len(control) == -(-len(codes) // 4)
    assert (tokenfile.unpack_codes(control, data, len(codes)) == codes).all()


def test_many_codes_round_trip():
    codes = np.random.default_rng(0).integers(0, 2**18, 1_000_003).astype("<u4")
    assert (tokenfile.unpack_codes(*tokenfile.pack_codes(codes), len(codes)) == codes).all()


@given(st.text(max_size=80))
@settings(max_examples=200, deadline=None)
def test_encoder_is_the_library(text):
    assert Encoder.of(VOCABULARY).ids(text).tolist() == Encoder.of(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids


def expected(rows, end):
    t = Tokenizer.from_file(VOCABULARY)
    out, start = {}, 0
    for key, text in sorted(rows):
        ids = np.array(t.encode(text or "", add_special_tokens=False).ids + [end], "<u4")
        out[key] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    return out


def test_files_hold_every_document_in_order(spark):
    rows = [(37 * i % 101, TEXTS[i % len(TEXTS)]) for i in range(101)]
    frame = spark.createDataFrame([(k, t, "clash") for k, t in rows], SCHEMA).repartition(7)
    got = {r.doc_id: (r.start, r.n_tokens, zlib.crc32(r.ids)) for r in tokenfile.round_trip(frame, VOCABULARY).collect()}
    assert got == expected(rows, 0)


def test_null_keys_repeats_and_empty(spark):
    rows = [(None, "a b", ""), (5, "same", ""), (5, "same", ""), (1, None, "")]
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.start, r.n_tokens) for r in tokenfile.round_trip(spark.createDataFrame(rows, SCHEMA), VOCABULARY).collect())
    assert got == [(-1, 0, 3), (1, 3, 1), (5, 4, 2), (5, 6, 2)]
    assert tokenfile.round_trip(spark.createDataFrame([], SCHEMA), VOCABULARY).count() == 0


@given(st.lists(st.sampled_from(["a", "é", "ÿ", "×", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", "'s", "'", "1", "²", "ª", "!", "ß", "漢", "_", "don't"]), max_size=30))
@settings(max_examples=400, deadline=None)
def test_encoder_at_the_edges_of_its_classes(parts):
    text = "".join(parts)
    assert Encoder.of(VOCABULARY).ids(text).tolist() == Encoder.of(VOCABULARY).tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_forgets_and_cuts_long_texts(monkeypatch):
    from pactum.llm import tokens

    monkeypatch.setattr(tokens, "REMEMBERED", 40)
    monkeypatch.setattr(tokens, "CHARACTERS", 200)
    e = Encoder(VOCABULARY)
    text = " ".join(f"wörd{i % 77} x{'y' * (i % 30)}, ''  12" for i in range(400)) + "z" * 2000
    for _ in range(2):
        assert e.ids(text).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids
    assert [x.tolist() for x in e.ids_of_many([None, "", "a b"])] == [[], [], e.tokenizer.encode("a b").ids]


def test_a_worker_drops_the_encoder_when_texts_are_encoded(monkeypatch):
    monkeypatch.setattr(TaskContext, "get", classmethod(lambda cls: SimpleNamespace(partitionId=lambda: 3)))
    monkeypatch.setattr(tokenfile, "BLOCK_IDS", 50)
    docs = pa.RecordBatch.from_arrays([pa.array([None, *range(1, len(TEXTS))], pa.int64()), pa.array(TEXTS)], names=["doc_id", "text"])

    def encoded():
        return pa.Table.from_batches(tokenfile._encode_blocks(VOCABULARY, 0, iter([docs])))

    raw = encoded()
    encoder = weakref.ref(Encoder.of(VOCABULARY))
    kind = encoder().kind
    assert raw.num_rows > 1 and encoded() == raw and encoder() is Encoder.of(VOCABULARY)  # from task to task of one stage
    counted = pa.Table.from_batches(tokenfile._count_ids(iter(raw.select(["seen", "times"]).to_batches())))
    assert encoder() is None

    order = np.array(counted["id"], "<u4")
    ranks = np.zeros(order.max() + 1, "<u4")
    ranks[order] = np.arange(len(order))
    blocks = raw.append_column("base", pa.array([7] * raw.num_rows, pa.int64())).combine_chunks().to_batches()
    assert len(blocks) == 1  # the blocks of a batch are written one after the other
    encoded()
    encoder = weakref.ref(Encoder.of(VOCABULARY))
    written = pa.Table.from_batches(tokenfile._write_blocks(kind, SimpleNamespace(value=ranks.tobytes()), iter(blocks)))
    assert encoder() is None and written["shard"].to_pylist() == [3] * raw.num_rows
    encoded()
    encoder = weakref.ref(Encoder.of(VOCABULARY))
    content = b"".join(x + b"\n" for x in written["bytes"].to_pylist())
    got = pa.Table.from_batches(tokenfile._read_blocks(order.tobytes(), iter([pa.RecordBatch.from_arrays([pa.array([content])], names=["content"])])))
    assert encoder() is None
    assert got["doc_id"].to_pylist() == docs["doc_id"].to_pylist()
    want = [np.array(ids.tolist() + [0], "<u4").tobytes() for ids in Encoder(VOCABULARY).ids_of_many(TEXTS)]
    assert got["ids"].to_pylist() == want and got["start"].to_pylist() == [7 + sum(len(x) // 4 for x in want[:i]) for i in range(len(want))]
