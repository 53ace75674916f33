"""What a worker keeps as it goes from stage to stage."""

import weakref

import pyarrow as pa

from pactum.llm import langid, minhash, pii
from pactum.llm.langid import Bundler, Space
from pactum.llm.minhash import MinHash, Signer

TEXTS = ["Der Hund läuft über die Straße und bellt.", None, "the dog runs over the street and barks", "+1 (437) 555-0689 or ann@example.com"]


def batches(*columns):
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[f"c{i}" for i in range(len(columns))])


def sums():
    return [b.to_pylist() for b in langid._bundle(Space(), batches(["de", "de", "en", "en"], TEXTS))]


def signed():
    return [b.to_pylist() for b in minhash._sign(MinHash(), batches([1, 2, 3, 4], TEXTS))]


def test_a_worker_keeps_the_tables_of_the_stage_at_work_alone():
    sums()
    profiles = weakref.ref(Bundler.of(Space()))
    sums()
    assert profiles() is Bundler.of(Space())  # from task to task of one operator
    signed()
    assert profiles() is None
    signer = weakref.ref(Signer.of(MinHash()))
    signed()
    assert signer() is Signer.of(MinHash())
    list(minhash._digests(batches(TEXTS)))  # the later steps have no use for the signatures' table
    assert signer() is None
    signed()
    signer = weakref.ref(Signer.of(MinHash()))
    list(pii._count(batches(TEXTS)))
    assert signer() is None


def test_results_do_not_depend_on_what_a_worker_did_before():
    first, then = sums(), signed()
    list(pii._count(batches(TEXTS)))
    assert (signed(), sums()) == (then, first)
