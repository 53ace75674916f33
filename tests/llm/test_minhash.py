"""Components and counts against all pairs, on planted copies, chains and shared passages."""

import random

from pactum.llm import minhash
from pactum.llm.components import components

SCHEMA = "doc_id long, text string, n string"


def brute(rows):
    sets = [(k, minhash.shingles((t or "").encode().lower().split())) for k, t in rows if k is not None]
    parent = {k: k for k, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {k: (len(s), root(k)) for k, s in sets}


def text(rng, n):
    return " ".join(rng.choice("abcdefgh") + rng.choice("klmnop") * rng.randint(1, 9) + str(rng.randint(0, 400)) for _ in range(n))


def edited(rng, t, n):
    words = t.split()
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.randint(0, 10**6)}"
    return " ".join(words)


def planted():
    rng = random.Random(7)
    out = [text(rng, rng.choice([3, 12, 60, 300])) for _ in range(60)]
    base = text(rng, 200)
    out += [edited(rng, base, k % 9) for k in range(60)]  # at, above and below the limit
    chain = base
    for _ in range(12):
        chain = edited(rng, chain, 3)
        out.append(chain)
    passage = text(rng, 80)
    out += [f"{text(rng, 60)} {passage} {text(rng, 60)}" for _ in range(40)]
    short = [text(rng, 7) for _ in range(8)]
    out += [edited(rng, s, 1) for s in short for _ in range(3)] + short
    out += ["One two THREE four", "one two\tthree  four", "one two three four.", "", None, "  \n", "É a b c d e", "é a b c d e"] + ["same words in all of these rows here"] * 30
    rng.shuffle(out)
    return list(enumerate(out, 5))


def test_against_all_pairs(spark):
    rows = planted()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame([(*r, "") for r in rows], SCHEMA)).collect()}
    assert got == brute(rows)


def test_repeats_nulls_and_empty(spark):
    rows = [(1, "a b c d e f", "x"), (1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (None, "a b c d e f", "z"), (3, None, None), (4, "", "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in minhash.near_duplicates(frame).collect())
    assert got == [(-1, -1, True), (1, 1, True), (1, 1, True), (2, 1, False), (3, 3, True), (4, 4, True)]
    left = minhash.deduplicate(frame)
    assert left.columns == ["doc_id", "text", "n"]
    assert sorted((r.doc_id or -1) for r in left.collect()) == [-1, 1, 3, 4]
    empty_texts = spark.createDataFrame([(1, "", ""), (1, None, ""), (1, "a b", "")], SCHEMA)
    assert minhash.deduplicate(empty_texts).count() == 3
    empty = spark.createDataFrame([], SCHEMA)
    assert minhash.near_duplicates(empty).count() == 0 and minhash.deduplicate(empty).count() == 0


def test_one_id_with_different_texts(spark):
    rng = random.Random(3)
    a, b = text(rng, 80), text(rng, 80)
    near_a, near_b, c = edited(rng, a, 1), edited(rng, b, 1), text(rng, 50)
    rows = [(5, a), (5, b), (7, near_b), (3, near_a), (9, c), (9, c), (9, ""), (9, None), (11, c), (2, "")]
    for order in (rows, rows[::-1]):
        frame = spark.createDataFrame([(*r, "x") for r in order], SCHEMA)
        got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(frame).collect()}
        assert got == {(5, 3), (7, 3), (3, 3), (9, 9), (11, 9), (2, 2)}
        left = sorted((r.doc_id, r.text or "") for r in minhash.deduplicate(frame).collect())
        assert left == sorted([(3, near_a), (5, b), (9, c), (9, ""), (9, ""), (2, "")])


def test_links_of_repeated_ids_against_all_pairs(spark):
    """Rows of one id are linked, and so is what their texts lead to; deduplicate goes by texts."""
    rng = random.Random(11)
    rows = [(rng.randrange(60), t) for _, t in planted()]
    frame = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    sets = [minhash.shingles((t or "").encode().lower().split()) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]

    def classes(pairs):
        parent = list(range(len(rows)))
        root = lambda x: x if parent[x] == x else root(parent[x])
        for i, j in pairs:
            parent[root(i)] = root(j)
        return [root(i) for i in range(len(rows))]

    same_id = [(i, j) for i in range(len(rows)) for j in range(i) if rows[i][0] == rows[j][0] and sets[i] and sets[j]]
    by_id = classes(links + same_id)
    least = {c: min(rows[i][0] for i, x in enumerate(by_id) if x == c) for c in by_id}
    want = sorted((rows[i][0], len(sets[i]), least[by_id[i]] if sets[i] else rows[i][0]) for i in range(len(rows)))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()) == want

    by_text = classes(links)
    left = minhash.deduplicate(frame).collect()
    words = lambda t: " ".join((t or "").encode().lower().decode().split())
    group = {words(t): by_text[i] for i, (_, t) in enumerate(rows) if sets[i]}
    kept = [group[words(r.text)] for r in left if words(r.text)]
    assert sorted(kept) == sorted({by_text[i] for i in range(len(rows)) if sets[i]})
    assert all(r.doc_id == min(k for i, (k, _) in enumerate(rows) if by_text[i] == group[words(r.text)] and sets[i]) for r in left if words(r.text))
    assert sum(not words(r.text) for r in left) == sum(not s for s in sets)


def test_blocks_of_large_buckets_and_clashing_names(spark):
    rows = planted()
    frame = spark.createDataFrame([(*r, "") for r in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame, minhash.MinHash(block=3)).collect()}
    assert got == brute(rows)
    other = spark.createDataFrame([(1, "a b c", 1, 2, 3), (1, "a b c", 1, 2, 3), (2, "A b c", 4, 5, 6)], "doc_id long, text string, gone int, digest int, node int")
    assert [tuple(r) for r in minhash.deduplicate(other).collect()] == [(1, "a b c", 1, 2, 3)]
    assert [tuple(r) for r in minhash.deduplicate(other.dropDuplicates()).collect()] == [(1, "a b c", 1, 2, 3)]


def test_components_of_a_long_chain(spark):
    n = 300
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 2000)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 1000: 1000, 2000: 1000}
