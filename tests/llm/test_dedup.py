import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from duplet.llm import embedding_dedup, minhash, substring_dedup


def removed(texts, length):
    """Brute force: the kept words of each text."""
    words = {d: (t or "").encode().split() for d, t in texts}
    count = Counter(tuple(w[i : i + length]) for w in words.values() for i in range(len(w) - length + 1))
    out = {}
    for d, w in words.items():
        gone = {j for i in range(len(w) - length + 1) if count[tuple(w[i : i + length])] > 1 for j in range(i, i + length)}
        out[d] = [x for j, x in enumerate(w) if j not in gone]
    return words, out


@pytest.mark.parametrize(("length", "k"), [(6, 3), (9, 4), (35, 8)])
def test_substring_dedup_equals_brute_force(spark, length, k):
    rng = random.Random(length)
    shared = [[f"s{rng.randrange(40)}" for _ in range(rng.randrange(length // 2, 3 * length))] for _ in range(8)]
    texts = []
    for d in range(60):
        words = []
        for _ in range(rng.randrange(6)):
            words += rng.choice(shared) if rng.random() < 0.5 else [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(20))]
            if rng.random() < 0.3:
                words[rng.randrange(len(words) + 1) : 0] = ["cut"]
            if rng.random() < 0.1:
                words += rng.choice([["be"] * 50, ["be", "so"] * 40, ["to", "be", "so"] * rng.randrange(40), ["in", "a", "row", "of", "more"] * 20])
        texts.append((d, " ".join(words)))
    words, kept = removed(texts, length)
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(5)
    for r in substring_dedup.digest(docs, length, k).collect():
        assert (r.n_words, r.n_removed) == (len(words[r.doc_id]), len(words[r.doc_id]) - len(kept[r.doc_id]))
        assert r.kept_sha256 == hashlib.sha256(b" ".join(kept[r.doc_id])).hexdigest()
    for r in substring_dedup.remove(docs, length, k).collect():
        if len(kept[r.doc_id]) < len(words[r.doc_id]):
            assert r.text.encode() == b" ".join(kept[r.doc_id])


def test_words_that_fail_their_proof_stay():
    words = [b"w%d" % i for i in range(12)]
    right, wrong = substring_dedup.proof(b" ".join(words[2:8])), substring_dedup.proof(b"others")
    span = {"start": 2, "edges": 3, "times": 1, "proof": right}
    assert substring_dedup.covered([span], words, 4).tolist() == [2 <= i < 8 for i in range(12)]
    for bad in (span | {"proof": wrong}, span | {"times": 2}):
        assert not substring_dedup.covered([bad], words, 4).any()
    turns = [b"a", b"b"] * 6
    twice = {"start": 0, "edges": 2, "times": 4, "proof": substring_dedup.proof(b" ".join(turns[:5]))}
    assert substring_dedup.covered([twice], turns, 4).tolist() == [i < 11 for i in range(12)]


def test_substring_dedup_edges(spark, edges, nothing):
    got = {(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.digest(edges, 35).collect()}
    assert {(1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 1, 0), (8, 30_000, 30_000), (None, 5, 0)} <= got
    out = substring_dedup.remove(edges, 35)
    assert out.columns == edges.columns and out.count() == edges.count()
    assert {r.doc_id: r.text for r in out.collect()}[3] == " \n\t "
    assert substring_dedup.digest(nothing).count() == 0


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} or ({tuple(w)} if w else set())


@pytest.mark.parametrize(("percent", "each"), [(85, 3), (80, 5)])
def test_near_duplicates_equal_brute_force(spark, percent, each):
    rng = random.Random(percent)
    rows = []
    for _ in range(12):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(2, 200))]
        for _ in range(rng.randrange(1, 25)):
            rate = rng.choice([0, 0.01, 0.02, 0.04, 0.08])
            rows.append((len(rows), " ".join(x if rng.random() > rate else f"n{rng.randrange(9999)}" for x in base)))
    sets = {d: shingles(t, each) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * len(sets[a] | sets[b]) and find(a) != find(b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent, each).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def test_near_duplicates_edges(edges, nothing):
    got = [tuple(r) for r in minhash.near_duplicates(edges).collect()]
    assert {(1, 0, 1, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 3, None, False), (8, 1, 8, True)} <= set(got)
    assert got.count((6, 1, 6, True)) == 2 and len(got) == 10
    assert minhash.near_duplicates(nothing).count() == 0


def test_every_coordinate_of_a_sketch_fills_and_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5, 40, 3000):
        x = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        s = minhash.sketch(x)
        assert (s > 0).all() and len(set((s >> np.uint64(56)).tolist())) == minhash.SIZE
    agree = []
    for _ in range(60):
        x = rng.integers(0, 2**63, 900).astype(np.uint64)
        agree.append((minhash.sketch(np.unique(x[:600])) == minhash.sketch(np.unique(x[300:]))).mean())
    assert abs(np.mean(agree) - 1 / 3) < 0.03


def brute_links(ids, labels, vectors, threshold):
    x = np.array(vectors, float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    linked = (x @ x.T >= threshold) & (np.array(labels)[:, None] == np.array(labels)[None, :])
    np.fill_diagonal(linked, False)
    parent = {i: i for i in ids}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in zip(*np.nonzero(linked), strict=True):
        p, q = sorted((find(ids[a]), find(ids[b])))
        parent[q] = p
    return {i: (int(n), find(i)) for i, n in zip(ids, linked.sum(axis=1), strict=True)}


@pytest.mark.parametrize("whole", [512, 20])
def test_embeddings_equal_brute_force(spark, monkeypatch, whole):
    monkeypatch.setattr(embedding_dedup, "WHOLE", whole)
    rng = np.random.default_rng(whole)
    centers = rng.normal(size=(6, 24))
    rows = [centers[i % 6] + rng.normal(scale=s, size=24) for i, s in enumerate(rng.choice([0.05, 0.12, 0.2, 2.0], 400))]
    rows += [rows[0]] * 3
    labels = [int(x) for x in rng.integers(0, 2, len(rows))]
    frame = spark.createDataFrame([(i, [float(v) for v in x], y) for i, (x, y) in enumerate(zip(rows, labels, strict=True))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, 0.93).collect()}
    assert got == brute_links(list(range(len(rows))), labels, rows, 0.93)


def test_embedding_edges(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 1), (2, [2.0, 0.0], 1), (3, [1.0, 0.0], 2), (4, [1.0, 0.0], None), (5, None, 1), (6, [], 1), (7, [0.0, 0.0], 1), (8, [nan, 1.0], 1), (9, [1.0, None], 1), (11, [float("inf"), 1.0], 1), (12, [-float("inf"), nan], 1), (10, [1.0, 0.0, 0.0], 1), (2, [2.0, 0.0], 1), (None, [1.0, 0.0], 1)]
    frame = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<double>, label int, component long")
    got = [tuple(r) for r in embedding_dedup.near_duplicates(frame).collect()]
    assert (1, 1, 1, True) in got and got.count((2, 1, 1, False)) == 2 and (None, 0, None, False) in got
    assert all((i, 0, i, True) in got for i in range(3, 13)) and len(got) == len(rows)
    assert embedding_dedup.near_duplicates(frame.limit(0)).count() == 0


def test_passes_keep_the_chance_to_miss_at_any_size():
    few, many = (embedding_dedup.passes_for(n, 0.93, 128, 0.005) for n in (5_000, 10**9))
    assert 4 <= few < many


def test_pairs_of_a_crowded_label_are_found(spark):
    rng = np.random.default_rng(4)
    unit = lambda v: v / np.linalg.norm(v, axis=1, keepdims=True)
    n, pairs = 3000, 200
    x = np.sqrt(0.85) * np.eye(64)[0] + np.sqrt(0.15) * unit(rng.normal(size=(n, 64)))
    x = unit(x)
    apart = rng.normal(size=(pairs, 64))
    apart = unit(apart - (apart * x[:pairs]).sum(axis=1, keepdims=True) * x[:pairs])
    rows = np.vstack([x, 0.935 * x[:pairs] + np.sqrt(1 - 0.935**2) * apart, x[:5], x[:1], x[:1]])
    frame = spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, 0.93).collect()}
    want = brute_links(list(range(len(rows))), [0] * len(rows), rows, 0.93)
    assert sum(got[i] == want[i] for i in want) >= 0.995 * len(want)
    assert sum(want[i][0] > 0 for i in want) > 2 * pairs
    assert embedding_dedup.passes_measured(x[:1000], 100_000, 0.93, 128, 0.005) > 10 * embedding_dedup.passes_for(100_000, 0.93, 128, 0.005)


def test_one_id_on_several_texts_ties_their_groups(spark):
    first, second = [" ".join(f"{x}{i}" for i in range(60)) for x in "ab"]
    rows = [(1, first), (2, first + " end"), (1, second), (3, second + " end"), (4, first), (5, second), (6, "alone by itself here"), (7, None), (7, "alone by itself there")]
    for low in (0, -(1 << 62) - 5):
        docs = spark.createDataFrame([(d + low, t) for d, t in rows], "doc_id long, text string").repartition(3)
        got = {(r.doc_id - low, r.component_id - low) for r in minhash.near_duplicates(docs, 85, 3).collect()}
        assert got == {(d, 1) for d in range(1, 6)} | {(6, 6), (7, 7)}


def test_links_do_not_depend_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 32))
    x[1500:] = x[:1500] + 0.22 * rng.standard_normal((1500, 32))
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    vectors = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "vec_id long, label int, embedding array<double>")
    try:
        for n in (4, 200):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(vectors, 0.93).collect()}
            assert want.sum() > 1000 and sum(got[i] != want[i] for i in range(3000)) <= 0.005 * want.sum()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)


def test_sixteen_bits_decide_all_but_what_is_next_to_the_threshold(spark):
    rng = np.random.default_rng(12)
    x = rng.standard_normal((500, 48)) * rng.choice([0.01, 1.0, 30.0], (1, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    packed = embedding_dedup._packed(x)
    back, left = embedding_dedup._unpacked(packed.slice(7, 400))
    assert (np.abs(np.linalg.norm(back - x[7:407], axis=1) - left) < 1e-15).all() and left.max() < 1e-3
    error = left[:, None] + (1 + left[:, None]) * left[None, :] + embedding_dedup.ROUNDING
    assert (np.abs(back @ back.T - x[7:407] @ x[7:407].T) <= error).all()
    # pairs at the threshold itself, within a few units of the last place above and below it
    turn = np.eye(48)[1]
    rows = [np.eye(48)[0]]
    for c in (0.93 - 1e-9, 0.93 + 1e-9, 0.93 - 1e-6, 0.93 + 1e-6):
        turn = np.roll(turn, 7)
        rows.append(c * rows[0] + np.sqrt(1 - c * c) * turn)
    frame = spark.createDataFrame([(i, 0, [float(v) for v in r]) for i, r in enumerate(rows)], "vec_id long, label int, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(frame, 0.93).collect()}
    assert got == {0: (2, 0), 1: (0, 1), 2: (1, 0), 3: (0, 3), 4: (1, 0)}
