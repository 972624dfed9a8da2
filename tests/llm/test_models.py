import math
import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

from duplet.llm import html_extract, quality, sentencepiece_sampling, toxicity

needs_tokenizer = pytest.mark.skipif(not Path(sentencepiece_sampling.DEFAULT_MODEL).exists(), reason="no tokenizer here")


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "the", "re", "tion", "er", "st"]) for _ in range(rng.randrange(1, 4)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.randrange(20, 120))]
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            words = [w.upper() + "!!" for w in words] if i % 8 else [w + rng.choice(["###", "$$$"]) for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["mubbly", "grotter", "grottering", "zastard"])
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    return rows


def test_quality_learns_and_holds_on_unseen_texts():
    train, test = corpus(300, 1), corpus(200, 2)
    m = quality.fit([t for _, t, _, _ in train], [q for _, _, q, _ in train], quality.Settings(steps=2400))
    s = m.scores(pa.array([t for _, t, _, _ in test]))
    assert np.mean((s >= 0.7) == np.array([q for _, _, q, _ in test])) > 0.97
    again = quality.fit([t for _, t, _, _ in train], [q for _, _, q, _ in train], quality.Settings(steps=2400))
    assert (again.weight == m.weight).all()


def test_quality_features_stay_within_words_and_documents():
    alone = [quality.features(np.frombuffer(t.encode(), np.uint8), np.array([0, len(t.encode())]), 1 << 16)[0] for t in ("ab cde", "é xyz xyz")]
    data = np.frombuffer("ab cdeé xyz xyz".encode(), np.uint8)
    f, d = quality.features(data, np.array([0, 6, len(data)]), 1 << 16)
    for i in (0, 1):
        assert Counter(f[d == i].tolist()) == Counter(alone[i].tolist())


def test_quality_edges(spark, edges, nothing):
    m = quality.Model(np.zeros(1 << 10), 1.0)
    got = {r.doc_id: r.score for r in quality.score(edges, m).collect()}
    assert got[1] == got[2] == got[8] == pytest.approx(1 / (1 + math.exp(-1))) and quality.score(nothing, m).count() == 0
    assert quality.keep(edges, m).count() == edges.count() and quality.keep(edges, quality.Model(np.zeros(8), -1.0)).count() == 0
    assert quality.fit([], []).scores(pa.array(["x"]))[0] == 0.5


def test_held_out_folds(spark):
    got = spark.range(50).select(quality.held_out(__import__("pyspark").sql.functions.col("id"), 4, 2).alias("h")).collect()
    assert [r.h for r in got] == [zlib.crc32(str(i).encode()) % 4 == 2 for i in range(50)]


def test_toxicity_finds_unseen_forms_and_leaves_clean_texts():
    train, test = corpus(600, 3), corpus(300, 4)
    index = toxicity.fit([(i, t, y) for i, t, _, y in train])
    s, evidence = index.scores(pa.array([t for _, t, _, _ in test]))
    y = np.array([x[3] for x in test])
    assert (s[y == 1] >= 0.7).mean() > 0.97 and (s[y == 0] < 0.7).mean() > 0.99
    assert all(evidence[i] for i in np.flatnonzero(y))


def test_nearest_equals_brute_force():
    train = corpus(300, 5)
    index = toxicity.fit([(i, t, y) for i, t, _, y in train], toxicity.Settings(block=16, min_chi=0.0, ratio=1.0))
    dense = np.zeros((len(train), len(index.vocabulary)))
    term = np.repeat(np.arange(len(index.vocabulary)), index.start[:, -1] - index.start[:, 0])
    dense[index.example, term] = index.weight
    for i in range(0, 300, 17):
        t = np.flatnonzero(dense[i])
        c, who = index.nearest(t, dense[i, t], 10)
        all_ = dense @ dense[i]
        want = sorted(range(len(train)), key=lambda j: (-round(all_[j], 12), j))[:10]
        assert who.tolist() == [j for j in want if all_[j] > 0] and np.allclose(c, all_[who])


def test_toxicity_learns_insults_that_are_each_rare_or_quoted():
    def texts(n, seed, quoted):
        rng, out = random.Random(seed), []
        names = ["".join(random.Random(j).choices("lmnopqrstuvwxyz", k=8)) for j in range(120)]
        for i in range(n):
            words = ["".join(rng.choices("abcdefghijk", k=2)) for _ in range(rng.randrange(40, 120))]
            for _ in range(3 if i % 2 else int(rng.random() < quoted)):
                words[rng.randrange(len(words))] = rng.choice(names)
            out.append((i, " ".join(words), i % 2))
        return out

    for quoted, least in ((0.0, 0.9), (0.05, 0.8)):
        s, evidence = toxicity.fit(texts(800, 1, quoted)).scores(pa.array([t for _, t, _ in texts(300, 2, quoted)]))
        assert (s[1::2] >= 0.7).mean() > least and (s[::2] < 0.7).mean() > 0.9
        assert all(evidence[1::2])


def test_toxicity_edges(spark, edges, nothing):
    index = toxicity.fit([(i, t, y) for i, t, _, y in corpus(200, 6)])
    got = {r.doc_id: (r.score, r.predicted, r.evidence) for r in toxicity.score(edges, index).collect()}
    assert got[1] == got[2] == got[3] and got[1][1] == 0 and got[1][2] == [] and toxicity.score(nothing, index).count() == 0
    assert toxicity.fit([]).scores(pa.array(["x", None]))[0].shape == (2,)


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var x="</p>";</script></head><body><nav><ul><li><a href="/">Home</a><li><a href="/b">B</a></ul></nav><!-- <p>no</p> --><div class="ad">Buy now.</div>
<article><h1>A  title&nbsp;here</h1><p><b>First   text &lt;b&gt; &#233;.<br><p>Second<i> one</i> goes on, and on.</article><div class="comments"><p>I disagree.</p></div><footer>&copy; me"""


def test_blocks_decode_and_follow_open_tags():
    got = html_extract.blocks(PAGE)
    assert [b.text for b in got] == ["T & t", "Home", "B", "Buy now.", "A title here", "First text <b> é.", "Second one goes on, and on.", "I disagree.", "© me"]
    assert got[5].path == got[6].path and got[4].path[-2:] == ("article", "h1") and got[1].linked == 1.0
    assert html_extract.blocks("") == [] and html_extract.blocks("<p>a < b &amp c <") and html_extract.blocks("<!-- open <p>x") == []


def test_digits_are_counted_over_the_whole_block():
    block = html_extract.blocks(f"<p>{'a' * 400}{'7' * 1200}</p>")[0]
    assert html_extract._shape(block, 0, 1)[5] == pytest.approx(0.75)


def test_gradients_are_those_of_the_loss():
    net = html_extract.Network(1)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    pages = [html_extract.blocks(PAGE), html_extract.blocks("<p>one<p>two")]
    batch = html_extract.Network.batch(pages)
    labels = (np.arange(batch[3].size).reshape(batch[3].shape) % 2).astype(float)

    def loss():
        p = net.forward(*batch)
        return -((labels * np.log(p) + (1 - labels) * np.log(1 - p)) * batch[3]).sum() / batch[3].sum()

    state = {}
    before = {k: v.copy() for k, v in net.p.items()}
    net.step(*batch, labels, state, 0.0)
    grads = {k: state[k][0] / 0.1 for k in before}
    for k in ("wf", "wb", "cf", "out", "path", "word"):
        at = np.unravel_index(np.abs(grads[k]).argmax(), grads[k].shape)
        net.p = {a: b.astype(np.float64) for a, b in before.items()}
        net.p[k][at] += 1e-3
        up = loss()
        net.p[k][at] -= 2e-3
        assert (up - loss()) / 2e-3 == pytest.approx(grads[k][at], rel=0.03, abs=1e-5)


def test_extraction(spark):
    net = html_extract.train()
    rng = np.random.default_rng(77)
    made = [html_extract.invent(rng) for _ in range(150)]
    right = [((s >= 0.5) == np.array(y)).mean() for s, (_, y) in zip(net.scores([x for x, _ in made]), made, strict=True) if len(y)]
    assert np.mean(right) > 0.98
    pages = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (3, "u", "", "x"), (None, "u", "<p", "x"), (1, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    got = sorted(html_extract.extract(pages, net).collect(), key=str)
    text = "A title here\n\nFirst text <b> é.\n\nSecond one goes on, and on."
    assert [r.text for r in got if r.page_id == 1] == [text] * 2 and {(r.text, r.n_chars) for r in got if r.page_id != 1} == {("", 0)}
    assert html_extract.extract(pages.limit(0), net).count() == 0


@needs_tokenizer
def test_segmentations_are_a_sample_without_replacement():
    p = sentencepiece_sampling.pieces(sentencepiece_sampling.DEFAULT_MODEL, 1.0)
    ids = {b: i for i, b in enumerate(p.bytes) if b and p.byte_id[b[0]] != i}
    found = []

    def walk(rest, path, logp):
        if not rest:
            found.append((tuple(path), logp))
        for n in range(1, min(len(rest), p.longest) + 1):
            if rest[:n] in ids:
                walk(rest[n:], [*path, ids[rest[:n]]], logp + p.logp[ids[rest[:n]]])

    walk(b" the cat", [], 0.0)
    total = np.logaddexp.reduce([x for _, x in found])
    share = {s: math.exp(x - total) for s, x in found}
    n, k = 4000, 3
    rows = sentencepiece_sampling.segment(pa.array(["the cat"] * n), np.arange(n), p, k, 1)
    assert all(len({tuple(x[0].tolist()) for x in r}) == k for r in rows)
    assert all(x[1] == pytest.approx(math.log(share[tuple(x[0].tolist())])) for r in rows[:50] for x in r)
    first, second = (Counter(tuple(r[i][0].tolist()) for r in rows) for i in (0, 1))
    for s, q in sorted(share.items(), key=lambda x: -x[1])[:4]:
        later = sum(share[a] * q / (1 - share[a]) for a in share if a != s)
        assert first[s] / n == pytest.approx(q, abs=0.03) and second[s] / n == pytest.approx(later, abs=0.03)
    # each segmentation's share over its inclusion probability adds up to 1 in the mean
    assert np.mean([sum(math.exp(x[1] - x[3]) for x in r) for r in rows]) == pytest.approx(1, abs=0.02)


@needs_tokenizer
def test_segmentation_edges(spark, edges, nothing):
    got = sentencepiece_sampling.encode(edges, 2)
    back = {r.doc_id: r.text for r in sentencepiece_sampling.decode_column(got).collect()}
    assert all(back[r.doc_id] == (r.text or "") for r in edges.collect())
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[1].n_samples == rows[2].n_samples == 0 and rows[4].n_samples == 2 and rows[4].samples[0]["perturbed"] > rows[4].samples[1]["perturbed"]
    assert {r.doc_id: r.samples for r in sentencepiece_sampling.encode(edges.repartition(3), 2).collect()}[8] == rows[8].samples
    assert sentencepiece_sampling.encode(nothing).count() == 0


@needs_tokenizer
def test_segmentations_do_not_depend_on_what_is_held(monkeypatch):
    p = sentencepiece_sampling.pieces(sentencepiece_sampling.DEFAULT_MODEL, 1.0)
    rng = random.Random(4)
    texts = pa.array([" ".join(rng.choice(["the", "cat", "sitting", "é▁😀", "\n\n", "", "zq" * 40, str(rng.random())]) for _ in range(rng.randrange(80))) for _ in range(120)])
    keys = np.arange(120)
    plain = lambda rows: [[(x[0].tolist(), *x[1:]) for x in r] for r in rows]
    whole = plain(sentencepiece_sampling.segment(texts, keys, p, 3, 1))
    for chunk, nodes in ((300, 200), (5000, 1 << 19), (1, 50)):
        monkeypatch.setattr(sentencepiece_sampling, "CHUNK", chunk)
        monkeypatch.setattr(sentencepiece_sampling, "NODES", nodes)
        assert plain(sentencepiece_sampling.segment(texts, keys, p, 3, 1)) == whole
    # units whose hashes collide are told apart by what their pieces spell
    monkeypatch.setattr(sentencepiece_sampling, "run_hashes", lambda v, a, b, base: (b - a).astype(np.uint64))
    for t, r in zip(texts.to_pylist(), sentencepiece_sampling.segment(texts, keys, p, 3, 1), strict=True):
        assert all(sentencepiece_sampling.decode(x[0], p) == t for x in r)


def test_deep_and_unclosed_tags_take_time_in_proportion():
    n = 30_000
    for page in ("<div>t" * n, "<b>" * n + "<hr>t" * n, "<div>" * n + "</x>t" * n, "<p><b>" * n + "<hr>t" * n, "<ul><li>" * n + "<li>t" * n):
        found = html_extract.blocks(page)
        assert found and max(len(b.path) for b in found) <= html_extract.LEVELS
    assert [b.path[-1] for b in html_extract.blocks("<div>" * 100 + "<section>a</section>b")] == ["section", "div"]
