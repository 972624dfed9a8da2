import random
from collections import Counter
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from duplet.functions.similarity import ratio
from duplet.functions.text import content_hash
from duplet.operators import blocks, cells, classes, clones, delta, planes, prefixes, storage, vocab


def units_of(spark, rows):
    made = spark.createDataFrame([(i, p, q, a, z, t) for i, (p, q, a, z, t) in enumerate(rows)], "unit_ord long, path string, qualname string, start_line long, end_line long, tokens array<string>")
    return made.withColumn("path_parts", F.split("path", "/")).withColumn("n_tokens", F.size("tokens")).withColumn("hash", content_hash(F.col("tokens")))


def files_of(spark, tokens):
    rows = [(p, p.split("/"), list(t), list(range(1, len(t) + 1))) for p, t in tokens.items()]
    return spark.createDataFrame(rows, "path string, path_parts array<string>, tokens array<string>, lines array<int>")


def blocks_of(spark, tokens, k):
    return {(r.a.file, r.a.start_line, r.b.file, r.b.start_line, r.tokens) for r in blocks.find_blocks(files_of(spark, tokens), k).collect()}


@pytest.mark.parametrize("least", [0.0, 0.3, 0.6, 0.9])
def test_clones_equal_a_scan_of_all_pairs(spark, least):
    rng = random.Random(4)
    base = [str(rng.randrange(12)) for _ in range(30)]
    rows = []
    for i in range(14):
        t = [x if rng.random() > i / 20 else str(rng.randrange(12)) for x in base]
        rows.append((f"f{i % 5}.py", f"u{i}", 10 * i, 10 * i + 5, t))
    rows.append(("f0.py", "outer", 0, 200, base))  # holds every unit of its file
    got = {(r.a.qualname, r.b.qualname): r.similarity for r in clones.find_clones(units_of(spark, rows), least).collect()}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0].split("/"), rows[i][2], rows[i][3], i))
    want = {}
    for x, i in enumerate(order):
        for j in order[x + 1 :]:
            a, b = rows[i], rows[j]
            nest = a[0] == b[0] and ((a[2] <= b[2] and b[3] <= a[3]) or (b[2] <= a[2] and a[3] <= b[3]))
            r = ratio(a[4], b[4])
            if not nest and r >= least:
                want[a[1], b[1]] = r
    assert got == want


def test_same_tokens_in_another_order_are_no_clone(spark):
    rows = [("a.py", "x", 1, 2, list("abcdefghij")), ("b.py", "y", 1, 2, list("jihgfedcba"))]
    assert clones.find_clones(units_of(spark, rows), 0.6).isEmpty()


def test_file_order_is_by_path_component(spark):
    rows = [("a.b.py", "x", 1, 2, ["t"]), ("a/b.py", "y", 1, 2, ["t"])]
    assert clones.find_clones(units_of(spark, rows)).first().a.file == "a/b.py"


def test_only_the_anchor_is_paired(spark):
    tokens = {"A": ["90", "1", "2", "3", "91"], "B": ["80", "1", "2", "3", "4", "5", "6", "81"], "C": ["70", "1", "2", "3", "4", "5", "6", "71"]}
    found = blocks_of(spark, tokens, 3)
    assert ("A", 2, "B", 2, 3) in found and ("A", 2, "C", 2, 3) in found
    assert not any(x[4] == 6 for x in found)


def test_runs_of_one_file_may_overlap(spark):
    assert blocks_of(spark, {"A": list("1212121")}, 2) == {("A", 1, "A", 3, 5), ("A", 1, "A", 5, 3)}


def test_n_places_give_n_minus_one_pairs(spark):
    tokens = {f"f{i}": ["s", "a", "b", "c", "d", str(i)] for i in range(5)}
    assert len(blocks_of(spark, tokens, 4)) == 4


def test_blocks_equal_a_naive_search(spark):
    rng = random.Random(2)
    tokens = {f"f{i}": [str(rng.randrange(3)) for _ in range(rng.randrange(30))] for i in range(6)}
    k, places = 4, {}
    for p in sorted(tokens):
        for s in range(len(tokens[p]) - k + 1):
            places.setdefault(tuple(tokens[p][s : s + k]), []).append((p, s))
    want = set()
    for (a, sa), *others in places.values():
        for b, sb in others:
            ta, tb = tokens[a], tokens[b]
            if sa and sb and ta[sa - 1] == tb[sb - 1]:
                continue
            n = 0
            while sa + n < len(ta) and sb + n < len(tb) and ta[sa + n] == tb[sb + n]:
                n += 1
            want.add((a, sa + 1, b, sb + 1, n))
    assert blocks_of(spark, tokens, k) == want


def names(spark, sets):
    return spark.createDataFrame([(p, [p], n) for p, s in sets.items() for n in s], "path string, path_parts array<string>, name string")


@pytest.mark.parametrize("least", [0.0, 0.4, 0.8, 1.0])
def test_vocab_pairs_equal_all_pairs(spark, least):
    rng = random.Random(3)
    sets = {f"f{i}": set(rng.sample("abcdefghijklmnop", rng.randrange(3, 14))) for i in range(9)}
    got = {(r.a, r.b): (r.shared, r.overlap) for r in vocab.find_vocab_pairs(names(spark, sets), None, least, 3).collect()}
    want = {}
    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both / min(len(sets[a]), len(sets[b])) >= least:
                want[a, b] = (both, both / min(len(sets[a]), len(sets[b])))
    assert got == want


def test_a_subset_overlaps_wholly_and_small_vocabularies_do_not_count(spark):
    sets = {"big": set("abcdefgh"), "small": set("abcd"), "tiny": set("ab")}
    assert [(r.a, r.b, r.overlap) for r in vocab.find_vocab_pairs(names(spark, sets), None, 0.5, 3).collect()] == [("big", "small", 1.0)]


def test_classes_follow_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 101)], "a long, b long")
    got = {r.id: r.class_id for r in classes.classes(edges).collect()}
    assert got == {**{i: 0 for i in range(21)}, 100: 100, 101: 100}


def test_union_find():
    u = classes.UnionFind(5)
    assert u.union(0, 3) and u.union(3, 4) and not u.union(0, 4)
    assert (u.set_size(4), u.groups(2), len(u)) == (3, [[0, 3, 4]], 5)


UNIT = "struct<file: string, qualname: string, start_line: long, end_line: long, hash: string>"


def clone_rows(spark, rows):
    return spark.createDataFrame([(s, ("f", "a", 1, 2, x), ("g", "b", line, 9, y)) for s, x, y, line in rows], f"similarity double, a {UNIT}, b {UNIT}")


def test_clone_delta(spark):
    base = clone_rows(spark, [(0.86, "h1", "h2", 1), (0.5, "h5", "h6", 1)])
    head = clone_rows(spark, [(0.9, "h2", "h1", 40), (0.9, "h1", "h3", 1), (0.8, "h1", "h4", 1), (1.0, "h7", "h7", 1), (0.9, "h5", "h6", 1)])
    assert {(r.a.hash, r.b.hash) for r in delta.new_clones(head, base, 0.85).collect()} == {("h1", "h3"), ("h7", "h7")}


def test_block_delta_knows_files_but_not_lines(spark):
    place = "struct<file: string, start_line: long, end_line: long>"
    make = lambda rows: spark.createDataFrame([((a, s, 9), (b, 1, 9), 50, "h") for a, b, s in rows], f"a {place}, b {place}, tokens long, hash string")
    found = delta.new_blocks(make([("y", "x", 70), ("x", "moved", 1)]), make([("x", "y", 1)])).collect()
    assert [(r.a.file, r.b.file) for r in found] == [("x", "moved")]


def test_vocab_delta(spark):
    make = lambda rows: spark.createDataFrame(rows, "a string, b string, overlap double, zero_inbound boolean")
    base = make([("a", "b", 0.5, False), ("a", "c", 0.5, False), ("a", "d", 0.5, False), ("a", "e", 0.5, True)])
    head = make([("b", "a", 0.55, False), ("a", "c", 0.56, False), ("a", "d", 0.9, True), ("a", "e", 0.52, True), ("a", "z", 0.6, True)])
    got = {(r.a, r.b): (r.change, r.from_overlap) for r in delta.vocab_changes(head, base, 0.05).collect()}
    assert got == {("a", "c"): ("worsened", 0.5), ("a", "d"): ("became_unreferenced", None), ("a", "z"): ("new", None)}


def test_truncate(spark):
    rows = spark.range(5).orderBy("id")
    assert [(d.count(), n) for d, n in (delta.truncate(rows, k) for k in (None, 0, 3, 9))] == [(5, 0), (0, 5), (3, 2), (5, 0)]


def test_pairs_of_many_cells_equal_a_naive_count(spark, monkeypatch):
    monkeypatch.setattr(cells, "SEQUENCES", 3)  # a grid of four by four
    rng = random.Random(9)
    words = {f"s{i}": [rng.choice("abcde") for _ in range(rng.randrange(1, 12))] for i in range(12)}
    sequences = spark.createDataFrame([(h, t, len(t)) for h, t in words.items()], "hash string, tokens array<string>, n_tokens int")
    got = {(r.hash_a, r.hash_b): r.quick_ratio for r in clones.quick_ratios(sequences, 0.6).collect()}
    bound = lambda a, b: 2.0 * sum(min(a.count(x), b.count(x)) for x in set(a)) / (len(a) + len(b))
    want = {(x, y): bound(words[x], words[y]) for x in words for y in words if x < y and bound(words[x], words[y]) >= 0.6}
    assert want and got == pytest.approx(want)


def test_paths_that_occur_once_stay_where_they_are(spark):
    tokens = {f"f{i}": [f"{i}w{j}" for j in range(400)] for i in range(4)}
    tokens["g"] = ["x"] + tokens["f1"][100:140]
    sequences = blocks.packed(files_of(spark, tokens))
    found = blocks._paths(sequences, 30).collect()
    assert {r.key for r in found} == {"f1", "g"} and sum(len(r.windows) // 8 for r in found) < 100
    assert blocks_of(spark, tokens, 30) == {("f1", 101, "g", 2, 40)}


@pytest.mark.parametrize("k", [1, 2, 7])
def test_blocks_of_periodic_tokens_equal_a_naive_search(spark, k):
    rng = random.Random(k)
    tokens = {f"{i % 3}/f{i}": [x for _ in range(rng.randrange(12)) for x in rng.choice(("ab", "a", "abc", "cé"))] for i in range(9)} | {"none": []}
    places = {}
    for p in sorted(tokens, key=lambda p: p.split("/")):
        for s in range(len(tokens[p]) - k + 1):
            places.setdefault(tuple(tokens[p][s : s + k]), []).append((p, s))
    want = set()
    for (a, sa), *others in places.values():
        for b, sb in others:
            ta, tb = tokens[a], tokens[b]
            if not (sa and sb and ta[sa - 1] == tb[sb - 1]):
                n = next((i for i, (x, y) in enumerate(zip(ta[sa:], tb[sb:], strict=False)) if x != y), min(len(ta) - sa, len(tb) - sb))
                want.add((a, sa + 1, b, sb + 1, n))
    assert blocks_of(spark, tokens, k) == want


def test_blocks_among_known_files_are_left_out_as_by_the_delta(spark):
    rng = random.Random(5)
    tokens = {f"f{i}": [str(rng.randrange(3)) for _ in range(rng.randrange(40))] for i in range(8)}
    old = {p: t for p, t in tokens.items() if p in ("f0", "f2", "f3", "f6")}
    head, base = (blocks.find_blocks(files_of(spark, t), 4) for t in (tokens, old))
    known = spark.createDataFrame([(p,) for p in old], "key string")
    got = blocks.find_packed_blocks(blocks.packed(files_of(spark, tokens)), 4, known)
    assert sorted(map(str, got.collect())) == sorted(map(str, delta.new_blocks(head, base).collect())) != []


def test_vocab_pairs_across_blocks_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(vocab, "DOCUMENTS", 6)
    rng = random.Random(8)
    sets = {f"{i % 4}/f{i}": set(rng.sample("abcdefghijklmnopqé", rng.randrange(3, 15))) for i in range(30)}
    docs = spark.createDataFrame([(p, p.split("/"), sorted(s)) for p, s in sets.items()], "path string, path_parts array<string>, names array<string>")
    want = {(a, b, len(sets[a] & sets[b]), tuple(sorted(sets[a] & sets[b]))) for a in sets for b in sets if a.split("/") < b.split("/") and len(sets[a] & sets[b]) >= 0.6 * min(len(sets[a]), len(sets[b]))}
    assert want == {(r.a, r.b, r.shared, tuple(r.sample_shared)) for r in vocab.overlapping(docs, None, 0.6, 3).collect()}


def test_pairs_beyond_the_bits_and_across_batches_equal_a_naive_count(spark, monkeypatch):
    monkeypatch.setattr(vocab, "COMMON", 70)  # two words of bits, with rare names beside them
    monkeypatch.setattr(vocab, "SETS", 3)
    rng = random.Random(11)
    sets = {f"d{i}": sorted({f"w{int(200 * rng.random() ** 2)}" for _ in range(rng.randrange(5, 90))}) for i in range(40)}
    known = {p for p in sets if rng.random() < 0.4}
    docs = spark.createDataFrame([(p, [p], s, p in known) for p, s in sets.items()], "path string, path_parts array<string>, names array<string>, known boolean")
    for least in (0.0, 0.3, 0.55):
        want = {(a, b, len(set(x) & set(y))) for a, x in sets.items() for b, y in sets.items() if a < b and min(len(x), len(y)) >= 6 and len(set(x) & set(y)) >= least * min(len(x), len(y)) - 1e-9}
        assert want == {(r.a, r.b, r.shared) for r in vocab.overlapping(docs.drop("known"), None, least, 6).collect()}
        assert {w for w in want if not {w[0], w[1]} <= known} == {(r.a, r.b, r.shared) for r in vocab.overlapping(docs, None, least, 6).collect()}


def test_vocab_delta_counts_its_pairs_once(spark, tmp_path, monkeypatch):
    from duplet.plans import queries

    text = [" ".join(f"w{j}" for j in range(i, i + 40)) for i in range(6)]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(text)], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, text[2])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(0,), (1,), (2,)], "doc_id long").write.parquet(f"{tmp_path}/labels.parquet")
    asked = []
    real = vocab.overlapping
    monkeypatch.setattr(vocab, "overlapping", lambda *a, **k: asked.append(1) or real(*a, **k))
    rows = queries.delta_vocab(spark, str(tmp_path)).collect()
    assert len(asked) == 1 and {r.change for r in rows} == {"new"}
    names = ["benchmark/00000001", *(f"s/{i:08}" for i in range(6))]
    old = set(names[1:4])
    assert {(r.a, r.b) for r in rows} == {(a, b) for a in names for b in names if a < b and not {a, b} <= old}
    # a path with one text in the old snapshot and one outside it takes both runs
    spark.createDataFrame([(1, text[2], "en", "benchmark")], "doc_id long, text string, lang string, source string").write.mode("append").parquet(f"{tmp_path}/documents.parquet")
    rows = queries.delta_vocab(spark, str(tmp_path)).collect()
    assert len(asked) == 3 and ("benchmark/00000001", "s/00000000") not in {(r.a, r.b) for r in rows}


@pytest.mark.parametrize("least", [0.5, 0.7, 0.85])
def test_only_near_pairs_are_candidates_and_none_is_lost(spark, monkeypatch, least):
    monkeypatch.setattr(prefixes, "SEQUENCES", 25)  # bands in parts
    monkeypatch.setattr(cells, "FAMILY", 4)
    rng = random.Random(3)
    word = lambda: f"w{int(400 * rng.random() ** 3)}"
    made = [[word() for _ in range(rng.randrange(20, 200))] for _ in range(60)]
    made += [[x if rng.random() > 0.2 * rng.random() else word() for x in t][: rng.randrange(15, 210)] for t in made for _ in range(2)]
    made += [t[::-1] for t in made[:9]]
    words = {f"s{i:03}": t for i, t in enumerate(made)}
    sequences = spark.createDataFrame([*words.items(), *list(words.items())[::7]], "hash string, tokens array<string>")  # some twice
    bag = {h: Counter(t) for h, t in words.items()}
    bound = lambda a, b: 2.0 * sum((bag[a] & bag[b]).values()) / (len(words[a]) + len(words[b]))
    want = {(x, y): q for x in words for y in words if x < y and (q := bound(x, y)) >= least}
    found = [(r.hash_a, r.hash_b) for r in clones.candidates(sequences, least).collect()]
    assert len(found) == len(set(found)) and set(want) <= set(found) and (least < 0.8 or len(found) < 3 * len(want) + 60)
    assert {(r.hash_a, r.hash_b): r.quick_ratio for r in clones.quick_ratios(sequences, least).collect()} == pytest.approx(want)


def test_stored_tables_are_packed_tightly(spark):
    files = storage.stored(spark.range(5), "numbers").inputFiles()
    assert files and all(f.endswith(".zstd.parquet") for f in files)


def test_sets_are_counted_in_full_only_if_their_rarest_names_meet(monkeypatch):
    rng = np.random.default_rng(5)
    sets = sorted((sorted(set((rng.zipf(1.3, rng.integers(5, 90)) % 3000).tolist())) for _ in range(300)), key=len)
    sets += [sets[-1]] * 2
    codes = np.unique(np.concatenate(sets))
    place = {c: i for i, c in enumerate(sorted(codes.tolist(), key=lambda c: (sum(c in s for s in sets), c)))}
    coded = [np.array(sorted(place[c] for c in s), np.int32) for s in sets]
    flat, bounds = np.concatenate(coded), np.append(0, np.cumsum([len(c) for c in coded]))
    for common in (70, 5000):
        low = max(0, len(codes) - common)
        bits = vocab._bits(np.repeat(np.arange(len(sets)), np.diff(bounds))[flat >= low], flat[flat >= low] - low, len(sets), len(codes) - low)
        index = vocab._Index(flat, bounds, bits, low, len(codes))
        counted, whole = [], vocab._Index._counted
        monkeypatch.setattr(vocab._Index, "_counted", lambda self, found, *x: counted.append(len(found)) or whole(self, found, *x))  # noqa: B023
        for i in range(0, len(sets), 7):
            some = np.arange(i, min(i + 7, len(sets)))
            need = np.maximum(1, np.ceil(0.55 * np.diff(bounds)[some]).astype(np.int64))
            for x, (found, n) in zip(some.tolist(), index.shared([coded[v] for v in some], bits[:, some].T, need, some + 1), strict=True):
                want = {y: k for y in range(x + 1, len(sets)) if (k := len(set(sets[x]) & set(sets[y]))) >= need[x - i]}
                assert dict(zip(found.tolist(), n.tolist(), strict=True)) == want
        monkeypatch.setattr(vocab._Index, "_counted", whole)
        assert sum(counted) < len(sets) * (len(sets) - 1) // 4


def test_minimizers_are_let_go_before_the_paths_travel(spark, monkeypatch):
    frames, let_go = [], []
    real = blocks.bit_map
    monkeypatch.setattr(blocks, "bit_map", lambda df, c: frames.append(c) or real(df, c))
    monkeypatch.setattr(blocks, "released", lambda s: let_go.append(len(frames)))
    blocks._paths(blocks.packed(files_of(spark, {"a": "x y z u v".split(), "b": "x y z u w".split()})), 3)
    assert let_go == [1]


def test_token_lists_travel_whole():
    lists = [["a", "", "Ä" * 300], [], ["x\x1fy", "z"] * 900]
    column = pa.array([["left out"], *lists], pa.list_(pa.string()))[1:]
    assert cells.unpacked(cells.packed(column)).to_pylist() == lists
    assert cells.unpacked(cells.packed(column[:0])).to_pylist() == []


def test_tables_of_tokens_go_before_pairs_are_matched(spark, monkeypatch):
    frames = {}
    for module in (clones, prefixes, cells):
        monkeypatch.setattr(module, "stored", lambda df, name: frames.setdefault(name, storage.stored(df, name)))
    rows = [(f"{x}.py", x, 1, 2, [*"abcdefghij", x]) for x in "xyz"]
    found = clones.similar_blocks(units_of(spark, rows), 0.6)
    left = lambda name: Path(frames[name].inputFiles()[0].removeprefix("file://")).exists()
    assert not left("sequences") and not left("prefixes") and left("met")
    assert {(r.at_a, r.at_b, r.size) for r in found.collect()} == {(0, 0, 10)} and found.count() == 3


def test_pairs_travel_as_numbers(spark, monkeypatch):
    frames = {}
    for module in (clones, prefixes, cells):
        monkeypatch.setattr(module, "stored", lambda df, name: frames.setdefault(name, storage.stored(df, name)))
    rows = [("z.py", "z", 1, 2, [*"abcdefghij", "z"]), ("a.py", "a", 1, 2, [*"abcdefghij", "y"]), ("zz.py", "zz", 1, 2, [*"abcdefghij", "y"])]
    found = clones.similar_streams(units_of(spark, rows), 0.6).collect()
    assert {frames[x].schema[s].dataType.simpleString() for x in ("pairs", "dealt") for s in "ab"} == {"bigint"}
    hashes = {r.path: r.hash for r in units_of(spark, rows).collect()}
    assert [(r.hash_a, r.hash_b) for r in found] == [(hashes["a.py"], hashes["z.py"])]  # from the one that comes first


def test_counts_of_rows_by_bits():
    rng = np.random.default_rng(4)
    for n in (0, 1, 2, 3, 8, 31, 200):
        rows = rng.integers(0, 1 << 63, (n, 3), dtype=np.uint64)
        want = np.unpackbits(rows.view(np.uint8).reshape(n, 24), axis=1).sum(axis=0)
        got = sum((np.unpackbits(p.view(np.uint8)).astype(int) << j for j, p in enumerate(planes.added(rows))), np.zeros(192, int))
        assert (got == want).all()


@pytest.mark.parametrize(("common", "seldom", "ahead"), [(1 << 14, 400, 64), (5, 3, 8), (0, 400, 64), (40, 1, 8)])
def test_vocab_samples_by_bits_equal_all_pairs(spark, monkeypatch, common, seldom, ahead):
    for name, value in (("PACK", 1500), ("HELD", 4000), ("TOGETHER", 2), ("TASKS", 4), ("ROWS", common), ("SELDOM", seldom), ("AHEAD", ahead)):
        monkeypatch.setattr(planes, name, value)
    rng = random.Random(common + ahead)
    most = rng.sample(range(300), 60)
    docs = [(f"{'ab'[i % 2]}/{i:03d}", sorted({f"n{x}" if x % 5 else f"é{x}" for x in rng.sample(most if i % 3 else range(300), rng.randrange(12, 55))}), i % 4 == 0) for i in range(90)]
    docs += [(p + "x", names, known) for p, names, known in docs[:9]]
    both = [(x, y, sorted(set(x[1]) & set(y[1]))) for x in docs for y in docs if x[0].split("/") < y[0].split("/") and not (x[2] and y[2])]
    want = sorted((x[0], y[0], len(s), len(x[1]), len(y[1]), " ".join(s[:25])) for x, y, s in both if len(s) / min(len(x[1]), len(y[1])) >= 0.55)
    own = spark.createDataFrame([(p, p.split("/"), names, known) for p, names, known in docs], "path string, path_parts array<string>, names array<string>, known boolean").repartition(3)
    columns = ("a", "b", "shared", "a_vocabulary", "b_vocabulary", "sample_shared")
    assert want == sorted(map(tuple, vocab.overlapping(own, None, 0.55, 12, joined=" ").select(*columns).collect()))
    assert want == sorted((*r[:5], " ".join(r[5])) for r in vocab.overlapping(own, None, 0.55, 12).select(*columns).collect())


def test_vocab_samples_store_packs_alone(spark, tmp_path, monkeypatch):
    from duplet.plans import queries

    words = [f"w{i}" for i in range(60)]
    spark.createDataFrame([(i, " ".join(words[i : i + 50]), "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    names = []
    for module in (vocab, planes):
        monkeypatch.setattr(module, "stored", lambda df, name, *x, real=module.stored, **k: names.append(name) or real(df, name, *x, **k))
    found = queries.vocab_samples(spark, str(tmp_path))
    assert names == ["packs"] and found.count() == 15
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_names_of_latin_texts_are_those_of_the_tokens(spark, tmp_path):
    from duplet.functions.text import prose_tokens
    from duplet.plans import prose

    every = " ".join(f"{chr(i)}x{chr(i)} Q{chr(i)}" for i in range(256))
    texts = [every, every.replace("x", ""), "", None, "12 012 a1 1a NUM num ÀÉ àé ß ẞ", "Ωmega ωmega 12 ÿ Ÿ", "٣٤ 34 ² 2² ½", "..", "a\tb\nB\x0bc\x85d\xa0e"]
    spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {r.path: r.names for r in prose.documents(spark, str(tmp_path)).select("path", F.array_distinct(prose_tokens(F.col("text"))).alias("names")).collect()}
    assert want == {r.path: r.names for r in prose.vocabularies(spark, str(tmp_path)).collect()}
