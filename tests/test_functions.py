import hashlib
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from duplet.functions import matching, text
from duplet.functions.similarity import Matcher, matching_blocks, quick_ratio, ratio, real_quick_ratio

SEQUENCES = [[], [1], [1, 2, 3], [3, 2, 1], [1, 2, 3, 4, 5, 6], [4, 5, 6, 1, 2, 3], [1, 1, 1, 1], [9, 9, 1, 2], [1, 2, 8]]


def test_swapped_halves_share_all_tokens_but_only_half_match():
    assert quick_ratio(SEQUENCES[4], SEQUENCES[5]) == 1.0
    assert ratio(SEQUENCES[4], SEQUENCES[5]) == 0.5


def test_bounds_are_never_below_the_ratio():
    for a, b in itertools.product(SEQUENCES, repeat=2):
        assert real_quick_ratio(len(a), len(b)) >= quick_ratio(a, b) >= ratio(a, b)


def test_ratio_has_a_direction():
    a, b = [3, 1, 3, 1, 2, 2], [3, 1, 2, 1, 3, 1]
    assert (round(ratio(a, b), 4), ratio(b, a)) == (0.6667, 0.5)


def test_matching_runs_have_no_terminator():
    assert matching_blocks([9, 9, 1, 2], [1, 2, 8]) == [(2, 0, 2)]
    assert Matcher([1, 2, 8]).matching_blocks([5]) == []


def test_hash_separates_tokens_and_knows_the_empty_sequence(spark):
    rows = spark.createDataFrame([(["a", "b"],), (["ab"],), ([],)], "t array<string>").select(text.content_hash(F.col("t")).alias("h")).collect()
    expect = [hashlib.sha256(x.encode()).hexdigest()[:32] for x in ("a\x1fb\x1f", "ab\x1f", "")]
    assert [r.h for r in rows] == expect


def test_prose_tokens_keep_their_lines(spark):
    row = spark.createDataFrame([("The cat\n\n12 Äpfel",)], "t string").select(text.prose_tokens(F.col("t")).alias("x"), text.prose_lines(F.col("t")).alias("l")).first()
    assert (row.x, row.l) == (["the", "cat", "NUM", "äpfel"], [1, 1, 3, 3])


@pytest.mark.parametrize(("token", "name"), [("../pkg/mod.py", "pkg/mod"), ("./b", "b"), ("/abs/x.js", "abs/x"), ("pkg.mod", "pkg.mod")])
def test_reference_names(spark, token, name):
    found = spark.createDataFrame([(token,)], "t string").select(text.reference_names(F.col("t"), ["py", "js"]).alias("n")).first().n
    assert found[0] == name and name.replace("/", ".") in found


def test_import_lines_need_the_whole_first_word(spark):
    lines = ["import x", "  from a import b", "require_relative 'x'", "#include <a>", "const a = require('./b')", "importer()", ""]
    rows = spark.createDataFrame([(x,) for x in lines], "t string").select(text.is_import(F.col("t")).alias("i")).collect()
    assert [r.i for r in rows] == [True, True, False, False, True, False, False]


@pytest.mark.parametrize("limits", [(1 << 17, 1 << 20), (50, 300), (1, 1)])  # all at once, in parts, regions one at a time the plain way
def test_matching_of_many_pairs_equals_one_at_a_time(monkeypatch, limits):
    monkeypatch.setattr(matching, "TOKENS", limits[0])
    monkeypatch.setattr(matching, "HITS", limits[1])
    rng = random.Random(limits[0])
    made = [*SEQUENCES, [1, 2, 3, 4] * 20, [rng.randrange(3) for _ in range(90)], [int(rng.paretovariate(0.7)) % 500 for _ in range(250)]]
    for t in made[9:] * 2:
        cut = rng.randrange(len(t))
        made.append([x if rng.random() > 0.15 else rng.randrange(5) for x in t[:cut]] + t[max(0, cut - 5) :])
    bounds, codes = np.append(0, np.cumsum([len(t) for t in made])), np.concatenate(made).astype(np.int64)
    left, right = np.array(list(itertools.product(range(len(made)), repeat=2))).T
    got = {p: [] for p in range(len(left))}
    for _, _, pair, *runs in matching.matched(codes, bounds, left, right):
        for p, *run in zip(pair.tolist(), *(x.tolist() for x in runs), strict=True):
            got[p].append(tuple(run))
    assert got == {p: matching_blocks(made[a], made[b]) for p, (a, b) in enumerate(zip(left, right, strict=True))}
