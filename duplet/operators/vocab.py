"""Vocabulary overlap between files, and who imports whom."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.functions.hashes import SEPARATOR
from duplet.functions.text import REFERENCE, dotted_path, file_stem, is_import, lines, overlap, reference_names
from duplet.operators import planes
from duplet.operators.storage import BATCH_ROWS, map_arrow, stored

SAMPLE = 25
#: Documents of a block, at most about.
DOCUMENTS = 25_000
#: Names of a cell that go by bits, and sets that are counted at once.
COMMON, SETS = 512, 16
#: Sets whose names are put in order at once.
SLICE = 1000
#: One in so many names of a set, and one, must be met among its rarest before it is counted in full.
SPARE = 8


def vocabulary(identifiers: DataFrame, noise: DataFrame | None = None) -> DataFrame:
    """Distinct (path, path_parts, name) without the noise (language, name) of the file's own language."""
    names = identifiers.select("path", "path_parts", "language", "name").distinct()
    if noise is not None:
        names = names.join(noise.select("language", "name").distinct(), ["language", "name"], "left_anti")
    return names.select("path", "path_parts", "name")


def inbound_imports(files: DataFrame, extensions: list[str]) -> DataFrame:
    """(path, inbound): how many other files have an import line with a token that names the file by stem or dotted path."""
    line = files.select("path", F.explode(lines(F.col("text"))).alias("line")).where(is_import(F.col("line")))
    token = line.select(F.col("path").alias("importer"), F.explode(F.regexp_extract_all("line", F.lit(REFERENCE), F.lit(0))).alias("token"))
    named = token.select("importer", F.explode(reference_names(F.col("token"), extensions)).alias("name")).where("name <> ''").distinct()
    targets = files.select("path", F.explode(F.array_distinct(F.array(file_stem(F.col("path")), dotted_path(F.col("path"))))).alias("name")).where("name <> ''")
    counted = named.join(targets, "name").where("importer <> path").groupBy("path").agg(F.countDistinct("importer").alias("inbound"))
    return files.select("path").join(counted, "path", "left").select("path", F.coalesce("inbound", F.lit(0)).alias("inbound"))


class _Index:
    """Some sets of codes, in order of size, to find which of them share enough with others."""

    def __init__(self, flat: np.ndarray, bounds: np.ndarray, bits: np.ndarray, often: int, n_codes: int):
        """flat[bounds[i] : bounds[i + 1]] is a set, its codes rising from the rarest on; bits: of those from the code `often` on, by _bits()."""
        self.count, self.bits, self.often = len(bounds) - 1, bits, often
        self.flat, self.bounds = flat[bounds[0] : bounds[-1]], bounds - bounds[0]
        # where the codes from each of some on begin in each set: the common ones, twice, four times as many and so on, all
        common = max(1, n_codes - often)
        self.steps = np.array([max(0, n_codes - (common << i)) for i in range(math.ceil(n_codes / common).bit_length() + 1)])
        step = np.searchsorted(-self.steps, -np.arange(n_codes))
        of = np.repeat(np.arange(self.count), np.diff(self.bounds))
        held = np.bincount(of * len(self.steps) + step[self.flat], minlength=self.count * len(self.steps)).reshape(self.count, -1)
        self.from_step = (self.bounds[1:, None] - np.cumsum(held, axis=1)).T.copy()
        key = self.flat * np.int64(self.count)
        key += of
        key.sort()
        key %= max(self.count, 1)
        self.of = key.astype(np.int32)
        self.end = np.cumsum(np.bincount(self.flat, minlength=n_codes))
        self.first, self.begun = np.append(0, self.end[:-1])[:n_codes], 0
        self.flag = np.zeros(n_codes, bool)

    def _begin(self, at: int) -> None:
        """Leaves the sets before `at` out of the lists."""
        np.add.at(self.first, self.flat[self.bounds[self.begun] : self.bounds[at]], 1)
        self.begun = at

    def shared(self, sets: list[np.ndarray], bits: np.ndarray, need: np.ndarray, after: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each of a few sets, the sets from after[i] on that share need[i] codes with it, and how many they share. after never falls, from call to call either.

        Of the n - need + s rarest codes of a set, s are in every set that shares `need` with it: lists of those tell which sets are worth the other codes.
        """
        low = min(int(after[0]), self.count)
        self._begin(low)
        width = self.count - low
        n = np.array([len(x) for x in sets])
        spare = np.minimum(need, 1 + n // SPARE)
        kept = n - need + spare
        codes = np.concatenate([x[:k] for x, k in zip(sets, kept.tolist(), strict=True)])
        size = self.end[codes] - self.first[codes]
        ends = np.cumsum(size)
        places = self.of[np.repeat(self.first[codes] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]
        each = np.repeat(np.arange(len(sets)) * width - low, kept)
        met = np.bincount(places + np.repeat(each, size), minlength=len(sets) * width).reshape(len(sets), width)
        for i, mine in enumerate(sets):
            skip = max(int(after[i]) - low, 0)
            found = np.flatnonzero(met[i, skip:] >= spare[i])
            yield self._counted(found + low + skip, met[i, skip:][found], mine[int(kept[i]) :], bits[i], int(need[i]))

    def _counted(self, found: np.ndarray, count: np.ndarray, rest: np.ndarray, bits: np.ndarray, need: int) -> tuple[np.ndarray, np.ndarray]:
        """Those of found that share `need` codes with a set, and how many. count: without those of `rest`, of which the common ones go by bits, the others for the sets that can still have enough."""
        if not len(found) or not len(rest):
            return found[count >= need], count[count >= need]
        middle = rest[: np.searchsorted(rest, self.often)]
        if not len(middle) and rest[0] > self.often:  # common codes ahead of the rest are counted
            word, bit = divmod(int(rest[0]) - self.often, 64)
            bits = bits.copy()
            bits[:word] = 0
            bits[word] &= np.uint64((1 << 64) - (1 << bit))
        count = count + np.bitwise_count(self.bits[:, found] & bits[:, None]).sum(axis=0, dtype=np.int64)
        open_ = count + len(middle) >= need
        found, count = found[open_], count[open_]
        if len(middle) and len(found):
            self.flag[middle] = True
            begin, stop = self.from_step[np.argmax(self.steps <= middle[0])][found], self.from_step[0][found]
            flags = self.flag[np.concatenate([self.flat[a:b] for a, b in zip(begin.tolist(), stop.tolist(), strict=True)])]
            of = np.repeat(np.arange(len(found)), stop - begin)[flags]
            count = count + np.bincount(of, minlength=len(found))
            self.flag[middle] = False
        enough = count >= need
        return found[enough], count[enough]


def _bits(rows: np.ndarray, codes: np.ndarray, count: int, n_codes: int) -> np.ndarray:
    """Words of 64 bits, word by row: those of each row's codes."""
    out = np.zeros((count, 64 * math.ceil(n_codes / 64)), bool)
    out[rows, codes] = True
    return np.ascontiguousarray(np.packbits(out, axis=1, bitorder="little").view(np.uint64).T)


def _keys(docs: DataFrame, n: int) -> DataFrame:
    """(cell, to): for each of n cells a key by which repartition(n) gives it a partition of its own."""
    each = docs.sparkSession.range(20 * n * n).select(F.col("id").alias("to"), F.pmod(F.hash("id"), F.lit(n)).alias("cell"))
    return each.groupBy("cell").agg(F.min("to").alias("to"))


def _meeting(docs: DataFrame, least: float, sample: bool) -> DataFrame:
    """(a, b, shared, n1, n2, common): the pairs of docs (path, path_parts, names, n) whose overlap reaches least > 0, a before b in file order.

    Documents are dealt to blocks; a pair of blocks is compared by an index of one of them, each set with those that come after it
    by size. Where docs have a column `known`, pairs of two known ones are left out.
    """
    count = docs.count()
    blocks = max(1, min(4, math.ceil(count / 500)), math.ceil(count / DOCUMENTS))
    known = F.col("known") if "known" in docs.columns else F.lit(False)
    own = docs.select("path", F.array_join("path_parts", "\x00").alias("key"), F.array_join("names", SEPARATOR).alias("names"), known.alias("known"), F.pmod(F.xxhash64("path"), F.lit(blocks)).cast("int").alias("block"))
    dealt = own.select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("with"))
    dealt = dealt.select(F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "block", "path", "key", "names", "known")

    def cell(t: pa.Table) -> Iterator[pa.RecordBatch]:
        block, path, known = t.column("block").to_numpy(), t.column("path").combine_chunks(), t.column("known").to_numpy()
        lists = pc.split_pattern(t.column("names").cast(pa.large_string()).combine_chunks(), SEPARATOR)
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        size = lists.value_lengths().to_numpy()
        key = np.empty(len(t), np.int64)
        key[pc.sort_indices(t.column("key")).to_numpy()] = np.arange(len(t))
        coded = lists.flatten().dictionary_encode()
        del lists
        words, codes = coded.dictionary, coded.indices.to_numpy()
        del coded
        rarest = np.argsort(np.bincount(codes, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.int32)
        rank[rarest] = np.arange(len(words), dtype=np.int32)
        codes, words = rank[codes], words.take(pa.array(rarest))  # the rarest name is 0
        by_name = np.empty(len(words) if sample else 0, np.int32)
        if sample:
            by_name[pc.sort_indices(words).to_numpy()] = np.arange(len(words), dtype=np.int32)
        # in each block by size, so that a set meets those after it; in each set the rarest first
        order = np.lexsort((key, size, block))
        bounds = np.append(0, np.cumsum(size))
        turn = np.append(0, np.cumsum(size[order]))
        turned = np.empty_like(codes)
        for i in range(0, len(size), SLICE):
            some = order[i : i + SLICE]
            at = np.repeat(bounds[some] - turn[i : i + len(some)], size[some]) + np.arange(turn[i], turn[i + len(some)])
            both = np.repeat(np.arange(len(some)) * len(words), size[some]) + codes[at]
            both.sort()
            turned[turn[i] : turn[i + len(some)]] = both % len(words)
        codes = turned
        block, size, key, known, path, bounds = block[order], size[order], key[order], known[order], path.take(pa.array(order)), turn
        by_size = np.empty(len(size), np.int64)
        by_size[np.lexsort((key, size))] = np.arange(len(size))
        low_common = max(0, len(words) - COMMON)
        often = codes >= low_common
        bits = _bits(np.repeat(np.arange(len(size)), size)[often], codes[often] - low_common, len(size), len(words) - low_common)
        del often

        def first_shared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            both = np.intersect1d(x, y, assume_unique=True)
            return both[np.argsort(by_name[both])[:SAMPLE]]

        def as_batch(rows: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            i, j, n = (np.concatenate(c) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 3
            swap = key[i] > key[j]
            a, b = np.where(swap, j, i), np.where(swap, i, j)
            texts = ([words.take(pa.array(first_shared(codes[bounds[v] : bounds[v + 1]], codes[bounds[w] : bounds[w + 1]]))).to_pylist() for v, w in zip(a.tolist(), b.tolist(), strict=True)]) if sample else [[]] * len(a)
            return pa.RecordBatch.from_arrays([path.take(pa.array(a)), path.take(pa.array(b)), *(pa.array(c.astype(np.int64)) for c in (n, size[a], size[b])), pa.array(texts, pa.list_(pa.string()))], ["a", "b", "shared", "n1", "n2", "common"])

        sides = [(int(np.searchsorted(block, x)), int(np.searchsorted(block, x, "right"))) for x in np.unique(block)]
        low, high = t.column("low")[0].as_py(), t.column("high")[0].as_py()
        for x, y in ((0, 0),) if low == high else ((0, 1), (1, 0)) if len(sides) == 2 else ():
            begin, end = sides[y]
            index = _Index(codes, bounds[begin : end + 1], bits[:, begin:end], low_common, len(words))
            after = np.searchsorted(by_size[begin:end], by_size[slice(*sides[x])], "right")
            out: list[tuple[np.ndarray, ...]] = []
            held = 0
            for i in range(sides[x][0], sides[x][1], SETS):
                some = np.arange(i, min(i + SETS, sides[x][1]))
                need = np.maximum(1, np.ceil(least * size[some] - 1e-9).astype(np.int64))
                for i, (j, n) in zip(some, index.shared([codes[bounds[v] : bounds[v + 1]] for v in some], bits[:, some].T, need, after[some - sides[x][0]]), strict=True):
                    j = j + begin
                    if known[i]:
                        j, n = j[~known[j]], n[~known[j]]
                    if len(j):
                        out.append((np.full(len(j), i), j, n))
                        held += len(j)
                if held >= BATCH_ROWS:
                    yield as_batch(out)
                    out, held = [], 0
            yield as_batch(out)

    def run(batches):
        held: list[pa.RecordBatch] = []
        name = None
        for batch in batches:
            at = 0
            for cell_name, group in groupby(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
                n = len(list(group))
                if cell_name != name and held:
                    yield from cell(pa.Table.from_batches(held))
                    held = []
                name = cell_name
                held.append(batch.slice(at, n))
                at += n
        if held:
            yield from cell(pa.Table.from_batches(held))

    at_once = lambda some, n: map_arrow(some.join(F.broadcast(_keys(docs, n)), F.col("nth") == F.col("cell")).drop("nth", "cell").repartition(n, "to").sortWithinPartitions("low", "high", "block").drop("to"), run, "a string, b string, shared long, n1 long, n2 long, common array<string>")
    if blocks <= 4:
        return stored(at_once(dealt.withColumn("nth", F.expr("high * (high + 1) div 2 + low")), blocks * (blocks + 1) // 2), "met")
    # one block with the others after it at a time, so that shuffle files of all cells never lie side by side
    return reduce(DataFrame.union, [stored(at_once(dealt.where(F.col("low") == i).withColumn("nth", F.col("high") - i), blocks - i), "met") for i in range(blocks)])


def find_vocab_pairs(vocab: DataFrame, inbound: DataFrame | None = None, min_overlap: float = 0.55, min_vocabulary: int = 30) -> DataFrame:
    """overlapping() of the vocabularies (path, path_parts, name), names distinct."""
    return overlapping(vocab.groupBy("path", "path_parts").agg(F.collect_list("name").alias("names")), inbound, min_overlap, min_vocabulary)


def overlapping(docs: DataFrame, inbound: DataFrame | None = None, min_overlap: float = 0.55, min_vocabulary: int = 30, sample: bool = True, joined: str | None = None) -> DataFrame:
    """Pairs of files (path, path_parts, names) whose vocabularies overlap: shared / size of the smaller >= min_overlap, both sizes >= min_vocabulary.

    min_overlap = 0 asks for every pair and gets all. Where docs have a column `known`, pairs of two known ones are left out. sample: whether sample_shared is wanted; else it is empty.
    joined: sample_shared is one text, joined by this, and the caller reads the frame once.
    """
    docs = docs.withColumn("n", F.size("names").cast("long")).where((F.col("n") >= min_vocabulary) & (F.col("n") > 0))
    known = F.col("known") if "known" in docs.columns else F.lit(False)
    if min_overlap > 0 and sample:
        counted = planes.meeting(docs.withColumn("known", known), min_overlap, SAMPLE, joined, once=joined is not None)
    elif min_overlap > 0:
        counted = _meeting(stored(docs, "names"), min_overlap, sample)
    else:
        docs = stored(docs, "names")
        x, y = (docs.select(F.col("path").alias(s), F.col("path_parts").alias(f"p{i}"), F.col("names").alias(f"s{i}"), F.col("n").alias(f"n{i}"), known.alias(f"k{i}")) for i, s in ((1, "a"), (2, "b")))
        both = x.join(y, (F.col("p1") < F.col("p2")) & ~(F.col("k1") & F.col("k2"))).withColumn("common", F.array_sort(F.array_intersect("s1", "s2")))
        common = F.slice("common", 1, SAMPLE)
        counted = both.select("a", "b", F.size("common").cast("long").alias("shared"), "n1", "n2", (common if joined is None else F.array_join(common, joined)).alias("common"))
    found = counted.select("a", "b", overlap(F.col("shared"), F.col("n1"), F.col("n2")).alias("overlap"), "shared", F.col("n1").alias("a_vocabulary"), F.col("n2").alias("b_vocabulary"), F.col("common").alias("sample_shared")).where(F.col("overlap") >= min_overlap)
    if inbound is None:
        found = found.withColumn("a_inbound_imports", F.lit(0).cast("long")).withColumn("b_inbound_imports", F.lit(0).cast("long"))
    else:
        for s in "ab":
            found = found.join(inbound.select(F.col("path").alias(s), F.col("inbound").cast("long").alias(f"{s}_inbound_imports")), s)
    found = found.withColumn("zero_inbound", (F.col("a_inbound_imports") == 0) | (F.col("b_inbound_imports") == 0))
    return found.select("a", "b", "overlap", "shared", "a_vocabulary", "b_vocabulary", "a_inbound_imports", "b_inbound_imports", "zero_inbound", "sample_shared")


def detector_order(pairs: DataFrame) -> DataFrame:
    """As the detector ranks: pairs with an unreferenced side first."""
    return pairs.orderBy(F.col("zero_inbound").desc(), F.col("overlap").desc(), F.least("a", "b"), F.greatest("a", "b"))


def in_order(pairs: DataFrame) -> DataFrame:
    """As reports list: by overlap, then key."""
    return pairs.orderBy(F.col("overlap").desc(), F.least("a", "b"), F.greatest("a", "b"))
