"""Which sets of names overlap, and the first names that they share: a set meets the larger ones by bit maps, 64 at once.

Sets travel in packs, coded by a dictionary of their own. A task holds some packs as rows of bits, a row for each common name
with a bit for each set, and adds up the rows of another set's names in binary, bit by bit of the counts. Rare names go by lists.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duplet.operators.storage import BATCH_ROWS, map_arrow, stored

#: Names, with repeats, of a pack and of the packs that a task holds as bits, at most about; packs that meet those together.
PACK, HELD, TOGETHER = 1 << 20, 6 << 20, 4
#: Names that have a row of bits, at most, and one in so many sets that must have such a name.
ROWS, SELDOM = 1 << 14, 400
#: Words of 64 bits of a slab's row; names, and sets, whose rows are added up at once.
WORDS, ADDED, SETS = 32, 9600, 128
#: Rare names that a pair may share without being looked at by itself; one in so many needed names must be met beside the common ones.
RARE, SPARE = 4, 4
#: Pairs of a set that are looked up at once.
AT_ONCE = 1024
#: Names, in order, among which the first shared ones are sought before all of a set's are.
AHEAD = 64
#: Tasks of a job.
TASKS = 100

_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _one(data: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(data).read_next_batch()


def _pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    lists = t.column("names").combine_chunks()
    size = lists.value_lengths().to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    order = pc.sort_indices(coded.dictionary)
    words = coded.dictionary.take(order)
    rank = np.empty(len(words), np.int64)
    rank[order.to_numpy()] = np.arange(len(words))
    codes = np.repeat(np.arange(len(size)) * len(words), size) + rank[coded.indices.to_numpy()]
    codes.sort()  # in each set by name
    codes %= max(1, len(words))
    sets = pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in ("path", "key", "known")), pa.array(size.astype(np.int32))], ["path", "key", "known", "size"])
    steps = pa.RecordBatch.from_arrays([pa.array(np.diff(codes, prepend=0).astype(np.int32))], ["step"])
    parts = [sets, pa.RecordBatch.from_arrays([words], ["word"]), steps]
    return pa.RecordBatch.from_arrays([pa.array([len(size)]), pa.array([len(codes)]), *(pa.array([_ipc(p)], pa.binary()) for p in parts)], ["sets", "names", "heads", "words", "steps"])


def packs(docs: DataFrame) -> DataFrame:
    """(sets, names: how many; heads, words, steps) of docs (path, path_parts, names, known), names distinct: some sets in each row, as stored."""

    def run(batches):
        held, names = [], 0
        for batch in batches:
            held.append(batch)
            names += len(batch.column(2).flatten())
            if names >= PACK:
                yield _pack(held)
                held, names = [], 0
        if held:
            yield _pack(held)

    own = docs.select("path", F.array_join("path_parts", "\x00").alias("key"), "names", "known")
    return stored(map_arrow(own, run, "sets long, names long, heads binary, words binary, steps binary"), "packs", rows=1)


def added(rows: np.ndarray) -> list[np.ndarray]:
    """The bits of how many rows have each bit, the lowest first. Overwrites rows, words of 64 bits."""
    n, width = rows.shape
    now, then, some, out = rows, np.empty((n // 2 + 1, width), np.uint64), np.empty((n // 3 + 1, width), np.uint64), []
    while True:
        carried = 0
        while n >= 3:
            k = n // 3
            a, b, c, u, d = now[:k], now[k : 2 * k], now[2 * k : 3 * k], some[:k], then[carried : carried + k]
            np.bitwise_xor(a, b, out=u)
            np.bitwise_and(a, b, out=d)
            np.bitwise_xor(u, c, out=a)
            np.bitwise_and(u, c, out=u)
            np.bitwise_or(d, u, out=d)
            if n > 3 * k:
                now[k : n - 2 * k] = now[3 * k : n]
            n, carried = n - 2 * k, carried + k
        if n == 2:
            np.bitwise_and(now[0], now[1], out=then[carried])
            np.bitwise_xor(now[0], now[1], out=now[0])
            carried += 1
        if n:
            out.append(now[0].copy())
        if not carried:
            return out
        now, then, n = then, now, carried


def _reached(planes: list[np.ndarray], least: np.ndarray) -> np.ndarray:
    """Bits of the counts in planes, each sets by words, that are least[set] or more."""
    more, same = np.zeros_like(planes[0]), np.full_like(planes[0], _FULL)
    for j in range(len(planes) - 1, -1, -1):
        asked = np.where(least >> j & 1, _FULL, np.uint64(0))[:, None]
        more |= same & planes[j] & ~asked
        same &= ~(planes[j] ^ asked)
    return np.where((least >> len(planes) > 0)[:, None], np.uint64(0), more | same)


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first[i], first[i] + 1 and so on, size[i] of them, for each i."""
    ends = np.cumsum(size)
    return np.repeat(first - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)


class _Sets:
    """The sets of a pack, in order of size and file."""

    def __init__(self, heads: bytes, steps: bytes, code_of: np.ndarray):
        """code_of: of each of the pack's words, -1 for none; names without a code are left out."""
        t = _one(heads)
        size, key = t.column("size").to_numpy().astype(np.int64), t.column("key").to_pylist()
        order = np.array(sorted(range(len(size)), key=lambda i: (size[i], key[i])), np.int64)
        codes = code_of[np.cumsum(_one(steps).column(0).to_numpy())]
        bounds = np.append(0, np.cumsum(size))
        codes, turned = codes[_spans(bounds[order], size[order])], np.append(0, np.cumsum(size[order]))
        kept = codes >= 0
        self.codes, self.bounds = codes[kept], np.append(0, np.cumsum(kept))[turned]
        self.size, self.key, self.path, self.known = size[order], [key[i] for i in order], t.column("path").take(pa.array(order)), t.column("known").to_numpy(zero_copy_only=False)[order]


class _Held:
    """Some sets as rows of bits."""

    def __init__(self, rows: list[dict]):
        """rows: of packs()."""
        words = [_one(r.pop("words")).column(0) for r in rows]
        coded = pa.concat_arrays(words).dictionary_encode()
        self.words, code_of = coded.dictionary, np.split(coded.indices.to_numpy(), np.cumsum([len(w) for w in words])[:-1])
        del coded, words
        parts = [_Sets(r.pop("heads"), r.pop("steps"), c) for r, c in zip(rows, code_of, strict=True)]
        size, key = np.concatenate([p.size for p in parts]), [k for p in parts for k in p.key]
        order = np.array(sorted(range(len(size)), key=lambda i: (size[i], key[i])), np.int64)
        self.count, self.size, self.places = len(order), size[order], [(int(size[i]), key[i]) for i in order]
        self.path = pa.concat_arrays([p.path for p in parts]).take(pa.array(order))
        self.known = np.concatenate([p.known for p in parts])[order]
        self.keys = sorted(key)
        rank = {k: i for i, k in enumerate(self.keys)}
        self.rank = np.array([rank[key[i]] for i in order], np.int64)
        flat = np.concatenate([p.codes for p in parts])
        first = np.append(0, np.cumsum(np.concatenate([np.diff(p.bounds) for p in parts])))
        del parts
        often = np.bincount(flat, minlength=len(self.words))
        common = np.argsort(-often, kind="stable")[:ROWS]
        common = common[often[common] >= max(2, self.count / SELDOM)]
        self.row = np.full(len(self.words), -1, np.int32)
        self.row[common] = np.arange(len(common), dtype=np.int32)
        self.rows = len(common)  # one more is empty
        self.slabs = np.zeros((math.ceil(self.count / (64 * WORDS)), self.rows + 1, WORDS), np.uint64)
        rare_code, rare_of, step = [], [], 32 * WORDS  # half a slab
        for at in range(0, self.count, step):
            some = order[at : at + step]
            n = first[some + 1] - first[some]
            codes, of = flat[_spans(first[some], n)], np.repeat(np.arange(len(some)), n)
            row = self.row[codes]
            seldom = row < 0
            rare_code.append(codes[seldom])
            rare_of.append((of[seldom] + at).astype(np.int32))
            bits = np.zeros((self.rows + 1, step), bool)
            bits[row[~seldom], of[~seldom]] = True
            slab, word = divmod(at // 64, WORDS)
            self.slabs[slab, :, word : word + step // 64] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
        del flat
        self.seldom = sum(np.bincount(c, minlength=len(self.words)) for c in rare_code)
        by_code = np.concatenate([c * np.int64(self.count) + of for c, of in zip(rare_code, rare_of, strict=True)])
        del rare_code, rare_of
        by_code.sort()
        by_code %= max(1, self.count)
        self.of = by_code.astype(np.int32)
        self.first = np.cumsum(self.seldom) - self.seldom
        self.bits = self.slabs.reshape(-1)
        pa.default_memory_pool().release_unused()

    def has(self, rows: np.ndarray, sets: np.ndarray) -> np.ndarray:
        """Whether each of some sets has the name of each row, set by row, as 0 and 1. A row of -1 is empty."""
        base = sets // (64 * WORDS) * ((self.rows + 1) * WORDS) + sets % (64 * WORDS) // 64
        line = np.where(rows < 0, self.rows, rows).astype(np.int64) * WORDS
        return self.bits[base[:, None] + line] >> (sets % 64).astype(np.uint64)[:, None] & np.uint64(1)

    def meeting(self, sets: list[tuple[np.ndarray, int, int]]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]]:
        """For each (codes, need, after) of some sets: its number, the held sets from `after` on that share `need` names with it, how many, its names' rows, and which held sets have which names without a row.

        Whoever shares `need` names with a set shares need - e without its e most common ones: those are looked up only for who does.
        """
        rows = [self.row[codes] for codes, _, _ in sets]
        need, after = np.array([n for _, n, _ in sets]), np.array([a for _, _, a in sets])
        held = [np.sort(r[r >= 0]) for r in rows]
        skipped = np.minimum(need - np.minimum(need, RARE + 1 + need // SPARE), [len(h) for h in held])
        asked = need - skipped
        idx = np.full((max((len(h) - e for h, e in zip(held, skipped.tolist(), strict=True)), default=0), len(sets)), self.rows)
        for k, (h, e) in enumerate(zip(held, skipped.tolist(), strict=True)):
            idx[: len(h) - e, k] = h[e:]
        # names without a row, of all the sets at once
        at = [np.flatnonzero(r < 0) for r in rows]
        codes = np.concatenate([c[x] for (c, _, _), x in zip(sets, at, strict=True)])
        n = self.seldom[codes]
        of = self.of[_spans(self.first[codes], n)]
        by, place = np.repeat(np.repeat(np.arange(len(sets)), [len(x) for x in at]), n), np.repeat(np.concatenate(at), n)
        late = of >= after[by]
        of, by, place = of[late], by[late], place[late]
        key, n = np.unique(by * self.count + of, return_counts=True)
        most = np.zeros(len(sets), np.int64)
        np.maximum.at(most, key // self.count, n)
        low = np.maximum(0, asked - np.minimum(RARE, most))
        special, s_of = key[n > RARE] // self.count, key[n > RARE] % self.count
        found = []
        for slab in range(int(after.min()) // (64 * WORDS), len(self.slabs)):
            took = np.take(self.slabs[slab], idx, axis=0, mode="clip").reshape(len(idx), len(sets) * WORDS)
            planes = [p.reshape(len(sets), WORDS) for p in added(took)] or [np.zeros((len(sets), WORDS), np.uint64)]
            reached = _reached(planes, low)
            here = s_of // (64 * WORDS) == slab
            bit = s_of[here] % (64 * WORDS)
            np.bitwise_or.at(reached, (special[here], bit // 64), np.uint64(1) << (bit % 64).astype(np.uint64))
            k, word = np.nonzero(reached)
            if not len(k):
                continue
            each, bit = np.nonzero(np.unpackbits(reached[k, word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            k, word = k[each], word[each]
            whose = (slab * WORDS + word) * 64 + bit
            late = (whose >= after[k]) & (whose < self.count)
            k, word, bit, whose = k[late], word[late], bit[late].astype(np.uint64), whose[late]
            found.append((k * self.count + whose, sum((p[k, word] >> bit & np.uint64(1)).astype(np.int64) << j for j, p in enumerate(planes))))
        if not found:
            return
        both, count = (np.concatenate(x) for x in zip(*found, strict=True))
        if len(key):
            x = np.minimum(np.searchsorted(key, both), len(key) - 1)
            count += np.where(key[x] == both, n[x], 0)
        enough = count >= asked[both // self.count]
        both, count = both[enough], count[enough]
        order = np.argsort(both)
        both, count = both[order], count[order]
        ends, rare = np.searchsorted(both, np.arange(len(sets) + 1) * self.count), np.searchsorted(by, np.arange(len(sets) + 1))
        for k in range(len(sets)):
            for i in range(int(ends[k]), int(ends[k + 1]), AT_ONCE):
                part = slice(i, min(i + AT_ONCE, int(ends[k + 1])))
                mine, shared = both[part] - k * self.count, count[part]
                if skipped[k]:
                    shared = shared + self.has(held[k][: skipped[k]], mine).sum(axis=1, dtype=np.int64)
                    mine, shared = mine[shared >= need[k]], shared[shared >= need[k]]
                if len(mine):
                    yield k, mine, shared, rows[k], (of[rare[k] : rare[k + 1]], place[rare[k] : rare[k + 1]])

    def first_shared(self, rows: np.ndarray, rare: tuple[np.ndarray, np.ndarray], found: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The places of the first `most` names, by their rows, that found sets have, list by list, the length of each list, and the list of each found set."""
        at = np.minimum(np.searchsorted(found, rare[0]), len(found) - 1)
        hit = found[at] == rare[0]
        place, at = rare[1][hit], at[hit]
        places, lengths, of, lists = [], [], np.empty(len(found), np.int64), 0
        todo = np.arange(len(found))
        for upto in (AHEAD, len(rows)) if len(rows) > AHEAD else (len(rows),):
            has = np.zeros((len(todo), max(upto, AHEAD)), np.uint8)
            has[:, :upto] = self.has(rows[:upto], found[todo])
            back = np.full(len(found), -1)
            back[todo] = np.arange(len(todo))
            in_it = (place < upto) & (back[at] >= 0)
            has[back[at[in_it]], place[in_it]] = 1
            count = np.cumsum(has, axis=1, dtype=np.int32)
            done = (count[:, -1] >= most) | (upto == len(rows))
            has &= count <= most
            some = has[done]
            if len(some):
                bits = np.packbits(some, axis=1)
                _, one, each = np.unique(bits.view(np.uint64).ravel() if bits.shape[1] == 8 else bits.view(f"V{bits.shape[1]}").ravel(), return_index=True, return_inverse=True)
                places.append(np.nonzero(some[one])[1])
                lengths.append(some[one].sum(axis=1, dtype=np.int64))
                of[todo[done]] = lists + each
                lists += len(one)
            todo = todo[~done]
            if not len(todo):
                break
        return np.concatenate(places), np.concatenate(lengths), of


def _cell(y: _Held, others: list[dict], least: float, most: int, joined: str | None) -> Iterator[pa.RecordBatch]:
    """(a, b, shared, n1, n2, common) of the sets of `others` with the held ones after them by size and file."""
    words = [_one(r.pop("words")).column(0) for r in others]
    found = pc.index_in(pa.concat_arrays(words), value_set=y.words).fill_null(-1).to_numpy()
    code_of = np.split(found, np.cumsum([len(w) for w in words])[:-1])
    del words

    def as_batch(out: list[tuple], x: _Sets) -> pa.RecordBatch:
        i, j, shared, first = (np.concatenate([o[c] for o in out]) for c in range(4))
        a, b, m = x.path.take(pa.array(i)), y.path.take(pa.array(j)), np.array([x.size[i], y.size[j]])
        other = pa.array(~first)
        a, b = pc.if_else(other, b, a), pc.if_else(other, a, b)
        n1, n2 = np.where(first, m, m[::-1])
        ends = np.cumsum(np.concatenate([np.zeros(1, np.int64), *(o[5] for o in out)]))
        each = np.concatenate([o[6] + n for o, n in zip(out, np.cumsum([0, *(len(o[5]) for o in out[:-1])]), strict=True)])
        lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), y.words.take(pa.array(np.concatenate([o[4] for o in out]))))
        common = (lists if joined is None else pc.binary_join(lists, joined)).take(pa.array(each))
        return pa.RecordBatch.from_arrays([a, b, *(pa.array(c.astype(np.int64)) for c in (shared, n1, n2)), common], ["a", "b", "shared", "n1", "n2", "common"])

    others, code_of = others[::-1], code_of[::-1]
    while others:
        r = others.pop()
        x = _Sets(r["heads"], r["steps"], code_of.pop())
        need = np.maximum(1, np.ceil(least * x.size - 1e-9).astype(np.int64))
        after = [bisect_right(y.places, (int(n), k)) for n, k in zip(x.size, x.key, strict=True)]
        has = np.diff(x.bounds)
        asked = [i for i in range(len(x.size)) if after[i] < y.count and has[i] >= need[i]]
        out: list[tuple] = []
        held_rows = at = 0
        while at < len(asked):
            some = asked[at : at + max(1, min(SETS, ADDED // int(has[asked[at]] + 1)))]
            at += len(some)
            names = [x.codes[x.bounds[i] : x.bounds[i + 1]] for i in some]
            for k, found, shared, rows, rare in y.meeting([(c, int(need[i]), after[i]) for c, i in zip(names, some, strict=True)]):
                i = some[k]
                if x.known[i]:
                    new = ~y.known[found]
                    found, shared = found[new], shared[new]
                    if not len(found):
                        continue
                places, lengths, each = y.first_shared(rows, rare, found, most) if most else (np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(len(found), np.int64))
                out.append((np.full(len(found), i), found, shared, y.rank[found] >= bisect_right(y.keys, x.key[i]), names[k][places], lengths, each))
                held_rows += len(found)
                if held_rows >= 8 * BATCH_ROWS:
                    yield as_batch(out, x)
                    out, held_rows = [], 0
        if out:
            yield as_batch(out, x)


def meeting(docs: DataFrame, least: float, most: int, joined: str | None = None, once: bool = False) -> DataFrame:
    """(a, b, shared, n1, n2, common): the pairs of docs (path, path_parts, names, known) whose overlap reaches least > 0, a before b in file order.

    common: the first `most` names that both have, in order, or those joined. Pairs of two known ones are left out. once: the
    frame is read once, so that it need not be stored.
    """
    table = packs(docs)
    spark = table.sparkSession
    sizes = [(unquote(r.file_path), r.names) for r in table.select("names", "_metadata.file_path").collect()]
    fields = f"a string, b string, shared long, n1 long, n2 long, common {'array<string>' if joined is None else 'string'}"
    if not sizes:
        return spark.createDataFrame([], fields)
    total, cores = sum(n for _, n in sizes), spark.sparkContext.defaultParallelism
    apart = max(1, min(cores, len(sizes)), math.ceil(total / HELD))
    parts = min(len(sizes), math.ceil(3 * cores / apart))

    def dealt(n: int) -> list[list[str]]:
        """The packs' files in n groups of about as many names."""
        groups: list[tuple[int, list[str]]] = [(0, []) for _ in range(n)]
        for f, names in sorted(sizes, key=lambda s: (-s[1], s[0])):
            i = min(range(n), key=lambda g: groups[g][0])
            groups[i] = groups[i][0] + names, [*groups[i][1], f]
        return [g for _, g in groups if g]

    def run(batches):
        y, held, others = None, [], []
        for batch in batches:
            for r in batch.to_pylist():
                first = r.pop("first")
                (held if first else others).append(r)
                if first and first == len(held):
                    y, held = _Held(held), []
                if y is not None and len(others) >= TOGETHER:
                    yield from _cell(y, others, least, most, joined)
                    others = []
        if others:
            yield from _cell(y, others, least, most, joined)

    read = lambda files, first: spark.read.schema(table.schema).parquet(*files).select("heads", "words", "steps", F.lit(first).alias("first"))
    tasks = [(h, m) for h in dealt(apart) for m in dealt(parts)]
    # a task reads its packs by itself, without a shuffle; a union of single partitions alone would be a single partition
    nothing = spark.range(0, 0, 1, 2).select(*(F.lit(b"").alias(c) for c in ("heads", "words", "steps")), F.lit(0).alias("first"))
    jobs = [reduce(DataFrame.union, [read(h, len(h)).union(read(m, 0)).coalesce(1) for h, m in tasks[i : i + TASKS]], nothing) for i in range(0, len(tasks), TASKS)]
    found = [map_arrow(j, run, fields) for j in jobs]
    return found[0] if once and len(found) == 1 else reduce(DataFrame.union, [stored(f, "met") for f in found])
