"""SentencePiece segmentations by Gumbel top-k without replacement: a perturbed A* search over each text's lattice.

Every complete segmentation has the probability of its pieces, normalized over the lattice. The search holds disjoint
sets of segmentations, each with the largest perturbed log probability (log probability plus Gumbel noise) of its members:
that bound is exact, since the maximum over a set is Gumbel at the log of the set's mass, truncated at what its parent
had. The best set is split: its best member is drawn piece by piece, forward along edges weighed by what the backward
pass says of their ends, and all siblings along it become new sets. So the members come out in falling order of
perturbed log probability, all distinct: a sample without replacement. Noise comes from hashes of the row key.

Pieces never cross the start of a run of spaces, nor a line feed, so a lattice is a chain of those of its units; all
units of a chunk get theirs in one numpy pass, equal ones once.
"""

from __future__ import annotations

import heapq
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from duplet.llm.common import map_arrow, mix, run_hashes, text_chunks

_U = np.uint64
_BASE = 0x9FB21C651E98DF25
DEFAULT_MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE, LINE = 32, 10
#: Bytes of texts that one step works on, and nodes of lattices that stay between steps.
CHUNK = 1 << 18
NODES = 1 << 19


def _uniform(key: np.ndarray) -> np.ndarray:
    """In (0, 1)."""
    return ((mix(key) >> _U(12)).astype(np.float64) + 0.5) * 2.0**-52


class Pieces:
    """A model's pieces as bytes, with spaces for their mark, and a log probability for each.

    Models of the merge kind carry ranks, not probabilities: then the r-th piece weighs 1 / (r + offset) (Zipf's law),
    to the power 1 / temperature. Models of the unigram kind carry log probabilities, which are divided by the temperature.
    """

    def __init__(self, model_file: str, temperature: float = 1.0, offset: int = 10):
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = p.get_piece_size()
        names = [p.id_to_piece(i) for i in range(n)]
        plain = [i for i in range(n) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]
        for i in plain:
            body = names[i].lstrip("▁")
            if "▁" in body or "\n" in names[i]:
                raise ValueError(f"piece {names[i]!r} crosses a unit's bounds")
        raw = np.array([p.get_score(i) for i in range(n)])
        merges = all(float(raw[i]).is_integer() for i in plain[:1000])
        logp = np.full(n, -math.log(n + offset) - 2.0)
        if merges:
            order = sorted(plain, key=lambda i: -raw[i])
            logp[order] = -np.log(np.arange(len(order)) + offset)
        else:
            logp[plain] = raw[plain]
            logp[[i for i in range(n) if p.is_byte(i)]] = raw[plain].min() - 2.0
        self.logp = logp / temperature
        self.bytes = [b""] * n
        for i in plain:
            self.bytes[i] = names[i].replace("▁", " ").encode()
        self.byte_id = np.full(256, -1)
        for i in range(n):
            if p.is_byte(i):
                value = int(names[i][3:-1], 16)
                self.byte_id[value] = i
                self.bytes[i] = bytes([value])
        if (self.byte_id < 0).any():
            raise ValueError("the model has no pieces for bytes: texts could not be kept whole")
        self.size = np.array([len(b) for b in self.bytes])
        self.blob = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.at = np.cumsum(self.size) - self.size
        self._grow(np.array(plain))

    def _grow(self, plain: np.ndarray) -> None:
        """The trie of the pieces: state 0 is its root, a step is keyed by 256 * state + byte in an open hash table, and whole holds the piece that a state spells, or -1."""
        size, at = self.size[plain], self.at[plain]
        self.longest = int(size.max())
        state, count = np.zeros(len(plain), np.int64), 1
        keys, ends = [], {}
        for x in range(self.longest):
            on = np.flatnonzero(size > x)
            steps, where = np.unique(state[on] * 256 + self.blob[at[on] + x], return_inverse=True)
            state[on] = count + where
            keys.append(steps)
            done = on[size[on] == x + 1]
            ends |= dict(zip(state[done].tolist(), plain[done].tolist(), strict=True))
            count += len(steps)
        keys = np.concatenate(keys)
        self.whole = np.full(count, -1, np.int32)
        self.whole[list(ends)] = list(ends.values())
        self.bits = 64 - int(np.ceil(np.log2(count))) - 2
        self.slots, self.next = np.full((1 << (64 - self.bits)) + 64, -1, np.int32), np.zeros((1 << (64 - self.bits)) + 64, np.int32)
        left = np.arange(len(keys))
        slot = self._slot(keys)
        while len(left):
            free = left[self.slots[slot[left]] < 0]
            _, first = np.unique(slot[free], return_index=True)
            put = free[first]
            self.slots[slot[put]], self.next[slot[put]] = keys[put], put + 1
            left = left[self.slots[slot[left]] != keys[left]]
            slot[left] += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(_U) * _U(0x9E3779B97F4A7C15)) >> _U(self.bits)).astype(np.int64)

    def step(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The state after one more byte, or -1 where no piece goes on so."""
        keys = state.astype(np.int64) * 256 + byte
        slot = self._slot(keys)
        held = self.slots[slot]
        out = np.where(held == keys, self.next[slot], -1)
        go = np.flatnonzero((held != keys) & (held >= 0))
        while len(go):
            slot[go] += 1
            held = self.slots[slot[go]]
            hit = held == keys[go]
            out[go[hit]] = self.next[slot[go[hit]]]
            go = go[~hit & (held >= 0)]
        return out


@lru_cache(4)
def pieces(model_file: str, temperature: float) -> Pieces:
    return Pieces(model_file, temperature)


def _spelt(text: np.ndarray, stop: np.ndarray, p: Pieces) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """By number of bytes: the nodes (node i stands before byte i, its unit ends at stop[i]) from which a piece goes, and the pieces."""
    live, state = np.arange(len(text)), np.zeros(len(text), np.int32)
    source, piece = [], []
    for x in range(1, p.longest + 1):
        state = p.step(state, text[live + (x - 1)])
        on = np.flatnonzero(state >= 0)
        live, state = live[on], state[on]
        if not len(live):
            break
        ids = p.whole[state]
        whole = np.flatnonzero(ids >= 0)
        source.append(live[whole])
        piece.append(ids[whole])
        on = np.flatnonzero(live + x < stop[live])
        live, state = live[on], state[on]
    return source, piece


def _lattices(text: np.ndarray, size: np.ndarray, p: Pieces) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """Of units of `size` bytes laid end to end in text: where each node's edges begin, and the edges."""
    n = len(text)
    first = np.cumsum(size) - size
    stop = np.repeat(first + size, size)
    source, piece = _spelt(text, stop, p)
    # a character that is no piece goes as bytes
    begins = np.flatnonzero((text & 0xC0) != 0x80)
    char_end = np.full(n, -1)
    char_end[begins] = np.append(begins[1:], n)
    known = np.zeros(n, bool)
    for x, s in enumerate(source[:4], 1):
        known[s[s + x == char_end[s]]] = True
    loose = np.flatnonzero(~known[np.maximum.accumulate(np.where(char_end >= 0, np.arange(n), 0))])
    # a node's edges lie in a row: the longest first, as it often is the likeliest, a byte last
    source.insert(0, loose)
    piece.insert(0, p.byte_id[text[loose]])
    fill = np.zeros(n, np.int64)
    for s in source:
        fill[s] += 1
    edge0 = np.concatenate([[0], np.cumsum(fill)])
    fill = edge0[:-1].copy()
    of, what = np.zeros(edge0[-1], np.int64), np.zeros(edge0[-1], np.int32)
    for s, ids in zip(source[::-1], piece[::-1], strict=True):
        at = fill[s]
        of[at], what[at] = s, ids
        fill[s] += 1
    to = of + p.size[what]
    weight = p.logp[what]
    last = to == stop[of]
    rest = stop - np.arange(n)  # bytes from a node to its unit's end
    widest = int(size.max(initial=0))
    by = np.argsort(rest.astype(np.uint16) if widest < 1 << 16 else rest, kind="stable")
    cut = np.concatenate([[0], np.cumsum(np.bincount(rest, minlength=widest + 1)[1:])])
    degree = np.diff(edge0)
    beyond = np.zeros(n + 1)  # log mass from a node to its unit's end
    for d in range(1, widest + 1):
        nodes = by[cut[d - 1] : cut[d]]
        nodes = nodes[degree[nodes] > 0]  # no piece begins within a character
        if not len(nodes):
            continue
        count = degree[nodes]
        lead = np.cumsum(count) - count
        e = np.repeat(edge0[nodes] - lead, count) + np.arange(lead[-1] + count[-1])
        v = weight[e] + np.where(last[e], 0.0, beyond[to[e]])
        top = np.maximum.reduceat(v, lead)
        beyond[nodes] = top + np.log(np.add.reduceat(np.exp(v - np.repeat(top, count)), lead))
    logp = np.minimum(weight + np.where(last, 0.0, beyond[to]) - beyond[of], 0.0)
    share = np.exp(logp)
    total = np.cumsum(share)
    upto = total - np.repeat(np.append(total - share, 0.0)[edge0[:-1]], degree)
    upto[edge0[1:] - 1] = 2.0
    return edge0, {"to": to.astype(np.int32), "piece": what, "last": last, "logp": logp, "upto": upto}


class Lattices:
    """The lattices of distinct units, end to end: node i stands before a byte, its edges are edge0[i] to edge0[i + 1].

    Units come by hash and stay for later texts. What is held is bounded: beyond NODES nodes, those that came up often since
    the last time stay, up to half of that.
    """

    EDGES = {"to": np.int32, "piece": np.int32, "last": bool, "logp": np.float64, "upto": np.float64}

    def __init__(self, p: Pieces):
        self.p = p
        self.hash, self.unit = np.zeros(0, _U), np.zeros(0, np.int64)  # hashes in order, and their units
        self.size = self.first = self.hits = np.zeros(0, np.int64)  # of units: bytes, first node, times met
        self.edge0 = np.empty(NODES + (NODES >> 1), np.int64)
        self.edge0[0] = self.nodes = self.edges = 0
        for k, kind in self.EDGES.items():
            setattr(self, k, np.empty(3 * NODES, kind))

    def _append(self, size: np.ndarray, edge0: np.ndarray, edges: dict[str, np.ndarray]) -> None:
        self.first = np.concatenate([self.first, self.nodes + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        nodes, count = self.nodes + len(edge0) - 1, self.edges + len(edges["to"])
        self.edge0 = _with_room(self.edge0, self.nodes + 1, nodes + 1)
        self.edge0[self.nodes : nodes + 1] = edge0 + self.edges
        for k, v in edges.items():
            a = _with_room(getattr(self, k), self.edges, count)
            a[self.edges : count] = v + self.nodes if k == "to" else v
            setattr(self, k, a)
        self.nodes, self.edges = nodes, count

    def find(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The unit of each span of data; spans with one hash are taken as equal."""
        names, pick, inverse, met = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
        at = np.minimum(np.searchsorted(self.hash, names), max(len(self.hash) - 1, 0))
        new = np.flatnonzero(self.hash[at] != names) if len(self.hash) else np.arange(len(names))
        if len(new):
            first, size = start[pick[new]], (end - start)[pick[new]]
            text = data[np.repeat(first - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
            place = np.searchsorted(self.hash, names[new])
            self.unit = np.insert(self.unit, place, len(self.size) + np.arange(len(new)))
            self.hash = np.insert(self.hash, place, names[new])
            self._append(size, *_lattices(text, size, self.p))
            self.hits = np.concatenate([self.hits, np.zeros(len(new), np.int64)])
        unit = self.unit[np.searchsorted(self.hash, names)]
        self.hits[unit] += met
        return unit[inverse]

    def rest(self) -> None:
        """Between chunks: lets go of what came up seldom if too much is held."""
        if self.nodes <= NODES:
            return
        often = 2
        while self.size[keep := np.flatnonzero(self.hits >= often)].sum() > NODES // 2:
            often *= 2
        size, shift = self.size[keep], self.first[keep] - np.cumsum(self.size[keep]) + self.size[keep]
        node = np.repeat(shift, size) + np.arange(int(size.sum()))
        degree = self.edge0[node + 1] - self.edge0[node]
        edge0 = np.concatenate([[0], np.cumsum(degree)])
        e = np.repeat(self.edge0[node] - edge0[:-1], degree) + np.arange(edge0[-1])
        edges = {k: getattr(self, k)[e] for k in self.EDGES}
        edges["to"] -= np.repeat(np.repeat(shift, size), degree).astype(np.int32)
        number = np.full(len(self.size), -1)
        number[keep] = np.arange(len(keep))
        held = number[self.unit] >= 0
        names, unit, hits = self.hash[held], number[self.unit[held]], self.hits[keep] // often
        self.__init__(self.p)
        self.hash, self.unit, self.hits = names, unit, hits
        self._append(size, edge0, edges)

    def draw(self, node: np.ndarray, u: np.ndarray) -> np.ndarray:
        """An edge of each node, the first whose share with those before it reaches u."""
        e = self.edge0[node]
        go = np.flatnonzero(self.upto[e] < u)
        while len(go):
            e[go] += 1
            go = go[self.upto[e[go]] < u[go]]
        return e


def _with_room(a: np.ndarray, used: int, need: int) -> np.ndarray:
    """a, or its first `used` in an array that has room for need."""
    if len(a) >= need:
        return a
    out = np.empty(max(need, 3 * len(a) // 2), a.dtype)
    out[:used] = a[:used]
    return out


class Paths:
    """A sampled segmentation of each unit occurrence: edges in a row, cut by occurrence."""

    def __init__(self, lat: Lattices, unit: np.ndarray, key: np.ndarray):
        node, who = lat.first[unit], np.arange(len(unit))
        steps, step = [], 0
        while len(who):
            e = lat.draw(node, _uniform(key[who] + _U(step * 0xD1B54A32D192ED03 % (1 << 64))))
            steps.append((who, e))
            open_ = ~lat.last[e]
            who, node = who[open_], lat.to[e[open_]]
            step += 1
        count = np.zeros(len(unit), np.int64)
        for w, _ in steps:
            count[w] += 1
        self.bound = np.concatenate([[0], np.cumsum(count)])
        self.edge = np.zeros(self.bound[-1], np.int64)
        for t, (w, e) in enumerate(steps):
            self.edge[self.bound[w] + t] = e


def _gumbel(phi: float, top: float, u: float) -> float:
    """A Gumbel at phi that is at most top."""
    if phi == -math.inf:
        return phi
    x, y = -top, math.log(-math.log(u)) - phi
    return -(max(x, y) + math.log1p(math.exp(-abs(x - y))))


def _search(lat: Lattices, runs: list[tuple[np.ndarray, np.ndarray]], key: int, k: int) -> list[tuple[np.ndarray, float, float, float]]:
    """The first k segmentations of one text: (edges, log probability, perturbed log probability, log of its inclusion probability).

    runs: for each of k, an independent draw of all units: edges and their bounds by unit. A set in the queue is all that
    leaves a found path at one of its places a to b - 1, but at a for the edges in gone; (value, path, a, b, gone).
    """
    noise = np.random.Generator(np.random.Philox(key=key))
    u = lambda: max(noise.random(), 1e-300)
    found: list[tuple[np.ndarray, np.ndarray, float]] = []  # edges, sums of log probabilities before each, value
    queue: list[tuple[float, int, int, int, tuple[int, ...]]] = []

    def put(path: int, a: int, b: int, gone: tuple[int, ...], top: float) -> None:
        if a == b:
            return
        edges, at, _ = found[path]
        if gone:
            node = _node(lat, edges[a])
            others = [e for e in range(lat.edge0[node], lat.edge0[node + 1]) if e not in gone and e != edges[a]]
            mass = sum(map(math.exp, lat.logp[others]))
        else:
            mass = -math.expm1(at[b] - at[a])
        if mass > 0:
            heapq.heappush(queue, (-_gumbel(at[a] + math.log(mass), top, u()), path, a, b, gone))

    def take(edges: np.ndarray, value: float, at: int, gone: tuple[int, ...]) -> None:
        """Takes a path; it left another at its place `at`, where the children in gone are not in its set."""
        found.append((edges, np.concatenate([[0.0], np.cumsum(lat.logp[edges])]), value))
        if gone:
            put(len(found) - 1, at, at + 1, gone, value)
            at += 1
        put(len(found) - 1, at, len(edges), (), value)

    take(runs[0][0], float(noise.gumbel()), 0, ())
    while len(found) < k and queue:
        value, path, a, b, gone = heapq.heappop(queue)
        old, at, _ = found[path]
        j = a
        if not gone:  # a place by the mass that leaves there: the sums tell how much is left
            left = max(at[a] + math.log1p(u() * math.expm1(at[b] - at[a])), at[b])
            j = a + int(np.searchsorted(-at[a + 1 : b], -left))
            put(path, a, j, (), -value)
            put(path, j + 1, b, (), -value)
        gone = (*gone, int(old[j]))
        node = _node(lat, old[j])
        options = [e for e in range(lat.edge0[node], lat.edge0[node + 1]) if e not in gone]
        share = np.cumsum(np.exp(lat.logp[options]))
        tail = [options[min(int(np.searchsorted(share, noise.random() * share[-1], "right")), len(options) - 1)]]
        while not lat.last[tail[-1]]:
            e, x = int(lat.edge0[lat.to[tail[-1]]]), noise.random()
            while lat.upto[e] < x:
                e += 1
            tail.append(e)
        run, cut = runs[len(found)]
        rest = run[cut[int(np.count_nonzero(lat.last[old[:j]])) + 1] :]
        take(np.concatenate([old[:j], np.array(tail), rest]).astype(np.int64), -value, j, gone)
    bound = -queue[0][0] if queue else -math.inf
    out = []
    for edges, at, value in found:
        grown = math.exp(min(at[-1] - bound, 700.0)) if queue else math.inf
        out.append((edges, float(at[-1]), value, 0.0 if grown > 40 else math.log(-math.expm1(-grown)) if grown > 1e-12 else float(at[-1] - bound)))
    return out


def _node(lat: Lattices, edge: int) -> int:
    return int(np.searchsorted(lat.edge0[: lat.nodes + 1], edge, "right")) - 1


def segment(texts: pa.Array, keys: np.ndarray, p: Pieces, k: int, seed: int) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """For each text its first k segmentations in order: (piece ids, log probability, perturbed, log inclusion). Empty text: none."""
    return [row for rows in segmented(texts, keys, p, k, seed) for row in rows]


def segmented(texts: pa.Array, keys: np.ndarray, p: Pieces, k: int, seed: int, known: Lattices | None = None):
    """segment() part by part. known: lattices to use and add to. Each segmentation spells its text, byte by byte, or this raises."""
    known = known or Lattices(p)
    texts = texts.cast(pa.large_string()).fill_null("")
    marked = pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise(pa.array([" "] * len(texts), pa.large_string()), texts, pa.scalar("", pa.large_string())))
    for lo, hi, data, offsets in text_chunks(marked, CHUNK):
        rows = _segment(data, offsets, keys[lo:hi], known, k, seed)
        known.rest()
        if not _spells(rows, data, offsets, p):  # two units of one hash: each span gets a lattice of its own
            rows = _segment(data, offsets, keys[lo:hi], Lattices(p), k, seed, alone=True)
            if not _spells(rows, data, offsets, p):
                raise ValueError(f"segmentation loses a text in {data[:80].tobytes()!r}")
        yield rows


def _segment(data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, lat: Lattices, k: int, seed: int, alone: bool = False) -> list[list[tuple[np.ndarray, float, float, float]]]:
    n, docs = len(data), len(offsets) - 1
    before = np.concatenate([[LINE], data[:-1]])
    opens = ((data == SPACE) & (before != SPACE)) | (data == LINE) | (before == LINE)
    opens[offsets[:-1][np.diff(offsets) > 0]] = True
    start = np.flatnonzero(opens)
    end = np.append(start[1:], n)
    doc_of = np.searchsorted(start, offsets)
    h = np.arange(len(start), dtype=_U) if alone else run_hashes(data.astype(_U) + _U(1), start, end, _BASE)
    unit = lat.find(data, start, end, h)
    doc = np.repeat(np.arange(docs), np.diff(doc_of))
    row = mix(keys.astype(np.int64).view(_U) + _U(seed * 0x9E3779B97F4A7C15 % (1 << 64)))
    base = row[doc] + (np.arange(len(start)) - doc_of[doc]).astype(_U) * _U(0xA24BAED4963EE407)
    draws = [Paths(lat, unit, mix(base + _U((r + 1) * 0x8CB92BA72F3D8DD7 % (1 << 64)))) for r in range(k)]
    out = []
    for i in range(docs):
        a, b = doc_of[i], doc_of[i + 1]
        if a == b:
            out.append([])
            continue
        runs = [(d.edge[d.bound[a] : d.bound[b]], d.bound[a : b + 1] - d.bound[a]) for d in draws]
        out.append([(lat.piece[e], *x) for e, *x in _search(lat, runs, int(row[i]), k)])
    return out


def _bytes(ids: np.ndarray, p: Pieces) -> np.ndarray:
    size = p.size[ids]
    return p.blob[np.repeat(p.at[ids] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]


def _spells(rows: list, data: np.ndarray, offsets: np.ndarray, p: Pieces) -> bool:
    """Whether every segmentation of rows spells its text."""
    for r in range(max(map(len, rows), default=0)):
        have = [i for i, x in enumerate(rows) if len(x) > r]
        whole = data if len(have) == len(rows) else np.concatenate([data[offsets[i] : offsets[i + 1]] for i in have])
        sizes = np.array([p.size[rows[i][r][0]].sum() for i in have])
        if (sizes != np.diff(offsets)[have]).any() or (_bytes(np.concatenate([rows[i][r][0] for i in have]), p) != whole).any():
            return False
    return all(bool(x) == (offsets[i + 1] > offsets[i]) for i, x in enumerate(rows))


def decode(ids: np.ndarray, p: Pieces) -> str:
    """The text that ids stand for: the marked space before it goes."""
    return _bytes(np.asarray(ids, np.int64), p).tobytes()[1:].decode()


SAMPLE = "struct<ids: array<int>, log_prob: double, perturbed: double, log_inclusion: double>"


def encode(docs: DataFrame, k: int = 2, model_file: str = DEFAULT_MODEL, temperature: float = 1.0, seed: int = 23) -> DataFrame:
    """(doc_id, n_samples, n_pieces, samples): k distinct segmentations of every whole text, fewer where it has fewer.

    samples are in falling order of perturbed log probability; log_inclusion is the log of the probability that the
    segmentation is among the first k given the threshold, the (k+1)-th perturbed value (0 if all are there). n_pieces is that of
    the first. Each one is decoded again, and a text that does not come back raises. Noise depends on seed and doc_id only:
    reruns agree; rows with one doc_id and text get the same. Null and empty texts: no samples, n_pieces 0. A null doc_id
    counts as -1. No rows: no rows. Extra columns are left out.
    """

    def run(batches):
        p = pieces(model_file, temperature)
        known = Lattices(p)
        for b in batches:
            keys, at = b.column(0).fill_null(-1).to_numpy(zero_copy_only=False), 0
            for rows in segmented(b.column(1), keys, p, k, seed, known):
                flat = [x for r in rows for x in r]
                ids = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *(len(x[0]) for x in flat)]), pa.int32()), pa.array(np.concatenate([x[0] for x in flat]) if flat else [], pa.int32()))
                parts = pa.StructArray.from_arrays([ids, *(pa.array([x[i] for x in flat], pa.float64()) for i in (1, 2, 3))], ["ids", "log_prob", "perturbed", "log_inclusion"])
                samples = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), parts)
                yield pa.RecordBatch.from_arrays([b.column(0)[at : at + len(rows)], pa.array([len(r) for r in rows], pa.int32()), pa.array([len(r[0][0]) if r else 0 for r in rows], pa.int64()), samples], ["doc_id", "n_samples", "n_pieces", "samples"])
                at += len(rows)

    return map_arrow(docs.select("doc_id", "text"), run, f"doc_id long, n_samples int, n_pieces long, samples array<{SAMPLE}>")


def decode_column(encoded: DataFrame, model_file: str = DEFAULT_MODEL) -> DataFrame:
    """(doc_id, text): the text of each row's first sample; no samples: an empty text."""

    def run(batches):
        p = pieces(model_file, 1.0)
        for b in batches:
            texts = [decode(np.array(s[0]["ids"], np.int64), p) if s else "" for s in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(encoded.select("doc_id", "samples"), run, "doc_id long, text string")
