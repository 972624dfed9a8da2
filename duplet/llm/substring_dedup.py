"""Substring dedup by De Bruijn compaction.

A window of `length` words is an edge of the De Bruijn graph (its ends are the runs of length - 1 words). Instead of
shuffling every edge, each document is cut into paths: runs of successive edges that share their minimizer, the k-mer
with the least hash among those within the window. Equal edges share it at the same place, so they can meet only in
paths with an equal minimizer (as in minimizer-partitioned graph builders). Then

1. a path that follows itself, as in periodic text, is one with a number of times; paths whose minimizer occurs once in the corpus hold no repeated edge and go;
2. equal paths (minimizer and content digest) compact to one with its count. A count of 2 or more is a repeated
   nonbranching path: all its edges repeat, wherever it lies;
3. repeated paths compact further: two are one chain if the places at which one ends are exactly those at which the other
   begins. Only a chain's head is looked up in the documents, and brings the whole chain;
4. where a minimizer has different paths, the graph branches. There, one representative of each path is expanded into its
   edges, with its count as weight, and edges with a weight of 2 or more in sum repeat;
5. source coordinates (document, first word, edges) bring both back to every document, where successive ones join into
   maximal spans. There the words of each chain are held against its representative's, which is read at its own
   coordinates, by a cryptographic digest, and a chain with other words is not cut.

Paths meet by 128 bits (the minimizer's 64-bit hash with the path's digest), edges by 128 bits of a cryptographic digest of
their words. So no words are cut that don't repeat; a repeat is missed where two paths that differ share 128 bits.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duplet.llm.common import Words, discard, map_arrow, run_hashes, signed, stored, text_chunks, unused

_SEED_BASE, _PATH_BASE = 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3
#: Bits of a position that ride below the hash in the sliding minimum.
_PLACE = np.uint64(28)


def _key(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text (it tells rows with the same doc_id apart) and text."""
    return docs.select("doc_id", F.hash("text").alias("th"), "text")


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of x[i : i + width] for every i."""
    done = 1
    out = x
    while done * 2 <= width:
        out = np.minimum(out[:-done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def paths(words: Words, length: int, k: int) -> tuple[np.ndarray, ...]:
    """(document, first word, edges, times, minimizer, digest) of the paths of some texts; a path that comes several times in a row, as in periodic text, is one with that many times."""
    n = len(words.hash)
    none = (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    if n < length:
        return none
    last = np.repeat(words.first[1:], np.diff(words.first))  # of each word, the end of its document
    edges = np.flatnonzero(np.arange(n) + length <= last)
    if not len(edges):
        return none
    at = np.arange(n - k + 1)
    seeds = run_hashes(words.hash, at, at + k, _SEED_BASE)
    least = _sliding_min(seeds >> _PLACE << _PLACE | at.astype(np.uint64), length - k + 1)[edges]
    chosen = (least & np.uint64((1 << int(_PLACE)) - 1)).astype(np.int64)
    doc = np.searchsorted(words.first, edges, "right") - 1
    fresh = np.ones(len(edges), bool)
    fresh[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    begin = np.flatnonzero(fresh)
    count = np.diff(np.append(begin, len(edges)))
    start = edges[begin]
    doc, seed, dig = doc[begin], seeds[chosen[begin]], run_hashes(words.hash, start, start + count + length - 1, _PATH_BASE)
    lead = np.flatnonzero(np.append(True, (seed[1:] != seed[:-1]) | (dig[1:] != dig[:-1]) | (doc[1:] != doc[:-1])))
    times = np.diff(np.append(lead, len(seed)))
    return doc[lead], (start - words.first[doc])[lead], count[lead], times, seed[lead], dig[lead]


def _occurrences(docs: DataFrame, length: int, k: int) -> DataFrame:
    def run(batches):
        for b in batches:
            for lo, hi, data, offsets in text_chunks(b.column(2)):
                doc, start, count, times, seed, dig = paths(Words(data, offsets), length, k)
                row = pa.array(doc)
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi].take(row), b.column(1)[lo:hi].take(row), pa.array(start.astype(np.int32)), pa.array(count.astype(np.int32)), pa.array(times.astype(np.int32)), pa.array(signed(seed)), pa.array(signed(dig))], ["doc_id", "th", "start", "edges", "times", "seed", "dig"])

    return map_arrow(_key(docs), run, "doc_id long, th int, start int, edges int, times int, seed long, dig long")


def _same(a: DataFrame, b: DataFrame) -> Column:
    return a.doc_id.eqNullSafe(b.doc_id) & (a.th == b.th)


def _places(at: Column, *more: str) -> list[Column]:
    """Two sums over a path's places (document, word) that tell sets of places apart: of 28 bits each, so that they don't overflow under 2**35 places."""
    h = F.xxhash64("doc_id", "th", at)
    return [F.sum(F.shiftright(h, 36)).alias(more[0]), F.sum(h.bitwiseAND((1 << 28) - 1)).alias(more[1])]


def _chains(repeated: DataFrame) -> DataFrame:
    """(doc_id, th, start, edges, seed, dig): the chains of repeated paths, with the head's hashes, at their first places.

    Paths of one chain have the same places but for their offsets, so their first places lie in one document, in a row. A
    path that anywhere follows itself is a chain of its own.
    """
    by_place = Window.partitionBy("doc_id", "th").orderBy("start")
    before = F.lag(F.struct((F.col("start") + F.col("edges")).alias("start"), "n", "loops", F.col("end1").alias("begin1"), F.col("end2").alias("begin2"))).over(by_place)
    linked = repeated.withColumn("head", F.col("loops") | ~F.coalesce(before == F.struct("start", "n", "loops", "begin1", "begin2"), F.lit(False)))
    numbered = linked.withColumn("chain", F.sum(F.col("head").cast("int")).over(by_place))
    out = numbered.groupBy("doc_id", "th", "chain").agg(F.min("start").alias("start"), F.sum("edges").cast("int").alias("edges"), F.min_by(F.struct("seed", "dig"), "start").alias("head"))
    return out.select("doc_id", "th", "start", "edges", "head.seed", "head.dig")


def repeated_spans(docs: DataFrame, length: int = 35, k: int = 8) -> DataFrame:
    """(doc_id, th, spans): for each document with repeated edges, the runs [first word, edges, times, proof] of them, edges that many times in a row; th is a hash of the text, proof() of the words of the first time must give proof where there is one."""
    found = _occurrences(docs, length, k)
    # stored, so that the join with it has no aggregate in its stage and a hot minimizer's partition can be split
    often = stored(found.groupBy("seed").agg(F.sum("times").alias("n")).where("n > 1").select("seed"), "often")
    places = stored(found.join(often, "seed"), "paths")
    discard(often)
    first = F.min(F.struct("doc_id", "th", "start", "edges")).alias("at")
    compact = stored(places.groupBy("seed", "dig").agg(F.sum("times").alias("n"), (F.max("times") > 1).alias("loops"), first, *_places(F.col("start"), "begin1", "begin2"), *_places(F.col("start") + F.col("edges"), "end1", "end2")), "compact")
    branching = compact.groupBy("seed").agg(F.count("*").alias("ways")).where("ways > 1").select("seed")
    none = F.lit(None).cast("long")
    expand = compact.join(branching, "seed", "left_semi").select("at.*", "n", none.alias("seed"), none.alias("dig"))
    chains = stored(_chains(compact.where("n > 1").select("at.*", "n", "loops", "seed", "dig", "begin1", "begin2", "end1", "end2")), "chains")
    parts = expand.union(chains.select("doc_id", "th", "start", "edges", F.lit(0).cast("long").alias("n"), "seed", "dig"))
    need = parts.groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "edges", "n", "seed", "dig")).alias("parts"))
    edges = stored(_edges(docs, need, length), "edges")
    discard(compact, chains)
    twice = edges.where("n > 0").groupBy("e1", "e2").agg(F.sum("n").alias("total")).where("total > 1").select("e1", "e2")
    single = edges.where("n = 1").join(twice, ["e1", "e2"], "left_semi").select("doc_id", "th", F.col("at").alias("start"), F.lit(1).alias("edges"), F.lit(1).alias("times"), F.lit(None).cast("binary").alias("proof"))
    heads = edges.where("n = 0").select("seed", "dig", F.col("at").alias("edges"), "proof").dropDuplicates(["seed", "dig"])
    whole = places.drop("edges").join(heads, ["seed", "dig"]).select("doc_id", "th", "start", "edges", "times", "proof")
    spans = stored(whole.union(single).groupBy("doc_id", "th").agg(F.collect_list(F.struct("start", "edges", "times", "proof")).alias("spans")), "spans")
    discard(places, edges)
    return spans


def proof(words: bytes) -> bytes:
    """Of words joined by one space."""
    return hashlib.blake2b(words, digest_size=16).digest()


def _edges(docs: DataFrame, need: DataFrame, length: int) -> DataFrame:
    """Of the paths in need: (e1, e2, n, doc_id, th, at) for each edge of those with a count n, which is their path's; (seed, dig, n = 0, proof, at = edges) of each chain."""
    names = ["e1", "e2", "n", "doc_id", "th", "at", "seed", "dig", "proof"]

    def run(batches):
        for b in batches:
            parts, texts, out = b.column(3), b.column(2), []
            for i in range(len(b)):
                words = (texts[i].as_py() or "").encode().split()
                whole, cut = b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
                said = lambda at, n: proof(whole[cut[at] : cut[at + n] - 1])  # noqa: B023, E731
                own = parts[i : i + 1].flatten()
                start, count, n = (own.field(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("start", "edges", "n"))
                for chain in (False, True):
                    rows = np.flatnonzero((n == 0) == chain)
                    if not len(rows):
                        continue
                    if chain:
                        at, weight = count[rows], n[rows]
                        proofs = pa.array([said(s, e + length - 1) for s, e in zip(start[rows].tolist(), count[rows].tolist(), strict=True)], pa.binary())
                        blank = pa.nulls(len(rows), pa.int64())
                        keys = [blank, blank, *(own.field(x).take(pa.array(rows)) for x in ("seed", "dig")), proofs]
                    else:
                        c = count[rows]
                        at, weight = np.repeat(start[rows] - np.cumsum(c) + c, c) + np.arange(c.sum()), np.repeat(n[rows], c)
                        both = np.frombuffer(b"".join([said(x, length) for x in at.tolist()]), "<i8").reshape(-1, 2)
                        blank = pa.nulls(len(at), pa.int64())
                        keys = [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), blank, blank, pa.nulls(len(at), pa.binary())]
                    row = pa.array(np.full(len(at), i))
                    out.append(pa.RecordBatch.from_arrays([*keys[:2], pa.array(weight), b.column(0).take(row), b.column(1).take(row), pa.array(at.astype(np.int32)), *keys[2:]], names))
            if out:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    d = _key(docs)
    return map_arrow(d.join(need, _same(d, need)).select(d.doc_id, d.th, "text", "parts"), run, "e1 long, e2 long, n long, doc_id long, th int, at int, seed long, dig long, proof binary")


def covered(spans: list | None, words: list[bytes], length: int) -> np.ndarray:
    """For each word, whether a repeated edge covers it; a span whose words don't give its proof counts for nothing."""
    steps = np.zeros(len(words) + 1, np.int64)
    for s in spans or ():
        start, edges = s["start"], s["edges"]
        one, end = start + edges + length - 1, start + edges * s["times"] + length - 1
        if s["proof"] is None or (s["proof"] == proof(b" ".join(words[start:one])) and (one == end or words[start + edges : end] == words[start : end - edges])):
            steps[start] += 1
            steps[end] -= 1
    return np.cumsum(steps[:-1]) > 0


def _apply(docs: DataFrame, length: int, k: int, run, fields, columns: list[str]) -> DataFrame:
    """run over the columns of docs, and last each document's spans; names that docs has too don't matter."""
    name = {c: unused(docs.columns, f"its_{c}") for c in ("doc_id", "th", "spans")}
    spans = repeated_spans(docs, length, k).withColumnsRenamed(name)
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(spans[name["doc_id"]]) & (F.hash(docs["text"]) == spans[name["th"]]), "left")
    return map_arrow(joined.select(*(docs[f"`{c}`"] for c in columns), name["spans"]), run, fields)


def digest(docs: DataFrame, length: int = 35, k: int = 8) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every document: see remove() for what is removed.

    Null, empty and blank texts: no words. Repeated rows: each by itself. No rows: no rows. Extra columns are left out.
    """

    def run(batches):
        for b in batches:
            rows = []
            for text, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = (text or "").encode().split()
                gone = covered(spans, words, length)
                kept = words if not spans else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            a, c, d = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(d, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _apply(docs, length, k, run, "doc_id long, n_words long, n_removed long, kept_sha256 string", ["doc_id", "text"])


def remove(docs: DataFrame, length: int = 35, k: int = 8) -> DataFrame:
    """docs with the words that a repeated window covers cut from text; texts without any stay byte for byte.

    A window of `length` words of one document repeats if its words also start anywhere else, in the same document or
    another. All are judged on the input. In a text that loses words the kept ones are joined by one space; n_chars,
    where there is one, follows. Null and empty texts stay; texts under `length` words too. Equal rows: both lose the
    repeated words. No rows: no rows. Other columns pass.
    """
    column = docs.columns.index("text")
    chars = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        for b in batches:
            texts, spans = b.column(column).to_pylist(), b.column(b.num_columns - 1).to_pylist()
            for i, s in enumerate(spans):
                if s:
                    words = texts[i].encode().split()
                    gone = covered(s, words, length).tolist()
                    texts[i] = b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
            out = b.columns[:-1]
            out[column] = pa.array(texts, pa.string())
            if chars is not None:
                sizes = [len(t) if s else n for t, s, n in zip(texts, spans, out[chars].to_pylist(), strict=True)]
                out[chars] = pa.array(sizes, out[chars].type)
            yield pa.RecordBatch.from_arrays(out, b.schema.names[:-1])

    return _apply(docs, length, k, run, docs.schema, docs.columns)
