import random
import zlib
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from duplet.llm import mixing, ogg_media, queries, sharding

SF = Path("/root/testdata/sf0.001")


def test_checksum_is_that_of_the_container():
    slow = 0
    data = bytes(range(256)) * 3
    for x in data:
        slow ^= x << 24
        for _ in range(8):
            slow = (slow << 1 ^ (0x04C11DB7 if slow & 0x80000000 else 0)) & 0xFFFFFFFF
    assert ogg_media.page_crc(data) == slow


@pytest.mark.parametrize("size", [192, 1920, 3840, 192 * 255, 192 * 1001])
@pytest.mark.parametrize(("channels", "packet", "segments"), [(1, 192, 255), (2, 1920, 3), (3, 65_088, 64), (2, 255 * 192, 255)])
def test_samples_come_back(size, channels, packet, segments):
    data = random.Random(size).randbytes(size)
    media = ogg_media.write_samples(data, channels=channels, packet=packet, segments=segments)
    back, facts = ogg_media.read_samples(media)
    assert back == data and facts["streams"] == channels and len(facts["times"]) == facts["packets"]
    assert facts["times"][::channels] == sorted(facts["times"][::channels])


def test_any_changed_byte_is_seen():
    media = ogg_media.write_samples(bytes(range(192)) * 10)
    for at in range(0, len(media), 7):
        bad = bytearray(media)
        bad[at] ^= 4
        with pytest.raises(ogg_media.OggError):
            ogg_media.read_samples(bytes(bad))
    for cut in (1, 30, len(media) // 2, len(media) - 1):
        with pytest.raises(ogg_media.OggError):
            ogg_media.read_samples(media[:cut])
    with pytest.raises(ogg_media.OggError):
        ogg_media.read(media + media)


def test_a_page_without_segments_within_a_packet():
    data = bytes(range(255)) * 2 + b"end"
    head, *rest = ogg_media.pages(7, [(b"first", 0), (data, 3)], segments=2)

    def numbered(page, n):
        page = page[:18] + n.to_bytes(4, "little") + b"\0\0\0\0" + page[26:]
        return page[:22] + ogg_media.page_crc(page).to_bytes(4, "little") + page[26:]

    empty = ogg_media.HEADER.pack(b"OggS", 0, ogg_media.CONTINUED, -1, 7, 0, 0, 0)
    (stream,) = ogg_media.read(head + rest[0] + numbered(empty, 2) + b"".join(numbered(p, 3 + i) for i, p in enumerate(rest[1:])))
    assert stream.packets == [b"first", data]


def test_media_columns(spark, edges, nothing):
    out = {r.doc_id: r for r in ogg_media.decode(ogg_media.encode(edges)).collect()}
    assert out[1].payload == b" " * 192 and out[8].payload.startswith(b"long long") and out[4].media == out[5].media and out[4].error is None
    d = {r.doc_id: r for r in ogg_media.digest(edges).collect()}
    assert (d[8].n_bytes, d[8].payload_bytes, d[8].tail_crc32) == (150_000, 150_144, zlib.crc32(b" " * 16)) and d[1].media_sha256 == d[2].media_sha256
    broken = ogg_media.encode(edges).withColumn("media", F.when(F.col("doc_id") == 4, F.lit(b"OggSxx")).when(F.col("doc_id") != 5, F.col("media")))
    bad = {r.doc_id: r for r in ogg_media.decode(broken).collect()}
    assert bad[4].error and bad[4].payload is None and bad[5].error is None and bad[5].payload is None
    assert ogg_media.digest(nothing).count() == 0


def levels(sizes, weights, total, cap):
    """Shares by weight; what is above its cap stops there and the excess is shared anew."""
    left, full = dict(sizes), {}
    while True:
        rest, w = total - sum(full.values()), sum(weights[s] for s in left)
        over = [s for s in left if rest * weights[s] / w > cap * sizes[s]]
        if not over:
            return full | {s: rest * weights[s] / w for s in left}
        for s in over:
            full[s] = cap * left.pop(s)


@pytest.mark.parametrize("seed", range(4))
def test_targets_equal_sharing_in_turns(spark, seed):
    rng = random.Random(seed)
    sizes = {f"s{i}": rng.choice([0, 3, 50, 400, 9000]) + 1 for i in range(9)}
    rows = spark.createDataFrame(list(sizes.items()) + [(None, 77)], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows, (5.0, 2.0, 1.0), 1.5, 2.0).collect()}
    order = [*sorted(sizes), None]
    want = levels(sizes | {None: 77}, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, 1.5 * (sum(sizes.values()) + 77), 2.0)
    assert got == pytest.approx(want)


def test_mix(spark, edges, nothing):
    rows = [(i, "w " * (i % 30), "en", f"s{i % 3}", 0) for i in range(6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(docs)
    for r in mixed.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect():
        assert r.taken == pytest.approx(r.target, rel=0.06)
    assert mixed.agg(F.max("copies")).first()[0] <= 2 and mixing.emit(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
    same = lambda d: sorted((r.doc_id, r.copies) for r in mixing.mix(d).collect())
    assert same(docs) == same(docs.repartition(7))
    got = mixing.mix(edges)
    assert got.count() == edges.count() and {r["size"] for r in got.where("doc_id < 4").collect()} == {0}
    assert mixing.mix(nothing).count() == 0


def check_shards(rows, shards):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert all(0 <= s < shards for s in by) and all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values())
    return {s: sum(r["size"] for r in g) for s, g in by.items()}


def test_shards_are_even_and_copies_meet(spark, edges, nothing):
    rng = random.Random(9)
    texts = [f"t{i} " * rng.randrange(1, 60) for i in range(3000)]
    texts += [t for i in range(80) for t in [f"copied {i} " * 9] * rng.randrange(2, 9)] + ["everywhere " * 10] * 1500
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = sharding.assign(docs, 8).collect()
    load = check_shards(rows, 8)
    mean = sum(load.values()) / 8
    assert len(rows) == len(texts) and max(load.values()) < 1.03 * mean and min(load.values()) > 0.97 * mean
    groups = {}
    for r in rows:
        groups.setdefault(texts[r.doc_id], set()).add(r.shard)
    small = [g for t, g in groups.items() if t.startswith("copied")]
    assert sum(len(g) == 1 for g in small) > 0.9 * len(small)
    assert sorted(rows) == sorted(sharding.assign(docs.repartition(5), 8).collect())
    few = sharding.assign(edges, 4).collect()
    check_shards(few, 4)
    assert len(few) == edges.count() and {r["size"] for r in few if r.doc_id in (1, 2)} == {8}
    assert sharding.assign(nothing, 4).count() == 0


@pytest.mark.parametrize(("groups", "members", "pairs"), [(3, 70, 0), (9, 90, 0), (16, 50, 0), (2, 60, 600)])
def test_groups_that_fit_a_shard_meet(spark, groups, members, pairs):
    texts = [f"large {g:04}" for g in range(groups) for _ in range(members)] + [f"pairs {i:04}" for i in range(pairs) for _ in range(2)]
    texts += [f"alone {i:04}" for i in range(2400 - len(texts))]
    rows = sharding.assign(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 24).collect()
    load = check_shards(rows, 24)
    mean = sum(load.values()) / 24
    where = {}
    for r in rows:
        where.setdefault(texts[r.doc_id], set()).add(r.shard)
    assert len(rows) == len(texts) and all(len(s) == 1 for s in where.values())
    assert max(load.values()) < 1.05 * mean and min(load.values()) > 0.95 * mean


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, str(SF)).toPandas(), db.sql(queries.ORACLE_SQL[name]).df()
    plain = lambda d: sorted(tuple(str(round(v, 9) if isinstance(v, float) else v) for v in r) for r in d[sorted(d.columns)].itertuples(index=False))
    assert plain(got) == plain(want)


@pytest.mark.skipif(not SF.exists(), reason="no tables here")
def test_pipeline_keeps_columns_and_runs_whole(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(SF))
        assert out.columns == docs.columns
    assert corpus_pipeline.run(spark, str(SF)).count() > 0


def test_shards_of_a_small_table_are_even(spark):
    docs = spark.read.parquet(str(SF / "documents.parquet"))
    rows = sharding.assign(docs, 24).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    sizes = [r.n for r in rows]
    assert len(sizes) == 24 and max(sizes) <= 1.02 * sum(sizes) / 24 and min(sizes) >= 0.97 * sum(sizes) / 24


def test_null_text_has_the_checksum_of_no_bytes(spark, edges):
    got = {r.doc_id: (r.size, r.text_crc32) for r in sharding.assign(edges, 3).collect()}
    assert got[1] == got[2] == (8, 0)
