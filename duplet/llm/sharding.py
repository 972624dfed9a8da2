"""Sharding by balanced label propagation, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duplet.llm.common import crc32_text, stored

#: Buckets of the histograms that turn byte quotas into thresholds on a hash.
BINS = 4096
#: Groups of at least this part of a shard, shards / LARGE at most, are placed one by one; below the slack, so that any other group finds room.
LARGE = 1 / 64


def _bin(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BINS)).cast("int")


def assign(docs: DataFrame, shards: int = 24, rounds: int = 40, slack: float = 0.02, seed: int = 5) -> DataFrame:
    """docs with size, text_crc32, shard and slot; sizes of shards are near equal, equal texts meet where room allows.

    Documents with equal texts are linked. All start in the shard of a hash of doc_id. What isn't placed can still leave,
    so a shard's room is (1 + slack) of the mean less the bytes placed there. Large groups and large single documents are
    placed first, by size, the latter in the emptiest shard. In each round every group left asks for the shard with room for it that holds most of its bytes (ties: the
    higher shard), or by hash for any with room; a shard admits groups in an order by hash while room lasts, and those refused
    ask again, until a round places none. A group that fits nowhere stays divided. Then what isn't placed, unlinked documents
    and divided groups, moves from shards above the mean to those below. A shard's quota becomes a threshold on
    the hash through a histogram of BINS bins, so no task sees a whole shard. slot numbers a shard's documents from 0
    without gaps, counted within hash bins plus an offset for each bin.
    Null text: size 8, checksum 0 (that of no bytes), its own group of nulls. Rows that repeat are told apart only by their slot. No rows: no rows.
    Other columns pass; any named like those added are replaced.
    """
    spark = docs.sparkSession
    base = docs.drop("size", "text_crc32", "shard", "slot", "law", "grown_shard")
    sized = base.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 8).withColumn("text_crc32", F.coalesce(crc32_text(F.col("text")), F.lit(0)).cast("long"))
    group = F.coalesce(F.xxhash64("text", F.md5("text")), F.lit(0))
    rows = sized.select("doc_id", "size", "text_crc32", group.alias("g"))
    start = F.pmod(F.xxhash64("doc_id", "size", "text_crc32", F.lit(seed)), F.lit(shards)).cast("int")
    held = rows.groupBy("g", start.alias("start")).agg(F.sum("size").alias("bytes"), F.count("*").alias("members"))
    every = stored(held.groupBy("g").agg(F.sum("bytes").alias("total"), F.sum("members").alias("members"), F.collect_list(F.struct("bytes", F.col("start").alias("shard"))).alias("held")), "groups")
    mean = (every.agg(F.sum("total").alias("n")).first().n or 0) / shards
    room = [mean * (1 + slack)] * shards
    chosen: list[tuple[int, int]] = []
    for r in every.where(F.col("total") >= F.lit(mean * LARGE)).orderBy(F.desc("total"), "g").collect():  # at most shards / LARGE
        fits = [s for s in range(shards) if room[s] >= r.total]
        if r.members == 1:  # nothing links it: to the emptiest shard, so that the rest can level out
            best = max(range(shards), key=lambda s: (room[s], s))
            room[best] -= r.total
            chosen.append((r.g, best))
        elif fits:
            bytes_in = {h.shard: h.bytes for h in r.held}
            best = max(fits, key=lambda s: (bytes_in.get(s, 0), room[s], s))
            room[best] -= r.total
            chosen.append((r.g, best))
    settled = stored(spark.createDataFrame(chosen, "g long, shard int"), "settled")
    left = every.where(F.col("members") > 1).where(F.col("total") < F.lit(mean * LARGE))
    for r in range(rounds):
        rooms = F.array(*[F.struct(F.lit(float(x)).alias("room"), F.lit(i).alias("shard")) for i, x in enumerate(room)])
        own = F.array_max(F.filter("held", lambda h: F.element_at(rooms, h["shard"] + 1)["room"] >= F.col("total")))["shard"]
        other = F.filter(rooms, lambda x: x["room"] >= F.col("total"))
        any_ = F.when(F.size(other) > 0, F.get(other, F.pmod(F.xxhash64("g", F.lit(seed + 30 + r)), F.size(other)).cast("int"))["shard"])
        asked = stored(left.withColumn("want", F.coalesce(own, any_)).withColumn("turn", _bin(F.col("g"), F.lit(seed + 10 + r))), "asked")
        by_turn = asked.where("want is not null").groupBy("want", "turn").agg(F.sum("total").alias("bytes"))
        sofar = by_turn.withColumn("sofar", F.sum("bytes").over(Window.partitionBy("want").orderBy("turn")))
        fits = sofar.where(F.col("sofar") <= F.element_at(rooms, F.col("want") + 1)["room"]).groupBy("want").agg(F.max("turn").alias("limit"), F.max("sofar").alias("taken"))
        admitted = fits.collect()  # at most one row a shard
        if not admitted:
            break
        for x in admitted:
            room[x.want] -= x.taken
        limit = F.create_map(*[F.lit(v) for x in admitted for v in (x.want, x.limit)])
        goes = F.coalesce(F.col("turn") <= limit[F.col("want")], F.lit(False))
        settled = settled.union(asked.where(goes).select("g", F.col("want").alias("shard")))
        left = asked.where(~goes).select("g", "total", "held")
    settled = stored(settled, "settled")
    frame = spark.range(shards).select(F.col("id").cast("int").alias("shard"))
    full = frame.join(F.broadcast(spark.createDataFrame([(i, int(round(mean * (1 + slack) - x))) for i, x in enumerate(room)], "shard int, linked long")), "shard")
    bins = rows.join(settled.withColumnRenamed("shard", "linked_shard"), "g", "left").withColumn("start", start).withColumn("bin", _bin(F.col("doc_id"), F.col("size"), F.lit(seed + 2)))
    lone = stored(bins.where("linked_shard is null").groupBy("start", "bin").agg(F.sum("size").alias("bytes")), "lone")
    placed = _level(frame, full, lone, shards, seed)
    final = stored(
        bins.join(placed.withColumnRenamed("shard", "lone_shard"), ["start", "bin"], "left")
        .select("doc_id", "size", "text_crc32", "g", F.coalesce("linked_shard", "lone_shard").alias("shard")),
        "placed",
    )
    cell = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(BINS)).cast("int")
    counts = final.groupBy("shard", cell.alias("cell")).agg(F.count("*").alias("n"))
    offsets = counts.withColumn("offset", F.sum("n").over(Window.partitionBy("shard").orderBy("cell")) - F.col("n")).drop("n")
    turn = Window.partitionBy("shard", "cell").orderBy("doc_id", "size", "text_crc32")
    return final.withColumn("cell", cell).withColumn("turn", F.row_number().over(turn)).join(offsets, ["shard", "cell"]).select("doc_id", "size", "text_crc32", F.col("g").alias("text_group"), "shard", (F.col("turn") - 1 + F.col("offset")).cast("long").alias("slot"))


def _level(frame: DataFrame, linked: DataFrame, lone: DataFrame, shards: int, seed: int) -> DataFrame:
    """(start, bin, shard): where each bin of documents not placed goes so that all shards hold the mean.

    Bins leave a shard above the mean until it is at the mean; what left is laid out in one row of bytes, and so is
    the room of the shards below; a bin goes to the shard whose room its middle falls into. At most shards x BINS rows.
    """
    single = lone.groupBy(F.col("start").alias("shard")).agg(F.sum("bytes").alias("single"))
    load = frame.join(linked, "shard", "left").join(single, "shard", "left").na.fill(0).withColumn("load", F.col("linked") + F.col("single"))
    load = load.withColumn("gap", F.sum("load").over(Window.partitionBy(F.lit(0))) / shards - F.col("load"))
    sofar = F.sum("bytes").over(Window.partitionBy("start").orderBy("bin"))
    bins = lone.withColumn("sofar", sofar).join(F.broadcast(load.select(F.col("shard").alias("start"), "gap")), "start")
    leaves = bins.withColumn("leaves", F.col("sofar") - F.col("bytes") / 2 <= -F.col("gap"))
    gone = leaves.where("leaves")
    line = gone.withColumn("middle", F.sum("bytes").over(Window.partitionBy(F.lit(0)).orderBy("start", "bin")) - F.col("bytes") / 2)
    line = line.withColumn("part", F.col("middle") / F.sum("bytes").over(Window.partitionBy(F.lit(0))))
    rooms = load.where("gap > 0").withColumn("upto", F.sum("gap").over(Window.partitionBy(F.lit(0)).orderBy("shard"))).withColumn("all", F.sum("gap").over(Window.partitionBy(F.lit(0))))
    rooms = rooms.select(F.col("shard"), ((F.col("upto") - F.col("gap")) / F.col("all")).alias("low"), (F.col("upto") / F.col("all")).alias("high"))
    arrive = line.join(F.broadcast(rooms), (F.col("part") >= F.col("low")) & (F.col("part") < F.col("high")), "left").select("start", "bin", F.coalesce("shard", "start").alias("shard"))
    return arrive.union(leaves.where(~F.col("leaves")).select("start", "bin", F.col("start").alias("shard")))
