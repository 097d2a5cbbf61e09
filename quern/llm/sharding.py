"""Sharding by balanced label propagation.

Documents with equal texts are linked through their group. Groups larger than a small part of a shard, of which there are few, are placed first, largest first, each in one shard; only
a group that no shard has room for is cut, into as few parts as fill the emptiest shards. In each round a join gives every other document the shard where most of its group lies, and
documents move there as far as the shards' quotas allow for documents with a copy, as those without can make room; the share that may enter a shard is drawn by a hash of the group, so
that groups move together. Rounds end when nobody wants to move. At the end a distributed ranking gives each shard exactly its number of rows: the surplus of full shards moves, texts without a copy before others, and then whole groups one after another.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import cut, documents, only, remove
from quern.operators.prefix import BITS, numbered

SHARDS, ROUNDS = 16, 3
#: Rows of a group that is not placed first, at most, as a part of a shard; bits of a group in the order of slots.
PART, GROUP_BITS = 32, 12


def shard(df: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each row of ``df`` (doc_id, text); the numbers of rows of two shards differ by one at most.

    ``size`` is the text's UTF-8 bytes (null: none) plus 1, ``slot`` counts a shard's rows from 0 without gaps. Null texts are one group, empty ones another. Rows are told apart by
    doc_id: repeated rows get slots of their own, as do rows with a null one. Other columns aren't read. An empty table gives no rows.
    """
    raw = F.coalesce(F.encode("text", "utf-8"), F.lit(b"").cast("binary"))
    base = only(df, "doc_id", "text").select(
        "doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.unhex(F.sha2(F.concat(F.when(F.col("text").isNull(), "-").otherwise("+"), raw), 256)).alias("sha")
    )
    base = cut(base.select("*", F.hash("doc_id").alias("h")))
    rows = base.count()
    most = max(8, rows // (shards * PART))
    # written, so that adaptive execution can split a hot group in the join
    groups = cut(base.groupBy("sha").agg(F.count("*").alias("times")).filter("times > 1"))
    quotas = [rows // shards + (i < rows % shards) for i in range(shards)]
    large = groups.filter(F.col("times") > most).collect()  # shards * PART at most
    plan, free = planned(sorted(((r.sha, r.times) for r in large), key=lambda g: (-g[1], bytes(g[0]))), quotas)
    fixed = F.broadcast(df.sparkSession.createDataFrame(plan, "sha binary, piece int, start long, end long, to int"))
    at = F.pmod(F.xxhash64("doc_id", F.lit(1)), "times")
    found = base.join(groups, "sha", "left").withColumn("times", F.coalesce("times", F.lit(1))).withColumn("at", at).join(fixed.withColumnRenamed("sha", "key"), (F.col("sha") == F.col("key")) & (F.col("at") >= F.col("start")) & (F.col("at") < F.col("end")), "left")
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(max(1, sum(free))))
    dealt = sum(((draw >= sum(free[: i + 1])).cast("int") for i in range(shards - 1)), F.lit(0))
    placed = found.select(
        "doc_id", "size", "text_crc32", "h", F.xxhash64("sha", F.coalesce("piece", F.lit(0))).alias("chunk"), F.col("to").isNotNull().alias("fixed"), (F.col("to").isNull() & (F.col("times") > 1)).alias("linked"), F.coalesce("to", dealt).alias("shard")
    )
    placed = cut(placed)
    remove(base, groups)
    for step in range(rounds):
        near = placed.filter("linked").groupBy("chunk", "shard").agg(F.count("*").alias("n"))
        want = cut(near.groupBy("chunk").agg(F.max_by("shard", F.struct("n", F.hash("chunk", "shard"))).alias("want")))
        asked = placed.join(want, "chunk", "left").withColumn("want", F.coalesce("want", "shard"))
        flows = {(r["shard"], r.want): r.n for r in asked.filter("linked OR fixed").groupBy("shard", "want").agg(F.count("*").alias("n")).collect()}  # shards squared at most
        if all(a == b for a, b in flows):
            remove(want)
            break
        share = entering(flows, shards, rows // shards)
        odds = F.element_at(F.array(*[F.lit(x) for x in share]), F.col("want") + 1)
        draw = F.pmod(F.xxhash64("chunk", F.lit(step)), F.lit(1 << 20)) / float(1 << 20)
        new = cut(asked.withColumn("shard", F.when(draw < odds, F.col("want")).otherwise(F.col("shard"))).select(placed.columns))
        remove(placed, want)
        placed = new
    return slots(placed, rows, shards)


def planned(groups: list[tuple[bytes, int]], quotas: list[int]) -> tuple[list[tuple[bytes, int, int, int, int]], list[int]]:
    """Pieces (sha, number, start, end, shard) of groups (sha, times), and the rows that are left to each shard; a piece is a whole group where a shard has room for it."""
    free, plan = list(quotas), []
    for sha, times in groups:
        start, number = 0, 0
        while start < times:
            fits = [s for s, n in enumerate(free) if n >= times - start]
            to = min(fits, key=lambda s: (free[s], s)) if fits else max(range(len(free)), key=lambda s: (free[s], -s))
            n = min(free[to], times - start)
            plan.append((bytes(sha), number, start, start + n, to))
            free[to], start, number = free[to] - n, start + n, number + 1
    return plan, free


def entering(flows: dict[tuple[int, int], int], shards: int, quota: float) -> list[float]:
    """Share of the documents that ask to enter each shard which may, such that none ends above ``quota`` even if nobody who asked to leave does."""
    stay = [sum(n for (a, _), n in flows.items() if a == s) for s in range(shards)]
    ask = [sum(n for (a, b), n in flows.items() if b == s != a) for s in range(shards)]
    leave = [sum(n for (a, b), n in flows.items() if a == s != b) for s in range(shards)]
    odds = [1.0] * shards
    for _ in range(8):  # the fewer may enter elsewhere, the fewer leave
        left = [sum(n * odds[b] for (a, b), n in flows.items() if a == s != b) if leave[s] else 0.0 for s in range(shards)]
        odds = [min(1.0, max(0.0, quota - stay[s] + left[s]) / ask[s]) if ask[s] else 1.0 for s in range(shards)]
    return odds


def slots(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Rank the rows of each shard: groups placed first, other groups, texts without a copy. Rows ranked above their shard's number fill the gaps of others."""
    together = F.when(F.col("fixed"), F.xxhash64("doc_id", F.lit(3))).otherwise(F.xxhash64("chunk", F.lit(2)))  # groups placed first, which may be large, needn't stay in one cell
    group, doc = F.shiftrightunsigned(together, 64 - GROUP_BITS), F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(2)), 64 - (BITS - 2 - GROUP_BITS))
    order = F.when(F.col("fixed"), 0).when(F.col("linked"), 1).otherwise(2).cast("long")
    key = F.shiftleft(F.shiftleft(order, GROUP_BITS) + group, BITS - 2 - GROUP_BITS) + doc
    ranked = numbered(placed.withColumn("key", key), ["shard"], "key", ["chunk", "doc_id", "h"], 4 * rows // shards).withColumnRenamed("nr", "slot")
    have = {r["shard"]: r.n for r in placed.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    quota = [rows // shards + (s < rows % shards) for s in range(shards)]
    moves, gaps = [], [[s, have.get(s, 0), quota[s]] for s in range(shards) if have.get(s, 0) < quota[s]]
    for s in range(shards):
        at, end = quota[s], have.get(s, 0)
        while at < end:
            to, free, limit = gaps[0]
            n = min(end - at, limit - free)
            moves.append((s, at, at + n, to, free - at))
            at, gaps[0][1] = at + n, free + n
            if gaps[0][1] == limit:
                gaps.pop(0)
    new_shard, new_slot = F.col("shard"), F.col("slot")
    for s, start, end, to, shift in moves:  # 2 x shards at most
        here = (F.col("shard") == s) & (F.col("slot") >= start) & (F.col("slot") < end)
        new_shard, new_slot = F.when(here, F.lit(to)).otherwise(new_shard), F.when(here, F.col("slot") + shift).otherwise(new_slot)
    return ranked.select("doc_id", "size", "text_crc32", new_shard.cast("int").alias("shard"), new_slot.cast("long").alias("slot"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir)).withColumns({"law": F.lit("rows"), "grown_shard": F.lit(None).cast("int")})
