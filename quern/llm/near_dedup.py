"""MinHash near-dedup with BagMinHash signatures: documents whose multisets of five-word shingles have a weighted Jaccard similarity of 0.8 or more, and the classes they form.

Each shingle has Poisson processes over dyadic ranges of its weight, [0, 1), [1, 2), [2, 4) and so on, with rates as wide as the ranges; a point counts for a document if it lies
under the shingle's weight there, and falls into one register of the signature. The first point of a register is the same for two documents as often as their weighted Jaccard
similarity says. Texts with equal multisets are one text from the start. Bands of registers put like texts into buckets; the texts of buckets that hang together are compared with one leader, not with
each other. Texts of buckets that still hold several parts are then joined exactly, whatever their bucket, by the first units of each text (a shingle's first, second, ... occurrence),
rare ones first: two texts that are alike share a unit among the first of both, early enough to leave room for the overlap that they need. The least text of each unit is compared with
the others, which joins most; then all pairs of texts that are still in different parts. Every link is verified on whole texts by the exact overlap of the multisets.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.fragments import STEP, Line, U, grams, mixed
from quern.llm.shared import cut, documents, mapped, only, remove

SHINGLE, LIKE = 5, 0.8
#: A pair at 0.8 misses all 24 bands of 4 registers with probability 0.0000033. Points of a process that are drawn at once.
BANDS, ROWS, POINTS = 24, 4, 4


def shingles(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a text's shingles, ascending, and how often each occurs; fewer words than a shingle are one shingle of their own."""
    x = Line(text).hashes()
    return np.unique(grams(x, min(SHINGLE, len(x))), return_counts=True) if len(x) else (x, np.zeros(0, np.int64))


def signature(shingle: np.ndarray, weight: np.ndarray, size: int) -> np.ndarray:
    """The first point of each register, as bits that tell points apart."""
    levels = np.ceil(np.log2(np.maximum(weight, 1))).astype(np.int64) + 1
    which = np.repeat(np.arange(len(shingle)), levels)
    level = np.arange(len(which)) - np.repeat(np.cumsum(levels) - levels, levels)
    rate = np.where(level > 0, 2.0 ** (level - 1), 1.0)
    low = np.where(level > 0, rate, 0.0)
    seed = mixed(shingle[which] + level.astype(U) * STEP)
    end = size * (np.log(size) + 2.0) / weight.sum()
    while True:
        first = np.full(size, np.inf)
        left, x, t = np.arange(len(which)), np.zeros(len(which)), 0
        while len(left):  # POINTS points of each process at once
            steps = np.array([(t + i) * int(STEP) & 0xFFFFFFFFFFFFFFFF for i in range(1, POINTS + 1)], U)
            t += POINTS
            draw = mixed(seed[left][:, None] + steps)
            at = x[:, None] - np.cumsum(np.log(((draw >> U(11)).astype(np.float64) + 1.0) * 2.0**-53), axis=1) / rate[left][:, None]
            row, column = np.nonzero(at <= end)
            second, of = mixed(draw[row, column] ^ STEP), left[row]
            under = low[of] + (second >> U(32)).astype(np.float64) * 2.0**-32 * rate[of] < weight[which[of]]
            np.minimum.at(first, ((second & U(0xFFFFFFFF)) % U(size)).astype(np.int64)[under], at[row, column][under])
            more = at[:, -1] <= end
            left, x = left[more], at[more, -1]
        if np.isfinite(first).all():
            return first.view(U)
        end *= 2


def signed(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    turn = mixed(np.arange(1, BANDS * ROWS + 1, dtype=U) * STEP) | U(1)
    for part in parts:
        rows = []
        for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
            s, w = shingles(text)
            bands = mixed((mixed(signature(s, w, BANDS * ROWS)) * turn).reshape(BANDS, ROWS).sum(axis=1)).view(np.int64) if len(s) else np.zeros(0, np.int64)
            rows.append((doc_id, xxhash.xxh3_128_digest(s.tobytes() + w.astype(np.int64).tobytes()), int(w.sum()), bands))
        yield pd.DataFrame(rows, columns=["doc_id", "digest", "n", "bands"])


def compared(parts: Iterator[pd.DataFrame], like: float) -> Iterator[pd.DataFrame]:
    """Compare texts x with texts y by the exact overlap of their multisets."""
    last: tuple = (None, None)
    for part in parts:
        found = []
        for a, b, x, y in zip(part["a"], part["b"], part["x"], part["y"], strict=True):
            if last[0] != b:
                last = (b, shingles(y))
            (s, w), (z, v) = shingles(x), last[1]
            _, i, j = np.intersect1d(s, z, assume_unique=True, return_indices=True)
            both = int(np.minimum(w[i], v[j]).sum())
            found.append((a, b, both >= like * (int(w.sum()) + int(v.sum()) - both) - 1e-9))
        yield pd.DataFrame(found, columns=["a", "b", "alike"])


def units(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The units of each text's multiset: its shingles, further occurrences of one under hashes of their own."""
    for part in parts:
        rows = []
        for rep, text in zip(part["rep"], part["text"], strict=True):
            s, w = shingles(text)
            again = (np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)).astype(U)
            rows.append((rep, int(w.sum()), np.where(again > 0, mixed(np.repeat(s, w) + again * STEP), np.repeat(s, w)).view(np.int64)))
        yield pd.DataFrame(rows, columns=["rep", "n", "units"])


def components(links: DataFrame) -> DataFrame:
    """Rows (node, part) for each end of links (a, b): the least node that it is connected with. Large-star and small-star rounds until nothing changes."""
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = cut(links.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        # every neighbour above a node goes to the node's least neighbour; those are written, so that adaptive execution can split the links of a hot node in the join
        near = both(edges)
        least = cut(near.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = near.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.filter("a != b").distinct())
        # and every neighbour below it too, with the node itself
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        last, edges = edges, cut(small.filter("a != b").distinct())
        remove(last, least, large)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("part")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("part")).distinct())
        seen = now


def mixed_seats(seats: DataFrame, parts: DataFrame) -> DataFrame:
    """The seats, with their part and the bucket's number k and least text, of the buckets that hold several parts."""
    sat = seats.join(parts, "rep")
    buckets = sat.groupBy("bucket").agg(F.count("*").alias("k"), F.min("rep").alias("least"), F.min("part").alias("low"), F.max("part").alias("high"))
    buckets = cut(buckets.filter("low != high").select("bucket", "k", "least"))
    out = cut(sat.join(buckets, "bucket"))
    remove(buckets)
    return out


def led(shared: DataFrame) -> DataFrame:
    """Rows (a, b): texts with the leader b of all buckets that hang together; that is the text whose buckets are fullest, as a template's are."""
    fame = shared.groupBy("rep").agg(F.sum("k").alias("fame"))
    groups = components(shared.select(F.col("rep").alias("a"), F.col("least").alias("b")))
    sat = cut(fame.join(groups.select(F.col("node").alias("rep"), F.col("part").alias("bucket")), "rep"))
    top = cut(sat.groupBy("bucket").agg(F.max("fame").alias("fame")))
    leads = cut(sat.join(top, ["bucket", "fame"]).groupBy("bucket").agg(F.min("rep").alias("b")))
    return sat.join(leads, "bucket").filter("rep != b").select(F.col("rep").alias("a"), "b").distinct()


def prefixes(texts: DataFrame, like: float) -> DataFrame:
    """Rows (unit, rep, n, at): the units of each text (rep, text) that a text like it can share first, in an order by the number of texts that have them; ``at`` counts the units before.

    Units of one text alone come first in the order and are left out.
    """
    listed = cut(mapped(texts, units, "rep long, n long, units array<long>"))
    each = listed.select("rep", "n", F.explode("units").alias("unit"))
    common = each.groupBy("unit").agg(F.count("*").alias("times")).filter("times > 1")
    kept = each.join(common, "unit").groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("times", "unit"))).alias("u"))
    first = F.slice("u", 1, F.greatest(F.lit(0), F.floor(F.col("n") * (1 - like) + 1e-6).cast("int") + 1 - (F.col("n") - F.size("u")).cast("int")))
    return cut(kept.select("rep", "n", (F.col("n") - F.size("u")).alias("alone"), F.posexplode(first).alias("i", "x")).select("x.unit", "rep", "n", (F.col("alone") + F.col("i")).alias("at")))


def candidates(heads: DataFrame, parts: DataFrame, like: float, least: bool) -> DataFrame:
    """Rows (a, b): pairs of texts of different parts that may be alike by a unit of their ``prefixes``; of each unit those with its least text only, or all.

    If the first common unit has i and j units before it, the overlap is at most what follows in either; the smaller text of a pair has it even nearer to the start.
    """
    part_of = like / (1 + like)
    sat = heads.join(parts, "rep")
    mixed_ = sat.groupBy("unit").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.min("rep").alias("lead")).filter("low != high").select("unit", "lead")
    sat = cut(sat.join(mixed_, "unit"))
    small = sat.filter(F.col("at") <= F.col("n") * (1 - 2 * part_of) + 1e-6).select("unit", F.col("rep").alias("b"), F.col("n").alias("m"), F.col("part").alias("q"), F.col("at").alias("j"))
    fit = (F.col("part") != F.col("q")) & ((F.col("m") < F.col("n")) | ((F.col("m") == F.col("n")) & (F.col("b") < F.col("rep")))) & (F.col("m") >= like * F.col("n") - 1e-6)
    room = F.least(F.col("n") - F.col("at"), F.col("m") - F.col("j")) >= part_of * (F.col("n") + F.col("m")) - 1e-6
    led_ = (F.col("rep") == F.col("lead")) | (F.col("b") == F.col("lead")) if least else F.lit(True)
    return sat.join(small, "unit").filter(fit & room & led_).select(F.col("rep").alias("a"), "b").distinct()


def verified(pairs: DataFrame, bodies: DataFrame, like: float) -> DataFrame:
    """Rows (a, b, alike) of pairs (a, b)."""
    bodied = pairs.join(bodies.select(F.col("doc_id").alias("a"), F.col("text").alias("x")), "a").join(bodies.select(F.col("doc_id").alias("b"), F.col("text").alias("y")), "b")
    return cut(mapped(bodied.select("a", "b", "x", "y"), partial(compared, like=like), "a long, b long, alike boolean"))


def joined(parts: DataFrame, links: DataFrame) -> DataFrame:
    """The parts (rep, part) after joining those that links (a, b) connect."""
    ends = links.join(parts.select(F.col("rep").alias("a"), F.col("part").alias("p")), "a").join(parts.select(F.col("rep").alias("b"), F.col("part").alias("q")), "b")
    moved = components(ends.select(F.col("p").alias("a"), F.col("q").alias("b")))
    return parts.join(moved.select(F.col("node").alias("part"), F.col("part").alias("to")), "part", "left").select("rep", F.coalesce("to", "part").alias("part"))


def near_classes(df: DataFrame, like: float = LIKE) -> DataFrame:
    """Rows (doc_id, class_id, class_size), one for each row of ``df`` (doc_id, text): documents linked by a similarity of ``like`` or more, directly or through others.

    ``class_id`` is the least doc_id of the class. Texts with equal multisets of shingles are alike; texts without words are one class. Texts of one to four words are one shingle.
    Rows repeated with one doc_id and one text are alike as any two rows are, and each counts; unlike texts have unlike ones. A row with a null doc_id is in the class of rows with
    its very shingles, and in none (null) if those have null ones too. Other columns aren't read. An empty table gives no rows.
    """
    texts = only(df, "doc_id", "text")
    rows = cut(mapped(texts, signed, "doc_id long, digest binary, n long, bands array<long>"))
    first = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")))
    bands = rows.join(first.select("digest", "rep"), "digest").filter("doc_id = rep")
    seats = bands.select("rep", F.posexplode("bands").alias("band", "h")).select("rep", F.xxhash64("band", "h").alias("bucket"))
    shared = cut(seats.groupBy("bucket").agg(F.count("*").alias("k")).filter("k > 1").select("bucket"))
    seats = cut(seats.join(shared, "bucket").select("bucket", "rep"))
    remove(shared)
    parts = cut(seats.select("rep").distinct().select("rep", F.col("rep").alias("part")))
    bodies = cut(texts.join(parts.select(F.col("rep").alias("doc_id")).hint("shuffle_hash"), "doc_id", "left_semi"))
    shared = mixed_seats(seats, parts)
    if not shared.isEmpty():
        parts = cut(joined(parts, verified(led(shared), bodies, like).filter("alike").select("a", "b")))
        # what is apart in a bucket is alike only if its units say so
        apart = mixed_seats(seats, parts).select("rep").distinct()
        heads = prefixes(bodies.select(F.col("doc_id").alias("rep"), "text").join(apart.hint("shuffle_hash"), "rep", "left_semi").dropDuplicates(["rep"]), like)
        for least in (True, False):
            found = verified(candidates(heads, parts, like, least), bodies, like)
            parts = cut(joined(parts, found.filter("alike").select("a", "b")))
    named = first.join(parts, "rep", "left").select("digest", "copies", F.coalesce("part", "rep").alias("class_id"))
    named = named.withColumn("key", F.coalesce(F.col("class_id").cast("string"), F.hex("digest")))
    sizes = cut(named.groupBy("key").agg(F.sum("copies").alias("class_size")))
    named = cut(named.join(sizes, "key").select("digest", "class_id", "class_size"))
    return rows.select("doc_id", "digest").join(named, "digest").select("doc_id", "class_id", "class_size")


def keep_one(df: DataFrame, like: float = LIKE) -> DataFrame:
    """The rows of ``df`` that stay, one of each class, with all their columns."""
    kept = near_classes(df, like).filter("doc_id = class_id").select("doc_id")
    return df.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(df.columns)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_classes(documents(spark, sf_dir))
    return found.withColumn("kept", F.col("doc_id") == F.col("class_id"))


def brute_force(rows: list[tuple[int, str | None]], like: float = LIKE) -> dict[int, int]:
    """Class of each document by comparing all pairs, for tests."""
    bags = {}
    for d, text in rows:
        w = (text or "").encode().split()
        bags[d] = Counter(tuple(w[i : i + min(SHINGLE, len(w))]) for i in range(max(1, len(w) - SHINGLE + 1))) if w else Counter()
    ids = sorted(bags)
    parent = {d: d for d in ids}

    def root(d: int) -> int:
        while parent[d] != d:
            d = parent[d]
        return d

    size = {d: sum(bags[d].values()) for d in ids}
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if bags[a] == bags[b] or (min(size[a], size[b]) >= like * max(size[a], size[b]) and (both := sum((bags[a] & bags[b]).values())) >= like * (size[a] + size[b] - both) and size[a]):
                p, q = sorted((root(a), root(b)))
                parent[q] = p
    return {d: root(d) for d in ids}


#: The same for DuckDB, by all pairs that share a shingle and a closure of links: for small tables alone.
ORACLE = rf"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
 each AS (SELECT doc_id, array_to_string(w[i:i + {SHINGLE - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - {SHINGLE - 2}, 2))) AS i FROM d WHERE len(w) > 0)),
 bag AS (SELECT doc_id, s, count(*) AS c FROM each GROUP BY ALL),
 sum_ AS (SELECT doc_id, sum(c) AS n, md5(string_agg(c || ':' || s, chr(10) ORDER BY s)) AS digest FROM bag GROUP BY doc_id),
 named AS (SELECT d.doc_id, coalesce(n, 0) AS n, min(d.doc_id) OVER (PARTITION BY coalesce(digest, '')) AS rep FROM d LEFT JOIN sum_ USING (doc_id)),
 own AS MATERIALIZED (SELECT bag.*, n FROM bag JOIN named USING (doc_id) WHERE doc_id = rep),
 link AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM own a JOIN own b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id
  HAVING sum(least(a.c, b.c)) >= {LIKE} * (any_value(a.n) + any_value(b.n) - sum(least(a.c, b.c))) - 1e-9),
 both_ AS MATERIALIZED (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
 reach(rep, other) AS (SELECT DISTINCT x, x FROM both_ UNION SELECT rep, y FROM reach JOIN both_ ON other = x),
 part AS (SELECT rep, min(other) AS class_id FROM reach GROUP BY rep)
SELECT doc_id, coalesce(class_id, rep) AS class_id, count(*) OVER (PARTITION BY coalesce(class_id, rep)) AS class_size, doc_id = coalesce(class_id, rep) AS kept FROM named LEFT JOIN part USING (rep)
"""
