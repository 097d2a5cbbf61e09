"""Suffix-array dedup: repeated byte strings, found with a logarithmic family of sparse suffix arrays.

The suffixes indexed are those that start at anchors: every string of ``k`` bytes holds an anchor that depends on its bytes alone, so equal strings have indexed suffixes at equal
places, ``m`` bytes or more before their end. A new batch of documents becomes a suffix array: its suffixes, by their first DEPTH bytes, in order. It is merge-scanned with all existing
levels: in the common order, what a suffix shares with any other is what it shares with its neighbours, so one pass gives each suffix its longest common prefix. In the same pass levels
of one size merge into the next, so after ``b`` batches there are at most log2(b) + 1, and a suffix is rewritten as often at most.

A string that repeats needs a suffix whose common prefix reaches its end; that leaves few places. There, whole contents are compared: fragments, then blocks, then single strings, by
digests of 128 bits.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import partial, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.fragments import Bytes, anchors, classes_of, covered, occurrences, pieces, spans_to_text, windows_apart
from quern.llm.shared import cut, documents, mapped, only, release, remove

#: Bytes of a string, of an anchor and of an indexed suffix; strings in a block; batches that a table is dealt to.
K, M, DEPTH, BLOCK, BATCHES = 200, 32, 64, 16, 3


def scanned(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[pa.RecordBatch]:
    """One pass over suffixes in order, rows (suffix, times, own): equal ones merge into one row, with sums of ``times`` and ``own``, and with ``reach``, the longest common prefix with
    any other suffix; that is ``depth`` if the suffix occurs twice or more."""
    rest = np.zeros((0, depth), np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before = 0  # what the last suffix, which may go on, shares with the one before it

    def merged(rows: np.ndarray, times: np.ndarray, own: np.ndarray, reach: np.ndarray) -> pa.RecordBatch:
        suffix = pa.FixedSizeBinaryArray.from_buffers(pa.binary(depth), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows))]).cast(pa.binary())
        return pa.RecordBatch.from_arrays([suffix, pa.array(times), pa.array(own), pa.array(np.where(times > 1, depth, reach).astype(np.int32))], names=["suffix", "times", "own", "reach"])

    for batch in batches:
        if not batch.num_rows:
            continue
        read = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint8).reshape(-1, depth), np.asarray(batch.column(1)), np.asarray(batch.column(2))
        rows, times, own = (np.concatenate(x) for x in zip(rest, read, strict=True))
        begin = np.flatnonzero(np.concatenate(([True], (rows[1:] != rows[:-1]).any(axis=1))))
        rows, times, own = rows[begin], np.add.reduceat(times, begin), np.add.reduceat(own, begin)
        common = np.concatenate(([before], (rows[1:] != rows[:-1]).argmax(axis=1)))
        rest, before = (rows[-1:], times[-1:], own[-1:]), int(common[-1])
        if len(rows) > 1:
            yield merged(rows[:-1], times[:-1], own[:-1], np.maximum(common[:-1], common[1:]))
    if len(rest[0]):
        yield merged(*rest, np.array([before]))


class SuffixIndex:
    """Levels of sparse suffix arrays, tables (suffix, times) in order; level ``i`` holds 2^i batches."""

    def __init__(self, depth: int = DEPTH, least: int = M) -> None:
        self.depth, self.least = depth, least
        self.levels: dict[int, DataFrame] = {}
        self.last: DataFrame | None = None

    def add(self, suffixes: DataFrame) -> None:
        """Index a batch (suffix, times), a written table, which may be empty and hold a suffix in several rows. One pass sorts it, scans it with all levels, and merges those of its size."""
        size, merging = 0, [suffixes]
        while size in self.levels:
            merging.append(self.levels.pop(size))
            size += 1
        rows = [x.select("suffix", "times", F.col("times").alias("own")) for x in merging] + [x.select("suffix", "times", F.lit(0).cast("long").alias("own")) for x in self.levels.values()]
        # suffixes that share ``least`` bytes come into one part, where they are neighbours; equal ones were counted before
        ordered = reduce(DataFrame.unionByName, rows).repartitionByRange(F.substring("suffix", 1, self.least)).sortWithinPartitions("suffix")
        scan = cut(ordered.mapInArrow(partial(scanned, depth=self.depth), "suffix binary, times long, own long, reach int"))
        self.levels[size] = scan.filter("own > 0").select("suffix", F.col("own").alias("times"))
        self.last = scan
        remove(*merging)

    def repeated(self) -> DataFrame:
        """Rows (suffix, reach): the hash of each suffix that shares ``least`` bytes or more with another, and how many (``depth`` at most). The levels go, as nothing more is added."""
        out = cut(self.last.filter(F.col("reach") >= self.least).select(F.xxhash64("suffix").alias("suffix"), "reach").groupBy("suffix").agg(F.max("reach").alias("reach")))
        remove(*self.levels.values())
        self.levels = {}
        return out


def repeated_strings(df: DataFrame, k: int = K, m: int = M, batches: int = BATCHES, depth: int = DEPTH) -> DataFrame:
    """Rows (doc_id, start, n): ``n`` windows of ``k`` bytes from byte ``start`` on that also start anywhere else, overlaps included.

    ``df`` has doc_id and text; null, empty and shorter texts have no window, and neither have rows with a null doc_id. Rows repeated with one doc_id count each, so that what they share
    is repeated. Documents are dealt to ``batches`` by a hash of doc_id. Other columns aren't read. An empty table gives no rows.
    """
    spark, index, docs = df.sparkSession, SuffixIndex(depth, m), only(df, "doc_id", "text")
    for batch in range(batches):
        index.add(cut(anchors(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(batches)) == batch), Bytes, k, m, depth)))
        release(spark)
    repeated = index.repeated()
    # a window ends k bytes after its start, which is ``at`` bytes or less before the anchor
    long = (F.col("reach") >= depth) | (F.col("at") + F.col("reach") >= k)
    found = cut(occurrences(docs, Bytes, k, m, depth).join(repeated.hint("shuffle_hash"), "suffix").filter(long).drop("suffix", "reach"))
    remove(repeated)
    release(spark)
    wholes, read, parts = [], [found], found
    schema = "anchor binary, content binary, doc_id long, start long, n int, at int"
    for last in (False, True):
        classes, paths = classes_of(parts, keep_first=False)
        read += [classes, paths]
        wholes.append(parts.join(classes.filter("times > 1").select("anchor", "content").hint("shuffle_hash"), ["anchor", "content"]).select("doc_id", "start", "n"))
        if not last:
            parts = cut(mapped(spans_to_text(docs, paths, "inner"), partial(pieces, kind=Bytes, k=k, block=min(BLOCK, k - m + 1)), schema))
            read.append(parts)
            release(spark)
    edges = windows_apart(docs, paths, Bytes, k)
    met = cut(edges.groupBy("digest").agg(F.count("*").alias("times")).filter("times > 1").select("digest"))
    spans = cut(reduce(DataFrame.unionByName, [*wholes, edges.join(met.hint("shuffle_hash"), "digest").select("doc_id", "start", F.lit(1).alias("n"))]))
    remove(*read, edges, met)
    release(spark)
    return spans


def drop_strings(df: DataFrame, k: int = K, m: int = M, batches: int = BATCHES) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept): the bytes left, which may end within a character."""

    def finish(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = []
            for doc_id, text, spans in zip(part["doc_id"], part["text"], part["spans"], strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                gone = covered(spans, len(data), k).tobytes()
                runs, kept, at = 0, [], 0
                while (begin := gone.find(1, at)) >= 0:
                    kept.append(data[at:begin])
                    end = gone.find(0, begin)
                    at, runs = (len(data) if end < 0 else end), runs + 1
                kept.append(data[at:])
                left = b"".join(kept)
                rows.append((doc_id, len(data), len(data) - len(left), runs, left))
            yield pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return mapped(spans_to_text(df, repeated_strings(df, k, m, batches), "left"), finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_strings(documents(spark, sf_dir)).withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


def brute_force(rows: list[tuple[int, str | None]], k: int = K) -> dict[int, tuple[int, int, int, str]]:
    """The same by counting all windows, for tests."""
    texts = {d: (t or "").encode() for d, t in rows}
    times = Counter(b[i : i + k] for b in texts.values() for i in range(len(b) - k + 1))
    out = {}
    for d, b in texts.items():
        gone = bytearray(len(b))
        for i in range(len(b) - k + 1):
            if times[b[i : i + k]] > 1:
                gone[i : i + k] = b"\1" * k
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1])), hashlib.sha256(kept).hexdigest())
    return out


#: The same for DuckDB, which keeps a row for each window: for small tables alone. Bytes are pairs of hexadecimal digits.
ORACLE = """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, ''))::BIGINT AS n FROM documents),
 win AS (SELECT doc_id, i, md5(h[2 * i + 1:2 * i + 400]) AS w FROM (SELECT doc_id, h, unnest(range(0, greatest(n - 199, 0))) AS i FROM b)),
 rep AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY w) > 1),
 fresh AS (SELECT doc_id, i, CASE WHEN lag(i) OVER (PARTITION BY doc_id ORDER BY i) >= i - 200 THEN 0 ELSE 1 END AS f FROM rep),
 run AS (SELECT doc_id, min(i) AS s, max(i) + 200 AS e FROM (SELECT doc_id, i, sum(f) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM fresh) GROUP BY doc_id, r),
 gap AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS p FROM run),
 cutout AS (SELECT gap.doc_id, sum(e - s)::BIGINT AS gone, count(*) AS spans, string_agg(h[2 * p + 1:2 * s], '' ORDER BY s) AS head, max(e) AS e FROM gap JOIN b USING (doc_id) GROUP BY gap.doc_id)
SELECT b.doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE head || h[2 * e + 1:] END)) AS kept_sha256
FROM b LEFT JOIN cutout USING (doc_id)
"""
