"""Substring dedup: repeated passages of words, found as repeated paths of a De Bruijn graph of word windows.

Each window of ``k`` words is an edge between the nodes of its first and its last ``k - 1`` words. Edges are told apart in parts of the graph by their minimisers, as large graphs are
built: consecutive edges of a document with one anchor are a path, and only paths whose anchor occurs again can repeat. Equal paths are one; joins with the table of nodes and their
degrees compact the repeated paths that meet at nodes with one way in and one way out; and only where an anchor has several paths (the graph branches) are single edges compared.

Digests find what repeats; words decide. Each span that would go is looked up at its source coordinates (document, first word), block by block of the source, so that a source is quoted
once however many spans come from it; and it goes only if the words there are the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.fragments import Line, Words, anchors, classes_of, covered, later, occurrences, spans_to_text, windows_apart
from quern.llm.shared import cut, documents, mapped, release, remove

#: Words of a window, of a minimiser, and of a block of a source.
K, M, QUOTE = 20, 6, 32


def nodes(paths: DataFrame) -> DataFrame:
    """Rows (node, ways_in, ways_out) of the ends of paths (head, tail)."""
    ends = paths.select(F.col("head").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(paths.select(F.col("tail").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o")))
    return ends.groupBy("node").agg(F.sum("i").alias("ways_in"), F.sum("o").alias("ways_out"))


def compacted(paths: DataFrame) -> DataFrame:
    """The repeated paths (anchor, content, first, head, tail) as (anchor, content, source, source_start, origin): where the path's first occurrence is, and the first word there of the
    compacted path that it belongs to. A path goes on with the next one of its source if the node between them has one way in and one way out."""
    simple = nodes(paths).filter("ways_in = 1 AND ways_out = 1").select("node")
    ended = paths.select(F.col("tail").alias("node"), F.col("first.doc_id").alias("source"), (F.col("first.start") + F.col("first.n")).alias("source_start")).join(simple, "node")
    begun = paths.select("anchor", "content", F.col("head").alias("node"), F.col("first.doc_id").alias("source"), F.col("first.start").alias("source_start"))
    joined = begun.join(ended.withColumn("goes_on", F.lit(True)), ["node", "source", "source_start"], "left")
    origin = F.last(F.when(F.col("goes_on").isNull(), F.col("source_start")), ignorenulls=True).over(Window.partitionBy("source").orderBy("source_start"))
    return joined.withColumn("origin", origin).drop("node", "goes_on")


def joined_up(pieces: DataFrame) -> DataFrame:
    """Spans (doc_id, start, n, source, source_start) from pieces of them that follow each other in the document as they do on one compacted path of their source."""
    line = Window.partitionBy("doc_id", "source", "origin", F.col("start") - F.col("source_start")).orderBy("start")
    fresh = F.coalesce((F.lag(F.col("start") + F.col("n")).over(line) < F.col("start")).cast("int"), F.lit(1))
    numbered = pieces.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    spans = numbered.groupBy("doc_id", "source", "origin", (F.col("start") - F.col("source_start")).alias("shift"), "run").agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"))
    return spans.select("doc_id", "start", (F.col("end") - F.col("start")).cast("int").alias("n"), "source", (F.col("start") - F.col("shift")).alias("source_start"))


def quoted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The words of the listed blocks of each document, joined by one space."""
    columns = ["source", "block", "words"]
    for batch in batches:
        rows, size = [], 0
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            words = Words.plain(text)
            for block in spans:
                rows.append((doc_id, block, words.quote(block * QUOTE, (block + 1) * QUOTE)))
                size += len(rows[-1][2])
                if size > 8_000_000:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        yield pd.DataFrame(rows, columns=columns)


def verified(words: Line, quotes: list | np.ndarray, k: int) -> list[dict]:
    """The spans (start, n) of a document whose words are those of their source in every block that they reach into; quotes are ``start:n:source_start:block:words``."""
    spans: dict[tuple[int, int, int], bool] = {}
    for q in quotes:
        *numbers, there = q.split(b":", 4)
        start, n, source_start, block = map(int, numbers)
        first = block * QUOTE
        low, high = max(first, source_start), min(first + QUOTE, source_start + n + k - 1)
        if high - low < QUOTE:
            there = b" ".join(there.split(b" ")[low - first : high - first])
        same = words.quote(start + low - source_start, start + high - source_start) == there
        spans[start, n, source_start] = spans.get((start, n, source_start), True) and same
    return [{"start": start, "n": n} for (start, n, _), same in spans.items() if same]


def repeated_passages(df: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Rows (doc_id, start, n, source_start, block, words): ``n`` windows of ``k`` words, from word ``start`` on, whose words also start earlier (smaller doc_id, or an earlier word);
    a row for each block of the source that they reach into, with its words, joined by one space.

    ``df`` has doc_id and text; null and empty texts have no window, nor have texts under ``k`` words. Rows with a null doc_id have none either; of rows repeated with one doc_id none
    is earlier than the other. Other columns aren't read. An empty table gives no rows.
    """
    again = cut(anchors(df, Words, k, m).groupBy("anchor").agg(F.count("*").alias("times")).filter("times > 1").select("anchor"))
    release(df.sparkSession)
    found = cut(occurrences(df, Words, k, m).join(again.hint("shuffle_hash"), "anchor"))
    remove(again)
    release(df.sparkSession)
    classes, paths = classes_of(found, keep_first=True)
    repeated = cut(compacted(classes.filter("times > 1")))
    whole = found.join(repeated.hint("shuffle_hash"), ["anchor", "content"]).filter(later("source", "source_start")).select("doc_id", "start", "n", "source", "source_start", "origin")
    edges = windows_apart(df, paths, Words, k)
    release(df.sparkSession)
    # few edges repeat: the first of each is looked for among those alone
    met = edges.groupBy("digest").agg(F.count("*").alias("times")).filter("times > 1").select("digest")
    again = cut(edges.join(met.hint("shuffle_hash"), "digest"))
    first = again.groupBy("digest").agg(F.min(F.struct("doc_id", "start")).alias("first")).select("digest", "first.doc_id", "first.start").toDF("digest", "source", "source_start")
    single = again.join(cut(first).hint("shuffle_hash"), "digest").filter(later("source", "source_start")).select("doc_id", "start", F.lit(1).alias("n"), "source", "source_start", F.lit(-1).cast("long").alias("origin"))
    spans = cut(joined_up(whole.unionByName(single)))
    remove(found, classes, paths, repeated, edges, again)
    release(df.sparkSession)
    block = lambda at: F.floor(at / QUOTE)
    asked = spans.withColumn("block", F.explode(F.sequence(block(F.col("source_start")), block(F.col("source_start") + F.col("n") + k - 2))))
    words = cut(mapped(spans_to_text(df, asked.select(F.col("source").alias("doc_id"), "block").distinct(), "inner"), quoted, "source long, block long, words binary"))
    release(df.sparkSession)
    return asked.join(words.hint("shuffle_hash"), ["source", "block"]).select("doc_id", "start", "n", "source_start", "block", "words")


def drop_passages(df: DataFrame, k: int = K, m: int = M) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, text), one for each row of ``df``: the words left, joined by one space; the text is null where it was null."""

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
                words = Words.plain(text)
                gone = covered([] if spans is None else verified(words, spans, k), len(words), k)
                kept = words.data if not gone.any() else b" ".join(w for w, x in zip(words.data.split(b" "), gone.tolist(), strict=True) if not x)
                rows.append((doc_id, len(words), int(gone.sum()), None if text is None else kept.decode("utf-8", "surrogatepass")))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_removed", "text"])

    quotes = F.concat(F.encode(F.concat_ws(":", "start", "n", "source_start", "block", F.lit("")), "utf-8"), "words")  # flat, as lists of structs are slow to hand over
    return mapped(spans_to_text(df, repeated_passages(df, k, m).select("doc_id", quotes.alias("quote")), "left"), finish, "doc_id long, n_words long, n_removed long, text string")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_passages(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, str | None]], k: int = K) -> dict[int, tuple[int, int, str]]:
    """The same by comparing all windows, for tests."""
    first: dict[tuple, tuple[int, int]] = {}
    out = {}
    for doc_id, text in sorted(rows):
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            if first.setdefault(tuple(words[i : i + k]), (doc_id, i)) != (doc_id, i):
                gone[i : i + k] = [True] * k
        kept = b" ".join(w for w, x in zip(words, gone, strict=True) if not x)
        out[doc_id] = (len(words), sum(gone), hashlib.sha256(kept).hexdigest())
    return out


#: The same for DuckDB, which keeps a row for each window: for small tables alone.
ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
 win AS (SELECT doc_id, i, array_to_string(words[i:i + 19], ' ') AS t FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 18, 1))) AS i FROM w)),
 rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
 gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, (SELECT unnest(range(0, 20)) AS j)),
 lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
 word AS (SELECT doc_id, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS p FROM w),
 kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY word.doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM w LEFT JOIN lost USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
