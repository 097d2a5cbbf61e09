"""Exact dedup by skew-safe combining.

Texts are compared in full at each stage, as grouping keys beside their digest: within each task (map-side combine), among the rows of a digest's salt, and among the winners of the
salts. Only digests that a large share of all rows have are salted, so texts that occur once or a few times move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import BLANK, cut, documents, only, remove

#: A digest is salted when more rows than HOT and than 1 / SHARES of all rows have it: fewer than SHARES digests, of 32 bytes each, can.
HOT, SHARES, SALTS = 64, 4096, 16


def normalised(text: Column) -> Column:
    """Runs of blanks as one space; null as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANK, " ")


def classes(df: DataFrame, hot: int = HOT, salts: int = SALTS) -> DataFrame:
    """Rows (doc_id, keep_id, group_size, sha), one for each row of ``df`` (doc_id, text): the smallest doc_id among equal texts, and how many rows there are.

    Texts are equal when identical after replacing each run of blanks by one space; null and empty texts are equal to each other. Repeated rows each count and each get a row; a null
    doc_id is never chosen while its group has another. Other columns aren't read. An empty table gives no rows.
    """
    text = only(df, "doc_id", "text").select("doc_id", normalised(F.col("text")).alias("t")).withColumn("sha", F.unhex(F.sha2("t", 256)))
    ids = cut(text.select("doc_id", "sha", F.xxhash64("t").alias("check")))
    most = max(hot, ids.count() // SHARES)
    often = ids.groupBy("sha").agg(F.count("*").alias("times")).filter(F.col("times") > most).select("sha", F.lit(True).alias("often"))
    best = (F.min("doc_id").alias("doc_id"), F.sum("n").alias("n"))
    salt = F.when(F.col("often"), F.pmod(F.xxhash64("doc_id"), F.lit(salts))).otherwise(-1).alias("salt")
    salted = text.join(F.broadcast(often), "sha", "left").select("sha", salt, "t", "doc_id", F.lit(1).alias("n")).groupBy("sha", "salt", "t").agg(*best)
    # what isn't salted is final here, and its text is let go; salt winners keep theirs
    parts = cut(salted.select("sha", "salt", F.xxhash64("t").alias("check"), F.when(F.col("salt") >= 0, F.col("t")).alias("t"), "doc_id", "n"))
    # written, so that adaptive execution can split a hot digest in the join
    groups = cut(parts.groupBy("sha", "check", "t").agg(*best).select("sha", "check", F.col("doc_id").alias("keep_id"), F.col("n").alias("group_size")))
    remove(parts)
    return ids.join(groups, ["sha", "check"]).select("doc_id", "keep_id", "group_size", "sha")


def deduplicate(df: DataFrame) -> DataFrame:
    """The rows of ``df`` that stay, with all their columns; rows repeated as a whole stay as often as they occur."""
    kept = classes(df).filter("doc_id = keep_id").select("doc_id").distinct()
    return df.join(kept.hint("shuffle_hash"), "doc_id", "left_semi").select(df.columns)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(documents(spark, sf_dir))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


ORACLE = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
