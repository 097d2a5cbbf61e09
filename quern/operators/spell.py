"""Spelling correction by shared k-grams and edit distance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.tokens import edit_distance, kgrams
from quern.operators.index import Index

JACCARD, DISTANCE, K = 0.4, 2, 2


def grams_of(word: str, k: int = K) -> list[str]:
    marked = f"^{word}$"
    return sorted({marked[i : i + k] for i in range(len(marked) - k + 1)})


def jaccard(terms: DataFrame, word: str, k: int = K) -> DataFrame:
    """Rows (term, jaccard) of terms that share a gram: the word's different grams against all of the term's, repeated ones counted each time."""
    wanted = grams_of(word, k)
    grams = kgrams(F.col("term"), k)
    shared = F.size(F.filter(grams, lambda g: g.isin(wanted)))
    counted = terms.withColumn("shared", shared).filter("shared > 0")
    return counted.withColumn("jaccard", F.col("shared") / (len(wanted) + F.size(grams) - F.col("shared"))).drop("shared")


def sharing(index: Index, word: str, k: int = K) -> DataFrame:
    """Rows (term, df) of terms that share a k-gram with the word, by the k-gram index, and whose length is near enough for the edit distance."""
    near = index.grams.filter(F.col("gram").isin(grams_of(word, k)) & F.length("term").between(len(word) - DISTANCE, len(word) + DISTANCE))
    return index.terms.select("term", "df").join(near.select("term").distinct(), "term", "left_semi")


def candidates(terms: DataFrame, word: str, k: int = K) -> DataFrame:
    """Rows (term, jaccard, distance, df, score), from terms (term, df): near enough by grams, then by edit distance; score is df / jaccard / distance."""
    near = jaccard(terms, word, k).filter(F.col("jaccard") >= JACCARD).filter(F.levenshtein("term", F.lit(word)) <= DISTANCE)
    scored = near.withColumn("distance", edit_distance(F.col("term"), F.lit(word))).filter((F.col("distance") <= DISTANCE) & (F.col("distance") > 0))
    return scored.withColumn("score", F.col("df") / F.col("jaccard") / F.col("distance"))


def best(index: Index, word: str, limit: int) -> list[tuple[str, float]]:
    """Up to ``limit`` corrections of a word, best first; the word alone, with score 1, if it is a term."""
    if not index.terms.filter(F.col("term") == word).isEmpty():
        return [(word, 1.0)]
    return [(r.term, r.score) for r in candidates(sharing(index, word), word).orderBy(F.desc("score"), "term").limit(limit).collect()]


def check(index: Index, query: str, limit: int = 10) -> DataFrame:
    """Rows (suggestion, score): corrections of a query, best first. For several words the better half of each word's is combined, and sums are multiplied by the documents with all words."""
    words = query.lower().split()
    spark = index.terms.sparkSession
    lists = [best(index, w, 10 * limit) for w in words]
    if len(lists) == 1:
        return spark.createDataFrame(lists[0][:limit], "suggestion string, score double")
    half = [part[: min(len(part) // 2 + 1, limit // 2 + 1)] for part in lists]
    phrases: list[tuple[tuple[str, ...], float]] = [((), 0.0)] if half else []
    for part in half:
        phrases = [((*p, w), s + t) for p, s in phrases for w, t in part]
    rows = spark.createDataFrame([(" ".join(p), s, list(p)) for p, s in phrases], "suggestion string, score double, words array<string>")
    used = sorted({w for p, _ in phrases for w in p})
    # documents with all words of each phrase, for all phrases in one aggregation
    held = index.postings.filter(F.col("term").isin(used)).groupBy("doc_id").agg(F.collect_set("term").alias("have"))
    # the phrases, at most (limit / 2 + 1) to the number of words, are matched within each document's row
    listed = F.array(*[F.struct(F.lit(" ".join(p)).alias("s"), F.array(*map(F.lit, p)).alias("w")) for p, _ in phrases]) if phrases else None
    if listed is None:
        return spark.createDataFrame([], "suggestion string, score double")
    fits = held.select(F.explode(F.filter(listed, lambda x: F.size(F.array_except(x["w"], F.col("have"))) == 0)).alias("x")).groupBy(F.col("x.s").alias("suggestion")).agg(F.count("*").alias("n"))
    joined = rows.join(fits, "suggestion", "left").select("suggestion", (F.col("score") * F.coalesce("n", F.lit(0))).alias("score"))
    return joined.orderBy(F.desc("score"), "suggestion").limit(limit)


def displayed(suggestions: DataFrame, longest: int = 50) -> DataFrame:
    """With a column shown: suggestions as they are listed, cut with three dots after ``longest`` characters."""
    text = F.col("suggestion")
    return suggestions.withColumn("shown", F.when(F.length(text) > longest, F.concat(F.substring(text, 1, longest), F.lit("..."))).otherwise(text))
