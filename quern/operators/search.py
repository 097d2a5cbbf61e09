"""Boolean, phrase, wildcard and ranked search, and relevance feedback."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.tokens import basename
from quern.operators import graph, index
from quern.plans.query import Query, QueryType, RankingType, any_of, places

#: Weights of tf-idf and PageRank in a combined score, and of the query and of relevant documents in feedback.
TF_IDF, PAGERANK, ALPHA, BETA = 0.4, 0.6, 0.2, 0.8


def placed(found: DataFrame, query: Query) -> DataFrame:
    """Occurrences of the query's words, with the place of each; wildcards stand for every term that fits."""
    return found.filter(any_of(query.words, F.col("term"))).select("doc_id", "offset", "term", F.explode(places(query.words, F.col("term"))).alias("pos"))


def intersection(found: DataFrame, query: Query) -> DataFrame:
    """Documents (doc_id) with all words."""
    return placed(found, query).groupBy("doc_id").agg(F.countDistinct("pos").alias("n")).filter(F.col("n") == len(query)).select("doc_id")


def phrase(found: DataFrame, query: Query) -> DataFrame:
    """Documents with all words one after another, and the last word's last offset: occurrences that would start the phrase at one place meet there, in one shuffle."""
    starts = placed(found, query).groupBy("doc_id", (F.col("offset") - F.col("pos")).alias("start")).agg(F.countDistinct("pos").alias("n")).filter(F.col("n") == len(query))
    return starts.groupBy("doc_id").agg((F.max("start") + len(query) - 1).cast("int").alias("last_offset"))


def union(found: DataFrame, query: Query) -> DataFrame:
    """Documents with any word, and how many different words they have."""
    return placed(found, query).groupBy("doc_id").agg(F.countDistinct("term").alias("n_terms"))


def expanded(index_: index.Index, query: Query) -> dict[str, float] | DataFrame:
    """Weights of a query's terms; with wildcards each term that fits counts once, and all weights are 1. Rows (term, weight) where those are many."""
    if query.has_wildcard:
        terms = index_.wanted(query.words)
        return dict.fromkeys(terms, 1.0) if isinstance(terms, list) else terms.withColumn("weight", F.lit(1.0))
    weights: dict[str, float] = {}
    for term, weight in query.terms:
        weights[term] = weights.get(term, 0.0) + weight
    return weights


def tf_idf(index_: index.Index, weights: dict[str, float] | DataFrame) -> DataFrame:
    """Rows (doc_id, score) with scores above 0: weighted sums of tf ln(N / df), over the document's length. Reads the postings and dictionary entries of the weighted terms."""
    lists, terms = index_.postings.select("term", "doc_id", "tf"), index_.terms.select("term", "df")
    if isinstance(weights, dict):
        lists, terms = (x.filter(F.col("term").isin(list(weights))) for x in (lists, terms))
        weights = index_.terms.sparkSession.createDataFrame(list(weights.items()), "term string, weight double")
    n = index_.documents.agg(F.count("*").alias("n"))  # one row
    factors = terms.join(weights, "term").crossJoin(F.broadcast(n)).select("term", (F.col("weight") * F.log(F.col("n") / F.col("df"))).alias("factor"))
    sums = lists.join(factors, "term").groupBy("doc_id").agg(F.sum(F.col("factor") * F.col("tf")).alias("part"))
    return sums.join(index_.documents.select("doc_id", "doc_len"), "doc_id").select("doc_id", (F.col("part") / F.col("doc_len")).alias("score")).filter("score > 0")


def by_pagerank(scores: DataFrame, docs: DataFrame, ranks: DataFrame) -> DataFrame:
    """Rows (doc_id, score, rank): the PageRank of each document, found by its file name as title; 0 where there is none."""
    named = scores.join(docs.select("doc_id", basename(F.col("doc_name")).alias("title")), "doc_id")
    return named.join(ranks.select("title", F.col("score").alias("rank")), "title", "left").select("doc_id", "score", F.coalesce("rank", F.lit(0.0)).alias("rank"))


def top(results: DataFrame, k: int | None = None, skip: int = 0) -> DataFrame:
    """Best first, ties by doc_id; k of them after the first ``skip``."""
    ordered = results.orderBy(F.desc("score"), F.asc("doc_id"))
    ordered = ordered.offset(skip) if skip else ordered
    return ordered if k is None else ordered.limit(k)


def feedback_weights(found: DataFrame, query: Query, relevant: list[int], alpha: float = ALPHA, beta: float = BETA, strict: bool = False) -> DataFrame:
    """Rows (term, weight): the query's weights over their sum, times alpha, plus beta times the terms' counts in the relevant documents.

    ``strict`` divides each weight by the sum as it is after the weights before it were divided, and lets the last of equal terms stand.
    """
    weights = [w for _, w in query.terms]
    for i in range(len(weights)):
        weights[i] = weights[i] / sum(weights) if strict else query.terms[i][1] / query.length
    kept: dict[str, float] = {}
    for (term, _), w in zip(query.terms, weights, strict=True):
        kept[term] = alpha * w + (0.0 if strict else kept.get(term, 0.0))
    asked = found.sparkSession.createDataFrame(list(kept.items()), "term string, weight double")
    counted = found.filter(F.col("doc_id").isin(relevant)).groupBy("term").agg((F.count("*") * beta).alias("weight"))
    return asked.unionByName(counted).groupBy("term").agg(F.sum("weight").alias("weight"))


@dataclass
class SearchEngine:
    """Searches an index, with the documents' link graph and its ranks if there are any."""

    index: index.Index
    edges: DataFrame | None = None
    nodes: DataFrame | None = None
    ranks: DataFrame | None = None

    @staticmethod
    def over(docs: DataFrame, edges: DataFrame | None = None, nodes: DataFrame | None = None, ranks: DataFrame | None = None, **flags: object) -> SearchEngine:
        """An engine over documents (doc_id, doc_name, text) without a saved index."""
        return SearchEngine(index.Index.over(docs, **flags), edges, nodes, ranks)

    @staticmethod
    def load(spark: SparkSession, path: str, edges: DataFrame | None = None, nodes: DataFrame | None = None, ranks: DataFrame | None = None) -> SearchEngine:
        """An engine over a saved index; no text is read again."""
        return SearchEngine(index.Index.load(spark, path), edges, nodes, ranks)

    def occurrences(self, query: Query) -> DataFrame:
        """Occurrences of the terms that the query's words stand for."""
        return self.index.occurrences(self.index.wanted(query.words))

    def search(self, text: str | Query, kind: QueryType = QueryType.INTERSECTION, ranking: RankingType = RankingType.TF_IDF) -> DataFrame:
        query = text if isinstance(text, Query) else Query.parse(text)
        if kind is QueryType.INTERSECTION:
            return intersection(self.occurrences(query), query)
        if kind is QueryType.PHRASE:
            return phrase(self.occurrences(query), query)
        if ranking is RankingType.HITS:
            return self.hits(query)
        scores = tf_idf(self.index, expanded(self.index, query))
        if ranking is RankingType.TF_IDF:
            return scores
        ranked = by_pagerank(scores, self.index.documents, self.ranks)
        if ranking is RankingType.PAGERANK:
            return ranked.select("doc_id", F.col("rank").alias("score"))
        return ranked.select("doc_id", (TF_IDF * F.col("score") + PAGERANK * F.col("rank")).alias("score"))

    def hits(self, query: Query, steps: int | None = None) -> DataFrame:
        """Hub plus authority of each document of the base set around those with any word; node ids are doc_ids."""
        root = union(self.occurrences(query), query).select(F.col("doc_id").alias("node_id"))
        edges, nodes = graph.base_set(self.edges, root, self.nodes)
        both = graph.hits(edges, nodes, steps=steps)
        return both.join(self.index.documents.select(F.col("doc_id").alias("node_id")), "node_id").select(F.col("node_id").alias("doc_id"), (F.col("hub") + F.col("authority")).alias("score"))

    def needs_spellcheck(self, text: str) -> bool:
        """Whether the first word isn't in the index; a later missing word only makes the result empty."""
        query = Query.parse(text)
        return bool(len(query)) and not query.has_wildcard and self.index.terms.filter(F.col("term") == query.words[0]).isEmpty()
