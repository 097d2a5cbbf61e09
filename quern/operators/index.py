"""Building an inverted index and its statistics, and saving it for searches."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.tokens import kgrams, tokens
from quern.sources.tables import remove, settle

#: Terms that a query's wildcards stand for are listed in its filter up to so many, and joined beyond.
LISTED = 1_000


def occurrences(docs: DataFrame, **flags: object) -> DataFrame:
    """Rows (term, doc_id, offset) of each token; ``flags`` as for ``tokens``."""
    return docs.select("doc_id", F.posexplode(tokens(F.col("text"), **flags)).alias("offset", "term")).select("term", "doc_id", "offset")


def inverted_index(found: DataFrame) -> DataFrame:
    """Rows (term, doc_id, tf, offsets) with offsets ascending."""
    return found.groupBy("term", "doc_id").agg(F.count("*").cast("int").alias("tf"), F.sort_array(F.collect_list("offset")).alias("offsets"))


def postings(docs: DataFrame, **flags: object) -> DataFrame:
    """The rows of ``inverted_index`` from documents with unlike doc_ids: each document's tokens are grouped within its own row, so nothing is shuffled."""

    def grouped(seats: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), F.size(seats) - 1), lambda i: (i == 0) | (F.get(seats, i)["t"] != F.get(seats, i - 1)["t"]))
        part = lambda b, i, j: F.transform(F.slice(seats, i + 1, F.coalesce(F.get(b, j + 1), F.size(seats)) - i), lambda x: x["i"])
        lists = lambda b: F.transform(b, lambda i, j: F.struct(F.get(seats, i)["t"].alias("term"), part(b, i, j).alias("offsets")))
        return F.transform(F.array(begins), lists)[0]

    seated = F.sort_array(F.transform(tokens(F.col("text"), **flags), lambda t, i: F.struct(t.alias("t"), i.alias("i"))))
    rows = docs.select("doc_id", seated.alias("seats")).filter(F.size("seats") > 0)
    rows = rows.select("doc_id", F.explode(F.transform(F.array("seats"), grouped)[0]).alias("p"))
    return rows.select("p.term", "doc_id", F.size("p.offsets").alias("tf"), "p.offsets")


def dictionary(lists: DataFrame) -> DataFrame:
    """Rows (term, df, cf) from postings, in one shuffle of sums."""
    return lists.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))


def doc_lengths(docs: DataFrame, **flags: object) -> DataFrame:
    """Rows (doc_id, doc_len), with 0 for documents without tokens."""
    return docs.select("doc_id", F.size(tokens(F.col("text"), **flags)).alias("doc_len"))


def term_frequency(found: DataFrame) -> DataFrame:
    """Rows (term, doc_id, tf)."""
    return found.groupBy("term", "doc_id").agg(F.count("*").alias("tf"))


def document_frequency(found: DataFrame) -> DataFrame:
    """Rows (term, df)."""
    return term_frequency(found).groupBy("term").agg(F.count("*").alias("df"))


def term_dictionary(found: DataFrame) -> DataFrame:
    """Rows (term, df, cf): in how many documents, and how often, a term occurs. The term itself is its key."""
    return term_frequency(found).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def kgram_index(terms: DataFrame, k: int = 2) -> DataFrame:
    """Distinct rows (gram, term) of distinct terms."""
    return terms.select("term", F.explode(F.array_distinct(kgrams(F.col("term"), k))).alias("gram")).select("gram", "term")


def kgram_lookup(grams: DataFrame, wanted: list[str]) -> DataFrame:
    """Terms that have all the wanted grams."""
    if len({len(g) for g in wanted}) > 1:
        raise ValueError("grams of different lengths")
    found = grams.filter(F.col("gram").isin(wanted)).groupBy("term").agg(F.countDistinct("gram").alias("n"))
    return found.filter(F.col("n") == len(set(wanted))).select("term")


def merge(*postings: DataFrame) -> DataFrame:
    """One index from several: the same rows as a single build of all their documents."""
    whole = postings[0]
    for more in postings[1:]:
        whole = whole.unionByName(more)
    merged = whole.groupBy("term", "doc_id").agg(F.sort_array(F.array_distinct(F.flatten(F.collect_list("offsets")))).alias("offsets"))
    return merged.select("term", "doc_id", F.size("offsets").alias("tf"), "offsets")


def intersect(a: DataFrame, b: DataFrame) -> DataFrame:
    """Documents of both posting lists."""
    return a.select("doc_id").distinct().join(b.select("doc_id"), "doc_id", "left_semi")


@dataclass(frozen=True)
class Index:
    """Postings (term, doc_id, tf, offsets), dictionary (term, df, cf), its k-grams (gram, term), and documents (doc_id, doc_name, doc_len)."""

    postings: DataFrame
    terms: DataFrame
    grams: DataFrame
    documents: DataFrame

    @staticmethod
    def over(docs: DataFrame, **flags: object) -> Index:
        """The index of documents (doc_id, doc_name, text), not saved: each use reads the texts anew."""
        lists = postings(docs, **flags)
        terms = dictionary(lists)
        return Index(lists, terms, kgram_index(terms), docs.select("doc_id", "doc_name", F.size(tokens(F.col("text"), **flags)).alias("doc_len")))

    def save(self, path: str) -> None:
        """Write all four tables, each sorted by what it is looked up by; lists of frequent terms are cut by doc_id, so that none lies in one task."""
        spark, written = self.postings.sparkSession, settle(self.postings)  # a range partitioning reads its input twice: not the texts
        save_postings(written, f"{path}/postings")
        remove(written)
        terms = spark.read.parquet(f"{path}/postings").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").cast("long").alias("cf"))
        terms.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/terms")
        grams = kgram_index(spark.read.parquet(f"{path}/terms"))
        grams.repartitionByRange("gram", "term").sortWithinPartitions("gram", "term").write.mode("overwrite").parquet(f"{path}/grams")
        self.documents.write.mode("overwrite").parquet(f"{path}/documents")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Index:
        """A saved index; filters on terms, grams and documents reach the scans."""
        return Index(*[spark.read.parquet(f"{path}/{name}") for name in ("postings", "terms", "grams", "documents")])

    def occurrences(self, terms: list[str] | DataFrame | None = None) -> DataFrame:
        """Rows (term, doc_id, offset); of some terms alone, if a list or a table of them is given."""
        lists = self.postings
        if isinstance(terms, list):
            lists = lists.filter(F.col("term").isin(terms))
        elif terms is not None:
            lists = lists.join(terms.select("term"), "term", "left_semi")
        return lists.select("term", "doc_id", F.explode("offsets").alias("offset"))

    def fitting(self, pattern: str, k: int = 2) -> DataFrame:
        """Terms that fit a word with one ``*``: those with the k-grams of its start and end, tested again as a whole."""
        start, _, end = pattern.partition("*")
        wanted = sorted({w[i : i + k] for w in (f"^{start}", f"{end}$") for i in range(len(w) - k + 1)})
        if not start and not end:
            return self.terms.select("term").limit(0)
        return kgram_lookup(self.grams, wanted).filter(F.col("term").startswith(start) & F.col("term").endswith(end))

    def wanted(self, words: list[str]) -> list[str] | DataFrame:
        """Terms that the words stand for: a list, or a table where wildcards stand for more than LISTED."""
        plain = sorted({w for w in words if "*" not in w})
        found = [self.fitting(w) for w in sorted({w for w in words if "*" in w})]
        if not found:
            return plain
        terms = self.postings.sparkSession.createDataFrame([(w,) for w in plain], "term string")
        for more in found:
            terms = terms.unionByName(more)
        listed = [r.term for r in terms.distinct().limit(LISTED + 1).collect()]
        return listed if len(listed) <= LISTED else terms.distinct()


def save_postings(lists: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write postings sorted by term, with bloom filters of terms; ``append`` adds a segment."""
    lists.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode(mode).option("parquet.bloom.filter.enabled#term", "true").parquet(path)
