"""Directories of documents, link and title files, saved indexes, text sinks."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.tokens import basename


def read_directory(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, doc_name, text), one for each file below a directory; ids by a hash of the path, so that they don't depend on other files."""
    files = spark.read.option("recursiveFileLookup", True).option("ignoreCorruptFiles", True).text(path, wholetext=True).select(F.input_file_name().alias("doc_name"), F.col("value").alias("text"))
    return files.select(F.xxhash64("doc_name").alias("doc_id"), "doc_name", "text")


def read_patterns(lines: str) -> list[str]:
    """Patterns of a file's content: one a line, without blank lines and those that start with //."""
    stripped = (line.strip() for line in lines.splitlines())
    return [line for line in stripped if line and not line.startswith("//")]


def parse_links(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges (src, dst), each once, and nodes (node_id), from lines ``node;out1,out2,...`` in a column value. A node without targets is still declared."""
    parts = lines.filter("trim(value) != ''").select(F.split("value", ";", 2).alias("p")).select(F.trim(F.get("p", F.lit(0))).alias("src"), F.coalesce(F.get("p", F.lit(1)), F.lit("")).alias("rest"))
    edges = parts.select("src", F.explode(F.split("rest", ",")).alias("dst")).select("src", F.trim("dst").alias("dst")).filter("dst != ''").distinct()
    return edges, parts.select(F.col("src").alias("node_id")).union(edges.select("dst")).distinct()


def parse_titles(lines: DataFrame) -> DataFrame:
    """Rows (node_id, title) from lines ``node;title``; the title may hold semicolons."""
    return lines.select(F.split("value", ";", 2).alias("p")).select(F.get("p", F.lit(0)).alias("node_id"), F.get("p", F.lit(1)).alias("title"))


def parse_truth(lines: DataFrame) -> DataFrame:
    """Rows (node_id, score) from lines ``name: value``."""
    return lines.select(F.split("value", ": ", 2).alias("p")).select(F.get("p", F.lit(0)).alias("node_id"), F.get("p", F.lit(1)).cast("double").alias("score"))


def encode_postings(postings: DataFrame, together: int = 100_000) -> DataFrame:
    """Rows (term, block, line): a term's list as text, ``term;~doc,off,off,~doc,off,`` in the order of documents.

    A list is cut into blocks where doc_id passes a multiple of ``together``, so that no row holds more documents than that; a block is a line that reads like a whole list.
    """
    entry = F.concat(F.lit("~"), F.col("doc_id").cast("string"), F.lit(","), F.concat_ws(",", F.col("offsets").cast("array<string>")), F.lit(","))
    lists = postings.groupBy("term", F.floor(F.col("doc_id") / together).alias("block")).agg(F.sort_array(F.collect_list(F.struct("doc_id", entry.alias("entry")))).alias("entries"))
    return lists.select("term", "block", F.concat(F.col("term"), F.lit(";"), F.concat_ws("", F.col("entries.entry"))).alias("line"))


def decode_postings(lines: DataFrame) -> DataFrame:
    """Rows (term, doc_id, tf, offsets) from a column line."""
    head = lines.select(F.expr("substring_index(line, ';~', 1)").alias("term"), F.expr("substring(line, length(substring_index(line, ';~', 1)) + 3)").alias("rest"))
    entries = head.select("term", F.explode(F.split("rest", "~")).alias("entry")).select("term", F.filter(F.split("entry", ","), lambda x: x != "").alias("p"))
    return entries.select("term", F.get("p", F.lit(0)).cast("long").alias("doc_id"), (F.size("p") - 1).alias("tf"), F.slice("p", 2, F.greatest(F.size("p") - 1, F.lit(0))).cast("array<int>").alias("offsets"))


def encode_documents(documents: DataFrame) -> DataFrame:
    """Lines ``doc_id;name;length`` of documents (doc_id, doc_name, doc_len)."""
    return documents.select(F.concat_ws(";", F.col("doc_id").cast("string"), "doc_name", F.col("doc_len").cast("string")).alias("line"))


def decode_documents(lines: DataFrame) -> DataFrame:
    """Rows (doc_id, doc_name, doc_len) from a column line; the name may hold semicolons."""
    head, tail = F.regexp_extract("line", r"\A(-?\d+);", 1), F.regexp_extract("line", r";(\d+)\z", 1)
    return lines.select(head.cast("long").alias("doc_id"), F.regexp_extract("line", r"(?s)\A-?\d+;(.*);\d+\z", 1).alias("doc_name"), tail.cast("int").alias("doc_len"))


def write_tokens(tokens: DataFrame, path: str) -> None:
    """Write tokens (doc_id, offset, token), one a line, in the order of documents and places; parts follow each other in that order."""
    tokens.repartitionByRange("doc_id", "offset").sortWithinPartitions("doc_id", "offset").select("token").write.mode("overwrite").text(path)


def fetch_document(docs: DataFrame, name: str) -> DataFrame:
    """Lines of the document of that file name, trimmed, in order; a single line says so if there is none."""
    found = docs.filter(basename(F.col("doc_name")) == name).select(F.posexplode(F.transform(F.split("text", "\n"), lambda x: F.trim(x))).alias("line_no", "line"))
    none = docs.sparkSession.createDataFrame([(0, "No file found")], "line_no int, line string")
    return found.unionByName(none.join(found.limit(1).select(F.lit(True).alias("some")), F.lit(True), "left_anti"))


def top_lines(scores: DataFrame, k: int, form: str = "%s: %.5f") -> DataFrame:
    """The k best of (node_id, score) as lines of text, in order."""
    best = scores.orderBy(F.desc("score"), "node_id").limit(k)
    place = F.row_number().over(Window.orderBy(F.desc("score"), "node_id"))  # over k rows
    return best.select(place.alias("place"), F.format_string(form, F.col("node_id").cast("string"), "score").alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    """Write the column value as text, in one file for a top list."""
    lines.select("value").coalesce(1).write.mode("overwrite").text(str(PurePosixPath(path)) if "://" not in path else path)
