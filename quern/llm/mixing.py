"""Mixing sources to target weights.

Each document gets a key by hash, and the documents of a source are range-sorted by it. Keys are uniform, so their leading bits cut a source into cells of like size without
sampling. Sizes are summed by cell, over cells in levels, and within each cell; each source is cut at its budget, after whole epochs where the budget exceeds its size. Budgets come
from a sorted table of sources, of which there may be as many as documents.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import cut, documents, n_words_of, only, remove, words_of
from quern.operators.prefix import bits_for, cell, starts, uniform

#: Weights by rank of the source, repeating; the mix's size and the most of a source, as multiples of the input.
WEIGHTS, SHARE, EPOCHS = (3, 1, 2), 1.5, 2.0
#: Rows that a sorted run of sources has, at least about.
RUN = 4096


def sorted_runs(df: DataFrame, *order: Column) -> DataFrame:
    """``df`` written in order, with a column run: runs of RUN rows or more follow each other by number. There are at most as many runs as a run has rows."""
    rows = df.count()
    runs = max(1, min(rows // RUN, math.isqrt(rows)))
    return cut(df.repartitionByRange(runs, *order).withColumn("run", F.spark_partition_id()))


def before(df: DataFrame, value: Column, order: list[Column], name: str) -> DataFrame:
    """``df`` (with a column run) and the sum of ``value`` over the rows before: within the run, and over the runs before."""
    upto = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy("run").agg(F.sum(value).alias("#sum")).withColumn("#from", F.coalesce(F.sum("#sum").over(upto(Window.orderBy("run"))), F.lit(0)))
    within = F.coalesce(F.sum(value).over(upto(Window.partitionBy("run").orderBy(*order))), F.lit(0))
    return df.withColumn("#in", within).join(sums.drop("#sum"), "run").withColumn(name, F.col("#from") + F.col("#in")).drop("#from", "#in")


def budgets(totals: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS) -> DataFrame:
    """Rows (*columns of totals, target) for sources (source, size): shares by weight, in the order of code points with null last; none above ``epochs`` times its source's size.

    What sources of full size leave is shared anew by weight until none is above; that ends at one level for each unit of weight, below which lie all sources that are full.
    """
    columns = totals.columns
    by_name = [F.col("source").asc_nulls_last()]
    named = sorted_runs(totals, *by_name)
    ranked = before(named, F.lit(1), by_name, "rank")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    weighted = ranked.select(*columns, weight.alias("weight")).withColumn("full", F.col("size") * epochs).withColumn("ratio", F.col("full") / F.col("weight"))
    by_ratio = [F.col("ratio"), *by_name]
    runs = sorted_runs(weighted, *by_ratio)
    lined = cut(before(before(runs, F.col("full"), by_ratio, "below"), F.col("weight"), by_ratio, "lighter"))
    remove(named, runs)
    whole = lined.agg(F.sum("size").alias("size"), F.sum("weight").alias("weight")).first()
    left = F.lit(float(whole["size"] or 0) * share) - F.col("below")
    wide = F.lit(float(whole["weight"] or 0)) - F.col("lighter")
    # the first source that stays under its full size when what is left is shared among it and those after it
    level = lined.filter(left * F.col("weight") < F.col("full") * wide).agg(F.min_by(left / wide, F.struct("ratio", F.col("source").isNull(), "source"))).first()[0]
    target = F.col("full") if level is None else F.least(F.col("full"), F.greatest(F.lit(0.0), F.col("weight") * level))
    return lined.select(*columns, target.cast("double").alias("target"))


def mix(df: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: float = EPOCHS, seed: int = 0) -> DataFrame:
    """Rows (doc_id, size, source_size, target, taken), one for each row of ``df`` (doc_id, text, source).

    ``taken`` is the number of words that the mix takes of a document, repeats counted: whole epochs of its source, and in the last one all words before the cut. A source's taken
    words are its target, rounded. Null and empty texts have size 0 and nothing is taken of them; a null source is one source. Ties of keys go by doc_id; repeated rows are taken
    one by one, and a null doc_id is an id like others. Other columns aren't read. An empty table gives no rows.
    """
    group = F.concat(F.when(F.col("source").isNull(), "-").otherwise("+"), F.coalesce("source", F.lit("")))
    sized = cut(only(df, "doc_id", "text", "source").select("doc_id", "source", group.alias("group"), n_words_of(F.col("text")).alias("size"), uniform(F.lit(seed), F.col("doc_id")).alias("key")))
    totals = cut(sized.groupBy("group", "source").agg(F.sum("size").alias("size"), F.count("*").alias("docs")))
    most = totals.agg(F.max("docs")).first()[0] or 0
    bits = bits_for(most)
    plan = budgets(totals, weights, share, epochs).select("group", F.col("size").alias("source_size"), "target", F.floor(F.col("target") + 0.5).alias("budget"))
    # a document finds its source's plan and what lies before its cell by one join, on a key that no source owns alone
    cells = starts(sized, ["group"], "key", F.col("size"), bits).join(plan, "group")
    within = Window.partitionBy("group", "cell").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.drop("source").withColumn("cell", cell(F.col("key"), bits)).withColumn("at", F.coalesce(F.sum("size").over(within), F.lit(0)))
    joined = placed.join(cells, ["group", "cell"])
    rest = F.col("budget") - F.col("source_size") * F.expr("budget div greatest(source_size, 1)") - F.col("start") - F.col("at")
    taken = F.col("size") * F.expr("budget div greatest(source_size, 1)") + F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return joined.select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mixed_documents(df: DataFrame, **options: object) -> DataFrame:
    """The mix itself: rows of ``df`` with all their columns, repeated for each epoch; the text of the one document at a source's cut ends there.

    Rows of which nothing is taken go, null and empty texts among them. doc_id is unique in ``df``; rows with a null one go.
    """
    taken = mix(df, **options).filter("taken > 0").select("doc_id", "size", "taken")
    text = F.when(F.col("#part") >= F.col("#size"), F.col("text")).otherwise(F.array_join(F.slice(words_of(F.col("text")), F.lit(1), F.col("#part").cast("int")), " "))
    copies = taken.select(F.col("doc_id"), F.col("size").alias("#size"), F.explode(F.expr("sequence(0L, (taken - 1) div size)")).alias("#copy"), "taken")
    copies = copies.select("doc_id", "#size", F.least(F.col("#size"), F.col("taken") - F.col("#copy") * F.col("#size")).alias("#part"))
    joined = df.join(copies.hint("shuffle_hash"), "doc_id")
    return joined.select(*[(text if c == "text" else F.col(f"`{c}`")).alias(c) for c in df.columns])


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).withColumn("target", F.round("target", 3))


#: The budgets are found as a cap on size for each weight: sources are cut off in the order of their size for each weight, as long as the rest can't take up what is left.
ORACLE = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))::BIGINT AS size,
  ('0x' || md5('0:' || coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS key FROM documents),
 s AS (SELECT source, sum(size)::BIGINT AS n FROM d GROUP BY source),
 r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w, 1.5::DOUBLE * (SELECT sum(n) FROM s) AS whole FROM s),
 o AS (SELECT *, whole - coalesce(sum(2 * n) OVER p, 0) AS remains, sum(w) OVER q AS wide FROM r
  WINDOW p AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), q AS (ORDER BY 2.0 * n / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 lvl AS (SELECT coalesce(min_by(remains / wide, 2.0 * n / w) FILTER (WHERE remains * w < 2.0 * n * wide), 1e300) AS level FROM o),
 t AS (SELECT source, n, least(2.0 * n, w * level)::DOUBLE AS target FROM r, lvl),
 p AS (SELECT d.doc_id, d.size, t.n AS source_size, t.target, floor(t.target + 0.5)::BIGINT AS budget, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, round(target, 3) AS target, (size * (budget // greatest(source_size, 1)) + greatest(0, least(size, budget - source_size * (budget // greatest(source_size, 1)) - pos)))::BIGINT AS taken FROM p
"""
