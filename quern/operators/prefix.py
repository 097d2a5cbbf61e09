"""Running sums over groups of any size, without a group or the list of its ranges in one task.

Rows are ordered by a key of 60 uniform bits. Leading bits cut each group into cells of about CELL rows; cells nest in cells of WIDE leading bits fewer. Sums go up the levels by
combining aggregates, and come down by windows of 2^WIDE rows at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS, CELL, WIDE = 60, 256, 10


def uniform(*parts: Column) -> Column:
    """A number of 60 bits from an MD5 digest of the parts, which other engines compute alike; a null part counts as the empty text."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 15), 16, 10).cast("long")


def cell(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(key, BITS - bits) if bits else F.lit(0).cast("long")


def bits_for(rows: int) -> int:
    """Leading bits that cut so many rows into cells of about CELL."""
    return max(0, math.ceil(math.log2(max(1, rows) / CELL)))


def starts(df: DataFrame, by: list[str], key: str, value: Column, bits: int) -> DataFrame:
    """Rows (*by, cell, start): the sum of ``value`` over the rows of the group in cells before; groups aren't null."""
    level = df.select(*by, cell(F.col(key), bits).alias("cell"), value.alias("value")).groupBy(*by, "cell").agg(F.sum("value").alias("value"))
    levels = [level]
    for _ in range(bits, WIDE, -WIDE):
        level = level.groupBy(*by, F.shiftright("cell", WIDE).alias("cell")).agg(F.sum("value").alias("value"))
        levels.append(level)
    out = None
    for level in reversed(levels):
        top = out is None
        siblings = Window.partitionBy(*by, *([] if top else [F.shiftright("cell", WIDE)])).orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
        here = level.select(*by, "cell", F.coalesce(F.sum("value").over(siblings), F.lit(0)).alias("start"))
        if not top:
            above = out.withColumnsRenamed({"cell": "above", "start": "from"})
            here = here.withColumn("above", F.shiftright("cell", WIDE)).join(above, [*by, "above"]).select(*by, "cell", (F.col("start") + F.col("from")).alias("start"))
        out = here
    return out


def numbered(df: DataFrame, by: list[str], key: str, ties: list[str], rows: int) -> DataFrame:
    """``df`` with a column nr: the rows of each group from 0 on, by ``key`` and then ``ties``; ``rows``: of the largest group, about. ``df`` is a written table, as it is read twice."""
    bits = bits_for(rows)
    begin = starts(df, by, key, F.lit(1), bits)
    place = F.row_number().over(Window.partitionBy(*by, "cell").orderBy(key, *ties)) - 1
    placed = df.withColumn("cell", cell(F.col(key), bits)).withColumn("place", place)
    return placed.join(begin, [*by, "cell"]).withColumn("nr", F.col("start") + F.col("place")).select(*df.columns, "nr")
