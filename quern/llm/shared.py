"""What the training-data operators share: reading, cutting lineage, words, per-row helpers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from functools import partial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.sources.tables import new_path, remove  # noqa: F401

#: What separates words, as a character class for Java and RE2 patterns.
BLANK = r"[\x20\x09-\x0D]+"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def cut(df: DataFrame, *parts: str) -> DataFrame:
    """Write ``df`` as a table in the cluster's shared folder and read it back, so that later jobs start from files instead of lineage; lost executors cost only the tasks that ran on them."""
    spark = df.sparkSession
    path = new_path(spark)
    df.write.option("compression", "zstd").partitionBy(*parts).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner delete the shuffle files of jobs that are over, which otherwise waits for the driver's next full collection; for between steps that shuffle a whole corpus."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often the body names it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """The words of a text, in order; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def n_words_of(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.size(words_of(text)).cast("long")


def trim() -> None:
    """Give freed memory back to the system: a worker process outlives its task, and what it keeps is lacking to others."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def trimmed(parts: Iterator[pd.DataFrame], work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    try:
        yield from work(parts)
    finally:
        trim()


def mapped(df: DataFrame, work: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: object) -> DataFrame:
    """``mapInPandas`` whose tasks trim their worker's memory when they are done."""
    return df.mapInPandas(partial(trimmed, work=work), schema)


HELD: dict[str, object] = {}


def held(name: str, make: Callable[[], object]) -> object:
    """What a worker process keeps between the tasks of one operator; that of another operator goes first, so that a worker holds one at most."""
    if name not in HELD:
        HELD.clear()
        trim()
        HELD[name] = make()
    return HELD[name]


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns alone: further columns of an input, whatever their names, can't clash with an operator's own."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
