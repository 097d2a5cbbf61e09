"""Quality classifier: nearest-neighbour voting among labelled latent-semantic vectors.

A document's words and their shapes are hashed into a fixed number of features. A truncated singular value decomposition of the labelled documents' weighted features gives the
latent space; the labelled vectors, of which there are at most SAMPLE, go to each task, which multiplies them with its documents' vectors block by block. Every document is scored by
its nearest labelled documents, weighted by similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import documents, held, mapped, only

#: Labelled documents that the model is fitted on, at most: those with the least hashes of doc_id.
SAMPLE = 4_000
#: Hashed features of words and of words' shapes, dimensions of the latent space, neighbours that vote, power of their similarity, documents in a block.
WORD_BITS, SHAPE_BITS, LATENT, NEIGHBOURS, POWER, BLOCK = 11, 7, 48, 25, 8, 256
#: Weight of the shapes beside the words; score from which a document is taken for good.
SHAPES, CUT = 2.0, 0.3
KEEP = 150_000
N_WORDS, N_SHAPES = 1 << WORD_BITS, 1 << SHAPE_BITS


class Features(dict):
    """Word feature and shape feature of a word, in one number; kept for a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEEP:
            self.clear()
        shape = []
        for c in word.decode("utf-8", "replace"):
            kind = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "." if c in ".,;:?'\"()-" else "!" if c.isascii() else "x"
            if not shape or shape[-1] != kind:
                shape.append(kind)
        low = word.lower().strip(b".,;:!?")
        self[word] = out = (xxhash.xxh3_64_intdigest(low) & (N_WORDS - 1)) << 8 | (xxhash.xxh3_64_intdigest("".join(shape[:6])) % (N_SHAPES - 2))
        return out


def counted(texts: list[str | None], features: Features) -> np.ndarray:
    """Counts of features, a row for each text; the last two shapes count words equal to the one before, and words beyond the first of their feature."""
    out = np.zeros((len(texts), N_WORDS + N_SHAPES), np.float32)
    for row, text in zip(out, texts, strict=True):
        words = (text or "").encode("utf-8", "surrogatepass").split()
        if not words:
            continue
        x = np.fromiter(map(features.__getitem__, words), np.int64, len(words))
        row[:N_WORDS] = np.bincount(x >> 8, minlength=N_WORDS)
        row[N_WORDS:] = np.bincount(x & 255, minlength=N_SHAPES)
        row[-2] = np.count_nonzero(x[1:] == x[:-1])
        row[-1] = len(x) - np.count_nonzero(row[:N_WORDS])
    return out


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def weighted(self, counts: np.ndarray) -> np.ndarray:
        """Words by log frequency and rarity, shapes by the root of their share; both of bounded length."""
        words = np.log1p(counts[:, :N_WORDS]) * self.idf
        words /= np.maximum(np.linalg.norm(words, axis=1, keepdims=True), 1e-9)
        shapes = np.sqrt(counts[:, N_WORDS:] / np.maximum(counts[:, :N_WORDS].sum(axis=1, keepdims=True), 1))
        return np.hstack([words, SHAPES * shapes]).astype(np.float32)

    def latent(self, counts: np.ndarray) -> np.ndarray:
        v = self.weighted(counts) @ self.axes
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)

    def scores(self, counts: np.ndarray) -> np.ndarray:
        n = len(self.labels)
        if not n:
            return np.full(len(counts), self.prior)
        near = self.latent(counts) @ self.vectors.T
        k = min(NEIGHBOURS, n)
        top = np.argpartition(near, n - k, axis=1)[:, n - k :] if k < n else np.broadcast_to(np.arange(n), near.shape)
        weight = np.clip(np.take_along_axis(near, top, axis=1), 0, 1).astype(np.float64) ** POWER
        # a pseudo-vote for the prior: far neighbours decide little, and empty texts get the prior itself
        return ((weight * self.labels[top]).sum(axis=1) + 0.1 * self.prior) / (weight.sum(axis=1) + 0.1)


def sampled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    features = held("features", Features)
    for part in parts:
        for i in range(0, len(part), BLOCK):
            some = part.iloc[i : i + BLOCK]
            rows = counted(list(some["text"]), features)
            yield pd.DataFrame({"doc_id": some["doc_id"], "label": some["label"], "at": [np.flatnonzero(r).astype(np.int32) for r in rows], "n": [r[r > 0] for r in rows]})


def fit(df: DataFrame, labels: DataFrame, sample: int = SAMPLE, seed: int = 0) -> Model:
    """Fit on at most ``sample`` rows of ``labels`` (doc_id, label 0 or 1) and their whole texts in ``df``; the vectors that reach the driver are of bounded size.

    Rows with a null id or label, or without a document, aren't used. Without any labelled document the model scores 0.5 throughout.
    """
    some = only(labels, "doc_id", "label").dropna().distinct().orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id", "label").limit(sample)
    rows = mapped(only(df, "doc_id", "text").join(F.broadcast(some), "doc_id"), sampled, "doc_id long, label int, at array<int>, n array<float>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label))
    counts = np.zeros((len(rows), N_WORDS + N_SHAPES), np.float32)
    for out, row in zip(counts, rows, strict=True):
        out[row["at"]] = row.n
    y = np.array([float(r.label == 1) for r in rows])
    idf = np.log((1 + len(rows)) / (1 + (counts[:, :N_WORDS] > 0).sum(axis=0))).astype(np.float32)
    model = Model(idf, np.zeros((N_WORDS + N_SHAPES, 1), np.float32), np.zeros((0, 1), np.float32), y, float(y.mean()) if len(y) else 0.5)
    if len(rows):
        x = model.weighted(counts)
        rng = np.random.Generator(np.random.PCG64(seed))
        basis = np.linalg.qr(x.T @ (x @ rng.standard_normal((x.shape[1], min(LATENT + 16, *x.shape)), dtype=np.float32)))[0]
        for _ in range(2):
            basis = np.linalg.qr(x.T @ (x @ basis))[0]
        _, _, turn = np.linalg.svd(x @ basis, full_matrices=False)
        model.axes = np.ascontiguousarray((basis @ turn.T)[:, :LATENT], np.float32)
        model.vectors = np.ascontiguousarray(model.latent(counts), np.float32)
    return model


def scored(parts: Iterator[pd.DataFrame], model: Model) -> Iterator[pd.DataFrame]:
    features = held("features", Features)
    for part in parts:
        for i in range(0, len(part), BLOCK):
            some = part.iloc[i : i + BLOCK]
            yield pd.DataFrame({"doc_id": some["doc_id"], "score": model.scores(counted(list(some["text"]), features)).clip(0, 1)})


def score(df: DataFrame, model: Model) -> DataFrame:
    """Rows (doc_id, score), one for each row of ``df`` (doc_id, text): how likely label 1 is, from 0 to 1. Null and empty texts get the share of label 1 in the sample."""
    return mapped(only(df, "doc_id", "text"), partial(scored, model=model), "doc_id long, score double")


def good(parts: Iterator[pd.DataFrame], model: Model, least: float) -> Iterator[pd.DataFrame]:
    features = held("features", Features)
    for part in parts:
        keep = np.concatenate([model.scores(counted(list(part["text"].iloc[i : i + BLOCK]), features)) for i in range(0, len(part), BLOCK)] or [np.zeros(0)]) >= least
        yield part[keep]


def keep_good(df: DataFrame, model: Model, least: float = CUT) -> DataFrame:
    """The rows of ``df`` that score ``least`` or more, with all their columns, in one pass."""
    text = df.select(*[F.col(f"`{c}`") for c in df.columns])
    return mapped(text, partial(good, model=model, least=least), df.schema)


def held_out() -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))


def fitted(spark: SparkSession, sf_dir: str, df: DataFrame | None = None) -> Model:
    """The model of labels.quality, learnt from the rows that aren't held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out()).select("doc_id", F.col("quality").alias("label"))
    return fit(documents(spark, sf_dir) if df is None else df, labels)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(documents(spark, sf_dir), fitted(spark, sf_dir))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"))
