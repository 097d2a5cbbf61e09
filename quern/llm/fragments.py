"""Repeated windows over sequences of words or bytes, without a row for each window.

A window is ``k`` consecutive symbols. Each window has an anchor: of the ``m``-grams in it the one with the least hash, the leftmost of equal ones. Consecutive windows with
the same anchor form a fragment. Two equal windows have equal anchors at equal places, so repeated windows only need looking for among fragments with the same anchor:

1. anchors that occur once are dropped (``repeated`` decides; each operator finds them by its own method);
2. fragments with equal content are one class, and what holds for a class holds for all its windows;
3. only where one anchor has several classes (a path branches) are single windows compared, one class each.

Counts are map-side combined and occurrences are joined to classes, so that a hot key is split by adaptive execution instead of landing in one task.

Documents are told apart by doc_id. Rows with a null one stay as they are, and their windows count for nothing. Rows that share one are one document, seen more than once: spans that
are found in one hold for all, as far as their texts reach.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import cut, mapped, only, release, remove

U = np.uint64
#: Odd multipliers and shifts of a 64-bit finaliser and of the m-gram sums.
MIX_A, MIX_B, STEP = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0x9E3779B97F4A7C15)
#: Windows handled at once; bounds memory for long documents.
PIECE = 1 << 20
#: Odd factors of a byte's place in a word, and of each byte.
PLACE_FACTOR = 0xD1342543DE82EF97
RANDOM_BYTES = np.random.Generator(np.random.PCG64(7)).integers(0, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(30))) * MIX_A
    x = (x ^ (x >> U(27))) * MIX_B
    return x ^ (x >> U(31))


def grams(x: np.ndarray, m: int) -> np.ndarray:
    """A hash of each ``m`` consecutive symbols' hashes, by doubling."""
    out, width, start, step = None, 1, 0, STEP
    part = x
    while m >= width:
        if m & width:
            piece = part[start:]
            out = piece if out is None else out[: len(x) - start - width + 1] * (step | U(1)) + piece[: len(x) - start - width + 1]
            start += width
        step = mixed(np.array([step], U))[0] | U(1)
        part = part[:-width] * step + part[width:] if len(part) > width else part[:0]
        width *= 2
    return mixed(out[: max(0, len(x) - m + 1)]) if out is not None else x[:0]


def least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    done, n = 1, len(x) - width + 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[: len(x) - step], x[step:])
        done += step
    return x[:n]


def fragments(x: np.ndarray, k: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, number of windows, anchor's place and anchor's hash of each fragment of symbols with hashes ``x``."""
    found = []
    for at in range(0, len(x) - k + 1, PIECE):
        part = x[at : at + PIECE + k - 1]
        g = grams(part, m)
        low = U((1 << 24) - 1)
        packed = least((g & ~low) | np.arange(len(g), dtype=U), k - m + 1)
        place = (packed & low).astype(np.int64)
        start = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        found.append((start + at, np.diff(np.append(start, len(place))), place[start] + at, g[place[start]]))
    if not found:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U),)
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


@lru_cache(4)
def powers(factor: int, many: int) -> np.ndarray:
    out = np.full(many, factor, U)
    out[0] = 1
    return np.cumprod(out)


class Line:
    """A text's words, joined by one space, and where each starts and ends."""

    def __init__(self, text: str | None):
        self.data = b" ".join((text or "").encode("utf-8", "surrogatepass").split())
        self.bytes = np.frombuffer(self.data, np.uint8)
        gaps = np.flatnonzero(self.bytes == 32)
        self.starts, self.ends = np.concatenate(([0], gaps + 1)), np.concatenate((gaps, [len(self.data)]))
        if not self.data:
            self.starts = self.ends = gaps

    def __len__(self) -> int:
        return len(self.starts)

    def hashes(self) -> np.ndarray:
        """A hash of each word by its bytes: differences of one running sum over the line."""
        many = 1 << max(17, len(self.data).bit_length())  # few sizes, so that tables are used again
        sums = np.zeros(len(self.data) + 1, U)
        np.cumsum(RANDOM_BYTES[self.bytes] * powers(PLACE_FACTOR, many)[: len(self.data)], out=sums[1:])
        return mixed((sums[self.ends] - sums[self.starts]) * powers(pow(PLACE_FACTOR, -1, 1 << 64), many)[self.starts] + (self.ends - self.starts).astype(U) * STEP)

    def quote(self, start: int, end: int) -> bytes:
        """The words from ``start`` to before ``end``, as far as there are any."""
        end = min(end, len(self))
        return self.data[self.starts[start] : self.ends[end - 1]] if start < end else b""


class Words:
    """A text as a sequence of words."""

    def __init__(self, m: int):
        self.m = m

    @staticmethod
    def plain(text: str | None) -> Line:
        return Line(text)

    def read(self, text: str | None) -> tuple[Line, np.ndarray]:
        line = Line(text)
        return line, line.hashes()

    @staticmethod
    def many(line: Line, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The words from each start to each end, joined by one space."""
        data = line.data
        return [data[a:b] for a, b in zip(line.starts[starts].tolist(), line.ends[ends - 1].tolist(), strict=True)]


class Bytes:
    """A text as a sequence of its UTF-8 bytes."""

    def __init__(self, m: int):
        self.m = m

    @staticmethod
    def plain(text: str | None) -> bytes:
        return (text or "").encode("utf-8", "surrogatepass")

    def read(self, text: str | None) -> tuple[bytes, np.ndarray]:
        data = self.plain(text)
        return data, RANDOM_BYTES[np.frombuffer(data, np.uint8)]

    @staticmethod
    def many(data: bytes, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        return [data[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def padded(data: bytes, place: np.ndarray, depth: int) -> list[bytes]:
    """The ``depth`` bytes from each place on, filled up with zeros at the end of the data."""
    data = data + b"\0" * depth
    return [data[p : p + depth] for p in place.tolist()]


def anchored(batches: Iterator[pd.DataFrame], kind: type, k: int, m: int, depth: int, whole: bool) -> Iterator[pd.DataFrame]:
    """Rows of fragments. ``whole``: with their content's digest and their place, else their anchors alone. ``depth``: with the suffix at the anchor, so many bytes of it: its hash if
    ``whole``, else the suffix itself instead of the anchor, and how often it occurs among rows read together. Where it is 0, ``whole`` rows have the hashes of the k - 1 symbols that
    they start and end with."""
    symbols = kind(m)
    rows = Rows(*columns_of(depth, whole), many=100_000)
    suffixes: Counter[bytes] = Counter()
    for batch in batches:
        for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
            data, x = symbols.read(text)
            start, n, place, h = fragments(x, k, m)
            if not len(start):
                continue
            if depth and not whole:
                suffixes.update(padded(data, place, depth))
                if len(suffixes) > 200_000:
                    yield counted(suffixes)
                    suffixes = Counter()
                continue
            out = [h.view(np.int64)]
            if whole:
                content = [xxhash.xxh3_128_digest(s) for s in symbols.many(data, start, start + n + k - 1)]
                out += [content, np.full(len(start), doc_id, np.int64), start, n.astype(np.int32)]
                if depth:
                    out.append((place - start).astype(np.int32))
                    out.append(np.array([xxhash.xxh64_intdigest(s, 42) for s in padded(data, place, depth)], U).view(np.int64))
                else:
                    out += ends(x, k - 1, start, start + n)
            rows.add(*out)
            yield from rows.frames()
    yield from rows.frames(rest=True)
    if suffixes:
        yield counted(suffixes)


def counted(suffixes: Counter[bytes]) -> pd.DataFrame:
    return pd.DataFrame({"suffix": list(suffixes), "times": list(suffixes.values())})


def columns_of(depth: int, whole: bool) -> dict[str, str]:
    if not whole:
        return {"suffix": "binary", "times": "long"} if depth else {"anchor": "long"}
    own = {"at": "int", "suffix": "long"} if depth else {"head": "long", "tail": "long"}
    return {"anchor": "long", "content": "binary", "doc_id": "long", "start": "long", "n": "int"} | own


def ends(x: np.ndarray, m: int, *places: np.ndarray) -> list[np.ndarray]:
    """Hashes of the ``m`` symbols from each place on, by differences of one running sum."""
    many = 1 << max(17, len(x).bit_length())
    sums = np.zeros(len(x) + 1, U)
    np.cumsum(x * powers(PLACE_FACTOR, many)[: len(x)], out=sums[1:])
    back = powers(pow(PLACE_FACTOR, -1, 1 << 64), many)
    return [mixed((sums[p + m] - sums[p]) * back[p]).view(np.int64) for p in places]


def clipped(spans: list | np.ndarray | tuple, limit: int) -> Iterator[tuple[int, int]]:
    """Start and number of windows of spans, as far as a text with ``limit`` windows has them."""
    for s in spans:
        if s["start"] < limit:
            yield s["start"], min(s["n"], limit - s["start"])


class Rows:
    """Columns that grow by arrays and lists; a frame for each so many rows, so that short documents share one."""

    def __init__(self, *names: str, many: int = 20_000):
        self.names, self.many = names, many
        self.parts: list[tuple] = []
        self.n = 0

    def add(self, *columns: np.ndarray | list) -> None:
        self.parts.append(columns)
        self.n += len(columns[0])

    def frames(self, rest: bool = False) -> Iterator[pd.DataFrame]:
        if self.n >= self.many or rest and self.n:
            columns = zip(*self.parts, strict=True)
            self.parts, self.n = [], 0
            yield pd.DataFrame({k: np.concatenate(c) if isinstance(c[0], np.ndarray) else [x for part in c for x in part] for k, c in zip(self.names, columns, strict=True)})


def pieces(batches: Iterator[pd.DataFrame], kind: type, k: int, block: int) -> Iterator[pd.DataFrame]:
    """The listed fragments in blocks of ``block`` windows at most, on a grid from their anchors. ``anchor`` is the digest of what all windows of the grid's block have in
    common, so that equal windows lie in blocks with equal ones; ``content`` is that of all the block's symbols."""
    symbols, rows = kind(0), Rows("anchor", "content", "doc_id", "start", "n", "at")
    for batch in batches:
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            data = symbols.plain(text)
            begin, end, low = [], [], []
            for s, (start, n) in zip((s for s in spans if s["start"] <= len(data) - k), clipped(spans, len(data) - k + 1), strict=True):
                grid = start + s["at"] % block - block
                edges = [start, *range(grid + block * (1 + (grid + block <= start)), start + n, block), start + n]
                begin += edges[:-1]
                end += edges[1:]
                low += [e - (e - grid) % block for e in edges[:-1]]
            begin, end, low = (np.array(x, np.int64) for x in (begin, end, low))
            for i in range(0, len(begin), 10_000):
                f, t, g = begin[i : i + 10_000], end[i : i + 10_000], low[i : i + 10_000]
                digests = [[xxhash.xxh3_128_digest(s) for s in symbols.many(data, x, y)] for x, y in ((g + block - 1, g + k), (f, t + k - 1))]
                rows.add(*digests, np.full(len(f), doc_id, np.int64), f, (t - f).astype(np.int32), np.zeros(len(f), np.int32))
                yield from rows.frames()
    yield from rows.frames(rest=True)


def windows(batches: Iterator[pd.DataFrame], kind: type, k: int) -> Iterator[pd.DataFrame]:
    """A row with a 128-bit digest for each window of the listed spans."""
    symbols, rows = kind(0), Rows("digest", "doc_id", "start")
    for batch in batches:
        for doc_id, text, spans in zip(batch["doc_id"], batch["text"], batch["spans"], strict=True):
            data = symbols.plain(text)
            place = np.concatenate([np.zeros(0, np.int64), *[np.arange(start, start + n) for start, n in clipped(spans, len(data) - k + 1)]])
            for i in range(0, len(place), 20_000):
                part = place[i : i + 20_000]
                rows.add([xxhash.xxh3_128_digest(s) for s in symbols.many(data, part, part + k)], np.full(len(part), doc_id, np.int64), part)
                yield from rows.frames()
    yield from rows.frames(rest=True)


def texts(df: DataFrame) -> DataFrame:
    return only(df, "doc_id", "text")


def anchors(df: DataFrame, kind: type, k: int, m: int, depth: int = 0) -> DataFrame:
    """One row for each fragment: its ``anchor``. Or the ``suffix`` there, ``depth`` bytes of it, in rows with a number of ``times``."""
    return read(df, kind, k, m, depth, False)


def occurrences(df: DataFrame, kind: type, k: int, m: int, depth: int = 0) -> DataFrame:
    """One row for each fragment, with its content's digest and its place. ``suffix`` is a hash, the same as Spark's xxhash64."""
    return read(df, kind, k, m, depth, True)


def read(df: DataFrame, kind: type, k: int, m: int, depth: int, whole: bool) -> DataFrame:
    schema = ", ".join(f"{c} {t}" for c, t in columns_of(depth, whole).items())
    return mapped(texts(df).filter("doc_id IS NOT NULL"), partial(anchored, kind=kind, k=k, m=m, depth=depth, whole=whole), schema)


def spans_to_text(df: DataFrame, spans: DataFrame, how: str) -> DataFrame:
    """Join each document with its list of spans, structs or what the only further column holds; the spans are the built side, so that texts aren't sorted."""
    columns = [c for c in spans.columns if c != "doc_id"]
    listed = spans.groupBy("doc_id").agg(F.collect_list(F.struct(*columns) if len(columns) > 1 else columns[0]).alias("spans"))
    return texts(df).join(listed.hint("shuffle_hash"), "doc_id", how)


def classes_of(found: DataFrame, keep_first: bool) -> tuple[DataFrame, DataFrame]:
    """Classes (anchor, content, times, first, ...) of equal fragments, and the first of each class where an anchor has several (doc_id, start, n, ...)."""
    place, nodes = [[c for c in names if c in found.columns] for names in (("doc_id", "start", "n", "at"), ("head", "tail"))]
    if keep_first:
        classes = found.groupBy("anchor", "content").agg(F.count("*").alias("times"), F.min(F.struct(*place)).alias("first"), *[F.first(c).alias(c) for c in nodes])
    else:  # any place will do, and its columns come from one row
        classes = found.groupBy("anchor", "content").agg(F.count("*").alias("times"), *[F.first(c).alias(c) for c in (*place, *nodes)])
        classes = classes.select("anchor", "content", "times", F.struct(*place).alias("first"), *nodes)
    classes = cut(classes)
    release(found.sparkSession)
    # written, so that adaptive execution can split a hot anchor in the join
    branching = cut(classes.groupBy("anchor").agg(F.count("*").alias("ways")).filter("ways > 1").select("anchor"))
    paths = cut(classes.join(branching, "anchor").select("first.*"))
    remove(branching)
    return classes, paths


def windows_apart(df: DataFrame, paths: DataFrame, kind: type, k: int) -> DataFrame:
    """A row (digest, doc_id, start) for each window of the listed paths."""
    edges = cut(mapped(spans_to_text(df, paths, "inner"), partial(windows, kind=kind, k=k), "digest binary, doc_id long, start long"))
    release(df.sparkSession)
    return edges


def later(doc_id: str = "first.doc_id", start: str = "first.start") -> Column:
    """Whether a row isn't its class's first."""
    return (F.col("doc_id") > F.col(doc_id)) | ((F.col("doc_id") == F.col(doc_id)) & (F.col("start") > F.col(start)))


def covered(spans: list | np.ndarray | None, n: int, k: int) -> np.ndarray:
    """Which of ``n`` symbols the spans' windows cover."""
    edge = np.zeros(n + 1, np.int64)
    for start, many in clipped(() if spans is None else spans, n - k + 1):
        edge[start] += 1
        edge[start + many + k - 1] -= 1
    return np.cumsum(edge[:n]) > 0
