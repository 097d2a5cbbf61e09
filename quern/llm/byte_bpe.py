"""Byte-level BPE encoding and decoding with DuckDB, one database for each task.

Texts are cut at single spaces and newlines between other characters, which no pretoken crosses; the pieces and their pretokens are encoded once and kept for a while. The pretokens
that aren't tokens themselves become rows of a token for each position. A recursive query joins each row's pair with the merge table and contracts each word's leftmost pair of least
rank, until no pair of any word is left. Decoding joins ids with the vocabulary and aggregates their bytes in order.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
import tempfile
from collections.abc import Callable, Iterator
from functools import partial
from itertools import chain

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession

from quern.llm.shared import documents, held, mapped, only

VOCABULARY = "byte_bpe_50k.tiktoken"
#: Pieces and pretokens that a worker keeps of each of two generations, and new ones that are encoded together; bytes of results in a frame.
PIECES, WORDS, TOGETHER, FRAME = 100_000, 200_000, 60_000, 8_000_000
#: Longest word, in bytes, of which the leftmost pair alone is contracted in a round; rows that the rounds of one query add up to, about; rounds of longer words in one query.
SHORT, ROWS, ROUNDS = 127, 3_000_000, 16
#: MB of a task's database, but for words that need more.
MEMORY = 250
#: Where a space or newline isn't alone between two characters that aren't white, or the mark of cuts is in the text.
CROWDED = re.compile(r"\s[ \n]|[ \n]\s|\A[ \n]|[ \n]\Z|\0")

#: ``place`` packs the word's number and the position in it, ``pair`` the ids there and at the next position (all ones at the end). Contracting drops the pair's first row, and its
#: second takes the merged id, so that a row knows its neighbour without sorting. Rounds go on with the words that had a pair; words without one are final.
MERGE = """
WITH RECURSIVE step(place, pair, live) AS (
  SELECT place, pair, true FROM bytes
  UNION ALL
  (WITH now AS MATERIALIZED (SELECT place, pair FROM step WHERE live),
   least AS MATERIALIZED (SELECT place >> 8 AS word, min(id << 8 | (place & 255)) AS least FROM now JOIN merges USING (pair) GROUP BY 1),
   hit AS MATERIALIZED (SELECT word, least & 255 AS spot, least >> 8 AS merged FROM least)
   SELECT CASE WHEN (place & 255) > spot THEN place - 1 ELSE place END,
     CASE (place & 255) - spot WHEN 1 THEN merged << 32 | (pair & 4294967295) WHEN -1 THEN pair >> 32 << 32 | merged ELSE pair END, merged IS NOT NULL
   FROM now LEFT JOIN hit ON word = place >> 8
   WHERE merged IS NULL OR (place & 255) <> spot)
)
SELECT place >> 8 AS word, pair >> 32 AS id FROM step WHERE NOT live ORDER BY place
"""
#: The same for long words, where a round contracts many places of a word's least pair, which are those that one by one would come next: leftmost first, every second where they
#: overlap, up to the first that makes a pair of lower rank with what is before or after it. Up to there no other pair becomes the least, as a longer token can't have the same rank;
#: from there on the next rounds decide. A query ends after some rounds, so that what it holds is bounded.
MERGE_LONG = """
WITH RECURSIVE step(word, pos, id, live, round) AS (
  SELECT word, pos, id, true, 0 FROM bytes
  UNION ALL
  (WITH pair AS MATERIALIZED (
     SELECT word, pos, s.id, next_pos, end_pos, before_id, after_id, m.id AS merged, round
     FROM (SELECT word, pos, id, lead(id) OVER w AS next_id, lead(pos) OVER w AS next_pos, lead(pos, 2) OVER w AS end_pos, lag(id) OVER w AS before_id, lead(id, 2) OVER w AS after_id, round
       FROM step WHERE live AND round < {rounds} WINDOW w AS (PARTITION BY word ORDER BY pos)) s
     LEFT JOIN merges m ON m.pair = s.id << 32 | s.next_id),
   least AS MATERIALIZED (SELECT word, min(merged) AS least FROM pair GROUP BY word),
   hit AS MATERIALIZED (SELECT p.*, CASE WHEN lag(next_pos) OVER w = pos THEN 0 ELSE 1 END AS fresh FROM pair p JOIN least l ON p.word = l.word AND p.merged = l.least WINDOW w AS (PARTITION BY p.word ORDER BY pos)),
   run AS MATERIALIZED (SELECT *, sum(fresh) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM hit),
   turn AS MATERIALIZED (SELECT * FROM run QUALIFY row_number() OVER (PARTITION BY word, run ORDER BY pos) % 2 = 1),
   seen AS MATERIALIZED (SELECT *, CASE WHEN lag(end_pos) OVER w = pos THEN merged ELSE before_id END AS left_id FROM turn WINDOW w AS (PARTITION BY word ORDER BY pos)),
   best AS MATERIALIZED (SELECT s.word, s.pos, s.next_pos, s.merged FROM seen s LEFT JOIN merges x ON x.pair = s.left_id << 32 | s.merged LEFT JOIN merges y ON y.pair = s.merged << 32 | s.after_id
     QUALIFY coalesce(sum(CASE WHEN x.id < s.merged OR y.id < s.merged THEN 1 ELSE 0 END) OVER (PARTITION BY s.word ORDER BY s.pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0)
   SELECT p.word, p.pos, coalesce(b.merged, p.id), l.least IS NOT NULL, round + 1
   FROM pair p JOIN least l ON p.word = l.word LEFT JOIN best b ON p.word = b.word AND p.pos = b.pos ANTI JOIN best x ON p.word = x.word AND p.pos = x.next_pos)
)
SELECT word, pos, id, live FROM step WHERE NOT live OR round = {rounds} ORDER BY word, pos
"""
#: The bytes of all words in one aggregate, so that they are sorted once; a comma ends each word.
DECODE = "SELECT string_agg(CASE WHEN last THEN hex || ',' ELSE hex END, '' ORDER BY place) FROM ids JOIN vocabulary USING (id)"


def ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids, from a file of lines with base64 and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


class Kept:
    """Ids and bytes of pieces or pretokens, those asked for lately: two generations of about ``most``, or of as many as one batch has."""

    def __init__(self, most: int):
        self.most, self.new, self.old = most, {}, {}

    def lacking(self, wanted: set[str]) -> list[str]:
        """Those of ``wanted`` that have to be learnt; the others are in the new generation afterwards."""
        if len(self.new) > self.most:
            self.old, self.new = self.new, {}
        new, old, out = self.new, self.old.get, []
        for x in wanted.difference(new):
            if found := old(x):
                new[x] = found
            else:
                out.append(x)
        return out


class Coder:
    """Encoder and decoder of a task; ``path`` names the vocabulary's file on each machine."""

    def __init__(self, path: str):
        self.ranks = ranks(path)
        self.single = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces, self.words = Kept(PIECES), Kept(WORDS)
        self.spill = tempfile.TemporaryDirectory()  # this worker's own, for what a word of many MB needs beyond the limit
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": f"{MEMORY}MB", "temp_directory": self.spill.name})
        merges = [(self.ranks[t[:i]] << 32 | self.ranks[t[i:]], rank) for t, rank in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        self._table("merges", pd.DataFrame(merges, columns=["pair", "id"], dtype="int64"))
        self._table("vocabulary", pd.DataFrame({"id": list(self.ranks.values()), "hex": [t.hex() for t in self.ranks]}))

    def _table(self, name: str, rows: pd.DataFrame) -> None:
        self.db.register("rows_in", rows)
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM rows_in")
        self.db.unregister("rows_in")

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """How many ids each word has, and all ids in order, by pairs of least rank."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        of, ids = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        order = np.argsort(size, kind="stable")
        # as many words as bound the rows of all rounds; a round of a short word takes a byte at least
        load = np.cumsum(size[order] * np.where(size[order] > SHORT, ROUNDS, (size[order] + 1) // 2)) // ROWS * 2 + (size[order] > SHORT)
        for numbers in np.split(order, np.flatnonzero(np.diff(load)) + 1) if len(order) else ():
            word, pos = numbered(size[numbers])
            merged = self._long if size[numbers[0]] > SHORT else self._short
            part = merged(word, pos, self.single[np.frombuffer(b"".join([words[i] for i in numbers.tolist()]), np.uint8)])
            of.append(numbers[part[0]])
            ids.append(part[1])
        where = np.concatenate(of)
        return np.bincount(where, minlength=len(words)), np.concatenate(ids)[np.argsort(where, kind="stable")]

    def _short(self, word: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        after = np.append(ids[1:], 0)
        after[np.append(pos[1:] == 0, True)] = 0xFFFFFFFF
        self._table("bytes", pd.DataFrame({"place": word << 8 | pos, "pair": ids << 32 | after}))
        rows = self.db.execute(MERGE).fetchnumpy()
        return rows["word"], rows["id"]

    def _long(self, word: np.ndarray, pos: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        self.db.execute(f"SET memory_limit = '{max(MEMORY, len(ids) // 1500)}MB'")  # beyond about 400 kB a word's windows take 600 bytes or so for each of its bytes
        rows, done = {"word": word, "pos": pos, "id": ids, "live": np.ones(len(ids), bool)}, []
        while rows["live"].any():
            self._table("bytes", pd.DataFrame({k: rows[k][rows["live"]] for k in ("word", "pos", "id")}))
            rounds = max(1, min(ROUNDS, ROWS // int(rows["live"].sum())))
            rows = self.db.execute(MERGE_LONG.format(rounds=rounds)).fetchnumpy()
            done.append([rows[k][~rows["live"]] for k in ("word", "id")])
        self.db.execute(f"SET memory_limit = '{MEMORY}MB'")
        of, found = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(of, kind="stable")
        return of[order], found[order]

    def decode(self, counts: np.ndarray, ids: np.ndarray) -> list[bytes]:
        """Bytes of each list of ids, of which ``counts`` are the lengths; none is empty."""
        last = np.zeros(len(ids), bool)
        last[np.cumsum(counts) - 1] = True
        self._table("ids", pd.DataFrame({"place": np.arange(len(ids)), "id": ids, "last": last}))
        return list(map(bytes.fromhex, (self.db.execute(DECODE).fetchall()[0][0] or "").split(",")[:-1]))

    def learn(self, pieces: list[str]) -> None:
        """Encode and decode pieces, by their pretokens, each once."""
        found_in = self.pattern.findall
        # most pieces are a space and ASCII letters, which are one pretoken
        tokens = [[p] if p.isascii() and (p[1:].isalpha() if p[0] == " " else p.isalpha()) else found_in(p) for p in pieces]
        new = self.words.lacking(set(chain.from_iterable(tokens)))
        words = self.words.new
        raw = [t.encode("utf-8", "surrogatepass") for t in new]
        known = [self.ranks[w] if w in self.ranks else -1 for w in raw]
        new = [t for t, i in zip(new, known, strict=True) if i >= 0] + [t for t, i in zip(new, known, strict=True) if i < 0]
        counts, ids = self.merge([w for w, i in zip(raw, known, strict=True) if i < 0])
        single = np.array([i for i in known if i >= 0], np.int64)
        counts, ids = np.append(np.ones(len(single), np.int64), counts), np.append(single, ids)
        data, ends = ids.astype("<u4").tobytes(), (4 * np.cumsum(counts)).tolist()
        words.update(zip(new, zip([data[i:j] for i, j in zip([0, *ends], ends, strict=False)], self.decode(counts, ids), strict=True), strict=True))
        kept = self.pieces.new
        for piece, part in zip(pieces, tokens, strict=True):
            if len(part) == 1:
                kept[piece] = words[piece]
            else:
                found = [words[t] for t in part]
                kept[piece] = (b"".join([x[0] for x in found]), b"".join([x[1] for x in found]))

    @staticmethod
    def cut(text: str) -> list[str]:
        """Pieces that are pretokenised alike alone and in the text: cut before each space, and around each newline, that stands between two characters that aren't white."""
        if not CROWDED.search(text):
            return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0") if text else []
        parts = text.split(" ")
        out, open_ = parts[:1], not parts[0] or parts[0][-1].isspace()
        for part in parts[1:]:
            if not part or open_ or part[0].isspace():
                out[-1] += " " + part
            else:
                out.append(" " + part)
            open_ = not part or part[-1].isspace()
        return out

    def coded(self, texts: list[str | None]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as little-endian 32-bit integers, and the bytes that they decode to, of each text."""
        at = 0
        while at < len(texts):  # as many texts as have TOGETHER unlike pieces
            cuts: list[list[str]] = []
            wanted: set[str] = set()
            while at < len(texts) and (not cuts or len(wanted) < 2 * TOGETHER):
                cuts.append(self.cut(texts[at] or ""))
                wanted.update(cuts[-1])
                at += 1
            new = self.pieces.lacking(wanted)
            for i in range(0, len(new), TOGETHER):
                self.learn(new[i : i + TOGETHER])
            kept = self.pieces.new
            for part in cuts:
                found = [kept[p] for p in part]
                yield b"".join([x[0] for x in found]), b"".join([x[1] for x in found])


def numbered(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the list and position in it, for each element of lists of these lengths."""
    return np.repeat(np.arange(len(n)), n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


COLUMNS = ["doc_id", "n_tokens", "ids", "decoded"]


def coded(parts: Iterator[pd.DataFrame], path: str, digest: bool) -> Iterator[pd.DataFrame]:
    shown: Callable[[bytes], object] = (lambda data: hashlib.sha256(data).hexdigest()) if digest else bytes
    collects = gc.isenabled()
    gc.disable()  # many small objects are made and kept here, none of them in cycles
    try:
        for part in parts:
            coder = held(f"bpe {path}", lambda: Coder(path))
            rows, size = [], 0
            for doc_id, (ids, back) in zip(part["doc_id"], coder.coded(part["text"].tolist()), strict=True):
                rows.append((doc_id, len(ids) // 4, shown(ids), shown(back)))
                size += len(rows[-1][2]) + len(rows[-1][3])
                if size > FRAME:
                    yield pd.DataFrame(rows, columns=COLUMNS)
                    rows, size = [], 0
            yield pd.DataFrame(rows, columns=COLUMNS)
    finally:
        if collects:
            gc.enable()


def encode(df: DataFrame, path: str | None = None) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, decoded), one for each row of ``df`` (doc_id, text): the ids as little-endian unsigned 32-bit integers, and the bytes that they decode to.

    Null and empty texts have no ids. Special tokens aren't recognised. Other columns aren't read.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    return mapped(only(df, "doc_id", "text"), partial(coded, path=path, digest=False), "doc_id long, n_tokens long, ids binary, decoded binary")


def encode_digests(df: DataFrame, path: str | None = None) -> DataFrame:
    """``encode`` with SHA-256 digests instead of the ids and bytes."""
    path = path or public_tokenizers.path(VOCABULARY)
    out = mapped(only(df, "doc_id", "text"), partial(coded, path=path, digest=True), "doc_id long, n_tokens long, ids string, decoded string")
    return out.withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(documents(spark, sf_dir))
