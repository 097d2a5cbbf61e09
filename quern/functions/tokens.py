"""Tokenisation: from a text column to an array of tokens."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs that belong together, plain tokens, and plain tokens or single punctuation characters.
CHUNK, STANDARD, WITH_PUNCTUATION = r"[\p{L}!-~]+", r"[\p{L}0-9]+", r"[\p{L}0-9]+|\p{Punct}"

# Patterns of tokens that aren't plain words, in order of precedence.
PATTERNS = (
    r"http(s){0,1}:\/\/([A-Za-z0-9\-\_\.\%]+(:\d+){0,1})\/{0,1}([A-Za-z0-9\-\'\+\_\%\.\=\&\,\@\!]*[\/\#\?\:]*)*",
    r"(\d{1,3}\.){3}\d{1,3}",
    r"(\d\-){0,1}(\d{3}\-){2}\d{4}",
    r"\d+/\d+",
    r"\w+-\w+",
    r"[a-zA-Z0-9\.\_]+@[a-zA-Z0-9\-\.]+",
    r"([A-Za-z]+\.[A-Za-z]+\.)",
    r"(\d\.)+\d+",
    r"[A-Za-z]+\d+",
    r"\+\d+",
    r"(\d+\,)+\d+",
    r"\$\d+",
    r"^[A-Za-z]*\'[A-Za-z]+$",
    r"(\d{1,2}\:){2}\d{2}",
    r"[A-Za-z0-9\_\-]+\.[a-z]+",
)


# Letters from U+00C0 to U+017E that don't decompose.
WHOLE_LETTERS = {
    "Æ": "E", "Ð": "D", "Ø": "O", "Þ": "T", "ß": "S", "æ": "e", "ð": "d", "ø": "o", "þ": "t", "Đ": "D", "đ": "d", "Ħ": "H", "ħ": "h", "ı": "i", "Ĳ": "I", "ĳ": "i", "ĸ": "k",
    "Ŀ": "L", "ŀ": "l", "Ł": "L", "ł": "l", "ŉ": "n", "Ŋ": "N", "ŋ": "n", "Œ": "O", "œ": "o", "Ŧ": "T", "ŧ": "t",
}


def diacritics() -> tuple[str, str]:
    """Letters from U+00C0 to U+017E, and the plain letters that they are built on or stand near."""
    pairs = [(chr(c), WHOLE_LETTERS.get(chr(c), unicodedata.normalize("NFD", chr(c))[0])) for c in range(0xC0, 0x17F)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def prepared(text: Column, case_folding: bool, remove_diacritics: bool, strict: bool) -> Column:
    text = F.coalesce(text, F.lit(""))
    if strict:  # a chunk that the end of the text cuts off is lost
        text = F.regexp_replace(text, CHUNK + r"\z", "")
    if remove_diacritics:
        text = F.translate(text, *diacritics())
    return F.lower(text) if case_folding else text


def split_chunk(chunk: str, patterns: list[re.Pattern], plain: re.Pattern) -> list[str]:
    """Tokens of a chunk: the first pattern that is found anywhere wins, what is before it is plain, and what follows is split anew."""
    out: list[str] = []
    while chunk:
        match = next((m for p in patterns if (m := p.search(chunk)) and m.end() > m.start()), None)
        if match is None:
            return out + plain.findall(chunk)
        out += plain.findall(chunk[: match.start()])
        out.append(match.group())
        chunk = chunk[match.end() :]
    return out


def tokens(text: Column, case_folding: bool = True, remove_diacritics: bool = False, remove_punctuation: bool = True, patterns: Iterable[str] | None = None, strict: bool = False) -> Column:
    """Tokens of a text in order, as an array; null is the empty text. Without ``patterns`` everything stays in built-in functions."""
    text = prepared(text, case_folding, remove_diacritics, strict)
    if patterns is None:
        return F.regexp_extract_all(text, F.lit(STANDARD if remove_punctuation else WITH_PUNCTUATION), F.lit(0))
    chosen, kept = list(patterns), "[^\\W_]+" if remove_punctuation else "[^\\W_]+|[!-/:-@\\[-`{-~]"

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        compiled, plain = [re.compile(p, re.ASCII) for p in chosen], re.compile(kept)
        special = re.compile(r"[^\w]|_|[A-Za-z]\d", re.ASCII)
        for batch in batches:
            yield batch.map(lambda chunks: [t for c in chunks for t in (split_chunk(c, compiled, plain) if special.search(c) else plain.findall(c))])

    return split(F.regexp_extract_all(text, F.lit(CHUNK), F.lit(0)))


def basename(path: Column) -> Column:
    """Last part of a path that isn't empty."""
    return F.element_at(F.filter(F.split(path, r"[\\/]"), lambda x: x != ""), -1)


def edit_distance(a: Column, b: Column) -> Column:
    """Insertions and deletions between two words; a substitution counts as both."""

    def row(previous: Column, i: Column) -> Column:
        def cell(current: Column, j: Column) -> Column:
            same = F.substring(a, i, F.lit(1)) == F.substring(b, j, F.lit(1))
            cheapest = F.least(F.element_at(previous, j + 1) + 1, F.element_at(current, j) + 1)
            return F.concat(current, F.array(F.when(same, F.element_at(previous, j)).otherwise(cheapest)))

        return F.aggregate(F.sequence(F.lit(1), F.length(b)), F.array(i), cell)

    full = F.element_at(F.aggregate(F.sequence(F.lit(1), F.length(a)), F.sequence(F.lit(0), F.length(b)), row), -1)
    return F.when(F.length(a) == 0, F.length(b)).when(F.length(b) == 0, F.length(a)).otherwise(full)


def kgrams(word: Column, k: int = 2) -> Column:
    """k-grams of ``^word$`` in order; none if it is shorter than k."""
    marked = F.concat(F.lit("^"), word, F.lit("$"))
    grams = F.transform(F.sequence(F.lit(1), F.length(marked) - (k - 1)), lambda i: F.substring(marked, i, F.lit(k)))
    return F.when(F.length(marked) >= k, grams).otherwise(F.array().cast("array<string>"))
