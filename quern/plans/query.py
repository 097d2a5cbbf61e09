"""Search queries as immutable values, and the rewriting of wildcards."""

from __future__ import annotations

from dataclasses import dataclass
from enum import Enum
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


class QueryType(Enum):
    INTERSECTION = "intersection"
    PHRASE = "phrase"
    RANKED = "ranked"


class RankingType(Enum):
    TF_IDF = "tf_idf"
    PAGERANK = "pagerank"
    COMBINATION = "combination"
    HITS = "hits"


@dataclass(frozen=True)
class Query:
    """Terms with weights, in order."""

    terms: tuple[tuple[str, float], ...]

    @staticmethod
    def parse(text: str) -> Query:
        """Lower-case words between blanks, each of weight 1; not tokenised further."""
        return Query(tuple((word, 1.0) for word in text.lower().strip().split()))

    def __len__(self) -> int:
        return len(self.terms)

    @property
    def words(self) -> list[str]:
        return [word for word, _ in self.terms]

    @property
    def length(self) -> float:
        """Sum of the weights."""
        return sum(weight for _, weight in self.terms)

    @property
    def has_wildcard(self) -> bool:
        return any("*" in word for word in self.words)


def matches(pattern: str, term: Column) -> Column:
    """Whether a term fits a word with one ``*`` at most; start and end are tested apart and may overlap. A lone ``*`` fits nothing."""
    if pattern.count("*") > 1:
        raise ValueError(f"more than one * in {pattern!r}")
    if "*" not in pattern:
        return term == pattern
    start, end = pattern.split("*")
    if not start and not end:
        return F.lit(False)
    return term.startswith(start) & term.endswith(end)


def any_of(patterns: list[str], term: Column) -> Column:
    return reduce(lambda x, y: x | y, [matches(p, term) for p in patterns], F.lit(False))


def places(patterns: list[str], term: Column) -> Column:
    """Places of the query's words that a term fits, as an array."""
    fits = F.array(*[F.when(matches(p, term), F.lit(i)) for i, p in enumerate(patterns)])
    return F.filter(fits, lambda x: x.isNotNull())
