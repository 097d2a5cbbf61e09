"""Quality rules by distribution divergence.

The histograms of a document's character classes and of its common words are compared with those of each language's documents together, by Jensen-Shannon distance. A document is
rejected when it is far from every language. Short documents, whose histograms say little, and languages with little text aren't judged. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.shared import BLANK, cut, documents, let, only, words_of

#: Common words of the languages that have a reference; the last bin is for all other words.
COMMON = {
    "en": ("the", "of", "and", "to", "in", "is", "that", "was", "with", "for"),
    "fr": ("le", "les", "et", "des", "est", "dans", "pour", "une", "que", "sur"),
    "de": ("der", "die", "und", "zu", "den", "von", "das", "mit", "ist", "nicht"),
    "es": ("el", "los", "y", "del", "en", "una", "por", "para", "las", "con"),
}
#: Character classes that are counted; blanks and all other characters are two more bins.
CLASSES = {"upper": "[^A-Z]+", "digit": "[^0-9]+", "stop": "[^.,;:!?]+", "n_symbols": "[^#*$%&|<>]+"}
#: Least words of a judged document; least characters of a reference; the distances above which a document is far from a language.
LEAST_WORDS, LEAST_CHARS, FAR_CHARS, FAR_WORDS = 30, 2_000, 0.25, 0.3


def repeat_words(words: Column) -> Column:
    """Words in windows of five that occur twice or more, the first included; windows are told apart by 64-bit hashes."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.xxhash64(*[F.element_at(w, i + j) for j in range(5)]))

    def flagged(s: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(s, j)["h"] == x["h"], F.lit(False))
        return F.array_sort(F.transform(F.filter(s, lambda x, j: same(x, j - 1) | same(x, j + 1)), lambda x: x["i"]))

    def cover(p: Column) -> Column:
        return F.aggregate(F.transform(p, lambda x, j: F.least(F.lit(5), F.coalesce(F.get(p, j + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)

    def counted(h: Column) -> Column:
        sorted_ = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(sorted_, lambda s: let(flagged(s), cover)))

    return F.when(F.size(words) < 5, F.lit(0)).otherwise(let(windows(words), counted))


def measured(df: DataFrame) -> DataFrame:
    """One row for each document: counts of the base rules, of character classes and of common words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = [w for c in COMMON.values() for w in c]
    lines = F.filter(F.split(text, "\n"), lambda line: F.regexp_replace(line, BLANK, "") != "")
    places = lambda w: F.filter(F.transform(w, lambda x: F.array_position(F.array(*map(F.lit, names)), F.rtrim(F.lower(x), F.lit(".,;:!?"))).cast("int")), lambda x: x > 0)
    common = lambda w: let(places(w), lambda p: F.transform(F.array(*[F.lit(i + 1) for i in range(len(names))]), lambda k: F.size(F.filter(p, lambda x: x == k))))
    per_word = let(words_of(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words"), common(w).alias("common")))
    counts = [F.length(F.regexp_replace(text, p, "")).cast("long").alias(c) for c, p in CLASSES.items()]
    dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")
    out = only(df, "doc_id", "text", "lang").select("doc_id", "lang", F.length(text).cast("long").alias("chars"), F.length(F.regexp_replace(text, BLANK, "")).cast("long").alias("word_chars"), *counts, dup, per_word.alias("w"))
    return out.select("doc_id", "lang", "chars", "word_chars", *CLASSES, "n_dup_lines", "w.*")


def histograms() -> tuple[list[Column], list[Column]]:
    """Counts by character class and by common word, as columns of ``measured``."""
    size = sum(map(len, COMMON.values()))
    classes = [F.col(c) for c in CLASSES]
    words = [F.element_at("common", i + 1) for i in range(size)]
    return [*classes, F.col("chars") - F.col("word_chars"), F.col("word_chars") - reduce(Column.__add__, classes)], [*words, F.col("n_words") - F.aggregate("common", F.lit(0), lambda a, x: a + x)]


def distance(counts: list[Column], reference: list[float]) -> Column:
    """Jensen-Shannon distance, base 2, of a histogram of counts to a distribution."""
    other = F.array(*[F.lit(float(q)) for q in reference])

    def compare(c: Column) -> Column:
        total = F.greatest(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), F.lit(1.0))
        return let(total, lambda t: F.aggregate(F.zip_with(c, other, lambda x, q: jensen(x / t, q)), F.lit(0.0), lambda a, x: a + x))

    return F.sqrt(F.greatest(F.lit(0.0), let(F.array(*[c.cast("double") for c in counts]), compare) / 2))


def jensen(p: Column, q: Column) -> Column:
    m = (p + q) / 2
    return F.when(p > 0, p * F.log2(p / m)).otherwise(0.0) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)


def judged(df: DataFrame, least_words: int = LEAST_WORDS, far_chars: float = FAR_CHARS, far_words: float = FAR_WORDS) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, char_distance, word_distance, base_failed, kept), one for each row of ``df`` (doc_id, text, lang).

    The distances are those to the language that is nearest by the larger of both, each as a part of its limit; they are null where nothing is judged: under ``least_words`` words,
    or where no language has LEAST_CHARS characters. References are taken over all rows of the language, repeated ones counted each time. Null and empty texts have no words and fail
    the base rules. Other columns aren't read.
    """
    rows = cut(measured(df))
    chars, words = histograms()
    size = (len(chars), len(words))
    sums = [F.sum(F.when(F.col("lang") == lang, c)).alias(f"{lang}{i}") for lang in COMMON for i, c in enumerate([*chars, *words])]
    total = rows.agg(*sums).first()  # one row of fixed width
    near = []
    for lang in COMMON:
        seen = [float(total[f"{lang}{i}"] or 0) for i in range(sum(size))]
        if sum(seen[: size[0]]) < LEAST_CHARS:
            continue
        c, w = ([x / max(1.0, sum(part)) for x in part] for part in (seen[: size[0]], seen[size[0] :]))
        near.append((distance(chars, c), distance(words, w)))
    judge = F.col("n_words") >= least_words
    found = F.array(*[let(F.struct(c.alias("c"), w.alias("w")), lambda d: F.struct(F.greatest(d["c"] / far_chars, d["w"] / far_words).alias("far"), d["c"].alias("c"), d["w"].alias("w"))) for c, w in near])
    best = F.when(judge, F.array_min(found)) if near else F.lit(None).cast("struct<far:double,c:double,w:double>")
    out = rows.withColumn("best", best).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("best.far") <= 1, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", F.col("best.c").alias("char_distance"), F.col("best.w").alias("word_distance"), "base_failed", kept.alias("kept"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judged(documents(spark, sf_dir)).drop("char_distance", "word_distance")


def quoted(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def oracle() -> str:
    blank, names = r"'[\x20\x09-\x0D]+'", [w for c in COMMON.values() for w in c]
    counts = ", ".join(f"length(regexp_replace(t, '{p}', '', 'g')) AS {c}" for c, p in CLASSES.items())
    classes = " + ".join(CLASSES)
    return rf"""
WITH d AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), {blank}), lambda x: x <> '') AS w FROM documents),
 five AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1))) AS i FROM d)),
 again AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM five QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1), (SELECT unnest(range(0, 5)) AS j) GROUP BY doc_id),
 m AS (SELECT doc_id, lang, len(w) AS n_words, length(t) AS chars, length(regexp_replace(t, {blank}, '', 'g')) AS word_chars, {counts},
  list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, {blank}, '', 'g') <> '') AS lines, list_transform(w, lambda x: rtrim(lower(x), '.,;:!?')) AS plain FROM d),
 h AS (SELECT *, [{", ".join(CLASSES)}, chars - word_chars, word_chars - ({classes})] AS c, list_transform({quoted(names)}, lambda k: len(list_filter(plain, lambda x: x = k))) AS common FROM m),
 q AS MATERIALIZED (SELECT * EXCLUDE (common), list_append(common, n_words - list_sum(common)) AS k FROM h),
 bins AS (SELECT lang, kind, i, sum(x) AS n FROM (SELECT lang, 'c' AS kind, unnest(range(len(c))) AS i, unnest(c) AS x FROM q UNION ALL SELECT lang, 'k', unnest(range(len(k))), unnest(k) FROM q) WHERE lang IN {tuple(COMMON)} GROUP BY ALL),
 ref AS (SELECT lang, list(n ORDER BY i) FILTER (WHERE kind = 'c') AS rc, list(n ORDER BY i) FILTER (WHERE kind = 'k') AS rk FROM bins GROUP BY lang HAVING sum(n) FILTER (WHERE kind = 'c') >= {LEAST_CHARS}),
 pair AS (SELECT q.doc_id, list_transform(list_zip(c, rc), lambda z: [z[1] / greatest(list_sum(c), 1), z[2] / greatest(list_sum(rc), 1)]) AS pc, list_transform(list_zip(k, rk), lambda z: [z[1] / greatest(list_sum(k), 1), z[2] / greatest(list_sum(rk), 1)]) AS pk FROM q, ref),
 js AS (SELECT doc_id, {" , ".join(f"sqrt(greatest(0, list_sum(list_transform({p}, lambda z: CASE WHEN z[1] > 0 THEN z[1] * log2(2 * z[1] / (z[1] + z[2])) ELSE 0 END + CASE WHEN z[2] > 0 THEN z[2] * log2(2 * z[2] / (z[1] + z[2])) ELSE 0 END)) / 2)) AS {p}" for p in ("pc", "pk"))} FROM pair),
 far AS (SELECT doc_id, min(greatest(pc / {FAR_CHARS}, pk / {FAR_WORDS})) AS far FROM js GROUP BY doc_id),
 base AS (SELECT q.*, coalesce(again.n, 0) AS again, n_words < 10 OR 100 * coalesce(again.n, 0) > 20 * n_words AS base_failed FROM q LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, again::BIGINT AS n_repeat_words, base_failed,
 NOT base_failed AND (n_words < {LEAST_WORDS} OR coalesce(far, 0) <= 1) AS kept FROM base LEFT JOIN far USING (doc_id)
"""


ORACLE = oracle()
