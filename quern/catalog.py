"""All queries by name, over the test tables, and their SQL for DuckDB.

The corpus is the table documents, named doc<id>. Links lead from a click's user to the user of the day's next event, which gives cycles, and from an error's user to the node of its
hour, which has no targets. Queries that search read an index that is saved once for each folder of tables and session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.tokens import PATTERNS, basename, diacritics, tokens
from quern.operators import graph, index, search, spell
from quern.plans.query import Query, QueryType, RankingType, matches
from quern.sources import files
from quern.sources.tables import new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Steps of the iterative queries, as SQL has to spell them out.
STEPS, HITS_STEPS = 10, 6
WORD, TYPO = "thsh", "thee"


def query(sql: str | None = None) -> Callable[[Callable], Callable]:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def docs(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("doc_name"), "text")


def found(spark: SparkSession, d: str) -> DataFrame:
    return index.occurrences(docs(spark, d))


#: Number of the first of the nodes that stand for hours.
HOURS = 1_000_000_000


def edges(spark: SparkSession, d: str) -> DataFrame:
    events = spark.read.parquet(f"{d}/events.parquet")
    day = Window.partitionBy(F.to_date("ts")).orderBy("ts")
    steps = events.select(F.col("user_id").alias("src"), F.lead("user_id").over(day).alias("dst"), "event_type").filter("event_type = 'click' AND dst IS NOT NULL")
    errors = events.filter("event_type = 'error'").select(F.col("user_id").alias("src"), (F.hour("ts") + HOURS).cast("long").alias("dst"))
    return steps.select("src", "dst").union(errors).distinct()


def nodes(spark: SparkSession, d: str) -> DataFrame:
    users = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("node_id"))
    return users.union(edges(spark, d).select("dst")).distinct()


#: Folders of saved indexes, by session and folder of tables.
SAVED: dict[tuple[str, str], str] = {}


def saved(spark: SparkSession, d: str) -> str:
    """The folder of the index of the documents in ``d``; it is built when first asked for."""
    key = (spark.sparkContext.applicationId, d)
    if key not in SAVED:
        path = new_path(spark)
        index.Index.over(docs(spark, d)).save(path)
        SAVED[key] = path
    return SAVED[key]


def loaded(spark: SparkSession, d: str) -> index.Index:
    return index.Index.load(spark, saved(spark, d))


def engine(spark: SparkSession, d: str, ranks: bool = False) -> search.SearchEngine:
    e, n = edges(spark, d), nodes(spark, d)
    scores = graph.pagerank(e, n, 0, epsilon=None, steps=STEPS).withColumn("title", F.concat(F.lit("doc"), F.col("node_id").cast("string"))) if ranks else None
    return search.SearchEngine.load(spark, saved(spark, d), e, n, scores)


def joined_list(name: str) -> Column:
    return F.concat_ws(",", F.col(name).cast("array<string>")).alias(name)


OCC = r"""occ AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t)))::INTEGER AS "offset" FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}0-9]+') AS t FROM documents))"""
TF = f"""{OCC}, len AS (SELECT doc_id, count(*) AS n FROM occ GROUP BY 1), tf AS (SELECT term, doc_id, count(*) AS tf FROM occ GROUP BY 1, 2), df AS (SELECT term, count(*) AS df, sum(tf)::BIGINT AS cf FROM tf GROUP BY 1)"""
EDGES = f"""edges AS (SELECT src, dst FROM (SELECT user_id AS src, lead(user_id) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts) AS dst, event_type FROM events) WHERE event_type = 'click' AND dst IS NOT NULL
 UNION SELECT user_id, {HOURS} + hour(ts) FROM events WHERE event_type = 'error'), nodes AS (SELECT user_id AS node_id FROM events UNION SELECT dst FROM edges)"""


def tokens_sql(text: str, pattern: str) -> str:
    return f"""SELECT doc_id, unnest(range(len(t)))::INTEGER AS "offset", unnest(t) AS token FROM (SELECT doc_id, regexp_extract_all({text}, '{pattern}') AS t FROM documents)"""


def tfidf_sql(weights: str, name: str = "scores") -> str:
    return f"""q(term, w) AS ({weights}), {name} AS (SELECT tf.doc_id, sum(q.w * tf.tf * ln((SELECT count(*) FROM documents)::DOUBLE / df.df)) / any_value(len.n) AS score FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id) GROUP BY 1 HAVING score > 0)"""


def values(weights: dict[str, float]) -> str:
    return "VALUES " + ", ".join(f"('{t}', {w}::DOUBLE)" for t, w in weights.items())


def pagerank_sql(steps: int) -> str:
    out = [EDGES, "deg AS (SELECT src, count(*) AS out FROM edges GROUP BY 1)", "n AS (SELECT count(*)::DOUBLE AS n FROM nodes)", "r0 AS MATERIALIZED (SELECT node_id, out, CASE WHEN node_id = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS score FROM nodes LEFT JOIN deg ON src = node_id)"]
    for i in range(1, steps + 1):
        out.append(f"m{i} AS MATERIALIZED (SELECT (0.15 * (sum(score) - coalesce(sum(score) FILTER (WHERE out IS NULL), 0)) + coalesce(sum(score) FILTER (WHERE out IS NULL), 0)) / (SELECT n FROM n) AS base FROM r{i - 1})")
        out.append(f"f{i} AS (SELECT dst, sum(score / out) AS part FROM edges JOIN r{i - 1} ON src = node_id GROUP BY 1)")
        out.append(f"r{i} AS MATERIALIZED (SELECT node_id, out, 0.85 * coalesce(part, 0) + (SELECT base FROM m{i}) AS score FROM r{i - 1} LEFT JOIN f{i} ON dst = node_id)")
    return ", ".join(out)


def settled_sql(steps: int, table: str = "r", columns: tuple[str, ...] = ("score",), epsilon: float = graph.EPSILON) -> str:
    """The first of the steps r1, r2, ... after which no score moves by more than ``epsilon``."""
    move = "greatest(" + ", ".join(f"max(abs(a.{c} - b.{c}))" for c in columns) + ")"
    moves = " UNION ALL ".join(f"SELECT {i} AS step, {move} AS move FROM {table}{i} a JOIN {table}{i - 1} b USING (node_id)" for i in range(1, steps + 1))
    return f"last AS MATERIALIZED (SELECT min(step) AS step FROM ({moves}) WHERE move <= {epsilon}), done AS (" + " UNION ALL ".join(f"SELECT * FROM {table}{i} WHERE (SELECT step FROM last) = {i}" for i in range(1, steps + 1)) + ")"


def drawn_sql(*parts: str) -> str:
    return f"('0x' || md5(concat_ws(':', {', '.join(parts)}))[1:15])::BIGINT"


def monte_carlo_sql(cyclic: bool, complete: bool) -> str:
    first = "walk % (SELECT n FROM n)" if cyclic else f"{drawn_sql('walk', '0', '-1')} % (SELECT n FROM n)"
    at_end = "NULL" if complete else f"(SELECT o.node_id FROM ord o WHERE o.nr = {drawn_sql('w.walk', '0', 'w.step', '3')} % (SELECT n FROM n))"
    go = f"{drawn_sql('w.walk', '0', 'w.step', '1')} % 100 < 85"
    return f"""{EDGES}, n AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS out FROM edges GROUP BY 1),
 ord AS MATERIALIZED (SELECT node_id, row_number() OVER (ORDER BY {drawn_sql("node_id")}, node_id) - 1 AS nr FROM nodes), links AS MATERIALIZED (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY {drawn_sql("dst")}, dst) - 1 AS nr FROM edges),
 walkers AS MATERIALIZED (SELECT walk, ord.node_id FROM (SELECT walk, {first} AS nr FROM (SELECT unnest(range((SELECT n FROM n))) AS walk)) JOIN ord USING (nr)),
 w AS (SELECT walk, node_id, 0 AS step FROM walkers UNION ALL
  SELECT walk, node_id, step + 1 FROM (SELECT w.walk, w.step, CASE WHEN d.out IS NULL THEN {at_end} ELSE (SELECT l.dst FROM links l WHERE l.src = w.node_id AND l.nr = {drawn_sql("w.walk", "0", "w.step", "2")} % d.out) END AS node_id
   FROM w LEFT JOIN deg d ON d.src = w.node_id WHERE {go}) WHERE node_id IS NOT NULL),
 ends AS (SELECT node_id, count(*) AS k FROM w {"" if complete else f"WHERE NOT ({go})"} GROUP BY 1), mc AS (SELECT node_id, coalesce(k, 0) / (SELECT sum(k) FROM ends) AS score FROM nodes LEFT JOIN ends USING (node_id))"""


def monte_carlo_rows(cyclic: bool, complete: bool) -> str:
    return f"WITH RECURSIVE {monte_carlo_sql(cyclic, complete)} SELECT node_id, round(score, 9) AS score FROM mc"


def patterns_sql() -> str:
    match = "coalesce(" + ", ".join("nullif(regexp_extract(rest, '" + p.replace("'", "''") + "'), '')" for p in PATTERNS) + ")"
    plain = lambda x: rf"regexp_extract_all({x}, '[\p{{L}}0-9]+')"
    return rf"""WITH RECURSIVE chunks AS (SELECT doc_id, unnest(range(len(c))) AS nr, unnest(c) AS chunk FROM (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}!-~]+') AS c FROM documents)),
 split AS (SELECT doc_id, nr, chunk AS rest, CAST([] AS VARCHAR[]) AS t FROM chunks WHERE regexp_matches(chunk, '[^\w]|_|[A-Za-z]\d') UNION ALL
  SELECT doc_id, nr, CASE WHEN m IS NULL THEN '' ELSE rest[strpos(rest, m) + len(m):] END, t || CASE WHEN m IS NULL THEN {plain("rest")} ELSE {plain("rest[:strpos(rest, m) - 1]")} || [m] END
  FROM (SELECT *, {match} AS m FROM split WHERE rest <> '')),
 whole AS (SELECT doc_id, nr, t FROM split WHERE rest = '' UNION ALL SELECT doc_id, nr, {plain("chunk")} FROM chunks WHERE NOT regexp_matches(chunk, '[^\w]|_|[A-Za-z]\d')),
 each AS (SELECT doc_id, nr, unnest(range(len(t))) AS j, unnest(t) AS token FROM whole)
SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY nr, j) - 1)::INTEGER AS "offset", token FROM each"""


def hits_sql(steps: int, links: str, members: str) -> str:
    out = [f"h0 AS MATERIALIZED (SELECT node_id, 1.0::DOUBLE AS hub, 1.0::DOUBLE AS authority FROM {members})"]
    for i in range(1, steps + 1):
        p = f"h{i - 1}"
        out.append(f"a{i} AS MATERIALIZED (SELECT p.node_id, coalesce((SELECT sum(q.authority) FROM {links} e JOIN {p} q ON e.dst = q.node_id WHERE e.src = p.node_id), 0) AS h, coalesce((SELECT sum(q.hub) FROM {links} e JOIN {p} q ON e.src = q.node_id WHERE e.dst = p.node_id), 0) AS a FROM {p} p)")
        out.append(f"h{i} AS MATERIALIZED (SELECT node_id, h / coalesce(nullif(sqrt((SELECT sum(h * h) FROM a{i})), 0), 1) AS hub, a / coalesce(nullif(sqrt((SELECT sum(a * a) FROM a{i})), 0), 1) AS authority FROM a{i})")
    return ", ".join(out)


DEL1 = "list_transform(range(1, len({x}) + 1), lambda {i}: {x}[:{i} - 1] || {x}[{i} + 1:])"


def distance_sql(term: str, word: str) -> str:
    one = lambda x, i="i": DEL1.format(x=x, i=i)
    two = lambda x: f"flatten(list_transform({one(x)}, lambda y: {one('y', 'j')}))"
    w = f"'{word}'"
    return f"""CASE WHEN {term} = {w} THEN 0 WHEN len({term}) = {len(word)} AND list_has_any({one(term)}, {one(w)}) THEN 2
 WHEN len({term}) = {len(word) + 1} AND list_contains({one(term)}, {w}) THEN 1 WHEN len({term}) = {len(word) - 1} AND list_contains({one(w)}, {term}) THEN 1
 WHEN len({term}) = {len(word) + 2} AND list_contains({two(term)}, {w}) THEN 2 WHEN len({term}) = {len(word) - 2} AND list_contains({two(w)}, {term}) THEN 2 ELSE 9 END"""


def jaccard_sql(word: str) -> str:
    grams = spell.grams_of(word)
    listed = "[" + ", ".join(f"'{g}'" for g in grams) + "]"
    return f"""g AS (SELECT term, df, list_transform(range(1, len(term) + 2), lambda i: ('^' || term || '$')[i:i + 1]) AS gs FROM df),
 j AS (SELECT term, df, len(list_filter(gs, lambda x: list_contains({listed}, x))) AS shared, len(gs) AS n FROM g), jac AS (SELECT term, df, shared / ({len(grams)} + n - shared)::DOUBLE AS jaccard FROM j WHERE shared > 0)"""


def candidates_sql(word: str) -> str:
    return f"""{TF}, {jaccard_sql(word)}, cand AS (SELECT *, df / jaccard / distance AS score FROM (SELECT term, jaccard, ({distance_sql("term", word)})::INTEGER AS distance, df FROM jac WHERE jaccard >= 0.4) WHERE distance BETWEEN 1 AND 2)"""


# --- sources ---


@query("SELECT doc_id, 'doc' || doc_id AS doc_name, length(text)::INTEGER AS n_chars FROM documents")
def scan_documents(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", "doc_name", F.length("text").alias("n_chars"))


@query(r"""SELECT (unnest(range(len(l))))::INTEGER AS line_no, trim(unnest(l)) AS line FROM (SELECT string_split(text, chr(10)) AS l FROM documents WHERE doc_id = 7)""")
def fetch_document(spark: SparkSession, d: str) -> DataFrame:
    return files.fetch_document(docs(spark, d), "doc7")


@query("SELECT doc_id, 'doc' || doc_id AS name FROM documents")
def doc_basename(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", basename(F.concat(F.lit("corpus/part\\"), "doc_name", F.lit("/"))).alias("name"))


@query(f"WITH {EDGES} SELECT src, dst FROM edges")
def graph_edges(spark: SparkSession, d: str) -> DataFrame:
    lines = edges(spark, d).select(F.concat_ws(";", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return files.parse_links(lines)[0].select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst"))


@query(f"WITH {EDGES} SELECT node_id FROM nodes")
def graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    declared = nodes(spark, d).select(F.concat(F.col("node_id").cast("string"), F.lit(";")).alias("value"))
    lines = edges(spark, d).select(F.concat_ws(";", F.col("src").cast("string"), F.col("dst").cast("string")).alias("value"))
    return files.parse_links(declared.union(lines))[1].select(F.col("node_id").cast("long").alias("node_id"))


# --- tokens ---


def token_rows(spark: SparkSession, d: str, **flags: object) -> DataFrame:
    return index.occurrences(docs(spark, d), **flags).select("doc_id", "offset", F.col("term").alias("token"))


@query(tokens_sql("text", r"[\p{L}0-9]+"))
def tokenize_standard(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, d, case_folding=False)


@query(tokens_sql("lower(text)", r"[\p{L}0-9]+"))
def tokenize_casefold(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, d)


@query(tokens_sql("lower(text)", r"[\p{L}0-9]+|[[:punct:]]"))
def tokenize_keep_punct(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, d, remove_punctuation=False)


@query(tokens_sql("lower(translate(text, '{}', '{}'))".format(*diacritics()), r"[\p{L}0-9]+"))
def tokenize_nodiacritics(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, d, remove_diacritics=True)


@query(patterns_sql())
def tokenize_patterns(spark: SparkSession, d: str) -> DataFrame:
    return token_rows(spark, d, patterns=PATTERNS)


# --- index ---


@query(f"""WITH {OCC} SELECT term, doc_id, "offset" FROM occ""")
def occurrences(spark: SparkSession, d: str) -> DataFrame:
    return found(spark, d)


POSTINGS = f"""WITH {OCC} SELECT term, doc_id, count(*)::INTEGER AS tf, string_agg("offset"::VARCHAR, ',' ORDER BY "offset") AS offsets FROM occ"""


@query(POSTINGS + " GROUP BY 1, 2")
def inverted_index(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(docs(spark, d)).select("term", "doc_id", "tf", joined_list("offsets"))


@query(r"""SELECT doc_id, len(regexp_extract_all(lower(text), '[\p{L}0-9]+'))::INTEGER AS doc_len FROM documents""")
def doc_lengths(spark: SparkSession, d: str) -> DataFrame:
    return index.doc_lengths(docs(spark, d))


@query(POSTINGS + f" WHERE term = '{WORD}' GROUP BY 1, 2")
def term_lookup(spark: SparkSession, d: str) -> DataFrame:
    return loaded(spark, d).postings.filter(F.col("term") == WORD).select("term", "doc_id", "tf", joined_list("offsets"))


@query(f"WITH {TF} SELECT term, df FROM df")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index.dictionary(index.postings(docs(spark, d))).select("term", "df")


@query(f"WITH {TF} SELECT term, doc_id, tf FROM tf")
def term_frequency(spark: SparkSession, d: str) -> DataFrame:
    return index.postings(docs(spark, d)).select("term", "doc_id", F.col("tf").cast("long").alias("tf"))


@query(f"WITH {TF} SELECT term, df, cf FROM df")
def term_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return index.dictionary(index.postings(docs(spark, d)))


@query(f"WITH {OCC} SELECT doc_id || ';doc' || doc_id || ';' || count(*) AS line FROM occ GROUP BY doc_id")
def documents_codec(spark: SparkSession, d: str) -> DataFrame:
    lines = files.encode_documents(loaded(spark, d).documents)
    return files.encode_documents(files.decode_documents(lines))


@query(f"WITH {OCC} SELECT DISTINCT unnest(list_transform(range(1, len(term) + 2), lambda i: ('^' || term || '$')[i:i + 1])) AS gram, term FROM (SELECT DISTINCT term FROM occ)")
def kgram_index(spark: SparkSession, d: str) -> DataFrame:
    return index.kgram_index(found(spark, d).select("term").distinct())


@query(f"WITH {OCC} SELECT term, count(*) AS n FROM occ WHERE doc_id = 7 GROUP BY 1")
def doc_term_vector(spark: SparkSession, d: str) -> DataFrame:
    return index.occurrences(docs(spark, d).filter("doc_id = 7")).groupBy("term").agg(F.count("*").alias("n"))


@query(f"WITH {OCC} SELECT DISTINCT doc_id FROM occ WHERE term = 'tion' AND doc_id IN (SELECT doc_id FROM occ WHERE term = '{WORD}')")
def postings_intersect(spark: SparkSession, d: str) -> DataFrame:
    lists = loaded(spark, d).postings
    return index.intersect(lists.filter("term = 'tion'"), lists.filter(F.col("term") == WORD))


@query(POSTINGS + f" WHERE term IN ('tion', '{WORD}') GROUP BY 1, 2")
def postings_merge(spark: SparkSession, d: str) -> DataFrame:
    lists = loaded(spark, d).postings
    return index.merge(*[lists.filter(F.col("term") == t) for t in ("tion", WORD)]).select("term", "doc_id", "tf", joined_list("offsets"))


@query(POSTINGS + " GROUP BY 1, 2")
def index_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    path = new_path(spark)
    index.Index.over(docs(spark, d)).save(path)
    return index.Index.load(spark, path).postings.select("term", "doc_id", "tf", joined_list("offsets"))


@query(POSTINGS + " GROUP BY 1, 2")
def index_segment_merge(spark: SparkSession, d: str) -> DataFrame:
    path, all_docs = new_path(spark), docs(spark, d)
    for part in range(2):
        index.save_postings(index.postings(all_docs.filter(F.col("doc_id") % 2 == part)), path, "append")
    return index.merge(spark.read.parquet(path)).select("term", "doc_id", "tf", joined_list("offsets"))


@query(f"""WITH {OCC}, p AS (SELECT term, doc_id, string_agg("offset"::VARCHAR, ',' ORDER BY "offset") AS o FROM occ GROUP BY 1, 2) SELECT term, doc_id // 100000 AS block, term || ';' || string_agg('~' || doc_id || ',' || o || ',', '' ORDER BY doc_id) AS line FROM p GROUP BY 1, 2""")
def postings_codec(spark: SparkSession, d: str) -> DataFrame:
    return files.encode_postings(files.decode_postings(files.encode_postings(index.postings(docs(spark, d)))))


# --- search ---


def searched(text: str, kind: QueryType, ranking: RankingType = RankingType.TF_IDF, ranks: bool = False) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: engine(spark, d, ranks).search(text, kind, ranking)


@query(f"WITH {OCC} SELECT doc_id FROM occ WHERE term IN ('the', 'of', 'tion') GROUP BY 1 HAVING count(DISTINCT term) = 3")
def search_intersection(spark: SparkSession, d: str) -> DataFrame:
    return searched("the of tion", QueryType.INTERSECTION)(spark, d)


@query(f"""WITH {OCC} SELECT a.doc_id, max(b."offset") AS last_offset FROM occ a JOIN occ b ON a.doc_id = b.doc_id AND b."offset" = a."offset" + 1 WHERE a.term = 'of' AND b.term = 'the' GROUP BY 1""")
def search_phrase(spark: SparkSession, d: str) -> DataFrame:
    return searched("of the", QueryType.PHRASE)(spark, d)


@query(f"WITH {OCC} SELECT doc_id, count(DISTINCT term) AS n_terms FROM occ WHERE term IN ('{WORD}', 'thble') GROUP BY 1")
def search_union(spark: SparkSession, d: str) -> DataFrame:
    query_ = Query.parse(f"{WORD} thble")
    return search.union(engine(spark, d).occurrences(query_), query_)


@query(f"WITH {OCC} SELECT term FROM (SELECT DISTINCT term FROM occ) WHERE contains('^' || term || '$', '^t') AND contains('^' || term || '$', 'on') AND contains('^' || term || '$', 'n$')")
def kgram_lookup(spark: SparkSession, d: str) -> DataFrame:
    return index.kgram_lookup(loaded(spark, d).grams, ["^t", "on", "n$"])


@query(f"WITH {OCC} SELECT term FROM (SELECT DISTINCT term FROM occ) WHERE contains('^' || term || '$', '^t') AND contains('^' || term || '$', 'on') ORDER BY term LIMIT 10")
def kgram_lookup_first(spark: SparkSession, d: str) -> DataFrame:
    return index.kgram_lookup(loaded(spark, d).grams, ["^t", "on"]).orderBy("term").limit(10)


def terms_like(spark: SparkSession, d: str, pattern: str) -> DataFrame:
    return loaded(spark, d).fitting(pattern)


@query(f"WITH {OCC} SELECT DISTINCT term FROM occ WHERE starts_with(term, 'tion')")
def wildcard_prefix(spark: SparkSession, d: str) -> DataFrame:
    return terms_like(spark, d, "tion*")


@query(f"WITH {OCC} SELECT DISTINCT term FROM occ WHERE ends_with(term, 'tion')")
def wildcard_suffix(spark: SparkSession, d: str) -> DataFrame:
    return terms_like(spark, d, "*tion")


INFIX = "starts_with(term, 'th') AND ends_with(term, 'tion')"


@query(f"WITH {OCC} SELECT DISTINCT term FROM occ WHERE {INFIX}")
def wildcard_infix(spark: SparkSession, d: str) -> DataFrame:
    return terms_like(spark, d, "th*tion")


@query(f"WITH {OCC} SELECT doc_id FROM occ WHERE {INFIX} AND doc_id IN (SELECT doc_id FROM occ WHERE term = 'of') GROUP BY 1")
def search_wildcard_intersection(spark: SparkSession, d: str) -> DataFrame:
    return searched("th*tion of", QueryType.INTERSECTION)(spark, d)


@query(f"""WITH {OCC} SELECT a.doc_id, max(b."offset") AS last_offset FROM occ a JOIN (SELECT * FROM occ WHERE {INFIX}) b ON a.doc_id = b.doc_id AND b."offset" = a."offset" + 1 WHERE a.term = 'of' GROUP BY 1""")
def search_wildcard_phrase(spark: SparkSession, d: str) -> DataFrame:
    return searched("of th*tion", QueryType.PHRASE)(spark, d)


def rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(f"WITH {TF}, {tfidf_sql(f'SELECT DISTINCT term, 1.0 FROM occ WHERE {INFIX}')} SELECT doc_id, round(score, 6) AS score FROM scores")
def search_wildcard_ranked(spark: SparkSession, d: str) -> DataFrame:
    return rounded(searched("th*tion", QueryType.RANKED)(spark, d))


THREE = values({"the": 1.0, "of": 1.0, "and": 1.0})


@query(f"WITH {TF}, {tfidf_sql(THREE)} SELECT doc_id, round(score, 6) AS score FROM scores")
def search_ranked_tfidf(spark: SparkSession, d: str) -> DataFrame:
    return rounded(searched("the of and", QueryType.RANKED)(spark, d))


@query(f"WITH {TF}, {tfidf_sql(values({'the': 0.5, 'tion': 2.0}))} SELECT doc_id, round(score, 6) AS score FROM scores")
def search_ranked_tfidf_weighted(spark: SparkSession, d: str) -> DataFrame:
    return rounded(engine(spark, d).search(Query((("the", 0.5), ("tion", 2.0))), QueryType.RANKED))


RANKED = f"WITH {TF}, {tfidf_sql(THREE)}, {pagerank_sql(STEPS)}"


@query(f"{RANKED} SELECT s.doc_id, round(coalesce(r.score, 0), 6) AS score FROM scores s LEFT JOIN r{STEPS} r ON s.doc_id = r.node_id")
def search_ranked_pagerank(spark: SparkSession, d: str) -> DataFrame:
    return rounded(searched("the of and", QueryType.RANKED, RankingType.PAGERANK, ranks=True)(spark, d))


@query(f"{RANKED} SELECT s.doc_id, round(0.4 * s.score + 0.6 * coalesce(r.score, 0), 6) AS score FROM scores s LEFT JOIN r{STEPS} r ON s.doc_id = r.node_id")
def search_ranked_combination(spark: SparkSession, d: str) -> DataFrame:
    return rounded(searched("the of and", QueryType.RANKED, RankingType.COMBINATION, ranks=True)(spark, d))


BASE = f"""{OCC}, {EDGES}, root AS (SELECT DISTINCT doc_id AS node_id FROM occ WHERE term IN ('{WORD}', 'thble')),
 near AS (SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM root) OR dst IN (SELECT node_id FROM root)),
 members AS (SELECT src AS node_id FROM near UNION SELECT dst FROM near UNION SELECT node_id FROM root WHERE node_id IN (SELECT node_id FROM nodes))"""


@query(f"WITH {BASE}, {hits_sql(HITS_STEPS, 'near', 'members')} SELECT node_id AS doc_id, round(hub + authority, 6) AS score FROM h{HITS_STEPS} WHERE node_id IN (SELECT doc_id FROM documents)")
def search_ranked_hits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(engine(spark, d).hits(Query.parse(f"{WORD} thble"), HITS_STEPS))


@query(f"WITH {TF}, {tfidf_sql(THREE)} SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT 10")
def topk_results(spark: SparkSession, d: str) -> DataFrame:
    best = searched("the of and", QueryType.RANKED)(spark, d).withColumn("score", F.round("score", 9))
    return rounded(search.top(best, 10))


@query(f"WITH {TF}, {tfidf_sql(THREE)} SELECT doc_id, round(score, 6) AS score FROM scores ORDER BY round(score, 9) DESC, doc_id LIMIT 10 OFFSET 10")
def page_results(spark: SparkSession, d: str) -> DataFrame:
    best = searched("the of and", QueryType.RANKED)(spark, d).withColumn("score", F.round("score", 9))
    return rounded(search.top(best, 10, skip=10))


FEEDBACK = "fb AS (SELECT term, sum(w) AS weight FROM (SELECT * FROM (VALUES ('the', 0.1::DOUBLE), ('tion', 0.1::DOUBLE)) AS v(term, w) UNION ALL SELECT term, 0.8 * count(*) FROM occ WHERE doc_id IN (7, 11) GROUP BY 1) GROUP BY 1)"


@query(f"WITH {OCC}, {FEEDBACK} SELECT term, round(weight, 6) AS weight FROM fb")
def relevance_feedback_weights(spark: SparkSession, d: str) -> DataFrame:
    return search.feedback_weights(found(spark, d), Query.parse("the tion"), [7, 11]).withColumn("weight", F.round("weight", 6))


@query(f"WITH {TF}, {FEEDBACK}, {tfidf_sql('SELECT term, weight FROM fb')} SELECT doc_id, round(score, 6) AS score FROM scores")
def search_feedback_tfidf(spark: SparkSession, d: str) -> DataFrame:
    weights = search.feedback_weights(found(spark, d), Query.parse("the tion"), [7, 11])
    return rounded(search.tf_idf(loaded(spark, d), weights))


# --- spelling ---


@query(f"WITH {TF}, {jaccard_sql(TYPO)} SELECT term, round(jaccard, 6) AS jaccard FROM jac")
def spell_jaccard(spark: SparkSession, d: str) -> DataFrame:
    return spell.jaccard(loaded(spark, d).terms, TYPO).select("term", F.round("jaccard", 6).alias("jaccard"))


@query(f"WITH {OCC} SELECT term, ({distance_sql('term', TYPO)})::INTEGER AS distance FROM (SELECT DISTINCT term FROM occ) WHERE distance <= 2")
def spell_edit_distance(spark: SparkSession, d: str) -> DataFrame:
    from quern.functions.tokens import edit_distance

    terms = loaded(spark, d).terms.select("term").filter(F.levenshtein("term", F.lit(TYPO)) <= 2)
    return terms.select("term", edit_distance(F.col("term"), F.lit(TYPO)).alias("distance")).filter("distance <= 2")


@query(f"WITH {candidates_sql(TYPO)} SELECT term, round(jaccard, 6) AS jaccard, distance, df, round(score, 6) AS score FROM cand")
def spell_candidates(spark: SparkSession, d: str) -> DataFrame:
    near = spell.candidates(spell.sharing(loaded(spark, d), TYPO), TYPO)
    return near.select("term", F.round("jaccard", 6).alias("jaccard"), "distance", "df", F.round("score", 6).alias("score"))


@query(f"WITH {candidates_sql(TYPO)} SELECT term AS suggestion, round(score, 6) AS score FROM cand ORDER BY cand.score DESC, term LIMIT 10")
def spell_check_single(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spell.check(loaded(spark, d), TYPO))


@query(f"""WITH {candidates_sql(TYPO)}, c AS (SELECT term, score, row_number() OVER (ORDER BY score DESC, term) AS nr, count(*) OVER () AS n FROM cand), b AS (SELECT * FROM c WHERE nr <= least(n // 2 + 1, 6)),
 p AS (SELECT b.term || ' of' AS suggestion, (b.score + 1) * (SELECT count(*) FROM tf x JOIN tf y USING (doc_id) WHERE x.term = b.term AND y.term = 'of') AS score FROM b) SELECT suggestion, round(score, 6) AS score FROM p ORDER BY p.score DESC, suggestion LIMIT 10""")
def spell_check_phrase(spark: SparkSession, d: str) -> DataFrame:
    return rounded(spell.check(loaded(spark, d), f"{TYPO} of"))


@query("SELECT doc_id, CASE WHEN length(text) > 50 THEN text[:50] || '...' ELSE text END AS shown FROM documents")
def spell_display(spark: SparkSession, d: str) -> DataFrame:
    return spell.displayed(docs(spark, d).withColumnRenamed("text", "suggestion")).select("doc_id", "shown")


# --- graphs ---


@query(f"WITH {EDGES} SELECT src AS node_id, count(*) AS out FROM edges GROUP BY 1")
def graph_out_degree(spark: SparkSession, d: str) -> DataFrame:
    return graph.out_degree(edges(spark, d))


@query(f"WITH {EDGES} SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT src FROM edges)")
def graph_dangling(spark: SparkSession, d: str) -> DataFrame:
    return graph.dangling(nodes(spark, d), edges(spark, d))


def ranks(spark: SparkSession, d: str, steps: int = STEPS) -> DataFrame:
    return graph.pagerank(edges(spark, d), nodes(spark, d), 0, epsilon=None, steps=steps)


PAGERANK = f"WITH {pagerank_sql(STEPS)}"


#: Steps that the SQL spells out for iterations that stop by themselves; they stop earlier.
ENOUGH = 20


@query(f"WITH {pagerank_sql(ENOUGH)}, {settled_sql(ENOUGH)} SELECT node_id, round(score, 6) AS score FROM done")
def pagerank_dense(spark: SparkSession, d: str) -> DataFrame:
    return rounded(graph.pagerank(edges(spark, d), nodes(spark, d), 0, steps=100))


@query(f"{PAGERANK} SELECT node_id, round(score, 6) AS score FROM r{STEPS}")
def pagerank_sparse(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranks(spark, d))


@query(f"{PAGERANK} SELECT node_id, round(score, 5) AS score FROM r{STEPS} ORDER BY round(score, 9) DESC, node_id LIMIT 30")
def pagerank_top30(spark: SparkSession, d: str) -> DataFrame:
    best = ranks(spark, d).withColumn("score", F.round("score", 9))
    return best.orderBy(F.desc("score"), "node_id").limit(30).select("node_id", F.round("score", 5).alias("score"))


@query(f"WITH RECURSIVE {monte_carlo_sql(True, True)}, {pagerank_sql(STEPS).removeprefix(EDGES + ', ').replace('n AS (SELECT count(*)::DOUBLE AS n FROM nodes), ', '').replace('deg AS (SELECT src, count(*) AS out FROM edges GROUP BY 1), ', '')}, truth AS (SELECT node_id, round(score, 5) AS score FROM r{STEPS} ORDER BY round(score, 9) DESC, node_id LIMIT 30) SELECT round(sum(power(mc.score - truth.score, 2)), 9) AS sse FROM mc JOIN truth USING (node_id)")
def pagerank_sse(spark: SparkSession, d: str) -> DataFrame:
    lines = pagerank_top30(spark, d).select(F.format_string("%s: %.5f", F.col("node_id").cast("string"), "score").alias("value"))
    truth = files.parse_truth(lines).withColumn("node_id", F.col("node_id").cast("long"))
    walked = graph.monte_carlo(edges(spark, d), nodes(spark, d), cyclic=True, complete=True)
    return graph.squared_error(walked, truth).select(F.round("sse", 9).alias("sse"))


@query(monte_carlo_rows(False, False))
def mc_endpoint_random(spark: SparkSession, d: str) -> DataFrame:
    walked = graph.monte_carlo(edges(spark, d), nodes(spark, d), cyclic=False, complete=False)
    return walked.withColumn("score", F.round("score", 9))


@query(monte_carlo_rows(True, False))
def mc_endpoint_cyclic(spark: SparkSession, d: str) -> DataFrame:
    walked = graph.monte_carlo(edges(spark, d), nodes(spark, d), cyclic=True, complete=False)
    return walked.withColumn("score", F.round("score", 9))


@query(monte_carlo_rows(True, True))
def mc_complete_cyclic(spark: SparkSession, d: str) -> DataFrame:
    walked = graph.monte_carlo(edges(spark, d), nodes(spark, d), cyclic=True, complete=True)
    return walked.withColumn("score", F.round("score", 9))


@query(monte_carlo_rows(False, True))
def mc_complete_random(spark: SparkSession, d: str) -> DataFrame:
    walked = graph.monte_carlo(edges(spark, d), nodes(spark, d), cyclic=False, complete=True)
    return walked.withColumn("score", F.round("score", 9))


@query(f"WITH {BASE} SELECT src, dst FROM near")
def hits_base_set(spark: SparkSession, d: str) -> DataFrame:
    root = search_union(spark, d).select(F.col("doc_id").alias("node_id"))
    return graph.base_set(edges(spark, d), root, nodes(spark, d))[0]


WHOLE = f"WITH {EDGES}, {hits_sql(HITS_STEPS, 'edges', 'nodes')}"


def whole_hits(spark: SparkSession, d: str) -> DataFrame:
    return graph.hits(edges(spark, d), nodes(spark, d), steps=HITS_STEPS)


@query(f"{WHOLE} SELECT node_id, round(hub, 6) AS score FROM h{HITS_STEPS}")
def hits_hubs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole_hits(spark, d).select("node_id", F.col("hub").alias("score")))


@query(f"{WHOLE} SELECT node_id, round(authority, 6) AS score FROM h{HITS_STEPS}")
def hits_authorities(spark: SparkSession, d: str) -> DataFrame:
    return rounded(whole_hits(spark, d).select("node_id", F.col("authority").alias("score")))


@query(f"WITH {EDGES}, {hits_sql(ENOUGH // 2, 'edges', 'nodes')}, {settled_sql(ENOUGH // 2, 'h', ('hub', 'authority'), graph.HITS_EPSILON)} SELECT node_id, round(hub, 6) AS hub, round(authority, 6) AS authority FROM done")
def hits_converged(spark: SparkSession, d: str) -> DataFrame:
    return graph.hits(edges(spark, d), nodes(spark, d)).select("node_id", F.round("hub", 6).alias("hub"), F.round("authority", 6).alias("authority"))


def best_sql(name: str) -> str:
    return f"(SELECT '{name}' AS kind, node_id, round({name}, 5) AS score FROM h{HITS_STEPS} ORDER BY round({name}, 9) DESC, node_id LIMIT 30)"


@query(f"{WHOLE} SELECT * FROM {best_sql('hub')} UNION ALL SELECT * FROM {best_sql('authority')}")
def hits_top30(spark: SparkSession, d: str) -> DataFrame:
    both = whole_hits(spark, d)
    best = [both.select(F.lit(k).alias("kind"), "node_id", F.round(k, 9).alias("score")).orderBy(F.desc("score"), "node_id").limit(30) for k in ("hub", "authority")]
    return best[0].unionByName(best[1]).withColumn("score", F.round("score", 5))
