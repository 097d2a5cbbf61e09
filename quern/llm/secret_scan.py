"""Secret scans with multipart credential linking.

Strong patterns are reported wherever they match. Weak ones - names of users and clients, mixed tokens, endpoints - are candidates, which an interval join within each document
pairs with their complement: an identifier with a secret, and an endpoint with both. Only candidates with a complement within SCOPE characters are reported. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.llm.shared import cut, documents, let, only

#: Fixed patterns of the base kinds, in the order of kinds; the keywords of assign match in either case.
KEYWORDS = ("password", "passwd", "secret", "token", "api_?key")
#: Names of the weak identifiers' fields and schemes of endpoints.
NAMES, SCHEMES = ("client_?id", "access_?key_?id", "user_?name", "login", "account"), ("https?", "ftp", "postgres", "mysql", "mongodb", "redis", "amqp")
#: Characters between two parts at most.
SCOPE = 300


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = "(?:" + "|".join(map(either_case, KEYWORDS)) + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
PATTERNS = {
    "assign": ASSIGN,
    "access": "AKIA[A-Z0-9]{14,}",
    "hex": "[0-9a-f]{16,}",
    "ident": "(?:" + "|".join(map(either_case, NAMES)) + r""")["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""",
    "mixed": "[A-Za-z0-9+/_-]{20,}",
    "endpoint": "(?:" + "|".join(SCHEMES) + r""")://[^\x20\x09-\x0D"'<>]{4,}""",
}
KINDS = tuple(PATTERNS)
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "mixed")


def passing(kind: str, match: Column) -> Column:
    """What a match must hold besides its pattern."""
    if kind == "assign":
        return F.length(F.regexp_extract(match, ASSIGN, 1)) >= 12
    if kind == "mixed":
        return match.rlike("[a-z]") & match.rlike("[A-Z]") & match.rlike("[0-9]")
    return F.lit(True)


def candidates(df: DataFrame) -> DataFrame:
    """Rows (row, kind, start, end): matches of each pattern, leftmost and not overlapping; places in code points, the end exclusive.

    ``row`` is the doc_id with a hash of the text: it stays the same when a lost executor's work is done again, and rows repeated as a whole have one.
    """
    text = F.col("text")

    def matches(kind: str) -> Column:
        pattern = PATTERNS[kind]
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        gaps = F.split(text, pattern, -1)
        rows = let(F.struct(found.alias("m"), gaps.alias("g")), lambda x: F.transform(x["m"], lambda m, i: F.struct(F.lit(KINDS.index(kind)).alias("kind"), i.alias("i"), F.length(F.get(x["g"], i)).alias("gap"), F.length(m).alias("len"), passing(kind, m).alias("ok"))))
        return F.when(text.rlike(pattern), rows).otherwise(F.array().cast("array<struct<kind:int,i:int,gap:int,len:int,ok:boolean>>"))

    rows = only(df, "doc_id", "text").filter("text IS NOT NULL").withColumn("row", F.struct("doc_id", F.xxhash64("text").alias("hash")))
    rows = rows.select("row", F.explode(F.concat(*map(matches, KINDS))).alias("m")).select("row", "m.*").distinct()
    upto = Window.partitionBy("row", "kind").orderBy("i")
    start = F.sum("gap").over(upto.rowsBetween(Window.unboundedPreceding, 0)) + F.coalesce(F.sum("len").over(upto.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("start", start).filter("ok").select("row", "kind", "start", (F.col("start") + F.col("len")).alias("end"))


def linked(found: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The strong candidates, and the weak ones with their complement at most ``scope`` characters away."""
    part = F.when(F.col("kind").isin([KINDS.index(k) for k in IDENTIFIERS]), "identifier").when(F.col("kind").isin([KINDS.index(k) for k in SECRETS]), "secret").otherwise("endpoint")
    parts = found.withColumn("part", part)
    # bins as long as the scope: few candidates fit into one, so the join within it stays small
    seat = lambda x: (x / scope).cast("long")
    weak = parts.filter(F.col("kind") >= 3).withColumn("bin", F.explode(F.sequence(seat(F.col("start")) - 1, seat(F.col("end")) + 1)))
    other = parts.filter("part != 'endpoint'").select("row", F.col("part").alias("o_part"), F.col("start").alias("o_start"), F.col("end").alias("o_end"), F.explode(F.sequence(seat(F.col("start")), seat(F.col("end")))).alias("bin"))
    met = weak.join(other, ["row", "bin"]).filter((F.col("part") != F.col("o_part")) & (F.col("o_start") <= F.col("end") + scope) & (F.col("start") <= F.col("o_end") + scope))
    keys = ("row", "kind", "start", "end")
    sides = met.groupBy(*keys).agg(F.countDistinct("o_part").alias("sides"))
    weak_ok = sides.filter((F.col("sides") == 2) | (F.col("kind") != KINDS.index("endpoint"))).select(*keys)
    return found.filter(F.col("kind") < 3).select(*keys).unionByName(weak_ok)


def scan(df: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Rows (doc_id, spans), one for each row of ``df`` (doc_id, text): ``spans`` are structs (start, kind, end), kind by its place in KINDS, in that order.

    Null and empty texts have none. Spans overlap where kinds do. Rows repeated with one doc_id, the null one too, get the spans of all of them, each once. Other columns aren't
    read. An empty table gives no rows.
    """
    spans = linked(cut(candidates(df)), scope).select(F.col("row.doc_id").alias("id"), F.struct("start", "kind", "end").alias("span")).distinct()
    listed = spans.groupBy("id").agg(F.sort_array(F.collect_list("span")).alias("spans"))
    empty = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    ids = only(df, "doc_id")
    return ids.join(listed.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("id")), "left").select("doc_id", F.coalesce("spans", empty).alias("spans"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*map(F.lit, KINDS))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    base = F.sha2(joined(F.filter("spans", lambda s: s["kind"] < 3)), 256)
    return scan(documents(spark, sf_dir)).select("doc_id", *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])], base.alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle() -> str:
    each = " UNION ALL ".join(f"SELECT doc_id, {i} AS kind, regexp_extract_all(t, {quoted(p)}) AS m, string_split_regex(t, {quoted(p)}) AS g FROM d" for i, p in enumerate(PATTERNS.values()))
    part = "CASE WHEN kind IN (1, 3) THEN 'i' WHEN kind IN (0, 2, 4) THEN 's' ELSE 'e' END"
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({each}),
 u AS (SELECT doc_id, kind, unnest(m) AS m, unnest(g[:len(m)]) AS g, unnest(range(len(m))) AS i FROM f),
 p AS (SELECT *, (sum(length(g)) OVER (w ROWS UNBOUNDED PRECEDING) + coalesce(sum(length(m)) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS s FROM u WINDOW w AS (PARTITION BY doc_id, kind ORDER BY i)),
 c AS (SELECT doc_id, kind, s, s + length(m) AS e, {part} AS part FROM p
  WHERE CASE kind WHEN 0 THEN length(regexp_extract(m, {quoted(ASSIGN)}, 1)) >= 12 WHEN 4 THEN regexp_matches(m, '[a-z]') AND regexp_matches(m, '[A-Z]') AND regexp_matches(m, '[0-9]') ELSE true END),
 k AS (SELECT a.doc_id, a.kind, a.s, a.e FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.kind > 2 AND b.part <> 'e' AND a.part <> b.part AND b.s <= a.e + {SCOPE} AND a.s <= b.e + {SCOPE}
  GROUP BY ALL HAVING a.kind < 5 OR count(DISTINCT b.part) = 2),
 l AS (SELECT doc_id, kind, s, e, ['assign','access','hex','ident','mixed','endpoint'][kind + 1] || ':' || s || ':' || e AS x FROM (SELECT doc_id, kind, s, e FROM c WHERE kind < 3 UNION ALL SELECT * FROM k)),
 o AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS a, count(*) FILTER (WHERE kind = 1) AS b, count(*) FILTER (WHERE kind = 2) AS h, string_agg(x, ',' ORDER BY s, kind) FILTER (WHERE kind < 3) AS base, string_agg(x, ',' ORDER BY s, kind) AS spans FROM l GROUP BY doc_id)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(b, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN o USING (doc_id)
"""


ORACLE = oracle()
