"""Small corpora and graphs with results worked out by hand."""

from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quern.__main__ import main
from quern.functions.tokens import PATTERNS, basename, edit_distance, tokens
from quern.operators import graph, index, prefix, search, spell
from quern.plans.query import Query, QueryType, matches
from quern.sources import files, tables
from quern.streaming.indexing import index_stream, read_segments

TEXTS = ["the quick brown fox jumps over the lazy dog ", "the quick red fox ", "a brown dog and a quick fox ", "lazy dogs sleep "]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, f"a/doc{i}", t) for i, t in enumerate(TEXTS)], "doc_id long, doc_name string, text string").cache()


@pytest.fixture(scope="module")
def engine(docs):
    return search.SearchEngine.over(docs)


def ids(df):
    return sorted(r[0] for r in df.collect())


@pytest.mark.parametrize(("text", "want"), [("quick fox", [0, 1, 2]), ("brown dog", [0, 2]), ("quick unicorn", []), ("do*", [0, 2, 3]), ("*ck", [0, 1, 2]), ("b*n", [0, 2])])
def test_intersection(engine, text, want):
    assert ids(engine.search(text)) == want


@pytest.mark.parametrize(("text", "want"), [("brown dog", [(2, 2)]), ("quick brown fox", [(0, 3)]), ("quick b*n", [(0, 2)])])
def test_phrase(engine, text, want):
    assert [tuple(r) for r in engine.search(text, QueryType.PHRASE).collect()] == want


def test_ranked(engine):
    best = search.top(engine.search("quick dog", QueryType.RANKED)).collect()
    assert [(r.doc_id, round(r.score, 6)) for r in best] == [(2, 0.140118), (0, 0.108981), (1, 0.071921)]
    assert [r.doc_id for r in search.top(engine.search("quick dog", QueryType.RANKED), 1, skip=1).collect()] == [0]
    assert engine.needs_spellcheck("unicorn quick") and not engine.needs_spellcheck("quick unicorn")


@pytest.mark.parametrize(("strict", "dog"), [(True, 0.1333), (False, 0.1)])
def test_feedback(engine, strict, dog):
    weights = {r.term: round(r.weight, 4) for r in search.feedback_weights(engine.index.occurrences(), Query.parse("quick dog"), [1], strict=strict).collect()}
    assert weights == {"quick": 0.9, "dog": dog, "the": 0.8, "red": 0.8, "fox": 0.8}


def test_wildcards_overlap(spark):
    words = spark.createDataFrame([("aba",), ("abba",), ("ab",)], "term string")
    assert sorted(r.term for r in words.filter(matches("ab*ba", F.col("term"))).collect()) == ["aba", "abba"]
    with pytest.raises(ValueError, match="more than one"):
        matches("*a*", F.col("term"))


def test_spelling(engine):
    terms = engine.index.terms
    found = {r.term: (round(r.jaccard, 4), r.distance, round(r.score, 4)) for w in ("quik", "lasy", "dox") for r in spell.candidates(terms, w).collect()}
    assert found == {"quick": (0.5714, 1, 5.25), "lazy": (0.4286, 2, 2.3333)}
    assert [r.suggestion for r in spell.check(engine.index, "quik fox").collect()] == ["quick fox"]


@pytest.mark.parametrize(("a", "b", "want"), [("kitten", "sitting", 5), ("abc", "abd", 2), ("abc", "abcd", 1), ("same", "same", 0), ("", "ab", 2), ("ab", "", 2)])
def test_edit_distance(spark, a, b, want):
    assert spark.createDataFrame([(a, b)], "a string, b string").select(edit_distance(F.col("a"), F.col("b"))).first()[0] == want


GOLDEN = {
    "http://www.kth.se/a?b=1": ["http://www.kth.se/a?b=1"], "e.g.": ["e.g."], "info@kth.se": ["info@kth.se"], "3.14": ["3.14"], "1,000,000": ["1,000,000"], "$50": ["$50"], "don't": ["don't"],
    "rock'n'roll": ["rock", "n", "roll"], "12:30:45": ["12:30:45"], "foo-bar-baz": ["foo-bar", "baz"], "abc123def": ["abc123", "def"], "x1y2": ["x1", "y2"], "README.txt": ["readme.txt"],
    "24/7": ["24/7"], "555-123-4567": ["555-123-4567"], "192.168.0.1": ["192.168.0.1"], "+46": ["+46"], "(hello), world!": ["hello", "world"],
}


def test_pattern_tokens(spark):
    rows = spark.createDataFrame(list(enumerate(GOLDEN)), "i int, text string").select("i", tokens(F.col("text"), patterns=PATTERNS).alias("t")).orderBy("i").collect()
    assert [r.t for r in rows] == list(GOLDEN.values())


def test_token_flags(spark):
    one = lambda text, **flags: spark.createDataFrame([(text,)], "t string").select(tokens(F.col("t"), **flags)).first()[0]
    assert one("no trailing", strict=True) == ["no"]
    assert one("no trailing") == ["no", "trailing"]
    assert one("Ab, C.", case_folding=False, remove_punctuation=False) == ["Ab", ",", "C", "."]
    assert one("Éà ñ", remove_diacritics=True) == ["ea", "n"]
    assert one("Æßþ Łœ", remove_diacritics=True, case_folding=False) == ["ESt", "Lo"]
    assert one(None) == [] and one("") == []
    assert spark.createDataFrame([("a\\b/c.txt/",)], "p string").select(basename(F.col("p"))).first()[0] == "c.txt"


@pytest.fixture(scope="module")
def toy(spark):
    edges, nodes = files.parse_links(spark.createDataFrame([("0;1,2",), ("1;2",), ("2;0",), ("3;2",), ("4;",)], "value string"))
    return edges.cache(), nodes.cache()


def test_links(spark, toy):
    edges, nodes = toy
    assert edges.count() == 5 and sorted(r[0] for r in nodes.collect()) == list("01234")
    assert {r.node_id: r.out for r in graph.out_degree(edges).collect()} == {"0": 2, "1": 1, "2": 1, "3": 1}
    assert [r[0] for r in graph.dangling(nodes, edges).collect()] == ["4"]
    twice, _ = files.parse_links(spark.createDataFrame([("0;0,1,1",)], "value string"))
    assert sorted(map(tuple, twice.collect())) == [("0", "0"), ("0", "1")]


def test_pagerank(toy):
    got = {r.node_id: round(r.score, 5) for r in graph.pagerank(*toy, "0").collect()}
    assert got == {"0": 0.35908, "1": 0.18875, "2": 0.37988, "3": 0.03614, "4": 0.03614}


def test_hits(spark, toy):
    got = {r.node_id: (round(r.hub, 5), round(r.authority, 5)) for r in graph.hits(*toy).collect()}
    assert got == {"0": (0.70712, 0.00068), "1": (0.49999, 0.38267), "2": (0.00089, 0.92388), "3": (0.49999, 0.0), "4": (0.0, 0.0)}
    edges, nodes = graph.base_set(toy[0], spark.createDataFrame([("3",)], "node_id string"), toy[1])
    assert [tuple(r) for r in edges.collect()] == [("3", "2")] and sorted(r[0] for r in nodes.collect()) == ["2", "3"]


@pytest.mark.parametrize("cyclic", [True, False])
@pytest.mark.parametrize("complete", [True, False])
def test_monte_carlo(toy, cyclic, complete):
    got = {r.node_id: r.score for r in graph.monte_carlo(*toy, cyclic=cyclic, complete=complete, walks=400).collect()}
    want = {r.node_id: r.score for r in graph.pagerank(*toy, "0").collect()}
    assert abs(sum(got.values()) - 1) < 1e-9 and all(abs(got[k] - want[k]) < 0.05 for k in want)


def test_index_roundtrip_merge_and_codec(spark, docs, tmp_path):
    whole = index.inverted_index(index.occurrences(docs))
    rows = lambda df: sorted((r.term, r.doc_id, r.tf, tuple(r.offsets)) for r in df.collect())
    assert rows(index.postings(docs)) == rows(whole)
    index.Index.over(docs).save(str(tmp_path / "i"))
    saved = search.SearchEngine.load(spark, str(tmp_path / "i"))
    assert rows(saved.index.postings) == rows(whole)
    for text, kind in (("b*n dog", QueryType.INTERSECTION), ("quick b*n", QueryType.PHRASE), ("quick dog", QueryType.RANKED), ("do*", QueryType.RANKED)):
        assert sorted(map(tuple, saved.search(text, kind).collect())) == sorted(map(tuple, search.SearchEngine.over(docs).search(text, kind).collect()))
    assert "PushedFilters: [In(term, [dog,quick])" in saved.search("quick dog", QueryType.RANKED)._jdf.queryExecution().toString()
    assert sorted(r.doc_len for r in files.decode_documents(files.encode_documents(saved.index.documents)).collect()) == [3, 4, 7, 9]
    parts = [index.inverted_index(index.occurrences(docs.filter(F.col("doc_id") % 2 == i))) for i in range(2)]
    assert rows(index.merge(*parts)) == rows(whole)
    assert rows(files.decode_postings(files.encode_postings(whole))) == rows(whole)
    assert files.encode_postings(whole, 2).count() > files.encode_postings(whole).count() and rows(files.decode_postings(files.encode_postings(whole, 2))) == rows(whole)
    odd = spark.createDataFrame([("a;b~c,d", 1, 1, [3])], "term string, doc_id long, tf int, offsets array<int>")
    assert rows(files.decode_postings(files.encode_postings(odd))) == rows(odd)


def test_stream(spark, docs, tmp_path):
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    index_stream(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert read_segments(spark, str(tmp_path / "out")).count() == index.inverted_index(index.occurrences(docs)).count()


def test_files(spark, tmp_path):
    (tmp_path / "d" / "e").mkdir(parents=True)
    (tmp_path / "d" / "x.txt").write_text(" one \n two")
    (tmp_path / "d" / "e" / "y.txt").write_text("three")
    found = files.read_directory(spark, str(tmp_path / "d"))
    assert found.count() == 2
    assert [r.line for r in files.fetch_document(found, "x.txt").orderBy("line_no").collect()] == ["one", "two"]
    assert [r.line for r in files.fetch_document(found, "z.txt").collect()] == ["No file found"]
    assert files.read_patterns("// no\n\n \\d+ \n") == ["\\d+"]
    scores = spark.createDataFrame([("a", 0.5), ("b", 0.25)], "node_id string, score double")
    files.write_lines(files.top_lines(scores, 1), str(tmp_path / "top"))
    assert [r.value for r in spark.read.text(str(tmp_path / "top")).collect()] == ["a: 0.50000"]
    assert files.parse_titles(spark.createDataFrame([("1;a;b",)], "value string")).first()["title"] == "a;b"
    truth = files.parse_truth(spark.createDataFrame([("a: 0.25",)], "value string"))
    assert graph.squared_error(scores, truth).first()[0] == 0.0625
    words = spark.createDataFrame([(2, 0, "c"), (1, 1, "b"), (1, 0, "a")], "doc_id long, offset int, token string")
    files.write_tokens(words, str(tmp_path / "tokens"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "tokens").glob("part-*"))) == "a\nb\nc\n"


@pytest.mark.parametrize("bits", [0, 1, 9, 12, 23])
def test_prefix_sums(spark, bits):
    rows = [(g, (i * 2654435761 + len(g)) % (1 << 60) if i % 5 else 7, i) for g in "ab" for i in range(1, 200)]
    table = spark.createDataFrame(rows, "g string, key long, v int")
    got = {(r.g, r.cell): r.start for r in prefix.starts(table, ["g"], "key", F.col("v"), bits).collect()}
    cells = {(g, k >> (60 - bits)) for g, k, _ in rows}
    assert got == {(g, c): sum(v for h, k, v in rows if h == g and k >> (60 - bits) < c) for g, c in cells}
    numbers = sorted((r.g, r.nr) for r in prefix.numbered(table, ["g"], "key", ["v"], 300 << bits).collect())
    assert numbers == [(g, n) for g in "ab" for n in range(199)]


def test_shared_folder(spark, monkeypatch):
    assert tables.shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    cluster = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="local-cluster[2,1,1024]"))
    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(cluster)


def test_kgrams(engine):
    grams = engine.index.grams
    assert sorted(r[0] for r in index.kgram_lookup(grams, ["^d", "do"]).collect()) == ["dog", "dogs"]
    with pytest.raises(ValueError, match="different lengths"):
        index.kgram_lookup(grams, ["a", "ab"])


def test_commands(spark, tmp_path, capsys):
    (tmp_path / "d").mkdir()
    for i, text in enumerate(TEXTS):
        (tmp_path / "d" / f"doc{i}").write_text(text)
    (tmp_path / "links").write_text("0;1,2\n1;2\n2;0\n3;2\n4;\n")
    at = str(tmp_path / "i")

    def said(*arguments):
        capsys.readouterr()
        main(list(arguments))
        return capsys.readouterr().out.splitlines()

    said("index", str(tmp_path / "d"), "-t", at, "-cf", "-rp")
    assert sorted(line.rsplit("/", 1)[1] for line in said("search", at, "quick fox")) == ["doc0", "doc1", "doc2"]
    assert [line.rsplit("/", 1)[1] for line in said("search", at, "quick dog", "-k", "ranked")] == ["doc2", "doc0", "doc1"]
    assert [line.rsplit("/", 1)[1] for line in said("search", at, "quick dog", "-k", "ranked", "-s", "1", "-m", "1")] == ["doc0"]
    assert said("kgrams", at, "^d do") == ["dog", "dogs"] and said("spell", at, "quik")[0].split("\t")[0] == "quick"
    assert said("pagerank", str(tmp_path / "links"), "-m", "1") == ["2: 0.37988"] and said("hits", str(tmp_path / "links"), "-m", "1") == ["0: 0.70712", "2: 0.92388"]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x").write_text("Ab, é")
    assert said("tokens", str(tmp_path / "t"), "-rd") == ["Ab", ",", "e"] and said("tokens", str(tmp_path / "t"), "-cf", "-rp") == ["ab", "é"]
