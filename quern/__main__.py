"""Commands: ``python -m quern tokens|index|search|kgrams|spell|pagerank|hits ...``; each says what it takes with -h."""

from __future__ import annotations

import argparse
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.tokens import tokens
from quern.operators import graph, index, search, spell
from quern.plans.query import QueryType, RankingType
from quern.sources import files


def flags(args: argparse.Namespace) -> dict[str, object]:
    patterns = files.read_patterns(Path(args.patterns).read_text()) if args.patterns else None
    return {"case_folding": args.case_folding, "remove_diacritics": args.remove_diacritics, "remove_punctuation": args.remove_punctuation, "patterns": patterns}


def shown(df: DataFrame, most: int) -> None:
    for row in df.limit(most).collect():
        print(*row, sep="\t")


def linked(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, str | None]:
    lines = spark.read.text(path)
    first = lines.first()
    return *files.parse_links(lines), first and first[0].split(";")[0].strip()


def run(spark: SparkSession, args: argparse.Namespace) -> None:
    if args.command == "tokens":
        docs = files.read_directory(spark, args.path)
        listed = docs.select("doc_id", F.posexplode(tokens(F.col("text"), **flags(args))).alias("offset", "token"))
        files.write_tokens(listed, args.to) if args.to else shown(listed.orderBy("doc_id", "offset").select("token"), args.most)
    elif args.command == "index":
        index.Index.over(files.read_directory(spark, args.path), **flags(args)).save(args.to)
    elif args.command == "search":
        engine = search.SearchEngine.load(spark, args.path)
        found = engine.search(args.query, QueryType(args.kind), RankingType(args.ranking))
        found = search.top(found, args.most, args.skip) if "score" in found.columns else found.orderBy("doc_id").offset(args.skip)
        shown(found.join(engine.index.documents.select("doc_id", "doc_name"), "doc_id").orderBy(*([F.desc("score")] if "score" in found.columns else []), "doc_id"), args.most)
    elif args.command == "kgrams":
        shown(index.kgram_lookup(index.Index.load(spark, args.path).grams, args.query.split()).orderBy("term"), args.most)
    elif args.command == "spell":
        shown(spell.displayed(spell.check(index.Index.load(spark, args.path), args.query, args.most)).select("shown", "score"), args.most)
    else:
        edges, nodes, first = linked(spark, args.path)
        if args.command == "pagerank":
            shown(files.top_lines(graph.pagerank(edges, nodes, first), args.most).orderBy("place").select("value"), args.most)
        else:
            both = graph.hits(edges, nodes)
            for kind in ("hub", "authority"):
                shown(files.top_lines(both.select("node_id", F.col(kind).alias("score")), args.most, "%s: %.5g").orderBy("place").select("value"), args.most)


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="quern", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    for name, most in (("tokens", 1_000_000), ("index", 0), ("search", 10), ("kgrams", 10), ("spell", 10), ("pagerank", 30), ("hits", 30)):
        command = commands.add_parser(name)
        command.add_argument("path", help="folder of documents, of a saved index, or file of links")
        command.add_argument("-m", "--most", type=int, default=most, help="rows shown")
        if name in ("tokens", "index"):
            command.add_argument("-t", "--to", required=name == "index", help="folder to write")
            command.add_argument("-p", "--patterns", help="file of patterns")
            for short, flag in (("-cf", "--case-folding"), ("-rd", "--remove-diacritics"), ("-rp", "--remove-punctuation")):
                command.add_argument(short, flag, action="store_true")
        if name in ("search", "kgrams", "spell"):
            command.add_argument("query")
        if name == "search":
            command.add_argument("-k", "--kind", choices=[k.value for k in QueryType], default=QueryType.INTERSECTION.value)
            command.add_argument("-r", "--ranking", choices=[RankingType.TF_IDF.value], default=RankingType.TF_IDF.value)
            command.add_argument("-s", "--skip", type=int, default=0)
    return out


def main(arguments: list[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    spark = SparkSession.builder.appName("quern").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    run(spark, args)


if __name__ == "__main__":
    main()
