"""Command line: build, inspect, search and roll back an index; run a named query."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lamplight.functions import text as X
from lamplight.plans.index import CorpusIndex


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lamplight", description=__doc__)
    sub = p.add_subparsers(dest="command", required=True)
    for name, text in (("build", "index documents"), ("status", "show an index"), ("search", "search an index"), ("rollback", "put an older release in force")):
        s = sub.add_parser(name, help=text)
        s.add_argument("index")
        if name == "build":
            s.add_argument("documents", help="Parquet with document id and text")
            s.add_argument("--id", default="doc_id")
            s.add_argument("--title", default=None)
        if name == "search":
            s.add_argument("query", nargs="+")
            s.add_argument("--limit", type=int, default=5)
        if name == "status":
            s.add_argument("--verify", action="store_true", help="compare the tables with the manifest")
        if name == "rollback":
            s.add_argument("release", type=int)
    q = sub.add_parser("query", help="run a named query over a folder of tables")
    q.add_argument("name")
    q.add_argument("folder")
    q.add_argument("--rows", type=int, default=20)
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("lamplight").getOrCreate()
    if a.command == "query":
        from lamplight.plans import audit_queries, conversation_queries, corpus_queries, policy_queries, registry, text_queries  # noqa: F401

        registry.QUERIES[a.name](spark, a.folder).show(a.rows, truncate=80)
        return
    index = CorpusIndex(spark, a.index, X.KOREAN)
    if a.command == "build":
        docs = spark.read.parquet(a.documents)
        title = F.col(a.title) if a.title else F.lit("")
        print(json.dumps(index.build(docs.select(F.col(a.id).alias("document_id"), title.alias("title"), "text"))))
    elif a.command == "status":
        print(json.dumps(index.status(a.verify)))
    elif a.command == "search":
        asked = spark.createDataFrame(list(enumerate(a.query)), "query_id long, text string")
        for r in index.search(asked, limit=a.limit).orderBy("query_id", "rank").toLocalIterator():
            print(json.dumps(r.asDict(), ensure_ascii=False))
    else:
        index.rollback(a.release)


if __name__ == "__main__":
    main()
