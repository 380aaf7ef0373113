"""Command line: python -m lexweave ROOT create|list|delete|add|build|query|hits|check|evaluate ..."""

from __future__ import annotations

import argparse
import json
from dataclasses import asdict

from pyspark.sql import SparkSession

from lexweave.operators.dense import HashingEmbedder
from lexweave.operators.tables import snapshot
from lexweave.plans.engine import Engine, Settings
from lexweave.sources.scans import load_questions, text_pages
from lexweave.sources.sinks import write_report


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="lexweave")
    p.add_argument("root")
    p.add_argument("--settings", help="JSON file")
    commands = p.add_subparsers(dest="command", required=True)
    for name, arguments in {"create": ["corpus", "title"], "list": [], "delete": ["corpus"], "add": ["corpus", "directory"], "build": ["corpus"], "query": ["corpus", "question"], "hits": ["corpus", "question"], "check": ["corpus"], "evaluate": ["corpus", "questions"]}.items():
        own = commands.add_parser(name)
        for a in arguments:
            own.add_argument(a)
        if name == "add":
            own.add_argument("--glob", default="*.txt", help="text files with form feeds between pages")
        if name == "evaluate":
            own.add_argument("--report", help="folder for the summary as JSON")
        if name in ("query", "hits"):
            own.add_argument("--mode", default="hybrid", choices=["bm25", "dense", "hybrid"])
            own.add_argument("--top-k", type=int)
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("lexweave").getOrCreate()
    settings = Settings.load(json.load(open(args.settings, encoding="utf-8"))) if args.settings else None  # noqa: SIM115
    engine = Engine(spark, args.root, settings, HashingEmbedder())
    if args.command == "create":
        print(engine.create_corpus(args.corpus, args.title))
    elif args.command == "list":
        print(*(json.dumps(asdict(c)) for c in engine.list_corpora()), sep="\n")
    elif args.command == "delete":
        engine.delete_corpus(args.corpus)
    elif args.command == "add":
        engine.add_directory(args.corpus, args.directory, text_pages, glob=args.glob).show(truncate=False)
    elif args.command == "build":
        print(engine.build_corpus(args.corpus))
    elif args.command == "query":
        print(engine.query(args.corpus, args.question, mode=args.mode, top_k=args.top_k)["rendered"])
    elif args.command == "hits":
        asked = spark.createDataFrame([(1, args.question)], "query_id int, query string")
        for r in engine.describe_hits(args.corpus, engine.retrieve(args.corpus, asked, args.mode, args.top_k)).orderBy("rank").collect():
            print(f"{r['rank']:3} {r['score']:.4f} {r['line']}")
    elif args.command == "check":
        engine.check_order(args.corpus)
        print("the index is in the order of its chunks")
    else:
        summary = snapshot(engine.evaluate(args.corpus, load_questions(spark, args.questions)), "summary")
        summary.show(truncate=False)
        if args.report:
            write_report(summary, args.report)


if __name__ == "__main__":
    main()
