"""The command line: python -m quillsearch search|suggest|compare|serve [--catalogue FILE] [--log FILE] [WORD ...]"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from . import lexicons as L
from .operators.baseline import compare
from .service import Service, served
from .sources.catalogue import find_export, read_query_log

# The queries that both engines are compared on.
COMPARED = [
    "funny", "funny birthday", "flash card", "animated birthday", "birthdya", "aniversary", "congradulations", "funny birthday card for wife",
    "happy birthday card for my beautiful mom", "musical christmas card", "sorry card for friend", "thank you teacher",
]


def told(answer: dict) -> str:
    """A search's answer in lines."""
    rows = [f"{c['title']}  [{c['category']}]  {c['year']}  {c['why']}" for c in answer["new"]["results"]]
    return "\n".join([*([answer["new"]["message"]] if answer["new"]["message"] else []), *rows, f"{len(rows)} results via {answer['new']['strategy']}" if rows else "no results"])


def answers(service: Service, lines: Iterable[str]) -> Iterator[str]:
    """What each line asks for, told; blank lines ask for nothing."""
    return (told(service.search(raw)) for raw in map(str.strip, lines) if raw)


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quillsearch")
    parser.add_argument("command", choices=["search", "suggest", "compare", "serve"])
    parser.add_argument("words", nargs="*", help="the query; without one, search reads a query from each line of its input")
    parser.add_argument("--catalogue", help="the catalogue file; by default the one in ./data")
    parser.add_argument("--log", help="a query log (query, times) for suggestions")
    parser.add_argument("--host", default="127.0.0.1")
    parser.add_argument("--port", type=int, default=8000)
    args = parser.parse_args(argv)
    try:
        path = find_export(args.catalogue)
    except FileNotFoundError as missing:
        sys.exit(f"no catalogue: {missing}")
    spark = SparkSession.builder.appName("quillsearch").getOrCreate()
    service = Service.of_file(spark, path, read_query_log(spark, args.log) if args.log else None)
    raw = " ".join(args.words)
    if args.command == "search":
        for answer in answers(service, [raw] if raw else sys.stdin):
            print(answer, flush=True)
    elif args.command == "suggest":
        print("\n".join(service.suggest(raw)["suggestions"]))
    elif args.command == "compare":
        asked = spark.createDataFrame([(f"{i:02d}", q) for i, q in enumerate([raw] if raw else COMPARED)], "query_id string, raw string")
        for r in compare(service.index, asked, L.MAX_RESULTS).join(asked, "query_id").orderBy("query_id").collect():  # a stated, small set
            print(f"{r.raw}: {r.old_n} before, {r.new_n} now via {r.strategy}")
    else:
        with served(service, args.host, args.port) as server:
            print(f"http://{args.host}:{server.server_port}/", flush=True)
            server.serve_forever()


if __name__ == "__main__":
    main()
