"""python -m quillgraph.cli graphs | build | refresh | search | stats | serve"""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession

from .catalog import UnknownGraphError
from .server import serve
from .tools import Tools, searched

PREVIEW_CHARS = 200


def shown(hit) -> str:  # noqa: ANN001
    rank = lambda x: "-" if x is None else str(x)
    lines = [f"{hit['rank']}. {hit['score']:.4f} [vector {rank(hit['vector_rank'])}, keyword {rank(hit['keyword_rank'])}] {hit['uid']} {hit['breadcrumb']}"]
    return "\n".join(lines if hit["is_page"] else [*lines, "   " + hit["text"][:PREVIEW_CHARS]])


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillgraph", description=__doc__)
    parser.add_argument("command", choices=["graphs", "build", "refresh", "search", "stats", "serve"])
    parser.add_argument("words", nargs="?", default="")
    parser.add_argument("-g", "--graph", default="graph")
    parser.add_argument("-k", type=int, default=10)
    parser.add_argument("--registry", default="")
    parser.add_argument("--stores", default="stores")
    parser.add_argument("--port-file", default="")
    parser.add_argument("--port", type=int)
    parser.add_argument("--token")
    parser.add_argument("--entities", default="", help="JSON lines of the graph, instead of its API")
    parser.add_argument("--captures", default="", help="folder that keeps captured entities, so that a refresh pulls only what has changed")
    parser.add_argument("--lenient", action="store_true")
    parser.add_argument("--no-daily-notes", action="store_true")
    parser.add_argument("--model", default="")
    parser.add_argument("--dimension", type=int, default=64)
    parser.add_argument("--url", help="the embedding server")
    args = parser.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(name)s: %(message)s", stream=sys.stderr)
    spark = spark or SparkSession.builder.appName("quillgraph").getOrCreate()
    given = {c: getattr(args, c) for c in ("registry", "stores", "port_file", "port", "token", "entities", "captures", "lenient", "model", "dimension")}
    tools = Tools(spark, **given, **({"url": args.url} if args.url else {}))
    try:
        if args.command == "graphs":
            for g in tools.list_indexes():
                print(g["label"], g["name"], g["type"], f"{g['record_count']} records" if g["indexed"] else "not indexed", g["store"])
        elif args.command == "build":
            print(f"{tools.build(args.graph, not args.no_daily_notes).record_count} records")
        elif args.command == "refresh":
            print(tools.refresh_index(args.graph))
        elif args.command == "search":
            store = tools._indexed(args.graph)[1]
            print("\n".join(map(shown, searched(spark, store, args.words, args.k, tools.embedder(store.meta(spark))))))
        elif args.command == "stats":
            print(tools.index_stats(args.graph))
        else:
            serve(tools)
    except (UnknownGraphError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
