"""python -m tessera DIR search|validate|health|expand|export ...: the engine on the command line, results as JSON lines."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from .engine import Engine


def main(arguments: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tessera")
    parser.add_argument("tables")
    commands = parser.add_subparsers(dest="command", required=True)
    search = commands.add_parser("search")
    search.add_argument("text")
    search.add_argument("--kind", action="append", default=[])
    search.add_argument("--limit", type=int, default=5)
    commands.add_parser("expand").add_argument("id", nargs="+")
    commands.add_parser("export").add_argument("path")
    commands.add_parser("validate")
    commands.add_parser("health")
    asked = parser.parse_args(arguments)
    engine = Engine(SparkSession.builder.getOrCreate(), asked.tables)
    if asked.command == "export":
        engine.export(asked.path)
        return
    if asked.command == "search":
        rows = engine.search(asked.text, tuple(asked.kind), asked.limit)
    elif asked.command == "expand":
        rows = engine.expand(asked.id)
    else:
        rows = getattr(engine, asked.command)()
    for line in rows.toJSON().toLocalIterator():
        print(line)


if __name__ == "__main__":
    main()
