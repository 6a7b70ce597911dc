"""The command line: every command prints one compact line."""

from __future__ import annotations

import argparse
import json
import sys

from .codes import Refusal


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="ledgersift")
    sub = top.add_subparsers(dest="command", required=True)

    def command(name: str, text: str) -> argparse.ArgumentParser:
        p = sub.add_parser(name, help=text)
        p.add_argument("--case", help="the case's folder; else FORENSIC_CASE_ROOT")
        return p

    p = command("create-case", "make the folders and empty evidence tables")
    p.add_argument("--key", action="append", default=[], metavar="SCHEMA.TABLE=COLUMN[,COLUMN]", help="a declared key")
    p = command("ingest", "a text file or workbook becomes a source table")
    p.add_argument("--source", required=True)
    p.add_argument("--table", required=True)
    p.add_argument("--sheet")
    p.add_argument("--delimiter", default=",")
    command("verify", "try out what is promised of the evidence store")
    p = command("run-test", "one method on one table")
    p.add_argument("method")
    p.add_argument("--table", required=True)
    p.add_argument("--schema", default="source")
    for name in ("column", "identifier", "value", "entity-name", "threshold", "right-table", "right-schema", "right-column", "amount", "right-amount", "tolerance", "confirmed-by"):
        p.add_argument(f"--{name}")
    for name in ("allow-unsuitable", "reveal-values", "allow-large-profile"):
        p.add_argument(f"--{name}", action="store_true")
    p = command("run-suite", "all methods that fit a table")
    p.add_argument("--table", required=True)
    p.add_argument("--schema", default="source")
    p.add_argument("--amount", action="append")
    for name in ("identifier", "entity-name", "confirmed-by"):
        p.add_argument(f"--{name}")
    p.add_argument("--timeout-seconds", type=int, default=300)
    p.add_argument("--allow-large-profile", action="store_true")
    p = sub.add_parser("describe-method", help="a method's limitations; reads no data")
    p.add_argument("method", metavar="NAME[@VERSION]")
    return top


def execute(args: dict, spark=None) -> dict:
    """What a command replies. A refusal is a reply too."""
    from . import registry, runner, sources, suite
    from .contract import present

    name = args.pop("command")
    try:
        if name == "describe-method":
            return registry.describe(args["method"])
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.appName("ledgersift").getOrCreate()
            spark.sparkContext.setLogLevel("ERROR")
        root = args.pop("case")
        if name == "create-case":
            keys = dict(k.partition("=")[::2] for k in args["key"])
            case = sources.create_case(spark, root, {k: v.split(",") for k, v in keys.items()})
            return {"status": "completed", "case": case.root, "keys": len(keys)}
        case = sources.Case(spark, root)
        if name == "ingest":
            return {"status": "completed", **sources.ingest(case, args["source"], args["table"], args["delimiter"], args["sheet"])}
        if name == "verify":
            return {"status": "completed", **sources.verify_store(case)}
        given = {k: v for k, v in args.items() if v not in (None, False)}
        if name == "run-test":
            return json.loads(present(runner.run_test(case, given.pop("method"), given.pop("table"), **given)))
        return suite.run_suite(case, given.pop("table"), **given)
    except Refusal as e:
        return {"status": "refused", "code": str(e.code), "why": e.why}


def main(argv: list[str] | None = None) -> int:
    reply = execute(vars(parser().parse_args(argv)))
    print(json.dumps(reply, ensure_ascii=False, separators=(",", ":")))
    return 0 if reply.get("status") not in ("refused", "error") else 1


if __name__ == "__main__":
    sys.exit(main())
