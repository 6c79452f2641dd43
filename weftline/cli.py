"""Command line: python -m weftline.cli COMMAND ... [--root DIR] [--json]."""

from __future__ import annotations

import argparse
import json
import os
import sys

from pyspark.sql import SparkSession

from . import api, session


def parser() -> argparse.ArgumentParser:
    both = argparse.ArgumentParser(add_help=False)
    both.add_argument("--root", "-r", "--workspace", "-w", default=argparse.SUPPRESS)
    both.add_argument("--json", action="store_true", default=argparse.SUPPRESS)
    p = argparse.ArgumentParser(prog="weftline", parents=[both])
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str) -> argparse.ArgumentParser:
        return sub.add_parser(name, parents=[both])

    c = command("index")
    c.add_argument("--force", action="store_true")
    c.add_argument("--include", action="append", default=[])
    c.add_argument("--exclude", action="append", default=[])
    c.add_argument("--no-default-excludes", action="store_true")
    c.add_argument("--include-hidden", action="store_true")
    c.add_argument("--include-large", action="store_true")
    c.add_argument("--max-file-size", type=int, default=2 << 20)
    command("index-all").add_argument("workspaces", nargs="+")
    c = command("query")
    c.add_argument("query")
    c.add_argument("-k", "--top-k", type=int, default=10)
    c.add_argument("--filters", action="append", default=[])
    c = command("symbol")
    c.add_argument("name")
    c.add_argument("--scoped", action="store_true")
    c.add_argument("-n", "--limit", type=int, default=10)
    c = command("calls")
    c.add_argument("symbol")
    c.add_argument("-d", "--direction", default="callers")
    command("analyze").add_argument("analysis")
    c = command("export")
    c.add_argument("--max-files", type=int, default=20)
    c.add_argument("--max-symbols", type=int, default=40)
    c = command("search")
    c.add_argument("query")
    c.add_argument("-n", "--limit", type=int, default=10)
    return p


def run(spark: SparkSession, a: argparse.Namespace) -> dict:
    w = api.Workspace(spark, os.path.abspath(getattr(a, "root", ".")) if "://" not in getattr(a, "root", ".") else a.root)
    match a.command:
        case "index":
            return w.index(a.force, include=a.include, exclude=a.exclude, hidden=a.include_hidden, max_bytes=None if a.include_large else a.max_file_size, defaults=not a.no_default_excludes)
        case "index-all":
            return api.index_all(spark, [os.path.abspath(x) for x in a.workspaces])
        case "query":
            return w.query(a.query, a.top_k, a.filters)
        case "symbol":
            return w.symbol(a.name, a.scoped, a.limit)
        case "calls":
            return w.calls(a.symbol, a.direction)
        case "analyze":
            return w.analyze(a.analysis)
        case "export":
            return w.export(a.max_files, a.max_symbols)
        case "search":
            return w.search(a.query, a.limit)
    raise ValueError(f"unknown command {a.command}")


def printed(r: dict) -> str:
    """A result for people."""
    if r["type"] == "index":
        return f"{r['files']} files, {r['symbols']} symbols; {r['parsed']} parsed, {r['skipped']} unchanged, {r['removed']} removed"
    if r["type"] == "indexall":
        return "\n".join(f"{x['root']}: {printed(x)}" for x in r["results"])
    if r["type"] in ("query", "search"):
        return "\n".join(f"{x['score']:8.4f}  {x['symbol']}  {x['file']}:{x.get('line', x.get('start_line'))}" for x in r["results"]) or "nothing found"
    if r["type"] == "symbols":
        return "\n".join(f"{x['kind']} {x['scoped_name']}  {x['file']}:{x['line']}" for x in r["results"]) or "nothing found"
    if r["type"] == "calls":
        return "\n".join(f"{x['caller']} -> {x['callee']}  {x['file']}:{x['line']}" for x in r["results"]) or "nothing found"
    if r["type"] == "deadcode":
        return "\n".join([f"{r['dead_count']} dead symbols", *(f"  {x['kind']} {x['scoped_name']}  {x['file']}:{x['line']}" for x in r["symbols"])])
    return r["export"] if r["type"] == "export" else json.dumps(r, indent=2, default=str)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    as_json = getattr(a, "json", False)
    try:
        r = run(spark or session.build(master=os.environ.get("SPARK_MASTER")), a)
    except Exception as e:  # every failure has its envelope
        print(json.dumps(api.envelope(e), indent=2) if as_json else f"Error: {e}", file=sys.stderr)
        return 1
    print(json.dumps({"ok": True, **r}, indent=2, default=str) if as_json else printed(r))
    return 0


if __name__ == "__main__":
    sys.exit(main())
