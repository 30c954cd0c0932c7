"""Command line: python -m lodestone.cli --repo PATH analyze|search|trace|issues|metrics|viz|git-context|serve ... ; prints JSON, with --table
plain tables, and Mermaid for viz. `serve` answers tool calls on its input, see lodestone.server."""

from __future__ import annotations

import argparse
import json
import os
import sys

from lodestone.api import METRICS, Engine
from lodestone.operators.diagrams import KINDS
from lodestone.sources.repository import NotFound, TooLarge


def answer(engine: Engine, args: argparse.Namespace):
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]  # noqa: E731  (all are short lists)
    if args.command == "analyze":
        return {"status": "ok", "scope": engine.scope, **engine.counts(), "coverage": engine.coverage(), "health": engine.health(), "layers": engine.layers(), "warnings": engine.warnings()}
    if args.command == "search":
        return rows(engine.search(args.query, args.type, args.limit))
    if args.command == "trace":
        steps, more = engine.trace(args.name, args.direction, args.depth)
        return {"steps": rows(steps), "truncated": more}
    if args.command == "issues":
        return rows(engine.issues(args.types.split(",") if args.types else None))
    if args.command == "metrics":
        return rows(engine.metric(args.metric, args.top))
    if args.command == "viz":
        return engine.visualize(args.kind, args.scope_of, args.nodes)
    return engine.context(args.path, entity=args.entity)


def table(rows: list[dict], widest: int = 100) -> str:
    """Rows as a table of aligned columns; lists are joined, long cells cut."""

    def cell(x) -> str:
        x = ", ".join(map(str, x)) if isinstance(x, (list, tuple)) else "" if x is None else f"{x:.6g}" if isinstance(x, float) else str(x)
        x = " ".join(x.split())
        return x if len(x) <= widest else f"{x[: widest - 3]}..."

    if not rows:
        return "(none)"
    lines = [list(rows[0]), *([cell(r.get(c)) for c in rows[0]] for r in rows)]
    wide = [max(len(line[k]) for line in lines) for k in range(len(lines[0]))]
    lines.insert(1, ["-" * w for w in wide])
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(line, wide, strict=True)).rstrip() for line in lines)


def printed(out) -> str:
    """An answer as tables: lists of rows as they are, records by field."""
    if isinstance(out, list):
        return table(out)
    parts = []
    plain = [{"field": k, "value": v} for k, v in out.items() if not isinstance(v, (dict, list)) or v and isinstance(v, list) and not isinstance(v[0], dict)]
    for k, v in out.items():
        if isinstance(v, dict):
            parts.append(f"{k}\n{table([{'field': a, 'value': b} for a, b in v.items()])}")
        elif isinstance(v, list) and v and isinstance(v[0], dict):
            parts.append(f"{k}\n{table(v)}")
    return "\n\n".join([*([table(plain)] if plain else []), *parts])


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone", description=__doc__)
    p.add_argument("--table", action="store_true", help="plain tables instead of JSON")
    p.add_argument("--repo", default=".")
    p.add_argument("--scope")
    p.add_argument("--cache")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("analyze")
    s = sub.add_parser("search")
    s.add_argument("query")
    s.add_argument("--type", choices=("function", "class", "module"))
    s.add_argument("--limit", type=int, default=20)
    s = sub.add_parser("trace")
    s.add_argument("name")
    s.add_argument("--direction", choices=("forward", "backward", "both"), default="forward")
    s.add_argument("--depth", type=int, default=5)
    s = sub.add_parser("issues")
    s.add_argument("--types")
    s = sub.add_parser("metrics")
    s.add_argument("metric", nargs="?", choices=METRICS, default="summary")
    s.add_argument("--top", type=int, default=15)
    s = sub.add_parser("viz")
    s.add_argument("kind", nargs="?", choices=KINDS, default="architecture")
    s.add_argument("--of", dest="scope_of")
    s.add_argument("--nodes", type=int, default=15)
    s = sub.add_parser("git-context")
    s.add_argument("path")
    s.add_argument("--entity")
    sub.add_parser("serve")
    return p


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    if spark is None:
        from pyspark.sql import SparkSession

        spark = SparkSession.builder.config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "serve":
        from lodestone.server import serve

        return serve(spark)
    try:
        out = answer(Engine.analyze(spark, os.path.abspath(args.repo), args.scope, args.cache), args)
    except (NotFound, TooLarge, ValueError) as e:
        kind = {NotFound: "not_found", TooLarge: "too_large"}.get(type(e), "invalid_input")
        print(json.dumps({"status": "error", "error_type": kind, "message": str(e)}))
        return 1
    print(out if isinstance(out, str) else printed(out) if args.table else json.dumps(out, indent=2, default=str))
    return 0


if __name__ == "__main__":
    sys.exit(main())
