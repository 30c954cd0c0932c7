"""The seven questions as tools of a server that reads and writes lines of JSON-RPC 2.0, as the Model Context Protocol has them.

A session holds one analysis. Each answer is a JSON text; errors are records with status, error_type, message and suggestion and never end
the server. A tool other than analyze_repo that is called first says that nothing has been analysed. A failed analysis leaves none behind."""

from __future__ import annotations

import json
import os
import sys
from threading import RLock

from pyspark.sql import SparkSession

from lodestone.api import METRICS, Engine
from lodestone.operators.diagrams import KINDS
from lodestone.operators.issues import ORDER
from lodestone.sources.repository import NotFound, TooLarge

PROTOCOL = "2024-11-05"
_TEXT, _WHOLE = {"type": "string"}, {"type": "integer"}
#: name: (what it does, arguments, those that must be given).
TOOLS = {
    "analyze_repo": ("Reads a repository into a code graph; call it first, and again when files have changed.", {"repo_path": _TEXT, "scope": _TEXT, "use_cache": {"type": "boolean"}}, ["repo_path"]),
    "search_graph": ("Finds functions, classes and modules by a part of their name or path.", {"query": _TEXT, "entity_type": {"type": "string", "enum": ["function", "class", "module"]}, "limit": _WHOLE}, ["query"]),
    "trace_flow": ("Follows calls and imports from an entity.", {"entity_name": _TEXT, "direction": {"type": "string", "enum": ["forward", "backward", "both"]}, "max_depth": _WHOLE}, ["entity_name"]),
    "find_issues": ("Lists structural issues, the gravest first.", {"issue_types": {"type": "array", "items": {"type": "string", "enum": list(ORDER)}}}, []),
    "get_metrics": ("Ranks modules, entities or files by a metric.", {"metric": {"type": "string", "enum": list(METRICS)}, "top_n": _WHOLE}, []),
    "visualize": ("Draws a Mermaid diagram.", {"diagram_type": {"type": "string", "enum": list(KINDS)}, "scope": _TEXT, "max_nodes": _WHOLE}, []),
    "get_git_context": ("Tells a file's history, owners and companions.", {"file_path": _TEXT, "entity_name": _TEXT}, ["file_path"]),
}


def problem(kind: str, message: str, suggestion: str = "") -> dict:
    return {"status": "error", "error_type": kind, "message": message, "suggestion": suggestion}


class Session:
    """The state of a server: the engine of the last analysis. Calls are taken one after the other."""

    def __init__(self, spark: SparkSession, cache: str | None = ".lodestone"):
        self.spark, self.cache, self.engine, self.lock = spark, cache, None, RLock()

    def call(self, name: str, arguments: dict | None = None):
        """The answer of a tool: a record, a list of records, or the text of a diagram."""
        with self.lock:
            if name not in TOOLS:
                return problem("invalid_input", f"there is no tool {name}", f"Tools: {', '.join(TOOLS)}.")
            given = {k: v for k, v in (arguments or {}).items() if v is not None}
            _, known, needed = TOOLS[name]
            if wrong := [k for k in given if k not in known] + [k for k in needed if k not in given]:
                return problem("invalid_input", f"{name} takes {', '.join(known)}; unknown or missing: {', '.join(wrong)}")
            if name != "analyze_repo" and self.engine is None:
                return problem("not_analyzed", "no repository has been analysed", "Call analyze_repo first.")
            if name == "analyze_repo":
                self.engine = None
            try:
                return getattr(self, f"_{name}")(**given)
            except TooLarge as e:
                return problem("too_large", str(e), "Choose a folder by scope.")
            except NotFound as e:
                return problem("not_found", str(e), "Look at the name or path.")
            except (ValueError, TypeError) as e:
                return problem("invalid_input", str(e))
            except Exception as e:  # a tool call must not end the server
                return problem("parse_error", f"{name} failed: {str(e).splitlines()[0] if str(e) else type(e).__name__}", "Analyse the repository again.")

    @staticmethod
    def _rows(df) -> list[dict]:
        return [r.asDict(recursive=True) for r in df.collect()]  # all are short lists

    def _analyze_repo(self, repo_path: str, scope: str | None = None, use_cache: bool = True) -> dict:
        cache = os.path.join(repo_path, self.cache) if use_cache and self.cache else None
        engine = Engine.analyze(self.spark, repo_path, scope, cache)
        out = {"status": "ok", "analysis_scope": engine.scope, "is_partial": engine.scope is not None, "reused": engine.reused, **engine.counts()}
        out |= {"detected_layers": engine.layers(), "health": engine.health(), "coverage": engine.coverage(), "warnings": engine.warnings()}
        self.engine = engine
        return out

    def _search_graph(self, query: str, entity_type: str | None = None, limit: int = 20) -> list[dict]:
        if entity_type not in (None, "function", "class", "module"):
            raise ValueError("entity_type is function, class or module")
        return self._rows(self.engine.search(query, entity_type, limit))

    def _trace_flow(self, entity_name: str, direction: str = "forward", max_depth: int = 5) -> dict:
        steps, more = self.engine.trace(entity_name, direction, max_depth)
        return {"start": entity_name, "direction": direction, "steps": self._rows(steps), "truncated": more}

    def _find_issues(self, issue_types: list[str] | None = None) -> list[dict]:
        if issue_types is not None and not any(t in ORDER for t in issue_types):
            raise ValueError(f"issue types are {', '.join(ORDER)}")
        return self._rows(self.engine.issues(issue_types))

    def _get_metrics(self, metric: str = "summary", top_n: int = 15) -> list[dict]:
        return self._rows(self.engine.metric(metric, top_n))

    def _visualize(self, diagram_type: str = "architecture", scope: str | None = None, max_nodes: int = 15) -> str:
        return self.engine.visualize(diagram_type, scope, max_nodes)

    def _get_git_context(self, file_path: str, entity_name: str | None = None) -> dict:
        return self.engine.context(file_path, entity=entity_name)


def handle(session: Session, message: dict) -> dict | None:
    """The reply to a message; None to a notification."""
    method, number = message.get("method"), message.get("id")
    reply = lambda **x: {"jsonrpc": "2.0", "id": number, **x}
    if number is None:
        return None
    if method == "initialize":
        return reply(result={"protocolVersion": (message.get("params") or {}).get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "lodestone", "version": "2"}})
    if method == "ping":
        return reply(result={})
    if method == "tools/list":
        return reply(result={"tools": [{"name": n, "description": d, "inputSchema": {"type": "object", "properties": a, "required": r}} for n, (d, a, r) in TOOLS.items()]})
    if method == "tools/call":
        params = message.get("params") or {}
        out = session.call(params.get("name", ""), params.get("arguments"))
        wrong = isinstance(out, dict) and out.get("status") == "error"
        return reply(result={"content": [{"type": "text", "text": out if isinstance(out, str) else json.dumps(out, indent=2, default=str)}], "isError": wrong})
    return reply(error={"code": -32601, "message": f"there is no method {method}"})


def serve(spark: SparkSession, lines=None, out=None) -> int:
    """Answer messages, one a line, until the input ends."""
    session, out = Session(spark), out or sys.stdout
    for line in lines or sys.stdin:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
        except ValueError:
            answer = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        else:
            answer = handle(session, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "not a request"}}
        if answer is not None:
            print(json.dumps(answer, default=str), file=out, flush=True)
    return 0
