"""Declarations, imports and calls of Python source, by the standard library's syntax tree.

Names are lexical: the names of the enclosing functions and classes, joined by dots. A call belongs to the innermost function
around it (lambdas and classes inside do not cut); decorators belong to the scope around what they decorate, and calls outside
functions to none. Source that does not parse gives what a line rule finds, and is marked as recovered.

A syntax tree takes a hundred times its text, so long sources are parsed in parts, cut between top-level statements."""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator

_DEF = re.compile(r"^\s*(?:async\s+)?(def|class)\s+([A-Za-z_]\w*)")
_PATH = re.compile(r"[^\W\d]\w*(?:\.[^\W\d]\w*)*")
_Function = (ast.FunctionDef, ast.AsyncFunctionDef)
_LEAVES = frozenset((ast.Name, ast.Constant, ast.Load, ast.Store, ast.Del, ast.Pass, ast.Break, ast.Continue))
#: Characters of a part, and where one may begin: at words that begin a statement, at the start of a line.
PART = 1 << 18
_START = re.compile(r"^(?=(?:def|class|async|import|from)[ \t]|@)", re.MULTILINE)


def _signature(node, lines: list[str]) -> str:
    """From the start of a definition to where its body begins, blanks collapsed, without the colon."""
    first = node.body[0]
    start = min([first.lineno, *(d.lineno for d in getattr(first, "decorator_list", []))])
    if start == node.lineno:
        text = lines[node.lineno - 1].encode()[node.col_offset : first.col_offset].decode("utf-8", "replace")
    else:
        text = "\n".join([lines[node.lineno - 1].encode()[node.col_offset :].decode("utf-8", "replace"), *lines[node.lineno : start - 1]])
        text = re.sub(r"(?m)\s+#.*$|^\s*@.*$", "", text) if "#" in text else text
    return re.sub(r"\s+", " ", text).strip().rstrip(":").strip()


def _last_name(node) -> str | None:
    """The last identifier of an expression by place."""
    if isinstance(node, ast.Name):
        return node.id
    best = None
    for x in ast.walk(node):
        if isinstance(x, ast.Name):
            at = (x.lineno, x.col_offset, x.id)
        elif isinstance(x, ast.Attribute):
            at = (x.end_lineno, x.end_col_offset - len(x.attr.encode()), x.attr)
        elif isinstance(x, ast.keyword) and x.arg or isinstance(x, ast.arg):
            at = (x.lineno, x.col_offset, x.arg)
        else:
            continue
        best = max(best, at) if best else at
    return best and best[2]


def _dotted(node) -> str | None:
    parts = []
    while isinstance(node, ast.Attribute):
        parts.append(node.attr)
        node = node.value
    return ".".join([node.id, *reversed(parts)]) if isinstance(node, ast.Name) else None


class Broken(ValueError):
    """A source that does not parse."""


def parse(path: str, source: str) -> dict:
    """entities, imports and calls as dicts, and whether the source had errors."""
    out = {"entities": [], "imports": [], "calls": [], "recovered": False}
    try:
        found = list(parts(path, source))
    except Broken:
        return out | recovered(path, source)
    classes = [e for x in found for e in x["entities"] if e["type"] == "class"]
    functions = [e for x in found for e in x["entities"] if e["type"] != "class"]
    return out | {"entities": classes + functions} | {k: [y for x in found for y in x[k]] for k in ("imports", "calls")}


def _trees(source: str, size: int) -> Iterator[tuple[str, ast.Module]]:
    """The source in parts of about `size` characters, and their trees. What a cut divides is no statement of its own and does not parse
    (an open string, bracket or line, a decorator), so a part that does not is made longer, at last up to the end; raises Broken if it does not parse then."""
    at = 0
    while at < len(source) or not at:
        reach = size
        while True:
            cut = _START.search(source, at + reach) if at + reach < len(source) else None
            text = source[at : cut.start() if cut else len(source)]
            try:
                tree = ast.parse(text)
                break
            except (SyntaxError, ValueError, RecursionError) as e:
                if not cut:
                    raise Broken(str(e)) from e
                reach = 2 * len(text)
        yield text, tree
        at += max(1, len(text))


def parts(path: str, source: str, size: int = PART) -> Iterator[dict]:
    """entities (classes first), imports and calls of each part of a source, in order; raises Broken at one that has errors."""
    module, before = re.sub(r"\.[^./]*$", "", path), 0
    for text, tree in _trees(source, size):
        yield _walk(module, tree, re.split(r"\r\n|[\r\n]", text) if "\r" in text else text.split("\n"), before)
        before += text.count("\n") + text.count("\r") - text.count("\r\n")


def _walk(module: str, tree: ast.Module, lines: list[str], before: int) -> dict:
    """What parts() gives of a tree that begins after `before` lines."""
    out = {"entities": [], "imports": [], "calls": []}
    classes, functions = [], []

    def entity(kind, name, node):
        return {"name": name, "type": kind, "line_start": node.lineno + before, "line_end": node.end_lineno + before, "signature": _signature(node, lines) if kind == "function" else None, "complexity": node.end_lineno - node.lineno + 1, "source": "tree"}

    # Each item: (node, names around it, name of the function around it or None); a stack, so that deep nesting is no recursion.
    stack = [(n, (), None) for n in reversed(tree.body)]
    while stack:
        node, names, owner = stack.pop()
        if type(node) is ast.Expr:
            node = node.value
        inside = []
        if isinstance(node, _Function):
            inner = (*names, node.name)
            functions.append(entity("function", ".".join(inner), node))
            inside = [(d, names, owner) for d in node.decorator_list]
            own = [node.args, *([node.returns] if node.returns else []), *getattr(node, "type_params", []), *node.body]
            inside += [(n, inner, ".".join(inner)) for n in own]
        elif isinstance(node, ast.ClassDef):
            inner = (*names, node.name)
            classes.append(entity("class", ".".join(inner), node))
            inside = [(d, names, owner) for d in node.decorator_list]
            inside += [(n, names, owner) for n in [*node.bases, *node.keywords]] + [(n, inner, owner) for n in node.body]
        else:
            if isinstance(node, ast.Call) and owner:
                callee = _last_name(node.func) or ast.unparse(node.func)
                dotted = _dotted(node.func)
                out["calls"].append({"caller": owner, "callee": callee, "line": node.lineno + before, "callee_path": dotted})
            elif isinstance(node, ast.ImportFrom):
                named = [(a.name, a.asname or a.name) for a in node.names]
                out["imports"].append({"source_module": module, "target_module": "." * node.level + (node.module or ""), "imported_names": [a for a, _ in named], "local_names": [b for _, b in named], "is_from": True})
            elif isinstance(node, ast.Import):
                out["imports"] += [{"source_module": module, "target_module": a.name, "imported_names": [a.name], "local_names": [a.asname or a.name.split(".")[0]], "is_from": False} for a in node.names]
            if type(node) is ast.Call:
                below = [node.func, *node.args, *node.keywords]
            else:
                below = ast.iter_child_nodes(node)
            inside = [(n, names, owner) for n in below if type(n) not in _LEAVES]
        stack += reversed(inside)
    out["entities"] = classes + functions
    return out


def recovered(path: str, source: str) -> dict:
    """What a line rule finds in a source that does not parse."""
    entities = []
    for k, line in enumerate(source.splitlines(), 1):
        if m := _DEF.match(line):
            kind = "class" if m[1] == "class" else "function"
            entities.append({"name": m[2], "type": kind, "line_start": k, "line_end": k, "signature": line.strip().rstrip(":") if kind == "function" else None, "complexity": 1, "source": "tree"})
    entities.sort(key=lambda e: e["type"] != "class")
    return {"entities": entities, "recovered": True}
