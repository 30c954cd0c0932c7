"""Declarations, imports and calls of JavaScript and TypeScript by a tokenizer and a stack of braces.

It knows strings, templates, comments, regular expressions, `class`, `function`, methods, and arrows and function expressions bound
by const, let or var. What it does not know: generics with arrows inside call heads, and automatic semicolons that change meaning."""

from __future__ import annotations

import re

_TOKEN = re.compile(
    r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<text>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>\d[\w.]*)|(?P<op>=>|\.\.\.|\?\.|[-+*/%&|^!=<>]=+|&&|\|\||\+\+|--|.)""",
    re.S | re.X,
)
#: Words before parentheses that are neither a call nor a method's name.
_WORDS = frozenset("if for while switch catch return typeof await new function super import do else in of instanceof void delete throw case yield with async".split())
_IMPORT = re.compile(r"^\s*import\s+(?P<what>[^'\"]*?)(?:\s*from\s*)?[\"'](?P<target>[^\"']+)[\"']", re.M)


def _tokens(source: str) -> list[tuple[str, str, int]]:
    out, at, line = [], 0, 1
    while at < len(source):
        last = out[-1] if out else ("op", ";", 0)
        if source[at] == "/" and source[at : at + 2] not in ("//", "/*") and (last[0] == "op" and last[1] not in (")", "]", "}") or last[1] in ("return", "typeof", "case")):
            m = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*").match(source, at)
            if m:
                out.append(("text", m[0], line))
                at = m.end()
                continue
        m = _TOKEN.match(source, at)
        if m.lastgroup != "skip":
            out.append((m.lastgroup, m[0], line))
        line += m[0].count("\n")
        at = m.end()
    return out


def _pairs(tokens) -> dict[int, int]:
    open_, out = [], {}
    for k, (kind, t, _) in enumerate(tokens):
        if kind == "op" and t in "([{":
            open_.append(k)
        elif kind == "op" and t in ")]}" and open_:
            out[open_.pop()] = k
    return out


def imports(path: str, source: str) -> list[dict]:
    module, out = re.sub(r"\.[^./]*$", "", path), []
    for m in _IMPORT.finditer(source):
        what, target = re.sub(r"^type\s+", "", m["what"].strip()), m["target"]
        names, local, is_from = [], [], False
        if braces := re.search(r"\{([^}]*)\}", what, re.S):
            is_from = True
            for part in braces[1].split(","):
                words = re.sub(r"^type\s+", "", part.strip()).split()
                if words:
                    names.append(words[0])
                    local.append(words[-1])
        elif star := re.search(r"\*\s*as\s+([\w$]+)", what):
            local = [star[1]]
        elif what:
            names = local = [what.strip().rstrip(",").strip()]
        out.append({"source_module": module, "target_module": target, "imported_names": names, "local_names": list(local), "is_from": is_from})
    return out


def parse(path: str, source: str) -> dict:
    """entities, imports and calls as dicts, and whether brackets do not match."""
    tokens = _tokens(source)
    ends = _pairs(tokens)
    lines = source.split("\n")
    text = lambda k: tokens[k][1] if 0 <= k < len(tokens) else ""
    kind = lambda k: tokens[k][0] if 0 <= k < len(tokens) else ""
    scopes = []  # (first token, last token, name, kind, first line)

    def body(k: int) -> int | None:
        """The brace that opens the body after the parameters that close at k."""
        depth = 0
        for j in range(k + 1, min(k + 80, len(tokens))):
            t = text(j)
            if t == "{" and depth == 0 and text(j - 1) not in (":", "|", "&"):
                return j
            depth += (t in "([{<") - (t in ")]}>") if kind(j) == "op" and len(t) == 1 else 0
            if t in (";", ",") and depth <= 0 or depth < 0:
                return None
        return None

    def expression_end(k: int) -> int:
        depth = 0
        for j in range(k, len(tokens)):
            t = text(j)
            if kind(j) == "op":
                depth += (t in "([{") - (t in ")]}") if len(t) == 1 else 0
                if depth < 0 or depth == 0 and t in (";", ",") and j > k:
                    return j - 1
            if depth == 0 and j > k and tokens[j][2] > tokens[j - 1][2] and kind(j) == "name" and text(j - 1) not in ("=>", ".", "?.", "=", "+", "&&", "||", "?", ":"):
                return j - 1
        return len(tokens) - 1

    class_bodies = {}
    for k, (what, t, line) in enumerate(tokens):
        if what != "name":
            continue
        if t == "class" and kind(k + 1) == "name" and text(k - 1) != ".":
            start = next((j for j in range(k + 1, min(k + 60, len(tokens))) if text(j) == "{"), None)
            if start in ends:
                scopes.append((k, ends[start], text(k + 1), "class", line))
                class_bodies[start] = ends[start]
        elif t == "function" and text(k - 1) != ".":
            name_at = k + 1 + (text(k + 1) == "*")
            if kind(name_at) == "name":
                p = next((j for j in range(name_at + 1, min(name_at + 30, len(tokens))) if text(j) == "("), None)
                start = body(ends[p]) if p in ends else None
                if start in ends:
                    first = k - 1 if text(k - 1) == "async" else k
                    scopes.append((first, ends[start], text(name_at), "function", tokens[first][2]))
        elif t in ("const", "let", "var") and kind(k + 1) == "name":
            eq = next((j for j in range(k + 2, min(k + 60, len(tokens))) if text(j) in ("=", ";") or text(j) == "=>"), None)
            if eq is None or text(eq) != "=":
                continue
            p = eq + 1 + (text(eq + 1) == "async")
            arrow = p + 1 if kind(p) == "name" and text(p + 1) == "=>" else None
            if text(p) == "(" and p in ends:
                arrow = next((j for j in range(ends[p] + 1, min(ends[p] + 30, len(tokens))) if text(j) in ("=>", ";")), None)
            if arrow is None or text(arrow) != "=>":
                continue
            last = ends.get(arrow + 1) if text(arrow + 1) == "{" else expression_end(arrow + 1)
            scopes.append((p, last if last is not None else len(tokens) - 1, text(k + 1), "arrow", tokens[p][2]))
    for start, stop in class_bodies.items():
        k = start + 1
        while k < stop:
            if kind(k) == "name" and text(k + 1) == "(" and text(k) not in _WORDS and text(k - 1) not in (".", "new"):
                after = body(ends.get(k + 1, stop)) if k + 1 in ends else None
                if after in ends:
                    first = k
                    while text(first - 1) in ("async", "static", "get", "set", "public", "private", "protected", "override", "readonly"):
                        first -= 1
                    scopes.append((first, ends[after], text(k), "method", tokens[first][2]))
                    k = ends[after] + 1
                    continue
            k = ends[k] + 1 if text(k) in ("{", "(", "[") and k in ends else k + 1
    scopes.sort(key=lambda s: (s[0], -s[1]))
    named, entities = [], []
    for s in scopes:
        around = [x for x in scopes if x[0] < s[0] and s[1] <= x[1]]
        name = ".".join([*(x[2] for x in around if x[3] != "arrow"), s[2]])  # an arrow around adds no name
        named.append((s[0], s[1], name, s[3]))
        is_class = s[3] == "class"
        end = tokens[s[1]][2]
        entities.append({"name": name, "type": "class" if is_class else "function", "line_start": s[4], "line_end": end, "signature": None if is_class else lines[s[4] - 1].strip(), "complexity": end - s[4] + 1, "source": "tree"})
    entities.sort(key=lambda e: e["type"] != "class")
    calls = []
    for k, (_, t, _) in enumerate(tokens):
        if t != "(" or kind(k) != "op" or kind(k - 1) != "name" or text(k - 1) in _WORDS or text(k - 2) in ("function", "new", "class"):
            continue
        owner = [n for n in named if n[0] <= k <= n[1] and n[3] != "class"]
        if not owner or any(n[3] in ("method", "function") and n[0] <= k - 1 and n[2].split(".")[-1] == text(k - 1) and k - 1 - n[0] <= 3 and text(n[0]) in (text(k - 1), "function", "async", "static", "get", "set", "public", "private") for n in owner[-1:]):
            continue
        path_, j = [text(k - 1)], k - 2
        while text(j) in (".", "?.") and kind(j - 1) == "name":
            path_.insert(0, text(j - 1))
            j -= 2
        whole = text(j) not in (".", "?.")
        if text(j) == "new":
            continue
        calls.append({"caller": owner[-1][2], "callee": text(k - 1), "line": tokens[k - 1][2], "callee_path": ".".join(path_) if whole else None})
    balanced = sum(t in "([{" for w, t, _ in tokens if w == "op" and len(t) == 1) == len(ends) == sum(t in ")]}" for w, t, _ in tokens if w == "op" and len(t) == 1)
    return {"entities": entities, "imports": imports(path, source), "calls": calls, "recovered": not balanced}
