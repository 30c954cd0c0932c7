"""A source tree and its history as DataFrames: files read by the tasks, history and blame by plain git."""

from __future__ import annotations

import gc
import os
import re
import subprocess
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import line_source, python_source, script_source

# Languages by suffix, folders and files that are left out.
LANGUAGES = {".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".ts": "typescript", ".tsx": "typescript"}
BY_LINE = (".java", ".go", ".rs", ".rb", ".php", ".c", ".cpp", ".h", ".hpp", ".cs", ".swift", ".kt", ".scala")
SKIPPED_FOLDERS = ("node_modules", ".git", "__pycache__", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt", "target", "vendor", ".tox", ".mypy_cache", ".pytest_cache", ".eggs", ".cache", "egg-info")
SKIPPED_FILES = ("package-lock.json", "yarn.lock", "pnpm-lock.yaml", "poetry.lock", "Pipfile.lock", ".DS_Store", "thumbs.db")


@dataclass(frozen=True)
class Limits:
    """Bounds of an analysis."""

    files: int = 5000
    many_files: int = 2000
    file_bytes: int = 500_000
    commits: int = 500
    owned_files: int = 200


class NotFound(ValueError):
    """A repository, folder, file or entity that is not there."""


class TooLarge(ValueError):
    """More files than the limit."""


_ENTITY = "struct<name:string,type:string,line_start:int,line_end:int,signature:string,complexity:int,source:string>"
_IMPORT = "struct<source_module:string,target_module:string,imported_names:array<string>,local_names:array<string>,is_from:boolean>"
_CALL = "struct<caller:string,callee:string,line:int,callee_path:string>"
PARSED = f"file_path string, language string, n_lines int, parse_method string, recovered boolean, warning string, part int, before struct<classes:int,functions:int,imports:int,calls:int>, entities array<{_ENTITY}>, imports array<{_IMPORT}>, calls array<{_CALL}>"
#: Entities, imports and calls that a worker gathers of small files before it hands them on.
GATHERED = 20_000


def language_of(suffix: str) -> str | None:
    s = suffix.lower()
    return LANGUAGES.get(s) or (s[1:] if s in BY_LINE else None)


def _inside(root: str, path: str) -> Path:
    base = Path(root).resolve()
    to = (base / path).resolve()
    if Path(path).is_absolute() or not to.is_relative_to(base):
        raise NotFound(f"{path} is not inside the repository")
    return to


def inside(root: str, path: str) -> str:
    """A path below root in its plain form (`a/../b` is `b`); raises for others."""
    if not path or not path.strip():
        raise NotFound("a path below the repository is needed")
    return _inside(root, path).relative_to(Path(root).resolve()).as_posix()


def supported_extensions() -> list[str]:
    """All suffixes that are read, in order."""
    return sorted((*LANGUAGES, *BY_LINE))


def wanted(files: DataFrame, path_col: str = "file_path", size_col: str = "size", limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """The rows of files that scan() would read, by path and size, with their language: built-in functions, for listings of any size."""
    parts = F.split(F.col(path_col), "/")
    name = F.element_at(parts, -1)
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    suffix = F.lower(F.regexp_extract(name, "[^.](\\.[^.]+)$", 1))
    language = F.create_map(*(F.lit(x) for kv in {**LANGUAGES, **{e: e[1:] for e in BY_LINE}}.items() for x in kv))[suffix]
    skipped = F.exists(folders, lambda f: f.isin(*SKIPPED_FOLDERS) | f.endswith(".egg-info"))
    return files.withColumn("language", language).where(F.col("language").isNotNull() & ~skipped & ~name.isin(*SKIPPED_FILES) & (F.col(size_col) <= limits.file_bytes))


def scan(spark: SparkSession, root: str, scope: str | None = None, limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """file_path, size, content of the code files below root, or below its folder `scope`. Links to folders are not followed.

    Spark's own readers leave out names that begin with `_`, so the tree is walked here, up to the limit of files; contents are read by
    the tasks, which must see the folder. For many repositories at once, give parsed() a table of file_path and content."""
    base = Path(root)
    if not base.is_absolute() or not base.is_dir():
        raise NotFound(f"{root} is not an absolute path of a folder")
    if scope and scope.strip() not in ("", "."):
        if not _inside(root, scope).is_dir():
            raise NotFound(f"{scope} is not a folder of the repository")
    top = base.resolve()
    found = []
    for folder, folders, names in os.walk(_inside(root, scope) if scope and scope.strip() not in ("", ".") else top):
        folders[:] = sorted(d for d in folders if d not in SKIPPED_FOLDERS and not d.endswith(".egg-info"))
        for name in names:
            file = Path(folder, name)
            if name in SKIPPED_FILES or language_of(file.suffix) is None or file.is_symlink() and not file.resolve().is_relative_to(top):
                continue
            try:
                size = file.stat().st_size
            except OSError:
                continue
            if size <= limits.file_bytes:
                found.append((file.relative_to(top).as_posix(), size))
                if len(found) > limits.files:
                    raise TooLarge(f"more than {limits.files} code files; choose a folder of them")

    def read(batches):
        for batch in batches:
            content = []
            for path in batch["file_path"]:
                try:
                    content.append(Path(top, path).read_bytes())
                except OSError:
                    content.append(None)
            batch["content"] = content
            yield batch[batch["content"].notna()]

    listed = spark.createDataFrame(sorted(found), "file_path string, size long").repartition(max(1, min(64, len(found) // 16)))
    return listed.mapInPandas(read, "file_path string, size long, content binary")


def _arrow(ddl: str):
    """The Arrow type of a struct in the form of PARSED: ints, strings, booleans, arrays and structs."""
    import pyarrow as pa

    fields, depth, start = [], 0, 0
    for k, ch in enumerate(ddl + ","):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and not depth:
            name, kind = re.split("[ :]", ddl[start:k].strip(), maxsplit=1)
            fields.append((name, kind))
            start = k + 1
    plain = {"int": pa.int32(), "string": pa.string(), "boolean": pa.bool_()}
    of = lambda kind: plain.get(kind) or (pa.list_(of(kind[6:-1])) if kind.startswith("array<") else pa.struct(_arrow(kind[7:-1])))
    return [pa.field(name, of(kind)) for name, kind in fields]


def _large(path: str, source: str, row: dict, schema):
    """The batches of a source in parts, as parse() would give it at once: packed until it is known that all of it parses, then each part is told
    how many classes, functions, imports and calls stand before it."""
    import pyarrow as pa

    held, sizes, packed = [], [], pa.ipc.IpcWriteOptions(compression="lz4")
    gc.disable()  # trees have no cycles, and looking for some takes a fifth of the time
    try:
        for found in python_source.parts(path, source):
            batch = pa.RecordBatch.from_pylist([row | found | {"part": len(held)}], schema=schema)
            held.append(pa.BufferOutputStream())
            with pa.ipc.new_stream(held[-1], schema, options=packed) as out:
                out.write_batch(batch)
            held[-1] = held[-1].getvalue()
            n = sum(e["type"] == "class" for e in found["entities"])
            sizes.append((n, len(found["entities"]) - n, len(found["imports"]), len(found["calls"])))
    finally:
        gc.enable()
    classes, sums, at = sum(x[0] for x in sizes), [0, 0, 0, 0], schema.get_field_index("before")
    for k, (n, *_) in enumerate(sizes):
        # a function's place in its part counts the part's classes, and so is moved by all others
        before = {"classes": sums[0], "functions": classes + sums[1] - n, "imports": sums[2], "calls": sums[3]}
        batch = pa.ipc.open_stream(held[k]).read_next_batch()
        yield batch.set_column(at, schema.field(at), pa.array([before], schema.field(at).type))
        sums = [a + b for a, b in zip(sums, sizes[k], strict=True)]


def _parse(batches):
    import pyarrow as pa

    schema = pa.schema(_arrow(PARSED))
    rows, weight = [], 0
    for batch in batches:
        for path, content in zip(batch.column("file_path").to_pylist(), batch.column("content"), strict=True):
            language = language_of(Path(path).suffix)
            row = {"file_path": path, "language": language, "n_lines": 0, "parse_method": "tree" if Path(path).suffix.lower() in LANGUAGES else "regex-fallback", "recovered": False, "warning": None, "part": 0, "before": {"classes": 0, "functions": 0, "imports": 0, "calls": 0}, "entities": [], "imports": [], "calls": []}
            try:
                source = str(content.as_buffer(), "utf-8")
            except UnicodeDecodeError:
                rows.append(row | {"language": None, "warning": f"{path} is not UTF-8"})
                continue
            row["n_lines"] = source.count("\n") + 1
            try:
                if language == "python" and len(source) > python_source.PART:
                    try:
                        yield from _large(path, source, row, schema)
                        continue
                    except python_source.Broken:
                        found = row | python_source.recovered(path, source)
                elif language == "python":
                    found = python_source.parse(path, source)
                elif row["parse_method"] == "tree":
                    found = script_source.parse(path, source)
                else:
                    found = line_source.parse(path, source, language)
                row |= found
                names = {e["name"] for e in row["entities"]}
                row["calls"] = [c for c in row["calls"] if c["caller"] in names]
                if found["recovered"]:
                    row["warning"] = f"{path} has syntax errors; it is analysed in part"
            except Exception as e:  # one file must not end the analysis
                row["warning"] = f"{path} could not be parsed: {type(e).__name__}"
            rows.append(row)
            weight += sum(len(row[k]) for k in ("entities", "imports", "calls"))
            if weight > GATHERED:
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
                rows, weight = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema=schema)


def parsed(files: DataFrame) -> DataFrame:
    """See PARSED: a row for each file, or for each part of a long one: `part` counts from 0, and `before` says how many classes, functions, imports and
    calls of the file come before the part's lists. Calls are those within one of the file's entities. Files that are not UTF-8 have a null language and a warning, and nothing else."""
    return files.select("file_path", "content").mapInArrow(_parse, PARSED)


def _git(root: str, *args: str) -> str | None:
    try:
        run = subprocess.run(["git", "-C", root, "-c", "core.quotepath=false", *args], capture_output=True, timeout=120, check=False)
    except (OSError, subprocess.TimeoutExpired):
        return None
    return run.stdout.decode("utf-8", "replace") if run.returncode == 0 else None


def head(root: str) -> str | None:
    """The current commit, None outside a repository."""
    out = _git(root, "rev-parse", "HEAD")
    return out.strip() if out else None


def is_clean(root: str, but: str | None = None) -> bool:
    """Whether nothing is modified or untracked, other than below the folder `but`."""
    out = _git(root, "status", "--porcelain", "--untracked-files=all")
    return out is not None and all(but and line[3:].strip('"').startswith(but) for line in out.splitlines())


def commits(spark: SparkSession, root: str, limits: Limits = Limits(), path: str | None = None) -> DataFrame:  # noqa: B008
    """sha, seq (larger is newer), ts, author, email, message, path: the newest commits, each against its first parent.

    With `path`, the newest commits that touch it. Bounded by limits.commits, so the log is read on the driver."""
    schema = "sha string, seq long, ts timestamp, author string, email string, message string, path string"
    if path is not None:
        _inside(root, path)
    out = _git(root, "log", f"--max-count={limits.commits}", "-M", "--name-only", "--diff-merges=first-parent", "--root", "--format=%x01%H%x02%ct%x02%an%x02%ae%x02%s", *(["--", f":(literal){path}"] if path else []))
    rows, blocks = [], (out or "").split("\x01")[1:]
    from datetime import datetime, timezone

    for k, block in enumerate(blocks):
        first, _, rest = block.partition("\n")
        sha, ts, author, email, message = first.split("\x02", 4)
        for p in sorted({x for x in rest.split("\n") if x}):
            rows.append((sha, len(blocks) - k, datetime.fromtimestamp(int(ts), timezone.utc), author, email, message[:120], p))
    return spark.createDataFrame(rows, schema)


def _blamed(root: str, most_bytes: int):
    """The lines of files by author, one git process a file, in the tasks that have the paths."""

    def run(batches):
        import pandas as pd

        for batch in batches:
            rows = []
            for path in batch["path"]:
                try:
                    file = _inside(root, path)
                    if not file.is_file() or file.stat().st_size > most_bytes:
                        continue
                except (NotFound, OSError):
                    continue
                author, counted = None, {}
                for line in (_git(root, "blame", "--line-porcelain", "HEAD", "--", path) or "").split("\n"):
                    if line.startswith("author "):
                        author = line[7:]
                    elif line.startswith("author-mail "):
                        own = counted.setdefault(author, [line[12:].strip("<>"), 0])
                        own[1] += 1
                rows += [(path, a, mail, n) for a, (mail, n) in counted.items()]
            yield pd.DataFrame(rows, columns=["path", "author", "email", "lines"])

    return run


def blame(spark: SparkSession, root: str, paths: list[str], limits: Limits = Limits()) -> DataFrame:  # noqa: B008
    """path, author, email, lines at the current commit; files above the size limit give no rows. Paths are dealt to the tasks, which must see the folder, as
    those of scan() must; each path is a git process of its own."""
    for path in paths:
        _inside(root, path)
    few = [(p,) for p in paths[: limits.owned_files]]
    dealt = spark.createDataFrame(few, "path string").repartition(max(1, min(len(few), spark.sparkContext.defaultParallelism)))
    return dealt.mapInPandas(_blamed(root, limits.file_bytes), "path string, author string, email string, lines long")
