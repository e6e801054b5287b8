"""Python source and documentation text -> rows.

The syntax tree is the one thing that needs Python on the executors: files go through
mapInPandas in Arrow batches, and everything after works on columns.
"""

from __future__ import annotations

import ast
import bisect
import re
import textwrap
from collections.abc import Iterable, Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions._lift import arrow_function
from ..sources import shared
from . import docstrings

PARAMETER = "struct<pos:int, name:string, type_annotation:string, default_value:string, is_required:boolean>"
FUNCTION = f"function_id string, file_path string, line_number int, end_line_number int, name string, return_type string, is_async boolean, is_method boolean, decorators array<string>, source_code string, parameters array<{PARAMETER}>, raw_doc string, parse_error string"
EXCEPTIONS = "array<struct<exception_type:string, description:string, line:int, is_re_raised:boolean, confidence:double>>"
_FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def tree_of(source: str) -> tuple[ast.AST | None, str | None]:
    """The syntax tree; on a syntax error that of the longest run of whole statements from the
    start that parses, with the message; without any, None.

    A cut is possible before a line at the left margin. An error that the parser reports in some
    line is one in every longer text too, an open bracket or text where it opens; so the next cut to
    try is the last one up to that line, and the first that parses is the longest."""
    try:
        return ast.parse(source), None
    except (SyntaxError, ValueError) as e:
        first = _error_line(source, e)
        error = f"line {first}: {e.args[0]}"
    lines = source.split("\n")
    cuts = [0, *(i for i, x in enumerate(lines) if i and x[:1] not in ("", " ", "\t", "#", ")", "]", "}"))]
    at = bisect.bisect_right(cuts, first - 1) - 1
    while at > 0:
        text = "\n".join(lines[: cuts[at]])
        try:
            tree = ast.parse(text)
            return (tree if tree.body else None), error
        except (SyntaxError, ValueError) as e:
            at = min(at - 1, bisect.bisect_right(cuts, _error_line(text, e) - 1) - 1)
    return None, error


def _error_line(source: str, e: Exception) -> int:
    """Where a text's error is; of a zero byte, which has no place in the message, its line."""
    if "\0" in source:
        return source[: source.index("\0")].count("\n") + 1
    return getattr(e, "lineno", None) or 1


_BLOCKS = ("body", "handlers", "orelse", "finalbody", "cases")


def statements(tree: ast.AST) -> list[tuple[ast.AST, bool]]:
    """The tree and its statements in the order of ``ast.walk``, with whether each stands right in a class.
    Expressions hold no statements, so most of a tree isn't visited."""
    out = [(tree, False)]
    for node, _ in out:
        inside = isinstance(node, ast.ClassDef)
        for block in _BLOCKS:
            out += [(c, inside) for c in getattr(node, block, ())]
    return out


def walk(node: ast.AST) -> list[ast.AST]:
    """As ``ast.walk``, but for the marks of what is loaded and stored."""
    out = [node]
    for n in out:
        for name in n._fields:
            if name == "ctx":
                continue
            x = getattr(n, name, None)
            if isinstance(x, list):
                out += [c for c in x if isinstance(c, ast.AST)]
            elif isinstance(x, ast.AST):
                out.append(x)
    return out


def parameters_of(args: ast.arguments) -> list[dict]:
    """Names carry their kind: ``x/`` positional only, ``*x``, ``**x``."""
    text = lambda n: None if n is None else ast.unparse(n)
    plain = [(a, "/") for a in args.posonlyargs] + [(a, "") for a in args.args]
    defaults = [None] * (len(plain) - len(args.defaults)) + list(args.defaults)
    out = [(f"{a.arg}{mark}", text(a.annotation), text(d), d is None) for (a, mark), d in zip(plain, defaults, strict=True)]
    if args.vararg:
        out.append((f"*{args.vararg.arg}", text(args.vararg.annotation), None, False))
    out += [(a.arg, text(a.annotation), text(d), d is None) for a, d in zip(args.kwonlyargs, args.kw_defaults, strict=True)]
    if args.kwarg:
        out.append((f"**{args.kwarg.arg}", text(args.kwarg.annotation), None, False))
    return [{"pos": i, "name": n, "type_annotation": t, "default_value": d, "is_required": r} for i, (n, t, d, r) in enumerate(out)]


def functions_of(path: str, source: str) -> list[tuple]:
    """All functions of a file, outer before inner ones."""
    tree, error = tree_of(source)
    return [row for row, _ in _functions(path, source, statements(tree), error)] if tree else []


def _functions(path: str, source: str, found: list[tuple[ast.AST, bool]], error: str | None) -> list[tuple[tuple, ast.AST]]:
    lines, out = source.split("\n"), []
    for node, in_class in found:
        if isinstance(node, _FUNCTIONS):
            params = parameters_of(node.args)
            method = in_class or bool(params) and params[0]["name"].rstrip("/") in ("self", "cls")
            end = node.end_lineno or node.lineno
            row = (
                f"{path}:{node.lineno}:{node.name}", path, node.lineno, end, node.name, ast.unparse(node.returns) if node.returns else None, isinstance(node, ast.AsyncFunctionDef), method,
                [ast.unparse(d) for d in node.decorator_list], "\n".join(lines[node.lineno - 1 : end]), params, ast.get_docstring(node), error,
            )
            out.append((row, node))
    return out


def split_ddl(ddl: str) -> list[str]:
    """``a int, b array<...>`` -> its columns; brackets nest."""
    depth, out, word = 0, [], ""
    for c in ddl + ",":
        depth += (c in "<(") - (c in ">)")
        if c == "," and not depth:
            out.append(word.strip())
            word = ""
        else:
            word += c
    return out


@cache
def _columns(ddl: str) -> list[str]:
    return [c.split()[0] for c in split_ddl(ddl)]


def _table(files: DataFrame, schema: str, rows) -> DataFrame:
    cols = _columns(schema)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame([r for p, s in zip(b["path"], b["content"], strict=True) for r in rows(p, s)], columns=cols)

    return files.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(work, schema)


def functions(files: DataFrame) -> DataFrame:
    """(path, content) -> one row per function. Files without functions give none; a file
    with a syntax error gives those before it, with the message."""
    return _table(files, FUNCTION, functions_of)


IMPORT = "module string, import_type string, source string, imported_names array<string>, aliases map<string,string>, line int, level int"


def module_name(path: str) -> str:
    m = re.sub(r"\.py$", "", path.replace("\\", "/").strip("/")).replace("/", ".")
    return re.sub(r"(^|\.)__init__$", "", m)


def imports_of(path: str, source: str) -> list[tuple]:
    tree, _ = tree_of(source)
    return _imports(path, statements(tree) if tree else [])


def _imports(path: str, found: list[tuple[ast.AST, bool]]) -> list[tuple]:
    out, here = [], module_name(path)
    for node, _ in found:
        if isinstance(node, ast.Import):
            out += [(here, "standard", a.name, [a.name], {a.asname: a.name} if a.asname else {}, node.lineno, 0) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            kind = "wildcard" if any(a.name == "*" for a in node.names) else "relative" if node.level else "from"
            source_ = node.module or ""
            if node.level:
                base = here.split(".")
                base = base[: len(base) - node.level + (1 if path.endswith("__init__.py") else 0)]
                source_ = ".".join([*base, *([node.module] if node.module else [])])
            out.append((here, kind, source_, [a.name for a in node.names], {a.asname: a.name for a in node.names if a.asname}, node.lineno, node.level))
    return out


def imports(files: DataFrame) -> DataFrame:
    """(path, content) -> imports, relative ones resolved against the importing module."""
    return _table(files, IMPORT, imports_of)


EXPORT = "module string, exports array<string>, is_package boolean, module_doc string"


def exports_of(path: str, source: str) -> list[tuple]:
    """``__all__`` if it is a list of strings, else the public names."""
    return _exports(path, tree_of(source)[0])


def _exports(path: str, tree: ast.AST | None) -> list[tuple]:
    if tree is None:
        return [(module_name(path), [], path.endswith("__init__.py"), None)]
    listed = next((n.value for n in tree.body if isinstance(n, ast.Assign) and any(isinstance(t, ast.Name) and t.id == "__all__" for t in n.targets)), None)
    if isinstance(listed, (ast.List, ast.Tuple)):
        names = [e.value for e in listed.elts if isinstance(e, ast.Constant) and isinstance(e.value, str)]
    else:
        names = [n.name for n in tree.body if isinstance(n, (*_FUNCTIONS, ast.ClassDef)) and not n.name.startswith("_")]
    return [(module_name(path), sorted(set(names)), path.endswith("__init__.py"), ast.get_docstring(tree))]


def modules(files: DataFrame) -> DataFrame:
    return _table(files, EXPORT, exports_of)


# What some calls may raise.
CALLS = {"open": ("FileNotFoundError", "PermissionError", "IOError"), "int": ("ValueError",), "float": ("ValueError",), "len": ("TypeError",), "max": ("ValueError",), "min": ("ValueError",), "next": ("StopIteration",), "iter": ("TypeError",), "getattr": ("AttributeError",), "setattr": ("AttributeError",), "delattr": ("AttributeError",)}


def exceptions_of(source: str) -> list[dict]:
    """What a function may raise, the surest of each type, by falling confidence: raised by
    name 0.95, re-raised 0.8, by a known call 0.6, a subscript 0.4, an attribute 0.3."""
    func = function_in(source)
    return raised_in(func, 0) if func else []


def function_in(source: str) -> ast.FunctionDef | ast.AsyncFunctionDef | None:
    """The first function of a piece of source, which may be indented."""
    tree, _ = tree_of(textwrap.dedent(source or ""))
    return next((n for n in ast.walk(tree) if isinstance(n, _FUNCTIONS)), None) if tree else None


def raised_in(func: ast.FunctionDef | ast.AsyncFunctionDef, before: int) -> list[dict]:
    """before: lines of the text above the function's."""
    best: dict[str, tuple[float, int, int, bool]] = {}

    def note(kind: str, confidence: float, line: int, again: bool = False) -> None:
        if kind not in best or best[kind][0] < confidence:
            best[kind] = (confidence, len(best), line - before, again)

    decorators = {n for d in func.decorator_list for n in walk(d)}
    for n in walk(func):
        if n in decorators:
            continue
        if isinstance(n, ast.Raise):
            e = n.exc.func if isinstance(n.exc, ast.Call) else n.exc
            if n.exc is None:
                note("Exception", 0.8, n.lineno, True)
            elif isinstance(e, ast.Name):
                note(e.id, 0.95, n.lineno)
        elif isinstance(n, ast.Call):
            for kind in CALLS.get(getattr(n.func, "id", getattr(n.func, "attr", "")), ()):
                note(kind, 0.6, n.lineno)
        elif isinstance(n, ast.Subscript):
            note("KeyError", 0.4, n.lineno)
            note("IndexError", 0.4, n.lineno)
        elif isinstance(n, ast.Attribute):
            note("AttributeError", 0.3, n.lineno)
    return [{"exception_type": k, "description": f"When a {k} condition occurs", "line": line, "is_re_raised": again, "confidence": c} for k, (c, _, line, again) in sorted(best.items(), key=lambda x: (-x[1][0], x[0]))]


def behaviour_of(source: str) -> list[dict]:
    """Patterns of control flow, data, side effects and errors in a function's body."""
    func = function_in(source)
    if func is None:
        return []
    nodes = walk(func)
    loops = [n for n in nodes if isinstance(n, (ast.For, ast.AsyncFor, ast.While))]
    nested = any(isinstance(m, (ast.For, ast.AsyncFor, ast.While)) for n in loops for c in ast.iter_child_nodes(n) for m in ast.walk(c))
    calls = {getattr(n.func, "id", getattr(n.func, "attr", "")) for n in nodes if isinstance(n, ast.Call)}
    own = [n for n in nodes if isinstance(n, ast.Call) and getattr(n.func, "id", None) == func.name]
    returns = [n for n in nodes if isinstance(n, ast.Return) and n.value is not None]
    signs = (
        ("iteration", bool(loops), 0.9), ("nested_iteration", nested, 0.9), ("conditional", any(isinstance(n, ast.If) for n in nodes), 0.8), ("recursion", bool(own), 0.95), ("generator", any(isinstance(n, (ast.Yield, ast.YieldFrom)) for n in nodes), 0.95),
        ("comprehension", any(isinstance(n, (ast.ListComp, ast.SetComp, ast.DictComp, ast.GeneratorExp)) for n in nodes), 0.8), ("error_handling", any(isinstance(n, ast.Try) for n in nodes), 0.9), ("context_manager", any(isinstance(n, (ast.With, ast.AsyncWith)) for n in nodes), 0.9),
        ("global_state", any(isinstance(n, (ast.Global, ast.Nonlocal)) for n in nodes), 0.9), ("attribute_assignment", any(isinstance(t, ast.Attribute) for n in nodes if isinstance(n, ast.Assign) for t in n.targets), 0.8), ("file_access", "open" in calls, 0.85), ("output", "print" in calls, 0.8),
        ("multiple_returns", len(returns) > 1, 0.8), ("awaiting", any(isinstance(n, ast.Await) for n in nodes), 0.9), ("assertion", any(isinstance(n, ast.Assert) for n in nodes), 0.8),
    )
    return [{"pattern": p, "confidence": c} for p, found, c in signs if found]


def returns_of(source: str) -> dict:
    """The kinds of values that a function's return and yield statements give."""
    func = function_in(source)
    kinds, yields, bare, stack = set(), set(), False, list(func.body) if func else []
    while stack:  # not into inner functions
        n = stack.pop()
        if isinstance(n, (*_FUNCTIONS, ast.ClassDef, ast.Lambda)):
            continue
        if isinstance(n, ast.Return):
            bare |= n.value is None
            if n.value is not None:
                kinds.add(kind_of(n.value))
        elif isinstance(n, (ast.Yield, ast.YieldFrom)):
            yields.add(kind_of(n.value) if n.value is not None else "None")
        stack += ast.iter_child_nodes(n)
    if bare and kinds:
        kinds.add("None")
    return {"return_types": sorted(kinds), "yield_types": sorted(yields), "is_generator": bool(yields)}


def kind_of(node: ast.expr) -> str:
    if isinstance(node, ast.Constant):
        return type(node.value).__name__ if node.value is not None else "None"
    names = {ast.List: "list", ast.ListComp: "list", ast.Dict: "dict", ast.DictComp: "dict", ast.Set: "set", ast.SetComp: "set", ast.Tuple: "tuple", ast.JoinedStr: "str", ast.Compare: "bool", ast.GeneratorExp: "Generator", ast.Lambda: "Callable"}
    if isinstance(node, ast.Call) and isinstance(node.func, ast.Name):
        return node.func.id if node.func.id in ("int", "str", "float", "bool", "list", "dict", "set", "tuple", "bytes") or node.func.id[:1].isupper() else "Any"
    return names.get(type(node), "Any")


def calls_of(source: str) -> list[dict]:
    """Which functions a piece of code calls, how often, and with which keywords."""
    tree, _ = tree_of(textwrap.dedent(source or ""))
    found: dict[str, dict] = {}
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, ast.Call):
            name = ast.unparse(n.func)
            x = found.setdefault(name, {"callee": name, "uses": 0, "keywords": set()})
            x["uses"] += 1
            x["keywords"] |= {k.arg for k in n.keywords if k.arg}
    return [{**x, "keywords": sorted(x["keywords"])} for _, x in sorted(found.items())]


def _each(series_type: str, f):
    @arrow_function(series_type, once=True)
    def run(source: pd.Series) -> pd.Series:
        return source.map(f)

    return run


exceptions = _each(EXCEPTIONS, exceptions_of)
behaviour = _each("array<struct<pattern:string, confidence:double>>", behaviour_of)
calls = _each("array<struct<callee:string, uses:int, keywords:array<string>>>", calls_of)


@arrow_function("return_types array<string>, yield_types array<string>, is_generator boolean")
def returns(source: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([returns_of(s) for s in source], columns=["return_types", "yield_types", "is_generator"])


def docstrings_in(source: str) -> list[str]:
    """All documentation texts of a file, for a vote on its style."""
    tree, _ = tree_of(source or "")
    return [d for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.ClassDef, *_FUNCTIONS)) and (d := ast.get_docstring(n))] if tree else []


file_docstrings = _each("array<string>", docstrings_in)


#: A file's own row: how much of it could be parsed, and why not the rest.
FILE = "path string, lines int, functions int, classes int, parse_error string"
PROJECT = f"kind string, {FUNCTION}, doc struct<{', '.join(c.replace(' ', ':', 1) for c in split_ddl(docstrings.DOC))}>, exceptions {EXCEPTIONS}, " + ", ".join(f"{m}_{c}" for m, ddl in (("import", IMPORT), ("module", EXPORT), ("in", FILE)) for c in split_ddl(ddl))


def project_of(path: str, source: str) -> Iterator[dict]:
    """All that one parse of a file gives, as records of one kind each."""
    tree, error = tree_of(source)
    names = _columns(FUNCTION)
    inside = statements(tree) if tree else []
    found = _functions(path, source, inside, error)
    for row, node in found:
        x = dict(zip(names, row, strict=True))
        yield {"kind": "function", **x, "doc": docstrings.parse(x["raw_doc"]), "exceptions": raised_in(node, node.lineno - 1)}
    for kind, ddl, rows in (("import", IMPORT, _imports(path, inside)), ("module", EXPORT, _exports(path, tree))):
        for row in rows:
            yield {"kind": kind, **{f"{kind}_{c}": v for c, v in zip(_columns(ddl), row, strict=True)}}
    classes = sum(isinstance(n, ast.ClassDef) for n, _ in inside)
    yield {"kind": "file", **{f"in_{c}": v for c, v in zip(_columns(FILE), (path, source.count("\n") + 1, len(found), classes, error), strict=True)}}


def project(files: DataFrame) -> DataFrame:
    """(path, content) -> everything that the stages read, from one parse of each file: rows of
    the kinds function (with ``doc`` and ``exceptions``), import, module and file. To be stored; see ``Project``."""
    cols = _columns(PROJECT)

    def work(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [r for p, s in zip(b["path"], b["content"], strict=True) for r in project_of(p, s)]
            yield pd.DataFrame({c: pd.Series([r.get(c) for r in rows], dtype=object) for c in cols})

    return files.select("path", F.coalesce("content", F.lit("")).alias("content")).mapInPandas(work, PROJECT)


class Project:
    """A stored project; its parts are scans of few columns of one table."""

    def __init__(self, files: DataFrame):
        self.table = shared.store(project(files), "project")

    def _part(self, kind: str, ddl: str, *more: str) -> DataFrame:
        prefix = {"function": "", "file": "in_"}.get(kind, f"{kind}_")
        return self.table.where(F.col("kind") == kind).select(*(F.col(f"{prefix}{c}").alias(c) for c in _columns(ddl)), *more)

    @property
    def functions(self) -> DataFrame:
        """With ``doc`` (null without documentation) and ``exceptions``."""
        return self._part("function", FUNCTION, "doc", "exceptions")

    @property
    def imports(self) -> DataFrame:
        return self._part("import", IMPORT)

    @property
    def modules(self) -> DataFrame:
        return self._part("module", EXPORT)

    @property
    def files(self) -> DataFrame:
        """A row for every file, also for those without functions or that can't be parsed."""
        return self._part("file", FILE)

    def discard(self) -> None:
        shared.discard(self.table)


def functions_once(files: DataFrame) -> DataFrame:
    """As ``functions``, but files of equal content are parsed once: each content's smallest
    path stands for it, and its rows come back under every path."""
    hashed = files.select("path", F.coalesce("content", F.lit("")).alias("content")).withColumn("key", F.sha2("content", 256))
    first = hashed.groupBy("key").agg(F.min("path").alias("path"), F.first("content").alias("content"))
    parsed_ = functions(first).withColumnRenamed("file_path", "first_path")
    paths = hashed.select("key", "path").join(first.select("key", F.col("path").alias("first_path")), "key")
    out = parsed_.join(paths, "first_path").withColumn("file_path", F.col("path"))
    out = out.withColumn("function_id", F.concat_ws(":", "file_path", "line_number", "name"))
    return out.select(*_columns(FUNCTION))
