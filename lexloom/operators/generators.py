"""One suggestion for each finding: a registry of generators by issue type.

A generator gets a case (the finding and its function, parsed) and returns a repaired
documentation as a record, or None if it has nothing to offer. All generators run in one
Arrow pass over the findings; what a function's own row already holds is not parsed again.
"""

from __future__ import annotations

import ast
import difflib
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import docstrings, parse, suggestions
from .patterns import HINT


@dataclass
class Case:
    issue_type: str
    subject: str | None
    name: str
    parameters: list[dict]
    return_type: str | None
    exceptions: list[dict]
    decorators: list[str]
    is_async: bool
    doc: dict
    source: str
    #: What similar examples say: (slot, subject) -> texts, the best first.
    hints: dict = field(default_factory=dict)
    #: Slots that were asked for and had something to say.
    used: set = field(default_factory=set)

    def hint(self, slot: str, subject: str = "") -> str | None:
        texts = self.hints.get((slot, subject))
        if texts:
            self.used.add(slot)
        return texts[0] if texts else None

    @property
    def own(self) -> list[dict]:
        """Parameters without self and cls."""
        return [p for p in self.parameters if bare(p["name"]) not in ("self", "cls")]

    @property
    def told(self) -> list[dict]:
        return list(self.doc["parameters"])


Generator = Callable[[Case], "dict | None"]


def bare(name: str) -> str:
    return name.strip("*/")


def entry(c: Case, p: dict, before: dict | None = None) -> dict:
    """A documented parameter for one of the signature; a description that says something stays,
    else examples that describe such a parameter decide, else its name and type."""
    keep = before is not None and not docstrings.generic(before["description"])
    text = before["description"] if keep else c.hint("parameter", bare(p["name"])) or suggestions.placeholder(p["name"], p["type_annotation"])
    return {"name": p["name"].rstrip("/"), "type_str": p["type_annotation"], "description": text, "is_optional": not p["is_required"], "default_value": p["default_value"]}


def add_missing(c: Case) -> dict | None:
    """Undocumented parameters join the documented ones, in signature order."""
    told = {bare(p["name"]): p for p in c.told}
    order = {bare(p["name"]): i for i, p in enumerate(c.own)}
    new = c.told + [entry(c, p) for p in c.own if bare(p["name"]) not in told]
    return c.doc | {"parameters": sorted(new, key=lambda p: order.get(bare(p["name"]), len(order)))}


def rename(c: Case) -> dict | None:
    """A documented name that the signature lacks becomes its most alike undocumented one, or goes."""
    told = {bare(p["name"]) for p in c.told}
    free = {bare(p["name"]): p for p in c.own if bare(p["name"]) not in told}
    best = max(free, key=lambda n: (suggestions._ratio(n, c.subject or ""), n), default=None)
    if best is not None and suggestions._ratio(best, c.subject or "") <= 0.6:
        best = None
    new = []
    for p in c.told:
        if bare(p["name"]) != c.subject:
            new.append(p)
        elif best is not None:
            new.append(entry(c, free[best], p))
    return c.doc | {"parameters": new} if len(new) < len(c.told) or best is not None else None


def retype(c: Case) -> dict | None:
    kinds = {bare(p["name"]): p["type_annotation"] for p in c.own}
    return c.doc | {"parameters": [p | {"type_str": kinds.get(bare(p["name"])) or p["type_str"]} for p in c.told]}


def redefault(c: Case) -> dict | None:
    """Documented defaults as in the signature, also where the description tells them."""
    values = {bare(p["name"]): p["default_value"] for p in c.own}
    new = []
    for p in c.told:
        now, was = values.get(bare(p["name"])), p["default_value"]
        if now is not None and was is not None and now != was:
            p = p | {"default_value": now, "description": p["description"].replace(f"efaults to {was}", f"efaults to {now}")}
        new.append(p)
    return c.doc | {"parameters": new}


def reorder(c: Case) -> dict | None:
    order = {bare(p["name"]): i for i, p in enumerate(c.own)}
    return c.doc | {"parameters": sorted(c.told, key=lambda p: order.get(bare(p["name"]), len(order)))}


def sync_all(c: Case) -> dict | None:
    told = {bare(p["name"]): p for p in c.told}
    return c.doc | {"parameters": [entry(c, p, told.get(bare(p["name"]))) for p in c.own]}


def inferred_return(c: Case) -> str | None:
    """The annotation, or what the return and yield statements give."""
    if c.return_type:
        return c.return_type
    found = parse.returns_of(c.source)
    kinds = found["yield_types"] if found["is_generator"] else found["return_types"]
    known = [k for k in kinds if k != "None"]
    if not known or "Any" in known:
        return "Generator" if found["is_generator"] else None
    one = known[0] if len(known) == 1 else f"Union[{', '.join(known)}]"
    if found["is_generator"]:
        return f"Iterator[{one}]"
    return f"Optional[{one}]" if "None" in kinds else one


def add_returns(c: Case) -> dict | None:
    kind = inferred_return(c)
    if kind is None or kind == "None":
        return None
    old = c.doc["returns"] or {}
    words = {"bool": "True if it holds, False otherwise.", "Iterator": "The items, one after the other.", "Generator": "The items, one after the other."}
    return c.doc | {"returns": {"type_str": kind, "description": old.get("description") or c.hint("returns") or words.get(kind.split("[")[0], "The result.")}}


def add_raises(c: Case) -> dict | None:
    told = {r["exception_type"] for r in c.doc["raises"]}
    conditions = {"ValueError": "If a value is not valid.", "TypeError": "If a type is not valid.", "KeyError": "If a key is missing.", "IndexError": "If an index is out of range."}
    own = raise_conditions(c.source)
    here = lambda e: f"Raised if {own[e]}." if e in conditions and e in own else f"If {own[e]}." if e in own else None
    said = lambda e: c.hint("raises", e) or " ".join(filter(None, [conditions.get(e), here(e)]))
    new = [{"exception_type": e["exception_type"], "description": said(e["exception_type"]) or e["description"]} for e in c.exceptions if e["confidence"] >= 0.8 and e["exception_type"] not in told]
    return c.doc | {"raises": [*c.doc["raises"], *new]} if new else None


# What a pattern of behaviour says in a description.
BEHAVIOUR = {"iteration": "Iterates over its input.", "recursion": "Calls itself.", "generator": "Yields items lazily.", "error_handling": "Handles errors inside.", "context_manager": "Manages a resource.", "file_access": "Reads or writes files.", "global_state": "Changes global state.", "awaiting": "Waits for other tasks."}


def describe(c: Case) -> dict | None:
    """The description tells the patterns of behaviour that it does not tell yet, and what
    examples say about functions of such a name."""
    old = c.doc["description"] or ""
    new = [text for p in parse.behaviour_of(c.source) if (text := BEHAVIOUR.get(p["pattern"])) and text not in old]
    if c.hint("behaviour"):
        new += [t for t in c.hints["behaviour", ""] if t not in old]
    return c.doc | {"description": "\n\n".join(filter(None, [old, " ".join(new)]))} if new else None


def add_example(c: Case) -> dict | None:
    return c.doc | {"examples": [c.hint("example") or suggestions.example_for(c.name, c.parameters)]}


GENERATORS: dict[str, Generator] = {
    "parameter_name_mismatch": rename, "parameter_missing": add_missing, "missing_params": add_missing, "parameter_count_mismatch": sync_all, "parameter_type_mismatch": retype, "type_mismatches": retype,
    "parameter_order_different": reorder, "undocumented_kwargs": add_missing, "default_mismatches": redefault, "return_type_mismatch": add_returns, "missing_returns": add_returns, "missing_raises": add_raises,
    "description_outdated": describe, "missing_examples": add_example, "example_invalid": add_example, "example_outdated": add_example, "example_incomplete": add_example,
}


def raise_conditions(source: str) -> dict[str, str]:
    """exception -> the condition of the ``if`` around its ``raise``, in words; the first counts."""
    func = parse.function_in(source)
    found: dict[str, str] = {}

    def go(node: ast.AST, test: ast.expr | None) -> None:
        for name, value in ast.iter_fields(node):
            for child in value if isinstance(value, list) else [value]:
                if not isinstance(child, ast.AST):
                    continue
                inner = test if not isinstance(node, ast.If) else node.test if name == "body" else None
                if isinstance(child, ast.Raise) and inner is not None:
                    e = child.exc.func if isinstance(child.exc, ast.Call) else child.exc
                    if isinstance(e, ast.Name):
                        found.setdefault(e.id, spoken(inner))
                go(child, inner)

    if func:
        go(func, None)
    return found


# Comparisons in words.
COMPARED = {ast.Lt: "is below", ast.LtE: "is at most", ast.Gt: "is above", ast.GtE: "is at least", ast.Eq: "is", ast.NotEq: "is not", ast.In: "is in", ast.NotIn: "is not in", ast.Is: "is", ast.IsNot: "is not"}


def spoken(test: ast.expr) -> str:
    """A condition in words, as far as it is a comparison or a negation."""
    if isinstance(test, ast.BoolOp):
        return (" and " if isinstance(test.op, ast.And) else " or ").join(map(spoken, test.values))
    if isinstance(test, ast.Compare) and len(test.ops) == 1:
        return f"{ast.unparse(test.left)} {COMPARED[type(test.ops[0])]} {ast.unparse(test.comparators[0])}"
    if isinstance(test, ast.UnaryOp) and isinstance(test.op, ast.Not):
        inner = test.operand
        if isinstance(inner, ast.Compare) and len(inner.ops) == 1:
            return f"not ({spoken(inner)})"
        return f"{ast.unparse(inner)} is empty or false" if isinstance(inner, (ast.Name, ast.Attribute)) else f"not {ast.unparse(inner)}"
    return f"{ast.unparse(test)} is set" if isinstance(test, (ast.Name, ast.Attribute)) else ast.unparse(test)


# What magic methods do, in a summary.
MAGIC = {"__init__": "Set the object up.", "__len__": "How many items there are.", "__str__": "The object as text.", "__repr__": "The object as code.", "__iter__": "Go over the items.", "__eq__": "Whether both are equal.", "__enter__": "Enter the context.", "__exit__": "Leave the context.", "__call__": "Call the object."}
# What a construct adds to a description.
CONSTRUCTS = {"property": "Read as an attribute.", "classmethod": "Called on the class.", "staticmethod": "Needs no object.", "contextmanager": "For use in a with statement.", "async": "Has to be awaited.", "generator": "Yields its items one by one.", "overload": "One of several signatures."}


def construct(c: Case) -> str | None:
    """What kind of special construct a function is, the most telling first."""
    has = lambda d: any(x.split("(")[0].split(".")[-1] == d for x in c.decorators)
    if has("property") or any(x.endswith((".setter", ".getter", ".deleter")) for x in c.decorators):
        return "property"
    for d in ("overload", "classmethod", "staticmethod"):
        if has(d):
            return d
    if has("contextmanager") or has("asynccontextmanager"):
        return "contextmanager"
    if c.name.startswith("__") and c.name.endswith("__"):
        return "magic"
    return None


def special(c: Case, registry: dict[str, Generator]) -> tuple[str, dict] | None:
    """Special constructs: the section that the finding is about is repaired as for any
    function, in the construct's own way; all that the documentation says otherwise stays.

    A property and an overload get no new parameters, and an example of a property reads it;
    a description says what the construct is; a magic method without a summary gets one."""
    kind = construct(c)
    if kind is None:
        return None
    about_parameters = registry.get(c.issue_type) in (add_missing, rename, retype, redefault, reorder, sync_all)
    if kind == "magic":
        doc = c.doc if c.doc["summary"] else c.doc | {"summary": MAGIC.get(c.name, f"Implement {c.name}.")}
        made = repaired(c, registry)
        return "magic", (made or c.doc) | {"summary": MAGIC.get(c.name, doc["summary"]) if not c.doc["summary"] or c.name in MAGIC and made is None else doc["summary"]}
    if kind == "property" and c.issue_type in ("missing_examples", "example_invalid", "example_outdated", "example_incomplete"):
        return kind, c.doc | {"examples": [f">>> obj.{c.name}"]}
    if kind in ("property", "overload") and about_parameters:
        return kind, c.doc
    if c.issue_type == "description_outdated":
        old = c.doc["description"] or ""
        said = (repaired(c, registry) or c.doc)["description"] or ""
        words = CONSTRUCTS[kind]
        return kind, c.doc | {"description": said if words in old else " ".join(filter(None, [said, words]))}
    doc = repaired(c, registry)
    return (kind, doc) if doc is not None and kind in ("property", "overload") else None


def repaired(c: Case, registry: dict[str, Generator]) -> dict | None:
    f = registry.get(c.issue_type)
    return f(c) if f else None


#: kind of generator -> confidence of what it makes.
CONFIDENCE = {"rename": 0.85, "add_missing": 0.9, "sync_all": 0.8, "retype": 0.9, "reorder": 0.95, "redefault": 0.9, "add_returns": 0.85, "add_raises": 0.85, "describe": 0.6, "add_example": 0.7, "property": 0.8, "overload": 0.8, "magic": 0.8, "classmethod": 0.8, "staticmethod": 0.8, "contextmanager": 0.8, "fallback": 0.3}


def made(c: Case, registry: dict[str, Generator], style: str, width: int) -> tuple[str, str, float, bool, str | None]:
    """(text, kind, confidence, ready, error). A generator that fails or has nothing to offer
    leaves a generic suggestion that is not ready to paste."""
    error = None
    try:
        found = special(c, registry)
        if found is None and c.issue_type in registry:
            f = registry[c.issue_type]
            doc = f(c)
            found = (getattr(f, "__name__", "custom"), doc) if doc is not None else None
        if found is not None:
            return docstrings.render(found[1], style, width), found[0], CONFIDENCE.get(found[0], 0.5), True, None
    except Exception as e:  # noqa: BLE001  a failing generator is data here
        error = f"{type(e).__name__}: {e}"
    return f"Review the documentation of {c.name}: {c.issue_type.replace('_', ' ')}.", "fallback", CONFIDENCE["fallback"], False, error


EMPTY = {"format": "google", "summary": "", "description": None, "parameters": [], "returns": None, "raises": [], "examples": []}
CASE = ("name", "parameters", "return_type", "exceptions", "decorators", "is_async", "doc", "source_code", "hints")


def _plain(x):
    """Rows of Arrow as plain records."""
    if isinstance(x, dict):
        return {k: _plain(v) for k, v in x.items()}
    if hasattr(x, "asDict"):
        return _plain(x.asDict())
    return x if isinstance(x, str) or not hasattr(x, "__iter__") else [_plain(v) for v in x]


def cases(functions: DataFrame) -> DataFrame:
    """functions (function columns, doc, exceptions, perhaps hints) with their row as ``case``."""
    if "hints" not in functions.columns:
        functions = functions.withColumn("hints", F.array().cast(HINT))
    return functions.withColumn("case", F.struct(*CASE))


def generate(findings: DataFrame, functions: DataFrame, style: str = "google", width: int = 88, registry: dict[str, Generator] | None = None) -> DataFrame:
    """findings (function_id, issue_type, subject, ...), functions (function columns, doc,
    exceptions, perhaps hints) -> the findings with what ``suggested`` adds."""
    return suggested(findings.join(cases(functions).select("function_id", "case"), "function_id").select(*findings.columns, "case"), style, width, registry)


def suggested(asked: DataFrame, style: str = "google", width: int = 88, registry: dict[str, Generator] | None = None) -> DataFrame:
    """asked (issue_type, subject, case, ...): findings that hold their function's row (see ``cases``) -> without it,
    but with suggested_text, kind, suggested_confidence, ready, error, diff, rag_enhanced: whether what examples
    say went into the text."""
    known = GENERATORS if registry is None else registry

    @F.pandas_udf("suggested_text string, kind string, suggested_confidence double, ready boolean, error string, diff string, rag_enhanced boolean")
    def run(issue: pd.Series, subject: pd.Series, name: pd.Series, params: pd.Series, ret: pd.Series, exceptions: pd.Series, decorators: pd.Series, is_async: pd.Series, doc: pd.DataFrame, source: pd.Series, hints: pd.Series) -> pd.DataFrame:
        docs = doc.to_dict("records")
        rows = []
        for i, s, n, p, r, e, d, a, o, src, h in zip(issue, subject, name, params, ret, exceptions, decorators, is_async, docs, source, hints, strict=True):
            old = _plain(o) if o.get("summary") is not None else EMPTY
            old = EMPTY | {k: v for k, v in old.items() if v is not None and v == v}
            said: dict = {}
            for x in _plain(h) if h is not None else ():
                said.setdefault((x["slot"], x["subject"]), []).append(x["text"])
            case = Case(i, s, n, _plain(p), r, _plain(e), _plain(d), bool(a), old, src or "", said)
            text, kind, confidence, ready, error = made(case, known, style, width)
            before = docstrings.render(old, style, width)
            rows.append((text, kind, confidence, ready, error, "\n".join(difflib.unified_diff(before.split("\n"), text.split("\n"), "before", "after", lineterm="")) if ready else None, ready and bool(case.used)))
        return pd.DataFrame(rows, columns=["suggested_text", "kind", "suggested_confidence", "ready", "error", "diff", "rag_enhanced"])

    # Not deterministic to the planner, which else evaluates it anew for filters and for each of its fields.
    out = asked.withColumn("suggested", run.asNondeterministic()("issue_type", "subject", *(f"case.{c}" for c in CASE)))
    return out.select(*(c for c in asked.columns if c != "case"), "suggested.*")
