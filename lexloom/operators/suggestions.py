"""Findings -> suggested documentation."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions._lift import arrow_function
from . import docstrings

SUGGESTION = "suggested_text string, kind string, confidence double, ready boolean"


def placeholder(name: str, kind: str | None) -> str:
    """A description of a parameter from its name and type."""
    words = name.strip("*/").replace("_", " ")
    if name.startswith("**"):
        return "Additional keyword arguments."
    if name.startswith("*"):
        return "Additional positional arguments."
    if (kind or "").startswith("bool"):
        return f"Whether to {words.removeprefix('is ').removeprefix('use ')}." if words else "Flag."
    return f"The {words}."


def value_of(kind: str | None) -> str:
    """A value of a type, for examples."""
    known = {"int": "1", "float": "1.0", "str": '"text"', "bool": "True", "bytes": 'b"data"'}
    base = (kind or "").replace("Optional[", "").rstrip("]").split("[")[0].lower()
    return known.get(base) or {"list": "[]", "dict": "{}", "set": "set()", "tuple": "()"}.get(base, "None")


def repaired(name: str, params: list[dict], return_type: str | None, exceptions: list[dict], raw: str | None) -> dict:
    """The documentation that a signature calls for, with what was said already kept."""
    old = docstrings.parse(raw) or {"format": "google", "summary": f"{name.replace('_', ' ').strip().capitalize()}.", "description": None, "parameters": [], "returns": None, "raises": [], "examples": []}
    told = {p["name"].strip("*"): p for p in old["parameters"]}
    params = [p for p in params if p["name"].strip("*/") not in ("self", "cls")]
    unused = [p for n, p in told.items() if n not in {q["name"].strip("*/") for q in params}]
    new = []
    for p in params:
        plain = p["name"].strip("*/")
        before = told.get(plain)
        if before is None and unused:  # a renamed one: the most alike by letters
            best = max(unused, key=lambda u: difflib.SequenceMatcher(None, u["name"], plain).ratio())
            if difflib.SequenceMatcher(None, best["name"], plain).ratio() > 0.6:
                before = best
                unused.remove(best)
        text = before["description"] if before and not docstrings.generic(before["description"]) else placeholder(p["name"], p["type_annotation"])
        new.append({"name": p["name"].rstrip("/"), "type_str": p["type_annotation"], "description": text, "is_optional": not p["is_required"], "default_value": p["default_value"]})
    returns = old["returns"]
    if return_type and return_type != "None":
        returns = {"type_str": return_type, "description": (returns or {}).get("description") or "The result."}
    known = {r["exception_type"] for r in old["raises"]}
    raises = old["raises"] + [{"exception_type": e["exception_type"], "description": e["description"]} for e in exceptions if e["confidence"] >= 0.8 and e["exception_type"] not in known]
    return old | {"parameters": new, "returns": returns, "raises": raises}


def example_for(name: str, params: list[dict]) -> str:
    needed = [p for p in params if p["is_required"] and p["name"].strip("*/") not in ("self", "cls") and not p["name"].startswith("*")]
    return f">>> {name}({', '.join(value_of(p['type_annotation']) for p in needed)})"


def suggest(pairs: DataFrame, style: str = "google", width: int = 88) -> DataFrame:
    """(function columns, exceptions) -> function_id, suggested_text, diff: one per function."""

    @F.pandas_udf("suggested_text string, diff string")
    def made(name: pd.Series, params: pd.Series, ret: pd.Series, exceptions: pd.Series, raw: pd.Series) -> pd.DataFrame:
        rows = []
        for n, p, r, e, d in zip(name, params, ret, exceptions, raw, strict=True):
            text = docstrings.render(repaired(n, list(p), r, list(e), d), style, width)
            rows.append((text, "\n".join(difflib.unified_diff((d or "").split("\n"), text.split("\n"), "before", "after", lineterm=""))))
        return pd.DataFrame(rows, columns=["suggested_text", "diff"])

    return pairs.select("function_id", made("name", "parameters", "return_type", "exceptions", "raw_doc").alias("s")).select("function_id", "s.*")


def line_changes(old: Column, new: Column) -> Column:
    """Lines of one text that the other doesn't have."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    return F.struct(F.filter(b, lambda x: ~F.array_contains(a, x)).alias("added"), F.filter(a, lambda x: ~F.array_contains(b, x)).alias("removed"))


def quality(confidence: Column, ready: Column, completeness: Column, style_ok: Column) -> Column:
    """The mean of four factors."""
    return (confidence + ready.cast("int") + completeness + style_ok.cast("int")) / 4


def reordered(documented: Column, signature: Column) -> Column:
    """Documented parameters in signature order; others after them in their own."""
    place = lambda p: F.when(F.array_position(signature, p["name"]) > 0, F.array_position(signature, p["name"])).otherwise(F.lit(1 << 30))
    keyed = F.transform(documented, lambda p, i: F.struct(place(p).alias("at"), i.alias("i"), p.alias("p")))
    return F.transform(F.array_sort(keyed), lambda x: x["p"])


def _ratio(x: str, y: str) -> float:
    """Twice the longest common subsequence over the total length (0 to 1)."""
    if not x and not y:
        return 1.0
    where: dict[str, int] = {}
    for i, c in enumerate(x):
        where[c] = where.get(c, 0) | 1 << i
    full = free = (1 << len(x)) - 1  # a cleared bit is a letter of x that the subsequence takes
    for c in y:
        hit = free & where.get(c, 0)
        free = (free + hit | free - hit) & full
    return 2 * (len(x) - free.bit_count()) / (len(x) + len(y))


def _token_set_ratio(x: str, y: str) -> float:
    """The best ratio among shared words, and shared with the rest of either; 1 if one
    side's words are all in the other's, 0 if a side has none."""
    a, b = set(x.split()), set(y.split())
    if not a or not b:
        return 0.0
    both = " ".join(sorted(a & b))
    if both and (not a - b or not b - a):
        return 1.0
    left, right = " ".join([both, *sorted(a - b)]).strip(), " ".join([both, *sorted(b - a)]).strip()
    return max([_ratio(left, right), *((_ratio(both, left), _ratio(both, right)) if both else ())])


@arrow_function("double")
def indel_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


@arrow_function("double")
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([_token_set_ratio(x or "", y or "") for x, y in zip(a, b, strict=True)])


def parameter_text(kind: Column, name: Column, expected: Column, actual: Column) -> Column:
    """What to do about a parameter, as one sentence."""
    return (
        F.when(kind == "parameter_missing", F.concat(F.lit("Add '"), name, F.lit("' to the documentation.")))
        .when(kind == "parameter_name_mismatch", F.concat(F.lit("Rename '"), actual, F.lit("' to '"), expected, F.lit("'.")))
        .when(kind == "parameter_type_mismatch", F.concat(F.lit("Change the type of '"), name, F.lit("' from '"), actual, F.lit("' to '"), expected, F.lit("'.")))
        .when(kind == "default_mismatches", F.concat(F.lit("Change the default of '"), name, F.lit("' from "), actual, F.lit(" to "), expected, F.lit(".")))
        .otherwise(F.concat(F.lit("Check '"), name, F.lit("'.")))
    )


def skeleton(name: Column, parameters: Column, return_type: Column) -> Column:
    """An empty documentation with a line for each parameter and the return value."""
    lines = F.transform(parameters, lambda p: F.concat(F.lit("    "), p["name"], F.when(p["type_annotation"].isNotNull(), F.concat(F.lit(" ("), p["type_annotation"], F.lit(")"))).otherwise(""), F.lit(": ")))
    args = F.when(F.size(parameters) > 0, F.concat(F.lit("\n\nArgs:\n"), F.array_join(lines, "\n"))).otherwise("")
    returns = F.when(F.coalesce(return_type, F.lit("None")) != "None", F.concat(F.lit("\n\nReturns:\n    "), return_type, F.lit(": "))).otherwise("")
    return F.concat(F.initcap(F.replace(name, F.lit("_"), F.lit(" "))), F.lit("."), args, returns)


def fenced(text: Column, language: str = "python") -> Column:
    return F.concat(F.lit(f"```{language}\n"), F.regexp_replace(text, r"\s+$", ""), F.lit("\n```"))


def keep_descriptions(old: Column, new: Column, is_generic) -> Column:
    """New parameters with the old descriptions where the new ones say nothing."""
    def kept(p: Column) -> Column:
        before = F.try_element_at(F.filter(old, lambda o: o["name"] == p["name"]), F.lit(-1))
        text = F.when(is_generic(p["description"]) & F.coalesce(before["description"].isNotNull(), F.lit(False)), before["description"]).otherwise(p["description"])
        return F.struct(p["name"].alias("name"), text.alias("description"))

    return F.transform(new, kept)
