"""Consistency rules: each maps a documented function to findings, as a column.

All enabled rules build one array in a single select; one explode makes rows of it. Nothing
is shuffled. Names are compared without ``*`` and ``/`` marks unless a rule says otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import ISSUE_SEVERITY, EngineConfig
from ..functions import types
from ..functions._lift import lookup

ISSUE = "struct<rule:string, issue_type:string, severity:string, description:string, suggestion:string, confidence:double, subject:string>"


def _issue(rule: str, kind: str, confidence: float, subject: Column, description: Column, suggestion: Column) -> Column:
    return F.struct(F.lit(rule).alias("rule"), F.lit(kind).alias("issue_type"), F.lit(ISSUE_SEVERITY[kind]).alias("severity"), description.alias("description"), suggestion.alias("suggestion"), F.lit(confidence).alias("confidence"), subject.alias("subject"))


def _none() -> Column:
    return F.array().cast(f"array<{ISSUE}>")


def bare(name: Column) -> Column:
    return F.regexp_replace(name, r"^\*+|/$", "")


def _own(params: str = "parameters") -> Column:
    """Without self and cls."""
    return F.filter(params, lambda p: ~bare(p["name"]).isin("self", "cls"))


def _names(params: Column, strip: bool = True) -> Column:
    return F.transform(params, lambda p: bare(p["name"]) if strip else p["name"])


_DOC_PARAMETERS = "array<struct<name:string, type_str:string, description:string, is_optional:boolean, default_value:string>>"


def _doc() -> Column:
    return F.coalesce(F.col("doc.parameters"), F.array().cast(_DOC_PARAMETERS))


def _return() -> Column:
    return F.coalesce(F.col("return_type"), F.lit(""))


say = F.concat


def parameter_names() -> Column:
    f, d = _names(_own()), _names(_doc())
    missing = F.array_sort(F.array_except(f, d))
    extra = F.array_sort(F.array_except(d, f))
    hint = F.when(F.size(f) > 0, say(F.lit(" Did you mean one of: "), F.array_join(F.array_sort(F.array_distinct(f)), ", "), F.lit("?"))).otherwise("")
    return F.concat(
        F.transform(missing, lambda n: _issue("parameter_names", "parameter_missing", 1.0, n, say(F.lit("Parameter '"), n, F.lit("' is not documented")), say(F.lit("Document '"), n, F.lit("'")))),
        F.transform(extra, lambda n: _issue("parameter_names", "parameter_name_mismatch", 0.95, n, say(F.lit("Parameter '"), n, F.lit("' is documented but not in the signature")), say(F.lit("Remove or rename '"), n, F.lit("'."), hint))),
    )


def _documented(p: Column) -> Column:
    """The documented parameter of the same exact name, the last if there are several."""
    return F.element_at(F.filter(_doc(), lambda d: d["name"] == p["name"]), -1)


def _paired(found: Callable[[Column, Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    both = F.transform(F.filter(_own(), lambda p: F.exists(_doc(), lambda d: d["name"] == p["name"])), lambda p: F.struct(p.alias("p"), _documented(p).alias("d")))
    return F.transform(F.filter(both, lambda x: F.coalesce(found(x["p"], x["d"]), F.lit(False))), lambda x: make(x["p"], x["d"]))


def parameter_types() -> Column:
    differ = lambda p, d: (F.coalesce(p["type_annotation"], F.lit("")) != "") & (F.coalesce(d["type_str"], F.lit("")) != "") & ~types.same(p["type_annotation"], d["type_str"])
    return _paired(differ, lambda p, d: _issue("parameter_types", "parameter_type_mismatch", 0.9, p["name"], say(F.lit("Parameter '"), p["name"], F.lit("' is '"), p["type_annotation"], F.lit("' but documented as '"), d["type_str"], F.lit("'")), say(F.lit("Change the documented type to '"), p["type_annotation"], F.lit("'"))))


def parameter_count() -> Column:
    n, m = F.size(_own()), F.size(_doc())
    one = _issue("parameter_count", "parameter_count_mismatch", 1.0, F.lit(None).cast("string"), say(n.cast("string"), F.lit(" parameters, "), m.cast("string"), F.lit(" documented")), say(F.lit("Document all "), n.cast("string"), F.lit(" parameters")))
    return F.when(n != m, F.array(one)).otherwise(_none())


def return_type() -> Column:
    doc = F.coalesce(F.col("doc.returns.type_str"), F.lit(""))
    missing = _issue("return_type", "missing_returns", 0.95, F.lit(None).cast("string"), say(F.lit("Returns '"), _return(), F.lit("' without a documented type")), say(F.lit("Add a Returns section for '"), _return(), F.lit("'")))
    wrong = _issue("return_type", "return_type_mismatch", 0.9, F.lit(None).cast("string"), say(F.lit("Returns '"), _return(), F.lit("' but documented as '"), doc, F.lit("'")), say(F.lit("Change the documented return type to '"), _return(), F.lit("'")))
    return F.when((_return() != "") & (_return() != "None") & (doc == ""), F.array(missing)).when((_return() != "") & (doc != "") & ~types.same(_return(), doc), F.array(wrong)).otherwise(_none())


def missing_params() -> Column:
    d = _names(_doc())
    lost = F.filter(_own(), lambda p: ~F.array_contains(d, bare(p["name"])))
    return F.transform(lost, lambda p: _issue("missing_params", "missing_params", 1.0, p["name"], say(F.lit("Parameter '"), p["name"], F.lit("' is not documented")), say(F.lit("Add '"), p["name"], F.when(p["type_annotation"].isNotNull(), say(F.lit(" ("), p["type_annotation"], F.lit(")"))).otherwise(""), F.lit("' to the parameters"))))


def missing_returns() -> Column:
    one = _issue("missing_returns", "missing_returns", 0.95, F.lit(None).cast("string"), F.lit("Return value is not documented"), say(F.lit("Add a Returns section: "), _return()))
    return F.when((_return() != "") & (_return() != "None") & F.col("doc.returns").isNull(), F.array(one)).otherwise(_none())


def missing_raises(least: float = 0.8) -> Column:
    sure = F.transform(F.filter("exceptions", lambda e: e["confidence"] >= least), lambda e: e["exception_type"])
    told = F.coalesce(F.transform("doc.raises", lambda r: r["exception_type"]), F.array().cast("array<string>"))
    lost = F.array_sort(F.array_except(sure, told))
    one = _issue("missing_raises", "missing_raises", 0.9, F.array_join(lost, ","), say(F.lit("Raises without documentation: "), F.array_join(lost, ", ")), say(F.lit("Add a Raises section for "), F.array_join(lost, ", ")))
    return F.when(F.size(lost) > 0, F.array(one)).otherwise(_none())


def undocumented_kwargs() -> Column:
    d = _names(_doc(), strip=False)
    lost = F.filter(_own(), lambda p: p["name"].startswith("*") & ~F.array_contains(d, p["name"]))
    return F.transform(lost, lambda p: _issue("undocumented_kwargs", "undocumented_kwargs", 1.0, p["name"], say(F.lit("'"), p["name"], F.lit("' is not documented")), say(F.lit("Document '"), p["name"], F.lit("'"))))


def default_mismatches() -> Column:
    differ = lambda p, d: (F.coalesce(p["default_value"], F.lit("")) != "") & (F.coalesce(d["default_value"], F.lit("")) != "") & (p["default_value"] != d["default_value"])
    return _paired(differ, lambda p, d: _issue("default_mismatches", "default_mismatches", 0.9, p["name"], say(F.lit("'"), p["name"], F.lit("' defaults to "), p["default_value"], F.lit(", documented as "), d["default_value"]), say(F.lit("Change the documented default to "), p["default_value"])))


def parameter_order() -> Column:
    f, d = _names(_own(), strip=False), _names(_doc(), strip=False)
    a, b = F.filter(f, lambda n: F.array_contains(d, n)), F.filter(d, lambda n: F.array_contains(f, n))
    one = _issue("parameter_order", "parameter_order_different", 0.8, F.array_join(a, ","), F.lit("Parameters are documented in another order"), say(F.lit("Reorder them: "), F.array_join(a, ", ")))
    return F.when((F.size(F.array_distinct(a)) > 1) & (a != b), F.array(one)).otherwise(_none())


def optional_parameters() -> Column:
    wrong = F.filter(_own(), lambda p: F.coalesce(F.lower(p["default_value"]).isin("none", "null") & (p["type_annotation"] != "") & ~types.is_optional(p["type_annotation"]), F.lit(False)))
    return F.transform(wrong, lambda p: _issue("optional_parameters", "parameter_type_mismatch", 0.85, p["name"], say(F.lit("'"), p["name"], F.lit("' defaults to None but isn't Optional")), say(F.lit("Annotate it as Optional["), p["type_annotation"], F.lit("]"))))


def method_decorators() -> Column:
    one = _issue("method_decorators", "parameter_name_mismatch", 0.7, F.lit("cls"), F.lit("Uses 'cls', which suggests a class method"), F.lit("Check for the @classmethod decorator"))
    return F.when(F.exists("parameters", lambda p: bare(p["name"]) == "cls") & (F.size("parameters") > 1), F.array(one)).otherwise(_none())


#: The registry: name -> column. A caller may add rules of the same type.
RULES: dict[str, Callable[[], Column]] = {
    f.__name__: f for f in (parameter_names, parameter_types, parameter_count, return_type, missing_params, missing_returns, missing_raises, undocumented_kwargs, default_mismatches, parameter_order, optional_parameters, method_decorators)
}


def effective(config: EngineConfig) -> list[str]:
    return [r for r in (config.enabled_rules or tuple(RULES)) if r not in config.disabled_rules]


def check(pairs: DataFrame, config: EngineConfig = EngineConfig()) -> DataFrame:
    """(function columns, doc struct, exceptions array) -> one row per finding with its
    ordinal; functions without documentation give none. Severity overrides hold for all rules."""
    names = effective(config)
    found = F.concat(*(RULES[r]() for r in names)) if names else _none()
    rows = pairs.where("doc is not null").select("function_id", "file_path", "line_number", F.posexplode(found).alias("ordinal", "i")).select("function_id", "file_path", "line_number", "ordinal", "i.*")
    if config.severity_overrides:
        rows = rows.withColumn("severity", F.coalesce(lookup(F.col("issue_type"), config.severity_overrides), F.col("severity")))
    return rows


def marked_parameters() -> Column:
    """Findings beyond the twelve: ``*`` and ``**`` without their marks in the documentation,
    and parameters that may be None documented as required."""
    d = _doc()
    unmarked = F.filter("parameters", lambda p: p["name"].startswith("*") & F.exists(d, lambda x: x["name"] == bare(p["name"])))
    needed = F.filter("parameters", lambda p: F.coalesce(types.is_optional(p["type_annotation"]), F.lit(False)) & F.exists(d, lambda x: (x["name"] == p["name"]) & ~x["is_optional"] & ~F.coalesce(types.is_optional(x["type_str"]), F.lit(False))))
    say_ = lambda kind: lambda p: F.struct(F.lit(kind).alias("kind"), p["name"].alias("subject"))
    return F.concat(F.transform(unmarked, say_("marks missing")), F.transform(needed, say_("optional told as required")))


def coverage() -> Column:
    """struct of a function's documented, missing and extra parameters and the percentage."""
    f, d = F.array_distinct(_names(_own())), F.array_distinct(_names(_doc()))
    both = F.size(F.array_intersect(f, d))
    return F.struct(F.size(f).alias("parameters"), both.alias("documented"), F.array_sort(F.array_except(f, d)).alias("missing"), F.array_sort(F.array_except(d, f)).alias("extra"), F.when(F.size(f) == 0, 100.0).otherwise(F.round(both / F.size(f) * 100, 1)).alias("percent"))


def doc_quality() -> Column:
    """1 - 0.1 for each missing, 0.05 for each extra parameter, 0.1 without return, clipped."""
    f, d = F.array_distinct(_names(F.col("parameters"), False)), F.array_distinct(_names(_doc(), False))
    params = F.when(F.size(d) > 0, 0.1 * F.size(F.array_except(f, d)) + 0.05 * F.size(F.array_except(d, f))).otherwise(0.0)
    return F.greatest(F.lit(0.0), F.lit(1.0) - params - F.when((_return() != "") & F.col("doc.returns").isNull(), 0.1).otherwise(0.0))


def signature_similarity() -> Column:
    """Jaccard of signature and documented names; one side empty 0.5, both or no documentation 1."""
    f, d = _names(F.col("parameters"), False), _names(_doc(), False)
    from ..functions._lift import jaccard

    return F.when(F.col("doc").isNull(), 1.0).otherwise(jaccard(f, d, 1.0, 0.5))
