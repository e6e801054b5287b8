"""Type annotations as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import any_of, bound, col

# Names of types in documentation and what they are called in code.
SPELLINGS = {"string": "str", "integer": "int", "boolean": "bool", "float": "float", "list": "List", "dict": "Dict", "tuple": "Tuple", "set": "Set"}


def normalise(t) -> Column:
    """Canonical spelling; ``X | None`` and ``Union[X, None]`` become ``Optional[X]``."""
    out = F.trim(F.coalesce(col(t), F.lit("")))
    for old, new in SPELLINGS.items():
        out = F.regexp_replace(out, rf"(?i)\b{old}\b", new)
    out = F.regexp_replace(out, r"\bUnion\[([^,]+),\s*None\]", r"Optional[$1]")
    return F.regexp_replace(out, r"\b(\w+)\s*\|\s*None\b", r"Optional[$1]")


def same(a, b) -> Column:
    """Whether two types are equivalent; a missing type equals only a missing one."""
    x, y = F.coalesce(col(a), F.lit("")), F.coalesce(col(b), F.lit(""))
    p, q = normalise(x), normalise(y)
    opened = lambda t: F.concat(F.replace(F.replace(t, F.lit("Optional["), F.lit("")), F.lit("]"), F.lit("")), F.lit(" | None"))
    return F.when((x == "") | (y == ""), x == y).otherwise((F.lower(p) == F.lower(q)) | (opened(p) == q) | (p == opened(q)))


def base(t) -> Column:
    """What an Optional or container is of; of a Dict both parts."""
    n = normalise(t)
    inner = F.regexp_extract(n, r"^(?:List|Set|Tuple)\[(.+)\]", 1)
    return (
        F.when(n.rlike(r"^Optional\[.+\]"), F.regexp_extract(n, r"^Optional\[(.+)\]", 1))
        .when(inner != "", F.trim(F.get(F.split(inner, ","), F.lit(0))))
        .when(n.rlike(r"^Dict\[.+\]"), F.regexp_extract(n, r"^Dict\[(.+)\]", 1))
        .otherwise(n)
    )


# Types that count as the same, and related ones, in retrieval.
ALIKE = (("str", "string"), ("int", "integer"), ("bool", "boolean"), ("dict", "dictionary", "mapping"), ("list", "array", "sequence"), ("float", "number", "double"), ("none", "null", "nonetype"))
RELATED = (("int", "float"), ("list", "sequence"), ("dict", "mapping"), ("str", "any"), ("int", "any"), ("float", "any"))


def plain(t) -> Column:
    """Lower case without quotes; ``Optional[x]`` as ``x | none``."""
    n = F.regexp_replace(F.lower(F.trim(F.coalesce(col(t), F.lit("")))), "[\"']", "")
    return F.when(n.rlike(r"^optional\[.*\]$"), F.concat(F.regexp_extract(n, r"^optional\[(.*)\]$", 1), F.lit(" | none"))).otherwise(n)


def compatibility(a, b) -> Column:
    """1 for types that are alike, 0.5 for related ones, else 0."""
    x, y = plain(a), plain(b)
    both_none = F.contains(x, F.lit("| none")) & F.contains(y, F.lit("| none"))
    bare = lambda t: F.trim(F.replace(t, F.lit("| none"), F.lit("")))

    def alike(p: Column, q: Column) -> Column:
        out = p == q
        for group in ALIKE:
            out = out | (p.isin(*group) & q.isin(*group))
        return out

    related = F.lit(False)
    for p, q in RELATED:
        related = related | ((x == p) & (y == q)) | ((x == q) & (y == p))
    root = lambda t: F.substring_index(t, "[", 1)
    related = related | ((root(x) == root(y)) & (x != y))
    return F.when(alike(x, y) | (both_none & alike(bare(x), bare(y))), 1.0).when(related, 0.5).otherwise(0.0)


def family_similarity(a, b) -> Column:
    """0.9 in one family, 0.8 where one names the other, 1 if equal, else 0 (0.6 for numbers)."""
    x, y = F.lower(F.coalesce(col(a), F.lit(""))), F.lower(F.coalesce(col(b), F.lit("")))
    families = (("str", "string", "text"), ("int", "integer"), ("float", "double", "decimal"), ("list", "array", "sequence"), ("dict", "mapping", "map"), ("bool", "boolean"))
    one = F.lit(False)
    for f in families:
        one = one | (x.isin(*f) & y.isin(*f))
    numbers = ("int", "integer", "float", "double", "decimal", "number")
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(one, 0.9).when(F.contains(x, y) | F.contains(y, x), 0.8).when(x.isin(*numbers) & y.isin(*numbers), 0.6).otherwise(0.0)


def complexity(t) -> Column:
    """simple, optional, union, generic or nested."""
    n = normalise(t)
    depth = F.length(n) - F.length(F.replace(n, F.lit("["), F.lit("")))
    return F.when(depth >= 2, "nested").when(n.startswith("Optional["), "optional").when(n.startswith("Union[") | F.contains(n, F.lit("|")), "union").when(depth == 1, "generic").otherwise("simple")


def for_style(t, style: str) -> Column:
    """As a documentation style writes a type: optional ones with a word, unions with or."""
    n = normalise(t)
    inner = F.regexp_extract(n, r"^Optional\[(.+)\]$", 1)
    union = F.regexp_extract(n, r"^Union\[(.+)\]$", 1)
    low = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\bList\b", "list"), r"\bDict\b", "dict"), r"\bTuple\b", "tuple")
    tail = {"google": ", optional", "numpy": ", optional", "sphinx": " or None", "rest": " or None"}[style]
    either = lambda x: F.regexp_replace(x, r"\s*[,|]\s*", " or ")
    return low(F.when(inner != "", F.concat(inner, F.lit(tail))).when(union != "", either(union)).when(F.contains(n, F.lit("|")), either(n)).otherwise(n))


def is_optional(t) -> Column:
    low = F.lower(F.coalesce(col(t), F.lit("")))
    return any_of(low, ("optional", "| none"))


def features(t) -> Column:
    """What ``compatibility`` looks at in a type, to be computed once for each side of many pairs."""

    def group(c: Column) -> Column:
        out = c
        for g in ALIKE:
            out = F.when(c.isin(*g), F.lit(g[0])).otherwise(out)
        return out

    both = bound(plain(t), lambda x: F.struct(x.alias("x"), F.trim(F.replace(x, F.lit("| none"), F.lit(""))).alias("bare")))
    return bound(both, lambda v: F.struct(v["x"].alias("x"), group(v["x"]).alias("group"), group(v["bare"]).alias("bare"), F.contains(v["x"], F.lit("| none")).alias("none"), F.substring_index(v["x"], "[", 1).alias("root")))


def compatible(a: Column, b: Column) -> Column:
    """As ``compatibility``, of features."""
    pair = F.concat(a["x"], F.lit("~"), b["x"])
    related = pair.isin(*(f"{p}~{q}" for x, y in RELATED for p, q in ((x, y), (y, x)))) | ((a["root"] == b["root"]) & (a["x"] != b["x"]))
    return F.when((a["group"] == b["group"]) | (a["none"] & b["none"] & (a["bare"] == b["bare"])), 1.0).when(related, 0.5).otherwise(0.0)
