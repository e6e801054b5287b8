"""Names: tokens, patterns and similarities. All expressions stay in the JVM."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import col, jaccard, lit_list

#: Fixed: what a camel-case token is; digits fall out where letters are.
TOKEN = r"[A-Z]?[a-z]+|[A-Z]+(?=[A-Z][a-z]|\b)"


def tokens(name) -> Column:
    """Lower-case tokens of a snake- or camel-case name, in order."""
    parts = F.transform(F.split(col(name), "_"), lambda p: F.when(F.size(F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0))) > 0, F.regexp_extract_all(p, F.lit(TOKEN), F.lit(0))).otherwise(F.array(p)))
    return F.filter(F.transform(F.flatten(parts), F.lower), lambda t: t != "")


def token_similarity(a, b) -> Column:
    """Jaccard of two token arrays; two empty ones are alike, one is not like any other."""
    return jaccard(col(a), col(b), both_empty=1.0, one_empty=0.0)


def character_similarity(a, b) -> Column:
    """1 if equal, 0.8 if one contains the other, else the Jaccard of their characters."""
    x, y = F.lower(col(a)), F.lower(col(b))
    chars = lambda s: F.array_distinct(F.split(s, ""))
    return (
        F.when(x == y, 1.0)
        .when((x == "") | (y == ""), 0.0)
        .when(F.contains(x, y) | F.contains(y, x), 0.8)
        .otherwise(jaccard(F.filter(chars(x), lambda c: c != ""), F.filter(chars(y), lambda c: c != ""), 1.0, 0.0))
    )


def prefix_similarity(a, b) -> Column:
    """Length of the common prefix over the mean length, ignoring case."""
    x, y = F.lower(col(a)), F.lower(col(b))
    n = F.least(F.length(x), F.length(y))
    same = F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct((s["n"] + (s["on"] & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1)))).cast("int")).alias("n"), (s["on"] & (F.substr(x, i, F.lit(1)) == F.substr(y, i, F.lit(1)))).alias("on")),
        lambda s: s["n"],
    )
    total = F.length(x) + F.length(y)
    return F.when(x == y, 1.0).when(total > 0, same / (total / 2)).otherwise(0.0)


# Name changes that keep the meaning, as (affix, replacement).
PREFIX_CHANGES = (("get_", "fetch_"), ("set_", "update_"), ("create_", "make_"), ("delete_", "remove_"), ("build_", "construct_"), ("init_", "initialize_"))
SUFFIX_CHANGES = (("_id", "_identifier"), ("_dict", "_map"), ("_list", "_array"), ("_str", "_string"), ("_num", "_number"), ("_config", "_configuration"), ("_info", "_information"), ("_data", "_dataset"), ("_proc", "_process"))


def pattern_images(name) -> Column:
    """The names that a usual change makes of a name."""
    n = F.lower(col(name))
    made = [F.when(n.startswith(a) & (F.length(n) > len(a)), F.concat(F.lit(b), F.substr(n, F.lit(len(a) + 1)))) for a, b in PREFIX_CHANGES]
    made += [F.when(n.endswith(a) & (F.length(n) > len(a)), F.concat(F.left(n, F.length(n) - len(a)), F.lit(b))) for a, b in SUFFIX_CHANGES]
    return F.array_compact(F.array(*made))


def snake(name) -> Column:
    return F.lower(F.regexp_replace(col(name), "([a-z0-9])([A-Z])", "$1_$2"))


def follows_pattern(a, b) -> Column:
    """Whether a usual change, or only camel or snake case, separates two names."""
    x, y = F.lower(col(a)), F.lower(col(b))
    return F.array_contains(pattern_images(a), y) | F.array_contains(pattern_images(b), x) | (snake(a) == y) | (snake(b) == x)


def module_distance(a, b) -> Column:
    """Levels of two dotted paths outside their common prefix."""
    x, y = F.split(col(a), r"\."), F.split(col(b), r"\.")
    return F.size(x) + F.size(y) - 2 * common_levels(x, y)


def common_levels(x: Column, y: Column) -> Column:
    """The length of the common prefix of two arrays."""
    n = F.least(F.size(x), F.size(y))
    diff = F.filter(F.sequence(F.lit(1), n), lambda i: ~F.element_at(x, i).eqNullSafe(F.element_at(y, i)))
    return F.when(n > 0, F.coalesce(F.array_min(diff) - 1, n)).otherwise(0)


def module_of(path) -> Column:
    """pkg/mod.py -> pkg.mod; a package's __init__ is the package."""
    p = F.regexp_replace(F.translate(col(path), "\\/", ".."), r"\.py$", "")
    return F.regexp_replace(p, r"\.?__init__$", "")


def module_context(path, module) -> Column:
    """1 where one module's path is the beginning of the other's, 0.5 in the same top package, else 0."""
    x, y = F.split(module_of(path), r"\."), F.split(F.coalesce(col(module), F.lit("")), r"\.")
    shared = common_levels(x, y)
    return F.when((shared == F.size(x)) | (shared == F.size(y)), 1.0).when((F.size(x) >= 2) & (F.size(y) >= 2) & (shared >= 1), 0.5).otherwise(0.0)


# Verbs that mean the same.
VERBS = {
    "get": ("fetch", "retrieve", "obtain", "find", "load"),
    "set": ("update", "modify", "change", "assign"),
    "create": ("make", "build", "generate", "construct", "init"),
    "delete": ("remove", "drop", "destroy", "clear"),
    "check": ("verify", "validate", "test", "ensure"),
    "calculate": ("compute", "determine", "evaluate"),
    "parse": ("process", "analyze", "interpret"),
    "save": ("store", "persist", "write"),
    "load": ("read", "fetch", "get", "retrieve"),
}


def verb_groups(verb: Column) -> Column:
    """The groups that a verb is in."""
    return F.array_compact(F.array(*(F.when(verb.isin(base, *more), base) for base, more in VERBS.items())))


def synonymous(a: Column, b: Column) -> Column:
    """Whether two verbs share a group (not merely both being its name)."""
    return F.arrays_overlap(verb_groups(a), verb_groups(b)) & ((a != b) | F.exists(lit_list([v for more in VERBS.values() for v in more]), lambda v: v == a))


def synonyms(a: str, b: str) -> bool:
    """As ``synonymous``, of two verbs as text."""
    groups = lambda v: {base for base, more in VERBS.items() if v == base or v in more}
    return bool(groups(a) & groups(b)) and (a != b or any(a in more for more in VERBS.values()))


def semantic_similarity(a, b, ratio: Column) -> Column:
    """1 if equal; 0.8 and up if the first tokens are synonyms; else the given ratio."""
    x, y = tokens(a), tokens(b)
    rest = lambda t: F.slice(t, 2, F.greatest(F.size(t), F.lit(1)))
    both = (F.size(x) > 0) & (F.size(y) > 0)
    return F.when(col(a) == col(b), 1.0).when(both & synonymous(F.get(x, F.lit(0)), F.get(y, F.lit(0))), 0.8 + 0.2 * token_similarity(rest(x), rest(y))).otherwise(ratio)


def unlike(name, patterns: Mapping[str, str]) -> Column:
    """The kinds of patterns that the whole of a name doesn't match, sorted; a null name matches none."""
    bad = [F.when(~F.coalesce(col(name).rlike(f"^(?:{p})$"), F.lit(False)), kind) for kind, p in sorted(patterns.items())]
    return F.array_compact(F.array(*bad)) if bad else F.array().cast("array<string>")


def features(name) -> Column:
    """What ``semantic_similarity`` looks at in a name, to be computed once for each side of many pairs."""
    t = tokens(name)
    first = F.get(t, F.lit(0))
    verbs = lit_list([v for more in VERBS.values() for v in more])
    return F.struct(col(name).alias("name"), F.slice(t, 2, F.greatest(F.size(t), F.lit(1))).alias("rest"), first.alias("first"), verb_groups(first).alias("groups"), F.array_contains(verbs, first).alias("listed"))


def similar(a: Column, b: Column, ratio: Column) -> Column:
    """As ``semantic_similarity``, of features."""
    synonyms = F.coalesce(F.arrays_overlap(a["groups"], b["groups"]) & ((a["first"] != b["first"]) | a["listed"]), F.lit(False))
    return F.when(a["name"] == b["name"], 1.0).when(synonyms, 0.8 + 0.2 * token_similarity(a["rest"], b["rest"])).otherwise(ratio)
