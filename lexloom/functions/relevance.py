"""What names of parameters, exceptions and functions say about each other."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ._lift import any_of, bound, col, jaccard, lookup

# Parameter names that mean the same.
SYNONYMS = (
    ("msg", "message"), ("val", "value"), ("param", "parameter"), ("config", "configuration"), ("cfg", "config"), ("dir", "directory"), ("func", "function"), ("fn", "function"), ("cb", "callback"), ("idx", "index"),
    ("num", "number"), ("str", "string"), ("dict", "dictionary"), ("obj", "object"), ("req", "request"), ("res", "response"), ("resp", "response"), ("err", "error"), ("exc", "exception"), ("ref", "reference"),
    ("impl", "implementation"), ("mgr", "manager"), ("conn", "connection"), ("src", "source"), ("dst", "destination"), ("dest", "destination"), ("args", "arguments"), ("kwargs", "keyword_arguments"), ("opts", "options"),
    ("env", "environment"), ("ctx", "context"), ("auth", "authentication"), ("id", "identifier"), ("uid", "user_id"), ("pwd", "password"), ("addr", "address"), ("desc", "description"), ("max", "maximum"), ("min", "minimum"),
    ("tmp", "temporary"), ("temp", "temporary"), ("proc", "process"), ("db", "database"), ("query", "search"), ("find", "search"), ("lookup", "search"), ("content", "text"), ("data", "content"), ("info", "information"),
    ("stats", "statistics"), ("file", "path"), ("filepath", "path"), ("filename", "name"), ("uri", "url"), ("endpoint", "url"), ("api_url", "endpoint"), ("count", "number"), ("amount", "number"), ("total", "sum"),
    ("enable", "activate"), ("disable", "deactivate"), ("start", "begin"), ("stop", "end"), ("create", "make"), ("delete", "remove"), ("update", "modify"), ("fetch", "get"), ("retrieve", "get"), ("store", "save"),
    ("load", "read"), ("write", "save"),
)


def parameter_similarity(a, b) -> Column:
    """1 equal, 0.8 one in the other or a synonym as a word, 0.7 as a part, up to 0.6 by
    shared words, up to 0.4 by letters."""
    x, y = (F.replace(F.lower(col(c)), F.lit("_"), F.lit(" ")) for c in (a, b))
    return bound(F.struct(x.alias("x"), y.alias("y"), F.split(x, " ").alias("p"), F.split(y, " ").alias("q")), lambda v: _alike(v["x"], v["y"], v["p"], v["q"]))


def _alike(x: Column, y: Column, p: Column, q: Column) -> Column:
    """Of two names in lower case and their words."""
    # A table that is looked through, not a condition for each pair: those would be compiled one by one.
    pairs = F.array(*(F.struct(F.lit(s.replace("_", " ")).alias("s"), F.lit(t.replace("_", " ")).alias("t")) for s, t in SYNONYMS))
    word = F.exists(pairs, lambda m: (F.array_contains(p, m["s"]) & F.array_contains(q, m["t"])) | (F.array_contains(p, m["t"]) & F.array_contains(q, m["s"])))
    part = F.exists(pairs, lambda m: (F.contains(x, m["s"]) & F.contains(y, m["t"])) | (F.contains(x, m["t"]) & F.contains(y, m["s"])))
    shared = F.size(F.array_intersect(p, q)) / F.greatest(F.size(F.array_distinct(p)), F.size(F.array_distinct(q)))
    letters = jaccard(F.filter(F.split(x, ""), lambda c: c != ""), F.filter(F.split(y, ""), lambda c: c != ""), 0.0, 0.0)
    return F.when(x == y, 1.0).when(F.contains(x, y) | F.contains(y, x), 0.8).when(word, 0.8).when(part, 0.7).when(shared > 0, F.least(F.lit(0.6), shared)).otherwise(F.least(F.lit(0.4), letters))


# Kinds of exceptions that go together.
EXCEPTION_FAMILIES = (("value", "validation", "invalid"), ("key", "lookup", "notfound"), ("type", "typeof", "cast"), ("io", "file", "os"), ("connection", "network", "socket"), ("permission", "access", "auth"), ("timeout", "deadline", "expired"))


def exceptions_match(a, b) -> Column:
    x, y = (F.trim(F.regexp_replace(F.lower(col(c)), "error|exception", "")) for c in (a, b))
    one = F.lit(False)
    for f in EXCEPTION_FAMILIES:
        one = one | (x.isin(*f) & y.isin(*f))
    return (col(a) == col(b)) | (x == y) | one | F.contains(x, y) | F.contains(y, x)


# Words of a function's name for which an exception is plausible, and exceptions that always are.
NETWORK = ("fetch", "request", "send", "connect", "download", "upload", "api", "http", "transaction", "payment")
PAYMENT = ("payment", "transaction", "process", "charge", "billing", "purchase", "order")
ACCESS = ("auth", "login", "verify", "permission", "access", "security")
CHECKS = ("validate", "check", "verify", "parse", "process", "handle")
COMMON = ("ValueError", "TypeError", "RuntimeError", "IOError", "KeyError", "AttributeError", "NotImplementedError")


def exception_relevant(exception, function_name, parameter_names) -> Column:
    e, name = col(exception), F.lower(col(function_name))
    low = F.lower(e)
    return (
        F.when(e == "TimeoutError", F.exists(col(parameter_names), lambda p: F.contains(F.lower(p), F.lit("timeout"))))
        .when(e == "NetworkError", any_of(name, NETWORK))
        .when(any_of(low, ("payment", "transaction")), any_of(name, PAYMENT))
        .when(any_of(low, ("auth", "permission")), any_of(name, ACCESS))
        .when(any_of(low, ("validation", "invalid")), any_of(name, CHECKS))
        .otherwise(e.isin(*COMMON))
    )


# What a word of a name says that a function is for; the first that occurs counts.
PURPOSES = {
    "get": "Retrieves and returns data",
    "set": "Sets or updates data values",
    "create": "Creates new objects or data structures",
    "build": "Constructs complex objects or structures",
    "calculate": "Performs mathematical calculations",
    "compute": "Computes results from input data",
    "process": "Processes input data through a series of operations",
    "transform": "Transforms data from one format to another",
    "convert": "Converts data between different types or formats",
    "validate": "Validates data against specified criteria",
    "check": "Checks conditions or data integrity",
    "verify": "Verifies data correctness or conditions",
    "parse": "Parses structured data or text",
    "format": "Formats data for display or output",
    "serialize": "Serializes data for storage or transmission",
    "deserialize": "Deserializes data from storage format",
    "load": "Loads data from external sources",
    "save": "Saves data to external storage",
    "update": "Updates existing data or state",
    "delete": "Removes or deletes data",
    "find": "Searches for and locates specific data",
    "search": "Searches through data collections",
    "filter": "Filters data based on criteria",
    "sort": "Sorts data in a specific order",
}


def purpose(name) -> Column:
    found = F.filter(F.array(*map(F.lit, PURPOSES)), lambda k: F.contains(F.lower(col(name)), k))
    return lookup(F.get(found, F.lit(0)), PURPOSES)


def example_profile(text) -> Column:
    """struct of an example's setup lines, calls, assertions, features and complexity."""
    lines = F.filter(F.transform(F.split(F.trim(F.coalesce(col(text), F.lit(""))), "\n"), F.trim), lambda x: (x != "") & ~x.startswith("#"))
    called = lambda x: F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))
    assigned = lambda x: F.contains(x, F.lit("=")) & ~F.contains(x, F.lit("==")) & ~F.contains(x, F.lit("!="))
    kind = F.transform(lines, lambda x: F.when(x.rlike("import|from"), "setup").when(assigned(x), F.when(called(x), "call").otherwise("setup")).when(x.rlike("^(assert|print)"), "assertion").when(called(x), "call").otherwise("other"))
    n = lambda k: F.size(F.filter(kind, lambda x: x == k))
    features = F.array_compact(F.array(*(F.when(F.exists(lines, _has(w)), f) for w, f in (("await", "async"), ("yield", "generator"), ("lambda", "lambda")))))
    total = n("setup") + n("call") + n("assertion")
    return F.struct(
        n("setup").alias("setup"), n("call").alias("calls"), n("assertion").alias("assertions"), features.alias("features"),
        F.when((total > 10) | (F.size(features) > 2), "advanced").when((total > 5) | (F.size(features) > 0), "intermediate").otherwise("basic").alias("complexity"),
    )


def _has(word: str):
    return lambda x: F.contains(x, F.lit(word))


def resolved_import(source, level, module) -> Column:
    """The absolute module of a relative import; null beyond the top package."""
    parts = F.split(col(module), r"\.")
    base = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - col(level), F.lit(0)))
    tail = F.when(F.coalesce(col(source), F.lit("")) != "", F.array(col(source))).otherwise(F.array().cast("array<string>"))
    name = F.array_join(F.concat(base, tail), ".")
    return F.when(col(level) == 0, col(source)).when(col(level) > F.size(parts), F.lit(None)).otherwise(F.nullif(name, F.lit("")))
