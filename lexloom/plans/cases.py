"""Column functions over stated cases, each repeated for every region: what a case gives is
told by hand."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import docs, json_text, names, relevance, scores, types
from ..functions._lift import lookup
from ..operators import docstrings, matching, routing, rules, simulation, suggestions, validation
from ..sources import python_files, stores
from .register import query, table
from .told import literal


def cases(spark, sf_dir, columns: str, rows: list[tuple]):
    """region x the rows, as columns r and the named ones."""
    cols = columns.split()
    at = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(cols, r, strict=True))) for r in rows))
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), F.inline(at)).toDF("r", *cols)


def told(columns: str, rows: list[tuple]) -> str:
    cols = columns.split()
    return f"select r_regionkey as r, t.* from region, (values {', '.join('(' + ', '.join(map(literal, r)) + ')' for r in rows)}) as t({', '.join(cols)})"


def keyed(spark, sf_dir, columns: str, rows: list[tuple]):
    """Each part with the case that its key picks, as columns r and the named ones; {n} in text is the part's name."""
    cols = columns.split()
    k = F.col("p_partkey")
    at = lambda i: lookup(k % len(rows), {n: r[i] for n, r in enumerate(rows)})
    fill = lambda i: F.replace(at(i), F.lit("{n}"), F.col("p_name")) if any(isinstance(r[i], str) for r in rows) else at(i)
    return table(spark, sf_dir, "part").select(k.alias("r"), *(fill(i).alias(c) for i, c in enumerate(cols)))


def told_keyed(columns: str, rows: list[tuple]) -> str:
    cols = columns.split()
    texts = {c for i, c in enumerate(cols) if any(isinstance(r[i], str) for r in rows)}
    values = ", ".join(f"({', '.join(map(literal, (n, *r)))})" for n, r in enumerate(rows))
    return f"select p_partkey as r, {', '.join(f"replace({c}, '{{n}}', p_name) as {c}" if c in texts else c for c in cols)} from part join (values {values}) as t(_case, {', '.join(cols)}) on p_partkey % {len(rows)} = _case"


TYPES = [
    ("string", "str", True, "str", "simple", "str", "str"), ("Union[int, None]", "Optional[int]", True, "int", "optional", "int, optional", "int or None"), ("int | None", "Optional[int]", True, "int", "optional", "int, optional", "int or None"), ("list[str]", "List[str]", True, "str", "generic", "list[str]", "list[str]"),
    ("Dict[str, List[int]]", "Dict[str, List[int]]", True, "str, List[int]", "nested", "dict[str, list[int]]", "dict[str, list[int]]"), ("Union[int, str]", "Union[int, str]", True, "Union[int, str]", "union", "int or str", "int or str"), ("Box", "Box", True, "Box", "simple", "Box", "Box"), ("boolean", "bool", True, "bool", "simple", "bool", "bool"),
]


@query(told("t normal same base complexity google sphinx", TYPES))
def type_forms(spark, sf_dir):
    """Canonical spelling, equivalence with it, inner type, class, and how styles write it."""
    c = cases(spark, sf_dir, "t", [(t[0],) for t in TYPES])
    return c.select("r", "t", types.normalise("t").alias("normal"), types.same("t", types.normalise("t")).alias("same"), types.base("t").alias("base"), types.complexity("t").alias("complexity"), types.for_style("t", "google").alias("google"), types.for_style("t", "sphinx").alias("sphinx"))


PAIRS = [
    ("int", "integer", True, 1.0, 0.9), ("int", "float", False, 0.5, 0.6), ("str", "str", True, 1.0, 1.0), ("List[int]", "List[str]", False, 0.5, 0.0), ("Optional[int]", "Optional[integer]", True, 1.0, 0.0), ("str", "bytes", False, 0.0, 0.0), ("dict", "mapping", False, 1.0, 0.9), ("", "int", False, 0.0, 0.0),
]


@query(told("a b same compatible family", PAIRS))
def type_pairs(spark, sf_dir):
    c = cases(spark, sf_dir, "a b", [p[:2] for p in PAIRS])
    return c.select("r", "a", "b", types.same("a", "b").alias("same"), types.compatibility("a", "b").alias("compatible"), types.family_similarity("a", "b").alias("family"))


NAMES = [
    ("get_user", "fetch_user", True, 1.0, 0.0), ("userId", "user_id", True, 0.2, 0.615384615), ("parse_args", "parse_args", True, 1.0, 1.0), ("load_file", "read_file", False, 1.0, 0.0), ("abc", "xyz", False, 0.2, 0.0), ("item_list", "item_array", True, 0.2, 0.526315789),
]


@query(told("a b follows semantic prefix", NAMES))
def name_pairs(spark, sf_dir):
    """Usual changes of names, synonyms of their verbs, common beginnings."""
    c = cases(spark, sf_dir, "a b", [p[:2] for p in NAMES])
    return c.select("r", "a", "b", names.follows_pattern("a", "b").alias("follows"), F.round(names.semantic_similarity("a", "b", F.lit(0.2)), 9).alias("semantic"), F.round(names.prefix_similarity("a", "b"), 9).alias("prefix"))


PARAMS = [("msg", "message", 0.8), ("user", "user", 1.0), ("user_name", "user_mail", 0.5), ("file", "path", 0.8), ("x", "q", 0.0), ("num_items", "item_number", 0.8), ("data", "content", 0.8)]


@query(told("a b similarity", PARAMS))
def parameter_names_alike(spark, sf_dir):
    c = cases(spark, sf_dir, "a b", [p[:2] for p in PARAMS])
    return c.select("r", "a", "b", F.round(relevance.parameter_similarity("a", "b"), 9).alias("similarity"))


RATIOS = [("label", "lable", 0.8, 0.8), ("abc", "", 0.0, 0.0), ("", "", 1.0, 0.0), ("get user", "user get", 0.5, 1.0), ("kitten", "sitting", 0.615384615, 0.615384615), ("same", "same", 1.0, 1.0)]


@query(told("a b ratio by_words", RATIOS))
def text_ratios(spark, sf_dir):
    """Twice the longest common subsequence over the lengths, and the best over shared words."""
    c = cases(spark, sf_dir, "a b", [p[:2] for p in RATIOS])
    return c.select("r", "a", "b", F.round(suggestions.indel_ratio("a", "b"), 9).alias("ratio"), F.round(suggestions.token_set_ratio("a", "b"), 9).alias("by_words"))


MODULES = [("a.b.c", "a.b.d", 2, 0.5), ("a", "a", 0, 1.0), ("a.b", "x.y", 4, 0.0), ("a.b", "a.b.c", 1, 1.0)]


@query(told("a b distance context", MODULES))
def module_pairs(spark, sf_dir):
    c = cases(spark, sf_dir, "a b", [p[:2] for p in MODULES])
    return c.select("r", "a", "b", names.module_distance("a", "b").alias("distance"), names.module_context(F.concat(F.translate("a", ".", "/"), F.lit(".py")), "b").alias("context"))


IMPORTS = [("x", 0, "a.b.c", "x"), ("x", 1, "a.b.c", "a.b.x"), ("", 2, "a.b.c", "a"), ("x", 4, "a.b.c", None), ("y.z", 3, "a.b.c", "y.z")]


@query(told("source level module resolved", IMPORTS))
def resolved_imports(spark, sf_dir):
    c = cases(spark, sf_dir, "source level module", [i[:3] for i in IMPORTS])
    return c.select("r", "source", "level", "module", relevance.resolved_import("source", "level", "module").alias("resolved"))


PATHS = [("file:/p/a.py", True), ("file:/p/.venv/a.py", False), ("file:/p/.hidden/a.py", False), ("file:/p/build/x/a.py", False), ("file:/p/builder/a.py", True), ("file:/p/test_x/a.py", False), ("file:/p/__pycache__/a.py", False)]


@query(told("path kept", PATHS))
def wanted_paths(spark, sf_dir):
    return cases(spark, sf_dir, "path", [(p,) for p, _ in PATHS]).select("r", "path", python_files.wanted(F.col("path"), globs=("test_*",)).alias("kept"))


BYTES = [("68c3a9", "hé{n}"), ("68e9", "hé{n}"), ("", "{n}"), ("61", "a{n}")]


@query(told_keyed("hex text", BYTES))
def decoded_files(spark, sf_dir):
    """UTF-8, else Latin-1."""
    c = keyed(spark, sf_dir, "hex name", [(b, "{n}") for b, _ in BYTES]).withColumn("content", F.concat(F.unhex("hex"), F.encode("name", "UTF-8")))
    return c.select("r", "hex", python_files.decoded("content").alias("text"))


SUGGESTED = [
    ("Do it.\n\nArgs:\n    x (int): The x.", ""), ("Args:\nx: y", "style"), ("", "empty"), ("   odd", "indentation"), ('a """ b', "not a string,quotes"), ("fix this", "vague"), ("Do it.\n\nargs:\n    x: y", "style"), ("A\n\n                deep", "indentation"), ("Do it.\n\n:param x: y", "style"),
]


@query(told("text problems", SUGGESTED))
def suggestion_problems(spark, sf_dir):
    c = cases(spark, sf_dir, "text", [(t,) for t, _ in SUGGESTED])
    return c.select("r", "text", F.array_join(validation.problems("text", "google"), ",").alias("problems"))


STYLED = [
    ("Parameters\n----------\nx : int", "", "mixed styles", "mixed styles"), ("Parameters\n-----\nx", "underline of another length", "mixed styles", "mixed styles"), ("Parameters\nx", "section without underline,underline of another length", "", ""), ("Args:\n    x: y", "mixed styles", "", "mixed styles"),
    (":param: y", "mixed styles", "mixed styles", "field without a name"), (":param x: y", "mixed styles", "mixed styles", ""), (":param x", "mixed styles", "mixed styles", "field without a colon"), ("Plain.", "", "", ""),
]


@query(told("text numpy google sphinx", STYLED))
def style_problems(spark, sf_dir):
    c = cases(spark, sf_dir, "text", [(t[0],) for t in STYLED])
    return c.select("r", "text", *(F.array_join(validation.style_problems("text", s), ",").alias(s) for s in ("numpy", "google", "sphinx")))


SECTIONS = [
    ("Do.\n\nArgs:\n    x: y\n\nReturns:\n    int: z", "Args:\n    q: w", "Do.\n\nArgs:\n    q: w\n\nReturns:\n    int: z"), ("Do.\n\nReturns:\n    int: z", "Args:\n    q: w", "Do.\n\nArgs:\n    q: w\n\nReturns:\n    int: z"), ("Do.", "Raises:\n    E: w", "Do.\n\nRaises:\n    E: w"),
    ("Do.\n\nSpecial:\n    kept\n\nReturns:\n    a", "Returns:\n    b", "Do.\n\nSpecial:\n    kept\n\nReturns:\n    b"), ("Do.\n\nParameters\n----------\nx\n    y", "Parameters\n----------\nq\n    w", "Do.\n\nParameters\n----------\nq\n    w"), ("Do.\n\nReturns:\n    a\n\nSpecial:\n    kept", "Raises:\n    E: w", "Do.\n\nReturns:\n    a\n\nRaises:\n    E: w\n\nSpecial:\n    kept"),
]


@query(told("text section merged", SECTIONS))
def merged_sections(spark, sf_dir):
    """A section is replaced, or put where the order has it; custom sections stay."""
    c = cases(spark, sf_dir, "text section", [s[:2] for s in SECTIONS])
    return c.select("r", "text", "section", docstrings.with_section("text", "section").alias("merged"))


LINES = [("a\n{n}", "a\nc", "c", "{n}"), ("", "{n}", "{n}", ""), ("{n}", "{n}", "", "")]


@query(told_keyed("old new added removed", LINES))
def line_changes(spark, sf_dir):
    c = keyed(spark, sf_dir, "old new", [x[:2] for x in LINES])
    d = suggestions.line_changes(F.col("old"), F.col("new"))
    return c.select("r", "old", "new", F.array_join(d["added"], ",").alias("added"), F.array_join(d["removed"], ",").alias("removed"))


@query(told("documented signature ordered", [("c,a,b", "a,b,c", "a,b,c"), ("z,b,a", "a,b", "a,b,z"), ("a", "b,c", "a")]))
def reordered_parameters(spark, sf_dir):
    c = cases(spark, sf_dir, "documented signature", [("c,a,b", "a,b,c"), ("z,b,a", "a,b"), ("a", "b,c")])
    d = F.transform(F.split("documented", ","), lambda n: F.struct(n.alias("name")))
    return c.select("r", "documented", "signature", F.array_join(F.transform(suggestions.reordered(d, F.split("signature", ",")), lambda p: p["name"]), ",").alias("ordered"))


EXAMPLES = [("x = '{n}'\ny = f(x)\nassert y", 1, 1, 1, "basic"), ("import os\nawait g('{n}')", 1, 1, 0, "intermediate"), ("", 0, 0, 0, "basic"), ("# only {n}\nh()", 0, 1, 0, "basic")]


@query(told_keyed("text setup calls assertions complexity", EXAMPLES))
def example_profiles(spark, sf_dir):
    c = keyed(spark, sf_dir, "text", [(e[0],) for e in EXAMPLES]).withColumn("p", relevance.example_profile("text"))
    return c.select("r", "text", "p.setup", "p.calls", "p.assertions", "p.complexity")


REPLIES = [("There is an issue here.\nAll well.", "There is an issue here."), ("missing thing\nproblem two", "missing thing|problem two"), ("fine", "")]


@query(told("text found", REPLIES))
def recovered_findings(spark, sf_dir):
    c = cases(spark, sf_dir, "text", [(t,) for t, _ in REPLIES])
    return c.select("r", "text", F.array_join(F.transform(json_text.recovered("text"), lambda x: x["description"]), "|").alias("found"))


@query(told("kind question", [(k, q) for k, q in routing.TEMPLATES.items()] + [("other", routing.TEMPLATES["behavior"])]))
def prompt_questions(spark, sf_dir):
    return cases(spark, sf_dir, "kind", [(k,) for k in [*routing.TEMPLATES, "other"]]).select("r", "kind", routing.prompt_for(F.col("kind")).alias("question"))


@query("""with f as (select p_partkey as r, p_size % 2 = 0 as examples, p_retailprice > 1000 as raises, p_partkey % 3 = 0 as changed from part)
select *, case when examples or raises or changed then concat_ws(',', case when changed then 'behavior' end, case when examples then 'examples' end, case when raises then 'edge_cases' end) else 'behavior' end as kinds from f""")
def chosen_analyses(spark, sf_dir):
    k = F.col("p_partkey")
    c = table(spark, sf_dir, "part").select(k.alias("r"), (F.col("p_size") % 2 == 0).alias("examples"), (F.col("p_retailprice") > 1000).alias("raises"), (k % 3 == 0).alias("changed"))
    return c.select("r", "examples", "raises", "changed", F.array_join(routing.analysis_types(F.col("examples"), F.col("raises"), F.col("changed")), ",").alias("kinds"))


@query(told("params typed returns complexity alike", [(0, True, False, 2, 0.5), (3, False, True, 3, 1.0), (6, True, True, 5, 0.5), (1, False, False, 1, 0.5)]))
def signature_complexity(spark, sf_dir):
    c = cases(spark, sf_dir, "params typed returns", [(0, True, False), (3, False, True), (6, True, True), (1, False, False)])
    n = scores.complexity(F.col("params"), F.col("typed"), F.col("returns"))
    return c.select("r", "params", "typed", "returns", n.alias("complexity"), F.round(F.when(n == 3, 1.0).otherwise(scores.complexity_match(F.lit(1), F.lit(3))), 9).alias("alike"))


@query(told("a b overlap", [("one two", "two three", 0.5), ("", "", 0.0), ("A b", "a B", 1.0), ("x y z", "x", 0.333333333)]))
def word_overlaps(spark, sf_dir):
    c = cases(spark, sf_dir, "a b", [("one two", "two three"), ("", ""), ("A b", "a B"), ("x y z", "x")])
    return c.select("r", "a", "b", F.round(routing.words_overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


@query("""with f as (select p_partkey as r, p_size % 2 = 0 as params, p_size % 3 = 0 as described, p_partkey % 2 = 0 as returns, p_partkey % 3 = 0 as examples, p_name || ' ' || p_type || ' ' || p_brand as text from part)
select *, least(5, 1 + (len(text) > 20)::int + params::int + (params and described)::int + returns::int + examples::int) as quality from f""")
def documentation_quality(spark, sf_dir):
    k, n = F.col("p_partkey"), F.col("p_size")
    c = table(spark, sf_dir, "part").select(k.alias("r"), (n % 2 == 0).alias("params"), (n % 3 == 0).alias("described"), (k % 2 == 0).alias("returns"), (k % 3 == 0).alias("examples"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("text"))
    return c.select("r", "params", "described", "returns", "examples", "text", docs.doc_quality(*(F.col(x) for x in ("params", "described", "returns", "examples", "text"))).alias("quality"))


@query(told("u drawn", [(0.0, "missing_params"), (0.31, "missing_returns"), (0.74, "missing_raises"), (0.95, "parameter_type_mismatch"), (0.999999, "parameter_type_mismatch")]))
def weighted_draws(spark, sf_dir):
    return cases(spark, sf_dir, "u", [(0.0,), (0.31,), (0.74,), (0.95,), (0.999999,)]).select("r", "u", simulation.weighted(F.col("u"), simulation.WEIGHTS).alias("drawn"))


@query("""select l_orderkey, l_linenumber, round((l_discount + (l_linenumber % 2 = 0)::int + l_tax + (l_linenumber % 3 = 0)::int) / 4, 9) as quality from lineitem""")
def four_factor_quality(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(suggestions.quality(F.col("l_discount"), n % 2 == 0, F.col("l_tax"), n % 3 == 0), 9).alias("quality"))


@query("select r_regionkey as r, '{\"a\":' || r_regionkey || ',\"b\":\"' || r_name || '\"}' as json from region")
def json_rows(spark, sf_dir):
    c = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("a"), F.col("r_name").alias("b"))
    return stores.to_json_rows(c).select(F.get_json_object("json", "$.a").cast("int").alias("r"), "json")


BLOCKS = [("describe: Tells it.", "describe", "Tells it."), ("  other(x): Takes x.", "other", "Takes x."), ("no block here", None, None)]


@query("select r_regionkey as r, t.name, t.text from region, (values ('describe', 'Tells it.'), ('other', 'Takes x.')) as t(name, text)")
def module_blocks(spark, sf_dir):
    """``name: text`` lines of a module's documentation."""
    c = cases(spark, sf_dir, "module_doc", [("A module.\n\n" + "\n".join(b[0] for b in BLOCKS),)])
    return matching.module_docs(c.withColumn("module", F.col("r").cast("string"))).select(F.col("module").cast("int").alias("r"), "name", "text")


_BARE = [("*{n}", "{n}"), ("**{n}", "{n}"), ("{n}/", "{n}"), ("{n}", "{n}")]


@query(told_keyed("name bare", _BARE))
def bare_names(spark, sf_dir):
    return keyed(spark, sf_dir, "name", [(x,) for x, _ in _BARE]).select("r", "name", rules.bare(F.col("name")).alias("bare"))


@query("select r_regionkey as r, r_regionkey >= 3 as kept from region where r_regionkey >= 3")
def kept_by_age(spark, sf_dir):
    """Rows of at most a stated age."""
    c = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("r"), (F.col("r_regionkey") * 86400.0).alias("t"))
    return stores.recent(c, "t", F.lit(4 * 86400.0), 1).select("r", F.lit(True).alias("kept"))


ACTIONS = [
    ("parameter_missing", "x", "", "", "Add 'x' to the documentation."), ("parameter_name_mismatch", "x", "y", "z", "Rename 'z' to 'y'."), ("parameter_type_mismatch", "x", "int", "str", "Change the type of 'x' from 'str' to 'int'."), ("default_mismatches", "x", "1", "2", "Change the default of 'x' from 2 to 1."), ("other", "x", "", "", "Check 'x'."),
]


@query(told("kind name expected actual text", ACTIONS))
def parameter_texts(spark, sf_dir):
    c = cases(spark, sf_dir, "kind name expected actual", [a[:4] for a in ACTIONS])
    return c.select("r", "kind", "name", "expected", "actual", suggestions.parameter_text(*(F.col(x) for x in ("kind", "name", "expected", "actual"))).alias("text"))


FENCED = [("x = '{n}'\n", "```python\nx = '{n}'\n```"), ("{n}  ", "```python\n{n}\n```")]


@query(told_keyed("text fenced", FENCED))
def fenced_texts(spark, sf_dir):
    return keyed(spark, sf_dir, "text", [(t,) for t, _ in FENCED]).select("r", "text", suggestions.fenced(F.col("text")).alias("fenced"))


KEPT = [("a:The {n}.,b:The b.", "a:,b:Other {n}.,c:", "The {n}.|Other {n}.|"), ("", "a:", ""), ("a:The {n}.", "b:", "")]


@query(told_keyed("old new kept", KEPT))
def kept_descriptions(spark, sf_dir):
    """Descriptions that say something stay where the new ones say nothing."""
    c = keyed(spark, sf_dir, "old new", [x[:2] for x in KEPT])
    made = lambda x: F.transform(F.split(x, ","), lambda p: F.struct(F.substring_index(p, ":", 1).alias("name"), F.substring_index(p, ":", -1).alias("description")))
    kept = suggestions.keep_descriptions(made(F.col("old")), made(F.col("new")), lambda d: d == "")
    return c.select("r", "old", "new", F.array_join(F.transform(kept, lambda p: p["description"]), "|").alias("kept"))


@query("select l_orderkey, l_linenumber, l_extendedprice as before, l_extendedprice * (1 - l_discount) * (1 + l_tax) as after, greatest(0.0::double, after - before) as used from lineitem")
def memory_deltas(spark, sf_dir):
    from ..streaming import tracking

    x = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("before"), (F.col("l_extendedprice") * (1 - F.col("l_discount")) * (1 + F.col("l_tax"))).alias("after"))
    return x.select("*", tracking.memory_used(F.col("before"), F.col("after")).alias("used"))
