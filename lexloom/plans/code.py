"""Source text to findings, over files with known defects made from the part table."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import SEVERITY_WEIGHT
from ..functions._lift import lookup
from ..functions import names, relevance
from ..operators import docstrings, engine, matching, parse, retrieval, routing, rules, suggestions
from ..sources import shared, synthetic
from .register import query, table


def pairs(spark, sf_dir):
    files = synthetic.source_files(table(spark, sf_dir, "part"))
    return matching.documented(parse.functions(files)).withColumn("part", F.regexp_extract("name", r"(\d+)$", 1).cast("long"))


_RULES = """
with d(k, rule, issue_type, severity, subject) as (values
 (1, 'parameter_names', 'parameter_missing', 'critical', 'size'), (1, 'parameter_count', 'parameter_count_mismatch', 'critical', null), (1, 'missing_params', 'missing_params', 'critical', 'size'),
 (2, 'parameter_names', 'parameter_missing', 'critical', 'label'), (2, 'parameter_names', 'parameter_name_mismatch', 'critical', 'tag'), (2, 'missing_params', 'missing_params', 'critical', 'label'),
 (3, 'parameter_types', 'parameter_type_mismatch', 'high', 'label'), (4, 'return_type', 'missing_returns', 'high', null), (4, 'missing_returns', 'missing_returns', 'high', null),
 (5, 'missing_raises', 'missing_raises', 'medium', 'ValueError'), (6, 'default_mismatches', 'default_mismatches', 'medium', 'label'), (7, 'return_type', 'return_type_mismatch', 'high', null)),
i as (select p_partkey as part, d.* from part join d on p_partkey % 8 = d.k)
"""


@query(f"{_RULES} select part, rule, issue_type, severity, subject from i")
def rule_issues(spark, sf_dir):
    """Flagship: parse, match and run all rules in one pass without a shuffle."""
    p = pairs(spark, sf_dir)
    return rules.check(p).select(F.regexp_extract("function_id", r"(\d+)$", 1).cast("long").alias("part"), "rule", "issue_type", "severity", "subject")


@query(f"{_RULES} select part, count(*) as issues, max(case severity when 'critical' then 4 when 'high' then 3 when 'medium' then 2 else 1 end) as worst from i group by part")
def issues_by_function(spark, sf_dir):
    i = rules.check(pairs(spark, sf_dir))
    return i.groupBy(F.regexp_extract("function_id", r"(\d+)$", 1).cast("long").alias("part")).agg(F.count("*").alias("issues"), F.max(lookup(F.col("severity"), SEVERITY_WEIGHT, 0)).alias("worst"))


@query("select p_partkey as part, 'get_' || regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') || '_' || p_partkey as name, 4 as line_number, 3 as n_parameters, 'int' as return_type, false as is_method from part")
def parse_functions(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", "name", "line_number", F.size("parameters").alias("n_parameters"), "return_type", "is_method")


@query("""select p_partkey as part, u.pos, u.name, u.type_annotation, u.default_value, u.is_required from part cross join
 (values (0, 'size', 'int', null, true), (1, 'label', 'str', '''x''', false), (2, '*rest', null, null, false)) as u(pos, name, type_annotation, default_value, is_required)""")
def parse_parameters(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", F.explode("parameters").alias("p")).select("part", "p.pos", "p.name", "p.type_annotation", "p.default_value", "p.is_required")


@query("select p_partkey as part, 'google' as format, 'Look the part up.' as summary, case p_partkey % 8 when 1 then 2 else 3 end as n_parameters, case p_partkey % 8 when 4 then null when 7 then 'str' else 'int' end as return_type, case p_partkey % 8 when 5 then 0 else 1 end as n_raises from part")
def parse_docstrings(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("part", "doc.format", "doc.summary", F.size("doc.parameters").alias("n_parameters"), F.col("doc.returns.type_str").alias("return_type"), F.size("doc.raises").alias("n_raises"))


@query("select p_partkey as part, 'ValueError' as exception_type, 0.95::double as confidence from part")
def raised_exceptions(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", F.explode("exceptions").alias("e")).select("part", "e.exception_type", "e.confidence")


@query("select p_partkey as part, 'shop.' || translate(lower(p_brand), '# ', '__') || '.part_' || p_partkey as module, 'standard' as import_type, 'os' as source from part")
def parse_imports(spark, sf_dir):
    i = parse.imports(synthetic.source_files(table(spark, sf_dir, "part")))
    return i.select(F.regexp_extract("module", r"(\d+)$", 1).cast("long").alias("part"), "module", "import_type", "source")


@query("select p_partkey as part, 'exact' as match_type, round(0.8 + 0.2 * case p_partkey % 8 when 1 then 2/3.0::double when 2 then 0.5 else 1 end, 9) as confidence from part")
def direct_match(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return matching.direct(p).select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("part"), "match_type", F.round("confidence", 9).alias("confidence"))


@query("select p_partkey as part, 3 as parameters, case p_partkey % 8 when 1 then 2 when 2 then 2 else 3 end as documented, case p_partkey % 8 when 1 then 66.7 when 2 then 66.7 else 100.0 end::double as percent from part")
def parameter_coverage(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", rules.coverage().alias("c")).select("part", "c.parameters", "c.documented", "c.percent")


@query("select p_partkey as part, round(1 - case p_partkey % 8 when 1 then 0.1 when 2 then 0.15 when 4 then 0.1 else 0 end, 9)::double as quality from part")
def doc_quality(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", F.round(rules.doc_quality(), 9).alias("quality"))


@query("select p_partkey as part, unnest(['conditional']) as pattern from part")
def behaviour_patterns(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", F.explode(parse.behaviour("source_code")).alias("b")).select("part", "b.pattern")


@query("select p_partkey as part, 'def get_' || regexp_replace(lower(p_name), '[^a-z]+', '_', 'g') || '_' || p_partkey || '(size: int, label: str = ''x'', *rest) -> int' as signature from part")
def signatures(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", matching.signature_text().alias("signature"))


@query("select p_partkey as part, p_partkey % 8 in (1, 2, 4) as routed from part")
def model_routing(spark, sf_dir):
    """Functions go to the model whose documentation quality is below one."""
    from ..config import EngineConfig

    p = pairs(spark, sf_dir)
    routed = routing.needs_model(rules.doc_quality(), F.size("parameters"), F.size("doc.examples") > 0, F.col("decorators"), EngineConfig(llm_below=0.95))
    return p.select("part", routed.alias("routed"))


@query("select p_partkey as part, contains('ValueError size label rest', w) as found, w as word from part, (values ('size'), ('label'), ('rest'), ('ValueError')) as t(w)")
def suggested_docs(spark, sf_dir):
    """Repaired documentation names every parameter and exception."""
    s = suggestions.suggest(pairs(spark, sf_dir))
    words = F.explode(F.array(*map(F.lit, ("size", "label", "rest", "ValueError"))))
    return s.select(F.regexp_extract("function_id", r"(\d+)$", 1).cast("long").alias("part"), "suggested_text", words.alias("word")).select("part", F.contains("suggested_text", "word").alias("found"), "word")


@query("select p_partkey as part, 'sphinx' as format, case p_partkey % 8 when 1 then 2 else 3 end as n_parameters from part")
def converted_style(spark, sf_dir):
    """Google documentation rendered as Sphinx fields and read again."""
    c = pairs(spark, sf_dir).select("part", docstrings.converter("sphinx")("raw_doc").alias("raw"))
    return c.select("part", docstrings.parsed("raw").alias("d")).select("part", "d.format", F.size("d.parameters").alias("n_parameters"))


@query(f"{_RULES}, n as (select part, count(*) as n, count(*) filter (severity in ('critical', 'high')) as heavy from i group by part) select p_partkey as part, case when n is null then 5 else 4 end as quality_score from part left join n on part = p_partkey where coalesce(n, 0) <= 1 and coalesce(heavy, 0) = 0")
def good_examples(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return routing.good_examples(p, rules.check(p)).select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("part"), "quality_score")


@query("select p_partkey as part, 'Retrieves and returns data' as purpose from part")
def function_purpose(spark, sf_dir):
    return pairs(spark, sf_dir).select("part", relevance.purpose("name").alias("purpose"))


@query("""select p_partkey as part, e.exception, case e.exception when 'NetworkError' then false when 'TimeoutError' then false when 'ValidationError' then false else true end as relevant, e.exception in ('ValueError', 'ValidationError') as like_value
 from part, (values ('ValueError'), ('NetworkError'), ('TimeoutError'), ('ValidationError'), ('KeyError')) as e(exception)""")
def exception_relevance(spark, sf_dir):
    x = pairs(spark, sf_dir).select("part", F.lit("describe").alias("name"), F.transform("parameters", lambda p: p["name"]).alias("names"), F.explode(F.array(*map(F.lit, ("ValueError", "NetworkError", "TimeoutError", "ValidationError", "KeyError")))).alias("exception"))
    return x.select("part", "exception", relevance.exception_relevant("exception", "name", "names").alias("relevant"), relevance.exceptions_match("exception", F.lit("ValueError")).alias("like_value"))


@query("select p_partkey as part, 'tag' as told_name, 'label' as own_name from part where false")
def renamed_parameters(spark, sf_dir):
    """tag and label share too few letters to be taken for a rename."""
    x = pairs(spark, sf_dir).select("part", "function_id", F.transform("parameters", lambda p: p["name"]).alias("own"), F.transform("doc.parameters", lambda p: p["name"]).alias("told"))
    return retrieval.renamed_parameters(x).select(F.regexp_extract("function_id", r"(\d+)$", 1).cast("long").alias("part"), "told_name", "own_name")


@query()
def retrieve_examples(spark, sf_dir):
    """The functions of every hundredth part against all as a corpus of examples."""
    # Read by queries and corpus: parsed once.
    p = shared.store(pairs(spark, sf_dir).select("part", "name", matching.signature_text().alias("signature"), "file_path"), "functions")
    corpus = p.select(
        F.col("part").alias("example_id"), F.col("name").alias("function_name"), F.col("signature").alias("function_signature"), F.regexp_replace(F.translate("file_path", "/", "."), r"\.py$", "").alias("module_path"),
        (F.col("part") % 5 + 1).cast("int").alias("complexity_score"), (F.col("part") % 3 + 3).cast("int").alias("quality_score"), F.when(F.col("part") % 4 == 0, "accepted").otherwise("curated").alias("source"), (F.lit(1.7e9) - F.col("part") * 86400).alias("timestamp"),
    )
    q = p.where("part % 100 = 0").withColumnRenamed("part", "query_id")
    return retrieval.retrieve(q, corpus, F.lit(1.7e9)).select("query_id", "example_id", F.round("similarity", 9).alias("similarity"), "rank")


@query("""with f as (select p_partkey as part, p_partkey % 8 as k from part), w(k, issue_type, subject, told, plain) as (values
 (1, 'parameter_missing', 'size', 'size (int): How large.', 'size (int): The size.'), (2, 'missing_params', 'label', 'label (str, optional): What it says.', 'label (str, optional): The label.'),
 (4, 'missing_returns', null, 'int: The number.', 'int: The result.'), (5, 'missing_raises', 'ValueError', 'ValueError: If it is negative.', 'ValueError: If a value is not valid. Raised if size is below 0.'))
select distinct part, issue_type, subject, true as told_with, true as plain_without, 3 as examples_used, true as rag_enhanced from f join w using (k)""")
def suggested_with_examples(spark, sf_dir):
    """Suggestions fed by the three best examples of a corpus of faultless functions: what these say
    about a parameter, the return value or an exception stands in the text, where without a
    corpus name, type and code decide."""
    p = engine.opened(synthetic.source_files(table(spark, sf_dir, "part"))).functions
    found = shared.store(engine.analyse(p), "findings")
    good = p.where("doc is not null").join(found.select("function_id"), "function_id", "left_anti")
    corpus = good.select(
        F.col("function_id").alias("example_id"), F.col("name").alias("function_name"), matching.signature_text().alias("function_signature"), names.module_of(F.col("file_path")).alias("module_path"),
        F.lit(3).alias("complexity_score"), F.lit(5).alias("quality_score"), F.lit("curated").alias("source"), F.lit(0.0).alias("timestamp"), F.col("raw_doc").alias("docstring_content"),
    )
    wanted = {"parameter_missing": ("size (int): How large.", "size (int): The size."), "missing_params": ("label (str, optional): What it says.", "label (str, optional): The label."), "missing_returns": ("int: The number.", "int: The result."), "missing_raises": ("ValueError: If it is negative.", "ValueError: If a value is not valid. Raised if size is below 0.")}
    part = F.regexp_extract("function_id", r"(\d+)$", 1).cast("long")
    asked = found.where(((part % 8 == 1) & (F.col("issue_type") == "parameter_missing")) | ((part % 8 == 2) & (F.col("issue_type") == "missing_params")) | (part % 8).isin(4, 5) & F.col("issue_type").isin("missing_returns", "missing_raises"))
    keep = ["function_id", "issue_type", "subject"]
    # The functions that may be asked about, told by their key: others' texts need not meet the findings.
    own = p.where((part % 8).isin(1, 2, 4, 5))
    with_ = engine.enhance(asked, own, corpus=corpus).select(*keep, F.col("suggested_text").alias("rich"), "examples_used", "rag_enhanced").distinct()
    without = engine.enhance(asked, own).select(*keep, F.col("suggested_text").alias("plain")).distinct()
    told = lambda i: lookup(F.col("issue_type"), {k: v[i] for k, v in wanted.items()})
    x = with_.join(without, ["function_id", "issue_type"]).select(part.alias("part"), "issue_type", with_["subject"], F.contains("rich", told(0)).alias("told_with"), F.contains("plain", told(1)).alias("plain_without"), "examples_used", "rag_enhanced")
    return x.distinct()
