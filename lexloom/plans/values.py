"""Column operators over values of the tables: paths, names, types, lines, words and rows as they come."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import names, scores, types
from ..operators import engine, routing, suggestions
from ..sources import python_files, stores
from . import gallery
from .register import query, table
from .told import told


@query(r"""with p as (select page_id, string_split(regexp_replace(url, '^[a-z]+:/*', ''), '/') as parts from pages where url is not null)
select page_id, not list_has_any(parts, ['es', 'build']) and len([x for x in parts if x like '.%' and length(x) > 1 and x <> '..']) = 0 and len([x for x in parts if x like '%7%']) = 0 as kept from p""")
def wanted_addresses(spark, sf_dir):
    """Addresses as paths: a scan with these exclusions would read those that are kept."""
    return table(spark, sf_dir, "pages").where("url is not null").select("page_id", python_files.wanted(F.col("url"), excluded=("es", "build"), globs=("*7*",)).alias("kept"))


@query("select conv_id, turn, md5(text) as utf8, case when regexp_full_match(text, '[\\x00-\\xff]*') then md5(text) end as latin from conversations where text is not null")
def decoded_texts(spark, sf_dir):
    """Bytes of texts in UTF-8, and of those that have it in Latin-1, come back as they were."""
    c = table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", "text", F.encode("text", "UTF-8").alias("u"), F.encode("text", "ISO-8859-1").alias("l"))
    latin = F.col("text").rlike(r"^[\x00-\xff]*$")
    return c.select("conv_id", "turn", F.md5(python_files.decoded("u")).alias("utf8"), F.when(latin, F.md5(python_files.decoded("l"))).alias("latin"))


_NEXT = "select conv_id, turn, coalesce(text, '') as a, lead(coalesce(text, '')) over (partition by conv_id order by turn) as b from conversations where conv_id is not null and turn is not null"


def _turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").where("conv_id is not null and turn is not null").withColumn("a", F.coalesce("text", F.lit("")))
    return c.withColumn("b", F.lead("a").over(Window.partitionBy("conv_id").orderBy("turn"))).where("b is not null")


@query(f"""with n as ({_NEXT}) select conv_id, turn, array_to_string([x for x in string_split(b, chr(10)) if not list_contains(string_split(a, chr(10)), x)], '|') as added,
 array_to_string([x for x in string_split(a, chr(10)) if not list_contains(string_split(b, chr(10)), x)], '|') as removed from n where b is not null""")
def turn_changes(spark, sf_dir):
    """Lines that a turn has and the one before has not, and the other way round."""
    d = suggestions.line_changes(F.col("a"), F.col("b"))
    return _turns(spark, sf_dir).select("conv_id", "turn", F.array_join(d["added"], "|").alias("added"), F.array_join(d["removed"], "|").alias("removed"))


@query(f"""with n as ({_NEXT}), w as (select conv_id, turn, list_distinct([x for x in regexp_split_to_array(lower(a), '\\s+') if x <> '']) as a, list_distinct([x for x in regexp_split_to_array(lower(b), '\\s+') if x <> '']) as b from n where b is not null)
select conv_id, turn, round(len(list_intersect(a, b)) / greatest(len(a), len(b), 1), 9) as overlap from w""")
def turn_overlaps(spark, sf_dir):
    """Words that a turn shares with the next, over the more words of the two."""
    return _turns(spark, sf_dir).select("conv_id", "turn", F.round(routing.words_overlap(F.col("a"), F.col("b")), 9).alias("overlap"))


@query(r"select conv_id, turn, md5('```python' || chr(10) || regexp_replace(text, '\s+$', '') || chr(10) || '```') as fenced from conversations where text is not null")
def fenced_turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations").where("text is not null").select("conv_id", "turn", F.md5(suggestions.fenced(F.col("text"))).alias("fenced"))


@query("""with n as (select p_partkey, replace(lower(p_name), ' ', '_') as name from part), p as (select a.p_partkey, a.name as a, b.name as b from n a join n b on b.p_partkey = a.p_partkey + 1)
select p_partkey, round(case when a = b then 1 else 2.0 * coalesce(list_max([i for i in range(1, least(length(a), length(b)) + 1) if left(a, i) = left(b, i)]), 0) / (length(a) + length(b)) end, 9)::double as prefix from p""")
def name_prefixes(spark, sf_dir):
    """How much of its beginning a name shares with the next part's."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.replace(F.lower("p_name"), F.lit(" "), F.lit("_")).alias("a"))
    p = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b")), "p_partkey")
    return p.select("p_partkey", F.round(names.prefix_similarity("a", "b"), 9).alias("prefix"))


@query(r"""with u as (select page_id, [x for x in string_split(regexp_replace(regexp_extract(url, '^[a-z]+://([^?#]*)', 1), '/+$', ''), '/') if x <> ''] as a from pages where url is not null),
p as (select x.page_id, x.a, y.a as b from u x join u y on y.page_id = x.page_id + 1 where len(x.a) > 0 and len(y.a) > 0)
select page_id, len(a) + len(b) - 2 * coalesce(list_max([i for i in range(1, least(len(a), len(b)) + 1) if a[1:i] = b[1:i]]), 0) as distance from p""")
def address_distances(spark, sf_dir):
    """Levels of two neighbouring addresses, read as dotted paths, outside what they begin with together."""
    parts = F.filter(F.split(F.regexp_replace(F.regexp_extract("url", r"^[a-z]+://([^?#]*)", 1), "/+$", ""), "/"), lambda x: x != "")
    u = table(spark, sf_dir, "pages").where("url is not null").select("page_id", F.array_join(F.transform(parts, lambda x: F.translate(x, ".", "_")), ".").alias("a")).where("a <> ''")
    u = u.join(u.select((F.col("page_id") - 1).alias("page_id"), F.col("a").alias("b")), "page_id")
    return u.select("page_id", names.module_distance("a", "b").alias("distance"))


@query("select n_nationkey as key, '{\"n_nationkey\":' || n_nationkey || ',\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' as json from nation")
def nation_rows(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    return stores.to_json_rows(n).select(F.get_json_object("json", "$.n_nationkey").cast("int").alias("key"), "json")


@query(told("name complexity", [
    (0, "size{k}", 2), (0, "make{k}", 2), (0, "grow{k}", 3), (1, "fetch{k}", 4), (2, "walk{k}", 3), (2, "inner{k}", 1), (3, "build{k}", 2), (4, "good{n}", 1), (5, "good{k}", 1), (7, "describe{p}", 1), (8, "shared{k}", 3), (8, "__len__", 2), (9, "shared{p}", 1), (9, "lonely{k}", 1),
]))
def gallery_complexity(spark, sf_dir):
    """Complexity of signatures: parameters, whether all have types, and a return type."""
    f = engine.opened(gallery.files(spark, sf_dir)).functions
    typed = ~F.exists("parameters", lambda p: p["type_annotation"].isNull())
    return f.select("name", scores.complexity(F.size("parameters"), typed, F.col("return_type").isNotNull()).alias("complexity"))


@query(told("name parameter normal base class google", [
    (0, "make{k}", "size", "int", "int", "simple", "int"), (0, "grow{k}", "by", "Optional[int]", "int", "optional", "int, optional"), (1, "fetch{k}", "url", "str", "str", "simple", "str"), (1, "fetch{k}", "retries", "Optional[int]", "int", "optional", "int, optional"),
    (1, "fetch{k}", "timeout", "float", "float", "simple", "float"), (3, "build{k}", "name", "str", "str", "simple", "str"), (3, "build{k}", "count", "int", "int", "simple", "int"), (8, "shared{k}", "value", "float", "float", "simple", "float"), (8, "shared{k}", "lable", "str", "str", "simple", "str"),
]))
def gallery_types(spark, sf_dir):
    """Types of parameters in their usual spelling, without what makes them optional, by class, and as a style writes them."""
    f = engine.opened(gallery.files(spark, sf_dir)).functions.select("name", F.explode("parameters").alias("p")).where("p.type_annotation is not null and p.type_annotation <> 'list'")
    t = F.col("p.type_annotation")
    return f.select("name", F.col("p.name").alias("parameter"), types.normalise(t).alias("normal"), types.base(t).alias("base"), types.complexity(t).alias("class"), types.for_style(t, "google").alias("google"))
