"""Text classification, vocabulary and JSON over documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import docs, errors, json_text, names, scores
from ..operators import aggregates
from .register import query, table


@query(r"""select doc_id, case when contains(text, ':param') or contains(text, ':type') or contains(text, ':returns:') or contains(text, ':rtype:') or contains(text, ':raises:') then case when contains(text, ':Example:') or contains(text, '.. code-block::') then 'rest' else 'sphinx' end
 when regexp_matches(text, '(?m)^[ \t]*(?:Parameters|Returns|Raises|Examples|Notes)[ \t]*\n[ \t]*-+[ \t]*$') then 'numpy' else 'google' end as format from documents""")
def doc_format(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", docs.format_of("text").alias("format"))


def _style_sql(style: str) -> str:
    required, optional, forbidden, weight = docs.STYLE_SIGNS[style]
    hit = lambda ps, w: " + ".join(f"{w} * regexp_matches(t, '(?im){p}')::int" for p in ps)
    return f"greatest(0, least(1, ({hit(required, 2.0)} + {hit(optional, 0.5)} - ({hit(forbidden, 1.5)})) * {weight} / 5.0))::double"


_STYLES = "s as (select doc_id, lang, " + ", ".join(f"{_style_sql(s)} as {s}" for s in docs.STYLE_SIGNS) + " from (select doc_id, lang, lower(text) as t from documents))"


@query(f"with {_STYLES} select doc_id, round(google, 9) as google, round(numpy, 9) as numpy, round(sphinx, 9) as sphinx, round(rest, 9) as rest from s")
def style_score(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *(F.round(docs.style_score("text", s), 9).alias(s) for s in docs.STYLE_SIGNS))


@query(f"""with {_STYLES}, b as (select lang, greatest(google, numpy, sphinx, rest) as score, case when greatest(google, numpy, sphinx, rest) < 0.3 then 'google' when google >= greatest(numpy, sphinx, rest) then 'google' when numpy >= greatest(sphinx, rest) then 'numpy' when sphinx >= rest then 'sphinx' else 'rest' end as style from s),
v as (select lang, style, sum(score) as score from b group by all), t as (select lang, sum(score) as total from v group by lang), w as (select * from v qualify row_number() over (partition by lang order by score desc, style) = 1)
select lang, case when total > 0 and score >= 0.4 * total then style else 'google' end as style from w join t using (lang)""")
def style_vote(spark, sf_dir):
    b = table(spark, sf_dir, "documents").select("lang", docs.best_style("text").alias("b")).select("lang", "b.style", "b.score")
    return aggregates.style_vote(b, "lang").select("lang", "style")


@query("""select conv_id, turn, round(least(1.0, case when trim(text) <> '' then 0.2 else 0 end + case when contains(lower(text), 'args:') or contains(lower(text), 'arguments:') then 0.2 else 0 end + case when contains(lower(text), 'returns:') or contains(lower(text), 'return:') then 0.2 else 0 end
 + case when contains(lower(text), 'raises:') or contains(lower(text), 'raise:') then 0.1 else 0 end + case when contains(lower(text), 'example:') or contains(text, '>>>') then 0.15 else 0 end + case when length(text) > 100 then 0.15 else 0 end), 9)::double as completeness from conversations""")
def completeness(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.round(docs.completeness("text"), 9).alias("completeness"))


_ANY = lambda ps: "(" + " or ".join(f"contains(s, '{p}')" for p in ps) + ")"


@query(f"select conv_id, turn, length(s) >= 10 and not ({_ANY(docs.VAGUE)} and length(s) < 50) and {_ANY(docs.ACTIONS)} as actionable from (select conv_id, turn, trim(lower(text)) as s from conversations)")
def actionable(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", docs.actionable("text").alias("actionable"))


@query("""with w as (select lang, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) as term from documents), n as (select lang, term, count(*) as uses from w group by all)
select lang, term, uses, row_number() over (partition by lang order by uses desc, term) as rank from n qualify rank <= 10""")
def vocab_top10(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("lang", F.explode(docs.vocabulary("text")).alias("term"))
    return aggregates.frequent_terms(w, "lang", "term", 10).select("lang", "term", "uses", "rank")


@query("""with w as (select source, unnest(regexp_extract_all(lower(text), '[a-z]+ed [a-z]+ing')) as phrase from documents) select source, phrase, count(*) as uses from w group by all having count(*) >= 2""")
def phrases_ge2(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("source", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+ed [a-z]+ing"), F.lit(0))).alias("phrase"))
    return aggregates.at_least(w, ["source", "phrase"], 2)


@query("""select event_id, json_valid(props) as valid, try_cast(json_extract(props, '$.k') as bigint) as k from events""")
def json_valid(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.try_parse_json("props").isNotNull().alias("valid"), F.get_json_object("props", "$.k").try_cast("long").alias("k"))


@query("""select event_id, 'parameter_type_mismatch' as issue_type, least(1.0, value / 100)::double as confidence from events where value >= 0 and value <= 100""")
def reply_findings(spark, sf_dir):
    """Model replies in fences, made of events and read back."""
    e = table(spark, sf_dir, "events").select("event_id", "value")
    reply = F.concat(F.lit("Here it is:\n```json\n"), F.to_json(F.struct(F.array(F.struct(F.lit("type_mismatch").alias("type"), F.lit("differs").alias("description"), F.lit("change it").alias("suggestion"), (F.col("value") / 100).alias("confidence"), F.lit(1).alias("line_number"))).alias("issues"))), F.lit("\n```"))
    x = e.select("event_id", F.explode(json_text.findings(json_text.extract(reply))["issues"]).alias("i")).where(json_text.valid_finding(F.col("i")))
    return x.select("event_id", json_text.issue_type(F.col("i.type")).alias("issue_type"), F.col("i.confidence").alias("confidence"))


@query(r"""select doc_id, length(text) as characters, case when text = '' then 0 else len(string_split(regexp_replace(text, '\n$', ''), chr(10))) end as lines, (length(text) // 4)::int as tokens,
 regexp_matches(text, 'example|Example|EXAMPLE') as has_examples, regexp_matches(text, 'JSON|json|format') as has_format,
 ((length(text) > 1000)::int + (length(text) - length(replace(text, '{', '')) > 10)::int + regexp_matches(text, 'example|Example|EXAMPLE')::int + regexp_matches(text, 'JSON|json|format')::int + regexp_matches(text, 'CRITICAL|IMPORTANT')::int) / 5.0::double as complexity from documents""")
def text_profile(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", docs.text_profile("text").alias("p")).select("doc_id", *(f"p.{c}" for c in ("characters", "lines", "tokens", "has_examples", "has_format", "complexity")))


@query("select conv_id, sum(length(text) // 4 + 750)::bigint as tokens, round(sum(round((length(text) // 4 + 750) / 1000.0::double * 0.002, 6)), 6) as cost from conversations group by conv_id")
def cost_estimate(spark, sf_dir):
    t = table(spark, sf_dir, "conversations").select("conv_id", scores.estimate_tokens("text").alias("t"))
    return t.groupBy("conv_id").agg(F.sum("t").alias("tokens"), F.round(F.sum(scores.estimate_cost(F.col("t"), F.lit(0.002))), 6).alias("cost"))


@query("""select d.source, count(*) as docs, count(l.quality) as labelled, count(*) filter (l.quality = 1) as good, round(avg(l.quality), 6) as share from documents d left join labels l using (doc_id) group by d.source""")
def quality_labels(spark, sf_dir):
    d = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")
    return d.groupBy("source").agg(F.count("*").alias("docs"), F.count("quality").alias("labelled"), F.count_if(F.col("quality") == 1).alias("good"), F.round(F.avg("quality"), 6).alias("share"))


@query("""with u as (select page_id, string_split(regexp_replace(url, '[?#].*$', ''), '/') as p from pages), f as (select p as q from u order by page_id limit 1)
select page_id, len(p) + len(q) - 2 * coalesce(list_min([i - 1 for i in range(1, least(len(p), len(q)) + 1) if p[i] <> q[i]]), least(len(p), len(q))) as distance from u, f""")
def path_distance(spark, sf_dir):
    u = table(spark, sf_dir, "pages").select("page_id", F.split(F.regexp_replace("url", "[?#].*$", ""), "/").alias("p"))
    first = u.orderBy("page_id").limit(1).select(F.col("p").alias("q"))  # one row
    x = u.join(F.broadcast(first))
    return x.select("page_id", (F.size("p") + F.size("q") - 2 * names.common_levels(F.col("p"), F.col("q"))).cast("long").alias("distance"))


@query("""with b as (select item_id, list_distinct(string_split(lower(text), ' ')) as t from benchmark), q as (select item_id, list_distinct(string_split(lower(text), ' ')) as t from benchmark where item_id % 100 = 0)
select q.item_id as a, b.item_id as b, round(len(list_intersect(q.t, b.t)) / len(list_distinct(list_concat(q.t, b.t)))::double, 9) as similarity from q join b on q.item_id <> b.item_id""")
def token_jaccard(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(F.split(F.lower("text"), " ")).alias("t"))
    q = b.where("item_id % 100 = 0").select(F.col("item_id").alias("a"), F.col("t").alias("u"))
    return q.join(b, F.col("a") != F.col("item_id")).select("a", F.col("item_id").alias("b"), F.round(names.token_similarity("u", "t"), 9).alias("similarity"))


@query("""select case when contains(t, 'rate limit') then 'rate_limit' when contains(t, 'timeout') then 'timeout' when contains(t, 'connection') then 'network' else 'unknown' end as kind, count(*) as n from (select event_type || case user_id % 4 when 0 then ' rate limit' when 1 then ' timeout' when 2 then ' connection reset' else '' end as t from events) group by 1""")
def error_kinds(spark, sf_dir):
    u = F.col("user_id") % 4
    t = F.concat("event_type", F.when(u == 0, " rate limit").when(u == 1, " timeout").when(u == 2, " connection reset").otherwise(""))
    return table(spark, sf_dir, "events").select(errors.analyse(t)["kind"].alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))


@query(f"""with {_STYLES.replace("select doc_id, lang, ", "select doc_id, source, ").replace("(select doc_id, lang, lower(text)", "(select doc_id, source, lower(text)")}, m as (select * from s join (select doc_id from documents where text is not null qualify row_number() over (partition by source order by sha256(doc_id::varchar), doc_id) <= 50) using (doc_id)),
b as (select source, greatest(google, numpy, sphinx, rest) as score, case when greatest(google, numpy, sphinx, rest) < 0.3 then 'google' when google >= greatest(numpy, sphinx, rest) then 'google' when numpy >= greatest(sphinx, rest) then 'numpy' when sphinx >= rest then 'sphinx' else 'rest' end as style from m),
v as (select source, style, sum(score) as score from b group by all), t as (select source, sum(score) as total from v group by source), n as (select source, count(*) as n from b group by source),
w as (select * from v qualify row_number() over (partition by source order by score desc, style) = 1)
select source, case when total > 0 and score >= 0.4 * total then style else 'google' end as style, n from w join t using (source) join n using (source)""")
def project_styles(spark, sf_dir):
    """The style of each source by a vote of a sample of fifty of its texts, which no partitioning changes."""
    return aggregates.style_of_projects(table(spark, sf_dir, "documents"), "source", "doc_id", "text")


PATTERNS = {"function": "[a-z_][a-z0-9_]*", "short": ".{1,24}", "words": "[a-z]+( [a-z]+)*"}


@query(f"""with p as (select p_partkey, lower(p_name) as name from part) select p_partkey, array_to_string(list_filter([{', '.join(f"case when not regexp_full_match(name, '{p}') then '{k}' end" for k, p in sorted(PATTERNS.items()))}], lambda x: x is not null), ',') as unlike from p""")
def names_against_patterns(spark, sf_dir):
    """Names against the patterns that a user's settings give for kinds of names."""
    settings = EngineConfig().layered({"name_patterns": PATTERNS})
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(names.unlike(F.lower("p_name"), settings.name_patterns), ",").alias("unlike"))
