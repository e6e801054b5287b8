"""What goes into the corpus and the caches, and what comes of it, over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import EngineConfig
from ..functions import docs, hashing, scores
from ..operators import aggregates, corpus, embedding, matching, parse, retrieval, routing, simulation, suggestions, windows
from ..sources import stores, synthetic
from ..streaming import monitors
from . import gallery, services
from .register import query, table
from .told import told

_U = "(('0x' || md5(p_partkey::varchar || '{0}'))::uhugeint % 1000003)::double / 1000003"
_DRAWN = f"""u as (select p_partkey as id, {_U.format(":type")} as t, {_U.format(":quality")} as q, {_U.format(":accept")} as a, case when ('0x' || md5(p_partkey::varchar))::uhugeint % 100 < 50 then 'treatment' else 'control' end as ab_group from part),
d as (select id, ab_group, q, a, case when t < 0.3 then 'missing_params' when t < 0.55 then 'missing_returns' when t < 0.75 then 'missing_raises' when t < 0.9 then 'description_outdated' else 'parameter_type_mismatch' end as issue_type,
 least(1.0, case ab_group when 'control' then 0.6 else 0.75 end * case when q < 0.3 then 0.2 when q < 0.5 then 0.6 else 0.8 + 0.8 * (q - 0.5) end) as chance from u)"""


@query(f"with {_DRAWN} select id, issue_type, ab_group, round(q, 9) as quality, round(chance, 9) as chance, a < chance as accepted from d")
def simulated_suggestions(spark, sf_dir):
    """Types, groups, qualities and decisions that each suggestion's id decides."""
    s = simulation.simulate(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), "id")
    return s.select("id", "issue_type", "ab_group", F.round("quality", 9).alias("quality"), F.round("chance", 9).alias("chance"), "accepted")


@query(f"with {_DRAWN} select coalesce(ab_group, 'all') as ab_group, count(*) as total, count(*) as shown, count(*) filter (a < chance) as accepted, count(*) filter (a >= chance) as rejected, round(avg(q), 9) as mean_quality, round(count(*) filter (a < chance) / count(*), 9) as rate from d group by rollup (ab_group)")
def acceptance_simulation(spark, sf_dir):
    s = simulation.simulate(table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "id"), "id")
    r = simulation.results(s)
    return r.select(F.coalesce("ab_group", F.lit("all")).alias("ab_group"), "total", "shown", "accepted", "rejected", F.round("mean_quality", 9).alias("mean_quality"), F.round("rate", 9).alias("rate"))


def _examples(spark, sf_dir):
    """An example corpus from the part table, with faults of its own."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("example_id"), F.when(k % 11 == 0, "").otherwise(F.concat(F.lit("f"), (k % 50).cast("string"))).alias("function_name"), F.concat(F.lit("m"), F.when(k % 7 == 0, k % 2).otherwise(k).cast("string")).alias("module_path"), F.concat(F.lit("def f"), (k % 50).cast("string"), F.lit("()")).alias("function_signature"),
        F.lit("google").alias("docstring_format"), F.when(k % 5 == 0, "Short.").otherwise(F.concat(F.lit("Tells what part "), k.cast("string"), F.lit(" is about."))).alias("docstring_content"), F.col("p_size").alias("quality_score"), (k % 6).cast("int").alias("complexity_score"), F.col("p_brand").alias("category"),
        F.when(k % 3 == 0, "bootstrap").when(k % 3 == 1, "curated").otherwise("accepted").alias("source"),
    )


_EXAMPLES = """x as (select p_partkey as id, case when p_partkey % 11 = 0 then '' else 'f' || (p_partkey % 50) end as name, 'm' || case when p_partkey % 7 = 0 then p_partkey % 2 else p_partkey end as module, 'def f' || (p_partkey % 50) || '()' as sig,
 case when p_partkey % 5 = 0 then 'Short.' else 'Tells what part ' || p_partkey || ' is about.' end as text, p_size as quality, p_partkey % 6 as complexity, p_brand as category, case p_partkey % 3 when 0 then 'bootstrap' when 1 then 'curated' else 'accepted' end as source from part)"""


@query(f"""with {_EXAMPLES} select id as example_id, 'no function_name' as fault from x where name = '' union all select id, 'short text' from x where length(text) < 20 union all select id, 'quality out of range' from x where quality not between 1 and 5
 union all select id, 'complexity out of range' from x where complexity not between 1 and 5 union all select id, 'duplicate' from x where (module, name) in (select (module, name) from x group by module, name having count(*) > 1)""")
def corpus_faults(spark, sf_dir):
    return corpus.faults(_examples(spark, sf_dir))


@query(f"with {_EXAMPLES}, w(category, wanted) as (values ('Brand#11', 3), ('Brand#12', 1000000), ('Brand#99', 1)) select w.category, count(x.id) as n, w.wanted from w left join x using (category) group by all having count(x.id) < w.wanted")
def short_categories(spark, sf_dir):
    return corpus.short_categories(_examples(spark, sf_dir), {"Brand#11": 3, "Brand#12": 1_000_000, "Brand#99": 1})


@query(f"with {_EXAMPLES} select count(*) as examples, count(*) filter (source = 'bootstrap') as bootstrap, count(*) filter (source = 'curated') as curated, count(*) filter (source = 'accepted') as accepted, round(avg(quality), 6) as mean_quality, round(avg(complexity), 6) as mean_complexity, 1 as formats from x")
def corpus_statistics(spark, sf_dir):
    s = corpus.statistics(_examples(spark, sf_dir))
    return s.withColumns({c: F.round(c, 6) for c in ("mean_quality", "mean_complexity")})


@query(f"with {_EXAMPLES} select id as example_id, 'Function: ' || name || chr(10) || 'Signature: ' || sig || chr(10) || text as form from x")
def corpus_text_forms(spark, sf_dir):
    return _examples(spark, sf_dir).select("example_id", corpus.text_form().alias("form"))


@query("with f as (select p_partkey, p_size % 5 + 1 as quality_score, p_partkey % 5 + 1 as complexity_score from part where p_size % 5 + 1 >= 3) select p_partkey as part, quality_score, complexity_score from f order by quality_score desc, complexity_score desc, lpad(p_partkey::varchar, 9, '0') limit 150")
def bootstrap_examples(spark, sf_dir):
    """The 150 best examples: the limit is the corpus's size."""
    p = table(spark, sf_dir, "part").select(F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("function_id"), F.lit("told").alias("raw_doc"), "p_partkey", "p_size")
    b = corpus.bootstrap(p, F.col("p_size") % 5 + 1, F.col("p_partkey") % 5 + 1)
    return b.select(F.col("p_partkey").alias("part"), "quality_score", "complexity_score")


@query("select 'bootstrap' as source, count(*) as n from part where p_partkey % 3 = 0 union all select 'all', count(*) + (select count(*) from part where p_partkey % 3 = 0) from part")
def corpus_union(spark, sf_dir):
    """All rows of all tables: a bag, repeated rows count."""
    e = _examples(spark, sf_dir)
    both = corpus.joined(e, e.where("source = 'bootstrap'").drop("category"))
    return both.where("category is null").groupBy(F.lit("bootstrap").alias("source")).agg(F.count("*").alias("n")).unionByName(both.agg(F.lit("all").alias("source"), F.count("*").alias("n")))


_CACHE = "c as (select o_custkey as k, count(*) as hits, max(epoch(o_orderdate)) as created from orders group by 1)"


def _cache(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return o.groupBy(F.col("o_custkey").alias("cache_key")).agg(F.count("*").alias("hit_count"), F.max(F.col("o_orderdate").cast("timestamp").cast("double")).alias("created_at")).withColumn("accessed_at", F.col("created_at"))


@query(f"with {_CACHE}, r as (select c_custkey as k, 2 as more, 9e9::double as t from customer where c_custkey % 2 = 0) select c.k as cache_key, hits + coalesce(more, 0) as hit_count, greatest(created, coalesce(t, 0)) as accessed_at from c left join r using (k)")
def cache_reads(spark, sf_dir):
    c = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("cache_key"), F.lit(9e9).alias("t"))
    return corpus.hit_counts(_cache(spark, sf_dir), c.unionAll(c)).select("cache_key", "hit_count", "accessed_at")


@query(f"""with {_CACHE}, m as (select max(created) as now from c), t as (select k from c order by hits desc, k limit 10)
select count(*) as entries, count(*) filter (created >= now - 100 * 86400) as valid, sum(hits)::bigint as reads, round(sum(hits) / (sum(hits) + count(*)), 9) as hit_share, (select sum(k)::bigint from t) as most_read from c, m""")
def cache_statistics(spark, sf_dir):
    c = _cache(spark, sf_dir)
    now = c.agg(F.max("created_at")).first()[0]
    s = corpus.cache_statistics(c, F.lit(now), 100)
    return s.select("entries", "valid", "reads", F.round("hit_share", 9).alias("hit_share"), F.aggregate("most_read", F.lit(0).cast("long"), lambda a, x: a + x).alias("most_read"))


@query("select c_custkey as key, case when c_custkey % 4 = 0 then 'made' else 'cached' end as value from customer")
def filled_misses(spark, sf_dir):
    """Cached entries of the wanted keys and fresh ones for the rest."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    return stores.fill_misses(c, c.where("key % 4 <> 0").withColumn("value", F.lit("cached")), "key", lambda missing: missing.withColumn("value", F.lit("made")))


@query("select o_orderkey as key, case when o_orderkey % 3 = 0 then 'new' else 'old' end as value from orders where o_orderkey % 5 <> 0 or o_orderkey % 3 = 0")
def upserted(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    return stores.upsert(o.where("key % 5 <> 0").withColumn("value", F.lit("old")), o.where("key % 3 = 0").withColumn("value", F.lit("new")), ["key"])


@query("select o_orderkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 3 = 0)")
def invalidated_by_file(spark, sf_dir):
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("o_custkey"))
    return stores.invalidate(o, c, "o_custkey").select("o_orderkey")


@query("select p_partkey as part, md5('sig' || p_partkey || '|' || 'a,b' || '|' || 'm') as analysis, substr(sha256('sig' || p_partkey), 1, 16) as signature, sha256('m:text' || p_partkey) as embedding from part".replace("|| '|' || 'a,b'", "|| '|doc|' || 'a,b'"))
def cache_keys(spark, sf_dir):
    k = F.col("p_partkey").cast("string")
    sig = F.concat(F.lit("sig"), k)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), hashing.analysis_key(sig, F.lit("doc"), F.array(F.lit("b"), F.lit("a")), F.lit("m")).alias("analysis"), hashing.signature_hash(sig).alias("signature"), hashing.embedding_key(F.concat(F.lit("text"), k), F.lit("m")).alias("embedding"))


@query("""with w as (select p_partkey as id, 'missing_' || case p_partkey % 2 when 0 then 'params' else 'raises' end as issue, 'Document the param ' || p_partkey as text, p_size / 50.0::double as c, p_partkey % 3 = 0 as ready from part)
select id, round((1 + 0.2 + case issue when 'missing_params' then 1 else 0 end + c + ready::int) / 5, 9) as quality from w""")
def suggestion_quality(spark, sf_dir):
    """Five factors: text, completeness, the issue's own words, confidence, readiness."""
    k = F.col("p_partkey")
    text = F.concat(F.lit("Document the param "), k.cast("string"))
    issue = F.when(k % 2 == 0, "missing_params").otherwise("missing_raises")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.round(simulation.suggestion_quality(text, issue, F.col("p_size") / 50.0, k % 3 == 0, docs.completeness(text)), 9).alias("quality"))


@query(told("name kept", [(0, "make{k}", True), (0, "grow{k}", True), (1, "fetch{k}", True), (3, "build{k}", True), (8, "shared{k}", True)]))
def warming(spark, sf_dir):
    """High-value functions that the cache lacks."""
    f = parse.functions(gallery.files(spark, sf_dir)).withColumn("cache_key", F.col("function_id"))
    cached = f.where("name like 'inner%'").select("cache_key")
    return routing.to_warm(f, cached).select("name", F.lit(True).alias("kept"))


@query(told("name effort", [(0, "size{k}", 3), (0, "make{k}", 6), (0, "grow{k}", 8), (1, "fetch{k}", 10), (2, "walk{k}", 3), (2, "inner{k}", 2), (3, "build{k}", 6), (4, "good{n}", 2), (5, "good{k}", 2), (7, "describe{p}", 2), (8, "shared{k}", 5), (8, "__len__", 2), (9, "shared{p}", 2), (9, "lonely{k}", 2)]))
def request_effort(spark, sf_dir):
    """Requests dealt by type and file, the dearest first; the deal loses none."""
    f = parse.functions(gallery.files(spark, sf_dir)).select("function_id", "file_path", "name", F.lit("behavior").alias("analysis_type"), routing.effort(F.size("parameters"), F.col("end_line_number") - F.col("line_number") + 1, F.size("decorators"), F.col("is_async")).alias("effort"))
    return routing.scheduled(f, 4).select("name", "effort")


@query(f"with t as ({told('name', [(k, n) for k, n in gallery._ASKED])}) select count(*) as replies, round(count(*) filter (name not like 'build%') / count(*), 9) as success_rate, round(count(*) filter (name not like 'build%') / count(*), 9) as mean_issues, '401 unauthorized' as top_errors from t")
def reply_statistics(spark, sf_dir):
    p = parse.functions(gallery.files(spark, sf_dir)).where("raw_doc is not null")
    replies = routing.ask(routing.prompts(p, F.array(F.lit("behavior"))), services.answering, batch=4, pause=services.no_pause)
    s = routing.parse_statistics(replies, routing.answers(replies))
    return s.select("replies", F.round("success_rate", 9).alias("success_rate"), F.round("mean_issues", 9).alias("mean_issues"), F.array_join("top_errors", ",").alias("top_errors"))


@query("with x as (select p_brand as key, p_type as description, max(p_retailprice) as s from part group by all) select key, description, s, row_number() over (partition by key order by s desc, description) as rank from x qualify rank <= 5")
def top_descriptions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_brand").alias("key"), F.col("p_type").alias("description"), F.col("p_retailprice").alias("s"))
    return windows.most_similar(p, "key", "s")


_STEPS = """e as (select event_id, user_id, epoch(ts) as t, value, event_type, row_number() over (partition by user_id order by ts, event_id) as k from events)"""


@query(f"""with recursive {_STEPS}, r as (
 select user_id, k, event_id, case when value > 50 then t else -1e18 end as last, value > 50 as passed from e where k = 1 union all
 select e.user_id, e.k, e.event_id, case when e.value > 50 and e.t - r.last >= 86400 then e.t else r.last end, e.value > 50 and e.t - r.last >= 86400 from r join e on e.user_id = r.user_id and e.k = r.k + 1)
select event_id, passed from r""")
def alert_cooldown(spark, sf_dir):
    return monitors.fold(_events(spark, sf_dir, F.col("value")), "user_id", lambda: monitors.Cooldown(50.0, 86400.0), float)


@query(f"""with recursive {_STEPS}, r as (
 select user_id, k, event_id, t, 2::bigint as tokens, true as passed from e where k = 1 union all
 select e.user_id, e.k, e.event_id, e.t, g - (g >= 1)::int, g >= 1 from (select r.*, trunc(least(3, r.tokens + (n.t - r.t) * (1 / 36000::double)))::bigint as g, n.k as nk from r join e n on n.user_id = r.user_id and n.k = r.k + 1) r join e on e.user_id = r.user_id and e.k = r.nk)
select event_id, passed from r""")
def token_bucket(spark, sf_dir):
    return monitors.fold(_events(spark, sf_dir, F.lit(1)), "user_id", lambda: monitors.Bucket(1 / 36000, 3), int)


@query(f"""with recursive {_STEPS}, r as (
 select user_id, k, event_id, 'closed' as state, (event_type = 'error')::int as failures, case when event_type = 'error' then t else 0 end as last, true as passed from e where k = 1 union all
 select user_id, k, event_id, case when not through then state when ok then 'closed' when half or failures + 1 >= 2 then 'open' else state end, case when not through then failures when ok then case when half then 0 else greatest(0, failures - 1) end else failures + 1 end,
  case when through and not ok then t else last end, through
 from (select e.user_id, e.k, e.event_id, e.t, e.event_type <> 'error' as ok, r.state, r.failures, r.last, r.state <> 'open' or e.t - r.last >= 86400 as through, r.state = 'open' as half from r join e on e.user_id = r.user_id and e.k = r.k + 1) s)
select event_id, passed from r""")
def circuit_breaker(spark, sf_dir):
    return monitors.fold(_events(spark, sf_dir, F.col("event_type") != "error"), "user_id", lambda: monitors.Breaker(2, 86400.0), bool)


@query(f"""with recursive {_STEPS}, r as (
 select user_id, k, event_id, (event_type = 'error')::int as failures, case when event_type = 'error' and 1 >= 2 then t end as opened, true as passed from e where k = 1 union all
 select user_id, k, event_id, case when not through then failures when ok then 0 else failures + 1 end, case when not through then opened when ok then null when failures + 1 >= 2 then t else opened end, through
 from (select e.user_id, e.k, e.event_id, e.t, e.event_type <> 'error' as ok, r.failures, r.opened, r.opened is null or e.t - r.opened >= 86400 as through from r join e on e.user_id = r.user_id and e.k = r.k + 1) s)
select event_id, passed from r""")
def two_state_breaker(spark, sf_dir):
    return monitors.fold(_events(spark, sf_dir, F.col("event_type") != "error"), "user_id", lambda: embedding.TwoState(2, 86400.0), bool)


def _events(spark, sf_dir, x):
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.col("ts").cast("timestamp").cast("double").alias("t"), x.alias("x"))


@query("select r_regionkey as attempt, least(60, pow(2, r_regionkey))::double as delay from region")
def retry_delays(spark, sf_dir):
    return table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("attempt"), scores.retry_delay(F.col("r_regionkey")).alias("delay"))


@query("select p_partkey as id, round(1.0::double / (1 + (p_size / 10.0::double)), 9) as recency, round(0.4 * (p_size / 50.0::double) + 0.3 * 0.5 + 0.2 * 0.25 + 0.1, 9) as weighted from part")
def decay_and_weight(spark, sf_dir):
    now = F.lit(1.7e9)
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.round(scores.recency(now - F.col("p_size") * 86400, now), 9).alias("recency"), F.round(scores.weighted_score(F.col("p_size") / 50.0, F.lit(0.5), F.lit(0.25), F.lit(1.0)), 9).alias("weighted"))


@query("select p_partkey as part, case p_partkey % 3 when 0 then 'a' when 1 then 'b' end as found, case p_partkey % 3 when 0 then 0.9 when 1 then 0.48 end::double as confidence from part")
def fallback_chain(spark, sf_dir):
    """The first stage that has a result counts, its confidence scaled."""
    k = F.col("p_partkey")
    stage = lambda when, c, s: F.when(when, F.struct(F.lit(c).alias("confidence"), F.lit(s).alias("suggestion")))
    x = routing.with_fallback([(stage(k % 3 == 0, 0.9, "a"), 1.0), (stage(k % 3 <= 1, 0.6, "b"), 0.8)])
    return table(spark, sf_dir, "part").select(k.alias("part"), x.alias("x")).select("part", F.col("x.suggestion").alias("found"), F.round("x.confidence", 9).alias("confidence"))


@query("select p_partkey as part, p_partkey % 4 = 0 or p_size > 10 as routed from part")
def routed_by_settings(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = routing.needs_model(F.when(F.col("p_partkey") % 4 == 0, 0.5).otherwise(0.95), F.col("p_size"), F.lit(False), F.array().cast("array<string>"), EngineConfig())
    return p.select(F.col("p_partkey").alias("part"), r.alias("routed"))


@query("select p_partkey as part, 'shop.' || translate(lower(p_brand), '# ', '__') || '.part_' || p_partkey as module from part where p_partkey % 100 = 0")
def functions_by_module(spark, sf_dir):
    """The functions of a stated module: here, of every hundredth part its own."""
    f = synthetic.source_files(table(spark, sf_dir, "part"))
    known = matching.registry(parse.functions(f))
    wanted = f.where("p_partkey % 100 = 0").select(F.regexp_replace(F.translate("path", "/", "."), r"\.py$", "").alias("module"))
    return known.join(wanted, "module", "left_semi").select(F.regexp_extract("name", r"(\d+)$", 1).cast("long").alias("part"), "module")


@query("select p_partkey as id from part where p_size / 50.0 >= 0.2 and (p_partkey % 3 <> 1) and p_type like 'S%'")
def pasteable_or_none(spark, sf_dir):
    """The ranker's filter: what has no suggestion stays, what has one must be ready."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    x = p.select(k.alias("id"), (F.col("p_size") / 50.0).alias("confidence"), F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("ready"), F.left("p_type", F.lit(1)).alias("function_name"), F.lit("high").alias("severity"), F.lit("missing_params").alias("issue_type"))
    return aggregates.filtered(x, 0.2, ["high"], ["missing_params"], ready="or none", functions=["S"]).select("id")


@query("select p_partkey as id, round(p_size / 50.0::double, 9) as quality from part order by quality desc, id limit 20")
def best_suggestions(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), "p_size")
    return aggregates.by_quality(p, F.round(F.col("p_size") / 50.0, 9), "id").select("id", "quality").limit(20)


@query("select p_partkey as id, 'accepted' as source, 4 as quality_score, 1.0::double as improvement_score, 't' || p_partkey as text from part where p_partkey % 10 = 0")
def accepted_feed(spark, sf_dir):
    """Accepted suggestions as rows of the corpus."""
    k = F.col("p_partkey")
    a = table(spark, sf_dir, "part").where(k % 10 == 0).select(k.alias("function_id"), F.lit("f").alias("name"), F.lit("def f()").alias("signature"), F.lit("missing_params").alias("issue_type"), F.concat(F.lit("t"), k.cast("string")).alias("suggested_text"))
    return simulation.accepted_examples(a, F.lit(1.7e9)).select(F.col("example_id").alias("id"), "source", "quality_score", "improvement_score", F.col("docstring_content").alias("text"))


@query("""with c as (select event_type as kind, value * 10 as ms, user_id % 2 = 0 as hit, event_type = 'error' as error, 100 as tokens, 0.001::double as cost, epoch(ts) as t from events)
select coalesce(kind, 'all') as kind, count(*) as n, round(avg(ms), 6) as mean_ms, round(quantile_cont(ms, 0.5), 6) as p50, round(quantile_cont(ms, 0.95), 6) as p95, round(quantile_cont(ms, 0.99), 6) as p99, round(avg(hit::int), 9) as hit_rate, round(avg(error::int), 9) as error_rate, sum(tokens)::bigint as tokens,
 round(sum(cost), 6) as cost, round(count(*) / (max(t) - min(t)), 9) as per_second, round(0.4 * greatest(0, 1 - avg(ms) / 2000) + 0.3 * avg(hit::int) + 0.3 * greatest(0, 1 - avg(error::int) / 0.1), 6) as score from c group by rollup (kind)""")
def model_metrics(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    c = e.select(F.col("event_type").alias("kind"), (F.col("value") * 10).alias("ms"), (F.col("user_id") % 2 == 0).alias("hit"), (F.col("event_type") == "error").alias("error"), F.lit(100).alias("tokens"), F.lit(0.001).alias("cost"), F.col("ts").cast("timestamp").cast("double").alias("t"))
    m = aggregates.model_metrics(c)
    return m.select(F.coalesce("kind", F.lit("all")).alias("kind"), "n", "tokens", *(F.round(x, 6).alias(x) for x in ("mean_ms", "p50", "p95", "p99", "cost", "score")), *(F.round(x, 9).alias(x) for x in ("hit_rate", "error_rate", "per_second")))


@query("select count(*) as n, round(avg(p_size), 6) as quality, round(avg(p_retailprice), 6) as completeness, round(avg(nullif(p_size % 5, 0)), 6) as seconds from part")
def quality_metrics(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_size").alias("quality"), F.col("p_retailprice").alias("completeness"), (F.col("p_size") % 5).alias("seconds"))
    return aggregates.quality_metrics(p).withColumns({c: F.round(c, 6) for c in ("quality", "completeness", "seconds")})


@query("""with x as (select p_partkey as id, p_size % 100 / 100.0::double as a, 0.25::double as b, p_retailprice as m from part)
select id, case when a > b or a = b and 'parse' > 'match' then 'parse' else 'match' end as phase, case when greatest(a, b) > 0.5 then 'dominant' when greatest(a, b) > 0.4 then 'heavy' when greatest(a, b) > 0.3 then 'notable' when greatest(a, b) > 0.2 then 'mild' else 'even' end as weight,
 case when m > 1000 then 'high' when m > 500 then 'medium' else 'low' end as memory, (greatest(a, b) > 0.4)::int + (m > 1000)::int as n_advice from x""")
def load_profiles(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x = p.select(F.col("p_partkey").alias("id"), aggregates.load_profile({"parse": F.col("p_size") % 100 / 100.0, "match": F.lit(0.25)}, F.col("p_retailprice")).alias("x"))
    return x.select("id", "x.phase", "x.weight", "x.memory", F.size("x.advice").alias("n_advice"))


@query(told("name related", [(0, "size{k}", "make{k},grow{k}"), (0, "make{k}", "size{k},grow{k}"), (0, "grow{k}", "make{k},size{k}"), (2, "walk{k}", "inner{k}"), (2, "inner{k}", "walk{k}"), (8, "shared{k}", "__len__"), (8, "__len__", "shared{k}"), (9, "shared{p}", "lonely{k}"), (9, "lonely{k}", "shared{p}")]))
def related_functions(spark, sf_dir):
    r = routing.with_related(parse.functions(gallery.files(spark, sf_dir))).where(F.size("related") > 0)
    return r.select(F.substring_index("function_id", ":", -1).alias("name"), F.array_join("related", ",").alias("related"))


@query(told("path name", [(r[0], r[1], r[3]) for r in gallery.FUNCTIONS]) + " union all " + told("path name", [(r[0], "copy/" + r[1], r[3]) for r in gallery.FUNCTIONS]))
def parsed_once(spark, sf_dir):
    """Copies of a file are parsed once and come back under every path."""
    f = gallery.files(spark, sf_dir).select("path", "content")
    both = f.unionByName(f.select(F.concat(F.lit("copy/"), "path").alias("path"), "content"))
    return parse.functions_once(both).select(F.col("file_path").alias("path"), "name")


@query("select p_partkey as part, case p_partkey % 3 when 0 then '' when 1 then 'no kinds' else 'unknown kinds: x,no source,threshold out of range' end as problems from part")
def request_problems(spark, sf_dir):
    k = F.col("p_partkey")
    kinds = F.when(k % 3 == 0, F.array(F.lit("types"))).when(k % 3 == 1, F.array().cast("array<string>")).otherwise(F.array(F.lit("x")))
    x = routing.request_problems(kinds, F.when(k % 3 != 2, "def f(): 0"), F.when(k % 3 != 2, 0.5).otherwise(1.5))
    return table(spark, sf_dir, "part").select(k.alias("part"), F.array_join(x, ",").alias("problems"))


@query("select p_partkey as part, 'behavior+types: ' || p_size || ' issues, ' || p_partkey || ' tokens, ' || round(p_retailprice)::int || ' ms' as line from part")
def request_lines(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), routing.summary(F.array(F.lit("behavior"), F.lit("types")), F.col("p_size"), F.col("p_partkey"), F.col("p_retailprice")).alias("line"))


@query(told("name skeleton", [
    (0, "make{k}", "Make{k}.\n\nArgs:\n    cls: \n    size (int): \n\nReturns:\n    'Box{k}': "), (4, "good{n}", "Good{n}.\n\nArgs:\n    x: "), (8, "shared{k}", "Shared{k}.\n\nArgs:\n    value (float): \n    lable (str): \n\nReturns:\n    float: "),
]))
def doc_skeletons(spark, sf_dir):
    f = parse.functions(gallery.files(spark, sf_dir)).where("name like 'make%' or file_path like 'pkg/sub/%' or file_path like 'lib/%' and name like 'shared%'")
    return f.select("name", suggestions.skeleton(F.col("name"), F.col("parameters"), F.col("return_type")).alias("skeleton"))


@query(told("name own told", [(8, "shared{k}", "lable", "label")]))
def renamed_in_gallery(spark, sf_dir):
    """Documented names that the signature lacks, with the most alike undocumented one."""
    x = gallery.pairs(spark, sf_dir).where("raw_doc is not null").select("function_id", F.transform("parameters", lambda p: p["name"]).alias("own"), F.transform("doc.parameters", lambda p: p["name"]).alias("told"))
    return retrieval.renamed_parameters(x).select(F.substring_index("function_id", ":", -1).alias("name"), F.col("own_name").alias("own"), F.col("told_name").alias("told"))
