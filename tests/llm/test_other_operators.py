from __future__ import annotations

import math
import os
import random
import re
import shutil
import subprocess
import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexloom.llm import common, link_trust, pivot_join, queries, secret_ownership
from lexloom.sources import shared

from ..conftest import rows_of

REPO = Path(__file__).resolve().parents[2]


def vectors():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(40, 8))
    rows = [(i, base[i % 40] + rng.normal(scale=0.02 if i % 3 else 0.2, size=8)) for i in range(300)]
    rows = [(i, v.tolist()) for i, v in rows]
    rows += [(900, rows[0][1]), (901, [2 * x for x in rows[0][1]]), (902, [1e300 * x for x in rows[1][1]]), (902, rows[1][1])]
    rows += [(903, None), (904, [0.0] * 8), (905, [1.0] * 7 + [None]), (906, [math.nan] + [1.0] * 7), (907, [math.inf] + [1.0] * 7), (908, []), (None, rows[2][1])]
    return rows


def brute(rows):
    ok = [(i, np.array(v, float)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    u = np.array([v / np.abs(v).max() for _, v in ok])
    u /= np.linalg.norm(u, axis=1)[:, None]
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    low = np.array([2**60 if i is None else i for i, _ in ok])
    while True:
        new = np.minimum(low, np.where(hit, low[None], 2**61).min(1))
        if (new == low).all():
            break
        low = new
    out = [(i, int(n), int(c)) for (i, _), n, c in zip(ok, hit.sum(1), low, strict=True)]
    names = [i for i, _ in ok]
    return out + [(i, 0, i) for i, v in rows if not (v and None not in v and np.isfinite(np.array(v, float)).all() and any(v))], names


def test_bands_cover_every_bin():
    rows = [{"cell": c, "bin": b, "n": 3 + 40 * (b == 5), "low": b / 128, "high": (b + 0.9) / 128} for c in (0, 2) for b in range(2, 9)]
    got = pivot_join.bands(rows, 10)
    assert got["cell"].tolist() == [0, 0, 0, 2, 2, 2] and got["first"].tolist() == [2, 5, 6, 2, 5, 6]
    for x in rows:
        assert ((got["cell"] == x["cell"]) & (got["low"] <= x["low"]) & (got["high"] >= x["high"])).sum() == 1
    assert got["parts"].max() == 5


def test_blocks_by_distance_lose_nothing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, (rng.normal(size=6) + 3 * np.eye(6)[i % 6] * (i % 2)).tolist()) for i in range(500)]
    rows += [(1000 + i, (np.array(rows[i][1]) + rng.normal(scale=0.05, size=6)).tolist()) for i in range(200)] + [(2000, [1.0, 2.0]), (2001, [1.0, 2.01]), (2002, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "cls long, v array<double>, times int")
    got = {r["cls"]: r["n_links"] for r in pivot_join.links(df, 0.95, 7, block=20).collect()}
    long, short = [x for x in rows if len(x[1]) == 6], [x for x in rows if len(x[1]) == 2]
    for some in (long, short):
        u = np.array([v for _, v in some])
        u /= np.linalg.norm(u, axis=1)[:, None]
        for (i, _), n in zip(some, (u @ u.T >= 0.95).sum(1) - 1, strict=True):
            assert got[i] == n
    assert len(got) == len(rows)


@pytest.mark.parametrize("pivots", [None, 1, 20])
def test_pivot_join(spark, pivots):
    rows = vectors()
    df = spark.createDataFrame([(i, v, 0, 1) for i, v in rows], "vec_id long, embedding array<double>, label int, cls int").repartition(3)
    got = [(r["vec_id"], r["n_links"], r["component_id"]) for r in pivot_join.near_vectors(df, pivots=pivots).collect()]
    key = lambda x: (x[0] is None, x)
    assert sorted(got, key=key) == sorted(brute(rows)[0], key=key)
    assert pivot_join.near_vectors(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    got = {r["node"]: r["root"] for r in common.components(edges, "test").collect()}
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


def host_path(url):
    m = re.match(r".*?://([^/?#]*)([^?#]*)", url or "", re.DOTALL)
    return (m[1].translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")), m[2]) if m else ("", "")


def test_rules(spark):
    urls = ["http://A.Example.com/en/1", "http://www.example.com/en/x?y", "http://x.net/es/", "http://net/fr/a", "http://x.net/de/", "http://com", "http://com/", "http://notcom/", "nothing", None, "", "https://x.org:80/a#b/c", "http://example.com/en", "a://b://c.com/d"]
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(urls)] + [(4, urls[4], None, "x")], "page_id long, url string, html string, host string")
    got = link_trust.judge(df).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        host, path = host_path(urls[r["page_id"]])
        fit = [(v, h + p) for v, h, p in link_trust.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, key=lambda x: len(x[1]), default=(None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == (best[0] or "allow")
    assert link_trust.judge(df.limit(0)).count() == 0


@pytest.mark.parametrize("linkers", [1, 2, 7])
def test_hosts_that_mainly_link_to_blocked_ones_are_blocked(spark, linkers):
    to = lambda *hosts: "".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [("http://bad.net/es/a", to("deep.org")), ("http://good.com/", to("fine.org")), ("http://clean.org/", "")]
    for i in range(linkers):
        rows += [(f"http://farm{i}.org/", to("bad.net")), (f"http://main{i}.org/", to("bad.net", "bad.net", "bad.net", f"own{i}.org")), (f"http://far{i}.org/", to(f"farm{i}.org"))]
        rows += [(f"http://own{i}.org/", ""), (f"http://half{i}.org/", to("bad.net", "clean.org"))]
    rows += [("http://fine.org/", to("bad.net")), ("http://deep.org/", "")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string")
    got = {r["host"] for r in link_trust.judge(df).collect() if r["verdict"] == "block"}
    assert got == {"bad.net"} | {f"{k}{i}.org" for k in ("farm", "main", "far") for i in range(linkers)}


def test_distrust_goes_against_links_and_trust_along_them(spark):
    link = lambda *hosts: " ".join(f'<a href="http://{h}/">' for h in hosts)
    rows = [(1, "http://bad.net/es/1", ""), (2, "http://farm.org/", link("bad.net")), (3, "http://far.org/", link("farm.org")), (4, "http://good.com/", link("fine.org")), (5, "http://fine.org/", link("good.com", "bad.net")), (6, "http://alone.org/", '<a href="/x">'), (7, "http://bad.net/xx", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    edges = {(r["src"], r["dst"]) for r in link_trust.host_edges(df).collect()}
    assert edges == {("farm.org", "bad.net"), ("far.org", "farm.org"), ("good.com", "fine.org"), ("fine.org", "good.com"), ("fine.org", "bad.net")}
    seeds = spark.createDataFrame([(h, float(h == "good.com"), float(h == "bad.net")) for h in ("bad.net", "farm.org", "far.org", "good.com", "fine.org", "alone.org")], "host string, trust double, distrust double")
    got = {r["host"]: (r["trust"], r["distrust"]) for r in link_trust.propagate(link_trust.host_edges(df), seeds, rounds=60).collect()}
    names = sorted(got)
    out = {a: [b for x, b in edges if x == a] for a in names}
    into = {a: [x for x, b in edges if b == a] for a in names}
    t, d = dict.fromkeys(names, 0.0), dict.fromkeys(names, 0.0)
    for _ in range(60):
        t = {a: 0.15 * (a == "good.com") + 0.85 * sum(t[b] / len(out[b]) for b in into[a]) for a in names}
        d = {a: 0.15 * (a == "bad.net") + 0.85 * sum(d[b] / len(into[b]) for b in out[a]) for a in names}
    assert all(abs(got[a][0] - t[a]) < 1e-4 and abs(got[a][1] - d[a]) < 1e-4 for a in names)
    assert got["farm.org"][1] > 0 and got["far.org"][1] > 0 and got["fine.org"][0] > 0 and got["alone.org"] == (0, 0)


def ends(out, seeds, damping=0.85):
    """For each host the chances that its own walk ends on blocked and on allowed pages, by
    following all walks from that host alone: an independent form of what the query computes."""
    got = {}
    for side, along in ((1, out), (0, {a: [x for x in out for b in out[x] if b == a] for a in out})):
        for host in out:
            mass, ended = {host: 1.0}, 0.0
            for _ in range(400):
                after = {}
                for a, m in mass.items():
                    ended += m * seeds[a][side]
                    left = m * (1 - seeds[a][0] - seeds[a][1]) * damping
                    for b in along[a]:
                        after[b] = after.get(b, 0.0) + left / len(along[a])
                mass = after
            got.setdefault(host, {})[side] = ended
    return got


def rank(out, seeds, side, damping=0.85):
    """Personalised PageRank from the seeds, by repeated multiplication."""
    into = {a: [x for x in out for b in out[x] if b == a] for a in out}
    to, back = (out, into) if side == 0 else (into, out)
    p = {a: 0.0 for a in out}
    for _ in range(400):
        p = {a: (1 - damping) * seeds[a][side] + damping * sum(p[b] / len(to[b]) for b in back[a]) for a in out}
    return p


@pytest.mark.parametrize("seed", range(3))
def test_verdicts_over_links_by_following_every_walk(spark, seed):
    rng = random.Random(seed)
    hosts = [f"h{i}.org" for i in range(14)] + ["good.com", "fine.com", "bad.net", "worse.net", "mixed.net"]
    pages = []
    for h in hosts:
        for i in range(rng.randrange(1, 4)):
            path = "/es/" if h in ("bad.net", "worse.net") or h == "mixed.net" and i else "/x/"
            to = [rng.choice(hosts + ["bad.net", "worse.net"] * 4) for _ in range(rng.randrange(4))]
            pages.append((len(pages), f"http://{h}{path}{i}", "".join(f'<a href="http://{t}/">' for t in to), h, to))
    out = {h: [t for p in pages if p[3] == h for t in p[4] if t != h] for h in hosts}
    fit = lambda p: "allow" if p[3].endswith(".com") else "block" if "/es/" in p[1] else None
    share = lambda h, v: sum(fit(p) == v for p in pages if p[3] == h) / sum(p[3] == h for p in pages)
    seeds = {h: (share(h, "allow"), share(h, "block")) for h in hosts}
    walk, trust, distrust = ends(out, seeds), rank(out, seeds, 0), rank(out, seeds, 1)
    df = spark.createDataFrame([p[:3] for p in pages], "page_id long, url string, html string")
    shares = {r["host"]: (r["trust"], r["distrust"]) for r in link_trust.propagate(link_trust.host_edges(df), spark.createDataFrame([(h, *s) for h, s in seeds.items()], "host string, trust double, distrust double"), rounds=120, mean=True).collect()}
    assert all(abs(shares[h][0] - walk[h][0]) < 1e-6 and abs(shares[h][1] - walk[h][1]) < 1e-6 for h in hosts)
    got = {r["page_id"]: r["verdict"] for r in link_trust.judge(df).collect()}
    for p in pages:
        said = "block" if walk[p[3]][1] - walk[p[3]][0] > 0.5 and distrust[p[3]] > trust[p[3]] else "allow"
        assert got[p[0]] == (fit(p) or said), p
    assert any(got[p[0]] == "block" and not fit(p) for p in pages)


def test_secrets_by_counting_owners_by_hand(spark):
    """Patterns and counts written out here, not taken from the module."""
    rng = random.Random(1)
    values = ["".join(rng.choice("GhJkLmNpQrStUvWxYz") + str(rng.randrange(10)) for _ in range(11)) for _ in range(8)] + [f"{rng.getrandbits(100):025x}" for _ in range(3)]
    forms = [
        ("assign", "api_key = '{v}'", r"(?i)(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("url", "see https://me:{v}@host.org/x", r"://[^\s/:@'\"<>]*:([^\s/@'\"<>]+)@"),
        ("bearer", "Authorization: Bearer {v}", r"Bearer ([A-Za-z0-9]+)"), ("named", 'my_credentials: "{v}!x"', r'my_credentials: "([^"]+)"'), ("pem", "-----BEGIN PRIVATE KEY-----\n{v}\n{v}\n-----END PRIVATE KEY-----", r"KEY-----(\s[^-]+)-----END"), ("token", "see {v} there", r"see (\S+) there"),
    ]
    docs = []
    for i in range(160):
        kind, form, pattern = rng.choice(forms)
        docs.append((i, f"é {form.replace('{v}', rng.choice(values))} .", f"own{rng.choice([0, 0, 0, 1, 2, 3, i])}/r{rng.randrange(3)}", kind, pattern))
    found = {}
    for i, text, source, kind, pattern in docs:
        m = re.search(pattern, text)
        value = "".join(m[1].split()) if kind == "pem" else m[1]
        hexes = [(h.start(), h.end(), h[0]) for h in re.finditer("[0-9a-f]{16,}", text)]
        base = [("assign", m.start(), m.end(), value, m.start(1))] if kind == "assign" else []
        base += [("hex", s, e, v, s) for s, e, v in hexes]
        free = not any(s < m.end(1) and m.start(1) < e for _, s, e, _, _ in base)
        found[i] = (base, [(kind, m.start(1), m.end(1), value)] if kind != "assign" and free else [])
    owners = {}
    for i, _, source, _, _ in docs:
        for x in (*found[i][0], *found[i][1]):
            owners.setdefault(x[3], {}).setdefault(source.split("/")[0], set()).add(source)
    live = {v for v, who in owners.items() if len(who) <= 2 and sum(map(len, who.values())) <= 100 * len(who)}
    order = {k: n for n, k in enumerate(("assign", "access", "hex", "token", "url", "bearer", "pem", "named", "live"))}
    frame = spark.createDataFrame([d[:3] for d in docs], "doc_id long, text string, source string")
    seen = set()
    for r in secret_ownership.scan(frame).collect():
        base, more = found[r["doc_id"]]
        spans = {(s, order[k], e) for k, s, e, *_ in base} | {(at, order["live"], e) for _, _, e, v, at in base if v in live} | {(s, order[k], e) for k, s, e, v in more if v in live}
        names = list(order)
        assert r["spans"] == ",".join(f"{names[k]}:{s}:{e}" for s, k, e in sorted(spans)), docs[r["doc_id"]]
        assert r["n_live"] == sum(x[3] in live for x in (*base, *more)) and r["n_example"] == sum(x[3] not in live for x in (*base, *more))
        seen |= {names[k] for _, k, _ in spans}
    assert {"assign", "live", "hex", "url", "bearer", "named", "pem", "token"} <= seen


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(name, spark, sf_dir, duck):
    assert rows_of(queries.QUERIES[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(queries.ORACLES[name]).df())


def test_pipeline_stages_keep_their_promises(spark, sf_dir):
    import corpus_pipeline as p

    docs = queries.table(spark, sf_dir, "documents")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in p.STAGES[:-1]:
        after = common.store(stage(spark, docs, sf_dir), "test-stage")
        assert after.columns == docs.columns
        rows = after.collect()
        ids = [r["doc_id"] for r in rows]
        assert len(set(ids)) == len(ids) and set(ids) <= {r["doc_id"] for r in docs.select("doc_id").collect()}
        if name == "secret scans":
            assert len(rows) == docs.count()
        elif name != "toxicity":
            assert all(seen[r["doc_id"]] == r["text"] for r in rows)
        docs = after
    packed = p.STAGES[-1][1](spark, docs, sf_dir)
    assert {r["doc_id"] for r in packed.collect()} == set(ids)


CLASHES = "_row long, row long, Row_ long, _live string, live_spans string, score double, _text string, node long, block string, group long, cls long, root long, id_text string"


def test_stages_take_nulls_repeats_clashing_names_and_empty_tables(spark, sf_dir):
    import corpus_pipeline as p

    columns = [f.split(" ")[0] for f in CLASHES.split(", ")]
    more = [F.lit(7).cast(f.split(" ")[1]).alias(c) for c, f in zip(columns, CLASHES.split(", "), strict=True)]
    docs = queries.table(spark, sf_dir, "documents").limit(60)
    odd = [(None, None), (None, "x"), (-1, None), (-2, ""), (-3, " "), (-4, "a" * 1_000_000), (-4, "a" * 1_000_000), (-5, "password=abcdefghijkl9 é"), (-5, "password=abcdefghijkl9 é")]
    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in odd], docs.schema)
    docs = docs.unionByName(odd).select("*", *more)
    for name, work in p.STAGES:
        after = work(spark, docs, sf_dir)
        rows = common.store(after, "test-stage").collect()
        if name != "best-fit packing":
            assert after.columns == docs.columns and all(r["_row"] == r["row"] == r["Row_"] == 7 and r["score"] == 7.0 for r in rows), name
        texts = [r["text"] for r in rows] if name != "best-fit packing" else []
        if name == "exact dedup":
            assert sum(not t for t in texts) == 1 and texts.count("a" * 1_000_000) == 1
        elif name == "secret scans":
            assert len(rows) == docs.count() and texts.count("[REDACTED] é") == 2 and None in texts
        assert work(spark, docs.limit(0), sf_dir).count() == 0, name


def left_behind(spark, before=frozenset()):
    root = Path(shared.run_dir(spark).removeprefix("file://"))
    return set(root.iterdir()) - before


def stems(paths):
    return {x.name.rsplit("-", 1)[0] for x in paths}


def test_only_the_result_of_the_pipeline_is_left(spark, sf_dir):
    import corpus_pipeline as p

    before = left_behind(spark)
    assert p.run(spark, sf_dir).count()
    assert stems(left_behind(spark, before)) == {"best-fit-packing"}


def test_a_stage_leaves_the_results_of_others_alone(spark, sf_dir):
    import corpus_pipeline as p

    docs = queries.table(spark, sf_dir, "documents")
    a = p.drop_copies(spark, docs, sf_dir)
    b = p.drop_near_copies(spark, a, sf_dir)
    c = p.mask_secrets(spark, b, sf_dir)
    assert a.count() >= b.count() == c.count() > 0


def test_two_pipelines_in_one_driver(spark, sf_dir):
    from concurrent.futures import ThreadPoolExecutor

    import corpus_pipeline as p

    one = sorted(map(tuple, p.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect()))
    with ThreadPoolExecutor(2) as pool:
        both = list(pool.map(lambda _: sorted(map(tuple, p.run(spark, sf_dir).select("doc_id", "piece", "ids_crc32").collect())), range(2)))
    assert both == [one, one]


@pytest.mark.parametrize("name, kept", [
    ("op1_noisy_channel", set()), ("op4_radix_dedup", {"radix-groups"}), ("op5_minhash_dedup", {"minhash-result"}), ("op7_pivot_join", {"vector-result"}), ("op8_secret_ownership", {"secret-result"}),
    ("op9_packing", {"pieces-ranged"}), ("op10_link_trust", {"hosts-blocked"}), ("op11_ball_tree", {"ball-clusters"}), ("op13_conversation_repair", {"turns-repaired"}),
])
def test_operators_leave_what_their_results_read(name, kept, spark, sf_dir):
    before = left_behind(spark)
    assert queries.QUERIES[name](spark, sf_dir).count()
    assert stems(left_behind(spark, before)) == kept


def test_larger_tables_than_few_are_joined_by_a_shuffle(spark, sf_dir, monkeypatch):
    from lexloom.llm import minhash_dedup, radix_dedup

    docs = queries.table(spark, sf_dir, "documents")
    both = []
    for limit in (common.FEW, 0):
        monkeypatch.setattr(common, "few", lambda df, limit=limit: F.broadcast(df) if df.count() <= limit else df)
        both.append([sorted(f(docs).select("doc_id", "text").collect(), key=str) for f in (radix_dedup.drop_duplicates, minhash_dedup.drop_near_duplicates, secret_ownership.redact)])
    assert both[0] == both[1]


@pytest.mark.parametrize("master, named", [("spark://host:7077", None), ("spark://host:7077", "hdfs://a/b/"), ("local[2]", None), ("local-cluster[1,1,1024]", None)])
def test_a_cluster_needs_a_shared_folder(master, named):
    from unittest.mock import MagicMock

    s = MagicMock()
    s.conf.get.return_value = None
    s.sparkContext.master = master
    found = s.sparkContext._jsc.sc.return_value.getCheckpointDir.return_value
    found.isDefined.return_value, found.get.return_value = named is not None, named
    if named or master == "local[2]":
        assert common.shared_dir(s).startswith("hdfs://a/b" if named else "file:///")
    else:
        with pytest.raises(RuntimeError):
            common.shared_dir(s)


def test_the_rest_works_without_this_folder(tmp_path):
    shutil.copytree(REPO, tmp_path / "r", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "spark-warehouse"))
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(k.startswith('op1_') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    env = {**os.environ, "PYTHONPATH": str(tmp_path / "r")}
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "r", env=env).returncode == 0
