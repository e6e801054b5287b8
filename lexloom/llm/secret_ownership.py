"""Secrets, judged by who else has them.

A credential that belongs to someone appears in the repositories of one owner; an example
from a manual is copied widely. Candidates are the matches of three fixed patterns and, where
these found nothing, of weaker signs: long mixed tokens, passwords in addresses, bearer
headers, bodies of private keys, and quoted values of names that end like a secret's. Each
candidate's value is hashed, hashes are counted by distinct repository and distinct owner over
the whole corpus, and a value that few owners have, in few repositories, looks live.

Ownership decides what is added to the spans of the fixed patterns, which always stay: the
weaker candidates that look live, and as ``live`` the value of each fixed one that does.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

KINDS = ("assign", "access", "hex", "token", "url", "bearer", "pem", "named", "live")
BASE, LIVE = 3, 8
#: Fixed patterns and the least lengths of what they match (assign: of its value).
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}")
#: Weaker signs: kind, a part without which there is none, the pattern and its group.
URL = re.compile(r"""://[^\s/:@'"<>]*:([^\s/@'"<>]{8,})@""")
BEARER = re.compile(r"(?<!\w)(?:bearer|basic)\x20+([A-Za-z0-9._~+/=-]{12,})", re.IGNORECASE | re.ASCII)
NAMED = re.compile(r"""(?:key|auth|credentials?|pass|pwd)["']?\x20*[:=]\x20*["']([^"'\s]{12,})["']""", re.IGNORECASE | re.ASCII)
PEM = ("-----BEGIN ", "PRIVATE KEY-----", "-----END ")


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the fixed patterns, by start, then kind. A value is what
    the span ends with.

    Runs of hex digits are maximal, so asking for 16 in the pattern loses none; for assign
    a match that is too short still uses up its text."""
    out = []
    lower = text.lower()
    if any(k in lower for k in KEYS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def extra_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Values of the weaker signs, of which none touches a base span or one of a plainer sign."""
    mixed = lambda v: any(c.isdigit() for c in v) and v.upper() != v and v.lower() != v
    found = [(m.start(), 3, m.end(), m[0]) for m in TOKEN.finditer(text) if mixed(m[0])]
    lower = text.lower()
    if "://" in text and "@" in text:
        found += [(m.start(1), 4, m.end(1), m[1]) for m in URL.finditer(text)]
    if "bearer" in lower or "basic" in lower:
        found += [(m.start(1), 5, m.end(1), m[1]) for m in BEARER.finditer(text)]
    found += key_bodies(text)
    if any(k in lower for k in ("key", "auth", "credential", "pass", "pwd")):
        found += [(m.start(1), 7, m.end(1), m[1]) for m in NAMED.finditer(text)]
    if not found:
        return []
    out, taken = [], sorted((s, e) for s, _, e, _ in base)
    for kind in (6, 4, 5, 7, 3):  # what says most about itself first
        mine = free_of(sorted(x for x in found if x[1] == kind), taken)
        taken = sorted(taken + [(s, e) for s, _, e, _ in mine])
        out += mine
    return out


def key_bodies(text: str) -> list[tuple[int, int, int, str]]:
    """Bodies of private keys in text form; the value is without white space."""
    out, at = [], text.find(PEM[0])
    while at >= 0:
        head = text.find(PEM[1], at, at + 60)
        end = text.find(PEM[2], at)
        if end < 0:
            break
        start = head + len(PEM[1])
        if 0 <= head < end and (value := "".join(text[start:end].split())):
            out.append((start, 6, end, value))
        at = text.find(PEM[0], end)
    return out


def free_of(spans: list[tuple[int, int, int, str]], taken: list[tuple[int, int]]) -> list[tuple[int, int, int, str]]:
    """Those of the sorted spans that overlap none of the sorted taken ones."""
    out, at, reach = [], 0, -1
    for x in spans:
        while at < len(taken) and taken[at][0] < x[2]:
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= x[0]:
            out.append(x)
    return out


def joined(spans: Iterable[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


FOUND = "id_text string, repo string, owner string, n_assign long, n_access long, n_hex long, base_sha256 string, found array<struct<start:int, kind:int, end:int, value:int, hash:long>>"


def candidates(docs: DataFrame, source: str = "source") -> DataFrame:
    """documents -> one row each with its spans; a value's hash is the first 8 bytes of its
    SHA-256. The owner is what the source has before its first slash; the repository is the
    source if it has a slash, else the document itself."""
    common.small_batches(docs.sparkSession)

    @common.tidy
    def find(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for name, where, text in zip(b["id_text"], b["source"], b["text"], strict=True):
                base = base_spans(text)
                every = base + extra_spans(text, base)
                count = [sum(k == i for _, k, _, _ in base) for i in range(3)]
                listed = joined(x[:3] for x in base)
                found = [{"start": s, "kind": k, "end": e, "value": e - len(v) if k < BASE else s, "hash": int.from_bytes(hashlib.sha256(v.encode()).digest()[:8], "little", signed=True)} for s, k, e, v in every]
                rows.append((name, where if "/" in where else f"document {name}", where.split("/")[0], *count, hashlib.sha256(listed.encode()).hexdigest(), found))
            yield pd.DataFrame(rows, columns=["id_text", "repo", "owner", "n_assign", "n_access", "n_hex", "base_sha256", "found"])

    whole = docs.select(F.col("doc_id").cast("string").alias("id_text"), F.coalesce(F.col(source), F.lit("")).alias("source"), F.coalesce("text", F.lit("")).alias("text"))
    return whole.mapInPandas(find, FOUND)


def judged(each: DataFrame, max_owners: int, max_repos: int) -> DataFrame:
    """(row, repo, owner, start, kind, end, hash) with owners, repos and live: a value looks
    live if few owners have it, and each of them, on average, in few repositories. Hashes
    are counted by (hash, repository) first, so a value that a third of all rows have meets
    in a task only once for each repository and map task, and sums of these go on."""
    repos = each.select("hash", "repo", "owner").distinct()
    by_owner = repos.groupBy("hash", "owner").agg(F.count("*").alias("repos"))
    counts = by_owner.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("repos").alias("repos"))
    live = (F.col("owners") <= max_owners) & (F.col("repos") <= max_repos * F.col("owners"))
    return each.join(counts, "hash").withColumn("live", live)


@common.scratch()
def scan(docs: DataFrame, source: str = "source", max_owners: int = 2, max_repos: int = 100) -> DataFrame:
    """documents (doc_id, text, source, ...) -> doc_id, n_assign, n_access, n_hex,
    base_sha256, spans, n_live, n_example, most_owners, live: one row per row.

    spans: the fixed patterns' and what ownership adds; live lists all candidates that look live;
    most_owners: of the document's most widely held value (0 without any). Offsets are code
    points. Null and empty texts have no spans; documents without a source have one owner
    with the empty name. Only spans and hashes are shuffled, not texts. Rows that repeat are rows of
    their own, but no repositories of their own; an empty table gives no rows."""
    found = common.store(candidates(docs, source).withColumn("row", F.monotonically_increasing_id()), "secret-spans")
    each = found.where(F.size("found") > 0).select("row", "repo", "owner", F.explode("found").alias("c")).select("row", "repo", "owner", "c.*")
    span = F.struct("start", "kind", "end", "value")
    by_row = judged(each, max_owners, max_repos).groupBy("row").agg(
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"), F.max("owners").alias("most_owners"), F.sort_array(F.collect_list(F.when(F.col("live"), span))).alias("live_spans")
    )
    told = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1), x["start"], x["end"])), ",")
    plain = lambda s, k, e: F.struct(s.alias("start"), k.alias("kind"), e.alias("end"))
    base = F.transform(F.filter("found", lambda x: x["kind"] < BASE), lambda x: plain(x["start"], x["kind"], x["end"]))
    extra = F.transform("live_spans", lambda x: F.when(x["kind"] < BASE, plain(x["value"], F.lit(LIVE), x["end"])).otherwise(plain(x["start"], x["kind"], x["end"])))
    cols = [F.col("id_text").cast("long").alias("doc_id"), "n_assign", "n_access", "n_hex", "base_sha256"]
    some = found.where(F.size("found") > 0).join(by_row, "row").select(*cols, told(F.sort_array(F.array_distinct(F.concat(base, extra)))).alias("spans"), "n_live", "n_example", "most_owners", told(F.col("live_spans")).alias("live"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("n_live", "n_example", "most_owners")]
    none = found.where(F.size("found") == 0).select(*cols, F.lit("").alias("spans"), *zero, F.lit("").alias("live"))
    return common.keep(common.store(some.unionAll(none), "secret-result"))


@common.scratch()
def redact(docs: DataFrame, source: str = "source", max_owners: int = 2, max_repos: int = 100) -> DataFrame:
    """docs with each live-looking span replaced by ``[REDACTED]`` and n_chars (if there)
    the new length in code points. Overlapping spans are replaced as one. All rows and
    columns stay, whatever their names; null texts stay null. The rows are numbered and
    stored first; to the texts only the spans of those rows are joined that have live ones."""
    row, live = common.free_name(docs, "row"), common.free_name(docs, "live_spans")
    numbered = common.keep(common.store(docs.withColumn(row, F.monotonically_increasing_id()), "secret-input"))
    found = candidates(numbered.select(F.col(row).alias("doc_id"), F.col(source).alias("source"), "text")).where(F.size("found") > 0)
    each = found.select(F.col("id_text").cast("long").alias("row"), "repo", "owner", F.explode("found").alias("c")).select("row", "repo", "owner", "c.start", "c.end", "c.kind", "c.hash")
    each = common.store(each, "secret-each")
    spans = judged(each, max_owners, max_repos).where("live").groupBy("row").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(live))
    spans = common.keep(common.store(spans.withColumnRenamed("row", row), "secret-live"))
    out = numbered.join(common.few(spans), row, "left").withColumn("text", F.when(F.col(live).isNull(), F.col("text")).otherwise(masked(F.col("text"), F.col(live))))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(live).isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*docs.columns)


def masked(text: Column, spans: Column) -> Column:
    """text without the sorted spans [start, end), of which those that overlap go as one."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit(0).alias("at"))

    def step(done: Column, span: Column) -> Column:
        fresh = span["start"] >= done["at"]
        parts = F.when(fresh, F.concat(done["parts"], F.array(F.substr(text, done["at"] + 1, span["start"] - done["at"]), F.lit("[REDACTED]")))).otherwise(done["parts"])
        return F.struct(parts.alias("parts"), F.greatest(done["at"], span["end"]).alias("at"))

    return F.aggregate(spans, start, step, lambda done: F.concat(F.array_join(done["parts"], ""), F.substr(text, done["at"] + 1, F.length(text))))
