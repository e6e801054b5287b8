"""Exact duplicates by distributed MSD radix partitioning.

Documents are split by successive bytes of their texts, most significant first: all rows of
a node share the bytes read so far. A round reads the next block of each text still in
play (64 bytes, then four times as many each round), counts every (node, block), and sends
each row on to the node that its block names. A row leaves when it is alone in its node, or
when its text has ended there: then all rows of the node are the same text. Equality is
decided by the bytes themselves; no digest takes part. (text_sha256 is an output only.)

Counting combines rows before the shuffle, so a node that holds a third of all rows costs
one row for each task. Sending rows on is an inner join against one row for each node,
which adaptive execution splits where a node is hot. Rounds grow with the logarithm of the
longest repeated text, and only documents that share all bytes so far with another remain.
"""

from __future__ import annotations

import functools
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common


def normalised(text="text"):
    """Lower-cases A-Z only; null counts as empty."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


@common.scratch()
def duplicate_groups(docs: DataFrame, first_block: int = 64, growth: int = 4) -> DataFrame:
    """documents (doc_id, text, ...) -> doc_id, keep_id, group_size, kept, text_sha256.

    Rows whose normalised texts are the same bytes form a group; keep_id is the group's
    largest doc_id, and one row with that doc_id is kept. Null ids rank below all others
    (keep_id is null if the group has no other); of rows that repeat the largest doc_id
    any one is kept. Null texts count as empty ones. Other columns are ignored, so their
    names may clash with nothing. An empty table gives no rows.
    """
    rows = common.store(docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", normalised().alias("text")), "radix-input")
    sha = F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    return common.keep(common.store(grouped(rows, [F.col("doc_id"), sha], first_block, growth).drop("row"), "radix-groups"))


def grouped(rows: DataFrame, keep: list[Column], first_block: int = 64, growth: int = 4) -> DataFrame:
    """rows (row, doc_id, text) of a stored table, with unique row numbers and normalised
    texts -> row, what is to be kept, keep_id, group_size, kept.

    A round shuffles one block of each text that is in play, never what comes after it. After
    the first one the texts still in play, whole, are a table of their own (``radix-open``), which
    later rounds read in place: row numbers come to it by a broadcast if they are few."""
    raw, width, done_bytes = F.col("text").cast("binary"), first_block, 0
    first = rows.select("row", F.col("doc_id").alias("of"), "text", *keep)
    names = ["row", "of", *first.columns[3:]]
    now = first.select(*names, F.lit(0).cast("long").alias("node"), F.substring(raw, 1, width).alias("block"), (F.length(raw) <= width).alias("last"))
    texts = None
    done: list[DataFrame] = []
    while True:
        nodes = now.groupBy("node", "block", "last").agg(F.count("*").alias("n"), F.max("of").alias("keep_id"))
        nodes = common.store(nodes.withColumn("child", F.monotonically_increasing_id()), "radix-nodes")
        open_ = ~F.col("last") & (F.col("n") > 1)
        sent = now.join(nodes, ["node", "block", "last"]).select(*names, "n", "keep_id", F.col("child").alias("node"), open_.alias("open"))
        sent = common.store(sent, "radix-rows")
        common.discard(nodes)
        done.append(sent.where("not open").select(F.lit(len(done)).alias("round"), *names, "n", "keep_id", "node"))
        going = sent.where("open").select("row", "node")
        if going.isEmpty():
            break
        if texts is None:
            texts = common.store(common.few(sent.where("open").select("row")).join(first, "row").select(*names, raw.alias("raw")), "radix-open")
        done_bytes, width = done_bytes + width, width * growth
        block = F.substring("raw", done_bytes + 1, width).alias("block")
        now = common.few(going).join(texts, "row").select(*names, "node", block, (F.length("raw") <= done_bytes + width).alias("last"))
    ended = functools.reduce(DataFrame.unionAll, done)
    several = ended.where("n > 1")
    keepers = several.where("of <=> keep_id").groupBy("round", "node").agg(F.min("row").alias("row")).select("row", F.lit(True).alias("first"))
    judged = several.join(keepers, "row", "left").withColumn("kept", F.coalesce("first", F.lit(False)))
    out = ["row", *names[2:], "keep_id", F.col("n").alias("group_size"), "kept"]
    return judged.select(*out).unionAll(ended.where("n = 1").withColumn("kept", F.lit(True)).select(*out))


@common.scratch()
def drop_duplicates(docs: DataFrame) -> DataFrame:
    """Of each group of equal texts (null: empty) the row that ``duplicate_groups`` keeps,
    with all columns, whatever their names. Rows are numbered and stored first, so that rows which
    repeat a doc_id are told apart. Only the numbers of the rows that go, not texts, are
    joined with the table. An empty table stays empty."""
    row = common.free_name(docs, "row")
    numbered = common.keep(common.store(docs.withColumn(row, F.monotonically_increasing_id()), "radix-input"))
    found = grouped(numbered.select(F.col(row).alias("row"), "doc_id", normalised().alias("text")), [])
    gone = common.keep(common.store(found.where("not kept").select(F.col("row").alias(row)), "radix-gone"))
    return numbered.join(common.few(gone), row, "left_anti").drop(row)


ORACLE = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256 from n join g using (t)
"""
