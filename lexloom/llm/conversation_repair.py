"""Repairing the structure of conversations by the cheapest edits.

A conversation's turns are kept (K), given another role (R) or deleted (D), and turns without
text inserted (I), so that the roles read ``(s?(ua)+)?``. Of the cheapest edits those whose
letters, in order, are the least in ASCII are taken.

* A step of the program is a macro: a run of insertions and what becomes of the next turn,
  ``I..IK``. No macro is the beginning of another, so the letters of two paths compare as
  their first macros that differ do, and of paths to the same layer none begins another.
* A layer is what four states (nothing yet, after system, user, assistant) cost. Letters are
  never carried: a state has the rank of its best path among the layer's, and the ranks of the next
  layer follow from the parent's rank and then the macro's place. Parent pointers give the letters back.
* Costs less their minimum and the ranks of a layer take few values, so a layer's successors
  are looked up; a turn costs one look-up whatever its text.

What one layer does to the next, a block of turns does too: for each state before it, the cost
and rank of the best path to each state behind it. So a conversation of any length is cut into
blocks, each worked out by itself; their few numbers are put through the same program, and
each block then writes its edits between the states that this gives it.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

FAR = 1 << 40
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: What insertion, deletion, another role and a truncated turn that stays cost.
INSERT, DELETE, RENAME, TRUNCATED = 5, 2, 1, 5
#: More insertions in a row would pass a state twice.
RUNS = range(3)
MACROS = sorted("I" * n + c for n in RUNS for c in "DKR")
#: Fixed: faults in the order in which they count.
FINE, BLANK, DUPLICATE, CUT = range(4)
#: A block has at most so many turns, and so many letters of text before its last one.
BLOCK_TURNS, BLOCK_LETTERS = 8192, 4_000_000

Layer = tuple[tuple[int, ...], tuple[int, ...]]


def inserted(state: int) -> int:
    """The state after one insertion: user and assistant in turn."""
    return ASSISTANT if state == USER else USER


def steps(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(state before, state behind, cost, place of the macro) of all that may become of a turn."""
    out = []
    for before in range(4):
        at = before
        for n in RUNS:
            at = inserted(at) if n else at
            ends = [(at, "D", DELETE)]
            if fault not in (BLANK, DUPLICATE):
                stay = TRUNCATED if fault == CUT else 0
                if at in NEXT.get(initial, {}):
                    ends.append((NEXT[initial][at], "K", stay))
                ends += [(NEXT[c][at], "R", RENAME + stay) for c in "ua" if at in NEXT[c]]
            out += [(before, behind, n * INSERT + cost, MACROS.index("I" * n + letter)) for behind, letter, cost in ends]
    return out


class Machine:
    """Layers and their successors, worked out once for each that occurs."""

    def __init__(self):
        self.steps = {(i, f): steps(i, f) for i in ("s", "u", "a", "") for f in (FINE, BLANK, DUPLICATE, CUT)}
        self.known: dict[tuple[Layer, tuple[str, int]], tuple[Layer, int, tuple]] = {}

    def first(self, state: int) -> Layer:
        return tuple(0 if s == state else FAR for s in range(4)), tuple(0 if s == state else -1 for s in range(4))

    def step(self, layer: Layer, kind: tuple[str, int]) -> tuple[Layer, int, tuple]:
        """(next layer less its minimum, that minimum, for each state (state before, macro))."""
        out = self.known.get((layer, kind))
        if out is None:
            out = self.known[layer, kind] = advance(layer, self.steps[kind])
        return out

    def run(self, state: int, kinds: Iterable[tuple[str, int]], parents: list | None = None) -> tuple[Layer, int]:
        layer, total = self.first(state), 0
        for kind in kinds:
            layer, cost, back = self.step(layer, kind)
            total += cost
            if parents is not None:
                parents.append(back)
        return layer, total


def advance(layer: Layer, moves: list[tuple[int, int, int, int]]) -> tuple[Layer, int, tuple]:
    """One layer from another. moves: (state before, behind, cost, place): of equal cost the
    lower rank before, then the lower place, wins."""
    costs, ranks = layer
    best: list[tuple | None] = [None] * 4
    for before, behind, cost, place in moves:
        if costs[before] < FAR:
            way = costs[before] + cost, ranks[before], place, before
            if best[behind] is None or way < best[behind]:
                best[behind] = way
    order = sorted({(b[1], b[2]) for b in best if b})
    low = min(b[0] for b in best if b)
    return (tuple(b[0] - low if b else FAR for b in best), tuple(order.index((b[1], b[2])) if b else -1 for b in best)), low, tuple((b[3], b[2]) if b else None for b in best)


#: What the last insertions cost and bring: state -> runs of insertions that end well.
ENDINGS = {START: [0, 2], SYSTEM: [2], USER: [1], ASSISTANT: [0, 2]}


def ending(layer: Layer) -> tuple[int, int, int]:
    """(cost, state before the last insertions, their number) of the least end of a last layer."""
    costs, ranks = layer
    cost, _, n, state = min((costs[s] + n * INSERT, ranks[s], n, s) for s in range(4) if costs[s] < FAR for n in ENDINGS[s])
    return cost, state, n


def letters(parents: list, state: int) -> list[str]:
    """The macros of the path that ends in a state."""
    out = []
    for back in reversed(parents):
        state, place = back[state]
        out.append(MACROS[place])
    return out[::-1]


def edited(state: int, macros: list[str], roles: list[str], texts: list[str]) -> Iterator[tuple[str, str]]:
    """The turns (role, text) that macros leave, from a state on."""
    for macro, role, text in zip(macros, roles, texts, strict=True):
        for _ in macro[:-1]:
            state = inserted(state)
            yield ("user" if state == USER else "assistant"), ""
        if macro[-1] == "K":
            state = NEXT[role[:1]][state]
            yield role, text
        elif macro[-1] == "R":
            state = ASSISTANT if state == USER else USER
            yield ("user" if state == USER else "assistant"), text


def closing(state: int, n: int) -> list[tuple[str, str]]:
    out = []
    for _ in range(n):
        state = inserted(state)
        out.append(("user" if state == USER else "assistant", ""))
    return out


#: Fixed: ends of sentences, and what counts as a space.
ENDS = ".!?"
TRIM = "\x20\x09\x0a\x0b\x0c\x0d"


def fault(text: str, again: bool) -> int:
    seen = text.rstrip(TRIM)
    return BLANK if not seen else DUPLICATE if again else CUT if seen[-1] not in ENDS else FINE


def damage(conversations: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text, ...) -> the same four columns and ``dropped``, damaged by
    crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays, marked, so that its conversation
    is known), 1 empties its text, 2 takes out its ``.!?``, 3 repeats it, 4 makes it the user's.
    Null roles and texts, and null ids in the key, are one space."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") == 0).alias("dropped"), F.expr("explode(array_repeat(0, if(kind = 3, 2, 1)))").alias("_copy"))
    return rows.drop("_copy")


SUMMARY = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long"
FOUND = "kind string, id_text string, part long, block long, seq long, role string, text string, fault int, low long, high long, turns long, blank long, duplicate long, truncated long, illegal long, gaps long, cost long, head string, tail string, costs array<long>, ranks array<int>, audit string, repaired_sha256 string"


class _Block:
    """Turns of one conversation that follow each other, as many as a block holds."""

    def __init__(self):
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.faults: list[int] = []
        self.low = self.high = None
        self.turns = 0
        self.letters = 0

    def add(self, turn: int | None, role: str, text: str, again: bool) -> None:
        if turn is not None and turn != self.high:
            self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        self.roles.append(role)
        self.texts.append(text)
        self.faults.append(fault(text, again))
        self.letters += len(text)

    def full(self) -> bool:
        return len(self.roles) >= BLOCK_TURNS or self.letters >= BLOCK_LETTERS

    def kinds(self) -> list[tuple[str, int]]:
        return [kind_of(r, f) for r, f in zip(self.roles, self.faults, strict=True)]

    def counts(self) -> dict:
        bad = sum(a[:1] + b[:1] not in ("su", "ua", "au") for a, b in zip(self.roles, self.roles[1:], strict=False))
        return {"blank": self.faults.count(BLANK), "duplicate": self.faults.count(DUPLICATE), "truncated": self.faults.count(CUT), "illegal": bad}


def kind_of(role: str, fault: int) -> tuple[str, int]:
    return (role[:1] if role[:1] in ("s", "u", "a") else ""), fault


def _alone(machine: Machine, id_text: str, block: _Block) -> dict:
    """The result of a conversation that is one block."""
    parents: list = []
    layer, total = machine.run(START, block.kinds(), parents)
    cost, state, n = ending(layer)
    macros = letters(parents, state)
    turns = [*edited(START, macros, block.roles, block.texts), *closing(state, n)]
    gaps = block.high - block.low + 1 - block.turns if block.turns else 0
    return {"kind": "done", "id_text": id_text, **block.counts(), "gaps": gaps, "cost": total + cost, "audit": "".join(macros) + "I" * n, "repaired_sha256": hashlib.sha256("\n".join(f"{r}:{t}" for r, t in turns).encode()).hexdigest()}


def _table(machine: Machine, id_text: str, part: int, number: int, block: _Block) -> Iterator[dict]:
    """A block of a longer conversation: its summary, and its turns for when its states are known."""
    costs, ranks = [], []
    for s in range(4):
        layer, total = machine.run(s, block.kinds())
        costs += [c + total if c < FAR else FAR for c in layer[0]]
        ranks += layer[1]
    at = {"id_text": id_text, "part": part, "block": number}
    yield {"kind": "block", **at, **block.counts(), "low": block.low, "high": block.high, "turns": block.turns, "head": block.roles[0][:1], "tail": block.roles[-1][:1], "costs": costs, "ranks": ranks}
    for i, (r, t, f) in enumerate(zip(block.roles, block.texts, block.faults, strict=True)):
        yield {"kind": "turn", **at, "seq": i, "role": r, "text": t, "fault": f}


def _frames(rows: Iterable[dict], columns: list[str]) -> Iterator[pd.DataFrame]:
    """Rows in frames of bounded size."""
    held, size = [], 0
    for r in rows:
        held.append(r)
        size += 200 + len(r.get("text") or "") + len(r.get("audit") or "")
        if size > 4_000_000:
            yield _frame(held, columns)
            held, size = [], 0
    if held:
        yield _frame(held, columns)


WHOLE = {"conv_id", "part", "block", "seq", "fault", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "gaps", "cost", "before", "behind", "last"}


def _frame(rows: list[dict], columns: list[str]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.array([r.get(c) for r in rows], "Int64") if c in WHOLE else [r.get(c) for r in rows] for c in columns})


def _names(schema: str) -> list[str]:
    return re.findall(r"(?:^|, )(\w+) ", schema)


def _int(x) -> int | None:
    return None if x is None or pd.isna(x) else int(x)


def _blocks(batches: Iterable[pd.DataFrame]) -> Iterator[dict]:
    """Sorted turns of one task -> results of the conversations that are whole in it and one
    block, blocks and turns of the others. The first and the last conversation of a task may go on in
    another one, so these are never settled here."""
    from pyspark import TaskContext

    part, machine = TaskContext.get().partitionId(), Machine()
    key, block, number, edge = None, _Block(), 0, True
    for b in batches:
        for id_text, turn, role, text, again in zip(b["id_text"], b["turn_text"], b["role"], b["text"], b["again"], strict=True):
            if id_text != key:
                if block.roles:
                    yield from _table(machine, key, part, number, block) if edge or number else [_alone(machine, key, block)]
                edge = key is None
                key, block, number = id_text, _Block(), 0
            elif block.full():
                yield from _table(machine, key, part, number, block)
                block, number = _Block(), number + 1
            block.add(None if turn is None else int(turn), role, text, bool(again))
    if block.roles:
        yield from _table(machine, key, part, number, block)


def _choose(blocks: pd.DataFrame) -> pd.DataFrame:
    """The blocks of a conversation, a few numbers each -> for each the states around it, and
    on the last one the totals. It is the program over layers with blocks for turns."""
    x = blocks.sort_values(["part", "block"])
    layer, total, parents = Machine().first(START), 0, []
    for costs, ranks in zip(x["costs"], x["ranks"], strict=True):
        moves = [(s, e, int(costs[4 * s + e]), int(ranks[4 * s + e])) for s in range(4) for e in range(4) if costs[4 * s + e] < FAR]
        layer, cost, back = advance(layer, moves)
        total += cost
        parents.append(back)
    cost, state, n = ending(layer)
    behind = []
    for back in reversed(parents):
        behind.append(state)
        state = back[state][0]
    behind = behind[::-1]
    low, high, turns, last = None, None, 0, None
    for lo, hi, k in zip(x["low"], x["high"], x["turns"], strict=True):
        lo, hi = _int(lo), _int(hi)
        if hi is not None:
            turns += int(k) - (lo == last)
            low, high, last = lo if low is None else low, hi, hi
    seams = sum(a + b not in ("su", "ua", "au") for a, b in zip(x["tail"], x["head"][1:], strict=False))
    rows = [{"id_text": c, "part": p, "block": k, "before": before, "behind": e} for c, p, k, before, e in zip(x["id_text"], x["part"], x["block"], [START, *behind], behind, strict=False)]
    rows[-1] |= {"last": n, "gaps": high - low + 1 - turns if turns else 0, "cost": total + cost, "illegal": int(x["illegal"].sum()) + seams} | {c: int(x[c].sum()) for c in ("blank", "duplicate", "truncated")}
    return _frame(rows, _names(CHOSEN))


CHOSEN = f"id_text string, part long, block long, before int, behind int, last int, {SUMMARY}"
PIECE = f"id_text string, part long, block long, seq long, repaired string, audit string, last int, {SUMMARY}"


def _pieces(batches: Iterable[pd.DataFrame]) -> Iterator[dict]:
    """Turns of blocks whose states are known -> what each block repairs, in pieces of bounded size."""
    machine = Machine()
    key, roles, texts, faults, head = None, [], [], [], None

    def made() -> Iterator[dict]:
        parents: list = []
        machine.run(head.before, [kind_of(r, f) for r, f in zip(roles, faults, strict=True)], parents)
        macros = letters(parents, int(head.behind))
        turns = [f"{r}:{t}" for r, t in edited(int(head.before), macros, roles, texts)]
        closed = _int(head.last)
        if closed is not None:
            turns += [f"{r}:{t}" for r, t in closing(int(head.behind), closed)]
        at = {"id_text": head.id_text, "part": head.part, "block": head.block}
        for i, t in enumerate(turns):
            yield {**at, "seq": i, "repaired": t}
        yield {**at, "seq": len(turns), "audit": "".join(macros) + "I" * (closed or 0), **({c: _int(getattr(head, c)) for c in ("last", *_names(SUMMARY))} if closed is not None else {})}

    for b in batches:
        for r in b.itertuples(index=False):
            if key != (r.id_text, r.part, r.block):
                if roles:
                    yield from made()
                key, roles, texts, faults, head = (r.id_text, r.part, r.block), [], [], [], r
            roles.append(r.role)
            texts.append(r.text)
            faults.append(int(r.fault))
    if roles:
        yield from made()


def _joined(batches: Iterable[pd.DataFrame]) -> Iterator[dict]:
    """Pieces in order -> a row for each conversation; its text runs through the digest and is never held."""
    key, digest, audit, begun = None, None, [], False
    for b in batches:
        for r in b.itertuples(index=False):
            if r.id_text != key:
                key, digest, audit, begun = r.id_text, hashlib.sha256(), [], False
            if r.repaired is not None:
                digest.update((b"\n" if begun else b"") + r.repaired.encode())
                begun = True
                continue
            audit.append(r.audit)
            if _int(r.last) is not None:
                yield {"id_text": key, **{c: _int(getattr(r, c)) for c in _names(SUMMARY)}, "audit": "".join(audit), "repaired_sha256": digest.hexdigest()}


RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
JOINED = f"id_text string, {SUMMARY}, audit string, repaired_sha256 string"


def _streamed(work, schema: str):
    columns = _names(schema)

    @common.tidy
    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _frames(work(batches), columns)

    return run


@common.scratch()
def repair(turns: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, turn, role, text, dropped) -> conv_id, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256: a row for each conv_id, null one of them.

    Turns of a conversation come by turn, nulls first; of the same turn by role, the first letters
    of the text and its digest, so that only equal ones tie. Dropped rows only say that there is such a
    conversation; without others it has zeros, an empty audit and the digest of nothing. An empty
    table gives no rows. Null roles and texts are one space. Rows that repeat are duplicates.
    Texts may be of any length; other columns are not read.

    Turns are dealt by ranges of (conversation, turn, role, text, row), so a long conversation,
    or one with many equal rows, is spread over as many tasks as its rows need. Only the
    digest of its repaired text, and its audit, come together in one task, as a stream. parts: how many ranges."""
    spark = turns.sparkSession
    common.small_batches(spark)
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    or_space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(or_space("conv_id").alias("id_text"), "turn", or_space("role").alias("role"), or_space("text").alias("text"), F.coalesce("dropped", F.lit(False)).alias("dropped"))
    rows = common.store(rows.withColumns({"row": F.monotonically_increasing_id(), "digest": F.unhex(F.sha2("text", 256)), "begins": F.substring("text", 1, 64)}), "turns")
    left = rows.where(~F.col("dropped")).drop("dropped")
    place = F.struct(F.coalesce("turn", F.lit(-(2**63))).alias("at"), F.col("turn").isNotNull().alias("known"), "row")
    repeated = left.groupBy("id_text", "role", "digest").agg(F.count("*").alias("n"), F.min(place).alias("first")).where("n > 1")
    repeated = common.store(repeated.select("id_text", "role", "digest", F.col("first.row").alias("first")), "turns-repeated")
    again = F.coalesce(F.col("row") != F.col("first"), F.lit(False)).alias("again")
    marked = left.join(common.few(repeated), ["id_text", "role", "digest"], "left").select("id_text", "turn", "role", "begins", "digest", "row", "text", again)
    order = [F.col("id_text"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("begins"), F.col("digest"), F.col("row")]
    dealt = marked.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("id_text", F.col("turn").cast("string").alias("turn_text"), "role", "text", "again")
    found = common.store(dealt.mapInPandas(_streamed(_blocks, FOUND), FOUND), "turns-found")

    blocks = found.where("kind = 'block'").select("id_text", "part", "block", "low", "high", "turns", "blank", "duplicate", "truncated", "illegal", "head", "tail", "costs", "ranks")
    chosen = common.store(blocks.groupBy("id_text").applyInPandas(_choose, CHOSEN), "turns-chosen")
    open_ = found.where("kind = 'turn'").select("id_text", "part", "block", "seq", "role", "text", "fault").join(common.few(chosen), ["id_text", "part", "block"])
    pieces = open_.repartition(parts, "id_text", "part", "block").sortWithinPartitions("id_text", "part", "block", "seq").mapInPandas(_streamed(_pieces, PIECE), PIECE)
    joined = pieces.repartition(parts, "id_text").sortWithinPartitions("id_text", "part", "block", "seq").mapInPandas(_streamed(_joined, JOINED), JOINED)

    counts = [F.lit(0).cast("long").alias(c) for c in _names(SUMMARY)]
    none = rows.groupBy("id_text").agg(F.every("dropped").alias("gone")).where("gone").select("id_text", *counts, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))
    done = found.where("kind = 'done'").select(*_names(JOINED))
    whole = done.unionByName(joined).unionByName(none)
    whole = whole.select(F.expr("cast(nullif(id_text, ' ') as long)").alias("conv_id"), *RESULT[1:])
    return common.keep(common.store(whole, "turns-repaired"))
