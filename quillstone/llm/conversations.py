"""Operator 12: conversation structure repair by a forward Viterbi pass over four grammar states.

A conversation's role initials must give `(s?(ua)+)?`. Its states: nothing yet, after s, after u, after a; the first and the
last accept. Row by row each state carries its least (cost, audit string); a layer is closed by at most three inserts. A row's
letter has one cost whatever the path, so of two audits of one cost none begins with the other, and the lesser of two stays the
lesser with whatever follows: the pass is exact, and so is putting parts of a conversation together.

Rows are dealt by range of (conversation, turn) and sorted, so a partition holds whole conversations but for its first and its
last. These two, and conversations over CHUNK_ROWS rows or CHUNK_BYTES bytes, become chunks: a chunk gives the best way from each
state to each, chunks are put together in order by their ways alone, and each chunk then writes its part of the
repaired text. No task holds the rows of a long conversation; its digest is fed chunk by chunk, as SHA-256 has an order.

Defined results. Order within a conversation: turn (nulls first), role, MD5 of the text; equal rows are adjacent and all but the first
are duplicates. A null role or text is one space. A row with null role and null text holds no message: it only names its conversation, which without other rows has
zeros, an empty audit and the empty string's digest. Null ids are one conversation. A role whose first character is not s, u or a (an empty one, `User`) can't be kept;
`usher` has the initial u and stays as it is. Gaps over the longest long are given as that. Extra columns are ignored. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import os.path
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from quillstone.llm.common import SPACE, arrow_map, cut

#: The grammar: state and initial to state, the only other role that may follow each state, and its name.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
DUE = {0: "user", 1: "user", 2: "assistant", 3: "user"}
STATES, ACCEPTED = range(4), (0, 3)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
CHUNK_ROWS, CHUNK_BYTES, LONGEST = 2000, 4 << 20, (1 << 63) - 1

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
CHUNK = "part array<long>, turns array<long>, roles array<string>, texts array<string>, fresh array<struct<at: int, h: binary>>"


# ------------------------------------------------------------------ the grammar


def _better(layer: list, state: int, way: tuple[int, str]) -> None:
    if layer[state] is None or way < layer[state]:
        layer[state] = way


def close(layer: list) -> list:
    """Inserts: from any state at most three reach all that they can."""
    for _ in range(3):
        for state in STATES:
            if layer[state] is not None:
                cost, audit = layer[state]
                _better(layer, NEXT[state, DUE[state][0]], (cost + INSERT, audit + "I"))
    return layer


def advance(layer: list, fault: str, initial: str) -> list:
    """The layer after a row."""
    after: list = [None] * 4
    extra = TRUNCATED if fault == "truncated" else 0
    for state, way in enumerate(layer):
        if way is None:
            continue
        cost, audit = way
        _better(after, state, (cost + DELETE, audit + "D"))
        if fault not in ("blank", "duplicate"):
            if (state, initial) in NEXT:
                _better(after, NEXT[state, initial], (cost + KEEP + extra, audit + "K"))
            _better(after, NEXT[state, DUE[state][0]], (cost + REROLE + extra, audit + "R"))
    return close(after)


def ways(faults: list[str], initials: list[str], start: int) -> list:
    """The best (cost, audit) from a state to each, None where there is none. A later part doesn't insert before its first row: the part before it did."""
    layer: list = [None] * 4
    layer[start] = (0, "")
    for fault, initial in zip(faults, initials):
        layer = advance(layer, fault, initial)
    return layer


def applied(audit: str, roles: list[str], texts: list[str], state: int) -> Iterator[tuple[str, str]]:
    """The repaired (role, text) of a part that begins in a state."""
    at = 0
    for edit in audit:
        role, text = (DUE[state], "") if edit == "I" else (roles[at], texts[at])
        at += edit != "I"
        if edit == "D":
            continue
        role = DUE[state] if edit == "R" else role
        state = NEXT[state, role[0]]
        yield role, text


def fault_of(text: str, seen: bool) -> str:
    """A row's first fault."""
    end = text.rstrip(SPACE)[-1:]
    if not end:
        return "blank"
    return "duplicate" if seen else "" if end in ".!?" else "truncated"


def _key(role: str, text: str) -> bytes:
    r = role.encode()
    return hashlib.blake2b(b"%d:%b%b" % (len(r), r, text.encode()), digest_size=16).digest()


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:]))


def _gaps(first, last, distinct: int) -> int:
    return 0 if first is None else min(last - first + 1 - distinct, LONGEST)


def report(turns: list, roles: list[str], texts: list[str]) -> tuple:
    """The REPORT of a conversation that is held whole."""
    seen, faults, initials = set(), [], [r[:1] for r in roles]
    for role, text in zip(roles, texts):
        faults.append(fault_of(text, (role, text) in seen))
        seen.add((role, text))
    layer = close([(0, ""), None, None, None])
    for fault, initial in zip(faults, initials):
        layer = advance(layer, fault, initial)
    cost, audit = min(layer[s] for s in ACCEPTED if layer[s] is not None)
    known = [t for t in turns if t is not None]
    repaired = "\n".join(f"{r}:{t}" for r, t in applied(audit, roles, texts, 0))
    gaps = _gaps(min(known), max(known), len(set(known))) if known else 0
    return gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), _illegal(initials), cost, audit, hashlib.sha256(repaired.encode()).hexdigest()


# ------------------------------------------------------------------ the first pass: whole conversations, and chunks


class _Open:
    """The rows of a conversation, or of its present chunk."""

    def __init__(self, who, first: bool):
        self.who, self.cut, self.bytes, self.n = who, first, 0, 0
        self.turns, self.roles, self.texts = [], [], []

    def add(self, turn, role, text) -> bool:
        """Whether the chunk is full."""
        if role is None and text is None:
            return False
        self.turns.append(turn)
        self.roles.append(" " if role is None else role)
        self.texts.append(" " if text is None else text)
        self.bytes += len(self.texts[-1]) + len(self.roles[-1])
        return len(self.turns) >= CHUNK_ROWS or self.bytes >= CHUNK_BYTES

    def chunk(self, partition: int) -> dict:
        seen, fresh = set(), []
        for at, (role, text) in enumerate(zip(self.roles, self.texts)):
            k = _key(role, text)
            if k not in seen and fault_of(text, False) != "blank":
                fresh.append({"at": at, "h": k})
            seen.add(k)
        out = {"who": self.who, "part": [partition, self.n], "turns": self.turns, "roles": self.roles, "texts": self.texts, "fresh": fresh}
        self.n, self.bytes, self.cut = self.n + 1, 0, True
        self.turns, self.roles, self.texts = [], [], []
        return out

    def end(self, partition: int) -> dict:
        if self.cut:
            return self.chunk(partition)
        return dict(zip(("who", *COUNTS, "audit", "repaired_sha256"), (self.who, *report(self.turns, self.roles, self.texts))))


def _first_pass(schema: pa.Schema):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        partition, now, first, out = TaskContext.get().partitionId(), None, True, []
        for b in batches:
            for who, turn, role, text in zip(*(b.column(c).to_pylist() for c in ("who", "turn", "role", "text"))):
                if now is None or who != now.who:
                    if now is not None:
                        out.append(now.end(partition))
                        first = False
                    now = _Open(who, first)
                if now.add(turn, role, text):
                    out.append(now.chunk(partition))
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if now is not None:
            out.append(now.chunk(partition))
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


# ------------------------------------------------------------------ chunks


SUMMARY = "part array<long>, ways array<struct<i: int, j: int, cost: long, audit: string>>, faults array<long>, illegal long, ends array<string>, first long, last long, distinct long"


def _summaries(schema: pa.Schema):
    """A row for each chunk: its ways, its counts, and what its neighbours need of its ends."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.to_pylist():
                new = {f["at"] for f in x["fresh"]} - set(x["late"] or ())
                faults = [fault_of(t, at not in new) for at, t in enumerate(x["texts"])]
                initials = [r[:1] for r in x["roles"]]
                found = [{"i": i, "j": j, "cost": w[0], "audit": w[1]} for i in STATES for j, w in enumerate(ways(faults, initials, i)) if w]
                known = [t for t in x["turns"] if t is not None]
                out.append({
                    "who": x["who"], "part": x["part"], "ways": found, "faults": [faults.count(f) for f in ("blank", "duplicate", "truncated")],
                    "illegal": _illegal(initials), "ends": [initials[0], initials[-1]] if initials else [],
                    "first": known[0] if known else None, "last": known[-1] if known else None, "distinct": len(set(known)),
                })
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


class _Chain:
    """Chunks of a conversation put together in their order. What all audits begin with is set aside, so that they stay short."""

    def __init__(self, who):
        self.who, self.layer = who, close([(0, ""), None, None, None])
        self.head, self.steps, self.end = [], [], None
        self.counts, self.illegal, self.first, self.last, self.distinct = [0, 0, 0], 0, None, None, 0

    def add(self, x: dict) -> None:
        after, back = [None] * 4, [None] * 4
        for w in x["ways"]:
            way = self.layer[w["i"]]
            if way is not None:
                way = (way[0] + w["cost"], way[1] + w["audit"])
                if after[w["j"]] is None or way < after[w["j"]]:
                    after[w["j"]], back[w["j"]] = way, w["i"]
        same = len(os.path.commonprefix([w[1] for w in after if w]))
        self.head.append(next(w[1] for w in after if w)[:same])
        self.layer = [w and (w[0], w[1][same:]) for w in after]
        self.steps.append((x["part"], back))
        self.counts = [a + b for a, b in zip(self.counts, x["faults"])]
        self.illegal += x["illegal"]
        if x["ends"]:
            self.illegal += self.end is not None and self.end + x["ends"][0] not in LEGAL
            self.end = x["ends"][1]
        if x["first"] is not None:
            self.distinct += x["distinct"] - (self.last == x["first"])
            self.first, self.last = x["first"] if self.first is None else self.first, x["last"]

    def rows(self) -> Iterator[dict]:
        cost, audit, state = min((*self.layer[s], s) for s in ACCEPTED if self.layer[s] is not None)
        audit = "".join(self.head) + audit
        yield {"who": self.who, "gaps": _gaps(self.first, self.last, self.distinct), **dict(zip(("blank", "duplicate", "truncated"), self.counts)), "illegal": self.illegal, "cost": cost, "audit": audit}
        for k in range(len(self.steps) - 1, -1, -1):
            part, back = self.steps[k]
            j, state = state, back[state]
            # What is inserted before the first row of all belongs to the first chunk.
            yield {"who": self.who, "part": part, "i": state, "j": j, "lead": 0 if k else (0, 0, 1, 2)[state]}


def _by_conversation(make, add, rows, schema: pa.Schema):
    """A fold over rows that are sorted by conversation and part: one row is held at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for b in batches:
            for x in b.to_pylist():
                if now is None or now.who != x["who"]:
                    out += rows(now) if now is not None else ()
                    now = make(x["who"])
                add(now, x)
            yield pa.RecordBatch.from_pylist(out, schema)
            out = []
        if now is not None:
            yield pa.RecordBatch.from_pylist(list(rows(now)), schema)

    return run


def _repaired(schema: pa.Schema):
    """A chunk's part of the repaired text, null where nothing of it stays."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.to_pylist():
                turns = applied("I" * x["lead"] + x["edits"], x["roles"], x["texts"], 0 if x["lead"] else x["i"])
                said = [f"{r}:{t}" for r, t in turns]
                yield pa.RecordBatch.from_pylist([{"who": x["who"], "part": x["part"], "said": "\n".join(said) if said else None}], schema)

    return run


class _Digest:
    """SHA-256 of the parts of a conversation, fed one after the other."""

    def __init__(self, who):
        self.who, self.sha, self.some = who, hashlib.sha256(), False

    def add(self, x: dict) -> None:
        if x["said"] is not None:
            self.sha.update((b"\n" if self.some else b"") + x["said"].encode())
            self.some = True

    def rows(self) -> list[dict]:
        return [{"who": self.who, "repaired_sha256": self.sha.hexdigest()}]


def _mapped(df: DataFrame, make, columns: str) -> DataFrame:
    """df through make(Arrow schema); `who` is a list of the conversation's id alone, so that null ids are equal."""
    ddl = f"who {dict(df.dtypes)['who']}, {columns}"
    return arrow_map(df, make(to_arrow_schema(df.sparkSession.createDataFrame([], ddl).schema)), ddl)


def _folded(df: DataFrame, kind, columns: str) -> DataFrame:
    """The rows of a conversation in their order, one after the other."""
    return _mapped(df.repartition("who").sortWithinPartitions("who", "part"), lambda s: _by_conversation(kind, kind.add, kind.rows, s), columns)


def repair(rows: DataFrame) -> DataFrame:
    """A row for each conversation of rows (conv_id, turn, role, text): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    dealt = rows.select(F.array("conv_id").alias("who"), F.col("turn").cast("long").alias("turn"), "role", "text")
    dealt = dealt.withColumns({"h": F.md5(F.coalesce("text", F.lit(" "))), "n": F.monotonically_increasing_id()})
    order = ["who", "turn", F.coalesce("role", F.lit(" ")), "h", "n"]
    first = cut(_mapped(dealt.repartitionByRange(*order).sortWithinPartitions(*order).drop("h", "n"), _first_pass, f"{REPORT}, {CHUNK}"))
    whole, chunks = first.where("part is null"), first.where("part is not null").select("who", "part", "turns", "roles", "texts", "fresh")
    # Of a message a chunk sends its first place only.
    places = chunks.select("who", "part", F.explode("fresh").alias("f")).select("who", "part", "f.at", "f.h")
    firsts = places.groupBy("who", "h").agg(F.min("part").alias("least"), F.count("*").alias("n")).where("n > 1")
    late = places.join(firsts, ["who", "h"]).where("part > least").groupBy("who", "part").agg(F.collect_list("at").alias("late"))
    summaries = cut(_mapped(chunks.join(late, ["who", "part"], "left"), _summaries, SUMMARY))
    counts = ", ".join(f"{c} long" for c in COUNTS)
    chained = cut(_folded(summaries, _Chain, f"{counts}, audit string, part array<long>, i int, j int, lead int"))
    chosen = summaries.join(chained.where("part is not null").select("who", "part", "i", "j", "lead"), ["who", "part"])
    edits = chosen.select("who", "part", "i", "lead", F.expr("filter(ways, w -> w.i = i and w.j = j)[0].audit").alias("edits"))
    said = _mapped(chunks.join(edits, ["who", "part"]), _repaired, "part array<long>, said string")
    digests = _folded(said, _Digest, "repaired_sha256 string")
    joined = chained.where("part is null").drop("part", "i", "j", "lead").join(digests, "who")
    columns = [F.col("who")[0].alias("conv_id"), *COUNTS, "audit", "repaired_sha256"]
    return whole.select(*columns).union(joined.select(*columns))


def damage(rows: DataFrame) -> DataFrame:
    """Rows of conversations with faults by crc32(`conv_id:turn`) % 20: 0 drops a row (its conversation stays named), 1 empties its text, 2 removes its `.!?`, 3 repeats it, 4 gives it to the user."""
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    r = rows.select("conv_id", "turn", (F.crc32(name) % 20).alias("kind"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role, stays = F.when(F.col("kind") == 4, "user").otherwise(F.col("role")), F.col("kind") != 0
    times = F.array_repeat(F.lit(1), F.when(F.col("kind") == 3, 2).otherwise(1))
    return r.select("conv_id", "turn", F.when(stays, role).alias("role"), F.when(stays, text).alias("text"), F.explode(times).alias("__time")).drop("__time")
