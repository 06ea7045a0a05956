"""Conversation structure repair: the cheapest edits that give a conversation alternating roles.

Roles are to read `(s?(ua)+)?` by their initials. The turns of a conversation are aligned with
each length of that string that can still win (Wagner-Fischer); the cost of the best length so far
bounds the cells of the next table (Ukkonen's band). Among alignments of one cost their audits,
backtraced letter by letter, are compared. Lengths differ only in how often `ua` goes round, so
conversations of more than LONG turns take one table that wraps around it, with the same results.

Two passes over the turns, each sorted in its tasks: the first keeps one byte a turn (and a hash
of it, for repeats), and gives the audits; the second reads audits and turns and passes on what is
left. Neither keeps the texts of a conversation, however long it is.

Nulls: a null role or text counts as one space; turns without a number come first; rows without a
conv_id are one conversation. Turns of one number are ordered by role and text, so repeated rows
stand side by side. Empty texts are blank. An empty table gives an empty result. Other columns are
ignored whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import slices

#: Costs of the edits; an undeleted turn without an end costs CUT more.
REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: Turns from which one table that wraps around takes the place of a table for each length.
LONG = 128
#: Characters of an audit that travel in one row.
PART = 1 << 16
SPACES = " \t\n\x0b\x0c\r"
NAMES = {"u": "user", "a": "assistant"}
SUMMARY = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) after the faults of the contract, chosen by crc32 of `conv_id:turn` modulo 20."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", space("conv_id"), space("turn")).cast("binary")) % 20
    kept = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == 3, 2).otherwise(1)))
    return kept.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("time")).drop("time")


def _lengths(n: int, with_s: bool) -> list[tuple[int, str]]:
    """(least cost, target) of every string of the grammar that could beat deleting all of n turns, cheapest first."""
    found = []
    for lead in ("", "s") if with_s else ("",):
        for pairs in range(1, (n + n * DELETE // INSERT) // 2 + 2):
            length = len(lead) + 2 * pairs
            found.append((INSERT * max(0, length - n) + DELETE * max(0, n - length), lead + "ua" * pairs))
    return sorted(found)


def _aligned(turns: str, target: str, most: int) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest alignment of turns (s u a o, capitals if cut off) with target, None above most."""
    n, m = len(turns), len(target)
    deletes = (most + INSERT * (n - m)) // (DELETE + INSERT)  # the band: more deletions, with the insertions that make up for them, cost too much
    inserts = deletes - (n - m)
    if deletes < 0 or inserts < 0:
        return None
    far = most + 1
    rest = [[far] * (m + 1) for _ in range(n + 1)]  # cost of what is left from turn i and place j on
    low = turns.lower()
    for i in range(n, -1, -1):
        row, below = rest[i], rest[i + 1] if i < n else None
        for j in range(min(m, i + inserts), max(0, i - deletes) - 1, -1):
            best = 0 if i == n and j == m else far
            if below is not None:
                best = min(best, below[j] + DELETE)
                if j < m and (low[i] == target[j] or target[j] != "s"):
                    best = min(best, below[j + 1] + (0 if low[i] == target[j] else REROLE) + (CUT if turns[i] != low[i] else 0))
            if j < m and target[j] != "s":
                best = min(best, row[j + 1] + INSERT)
            row[j] = best
    if rest[0][0] > most:
        return None
    audit, i, j = [], 0, 0
    while i < n or j < m:
        left = rest[i][j]
        if i < n and rest[i + 1][j] + DELETE == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] != "s" and rest[i][j + 1] + INSERT == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if low[i] == target[j] else "R")
            i, j = i + 1, j + 1
    return rest[0][0], "".join(audit)


def _by_lengths(turns: str) -> tuple[int, str]:
    best = (DELETE * len(turns), "D" * len(turns))
    for least, target in _lengths(len(turns), "s" in turns.lower()):
        if least > best[0]:
            break
        found = _aligned(turns, target, best[0])
        if found:
            best = min(best, found)
    return best


#: Where the string stands: 0 nothing yet, 1 after s, 2 after u, 3 after a; the letter that is next, and where it leads.
_NEXT = (("u", 2), ("u", 2), ("a", 3), ("u", 2))


def _wrapped(turns: str) -> tuple[int, str]:
    """As _by_lengths, by one table whose columns are the places of the string, going round."""
    n = len(turns)
    far = DELETE * n + INSERT * 4

    def relaxed(cost: list[int]) -> list[int]:
        for _ in range(2):
            cost = [min(cost[at], cost[_NEXT[at][1]] + INSERT) for at in range(4)]
        return cost

    rest = [relaxed([0, far, far, 0])]
    for turn in reversed(turns):
        low, after = turn.lower(), rest[-1]
        cut = CUT if turn != low else 0
        row = [min(after[at] + DELETE, after[to] + cut + (0 if low == letter else REROLE)) for at, (letter, to) in enumerate(_NEXT)]
        if low == "s":
            row[0] = min(row[0], after[1] + cut)
        rest.append(relaxed(row))
    rest.reverse()
    audit, i, at = [], 0, 0
    while i < n or rest[i][at]:
        left, (letter, to) = rest[i][at], _NEXT[at]
        if i < n and rest[i + 1][at] + DELETE == left:
            audit.append("D")
            i += 1
        elif rest[i][to] + INSERT == left:
            audit.append("I")
            at = to
        else:
            low = turns[i].lower()
            cut = CUT if turns[i] != low else 0
            if at == 0 and low == "s" and rest[i + 1][1] + cut == left:
                audit.append("K")
                at = 1
            else:
                audit.append("K" if low == letter else "R")
                at = to
            i += 1
    return rest[0][0], "".join(audit)


@lru_cache(maxsize=1 << 14)
def _repaired(turns: str) -> tuple[int, str]:
    return _by_lengths(turns) if len(turns) <= LONG else _wrapped(turns)


def align(turns: str) -> tuple[int, str]:
    """(cost, audit) of turns: s u a or o (any other initial), capitals if cut off, x if it has to go.

    What has to go is deleted at its place, before anything is inserted there, which is least; the rest is aligned without it.
    """
    cost, edits = _repaired(turns.replace("x", ""))
    audit, at = [], 0
    for edit in [*edits, ""]:
        while at < len(turns) and turns[at] == "x":
            audit.append("D")
            at += 1
        audit.append(edit)
        at += edit != "I"
    return cost + DELETE * turns.count("x"), "".join(audit)


class _Conversation:
    """What the first pass keeps of the conversation it reads."""

    def __init__(self, conv_id: int | None) -> None:
        self.conv_id, self.codes, self.seen = conv_id, bytearray(), set()
        self.first = self.last = self.before = None
        self.numbers = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.numbers += 1
        initial = role[:1]
        if self.before is not None and self.before + initial not in ("su", "ua", "au"):
            self.illegal += 1
        self.before = initial
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        end = text.rstrip(SPACES)[-1:]
        code = initial if initial in ("s", "u", "a") else "o"
        if not end:
            self.blank += 1
            code = "x"
        elif key in self.seen:
            self.duplicate += 1
            code = "x"
        elif end not in ".!?":
            self.truncated += 1
            code = code.upper()
        self.seen.add(key)
        self.codes += code.encode()

    def row(self) -> tuple:
        cost, audit = align(self.codes.decode())
        gaps = self.last - self.first + 1 - self.numbers if self.numbers else 0
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(schema.names, zip(*rows, strict=True), strict=True)), schema=schema)


def audits(turns: DataFrame) -> DataFrame:
    """One row a conversation of turns (conv_id, turn, role, text): its faults, the cost of its repair and the audit, a letter an edit."""
    schema = pa.schema([(c.split()[0], pa.string() if c.endswith("string") else pa.int64()) for c in SUMMARY.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for part in slices(batches, "text"):
            for conv_id, turn, role, text in zip(*[c.to_pylist() for c in part.columns], strict=True):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        out.append(now.row())
                    now = _Conversation(conv_id)
                now.add(turn, role, text)
            if out:
                yield _table(out, schema)
                out = []
        if now is not None:
            yield _table([now.row()], schema)

    columns = (F.col("conv_id"), F.col("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return turns.select(*columns).repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text").mapInArrow(run, SUMMARY)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conv_id, place, role, text) of the turns that repair leaves or adds; batches come sorted: of each conversation the parts of its audit, then its turns.

    A conversation of which nothing is left gives one row of place 0.
    """

    class Edits:
        def __init__(self, conv_id: int | None) -> None:
            self.conv_id, self.parts, self.audit, self.at, self.place, self.letter = conv_id, [], None, 0, 0, ""

        def emit(self, role: str | None, text: str) -> tuple:
            role = role if role is not None else NAMES["a" if self.letter == "u" else "u"]
            self.letter = role[:1]
            self.place += 1
            return self.conv_id, self.place, role, text

        def inserted(self) -> Iterator[tuple]:
            if self.audit is None:
                self.audit = "".join(self.parts)
            while self.audit[self.at : self.at + 1] == "I":
                self.at += 1
                yield self.emit(None, "")

        def end(self) -> Iterator[tuple]:
            yield from self.inserted()
            if not self.place:
                yield self.conv_id, 0, None, None

    now = None
    for part in slices(batches, "text"):
        for conv_id, kind, role, text in zip(*[part.column(part.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "kind", "role", "text")], strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    yield from now.end()
                now = Edits(conv_id)
            if kind == 0:
                now.parts.append(text)
                continue
            yield from now.inserted()
            edit = now.audit[now.at]
            now.at += 1
            if edit != "D":
                yield now.emit(role if edit == "K" else None, text)
    if now is not None:
        yield from now.end()


def _with_audits(turns: DataFrame, found: DataFrame) -> DataFrame:
    part = F.explode(F.sequence(F.lit(0), F.floor((F.greatest(F.length("audit"), F.lit(1)) - 1) / PART).cast("int")))
    parts = found.select("conv_id", "audit", part.alias("part")).select("conv_id", F.lit(0).alias("kind"), F.col("part").cast("long").alias("turn"), F.lit("").alias("role"), F.substring("audit", F.col("part") * PART + 1, F.lit(PART)).alias("text"))
    own = turns.select("conv_id", F.lit(1).alias("kind"), "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return parts.unionByName(own).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "text")


def repaired(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns after the edits of found (audits of the same turns), in order of place from 1; a conversation without any has one row of place 0 and nulls."""
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for row in _edited(batches):
            out.append(row)
            size += 64 + len(row[3] or "")
            if size > 1 << 20:
                yield _table(out, schema)
                out, size = [], 0
        if out:
            yield _table(out, schema)

    return _with_audits(turns, found).mapInArrow(run, "conv_id long, place long, role string, text string")


def repaired_digests(turns: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256): SHA-256 of the repaired `role:text`, joined by line feeds, made as they pass by."""
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out = None, []
        for conv_id, place, role, text in _edited(batches):
            if place <= 1:
                if now is not None:
                    out.append((now[0], now[1].hexdigest()))
                now = conv_id, hashlib.sha256()
                if len(out) >= 10_000:
                    yield _table(out, schema)
                    out = []
            if place:
                now[1].update(f"{chr(10) if place > 1 else ''}{role}:{text}".encode())
        if now is not None:
            yield _table([*out, (now[0], now[1].hexdigest())], schema)

    return _with_audits(turns, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair_report(conversations: DataFrame, turns: DataFrame, found: DataFrame) -> DataFrame:
    """A row for every conv_id of conversations: found with the digest of what is repaired; zeros, an empty audit and the digest of nothing where turns has no row of it."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct().alias("i")
    digests = repaired_digests(turns, found).alias("d")
    both = ids.join(found.alias("f"), F.col("i.conv_id").eqNullSafe(F.col("f.conv_id")), "left").join(digests, F.col("i.conv_id").eqNullSafe(F.col("d.conv_id")), "left")
    counts = [F.coalesce(f"f.{c}", F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return both.select("i.conv_id", *counts, F.coalesce("f.audit", F.lit("")).alias("audit"), F.coalesce("d.repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
