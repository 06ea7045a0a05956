"""Chunks at syntax boundaries, and the trail of headings above them.

Texts are cut where their outline allows it, in Arrow batches: places open under a budget (a block
that fits stays whole, a larger one opens between its children, a leaf between lines), and one
greedy pass takes as much as fits from each place to another. What introduces something
(a comment, a heading) goes with what follows it. Headings come out of the same pass as rows
beside the chunks, and their trails are window functions over both, an as-of join without a join.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.text import LANGUAGES
from quarry.operators import chunking
from quarry.operators.outline import Block, headings, outline

#: Bytes of a chunk at most, and how deep blocks are entered before they are cut by lines.
BUDGET, DEEPEST = 1200, 48
BODY, LEAD, BLANK = range(3)
#: White space that is cut off the ends of chunks.
_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
_ASCII_SPACE = b" \t\n\x0c\r"
LEVELS = range(1, 7)

Piece = tuple[int, int, int]  # start, end, kind


def _piece(data: bytes, start: int, end: int, lead: bool = False) -> Piece:
    return start, end, BLANK if not data[start:end].strip(_ASCII_SPACE) else LEAD if lead else BODY


def _line_places(data: bytes, start: int, end: int, budget: int) -> Iterator[int]:
    """Where a stretch beyond the budget is cut: behind the last line that fits, or between characters of one that doesn't."""
    while end - start > budget:
        at = data.rfind(b"\n", start, start + budget) + 1
        if at <= start:
            at = start + budget
            while at > start and data[at] & 0xC0 == 0x80:
                at -= 1
            if at == start:  # not even one character fits
                break
        yield at
        start = at


def places(root: Block, data: bytes, budget: int) -> tuple[list[int], set[int]]:
    """Where the text may be cut under a budget, in order with both ends of the outline, and which of them open a lead.

    A block that fits keeps its inside closed; one that doesn't opens where its children begin and end.
    """
    found, leads, todo = {root.start, root.end}, set(), [(root, 0)]
    if root.lead and root.end - root.start <= budget:
        leads.add(root.start)
    while todo:
        block, depth = todo.pop()
        if block.end - block.start <= budget or depth >= DEEPEST:
            continue
        for child in block.children:
            found.update((child.start, child.end))
            if child.lead and child.end - child.start <= budget:
                leads.add(child.start)
            todo.append((child, depth + 1))
    ordered = sorted(found)
    for a, b in list(zip(ordered, ordered[1:])):
        found.update(_line_places(data, a, b, budget))
    return sorted(found), leads


def pieces(root: Block, data: bytes, budget: int = BUDGET) -> list[Piece]:
    """Pieces between the places, which cover the outline without gaps."""
    at, leads = places(root, data, budget)
    return [_piece(data, a, b, a in leads) for a, b in zip(at, at[1:])]


def packed(own: list[Piece], budget: int = BUDGET) -> list[tuple[int, int]]:
    """Ranges of as many pieces as fit the budget, cut before the leads at their end: those go with what follows, or stand alone if it leaves them no room."""
    first = next((n for n, piece in enumerate(own) if piece[2] != BLANK), len(own))
    ends = [end for _, end, _ in own]
    home, run = [], None  # of each piece: the first of the leads that it ends with, if any
    for n, (_, _, kind) in enumerate(own):
        run = None if kind == BODY else n if kind == LEAD and run is None else run
        home.append(run)
    ranges, at = [], first
    while at < len(own):
        start = own[at][0]
        after = max(bisect_right(ends, start + budget, at), at + 1)  # the first piece that doesn't fit
        lead = home[after - 1] if after < len(own) else None
        if lead is not None:
            lead = next((n for n in range(max(lead, at), after) if own[n][2] == LEAD), None)
        if lead is None or lead == at:
            ranges.append((start, ends[after - 1]))
            at = after
            continue
        ranges.append((start, own[lead][0]))
        at = lead
        if ends[after] - own[lead][0] > budget:
            ranges.append((own[lead][0], ends[after - 1]))
            at = after
    return ranges


def cut(text: str, language: str, budget: int = BUDGET) -> tuple[list[tuple[int, int, str]], list[Block], list[int]]:
    """(start, end, text) of the chunks of a text, its headings, and the places of its line feeds; all in bytes."""
    data = text.encode("utf-8", "surrogatepass")
    root = outline(data, language)
    found = []
    for a, b in packed(pieces(root, data, budget), budget):
        raw = data[a:b].decode("utf-8", "replace")
        inner = raw.strip(_SPACE)
        if inner:
            start = a + len(raw[: len(raw) - len(raw.lstrip(_SPACE))].encode())
            found.append((start, start + len(inner.encode()), inner))
    feeds = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10).tolist()
    return found, headings(root) if language == "markdown" else [], feeds


def outlined(docs: DataFrame, text_col: str = "text", language_col: str = "language", line_col: str | None = None, budget: int = BUDGET) -> DataFrame:
    """Chunks and headings of docs with a known language, one a row: docs' other columns, kind, chunk_index, text, start_line, end_line, start, stop, level.

    kind is chunk or heading; start and stop are bytes. A text that is null or blank gives nothing.
    """
    rest = [c for c in docs.columns if c not in (text_col, line_col)]
    known = docs.where(F.col(language_col).isin(sorted(LANGUAGES.values())) & F.col(text_col).isNotNull())
    sent = known.select(*rest, F.col(language_col).alias("__language"), F.col(text_col).alias("__text"), (F.col(line_col) if line_col else F.lit(1)).cast("int").alias("__line"))
    own = "kind string, chunk_index int, text string, start_line int, end_line int, start long, stop long, level int"
    names = [x.split()[0] for x in own.split(", ")]
    types = [pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                batch = whole.slice(at, 64)
                of, rows = [], []
                for n, (language, text, line) in enumerate(zip(*[batch.column(len(rest) + k).to_pylist() for k in range(3)], strict=True)):
                    found, titles, feeds = cut(text, language, budget)
                    rows += [("chunk", k, t, line + bisect_left(feeds, a), line + bisect_left(feeds, b - 1), a, b, None) for k, (a, b, t) in enumerate(found)]
                    rows += [("heading", None, h.title, line + bisect_left(feeds, h.start), line + bisect_left(feeds, h.start), h.start, h.end, h.level) for h in titles]
                    of += [n] * (len(found) + len(titles))
                if rows:
                    kept = [c.take(pa.array(of, pa.int64())) for c in batch.columns[: len(rest)]]
                    yield pa.RecordBatch.from_arrays([*kept, *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]], names=[*rest, *names])

    schema = ", ".join([*[f"`{c}` {t}" for c, t in docs.dtypes if c in rest], own])
    return sent.mapInArrow(run, schema)


def with_trails(rows: DataFrame, key: str) -> DataFrame:
    """rows of outlined with context: the headings in force at a chunk, or that a heading ends, joined by " > ".

    A heading is in force until one of its level or above comes. Where exactly one heading has the
    highest level, it is the document's title and left out; so are headings within the chunk itself.
    """
    whole = Window.partitionBy(key)
    heading = F.col("kind") == "heading"
    top = rows.withColumn("__top", F.min("level").over(whole))
    titled = top.withColumn("__title", F.when(F.sum(F.when(F.col("level") == F.col("__top"), 1)).over(whole) == 1, F.col("__top")))
    before = whole.orderBy("start", F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)  # a heading comes before the chunk that it opens
    last = titled.withColumns({f"__h{n}": F.last(F.when(heading & (F.col("level") == n), F.struct("start", "text")), ignorenulls=True).over(before) for n in LEVELS})
    at = [F.coalesce(F.col(f"__h{n}.start"), F.lit(-1)) for n in LEVELS]
    open_ = [F.when((at[n - 1] > (F.greatest(*at[: n - 1]) if n > 2 else at[0] if n == 2 else F.lit(-1))) & ~F.equal_null(F.lit(n), F.col("__title")), F.col(f"__h{n}.text")) for n in LEVELS]
    holder = F.last(F.when(~heading, F.struct("chunk_index", "stop")), ignorenulls=True).over(whole.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0))
    held = last.withColumn("__trail", F.array_compact(F.array(*open_))).withColumn("__holder", holder)
    inside = F.when(heading & (F.col("start") < F.col("__holder.stop")), F.col("text"))
    own = F.when(heading, F.array().cast("array<string>")).otherwise(F.collect_set(inside).over(Window.partitionBy(key, "__holder.chunk_index")))
    parts = F.when(F.size("__trail") > 0, F.split(F.array_join("__trail", " > "), " > ")).otherwise(F.array().cast("array<string>"))
    context = F.array_join(F.filter(parts, lambda x: ~F.array_contains("__own", x)), " > ")
    return held.withColumn("__own", own).withColumn("context", context).select(*rows.columns, "context")


def chunks(docs: DataFrame, key: str, text_col: str = "text", language_col: str = "language", line_col: str | None = None, budget: int = BUDGET) -> DataFrame:
    """Chunks of every text: at syntax boundaries where its language is known, else windows of words. docs' other columns, chunk_index, text, start_line, end_line, context."""
    rest = [c for c in docs.columns if c not in (text_col, line_col)]
    out = [*rest, "chunk_index", "text", "start_line", "end_line", "context"]
    known = F.coalesce(F.col(language_col).isin(sorted(LANGUAGES.values())), F.lit(False))
    marked = F.col(language_col) == "markdown"
    prose = with_trails(outlined(docs.where(marked), text_col, language_col, line_col, budget), key).where("kind = 'chunk'").select(*out)
    other = outlined(docs.where(known & ~marked), text_col, language_col, line_col, budget).withColumn("context", F.lit("")).select(*out)
    plain = chunking.word_windows(docs.where(~known), text_col, line_col).withColumn("context", F.lit("")).select(*out)
    return prose.unionByName(other).unionByName(plain)
