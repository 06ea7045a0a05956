"""Chunkers by name, and a table function that runs one of them from SQL.

    table_functions.register(spark)
    spark.sql("SELECT * FROM chunk(TABLE(docs), line => 'line', chunker => 'auto')")

The result has the columns of the table but for text and line, then those of a chunk. A chunker sees
one whole text; register it before the function, which takes along those that are known then.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.errors import InvalidArgument
from quarry.functions.text import LANGUAGES
from quarry.operators import chunking, syntax
from quarry.operators.embedding import WORD

_CHUNK = StructType().add("chunk_index", IntegerType()).add("text", StringType()).add("start_line", IntegerType()).add("end_line", IntegerType()).add("context", StringType())


class Chunk(NamedTuple):
    text: str
    start_line: int
    end_line: int
    context: str = ""


#: A text, its language or none, and the number of its first line, to chunks in order.
Chunker = Callable[[str, "str | None", int], Iterator[Chunk]]


def words(text: str, language: str | None, line: int) -> Iterator[Chunk]:
    """Windows of words, as chunking.word_windows has them."""
    found = [(w, line + n) for n, row in enumerate(text.split("\n")) for w in WORD.findall(row)]
    step = chunking.WINDOW - chunking.OVERLAP
    for at in range(0, max(len(found) - chunking.OVERLAP, min(len(found), 1)), step):
        own = found[at : at + chunking.WINDOW]
        yield Chunk(" ".join(w for w, _ in own), own[0][1], own[-1][1])


def trails(spans: list[tuple[int, int]], titles: list[tuple[int, int, str]]) -> Iterator[str]:
    """The trail of each span (start, stop) among headings (start, level, title) of one text, both in order: as syntax.with_trails, for a text that is at hand."""
    top = min((level for _, level, _ in titles), default=0)
    if sum(level == top for _, level, _ in titles) != 1:
        top = 0  # no title
    force: dict[int, str] = {}
    n = 0
    for k, (start, stop) in enumerate(spans):
        while n < len(titles) and titles[n][0] <= start:
            _, level, title = titles[n]
            force = {a: t for a, t in force.items() if a < level} | {level: title}
            n += 1
        end = min(stop, spans[k + 1][0]) if k + 1 < len(spans) else stop
        own = {t for s, _, t in titles if start <= s < end}
        above = " > ".join(t for level, t in sorted(force.items()) if level != top)
        yield " > ".join(p for p in above.split(" > ") if p not in own) if above else ""


def auto(text: str, language: str | None, line: int) -> Iterator[Chunk]:
    """Chunks as syntax.chunks has them: at syntax boundaries where the language is known, else windows of words."""
    if language not in LANGUAGES.values():
        yield from words(text, language, line)
        return
    found, titles, feeds = syntax.cut(text, language)
    above = trails([(a, b) for a, b, _ in found], [(h.start, h.level, h.title) for h in titles])
    for (a, b, body), context in zip(found, above, strict=True):
        yield Chunk(body, line + syntax.bisect_left(feeds, a), line + syntax.bisect_left(feeds, b - 1), context)


CHUNKERS: dict[str, Chunker] = {"auto": auto, "words": words}


def _function(known: dict[str, Chunker]):
    class Chunks:
        @staticmethod
        def analyze(rows: AnalyzeArgument, text: AnalyzeArgument = None, language: AnalyzeArgument = None, line: AnalyzeArgument = None, chunker: AnalyzeArgument = None) -> AnalyzeResult:
            if not rows.isTable:
                raise InvalidArgument("chunk takes a table first: chunk(TABLE(...))")
            given = {"text": (text, "text"), "language": (language, "language"), "line": (line, None), "chunker": (chunker, "auto")}
            values = {k: v.value if v is not None else usual for k, (v, usual) in given.items()}
            if values["chunker"] not in known:
                raise InvalidArgument(f"no chunker {values['chunker']!r}; there are {', '.join(sorted(known))}")
            for k in ("text", "language", "line"):
                if values[k] is not None and values[k] not in rows.dataType.names:
                    raise InvalidArgument(f"the table has no column {values[k]!r} for {k}")
            out = StructType([f for f in rows.dataType.fields if f.name not in (values["text"], values["line"])])
            clash = set(out.names) & set(_CHUNK.names)
            if clash:
                raise InvalidArgument(f"columns of chunks are in the table already: {', '.join(sorted(clash))}")
            return AnalyzeResult(schema=StructType(out.fields + _CHUNK.fields))

        def eval(self, rows, text="text", language="language", line=None, chunker="auto"):
            body = rows[text]
            if body is None:
                return
            rest = [rows[c] for c in rows.__fields__ if c not in (text, line)]
            first = 1 if line is None else rows[line]
            for k, c in enumerate(known[chunker](body, rows[language], first)):
                yield (*rest, k, *c)

    return udtf(Chunks, useArrow=True)


def register(spark: SparkSession, name: str = "chunk") -> None:
    """Make the function known to SQL, with the chunkers registered so far."""
    spark.udtf.register(name, _function(dict(CHUNKERS)))


def chunks(docs: DataFrame, chunker: str, text_col: str = "text", language_col: str = "language", line_col: str | None = None) -> DataFrame:
    """The columns of syntax.chunks, by a registered chunker; a text that is null gives nothing."""
    spark = docs.sparkSession
    register(spark, "quarry_chunk")
    names = [f"`text` => '{text_col}'", f"`language` => '{language_col}'", *([f"line => '{line_col}'"] if line_col else []), f"chunker => '{chunker}'"]
    return spark.sql(f"SELECT * FROM quarry_chunk(TABLE(SELECT * FROM {{docs}}), {', '.join(names)})", docs=docs)
