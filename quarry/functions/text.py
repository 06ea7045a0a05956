"""Scalar text functions of parsing, labelling and display, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space, in syntax that Java and RE2 share. Fixed values.
SPACE = r"\x{9}-\x{D}\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"

#: Endings of test files; a base name that starts with test_, and these folders, count too. Fixed values.
TEST_ENDINGS = (
    "_test.go", "_test.py", "_test.rs", "_test.ts", "_test.js", ".test.ts", ".test.tsx", ".test.js",
    ".test.jsx", ".spec.ts", ".spec.tsx", ".spec.js", ".spec.jsx", "_spec.rb", "_spec.lua", "_test.exs",
)
TEST_FOLDERS = ("test", "tests", "__tests__", "spec")
TEST_PATTERN = "(" + "|".join(e.replace(".", r"\.") for e in TEST_ENDINGS) + ")$|(^|/)test_[^/]*$|/(" + "|".join(TEST_FOLDERS) + ")/"

#: Grammars by MIME type. Fixed values.
LANGUAGES = {"text/x-go": "go", "text/x-rust": "rust", "text/x-python": "python", "text/x-nix": "nix", "text/x-lua": "lua", "text/markdown": "markdown"}

#: A header from its first line to the first line that is --- but for white space at its end. No group repeats, so length is no matter.
_HEADER = r"(?s)\A(---\r?\n(?:.*?\n)??---[" + SPACE.replace(r"\x{9}-\x{D}", r"\x{9}\x{B}-\x{D}") + r"]*(?:\n|\z))"

#: Which languages put the headings above a chunk before its text when it is embedded.
HEADING_CONTEXT = ("markdown",)


def words(text: Column) -> Column:
    """Runs of characters that are no SPACE. Splitting at blanks costs a fraction of extracting what lies between them."""
    return F.array_remove(F.split(text, f"[{SPACE}]+", -1), "")


def is_test_path(uri: Column) -> Column:
    return F.lower(uri).rlike(TEST_PATTERN)


def language_of(mime: Column) -> Column:
    """Grammar of a MIME type with or without parameters; null for none."""
    bare = F.lower(F.trim(F.split_part(mime, F.lit(";"), F.lit(1))))
    known = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.element_at(known, bare)


def front_matter(text: Column) -> tuple[Column, Column]:
    """(body, starting line) without a YAML header; an unclosed header stays."""
    header = F.regexp_extract(text, _HEADER, 1)
    body = F.substring(text, F.length(header) + 1, F.length(text))
    return body, (F.length(header) - F.length(F.replace(header, F.lit("\n"), F.lit(""))) + 1).cast("int")


def uses_heading_context(language: Column) -> Column:
    return F.coalesce(language.isin(*HEADING_CONTEXT), F.lit(False))


def _as_text(content: Column) -> Column:
    return F.make_valid_utf8(content.cast("string"))


#: Content to (text, starting line), by MIME type; a name that ends in a slash takes all types that begin with it and have none of their own.
#: exactly text/markdown loses its header, other text is decoded as it is.
PARSERS: dict[str, Callable[[Column], tuple[Column, Column]]] = {"text/markdown": lambda c: front_matter(_as_text(c)), "text/": lambda c: (_as_text(c), F.lit(1))}


def supported(mime: Column) -> Column:
    """Whether some parser takes the MIME type; what none takes is a failure, not an empty document."""
    return F.coalesce(_parser(mime) != "", F.lit(False))


def parsed(mime: Column, content: Column) -> tuple[Column, Column]:
    """(text, starting line) by the parser of the MIME type; null and 1 without one."""
    own = _parser(mime)
    text, line = F.lit(None).cast("string"), F.lit(1)
    for name, parse in PARSERS.items():
        body, first = parse(content)
        text, line = F.when(own == name, body).otherwise(text), F.when(own == name, first).otherwise(line)
    return text, line.cast("int")


def _parser(mime: Column) -> Column:
    """The name in PARSERS that a MIME type has its parser under: its own, or else the longest beginning; empty for none."""
    begins = sorted((n for n in PARSERS if n.endswith("/")), key=len, reverse=True)
    found = F.when(mime.isin(*[n for n in PARSERS if not n.endswith("/")]), mime)
    for name in begins:
        found = found.when(F.startswith(mime, F.lit(name)), F.lit(name))
    return found.otherwise("")


def label(display_path: Column, uri: Column) -> Column:
    """Display path, or else the last two components of the URI."""
    parts = F.split(uri, "/", -1)
    last = F.array_join(F.slice(parts, F.greatest(F.size(parts) - 1, F.lit(1)), F.lit(2)), "/")
    return F.when(display_path != "", display_path).otherwise(last)


def embed_text(path: Column, context: Column, text: Column) -> Column:
    """What is embedded: path, context and text, each on a line of its own; empty ones are left out. It is never stored."""
    one = lambda c: F.when(c != "", F.concat(c, F.lit("\n"))).otherwise("")
    return F.concat(one(path), one(context), text)


def snippet(text: Column, most: int) -> Column:
    """White space made single blanks; cut before the character that would pass most bytes, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))
    cut = F.regexp_replace(F.make_valid_utf8(F.substring(F.encode(flat, "UTF-8"), 1, most).cast("string")), "�+$", "")
    return F.when(F.octet_length(flat) > most, F.concat(cut, F.lit("…"))).otherwise(flat)


def clean_path(path: Column) -> Column:
    """A path without empty, . and .. parts and without a slash at its end; the root stays the root, nothing becomes "."."""
    return _named(path, lambda given: _named(F.filter(F.split(given, "/", -1), lambda p: ~p.isin("", ".")), lambda parts: _clean(given, parts)))


def _named(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value worked out once however often then uses it: it is a variable of a lambda function there."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _clean(path: Column, parts: Column) -> Column:
    rooted = F.startswith(path, F.lit("/"))
    plain = F.array_join(parts, "/")

    def step(acc, p):
        up = (p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != "..")
        return F.when(up, F.slice(acc, F.lit(1), F.size(acc) - 1)).when((p == "..") & rooted, acc).otherwise(F.concat(acc, F.array(p)))

    folded = F.when(F.array_contains(parts, ".."), F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")).otherwise(plain)
    return _named(folded, lambda f: F.when(rooted, F.concat(F.lit("/"), f)).otherwise(F.when(f == "", ".").otherwise(f)))


def result_path(uri: Column, root: str) -> Column:
    """Clean local path of a result: file:// decoded, other schemes and empty ones null, relative ones joined to root."""
    path = (
        F.when(F.startswith(uri, F.lit("file://")), F.try_url_decode(F.replace(F.substring(uri, 8, F.length(uri)), F.lit("+"), F.lit("%2B"))))
        .when(uri.rlike("^[A-Za-z][A-Za-z0-9+.-]*://") | (uri == ""), F.lit(None).cast("string"))
        .otherwise(uri)
    )
    return clean_path(_named(path, lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), p))))


def plural(n: Column, noun: str) -> Column:
    return F.concat(n.cast("string"), F.when(n == 1, F.lit(f" {noun}")).otherwise(F.lit(f" {noun}s")))


def percent(done: Column, total: Column) -> Column:
    """Whole percents, rounded down; null without a total."""
    return F.when(total > 0, F.floor(F.try_divide(done, total) * 100))


def activity_line(document: Column, stage: Column, documents: Column, scans: Column) -> Column:
    """What is being worked on and what waits, in one line; empty when nothing is."""
    active = F.when(document != "", F.concat_ws(" ", F.when(stage != "", stage).otherwise("working on"), document))
    waiting = [F.when(n > 0, F.concat(plural(n, noun), F.lit(" queued"))) for n, noun in ((documents, "document"), (scans, "scan"))]
    return F.concat_ws(", ", active, *waiting)


def scan_summary(ingested: Column, removed: Column, failed: Column, unchanged: Column, took_ms: Column, quiet_ms: int = 750) -> Column:
    """What a scan did and how long it took; null where it did nothing and took less than quiet_ms."""
    parts = [F.when(n > 0, F.concat(n.cast("string"), F.lit(f" {word}"))) for n, word in ((ingested, "indexed"), (removed, "removed"), (failed, "failed"))]
    idle = (ingested == 0) & (removed == 0) & (failed == 0)
    said = F.concat_ws(", ", *parts, F.when(idle, F.concat(unchanged.cast("string"), F.lit(" unchanged"))))
    return F.when(~(idle & (took_ms < quiet_ms)), F.concat(said, F.lit(" in "), F.format_string("%.1f", took_ms / 1000), F.lit("s")))


def meter(done: Column, total: Column, cells: int = 14) -> Column:
    """A bar of cells between marks, filled by whole percents and rounded half up; null without a total."""
    percent = F.floor(done / total * 100)
    full = F.floor(F.least(F.lit(1.0), percent / 100) * cells + 0.5).cast("int")
    return F.when(total > 0, F.concat(F.lit("▕"), F.repeat(F.lit("█"), full), F.repeat(F.lit("░"), cells - full), F.lit("▏")))
