"""Syntax chunks: tiling, budgets, leads that travel, lines, and trails of headings."""

import random

import pytest
from pyspark.sql import functions as F

from quarry.operators import outline, syntax

GO = """package store

import "fmt"

// Box holds one value and says how often it was read.
type Box struct {
	value int
}

// Open reads the value of the box, counts the access and gives
// an error where nothing was ever put into it.
func (b *Box) Open(name string) (int, error) {
	if b.value == 0 {
		return 0, fmt.Errorf("empty: %s", name)
	}
	return b.value, nil
}
"""
PYTHON = '# a module\nimport os\n\n\ndef read(path):\n    """Read it."""\n    with open(path) as f:\n        return f.read()\n\n\nclass A:\n    # what it does\n    def b(self):\n        return 1\n'
LUA = "local M = {}\n\n--[[ long\ncomment ]]\nfunction M.show(x)\n  if x then\n    return x\n  else\n    return nil\n  end\nend\n\nreturn M\n"
NIX = "{ pkgs }:\n# shell\npkgs.mkShell {\n  packages = [ pkgs.go ];\n}\n"
RUST = "//! A worker.\nuse std::fmt;\n\n/// Splits.\npub struct S {\n    w: usize,\n}\n\nimpl S {\n    /// Do it.\n    fn go(&self) -> usize {\n        self.w\n    }\n}\n"
MARKDOWN = """# Handbook

Some words first.

## How data flows

A file becomes rows.

### First level

Stores and streams.

## Removal

Order matters here.

Underlined part
---------------

The last words, which are
on two lines.

```sh
# no heading
run it
```
"""
SAMPLES = [(GO, "go"), (PYTHON, "python"), (LUA, "lua"), (NIX, "nix"), (RUST, "rust"), (MARKDOWN, "markdown"), ("x := \"" + "é" * 3000 + '"\n', "go"), ("func ( { { {", "go"), ("", "go"), ("\n\n \t\n", "markdown"), ("```\n# open fence\n" + "word " * 400, "markdown"), ("a\r\n=\r\n\r\nb\r\n", "markdown")]


@pytest.mark.parametrize("budget", [4, 60, 200, 512, 1200])
def test_chunks_tile_the_text(budget):
    for text, language in SAMPLES:
        found, _, feeds = syntax.cut(text, language, budget)
        data = text.encode()
        assert "".join("".join(c[2] for c in found).split()) == "".join(text.split())
        for (a, b, t), after in zip(found, [*found[1:], None]):
            assert data[a:b].decode() == t and b - a <= budget and (after is None or b <= after[0])
        assert feeds == [n for n, c in enumerate(data) if c == 10]
        assert found == syntax.cut(text, language, budget)[0]


def test_pieces_cover_without_gaps_on_random_texts():
    rng = random.Random(4)
    for _ in range(300):
        text = "".join(rng.choice(["# a", "## é", "```", "word", " ", "\n", "\n\n", "\t", "// c", "}", "{", "---", "--[[", "]]"]) for _ in range(rng.randint(0, 60)))
        for language in ("markdown", "go", "lua", "python"):
            data, budget = text.encode(), rng.choice([5, 17, 60])
            got = list(syntax.pieces(outline.outline(data, language), data, budget))
            assert [p[0] for p in got] == [0, *[p[1] for p in got[:-1]]] if got else not data
            assert not got or got[-1][1] == len(data)
            assert all(b - a <= budget for a, b, _ in got)


def chunk_with(text, language, budget, needle):
    return next(t for _, _, t in syntax.cut(text, language, budget)[0] if needle in t)


def test_comments_stay_with_what_they_introduce():
    assert len(syntax.cut(GO, "go")[0]) == 1
    assert chunk_with(GO, "go", 360, "func (b *Box) Open").startswith("// Open reads")
    alone = chunk_with(GO, "go", 200, "// Open reads")
    assert "type Box" not in alone and "an error where" in alone
    assert chunk_with(GO, "go", 300, "type Box struct").count("func") == 0
    assert chunk_with(RUST, "rust", 90, "fn go").startswith(("/// Do it.", "impl S"))


def rows_of(spark, *texts, budget=60):
    docs = spark.createDataFrame([(n, t, lang, 5) for n, (t, lang) in enumerate(texts)], "doc int, text string, language string, line int")
    return {(r["doc"], r["chunk_index"]): r for r in syntax.chunks(docs, "doc", line_col="line", budget=budget).collect()}


def test_trails(spark):
    got = rows_of(spark, (MARKDOWN, "markdown"), ("## One\n\nalpha prose that runs on for a while here.\n\n## Two\n\nbeta prose that also runs on for a while.\n", "markdown"), (GO, "go"), ("one two three", None), ("  ", "markdown"), (None, "markdown"))
    by_text = {(d, r["text"]): r for (d, _), r in got.items()}
    find = lambda d, needle: next(r for (k, t), r in by_text.items() if k == d and needle in t)
    assert find(0, "Stores and streams")["context"] == "How data flows"  # its own heading is in the chunk, the title is left out
    assert find(0, "Order matters")["context"] == ""
    assert find(0, "no heading")["context"] == "Underlined part"
    assert find(1, "beta prose")["context"] in ("Two", "") and all("One" not in r["context"] for (d, t), r in by_text.items() if "beta" in t)
    assert {r["context"] for (d, _), r in got.items() if d == 2} == {""}
    assert find(3, "one two three")["start_line"] == 5 and not any(d > 3 for d, _ in got)
    for (d, _), r in got.items():
        text = [MARKDOWN, None, GO][d] if d in (0, 2) else None
        if text:
            assert r["text"].split("\n")[0].strip()[:20] in text.split("\n")[r["start_line"] - 5]


def test_headings_of_both_spellings():
    text = "Top\n===\n\n#not one\n####### seven\n## Two ##\n- item\n---\n\n    # code\n#\ntext\nmore\n---\n~~~\n# in\n```\n~~~\n### Three #x\n"
    found = [(h.level, h.title) for h in outline.headings(outline.outline(text.encode(), "markdown"))]
    assert found == [(1, "Top"), (2, "Two"), (2, "text"), (3, "Three #x")]


def test_trail_of_many_levels(spark):
    text = "# A\n\n## B\n\n#### C\n\n## D\n\n# E\n\n###### F\n\nend\n"
    docs = spark.createDataFrame([(1, text, "markdown")], "doc int, text string, language string")
    rows = syntax.with_trails(syntax.outlined(docs), "doc").where(F.col("kind") == "heading").orderBy("start").collect()
    assert [r["context"] for r in rows] == ["A", "A > B", "A > B > C", "A > D", "E", "E > F"]
