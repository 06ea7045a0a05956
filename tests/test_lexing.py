"""Boundaries of code: strings, comments and delimiters of each language, and cuts against a plain account of them."""

import random
import time

import pytest

from quarry.operators import lexing, syntax
from quarry.operators.outline import outline


def kinds(text, language):
    data = text.encode()
    return [(k, data[a:b].decode()) for k, a, b in lexing.tokens(data, language) if k != "feed"]


def tops(text, language):
    data = text.encode()
    return [data[b.start : b.end].decode() for b in outline(data, language).children]


def chunk_texts(text, language, budget):
    return [t for _, _, t in syntax.cut(text, language, budget)[0]]


@pytest.mark.parametrize(
    ("language", "text", "strings", "comments"),
    [
        ("go", 'a := `x { " // y` + "b \\" }" + \'}\' // c {\n/* d\n } */', ['`x { " // y`', '"b \\" }"', "'}'"], ["// c {", "/* d\n } */"]),
        ("rust", "let a: &'static str = r#\"x \" { \"#; '\\''; b'}'; \"two\nlines }\"; /* a /* b { */ } */ x", ['r#"x " { "#', "'\\''", "'}'", '"two\nlines }"'], ["/* a /* b { */ } */"]),
        ("lua", "x = [==[ a ]] end { ]==] .. 'it\\'s }' --[[ if\n do ]] -- end\n", ["[==[ a ]] end { ]==]", "'it\\'s }'"], ["--[[ if\n do ]]", "-- end"]),
        ("nix", "{ a = \"x ${f { b = \"}\"; }} y\"; c = ''\n  ''${no} ''' } ${\"z\"}\n''; } # e {", ['"x ${f { b = "}"; }} y"', "''\n  ''${no} ''' } ${\"z\"}\n''"], ["# e {"]),
        ("python", "a = '''x\n# no (''' + \"(\" # yes (\nb = r'\\'('", ["'''x\n# no ('''", '"("', "'\\'('"], ["# yes ("]),
    ],
)
def test_brackets_in_strings_and_comments_do_not_count(language, text, strings, comments):
    found = kinds(text, language)
    assert [t for k, t in found if k == "string"] == strings
    assert [t for k, t in found if k == "comment"] == comments


def test_statements_of_each_language():
    assert tops("func a() {\n\tx()\n}\n\nfunc b() int { return 1 }; var c = d +\n\te\n", "go") == ["func a() {\n\tx()\n}", "func b() int { return 1 };", "var c = d +\n\te"]
    assert tops("#[test]\nfn a() { b(); } fn c() -> T\nwhere T: X,\n{ d }\n\nlet e = f()\n    .g();\n", "rust") == ["#[test]\nfn a() { b(); }", "fn c() -> T\nwhere T: X,\n{ d }", "let e = f()\n    .g();"]
    assert tops("if a then b() else c() end function d() return { 1, 2 } end\nlocal e = f\n  .. g\n", "lua") == ["if a then b() else c() end", "function d() return { 1, 2 } end", "local e = f\n  .. g"]
    assert tops("{ pkgs, ... }:\nlet\n  a = 1;\n  b = { c = 2; };\nin\npkgs.d\n", "nix") == ["{ pkgs, ... }:", "let", "a = 1;", "b = { c = 2; };", "in", "pkgs.d"]
    assert tops("def a(\n  b,\nc):\n    return '''\nd\n'''\n\nif x: y\nelif z:\n    pass\nelse: w\ne = 1; f = 2\n", "python") == ["def a(\n  b,\nc):\n    return '''\nd\n'''", "if x: y\nelif z:\n    pass\nelse: w", "e = 1; f = 2"]


def test_a_file_of_one_line_is_cut_at_its_blocks():
    go = " ".join(f"func f{n}(a int) int {{ if a > {n} {{ return a }}; return g(a, {n}) }};" for n in range(40))
    rust = "".join(f'fn f{n}(a: u8) -> u8 {{ let b = "}}"; match a {{ {n} => {{ b }}, _ => a }} }}' for n in range(40))
    lua = " ".join(f"function f{n}(a) if a then return '{n} end' end end" for n in range(40))
    nix = "{ " + " ".join(f'a{n} = {{ b = "}}"; c = [ {n} ]; }};' for n in range(40)) + " }"
    for text, language, opening in ((go, "go", "func f"), (rust, "rust", "fn f"), (lua, "lua", "function f")):
        found = chunk_texts(text, language, 200)
        assert len(found) >= 10 and all(t.startswith(opening) for t in found)
        assert all(len(t.encode()) <= 200 for t in found)
    inner = chunk_texts(nix, "nix", 200)
    assert all(t.startswith(("{", "a")) and t.endswith((";", "}")) for t in inner)


def test_a_list_beyond_the_budget_is_cut_behind_its_commas():
    text = "x = [" + ", ".join(f'"it, {n}"' for n in range(100)) + "]\n"
    found = chunk_texts(text, "python", 100)
    assert len(found) > 5 and all(t.endswith((",", "]")) for t in found)
    assert all(t.count('"') % 2 == 0 for t in found)


def test_python_keeps_indentation_outside_brackets_and_strings():
    text = 'class A:\n    def b(self):\n        return (\n1,\n            2)\n\n    def c(self):\n        x = """\ndef no():\n"""\n        return x\n\ndef d():\n    pass\n'
    (a, d) = tops(text, "python")
    assert a.startswith("class A") and a.endswith("return x") and d.startswith("def d")
    found = chunk_texts(text, "python", 70)
    assert [t.split("\n")[0] for t in found if t.startswith(("def", "class"))] == ["class A:", "def c(self):", "def d():"]


def test_comments_lead_on_lines_of_their_own_only():
    data = b"a(); // about a\n// about b\nb() {\n  // inside\n  c();\n}\n"
    root = outline(data, "rust")
    assert [(data[b.start : b.end].split(b"\n")[0], b.lead) for b in root.children] == [(b"a(); // about a", False), (b"// about b", True), (b"b() {", False)]


def plain_cut(data, language, budget):
    """The account that the chunks are held against: open blocks one inside another, then take pieces one by one."""
    root = outline(data, language)

    def own(block, depth):
        if block.end - block.start <= budget:
            return [(block.start, block.end, block.lead)]
        if depth >= syntax.DEEPEST or not block.children:
            return by_lines(block.start, block.end)
        out, at = [], block.start
        for child in block.children:
            out += by_lines(at, child.start) + own(child, depth + 1)
            at = child.end
        return out + by_lines(at, block.end)

    def by_lines(a, b):
        out = []
        while b - a > budget:
            fits = [n + 1 for n in range(a, a + budget) if data[n] == 10]
            at = fits[-1] if fits else max((n for n in range(a + 1, a + budget + 1) if data[n] & 0xC0 != 0x80), default=None)
            if at is None:
                break
            out.append((a, at, False))
            a = at
        return [*out, (a, b, False)] if b > a else out

    chunks, held = [], []
    for piece in own(root, 0):
        blank = not data[piece[0] : piece[1]].strip()
        if not held and blank:
            continue
        if held and piece[1] - held[0][0] > budget:
            tail = len(held)
            while tail and (held[tail - 1][2] or not data[held[tail - 1][0] : held[tail - 1][1]].strip()):
                tail -= 1
            while tail < len(held) and not held[tail][2]:  # leads begin with a lead, not with a blank
                tail += 1
            moved = held[tail:] if tail else []
            chunks.append(held[:tail] if moved else held)
            if moved and piece[1] - moved[0][0] > budget:
                chunks.append(moved)
                moved = []
            held = moved
        held = [*held, piece]
    chunks += [held] if held else []
    found = [data[c[0][0] : c[-1][1]].decode("utf-8", "replace").strip(syntax._SPACE) for c in chunks]
    return [t for t in found if t]


WORDS = ["fn a() ", "{", "}", "(", ")", "[", "]", ";", ",", "\n", "\n\n", " ", "\n    ", "// c\n", "# d\n", "--[[ e ]]", "-- f\n", '"s"', '"', "'", "'''", "``", "/* g */", "if x then ", " end", "function ", "é", "word", "else:", "x = 1", "## h\n", "```\n", "---\n"]


def test_cuts_equal_the_plain_account():
    rng = random.Random(11)
    for n in range(1500):
        text = "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 80)))
        for language in ("go", "rust", "python", "lua", "nix", "markdown"):
            budget = rng.choice([4, 9, 25, 60, 200])
            found = chunk_texts(text, language, budget)
            assert found == plain_cut(text.encode(), language, budget), (n, language, budget, text)
            assert "".join("".join(found).split()) == "".join(text.split())


def test_children_follow_each_other_within_their_block():
    rng = random.Random(12)
    for _ in range(500):
        data = "".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60))).encode()
        for language in ("go", "rust", "python", "lua", "nix"):
            todo = [outline(data, language)]
            while todo:
                block = todo.pop()
                at = block.start
                for child in block.children:
                    assert at <= child.start <= child.end <= block.end
                    at = child.end
                todo += block.children


@pytest.mark.parametrize("language", ["go", "rust", "python", "lua", "nix"])
def test_hostile_texts_take_linear_time(language):
    for unit in ("(", ")", "{ ] ", '"', '"\\', "/*", "a;", "x\n", "\n", "if do function ", "'''", "''${", "} ", "--[[", "x = \n\n", "f,", "# c\n"):
        began = time.monotonic()
        syntax.cut(unit * 40_000, language)
        assert time.monotonic() - began < 8, unit
