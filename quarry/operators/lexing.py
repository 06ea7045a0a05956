"""Statements of source code as nested blocks of bytes, from strings, comments and matched delimiters.

One regular expression a language finds what matters: comments, strings, brackets, separators and
line feeds. Brackets in strings and comments don't count, a closing one without its opening one is
plain text, and one that never closes ends with the text. Statements hold parts between commas,
and those what is in brackets; a comment that opens a line of its own is a lead. Python's
statements are lines, those within brackets or strings being one, nested by their indentation.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


@dataclass
class Block:
    start: int
    end: int
    lead: bool = False  # a comment or a heading: it introduces what comes next
    level: int = 0  # of a heading
    title: str = ""
    children: list[Block] = field(default_factory=list)


# The lexical rules of each language. Every string or comment that isn't closed ends with the line or the text.
_QUOTED = rb'"(?:[^"\\]+|\\[\s\S])*+"?'
_ONE_LINE = rb'"(?:[^"\\\n]+|\\.)*+"?'
_TRIPLE = rb'"""(?:[^"\\]+|\\[\s\S]|"(?!""))*+(?:"""|\Z)' + rb"|'''(?:[^'\\]+|\\[\s\S]|'(?!''))*+(?:'''|\Z)"
_CHAR = rb"'(?:\\[^\n][^'\n]{0,12}|[^'\\\n\x80-\xff]|[\xc0-\xff][\x80-\xbf]{1,3})'"
_RULES = {
    "go": (rb"//[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rb"`[^`]*`?|" + _ONE_LINE + rb"|" + _CHAR, rb""),
    "rust": (rb"//[^\n]*|/\*", rb'\bb?r(?P<hashes>#*)"[\s\S]*?(?:"(?P=hashes)|\Z)|' + _QUOTED + rb"|" + _CHAR, rb""),
    "nix": (rb"#[^\n]*|/\*[\s\S]*?(?:\*/|\Z)", rb"\"|''", rb""),
    "lua": (rb"--\[(?P<c>=*)\[[\s\S]*?(?:\](?P=c)\]|\Z)|--[^\n]*", rb"\[(?P<s>=*)\[[\s\S]*?(?:\](?P=s)\]|\Z)|" + _ONE_LINE + rb"|'(?:[^'\\\n]+|\\.)*+'?", rb"|\b(?:function|if|do|repeat)\b"),
    "python": (rb"#[^\n]*", _TRIPLE + rb'|"(?:[^"\\\n]+|\\[\s\S])*+"?' + rb"|'(?:[^'\\\n]+|\\[\s\S])*+'?", rb""),
}
_SHUT = {"lua": rb"|\b(?:end|until)\b"}
_TOKENS = {
    language: re.compile(rb"(?P<comment>%s)|(?P<string>%s)|(?P<open>[\[({]%s)|(?P<close>[\])}]%s)|(?P<semi>;)|(?P<comma>,)|(?P<feed>\n)" % (comment, string, opens, _SHUT.get(language, b"")))
    for language, (comment, string, opens) in _RULES.items()
}
_PAIR = {b"(": b")", b"[": b"]", b"{": b"}", b"function": b"end", b"if": b"end", b"do": b"end", b"repeat": b"until"}
#: Bytes after which a line feed doesn't end a statement, and words that go on with the one before a closed block.
_GOES_ON = {"go": b"+-*/%&|^<>=!,.:([{", "lua": b"+-*/%^<>=~,.:(&|#", "python": b"\\"}
_NEXT_GOES_ON = {"lua": re.compile(rb"\s*(?:[.:+*/%^<>=~&|,(]|(?:and|or)\b)")}
_NEW_AFTER_BLOCK = re.compile(rb"\s*(?!(?:else|as|where|then|do|and|or)\b)(?:[A-Za-z_#}]|//|/\*|--|\Z)")
_NIX_LINE = re.compile(rb"(?::|\blet|\bin)\Z")
_NESTED = re.compile(rb"/\*|\*/")
_NIX_IN = {b'"': re.compile(rb'\\[\s\S]|\$\{|"'), b"''": re.compile(rb"''\\[\s\S]|'''|''\$|\$\$|\$\{|''")}
_NIX_CODE = re.compile(rb"#[^\n]*|/\*[\s\S]*?(?:\*/|\Z)|\"|''|[{}]")
_GO_ON_WORDS = re.compile(rb"(?:else|elif|except|finally|case)\b")


def _nested_end(data: bytes, at: int) -> int:
    """Where a comment that may hold others ends; at is behind its opening."""
    depth = 1
    for m in _NESTED.finditer(data, at):
        depth += 1 if m.group() == b"/*" else -1
        if depth == 0:
            return m.end()
    return len(data)


def _nix_string_end(data: bytes, at: int, quote: bytes) -> int:
    """Where a string ends that may hold code in ${}, which may hold strings; at is behind its opening."""
    inside = [quote]  # strings and braces that are open
    while inside:
        code = inside[-1] == b"{"
        m = (_NIX_CODE if code else _NIX_IN[inside[-1]]).search(data, at)
        if m is None:
            return len(data)
        token, at = m.group(), m.end()
        if token == inside[-1] and not code or code and token == b"}":
            inside.pop()
        elif token == b"${" or code and token == b"{":
            inside.append(b"{")
        elif code and token in _NIX_IN:
            inside.append(token)
    return at


def tokens(data: bytes, language: str) -> Iterator[tuple[str, int, int]]:
    """(kind, start, end) of comments, strings, brackets (open, close), semi, comma and feed, in order."""
    rule, at = _TOKENS[language], 0
    while m := rule.search(data, at):
        kind, (start, at) = m.lastgroup, m.span()
        if m.group("comment") is not None:
            kind = "comment"
            if language == "rust" and m.group() == b"/*":
                at = _nested_end(data, at)
        elif m.group("string") is not None:
            kind = "string"
            if language == "nix":
                at = _nix_string_end(data, at, m.group())
        yield kind, start, at


class _Group:
    """What is between two brackets: its block, what closes it, and the statement and part that are open in it."""

    __slots__ = ("block", "shut", "statement", "part")

    def __init__(self, block: Block, shut: bytes):
        self.block, self.shut, self.statement, self.part = block, shut, None, None

    def take(self, start: int, end: int, lead: bool = False) -> None:
        if self.statement is None:
            self.statement = Block(start, end)
            self.block.children.append(self.statement)
        if self.part is None:
            self.part = Block(start, end, lead)
            self.statement.children.append(self.part)
        self.statement.end = self.part.end = end

    def end_part(self) -> None:
        self.part = None

    def end_statement(self) -> None:
        """A statement of one part takes that part's place, so depth grows by what is really nested."""
        if self.statement is not None and len(self.statement.children) == 1:
            self.block.children[-1] = self.statement.children[0]
        self.statement = self.part = None


def statements(data: bytes, language: str) -> Block:
    """The text as a block of its statements; in Python each line that brackets and strings don't hold together."""
    root = Block(0, len(data))
    groups = [_Group(root, b"")]
    at = 0  # behind the last token
    going = 0  # up to here line feeds end nothing, since what follows them goes on

    def shut(upto: int, end: int) -> None:
        while len(groups) > upto:
            inner = groups.pop()
            inner.end_statement()
            inner.block.end = end
            groups[-1].take(inner.block.start, end)

    def plain(end: int) -> None:
        body = data[at:end]
        left = len(body) - len(body.lstrip())
        if left < len(body):
            groups[-1].take(at + left, at + len(body.rstrip()))

    for kind, start, end in tokens(data, language):
        plain(start)
        top = groups[-1]
        at = end
        if kind == "comment":
            held = top.part or (top.statement or top.block).children[-1:]
            held = held[0] if isinstance(held, list) and held else held or None
            if held is not None and not held.lead and data.find(b"\n", held.end, start) < 0:  # behind a statement on its line
                for block in (held, top.statement):
                    if block is not None:
                        block.end = end
            elif top.part is None:
                top.take(start, end, lead=True)
                top.end_part()
                if len(top.statement.children) == 1:
                    top.end_statement()
            else:
                top.take(start, end)
        elif kind == "string":
            top.take(start, end)
        elif kind == "open":
            top.take(start, end)
            inner = Block(start, end)
            top.part.children.append(inner)
            groups.append(_Group(inner, _PAIR[data[start:end]]))
        elif kind == "close":
            mark = data[start:end]
            depth = next((n for n in range(len(groups) - 1, max(0, len(groups) - 200), -1) if groups[n].shut == mark), 0)
            if not depth:
                top.take(start, end)
                continue
            shut(depth, end)
            if language in ("go", "rust", "lua") and mark in (b"}", b"end") and _NEW_AFTER_BLOCK.match(data, end):
                groups[-1].end_statement()
        elif kind == "semi":
            top.take(start, end)
            top.end_statement()
        elif kind == "comma":
            top.take(start, end)
            top.end_part()
        elif top.statement is not None:  # a line feed
            last = data[top.statement.end - 1 : top.statement.end]
            if language == "rust":
                continue
            if language == "nix":
                ends = top.shut == b"]" or _NIX_LINE.search(data, max(0, top.statement.end - 4), top.statement.end)
            elif language == "python":
                ends = len(groups) == 1 and last != b"\\"
            else:
                doubled = data[top.statement.end - 2 : top.statement.end] in (b"++", b"--")
                ends = end > going and (doubled or last not in _GOES_ON[language])
                if ends and language in _NEXT_GOES_ON and (after := _NEXT_GOES_ON[language].match(data, end)):
                    ends, going = False, after.end()
            if ends:
                top.end_statement()
    plain(len(data))
    shut(1, max(len(data.rstrip()), at))  # a string that isn't closed holds the white space at the end, too
    groups[0].end_statement()
    return root


def by_indent(root: Block, data: bytes) -> Block:
    """Lines nested by indentation: one holds those below it that are indented further, and those that go on with it."""
    out = Block(root.start, root.end)
    open_: list[tuple[float, Block]] = [(-1, out)]
    last = margin = 0  # where the line before ends, and how far the last one was indented
    for line in root.children:
        feed = data.rfind(b"\n", last, line.start)
        if feed >= 0 or not last:
            depth = margin = line.start - feed - 1
        else:
            depth = margin + 0.5  # behind a semicolon: within what the line opens with
        last = line.end
        while open_[-1][0] > depth:
            open_.pop()
        if open_[-1][0] == depth and open_[-1][1] is not out and _GO_ON_WORDS.match(data, line.start):
            block = None
        else:
            while open_[-1][0] >= depth:
                open_.pop()
            block = Block(line.start, line.end, line.lead)
        open_[-1][1].children.append(block or line)
        for _, above in open_[1:]:
            above.end = line.end
        if block is not None and not line.lead:
            block.children.append(line)
            open_.append((depth, block))
    return out


def code(data: bytes, language: str) -> Block:
    """The outline of code: where its statements, their parts and what is in their brackets begin and end."""
    found = statements(data, language)
    return by_indent(found, data) if language == "python" else found
