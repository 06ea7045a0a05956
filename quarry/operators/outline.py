"""Where texts may be cut: outlines of Markdown and of code, as nested blocks of bytes.

No grammar is at hand, so Markdown is scanned by its block rules (headings of both spellings,
fences, blank lines) and code by its strings, comments and delimiters (lexing). An outline is a
Block whose children follow each other; what lies between children belongs to no child.
"""

from __future__ import annotations

import re

from quarry.operators.lexing import Block, code

_LINE = re.compile(rb"[^\n]*\n|[^\n]+\Z")
_FENCE = re.compile(rb" {0,3}(`{3,}|~{3,})")
_ATX = re.compile(rb" {0,3}(#{1,6})(?:[ \t]+(.*?))?[ \t]*\r?\n?\Z", re.S)
_UNDERLINE = re.compile(rb" {0,3}(=+|-+)[ \t]*\r?\n?\Z")
_NO_PARAGRAPH = re.compile(rb" {0,3}(?:[-*+>|]|\d+[.)]|(?:[*_-][ \t]*){3,}\r?\n?\Z)")


def _markdown_blocks(data: bytes) -> list[Block]:
    """Headings, fenced blocks and runs of other lines, in order; blank lines belong to none."""
    out: list[Block] = []
    fence, opened = None, 0
    run: list[tuple[int, int]] = []

    def close_run() -> None:
        if run:
            out.append(Block(run[0][0], run[-1][1], children=[Block(a, b) for a, b in run] if len(run) > 1 else []))
            run.clear()

    for m in _LINE.finditer(data):
        (a, b), line = m.span(), m.group()
        mark = _FENCE.match(line)
        if fence is not None:
            if mark and mark.group(1)[:1] == fence[:1] and len(mark.group(1)) >= len(fence) and not line[mark.end() :].strip():
                out.append(Block(opened, b))
                fence = None
        elif mark:
            close_run()
            fence, opened = mark.group(1), a
        elif not line.strip():
            close_run()
        elif heading := _ATX.match(line):
            close_run()
            title = re.sub(rb"(?:^|[ \t]+)#+\Z", b"", heading.group(2) or b"").strip().decode("utf-8", "replace")
            out.append(Block(a, b, bool(title), len(heading.group(1)) if title else 0, title))
        elif run and (under := _UNDERLINE.match(line)) and not _NO_PARAGRAPH.match(data[run[-1][0] : run[-1][1]]):
            first = data[run[0][0] : run[0][1]].strip().decode("utf-8", "replace")
            out.append(Block(run[0][0], b, True, 1 if under.group(1)[:1] == b"=" else 2, first))
            run.clear()
        else:
            run.append((a, b))
    close_run()
    if fence is not None:
        out.append(Block(opened, len(data)))
    return out


def markdown(data: bytes) -> Block:
    """Sections by their headings, nested by level; each holds its heading, its blocks and the sections below it."""
    root = Block(0, len(data))
    open_ = [root]
    for block in _markdown_blocks(data):
        if block.level:
            while open_[-1].level >= block.level:
                open_.pop()
            section = Block(block.start, block.end, level=block.level)
            open_[-1].children.append(section)
            open_.append(section)
        open_[-1].children.append(block)
        for section in open_[1:]:
            section.end = max(section.end, block.end)
    return root


def outline(data: bytes, language: str) -> Block:
    return markdown(data) if language == "markdown" else code(data, language)


def headings(block: Block) -> list[Block]:
    """Headings of an outline, in order."""
    if block.level and block.title:
        return [block]
    return [h for child in block.children for h in headings(child)]
