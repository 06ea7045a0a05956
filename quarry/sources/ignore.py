"""Ignore files: patterns of one folder, and the verdict of all folders above a path."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Pattern:
    regex: re.Pattern
    negated: bool
    folders_only: bool


def _regex(glob: str) -> str:
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        elif glob[i] == "[" and (end := glob.find("]", i + 2)) > 0:
            body = glob[i + 1 : end]
            out, i = out + "[" + ("^" + body[1:] if body[0] in "!^" else body).replace("\\", "\\\\") + "]", end + 1
        elif glob[i] == "\\" and i + 1 < len(glob):
            out, i = out + re.escape(glob[i + 1]), i + 2
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def parse(text: str) -> list[Pattern]:
    """Patterns of an ignore file, in order. A slash inside a pattern ties it to the file's own folder."""
    found = []
    for line in text.splitlines():
        line = re.sub(r"(?<!\\)\s+$", "", line)
        if not line or line.startswith("#"):
            continue
        negated = line.startswith("!")
        glob = line[1:] if negated else line
        folders = glob.endswith("/")
        glob = glob.rstrip("/")
        tied = "/" in glob
        found.append(Pattern(re.compile(("" if tied else "(?:.*/)?") + _regex(glob.lstrip("/")) + r"\Z"), negated, folders))
    return found


def ignored(rules: list[tuple[str, list[Pattern]]], path: str, is_folder: bool) -> bool:
    """Whether the last pattern that fits path ignores it. rules: (folder, its patterns) from the root down; paths are relative to the root."""
    verdict = False
    for folder, patterns in rules:
        if folder and not path.startswith(folder + "/"):
            continue
        own = path[len(folder) + 1 :] if folder else path
        for p in patterns:
            if (is_folder or not p.folders_only) and p.regex.match(own):
                verdict = not p.negated
    return verdict
