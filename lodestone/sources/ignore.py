"""Gitignore rules as ordered regular expressions.

The last match wins, but for one case: a rule that takes back a folder does not take back what a rule for the files
themselves has ignored.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Patterns that always apply: fixed values.
DEFAULTS = [
    "**/.git/**",
    "**/bin/**",
    "**/obj/**",
    "**/node_modules/**",
    "**/.vs/**",
    "**/packages/**",
    "**/__pycache__/**",
    "**/.venv/**",
    "**/venv/**",
    "**/dist/**",
    "**/build/**",
    "**/.idea/**",
    "**/.cursor/**",
    "**/*.dll",
    "**/*.exe",
    "**/*.pdb",
    "**/*.cache",
]


class Rule(NamedTuple):
    matches: re.Pattern  # on the relative path
    own: re.Pattern | None  # matches only what the rule itself names, not what lies below; None for rules of folders
    ignored: bool


def compile_rules(patterns: list[str]) -> list[Rule]:
    """A rule for each line; blank lines and comments are left out."""
    return [r for p in patterns if (r := _rule(p))]


def _rule(line: str) -> Rule | None:
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep = line.startswith("!")
    p = line[keep:].removeprefix("\\")
    folder = p.endswith("/")
    p = p.rstrip("/")
    anchored = "/" in p
    p = p.removeprefix("/")
    out, i = "", 0
    while i < len(p):
        if p.startswith("**/", i):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif p.startswith("/**", i) and i + 3 == len(p):
            out, i = out + "/.+", i + 3
        elif p[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif p[i] == "?":
            out, i = out + "[^/]", i + 1
        elif p[i] == "[" and (j := p.find("]", i + 2)) > 0:
            body = p[i + 1 : j]
            out, i = out + "[" + ("^" + body[1:] if body[:1] == "!" else body).replace("\\", "\\\\") + "]", j + 1
        else:
            out, i = out + re.escape(p[i]), i + 1
    own = ("" if anchored else "(?:.*/)?") + out
    below = re.compile(f"^{own}" + ("/.*" if folder else "(?:/.*)?") + "$")
    return Rule(below, None if folder else re.compile(f"^{own}$"), not keep)


def build_spec(gitignore: str = "", extra: tuple[str, ...] = (), use_gitignore: bool = True) -> list:
    lines = DEFAULTS + (gitignore.splitlines() if use_gitignore else []) + list(extra)
    return compile_rules(lines)


def is_ignored(spec: list, relative: str | None) -> bool:
    """The root ('') is never ignored; a path outside the root (None) always is."""
    if relative is None:
        return True
    hit, by_name = False, False
    for rule in spec:
        if not relative or not rule.matches.match(relative):
            continue
        named = bool(rule.own and rule.own.match(relative))
        if rule.ignored or named or not by_name:
            hit, by_name = rule.ignored, named
    return hit


def ignored_column(path, spec: list):
    """The same test as a column expression over a relative path."""
    from pyspark.sql import functions as F

    no = F.lit(False)
    hit = by_name = no
    for rule in spec:
        match, named = path.rlike(rule.matches.pattern), path.rlike(rule.own.pattern) if rule.own else no
        if rule.ignored:
            hit, by_name = F.when(match, True).otherwise(hit), F.when(match, named).otherwise(by_name)
        else:
            hit, by_name = F.when(match & (named | ~by_name), False).otherwise(hit), by_name | named
    return hit
