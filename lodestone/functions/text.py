"""String predicates and helpers as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_fold(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def like_ascii_ci(c: Column, pattern) -> Column:
    """LIKE with live % and _, no escape, case-insensitive for ASCII only. pattern: text or a column."""
    p = pattern if isinstance(pattern, Column) else F.lit(pattern)
    if not isinstance(pattern, Column) and re.fullmatch(r"%[^%_\\]*%", pattern):
        return ascii_fold(c).contains(pattern[1:-1].translate(str.maketrans(UPPER, LOWER)))
    return F.like(ascii_fold(c), ascii_fold(p), F.lit("\u0001"))


def glob_like(glob: str) -> str:
    return glob.replace("*", "%")


def last_segment(c: Column) -> Column:
    return F.substring_index(c, ".", -1)


def base_short(c: Column) -> Column:
    """Simple name of a base: without type arguments and qualifiers."""
    return last_segment(F.trim(F.substring_index(c, "<", 1)))


def namespace_of(c: Column) -> Column:
    """All but the last segment; the name itself where there is no dot."""
    return F.when(F.instr(c, ".") > 0, F.regexp_replace(c, r"\.[^.]*$", "")).otherwise(c)


def looks_like_interface(c: Column) -> Column:
    return c.rlike(r"^I\p{Lu}")


def type_name_literal(c: Column) -> Column:
    return c.rlike(r"^\p{Lu}[\p{L}\p{N}_]{3,}$")


def safe_file_name(c: Column) -> Column:
    name = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), r"^[._-]+|[._-]+$", "")
    return F.when(name == "", "symbol").otherwise(name)


# --- full text -----------------------------------------------------------------------------------------------------

MARKS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def plain(c: Column) -> Column:
    return F.translate(F.lower(c), *MARKS)


def tokens(c: Column) -> Column:
    """Lower-cased runs of letters and digits, without accents; an underscore parts words, camel case does not."""
    return F.filter(F.split(plain(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def match(expression: str, *columns: Column) -> Column:
    """A full-text expression over any of the columns: words, "phrases", prefix*, AND (also by a blank), OR, NOT, ()."""
    items = re.findall(r'"[^"]*"|\(|\)|[^\s()"]+', expression)
    toks, at = [tokens(c) for c in columns], [0]

    def term(text: str) -> Column:
        prefix = text.endswith("*")
        words = [w.translate(str.maketrans(*MARKS)) for w in re.findall(r"[^\W_]+", text.lower())]
        if not words:
            return F.lit(False)
        hits = F.lit(False)
        for t in toks:
            if len(words) == 1 and not prefix:
                hits = hits | F.array_contains(t, words[0])
            else:
                joined = F.concat(F.lit(" "), F.array_join(t, " "), F.lit(" "))
                hits = hits | joined.contains(" " + " ".join(words) + ("" if prefix else " "))
        return hits

    def primary() -> Column:
        if at[0] >= len(items):
            raise ValueError(f"incomplete full-text expression: {expression}")
        x = items[at[0]]
        at[0] += 1
        if x == "(":
            inner = either()
            if at[0] >= len(items) or items[at[0]] != ")":
                raise ValueError(f"missing ) in {expression}")
            at[0] += 1
            return inner
        if x in (")", "AND", "OR", "NOT"):
            raise ValueError(f"unexpected {x} in {expression}")
        return term(x)

    def both() -> Column:
        out = primary()
        while at[0] < len(items) and items[at[0]] not in (")", "OR"):
            word = items[at[0]]
            at[0] += word in ("AND", "NOT")
            out = out & ~primary() if word == "NOT" else out & primary()
        return out

    def either() -> Column:
        out = both()
        while at[0] < len(items) and items[at[0]] == "OR":
            at[0] += 1
            out = out | both()
        return out

    found = either()
    if at[0] < len(items):
        raise ValueError(f"unexpected {items[at[0]]} in {expression}")
    return found


def snippet(c: Column, word: str, width: int = 48) -> Column:
    """`width` tokens from the first hit on, the hits in [ ]; '…' where text goes on."""
    t, w = tokens(c), word.lower()
    first = F.greatest(F.array_position(t, w), F.lit(1))
    window = F.transform(F.slice(t, first.cast("int"), width), lambda x: F.when(x == w, F.concat(F.lit("["), x, F.lit("]"))).otherwise(x))
    return F.concat(F.when(first > 1, "…").otherwise(""), F.array_join(window, " "), F.when(F.size(t) >= first + width, "…").otherwise(""))
