"""A syntactic extractor for C#: one source text to symbol rows and raw edges. No compiler, never raises on bad code.

A lexer drops comments and preprocessor lines and yields words, punctuation and literals; a walker follows declarations
by braces with a stack of scopes. Columns are byte columns, lines count from 1.
"""

from __future__ import annotations

import json
import re

TOKEN = re.compile(
    r'(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|\Z)|(?m:^[ \t]*\#[^\n]*))|(?P<raw>\$*"""+.*?(?:"""+|\Z))|(?P<verb>(?:\$@|@\$|@)"(?:[^"]|"")*(?:"|\Z))'
    r'|(?P<interp>\$"(?:\\.|\{[^{}\n]*\}|[^"\\\n])*(?:"|$))|(?P<str>"(?:\\.|[^"\\\n])*(?:"|(?=\n)|\Z))|(?P<chr>\'(?:\\.|[^\'\\\n])*(?:\'|(?=\n)|\Z))'
    r"|(?P<word>@?[^\W\d]\w*)|(?P<num>\d[\w.]*)|(?P<op>=>|::|\?\.|\?\?|->|[<>=!+\-*/%&|^]=|&&|\|\||\+\+|--|.)",
    re.S,
)
TYPES = {"class": "type", "struct": "type", "record": "type", "interface": "interface", "enum": "enum"}
MODIFIERS = set("public private protected internal static abstract sealed partial readonly ref unsafe new virtual override async extern const volatile required file fixed event implicit explicit scoped".split())
NO_CALL = set("if for foreach while switch using lock catch typeof sizeof default checked unchecked new return await throw when in is as base this fixed else do out ref stackalloc and or not".split())
BUDGET = 256


class Tokens:
    def __init__(self, text: str):
        self.kind, self.text, self.at = [], [], []
        for m in TOKEN.finditer(text):
            if m.lastgroup != "skip":
                self.kind.append(m.lastgroup)
                self.text.append(m[0])
                self.at.append(m.start())
        self.source, self.match = text, {}
        stack, pair = [], {")": "(", "]": "[", "}": "{"}
        for i, t in enumerate(self.text):
            if self.kind[i] == "op":
                if t in "([{":
                    stack.append(i)
                elif t in pair:
                    while stack and self.text[stack[-1]] != pair[t]:
                        self.match[stack.pop()] = i
                    if stack:
                        self.match[stack.pop()] = i
        for i in stack:
            self.match[i] = len(self.text)
        self.opening = {close: i for i, close in self.match.items()}
        self.lines = [0] + [m.end() for m in re.finditer("\n", text)]

    def place(self, offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.lines, offset) - 1
        return line + 1, len(self.source[self.lines[line] : offset].encode("utf-8", "replace"))

    def span(self, a: int, b: int) -> tuple[int, int, int, int]:
        """Of the tokens a..b, both included: start line, end line, start column, end column."""
        b = max(a, min(b, len(self.text) - 1))
        (sl, sc), (el, ec) = self.place(self.at[a]), self.place(self.at[b] + len(self.text[b]))
        return sl, el, sc, ec

    def join(self, a: int, b: int) -> str:
        """The source between tokens a and b (b not included), as written."""
        return self.source[self.at[a] : self.at[b - 1] + len(self.text[b - 1])] if a < b else ""


class Extract:
    def __init__(self, text: str, literals: bool):
        self.t, self.literals, self.left = Tokens(text), literals, BUDGET
        self.symbols: list[dict] = []
        self.edges: list[dict] = []

    def symbol(self, kind: str, name: str, scope: list[str], a: int, b: int) -> str:
        q = ".".join([*scope, name]).replace(" ", "")
        sl, el, sc, ec = self.t.span(a, b)
        self.symbols.append({"kind": kind, "name": name, "qualified_name": q, "span_start_line": sl, "span_end_line": el, "span_start_col": sc, "span_end_col": ec})
        return q

    def edge(self, kind: str, src: str | None, guess: str | None, confidence: str, a: int, b: int, meta: dict) -> None:
        sl, el, sc, ec = self.t.span(a, b)
        meta_json = json.dumps(meta, ensure_ascii=False, separators=(",", ":"))
        self.edges.append({"edge_type": kind, "src_symbol_name": src, "dst_qualified_guess": guess, "confidence": confidence, "ref_start_line": sl, "ref_start_col": sc, "ref_end_line": el, "ref_end_col": ec, "meta_json": meta_json})

    def skip_angle(self, i: int) -> int:
        """Past a type argument list that opens at i; i itself if it is not one."""
        depth, j = 0, i
        while j < len(self.t.text):
            x = self.t.text[j]
            if x == "<":
                depth += 1
            elif x == ">":
                depth -= 1
                if not depth:
                    return j + 1
            elif x in "([" and j in self.t.match:
                j = self.t.match[j]
            elif self.t.kind[j] not in ("word", "op") or x in (";", "{", "}", ")", "&&", "||", "="):
                return i
            j += 1
        return i

    def until(self, i: int, end: int, stops: tuple[str, ...]) -> int:
        """The first stop token from i on, brackets skipped; end if there is none."""
        while i < end:
            if self.t.text[i] in stops and self.t.kind[i] == "op":
                return i
            i = self.t.match.get(i, i) + 1 if self.t.text[i] in "([{" and self.t.kind[i] == "op" else i + 1
        return end

    def split(self, a: int, b: int) -> list[tuple[int, int]]:
        """Token ranges between the commas of a..b, brackets and type arguments skipped."""
        out, start, i = [], a, a
        while i < b:
            x = self.t.text[i]
            if x == "," :
                out.append((start, i))
                start = i + 1
            if x == "<":
                i = max(self.skip_angle(i), i + 1)
            elif x in "([{" and self.t.kind[i] == "op":
                i = self.t.match[i] + 1
            else:
                i += 1
        return out + [(start, b)] if start < b else out

    def walk(self, a: int, b: int, scope: list[str], owner: str | None, kind: str | None) -> None:
        i, tx = a, self.t.text
        while i < b:
            if tx[i] in (";", "}"):
                i += 1
            elif tx[i] == "[":
                self.strings(i, min(self.t.match[i], b), owner)
                i = self.t.match[i] + 1
            else:
                i = max(i + 1, self.member(i, b, scope, owner, kind))

    def member(self, i: int, b: int, scope: list[str], owner: str | None, inside: str | None) -> int:
        t, start = self.t, i
        tx = t.text
        if tx[i] == "global" and i + 1 < b and tx[i + 1] == "using":
            i += 1
        if tx[i] == "using" and owner is None and i + 1 < b and tx[i + 1] != "(":
            end = self.until(i, b, (";",))
            words = list(range(i + 1, end))
            static = bool(words) and tx[words[0]] == "static"
            words = words[static:]
            alias = None
            if len(words) > 1 and tx[words[1]] == "=":
                alias, words = tx[words[0]], words[2:]
            name = t.join(words[0], words[-1] + 1).replace(" ", "") if words else ""
            meta = {"using": name, "static": static} | ({"alias": alias} if alias else {})
            self.edge("imports", None, name or None, "exact" if name else "unresolved", start, end, meta)
            return end + 1
        if tx[i] == "namespace":
            end = self.until(i + 1, b, ("{", ";"))
            name = t.join(i + 1, end).replace(" ", "")
            if end < b and tx[end] == "{":
                self.walk(end + 1, min(t.match[end], b), [*scope, name], owner, None)
                return t.match[end] + 1
            self.walk(end + 1, b, [*scope, name], owner, None)
            return b
        while i < b and tx[i] in MODIFIERS:
            i += 1
        if i < b and tx[i] in TYPES and not (tx[i] == "record" and i + 1 < b and t.kind[i + 1] != "word"):
            return self.type(start, i, b, scope)
        if i < b and tx[i] == "delegate":
            end = self.until(i, b, (";",))
            k = next((j for j in range(i, end) if tx[j] == "("), end)
            j = k - 1
            while j > i and tx[j] == ">" or j > i and t.kind[j] != "word":
                j = next((h for h in range(j, i, -1) if tx[h] == "<"), i + 1) - 1
            self.symbol("delegate", tx[j] if j > i else "<anonymous>", scope, start, end)
            return end + 1
        if inside == "enum":
            end = self.until(i, b, (",",))
            if i < b and t.kind[i] == "word":
                self.symbol("enum_member", tx[i], scope, start, end - 1)
                self.strings(i, end, owner)
            return end + 1
        if inside is None:
            return self.until(i, b, (";", "{")) + 1
        return self.body_member(start, i, b, scope, owner)

    def type(self, start: int, i: int, b: int, scope: list[str]) -> int:
        t, tx = self.t, self.t.text
        kind = TYPES[tx[i]]
        i += 1
        if i < b and tx[i] in ("struct", "class"):
            i += 1
        name = tx[i] if i < b and t.kind[i] == "word" else "<anonymous>"
        i += name != "<anonymous>"
        if i < b and tx[i] == "<":
            i = max(self.skip_angle(i), i)
        if i < b and tx[i] == "(":
            i = t.match[i] + 1
        end = self.until(i, b, ("{", ";"))
        close = min(t.match.get(end, end), b) if end < b and tx[end] == "{" else end
        q = self.symbol(kind, name, scope, start, close)
        where = next((j for j in range(i, end) if tx[j] == "where"), end)
        if i < where and tx[i] == ":":
            for n, (x, y) in enumerate(self.split(i + 1, where)):
                stop = next((j for j in range(x, y) if tx[j] == "("), y)
                base = t.join(x, stop)
                if base:
                    self.edge("implements" if n else "inherits", q, base, "heuristic", x, stop - 1, {"base_text": base, "base_index": n})
        if end < b and tx[end] == "{":
            self.walk(end + 1, close, [*scope, name], q, kind)
        return close + 1

    def body_member(self, start: int, i: int, b: int, scope: list[str], owner: str | None) -> int:
        """Constructors, methods, properties and fields of a type; anything else is passed over."""
        t, tx = self.t, self.t.text
        stop = self.until_member(i, b)
        if stop >= b:
            return b
        end = self.end_of(stop, b)
        if tx[stop] == "(":
            j = stop - 1
            if tx[j] == ">":
                depth = 0
                while j > i:
                    depth += (tx[j] == ">") - (tx[j] == "<")
                    j -= 1
                    if not depth:
                        break
            name = tx[j] if j >= i and t.kind[j] == "word" else ""
            if not name or "operator" in tx[i:stop] or j > i and tx[j - 1] == "~":
                return end + 1
            simple = name.lstrip("@")
            if j == i and scope and simple == scope[-1]:
                self.symbol("constructor", simple, scope, start, end)
                self.parameters(stop, owner)
                if self.body_from(t.match[stop] + 1, end):
                    self.body(self.body_from(t.match[stop] + 1, end), end, ".".join([*scope, simple]))
                return end + 1
            if j == i:
                return end + 1
            q = self.symbol("method", simple, scope, start, end)
            first = self.body_from(t.match[stop] + 1, end)
            if first:
                self.body(first, end, q)
            return end + 1
        if tx[stop] in ("{", "=>"):
            if t.kind[stop - 1] == "word" and tx[stop - 1] != "this" and stop - 1 > i and "this" not in tx[i:stop]:
                if "event" not in tx[start:i]:
                    owner = self.symbol("property", tx[stop - 1], scope, start, end)
            self.strings(stop, end + 1, owner)
            return end + 1
        if "event" in tx[start:i] or "this" in tx[i:stop]:
            return end + 1
        for x, y in self.split(i, end):
            eq = next((k for k in range(x, y) if tx[k] == "="), y)
            if eq > x and t.kind[eq - 1] == "word":
                self.symbol("field", tx[eq - 1], scope, eq - 1, y - 1)
        self.strings(i, end, owner)
        return end + 1

    def until_member(self, i: int, b: int) -> int:
        """The token that tells the kind of a member: ( { => = ; or , — past types, tuples, indexes and arrays."""
        tx, first = self.t.text, i
        while i < b:
            x = tx[i]
            if x == "<":
                i = max(self.skip_angle(i), i + 1)
            elif x == "[":
                i = self.t.match[i] + 1
            elif x == "(" and (i == first or self.t.kind[i - 1] != "word" and tx[i - 1] != ">"):
                i = self.t.match[i] + 1
            elif x in ("(", "{", "=>", "=", ";", ","):
                return i
            else:
                i += 1
        return b

    def end_of(self, i: int, b: int) -> int:
        """The last token of a member whose telling token is i."""
        tx = self.t.text
        if tx[i] == "{":
            end = min(self.t.match[i], b - 1)
            if end + 1 < b and tx[end + 1] == "=":
                return min(self.until(end, b, (";",)), b - 1)
            return end
        if tx[i] == "(":
            stop = self.until(i, b, ("{", ";", "=>"))
            if stop < b and tx[stop] == "{":
                return min(self.t.match[stop], b - 1)
            return min(self.until(stop, b, (";",)), b - 1)
        return min(self.until(i, b, (";",)), b - 1)

    def body_from(self, i: int, end: int) -> int | None:
        stop = self.until(i, end, ("{", "=>"))
        return stop if stop < end else None

    def parameters(self, i: int, owner: str | None) -> None:
        n = 0
        for a, b in self.split(i + 1, self.t.match[i]):
            while a < b and self.t.text[a] == "[":
                a = self.t.match[a] + 1
            while a < b and self.t.text[a] in ("ref", "out", "in", "params", "this", "scoped", "readonly"):
                a += 1
            eq = next((k for k in range(a, b) if self.t.text[k] == "="), b)
            if eq - a < 2:
                continue
            kind = self.t.join(a, eq - 1)
            self.edge("injects", owner, kind, "heuristic", a, eq - 1, {"parameter_name": self.t.text[eq - 1], "parameter_index": n})
            n += 1

    def literal(self, i: int, owner: str | None) -> None:
        text = self.t.text[i].strip('"')
        if self.literals and self.left > 0 and self.t.kind[i] == "str" and len(text) >= 4 and text[0].isupper() and all(c.isalnum() or c == "_" for c in text):
            self.left -= 1
            self.edge("string_ref", owner, text, "unresolved", i, i, {"literal_text": text})

    def strings(self, a: int, b: int, owner: str | None) -> None:
        for i in range(a, min(b, len(self.t.text))):
            self.literal(i, owner)

    def operand(self, p: int, a: int) -> int | None:
        """The first token of what stands before a member access and ends with token p: a name with its arguments and
        indexes, a group in brackets or a literal. None where no operand ends there."""
        t, tx = self.t, self.t.text
        while p > a:
            if tx[p] == "!":
                p -= 1
            elif tx[p] in (")", "]", "}") and t.kind[p] == "op":
                o = t.opening.get(p, -1)
                if o <= a:
                    return None
                before = tx[o - 1]
                if t.kind[o - 1] == "word" and before not in NO_CALL - {"this", "base"} or before in (")", "]", "!") or before == ">" and tx[p] != "}":
                    p = o - 1
                else:
                    return o if tx[p] == ")" else None
            elif tx[p] == ">":
                o = next((x for x in range(p - 1, a, -1) if tx[x] == "<" and self.skip_angle(x) == p + 1), a)
                if o == a or t.kind[o - 1] != "word":
                    return None
                p = o - 1
            elif t.kind[p] == "word":
                return p if tx[p] not in NO_CALL - {"this", "base"} else None
            else:
                return p if t.kind[p] not in ("op",) else None
        return None

    def body(self, a: int, b: int, owner: str) -> None:
        """Invocations of a body, last first: an identifier or member chain before a ( that is no keyword and no new."""
        t, tx = self.t, self.t.text
        for i in range(min(b, len(tx) - 1), a - 1, -1):
            self.literal(i, owner)
            if tx[i] != "(" or t.kind[i] != "op" or i == a:
                continue
            j = i - 1
            if tx[j] == ">":
                k = j
                depth = 0
                while k > a:
                    depth += (tx[k] == ">") - (tx[k] == "<")
                    if not depth:
                        break
                    k -= 1
                if self.skip_angle(k) != j + 1:
                    continue
                j = k - 1
            if t.kind[j] != "word" or tx[j] in NO_CALL:
                continue
            k = j
            while k - 1 > a and tx[k - 1] in (".", "::") and (p := self.operand(k - 2, a)) is not None:
                k = p
            prev = tx[k - 1] if k - 1 >= a else ""
            if prev == "new" and any(x in ("(", "{") for x in tx[k:j]):
                k -= 1  # a call on an object just made
            elif prev == "new" or t.kind[k - 1] == "word" and prev not in NO_CALL and prev not in ("yield", "await", "case", "from", "select", "where"):
                continue
            callee = t.join(k, i).replace(" ", "").replace("\n", "")
            if prev == "?.":
                callee = "." + callee
            simple = re.split(r"\.|::", callee)[-1]
            self.edge("calls", owner, callee or simple or None, "unresolved", k, min(t.match[i], b), {"callee_text": callee, "callee_simple": simple})


def extract(source: bytes | str, literals: bool = False) -> tuple[list[dict], list[dict], str | None]:
    """symbols, raw edges and the error, if any, of one source text."""
    text = source.decode("utf-8", "replace") if isinstance(source, (bytes, bytearray)) else source
    x = Extract(text.removeprefix("﻿"), literals)
    try:
        x.walk(0, len(x.t.text), [], None, None)
    except (IndexError, KeyError, RecursionError) as e:
        return [], [], f"parse: {type(e).__name__}: {e}"
    return x.symbols, x.edges, None


SYMBOL = "struct<kind:string,name:string,qualified_name:string,span_start_line:int,span_end_line:int,span_start_col:int,span_end_col:int>"
EDGE = "struct<edge_type:string,src_symbol_name:string,dst_qualified_guess:string,confidence:string,ref_start_line:int,ref_start_col:int,ref_end_line:int,ref_end_col:int,meta_json:string>"
HANDLERS = {".cs": extract}


def extract_files(files, literals: bool = False):
    """path, symbols, edges, error for files(path, content): the handler of the extension reads each text whole."""
    import pandas as pd

    def run(frames):
        for f in frames:
            rows = []
            for path, content in zip(f["path"], f["content"]):
                handler = HANDLERS.get("." + path.rsplit(".", 1)[-1].lower())
                s, e, error = handler(content if content is not None else "", literals) if handler else ([], [], "parse: no handler")
                rows.append((path, s, e, error))
            yield pd.DataFrame(rows, columns=["path", "symbols", "edges", "error"])

    return files.select("path", "content").mapInPandas(run, f"path string, symbols array<{SYMBOL}>, edges array<{EDGE}>, error string")
