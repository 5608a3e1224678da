"""Command line: index a tree, query an index, keep notes, scan and export, serve read-only SQL."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from lodestone import index, server
from lodestone.export import notes
from lodestone.operators import read, sqlapi
from lodestone.sources import tree

#: Rows that each query command prints unless --limit says otherwise.
LIMITS = {"find-symbol": 100, "find-references": 200, "callers-of": 200, "implementations-of": 200, "features": 500, "path-search": 200, "grep-text": 100}


def _index_options(p: argparse.ArgumentParser) -> None:
    p.add_argument("root")
    p.add_argument("--out", default=None)
    p.add_argument("--sln", action="append", default=[])
    p.add_argument("--csproj", action="append", default=[])
    for flag in ("all-solutions", "no-sln", "store-content", "force", "prune-missing", "index-string-literals", "index-mvvm-edges"):
        p.add_argument(f"--{flag}", action="store_true")


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodestone")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("index")
    _index_options(a)
    a.add_argument("--ignore", action="append", default=[])
    s = sub.add_parser("scan-export")
    _index_options(s)
    s.add_argument("--out-dir", default=None)
    kinds = sub.add_parser("query").add_subparsers(dest="kind", required=True)
    options = {
        "find-symbol": ("name", "kind", "file-glob"), "find-references": ("symbol-id", "qualified"), "callers-of": ("symbol-id",), "implementations-of": ("symbol-id",),
        "features": ("name",), "path-search": ("text",), "grep-text": ("text",), "stats": (), "sql": ("text",), "vault": ("out-dir",),
    }
    for kind, names in options.items():
        q = kinds.add_parser(kind)
        q.add_argument("--index", required=True)
        for n in names:
            if n == "text":
                q.add_argument(n)
            elif n == "kind":
                q.add_argument("--kind", dest="kind_of")
            else:
                q.add_argument(f"--{n}", type=int if n == "symbol-id" else str, required=kind in ("callers-of", "implementations-of"))
        if kind in LIMITS:
            q.add_argument("--limit", type=int, default=LIMITS[kind])
        if kind == "grep-text":
            q.add_argument("--regex", action="store_true")
    actions = sub.add_parser("notes").add_subparsers(dest="action", required=True)
    for action in ("get-or-create", "append", "sync"):
        n = actions.add_parser(action)
        n.add_argument("symbol")
        n.add_argument("--notes-dir", default=".lodestone/notes")
        n.add_argument("--index", default=None)
        if action == "append":
            n.add_argument("--text")
            n.add_argument("--from-stdin", action="store_true")
    v = sub.add_parser("serve")
    v.add_argument("--index", required=True)
    v.add_argument("--notes-dir", default=".lodestone/notes")
    return p


def choose_projects(spark: SparkSession, o) -> dict:
    """The solutions or projects of a run. Without a choice: the only solution below root, or else all projects below it;
    several solutions are an error, as there is nobody to ask."""
    if o.no_sln and (o.sln or o.all_solutions) or o.all_solutions and (o.sln or o.csproj) or o.sln and o.csproj:
        raise ValueError("--all-solutions, --sln, --csproj and --no-sln exclude one another")
    if o.all_solutions or o.sln or o.csproj:
        return {"sln": o.sln, "csproj": o.csproj, "all_solutions": o.all_solutions}
    names = lambda pattern: [r.path for r in tree.discover(spark, o.root, pattern).select("path").collect()]
    found = [] if o.no_sln else names("*.sln")
    if len(found) > 1:
        raise ValueError("several solutions, choose with --sln or --all-solutions: " + ", ".join(found))
    return {"sln": found} if found else {"csproj": names("*.csproj")}


def _build(spark: SparkSession, o, out: str) -> dict:
    flags = {"store_content": o.store_content, "literals": o.index_string_literals, "mvvm": o.index_mvvm_edges, "force": o.force, "prune_missing": o.prune_missing}
    return index.build(spark, o.root, out, extra_ignore=tuple(getattr(o, "ignore", ())), **flags, **choose_projects(spark, o))


def run_query(spark: SparkSession, o, t: dict) -> str:
    if o.kind == "vault":
        return str(notes.export(t, o.out_dir or "vault"))
    made = {
        "find-symbol": lambda: read.find_symbol(t["symbols"], t["files"], name=o.name, kind=o.kind_of, file_glob=o.file_glob, limit=o.limit),
        "find-references": lambda: read.find_references(t["edges"], t["files"], t["symbols"], symbol_id=o.symbol_id, qualified=o.qualified, limit=o.limit),
        "callers-of": lambda: read.callers_of(t["edges"], t["files"], t["symbols"], o.symbol_id, o.limit),
        "implementations-of": lambda: read.implementations_of(t["edges"], t["files"], t["symbols"], o.symbol_id, o.limit),
        "features": lambda: read.features_by_name(t["features"], o.name, o.limit),
        "path-search": lambda: read.path_search(t["files"], o.text, o.limit),
        "stats": lambda: read.stats(**{k: t[k] for k in ("symbols", "edges", "files", "projects", "features")}),
        "grep-text": lambda: read.grep_text(t["files"], o.text, regex=o.regex, limit=o.limit),
        "sql": lambda: sqlapi.read_query(spark, o.text),
    }[o.kind]()
    return sqlapi.as_text(made)


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    o = _parser().parse_args(argv)
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if o.command in ("index", "scan-export"):
            out = o.out or f"{o.root.rstrip('/')}/.lodestone/index"
            print(_build(spark, o, out))
            if o.command == "scan-export":
                t = index.load(spark, out)
                print(notes.export(t, o.out_dir or f"{o.root.rstrip('/')}/.lodestone/vault"))
        elif o.command == "notes":
            t = index.load(spark, o.index) if o.index else None
            text = sys.stdin.read() if o.action == "append" and o.from_stdin else getattr(o, "text", None)
            print(server.note(o.action, o.notes_dir, o.symbol, t, text))
        else:
            t = index.load(spark, o.index)
            if o.command == "serve":
                server.serve(spark, t, o.notes_dir, sys.stdin, sys.stdout)
            else:
                print(run_query(spark, o, t))
    except (FileNotFoundError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
