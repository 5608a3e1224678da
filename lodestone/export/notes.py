"""Markdown for symbols: one note for each type, worked out for all types at once by joins."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.schemas import TYPE_LIKE

SECTIONS = {"inherits": "Inherits", "implements": "Implements", "injects": "Dependencies (Injects)", "methods": "Methods", "properties": "Properties", "calls": "Calls"}


def prefixes(q):
    """All proper dotted prefixes of a qualified name."""
    parts = F.split(q, r"\.")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "."))).otherwise(F.array().cast("array<string>"))


def structure(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """owner (a type's qualified name), section, link: distinct links of every type. Members are found by their
    dotted prefixes, an equi-join, at any depth."""
    types = symbols.where(F.col("kind").isin(*TYPE_LIKE)).select(F.col("qualified_name").alias("owner")).distinct()
    inside = symbols.select(F.col("id").alias("member"), "kind", "qualified_name", F.explode(prefixes(F.col("qualified_name"))).alias("owner")).join(types, "owner", "left_semi")
    methods = inside.where("kind in ('method', 'constructor')").select("owner", F.lit("methods").alias("section"), F.col("qualified_name").alias("link"))
    held = inside.where("kind in ('property', 'field')").select("owner", F.lit("properties").alias("section"), F.col("qualified_name").alias("link"))
    dst = symbols.select(F.col("id").alias("dst_symbol_id"), F.col("qualified_name").alias("link"))
    e = edges.where("dst_symbol_id is not null").select("src_symbol_id", "dst_symbol_id", "edge_type").join(dst, "dst_symbol_id")
    calls = e.where("edge_type = 'calls'").join(inside.select(F.col("member").alias("src_symbol_id"), "owner"), "src_symbol_id")
    calls = calls.select("owner", F.lit("calls").alias("section"), "link")
    own = symbols.where(F.col("kind").isin(*TYPE_LIKE)).select(F.col("id").alias("src_symbol_id"), F.col("qualified_name").alias("owner"))
    direct = e.where("edge_type in ('inherits', 'implements', 'injects')").join(own, "src_symbol_id").select("owner", F.col("edge_type").alias("section"), "link")
    return methods.union(held).union(calls).union(direct).distinct()


def notes(symbols: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """path and body of the note of every type-like symbol; links in order of qualified names, '- (none)' where a section is empty."""
    link = lambda name: F.concat(F.lit("- [["), F.replace(name, F.lit("."), F.lit("/")), F.lit("]]"))
    parts = structure(symbols, edges).groupBy("owner", "section").agg(F.array_join(F.transform(F.array_sort(F.collect_set("link")), link), "\n").alias("text"))
    wide = parts.groupBy("owner").pivot("section", list(SECTIONS)).agg(F.first("text"))
    s = symbols.where(F.col("kind").isin(*TYPE_LIKE)).join(files.select(F.col("id").alias("file_id"), F.col("path").alias("file_path")), "file_id")
    s = s.join(wide, s.qualified_name == wide.owner, "left")
    head = F.concat(F.lit("---\nid: "), "id", F.lit("\nkind: "), "kind", F.lit("\nqualified_name: "), "qualified_name", F.lit("\nfile_path: "), "file_path", F.lit("\n---\n\n# "), "name", F.lit("\n"))
    body = [F.concat(F.lit(f"\n## {t}\n"), F.coalesce(F.col(c), F.lit("- (none)")), F.lit("\n")) for c, t in SECTIONS.items()]
    return s.select(F.concat(F.replace("qualified_name", F.lit("."), F.lit("/")), F.lit(".md")).alias("path"), F.concat(head, *body).alias("body"))


def feature_notes(features: DataFrame) -> DataFrame:
    """path and body of the note of every feature, in the order of domains and names; features of one name share a
    path, and the last one written stays."""
    link = lambda c: F.concat(F.lit("[["), F.replace(F.col(c), F.lit("."), F.lit("/")), F.lit("]]"))
    domain = F.coalesce("domain", F.lit(""))
    head = F.concat(F.lit("# Feature: "), "name", F.lit("\n\n**Domain:** "), domain, F.lit("\n**ViewModel:** "), link("viewmodel"), F.lit("\n"))
    service = F.when(F.col("service") != "", F.concat(F.lit("\n**Service:** "), link("service"), F.lit("\n"))).otherwise("")
    rows = features.orderBy(domain, "name", "viewmodel")
    return rows.select(F.concat(F.lit("Features/"), "name", F.lit(".md")).alias("path"), F.concat(head, service).alias("body"))


def export(tables: dict[str, DataFrame], out: str) -> int:
    """Write the notes of all types and features of an index below out; returns their number."""
    written = write_notes(notes(tables["symbols"], tables["edges"], tables["files"]), out)
    return written + write_notes(feature_notes(tables["features"]), out)


def write_notes(rows: DataFrame, out: str) -> int:
    """Write one file for each row below out; returns the number written. Rows come to the driver one by one."""
    n = 0
    for r in rows.toLocalIterator():
        p = Path(out) / r.path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(r.body, encoding="utf-8")
        n += 1
    return n


HEADING = "## Notes"


def get_or_create(path: str, body: str) -> str:
    p = Path(path)
    if not p.exists():
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(f"{body.rstrip()}\n\n{HEADING}\n", encoding="utf-8")
    return p.read_text(encoding="utf-8")


def append(path: str, text: str) -> None:
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(path)
    have = p.read_text(encoding="utf-8")
    if HEADING not in have:
        raise ValueError(f"{path} has no '{HEADING}' section")
    tail = have.split(HEADING, 1)[1].strip()
    p.write_text(have.rstrip() + ("\n\n" if tail else "\n") + text.rstrip() + "\n", encoding="utf-8")


def sync(path: str, body: str) -> None:
    """Renew what stands above the notes heading, keep the rest."""
    have = Path(path).read_text(encoding="utf-8")
    Path(path).write_text(f"{body.rstrip()}\n\n" + have[have.index(HEADING) :], encoding="utf-8")
