"""The read queries: lazy DataFrames over the index tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import glob_like, like_ascii_ci, match, snippet


def find_symbol(symbols, files, name=None, kind=None, file_glob=None, limit=100) -> DataFrame:
    f = files.select(F.col("id").alias("file_id"), "path")
    if file_glob:
        f = f.where(like_ascii_ci(F.col("path"), glob_like(file_glob)))
    s = symbols
    if name:
        s = s.where((F.col("name") == name) | like_ascii_ci(F.col("qualified_name"), f"%{name}%"))
    if kind:
        s = s.where(F.col("kind") == kind)
    return s.join(f, "file_id").select("id", "kind", "name", "qualified_name", "path", "span_start_line", "span_end_line").orderBy("path", "span_start_line", "id").limit(limit)


def find_references(edges, files, symbols=None, symbol_id=None, qualified=None, limit=200) -> DataFrame:
    """`qualified` is a qualified or simple name and must hit exactly one symbol, else the result is empty."""
    f = files.select(F.col("id").alias("src_file_id"), "path")
    if symbol_id is None:
        hits = symbols.where((F.col("qualified_name") == qualified) | (F.col("name") == qualified))
        one = hits.agg(F.count("*").alias("n"), F.min("id").alias("dst_symbol_id")).where("n = 1").select("dst_symbol_id")
        e = edges.join(F.broadcast(one), "dst_symbol_id")  # one row at most
    else:
        e = edges.where(F.col("dst_symbol_id") == symbol_id)
    return e.join(f, "src_file_id").select("id", "edge_type", "confidence", "src_file_id", "path", "ref_start_line", "dst_symbol_id").orderBy("path", "ref_start_line", "id").limit(limit)


def callers_of(edges, files, symbols, symbol_id, limit=200) -> DataFrame:
    f = files.select(F.col("id").alias("src_file_id"), "path")
    s = symbols.select(F.col("id").alias("src_symbol_id"), F.col("qualified_name").alias("src_q"))
    e = edges.where((F.col("edge_type") == "calls") & (F.col("dst_symbol_id") == symbol_id))
    return e.join(f, "src_file_id").join(s, "src_symbol_id", "left").select("id", "confidence", "path", "ref_start_line", "src_symbol_id", "src_q").orderBy("path", "ref_start_line", "id").limit(limit)


def implementations_of(edges, files, symbols, symbol_id, limit=200) -> DataFrame:
    d = symbols.where((F.col("kind") == "interface") & (F.col("id") == symbol_id)).select(F.col("id").alias("dst_symbol_id"))
    s = symbols.select(F.col("id").alias("src_symbol_id"), "kind", "name", "qualified_name", "span_start_line", F.col("file_id").alias("f"))
    e = edges.where(F.col("edge_type").isin("implements", "inherits")).select(F.col("id").alias("edge_id"), "src_symbol_id", "dst_symbol_id")
    out = e.join(d, "dst_symbol_id").join(s, "src_symbol_id").join(files.select(F.col("id").alias("f"), "path"), "f")
    return out.orderBy("edge_id", "src_symbol_id").limit(limit).select(F.col("src_symbol_id").alias("id"), "kind", "name", "qualified_name", "path", "span_start_line")


def lookup_file(files, path) -> DataFrame:
    """The row of one path, if there is one."""
    return files.where(F.col("path") == path).limit(1)


def lookup_symbol(symbols, files, name) -> DataFrame:
    """One symbol with this qualified or simple name: a qualified name goes first, then the order of qualified names."""
    f = files.select(F.col("id").alias("file_id"), "path")
    hits = symbols.where((F.col("qualified_name") == name) | (F.col("name") == name)).join(f, "file_id")
    exact = F.when(F.col("qualified_name") == name, 0).otherwise(1)
    return hits.orderBy(exact, "qualified_name", "id").limit(1).select("id", "kind", "name", "qualified_name", "path")


def features_by_name(feats, name=None, limit=500) -> DataFrame:
    f = feats.where(like_ascii_ci(F.col("name"), f"%{name}%")) if name else feats
    return f.orderBy(F.coalesce("domain", F.lit("")), "name", "viewmodel").limit(limit)


def path_search(files, text, limit=200) -> DataFrame:
    return files.where(like_ascii_ci(F.col("path"), f"%{text}%")).select("id", "path").orderBy("path").limit(limit)


def stats(**tables: DataFrame) -> DataFrame:
    """One row for each table: its name and number of rows, in one job."""
    out = None
    for name, t in tables.items():
        one = t.agg(F.lit(name).alias("name"), F.count("*").cast("long").alias("n")) if t is not None else None
        out = one if out is None else out if one is None else out.union(one)
    return out


def symbols_in_file(symbols, files, path) -> DataFrame:
    f = files.where(F.col("path") == path).select(F.col("id").alias("file_id"))
    return symbols.join(f, "file_id").select("id", "kind", "qualified_name", "span_start_line", "span_end_line").orderBy("span_start_line", "id")


def incoming_calls(edges, files, symbol_id) -> DataFrame:
    f = files.select(F.col("id").alias("src_file_id"), "path")
    return edges.where((F.col("dst_symbol_id") == symbol_id) & (F.col("edge_type") == "calls")).join(f, "src_file_id").select("path", "ref_start_line", "confidence", "edge_type")


def project_dependencies(project_edges, projects) -> DataFrame:
    p = projects.select(F.col("id").alias("src_project_id"), F.col("name").alias("src"))
    d = projects.select(F.col("id").alias("dst_project_id"), F.col("name").alias("dst"))
    return project_edges.join(p, "src_project_id").join(d, "dst_project_id", "left").select("src", "dst", "edge_kind", "target")


def grep_substring(files, text, limit=100) -> DataFrame:
    hit = files.where(like_ascii_ci(F.col("content"), f"%{text}%"))
    return hit.select("path", F.substring("content", 1, 200).alias("snippet")).orderBy("path").limit(limit)


def grep_regex(files, pattern, limit=100, python=False) -> DataFrame:
    """First line of the text, cut to 200 characters, of files whose content matches. python: Python's dialect."""
    if python:
        import re

        import pandas as pd

        def found(s):
            r = re.compile(pattern)
            return s.map(lambda x: x is not None and r.search(x) is not None)

        found.__annotations__ = {"s": pd.Series, "return": pd.Series}
        hit = files.where(F.pandas_udf(found, "boolean")("content"))
    else:
        hit = files.where(F.col("content").rlike(pattern))
    return hit.select("path", F.substring(F.substring_index("content", "\n", 1), 1, 200).alias("snippet")).orderBy("path").limit(limit)


def grep_text(files, text, regex=False, limit=100) -> DataFrame:
    """Substring search; where it finds nothing, a full-text search by the same words (a bad expression finds none)."""
    if regex:
        return grep_regex(files, text, limit, python=True)
    plain = grep_substring(files, text, limit)
    try:
        words = fts_content(files, text, limit)
    except ValueError:
        return plain
    return plain.unionByName(words.join(plain.limit(1).select(F.lit(1).alias("_any")), F.lit(True), "left_anti")).limit(limit)


def fts_symbols(symbols, files, expression, limit=50) -> DataFrame:
    s = symbols.where(match(expression, F.col("name"), F.col("qualified_name")))
    return s.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("id", "kind", "qualified_name", "path").orderBy("id").limit(limit)


def fts_paths(files, expression, limit=50) -> DataFrame:
    return files.where(match(expression, F.col("path"))).select("id", "path").orderBy("id").limit(limit)


def fts_content(files, expression, limit=100) -> DataFrame:
    word = expression.replace('"', "").replace("*", "").split()
    hit = files.where(match(expression, F.col("path"), F.col("content")))
    return hit.select("path", snippet(F.col("content"), word[0] if word else "").alias("snippet")).orderBy("path").limit(limit)
