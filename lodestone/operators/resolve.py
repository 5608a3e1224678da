"""Reference resolution: an edge's guess becomes a symbol id and a confidence.

The ladder looks for the guess as a qualified name, then for its last segment as a simple name. Candidates are ordered by
id and visible if their file is not after the edge's. Each step needs only the first candidates of a name, so names are
aggregated to dictionaries once and every edge costs three equi-joins, however many symbols share a hot name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import base_short, last_segment, looks_like_interface
from lodestone.schemas import TYPE_LIKE


def _firsts(symbols: DataFrame, key: str, classes: dict[str, Column], want: dict[str, tuple[str, int]]) -> DataFrame:
    """For each key the first or second symbol, by id, of each class. One window ranks all classes; its limit of two
    rows a key and class is taken before the shuffle, so a hot name moves two rows from each task."""
    of = F.explode(F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in classes.items()])))
    rows = symbols.select(key, F.struct("id", "file_id", "kind").alias("s"), of.alias("class"))
    rank = F.row_number().over(Window.partitionBy(key, "class").orderBy("s.id"))
    rows = rows.withColumn("r", rank).where("r <= 2")
    return rows.groupBy(key).agg(*[F.min(F.when((F.col("class") == c) & (F.col("r") == r), F.col("s"))).alias(n) for n, (c, r) in want.items()])


def _visible(s: str, ordered: bool) -> Column:
    return F.col(f"{s}.id").isNotNull() & (F.col(f"{s}.file_id") <= F.col("src_file_id") if ordered else F.lit(True))


def dictionaries(symbols: DataFrame, scope: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """By qualified name and by simple name: the first symbols, also of those in scope (files: file_id)."""
    s = symbols.select("id", "file_id", "kind", "name", "qualified_name")
    s = s.withColumn("within", F.lit(True)) if scope is None else s.join(scope.select("file_id").distinct().withColumn("within", F.lit(True)), "file_id", "left")
    inside = F.col("within").isNotNull()
    interface = F.col("kind") == "interface"
    by_q = _firsts(s, "qualified_name", {"q": F.lit(True), "s": inside}, {"q1": ("q", 1), "q2": ("q", 2), "qs": ("s", 1)})
    names = {"n": inside, "d": inside & F.expr("endswith(qualified_name, concat('.', name))"), "i": interface, "s": inside & interface, "t": F.col("kind").isin(*TYPE_LIKE)}
    want = {"n1": ("n", 1), "nd": ("d", 1), "i1": ("i", 1), "i2": ("i", 2), "is1": ("s", 1), "s2": ("s", 2), "t1": ("t", 1), "t2": ("t", 2)}
    return by_q, _firsts(s, "name", names, want)


def resolve(refs: DataFrame, symbols: DataFrame, scope: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """refs(src_file_id, name, dst_guess, ...) with dst_symbol_id, dst_kind and confidence.

    scope: files of the selected projects; None means no scope, so all files count.
    """
    by_q, by_n = dictionaries(symbols, scope)
    cand = F.coalesce("name", last_segment(F.col("dst_guess")))
    r = refs.withColumn("_cand", cand)
    out = r.join(by_q, r.dst_guess == by_q.qualified_name, "left").drop("qualified_name")
    out = out.join(by_n.withColumnRenamed("name", "_n"), F.col("_cand") == F.col("_n"), "left").drop("_n")
    exact = _visible("q1", ordered) & ~_visible("q2", ordered)
    many = _visible("q2", ordered) & _visible("qs", ordered) & F.lit(scope is not None)
    within = F.contains("_cand", "dst_guess")
    by_name = F.when(~within & _visible("nd", ordered), F.col("nd")).when(_visible("n1", ordered), F.col("n1"))
    hit = F.when(exact, F.col("q1")).when(many, F.col("qs")).otherwise(by_name)
    out = out.withColumn("_hit", hit).withColumn("_exact", exact)
    conf = F.when(F.col("_hit.id").isNull(), "unresolved").when(F.col("_exact"), "exact").otherwise("heuristic")
    out = out.withColumns({"dst_symbol_id": F.col("_hit.id"), "dst_kind": F.col("_hit.kind"), "confidence": conf})
    return out


_WORK = ["_cand", "_hit", "_exact", "q1", "q2", "qs", "n1", "nd", "i1", "is1", "t1", "i2", "s2", "t2"]


def resolve_general(refs: DataFrame, symbols: DataFrame, **how) -> DataFrame:
    return resolve(refs, symbols, **how).drop(*_WORK)


def resolve_inheritance(refs: DataFrame, symbols: DataFrame, scope: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Base lists: the ladder on the short name, then the only interface of that name, anywhere or else in scope."""
    return _inherited(resolve(refs.withColumn("name", base_short(F.col("dst_guess"))), symbols, scope, ordered), ordered).drop(*_WORK)


def _inherited(out: DataFrame, ordered: bool) -> DataFrame:
    """The results of the ladder, or the only interface of the name."""
    one = F.when(_visible("i1", ordered) & ~_visible("i2", ordered), F.col("i1")).when(_visible("is1", ordered) & ~_visible("s2", ordered), F.col("is1"))
    found = F.coalesce(F.col("_hit"), one)
    conf = F.when(F.col("_hit.id").isNotNull(), F.col("confidence")).when(found["id"].isNotNull(), "heuristic").otherwise("unresolved")
    out = out.withColumns({"dst_symbol_id": found["id"], "dst_kind": found["kind"], "confidence": conf})
    return out.withColumn("edge_type", final_edge_type())


def final_edge_type() -> Column:
    """An interface is implemented, a class keeps the parser's type, an unresolved I-name counts as an interface."""
    known = F.col("dst_symbol_id").isNotNull()
    return F.when(known & (F.col("dst_kind") == "interface"), "implements").when(~known & looks_like_interface(F.col("name")), "implements").otherwise(F.col("edge_type"))


def repair_inheritance(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """A second look at unresolved inheritance edges, with every symbol visible and every file in scope."""
    lost = edges.where("dst_symbol_id is null").drop("dst_symbol_id", "dst_kind", "confidence")
    again = resolve_inheritance(lost, symbols, symbols.select("file_id").distinct(), ordered=False)
    return edges.where("dst_symbol_id is not null").unionByName(again)


def resolve_string_refs(refs: DataFrame, symbols: DataFrame, ordered: bool = True) -> DataFrame:
    """Literals that name exactly one visible type; the others are dropped."""
    return _literal(resolve(refs.withColumn("name", F.col("dst_guess")), symbols, None, ordered), ordered).drop(*_WORK)


def _literal(out: DataFrame, ordered: bool) -> DataFrame:
    """The results of the ladder replaced by the only visible type of the name."""
    out = out.where(_visible("t1", ordered) & ~_visible("t2", ordered))
    return out.withColumns({"dst_symbol_id": F.col("t1.id"), "dst_kind": F.col("t1.kind"), "confidence": F.lit("heuristic")})


def source_symbols(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """src_symbol_id: the last symbol in the edge's own file with the source's qualified name (overloads, partials)."""
    last = symbols.groupBy("file_id", "qualified_name").agg(F.max("id").alias("src_symbol_id"))
    last = last.withColumnsRenamed({"file_id": "src_file_id", "qualified_name": "src_qualified"})
    return refs.join(last, ["src_file_id", "src_qualified"], "left")


def resolve_all(refs: DataFrame, symbols: DataFrame, scope: DataFrame | None = None, ordered: bool = True) -> DataFrame:
    """Every edge type by its own rule, over one pass of the ladder; imports are never resolved."""
    kind = F.col("edge_type")
    base, literal = kind.isin("inherits", "implements"), kind == "string_ref"
    none = refs.where(kind == "imports").withColumns({"dst_symbol_id": F.lit(None).cast("long"), "dst_kind": F.lit(None).cast("string"), "confidence": F.lit("unresolved")})
    name = F.when(base, base_short(F.col("dst_guess"))).when(literal, F.col("dst_guess")).otherwise(F.col("name"))
    out = resolve(refs.where(kind != "imports").withColumn("name", name), symbols, scope, ordered)
    # one plan to here: the three rules differ in projections and filters, and their common joins are exchanged once
    parts = [_inherited(out.where(base), ordered), _literal(out.where(literal), ordered), out.where(~base & ~literal)]
    rows = none
    for p in parts:
        rows = rows.unionByName(p.drop(*_WORK))
    return rows


def merge_inheritance_meta(edges: DataFrame) -> DataFrame:
    """edges whose meta_json says, for inheritance, the base's short name and what became of it.

    base_short, base_resolved and, of a resolved base, dst_kind; of others base_kind_hint. A hint that an earlier pass
    left stays."""
    meta = F.from_json(F.coalesce("meta_json", F.lit("{}")), "map<string,string>")
    base = F.col("edge_type").isin("inherits", "implements")
    known = F.col("dst_symbol_id").isNotNull()
    short = F.to_json(F.struct(base_short(F.col("dst_guess")).alias("base_short"), known.alias("base_resolved"), F.when(known, F.col("dst_kind")).alias("dst_kind"),
        F.when(~known, F.when(looks_like_interface(base_short(F.col("dst_guess"))), "interface").otherwise("unknown")).alias("base_kind_hint")))
    old = F.regexp_replace(F.coalesce("meta_json", F.lit("{}")), r"\}\s*$", "")
    merged = F.concat(old, F.when(F.size(meta) > 0, ",").otherwise(""), F.substring(short, 2, 1 << 30))
    return edges.withColumn("meta_json", F.when(base, merged).otherwise(F.col("meta_json")))
