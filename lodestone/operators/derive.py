"""Relations derived from symbols and edges: features, view and service links, files of projects, folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import like_ascii_ci, namespace_of

SERVICE_SUFFIXES = ("Service", "ServiceAgent", "Manager")
RANKED_SUFFIXES = ("Service", "ServiceAgent", "Manager", "Client")
VIEW_SUFFIXES = ("View", "Page", "Window")


def view_models(symbols: DataFrame) -> DataFrame:
    """Types whose name ends in ViewModel (ASCII case ignored); the suffix is cut only where its case is right."""
    name = F.col("name")
    stem = F.when(name.endswith("ViewModel"), F.expr("substring(name, 1, length(name) - 9)")).otherwise(name)
    return symbols.where((F.col("kind") == "type") & like_ascii_ci(name, "%ViewModel")).withColumn("stem", stem)


def _lookup(keys: DataFrame, symbols: DataFrame, suffixes: tuple[str, ...], kinds: tuple[str, ...]) -> DataFrame:
    """keys(key, base) with the first symbol named base + suffix: suffixes in order, then the smallest id."""
    tries = keys.select("key", F.posexplode(F.array(*[F.concat("base", F.lit(s)) for s in suffixes])).alias("rank", "qualified_name"))
    found = tries.join(symbols.where(F.col("kind").isin(*kinds)), "qualified_name")
    first = F.min_by(F.struct("id", "qualified_name", "file_id"), F.struct("rank", "id"))
    return found.groupBy("key").agg(first.alias("hit")).select("key", "hit.*")


def _base() -> Column:
    return F.concat(namespace_of(F.col("qualified_name")), F.lit("."), "stem")


def projects_of_files(project_files: DataFrame, projects: DataFrame) -> DataFrame:
    """One project for each file: the smallest name, then id."""
    p = project_files.join(projects, project_files.project_id == projects.id)
    return p.groupBy("file_id").agg(F.min(F.struct("name", "id", "domain")).alias("p")).select("file_id", F.col("p.name").alias("project"), F.col("p.domain").alias("project_domain"))


def features(symbols: DataFrame, project_files: DataFrame, projects: DataFrame) -> DataFrame:
    """name, domain, viewmodel, service, project: one feature for each view model's qualified name."""
    vm = view_models(symbols)
    vm = vm.groupBy("qualified_name").agg(F.min(F.struct("id", "stem", "file_id")).alias("v")).select("qualified_name", "v.*").where("stem <> ''")
    vm = vm.join(projects_of_files(project_files, projects), "file_id", "left")
    service = _lookup(vm.select(F.col("id").alias("key"), _base().alias("base")), symbols, SERVICE_SUFFIXES, ("type", "interface"))
    vm = vm.join(service.select(F.col("key").alias("id"), F.col("qualified_name").alias("service")), "id", "left")
    first = F.when(F.instr("qualified_name", ".") > 0, F.substring_index("qualified_name", ".", 1))
    domain = F.when(F.trim(F.coalesce("project_domain", F.lit(""))) != "", F.col("project_domain")).otherwise(first)
    return vm.select(F.col("stem").alias("name"), domain.alias("domain"), F.col("qualified_name").alias("viewmodel"), "service", "project")


def view_edges(symbols: DataFrame) -> DataFrame:
    """mvvm_view edges, from the view to the view model of the same stem."""
    vm = view_models(symbols)
    hit = _lookup(vm.select(F.col("id").alias("key"), _base().alias("base")), symbols, VIEW_SUFFIXES, ("type",))
    return hit.select(F.col("id").alias("src_symbol_id"), F.col("key").alias("dst_symbol_id"), F.col("file_id").alias("src_file_id"), F.lit("mvvm_view").alias("edge_type"), F.lit("heuristic").alias("confidence"))


def primary_services(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """mvvm_primary_service: of a view model's resolved injections the best by suffix rank, parameter, name, id."""
    vm = view_models(symbols).select(F.col("id").alias("src_symbol_id"), F.col("file_id").alias("src_file"))
    inj = edges.where("edge_type = 'injects' and dst_symbol_id is not null").select("src_symbol_id", "dst_symbol_id", "parameter_index")
    dst = symbols.select(F.col("id").alias("dst_symbol_id"), F.col("name").alias("dst_name"), F.col("qualified_name").alias("dst_qualified"))
    rank = F.lit(99)
    for i, s in reversed(list(enumerate(RANKED_SUFFIXES))):
        rank = F.when(F.col("dst_name").endswith(s), i).otherwise(rank)
    found = inj.join(vm, "src_symbol_id").join(dst, "dst_symbol_id")
    order = F.struct(rank.alias("r"), "parameter_index", "dst_name", "dst_symbol_id")
    best = found.groupBy("src_symbol_id").agg(F.min_by(F.struct("dst_symbol_id", "dst_qualified", "parameter_index"), order).alias("b"))
    return best.select("src_symbol_id", "b.*", F.lit("mvvm_primary_service").alias("edge_type"))


def override_services(feats: DataFrame, primary: DataFrame, symbols: DataFrame) -> DataFrame:
    """The primary service replaces a feature's inferred one; of a partial view model's parts the last id decides."""
    p = primary.join(symbols.select(F.col("id").alias("src_symbol_id"), F.col("qualified_name").alias("viewmodel")), "src_symbol_id")
    p = p.groupBy("viewmodel").agg(F.max_by("dst_qualified", "src_symbol_id").alias("primary"))
    return feats.join(p, "viewmodel", "left").select("name", "domain", "viewmodel", F.coalesce("primary", "service").alias("service"), "project")


def ancestors(path: Column) -> Column:
    """All ancestor directories of an absolute path, nearest the root first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(2), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def files_to_projects(files: DataFrame, projects: DataFrame) -> DataFrame:
    """file_id, project_id: the project whose directory is the file's deepest ancestor; ties go to the first listed."""
    dirs = projects.select(F.col("id").alias("project_id"), F.regexp_replace("path", "/[^/]*$", "").alias("dir"))
    up = files.where(F.size(F.split("path", "/")) > 2).select(F.col("id").alias("file_id"), F.explode(ancestors(F.col("path"))).alias("dir"))
    hit = up.join(dirs, "dir")
    return hit.groupBy("file_id").agg(F.max_by("project_id", F.struct(F.length("dir"), -F.col("project_id"))).alias("project_id"))


def folders(files: DataFrame) -> DataFrame:
    """path and parent of every ancestor folder."""
    d = files.where(F.size(F.split("path", "/")) > 2).select(F.explode(ancestors(F.col("path"))).alias("path")).distinct()
    parent = F.regexp_replace("path", "/[^/]*$", "")
    return d.select("path", F.when(parent != "", parent).alias("parent"))


def with_ids(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Ids by position: the group's offset plus the row's place in it. Only one count a group passes a single task."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(group, F.coalesce(before, F.lit(0)).alias("_o"))
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("_p", place).join(offsets, group).withColumn("id", (F.col("_o") + F.col("_p")).cast("long")).drop("_p", "_o")
