"""Build an index: scan, extract, resolve, derive, write Parquet tables; read it back.

A run over an index that exists extracts only the files that are new or changed and takes the other files' symbols and
references from the last run. They stand in two generations of tables, so that a run never overwrites what it reads;
`meta`, written last, names the valid one. Resolution and all that follows cover the whole index, so no edge keeps a
target that is gone.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone import schemas
from lodestone.extract.csharp import extract_files
from lodestone.operators import derive, incremental, resolve
from lodestone.sources import ignore, tree


def _raw_edges(parsed: DataFrame, files: DataFrame) -> DataFrame:
    e = parsed.select("path", F.explode("edges").alias("e")).select("path", "e.*").join(files.select("path", F.col("id").alias("src_file_id")), "path")
    meta = lambda k: F.get_json_object("meta_json", f"$.{k}")
    return e.select(
        "src_file_id", "edge_type", F.col("src_symbol_name").alias("src_qualified"), F.col("dst_qualified_guess").alias("dst_guess"),
        F.when(F.col("edge_type") == "calls", meta("callee_simple")).alias("name"), F.coalesce(meta("parameter_index").cast("int"), F.lit(0)).alias("parameter_index"),
        F.col("confidence").alias("parsed_confidence"), "ref_start_line", "ref_start_col", "ref_end_line", "ref_end_col", "meta_json",
    )


def _stored_meta(spark: SparkSession, out: str) -> dict:
    """The metadata of the last finished run; empty where there is none."""
    try:
        return {r.key: json.loads(r.value) for r in spark.read.schema(schemas.META).parquet(f"{out}/meta").collect()}
    except AnalysisException:
        return {}


def _extract(scan: DataFrame, stored: DataFrame | None, force: bool, literals: bool) -> DataFrame:
    """path, fingerprint, symbols, edges and error of all files: stored rows, replaced where a file is new or changed.

    A file that fails keeps its earlier symbols and edges, and no fingerprint, so that the next run tries it again."""
    marks = list(incremental.FINGERPRINT)
    dirty = scan if stored is None else incremental.dirty_files(scan, stored, force)
    new = extract_files(dirty, literals).join(dirty.select("path", *marks), "path")
    if stored is None:
        earlier = new.select("path", F.lit(None).alias("_s"), F.lit(None).alias("_e")).limit(0)
    else:
        earlier = stored.select("path", F.col("symbols").alias("_s"), F.col("edges").alias("_e"))
    failed = F.col("error").isNotNull()
    pick = lambda old, c: F.when(failed, F.col(old)).otherwise(F.col(c)).alias(c)
    new = new.join(earlier, "path", "left").select("path", *[F.when(~failed, F.col(c)).alias(c) for c in marks], pick("_s", "symbols"), pick("_e", "edges"), "error")
    return new if stored is None else incremental.replace_files(stored, new, "path")


def find_projects(spark: SparkSession, root: str, sln: list[str] = (), csproj: list[str] = (), all_solutions: bool = False) -> tuple[DataFrame, list[str]]:
    """path, name, project_references, package_references, domain of the chosen projects, and messages about missing files.

    all_solutions takes every solution below root, sln the named ones in that order, csproj the named projects; of a
    project that several solutions list the first place counts."""
    errors = [f"missing file: {p}" for p in [*sln, *csproj] if tree.read_text(spark, p) is None]
    if all_solutions or sln:
        texts = tree.discover(spark, root, "*.sln") if all_solutions else tree.load_texts(spark, list(sln))
        listed = tree.parse_sln(texts)
        there = [r.path for r in listed.select("path").distinct().collect()]  # as many as the solutions list
        found = tree.load_texts(spark, there)
        chosen, missing = tree.collect_projects(listed, found)
        errors += sorted(r.error for r in missing.collect())
        return tree.parse_csproj(found.join(chosen.select("path"), "path", "left_semi")), errors
    return tree.parse_csproj(tree.load_texts(spark, list(csproj))), errors


#: Functions of (symbols, files) that give further view edges (src_symbol_id, dst_symbol_id, edge_type); none by default.
UI_ADAPTERS: list = []


def build(spark: SparkSession, root: str, out: str, *, sln: list[str] = (), csproj: list[str] = (), all_solutions: bool = False, extra_ignore: tuple[str, ...] = (), gitignore: str | None = None, literals: bool = False, mvvm: bool = False, store_content: bool = False, force: bool = False, prune_missing: bool = False) -> dict[str, int]:
    """Index the C# files below root to Parquet tables below out; returns the number of rows of each table.

    gitignore: rules to use instead of those of the file .gitignore in root. Solutions and projects as in `find_projects`:
    files of their folders are the scope in which names are looked for first. A solution or project that is missing, a
    file that cannot be parsed and derived tables that fail are named in the metadata's `errors`; derived tables are
    written aside and take their place when all of them stand.

    Where out holds a finished index, only new and changed files are extracted, or all with `force` or when `literals` is
    not as it was. Files that the scan no longer finds stay in the index unless `prune_missing`.
    """
    began = time.time()
    meta = _stored_meta(spark, out)
    last, now = meta.get("generation"), 1 - meta.get("generation", 1)
    rules = tree.read_text(spark, f"{root.rstrip('/')}/.gitignore") or "" if gitignore is None else gitignore
    scan = tree.scan_files(spark, root, ignore.build_spec(rules, extra_ignore))
    stored = None if last is None else spark.read.parquet(f"{out}/_parsed{last}")
    if last is not None:
        before = spark.read.parquet(f"{out}/_scan{last}").select(*scan.columns)
        scan, stored = (scan, stored.join(scan.select("path"), "path", "left_semi")) if prune_missing else (incremental.upsert(before, scan, "path"), stored)
    files = derive.with_ids(scan.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")), "folder", ["path"])
    _write(files, out, f"_scan{now}")
    files = spark.read.parquet(f"{out}/_scan{now}")
    _write(_extract(files, stored, force or meta.get("literals") != literals, literals), out, f"_parsed{now}")
    parsed = spark.read.parquet(f"{out}/_parsed{now}")
    syms = parsed.select("path", F.posexplode("symbols").alias("seq", "s")).select("path", "seq", "s.*").join(files.select("path", F.col("id").alias("file_id")), "path").drop("path")
    _write(derive.with_ids(syms, "file_id", ["seq"]), out, "symbols")
    symbols = spark.read.parquet(f"{out}/symbols")
    projects, errors = find_projects(spark, root, sln, csproj, all_solutions)
    projects = derive.with_ids(projects.withColumn("folder", F.regexp_replace("path", "/[^/]*$", "")), "folder", ["path"]).drop("folder")
    _write(projects, out, "projects")
    projects = spark.read.parquet(f"{out}/projects")
    _write(tree.project_edges(projects), out, "project_edges")
    _write(derive.files_to_projects(files, projects), out, "project_files")
    links = spark.read.parquet(f"{out}/project_files")
    scope = links.select("file_id") if not links.isEmpty() else None
    refs = resolve.source_symbols(_raw_edges(parsed, files), symbols)
    edges = resolve.resolve_all(refs, symbols, scope)
    base = F.col("edge_type").isin("inherits", "implements")
    edges = edges.where(~base).unionByName(resolve.repair_inheritance(edges.where(base), symbols))
    edges = resolve.merge_inheritance_meta(edges)
    edges = edges.withColumn("confidence", F.when(F.col("edge_type") == "imports", F.col("parsed_confidence")).otherwise(F.col("confidence"))).drop("parsed_confidence", "src_qualified", "dst_guess")
    order = ["ref_start_line", "ref_start_col", "edge_type", "meta_json"]
    _write(derive.with_ids(edges, "src_file_id", order), out, "edges")
    edges = spark.read.parquet(f"{out}/edges")
    try:
        feats, derived = derive.features(symbols, links, projects), ["features"]
        if mvvm:
            primary = derive.primary_services(edges, symbols)
            feats = derive.override_services(feats, primary, symbols)
            views = derive.view_edges(symbols).unionByName(primary.select("src_symbol_id", "dst_symbol_id", "edge_type"), allowMissingColumns=True)
            for adapter in UI_ADAPTERS:
                views = views.unionByName(adapter(symbols, files), allowMissingColumns=True)
            _write(views, out, "_staged/mvvm_edges")
            derived.append("mvvm_edges")
        _write(feats, out, "_staged/features")
        for name in derived:
            tree.move(spark, f"{out}/_staged/{name}", f"{out}/{name}")
    except (AnalysisException, PySparkException) as e:
        errors.append(f"features: {e}")
    _write(derive.folders(files), out, "folders")
    _write(files if store_content else files.drop("content"), out, "files")
    errors += [f"{r.path}: {r.error}" for r in parsed.where("error is not null").select("path", "error").orderBy("path").limit(1000).collect()]
    counts = {t: spark.read.parquet(f"{out}/{t}").count() for t in ("files", "symbols", "edges", "projects", "features")}
    meta = {"last_index_ms": int((time.time() - began) * 1000), "tables": list(schemas.TABLES), "generation": now, "literals": literals, "errors": errors, "created_utc": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())}
    spark.createDataFrame([(k, json.dumps(v)) for k, v in meta.items()], schemas.META).write.mode("overwrite").parquet(f"{out}/meta")
    return counts


def _write(df: DataFrame, out: str, name: str) -> None:
    df.write.mode("overwrite").parquet(f"{out}/{name}")


def is_stale(spark: SparkSession, out: str, root: str) -> bool | None:
    """Whether the index is older than the last commit of the repository at root; None where there is no answer."""
    import subprocess

    try:
        got = subprocess.run(["git", "-C", root, "log", "-1", "--format=%ct"], capture_output=True, text=True, timeout=60, check=False)
    except OSError:
        return None
    created = _stored_meta(spark, out).get("created_utc")
    if got.returncode or not got.stdout.strip().isdigit() or not created:
        return None
    import calendar

    return calendar.timegm(time.strptime(created, "%Y-%m-%dT%H:%M:%SZ")) < int(got.stdout)


def load(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """The tables of an index, also as temporary views."""
    if "://" not in out and not os.path.exists(out):
        raise FileNotFoundError(out)
    if "://" not in out and not os.path.exists(f"{out}/meta"):
        raise ValueError(f"{out} holds no finished index")
    found = {}
    for t in ("files", "symbols", "edges", "projects", "project_files", "project_edges", "features", "folders", "meta"):
        found[t] = spark.read.parquet(f"{out}/{t}")
        found[t].createOrReplaceTempView(t)
    return found
