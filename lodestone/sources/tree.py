"""Source-tree scan, solutions and projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.ignore import ignored_column

PROJECT_REF = r'Project\("[^"]*"\)\s*=\s*"([^"]+)"\s*,\s*"([^"]+)"'


def text_of(content: str):
    """The text of a binary column: UTF-8, bytes that are none replaced, a mark at the start dropped by the readers."""
    return F.make_valid_utf8(F.col(content).cast("string"))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file of any store that Spark reads, also one whose name begins with a dot; None if there is none."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8", "replace")
    finally:
        stream.close()


def move(spark: SparkSession, source: str, target: str) -> None:
    """Put a written folder in the place of another."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    a, b = path(source), path(target)
    fs = a.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(b, True)
    fs.rename(a, b)


def discover(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """path, content of the files below root whose names fit the pattern, in order of path; no ignore rules."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    return df.select(_plain(F.col("path")).alias("path"), text_of("content").alias("content")).orderBy("path")


def load_texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, content of the files that exist."""
    rows = [(p, text) for p in paths if (text := read_text(spark, p)) is not None]
    return spark.createDataFrame(rows, "path string, content string")


def _plain(path):
    return F.regexp_replace(path, "^file:/+", "/")


def scan_files(spark: SparkSession, root: str, spec: list, pattern: str = "*.{cs,CS,Cs,cS}") -> DataFrame:
    """path, size, mtime_ns (of millisecond resolution), sha256, content, in order of path after the ignore rules."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(root)
    path = _plain(F.col("path"))
    relative = F.expr(f"substring(path, {len(root.rstrip('/')) + 2})")
    df = df.select(path.alias("path"), F.col("length").alias("size"), (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.sha2("content", 256).alias("sha256"), text_of("content").alias("content"))
    return df.where(~ignored_column(relative, spec))


def fold_dots(path):
    """A path with . and .. folded and backslashes turned."""
    parts = F.filter(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), lambda p: (p != "") & (p != "."))
    folded = F.aggregate(parts, F.array().cast("array<string>"), lambda acc, p: F.when(p == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    return F.concat(F.lit("/"), F.array_join(folded, "/"))


def _folder(path):
    return F.regexp_replace(path, "/[^/]*$", "")


def parse_sln(texts: DataFrame) -> DataFrame:
    """solution, ordinal, name, path for texts(path, content): the projects that a solution lists."""
    n = F.posexplode(F.arrays_zip(F.regexp_extract_all("content", F.lit(PROJECT_REF), 1).alias("name"), F.regexp_extract_all("content", F.lit(PROJECT_REF), 2).alias("file"))).alias("ordinal", "p")
    rows = texts.select(F.col("path").alias("solution"), n)
    full = fold_dots(F.concat(_folder(F.col("solution")), F.lit("/"), F.col("p.file")))
    return rows.select("solution", "ordinal", F.col("p.name").alias("name"), full.alias("path")).where(F.lower("path").rlike(r"\.(cs|vb|fs)proj$"))


def parse_csproj(texts: DataFrame) -> DataFrame:
    """path, name, project_references, package_references, domain for texts(path, content)."""
    xml = F.regexp_replace(F.col("content"), r"^﻿?\s*<\?xml[^>]*\?>", "")
    t = texts.withColumn("xml", xml)
    get = lambda tag: F.expr(f"xpath(xml, \"//*[local-name()='{tag}']/@Include\")")
    root = F.get(F.filter(F.transform(F.expr("xpath(xml, \"//*[local-name()='RootNamespace']/text()\")"), F.trim), lambda x: x != ""), F.lit(0))
    refs = F.transform(get("ProjectReference"), lambda r: fold_dots(F.concat(_folder(F.col("path")), F.lit("/"), r)))
    name = F.regexp_replace(F.regexp_extract("path", "([^/]+)$", 1), r"\.[^.]*$", "")
    return t.select("path", name.alias("name"), refs.alias("project_references"), get("PackageReference").alias("package_references"), F.substring_index(root, ".", 1).alias("domain"))


def collect_projects(listed: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """csproj paths of all solutions, each once at its first place, and messages for those that do not exist."""
    c = listed.where(F.lower("path").endswith(".csproj"))
    first = c.groupBy("path").agg(F.min(F.struct("solution", "ordinal", "name")).alias("f"))
    there = existing.select("path").distinct()
    missing = c.join(there, "path", "left_anti").select(F.format_string("solution %s lists missing .csproj: %s", "solution", "path").alias("error"))
    return first.join(there, "path", "left_semi").select("path", "f.*"), missing


def project_edges(projects: DataFrame) -> DataFrame:
    """src_project_id, dst_project_id (null for packages and unknown projects), edge_kind, target; equal rows once."""
    ref = projects.select(F.col("id").alias("src_project_id"), F.explode("project_references").alias("target")).withColumn("edge_kind", F.lit("project_reference"))
    pkg = projects.select(F.col("id").alias("src_project_id"), F.explode("package_references").alias("target")).withColumn("edge_kind", F.lit("package_reference"))
    known = projects.select(F.col("path").alias("dst"), F.col("id").alias("dst_project_id"))
    both = ref.unionByName(pkg)
    return both.join(known, (F.col("target") == F.col("dst")) & (F.col("edge_kind") == "project_reference"), "left").select("src_project_id", "dst_project_id", "edge_kind", "target").distinct()
