"""Registered queries of what goes into an index and comes out of it: sources, extractor, incremental writes, notes.

The source texts are made from the driver's tables by SQL that Spark and DuckDB read alike; the checking SQL says what a
reader of these texts must find.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.export import notes
from lodestone.extract.csharp import extract_files
from lodestone.operators import derive, incremental, read, resolve
from lodestone.plans.bridge import CTES
from lodestone.plans.catalog import _VM, EDGES, _edges, query
from lodestone.sources import ignore, tree

RULES = "*.tmp.cs\n!keep.tmp.cs\n/only\nlogs/\n"
PATHS = """select p_partkey as id, concat(case p_partkey % 9 when 0 then 'bin/' when 1 then 'src/obj/' when 2 then 'a/logs/' when 3 then 'only/' when 4 then 'b/only/' when 5 then 'lib/binary/' else '' end,
  replace(p_name, ' ', '_'), case p_partkey % 7 when 0 then '/x.tmp.cs' when 1 then '/keep.tmp.cs' when 2 then '/logs' else '.cs' end) as path from part"""


@query("select id, path, case when p % 9 in (2, 3) then true when p % 7 = 1 then false else p % 9 in (0, 1) or p % 7 = 0 end ignored from (select id, path, id p from paths)", f"paths as ({PATHS})")
def ignore_rules(t):
    paths = t.sql(PATHS)
    return paths.select("id", "path", ignore.ignored_column(F.col("path"), ignore.build_spec(RULES)).alias("ignored"))


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see; of this machine only where no shared one is named."""
    base = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    return f"{base.rstrip('/')}/lodestone-{uuid.uuid4().hex}"


@query("""select concat('region=', n_regionkey) folder, octet_length(encode(string_agg(n_name || chr(10), '' order by n_name))) as size, sha256(string_agg(n_name || chr(10), '' order by n_name)) sha256,
  string_agg(n_name || chr(10), '' order by n_name) as content from nation where n_regionkey <> 3 group by n_regionkey""", "none as (select 1)")
def scan_tree(t):
    """Nations, written as one text a region and scanned again; one region's folder is ignored."""
    root, spark = scratch(t.spark), t.spark
    rows = t.raw("nation").select(F.col("n_name").alias("value"), F.col("n_regionkey").alias("region"))
    rows.repartition("region").sortWithinPartitions("region", "value").write.partitionBy("region").text(root)
    found = tree.scan_files(spark, root, ignore.build_spec("region=3/\n"), "*.txt")
    return found.select(F.regexp_extract("path", "([^/]+)/[^/]+$", 1).alias("folder"), "size", "sha256", "content")


SOURCES = """select s_suppkey as id, concat('/src/', s_suppkey, '.cs') as path, concat('using Acme.N', s_nationkey, ';\nnamespace Acme.S', s_suppkey, '\n{\n  public interface ILedger', s_nationkey, ' { }\n',
  '  public class Book : ILedger', s_nationkey, '\n  {\n    public Book(IRules', s_suppkey % 7, ' rules) { }\n    public int Sum(int n)\n    {\n      return store.Find(n);\n    }\n  }\n}\n') as content,
  s_nationkey as n, s_suppkey as s from supplier"""


def _parsed(t) -> DataFrame:
    return extract_files(t.sql(SOURCES))


@query("""select path, k.kind, k.name, concat('Acme.S', s, '.', k.owner, k.name) qualified_name, k.a span_start_line, k.b span_end_line from
  (select path, s, unnest([{'kind': 'interface', 'name': concat('ILedger', n), 'owner': '', 'a': 4, 'b': 4},
    {'kind': 'type', 'name': 'Book', 'owner': '', 'a': 5, 'b': 12}, {'kind': 'constructor', 'name': 'Book', 'owner': 'Book.', 'a': 7, 'b': 7}, {'kind': 'method', 'name': 'Sum', 'owner': 'Book.', 'a': 8, 'b': 11}]) k from sources)""", f"sources as ({SOURCES})")  # fmt: skip
def extract_symbols(t):
    s = _parsed(t).select("path", F.explode("symbols").alias("s"))
    return s.select("path", "s.kind", "s.name", "s.qualified_name", "s.span_start_line", "s.span_end_line")


@query("""select path, k.t edge_type, k.g dst_guess, k.l ref_start_line from
  (select path, unnest([{'t': 'imports', 'g': concat('Acme.N', n), 'l': 1}, {'t': 'inherits', 'g': concat('ILedger', n), 'l': 5}, {'t': 'injects', 'g': concat('IRules', s % 7), 'l': 7}, {'t': 'calls', 'g': 'store.Find', 'l': 10}]) k from sources)""", f"sources as ({SOURCES})")  # fmt: skip
def extract_edges(t):
    e = _parsed(t).select("path", F.explode("edges").alias("e"))
    return e.select("path", "e.edge_type", F.col("e.dst_qualified_guess").alias("dst_guess"), "e.ref_start_line")


_SLN = "solutions as (select n_name as name, n_regionkey as r, row_number() over (partition by n_regionkey order by n_name) - 1 as k, n_nationkey as n from nation)"


def _solutions(t) -> DataFrame:
    """A solution for each region; every fourth entry is a folder."""
    line = F.concat(F.lit('Project("{1}") = "'), "n_name", F.lit('", "..\\src\\'), "n_name", F.when(F.col("n_nationkey") % 4 == 0, F.lit('", "{2}"')).otherwise(F.concat(F.lit("\\"), "n_name", F.lit('.csproj", "{2}"'))))
    rows = t.raw("nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_name", line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    return rows.select(F.concat(F.lit("/r/all/"), "n_regionkey", F.lit(".sln")).alias("path"), "content")


@query("select concat('/r/all/', r, '.sln') solution, cast(k as int) ordinal, name, concat('/r/src/', name, '/', name, '.csproj') path from solutions where n % 4 <> 0", _SLN)
def solution_projects(t):
    return tree.parse_sln(_solutions(t))


@query("select concat('solution /r/all/', r, '.sln lists missing .csproj: /r/src/', name, '/', name, '.csproj') error from solutions where n % 4 <> 0 and n % 3 = 0", _SLN)
def solution_missing(t):
    there = t.raw("nation").where("n_nationkey % 3 <> 0").select(F.concat(F.lit("/r/src/"), "n_name", F.lit("/"), "n_name", F.lit(".csproj")).alias("path"))
    return tree.collect_projects(tree.parse_sln(_solutions(t)), there)[1]


CSPROJ = """select cast(n_nationkey + 1 as bigint) as id, concat('/r/src/', n_name, '/', n_name, '.csproj') as path, concat('<Project><PropertyGroup><RootNamespace>Acme', n_regionkey, '.', n_name, '</RootNamespace></PropertyGroup><ItemGroup>',
  '<ProjectReference Include="../NATION_', (n_nationkey * 3) % 30, '/NATION_', (n_nationkey * 3) % 30, '.csproj"/><PackageReference Include="Pkg', n_regionkey, '"/></ItemGroup></Project>') as content, n_nationkey as n, n_regionkey as r, n_name as name from nation"""


@query("select path, name, concat('Acme', r) as domain, concat('/r/src/NATION_', n * 3 % 30, '/NATION_', n * 3 % 30, '.csproj') project_reference, concat('Pkg', r) package_reference from csproj", f"csproj as ({CSPROJ})")
def csproj_fields(t):
    one = lambda c: F.array_join(f"{c}s", ",").alias(c)
    return tree.parse_csproj(t.sql(CSPROJ)).select("path", "name", "domain", one("project_reference"), one("package_reference"))


@query("""select a.id src_project_id, b.id dst_project_id, 'project_reference' edge_kind, concat('/r/src/NATION_', a.n * 3 % 30, '/NATION_', a.n * 3 % 30, '.csproj') target from csproj a left join csproj b on b.n = a.n * 3 % 30
  union all select id, null, 'package_reference', concat('Pkg', r) from csproj""", f"csproj as ({CSPROJ})")
def csproj_edges(t):
    projects = tree.parse_csproj(t.sql(CSPROJ)).join(t.sql(CSPROJ).select("path", "id"), "path")
    return tree.project_edges(projects)


@query("select id, path, case when id % 3 = 0 then size else -1 end as size from files where id % 3 = 0 or id % 2 = 0")
def upsert_files(t):
    """Of the stored even files and the scanned ones of three, the scanned rows stay where both have a path."""
    f = t.files.select("id", "path", "size")
    return incremental.upsert(f.where("id % 2 = 0").withColumn("size", F.lit(-1).cast("long")), f.where("id % 3 = 0").withColumn("size", F.col("size").cast("long")), "path")


@query("""select id, cand base_short, case when dst_symbol_id is null then 'false' else 'true' end base_resolved, dst_kind, case when dst_symbol_id is null then case when regexp_matches(cand, '^I[A-Z]') then 'interface' else 'unknown' end end base_kind_hint
  from edges where parsed in ('inherits', 'implements')""", EDGES)  # fmt: skip
def inheritance_meta(t):
    e = _edges(t, "inherits", "implements").withColumn("meta_json", F.lit(None).cast("string"))
    get = lambda k: F.get_json_object("meta_json", f"$.{k}").alias(k)
    return resolve.merge_inheritance_meta(e).select("id", get("base_short"), get("base_resolved"), get("dst_kind"), get("base_kind_hint"))


_FIRST = "(select min(name) from symbols where prefix <> '')"


@query(f"select s.id, s.kind, name, qualified_name, path from symbols s join files f on f.id = file_id where name = {_FIRST} or qualified_name = {_FIRST} order by qualified_name <> {_FIRST}, qualified_name, s.id limit 1")
def lookup_symbol(t):
    name = t.symbols.where("prefix <> ''").agg(F.min("name")).first()[0]
    return read.lookup_symbol(t.symbols, t.files, name)


_TYPES = "('type', 'interface', 'enum', 'delegate')"
_LINKS = EDGES + f""", tops as (select id, qualified_name from symbols where kind in {_TYPES}),
  within_of as (select distinct m.id, m.kind, m.qualified_name, o.qualified_name as owner from symbols m join (select distinct qualified_name from tops) o on starts_with(m.qualified_name, o.qualified_name || '.')),
  links as (select owner, 'methods' section, qualified_name link from within_of where kind in ('method', 'constructor') union select owner, 'properties', qualified_name from within_of where kind in ('property', 'field')
    union select w.owner, 'calls', d.qualified_name from edges e join within_of w on w.id = e.src_symbol_id join symbols d on d.id = e.dst_symbol_id where e.edge_type = 'calls'
    union select s.qualified_name, e.edge_type, d.qualified_name from edges e join tops s on s.id = e.src_symbol_id join symbols d on d.id = e.dst_symbol_id where e.edge_type in ('inherits', 'implements', 'injects'))"""


@query("select * from links", _LINKS)
def note_links(t):
    return notes.structure(t.symbols, _edges(t, "calls", "injects", "inherits", "implements"))


def _section(kind: str, title: str) -> str:
    return f"chr(10) || '## {title}' || chr(10) || coalesce((select string_agg('- [[' || replace(link, '.', '/') || ']]', chr(10) order by link) from links where owner = s.qualified_name and section = '{kind}'), '- (none)') || chr(10)"


@query(f"""select replace(qualified_name, '.', '/') || '.md' as path, '---' || chr(10) || 'id: ' || s.id || chr(10) || 'kind: ' || s.kind || chr(10) || 'qualified_name: ' || qualified_name || chr(10) || 'file_path: ' || f.path || chr(10) || '---' || chr(10) || chr(10) || '# ' || name || chr(10)
  || {" || ".join(_section(k, v) for k, v in notes.SECTIONS.items())} as body from symbols s join files f on f.id = s.file_id where s.kind in {_TYPES}""", _LINKS)  # fmt: skip
def type_notes(t):
    return notes.notes(t.symbols, _edges(t, "calls", "injects", "inherits", "implements"), t.files)


@query("""select 'Features/' || name || '.md' as path, '# Feature: ' || name || chr(10) || chr(10) || '**Domain:** ' || coalesce(domain, '') || chr(10) || '**ViewModel:** [[' || replace(viewmodel, '.', '/') || ']]' || chr(10)
  || coalesce(chr(10) || '**Service:** [[' || replace(service, '.', '/') || ']]' || chr(10), '') as body from feats""", CTES + _VM)
def feature_notes(t):
    return notes.feature_notes(derive.features(t.symbols, t.project_files, t.projects))
