"""Index tables made from the driver's tables, so that every operator runs on data of any size.

The recipes are SQL that Spark and DuckDB read alike; the checking SQL of each query starts from the same text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestone.operators.derive import with_ids

FILES = """select s_suppkey + 1 as id, concat('/repo/', r_name, '/', n_name, '/', replace(s_name, '#', '_'), '.cs') as path, n_chars as size,
  s_suppkey * 1000003 as mtime_ns, {sha}(s_name{bits}) as sha256, text as content, cast(n_nationkey + 1 as bigint) as project_id, n_regionkey <> 4 as in_project
  from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey left join documents on doc_id = s_suppkey"""
PROJECTS = """select cast(n_nationkey + 1 as bigint) as id, n_name as name, concat('/repo/', r_name, '/', n_name, '/', n_name, '.csproj') as path, 'csproj' as kind,
  case when n_nationkey % 7 <> 0 then r_name end as domain from nation join region on n_regionkey = r_regionkey"""
PROJECT_EDGES = """select cast(a.n_nationkey + 1 as bigint) as src_project_id, cast(b.n_nationkey + 1 as bigint) as dst_project_id, 'project_reference' as edge_kind,
  cast(null as varchar(100)) as target from nation a join nation b on a.n_regionkey = b.n_regionkey and b.n_nationkey = a.n_nationkey + 5
  union all select distinct cast(s_nationkey + 1 as bigint), cast(null as bigint), 'package_reference', concat('Pkg.', replace(p_brand, '#', ''))
  from lineitem join supplier on l_suppkey = s_suppkey join part on l_partkey = p_partkey where l_quantity = 50"""
SYMBOLS = """select p_partkey as partkey, p_partkey % {files} + 1 as file_id,
  case when p_type like 'SMALL%' then 'interface' when p_type like 'MEDIUM%' then 'method' when p_type like 'PROMO%' then 'enum' when p_type like 'LARGE%' then 'delegate' else 'type' end as kind,
  concat(case when p_type like 'SMALL%' then 'I' else '' end, upper(substr(split_part(p_name, ' ', 1), 1, 1)), substr(split_part(p_name, ' ', 1), 2),
    upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2),
    case p_size % 8 when 0 then 'ViewModel' when 1 then 'Service' when 2 then 'View' when 3 then 'Manager' when 4 then 'Client' when 5 then 'ServiceAgent' when 6 then 'Page' else '' end) as name,
  case when p_partkey % 11 = 0 then '' else concat('Ns', cast(p_partkey % 5 as varchar(10)), '.') end as prefix, p_size as span_start_line, cast(p_size + p_partkey % 10 as int) as span_end_line from part"""
REFS = """select l_orderkey * 10 + l_linenumber as id, s.id as src_symbol_id, s.file_id as src_file_id,
  case concat(l_returnflag, l_linestatus) when 'AF' then 'calls' when 'AO' then 'injects' when 'NF' then 'inherits' when 'NO' then 'implements' when 'RF' then 'string_ref' else 'imports' end as edge_type,
  case (l_orderkey + l_linenumber) % 4 when 0 then t.qualified_name when 1 then t.name when 2 then concat('Ext.', t.name) else concat('Missing', t.name) end as dst_guess,
  l_linenumber as parameter_index, cast(l_quantity as int) as ref_start_line
  from lineitem join symbols s on s.partkey = l_partkey join symbols t on t.partkey = (l_orderkey * 7 + l_linenumber * 13) % {parts}"""

#: For DuckDB: the same tables as common table expressions.
CTES = f"""files as ({FILES.format(sha="sha256", bits="")}), projects as ({PROJECTS}), project_edges as ({PROJECT_EDGES}),
  project_files as (select project_id, id as file_id from files where in_project),
  raw_symbols as ({SYMBOLS.format(files="(select count(*) from supplier)")}),
  symbols as (select *, concat(prefix, name) as qualified_name, row_number() over (order by file_id, partkey) as id from raw_symbols),
  raw_refs as ({REFS.format(parts="(select count(*) from part)")}),
  refs as (select *, case when edge_type = 'calls' then string_split(dst_guess, '.')[-1] end as name from raw_refs)"""


class Tables:
    """The bridged tables of one input folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.folder = spark, sf_dir
        self.counts: dict[str, int] = {}
        self.schemas: dict[str, StructType] = {}

    def raw(self, name: str) -> DataFrame:
        """One of the driver's tables; its schema is looked up once, as each look-up is a job."""
        if name not in self.schemas:
            self.schemas[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet").schema
        return self.spark.read.schema(self.schemas[name]).parquet(f"{self.folder}/{name}.parquet")

    def count(self, name: str) -> int:
        """Rows of a table, counted once."""
        if name not in self.counts:
            self.counts[name] = self.raw(name).count()
        return self.counts[name]

    def sql(self, text: str, **more: DataFrame) -> DataFrame:
        import re

        text = text.replace("{", "{{").replace("}", "}}")
        for name in ("supplier", "nation", "region", "documents", "lineitem", "part"):
            if re.search(rf"\b(from|join) {name}\b", text):
                more[name] = self.raw(name)
                text = re.sub(rf"\b(from|join) {name}\b( [ab]\b)?", lambda m: f"{m[1]} {{{name}}}{m[2] or ' ' + name}", text)
        for name in ("symbols",):
            text = re.sub(rf"\b(from|join) {name}\b", lambda m: f"{m[1]} {{{m.string and name}}}", text)
        return self.spark.sql(text, **more)

    @property
    def files(self) -> DataFrame:
        return self.sql(FILES.format(sha="sha2", bits=", 256"))

    @property
    def projects(self) -> DataFrame:
        return self.sql(PROJECTS)

    @property
    def project_files(self) -> DataFrame:
        return self.files.where("in_project").select("project_id", F.col("id").alias("file_id"))

    @property
    def project_edges(self) -> DataFrame:
        return self.sql(PROJECT_EDGES)

    @property
    def symbols(self) -> DataFrame:
        s = self.sql(SYMBOLS.format(files=self.count("supplier")))
        return with_ids(s.withColumn("qualified_name", F.concat("prefix", "name")), "file_id", ["partkey"])

    @property
    def refs(self) -> DataFrame:
        r = self.sql(REFS.format(parts=self.count("part")), symbols=self.symbols)
        return r.withColumn("name", F.when(F.col("edge_type") == "calls", F.substring_index("dst_guess", ".", -1)).otherwise(F.lit(None)))

    @property
    def scope(self) -> DataFrame:
        return self.project_files.select("file_id")
