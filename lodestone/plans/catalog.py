"""Every registered query of the index operators, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as T
from lodestone.operators import derive, incremental, read, resolve, sqlapi
from lodestone.plans.bridge import CTES, Tables

QUERIES: dict = {}
ORACLE_SQL: dict = {}
FOLD = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: The ladder, restated candidate by candidate for DuckDB.
VISIBLE = "s.file_id <= r.src_file_id"
RESOLVED = """, within as (select file_id from project_files),
  q as (select r.id, r.src_symbol_id, r.dst_guess, r.src_file_id, r.rn, count(*) c, min(s.id) f, min(case when s.file_id in (select file_id from within) then s.id end) fs
    from numbered r join symbols s on s.qualified_name = r.dst_guess and s.file_id <= r.src_file_id group by all),
  n as (select r.rn, count(*) c, min(s.id) f, min(case when contains(s.qualified_name, r.dst_guess) or ends_with(s.qualified_name, '.' || r.cand) then s.id end) m
    from numbered r join symbols s on s.name = r.cand and s.file_id <= r.src_file_id and s.file_id in (select file_id from within) group by all),
  i as (select r.rn, count(*) c, min(s.id) f, count(case when s.file_id in (select file_id from within) then 1 end) cs, min(case when s.file_id in (select file_id from within) then s.id end) fs
    from numbered r join symbols s on s.name = r.cand and s.kind = 'interface' and s.file_id <= r.src_file_id group by all),
  t as (select r.rn, count(*) c, min(s.id) f from numbered r join symbols s on s.name = r.dst_guess and s.kind in ('type', 'interface', 'enum', 'delegate') and s.file_id <= r.src_file_id group by all),
  ladder as (select r.*, case when q.c = 1 then q.f when q.c > 1 and q.fs is not null then q.fs when n.c = 1 then n.f else coalesce(n.m, n.f) end dst, q.c = 1 as exact,
    case when i.c = 1 then i.f when i.cs = 1 then i.fs end one, case when t.c = 1 then t.f end lit
    from numbered r left join q on q.rn = r.rn left join n on n.rn = r.rn left join i on i.rn = r.rn left join t on t.rn = r.rn),
  resolved as (select id, src_symbol_id, src_file_id, dst_guess, parameter_index, ref_start_line, edge_type parsed, cand,
    case when edge_type = 'imports' then null when edge_type = 'string_ref' then lit when edge_type in ('inherits', 'implements') then coalesce(dst, one) else dst end dst_symbol_id,
    case when edge_type = 'imports' then 'unresolved' when edge_type = 'string_ref' then 'heuristic' when dst is not null then case when exact then 'exact' else 'heuristic' end
      when edge_type in ('inherits', 'implements') and one is not null then 'heuristic' else 'unresolved' end confidence
    from ladder where edge_type <> 'string_ref' or lit is not null),
  edges as (select x.*, case when parsed not in ('inherits', 'implements') then parsed when k.kind = 'interface' then 'implements'
    when k.kind is null and regexp_matches(cand, '^I[A-Z]') then 'implements' else parsed end edge_type, k.kind dst_kind from resolved x left join symbols k on k.id = x.dst_symbol_id)"""
NUMBERED = """, numbered as (select *, row_number() over () rn, case when edge_type in ('inherits', 'implements') then string_split(trim(string_split(dst_guess, '<')[1]), '.')[-1]
    else coalesce(name, string_split(dst_guess, '.')[-1]) end cand from refs)"""
EDGES = CTES + NUMBERED + RESOLVED


def query(oracle: str | None = None, ctes: str = CTES):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if oracle:
            ORACLE_SQL[f.__name__] = f"with recursive {ctes} {oracle}"
        return f

    return register


def _edges(t: Tables, *types: str) -> DataFrame:
    """All edges, or those that can become one of the types: inheritance may turn out either way."""
    refs = t.refs.where(F.col("edge_type").isin(*types)) if types else t.refs
    return resolve.resolve_all(refs, t.symbols, t.scope)


_PICK = "id, src_symbol_id, src_file_id, edge_type, dst_guess, dst_symbol_id, confidence"
_COLS = ["id", "src_symbol_id", "src_file_id", "edge_type", "dst_guess", "dst_symbol_id", "confidence"]


@query("select s.id, kind, name, qualified_name, path, span_start_line, span_end_line from symbols s join files f on f.id = file_id where name = 'RedService' or " + FOLD.format("qualified_name") + " like '%service%' order by path, span_start_line, s.id limit 100")
def find_symbol_name(t):
    return read.find_symbol(t.symbols, t.files, name="Service")


@query("select s.id, kind, name, qualified_name, path, span_start_line, span_end_line from symbols s join files f on f.id = file_id where kind = 'interface' order by path, span_start_line, s.id limit 100")
def find_symbol_kind(t):
    return read.find_symbol(t.symbols, t.files, kind="interface")


@query("select s.id, s.kind, name, qualified_name, path, span_start_line, span_end_line from symbols s join files f on f.id = file_id where s.kind = 'type' and " + FOLD.format("path") + " like '/repo/asia/%' order by path, span_start_line, s.id limit 100")
def find_symbol_glob(t):
    return read.find_symbol(t.symbols, t.files, kind="type", file_glob="/repo/ASIA/*")


@query("select s.id, s.kind, qualified_name, span_start_line, span_end_line from symbols s join files f on f.id = file_id where path in (select path from files where id = 3)")
def symbols_in_file(t):
    path = t.files.where("id = 3").first().path
    return read.symbols_in_file(t.symbols, t.files, path)


@query("select id, path from files where " + FOLD.format("path") + " like '%supplier_00000000%' order by path limit 200")
def path_search(t):
    return read.path_search(t.files, "Supplier_00000000")


@query("select 'symbols' as name, count(*) n from symbols union all select 'edges', count(*) from refs union all select 'files', count(*) from files union all select 'projects', count(*) from projects")
def index_stats(t):
    return read.stats(symbols=t.symbols, edges=t.refs, files=t.files, projects=t.projects)


@query(f"select {_PICK} from edges where edge_type = 'calls'", EDGES)
def resolve_calls(t):
    return resolve.resolve_general(t.refs.where("edge_type = 'calls'"), t.symbols, scope=t.scope).select(_COLS)


@query(f"select {_PICK} from edges where edge_type = 'injects'", EDGES)
def resolve_injects(t):
    return resolve.resolve_general(t.refs.where("edge_type = 'injects'"), t.symbols, scope=t.scope).select(_COLS)


@query(f"select {_PICK} from edges where parsed in ('inherits', 'implements')", EDGES)
def resolve_inheritance(t):
    return resolve.resolve_inheritance(t.refs.where("edge_type in ('inherits', 'implements')"), t.symbols, t.scope).select(_COLS)


@query(f"select {_PICK} from edges where edge_type = 'string_ref'", EDGES)
def resolve_string_refs(t):
    return resolve.resolve_string_refs(t.refs.where("edge_type = 'string_ref'"), t.symbols).select(_COLS)


@query(f"select {_PICK} from edges", EDGES)
def resolve_all(t):
    return _edges(t).select(_COLS)


_REPAIR = EDGES + """, lost as (select * from edges where parsed in ('inherits', 'implements') and dst_symbol_id is null),
  q2 as (select dst_guess, count(*) c, min(s.id) f from (select distinct dst_guess from lost) l join symbols s on s.qualified_name = dst_guess group by all),
  qc as (select cand, count(*) c, min(s.id) f, min(case when ends_with(s.qualified_name, '.' || cand) then s.id end) m from (select distinct cand from lost) l join symbols s on s.name = cand group by all)
"""


@query("""select l.id, l.src_symbol_id, l.dst_guess, coalesce(case when q2.c >= 1 then q2.f end, case when contains(l.cand, l.dst_guess) then qc.f else coalesce(qc.m, qc.f) end) dst_symbol_id
  from lost l left join q2 using (dst_guess) left join qc using (cand)
  union all select id, src_symbol_id, dst_guess, dst_symbol_id from edges where parsed in ('inherits', 'implements') and dst_symbol_id is not null""", _REPAIR)  # fmt: skip
def resolve_inheritance_repair(t):
    e = resolve.resolve_inheritance(t.refs.where("edge_type in ('inherits', 'implements')"), t.symbols, t.scope)
    return resolve.repair_inheritance(e, t.symbols).select("id", "src_symbol_id", "dst_guess", "dst_symbol_id")


@query("select edge_type, confidence, count(*) n from edges group by all", EDGES)
def confidence_histogram(t):
    return _edges(t).groupBy("edge_type", "confidence").agg(F.count("*").alias("n"))


@query("select r.id, r.src_file_id, max(s.id) src_symbol_id from (select distinct id, src_file_id, src_symbol_id o from refs) r join symbols b on b.id = r.o join symbols s on s.file_id = r.src_file_id and s.qualified_name = b.qualified_name group by r.id, r.src_file_id, r.o")
def edge_source_endpoint(t):
    q = t.symbols.select(F.col("id").alias("o"), F.col("qualified_name").alias("src_qualified"))
    refs = t.refs.select("id", "src_file_id", F.col("src_symbol_id").alias("o")).distinct().join(q, "o")
    return resolve.source_symbols(refs, t.symbols).select("id", "src_file_id", "src_symbol_id")


_TARGET = "(select min(id) from symbols where name = (select min(name) from symbols where kind = 'interface'))"


def _at(t: Tables, query, *types: str) -> DataFrame:
    """query(edges, symbols, id) for the first symbol of the first interface name; only edges of these types are resolved."""
    symbols, refs = t.symbols, t.refs
    first = symbols.groupBy("name").agg(F.min("id").alias("id"), F.max(F.col("kind") == "interface").alias("i"))
    symbol_id = first.where("i").agg(F.min_by("id", "name")).first()[0]
    refs = refs.where(F.col("edge_type").isin(*types)) if types else refs
    return query(resolve.resolve_all(refs, symbols, t.scope), symbols, symbol_id)


@query(f"select e.id, edge_type, confidence, src_file_id, path, ref_start_line, dst_symbol_id from edges e join files f on f.id = src_file_id where dst_symbol_id = {_TARGET} order by path, ref_start_line, e.id limit 200", EDGES)
def find_references(t):
    return _at(t, lambda e, s, i: read.find_references(e, t.files, symbol_id=i))


_UNIQUE = "(select min(qualified_name) from (select qualified_name from symbols where prefix <> '' group by qualified_name having count(*) = 1) where qualified_name in (select dst_guess from refs where edge_type = 'calls'))"


@query(f"select e.id, edge_type, confidence, src_file_id, path, ref_start_line, dst_symbol_id from edges e join files f on f.id = src_file_id where dst_symbol_id in (select id from symbols where qualified_name = {_UNIQUE}) order by path, ref_start_line, e.id limit 200", EDGES)
def find_references_qualified(t):
    called = t.refs.where("edge_type = 'calls'").select(F.col("dst_guess").alias("qualified_name"))
    name = t.symbols.where("prefix <> ''").groupBy("qualified_name").agg(F.count("*").alias("n")).where("n = 1").join(called, "qualified_name", "left_semi").agg(F.min("qualified_name")).first()[0]
    return read.find_references(_edges(t), t.files, t.symbols, qualified=name)


@query(f"select e.id, confidence, path, ref_start_line, src_symbol_id, s.qualified_name src_q from edges e join files f on f.id = src_file_id left join symbols s on s.id = src_symbol_id where edge_type = 'calls' and dst_symbol_id = {_TARGET} order by path, ref_start_line, e.id limit 200", EDGES)
def callers_of(t):
    return _at(t, lambda e, s, i: read.callers_of(e, t.files, s, i), "calls")


@query(f"select s.id, s.kind, s.name, s.qualified_name, path, s.span_start_line from edges e join symbols s on s.id = src_symbol_id join symbols d on d.id = dst_symbol_id join files f on f.id = s.file_id where d.kind = 'interface' and d.id = {_TARGET} and edge_type in ('implements', 'inherits') order by e.id, src_symbol_id limit 200", EDGES)
def implementations_of(t):
    return _at(t, lambda e, s, i: read.implementations_of(e, t.files, s, i), "inherits", "implements")


@query(f"select path, ref_start_line, confidence, edge_type from edges e join files f on f.id = src_file_id where edge_type = 'calls' and dst_symbol_id = {_TARGET}", EDGES)
def incoming_calls(t):
    return _at(t, lambda e, s, i: read.incoming_calls(e, t.files, i), "calls")


_VM = """, vm as (select id, file_id, qualified_name, case when ends_with(name, 'ViewModel') then left(name, -9) else name end stem,
    (case when contains(qualified_name, '.') then regexp_replace(qualified_name, '\\.[^.]*$', '') else qualified_name end) || '.' || case when ends_with(name, 'ViewModel') then left(name, -9) else name end base
    from symbols where kind = 'type' and lower(name) like '%viewmodel'),
  feats as (select v.stem as name, coalesce(nullif(trim(p.domain), ''), case when contains(v.qualified_name, '.') then string_split(v.qualified_name, '.')[1] end) as domain, v.qualified_name viewmodel,
    (select s.qualified_name from symbols s join (values (0, 'Service'), (1, 'ServiceAgent'), (2, 'Manager')) x(o, suf) on s.qualified_name = v.base || suf where s.kind in ('type', 'interface') order by o, s.id limit 1) service, p.name project
    from (select arg_min(vm, id) v from vm group by qualified_name) left join (select file_id, arg_min(p.name, p.name) as name, arg_min(p.domain, p.name) as domain from project_files pf join projects p on p.id = pf.project_id group by file_id) p on p.file_id = v.file_id
    where v.stem <> '')"""
_VM = _VM.replace("select arg_min(vm, id) v from vm", "select arg_min(struct_pack(id, file_id, qualified_name, stem, base), id) v from vm").replace("case when contains(v.qualified_name", "case when contains(v.qualified_name")


@query("select * from feats", CTES + _VM)
def features(t):
    return derive.features(t.symbols, t.project_files, t.projects)


@query("select * from feats where lower(name) like '%red%' order by coalesce(domain, ''), name, viewmodel limit 500", CTES + _VM)
def features_by_name(t):
    return read.features_by_name(derive.features(t.symbols, t.project_files, t.projects), "Red")


@query("""select s.id src_symbol_id, vm.id dst_symbol_id, s.file_id src_file_id, 'mvvm_view' edge_type, 'heuristic' confidence from vm join lateral
  (select s.id, s.file_id from symbols s join (values (0, 'View'), (1, 'Page'), (2, 'Window')) x(o, suf) on s.qualified_name = vm.base || suf where s.kind = 'type' order by o, s.id limit 1) s on true""", CTES + _VM)  # fmt: skip
def mvvm_view_edges(t):
    return derive.view_edges(t.symbols)


_PRIMARY = EDGES + _VM + """, ranked as (select e.src_symbol_id, e.dst_symbol_id, d.qualified_name dst_qualified, e.parameter_index,
    row_number() over (partition by e.src_symbol_id order by case when ends_with(d.name, 'Service') then 0 when ends_with(d.name, 'ServiceAgent') then 1 when ends_with(d.name, 'Manager') then 2 when ends_with(d.name, 'Client') then 3 else 99 end,
    e.parameter_index, d.name, d.id) k from edges e join vm on vm.id = e.src_symbol_id join symbols d on d.id = e.dst_symbol_id where e.edge_type = 'injects'),
  prim as (select * from ranked where k = 1)"""


@query("select src_symbol_id, dst_symbol_id, dst_qualified, parameter_index, 'mvvm_primary_service' edge_type from prim", _PRIMARY)
def mvvm_primary_service(t):
    return derive.primary_services(_edges(t, "injects"), t.symbols)


@query("select f.name, f.domain, f.viewmodel, coalesce((select arg_max(p.dst_qualified, p.src_symbol_id) from prim p join symbols s on s.id = p.src_symbol_id where s.qualified_name = f.viewmodel), f.service) service, f.project from feats f", _PRIMARY)
def feature_service_override(t):
    s = t.symbols
    return derive.override_services(derive.features(s, t.project_files, t.projects), derive.primary_services(_edges(t, "injects"), s), s)


_NESTED = CTES + """, nested as (select id, path from projects where id % 2 = 0 union all select 1000 + r_regionkey, concat('/repo/', r_name, '/', r_name, '.csproj') from region)"""


@query("select f.id file_id, arg_max(p.id, length(p.path)) project_id from files f join nested p on starts_with(f.path, regexp_replace(p.path, '/[^/]*$', '/')) group by f.id", _NESTED)
def file_to_project(t):
    """Projects of regions hold those of half of the nations: the deepest folder decides."""
    above = t.raw("region").select((F.lit(1000) + F.col("r_regionkey")).cast("long").alias("id"), F.concat(F.lit("/repo/"), "r_name", F.lit("/"), "r_name", F.lit(".csproj")).alias("path"))
    return derive.files_to_projects(t.files, t.projects.where("id % 2 = 0").select("id", "path").union(above))


@query("select p.name src, d.name dst, edge_kind, target from project_edges e join projects p on p.id = src_project_id left join projects d on d.id = dst_project_id")
def project_dependencies(t):
    return read.project_dependencies(t.project_edges, t.projects)


@query("select src_project_id, target from project_edges where edge_kind = 'package_reference' group by all")
def package_references(t):
    return t.project_edges.where("edge_kind = 'package_reference'").select("src_project_id", "target").distinct()


@query("select id, path from projects where id not in (select project_id from project_files)")
def missing_projects(t):
    return t.projects.join(t.project_files.select(F.col("project_id").alias("id")), "id", "left_anti").select("id", "path")


@query("""select distinct p path, case when regexp_replace(p, '/[^/]*$', '') <> '' then regexp_replace(p, '/[^/]*$', '') end parent from
  (select array_to_string(string_split(path, '/')[1:unnest(range(2, len(string_split(path, '/'))))], '/') p from files)""")
def folder_chain(t):
    return derive.folders(t.files)


#: Every document as a file.
TEXTS = "texts as (select doc_id as id, '/docs/' || lpad(cast(doc_id as varchar), 12, '0') as path, text as content from documents)"


def _texts(t: Tables) -> DataFrame:
    return t.raw("documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("/docs/"), F.lpad(F.col("doc_id").cast("string"), 12, "0")).alias("path"), F.col("text").alias("content"))


@query("select path, left(content, 200) snippet from texts where " + FOLD.format("content") + " like '%the th%' order by path limit 100", TEXTS)
def grep_substring(t):
    return read.grep_substring(_texts(t), "The th")


@query(r"select path, left(string_split(content, chr(10))[1], 200) snippet from texts where regexp_matches(content, '[A-Z][a-z]+ing and') order by path limit 100", TEXTS)
def grep_regex(t):
    return read.grep_regex(_texts(t), "[A-Z][a-z]+ing and")


@query(r"select path, left(string_split(content, chr(10))[1], 200) snippet from texts where regexp_matches(content, '(?i)\bTHE\b.*\d{3}') order by path limit 100", TEXTS)
def grep_text_regex(t):
    """Python's dialect of regular expressions."""
    return read.grep_text(_texts(t), r"(?i)\bTHE\b.*\d{3}", regex=True)


@query("select path, left(content, 200) snippet from texts where " + FOLD.format("content") + " like '%ting the%' order by path limit 100", TEXTS)
def grep_text(t):
    return read.grep_text(_texts(t), "ting THE")


_TOKENS = r"list_filter(regexp_split_to_array(strip_accents(lower({})), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"


@query("select s.id, s.kind, qualified_name, path from symbols s join files f on f.id = file_id where len(list_filter(" + _TOKENS.format("name || ' ' || qualified_name") + ", lambda x: starts_with(x, 'blue'))) > 0 order by s.id limit 50")
def fts_symbol_prefix(t):
    return read.fts_symbols(t.symbols, t.files, "Blue*")


@query("select id, path from files where list_contains(" + _TOKENS.format("path") + ", 'asia') order by id limit 50")
def fts_path_term(t):
    return read.fts_paths(t.files, "asia")


@query("select doc_id from documents where list_contains(" + _TOKENS.format("text") + ", 'the') and list_contains(" + _TOKENS.format("text") + ", 'thing') and not list_contains(" + _TOKENS.format("text") + ", 'and')")
def fts_content_and(t):
    return t.raw("documents").where(T.match("the AND thing NOT and", F.col("text"))).select("doc_id")


@query(r"""select path, case when a > 1 then '…' else '' end || array_to_string(list_transform(w[a : a + 47], lambda x: case when x = 'the' then '[the]' else x end), ' ') || case when len(w) >= a + 48 then '…' else '' end snippet
  from (select path, w, list_position(w, 'the') a from (select path, """ + _TOKENS.format("content") + """ w from texts) where list_contains(w, 'the')) order by path limit 100""", TEXTS)
def fts_snippet(t):
    return read.fts_content(_texts(t), "the")


@query("select id, path from files where not (id % 3 = 0)")
def incremental_dirty(t):
    stored = t.files.where("id % 5 <> 0").withColumn("sha256", F.when(F.col("id") % 3 == 0, F.col("sha256")).otherwise("old"))
    stored = stored.unionByName(t.files.where("id % 15 = 0"))
    return incremental.dirty_files(t.files, stored).select("id", "path")


ORACLE_SQL["incremental_dirty"] = f"with {CTES} select id, path from files where id % 3 <> 0"


@query("select file_id, qualified_name, case when file_id % 4 = 0 then 'new' else kind end kind from symbols")
def incremental_replace(t):
    s = t.symbols.select("file_id", "qualified_name", "kind")
    return incremental.replace_files(s, s.where("file_id % 4 = 0").withColumn("kind", F.lit("new")))


@query("select id, src_symbol_id, case when dst_symbol_id % 2 = 0 then dst_symbol_id end dst_symbol_id, confidence from edges where edge_type = 'calls'", EDGES)
def dangling_edge_nullout(t):
    e = resolve.resolve_general(t.refs.where("edge_type = 'calls'"), t.symbols, scope=t.scope).select("id", "src_symbol_id", "dst_symbol_id", "confidence")
    return incremental.null_dangling(e, t.symbols.where("id % 2 = 0"))


@query("select id, path, sha256 from files")
def fingerprint_sha256(t):
    return t.files.select("id", "path", "sha256")


@query("select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as bigint), 0) k from events")
def json_field(t):
    return t.raw("events").select("event_id", F.coalesce(F.expr("try_cast(get_json_object(props, '$.k') as bigint)"), F.lit(0)).alias("k"))


def _sql(t: Tables, text: str) -> DataFrame:
    for name in ("symbols", "files", "projects", "project_edges", "project_files"):
        if name in text:
            getattr(t, name).createOrReplaceTempView(name)
    return sqlapi.read_query(t.spark, text)


for _name, _text in {
    "sql_window": "select id, kind, row_number() over (partition by kind order by id) as r, sum(span_start_line) over (partition by kind order by id) as s from symbols",
    "sql_setops": "select name from symbols where kind = 'type' intersect select name from symbols where kind = 'method' union select name from projects except select name from projects where id > 20",
    "sql_rollup": "select kind, file_id % 3 as f, count(*) as n, grouping(kind) as g from symbols group by rollup (kind, file_id % 3)",
    "sql_recursive": "with recursive up(a, b) as (select src_project_id, dst_project_id from project_edges where dst_project_id is not null union all select up.a, e.dst_project_id from up join project_edges e on e.src_project_id = up.b where e.dst_project_id is not null) select a, b, count(*) as n from up group by a, b",
}.items():
    QUERIES[_name] = lambda spark, sf_dir, text=_text: _sql(Tables(spark, sf_dir), text)
    ORACLE_SQL[_name] = (_text.replace("with recursive up", f"with recursive {CTES}, up") if _text.startswith("with") else f"with {CTES} {_text}").replace("sum(span_start_line) over (partition by kind order by id)", "cast(sum(span_start_line) over (partition by kind order by id) as bigint)")
