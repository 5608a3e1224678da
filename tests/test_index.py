import io
import json
import re
import sqlite3

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone import cli, index, server
from lodestone.export import notes
from lodestone.extract import csharp
from lodestone.extract.csharp import extract
from lodestone.functions import text as T
from lodestone.operators import read, sqlapi
from lodestone.sources import ignore, tree

SAMPLE = """using Acme.Core;
namespace Acme.Billing
{
    public interface ILedger { decimal Total { get; } }
    public abstract class Account<T> : ILedger
    {
        private readonly List<T> lines = new(), spare;
        public string Label { get { return "LedgerLabel"; } }
        protected Account(ITaxRules rules, [In] int count = 3) => Check(rules);
        public virtual decimal Sum(int year)
        {
            return rules?.Rate(year) ?? Find<T>(year).Where(x => x.Open()).First();
        }
    }
    public sealed class Invoice : Account<Line>, IPrintable
    {
        void Print() { new Printer(this).Run(); base.Sum(1); Log.Write("done"); }
    }
}
"""


def test_extract():
    symbols, edges, error = extract(SAMPLE, literals=True)
    assert error is None
    base = "Acme.Billing"
    assert [(s["kind"], s["qualified_name"].removeprefix(base).lstrip(".")) for s in symbols if s["kind"] != "namespace"] == [
        ("interface", "ILedger"), ("property", "ILedger.Total"), ("type", "Account"), ("field", "Account.lines"), ("field", "Account.spare"), ("property", "Account.Label"),
        ("constructor", "Account.Account"), ("method", "Account.Sum"), ("type", "Invoice"), ("method", "Invoice.Print"),
    ]
    assert {(e["edge_type"], e["dst_qualified_guess"]) for e in edges if e["edge_type"] not in ("calls", "string_ref", "imports")} == {
        ("inherits", "ILedger"), ("inherits", "Account<Line>"), ("implements", "IPrintable"), ("injects", "ITaxRules"), ("injects", "int"),
    }
    assert [e["src_symbol_name"] for e in edges if e["edge_type"] == "string_ref"] == [f"{base}.Account.Label"]
    calls = {e["dst_qualified_guess"]: json.loads(e["meta_json"])["callee_simple"] for e in edges if e["edge_type"] == "calls"}
    assert calls == {
        "Check": "Check", ".Rate": "Rate", "Find<T>": "Find<T>", "Find<T>(year).Where": "Where", "x.Open": "Open", "Find<T>(year).Where(x=>x.Open()).First": "First",
        "newPrinter(this).Run": "Run", "base.Sum": "Sum", "Log.Write": "Write",
    }


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet='{}()<>[];:,."\'=@$#/\\ \nclassintvoidnewABé', max_size=80))
def test_extract_never_raises(code):
    symbols, _, _ = extract("class A { " + code)
    assert all(s["span_end_line"] >= s["span_start_line"] >= 1 for s in symbols)


def tree_of(folder, files):
    for name, text in files.items():
        p = folder / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text if isinstance(text, bytes) else text.encode())


PROJECT = '<Project><PropertyGroup><RootNamespace>Acme.{0}</RootNamespace></PropertyGroup><ItemGroup><ProjectReference Include="..\\Abc\\Core.csproj"/><PackageReference Include="Json"/></ItemGroup></Project>'


def test_index_of_a_solution(spark, tmp_path, capsys):
    """Scan with ignore rules and bad bytes, projects of a solution, scope, notes, command line and tools, end to end."""
    src, out = tmp_path / "src", str(tmp_path / "out")
    tree_of(src, {
        "App/Ledger.cs": SAMPLE, "App/Cafe.cs": "class Caf\xe9 { string S = \"\x80\"; }".encode("latin-1"), "App/obj/Made.cs": "class Made {}", "gen/Auto.cs": "class Auto {}", ".gitignore": "# made\n/gen/\n",
        "App/App.csproj": PROJECT.format("App"), "Abc/Core.csproj": PROJECT.format("Core"), "Abc/Tax.cs": "namespace Acme.Core; public interface ITaxRules { } class Log { static void Write() {} }",
        "Old/Tax.cs": "namespace Acme.Old; interface ITaxRules { } class TaxViewModel { public TaxViewModel(TaxService s) {} } class TaxService {}",
        "All.sln": 'Project("{1}") = "App", "App\\App.csproj", "{2}"\nProject("{1}") = "Core", "Abc\\Core.csproj", "{3}"\nProject("{1}") = "Gone", "Gone\\Gone.csproj", "{4}"',
    })
    assert cli.main(["index", str(src), "--out", out, "--index-mvvm-edges", "--store-content"], spark) == 0
    t = index.load(spark, out)
    assert sorted(r.path.removeprefix(f"{src}/") for r in t["files"].collect()) == ["Abc/Tax.cs", "App/Cafe.cs", "App/Ledger.cs", "Old/Tax.cs"]
    assert read.lookup_file(t["files"], f"{src}/App/Cafe.cs").first().content.count("\ufffd") == 2
    meta = {r.key: json.loads(r.value) for r in t["meta"].collect()}
    assert len(meta["errors"]) == 1 and "missing .csproj" in meta["errors"][0] and not index.is_stale(spark, out, str(tmp_path))
    deps = read.project_dependencies(t["project_edges"], t["projects"])
    assert {(r.src, r.dst) for r in deps.where("edge_kind = 'project_reference'").collect()} == {("App", "Core"), ("Core", "Core")} and deps.count() == 4
    core = read.lookup_symbol(t["symbols"], t["files"], "Acme.Core.ITaxRules").first()
    injected = t["edges"].where("edge_type = 'injects' and dst_symbol_id is not null").collect()
    assert t["project_files"].count() == 3 and [(r.confidence, r.dst_symbol_id) for r in injected] == [("heuristic", core.id)]
    bases = {json.loads(r.meta_json)["base_short"]: json.loads(r.meta_json) for r in t["edges"].where("edge_type in ('inherits', 'implements')").collect()}
    assert bases["ILedger"]["base_resolved"] == "true" or bases["ILedger"]["base_resolved"] is True
    assert bases["ILedger"]["dst_kind"] == "interface" and bases["IPrintable"]["base_kind_hint"] == "interface" and "base_text" in bases["Account"]
    assert [r.service for r in t["features"].collect()] == ["Acme.Old.TaxService"]
    body = {r.path: r.body for r in notes.notes(t["symbols"], t["edges"], t["files"]).collect()}
    assert "## Properties\n- [[Acme/Billing/Account/Label]]" in body["Acme/Billing/Account.md"] and "- [[Acme/Billing/Account]]" in body["Acme/Billing/Invoice.md"]
    assert notes.export(t, str(tmp_path / "vault")) == len(body) + 1
    assert (tmp_path / "vault/Features/Tax.md").read_text() == "# Feature: Tax\n\n**Domain:** Acme\n**ViewModel:** [[Acme/Old/TaxViewModel]]\n\n**Service:** [[Acme/Old/TaxService]]\n"
    capsys.readouterr()
    assert cli.main(["query", "find-symbol", "--index", out, "--kind", "interface", "--file-glob", "*/Abc/*"], spark) == 0
    assert str(core.id) in capsys.readouterr().out
    assert cli.main(["query", "grep-text", r"class\s+Caf", "--regex", "--index", out], spark) == 0 and "Cafe.cs" in capsys.readouterr().out
    assert cli.main(["notes", "get-or-create", "Invoice", "--index", out, "--notes-dir", str(tmp_path / "n")], spark) == 0
    assert cli.main(["notes", "append", "Invoice", "--text", "seen", "--notes-dir", str(tmp_path / "n")], spark) == 0 and capsys.readouterr().out.rstrip().endswith("seen")
    assert cli.main(["query", "stats", "--index", str(tmp_path / "absent")], spark) == 2
    (src / "More.sln").write_text("none")
    assert cli.main(["index", str(src), "--out", out], spark) == 2 and cli.main(["index", str(src), "--sln", "a", "--csproj", "b"], spark) == 2
    ask = [{"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}]
    ask += [{"id": 3 + i, "method": "tools/call", "params": {"name": n, "arguments": a}} for i, (n, a) in enumerate([("read_query", {"query": "select count(*) as n from features"}), ("read_query", {"query": "drop table features"}), ("list_tables", {}), ("append_note", {"symbol_name": "Nobody", "text": "x"})])]
    said = io.StringIO()
    server.serve(spark, t, str(tmp_path / "n"), [json.dumps(x) for x in ask], said)
    got = {x["id"]: x["result"] for x in map(json.loads, said.getvalue().splitlines())}
    assert len(got[2]["tools"]) == 6 and got[3]["content"][0]["text"] == "n\n1" and [got[i]["isError"] for i in (3, 4, 5, 6)] == [False, True, False, True]


def test_index_incremental(spark, tmp_path, monkeypatch):
    src, out, seen = tmp_path / "src", str(tmp_path / "out"), []
    src.mkdir()
    (src / "a.cs").write_text("class A { void F() {} }")
    (src / "b.cs").write_text("class B : A { }")
    (src / "c.cs").write_text("class C { }")

    def extracted(files, literals=False):
        rows = files.select("path", "content").collect()
        seen.append(sorted(r.path.rsplit("/", 1)[1] for r in rows))
        got = [(r.path, [], [], "parse: broken") if "BROKEN" in r.content else (r.path, *extract(r.content)) for r in rows]
        return spark.createDataFrame(got, f"path string, symbols array<{csharp.SYMBOL}>, edges array<{csharp.EDGE}>, error string")

    monkeypatch.setattr(index, "extract_files", extracted)
    names = lambda: {r.name for r in index.load(spark, out)["symbols"].collect()}
    index.build(spark, str(src), out)
    assert seen.pop() == ["a.cs", "b.cs", "c.cs"] and names() == {"A", "F", "B", "C"}
    (src / "a.cs").write_text("class A2 { void F() {} }")
    (src / "c.cs").write_text("BROKEN")
    (src / "d.cs").write_text("class D { }")
    (src / "b.cs").unlink()
    index.build(spark, str(src), out)
    assert seen.pop() == ["a.cs", "c.cs", "d.cs"] and names() == {"A2", "F", "B", "C", "D"}
    t = index.load(spark, out)
    assert [r.dst_symbol_id for r in t["edges"].where("edge_type = 'inherits'").collect()] == [None]
    (src / "c.cs").write_text("class C2 { }")
    assert index.build(spark, str(src), out, prune_missing=True)["files"] == 3
    assert seen.pop() == ["c.cs"] and names() == {"A2", "F", "C2", "D"}


def test_sql_guard(spark):
    for bad in ("drop table x", "insert into t values (1)", "with a as (select 1) insert into t select * from a"):
        with pytest.raises(Exception):
            sqlapi.guard(spark, bad)
    sqlapi.guard(spark, "with a as (select 1 as x) select * from a")


def test_like_equals_sqlite(spark):
    words, patterns = ["Abc", "aXc", "a%c", "É", "", "src\\x"], ["%B%", "a_c", "%\\x", "é", "%", "a%c"]
    con = sqlite3.connect(":memory:")
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for p in patterns:
        got = [r[0] for r in df.select(T.like_ascii_ci(F.col("w"), p)).collect()]
        assert got == [bool(con.execute("select ? like ?", (w, p)).fetchone()[0]) for w in words], p


def test_ignore_rules():
    spec = ignore.build_spec("*.tmp.cs\n!keep.tmp.cs\n/only\nlogs/\n")
    hit = lambda p: ignore.is_ignored(spec, p)
    assert hit("a/bin/x.cs") and hit("x.tmp.cs") and not hit("keep.tmp.cs") and hit("only/a.cs") and not hit("b/only/a.cs") and hit("b/logs/a.cs") and not hit("a.cs") and hit(None) and not hit("")


def test_ignore_taken_back(spark):
    """A folder that is taken back keeps what a rule for files ignores; a file that is taken back leaves its folder."""
    spec = ignore.build_spec("*.log.cs\n!kept/\nmade/\n!made/own.cs\n!made\n")
    want = {"kept/a.log.cs": True, "kept/a.cs": False, "made/own.cs": False, "made/x.cs": False, "made/x.log.cs": False, "a.log.cs": True, "bin/kept/a.cs": True, "made": False}
    assert {p: ignore.is_ignored(spec, p) for p in want} == want
    rows = spark.createDataFrame([(p,) for p in want], "path string").select("path", ignore.ignored_column(F.col("path"), spec).alias("hit")).collect()
    assert {r.path: r.hit for r in rows} == want


def test_projects(spark):
    sln = 'Project("{1}") = "App", "src\\App\\App.csproj", "{2}"\nProject("{1}") = "Dir", "Dir", "{3}"'
    got = tree.parse_sln(spark.createDataFrame([("/r/a.sln", sln)], "path string, content string")).collect()
    assert [(r.name, r.path) for r in got] == [("App", "/r/src/App/App.csproj")]
    xml = '<Project xmlns="x"><PropertyGroup><RootNamespace>Acme.App</RootNamespace></PropertyGroup><ItemGroup><ProjectReference Include="..\\Lib\\Lib.csproj"/><PackageReference Include="P"/></ItemGroup></Project>'
    r = tree.parse_csproj(spark.createDataFrame([("/r/src/App/App.csproj", xml)], "path string, content string")).first()
    assert (r.domain, r.project_references, r.package_references, r.name) == ("Acme", ["/r/src/Lib/Lib.csproj"], ["P"], "App")


def test_notes_files(tmp_path):
    p = str(tmp_path / "n.md")
    notes.get_or_create(p, "# A")
    notes.append(p, "first")
    notes.append(p, "second")
    notes.sync(p, "# B")
    assert re.fullmatch(r"# B\n\n## Notes\nfirst\n\nsecond\n", open(p).read())
    with pytest.raises(FileNotFoundError):
        notes.append(str(tmp_path / "absent.md"), "x")
