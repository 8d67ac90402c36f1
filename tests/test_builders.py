import pytest
from pyspark.sql import functions as F

from loomgraph.functions import compact as CP
from loomgraph.functions import languages as L
from loomgraph.functions.parsers import REGISTRY
from loomgraph.operators import ingest as I
from loomgraph.operators import relations as R
from loomgraph.operators import scans as S
from loomgraph.plans.sample_files import FILES

TEXTS = {p: t for p, _, t in FILES}
FS = "id string, path string, kind string, content string, updated_at string"


def _names(path):
    return {c["name"]: c for c in REGISTRY["." + path.rsplit(".", 1)[1]](TEXTS[path])}


@pytest.mark.parametrize("path,names", [
    ("src/app.js", {"start", "finish", "Store", "Store.save", "Store.constructor"}), ("src/helper.ts", {"Options", "helper", "check"}), ("src/main.go", {"Run", "step", "Server"}),
    ("src/lib.rs", {"Point", "Point.new", "check", "run"}), ("src/Main.java", {"Main", "Main.add", "Main.sum"}), ("src/tool.rb", {"run", "Tool", "Tool.step"}), ("src/run.sh", {"hello", "main"}), ("src/util.c", {"add", "twice", "pair"}),
    ("legacy/App/Store.cs", {"ReportSection", "ReportSection.Run", "ReportSection.Save"}), ("legacy/App/Main.vb", {"MainForm", "MainForm.Load", "MainForm.Total"}), ("src/form.frm", {"Form_Load", "Fill"}),
])
def test_chunks_of_languages(path, names):
    assert set(_names(path)) == names


def test_what_chunks_call_import_and_export():
    app = _names("src/app.js")
    assert app["start"]["calls"] == ["finish", "helper"] and app["start"]["imports"] == ["./helper.js", "fs"] and app["start"]["exported"] and app["finish"]["exported"]
    assert app["start"]["description"] == "Starts the whole application." and (app["start"]["start_line"], app["start"]["end_line"]) == (5, 8)
    assert _names("src/util.c")["add"]["exported"] is False and _names("src/main.go")["Run"]["exported"] is True


def test_braces_in_texts_and_comments_count_for_nothing():
    text = 'function a() {\n  const x = "}"; // }\n  return `}`;\n}\nfunction b() { /* { */ }\nfunction c() {'
    got = {c["name"]: (c["start_line"], c["end_line"]) for c in L.code_chunks(text, L.SCRIPT)}
    assert got == {"a": (1, 4), "b": (5, 5), "c": (6, 6)}
    assert list(L.code_chunks("", L.GO)) == [] and list(L.code_chunks("x" * 100_000 + "{" * 50, L.C)) == []


def test_relations_of_odd_files(spark):
    rows = [("f1", "a/x.config", "CODE", '<add name="Db" /><section name="s" type="N.T, A"/><r file="../y.config"/><q configSource="/abs.config"/>', ""), ("f2", "y.config", "CODE", None, ""), ("f3", "a/b.cs", "CODE", 'class T { string s = ConfigurationManager.ConnectionStrings["DB"]; }', ""), ("f4", "a/x.config", "CODE", "", "")]
    f = spark.createDataFrame(rows, FS)
    assert {tuple(r) for r in R.config_includes(f).collect()} == {("f1", "f2", "r:file")}
    assert {(r["from_id"], r["to_id"], r["relation"]) for r in R.uses_files(f).collect()} == {("f3", "f1", "USES_CONFIG")}
    assert {tuple(r) for r in R.section_handlers(f).collect()} == {("f1", "f3", "section_handler:s")}
    none = f.limit(0)
    assert R.embedded_sql(none).count() == R.project_links(none).count() == R.machine_configs(none).count() == R.transforms(none).count() == 0


def test_nearest_machine_config_takes_the_deepest_folder(spark):
    c = "<configuration/>"
    f = spark.createDataFrame([("m0", "machine.config", "CODE", c, ""), ("m1", "a/b/machine.config", "CODE", c, ""), ("m2", "a/machine.config", "CODE", c, ""), ("x", "a/b/c/x.config", "CODE", c, ""), ("y", "z/y.config", "CODE", c, "")], FS)
    got = {r["from_id"]: r["to_id"] for r in R.machine_configs(f).collect()}
    # z/y.config shares no folder with any: the smallest id of all.
    assert got == {"x": "m1", "y": "m0"}


def test_superseded_records_by_number_and_name(spark):
    adr = "id string, path string, title string, body string"
    df = spark.createDataFrame([("adr:adr-1-a", "d/ADR-1-a.md", "First", ""), ("adr:adr-2-b", "d/ADR-2-b.md", "Second", "Supersedes: 1 and supersedes ADR-2-b, ersätter - First"), ("adr:adr-3-c", "d/ADR-3-c.md", "", None)], adr)
    assert {(r["from_id"], r["to_id"]) for r in R.supersedes(df).collect()} == {("adr:adr-2-b", "adr:adr-1-a")}


def test_relations_go_by_kind_with_a_file(spark):
    ch = spark.createDataFrame([("c1", "f1"), ("c2", "f2")], "id string, file_id string")
    rel = spark.createDataFrame([("c1", "c2", "CALLS"), ("c2", "c1", "CALLS"), ("c2", "f1", "IMPORTS"), ("c1", "f2", "IMPORTS"), ("f1", "c1", "DEFINES"), ("f2", "c2", "DEFINES"), ("r", "f1", "CONSTRAINS"), ("f1", "c2", "CALLS_SQL")], "from_id string, to_id string, relation string")
    kept = {tuple(r) for r in I.drop_files(ch, rel, spark.createDataFrame([("f1",)], "id string"))[1].select("from_id", "to_id", "relation").collect()}
    assert kept == {("c2", "f1", "IMPORTS"), ("f2", "c2", "DEFINES"), ("r", "f1", "CONSTRAINS")}
    assert {tuple(r) for r in I.hydrate(spark.createDataFrame([("f2",)], "id string"), ch, rel).select("from_id", "to_id", "relation").collect()} == {("f2", "c2", "DEFINES")}


def test_mentions_of_rules_of_any_form(spark):
    f = spark.createDataFrame([("f1", "a.md", "DOC", "see rule:no-direct-sql here"), ("f2", "b.md", "DOC", "xrule:no-direct-sqlx"), ("f3", "c.md", "DOC", "about abcx"), ("f4", "d.md", "DOC", None)], "id string, path string, kind string, content string")
    r = spark.createDataFrame([("rule:no-direct-sql", ""), ("abc", "")], "id string, body string")
    assert {(x["rule_id"], x["file_id"]) for x in I.keyword_rules(f, r).where("how = 'mention'").collect()} == {("rule:no-direct-sql", "f1"), ("rule:no-direct-sql", "f2"), ("abc", "f3")}


def test_secrets_in_the_midst_of_files(spark):
    df = spark.createDataFrame([("a.env", "user=x\nPASSWORD=hunter22\nother=1"), ("deploy/.env.production", "X=1\npwd=longenough;"), ("appsettings.Dev.json", '{"password": "abcdefgh"}\n'), ("x.bin", "password=abcdefgh"), ("b.py", "a\0b\npassword=abcdefgh"), ("c.md", "^TODO\nx")], "path string, t string")
    assert {(r["path"], r["line_no"]) for r in S.secret_hits(df, "path", "t").collect()} == {("a.env", 2), ("deploy/.env.production", 2)}
    lines = spark.createDataFrame([("a", "a\nTODO x\nb TODO")], "path string, t string")
    assert [r["line_no"] for r in S.policy_hits(lines, "path", "t", "^TODO").collect()] == [2] and [r["line_no"] for r in S.context_lines(lines, "path", "t", "^TODO").collect()] == [2]
    assert S.policy_detail(S.policy_hits(lines, "path", "t", "TODO"), "path").first()["detail"] == "a:2\na:3"


def test_compaction_keeps_head_signals_and_tail(spark):
    body = "\n".join(["x = 1"] * 9000 + ["export function y() {"] + ["z = 2"] * 9000)
    text, cut, n, kept, lost = CP.compact_file("p.js", "e", body)
    assert cut and kept == len(text) < n == kept + lost and "export function y" in text and text.startswith("p.js\ne\nx = 1") and text.endswith("z = 2")
    assert CP.compact_file("p", "", "short") == ("p\n\nshort", False, 8, 8, 0)
    assert CP.cut_to_tokens("abcd efgh ", 1) == "abcd" and CP.cut_to_tokens("abc", 0) == "abc" and len(CP.signal_lines("import " + "x" * 9000)) < 700
    df = spark.createDataFrame([("a", "x" * 100), ("b", None)], "id string, t string")
    assert {(r["id"], None if r["t"] is None else len(r["t"]), r["cut"]) for r in CP.truncated(df, "id", "t", 10).collect()} == {("a", 40, True), ("b", None, False)}


def test_descriptions_of_chunks(spark):
    df = spark.createDataFrame([("function", True, "f()", "", "/** Does a thing well. */\nfunction f() {}"), ("method", False, "g()", "a longer description", "x")], "kind string, exported boolean, signature string, description string, body string")
    got = [r[0] for r in df.select(CP.description(*[F.col(c) for c in df.columns])).collect()]
    assert got == ["function. exported. f(). Does a thing well..", "method. g(). a longer description."]
