import pytest

from loomgraph.llm import handwritten, privacy, syntax

VALID = {
    "javascript": ["", "// only a comment", "const a = b ? c.d : `x${y}`;\nif (/^[a]+\\(1/.test(x)) f();", "!function(){var a=b||{c:1};for(var i=0;i<n;i++)f(i)}();",
                   "export async function f({a, b: [c]}, ...rest) { try { await g(); } catch (e) { throw e; } finally { h(); } }", "const s = `\n<<<<<<< ours\n=======\n>>>>>>> b\n`;",
                   "class A extends B { static x = 1; get y() { return this.x; } async *z() {} }", "a.b = (x) => ({ k: x, ...y }); label: for (;;) { break label; }"],
    "typescript": ["import { a, type B } from './c';\nlet x: Array<Map<string, number>> = y ?? [];\nexport interface I { a?: string | null; b: number; }", "const q = (z as T).m<U>(1);\nfunction f(a: string[]): void { }", "type A = B | C;\nenum E { X, Y = 2 }"],
    "csharp": ["using System;\nnamespace A.B { public class C : D<int> { [E(1)] public long F { get; set; } public async Task<int> G(string a, int? b = 1) { foreach (var i in a) { H(i); } return a.Where(x => x.Y >= 1).ToList(); } } }",
               "static class C { static readonly int[] X =\n{\n 1, 2, 0x1F,\n}; char c = x == 1 ? '{' : '('; string s = $\"{a.b}/c\"; string v = @\"a\n<<<<<<< ours\n\"; }"],
    "vbnet": ["Imports System\nPublic Class A\n Public Function B(c As String) As Integer\n  Dim d As New E(1)\n  If d Is Nothing Then\n   d.F += 3 * g.H\n  End If\n  For Each i In j.K(l)\n  Next\n  ' >>>>>>> no\n  Return If(a Is Nothing, \"\"\"x\"\" y\", 2)\n End Function\nEnd Class"],
    "sql": ["SET NOCOUNT ON;\nGO\nCREATE OR ALTER PROCEDURE [dbo].[A]\n @b INT = 1\nAS\nBEGIN\n IF EXISTS (SELECT 1 FROM dbo.C WHERE d = 1)\n BEGIN\n  SELECT CASE WHEN e > 1 THEN 'it''s' ELSE 'f' END AS g FROM dbo.H;\n END\n WHILE @b < 5\n BEGIN\n  SET @b = @b + 1;\n END\n RETURN 3;\nEND\nGO"],
    "python": ["import a\nfrom b.c import D, e\n\nasync def f(x, *, y=None) -> Z:\n    with a.b(1) as c:\n        return [i.j for i in k if i]\n", "x = {'a': b, **c}\nassert x >= 1, 'm'\ny = lambda a, b=1: a if b else None\n"],
    "config": ["<?xml version=\"1.0\"?>\n<a><!-- > ) --><b c=\"d\" /></a>"],
}
BROKEN = {
    "javascript": ["const a = ;", "function f( { ", "let x: number = 1;", "a\n<<<<<<< HEAD\nb();\n=======\nc();\n>>>>>>> x\n", "def f(x):\n    return x\n", "if (x) { y(; }", "const s = 'open"],
    "typescript": ["export function f(a: string { }", "class A { m() { }", "Imports System\nPublic Class A\nEnd Class"],
    "csharp": ["public class A { void B() { int x = ; } }", "namespace A { class B { ", "using System;\n}\n", "Dim x As Integer = 1"],
    "vbnet": ["Public Class A\n Public Sub B()\nEnd Class", "using System;\nclass A { }", "Dim x As"],
    "sql": ["CREATE PROCEDURE a AS BEGIN SELECT 1 FROM b;", "SELECT FROM WHERE;", "public class A { }", "UPDATE t SET"],
    "python": ["def f(:\n    pass", "def f():\nx = 1", "x = (1", "  y = 1\n z = 2"],
    "config": ["<a><b></a>", "<a", "<a/>\n<<<<<<< x", "SET NOCOUNT ON;"],
}


@pytest.mark.parametrize("lang", sorted(VALID))
def test_valid_and_broken(lang):
    assert [t for t in VALID[lang] if syntax.repair_cost(lang, t)] == []
    assert [t for t in BROKEN[lang] if not syntax.repair_cost(lang, t)] == []
    assert syntax.repair_cost(lang, None) == 0 and syntax.repair_cost(lang, " \n") == 0 and syntax.repair_cost(None, "x(") == 0


def test_costs_are_small_for_small_damage():
    assert syntax.repair_cost("csharp", "class A { void B() { f(1) } }") == 1
    assert syntax.repair_cost("javascript", "function f() { g(); ") <= 3
    assert syntax.cause("javascript", "const a = 1;\nfunction f() {\n  g(", syntax.repair_cost("javascript", "const a = 1;\nfunction f() {\n  g(")) == "truncated"


def test_broken_files_frame(spark):
    rows = [(1, "python", "a", "x = (1"), (2, "python", "a", "x = 1"), (3, None, None, "x ("), (4, "sql", "a", None), (1, "python", "a", "x = (1")]
    got = syntax.broken_files(spark.createDataFrame(rows, "doc_id long, lang string, source string, text string")).collect()
    assert [r["doc_id"] for r in got] == [1, 1]


def test_notices_count_only_at_the_head():
    assert handwritten.head_notice("// <auto-generated>\nx")[0] == "generated"
    assert handwritten.head_notice("# Vendored from x 1.2, upstream commit a\nx")[0] == "vendored"
    assert handwritten.head_notice("/*! a v1.2.3 | (c) a | MIT */\nx")[0] == "vendored"
    assert handwritten.head_notice("// Do not route a lazy lens from x\ny")[0] == ""
    assert handwritten.head_notice("x = 1\n// Code generated by y. DO NOT EDIT.")[0] == ""
    assert handwritten.head_notice("// keys are auto-generated by the x\n")[0] == ""
    assert handwritten.literal_share(["a = [", "  1, 2, 3,", "  0x1F, 4,", " 'x',", "  5, 6, 7, 8, 9, 10,", "]"]) > 0.8


def test_forest_finds_files_without_a_notice(spark):
    import random
    rnd = random.Random(5)
    name = lambda: "".join(rnd.choice("abcdefgh") for _ in range(7))
    hand = lambda: "\n".join(rnd.choice([f"def {name()}({name()}):", f"    # {name()} {name()}", f"    {name()} = {name()}.{name()}({rnd.randrange(99)})", f"    if {name()} > 2:", f"        return {name()}"]) for _ in range(40))
    made = lambda: "\n".join(f"_X{i} = _make(name='{name()}', number={i}, kind=3)" for i in range(40))
    rows = [(i, f"src/a{i}.py", hand()) for i in range(120)] + [(200 + i, f"src/b{i}.py", ("# Code generated by x. DO NOT EDIT.\n" if i % 2 else "") + made()) for i in range(40)]
    rows += [(300, "vendor/x/a.py", hand()), (301, "src/e.py", ""), (302, None, None)]
    got = {r["doc_id"]: r["by_hand"] for r in handwritten.classify(spark.createDataFrame(rows, "doc_id long, path string, text string")).collect()}
    assert sum(got[i] for i in range(120)) >= 118 and sum(not got[200 + i] for i in range(40)) >= 39
    assert not got[300] and got[301] and got[302]
    assert handwritten.classify(spark.createDataFrame(rows[:5], "doc_id long, path string, text string")).where("by_hand").count() == 5


def test_written_forms():
    text = ("Mail a.b+c@x-y.example or d_e (at) f [dot] g [dot] test, h AT i DOT test; git@forge.x.test:team/x.git; pkg@1.2.3; noreply@x.test. Call +1-279-555-0141, (835) 555-0175, 388.555.0189, "
            "07700 900559, 070-174 06 11, 030/23125882, 0049-30-23125-752, +46 70 174 06 07. Release 42.555.028, 2024-03-15 07:21:10. Ids 666-24-4673, 666 40 1805, QQ 54 46 58 A, QQ246066B, 18720501-6426; "
            "Build 20240915-0552. At 760 Saltmarsh Court, Lindenackerweg 51b, Am Kranichufer 44, Björkhagsvägen 64 B. The Mill Lane cluster listens on port 62.")
    got = {}
    for s, e, k in privacy.structured(text):
        got.setdefault(k, []).append(text[s:e])
    assert got["EMAIL"] == ["a.b+c@x-y.example", "d_e (at) f [dot] g [dot] test", "h AT i DOT test"]
    assert got["PHONE"] == ["+1-279-555-0141", "(835) 555-0175", "388.555.0189", "07700 900559", "070-174 06 11", "030/23125882", "0049-30-23125-752", "+46 70 174 06 07"]
    assert got["ID_NUMBER"] == ["666-24-4673", "666 40 1805", "QQ 54 46 58 A", "QQ246066B", "18720501-6426"]
    assert got["ADDRESS"] == ["760 Saltmarsh Court", "Lindenackerweg 51b", "Am Kranichufer 44", "Björkhagsvägen 64 B"]


def test_names_by_cooccurrence(spark):
    given, family = ["Anna", "Bertil", "Carla", "David"], ["Lindqvarn", "Osmund", "Tjell", "Vexley-Holm"]
    rows = []
    for i in range(64):
        g, f = given[i % 4], family[i // 4 % 4]
        form = [f"Owner: {g} {f} <a{i}@x.test>", f"Customer {f}, {g} lives at {i + 1} Mill Road and called.", f"Reported by {g} K. {f.upper() if i % 8 else f}, reachable at 388.555.0189."][i % 3]
        rows.append((i, f"Some plain text here.\n{form}\n" + "filler words " * 60 + "\nSee the Graph Loader guide."))
    rows += [(100, "Deciders: Anna Tjell; David Osmund\n" + "filler " * 50), (101, "Ask the Graph Loader. Context Reload is new."), (102, None), (103, "")]
    out = {r["doc_id"]: r for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    names = [s["found_text"] for s in out[100]["spans"]]
    assert names == ["Anna Tjell", "David Osmund"] and out[100]["redacted"].startswith("Deciders: [NAME]; [NAME]\nfiller")
    assert 101 not in out and 102 not in out
    assert [s["found_text"] for s in out[1]["spans"] if s["pii_type"] == "NAME"] == ["Lindqvarn, Bertil"]
    same = {r["doc_id"]: r["redacted"] for r in privacy.sanitise(spark.createDataFrame(rows, "doc_id long, text string"), max_broadcast_terms=0).collect()}
    assert same == {k: v["redacted"] for k, v in out.items()}
