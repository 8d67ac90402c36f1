"""Ordinary valid code of every language, none of which may be taken for broken, and planted breaks, which must be."""

import pytest

from loomgraph.llm.syntax import repair_cost

SNIPPETS = {
    "javascript": r'''const a = 1
let b = a + 2
function f(x) {
  return x
}
f(a)
---
class A { static x = 1; static { A.x = 2; } #p = 3; get v() { return this.#p; } }
---
const t = `a ${`b ${c}` } d`;
---
const {a, b: {c}, ...r} = o; const [x, , y = 2] = z;
---
export default async function* g() { yield* h(); for await (const x of y) { await x; } }
---
label: for (let i = 0; i < 3; i++) { if (i) continue label; }
---
const f = async ({a, b}) => ({...a, [b]: 1, get c() { return 1 }, async *d() {}});
---
x ??= y?.z?.[0]?.(1) ?? 2 ** 3;
---
import a, {b as c, default as d} from "x"; import * as e from 'y'; export * from "z"; export * as q from "w"; export {a as default};
---
if (a) b(); else if (c) { d() } else e();
---
do { x++ } while (x < 5);
---
switch (a) { case 1: case 2: { b(); break; } default: c() }
---
try { a() } catch { b() } finally { c() }
---
const r = /ab[/]c/gi.test(s) ? a : b;
---
var f = function () { return new.target };
---
(function () { 'use strict' })();
---
(async () => { await import('./x.js') })()
---
const a = b
  .map(x => x * 2)
  .filter(Boolean)
---
export const x = 1, y = 2
export function z() {}
---
const o = { a, b, c() {}, 'd-e': 1, 5: 2, async f() {}, get [k]() { return 1 } }
---
for (const k in o) if (has(o, k)) delete o[k];
---
throw new Error(`bad ${x}`);
---
while (true) { break }
---
return_ = a ? b ? 1 : 2 : 3;
---
let x = (1, 2), y = void 0, z = typeof a === 'b';
---
class B extends (mix(A)) { constructor() { super(...arguments); super.f(); } static async *g() {} }
---
a = b ? function () {} : class {};
---
var x = a / b / c;
---
const big = 10n, n = 1_000, h = 0xff, e = 1e-5;
---
if (!(a in b) || !(c instanceof D)) {}
''',
    "typescript": r'''type M<T> = { [K in keyof T]?: T[K] };
---
type F = (a: string, b?: number) => void;
---
type T = [string, number, ...boolean[]];
---
const c = { a: 1 } satisfies Config;
---
@Component({ selector: 'a' })
export class A { @Input() x: string = ''; constructor(private readonly s: S) {} }
---
function isS(x: unknown): x is string { return typeof x === 'string'; }
---
type C<T> = T extends (infer U)[] ? U : never;
---
interface I extends J, K<string> { readonly a: number; b?(x: number): void; [key: string]: any; (x: number): string; new (x: string): I; }
---
abstract class A<T extends object = {}> implements B<T> { protected abstract f(): void; static readonly x: Map<string, number> = new Map(); declare y: number; }
---
enum E { A = 1, B = A << 1, C = 'c' }
---
declare module 'x' { export function f(a: number): string; }
---
declare global { interface Window { a: string } }
---
export type { A } from './a'; import type { B } from './b'; import { type C, D } from './c';
---
function f<T, K extends keyof T>(o: T, k: K): T[K] { return o[k]; }
---
function g(a: string): string;
function g(a: number): number;
function g(a: any) { return a; }
---
const x = y as unknown as Z<number>[]; const n = x!.a!.b;
---
let u: string | null | undefined = null; let v: 'a' | 'b' = 'a'; let w: readonly string[] = [];
---
const f = <T,>(x: T): T => x;
---
type P = Partial<Record<keyof A, Array<{ a: string; b: number }>>>;
---
namespace N.M { export const x = 1 }
---
export const enum X { A, B }
---
type G = typeof x; type H = A['b']; type L = `${string}-a`;
---
class A { private x?: number; get y(): number { return this.x ?? 0 } set y(v: number) { this.x = v } async *z(): AsyncGenerator<number> { yield 1 } }
---
export default interface Foo { a: string }
---
const a = (b: number, ...c: string[]): void => {};
---
function assertX(v: any): asserts v is X {}
---
let t: [a: string, b?: number];
---
export abstract class R { abstract get x(): string; constructor(public a = 1, protected b?: string) { super() } }
---
const m = new Map<string, { a: number }>();
---
type U = | 'a' | 'b';
---
import fs = require('fs'); export = x;
---
for (const [k, v] of Object.entries(o) as [string, number][]) {}
---
let fn: (x: number) => (y: string) => boolean;
---
type D = { a: string, b: number } & E;
''',
    "csharp": r'''class A<T> : B where T : class, new() { }
---
class A { void F() { try { G(); } catch (E e) when (e.X > 1) { } } }
---
class A { public int this[int i] { get => x[i]; set { x[i] = value; } } }
---
class A { public static A operator +(A a, A b) => new A(); public static implicit operator int(A a) => 1; }
---
class A { void F() { var q = from x in xs where x > 1 orderby x descending select new { x, y = x * 2 }; } }
---
class A { string F(object o) => o switch { int i when i > 0 => "a", string { Length: > 3 } s => s, null => "n", _ => "d" }; }
---
namespace A.B;
public record P(int X, int Y) { public int Z { get; init; } = 1; }
---
class A { event EventHandler<X> E; public delegate void D(int a, ref string b); }
---
using System; using static System.Math; using X = System.Text; namespace A { internal sealed class B : C, ID<int> { } }
---
class A { int? x; List<Dictionary<string, int[]>> y = new(); (int a, string b) T() => (1, "a"); }
---
class A { async Task<int> F(CancellationToken t = default) { await foreach (var x in Y()) { yield return x; } return await G().ConfigureAwait(false); } }
---
class A { void F() { if (x is not null && y is int z) { } lock (o) { } using var s = G(); unsafe { } checked { } } }
---
[Serializable, Obsolete("x")] public class A { [Key] public int Id { get; set; } [return: X] void F([In] int a) { } }
---
interface I<in T, out U> where T : struct { U F(T x); int P { get; } }
---
class A { ~A() { } static A() { } public A() : base(1) { } public A(int x) : this() { } }
---
enum E : byte { A = 1, B = 1 << 2, [X] C }
---
class A { void F() { for (int i = 0, j = 1; i < 3; i++, j--) { goto end; } end: return; } }
---
class A { void F() { Func<int, int> f = x => x + 1; Action g = () => { }; var h = delegate (int x) { return x; }; int L(int a) => a; } }
---
class A { string s = $"a {x:N2} {(y ? "b" : "c")}"; string v = @"c:\x"; string r = "q"; char c = '\n'; }
---
class A { void F() { var (a, b) = T(); (a, b) = (b, a); int[] x = { 1, 2 }; var y = new[] { 1 }; var z = x[1..^1]; x?[0]?.F(); a ??= b; } }
---
class A { int F() => throw new X(); int P => _p ??= G(); }
---
struct S { public readonly int X; public const double Y = 1.5e3; fixed byte b[3]; }
---
class A { void F() { switch (x) { case 1: case 2 when y: break; case int n: return; default: throw; } do { } while (true); } }
---
public abstract partial class A { protected abstract void F(); partial void G(); public virtual int H<T>(T x) where T : IFoo => 1; }
---
class A { void F() { foreach (var (k, v) in d) { } var o = new B { X = 1, Y = { 2 }, ["a"] = 3 }; var c = (T)x; var t = typeof(List<>); var n = nameof(A.B); } }
---
var x = 1; Console.WriteLine(x);
---
class A { public required string N { get; set; } public static readonly A I = new() { N = "x" }; }
---
#region X
class A { }
#endregion
---
class A { void F(in int a, out int b, params string[] c) { b = default(int); int.TryParse("1", out var d); stackalloc_(); } }
---
class A { IEnumerable<int> F() { yield return 1; yield break; } bool B => a < b && c > d; int C => a ? b : c; }
''',
    "sql": r'''WITH c AS (SELECT a FROM t WHERE b = 1), d (x) AS (SELECT 1) SELECT * FROM c JOIN d ON c.a = d.x;
---
MERGE INTO t AS x USING s AS y ON x.id = y.id WHEN MATCHED THEN UPDATE SET x.a = y.a WHEN NOT MATCHED THEN INSERT (id, a) VALUES (y.id, y.a) WHEN NOT MATCHED BY SOURCE THEN DELETE;
---
CREATE TABLE t (id INT NOT NULL DEFAULT 0, n NVARCHAR(50) DEFAULT 'x', c DATETIME DEFAULT GETDATE(), PRIMARY KEY (id));
---
SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b DESC) AS r, SUM(x) OVER (ORDER BY y ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) FROM t;
---
BEGIN TRY SELECT 1/0; END TRY BEGIN CATCH THROW; END CATCH
---
DECLARE @a INT = 1, @b VARCHAR(10); SET @a = (SELECT MAX(id) FROM t); IF @a > 1 BEGIN PRINT 'x' END ELSE PRINT 'y';
---
SELECT CASE WHEN a = 1 THEN 'x' WHEN a IN (2,3) THEN 'y' ELSE NULL END AS c, COUNT(*) FROM t GROUP BY a HAVING COUNT(*) > 1 ORDER BY c OFFSET 10 ROWS FETCH NEXT 5 ROWS ONLY;
---
INSERT INTO t (a, b) OUTPUT inserted.id SELECT a, b FROM s WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.a = s.a);
---
UPDATE x SET x.a = y.b FROM t x INNER JOIN s y ON x.id = y.id WHERE y.c IS NOT NULL;
---
DELETE FROM t WHERE id IN (SELECT id FROM s) AND a LIKE '%x%' ESCAPE '!';
---
ALTER TABLE t ADD c INT NULL; ALTER TABLE t ADD CONSTRAINT k FOREIGN KEY (a) REFERENCES s (b) ON DELETE CASCADE; ALTER TABLE t DROP COLUMN c;
---
CREATE OR ALTER PROCEDURE p @a INT, @b INT = 2 OUTPUT AS BEGIN SET NOCOUNT ON; RETURN 0; END
---
CREATE FUNCTION f (@a INT) RETURNS TABLE AS RETURN (SELECT @a AS x);
---
CREATE INDEX i ON t (a ASC, b DESC) INCLUDE (c) WHERE d = 1;
---
WHILE @i < 10 BEGIN SET @i += 1; IF @i = 5 CONTINUE; BREAK; END
---
SELECT TOP (10) a.*, b.[x y] FROM dbo.t AS a WITH (NOLOCK) LEFT OUTER JOIN s b ON a.id = b.id CROSS APPLY f(a.id) z;
---
SELECT a, CAST(b AS INT), CONVERT(VARCHAR(10), c, 120), COALESCE(d, 'x') FROM t UNION ALL SELECT 1, 2, 3, 4 EXCEPT SELECT 5, 6, 7, 8;
---
DROP TABLE IF EXISTS t; CREATE VIEW v AS SELECT 1 AS a; GO
---
SELECT * FROM (VALUES (1, 'a'), (2, 'b')) AS v(x, y) WHERE x BETWEEN 1 AND 2;
---
CREATE TRIGGER tr ON t AFTER INSERT, UPDATE AS BEGIN SELECT 1; END
---
BEGIN TRANSACTION; COMMIT TRANSACTION; ROLLBACK TRAN;
---
SELECT STRING_AGG(a, ',') WITHIN GROUP (ORDER BY a), a COLLATE Latin1_General_CI_AS FROM t FOR JSON PATH;
---
INSERT INTO t VALUES (1, N'x'), (2, NULL); EXEC sp_x @a = 1, @b OUTPUT; GRANT SELECT ON t TO u;
---
DECLARE c CURSOR FOR SELECT a FROM t; OPEN c; FETCH NEXT FROM c INTO @a; CLOSE c; DEALLOCATE c;
---
CREATE TABLE #t (a INT IDENTITY(1,1) PRIMARY KEY CLUSTERED, b AS a * 2, CONSTRAINT ck CHECK (a > 0), UNIQUE (b)); TRUNCATE TABLE #t;
''',
    "vbnet": r'''Imports System
Namespace A
    Public Class B(Of T)
        Inherits C
        Implements D, E
        Private ReadOnly x As New List(Of Integer) From {1, 2}
        Public Property P As Integer = 1
        Public Sub New(a As Integer)
            MyBase.New(a)
        End Sub
        Public Async Function F(Optional a As Integer = 1) As Task(Of Integer)
            Dim q = From y In x Where y > 1 Order By y Select y
            Dim g = Function(z) z + 1
            Await H()
            If a = 1 Then Return 1 Else Return 2
            For i As Integer = 0 To 5 Step 2
                Continue For
            Next
            For Each k In x
                Console.WriteLine($"a {k}")
            Next k
            Select Case a
                Case 1, 2
                    Exit Select
                Case Is > 3
                    Throw New Exception("x")
                Case Else
            End Select
            Using s As New Z()
            End Using
            Try
                a += 1
            Catch ex As Exception When a > 1
            Finally
            End Try
            Do While a < 3
                a = a + 1
            Loop
            With s
                .X = 1
            End With
            Return If(a > 1, 2, 3)
        End Function
        Public Overrides ReadOnly Property Q As String
            Get
                Return "x"
            End Get
        End Property
        <Obsolete("x")>
        Public Shared Operator +(a As B, b As B) As B
            Return a
        End Operator
        Public Event Ev As EventHandler
        Public Delegate Sub Dl(a As Integer)
    End Class
End Namespace
---
Module M
    Sub Main(args() As String)
        Dim a(5) As Integer, b As String = "x"
        Dim h = Sub(x As Integer)
                    Console.WriteLine(x)
                End Sub
        Dim o = New With {.A = 1, .B = 2}
        Dim d As New Dictionary(Of String, Integer) From {{"a", 1}}
        AddHandler x.Y, AddressOf Z
        ReDim Preserve a(10)
        While True
            Exit While
        End While
        If TypeOf o Is String AndAlso Not x Then
            GoTo done
        ElseIf x Then
        End If
done:
        Dim s = CType(o, String) & vbCrLf
        On Error Resume Next
    End Sub
End Module
---
#If DEBUG Then
Public Interface I
    Function F(a As Integer) As Integer
    ReadOnly Property P As String
    Sub S()
End Interface
#End If
Public Enum E
    A = 1
    B
End Enum
Public Structure St
    Public X As Integer
End Structure
''',
}
CASES = [(lang, s) for lang, text in SNIPPETS.items() for s in text.split("---\n")]


@pytest.mark.parametrize("lang,text", CASES)
def test_valid_code_needs_no_repair(lang, text):
    assert repair_cost(lang, text) == 0


@pytest.mark.parametrize("lang,text", CASES)
def test_a_lost_last_bracket_is_found(lang, text):
    at = max(text.rfind(c) for c in ")]}")
    if at >= 0 and text[at:].strip("; \n") and "'" not in text and '"' not in text and "`" not in text:
        assert repair_cost(lang, text[:at] + text[at + 1 :]) > 0


@pytest.mark.parametrize("lang,text", [
    ("javascript", "const a = \n+ ;"), ("javascript", "let x = {a: 1\n b: 2};"), ("javascript", "if (a b) c();"), ("javascript", "function f( { }"), ("typescript", "type A = { a: ; };"), ("typescript", "let x: = 1;"),
    ("csharp", "class A { void F( { } }"), ("csharp", "class A { int x = ; }"), ("csharp", "class A { void F() { if x > 1 { } } }"), ("sql", "SELECT FROM WHERE"), ("sql", "INSERT INTO t (a, b VALUES (1, 2);"), ("sql", "SELECT a FROM t WHERE"),
    ("vbnet", "Sub A()\n If x Then\nEnd Sub\n"), ("python", "def f(:\n  pass"), ("config", "<a><b></a>"),
])
def test_breaks_are_found(lang, text):
    assert repair_cost(lang, text) > 0
