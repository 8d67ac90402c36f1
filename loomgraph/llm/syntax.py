"""Grammars of the languages of a corpus, and source files that do not parse in theirs."""

from __future__ import annotations

import ast
import re
from functools import cache, lru_cache
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame

from . import wider
from .repair import Bracketed, Folds, Grammar

# Symbols: i name, n number, s string, d dot, k comma, = assignment, o operator, m plus or minus, ! not,
# p increment, A arrow, h question mark, x star, u bar, e ellipsis, @ at, X what is no token;
# P group of values, Q group of declarations, B index or list, O object, K block, U empty braces.
# Keywords are written <so> and get a character each.
_KEYWORDS: dict[str, str] = {}


def _kw(word: str) -> str:
    return _KEYWORDS.setdefault(word, chr(0xE000 + len(_KEYWORDS)))


def _g(pattern: str, **parts: str) -> str:
    for name, value in parts.items():
        pattern = pattern.replace("{" + name + "}", "(" + value + ")")
    return re.sub(r"<([A-Za-z]+)>", lambda m: _kw(m.group(1)), re.sub(r"\s+", "", pattern))


def _list(item: str, empty: bool = True) -> str:
    return f"(({item})(k({item}))*k?)" + ("?" if empty else "")


# Operators by symbol.
_OPS = {
    "d": ". ?. ::", "k": ",", ";": ";", ":": ":", "=": "= += -= *= /= %= &= |= ^= <<= >>= ??= &&= ||= **= //=", "m": "+ -",
    "!": "! ~", "p": "++ --", "A": "=>", "h": "?", "<": "<", ">": ">", "x": "*", "u": "|", "e": "...", "@": "@", "R": "->", "W": ":=",
    "o": "== === != !== <= >= && || ?? & ^ / % ** << // <>",
}
_SYMBOL = {op: s for s, ops in _OPS.items() for op in ops.split()} | {c: c for c in "()[]{}"}
_PUNCT = r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|\?\?=|&&=|\|\|=|//=|=>|->|:=|\?\.(?!\d)|==|!=|<=|>=|&&|\|\||\?\?|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|<>|\*\*|::|[-+*/%&|^!~?:;,.<>=@(){}\[\]]"
_NUMBER = r"0[xX][\da-fA-F_]+[nuUlL]*|0[bB][01_]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[a-zA-Z]{0,3}"
_REGEX = r"/(?![/*])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*"
_BLOCK = r"/\*(?:[^*]|\*(?!/))*\*/"

_C_TOKENS = rf"(?P<skip>\s+|//[^\n\r]*|{_BLOCK}|^\#!?[^\n]*)"
# Words that are keywords only before another word, a text or an opening bracket.
_LATER = r"(?:from|of|as|get|set|static|async|type|interface|enum|namespace|declare|readonly|public|private|protected|abstract|implements|keyof|is|when|where|record|partial|yield|params|delegate|event|with|not)"
_JS_LEXER = re.compile(
    rf"{_C_TOKENS}|(?P<re>[(,=:\[!&|?{{}};]\s*{_REGEX})|(?P<s>\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'|`(?:\\[\s\S]|[^`\\])*`)"
    rf"|(?P<n>{_NUMBER})|(?P<i>[^\W\d][\w$]*|[$#][\w$]*)|(?P<o>{_PUNCT})|(?P<X>.)", re.M)
_CS_LEXER = re.compile(
    rf"{_C_TOKENS}|(?P<re>\Z(?!\Z))|(?P<s>(?:\$@|@\$|@)\"(?:[^\"]|\"\")*\"|\$?\"(?:\\.|[^\"\\\n])*\"|'(?:\\.[^'\n]*|[^'\\\n])')"
    rf"|(?P<n>{_NUMBER})|(?P<i>@?[^\W\d]\w*)|(?P<o>{_PUNCT})|(?P<X>.)", re.M)
_SQL_LEXER = re.compile(
    rf"(?P<skip>\s+|--[^\n\r]*|{_BLOCK})|(?P<re>\Z(?!\Z))|(?P<s>N?'(?:[^']|'')*')|(?P<n>{_NUMBER})"
    rf"|(?P<i>\[[^\]\n]+\]|\"[^\"\n]+\"|[@\#]{{1,2}}\w[\w$\#]*|[^\W\d][\w$\#@]*)|(?P<o>{_PUNCT})|(?P<X>.)", re.M)
_PY_LEXER = re.compile(
    rf"(?P<skip>[ \t\f]+|\#[^\n\r]*|\\\r?\n)|(?P<re>\r\n|\n|\r)|(?P<s>[rRbBuUfF]{{0,2}}(?:\"\"\"(?:\\[\s\S]|[^\\])*?\"\"\"|'''(?:\\[\s\S]|[^\\])*?'''|\"(?:\\(?:\r\n|[\s\S])|[^\"\\\n])*\"|'(?:\\(?:\r\n|[\s\S])|[^'\\\n])*'))"
    rf"|(?P<n>{_NUMBER})|(?P<i>[^\W\d]\w*)|(?P<o>{_PUNCT})|(?P<X>.)", re.M)
_VB_LEXER = re.compile(
    rf"(?P<skip>[ \t\f]+|'[^\n\r]*|\bREM\b[^\n\r]*|[ \t]_[ \t]*(?:\r\n|\n|\r))|(?P<re>\r\n|\n|\r)|(?P<s>\$?\"(?:[^\"\n]|\"\")*\"c?|\#[^\#\n]*\d[^\#\n]*\#)"
    rf"|(?P<n>&[hH][\da-fA-F]+|{_NUMBER})|(?P<i>\[\w+\]|[^\W\d]\w*)|(?P<o>{_PUNCT})|(?P<X>.)", re.M | re.I)


def _words(text: str) -> dict[str, str]:
    return {w: _kw(w) for w in text.split()}


# Keywords.
_JS_WORDS = _words("""import export default from const let var function async await return if else for while do try catch finally throw
    new class extends switch case break continue of in instanceof typeof void delete yield static get set as""")
_TS_WORDS = _JS_WORDS | _words("type interface enum namespace declare readonly public private protected abstract implements keyof is")
_CS_WORDS = _words("""using namespace class struct interface enum record public private protected internal static readonly const async await
    abstract sealed override virtual partial extern new return if else for foreach while do try catch finally throw switch case default
    break continue in is as typeof get set lock when where out ref params void yield this event delegate operator unsafe volatile with not""")
_PY_WORDS = _words("""import from as def class return if elif else for while try except finally with raise pass break continue lambda not and or
    in is assert del global nonlocal yield async await""")
_VB_WORDS = {w.lower(): _kw("VB" + w) for w in """Imports Public Private Protected Friend Shared Overrides Overridable Partial Class Module Namespace
    Structure Interface Enum End Sub Function Property Dim As New If Then Else ElseIf For Each In To Step Next Return Try Catch Finally Throw
    While Do Loop Until Using With Select Case Exit Continue Call Not And Or AndAlso OrElse Is IsNot Like Mod Xor Of ByVal ByRef Optional
    WithEvents Const ReadOnly Inherits Implements Nothing Handles Set Get Let Option Static Async Await AddHandler RemoveHandler AddressOf
    SyncLock Wend ParamArray When Default Overloads Shadows MustOverride MustInherit NotInheritable Delegate Event RaiseEvent ReDim Preserve Yield GoTo""".split()}
_SQL_WORDS = {w.lower(): _kw("SQL" + w) for w in """Select From Where Insert Into Values Update Set Delete Exec Execute Create Or Alter Procedure Proc View
    Function Table Trigger As Begin End Case When Then Else If Exists Return Go And Not In Is Null Like Between Order Group By Having Join Left
    Right Inner Outer Full Cross On Union All Distinct Top While Declare Print Drop Go Desc Asc With Off Returns Index Unique Primary Key Default
    Constraint References Foreign Check Add Truncate Merge Using Break Continue Transaction Tran Commit Rollback Raiserror Throw Output Use Try Catch
    Limit Offset Fetch Identity""".split()}


def _folds(*steps: tuple[str, str]) -> Folds:
    return Folds([(_g(p), r) for p, r in steps])


#: A statement ends at a semicolon, or at a block that nothing continues.
_STATEMENT = r"[^;KU]*(?:[KU](?=[;,)dPkoh:=mA<>xu])[^;KU]*)*(?:;|[KU]|$)"


def _js_grammar(ts: bool) -> Bracketed:
    any_ = "[i" + "".join(_kw(w) for w in _TS_WORDS) + "]"
    func = "<async>?<function>x?i?[PQ](?::[idBuhsnoOPUA]+)?[KUO]"
    cls = "<class>i?(?:<extends>i(?:di)*P?)?(?:<implements>i(?:di)*(?:ki(?:di)*)*)?[KUO]"
    prim = f"(?:{func}|{cls}|[EinsPBOU])"
    post = f"(?:d{any_}|dB|dP|P|B|s|p" + ("|!(?!=)|<as>(?:<const>|[idBunsOU]+)" if ts else "") + ")"
    pre = "(?:[m!p]|<new>|<typeof>|<void>|<delete>|<await>|<yield>x?" + ("|<keyof>" if ts else "") + ")"
    operand = f"{pre}*+{prim}{post}*+"
    binary = "(?:[omx<u=]|>{{1,3}}|<in>|<instanceof>)".replace("{{", "{").replace("}}", "}")
    steps = [(f"{operand}(?:{binary}{operand})*+", "E"), ("EhE:E", "E"), ("<async>?[EQ]A[EKUO]", "E"), ("E(?:P|B|d" + any_ + f"|s)++", "E"), (f"E{binary}E", "E")]
    if ts:
        generic = ("(?<=[iEP])<[idkBhuUOsno]*>", "")
        steps = [("(?<=[:<uk])<void>", "i"), generic, generic, generic, ("([PQ]):[idBuhsno]+A", r"\1A"), *steps]
    e = "E"
    exports = "(<export><default>?)?" + ("<declare>?" if ts else "")
    mods = "(<public>|<private>|<protected>|<readonly>|<static>|<abstract>|<async>|<get>|<set>|<declare>)*" if ts else "(<static>|<async>|<get>|<set>)*"
    decl = "E(h?:E)?" if ts else "E"
    typed = "(h?:E)?" if ts else ""
    args = _list("e?E")
    head = f"((<const>|<let>|<var>)?(E(kE)*)?;E?;(E(kE)*)?|(<const>|<let>|<var>)?E(<of>|<in>)E|(<const>|<let>|<var>)E)"
    qual = f"{head}" + (f"|{_list(f'e?{mods}E{typed}')}" if ts else "")
    prop = "(e?E(:E)?|(<async>|<get>|<set>)*x?EQ?[KE]|E<as>E" + ("|<type>E(<as>E)?|x?E[QE]?:E[KE]" if ts else "") + ")"
    pref = "(<if>E|<else>|<for><await>?[EQ]|<while>E|<do>|E:|<case>E:|<default>:)*"
    names = "(E|x<as>E)(k(E|x<as>E))*"
    simple = f"((<const>|<let>|<var>){decl}(k{decl})*|E(kE)*|<return>E?(kE)*|<throw>E|<break>E?|<continue>E?|<import>E|<import>" + ("<type>?" if ts else "") + f"{names}<from>E|(E|x(<as>E)?)<from>E" + ("|<type>E|<type>E<from>E" if ts else "") + ")"
    stmt = (
        f"{pref}({exports}({simple})?;?|K;?|<try>[KE]|<catch>[EQ]?[KE]|<finally>[KE]|<switch>E[KE]|{mods}x?EQ?" + ("(:E)?" if ts else "") + "[KE]"
        + (f"|{mods}E(h|!)?(:E)?;|{exports}<interface>E(<extends>E(kE)*)?[KE]|{exports}<const>?<enum>E[KE]?|{exports}<namespace>E[KE]?|@E|{exports}<abstract>E|{mods}(E|EQ):E;" if ts else f"|{mods}E;") + ")"
    )
    stmt = Grammar(_g(stmt))
    return Bracketed(
        _folds(*steps),
        {"(": [("P", Grammar(_g(args)), False), ("Q", Grammar(_g(qual)), False)],
         "[": [("B", Grammar(_g(_list("e?E") + "|k+(E(kE)*)?" + ("|E:E" if ts else ""))), False)],
         "{": [("U", Grammar(";;X"), False), ("O", Grammar(_g(_list(prop, False))), False), ("K", stmt, True)]},
        stmt, _STATEMENT,
        [(_kw("else"), rf"{_kw('if')}|.*{_kw('else')}"), (_kw("catch"), _kw("try")), (_kw("finally"), rf"{_kw('try')}|{_kw('catch')}")],
        _g("(?<=[PQ])[OU]|(?<=<else>)[OU]|(?<=<try>)[OU]|(?<=<catch>)[OU]|(?<=<finally>)[OU]|(?<=<do>)[OU]"),
    )


def _cs_grammar() -> Bracketed:
    prim = "(?:<new>(?:i(?:di)*)?h?(?:P?B+|P|B)?[OUK]?|<default>P?|<typeof>[PQ]|<delegate>[PQ]?[KU]|<void>x?|[EinsPB]|<this>)"
    post = "(?:d[i" + _kw("this") + "]|d<new>|P|B|p|!(?!=)|<switch>[OKU]|<is>(?:<not>)?(?:<new>|i(?:di)*)B?i?|<as>i(?:di)*B?h?|<with>[OU])"
    pre = "(?:[m!px]|<await>|<ref>|<throw>|<out>|P(?=[in" + _kw("this") + _kw("new") + "sP]))"
    operand = f"{pre}*+{prim}{post}*+".replace("{pre}", pre)
    binary = "(?:[omx<u=]|>{1,3})"
    steps = [
        ("^B+(?=[i" + "".join(_kw(w) for w in _CS_WORDS) + "])", "@"), *[("(?<=[iE])<[idkBhP]*>", "")] * 3, (f"{operand}(?:{binary}{operand})*+", "E"), ("EhE:E", "E"), ("<async>?<static>?[EQ]A[EKUO]", "E"),
        ("E(?:P|B|di)++", "E"), (f"E{binary}[EOU]", "E"),
    ]
    mods = "(<public>|<private>|<protected>|<internal>|<static>|<readonly>|<const>|<async>|<abstract>|<sealed>|<override>|<virtual>|<partial>|<extern>|<unsafe>|<volatile>|<event>)*"
    args = _list("(E:)?(<in>)?E?E")
    param = "E?(<this>|<in>|<params>)*E?h?E"
    head = f"((EE|E)?(kE)*;E?;(E(kE)*)?|E<in>E|EE<in>E|EE)"
    qual = f"{head}|{_list(param)}"
    where = "(<where>E:(E|<class>|<struct>)(k(E|<class>|<struct>))*)*"
    pref = "(<if>E|<else>|<for>[EQ]|<foreach>[EQ]|<while>E|<do>|<using>[EQ]|<lock>E|E:|<case>E(E)?(<when>E)?:|<default>:)*"
    simple = "(Eh?E(kE)*|E(kE)*|<yield>?<return>E?|<yield>?<break>|<continue>|<throw>E?|<using>Eh?E|<const>EE(kE)*)"
    stmt = (
        f"{pref}(({simple})?;|K;?|<try>[KE]|<catch>[EQ]?(<when>E)?[KE]|<finally>[KE]|<switch>E[KE]|<using><static>?E;|<namespace>E[KE;]"
        f"|@?{mods}((<class>|<struct>|<interface>|<record>|<enum>)+E(:E(kE)*)?{where}([KEO];?|;)|<delegate>E?EQ?;|<new>?Eh?E?Q?(:E)?{where}([KE](E?;)?|;)|Eh?E(kE)*;|E<this>E[KE]))"
    )
    stmt = Grammar(_g(stmt))
    obj = _list("(E(:E)?|O|K|U|E<when>E)")
    return Bracketed(
        _folds(*steps),
        {"(": [("P", Grammar(_g(args)), False), ("Q", Grammar(_g(qual)), False)], "[": [("B", Grammar(_g(_list("(E:)?E") + "|k+|EE")), False)],
         "{": [("U", Grammar(";;X"), False), ("O", Grammar(_g(obj)), False), ("K", stmt, True)]},
        stmt, _STATEMENT,
        [(_kw("else"), rf"{_kw('if')}|.*{_kw('else')}"), (_kw("catch"), rf"{_kw('try')}|{_kw('catch')}"), (_kw("finally"), rf"{_kw('try')}|{_kw('catch')}")],
        _g("(?<=[PQi])U|(?<=<else>)U|(?<=<try>)U|(?<=<finally>)U|(?<=<do>)U"),
    )


def _named(prefix: str, pattern: str) -> str:
    return re.sub(r"<([A-Za-z]+)>", lambda m: _kw(prefix + m.group(1)), re.sub(r"\s+", "", pattern))


class Sql:
    """BEGIN .. END and CASE .. END are the groups beside parentheses."""

    def __init__(self):
        q = lambda p: _named("SQL", p)
        operand = "(?:[m!]|<Not>|<Distinct>|<All>|<Exists>)*+(?:i(?:di|dx)*P?|[nsPCE]|<Null>|<Left>P|<Right>P|<Default>|<Insert>P|<Update>P)"
        binary = "(?:[omx<=u]|>|<And>|<Or>|<In>|<Like>|<Between>|<Is>|<Not>(?:<In>|<Like>|<Between>))"
        self.folds = Folds([(q(f"{operand}(?:{binary}{operand})*+"), "E"), (q(f"E{binary}E"), "E"), (q("E<As>E(?!<Begin>)"), "E"), (q("(?<=<Select>)(?:<Top>E)?x"), "E")])
        typ = "(E|<Table>)"
        source = "(EE?(<With>E)?)"
        join = f"((k|((<Left>|<Right>|<Full>)<Outer>?|<Inner>|<Cross>)?<Join>){source}(<On>E)?)"
        item = "((<Top>E)?E(E|<As>E)?|x)"
        tail = "((<Where>E)?(<Group><By>E(kE)*)?(<Having>E)?(<Order><By>E(<Asc>|<Desc>)?(kE(<Asc>|<Desc>)?)*)?(<Limit>E)?)"
        select = f"(<Select>{item}(k{item})*(<Into>E)?(<From>{source}{join}*)?{tail})"
        query = f"({select}(<Union><All>?({select}|E))*)"
        col = "(EE?E?(<Not>E|<Null>|<Primary>|<Key>|<Unique>|<Identity>E?|<Default>E|<References>E|<Check>E)*)"
        rule = "((<Constraint>E)?(<Primary><Key>|<Unique>|<Foreign><Key>|<Check>)E(<References>E)?)"
        group = f"{_list('E(E|<As>E)?(<Asc>|<Desc>)?')}|{query}|{_list(f'({col}|{rule})')}|x|Ex?"
        param = "(E<As>?E?(<Output>)?)"
        params = f"({param}(k{param})*)"
        simple = (
            f"{query}|<Insert><Into>?EE?(<Values>E(kE)*|{query}|(<Exec>|<Execute>)E+|<Default><Values>)|<Update>E<Set>E(kE)*(<From>{source}{join}*)?(<Where>E)?"
            f"|<Delete><From>?EE?(<From>{source}{join}*)?(<Where>E)?|(<Exec>|<Execute>)EE?(<Output>)?(kE(<Output>)?)*|<Set>E|<Set>E+(<On>|<Off>)|<Set><Identity>E(<On>|<Off>)"
            f"|<Return>E?|<Declare>{params}|<Print>E|<Use>E|<Drop>(<Table>|<View>|<Procedure>|<Proc>|<Function>|<Index>|<Trigger>)(<If><Exists>)?E|<Truncate><Table>E|<Create><Table>E+"
            f"|<Alter><Table>E(<Add>{col}|<Drop>E+|<Alter>E+)|<Create><Unique>?<Index>E<On>E|(<Create>|<Alter>)(<Or><Alter>)?<View>E(<As>)?{query}"
            f"|<Begin>?(<Commit>|<Rollback>)(<Transaction>|<Tran>)?E?|<Break>|<Continue>|<Throw>(E(kE)*)?|<Raiserror>E"
        )
        create = f"((<Create>|<Alter>)(<Or><Alter>)?((<Procedure>|<Proc>)EE?{params}?|(<Procedure>|<Proc>)E(k{param})*|<Function>E<Returns>{typ}|<Trigger>E<On>E+(<Insert>|<Update>|<Delete>)(k(<Insert>|<Update>|<Delete>))*)(<With>E)?<As>)"
        cond = "(<If>E|<Else>|<While>E)"
        self.group_grammar = Grammar(q(group))
        self.case = Grammar(q("E?(<When>E<Then>E)+(<Else>E)?"))
        self.stmt = Grammar(q(f"({create}?{cond}*(({simple})|K)?)+;?"))
        self.one = lru_cache(200_000)(lambda g, t: g.cost(self.folds.fold(t)))
        go, b, e, c = (_kw("SQL" + w) for w in ("Go", "Begin", "End", "Case"))
        self.cut = re.compile(rf"[^;K{go}]*(?:;|K;?|{go}|$)")
        self.go, self.paren = go, re.compile(r"\([^()]*\)")
        self.block = re.compile(rf"([{b}{c}])([^{b}{c}{e}()]*){e}")
        self.begin, self.else_, self.if_ = b, _kw("SQLElse"), _kw("SQLIf")

    def statements(self, tokens: str) -> int:
        cost, before = 0, ""
        for p in self.cut.findall(tokens):
            p = p.rstrip(self.go)
            if p:
                c = self.one(self.stmt, p)
                if not c and p[0] == self.else_ and self.if_ not in before and self.else_ not in before:
                    c = 1
                cost += c
                before = p
        return cost

    def parse(self, tokens: str) -> int:
        cost = 0

        def paren(m: re.Match) -> str:
            nonlocal cost
            cost += self.one(self.group_grammar, m.group()[1:-1])
            return "P"

        def block(m: re.Match) -> str:
            nonlocal cost
            if m.group(1) == self.begin:
                cost += self.statements(m.group(2))
                return "K"
            cost += self.one(self.case, m.group(2))
            return "C"

        n = 1
        while n:
            tokens, a = self.block.subn(block, tokens)
            tokens, b = self.paren.subn(paren, tokens)
            n = a + b
        return cost + self.statements(tokens)


class Python:
    """Logical lines; blocks are told by their indentation."""

    def __init__(self):
        prim = "[EinsPBOe]"
        post = "(?:di|P|B|s)"
        pre = "(?:[m!]|<not>|<await>)"
        operand = f"{pre}*+{prim}{post}*+"
        binary = "(?:[omx<u@]|>{1,2}|<and>|<or>|<in>|<is><not>?|<not><in>|W)"
        folds = _folds(
            (f"(?<!<for>){operand}(?:{binary}{operand})*+", "E"), ("(?<=<for>)[inEPkdB]+(?=<in>)", "E"), ("E<if>E<else>E", "E"),
            ("<lambda>(?:x*E(?:=E)?(?:kx*E(?:=E)?)*)?:E", "E"), ("E(?:P|B|di)++", "E"), (f"E{binary}E", "E"),
        )
        star = "([xo]?E)"
        many = f"({star}(k{star})*k?)"
        comp = f"(<async>?<for>E<in>E(<if>E)*)+"
        paren = f"{_list(f'([xo]?E(=E)?|E{comp}|x|o)')}|{_list('([xo]?E(:E)?(=E)?|x|o)')}|<yield>{many}?|{_list('E(<as>E)?')}"
        slice_ = "(E?(:E?)*|xE)"
        brace = f"{_list('(E:E|oE)')}|{_list(star)}|E:E{comp}|E{comp}"
        simple = (
            f"({many}(:E)?(={many}|=<yield>{many}?)*|<return>{many}?|<raise>(E(<from>E)?)?|<pass>|<break>|<continue>|<assert>E(kE)?|<del>{many}"
            f"|<import>E(<as>E)?(kE(<as>E)?)*|<from>(E|d|e)+<import>(x|E(<as>E)?(kE(<as>E)?)*)|(<global>|<nonlocal>)E(kE)*|<yield><from>?{many}?|E{many})"
        )
        head = (
            f"((<if>|<elif>|<while>)E|<else>|<try>|<finally>|<except>x?({many}(<as>E)?)?|<async>?<for>({many}<in>)?{many}|<async>?<with>E(<as>E)?(kE(<as>E)?)*"
            f"|<async>?<def>E(RE)?|<class>E):"
        )
        plain = simple.replace("|E{many}", "").replace(f"|E{many})", ")")
        self.line = Grammar(_g(f"({head}({plain}(;{plain})*;?)?|{plain}(;{plain})*;?|@E)"))
        self.head = Grammar(_g(head))
        groups = {"(": [("P", Grammar(_g(paren)), False)], "[": [("B", Grammar(_g(f"{_list(slice_)}|E{comp}")), False)], "{": [("O", Grammar(_g(brace)), False)]}
        self.groups = Bracketed(folds, groups, self.line, ".+", [])
        follow = {"else": "if elif for while try except", "elif": "if elif", "except": "try except", "finally": "try except else"}
        self.follow = {_kw(k): {_kw(w) for w in v.split()} for k, v in follow.items()}

    def parse(self, text: str) -> int:
        tokens: list[str] = []
        lines: list[tuple[int, str]] = []
        depth = cost = indent = 0
        for m in _PY_LEXER.finditer(text):
            kind = m.lastgroup
            if kind == "re":
                if depth <= 0 and tokens:
                    lines.append((indent, "".join(tokens)))
                    tokens, depth = [], 0
                continue
            if kind == "skip":
                continue
            word = m.group()
            if not tokens:
                start = text.rfind("\n", 0, m.start()) + 1
                indent = len(text[start : m.start()].expandtabs(8))
            t = _PY_WORDS.get(word, "i") if kind == "i" else _SYMBOL.get(word, "o") if kind == "o" else kind
            if t in "([{":
                depth += 1
            elif t in ")]}":
                depth -= 1
            tokens.append(t)
        if tokens:
            lines.append((indent, "".join(tokens)))
        levels, expect, heads = [0], False, {}
        for at, line in lines:
            line, c = self.groups.reduce(line)
            cost += c + self.groups.one(self.line, line)
            if expect:
                if at > levels[-1]:
                    levels.append(at)
                else:
                    cost += 1  # a block is missing
            elif at > levels[-1]:
                cost += 1
                levels.append(at)
            while at < levels[-1]:
                heads.pop(levels[-1], None)
                levels.pop()
            if at != levels[-1]:
                cost += 1
                levels.append(at)
            first = line[1] if len(line) > 1 and line[0] == _kw("async") else line[0]
            if first in self.follow and heads.get(at) not in self.follow[first]:
                cost += 1
            heads[at] = first
            expect = line[-1] == ":" and self.groups.one(self.head, line) == 0
        return cost + expect


class Basic:
    """Lines of statements; blocks are told by their first and last lines."""

    def __init__(self):
        w = lambda p: _named("VB", p)
        after = "[i" + "".join(_VB_WORDS.values()) + "]"
        operand = "(?:m|<Not>|<Await>)*+(?:(?:<If>|<New>i(?:di)*)P|<New>i(?:di)*|[EinsPO]|<Nothing>|<AddressOf>|d" + after + ")(?:d" + after + "|P|!i|h)*+"
        binary = "(?:[omx<u=]|>|<And>|<Or>|<AndAlso>|<OrElse>|<Is>|<IsNot>|<Like>|<Mod>|<Xor>)"
        self.folds = Folds([(w(f"{operand}(?:{binary}{operand})*+"), "E"), (w(f"E{binary}E"), "E"), (w("(?:<Function>|<Sub>)E(?=E)"), "")])
        mods = "(<Public>|<Private>|<Protected>|<Friend>|<Shared>|<Overrides>|<Overridable>|<Partial>|<ReadOnly>|<Static>|<Async>|<Overloads>|<Shadows>|<MustOverride>|<MustInherit>|<NotInheritable>|<Default>|<Const>|<WithEvents>)"
        param = "((<ByVal>|<ByRef>|<Optional>|<ParamArray>)*E(<As>E)?)"
        arg = "((EW)?E|<Of>E(kE)*|E<To>E)"
        self.paren = Grammar(w(f"{arg}?(k{arg}?)*|{_list(param)}"))
        self.brace = Grammar(w(_list("E")))
        var = "(E(k E)*(<As>E)?((<From>|<With>)E)?)"
        simple = (
            f"(<Imports>E|<Option>E(<On>)?E?|<Dim>{var}(k{var})*|{mods}+{var}|E|<Return>E?|<Throw>E?|<Exit>(<Sub>|<Function>|<For>|<Do>|<While>|<Try>|<Select>|<Property>)"
            f"|<Continue>(<For>|<Do>|<While>)|<Call>E|<Inherits>E|<Implements>E(kE)*|(<AddHandler>|<RemoveHandler>)EkE|<RaiseEvent>E|<ReDim><Preserve>?E|{mods}*<Event>E(<As>E)?|<Yield>E|<GoTo>E)"
        ).replace("<Option>E(<On>)?E?", "<Option>E+")
        opens = {
            "class": f"{mods}*<Class>E", "module": f"{mods}*<Module>E", "namespace": "<Namespace>E", "structure": f"{mods}*<Structure>E",
            "interface": f"{mods}*<Interface>E", "enum": f"{mods}*<Enum>E(<As>E)?", "sub": f"{mods}*<Sub>(E|<New>E?)(<Handles>E(kE)*)?(<Implements>E)?",
            "function": f"{mods}*<Function>E(<As>E)?(<Handles>E|<Implements>E)?", "property": f"{mods}*<Property>E(<As>E)?",
            "if": "<If>E<Then>?", "for": "<For>E(<As>E)?<To>E(<Step>E)?", "foreach": "<For><Each>E(<As>E)?<In>E",
            "while": "<While>E", "do": "<Do>((<While>|<Until>)E)?", "try": "<Try>", "using": "<Using>E(<As>E)?", "with": "<With>E",
            "select": "<Select><Case>?E", "synclock": "<SyncLock>E", "get": "<Get>", "set": "<Set>E?",
        }
        words = {"synclock": "SyncLock"}
        ends = {k: f"<End><{words.get(k, k.capitalize())}>" for k in opens if k not in ("for", "foreach", "do")}
        ends |= {"for": "<Next>E?", "foreach": "<Next>E?", "do": "<Loop>((<While>|<Until>)E)?"}
        mids = {"if": "<Else>|<ElseIf>E<Then>?|<Else><If>E<Then>", "try": "<Catch>(E(<As>E)?)?(<When>E)?|<Finally>", "select": "<Case>(<Else>|(<Is>[o<>=])?E(<To>E)?(kE(<To>E)?)*)"}
        inline = f"<If>E<Then>{simple}(<Else>{simple})?"
        lines = {k: [(n, re.compile(w(p).replace("(", "(?:"))) for n, p in v.items()] for k, v in (("opens", opens), ("ends", ends), ("mids", mids))}
        self.opens, self.ends, self.mids = lines["opens"], lines["ends"], lines["mids"]
        every = "|".join([simple, inline, *opens.values(), *ends.values(), *mids.values()])
        self.line = Grammar(w(f"({every})(:({simple}))*|E:"))
        self.kind = lru_cache(200_000)(self._kind)
        self.group = re.compile(r"[({][^(){}]*[)}]")
        self.inner = lru_cache(200_000)(lambda t: (self.paren if t[0] == "(" else self.brace).cost(self.folds.fold(t[1:-1])))

    def _kind(self, line: str) -> tuple:
        line = self.folds.fold(re.sub(r"^<[iP dk=E]+>", "", line))
        if not line:
            return 0, "", set(), set()
        return (
            self.line.cost(line), next((k for k, p in self.opens if p.fullmatch(line)), ""),
            {k for k, p in self.ends if p.fullmatch(line)}, {k for k, p in self.mids if p.fullmatch(line)},
        )

    def parse(self, text: str) -> int:
        cost, depth = 0, 0
        tokens: list[str] = []
        lines: list[str] = []
        for m in _VB_LEXER.finditer(text + "\n"):
            kind = m.lastgroup
            if kind == "skip":
                continue
            if kind == "re":
                if tokens and not (depth > 0 and tokens[-1] in "(,k{"):
                    lines.append("".join(tokens))
                    tokens, depth = [], 0
                continue
            word = m.group()
            t = _VB_WORDS.get(word.lower(), "i") if kind == "i" else _SYMBOL.get(word, "o") if kind == "o" else kind
            depth += (t in "({") - (t in ")}")
            tokens.append(t)
        if tokens:
            lines.append("".join(tokens))

        def one(m: re.Match) -> str:
            nonlocal cost
            cost += self.inner(m.group())
            return "P" if m.group()[0] == "(" else "O"

        stack: list[str] = []
        properties = 0
        for line in lines:
            n = 1
            while n:
                line, n = self.group.subn(one, line)
            c, opens, ends, mids = self.kind(line)
            cost += c
            if ends:
                at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i] in ends), -1)
                if at < 0 and ends == {"property"} and properties:
                    properties -= 1
                elif at < 0:
                    cost += 1
                else:
                    cost += len(stack) - 1 - at
                    del stack[at:]
            elif mids:
                cost += not (stack and stack[-1] in mids)
            elif opens == "property":
                properties += 1  # with or without accessors of its own, so its end may come or not
            elif opens:
                stack.append(opens)
        return cost + len(stack)


_TAG = re.compile(r"<!--(?:[^-]|-(?!-))*-->|<\?[\w:-]+(?:[^?]|\?(?!>))*\?>|<!\[CDATA\[[\s\S]*?\]\]>|<!DOCTYPE[^<>\[]*>|<(/?)([A-Za-z_][\w.:-]*)((?:\s+[A-Za-z_][\w.:-]*\s*=\s*(?:\"[^\"<]*\"|'[^'<]*'))*)\s*(/?)>|<")
_BAD_ENTITY = re.compile(r"&(?!(?:\w+|#\d+|#x[\da-fA-F]+);)")


def _markup(text: str) -> int:
    """Elements are the groups; a tag that is none, or has no partner, is a repair, and so is text outside."""
    cost, stack, roots, at = 0, [], 0, 0
    for m in _TAG.finditer(text):
        between, at = text[at : m.start()], m.end()
        if not stack and between.strip("﻿ \t\r\n"):
            cost += 1
        cost += len(_BAD_ENTITY.findall(between))
        if m.group() == "<":
            cost += 1
        elif m.group(2):
            cost += len(_BAD_ENTITY.findall(m.group(3)))
            if m.group(1):
                if m.group(2) in stack:
                    while stack[-1] != m.group(2):
                        stack.pop()
                        cost += 1
                    stack.pop()
                else:
                    cost += 1
            else:
                roots += not stack
                if not m.group(4):
                    stack.append(m.group(2))
    return cost + len(stack) + (1 if text[at:].strip() else 0) + max(0, roots - 1) + (roots == 0 and bool(text.strip()))


def _lex(lexer: re.Pattern, words: dict[str, str], text: str, lower: bool) -> str:
    out = []
    add = out.append
    for m in lexer.finditer(text):
        kind = m.lastgroup
        if kind == "skip":
            continue
        if kind == "i":
            word = m.group()
            t = words.get(word.lower() if lower else word, "i")
            add("i" if t in _CONTEXTUAL and not lower and not _FOLLOWED.match(text, m.end()) else t)
        elif kind == "o":
            add(_SYMBOL.get(m.group(), "o"))
        elif kind == "re":
            add(_SYMBOL.get(m.group()[0], "o") + "s" if m.group()[0] not in "!&|?" else {"!": "!", "&": "o", "|": "u", "?": "h"}[m.group()[0]] + "s")
        else:
            add(kind)
    return "".join(out)


def _tokens(lexer: re.Pattern, words: dict[str, str], text: str, lower: bool) -> list[wider.Token]:
    """The same with the text of every token, and whether a line ends before it."""
    out, new = [], False
    for m in lexer.finditer(text):
        kind, word = m.lastgroup, m.group()
        if kind == "skip":
            new |= "\n" in word or "\r" in word
            continue
        if kind == "re":
            first = word[0]
            out += [(_SYMBOL.get(first, "o"), first, new), ("s", "//", False)]
        elif kind == "i":
            s = words.get(word.lower() if lower else word, "i")
            out.append(("i" if s in _CONTEXTUAL and not lower and not _FOLLOWED.match(text, m.end()) else s, word, new))
        else:
            out.append((_SYMBOL.get(word, "o") if kind == "o" else kind, word, new))
        new = False
    return out


def _joined(tokens: list[wider.Token]) -> str:
    return "".join(s for s, _, _ in tokens)


_CONTEXTUAL = frozenset(_kw(w) for w in _LATER[3:-1].split("|"))
_FOLLOWED = re.compile(r"\s+[\w$\"'\[{*#@]")


@cache
def _parser(lang: str):
    if lang in ("javascript", "typescript"):
        ts = lang == "typescript"
        g, words = _js_grammar(ts), _TS_WORDS if ts else _JS_WORDS

        head = re.compile(_g("(?<![d])(?:<if>|<while>|<switch>)(?![(:])"))

        def script(text: str) -> int:
            plain = _lex(_JS_LEXER, words, text, False)
            cost = g.parse(plain)
            if cost:
                tokens = _tokens(_JS_LEXER, words, wider.inner_texts(text, "`", "${"), False)
                cost = min(cost, g.parse(_joined(wider.script(tokens, ts, _kw))))
            # Conditions stand in parentheses.
            return cost or int(head.search(plain) is not None)

        return script
    if lang == "csharp":
        g = _cs_grammar()

        head = re.compile(_g("(?<!d)(?:<if>|<while>|<foreach>|<lock>)(?!\\()"))

        def csharp(text: str) -> int:
            tokens = _lex(_CS_LEXER, _CS_WORDS, text, False)
            cost = g.parse(tokens)
            if cost:
                plain = re.sub(r"(?m)^[ \t]*#\s*(?:region|endregion|if|else|elif|endif|pragma|nullable|define|undef|line|warning|error)\b[^\n]*", "", text)
                wide = _tokens(_CS_LEXER, _CS_WORDS, wider.inner_texts(plain, '$"', "{"), False)
                cost = min(cost, g.parse(_joined(wider.csharp(wide, _kw))))
            return cost or int(head.search(tokens) is not None)

        return csharp
    if lang == "sql":
        s = Sql()

        def sql(text: str) -> int:
            cost = s.parse(_lex(_SQL_LEXER, _SQL_WORDS, text, True))
            if cost:
                cost = min(cost, s.parse(_joined(wider.sql(_tokens(_SQL_LEXER, _SQL_WORDS, text, True), lambda w: _kw("SQL" + w)))))
            return cost

        return sql
    if lang == "python":
        return Python().parse
    if lang == "vbnet":
        b = Basic()

        def basic(text: str) -> int:
            cost = b.parse(text)
            return min(cost, b.parse(wider.basic(text))) if cost else 0

        return basic
    return _markup


def _confirmed(lang: str, text: str) -> bool:
    """Whether the library's own parser rejects a text too, for the languages that have one."""
    try:
        if lang == "python":
            ast.parse(text)
            return False
        if lang == "config":
            expat.ParserCreate().Parse(text.encode("utf-8", "replace"), True)
            return False
    except (SyntaxError, ValueError, RecursionError, MemoryError, expat.ExpatError):
        return True
    return True


LANGUAGES = ("csharp", "vbnet", "javascript", "typescript", "python", "sql", "config")
_MARK = re.compile(r"^(?:<{7}|>{7}|\|{7}|={7})(?:[ \r\n]|$)", re.M)


def repair_cost(lang: str | None, text: str | None) -> int:
    """Least number of tokens to supply, drop or replace until ``text`` parses in ``lang``; 0 for valid texts,
    empty ones, and languages without a grammar."""
    if not text or not text.strip() or lang not in LANGUAGES:
        return 0
    cost = _parser(lang)(text.lstrip("﻿"))
    return cost if cost and _confirmed(lang, text.lstrip("﻿")) else 0


def cause(lang: str, text: str, cost: int) -> str:
    """Why a text does not parse: conflict marks, its language is another one, it ends too early, else 'other'."""
    if len(_MARK.findall(text)) >= 2 and (lang == "config" or repair_cost(lang, _MARK.sub("", _without_conflicts(text))) < cost):
        return "conflict"
    lines = max(1, text.count("\n"))
    if cost > 5 and cost > 0.3 * lines:
        others = [x for x in LANGUAGES if x != lang and repair_cost(x, text) == 0]
        if others:
            return "mismatch"
    head = text[: text.rstrip().rfind("\n") + 1]
    if cost <= 12 and not re.search(r"[;}\])>]\s*$|\bEnd \w+\s*$|\bEND\s*(?:GO\s*)?$", text):
        return "truncated"
    return "truncated" if head and cost <= 6 and repair_cost(lang, text + "\n" + _closers(text)) == 0 else "other"


def _without_conflicts(text: str) -> str:
    """The text with the first side of every conflict only."""
    return re.sub(r"^<{7}[^\n]*\n([\s\S]*?)(?:^\|{7}[^\n]*\n[\s\S]*?)?^={7}[^\n]*\n[\s\S]*?^>{7}[^\n]*\n?", r"\1", text, flags=re.M)


def _closers(text: str) -> str:
    stack = []
    for c in re.sub(r"\"[^\"\n]*\"|'[^'\n]*'", "", text):
        if c in "([{":
            stack.append({"(": ")", "[": "]", "{": "}"}[c])
        elif stack and c == stack[-1]:
            stack.pop()
    return "".join(reversed(stack))


def broken_files(docs: DataFrame) -> DataFrame:
    """``(doc_id, lang, source, repairs, reason)`` of the files ``(doc_id, lang, source, text)`` that need repairs.

    Null and empty texts, texts of comments only, and texts in other languages need none. Every row
    is judged by itself, so repeated rows come out repeated.
    """

    def run(batches):
        for batch in batches:
            rows = []
            cols = [batch.column(c).to_pylist() for c in ("doc_id", "lang", "source", "text")]
            for doc, lang, source, text in zip(*cols, strict=True):
                n = repair_cost(lang, text)
                if n:
                    rows.append((doc, lang, source, n, cause(lang, text, n)))
            out = list(zip(*rows, strict=True)) if rows else [[]] * 5
            types = [pa.int64(), pa.string(), pa.string(), pa.int32(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["doc_id", "lang", "source", "repairs", "reason"])

    return docs.where("length(text) > 0").select("doc_id", "lang", "source", "text").mapInArrow(
        run, "doc_id long, lang string, source string, repairs int, reason string"
    )
