"""Less common constructs of a language, rewritten token by token to the common ones that its grammar holds.

A text that the grammar would have to repair is read once more after these rewritings, and only what still
needs repairs counts. Every rewriting reads a whole construct (a type, a clause, a modifier) and puts a
constituent of the same kind in its place, or nothing; brackets are only taken out in pairs, so a text that
lacks one still does.
"""

from __future__ import annotations

import re
from collections.abc import Callable

#: A token: its symbol in the grammar, its text, and whether a line ends before it.
Token = tuple[str, str, bool]
OPEN, SHUT = "([{", ")]}"


def closing(t: list[Token], at: int) -> int:
    """Where the bracket at a place is closed, or -1."""
    stack = []
    for i in range(at, len(t)):
        s = t[i][0]
        if s in OPEN and s:
            stack.append(SHUT[OPEN.index(s)])
        elif s in SHUT and s:
            if not stack or stack.pop() != s:
                return -1
            if not stack:
                return i
    return -1


def inner_texts(text: str, start: str, hole: str) -> str:
    """Texts with code in them turned to plain ones: ``start`` opens one, ``hole`` a piece of code up to its brace."""
    quote, out, at = start[-1], [], 0
    while True:
        i = text.find(start, at)
        if i < 0:
            return "".join(out) + text[at:]
        out.append(text[at:i])
        j, depth = i + len(start), []
        while j < len(text):
            c = text[j]
            if depth:
                if c == "{":
                    depth.append("{")
                elif c == "}":
                    depth.pop()
                elif c == quote:
                    depth.append(quote) if depth[-1] != quote else depth.pop()
                    if depth and depth[-1] == quote:
                        k = j + 1
                        while k < len(text) and text[k] != quote and text[k] != "\n" or text[k : k + len(hole)] == hole and k < len(text):
                            k += 1
                        j = k
                        depth.pop()
            elif c == "\\":
                j += 1
            elif text.startswith(hole, j) and not text.startswith(hole + hole, j):
                depth.append("{")
                j += len(hole) - 1
            elif c == quote:
                break
            elif quote == '"' and c == "\n":
                break
            j += 1
        if j >= len(text) or text[j] != quote:
            out.append(start)
            at = i + len(start)
            continue
        out.append(quote + quote)
        at = j + 1


def until(t: list[Token], at: int, stop: Callable[[int], bool]) -> int:
    """The first place from ``at`` on, outside of brackets, where ``stop`` holds, or the end; -1 where brackets don't pair."""
    while at < len(t) and not stop(at):
        if t[at][0] and t[at][0] in SHUT:
            return -1
        if t[at][0] and t[at][0] in OPEN:
            at = closing(t, at)
            if at < 0:
                return -1
        at += 1
    return at


class Types:
    """Types of TypeScript by recursive descent: each method returns where a type ends, or -1."""

    def __init__(self, t: list[Token]):
        self.t = t

    def sym(self, i: int) -> str:
        return self.t[i][0] if 0 <= i < len(self.t) else ""

    def word(self, i: int) -> str:
        return self.t[i][1] if 0 <= i < len(self.t) else ""

    def named(self, i: int) -> bool:
        return bool(re.fullmatch(r"[A-Za-z_$#][\w$]*", self.word(i)))

    def whole(self, i: int) -> int:
        """A type with unions and conditions."""
        if self.sym(i) in ("u", "o") and self.word(i) in ("|", "&"):
            i += 1
        i = self.prefixed(i)
        while i >= 0 and self.word(i) in ("|", "&"):
            i = self.prefixed(i + 1)
        if i >= 0 and self.word(i) == "extends":
            j = self.whole_plain(i + 1)
            if j >= 0 and self.word(j) == "?":
                k = self.whole(j + 1)
                if k >= 0 and self.word(k) == ":":
                    return self.whole(k + 1)
            return -1 if j < 0 else i
        return i

    def whole_plain(self, i: int) -> int:
        i = self.prefixed(i)
        while i >= 0 and self.word(i) in ("|", "&"):
            i = self.prefixed(i + 1)
        return i

    def prefixed(self, i: int) -> int:
        while self.word(i) in ("keyof", "readonly", "typeof", "infer", "unique", "abstract") and (self.named(i + 1) or self.sym(i + 1) in "([{ns"):
            i += 1
        if self.word(i) == "asserts" and self.named(i + 1) and self.word(i + 1) != "is":
            i += 1
        i = self.primary(i)
        while i >= 0 and not self.t[i - 1 if i >= len(self.t) else i][2] and self.sym(i) == "[":
            if self.sym(i + 1) == "]":
                i += 2
            else:
                j = self.whole(i + 1)
                if j < 0 or self.sym(j) != "]":
                    return -1
                i = j + 1
        return i

    def primary(self, i: int) -> int:
        s, w = self.sym(i), self.word(i)
        if w == "new" and self.sym(i + 1) in ("(", "<"):
            i, s, w = i + 1, self.sym(i + 1), self.word(i + 1)
        if w == "<":
            i = self.parameters(i)
            s = self.sym(i) if i >= 0 else ""
        if i < 0:
            return -1
        if s == "(":
            j = self.group(i)
            if j >= 0 and self.word(j) == "=>":
                return self.whole(j + 1)
            k = self.whole(i + 1)
            return k + 1 if k >= 0 and self.sym(k) == ")" else -1
        if s == "[":
            return self.items(i, "]", self.element)
        if s == "{":
            return self.members(i)
        if w == "-" and self.sym(i + 1) == "n":
            return i + 2
        if s in ("n", "s"):
            return i + 1
        if not self.named(i) or w in ("class", "function", "return", "const", "let", "var", "if", "else", "for", "while", "case", "new"):
            return -1
        i += 1
        while self.word(i) == "." and self.named(i + 1):
            i += 2
        if self.word(i) == "is" and (self.named(i + 1) or self.sym(i + 1) in "({[s"):
            return self.whole(i + 1)
        if self.word(i) == "(" and w == "import":
            i = closing(self.t, i) + 1
        if self.word(i) == "<":
            j = self.arguments(i)
            return j if j >= 0 else i
        return i

    def arguments(self, i: int) -> int:
        """Types in angles. Two angles in one sign are split by the caller beforehand."""
        j = self.whole(i + 1)
        while j >= 0 and self.word(j) == ",":
            j = self.whole(j + 1)
        return j + 1 if j >= 0 and self.word(j) == ">" else -1

    def parameters(self, i: int) -> int:
        """Type parameters with bounds and defaults."""
        j = i + 1
        while True:
            while self.word(j) in ("const", "in", "out") and self.named(j + 1):
                j += 1
            if not self.named(j):
                return -1
            j += 1
            if self.word(j) == "extends":
                j = self.whole(j + 1)
            if j >= 0 and self.word(j) == "=":
                j = self.whole(j + 1)
            if j < 0:
                return -1
            if self.word(j) == ",":
                j += 1
                if self.word(j) != ">":
                    continue
            return j + 1 if self.word(j) == ">" else -1

    def items(self, i: int, end: str, one: Callable[[int], int]) -> int:
        j = i + 1
        while self.sym(j) != end:
            j = one(j)
            if j < 0:
                return -1
            if self.word(j) in (",", ";") :
                j += 1
            elif self.sym(j) != end:
                return -1
        return j + 1

    def element(self, i: int) -> int:
        i += self.word(i) == "..."
        if self.named(i) and self.word(i + 1) in (":", "?") and (self.word(i + 1) == ":" or self.word(i + 2) == ":"):
            return self.whole(i + 2 + (self.word(i + 1) == "?"))
        j = self.whole(i)
        return j + 1 if j >= 0 and self.word(j) == "?" else j

    def parameter(self, i: int) -> int:
        i += self.word(i) == "..."
        if self.sym(i) in ("{", "["):
            i = closing(self.t, i) + 1
            if i == 0:
                return -1
        elif self.named(i):
            i += 1
        else:
            return -1
        i += self.word(i) == "?"
        return self.whole(i + 1) if self.word(i) == ":" else i

    def group(self, i: int) -> int:
        """Parameters of a type of functions."""
        return self.items(i, ")", self.parameter)

    def members(self, i: int) -> int:
        """An object type, also one that maps keys."""
        j = i + 1
        while self.sym(j) != "}":
            if j >= len(self.t):
                return -1
            j = self.member(j)
            if j < 0:
                return -1
            if self.word(j) in (";", ","):
                j += 1
            elif self.sym(j) != "}" and not (j < len(self.t) and self.t[j][2]):
                return -1
        return j + 1

    def member(self, j: int) -> int:
        while self.word(j) in ("readonly", "-", "+", "get", "set", "static", "new") and self.word(j + 1) not in (":", "?", ";", ",") and not (self.sym(j + 1) == "(" and self.word(j) != "new"):
            j += 1
        if self.sym(j) == "[":
            k = j + 1
            if self.named(k) and self.word(k + 1) in (":", "in"):
                k = self.whole(k + 2)
                if k >= 0 and self.word(k) == "as":
                    k = self.whole(k + 1)
                if k < 0 or self.sym(k) != "]":
                    return -1
                j = k + 1
            else:
                j = closing(self.t, j) + 1
                if j == 0:
                    return -1
        elif self.sym(j) == "(" or self.word(j) == "<":
            pass
        elif self.named(j) or self.sym(j) in ("s", "n"):
            j += 1
        else:
            return -1
        while self.word(j) in ("?", "-", "+"):
            j += 1
        if self.word(j) == "<":
            j = self.parameters(j)
            if j < 0:
                return -1
        if self.sym(j) == "(":
            j = self.group(j)
        return self.whole(j + 1) if j >= 0 and self.word(j) == ":" else j


_ENDS = re.compile(r"[inspB)\]}]|.*")
#: Words after which a line end ends a statement, and words and signs that begin one.
_STOPS = {"return", "break", "continue", "this", "super", "null", "true", "false"}
_STARTS = {"import", "export", "const", "let", "var", "function", "async", "await", "return", "if", "for", "while", "do", "try", "throw", "new", "class", "switch", "break", "continue", "typeof", "delete", "void", "yield", "static", "get", "set",
           "type", "interface", "enum", "namespace", "declare", "abstract", "public", "private", "protected", "readonly", "this", "super", "case", "default"}


def line_ends(t: list[Token]) -> list[Token]:
    """Semicolons where a line ends a statement: within braces or outside of all brackets, between what can end one and what can begin one."""
    out: list[Token] = []
    stack: list[str] = []
    for i, (s, w, new) in enumerate(t):
        if new and out and (not stack or stack[-1] == "{"):
            p, pw = out[-1][0], out[-1][1]
            ends = p in ("n", "s", "p", ")", "]", "}") or p == "i" or pw in _STOPS
            begins = s in ("i", "n", "s", "{", "@") and s != "{" or w in _STARTS or w in ("#", "[") and p == "}" or w == "@"
            if p == ")" and w not in _STARTS and s == "{":
                begins = False
            # What closes a head (if, for, while) is followed by its statement.
            if p == ")" and begins:
                k, depth = len(out) - 1, 0
                while k >= 0:
                    depth += (out[k][0] == ")") - (out[k][0] == "(")
                    if depth == 0:
                        break
                    k -= 1
                begins = not (k > 0 and out[k - 1][1] in ("if", "for", "while", "await", "switch", "with"))
            if p == "}":
                begins = begins and w not in ("else", "catch", "finally", "while", "from", "as", "of", "in", "instanceof")
            if ends and begins and pw not in ("else", "do", "in", "of", "instanceof", "typeof", "new"):
                out.append((";", ";", False))
        if s and s in OPEN:
            stack.append(s)
        elif s and s in SHUT and stack:
            stack.pop()
        out.append((s, w, new))
    return out


def script(t: list[Token], ts: bool, kw: Callable[[str], str]) -> list[Token]:
    """JavaScript and TypeScript: line ends, types, decorators, and smaller forms."""
    e = ("i", "_", False)
    if ts:
        split = []
        for s, w, new in t:
            if w in (">>", ">>>"):
                split += [(">", ">", new and k == 0) for k in range(len(w))]
            else:
                split.append((s, w, new))
        t = typed(split, kw)
    out: list[Token] = []
    i = 0
    while i < len(t):
        s, w, new = t[i]
        nxt = t[i + 1][1] if i + 1 < len(t) else ""
        if w == "new" and nxt == "." or w == "import" and nxt in ("(", "."):
            out.append(e if w == "import" else ("i", "new", new))
            i += 1
            continue
        if w == "default" and (nxt == "as" or out and out[-1][1] == "as"):
            out.append(("i", w, new))
        elif w == "static" and nxt == "{":
            pass
        elif w == "as" and nxt == "default":
            out.append((kw("as"), w, new))
        elif w == "," and out and out[-1][1] in (",", "[") and _in_list(out):
            pass
        elif w == "extends" and nxt == "(":
            j = closing(t, i + 1)
            out += [t[i], e] if j > 0 else [t[i]]
            i = j if j > 0 else i
        else:
            out.append(t[i])
        i += 1
    out = line_ends(out)
    # A block after a catch without a name is one.
    return [x for i, x in enumerate(out) if not (x[1] == ";" and i and out[i - 1][1] == "catch")]


def _in_list(t: list[Token]) -> bool:
    depth = 0
    for s, *_ in reversed(t):
        if s and s in SHUT:
            depth += 1
        elif s and s in OPEN:
            if depth == 0:
                return s == "["
            depth -= 1
    return False


def typed(t: list[Token], kw: Callable[[str], str]) -> list[Token]:
    """Types, their parameters and declarations of types only, taken out."""
    y = Types(t)
    out: list[Token] = []
    i = 0
    while i < len(t):
        s, w, new = t[i]
        p = out[-1][1] if out else ""
        fresh = not out or p in (";", "{", "}") or new or p in ("export", "declare", "default")
        if w == "@" and y.named(i + 1):
            i += 2
            while y.word(i) == "." and y.named(i + 1):
                i += 2
            if y.sym(i) == "(":
                i = closing(t, i) + 1 or i
            continue
        if w == "satisfies" and out and (out[-1][0] in "ins" or p in (")", "]", "}")):
            j = y.whole(i + 1)
            if j > 0:
                i = j
                continue
        if fresh and w == "type" and y.named(i + 1):
            j = i + 2
            j = y.parameters(j) if y.word(j) == "<" else j
            if j > 0 and y.word(j) == "=":
                k = y.whole(j + 1)
                if k > 0:
                    out += [("i", "_", new), (";", ";", False)]
                    i = k + (y.word(k) == ";")
                    continue
        if fresh and w == "interface" and y.named(i + 1):
            j = i + 2
            j = y.parameters(j) if y.word(j) == "<" else j
            if j > 0 and y.word(j) == "extends":
                j = y.whole_plain(j + 1)
                while j > 0 and y.word(j) == ",":
                    j = y.whole_plain(j + 1)
            if j > 0 and y.sym(j) == "{":
                k = y.members(j)
                if k > 0:
                    while out and out[-1][1] in ("export", "declare", "default"):
                        out.pop()
                    out += [("i", "_", new), (";", ";", False)]
                    i = k
                    continue
        if fresh and w == "declare" and y.word(i + 1) in ("module", "global", "namespace"):
            j = i + 2
            while y.sym(j) == "s" or y.named(j) or y.word(j) == ".":
                j += 1
            if y.sym(j) == "{":
                i = j
                continue
        if fresh and w in ("function", "async") or w == "function":
            j = i + 1 + (w == "async")
            j += y.word(j) == "*"
            if w == "function" and y.named(j):
                j = y.parameters(j + 1) if y.word(j + 1) == "<" else j + 1
                if j > 0 and y.sym(j) == "(":
                    k = y.group(j)
                    k = y.whole(k + 1) if k > 0 and y.word(k) == ":" else k
                    if k > 0 and (y.word(k) == ";" or y.sym(k) != "{" and k < len(t) and t[k][2]):
                        while out and out[-1][1] in ("export", "declare", "default"):
                            out.pop()
                        out += [("i", "_", new), (";", ";", False)]
                        i = k + (y.word(k) == ";")
                        continue
        if w == "abstract" and (y.word(i + 1) in ("get", "set", "async") or y.named(i + 1)) and y.word(i + 1) != "class":
            j = i + 1
            while y.named(j) and y.named(j + 1):
                j += 1
            j = y.parameters(j + 1) if y.word(j + 1) == "<" else j + 1
            k = y.group(j) if j > 0 and y.sym(j) == "(" else j
            k = y.whole(k + 1) if k > 0 and y.word(k) == ":" else k
            if k > 0 and (y.word(k) == ";" or k < len(t) and t[k][2]):
                while out and out[-1][1] in ("public", "protected", "private", "readonly", "override"):
                    out.pop()
                out += [("i", "_", new), (";", ";", False)]
                i = k + (y.word(k) == ";")
                continue
        if w == "<":
            before = out[-1] if out else ("", "", False)
            j = y.parameters(i) if before[0] == "i" or p in ("function", "new", "=", "(", ",", "async", "return", "=>", "get", "set", ";", "{", "") else -1
            j = j if j > 0 else y.arguments(i) if before[0] == "i" or p in (")", "]") else -1
            if j > 0 and (y.word(j) in ("(", "{", ")", "]", ",", ";", "=", "extends", "implements", "=>", ":", "?", "|", "&", ".", "!") or y.sym(j) in ("s", "") or j < len(t) and t[j][2]):
                i = j
                continue
        if w == ":" and out and (p in (")", "]", "}", "?", "!") or out[-1][0] == "i" or y.named(i - 1)):
            j = y.whole(i + 1)
            if j > 0 and y.word(j) in (",", ")", ";", "=", "{", "=>", "]", "of", "in", "}") or j > 0 and (j >= len(t) or t[j][2]):
                if p == ")" or p in ("?", "!"):
                    # A result's type, or that of what may be missing, goes whole.
                    if p in ("?", "!"):
                        out.pop()
                    i = j
                    continue
                out += [(":", ":", False), ("i", "_", False)]
                i = j
                continue
        if w == "as" and s == kw("as"):
            j = y.whole(i + 1)
            if j > 0 and y.word(i + 1) not in ("const", "default") and (out and (out[-1][0] in "ins" or p in (")", "]", "}"))) and not (y.word(j) in (",", "}") and _imported(out)):
                i = j
                continue
        if fresh and w == "import" and y.named(i + 1) and y.word(i + 2) == "=":
            out.append((kw("const"), "const", new))
            i += 1
            continue
        if w == "export" and y.word(i + 1) == "=":
            out.append(("i", "_", new))
            i += 1
            continue
        if w == "type" and y.word(i - 1) in ("import", "export", "{", ",") and (y.named(i + 1) or y.sym(i + 1) == "{" or y.word(i + 1) == "*") and y.word(i + 1) not in ("from", "as"):
            i += 1
            continue
        if w in ("override", "accessor") and y.named(i + 1):
            i += 1
            continue
        out.append(t[i])
        i += 1
    return out


def _imported(t: list[Token]) -> bool:
    depth = 0
    for k in range(len(t) - 1, -1, -1):
        s = t[k][0]
        depth += (s == "}") - (s == "{")
        if depth < 0:
            return k > 0 and t[k - 1][1] in ("import", "export", ",", "type")
    return False


def csharp(t: list[Token], kw: Callable[[str], str]) -> list[Token]:
    """C#: bounds of type parameters, filters, accessors, operators, queries, patterns, attributes."""
    sym = lambda i: t[i][0] if 0 <= i < len(t) else ""
    word = lambda i: t[i][1] if 0 <= i < len(t) else ""
    name = lambda i: bool(re.fullmatch(r"@?[A-Za-z_]\w*", word(i)))
    out: list[Token] = []
    i = 0
    while i < len(t):
        s, w, new = t[i]
        p = out[-1][1] if out else ""
        begins = not out or p in ("{", "}", ";")
        if w == "where" and name(i + 1) and word(i + 2) == ":":
            j = i + 3
            while j < len(t) and word(j) not in ("{", ";", "=>", "where"):
                j = closing(t, j) if sym(j) == "(" else j
                if j < 0 or not (name(j) or word(j) in (",", "<", ">", ">>", ".", "?", "(", ")", "[", "]")):
                    break
                j += 1
            if j > 0 and word(j) in ("{", ";", "=>", "where"):
                i = j
                continue
        if w == "when" and (p == ")" or out and out[-1][0] == "i"):
            out.append((kw("when"), w, new))
            i += 1
            continue
        if w in ("get", "set", "init", "add", "remove") and word(i + 1) in ("{", "=>", ";"):
            out.append(("i", w, new))
            i += 1
            continue
        if w == "operator":
            j = i + 1
            while j < len(t) and sym(j) != "(" and j < i + 4:
                j += 1
            if sym(j) == "(":
                while out and out[-1][1] in ("implicit", "explicit"):
                    out.pop()
                out.append(("i", w, new))
                i = j
                continue
        if w == "this" and sym(i + 1) == "[" and name(i - 1) and closing(t, i + 1) > 0 and word(closing(t, i + 1) + 1) in ("{", "=>"):
            i = closing(t, i + 1) + 1
            out.append(("i", "_", new))
            continue
        if w == "from" and name(i + 1) and (word(i + 2) == "in" or name(i + 2) and word(i + 3) == "in"):
            j, depth, query = i, 0, []
            while j < len(t):
                if sym(j) in OPEN and sym(j):
                    depth += 1
                elif sym(j) in SHUT and sym(j):
                    depth -= 1
                if depth < 0 or depth == 0 and word(j) in (";", ","):
                    break
                query.append(t[j])
                j += 1
            done = clauses(query)
            if done:
                out += done
                i = j
                continue
        if w == "[" and (begins or p in ("(", ",", "]") or p == "") and closing(t, i) > 0:
            j = closing(t, i) + 1
            if (name(j) or sym(j) == "[" or word(j) in _CS_AFTER) and name(i + 1) and p not in ("]",) and not (p in ("(", ",") and not name(j)):
                i = j
                continue
        if w == "~" and name(i + 1) and begins:
            i += 1
            continue
        if w == ":" and p == ")" and word(i + 1) in ("base", "this") and sym(i + 2) == "(":
            j = closing(t, i + 2)
            if j > 0 and word(j + 1) in ("{", "=>"):
                i = j + 1
                continue
        if w in ("in", "out") and p in ("<", ",") and name(i + 1) and word(i + 2) in (",", ">"):
            i += 1
            continue
        if w == "await" and word(i + 1) in ("foreach", "using"):
            i += 1
            continue
        if w in ("checked", "unchecked", "unsafe", "fixed") and word(i + 1) == "{":
            i += 1
            continue
        if w == "record" and word(i + 1) in ("class", "struct"):
            i += 1
            continue
        if w in ("class", "struct", "record", "interface") and name(i + 1):
            out.append((kw("class"), w, new) if w == "record" else t[i])
            out.append(("i", word(i + 1), False))
            i += 2
            if word(i) == "<":
                j = i + 1
                while j < len(t) and (name(j) or word(j) in (",", ">", "[", "]")) and word(j - 1) != ">":
                    j += 1
                i = j if word(j - 1) == ">" else i
            if sym(i) == "(" and closing(t, i) > 0:
                i = closing(t, i) + 1
            continue
        if w in ("required", "file", "scoped") and name(i + 1):
            i += 1
            continue
        if w == "." and word(i + 1) == "." or w == "..":
            out.append(("m", "..", new))
            if not out[:-1] or out[-2][1] in ("[", ",", "("):
                out.pop()
            i += 2 if w == "." else 1
            if word(i) in ("]", ")", ","):
                out.append(("i", "_", False))
            continue
        if w == "=" and p == "}" and not new:
            # The first value of a property after its accessors.
            out.append(("i", "_", False))
        if w == "^" and p in ("[", "..", ","):
            i += 1
            continue
        if w in ("and", "or") and out and (out[-1][0] in ("i", "n", "s") or p in (")", "]", "}", ">")) and (name(i + 1) or sym(i + 1) in ("n", "s", "(", "{", "<", ">", "o")):
            out.append(("o", "&&", new))
            i += 1
            continue
        if w == "not" and (name(i + 1) or sym(i + 1) in ("n", "s", "(", "{", "<", ">", "o")) and (p in ("is", "(", "and", "or", "&&", "case", "{", ",", ":") or True):
            i += 1
            continue
        if w in ("<", ">", "<=", ">=") and p in ("is", "&&", ":", "{", ",", "(", "case") and (sym(i + 1) in ("n", "s", "i") or word(i + 1) == "-"):
            i += 1
            continue
        if s == "i" and out and (out[-1][0] == "i" or p in ("}", ">", "]", "?")) and word(i + 1) in ("when", "=>") and _in_switch(out):
            i += 1
            continue
        if s == "i" and out and p == "}" and word(i + 1) in (")", "&&", ";", ",", "?") and not new:
            i += 1
            continue
        if w == "{" and out and _in_switch(out) and (out[-1][0] == "i" or p in ("{", ",", ")")) and closing(t, i) > 0 and word(closing(t, i) + 1) != ";" and p != "switch":
            # What a pattern asks of members.
            if out[-1][0] != "i":
                out.append(("i", "_", new))
            i = closing(t, i) + 1
            continue
        if w == "{" and word(i + 1) == "}":
            out += [t[i], (";", ";", False), t[i + 1]]
            i += 2
            continue
        if s == "n" and w.endswith(".") and word(i + 1) == ".":
            out += [t[i], ("m", "..", False)]
            i += 2
            continue
        if w == "<>" and out and out[-1][0] == "i":
            i += 1
            continue
        if w == "default" and p not in ("{", "}", ";", ":") and word(i + 1) not in (":",):
            out.append(("i", w, new))
            i += 1
            continue
        if w == "namespace" and name(i + 1):
            j = i + 1
            while name(j) or word(j) == ".":
                j += 1
            if word(j) == ";":
                i = j + 1
                continue
        if w == "goto":
            out.append((kw("return"), w, new))
            i += 1
            continue
        if s == "i" and word(i + 1) == ":" and begins and word(i + 2) not in (":",):
            i += 2
            continue
        if w == "using" and name(i + 1) and word(i + 2) == "=":
            i += 3
            out.append((kw("using"), w, new))
            continue
        out.append(t[i])
        i += 1
    return out


_CS_AFTER = {"public", "private", "protected", "internal", "static", "readonly", "const", "async", "abstract", "sealed", "override", "virtual", "partial", "extern", "new", "class", "struct", "interface", "enum", "record", "delegate", "event", "void", "ref", "in", "out", "params", "unsafe"}


def _in_switch(t: list[Token]) -> bool:
    depth = 0
    for k in range(len(t) - 1, -1, -1):
        s = t[k][0]
        if s and s in SHUT:
            depth += 1
        elif s and s in OPEN:
            if depth == 0:
                return s == "{" and k > 0 and (t[k - 1][1] == "switch" or t[k - 1][1] in ("is", "not") or _in_switch(t[:k]) and t[k - 1][0] == "i")
            depth -= 1
    return False


def clauses(query: list[Token]) -> list[Token]:
    """A query as a group of its expressions; [] where a clause is empty or the query does not end in select or group."""
    out: list[Token] = [("(", "(", False)]
    heads = {"from", "in", "where", "orderby", "select", "let", "join", "on", "equals", "into", "group", "by"}
    depth, last, full = 0, "", False
    final = False
    for k, (s, w, _) in enumerate(query):
        if s and s in OPEN:
            depth += 1
        elif s and s in SHUT:
            depth -= 1
        if depth == 0 and w in heads and s not in ("s",):
            if k and not full:
                return []
            if k:
                out.append(("k", ",", False))
            last, full = w, False
            final |= w in ("select", "by")
        elif depth == 0 and w in ("ascending", "descending"):
            pass
        else:
            full = True
            out.append((s, w, False))
    # "from T x in" names a type before the variable.
    return [*out, (")", ")", False)] if full and final and last else []


def sql(t: list[Token], kw: Callable[[str], str]) -> list[Token]:
    """SQL: named queries, merges, windows, options of columns and tables, and statements of cursors and rights."""
    low = [w.lower() for _, w, _ in t]
    sym = lambda i: t[i][0] if 0 <= i < len(t) else ""
    word = lambda i: low[i] if 0 <= i < len(t) else ""
    out: list[Token] = []
    e = ("i", "_", False)
    semi = (";", ";", False)
    merging = False
    i = 0
    while i < len(t):
        s, w, new = t[i]
        v = low[i]
        p = out[-1][1].lower() if out else ""
        if v == "with" and sym(i + 1) == "i":
            j, ok = i + 1, True
            while ok:
                ok = sym(j) == "i"
                j += 1
                if ok and sym(j) == "(":
                    j = closing(t, j) + 1
                ok = ok and j > 0 and word(j) == "as" and sym(j + 1) == "("
                if not ok:
                    break
                k = closing(t, j + 1)
                ok = k > 0
                if not ok:
                    break
                # The named query itself is read as a statement of its own.
                out += [*sql(t[j + 2 : k], kw), semi]
                j = k + 1
                if word(j) != ",":
                    break
                j += 1
            if ok and word(j) in ("select", "insert", "update", "delete", "merge"):
                i = j
                continue
        if v == "merge":
            j = i + 1 + (word(i + 1) == "into")
            merging = True
            out += [(kw("Select"), "select", new), e, (kw("From"), "from", False)]
            i = j
            continue
        if merging and v == "using":
            out.append((kw("Join"), "join", False))
            i += 1
            continue
        if merging and v == "when":
            j = i + 1 + (word(i + 1) == "not")
            if word(j) == "matched":
                j += 1
                if word(j) == "by" and word(j + 1) in ("target", "source"):
                    j += 2
                cond = []
                if word(j) == "and":
                    k = j + 1
                    while k < len(t) and word(k) != "then":
                        k += 1
                    cond, j = t[j + 1 : k], k
                if word(j) == "then" and word(j + 1) in ("update", "insert", "delete"):
                    out.append(semi)
                    if cond:
                        out += [(kw("If"), "if", False), *cond]
                    out.append(t[j + 1])
                    out.append(e)
                    i = j + 2
                    if word(j + 1) == "insert" and word(i) == "values":
                        pass
                    continue
        if v == ";":
            merging = False
        if v in ("over", "group") and sym(i + 1) == "(" and p in (")", "_") and closing(t, i + 1) > 0 and (v == "over" or p == "within"):
            i = closing(t, i + 1) + 1
            continue
        if v == "within" and word(i + 1) == "group" and sym(i + 2) == "(" and closing(t, i + 2) > 0:
            i = closing(t, i + 2) + 1
            continue
        if v == "begin" and word(i + 1) in ("try", "catch") or v == "end" and word(i + 1) in ("try", "catch"):
            out.append(t[i])
            i += 2
            continue
        if v in ("begin", "commit", "rollback") and word(i + 1) in ("transaction", "tran"):
            i += 2 + (sym(i + 2) == "i")
            out += [(kw("Break"), "break", new), semi]
            i += word(i) == ";"
            continue
        if v == "offset" and word(i + 2) in ("row", "rows"):
            i += 3
            if word(i) == "fetch" and word(i + 1) in ("next", "first") and word(i + 3) in ("row", "rows") and word(i + 4) == "only":
                i += 5
            continue
        if v == "output" and word(i + 1) in ("inserted", "deleted", "$action"):
            j = i + 1
            while sym(j) in ("i", "d", "k", "x") and word(j) != "into" and word(j) not in ("values", "select"):
                j += 1
            j += 2 if word(j) == "into" else 0
            i = j
            continue
        if v == "escape" and sym(i + 1) == "s":
            i += 2
            continue
        if v == "collate" and sym(i + 1) == "i":
            i += 2
            continue
        if v == "for" and word(i + 1) in ("json", "xml"):
            i += 3
            while word(i) == "," or sym(i) == "(":
                i = closing(t, i) + 1 if sym(i) == "(" else i + 2
            continue
        if v == "on" and word(i + 1) in ("delete", "update") and word(i + 2) in ("cascade", "no", "set"):
            i += 3 if word(i + 2) == "cascade" else 4
            continue
        if v in ("cross", "outer") and word(i + 1) == "apply":
            out += [(kw("Cross"), "cross", new), (kw("Join"), "join", False)]
            i += 2
            continue
        if v in ("except", "intersect"):
            out.append((kw("Union"), "union", new))
            i += 1
            continue
        if v == "as" and sym(i + 1) == "i" and sym(i + 2) == "(" and p == ")" and closing(t, i + 2) > 0:
            out += [t[i], t[i + 1]]
            i = closing(t, i + 2) + 1
            continue
        if v == "(" and word(i + 1) == "values" and closing(t, i) > 0 and p in ("from", "join", ","):
            i = closing(t, i) + 1
            out.append(e)
            continue
        if v in ("clustered", "nonclustered", "persisted"):
            i += 1
            continue
        if v == "include" and sym(i + 1) == "(" and p == ")" and closing(t, i + 1) > 0:
            i = closing(t, i + 1) + 1
            if word(i) == "where":
                i = max(i, until(t, i, lambda k: word(k) == ";"))
            continue
        if v == "default" and p not in ("values", "into", "=", "(", ",") and (sym(i + 1) in ("n", "s", "(", "i") or word(i + 1) in ("null",) or word(i + 1) in ("-", "+")):
            j = i + 1 + (word(i + 1) in ("-", "+"))
            j = closing(t, j) + 1 if sym(j) == "(" else j + 1
            if sym(j) == "(" and closing(t, j) > 0:
                j = closing(t, j) + 1
            i = j if j > 0 else i + 1
            continue
        if v == "as" and p and out[-1][0] == "i" and _in_table(out) and (sym(i + 1) in ("i", "(")):
            j = i + 1
            depth = 0
            while j < len(t):
                if sym(j) == "(":
                    depth += 1
                elif sym(j) == ")":
                    if depth == 0:
                        break
                    depth -= 1
                elif depth == 0 and word(j) == ",":
                    break
                j += 1
            out.append(e)
            i = j
            continue
        if v in ("grant", "revoke", "deny", "open", "close", "deallocate", "fetch") and (not out or p in (";", "begin", "go") or new):
            j = until(t, i + 1, lambda k: word(k) == ";" or t[k][2])
            if j > i + 1:
                out += [(kw("Break"), "break", new)]
                i = j
                continue
        if v == "cursor" and "declare" in [x[1].lower() for x in out[-2:]]:
            j = i + 1
            while j < len(t) and word(j) != "for":
                j += 1
            if word(j) == "for":
                out[-2:] = []
                i = j + 1
                continue
        if v in ("after", "instead") and "trigger" in [x[1].lower() for x in out[-5:]]:
            i += 1 + (word(i + 1) == "of")
            continue
        if v == "drop" and word(i + 1) in ("column", "constraint") and sym(i + 2) == "i":
            out += [t[i], t[i + 2]]
            i += 3
            continue
        if v == "add" and word(i + 1) == "constraint":
            j = until(t, i + 3, lambda k: word(k) == ";" or t[k][2] and word(k) in ("alter", "create", "go", "select"))
            if j > 0:
                out += [t[i], e, e]
                i = j
                continue
        if v == "if" and word(i + 1) == "exists" and p in ("table", "view", "procedure", "function", "index", "trigger"):
            i += 2
            continue
        if v == "with" and sym(i + 1) == "(" and out and (out[-1][0] == "i" or p == ")"):
            j = closing(t, i + 1)
            if j > 0:
                i = j + 1
                continue
        out.append(t[i])
        i += 1
    return out


def _in_table(t: list[Token]) -> bool:
    depth = 0
    for k in range(len(t) - 1, -1, -1):
        s = t[k][0]
        if s == ")":
            depth += 1
        elif s == "(":
            if depth == 0:
                return any(x[1].lower() == "table" for x in t[max(0, k - 4) : k])
            depth -= 1
    return False


_BASIC = [(re.compile(p, re.I | re.M), r) for p, r in (
    (r"^[ \t]*#[ \t]*(?:If|ElseIf|Else|End|Region|Const|ExternalSource|Disable|Enable)\b[^\n]*", ""),
    (r"^[ \t]*On[ \t]+Error\b[ \t]+(?:Resume[ \t]+Next|GoTo[ \t]+\w+)[ \t]*$", ""),
    (r"^[ \t]*(?:(?:Public|Private|Friend|Protected|Shadows)[ \t]+)*(?:Delegate[ \t]+(?:Sub|Function)|Custom[ \t]+Event)[ \t]+\w+[ \t]*\([^()\n]*\)(?:[ \t]+As[ \t]+[\w.]+(?:\([^()\n]*\))?)?[ \t]*$", ""),
    (r"^([ \t]*)(?:(?:Public|Shared|Overloads|Shadows|Widening|Narrowing)[ \t]+)*Operator[ \t]+[^\s(]+[ \t]*\(", r"\1Function Op("),
    (r"^([ \t]*)End[ \t]+Operator\b", r"\1End Function"),
    (r"^([^'\"\n]*=[ \t]*)(?:Async[ \t]+)?(Sub|Function)[ \t]*(\([^()\n]*\))[ \t]*(?:As[ \t]+[\w.]+(?:\([^()\n]*\))?)?[ \t]*$", r"\1x" + "\n" + r"\2 L\3"),
    (r"\bNew[ \t]+With[ \t]*\{[^{}\n]*\}", "x"), (r"\bFrom[ \t]*\{(?:[^{}\n]|\{[^{}\n]*\})*\}", ""),
    (r"([=(,][ \t]*)(?:From|Aggregate)[ \t]+\w+[ \t]+(?:As[ \t]+[\w.]+[ \t]+)?In[ \t]+[^\n]*?\bSelect[ \t]+[\w.]+", r"\1x"),
    (r"\bAddressOf[ \t]+", ""), (r"\bTypeOf[ \t]+(?=[\w.]+[ \t]+(?:Is|IsNot)[ \t])", ""),
    (r"^[^'\"\n]*\bMustOverride\b[^\n]*", ""),
)]
_INTERFACE = re.compile(r"^([ \t]*(?:(?:Public|Private|Friend|Protected|Partial|Shadows)[ \t]+)*Interface\b[^\n]*\n)([\s\S]*?)(^[ \t]*End[ \t]+Interface\b)", re.I | re.M)
_MEMBER = re.compile(r"^[ \t]*(?:(?:ReadOnly|WriteOnly|Default|Overloads|Shadows)[ \t]+)*(?:Sub|Function|Property|Event)[ \t]+\w+[ \t]*(?:\([^\n]*\))?(?:[ \t]+As[ \t]+[^\n]+)?[ \t]*$", re.I | re.M)


def basic(text: str) -> str:
    """VB: lines of its preprocessor, members of interfaces, operators, queries and smaller forms as common ones."""
    text = _INTERFACE.sub(lambda m: m.group(1) + _MEMBER.sub("", m.group(2)) + m.group(3), text)
    for p, r in _BASIC:
        text = p.sub(r, text)
    return text
