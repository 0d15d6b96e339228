"""TypeScript and JavaScript declarations and calls from a token stream: one scanner for statements, class bodies and expressions.

Names are ``module:Name`` and ``module:Class#member``, the module being the file's path without its extension. Imports, exports
and re-exports are rows of ``imports`` (``kind`` import, export, reexport; ``orig`` is the name on the other side). Types
that annotations don't spell (inferred ones, unions of several types) are left out rather than guessed.
"""

from __future__ import annotations

import re

from callweave.extract.java import Parser, Token
from callweave.extract.rows import Found

TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>"(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`)|(?P<num>\d[\w.]*)|(?P<id>[#@]?[A-Za-z_$][\w$]*)|(?P<op>\?\.(?!\d)|=>|\.\.\.|[=!]==?|.)""", re.DOTALL)
PATTERN = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: The language's words.
MODIFIERS = {"public", "private", "protected", "readonly", "static", "abstract", "async", "override", "declare", "accessor", "get", "set"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "return", "throw", "try", "do", "else", "case", "new", "typeof", "await", "yield", "in", "of", "instanceof", "void", "delete", "function", "with", "import"}
BEFORE_PATTERN = {"return", "typeof", "case", "in", "of", "await", "yield", "throw", "else", "do", "void", "delete"}


def lex(text: str) -> list[Token]:
    """Tokens; ``?.`` reads as a dot, ``!`` before a dot is left out, and what a template embeds follows it in brackets."""
    out: list[Token] = []
    at, line = 0, 1
    while at < len(text):
        last = out[-1] if out else None
        m = None
        if text[at] == "/" and (last is None or (last.kind == "op" and last.text not in ")]}") or last.text in BEFORE_PATTERN):
            m = PATTERN.match(text, at)
        kind = "num" if m else None
        m = m or TOKEN.match(text, at)
        kind = kind or m.lastgroup
        if kind != "skip":
            word = "." if m[0] == "?." else m[0]
            if word == "." and last and last.text == "!":
                out.pop()
            out.append(Token(kind, word, at, line))
            if kind == "str" and word[0] == "`":
                for inner in re.finditer(r"\$\{([^{}`]*)\}", word):
                    here = line + word.count("\n", 0, inner.start())
                    out.append(Token("op", "(", at, here))
                    out += [Token(t.kind, t.text, at + inner.start(1) + t.at, here + t.line - 1) for t in lex(inner[1])]
                    out.append(Token("op", ")", at, here))
        line += m[0].count("\n")
        at = m.end()
    return out


def module_path(path: str) -> str:
    return re.sub(r"\.(d\.)?([cm]?[jt]s|[jt]sx)$", "", path)


def plain_type(text: str | None) -> tuple[str | None, str | None]:
    """(type, its single argument): null and undefined left out, arrays keep ``[]``; neither for a union of several types or a literal type."""
    if not text:
        return None, None
    parts = [p for p in _split(text, "|") if p not in ("null", "undefined", "")]
    if len(parts) != 1:
        return None, None
    one = parts[0].removeprefix("readonly ").strip("()")
    if m := re.fullmatch(r"(?:Readonly)?Array<(.+)>", one):
        one = m[1] + "[]"
    if not re.fullmatch(r"[A-Za-z_$][\w$.]*(<.*>)?(\[\])*", one, re.DOTALL):
        return None, None
    inner = re.fullmatch(r"[^<]*<([\w$.]+)>.*", one)
    return re.sub(r"<.*>", "", one, flags=re.DOTALL), inner[1] if inner else None


def _split(text: str, mark: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, c in enumerate(text):
        depth += (c in "<([{") - (c in ")]}" or (c == ">" and text[i - 1 : i] != "="))
        if c == mark and not depth:
            out.append(text[start:i].strip())
            start = i + 1
    return [*out, text[start:].strip()]


class Script(Parser):
    def __init__(self, text: str, path: str) -> None:
        self.text, self.t, self.out = text, lex(text), Found(package=module_path(path))
        self.t += [Token("op", "", len(text), self.t[-1].line if self.t else 1)] * 8  # looking ahead never leaves the list
        self.module, self.match = self.out.package, self._matches()
        self.closing: dict[int, int] = {}
        self.pending: list[tuple[int, int]] = []

    def parse(self) -> Found:
        self.scan(0, len(self.t), None, None)
        for local, end in self.pending:
            self.out.locals[local]["owner_seq"] = self.closing.get(end)
        return self.out

    # Rows

    def declare(self, name: str, kind: str, owner: str | None, a: int, b: int, **more) -> int:
        fqn = f"{owner}#{name}" if owner else f"{self.module}:{name}"
        last = self.t[min(max(b, a), len(self.t) - 1)]
        row = {"name": name, "fqn": fqn, "kind": kind, "container_fqn": owner or self.module, "type_name": None, "type_args": None, "signature": name, "arity": None, "params": [], "start_line": self.t[a].line, "end_line": last.line, "start_byte": self.t[a].at, "end_byte": last.at + len(last.text), "modifiers": [], "annotations": [], "supertypes": []}
        return self.out.add("symbols", **(row | more))

    def linked(self, kind: str, simple: str | None, orig: str | None, module: str | None = None) -> None:
        self.out.add("imports", fqn=self.module if module is None else module, simple=simple, is_wildcard=int(orig == "*"), is_static=0, kind=kind, orig=orig)

    def bind(self, scope: int | None, name: str, line: int, kind: str, typed: str | None = None) -> int:
        base, inner = plain_type(typed)
        return self.out.add("locals", scope_seq=scope, name=name, type_name=base, type_args=inner, owner_seq=None, line=line, init_kind=kind, init_path=None)

    # Types and parameters

    def type_after(self, i: int) -> tuple[str, int]:
        """The text of a type from token ``i`` and the index after it."""
        a, depth = i, 0
        while i < len(self.t):
            t = self.t[i]
            new_line = i > a and t.line > self.t[i - 1].line and self.text_at(i - 1) not in ("|", "&", "<", ",", "=>") and t.text not in ("|", "&", ".")
            if not depth and (t.text in (",", ")", "=", ";", "}", "]") or (i > a and (t.text == "{" and self.text_at(i - 1) not in ("|", "&", "=>")) or new_line or (t.text == "=>" and self.text_at(i - 1) != ")"))):
                break
            if t.text == "=>" and not depth and self.text_at(a) != "(":
                break
            depth += (t.text == "<") - (t.text == ">")
            i = self.end_of(i) + 1 if t.text in ("(", "[", "{") else i + 1
        return self.joined(a, i), i

    def parts(self, open_: int) -> list[tuple[int, int]]:
        """Where each of a bracket's comma-separated parts begins and ends."""
        close, out, i, start, depth = self.end_of(open_), [], open_ + 1, open_ + 1, 0
        while i <= close:
            w = self.text_at(i)
            depth += (w == "<") - (w == ">" and depth > 0)
            if i == close or (w == "," and not depth):
                if i > start:
                    out.append((start, i))
                start = i + 1
            i = self.end_of(i) + 1 if i < close and w in ("(", "[", "{") else i + 1
        return out

    def parameters(self, open_: int) -> list[dict]:
        out = []
        for a, b in self.parts(open_):
            marks, i = set(), a
            while i < b and (self.text_at(i).startswith("@") or self.text_at(i) in MODIFIERS and self.t[i + 1].kind == "id" or self.text_at(i) == "..."):
                if self.text_at(i).startswith("@") and self.text_at(i + 1) == "(":
                    i = self.end_of(i + 1)
                marks.add(self.text_at(i))
                i += 1
            name, at = (self.text_at(i), i) if self.t[i].kind == "id" else (None, i)
            i = self.end_of(i) + 1 if self.text_at(i) in ("{", "[") else i + 1
            i += self.text_at(i) == "?"
            typed = self.type_after(i + 1)[0] if self.text_at(i) == ":" and i < b else None
            out.append({"name": name, "type": typed, "marks": sorted(marks & MODIFIERS), "rest": "..." in marks, "at": at})
        return out

    def head(self, open_: int) -> tuple[list[dict], str | None, int]:
        """Parameters, declared result and the index after both."""
        i, result = self.end_of(open_) + 1, None
        if self.text_at(i) == ":":
            result, i = self.type_after(i + 1)
            result = re.sub(r"^(asserts\s+)?\w+ is .*|this$", "", result) or None
        return self.parameters(open_), result, i

    def arrow(self, i: int) -> int | None:
        """The index of an arrow function's ``(`` or bare parameter, if one starts at ``i``."""
        i += self.text_at(i) == "async"
        if self.text_at(i) == "<" and (after := next((k for k in range(i, min(i + 64, len(self.t))) if self.text_at(k) == ">"), None)):
            i = after + 1
        if self.text_at(i) == "(":
            return i if self.text_at(self.head(i)[2]) == "=>" else None
        return i if i < len(self.t) and self.t[i].kind == "id" and self.text_at(i + 1) == "=>" else None

    def expression_end(self, i: int) -> int:
        """The index after an expression: at a comma, a semicolon, a closing bracket, or a line's end where no operator goes on."""
        a = i
        while i < len(self.t) and self.text_at(i) not in (",", ";", ")", "]", "}"):
            t = self.t[i]
            if i > a and t.line > self.t[i - 1].line and t.kind != "op" and self.t[i - 1].kind != "op":
                break
            if i > a and t.line > self.t[i - 1].line and t.kind == "id" and self.text_at(i - 1) in (")", "]", "}"):
                break
            i = self.end_of(i) + 1 if t.text in ("(", "[", "{") else i + 1
        return i

    def function(self, name: str, kind: str, owner: str | None, start: int, open_: int, more: dict) -> int:
        """Declares what has parameters at ``open_``, reads its body, gives the index after it."""
        bare = self.text_at(open_) != "("
        params, result, i = ([{"name": self.text_at(open_), "type": None, "marks": [], "rest": False, "at": open_}], None, open_ + 1) if bare else self.head(open_)
        arrow = self.text_at(i) == "=>"
        i += arrow
        block = self.text_at(i) == "{"
        end = self.end_of(i) if block else self.expression_end(i) if arrow else i
        base, inner = plain_type(result)
        types = [(p["type"] or "any") + ("..." if p["rest"] else "") for p in params]
        symbol = self.declare(name, kind, owner, start, end, type_name=base or (self.built(i, end) if block else None), type_args=inner, arity=len(params), params=types, signature=f"{name}({', '.join(types)})", **more)
        for p in params:
            if p["name"]:
                self.bind(symbol, p["name"], self.t[p["at"]].line, "param", p["type"])
                if kind == "constructor" and p["marks"]:
                    field, arg = plain_type(p["type"])
                    self.declare(p["name"], "field", owner, p["at"], p["at"], type_name=field, type_args=arg, modifiers=[*p["marks"], "parameter-property"])
        if block or arrow:
            self.scan(i + block, end, symbol, owner)
        return end + block

    def built(self, a: int, b: int) -> str | None:
        """The type that every ``return`` of a body makes with ``new``, if they agree."""
        made = {self.text_at(i + 2) if self.text_at(i + 1) == "new" else None for i in range(a, b) if self.text_at(i) == "return"}
        return made.pop() if len(made) == 1 else None

    # Statements

    def scan(self, a: int, b: int, scope: int | None, owner: str | None) -> None:
        i = a
        while i < b:
            t = self.t[i]
            if t.kind != "id":
                if t.text == "(" and self.text_at(self.end_of(i) + 1) in ("=>", ":") and self.arrow(i) is not None:
                    for p in self.parameters(i):
                        if p["name"]:
                            self.bind(scope, p["name"], t.line, "lambda", p["type"])
                i += 1
                continue
            member = self.text_at(i - 1) == "."
            i = (None if member else self.statement(i, scope)) or self.expression(i, scope, owner) or i + 1

    def statement(self, i: int, scope: int | None) -> int | None:
        """The index after a declaration's head, or after all of it; None if ``i`` starts none."""
        w, start, marks = self.text_at(i), i, []
        if w == "import" and self.text_at(i + 1) not in ("(", "."):
            return self.imported(i + 1)
        if w == "export":
            marks, i = ["export"], i + 1
            if self.text_at(i) == "default":
                marks, i = [*marks, "default"], i + 1
            elif self.text_at(i) in ("{", "*") or (self.text_at(i) == "type" and self.text_at(i + 1) == "{"):
                return self.exports(i + (self.text_at(i) == "type"))
        while self.text_at(i) in ("abstract", "declare", "async") and i + 1 < len(self.t) and self.t[i + 1].kind == "id":
            marks, i = [*marks, self.text_at(i)], i + 1
        w, after = self.text_at(i), self.text_at(i + 1)
        if w == "const" and after == "enum":
            w, i = "enum", i + 1
        named = i + 1 < len(self.t) and self.t[i + 1].kind == "id"
        if w in ("class", "interface", "enum") and (named or (w == "class" and "default" in marks)):
            return self.type_body(i, w, marks, start)
        if w == "function":
            k = i + 1 + (after == "*")
            name = self.text_at(k) if k < len(self.t) and self.t[k].kind == "id" else "default" if "default" in marks else None
            open_ = next((j for j in range(k, min(k + 64, len(self.t))) if self.text_at(j) == "("), None)
            return self.function(name, "function", None, start, open_, {"modifiers": marks}) if name and open_ else None
        if w in ("const", "let", "var"):
            return self.variable(i + 1, scope, marks, start)
        if w in ("exports", "module") and after == ".":
            return self.assigned(i)
        if "default" in marks:
            if self.arrow(i) is not None:
                return self.function("default", "function", None, start, self.arrow(i), {"modifiers": marks})
            if i < len(self.t) and self.t[i].kind == "id":
                self.linked("export", "default", w)
        return i if marks else None

    def imported(self, i: int) -> int:
        i += self.text_at(i) == "type" and self.text_at(i + 1) != "from"
        names: list[tuple[str, str]] = []
        while i < len(self.t) and self.t[i].kind != "str" and self.text_at(i) not in (";", "="):
            if self.text_at(i) == "{":
                names += self.pairs(i)
                i = self.end_of(i)
            elif self.text_at(i) == "*" and self.text_at(i + 1) == "as":
                names.append((self.text_at(i + 2), "*"))
                i += 2
            elif self.t[i].kind == "id" and self.text_at(i) != "from":
                names.append((self.text_at(i), "default"))
            i += 1
        if self.text_at(i) == "=" and self.text_at(i + 1) == "require":
            names, i = [(n, "*") for n, _ in names], i + 3
        if i < len(self.t) and self.t[i].kind == "str":
            for simple, orig in names or [(None, None)]:
                self.linked("import", simple, orig, self.t[i].text[1:-1])
        return i + 1

    def pairs(self, open_: int, mark: str = "as") -> list[tuple[str, str]]:
        """(name here, name there) of ``{ there as here, same }``."""
        out = []
        for a, b in self.parts(open_):
            a += self.text_at(a) == "type" and b - a > 1 and self.text_at(a + 1) != mark
            if self.t[a].kind in ("id", "str"):
                there = self.text_at(a)
                out.append((self.text_at(a + 2) if self.text_at(a + 1) == mark and b - a > 2 else there, there))
        return out

    def exports(self, i: int) -> int:
        names = self.pairs(i) if self.text_at(i) == "{" else [(self.text_at(i + 2) if self.text_at(i + 1) == "as" else "*", "*")]
        i = self.end_of(i) + 1 if self.text_at(i) == "{" else i + (3 if names[0][0] != "*" else 1)
        source = self.t[i + 1].text[1:-1] if self.text_at(i) == "from" and i + 1 < len(self.t) else None
        for here, there in names:
            self.linked("reexport" if source is not None else "export", here, there, source)
        return i + 2 if source is not None else i

    def assigned(self, i: int) -> int | None:
        """``exports.x = ...``, ``module.exports.x = ...`` and ``module.exports = ...``."""
        k = i + 2 if self.text_at(i) == "module" and self.text_at(i + 2) == "exports" else i if self.text_at(i) == "exports" else None
        if k is None:
            return None
        name, at = (self.text_at(k + 2), k + 3) if self.text_at(k + 1) == "." else ("default", k + 1)
        if self.text_at(at) != "=":
            return None
        value = at + 1
        open_ = self.arrow(value)
        if open_ is None and self.text_at(value + (self.text_at(value) == "async")) == "function":
            open_ = next((j for j in range(value, min(value + 8, len(self.t))) if self.text_at(j) == "("), None)
        if open_ is not None:
            return self.function(name, "function", None, i, open_, {"modifiers": ["export", *(["default"] if name == "default" else [])]})
        if self.text_at(value) == "{":
            for here, there in [(x, y) for y, x in self.pairs(value, ":")]:
                self.linked("export", here, there)
        elif self.t[value].kind == "id" and self.text_at(value) not in ("new", "class", "require"):
            self.linked("export", name, self.text_at(value))
        return value

    def variable(self, i: int, scope: int | None, marks: list[str], start: int) -> int:
        """One declarator of ``const``, ``let`` or ``var``; its initialiser is left to the scanner unless it is a function."""
        line = self.t[i].line if i < len(self.t) else 0
        if self.text_at(i) in ("{", "["):
            names, after = self.pairs(i, ":") if self.text_at(i) == "{" else [], self.end_of(i) + 1
            if self.text_at(after) == "=" and self.text_at(after + 1) == "require" and after + 3 < len(self.t):
                for there, here in [(y, x) for x, y in names]:
                    self.linked("import", here, there, self.t[after + 3].text[1:-1])
                return self.end_of(after + 2) + 1
            for here, _ in names:
                self.bind(scope, here, line, "destructured")
            return after
        name, typed, k = self.text_at(i), None, i + 1
        k += self.text_at(k) == "!"
        if self.text_at(k) == ":":
            typed, k = self.type_after(k + 1)
        if self.text_at(k) != "=":
            self.bind(scope, name, line, "declared", typed)
            return k
        v = k + 1
        if self.text_at(v) == "require" and self.text_at(v + 1) == "(" and v + 2 < len(self.t) and self.t[v + 2].kind == "str":
            member = self.text_at(v + 5) if self.text_at(v + 4) == "." else "*"
            self.linked("import", name, member, self.t[v + 2].text[1:-1])
            return self.end_of(v + 1) + 1
        open_ = self.arrow(v)
        if open_ is None and self.text_at(v + (self.text_at(v) == "async")) == "function":
            open_ = next((j for j in range(v, min(v + 8, len(self.t))) if self.text_at(j) == "("), None)
        if open_ is not None:
            return self.function(name, "function", None, start, open_, {"modifiers": marks})
        if "export" in marks:
            self.declare(name, "field", None, start, v, modifiers=marks, type_name=plain_type(typed)[0])
        waits = self.text_at(v) == "await"
        if typed is None and self.text_at(v + waits) == "new":
            typed = self.joined(v + waits + 1, self.dotted(v + waits + 1) + 1)
        local = self.bind(scope, name, line, "await" if waits else "call", typed)
        end = self.expression_end(v)
        if typed is None and self.text_at(end - 1) == ")":
            self.pending.append((local, end - 1))
        return v

    # Types

    def type_body(self, i: int, kind: str, marks: list[str], start: int) -> int:
        name = self.text_at(i + 1) if self.t[i + 1].kind == "id" and self.text_at(i + 1) not in ("extends", "implements") else "default"
        k, supers, depth = i + 1 + (name != "default"), [], 0
        while k < len(self.t) and not (self.text_at(k) == "{" and not depth):
            w = self.text_at(k)
            depth += (w == "<") - (w == ">" and depth > 0)
            if not depth and self.t[k].kind == "id" and w not in ("extends", "implements") and self.text_at(k - 1) in ("extends", "implements", ","):
                path = self.dotted(k)
                supers.append(self.joined(k, path + 1))
                k = path
            k += 1
        end = self.end_of(k)
        symbol = self.declare(name, kind, None, start, end, supertypes=supers, modifiers=marks, annotations=self.decorators(start), signature=f"{kind} {name}")
        owner, k = f"{self.module}:{name}", k + 1
        while k < end and kind != "enum":
            k = max(self.member(k, end, owner, symbol), k + 1)
        return end + 1

    def decorators(self, i: int) -> list[str]:
        """The decorators that end right before token ``i``."""
        out = []
        while i > 0:
            open_ = self.match.get(i - 1) if self.text_at(i - 1) == ")" else i - 1
            name = open_ - 1 if open_ is not None and open_ != i - 1 else i - 1
            if name < 0 or not self.text_at(name).startswith("@"):
                break
            out.append(self.joined(name, i))
            i = name
        return out[::-1]

    def member(self, k: int, end: int, owner: str, symbol: int) -> int:
        start, marks, notes = k, [], []
        while k < end and self.text_at(k).startswith("@"):
            close = self.end_of(k + 1) if self.text_at(k + 1) == "(" else k
            notes.append(self.joined(k, close + 1))
            if close > k:
                self.scan(k + 2, close, symbol, owner)
            k = close + 1
        while k < end and self.text_at(k) in MODIFIERS | {"*"} and self.text_at(k + 1) not in ("(", ":", "=", ";", "?", "<", ","):
            marks, k = [*marks, self.text_at(k)], k + 1
        if k >= end or self.t[k].kind not in ("id", "str"):
            return self.end_of(k) + 1 if self.text_at(k) in ("{", "[", "(") else k + 1
        name, at, k = self.text_at(k).strip("'\""), k, k + 1
        while self.text_at(k) in ("?", "!"):
            k += 1
        more = {"modifiers": marks, "annotations": notes}
        if self.text_at(k) == "<":
            k = next((j for j in range(k, end) if self.text_at(j) == "("), k)
        if self.text_at(k) == "(":
            kind = "constructor" if name == "constructor" else "method"
            return self.function(name, kind, owner, start, k, more)
        typed = None
        if self.text_at(k) == ":":
            typed, k = self.type_after(k + 1)
        if self.text_at(k) == "=":
            open_ = self.arrow(k + 1)
            if open_ is not None:
                return self.function(name, "method", owner, start, open_, more)
            if typed is None and self.text_at(k + 1) == "new":
                typed = self.joined(k + 2, self.dotted(k + 2) + 1)
            stop = self.expression_end(k + 1)
            self.scan(k + 1, stop, symbol, owner)
            k = stop
        base, inner = plain_type(typed)
        self.declare(name, "field", owner, at, k - 1, type_name=base, type_args=inner, **more)
        return k

    # Expressions

    def dotted(self, i: int) -> int:
        """The index of the last name of a path ``a.b.c`` that starts at ``i``."""
        while self.text_at(i + 1) == "." and i + 2 < len(self.t) and self.t[i + 2].kind == "id":
            i += 2
        return i

    def expression(self, i: int, scope: int | None, owner: str | None) -> int | None:
        """Reads a call or ``new`` at ``i`` with its arguments, and gives the index after it; None if there is none."""
        t, made = self.t[i], self.text_at(i) == "new"
        at = self.dotted(i + 1) if made else i
        open_ = at + 1
        if self.text_at(open_) == "." and self.text_at(open_ + 1) == "(":  # f?.(x)
            open_ += 1
        elif self.text_at(open_) == "<" and self.t[at].kind == "id":
            open_ = self.type_end(at) or open_
        if self.text_at(open_) != "(" or (not made and (t.text in NOT_CALLS or t.text.startswith("@") and self.text_at(i - 1) != ".")):
            return None
        close = self.end_of(open_)
        if not made and self.text_at(close + 1) == "{" and self.text_at(i - 1) in ("{", ",", "async", "get", "set"):  # a method of an object literal
            return None
        _, kinds, strings = self.arguments(open_)
        row = {"from_seq": scope, "arity": len(self.parts(open_)), "arg_types": kinds, "str_args": strings, "line": t.line}
        if made:
            ref = self.out.add("refs", name=self.joined(i + 1, at + 1), receiver=None, receiver_seq=None, kind="new", **row)
        else:
            receiver = self.receiver(i - 1, self.closing) if self.text_at(i - 1) == "." else (None, None)
            own = t.text == "super"
            ref = self.out.add("refs", name="<init>" if own else t.text, receiver="super" if own else receiver[0], receiver_seq=receiver[1], kind="call", **row)
        self.closing[close] = ref
        self.scan(open_ + 1, close, scope, owner)
        return close + 1


def extract_script(text: str, path: str) -> Found:
    return Script(text, path).parse()
