"""Java declarations and calls from a token stream: types and members by descent, bodies by scanning.

No grammar library is needed. What a body's tokens can't tell (a cast's target, a lambda's inferred type) is left
untyped rather than guessed.
"""

from __future__ import annotations

import re
from typing import NamedTuple

from callweave.extract.rows import Found

TOKEN = re.compile(r"""(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<str>\"\"\".*?\"\"\"|"(?:\\.|[^"\\\n])*")|(?P<chr>'(?:\\.|[^'\\\n])+')|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>->|::|\.\.\.|.)""", re.DOTALL | re.VERBOSE)
#: The language's words.
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
TYPE_WORDS = {"class": "class", "interface": "interface", "enum": "enum", "record": "record"}
NOT_CALLS = {"if", "for", "while", "switch", "catch", "synchronized", "return", "throw", "assert", "try", "do", "else", "case", "instanceof", "new", "yield"}
NOT_TYPES = NOT_CALLS | {"this", "super", "break", "continue", "package", "import", "goto", "true", "false", "null"}
PRIMITIVES = {"int", "long", "short", "byte", "char", "float", "double", "boolean", "void"}
BUILDERS = {"Builder", "SuperBuilder"}


class Token(NamedTuple):
    kind: str
    text: str
    at: int
    line: int


def lex(text: str) -> list[Token]:
    out, line, last = [], 1, 0
    for m in TOKEN.finditer(text):
        line += text.count("\n", last, m.start())
        last = m.start()
        if m.lastgroup != "skip":
            out.append(Token(m.lastgroup, m[0], m.start(), line))
    return out


def simple_type(text: str) -> tuple[str, str | None]:
    """``List<User>`` to (``List``, ``User``): the single plain argument, or none; arrays are their element's."""
    base = re.sub(r"<.*", "", text).replace("...", "").replace("[]", "").strip()
    inner = re.fullmatch(r"[^<]*<\s*(?:\?\s*(?:extends|super)\s*)?([\w$.]+)\s*>.*", text)
    return base, inner[1] if inner else None


class Parser:
    def __init__(self, text: str, path: str) -> None:
        self.text, self.t, self.i, self.out, self.anonymous = text, lex(text), 0, Found(), 0
        self.match = self._matches()

    def _matches(self) -> dict[int, int]:
        """Index of each bracket's partner."""
        pairs, stack, out = {")": "(", "]": "[", "}": "{"}, [], {}
        for i, t in enumerate(self.t):
            if t.kind == "op":
                if t.text in "([{" and len(t.text) == 1:
                    stack.append(i)
                elif t.text in pairs:
                    while stack and self.t[stack[-1]].text != pairs[t.text]:
                        stack.pop()
                    if stack:
                        out[stack[-1]] = i
                        out[i] = stack.pop()
        return out

    def text_at(self, i: int) -> str:
        return self.t[i].text if 0 <= i < len(self.t) else ""

    def end_of(self, i: int) -> int:
        return self.match.get(i, len(self.t) - 1)

    # Types as text

    def type_end(self, i: int) -> int | None:
        """The index after a type that starts at ``i``, or None."""
        if i >= len(self.t) or self.t[i].kind != "id" or self.t[i].text in NOT_TYPES:
            return None
        i += 1
        while True:
            if self.text_at(i) == "<":
                depth = 0
                while i < len(self.t):
                    x = self.t[i].text
                    depth += (x == "<") - (x == ">")
                    if x not in "<>,.?&[]@" and self.t[i].kind != "id" or x in ("(", ";"):
                        return None
                    i += 1
                    if not depth:
                        break
                else:
                    return None
            if self.text_at(i) == "." and i + 1 < len(self.t) and self.t[i + 1].kind == "id":
                i += 2
                continue
            break
        while self.text_at(i) == "[" and self.text_at(i + 1) == "]":
            i += 2
        if self.text_at(i) == "...":
            i += 1
        return i

    def joined(self, a: int, b: int) -> str:
        out = ""
        for t in self.t[a:b]:
            out += (" " if out and out[-1].isalnum() and t.kind == "id" else "") + t.text
        return out

    # Declarations

    def parse(self) -> Found:
        while self.i < len(self.t):
            word = self.t[self.i].text
            if word == "package":
                end = self.find(";")
                self.out.package = self.joined(self.i + 1, end)
                self.i = end + 1
            elif word == "import":
                end = self.find(";")
                static = self.text_at(self.i + 1) == "static"
                name = self.joined(self.i + 1 + static, end)
                wild = name.endswith(".*")
                name = name.removesuffix(".*")
                self.out.add("imports", fqn=name, simple=None if wild else name.rpartition(".")[2], is_wildcard=int(wild), is_static=int(static), kind="import")
                self.i = end + 1
            else:
                start = self.i
                self.member(None, None, None)
                self.i = max(self.i, start + 1)
        return self.out

    def find(self, what: str) -> int:
        i = self.i
        while i < len(self.t) and self.t[i].text != what:
            i += 1
        return i

    def modifiers(self) -> tuple[list[str], list[tuple[str, int, int | None]]]:
        """Modifier words, and annotations with the place of their arguments."""
        words, notes = [], []
        while self.i < len(self.t):
            t = self.t[self.i]
            if t.text == "@" and self.text_at(self.i + 1) != "interface":
                end = self.i + 2
                while self.text_at(end) == ".":
                    end += 2
                name, args = self.joined(self.i + 1, end), None
                if self.text_at(end) == "(":
                    args, end = end, self.end_of(end) + 1
                notes.append((name, t.line, args))
                self.i = end
            elif t.text in MODIFIERS or t.text == "non" and self.text_at(self.i + 1) == "-":
                words.append(t.text)
                self.i += 3 if t.text == "non" else 1
            else:
                break
        return words, notes

    def notes(self, notes: list, symbol: int) -> None:
        for name, line, args in notes:
            raw = None if args is None else self.text[self.t[args].at + 1 : self.t[self.end_of(args)].at]
            strings = [] if args is None else [t.text[1:-1] for t in self.t[args : self.end_of(args)] if t.kind == "str"]
            self.out.add("refs", from_seq=symbol, name="@" + name, receiver=None, arity=None, arg_types=[raw] if raw is not None else [], str_args=strings, receiver_seq=None, line=line, kind="annotation")

    def span(self, a: int, b: int) -> dict:
        b = min(b, len(self.t) - 1)
        return {"start_line": self.t[a].line, "end_line": self.t[b].line + self.t[b].text.count("\n"), "start_byte": self.t[a].at, "end_byte": self.t[b].at + len(self.t[b].text)}

    def member(self, owner: str | None, owner_name: str | None, scope: int | None) -> None:
        """One declaration at ``self.i``: a type, method, constructor, field or initialiser."""
        start = self.i
        words, notes = self.modifiers()
        word = self.text_at(self.i)
        names = ["@" + n for n, _, _ in notes]
        if word in ("", ";", "}"):
            self.i += 1
            return
        if word == "{":
            self.body(self.i, self.end_of(self.i), scope, owner)
            self.i = self.end_of(self.i) + 1
            return
        if word == "@" or word in TYPE_WORDS and self.i + 1 < len(self.t) and self.t[self.i + 1].kind == "id" and (word != "record" or self.text_at(self.i + 2) in ("(", "<")):
            self.type_declaration(start, words, names, notes, owner)
            return
        parameters = []
        if word == "<":  # of the method
            depth, a = 0, self.i
            while self.i < len(self.t):
                depth += (self.text_at(self.i) == "<") - (self.text_at(self.i) == ">")
                self.i += 1
                if not depth:
                    break
            parameters = ["tp:" + t.text for k, t in enumerate(self.t[a : self.i]) if t.kind == "id" and self.text_at(a + k - 1) in ("<", ",")]
        if self.text_at(self.i) == owner_name and self.text_at(self.i + 1) in ("(", "{"):
            self.callable(start, words + parameters, names, notes, owner, owner_name, "constructor", None, self.i + 1)
            return
        after = self.type_end(self.i)
        if after is None or after >= len(self.t) or self.t[after].kind != "id":
            self.i += 1
            return
        kind = self.joined(self.i, after)
        name = self.t[after].text
        if self.text_at(after + 1) == "(":
            self.callable(start, words + parameters, names, notes, owner, name, "method", kind, after + 1)
        else:
            self.fields(start, words, names, notes, owner, kind, after, scope)

    def type_declaration(self, start: int, words: list, names: list, notes: list, owner: str | None) -> None:
        kind = "annotation" if self.text_at(self.i) == "@" else TYPE_WORDS[self.text_at(self.i)]
        self.i += 2 if kind == "annotation" else 1
        name = self.text_at(self.i)
        fqn = f"{owner}.{name}" if owner else f"{self.out.package}.{name}" if self.out.package else name
        head = self.i + 1
        body = head
        while body < len(self.t) and self.text_at(body) not in ("{", ";"):
            body = self.end_of(body) + 1 if self.text_at(body) == "(" else body + 1
        supers, i = [], head
        if self.text_at(i) == "<":
            depth = 0
            while i < body:
                depth += (self.text_at(i) == "<") - (self.text_at(i) == ">")
                if self.t[i].kind == "id" and depth == 1 and self.text_at(i - 1) in ("<", ","):
                    words.append("tp:" + self.t[i].text)
                i += 1
                if not depth:
                    break
        components = None
        if self.text_at(i) == "(":
            components = self.parameters(i)
            i = self.end_of(i) + 1
        while i < body:
            if self.text_at(i) in ("extends", "implements", ",") and (after := self.type_end(i + 1)):
                supers.append(simple_type(self.joined(i + 1, after))[0])
                i = after
            elif self.text_at(i) == "permits":
                break
            else:
                i += 1
        end = self.end_of(body) if self.text_at(body) == "{" else body
        symbol = self.out.add("symbols", name=name, fqn=fqn, kind=kind, container_fqn=owner, type_name=None, type_args=None, signature=self.joined(start, body), arity=None, params=[], modifiers=words, annotations=names, supertypes=supers, **self.span(start, end))
        self.notes(notes, symbol)
        for declared, pname, line in components or []:
            base, arg = simple_type(declared)
            place = {"start_line": line, "end_line": line, "start_byte": self.t[start].at, "end_byte": self.t[start].at}
            self.out.add("symbols", name=pname, fqn=f"{fqn}.{pname}", kind="field", container_fqn=fqn, type_name=base, type_args=arg, signature=f"{declared} {pname}", arity=None, params=[], modifiers=["private", "final"], annotations=[], supertypes=[], **place)
            self.generated(fqn, pname, base, arg, [], line)
        first = len(self.out.symbols)
        self.i = body + 1
        if self.text_at(body) == "{":
            if kind == "enum":
                self.constants(fqn, name, end, symbol)
            while self.i < end:
                before = self.i
                self.member(fqn, name, symbol)
                self.i = max(self.i, before + 1)
        self.lombok(fqn, name, names, first)
        self.i = end + 1

    def constants(self, fqn: str, name: str, end: int, symbol: int) -> None:
        while self.i < end and self.text_at(self.i) != ";":
            if self.t[self.i].kind == "id" and self.text_at(self.i - 1) in ("{", ","):
                at = self.t[self.i]
                place = {"start_line": at.line, "end_line": at.line, "start_byte": at.at, "end_byte": at.at + len(at.text)}
                self.out.add("symbols", name=at.text, fqn=f"{fqn}.{at.text}", kind="field", container_fqn=fqn, type_name=name, type_args=None, signature=at.text, arity=None, params=[], modifiers=["public", "static", "final"], annotations=[], supertypes=[], **place)
                self.i += 1
                if self.text_at(self.i) == "(":
                    self.body(self.i, self.end_of(self.i), symbol, fqn)
                    self.i = self.end_of(self.i) + 1
                if self.text_at(self.i) == "{":
                    inner, self.i = self.end_of(self.i), self.i + 1
                    while self.i < inner:
                        before = self.i
                        self.member(fqn, name, symbol)
                        self.i = max(self.i, before + 1)
                    self.i = inner + 1
            else:
                self.i += 1

    def parameters(self, open_: int) -> list[tuple[str, str, int]]:
        """(type, name, line) of each parameter."""
        out, keep, close = [], self.i, self.end_of(open_)
        self.i = open_ + 1
        while self.i < close:
            self.modifiers()
            after = self.type_end(self.i)
            if after and after < close and self.t[after].kind == "id":
                out.append((self.joined(self.i, after), self.t[after].text, self.t[after].line))
                self.i = after + 1
            while self.i < close and self.text_at(self.i) != ",":
                self.i = self.end_of(self.i) + 1 if self.text_at(self.i) in ("(", "[", "{") else self.i + 1
            self.i += 1
        self.i = keep
        return out

    def callable(self, start: int, words: list, names: list, notes: list, owner: str | None, name: str, kind: str, returns: str | None, open_: int) -> None:
        compact = self.text_at(open_) == "{"  # of a record
        params = [] if compact else self.parameters(open_)
        i = open_ if compact else self.end_of(open_) + 1
        while i < len(self.t) and self.text_at(i) not in ("{", ";"):
            i += 1
        end = self.end_of(i) if self.text_at(i) == "{" else i
        base, arg = simple_type(returns) if returns else (None, None)
        symbol = self.out.add("symbols", name=name, fqn=f"{owner}.{name}" if owner else name, kind=kind, container_fqn=owner, type_name=base, type_args=arg, signature=self.joined(start, i), arity=len(params), params=[p for p, _, _ in params], modifiers=words, annotations=names, supertypes=[], **self.span(start, end))
        self.notes(notes, symbol)
        for declared, pname, line in params:
            b, a = simple_type(declared)
            self.out.add("locals", scope_seq=symbol, name=pname, type_name=b, type_args=a, owner_seq=None, line=line, init_kind="param", init_path=None)
        if self.text_at(i) == "{":
            self.body(i, end, symbol, owner)
        self.i = end + 1

    def fields(self, start: int, words: list, names: list, notes: list, owner: str | None, kind: str, at: int, scope: int | None) -> None:
        base, arg = simple_type(kind)
        end = at
        while end < len(self.t) and self.text_at(end) != ";":
            end = self.end_of(end) + 1 if self.text_at(end) in ("(", "{", "[") else end + 1
        i, symbol = at, None
        while i < end:
            if self.t[i].kind == "id" and (i == at or self.text_at(i - 1) == ",") and self.text_at(i + 1) in ("=", ",", ";", "["):
                symbol = self.out.add("symbols", name=self.t[i].text, fqn=f"{owner}.{self.t[i].text}", kind="field", container_fqn=owner, type_name=base, type_args=arg, signature=f"{kind} {self.t[i].text}", arity=None, params=[], modifiers=words, annotations=names, supertypes=[], **self.span(start, end))
            i = self.end_of(i) + 1 if self.text_at(i) in ("(", "{", "[") else i + 1
        if symbol is not None:
            self.notes(notes, symbol)
            self.body(at, end, scope if scope is not None else symbol, owner)
        self.i = end + 1

    def generated(self, owner: str, name: str, kind: str | None, arg: str | None, params: list[str], line: int) -> None:
        place = {"start_line": line, "end_line": line, "start_byte": 0, "end_byte": 0}
        self.out.add("symbols", name=name, fqn=f"{owner}.{name}", kind="method", container_fqn=owner, type_name=kind, type_args=arg, signature=f"{name}({', '.join(params)})", arity=len(params), params=params, modifiers=["public", "generated"], annotations=[], supertypes=[], **place)

    def lombok(self, fqn: str, name: str, names: list[str], first: int) -> None:
        """Accessors and builders that annotations ask for, where nothing written has their name and arity."""
        marks = {n.lstrip("@").rpartition(".")[2] for n in names}
        own = [s for s in self.out.symbols[first:] if s["container_fqn"] == fqn]
        written = {(s["name"], s["arity"]) for s in own if s["kind"] == "method"}
        for f in [s for s in own if s["kind"] == "field" and "static" not in s["modifiers"]]:
            mine = marks | {n.lstrip("@").rpartition(".")[2] for n in f["annotations"]}
            cap = f["name"][:1].upper() + f["name"][1:]
            getter = f["name"] if f["type_name"] == "boolean" and f["name"].startswith("is") else ("is" if f["type_name"] == "boolean" else "get") + cap
            if mine & {"Getter", "Data", "Value"} and (getter, 0) not in written:
                self.generated(fqn, getter, f["type_name"], f["type_args"], [], f["start_line"])
            if mine & {"Setter", "Data"} and "final" not in f["modifiers"] and ("set" + cap, 1) not in written:
                self.generated(fqn, "set" + cap, "void", None, [f["type_name"]], f["start_line"])
        if marks & BUILDERS:
            line, inner = self.out.symbols[first - 1]["start_line"] if first else 1, f"{fqn}.{name}Builder"
            place = {"start_line": line, "end_line": line, "start_byte": 0, "end_byte": 0}
            self.out.add("symbols", name=f"{name}Builder", fqn=inner, kind="class", container_fqn=fqn, type_name=None, type_args=None, signature=f"class {name}Builder", arity=None, params=[], modifiers=["public", "static", "generated"], annotations=[], supertypes=[], **place)
            self.generated(fqn, "builder", f"{name}Builder", None, [], line)
            self.generated(inner, "build", name, None, [], line)
            for f in own:
                if f["kind"] == "field" and "static" not in f["modifiers"]:
                    self.generated(inner, f["name"], f"{name}Builder", None, [f["type_name"]], line)

    # Bodies

    def arguments(self, open_: int) -> tuple[int, list[str | None], list[str]]:
        """Number, type tokens and string literals of a call's arguments."""
        close, parts, i, start = self.end_of(open_), [], open_ + 1, open_ + 1
        while i <= close:
            if i == close or self.text_at(i) == ",":
                if i > start:
                    parts.append((start, i))
                start = i + 1
            if i < close and self.text_at(i) in ("(", "[", "{"):
                i = self.end_of(i)
            i += 1
        kinds, strings = [], []
        for a, b in parts:
            t, kind = self.t[a], None
            if b - a == 1:
                if t.kind == "str":
                    kind = "!String"
                    strings.append(t.text[1:-1])
                elif t.kind == "chr":
                    kind = "!char"
                elif t.kind == "num":
                    kind = "!double" if re.search(r"[.fFdD]", t.text) and not t.text.startswith("0x") else "!int"
                elif t.text in ("true", "false"):
                    kind = "!boolean"
                elif t.kind == "id" and t.text not in NOT_TYPES:
                    kind = t.text
            elif self.text_at(b - 1) == "class" and self.text_at(b - 2) == ".":
                kind = self.joined(a, b)
            kinds.append(kind)
        return len(parts), kinds, strings

    def body(self, a: int, b: int, scope: int | None, owner: str | None) -> None:
        """Calls, ``new`` and locals between two tokens; anonymous classes' members included."""
        closing: dict[int, int] = {}  # closing bracket of a call to its ref
        pending: list[tuple[int, int]] = []  # locals typed by a call, and where their initialiser ends
        i = a
        while i < b:
            t = self.t[i]
            if t.kind != "id":
                if t.text == "::" and self.text_at(i + 1):
                    name = self.text_at(i + 1)
                    receiver = self.receiver(i, closing)
                    if name == "new":
                        self.out.add("refs", from_seq=scope, name=receiver[0] or "", receiver=None, arity=None, arg_types=[], str_args=[], receiver_seq=None, line=t.line, kind="new")
                    else:
                        self.out.add("refs", from_seq=scope, name=name, receiver=receiver[0], arity=None, arg_types=[], str_args=[], receiver_seq=receiver[1], line=t.line, kind="call")
                    i += 2
                    continue
                i += 1
                continue
            if t.text == "new":
                after = self.type_end(i + 1)
                if after and self.text_at(after) == "(":
                    kind = simple_type(self.joined(i + 1, after))[0]
                    n, kinds, strings = self.arguments(after)
                    ref = self.out.add("refs", from_seq=scope, name=kind, receiver=None, arity=n, arg_types=kinds, str_args=strings, receiver_seq=None, line=t.line, kind="new")
                    closing[self.end_of(after)] = ref
                    self.body(after + 1, self.end_of(after), scope, owner)
                    i = self.end_of(after) + 1
                    if self.text_at(i) == "{":
                        self.anonymous += 1
                        i = self.inner_class(i, kind, owner)
                    continue
                i = after or i + 1
                continue
            if self.text_at(i + 1) == "(" and t.text not in NOT_CALLS:
                receiver = self.receiver(i - 1, closing) if self.text_at(i - 1) == "." else (None, None)
                n, kinds, strings = self.arguments(i + 1)
                own = t.text in ("this", "super")
                ref = self.out.add("refs", from_seq=scope, name="<init>" if own else t.text, receiver=t.text if own else receiver[0], arity=n, arg_types=kinds, str_args=strings, receiver_seq=receiver[1], line=t.line, kind="call")
                closing[self.end_of(i + 1)] = ref
                self.body(i + 2, self.end_of(i + 1), scope, owner)
                i = self.end_of(i + 1) + 1
                continue
            if t.text in TYPE_WORDS and self.t[i + 1].kind == "id" and self.text_at(i - 1) in (";", "{", "}") and t.text != "record":
                keep, self.i = self.i, i
                self.type_declaration(i, [], [], [], owner)
                i, self.i = self.i, keep
                continue
            declared = self.local(i, b, scope, pending)
            i = declared or i + 1
        for local, end in pending:
            self.out.locals[local]["owner_seq"] = closing.get(end)

    def inner_class(self, open_: int, parent: str, owner: str | None) -> int:
        name = f"${self.anonymous}"
        fqn = f"{owner}.{name}" if owner else name
        end = self.end_of(open_)
        symbol = self.out.add("symbols", name=name, fqn=fqn, kind="class", container_fqn=owner, type_name=None, type_args=None, signature=f"new {parent}", arity=None, params=[], modifiers=[], annotations=[], supertypes=[parent], **self.span(open_, end))
        keep, self.i = self.i, open_ + 1
        while self.i < end:
            before = self.i
            self.member(fqn, None, symbol)
            self.i = max(self.i, before + 1)
        self.i = keep
        return end + 1

    def receiver(self, dot: int, closing: dict) -> tuple[str | None, int | None]:
        """(text, ref) of what stands before a dot: a path of names, a call's result, or anything else as ``(...)``."""
        j = dot - 1
        if j in closing:
            return "(...)", closing[j]
        if j >= 0 and self.t[j].kind == "id":
            k = j
            while self.text_at(k - 1) == "." and k >= 2 and self.t[k - 2].kind == "id":
                k -= 2
            if self.text_at(k - 1) == ".":
                return "(...)", None
            return self.joined(k, j + 1), None
        if j >= 0 and self.t[j].kind == "str":
            return "!String", None
        return "(...)", None

    def local(self, i: int, b: int, scope: int | None, pending: list) -> int | None:
        """A declaration at a statement's start, in a ``for``, ``try`` or ``catch`` head, or an ``instanceof`` pattern; returns where to go on."""
        before = self.text_at(i - 1)
        if before not in (";", "{", "}", "(", "final", "instanceof", ")", "else") and not (before == "->"):
            return None
        after = self.type_end(i)
        if not after or after >= b or self.t[after].kind != "id" or self.t[after].text in NOT_TYPES:
            return None
        follows = self.text_at(after + 1)
        if follows not in ("=", ";", ":", ",", ")", "&") or follows in (",", ")", "&") and before not in ("(", "final", "instanceof"):
            return None
        kind = self.joined(i, after)
        base, arg = simple_type(kind)
        how, path = ("loop" if follows == ":" else "let"), None
        if base == "var":
            base, arg = None, None
            if follows == "=" and self.text_at(after + 2) == "new" and (e := self.type_end(after + 3)):
                base, arg = simple_type(self.joined(after + 3, e))
                how = "construct"
            elif follows == "=":
                path = self.joined(after + 2, min(b, after + 3))
                how = "call"
        local = self.out.add("locals", scope_seq=scope, name=self.t[after].text, type_name=base, type_args=arg, owner_seq=None, line=self.t[after].line, init_kind=how, init_path=path)
        if how == "call":
            end = after + 2
            while end < b and self.text_at(end) != ";":
                end = self.end_of(end) + 1 if self.text_at(end) in ("(", "[", "{") else end + 1
            pending.append((local, end - 1))
        return after + 1


def extract_java(text: str, path: str) -> Found:
    return Parser(text, path).parse()
