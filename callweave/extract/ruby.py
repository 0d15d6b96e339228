"""Ruby declarations and calls: statements with a stack of open blocks, calls by scanning what is left of each line.

Strings keep their place but lose their content before calls are looked for, so code in them isn't read as calls.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from callweave.extract.rows import Found

#: Words that aren't calls, openers of blocks, and the macros that declare something.
KEYWORDS = {"if", "unless", "while", "until", "case", "when", "then", "else", "elsif", "end", "do", "begin", "rescue", "ensure", "return", "yield", "and", "or", "not", "in", "self", "nil", "true", "false", "super", "def", "class", "module", "alias", "undef", "defined?", "break", "next", "redo", "retry", "for", "__method__", "__FILE__", "lambda", "proc", "raise", "loop", "require", "require_relative", "private", "protected", "public", "puts", "print", "p", "include", "extend", "prepend"}
OPENERS = re.compile(r"^(?:[\w.@\[\]]+\s*(?:\|\||&&|\+|-)?=\s*)?(?:if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")
ATTRIBUTES = {"attr_reader": ("r",), "attr_writer": ("w",), "attr_accessor": ("r", "w"), "cattr_accessor": ("r", "w"), "mattr_accessor": ("r", "w")}
ONE, MANY = {"belongs_to", "has_one"}, {"has_many", "has_and_belongs_to_many"}
FINDERS = {"new", "find", "find_by", "find_by!", "first", "last", "create", "create!", "build", "take"}


@dataclass
class Frame:
    kind: str
    name: str = ""
    symbol: int | None = None
    singleton: bool = False
    visibility: str = "public"


def classify(word: str) -> str:
    if word.endswith("ies"):
        word = word[:-3] + "y"
    elif re.search(r"(ch|sh|ss|x|z)es$", word):
        word = word[:-2]
    elif word.endswith("s") and not re.search(r"(ss|us|is)$", word):
        word = word[:-1]
    return "".join(p[:1].upper() + p[1:] for p in word.split("_") if p)


def blanked(line: str) -> tuple[str, list[tuple[int, str]]]:
    """The line without comment, string contents as blanks; and the strings with their places."""
    out, strings, i = [], [], 0
    while i < len(line):
        c = line[i]
        if c in "\"'" and not (i and line[i - 1] in "$?"):
            j = i + 1
            while j < len(line) and line[j] != c:
                j += 2 if line[j] == "\\" else 1
            body = line[i + 1 : j]
            strings.append((i, body))
            code = "".join(m[1] for m in re.finditer(r"#\{([^}]*)\}", body)) if c == '"' else ""
            out.append(c + (" " * len(body)) + (c if j < len(line) else ""))
            if code:
                out.append(f" ;{code}; ")
            i = j + 1
        elif c == "#" and (not i or line[i - 1].isspace()):
            break
        else:
            out.append(c)
            i += 1
    return "".join(out), strings


class Reader:
    def __init__(self, text: str, path: str) -> None:
        self.out, self.stack, self.lines, self.here = Found(), [], text.split("\n"), 0
        self.offset = 0
        self.bound: dict[int | None, set[str]] = {}

    def bind(self, scope: int | None, name: str, kind: str, typed: str | None = None) -> None:
        self.bound.setdefault(scope, set()).add(name)
        self.out.add("locals", scope_seq=scope, name=name, type_name=typed, type_args=None, owner_seq=None, line=self.here, init_kind=kind, init_path=None)

    def owner(self) -> str:
        return "::".join(f.name for f in self.stack if f.kind in ("class", "module"))

    def scope(self) -> int | None:
        return next((f.symbol for f in reversed(self.stack) if f.symbol is not None), None)

    def holder(self) -> Frame | None:
        return next((f for f in reversed(self.stack) if f.kind in ("class", "module")), None)

    def symbol(self, name: str, kind: str, **more) -> int:
        owner = self.owner()
        sep = "." if kind == "class_method" else "#"
        fqn = (f"{owner}::{name}" if owner else name) if kind in ("class", "module") else f"{owner or 'Object'}{sep}{name}"
        base = {"name": name, "fqn": fqn, "kind": kind, "container_fqn": owner or (None if kind in ("class", "module") else "Object"), "type_name": None, "type_args": None, "signature": name, "arity": None, "params": [], "start_line": self.here, "end_line": self.here, "start_byte": self.offset, "end_byte": self.offset, "modifiers": [], "annotations": [], "supertypes": []}
        return self.out.add("symbols", **(base | more))

    def read(self) -> Found:
        heredoc, embedded = None, False
        for self.here, raw in enumerate(self.lines, 1):
            at, self.offset = self.offset, self.offset
            stripped = raw.strip()
            if embedded or heredoc:
                embedded = embedded and stripped != "=end"
                heredoc = None if heredoc and stripped == heredoc else heredoc
            elif stripped == "=begin":
                embedded = True
            elif stripped == "__END__":
                break
            else:
                code, strings = blanked(raw)
                if found := re.search(r"<<[~-]?[\"']?([A-Z_]+)[\"']?", raw):
                    heredoc = found[1]
                for part in self.statements(code):
                    self.statement(part.strip(), code, strings, at + len(raw))
            self.offset = at + len(raw) + 1
        return self.out

    @staticmethod
    def statements(code: str) -> list[str]:
        return [p for p in code.split(";") if p.strip()]

    def close(self, end: int) -> None:
        if self.stack:
            frame = self.stack.pop()
            if frame.symbol is not None and frame.kind != "block":
                self.out.symbols[frame.symbol] |= {"end_line": self.here, "end_byte": end}

    def statement(self, s: str, code: str, strings: list, end: int) -> None:
        if re.match(r"end\b", s):
            self.close(end)
            return
        if m := re.match(r"class\s*<<\s*self", s):
            self.stack.append(Frame("singleton", singleton=True))
            return
        if m := re.match(r"(class|module)\s+([A-Z][\w:]*)(?:\s*<\s*([\w:.]+))?", s):
            supers = [m[3]] if m[3] else []
            symbol = self.symbol(m[2], m[1], supertypes=supers, signature=s)
            self.stack.append(Frame(m[1], m[2], symbol))
            if re.search(r"\bend$", s):
                self.close(end)
            return
        if m := re.match(r"([A-Z]\w*)\s*=\s*(Struct|Data|Class)\.(?:new|define)\b(.*)", s):
            symbol = self.symbol(m[1], "class", signature=s, supertypes=re.findall(r"\(\s*([A-Z][\w:]*)", m[3])[:1] if m[2] == "Class" else [])
            self.stack.append(Frame("class", m[1], symbol))
            for name in re.findall(r":(\w+)", m[3]) if m[2] != "Class" else []:
                self.symbol(name, "method", arity=0, modifiers=["generated"])
            if not re.search(r"\bdo\b(\s*\|[^|]*\|)?$", s):
                self.close(end)
            return
        if m := re.match(r"(?:(private|protected|public|private_class_method)\s+)?def\s+(self\.|[A-Z]\w*\.)?([\w]+[?!=]?|[+\-*/<>=!~\[\]%&|^]+)\s*(\(?)(.*)", s):
            self.define(m, s, end)
            return
        if s in ("private", "protected", "public"):
            if holder := self.holder():
                holder.visibility = s
            return
        if self.macro(s, strings):
            return
        self.calls(s, strings)
        if OPENERS.search(s) and not re.search(r"\bend\b", s):
            self.stack.append(Frame("block"))

    def define(self, m: re.Match, s: str, end: int) -> None:
        rest = m[5]
        inner = rest[: self.balanced(rest)] if m[4] else rest.split("=")[0] if re.match(r"\s*=\s", rest) else rest
        params = [p.strip() for p in re.split(r",(?![^(\[{]*[)\]}])", inner.rstrip(") ")) if p.strip()]
        params = [p for p in params if not p.startswith("&")]
        kind = "class_method" if m[2] or any(f.singleton for f in self.stack) else "method"
        holder = self.holder()
        visibility = m[1] or (holder.visibility if holder and kind == "method" else "public")
        signature = f"{m[3]}({', '.join(params)})"
        symbol = self.symbol(m[3], kind, arity=len(params), params=params, modifiers=[visibility.removesuffix("_class_method")] if visibility else [], signature=signature)
        for p in params:
            if name := re.match(r"\*{0,2}(\w+)", p):
                self.bind(symbol, name[1], "param")
        after = rest[self.balanced(rest) + 1 :] if m[4] else rest
        if endless := re.match(r"\s*=\s+(.*)", after):
            self.stack.append(Frame("method", m[3], symbol))
            self.calls(endless[1], [])
            self.close(end)
        else:
            self.stack.append(Frame("method", m[3], symbol))
            if re.search(r"\bend$", s):
                self.close(end)

    @staticmethod
    def balanced(text: str) -> int:
        """Where the bracket that stands open before ``text`` closes."""
        depth = 1
        for i, c in enumerate(text):
            depth += (c in "([{") - (c in ")]}")
            if not depth:
                return i
        return len(text)

    def macro(self, s: str, strings: list) -> bool:
        """Declarations made by calls in a class body."""
        holder = self.stack[-1] if self.stack and self.stack[-1].kind in ("class", "module", "singleton", "block") else None
        m = re.match(r"(\w+)\s*\(?\s*(.*)", s)
        if m and m[1] in ("require", "require_relative") and strings:
            self.out.add("imports", fqn=strings[0][1], simple=strings[0][1].rpartition("/")[2], is_wildcard=0, is_static=0, kind="import")
            return True
        if not (holder and m):
            return False
        word, rest = m[1], m[2]
        names = re.findall(r"(?<![\w:]):(\w+[?!]?)(?!\s*=>)", rest)
        if word in ("include", "extend", "prepend"):
            owner = self.holder()
            if owner and owner.symbol is not None:
                self.out.symbols[owner.symbol]["supertypes"] += re.findall(r"[A-Z][\w:]*", rest)
            return True
        if word in ATTRIBUTES:
            for name in names:
                for way in ATTRIBUTES[word]:
                    self.symbol(name + ("=" if way == "w" else ""), "method", arity=int(way == "w"), modifiers=["generated"])
            return True
        if word in ONE | MANY and names:
            said = re.search(r"class_name:\s*[\"']", s)
            model = next((t for at, t in strings if said and re.match(r"[A-Z]", t)), None) or classify(names[0])
            many = word in MANY
            self.symbol(names[0], "method", type_name=model, arity=0, modifiers=["generated", *(["collection"] if many else [])])
            self.symbol(names[0] + "=", "method", arity=1, modifiers=["generated"])
            return True
        if word == "scope" and names:
            self.symbol(names[0], "class_method", type_name=(self.owner().rpartition("::")[2] or None), modifiers=["generated"])
            self.calls(rest, strings)
            return True
        if word == "delegate" and (to := re.search(r"to:\s*:(\w+)", rest)):
            for name in [n for n in names if n != to[1]]:
                symbol = self.symbol(name, "method", modifiers=["generated"])
                self.out.add("refs", from_seq=symbol, name=name, receiver=to[1], arity=None, arg_types=[], str_args=[], receiver_seq=None, line=self.here, kind="call")
            return True
        if word == "alias_method" and len(names) > 1 or word == "define_method" and names:
            symbol = self.symbol(names[0], "method", modifiers=["generated"] if word == "alias_method" else [])
            if word == "alias_method":
                self.out.add("refs", from_seq=symbol, name=names[1], receiver="self", arity=None, arg_types=[], str_args=[], receiver_seq=None, line=self.here, kind="call")
            else:
                self.stack.append(Frame("method", names[0], symbol))
            return True
        if re.match(r"(before|after|around)_\w+$|validate$|helper_method$", word) and names:
            for name in names:
                self.out.add("refs", from_seq=self.scope(), name=name, receiver="self", arity=None, arg_types=[], str_args=[], receiver_seq=None, line=self.here, kind="call")
            return True
        return False

    def calls(self, s: str, strings: list) -> None:
        scope = self.scope()
        for names in re.findall(r"(?:\{|\bdo)\s*\|([^|]*)\|", s):
            for name in re.findall(r"\w+", names):
                self.bind(scope, name, "block-param")
        bound = self.bound.setdefault(scope, set())
        if m := re.match(r"(@{0,2}\w+)\s*(?:\|\|)?=(?![=~>])\s*(.*)", s):
            built = re.match(r"([A-Z][\w:]*)\.(\w+[!?]?)", m[2])
            typed = built[1] if built and built[2] in FINDERS else None
            self.bind(scope, m[1], ("construct" if built[2] == "new" else "finder") if typed else "assigned", typed)
            s = m[2]
        chain: dict[int, int] = {}  # where a call's text ends, to its ref
        for m in re.finditer(r"([A-Z][\w:]*|@{1,2}\w+|self|[a-z_]\w*[?!]?)|\.|&\.|\(|\)", s):
            word, a, b = m[0], m.start(), m.end()
            if not re.match(r"[a-z_]", word) or word in ("self",):
                continue
            before = s[:a]
            dotted = re.search(r"(&?\.)$", before)
            follows = s[b:]
            if not dotted and (word in KEYWORDS or before.endswith(":") and not before.endswith("::") or re.match(r":(?!:)", follows) or before.endswith(("@", "$"))):
                continue
            opens = follows.startswith("(")
            args = follows[1 : 1 + self.balanced(follows[1:])] if opens else follows.lstrip() if re.match(r"\s+[\w:@\"'\[{]", follows) and not re.match(r"\s+(?:if|unless|and|or|do|then|while|until|rescue|in)\b", follows) else ""
            args = re.split(r"\b(?:if|unless|do)\b", args)[0] if not opens else args
            count = len([x for x in re.split(r",(?![^(\[{]*[)\]}])", args) if x.strip()])
            receiver, ref = None, None
            if dotted:
                left = before[: dotted.start()]
                word_before = re.search(r"([A-Z][\w:]*|@{0,2}\w+[?!]?)$", left)
                if len(left) in chain:
                    receiver, ref = "(...)", chain[len(left)]
                elif word_before and not left[: word_before.start()].endswith((".", "&.")):
                    receiver = word_before[1]
                else:
                    receiver = "(...)"
            elif word in bound and not opens:
                continue
            kind = "new" if word == "new" and receiver and receiver[:1].isupper() else "call" if dotted or opens or args else "ident_call"
            said = [t for at, t in strings] if args and len(strings) == args.count("'") // 2 + args.count('"') // 2 else []
            row = self.out.add("refs", from_seq=scope, name=receiver if kind == "new" else word, receiver=None if kind == "new" else receiver, arity=count if opens or args else 0, arg_types=[], str_args=said, receiver_seq=ref, line=self.here, kind=kind)
            chain[b + (2 + self.balanced(follows[1:]) if opens else 0)] = row


def extract_ruby(text: str, path: str) -> Found:
    return Reader(text, path).read()
