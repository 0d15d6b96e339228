"""Declarations in schema files: fields of GraphQL types, rpc methods of services, statements of SQL mappers. Each becomes a symbol.

What stands in comments and strings declares nothing; it is blanked first, so that all offsets and lines stay.
"""

from __future__ import annotations

import re

from callweave.extract.rows import Found
from callweave.operators.mappers import lines_at, read_mapper

UNREAD = re.compile(r'"""[\s\S]*?"""|"(?:\\.|[^"\\\n])*"|#[^\n]*')
PROTO_UNREAD = re.compile(r"/\*[\s\S]*?\*/|//[^\n]*|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'")
TOKEN = re.compile(r"\w+|[{}()\[\]:@!]")
#: What opens a definition; only the first two have fields that a resolver answers.
DEFINITIONS = ("type", "interface", "input", "enum", "union", "scalar", "directive", "schema")
RPC = re.compile(r"\bservice\s+([A-Za-z_]\w*)\s*(?=\{)|\brpc\s+([A-Za-z_]\w*)\s*\(|[{}]")


def _spaces(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _owner(head: list[str]) -> str | None:
    """The type whose block follows the words ``head``; none if it isn't a type's or an interface's."""
    at = max((i for i, w in enumerate(head) if w in DEFINITIONS), default=None)
    return head[at + 1] if at is not None and head[at] in DEFINITIONS[:2] and at + 1 < len(head) else None


def read_graphql(text: str) -> list[tuple[str, str, int, int]]:
    """(type, field, start, end) of every field, those of extended types under the type's own name.

    A field is a name before a colon, directly in a type's braces and outside all other brackets; it ends before the next.
    """
    out: list[list] = []
    head: list[str] = []
    braces = inner = last = 0
    owner = word = previous = None
    for m in TOKEN.finditer(UNREAD.sub(_spaces, text)):
        t = m[0]
        if t in "([":
            inner += 1
        elif t in ")]":
            inner = max(inner - 1, 0)
        elif t == "{":
            braces += 1
            if braces == 1:
                owner, word, inner = _owner(head), None, 0
        elif t == "}":
            if braces == 1:
                if owner and out and out[-1][3] is None:
                    out[-1][3] = last
                owner, head, inner = None, [], 0
            braces = max(braces - 1, 0)
        elif not braces:
            if not inner and t[0] not in ":@!":
                head.append(t)
        elif owner and braces == 1 and not inner:
            if t == ":" and word:
                name, start, before = word
                if out and out[-1][3] is None:
                    out[-1][3] = before
                out.append([owner, name, start, None])
                word = None
            elif t[0].isalpha() or t[0] == "_":
                word = None if previous == "@" else (t, m.start(), last)
        last, previous = m.end(), t
    if out and out[-1][3] is None:
        out[-1][3] = last
    return [tuple(r) for r in out]


def read_proto(text: str) -> list[tuple[str, str, int, int]]:
    """(service, method, start, end) of every rpc; options in braces don't end a service."""
    out, service, braces, outside = [], None, 0, 0
    for m in RPC.finditer(PROTO_UNREAD.sub(_spaces, text)):
        if m[0] == "{":
            braces += 1
        elif m[0] == "}":
            braces -= 1
            if braces <= outside:
                service = None
        elif m[1]:
            service, outside = m[1], braces
        elif service:
            out.append((service, m[2], m.start(), m.end()))
    return out


def _found(text: str, rows: list[tuple], kind: str, note: str) -> Found:
    """``rows``: name, full name, container, signature, annotation, start, end."""
    found = Found()
    places = lines_at(text, [o for r in rows for o in r[5:]])
    for i, (name, fqn, owner, signature, mark, start, end) in enumerate(rows):
        found.add("symbols", name=name, fqn=fqn, kind=kind, container_fqn=owner, type_name=None, type_args=None, signature=signature, arity=None, params=[], start_line=places[2 * i], end_line=places[2 * i + 1], start_byte=start, end_byte=end, modifiers=[], annotations=[mark or note], supertypes=[])
    return found


def extract_graphql(text: str, path: str) -> Found:
    shown = re.sub(UNREAD, lambda m: m[0] if m[0][0] == '"' and not m[0].startswith('"""') else _spaces(m), text)
    return _found(text, [(f, f"graphql:{t}.{f}", t, " ".join(shown[a:b].split()), None, a, b) for t, f, a, b in read_graphql(text)], "graphql-field", "schema")


def extract_proto(text: str, path: str) -> Found:
    return _found(text, [(f, f"rpc:{s}/{f}", s, f"rpc {f}", None, a, b) for s, f, a, b in read_proto(text)], "rpc-method", "proto")


def extract_mapper(text: str, path: str) -> Found:
    return _found(text, [(f, f"sql:{n}#{f}", n, f'<{verb} id="{f}">', verb, a, b) for n, f, verb, a, b in read_mapper(text)], "sql-statement", "sql")
