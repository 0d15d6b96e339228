"""TypeScript and JavaScript trees: extraction, modules, exports and resolution."""

from __future__ import annotations

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from callweave import project
from callweave.extract.script import extract_script, lex, plain_type

TREE = {
    "tsconfig.json": '{ // paths\n "compilerOptions": {"baseUrl": ".", "paths": {"@app/*": ["src/*"]}},\n}',
    "packages/kit/package.json": '{"name": "@shop/kit", "main": "lib/index.js"}',
    "packages/kit/lib/index.js": "exports.round = function (x) { return trim(x); };\nconst trim = (x) => x;\nmodule.exports.trim = trim;\n",
    "src/model.ts": "export class Item {\n  constructor(readonly name: string) {}\n  label(): string { return this.name; }\n}\nexport class Special extends Item {\n  constructor() { super('s'); }\n  show() { return super.label(); }\n}\n",
    "src/other.ts": "export class Item { label() { return 1; } }\n",
    "src/store.ts": "import { Item as Thing } from './model';\nexport interface Store { find(id: string): Promise<Thing>; all(): Thing[] }\nexport class MemoryStore implements Store {\n  private items: Thing[] = [];\n  async find(id: string): Promise<Thing> { return this.items.pop(); }\n  all() { return this.items; }\n  get first(): Thing { return this.items[0]; }\n}\n",
    "src/index.ts": "export * from './store';\nexport { Item, Special as Extra } from './model';\nexport { default as boot } from './boot';\n",
    "src/boot.ts": "export default function start() { return build(); }\nexport function build() { return new Service(null); }\nimport { Service } from './service';\n",
    "src/service.tsx": """import { Store, MemoryStore, Extra, boot } from '@app/index';
import * as model from './model';
import { round } from '@shop/kit';
import { Client } from 'far-client';
const http = require('http');
@Injectable()
export class Service {
  private client: Client;
  constructor(private readonly store: Store, private memory: MemoryStore) {}
  async load(id: string) {
    const item = await this.store.find(id);
    item.label();
    this.memory.first.label();
    this.store.all().push(item);
    const e = new Extra();
    e.label();
    const m = new model.Item('x');
    m?.label();
    round(`${boot()}`);
    this.client.send(id);
    http.get(id);
    item.vanish();
    someone.show();
    undeclared(id);
    const label = (x: Item) => x;
  }
}
""",
    "src/A.java": "class A { void label() { label(); } }",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def indexed(spark, tree):
    return project.index(spark, str(tree), repo_id="r")


def test_edges(indexed):
    names = indexed["symbols"].select("id", "fqn")
    rows = indexed["edges"].join(names.select(F.col("id").alias("from_symbol_id"), F.col("fqn").alias("a")), "from_symbol_id").join(names.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("b")), "to_symbol_id").collect()
    got = {(r["a"], r["b"], r["kind"], r["via"]) for r in rows}
    load = "src/service:Service#load"
    want = {
        ("src/model:Special", "src/model:Item", "extends", "declaration"),
        ("src/model:Special#constructor", "src/model:Item#constructor", "calls", "constructor"),
        ("src/model:Special#show", "src/model:Item#label", "calls", "direct"),
        ("src/store:MemoryStore", "src/store:Store", "implements", "declaration"),
        ("src/boot:start", "src/boot:build", "calls", "direct"),
        ("src/boot:build", "src/service:Service", "instantiates", "direct"),
        ("src/boot:build", "src/service:Service#constructor", "calls", "constructor"),
        ("packages/kit/lib/index:round", "packages/kit/lib/index:trim", "calls", "direct"),
        (load, "src/store:Store#find", "calls", "direct"),
        (load, "src/store:MemoryStore#find", "calls", "interface->impl"),
        (load, "src/model:Item#label", "calls", "direct"),
        (load, "src/store:Store#all", "calls", "direct"),
        (load, "src/store:MemoryStore#all", "calls", "interface->impl"),
        (load, "src/model:Special", "instantiates", "direct"),
        (load, "src/model:Special#constructor", "calls", "constructor"),
        (load, "src/model:Item", "instantiates", "direct"),
        (load, "src/model:Item#constructor", "calls", "constructor"),
        (load, "packages/kit/lib/index:round", "calls", "direct"),
        (load, "src/boot:start", "calls", "direct"),
        (load, "src/model:Special#show", "calls", "unique-name"),
    }
    assert {g for g in got if g[0] != "A.label"} == want
    labels = [r["line"] for r in rows if r["a"] == load and r["b"] == "src/model:Item#label"]
    assert sorted(labels) == [12, 13, 16, 18]


def test_outcomes(indexed):
    refs = indexed["refs"].select(F.col("id").alias("ref_id"), "name", "receiver")
    got = {(r["name"], r["receiver"]): (r["reason"], r["owner"]) for r in indexed["unresolved"].join(refs, "ref_id").collect()}
    assert got[("send", "this.client")] == ("external:far-client", "far-client") and got[("get", "http")] == ("external:http", "http")
    assert got[("pop", "this.items")] == ("external:Array", "Array") and got[("undeclared", None)][0] == "external:not-in-project"
    assert got[("vanish", "item")][0] == "external:not-in-project" and ("push", "(...)") in got


def test_stored(spark, tree, indexed, tmp_path):
    project.write(indexed, str(tmp_path / "facts"), "r")
    assert project.sync(spark, str(tree), str(tmp_path / "facts"), "r") == {"unchanged": 8}
    assert project.read(spark, str(tmp_path / "facts"), "r")["imports"].where("orig = 'Special'").count() == 1


def test_shapes():
    found = extract_script("export abstract class A<T extends B> extends C<T> {\n  #n = 1;\n  static async *go?(a: Map<string, number>, ...rest: X[]): Y | null { if (/[/]\\(/.test(a)) b(a); }\n  run = async <K,>(e: K) => { this.go(); };\n}\nconst o = { m(x) { inner(x); }, k: () => f<T>(1) };\nimport z = require('z');", "a/b.d.ts")
    assert [(s["fqn"], s["kind"], s["type_name"], s["params"]) for s in found.symbols] == [
        ("a/b:A", "class", None, []), ("a/b:A##n", "field", None, []), ("a/b:A#go", "method", "Y", ["Map<string,number>", "X[]..."]), ("a/b:A#run", "method", None, ["K"]),
    ]
    assert found.symbols[0]["supertypes"] == ["C"] and found.symbols[0]["modifiers"] == ["export", "abstract"]
    assert [(r["name"], r["receiver"]) for r in found.refs] == [("test", "(...)"), ("b", None), ("go", "this"), ("inner", None), ("f", None)]
    assert [(i["simple"], i["orig"], i["fqn"]) for i in found.imports] == [("z", "*", "z")]


def test_types():
    assert plain_type("Item | null") == ("Item", None) and plain_type("A | B") == (None, None) and plain_type("Promise<Item>") == ("Promise", "Item")
    assert plain_type("Array<Item>") == ("Item[]", None) == plain_type("readonly Item[]") and plain_type("(x: A) => B") == (None, None) and plain_type(None) == (None, None)


def test_lines_and_templates():
    tokens = lex("a // b\n`x ${f(`no`)} \n ${g(1)}` / 2 /* \n */ / h")
    assert [(t.text, t.line) for t in tokens if t.kind == "id"][0] == ("a", 1) and ("h", 4) in [(t.text, t.line) for t in tokens]
    assert not [t for t in lex("x = a / b / c") if t.text.startswith("/ ")]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["class", "export", "default", "import", "from", "const", "function", "new", "async", "=>", "(", ")", "{", "}", "[", "]", "<", ">", "=", ":", ";", ",", ".", "?.", "*", "as", "a", "B", "'s'", "`t${", "}`", "/", "\n", "@d", "#p", "exports", "module", "require", "type", "get", "super", "this", "enum", "..."]), max_size=30))
def test_any_tokens_are_read(words):
    extract_script(" ".join(words), "x.ts")
