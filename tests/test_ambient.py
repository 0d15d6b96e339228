"""Declarations of dependencies: which are read, and which calls they prove to be the library's."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from callweave import project
from callweave.sources import ambient

TREE = {
    "src/app.ts": """import { Client, open } from 'far-client';
import { Box } from '@lab/kit';
import express from 'express';
import { missing } from 'nowhere';
export class App {
  private client: Client;
  run(box: Box) {
    this.client.request('x').body().trim();
    open('y').request('z');
    box.lid.lift();
    const made = new Client();
    made.close();
    missing().then();
    this.own().run(box);
  }
  own(): App { return this; }
  close() {}
  lift() {}
}
""",
    "packages/one/main.ts": "import { Deep } from 'only-here';\nexport function go(d: Deep) { d.dive(); }\n",
    "packages/one/node_modules/only-here/index.d.ts": "export declare class Deep { dive(): void; }\n",
    "node_modules/far-client/package.json": json.dumps({"name": "far-client", "types": "./lib/main.d.ts"}),
    "node_modules/far-client/lib/main.d.ts": "import { Reply } from './reply';\nexport declare class Client { request(path: string): Reply; close(): void; }\nexport declare function open(name: string): Client;\nexport * from './reply';\n",
    "node_modules/far-client/lib/reply.d.ts": "export declare class Reply { body(): string; }\n",
    "node_modules/far-client/other.d.ts": "export declare class Outside {}\n",
    "node_modules/far-client/node_modules/inner/index.d.ts": "export declare class Inner {}\n",
    "node_modules/far-client/lib/a/b/c/d/deep.d.ts": "export declare class TooDeep {}\n",
    "node_modules/@types/lab__kit/index.d.ts": "export interface Lid { lift(): void }\nexport interface Box { lid: Lid }\n",
    "node_modules/unused/index.d.ts": "export declare class Unused {}\n",
    "node_modules/express/package.json": "{ broken",
}


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("ambient")
    for name, text in TREE.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return root


@pytest.fixture(scope="module")
def indexed(spark, tree):
    return project.index(spark, str(tree), "r")


def test_files_of_imported_packages_alone(indexed):
    got = {(r["path"], r["owner"]) for r in indexed["files"].where("external = 1").collect()}
    assert got == {("node_modules/far-client/lib/main.d.ts", "far-client"), ("node_modules/far-client/lib/reply.d.ts", "far-client"), ("node_modules/@types/lab__kit/index.d.ts", "@lab/kit"), ("packages/one/node_modules/only-here/index.d.ts", "only-here")}
    assert indexed["files"].where("external = 0").count() == 2
    outside = indexed["files"].where("external = 1").select(F.col("id").alias("file_id"))
    assert indexed["refs"].join(outside, "file_id").count() == 0


def test_calls_are_proven_external(indexed):
    refs = indexed["refs"].select(F.col("id").alias("ref_id"), "name", "line")
    got = {(r["name"], r["line"]): r["reason"] for r in indexed["unresolved"].join(refs, "ref_id").collect()}
    assert {got[k] for k in [("request", 8), ("body", 8), ("trim", 8), ("open", 9), ("request", 9), ("Client", 11), ("close", 12)]} == {"external:far-client"}
    assert got[("lift", 10)] == "external:@lab/kit" and got[("dive", 2)] == "external:only-here"
    assert got[("missing", 13)] == got[("then", 13)] == "external:nowhere"
    names = indexed["symbols"].select("id", "fqn")
    edges = indexed["edges"].join(names.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("b")), "to_symbol_id").collect()
    assert {r["b"] for r in edges} == {"src/app:App#own", "src/app:App#run"}  # no like-named own method is taken for the library's


def test_limits_and_hops(spark, tree):
    found = ambient.listing(spark, str(tree))
    wanted = spark.createDataFrame([("far-client",), ("unheard",)], "name string")
    paths = lambda **limits: sorted(r["path"].rpartition("/")[2] for r in ambient.declarations(found, wanted, **limits)[0].collect())
    assert paths() == ["main.d.ts", "reply.d.ts"] and paths(max_files=1) == ["main.d.ts"] and paths(max_bytes=60) == []
    assert paths(max_depth=9) == ["deep.d.ts", "main.d.ts", "reply.d.ts"]


def test_sync_keeps_libraries(spark, tree, indexed, tmp_path):
    project.write(indexed, str(tmp_path), "r")
    assert project.sync(spark, str(tree), str(tmp_path), "r") == {"unchanged": 2}
    assert project.read(spark, str(tmp_path), "r")["files"].where("external = 1").count() == 4
