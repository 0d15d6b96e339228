"""Class files of a compiled library: signatures as source has them, and what they prove of calls."""

from __future__ import annotations

import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from callweave import project
from callweave.sources import classfiles

LIBRARY = {
    "far/lib/Client.java": """package far.lib;
import java.util.*;
public class Client<T extends Number> extends Base implements Runnable {
  public static final Map<String, List<int[]>> TABLE = null;
  long big; double wide = 2.5;
  public Client(String name) { }
  public Reply send(String path, int... codes) { return null; }
  public <R> Optional<R> first(List<? extends R> of, Map.Entry<String, T>[] more) { return null; }
  public static Client<Integer> open() { return null; }
  public void run() { }
  private void hidden() { }
  public class Inner { public T get() { return null; } }
}
class Base { public Reply last() { return null; } }
""",
    "far/lib/Reply.java": "package far.lib; public interface Reply { String body(); default Reply next(Object o) { return this; } Reply next(String s); }",
}
OWN = {
    "app/Main.java": """package app;
import far.lib.Client;
import far.lib.Reply;
import static far.lib.Client.open;
class Main {
  private Client<Integer> client;
  void go(Reply given) {
    client.send("a", 1, 2).next("b").body().trim().strip();
    client.last().body();
    new Client("x").run();
    given.next("s").body();
    own().body();
    open();
    client.vanish();
  }
  Main own() { return this; }
  void body() { }
  void run() { }
  void send(String a) { }
}
""",
}
JAVA_BASE = "/usr/lib/jvm/java-17-openjdk-amd64/jmods/java.base.jmod"


@pytest.fixture(scope="module")
def jar(tmp_path_factory):
    if not shutil.which("javac"):
        pytest.skip("no Java compiler")
    root = tmp_path_factory.mktemp("library")
    for name, text in LIBRARY.items():
        (root / "src" / name).parent.mkdir(parents=True, exist_ok=True)
        (root / "src" / name).write_text(text)
    subprocess.run(["javac", "-d", str(root / "out"), *[str(root / "src" / n) for n in LIBRARY]], check=True, capture_output=True)
    out = str(root / "far.jar")
    subprocess.run(["jar", "cf", out, "-C", str(root / "out"), "."], check=True, capture_output=True)
    return out


def test_signatures(spark, jar, tmp_path):
    (tmp_path / "a-broken.jar").write_bytes(b"no archive")
    wanted = spark.createDataFrame([("far.lib.Client",), ("far.lib.Client.Inner",), ("far.lib.Unknown",)], "fqn string")
    rows = classfiles.signatures(spark, [jar, str(tmp_path / "a-broken.jar")], wanted).collect()
    got = {(r["fqn"].rpartition(".")[2], r["kind"], r["name"], r["type_name"], r["type_args"], tuple(r["params"]) if r["params"] is not None else None) for r in rows}
    want = {
        ("Client", "class", "Client", None, None, None), ("Inner", "class", "Inner", None, None, None),
        ("Client", "field", "TABLE", "java.util.Map", "java.lang.String, java.util.List<int[]>", None), ("Client", "field", "big", "long", None, None), ("Client", "field", "wide", "double", None, None),
        ("Client", "constructor", "Client", None, None, ("java.lang.String",)), ("Client", "method", "send", "far.lib.Reply", None, ("java.lang.String", "int...")),
        ("Client", "method", "first", "java.util.Optional", "R", ("java.util.List", "java.util.Map.Entry[]")), ("Client", "method", "open", "far.lib.Client", "java.lang.Integer", ()), ("Client", "method", "run", "void", None, ()),
        ("Inner", "constructor", "Inner", None, None, ("far.lib.Client",)), ("Inner", "method", "get", "T", None, ()),
    }
    assert got == want
    assert next(r["supertypes"] for r in rows if r["name"] == "Client" and r["kind"] == "class") == ["far.lib.Base", "java.lang.Runnable"]
    with pytest.raises(ValueError):
        list(classfiles.class_members(b"\0" * 40))


def test_library_types_answer_calls(spark, jar, tmp_path):
    for name, text in OWN.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    made = project.index(spark, str(tmp_path), "r", archives=[jar, JAVA_BASE])
    refs = made["refs"].select(F.col("id").alias("ref_id"), "name", "line")
    got = {(r["name"], r["line"]): r["reason"] for r in made["unresolved"].join(refs, "ref_id").collect()}
    assert {got[k] for k in [("send", 8), ("Client", 10), ("run", 10)]} == {"external:far.lib.Client"}
    assert {got[k] for k in [("next", 8), ("body", 8), ("next", 11), ("body", 11)]} == {"external:far.lib.Reply"}
    assert got[("trim", 8)] == got[("strip", 8)] == "external:java.lang.String"
    names = made["symbols"].select("id", "fqn")
    edges = {r["b"] for r in made["edges"].join(names.select(F.col("id").alias("to_symbol_id"), F.col("fqn").alias("b")), "to_symbol_id").collect()}
    assert edges == {"app.Main.own", "app.Main.body"}
    assert made["files"].where("external = 1 and path = 'jvm:java.lang.String'").count() == 1
