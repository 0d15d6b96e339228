"""The command line over a small stored index; source slices; path lists."""

from __future__ import annotations

import json

import pytest

from callweave import cli, report
from tests.test_project import TREE


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    root, store = tmp_path_factory.mktemp("tree"), str(tmp_path_factory.mktemp("store"))
    tree = TREE | {"src/test/shop/OrderTest.java": "package shop; class OrderTest { void pays() { new Order(\"1\").pay(1); } }"}
    for name, text in tree.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    assert cli.main(["index", store, "r", str(root)]) == 0
    return store


def said(capsys, *argv):
    code = cli.main([*argv, "--json"])
    return json.loads(capsys.readouterr().out.strip().split("\n")[-1]), code


def test_commands(store, capsys):
    capsys.readouterr()
    status, _ = said(capsys, "status", store, "r")
    assert status[0]["linked"] + status[0]["library"] + status[0]["missed"] == status[0]["refs"] > 0
    assert said(capsys, "query", store, "r", "Order")[0][0]["fqn"] == "shop.Order"
    callers, _ = said(capsys, "callers", store, "r", "Repo#load")
    assert [c["fqn"] for c in callers] == ["shop.web.Api.show"]
    callees, _ = said(capsys, "callees", store, "r", "SqlRepo#put")
    assert [c["fqn"] for c in callees] == ["shop.Base.audit"]
    impact, _ = said(capsys, "impact", store, "r", "Base#helper")
    assert {(r["depth"], r["fqn"]) for r in impact} >= {(1, "shop.Base.audit"), (2, "shop.SqlRepo.put")}
    assert [h["fqn"] for h in said(capsys, "path", store, "r", "SqlRepo#put", "Base#helper")[0]] == ["shop.Base.audit", "shop.Base.helper"]
    reached, code = said(capsys, "affected", store, "r", "src/shop/Order.java", "--fail-if-untested")
    assert code == 0 and {"src/test/shop/OrderTest.java", "src/shop/web/Api.java"} <= {r["path"] for r in reached}
    assert said(capsys, "affected", store, "r", "src/shop/web/Api.java", "--fail-if-untested")[1] == 2
    for command in ("dead", "cycles", "hotspots", "routes"):
        assert isinstance(said(capsys, command, store, "r")[0], list)
    with pytest.raises(SystemExit, match="ambiguous"):
        cli.main(["callers", store, "r", "pay"])
    with pytest.raises(SystemExit, match="nothing"):
        cli.main(["why", store, "r", "nowhere"])


def test_source_slices(spark):
    text = "a\nclass B {\n  😀 x;\n}\nz"
    start, end = text.index("class"), text.index("}") + 1
    symbols = spark.createDataFrame([(1, 7, 2, 4, start, end)], "id long, file_id long, start_line int, end_line int, start_byte int, end_byte int")
    texts = spark.createDataFrame([(7, text)], "file_id long, text string")
    assert report.source_slices(symbols, texts).first()["source"] == "2 | class B {\n3 |   😀 x;\n4 | }"
    assert report.source_slices(symbols, texts, 1).first()["source"] == "2 | class B {\n  | ... (2 more lines, to line 4)"


def test_changed_paths():
    assert report.changed_paths(["/r/a/b.java", "c.rb", "./d.ts", "", "c.rb"], "/r") == ["a/b.java", "c.rb", "d.ts"]
    assert report.changed_paths(["x.rb"], "/r", "/r/lib") == ["lib/x.rb"]
    assert report.reason_text("ambiguous-name") != "ambiguous-name" and report.reason_text(None) == "unresolved"
