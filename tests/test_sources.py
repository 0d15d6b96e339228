"""Rails schema and routes, module resolution, re-exports."""

from __future__ import annotations

from callweave.sources import modules, rails

SCHEMA = '''ActiveRecord::Schema.define do
  create_table "line_items", force: :cascade do |t|
    t.string "name", null: false
    t.integer "count"
    t.index ["name"], name: "x"
    t.index "name"
    t.check_constraint "count > 0"
  end

  create_table 'tags_posts', id: false do |x|
    x.bigint 'tag_id'
    t.string "other"
  end
end
'''

ROUTES = """Rails.application.routes.draw do
  root to: 'home#show' # not '#this'
  namespace :api do
    resources :things, only: [:index, :show] do
      member do
        post :publish
      end
      get :recent, on: :collection
      collection do
        get 'export', to: 'exports#run'
      end
      resource :owner, only: %i[show]
    end
  end
  scope '/v2', module: :next do
    get '/ping' => 'health#ping'
    match 'both', to: 'a/b#c', via: [:get, :post]
  end
  resources :users, except: [:destroy, :edit], path: 'people'
  delete "/out", to: "sessions#destroy"
end
"""


def test_schema_columns_and_attributes(spark):
    got = {tuple(r) for r in rails.schema_columns(spark.createDataFrame([(SCHEMA,)], "text string")).collect()}
    assert got == {("line_items", "name"), ("line_items", "count"), ("line_items", "id"), ("tags_posts", "tag_id")}
    columns = spark.createDataFrame(sorted(got), "table string, column string")
    symbols = spark.createDataFrame([("Shop::LineItem", "class"), ("LineItems", "method")], "fqn string, kind string")
    names = {(r["container_fqn"], r["name"]) for r in rails.column_attributes(columns, symbols).collect()}
    assert names == {("Shop::LineItem", n + e) for n in ("name", "count", "id") for e in ("", "=", "?")}


def test_routes(spark):
    got = {(v, p, c, a) for v, p, c, a, _ in rails.rails_routes(ROUTES)}
    for want in [
        ("GET", "/", "Home", "show"), ("GET", "/api/things", "Api::Things", "index"), ("GET", "/api/things/{}", "Api::Things", "show"), ("POST", "/api/things/{}/publish", "Api::Things", "publish"),
        ("GET", "/api/things/recent", "Api::Things", "recent"), ("GET", "/api/things/export", "Api::Exports", "run"), ("GET", "/api/things/{}/owner", "Api::Owners", "show"), ("GET", "/v2/ping", "Next::Health", "ping"),
        ("GET", "/v2/both", "Next::A::B", "c"), ("POST", "/v2/both", "Next::A::B", "c"), ("GET", "/people", "Users", "index"), ("PATCH", "/people/{}", "Users", "update"), ("DELETE", "/out", "Sessions", "destroy"),
    ]:
        assert want in got, want
    assert not any(a in ("destroy", "edit") and c == "Users" for _, _, c, a in got) and ("POST", "/api/things", "Api::Things", "create") not in got
    frame = rails.routes(spark.createDataFrame([("config/routes.rb", ROUTES), ("x.rb", None)], "path string, text string"))
    assert frame.count() == len(rails.rails_routes(ROUTES)) and rails.rails_routes("end\nend\nget") == []


def test_modules(spark):
    configs = {"web/tsconfig.json": '{ // c\n "extends": "../base", "compilerOptions": {"baseUrl": "src", "paths": {"@app/*": ["app/*"], "@app/special": ["odd/place"],}} }', "base.json": '{"compilerOptions": {"strict": true}}'}
    options = modules.compiler_options(configs, "web/tsconfig.json")
    assert options["strict"] and options["baseUrl"] == "web/src"
    alias = modules.aliases(options)
    assert alias[0][:2] == ("@app/special", "web/src/odd/place") and alias[1][0] == "@app/"
    assert modules.package_entry('{"name": "@s/core", "exports": {".": {"import": "./lib/main.js"}}}', "packages/core") == ("@s/core", "packages/core/lib/main.js")
    assert modules.package_entry("{", "x") is None and modules.compiler_options({}, "x") == {}
    asked = [("web/src/a/b", "./c"), ("web/src/a/b", "../d"), ("web/src/a/b", "@app/x"), ("web/src/a/b", "@app/special"), ("web/src/a/b", "@s/core"), ("web/src/a/b", "react"), ("web/src/a/b", "./gone")]
    known = ["web/src/a/c", "web/src/d/index", "web/src/app/x", "web/src/odd/place", "packages/core/lib/main"]
    target = [(p, t + "/" if p.endswith("/") else t, i) for p, t, i in alias]
    got = modules.resolved_modules(
        spark.createDataFrame(asked, "from_module string, specifier string"), spark.createDataFrame([(k,) for k in known], "module string"), spark.createDataFrame(target, "prefix string, target string, at int"), spark.createDataFrame([("@s/core", "packages/core/lib/main.js")], "name string, entry string")
    )
    assert {r["specifier"]: r["module"] for r in got.collect()} == {"./c": known[0], "../d": known[1], "@app/x": known[2], "@app/special": known[3], "@s/core": known[4]}


def test_reexports_with_a_cycle(spark):
    direct = spark.createDataFrame([("a", "f"), ("a", "default"), ("c", "g")], "module string, name string")
    again = spark.createDataFrame([("b", "a", "*", None), ("b", "c", "*", None), ("c", "b", "*", None), ("d", "b", "h", "f"), ("d", "a", "main", "default")], "module string, from_module string, name string, orig string")
    got = {(r["module"], r["name"]): r["origin"] for r in modules.exported(direct, again).collect()}
    assert got == {("a", "f"): "a", ("a", "default"): "a", ("c", "g"): "c", ("b", "f"): "a", ("b", "g"): "c", ("c", "f"): "a", ("d", "h"): "a", ("d", "main"): "a"}


def test_a_tree_with_odd_files(spark, tmp_path):
    """Files that are no UTF-8, binary or too large are listed and refused; the rest are read."""
    from callweave.sources import files

    for name, content in [("a.java", b"class A {}\n"), ("latin.rb", b"# caf\xe9\nclass B\nend\n"), ("bin.js", b"\x00\x01\xff"), ("big.ts", b"x" * (8 * 1024 * 1024 + 5)), ("node_modules/z.js", b"1"), ("long.rb", b"# \xc3\xa9\n" * 600_000)]:
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(content)
    got = {r["path"]: (r["admission"], r["text"]) for r in files.read_tree(spark, str(tmp_path)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a.java": "ok", "latin.rb": "ok", "bin.js": "binary", "big.ts": "too-large", "long.rb": "too-large"}
    assert got["latin.rb"][1] == "# caf\ufffd\nclass B\nend\n"
