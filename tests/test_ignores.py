"""Listings against git's own, on trees with nested ignore files, negations and forced files."""

from __future__ import annotations

import os
import subprocess

import pytest

from callweave.sources import ignores
from callweave.sources.files import read_tree

FILES = {
    ".gitignore": "*.gen.ts\n!keep.gen.ts\n/out/\nlogs\n!/pkg/logs/\nnode_modules\n!pkg/node_modules\n# note\n\\#odd.ts\ndocs/**/draft.ts\nspace\\ name.ts  \na[0-9x].ts\n[!m]z.ts\n/only.ts\nfoo/*\n!foo/bar\n**/deep/er.ts\nabc/**\n?q.ts\n",
    "src/.gitignore": "gone.ts\n!x.gen.ts\n/rooted.ts\nsub/inner.ts\n*.tmp.ts\n",
    "src/sub/.gitignore": "!gone.ts\n!y.tmp.ts\nlocal/\n",
    ".git/info/exclude": "secret.ts\n!x9.ts\n",
}
SOURCES = """a.ts b.gen.ts keep.gen.ts out/a.ts src/out/a.ts logs/l.ts pkg/logs/l.ts node_modules/m.ts pkg/node_modules/m.ts #odd.ts docs/draft.ts docs/a/b/draft.ts docs/final.ts
a1.ts ax.ts ay.ts mz.ts nz.ts only.ts src/only.ts foo/x.ts foo/bar/y.ts foo/baz/y.ts deep/er.ts q/deep/er.ts abc/d/e.ts abc/f.ts xq.ts xxq.ts src/gone.ts src/x.gen.ts
src/rooted.ts src/in/rooted.ts src/sub/inner.ts src/sub/gone.ts src/a.tmp.ts src/sub/y.tmp.ts src/sub/local/z.ts src/local/z.ts secret.ts src/secret.ts _lead.ts src/__tests__/t.ts src/_u/__v/_w.ts build/b.ts org/build/c.ts forced.gen.ts""".split()
SPACED = ["space name.ts"]


def git(root, *args):
    env = {**os.environ, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
    return subprocess.run(["git", "-C", str(root), *args], check=True, capture_output=True, env=env).stdout.decode()


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("listing")
    git(root, "init", "-q")
    for path, text in [*FILES.items(), *((p, "let x = 1\n") for p in SOURCES + SPACED)]:
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    git(root, "add", "a.ts", "src/x.gen.ts", "build/b.ts", "docs/final.ts")
    git(root, "add", "-f", "forced.gen.ts", "src/gone.ts")
    return root


def listing(root, *args):
    return {p for p in git(root, "ls-files", "-z", "--exclude-standard", *args).split("\0") if p.endswith(".ts")}


def test_listing_equals_git(spark, tree):
    want = listing(tree, "--cached", "--others") - listing(tree, "--cached", "--ignored")
    assert {r["path"] for r in read_tree(spark, str(tree)).select("path").collect()} == want
    assert "src/__tests__/t.ts" in want and "_lead.ts" in want and "org/build/c.ts" in want and "pkg/node_modules/m.ts" in want and "forced.gen.ts" not in want


@pytest.mark.parametrize("version", ["2", "4"])
def test_index_entries_equal_git(spark, tree, version):
    git(tree, "update-index", "--index-version", version)
    got = {(r["path"], f"{r['mode']:o}", r["sha"], r["stage"]) for r in ignores.tracked(spark, str(tree)).collect()}
    want = {(p, m, s, int(n)) for m, s, n, p in (x.replace("\t", " ").split(" ", 3) for x in git(tree, "ls-files", "-s").splitlines())}
    assert got == want and len(got) == 6


def test_index_of_version_three(tmp_path):
    git(tmp_path, "init", "-q")
    for name in ("a.ts", "bb.ts"):
        (tmp_path / name).write_text("x")
    git(tmp_path, "add", ".")
    git(tmp_path, "update-index", "--skip-worktree", "bb.ts")
    data = (tmp_path / ".git/index").read_bytes()
    assert data[4:8] == b"\0\0\0\3" and [(e[0], e[4]) for e in ignores.index_entries(data)] == [("a.ts", False), ("bb.ts", True)]
    with pytest.raises(ValueError):
        list(ignores.index_entries(b"nope" + data[4:]))


def test_without_git_build_output_stays_out(spark, tmp_path):
    for p in ("a.ts", "build/b.ts", "x/dist/c.ts", "node_modules/d.ts", "kept/node_modules/e.ts", "A.JAVA"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("class A {}")
    paths = lambda: {r["path"] for r in read_tree(spark, str(tmp_path)).select("path").collect()}
    assert paths() == {"a.ts", "A.JAVA"}
    (tmp_path / ".gitignore").write_text("node_modules\n!kept/node_modules\n")
    assert paths() == {"a.ts", "A.JAVA", "kept/node_modules/e.ts"}
