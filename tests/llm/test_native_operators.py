"""URL filters, quality rules and chat formatting: SQL, hand-made cases, empty tables."""

from __future__ import annotations

import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from callweave.llm import chat, oracles, quality, url_filter
from callweave.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_agrees(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


PAGES = [
    (1, "http://a.org/es/1", ""),
    (2, "https://b.xyz/1", '<LINK rel="canonical" href="http://A.org/es/1">'),
    (3, "http://c.xyz/x/y?q#f", '<meta http-equiv=refresh content="0; url=//b.xyz/1">'),
    (4, "http://c.xyz/x/z", "<link href=y?q rel=canonical>"),
    (5, "http://d.xyz", '<link rel=canonical href="/k">'),
    (6, "http://d.xyz/k", None),
    (7, "http://e.com/en/9", '<link rel=canonical href="http://net.net/de/1">'),
    (8, "http://f.q/1", '<link rel=canonical href="http://e.com/en/9">'),
    (9, None, "x"),
    (10, "nourl", '<link rel=canonical href="http://e.com/en/9">'),
    (11, "HTTP://Sub.Example.com/en/77", ""),
    (11, "HTTP://Sub.Example.com/en/77", ""),
    (None, "http://g.com/en/", ""),
]


def test_url_verdicts(spark):
    pages = spark.createDataFrame([(*p, "clash", "clash") for p in PAGES], "page_id long, url string, html string, host string, component string")
    got = sorted(((r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judged(pages).collect()), key=repr)
    want = [
        (1, "a.org", "/es/1", "org/es/", "block"),
        (2, "b.xyz", "/1", None, "block"),
        (3, "c.xyz", "/x/y", None, "block"),
        (4, "c.xyz", "/x/z", None, "block"),
        (5, "d.xyz", "", None, "allow"),
        (6, "d.xyz", "/k", None, "allow"),
        (7, "e.com", "/en/9", "com/en/", "block"),  # a rule of its own stands against the allowed alias
        (8, "f.q", "/1", None, "allow"),  # an allowed alias outweighs a blocked one
        (9, "", "", None, "allow"),
        (10, "", "", None, "allow"),
        (11, "sub.example.com", "/en/77", "example.com/en/7", "allow"),
        (11, "sub.example.com", "/en/77", "example.com/en/7", "allow"),
        (None, "g.com", "/en/", "com/en/", "block"),
    ]
    assert got == sorted(want, key=repr)


def test_long_alias_chain(spark):
    """A chain of redirects far from the blocked end."""
    n = 40
    rows = [(i, f"http://h{i}.xyz/p", f'<link rel="canonical" href="http://h{i + 1}.xyz/p">' if i < n else '<link rel="canonical" href="http://bad.org/es/">') for i in range(n + 1)]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).select("verdict").distinct().collect()
    assert [r["verdict"] for r in got] == ["block"]


LINKS = [
    ('<link rel=canonical href=""><link rel="canonical" href="http://a.x/1"><link rel=canonical href="http://a.x/2">', ["a.x/1", "a.x/2"]),
    ('<meta http-equiv="refresh" content="5"><meta http-equiv="refresh" content="0; url=http://a.x/3">', ["a.x/3"]),
    ('<link rel="alternate canonical" href="/k">', ["p.x/k"]),
    ('<link rel="noncanonical" href="/k"><link rel="stylesheet" href="canonical">', []),
    ('<link rel="canonical" href="http://a.x/p?a=1&amp;b=2&#38;c=3&#x26;d=&amp;lt;&#233;&nope;">', ["a.x/p?a=1&b=2&c=3&d=&lt;é&nope;"]),
    ('<link rel="canonical" href="../c/./d"><link rel=canonical href="./e">', ["p.x/a/c/d", "p.x/a/b/e"]),
    ('<link rel="canonical" href="../../../../f/.."><link rel=canonical href="?q=http://z.x/">', ["p.x/", "p.x/a/b/page?q=http://z.x/"]),
    ('<link rel="canonical" href="mailto:x@y.z">', []),
]


def test_all_links_of_a_page(spark):
    for html, want in LINKS:
        pages = spark.createDataFrame([("http://p.x/a/b/page", html)], "url string, html string")
        assert sorted(tuple(r) for r in url_filter.link_edges(pages).collect()) == sorted(("p.x/a/b/page", b) for b in want), html


def test_plan_of_links_stays_small(spark, capsys):
    """Steps put into one another made plans of millions of characters, which filled the driver's memory for any input."""
    url_filter.link_edges(spark.read.parquet("/root/testdata/sf0.001/pages.parquet")).explain(True)
    assert 1_000 < len(capsys.readouterr().out) < 200_000


def test_block_reaches_every_alias(spark):
    rows = [(1, "http://p.x/1", '<link rel=canonical href="http://q.x/2"><link rel="canonical" href="http://r.x/3?a=1&amp;b=2">'), (2, "http://r.x/3?a=1&b=2", '<meta http-equiv=refresh content="0; url=http://bad.org/x/../es/1">')]
    got = url_filter.judged(spark.createDataFrame(rows, "page_id long, url string, html string")).select("verdict").collect()
    assert [r["verdict"] for r in got] == ["block", "block"]


def test_linked_pages_equal_sql(spark, tmp_path):
    """Every third page of the test table linked to others, by each kind of address; verdicts as SQL has them."""
    table = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    kinds = ['<link rel=canonical href="http://a.net/de/{}">', '<meta http-equiv=refresh content="0; url=//sub.example.com:80/en/7/{}">', '<link href="../x/{}" rel="alternate canonical">', '<link rel=canonical href="?a={}&amp;b=1"><link rel="canonical" href="/es/{}/.">']
    tags = F.element_at(F.array(*[F.lit(k) for k in kinds]), (F.col("page_id") % len(kinds) + 1).cast("int"))
    linked = table.withColumn("html", F.when(F.col("page_id") % 3 == 0, F.concat("html", F.replace(tags, F.lit("{}"), (F.col("page_id") % 5).cast("string")))).otherwise(F.col("html")))
    hand = spark.createDataFrame([(1000 + i, f"http://p{i}.x/a/b/page", html) for i, (html, _) in enumerate(LINKS)] + [(2000 + (p[0] or 0), p[1], p[2]) for p in PAGES], table.schema)
    linked.unionByName(hand).write.parquet(path := str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{path}/*.parquet'")
    got = url_filter.judged(spark.read.parquet(path))
    names = ", ".join(f'"{c}"' for c in got.columns)
    rows = sorted((tuple(r) for r in got.collect()), key=repr)
    assert rows == sorted(con.execute(f"select {names} from ({ORACLE_SQL['op2_url_filters']})").fetchall(), key=repr)
    assert sum(r[5] is not None for r in rows) >= 15


def test_url_rules_of_one_length_and_many(spark):
    """Allow before block, then the greater string; a table of very many rules; a very long page."""
    rules = [("block", "q.com/x"), ("allow", "q.com/x"), ("block", "com/y/z"), ("block", "q.com/y")]
    pages = spark.createDataFrame([(1, "http://q.com/xa", "z" * 2_000_000 + "<link rel=canonical href='/w'>"), (2, "http://q.com/y/z", ""), (3, "http://q.com/w", "")], "page_id long, url string, html string")
    want = [(1, "q.com/x", "allow"), (2, "q.com/y", "block"), (3, None, "allow")]
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, rules).collect()) == want
    many = spark.range(50_000).select(F.lit("block").alias("verdict"), F.concat(F.lit("h"), "id", F.lit(".net/p"), "id").alias("rule"))
    many = many.unionByName(spark.createDataFrame(rules, "verdict string, rule string"))
    assert sorted((r["page_id"], r["rule"], r["verdict"]) for r in url_filter.judged(pages, many).collect()) == want


def test_url_empty(spark):
    assert url_filter.judged(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def _measures(text: str | None) -> tuple:
    """The base measures, restated."""
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for k in range(8)}
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered), failed)


def test_quality_measures(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "w " * 7, "w " * 8, "w " * 9, "x y \x0b z\x0c", "é😀 " * 30, "l1\nl1\n \n l1\nl1", "a\\b " * 40]
    texts += [" ".join(rng.choice(["a", "b", "#c", "d|e", "f\n"]) for _ in range(rng.randint(0, 60))) for _ in range(60)]
    texts += [" ".join(f"w{i % 97}" for i in range(5000))]
    docs = spark.createDataFrame([(i, t, None if i % 3 else "en", None if i % 5 else "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    docs = docs.unionByName(docs.limit(1))
    got = sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.judged(docs, [F.col("doc_id")]).collect())
    assert got == sorted((i, *_measures(t)) for i, t in [*enumerate(texts), (0, texts[0])])


def test_quality_threshold_follows_the_group(spark):
    """A share of symbols that is odd in one source is usual in another."""
    plain = [(i, " ".join(f"word{i}x{j}" for j in range(30)), "en", "a") for i in range(200)]
    coded = [(1000 + i, " ".join(f"#wo{i}x{j}" for j in range(30)), "en", "b") for i in range(200)]
    odd = [(5000, plain[0][1].replace("word", "#wo"), "en", "a")]
    docs = spark.createDataFrame([*plain, *coded, *odd], "doc_id long, text string, lang string, source string")
    kept = {r["doc_id"]: r["kept"] for r in quality.judged(docs, [F.col("doc_id")]).collect()}
    assert not kept[5000] and all(kept[i] for i in kept if i != 5000)
    assert quality.keep(docs).columns == docs.columns and quality.keep(docs).count() == 400


def test_quality_fences_are_bounded_by_the_language(spark):
    """A source of which 40 % repeat their lines doesn't set its own standard; its clean texts stay."""
    clean = lambda i: "\n".join(f"w{i}a{j} b c{j} d e{j}" for j in range(10))
    junk = lambda i: "\n".join(f"w{i}a{j % 5} b c{j % 5} d e{j % 5} line{j // 10}" for j in range(10))
    rows = [(i, clean(i), "en", "a", 1, 1) for i in range(500)] + [(1000 + i, junk(i) if i % 5 < 2 else clean(1000 + i), "en", "b", 1, 1) for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __doc_id int, __h int")
    judged = {r["doc_id"]: (r["duplicates"], r["base_failed"], r["kept"]) for r in quality.judged(docs, [F.col("doc_id")]).collect()}
    assert all((r["kept"]) == (not r["base_failed"] and r["duplicates"] <= 250) for r in quality.judged(docs, [F.col("doc_id")]).collect()), judged
    assert quality.keep(docs).columns == docs.columns and {r["doc_id"] for r in quality.keep(docs).collect()} == {k for k, v in judged.items() if v[2]}


def test_quality_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality.judged(docs, [F.col("doc_id")]).count() == 0
    assert quality.keep(docs).count() == 0


def test_bucket_is_within_a_thirtysecond(spark):
    rows = spark.range(0, 5000).unionByName(spark.range(1 << 40, (1 << 40) + 50)).select("id", quality.bucket(F.col("id")).alias("b")).collect()
    assert all(r["b"] <= r["id"] and (r["id"] - r["b"]) * 32 <= max(r["id"], 1) for r in rows)


TURNS = [
    (1, 0, "u", "Hello there\n\nSecond para"),
    (1, 1, "a", "> hello   THERE\nYes"),
    (1, 2, "u", ">> Hello there\n> Yes\nno\n\n> Second para\nok"),
    (1, 3, "a", ">no\n reply"),
    (1, 3, "a", "dup row"),
    (2, 0, "u", None),
    (2, 1, "u", ""),
    (2, 2, "u", "> Hello there"),
    (None, 1, "u", "> x\ny"),
    (3, None, "u", "> x"),
    (1, 4, None, "> > hello there\n\t> ok\nfin"),
]


def test_chat_links(spark, tmp_path):
    turns = spark.createDataFrame([(*t, 7) for t in TURNS], "conv_id long, turn long, role string, text string, depth int")
    got = sorted((tuple(r) for r in chat.linked(turns).collect()), key=repr)
    assert (1, 2, "u", "no\n\nok", 3, 3, 1, 0, 2) in got
    assert (1, 3, "a", "reply", 1, 1, 2, 0, 3) in got and (1, 3, "a", "dup row", 1, 1, 2, 0, 3) in got
    assert (2, 2, "u", "", 1, 0, None, 2, 0) in got  # quoted from another conversation: no link
    assert (None, 1, "u", "y", 0, 0, None, 1, 0) in got
    turns.write.parquet(path := str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    names = ", ".join(f'"{c}"' for c in chat.linked(turns).columns)
    assert sorted(con.execute(f"select {names} from ({oracles.CHAT})").fetchall(), key=repr) == got


def test_chat_pieces_and_the_test_table_with_quotes(spark, tmp_path):
    """Quotes trimmed to a line or sentence or wrapped anew; turns of the test table quoting earlier ones; all as SQL has it."""
    hand = [
        (1, 0, "u", "First line of it\nsecond line of it. And a third sentence here.\n\nyes"),
        (1, 1, "a", "> second line of it. And a third\n> sentence here.\nok"),  # a part, wrapped anew
        (1, 2, "u", "> and a third   sentence here.\nfine"),
        (1, 3, "a", "> line of\nshort pieces link nothing"),
        (1, 4, "u", "> FIRST line of it\n\n> nobody said this one\nmixed " + "x" * 300_000),
    ]
    table = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text")
    earlier = table.select(F.col("conv_id").alias("c"), (F.col("turn") + 1).alias("t"), F.concat(F.lit("> "), F.replace("text", F.lit("\n"), F.lit("\n> ")), F.lit("\n")).alias("quote"))
    quoting = table.join(earlier, (F.col("conv_id") == F.col("c")) & (F.col("turn") == F.col("t")), "left").select("conv_id", "turn", "role", F.when(F.col("turn") % 2 == 1, F.concat(F.coalesce("quote", F.lit("")), "text")).otherwise(F.col("text")).alias("text"))
    quoting.unionByName(spark.createDataFrame([(c + 10**6, *t) for c, *t in hand], "conv_id long, turn long, role string, text string")).write.parquet(path := str(tmp_path / "t"))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/*.parquet'")
    linked = chat.linked(spark.read.parquet(path))
    names = ", ".join(f'"{c}"' for c in linked.columns)
    got = sorted((tuple(r) for r in linked.collect()), key=repr)
    assert sorted(con.execute(f"select {names} from ({oracles.CHAT})").fetchall(), key=repr) == got
    found = {r[1]: r[4:] for r in got if r[0] == 10**6 + 1}
    assert found == {0: (0, 0, None, 0, 0), 1: (1, 1, 0, 0, 1), 2: (1, 1, 0, 0, 1), 3: (1, 0, None, 3, 0), 4: (2, 1, 0, 0, 1)}
    assert sum(r[5] for r in got if r[0] < 10**6) > 10


def test_chat_deep_thread_and_order(spark):
    rows = [(1, 0, "u", "m0")] + [(1, i, "u", f"> m{i - 1}\nm{i}") for i in range(1, 35)]
    got = {r["turn"]: r for r in chat.linked(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert all(got[i]["root_turn"] == 0 and got[i]["depth"] == i and got[i]["text"] == f"m{i}" for i in range(35))
    assert all(got[i]["parent_turn"] < i for i in range(1, 35))


def test_chat_empty(spark):
    assert chat.linked(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_chat_lines_of_very_many_marks(spark):
    rows = [("c", 1, "user", "said before by me"), ("c", 2, "assistant", ">" * 1_000_000 + " said before by me\n> > \tsaid before by me"), ("c", 3, "user", "> a\nb c d\n" * 3_000)]
    got = {r["turn"]: r for r in chat.linked(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert (got[2]["n_quotes"], got[2]["n_linked"], got[2]["parent_turn"], got[2]["text"]) == (2, 2, 1, "")
    assert got[3]["n_quotes"] == 3_000
