"""Restoration, the classifier, and the pipeline's stages."""

from __future__ import annotations

import math
import re
import time
import zlib

import numpy as np
import pytest

import corpus_pipeline
from callweave.llm import quality, toxicity
from callweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.language_model(tables[0])


def test_language_model_counts_every_text(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, "AB é"), (3, None), (4, "")], "doc_id long, text string").repartition(3)
    n = np.zeros((64, 64, 64))
    for text in ("ab", "ab é"):
        c = [0, 0, *({"a": 1, "b": 2, " ": 0, "é": 27 + 0xE9 - 223}[x] for x in text), 0]
        for x, y, z in zip(c, c[1:], c[2:], strict=False):
            n[x, y, z] += 1
    assert np.allclose(toxicity.language_model(docs), toxicity.smoothed(n))
    assert np.allclose(np.exp(toxicity.language_model(docs)).sum(2), 1, atol=1e-4)


@pytest.mark.parametrize(("written", "meant"), [("1d10t", "idiot"), ("stup1d", "stupid"), ("$tup1d", "stupid"), ("l.o.s.e.r", "loser"), ("idioooot", "idiot"), ("tr@sh!!", "trash"), ("cl0wn,", "clown"), ("id-iot", "idiot")])
def test_restored(model, written, meant):
    restorer = toxicity.Restorer(model)
    assert restorer.restore(restorer.plain(written)) == meant


def test_restoring_leaves_others_alone(model):
    restorer = toxicity.Restorer(model)
    for word in ("hello", "4790808788808394", "a1b2c3d4e5f6", "the***", "", "!!!", "naïve", "x" * 100):
        assert restorer.restore(restorer.plain(word)) in (restorer.plain(word), "xx", "x")  # a stretched letter is one or two
    assert "idiot" in restorer.words("so i d i o t s i d i o t") or "idiotsidiot" in restorer.words("so i d i o t s i d i o t")
    assert restorer.text("You 1d10t, ok\n") == "You idiot ok\n"


def test_viterbi_is_the_best_of_all_readings(model):
    """Against every path of the lattice."""
    restorer = toxicity.Restorer(model)

    def readings(lattice):
        if not lattice:
            yield "", 0.0
            return
        for text, cost in lattice[0]:
            for rest, more in readings(lattice[1:]):
                yield text + rest, cost + more

    def value(text, cost):
        a = b = 0
        s = -cost
        for ch in text:
            c = int(toxicity.TABLE[min(ord(ch), len(toxicity.TABLE) - 1)])
            s += restorer.model[a][b][c]
            a, b = b, c
        return s + restorer.model[a][b][0]

    for word in ("1d10t", "l00s3r", "s.c.um", "aab1!!c", "m*r0n"):
        best = max(value(*r) for r in readings(restorer.lattice(word)))
        said = restorer.restore(word)
        assert math.isclose(best, max(value(t, c) for t, c in readings(restorer.lattice(word)) if t == said), rel_tol=1e-6)


def test_held_out_accuracy(tables):
    docs, labels = tables
    rows = toxicity.scored(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    toxic = [r["score"] for r in held if r["toxic"]]
    clean = [r["score"] for r in held if not r["toxic"]]
    auc = sum((t > c) + 0.5 * (t == c) for t in toxic for c in clean) / (len(toxic) * len(clean))
    assert auc > 0.9 and sum(r["predicted"] for r in held if not r["toxic"]) <= 0.03 * len(clean)


def test_held_out_labels_are_not_read(spark, tables):
    docs, labels = tables
    turned = labels.withColumn("toxic", toxicity.F.when(toxicity.held_out(), 1 - toxicity.F.col("toxic")).otherwise(toxicity.F.col("toxic")))
    one = {r["doc_id"]: r["score"] for r in toxicity.scored(docs, labels).collect()}
    assert one == {r["doc_id"]: r["score"] for r in toxicity.scored(docs, turned).collect()}


def test_obfuscated_texts_are_found(spark, tables):
    """Held-out toxic texts, their telling words written otherwise."""
    docs, labels = tables
    extra = spark.createDataFrame([(10**6 + i, f"the {w} of the and in that {w} with an {v} is") for i, (w, v) in enumerate([("1d10t", "stup1d"), ("l.o.s.e.r", "m0r0n"), ("tr@sh", "cl0wn"), ("w0rthl3ss", "p4thetic")])] + [(10**6 + 9, "the and in that with an is of")], "doc_id long, text string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.scored(docs.select("doc_id", "text").unionByName(extra), labels).where("doc_id >= 1000000").collect()}
    assert got == {10**6: 1, 10**6 + 1: 1, 10**6 + 2: 1, 10**6 + 3: 1, 10**6 + 9: 0}


SPACED = [
    "t h e i d i o t o f t h e a n d i n t h a t s t u p i d i s w i t h a n i d i o t o f t h e s t u p i d",
    "t h e   i d i o t   o f   t h e   a n d   i n   t h a t   s t u p i d   w i t h   a n   i d i o t   o f   t h e",
    "t, h. e i! d i o t, o f t h e a n d i n t h a t s t u p i d i s w i t h a n i d 1 o t, o f t h e s t u p i d !",
    "t.h.e.i.d.i.o.t.o.f.t.h.e.a.n.d.i.n.t.h.a.t.s.t.u.p.i.d.i.s.w.i.t.h.a.n.i.d.i.o.t",
]


@pytest.mark.parametrize("text", SPACED)
def test_spaced_sentences_are_read_as_words(model, text):
    assert {"idiot", "stupid"} <= toxicity.Restorer(model).words(text)


def test_long_spaced_text_is_read(model):
    assert "idiot" in toxicity.Restorer(model).words(" ".join("theidiotofthe" * 200))


def test_spaced_toxic_sentences_are_found(spark, tables):
    docs, labels = tables
    clean = ["t h e a n d i n t h a t w i t h a n i s o f t h e a n d i n t h a t w i t h a n i s", "the a b c of the"]
    extra = spark.createDataFrame([(10**6 + i, t) for i, t in enumerate([*SPACED, *clean])], "doc_id long, text string")
    got = {r["doc_id"] - 10**6: r["predicted"] for r in toxicity.scored(docs.select("doc_id", "text").unionByName(extra), labels).where("doc_id >= 1000000").collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 1, 4: 0, 5: 0}


def test_no_labels_nulls_and_empty(spark):
    docs = spark.createDataFrame([(1, None, "x"), (None, "", "y"), (2, "a b c", "z"), (2, "a b c", "z")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.scored(docs, none).collect()
    assert len(rows) == 4 and all(r["score"] == 0.5 and r["predicted"] == 0 for r in rows)
    one_kind = spark.createDataFrame([(1, 1, 0), (2, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert all(r["predicted"] == 0 for r in toxicity.scored(docs, one_kind).collect())
    assert toxicity.scored(docs.limit(0), none).count() == 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "n-gram Jaccard join", "best-fit packing"]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    first = corpus_pipeline.drop_toxic(spark, docs, SF)
    gone = {r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 1").collect()}
    kept = {r["doc_id"] for r in first.collect()}
    assert first.columns == docs.columns and gone and kept == {r["doc_id"] for r in docs.select("doc_id").collect()} - gone
    second = corpus_pipeline.drop_low_quality(spark, docs, SF)
    passed = {r["doc_id"] for r in quality.judged(docs, [docs["doc_id"]]).where("kept").collect()}
    assert second.columns == docs.columns and {r["doc_id"] for r in second.collect()} == passed
    third = corpus_pipeline.drop_near_copies(spark, docs, SF)
    assert third.columns == docs.columns and 0 < third.count() < docs.count()


def test_words_of_any_length_are_read(model):
    """A stretched or masked word among hundreds of characters, and one of 100,000."""
    restorer = toxicity.Restorer(model)
    long = "1d10t" * 40
    assert restorer.suspicious(long) and restorer.restore(long).startswith("idiot") and restorer.restore(long).isalpha()
    assert "idiot" in restorer.words("x" + "theidiotofthe" * 30) or any("idiot" in w for w in restorer.words("theidiotofthe" * 30))
    assert toxicity.features("a" * 1000) and len(toxicity.features("a" * 1000)) == 9
    assert len(restorer.restore("a-b" * 30_000)) >= 60_000


def test_keep_with_clashing_columns(spark, tables):
    docs, labels = tables
    named = docs.selectExpr("*", "1 as k", "2 as toxic", "3 as fold", "4 as score", "5 as n", "6 as top_symbols", "7 as kept", "8 as t_lang")
    assert toxicity.keep(named.limit(50), labels).columns == named.columns
    assert quality.keep(named).columns == named.columns
    assert quality.keep(named).count() == quality.keep(docs).count()


def test_pipeline_end_to_end(spark, duck):
    """Each stage restated: scores of the operator, rules in SQL, all pairs, ids of the tokenizers library; the packing checked for what it must hold."""
    from tokenizers import Tokenizer

    from callweave.llm import oracles
    from tests.llm.test_ngram_join import brute

    folder = "/root/testdata/sf0.001"
    con = duck(folder)
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    clean = [r["doc_id"] for r in toxicity.scored(docs, labels).where("predicted = 0").collect()]
    con.execute(f"create table clean as select * from documents where doc_id in ({', '.join(map(str, clean))})")
    good = {r[0]: r[1] for r in con.execute(f"select d.doc_id, d.text from clean d join ({oracles.quality_sql('clean')}) j on d.doc_id = j.doc_id where j.kept").fetchall()}
    alone = {k for k, c in brute(list(good.items()), 5, 80).items() if k == c}
    assert 0 < len(alone) < len(good) < len(clean) <= docs.count()
    encode = Tokenizer.from_file(QUERIES["op3_best_fit_packing"].__globals__["tokenizer_files"]()[1])
    want = {}
    for k in alone:
        ids = [*encode.encode(good[k] or "", add_special_tokens=False).ids, 2]
        first = len(ids) % 1024 or 1024
        for i, s in enumerate([0, *range(first, len(ids), 1024)]):
            part = np.array(ids[s : first if i == 0 else s + 1024], "<u4")
            want[k, i] = (s, len(part), zlib.crc32(part.tobytes()))
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want and len(rows) == len(want)
    places = {}
    for r in rows:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in places.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(places) <= 1 + 1.05 * sum(r["length"] for r in rows) / 1024
    assert corpus_pipeline.ORACLE_SQL is None and "op5_toxicity" in QUERIES


def test_long_runs_of_marks_take_no_time(spark):
    restorer = toxicity.Restorer(np.zeros((toxicity.CLASSES,) * 3, np.float32))
    pattern = re.compile(r"(?:([^\w\s])\1{2,}|[!?.,;:)\]}\"'»…|]+)+$")  # what ``plain`` does, for short words
    for word in ["a", "", "...", "a...", "a###", "a##", "a#!#!", "a!###!!", "a_ __", "b́---", "###", "a##!", "é»…||", "chapter...12"]:
        assert restorer.plain(word) == restorer.HEAD.sub("", pattern.sub("", word))
    start = time.perf_counter()
    for marks in (".", "!?", "#", "-.", "…|"):
        for word in ("chapter" + marks * 100_000 + "12", "chapter" + marks * 100_000):
            restorer.plain(word)
            marked = toxicity.Marked(restorer, {"=chapter": (1.0, 1.0)})
            marked.summary(f"some {word} words")
    assert time.perf_counter() - start < 60


def test_words_that_no_weight_begins_make_no_features(monkeypatch):
    import numpy as np

    from callweave.llm import toxicity

    made = []
    original = toxicity.features
    monkeypatch.setattr(toxicity, "features", lambda w: made.append(w) or original(w))
    marked = toxicity.Marked(toxicity.Restorer(np.zeros((64, 64, 64), np.float32)), {"=idiot": (3.0, 2.0), ">tupid": (2.0, 1.0)})
    assert marked.summary("plain words stand here, idiot and stupid")[:2] == [3.0, 2.0]
    assert sorted(made) == ["idiot", "stupid"]
