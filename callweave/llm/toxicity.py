"""Toxicity of texts read through a noisy channel.

Words written to escape a filter (l33t letters, stre-e-etched or s p a c e d ones) span a lattice of
what each character may stand for. A Viterbi search finds the reading that a character trigram
model of the corpus likes best, net of the channel's costs, and the restored words are scored.

Between single characters that stand apart the lattice carries a blank too, so that whole sentences
written so, of any length and with marks, are read as words.

1. ``language_model``: trigram counts of 64 character classes over every whole text, summed within
   tasks and then across them: a table of fixed size (64 cubed at most).
2. ``fitted``: for each feature (a restored word, its beginnings of 3 to 8 letters and its ends) the number of toxic
   and of clean training documents that have it. Features whose log-likelihood ratio exceeds
   what the best of that many random ones would reach, and whose odds are ``LEAST_RATIO`` at least, get their
   log odds as weight. A word's evidence is the largest weight of its features. A logistic
   regression over a document's evidence (``summary``) is fitted with the weights that the other half of
   the sample gave, so that chance features aren't believed. The sample is bounded and documented:
   at most ``SAMPLE`` labelled rows of either label, those of the least hash of doc_id, so it is
   the same on every run; only that bounded table is broadcast, and the prior is that of all training labels. A model
   keeps every feature that passes both tests: a few thousand at most, as each must stand in several of the sample's toxic documents.
3. ``scored``: one pass over all whole texts. Labels, language, source and doc_id are no inputs of a score.

Words and texts of any length are read whole: the search keeps a few paths and takes time in proportion. No shuffle carries texts. Null and empty texts get the prior. Labels of held-out documents (crc32 of doc_id
as text, modulo 3, is 1) aren't read. Null doc_ids are not held out and have no labels; labels that repeat a
doc_id count as toxic if any is. Repeated rows get one score each. Other columns play no part. With no labels of one kind there are no weights: all get the prior (1/2 without labels).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterable, Iterator
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch

SAMPLE, LEAST_RATIO, THRESHOLD, CACHE = 10_000, 5.0, 0.7, 250_000
RIDGE, CAUTION = 1.0, 8
CLASSES = 64
#: What a written character may stand for besides itself.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i"}
MASK, SEPARATORS = "*", ".-_·'~`,"
#: Left out at the ends of a character that stands apart.
MARKS = ".,;:!?\"'()[]{}«»¿¡…|*#%&<>=/\\-_·~`"
#: Costs in nats: a stand-in, a masked letter, a separator left out, a repeated letter left out, one of two equal letters left out, a mark left out at the word's end, one left out within.
COST = {"leet": 1.0, "mask": 4.0, "separator": 1.5, "repeat": 0.5, "double": 2.0, "edge": 1.0, "mark": 4.0}
#: What a word's end costs between characters that stand equally far apart: read at each price (a bonus first), as the model knows neither every word nor every join.
BREAKS = (-2.0, 0.0, 2.0)
#: Longer words are read with blanks between their characters too.
LONG = 40
#: Longer words aren't kept in caches.
KEPT = 64

LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Feature to log odds, and to log odds as if CAUTION more clean documents had it.
Weights = dict[str, tuple[float, float]]


def _classes() -> np.ndarray:
    """Code point to class: 0 white space, 1 to 26 a to z, 27 to 59 the letters 223 to 255, 60 digits, 61 other letters, 62 the rest."""
    out = np.full(0x500, 62, np.int64)
    for c in range(len(out)):
        ch = chr(c)
        if ch.isspace():
            out[c] = 0
        elif ch in LETTERS:
            out[c] = 1 + LETTERS.index(ch)
        elif 223 <= c <= 255 and ch.isalpha():
            out[c] = 27 + c - 223
        elif ch.isdigit():
            out[c] = 60
        elif ch.isalpha():
            out[c] = 61
    return out


TABLE = _classes()


def classes(text: str) -> np.ndarray:
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    return TABLE[np.minimum(points, len(TABLE) - 1)]


def language_model(docs: DataFrame) -> np.ndarray:
    """Log probabilities [a, b, c] of class c after a and b, from all texts; interpolated with the shorter contexts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, held, size = np.zeros(CLASSES**3, np.int64), [], 0
        for b in batches:
            for t in b.column(0):
                if text := t.as_py():
                    c = np.concatenate(([0, 0], classes(text), [0]))
                    held.append((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:])
                    size += len(c)
                    if size >= 1 << 20:
                        counts += np.bincount(np.concatenate(held), minlength=CLASSES**3)
                        held, size = [], 0
        if held:
            counts += np.bincount(np.concatenate(held), minlength=CLASSES**3)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["cell", "n"])

    cells = docs.select("text").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(CLASSES**3)
    counts[cells["cell"].to_numpy(np.int64)] = cells["n"].to_numpy(float)
    return smoothed(counts.reshape(CLASSES, CLASSES, CLASSES))


def smoothed(n: np.ndarray) -> np.ndarray:
    uni = (n.sum((0, 1)) + 1) / (n.sum() + CLASSES)
    pairs = n.sum(0)
    bi = (pairs + 20 * uni) / (pairs.sum(1, keepdims=True) + 20)
    tri = (n + 20 * bi[None]) / (n.sum(2, keepdims=True) + 20)
    return np.log(tri).astype(np.float32)


class Restorer:
    """Restores words; ``model`` is that of ``language_model``."""

    ODD = re.compile(r"[^\W\d_]")
    TAIL = "!?.,;:)]}\"'»…|"
    HEAD = re.compile(r"^[\"'(\[{«¿.,;:*#%&|<>=/\\-]+")
    RUN = re.compile(r"([^\W\d_])\1\1")
    TOKEN = re.compile(r"\S+")
    #: So many marks in a row part words, as white space does: dot leaders, rules, cheers.
    RULE = re.compile(r"[^\w\s]{8,}")

    def __init__(self, model: np.ndarray) -> None:
        self.model = model.tolist()
        self.short: dict[tuple[str, tuple[bool, ...]], set[str]] = {}

    def plain(self, word: str) -> str:
        """Lower case, without marks at its ends: at its end those of ``TAIL`` and any three or more equal ones."""
        word = word.lower()
        end = len(word)
        while end:
            c, start = word[end - 1], end - 1
            if c not in self.TAIL:
                if c.isalnum() or c == "_":
                    break
                while start and word[start - 1] == c:
                    start -= 1
                if end - start < 3:
                    break
            end = start
        return self.HEAD.sub("", word[:end])

    def suspicious(self, word: str) -> bool:
        stands_in = not word.isalpha() and self.ODD.search(word) is not None and any(c in LEET or c in SEPARATORS or c == MASK for c in word)
        return stands_in or self.RUN.search(word) is not None

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters, the strings it may stand for and their costs."""
        out, i, n = [], 0, len(word)
        while i < n:
            j = i
            while j < n and word[j] == word[i]:
                j += 1
            c, k = word[i], j - i
            if c.isalpha():
                options = [(c * min(k, 2), 0.0 if k < 3 else COST["repeat"])]
                if k > 1:
                    options.append((c, COST["double"] if k == 2 else 0.0))
            else:
                options = [(c * k, 0.0)]
                if c in LEET:
                    for x in LEET[c]:
                        options += [(x * min(k, 2), COST["leet"] * min(k, 2)), *([(x, COST["leet"] + COST["repeat"])] if k > 1 else [])]
                if c in SEPARATORS or c == MASK or c in "!$@|+":
                    options.append(("", COST["edge"] if i == 0 or j == n else COST["separator" if c in SEPARATORS else "mark"]))
                if c == MASK and k == 1:
                    options += [(x, COST["mask"]) for x in LETTERS]
            out.append(options)
            i = j
        return out

    def restore(self, word: str) -> str:
        """The best reading of ``word`` (lower case), or itself if nothing in it is suspicious."""
        if not self.suspicious(word):
            return word
        return self.read(self.lattice(word))

    def read(self, lattice: Iterable[list[tuple[str, float]]]) -> str:
        """The reading of ``lattice`` that the model likes best."""
        best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        last = len(TABLE) - 1
        for options in lattice:
            step: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, said) in best.items():
                for text, cost in options:
                    x, y, s = a, b, score - cost
                    for ch in text:
                        c = int(TABLE[min(ord(ch), last)])
                        s += self.model[x][y][c]
                        x, y = y, c
                    old = step.get((x, y))
                    if old is None or s > old[0]:
                        step[x, y] = (s, (said, text) if text else said)
            best = step
        said = max(((s + self.model[a][b][0], said) for (a, b), (s, said) in best.items()), key=lambda r: r[0])[1]
        out = []
        while said:
            said, text = said
            out.append(text)
        return "".join(reversed(out))

    def spaced(self, chars: str, gaps: list[int]) -> set[str]:
        """The words of ``chars``, written apart, at each price of ``BREAKS``; gaps wider than the least (``gaps``: before each but the first) are likelier to end words."""
        chars = "".join(c if len(c.lower()) > 1 else c.lower() for c in chars)
        wide = tuple(g > min(gaps) for g in gaps)
        if (found := self.short.get((chars, wide))) is None:
            found = {w for cost in BREAKS for w in self.read(self.apart(chars, wide, cost)).split()}
            if len(chars) <= 8:
                if len(self.short) >= CACHE // 8:
                    self.short.clear()
                self.short[chars, wide] = found
        return found

    def apart(self, chars: str, wide: tuple[bool, ...], cost: float) -> Iterator[list[tuple[str, float]]]:
        """The lattice of ``chars`` with the gaps between them; equal letters in a row as in ``lattice``."""
        n, i = len(chars), 0
        narrow, broad = [("", 0.0), (" ", COST["mark"] if any(wide) else cost)], [("", COST["separator"]), (" ", 0.0)]
        while i < n:
            j = i + 1
            while j < n and chars[j] == chars[i] and chars[i].isalpha() and not wide[j - 1]:
                j += 1
            if i:
                yield broad if wide[i - 1] else narrow
            c, k = chars[i], j - i
            yield self.lattice(c)[0]
            if k > 1:
                yield narrow
                yield [(c, 0.0), ("", COST["double"])] if k == 2 else [(c, COST["repeat"]), ("", 0.0)]
            i = j

    def words(self, text: str) -> set[str]:
        """The text's distinct words as written, what ``spaced`` reads in characters that stand apart and in words of more than ``LONG`` characters, and each run of four or more single characters joined into one."""
        text = " ".join(part for part, _ in self.ruled(text))
        tokens = text.split()
        out = set(tokens)
        odd = [w for w in out if len(w) > 4 and (len(w) > LONG or w[1] in SEPARATORS and w[3] in SEPARATORS)]
        alone = {w for w in out if len(w) == 1 or not w.isalpha() and len(w.strip(MARKS)) == 1}
        apart = [w in alone for w in tokens] if alone else []
        if any(map(and_, apart, apart[1:])):  # a single character between words is no run
            run: list[str] = []
            gaps: list[int] = []
            end = 0
            for m in (*self.TOKEN.finditer(text), None):
                w = m[0] if m else ""
                single = w if len(w) == 1 else w.strip(MARKS)
                if len(single) == 1:
                    if run:
                        gaps.append(m.start() - end)
                    run.append(single)
                    end = m.end()
                elif run:
                    if len(run) >= 4:
                        out.add("".join(run))
                    if sum(c.isalpha() for c in run) > 1:
                        out.update(self.spaced("".join(run), gaps))
                    run, gaps = [], []
        for w in odd:
            bare = w.strip(MARKS)
            spelled = len(bare) > 4 and all(c in SEPARATORS for c in bare[1::2])
            if sum(c.isalpha() for c in bare) > 1 and (spelled or len(bare) > LONG):
                chars = bare[::2] if spelled else bare
                out.update(self.spaced(chars, [1] * (len(chars) - 1)))
        return out

    def text(self, text: str) -> str:
        """The whole text with each suspicious word replaced by its reading."""
        return "".join(self.TOKEN.sub(lambda m: self.restore(p) if self.suspicious(p := self.plain(m[0])) else m[0], part) + rule for part, rule in self.ruled(text))

    def ruled(self, text: str) -> list[tuple[str, str]]:
        """The text's parts between rules of marks, each with the rule after it; an underscore is a mark here."""
        out, done = [], 0
        for m in self.RULE.finditer(text.replace("_", ".") if "_" in text else text):
            out.append((text[done : m.start()], m[0] if "_" not in text else text[m.start() : m.end()]))
            done = m.end()
        return [*out, (text[done:], "")]


def features(word: str) -> tuple[str, ...]:
    n = len(word)
    if n < 3:
        return ()
    return ("=" + word, *("<" + word[:k] for k in range(3, min(n, 9))), *(">" + word[-k:] for k in (5, 6) if n > k))


class Marked(dict):
    """Word as written to its features, or with weights to its evidence: none for almost all words."""

    def __init__(self, restorer: Restorer, weights: Weights | None) -> None:
        super().__init__()
        self.restorer, self.weights = restorer, weights
        self.most = CACHE // 8 if weights is None else CACHE  # features take more room than a number
        #: What the features with weights begin and end with: most words need no features made.
        self.heads = {f[1:4] for f in weights or () if f[0] in "=<"}
        self.tails = {f[-5:] for f in weights or () if f[0] == ">"}

    def __missing__(self, word: str):
        low = word.lower()
        read = self.restorer.restore(low if low.isalpha() else self.restorer.plain(word))
        if self.weights is None:
            found = features(read)
        elif read[:3] in self.heads or read[-5:] in self.tails:
            found = features(read)
            known = [x for f in found if (x := self.weights.get(f))]
            found = (max(w for w, _ in known), self.weights.get(found[0], (0.0, -math.inf))[1]) if known else ()
        else:
            found = ()
        if len(word) <= KEPT:
            if len(self) >= self.most:
                self.clear()
            self[word] = found
        return found

    def summary(self, text: str | None) -> list[float]:
        """The three strongest words' evidence, all words' together, the number of distinct words; last, apart, the largest cautious log odds of a whole word."""
        words = self.restorer.words(text) if text else ()
        found = sorted((e for w in words if (e := self[w])), reverse=True)
        return [*([w for w, _ in found] + [0.0] * 3)[:3], math.log1p(sum(w for w, _ in found)), math.log1p(len(words)), max((v for _, v in found), default=-math.inf)]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, model: np.ndarray, sample: int = SAMPLE) -> tuple[Weights, list[float], float]:
    """Feature weights, the regression's coefficients (the intercept first) and the prior's log odds, from labelled documents that aren't held out."""
    known = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = {bool(t): c for t, c in known.groupBy(F.col("toxic") > 0).count().collect()}
    prior = math.log((n.get(True, 0) + 0.5) / (n.get(False, 0) + 0.5))
    if not n.get(True) or not n.get(False):
        return {}, [prior], prior
    part = lambda cond: known.where(cond).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = part("toxic > 0").unionByName(part("toxic <= 0")).select(F.col("doc_id").alias("k"), (F.col("toxic") > 0).cast("int").alias("toxic"), F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(2)).cast("int").alias("fold"))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).select("toxic", "fold", "text")
    context = docs.sparkSession.sparkContext
    shared = context.broadcast(model)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        marked, seen = Marked(restorer, None), {}
        for b in batches:
            for toxic, fold, text in zip(*b.columns, strict=True):
                side = 2 * fold.as_py() + 1 - toxic.as_py()
                own = {f for w in restorer.words(text.as_py() or "") for f in marked[w]}
                own.add("")
                for f in own:
                    seen.setdefault(f, [0] * 4)[side] += 1
                if len(seen) > CACHE // 2:
                    yield _counts(seen)
                    seen = {}
        yield _counts(seen)

    scratch = Scratch(docs.sparkSession)
    counts = scratch.save(rows.mapInArrow(count, "f string, t0 long, c0 long, t1 long, c1 long").groupBy("f").agg(*[F.sum(x).alias(x) for x in ("t0", "c0", "t1", "c1")]))
    every = counts.where("f = ''").first()
    if not every:  # no labelled document is there
        scratch.drop(counts)
        return {}, [prior], prior
    kinds = counts.count()
    folds = [_weights(counts, F.col(f"t{i}"), F.col(f"c{i}"), every[f"t{i}"], every[f"c{i}"], kinds) for i in (0, 1)]
    weights = _weights(counts, F.col("t0") + F.col("t1"), F.col("c0") + F.col("c1"), every["t0"] + every["t1"], every["c0"] + every["c1"], kinds)
    scratch.drop(counts)
    crossed = context.broadcast(folds)

    def summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer = Restorer(shared.value)
        by_fold = [Marked(restorer, crossed.value[1]), Marked(restorer, crossed.value[0])]
        for b in batches:
            made = [by_fold[f.as_py()].summary(t.as_py())[:-1] for _, f, t in zip(*b.columns, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(made, pa.list_(pa.float64()))], ["toxic", "x"])

    seen = rows.mapInArrow(summarise, "toxic int, x array<double>").toPandas()  # at most twice the sample
    y = seen["toxic"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return {}, [prior], prior
    order = np.lexsort((*np.array(seen["x"].tolist()).T, y))  # one order on every run
    coefficients = regression(np.array(seen["x"].tolist())[order], y[order])
    coefficients[0] += prior - math.log(y.sum() / (len(y) - y.sum()))
    return weights, coefficients, prior


def regression(x: np.ndarray, y: np.ndarray, steps: int = 30) -> list[float]:
    """Ridge logistic regression by Newton's method; the intercept, first, isn't shrunk."""
    x = np.column_stack((np.ones(len(x)), x))
    penalty = np.diag([1e-6] + [RIDGE] * (x.shape[1] - 1))
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w.tolist()


def _weights(counts: DataFrame, t: Column, c: Column, toxic: int, clean: int, kinds: int) -> Weights:
    """Log odds of the features that hold more than chance would among so many kinds."""
    if not toxic or not clean:
        return {}
    share = toxic / (toxic + clean)
    odds = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    # twice the log-likelihood ratio of the feature's own toxic share against the sample's
    g2 = 2 * (t * F.log(t / (t + c) / share) + F.when(c > 0, c * F.log(c / (t + c) / (1 - share))).otherwise(0.0))
    strong = counts.where(t > 0).where("f <> ''").select("f", odds.alias("w"), g2.alias("g"), (F.log((t + 0.5) / (toxic + 1)) - F.log((c + CAUTION) / (clean + CAUTION))).alias("v")).where((F.col("w") >= math.log(LEAST_RATIO)) & (F.col("g") >= 2 * math.log(max(kinds, 2))))
    return {r["f"]: (r["w"], r["v"]) for r in strong.collect()}


def _counts(seen: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), *[pa.array([x[i] for x in seen.values()], pa.int64()) for i in range(4)]], ["f", "t0", "c0", "t1", "c1"])


def logit(summary: list[float], coefficients: list[float], prior: float) -> float:
    """The regression's, or that of the surest single word if it says more: one slur in a long text is enough."""
    *x, surest = summary
    return max(coefficients[0] + sum(a * b for a, b in zip(coefficients[1:], x, strict=False)), prior + surest)


def scorer(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE):
    """A pandas UDF from text to probability, with the model fitted on ``docs`` and ``labels``."""
    model = language_model(docs)
    shared = docs.sparkSession.sparkContext.broadcast((model, *fitted(docs, labels, model, sample)))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model, weights, coefficients, prior = shared.value
        marked = Marked(Restorer(model), weights)
        for texts in batches:
            logits = (logit(marked.summary(t), coefficients, prior) for t in texts)
            yield pd.Series([1 / (1 + math.exp(-max(-500.0, min(500.0, x)))) for x in logits], dtype=float)

    return score


def scored(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    out = docs.select("doc_id", held_out().alias("held_out"), scorer(docs, labels, sample)("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` under the threshold, with their columns as they are."""
    return docs.where(scorer(docs, labels, sample)("text") < THRESHOLD)
