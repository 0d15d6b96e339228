"""Token counts of a unigram vocabulary without the tokens: a Viterbi pass that carries two numbers.

An Aho-Corasick automaton enumerates every vocabulary entry that ends at each character. Dynamic
programming keeps, for each place, the best score so far and the number of pieces on that path;
no back pointers are kept, since only the count is asked for. The tie rules are those of the
``Unigram`` model of the tokenizers library: a path replaces another only if its score is
greater, and earlier starts come first, so of equal paths the one with the longest last piece
stands. A character that no entry of its length covers costs the least score less 10; neighbouring unknown
pieces are fused into one, or, with byte fallback, each run of unknown characters counts its bytes.

What is counted are the pieces of whatever scored vocabulary is given. The model's own normaliser isn't applied: texts are
taken as they are. Texts are split as ``Metaspace`` does (each blank becomes the meta symbol and begins a word),
words seen before come from a dictionary emptied at ``CACHE`` entries. One pass, no shuffle.
Null and empty texts count 0; repeated rows count alike; an empty table gives an empty one; other columns are left out.
A long text without blanks is one word and takes time and memory in proportion.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

CACHE, UNKNOWN_PENALTY = 300_000, 10.0
META = "▁"


def vocabulary(path: str) -> tuple[list[tuple[str, float]], int]:
    """(piece, score) in the order of ids and the unknown piece's id, from a sentencepiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())], model.unk_id()


class Counter(dict):
    """Word, without the meta symbol before it, to its number of pieces."""

    def __init__(self, pieces: list[tuple[str, float]], unknown: int, byte_fallback: bool) -> None:
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for i, (piece, score) in enumerate(pieces):
            if piece:
                self.automaton.add_word(piece, (len(piece), score, i == unknown))
        self.automaton.make_automaton()
        self.bytes_known = byte_fallback and {f"<0x{b:02X}>" for b in range(256)} <= {p for p, _ in pieces}
        self.unknown_score = min(s for _, s in pieces) - UNKNOWN_PENALTY

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        out = self[word] = self.count(META + word)
        return out

    def count(self, word: str) -> int:
        """Best paths from left to right, in one walk over the matches: by their ends, and of one end the longer first."""
        n = len(word)
        score, pieces, unknown = [0.0] * (n + 1), [0] * (n + 1), [False] * (n + 1)
        here, best, start, is_unknown, single = 0, None, 0, False, False
        for last, (length, s, u) in self.automaton.iter(word):
            while here < last:  # what ends before is complete
                self._close(word, here, best, start, is_unknown, single, score, pieces, unknown)
                here, best, is_unknown, single = here + 1, None, False, False
            x = score[last + 1 - length] + s
            if best is None or x > best:
                best, start, is_unknown = x, last + 1 - length, u
            if length == 1:
                single = True
        while here < n:
            self._close(word, here, best, start, is_unknown, single, score, pieces, unknown)
            here, best, is_unknown, single = here + 1, None, False, False
        return pieces[n]

    def _close(self, word: str, last: int, best: float | None, start: int, is_unknown: bool, single: bool, score: list[float], pieces: list[int], unknown: list[bool]) -> None:
        """Settles the best path to the end of character ``last``."""
        if not single and (best is None or score[last] + self.unknown_score > best):
            best, start, is_unknown = score[last] + self.unknown_score, last, True
        score[last + 1] = best
        if not is_unknown:
            pieces[last + 1] = pieces[start] + 1
            return
        unknown[last + 1] = True
        if self.bytes_known:
            pieces[last + 1] = pieces[start] + len(word[start : last + 1].encode())
        else:
            pieces[last + 1] = pieces[start] + (not (start > 0 and unknown[start]))

    def total(self, text: str) -> int:
        if not text:
            return 0
        marked = text.replace(" ", META)
        return sum(map(self.__getitem__, marked.removeprefix(META).split(META)))


@cache
def counter(path: str, byte_fallback: bool) -> Counter:
    return Counter(*vocabulary(path), byte_fallback)


def counted(docs: DataFrame, path: str, byte_fallback: bool = True, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_chars`` and ``n_tokens`` of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = counter(path, byte_fallback)
        for b in batches:
            chars, counts = [], []
            for x in b.column(1):
                t = x.as_py() or ""
                chars.append(len(t))
                counts.append(made.total(t))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(chars, pa.int64()), pa.array(counts, pa.int64())], [key, "n_chars", "n_tokens"])

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_chars long, n_tokens long")
