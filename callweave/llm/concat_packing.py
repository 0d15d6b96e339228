"""Concatenate and cut: all documents as one stream of tokens, cut into windows of one length.

1. Every whole text is tokenised once, ``end`` after it; the ids are written to the shared folder with the task's
   number (``part``) and the tokens of the task's rows before it (``before``). The written table fixes the stream's order,
   so a task that is run again later can't move anything.
2. Two-pass prefix sums: the tokens of each part are summed map-side, then added up over blocks of ``BLOCK`` parts and
   within each block. That gives ``base``, the place in the stream where a part starts; no window function
   sees more than ``BLOCK`` parts, or more rows than there are blocks.
3. A row's place is its part's base and its ``before``. Every multiple of ``length`` inside a row cuts it: a row
   yields a piece for each window that it touches, with marks for those cut at a boundary.

Only the last window can be shorter. Rows are never grouped or shuffled by key, so neither a hot source nor a very long
text weighs on one task beyond its own tokens; the bases are broadcast while they are at most ``BROADCAST`` rows and joined by
Spark's choice beyond it.

Null text is an empty document (its end token alone). Null ids and repeated rows are documents like others. Other
columns, whatever their names, play no part. An empty table gives an empty one.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch
from callweave.llm.packing import tokenizer

LENGTH, END, BLOCK = 2048, 1, 1024
#: So many parts' bases (16 bytes each) are broadcast at most.
BROADCAST = 1 << 20
TOKENS = "part int, before long, doc_id long, doc_tokens long, ids binary"
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, from_previous boolean, into_next boolean"
ROWS = 256


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


def tokens(docs: DataFrame, tokenizer_args: tuple[str, str, str], end: int = END) -> DataFrame:
    """A row for each document: its ids and how many of its part's come before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before = tokenizer(*tokenizer_args), TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b, out = whole.slice(at, ROWS), []
                for key, text in zip(b.column(0), b.column(1), strict=True):
                    ids = np.append(encode(text.as_py() or ""), end).astype("<u4")
                    out.append((part, before, key.as_py(), len(ids), ids.tobytes()))
                    before += len(ids)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _names(TOKENS))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, TOKENS)


def bases(sizes: DataFrame, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """``part, base`` of ``sizes(part, size)``, one row a part: what all lower parts hold together."""
    own = scratch.save(sizes.withColumn("block", F.expr(f"part div {block}")))
    blocks = own.groupBy("block").agg(F.sum("size").alias("size"))
    running = "coalesce(sum(size) over ({} order by {} rows between unbounded preceding and 1 preceding), 0)"
    starts = blocks.select("block", F.expr(running.format("", "block")).alias("start"))
    inside = own.select("part", "block", F.expr(running.format("partition by block", "part")).alias("inside"))
    return scratch.save(inside.join(starts, "block").select("part", (F.col("start") + F.col("inside")).alias("base")))


def cut(rows: DataFrame, length: int) -> DataFrame:
    """The pieces of rows ``doc_id, doc_tokens, ids, place``, place being where the row starts in the stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [*[pa.int64()] * 7, *[pa.bool_()] * 2]
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                out = []
                for key, total, ids, place in zip(*(c.to_pylist() for c in whole.slice(at, ROWS).columns), strict=True):
                    held, start = memoryview(ids), 0
                    while start < total:
                        window, offset = divmod(place + start, length)
                        stop = min(total, start + length - offset)
                        out.append((key, start, stop - start, zlib.crc32(held[4 * start : 4 * stop]), total, window, offset, start > 0, stop < total))
                        start = stop
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(kinds)], _names(PIECES))

    return rows.select("doc_id", "doc_tokens", "ids", "place").mapInArrow(run, PIECES)


def packed(docs: DataFrame, tokenizer_args: tuple[str, str, str], length: int = LENGTH, end: int = END) -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and, for pieces cut at a boundary, whether
    the document goes on from the window before (``from_previous``) or into the next (``into_next``)."""
    scratch = Scratch(docs.sparkSession)
    every = scratch.save(tokens(docs, tokenizer_args, end))
    places = bases(every.groupBy("part").agg(F.sum("doc_tokens").alias("size")), scratch)
    if places.count() <= BROADCAST:
        places = F.broadcast(places)
    return cut(every.join(places, "part").withColumn("place", F.col("base") + F.col("before")), length)


def windows(pieces: DataFrame, length: int = LENGTH) -> DataFrame:
    """Each sequence with its number of pieces, its tokens, and the padding it needs: none where it is full or its length a power of two."""
    each = pieces.groupBy("sequence_id").agg(F.count("*").alias("n_pieces"), F.sum("length").alias("tokens"))
    return each.withColumn("padding", F.when(F.bit_count("tokens") == 1, F.lit(0).cast("long")).otherwise(length - F.col("tokens")))
