"""Containers and archives: round trips, broken files, small tables."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import media, warc


@settings(max_examples=80, deadline=None)
@given(st.binary(max_size=5000))
def test_payload_comes_back(raw):
    payload = media.padded(raw)
    assert len(payload) % 64 == 0 and payload and payload.startswith(raw) and not payload[len(raw) :].strip(b"\0")
    data = memoryview(media.wrap(payload))
    (track,) = media.sample_tables(data)
    assert media.read_back(data, track) == payload
    assert (track.codec, track.width, track.height, track.duration) == ("raw ", 8, 8, len(payload) // 64 * media.DELTA)
    assert [o for o, _ in track.ranges()] == [o for i, o in enumerate(track.offsets) if i % media.GOP == 0]


@pytest.mark.parametrize("frames", [1, media.CHUNK - 1, media.CHUNK, media.CHUNK + 1, 3 * media.CHUNK, 3 * media.CHUNK + 5])
def test_chunk_runs(frames):
    payload = bytes(i % 251 for i in range(frames * 64))
    data = memoryview(media.wrap(payload))
    assert media.read_back(data, media.sample_tables(data)[0]) == payload


def test_boxes_nest_and_are_checked():
    data = memoryview(media.wrap(b"x" * 64))
    paths = [p for p, _, _ in media.walk(data)]
    assert (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"stsz") in paths and paths[0] == (b"ftyp",) and paths[-1] == (b"mdat",)
    wide = struct.pack(">I4sQ", 1, b"mdat", 20) + b"abcd"  # a 64-bit size
    assert [(p[-1], b - a) for p, a, b in media.walk(memoryview(media.box(b"moov", wide)))] == [(b"moov", 20), (b"mdat", 4)]
    open_ended = struct.pack(">I4s", 0, b"mdat") + b"abc"
    assert [(a, b) for _, a, b in media.walk(memoryview(open_ended))] == [(8, 11)]
    with pytest.raises(ValueError, match="leaves its parent"):
        list(media.walk(memoryview(struct.pack(">I4s", 99, b"moov"))))
    with pytest.raises(ValueError, match="multiple"):
        media.wrap(b"abc")


def test_variable_sizes_and_no_sync_table():
    """A file as others write it: sizes differ, all samples are keyframes."""
    sizes, first = [3, 5, 1], 8
    stbl = media.box(b"stbl", media.full(b"stsd", 0, 0, struct.pack(">I", 1), media.box(b"sowt", b"\0" * 28)), media.full(b"stsc", 0, 0, struct.pack(">IIII", 1, 1, 3, 1)), media.full(b"stsz", 0, 0, struct.pack(">II3I", 0, 3, *sizes)), media.full(b"co64", 0, 0, struct.pack(">IQ", 1, first)))
    mdia = media.box(b"mdia", media.full(b"mdhd", 0, 0, struct.pack(">IIIIHH", 0, 0, 8000, 9, 0, 0)), media.full(b"hdlr", 0, 0, b"\0" * 4, b"soun", b"\0" * 12), media.box(b"minf", stbl))
    data = memoryview(media.box(b"mdat", b"abcdefghi") + media.box(b"moov", media.box(b"trak", mdia)))
    (track,) = media.sample_tables(data)
    assert (track.codec, track.handler, track.timescale, track.duration) == ("sowt", "soun", 8000, 9)
    assert track.ranges() == [(8, 3), (11, 5), (16, 1)] and media.read_back(data, track) == b"abcdefghi"


def test_media_frame(spark):
    texts = [None, "", "é" * 40, "x" * 200_000, "é" * 40]
    docs = spark.createDataFrame([(i, t, b"c") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    rows = sorted(media.digests(docs).collect(), key=lambda r: r["doc_id"])
    for r, t in zip(rows, texts, strict=True):
        raw = (t or "").encode()
        payload = media.padded(raw)
        stored = media.wrap(payload)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
    assert rows[2].asDict() | {"doc_id": 0} == rows[4].asDict() | {"doc_id": 0} and rows[0]["feature"] == rows[1]["feature"]
    assert media.digests(docs.limit(0)).count() == 0


RECORDS = [warc.record(1, "http://a/", b"", "response", None), warc.record(2, "http://b/\r\nx", b"WARC/1.0\r\n\r\n" * 3 + b"\r\n", "response", None), warc.record(None, None, "é".encode() * 300_000, "response", None), warc.record(4, "u", b"gone", "revisit", 2)]


@pytest.mark.parametrize("source", [gzip.compress(b"".join(RECORDS)), b"".join(map(gzip.compress, RECORDS)), gzip.compress(b"\r\n".join(RECORDS[:2]) + b"\r\n") + gzip.compress(b"".join(RECORDS[2:]))])
@pytest.mark.parametrize("buffer", [7, 1 << 20])
def test_normalise(monkeypatch, source, buffer):
    monkeypatch.setattr(warc, "BUFFER", buffer)
    sink = io.BytesIO()
    index = list(warc.normalise(io.BytesIO(source), sink))
    out = sink.getvalue()
    assert [i for i, _, _ in index] == ["<urn:page:1>", "<urn:page:2>", "<urn:page:>", "<urn:page:4>"]
    assert [zlib.decompress(out[o : o + n], 31) for _, o, n in index] == RECORDS
    assert gzip.decompress(out) == b"".join(RECORDS)


def test_broken_streams():
    whole = gzip.compress(b"".join(RECORDS))
    for bad, error in ((whole[: len(whole) // 2], (EOFError, ValueError, zlib.error)), (gzip.compress(b"no record\r\n\r\n"), ValueError), (gzip.compress(RECORDS[2][:500]), EOFError)):
        with pytest.raises(error):
            list(warc.normalise(io.BytesIO(bad), io.BytesIO()))
    assert list(warc.normalise(io.BytesIO(b""), io.BytesIO())) == []


def test_archives(spark):
    rows = [(1, "u", "same"), (2, None, "same"), (3, "u", ""), (4, "u", None), (5, "u", "é\r\n\r\nWARC/1.1"), (9, "u", "same"), (9, "u", "same"), (None, "u", "same")]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, keeper string, n int").repartition(3)
    got = sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in warc.round_trip(pages).collect()), key=repr)
    want = []
    for page, _, html in rows:
        raw = (html or "").encode()
        largest = max((p for p, _, h in rows if p is not None and (h or "") == (html or "")), default=None)
        old = page is not None and page < largest
        want.append((page, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if old else "response", largest if old else None))
    assert got == sorted(want, key=repr)
    assert {r["record_type"] for r in warc.round_trip(pages, least=100).collect()} == {"response"}
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_attempts_do_not_share_archives(spark, tmp_path):
    """The same rows written twice to one folder, in another order: both indexes still read back what was written."""
    pages = spark.createDataFrame([(i, f"http://u/{i}", f"body {i % 7} " * (i + 1)) for i in range(40)] + [(40, "u", "x" * 3_000_000)], "page_id long, url string, html string").coalesce(2)
    folder = str(tmp_path / "w")
    indexes = []
    for k, rows in enumerate((pages, pages.sort(warc.F.desc("page_id")).coalesce(2))):
        warc.archived(rows, folder).write.parquet(path := str(tmp_path / f"i{k}"))
        indexes.append(spark.read.parquet(path))
    one, two = (sorted((r["page_id"], r["payload_bytes"], r["payload_digest"]) for r in warc.read_back(i, folder).collect()) for i in indexes)
    assert one == two and len(one) == 41


def test_revisits_are_read_through_their_response(spark):
    rows = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    records = spark.createDataFrame([(9, 5, "D", "response", None), (3, 5, "D", "revisit", 9), (4, 5, "D", "revisit", 9)], rows)
    assert sorted(r["payload_bytes"] for r in warc.followed(records).collect()) == [5, 5, 5]
    for lost in ((4, 6, "D", "revisit", 9), (4, 5, "E", "revisit", 9), (4, 5, "D", "revisit", 8)):
        with pytest.raises(Exception, match="no response as told for page 4"):
            warc.followed(records.unionByName(spark.createDataFrame([lost], rows))).collect()


def _fragmented(sizes: list[list[int]], bits: int) -> tuple[bytes, list[bytes]]:
    """A file with two samples in stz2 of its own and one fragment for each list of sizes; its samples."""
    box, full = media.box, media.full
    samples = [bytes([65 + i] * n) for i, n in enumerate([3, 7, *(n for part in sizes for n in part)])]
    packed = {4: b"\x37", 8: b"\3\7", 16: b"\0\3\0\7"}[bits]

    def head(first: int) -> bytes:
        stbl = box(b"stbl", full(b"stsd", 0, 0, struct.pack(">I", 1), box(b"mp4a", b"\0" * 28)), full(b"stsc", 0, 0, struct.pack(">4I", 1, 1, 2, 1)), full(b"stz2", 0, 0, b"\0\0\0", bytes([bits]), struct.pack(">I", 2), packed), full(b"stco", 0, 0, struct.pack(">2I", 1, first)))
        mdia = box(b"mdia", full(b"mdhd", 0, 0, struct.pack(">4IHH", 0, 0, 1000, 20, 0, 0)), full(b"hdlr", 0, 0, b"\0" * 4, b"soun", b"\0" * 13), box(b"minf", stbl))
        tkhd = full(b"tkhd", 0, 7, struct.pack(">3I", 0, 0, 5), b"\0" * 68)
        return box(b"ftyp", b"isom") + box(b"moov", box(b"trak", tkhd, mdia), box(b"mvex", full(b"trex", 0, 0, struct.pack(">5I", 5, 1, 10, 0, 0x10000))))

    out = head(len(head(0)) + 8) + box(b"mdat", samples[0], samples[1])
    k = 2
    for part in sizes:
        def moof(place: int, part=part) -> bytes:
            trun = full(b"trun", 0, 0x205, struct.pack(">IiI", len(part), place, 0), *[struct.pack(">I", n) for n in part])
            return box(b"moof", full(b"mfhd", 0, 0, struct.pack(">I", 1)), box(b"traf", full(b"tfhd", 0, 0x20000, struct.pack(">I", 5)), full(b"tfdt", 0, 0, b"\0" * 4), trun))

        out += moof(len(moof(0)) + 8) + box(b"mdat", *samples[k : k + len(part)])
        k += len(part)
    return out, samples


@pytest.mark.parametrize("bits", [4, 8, 16])
def test_fragments_and_compact_sizes(bits):
    data, samples = _fragmented([[5, 1, 4], [], [9]], bits)
    (track,) = media.sample_tables(memoryview(data))
    assert [data[o : o + n] for o, n in zip(track.offsets, track.sizes, strict=True)] == samples
    assert media.read_back(memoryview(data), track) == b"".join(samples)
    assert track.codec == "mp4a" and track.duration == 20 + 40 and track.keys == [1, 2, 3, 6]
    with pytest.raises(ValueError, match="doesn't declare"):
        media.sample_tables(memoryview(data.replace(struct.pack(">I4sI", 16, b"tfhd", 0x20000) + struct.pack(">I", 5), struct.pack(">I4sI", 16, b"tfhd", 0x20000) + struct.pack(">I", 6))))
