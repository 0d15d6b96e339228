"""ISO media containers: written around payloads, and read by walking their boxes.

``wrap`` stores a payload as uncompressed 8-bit grey video: each 64 bytes are one 8 x 8 frame, the
last filled up with zero bytes, every ``GOP``-th frame marked as a sync sample. ``walk`` yields the boxes of any ISO
file, nested ones too; ``sample_tables`` decodes stsd, stsc, stsz or stz2, stco or co64 and stss, and of fragmented files
trex, tfhd and trun, so that codec, duration, and the byte ranges of all samples and of the keyframes are known while no
payload byte is looked at. Files of several tracks give one table per track.

Each row stands alone (no shuffle), so repeats and ties give equal values; null and empty texts
are one frame of zeros. A file lives in one task's memory, a few times its size. Broken files raise.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FRAME, SIDE, GOP, TIMESCALE, DELTA = 64, 8, 12, 600, 24
#: Frames of a chunk; a payload of more chunks than one exercises stsc and stco.
CHUNK = 256
#: Bytes of containers that a task hands on at once.
FLUSH = 4 << 20
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"mvex", b"moof", b"traf", b"udta"}
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    head = struct.pack(">I4s", size, kind) if size < 1 << 32 else struct.pack(">I4sQ", 1, kind, size + 8)
    return b"".join((head, *parts))


def full(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes) -> bytes:
    return payload + b"\0" * (FRAME * max(1, -(-len(payload) // FRAME)) - len(payload))


def wrap(payload: bytes) -> bytes:
    """An MP4 file that holds ``payload``; its length must be a positive multiple of 64."""
    n, rest = divmod(len(payload), FRAME)
    if rest or not n:
        raise ValueError(f"a payload of {len(payload)} bytes isn't a positive multiple of {FRAME}")
    duration, chunks = n * DELTA, -(-n // CHUNK)
    brand = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isommp41")
    entry = box(b"raw ", b"\0" * 6, struct.pack(">H", 1), b"\0" * 16, struct.pack(">HHIIIH", SIDE, SIDE, 72 << 16, 72 << 16, 0, 1), b"\0" * 32, struct.pack(">Hh", 8, -1))
    last = n - (chunks - 1) * CHUNK
    runs = [(1, min(n, CHUNK), 1)] + ([(chunks, last, 1)] if chunks > 1 and last != CHUNK else [])
    keys = range(1, n + 1, GOP)

    def moov(first: int) -> bytes:
        wide = first + len(payload) >= 1 << 32
        offsets = [first + i * CHUNK * FRAME for i in range(chunks)]
        stbl = box(
            b"stbl",
            full(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full(b"stts", 0, 0, struct.pack(">III", 1, n, DELTA)),
            full(b"stss", 0, 0, struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            full(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
            full(b"co64" if wide else b"stco", 0, 0, struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        minf = box(b"minf", full(b"vmhd", 0, 1, b"\0" * 8), box(b"dinf", full(b"dref", 0, 0, struct.pack(">I", 1), full(b"url ", 0, 1))), stbl)
        mdia = box(b"mdia", full(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, TIMESCALE, duration, 0x55C4, 0)), full(b"hdlr", 0, 0, b"\0" * 4, b"vide", b"\0" * 12, b"payload\0"), minf)
        tkhd = full(b"tkhd", 1, 7, struct.pack(">QQIIQ", 0, 0, 1, 0, duration), b"\0" * 16, MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, TIMESCALE, duration, 0x10000, 0x100), b"\0" * 10, MATRIX, b"\0" * 24, struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, mdia))

    head = 8 if len(payload) + 8 < 1 << 32 else 16
    first = len(brand) + len(moov(0)) + head
    if first + len(payload) >= 1 << 32:
        first = len(brand) + len(moov(1 << 33)) + head
    return brand + moov(first) + box(b"mdat", payload)


def walk(data: memoryview, start: int = 0, end: int | None = None, above: tuple = ()) -> Iterator[tuple[tuple, int, int]]:
    """(path of kinds, first byte of the body, end) of every box, parents first; payloads aren't touched."""
    end = len(data) if end is None else end
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        stop = end if size == 0 else start + size
        if stop > end or stop < body:
            raise ValueError(f"box {kind!r} at {start} leaves its parent")
        yield (*above, kind), body, stop
        if kind in CONTAINERS:
            yield from walk(data, body, stop, (*above, kind))
        start = stop


@dataclass
class Track:
    codec: str = ""
    handler: str = ""
    width: int = 0
    height: int = 0
    timescale: int = 0
    duration: int = 0
    sizes: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    keys: list[int] = field(default_factory=list)

    def ranges(self) -> list[tuple[int, int]]:
        """(offset, length) of the keyframes."""
        return [(self.offsets[k - 1], self.sizes[k - 1]) for k in self.keys]


def sample_tables(data: memoryview) -> list[Track]:
    """Each track's codec, times and sample places, from the boxes alone; samples of fragments follow those of the track's own table."""
    tracks: dict[int, Track] = {}
    tables: list[dict[bytes, tuple[int, int]]] = []
    trex: dict[int, tuple[int, ...]] = {}
    fragments: list[tuple[int, list[tuple[bytes, int]]]] = []  # where the moof starts; the tfhd and trun boxes in it
    top = 0
    for path, a, b in walk(data):
        kind = path[-1]
        if kind == b"trak":
            tables.append({})
        elif kind == b"moof":
            fragments.append((top, []))
        elif kind == b"trex":
            track, _, *defaults = struct.unpack_from(">5I", data, a + 4)
            trex[track] = tuple(defaults)
        elif kind in (b"tfhd", b"trun") and b"moof" in path:
            fragments[-1][1].append((kind, a))
        elif tables and b"trak" in path:
            tables[-1][kind] = (a, b)
        if len(path) == 1:
            top = b
    for i, t in enumerate(tables):
        number = struct.unpack_from(">I", data, t[b"tkhd"][0] + (20 if data[t[b"tkhd"][0]] else 12))[0] if b"tkhd" in t else -i
        tracks[number] = _track(data, t)
    for start, boxes in fragments:
        _fragment(data, start, boxes, tracks, trex)
    return list(tracks.values())


def _track(data: memoryview, t: dict[bytes, tuple[int, int]]) -> Track:
    track, at = Track(), {k: a + 4 for k, (a, _) in t.items()}
    version = data[t[b"mdhd"][0]]
    track.timescale, track.duration = struct.unpack_from(">IQ" if version else ">II", data, at[b"mdhd"] + (16 if version else 8))
    track.handler = bytes(data[at[b"hdlr"] + 4 : at[b"hdlr"] + 8]).decode("latin-1")
    track.codec = bytes(data[at[b"stsd"] + 8 : at[b"stsd"] + 12]).decode("latin-1")
    if track.handler == "vide":
        track.width, track.height = struct.unpack_from(">HH", data, at[b"stsd"] + 4 + 8 + 24)
    track.sizes = _sizes(data, at)
    n = len(track.sizes)
    where, kind = (at[b"co64"], "Q") if b"co64" in at else (at[b"stco"], "I")
    (chunks,) = struct.unpack_from(">I", data, where)
    starts = struct.unpack_from(f">{chunks}{kind}", data, where + 4)
    (m,) = struct.unpack_from(">I", data, at[b"stsc"])
    runs = [struct.unpack_from(">III", data, at[b"stsc"] + 4 + 12 * i) for i in range(m)]
    sample = 0
    for i, (first, per, _) in enumerate(runs):
        until = runs[i + 1][0] if i + 1 < m else chunks + 1
        for chunk in range(first, until):
            place = starts[chunk - 1]
            for _ in range(per):
                track.offsets.append(place)
                place += track.sizes[sample]
                sample += 1
    if b"stss" in at:
        (k,) = struct.unpack_from(">I", data, at[b"stss"])
        track.keys = list(struct.unpack_from(f">{k}I", data, at[b"stss"] + 4))
    else:
        track.keys = list(range(1, n + 1))
    return track


def _sizes(data: memoryview, at: dict[bytes, int]) -> list[int]:
    if b"stsz" in at:
        size, n = struct.unpack_from(">II", data, at[b"stsz"])
        return [size] * n if size else list(struct.unpack_from(f">{n}I", data, at[b"stsz"] + 8))
    bits, n = struct.unpack_from(">3xBI", data, at[b"stz2"])
    body = at[b"stz2"] + 8
    if bits == 4:
        return [data[body + i // 2] >> (0 if i % 2 else 4) & 15 for i in range(n)]
    if bits not in (8, 16):
        raise ValueError(f"sample sizes of {bits} bits")
    return list(struct.unpack_from(f">{n}{'B' if bits == 8 else 'H'}", data, body))


def _fragment(data: memoryview, start: int, boxes: list[tuple[bytes, int]], tracks: dict[int, Track], trex: dict[int, tuple[int, ...]]) -> None:
    """Adds the samples of one moof. Flags of tfhd: 1 base, 2 description, 8 duration, 16 size, 32 flags, 0x20000 base is the moof; of trun: 1 place, 4 first flags, 0x100 durations, 0x200 sizes, 0x400 flags, 0x800 shifts."""
    track, place, first_traf = None, start, True
    base = duration = size = flags = 0
    for kind, a in boxes:
        said = struct.unpack_from(">I", data, a)[0] & 0xFFFFFF
        if kind == b"tfhd":
            (number,), at = struct.unpack_from(">I", data, a + 4), a + 8
            if number not in tracks:
                raise ValueError(f"a fragment of track {number}, which the file doesn't declare")
            track = tracks[number]
            duration, size, flags = trex.get(number, (0, 0, 0))
            base = start if first_traf or said & 0x20000 else place
            first_traf = False
            if said & 1:
                (base,), at = struct.unpack_from(">Q", data, at), at + 8
            at += 4 if said & 2 else 0
            values = [duration, size, flags]
            for i, bit in enumerate((8, 16, 32)):
                if said & bit:
                    (values[i],), at = struct.unpack_from(">I", data, at), at + 4
            duration, size, flags = values
            place = base
            continue
        (n,), at = struct.unpack_from(">I", data, a + 4), a + 8
        if said & 1:
            place, at = base + struct.unpack_from(">i", data, at)[0], at + 4
        first = None
        if said & 4:
            (first,), at = struct.unpack_from(">I", data, at), at + 4
        for i in range(n):
            values = [duration, size, flags if first is None or i else first]
            for k, bit in enumerate((0x100, 0x200, 0x400)):
                if said & bit:
                    (values[k],), at = struct.unpack_from(">I", data, at), at + 4
            at += 4 if said & 0x800 else 0
            track.offsets.append(place)
            track.sizes.append(values[1])
            track.duration += values[0]
            place += values[1]
            if not values[2] & 0x10000:
                track.keys.append(len(track.sizes))


def read_back(data: memoryview, track: Track) -> bytes:
    """The track's samples in order, joined; neighbours are copied as one range."""
    out, start, end = [], 0, 0
    for o, s in zip(track.offsets, track.sizes, strict=True):
        if o != end:
            out.append(data[start:end])
            start = o
        end = o + s
    return b"".join((*out, data[start:end]))


def stored(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes`` and ``media`` (binary): every whole text as UTF-8 in a container."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            start, held, sizes, files = 0, 0, [], []
            for i, t in enumerate(b.column(1)):
                raw = (t.as_py() or "").encode()
                sizes.append(len(raw))
                files.append(wrap(padded(raw)))
                held += len(files[-1])
                if held >= FLUSH or i + 1 == b.num_rows:  # long texts aren't held a whole batch long
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(files)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [key, "n_bytes", "media"])
                    start, held, sizes, files = i + 1, 0, [], []

    return docs.select(key, text).mapInArrow(run, f"{key} {docs.schema[key].dataType.simpleString()}, n_bytes long, media binary")


def feature(track: Track) -> str:
    ranges = track.ranges()
    crc = zlib.crc32(b"".join(struct.pack(">QQ", *r) for r in ranges))
    first = f"{ranges[0][0]}+{ranges[0][1]}" if ranges else "-"
    return f"codec={track.codec.strip()};size={track.width}x{track.height};duration={track.duration}/{track.timescale};samples={len(track.sizes)};keyframes={len(ranges)};first={first};ranges_crc32={crc:08x}"


def probed(media: DataFrame, key: str = "doc_id") -> DataFrame:
    """Reads stored containers: codec, duration_ms, keyframe ranges (array of offset and length), payload digests, feature."""
    schema = f"{key} {media.schema[key].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, duration_ms long, keyframes array<struct<offset: bigint, length: bigint>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, n, m in zip(b.column(0), b.column(1), b.column(2), strict=True):
                data = memoryview(m.as_buffer())
                track = sample_tables(data)[0]
                payload = read_back(data, track)
                rows.append((k.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(data), hashlib.sha256(data).hexdigest(), feature(track), track.codec, track.duration * 1000 // track.timescale, [{"offset": o, "length": s} for o, s in track.ranges()]))
            names = [x.split()[0] for x in schema.replace("array<struct<offset: bigint, length: bigint>>", "x").split(", ")]
            ranges = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
            types = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), ranges]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)

    return media.select(key, "n_bytes", "media").mapInArrow(run, schema)


def digests(docs: DataFrame) -> DataFrame:
    """The contract's columns, with codec, duration and the number of keyframes."""
    return probed(stored(docs)).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "codec", "duration_ms", F.size("keyframes").cast("long").alias("n_keyframes"))
