"""WARC archives: writing, normalising monolithic gzip, reading by offset.

Crawls are often kept as one gzip stream over a whole file, which can't be entered in the
middle. ``normalise`` inflates such a stream once, front to back, finds the records in it and writes
each as a gzip member of its own, together with a sidecar index of (record id, offset, length).
It holds one buffer and one record's head at a time; a record's body passes through in pieces.

``archived`` writes the rows of a table as records into one monolithic archive a task attempt, normalises it,
deletes it, and returns the index. Files lie in the shared folder under names that hold the attempt,
so that a repeated or speculative attempt never touches the files of another; the index that Spark commits names
the archives that count. ``read_back`` opens only these, by offset, dealt by their bytes over as many tasks as they need.

Records with equal payloads of at least ``least`` bytes are stored once: the row of the largest
page_id is the response and the others are revisits of the identical-payload-digest profile that refer to it.
That decision is a map-side aggregate by SHA-1 and length over all rows and a join back of ids alone, salted. Payloads
are shuffled only where a filter of fixed size (``CELLS`` hash cells) says that another row may have the same one. A
revisit is read back through its response: length and digest are those of the bytes stored there.

Null html is an empty payload. Null page_ids are stored as responses, without sharing. Rows that
repeat a page_id with one payload are all responses if that page_id is the largest. Payloads of any length pass in
pieces while archives are normalised, but stand whole in memory while written and read. Other columns are left out. An
empty table gives no archives and no rows.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.llm.common import Scratch, dealt, repeated

LEVEL, BUFFER, BLOCK = 1, 1 << 16, 8 << 20
#: Archive bytes of a reading task; hash cells of the filter for payloads found twice.
TASK, CELLS = 64 << 20, 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "page_id long, archive string, record_id string, offset long, length long"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """A WARC/1.1 record; revisits leave the payload out and name its length and response."""
    body = payload if kind == "response" else b""
    address = (url or "").replace("\r", "").replace("\n", "")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = _fields(head)
    return fields, rest[: int(fields["content-length"])]


class Inflated:
    """The bytes under a gzip file, one member or many, by line and by count, from one pass.

    ``held`` is read from ``at`` on; it is cut only when more is appended, so a record's bytes are copied once.
    """

    def __init__(self, source) -> None:
        self.source, self.held, self.at, self.z, self.over = source, b"", 0, zlib.decompressobj(31), False

    def more(self) -> bool:
        while not self.over:
            if self.z.eof:  # another member follows, or the end
                left = self.z.unused_data or self.source.read(BUFFER)
                if not left:
                    self.over = True
                    break
                self.z = zlib.decompressobj(31)
                got = self.z.decompress(left, BUFFER)
            else:
                data = self.z.unconsumed_tail or self.source.read(BUFFER)
                if not data and not self.z.eof:
                    if self.at < len(self.held) or self.z.flush():
                        raise EOFError("the gzip stream is cut off")
                    self.over = True
                    break
                got = self.z.decompress(data, BUFFER)
            if got:
                self.held, self.at = self.held[self.at :] + got if self.at < len(self.held) else got, 0
                return True
        return False

    def head(self) -> bytes | None:
        """Up to and with the empty line; blank lines before it are passed over; None at the end."""
        while True:
            while self.at < len(self.held) and self.held[self.at] in b"\r\n":
                self.at += 1
            if (end := self.held.find(b"\r\n\r\n", self.at)) >= 0:
                start, self.at = self.at, end + 4
                return self.held[start : self.at]
            if not self.more():
                if self.at < len(self.held):
                    raise EOFError("a record's head is cut off")
                return None

    def body(self, n: int) -> Iterator[bytes]:
        while n:
            if self.at == len(self.held) and not self.more():
                raise EOFError("a record's block is cut off")
            piece = self.held[self.at : self.at + n]
            self.at += len(piece)
            n -= len(piece)
            yield piece


def normalise(source, sink, level: int = LEVEL) -> Iterator[tuple[str, int, int]]:
    """Rewrites every record of ``source`` as its own member in ``sink``; yields (record id, offset, length)."""
    stream, place = Inflated(source), 0
    while (head := stream.head()) is not None:
        fields, z, start = _fields(head), zlib.compressobj(level, zlib.DEFLATED, 31), place
        place += sink.write(z.compress(head))
        for piece in stream.body(int(fields["content-length"])):
            place += sink.write(z.compress(piece))
        place += sink.write(z.compress(b"\r\n\r\n"))
        place += sink.write(z.flush())
        yield fields.get("warc-record-id", ""), start, place - start


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:] if x)}


def decided(pages: DataFrame, least: int) -> DataFrame:
    """``page_id, h, keeper`` for pages whose payload another, larger page_id has."""
    payloads = pages.select("page_id", F.coalesce("html", F.lit("")).alias("html")).select("page_id", F.sha1("html").alias("h"), F.octet_length("html").cast("long").alias("n"))
    shared = payloads.where(f"page_id is not null and n >= {int(least)}")
    keeper = shared.groupBy("h", "n").agg(F.max("page_id").alias("keeper"), F.min("page_id").alias("lowest")).where("lowest < keeper").drop("lowest")
    met = dealt(shared, "page_id").join(repeated(keeper), ["h", "n", "salt"])
    return met.where("page_id < keeper").select("page_id", "h", "keeper").distinct()


def archived(pages: DataFrame, folder: str, least: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """Writes the archives and returns their index (lazily: evaluate it once, by writing it)."""
    payload = F.coalesce("html", F.lit(""))
    chosen = pages.select("page_id", "url", payload.alias("html"), F.sha1(payload).alias("h"))
    revisits = (scratch or Scratch(pages.sparkSession)).save(decided(pages, least))
    cell = lambda: F.pmod(F.xxhash64("h"), F.lit(CELLS))
    cells = revisits.select(cell().alias("cell")).distinct()  # at most CELLS rows
    alone = chosen.join(F.broadcast(cells), cell() == F.col("cell"), "left_anti").withColumn("keeper", F.lit(None).cast("long"))
    maybe = chosen.join(F.broadcast(cells), cell() == F.col("cell"), "left_semi").join(revisits, ["page_id", "h"], "left")
    columns = [F.col("page_id").cast("long"), "url", "html", F.col("keeper").cast("long").alias("keeper")]
    rows = alone.select(*columns).unionByName(maybe.select(*columns))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name = f"{base}/part-{context.partitionId():06d}-{context.taskAttemptId()}.warc.gz"
        fs.create_dir(base, recursive=True)
        z, ids = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), []
        with fs.open_output_stream(f"{name}.whole", compression=None) as out:
            for b in batches:
                for page, url, html, keeper in zip(*b.columns, strict=True):
                    page, keeper = page.as_py(), keeper.as_py()
                    out.write(z.compress(record(page, url.as_py(), html.as_py().encode(), "response" if keeper is None else "revisit", keeper)))
                    ids.append(page)
            out.write(z.flush())
        if not ids:
            fs.delete_file(f"{name}.whole")
            return
        with fs.open_input_stream(f"{name}.whole", compression=None) as source, fs.open_output_stream(name, compression=None) as sink:
            index = list(normalise(source, sink))
        fs.delete_file(f"{name}.whole")
        with fs.open_output_stream(f"{name}.idx", compression=None) as side:
            for i, o, n in index:
                side.write(f"{i}\t{o}\t{n}\n".encode())
        if len(index) != len(ids):
            raise ValueError(f"{len(ids)} records written, {len(index)} found again")
        for i in range(0, len(ids), 10_000):
            some = index[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 10_000], pa.int64()), pa.array([name] * len(some), pa.string()), *[pa.array([x[k] for x in some], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))]], ["page_id", "archive", "record_id", "offset", "length"])

    return rows.mapInArrow(write, INDEX)


def read_back(index: DataFrame, folder: str) -> DataFrame:
    """One row for each indexed record, read from its member: its payload's length and digest (of a revisit: as it says), type, and response."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, archive string, offset long, length long"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        name, opened = None, None
        for b in batches:
            out = []
            for page, archive, record_id, offset, length in zip(*b.columns, strict=True):
                if (archive := archive.as_py()) != name:
                    if opened:
                        opened.close()
                    name, opened = archive, fs.open_input_file(archive)
                offset, length = offset.as_py(), length.as_py()
                opened.seek(offset)
                fields, block = parse(zlib.decompress(opened.read(length), 31))
                if fields["warc-record-id"] != record_id.as_py():
                    raise ValueError(f"{archive} has {fields['warc-record-id']} at {offset}")
                said, n = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
                if fields["warc-type"] == "response":
                    found = digest(block)
                    if (found, len(block)) != (said, n):
                        raise ValueError(f"{record_id.as_py()} in {archive} isn't what was written")
                refers = fields.get("warc-refers-to", "").removeprefix("<urn:page:").removesuffix(">")
                out.append((page.as_py(), n, said, fields["warc-type"], int(refers) if refers else None, archive.rpartition("/")[2], offset, length))
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], [x.split()[0] for x in schema.split(", ")])
        if opened:
            opened.close()

    return index.select("page_id", "archive", "record_id", "offset", "length").mapInArrow(read, schema)


def followed(records: DataFrame) -> DataFrame:
    """``records`` with each revisit's length taken from the response that it refers to; a revisit whose response isn't there, or has other bytes, fails."""
    revisits = records.where("record_type = 'revisit'")
    wanted = revisits.select(F.col("refers_to").alias("at"), F.col("payload_digest").alias("d")).distinct()
    responses = records.where("record_type = 'response'").select(F.col("page_id").alias("at"), F.col("payload_digest").alias("d"), F.col("payload_bytes").alias("stored"))
    answers = responses.join(wanted, ["at", "d"], "left_semi").groupBy("at", "d").agg(F.max("stored").alias("stored"))
    met = dealt(revisits.withColumns({"at": F.col("refers_to"), "d": F.col("payload_digest")}), "page_id").join(repeated(answers), ["at", "d", "salt"], "left")
    checked = F.when(F.col("stored") == F.col("payload_bytes"), F.col("stored")).otherwise(F.raise_error(F.concat(F.lit("no response as told for page "), F.col("page_id").cast("string"))).cast("long"))
    return records.where("record_type = 'response'").unionByName(met.withColumn("payload_bytes", checked).select(*records.columns))


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes every row of ``pages`` and reads the archives back, members dealt out in blocks of ``BLOCK`` bytes."""
    scratch = Scratch(pages.sparkSession)
    folder = scratch.path()
    index = scratch.save(archived(pages, folder, least, scratch))
    size = index.agg(F.sum("length")).first()[0] or 0
    spread = index.repartition(max(pages.sparkSession.sparkContext.defaultParallelism, -(-size // TASK)), "archive", (F.col("offset") / BLOCK).cast("long"))
    return followed(scratch.save(read_back(spread.sortWithinPartitions("archive", "offset"), folder)))
