r"""WARC archives, each with a Zstandard dictionary in a leading skippable frame.

An archive is a sequence of Zstandard frames. The first is a skippable frame (magic number
0x184D2A5D) with the dictionary, trained on the first records of that archive (too few to learn from: the
task's archive before it lends its own, and the frame is empty if there is none); then each record is a
frame of its own, compressed with the dictionary. A reader needs nothing but the file.

Of records with one payload (of at least `least` bytes) one holds it, and the others refer to it.
Archives are written below the shared folder through pyarrow's file systems; only the archives named
in the manifest, which Spark commits once for each task, are read, so a task that runs twice does no
harm.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm._shared import lean, parallelism, scratch_dir, written

#: Magic number of the dictionary's skippable frame, and of a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
#: Bytes of a dictionary, bytes of records it is trained on, and bytes of an archive before the next begins.
DICTIONARY_BYTES, TRAINING_BYTES, ARCHIVE_BYTES = 48 << 10, 2 << 20, 64 << 20
#: Bytes of the least dictionary that is worth its place.
LEAST_DICTIONARY = 1 << 10
#: Up to so many repeated payloads (56 bytes each) are broadcast.
FEW_PAYLOADS = 200_000
#: Bytes of one record that training looks at (the record is written whole).
TRAINING_RECORD = 32 << 10
PROFILE = "http://netpreservation.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # the standard namespace of URLs


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{page_id}/{digest}')}>"


def _header(value: object) -> str:
    """A header value: control characters and line ends percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in str(value))


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One WARC/1.1 record; a revisit holds the HTTP header only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_header(url)}")
    if page_id is not None:
        head.append(f"WARC-Page-ID: {page_id}")
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}"]
        if refers_to is not None:
            head.append(f"WARC-Refers-To-Page-ID: {refers_to}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(samples: list[bytes], size: int = DICTIONARY_BYTES):
    """A dictionary from sample records, smaller for few of them; None if there is too little to learn from."""
    import zstandard

    size = min(size, sum(map(len, samples)) // 4)
    if len(samples) < 16 or size < LEAST_DICTIONARY:
        return None
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8)
    except zstandard.ZstdError:
        return None


def file_system(path: str):
    """pyarrow's file system of a URI (file, hdfs, s3, gs, abfs, or a plain path), and the path in it.

    Hadoop's names of S3 are understood, too; a scheme that pyarrow doesn't know is an error.
    """
    from pyarrow import fs

    for name in ("s3a://", "s3n://"):
        if path.startswith(name):
            path = "s3://" + path.removeprefix(name)
    return fs.FileSystem.from_uri(path)


class Archive:
    """Writes one archive; close() puts it in place under its name."""

    def __init__(self, fs, path: str, dictionary, level: int):
        import zstandard

        self.fs, self.path = fs, path
        self.out = fs.open_output_stream(path)
        raw = dictionary.as_bytes() if dictionary else b""
        packed = zstandard.ZstdCompressor(level=19).compress(raw) if raw else b""
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.size = 8 + len(packed)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=dictionary) if dictionary else zstandard.ZstdCompressor(level=level)
        self.records = 0

    def add(self, data: bytes) -> None:
        frame = self.compressor.compress(data)
        self.out.write(frame)
        self.size += len(frame)
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.size


def read_archive(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != SKIPPABLE:
        raise ValueError("the archive has no leading dictionary frame")
    packed = stream.read(size)
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(packed)) if packed else None
    maker = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    rest = b""
    while True:
        if not rest:
            rest = stream.read(1 << 20)
            if not rest:
                return
        one, parts = maker.decompressobj(), []
        while True:
            parts.append(one.decompress(rest))
            if one.eof:
                rest = one.unused_data
                break
            rest = stream.read(1 << 20)
            if not rest:
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of a record."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:]), payload


def roles(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, url, html, digest, size, main_id: main_id is the page that holds the payload, null if its own.

    Only digests with several pages and enough bytes are joined back: broadcast if they are few, else by
    a join in which Spark may split a hot digest.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumns({"digest": F.sha1("html"), "size": F.octet_length("html").cast("long")})
    alike = rows.filter(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("main_id"), F.count("*").alias("n")).filter("n > 1 AND main_id IS NOT NULL").drop("n")
    alike = written(alike, "repeated-payloads")
    return rows.join(F.broadcast(alike) if alike.count() <= FEW_PAYLOADS else alike, "digest", "left")


def write_archives(pages: DataFrame, path: str, least: int = 1000, date: str = "1970-01-01T00:00:00Z", level: int = 6, archive_bytes: int = ARCHIVE_BYTES, training_bytes: int = TRAINING_BYTES, **columns: str) -> DataFrame:
    """Write the archives below path (a URI) and return their manifest: archive, records, bytes.

    A null payload is empty, a null url or page_id leaves its header out. Pages with equal payloads
    of at least `least` bytes refer to the one with the largest page_id; rows that repeat it are
    responses too. An empty table writes no archive.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = file_system(path)
        fs.create_dir(folder, recursive=True)
        archive, waiting, held, made, learnt = None, [], 0, [], None

        def begin() -> Archive:
            nonlocal waiting, held, learnt
            learnt = train([r[:TRAINING_RECORD] for r in waiting]) or learnt  # a short last archive has the one before's
            new = Archive(fs, f"{folder}/{uuid.uuid4().hex}.warc.zst", learnt, level)
            for r in waiting:
                new.add(r)
            waiting, held = [], 0
            return new

        for batch in batches:
            for page_id, url, html, digest, size, main_id in zip(*(c.to_pylist() for c in batch.columns)):
                revisit = main_id is not None and main_id != page_id
                data = record(page_id, url, html.encode(), digest, size, main_id, revisit, date)
                if archive is None:
                    waiting.append(data)
                    held += len(data)
                    if held >= training_bytes:
                        archive = begin()
                    continue
                archive.add(data)
                if archive.size >= archive_bytes:
                    made.append(archive.close())
                    archive = None
        if archive is None and waiting:
            archive = begin()
        if archive is not None:
            made.append(archive.close())
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made)], names=["archive", "records", "bytes"])

    rows = roles(pages, least, **columns).select("page_id", "url", "html", "digest", "size", "main_id")
    return written(rows.mapInArrow(lean(write), "archive string, records long, bytes long"), "manifest")


def read_pages(manifest: DataFrame, path: str, with_html: bool = False) -> DataFrame:
    """A row for each record of the archives: page_id, payload_bytes, payload_digest, record_type, refers_to, url (and html).

    The digest of a response is computed from its payload and must equal the record's header.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for name in batch.column(0).to_pylist():
                    with fs.open_input_stream(name) as stream:
                        for data in read_archive(stream):
                            warc, http, payload = parse(data)
                            kind, digest = warc["WARC-Type"], warc["WARC-Payload-Digest"].removeprefix("sha1:")
                            if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                                raise ValueError(f"payload and digest differ in {name}")
                            number = lambda k: int(warc[k]) if k in warc else None  # noqa: E731, B023
                            row = (number("WARC-Page-ID"), int(http["Content-Length"]), digest, kind, number("WARC-Refers-To-Page-ID"), warc.get("WARC-Target-URI"))
                            yield (*row, payload.decode() if kind == "response" else None) if with_html else row

        def block(some: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some), schema.types)], schema=schema)

        some, held = [], 0
        for row in rows():
            some.append(row)
            held += 200 + (len(row[-1] or "") if with_html else 0)
            if held >= 2 << 20:
                yield block(some)
                some, held = [], 0
        if some:
            yield block(some)

    fields = [("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string())]
    schema = pa.schema(fields + [("html", pa.string())] * with_html)
    n = max(1, min(parallelism(manifest.sparkSession), manifest.count()))
    spread = manifest.select("archive").repartition(n)
    return spread.mapInArrow(lean(read), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string" + ", html string" * with_html)


def warc_round_trip(pages: DataFrame, path: str | None = None, **settings) -> DataFrame:
    """Write the archives and read them back, a row for each page."""
    path = path or scratch_dir(pages.sparkSession, "warc")
    manifest = write_archives(pages, path, **settings)
    return read_pages(manifest, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


WARC_SQL = """
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS main_id FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND main_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND main_id <> page_id THEN main_id END AS refers_to
FROM m
"""
