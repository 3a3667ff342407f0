"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent frames; each bundle ends with the seek table of the Zstandard seekable
format (a skippable frame), so one record is read by decompressing one frame.  The index maps a record id to
its frame and its offset within the decompressed frame.  Bundles are rows of a table (the binary ``bundle``),
which any store that Spark writes to can hold; :func:`export` puts them out as .warc.zst files.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import write_table

SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
#: Smaller payloads are always stored.
LEAST_SHARED = 1000
FRAME_BYTES, BUNDLE_BYTES, LEVEL = 256 << 10, 32 << 20, 3
#: Groups of equal payloads that are sent to the rows.
MAX_BROADCAST = 100_000


@dataclass
class Record:
    """``refers_to``: the record that holds a revisit's payload; ``number`` and ``refers_to`` may be None."""

    number: int | None
    url: str | None
    payload: bytes
    digest: str
    length: int
    revisit: bool = False
    refers_to: int | None = None


def _urn(number: int | None) -> str:
    return "<urn:page:null>" if number is None else f"<urn:page:{number}>"


def _line(value: str) -> tuple[str, bool]:
    """A value for a header line, and whether it had to be escaped: line ends, zeros and white space at its ends."""
    if not any(c in value for c in "\r\n\0") and value == value.strip():
        return value, False
    return quote(value, safe="/:?#[]@!$&'()*+,;=~"), True


def encode(record: Record) -> bytes:
    """A WARC/1.1 record; a revisit has no payload but names the record that does."""
    body = b"" if record.revisit else record.payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if record.revisit else 'response'}", f"WARC-Record-ID: {_urn(record.number)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if record.url is not None:
        line, escaped = _line(record.url)
        head += [f"WARC-Target-URI: {line}", *(["X-Target-URI-Escaped: yes"] if escaped else [])]
    head += ["Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{record.digest}", f"X-Payload-Length: {record.length}"]
    if record.revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_urn(record.refers_to)}"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def decode(data: bytes, at: int = 0) -> Record:
    """The record that starts at ``at``."""
    end = data.index(b"\r\n\r\n", at)
    first, *lines = data[at:end].decode().split("\r\n")
    if first != "WARC/1.1":
        raise ValueError("no WARC record here")
    head = dict(line.split(": ", 1) for line in lines)
    number = lambda urn: None if urn in (None, "<urn:page:null>") else int(urn.removeprefix("<urn:page:").removesuffix(">"))
    size, url = int(head["Content-Length"]), head.get("WARC-Target-URI")
    url = unquote(url) if "X-Target-URI-Escaped" in head else url
    return Record(number(head["WARC-Record-ID"]), url, data[end + 4 : end + 4 + size], head["WARC-Payload-Digest"].removeprefix("sha1:"), int(head["X-Payload-Length"]), head["WARC-Type"] == "revisit", number(head.get("WARC-Refers-To")))


class BundleWriter:
    """Gathers records into frames and frames into one bundle."""

    def __init__(self, frame_bytes: int = FRAME_BYTES, level: int = LEVEL):
        import zstandard

        self.packer, self.frame_bytes = zstandard.ZstdCompressor(level=level, write_checksum=True), frame_bytes
        self.frames: list[tuple[bytes, int]] = []
        self.index: list[tuple[int | None, int, int]] = []
        self.open, self.filled, self.size = [], 0, 0

    def add(self, record: Record) -> None:
        data = encode(record)
        if self.filled and self.filled + len(data) > self.frame_bytes:
            self._close()
        self.index.append((record.number, len(self.frames), self.filled))
        self.open.append(data)
        self.filled += len(data)

    def _close(self) -> None:
        packed = self.packer.compress(b"".join(self.open))
        self.frames.append((packed, self.filled))
        self.size += len(packed)
        self.open, self.filled = [], 0

    def finish(self) -> bytes:
        if self.filled:
            self._close()
        table = b"".join(struct.pack("<II", len(data), raw) for data, raw in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        return b"".join(data for data, _ in self.frames) + struct.pack("<II", SKIPPABLE, len(table) + len(footer)) + table + footer


def seek_table(bundle: bytes | memoryview) -> list[tuple[int, int, int]]:
    """(offset, compressed size, decompressed size) of each frame, from the footer; nothing else is read."""
    count, flags, magic = struct.unpack("<IBI", bundle[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table at the end")
    width = 12 if flags & 0x80 else 8
    table = bundle[-9 - count * width : -9]
    out, at = [], 0
    for k in range(count):
        packed, raw = struct.unpack_from("<II", table, k * width)
        out.append((at, packed, raw))
        at += packed
    return out


def read_record(bundle: bytes, frame: int, offset: int) -> Record:
    """One record by its index entry: only its frame is decompressed."""
    import zstandard

    at, packed, raw = seek_table(bundle)[frame]
    return decode(zstandard.ZstdDecompressor().decompress(bundle[at : at + packed], max_output_size=raw), offset)


def plan_records(pages: DataFrame, least_shared: int = LEAST_SHARED, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest and refers_to (null: a response) of each row.

    Large payloads are grouped by digest and length; counts and largest ids are reduced before the shuffle.  Up to
    ``max_broadcast`` groups (about 60 bytes each) are sent to where the rows are, so payloads are not moved; beyond that
    rows and groups meet in a shuffle join, in which small payloads have a key of their own, so no key gathers them."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")})
    large = pages.select("page_id", payload.alias("payload")).where(F.octet_length("payload") >= least_shared)
    groups = large.groupBy(F.sha1("payload").alias("__digest"), F.octet_length("payload").cast("long").alias("__length")).agg(F.max("page_id").alias("__holder"), F.count("*").alias("__n")).where("__n > 1").drop("__n")
    shared = write_table(groups, "shared-payloads")
    few = shared.limit(max_broadcast + 1).count() <= max_broadcast
    key = F.when(F.col("payload_bytes") >= least_shared, F.col("payload_digest")).otherwise(F.concat(F.lit("#"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.lit("/"), F.substring("payload_digest", 1, 8)))
    joined = rows.withColumn("__key", key).join(F.broadcast(shared) if few else shared, (F.col("__key") == F.col("__digest")) & (F.col("payload_bytes") == F.col("__length")), "left")
    holder = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("__holder")), F.col("__holder"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "payload_digest", holder.alias("refers_to"))


def write_bundles(records: DataFrame, frame_bytes: int = FRAME_BYTES, bundle_bytes: int = BUNDLE_BYTES, level: int = LEVEL) -> DataFrame:
    """A stored table of bundles: bundle, and index as parallel arrays (number, frame, offset).

    A bundle closes at about ``bundle_bytes`` compressed bytes, so memory is bounded; a record larger than a frame has its own."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(writer: BundleWriter) -> pa.RecordBatch:
            bundle = writer.finish()
            return pa.RecordBatch.from_arrays(
                [pa.array([bundle], pa.binary()), *(pa.array([[x[k] for x in writer.index]], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.int32(), pa.int64())))], names=["bundle", "number", "frame", "offset"]
            )

        writer = BundleWriter(frame_bytes, level)
        for batch in batches:
            columns = (batch.column(n).to_pylist() for n in ("page_id", "url", "payload", "payload_digest", "payload_bytes", "refers_to"))
            for number, url, payload, digest, length, refers_to in zip(*columns, strict=True):
                writer.add(Record(number, url, payload, digest, length, refers_to is not None, refers_to))
                if writer.size >= bundle_bytes:
                    yield out(writer)
                    writer = BundleWriter(frame_bytes, level)
        if writer.index:
            yield out(writer)

    schema = "bundle binary, number array<long>, frame array<int>, offset array<long>"
    return write_table(records.mapInArrow(run, schema), "bundles")


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Every record back from its bundle: page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Frames are found by the seek table and records by the index.  A response's length and digest are those of the
    payload that was read, a revisit's those of its head."""
    return _read(bundles.select("bundle", "frame", "offset"))


def fetch(bundles: DataFrame, numbers: DataFrame) -> DataFrame:
    """The records of ``numbers`` (number), as :func:`read_bundles` gives them: only frames that hold one are decompressed.

    The index alone is exploded and joined; bundles without a record that is asked for are not read on."""
    places = bundles.select(F.sha1("bundle").alias("__id"), F.explode(F.arrays_zip("number", "frame", "offset")).alias("e")).select("__id", "e.number", "e.frame", "e.offset")
    asked = places.join(numbers.select("number").distinct(), "number", "left_semi").groupBy("__id").agg(F.array_sort(F.collect_list(F.struct("frame", "offset"))).alias("at"))
    held = bundles.select("bundle", F.sha1("bundle").alias("__id")).join(asked, "__id")
    return _read(held.select("bundle", F.col("at.frame").alias("frame"), F.col("at.offset").alias("offset")))


def _read(rows: DataFrame) -> DataFrame:
    """The records at the places (frame, offset, sorted) of each bundle."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            for k in range(batch.num_rows):
                bundle = memoryview(batch.column("bundle")[k].as_buffer())
                frames, rows, at, data = seek_table(bundle), [], -1, b""
                for frame, offset in zip(batch.column("frame")[k].as_py(), batch.column("offset")[k].as_py(), strict=True):
                    if frame != at:
                        if rows:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows = []
                        start, packed, raw = frames[frame]
                        at, data = frame, unpacker.decompress(bundle[start : start + packed], max_output_size=raw)
                    r = decode(data, offset)
                    size, digest = (r.length, r.digest) if r.revisit else (len(r.payload), hashlib.sha1(r.payload).hexdigest())
                    rows.append((r.number, r.url, r.payload, size, digest, "revisit" if r.revisit else "response", r.refers_to))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return rows.mapInArrow(run, "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long")


def index_of(bundles: DataFrame) -> DataFrame:
    """(number, bundle_id, frame, offset): where each record is; bundle_id is the bundle's SHA-1."""
    entries = F.explode(F.arrays_zip("number", "frame", "offset"))
    return bundles.select(F.sha1("bundle").alias("bundle_id"), entries.alias("e")).select("e.number", "bundle_id", "e.frame", "e.offset")


def export(bundles: DataFrame, folder: str) -> DataFrame:
    """Writes each bundle to ``folder``/<SHA-1>.warc.zst, through pyarrow's file systems; gives path and size.

    File names follow from the content, so a task that runs again writes the same files."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            paths, sizes = [], []
            for value in batch.column("bundle").to_pylist():
                paths.append(f"{root}/{hashlib.sha1(value).hexdigest()}.warc.zst")
                sizes.append(len(value))
                with store.open_output_stream(paths[-1]) as out:
                    out.write(value)
            yield pa.RecordBatch.from_pydict({"path": paths, "size": sizes}, schema=pa.schema([("path", pa.string()), ("size", pa.int64())]))

    return bundles.select("bundle").mapInArrow(run, "path string, size long")


def archive(pages: DataFrame) -> DataFrame:
    """Writes every row of ``pages`` (page_id, url, html) to bundles and reads them back.

    Null html is an empty payload; a null page_id is written as such and never holds a payload for others (unless
    all of its group are null: then all are responses); rows that repeat the holder's id are all responses; empty
    tables make no bundle."""
    return read_bundles(write_bundles(plan_records(pages)))


def op1_warc_bundles(spark, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives; see :func:`archive`."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return archive(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages
), held AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) END AS holder FROM p
)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN holder IS NOT NULL AND page_id IS DISTINCT FROM holder THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM holder THEN holder END AS refers_to
FROM held
"""
