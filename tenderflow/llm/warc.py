"""WARC archives: written as one gzip stream, normalised to a gzip member for each record.

Writers put the records of a task into files that are one gzip stream as a whole, as some crawlers
leave them; nothing in such a file can be read without inflating all before it.  The normaliser
inflates a file once, as a stream, writes each record again as a member of its own, and beside the
new file a sidecar that has each record's offset and length.  Readers seek with the sidecar.

Files lie in the shared staging folder.  A task writes to names of its own and names them in its
result, so what a lost task wrote is never read.  A file is closed at a bounded size, and no record
is held in memory whole while it is normalised.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderflow.llm.ship import ship_code
from tenderflow.sources.staging import stage, staging_folder

ARCHIVE_BYTES = 64 << 20  # of records in one file
CHUNK = 1 << 20
TASKS_PER_CORE = 4  # that read archive files
LEAST_REVISITED = 100
DATE = "1970-01-01T00:00:00Z"  # the tables have no date
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "urn:page:"

FILES = "path string, records long"
NORMALISED = "path string, sidecar string, records long"
RECORDS = (
    "page_id long, record_type string, target string, refers_to long, payload_bytes long, "
    "payload_digest string, payload binary"
)


@dataclass
class Record:
    """A record's header fields and, once read, its block."""

    fields: dict[str, str]
    block: bytes = b""


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def header(fields: dict[str, str]) -> bytes:
    lines = "".join(f"{name}: {value}\r\n" for name, value in fields.items())
    return f"WARC/1.1\r\n{lines}\r\n".encode()


def parse_header(data: bytes) -> dict[str, str]:
    first, *lines = data.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no WARC record: {first[:40]!r}")
    return dict(line.split(": ", 1) for line in lines if line)


def page_record(page_id, url, payload: bytes, digest: str, refers_to) -> tuple[bytes, bytes]:
    """Header and block.  A revisit has the HTTP header of the full payload, but no payload."""
    revisit = refers_to is not None
    block = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block += b"" if revisit else payload
    fields = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": f"<{ID}{'' if page_id is None else page_id}>", "WARC-Date": DATE,
    }
    if url is not None:
        fields["WARC-Target-URI"] = quote(url, safe=":/?#[]@!$&'()*+,;=%~")
    if revisit:
        fields |= {"WARC-Refers-To": f"<{ID}{refers_to}>", "WARC-Profile": PROFILE}
    fields |= {
        "WARC-Payload-Digest": f"sha256:{digest}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    return header(fields), block


def _writer(folder: str, most: int):
    """A function from pages (page_id, url, payload, digest, refers_to) to the files it wrote."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        out, size, records, name = None, 0, 0, ""

        def files():
            out.close()
            return pa.RecordBatch.from_pydict(
                {"path": [f"{folder}/{name}"], "records": [records]}
            )

        for batch in batches:
            for i in range(batch.num_rows):
                page = [column[i].as_py() for column in batch.columns]
                if out is None:
                    name, size, records = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    raw = store.open_output_stream(f"{root}/{name}", compression=None)
                    out = _Closing(raw)
                for part in (*page_record(*page), b"\r\n\r\n"):
                    out.write(part)
                    size += len(part)
                records += 1
                if size >= most:
                    yield files()
                    out = None
        if out is not None:
            yield files()

    return write


class _Closing:
    """A gzip stream over a file, closed together."""

    def __init__(self, raw):
        self.raw, self.packed = raw, gzip.GzipFile(fileobj=raw, mode="wb", mtime=0)
        self.write = self.packed.write

    def close(self) -> None:
        self.packed.close()
        self.raw.close()


def inflated(source) -> Iterator[bytes]:
    """What a file of one or more gzip members holds, in chunks of bounded size."""
    member = zlib.decompressobj(31)
    data = source.read(CHUNK)
    while data:
        yield member.decompress(data, CHUNK)
        data = member.unconsumed_tail
        if member.eof:
            data = member.unused_data
            member = zlib.decompressobj(31)
        if not data:
            data = source.read(CHUNK)
    if (rest := member.flush()):
        yield rest


class Inflated:
    """Reads up to a mark, or so many bytes, from chunks."""

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.held, self.at = chunks, b"", 0

    def _more(self) -> bool:
        new = next(self.chunks, None)
        self.held, self.at = self.held[self.at:] + (new or b""), 0
        return new is not None

    def until(self, mark: bytes) -> bytes | None:
        while (end := self.held.find(mark, self.at)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("the archive ends within a header")
                return None
        found, self.at = self.held[self.at:end], end + len(mark)
        return found

    def take(self, size: int) -> Iterator[bytes]:
        while size:
            if self.at == len(self.held) and not self._more():
                raise ValueError("the archive ends within a record")
            part = self.held[self.at:self.at + size]
            self.at += len(part)
            size -= len(part)
            yield part


def normalise(source, sink, sidecar) -> int:
    """Copy a file of records to one with a gzip member for each; returns their number.

    The sidecar gets a line of JSON for each record, in order: offset and length of the member,
    the record's id, type and payload digest.
    """
    records, offset = 0, 0
    stream = Inflated(inflated(source))
    while (head := stream.until(b"\r\n\r\n")) is not None:
        fields = parse_header(head)
        member, length = zlib.compressobj(6, zlib.DEFLATED, 31), 0

        def put(data: bytes) -> int:
            return sink.write(data) if data else 0

        length += put(member.compress(head + b"\r\n\r\n"))
        for part in stream.take(int(fields["Content-Length"])):
            length += put(member.compress(part))
        if b"".join(stream.take(4)) != b"\r\n\r\n":
            raise ValueError(f"{fields['WARC-Record-ID']} has no end")
        length += put(member.compress(b"\r\n\r\n") + member.flush())
        line = {
            "offset": offset, "length": length, "id": fields["WARC-Record-ID"],
            "type": fields["WARC-Type"], "digest": fields.get("WARC-Payload-Digest"),
        }
        sidecar.write(json.dumps(line).encode() + b"\n")
        offset, records = offset + length, records + 1
    return records


def _normaliser(folder: str):
    """A function from files to the normalised files and their sidecars."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for path, expected in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                name = f"{uuid.uuid4().hex}.warc.gz"
                old, at = open_store(path)
                with (
                    old.open_input_stream(at, compression=None) as source,
                    store.open_output_stream(f"{root}/{name}", compression=None) as sink,
                    store.open_output_stream(f"{root}/{name}.jsonl", compression=None) as sidecar,
                ):
                    records = normalise(source, sink, sidecar)
                if records != expected:
                    raise ValueError(f"{path} has {records} records, not {expected}")
                yield pa.RecordBatch.from_pydict({
                    "path": [f"{folder}/{name}"], "sidecar": [f"{folder}/{name}.jsonl"],
                    "records": [records],
                })

    return run


def read_member(data: bytes) -> Record:
    """One record from its gzip member."""
    head, _, rest = gzip.decompress(data).partition(b"\r\n\r\n")
    fields = parse_header(head)
    return Record(fields, rest[:int(fields["Content-Length"])])


def _page(number: str | None) -> int | None:
    text = (number or "").strip("<>").removeprefix(ID)
    return int(text) if text else None


def _read_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every record of normalised files, found with their sidecars."""
    schema = pa.schema([
        ("page_id", pa.int64()), ("record_type", pa.string()), ("target", pa.string()),
        ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("payload", pa.binary()),
    ])

    def full(rows):
        return pa.RecordBatch.from_pylist(rows, schema=schema)

    for batch in batches:
        for path, sidecar in zip(*[c.to_pylist() for c in batch.columns[:2]], strict=True):
            store, at = open_store(path)
            rows, size = [], 0
            with (
                store.open_input_file(at) as source,
                store.open_input_stream(open_store(sidecar)[1], compression=None) as lines,
            ):
                for line in _lines(lines):
                    entry = json.loads(line)
                    source.seek(entry["offset"])
                    record = read_member(source.read(entry["length"]))
                    rows.append(_row(record))
                    size += len(record.block)
                    if size >= CHUNK:
                        yield full(rows)
                        rows, size = [], 0
            if rows:
                yield full(rows)


def _lines(source) -> Iterator[bytes]:
    held = b""
    while data := source.read(CHUNK):
        *lines, held = (held + data).split(b"\n")
        yield from lines
    if held:
        yield held


def _row(record: Record) -> dict:
    http, _, payload = record.block.partition(b"\r\n\r\n")
    kind, fields = record.fields["WARC-Type"], record.fields
    noted = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    size = next(
        int(line.split(b":")[1]) for line in http.split(b"\r\n")
        if line.lower().startswith(b"content-length:")
    )
    if kind == "response":
        found = hashlib.sha256(payload).hexdigest()
        if (found, len(payload)) != (noted, size):
            raise ValueError(f"{fields['WARC-Record-ID']} has another payload than it says")
    return {
        "page_id": _page(fields["WARC-Record-ID"]), "record_type": kind,
        "target": fields.get("WARC-Target-URI"), "refers_to": _page(fields.get("WARC-Refers-To")),
        "payload_bytes": size, "payload_digest": noted,
        "payload": payload if kind == "response" else None,
    }


def _spread(files: DataFrame) -> DataFrame:
    """Few files to a task, in no more tasks than a few for each core, however many files."""
    ship_code(files.sparkSession)
    most = TASKS_PER_CORE * files.sparkSession.sparkContext.defaultParallelism
    return files.repartition(max(1, min(files.count(), most)))


def write_archives(pages: DataFrame, most: int = ARCHIVE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as records; the files' path and records.

    Of pages with equal payloads of at least ``LEAST_REVISITED`` bytes that with the smallest
    page_id is a response, and so is every other row with that page_id; the others revisit it.
    Null html is an empty payload, a null url is left out, a null page_id is an empty number and
    never revisited.
    """
    ship_code(pages.sparkSession)
    payload = F.coalesce(pages["html"], F.lit("")).cast("binary")
    made = pages.select(
        pages["page_id"].cast("long"), "url", payload.alias("payload"),
        F.sha2(payload, 256).alias("digest"),
    )
    first = F.min("page_id").alias("first")
    repeats = stage(
        made.where(F.length("payload") >= LEAST_REVISITED).groupBy("digest")
        .agg(first, F.count("*").alias("n")).where("n > 1 and first is not null")
        .select("digest", "first"),
        "repeats",
    )
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    records = made.join(repeats, "digest", "left").select(
        "page_id", "url", "payload", "digest", refers.alias("refers_to")
    )
    folder = staging_folder(pages.sparkSession, "streams")
    return stage(records.mapInArrow(_writer(folder, most), FILES), "stream-files")


def normalise_archives(files: DataFrame) -> DataFrame:
    """Rewrite stored ``files`` (path, records): path, sidecar and records of the new ones."""
    folder = staging_folder(files.sparkSession, "records")
    return stage(_spread(files).mapInArrow(_normaliser(folder), NORMALISED), "record-files")


def read_archives(files: DataFrame) -> DataFrame:
    """The records of normalised ``files``: page_id, record_type, target, refers_to,
    payload_bytes, payload_digest (both of the full payload) and payload, null for revisits."""
    return _spread(files).mapInArrow(_read_records, RECORDS)


def round_trip(pages: DataFrame) -> DataFrame:
    """``pages`` written, normalised and read back.

    Payloads are written and read whole, however long; repeated rows each give a record; no rows
    give no rows.  Other columns are not read, whatever their names.
    """
    return read_archives(normalise_archives(write_archives(pages)))
