"""Operator 3: WARC archives. A normaliser inflates a monolithic gzip archive once, rewrites every record as a gzip member
of its own, and writes a sidecar index of offsets, so that any record can be read alone."""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framelake.llm.text import small_batches
from framelake.operators.skew import join_group_value
from framelake.sources.scratch import materialise, new_path

#: Payload bytes after which a task begins its next archive: one task normalises an archive at a time.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
LEVEL = 5
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and the path in it (file:, hdfs:, s3: and others, by Arrow)."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def _plain(uri: str) -> str:
    """file:/x and file:///x alike as file:///x."""
    return "file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri


def save(fs: pafs.FileSystem, path: str, chunks: Iterator[bytes]) -> int:
    """Write a file under a name of its own and move it in place: a task that runs again leaves the same whole file."""
    part, size = f"{path}.{uuid.uuid4().hex}", 0
    with fs.open_output_stream(part, compression=None) as f:
        for chunk in chunks:
            f.write(chunk)
            size += len(chunk)
    fs.move(part, path)
    return size


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, kind: str, payload_digest: str, payload_bytes: int, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC/1.1 record; extension fields carry the page id and the full payload's length, also for revisits."""
    name = lambda k: f"<urn:page:{'null' if k is None else k}>"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", name(page_id)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", json.dumps(url, ensure_ascii=True)),
        ("WARC-Payload-Digest", f"sha1:{payload_digest}"),
        ("X-Payload-Length", str(payload_bytes)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", name(refers_to))]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(payload)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + CRLF + payload + CRLF + CRLF


def page_of(field: str) -> int | None:
    k = field.removeprefix("<urn:page:").removesuffix(">")
    return None if k == "null" else int(k)


def parse(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, content) of each record in a stream of inflated bytes; holds one record at a time."""
    held = bytearray()

    def need(n: int) -> bool:
        while len(held) < n:
            chunk = next(chunks, None)
            if chunk is None:
                return False
            held.extend(chunk)
        return True

    while need(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(held)
            if not need(seen + 1):
                raise ValueError("an archive ends inside a record's header")
        lines = held[:end].decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record begins with {lines[0][:40]!r}")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size, begin = int(fields["Content-Length"]), end + 4
        if not need(begin + size + 4):
            raise ValueError("an archive ends inside a record's content")
        content = bytes(held[begin : begin + size])
        del held[: begin + size + 4]
        yield fields, content


def inflate(f) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, chunk by chunk; each byte is inflated once."""
    inflater = zlib.decompressobj(31)
    while data := f.read(CHUNK):
        while data:
            out = inflater.decompress(data, CHUNK)
            if out:
                yield out
            data = inflater.unconsumed_tail
            if inflater.eof:
                data = inflater.unused_data
                inflater = zlib.decompressobj(31)
    if tail := inflater.flush():
        yield tail


def _members(records: Iterator[bytes]) -> Iterator[bytes]:
    for r in records:
        packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
        yield packer.compress(r) + packer.flush()


def _one_stream(records: Iterator[bytes]) -> Iterator[bytes]:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    for r in records:
        yield packer.compress(r)
    yield packer.flush()


def write_monolithic(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every page as a response record into archives that are one gzip stream each, from the partitions that hold
    the pages (no shuffle). Returns (archive, place, page_id, payload_bytes, payload_digest) of each record."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        pages_left = ((i, u, h or b"") for b in batches for i, u, h in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True))
        first = next(pages_left, None)
        k = 0
        while first is not None:
            name, notes, size = f"{base}/mono-{TaskContext.get().partitionId():06d}-{k:04d}.warc.gz", [], 0

            def records():
                nonlocal first, size
                while first is not None and size < archive_bytes:
                    page_id, url, payload = first
                    d = digest(payload)
                    notes.append((page_id, len(payload), d))
                    yield record(page_id, url, "response", d, len(payload), payload)
                    size += len(payload) + 512
                    first = next(pages_left, None)

            save(fs, name, _one_stream(records()))
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(notes)), pa.array(range(len(notes)), pa.int64()), pa.array([x[0] for x in notes], pa.int64()), pa.array([x[1] for x in notes], pa.int64()), pa.array([x[2] for x in notes])],
                names=["archive", "place", "page_id", "payload_bytes", "payload_digest"],
            )
            k += 1

    sent = pages.select("page_id", "url", F.col("html").cast("binary").alias("html"))
    return sent.mapInArrow(run, "archive string, place long, page_id long, payload_bytes long, payload_digest string")


INDEX = "archive string, place long, page_id long, record_type string, refers_to long, at long, size long"


def normalise(plan: DataFrame, folder: str, tasks: int) -> DataFrame:
    """plan (archive, place, refers_to: null for a response) -> INDEX of the rewritten archives.

    Each archive is inflated once, front to back; every record becomes a gzip member of its own, a duplicate becomes a
    revisit without payload, and NAME.idx beside the new archive has a line of place, offset and size for each. The
    monolithic archive is deleted when its successor is in place; a task that runs again then finds that successor.
    """
    def run(table: pa.Table) -> pa.Table:
        fs, _ = store(folder)
        old = table.column("archive")[0].as_py()
        new = old.replace("/mono-", "/each-")
        refers = dict(zip(table.column("place").to_pylist(), table.column("refers_to").to_pylist(), strict=True))
        entries: list[tuple] = []
        if fs.get_file_info(old).type == pafs.FileType.NotFound:
            with fs.open_input_stream(new.replace(".warc.gz", ".idx"), compression=None) as f:
                entries = [tuple(x) for x in json.loads(f.read())]
        else:
            def rewritten(f):
                at = 0
                for place, (fields, payload) in enumerate(parse(inflate(f))):
                    page_id, d, n = page_of(fields["WARC-Record-ID"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                    kind = "response" if refers[place] is None else "revisit"
                    out = record(page_id, json.loads(fields["WARC-Target-URI"]), kind, d, n, payload if kind == "response" else b"", refers[place])
                    (member,) = _members(iter([out]))
                    entries.append((place, page_id, kind, refers[place], at, len(member)))
                    at += len(member)
                    yield member

            with fs.open_input_stream(old, compression=None) as f:
                save(fs, new, rewritten(f))
            save(fs, new.replace(".warc.gz", ".idx"), iter([json.dumps(entries).encode()]))
            fs.delete_file(old)
        columns = list(zip(*entries, strict=True))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table([pa.array([new] * len(entries)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=[x.split()[0] for x in INDEX.split(", ")])

    return plan.select("archive", "place", "refers_to").repartition(tasks, "archive").groupBy("archive").applyInArrow(run, INDEX)


def read_records(index: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Read every record of the index alone, by `tasks` tasks, by offset: page_id, record_type, refers_to, payload_bytes, payload_digest,
    url, payload (null for revisits). A response's length and digest are computed from its payload and must match its
    header; a revisit's come from its header."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = store(folder)
        opened, name = None, None
        for batch in batches:
            out, size = [], 0
            for archive, at, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "at", "size")), strict=True):
                if archive != name:
                    if opened:
                        opened.close()
                    opened, name = fs.open_input_file(archive), archive
                opened.seek(at)
                ((fields, payload),) = parse(iter([zlib.decompress(opened.read(n), 31)]))
                kind, d, full = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
                if kind == "response" and (digest(payload), len(payload)) != (d, full):
                    raise ValueError(f"{archive} at {at}: the payload differs from its digest")
                out.append({"page_id": page_of(fields["WARC-Record-ID"]), "record_type": kind, "refers_to": page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload_bytes": full, "payload_digest": d, "url": json.loads(fields["WARC-Target-URI"]), "payload": payload if kind == "response" else None})
                size += len(payload)
                if size > 16 * CHUNK:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_pylist(out, schema)
        if opened:
            opened.close()

    ordered = index.repartition(tasks, "archive").sortWithinPartitions("archive", "at")
    return ordered.select("archive", "at", "size").mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary")


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages as WARC archives, normalise them, and read all records back (see read_records for the columns).

    Reads page_id, url and html; other columns are ignored. The payload is html in UTF-8, a null is empty. Of records
    with equal payloads of at least least_bytes bytes, that with the largest page_id is the response (of equal largest
    ids, or of null ids alone, one that a hash of its place picks) and the others revisit it; a null page_id counts as smaller than any
    other and revisits refer to the response's page_id (-1 if that is null). An empty table gives no archives and no rows.
    """
    spark = pages.sparkSession
    small_batches(spark)
    folder = _plain(folder or new_path(spark, "warc"))
    written = materialise(write_monolithic(pages, folder, archive_bytes), "written")
    rank = F.struct(F.col("page_id").isNotNull(), "page_id", F.hash("archive", "place"), "archive", "place")
    groups = written.groupBy("payload_digest", "payload_bytes").agg(F.max(rank).alias("top"), F.count("*").alias("copies")).filter(F.col("copies") > 1).filter(F.col("payload_bytes") >= least_bytes)
    groups = materialise(groups.select("payload_digest", "payload_bytes", F.col("top.page_id").alias("to"), F.col("top.archive").alias("to_archive"), F.col("top.place").alias("to_place"), "copies"), "payloads")
    same = join_group_value(written, groups, ["payload_digest", "payload_bytes"], "copies").filter((F.col("archive") != F.col("to_archive")) | (F.col("place") != F.col("to_place")))
    plan = written.join(same.select("archive", "place", F.coalesce("to", F.lit(-1)).alias("refers_to")), ["archive", "place"], "left")
    # Rows of the index are few bytes for much work: so many tasks as archives ask for, which AQE leaves alone.
    tasks = 2 * max(1, written.select("archive").distinct().count())
    index = materialise(normalise(plan, folder, tasks), "index")
    return read_records(index, folder, tasks)

