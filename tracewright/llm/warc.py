"""Legacy archive converter: ARC files (versions 1 and 2) to WARC, and a reader for the result.

An ARC file begins with a version block that names the fields of its URL records; every record has one header line with these
fields, the last of which declares the length of what follows. The converter goes over each file twice. The first time it
indexes records and digests payloads; equal payloads of MIN_REVISIT bytes or more then get one response, the record of the least page id, and
revisits that refer to it. The second time it writes one WARC file per ARC file, a gzip member per record: identifiers are
version 5 UUIDs of the ARC file's name and the record's number, dates come from the ARC's 8, 12 or 14 digits, types from the
index, and digests are SHA-256, of the payload and of the block. A revisit keeps the HTTP header, whose Content-Length tells
the full payload's size, and names its response by identifier, target URI and date. ARC files are read plain or with a gzip member per record, as archives store them, and written so.
An ARC file's name is its task's and its own number, so identifiers are the same in every run over the same partitions; what an attempt of a task adds to the path isn't part of it.

Files are read and written record by record. A file counts once the manifest names it, so an attempt that is lost leaves nothing that is read.

Defined results: a null payload is empty; a null URL is written as "-"; blanks and control characters in a URL are percent-encoded; null page ids sort last and
are null again when read; of repeated rows with one payload, the first by page id, file and place is the response; texts of any length are one record each; empty tables
give empty results; extra columns are not read. Where a record's header line or declared length can't be right, the rest of its file can't be read: the records before it are converted, and the WARC manifest counts the
place as malformed.
"""

from __future__ import annotations

import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, delete, materialize, scratch, slices, small_side_join
from .files import fresh, make_folder, opened

MIN_REVISIT = 100
ARC_BYTES = 64 << 20
#: Fixed by the formats.
ARC_FIELDS = {1: b"URL IP-address Archive-date Content-type Archive-length", 2: b"URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"}
TO = ("to_path", "to_seq", "to_page", "to_url", "to_date")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ARC_MANIFEST = "path string, version int, records long"
WARC_MANIFEST = "path string, records long, malformed long"
INDEX = "path string, seq long, page_id long, payload_bytes long, digest string, url string, date string, error string"


# ARC


def arc_url(url: str | None) -> bytes:
    return re.sub(rb"[\x00-\x20\x7f]", lambda m: b"%%%02X" % m[0][0], (url or "-").encode()) or b"-"


def http_block(page_id: int | None, payload: bytes) -> bytes:
    head = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8", b"Content-Length: %d" % len(payload)]
    if page_id is not None:
        head.append(b"X-Page-Id: %d" % page_id)
    return b"\r\n".join(head) + b"\r\n\r\n" + payload


def arc_version_block(name: str, version: int, date: str) -> bytes:
    body = b"%d 0 tracewright\n%s\n" % (version, ARC_FIELDS[version])
    values = [b"filedesc://" + name.encode(), b"0.0.0.0", date.encode(), b"text/plain"] + [b"200", b"-", b"-", b"0", name.encode()] * (version == 2)
    return b" ".join([*values, b"%d" % len(body)]) + b"\n" + body


def arc_record(url: bytes, ip: str, date: str, kind: bytes, block: bytes, version: int, offset: int = 0, name: str = "-") -> bytes:
    values = [url, ip.encode(), date.encode(), kind]
    if version == 2:
        values += [b"200", hashlib.md5(block).hexdigest().encode(), b"-", b"%d" % offset, name.encode()]
    return b"\n" + b" ".join([*values, b"%d" % len(block)]) + b"\n" + block


def _exactly(f, n: int) -> bytes:
    got = f.read(n)
    if len(got) != n:
        raise ValueError(f"a record declares {n} bytes, {len(got)} are left")
    return got


def read_arc(f) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """(header fields, block) of each URL record of an ARC stream, plain or gzipped, whatever its version's field line; ValueError where it can't go on."""
    f = f if hasattr(f, "peek") else io.BufferedReader(f)
    if f.peek(2)[:2] == b"\x1f\x8b":
        f = io.BufferedReader(_Members(f), 1 << 16)
    first = f.readline().split()
    if not first:
        return
    declared = _exactly(f, int(first[-1])).replace(b"\r\n", b"\n").split(b"\n")
    names = declared[1].split() if len(declared) > 1 else []
    if b"Archive-length" not in names:
        raise ValueError(f"the version block names the fields {names}")
    while True:
        line = f.readline()
        while line in (b"\n", b"\r\n"):
            line = f.readline()
        if not line:
            return
        # The URL may hold blanks in old files, so fields are counted from the end.
        values = line.rstrip(b"\r\n").rsplit(b" ", len(names) - 1)
        if len(values) != len(names):
            raise ValueError(f"a header line has {len(values)} of {len(names)} fields")
        fields = dict(zip(names, values, strict=True))
        yield fields, _exactly(f, int(fields[b"Archive-length"]))


def arc_name(path: str) -> str:
    """An ARC file's name without what an attempt of a task adds."""
    return path.rsplit("/", 1)[-1].split(".")[0]


def write_arc(pages: DataFrame, folder: str, date: str, arc_bytes: int = ARC_BYTES) -> DataFrame:
    """Writes (page_id, url, html) rows as ARC files of about arc_bytes of content each, of version 1 and 2 in turn; gives their manifest."""
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, size, content, turn, done = None, 0, 0, 0, TaskContext.get().partitionId(), []
        for b in slices(batches):
            for page_id, url, html in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    name = f"pages-{TaskContext.get().partitionId():05d}-{len(done):05d}"
                    version, path = 1 + turn % 2, fresh(folder, f"{name}.", ".arc.gz")
                    fs, inner = opened(path)
                    out = fs.open_output_stream(inner)
                    size = out.write(member(arc_version_block(name, version, date), 3))
                    n, content, turn = 0, 0, turn + 1
                record = arc_record(arc_url(url), "0.0.0.0", date, b"text/html", http_block(page_id, html or b""), version, size, name)
                size, content = size + out.write(member(record, 3)), content + len(record)
                n += 1
                if content >= arc_bytes:
                    out.close()
                    done.append((path, version, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, version, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int32()), pa.array([d[2] for d in done], pa.int64())], ["path", "version", "records"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col("html").cast("binary").alias("html"))
    return materialize(rows.mapInArrow(write, ARC_MANIFEST), "arc-manifest")


def split_http(block: bytes) -> tuple[bytes, bytes, dict[bytes, bytes]]:
    """Header with its blank line, payload, and header fields in lower case; a block without a header is all payload."""
    if not block.startswith(b"HTTP/") or (at := block.find(b"\r\n\r\n")) < 0:
        return b"", block, {}
    fields = dict(line.split(b":", 1) for line in block[:at].split(b"\r\n")[1:] if b":" in line)
    return block[: at + 4], block[at + 4 :], {k.strip().lower(): v.strip() for k, v in fields.items()}


def _page_id(fields: dict[bytes, bytes]) -> int | None:
    return int(fields[b"x-page-id"]) if b"x-page-id" in fields else None


# WARC


def record_id(arc: str, seq: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{arc_name(arc)}#{seq}')}>"


def warc_date(digits: str) -> str:
    """ISO time of an ARC date of 14, 12 or 8 digits."""
    d = re.sub(r"\D", "", digits)
    d = (d + "00000101000000"[len(d) :])[:14]
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def sha256(data: bytes) -> str:
    return "sha256:" + hashlib.sha256(data).hexdigest()


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One gzip member."""
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("WARC-Block-Digest", sha256(block)), ("Content-Length", str(len(block)))])
    return member(head.encode() + b"\r\n" + block + b"\r\n\r\n")


def member(data: bytes, level: int = 6) -> bytes:
    """Data as a gzip member."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _Members(io.RawIOBase):
    """Bytes of a stream of gzip members, one after the other."""

    def __init__(self, f, chunk: int = 1 << 20):
        self.f, self.chunk, self.z, self.rest = f, chunk, None, b""

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while True:
            if self.z is None:
                self.rest = self.rest or self.f.read(self.chunk)
                if not self.rest:
                    return 0
                self.z = zlib.decompressobj(31)
            got = self.z.decompress(self.rest, len(into))
            self.rest = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
            if self.z.eof:
                self.z = None
            elif not self.rest and not got:
                self.rest = self.f.read(self.chunk)
                if not self.rest:
                    raise ValueError("a gzip member ends early")
            if got:
                into[: len(got)] = got
                return len(got)


def read_warc(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of a gzipped WARC stream."""
    s = io.BufferedReader(_Members(f), 1 << 16)
    while line := s.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record begins with {line[:40]!r}")
        fields = {}
        while (line := s.readline()).strip():
            k, _, v = line.decode().partition(":")
            fields[k.strip().lower()] = v.strip()
        yield fields, _exactly(s, int(fields["content-length"]))


def index_arc(manifest: DataFrame) -> DataFrame:
    """INDEX rows of all records."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for path in b.column("path").to_pylist():
                fs, inner = opened(path)
                rows, error = [], None
                with fs.open_input_stream(inner) as raw, io.BufferedReader(raw, 1 << 20) as f:
                    try:
                        for seq, (fields, block) in enumerate(read_arc(f)):
                            _, payload, http = split_http(block)
                            rows.append((path, seq, _page_id(http), len(payload), hashlib.sha256(payload).hexdigest(), fields.get(b"URL", b"-").decode("utf-8", "replace"), warc_date(fields.get(b"Archive-date", b"").decode("latin-1")), None))
                    except (ValueError, zlib.error) as e:
                        rows.append((path, len(rows), None, None, None, None, None, str(e)[:200]))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    schema = pa.schema([(n, pa.int64() if t == "long" else pa.string()) for n, t in (x.split() for x in INDEX.split(", "))])
    return _by_file(manifest).mapInArrow(look, INDEX)


def _by_file(manifest: DataFrame) -> DataFrame:
    n = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return manifest.select("path").repartition(n, "path")


def decide(index: DataFrame) -> DataFrame:
    """(path, seq, error) with to_path, to_seq, to_page, to_url and to_date of the records that are revisits; null for responses."""
    rank = F.struct(F.col("page_id").isNull().alias("last"), "page_id", "path", "seq", "url", "date")
    shared = index.where(F.col("payload_bytes") >= MIN_REVISIT).groupBy("digest").agg(F.count("*").alias("n"), F.min(rank).alias("first")).where("n > 1")
    shared = shared.select("digest", *[F.col(f"first.{c}").alias(f"to_{c.split('_')[0]}") for c in ("path", "seq", "page_id", "url", "date")])
    met = small_side_join(index, shared, ["digest"], "left", most=50_000)
    own = (F.col("to_path") == F.col("path")) & (F.col("to_seq") == F.col("seq"))
    revisit = F.col("to_path").isNotNull() & ~own & (F.col("payload_bytes") >= MIN_REVISIT)
    return met.select("path", "seq", "error", *[F.when(revisit, F.col(c)).alias(c) for c in TO])


def convert(manifest: DataFrame, folder: str) -> DataFrame:
    """Writes a WARC file for each ARC file; gives their manifest."""
    make_folder(folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at = [], None
        for b in slices(batches):
            for path, seq, error, to_path, to_seq, to_page, to_url, to_date in zip(*(b.column(c).to_pylist() for c in ("path", "seq", "error", *TO)), strict=True):
                if at != path:
                    if at is not None:
                        out.close()
                    at = path
                    fs, inner = opened(path)
                    records = enumerate(read_arc(io.BufferedReader(fs.open_input_stream(inner), 1 << 20)))
                    target = fresh(folder, f"{arc_name(path)}.", ".warc.gz")
                    ofs, oinner = opened(target)
                    out = ofs.open_output_stream(oinner)
                    out.write(warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", record_id(path, -1)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Filename", f"{arc_name(path)}.warc.gz"), ("Content-Type", "application/warc-fields")], b"software: tracewright\r\nformat: WARC File Format 1.1\r\n"))
                    done.append([target, 0, 0])
                if error is not None:
                    done[-1][2] += 1
                    continue
                k, (fields, block) = next(records)
                if k != seq:
                    raise ValueError(f"{path}: record {k} meets the decision for {seq}")
                head, payload, http = split_http(block)
                date = warc_date(fields.get(b"Archive-date", b"").decode("latin-1"))
                headers = [
                    ("WARC-Type", "revisit" if to_path else "response"), ("WARC-Record-ID", record_id(path, seq)), ("WARC-Date", date),
                    ("WARC-Target-URI", fields.get(b"URL", b"-").decode("utf-8", "replace")), ("WARC-IP-Address", fields.get(b"IP-address", b"0.0.0.0").decode("latin-1")), ("WARC-Payload-Digest", sha256(payload)),
                    ("Content-Type", "application/http; msgtype=response" if head else fields.get(b"Content-type", b"application/octet-stream").decode("latin-1")),
                ]
                if (page := _page_id(http)) is not None:
                    headers.append(("X-Page-Id", str(page)))
                if to_path:
                    headers += [("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", record_id(to_path, to_seq)), ("WARC-Refers-To-Target-URI", to_url), ("WARC-Refers-To-Date", to_date)]
                    if to_page is not None:
                        headers.append(("X-Refers-To-Page-Id", str(to_page)))
                out.write(warc_record(headers, head if to_path else block))
                done[-1][1] += 1
        if at is not None:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), *[pa.array([d[k] for d in done], pa.int64()) for k in (1, 2)]], ["path", "records", "malformed"])

    spark = manifest.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    with Workspace(spark, "arc") as tmp:
        decided = decide(tmp.write(index_arc(manifest), "index"))
        return materialize(decided.repartition(n, "path").sortWithinPartitions("path", "seq").mapInArrow(write, WARC_MANIFEST), "warc-manifest")


def scan_warc(manifest: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of the page records of WARC files. Digests of whole payloads are computed again and compared."""
    columns = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for path in b.column("path").to_pylist():
                fs, inner = opened(path)
                rows = []
                with fs.open_input_stream(inner) as raw:
                    for fields, block in read_warc(raw):
                        kind = fields["warc-type"]
                        if kind not in ("response", "revisit"):
                            continue
                        _, payload, http = split_http(block)
                        size = len(payload) if kind == "response" else int(http[b"content-length"])
                        digest = fields["warc-payload-digest"]
                        if kind == "response" and digest != sha256(payload):
                            raise ValueError(f"{path}: {fields['warc-record-id']} doesn't match its digest")
                        page, to = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
                        rows.append((None if page is None else int(page), size, digest.removeprefix("sha256:"), kind, None if to is None else int(to)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), columns.values(), strict=True)], list(columns))

    return _by_file(manifest).mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(spark: SparkSession, pages: DataFrame, date: str = "20080430204825") -> DataFrame:
    """Pages through ARC files and the converter into WARC files, and read back from these."""
    folder = scratch(spark, "arc")
    warcs = convert(write_arc(pages, folder, date), scratch(spark, "warc"))
    delete(spark, folder)  # all is in the WARC files now
    return scan_warc(warcs)
