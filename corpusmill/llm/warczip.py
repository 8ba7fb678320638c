"""Web archives packaged in ZIP files, read in place.

A package holds two stored (not compressed) members: ``archive/data.warc.gz``, in which each record is
a gzip member of its own, and ``indexes/index.cdxj``, a line per record with its offset and length.
The reader parses the end record, the ZIP64 end record and locator, and the central directory, finds
where the stored members' bytes lie in the package, and reads records by byte ranges: nothing is
extracted. Packages roll at a size, so that a task reads a bounded one.

Defined results:
  * a null payload is the empty payload; payloads under ``least`` bytes are always responses;
  * of rows with equal payloads of ``least`` bytes or more, those of the largest id are responses,
    the others revisit that id; a null id is smaller than any other;
  * repeated rows give repeated records; an empty table gives no package and no rows;
  * a null URL is written as an empty one, and line ends in a URL as %0D and %0A, which is how they are read back;
  * a payload of any length is one record, held whole by one task; other columns are ignored.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.scratch import materialize, scratch_path

LEAST_REVISIT = 1000
#: A package is closed once it holds so many bytes; a single longer record still goes in whole.
PACKAGE_BYTES = 32 << 20
#: Rows of a payload that many pages share are joined in so many parts.
SALTS = 16
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"

_LOCAL, _CENTRAL, _END, _END64, _LOCATOR64 = b"PK\3\4", b"PK\1\2", b"PK\5\6", b"PK\6\6", b"PK\6\7"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def plan_records(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(page_id, url, payload, payload_bytes, digest, record_type, refers_to) of each page."""
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "digest": F.sha1("payload")})
    # Only payloads that occur more than once take part, a row for each: hot ones are met in parts.
    shared = rows.where(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("kept"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salted = shared.select("digest", "payload_bytes", "kept", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    joined = rows.join(salted, ["digest", "payload_bytes", "salt"], "left")
    revisit = F.col("kept").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("kept"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("kept")).cast("long").alias("refers_to"))


def record_bytes(page_id: int | None, url: str, payload: bytes, payload_bytes: int, digest: str, refers_to: int | None) -> bytes:
    """A WARC record: a response with its payload, or a revisit without."""
    name = lambda x: f"<urn:page:{'' if x is None else x}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": name(page_id),
        "WARC-Date": "1970-01-01T00:00:00Z",
        "WARC-Target-URI": url.replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": f"sha1:{digest}",
    }
    if refers_to is not None:
        fields |= {"WARC-Refers-To": name(refers_to), "WARC-Profile": _PROFILE}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


@dataclass
class Record:
    """A record as read: header fields and payload (None for a revisit)."""

    fields: dict[str, str]
    payload: bytes | None
    payload_bytes: int

    @staticmethod
    def _page(urn: str | None) -> int | None:
        number = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number else None

    @property
    def page_id(self) -> int | None:
        return self._page(self.fields["WARC-Record-ID"])

    @property
    def refers_to(self) -> int | None:
        return self._page(self.fields.get("WARC-Refers-To"))


def parse_record(data: bytes) -> Record:
    """Reads a record's headers and payload, and verifies a response's payload digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if fields["WARC-Type"] != "response":
        return Record(fields, None, size)
    if len(payload) != size or f"sha1:{hashlib.sha1(payload).hexdigest()}" != fields["WARC-Payload-Digest"]:
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    return Record(fields, payload, size)


class PackageWriter:
    """Writes a package to an output stream, record by record."""

    def __init__(self, out):
        self._zip = zipfile.ZipFile(out, "w", zipfile.ZIP_STORED, allowZip64=True)
        self._data = self._zip.open(zipfile.ZipInfo(DATA), "w", force_zip64=True)
        self._index: list[str] = []
        self.size = 0

    def add(self, page_id: int | None, url: str, digest: str, record: bytes) -> None:
        packed = gzip.compress(record, compresslevel=1, mtime=0)
        self._data.write(packed)
        self._index.append(json.dumps({"id": page_id, "url": url, "digest": f"sha1:{digest}", "offset": self.size, "length": len(packed)}))
        self.size += len(packed)

    def close(self) -> int:
        self._data.close()
        with self._zip.open(zipfile.ZipInfo(INDEX), "w", force_zip64=True) as f:
            f.write("".join(f"{x}\n" for x in self._index).encode())
        self._zip.close()
        return len(self._index)


def _zip64(extra: bytes, values: list[int]) -> list[int]:
    """Values of a directory entry, those at their limit taken from its ZIP64 field, in order."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = io.BytesIO(extra[at + 4 : at + 4 + size])
            return [struct.unpack("<Q", wide.read(8))[0] if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def directory(f) -> dict[str, tuple[int, int, int, int]]:
    """name: (method, offset of the member's bytes, stored size, real size), from a package's central directory.

    ``f`` needs ``size()`` and ``read_at(n, offset)`` only.
    """
    total = f.size()
    tail_at = max(0, total - 65_557 - 20)
    tail = f.read_at(total - tail_at, tail_at)
    end = tail.rfind(_END)
    if end < 0:
        raise ValueError("not a ZIP file: no end record")
    entries, size, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == _LOCATOR64:
        (end64,) = struct.unpack_from("<Q", tail, end - 12)
        record = f.read_at(56, end64)
        if record[:4] != _END64:
            raise ValueError("damaged ZIP64 end record")
        entries, size, start = struct.unpack_from("<QQQ", record, 32)
    central, at, found = f.read_at(size, start), 0, {}
    for _ in range(entries):
        if central[at : at + 4] != _CENTRAL:
            raise ValueError("damaged central directory")
        flags, method = struct.unpack_from("<HH", central, at + 8)
        packed, real, n_name, n_extra, n_comment = struct.unpack_from("<IIHHH", central, at + 20)
        (offset,) = struct.unpack_from("<I", central, at + 42)
        raw = central[at + 46 : at + 46 + n_name]
        real, packed, offset = _zip64(central[at + 46 + n_name : at + 46 + n_name + n_extra], [real, packed, offset])
        local = f.read_at(30, offset)
        if local[:4] != _LOCAL:
            raise ValueError("damaged local header")
        name_size, extra_size = struct.unpack_from("<HH", local, 26)
        found[raw.decode("utf-8" if flags & 0x800 else "cp437")] = (method, offset + 30 + name_size + extra_size, packed, real)
        at += 46 + n_name + n_extra + n_comment
    return found


def _stored(members: dict, name: str) -> tuple[int, int]:
    method, offset, packed, real = members[name]
    if method != 0 or packed != real:
        raise ValueError(f"{name} is not a stored member")
    return offset, real


def read_package(f, span: int = 4 << 20) -> Iterator[Record]:
    """All records of a package, by ranged reads of about ``span`` bytes of neighbouring records."""
    members = directory(f)
    at, size = _stored(members, INDEX)
    lines = [json.loads(x) for x in f.read_at(size, at).splitlines()]
    base, whole = _stored(members, DATA)
    k = 0
    while k < len(lines):
        low = lines[k]["offset"]
        last = k
        while last + 1 < len(lines) and lines[last + 1]["offset"] + lines[last + 1]["length"] - low <= span:
            last += 1
        high = lines[last]["offset"] + lines[last]["length"]
        if high > whole:
            raise ValueError("the index points past its archive")
        data = f.read_at(high - low, base + low)
        for line in lines[k : last + 1]:
            here = line["offset"] - low
            yield parse_record(zlib.decompress(data[here : here + line["length"]], 31))
        k = last + 1


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


_MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def _write_partition(folder: str, package_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    task = TaskContext.get()
    fs, root = _filesystem(folder)
    writer, out, temporary, done = None, None, "", 0

    def finish() -> pa.RecordBatch:
        # A package is published under its final name when it is whole. Names tell attempts apart, as two may see rows in different orders;
        # the manifest, which Spark's committer publishes for one attempt only, decides which packages count.
        records = writer.close()
        out.close()
        name = f"part-{task.partitionId():06d}-{done:04d}-{task.taskAttemptId()}.wacz"
        fs.move(temporary, f"{root}/{name}")
        return pa.record_batch([pa.array([f"{folder}/{name}"]), pa.array([records]), pa.array([writer.size])], schema=_MANIFEST)

    for batch in batches:
        for row in batch.to_pylist():
            if writer is None:
                fs.create_dir(root, recursive=True)
                temporary = f"{root}/.writing-{task.taskAttemptId()}-{done}"
                out = fs.open_output_stream(temporary)
                writer = PackageWriter(out)
            writer.add(row["page_id"], row["url"], row["digest"], record_bytes(row["page_id"], row["url"], row["payload"], row["payload_bytes"], row["digest"], row["refers_to"]))
            if writer.size >= package_bytes:
                yield finish()
                writer, done = None, done + 1
    if writer is not None:
        yield finish()


def write_packages(records: DataFrame, folder: str, package_bytes: int = PACKAGE_BYTES) -> DataFrame:
    """Writes planned records as packages under ``folder``, a URI that all executors reach; returns (path, records, bytes)."""
    rows = records.select("page_id", "url", "payload", "payload_bytes", "digest", "refers_to")
    return materialize(rows.mapInArrow(lambda batches: _write_partition(folder, package_bytes, batches), "path string, records long, bytes long"), "packages")


_READ = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])


def _read_paths(with_payload: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path in batch.column(0).to_pylist():
            fs, local = _filesystem(path)
            with fs.open_input_file(local) as f:
                rows, size = [], 0
                for r in read_package(f):
                    rows.append((r.page_id, r.fields["WARC-Target-URI"], r.payload_bytes, r.fields["WARC-Payload-Digest"].removeprefix("sha1:"), r.fields["WARC-Type"], r.refers_to, r.payload if with_payload else None))
                    size += r.payload_bytes if with_payload else 200
                    if size >= 4 << 20:
                        yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)
                        rows, size = [], 0
                if rows:
                    yield pa.record_batch([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), _READ, strict=True)], schema=_READ)


def read_packages(spark: SparkSession, manifest: DataFrame, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of all records of the packages."""
    paths = manifest.select("path")
    n = max(1, paths.count())
    return paths.repartition(n, "path").mapInArrow(lambda batches: _read_paths(with_payload, batches), "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def archive_and_read(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """The contract's rows: all pages written to packages in the shared scratch space and read back."""
    spark = pages.sparkSession
    manifest = write_packages(plan_records(pages, least), scratch_path(spark, "wacz"))
    return read_packages(spark, manifest, with_payload=False).drop("payload")
