"""Token files: a header and little-endian 16-bit ids, documents end with the end id. A Python data source reads and writes them.

    spark.dataSource.register(TokenFiles)
    spark.read.format("tok1").load(path)                                  # (file, doc, ids)
    df.write.format("tok1").option("vocab", 32000).option("eos", 2).mode("append").save(path)

Files with another header, of 24 bytes, are read with ``option("header", "gnrp")``.
"""

from __future__ import annotations

import glob
import os
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

# Fixed values of the format.
MAGIC, VERSION = 0x544F4B31, 1
HEADER = struct.Struct("<IIIIQIQ")  # magic, version, vocabulary, end id, tokens, split, reserved
OTHER_MAGIC = int.from_bytes(b"GNRP", "little")
OTHER_HEADER = struct.Struct("<IIIIQ")  # magic, version, vocabulary, end id, tokens
SPLITS = {"train": 0, "val": 1, "test": 2}
#: Tokens that a partition reads.
SPAN = 16 << 20


@dataclass(frozen=True)
class TokenHeader:
    vocab: int
    eos: int
    tokens: int
    split: int
    size: int


def read_header(path: str, kind: str = "tok1") -> TokenHeader:
    """The header of a file whose size must be exactly what it says."""
    form, magic = (HEADER, MAGIC) if kind == "tok1" else (OTHER_HEADER, OTHER_MAGIC)
    with open(path, "rb") as f:
        raw = f.read(form.size)
    if len(raw) < form.size:
        raise ValueError(f"{path}: shorter than its header")
    got = form.unpack(raw)
    if got[0] != magic:
        raise ValueError(f"{path}: not a {kind} file")
    header = TokenHeader(got[2], got[3], got[4], got[5] if kind == "tok1" else 0, form.size)
    if os.path.getsize(path) != form.size + 2 * header.tokens:
        raise ValueError(f"{path}: {os.path.getsize(path)} bytes, not {form.size + 2 * header.tokens}")
    return header


def write_tokens(path: str, ids: np.ndarray, vocab: int, eos: int, split: str = "train") -> None:
    """Writes a file under another name first, so that none is ever half written."""
    ids = np.asarray(ids)
    if not 0 <= eos < vocab or vocab > 65536:
        raise ValueError("the end id must be in a vocabulary of at most 65,536")
    if len(ids) and (ids.min() < 0 or ids.max() >= vocab):
        raise ValueError("an id is outside the vocabulary")
    temporary = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
    with open(temporary, "wb") as f:
        f.write(HEADER.pack(MAGIC, VERSION, vocab, eos, len(ids), SPLITS[split], 0))
        f.write(ids.astype("<u2").tobytes())
    os.replace(temporary, path)


def read_tokens(path: str, kind: str = "tok1") -> tuple[TokenHeader, np.ndarray]:
    header = read_header(path, kind)
    return header, np.memmap(path, "<u2", "r", header.size, (header.tokens,)) if header.tokens else np.empty(0, "<u2")


def problems(path: str) -> list[str]:
    """What is wrong with a file; none if it is sound."""
    try:
        header, ids = read_tokens(path)
    except ValueError as e:
        return [str(e)]
    found = []
    if not len(ids):
        return ["no tokens"]
    if int(ids.max()) >= header.vocab:
        found.append(f"id {int(ids.max())} outside the vocabulary of {header.vocab}")
    if int(ids[-1]) != header.eos:
        found.append("the last document isn't ended")
    return found


def merge(paths: list[str], out: str, split: str = "train") -> int:
    """One file after another; vocabularies and end ids must agree."""
    headers = [read_header(p) for p in paths]
    if len({(h.vocab, h.eos) for h in headers}) != 1:
        raise ValueError("files of different vocabularies")
    total = sum(h.tokens for h in headers)
    temporary = f"{out}.tmp"
    with open(temporary, "wb") as f:
        f.write(HEADER.pack(MAGIC, VERSION, headers[0].vocab, headers[0].eos, total, SPLITS[split], 0))
        for p, h in zip(paths, headers, strict=True):
            with open(p, "rb") as g:
                g.seek(h.size)
                while chunk := g.read(16 << 20):
                    f.write(chunk)
    os.replace(temporary, out)
    return total


class _Span(InputPartition):
    def __init__(self, path: str, kind: str, low: int, high: int):
        super().__init__((path, low, high))
        self.path, self.kind, self.low, self.high = path, kind, low, high


_ROWS = pa.schema([("file", pa.string()), ("doc", pa.int64()), ("ids", pa.list_(pa.int32()))])


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], kind: str, span: int):
        self.paths, self.kind, self.span = paths, kind, span

    def partitions(self) -> list[_Span]:
        out = []
        for p in self.paths:
            n = read_header(p, self.kind).tokens
            out += [_Span(p, self.kind, k, min(k + self.span, n)) for k in range(0, n, self.span)]
        return out or [_Span("", self.kind, 0, 0)]

    def read(self, partition: _Span) -> Iterator[pa.RecordBatch]:
        """The documents that begin in the span, whole; ``doc`` is where they begin, in tokens."""
        if not partition.path:
            return
        header, ids = read_tokens(partition.path, partition.kind)
        low, high = partition.low, partition.high
        if low and ids[low - 1] != header.eos:  # that document began before the span
            ends = np.flatnonzero(ids[low:high] == header.eos)
            if not len(ends):
                return
            low += int(ends[0]) + 1
        stop = high
        while stop < header.tokens and ids[stop - 1] != header.eos:
            ends = np.flatnonzero(ids[stop : stop + (1 << 16)] == header.eos)
            stop = stop + int(ends[0]) + 1 if len(ends) else min(stop + (1 << 16), header.tokens)
        if low >= high:
            return
        own = np.asarray(ids[low:stop]).astype(np.int32)
        edges = np.append(0, np.flatnonzero(own == header.eos) + 1)
        if edges[-1] != len(own):
            edges = np.append(edges, len(own))  # a last document without an end
        name = os.path.basename(partition.path)
        for k in range(0, len(edges) - 1, 4096):
            part = edges[k : k + 4097]
            lists = pa.ListArray.from_arrays(pa.array(part - part[0], pa.int32()), pa.array(own[part[0] : part[-1]]))
            yield pa.record_batch([pa.array([name] * (len(part) - 1)), pa.array(low + part[:-1]), lists], schema=_ROWS)


class _Done(WriterCommitMessage):
    def __init__(self, path: str):
        self.path = path


class _Writer(DataSourceWriter):
    def __init__(self, path: str, vocab: int, eos: int, split: str):
        self.path, self.vocab, self.eos, self.split = path, vocab, eos, split

    def write(self, rows: Iterator) -> _Done:
        from pyspark import TaskContext

        os.makedirs(self.path, exist_ok=True)
        ids = [np.asarray(r["ids"], np.int64) for r in rows]
        if not ids:
            return _Done("")
        hidden = os.path.join(self.path, f".part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex[:8]}.bin")
        write_tokens(hidden, np.concatenate(ids), self.vocab, self.eos, self.split)
        return _Done(hidden)

    def commit(self, messages: list[_Done | None]) -> None:
        """Files of successful tasks get their names: nothing half written is ever seen."""
        for m in messages:
            if m and m.path:
                os.replace(m.path, os.path.join(self.path, os.path.basename(m.path)[1:]))

    def abort(self, messages: list[_Done | None]) -> None:
        for m in messages:
            if m and m.path and os.path.exists(m.path):
                os.remove(m.path)


class TokenFiles(DataSource):
    """Format ``tok1``; files must be on a path that driver and executors share as a file system."""

    @classmethod
    def name(cls) -> str:
        return "tok1"

    def schema(self) -> str:
        return "file string, doc long, ids array<int>"

    def _path(self) -> str:
        return self.options["path"].removeprefix("file://").removeprefix("file:")

    def reader(self, schema) -> _Reader:
        path = self._path()
        paths = sorted(glob.glob(os.path.join(path, "*.bin"))) if os.path.isdir(path) else sorted(glob.glob(path))
        return _Reader(paths, self.options.get("header", "tok1"), int(self.options.get("span", SPAN)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self._path(), int(self.options["vocab"]), int(self.options["eos"]), self.options.get("split", "train"))
