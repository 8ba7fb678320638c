"""TIFF: a writer and a reader of 8-bit pages, in strips or tiles.

The reader walks the chain of image directories, decodes PackBits, LZW or deflate strips and tiles,
undoes horizontal differencing, and gives one row per page.

Payloads are stored as grey pages of 64 samples a row. A payload is cut in pages of ``PAGE_BYTES``;
a page's bytes decide its layout by their CRC, whatever its size: PackBits strips, LZW strips with differencing, deflate
strips, or deflate tiles, a quarter of all pages each. So equal payloads give equal files.

Defined results:
  * a null text is the empty text; a payload is padded with zero bytes to a positive multiple of 64;
  * texts of any length are stored whole; repeated rows give repeated rows with equal values;
  * an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import release
from corpusmill.scratch import materialize

WIDTH = 64
PAGE_BYTES = 1 << 20
STRIP_ROWS = 1024
TILE = 64

_NONE, _LZW, _DEFLATE, _PACKBITS = 1, 5, 8, 32773
_TAG = {"width": 256, "height": 257, "bits": 258, "coding": 259, "grey": 262, "strip_at": 273, "samples": 277, "strip_rows": 278, "strip_size": 279, "page": 297, "predictor": 317, "tile_w": 322, "tile_h": 323, "tile_at": 324, "tile_size": 325}
_SIZE = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}


def packbits(data: bytes) -> bytes:
    """Runs of three or more equal bytes, and literals between them."""
    x = np.frombuffer(data, np.uint8)
    edges = np.concatenate([[0], np.flatnonzero(x[1:] != x[:-1]) + 1, [len(x)]]) if len(x) else np.zeros(1, np.int64)
    sizes = np.diff(edges)
    long = np.flatnonzero(sizes >= 3)
    out, at = [], 0

    def literal(to: int) -> None:
        for i in range(at, to, 128):
            part = data[i : min(i + 128, to)]
            out.append(bytes((len(part) - 1,)) + part)

    for first, size in zip(edges[long].tolist(), sizes[long].tolist(), strict=True):
        literal(first)
        at = first + size
        value = data[first : first + 1]
        while size >= 2:
            n = min(size, 128)
            out.append(bytes((257 - n,)) + value)
            size -= n
        if size:
            out.append(b"\0" + value)
    literal(len(data))
    return b"".join(out)


def unpackbits(data: bytes, size: int) -> bytes:
    out, total, i = [], 0, 0
    while total < size:
        head = data[i]
        if head < 128:
            out.append(data[i + 1 : i + 2 + head])
            i += 2 + head
            total += 1 + head
        elif head > 128:
            out.append(data[i + 1 : i + 2] * (257 - head))
            i += 2
            total += 257 - head
        else:
            i += 1
    return b"".join(out)[:size]


#: Widths of the codes after a clear code, by place: they grow one code early, as the format asks.
_WIDTHS = np.minimum(np.frompyfunc(int.bit_length, 1, 1)(np.arange(259, 259 + 4096)).astype(np.int64), 12)
_OFFSETS = np.concatenate([[0], np.cumsum(_WIDTHS)])


def lzw(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, high bits first."""
    codes, table, after, held = [256], {}, 258, -1
    put, find = codes.append, table.get
    for b in data:
        if held < 0:
            held = b
            continue
        key = held << 8 | b
        known = find(key)
        if known is not None:
            held = known
            continue
        put(held)
        table[key] = after
        after += 1
        held = b
        if after >= 4094:
            put(256)
            table.clear()
            after = 258
    if held >= 0:
        put(held)
    put(257)
    value = np.array(codes, np.int64)
    clear = np.flatnonzero(value == 256)
    place = np.arange(len(value)) - np.repeat(clear + 1, np.diff(np.append(clear, len(value))))  # after the clear code before
    place[clear[1:]] = clear[1:] - clear[:-1] - 1
    width = np.where(place < 0, 9, _WIDTHS[place])
    bits = np.concatenate([[0], np.cumsum(width)])
    back = np.repeat(bits[1:], width) - 1 - np.arange(bits[-1])
    return np.packbits((np.repeat(value, width) >> back & 1).astype(np.uint8)).tobytes()


def _codes(raw: np.ndarray, bit: int) -> np.ndarray:
    """The codes from a bit on that the data may hold, as if no clear code came."""
    at = bit + _OFFSETS[:-1]
    fits = at + _WIDTHS <= 8 * (len(raw) - 2)
    at, width = at[fits], _WIDTHS[fits]
    byte = at >> 3
    word = raw[byte].astype(np.int64) << 16 | raw[byte + 1].astype(np.int64) << 8 | raw[byte + 2]
    return word >> (24 - (at & 7) - width) & ((1 << width) - 1)


def unlzw(data: bytes, size: int) -> bytes:
    raw = np.frombuffer(data + b"\0\0", np.uint8)
    singles = [bytes((i,)) for i in range(256)] + [b"", b""]
    out, total, bit = [], 0, 0
    while total < size:
        codes = _codes(raw, bit)
        if not len(codes):
            raise ValueError("LZW data end early")
        stop = np.flatnonzero((codes == 256) | (codes == 257))
        n = int(stop[0]) if len(stop) else len(codes)
        table, before = singles.copy(), b""
        grow = table.append
        for code in codes[:n].tolist():
            if before:
                piece = table[code] if code < len(table) else before + before[:1]
                grow(before + piece[:1])
            else:
                piece = table[code]
            out.append(piece)
            total += len(piece)
            before = piece
        if not len(stop):
            break
        if codes[n] == 257:
            break
        bit += int(_OFFSETS[n + 1])
    return b"".join(out)[:size]


def _encode(data: bytes, coding: int) -> bytes:
    return {_NONE: bytes, _PACKBITS: packbits, _LZW: lzw, _DEFLATE: lambda x: zlib.compress(x, 1)}[coding](data)


def _decode(data: bytes, coding: int, size: int) -> bytes:
    if coding == _PACKBITS:
        return unpackbits(data, size)
    if coding == _LZW:
        return unlzw(data, size)
    if coding in (_DEFLATE, 32946):
        return zlib.decompress(data)[:size]
    if coding == _NONE:
        return data[:size]
    raise ValueError(f"coding {coding} is not supported")


def _differences(rows: np.ndarray) -> np.ndarray:
    out = rows.copy()
    out[:, 1:] -= rows[:, :-1]
    return out


def _page_parts(data: bytes) -> tuple[int, int, bool, list[bytes]]:
    """(coding, predictor, tiled, encoded parts) of a page."""
    rows = np.frombuffer(data, np.uint8).reshape(-1, WIDTH)
    layout = zlib.crc32(data) & 3
    if layout == 3:
        short = -len(rows) % TILE
        whole = np.vstack([rows, np.zeros((short, WIDTH), np.uint8)]) if short else rows
        return _DEFLATE, 1, True, [_encode(whole[i : i + TILE].tobytes(), _DEFLATE) for i in range(0, len(whole), TILE)]
    coding, predictor = ((_PACKBITS, 1), (_LZW, 2), (_DEFLATE, 1))[layout]
    samples = _differences(rows) if predictor == 2 else rows
    return coding, predictor, False, [_encode(samples[i : i + STRIP_ROWS].tobytes(), coding) for i in range(0, len(rows), STRIP_ROWS)]


def write_tiff(payload: bytes) -> bytes:
    """A little-endian TIFF file of a payload whose length is a positive multiple of ``WIDTH``."""
    out = bytearray(b"II*\0\0\0\0\0")
    link = 4
    pages = [payload[i : i + PAGE_BYTES] for i in range(0, len(payload), PAGE_BYTES)]
    for k, data in enumerate(pages):
        coding, predictor, tiled, parts = _page_parts(data)
        at = []
        for p in parts:
            at.append(len(out))
            out += p
            out += b"\0" * (len(out) % 2)
        sizes = [len(p) for p in parts]
        height = len(data) // WIDTH
        entries = {"width": (4, [WIDTH]), "height": (4, [height]), "bits": (3, [8]), "coding": (3, [coding]), "grey": (3, [1]), "samples": (3, [1]), "page": (3, [k & 0xFFFF, len(pages) & 0xFFFF]), "predictor": (3, [predictor])}
        if tiled:
            entries |= {"tile_w": (4, [TILE]), "tile_h": (4, [TILE]), "tile_at": (4, at), "tile_size": (4, sizes)}
        else:
            entries |= {"strip_at": (4, at), "strip_rows": (4, [STRIP_ROWS]), "strip_size": (4, sizes)}
        fields = []
        for name, (kind, values) in sorted(entries.items(), key=lambda x: _TAG[x[0]]):
            raw = struct.pack(f"<{len(values)}{'H' if kind == 3 else 'I'}", *values)
            if len(raw) > 4:
                place, raw = len(out), out.extend(raw) or b""
                raw = struct.pack("<I", place)
            fields.append(struct.pack("<HHI", _TAG[name], kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


@dataclass
class Page:
    number: int
    width: int
    height: int
    coding: int
    predictor: int
    samples: bytes


def read_tiff(data: bytes) -> Iterator[Page]:
    """The pages of a file of 8-bit grey samples, either byte order, strips or tiles."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    (at,) = struct.unpack_from(order + "I", data, 4)
    seen, number = set(), 0
    while at:
        if at in seen:
            raise ValueError("the image directories form a ring")
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
            if kind not in (1, 3, 4):
                continue
            place = at + 10 + 12 * k
            if count * _SIZE[kind] > 4:
                (place,) = struct.unpack_from(order + "I", data, place)
            tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 3: 'H', 4: 'I'}[kind]}", data, place))
        yield _page(number, data, tags)
        number += 1
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)


def _page(number: int, data: bytes, tags: dict[int, list[int]]) -> Page:
    get = lambda name, default: tags.get(_TAG[name], [default])[0]
    width, height, coding, predictor = get("width", 0), get("height", 0), get("coding", 1), get("predictor", 1)
    if get("bits", 1) != 8 or get("samples", 1) != 1 or predictor not in (1, 2):
        raise ValueError("only pages of single 8-bit samples are supported")

    def part(at: int, size: int, w: int, h: int) -> np.ndarray:
        rows = np.frombuffer(_decode(data[at : at + size], coding, w * h), np.uint8).reshape(h, w)
        return np.cumsum(rows, axis=1, dtype=np.uint8) if predictor == 2 else rows

    if _TAG["tile_at"] in tags:
        tw, th = get("tile_w", 0), get("tile_h", 0)
        across = -(-width // tw)
        canvas = np.zeros((-(-height // th) * th, across * tw), np.uint8)
        for k, (at, size) in enumerate(zip(tags[_TAG["tile_at"]], tags[_TAG["tile_size"]], strict=True)):
            y, x = k // across * th, k % across * tw
            canvas[y : y + th, x : x + tw] = part(at, size, tw, th)
        samples = canvas[:height, :width].tobytes()
    else:
        step = min(get("strip_rows", height), height)
        parts = zip(tags[_TAG["strip_at"]], tags[_TAG["strip_size"]], strict=True)
        samples = b"".join(part(at, size, width, min(step, height - k * step)).tobytes() for k, (at, size) in enumerate(parts))
    return Page(number, width, height, coding, predictor, samples)


def payload_of(text: bytes) -> bytes:
    """The bytes, padded with zero bytes to a positive multiple of 64."""
    return text.ljust(max(1, -(-len(text) // WIDTH)) * WIDTH, b"\0")


def features_of(pages: int, counts: np.ndarray, changes: int) -> str:
    """Statistics of the samples: their mean, deviation, entropy, distinct values, and changes along rows."""
    total = int(counts.sum())
    values = np.arange(256)
    mean = float((counts * values).sum()) / total
    deviation = float((counts * (values - mean) ** 2).sum() / total) ** 0.5
    p = counts[counts > 0] / total
    return f"pages={pages};mean={mean:.4f};deviation={deviation:.4f};entropy={float(-(p * np.log2(p)).sum()) + 0.0:.4f};distinct={int((counts > 0).sum())};changes={changes}"


_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.large_binary())])


def _write_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
            rows.append((doc_id, len(text or b""), write_tiff(payload_of(text or b""))))
            size += len(rows[-1][2])
            if size >= 4 << 20:
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEDIA, strict=True)], schema=_MEDIA)
                rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _MEDIA, strict=True)], schema=_MEDIA)


def to_media(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a TIFF file."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_write_rows, "doc_id long, n_bytes long, media binary")


_PAGES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("coding", pa.int32()), ("predictor", pa.int32()), ("samples", pa.large_binary())])
_PAGES_DDL = "doc_id long, n_bytes long, media_bytes long, media_sha256 string, page int, width int, height int, coding int, predictor int, samples binary"


def _page_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, size = [], 0
        for doc_id, n_bytes, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = (doc_id, n_bytes, len(data), hashlib.sha256(data).hexdigest())
            for p in read_tiff(data):
                rows.append((*own, p.number, p.width, p.height, p.coding, p.predictor, p.samples))
                size += len(p.samples)
                if size >= 4 << 20:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES)
                    rows, size = [], 0
        if rows:
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PAGES, strict=True)], schema=_PAGES)


def pages_of(media: DataFrame) -> DataFrame:
    """One row per page: (doc_id, n_bytes, media_bytes, media_sha256, page, width, height, coding, predictor, samples); a file's pages follow each other."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_page_rows, _PAGES_DDL)


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def _digest_rows(pages: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of pages, in order, become a row per file: page 0 begins one."""
    file, done = None, []

    def digest() -> tuple:
        head, sha, size, tail, counts, changes, n = file
        return head[0], head[1], size, sha.hexdigest(), zlib.crc32(tail), head[2], head[3], features_of(n, counts, changes)

    def flush() -> pa.RecordBatch:
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), _DIGEST, strict=True)], schema=_DIGEST)

    for batch in pages:
        for *head, page, _, height, _, _, samples in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if page == 0:
                if file:
                    done.append(digest())
                file = [head, hashlib.sha256(), 0, b"", np.zeros(256, np.int64), 0, 0]
            x = np.frombuffer(samples, np.uint8)
            rows = x.reshape(height, -1)
            file[1].update(samples)
            file[2] += len(samples)
            file[3] = (file[3] + samples[-64:])[-64:]
            file[4] += np.bincount(x, minlength=256)
            file[5] += int(np.count_nonzero(rows[:, 1:] != rows[:, :-1]))
            file[6] += 1
        if done:
            yield flush()
            done.clear()
    if file:
        done.append(digest())
        yield flush()
    release()


def report(documents: DataFrame) -> DataFrame:
    """The contract's digest: files are written to the shared scratch space, read back as rows of pages, and those folded by file.

    Pages are read and folded in one worker: what :func:`pages_of` gives doesn't cross to the JVM and back.
    """
    media = materialize(to_media(documents), "tiff", compression="none")
    return media.select("doc_id", "n_bytes", "media").mapInArrow(lambda batches: _digest_rows(_page_rows(batches)), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
