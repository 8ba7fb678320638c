"""Token ids in ORC: integer run-length encoded id lists, with row indexes and Bloom filters on doc_id.

Texts are encoded by a tokenizer file of the ``tokenizers`` library. A text is cut where the
tokenizer's own pattern always cuts (at ASCII white space, and between ASCII letters, digits and
punctuation), each distinct piece is encoded once per task while a memory of ``MEMORY_BYTES``
lasts, and the ids are put together with numpy. Words of plain small letters go to the tokenizer's
model alone, as its normalizer and pattern don't change them. The memory goes when the task ends. The pieces' ids equal the whole text's; a text
that holds the string of an added token is encoded whole.

Files hold the documents in ascending doc_id order: file k's documents precede file k + 1's, and rows
are sorted in a file. A row has the document's position in its file, so the global position of a
document needs the totals of the files before it and no other document.

Defined results:
  * a null text is the empty text: its ids are the end id alone; a text of any length is encoded whole;
  * rows of equal doc_id follow each other, ordered by a hash of their text; a null doc_id comes first;
  * an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import lower_ascii, release, runs
from corpusmill.scratch import scratch_path

END_ID = 2
#: Bytes that a worker's memory of distinct pieces may take; beyond half of them it forgets the pieces not seen since the last time.
MEMORY_BYTES = 32 << 20
#: What a remembered piece takes beside its own bytes and those of its ids: two objects' heads and a place in a table.
PIECE_BYTES = 200
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 1000
#: About so many documents go to a file.
DOCS_PER_FILE = 16_384
#: The files' totals are sent to all executors while there are no more files; beyond, they are joined by file.
BROADCAST_FILES = 1_000_000
#: Bytes that are cut and looked up together.
RUN = 2 << 20

#: Words that are encoded together.
WORDS = 2000
#: What the light tokenizer relies on: letters that the normalizer leaves as they are and the pattern takes as one piece, given to the model as bytes.
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: a-z and the small letters of Latin-1: composed, lower case, and no two of them combine.
_PLAIN = re.compile("[a-zß-öø-ÿ]+")


def _byte_letters() -> str:
    """The character that stands for each byte in byte-level vocabularies; the space stays, as it parts words here."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = iter(range(256, 512))
    return "".join(" " if b == 32 and next(other) else chr(b) if b in shown else chr(next(other)) for b in range(256))


_BYTE_LETTERS = _byte_letters()

_SPACE, _LETTER, _DIGIT, _PUNCT, _QUOTE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[33:127] = _PUNCT
_CLASS[48:58] = _DIGIT
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[39] = _QUOTE
#: By class before and class after: a piece ends between them. An apostrophe may begin a contraction; other bytes may combine.
_CUT = np.zeros((6, 6), bool)
_CUT[_DIGIT, :] = _CUT[:, _DIGIT] = True
_CUT[_LETTER, [_PUNCT, _QUOTE]] = _CUT[_PUNCT, _LETTER] = True
_CUT[_SPACE, :] = _CUT[:, _SPACE] = True
_CUT = _CUT.ravel()


class Encoder:
    """Ids of many texts by a tokenizer that cuts at ASCII spaces and between ASCII classes, case ignored."""

    def __init__(self, definition: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        added = self.tokenizer.get_added_tokens_decoder()
        self.whole = [t.content.encode() for t in added.values()]
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends_word = np.zeros(max([*vocab.values(), *added, 0]) + 1, bool)
        self.ends_word[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.light = self._light()
        self.known: dict[bytes, bytes] = {}  # a piece's ids, as 32-bit integers
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def _light(self):
        """The same model for plain words between spaces, without the normalizer and the pattern, which leave such words as they are; None for a tokenizer of another form."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        whole = self.tokenizer
        form = lambda part: json.loads(part.__getstate__()) if part is not None else {}
        split, *rest = form(whole.pre_tokenizer).get("pretokenizers") or [{}]
        pattern = split.get("type") == "Split" and split.get("pattern") == {"Regex": _PATTERN} and split.get("behavior") == "Removed" and split.get("invert") is True
        byte_level = len(rest) == 1 and rest[0].get("type") == "ByteLevel" and not rest[0].get("add_prefix_space") and not rest[0].get("use_regex", True)
        if form(whole.normalizer).get("normalizers") != _NORMALIZERS or not pattern or not byte_level or not isinstance(whole.model, models.BPE) or whole.truncation or whole.padding:
            return None
        light = Tokenizer(whole.model)  # the model is shared, not copied
        light.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        return light

    def forget(self) -> None:
        """Frees the memory of pieces."""
        self.known, self.older, self.held = {}, {}, 0

    def whole_text(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _encoded(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of new pieces: of those of letters alone many at a time, as their last token tells where each ends."""
        texts = b" ".join(pieces).decode("utf-8", "replace").split(" ") if pieces else []
        out: list[bytes | None] = [None] * len(pieces)
        plain, letters, rest = [], [], []
        for i, t in enumerate(texts):
            (plain if self.light and _PLAIN.fullmatch(t) else letters if t.isalpha() else rest).append(i)
        for some, tokenizer in ((plain, self.light), (letters, self.tokenizer)):
            for k in range(0, len(some), WORDS):
                part = some[k : k + WORDS]
                if tokenizer is self.light:
                    joined = codecs.charmap_decode(b" ".join([pieces[i] for i in part]), "strict", _BYTE_LETTERS)[0]
                else:
                    joined = " ".join([texts[i] for i in part])
                ids = np.array(tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, np.int32)
                ends = 4 * np.flatnonzero(self.ends_word[ids]) + 4
                if len(ends) == len(part):
                    raw, low = ids.tobytes(), 0
                    for i, high in zip(part, ends.tolist(), strict=True):
                        out[i] = raw[low:high]
                        low = high
                else:
                    rest += part
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False), strict=True):
            out[i] = array("i", e.ids).tobytes()
        return out

    def _ids_of(self, pieces: list[bytes]) -> list[bytes]:
        if 2 * self.held > MEMORY_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        out = list(map(self.known.get, pieces))
        asked = [i for i, x in enumerate(out) if x is None]
        own = [pieces[i] for i in asked]
        found = list(map(self.older.get, own))
        fresh = iter(self._encoded([p for p, x in zip(own, found, strict=True) if x is None]))
        found = [next(fresh) if x is None else x for x in found]
        self.known.update(zip(own, found, strict=True))
        self.held += sum(map(len, own)) + sum(map(len, found)) + PIECE_BYTES * len(own)
        for i, x in zip(asked, found, strict=True):
            out[i] = x
        return out

    def encode(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts in ``buf``, one after another, and where each text's begin."""
        n = len(offsets) - 1
        low = lower_ascii(buf)
        kind = _CLASS[low]
        solid = kind != _SPACE
        begins = np.zeros(len(buf) + 1, bool)
        if len(buf):
            begins[1:-1] = _CUT[kind[:-1] * np.uint8(6) + kind[1:]]
            begins[offsets[:-1]] = True
        begins[-1] = False
        begins[:-1] &= solid
        place = np.zeros(len(buf) + 1, np.int32)
        np.cumsum(solid, dtype=np.int32, out=place[1:])
        starts = np.flatnonzero(begins)
        compact = low[solid]
        where = np.append(place[starts], np.int32(len(compact)))
        pieces = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(where), pa.py_buffer(compact)]).dictionary_encode()
        distinct = self._ids_of(pieces.dictionary.to_pylist())
        sizes = np.array([len(x) // 4 for x in distinct], np.int64)
        flat = np.frombuffer(b"".join(distinct), np.int32)
        origin = np.cumsum(sizes) - sizes
        index = pieces.indices.to_numpy(zero_copy_only=False)
        size = sizes[index] if len(index) else np.empty(0, np.int64)
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(upto[-1]) + np.repeat(origin[index] - upto[:-1], size)] if len(index) else flat
        at = upto[np.searchsorted(starts, offsets, side="left")]
        if any(w in (raw := buf.tobytes()) for w in self.whole):
            texts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            own = [self.whole_text(t.decode("utf-8", "replace")) if any(w in t for w in self.whole) else ids[at[i] : at[i + 1]] for i, t in enumerate(texts)]
            ids = np.concatenate(own)
            at = np.concatenate([[0], np.cumsum([len(x) for x in own])])
        assert len(at) == n + 1
        return ids, at


@lru_cache(maxsize=2)
def _encoder(definition: str) -> Encoder:
    return Encoder(definition)


_ROWS = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
_ROWS_DDL = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


def _encode_rows(definition: str, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    encoder, part, start = _encoder(definition), TaskContext.get().partitionId(), 0
    for batch in batches:
        for a, b, buf, offsets in runs(batch.column(1), RUN):
            ids, at = encoder.encode(buf, offsets)
            n = b - a
            lengths = np.diff(at) + 1
            ends = np.cumsum(lengths)
            out = np.full(int(ends[-1]), end_id, np.int32)
            keep = np.ones(len(out), bool)
            keep[ends - 1] = False
            out[keep] = ids
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(out))
            columns = [batch.column(0).slice(a, n), pa.array(np.full(n, part, np.int32)), pa.array(start + ends - lengths), pa.array(lengths), lists]
            start += int(ends[-1])
            yield pa.record_batch(columns, schema=_ROWS)
    encoder.forget()
    release()


def write_token_files(documents: DataFrame, path: str, tokenizer_path: str, end_id: int = END_ID, files: int | None = None) -> None:
    """Writes the ids of all texts as ORC files under ``path``, in ascending doc_id order."""
    spark = documents.sparkSession
    definition = spark.sparkContext.broadcast(Path(tokenizer_path).read_text(encoding="utf-8"))
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    if files is None:
        files = max(1, -(-documents.count() // DOCS_PER_FILE), int(spark.conf.get("spark.sql.shuffle.partitions")))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ordered = docs.repartitionByRange(files, *order).sortWithinPartitions(*order)
    encoded = ordered.mapInArrow(lambda batches: _encode_rows(definition.value, end_id, batches), _ROWS_DDL)
    encoded.write.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01").option("orc.row.index.stride", str(ROW_INDEX_STRIDE)).option("orc.stripe.size", str(STRIPE_BYTES)).option("orc.create.index", "true").option("compression", "zstd").orc(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents: ``start`` counts the ids of all documents before it.

    Files are read by stripe; a filter on doc_id is pushed to the files' indexes and Bloom filters.
    """
    rows = spark.read.schema(_ROWS_DDL).orc(path)
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("total"))  # a row for each file
    before = totals.select("part", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    if len(rows.inputFiles()) <= BROADCAST_FILES:
        before = F.broadcast(before)  # 12 bytes a file
    return rows.join(before, "part").select("doc_id", (F.col("before") + F.col("local_start")).alias("start"), "n_tokens", "ids")


def find_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """The id lists of some documents: stripes and row groups that can't hold them are skipped."""
    return spark.read.schema(_ROWS_DDL).orc(path).where(F.col("doc_id").isin(doc_ids)).select("doc_id", "n_tokens", "ids")


_DIGEST = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _digest_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lists = batch.column(3)
        values = np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False), dtype="<u4")
        at = lists.offsets.to_numpy()
        data = memoryview(values).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        yield pa.record_batch([*batch.columns[:3], pa.array(crc, pa.int64())], schema=_DIGEST)


def report(spark: SparkSession, path: str) -> DataFrame:
    """The contract's digest of files that :func:`write_token_files` wrote."""
    return read_token_files(spark, path).mapInArrow(_digest_rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_report(documents: DataFrame, tokenizer_path: str, end_id: int = END_ID) -> DataFrame:
    """Writes the files to a fresh folder of the shared scratch space and reads them back."""
    path = scratch_path(documents.sparkSession, "token-ids")
    write_token_files(documents, path, tokenizer_path, end_id)
    return report(documents.sparkSession, path)


def ids_crc32(ids: list[int]) -> int:
    """What ``ids_crc32`` is for a list of ids."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def file_digest(path: str) -> str:
    """SHA-256 of a tokenizer file, to note beside the ids."""
    return hashlib.sha256(Path(path).read_bytes()).hexdigest()
