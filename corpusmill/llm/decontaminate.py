"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The test strings are windows of consecutive benchmark words. A table of shifts, indexed by the hash
of a block of words, tells how far a search may jump when no test string can end at a position;
where the shift is zero, the block's hash selects a bucket of test strings, and comparing the words
themselves confirms an occurrence. Texts are cut in stretches that are searched abreast.

Defined results:
  * null or empty text, or one without words: no words, no hits, not contaminated;
  * a benchmark item without words matches nothing; one of fewer words than a window is one window;
  * an item of null id is searched as all others, and its words count as hit; only its id is not listed nor counted in n_items;
  * a text of any length is searched whole, in stretches;
  * items of equal text all count as found; an empty benchmark leaves every document clean;
  * repeated documents give repeated rows; other columns of either table are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import RollingHash, kept_rows, lower_ascii, mix, release, runs, word_spans
from corpusmill.scratch import materialize, numbered

#: Words: runs of 0-9, a-z and of all that is not ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW = 13
#: A benchmark of more bytes is searched in several blocks, each of about that many: a block's tables take some hundred times its bytes.
BLOCK_BYTES = 1 << 20
#: Where the searched stretches of a text begin, in words.
STRETCH = 256

_WORD_BYTES = re.compile(WORD.encode("latin-1"))
_IS_WORD = np.zeros(256, bool)
_IS_WORD[0x30:0x3A] = _IS_WORD[0x61:0x7B] = _IS_WORD[0x80:] = True
_TABLE_BITS = 18


def words_of(text: str | None) -> list[bytes]:
    """The words of a text: A-Z lower-cased, no other letter changed."""
    return _WORD_BYTES.findall((text or "").encode().lower())


def _word_hashes(words: list[bytes]) -> np.ndarray:
    buf = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1]).astype(np.int64)
    return RollingHash(buf).of(starts, ends)


def _block(hashes: list[np.ndarray]) -> np.ndarray:
    h = hashes[0]
    for x in hashes[1:]:
        h = h * np.uint64(0x100000001B3) + x
    return mix(h)


@dataclass
class Tables:
    """Wu-Manber tables for patterns of which none has fewer than ``length`` words."""

    length: int
    block: int = 2
    shift: np.ndarray = field(default=None, repr=False)
    keys: np.ndarray = field(default=None, repr=False)  # sorted block hashes at which a pattern's first `length` words end
    first: np.ndarray = field(default=None, repr=False)  # where a key's patterns begin in `order`
    order: np.ndarray = field(default=None, repr=False)

    @classmethod
    def build(cls, length: int, ids: list[int], patterns: list[tuple[bytes, ...]]) -> Tables:
        own = cls(length, min(2, length))
        own.shift = np.full(1 << _TABLE_BITS, length - own.block + 1, np.int16)
        suffix = np.empty(len(ids), np.uint64)
        for k, i in enumerate(ids):
            h = _word_hashes(list(patterns[i][:length]))
            blocks = _block([h[j : length - own.block + 1 + j] for j in range(own.block)])
            suffix[k] = blocks[-1]
            np.minimum.at(own.shift, (blocks >> np.uint64(64 - _TABLE_BITS)).astype(np.int64), np.arange(len(blocks) - 1, -1, -1, dtype=np.int16))
        rank = np.argsort(suffix, kind="stable")
        own.keys, own.first = np.unique(suffix[rank], return_index=True)
        own.first = np.append(own.first, len(ids))
        own.order = np.asarray(ids, np.int64)[rank]
        return own


class WuManber:
    """Test strings of words, searched in many texts at once."""

    def __init__(self, patterns: list[tuple[bytes, ...]]):
        self.patterns = patterns
        self.sizes = np.array([len(p) for p in patterns], np.int64)
        groups: dict[int, list[int]] = {}
        for i, p in enumerate(patterns):
            groups.setdefault(max(k for k in (1, 2, 4, 8, WINDOW) if k <= len(p)), []).append(i)
        self.tables = [Tables.build(length, ids, patterns) for length, ids in sorted(groups.items())]

    def search(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word positions and pattern numbers of all occurrences; ``first`` has each text's first word."""
        if not len(starts) or not self.tables:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        hashes = RollingHash(low)
        at, which = [], []
        for t in self.tables:
            for pos, pat in self._candidates(t, hashes, starts, ends, first):
                at.append(pos)
                which.append(pat)
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        at, which = np.concatenate(at), np.concatenate(which)
        text_end = first[np.searchsorted(first, at, side="right")]
        keep = at + self.sizes[which] <= text_end
        at, which = at[keep], which[keep]
        return self._confirmed(low, starts, ends, at, which)

    def _candidates(self, t: Tables, hashes: RollingHash, starts: np.ndarray, ends: np.ndarray, first: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        # A cursor stands at the last of the first `length` words that a pattern would have there.
        low, high = first[:-1] + t.length - 1, first[1:]
        room = high > low
        low, high = low[room], high[room]
        pieces = -(-(high - low) // STRETCH)
        origin = np.repeat(low, pieces)
        step = np.arange(len(origin)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        pos = origin + step * STRETCH
        stop = np.minimum(pos + STRETCH, np.repeat(high, pieces))
        while len(pos):
            near = [pos - k for k in range(t.block - 1, -1, -1)]
            h = _block([hashes.of(starts[p], ends[p]) for p in near])
            shift = t.shift[(h >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)].astype(np.int64)
            zero = shift == 0
            if zero.any():
                where, key = pos[zero], h[zero]
                k = np.minimum(np.searchsorted(t.keys, key), len(t.keys) - 1)
                same = t.keys[k] == key
                where, k = where[same], k[same]
                n = t.first[k + 1] - t.first[k]
                if len(n):
                    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    yield np.repeat(where, n) - t.length + 1, t.order[np.repeat(t.first[k], n) + within]
            pos = pos + np.maximum(shift, 1)
            alive = pos < stop
            pos, stop = pos[alive], stop[alive]

    def _confirmed(self, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data, seen = low.tobytes(), {}
        keep = np.zeros(len(at), bool)
        for i, (a, p) in enumerate(zip(at.tolist(), which.tolist(), strict=True)):
            raw = data[starts[a] : ends[a + self.sizes[p] - 1]]
            found = seen.get((raw, p))
            if found is None:
                found = seen[raw, p] = tuple(_WORD_BYTES.findall(raw)) == self.patterns[p]
            keep[i] = found
        return at[keep], which[keep]


def windows_of(items: list[tuple[object, str | None]], window: int = WINDOW) -> tuple[list[tuple[bytes, ...]], list[list[str]]]:
    """Distinct windows of the items, and each window's item ids as strings. Items of null text give none; a null id is no window's."""
    owners: dict[tuple[bytes, ...], set[str]] = {}
    for item_id, text in items:
        words = words_of(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners.setdefault(tuple(words[i : i + window]), set()).update([] if item_id is None else [str(item_id)])
    return list(owners), [sorted(x) for x in owners.values()]


_SCANNED = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("ranges", pa.list_(pa.struct([("low", pa.int64()), ("high", pa.int64())]))), ("items", pa.list_(pa.string()))])
_SCANNED_DDL = "doc_id long, n_words long, n_hit long, ranges array<struct<low:long,high:long>>, items array<string>"


def _scan(matcher: WuManber, owners: list[list[str]], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, text) become the hit word ranges of each text, sorted and apart, and the items found."""
    for batch in batches:
        for a, b, buf, offsets in runs(batch.column(1)):
            low = lower_ascii(buf)
            starts, ends, first = word_spans(_IS_WORD[low], offsets)
            at, which = matcher.search(low, starts, ends, first)
            doc = np.searchsorted(first, at, side="right") - 1
            ranges, items = [[] for _ in range(b - a)], [set() for _ in range(b - a)]
            for d, p, w in sorted(zip(doc.tolist(), at.tolist(), which.tolist(), strict=True)):
                from_word = p - int(first[d])
                to_word = from_word + len(matcher.patterns[w])
                if ranges[d] and from_word <= ranges[d][-1]["high"]:
                    ranges[d][-1]["high"] = max(ranges[d][-1]["high"], to_word)
                else:
                    ranges[d].append({"low": from_word, "high": to_word})
                items[d].update(owners[w])
            columns = [np.diff(first), [sum(x["high"] - x["low"] for x in r) for r in ranges], ranges, [sorted(x) for x in items]]
            yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(c, f.type) for c, f in zip(columns, _SCANNED, strict=True))], names=["doc_id", *_SCANNED.names])
    release()


def _parts(benchmark: DataFrame, block_bytes: int) -> int:
    """In how many blocks the benchmark's texts are searched."""
    return int(-(-(benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0) // block_bytes)) or 1


def _blocks(benchmark: DataFrame, n: int, window: int = WINDOW) -> Iterator[tuple[WuManber, list[list[str]]]]:
    """Search tables for the benchmark: for all of it, or for hashed parts of it, one after another."""
    items = benchmark.select("item_id", "text")
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        patterns, owners = windows_of([(r[0], r[1]) for r in part.toLocalIterator()], window)
        yield WuManber(patterns), owners


def _union_size(ranges: Column) -> Column:
    """The number of words in a union of (low, high) ranges that are sorted by low."""
    zero = F.lit(0).cast("long")
    return F.aggregate(
        ranges,
        F.struct(zero.alias("n"), zero.alias("to")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(zero, x["high"] - F.greatest(x["low"], acc["to"]))).alias("n"), F.greatest(acc["to"], x["high"]).alias("to")),
        lambda acc: acc["n"],
    )


def find_hits(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items): the words of each document inside occurrences, and the items found.

    Only the benchmark's texts are sent to the executors, in blocks whose size is measured first: one
    block and one pass where the benchmark is within ``block_bytes``, else as many passes as blocks, one block
    at a time, whose word ranges are united by row.
    """
    context = documents.sparkSession.sparkContext
    n = _parts(benchmark, block_bytes)
    if n == 1:
        shared = context.broadcast(next(_blocks(benchmark, 1, window)))
        rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        return rows.mapInArrow(lambda batches: _scan(*shared.value, batches), _SCANNED_DDL).select("doc_id", "n_words", "n_hit", "items")
    keyed = numbered(documents.select("doc_id", "text"), "_row")  # rows of one id stay apart
    key = keyed.schema["_row"].dataType.simpleString()
    united = None
    for block in _blocks(benchmark, n, window):
        shared = context.broadcast(block)
        found = keyed.select("_row", "text").mapInArrow(lambda batches, s=shared: _scan(*s.value, batches), _SCANNED_DDL.replace("doc_id long", f"doc_id {key}"))
        found = materialize(found if united is None else found.where("n_hit > 0"), "hits")
        united = found if united is None else united.unionByName(found)
        shared.destroy()
    merged = united.groupBy(F.col("doc_id").alias("_row")).agg(
        F.max("n_words").alias("n_words"),
        _union_size(F.array_sort(F.flatten(F.collect_list("ranges")))).alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return keyed.select("_row", "doc_id").join(merged, "_row").select("doc_id", "n_words", "n_hit", "items")


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words, and one at least, are inside occurrences."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontaminate(documents: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``documents`` that aren't contaminated, with all their columns.

    Where the benchmark is a single block, rows are kept or dropped as they are read, and nothing is shuffled.
    """
    n = _parts(benchmark, block_bytes)
    if n > 1:
        keyed = numbered(documents, "_row")
        hits = find_hits(keyed.select(F.col("_row").alias("doc_id"), "text"), benchmark, block_bytes=block_bytes)
        bad = hits.where(contaminated(F.col("n_hit"), F.col("n_words"))).select(F.col("doc_id").alias("_row"))
        return keyed.join(bad, "_row", "left_anti").select(*documents.columns)
    shared = documents.sparkSession.sparkContext.broadcast(next(_blocks(benchmark, 1))[0])

    def clean(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        low = lower_ascii(buf)
        starts, ends, first = word_spans(_IS_WORD[low], offsets)
        at, which = shared.value.search(low, starts, ends, first)
        edges = np.zeros(len(starts) + 1, np.int64)
        np.add.at(edges, at, 1)
        np.add.at(edges, at + shared.value.sizes[which], -1)
        hit = np.concatenate([[0], np.cumsum(np.cumsum(edges[:-1]) > 0)])
        n_hit, n_words = np.diff(hit[first]), np.diff(first)
        return ~((n_hit > 0) & (20 * n_hit >= n_words))

    return kept_rows(documents, clean)


def report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of :func:`find_hits`."""
    return find_hits(documents, benchmark).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def items_digest(items: list[str]) -> str:
    """What ``items_sha256`` is for a list of ids."""
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
