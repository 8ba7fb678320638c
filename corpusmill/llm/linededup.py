"""Line de-duplication by an exact set-similarity join.

A line's tokens are its distinct words, A-Z lower-cased. Two lines match if the Jaccard similarity of
their token sets is 0.8 or more; a line goes if any line before it, in the order of doc_id and line
number, matches it. Lines of equal sets are one class, and only classes are joined:

  * texts are read once: first lines of classes, the frequencies of tokens and the numbers of lines come from one pass and one shuffle;
  * tokens are ordered by rarity. Frequencies are counted over all lines, in a table of fixed size that is
    indexed by the token's hash; any order that all lines share gives right results, and a rare-first one short lists;
  * matching sets share a token of their prefixes (a shorter one for the smaller set), so classes meet by prefix token; length and
    positional filters, and a parity sketch that bounds the symmetric difference, leave few pairs. A sketch has 64 bits, and
    twice as many for each doubling of a set over 96 tokens; a wide one folds into a narrow one;
  * prefix tokens travel in packed blocks, a row for a bucket of tokens, not a row for each token. A bucket with more than ``HOT`` entries, known
    from the stored blocks, is split in shards that meet pair by pair; tasks hold a bucket or a pair of shards at a time;
  * each class first has its nearest pairs verified on the words themselves. Classes that have more pairs and
    no match yet then have all their pairs verified, so that a large group of near copies does not
    give all its pairs, and no match is lost.

Lines are one class if two 64-bit sums over their distinct words and the number of these agree; the words of members are not
compared again. A link between different classes is only made on the words themselves.

Defined results:
  * a text of any length is read whole, and so is a line; a null text is the empty text, of one empty line; a line without words is always kept and matches nothing;
  * rows of one doc_id count as one place: lines of equal sets at equal places are both kept or both go;
  * a null doc_id comes before all others; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import RollingHash, lower_ascii, mix, release, runs, word_spans
from corpusmill.operators.ngrams import small
from corpusmill.scratch import materialize

THRESHOLD = (4, 5)  # the similarity as a fraction: comparisons stay in whole numbers
COUNT_BITS, COUNT_BLOCK = 20, 1 << 14
HOT = 20_000
#: So many of a class's pairs, the nearest, are verified first.
FIRST = 4
#: Tokens of open classes are sent to the scan that looks for them while there are no more; beyond, they are joined.
SENT_TOKENS = 1_000_000
#: Lists of no more classes are compared as a whole; longer ones in blocks of ``BLOCK`` against ``STEP``, until each class has more than ``FIRST`` pairs.
LARGE, BLOCK, STEP = 2048, 512, 2048
PAIRS = 1 << 20
#: Postings of about so many go to a bucket; a worker packs so many at a time, in rows of at most so many; groups are joined up to so many.
PER_BUCKET, FLUSH, PER_ROW, GROUPED = 16_384, 1 << 20, 4096, 1 << 16

#: Bits for each end of a pair, in the table that tells which classes have one, and the number of bits of its greatest index (32 MB).
ENDS_ROOM, ENDS_BITS = 16, 28

#: The place of documents without an id: before all others.
_NO_ID = -(1 << 63)


def _is_word(buf: np.ndarray) -> np.ndarray:
    """A flag for each byte that isn't a space or one of the bytes 9 to 13."""
    return (buf != 32) & (buf - np.uint8(9) > 4)


def _lines(buf: np.ndarray, offsets: np.ndarray) -> tuple:
    """Distinct tokens of each line, and the lines: (token hash, line) pairs sorted by line, line starts and ends, their text and number."""
    low = lower_ascii(buf)
    starts, ends, _ = word_spans(_is_word(low), offsets)
    newlines = np.flatnonzero(buf == 10)
    # Line edges: each text's begin, and behind each newline; a text has a line more than newlines.
    line_start = np.sort(np.concatenate([offsets[:-1], newlines + 1]), kind="stable")
    owner = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, newlines, side="right") - 1])
    owner = owner[np.argsort(np.concatenate([offsets[:-1], newlines + 1]), kind="stable")]
    # An empty text begins where the next one does: sort by text, then by place.
    rank = np.lexsort((line_start, owner))
    line_start, owner = line_start[rank], owner[rank]
    line_end = np.concatenate([line_start[1:], [len(buf)]]) if len(line_start) else line_start
    last = np.concatenate([owner[1:] != owner[:-1], [True]]) if len(owner) else np.zeros(0, bool)
    line_end = np.where(last, offsets[1:][owner], line_end - 1)
    number = np.arange(len(owner)) - np.searchsorted(owner, owner, side="left")
    # Lines of empty texts hold no words and share their place with others: words go to the last line that begins at or before them.
    line = np.searchsorted(line_start, starts, side="right") - 1
    h = RollingHash(low).of(starts, ends)
    by = _by_line(line, h)
    h, line = h[by], line[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    return h[new], line[new], line_start, line_end, owner, number


def _by_line(line: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The order by line, then by a number of each token: a single sort where both fit 64 bits."""
    bits = max(int(line[-1]).bit_length() if len(line) else 0, 1)
    return np.argsort((line.astype(np.uint64) << np.uint64(64 - bits)) | (h >> np.uint64(bits)))


def _rare_first(line: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The order by line, then by count; what is equal stays in its order. Where all three fit 64 bits, numbers that end in their place are sorted, not places."""
    n = len(line)
    bits = [max(int(x).bit_length(), 1) for x in ((line[-1], count.max(), n - 1) if n else (0, 0, 0))]
    if sum(bits) > 64:
        return np.lexsort((count, line))
    key = (line.astype(np.uint64) << np.uint64(bits[1])) | count.astype(np.uint64)
    return (np.sort((key << np.uint64(bits[2])) | np.arange(n, dtype=np.uint64)) & np.uint64((1 << bits[2]) - 1)).astype(np.int64)


def _bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNT_BITS)).astype(np.int64)


def _sum_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.frombuffer(n, np.uint32).astype(np.int64)
            total[block] = total[block] + own if block in total else own
    yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], names=["block", "n"])


def rarity(table: DataFrame) -> np.ndarray:
    """Lines that have the tokens of each bucket: a table of fixed size, from all texts. Parts are summed by block, in a stream."""
    parts = table.where(F.col("n") == _COUNTS).select(F.col("l").alias("block"), F.col("line").alias("n"))
    out = np.zeros(1 << COUNT_BITS, np.int64)
    for r in parts.repartition("block").mapInArrow(_sum_rows, "block int, n binary").toLocalIterator():
        out[r["block"] * COUNT_BLOCK : (r["block"] + 1) * COUNT_BLOCK] = np.frombuffer(r["n"], np.int64)
    return np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


def prefix_size(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n of which a matching set must have one."""
    p, q = THRESHOLD
    return n - -(-n * p // q) + 1


def index_size(n: np.ndarray) -> np.ndarray:
    """Tokens of a set of n of which a matching set that is no smaller must have one among its ``prefix_size`` first."""
    p, q = THRESHOLD
    return n - -(-2 * n * p // (p + q)) + 1


_LINES = pa.schema([("d", pa.int64()), ("l", pa.int32()), ("n", pa.int32()), ("sig", pa.int64()), ("k", pa.int64()), ("line", pa.large_binary())])
_LINES_DDL = "d long, l int, n int, sig long, k long, line binary"


#: Rows of :func:`classes` that are no class, by their ``n``: counts of tokens, and packed numbers of lines.
_COUNTS, _DOCUMENTS = -1, -2


class _Tally:
    """What a task counts beside its lines: lines with a token, by the token's bucket, and documents' numbers of lines."""

    def __init__(self):
        self.tokens = np.zeros(1 << COUNT_BITS, np.uint32)
        self.documents: list[tuple[np.ndarray, ...]] = []

    def add(self, doc_id: pa.Array, h: np.ndarray, n: np.ndarray, owner: np.ndarray) -> None:
        self.tokens += np.bincount(_bucket(h), minlength=len(self.tokens)).astype(np.uint32)
        total = np.bincount(owner, minlength=len(doc_id))
        blank = np.bincount(owner[n == 0], minlength=len(doc_id))
        null = doc_id.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        self.documents.append((doc_id.fill_null(0).to_numpy(zero_copy_only=False), null, total.astype(np.int64), blank.astype(np.int64)))

    def document_rows(self, part: int, run: int) -> pa.RecordBatch:
        """One row of all documents seen since the last one: ids, whether they are null, lines and blank lines, as arrays one after another."""
        payload = b"".join(np.concatenate(x).astype("<i8").tobytes() for x in zip(*self.documents, strict=True))
        self.documents.clear()
        return pa.record_batch([pa.array([x], f.type) for x, f in zip((0, 0, _DOCUMENTS, part, run, payload), _LINES, strict=True)], schema=_LINES)

    def count_rows(self, part: int) -> pa.RecordBatch:
        """A row for each block of buckets that occur."""
        blocks = self.tokens.reshape(-1, COUNT_BLOCK)
        some = np.flatnonzero(blocks.any(axis=1))
        n = len(some)
        columns = (np.zeros(n, np.int64), some.astype(np.int32), np.full(n, _COUNTS, np.int32), some.astype(np.int64), np.full(n, part, np.int64), [blocks[k].tobytes() for k in some.tolist()])
        return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, _LINES, strict=True)], schema=_LINES)


def _line_rows(batches: Iterator[pa.RecordBatch], tally: _Tally | None = None) -> Iterator[pa.RecordBatch]:
    """A row for each line that has words."""
    for batch in batches:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        for a, b, buf, offsets in runs(batch.column(1)):
            h, line, line_start, line_end, owner, number = _lines(buf, offsets)
            n = np.bincount(line, minlength=len(line_start))
            if tally:
                tally.add(batch.column(0).slice(a, b - a), h, n, owner)
            some = np.flatnonzero(n)
            if not len(some):
                continue
            begin = np.cumsum(n[some]) - n[some]
            # Signature and parity sketch do not depend on the tokens' order.
            sig = np.add.reduceat(mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), begin)
            sketch = np.bitwise_xor.reduceat(np.uint64(1) << (mix(h + np.uint64(77)) >> np.uint64(58)), begin)
            data = buf.tobytes()
            text = pa.array([data[x:y] for x, y in zip(line_start[some].tolist(), line_end[some].tolist(), strict=True)], pa.large_binary())
            yield pa.record_batch([pa.array(ids[a + owner[some]]), pa.array(number[some].astype(np.int32)), pa.array(n[some].astype(np.int32)), pa.array(sig.view(np.int64)), pa.array(sketch.view(np.int64)), text], schema=_LINES)


def _first_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of lines; at times one of documents; and last the task's counts of tokens. Their keys are theirs alone."""
    from pyspark import TaskContext

    part, tally = TaskContext.get().partitionId(), _Tally()
    for run, batch in enumerate(batches):
        yield from _line_rows(iter([batch]), tally)
        if tally.documents:
            yield tally.document_rows(part, run)
    yield tally.count_rows(part)
    release()


def classes(documents: DataFrame) -> DataFrame:
    """(d, l, k, n, line): the first line of each distinct set of tokens. Rows of negative ``n`` are :func:`rarity`'s and :func:`counted`'s."""
    lines = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_first_rows, _LINES_DDL)
    first = lines.groupBy("sig", "k", "n").agg(F.min(F.struct("d", "l", "line")).alias("first"))
    return materialize(first.select("first.d", "first.l", "k", "n", "first.line"), "line-classes", compression="zstd")


_COUNTED = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_blank", pa.int64())])


def _counted_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for payload in batch.column(0).to_pylist():
            ids, null, total, blank = np.frombuffer(payload, "<i8").reshape(4, -1)
            yield pa.record_batch([pa.array(ids, mask=null.astype(bool)), pa.array(total), pa.array(blank)], schema=_COUNTED)


def counted(table: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_blank) of each row of documents."""
    return table.where(F.col("n") == _DOCUMENTS).select("line").mapInArrow(_counted_rows, "doc_id long, n_lines long, n_blank long")


_POSTINGS = pa.schema([("token", pa.int64()), ("d", pa.int64()), ("l", pa.int32()), ("k", pa.int64()), ("n", pa.int32()), ("at", pa.int32()), ("wide", pa.list_(pa.int64()))])
_POSTINGS_DDL = "token long, d long, l int, k long, n int, at int, wide array<long>"
#: Sets of no more tokens have a sketch of 64 bits; sketches double at most so often.
NARROW, LEVELS = 96, 5


def _level(n: np.ndarray) -> np.ndarray:
    """How often the sketch of a set of n tokens is doubled."""
    return np.clip(np.ceil(np.log2(np.maximum(n, NARROW) / NARROW)), 0, LEVELS).astype(np.int64)


def _wide_sketches(h: np.ndarray, line: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of all lines as words, one after another, and where each line's begin; none for a sketch of 64 bits.

    A token's bit is the same modulo any smaller sketch's size, so a sketch's halves together are the smaller one.
    """
    level = _level(n)
    words = np.where(level > 0, 1 << level, 0)
    at = np.concatenate([[0], np.cumsum(words)])
    out = np.zeros(at[-1], np.uint64)
    mine = level[line] > 0
    h, line = h[mine], line[mine]
    bit = mix(h + np.uint64(99)) & ((np.uint64(64) << level[line].astype(np.uint64)) - np.uint64(1))
    np.bitwise_xor.at(out, at[line] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, at


def _posting_rows(counts: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in runs(batch.column(4)):
            low = lower_ascii(buf)
            starts, ends, _ = word_spans(_is_word(low), offsets)
            line = np.searchsorted(offsets, starts, side="right") - 1
            h = RollingHash(low).of(starts, ends)
            by = _by_line(line, h)
            h, line = h[by], line[by]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
            h, line = h[new], line[new]
            # Rare first; tokens of equal counts in the order of their hashes, which all lines share.
            rank = _rare_first(line, counts[_bucket(h)])
            n = np.bincount(line, minlength=b - a)
            size = np.where(n > 0, prefix_size(n), 0)
            at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            of = np.repeat(np.arange(b - a), size)
            token = h[rank][np.repeat(np.cumsum(n) - n, size) + at]
            words, begin = _wide_sketches(h, line, n)
            width = np.diff(begin)[of]
            edges = np.concatenate([[0], np.cumsum(width)])
            flat = words[np.arange(edges[-1]) + np.repeat(begin[of] - edges[:-1], width)].view(np.int64)
            wide = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(flat))
            columns = [token.view(np.int64), *(batch.column(c).slice(a, b - a).to_numpy(zero_copy_only=False)[of] for c in range(4)), at.astype(np.int32)]
            yield pa.record_batch([*(pa.array(c) for c in columns), wide], schema=_POSTINGS)


_FIXED = (("token", np.uint32), ("d", np.int64), ("k", np.int64), ("l", np.int32), ("n", np.int32), ("at", np.int32))
_BLOCKS = pa.schema([("bucket", pa.int32()), ("m", pa.int32()), ("payload", pa.binary())])
_BLOCKS_DDL = "bucket int, m int, payload binary"


def _posting_blocks(counts: np.ndarray, bits: int, flush: int, rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings packed by the first ``bits`` of their token: arrays one after another, then sketches, whose widths follow from the sizes.

    Of an array's numbers all first bytes come first, then all second ones, and so on: most are zero and compress away. A token is its bucket
    and its last 32 bits; two tokens that are one by these only meet in vain.
    """
    held: list[pa.RecordBatch] = []
    total = 0

    def packed() -> Iterator[pa.RecordBatch]:
        columns = {c: np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c, _ in _FIXED}
        words, begin = _joined_sketches(held)
        held.clear()
        bucket = (columns["token"].view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)
        columns["token"] = columns["token"].astype(np.uint32)
        by = np.argsort(bucket, kind="stable")
        columns = {c: x[by] for c, x in columns.items()}
        width = np.diff(begin)[by]
        upto = np.concatenate([[0], np.cumsum(width)])
        words = words[np.arange(upto[-1]) + np.repeat(begin[:-1][by] - upto[:-1], width)] if upto[-1] else words[:0]
        bucket = bucket[by]
        edges = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1], [True]]))
        starts = np.concatenate([np.arange(a, b, rows) for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)])
        ends = np.append(starts[1:], len(bucket))
        names, payloads = bucket[starts].astype(np.int32), []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            payloads.append(b"".join([columns[c][a:b].view(np.uint8).reshape(b - a, -1).T.tobytes() for c, _ in _FIXED]) + words[upto[a] : upto[b]].tobytes())
        for k in range(0, len(payloads), 1 << 14):
            part = slice(k, k + (1 << 14))
            yield pa.record_batch([pa.array(names[part]), pa.array((ends - starts)[part].astype(np.int32)), pa.array(payloads[part], pa.binary())], schema=_BLOCKS)

    for batch in _posting_rows(counts, batches):
        held.append(batch)
        total += batch.num_rows
        if total >= flush:
            yield from packed()
            total = 0
    if held:
        yield from packed()
    release()


def _joined_sketches(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Sketches of all batches' rows as words, and where each row's begin and the last one ends."""
    words, begin, total = [np.empty(0, np.int64)], [np.zeros(1, np.int64)], 0
    for batch in batches:
        wide = batch.column("wide")
        edges = wide.offsets.to_numpy().astype(np.int64)
        words.append(wide.values.to_numpy(zero_copy_only=False)[edges[0] : edges[-1]])
        begin.append(edges[1:] - edges[0] + total)
        total += int(edges[-1] - edges[0])
    return np.concatenate(words), np.concatenate(begin)


def _unpacked(bucket: int, m: int, payload: bytes) -> tuple[dict[str, np.ndarray], np.ndarray]:
    out, at = {}, 0
    for c, t in _FIXED:
        size = np.dtype(t).itemsize
        out[c] = np.frombuffer(payload, np.uint8, m * size, at).reshape(size, m).T.copy().view(t).ravel()
        at += m * size
    out["token"] = out["token"].astype(np.int64) | np.int64(bucket << 32)
    return out, np.frombuffer(payload, np.int64, -1, at)


def _chosen(wanted: np.ndarray | None, batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """(bucket, rows, payload, flags of the wanted rows) of the blocks that have some; tokens of all blocks of a batch are looked up together."""
    buckets, sizes, payloads = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
    if wanted is None:
        yield from zip(buckets, sizes, payloads, (np.ones(m, bool) for m in sizes), strict=True)
        return
    first = np.array(buckets, np.int64) << 32
    low, high = np.searchsorted(wanted, first), np.searchsorted(wanted, first + (1 << 32))
    some = np.flatnonzero(low < high).tolist()
    if not some:
        return
    own = [np.frombuffer(payloads[i], np.uint8, 4 * sizes[i]).reshape(4, -1).T.copy().view(np.uint32).ravel() for i in some]
    edges = np.concatenate([[0], np.cumsum([len(x) for x in own])])
    tokens = np.concatenate(own).astype(np.int64) | np.repeat(first[some], np.diff(edges))
    flags = wanted[np.minimum(np.searchsorted(wanted, tokens), len(wanted) - 1)] == tokens
    for i, a, b in zip(some, edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        if flags[a:b].any():
            yield buckets[i], sizes[i], payloads[i], flags[a:b]


def _unpacked_rows(wanted: np.ndarray | None, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the postings in blocks, those of wanted tokens if a sorted array is given: of a block, first its tokens are looked at."""
    fields = [f.name for f in _POSTINGS if f.name != "wide"]
    for batch in batches:
        held: list[list[np.ndarray]] = [[] for _ in fields]
        widths, flat = [], []
        for bucket, m, payload, chosen in _chosen(wanted, batch):
            columns, words = _unpacked(bucket, m, payload)
            width = np.where((level := _level(columns["n"])) > 0, 1 << level, 0)
            widths.append(width[chosen])
            flat.append(words[np.repeat(chosen, width)])
            for own, c in zip(held, fields, strict=True):
                own.append(columns[c][chosen])
        if widths:
            edges = np.concatenate([[0], np.cumsum(np.concatenate(widths))])
            wide = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(np.concatenate(flat)))
            yield pa.record_batch([*(pa.array(np.concatenate(x)) for x in held), wide], schema=_POSTINGS)
    release()


_PAIRS = pa.schema([*((f"{c}{i}", t) for i in (1, 2) for c, t in (("d", pa.int64()), ("l", pa.int32()), ("k", pa.int64()))), ("more", pa.bool_())])
_PAIRS_DDL = "d1 long, l1 int, k1 long, d2 long, l2 int, k2 long, more boolean"


class _Lists:
    """Classes that share prefix tokens; finds pairs (later, earlier) that pass all filters."""

    def __init__(self, token: np.ndarray, d: np.ndarray, l_: np.ndarray, k: np.ndarray, n: np.ndarray, at: np.ndarray, probe: np.ndarray, wide: tuple[np.ndarray, np.ndarray], limits: tuple[int, int, int] | None = None):
        self.large, self.block, self.step = limits or (LARGE, BLOCK, STEP)
        by = np.lexsort((n, token))
        words, begin = wide
        level = _level(n)[by]
        # Of each level, the members' sketches as a matrix, and folded once; `row` is a member's row in its level's matrix.
        self.level, self.row, self.sketches, self.folded = level, np.zeros(len(by), np.int64), {}, {}
        for e in range(1, LEVELS + 1):
            mine = np.flatnonzero(level == e)
            self.row[mine] = np.arange(len(mine))
            own = words[begin[by[mine]][:, None] + np.arange(1 << e)[None]].view(np.uint64)
            self.sketches[e], self.folded[e] = own, own[:, : 1 << (e - 1)] ^ own[:, 1 << (e - 1) :]
        self.token, self.d, self.l, self.k, self.n, self.at, self.probe = (x[by] for x in (token, d, l_, k.view(np.uint64), n.astype(np.int64), at.astype(np.int64), probe))
        self.index = self.at < index_size(self.n)
        order = np.lexsort((self.k, self.l, self.d))
        same = np.concatenate([[False], (self.d[order][1:] == self.d[order][:-1]) & (self.l[order][1:] == self.l[order][:-1])])
        self.place = np.empty(len(order), np.int64)  # equal for equal places
        self.place[order] = np.cumsum(~same)
        self.edges = np.flatnonzero(np.concatenate([[True], self.token[1:] != self.token[:-1], [True]]))

    def _kept(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs whose sizes can match, i's the smaller: (later, earlier) of those that pass the other filters."""
        p, q = THRESHOLD
        n, m = self.n[i], self.n[j]
        need = -(-(n + m) * p // (p + q))
        ok = (np.bitwise_count(self.k[i] ^ self.k[j]) <= n + m - 2 * need) & self.index[i]
        i, j, n, m, need = i[ok], j[ok], n[ok], m[ok], need[ok]
        ok = np.minimum(n - self.at[i], m - self.at[j]) >= need
        i, j, n, m, need = i[ok], j[ok], n[ok], m[ok], need[ok]
        far = np.zeros(len(i), np.int64)
        a, b = self.level[i], self.level[j]  # i is the smaller: its sketch is as wide or half as wide
        for e in range(1, LEVELS + 1):
            for of, right in ((b == e, self.sketches[e]), (b == e + 1, self.folded.get(e + 1))):
                some = np.flatnonzero((a == e) & of)
                if len(some):
                    far[some] = np.bitwise_count(self.sketches[e][self.row[i[some]]] ^ right[self.row[j[some]]]).sum(axis=1)
        ok = far <= n + m - 2 * need
        i, j = i[ok], j[ok]
        swap = self.place[i] < self.place[j]
        later, earlier = np.where(swap, j, i), np.where(swap, i, j)
        ok = (self.place[i] != self.place[j]) & self.probe[later]
        return later[ok], earlier[ok]

    def pairs(self, everything: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Members are sorted by size: each meets those behind it, up to the greatest size that can match."""
        p, q = THRESHOLD
        low, high = self.edges[:-1], self.edges[1:]
        group = np.repeat(np.arange(len(low)), high - low)
        wide = int(self.n.max()) * q // p + 2
        upper = np.searchsorted(group * wide + self.n, group * wide + self.n * q // p, side="right")
        large = np.repeat((high - low) > self.large, high - low) & (not everything)
        mine = np.arange(len(group))
        count = np.where(large | ~self.index, 0, upper - mine - 1)
        upto = np.cumsum(count)
        a = 0
        while a < len(mine):
            b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + PAIRS, side="right")))
            c = count[a:b]
            if c.sum():
                i = np.repeat(mine[a:b], c)
                yield self._kept(i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(c) - c, c))
            a = b
        for lo, hi in zip(low[high - low > self.large].tolist(), high[high - low > self.large].tolist(), strict=True) if not everything else ():
            yield from self._large(lo, hi, upper)

    def _large(self, lo: int, hi: int, upper: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Blocks of a long list against the members around them, near sizes first.

        A class is left once it has more than ``FIRST`` pairs, no earlier: only then is it marked to have more, and sought again as a whole.
        """
        block, step = self.block, self.step
        found = np.zeros(hi - lo, np.int64)
        lower = np.searchsorted(upper[lo:hi], np.arange(lo, hi), side="right") + lo  # the first whose sizes reach a member
        for a in range(lo, hi, block):
            mine = np.arange(a, min(a + block, hi))
            from_, to = int(lower[a - lo]), int(upper[mine[-1]])
            for c in sorted(range(from_, to, step), key=lambda c: abs(c + step // 2 - a)):
                mine = mine[(found[mine - lo] <= FIRST) & self.probe[mine]]
                if not len(mine):
                    break
                others = np.arange(c, min(c + step, to))
                x, y = np.repeat(mine, len(others)), np.tile(others, len(mine))
                i, j = np.minimum(x, y), np.maximum(x, y)
                ok = (i != j) & (j < upper[i])
                later, earlier = self._kept(i[ok], j[ok])
                found += np.bincount(later - lo, minlength=hi - lo)
                yield later, earlier


def _pair_partition(everything: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among postings given as rows."""
    held = list(batches)
    if sum(x.num_rows for x in held):
        words, begin = _joined_sketches(held)
        columns = [np.concatenate([x.column(c).to_numpy(zero_copy_only=False) for x in held]) for c in ("token", "d", "l", "k", "n", "at", "probe")]
        yield from _pair_rows(_Lists(*columns, (words, begin)), everything)


def _pair_blocks(limits: tuple[int, int, int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs among postings in blocks, which come by group: groups are joined until they are worth a pass, and only one of that size is held."""
    held: dict[str, list[np.ndarray]] = {c: [] for c, _ in _FIXED}
    sketches, total, last = [], 0, None

    def pairs() -> Iterator[pa.RecordBatch]:
        columns = {c: np.concatenate(x) for c, x in held.items()}
        level = _level(columns["n"])
        begin = np.concatenate([[0], np.cumsum(np.where(level > 0, 1 << level, 0))])
        lists = _Lists(*(columns[c] for c in ("token", "d", "l", "k", "n", "at")), np.ones(len(begin) - 1, bool), (np.concatenate(sketches), begin), limits)
        yield from _pair_rows(lists, False)
        for x in held.values():
            x.clear()
        sketches.clear()

    for batch in batches:
        for group, sharded, bucket, m, payload in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if group != last and total >= GROUPED:
                yield from pairs()
                total = 0
            last = group
            columns, words = _unpacked(bucket, m, payload)
            for c, x in columns.items():
                # A token's lists in different pairs of shards stay apart.
                held[c].append(x ^ np.int64(group) if sharded and c == "token" else x)
            sketches.append(words)
            total += m
    if total:
        yield from pairs()
    release()


def _pair_rows(lists: _Lists, everything: bool) -> Iterator[pa.RecordBatch]:
    def rows(i: np.ndarray, j: np.ndarray, more: np.ndarray) -> pa.RecordBatch:
        own = [x for y in (i, j) for x in (lists.d[y], lists.l[y], lists.k[y].view(np.int64))]
        return pa.record_batch([pa.array(x) for x in (*own, more)], schema=_PAIRS)

    if everything:
        for i, j in lists.pairs(True):
            if len(i):
                yield rows(i, j, np.zeros(len(i), bool))
        return
    # Of each class, the nearest pairs: by distance of sketches, then the earliest.
    held_i, held_j, seen = (np.empty(0, np.int64) for _ in range(3))
    for i, j in lists.pairs(False):
        if not len(i):
            continue
        n = np.concatenate([seen, np.ones(len(i), np.int64)])
        i, j = np.concatenate([held_i, i]), np.concatenate([held_j, j])
        far = np.bitwise_count(lists.k[i] ^ lists.k[j]).astype(np.int64)
        by = np.lexsort((lists.place[j], far, lists.k[i], lists.place[i]))
        i, j, n = i[by], j[by], n[by]
        new = np.concatenate([[True], (lists.place[i][1:] != lists.place[i][:-1]) | (lists.k[i][1:] != lists.k[i][:-1])])
        first = np.flatnonzero(new)
        size = np.diff(np.append(first, len(i)))
        rank = np.arange(len(i)) - np.repeat(first, size)
        # What isn't held any more counts with the last pair that is.
        total = np.add.reduceat(n, first)
        keep = rank < FIRST
        seen = np.ones(len(i), np.int64)
        last = first + np.minimum(size, FIRST) - 1
        seen[last] = total - (np.minimum(size, FIRST) - 1)
        held_i, held_j, seen = i[keep], j[keep], seen[keep]
    if len(held_i):
        yield rows(held_i, held_j, seen > 1)


def _words(line: bytes) -> frozenset[bytes]:
    return frozenset(line.lower().split())


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    p, q = THRESHOLD
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            x, y = _words(a), _words(b)
            common = len(x & y)
            keep.append(common * q >= (len(x) + len(y) - common) * p)
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch([c.filter(mask) for c in batch.columns[2:]], names=["d", "l", "k"])


def _paired(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(d, l, k, line) of the classes that occur in pairs, and of few others: lines of classes without a pair needn't travel to be compared.

    A bit table of at most ``ENDS_BITS`` bits, indexed by the hash of a class's keys, tells them; what it lets pass in vain, joins drop.
    """
    ends = pairs.select(F.explode(F.array(*[F.xxhash64(f"d{i}", f"l{i}", f"k{i}") for i in (1, 2)])).alias("h"))
    bits = min(max((ends.count() * ENDS_ROOM).bit_length(), 15), ENDS_BITS)
    place = ends.select(F.shiftrightunsigned("h", 64 - bits).alias("at"))
    blocks = place.groupBy(F.shiftright("at", 15).alias("block")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(0x7FFF))).alias("bits"))
    found = np.zeros(1 << (bits - 3), np.uint8)
    for r in blocks.collect():
        found[r["block"] << 12 : (r["block"] + 1) << 12] = np.frombuffer(r["bits"], np.uint8)
    sent = table.sparkSession.sparkContext.broadcast(found)

    @F.pandas_udf("boolean")
    def occurs(h: pd.Series) -> pd.Series:
        at = h.to_numpy().view(np.uint64) >> np.uint64(64 - bits)
        return pd.Series((sent.value[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return table.where("n > 0").where(occurs(F.xxhash64("d", "l", "k"))).select("d", "l", "k", "line")


def _verified(pairs: DataFrame, table: DataFrame) -> DataFrame:
    """(d, l, k) of the classes that have a match among their pairs."""
    keys = ("d", "l", "k")
    texts = materialize(_paired(pairs, table), "line-ends", compression="zstd")  # stored: both ends of pairs are joined with it, and the scan is the greater work
    for i in (1, 2):
        pairs = pairs.join(texts.select(*[F.col(c).alias(f"{c}{i}") for c in keys], F.col("line").alias(f"line{i}")), [f"{c}{i}" for c in keys])
    rows = pairs.select("line1", "line2", *[F.col(f"{c}1").alias(c) for c in keys])
    return rows.mapInArrow(_verify, "d long, l int, k long").distinct()


def _matchable(table: DataFrame) -> DataFrame:
    """Classes that can match others: smaller sets match their equals only."""
    p, q = THRESHOLD
    return table.where(F.col("n") * (q - p) >= p).select("d", "l", "k", "n", "line")


def _blocks(table: DataFrame, counts) -> tuple[DataFrame, int]:
    """Packed postings of all prefix tokens, stored, and the number of buckets' bits."""
    p, q = THRESHOLD
    rows = _matchable(table)
    total = rows.agg(F.sum(F.col("n") - F.ceil(F.col("n") * p / q) + 1).alias("n")).first()["n"] or 0
    bits = min(max(int(total // PER_BUCKET).bit_length(), 4), 24)
    return materialize(rows.mapInArrow(lambda batches: _posting_blocks(counts.value, bits, FLUSH, PER_ROW, batches), _BLOCKS_DDL), "line-blocks", compression="zstd"), bits


def _grouped(blocks: DataFrame, hot: int) -> DataFrame:
    """(group, sharded, bucket, m, payload): blocks by bucket; those of hot buckets once for each pair of shards that theirs is in."""
    sizes = blocks.groupBy("bucket").agg(F.sum("m").alias("n")).where(F.col("n") > hot)
    large = materialize(sizes.select("bucket", F.ceil(F.col("n") / hot).cast("int").alias("shards")), "line-hot")
    if large.isEmpty():
        return blocks.select(F.col("bucket").cast("long").alias("group"), F.lit(False).alias("sharded"), "bucket", "m", "payload")
    rows = blocks.join(small(large), "bucket", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
    own = F.pmod(F.xxhash64("m", F.substring("payload", 1, 256)), F.col("shards")).cast("int")
    rows = rows.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
    group = F.when(F.col("shards") == 1, F.col("bucket").cast("long")).otherwise(F.xxhash64("bucket", F.least("own", "other"), F.greatest("own", "other")))
    return rows.select(group.alias("group"), (F.col("shards") > 1).alias("sharded"), "bucket", "m", "payload")


def _met(postings: DataFrame, everything: bool, hot: int) -> DataFrame:
    """Pairs of classes that share a prefix token and pass the filters, from postings as rows."""
    large = materialize(postings.groupBy("token").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > hot).select("token", F.ceil(F.col("m") / hot).cast("int").alias("shards")), "line-hot")
    if not large.isEmpty():
        rows = postings.join(large, "token", "left").withColumn("shards", F.coalesce("shards", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("d", "l", "k"), F.col("shards")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        postings = rows.withColumn("token", F.when(F.col("shards") == 1, F.col("token")).otherwise(F.xxhash64("token", F.least("own", "other"), F.greatest("own", "other"))))
    rows = postings.select("token", "d", "l", "k", "n", "at", "probe", "wide").repartition("token")
    return rows.mapInArrow(lambda batches: _pair_partition(everything, batches), _PAIRS_DDL)


def matched_classes(table: DataFrame, counts, hot: int = HOT, limits: tuple[int, int, int] = (LARGE, BLOCK, STEP), sent: int = SENT_TOKENS) -> DataFrame:
    """(d, l, k) of the classes that an earlier class matches.

    ``limits`` are the sizes of lists and blocks in the first pass; beyond ``sent`` tokens, those of open classes are joined, not sent.
    """
    keys = ["d", "l", "k"]
    blocks, bits = _blocks(table, counts)
    grouped = _grouped(blocks, hot).repartition("group").sortWithinPartitions("group")
    pairs = materialize(grouped.mapInArrow(lambda batches: _pair_blocks(limits, batches), _PAIRS_DDL), "line-pairs")
    distinct = pairs.select("d1", "l1", "k1", "d2", "l2", "k2").distinct()
    found = materialize(_verified(distinct, table), "line-matched")
    several = pairs.groupBy(*[F.col(f"{c}1").alias(c) for c in keys]).agg(F.max("more").alias("more")).where("more").drop("more")
    open_ = materialize(several.join(found, keys, "left_anti"), "line-open")
    if open_.isEmpty():
        return found
    probes = _matchable(table.join(open_, keys, "left_semi")).mapInArrow(lambda batches: _posting_rows(counts.value, batches), _POSTINGS_DDL)
    # What tells a token in blocks: its bucket and its last 32 bits.
    code = F.shiftleft(F.shiftrightunsigned("token", 64 - bits), 32).bitwiseOR(F.col("token").bitwiseAND(F.lit(0xFFFFFFFF)))
    tokens = materialize(probes.select(code.alias("token")).distinct(), "line-tokens")
    if tokens.count() <= sent:
        wanted = table.sparkSession.sparkContext.broadcast(np.sort(np.array([r["token"] for r in tokens.toLocalIterator()], np.int64)))
        near = blocks.mapInArrow(lambda batches: _unpacked_rows(wanted.value, batches), _POSTINGS_DDL)
    else:
        near = blocks.mapInArrow(lambda batches: _unpacked_rows(None, batches), _POSTINGS_DDL).join(tokens, "token", "left_semi")
    near = materialize(near.join(open_.withColumn("probe", F.lit(True)), keys, "left").withColumn("probe", F.coalesce("probe", F.lit(False))), "line-near")
    rest = materialize(_met(near, True, hot).drop("more").distinct(), "line-rest")
    return found.unionByName(_verified(rest, table))


def kept_lines(table: DataFrame) -> DataFrame:
    """(d, kept): numbers, from 0, of the lines with words that stay, of each document that has some; from :func:`classes`."""
    gone = matched_classes(table, table.sparkSession.sparkContext.broadcast(rarity(table)))
    stay = table.where("n > 0").select("d", "l", "k").join(gone, ["d", "l", "k"], "left_anti")
    return stay.groupBy("d").agg(F.array_sort(F.collect_set("l")).alias("kept"))


def report(documents: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_blank, n_kept, kept): how many lines a document has, how many have no words, and which of the others stay."""
    table = classes(documents)
    rows = counted(table).withColumn("d", F.coalesce("doc_id", F.lit(_NO_ID))).join(kept_lines(table), "d", "left")
    kept = F.coalesce("kept", F.array().cast("array<int>"))
    return rows.select("doc_id", "n_lines", "n_blank", F.size(kept).cast("long").alias("n_kept"), F.array_join(kept.cast("array<string>"), ",").alias("kept"))


def remove_repeated_lines(documents: DataFrame) -> DataFrame:
    """The documents, all columns kept, with the lines gone that an earlier line matches; lines without words stay."""
    kept = kept_lines(classes(documents)).withColumnRenamed("d", "_d").withColumnRenamed("kept", "_kept")
    rows = documents.withColumn("_d", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).join(kept, "_d", "left")
    stays = lambda line, i: F.array_contains(F.coalesce("_kept", F.array().cast("array<int>")), i) | ~line.rlike(r"[^\x20\x09-\x0D]")
    text = F.when(F.col("text").isNotNull(), F.array_join(F.filter(F.split("text", "\n", -1), stays), "\n"))
    return rows.withColumn("text", text).select(*documents.columns)
