"""Byte-level BPE: pre-tokenizer as a pattern, encoding of distinct pieces, decoding, training, vocabulary files."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import regex as re
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.scratch import materialize

_W = r" \t\n\r\f\x0B"
#: Contractions; all but the last of a run of spaces; a word, a number or marks with a space before; spaces.
PIECES = (
    rf"'(?:re|ve|ll|s|t|m|d)|[{_W}]+(?=[{_W}][^{_W}])|[{_W}]?[A-Za-z\x{{80}}-\x{{10FFFF}}]+|[{_W}]?[0-9]+"
    rf"|[{_W}]?[^{_W}A-Za-z0-9\x{{80}}-\x{{10FFFF}}]+|[{_W}]+"
)


#: The same in Python's syntax, for single texts.
PIECES_RE = PIECES.replace(r"\x{80}-\x{10FFFF}", "\x80-\U0010ffff")


def pieces(text: Column) -> Column:
    """The pieces of a text; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(PIECES), F.lit(0))


class Vocabulary:
    """Tokens by id, in the order of their merges, and special tokens. A lower id merges first."""

    def __init__(self, tokens: list[bytes], specials: dict[str, int] | None = None):
        self.tokens, self.specials = tokens, dict(specials or {})
        self.ids = {t: i for i, t in enumerate(tokens)}
        self._encoded = lru_cache(maxsize=1 << 18)(self._merge)

    def __reduce__(self):
        return Vocabulary, (self.tokens, self.specials)

    def __len__(self) -> int:
        return max([len(self.tokens), *(i + 1 for i in self.specials.values())])

    def _merge(self, piece: bytes) -> tuple[int, ...]:
        """Pairs merge by rank, the leftmost first; a heap of pairs, and links between parts that still stand."""
        n = len(piece)
        parts: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = lambda i: self.ids.get(parts[i] + parts[after[i]])
        heap = [(r, i, 2) for i in range(n - 1) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, size = heapq.heappop(heap)
            if parts[i] is None or after[i] >= n or len(parts[i]) + len(parts[after[i]]) != size or rank(i) != r:
                continue  # one of the two has merged since
            j = after[i]
            parts[i], parts[j] = parts[i] + parts[j], None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := rank(k)) is not None:
                    heapq.heappush(heap, (r, k, len(parts[k]) + len(parts[after[k]])))
        return tuple(self.ids[p] for p in parts if p is not None)

    def encode_piece(self, piece: str) -> tuple[int, ...]:
        return self._encoded(piece.encode())

    def decode(self, ids) -> str:
        names = {i: s.encode() for s, i in self.specials.items()}
        return b"".join(self.tokens[i] if i < len(self.tokens) else names.get(i, f"<unk:{i}>".encode()) for i in ids).decode("utf-8", "replace")

    def table(self, spark: SparkSession) -> DataFrame:
        """(id, token, kind): kind is byte, merge or special."""
        rows = [(i, t, "byte" if len(t) == 1 else "merge") for i, t in enumerate(self.tokens)]
        rows += [(i, s.encode(), "special") for s, i in self.specials.items()]
        return spark.createDataFrame(rows, "id int, token binary, kind string")

    def lines(self) -> list[str]:
        out = ["TOK", "V1", *(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(self.tokens)), "SPECIALS"]
        return out + [f"{base64.b64encode(s.encode()).decode()} {i}" for s, i in self.specials.items()]

    @classmethod
    def parse(cls, lines: list[str]) -> Vocabulary:
        """From the lines of a file; a banner and a version line may be missing."""
        body = [x for x in lines if x and x not in ("TOK", "V1")]
        cut = body.index("SPECIALS") if "SPECIALS" in body else len(body)
        pair = lambda x: (base64.b64decode(x.rsplit(" ", 1)[0]), int(x.rsplit(" ", 1)[1]))
        tokens = dict(map(reversed, map(pair, body[:cut])))
        return cls([tokens[i] for i in range(len(tokens))], {t.decode(): i for t, i in map(pair, body[cut + 1 :])})


def _ids_of(v: Vocabulary, eos: int | None, specials: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of pieces become lists of ids: each distinct piece of a batch is looked up once."""
    tail = np.array([] if eos is None else [eos], np.int32)
    for batch in batches:
        lists = batch.column(1)
        pieces_ = lists.flatten().dictionary_encode()
        own = [np.array([v.specials[p]] if specials and p in v.specials else v.encode_piece(p), np.int32) for p in pieces_.dictionary.to_pylist()] + [tail]
        sizes = np.array([len(x) for x in own], np.int64)
        flat, origin = np.concatenate(own), np.cumsum(sizes) - sizes
        # The end id is a piece of its own behind each list.
        n = np.diff(lists.offsets.to_numpy())
        index = np.insert(pieces_.indices.to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n), len(own) - 1)
        size = sizes[index]
        upto = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(upto[-1]) + np.repeat(origin[index] - upto[:-1], size)]
        edges = upto[np.concatenate([[0], np.cumsum(n + 1)])]
        yield pa.record_batch([batch.column(0), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids))], names=["doc_id", "ids"])


def encode(documents: DataFrame, vocabulary: Vocabulary, eos: int | None = None, specials: bool = False) -> DataFrame:
    """(doc_id, ids): the end id follows each document if it is given.

    No special token can come from a text, unless ``specials`` asks that the strings of special tokens are read as such. Workers remember
    the pieces that they have encoded, so the common ones cost a look-up.
    """
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)
    text = F.coalesce("text", F.lit(""))
    own = pieces(text)
    if specials and vocabulary.specials:
        mark = "|".join(re.escape(s) for s in sorted(vocabulary.specials, key=len, reverse=True))
        # Texts between special tokens are cut in pieces, the tokens stay whole.
        between, tokens = F.split(text, mark, -1), F.regexp_extract_all(text, F.lit(f"(?:{mark})"), F.lit(0))
        own = F.flatten(F.zip_with(F.transform(between, pieces), F.transform(tokens, lambda x: F.array(x)), lambda x, y: F.concat(x, F.coalesce(y, F.array().cast("array<string>")))))
    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", own.alias("_p")).mapInArrow(lambda batches: _ids_of(shared.value, eos, specials, batches), f"doc_id {kind}, ids array<int>")


def decode(rows: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(doc_id, text, n, bytes, single) of (doc_id, ids): the text, its numbers of ids and bytes, and of ids of single bytes."""
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    kind = rows.schema["doc_id"].dataType.simpleString()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        names = {i: s.encode() for s, i in v.specials.items()}
        size = max([len(v.tokens), *(i + 1 for i in names)])
        token = [*v.tokens, *(names.get(i, f"<unk:{i}>".encode()) for i in range(len(v.tokens), size))]
        for batch in batches:
            out, single, n_bytes = [], [], []
            for ids in batch.column(1).to_pylist():
                own = [token[i] if 0 <= i < size else f"<unk:{i}>".encode() for i in ids]
                data = b"".join(own)
                out.append(data.decode("utf-8", "replace"))
                n_bytes.append(len(data))
                single.append(sum(i < 256 for i in ids))
            n = [len(x) for x in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), pa.array(out, pa.string()), pa.array(n, pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(single, pa.int64())], names=["doc_id", "text", "n", "bytes", "single"])

    return rows.select("doc_id", "ids").mapInArrow(texts, f"doc_id {kind}, text string, n long, bytes long, single long")


def round_trip_failures(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """doc_id of texts that don't survive encoding and decoding."""
    back = decode(encode(documents, vocabulary), vocabulary).select("doc_id", F.col("text").alias("_back"))
    return documents.join(back, "doc_id").where(~F.col("_back").eqNullSafe(F.coalesce("text", F.lit("")))).select("doc_id")


def piece_table(texts: DataFrame) -> DataFrame:
    """(piece, n): the corpus as a trainer sees it, counted on the cluster."""
    return texts.select(F.explode(pieces(F.col("text"))).alias("piece")).groupBy("piece").agg(F.count(F.lit(1)).alias("n"))


def train(counted: list[tuple[str, int]], size: int, least: int = 2, split_digits: bool = False) -> list[bytes]:
    """Tokens of a vocabulary of at most ``size``: the bytes, then the most frequent pair again and again, the smaller one on a tie.

    Works on distinct pieces; a pair's count is kept up to date where it changes. With ``split_digits`` no
    token has two digits together.
    """
    tokens = [bytes([i]) for i in range(256)]
    words = [[p.encode()[i : i + 1] for i in range(len(p.encode()))] for p, _ in counted]
    weights = [n for _, n in counted]
    count, where = Counter(), defaultdict(set)
    for k, w in enumerate(words):
        for pair in zip(w, w[1:], strict=False):
            count[pair] += weights[k]
            where[pair].add(k)
    digit = lambda b: 48 <= b <= 57
    blocked = lambda pair: split_digits and digit(pair[0][-1]) and digit(pair[1][0])
    heap = [(-n, pair) for pair, n in count.items()]
    heapq.heapify(heap)
    known = set(tokens)
    while heap and len(tokens) < size:
        n, pair = heapq.heappop(heap)
        if count[pair] != -n or -n < least or blocked(pair):
            continue
        merged = pair[0] + pair[1]
        if merged not in known:
            known.add(merged)
            tokens.append(merged)
        changed = set()
        for k in where.pop(pair, set()):
            w, weight = words[k], weights[k]
            for old in zip(w, w[1:], strict=False):
                count[old] -= weight
                changed.add(old)
            new, i = [], 0
            while i < len(w):
                if i + 1 < len(w) and (w[i], w[i + 1]) == pair:
                    new.append(merged)
                    i += 2
                else:
                    new.append(w[i])
                    i += 1
            words[k] = new
            for p in zip(new, new[1:], strict=False):
                count[p] += weight
                where[p].add(k)
                changed.add(p)
        for p in changed:
            if count[p] > 0:
                heapq.heappush(heap, (-count[p], p))
    return tokens


#: Distinct pieces that one trainer takes; a larger corpus is sampled by its owner, not cut here.
MOST_PIECES = 5_000_000


def train_on(texts: DataFrame, size: int, least_piece: int = 1, most_pieces: int = MOST_PIECES, **options) -> Vocabulary:
    """Pieces are counted on the cluster; the distinct ones that occur ``least_piece`` times or more, by default all, are merged on the driver.

    More than ``most_pieces`` of them are an error: a trainer's corpus is a sample, and dropping pieces would give other merges.
    """
    rows = materialize(piece_table(texts).where(F.col("n") >= least_piece), "pieces")
    if (n := rows.count()) > most_pieces:
        raise ValueError(f"{n} distinct pieces, more than {most_pieces}: train on a sample")
    return Vocabulary(train(sorted((r["piece"], r["n"]) for r in rows.toLocalIterator()), size, **options))


def statistics(documents: DataFrame, vocabulary: Vocabulary, by: str) -> DataFrame:
    """One row per group: docs, tokens, bytes, bytes a token, the share of single-byte tokens in percent, and round-trip failures."""
    rows = documents.select(F.struct("doc_id", F.col(by).alias("group"), F.coalesce("text", F.lit("")).alias("text")).alias("doc_id"), "text")
    ids = encode(rows, vocabulary)
    back = decode(ids, vocabulary).select("doc_id.group", "n", "bytes", "single", (~F.col("text").eqNullSafe(F.col("doc_id.text"))).alias("bad"))
    out = back.groupBy(F.col("group").alias(by)).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"), F.sum("bytes").alias("bytes"), F.sum("single").alias("_single"), F.count(F.when(F.col("bad"), 1)).alias("failures"))
    share = lambda x, n: F.round(x / F.greatest(F.col("tokens"), F.lit(1)), n)
    return out.select(by, "docs", "tokens", "bytes", share(F.col("bytes"), 3).alias("bytes_per_token"), share(100 * F.col("_single"), 2).alias("single_byte_pct"), "failures")


#: A text that a sound vocabulary brings back whole.
PROBE = "h\u00e9llo \u65e5\u672c\u8a9e \U0001f600 \x00\x01 \t\n"


def verify(documents: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(check, passed): ids are dense, all bytes are there, a probe and all texts come back whole, and no text forges a special token."""
    v = vocabulary
    whole = lambda x: [i for p in re.findall(PIECES_RE, x) for i in v.encode_piece(p)]
    forged = any(whole(s) == [i] for s, i in v.specials.items())
    checks = [
        ("all bytes", all(v.ids.get(bytes([i])) is not None for i in range(256))),
        ("distinct tokens", len(v.ids) == len(v.tokens)),
        ("specials outside", all(i >= len(v.tokens) for i in v.specials.values())),
        ("probe", v.decode(whole(PROBE)) == PROBE),
        ("no forged special", not forged),
        ("round trip", round_trip_failures(documents, v).isEmpty()),
    ]
    return documents.sparkSession.createDataFrame(checks, "check string, passed boolean")


def require_frozen(path: str, sha256: str) -> None:
    """Refuses a vocabulary file that isn't the frozen one: another may have the same size and end id, so nothing else would notice."""
    got = hashlib.sha256(Path(path).read_bytes()).hexdigest()
    if got != sha256:
        raise ValueError(f"{path} isn't the frozen vocabulary: SHA-256 {got[:16]}, not {sha256[:16]}")


def profile(rows: DataFrame, vocab: int, eos: int) -> DataFrame:
    """One row per file of (file, doc, ids): tokens, documents, greatest id, whether the last token is the end, and the problems found."""
    last = F.max_by(F.element_at("ids", -1), "doc")
    out = rows.groupBy("file").agg(F.sum(F.size("ids")).alias("tokens"), F.sum(F.size(F.filter("ids", lambda i: i == eos))).alias("docs"), F.max(F.array_max("ids")).alias("max_id"), last.alias("last"))
    found = F.array_compact(F.array(F.when(F.col("max_id") >= vocab, F.lit("id outside the vocabulary")), F.when(F.col("last") != eos, F.lit("not ended"))))
    return out.withColumn("problems", found)


def as_arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    """Rows as a batch of a schema."""
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
