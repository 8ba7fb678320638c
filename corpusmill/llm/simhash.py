"""SimHash near-duplicates: fingerprints of four-word shingles, linked by a binary trie self-join.

Fingerprints are joined as distinct values, so copies cost nothing. Their 64 bits are cut in parts; as
links differ in few bits, two linked fingerprints agree in some of the parts whole. For each choice
of parts, fingerprints that agree in them meet in a group, whose trie is joined with itself: node
pairs go down together, add up the bits in which they differ, and are pruned when these exceed the
budget. A pair of nodes that lie in one component already is pruned too, so that a tight cluster
costs about its size, and a group gives a spanning forest of its links, not all pairs. Groups above
``HOT`` members are split in shards that meet pair by pair.

Components come from contracting the forest round by round: each node joins the neighbour of least
hash, in a table that each round writes to the shared folder.

Defined results:
  * a null or empty text, or one without words, has fingerprint 0, and is linked like any other;
  * a text of any length is hashed whole, and held whole by one task;
  * a text of fewer than four words has a single shingle; a bit set in exactly half the shingles is 0;
  * a component's id is its least doc_id; null doc_ids count as none, and are given their component's id;
  * repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import lower_ascii, release, runs, word_spans
from corpusmill.scratch import materialize, numbered

SHINGLE = 4
SEED = 42
BUDGET = 4
#: Members of a group above which it is split in shards of about so many.
HOT = 50_000
#: A value that more than one in so many documents has is joined by broadcast: there can't be more such values.
HEAVY_SHARE = 100_000
#: Pairs of nodes with no more pairs of members are compared directly.
LEAF = 64
#: Pairs of nodes that go down together, and pairs of members that are compared together.
FRONT, COMPARED = 1 << 15, 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def shingle_bounds(low: np.ndarray, offsets: np.ndarray, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends, first): shingles as ranges of bytes in which single spaces join the words."""
    word = ~_SPACE[low]
    starts, ends, first = word_spans(word, offsets)
    n_words = np.diff(first)
    joint = ends[:-1][ends[:-1] < starts[1:]] if len(ends) else ends
    keep = word.copy()
    keep[joint] = True
    flat = np.where(word, low, np.uint8(32))[keep]
    place = np.zeros(len(low) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    n = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    total = np.concatenate([[0], np.cumsum(n)])
    begin = np.arange(total[-1]) - np.repeat(total[:-1], n) + np.repeat(first[:-1], n)
    last = np.minimum(begin + shingle, np.repeat(first[1:], n)) - 1
    return flat, place[starts[begin]], place[starts[last]] + ends[last] - starts[last], total


def fingerprints(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The unsigned 64-bit fingerprint of each text."""
    import xxhash

    flat, a, b, first = shingle_bounds(lower_ascii(buf), offsets)
    out = np.zeros(len(offsets) - 1, np.uint64)
    if not len(a):
        return out
    data, digest = flat.tobytes(), xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[x:y], SEED) for x, y in zip(a.tolist(), b.tolist(), strict=True)), np.uint64, len(a))
    n = np.diff(first)
    some = np.flatnonzero(n)
    votes = np.add.reduceat(np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"), first[some], axis=0, dtype=np.int32)
    bits = 2 * votes > n[some, None]
    out[some] = np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def _print_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in runs(batch.column(1)):
            yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array(fingerprints(buf, offsets).view(np.int64))], names=["doc_id", "fp"])
    release()


def fingerprint_rows(documents: DataFrame) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long. Ids may be of any type that can be ordered."""
    return documents.select("doc_id", "text").mapInArrow(_print_rows, f"doc_id {documents.schema['doc_id'].dataType.simpleString()}, fp long")


class TrieJoin:
    """Links among sorted 64-bit values of groups, as a spanning forest."""

    def __init__(self, group: np.ndarray, key: np.ndarray, budget: int = BUDGET):
        rank = np.lexsort((key, group))
        self.rank, self.key, self.budget = rank, key[rank], budget
        group = group[rank]
        n = len(group)
        self.comp = np.arange(n)
        self.uniform = np.arange(n + 1)
        edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if n else np.zeros(1, np.int64)
        self.roots = edges[:-1], edges[1:]
        self.links: list[tuple[int, int]] = []

    def _unite(self, i: np.ndarray, j: np.ndarray) -> None:
        a, b = self.comp[i], self.comp[j]
        new = a != b
        if not new.any():
            return
        i, j, a, b = i[new], j[new], a[new], b[new]
        _, once = np.unique(np.minimum(a, b) * np.int64(len(self.comp)) + np.maximum(a, b), return_index=True)
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = parent[x]
            return x

        for x, y, p, q in zip(i[once].tolist(), j[once].tolist(), a[once].tolist(), b[once].tolist(), strict=True):
            r, s = root(p), root(q)
            if r != s:
                parent[max(r, s)] = min(r, s)
                self.links.append((x, y))
        to = np.arange(len(self.comp))
        touched = np.fromiter(parent, np.int64, len(parent))
        to[touched] = [root(x) for x in touched.tolist()]
        self.comp = to[self.comp]
        self.uniform[1:] = np.cumsum(np.concatenate([[True], self.comp[1:] != self.comp[:-1]]))

    def _compare(self, l1: np.ndarray, h1: np.ndarray, l2: np.ndarray, h2: np.ndarray) -> None:
        area = (h1 - l1) * (h2 - l2)
        upto = np.cumsum(area)
        at = 0
        while at < len(area):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + COMPARED, side="right")))
            size = area[at:to]
            k = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            wide = np.repeat(h2[at:to] - l2[at:to], size)
            i, j = np.repeat(l1[at:to], size) + k // wide, np.repeat(l2[at:to], size) + k % wide
            near = (i < j) & (np.bitwise_count(self.key[i] ^ self.key[j]) <= self.budget)
            self._unite(i[near], j[near])
            at = to

    def run(self, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Positions, in the input, of both ends of each link; the groups agree in their first ``depth`` bits."""
        if len(self.key) > 1:
            low, high = self.roots
            near = np.flatnonzero(np.bitwise_count(self.key[1:] ^ self.key[:-1]) <= self.budget)
            near = near[~np.isin(near + 1, low)]
            self._unite(near, near + 1)
            stack = [(depth, low, high, low, high, np.zeros(len(low), np.int8))]
            while stack:
                d, *front = stack.pop()
                if len(front[0]) > FRONT:
                    stack += [(d, *(x[k : k + FRONT] for x in front)) for k in range(0, len(front[0]), FRONT)]
                    continue
                stack += self._step(d, *front)
        i, j = (np.array(x, np.int64) for x in (zip(*self.links, strict=True) if self.links else ((), ())))
        return self.rank[i], self.rank[j]

    def _step(self, d: int, l1: np.ndarray, h1: np.ndarray, l2: np.ndarray, h2: np.ndarray, e: np.ndarray) -> list[tuple]:
        u = self.uniform
        joined = (u[h1] == u[l1 + 1]) & (u[h2] == u[l2 + 1]) & (self.comp[l1] == self.comp[l2])
        keep = ~joined
        l1, h1, l2, h2, e = l1[keep], h1[keep], l2[keep], h2[keep], e[keep]
        small = (h1 - l1) * (h2 - l2) <= LEAF if d < 64 else np.ones(len(l1), bool)
        if small.any():
            self._compare(l1[small], h1[small], l2[small], h2[small])
            l1, h1, l2, h2, e = (x[~small] for x in (l1, h1, l2, h2, e))
        if not len(l1):
            return []
        bit = np.uint64(63 - d)
        # In a node, values without the bit precede those with it: count them between the node's ends.
        m1, m2 = self._middle(bit, l1, h1), self._middle(bit, l2, h2)
        same = l1 == l2
        parts = [
            (l1, m1, l2, m2, e, None),
            (m1, h1, m2, h2, e, None),
            (l1, m1, m2, h2, e + 1, None),
            (m1, h1, l2, m2, e + 1, ~same),  # of a node with itself, one mixed pair is enough
        ]
        out = []
        for a, b, x, y, diff, only in parts:
            ok = (b > a) & (y > x) & (diff <= self.budget)
            if only is not None:
                ok &= only
            if ok.any():
                out.append([z[ok] for z in (a, b, x, y, diff)])
        return [(d + 1, *(np.concatenate(z) for z in zip(*out, strict=True)))] if out else []

    def _middle(self, bit: np.uint64, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The first position in each [low, high) whose value has the bit, by bisection over all nodes abreast."""
        a, b = low.copy(), high.copy()
        while (open_ := a < b).any():
            mid = (a + b) >> 1
            one = ((self.key[np.minimum(mid, len(self.key) - 1)] >> bit) & np.uint64(1)).astype(bool)
            b = np.where(open_ & one, mid, b)
            a = np.where(open_ & ~one, mid + 1, a)
        return a


def parts_for(n: int, budget: int = BUDGET) -> int:
    """Parts of the 64 bits: the fewest whose groups have, on average, few members; all values use one rule."""
    parts = budget + 1
    while parts < budget + 4 and n >> ((64 // parts) * (parts - budget)) > 4096:
        parts += 1
    return parts


def _layouts(parts: int, budget: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each choice of parts that agree: the bits that they have, and (shift, width) of all parts, chosen ones first."""
    edges = [64 * k // parts for k in range(parts + 1)]
    spans = [(edges[k], edges[k + 1] - edges[k]) for k in range(parts)]
    out = []
    for chosen in combinations(range(parts), parts - budget):
        order = [spans[k] for k in chosen] + [spans[k] for k in range(parts) if k not in chosen]
        out.append((sum(w for _, w in order[: len(chosen)]), order))
    return out


def _arranged(fp: Column, order: list[tuple[int, int]]) -> Column:
    """The value with its parts in another order, the first one highest."""
    out, top = F.lit(0).cast("long"), 64
    for shift, width in order:
        top -= width
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)) if width < 64 else fp
        out = out.bitwiseOR(F.shiftleft(part, top))
    return out


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _join_partition(depth: int, budget: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    columns = [[], [], []]
    for batch in batches:
        for k in range(3):
            columns[k].append(batch.column(k).to_numpy(zero_copy_only=False))
    if columns[0]:
        group, key, fp = (np.concatenate(c) for c in columns)
        i, j = TrieJoin(group, key.view(np.uint64), budget).run(depth)
        for k in range(0, len(i), 1 << 16):
            yield pa.record_batch([pa.array(fp[i[k : k + (1 << 16)]]), pa.array(fp[j[k : k + (1 << 16)]])], schema=_LINKS)


def links(prints: DataFrame, budget: int = BUDGET, hot: int = HOT) -> DataFrame:
    """(a, b): a forest that connects the distinct values of column ``fp`` exactly as all links do."""
    layouts = _layouts(parts_for(prints.count(), budget), budget)
    choices = F.array(*[F.struct(F.lit(k).alias("choice"), F.shiftrightunsigned(_arranged(F.col("fp"), order), 64 - bits).alias("head"), _arranged(F.col("fp"), order).alias("key")) for k, (bits, order) in enumerate(layouts)])
    rows = prints.select("fp", F.explode(choices).alias("x")).select("fp", "x.choice", "x.head", "x.key")
    large = rows.groupBy("choice", "head").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot)
    large = materialize(large.select("choice", "head", F.ceil(F.col("n") / hot).cast("int").alias("shards")), "simhash-hot")
    if large.isEmpty():
        rows = rows.select(F.xxhash64("choice", "head").alias("group"), "key", "fp")
    else:
        # Each shard of a hot group meets each other in a group of its own.
        own = F.pmod(F.xxhash64("fp"), F.col("shards")).cast("int")
        rows = rows.join(large, ["choice", "head"], "left").withColumn("shards", F.coalesce("shards", F.lit(1))).withColumn("own", own)
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        rows = rows.select(F.xxhash64("choice", "head", F.least("own", "other"), F.greatest("own", "other")).alias("group"), "key", "fp")
    depth = min(bits for bits, _ in layouts)
    return rows.repartition("group").mapInArrow(lambda batches: _join_partition(depth, budget, batches), "a long, b long")


def components(edges: DataFrame, name: str = "links") -> DataFrame:
    """(node, label): nodes of (a, b) links, and a label that the nodes of a component share."""
    edges = materialize(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), name)
    labels = None
    round_ = 0
    while not edges.isEmpty():
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(edges.select(F.col("b").alias("node"), F.col("a").alias("other")))
        rank = lambda c: F.xxhash64(c, F.lit(round_))  # noqa: B023, E731
        best = near.groupBy("node").agg(F.min(F.struct(rank(F.col("other")).alias("rank"), F.col("other").alias("to"))).alias("best"))
        own = F.struct(rank(F.col("node")).alias("rank"), F.col("node").alias("to"))
        step = materialize(best.select("node", F.least(F.col("best"), own)["to"].alias("to")), f"{name}-step")
        moved = step.select(F.col("node").alias("label"), "to")
        labels = step.select("node", F.col("to").alias("label")) if labels is None else labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label"))
        if round_:
            labels = materialize(labels, f"{name}-labels")
        a = step.select(F.col("node").alias("a"), F.col("to").alias("to_a"))
        b = step.select(F.col("node").alias("b"), F.col("to").alias("to_b"))
        edges = edges.join(a, "a").join(b, "b").where("to_a <> to_b").select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct()
        edges = materialize(edges, f"{name}-{round_}")
        round_ += 1
    return labels if labels is not None else edges.select(F.col("a").alias("node"), F.col("b").alias("label"))


def near_duplicates(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(doc_id, fp, component_id) of each document."""
    prints = materialize(fingerprint_rows(documents), "simhash")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")), "simhash-distinct")
    labels = components(links(distinct.select("fp"), budget), "simhash-links")
    linked = distinct.join(labels.select(F.col("node").alias("fp"), "label"), "fp")
    least = linked.groupBy("label").agg(F.min("first").alias("component_id"))
    renamed = linked.join(least, "label").select("fp", "component_id")
    ids = distinct.join(renamed, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id"))
    # Values of many documents would meet them all in one task; there are at most HEAVY_SHARE of those, so they are sent to the documents.
    heavy = F.col("n") > max(1000, prints.count() // HEAVY_SHARE)
    common = F.broadcast(materialize(ids.where(heavy).select("fp", "component_id"), "simhash-common"))
    rare = prints.join(common.select("fp"), "fp", "left_anti").join(ids.where(~heavy).select("fp", "component_id"), "fp")
    return prints.join(common, "fp").unionByName(rare).select("doc_id", "fp", "component_id")


def report(documents: DataFrame) -> DataFrame:
    """The contract's rows."""
    return near_duplicates(documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(documents: DataFrame, budget: int = BUDGET) -> DataFrame:
    """One document of each component, with all columns: that of the least doc_id, a null one first; of rows of one id, the first by file and place."""
    rows = numbered(documents, "_row")
    keyed = rows.select(F.struct(F.col("doc_id"), F.col("_row")).alias("doc_id"), "text")
    kept = near_duplicates(keyed, budget).where("doc_id = component_id").select("doc_id._row")
    return rows.join(kept, "_row", "left_semi").select(*documents.columns)
