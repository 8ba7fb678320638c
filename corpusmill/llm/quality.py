"""Quality classifier: a sparse ensemble of rules over statistics of whole texts.

Small trees are grown on a sample of labelled rows; each path from a root to a node is a conjunction of
bounds on statistics. Logistic regression with an L1 penalty weighs these rules, and most get no
weight. The remaining rules are compiled into one Spark column expression over the statistics.

Learning reads at most ``SAMPLE`` labelled rows, chosen by a hash of the id; statistics are taken of
every text, whole. Labels, languages, sources and ids are never inputs.

Defined results:
  * a null text has the statistics of the empty text; both get a score;
  * a text of any length is read whole; texts of equal statistics have equal scores, and a score of just 0.5 predicts 1;
  * without labelled rows every score is 0.5; with labels of one class, scores lean to it;
  * a label of null, or for no document, is not learned from; different labels of a document both count, equal ones once;
  * repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import RollingHash, lower_ascii, mix, runs, word_spans
from corpusmill.scratch import materialize

SAMPLE = 6000
TREES, DEPTH, SHRINK, BINS = 40, 3, 0.2, 32
PENALTIES = (0.02, 0.006, 0.002, 0.0006)

STATISTICS = (
    "log_bytes", "log_words", "word_length", "word_length_spread", "upper_share", "digit_share", "mark_share", "symbol_share", "wide_share", "pipes_per_word", "calls_per_word",
    "lines_per_word", "short_word_share", "marked_word_share", "capital_word_share", "distinct_word_share", "repeated_next_share", "distinct_run_share", "repeated_line_share", "entropy",
)

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[33:48] = _PUNCT[58:65] = _PUNCT[91:97] = _PUNCT[123:127] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = True


def _summed(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])


def _distinct(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """The number of distinct values of each owner."""
    if not len(values):
        return np.zeros(n)
    rank = np.lexsort((values, owner))
    v, o = values[rank], owner[rank]
    new = np.concatenate([[True], (v[1:] != v[:-1]) | (o[1:] != o[:-1])])
    return np.bincount(o[new], minlength=n).astype(float)


def statistics(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of :data:`STATISTICS` per text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(float)
    low = lower_ascii(buf)
    starts, ends, first = word_spans(~_SPACE[buf], offsets)
    words = np.diff(first).astype(float)
    some_bytes, some_words = np.maximum(size, 1), np.maximum(words, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    length = (ends - starts).astype(float)
    mean = np.bincount(owner, length, n) / some_words
    spread = np.sqrt(np.maximum(np.bincount(owner, length**2, n) / some_words - mean**2, 0))
    letters = np.maximum(_summed((low >= 97) & (low <= 122), offsets), 1)
    hashes = RollingHash(low)
    h = hashes.of(starts, ends)
    same = np.concatenate([[False], (h[1:] == h[:-1]) & (owner[1:] == owner[:-1])]) if len(h) else np.zeros(0, bool)
    run = mix(h[:-3] * np.uint64(3) + mix(h[1:-2] * np.uint64(5) + mix(h[2:-1] * np.uint64(7) + h[3:]))) if len(h) > 3 else h[:0]
    inside = owner[:-3] == owner[3:] if len(h) > 3 else np.zeros(0, bool)
    n_runs = np.bincount(owner[:-3][inside], minlength=n) if len(h) > 3 else np.zeros(n)
    line_starts, line_ends, line_first = word_spans(buf != 10, offsets)
    line_owner = np.repeat(np.arange(n), np.diff(line_first))
    lines = np.diff(line_first).astype(float)
    last = low[ends - 1] if len(ends) else low[:0]
    opening = buf[starts] if len(starts) else buf[:0]
    text = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    histogram = np.bincount(text * 256 + buf, minlength=n * 256).reshape(n, 256) / some_bytes[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        entropy = -np.nansum(np.where(histogram > 0, histogram * np.log2(histogram), 0), axis=1) + 0.0
    columns = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(words),
        "word_length": mean,
        "word_length_spread": spread,
        "upper_share": _summed((buf >= 65) & (buf <= 90), offsets) / letters,
        "digit_share": _summed((buf >= 48) & (buf <= 57), offsets) / some_bytes,
        "mark_share": _summed(_PUNCT[buf], offsets) / some_bytes,
        "symbol_share": _summed(_SYMBOL[buf], offsets) / some_bytes,
        "wide_share": _summed(buf >= 128, offsets) / some_bytes,
        "pipes_per_word": _summed(buf == ord("|"), offsets) / some_words,
        "calls_per_word": _summed(buf == ord("!"), offsets) / some_words,
        "lines_per_word": lines / some_words,
        "short_word_share": np.bincount(owner, length <= 3, n) / some_words,
        "marked_word_share": np.bincount(owner, _PUNCT[last], n) / some_words,
        "capital_word_share": np.bincount(owner, (opening >= 65) & (opening <= 90), n) / some_words,
        "distinct_word_share": _distinct(h, owner, n) / some_words,
        "repeated_next_share": np.bincount(owner, same, n) / some_words,
        "distinct_run_share": np.where(n_runs > 0, _distinct(run[inside], owner[:-3][inside] if len(h) > 3 else owner[:0], n) / np.maximum(n_runs, 1), 1.0),
        "repeated_line_share": 1 - np.where(lines > 0, _distinct(hashes.of(line_starts, line_ends), line_owner, n) / np.maximum(lines, 1), 1.0),
        "entropy": entropy,
    }
    return np.column_stack([columns[k] for k in STATISTICS])


_ROWS = pa.schema([("doc_id", pa.int64()), *((k, pa.float64()) for k in STATISTICS)])
_ROWS_DDL = "doc_id long, " + ", ".join(f"{k} double" for k in STATISTICS)


def _statistic_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b, buf, offsets in runs(batch.column(1)):
            table = statistics(buf, offsets)
            yield pa.record_batch([batch.column(0).slice(a, b - a), *(pa.array(np.ascontiguousarray(c)) for c in table.T)], schema=_ROWS)


def statistic_rows(documents: DataFrame) -> DataFrame:
    """doc_id and the statistics of each whole text."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_statistic_rows, _ROWS_DDL)


#: A rule: bounds (statistic, "<=" or ">", value), all of which hold.
Rule = tuple[tuple[int, str, float], ...]


def _tree(binned: np.ndarray, edges: list[np.ndarray], goal: np.ndarray, rows: np.ndarray, depth: int, path: dict, found: list[Rule], out: np.ndarray) -> None:
    """Grows a node that fits ``goal`` in the mean, notes its path, and writes its value to ``out``."""
    out[rows] = goal[rows].mean()
    if path:
        found.append(tuple(sorted((f, op, v) for (f, op), v in path.items())))
    if depth == 0 or len(rows) < 20:
        return
    g = goal[rows]
    best = (1e-9, -1, -1)
    for f in range(binned.shape[1]):
        n = np.bincount(binned[rows, f], minlength=BINS + 1)
        s = np.bincount(binned[rows, f], g, minlength=BINS + 1)
        n_low, s_low = np.cumsum(n)[:-1], np.cumsum(s)[:-1]
        n_high, s_high = len(rows) - n_low, g.sum() - s_low
        ok = (n_low >= 5) & (n_high >= 5)
        gain = np.where(ok, s_low**2 / np.maximum(n_low, 1) + s_high**2 / np.maximum(n_high, 1) - g.sum() ** 2 / len(rows), 0)[: len(edges[f])]
        if len(gain) and gain.max() > best[0]:
            best = (gain.max(), f, int(gain.argmax()))
    _, f, k = best
    if f < 0:
        return
    value, low = float(edges[f][k]), binned[rows, f] <= k
    for op, part in (("<=", rows[low]), (">", rows[~low])):
        _tree(binned, edges, goal, part, depth - 1, {**path, (f, op): value}, found, out)


def _holds(rules: list[Rule], x: np.ndarray) -> np.ndarray:
    out = np.ones((len(x), len(rules)), bool)
    for k, rule in enumerate(rules):
        for f, op, v in rule:
            out[:, k] &= x[:, f] <= v if op == "<=" else x[:, f] > v
    return out


def _lasso(a: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Logistic regression with an L1 penalty, by accelerated proximal gradients; columns are scaled to equal spread."""
    scale = np.maximum(a.std(axis=0), 0.02)
    b, n = (a - a.mean(axis=0)) / scale, len(y)
    rate = 4.0 / (max(np.linalg.norm(b, 2) ** 2 / n, 1e-9) + 1)
    w, held, base = np.zeros(b.shape[1]), np.zeros(b.shape[1]), 0.0
    t = 1.0
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(b @ held + base, -30, 30))) - y
        base -= rate * error.mean()
        new = held - rate * (b.T @ error) / n
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        held, w, t = new + (t - 1) / t_new * (new - w), new, t_new
    weights = w / scale
    return weights, float(base - a.mean(axis=0) @ weights)


def _loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-6, 1 - 1e-6)
    return float(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH) -> tuple[list[Rule], np.ndarray, float]:
    """(rules, weights, base) from statistics and 0/1 labels, in the given order of rows."""
    if not len(y):
        return [], np.empty(0), 0.0
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    if y.min() == y.max():
        return [], np.empty(0), float(np.log(share / (1 - share)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)])
    rng, score, found = np.random.default_rng(7), np.full(len(y), np.log(share / (1 - share))), []
    for _ in range(trees):
        goal, value = y - 1 / (1 + np.exp(-score)), np.zeros(len(y))
        rows = np.sort(rng.permutation(len(y))[: max(40, len(y) // 2)])
        _tree(binned, edges, goal, rows, depth, {}, found, value)
        score += SHRINK * 4 * value
    rules = list(dict.fromkeys(found))
    a = _holds(rules, x).astype(float)
    # Every fourth row chooses the penalty.
    check = np.arange(len(y)) % 4 == 3
    tried = []
    for penalty in PENALTIES:
        w, base = _lasso(a[~check], y[~check], penalty)
        tried.append((_loss(1 / (1 + np.exp(-np.clip(a[check] @ w + base, -30, 30))), y[check]), -penalty))
    w, base = _lasso(a, y, -min(tried)[1])
    kept = np.flatnonzero(w)
    return [rules[k] for k in kept], w[kept], base


def score_column(rules: list[Rule], weights: np.ndarray, base: float) -> Column:
    """The rules as one expression over the columns of :data:`STATISTICS`."""
    total = F.lit(float(base))
    for rule, weight in zip(rules, weights.tolist(), strict=True):
        holds = F.lit(True)
        for f, op, v in rule:
            holds &= F.col(STATISTICS[f]) <= F.lit(v) if op == "<=" else F.col(STATISTICS[f]) > F.lit(v)
        total += F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
    return 1.0 / (1.0 + F.exp(-total))


def _fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(3))


def learn(table: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[list[Rule], np.ndarray, float]:
    """Rules from the labelled rows of a table of statistics that aren't held out."""
    rank = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (_fold(F.col("doc_id")) != 1)).select(F.col("doc_id").cast("long").alias("doc_id"), "quality").distinct()
    n = usable.count()
    # Ranks are uniform: the bound keeps about the sample's size, whatever the table's.
    bound = f"{min(0xFFFFFFFF, int(sample / max(n, 1) * 0xFFFFFFFF)):08x}"
    few = usable.withColumn("rank", rank).where(F.substring("rank", 1, 8) <= bound)
    # Rows of one id with equal statistics teach once; of an id with more than one text, the least statistics do: an id is a row, and the sample's size bounds all.
    own = table.join(F.broadcast(few.select("doc_id").distinct()), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct(*STATISTICS)).alias("s"))
    rows = own.join(F.broadcast(few), "doc_id").select("rank", F.col("quality").cast("double").alias("quality"), "s.*").toPandas()
    rows = rows.sort_values(["rank", "quality", *STATISTICS], kind="stable")
    return fit(rows[list(STATISTICS)].to_numpy(float), (rows["quality"].to_numpy() > 0).astype(float))


def report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """The contract's rows."""
    table = materialize(statistic_rows(documents), "quality")
    score = score_column(*learn(table, labels))
    rows = table.select("doc_id", (_fold(F.col("doc_id")) == 1).alias("held_out"), score.alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
