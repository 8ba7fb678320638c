"""Language identification with a string kernel.

The kernel of two texts is the number of n-grams that both have, over the root of the product of
their numbers of n-grams: presence of all n-grams of one to three bytes, a blended spectrum. A set of
landmark texts spans a Nystrom approximation; kernel ridge regression against all landmarks gives a
score per language, one against the rest.

A text's kernels with all landmarks are its presence vector times the landmarks' presence vectors, each over the root of
its n-grams' number. N-grams that no landmark has add nothing to a product, but count in the text's own number. As products
are associative, the landmarks' vectors are multiplied with the learned coefficients once, and batches of presence vectors
with the result: a weight per n-gram and language. Batches have at most ``BATCH`` texts, whatever their sizes.

Before n-grams are taken, letters A-Z and those of Latin-1 are lower-cased, and every run of other
ASCII characters becomes one space, so that digits, marks and layout say nothing.

Learning reads a bounded sample of labelled rows: at most ``PER_LANGUAGE`` texts of each language, chosen by a hash of the
id, and of each the first ``SAMPLE_CHARS`` characters. Scoring reads every text whole, with all its n-grams.

Defined results:
  * a null text, or one without a letter, is ``und`` with score 0; so is every text if nothing was learned;
  * of languages with equal scores the first by code point is given;
  * a very long text is scored by all its n-grams, as any other;
  * repeated rows give repeated rows; an empty table gives none; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.arrowtext import kept_rows, release, runs

UNDETERMINED = "und"
PER_LANGUAGE = 250
LANDMARKS_PER_LANGUAGE = 32
SAMPLE_CHARS = 8192
#: Texts whose presence vectors are in memory together.
BATCH = 64
RIDGE = 1e-2
#: Scores are regression values near 0 and 1; this makes them shares that sum to 1.
SHARPNESS = 8.0
#: A text whose best language has a smaller share is rejected by :func:`identified`.
LEAST_SCORE = 0.3

# Symbols: 0 a space, 1-26 letters, 27-154 bytes of other characters.
_SYMBOL = np.zeros(256, np.uint8)
_SYMBOL[97:123] = _SYMBOL[65:91] = np.arange(1, 27)
_SYMBOL[128:] = np.arange(27, 155)
_BASE = 155


def _symbols(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all texts, runs of spaces made one, and where each text's begin."""
    low = buf
    if (wide := buf == 0xC3).any():  # capital letters of Latin-1 but the sign between them
        at = np.flatnonzero(wide[:-1]) + 1
        capital = at[(buf[at] >= 0x80) & (buf[at] <= 0x9E) & (buf[at] != 0x97)]
        low = buf.copy()
        low[capital] += 0x20
    s = _SYMBOL[low]
    keep = np.ones(len(s), bool)
    if len(s):
        keep[1:] = (s[1:] != 0) | (s[:-1] != 0)
    place = np.zeros(len(s) + 1, np.int64)
    np.cumsum(keep, out=place[1:])
    return s[keep].astype(np.int32), place[offsets]


def _grams(symbols: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, gram) of all n-grams, n from 1 to 3, none across texts; numbers of different n are apart."""
    text = np.repeat(np.arange(len(offsets) - 1, dtype=np.int64), np.diff(offsets))
    yield text, symbols
    pair = symbols[:-1] * _BASE + symbols[1:] if len(symbols) else symbols
    inside = text[:-1] == text[1:]
    yield text[:-1][inside], _BASE + pair[inside]
    triple = pair[:-1] * _BASE + symbols[2:] if len(symbols) > 2 else symbols[:0]
    inside = text[:-2] == text[2:] if len(symbols) > 2 else np.zeros(0, bool)
    yield text[:-2][inside] if len(symbols) > 2 else text[:0], _BASE + _BASE**2 + triple[inside]


_UNIVERSE = _BASE + _BASE**2 + _BASE**3


def _has_letter(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    ascii_letter = ((buf | 0x20) >= 97) & ((buf | 0x20) <= 122)
    has = np.diff(np.concatenate([[0], np.cumsum(ascii_letter)])[offsets]) > 0
    for i in np.flatnonzero(~has):
        own = buf[offsets[i] : offsets[i + 1]]
        if (own >= 128).any():
            has[i] = any(c.isalpha() for c in own.tobytes().decode("utf-8", "replace"))
    return has


@dataclass
class Model:
    """The landmarks' n-grams, and what each adds to each language's score: landmarks' vectors times coefficients."""

    languages: list[str]
    grams: np.ndarray
    weights: np.ndarray

    def __post_init__(self):
        self._column = None

    def presence(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Presence of the landmarks' n-grams in each text, and the number of all n-grams that a text has."""
        if self._column is None:
            self._column = np.full(_UNIVERSE, -1, np.int32)
            self._column[self.grams] = np.arange(len(self.grams), dtype=np.int32)
        n = len(offsets) - 1
        out = np.zeros((n, len(self.grams)), np.float32)
        flat, others = out.ravel(), np.zeros(n, np.int64)
        symbols, at = _symbols(buf, offsets)
        for text, gram in _grams(symbols, at):
            column = self._column[gram]
            known = column >= 0
            flat[text[known] * len(self.grams) + column[known]] = 1
            if not known.all():  # few: n-grams that no landmark has
                others += np.bincount(np.unique(text[~known] * _UNIVERSE + gram[~known]) // _UNIVERSE, minlength=n)
        return out, out.sum(1, dtype=np.float64) + others

    def shares(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row per text, a column per language; rows sum to 1."""
        present, total = self.presence(buf, offsets)
        scores = SHARPNESS * (present @ self.weights) / np.sqrt(np.maximum(total, 1))[:, None]
        e = np.exp(scores - scores.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _flat(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    data = [t.encode() for t in texts]
    return np.frombuffer(b"".join(data), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in data])]).astype(np.int64)


def kernel(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The kernel of texts given by presence and number of n-grams."""
    return (a[0] @ b[0].T).astype(np.float64) / np.sqrt(np.maximum(np.outer(a[1], b[1]), 1))


def fit(rows: list[tuple[str, str]], landmarks_per_language: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    """Learns from (text, language) rows; the first rows of each language are its landmarks."""
    languages = sorted({lang for _, lang in rows}, key=lambda x: x.encode())
    marks, count = [], dict.fromkeys(languages, 0)
    for i, (_, lang) in enumerate(rows):
        if count[lang] < landmarks_per_language:
            count[lang] += 1
            marks.append(i)
    if not rows:
        return Model([], np.empty(0, np.int64), np.empty((0, 0), np.float32))
    symbols, at = _symbols(*_flat([rows[i][0] for i in marks]))
    model = Model(languages, np.unique(np.concatenate([gram for _, gram in _grams(symbols, at)])), np.empty(0))
    landmarks = model.presence(*_flat([rows[i][0] for i in marks]))
    near = np.vstack([kernel(model.presence(*_flat([t for t, _ in rows[k : k + BATCH]])), landmarks) for k in range(0, len(rows), BATCH)])
    goal = np.array([[float(lang == x) for x in languages] for _, lang in rows])
    weight = np.array([1.0 / np.sqrt(sum(lang == x for _, x in rows)) for _, lang in rows])[:, None]
    near_w, goal_w = near * weight, goal * weight
    system = near_w.T @ near_w + ridge * kernel(landmarks, landmarks) + 1e-8 * np.eye(len(marks))
    coefficients = np.linalg.solve(system, near_w.T @ goal_w)
    model.weights = (landmarks[0].T.astype(np.float64) @ (coefficients / np.sqrt(np.maximum(landmarks[1], 1))[:, None])).astype(np.float32)
    return model


def _held_out(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds)) == 0


def sample(labelled: DataFrame, per_language: int = PER_LANGUAGE, sample_chars: int = SAMPLE_CHARS) -> list[tuple[str, str]]:
    """At most ``per_language`` (text, lang) rows of each language, by a hash of the id; the same rows in each run. Of a longer text, its beginning teaches."""
    rank = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.xxhash64("text")))
    rows = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    if not counts:
        return []
    # Ranks are uniform: a bound on them keeps about twice as many as are wanted, whatever the table's size.
    bounds = {lang: f"{min(0xFFFFFFFF, int(2.0 * (per_language + 20) / n * 0xFFFFFFFF)):08x}" for lang, n in counts.items()}
    bound = F.create_map(*[F.lit(x) for pair in bounds.items() for x in pair])[F.col("lang")]
    few = rows.select("lang", F.left("text", F.lit(sample_chars)).alias("text"), rank.alias("rank")).where(F.substring("rank", 1, 8) <= bound).dropDuplicates(["lang", "rank"])  # repeated rows teach once
    chosen: dict[str, list[tuple[str, str]]] = {}
    for r in few.toLocalIterator():
        chosen.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    return [(text, lang) for lang in sorted(chosen, key=lambda x: x.encode()) for _, text in sorted(chosen[lang])[:per_language]]


_OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _score_rows(model: Model, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = np.array([*model.languages, UNDETERMINED], dtype=object)
    for batch in batches:
        for a, b, buf, offsets in runs(batch.column(1), run_texts=BATCH):
            n = b - a
            best, score = np.full(n, len(model.languages)), np.zeros(n)
            if model.languages:
                shares, has = model.shares(buf, offsets), _has_letter(buf, offsets)
                best[has] = shares.argmax(axis=1)[has]
                score[has] = shares.max(axis=1)[has]
            yield pa.record_batch([batch.column(0).slice(a, n), pa.array(names[best], pa.string()), pa.array(score)], schema=_OUT)
    release()


def predict(documents: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(lambda batches: _score_rows(shared.value, batches), "doc_id long, lang_pred string, score double")


def learn(documents: DataFrame, folds: int = 5) -> Model:
    """A model from the text and language of the rows that aren't held out."""
    return fit(sample(documents.where(~_held_out(F.col("doc_id"), folds)).select("doc_id", "text", "lang")))


def report(documents: DataFrame) -> DataFrame:
    """The contract's rows."""
    return predict(documents, learn(documents)).select("doc_id", _held_out(F.col("doc_id"), 5).alias("held_out"), "lang_pred", "score")


def identified(documents: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The rows whose language is found, with all their columns: neither ``und`` nor a share under ``least_score``.

    Rows are kept or dropped as they are read: nothing is shuffled.
    """
    shared = documents.sparkSession.sparkContext.broadcast(learn(documents))

    def found(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        model = shared.value
        if not model.languages:
            return np.zeros(len(offsets) - 1, bool)
        return _has_letter(buf, offsets) & (model.shares(buf, offsets).max(axis=1) >= least_score)

    return kept_rows(documents, found, run_texts=BATCH)
