"""Queries over whole texts and arrays against plain Python, with what matters behind the places where samples end."""

import base64
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import tokenizer
from corpusmill.plans import catalogue


def written(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def got(spark, folder, name, key):
    return {r[key]: r.asDict() for r in catalogue.QUERIES[name](spark, folder).collect()}


def runs(items, n):
    return [tuple(items[i : i + n]) for i in range(len(items) - n + 1)]


def distinct(items, n):
    g = runs(items, n)
    return len(set(g)) / len(g) if g else 0.0


PLAIN = " ".join(f"w{i}" for i in range(250))
TEXTS = [PLAIN, PLAIN + " again and" * 400, PLAIN + " bad � end", " ".join(f"w{i % 8}" for i in range(16)), "a b", "", "aa b aab " * 90, " ".join(f"u{i}" for i in range(20_000))]


def test_repetition_of_whole_texts(spark, tmp_path):
    folder = written(spark, tmp_path, "documents", list(enumerate(TEXTS)), "doc_id long, text string")
    shares, flags = got(spark, folder, "repetition_share", "doc_id"), got(spark, folder, "generation_flags", "doc_id")
    for i, text in enumerate(TEXTS):
        w = text.split()
        loop = len(w) >= 24 and distinct(w, 3) < 0.5
        four = 1 - distinct(w, 4) if len(w) >= 4 else 0.0
        assert shares[i] == {"doc_id": i, "distinct2": pytest.approx(distinct(w, 2), abs=1e-6), "repeated4": pytest.approx(four, abs=1e-6), "loop": loop}
        assert flags[i] == {"doc_id": i, "empty": len(w) <= 8, "loop": loop, "invalid": "�" in text, "copies": len(w) >= 16 and w[8:16] == w[:8]}
    assert shares[1]["loop"] and flags[2]["invalid"]


def trained(texts, size):
    """Every pair of every piece is counted anew for each merge."""
    words = Counter(tuple(bytes([x]) for x in p.encode()) for t in texts for p in t)
    tokens = [bytes([i]) for i in range(256)]
    while len(tokens) < size:
        count = Counter()
        for w, n in words.items():
            for pair in zip(w, w[1:], strict=False):
                count[pair] += n
        n, pair = min(((-n, pair) for pair, n in count.items()), default=(0, None))
        if -n < 2:
            break
        if pair[0] + pair[1] not in tokens:
            tokens.append(pair[0] + pair[1])
        merged = Counter()
        for w, n in words.items():
            new, i = [], 0
            while i < len(w):
                both = w[i : i + 2] == pair
                new.append(pair[0] + pair[1] if both else w[i])
                i += 2 if both else 1
            merged[tuple(new)] += n
        words = merged
    return tokens


def test_vocabulary_of_all_pieces(spark, tmp_path):
    """Pieces that occur once hold the most frequent pair."""
    texts = [" ".join(f"{chr(97 + i)}{chr(97 + j)}qx" for j in range(26)) for i in range(8)] + ["low low lower"]
    folder = written(spark, tmp_path, "benchmark", list(enumerate(texts)), "item_id long, text string")
    rows = [r[0] for r in spark.read.parquet(f"{folder}/benchmark.parquet").select(tokenizer.pieces(F.col("text"))).collect()]
    want = trained(rows, 600)
    got_ = [bytes(r.token) for r in sorted(catalogue.QUERIES["bpe_train"](spark, folder).collect(), key=lambda r: r.id)]
    assert got_ == want and want[256] == b"qx"
    ids = tokenizer.Vocabulary(want)
    written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    sizes = got(spark, folder, "bpe_encode", "doc_id")
    assert [sizes[i]["n"] for i in range(len(texts))] == [1 + sum(len(ids.encode_piece(p)) for p in row) for row in rows]


def banned(items, n):
    return sorted({items[i + n - 1] for i in range(len(items) - n + 1) if items[i : i + n - 1] == items[len(items) - n + 1 :]})


def test_masks_of_whole_arrays(spark, tmp_path):
    rng = random.Random(3)
    vectors = [[round(rng.uniform(-1, 1), 3) for _ in range(64)] for _ in range(20)]
    vectors[0][40], vectors[1][63] = 5.0, 9.0
    folder = written(spark, tmp_path, "embeddings", list(enumerate(vectors)), "vec_id long, embedding array<double>")
    masks, nuclei, differences = (got(spark, folder, f"{name}", "vec_id") for name in ("logits_masks", "nucleus_masks", "score_differences"))
    for k, e in enumerate(vectors):
        floor = sorted(e, reverse=True)[2]
        assert masks[k] == {"vec_id": k, "kept": sum(x >= floor for x in e), "best": e.index(max(e)), "penalized": pytest.approx(max(x / 1.5 if x > 0 else x * 1.5 for x in e), abs=1e-6)}
        total, mass, size = sum(math.exp(x) for x in e), 0.0, 0
        for x in sorted(e, reverse=True):
            if mass >= 0.9:
                break
            mass, size = mass + math.exp(x) / total, size + 1
        ids = [math.floor(abs(x) * 3) for x in e]
        assert nuclei[k] == {"vec_id": k, "nucleus": size, "banned": banned(ids, 2), "tail": ids[-3:], "width": 64}
    assert masks[0]["best"] == 40 and masks[1]["best"] == 63
    assert set(differences) == set(range(19))
    for k, (a, b) in enumerate(zip(vectors, vectors[1:], strict=False)):
        far = [abs(x - y) for x, y in zip(a, b, strict=True)]
        agree = sum(math.floor(x) == math.floor(y) for x, y in zip(a, b, strict=True)) / 64
        relative = math.sqrt(sum(x * x for x in far) / sum(x * x for x in a))
        assert differences[k] == {"vec_id": k, "most": pytest.approx(max(far), abs=1e-6), "agree": pytest.approx(agree, abs=1e-6), "relative": pytest.approx(relative, abs=1e-6)}


def test_codecs_of_whole_texts(spark, tmp_path):
    texts = ["", "short", "x" * 100 + "\\\n\t\r\x00 end", "größe 😀 " * 500 + "\n", "line\n" * 3_000]
    folder = written(spark, tmp_path, "documents", list(enumerate(texts)), "doc_id long, text string")
    coded, escaped = got(spark, folder, "base64_codec", "doc_id"), got(spark, folder, "printable_and_spaced", "doc_id")
    for i, text in enumerate(texts):
        raw = text.encode()
        assert coded[i] == {"doc_id": i, "b": base64.b64encode(raw).decode(), "back": text, "n": len(text), "bytes": len(raw)}
        letters = {10: "\\n", 13: "\\r", 9: "\\t"}
        assert escaped[i]["p"] == "".join(chr(x) if 32 <= x <= 126 else letters.get(x, f"\\x{x:02X}") for x in raw + b"\ta\\b")
