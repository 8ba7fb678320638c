"""Samples, prompts, sinks and checks that SQL doesn't reach."""

import hashlib
import random
import re
import time
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import logs, ngrams, sampling, tokenizer
from corpusmill.plans import build
from corpusmill.plans.catalogue import QUERIES
from corpusmill.scratch import numbered, spread
from corpusmill.sources import documents as src
from corpusmill.sources import sinks
from corpusmill.streaming import ingest


def test_ranks_and_sums_of_hot_groups(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "a", "a", None, "b"]), rng.randint(0, 9)) for i in range(5000)]
    df = spark.createDataFrame(rows, "id long, g string, n long").repartition(5)
    got = {r.id: (r._rank, r._before, r._rows) for r in sampling.ranked(df, ["id"], ["g"], F.col("n")).collect()}
    rank, before, total = {}, {}, {}
    for _, g, _ in rows:
        total[g] = total.get(g, 0) + 1
    for i, g, n in rows:
        assert got[i] == (rank.get(g, 0), before.get(g, 0), total[g])
        rank[g], before[g] = rank.get(g, 0) + 1, before.get(g, 0) + n
    assert sampling.ranked(df.where("false"), ["id"]).collect() == []


def test_smoothing_over_blocks(spark):
    rng = random.Random(2)
    values = [rng.random() for _ in range(1000)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "step long, value double")
    got = {r.step: r.smooth for r in logs.smoothed(df, "value").collect()}
    m = None
    for i, v in enumerate(values):
        m = v if m is None else 0.95 * m + 0.05 * v
        assert got[i] == pytest.approx(m, rel=1e-12)


def test_runs_are_told_by_their_words(spark):
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choices("abc", k=rng.randint(0, 30)))) for i in range(200)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = ngrams.grams(df, "doc_id", ngrams.plain_words(F.col("text")), 4, 2).collect()
    words = {i: t.split() for i, t in docs}
    assert {(r.doc_id, r.at) for r in rows} == {(i, k) for i, w in words.items() for k in range(0, len(w) - 3, 2)}
    key = {}
    for r in rows:
        assert key.setdefault((r.a, r.b), words[r.doc_id][r.at : r.at + 4]) == words[r.doc_id][r.at : r.at + 4]
    assert len(key) == len({tuple(words[r.doc_id][r.at : r.at + 4]) for r in rows})


def test_titles_are_decomposed(spark):
    titles = ["Café résumé", "ﬁne Ⅷ ½ x²", "ÅNGSTRÖM—Units", "", None, "plain Title 2"]
    df = spark.createDataFrame([(t,) for t in titles], "t string").select(tx.title_form("t").alias("f"))
    assert [r.f for r in df.collect()] == [re.sub(r"[^a-z0-9]+", " ", unicodedata.normalize("NFKD", t or "").lower()).strip() for t in titles]


def test_row_keys_hold(spark, tmp_path):
    spark.range(1000).repartition(7).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    one = {r.id: r.k for r in numbered(df, "k").collect()}
    two = {r.id: r.k for r in numbered(df.where("id % 2 = 0"), "k").repartition(3).collect()}
    assert len(set(one.values())) == 1000 and all(one[i] == k for i, k in two.items())
    shuffled = numbered(df.repartition(5), "k")
    assert sorted(shuffled.collect()) == sorted(shuffled.collect())
    assert spread(df).count() == 1000


def test_vocabulary(spark, tmp_path):
    texts = spark.createDataFrame([(1, "low lower lowest 123 日本 <|end|> x"), (2, None), (3, "low<|end|><|end|>")], "doc_id long, text string")
    trained = tokenizer.train_on(texts, 280)
    v = tokenizer.Vocabulary(trained.tokens, {"<|end|>": len(trained.tokens)})
    assert all(r.passed for r in tokenizer.verify(texts, v).collect())
    plain = {r.doc_id: r.ids for r in tokenizer.encode(texts, v, eos=9).collect()}
    special = {r.doc_id: r.ids for r in tokenizer.encode(texts, v, specials=True).collect()}
    end = v.specials["<|end|>"]
    assert end not in plain[1] and plain[2] == [9] and special[1].count(end) == 1 and special[3][-2:] == [end, end]
    assert v.decode(special[3]) == "low<|end|><|end|>"
    with pytest.raises(ValueError):
        tokenizer.train_on(texts, 280, most_pieces=3)
    path = tmp_path / "v.tok"
    path.write_text("\n".join(v.lines()))
    tokenizer.require_frozen(str(path), hashlib.sha256(path.read_bytes()).hexdigest())
    with pytest.raises(ValueError):
        tokenizer.require_frozen(str(path), "0" * 64)


def test_long_pieces_merge_as_short_ones_do():
    rng = random.Random(4)
    v = tokenizer.Vocabulary(tokenizer.train([("".join(rng.choices("ab", k=8)), 1 + i % 3) for i in range(50)], 300))

    def plain(piece):
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            rank, at = min((v.ids.get(a + b, 1 << 60), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return tuple(v.ids[p] for p in parts)

    for n in (0, 1, 2, 7, 40, 300):
        for _ in range(20):
            piece = "".join(rng.choices("abc", k=n)).encode()
            assert v._merge(piece) == plain(piece)
    began = time.monotonic()
    v._merge(b"ab" * 50_000)
    assert time.monotonic() - began < 5


def test_file_digests(spark):
    folder = "/root/testdata/sf0.001"
    got = {r.file: (r.bytes, r.sha256) for r in QUERIES["file_digests"](spark, folder).collect()}
    for name, (size, digest) in got.items():
        data = open(f"{folder}/{name}", "rb").read()
        assert (size, digest) == (len(data), hashlib.sha256(data).hexdigest())
    assert set(got) == {f"{x}.parquet" for x in ("region", "nation", "benchmark", "labels")}


def test_written_once(spark, tmp_path):
    mark = sinks.fingerprint(source="a", size=3)
    assert mark != sinks.fingerprint(source="a", size=4)
    path = f"{tmp_path}/out"
    assert sinks.write_once(lambda: spark.range(3), path, mark, spark)
    assert not sinks.write_once(lambda: 1 / 0, path, mark, spark)
    assert sinks.write_once(lambda: spark.range(4), path, sinks.fingerprint(size=4), spark)
    assert spark.read.parquet(path).count() == 4
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", sinks.stamped(spark.range(1)).first().written_at)


def test_first_files_and_pdf(spark, tmp_path):
    for name, data in (("b.pdf", b"%PDF-1.4 x"), ("a.pdf", b"<html>"), ("c.pdf", b"%PDF" + b"x" * 100)):
        (tmp_path / name).write_bytes(data)
    assert [r.file.rsplit("/")[-1] for r in src.pdf_files(spark, str(tmp_path), 50).collect()] == ["b.pdf"]
    assert src.first_files(["b", "a", "b", "c"], 2) == ["a", "b"] and src.first_files(["b", "a"], None) == ["a", "b"]
    for name in "xyz":
        (tmp_path / f"t{name}.txt").write_text(f"line of {name}\n")
    domain = build.Domain("d", f"{tmp_path}/t*.txt", "line", max_files=2)
    assert sorted(r.text for r in build.read_domain(spark, domain).collect()) == ["line of x", "line of y"]


def test_metrics_log(spark, tmp_path):
    path = tmp_path / "metrics.jsonl"
    path.write_text('{"step": 1, "loss": 2.5}\n\nnot json\n{"step": 2, "loss": 2.0, "val_loss": 2.1}\n')
    assert [(r.step, r.val_loss) for r in logs.read_metrics(spark, str(path)).orderBy("step").collect()] == [(1, None), (2, 2.1)]


def test_stop_file(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/in")
    stream = ingest.new_files(spark, f"{tmp_path}/in", "id long")
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").start(f"{tmp_path}/out")
    query.processAllAvailable()
    assert not ingest.stop_when(query, f"{tmp_path}/STOP", every=0.2, timeout=0.5)
    (tmp_path / "STOP").write_text("")
    assert ingest.stop_when(query, f"{tmp_path}/STOP", every=0.2, timeout=20) and not query.isActive
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3
