"""Splitters, containers, token files, the tokenizer and streams."""

import gzip
import io
import json
import random
import tarfile
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import tokenizer
from corpusmill.sources import documents as src
from corpusmill.sources import tok1
from corpusmill.streaming import ingest


def split(spark, splitter, text):
    return spark.createDataFrame([(text,)], "t string").select(splitter(F.col("t")).alias("x")).first()["x"]


def test_splitters(spark):
    assert split(spark, src.by_line, "a\r\n\n  \nb") == ["a", "b"]
    assert split(spark, src.by_blank_lines, "a\nb\n\n \nc\n") == ["a\nb", "c"]
    assert split(spark, src.by_markers, "junk\n<|document|>\none\n<|endofdocument|>\nx\n<|document|>\ntwo\n<|document|>\nthree") == ["one", "two", "three"]
    assert split(spark, src.by_separator, "a\n\nb\n<|endoftext|>\nc\n<|endoftext|>\n") == ["a\n\nb", "c"]
    assert split(spark, lambda t: src.by_header(t, "h-"), "h-1\na\nh-2\nb") == ["a", "b"]
    assert split(spark, src.trimmed_slice, "tail\nwhole 1\nwhole 2\nhead") == "whole 1\nwhole 2"


@pytest.mark.parametrize(
    ("properties", "text"),
    [
        ({"code_content": " x = 1 "}, "x = 1"),
        ({"question": "What is 2+2?", "answer": "4"}, "Question: What is 2+2?\n\nAnswer: 4"),
        ({"question": "q", "answer": "a", "options": '["x", "y"]', "explanation": "why"}, "Question: q\n\nOptions:\n- x\n- y\n\nAnswer: a\n\nExplanation: why"),
        ({"question": "q", "answer": "a", "options": [], "explanation": "Source origin: z"}, "Question: q\n\nAnswer: a"),
        ({"objective_prompt": "o", "sketch_extrude_completion": "s"}, "Objective: o\n\nCompletion:\ns"),
        ({"cadquery_code": "c", "qa_pairs": [{"question": "q", "answer": "a"}, {"q": "r", "a": "b"}, {"q": "x"}]}, "d\n\nc\n\nQ: q\nA: a\n\nQ: r\nA: b"),
        ({"text": 5}, "d"),
        ([1], "d"),
    ],
)
def test_entity_text(spark, properties, text):
    df = spark.createDataFrame([("d", json.dumps(properties))], "d string, p string")
    assert df.select(src.entity_text(F.col("d"), F.col("p")).alias("x")).first()["x"] == text


def test_broken_entity(spark):
    df = spark.createDataFrame([("d", "{bad"), (None, None)], "d string, p string")
    assert [r.x for r in df.select(src.entity_text(F.col("d"), F.col("p")).alias("x")).collect()] == ["d", ""]


def test_articles_in_a_zip(spark, tmp_path):
    article = lambda i, lang, body: f"<PubmedArticle><PMID>{i}</PMID><Language>{lang}</Language><ArticleTitle>T{i}</ArticleTitle><Abstract>{body}</Abstract></PubmedArticle>"
    body = "<AbstractText Label='METHODS'>Some <i>italic</i> words.</AbstractText><AbstractText>More.</AbstractText>"
    xml = f"<S>{article(1, 'eng', body)}{article(2, 'eng', '')}{article(3, 'fre', body)}</S>".encode()
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("m.xml.gz", gzip.compress(xml))
    members = src.archive_members(spark, f"{tmp_path}/a.zip", "zip")
    got = src.articles(members, "bio", least=5).collect()
    assert [(r.doc_id, r.text) for r in got] == [("1", "T1\n\nMethods: Some italic words.\nMore.")]
    assert src.articles(members, "bio", least=5, english=False).count() == 2


def test_tar(spark, tmp_path):
    with tarfile.open(tmp_path / "a.tar", "w") as t:
        info = tarfile.TarInfo("d/x.py")
        info.size = 3
        t.addfile(info, io.BytesIO(b"abc"))
    assert [(r.member, bytes(r.content)) for r in src.archive_members(spark, f"{tmp_path}/a.tar", "tar").collect()] == [("d/x.py", b"abc")]


def test_items_and_manifest(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x"}\n{"id": "y"}\n')
    assert {r.id for r in src.eval_items(spark, str(tmp_path)).collect()} == {"x", "y"}
    expected = spark.createDataFrame([("a.jsonl", "0"), ("b.jsonl", "1")], "file string, expected string")
    assert src.manifest_problems(spark, str(tmp_path), expected).count() == 2
    (tmp_path / "b.jsonl").write_text('{"id": "x"}\n')
    with pytest.raises(ValueError):
        src.eval_items(spark, str(tmp_path))
    with pytest.raises(ValueError):
        src.expect_files(spark.read.text(str(tmp_path)), 5)


def test_token_files(spark, tmp_path):
    ids = np.array([5, 6, 9, 7, 9, 9, 1, 2], np.int64)
    path = f"{tmp_path}/a.bin"
    tok1.write_tokens(path, ids, 10, 9)
    assert (tmp_path / "a.bin").stat().st_size == 36 + 16
    spark.dataSource.register(tok1.TokenFiles)
    for span in (1, 2, 3, 100):
        rows = spark.read.format("tok1").option("span", span).load(path).orderBy("doc").collect()
        assert [r.ids for r in rows] == [[5, 6, 9], [7, 9], [9], [1, 2]]
    assert tok1.problems(path) == ["the last document isn't ended"]
    with pytest.raises(ValueError):
        tok1.write_tokens(path, np.array([10]), 10, 9)
    (tmp_path / "b.bin").write_bytes(b"x" * 50)
    with pytest.raises(ValueError):
        tok1.read_header(f"{tmp_path}/b.bin")


def test_token_sink_and_merge(spark, tmp_path):
    spark.dataSource.register(tok1.TokenFiles)
    df = spark.createDataFrame([([1, 2, 9],), ([3, 9],)], "ids array<int>").coalesce(1)
    df.write.format("tok1").option("vocab", 10).option("eos", 9).mode("append").save(f"{tmp_path}/out")
    back = spark.read.format("tok1").load(f"{tmp_path}/out")
    assert sorted(r.ids for r in back.collect()) == [[1, 2, 9], [3, 9]]
    tok1.write_tokens(f"{tmp_path}/x.bin", np.array([5, 9]), 10, 9)
    tok1.write_tokens(f"{tmp_path}/y.bin", np.array([7, 9]), 10, 9)
    assert tok1.merge([f"{tmp_path}/x.bin", f"{tmp_path}/y.bin"], f"{tmp_path}/z.bin") == 4
    tok1.write_tokens(f"{tmp_path}/w.bin", np.array([7, 9]), 11, 9)
    with pytest.raises(ValueError):
        tok1.merge([f"{tmp_path}/x.bin", f"{tmp_path}/w.bin"], f"{tmp_path}/q.bin")


def test_pieces(spark):
    df = spark.createDataFrame([("Hello, world!",), ("it's  2 x",)], "text string")
    got = [r.p for r in df.select(tokenizer.pieces(F.col("text")).alias("p")).collect()]
    assert got == [["Hello", ",", " world", "!"], ["it", "'s", " ", " 2", " x"]]


def test_bpe(spark):
    texts = spark.createDataFrame([("low lower lowest " * 5,), ("newer wider 1234 1234",)], "text string")
    v = tokenizer.train_on(texts, 300, least_piece=1, split_digits=True)
    assert v.tokens[:256] == [bytes([i]) for i in range(256)] and len(set(v.tokens)) == len(v.tokens)
    assert not any(a in b"0123456789" and b in b"0123456789" for t in v.tokens for a, b in zip(t, t[1:], strict=False))
    rng = random.Random(0)
    docs = spark.createDataFrame([(i, "".join(rng.choices("low erst\n 12é😀'", k=20))) for i in range(200)], "doc_id long, text string")
    assert tokenizer.round_trip_failures(docs, v).count() == 0
    v.specials = {"<|endoftext|>": len(v.tokens)}
    again = tokenizer.Vocabulary.parse(v.lines())
    assert again.tokens == v.tokens and again.specials == v.specials
    forged = tokenizer.encode(spark.createDataFrame([(1, "<|endoftext|>")], "doc_id long, text string"), v).first()
    assert len(v.tokens) not in forged.ids


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, "A b"), (2, "a  B"), (3, "c")], "doc_id long, text string").write.parquet(f"{tmp_path}/in/1")
    stream = lambda: ingest.distinct_texts(ingest.new_files(spark, f"{tmp_path}/in/*", "doc_id long, text string"))
    run = lambda: ingest.run_available(stream(), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(120)
    run()
    spark.createDataFrame([(4, "C"), (5, "d")], "doc_id long, text string").write.parquet(f"{tmp_path}/in/2")
    run()
    assert sorted(r.text.lower().strip() for r in spark.read.parquet(f"{tmp_path}/out").collect())[-2:] == ["c", "d"]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 3


def test_event_windows(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.write.parquet(f"{tmp_path}/e/1")
    s = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/e/*")
    q = ingest.counted_windows(s, "ts", "1 hour", "1 day").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.sql("SELECT sum(n) AS n FROM w").first()["n"] == events.count()


def test_spread_slices(spark, tmp_path):
    lines = [f"line {i:05d}" for i in range(2000)]
    (tmp_path / "a.txt").write_text("\n".join(lines))
    got = {r.slice: r.text.split("\n") for r in src.spread_slices(spark, str(tmp_path), 4, 600).collect()}
    assert set(got) == {0, 1, 2, 3} and all(set(x) <= set(lines) for x in got.values())
    assert [int(got[k][0][5:]) // 500 for k in range(4)] == [0, 1, 2, 3]
