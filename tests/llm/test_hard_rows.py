"""Null, empty, very long, tied and repeated rows, empty tables and clashing columns, for each operator and stage."""

import public_tokenizers
import pytest

import corpus_pipeline
from corpusmill.llm import decontaminate, langid, linededup, mixing, pii, quality, simhash, tiffpages, tokenids, warczip

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def benchmark(spark):
    text = "two three four five six seven eight nine ten eleven twelve thirteen fourteen"
    return spark.createDataFrame([(1, text), (2, "Und mehr é"), (3, None), (None, text), (4, "")], "item_id long, text string")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (8, None, 0), (None, 1, 1), (99, 0, 0)], "doc_id long, quality int, toxic int")


def operators(benchmark, labels):
    return {
        "decontaminate": lambda d: decontaminate.report(d, benchmark),
        "quality": lambda d: quality.report(d, labels),
        "lines": linededup.report,
        "tokens": lambda d: tokenids.encode_and_report(d, TOKENIZER),
        "mixing": mixing.report,
        "simhash": simhash.report,
        "langid": langid.report,
        "tiff": tiffpages.report,
        "pii": pii.report,
    }


@pytest.mark.parametrize("name", ["decontaminate", "quality", "lines", "tokens", "mixing", "simhash", "langid", "tiff", "pii"])
def test_a_row_for_each_document(name, hard, clashing, empty, benchmark, labels):
    run = operators(benchmark, labels)[name]
    got = sorted(map(str, run(hard).collect()))
    assert len(got) == 10
    assert sorted(map(str, run(clashing).collect())) == got
    assert run(empty).collect() == []


def test_stages(spark, hard, clashing, empty, tmp_path, benchmark):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        for docs in (hard, clashing, empty):
            out = stage(spark, docs, str(tmp_path))
            assert name == "token_ids" or out.columns == docs.columns
            out.collect()


def test_decontaminate_values(hard, benchmark):
    got = {r.doc_id: r for r in decontaminate.report(hard, benchmark).collect()}
    assert (got[1].n_words, got[1].n_hit, got[1].n_items, got[1].contaminated) == (14, 13, 1, True)
    assert got[1].items_sha256 == decontaminate.items_digest(["1"])
    assert (got[2].n_words, got[2].n_hit, got[2].contaminated) == (0, 0, False)
    assert (got[7].n_hit, got[7].n_items) == (3, 1)
    in_blocks = decontaminate.find_hits(hard, benchmark, block_bytes=20)
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in in_blocks.collect()) == sorted((str(r.doc_id), r.n_words, r.n_hit, r["items"]) for r in decontaminate.find_hits(hard, benchmark).collect())


def test_pages(spark):
    page = "<p>" + "x" * 2000
    rows = [(1, "u", page), (2, None, page), (3, "u", None), (None, "u", page), (4, "u\nv", "short"), (5, "u", "short"), (2, None, page)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS kept", "'x' AS payload")
    got = sorted((str(r.page_id), r.record_type, r.refers_to, r.payload_bytes) for r in warczip.archive_and_read(pages).collect())
    n = len(page)
    assert got == sorted([("1", "revisit", 2, n), ("2", "response", None, n), ("2", "response", None, n), ("3", "response", None, 0), ("None", "revisit", 2, n), ("4", "response", None, 5), ("5", "response", None, 5)])
    assert warczip.archive_and_read(pages.where("false")).collect() == []


def test_redact(hard):
    got = {r.doc_id: r.text for r in pii.redact(hard).collect()}
    assert got[None] == "a null id, mail [EMAIL] or [PHONE]"
    assert got[7].endswith("[CARD]")


def test_lines_removed(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i j\n\nkeep this"), (2, "a b c d e f g h i k\nj i h g f e d c b a\nKEEP this\nnew line here")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in linededup.remove_repeated_lines(docs).collect()}
    assert got == {1: "a b c d e f g h i j\n\nkeep this", 2: "new line here"}
