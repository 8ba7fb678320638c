"""Filtering stages keep exactly the rows that the operators' verdicts allow."""

from corpusmill.llm import decontaminate, langid


def test_decontaminate_drops_what_is_reported(spark, documents):
    benchmark = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    clean = {r.doc_id for r in decontaminate.report(documents, benchmark).where("NOT contaminated").collect()}
    assert 0 < len(clean) < documents.count()
    for block_bytes in (decontaminate.BLOCK_BYTES, 1000):
        kept = decontaminate.decontaminate(documents, benchmark, block_bytes)
        assert kept.schema == documents.schema and {r.doc_id for r in kept.collect()} == clean


def test_identified_keeps_what_is_told(spark, hard):
    told = {r.doc_id for r in langid.report(hard).where(f"lang_pred <> 'und' AND score >= {langid.LEAST_SCORE}").collect()}
    assert {r.doc_id for r in langid.identified(hard).collect()} == told and {2, 3, 4}.isdisjoint(told)
