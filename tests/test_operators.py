"""Duplicates, samples, splits, joins and accounting: literals, invariance and conservation."""

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import dedup, evals, logs, ngrams, sampling, sft
from corpusmill.plans import catalogue

SF = "/root/testdata/sf0.001"


def greedy(docs, k=12, stride=1, threshold=0.3):
    """The plain ordered pass."""
    kept, exact, seen = [], set(), set()
    for i, text in docs:
        key, w = " ".join(text.lower().split()), text.lower().split()
        s = {" ".join(w[j : j + k]) for j in range(len(w) - k + 1)}
        if key in exact or (s and len(s & seen) >= threshold * len(s)):
            continue
        exact.add(key)
        seen |= s
        kept.append(i)
    return kept


def test_near_duplicates_as_an_ordered_pass(spark):
    w = [f"w{i}" for i in range(2000)]
    base = w[:200]
    docs = [(1, " ".join(base)), (2, " ".join(base).upper()), (3, " ".join(["head", *base, "foot"])), (4, " ".join(base[:150])), (5, " ".join(base[:40] + w[300:460])), (6, "short one"), (7, "Short  one"), (8, "short two"), (9, " ".join(w[300:460] + w[900:960]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r.doc_id for r in dedup.near_duplicates(df, stride=1).collect()) == greedy(docs)


def test_reasons_conserve(spark):
    docs = spark.createDataFrame([(1, "a" * 30, "s"), (2, "A" * 30, "s"), (3, "b", "s"), (4, "�" * 5, "s"), (5, "  ", "s"), (6, "c" * 30, "t"), (7, "a" * 30, "t")], "doc_id long, text string, source string")
    got = {r.source: r.asDict() for r in dedup.report(docs, least_chars=20).collect()}
    assert got["s"] == {"source": "s", "n_in": 4, "n_kept": 1, "n_duplicate": 1, "n_broken": 1, "n_short": 1}
    assert got["t"]["n_in"] == 2 and got["t"]["n_duplicate"] == 1


def test_any_key(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "y"), (4, "c", "y"), (5, None, "x")], "i long, k1 string, k2 string")
    assert sorted(r.i for r in dedup.first_by_any_key(df, ["k1", "k2"], "i").collect()) == [1, 3]


@pytest.mark.parametrize("name", ["dedup_report", "hash_split3", "stable_pick_per_group", "contamination_status", "sft_reasons", "grouping_sets_summary"])
def test_partitioning_does_not_matter(spark, name):
    out = []
    for n in ("1", "17"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out.append(sorted(map(str, catalogue.QUERIES[name](spark, SF).collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert out[0] == out[1]


def test_spread_is_no_prefix(spark):
    df = spark.range(80).withColumn("b", F.floor(F.col("id") / 10))
    assert {r.b for r in sampling.spread_blocks(df, F.col("b"), 8, 0.25).collect()} == {2, 6}


def test_fixed_count_split(spark):
    df = spark.range(100).withColumn("g", F.lit(1))
    assert sampling.fixed_count_split(df, F.col("id").cast("string"), 0.1).where("split = 'val'").count() == 10
    assert sampling.fixed_count_split(spark.range(2), F.col("id").cast("string"), 0.1).where("split = 'val'").count() == 1
    with pytest.raises(ValueError):
        sampling.fixed_count_split(df, F.col("id"), 1.5)


def test_contradictions_and_duplicates(spark):
    rows = [(1, "p", "r", None), (2, "P ", "R", None), (3, "p", "other", None), (4, "q", "x 1", "1"), (5, "q", "x 2", "2"), (6, "z", "<|user|> x", None), (7, "n", "it is 5", "6"), (8, "long", "y" * 5000, None)]
    got = {r.id: r.reason for r in sft.account(spark.createDataFrame(rows, "id long, prompt string, response string, answer string")).collect()}
    assert got == {1: "kept", 2: "duplicate", 3: "duplicate_prompt", 4: "contradictory", 5: "contradictory", 6: "special_text", 7: "answer_mismatch", 8: "too_long"}


def test_leaks(spark):
    words = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(1, " ".join(words[:20])), (2, " ".join(f"v{i}" for i in range(20))), (3, "too short"), (4, " ".join([*words[40:53], *[f"u{i}" for i in range(30)]]))], "item_id long, text string")
    docs = spark.createDataFrame([(7, " ".join(words))], "doc_id long, text string")
    got = {r.item_id: (r.status, r.matched) for r in ngrams.leak_status(ngrams.item_hits(items, docs)).collect()}
    assert got == {1: ("leaked", 8), 2: ("clean", 0), 3: ("too_short", None), 4: ("partial", 1)}


def test_preferences(spark):
    variants = spark.createDataFrame([("t", i, f"text {i}", 1 if i % 2 == 0 else 3, i // 2) for i in range(4)], "topic string, i int, text string, detail int, formal int")
    pairs = evals.preference_pairs(variants)
    assert pairs.count() == 12 and pairs.where("conflicting").count() == 10
    assert evals.condition_blind_ceiling(pairs).first()["ceiling"] == pytest.approx(8 / 12)


def test_smoothed(spark):
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate([10, 0, 0])], "run string, step long, value double")
    assert [round(r.smooth, 4) for r in logs.smoothed(df, "value", by="run").orderBy("step").collect()] == [10.0, 9.5, 9.025]


def test_asof(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("b", 10, 1)], "k string, t long, v long")
    assert {(r.k, r.t): r.asof_v for r in logs.asof_join(left, right, "k", "t", "v").collect()} == {("a", 5): 50, ("a", 1): None, ("b", 9): None}
