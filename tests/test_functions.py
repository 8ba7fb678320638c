"""Column functions against literals."""

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import arrays, stats
from corpusmill.functions import text as tx
from corpusmill.operators import filters


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()], F.lit(0).alias("_z"))
    return row.select(column.alias("x")).first()["x"]


def test_normal_form(spark):
    assert one(spark, tx.normal_form("t"), t="  A\t b C\x1c\n ") == "a b c"
    assert one(spark, tx.title_form("t"), t="The (Best) Title!") == "the best title"


@pytest.mark.parametrize(("text", "number"), [("17 * 24 = 408", 408.0), ("The answer is 1,234.5.", 1234.5), ("nothing", None), ("first 3 then 4", 4.0), ("Answer: -2e3", -2000.0)])
def test_final_number(spark, text, number):
    assert one(spark, tx.final_number("t"), t=text) == number


def test_clean_and_truncate(spark):
    assert one(spark, tx.basic_clean("t"), t="﻿ a\r\nb\r\n\n\n\nc \n") == "a\nb\n\nc"
    cut = one(spark, tx.boundary_truncate("t", 10, 5), t="aaaa bbbb cccc")
    assert (cut["text"], cut["cut"]) == ("aaaa bbbb", True)
    assert one(spark, tx.boundary_truncate("t", 10, 5), t="a" * 20)["text"] == "a" * 10


def test_code_block(spark):
    assert one(spark, tx.code_block("t"), t="x\n```py\na = 1\n```\ny") == "a = 1"
    assert one(spark, tx.code_block("t"), t="\na = 1\n") == "a = 1"


def test_repetition(spark):
    a = F.split(F.lit("a b a b a b a b"), " ")
    assert one(spark, arrays.distinct_ratio(a, 2)) == pytest.approx(2 / 7)
    assert one(spark, arrays.repetition_loop(F.array_repeat(F.lit("a"), 24))) is True
    assert one(spark, arrays.repetition_loop(F.array_repeat(F.lit("a"), 23))) is False
    assert one(spark, arrays.distinct_ratio(F.array(F.lit("a")), 2)) == 0.0


def test_nucleus_keeps_the_item_that_crosses(spark):
    logits = F.array(*[F.log(F.lit(p)) for p in (0.5, 0.3, 0.15, 0.05)])
    kept = one(spark, F.transform(arrays.top_p(logits, 0.7), lambda x: x.isNotNull()))
    assert kept == [True, True, False, False]
    assert [x is not None for x in one(spark, arrays.top_k(logits, 1))] == [True, False, False, False]


def test_banned_next(spark):
    assert one(spark, arrays.banned_next(F.array(*map(F.lit, [1, 2, 3, 1, 2, 4, 1, 2])), 3)) == [3, 4]


def test_wilson(spark):
    low, high = stats.wilson(F.lit(8.0), F.lit(10))
    assert one(spark, F.round(low, 4)) == pytest.approx(0.4902, abs=1e-3)
    assert one(spark, F.round(high, 4)) == pytest.approx(0.9433, abs=1e-3)
    assert one(spark, stats.wilson(F.lit(0.0), F.lit(0), (0.0, 1.0))[1]) == 1.0


@pytest.mark.parametrize(("got", "want", "error"), [(5.0, 5.0, "correct"), (None, 5.0, "no_number"), (5000.0, 5.0, "unit_error (off by 10^3)"), (-5.0, 5.0, "sign_error"), (7.0, 5.0, "wrong_value")])
def test_number_error(spark, got, want, error):
    got = F.lit(got).cast("double")
    assert one(spark, stats.number_error(got, F.lit(want), F.lit(0.01), F.lit(False))) == error


def test_learning_rate(spark):
    rate = lambda s: one(spark, stats.learning_rate(F.lit(s), 1.0, 0.1, 10, 110))
    assert (rate(0), rate(9), rate(110), rate(500)) == (0.1, 1.0, 0.1, 0.1) and rate(60) == pytest.approx(0.55)


def test_quality_reason(spark):
    assert one(spark, filters.quality_reason(F.lit("too short"))) == "short"
    prose = "the neural operator of the field is that which we can see " * 200
    assert one(spark, filters.quality_reason(F.lit(prose))) is None
    assert one(spark, filters.quality_reason(F.lit("1234 5678 " * 1000))) == "low_alpha"
