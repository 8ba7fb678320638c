"""Evaluation roll-ups: grouping sets with intervals, pivots, distractors, run comparison, calibration, preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays, stats

COUNTED = ("n", "acc_norm", "acc", "ci_low", "ci_high", "chance", "above_chance")


def _summary(prefix: str = "") -> list[Column]:
    n, hits = F.count(F.lit(1)), F.sum(F.col("correct_norm").cast("int"))
    low, high = stats.wilson(hits.cast("double"), n)
    chance = F.avg("chance")
    return [n.alias("n"), (hits / n).alias("acc_norm"), F.avg(F.col("correct").cast("double")).alias("acc"), low.alias("ci_low"), high.alias("ci_high"), chance.alias("chance"), (low - chance > 1e-12).alias("above_chance")]


def summarise(records: DataFrame, *keys: Column) -> DataFrame:
    """Accuracy, its interval and chance by any keys."""
    return records.groupBy(*keys).agg(*_summary())


def grouped_summary(records: DataFrame) -> DataFrame:
    """Overall, by domain, by domain and level, by type and by skill (where it is known), in one pass of grouping sets."""
    sets = [[], ["domain"], ["domain", "level"], ["type"], ["skill"]]
    columns = ["domain", "level", "type", "skill"]
    level = F.grouping_id()
    out = records.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in columns]).agg(level.alias("grouping"), *_summary())
    by_skill = sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c != "skill")
    return out.where((F.col("grouping") != by_skill) | F.col("skill").isNotNull())


def pivot_accuracy(records: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """A column for each value: the share that is right, null where there is none."""
    return records.groupBy(row).pivot(column, values).agg(F.avg(F.col("correct_norm").cast("double")))


def distractors(items: DataFrame) -> DataFrame:
    """(kind, offered, picked, rate): how often wrong options of each kind are offered and picked."""
    rows = items.select("answer", "pick", F.posexplode("kinds").alias("at", "kind")).where(F.col("at") != F.col("answer"))
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("offered"), F.count(F.when(F.col("at") == F.col("pick"), 1)).alias("picked")).withColumn("rate", F.col("picked") / F.col("offered"))


def longest_option_bias(items: DataFrame) -> DataFrame:
    """One row: how often the longest option, the first on a tie, is the answer and the pick."""
    longest = arrays.first_argmax(F.transform("choices", F.length))
    return items.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(longest == F.col("answer"), 1)).alias("longest_is_answer"), F.count(F.when(longest == F.col("pick"), 1)).alias("longest_is_pick"))


def compare_guard(ref: DataFrame, new: DataFrame) -> DataFrame:
    """Ids that only one run has."""
    only = ref.select("id", F.lit(1).alias("in_ref")).join(new.select("id", F.lit(1).alias("in_new")), "id", "full")
    return only.where(F.col("in_ref").isNull() | F.col("in_new").isNull())


def compare_runs(ref: DataFrame, new: DataFrame) -> DataFrame:
    """By domain and, with a null domain, in all: items whose verdict changed, gained, lost, and picks that changed."""
    both = ref.select("id", "domain", F.col("correct_norm").alias("a"), F.col("pick").alias("pa")).join(new.select("id", F.col("correct_norm").alias("b"), F.col("pick").alias("pb")), "id")
    count = lambda c: F.count(F.when(c, 1))
    return both.rollup("domain").agg(
        F.count(F.lit(1)).alias("n"), count(F.col("a")).alias("ref_right"), count(F.col("b")).alias("new_right"), count(F.col("a") != F.col("b")).alias("changed"),
        count(~F.col("a") & F.col("b")).alias("gained"), count(F.col("a") & ~F.col("b")).alias("lost"), count(F.col("pa") != F.col("pb")).alias("pick_changed"),
    )


def upper_median(df: DataFrame, value: Column, *by: str) -> DataFrame:
    """The element at floor(n / 2), from 0, of the sorted values.

    By rank, not by a collected list, so that a group may be of any size.
    """
    rows = df.select(*by, value.alias("_v")).where("_v is not null")
    w = Window.partitionBy(*by)
    ranked = rows.withColumns({"_n": F.count(F.lit(1)).over(w), "_r": F.row_number().over(w.orderBy("_v"))})
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).select(*by, F.col("_v").alias("upper_median"))


def calibration(predictions: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, confidence, accuracy) of predictions (confidence, hit)."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    return predictions.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg(F.col("hit").cast("double")).alias("accuracy"))


def expected_calibration_error(predictions: DataFrame, bins: int = 10) -> DataFrame:
    rows = calibration(predictions, bins)
    return rows.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"), F.sum("n").alias("n"))


def leak_rollup(status: DataFrame) -> DataFrame:
    """Items of each status by domain and source, with sub-totals."""
    count = lambda s: F.count(F.when(F.col("status") == s, 1)).alias(s)
    return status.rollup("domain", "source").agg(*[count(s) for s in ("leaked", "partial", "clean", "too_short")])


# Preference pairs: variants of a topic, ranked by three criteria.
CONDITIONS = ("helpful", "concise", "formal")


def preferred(condition: Column, detail_a: Column, detail_b: Column, formal_a: Column, formal_b: Column) -> Column:
    """0 or 1 for the variant that a criterion prefers, null for a tie."""
    detailed = F.when(detail_a != detail_b, F.when(detail_a > detail_b, 0).otherwise(1))
    by_form = F.when(formal_a != formal_b, F.when(formal_a > formal_b, 0).otherwise(1))
    return F.when(condition == "helpful", detailed).when(condition == "concise", 1 - detailed).when(condition == "formal", by_form)


def preference_pairs(variants: DataFrame) -> DataFrame:
    """(prompt, condition, chosen, rejected, conflicting) of all unordered pairs of a topic's variants.

    ``variants`` is (topic, i, text, detail, formal): a topic has a few of them, so pairs are few as well.
    """
    a, b = variants.alias("a"), variants.alias("b")
    pairs = a.join(b, (F.col("a.topic") == F.col("b.topic")) & (F.col("a.i") < F.col("b.i")))
    pairs = pairs.withColumn("winners", F.array(*[preferred(F.lit(c), F.col("a.detail"), F.col("b.detail"), F.col("a.formal"), F.col("b.formal")) for c in CONDITIONS]))
    rows = pairs.select("a.topic", F.col("a.text").alias("ta"), F.col("b.text").alias("tb"), "winners", F.posexplode("winners").alias("at", "winner")).where("winner is not null")
    other = F.exists("winners", lambda w: w.isNotNull() & (w != F.col("winner")))
    condition = F.element_at(F.array(*[F.lit(c) for c in CONDITIONS]), F.col("at") + 1)
    first = F.col("winner") == 0
    return rows.select(F.col("topic").alias("prompt"), condition.alias("condition"), F.when(first, F.col("ta")).otherwise(F.col("tb")).alias("chosen"), F.when(first, F.col("tb")).otherwise(F.col("ta")).alias("rejected"), other.alias("conflicting"))


def condition_blind_ceiling(pairs: DataFrame) -> DataFrame:
    """One row: the greatest accuracy of a model that ignores the criterion."""
    key = ["prompt", F.least("chosen", "rejected").alias("x"), F.greatest("chosen", "rejected").alias("y")]
    groups = pairs.groupBy(*key).agg(F.count(F.when(F.col("chosen") == F.least("chosen", "rejected"), 1)).alias("k"), F.count(F.lit(1)).alias("n"))
    return groups.agg((F.sum(F.greatest(F.col("k"), F.col("n") - F.col("k"))) / F.sum("n")).alias("ceiling"), F.sum("n").alias("pairs"))


def surface_accuracy(pairs: DataFrame) -> DataFrame:
    """One row: how often lengths and contractions alone pick the chosen text."""
    def formality(t: str) -> Column:
        items = F.filter(F.split(t, r"\s+"), lambda w: w != "")
        mean = F.length(F.array_join(items, "")) / F.greatest(F.size(items), F.lit(1))
        return F.struct((-F.regexp_count(F.col(t), F.lit(r"'(?:re|ve|ll|s|t|m|d)\b"))).alias("c"), mean.alias("m"))

    longer = F.length("chosen") > F.length("rejected")
    shorter = F.length("chosen") < F.length("rejected")
    right = F.when(F.col("condition") == "helpful", longer).when(F.col("condition") == "concise", shorter).otherwise(formality("chosen") > formality("rejected"))
    return pairs.agg(F.avg(right.cast("double")).alias("accuracy"))
