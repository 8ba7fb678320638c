"""Splits and samples by hashes: the same rows in every run and on every layout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators.ngrams import small
from corpusmill.scratch import materialize


def unit_hash(key: Column, seed: str = "0") -> Column:
    """A number in [0, 1) from the first 32 bits of a SHA-256."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key), 256), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def bucket(key: Column, buckets: int) -> Column:
    """A bucket from the first 52 bits of a SHA-256."""
    return F.pmod(F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long"), F.lit(buckets))


def is_validation(key: Column, fraction: float) -> Column:
    """Membership by key alone: equal keys are on one side."""
    return bucket(key, 1_000_000) < round(fraction * 1_000_000)


def three_way(prompt: Column, seed: str, val: float, test: float) -> Column:
    """test, val or train, by the prompt's normal form."""
    u = unit_hash(tx.normal_form(prompt), seed)
    return F.when(u < test, "test").when(u < test + val, "val").otherwise("train")


def stable_pick(df: DataFrame, key: Column, cap: int, by: list[str] | None = None) -> DataFrame:
    """The first ``cap`` rows by SHA-1 of a key, in each group or in all."""
    ranked = df.withColumn("_h", F.sha1(key))
    if not by:
        return ranked.orderBy("_h").limit(cap).drop("_h")
    return ranked.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy("_h"))).where(F.col("_n") <= cap).drop("_h", "_n")


def ranked(df: DataFrame, order: list, by: list[str] | None = None, size: Column | None = None) -> DataFrame:
    """Adds, for each group, ``_rank`` (from 0), ``_before`` (the sizes of all earlier rows) and ``_rows`` (the group's rows).

    Rows are dealt by ranges of group and order and stored, so that ranges hold; ranks run inside ranges, and a row per range and group
    carries the sums of the ranges before it. A group with a third of all rows spreads over a third of the ranges.
    """
    groups = by or []
    keys = [f"_by{i}" for i in range(len(order))]
    rows = df.withColumns({k: F.col(o) if isinstance(o, str) else o for k, o in zip(keys, order, strict=True)}).withColumn("_size", F.lit(1) if size is None else F.coalesce(size, F.lit(0)))
    rows = materialize(rows.repartitionByRange(*groups, *keys).withColumn("_part", F.spark_partition_id()), "ranked")
    parts = rows.groupBy(*groups, "_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_size").alias("_s"))
    earlier = Window.partitionBy(*groups).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("_n").over(Window.partitionBy(*groups))
    parts = parts.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(groups)], F.col("_part").alias("_p"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_s").over(earlier), F.lit(0)).alias("_s0"), total.alias("_rows"))
    here = Window.partitionBy(*groups, "_part").orderBy(*keys)
    rows = rows.withColumns({"_rank": F.row_number().over(here) - 1, "_before": F.coalesce(F.sum("_size").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(groups):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    rows = rows.join(small(parts), same)
    return rows.withColumns({"_rank": F.col("_rank") + F.col("_n0"), "_before": F.col("_before") + F.col("_s0")}).select(*df.columns, "_rank", "_before", "_rows")


_RANKED = ("_rank", "_before", "_rows")


def fixed_count_split(df: DataFrame, key: Column, fraction: float, by: list[str] | None = None) -> DataFrame:
    """Adds ``split``: the first max(1, round(n f)) rows by hash are val, in each group; one row alone is train.

    Members differ from a permutation's; sizes are its.
    """
    if not 0 < fraction < 1:
        raise ValueError("fraction must lie between 0 and 1")
    rows = ranked(df, [F.sha1(key)], by)
    val = (F.col("_rows") >= 2) & (F.col("_rank") < F.greatest(F.lit(1), F.bround(F.col("_rows") * fraction)))
    return rows.withColumn("split", F.when(val, "val").otherwise("train")).drop(*_RANKED)


def every_kth(df: DataFrame, order: list, k: int, offset: int = 0) -> DataFrame:
    """Every k-th row of an order."""
    return ranked(df, order).where(F.pmod("_rank", F.lit(k)) == offset).drop(*_RANKED)


def strided_budget(df: DataFrame, size: Column, order: str, budget: int, seed: int = 0) -> DataFrame:
    """Every k-th row of an order, k such that the rows' sizes come to about ``budget``, up to the row that passes it."""
    total = df.agg(F.sum(size).alias("n")).first()["n"] or 0
    k = max(1, -(-total // budget))
    return until_budget(every_kth(df, [order], k, seed % k), size, order, budget)


def random_windows(sizes: DataFrame, size: str, width: int, draws: int, seed: str = "0") -> DataFrame:
    """(draw, start, columns of the file): ``draws`` windows of ``width`` and the next, uniform over all places of files laid end to end.

    ``sizes`` has a row per file, ordered by ``file``; files shorter than a window have none.
    """
    rows = sizes.withColumn("_places", F.greatest(F.col(size) - width, F.lit(0)))
    w = Window.orderBy("file")
    rows = rows.withColumn("_high", F.sum("_places").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_low", F.col("_high") - F.col("_places"))
    total = rows.agg(F.sum("_places").alias("n")).first()["n"] or 0
    at = F.floor(unit_hash(F.col("id").cast("string"), seed) * F.lit(total)).cast("long")
    picks = sizes.sparkSession.range(draws if total else 0).select(F.col("id").alias("draw"), at.alias("_at"))
    return picks.join(small(rows), (F.col("_at") >= F.col("_low")) & (F.col("_at") < F.col("_high"))).select("draw", (F.col("_at") - F.col("_low")).alias("start"), *sizes.columns)


def epoch_order(df: DataFrame, key: Column, epochs: int, seed: str = "0") -> DataFrame:
    """Adds ``epoch`` and ``hash``: ordered by both, every epoch is a shuffle of its own of all rows, the same in each run."""
    rows = df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return rows.withColumn("hash", F.sha1(F.concat(F.lit(f"{seed}:"), F.col("epoch").cast("string"), F.lit(":"), key)))


def topic_split(df: DataFrame, topic: str, fraction: float, seed: str = "0") -> DataFrame:
    """Adds ``split`` by topic: max(1, floor(n f)) of the n topics, by hash, are val with all their rows."""
    topics = ranked(df.select(topic).distinct(), [F.sha1(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(topic), F.lit(""))))])
    val = topics.where(F.col("_rank") < F.greatest(F.lit(1), F.floor(F.col("_rows") * fraction))).select(F.col(topic).alias("_topic"), F.lit(True).alias("_val"))
    return df.join(small(val), F.col(topic).eqNullSafe(F.col("_topic")), "left").withColumn("split", F.when(F.col("_val"), "val").otherwise("train")).drop("_topic", "_val")


def routed(df: DataFrame, source: str, control: list[str]) -> DataFrame:
    """Adds ``route``: sources held out as a control never train."""
    return df.withColumn("route", F.when(F.col(source).isin(control), "control").otherwise("train"))


def spread_blocks(df: DataFrame, block: Column, blocks: int, fraction: float) -> DataFrame:
    """Rows of evenly spaced blocks, never a prefix: the middles of max(1, round(f n)) equal spans of the block numbers."""
    k = max(1, round(fraction * blocks))
    return df.where(block.isin([int((i + 0.5) * blocks / k) for i in range(k)]))


def until_budget(df: DataFrame, size: Column, order: str, budget: int, by: list[str] | None = None, cross: bool = True) -> DataFrame:
    """Rows in order while the sizes before them are under the budget; ``cross`` keeps the row that passes it."""
    rows = ranked(df, [order], by, size)
    return rows.where(F.col("_before") < budget if cross else F.col("_before") + size <= budget).drop(*_RANKED)


def capped_mix(df: DataFrame, size: Column, group: str, order: str, cap: int, most: int = 5) -> DataFrame:
    """Of each group, the whole documents that end within ``cap``; a first one that is longer alone, cut at ``most`` caps.

    Adds ``taken``, the part of its size that is used.
    """
    rows = ranked(df, [order], [group], size)
    return rows.where((F.col("_before") + size <= cap) | (F.col("_rank") == 0)).withColumn("taken", F.least(size, F.lit(cap * most))).drop(*_RANKED)


def index_split(df: DataFrame, size: Column, group: str, order: str, every: int, cap: int) -> DataFrame:
    """Adds ``split`` (every k-th document of a group is val) and ``taken``: a cap on the group's size cuts the document that passes it."""
    rows = ranked(df, [order], [group], size).where(F.col("_before") < cap)
    return rows.withColumns({"split": F.when(F.col("_rank") % every == 0, "val").otherwise("train"), "taken": F.least(size, F.lit(cap) - F.col("_before"))}).drop(*_RANKED)


def weighted_draws(spark, weights: DataFrame, draws: int, seed: str = "0") -> DataFrame:
    """(draw, name): names drawn with replacement by their weights; the few weights are the size of a catalog."""
    total = F.sum("weight").over(Window.partitionBy())
    high = F.sum("weight").over(Window.orderBy("name").rowsBetween(Window.unboundedPreceding, 0)) / total
    parts = weights.select("name", high.alias("high"), (high - F.col("weight") / total).alias("low"))
    picks = spark.range(draws).select(F.col("id").alias("draw"), unit_hash(F.col("id").cast("string"), seed).alias("u"))
    return picks.join(small(parts), (F.col("u") >= F.col("low")) & (F.col("u") < F.col("high"))).select("draw", "name")


def epochs(weights: DataFrame, plan_tokens: int, most: float = 4.0) -> DataFrame:
    """How often each part of a mix is read: (name, weight, tokens) gain share, epochs and whether they are too many."""
    share = F.col("weight") / F.sum("weight").over(Window.partitionBy())
    rows = weights.withColumn("share", share)
    rows = rows.withColumn("epochs", F.col("share") * plan_tokens / F.greatest(F.col("tokens"), F.lit(1)))
    return rows.withColumn("too_many", F.col("epochs") > most)
