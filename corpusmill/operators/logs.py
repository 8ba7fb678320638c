"""Training-log analytics: series by step, smoothing, best points, spikes, slopes, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrays import let

_BLOCK = 256


def smoothed(series: DataFrame, value: str, decay: float = 0.95, by: str | None = None, order: str = "step") -> DataFrame:
    """Adds ``smooth``: an exponential mean whose seed is the first value.

    The recurrence runs over one series at a time, in blocks: first what each block makes of its seed, then inside the
    blocks, so that work grows with the points. A log has a row per step, so a series fits an array.
    """
    key = [by] if by else []
    rows = series.where(F.col(value).isNotNull())
    lists = rows.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_s"))
    next_ = lambda last, x: F.when(last.isNull(), x[value].cast("double")).otherwise(decay * last + (1 - decay) * x[value])
    none = F.lit(None).cast("double")
    run = lambda xs, seed, step: F.aggregate(xs, F.array(seed), lambda acc, x: F.concat(acc, F.array(step(F.element_at(acc, -1), x))))
    lists = lists.withColumn("_b", let(F.col("_s"), lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.size(s) - 1) / _BLOCK).cast("int")), lambda k: F.slice(s, k * _BLOCK + 1, _BLOCK))))
    lists = lists.withColumn("_seeds", run(F.col("_b"), none, lambda last, xs: F.aggregate(xs, last, next_)))
    inside = F.zip_with("_b", "_seeds", lambda xs, seed: F.when(xs.isNotNull(), F.slice(run(xs, seed, next_), 2, _BLOCK)))
    blocks = lists.withColumn("_m", F.flatten(F.filter(inside, lambda xs: xs.isNotNull())))
    out = blocks.select(*key, F.explode(F.arrays_zip("_s", "_m")).alias("_x"))
    return out.select(*key, F.col(f"_x._s.{order}").alias(order), F.col(f"_x._s.{value}").alias(value), F.col("_x._m").alias("smooth"))


def best_so_far(series: DataFrame, value: str, by: str, order: str = "step") -> DataFrame:
    """Adds the least value so far, whether this point is a strict improvement, and how many points ago the last one was."""
    w = Window.partitionBy(by).orderBy(order)
    before = F.min(value).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = series.withColumns({"best": F.min(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), "improved": before.isNull() | (F.col(value) < before), "_n": F.row_number().over(w)})
    last = F.max(F.when(F.col("improved"), F.col("_n"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("patience", F.col("_n") - last).drop("_n")


def run_summary(series: DataFrame, by: str, order: str = "step", tail: int = 1000) -> DataFrame:
    """One row per run: first, best and last values, where, spikes over three medians, and whether all are finite."""
    finite = ~F.isnan("value") & (F.abs(F.col("value")) != float("inf"))
    basic = series.groupBy(by).agg(
        F.count("value").alias("points"), F.min_by("value", order).alias("first"), F.max_by("value", order).alias("last"), F.max(order).alias("last_step"),
        F.min("value").alias("best"), F.min(F.struct("value", order))[order].alias("best_step"), F.percentile("value", 0.5).alias("median"), F.max("value").alias("most"), F.bool_and(finite).alias("all_finite"),
    )
    joined = series.join(basic, by)
    more = joined.groupBy(by).agg(
        F.count(F.when(F.col("value") > 3 * F.col("median"), 1)).alias("spikes"),
        F.max_by("value", F.when(F.col(order) <= F.col("last_step") - tail, F.col(order))).alias("earlier"),
        F.max(F.when(F.col(order) <= F.col("last_step") - tail, F.col(order))).alias("earlier_step"),
    )
    slope = (F.col("last") - F.col("earlier")) / (F.col("last_step") - F.col("earlier_step")) * 1000
    return basic.join(more, by).withColumn("slope", F.when(F.col("earlier_step").isNotNull(), slope)).drop("earlier", "earlier_step")


def near_end(series: DataFrame, by: str, order: str, reach: int) -> DataFrame:
    """The mean over the last ``reach`` steps of each run: an interval that is open below."""
    end = series.groupBy(by).agg(F.max(order).alias("_end"))
    rows = series.join(end, by).where((F.col(order) > F.col("_end") - reach) & (F.col(order) <= F.col("_end")))
    return rows.groupBy(by).agg(F.avg("value").alias("mean"), F.count(F.lit(1)).alias("n"))


def asof_join(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """Adds to each left row the value of the last right row of its key at or before it: one sorted pass over both."""
    a = left.withColumns({"_side": F.lit(1), "_v": F.lit(None).cast(right.schema[value].dataType)})
    b = right.select(key, at, F.lit(0).alias("_side"), F.col(value).alias("_v"))
    both = a.unionByName(b, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn(f"asof_{value}", F.last(F.when(F.col("_side") == 0, F.col("_v")), ignorenulls=True).over(w)).where("_side = 1").drop("_side", "_v")


def newest(checkpoints: DataFrame, run: str, order: str, keep: int) -> DataFrame:
    """Adds ``prune``: all but the newest of each run."""
    return checkpoints.withColumn("prune", F.row_number().over(Window.partitionBy(run).orderBy(F.col(order).desc())) > keep)


def best_row(rows: DataFrame, group: str, memory_limit: float, share: float = 0.85) -> DataFrame:
    """The fastest row of each group among those that ran and whose memory is unknown or within a share of the limit."""
    ok = rows.where((F.col("status") == "ok") & (F.col("memory").isNull() | (F.col("memory") <= share * memory_limit)))
    return ok.groupBy(group).agg(F.max(F.struct("speed", "batch")).alias("b")).select(group, "b.speed", "b.batch")


def gate(checks: list[tuple[str, Column]], df: DataFrame) -> DataFrame:
    """(check, passed): named aggregate conditions over a table, a row each."""
    row = df.agg(*[F.coalesce(c, F.lit(False)).alias(f"c{i}") for i, (_, c) in enumerate(checks)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(name).alias("check"), F.col(f"c{i}").alias("passed")) for i, (name, _) in enumerate(checks)])).alias("x")).select("x.*")


def unigram_loss(train: DataFrame, test: DataFrame, token: str, vocabulary: int) -> DataFrame:
    """One row: the mean loss of a unigram model with add-one smoothing, in nats, and the number of tokens."""
    counts = train.groupBy(token).agg(F.count(F.lit(1)).alias("_c"))
    total = train.count()
    uses = test.groupBy(token).agg(F.count(F.lit(1)).alias("_n"))
    loss = -F.ln((F.coalesce("_c", F.lit(0)) + 1) / F.lit(float(total + vocabulary)))
    return uses.join(counts, token, "left").agg((F.sum(F.col("_n") * loss) / F.sum("_n")).alias("loss"), F.sum("_n").alias("tokens"))


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """A training log of JSON lines, as columns step, loss, val_loss, grad_norm, tokens_per_s and time; lines that aren't JSON are null rows and go."""
    schema = "step long, loss double, val_loss double, grad_norm double, tokens_per_s double, time double"
    return spark.read.schema(schema).json(path).where("step is not null")


def checkpoint_checks(checkpoints: DataFrame, metrics: DataFrame, vocabulary: str, tolerance: float = 1e-6) -> DataFrame:
    """Adds to (step, val_loss, vocab_sha256) rows of checkpoints the loss that the log has for their step, and whether loss and vocabulary agree.

    The loss agrees with nothing, null, where one of the two is missing.
    """
    logged = metrics.groupBy("step").agg(F.max_by("val_loss", F.struct(F.col("val_loss").isNotNull())).alias("logged"))
    rows = checkpoints.join(logged, "step", "left")
    return rows.withColumns({"loss_matches": F.abs(F.col("logged") - F.col("val_loss")) < tolerance, "vocabulary_matches": F.col("vocab_sha256").eqNullSafe(F.lit(vocabulary))})


def next_token_metrics(rows: DataFrame, scores: str, target: str, bins: int = 10) -> DataFrame:
    """One row for (scores, target): tokens, cross-entropy in nats, perplexity, top-1, top-5, and the top choice's calibration error."""
    s = F.col(scores).cast("array<double>")
    peak = F.array_max(s)
    log_sum = let(s, lambda x: let(F.array_max(x), lambda m: m + F.ln(F.aggregate(x, F.lit(0.0), lambda acc, v: acc + F.exp(v - m)))))
    own = F.get(s, F.col(target))
    hit = F.array_position(s, peak) - 1 == F.col(target)
    better = let(own, lambda o: F.size(F.filter(s, lambda v, i: (v > o) | ((v == o) & (i < F.col(target))))))
    told = rows.select((log_sum - own).alias("ce"), hit.cast("int").alias("hit"), (better < 5).cast("int").alias("five"), F.exp(peak - log_sum).alias("conf"))
    told = told.withColumn("bin", F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)))
    by_bin = told.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.sum("ce").alias("ce"), F.sum("hit").alias("hit"), F.sum("five").alias("five"), F.sum("conf").alias("conf"))
    n = F.sum("n")
    loss = F.sum("ce") / n
    return by_bin.agg(n.alias("tokens"), loss.alias("cross_entropy"), F.exp(F.least(loss, F.lit(50.0))).alias("perplexity"), (F.sum("hit") / n).alias("top1"), (F.sum("five") / n).alias("top5"), (F.sum(F.abs(F.col("conf") - F.col("hit"))) / n).alias("calibration_error"))
