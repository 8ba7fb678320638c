"""Column functions on arrays: n-grams, masks, scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it, in lambdas too."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def ngrams(items: Column, n: int, step: int = 1) -> Column:
    """All runs of n items, every ``step``; none if there are fewer items."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1, F.lit(step)), lambda i: F.slice(w, i, n))
    return let(items, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.slice(F.array(w), 1, 0)))


def _run_keys(items: Column, n: int) -> Column:
    """The runs of n as strings, equal for equal runs only: arrays are told apart pair by pair, strings by hash."""
    named = lambda x: F.coalesce(F.concat(F.length(x.cast("string")), F.lit(":"), x.cast("string")), F.lit("-"))
    keys = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), ""))
    return let(F.transform(items, named), lambda w: F.when(F.size(w) >= n, keys(w)).otherwise(F.slice(w, 1, 0)))


def distinct_ratio(items: Column, n: int) -> Column:
    """Distinct runs of n over all; 0 if there is none."""
    return let(_run_keys(items, n), lambda g: F.coalesce(F.size(F.array_distinct(g)) / F.nullif(F.size(g), F.lit(0)), F.lit(0.0)))


def repeated_share(items: Column, n: int) -> Column:
    """Share of runs of n that repeat an earlier one; 0 if there is none."""
    return let(_run_keys(items, n), lambda g: F.coalesce(1 - F.size(F.array_distinct(g)) / F.nullif(F.size(g), F.lit(0)), F.lit(0.0)))


def repetition_loop(items: Column) -> Column:
    """Of 24 items or more, fewer than half of the runs of three are distinct."""
    return (F.size(items) >= 24) & (distinct_ratio(items, 3) < 0.5)


def agreement(a: Column, b: Column) -> Column:
    """Share of equal items over the common length; null if one is empty."""
    n = F.least(F.size(a), F.size(b))
    same = F.zip_with(F.slice(a, 1, n), F.slice(b, 1, n), lambda x, y: F.when(x == y, 1).otherwise(0))
    return F.aggregate(same, F.lit(0), lambda acc, x: acc + x) / F.nullif(n, F.lit(0))


def copies_tail(out: Column, prompt: Column, n: int = 8) -> Column:
    """The first n items of the output are the last n of the prompt."""
    return (F.size(out) >= n) & (F.size(prompt) >= n) & (F.slice(out, 1, n) == F.slice(prompt, -n, n))


def first_argmax(scores: Column) -> Column:
    """Place, from 0, of the first greatest score."""
    return F.array_position(scores, F.array_max(scores)) - 1


def per_character(scores: Column, choices: Column) -> Column:
    """Scores over the lengths of their choices."""
    return F.zip_with(scores, choices, lambda s, c: s / F.greatest(F.length(c), F.lit(1)))


def most_different(a: Column, b: Column) -> Column:
    """Greatest absolute difference over the common length."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def padded(items: Column, width: int, pad: Column) -> Column:
    return F.concat(items, F.array_repeat(pad, F.greatest(F.lit(width) - F.size(items), F.lit(0))))


def tail(items: Column, n: int) -> Column:
    """The last n items."""
    return F.when(F.size(items) > n, F.slice(items, -n, n)).otherwise(items)


def top_k(logits: Column, k: int) -> Column:
    """Logits under the k-th greatest become null."""
    floor = F.element_at(F.sort_array(logits, asc=False), F.least(F.lit(k), F.size(logits)))
    return F.transform(logits, lambda x: F.when(x >= floor, x))


def top_p(logits: Column, p: float) -> Column:
    """Logits outside the smallest set, greatest first, whose probability reaches p become null; ties by place."""
    def masked(xs: Column) -> Column:
        weights = let(F.array_max(xs), lambda peak: F.transform(xs, lambda x: F.exp(x - peak)))
        order = F.transform(F.reverse(F.array_sort(F.transform(xs, lambda x, i: F.struct(x.alias("x"), (-i).alias("i"))))), lambda s: -s["i"])
        start = F.struct(F.lit(0.0).alias("mass"), F.array().cast("array<int>").alias("kept"))

        def kept(w: Column) -> Column:
            bound = p * F.aggregate(w, F.lit(0.0), lambda acc, x: acc + x)
            grow = lambda acc, i, most: F.when(acc["mass"] < most, F.struct((acc["mass"] + F.get(w, i)).alias("mass"), F.concat(acc["kept"], F.array(i)).alias("kept"))).otherwise(acc)
            return let(bound, lambda most: F.aggregate(order, start, lambda acc, i: grow(acc, i, most), lambda acc: acc["kept"]))

        return let(let(weights, kept), lambda k: F.transform(xs, lambda x, i: F.when(F.array_contains(k, i), x)))

    return let(logits, masked)


def penalized(logits: Column, seen: Column, penalty: float) -> Column:
    """Logits of items seen are divided by the penalty if positive, else multiplied."""
    return F.transform(logits, lambda x, i: F.when(F.array_contains(seen, i), F.when(x > 0, x / penalty).otherwise(x * penalty)).otherwise(x))


def banned_next(items: Column, n: int) -> Column:
    """Items that would complete a run of n that occurs already, sorted."""
    prefix = F.slice(items, -(n - 1), n - 1)
    ends = F.filter(F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1))), lambda i: (F.size(items) >= n) & (F.slice(items, i, n - 1) == prefix))
    return F.array_sort(F.array_distinct(F.transform(ends, lambda i: F.element_at(items, (i + n - 1).cast("int")))))


def evenly_spaced(size: Column, count: int) -> Column:
    """``count`` places from 0 to size, both ends included, rounded down."""
    return F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.floor(i * size / F.lit(max(count - 1, 1))))
