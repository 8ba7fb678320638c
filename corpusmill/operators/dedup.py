"""Exact duplicates by any key, reports, greedy duplicate rules, near duplicates by shared shingles.

Which copy is first is decided by an order that the caller names; Spark's rows have none.
First copies are found by an aggregate (``min`` of the order), not by a window, wherever only they are
needed: it combines before the shuffle, so a key that half of all rows share is no hot partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.functions import text as tx
from corpusmill.operators import filters
from corpusmill.scratch import materialize


def first_of(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The rows that come first, by a unique ``order`` column, among those of equal key. A null key is a key."""
    firsts = df.groupBy(key.alias("_key")).agg(F.min(order).alias(order)).select(order)
    return df.join(firsts, order, "left_semi")


def entity_key(text: Column, properties: Column) -> Column:
    """The hash that a JSON column gives, else one of the normal form; a null text counts as empty."""
    return F.coalesce(F.get_json_object(properties, "$.sha256"), F.sha2(tx.normal_form(F.coalesce(text, F.lit(""))), 256))


def reasons(documents: DataFrame, least_chars: int = 200, most_broken: int = 2) -> DataFrame:
    """Adds ``reason``: kept, or why a document goes: empty, broken, short, duplicate, in this order.

    Only documents that pass the other tests make duplicates of later ones.
    """
    return _with_reason(_judged(documents, least_chars, most_broken))


def _judged(documents: DataFrame, least_chars: int = 200, most_broken: int = 2) -> DataFrame:
    """Adds what a text alone tells: a reason, and the hash of its normal form."""
    t = F.col("text")
    local = filters.first_reason([("empty", filters.is_empty(t)), ("broken", filters.is_broken(t, most_broken)), ("short", filters.is_short(t, least_chars))])
    return documents.withColumns({"_local": local, "_key": F.md5(tx.normal_form(t))})


def _with_reason(rows: DataFrame) -> DataFrame:
    firsts = rows.where("_local = 'kept'").groupBy("_key").agg(F.min("doc_id").alias("_first"))
    reason = F.when(F.col("_local") != "kept", F.col("_local")).when(F.col("_first") == F.col("doc_id"), "kept").otherwise("duplicate")
    return rows.join(firsts, "_key", "left").withColumn("reason", reason).drop("_local", "_key", "_first")


def report(documents: DataFrame, by: str = "source", **options) -> DataFrame:
    """Documents in, kept and dropped for each reason, by group; documents that are empty aren't counted in.

    Texts are read once: their keys and flags are stored, and the rest works on those.
    """
    rows = _with_reason(materialize(_judged(documents, **options).select("doc_id", by, "_local", "_key"), "dedup-keys")).where("reason <> 'empty'")
    count = lambda name: F.count(F.when(F.col("reason") == name, 1)).alias(f"n_{name}")
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n_in"), *[count(x) for x in ("kept", "duplicate", "broken", "short")])


def _greedy(rows: DataFrame, order: str, collides, rounds: int, name: str) -> DataFrame:
    """Fixed point of a rule in which kept rows alone drop later ones.

    All rows start as kept; each round drops those that collide with an earlier kept one. A row's
    state is final once all earlier rows' are, and the last round changes nothing. Each round is a
    stored table, so that neither lineage nor loss of executors grows with rounds.
    """
    state = materialize(rows.select(order).withColumn("kept", F.lit(True)), name)
    for _ in range(rounds):
        dropped = collides(state.where("kept").select(order))
        new = materialize(rows.select(order).join(dropped.select(order).distinct().withColumn("_drop", F.lit(True)), order, "left").select(order, F.col("_drop").isNull().alias("kept")), name)
        changed = new.join(state.withColumnRenamed("kept", "was"), order).where("kept <> was")
        if changed.isEmpty():
            return new.where("kept").select(order)
        state = new
    raise RuntimeError(f"no fixed point within {rounds} rounds")


def first_by_any_key(df: DataFrame, keys: list[str], order: str, rounds: int = 64) -> DataFrame:
    """Rows of which no earlier kept row has an equal value in any of the keys."""
    pairs = df.select(order, F.posexplode(F.array(*[F.col(k).cast("string") for k in keys])).alias("_k", "_v")).where("_v is not null")

    def collides(kept: DataFrame) -> DataFrame:
        firsts = pairs.join(kept, order, "left_semi").groupBy("_k", "_v").agg(F.min(order).alias("_first"))
        return pairs.join(firsts, ["_k", "_v"]).where(F.col(order) > F.col("_first"))

    return df.join(_greedy(df, order, collides, rounds, "any-key"), order, "left_semi")


def shingles(text: Column, k: int = 12, stride: int = 3) -> Column:
    """Hashes of the runs of k words whose hash is divisible by ``stride``; none for fewer words. A run is hashed by its words' hashes."""
    hashes = F.transform(arrays.ngrams(F.transform(tx.words(F.lower(text)), lambda w: F.xxhash64(w)), k), lambda g: F.xxhash64(g))
    return F.coalesce(F.array_distinct(F.filter(hashes, lambda h: F.pmod(h, F.lit(stride)) == 0)), F.array().cast("array<bigint>"))


def near_duplicates(documents: DataFrame, order: str = "doc_id", k: int = 12, stride: int = 3, threshold: float = 0.3, rounds: int = 64) -> DataFrame:
    """The documents that stay: no earlier kept one has their normal form, or together ``threshold`` of their sampled shingles."""
    base = documents.select(order, F.md5(tx.normal_form("text")).alias("_exact"), shingles(F.col("text"), k, stride).alias("_shingles"))
    base = materialize(base, "near-base")
    sizes = base.select(order, F.size("_shingles").alias("_n"))
    posting = base.select(order, F.explode("_shingles").alias("_h"))

    def collides(kept: DataFrame) -> DataFrame:
        exact = base.join(kept, order, "left_semi").groupBy("_exact").agg(F.min(order).alias("_first"))
        same = base.join(exact, "_exact").where(F.col(order) > F.col("_first")).select(order)
        first = posting.join(kept, order, "left_semi").groupBy("_h").agg(F.min(order).alias("_first"))
        seen = posting.join(first, "_h").where(F.col(order) > F.col("_first")).groupBy(order).agg(F.count(F.lit(1)).alias("_seen"))
        near = seen.join(sizes, order).where(F.col("_seen") >= threshold * F.col("_n")).select(order)
        return same.unionByName(near)

    return documents.join(_greedy(base, order, collides, rounds, "near-state"), order, "left_semi")


def repeated_lines(documents: DataFrame, least: int = 3, shorter_than: int = 120) -> DataFrame:
    """(doc_id, line, n): short lines that a document repeats and that don't end a sentence."""
    lines = documents.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).withColumn("line", F.trim("line"))
    return lines.where((F.length("line") > 0) & (F.length("line") < shorter_than) & ~F.endswith("line", F.lit("."))).groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def without_repeated_lines(documents: DataFrame, least: int = 3, shorter_than: int = 120) -> DataFrame:
    """Texts without those lines; all lines trimmed."""
    bad = repeated_lines(documents, least, shorter_than).groupBy("doc_id").agg(F.collect_list("line").alias("_bad"))
    kept = F.filter(F.transform(F.split("text", "\n"), lambda x: F.trim(x)), lambda x: ~F.array_contains(F.coalesce("_bad", F.array().cast("array<string>")), x))
    return documents.join(bad, "doc_id", "left").withColumn("text", F.array_join(kept, "\n")).drop("_bad")


def running_state(order: str, *partition: str):
    """A window over all earlier rows."""
    return Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
