"""Joins on n-grams of words or ids: contamination, overlap of splits, counts of phrases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.functions import text as tx

RUN = ["a", "b"]

#: A side is sent to all executors only if it is measured to have no more rows.
BROADCAST_ROWS = 500_000


def plain_words(text: Column) -> Column:
    """Lower-cased runs of a-z, 0-9 and non-ASCII."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9\x{80}-\x{10FFFF}]+"), F.lit(0))


def run_keys(words: Column, n: int, step: int = 1) -> Column:
    """array<struct<at, a, b>>: 96-bit hashes of the runs of n words, every ``step``, and where they begin, from 0.

    A run is told by the 64-bit hashes of its words, hashed together with 64 and with 32 bits: no run becomes a string.
    """
    keys = lambda h: F.transform(F.sequence(F.lit(0), F.size(h) - n, F.lit(step)), lambda i: arrays.let(F.slice(h, i + 1, n), lambda x: F.struct(i.alias("at"), F.xxhash64(x).alias("a"), F.hash(x).alias("b"))))
    none = F.array().cast("array<struct<at:int,a:bigint,b:int>>")
    return arrays.let(F.transform(words, lambda w: F.xxhash64(w)), lambda h: F.when(F.size(h) >= n, keys(h)).otherwise(none))


def grams(df: DataFrame, key: str, words: Column, n: int, step: int = 1) -> DataFrame:
    """(key, at, a, b): a row of :func:`run_keys` for each run."""
    return df.select(key, F.explode(run_keys(words, n, step)).alias("_x")).select(key, "_x.*")


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked to be sent to all executors if it is measured to be small; else the join shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def item_hits(items: DataFrame, documents: DataFrame, n: int = 13) -> DataFrame:
    """(item_id, ngrams, matched, first_doc, first_at) of each item; null ngrams if it has fewer words than n."""
    own = grams(items, "item_id", plain_words(F.col("text")), n).select("item_id", *RUN).distinct()
    wanted = own.select(*RUN).distinct()
    found = grams(documents, "doc_id", plain_words(F.col("text")), n).join(small(wanted), RUN).groupBy(*RUN).agg(F.min(F.struct("doc_id", "at")).alias("first"))
    hits = own.join(found, RUN, "left").groupBy("item_id").agg(F.count(F.lit(1)).alias("ngrams"), F.count("first").alias("matched"), F.min("first").alias("first"))
    return items.select("item_id").join(hits, "item_id", "left").select("item_id", "ngrams", "matched", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))


def leak_status(hits: DataFrame, threshold: float = 0.2, least_hits: int = 2, enough: int = 10) -> DataFrame:
    """Adds ``fraction`` and ``status``: too_short, leaked, partial or clean."""
    fraction = F.col("matched") / F.col("ngrams")
    leaked = ((fraction >= threshold) & (F.col("matched") >= least_hits)) | (F.col("matched") >= enough)
    status = F.when(F.col("ngrams").isNull(), "too_short").when(leaked, "leaked").when(F.col("matched") > 0, "partial").otherwise("clean")
    return hits.withColumns({"fraction": F.round(fraction, 3), "status": status})


def leaked_items(documents: DataFrame, items: DataFrame, n: int = 13) -> DataFrame:
    """(doc_id, item_id, matched): distinct runs that a document shares with an item."""
    own = grams(items, "item_id", plain_words(F.col("text")), n).select("item_id", *RUN).distinct()
    theirs = grams(documents, "doc_id", plain_words(F.col("text")), n).join(small(own.select(*RUN).distinct()), RUN, "left_semi").select("doc_id", *RUN).distinct()
    return theirs.join(small(own), RUN).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("matched"))


def document_overlap(val: DataFrame, train: DataFrame, key: Column) -> DataFrame:
    """One row: validation documents, how many of them are in training, and their share of characters."""
    v = val.select(key.alias("_k"), F.length("text").alias("_n"))
    hit = v.join(train.select(key.alias("_k")).distinct().withColumn("_in", F.lit(1)), "_k", "left")
    return hit.agg(F.count(F.lit(1)).alias("val_docs"), F.count("_in").alias("exact_docs"), F.sum("_n").alias("val_chars"), F.coalesce(F.sum(F.when(F.col("_in") == 1, F.col("_n"))), F.lit(0)).alias("exact_chars"))


def window_overlap(val: DataFrame, train: DataFrame, words: Column, n: int, step: int) -> DataFrame:
    """One row: windows of validation (every ``step``), those in training, and how many occur at most twice, or ten times or more."""
    wanted = grams(val, "doc_id", words, n, step).select(*RUN).distinct()
    counts = grams(train, "doc_id", words, n).join(small(wanted), RUN, "left_semi").groupBy(*RUN).agg(F.count(F.lit(1)).alias("n"))
    rows = wanted.join(counts, RUN, "left")
    return rows.agg(F.count(F.lit(1)).alias("windows"), F.count("n").alias("seen"), F.count(F.when(F.col("n") <= 2, 1)).alias("rare"), F.count(F.when(F.col("n") >= 10, 1)).alias("common"))


def phrase_count(text: Column, phrase: str) -> Column:
    """Occurrences that don't overlap."""
    return (F.length(text) - F.length(F.replace(text, F.lit(phrase), F.lit("")))) / len(phrase)


def containment(a: DataFrame, b: DataFrame) -> DataFrame:
    """How much of corpus a is in corpus b, by documents and by characters of normal forms."""
    return document_overlap(a, b, F.md5(tx.normal_form("text")))
