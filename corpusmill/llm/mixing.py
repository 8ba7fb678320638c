"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks.

Each source's documents are shuffled by a hash and laid end to end, which makes a stream of words; the
stream is cut in equal blocks and may be read up to three times. Slots of the mix follow the golden
ratio: slot k's point, k / phi mod 1, falls in a source's part of the cumulative shares. A slot's
rank among its source's slots is the block that it reads, and slots join blocks by source and
block. A source that the points serve a few blocks short of its quota reads them in slots behind the last point, so that
each source's words come out as its target, to the word. The order of the mix is the order of its slots: ``mix`` gives
documents by the slot that begins to read them, ``blocks`` gives each slot's words.

DataFrame operations only. Running sums go by hash bucket inside a source and by chunk of slots, so
that a source with a third of all rows is no single task's work.

Defined results:
  * a null or empty text, or one without words, has size 0 and is never taken;
  * a document longer than a block is read by several slots, one of any length;
  * a null source is a source of its own, after all others; a source without words has target 0;
  * rows of one doc_id are separate documents; a null doc_id is as good as any;
  * an empty table gives no rows; other columns are ignored (``mix`` keeps all of them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.scratch import materialize, numbered

WEIGHTS = (5, 2, 1)
MOST_EPOCHS = 3
BLOCK_WORDS = 256
SEED = "mix-1"
#: Hex digits of a document's hash that name its bucket: 4,096 buckets in each source.
BUCKET_DIGITS = 3
#: Slots are ranked in chunks of so many.
CHUNK = 8192
#: Points are k * GOLDEN mod 2^31: the golden ratio's steps in whole numbers, which never lose digits.
POINTS, GOLDEN = 1 << 31, 1327217885
#: The circle of points is looked up by so many equal cells.
CELLS = 4096

_WORDS = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    """The number of words of a text, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """(idx, source, source_size, target) of each source, a row for each.

    Sources by code point, null last, have the weights in turn. All sources together get as many words
    as there are; none gets more than ``most`` times its own, and what that leaves over is shared by
    weight among the others. The level at which all is shared is found in one pass over sources ordered
    by the level that fills them.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ordered = Window.orderBy(F.col("source").asc_nulls_last())
    rows = per_source.withColumn("idx", F.row_number().over(ordered) - 1)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod("idx", F.lit(len(weights))) + 1)
    rows = rows.withColumn("weight", weight.cast("long")).withColumn("filled_at", (most * F.col("source_size")).cast("double") / F.col("weight").cast("double"))
    below = Window.orderBy("filled_at", "idx").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = rows.withColumns({
        "level": (F.sum("source_size").over(everything) - most * F.coalesce(F.sum("source_size").over(below), F.lit(0))).cast("double")
        / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0))).cast("double")
    })
    level = F.min(F.when(F.col("level") <= F.col("filled_at"), F.struct("filled_at", "idx", "level"))).over(everything)["level"]
    rows = rows.withColumn("shared", level * F.col("weight").cast("double"))
    return rows.select("idx", "source", "source_size", F.least((most * F.col("source_size")).cast("double"), F.col("shared")).alias("target"))


def quotas(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Adds the words to take, blocks in an epoch, and the number of blocks (``quota``) that makes them up."""
    t, size = F.col("take"), F.col("source_size")
    rows = sources.withColumn("take", F.floor(F.col("target") + 0.5).cast("long"))
    rows = rows.withColumns({"blocks": F.ceil(size / block_words).cast("long"), "epochs": F.when(size > 0, F.floor(t / size)).otherwise(0).cast("long")})
    rows = rows.withColumn("rest", t - F.col("epochs") * size)
    return rows.withColumn("quota", F.col("epochs") * F.col("blocks") + F.ceil(F.col("rest") / block_words).cast("long"))


def schedule(sources: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """(slot, idx, rank, epoch, block, words): which block of which source each slot of the mix reads.

    The blocks that sources still lack after the last point have the slots behind it, by source and rank: a few for each source.
    """
    spark = sources.sparkSession
    total = sources.agg(F.sum("quota").alias("n")).first()["n"] or 0
    over = Window.orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    q = F.col("quota").cast("decimal(38,0)")
    low = F.coalesce(F.sum(q).over(over), F.lit(0).cast("decimal(38,0)"))
    edge = lambda x: F.floor(x * F.lit(POINTS) / F.lit(max(total, 1))).cast("long")
    parts = sources.where("quota > 0").withColumns({"low": edge(low), "high": edge(low + q)}).where("high > low")
    cell = POINTS // CELLS
    cells = parts.select("idx", "low", "high", "quota", F.explode(F.sequence(F.floor(F.col("low") / cell), F.floor((F.col("high") - 1) / cell))).alias("cell"))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.pmod(F.pmod("id", F.lit(POINTS)) * F.lit(GOLDEN), F.lit(POINTS)).alias("point"))
    slots = slots.withColumn("cell", F.floor(F.col("point") / cell))
    drawn = slots.join(cells, "cell").where((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high"))).select("slot", "idx", F.floor(F.col("slot") / CHUNK).alias("chunk"))
    in_chunk = drawn.groupBy("idx", "chunk").agg(F.count(F.lit(1)).alias("n"))
    before = in_chunk.select("idx", "chunk", F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    here = F.row_number().over(Window.partitionBy("idx", "chunk").orderBy("slot")) - 1
    ranked = drawn.withColumn("here", here).join(before, ["idx", "chunk"]).select("slot", "idx", (F.col("before") + F.col("here")).alias("rank"))
    quota = sources.select("idx", "source_size", "blocks", "epochs", "rest", "quota")
    served = in_chunk.groupBy("idx").agg(F.sum("n").alias("served"))
    lacking = quota.join(served, "idx", "left").where(F.col("quota") > F.coalesce("served", F.lit(0)))
    lacking = lacking.select("idx", F.explode(F.sequence(F.coalesce("served", F.lit(0)), F.col("quota") - 1)).alias("rank"))
    lacking = lacking.select((F.lit(total) + F.row_number().over(Window.orderBy("idx", "rank")) - 1).cast("long").alias("slot"), "idx", "rank")
    rows = ranked.unionByName(lacking).join(quota, "idx").where(F.col("rank") < F.col("quota"))
    rows = rows.withColumns({"epoch": F.floor(F.col("rank") / F.col("blocks")).cast("long"), "block": F.pmod("rank", "blocks")})
    upto = F.when(F.col("epoch") < F.col("epochs"), F.col("source_size")).otherwise(F.col("rest"))
    return rows.select("slot", "idx", "rank", "epoch", "block", F.least(F.lit(block_words).cast("long"), upto - F.col("block") * block_words).alias("words"))


def _streams(sizes: DataFrame, sources: DataFrame, seed: str) -> DataFrame:
    """Documents with their source's index, their place in its shuffled order, and where their words begin in its stream."""
    rows = sizes.join(sources.select("idx", F.col("source").alias("_source"), "source_size", "target"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
    rows = rows.withColumn("hash", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    rows = rows.withColumn("bucket", F.substring("hash", 1, BUCKET_DIGITS))
    in_bucket = rows.groupBy("idx", "bucket").agg(F.sum("size").alias("n"))
    before = in_bucket.select("idx", "bucket", F.coalesce(F.sum("n").over(Window.partitionBy("idx").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    order = Window.partitionBy("idx", "bucket").orderBy("hash", "doc_id", "size", *(c for c in sizes.columns if c == "_row"))
    rows = rows.withColumns({"place": F.row_number().over(order), "here": F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    return rows.join(before, ["idx", "bucket"]).withColumn("begin", F.col("before") + F.col("here"))


def take(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """Adds source_size, target, ``taken`` (words that the mix takes, repeats counted) and ``slots`` to rows of (doc_id, source, size, ...).

    ``slots`` has, for each time that the mix reads the document, the slot that reads its first word; null for times that it doesn't.
    """
    sources = materialize(quotas(targets(sizes, weights, most), block_words), "mix-sources")
    docs = _streams(sizes, sources, seed)
    slots = schedule(sources, block_words)
    # Of the slots that read a block, all but the source's last may read it whole.
    whole = F.least(F.lit(block_words).cast("long"), F.col("source_size") - F.col("block") * block_words)
    slots = slots.join(sources.select("idx", "source_size"), "idx").withColumn("cut", F.col("words") < whole)
    in_epoch = [F.max(F.when(F.col("epoch") == e, F.struct("slot", "words"))) for e in range(most)]
    reads = slots.groupBy("idx", "block").agg(F.count(F.when(~F.col("cut"), 1)).alias("times"), F.coalesce(F.max(F.when(F.col("cut"), F.col("words"))), F.lit(0)).alias("cut"), *[c.alias(f"epoch_{e}") for e, c in enumerate(in_epoch)])
    end = F.col("begin") + F.col("size")
    key = ["idx", "bucket", "place"]
    pieces = docs.where("size > 0").select(*key, "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    a = F.greatest(F.col("begin"), F.col("block") * block_words)
    b = F.least(F.col("end"), (F.col("block") + 1) * block_words)
    words = F.col("times") * (b - a) + F.greatest(F.lit(0), F.least(b, F.col("block") * block_words + F.col("cut")) - a)
    first = F.col("begin") - F.col("block") * block_words  # of a block where it begins, not negative: its first word's place there
    begins = [F.max(F.when((first >= 0) & (first < F.col(f"epoch_{e}.words")), F.col(f"epoch_{e}.slot"))).alias(f"slot_{e}") for e in range(most)]
    taken = pieces.join(reads, ["idx", "block"]).groupBy(*key).agg(F.sum(words).alias("taken"), *begins)
    rows = docs.join(taken, key, "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).withColumn("slots", F.array(*[F.col(f"slot_{e}") for e in range(most)])).drop(*[f"slot_{e}" for e in range(most)])
    return rows.drop(*key, "hash", "before", "here", "begin").drop("idx")


def sized(documents: DataFrame) -> DataFrame:
    """(doc_id, source, size), written once: texts are read a single time."""
    return materialize(documents.select("doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")


def report(documents: DataFrame) -> DataFrame:
    """The contract's rows."""
    return take(sized(documents)).select("doc_id", "size", "source_size", "target", "taken", F.get("slots", F.lit(0)).alias("first_slot"))


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS) -> DataFrame:
    """The mixed documents, with the input's columns: a row for each time that the mix reads a document, in the order of the slots that begin to read them.

    A source's last document may be read in part: its first words, joined by single spaces.
    """
    rows = numbered(documents, "_row")
    sizes = materialize(rows.select("_row", "doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    taken = take(sizes, weights, most).where("taken > 0").select("_row", F.col("size").alias("_size"), F.col("taken").alias("_taken"), F.posexplode("slots").alias("_time", "_slot"))
    taken = taken.where(F.col("_time") * F.col("_size") < F.col("_taken"))
    taken = taken.withColumn("_words", F.least("_size", F.col("_taken") - F.col("_time") * F.col("_size")))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)), 1, F.col("_words").cast("int")), " ")
    joined = rows.join(taken, "_row").withColumn("text", F.when(F.col("_words") < F.col("_size"), part).otherwise(F.col("text")))
    if "n_chars" in documents.columns:
        kind = documents.schema["n_chars"].dataType
        joined = joined.withColumn("n_chars", F.when(F.col("_words") < F.col("_size"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return joined.repartitionByRange("_slot").sortWithinPartitions("_slot", "_row").select(*documents.columns)


def blocks(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_EPOCHS, block_words: int = BLOCK_WORDS, seed: str = SEED) -> DataFrame:
    """(slot, at, doc_id, source, text): the words that each slot reads, a row for each document that a slot touches, in the order of slots.

    ``at`` is the place in its slot of a row's first word; words are joined by single spaces.
    """
    rows = numbered(documents.select("doc_id", "source", "text"), "_row")
    sizes = materialize(rows.select("_row", "doc_id", "source", words_in(F.col("text")).alias("size")), "mix-sizes")
    sources = materialize(quotas(targets(sizes, weights, most), block_words), "mix-sources")
    slots = schedule(sources, block_words).select("slot", "idx", "block", "words")
    docs = _streams(sizes, sources, seed).where("size > 0")
    end = F.col("begin") + F.col("size")
    pieces = docs.select("_row", "idx", "begin", end.alias("end"), F.explode(F.sequence(F.floor(F.col("begin") / block_words), F.floor((end - 1) / block_words))).alias("block"))
    first, last = F.col("block") * block_words, F.least(F.col("end"), F.col("block") * block_words + F.col("words"))
    read = pieces.join(slots, ["idx", "block"]).where(last > F.greatest("begin", first))
    read = read.select("_row", "slot", (F.greatest("begin", first) - first).alias("at"), (F.greatest("begin", first) - F.col("begin")).alias("_from"), (last - F.greatest("begin", first)).alias("_words"))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(_WORDS), F.lit(0)), (F.col("_from") + 1).cast("int"), F.col("_words").cast("int")), " ")
    return rows.join(read, "_row").select("slot", "at", "doc_id", "source", part.alias("text")).repartitionByRange("slot").sortWithinPartitions("slot", "at")

