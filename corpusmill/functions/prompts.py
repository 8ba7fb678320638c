"""Prompts of an evaluation, from items and worked examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.arrays import let
from corpusmill.operators.ngrams import small


def choice_context(question: Column) -> Column:
    """What stands before each choice."""
    return F.concat(F.lit("Question: "), question, F.lit("\nAnswer:"))


def short_number(x: Column) -> Column:
    """Whole numbers without a point; others with six significant digits, in scientific form below 0.0001 and from a million on."""

    def written(coded: Column) -> Column:
        digits = F.regexp_replace(F.substring_index(coded, "e", 1), r"\.?0+$", "")
        exponent = F.substring_index(coded, "e", -1)
        plain = F.regexp_replace(coded.cast("decimal(38,12)").cast("string"), r"\.?0+$", "")
        return F.when(exponent.cast("int").between(-4, 5), plain).otherwise(F.concat(digits, F.lit("e"), exponent))

    return F.when(x == F.floor(x), x.cast("decimal(38,0)").cast("string")).otherwise(let(F.format_string("%.5e", x), written))


def numeric_prompt(question: Column, shots: Column) -> Column:
    """Worked examples, an array of (question, solution, answer) whose solution may be null, then the question."""
    worked = lambda s: F.concat(s["solution"], F.lit(" The answer is "), short_number(s["answer"]), F.lit("."))
    shot = lambda s: F.concat(F.lit("Question: "), s["question"], F.lit("\nAnswer: "), F.coalesce(worked(s), short_number(s["answer"])), F.lit("\n\n"))
    return F.concat(F.coalesce(F.array_join(F.transform(shots, shot), ""), F.lit("")), choice_context(question))


def with_shots(items: DataFrame, shots: DataFrame, name: str = "fewshot") -> DataFrame:
    """Adds ``shots`` to items by the name of a set of examples; null for items that name none. ``shots`` has (name, shots), a row per set."""
    return items.join(small(shots.withColumnRenamed("name", "_shots_name")), F.col(name) == F.col("_shots_name"), "left").drop("_shots_name")
