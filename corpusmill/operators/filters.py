"""Predicates, and pipelines of reasons: each row is dropped for the first reason that applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.arrays import let

# The words that mark English prose, and the terms that topics are told by.
STOP_WORDS = "the of and to in is a that for with as are on by this be from an we which at it or can has was were".split()
TOPIC_TERMS = (
    r"physics[- ]informed|neural operator|operator learning|deeponet|fourier neural operator|scientific machine learning|"
    r"physics[- ]guided|physics[- ]based neural|differentiable physics|neural surrogate|\bPINNs?\b|neural PDE|neural ODE"
)
EARTH_TERMS = (
    r"\b(rocks?|minerals?|earthquakes?|volcan\w*|weather\w*|climates?|erosion|erod\w*|glacier\w*|sediment\w*|igneous|"
    r"metamorphic|fossils?|tectonic|atmospher\w*|tides?|clouds?|precipitation|hurricanes?|tornado\w*|crust|mantle|magma|"
    r"lava|landforms?|canyons?|groundwater|water cycle|humidity|ozone|greenhouse|global warming|droughts?|air mass\w*|"
    r"cold front|warm front)\b"
)


def first_reason(reasons: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first predicate that holds, else ``kept``."""
    out = None
    for name, holds in reasons:
        out = F.when(holds, name) if out is None else out.when(holds, name)
    return F.lit(kept) if out is None else out.otherwise(kept)


def is_empty(text: Column) -> Column:
    return F.coalesce(tx.normal_form(text), F.lit("")) == ""


def is_broken(text: Column, most: int = 2) -> Column:
    """More than ``most`` replacement characters."""
    return tx.replacement_count(text) > most


def is_short(text: Column, least: int) -> Column:
    return F.length(text) < least


def quality_reason(text: Column, least_words: int = 1500, least_alpha: float = 0.62, least_stop: float = 0.18, least_topic: int = 3, topic: str = TOPIC_TERMS) -> Column:
    """Why a text isn't prose on a topic, or null: words, letters, English stop words in the first 4,000, topic terms."""
    def told(items: Column) -> Column:
        return (
            F.when(F.size(items) < least_words, "short")
            .when(tx.alpha_ratio(text) < least_alpha, "low_alpha")
            .when(tx.share_of(items, STOP_WORDS, 4000) < least_stop, "not_english")
            .when(F.regexp_count(text, F.lit(f"(?i){topic}")) < least_topic, "off_topic")
        )

    return let(tx.words(text), told)


def path_reason(path: Column, text: Column, extensions: list[str], least: int = 80, most: int = 400_000, longest_line: int = 2000) -> Column:
    """Why a file of a code tree is skipped, or null: hidden folders, extension, size, NUL, long lines."""
    hidden = F.exists(F.split(path, "/"), lambda p: F.startswith(p, F.lit(".")))
    lines = F.array_max(F.transform(F.split(text, "\n"), F.length))
    return (
        F.when(hidden, "hidden")
        .when(~F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1)).isin(extensions), "extension")
        .when((F.octet_length(text) < least) | (F.octet_length(text) > most), "size")
        .when(F.contains(text, F.lit("\x00")), "binary")
        .when(lines > longest_line, "long_line")
    )


def repository_reason(fork: Column, licence: Column, allowed: list[str]) -> Column:
    """Why a repository is skipped, or null: a fork, or a licence that isn't listed."""
    return F.when(F.coalesce(fork, F.lit(False)), "fork").when(~F.coalesce(licence.isin(allowed), F.lit(False)), "licence")


def repeated_choices(choices: Column) -> Column:
    """Whether two choices are equal once trimmed."""
    return F.size(F.array_distinct(F.transform(choices, lambda x: F.trim(x)))) < F.size(choices)


def holds_special(text: Column, specials: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(s) for s in specials]), lambda s: F.contains(text, s))


def first_per_group(df: DataFrame, group: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
