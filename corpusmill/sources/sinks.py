"""Sinks: texts, corpora with manifests, splits, reports. Spark's committer publishes a folder when it is whole."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_text(df: DataFrame, path: str, blank_line: bool = False, gzip: bool = False) -> None:
    """A text per row, with a line feed or an empty line behind it."""
    writer = df.select("text").write.option("lineSep", "\n\n" if blank_line else "\n")
    (writer.option("compression", "gzip") if gzip else writer).text(path)


def write_corpus(df: DataFrame, path: str, separator: str = "<|endoftext|>") -> None:
    """Texts with separator lines, and a manifest of all other columns beside them."""
    df.select(F.concat("text", F.lit(f"\n{separator}")).alias("text")).write.text(f"{path}/corpus")
    df.drop("text").write.json(f"{path}/manifest")


def write_splits(df: DataFrame, path: str, columns: list[str]) -> None:
    """A folder of JSON lines for each value of ``split``; null fields are left out."""
    df.select(*columns, "split").write.partitionBy("split").option("ignoreNullFields", "true").json(path)


def rewrite(df: DataFrame, path: str, block_bytes: int = 64 << 20) -> None:
    """The same schema as Parquet, zstd, in row groups of about 64 MB."""
    df.write.option("compression", "zstd").option("parquet.block.size", str(block_bytes)).parquet(path)


def fingerprint(**parts) -> str:
    """A hash of everything that determines a job's output: inputs, settings, versions."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()[:24]


def write_once(df: Callable[[], DataFrame], path: str, mark: str, spark: SparkSession) -> bool:
    """Writes a job's table as Parquet unless one of the same fingerprint is there already; whether it was written.

    A folder is done if its mark is: the mark is written last, so a job that died is done anew. The table is only planned if it is needed.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_job_{mark}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(place):
        return False
    df().write.mode("overwrite").parquet(path)
    files.create(place, True).close()
    return True


def stamped(df: DataFrame) -> DataFrame:
    """Adds ``written_at``: the time of the query in UTC, to the second."""
    return df.withColumn("written_at", F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.current_timestamp().cast("timestamp_ntz")), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def write_curve(df: DataFrame, path: str) -> None:
    df.write.option("header", "true").csv(path)


def markdown(df: DataFrame, most: int = 200) -> str:
    """A small table as Markdown; a larger one is an error, not cut."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda v: "–" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v).replace("|", "\\|")
    return "\n".join([f"| {' | '.join(df.columns)} |", f"|{'---|' * len(df.columns)}", *(f"| {' | '.join(map(cell, r))} |" for r in rows)])


def latex_escaped(text: str) -> str:
    """Text for LaTeX: special characters escaped."""
    special = {"\\": r"\textbackslash{}", "~": r"\textasciitilde{}", "^": r"\textasciicircum{}"}
    return "".join(special.get(c, f"\\{c}" if c in "&%$#_{}" else c) for c in text)
