"""A corpus build as a declaration: domains, how their files are read, cleaned and split, in one lazy plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import dedup, sampling
from corpusmill.sources import documents as src

SPLITTERS = {"line": src.by_line, "blank": src.by_blank_lines, "marker": src.by_markers, "separator": src.by_separator}


@dataclass
class Domain:
    """A domain's files: ``kind`` is parquet, entity (a JSON column) or the name of a text splitter."""

    name: str
    path: str
    kind: str = "parquet"
    weight: float = 1.0
    min_chars: int = 0
    normalise: bool = True
    expect_files: int | None = None
    max_files: int | None = None


@dataclass
class BuildSpec:
    domains: list[Domain] = field(default_factory=list)
    val_fraction: float = 0.005
    plan_tokens: int = 0
    chars_per_token: float = 3.6

    @classmethod
    def parse(cls, text: str) -> BuildSpec:
        raw = json.loads(text)
        return cls(**{**raw, "domains": [Domain(**d) for d in raw.get("domains", [])]})


def parse_weighted(spec: str) -> tuple[str, float]:
    """``path=weight``: the weight stands behind the last sign."""
    path, _, weight = spec.rpartition("=")
    return (path, float(weight)) if path else (spec, 1.0)


def read_domain(spark: SparkSession, d: Domain) -> DataFrame:
    """(doc_id, domain, text) of a domain."""
    if d.max_files is not None:
        own = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(d.path).inputFiles()
        path = src.first_files(own, d.max_files)
    else:
        path = d.path
    if d.kind in SPLITTERS:
        files = src.text_files(spark, path)
        rows = src.documents(files, SPLITTERS[d.kind](F.col("text"))).select(F.concat_ws("#", "file", "pos").alias("doc_id"), "text")
    else:
        table = spark.read.parquet(*path) if isinstance(path, list) else spark.read.parquet(path)
        if d.kind == "entity":
            rows = table.select(F.col("entity_id").cast("string").alias("doc_id"), src.entity_text(F.col("description"), F.col("properties")).alias("text"))
        elif d.kind == "parquet":
            rows = table.select(F.col("doc_id").cast("string").alias("doc_id"), "text")
        else:
            raise ValueError(f"{d.name}: unknown kind {d.kind}")
    if d.expect_files is not None:
        src.expect_files(rows, d.expect_files)
    return rows.select("doc_id", F.lit(d.name).alias("domain"), F.coalesce("text", F.lit("")).alias("text"))


def corpus(spark: SparkSession, spec: BuildSpec) -> DataFrame:
    """(doc_id, domain, text, split): documents long enough, first copies, split by id."""
    parts = []
    for d in spec.domains:
        rows = read_domain(spark, d).where(F.length("text") >= d.min_chars)
        parts.append(dedup.first_of(rows, F.md5(tx.normal_form("text") if d.normalise else F.col("text")), "doc_id"))
    if not parts:
        raise ValueError("a build without domains")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("split", F.when(sampling.is_validation(F.col("doc_id"), spec.val_fraction), "val").otherwise("train"))


def manifest(rows: DataFrame, spec: BuildSpec) -> DataFrame:
    """Documents, characters and estimated tokens by domain and split, and how often the plan reads a domain."""
    weights = {d.name: d.weight for d in spec.domains}
    total = sum(weights.values()) or 1.0
    share = F.create_map(*[F.lit(x) for name, w in weights.items() for x in (name, w / total)])[F.col("domain")]
    out = rows.groupBy("domain", "split").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.length("text")).alias("chars"))
    out = out.withColumn("tokens", F.floor(F.col("chars") / spec.chars_per_token))
    return out.withColumn("epochs", F.when(F.col("split") == "train", share * spec.plan_tokens / F.greatest(F.col("tokens"), F.lit(1))))
