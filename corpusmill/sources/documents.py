"""Splitters of text files into documents, JSON rows to texts, and containers (zip, tar, XML, notebooks)."""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx

START, END, SEPARATOR = "<|document|>", "<|endofdocument|>", "<|endoftext|>"


def expect_files(df: DataFrame, n: int) -> DataFrame:
    """The table, if it is read from exactly n files; an incomplete download is an error."""
    found = len(df.inputFiles())
    if found != n:
        raise ValueError(f"{found} files, not {n}")
    return df


def first_files(paths: list[str], most: int | None) -> list[str]:
    """The first files of a sorted list without repeats; all without a bound."""
    return sorted(dict.fromkeys(paths))[:most]


def pdf_files(spark: SparkSession, path: str, most_bytes: int = 40 << 20) -> DataFrame:
    """(file, length, content) of the PDF files of a folder: no larger than a bound, and with the format's first bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).where(F.col("length") <= most_bytes)
    return rows.where(F.substring("content", 1, 4) == F.lit(b"%PDF")).select(F.col("path").alias("file"), "length", "content")


def text_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file, text) of whole text files, gzip too; invalid bytes become U+FFFD, all folders below are read."""
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.make_valid_utf8("value").alias("text"))


def spread_slices(spark: SparkSession, path: str, spread: int, slice_bytes: int) -> DataFrame:
    """(file, slice, text): evenly spaced slices of large text files, whole lines only; only the slices' bytes are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    jobs = files.select("path", "length", F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("slice"))
    begin = F.greatest(F.lit(0), F.floor((F.col("slice") + 0.5) / spread * F.col("length") - slice_bytes / 2)).cast("long")
    schema = pa.schema([("file", pa.string()), ("slice", pa.int32()), ("raw", pa.binary())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, k, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                store, local = fs.FileSystem.from_uri(file if "://" in file else file.replace("file:", "file://", 1))
                with store.open_input_file(local) as f:
                    f.seek(at)
                    raw = f.read(slice_bytes)
                yield pa.record_batch([pa.array([x], t.type) for x, t in zip((file, k, raw), schema, strict=True)], schema=schema)

    rows = jobs.select("path", "slice", begin.alias("begin")).repartition(spread).mapInArrow(read, "file string, slice int, raw binary")
    return rows.select("file", "slice", trimmed_slice(F.make_valid_utf8(F.col("raw"))).alias("text"))


def _kept(parts: Column) -> Column:
    return F.filter(F.transform(parts, lambda p: tx.replaced(tx.replaced(p, f"^[{tx.WHITE_SPACE}]+", ""), f"[{tx.WHITE_SPACE}]+\\z", "")), lambda p: p != "")


def by_line(text: Column) -> Column:
    """A document per line that isn't blank; carriage returns at its end are dropped."""
    lines = F.transform(F.split(text, "\n"), lambda x: tx.replaced(x, "[\r\n]+\\z", ""))
    return F.filter(lines, lambda x: tx.replaced(x, f"[{tx.WHITE_SPACE}]+", "") != "")


def by_blank_lines(text: Column) -> Column:
    """Blocks of lines between blank ones."""
    blocks = F.split(text, "\n(?:[ \t\r\f\x0b]*\n)+")
    return F.filter(F.transform(blocks, lambda b: tx.replaced(tx.replaced(b, "^[ \t\r\f\x0b]*\n", ""), "\n[ \t\r\f\x0b]*\\z", "")), lambda b: tx.replaced(b, f"[{tx.WHITE_SPACE}]+", "") != "")


def by_markers(text: Column) -> Column:
    """What stands between start and end markers; a start ends the document before it, an open last one counts, junk before the first start doesn't."""
    starts = F.slice(F.split(text, START.replace("|", "\\|")), 2, 1 << 30)
    return _kept(F.transform(starts, lambda p: F.substring_index(p, END, 1)))


def by_separator(text: Column, separator: str = SEPARATOR) -> Column:
    """Documents between separator lines, blank lines inside kept."""
    return _kept(F.split(text, "(?m)^" + separator.replace("|", "\\|") + "[ \t\r]*$"))


def by_header(text: Column, prefix: str) -> Column:
    """A line that begins with the prefix starts a document, and is dropped."""
    return _kept(F.split(text, f"(?m)^{prefix}.*$"))


def documents(files: DataFrame, splitter: Column) -> DataFrame:
    """(file, pos, text) of the documents that a splitter finds."""
    return files.select("file", F.posexplode(splitter).alias("pos", "text"))


def trimmed_slice(text: Column, delimiter: str = "\n") -> Column:
    """The whole documents of a slice: what lies between its first and last delimiter; empty without two."""
    first, last = F.instr(text, delimiter), F.length(text) - F.instr(F.reverse(text), delimiter[::-1]) + 1
    return F.when((first > 0) & (last > first), F.substring(text, first + len(delimiter), last - first - len(delimiter))).otherwise("")


def json_line_text(line: Column) -> Column:
    """The first of the usual keys of a JSON line, else the line."""
    return F.coalesce(*[F.get_json_object(line, f"$.{k}") for k in ("text", "content", "document", "body")], line)


def _member(v: Column, key: str) -> Column:
    """A member that is a string, trimmed and not empty, else null."""
    got = F.try_variant_get(v, f"$.{key}", "variant")
    return F.when(F.schema_of_variant(got) == "STRING", F.nullif(F.trim(F.try_variant_get(v, f"$.{key}", "string")), F.lit("")))


def entity_text(description: Column, properties: Column) -> Column:
    """The text of a row whose body lies in JSON: code or document, question and answer, CAD, else the description.

    Members count if they are strings. Options may be a list or a list in a string; pairs may use two key styles.
    """
    v = F.try_parse_json(properties)
    get = lambda k: _member(v, k)
    fallback = F.coalesce(description, F.lit(""))
    body = F.coalesce(*[get(k) for k in ("code_content", "doc_content", "text", "content")])
    listed = F.coalesce(F.try_variant_get(v, "$.options", "array<string>"), F.from_json(F.try_variant_get(v, "$.options", "string"), "array<string>"))
    options = F.transform(F.filter(listed, lambda o: o.isNotNull() & (o != "")), lambda o: F.concat(F.lit("- "), o))
    explanation = get("explanation")
    qa = F.concat_ws(
        "\n\n",
        F.concat(F.lit("Question: "), get("question")),
        F.when(F.size(options) > 0, F.concat(F.lit("Options:\n"), F.array_join(options, "\n"))),
        F.concat(F.lit("Answer: "), get("answer")),
        F.when(~F.startswith(explanation, F.lit("Source origin:")), F.concat(F.lit("Explanation: "), explanation)),
    )
    sketch = F.concat(F.lit("Objective: "), get("objective_prompt"), F.lit("\n\nCompletion:\n"), get("sketch_extrude_completion"))
    pairs = F.from_json(F.try_variant_get(v, "$.qa_pairs", "variant").cast("string"), "array<struct<question:string,q:string,answer:string,a:string>>")
    pick = lambda x, y: F.nullif(F.trim(F.coalesce(F.nullif(x, F.lit("")), y)), F.lit(""))
    lines = F.filter(F.transform(pairs, lambda p: F.concat(F.lit("Q: "), pick(p["question"], p["q"]), F.lit("\nA: "), pick(p["answer"], p["a"]))), lambda x: x.isNotNull())
    own = F.filter(F.array(get("cadquery_code"), get("step_file_snippet")), lambda x: x.isNotNull())
    parts = F.concat(own, F.coalesce(lines, F.filter(F.array(get("qa_pairs")), lambda x: x.isNotNull())))
    cad = F.concat_ws("\n\n", F.nullif(F.trim(description), F.lit("")), F.array_join(parts, "\n\n"))
    return F.when(v.isNull() | ~F.startswith(F.schema_of_variant(v), F.lit("OBJECT")), fallback).otherwise(
        F.coalesce(body, F.when(get("question").isNotNull() & get("answer").isNotNull(), qa), sketch, F.when(F.size(parts) > 0, cad), fallback)
    )


def notebook_text(raw: Column) -> Column:
    """Cells that aren't blank, joined by blank lines; those of text are marked. A source is a string or a list of lines; null if there is no JSON."""
    lines = lambda c: F.try_variant_get(c, "$.source", "array<string>")
    source = lambda c: F.coalesce(F.array_join(lines(c), ""), F.try_variant_get(c, "$.source", "string"), F.lit(""))
    cells = F.transform(F.coalesce(F.try_variant_get(F.try_parse_json(raw), "$.cells", "array<variant>"), F.array().cast("array<variant>")), lambda c: F.struct(F.try_variant_get(c, "$.cell_type", "string").alias("kind"), source(c).alias("text")))
    full = F.filter(cells, lambda c: tx.replaced(c["text"], f"[{tx.WHITE_SPACE}]+", "") != "")
    text = F.array_join(F.transform(full, lambda c: F.concat(F.when(c["kind"].eqNullSafe("markdown"), "# [markdown]\n").otherwise(""), c["text"])), "\n\n")
    return F.when(F.try_parse_json(raw).isNotNull(), text)


def paper_text(title: Column, sections: Column) -> Column:
    """Title, then sections (label, body) as "Label: body" lines."""
    line = lambda s: F.when(F.coalesce(s["label"], F.lit("")) == "", s["body"]).otherwise(F.concat(tx.capitalized(s["label"]), F.lit(": "), s["body"]))
    return F.concat(title, F.lit("\n\n"), F.array_join(F.transform(sections, line), "\n"))


_MEMBERS = pa.schema([("file", pa.string()), ("member", pa.string()), ("content", pa.binary())])


def _zip_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for info in z.infolist():
            if not info.is_dir():
                raw = z.read(info)
                yield info.filename, gzip.decompress(raw) if info.filename.endswith(".gz") else raw


def _tar_members(data: bytes) -> Iterator[tuple[str, bytes]]:
    with tarfile.open(fileobj=io.BytesIO(data)) as t:
        for info in t:
            if info.isfile():
                yield info.name, t.extractfile(info).read()


def archive_members(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(file, member, content) of zip or tar archives; gzip members of a zip are unpacked. An archive is one task's work."""
    open_ = {"zip": _zip_members, "tar": _tar_members}[kind]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for name, raw in open_(data):
                    yield pa.record_batch([pa.array([x], f.type) for x, f in zip((file, name, raw), _MEMBERS, strict=True)], schema=_MEMBERS)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(read, "file string, member string, content binary")


def _articles(data: bytes, least: int, english: bool) -> Iterator[tuple]:
    import xml.etree.ElementTree as ET

    flat = lambda e: "" if e is None else "".join(e.itertext()).strip()
    for _, node in ET.iterparse(io.BytesIO(data), events=("end",)):
        if node.tag != "PubmedArticle":
            continue
        languages = [x.text for x in node.iter("Language")]
        sections = [(s.get("Label"), flat(s)) for s in node.iter("AbstractText") if flat(s)]
        body = "\n".join(f"{label.capitalize()}: {x}" if label else x for label, x in sections)
        if len(body) >= least and (not english or not languages or "eng" in languages):
            title = flat(next(node.iter("ArticleTitle"), None))
            yield flat(next(node.iter("PMID"), None)), f"{title}\n\n{body}" if title else body
        node.clear()


_ARTICLES = pa.schema([("doc_id", pa.string()), ("domain", pa.string()), ("text", pa.string()), ("char_count", pa.int64())])


def articles(contents: DataFrame, domain: str, least: int = 200, english: bool = True) -> DataFrame:
    """(doc_id, domain, text, char_count) of the articles of XML files (a binary column ``content``), inline markup flattened."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = [(i, domain, x, len(x)) for i, x in _articles(data, least, english)]
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _ARTICLES, strict=True)], schema=_ARTICLES)

    return contents.select("content").mapInArrow(read, "doc_id string, domain string, text string, char_count long")


def eval_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of JSONL files, with the file's name; an id that occurs twice is an error."""
    rows = spark.read.option("recursiveFileLookup", "true").json(path).select("*", F.element_at(F.split("_metadata.file_path", "/"), -1).alias("_file"))
    twice = rows.groupBy("id").count().where("count > 1").limit(5).collect()
    if twice:
        raise ValueError(f"ids occur twice: {[r['id'] for r in twice]}")
    return rows


def manifest_problems(spark: SparkSession, path: str, expected: DataFrame) -> DataFrame:
    """(file, expected, found) of files that are missing or whose SHA-256 differs from the expected one."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.element_at(F.split("path", "/"), -1).alias("file"), F.sha2("content", 256).alias("found"))
    return expected.join(found, "file", "left").where(~F.col("expected").eqNullSafe(F.col("found")))
