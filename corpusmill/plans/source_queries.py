"""Queries on splitters, JSON rows, token tables and the tokenizer."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.functions import text as tx
from corpusmill.operators import logs, sampling, tokenizer
from corpusmill.plans.registry import Tables, query
from corpusmill.sources import documents as src


@query("""SELECT doc_id, generate_subscripts(l, 1) - 1 AS pos, unnest(l) AS line FROM (SELECT doc_id, list_filter(string_split(text, chr(10)), lambda s: trim(s) <> '') AS l FROM documents)""")
def line_docs(t: Tables):
    """Texts that are read as a document per line."""
    rows = t.documents.select("doc_id", F.posexplode(src.by_line(F.col("text"))).alias("pos", "line"))
    return rows.select("doc_id", F.col("pos").cast("long").alias("pos"), "line")


@query("""SELECT doc_id, CAST(count(*) AS BIGINT) AS n, max(length(d)) AS longest FROM (SELECT doc_id, unnest(string_split_regex(replace(text, '. ', '.' || chr(10) || ' ' || chr(10)), '\\n(?:[ \\t]*\\n)+')) AS d FROM documents) WHERE trim(d) <> '' GROUP BY doc_id""")
def blank_blocks(t: Tables):
    """Texts whose sentences are parted by blank lines, as blocks."""
    parted = F.replace("text", F.lit(". "), F.lit(".\n \n"))
    rows = t.documents.select("doc_id", F.explode(src.by_blank_lines(parted)).alias("d"))
    return rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("d")).cast("long").alias("longest"))


@query("""SELECT conv_id, trim(text, ' ' || chr(10)) AS text, turn FROM conversations WHERE role <> 'system' AND trim(text, ' ' || chr(10)) <> ''""")
def marker_docs(t: Tables):
    """A conversation as marked documents, read back: system turns stand before the first marker and are dropped."""
    line = F.concat(F.lit("<|document|>\n"), F.col("turn").cast("string"), F.lit("\t"), F.col("text"), F.lit("\n<|endofdocument|>"))
    rows = t.conversations.where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x")))).alias("xs"))
    text = F.concat(F.lit("junk\n"), F.array_join("xs.x", "\n"))
    docs = rows.select("conv_id", F.explode(src.by_markers(text)).alias("d"))
    return docs.select("conv_id", F.trim(F.regexp_extract("d", r"(?s)^[0-9]+\t[ \n]*(.*)$", 1)).alias("text"), F.regexp_extract("d", r"^([0-9]+)\t", 1).cast("long").alias("turn")).where("text <> ''")


_TURNS = """WITH x AS (SELECT conv_id, turn, role, trim(text, ' ' || chr(10)) AS text FROM conversations)
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, text FROM x WHERE text <> ''"""


def _turns(t: Tables, line) -> DataFrame:
    return t.conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("x"))))["x"].alias("xs"))


@query(_TURNS)
def separator_docs(t: Tables):
    """Turns between separator lines, blank lines inside them kept."""
    rows = _turns(t, F.col("text")).select("conv_id", F.array_join("xs", "\n<|endoftext|>\n").alias("text"))
    return rows.select("conv_id", F.posexplode(src.by_separator(F.col("text"))).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


@query(_TURNS)
def header_docs(t: Tables):
    """Turns behind header lines, which are dropped."""
    rows = _turns(t, F.concat(F.lit("chempile-"), "role", F.lit("\n"), "text")).select("conv_id", F.array_join("xs", "\n").alias("text"))
    return rows.select("conv_id", F.posexplode(src.by_header(F.col("text"), "chempile-")).alias("pos", "text")).withColumn("pos", F.col("pos").cast("long"))


@query("""SELECT doc_id, md5(CASE WHEN len(string_split(text, chr(10))) < 3 THEN '' ELSE array_to_string(string_split(text, chr(10))[2:-2], chr(10)) END) AS h FROM documents""")
def trimmed_slices(t: Tables):
    return t.documents.select("doc_id", F.md5(src.trimmed_slice(F.col("text"))).alias("h"))


@query("SELECT doc_id, text FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, '{\"other\":1}' FROM documents WHERE doc_id % 2 = 1")
def json_line_text(t: Tables):
    line = F.when(F.col("doc_id") % 2 == 0, F.to_json(F.struct(F.col("text").alias("content")))).otherwise('{"other":1}')
    return t.documents.select("doc_id", src.json_line_text(line).alias("text"))


@query("""SELECT item_id, CASE item_id % 5 WHEN 0 THEN trim(text) WHEN 1 THEN 'Question: ' || trim(text) || chr(10) || chr(10) || 'Options:' || chr(10) || '- a' || chr(10) || '- b' || chr(10) || chr(10) || 'Answer: ' || item_id
    WHEN 2 THEN 'd' || item_id WHEN 3 THEN 'd' || item_id || chr(10) || chr(10) || 'step' || chr(10) || chr(10) || 'Q: x' || chr(10) || 'A: y' ELSE 'd' || item_id END AS text FROM benchmark""")
def v4_text(t: Tables):
    """Rows whose text lies in JSON: code, question, broken, CAD with pairs, nothing usable."""
    i, none = F.col("item_id"), F.lit(None).cast("string")
    code = F.to_json(F.struct(F.col("text").alias("code_content")))
    question = F.to_json(F.struct(F.col("text").alias("question"), F.array(F.lit("a"), F.lit(""), F.lit("b")).alias("options"), i.cast("string").alias("answer"), F.lit("Source origin: z").alias("explanation")))
    cad = F.to_json(F.struct(F.lit("step").alias("step_file_snippet"), F.array(F.struct(F.lit("x").alias("q"), F.lit("y").alias("a"))).alias("qa_pairs")))
    body = F.when(i % 5 == 0, code).when(i % 5 == 1, question).when(i % 5 == 2, "{broken").when(i % 5 == 3, cad).otherwise(F.coalesce(none, F.lit('{"text": 5}')))
    return t.benchmark.select("item_id", src.entity_text(F.concat(F.lit("d"), i), body).alias("text"))


@query("SELECT page_id, CASE page_id % 2 WHEN 0 THEN '# [markdown]' || chr(10) || page_id || chr(10) || 'two' ELSE '# [markdown]' || chr(10) || page_id END || chr(10) || chr(10) || 'x = ' || page_id AS text FROM pages")
def notebook_text(t: Tables):
    """Sources as lists of lines and as plain strings; blank cells go."""
    i = F.col("page_id").cast("string")
    lists = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":["'), i, F.lit('\\n","two"]},{"cell_type":"code","source":[" "]},{"cell_type":"code","source":["x = ","'), i, F.lit('"]}]}'))
    strings = F.concat(F.lit('{"cells":[{"cell_type":"markdown","source":"'), i, F.lit('"},{"cell_type":"raw","source":""},{"cell_type":"raw"},{"cell_type":"code","source":"x = '), i, F.lit('"}]}'))
    return t.pages.select("page_id", src.notebook_text(F.when(F.col("page_id") % 2 == 0, lists).otherwise(strings)).alias("text"))


@query("SELECT item_id, upper(left(text, 5)) || chr(10) || chr(10) || 'Methods: ' || text || chr(10) || text AS text FROM benchmark")
def paper_text(t: Tables):
    section = lambda label: F.struct(F.lit(label).cast("string").alias("label"), F.col("text").alias("body"))
    return t.benchmark.select("item_id", src.paper_text(tx.upper(F.left("text", F.lit(5))), F.array(section("METHODS"), section(None))).alias("text"))


@query()
def pretokenized(t: Tables):
    """Pieces, joined again: every text comes back whole."""
    p = tokenizer.pieces(F.col("text"))
    return t.documents.select("doc_id", F.size(p).alias("n"), (F.array_join(p, "") == F.col("text")).alias("whole"))


@lru_cache(maxsize=1)
def _vocabulary(folder: str, spark) -> tokenizer.Vocabulary:
    return tokenizer.train_on(Tables(spark, folder).benchmark, 600)


@query()
def bpe_train(t: Tables):
    """A vocabulary of 600 tokens from the benchmark's texts."""
    return _vocabulary(t.folder, t.spark).table(t.spark)


@query()
def bpe_encode(t: Tables):
    """All documents as ids of the benchmark's vocabulary."""
    rows = tokenizer.encode(t.documents, _vocabulary(t.folder, t.spark), eos=0)
    return rows.select("doc_id", F.size("ids").alias("n"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@query()
def bpe_stats(t: Tables):
    """Per source: documents, tokens, bytes a token, the share of single-byte tokens, and texts that don't come back whole."""
    return tokenizer.statistics(t.documents, _vocabulary(t.folder, t.spark), "source")


@query()
def vocabulary_checks(t: Tables):
    """Named checks of the vocabulary over all documents."""
    return tokenizer.verify(t.documents, _vocabulary(t.folder, t.spark))


_IDS = "ids AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda w: 1 + length(w)) || [0] AS ids, source AS file FROM documents)"


def _id_rows(t: Tables):
    """Word lengths as stand-in ids, an end id of 0 behind each document."""
    ids = F.concat(F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.length(w) + 1), F.array(F.lit(0)))
    return t.documents.select(F.col("source").alias("file"), F.col("doc_id").alias("doc"), ids.alias("ids"))


@query(f"WITH {_IDS} SELECT file, CAST(sum(len(ids)) AS BIGINT) AS tokens, CAST(count(*) AS BIGINT) AS docs, CAST(max(list_max(ids)) AS BIGINT) AS max_id, 0 AS last, max(list_max(ids)) >= 30 AS bad FROM ids GROUP BY file")
def token_profile(t: Tables):
    """Per file: tokens, documents, the greatest id, and whether an id is outside a vocabulary of 30."""
    p = tokenizer.profile(_id_rows(t), 30, 0)
    return p.select("file", "tokens", "docs", F.col("max_id").cast("long").alias("max_id"), "last", F.array_contains("problems", "id outside the vocabulary").alias("bad"))


@query(f"WITH {_IDS} SELECT count(DISTINCT list_max(ids)) = 1 AS one_vocabulary FROM ids")
def vocabulary_agreement(t: Tables):
    return _id_rows(t).agg((F.count_distinct(F.array_max("ids")) == 1).alias("one_vocabulary"))


@query(f"""WITH {_IDS}, x AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS i FROM ids),
    e AS (SELECT doc_id, id, count(*) FILTER (id = 0) OVER (PARTITION BY doc_id % 10 ORDER BY doc_id, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS run, doc_id % 10 AS stream FROM x)
    SELECT stream, run, count(*) AS n, min(doc_id) AS doc_id FROM e GROUP BY ALL""")
def eos_boundaries(t: Tables):
    """Ten streams of ids, cut into documents at end ids: ends are counted in each row's array, and summed over rows, not tokens."""
    rows = _id_rows(t).select("doc", (F.col("doc") % 10).alias("stream"), "ids")
    ends = F.size(F.filter("ids", lambda i: i == 0))
    rows = sampling.ranked(rows, ["doc"], ["stream"], ends)
    cut = lambda ids: F.array_append(F.filter(F.transform(ids, lambda x, i: F.when(x == 0, i + 1)), lambda x: x.isNotNull()), F.size(ids))
    sizes = arrays.let(F.col("ids"), lambda ids: arrays.let(cut(ids), lambda c: F.transform(c, lambda end, k: end - F.when(k > 0, F.get(c, k - 1)).otherwise(0))))
    runs = rows.select("stream", "doc", "_before", F.posexplode(sizes).alias("k", "n")).where("n > 0")
    return runs.groupBy("stream", (F.col("_before") + F.col("k")).alias("run")).agg(F.sum("n").alias("n"), F.min("doc").alias("doc_id"))


@query(f"""WITH {_IDS}, s AS (SELECT doc_id, ids, unnest(range(0, len(ids), 64)) AS start FROM ids) SELECT doc_id, start, CAST(len(ids[start + 1:start + 65]) AS BIGINT) AS n FROM s WHERE start < len(ids) - 64""")
def sequential_windows(t: Tables):
    """Windows of 64 ids and the next, in order, none that overlaps."""
    rows = _id_rows(t).select(F.col("doc").alias("doc_id"), "ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(64))).alias("start"))
    return rows.where(F.col("start") < F.size("ids") - 64).select("doc_id", F.col("start").cast("long").alias("start"), F.size(F.slice("ids", F.col("start") + 1, 65)).cast("long").alias("n"))


@query(f"WITH {_IDS}, x AS (SELECT unnest(ids) AS id FROM ids) SELECT CAST(count(*) AS BIGINT) AS tokens, count(DISTINCT id) AS used, round(avg(CAST(id < 5 AS INT)), 9) AS low_share FROM x")
def tokenisation_stats(t: Tables):
    x = _id_rows(t).select(F.explode("ids").alias("id"))
    return x.agg(F.count(F.lit(1)).alias("tokens"), F.count_distinct("id").alias("used"), F.round(F.avg((F.col("id") < 5).cast("int")), 9).alias("low_share"))


@query()
def file_digests(t: Tables):
    """SHA-256 of the files that the small tables lie in; the path is no table's column, so SQL can't say it."""
    found = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load([f"{t.folder}/{x}.parquet" for x in ("region", "nation", "benchmark", "labels")])
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


@query("""WITH d AS (SELECT doc_id, sha256(text || '|v1') AS fp FROM documents), done AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'old' ELSE fp END AS fp FROM d WHERE doc_id % 3 <> 0 OR doc_id % 9 = 0)
    SELECT doc_id FROM d ANTI JOIN done USING (doc_id, fp)""")
def resume_todo(t: Tables):
    """Work whose fingerprint (content and settings) is not in the log."""
    d = t.documents.select("doc_id", F.sha2(F.concat("text", F.lit("|v1")), 256).alias("fp"))
    i = F.col("doc_id")
    done = d.where((i % 3 != 0) | (i % 9 == 0)).select("doc_id", F.when(i % 9 == 0, "old").otherwise(F.col("fp")).alias("fp"))
    return d.join(done, ["doc_id", "fp"], "left_anti").select("doc_id")


@query("""SELECT 'finite' AS "check", bool_and(isfinite(value)) AS passed FROM events UNION ALL SELECT 'progress', max(event_id) > 0 FROM events UNION ALL SELECT 'small', max(value) < 1 FROM events""")
def training_gates(t: Tables):
    """A run's series as named checks."""
    v = F.col("value")
    return logs.gate([("finite", F.bool_and(~F.isnan(v) & (F.abs(v) != float("inf")))), ("progress", F.max("event_id") > 0), ("small", F.max("value") < 1)], t.events)
