"""Queries that audit corpora and runs: splits by index, curves, flags, probes, markers, reconciliation."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import arrays, paper
from corpusmill.functions import text as tx
from corpusmill.operators import sampling
from corpusmill.plans.registry import Tables, query


@query("""
    WITH n AS (SELECT doc_id, n_chars, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS i FROM documents),
    c AS (SELECT *, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM n)
    SELECT doc_id, CASE WHEN i % 20 = 0 THEN 'val' ELSE 'train' END AS split, CAST(least(n_chars, 50000 - before) AS BIGINT) AS taken FROM c WHERE before < 50000""")
def index_modulo_split(t: Tables):
    """Every twentieth document of a source is validation; a cap on the source's size cuts the document that passes it."""
    rows = t.documents.select("doc_id", "source", "n_chars")
    return sampling.index_split(rows, F.col("n_chars"), "source", "doc_id", 20, 50_000).select("doc_id", "split", "taken")


@query("""SELECT a.event_id AS step, a.value AS train, b.value AS val FROM (SELECT * FROM events WHERE event_type = 'view') a
    LEFT JOIN (SELECT user_id, max(value) AS value, ts FROM events WHERE event_type = 'click' GROUP BY user_id, ts) b ON a.user_id = b.user_id AND a.ts = b.ts""")
def loss_curve_join(t: Tables):
    a = t.events.where("event_type = 'view'").select(F.col("event_id").alias("step"), F.col("value").alias("train"), "user_id", "ts")
    b = t.events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("val"))
    return a.join(b, ["user_id", "ts"], "left").select("step", "train", "val")


@query("""
    WITH x AS (SELECT doc_id, list_filter(string_split(text, ' '), lambda w: w <> '') AS w, text AS t FROM documents),
    g AS (SELECT *, list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: array_to_string(w[i:i + 2], ' ')) AS g3, w[1:8] AS head, w[9:] AS out FROM x)
    SELECT doc_id, len(out) = 0 AS empty, len(w) >= 24 AND len(list_distinct(g3)) / nullif(len(g3), 0) < 0.5 AS loop, contains(t, chr(65533)) AS invalid,
           len(out) >= 8 AND out[1:8] = head AS copies FROM g""")
def generation_flags(t: Tables):
    """The first eight words of a text as a prompt, all others as an output."""
    rows = t.documents.select("doc_id", F.col("text").alias("t"), F.filter(F.split("text", " "), lambda w: w != "").alias("w"))
    out = F.filter("w", lambda w, i: i >= 8)
    rows = rows.select("doc_id", "t", "w", out.alias("out"), F.slice("w", 1, 8).alias("prompt"))
    return rows.select("doc_id", (F.size("out") == 0).alias("empty"), arrays.repetition_loop(F.col("w")).alias("loop"), F.contains("t", F.lit(tx.REPLACEMENT)).alias("invalid"), arrays.copies_tail(F.col("out"), F.col("prompt")).alias("copies"))


@query("""SELECT source, count(*) AS n, count(quality) AS scored, round(avg(quality), 9) AS pass_rate, round(avg(n_chars), 6) AS mean_chars FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def generation_summary(t: Tables):
    """Pass rates over scored rows only; null where none is."""
    j = t.documents.join(t.labels, "doc_id", "left")
    return j.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count("quality").alias("scored"), F.round(F.avg("quality"), 9).alias("pass_rate"), F.round(F.avg("n_chars"), 6).alias("mean_chars"))


@query("""
    WITH x AS (SELECT vec_id, embedding AS e, list_reverse(embedding) AS r FROM embeddings),
    p AS (SELECT vec_id, list_position(e, list_max(e)) - 1 AS a, list_position(r, list_max(r)) - 1 AS b, len(e) AS n FROM x)
    SELECT a AS pick, count(*) AS items, count(*) FILTER (a = n - 1 - b) AS consistent FROM p GROUP BY a""")
def probe_order_consistency(t: Tables):
    """Options reversed: the pick should move with them."""
    e = F.col("embedding")
    rows = t.embeddings.select(arrays.first_argmax(e).alias("a"), arrays.first_argmax(F.reverse(e)).alias("b"), F.size(e).alias("n"))
    return rows.groupBy(F.col("a").alias("pick")).agg(F.count(F.lit(1)).alias("items"), F.count(F.when(F.col("a") == F.col("n") - 1 - F.col("b"), 1)).alias("consistent"))


@query("""SELECT CASE WHEN regexp_matches(html, '<script') THEN 'script' WHEN regexp_matches(html, '<style') THEN 'style' ELSE 'none' END AS marker, count(*) AS pages FROM pages GROUP BY 1""")
def code_markers(t: Tables):
    h = F.col("html")
    return t.pages.groupBy(F.when(h.rlike("<script"), "script").when(h.rlike("<style"), "style").otherwise("none").alias("marker")).agg(F.count(F.lit(1)).alias("pages"))


@query("""
    WITH k AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, text), s AS (SELECT source, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 13))::UBIGINT % 1000000 < 100000 AS BOOLEAN) AS val FROM k)
    SELECT source, count(*) AS kept, count(*) FILTER (val) AS val, count(*) FILTER (NOT val) AS train, count(*) = count(*) FILTER (val) + count(*) FILTER (NOT val) AS agrees FROM s GROUP BY source""")
def reconciliation(t: Tables):
    """Kept documents are those of both splits together."""
    kept = t.documents.groupBy("source", F.md5("text").alias("k")).agg(F.min("doc_id").alias("doc_id"))
    rows = kept.select("source", sampling.is_validation(F.col("doc_id").cast("string"), 0.1).alias("val"))
    n = lambda c: F.count(F.when(c, 1))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("kept"), n(F.col("val")).alias("val"), n(~F.col("val")).alias("train"), (F.count(F.lit(1)) == n(F.col("val")) + n(~F.col("val"))).alias("agrees"))


@query("""
    WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '\\b(?:the|and|for|der|und|les|des|los)\\b')) AS term FROM documents)
    SELECT a.term AS a, b.term AS b, count(*) AS docs FROM w a JOIN w b ON a.doc_id = b.doc_id AND a.term < b.term GROUP BY ALL""")
def term_cooccurrence(t: Tables):
    """Documents that hold both terms of a pair; a document holds at most eight terms."""
    terms = F.array_distinct(tx.ascii_words("text", ["the", "and", "for", "der", "und", "les", "des", "los"]))
    rows = t.documents.select(F.array_sort(terms).alias("w"))
    pairs = rows.select(F.explode("w").alias("a"), "w").select("a", F.explode("w").alias("b")).where("a < b")
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("docs"))


@query("""SELECT source, round(sum(n_chars * (1.0 + length(lang))) / sum(n_chars), 9) AS weighted, round(avg(1.0 + length(lang)), 9) AS plain FROM documents GROUP BY source""")
def domain_loss(t: Tables):
    """A mean by tokens and one by windows."""
    loss = 1.0 + F.length("lang")
    return t.documents.groupBy("source").agg(F.round(F.sum(F.col("n_chars") * loss) / F.sum("n_chars"), 9).alias("weighted"), F.round(F.avg(loss), 9).alias("plain"))


@query("""
    WITH w AS (SELECT item_id, list_filter(string_split(translate(text, '.:?!' || chr(10), '     '), ' '), lambda x: x <> '') AS w FROM benchmark),
    l AS (SELECT item_id, list_transform(range(0, len(w), 8), lambda i: 'L' || i || ' ' || array_to_string(w[i + 1:i + 8], ' ')) AS l FROM w)
    SELECT item_id, array_to_string(l, ' ') || ' End ' || item_id || '.' || chr(10) || chr(10) || 'first office of ' || item_id || chr(10) || chr(10) || array_to_string(l, ' ') || ' twice' AS text FROM l""")
def paper_cleaned(t: Tables):
    """Benchmark items as pages of a PDF: lines of eight words are joined; a short last line that ends a sentence, or an empty one, ends a paragraph.

    Ligatures, line-end hyphens, glyph numbers, running heads, page numbers and the list of references are taken out.
    """
    i = F.col("item_id").cast("string")
    words = F.filter(F.split(F.translate("text", ".:?!\n", "     "), " "), lambda x: x != "")
    cut = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.size(w) - 1) / 8).cast("int")), lambda k: F.concat(F.lit("L"), k * 8, F.lit(" "), F.array_join(F.slice(w, k * 8 + 1, 8), " ")))
    body = F.array_join(arrays.let(words, cut), "  \n")
    page = lambda n: F.lit(f"\nRunning Head\n{n}\n")
    raw = F.concat(page("1 of 3"), body, F.lit("\nEnd "), i, F.lit(".\n"), page("2 / 3"), F.lit("ﬁrst of-\nﬁce\u200b of(cid:7) "), i, F.lit("\n\n"), body, F.lit(" twice\n"), page("page 3"), F.lit("References\n[1] x\n"))
    return t.benchmark.select("item_id", paper.clean(raw).alias("text"))
