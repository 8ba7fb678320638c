"""Queries on prompts, instruction rows, checkpoints, samples of training data."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import arrays, prompts
from corpusmill.functions import text as tx
from corpusmill.operators import filters, logs, ngrams, sampling, sft
from corpusmill.plans.registry import Tables, query

_SHOTS = "(VALUES ('plain', 1, 'How many?', NULL, 3.0), ('plain', 2, 'What share?', NULL, 0.125), ('worked', 1, 'What is 2+2?', '2 + 2 = 4.', 4.0)) v(name, k, q, s, a)"


@query(f"""
    WITH s AS (SELECT name, string_agg('Question: ' || q || chr(10) || 'Answer: ' || CASE WHEN s IS NULL THEN '' ELSE s || ' The answer is ' END || (CASE a WHEN 3 THEN '3' WHEN 4 THEN '4' ELSE '0.125' END)
                   || CASE WHEN s IS NULL THEN '' ELSE '.' END || chr(10) || chr(10), '' ORDER BY k) AS shots FROM {_SHOTS} GROUP BY name)
    SELECT item_id, coalesce(shots, '') || 'Question: ' || text || chr(10) || 'Answer:' AS prompt, 'Question: ' || text || chr(10) || 'Answer:' AS context
    FROM benchmark LEFT JOIN s ON name = CASE item_id % 3 WHEN 0 THEN 'plain' WHEN 1 THEN 'worked' END""")
def prompt_texts(t: Tables):
    """Items with worked examples by name, without, and with none."""
    rows = [("plain", [("How many?", None, 3.0), ("What share?", None, 0.125)]), ("worked", [("What is 2+2?", "2 + 2 = 4.", 4.0)])]
    shots = t.spark.createDataFrame(rows, "name string, shots array<struct<question:string,solution:string,answer:double>>")
    items = t.benchmark.withColumn("fewshot", F.when(F.col("item_id") % 3 == 0, "plain").when(F.col("item_id") % 3 == 1, "worked"))
    joined = prompts.with_shots(items, shots)
    return joined.select("item_id", prompts.numeric_prompt(F.col("text"), F.col("shots")).alias("prompt"), prompts.choice_context(F.col("text")).alias("context"))


@query("SELECT event_id, CASE WHEN v = floor(v) THEN CAST(CAST(v AS BIGINT) AS VARCHAR) ELSE printf('%g', v) END AS written FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN round(value) WHEN 1 THEN value / 1000000 WHEN 2 THEN value * 100000 ELSE value END AS v FROM events)")
def short_numbers(t: Tables):
    """Numbers as prompts write them."""
    i, v = F.col("event_id") % 4, F.col("value")
    x = F.when(i == 0, F.round(v)).when(i == 1, v / 1000000).when(i == 2, v * 100000).otherwise(v)
    return t.events.select("event_id", prompts.short_number(x).alias("written"))


@query("""
    WITH e AS (SELECT list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS e, vec_id % len(embedding) AS y FROM embeddings),
    s AS (SELECT e, y, list_max(e) AS peak, list_max(e) + ln(list_sum(list_transform(e, lambda v: exp(v - list_max(e))))) AS z, e[y + 1] AS own FROM e),
    m AS (SELECT z - own AS ce, CAST(list_position(e, peak) - 1 = y AS INT) AS hit, exp(peak - z) AS conf,
                 CAST(len(list_filter(list_transform(range(1, len(e) + 1), lambda i: e[i] > own OR (e[i] = own AND i - 1 < y)), lambda b: b)) < 5 AS INT) AS five FROM s),
    b AS (SELECT least(floor(conf * 10), 9) AS bin, count(*) AS n, sum(ce) AS ce, sum(hit) AS hit, sum(five) AS five, sum(conf) AS conf FROM m GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS tokens, round(sum(ce) / sum(n), 6) AS cross_entropy, round(exp(least(sum(ce) / sum(n), 50)), 4) AS perplexity, round(sum(hit) / sum(n), 9) AS top1, round(sum(five) / sum(n), 9) AS top5,
           round(sum(abs(conf - hit)) / sum(n), 6) AS calibration_error FROM b""")
def next_token_metrics(t: Tables):
    """Embeddings as scores of next tokens; the target goes by the row's number."""
    rows = t.embeddings.select("embedding", (F.col("vec_id") % F.size("embedding")).cast("int").alias("target"))
    m = logs.next_token_metrics(rows, "embedding", "target")
    digits = {"cross_entropy": 6, "perplexity": 4, "top1": 9, "top5": 9, "calibration_error": 6}
    return m.select("tokens", *[F.round(c, n).alias(c) for c, n in digits.items()])


@query("""
    WITH c AS (SELECT event_id AS step, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN value + 0.5 ELSE value + 1e-9 END AS val_loss, CASE WHEN event_id % 4 = 0 THEN 'b' ELSE 'a' END AS vocab_sha256 FROM events WHERE event_id % 10 < 5),
    m AS (SELECT event_id AS step, value AS logged FROM events WHERE event_id % 2 = 0)
    SELECT step, logged, abs(logged - val_loss) < 1e-6 AS loss_matches, vocab_sha256 = 'a' AS vocabulary_matches FROM c LEFT JOIN m USING (step)""")
def checkpoint_checks(t: Tables):
    """Checkpoints against the log: agreeing, differing, and missing losses on either side."""
    i, v = F.col("event_id"), F.col("value")
    loss = F.when(i % 7 == 0, F.lit(None)).when(i % 3 == 0, v + 0.5).otherwise(v + 1e-9)
    checkpoints = t.events.where(i % 10 < 5).select(i.alias("step"), loss.alias("val_loss"), F.when(i % 4 == 0, "b").otherwise("a").alias("vocab_sha256"))
    metrics = t.events.where(i % 2 == 0).select(i.alias("step"), v.alias("val_loss"))
    return logs.checkpoint_checks(checkpoints, metrics, "a").select("step", "logged", "loss_matches", "vocabulary_matches")


@query("""SELECT conv_id, turn, i IN (0, 1, 6) AND trim(text, ' ' || chr(10)) <> '' AS ok, CASE WHEN i = 2 THEN 'bad JSON' WHEN i IN (3, 4, 5) OR trim(text, ' ' || chr(10)) = '' THEN 'needs non-empty string prompt and response' END AS note,
        CASE i WHEN 0 THEN '{"a":1,"b":[2,3]}' END AS answer FROM (SELECT conv_id, turn, text, (conv_id + turn) % 7 AS i FROM conversations)""")
def sft_rows(t: Tables):
    """Lines of JSON with both key styles, broken, without a response, with a response that is a number, with a system turn that is a list."""
    i = (F.col("conv_id") + F.col("turn")) % 7
    text = F.col("text")
    json = lambda **c: F.to_json(F.struct(*[v.alias(k) for k, v in c.items()]))
    answered = F.concat(F.lit('{"answer": {"b": [2, 3], "a": 1},'), F.expr("substring(to_json(struct(text AS prompt, role AS response)), 2)"))
    line = F.when(i == 0, answered).when(i == 1, json(instruction=text, output=F.col("role"))).when(i == 2, F.concat(F.lit("{broken"), text)).when(i == 3, json(prompt=text))
    line = line.when(i == 4, json(prompt=text, response=F.lit(5))).when(i == 5, json(prompt=text, response=F.col("role"), system=F.array("role"))).otherwise(json(prompt=text, response=F.col("role"), system=F.lit("")))
    rows = t.conversations.select(F.col("conv_id").cast("string").alias("file"), F.col("turn").alias("line"), line.alias("value"))
    out = sft.read_rows(rows)
    return out.select(F.col("file").cast("long").alias("conv_id"), F.col("line").alias("turn"), "ok", F.when(~F.col("ok"), F.col("note")).alias("note"), F.when(F.col("answer").isNotNull(), F.col("answer")).alias("answer"))


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS same FROM events")
def canonical_json(t: Tables):
    """JSON that says the same in another order and with spaces, that doesn't, and what is no JSON."""
    i = F.col("event_id") % 3
    value = F.when(i == 1, F.col("event_id") + 1).otherwise(F.col("event_id"))
    a = F.format_string('{"k": %d, "list": [1, {"y": null, "x": "z"}]}', "event_id")
    b = F.when(i == 2, '{"k": ').otherwise(F.format_string('{"list":[1,{"x":"z","y":null}],  "k":%d}', value))
    return t.events.select("event_id", (sft.canonical_json(a) == sft.canonical_json(b)).alias("same"))


@query("""
    WITH n AS (SELECT source, CAST(sum(n_chars) AS BIGINT) AS n FROM documents GROUP BY source), w AS (SELECT source, n, greatest(n - 64, 0) AS places FROM n),
    h AS (SELECT *, sum(places) OVER (ORDER BY source) AS high FROM w),
    d AS (SELECT r AS draw, CAST(floor(('0x' || substr(sha256('0:' || CAST(r AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 * (SELECT sum(places) FROM w)) AS BIGINT) AS pos FROM range(1000) t(r))
    SELECT draw, CAST(pos - (high - places) AS BIGINT) AS start, source FROM d JOIN h ON pos >= high - places AND pos < high""")
def random_windows(t: Tables):
    """A thousand windows of 64 over sources laid end to end."""
    sizes = t.documents.groupBy(F.col("source").alias("file")).agg(F.sum("n_chars").alias("n"))
    return sampling.random_windows(sizes, "n", 64, 1000).select("draw", "start", F.col("file").alias("source"))


@query("SELECT doc_id, epoch, sha1('0:' || epoch || ':' || doc_id) AS hash FROM documents, range(3) r(epoch)")
def epoch_shuffles(t: Tables):
    return sampling.epoch_order(t.documents.select("doc_id"), F.col("doc_id").cast("string"), 3).withColumn("epoch", F.col("epoch").cast("long"))


@query("""
    WITH p AS (SELECT source, row_number() OVER (ORDER BY sha1('0:' || source)) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source FROM documents))
    SELECT doc_id, CASE WHEN r < greatest(1, floor(n * 0.2)) THEN 'val' ELSE 'train' END AS split, CASE WHEN source IN ('src_1', 'src_2') THEN 'control' ELSE 'train' END AS route FROM documents JOIN p USING (source)""")
def topic_split(t: Tables):
    """A fifth of the sources is validation with all documents; two sources are a control."""
    rows = sampling.topic_split(t.documents.select("doc_id", "source"), "source", 0.2)
    return sampling.routed(rows, "source", ["src_1", "src_2"]).select("doc_id", "split", "route")


@query("""
    WITH k AS (SELECT CAST(greatest(1, ceil(sum(n_chars) / 50000.0)) AS BIGINT) AS k FROM documents), r AS (SELECT doc_id, n_chars, row_number() OVER (ORDER BY doc_id) - 1 AS i FROM documents),
    x AS (SELECT doc_id, coalesce(sum(n_chars) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM r, k WHERE i % k = 5 % k)
    SELECT doc_id FROM x WHERE before < 50000""")
def strided_budget(t: Tables):
    return sampling.strided_budget(t.documents.select("doc_id", "n_chars"), F.col("n_chars"), "doc_id", 50_000, 5).select("doc_id")


@query("SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'fork' WHEN page_id % 3 = 0 THEN 'licence' END AS reason FROM pages")
def repository_filter(t: Tables):
    i = F.col("page_id")
    licence = F.when(i % 6 == 0, F.lit(None)).when(i % 3 == 0, "GPL-3.0").otherwise("MIT")
    return t.pages.select("page_id", filters.repository_reason(F.when(i % 2 == 0, i % 5 == 0).otherwise(F.when(i % 5 == 0, F.lit(True))), licence, ["MIT", "Apache-2.0"]).alias("reason"))


@query("SELECT item_id, item_id % 2 = 0 AS repeated, [0, CAST(floor(length(text) / 3.0) AS BIGINT), CAST(floor(2 * length(text) / 3.0) AS BIGINT), length(text)] AS places FROM benchmark")
def choices_and_places(t: Tables):
    """Choices that are equal once trimmed; places spread evenly over a text."""
    choices = F.array(F.col("text"), F.lit("b"), F.when(F.col("item_id") % 2 == 0, " b ").otherwise("c"))
    places = F.transform(arrays.evenly_spaced(F.length("text"), 4), lambda x: x.cast("long"))
    return t.benchmark.select("item_id", filters.repeated_choices(choices).alias("repeated"), places.alias("places"))


@query("""
    WITH n AS (SELECT doc_id, length(text) AS n, trim(regexp_replace(lower(text), '[' || chr(9) || '-' || chr(13) || ' ]+', ' ', 'g')) AS k FROM documents), b AS (SELECT DISTINCT k FROM n WHERE doc_id % 3 = 1)
    SELECT count(*) AS val_docs, count(b.k) AS exact_docs, CAST(sum(n) AS BIGINT) AS val_chars, CAST(coalesce(sum(n) FILTER (b.k IS NOT NULL), 0) AS BIGINT) AS exact_chars FROM n LEFT JOIN b ON n.k = b.k WHERE doc_id % 3 = 0""")
def corpus_containment(t: Tables):
    """How much of one third of the documents is in another third, by normal forms."""
    return ngrams.containment(t.documents.where("doc_id % 3 = 0"), t.documents.where("doc_id % 3 = 1"))


@query("SELECT doc_id, md5(replace(replace(text || chr(13) || chr(10) || 'a' || chr(13) || 'b', chr(13) || chr(10), chr(10)), chr(13), chr(10))) AS h FROM documents")
def sanitized(t: Tables):
    """NUL and replacement characters go, line feeds only."""
    return t.documents.select("doc_id", F.md5(tx.without_invalid(F.concat(F.lit("\x00"), "text", F.lit("\r\na\rb\ufffd")))).alias("h"))


@query("""
    WITH r AS (SELECT id, list_transform(['a', 'b', 'c', 'x'], lambda k: ('0x' || substr(sha256('0:' || k || ':' || id), 1, 8))::UBIGINT) AS h FROM range(2000) t(id)),
    p AS (SELECT min(id) AS id, 1 + h[1] % 9 AS a, 1 + h[2] % 9 AS b, h[3] % 10 AS c, h[4] % 10 AS x FROM r GROUP BY ALL)
    SELECT id, 'What is the derivative of ' || a || 'x^2 + ' || b || 'x + ' || c || ' at x = ' || x || '?' AS prompt, CAST(2 * a * x + b AS VARCHAR) AS answer FROM p""")
def generated_polynomials(t: Tables):
    return sft.polynomials(t.spark, 2000).select("id", "prompt", "answer")


@query(r"""
    WITH r AS (SELECT id, list_transform(['a', 't'], lambda k: ('0x' || substr(sha256('0:' || k || ':' || id), 1, 8))::UBIGINT) AS h FROM range(2000) t(id)),
    p AS (SELECT min(id) AS id, CAST(1 + h[1] % 20 AS BIGINT) AS a, CAST(1 + h[2] % 60 AS BIGINT) AS t FROM r GROUP BY ALL)
    SELECT id, CASE WHEN a * t * t / 2.0 >= 10000 THEN CAST(CAST(round(a * t * t / 2.0 / 10) * 10 AS BIGINT) AS VARCHAR) ELSE regexp_replace(printf('%.1f', a * t * t / 2.0), '\.0$', '') END AS answer FROM p""")
def generated_physics(t: Tables):
    return sft.physics(t.spark, 2000).select("id", "answer")
