"""Queries on documents: text functions, filters, duplicates, splits, samples, n-grams."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.functions import arrays
from corpusmill.functions import text as tx
from corpusmill.operators import dedup, filters, ngrams, sampling
from corpusmill.plans.registry import Tables, query
from corpusmill.scratch import materialize

# The same expressions in DuckDB.
WS = tx.WHITE_SPACE
_NORM = f"trim(regexp_replace(lower(text), '[{WS}]+', ' ', 'g'))"
_WORDS = f"list_filter(string_split_regex(text, '[{WS}]+'), lambda w: w <> '')"
_PLAIN = "regexp_extract_all(lower(text), '[a-z0-9\\x{80}-\\x{10FFFF}]+')"
_STOPS = ", ".join(f"'{w}'" for w in filters.STOP_WORDS)


@query(f"""
    WITH r AS (SELECT doc_id, source, md5({_NORM}) AS k,
                      CASE WHEN {_NORM} = '' THEN 'empty' WHEN length(text) - length(replace(text, chr(65533), '')) > 2 THEN 'broken'
                           WHEN length(text) < 200 THEN 'short' ELSE 'kept' END AS l FROM documents),
    f AS (SELECT k, min(doc_id) AS first FROM r WHERE l = 'kept' GROUP BY k),
    x AS (SELECT source, CASE WHEN l <> 'kept' THEN l WHEN doc_id = first THEN 'kept' ELSE 'duplicate' END AS reason FROM r LEFT JOIN f USING (k))
    SELECT source, count(*) AS n_in, count(*) FILTER (reason = 'kept') AS n_kept, count(*) FILTER (reason = 'duplicate') AS n_duplicate,
           count(*) FILTER (reason = 'broken') AS n_broken, count(*) FILTER (reason = 'short') AS n_short
    FROM x WHERE reason <> 'empty' GROUP BY source""")
def dedup_report(t: Tables):
    return dedup.report(t.documents)


@query("SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")
def dedup_exact(t: Tables):
    return dedup.first_of(t.documents, F.md5("text"), "doc_id").select("doc_id")


@query("SELECT source, doc_id FROM (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source, text)")
def dedup_exact_per_shard(t: Tables):
    return dedup.first_of(t.documents, F.concat_ws("|", "source", F.md5("text")), "doc_id").select("source", "doc_id")


@query(f"SELECT min(doc_id) AS doc_id FROM documents GROUP BY {_NORM}")
def dedup_normalised(t: Tables):
    return dedup.first_of(t.documents, F.md5(tx.normal_form("text")), "doc_id").select("doc_id")


@query("""
    WITH p AS (SELECT event_id, event_type AS text, props FROM events)
    SELECT min(event_id) AS event_id, count(*) AS copies FROM p GROUP BY coalesce(json_extract_string(props, '$.sha256'), sha256(lower(text)))""")
def dedup_by_sha(t: Tables):
    rows = t.events.select("event_id", F.col("event_type").alias("text"), "props")
    return rows.groupBy(dedup.entity_key(F.col("text"), F.col("props")).alias("k")).agg(F.min("event_id").alias("event_id"), F.count(F.lit(1)).alias("copies")).drop("k")


@query(f"""
    WITH d AS (SELECT doc_id, source, {_NORM} AS n, left({_NORM}, 20) AS title FROM documents),
    s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY n) AS a, min(doc_id) OVER (PARTITION BY title) AS b FROM d)
    SELECT doc_id FROM s WHERE a = doc_id AND b = doc_id""", name="dedup_text_or_title")
def dedup_text_or_title(t: Tables):
    rows = t.documents.select("doc_id", F.md5(tx.normal_form("text")).alias("k1"), F.left(tx.normal_form("text"), F.lit(20)).alias("k2"))
    return dedup.first_by_any_key(rows, ["k1", "k2"], "doc_id").select("doc_id")


@query(f"""
    WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[{WS}]+'), lambda x: x <> '') AS w, md5({_NORM}) AS e FROM documents),
    g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 11], ' ') AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 10)) AS i FROM w WHERE len(w) >= 12)),
    f AS (SELECT h, min(doc_id) AS first FROM g GROUP BY h),
    s AS (SELECT doc_id, count(*) AS n, count(*) FILTER (first < doc_id) AS seen FROM g JOIN f USING (h) GROUP BY doc_id),
    x AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY e) < doc_id AS dup FROM w)
    SELECT doc_id, coalesce(n, 0) AS shingles, coalesce(seen, 0) AS seen, dup OR (coalesce(n, 0) > 0 AND seen >= 0.3 * n) AS drops FROM x LEFT JOIN s USING (doc_id)""")
def near_dup_round1(t: Tables):
    """The first round of the greedy rule, with every shingle: which documents an earlier one covers."""
    base = materialize(t.documents.select("doc_id", F.md5(tx.normal_form("text")).alias("e"), dedup.shingles(F.col("text"), 12, 1).alias("s")), "near-base")
    g = base.select("doc_id", F.explode("s").alias("h"))
    first = g.groupBy("h").agg(F.min("doc_id").alias("first"))
    seen = g.join(first, "h").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("first") < F.col("doc_id"), 1)).alias("seen"))
    exact = base.groupBy("e").agg(F.min("doc_id").alias("first"))
    rows = base.select("doc_id", "e").join(exact, "e").join(seen, "doc_id", "left")
    n, k = F.coalesce("n", F.lit(0)), F.coalesce("seen", F.lit(0))
    return rows.select("doc_id", n.alias("shingles"), k.alias("seen"), ((F.col("first") < F.col("doc_id")) | ((n > 0) & (k >= 0.3 * n))).alias("drops"))


@query()
def near_dup_greedy(t: Tables):
    """The greedy near-duplicate filter to its fixed point."""
    return dedup.near_duplicates(t.documents).select("doc_id")


@query("""
    SELECT doc_id, length(text) < 200 AS short, length(text) - length(replace(text, chr(65533), '')) > 2 AS broken, trim(text) = '' AS empty FROM documents""")
def broken_short_filters(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", filters.is_short(x, 200).alias("short"), filters.is_broken(x).alias("broken"), filters.is_empty(x).alias("empty"))


@query(f"""
    WITH w AS (SELECT doc_id, text, {_WORDS} AS w FROM documents)
    SELECT doc_id, CASE WHEN len(w) < 150 THEN 'short'
        WHEN len(regexp_extract_all(text, '\\p{{L}}')) / greatest(length(text), 1) < 0.62 THEN 'low_alpha'
        WHEN len(list_filter(w[1:4000], lambda x: lower(x) IN ({_STOPS}))) / nullif(len(w[1:4000]), 0) < 0.18 THEN 'not_english'
        WHEN len(regexp_extract_all(text, '(?i)\\b(the|and)\\b')) < 3 THEN 'off_topic' END AS reason FROM w""")
def quality_gate(t: Tables):
    return t.documents.select("doc_id", filters.quality_reason(F.col("text"), least_words=150, topic=r"\b(the|and)\b").alias("reason"))


@query("SELECT doc_id, round(len(regexp_extract_all(text, '\\p{L}')) / greatest(length(text), 1), 6) AS alpha FROM documents")
def alpha_ratio(t: Tables):
    return t.documents.select("doc_id", F.round(tx.alpha_ratio("text"), 6).alias("alpha"))


@query(f"SELECT doc_id, round(len(list_filter(({_WORDS})[1:4000], lambda x: lower(x) IN ({_STOPS}))) / nullif(len(({_WORDS})[1:4000]), 0), 6) AS share FROM documents")
def stopword_share(t: Tables):
    return t.documents.select("doc_id", F.round(tx.share_of(tx.words("text"), filters.STOP_WORDS, 4000), 6).alias("share"))


_TOPICS = [" physics-informed", " PINNs learn a neural operator", " DeepONet, neural PDE and Neural ODE", ""]


@query(f"""SELECT doc_id, len(regexp_extract_all(text || [{", ".join(f"'{x}'" for x in _TOPICS)}][1 + doc_id % 4], '(?i){filters.TOPIC_TERMS}')) AS hits,
        len(regexp_extract_all(text, '(?i)\\b(license|copyright|rights)\\b')) AS licence_hits FROM documents""")
def topic_hits(t: Tables):
    """How often a text names a topic; texts get terms behind them by id."""
    x = F.concat("text", F.element_at(F.array(*[F.lit(v) for v in _TOPICS]), (F.col("doc_id") % 4 + 1).cast("int")))
    n = lambda c, p: F.regexp_count(c, F.lit(f"(?i){p}")).cast("long")
    return t.documents.select("doc_id", n(x, filters.TOPIC_TERMS).alias("hits"), n(F.col("text"), r"\b(license|copyright|rights)\b").alias("licence_hits"))


@query(f"SELECT item_id, CASE WHEN regexp_matches(text, '(?i){filters.EARTH_TERMS}') THEN 'earth' ELSE 'other' END AS route FROM benchmark")
def earth_router(t: Tables):
    return t.benchmark.select("item_id", F.when(F.col("text").rlike(f"(?i){filters.EARTH_TERMS}"), "earth").otherwise("other").alias("route"))


@query("SELECT doc_id, lang FROM documents WHERE lang IS NULL OR lang IN ('en', 'de')")
def language_filter(t: Tables):
    return t.documents.where(F.col("lang").isNull() | F.col("lang").isin("en", "de")).select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)CC BY-NC') THEN 'nc' WHEN regexp_matches(text, '(?i)GNU|CC BY|MIT|Apache') THEN 'open' ELSE 'none' END AS licence FROM documents")
def license_filter(t: Tables):
    x = F.col("text")
    return t.documents.select("doc_id", F.when(x.rlike("(?i)CC BY-NC"), "nc").when(x.rlike("(?i)GNU|CC BY|MIT|Apache"), "open").otherwise("none").alias("licence"))


@query("""
    WITH p AS (SELECT page_id, html, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) || CASE WHEN page_id % 3 = 0 THEN '.py' WHEN page_id % 3 = 1 THEN '/.git/x.py' ELSE '.bin' END AS path FROM pages)
    SELECT page_id, CASE WHEN len(list_filter(string_split(path, '/'), lambda x: starts_with(x, '.'))) > 0 THEN 'hidden'
        WHEN lower(regexp_extract(path, '(\\.[^./]+)$', 1)) NOT IN ('.py', '.md') THEN 'extension'
        WHEN strlen(html) < 80 OR strlen(html) > 400000 THEN 'size' WHEN contains(html, chr(0)) THEN 'binary'
        WHEN list_max(list_transform(string_split(html, chr(10)), lambda x: length(x))) > 2000 THEN 'long_line' END AS reason FROM p""")
def path_filter(t: Tables):
    tail = F.when(F.col("page_id") % 3 == 0, ".py").when(F.col("page_id") % 3 == 1, "/.git/x.py").otherwise(".bin")
    rows = t.pages.withColumn("path", F.concat(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^?#]*)", 1), tail))
    return rows.select("page_id", filters.path_reason(F.col("path"), F.col("html"), [".py", ".md"]).alias("reason"))


@query(f"SELECT doc_id, md5({_NORM}) AS norm, sha256(regexp_replace(text, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) AS sha FROM documents")
def normal_forms(t: Tables):
    return t.documents.select("doc_id", F.md5(tx.normal_form("text")).alias("norm"), tx.collapsed_sha256("text").alias("sha"))


@query(r"""SELECT doc_id, trim(regexp_replace(strip_accents(regexp_replace(lower(text), '([\x{e0}-\x{e5}\x{e7}-\x{ef}\x{f1}-\x{f6}\x{f9}-\x{fd}\x{ff}])', '\1 ', 'g')), '[^a-z0-9]+', ' ', 'g')) AS title FROM documents""")
def title_norm(t: Tables):
    """A letter with a mark is decomposed; the mark, like all that is no letter or digit, becomes a space."""
    return t.documents.select("doc_id", tx.title_form("text").alias("title"))


@query(f"""
    WITH a AS (SELECT page_id, regexp_replace(replace(html, chr(65279), ''), '\\r\\n?', chr(10), 'g') AS x FROM pages),
    b AS (SELECT page_id, regexp_replace(x, '\\n{{3,}}', chr(10) || chr(10), 'g') AS x FROM a)
    SELECT page_id, md5(regexp_replace(regexp_replace(x, '^[{WS}]+', ''), '[{WS}]+$', '')) AS h FROM b""")
def clean_basic(t: Tables):
    return t.pages.select("page_id", F.md5(tx.basic_clean("html")).alias("h"))


@query("""
    WITH x AS (SELECT doc_id, text, left(text, 1000) AS h, strpos(reverse(right(left(text, 1000), 400)), ' ') AS b FROM documents)
    SELECT doc_id, md5(CASE WHEN length(text) <= 1000 THEN text WHEN b > 0 THEN rtrim(left(h, 1000 - b), ' ') ELSE rtrim(h, ' ') END) AS h, length(text) > 1000 AS cut FROM x""")
def truncate_boundary(t: Tables):
    return t.documents.select("doc_id", tx.boundary_truncate("text", 1000).alias("x")).select("doc_id", F.md5("x.text").alias("h"), "x.cut")


_HEADED = "text || repeat(chr(10) || ' Running head ' || doc_id % 5, 1 + doc_id % 4) || repeat(chr(10) || 'It ends here.', 3)"


@query(f"""
    SELECT doc_id, line, count(*) AS n FROM (SELECT doc_id, trim(unnest(string_split({_HEADED}, chr(10)))) AS line FROM documents)
    WHERE length(line) > 0 AND length(line) < 120 AND NOT ends_with(line, '.') GROUP BY ALL HAVING count(*) >= 3""")
def repeated_lines(t: Tables):
    """Texts with a running head one to four times, and a sentence three times, behind them."""
    i = F.col("doc_id")
    head = F.repeat(F.concat(F.lit("\n Running head "), i % 5), (1 + i % 4).cast("int"))
    return dedup.repeated_lines(t.documents.select("doc_id", F.concat("text", head, F.lit("\nIt ends here." * 3)).alias("text")))


@query("""
    WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    b AS (SELECT doc_id, trim(s) AS line FROM l WHERE length(trim(s)) BETWEEN 1 AND 119 AND NOT ends_with(trim(s), '.') GROUP BY ALL HAVING count(*) >= 3)
    SELECT d.doc_id, md5(coalesce(string_agg(trim(s), chr(10) ORDER BY i) FILTER (b.line IS NULL), '')) AS h
    FROM documents d JOIN l USING (doc_id) LEFT JOIN b ON l.doc_id = b.doc_id AND trim(s) = b.line GROUP BY d.doc_id""")
def repeated_lines_removed(t: Tables):
    return dedup.without_repeated_lines(t.documents.select("doc_id", "text")).select("doc_id", F.md5("text").alias("h"))


@query("SELECT item_id, list_filter(string_split_regex(text, '[.] '), lambda x: x <> '')[1] AS head, coalesce(try_cast(nullif(regexp_extract(text || ' = ' || (item_id * 7) || '.5', '([0-9.]+)$', 1), '') AS DOUBLE), 0) AS number FROM benchmark")
def last_number(t: Tables):
    x = F.concat("text", F.lit(" = "), F.col("item_id") * 7, F.lit(".5"))
    return t.benchmark.select("item_id", F.get(F.filter(F.split("text", "[.] "), lambda s: s != ""), F.lit(0)).alias("head"), F.coalesce(tx.final_number(x), F.lit(0.0)).alias("number"))


@query("""SELECT item_id, CASE item_id % 3 WHEN 0 THEN CAST(item_id * 1234 AS VARCHAR) WHEN 1 THEN '-' || item_id || '.5' ELSE replace(trim(text || ' done'), ',', '') END AS number,
        text || CASE item_id % 3 WHEN 0 THEN ' done' WHEN 1 THEN ' a b' ELSE ' done' END AS worked FROM benchmark""")
def gsm8k_number(t: Tables):
    """Solutions with a number behind the mark, with two marks of which the last counts, and without one: the text."""
    i = F.col("item_id")
    x = F.concat("text", F.when(i % 3 == 1, " a<<2*3=6>><<6>> b").otherwise("<<1+1=2>> done"))
    worked = tx.without_calculations(x)
    said = F.when(i % 3 == 0, F.concat(x, F.lit(" #### "), F.format_number(i * 1234, 0))).when(i % 3 == 1, F.concat(x, F.lit(" #### 7 #### -"), i, F.lit(".5"))).otherwise(worked)
    return t.benchmark.select("item_id", F.replace(tx.worked_number(said), F.lit(","), F.lit("")).alias("number"), worked.alias("worked"))


@query("SELECT item_id, CASE item_id % 4 WHEN 0 THEN text WHEN 1 THEN 'x = ' || item_id WHEN 2 THEN text ELSE 'see' || chr(10) || '```open' || chr(10) || text END AS code FROM benchmark")
def fence_extract(t: Tables):
    """A named block, the first of two blocks, no block, and one that is never closed."""
    i, text = F.col("item_id"), F.col("text")
    fenced = F.concat(F.lit("see\n```python\n\n"), text, F.lit("\n\n```\nend"))
    two = F.concat(F.lit("```\nx = "), i, F.lit("\n```\nthen\n```c++\ny\n```"))
    said = F.when(i % 4 == 0, fenced).when(i % 4 == 1, two).when(i % 4 == 2, text).otherwise(F.concat(F.lit("see\n```open\n"), text))
    return t.benchmark.select("item_id", tx.code_block(said).alias("code"))


@query("""SELECT item_id, item_id % 6 IN (0, 1, 3, 4) AS matches FROM benchmark""")
def answer_check(t: Tables):
    """Numbers: the last one, with digit groups, the wrong one, nearly equal; words: in another case, and absent."""
    i, n = F.col("item_id") % 6, F.col("item_id") + 1234
    number = n.cast("string")
    said = F.when(i == 0, F.concat(F.lit("We get 3. The answer is "), number, F.lit("."))).when(i == 1, F.concat(F.lit("so = "), F.format_number(n, 0)))
    said = said.when(i == 2, F.concat(F.lit("The answer is "), number, F.lit(" or rather: answer is 5"))).when(i == 3, F.concat(F.lit("= "), number, F.lit(".0000001"))).otherwise(F.concat("text", F.lit(" the Answer "), number))
    want = F.when(i < 4, number).when(i == 4, F.concat(F.lit(" THE answer "), number, F.lit(" "))).otherwise(F.concat(F.lit("no such answer "), number))
    return t.benchmark.select("item_id", tx.answer_matches(said, want).alias("matches"))


@query("SELECT doc_id, base64(encode(text)) AS b, text AS back, length(text) AS n, strlen(text) AS bytes FROM documents")
def base64_codec(t: Tables):
    b = F.replace(F.base64(F.col("text").cast("binary")), F.lit("\r\n"), F.lit(""))  # lines of 76 are broken
    return t.documents.select("doc_id", b.alias("b"), F.unbase64(b).cast("string").alias("back"), F.length("text").cast("long").alias("n"), F.octet_length("text").cast("long").alias("bytes"))


@query(r"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text || chr(9) || 'a\b', '[ -~]+|[^ -~]'), lambda x: CASE WHEN x = chr(10) THEN '\n' WHEN x = chr(13) THEN '\r' WHEN x = chr(9) THEN '\t'
        WHEN regexp_matches(x, '^[ -~]') THEN x ELSE regexp_replace(hex(encode(x)), '(..)', '\\x\1', 'g') END), '') AS p, array_to_string(string_split(CAST(doc_id AS VARCHAR), ''), ' ') AS s FROM documents""")
def printable_and_spaced(t: Tables):
    """Bytes outside 32 to 126 as escapes; a backslash stays."""
    return t.documents.select("doc_id", tx.printable(F.concat("text", F.lit("\ta\\b"))).alias("p"), tx.spaced("doc_id").alias("s"))


@query("SELECT doc_id, 'Repository: ' || source || chr(10) || 'License: ' || lang || chr(10) || 'File: ' || doc_id || '.txt' AS header, upper(left(source, 1)) || lower(substr(source, 2)) AS label, string_split(source || ' (x)', ' (')[1] AS grp FROM documents")
def headers_and_groups(t: Tables):
    header = F.format_string("Repository: %s\nLicense: %s\nFile: %s.txt", "source", "lang", F.col("doc_id").cast("string"))
    return t.documents.select("doc_id", header.alias("header"), tx.capitalized("source").alias("label"), tx.source_group(F.concat("source", F.lit(" (x)"))).alias("grp"))


@query("SELECT doc_id, CAST(('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), 1, 13))::UBIGINT % 1000000 < 50000 AS BOOLEAN) AS val FROM documents")
def hash_split2(t: Tables):
    return t.documents.select("doc_id", sampling.is_validation(F.col("doc_id").cast("string"), 0.05).alias("val"))


@query(f"""
    WITH u AS (SELECT doc_id, ('0x' || substr(sha256('7:' || {_NORM}), 1, 8))::UBIGINT / 4294967296.0 AS u FROM documents)
    SELECT doc_id, CASE WHEN u < 0.05 THEN 'test' WHEN u < 0.05 + 0.1 THEN 'val' ELSE 'train' END AS split FROM u""")
def hash_split3(t: Tables):
    return t.documents.select("doc_id", sampling.three_way(F.col("text"), "7", 0.1, 0.05).alias("split"))


@query("SELECT doc_id FROM documents ORDER BY sha1(CAST(doc_id AS VARCHAR)) LIMIT 50")
def stable_pick_topk(t: Tables):
    return sampling.stable_pick(t.documents, F.col("doc_id").cast("string"), 50).select("doc_id")


@query("SELECT lang, doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR))) <= 20")
def stable_pick_per_group(t: Tables):
    return sampling.stable_pick(t.documents, F.col("doc_id").cast("string"), 20, ["lang"]).select("lang", "doc_id")


@query("""
    SELECT doc_id, CASE WHEN count(*) OVER (PARTITION BY lang) >= 2 AND row_number() OVER (PARTITION BY lang ORDER BY sha1(CAST(doc_id AS VARCHAR)))
        <= greatest(1, round_even(count(*) OVER (PARTITION BY lang) * 0.1, 0)) THEN 'val' ELSE 'train' END AS split FROM documents""")
def document_split(t: Tables):
    return sampling.fixed_count_split(t.documents.select("doc_id", "lang"), F.col("doc_id").cast("string"), 0.1, ["lang"]).select("doc_id", "split")


@query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) WHERE n % 7 = 3")
def stride_sample(t: Tables):
    return sampling.every_kth(t.documents.select("doc_id"), ["doc_id"], 7, 3).select("doc_id")


@query("SELECT doc_id FROM documents WHERE doc_id // 10 % 8 IN (2, 6)")
def block_sample(t: Tables):
    return sampling.spread_blocks(t.documents, F.floor(F.col("doc_id") / 10) % 8, 8, 0.25).select("doc_id")


@query("""
    SELECT doc_id FROM (SELECT doc_id, coalesce(sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 20000""")
def budget_sample(t: Tables):
    return sampling.until_budget(t.documents.select("doc_id", "source", "n_chars"), F.col("n_chars"), "doc_id", 20_000, ["source"]).select("doc_id")


@query("""
    WITH x AS (SELECT source, doc_id, n_chars, sum(n_chars) OVER (PARTITION BY source ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS e,
                      row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents)
    SELECT source, doc_id, least(n_chars, 15000) AS taken FROM x WHERE e <= 3000 OR r = 1""")
def capped_mix(t: Tables):
    return sampling.capped_mix(t.documents.select("doc_id", "source", "n_chars"), F.col("n_chars"), "source", "doc_id", 3000).select("source", "doc_id", "taken")


@query("""
    WITH s AS (SELECT source AS name, CAST(sum(n_chars) AS DOUBLE) AS tokens, CAST(count(*) AS DOUBLE) AS weight FROM documents GROUP BY source)
    SELECT name, round(weight / sum(weight) OVER (), 9) AS share, round(weight / sum(weight) OVER () * 10000000 / greatest(tokens, 1), 6) AS epochs,
           weight / sum(weight) OVER () * 10000000 / greatest(tokens, 1) > 4 AS too_many FROM s""")
def mixture_weights_epochs(t: Tables):
    w = t.documents.groupBy(F.col("source").alias("name")).agg(F.sum("n_chars").cast("double").alias("tokens"), F.count(F.lit(1)).cast("double").alias("weight"))
    return sampling.epochs(w, 10_000_000).select("name", F.round("share", 9).alias("share"), F.round("epochs", 6).alias("epochs"), "too_many")


@query("""
    WITH p AS (SELECT * FROM (VALUES ('a', 0.2), ('b', 0.5), ('c', 0.3)) v(name, w)), q AS (SELECT name, sum(w) OVER (ORDER BY name) AS high, w FROM p),
    d AS (SELECT r AS draw, ('0x' || substr(sha256('0:' || CAST(r AS VARCHAR)), 1, 8))::UBIGINT / 4294967296.0 AS u FROM range(5000) t(r))
    SELECT name, count(*) AS n FROM d JOIN q ON u >= high - w AND u < high GROUP BY name""")
def mixture_draws(t: Tables):
    weights = t.spark.createDataFrame([("a", 0.2), ("b", 0.5), ("c", 0.3)], "name string, weight double")
    return sampling.weighted_draws(t.spark, weights, 5000).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


_HITS = f"""
    d AS (SELECT doc_id, {_PLAIN} AS w FROM documents), b AS (SELECT item_id, {_PLAIN} AS w FROM benchmark),
    dg AS (SELECT doc_id, i - 1 AS "at", array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13)),
    ig AS (SELECT DISTINCT item_id, array_to_string(w[i:i + 12], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 11)) AS i FROM b WHERE len(w) >= 13))"""


@query(f"WITH {_HITS} SELECT item_id, doc_id, count(DISTINCT g) AS matched FROM ig JOIN dg USING (g) GROUP BY ALL")
def ngram13_index(t: Tables):
    return ngrams.leaked_items(t.documents, t.benchmark).select("item_id", "doc_id", "matched")


_STATUS = f"""{_HITS},
    f AS (SELECT g, min(struct_pack(d := doc_id, a := "at")) AS first FROM dg SEMI JOIN ig USING (g) GROUP BY g),
    h AS (SELECT item_id, count(*) AS ngrams, count(first) AS matched, min(first) AS first FROM ig LEFT JOIN f USING (g) GROUP BY item_id),
    s AS (SELECT item_id, ngrams, matched, first.d AS first_doc, first.a AS first_at, round(matched / ngrams, 3) AS fraction,
                 CASE WHEN ngrams IS NULL THEN 'too_short' WHEN (matched / ngrams >= 0.2 AND matched >= 2) OR matched >= 10 THEN 'leaked'
                      WHEN matched > 0 THEN 'partial' ELSE 'clean' END AS status FROM benchmark LEFT JOIN h USING (item_id))"""


@query(f"WITH {_STATUS} SELECT * FROM s")
def contamination_status(t: Tables):
    return ngrams.leak_status(ngrams.item_hits(t.benchmark, t.documents))


@query(f"""
    WITH {_STATUS}, r AS (SELECT CASE WHEN item_id % 2 = 0 THEN 'even' ELSE 'odd' END AS domain, 's' || item_id % 3 AS source, status FROM s)
    SELECT domain, source, count(*) FILTER (status = 'leaked') AS leaked, count(*) FILTER (status = 'partial') AS partial,
           count(*) FILTER (status = 'clean') AS clean, count(*) FILTER (status = 'too_short') AS too_short FROM r GROUP BY ROLLUP (domain, source)""")
def contamination_rollup(t: Tables):
    from corpusmill.operators import evals

    s = ngrams.leak_status(ngrams.item_hits(t.benchmark, t.documents))
    rows = s.select(F.when(F.col("item_id") % 2 == 0, "even").otherwise("odd").alias("domain"), F.concat(F.lit("s"), F.col("item_id") % 3).alias("source"), "status")
    return evals.leak_rollup(rows)


@query(f"WITH {_STATUS} SELECT item_id FROM benchmark ANTI JOIN (SELECT item_id FROM s WHERE status = 'leaked') USING (item_id)")
def flagged_anti(t: Tables):
    flagged = ngrams.leak_status(ngrams.item_hits(t.benchmark, t.documents)).where("status = 'leaked'")
    return t.benchmark.join(flagged, "item_id", "left_anti").select("item_id")


_WINDOWS = f"""
    w AS (SELECT doc_id, {_PLAIN} AS w FROM documents),
    v AS (SELECT DISTINCT array_to_string(w[i + 1:i + 8], ' ') AS g FROM (SELECT w, unnest(range(0, len(w) - 7, 4)) AS i FROM w WHERE doc_id % 5 = 0 AND len(w) >= 8)),
    c AS (SELECT array_to_string(w[i + 1:i + 8], ' ') AS g, count(*) AS n FROM (SELECT w, unnest(range(0, len(w) - 7)) AS i FROM w WHERE doc_id % 5 <> 0 AND len(w) >= 8) GROUP BY 1)"""


@query(f"""WITH {_WINDOWS} SELECT count(*) AS windows, count(n) AS seen, count(*) FILTER (n <= 2) AS rare, count(*) FILTER (n >= 10) AS common FROM v LEFT JOIN c USING (g)""")
def window_overlap_share(t: Tables):
    """Windows of validation documents (a fifth by id, as the split) against all training windows."""
    val, train = t.documents.where("doc_id % 5 = 0"), t.documents.where("doc_id % 5 <> 0")
    return ngrams.window_overlap(val, train, ngrams.plain_words(F.col("text")), 8, 4)


@query("""
    WITH v AS (SELECT text, n_chars FROM documents WHERE doc_id % 5 = 0), t AS (SELECT DISTINCT text AS k FROM documents WHERE doc_id % 5 <> 0)
    SELECT count(*) AS val_docs, count(k) AS exact_docs, CAST(sum(n_chars) AS BIGINT) AS val_chars, CAST(coalesce(sum(n_chars) FILTER (k IS NOT NULL), 0) AS BIGINT) AS exact_chars FROM v LEFT JOIN t ON text = k""")
def doc_overlap_semi(t: Tables):
    return ngrams.document_overlap(t.documents.where("doc_id % 5 = 0"), t.documents.where("doc_id % 5 <> 0"), F.md5("text"))


@query("SELECT source, CAST(sum((length(text) - length(replace(text, 'the', ''))) / 3) AS BIGINT) AS n, CAST(sum((length(text) - length(replace(text, ' the', ''))) / 4) AS BIGINT) AS n_spaced FROM documents GROUP BY source")
def tag_count(t: Tables):
    x = F.col("text")
    return t.documents.groupBy("source").agg(F.sum(ngrams.phrase_count(x, "the")).cast("long").alias("n"), F.sum(ngrams.phrase_count(x, " the")).cast("long").alias("n_spaced"))


_G = "list_transform(range(1, greatest(len(w) - {n} + 2, 1)), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"


@query(f"""
    WITH x AS (SELECT doc_id, {_WORDS} AS w FROM documents), g AS (SELECT doc_id, len(w) AS n, {_G.format(n=2)} AS g2, {_G.format(n=4)} AS g4, {_G.format(n=3)} AS g3 FROM x)
    SELECT doc_id, round(coalesce(len(list_distinct(g2)) / nullif(len(g2), 0), 0), 6) AS distinct2, round(coalesce(1 - len(list_distinct(g4)) / nullif(len(g4), 0), 0), 6) AS repeated4,
           n >= 24 AND coalesce(len(list_distinct(g3)) / nullif(len(g3), 0), 0) < 0.5 AS loop FROM g""")
def repetition_share(t: Tables):
    x = t.documents.select("doc_id", tx.words("text").alias("w"))
    w = F.col("w")
    return x.select("doc_id", F.round(arrays.distinct_ratio(w, 2), 6).alias("distinct2"), F.round(arrays.repeated_share(w, 4), 6).alias("repeated4"), arrays.repetition_loop(w).alias("loop"))


@query(f"""
    WITH w AS (SELECT source, len({_WORDS}) AS n FROM documents)
    SELECT source, quantile_cont(n, 0.1) AS p10, quantile_cont(n, 0.5) AS p50, quantile_cont(n, 0.9) AS p90, CAST(max(n) AS BIGINT) AS most FROM w GROUP BY source""")
def length_distribution(t: Tables):
    w = t.documents.select("source", F.size(tx.words("text")).alias("n"))
    p = lambda q: F.percentile("n", F.lit(q))
    return w.groupBy("source").agg(p(0.1).alias("p10"), p(0.5).alias("p50"), p(0.9).alias("p90"), F.max("n").cast("long").alias("most"))


@query("""
    WITH g AS (SELECT left(text, 30) AS head, count(*) AS n FROM documents GROUP BY 1 ORDER BY n DESC, head LIMIT 20)
    SELECT head, n, CAST(sum(n) OVER (ORDER BY n DESC, head ROWS UNBOUNDED PRECEDING) AS BIGINT) AS running FROM g""")
def frequent_starts(t: Tables):
    top = t.documents.groupBy(F.left("text", F.lit(30)).alias("head")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "head").limit(20)
    return top.withColumn("running", F.sum("n").over(Window.orderBy(F.desc("n"), "head").rowsBetween(Window.unboundedPreceding, 0)))


@query("""
    SELECT term, count(*) FILTER (contains(text, term)) AS docs, round(avg(CAST(contains(text, term) AS INT)), 6) AS share
    FROM documents CROSS JOIN (VALUES ('License'), ('rights'), ('token = '), ('@')) v(term) GROUP BY term""")
def label_share(t: Tables):
    terms = ["License", "rights", "token = ", "@"]
    rows = t.documents.select(F.explode(F.array(*[F.struct(F.lit(x).alias("term"), F.contains(F.col("text"), F.lit(x)).cast("int").alias("has")) for x in terms])).alias("x"))
    return rows.groupBy("x.term").agg(F.sum("x.has").alias("docs"), F.round(F.avg("x.has"), 6).alias("share"))


@query("""
    SELECT source, CAST(sum(len(regexp_extract_all(text, '[\\x{200B}-\\x{200D}\\x{2060}\\x{FEFF}]'))) AS BIGINT) AS zero_width,
           CAST(sum(len(regexp_extract_all(text, '[\\x{FB00}-\\x{FB04}]'))) AS BIGINT) AS ligatures, CAST(sum(length(text) - length(replace(text, chr(65533), ''))) AS BIGINT) AS replaced,
           count(*) FILTER (contains(text, '@')) AS with_at FROM documents GROUP BY source""")
def special_characters(t: Tables):
    x = F.col("text")
    n = lambda p: F.sum(F.regexp_count(x, F.lit(p))).cast("long")
    return t.documents.groupBy("source").agg(n(r"[\x{200B}-\x{200D}\x{2060}\x{FEFF}]").alias("zero_width"), n(r"[\x{FB00}-\x{FB04}]").alias("ligatures"), F.sum(tx.replacement_count("text")).cast("long").alias("replaced"), F.count(F.when(F.contains(x, F.lit("@")), 1)).alias("with_at"))


@query("""
    SELECT CASE WHEN k >= 3 THEN 'three' WHEN k >= 1 THEN 'one' ELSE 'none' END AS terms, count(*) AS docs
    FROM (SELECT len(list_distinct(regexp_extract_all(lower(text), '\\b(?:the|and|der|die|les|des|los|las)\\b'))) AS k FROM documents) GROUP BY 1""")
def topic_term_buckets(t: Tables):
    k = F.size(F.array_distinct(tx.ascii_words("text", ["the", "and", "der", "die", "les", "des", "los", "las"])))
    return t.documents.groupBy(F.when(k >= 3, "three").when(k >= 1, "one").otherwise("none").alias("terms")).agg(F.count(F.lit(1)).alias("docs"))


@query("""
    SELECT source AS domain, count(*) AS docs, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(floor(sum(n_chars) / 3.6) AS BIGINT) AS tokens_estimate,
           count(*) FILTER (n_chars >= 1000) AS long_docs FROM documents GROUP BY source""")
def domain_totals(t: Tables):
    """Reads two columns only: sizes come from n_chars, not from the texts."""
    n = F.sum("n_chars")
    return t.documents.groupBy(F.col("source").alias("domain")).agg(F.count(F.lit(1)).alias("docs"), n.alias("chars"), F.floor(n / 3.6).alias("tokens_estimate"), F.count(F.when(F.col("n_chars") >= 1000, 1)).alias("long_docs"))


@query("""
    WITH t AS (SELECT unnest(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')) AS piece FROM documents)
    SELECT piece, count(*) AS n FROM t GROUP BY piece HAVING count(*) >= 50""")
def piece_counts(t: Tables):
    pieces = t.documents.select(F.explode(F.regexp_extract_all("text", F.lit(r"[^ \t\n\x0B\f\r]+"), F.lit(0))).alias("piece"))
    return pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("n")).where("n >= 50")
