"""Registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import decontaminate, langid, linededup, mixing, pii, quality, simhash, tiffpages, tokenids, warczip
from corpusmill.scratch import spread


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_read(spark, sf_dir, "documents"))


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return tokenids.encode_and_report(_read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.report(_read(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.report(_read(spark, sf_dir, "documents"))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(_read(spark, sf_dir, "documents"))


def op8_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warczip.archive_and_read(_read(spark, sf_dir, "pages"))


def op9_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiffpages.report(_read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op2_quality": op2_quality,
    "op3_line_dedup": op3_line_dedup,
    "op4_token_ids": op4_token_ids,
    "op5_mixing": op5_mixing,
    "op6_simhash": op6_simhash,
    "op7_langid": op7_langid,
    "op8_warc_zip": op8_warc_zip,
    "op9_tiff": op9_tiff,
    "op10_pii": op10_pii,
}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op1_decontaminate": f"""
        WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
        b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
        iw AS (
            SELECT DISTINCT item_id, len(w[i:i + 12]) AS k, array_to_string(w[i:i + 12], ' ') AS g
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
        ),
        ks AS (SELECT DISTINCT k FROM iw),
        dw AS (
            SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
            FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)
        ),
        m AS (SELECT dw.doc_id, dw.i, dw.k, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.k = iw.k),
        h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
        f AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
              FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN h USING (doc_id) LEFT JOIN f USING (doc_id)""",
    "op5_mixing": r"""
        WITH d AS (SELECT doc_id, source, md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
                          CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
        s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
        w AS (SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS BIGINT) AS weight,
                     row_number() OVER (ORDER BY source NULLS LAST) AS idx FROM s),
        f AS (SELECT *, CAST(3 * source_size AS DOUBLE) / CAST(weight AS DOUBLE) AS filled_at FROM w),
        l AS (SELECT *, CAST(sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY filled_at, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
                      / CAST(sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY filled_at, idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS level FROM f),
        v AS (SELECT level FROM l WHERE level <= filled_at ORDER BY filled_at, idx LIMIT 1),
        t AS (SELECT idx, source, source_size, least(CAST(3 * source_size AS DOUBLE), (SELECT level FROM v) * CAST(weight AS DOUBLE)) AS target FROM l),
        q0 AS (SELECT *, CAST(floor(target + 0.5) AS BIGINT) AS take FROM t),
        q1 AS (SELECT *, CAST(ceil(source_size / 256) AS BIGINT) AS blocks, CASE WHEN source_size > 0 THEN take // source_size ELSE 0 END AS epochs FROM q0),
        q AS (SELECT *, epochs * blocks + CAST(ceil((take - epochs * source_size) / 256) AS BIGINT) AS quota FROM q1),
        n AS (SELECT CAST(coalesce(sum(quota), 0) AS BIGINT) AS total FROM q),
        e AS (SELECT idx, CAST(coalesce(sum(quota) OVER (ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS HUGEINT) * 2147483648 // total AS low,
                     CAST(sum(quota) OVER (ORDER BY idx) AS HUGEINT) * 2147483648 // total AS high FROM q, n WHERE total > 0),
        k AS (SELECT slot, slot % 2147483648 * 1327217885 % 2147483648 AS point FROM (SELECT unnest(range(total)) AS slot FROM n)),
        g AS (SELECT slot, idx, row_number() OVER (PARTITION BY idx ORDER BY slot) - 1 AS rank FROM k JOIN e ON point >= low AND point < high),
        served AS (SELECT idx, count(*) AS n FROM g GROUP BY idx),
        more AS (SELECT idx, unnest(range(coalesce(n, 0), quota)) AS rank FROM q LEFT JOIN served USING (idx)),
        slots AS (SELECT g.slot, g.idx, g.rank FROM g JOIN q USING (idx) WHERE g.rank < quota
                  UNION ALL SELECT total + row_number() OVER (ORDER BY idx, rank) - 1, idx, rank FROM more, n),
        p AS (SELECT doc_id, size, source_size, target, epochs, take, idx,
                     CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS b
              FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source)
        SELECT doc_id, size, source_size, target,
               CAST(epochs * size + greatest(0, least(b + size, take - epochs * source_size) - b) AS BIGINT) AS taken,
               CASE WHEN epochs * size + greatest(0, least(b + size, take - epochs * source_size) - b) > 0 THEN slot END AS first_slot
        FROM p LEFT JOIN slots ON p.idx = slots.idx AND b // 256 = slots.rank AND size > 0""",
    "op8_warc_zip": """
        WITH p AS (SELECT page_id, coalesce(url, '') AS url, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS digest FROM pages),
        k AS (SELECT digest, max(page_id) AS kept FROM p WHERE n >= 1000 GROUP BY digest HAVING count(*) > 1)
        SELECT page_id, url, CAST(n AS BIGINT) AS payload_bytes, digest AS payload_digest,
               CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN kept END AS refers_to
        FROM p LEFT JOIN k USING (digest)""",
}
