"""Queries on series: events as a training log, schedules, costs, gates; windows of event time."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions import stats
from corpusmill.operators import logs
from corpusmill.plans.registry import Tables, query

_SERIES = "s AS (SELECT event_type AS run, event_id AS step, value FROM events)"


def _series(t: Tables) -> DataFrame:
    return t.events.select(F.col("event_type").alias("run"), F.col("event_id").alias("step"), "value")


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(c, digits).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


@query(f"""
    WITH RECURSIVE {_SERIES}, n AS (SELECT run, step, value, row_number() OVER (PARTITION BY run ORDER BY step) AS i FROM s WHERE step < 1500),
    e AS (SELECT run, step, value, i, value AS smooth FROM n WHERE i = 1 UNION ALL
          SELECT n.run, n.step, n.value, n.i, 0.95 * e.smooth + (1 - 0.95) * n.value FROM e JOIN n ON n.run = e.run AND n.i = e.i + 1)
    SELECT run, step, round(value, 9) AS value, round(smooth, 9) AS smooth FROM e""")
def ema_series(t: Tables):
    """The first 1,500 steps of each run: the recurrence's oracle is recursive SQL, which a longer one would take hours."""
    return _rounded(logs.smoothed(_series(t).where("step < 1500"), "value", by="run"), 9)


@query(f"""
    WITH {_SERIES}, b AS (SELECT *, min(value) OVER w AS best, min(value) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
                                 row_number() OVER w AS i FROM s WINDOW w AS (PARTITION BY run ORDER BY step)),
    c AS (SELECT *, before IS NULL OR value < before AS improved FROM b)
    SELECT run, step, value, best, improved, i - max(CASE WHEN improved THEN i END) OVER (PARTITION BY run ORDER BY step) AS patience FROM c""")
def best_so_far(t: Tables):
    return logs.best_so_far(_series(t), "value", "run")


@query(f"""
    WITH {_SERIES}, b AS (SELECT run, count(value) AS points, arg_min(value, step) AS first, arg_max(value, step) AS last, max(step) AS last_step, min(value) AS best,
                                 quantile_cont(value, 0.5) AS median, max(value) AS most, bool_and(isfinite(value)) AS all_finite FROM s GROUP BY run),
    m AS (SELECT run, min(step) FILTER (value = best) AS best_step, count(*) FILTER (value > 3 * median) AS spikes,
                 arg_max(value, step) FILTER (step <= last_step - 1000) AS e, max(step) FILTER (step <= last_step - 1000) AS es FROM s JOIN b USING (run) GROUP BY run)
    SELECT run, points, round(first, 6) AS first, round(last, 6) AS last, last_step, round(best, 6) AS best, best_step, round(median, 6) AS median, round(most, 6) AS most, all_finite, spikes,
           round((last - e) / (last_step - es) * 1000, 6) AS slope FROM b JOIN m USING (run)""")
def run_summary(t: Tables):
    """Best and last points, spikes over three medians, and the slope from an as-of point."""
    return _rounded(logs.run_summary(_series(t), "run"))


@query(f"""WITH {_SERIES}, e AS (SELECT run, max(step) AS z FROM s GROUP BY run)
    SELECT run, round(avg(value), 6) AS mean, count(*) AS n FROM s JOIN e USING (run) WHERE step > z - 250 AND step <= z GROUP BY run""")
def interval_mean(t: Tables):
    return _rounded(logs.near_end(_series(t), "run", "step", 250))


@query("""
    WITH p AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), c AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'click' GROUP BY ALL)
    SELECT p.event_id, p.user_id, c.value AS asof_value FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def asof_join_events(t: Tables):
    """Each purchase with the value of the user's last click."""
    p = t.events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    c = t.events.where("event_type = 'click'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return logs.asof_join(p, c, "user_id", "ts", "value").select("event_id", "user_id", "asof_value")


@query("""
    SELECT l.event_id AS click_id, r.event_id AS purchase_id FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'click' AND r.event_type = 'purchase'
        AND r.ts > l.ts AND r.ts <= l.ts + INTERVAL 1 HOUR""")
def range_join_events(t: Tables):
    """Purchases within an hour of a click: users are met by key, so no pair of two users is made."""
    c = t.events.where("event_type = 'click'").select("user_id", F.col("ts").alias("a"), F.col("event_id").alias("click_id"))
    p = t.events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("b"), F.col("event_id").alias("purchase_id"))
    return c.join(p, "user_id").where((F.col("b") > F.col("a")) & (F.col("b") <= F.col("a") + F.expr("INTERVAL 1 HOUR"))).select("click_id", "purchase_id")


@query("""
    WITH d AS (SELECT *, CASE WHEN ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS s FROM events),
    g AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d)
    SELECT user_id, min(ts) AS started, count(*) AS n, round(sum(value), 4) AS total FROM g GROUP BY user_id, k""")
def event_sessions(t: Tables):
    """Sessions: gaps of more than 30 minutes part them."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts")
    before = F.lag("ts").over(w)
    starts = F.when(before.isNull() | (F.col("ts") > before + F.expr("INTERVAL 30 MINUTE")), 1).otherwise(0)
    rows = t.events.withColumn("s", starts).withColumn("k", F.sum("s").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("user_id", "k").agg(F.min("ts").alias("started"), F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).drop("k")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS started, event_type, count(*) AS n FROM events GROUP BY ALL")
def tumbling_events(t: Tables):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("started"), "event_type", "n")


@query(f"""SELECT r AS step, round(CASE WHEN r < 100 THEN 0.0003 * (r + 1) / 100 WHEN r >= 2000 THEN 0.00003 ELSE 0.00003 + 0.5 * (0.0003 - 0.00003) * (1 + cos({math.pi!r} * ((r - 100) / 1900))) END, 12) AS lr FROM range(2100) t(r)""")
def lr_schedule(t: Tables):
    return t.spark.range(2100).select(F.col("id").alias("step"), F.round(stats.learning_rate(F.col("id"), 0.0003, 0.00003, 100, 2000), 12).alias("lr"))


@query("""
    SELECT p_partkey AS id, 6 * (p_size * 1000000.0) + 12 * 24.0 * 1024.0 * 2048.0 AS flops, round(p_retailprice * 100 * (6 * (p_size * 1000000.0) + 12 * 24.0 * 1024.0 * 2048.0) / 989e12, 9) AS mfu,
           round(1e9 / (p_retailprice * 100) / 3600, 6) AS hours_per_billion, CAST(greatest(least(floor(p_retailprice * 100 * 3600 * 0.9 / 65536), 5000), 50) AS BIGINT) AS steps,
           CAST(least(300, greatest(5, floor(greatest(least(floor(p_retailprice * 100 * 3600 * 0.9 / 65536), 5000), 50) / 20))) AS BIGINT) AS warmup FROM part""")
def cost_model(t: Tables):
    speed = F.col("p_retailprice") * 100
    flops = stats.flops_per_token(F.col("p_size") * 1000000.0, F.lit(24.0), F.lit(1024.0), F.lit(2048.0))
    steps = F.greatest(F.least(F.floor(speed * 3600 * 0.9 / 65536), F.lit(5000)), F.lit(50))
    warm = F.least(F.lit(300), F.greatest(F.lit(5), F.floor(steps / 20)))
    return t.part.select(F.col("p_partkey").alias("id"), flops.alias("flops"), F.round(speed * flops / 989e12, 9).alias("mfu"), F.round(1e9 / speed / 3600, 6).alias("hours_per_billion"), steps.cast("long").alias("steps"), warm.cast("long").alias("warmup"))


@query("""
    WITH r AS (SELECT p_brand AS preset, p_size AS batch, p_retailprice AS speed, CASE WHEN p_partkey % 5 > 0 THEN p_size * 2.0 END AS memory, CASE WHEN p_partkey % 7 = 0 THEN 'oom' ELSE 'ok' END AS status FROM part)
    SELECT preset, max(speed) AS speed, arg_max(batch, (speed, batch)) AS batch FROM r WHERE status = 'ok' AND (memory IS NULL OR memory <= 0.85 * 80) GROUP BY preset""")
def best_bench_row(t: Tables):
    k = F.col("p_partkey")
    rows = t.part.select(F.col("p_brand").alias("preset"), F.col("p_size").alias("batch"), F.col("p_retailprice").alias("speed"), F.when(k % 5 > 0, F.col("p_size") * 2.0).alias("memory"), F.when(k % 7 == 0, "oom").otherwise("ok").alias("status"))
    return logs.best_row(rows, "preset", 80)


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) > 3 AS prune FROM orders")
def prune_backups(t: Tables):
    return logs.newest(t.orders.select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 3)


@query("""SELECT unnest(['finite', 'ordered', 'enough', 'no_refunds']) AS "check", unnest([bool_and(isfinite(value)), max(event_id) = count(*) - 1, count(*) >= 100, count(*) FILTER (event_type = 'refund') = 0]) AS passed FROM events""")
def gate_checks(t: Tables):
    v = F.col("value")
    return logs.gate([("finite", F.bool_and(~F.isnan(v) & (F.abs(v) != float("inf")))), ("ordered", F.max("event_id") == F.count(F.lit(1)) - 1), ("enough", F.count(F.lit(1)) >= 100), ("no_refunds", F.count(F.when(F.col("event_type") == "refund", 1)) == 0)], t.events)


_TOKENS = "tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)"


@query(f"""
    WITH {_TOKENS}, c AS (SELECT w, count(*) AS c FROM tok WHERE doc_id % 5 <> 0 GROUP BY w), n AS (SELECT count(*) AS n FROM tok WHERE doc_id % 5 <> 0),
    u AS (SELECT w, count(*) AS k FROM tok WHERE doc_id % 5 = 0 GROUP BY w)
    SELECT round(sum(k * -ln((coalesce(c, 0) + 1) / CAST(n + 50000 AS DOUBLE))) / sum(k), 8) AS loss, CAST(sum(k) AS BIGINT) AS tokens FROM u LEFT JOIN c USING (w), n""")
def unigram_loss(t: Tables):
    """Trained on four fifths by id, measured on the rest: the split is the feature."""
    tok = t.documents.select("doc_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    return _rounded(logs.unigram_loss(tok.where("doc_id % 5 <> 0"), tok.where("doc_id % 5 = 0"), "w", 50_000), 8)


@query("""SELECT source, round(sum(ln(n_chars + 1) * n_chars) / sum(n_chars), 9) AS loss, round(sum(ln(n_chars + 1) * n_chars) / sum(strlen(text)) / ln(2), 9) AS bits_per_byte,
        round(exp(least(sum(ln(n_chars + 1) * n_chars) / sum(n_chars), 50)), 4) AS ppl, round(sum(strlen(text)) / sum(n_chars), 9) AS bytes_per_token FROM documents GROUP BY source""")
def bits_per_byte(t: Tables):
    n = F.col("n_chars")
    total, b = F.sum(F.ln(n + 1) * n), F.sum(F.octet_length("text"))
    loss = total / F.sum(n)
    return t.documents.groupBy("source").agg(F.round(loss, 9).alias("loss"), F.round(total / b / F.ln(F.lit(2.0)), 9).alias("bits_per_byte"), F.round(stats.perplexity(loss), 4).alias("ppl"), F.round(b / F.sum(n), 9).alias("bytes_per_token"))


@query("""
    WITH p AS (SELECT n_name AS domain, n_nationkey * 1000.0 AS planned FROM nation), m AS (SELECT n_name AS domain, sum(s_acctbal) AS held FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY 1),
    b AS (SELECT n_name AS domain, count(*) AS items FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1)
    SELECT domain, planned, round(held, 2) AS held, items, round(planned / nullif(held, 0), 6) AS passes,
           CASE WHEN held IS NULL THEN 'missing' WHEN held < planned THEN 'short' ELSE 'ok' END AS verdict FROM p LEFT JOIN m USING (domain) LEFT JOIN b USING (domain)""")
def gap_table(t: Tables):
    """Plan, holdings and benchmark side by side, with what is missing."""
    n = t.nation
    p = n.select(F.col("n_name").alias("domain"), (F.col("n_nationkey") * 1000.0).alias("planned"))
    m = t.supplier.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("domain")).agg(F.sum("s_acctbal").alias("held"))
    b = t.customer.where("c_mktsegment = 'BUILDING'").join(n, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("domain")).agg(F.count(F.lit(1)).alias("items"))
    held = F.col("held")
    verdict = F.when(held.isNull(), "missing").when(held < F.col("planned"), "short").otherwise("ok")
    return p.join(m, "domain", "left").join(b, "domain", "left").select("domain", "planned", F.round(held, 2).alias("held"), "items", F.round(F.col("planned") / F.nullif(held, F.lit(0.0)), 6).alias("passes"), verdict.alias("verdict"))


@query("""
    WITH r AS (SELECT id, list_transform(['a', 'b'], lambda k: ('0x' || substr(sha256('0:' || k || ':' || id), 1, 8))::UBIGINT) AS h FROM range(2000) t(id)),
    p AS (SELECT min(id) AS id, 100 + h[1] % 900 AS a, 100 + h[2] % 900 AS b FROM r GROUP BY ALL)
    SELECT id, 'What is ' || a || ' + ' || b || '?' AS prompt, array_to_string(string_split(CAST(a AS VARCHAR), ''), ' ') || ' + ' || array_to_string(string_split(CAST(b AS VARCHAR), ''), ' ') || ' = ' || (a + b) AS response, CAST(a + b AS VARCHAR) AS answer FROM p""")
def generated_arithmetic(t: Tables):
    """Generated additions with their answers."""
    from corpusmill.operators import sft

    return sft.arithmetic(t.spark, 2000)
