"""The ordinary relational surface on the star schema: joins, windows, grouping sets, set operations, functions."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.plans.registry import Tables, query

_MONEY = "l_extendedprice * (1 - l_discount)"


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS DOUBLE) AS sum_qty, round(sum({_MONEY}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""")
def pricing_summary(t: Tables):
    rows = t.lineitem.where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), F.round(F.sum(F.expr(_MONEY)), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


@query(f"""SELECT n_name, round(sum({_MONEY}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
    JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name""")
def local_supplier_revenue(t: Tables):
    j = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"))
    j = j.join(t.supplier, (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey"))).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.round(F.sum(F.expr(_MONEY)), 2).alias("revenue"))


@query("SELECT l_returnflag, l_linestatus, GROUPING(l_returnflag) AS g1, GROUPING(l_linestatus) AS g2, count(*) AS n, CAST(sum(l_quantity) AS DOUBLE) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_lineitem(t: Tables):
    return t.lineitem.cube("l_returnflag", "l_linestatus").agg(F.grouping("l_returnflag").cast("long").alias("g1"), F.grouping("l_linestatus").cast("long").alias("g2"), F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"))


@query("SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderpriority, o_orderstatus)")
def rollup_orders(t: Tables):
    return t.orders.rollup("o_orderpriority", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 2")
def topk_per_group(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return t.orders.withColumn("r", F.row_number().over(w)).where("r <= 2").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT o_orderkey, rank() OVER w AS r, dense_rank() OVER w AS d, ntile(4) OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice, o_orderkey) AS q,
    lag(o_orderkey) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS before, lead(o_orderkey, 2) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS after
    FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY CAST(o_orderdate AS DATE))""")
def window_functions(t: Tables):
    p = Window.partitionBy("o_orderstatus")
    w, by = p.orderBy(F.col("o_orderdate").cast("date")), p.orderBy("o_orderkey")
    return t.orders.select("o_orderkey", F.rank().over(w).cast("long").alias("r"), F.dense_rank().over(w).cast("long").alias("d"), F.ntile(4).over(p.orderBy("o_totalprice", "o_orderkey")).cast("long").alias("q"), F.lag("o_orderkey").over(by).alias("before"), F.lead("o_orderkey", 2).over(by).alias("after"))


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi_join(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer ANTI JOIN (SELECT o_custkey FROM orders WHERE o_totalprice > 250000) ON c_custkey = o_custkey")
def anti_join(t: Tables):
    """Customers without a large order."""
    return t.customer.join(t.orders.where("o_totalprice > 250000"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")
def left_join_counts(t: Tables):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT n_name, s_suppkey, c FROM nation FULL JOIN (SELECT s_nationkey AS k, max(s_suppkey) AS s_suppkey, count(*) AS c FROM supplier WHERE s_nationkey < 20 GROUP BY 1) ON n_nationkey = k")
def full_join(t: Tables):
    s = t.supplier.where("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("k")).agg(F.max("s_suppkey").alias("s_suppkey"), F.count(F.lit(1)).alias("c"))
    return t.nation.join(s, F.col("n_nationkey") == F.col("k"), "full").select("n_name", "s_suppkey", "c")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def cross_join_small(t: Tables):
    """Two tables of fixed size."""
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def theta_join(t: Tables):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"))


@query("""SELECT 'union' AS op, k FROM (SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) UNION ALL SELECT 'intersect', k FROM (SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier)
    UNION ALL SELECT 'except', k FROM (SELECT o_custkey AS k FROM orders WHERE o_custkey < 50 EXCEPT SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) UNION ALL SELECT 'all', k FROM (SELECT n_regionkey AS k FROM nation EXCEPT ALL SELECT r_regionkey FROM region)""")
def set_ops(t: Tables):
    c, s = t.customer.select(F.col("c_nationkey").cast("long").alias("k")), t.supplier.select(F.col("s_nationkey").cast("long").alias("k"))
    o, e = t.orders.where("o_custkey < 50").select(F.col("o_custkey").alias("k")), t.customer.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    n, r = t.nation.select(F.col("n_regionkey").cast("long").alias("k")), t.region.select(F.col("r_regionkey").cast("long").alias("k"))
    tag = lambda df, name: df.select(F.lit(name).alias("op"), "k")
    return tag(c.union(s).distinct(), "union").unionByName(tag(c.intersect(s), "intersect")).unionByName(tag(o.subtract(e), "except")).unionByName(tag(n.exceptAll(r), "all"))


@query("SELECT c_mktsegment, " + ", ".join(f"count(*) FILTER (o_orderstatus = '{x}') AS {x}" for x in "FOP") + " FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_mktsegment")
def pivot_segment_status(t: Tables):
    rows = t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey")).groupBy("c_mktsegment").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1)))
    return rows.na.fill(0)


@query("""SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS BIGINT) AS y, CAST(extract(month FROM o_orderdate) AS BIGINT) AS m, CAST(extract(quarter FROM o_orderdate) AS BIGINT) AS q, strftime(o_orderdate, '%Y-%m') AS ym,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS first, CAST(last_day(o_orderdate) AS DATE) AS last, CAST(CAST(o_orderdate AS DATE) + INTERVAL 30 DAY AS DATE) AS due, CAST(date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS days FROM orders""")
def date_functions(t: Tables):
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.year(d).cast("long").alias("y"), F.month(d).cast("long").alias("m"), F.quarter(d).cast("long").alias("q"), F.date_format(d, "yyyy-MM").alias("ym"), F.trunc(d, "month").alias("first"), F.last_day(d).alias("last"), F.date_add(d.cast("date"), 30).alias("due"), F.datediff(d.cast("date"), F.lit("1992-01-01").cast("date")).cast("long").alias("days"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS m FROM events")
def json_functions(t: Tables):
    k = F.get_json_object("props", "$.k").cast("long")
    return t.events.select("event_id", k.alias("k"), (k % 3).alias("m"))


@query("""SELECT vec_id, CAST(len(embedding) AS BIGINT) AS n, round(CAST(list_max(embedding) AS DOUBLE), 6) AS most, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 4) AS norm2,
    CAST(len(list_filter(embedding, lambda x: x > 0)) AS BIGINT) AS positive FROM embeddings""")
def array_functions(t: Tables):
    e = F.col("embedding")
    norm = F.aggregate(F.transform(e, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda acc, x: acc + x)
    return t.embeddings.select("vec_id", F.size(e).cast("long").alias("n"), F.round(F.array_max(e).cast("double"), 6).alias("most"), F.round(norm, 4).alias("norm2"), F.size(F.filter(e, lambda x: x > 0)).cast("long").alias("positive"))


@query("SELECT p_partkey, upper(p_brand) AS u, substr(p_type, 1, 5) AS s, length(p_name) AS n, replace(p_name, ' ', '_') AS r, lpad(CAST(p_size AS VARCHAR), 4, '0') AS l, contains(p_type, 'STEEL') AS steel, reverse(p_brand) AS rev FROM part")
def string_functions(t: Tables):
    return t.part.select("p_partkey", F.upper("p_brand").alias("u"), F.substring("p_type", 1, 5).alias("s"), F.length("p_name").cast("long").alias("n"), F.replace("p_name", F.lit(" "), F.lit("_")).alias("r"), F.lpad(F.col("p_size").cast("string"), 4, "0").alias("l"), F.contains("p_type", F.lit("STEEL")).alias("steel"), F.reverse("p_brand").alias("rev"))


@query("SELECT l_shipmode_proxy AS bucket, count(DISTINCT l_partkey) AS parts, CAST(quantile_cont(l_quantity, 0.5) AS DOUBLE) AS median, round(stddev_samp(l_quantity), 6) AS sd, round(corr(l_quantity, l_extendedprice), 6) AS c FROM (SELECT *, l_suppkey % 7 AS l_shipmode_proxy FROM lineitem) GROUP BY 1")
def statistics(t: Tables):
    return t.lineitem.groupBy((F.col("l_suppkey") % 7).alias("bucket")).agg(F.count_distinct("l_partkey").alias("parts"), F.percentile("l_quantity", 0.5).alias("median"), F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("c"))


@query("""WITH RECURSIVE d AS (SELECT o_custkey, o_orderkey, o_totalprice FROM orders) SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS running,
    round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving FROM d""")
def running_totals(t: Tables):
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return t.orders.select("o_custkey", "o_orderkey", F.round(F.sum("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("running"), F.round(F.avg("o_totalprice").over(w.rowsBetween(-2, 0)), 4).alias("moving"))


@query("SELECT o_orderpriority, count(*) AS n FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 45) GROUP BY 1")
def exists_subquery(t: Tables):
    late = t.lineitem.where("l_quantity > 45")
    return t.orders.join(late, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_partkey FROM part WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part)")
def scalar_subquery(t: Tables):
    return t.part.crossJoin(t.part.agg(F.avg("p_retailprice").alias("mean"))).where("p_retailprice > mean").select("p_partkey")
