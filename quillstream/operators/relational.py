"""Relational coverage on the star schema: joins of every kind, grouping sets, rankings, frames, sets and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators.pairs import weighted_median
from quillstream.session import table


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return li.groupBy("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(net), 2).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count(F.lit(1)).alias("n"))


def segment_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals by segment and priority with every subtotal (cube)."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.cube("c_mktsegment", "o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"), F.grouping_id().alias("gid"))


def rollup_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    g = li.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus")
    return g.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def semi_anti_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with an urgent order and none of low priority."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    urgent = o.where(F.col("o_orderpriority").startswith("1")).select(F.col("o_custkey").alias("c_custkey"))
    low = o.where(F.col("o_orderpriority").startswith("5")).select(F.col("o_custkey").alias("c_custkey"))
    return c.join(urgent, "c_custkey", "left_semi").join(low, "c_custkey", "left_anti").select("c_custkey")


def outer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and suppliers by nation, either side possibly missing."""
    c = table(spark, sf_dir, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("customers"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count(F.lit(1)).alias("suppliers"))
    return c.join(s, "nation", "full_outer").select("nation", F.coalesce("customers", F.lit(0)).alias("customers"), F.coalesce("suppliers", F.lit(0)).alias("suppliers"))


def asof_join(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, right_cols: list[str]) -> DataFrame:
    """For each left row the latest right row of its key at or before its time.

    Both sides are united and one ordered window carries the last right row forward: one shuffle, no pairs at all.
    """
    ours = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1)).withColumn("_r", F.lit(None).cast(right.select(F.struct(*right_cols).alias("r")).schema["r"].dataType))
    theirs = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*right_cols).alias("_r"))
    both = ours.unionByName(theirs, allowMissingColumns=True)
    w = Window.partitionBy(key).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1").select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in right_cols])


def asof_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the time of the user's latest view at or before it."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    views = e.where("event_type = 'view'").groupBy("user_id", F.col("ts").alias("view_ts")).agg(F.max("event_id").alias("view_id"))
    return asof_join(buys, views, "user_id", "ts", "view_ts", ["view_ts"]).select("event_id", "view_ts")


def range_join(left: DataFrame, right: DataFrame, key: list[str], left_point: str, right_point: str, within: float) -> DataFrame:
    """Pairs of a key with 0 <= right - left <= within: points fall in cells of that width, so a row meets two cells only."""
    a = left.withColumn("_cell", F.floor(F.col(left_point) / within))
    a = a.withColumn("_cell", F.explode(F.array("_cell", F.col("_cell") + 1)))
    b = right.withColumn("_cell", F.floor(F.col(right_point) / within))
    return a.join(b, [*key, "_cell"]).where((F.col(right_point) >= F.col(left_point)) & (F.col(right_point) - F.col(left_point) <= within)).drop("_cell")


def nearest_ship(spark: SparkSession, sf_dir: str, days: int = 40) -> DataFrame:
    """For each order its first shipment within ``days`` after the order date, and the gap in days."""
    day = lambda c: (F.unix_seconds(F.col(c).cast("timestamp")) / 86400).cast("double")
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), day("o_orderdate").alias("d0"))
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", day("l_shipdate").alias("d1"))
    pairs = range_join(o, li, ["k"], "d0", "d1", float(days))
    return pairs.groupBy("k").agg(F.min_by("l_linenumber", F.struct("d1", "l_linenumber")).alias("l_linenumber"), F.min(F.col("d1") - F.col("d0")).cast("long").alias("gap"), F.count(F.lit(1)).alias("n"))


def ranking_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return o.select(
        "o_orderkey", F.row_number().over(w).alias("rn"), F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderdate")).alias("dr"), F.ntile(4).over(w).alias("quartile"), F.lag("o_orderkey", 1, -1).over(w).alias("before"), F.lead("o_orderkey", 1, -1).over(w).alias("after"),
        F.round(F.sum("o_totalprice").over(w.rowsBetween(-2, 0)), 2).alias("last3"), F.round(F.max("o_totalprice").over(w.rowsBetween(Window.unboundedPreceding, 0)), 2).alias("peak"),
    )


def set_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_nationkey").alias("k"))
    s = table(spark, sf_dir, "supplier").where("s_acctbal < 3000").select(F.col("s_nationkey").alias("k"))
    parts = {"union": c.union(s).distinct(), "intersect": c.intersect(s), "except": c.subtract(s), "union_all": c.unionAll(s), "except_all": c.exceptAll(s), "intersect_all": c.intersectAll(s)}
    out = None
    for name, df in parts.items():
        row = df.groupBy("k").agg(F.count(F.lit(1)).alias("n")).withColumn("op", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def top_k_per_group(spark: SparkSession, sf_dir: str, k: int = 3) -> DataFrame:
    """The k parts of the greatest revenue of each brand."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))
    p = li.join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    w = Window.partitionBy("p_brand").orderBy(F.col("revenue").desc(), "p_partkey")
    return p.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("p_brand", "rank", "p_partkey", "revenue")


def weighted_median_price(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By brand the part size at which half the quantity is reached."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return weighted_median("p_size", "l_quantity", ["p_brand"], li, "size")


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str) -> DataFrame:
    """Unions of the intervals of a key that overlap or touch: key, start, end, n.

    An unknown end reaches nowhere, and an unknown start belongs to the last union: nulls come last, as in SQL. Both
    windows are of one sort, so equal intervals can't change places between them.
    """
    w = Window.partitionBy(*key).orderBy(F.asc_nulls_last(start), F.asc_nulls_last(end))
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (F.col(start) > reach) | reach.isNull()).withColumn("_island", F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count(F.lit(1)).alias("n")).drop("_island")


def interval_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The times in which each order's lines are on their way: from ship to receipt date, overlaps merged."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_shipdate").alias("start"), F.date_add("l_shipdate", (F.col("l_linenumber") * 5).cast("int")).cast("timestamp").alias("end"))
    return merge_intervals(li, ["l_orderkey"], "start", "end")


def interval_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = interval_union(spark, sf_dir)
    nxt = F.lead("start").over(Window.partitionBy("l_orderkey").orderBy(F.asc_nulls_last("start")))
    return u.select("l_orderkey", F.col("end").alias("gap_start"), nxt.alias("gap_end")).where("gap_end IS NOT NULL")


def pivot_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day by type, as columns, and back as rows of the largest type."""
    e = table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    kinds = ["click", "purchase", "view"]
    return e.groupBy("day").pivot("event_type", kinds).agg(F.count(F.lit(1))).select("day", *[F.coalesce(k, F.lit(0)).alias(k) for k in kinds])


_NET = "l_extendedprice * (1 - l_discount)"
_ASOF = "b AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'purchase'), v AS (SELECT DISTINCT user_id, ts AS view_ts FROM events WHERE event_type = 'view')"
_ISL = "i AS (SELECT l_orderkey, l_shipdate AS s, l_shipdate + to_days(CAST(l_linenumber * 5 AS INT)) AS e FROM lineitem), m AS (SELECT *, max(e) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM i), g AS (SELECT *, count(*) FILTER (r IS NULL OR s > r) OVER (PARTITION BY l_orderkey ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS k FROM m), u AS (SELECT l_orderkey, min(s) AS start, max(e) AS \"end\", count(*) AS n FROM g GROUP BY l_orderkey, k)"
_SETS = "c AS (SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000), s AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal < 3000)"
ORACLE = {
    "pricing_summary": f"SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum({_NET}), 2) AS revenue, round(avg(l_discount), 6) AS avg_disc, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL",
    "segment_totals": "SELECT c_mktsegment, o_orderpriority, count(*) AS n, round(sum(o_totalprice), 2) AS total, grouping_id(c_mktsegment, o_orderpriority) AS gid FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY CUBE (c_mktsegment, o_orderpriority)",
    "rollup_nations": "SELECT r_name, n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)",
    "grouping_sets": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "semi_anti_customers": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '1%') AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority LIKE '5%')",
    "outer_counts": "SELECT nation, coalesce(customers, 0) AS customers, coalesce(suppliers, 0) AS suppliers FROM (SELECT c_nationkey AS nation, count(*) AS customers FROM customer WHERE c_acctbal > 9000 GROUP BY 1) FULL JOIN (SELECT s_nationkey AS nation, count(*) AS suppliers FROM supplier WHERE s_acctbal > 5000 GROUP BY 1) USING (nation)",
    "asof_events": f"WITH {_ASOF} SELECT event_id, view_ts FROM b ASOF LEFT JOIN v ON b.user_id = v.user_id AND b.ts >= v.view_ts",
    "nearest_ship": """WITH p AS (SELECT o_orderkey AS k, l_linenumber, l_shipdate, date_diff('day', o_orderdate, l_shipdate) AS gap FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= o_orderdate AND l_shipdate - o_orderdate <= INTERVAL 40 DAY)
SELECT k, first(l_linenumber ORDER BY l_shipdate, l_linenumber) AS l_linenumber, min(gap) AS gap, count(*) AS n FROM p GROUP BY k""",
    "ranking_windows": """SELECT o_orderkey, row_number() OVER w AS rn, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate) AS dr, ntile(4) OVER w AS quartile, lag(o_orderkey, 1, -1) OVER w AS "before", lead(o_orderkey, 1, -1) OVER w AS "after",
round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS last3, round(max(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING), 2) AS peak FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
    "set_ops": f"WITH {_SETS}, x AS (SELECT 'union' AS op, k FROM (SELECT k FROM c UNION SELECT k FROM s) UNION ALL SELECT 'intersect', k FROM (SELECT k FROM c INTERSECT SELECT k FROM s) UNION ALL SELECT 'except', k FROM (SELECT k FROM c EXCEPT SELECT k FROM s) UNION ALL SELECT 'union_all', k FROM (SELECT k FROM c UNION ALL SELECT k FROM s) UNION ALL SELECT 'except_all', k FROM (SELECT k FROM c EXCEPT ALL SELECT k FROM s) UNION ALL SELECT 'intersect_all', k FROM (SELECT k FROM c INTERSECT ALL SELECT k FROM s)) SELECT op, k, count(*) AS n FROM x GROUP BY op, k",
    "top_k_per_group": f"WITH r AS (SELECT l_partkey, round(sum({_NET}), 2) AS revenue FROM lineitem GROUP BY l_partkey) SELECT p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY revenue DESC, p_partkey) AS rank, p_partkey, revenue FROM r JOIN part ON l_partkey = p_partkey QUALIFY rank <= 3",
    "weighted_median_price": "WITH s AS (SELECT p_brand, p_size, sum(l_quantity) AS w FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), r AS (SELECT *, sum(w) OVER (PARTITION BY p_brand ORDER BY p_size) AS run, sum(w) OVER (PARTITION BY p_brand) AS total FROM s) SELECT p_brand, min(p_size) AS size FROM r WHERE 2 * run >= total GROUP BY p_brand",
    "interval_union": f"WITH {_ISL} SELECT * FROM u",
    "interval_gaps": f"WITH {_ISL} SELECT * FROM (SELECT l_orderkey, \"end\" AS gap_start, lead(start) OVER (PARTITION BY l_orderkey ORDER BY start) AS gap_end FROM u) WHERE gap_end IS NOT NULL",
    "pivot_types": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'purchase') AS purchase, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1",
}
QUERIES = {
    "pricing_summary": pricing_summary, "segment_totals": segment_totals, "rollup_nations": rollup_nations, "grouping_sets": grouping_sets, "semi_anti_customers": semi_anti_customers, "outer_counts": outer_counts, "asof_events": asof_events,
    "nearest_ship": nearest_ship, "ranking_windows": ranking_windows, "set_ops": set_ops, "top_k_per_group": top_k_per_group, "weighted_median_price": weighted_median_price, "interval_union": interval_union, "interval_gaps": interval_gaps, "pivot_types": pivot_types,
}
