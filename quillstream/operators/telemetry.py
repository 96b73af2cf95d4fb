"""Request telemetry on the events table: summaries, nearest-rank percentiles, sliding rate audits, usage, jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.session import table


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events read as a request log: value is the duration, the number in props the items, user_id the service."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("started"), F.col("user_id").alias("service"), F.col("event_type").alias("reason"), F.col("value").alias("duration"), k.alias("items"), (F.pmod("event_id", F.lit(7)) == 0).cast("int").alias("retry"), (F.pmod("event_id", F.lit(11)) == 0).alias("failed"))


def nearest_rank(col: str | Column, share: float) -> Column:
    """The element at ceil(share * n), without interpolation."""
    return F.expr(f"percentile_disc({share}) WITHIN GROUP (ORDER BY {col})")


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = requests(spark, sf_dir)
    return r.groupBy("reason").agg(
        F.count(F.lit(1)).alias("n"), F.sum("retry").alias("retries"), F.count_if("failed").alias("failed"), F.round(F.avg("duration"), 3).alias("mean"), F.round(nearest_rank("duration", 0.9), 3).alias("p90"), F.sum("items").alias("items"),
    )


def rate_audit(spark: SparkSession, sf_dir: str, limit: int = 2) -> DataFrame:
    """Requests of a service in the hour that ends with each one, the hour half-open: exactly 3600 s ago is outside.

    The frame is on microseconds, so the open end is exact.
    """
    w = Window.partitionBy("service").orderBy("us").rangeBetween(-(3600 * 1_000_000 - 1), 0)
    r = requests(spark, sf_dir).withColumn("us", F.unix_micros("started"))
    return r.select("event_id", "service", F.count(F.lit(1)).over(w).alias("in_window")).withColumn("over", F.col("in_window") > limit)


#: How providers report usage: where each count stands, and what is added up. Shapes are fixed by the providers.
_PATHS = {
    "fresh": {"input": ["$.usage.input", "$.usage.cache_read", "$.usage.cache_write"], "output": ["$.usage.output"], "cached": ["$.usage.cache_read"], "written": ["$.usage.cache_write"], "reasoning": []},
    "thinking": {"input": ["$.usage.prompt"], "output": ["$.usage.candidates", "$.usage.thoughts"], "cached": ["$.usage.cached"], "written": [], "reasoning": ["$.usage.thoughts"]},
    "plain": {"input": ["$.usage.prompt_tokens"], "output": ["$.usage.completion_tokens"], "cached": ["$.usage.prompt_details.cached"], "written": [], "reasoning": ["$.usage.completion_details.reasoning"]},
}


def usage(provider: Column, body: Column) -> dict[str, Column]:
    """input, output, cached, written and reasoning tokens of a provider's reply; null is not reported, 0 is reported."""
    out = {}
    for name in ("input", "output", "cached", "written", "reasoning"):
        choice = F.lit(None).cast("long")
        for kind, paths in _PATHS.items():
            values = [X.tolerant_count(F.get_json_object(body, p)) for p in paths[name]]
            total = F.lit(None).cast("long")
            if values:
                some = F.coalesce(*values)
                total = F.when(some.isNotNull(), sum((F.coalesce(v, F.lit(0)) for v in values), F.lit(0)))
            choice = F.when(provider == kind, total).otherwise(choice)
        out[name] = choice.cast("long")
    return out


def usage_by_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies made of the events in three shapes, reduced to one."""
    r = requests(spark, sf_dir).withColumn("provider", F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.pmod("event_id", F.lit(3)) + 1).cast("int")))
    k = F.coalesce(F.col("items"), F.lit(0)).cast("string")
    j = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    body = F.when(F.col("provider") == "fresh", j('{"usage":{"input":', k, ',"cache_read":"', k, '","cache_write":2,"output":', k, "}}"))
    body = body.when(F.col("provider") == "thinking", j('{"usage":{"prompt":', k, ',"candidates":', k, ',"thoughts":3.9}}'))
    body = body.otherwise(j('{"usage":{"prompt_tokens":', k, ',"completion_tokens":-1}}'))
    r = r.withColumn("body", body)
    u = usage(F.col("provider"), F.col("body"))
    return r.select("provider", *[c.alias(n) for n, c in u.items()]).groupBy("provider").agg(*[F.sum(n).alias(n) for n in u], F.bool_or(F.coalesce("input", "output").isNotNull()).alias("reported"))


def status_retention(spark: SparkSession, sf_dir: str, days: int = 30) -> DataFrame:
    """Orders read as jobs: finished ones (status not O) older than ``days`` before the last finish; 0 days keeps all."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
    last = o.agg(F.max("o_orderdate").alias("now"))
    return o.join(F.broadcast(last)).where((F.col("o_orderstatus") != "O") & (F.lit(days) > 0) & (F.col("now") - F.make_interval(days=F.lit(days)) > F.col("o_orderdate"))).select("o_orderkey")


def jobs_admission(spark: SparkSession, sf_dir: str, most: int = 3) -> DataFrame:
    """For each priority: open orders queue by date; as many are admitted as running ones (status P) leave room."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority")
    running = o.groupBy("o_orderpriority").agg(F.least(F.count_if(F.col("o_orderstatus") == "P"), F.lit(most - 1)).alias("running"))
    w = Window.partitionBy("o_orderpriority").orderBy("o_orderdate", "o_orderkey")
    q = o.where("o_orderstatus = 'O'").withColumn("queue_position", F.row_number().over(w)).join(running, "o_orderpriority")
    return q.select("o_orderkey", "queue_position", (F.col("queue_position") <= most - F.col("running")).alias("admitted"))


def page_window(spark: SparkSession, sf_dir: str, page: int = 3, size: int = 25) -> DataFrame:
    """A page of the newest orders."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return o.orderBy(F.col("o_orderdate").desc(), "o_orderkey").offset((page - 1) * size).limit(size)


def fail_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A service fails when all of its requests failed, or more than max(3, a tenth)."""
    r = requests(spark, sf_dir).groupBy("service").agg(F.count(F.lit(1)).alias("total"), F.count_if("failed").alias("bad"))
    return r.withColumn("fails", (F.col("bad") == F.col("total")) | (F.col("bad") > F.greatest(F.lit(3), F.floor(F.col("total") / 10))))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a service with gaps of at most a day: first, last and number of requests."""
    e = requests(spark, sf_dir)
    g = e.groupBy("service", F.session_window("started", "1 day")).agg(F.min("started").alias("first_ts"), F.max("started").alias("last_ts"), F.count(F.lit(1)).alias("n"))
    return g.select("service", "first_ts", "last_ts", "n")


def debounced(spark: SparkSession, sf_dir: str, settle: int = 3600, most: int = 10) -> DataFrame:
    """Changes of a key that then stayed unchanged for ``settle`` seconds; at most ``most`` replacements a key."""
    e = requests(spark, sf_dir)
    w = Window.partitionBy("service").orderBy("started", "event_id")
    quiet = e.withColumn("next_", F.lead("started").over(w)).where(F.col("next_").isNull() | (F.unix_micros("next_") - F.unix_micros("started") >= settle * 1_000_000))
    return quiet.withColumn("change", F.row_number().over(w)).where(F.col("change") <= most).select("service", "event_id", "change")


def windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tumbling windows of a day by type."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return g.select(F.col("w.start").alias("day"), "event_type", "n", "v")


def sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of six hours every three by type."""
    e = table(spark, sf_dir, "events")
    g = e.groupBy(F.window("ts", "6 hours", "3 hours").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n")


_R = "r AS (SELECT event_id, ts AS started, user_id AS service, event_type AS reason, value AS duration, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS items, CASE WHEN event_id % 7 = 0 THEN 1 ELSE 0 END AS retry, event_id % 11 = 0 AS failed FROM events)"
ORACLE = {
    "latency_summary": f"WITH {_R} SELECT reason, count(*) AS n, CAST(sum(retry) AS BIGINT) AS retries, count(*) FILTER (failed) AS failed, round(avg(duration), 3) AS mean, round(quantile_disc(duration, 0.9), 3) AS p90, CAST(sum(items) AS BIGINT) AS items FROM r GROUP BY reason",
    "rate_audit": f"WITH {_R} SELECT event_id, service, count(*) OVER (PARTITION BY service ORDER BY epoch_us(started) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY service ORDER BY epoch_us(started) RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW) > 2 AS over FROM r",
    "usage_by_provider": f"""WITH {_R}, u AS (SELECT event_id % 3 AS p, coalesce(items, 0) AS k FROM r) SELECT ['fresh', 'thinking', 'plain'][1 + CAST(p AS INT)] AS provider, CAST(sum(CASE p WHEN 0 THEN k + k + 2 ELSE k END) AS BIGINT) AS input, CAST(sum(CASE p WHEN 0 THEN k WHEN 1 THEN k + 3 END) AS BIGINT) AS output,
CAST(sum(CASE p WHEN 0 THEN k END) AS BIGINT) AS cached, CAST(sum(CASE p WHEN 0 THEN 2 END) AS BIGINT) AS written, CAST(sum(CASE p WHEN 1 THEN 3 END) AS BIGINT) AS reasoning, true AS reported FROM u GROUP BY p""",
    "status_retention": "SELECT o_orderkey FROM orders, (SELECT max(o_orderdate) AS now_ FROM orders) WHERE o_orderstatus <> 'O' AND now_ - INTERVAL 30 DAY > o_orderdate",
    "jobs_admission": """WITH q AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderdate, o_orderkey) AS queue_position FROM orders WHERE o_orderstatus = 'O'),
r AS (SELECT o_orderpriority, least(count(*) FILTER (o_orderstatus = 'P'), 2) AS running FROM orders GROUP BY o_orderpriority) SELECT o_orderkey, queue_position, queue_position <= 3 - running AS admitted FROM q JOIN r USING (o_orderpriority)""",
    "page_window": "SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50",
    "fail_rule": f"WITH {_R} SELECT service, count(*) AS total, count(*) FILTER (failed) AS bad, count(*) FILTER (failed) = count(*) OR count(*) FILTER (failed) > greatest(3, count(*) // 10) AS fails FROM r GROUP BY service",
    "sessions": f"""WITH {_R}, g AS (SELECT *, CASE WHEN started < lag(started) OVER (PARTITION BY service ORDER BY started) + INTERVAL 1 DAY THEN 0 ELSE 1 END AS new FROM r), i AS (SELECT *, sum(new) OVER (PARTITION BY service ORDER BY started) AS no FROM g)
SELECT service, min(started) AS first_ts, max(started) AS last_ts, count(*) AS n FROM i GROUP BY service, no""",
    "debounced": f"WITH {_R}, n AS (SELECT *, lead(started) OVER (PARTITION BY service ORDER BY started, event_id) AS nx FROM r), c AS (SELECT service, event_id, row_number() OVER (PARTITION BY service ORDER BY started, event_id) AS change FROM n WHERE nx IS NULL OR epoch_us(nx) - epoch_us(started) >= 3600000000) SELECT * FROM c WHERE change <= 10",
    "windows": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n, round(sum(value), 4) AS v FROM events GROUP BY ALL",
    "sliding": "SELECT s AS start, event_type, count(*) AS n FROM (SELECT event_type, unnest([time_bucket(INTERVAL 3 HOUR, ts), time_bucket(INTERVAL 3 HOUR, ts) - INTERVAL 3 HOUR]) AS s FROM events) GROUP BY ALL",
}
QUERIES = {
    "latency_summary": latency_summary, "rate_audit": rate_audit, "usage_by_provider": usage_by_provider, "status_retention": status_retention, "jobs_admission": jobs_admission, "page_window": page_window,
    "fail_rule": fail_rule, "sessions": sessions, "debounced": debounced, "windows": windows, "sliding": sliding,
}
