"""Streams over events and segments: windows with watermarks, rate admission, change feeds, retention, batching.

Every query here also runs to its end over bounded input (``trigger(availableNow=True)``), which is how tests and the
registry use it.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillstream.operators.segments import pack, segments
from quillstream.session import scratch_dir, table


def file_stream(spark: SparkSession, sf_dir: str, name: str, **options: int) -> DataFrame:
    """A table as a stream of its files, whether it is one file or a folder of them.

    The path is a pattern, which only the table's own name meets: a stream takes a plain path for the folder of its files.
    """
    like = table(spark, sf_dir, name)
    return spark.readStream.schema(like.schema).options(**options).parquet(f"{sf_dir}/{name}.parque[t]")


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a stream of files. ts becomes an instant, so that it can be a watermark."""
    return file_stream(spark, sf_dir, "events", maxFilesPerTrigger=1).withColumn("ts", F.col("ts").cast("timestamp"))


def drained(df: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over all input there is, into a table in the shared folder, and returns the table.

    A complete result is replaced batch by batch; other modes append. Files are the sink, so nothing passes the driver.
    """
    spark = df.sparkSession
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out").select(*df.columns)


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events a day and type; complete mode, so that the last windows are in the result."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes")
    g = e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return drained(g.select(F.col("w.start").alias("day"), "event_type", "n"), "complete")


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events without repeats of an id within the watermark, as counts a type."""
    e = event_stream(spark, sf_dir).withWatermark("ts", "10 minutes").dropDuplicatesWithinWatermark(["event_id"])
    return drained(e.select("event_id", "event_type")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running totals of a type: a complete aggregation, renewed with each batch."""
    g = event_stream(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"), F.max("value").alias("top"))
    return drained(g, "complete")


def stream_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases with the views of the same user in the hour before: a join of two streams with bounded state."""
    e = event_stream(spark, sf_dir)
    buys = e.where("event_type = 'purchase'").select(F.col("event_id").alias("buy"), F.col("user_id").alias("u"), F.col("ts").alias("bt")).withWatermark("bt", "10 minutes")
    views = event_stream(spark, sf_dir).where("event_type = 'view'").select(F.col("event_id").alias("view"), F.col("user_id").alias("v"), F.col("ts").alias("vt")).withWatermark("vt", "10 minutes")
    j = buys.join(views, F.expr("u = v AND vt <= bt AND vt > bt - INTERVAL 1 HOUR"))
    return drained(j.select("buy", "view"))


def admit(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState, limit: int, seconds: int) -> Iterator[pd.DataFrame]:
    """Sliding admission: a request starts when fewer than ``limit`` started in the ``seconds`` before; else it waits.

    The state is the start times within the window, at most ``limit`` of them.
    """
    held: list[float] = list(state.get[0]) if state.exists else []
    rows = pd.concat(list(batches)).sort_values(["at", "event_id"])
    out = []
    for at, event in zip(rows["at"], rows["event_id"], strict=True):
        start = max([at, held[-1] if held else at])
        if len(held) >= limit:
            start = max(start, held[-limit] + seconds)
        held = [*held, start][-limit:]
        out.append((key[0], event, start - at))
    state.update((held,))
    yield pd.DataFrame(out, columns=["service", "event_id", "wait"])


def stream_admission(spark: SparkSession, sf_dir: str, limit: int = 2, seconds: int = 3600) -> DataFrame:
    """How long each event of a user waits under ``limit`` requests in ``seconds``."""
    e = event_stream(spark, sf_dir).select(F.col("user_id").alias("service"), "event_id", F.col("ts").cast("double").alias("at"))

    def run(key: Any, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        return admit(key, batches, state, limit, seconds)

    g = e.groupBy("service").applyInPandasWithState(run, "service long, event_id long, wait double", "held array<double>", "append", GroupStateTimeout.NoTimeout)
    return drained(g).select("service", "event_id", F.round("wait", 3).alias("wait"))


def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """version, doc_id, seg_no: every non-blank place of a document, in the order in which its distinct texts come first."""
    s = segments(table(spark, sf_dir, "documents"))
    first = s.withColumn("first_pos", F.min("seg_no").over(Window.partitionBy("doc_id", "text")))
    w = Window.partitionBy("doc_id").orderBy("first_pos", "seg_no")
    return first.withColumn("version", F.row_number().over(w)).select("doc_id", "version", "seg_no")


def since(feed: DataFrame, version: int) -> DataFrame:
    return feed.where(F.col("version") > version)


def stream_retention(spark: SparkSession, sf_dir: str, hours: int = 12) -> DataFrame:
    """Users whose last event is older than ``hours`` before the newest of all: what a state with a time to live lets go."""
    last = event_stream(spark, sf_dir).groupBy("user_id").agg(F.max("ts").alias("last_ts"))
    done = drained(last, "complete")
    now = done.agg(F.max("last_ts").alias("now"))  # one row
    return done.join(F.broadcast(now)).where(F.col("last_ts") < F.col("now") - F.make_interval(hours=F.lit(hours))).select("user_id")


def stream_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that arrive as files, packed into batches of at most 20 texts and 3,000 characters in each micro-batch."""
    root = f"{scratch_dir(spark)}/stream-{uuid.uuid4().hex[:12]}"
    s = file_stream(spark, sf_dir, "documents")

    def write(batch: DataFrame, number: int) -> None:
        rows = segments(batch).select("doc_id", F.col("seg_no").alias("first_pos"), "text")
        pack(rows, first_items=20).select("doc_id", "batch_no", "n_items", "n_chars").write.mode("overwrite").parquet(f"{root}/out/batch={number}")

    q = s.select("doc_id", "text").writeStream.option("checkpointLocation", f"{root}/state").foreachBatch(write).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{root}/out").select("doc_id", "batch_no", "n_items", "n_chars")


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
ORACLE = {
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS day, event_type, count(*) AS n FROM events GROUP BY ALL",
    "stream_distinct": "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type",
    "stream_summary": "SELECT event_type, count(*) AS n, round(sum(value), 3) AS total, max(value) AS top FROM events GROUP BY event_type",
    "stream_join": "SELECT b.event_id AS buy, v.event_id AS view FROM events b JOIN events v ON b.user_id = v.user_id AND b.event_type = 'purchase' AND v.event_type = 'view' AND v.ts <= b.ts AND v.ts > b.ts - INTERVAL 1 HOUR",
    "change_feed": f"WITH {_SEG}, f AS (SELECT *, min(seg_no) OVER (PARTITION BY doc_id, text) AS fp FROM s) SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY fp, seg_no) AS version, seg_no FROM f",
    "stream_retention": "WITH l AS (SELECT user_id, max(ts) AS t FROM events GROUP BY user_id) SELECT user_id FROM l WHERE t < (SELECT max(t) FROM l) - INTERVAL 12 HOUR",
    "stream_batches": f"""WITH RECURSIVE {_SEG}, o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS k, length(text) AS n FROM s),
b AS (SELECT doc_id, k, 0 AS batch_no, CAST(1 AS BIGINT) AS items, CAST(n AS BIGINT) AS chars FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.k, CASE WHEN full_ THEN b.batch_no + 1 ELSE b.batch_no END, CASE WHEN full_ THEN 1 ELSE b.items + 1 END, CASE WHEN full_ THEN o.n ELSE b.chars + o.n END
 FROM b JOIN o ON o.doc_id = b.doc_id AND o.k = b.k + 1, LATERAL (SELECT b.items >= 20 OR b.chars + o.n > 3000 AS full_))
SELECT doc_id, batch_no, max(items) AS n_items, max(chars) AS n_chars FROM b GROUP BY doc_id, batch_no""",
}
QUERIES = {
    "stream_tumbling": stream_tumbling, "stream_distinct": stream_distinct, "stream_summary": stream_summary, "stream_join": stream_join, "stream_admission": stream_admission, "change_feed": change_feed, "stream_retention": stream_retention, "stream_batches": stream_batches,
}
