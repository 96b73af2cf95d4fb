"""Record files: request logs, job records, glossaries, manifests; and the sinks that write them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST = T.StructType([T.StructField(n, t) for n, t in (
    ("started", T.DoubleType()), ("gate_wait", T.DoubleType()), ("duration", T.DoubleType()), ("attempt", T.IntegerType()), ("status", T.IntegerType()), ("error", T.StringType()), ("reason", T.StringType()),
    ("items", T.IntegerType()), ("chars", T.IntegerType()), ("model", T.StringType()), ("stop", T.StringType()), ("input_tokens", T.LongType()), ("output_tokens", T.LongType()),
)])
JOB = T.StructType([T.StructField(n, t) for n, t in (("id", T.StringType()), ("filename", T.StringType()), ("status", T.StringType()), ("created", T.DoubleType()), ("finished", T.DoubleType()), ("document", T.StringType()), ("size", T.LongType()))])


def request_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines; damaged lines are dropped, unknown keys ignored."""
    return spark.read.schema(REQUEST).option("mode", "DROPMALFORMED").json(path)


def append_requests(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def job_records(spark: SparkSession, path: str) -> DataFrame:
    """One JSON file a job; broken ones are dropped, and jobs that ran or queued when the process ended are interrupted."""
    j = spark.read.schema(JOB).option("multiLine", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path).where("id IS NOT NULL")
    return j.withColumn("status", F.when(F.col("status").isin("queued", "running"), "interrupted").otherwise(F.col("status")))


def write_jobs(df: DataFrame, path: str) -> None:
    """Replaces the partitions of the jobs written, and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("id").json(path)


def glossary_lines(texts: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """key, ord, source, target of 'source = target' lines; a spaced equals sign goes before a bare one."""
    l = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "^﻿|\r", ""), "\n")).alias("ord", "line"))
    cut = F.when(F.contains("line", F.lit(" = ")), F.split("line", " = ", 2)).when(F.contains("line", F.lit("=")), F.split("line", "=", 2))
    l = l.withColumn("p", cut).where("p IS NOT NULL").select(key, "ord", F.trim(F.get("p", F.lit(0))).alias("source"), F.trim(F.get("p", F.lit(1))).alias("target"))
    return l.where("source <> '' AND target <> ''")


def glossary_table(texts: DataFrame, text: str = "text", key: str = "path") -> DataFrame:
    """key, ord, source, target of a table file: tabs anywhere make it TSV, an equals sign on every line pairs, else CSV.

    A byte order mark and a header line (source and target by name) are dropped; both columns must be filled.
    """
    l = texts.select(key, F.posexplode(F.split(F.regexp_replace(text, "^﻿|\r", ""), "\n")).alias("ord", "line")).where("trim(line) <> ''")
    by = Window.partitionBy(key)
    l = l.withColumn("tabs", F.max(F.contains("line", F.lit("\t"))).over(by)).withColumn("pairs", F.min(F.contains("line", F.lit("="))).over(by))
    csv = F.from_csv("line", F.lit("source STRING, target STRING"), {"sep": ",", "quote": '"', "escape": '"'})
    tsv = F.split("line", "\t")
    pair = F.when(F.contains("line", F.lit(" = ")), F.split("line", " = ", 2)).otherwise(F.split("line", "=", 2))
    pick = lambda i, name: F.when(F.col("tabs"), F.get(tsv, F.lit(i))).when(F.col("pairs"), F.get(pair, F.lit(i))).otherwise(csv[name])
    out = l.select(key, "ord", F.trim(pick(0, "source")).alias("source"), F.trim(pick(1, "target")).alias("target"))
    header = (F.col("ord") == 0) & F.lower("source").isin("source", "term") & F.lower("target").isin("target", "translation")
    return out.where(~F.coalesce(header, F.lit(False)) & (F.col("source") != "") & (F.col("target") != ""))


def write_glossary_csv(df: DataFrame, path: str) -> None:
    df.select("source", "target").write.mode("overwrite").option("header", "true").csv(path)


def glossary_text(entries: DataFrame, ids: DataFrame) -> DataFrame:
    """One text of the entries of the glossaries asked for, in the order asked; ids that are gone are left out.

    ids: place, id. entries: id, ord, source, target.
    """
    e = ids.join(entries, "id").withColumn("line", F.concat_ws(" = ", "source", "target"))
    parts = F.array_sort(F.collect_list(F.struct("place", "ord", "line")))
    return e.agg(F.array_join(F.transform(parts, lambda x: x["line"]), "\n").alias("text"))


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """name, url, sha256 of a tab-separated list."""
    return spark.read.schema("name STRING, url STRING, sha256 STRING").option("sep", "\t").option("comment", "#").csv(path)


def checked(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files of a manifest with whether their content is what it says; missing ones too."""
    f = files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.sha2("content", 256).alias("found"))
    return listed.join(f, "name", "left").select("name", (F.col("found") == F.col("sha256")).alias("ok"))


def swap_in(df: DataFrame, path: str) -> None:
    """Writes a new version beside the old one and points to it last, so a reader never sees half of it.

    The pointer is a small file, replaced whole; old versions stay until ``vacuum``.
    """
    version = f"v{df.sparkSession.range(1).select(F.unix_micros(F.current_timestamp())).first()[0]}"
    df.write.parquet(f"{path}/{version}")
    df.sparkSession.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").text(f"{path}/current")


def swapped(spark: SparkSession, path: str) -> DataFrame:
    version = spark.read.text(f"{path}/current").first()[0]
    return spark.read.parquet(f"{path}/{version}")
