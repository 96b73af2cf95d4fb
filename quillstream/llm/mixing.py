"""Mixing sources to target weights.

Method: hash-random keys, a range sort within each source, distributed prefix sums of word counts and a cut at each
source's exact budget, with whole epochs repeated where a target exceeds its source. Native DataFrame code throughout.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
SEED = "mix-1"


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """source, source_size -> target: shares by weight, held at ``epochs`` times the source, the excess shared again.

    Water filling: with sources ordered by cap / weight, each k gives the level that the others get when the k first are
    full. Those levels rise up to the right k and fall after it, so the greatest is the solution. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * float(epochs))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).partitionBy(F.lit(1))
    rank = Window.partitionBy(F.lit(1)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.floor(F.sum("source_size").over(everything) * F.lit(share)).cast("double"))
    s = s.withColumn("full", F.coalesce(F.sum("cap").over(rank), F.lit(0.0))).withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(rank), F.lit(0.0)))
    s = s.withColumn("level", (F.col("budget") - F.col("full")) / F.col("open"))
    level = F.max("level").over(everything)
    return s.withColumn("target", F.coalesce(F.least(F.col("cap"), level * F.col("weight")), F.col("cap"))).select("source", "source_size", "target")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id", weights: tuple = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS, seed: str = SEED, bucket_bits: int = 12) -> DataFrame:
    """Adds size, source_size, target and taken (words that the mix takes, repeats counted) to docs.

    Each source is sorted by a key hashed from the id and the text, so that rows of one id or of none spread too; ``taken`` is the whole epochs times the size, plus what the last,
    partial epoch takes: documents in key order until the source's budget is met, the one at the border cut to fit. So
    the words taken of a source are its target rounded down to a whole word, exactly.

    The prefix sums are distributed: sums by (source, leading key bits) first, a window over at most 2**bucket_bits sums
    of a source, and a window within each small bucket. A hot source is thus spread over 2**bucket_bits groups.

    A null text has size 0; a null source is a source of its own, last in order; rows repeated whole or by id are
    ordered by id, size and text hash, so a rerun agrees; an empty table gives no rows; columns that clash with the
    added names are replaced.
    """
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(common.WORD)), F.lit(0)).cast("long")
    added = ("size", "source_size", "target", "taken")
    d = docs.drop(*[c for c in added if c in docs.columns]).withColumn("size", size)
    d = d.withColumn("_key", F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text), F.lit("")))))).withColumn("_src", F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("")))
    d = d.withColumn("_bucket", F.conv(F.substring("_key", 1, 4), 16, 10).cast("int").bitwiseAND(F.lit(0xFFFF)))
    d = d.withColumn("_bucket", F.shiftright("_bucket", 16 - bucket_bits))
    slim = d.select("_src", F.col(source).alias("source"), "_bucket", "size")
    sums = slim.groupBy("_src", "_bucket").agg(F.first("source").alias("source"), F.sum("size").alias("_sum"))
    by_source = targets(sums.groupBy("_src").agg(F.first("source").alias("source"), F.sum("_sum").alias("source_size")).drop("_src"), weights, share, epochs)
    by_source = by_source.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("")).alias("_src"), "source_size", "target")
    before = F.coalesce(F.sum("_sum").over(Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.withColumn("_before", before).select("_src", "_bucket", "_before").join(by_source, "_src")
    inner = Window.partitionBy("_src", "_bucket").orderBy("_key", doc_id, "size", F.xxhash64(text)).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_at", F.coalesce(F.sum("size").over(inner), F.lit(0))).join(offsets, ["_src", "_bucket"])
    whole = F.when(F.col("source_size") > 0, F.floor(F.floor("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.floor("target").cast("long") - whole * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_at") - F.col("_before")))
    d = d.withColumn("taken", (whole * F.col("size") + part).cast("long"))
    return d.drop("_key", "_src", "_bucket", "_at", "_before")


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = r"""
WITH d AS (SELECT doc_id, text, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5('mix-1|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || md5(coalesce(text, ''))) AS key FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS weight,
             2.0::DOUBLE * source_size AS cap FROM s),
v AS (SELECT *, floor(sum(source_size) OVER () * 1.5::DOUBLE) AS budget,
             coalesce(sum(cap) OVER o, 0.0::DOUBLE) AS full_, sum(weight) OVER () - coalesce(sum(weight) OVER o, 0.0::DOUBLE) AS open_
      FROM w WINDOW o AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT max((budget - full_) / open_) AS level FROM v),
t AS (SELECT source, source_size, coalesce(least(cap, level * weight), cap) AS target FROM v, l),
p AS (SELECT d.doc_id, d.size, t.source_size, t.target,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sofar,
             CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS whole
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(whole * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - whole * source_size - sofar)) AS BIGINT) AS taken FROM p
"""
