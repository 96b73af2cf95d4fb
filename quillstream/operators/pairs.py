"""Checks of source and target pairs, and echoes, on conversations and on deterministic stand-in translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.segments import segments
from quillstream.session import table


def upper_median(df: DataFrame, value: str, keys: list[str], least: int = 3, name: str = "median") -> DataFrame:
    """keys, name: the upper of the two middle values of each group (the element at n div 2, from 0, of the sorted ones);
    groups of fewer than ``least`` values are left out.

    Counts by value and a running sum: equal values travel as one row, and no group is gathered.
    """
    n = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    run = F.sum("_n").over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    n = n.withColumn("_run", run).withColumn("_all", F.sum("_n").over(group))
    return n.where((2 * F.col("_run") > F.col("_all")) & (F.col("_all") >= least)).groupBy(*keys).agg(F.min(value).alias(name))


def upper_median_of_all(df: DataFrame, value: str, least: int = 3, name: str = "median") -> DataFrame:
    """The same over all rows, as one row, without bringing them together.

    Two approximate quantiles just below and above the middle (their error is a share of the rows that is known) bound the
    element; those below are counted, and only the sliver between the bounds is put in order.
    """
    accuracy = 10_000
    v = df.where(F.col(value).isNotNull()).select(F.col(value).alias("_v"))
    ends = F.percentile_approx("_v", [0.5 - 2 / accuracy, 0.5 + 2 / accuracy], accuracy)
    about = v.agg(F.count(F.lit(1)).alias("_all"), ends.alias("_ends"))  # one row
    d = v.join(F.broadcast(about))
    below = d.agg(F.count_if(F.col("_v") < F.col("_ends")[0]).alias("_below"))  # one row
    near = d.where((F.col("_v") >= F.col("_ends")[0]) & (F.col("_v") <= F.col("_ends")[1])).groupBy("_v", "_all").agg(F.count(F.lit(1)).alias("_n"))
    run = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    near = near.join(F.broadcast(below)).withColumn("_run", F.col("_below") + run)
    return near.agg(F.min(F.when((2 * F.col("_run") > F.col("_all")) & (F.col("_all") >= least), F.col("_v"))).alias(name))


def weighted_median(value: str, weight: str, keys: list[str], df: DataFrame, name: str = "median") -> DataFrame:
    """The first value with twice its running weight at least the total."""
    sums = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    run = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("_run", F.sum("_w").over(run)).withColumn("_all", F.sum("_w").over(Window.partitionBy(*keys)))
    return sums.where("2 * _run >= _all").groupBy(*keys).agg(F.min(value).alias(name))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, src, dst: a user's turn and the assistant's that follows."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = c.withColumn("next_role", F.lead("role").over(w)).withColumn("dst", F.lead("text").over(w))
    return c.where("role = 'user' AND next_role = 'assistant'").select("conv_id", "turn", F.col("text").alias("src"), "dst")


def pair_length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose length is out of place against the upper median ratio of all pairs."""
    t = turns(spark, sf_dir).withColumn("ratio", X.length_ratio(F.col("src"), F.col("dst")))
    typical = upper_median_of_all(t, "ratio", name="typical")  # one row
    t = t.join(F.broadcast(typical)).withColumn("misplaced", X.out_of_place(F.col("src"), F.col("dst"), F.col("typical")))
    return t.select("conv_id", "turn", F.round("ratio", 6).alias("ratio"), "misplaced")


def pair_number_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and their stand-in translations that have long numbers on both sides and none in common."""
    s = segments(table(spark, sf_dir, "documents"))
    dst = F.when(F.col("seg_no") % 2 == 0, F.col("text")).otherwise(F.translate("text", "0123456789", "1234567890"))
    return s.withColumn("dst", dst).where(X.numbers_differ(F.col("text"), F.col("dst"))).select("doc_id", "seg_no")


def echo_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that a stand-in translator gave back as they were, or began as they were, with their documents."""
    s = segments(table(spark, sf_dir, "documents"))
    dst = F.when(F.col("seg_no") % 3 == 0, F.col("text")).when(F.col("seg_no") % 3 == 1, F.concat(F.substring("text", 1, 50), F.lit(" ..."))).otherwise(F.upper("text"))
    return s.withColumn("dst", dst).where(X.echoes(F.col("text"), F.col("dst"))).select("doc_id", "seg_no")


def slot_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines given slots and marks by rule: what a faulty target loses, adds or doubles."""
    s = segments(table(spark, sf_dir, "documents"))
    s = s.withColumn("src", F.concat(F.lit("{v0} "), "text", F.lit(" {v1} [[b]]x[[/b]]")))
    s = s.withColumn("dst", F.when(F.col("seg_no") % 3 == 0, F.col("src")).when(F.col("seg_no") % 3 == 1, F.replace("src", F.lit("{v1}"), F.lit("{v7}[[zz]]"))).otherwise(F.concat("src", F.lit(" {v0}"))))
    src, dst = F.col("src"), F.col("dst")
    return s.select("doc_id", "seg_no", X.keeps_slots_once(src, dst).alias("kept"), F.size(F.array_except(X.slots(dst), X.slots(src))).alias("alien"), F.sha1(X.without_invented_marks(src, dst).cast("binary")).alias("tidy_sha"), F.sha1(X.without_marks(dst).cast("binary")).alias("plain_sha"))


def fake_translation(col: Column) -> Column:
    """A deterministic stand-in for a translator."""
    return F.concat(F.lit("[t] "), col)


def back_to_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of unique texts mapped back to every place; skipped places and texts without a result keep the source."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("skip", F.col("seg_no") % 5 == 2)
    need = s.where(~F.col("skip") & X.has_letters(F.col("text"))).select("text").distinct()
    done = need.where("length(text) % 7 <> 0").withColumn("result", fake_translation(F.col("text")))
    out = s.join(done, "text", "left").withColumn("result", F.when(F.col("skip"), F.col("text")).otherwise(F.coalesce("result", "text")))
    return out.groupBy("doc_id").agg(F.count_if("skip").alias("skipped"), F.count_if(F.col("result") != F.col("text")).alias("translated"), F.sum(F.length("result")).alias("chars"))


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_TURNS = "c AS (SELECT conv_id, turn, role, text AS src, lead(role) OVER w AS nr, lead(text) OVER w AS dst FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), t AS (SELECT conv_id, turn, src, dst, length(src) AS ls, length(dst) AS ld FROM c WHERE role = 'user' AND nr = 'assistant')"
ORACLE = {
    "pair_length_outliers": f"""WITH {_TURNS}, r AS (SELECT *, CASE WHEN ls >= 60 THEN ld / ls END AS ratio FROM t), m AS (SELECT list_sort(list(ratio) FILTER (ratio IS NOT NULL))[count(ratio) // 2 + 1] AS typical FROM r)
SELECT conv_id, turn, round(ratio, 6) AS ratio, (ls >= 60 AND (ld / ls < typical * 0.45 OR ld / ls > typical * 4.0)) OR (ls < 60 AND ld > 60 * typical * 4.0) AS misplaced FROM r, m""",
    "pair_number_mismatch": f"WITH {_SEG}, p AS (SELECT *, CASE WHEN seg_no % 2 = 0 THEN text ELSE translate(text, '0123456789', '1234567890') END AS dst FROM s), n AS (SELECT *, regexp_extract_all(text, '[0-9]{{3,}}') AS a, regexp_extract_all(dst, '[0-9]{{3,}}') AS b FROM p) SELECT doc_id, seg_no FROM n WHERE len(a) > 0 AND len(b) > 0 AND NOT list_has_any(a, b)",
    "echo_pairs": f"WITH {_SEG} SELECT doc_id, seg_no FROM s WHERE (seg_no % 3 IN (0, 1) OR starts_with(upper(text), substring(text, 1, 40))) AND len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) >= 12 AND length(text) >= 80",
    "slot_checks": f"""WITH {_SEG}, p AS (SELECT doc_id, seg_no, seg_no % 3 AS m, '{{v0}} ' || text || ' {{v1}} [[b]]x[[/b]]' AS src, ' ' || text || '  ' AS body FROM s),
q AS (SELECT *, CASE m WHEN 0 THEN src WHEN 1 THEN replace(src, '{{v1}}', '{{v7}}') ELSE src || ' {{v0}}' END AS tidy FROM p)
SELECT doc_id, seg_no, m = 0 AS kept, CASE WHEN m = 1 THEN 1 ELSE 0 END AS alien, sha1(tidy) AS tidy_sha, sha1(body || 'x' || CASE WHEN m = 2 THEN ' ' ELSE '' END) AS plain_sha FROM q""",
    "back_to_places": f"""WITH {_SEG}, u AS (SELECT DISTINCT text FROM s WHERE seg_no % 5 <> 2 AND regexp_matches(text, '\\p{{L}}') AND length(text) % 7 <> 0), o AS (SELECT doc_id, seg_no % 5 = 2 AS skip, s.text, CASE WHEN seg_no % 5 <> 2 AND u.text IS NOT NULL THEN '[t] ' || s.text ELSE s.text END AS result FROM s LEFT JOIN u USING (text))
SELECT doc_id, count(*) FILTER (skip) AS skipped, count(*) FILTER (result <> text) AS translated, CAST(sum(length(result)) AS BIGINT) AS chars FROM o GROUP BY doc_id""",
}
QUERIES = {"pair_length_outliers": pair_length_outliers, "pair_number_mismatch": pair_number_mismatch, "echo_pairs": echo_pairs, "slot_checks": slot_checks, "back_to_places": back_to_places}
