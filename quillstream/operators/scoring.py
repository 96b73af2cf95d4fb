"""Scores of segmentations and differences of plans: shingle look-up, multiset joins, sequence differences, overlays."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.segments import segments
from quillstream.session import small, table


def words_of(col: str) -> Column:
    return F.filter(F.split(F.lower(col), r"[\x20\x09-\x0D]+"), lambda w: F.length(w) >= 2)


def shingles(df: DataFrame, key: str, col: str, n: int = 4) -> DataFrame:
    """key, pos, shingle of n words of two characters and more."""
    d = df.select(key, words_of(col).alias("w")).where(F.size("w") >= n)
    rows = d.select(key, F.posexplode(X.windows_of(F.col("w"), n)).alias("pos", "z")).where(F.col("z")[f"w{n - 1}"].isNotNull())
    return rows.select(key, "pos", F.concat_ws(" ", *[F.col("z")[f"w{k}"] for k in range(n)]).alias("shingle"))


def shingle_locate(spark: SparkSession, sf_dir: str, reach: int = 12) -> DataFrame:
    """Where each benchmark item starts and ends among the documents, by shingles that occur once in all of them.

    The shingle of an item nearest to its start (end), at most ``reach`` words from it, decides. A shingle in two places
    says nothing. The index is an aggregation with a partial step and a semi-join on the items' shingles comes first, so
    only shingles that an item asks for are shuffled.
    """
    items = shingles(table(spark, sf_dir, "benchmark"), "item_id", "text")
    last = items.groupBy("item_id").agg(F.max("pos").alias("last"))
    docs = shingles(table(spark, sf_dir, "documents"), "doc_id", "text").join(small(items.select("shingle").distinct()), "shingle", "left_semi")
    once = docs.groupBy("shingle").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")).where("n = 1")
    hit = items.join(once, "shingle").join(last, "item_id").where((F.col("pos") < reach) | (F.col("last") - F.col("pos") < reach))
    start, end = F.when(F.col("pos") < reach, F.struct("pos", "doc_id")), F.when(F.col("last") - F.col("pos") < reach, F.struct(-F.col("pos"), "doc_id"))
    g = hit.groupBy("item_id").agg(F.min(start)["doc_id"].alias("start_doc"), F.min(end)["doc_id"].alias("end_doc"))
    return table(spark, sf_dir, "benchmark").select("item_id").join(g, "item_id", "left").select("item_id", F.coalesce("start_doc", F.lit(-1)).alias("start_doc"), F.coalesce("end_doc", F.lit(-1)).alias("end_doc"))


def segmentation_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found, split over two documents, or merged with the next item; and the boundaries looked at."""
    s = shingle_locate(spark, sf_dir)
    s = s.withColumn("next_start", F.lead("start_doc").over(Window.partitionBy(F.floor(F.col("item_id") / 10)).orderBy("item_id")))
    return s.agg(
        F.count_if(F.expr("start_doc >= 0")).alias("found"), F.count_if(F.expr("start_doc >= 0 AND end_doc >= 0 AND start_doc <> end_doc")).alias("split"), F.count_if(F.expr("end_doc >= 0 AND next_start = end_doc")).alias("merged"), F.count_if(F.expr("end_doc >= 0 AND next_start >= 0")).alias("boundaries"),
    )


def skip_flag_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Multisets of flags: labelled quality against a rule (few letters), where their counts by document differ."""
    lab = table(spark, sf_dir, "labels").groupBy("doc_id", (F.col("quality") == 0).alias("skip")).agg(F.count(F.lit(1)).alias("a"))
    rule = table(spark, sf_dir, "documents").select("doc_id", (X.count_of(F.col("text"), X.LETTER) < 0.75 * F.length("text")).alias("skip"))
    rule = rule.groupBy("doc_id", "skip").agg(F.count(F.lit(1)).alias("b"))
    both = lab.join(rule, ["doc_id", "skip"], "full_outer").select("doc_id", "skip", F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))
    return both.where("a <> b")


def sequence_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, op, n) of an ordered comparison: rows kept, deleted and inserted. Groups are documents, bounded by their length."""

    def run(_, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        x, y = (list(p.sort_values("seg_no")["text"]) for p in (a, b))
        k = (a if len(a) else b)[key].iloc[0]
        n = {"equal": 0, "delete": 0, "insert": 0}
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
            if tag == "equal":
                n["equal"] += i2 - i1
            else:
                n["delete"] += i2 - i1
                n["insert"] += j2 - j1
        return pd.DataFrame({key: [k] * 3, "op": list(n), "n": list(n.values())})

    return old.groupBy(key).cogroup(new.groupBy(key)).applyInPandas(run, f"{key} long, op string, n long")


def plan_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents against the same without page labels and with each 9th line doubled."""
    s = segments(table(spark, sf_dir, "documents"))
    twice = F.explode(F.when(F.col("seg_no") % 9 == 4, F.sequence(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    new = s.where("seg_no % 13 <> 7").withColumn("_copy", twice).withColumn("seg_no", F.col("seg_no") * 10 + F.col("_copy")).drop("_copy")
    return sequence_diff(s, new, "doc_id")


def plan_multiset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order-insensitive part of the same comparison, as sets with counts."""
    s = segments(table(spark, sf_dir, "documents")).select("doc_id", "text")
    new = segments(table(spark, sf_dir, "documents")).where("seg_no % 13 <> 7").select("doc_id", "text")
    gone = s.exceptAll(new).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("old"))
    return gone.unionByName(new.exceptAll(s).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).withColumn("side", F.lit("new")))


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_LOC = """bw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: length(x) >= 2) AS w FROM benchmark), dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+'), lambda x: length(x) >= 2) AS w FROM documents),
bs AS (SELECT item_id, i - 1 AS pos, array_to_string(w[i:i + 3], ' ') AS sh, len(w) - 4 AS last FROM bw, unnest(range(1, len(w) - 2)) AS r(i)), ds AS (SELECT doc_id, array_to_string(w[i:i + 3], ' ') AS sh FROM dw, unnest(range(1, len(w) - 2)) AS r(i)),
o AS (SELECT sh, min(doc_id) AS doc_id FROM ds GROUP BY sh HAVING count(*) = 1), h AS (SELECT item_id, pos, last, doc_id FROM bs JOIN o USING (sh)),
loc AS (SELECT item_id, coalesce((SELECT first(doc_id ORDER BY pos) FROM h WHERE h.item_id = bw.item_id AND pos < 12), -1) AS start_doc, coalesce((SELECT first(doc_id ORDER BY pos DESC) FROM h WHERE h.item_id = bw.item_id AND last - pos < 12), -1) AS end_doc FROM bw)"""
ORACLE = {
    "shingle_locate": f"WITH {_LOC} SELECT * FROM loc",
    "segmentation_score": f"WITH {_LOC}, n AS (SELECT *, lead(start_doc) OVER (PARTITION BY item_id // 10 ORDER BY item_id) AS ns FROM loc) SELECT count(*) FILTER (start_doc >= 0) AS found, count(*) FILTER (start_doc >= 0 AND end_doc >= 0 AND start_doc <> end_doc) AS split, count(*) FILTER (end_doc >= 0 AND ns = end_doc) AS merged, count(*) FILTER (end_doc >= 0 AND ns >= 0) AS boundaries FROM n",
    "skip_flag_diff": "WITH l AS (SELECT doc_id, quality = 0 AS skip, count(*) AS a FROM labels GROUP BY ALL), r AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) < 0.75 * length(text) AS skip, count(*) AS b FROM documents GROUP BY ALL) SELECT doc_id, skip, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM l FULL JOIN r USING (doc_id, skip) WHERE coalesce(a, 0) <> coalesce(b, 0)",
    "plan_multiset_diff": f"WITH {_SEG}, o AS (SELECT doc_id, text FROM s), n AS (SELECT doc_id, text FROM s WHERE seg_no % 13 <> 7) SELECT 'old' AS side, doc_id, count(*) AS n FROM (SELECT * FROM o EXCEPT ALL SELECT * FROM n) GROUP BY doc_id UNION ALL SELECT 'new', doc_id, count(*) FROM (SELECT * FROM n EXCEPT ALL SELECT * FROM o) GROUP BY doc_id",
}
QUERIES = {"shingle_locate": shingle_locate, "segmentation_score": segmentation_score, "skip_flag_diff": skip_flag_diff, "plan_diff": plan_diff, "plan_multiset_diff": plan_multiset_diff}
