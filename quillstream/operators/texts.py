"""Queries that run the text functions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.segments import section_carry, segments
from quillstream.session import small, table


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    sha = lambda c: F.sha1(c.cast("binary"))
    return table(spark, sf_dir, "documents").select(
        "doc_id", sha(X.squeeze(t)).alias("squeezed"), sha(X.joined_lines(t)).alias("joined"), sha(X.without_code(t)).alias("no_code"), sha(X.half_width(t)).alias("narrow"), X.cut_point(F.substring(t, 1, 200)).alias("cut"), X.masked_secret(F.substring(t, 1, 20)).alias("masked"),
        X.deadline(F.length(t)).alias("deadline"), F.size(X.numbers(t)).alias("numbers"), F.size(X.scripts_in(t)).alias("scripts"),
    )


def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    p = X.config_prefix(F.col("source"), F.lit("mock"), F.col("lang"), F.lit("en"), F.lit("m1"), [F.lit("sys"), F.lit("user")], F.when(F.col("doc_id") % 2 == 0, F.lit("a = b")).otherwise(F.lit("")))
    return d.select("doc_id", p.alias("prefix"), X.cache_key(p, F.col("text")).alias("k"))


def lang_script_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", X.count_of(t, X.LETTER).alias("letters"), X.count_of(t, r"\p{IsHan}").alias("han"), X.count_of(t, r"[\p{IsHiragana}\p{IsKatakana}]").alias("kana"), X.count_of(t, r"\p{IsHangul}").alias("hangul"), X.script_language(t).alias("by_script"))


def profiles(docs: DataFrame, most: int = 300) -> DataFrame:
    """lang, gram, weight: the commonest letter triples of each language, as log shares. A few hundred rows a language."""
    g = triples(docs, "lang").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    total = g.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))).withColumn("all_", F.sum("n").over(Window.partitionBy("lang")))
    return total.where(F.col("rank") <= most).select("lang", "gram", (F.log(F.col("n") / F.col("all_")) + 12).alias("weight"))


def triples(docs: DataFrame, key: str) -> DataFrame:
    """key, gram, n: letter triples of lower-cased words with their ends marked, counted by row first."""
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    padded = docs.select(key, F.explode(words).alias("w")).groupBy(key, "w").agg(F.count(F.lit(1)).alias("n")).withColumn("w", F.concat(F.lit("_"), "w", F.lit("_")))
    grams = F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))
    return padded.where(F.length("w") >= 3).select(key, F.explode(grams).alias("gram"), "n")


def lang_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language by script, else by the profile with the greatest mean weight of the text's letter triples.

    Profiles are learnt from the documents of even id; a text with less than 20 letters (Han counted three times) stays
    undecided. The profiles are a bounded table: 300 rows a language.
    """
    d = table(spark, sf_dir, "documents")
    p = profiles(d.where("doc_id % 2 = 0 AND lang IS NOT NULL").select("lang", "text"))
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"\p{L}+"), F.lit(0))
    w = d.select("doc_id", F.explode(words).alias("w")).withColumn("w", F.concat(F.lit("_"), "w", F.lit("_")))
    g = w.select("doc_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("w") - 2), lambda i: F.substring("w", i, F.lit(3)))).alias("gram"))
    s = g.join(small(p), "gram").groupBy("doc_id", "lang").agg(F.sum("weight").alias("score"))  # scored where the text is
    best = s.groupBy("doc_id").agg(F.max_by("lang", F.struct("score", "lang")).alias("by_profile"))
    t = F.col("text")
    enough = X.count_of(t, X.LETTER) + 2 * X.count_of(t, r"\p{IsHan}") >= 20
    out = d.join(best, "doc_id", "left").select("doc_id", F.coalesce(X.script_language(t), F.when(enough, F.col("by_profile"))).alias("detected"))
    return out


def lang_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang").join(lang_detect(spark, sf_dir), "doc_id")
    return d.groupBy("lang", "detected", X.same_language(F.col("lang"), F.col("detected")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations packed into one message by the multi-item protocol and read back: every text at its index."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("l"))
    c = c.withColumn("texts", F.transform("l", lambda x: F.trim(F.regexp_replace(x["text"], r"[\n\r]+", " "))))
    c = c.withColumn("marker", X.free_marker(F.col("texts"))).withColumn("message", X.request_text(F.col("texts"), F.col("marker")))
    c = c.withColumn("back", X.reply_items(F.concat(F.col("message"), F.lit("\n[[p0]]\nlate"))))
    return c.select("conv_id", F.size("texts").alias("n"), "marker", F.length("message").alias("chars"), F.when(F.size("texts") > 1, F.size("back")).otherwise(F.size("texts")).alias("read"), F.sha1(F.when(F.size("texts") > 1, F.element_at("back", 0)).otherwise(F.element_at("texts", 1)).cast("binary")).alias("first_sha"))


def sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of sections: headings are lines of at most 30 characters, their level 1 to 3; a level whose heading has an
    even length opens a skipped section, up to the next heading of its level or above."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("head", F.length("text") <= 30)
    level = F.when(F.col("head"), F.length("text") % 3 + 1)
    return section_carry(s, "doc_id", "seg_no", level, F.col("head") & (F.length("text") % 2 == 0)).groupBy("doc_id").agg(F.count_if("skip").alias("skipped"), F.count_if("head").alias("heads"))


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_SCRIPTS = " + ".join(f"CAST(regexp_matches(text, '\\p{{{s}}}') AS INT)" for s in X.SCRIPTS)
ORACLE = {
    "text_cleaning": f"""WITH h AS (SELECT *, substring(text, 1, 200) AS t2, length(regexp_extract(substring(text, 1, 200), '(?s)^(.*[.!?。！？])', 1)) AS a, length(regexp_extract(substring(text, 1, 200), '(?s)^(.*)\\s', 1)) AS b, substring(text, 1, 20) AS k FROM documents)
SELECT doc_id, sha1(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS squeezed, sha1(regexp_replace(array_to_string(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(x, '[ \\t\\r\\f]+', ' ', 'g'), ' ')), chr(10)), '^\\n+|\\n+$', '', 'g')) AS joined,
sha1(regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://[^\\s]+', ' ', 'g')) AS no_code, sha1(translate(text, '{X.WIDE}', '{X.NARROW}')) AS narrow,
CASE WHEN a > length(t2) / 2 THEN a WHEN b > length(t2) / 2 THEN b ELSE length(t2) END AS cut, CASE WHEN length(k) <= 8 THEN repeat('*', length(k)) ELSE substring(k, 1, 3) || '***' || right(k, 4) END AS masked,
least(300.0::DOUBLE, greatest(90.0::DOUBLE, 60 + length(text) / 25)) AS deadline, len(list_distinct(regexp_extract_all(text, '[0-9]{{3,}}'))) AS numbers, {_SCRIPTS} AS scripts FROM h""",
    "cache_keys": "WITH p AS (SELECT doc_id, text, source || ':mock:m1:' || substring(sha1('sys' || chr(0) || 'user'), 1, 8) || ':' || lang || ':en' || CASE WHEN doc_id % 2 = 0 THEN ':g' || substring(sha1('a = b'), 1, 8) ELSE '' END AS prefix FROM documents) SELECT doc_id, prefix, sha1(prefix || chr(10) || text) AS k FROM p",
    "lang_script_share": """WITH c AS (SELECT doc_id, len(regexp_extract_all(text, '\\p{L}')) AS letters, len(regexp_extract_all(text, '\\p{Han}')) AS han, len(regexp_extract_all(text, '[\\p{Hiragana}\\p{Katakana}]')) AS kana, len(regexp_extract_all(text, '\\p{Hangul}')) AS hangul FROM documents)
SELECT *, CASE WHEN letters + 2 * han < 20 THEN NULL WHEN kana + han >= 0.5 * letters THEN CASE WHEN kana > 0 THEN 'ja' WHEN han >= 0.6 * letters THEN 'zh' END WHEN hangul >= 0.5 * letters THEN 'ko' END AS by_script FROM c""",
    "replies": """WITH c AS (SELECT conv_id, list(trim(regexp_replace(text, '[\\n\\r]+', ' ', 'g'), ' ') ORDER BY turn, text) AS texts FROM conversations GROUP BY conv_id)
SELECT conv_id, len(texts) AS n, 'p' AS marker, CASE WHEN len(texts) = 1 THEN length(texts[1]) ELSE length(array_to_string(list_transform(range(1, len(texts) + 1), lambda i: '[[p' || (i - 1) || ']]' || chr(10) || texts[i]), chr(10))) END AS chars, len(texts) AS read, sha1(texts[1]) AS first_sha FROM c""",
    "sections": f"""WITH {_SEG}, h AS (SELECT *, length(text) <= 30 AS head, CASE WHEN length(text) <= 30 THEN length(text) % 3 + 1 END AS lv, length(text) <= 30 AND length(text) % 2 = 0 AS op FROM s),
f AS (SELECT h.*, {" OR ".join(f"coalesce(max(CASE WHEN op AND lv = {k} THEN seg_no END) OVER w > coalesce(max(CASE WHEN NOT op AND lv <= {k} THEN seg_no END) OVER w, -1), false)" for k in (1, 2, 3))} AS skip FROM h WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no))
SELECT doc_id, count(*) FILTER (skip) AS skipped, count(*) FILTER (head) AS heads FROM f GROUP BY doc_id""",
}
QUERIES = {"text_cleaning": text_cleaning, "cache_keys": cache_keys, "lang_script_share": lang_script_share, "lang_detect": lang_detect, "lang_confusion": lang_confusion, "replies": replies, "sections": sections}
