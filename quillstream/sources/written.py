"""Sources as queries: the documents' lines written in a file format and read back by its parser, or kept as record files."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.segments import segments
from quillstream.session import scratch_dir, table
from quillstream.sources import documents, records


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, seg_no, t: lines of letters and single spaces, so that no format takes a sign for its own."""
    s = segments(table(spark, sf_dir, "documents"))
    t = F.trim(F.regexp_replace("text", "[^A-Za-z]+", " "))
    return s.select("doc_id", "seg_no", t.alias("t")).where("t <> ''")


def texts(rows: DataFrame, line: Column, head: str = "") -> DataFrame:
    """doc_id, text: the lines of a document one under the other."""
    parts = F.array_sort(F.collect_list(F.struct("seg_no", line.alias("x"))))
    return rows.groupBy("doc_id").agg(F.concat(F.lit(head), F.array_join(F.transform(parts, lambda p: p["x"]), "\n")).alias("text"))


def cues_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as subtitles, a cue each, every seventh followed by a second line, written again and read once more."""
    clock = lambda n: F.concat(F.lit("00:"), F.lpad(F.floor(n / 60 % 60).cast("string"), 2, "0"), F.lit(":"), F.lpad((n % 60).cast("string"), 2, "0"), F.lit(",000"))
    n = F.col("seg_no")
    cue = F.concat_ws("\n", n.cast("string"), F.concat(clock(n), F.lit(" --> "), clock(n + 1)), "t", F.when(n % 7 == 0, F.lit("and more")), F.lit(""))
    first = documents.cues(texts(lines(spark, sf_dir), cue), "doc_id")
    again = documents.cues(documents.written_cues(first, "doc_id"), "doc_id")
    return again.groupBy("doc_id").agg(F.count(F.lit(1)).alias("cues"), F.sum(F.length("text")).alias("chars"), F.max("timing").alias("last"))


def dialogue_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as dialogue of a script file; every fifth one is a drawing, which is no text."""
    head = "[Script Info]\nTitle: x\n\n[Events]\nFormat: Layer, Start, End, Style, Text\n"
    body = F.concat(F.lit("Dialogue: 0,0:00:01.00,0:00:02.00,Default,"), F.when(F.col("seg_no") % 5 == 0, F.lit("{\\p1}m 0 0 l 9 9")).otherwise(F.concat(F.lit("{\\i1}"), "t")))
    d = documents.dialogue(texts(lines(spark, sf_dir), body, head), "doc_id")
    return d.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("text")).alias("chars"))


def markdown_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as Markdown blocks of six kinds by turns; blocks and characters of each kind that the parser finds."""
    k = F.col("seg_no") % 6
    block = F.when(k == 0, F.concat(F.lit("## "), "t", F.lit("\n"))).when(k == 1, F.concat(F.lit("- "), "t", F.lit("\n"))).when(k == 2, F.concat(F.lit("> "), "t", F.lit("\n")))
    block = block.when(k == 3, F.concat(F.lit("```\n"), "t", F.lit("\n```\n"))).when(k == 4, F.concat("t", F.lit("\n---\n"))).otherwise(F.concat("t", F.lit("\n")))
    b = documents.markdown_table(texts(lines(spark, sf_dir), block), "doc_id")
    return b.groupBy("doc_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def markdown_prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents themselves as Markdown of one paragraph each: what is prose of it, and where it begins."""
    b = documents.markdown_segments(documents.markdown_table(texts(lines(spark, sf_dir), F.col("t")), "doc_id"))
    return b.groupBy("doc_id").agg(F.count(F.lit(1)).alias("blocks"), F.sha1(F.max("text").cast("binary")).alias("sha"), F.min("line").alias("first"))


def decoded_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as bytes of several encodings, told apart again: UTF-8 with and without a mark, UTF-16 with one."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL")
    utf8 = F.encode("text", "UTF-8")
    content = F.when(F.col("doc_id") % 3 == 0, utf8).when(F.col("doc_id") % 3 == 1, F.concat(F.unhex(F.lit("EFBBBF")), utf8)).otherwise(F.encode("text", "UTF-16"))
    t = documents.with_text(d.select(F.col("doc_id").cast("string").alias("path"), content.alias("content")))
    return t.select(F.col("path").cast("long").alias("doc_id"), F.sha1(F.col("text").cast("binary")).alias("sha"))


def glossary_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as glossary files, read as pairs; every fourth line has no sign between its halves and is none."""
    pair = F.when(F.col("seg_no") % 4 == 3, F.col("t")).otherwise(F.concat("t", F.lit(" = "), F.upper("t")))
    g = records.glossary_lines(texts(lines(spark, sf_dir), pair), "text", "doc_id")
    return g.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("source") + F.length("target")).alias("chars"))


def request_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests written as JSON lines beside damaged ones and read back: the damaged are dropped, unknown keys ignored."""
    e = table(spark, sf_dir, "events")
    path = f"{scratch_dir(spark)}/requests-{uuid.uuid4().hex[:12]}"
    row = F.to_json(F.struct(F.col("value").alias("duration"), F.lit(200).alias("status"), F.concat(F.lit("m"), F.col("user_id") % 3).alias("model"), F.lit(1).alias("unknown")))
    e.select(F.when(F.col("event_id") % 10 == 0, F.lit('{"duration": ')).otherwise(row).alias("value")).write.text(path)
    back = records.request_log(spark, path)
    return back.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sum("status").alias("status"))


_LINES = """s AS (SELECT doc_id, i - 1 AS seg_no, trim(regexp_replace(l[i], '[^A-Za-z]+', ' ', 'g'), ' ') AS t FROM
 (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)
 WHERE trim(regexp_replace(l[i], '[^A-Za-z]+', ' ', 'g'), ' ') <> '')"""
_CLOCK = "'00:' || lpad(CAST(({0} // 60) % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST({0} % 60 AS VARCHAR), 2, '0') || ',000'"
ORACLE = {
    "cues_back": f"""WITH {_LINES} SELECT doc_id, count(*) AS cues, CAST(sum(length(t) + CASE WHEN seg_no % 7 = 0 THEN 9 ELSE 0 END) AS BIGINT) AS chars,
max({_CLOCK.format('seg_no')} || ' --> ' || {_CLOCK.format('(seg_no + 1)')}) AS last FROM s GROUP BY doc_id""",
    "dialogue_back": f"""WITH {_LINES} SELECT doc_id, count(*) AS lines, CAST(sum(length(t)) AS BIGINT) AS chars FROM s WHERE seg_no % 5 <> 0 GROUP BY doc_id""",
    "markdown_kinds": f"""WITH {_LINES} SELECT doc_id, CASE seg_no % 6 WHEN 0 THEN 'h2' WHEN 1 THEN 'li' WHEN 2 THEN 'quote' WHEN 3 THEN 'code' WHEN 4 THEN 'h2'
ELSE 'p' END AS kind, count(*) AS n, CAST(sum(length(t) + CASE WHEN seg_no % 6 = 3 THEN 8 ELSE 0 END) AS BIGINT) AS chars FROM s GROUP BY 1, 2""",
    "markdown_prose": f"""WITH {_LINES} SELECT doc_id, count(DISTINCT doc_id) AS blocks, sha1(string_agg(t, chr(10) ORDER BY seg_no)) AS sha, 0 AS first
FROM s GROUP BY doc_id""",
    "decoded_texts": "SELECT doc_id, sha1(text) AS sha FROM documents WHERE text IS NOT NULL",
    "glossary_files": f"""WITH {_LINES} SELECT doc_id, count(*) AS n, CAST(sum(2 * length(t)) AS BIGINT) AS chars FROM s WHERE seg_no % 4 <> 3 GROUP BY doc_id""",
    "request_files": """SELECT 'm' || (user_id % 3) AS model, count(*) AS n, CAST(200 * count(*) AS BIGINT) AS status FROM events WHERE event_id % 10 <> 0
GROUP BY 1""",
}
QUERIES = {f.__name__: f for f in (cues_back, dialogue_back, markdown_kinds, markdown_prose, decoded_texts, glossary_files, request_files)}
