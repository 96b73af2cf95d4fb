"""Segments of documents: order, first occurrences, packing into batches, sections and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.session import table


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, seg_no (from 0), text: the non-blank lines of each document, numbered before blank ones are left out."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("seg_no", "text"))
    return lines.withColumn("text", F.trim("text")).where("text <> ''")


def unique_segments(segs: DataFrame) -> DataFrame:
    """First position and number of each distinct text of a document."""
    return segs.groupBy("doc_id", "text").agg(F.min("seg_no").alias("first_pos"), F.count(F.lit(1)).alias("occurrences"))


def pack(rows: DataFrame, first_items: int = 4, max_items: int = 20, max_chars: int = 3000) -> DataFrame:
    """Greedy batches of a document's texts, in order of first_pos: doc_id, batch_no, n_items, n_chars, first_pos.

    The first batch takes ``first_items`` at most, the others ``max_items``; a batch closes before it would exceed
    ``max_chars``, so a longer text is a batch of its own. The state resets with every batch, so no window sum gives
    this: it is a fold over the document's ordered lengths that carries the open batch and the closed ones.
    """
    item = F.struct("first_pos", F.length("text").cast("long").alias("n"))
    lists = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    batch = "array<struct<n_items:long,n_chars:long,first_pos:int>>"
    start = F.struct(F.array().cast(batch).alias("done"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"), F.lit(0).cast("int").alias("at"))

    def step(s, x):
        limit = F.when(F.size(s["done"]) == 0, F.lit(first_items)).otherwise(F.lit(max_items))
        full = (s["n"] > 0) & ((s["n"] >= limit) | (s["chars"] + x["n"] > max_chars))
        closed = F.array_append(s["done"], F.struct(s["n"].alias("n_items"), s["chars"].alias("n_chars"), s["at"].alias("first_pos")))
        return F.struct(
            F.when(full, closed).otherwise(s["done"]).alias("done"), F.when(full, F.lit(1).cast("long")).otherwise(s["n"] + 1).alias("n"),
            F.when(full, x["n"]).otherwise(s["chars"] + x["n"]).alias("chars"), F.when(full | (s["n"] == 0), x["first_pos"].cast("int")).otherwise(s["at"]).alias("at"),
        )

    last = lambda s: F.array_append(s["done"], F.struct(s["n"].alias("n_items"), s["chars"].alias("n_chars"), s["at"].alias("first_pos")))
    folded = lists.select("doc_id", F.aggregate("items", start, step, last).alias("b"))
    return folded.select("doc_id", F.posexplode("b").alias("batch_no", "b")).select("doc_id", "batch_no", "b.n_items", "b.n_chars", "b.first_pos")


def doc_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    unique = unique_segments(segments(table(spark, sf_dir, "documents")).where(X.has_letters(F.col("text"))))
    return pack(unique).select("doc_id", "batch_no", "n_items", "n_chars")


def q_unique_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = unique_segments(segments(table(spark, sf_dir, "documents")))
    return u.select("doc_id", X.digest(F.col("text")).alias("text_sha"), "first_pos", "occurrences")


def digest_sharing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of equal content: the one kept, and how many others there are."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.digest(F.col("text")).alias("digest"))
    shared = d.groupBy("digest").agg(F.min("doc_id").alias("keeper_id"), (F.count(F.lit(1)) - 1).alias("others"))
    return d.join(shared, "digest").select("doc_id", "digest", "keeper_id", "others")


def predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the lines of each document that the skip predicates hit."""
    s, t = segments(table(spark, sf_dir, "documents")), F.col("text")
    n = lambda c: F.count_if(c)
    return s.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"), n(X.has_letters(t)).alias("n_text"), n(X.worth_translating(t)).alias("n_worth"), n(X.is_page_number(t)).alias("n_page_numbers"),
        n(X.is_acronym(t)).alias("n_acronym"), n(X.selectable(t)).alias("n_selectable"), F.countDistinct(F.xxhash64(X.masked_digits(t))).alias("n_masked"), n(X.leading_number(t) != "").alias("n_numbered"),
    )


def running_lines(spark: SparkSession, sf_dir: str, least: int = 5) -> DataFrame:
    """Lines that repeat, digits aside, in at least ``least`` documents: what headers and footers are in pages."""
    s = segments(table(spark, sf_dir, "documents")).select(X.masked_digits(F.col("text")).alias("masked"), "doc_id")
    return s.groupBy("masked").agg(F.countDistinct("doc_id").alias("docs"), F.count(F.lit(1)).alias("times")).where(F.col("docs") >= least).select(F.sha1(F.col("masked").cast("binary")).alias("line_sha"), "docs", "times")


def section_carry(rows: DataFrame, key: str, order: str, level: Column, opens: Column) -> DataFrame:
    """Marks the rows of sections that an opening heading starts, up to the next heading of its level or above.

    The carried state is the last heading that decides: one that opens a section, or one that closes the open one. With
    headings of a few levels the latest opening of each level is a running maximum, so the whole is one ordered window.
    """
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = rows.withColumn("_level", level).withColumn("_opens", opens)
    skip = F.lit(False)
    for k in range(1, 7):
        opened = F.max(F.when(F.col("_opens") & (F.col("_level") == k), F.col(order))).over(w)
        closed = F.max(F.when(~F.col("_opens") & (F.col("_level") <= k), F.col(order))).over(w)
        skip = skip | F.coalesce(opened > F.coalesce(closed, F.lit(-1)), F.lit(False))
    return r.withColumn("skip", skip).drop("_level", "_opens")


def doc_sample(spark: SparkSession, sf_dir: str, budget: int = 4000) -> DataFrame:
    """Every k-th line of a document (k = lines div 40, at least 1) until ``budget`` characters, the one across it included."""
    s = segments(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    s = s.withColumn("rn", F.row_number().over(w) - 1).withColumn("k", F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy("doc_id")) / 40)))
    picked = s.where(F.col("rn") % F.col("k") == 0).withColumn("before", F.coalesce(F.sum(F.length("text")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return picked.where(F.col("before") < budget).groupBy("doc_id").agg(F.count(F.lit(1)).alias("paragraphs"), F.sum(F.length("text")).alias("sample_chars"))


def doc_excerpt(spark: SparkSession, sf_dir: str, least: int = 80, budget: int = 1500) -> DataFrame:
    """The first lines of ``least`` characters or more up to ``budget`` in all, the last one cut."""
    s = segments(table(spark, sf_dir, "documents")).where(F.length("text") >= least)
    w = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("before", F.coalesce(F.sum(F.length("text")).over(w), F.lit(0))).where(F.col("before") < budget)
    cut = F.substring("text", F.lit(1), (budget - F.col("before")).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("seg_no", cut.alias("t"))))
    return s.groupBy("doc_id").agg(F.sha1(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").cast("binary")).alias("excerpt_sha"), F.count(F.lit(1)).alias("parts"))


def neighbour_drop(spark: SparkSession, sf_dir: str, budget: int = 400) -> DataFrame:
    """Lines within ``budget`` characters before or after a suspect line (one with a digit) of the same document.

    Both sides are ranges of the running length, so one ordered window with a RANGE frame answers, without a self join.
    """
    s = segments(table(spark, sf_dir, "documents")).withColumn("suspect", F.col("text").rlike("[0-9]"))
    w = Window.partitionBy("doc_id").orderBy("seg_no").rowsBetween(Window.unboundedPreceding, 0)
    s = s.withColumn("cum", F.sum(F.length("text")).over(w))
    near = Window.partitionBy("doc_id").orderBy("cum").rangeBetween(-budget, budget)
    return s.withColumn("hit", F.max(F.col("suspect").cast("int")).over(near)).where("hit = 1").select("doc_id", "seg_no", "suspect")


def stratified_sample(spark: SparkSession, sf_dir: str, limit: int = 100) -> DataFrame:
    """Round robin over sources in a seeded order: the first of each source, then the second, ``limit`` rows in all."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.sha1(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).cast("binary")).alias("h"))
    d = d.withColumn("rn", F.row_number().over(Window.partitionBy("source").orderBy("h", "doc_id")))
    return d.orderBy("rn", "source").limit(limit).select("source", "doc_id", "rn")


def footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Characters that each source holds, texts that it holds twice counted once, and how many of its documents others share."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", X.digest(F.col("text")).alias("digest"), "n_chars")
    sources = d.groupBy("digest").agg(F.countDistinct("source").alias("sources"))
    once = d.groupBy("source", "digest").agg(F.max("n_chars").alias("n_chars"), F.count(F.lit(1)).alias("docs")).join(sources, "digest")
    return once.groupBy("source").agg(F.sum("n_chars").alias("chars"), F.sum("docs").alias("docs"), F.sum(F.when(F.col("sources") > 1, F.col("docs")).otherwise(0)).alias("shared"))


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_MASK = "regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g')"
_CODE = "regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://[^\\s]+', ' ', 'g')"

ORACLE = {
    "doc_batches": f"""WITH RECURSIVE {_SEG}, u AS (SELECT doc_id, text, min(seg_no) AS first_pos FROM s WHERE regexp_matches(text, '\\p{{L}}') GROUP BY ALL),
o AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) AS k, length(text) AS n FROM u),
b AS (SELECT doc_id, k, 0 AS batch_no, CAST(1 AS BIGINT) AS items, CAST(n AS BIGINT) AS chars FROM o WHERE k = 1
 UNION ALL SELECT o.doc_id, o.k, CASE WHEN full_ THEN b.batch_no + 1 ELSE b.batch_no END, CASE WHEN full_ THEN 1 ELSE b.items + 1 END, CASE WHEN full_ THEN o.n ELSE b.chars + o.n END
 FROM b JOIN o ON o.doc_id = b.doc_id AND o.k = b.k + 1, LATERAL (SELECT b.items >= CASE WHEN b.batch_no = 0 THEN 4 ELSE 20 END OR b.chars + o.n > 3000 AS full_))
SELECT doc_id, batch_no, max(items) AS n_items, max(chars) AS n_chars FROM b GROUP BY doc_id, batch_no""",
    "unique_segments": f"WITH {_SEG} SELECT doc_id, sha1(text) AS text_sha, min(seg_no) AS first_pos, count(*) AS occurrences FROM s GROUP BY doc_id, text",
    "digest_sharing": "WITH d AS (SELECT doc_id, sha1(text) AS digest FROM documents) SELECT doc_id, digest, min(doc_id) OVER (PARTITION BY digest) AS keeper_id, count(*) OVER (PARTITION BY digest) - 1 AS others FROM d",
    "predicates": f"""WITH {_SEG} SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(text, '\\p{{L}}')) AS n_text, count(*) FILTER (regexp_matches({_CODE}, '\\p{{L}}')) AS n_worth,
count(*) FILTER (length(text) BETWEEN 1 AND 16 AND (regexp_matches(lower(text), '^[-–—( ]*[0-9]+[-–—) ]*$') OR regexp_matches(lower(text), '^(page|p\\.)? ?[0-9]+ ?(/|of) ?[0-9]+$') OR regexp_matches(lower(text), '^page [0-9]+$') OR regexp_matches(lower(text), '^[ivxlcdm]+$'))) AS n_page_numbers,
count(*) FILTER (len(regexp_extract_all(text, '\\p{{L}}')) >= 2 AND len(regexp_extract_all(text, '\\p{{Lu}}')) >= 2) AS n_acronym,
count(*) FILTER (len(regexp_extract_all(text, '\\p{{L}}')) >= 2 AND NOT regexp_matches(text, '^https?://[^\\s]+$')) AS n_selectable, count(DISTINCT {_MASK}) AS n_masked,
count(*) FILTER (regexp_matches(text, '^\\s*([0-9]+(?:\\.[0-9]+)*)\\.?\\s+\\p{{L}}')) AS n_numbered FROM s GROUP BY doc_id""",
    "footprint": "WITH d AS (SELECT source, sha1(text) AS h, n_chars FROM documents), c AS (SELECT h, count(DISTINCT source) AS sources FROM d GROUP BY h), o AS (SELECT source, h, max(n_chars) AS n_chars, count(*) AS docs FROM d GROUP BY source, h) SELECT source, CAST(sum(n_chars) AS BIGINT) AS chars, CAST(sum(docs) AS BIGINT) AS docs, CAST(sum(CASE WHEN sources > 1 THEN docs ELSE 0 END) AS BIGINT) AS shared FROM o JOIN c USING (h) GROUP BY source",
    "running_lines": f"WITH {_SEG}, m AS (SELECT {_MASK} AS masked, doc_id FROM s) SELECT sha1(masked) AS line_sha, count(DISTINCT doc_id) AS docs, count(*) AS times FROM m GROUP BY masked HAVING count(DISTINCT doc_id) >= 5",
    "doc_sample": f"""WITH {_SEG}, a AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) - 1 AS rn, greatest(1, count(*) OVER (PARTITION BY doc_id) // 40) AS k FROM s),
p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM a WHERE rn % k = 0)
SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(text)) AS BIGINT) AS sample_chars FROM p WHERE before_ < 4000 GROUP BY doc_id""",
    "doc_excerpt": f"""WITH {_SEG}, p AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_ FROM s WHERE length(text) >= 80)
SELECT doc_id, sha1(string_agg(substring(text, 1, CAST(1500 - before_ AS BIGINT)), chr(10) ORDER BY seg_no)) AS excerpt_sha, count(*) AS parts FROM p WHERE before_ < 1500 GROUP BY doc_id""",
    "neighbour_drop": f"""WITH {_SEG}, c AS (SELECT doc_id, seg_no, regexp_matches(text, '[0-9]') AS suspect, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY seg_no) AS cum FROM s)
SELECT doc_id, seg_no, suspect FROM c WHERE EXISTS (SELECT 1 FROM c x WHERE x.doc_id = c.doc_id AND x.suspect AND abs(x.cum - c.cum) <= 400)""",
    "stratified_sample": """WITH d AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha1('7:' || CAST(doc_id AS VARCHAR)), doc_id) AS rn FROM documents)
SELECT source, doc_id, rn FROM d ORDER BY rn, source LIMIT 100""",
}
QUERIES = {
    "doc_batches": doc_batches, "unique_segments": q_unique_segments, "digest_sharing": digest_sharing, "predicates": predicates, "running_lines": running_lines, "footprint": footprint,
    "doc_sample": doc_sample, "doc_excerpt": doc_excerpt, "neighbour_drop": neighbour_drop, "stratified_sample": stratified_sample,
}
