"""Rows, cells and pieces of pages: index rows, grids, shared starts, merged lines and cells, captions, examples, formulas.

As in ``pagework``, boxes are derived from lines. Everything is an ordered window, a grouped vote or an equality join within
a page or a document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.layout import boxes, detections, iou
from quillstream.operators.rowwork import islands, numeric_pages
from quillstream.operators.segments import segments
from quillstream.session import table



def in_page() -> Window:
    return Window.partitionBy("doc_id", "page")


def in_order() -> Window:
    return Window.partitionBy("doc_id").orderBy("ord")


def index_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of an index that hold page numbers and nothing else (every ninth line is made one)."""
    n = F.col("ord")
    row = F.concat(n.cast("string"), F.lit(", "), (n + 1).cast("string"), F.lit("-"), (n + 3).cast("string"))
    b = boxes(spark, sf_dir).withColumn("row", F.when(n % 9 == 4, row).otherwise(F.col("text")))
    return b.where(F.col("row").rlike("^[0-9]+([ ,;-]+[0-9]+)*$")).select("doc_id", "page", "ord")


def number_pages(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """Pages with a column of lone numbers: at least three that have text on their left in the same row."""
    n = numeric_pages(spark, sf_dir).select("doc_id", "page", "y0", F.col("x1").alias("edge"))
    rows = boxes(spark, sf_dir).groupBy("doc_id", "page", "y0").agg(F.min("x1").alias("left_"))
    hit = n.join(rows, ["doc_id", "page", "y0"]).where(F.col("left_") < F.col("edge") - 20)
    return hit.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("numbers")).where(F.col("numbers") >= least)


def detached_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Margin notes (narrow blocks, three or more at one edge) as blocks of their own, and what is left of each page."""
    b = boxes(spark, sf_dir).withColumn("narrow", ~F.col("spanning") & (F.col("x1") - F.col("x0") <= 60))
    lane = F.count_if("narrow").over(Window.partitionBy("doc_id", "x0"))
    b = b.withColumn("note", F.col("narrow") & (lane >= 3))
    return b.groupBy("doc_id", "page").agg(F.count_if("note").alias("notes"), F.count_if(~F.col("note")).alias("body"), F.min(F.when(F.col("note"), F.col("ord"))).alias("first"))


def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of a grid of words: short lines at left edges that several of them share, between the grid's top and bottom."""
    b = boxes(spark, sf_dir).withColumn("short", (F.length("text") <= 40) & ~F.col("spanning")).withColumn("edge", F.round(F.col("x0") / 2))
    b = b.withColumn("rows", F.count_if("short").over(Window.partitionBy("doc_id", "page", "edge")))
    member = F.col("short") & (F.col("rows") >= 2)
    b = b.withColumn("top", F.min(F.when(member, F.col("y0"))).over(in_page())).withColumn("bottom", F.max(F.when(member, F.col("y1"))).over(in_page()))
    b = b.withColumn("edges", F.size(F.collect_set(F.when(member, F.col("edge"))).over(in_page())))
    return b.where("short AND edges >= 2 AND y0 >= top - 1 AND y1 <= bottom + 1").select("doc_id", "page", "ord")


def word_starts(lines: DataFrame, key: list[str]) -> DataFrame:
    """key, start: the place in its line of every word but the first."""
    w = lines.select(*key, F.posexplode(F.split("text", " ")).alias("i", "w"))
    before = Window.partitionBy(*key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    return w.withColumn("start", F.sum(F.length("w") + 1).over(before)).where("i > 0").select(*key, "start")


def shared_starts(spark: SparkSession, sf_dir: str, rows: int = 3) -> DataFrame:
    """Places at which a word begins in every line of a group of three lines: what columns of a table show."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("grp", F.floor(F.col("seg_no") / rows))
    n = s.groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 2)
    hit = word_starts(s, ["doc_id", "seg_no", "grp"]).groupBy("doc_id", "grp", "start").agg(F.count(F.lit(1)).alias("k"))
    return hit.join(n, ["doc_id", "grp"]).where("k = n").groupBy("doc_id", "grp").agg(F.count(F.lit(1)).alias("starts"), F.min("start").alias("first"))


def split_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells that stand side by side in a line, cut at bars and at wide gaps, as blocks of their own."""
    s = segments(table(spark, sf_dir, "documents"))
    cells = F.filter(F.transform(F.split("text", r"\||  +"), lambda c: F.trim(c)), lambda c: c != "")
    return s.select("doc_id", "seg_no", F.posexplode(cells).alias("cell", "t")).withColumn("n", F.max("cell").over(Window.partitionBy("doc_id", "seg_no"))).where("n > 0").select("doc_id", "seg_no", "cell", F.length("t").alias("chars"))


def visual_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent blocks of a page that stand in one row become one: their texts in order, and the box around them."""
    b = boxes(spark, sf_dir)
    new = ~(F.coalesce((F.col("y0") - F.lag("y0").over(in_page().orderBy("ord")) <= 18) & ~F.col("spanning") & (F.col("ord") % 2 == 1), F.lit(False)))
    u = islands(b, ["doc_id", "page"], "ord", new, "unit")
    return u.groupBy("doc_id", "page", "unit").agg(F.count(F.lit(1)).alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum(F.length("text")).alias("chars"))


def cell_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of each cell (half a page wide, 90 high) as one text, from the top down and from the left."""
    b = boxes(spark, sf_dir).withColumn("cell", F.floor((F.col("y0") - 50) / 90) * 2 + (F.col("x0") > 300).cast("int"))
    parts = F.array_sort(F.collect_list(F.struct("y0", "x0", "ord", "text")))
    text = F.array_join(F.transform(parts, lambda p: p["text"]), " ")
    return b.groupBy("doc_id", "page", "cell").agg(F.count(F.lit(1)).alias("n"), F.sha1(text.cast("binary")).alias("sha"))


def opens_small(col: Column) -> Column:
    return col.rlike(r"^\p{Ll}")


def line_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half sentences at the right of a page with the line that goes on at the left: no end before it, a small letter after.

    Every fifth line is given open ends, and the line after it small letters.
    """
    n = F.col("ord") % 5
    t = F.when(n == 1, F.regexp_replace("text", "[.!?:]+$", "")).when(n == 2, F.lower("text")).otherwise(F.col("text"))
    b, w = boxes(spark, sf_dir).withColumn("text", t), in_page().orderBy("ord")
    open_ = (F.col("x0") > 300) & (F.lead("x0").over(w) < 300) & ~F.col("text").rlike(r"[.!?:]$") & opens_small(F.lead("text").over(w))
    return b.withColumn("other", F.lead("ord").over(w)).withColumn("open_", open_).where("open_").select("doc_id", "ord", "other")


def caption_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captions (every eighth block is one) with the pieces that go on with them: each begins small and the one before is open."""
    b = boxes(spark, sf_dir).withColumn("label", F.col("ord") % 8 == 0)
    goes_on = ~F.col("label") & opens_small(F.col("text")) & ~F.lag("text").over(in_order()).rlike("[.!?]$")
    u = islands(b, ["doc_id"], "ord", ~F.coalesce(goes_on, F.lit(False)), "unit")
    return u.groupBy("doc_id", "unit").agg(F.min_by("label", "ord").alias("label"), F.min("ord").alias("ord"), F.count(F.lit(1)).alias("pieces")).where("label").drop("unit", "label")


def wrapped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that go on with the one above in their column: near it, of its size, and no sentence has ended there."""
    w = Window.partitionBy("doc_id", "page", "x0").orderBy("y0")
    b = boxes(spark, sf_dir)
    near = (F.col("y0") - F.lag("y1").over(w) <= 40) & (F.lag("size").over(w) == F.col("size")) & ~F.lag("text").over(w).rlike("[.!?]$")
    return b.withColumn("wraps", F.coalesce(near, F.lit(False))).where("wraps").select("doc_id", "ord")


def float_contents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What belongs to a float: the blocks of a column between the caption above (or its top) and the caption below."""
    b = boxes(spark, sf_dir).withColumn("caption", F.col("ord") % 9 == 8)
    below = Window.partitionBy("doc_id", "page", "x0").orderBy("y0").rowsBetween(1, Window.unboundedFollowing)
    b = b.withColumn("of", F.min(F.when(F.col("caption"), F.col("ord"))).over(below)).where("NOT caption AND of IS NOT NULL")
    return b.groupBy("doc_id", F.col("of").alias("caption")).agg(F.count(F.lit(1)).alias("blocks"), F.sum(F.length("text")).alias("chars"))


def numbered_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples with a number in brackets (every tenth line is made one) and the lines after them that are set deeper."""
    b = boxes(spark, sf_dir)
    t = F.when(F.col("ord") % 10 == 3, F.concat(F.lit("("), F.col("ord").cast("string"), F.lit(") "), "text")).otherwise(F.col("text"))
    b = b.withColumn("number", F.nullif(F.regexp_extract(t, r"^\(([0-9]+)\)", 1), F.lit("")).cast("int"))
    deeper = F.lead("x0").over(in_order()) > F.col("x0")
    return b.where("number IS NOT NULL").select("doc_id", "ord", "number").join(b.select("doc_id", "ord", F.coalesce(deeper, F.lit(False)).alias("deeper")), ["doc_id", "ord"])


def keyed_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two lines in a row whose first words carry the same keys in the same order (a key is a word's length modulo 3)."""
    b = boxes(spark, sf_dir).withColumn("key", F.transform(F.slice(F.split("text", " "), 1, 4), lambda x: F.length(x) % 3)).where("size(key) = 4")
    same = lambda f: F.coalesce((f("key").over(in_order()) == F.col("key")) & (F.abs(f("ord").over(in_order()) - F.col("ord")) == 1), F.lit(False))
    return b.withColumn("hit", same(F.lead) | same(F.lag)).where("hit").select("doc_id", "ord")


def is_formula(t: Column) -> Column:
    """Signs of a formula and at most one long word."""
    return t.rlike(r"[=+*/<>|^]|[0-9]\s*-") & (X.count_of(t, r"[A-Za-z]{4,}") <= 1)


def display_formulas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are formulas, neighbours joined: a formula that was wrapped is one."""
    s = segments(table(spark, sf_dir, "documents")).where(is_formula(F.col("text")))
    gap = F.coalesce(F.col("seg_no") - F.lag("seg_no").over(Window.partitionBy("doc_id").orderBy("seg_no")) > 1, F.lit(True))
    return islands(s, ["doc_id"], "seg_no", gap, "unit").groupBy("doc_id", "unit").agg(F.min("seg_no").alias("first"), F.count(F.lit(1)).alias("lines"))


def boundary_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines cut at a mark between sentences where there is exactly one; nothing of the others."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("parts", F.split("text", r"\. "))
    two = F.size("parts") == 2
    return s.select("doc_id", "seg_no", F.when(two, F.length(F.col("parts")[0])).alias("before"), F.when(two, F.length(F.get("parts", F.lit(1)))).alias("after"))


def alphabet_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes of a document whose letters come mostly as single ones, as those of formulas do."""
    b = boxes(spark, sf_dir)
    single, letters = F.sum(X.count_of(F.col("text"), r"(?<!\p{L})\p{L}(?!\p{L})")), F.sum(X.count_of(F.col("text"), X.LETTER))
    return b.groupBy("doc_id", "size").agg(letters.alias("letters"), F.round(single / F.nullif(letters, F.lit(0)), 9).alias("share")).where("letters >= 20 AND share >= 0.02")


def stored_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes kept as JSON under a key of kind, model and size, and those of one key read back."""
    d = detections(spark, sf_dir, "ref")
    key = F.struct(F.lit("layout").alias("kind"), F.when(F.col("doc_id") % 2 == 0, "m1").otherwise("m2").alias("model"), F.lit(1024).alias("size"))
    lines = d.select(F.to_json(F.struct(key.alias("key"), "doc_id", "page", "class", "x0", "y1")).alias("line"))
    back = F.from_json("line", "key STRUCT<kind: STRING, model: STRING, size: INT>, doc_id LONG, page INT, class STRING, x0 DOUBLE, y1 DOUBLE")
    mine = lines.select(back.alias("b")).select("b.*").where("key.kind = 'layout' AND key.model = 'm1' AND key.size = 1024")
    return mine.groupBy("doc_id", "class").agg(F.count(F.lit(1)).alias("n"), F.sum("x0").alias("x"), F.max("y1").alias("y"))


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each block: that of the model's region that covers it by half, else a rule's."""
    col = lambda d, p: d.select("doc_id", "ord", *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1", "class")])
    j = col(detections(spark, sf_dir, "ref"), "a_").join(col(detections(spark, sf_dir, "new"), "b_"), ["doc_id", "ord"], "left")
    j = j.join(boxes(spark, sf_dir).select("doc_id", "ord", "size", F.length("text").alias("n")), ["doc_id", "ord"])
    rule = F.when((F.col("size") >= 12) & (F.col("n") < 60), "heading").otherwise("body")
    return j.select("doc_id", "ord", F.when(F.coalesce(iou("a_", "b_") >= 0.5, F.lit(False)), F.col("b_class")).otherwise(rule).alias("class"))


def shape_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each shape (a word's length and last letter) the first letter that most of its words have; ties by letter."""
    w = table(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("w"))
    n = w.groupBy(F.length("w").alias("length"), F.substring("w", -1, 1).alias("last"), F.substring("w", 1, 1).alias("letter")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("length", "last").agg(F.min_by("letter", F.struct(-F.col("n"), "letter")).alias("letter"), F.sum("n").alias("votes"))


_SEG = """s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM
 (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)
 WHERE trim(l[i], ' ') <> '')"""
_BOX = f"""{_SEG}, z AS (SELECT *, seg_no % 17 = 0 AS spanning, CASE WHEN seg_no % 17 = 0 THEN 40.0::DOUBLE
 ELSE 40.0::DOUBLE + (seg_no % 2) * 270 END AS x0 FROM s),
b AS (SELECT doc_id, CAST(seg_no // 40 AS INT) AS page, seg_no AS ord, x0, CAST(60 + (seg_no % 40) * 18 AS DOUBLE) AS y0,
 CASE WHEN spanning THEN 560.0::DOUBLE ELSE x0 + least(250, length(text)) END AS x1,
 CAST(74 + (seg_no % 40) * 18 AS DOUBLE) AS y1, CAST(9 + length(text) % 4 AS DOUBLE) AS size, text, spanning FROM z)"""
_SMALL = "regexp_matches({}, '^\\p{{Ll}}')"
ORACLE = {
    "index_rows": f"""WITH {_BOX} SELECT doc_id, page, ord FROM b WHERE ord % 9 = 4 OR regexp_matches(text, '^[0-9]+([ ,;-]+[0-9]+)*$')""",
    "number_pages": f"""WITH {_BOX}, q AS (SELECT doc_id, page, y0, 540.0::DOUBLE + CASE ord % 4 WHEN 0 THEN 0 WHEN 1 THEN page % 2
 ELSE ord % 13 * 3 END AS edge FROM b WHERE ord % 5 <> 3)
SELECT doc_id, page, count(*) AS numbers FROM q JOIN b USING (doc_id, page, y0) WHERE x1 < edge - 20 GROUP BY ALL HAVING count(*) >= 3""",
    "detached_notes": f"""WITH {_BOX}, n AS (SELECT *, NOT spanning AND x1 - x0 <= 60 AS narrow FROM b),
m AS (SELECT *, narrow AND count(*) FILTER (narrow) OVER (PARTITION BY doc_id, x0) >= 3 AS note FROM n)
SELECT doc_id, page, count(*) FILTER (note) AS notes, count(*) FILTER (NOT note) AS body, min(ord) FILTER (note) AS first FROM m
GROUP BY doc_id, page""",
    "grid_cells": f"""WITH {_BOX}, c AS (SELECT * FROM b WHERE length(text) <= 40 AND NOT spanning),
m AS (SELECT * FROM c QUALIFY count(*) OVER (PARTITION BY doc_id, page, x0) >= 2),
g AS (SELECT doc_id, page, min(y0) AS top, max(y1) AS bottom FROM m GROUP BY ALL HAVING count(DISTINCT x0) >= 2)
SELECT c.doc_id, c.page, ord FROM c JOIN g ON c.doc_id = g.doc_id AND c.page = g.page WHERE y0 >= top - 1 AND y1 <= bottom + 1""",
    "split_cells": f"""WITH {_SEG}, p AS (SELECT doc_id, seg_no, list_filter(list_transform(regexp_split_to_array(text, '\\||  +'),
 lambda x: trim(x, ' ')), lambda x: x <> '') AS l FROM s)
SELECT doc_id, seg_no, i - 1 AS cell, length(l[i]) AS chars FROM p, unnest(range(1, len(l) + 1)) AS r(i) WHERE len(l) > 1""",
    "visual_lines": f"""WITH {_BOX}, n AS (SELECT *, CASE WHEN y0 - lag(y0) OVER w <= 18 AND NOT spanning AND ord % 2 = 1 THEN 0 ELSE 1 END AS new FROM b
 WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord)),
u AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, page ORDER BY ord) AS BIGINT) AS unit FROM n)
SELECT doc_id, page, unit, count(*) AS n, min(x0) AS x0, max(x1) AS x1, CAST(sum(length(text)) AS BIGINT) AS chars FROM u GROUP BY ALL""",
    "cell_texts": f"""WITH {_BOX} SELECT doc_id, page, CAST(floor((y0 - 50) / 90) AS BIGINT) * 2 + CASE WHEN x0 > 300 THEN 1 ELSE 0 END AS cell,
 count(*) AS n, sha1(string_agg(text, ' ' ORDER BY y0, x0, ord)) AS sha FROM b GROUP BY 1, 2, 3""",
    "line_tails": f"""WITH {_BOX}, t AS (SELECT * REPLACE (CASE ord % 5 WHEN 1 THEN regexp_replace(text, '[.!?:]+$', '') WHEN 2 THEN lower(text)
 ELSE text END AS text) FROM b), n AS (SELECT *, lead(ord) OVER w AS other, lead(text) OVER w AS nt, lead(x0) OVER w AS nx FROM t
 WINDOW w AS (PARTITION BY doc_id, page ORDER BY ord))
SELECT doc_id, ord, other FROM n WHERE x0 > 300 AND nx < 300 AND NOT regexp_matches(text, '[.!?:]$') AND {_SMALL.format('nt')}""",
    "caption_pieces": f"""WITH {_BOX}, n AS (SELECT *, CASE WHEN ord % 8 <> 0 AND {_SMALL.format('text')}
 AND NOT regexp_matches(lag(text) OVER w, '[.!?]$') THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)),
u AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS unit FROM n),
g AS (SELECT doc_id, unit, min(ord) AS ord, count(*) AS pieces FROM u GROUP BY doc_id, unit) SELECT doc_id, ord, pieces FROM g WHERE ord % 8 = 0""",
    "wrapped_lines": f"""WITH {_BOX}, n AS (SELECT *, lag(y1) OVER w AS py, lag(size) OVER w AS ps, lag(text) OVER w AS pt FROM b
 WINDOW w AS (PARTITION BY doc_id, page, x0 ORDER BY y0))
SELECT doc_id, ord FROM n WHERE y0 - py <= 40 AND ps = size AND NOT regexp_matches(pt, '[.!?]$')""",
    "float_contents": f"""WITH {_BOX}, n AS (SELECT *, min(CASE WHEN ord % 9 = 8 THEN ord END) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0
 ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS caption FROM b)
SELECT doc_id, caption, count(*) AS blocks, CAST(sum(length(text)) AS BIGINT) AS chars FROM n WHERE ord % 9 <> 8 AND caption IS NOT NULL
GROUP BY doc_id, caption""",
    "numbered_examples": f"""WITH {_BOX}, n AS (SELECT *, coalesce(lead(x0) OVER (PARTITION BY doc_id ORDER BY ord) > x0, false) AS deeper FROM b)
SELECT doc_id, ord, CASE WHEN ord % 10 = 3 THEN CAST(ord AS INT) ELSE TRY_CAST(regexp_extract(text, '^\\(([0-9]+)\\)', 1) AS INT) END AS number, deeper
FROM n WHERE ord % 10 = 3 OR regexp_matches(text, '^\\([0-9]+\\)')""",
    "keyed_lines": f"""WITH {_BOX}, k AS (SELECT doc_id, ord, list_transform(string_split(text, ' ')[1:4], lambda x: length(x) % 3) AS key FROM b),
f AS (SELECT * FROM k WHERE len(key) = 4)
SELECT DISTINCT x.doc_id, x.ord FROM f x JOIN f y ON x.doc_id = y.doc_id AND abs(x.ord - y.ord) = 1 AND x.key = y.key""",
    "display_formulas": f"""WITH {_SEG}, f AS (SELECT * FROM s WHERE regexp_matches(text, '[=+*/<>|^]|[0-9]\\s*-') AND len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) <= 1),
n AS (SELECT *, CASE WHEN seg_no - lag(seg_no) OVER (PARTITION BY doc_id ORDER BY seg_no) = 1 THEN 0 ELSE 1 END AS new FROM f),
u AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY seg_no) AS BIGINT) AS unit FROM n)
SELECT doc_id, unit, min(seg_no) AS first, count(*) AS lines FROM u GROUP BY doc_id, unit""",
    "boundary_splits": f"""WITH {_SEG}, p AS (SELECT doc_id, seg_no, string_split(text, '. ') AS l FROM s)
SELECT doc_id, seg_no, CASE WHEN len(l) = 2 THEN length(l[1]) END AS before, CASE WHEN len(l) = 2 THEN length(l[2]) END AS after FROM p""",
    "alphabet_fonts": f"""WITH {_BOX}, n AS (SELECT doc_id, size, len(regexp_extract_all(text, '\\p{{L}}')) AS l,
 len(list_filter(regexp_extract_all(text, '\\p{{L}}+'), lambda x: length(x) = 1)) AS k FROM b),
g AS (SELECT doc_id, size, CAST(sum(l) AS BIGINT) AS letters, sum(k) AS k FROM n GROUP BY doc_id, size)
SELECT doc_id, size, letters, round(k / letters, 9) AS share FROM g WHERE letters >= 20 AND round(k / letters, 9) >= 0.02""",
    "stored_boxes": f"""WITH {_BOX} SELECT doc_id, CASE WHEN spanning THEN 'title' ELSE 'text' END AS class, count(*) AS n, sum(x0) AS x, max(y1) AS y
FROM b WHERE doc_id % 2 = 0 GROUP BY 1, 2""",
    "classified": f"""WITH {_BOX}, n AS (SELECT *, (ord % 7) * 6 AS dx, ord % 7 AS dy FROM b),
i AS (SELECT *, greatest(0, x1 - x0 - dx) * greatest(0, y1 - y0 - dy) AS both_, (x1 - x0) * (y1 - y0) AS a FROM n)
SELECT doc_id, ord, CASE WHEN ord % 11 <> 5 AND both_ / (2 * a - both_) >= 0.5 THEN CASE WHEN spanning THEN 'title' ELSE 'text' END
 WHEN size >= 12 AND length(text) < 60 THEN 'heading' ELSE 'body' END AS class FROM i""",
    "shape_votes": """WITH w AS (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
n AS (SELECT length(w) AS length, right(w, 1) AS last, left(w, 1) AS letter, count(*) AS n FROM w GROUP BY ALL)
SELECT length, last, first(letter ORDER BY n DESC, letter) AS letter, CAST(sum(n) AS BIGINT) AS votes FROM n GROUP BY length, last""",
    "shared_starts": f"""WITH {_SEG}, g AS (SELECT *, seg_no // 3 AS grp FROM s), n AS (SELECT doc_id, grp, count(*) AS n FROM g GROUP BY ALL HAVING count(*) >= 2),
w AS (SELECT doc_id, grp, seg_no, string_split(text, ' ') AS l FROM g),
p AS (SELECT doc_id, grp, CAST(list_sum(list_transform(l[1:i - 1], lambda x: length(x) + 1)) AS BIGINT) AS start FROM w, unnest(range(2, len(l) + 1)) AS r(i)),
k AS (SELECT doc_id, grp, start, count(*) AS k FROM p GROUP BY ALL)
SELECT doc_id, grp, count(*) AS starts, min(start) AS first FROM k JOIN n USING (doc_id, grp) WHERE k = n GROUP BY doc_id, grp""",
}
QUERIES = {
    f.__name__: f
    for f in (
        index_rows, number_pages, detached_notes, grid_cells, shared_starts, split_cells, visual_lines, cell_texts, line_tails, caption_pieces,
        wrapped_lines, float_contents, numbered_examples, keyed_lines, display_formulas, boundary_splits, alphabet_fonts, stored_boxes,
        classified, shape_votes,
    )
}
