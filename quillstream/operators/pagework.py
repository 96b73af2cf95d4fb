"""Page analysis on derived boxes: frames, margins, notes, gaps, indents, tables, panels, continuations, bibliographies.

The base table is ``layout.boxes``. Everything is an ordered window, a grouped vote or an equality join on a cell, within
a document or page; no page is joined with itself without a key that bounds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.layout import boxes
from quillstream.operators.pairs import upper_median
from quillstream.operators.segments import segments
from quillstream.session import table


def latin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with letters of which fewer than a tenth are CJK, and pages of which 40 % of the lines end in a number."""
    b = boxes(spark, sf_dir)
    letters, cjk = F.sum(X.count_of(F.col("text"), X.LETTER)), F.sum(X.count_of(F.col("text"), r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]"))
    refs = F.avg(F.col("text").rlike(r"[0-9]+[.,;]?$").cast("int"))
    return b.groupBy("doc_id", "page").agg(((letters > 0) & (cjk < 0.1 * letters)).alias("latin"), ((refs >= 0.4) & (F.count(F.lit(1)) >= 5)).alias("index_page"), F.round(refs, 6).alias("ref_share"))


def text_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right edge of a document's text by vote: over the document, by page parity, by page; the most specific with
    enough votes holds. The three levels are one pass of grouping sets."""
    b = boxes(spark, sf_dir).where("NOT spanning").withColumn("parity", F.col("page") % 2).withColumn("edge", (F.round(F.col("x1") / 5) * 5).cast("int"))
    g = b.groupingSets([["doc_id", "edge"], ["doc_id", "parity", "edge"], ["doc_id", "page", "edge"]], "doc_id", "parity", "page", "edge").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))
    best = g.groupBy("doc_id", "parity", "page", "level").agg(F.max_by("edge", F.struct("n", "edge")).alias("edge"), F.max("n").alias("n"))
    keep = lambda cols, name: best.where(" AND ".join(f"{c} IS NULL" if c not in cols else f"{c} IS NOT NULL" for c in ("parity", "page"))).select("doc_id", *cols, F.col("edge").alias(f"{name}_edge"), F.col("n").alias(f"{name}_n"))
    pages = b.select("doc_id", "page", "parity").distinct()
    j = pages.join(keep([], "doc"), "doc_id", "left").join(keep(["parity"], "parity"), ["doc_id", "parity"], "left").join(keep(["page"], "page"), ["doc_id", "page"], "left")
    frame = F.coalesce(F.when(F.col("page_n") >= 4, F.col("page_edge")), F.when(F.col("parity_n") >= 4, F.col("parity_edge")), F.col("doc_edge"))
    return j.select("doc_id", "page", frame.alias("edge"))


def margin_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Narrow blocks (at most 60 wide) whose left edge has support of 2 others of the document: notes in a lane."""
    b = boxes(spark, sf_dir).where("NOT spanning AND x1 - x0 <= 60")
    near = Window.partitionBy("doc_id").orderBy("x0").rangeBetween(-2, 2)
    return b.withColumn("lane", F.count(F.lit(1)).over(near)).where("lane >= 3").select("doc_id", "ord", "lane")


def line_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest gap between blocks of a column, in twentieths of the size, ties to the smaller; by default 6."""
    b = boxes(spark, sf_dir).where("NOT spanning")
    w = Window.partitionBy("doc_id", "page", F.col("x0")).orderBy("y0")
    g = b.withColumn("gap", F.round((F.lead("y0").over(w) - F.col("y1")) / F.col("size") * 20).cast("int"))
    n = g.where("gap IS NOT NULL AND gap >= 0").groupBy("doc_id", "gap").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("doc_id").agg(F.min_by("gap", F.struct((-F.col("n")).alias("n"), F.col("gap"))).alias("gap"), F.sum("n").alias("pairs"))
    return b.select("doc_id").distinct().join(best, "doc_id", "left").select("doc_id", F.when(F.col("pairs") >= 3, F.col("gap")).otherwise(6).alias("gap"))


def paragraph_space(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The upper median of what follows lines that end a sentence and are short, where at least three do."""
    s = segments(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    g = s.withColumn("after", F.length(F.lead("text").over(w))).where(F.col("text").rlike("[.!?]$") & (F.length("text") < 200) & F.col("after").isNotNull())
    return upper_median(g.withColumn("after", F.col("after").cast("double")), "after", ["doc_id"], name="space")


def indents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a document sets its paragraphs in (more indented than flush, and three or more), and by how much: the
    interpolated median of the indents."""
    b = boxes(spark, sf_dir).where("NOT spanning").withColumn("indent", F.pmod("ord", F.lit(3)) * F.col("size") / 2)
    g = b.groupBy("doc_id").agg(F.count_if(F.col("indent") > 0).alias("inn"), F.count_if(F.col("indent") == 0).alias("flush"), F.round(F.expr("percentile(CASE WHEN indent > 0 THEN indent END, 0.5)"), 6).alias("median"))
    return g.select("doc_id", ((F.col("inn") > F.col("flush")) & (F.col("inn") >= 3)).alias("sets_in"), F.coalesce("median", F.lit(0.0)).alias("median"))


def body_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commonest rounded width of blocks, the last one of each page aside; ties to the smaller."""
    b = boxes(spark, sf_dir)
    last = F.max("ord").over(Window.partitionBy("doc_id", "page"))
    n = b.withColumn("last", last).where("ord < last").groupBy("doc_id", F.round(F.col("x1") - F.col("x0")).cast("int").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("doc_id").agg(F.min_by("width", F.struct((-F.col("n")).alias("n"), F.col("width"))).alias("width"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page, cell, x0, y0, x1, y1): a page's grid of two columns and bands of 90."""
    p = boxes(spark, sf_dir).select("doc_id", "page").distinct()
    g = p.withColumn("cell", F.explode(F.sequence(F.lit(0), F.lit(17))))
    return g.select("doc_id", "page", "cell", (40.0 + F.col("cell") % 2 * 270).alias("cx0"), (50.0 + F.floor(F.col("cell") / 2) * 90).alias("cy0"), (300.0 + F.col("cell") % 2 * 270).alias("cx1"), (140.0 + F.floor(F.col("cell") / 2) * 90).alias("cy1"))


def cell_containing(spark: SparkSession, sf_dir: str, least: float = 0.5) -> DataFrame:
    """For each block the cell that it overlaps most, if that is half of the block; ties to the first cell."""
    b = boxes(spark, sf_dir)
    j = b.join(cells(spark, sf_dir), ["doc_id", "page"])
    both = F.greatest(F.lit(0.0), F.least("x1", "cx1") - F.greatest("x0", "cx0")) * F.greatest(F.lit(0.0), F.least("y1", "cy1") - F.greatest("y0", "cy0"))
    share = both / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))
    best = j.withColumn("share", share).where(F.col("share") >= least).groupBy("doc_id", "ord").agg(F.max_by("cell", F.struct(F.round("share", 9), -F.col("cell"))).alias("cell"), F.round(F.max("share"), 6).alias("share"))
    return best


def covering_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block the region with the greatest share (to two digits), then score; later regions win ties; share from 0.6."""
    r = cells(spark, sf_dir).withColumn("score", F.pmod(F.col("cell") * 7 + F.col("doc_id"), F.lit(10)) / 10).withColumn("cx1", F.col("cx1") + 40)
    j = boxes(spark, sf_dir).join(r, ["doc_id", "page"])
    both = F.greatest(F.lit(0.0), F.least("x1", "cx1") - F.greatest("x0", "cx0")) * F.greatest(F.lit(0.0), F.least("y1", "cy1") - F.greatest("y0", "cy0"))
    j = j.withColumn("share", F.round(both / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))), 2)).where("share >= 0.6")
    return j.groupBy("doc_id", "ord").agg(F.max_by("cell", F.struct("share", "score", "cell")).alias("cell"))


def code_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells whose blocks' letters and digits are monospaced to 80 % (a block is, if its size is 9), with their blocks."""
    b = boxes(spark, sf_dir).join(cell_containing(spark, sf_dir).select("doc_id", "ord", "cell"), ["doc_id", "ord"])
    n = X.count_of(F.col("text"), "[A-Za-z0-9]")
    share = b.groupBy("doc_id", "page", "cell").agg(F.sum(F.when(F.col("size") == 9, n).otherwise(0)).alias("mono"), F.sum(n).alias("chars"), F.count(F.lit(1)).alias("blocks"))
    return share.where("chars > 0 AND mono >= 0.8 * chars").select("doc_id", "page", "cell", "blocks")


def float_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each caption (a numbered or short line) how far up its figure may reach: the lowest block before it in its column."""
    b = boxes(spark, sf_dir)
    w = Window.partitionBy("doc_id", "page", "x0").orderBy("y0").rowsBetween(Window.unboundedPreceding, -1)
    return b.withColumn("top", F.max(F.when(F.length("text") >= 80, F.col("y1"))).over(w)).where("length(text) < 40").select("doc_id", "ord", F.coalesce("top", F.lit(0.0)).alias("top"))


def running_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that repeat, digits aside, in the same band of 90 on two or more pages; and page labels."""
    b = boxes(spark, sf_dir).withColumn("zone", F.floor(F.col("y0") / 90)).withColumn("norm", X.masked_digits(F.col("text")))
    seen = b.groupBy("doc_id", "zone", "norm").agg(F.countDistinct("page").alias("pages")).where("pages >= 2").drop("pages")
    again = b.join(seen, ["doc_id", "zone", "norm"], "left_semi").select("doc_id", "ord")
    return again.union(b.where(X.is_page_number(F.col("text"))).select("doc_id", "ord")).distinct()


def joined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs: a line joins the one before unless that ended a sentence, or it begins with a capital after a short one."""
    s = segments(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    before = F.lag("text").over(w)
    new = before.isNull() | before.rlike("[.!?:]$") | (F.col("text").rlike(r"^\p{Lu}") & (F.length(before) < 60))
    p = s.withColumn("par", F.count_if(new).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.array_sort(F.collect_list(F.struct("seg_no", "text")))
    return p.groupBy("doc_id", "par").agg(F.count(F.lit(1)).alias("lines"), F.sha1(F.array_join(F.transform(parts, lambda x: x["text"]), " ").cast("binary")).alias("text_sha"))


def continuations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose first block goes on with the last one of the page before: no sentence end there, no capital here."""
    b = boxes(spark, sf_dir)
    ends = b.groupBy("doc_id", "page").agg(F.max_by("text", "ord").alias("last"), F.min_by("text", "ord").alias("first"))
    w = Window.partitionBy("doc_id").orderBy("page")
    e = ends.withColumn("next_", F.lead("first").over(w))
    return e.where(F.col("next_").isNotNull()).select("doc_id", "page", (~F.col("last").rlike("[.!?]$") & F.col("next_").rlike(r"^[\p{Ll}0-9(]")).alias("goes_on"))


def bibliographies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of reference-like lines without a heading: four leads in nine lines start one, gaps of up to four keep it going.

    A lead is a line with a number in it or at most 40 characters long.
    """
    s = segments(table(spark, sf_dir, "documents")).withColumn("lead_", F.col("text").rlike("[0-9]") | (F.length("text") <= 40))
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    s = s.withColumn("rn", F.row_number().over(w)).withColumn("ahead", F.count_if("lead_").over(w.rowsBetween(0, 8)))
    leads = s.where("lead_").withColumn("gap", F.col("rn") - F.lag("rn").over(w))
    runs = leads.withColumn("run", F.count_if(F.coalesce(F.col("gap") > 4, F.lit(True))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("doc_id", "run").agg(F.min("seg_no").alias("first"), F.max("seg_no").alias("last"), F.count(F.lit(1)).alias("leads"), F.max("ahead").alias("ahead")).where("ahead >= 4").drop("ahead", "run")


def part_plan(spark: SparkSession, sf_dir: str, parts: int = 5) -> DataFrame:
    """Documents of a source in contiguous parts of about equal weight: part = the running weight before it over the goal."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").alias("w"))
    run = Window.partitionBy("source").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    goal = F.sum("w").over(Window.partitionBy("source")) / parts
    d = d.withColumn("part", F.least(F.lit(parts - 1), F.floor(F.coalesce(F.sum("w").over(run), F.lit(0)) / goal)).cast("int"))
    return d.groupBy("source", "part").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.sum("w").alias("weight"))


def verbatim_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a document matched with those of a changed copy."""
    s = segments(table(spark, sf_dir, "documents"))
    new = s.where("seg_no % 10 <> 3 OR seg_no % 20 = 3").withColumn("text", F.when(F.col("seg_no") % 7 == 5, F.upper("text")).otherwise(F.col("text")))
    return matched_lines(s, new)


def matched_lines(s: DataFrame, new: DataFrame) -> DataFrame:
    """(doc_id, old, new, how): equal lines one to one by rank, the rest by place where their counts agree; where they
    don't, a further copy of an old line goes with the first of that text again."""
    rank = lambda d: d.withColumn("k", F.row_number().over(Window.partitionBy("doc_id", "text").orderBy("seg_no")))
    a, b = rank(s).select("doc_id", "text", "k", F.col("seg_no").alias("old")), rank(new).select("doc_id", "text", "k", F.col("seg_no").alias("new"))
    same = a.join(b, ["doc_id", "text", "k"]).select("doc_id", "old", "new")
    place = lambda d, c: d.withColumn("p", F.row_number().over(Window.partitionBy("doc_id").orderBy(c))).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("doc_id")))
    left = place(a.select("doc_id", "old").join(same, ["doc_id", "old"], "left_anti"), "old")
    right = place(b.select("doc_id", "new").join(same, ["doc_id", "new"], "left_anti"), "new")
    rest = left.join(right, ["doc_id", "p", "n"]).select("doc_id", "old", "new")
    first = a.where("k = 1").select("doc_id", "text", "old")
    again = b.join(same, ["doc_id", "new"], "left_anti").join(rest, ["doc_id", "new"], "left_anti").join(first, ["doc_id", "text"]).select("doc_id", "old", "new")
    return same.withColumn("how", F.lit("equal")).unionByName(rest.withColumn("how", F.lit("place"))).unionByName(again.withColumn("how", F.lit("again")))


def anchor_pairs(spark: SparkSession, sf_dir: str, reach: int = 40) -> DataFrame:
    """Each 'the' with the closest following 'of' within ``reach`` words, if there is one.

    The nearest following anchor is the first in a window over word places, so no pairs are made.
    """
    w = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.lower("text"), r"[\x20\x09-\x0D]+")).alias("pos", "w"))
    after = Window.partitionBy("doc_id").orderBy("pos").rangeBetween(1, reach)
    hit = w.withColumn("right_", F.min(F.when(F.col("w") == "of", F.col("pos"))).over(after))
    return hit.where("w = 'the' AND right_ IS NOT NULL").select("doc_id", "pos", (F.col("right_") - F.col("pos")).alias("gap"))


def notes_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first note of each text (lines with digits carry one), and keys that differ by note; texts whose layout no one uses."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("note", F.when(F.col("text").rlike("[0-9]"), F.concat(F.lit("n"), F.col("seg_no").cast("string"))))
    first = s.groupBy("text").agg(F.min_by("note", F.when(F.col("note").isNotNull(), F.struct("doc_id", "seg_no"))).alias("note"), F.count(F.lit(1)).alias("places"))
    return first.select(X.digest(F.col("text")).alias("text_sha"), F.coalesce("note", F.lit("")).alias("note"), X.cache_key(F.when(F.col("note").isNotNull(), F.concat(F.lit("p|"), "note")).otherwise(F.lit("p")), F.col("text")).alias("k"), "places")


def share_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the first other one with equal content and length, and the number of others."""
    d = table(spark, sf_dir, "documents").select("doc_id", X.digest(F.col("text")).alias("digest"), "n_chars")
    low = d.groupBy("digest", "n_chars").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    j = d.join(low, ["digest", "n_chars"])
    second = j.where("doc_id <> first").groupBy("digest", "n_chars").agg(F.min("doc_id").alias("second"))
    j = j.join(second, ["digest", "n_chars"])
    return j.select("doc_id", F.when(F.col("doc_id") == F.col("first"), F.col("second")).otherwise(F.col("first")).alias("other"), (F.col("n") - 1).alias("others"))


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_BOX = f"""{_SEG}, z AS (SELECT *, seg_no % 17 = 0 AS spanning, CASE WHEN seg_no % 17 = 0 THEN 40.0::DOUBLE ELSE 40.0::DOUBLE + (seg_no % 2) * 270 END AS x0 FROM s),
b AS (SELECT doc_id, CAST(seg_no // 40 AS INT) AS page, seg_no AS ord, x0, CAST(60 + (seg_no % 40) * 18 AS DOUBLE) AS y0, CASE WHEN spanning THEN 560.0::DOUBLE ELSE x0 + least(250, length(text)) END AS x1, CAST(74 + (seg_no % 40) * 18 AS DOUBLE) AS y1, CAST(9 + length(text) % 4 AS DOUBLE) AS size, text, spanning FROM z)"""
_MASK = "regexp_replace(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g')"
_CELL = "g AS (SELECT doc_id, page, c AS cell, 40.0::DOUBLE + c % 2 * 270 AS cx0, 50.0::DOUBLE + c // 2 * 90 AS cy0, 300.0::DOUBLE + c % 2 * 270 AS cx1, 140.0::DOUBLE + c // 2 * 90 AS cy1 FROM (SELECT DISTINCT doc_id, page FROM b), unnest(range(18)) AS q(c))"
_CC = "h AS (SELECT b.doc_id, b.page, ord, text, size, cell, greatest(0, least(x1, cx1) - greatest(x0, cx0)) * greatest(0, least(y1, cy1) - greatest(y0, cy0)) / ((x1 - x0) * (y1 - y0)) AS share FROM b JOIN g ON b.doc_id = g.doc_id AND b.page = g.page), m AS (SELECT * FROM h WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY doc_id, ord ORDER BY round(share, 9) DESC, cell) = 1)"
ORACLE = {
    "latin_pages": f"WITH {_BOX}, p AS (SELECT doc_id, page, sum(len(regexp_extract_all(text, '\\p{{L}}'))) AS l, sum(len(regexp_extract_all(text, '[\\p{{Han}}\\p{{Hiragana}}\\p{{Katakana}}\\p{{Hangul}}]'))) AS c, avg(CAST(regexp_matches(text, '[0-9]+[.,;]?$') AS INT)) AS r, count(*) AS n FROM b GROUP BY ALL) SELECT doc_id, page, l > 0 AND c < 0.1 * l AS latin, r >= 0.4 AND n >= 5 AS index_page, round(r, 6) AS ref_share FROM p",
    "text_frames": f"""WITH {_BOX}, e AS (SELECT doc_id, page, page % 2 AS parity, CAST(round(x1 / 5) * 5 AS INT) AS edge FROM b WHERE NOT spanning), d AS (SELECT doc_id, max_by(edge, n * 10000 + edge) AS edge, max(n) AS n FROM (SELECT doc_id, edge, count(*) AS n FROM e GROUP BY doc_id, edge) GROUP BY doc_id),
q AS (SELECT doc_id, parity, max_by(edge, n * 10000 + edge) AS edge, max(n) AS n FROM (SELECT doc_id, parity, edge, count(*) AS n FROM e GROUP BY doc_id, parity, edge) GROUP BY doc_id, parity), p AS (SELECT doc_id, page, max_by(edge, n * 10000 + edge) AS edge, max(n) AS n FROM (SELECT doc_id, page, edge, count(*) AS n FROM e GROUP BY doc_id, page, edge) GROUP BY doc_id, page)
SELECT DISTINCT e.doc_id, e.page, CASE WHEN p.n >= 4 THEN p.edge WHEN q.n >= 4 THEN q.edge ELSE d.edge END AS edge FROM e JOIN d ON e.doc_id = d.doc_id JOIN q ON e.doc_id = q.doc_id AND e.parity = q.parity JOIN p ON e.doc_id = p.doc_id AND e.page = p.page""",
    "margin_notes": f"WITH {_BOX}, n AS (SELECT doc_id, ord, count(*) OVER (PARTITION BY doc_id ORDER BY x0 RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS lane FROM b WHERE NOT spanning AND x1 - x0 <= 60) SELECT * FROM n WHERE lane >= 3",
    "line_gaps": f"WITH {_BOX}, g AS (SELECT doc_id, CAST(round((lead(y0) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0) - y1) / size * 20) AS INT) AS gap FROM b WHERE NOT spanning), n AS (SELECT doc_id, gap, count(*) AS n FROM g WHERE gap >= 0 GROUP BY ALL), k AS (SELECT doc_id, first(gap ORDER BY n DESC, gap) AS gap, sum(n) AS pairs FROM n GROUP BY doc_id) SELECT d.doc_id, CASE WHEN pairs >= 3 THEN gap ELSE 6 END AS gap FROM (SELECT DISTINCT doc_id FROM b WHERE NOT spanning) d LEFT JOIN k USING (doc_id)",
    "paragraph_space": f"WITH {_SEG}, g AS (SELECT *, length(lead(text) OVER (PARTITION BY doc_id ORDER BY seg_no)) AS after_ FROM s), f AS (SELECT * FROM g WHERE regexp_matches(text, '[.!?]$') AND length(text) < 200 AND after_ IS NOT NULL) SELECT doc_id, CAST(list_sort(list(after_))[count(*) // 2 + 1] AS DOUBLE) AS space FROM f GROUP BY doc_id HAVING count(*) >= 3",
    "indents": f"WITH {_BOX}, i AS (SELECT doc_id, (ord % 3) * size / 2 AS indent FROM b WHERE NOT spanning) SELECT doc_id, count(*) FILTER (indent > 0) > count(*) FILTER (indent = 0) AND count(*) FILTER (indent > 0) >= 3 AS sets_in, coalesce(round(quantile_cont(indent, 0.5) FILTER (indent > 0), 6), 0.0) AS median FROM i GROUP BY doc_id",
    "body_measure": f"WITH {_BOX}, l AS (SELECT *, max(ord) OVER (PARTITION BY doc_id, page) AS last FROM b), n AS (SELECT doc_id, CAST(round(x1 - x0) AS INT) AS width, count(*) AS n FROM l WHERE ord < last GROUP BY ALL) SELECT doc_id, first(width ORDER BY n DESC, width) AS width FROM n GROUP BY doc_id",
    "cell_containing": f"WITH {_BOX}, {_CELL}, {_CC} SELECT doc_id, ord, cell, round(share, 6) AS share FROM m",
    "covering_region": f"WITH {_BOX}, {_CELL}, h AS (SELECT b.doc_id, ord, cell, ((cell * 7 + b.doc_id) % 10) / 10 AS score, round(greatest(0, least(x1, cx1 + 40) - greatest(x0, cx0)) * greatest(0, least(y1, cy1) - greatest(y0, cy0)) / ((x1 - x0) * (y1 - y0)), 2) AS share FROM b JOIN g ON b.doc_id = g.doc_id AND b.page = g.page) SELECT doc_id, ord, first(cell ORDER BY share DESC, score DESC, cell DESC) AS cell FROM h WHERE share >= 0.6 GROUP BY doc_id, ord",
    "code_panels": f"WITH {_BOX}, {_CELL}, {_CC}, n AS (SELECT *, len(regexp_extract_all(text, '[A-Za-z0-9]')) AS n FROM m) SELECT doc_id, page, cell, count(*) AS blocks FROM n GROUP BY ALL HAVING sum(n) > 0 AND sum(CASE WHEN size = 9 THEN n ELSE 0 END) >= 0.8 * sum(n)",
    "float_zones": f"WITH {_BOX}, t AS (SELECT *, max(CASE WHEN length(text) >= 80 THEN y1 END) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM b) SELECT doc_id, ord, coalesce(top, 0.0) AS top FROM t WHERE length(text) < 40",
    "running_blocks": f"""WITH {_BOX}, n AS (SELECT doc_id, page, ord, text, floor(y0 / 90) AS zone, {_MASK} AS norm FROM b), r AS (SELECT doc_id, zone, norm FROM n GROUP BY ALL HAVING count(DISTINCT page) >= 2)
SELECT doc_id, ord FROM n JOIN r USING (doc_id, zone, norm) UNION SELECT doc_id, ord FROM b WHERE length(text) BETWEEN 1 AND 16 AND (regexp_matches(lower(text), '^[-–—( ]*[0-9]+[-–—) ]*$') OR regexp_matches(lower(text), '^(page|p\\.)? ?[0-9]+ ?(/|of) ?[0-9]+$') OR regexp_matches(lower(text), '^page [0-9]+$') OR regexp_matches(lower(text), '^[ivxlcdm]+$'))""",
    "joined_lines": f"WITH {_SEG}, l AS (SELECT *, lag(text) OVER (PARTITION BY doc_id ORDER BY seg_no) AS p FROM s), n AS (SELECT *, count(*) FILTER (p IS NULL OR regexp_matches(p, '[.!?:]$') OR (regexp_matches(text, '^\\p{{Lu}}') AND length(p) < 60)) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING) AS par FROM l) SELECT doc_id, par, count(*) AS lines, sha1(string_agg(text, ' ' ORDER BY seg_no)) AS text_sha FROM n GROUP BY doc_id, par",
    "continuations": f"WITH {_BOX}, e AS (SELECT doc_id, page, first(text ORDER BY ord DESC) AS l, first(text ORDER BY ord) AS f FROM b GROUP BY ALL), n AS (SELECT *, lead(f) OVER (PARTITION BY doc_id ORDER BY page) AS nx FROM e) SELECT doc_id, page, NOT regexp_matches(l, '[.!?]$') AND regexp_matches(nx, '^[\\p{{Ll}}0-9(]') AS goes_on FROM n WHERE nx IS NOT NULL",
    "bibliographies": f"""WITH {_SEG}, l AS (SELECT *, regexp_matches(text, '[0-9]') OR length(text) <= 40 AS ld, row_number() OVER w AS rn FROM s WINDOW w AS (PARTITION BY doc_id ORDER BY seg_no)), a AS (SELECT *, count(*) FILTER (ld) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS BETWEEN CURRENT ROW AND 8 FOLLOWING) AS ahead FROM l),
g AS (SELECT *, rn - lag(rn) OVER (PARTITION BY doc_id ORDER BY seg_no) AS gap FROM a WHERE ld), r AS (SELECT *, count(*) FILTER (gap IS NULL OR gap > 4) OVER (PARTITION BY doc_id ORDER BY seg_no ROWS UNBOUNDED PRECEDING) AS run FROM g) SELECT doc_id, min(seg_no) AS first, max(seg_no) AS last, count(*) AS leads FROM r GROUP BY doc_id, run HAVING max(ahead) >= 4""",
    "part_plan": "WITH d AS (SELECT source, doc_id, length(text) AS w, coalesce(sum(length(text)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bef, sum(length(text)) OVER (PARTITION BY source) / 5 AS goal FROM documents) SELECT source, CAST(least(4, floor(bef / goal)) AS INT) AS part, min(doc_id) AS first, max(doc_id) AS last, CAST(sum(w) AS BIGINT) AS weight FROM d GROUP BY ALL",
    "verbatim_match": f"""WITH {_SEG}, o AS (SELECT * FROM s), n AS (SELECT doc_id, seg_no, CASE WHEN seg_no % 7 = 5 THEN upper(text) ELSE text END AS text FROM o WHERE seg_no % 10 <> 3 OR seg_no % 20 = 3), a AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seg_no) AS k FROM o), b AS (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY seg_no) AS k FROM n),
e AS (SELECT a.doc_id, a.seg_no AS old, b.seg_no AS new FROM a JOIN b USING (doc_id, text, k)), l AS (SELECT doc_id, seg_no AS old, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM a WHERE (doc_id, seg_no) NOT IN (SELECT (doc_id, old) FROM e)), r AS (SELECT doc_id, seg_no AS new, row_number() OVER (PARTITION BY doc_id ORDER BY seg_no) AS p, count(*) OVER (PARTITION BY doc_id) AS n FROM b WHERE (doc_id, seg_no) NOT IN (SELECT (doc_id, new) FROM e)),
t AS (SELECT l.doc_id, old, new FROM l JOIN r USING (doc_id, p, n)), g AS (SELECT b.doc_id, a.seg_no AS old, b.seg_no AS new FROM b JOIN a ON a.doc_id = b.doc_id AND a.text = b.text AND a.k = 1 WHERE (b.doc_id, b.seg_no) NOT IN (SELECT (doc_id, new) FROM e UNION ALL SELECT (doc_id, new) FROM t))
SELECT doc_id, old, new, 'equal' AS how FROM e UNION ALL SELECT doc_id, old, new, 'place' FROM t UNION ALL SELECT doc_id, old, new, 'again' FROM g""",
    "anchor_pairs": "WITH w AS (SELECT doc_id, i - 1 AS pos, l[i] AS w FROM (SELECT doc_id, regexp_split_to_array(lower(text), '[\\x20\\x09-\\x0D]+') AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i)), h AS (SELECT *, min(CASE WHEN w = 'of' THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos RANGE BETWEEN 1 FOLLOWING AND 40 FOLLOWING) AS nx FROM w) SELECT doc_id, pos, nx - pos AS gap FROM h WHERE w = 'the' AND nx IS NOT NULL",
    "notes_and_links": f"WITH {_SEG}, f AS (SELECT text, CASE WHEN regexp_matches(text, '[0-9]') THEN 'n' || first(seg_no ORDER BY doc_id, seg_no) END AS note, count(*) AS places FROM s GROUP BY text) SELECT sha1(text) AS text_sha, coalesce(note, '') AS note, sha1(CASE WHEN note IS NULL THEN 'p' ELSE 'p|' || note END || chr(10) || text) AS k, places FROM f",
    "share_source": "WITH d AS (SELECT doc_id, sha1(text) AS h, n_chars FROM documents) SELECT a.doc_id, min(b.doc_id) AS other, count(*) AS others FROM d a JOIN d b ON a.h = b.h AND a.n_chars = b.n_chars AND a.doc_id <> b.doc_id GROUP BY a.doc_id",
}
QUERIES = {
    "latin_pages": latin_pages, "text_frames": text_frames, "margin_notes": margin_notes, "line_gaps": line_gaps, "paragraph_space": paragraph_space, "indents": indents, "body_measure": body_measure, "cell_containing": cell_containing, "covering_region": covering_region,
    "code_panels": code_panels, "float_zones": float_zones, "running_blocks": running_blocks, "joined_lines": joined_lines, "continuations": continuations, "bibliographies": bibliographies, "part_plan": part_plan, "verbatim_match": verbatim_match, "anchor_pairs": anchor_pairs,
    "notes_and_links": notes_and_links, "share_source": share_source,
}
