"""More page and row operators: runs, groups, contents pages, number columns, leaders, anchors, numbered lists, look-ups.

As in ``pagework``, boxes are derived from lines; numbers come from the lines' own digits or from their places.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.layout import boxes, detections, iou
from quillstream.operators.pagework import cells
from quillstream.operators.segments import segments
from quillstream.operators.terms import mined
from quillstream.session import table


def islands(df: DataFrame, key: list[str], order: str, changed: Column, name: str = "island") -> DataFrame:
    """Numbers runs of rows: a row for which ``changed`` holds begins a new one."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("_new", changed).withColumn(name, F.count_if("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def format_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Adjacent blocks of equal format (size) as one segment."""
    w = Window.partitionBy("doc_id").orderBy("ord")
    b = boxes(spark, sf_dir)
    r = islands(b, ["doc_id"], "ord", F.coalesce(F.lag("size").over(w) != F.col("size"), F.lit(True)), "run")
    return r.groupBy("doc_id", "run").agg(F.first("size").alias("size"), F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("chars"))


def note_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stacked blocks of a column, cut where the distance of their tops departs from the column's commonest one."""
    b = boxes(spark, sf_dir).where("NOT spanning")
    w = Window.partitionBy("doc_id", "page", "x0").orderBy("y0")
    b = b.withColumn("pitch", (F.col("y0") - F.lag("y0").over(w)).cast("int"))
    usual = b.where("pitch IS NOT NULL").groupBy("doc_id", "pitch").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.min_by("pitch", F.struct((-F.col("n")).alias("n"), F.col("pitch"))).alias("usual"))
    g = islands(b.join(usual, "doc_id"), ["doc_id", "page", "x0"], "y0", F.coalesce(F.col("pitch") != F.col("usual"), F.lit(True)), "grp")
    return g.groupBy("doc_id", "page", "x0", "grp").agg(F.count(F.lit(1)).alias("n"), F.min("ord").alias("first"))


def region_joins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in a row in one region (their half of the page), joined while no sentence ends between them."""
    b = boxes(spark, sf_dir).withColumn("region", F.when(F.col("spanning"), 2).otherwise((F.col("x0") > 300).cast("int")))
    w = Window.partitionBy("doc_id", "region").orderBy("ord")
    new = F.coalesce(F.lag("text").over(w).rlike("[.!?]$"), F.lit(True))
    return islands(b, ["doc_id", "region"], "ord", new, "unit").groupBy("doc_id", "region", "unit").agg(F.count(F.lit(1)).alias("n"))


def numeric_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a contents page: each block with a number made of its place, set right of it at an edge that depends on it."""
    b = boxes(spark, sf_dir)
    n = F.col("ord") % 50
    edge = 540.0 + F.when(F.col("ord") % 4 == 0, 0).when(F.col("ord") % 4 == 1, F.col("page") % 2).otherwise(F.col("ord") % 13 * 3)
    return b.where("ord % 5 <> 3").select("doc_id", "page", "ord", n.alias("number"), edge.alias("x1"), "y0", "size")


def number_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centres at which at least three numbers of a page stand within 1 of each other."""
    n = numeric_pages(spark, sf_dir)
    near = Window.partitionBy("doc_id", "page").orderBy("x1").rangeBetween(-1, 1)
    return n.withColumn("votes", F.count(F.lit(1)).over(near)).where("votes >= 3").groupBy("doc_id", "page").agg(F.countDistinct("x1").alias("edges"), F.max("votes").alias("votes"))


def number_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers that share an edge (within 1) with two others of the page, and numbers on the row of such a one."""
    n = numeric_pages(spark, sf_dir)
    near = Window.partitionBy("doc_id", "page").orderBy("x1").rangeBetween(-1, 1)
    n = n.withColumn("core", F.count(F.lit(1)).over(near) >= 3).withColumn("row", F.floor(F.col("y0") / 36))
    n = n.withColumn("beside", F.max("core").over(Window.partitionBy("doc_id", "page", "row")))
    return n.where("core OR beside").select("doc_id", "ord", "core")


def voted_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The right edge of a page's rows with the most votes of neighbours (within 1): three at least, and 40 %; larger wins ties."""
    n = numeric_pages(spark, sf_dir).groupBy("doc_id", "page", F.round("x1").cast("int").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("doc_id", "page")
    v = n.withColumn("votes", F.sum("n").over(w.orderBy("edge").rangeBetween(-1, 1))).withColumn("all_", F.sum("n").over(w))
    return v.where("votes >= 3 AND votes >= 0.4 * all_").groupBy("doc_id", "page").agg(F.max_by("edge", F.struct("votes", "edge")).alias("edge"))


def toc_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents pages: a page with a column of numbers, if it has a title or the page before is one too.

    Pages with a column form runs; a page counts from the first titled one of its run on.
    """
    p = boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.length("text") < 30).alias("titled"))
    p = p.withColumn("has", F.col("n") % 3 != 1)
    w = Window.partitionBy("doc_id").orderBy("page")
    p = islands(p, ["doc_id"], "page", ~F.col("has") | F.coalesce(~F.lag("has").over(w), F.lit(True)), "run")
    seen = F.max(F.col("titled") & F.col("has")).over(Window.partitionBy("doc_id", "run").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return p.select("doc_id", "page", (F.col("has") & seen).alias("contents"))


def leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contents entries with dot leaders and a page number, taken apart again."""
    s = segments(table(spark, sf_dir, "documents"))
    entry = F.concat(F.regexp_replace("text", "[ .0-9]+$", ""), F.when(F.col("seg_no") % 3 == 0, F.concat(F.lit(" ..... "), (F.col("seg_no") * 7).cast("string"))).otherwise(F.lit("")))
    s = s.withColumn("entry", entry)
    p = r"^(.*?)[ .]{3,}([0-9]+)$"
    return s.select("doc_id", "seg_no", F.sha1(F.when(F.col("entry").rlike(p), F.regexp_extract("entry", p, 1)).otherwise(F.col("entry")).cast("binary")).alias("title_sha"), F.regexp_extract("entry", p, 2).alias("page"))


def shared_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of narrow blocks on one baseline, within 20 of each other's top: neighbours in an ordered window."""
    b = boxes(spark, sf_dir).where("NOT spanning")
    w = Window.partitionBy("doc_id", "page").orderBy("y0", "x0")
    b = b.withColumn("next_", F.lead("ord").over(w)).withColumn("down", F.lead("y0").over(w) - F.col("y0")).withColumn("right_", F.lead("x0").over(w) - F.col("x1"))
    return b.where("down <= 20 AND right_ > 0").select("doc_id", "ord", F.col("next_").alias("other"))


def next_text_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each page the next one with body text (a line of 80 characters), pages of floats skipped."""
    p = boxes(spark, sf_dir).groupBy("doc_id", "page").agg(F.bool_or(F.length("text") >= 80).alias("body"))
    after = Window.partitionBy("doc_id").orderBy("page").rowsBetween(1, Window.unboundedFollowing)
    return p.select("doc_id", "page", F.coalesce(F.min(F.when(F.col("body"), F.col("page"))).over(after), F.lit(-1)).alias("next_page"))


def column_anchors(spark: SparkSession, sf_dir: str, gap: float = 8.0) -> DataFrame:
    """Left edges of a page clustered greedily: an edge within ``gap`` of its cluster's FIRST joins it; two blocks at least."""
    b = boxes(spark, sf_dir).withColumn("left_", F.col("x0") + F.pmod("ord", F.lit(7)) * 2)
    g = b.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list("left_")).alias("xs"))
    kind = "array<struct<x:double,n:int>>"
    last = lambda a: F.element_at(a, -1)
    step = lambda a, x: F.when((F.size(a) == 0) | (x - F.coalesce(last(a)["x"], F.lit(-1e18)) >= gap), F.array_append(a, F.struct(x.alias("x"), F.lit(1).alias("n")))).otherwise(F.array_append(F.slice(a, 1, F.size(a) - 1), F.struct(last(a)["x"].alias("x"), (last(a)["n"] + 1).alias("n"))))
    return g.select("doc_id", "page", F.explode(F.filter(F.aggregate("xs", F.array().cast(kind), step), lambda c: c["n"] >= 2)).alias("c")).select("doc_id", "page", F.col("c.x").alias("x"), F.col("c.n").alias("n"))


def numbered_lists(spark: SparkSession, sf_dir: str, least: int = 4) -> DataFrame:
    """Runs of consecutive numbers from 1 on among a document's lines, a gap of up to four lines between them.

    The expected number is a state that a line moves on, so it is a fold over a document's lines (a bounded group).
    """
    s = segments(table(spark, sf_dir, "documents")).withColumn("number", F.when(F.col("seg_no") % 11 < 7, F.col("seg_no") % 11 + 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("seg_no")
        out, first, expect, at = [], None, 1, None
        for no, n in zip(rows["seg_no"], rows["number"], strict=True):
            if n == expect and (at is None or no - at <= 4):
                first = no if expect == 1 else first
                expect, at = expect + 1, no
            elif n == 1 or at is not None and no - at > 4:
                if expect > least:
                    out.append((first, at, expect - 1))
                first, expect, at = (no, 2, no) if n == 1 else (None, 1, None)
        if expect > least:
            out.append((first, at, expect - 1))
        return pd.DataFrame([(pdf["doc_id"].iloc[0], *r) for r in out], columns=["doc_id", "first", "last", "n"])

    return s.select("doc_id", "seg_no", "number").groupBy("doc_id").applyInPandas(run, "doc_id long, first int, last int, n int")


def lone_fonts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes that a document uses only for short lines (at most 60), at least half of them right beside another size."""
    b = boxes(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("ord")
    b = b.withColumn("beside", F.coalesce(F.lag("size").over(w) != F.col("size"), F.lit(False)) | F.coalesce(F.lead("size").over(w) != F.col("size"), F.lit(False)))
    g = b.groupBy("doc_id", "size").agg(F.max(F.length("text")).alias("longest"), F.avg(F.col("beside").cast("int")).alias("beside"), F.count(F.lit(1)).alias("n"))
    return g.where("longest <= 60 AND beside >= 0.5").select("doc_id", "size", "n")


def touching_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each cell of a page the blocks that touch or come within 2 of its upper rule."""
    j = boxes(spark, sf_dir).join(cells(spark, sf_dir), ["doc_id", "page"])
    near = (F.col("y0") - 2 <= F.col("cy0")) & (F.col("y1") + 2 >= F.col("cy0")) & (F.col("x0") <= F.col("cx1")) & (F.col("x1") >= F.col("cx0"))
    return j.where(near).groupBy("doc_id", "page", "cell").agg(F.count(F.lit(1)).alias("blocks"))


def box_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of which a second model finds fewer than three quarters of the boxes (IoU of one half, same place)."""
    a = detections(spark, sf_dir, "ref").select("doc_id", "ord", *[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")])
    b = detections(spark, sf_dir, "new").select("doc_id", "ord", *[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")])
    found = a.join(b, ["doc_id", "ord"], "left").groupBy("doc_id").agg(F.count(F.lit(1)).alias("boxes"), F.count_if(iou("a_", "b_") >= 0.5).alias("found"))
    return found.where("found < 0.75 * boxes")


def bookmarks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles (the first lines of documents, with doubled spaces) looked up among all lines by their masked form."""
    s = segments(table(spark, sf_dir, "documents"))
    titles = s.where("seg_no = 0").select("doc_id", X.masked_digits(F.regexp_replace("text", " ", "  ")).alias("k"))
    lines = s.groupBy(X.masked_digits(F.col("text")).alias("k")).agg(F.count(F.lit(1)).alias("hits"), F.min("doc_id").alias("first_doc"))
    return titles.join(lines, "k").select("doc_id", "hits", "first_doc")


def term_definitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Definitions that come back for asked terms, in any case: those asked for stay, in the spelling asked."""
    asked = mined(table(spark, sf_dir, "documents")).where("words > 1").groupBy(F.lower("surface").alias("k")).agg(F.min("surface").alias("term"))
    back = asked.where("length(k) % 3 <> 0").select(F.upper("k").alias("source"), F.reverse("k").alias("target")).union(asked.limit(0).select("k", "k"))
    return asked.join(back.withColumn("k", F.lower("source")), "k").select("term", "target")


def foreign_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with letters that their document's language does not use (ß, ä, ö, ü; ñ, ó, í; è, ê, ç), neighbours joined."""
    s = segments(table(spark, sf_dir, "documents")).join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    f = s.withColumn("by_letters", X.letter_language(F.col("text"))).where("by_letters IS NOT NULL").where(~X.same_language(F.col("by_letters"), F.col("lang")))
    w = Window.partitionBy("doc_id").orderBy("seg_no")
    f = islands(f, ["doc_id"], "seg_no", F.coalesce(F.col("seg_no") - F.lag("seg_no").over(w) > 1, F.lit(True)), "grp")
    return f.groupBy("doc_id", "grp").agg(F.min("seg_no").alias("first"), F.count(F.lit(1)).alias("n"))


def merged_pieces(df: DataFrame, key: list[str], dy: float = 2.0, gap: float = 12.0) -> DataFrame:
    """Pieces of one line joined until nothing joins any more: a page at a time, which bounds the group.

    Two pieces join if their tops are within ``dy`` and the gap between them is at most ``gap``; a joined piece has a new
    extent, so it may reach further ones, which is why one pass is not enough.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["y0", "x0"], ignore_index=True)
        x0, y0, x1, y1, pieces = (pdf[c].to_numpy().copy() for c in ("x0", "y0", "x1", "y1", "pieces"))
        texts, there = [[t] for t in pdf["text"]], np.ones(len(pdf), bool)
        # tops and left edges stay, so a piece that takes no other one never will: each is settled once, in order
        low, high = np.searchsorted(y0, y0 - 2 * dy, "left"), np.searchsorted(y0, y0 + 2 * dy, "right")
        for i in range(len(pdf)):
            near = slice(low[i], high[i])
            while there[i]:
                hit = there[near] & (np.abs(y0[near] - y0[i]) <= dy) & (x0[near] >= x1[i]) & (x0[near] - x1[i] <= gap)
                hit[i - low[i]] = False
                if not hit.any():
                    break
                j = int(low[i] + hit.argmax())
                x1[i], y1[i], pieces[i], there[j] = max(x1[i], x1[j]), max(y1[i], y1[j]), pieces[i] + pieces[j], False
                texts[i] += texts[j]
        return pdf.assign(x1=x1, y1=y1, pieces=pieces, text=[" ".join(t) for t in texts])[there]

    d = df.select(*key, "x0", "y0", "x1", "y1", "text").withColumn("pieces", F.lit(1))
    return d.groupBy(*key).applyInPandas(run, d.schema)


def same_line_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of each page's lines, set in a row with gaps of 4 to 20, joined where the gaps allow."""
    b = boxes(spark, sf_dir)
    w = b.select("doc_id", "page", "y0", "y1", F.posexplode(F.split("text", " ")).alias("i", "text"))
    w = w.withColumn("x0", (F.col("i") * 30).cast("double")).withColumn("x1", F.col("x0") + 10 + F.length("text") % 17)
    m = merged_pieces(w, ["doc_id", "page"])
    return m.groupBy("doc_id", "page").agg(F.count(F.lit(1)).alias("left"), F.sum("pieces").alias("pieces"))


def prepared_glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with three terms or more, the key of their stored glossary (by content), and the key of the listing of
    their candidates, which is looked up where the first is not stored (contents whose digest begins with 8 to f)."""
    d = table(spark, sf_dir, "documents")
    t = mined(d).groupBy("doc_id").agg(F.array_sort(F.collect_list("key")).alias("keys")).where(F.size("keys") >= 3)
    j = t.join(d.select("doc_id", X.digest(F.col("text")).alias("digest")), "doc_id")
    listing = X.cache_key(F.lit("terms"), F.array_join("keys", "\n"))
    return j.select("doc_id", F.size("keys").alias("terms"), F.when(F.substring("digest", 1, 1) < "8", F.col("digest")).otherwise(listing).alias("k"))


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_BOX = f"""{_SEG}, z AS (SELECT *, seg_no % 17 = 0 AS spanning, CASE WHEN seg_no % 17 = 0 THEN 40.0::DOUBLE ELSE 40.0::DOUBLE + (seg_no % 2) * 270 END AS x0 FROM s),
b AS (SELECT doc_id, CAST(seg_no // 40 AS INT) AS page, seg_no AS ord, x0, CAST(60 + (seg_no % 40) * 18 AS DOUBLE) AS y0, CASE WHEN spanning THEN 560.0::DOUBLE ELSE x0 + least(250, length(text)) END AS x1, CAST(74 + (seg_no % 40) * 18 AS DOUBLE) AS y1, CAST(9 + length(text) % 4 AS DOUBLE) AS size, text, spanning FROM z)"""
_NUM = f"{_BOX}, q AS (SELECT doc_id, page, ord, 540.0::DOUBLE + CASE ord % 4 WHEN 0 THEN 0 WHEN 1 THEN page % 2 ELSE ord % 13 * 3 END AS x1, y0 FROM b WHERE ord % 5 <> 3)"
_MASK = lambda c: f"regexp_replace(lower(trim(regexp_replace({c}, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')), '[0-9]+', '#', 'g')"
_CELL = "g AS (SELECT doc_id, page, c AS cell, 40.0::DOUBLE + c % 2 * 270 AS cx0, 50.0::DOUBLE + c // 2 * 90 AS cy0, 300.0::DOUBLE + c % 2 * 270 AS cx1 FROM (SELECT DISTINCT doc_id, page FROM b), unnest(range(18)) AS k(c))"
ORACLE = {
    "format_runs": f"WITH {_BOX}, n AS (SELECT *, CASE WHEN lag(size) OVER w = size THEN 0 ELSE 1 END AS new FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)), r AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY ord) AS BIGINT) AS run FROM n) SELECT doc_id, run, min(size) AS size, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars FROM r GROUP BY doc_id, run",
    "note_groups": f"""WITH {_BOX}, p AS (SELECT *, CAST(y0 - lag(y0) OVER (PARTITION BY doc_id, page, x0 ORDER BY y0) AS INT) AS pitch FROM b WHERE NOT spanning), u AS (SELECT doc_id, first(pitch ORDER BY n DESC, pitch) AS usual FROM (SELECT doc_id, pitch, count(*) AS n FROM p WHERE pitch IS NOT NULL GROUP BY ALL) GROUP BY doc_id),
k AS (SELECT p.*, CAST(sum(CASE WHEN pitch = usual THEN 0 ELSE 1 END) OVER (PARTITION BY p.doc_id, page, x0 ORDER BY y0) AS BIGINT) AS grp FROM p JOIN u USING (doc_id)) SELECT doc_id, page, x0, grp, count(*) AS n, min(ord) AS first FROM k GROUP BY doc_id, page, x0, grp""",
    "region_joins": f"WITH {_BOX}, r AS (SELECT *, CASE WHEN spanning THEN 2 WHEN x0 > 300 THEN 1 ELSE 0 END AS region FROM b), n AS (SELECT *, CASE WHEN coalesce(regexp_matches(lag(text) OVER w, '[.!?]$'), true) THEN 1 ELSE 0 END AS new FROM r WINDOW w AS (PARTITION BY doc_id, region ORDER BY ord)), u AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id, region ORDER BY ord) AS BIGINT) AS unit FROM n) SELECT doc_id, region, unit, count(*) AS n FROM u GROUP BY doc_id, region, unit",
    "number_columns": f"WITH {_NUM}, v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page ORDER BY x1 RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS votes FROM q) SELECT doc_id, page, count(DISTINCT x1) AS edges, max(votes) AS votes FROM v WHERE votes >= 3 GROUP BY doc_id, page",
    "number_cells": f"WITH {_NUM}, v AS (SELECT *, count(*) OVER (PARTITION BY doc_id, page ORDER BY x1 RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) >= 3 AS core FROM q), w AS (SELECT *, bool_or(core) OVER (PARTITION BY doc_id, page, floor(y0 / 36)) AS beside FROM v) SELECT doc_id, ord, core FROM w WHERE core OR beside",
    "voted_right": f"WITH {_NUM}, n AS (SELECT doc_id, page, CAST(round(x1) AS INT) AS edge, count(*) AS n FROM q GROUP BY ALL), v AS (SELECT *, sum(n) OVER (PARTITION BY doc_id, page ORDER BY edge RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS votes, sum(n) OVER (PARTITION BY doc_id, page) AS tot FROM n) SELECT doc_id, page, first(edge ORDER BY votes DESC, edge DESC) AS edge FROM v WHERE votes >= 3 AND votes >= 0.4 * tot GROUP BY doc_id, page",
    "toc_pages": f"""WITH {_BOX}, p AS (SELECT doc_id, page, count(*) % 3 <> 1 AS has, bool_or(length(text) < 30) AS titled FROM b GROUP BY doc_id, page), n AS (SELECT *, CASE WHEN NOT has OR coalesce(NOT lag(has) OVER w, true) THEN 1 ELSE 0 END AS new FROM p WINDOW w AS (PARTITION BY doc_id ORDER BY page)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY page) AS run FROM n)
SELECT doc_id, page, has AND bool_or(titled AND has) OVER (PARTITION BY doc_id, run ORDER BY page) AS contents FROM r""",
    "leaders": f"""WITH {_SEG}, e AS (SELECT doc_id, seg_no, regexp_replace(text, '[ .0-9]+$', '') || CASE WHEN seg_no % 3 = 0 THEN ' ..... ' || (seg_no * 7) ELSE '' END AS entry FROM s)
SELECT doc_id, seg_no, sha1(CASE WHEN regexp_matches(entry, '^(.*?)[ .]{{3,}}([0-9]+)$') THEN regexp_extract(entry, '^(.*?)[ .]{{3,}}([0-9]+)$', 1) ELSE entry END) AS title_sha, regexp_extract(entry, '^(.*?)[ .]{{3,}}([0-9]+)$', 2) AS page FROM e""",
    "shared_lines": f"WITH {_BOX}, n AS (SELECT *, lead(ord) OVER w AS other, lead(y0) OVER w - y0 AS down, lead(x0) OVER w - x1 AS rt FROM b WHERE NOT spanning WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0)) SELECT doc_id, ord, other FROM n WHERE down <= 20 AND rt > 0",
    "next_text_page": f"WITH {_BOX}, p AS (SELECT doc_id, page, bool_or(length(text) >= 80) AS body FROM b GROUP BY doc_id, page) SELECT doc_id, page, coalesce(min(CASE WHEN body THEN page END) OVER (PARTITION BY doc_id ORDER BY page ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), -1) AS next_page FROM p",
    "lone_fonts": f"WITH {_BOX}, n AS (SELECT *, coalesce(lag(size) OVER w <> size, false) OR coalesce(lead(size) OVER w <> size, false) AS beside FROM b WINDOW w AS (PARTITION BY doc_id ORDER BY ord)) SELECT doc_id, size, count(*) AS n FROM n GROUP BY doc_id, size HAVING max(length(text)) <= 60 AND avg(CAST(beside AS INT)) >= 0.5",
    "touching_rules": f"WITH {_BOX}, {_CELL} SELECT b.doc_id, b.page, cell, count(*) AS blocks FROM b JOIN g ON b.doc_id = g.doc_id AND b.page = g.page WHERE y0 - 2 <= cy0 AND y1 + 2 >= cy0 AND x0 <= cx1 AND x1 >= cx0 GROUP BY ALL",
    "box_check": f"""WITH {_BOX}, n AS (SELECT doc_id, ord, x0, y0, x1, y1, (ord % 7) * 6 AS dx, ord % 7 AS dy, ord % 11 <> 5 AS there FROM b), i AS (SELECT *, greatest(0, x1 - x0 - dx) * greatest(0, y1 - y0 - dy) AS both_, (x1 - x0) * (y1 - y0) AS a FROM n)
SELECT doc_id, count(*) AS boxes, count(*) FILTER (there AND both_ / (2 * a - both_) >= 0.5) AS found FROM i GROUP BY doc_id HAVING count(*) FILTER (there AND both_ / (2 * a - both_) >= 0.5) < 0.75 * count(*)""",
    "bookmarks": f"WITH {_SEG}, l AS (SELECT {_MASK('text')} AS k, count(*) AS hits, min(doc_id) AS first_doc FROM s GROUP BY 1) SELECT doc_id, hits, first_doc FROM (SELECT doc_id, {_MASK("replace(text, ' ', '  ')")} AS k FROM s WHERE seg_no = 0) JOIN l USING (k)",
    "foreign_lines": f"""WITH {_SEG}, f AS (SELECT s.doc_id, seg_no, lang, CASE WHEN regexp_matches(s.text, '[ßäöü]') THEN 'de' WHEN regexp_matches(s.text, '[ñóí]') THEN 'es' WHEN regexp_matches(s.text, '[èêçé]') THEN 'fr' END AS bl FROM s JOIN documents d ON s.doc_id = d.doc_id), g AS (SELECT *, CASE WHEN seg_no - lag(seg_no) OVER (PARTITION BY doc_id ORDER BY seg_no) = 1 THEN 0 ELSE 1 END AS new FROM f WHERE bl IS NOT NULL AND bl <> lang),
h AS (SELECT *, CAST(sum(new) OVER (PARTITION BY doc_id ORDER BY seg_no) AS BIGINT) AS grp FROM g) SELECT doc_id, grp, min(seg_no) AS first, count(*) AS n FROM h GROUP BY doc_id, grp""",
}
QUERIES = {
    "format_runs": format_runs, "note_groups": note_groups, "region_joins": region_joins, "number_columns": number_columns, "number_cells": number_cells, "voted_right": voted_right, "toc_pages": toc_pages, "leaders": leaders, "shared_lines": shared_lines, "next_text_page": next_text_page,
    "column_anchors": column_anchors, "numbered_lists": numbered_lists, "lone_fonts": lone_fonts, "touching_rules": touching_rules, "box_check": box_check, "bookmarks": bookmarks, "term_definitions": term_definitions, "same_line_merge": same_line_merge, "prepared_glossary": prepared_glossary, "foreign_lines": foreign_lines,
}
