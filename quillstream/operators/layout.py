"""Geometry and graph operators on boxes: columns, reading order, overlap matching, suppression, components, votes.

Boxes are derived from the documents' words where a query needs a table: word i of line j stands at a place computed
from its length, so both engines get the same page.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.operators.relational import merge_intervals
from quillstream.operators.segments import segments
from quillstream.session import settle, table


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page, ord, x0, y0, x1, y1, size, text: lines as blocks in two columns, every 17th one across the page."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("page", F.floor(F.col("seg_no") / 40).cast("int"))
    k, wide = F.col("seg_no") % 40, F.col("seg_no") % 17 == 0
    col = F.when(wide, 0).otherwise(F.col("seg_no") % 2)
    x0 = F.when(wide, 40).otherwise(40 + col * 270).cast("double")
    return s.select("doc_id", "page", F.col("seg_no").alias("ord"), x0.alias("x0"), (60 + k * 18).cast("double").alias("y0"), F.when(wide, F.lit(560.0)).otherwise(x0 + F.least(F.lit(250), F.length("text"))).alias("x1"), (74 + k * 18).cast("double").alias("y1"), (9 + F.length("text") % 4).cast("double").alias("size"), "text", wide.alias("spanning"))


def area(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.greatest(x1 - x0, F.lit(0.0)) * F.greatest(y1 - y0, F.lit(0.0))


def overlap(a: str, b: str) -> Column:
    """Area that the boxes with the column prefixes a and b share."""
    c = lambda p, n: F.col(f"{p}{n}")
    return area(F.greatest(c(a, "x0"), c(b, "x0")), F.greatest(c(a, "y0"), c(b, "y0")), F.least(c(a, "x1"), c(b, "x1")), F.least(c(a, "y1"), c(b, "y1")))


def iou(a: str, b: str) -> Column:
    both = overlap(a, b)
    total = area(*[F.col(f"{a}{n}") for n in ("x0", "y0", "x1", "y1")]) + area(*[F.col(f"{b}{n}") for n in ("x0", "y0", "x1", "y1")])
    return F.when(total - both > 0, both / (total - both)).otherwise(0.0)


def reading_order(df: DataFrame, key: list[str]) -> DataFrame:
    """Bands between spanning separators; in a band by column, then down and across; a separator closes its band."""
    above = Window.partitionBy(*key).orderBy("y0", "ord").rowsBetween(Window.unboundedPreceding, -1)
    d = df.withColumn("band", F.coalesce(F.count_if("spanning").over(above), F.lit(0)))
    column = F.when(F.col("spanning"), 0).otherwise((F.col("x0") > 300).cast("int"))
    w = Window.partitionBy(*key).orderBy("band", F.col("spanning").cast("int"), column, "y0", "x0", "ord")
    return d.withColumn("place", F.row_number().over(w))


def q_reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reading_order(boxes(spark, sf_dir), ["doc_id", "page"]).select("doc_id", "ord", "band", "place")


def gutters(spark: SparkSession, sf_dir: str, least: float = 12.0, support: int = 3) -> DataFrame:
    """Gaps of at least 12 between the merged x ranges of a page's narrow blocks, with 3 or more blocks on both sides."""
    b = boxes(spark, sf_dir).where("NOT spanning")
    u = merge_intervals(b.select("doc_id", "page", "x0", "x1"), ["doc_id", "page"], "x0", "x1")
    w = Window.partitionBy("doc_id", "page").orderBy("x0")
    run, total = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(Window.partitionBy("doc_id", "page"))
    g = u.withColumn("right_", F.lead("x0").over(w)).withColumn("before", run).withColumn("after", total - run)
    return g.where((F.col("right_") - F.col("x1") >= least) & (F.col("before") >= support) & (F.col("after") >= support)).select("doc_id", "page", F.col("x1").alias("gap_start"), F.col("right_").alias("gap_end"))


def detections(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Box sets of two models: the second shifts every box by its length's remainder and loses each 11th."""
    b = boxes(spark, sf_dir).select("doc_id", "page", "ord", "x0", "y0", "x1", "y1", F.when(F.col("spanning"), "title").otherwise("text").alias("class"))
    if which == "ref":
        return b
    shift = (F.col("ord") % 7).cast("double")
    return b.where("ord % 11 <> 5").withColumns({"x0": F.col("x0") + shift * 6, "x1": F.col("x1") + shift * 6, "y0": F.col("y0") + shift, "y1": F.col("y1") + shift})


def iou_match(spark: SparkSession, sf_dir: str, least: float = 0.5) -> DataFrame:
    """One-to-one matches of two box sets by class with IoU of at least one half, per class and over all.

    Candidates meet on (document, page, class, cell of height 64), a box in each cell that it touches, so no page is
    crossed with itself; a match is mutual: each is the other's best.
    """
    cells = lambda d: d.withColumn("cell", F.explode(F.sequence(F.floor(F.col("y0") / 64), F.floor(F.col("y1") / 64))))
    ren = lambda d, p: d.select("doc_id", "page", "class", F.col("ord").alias(f"{p}ord"), *[F.col(c).alias(f"{p}{c}") for c in ("x0", "y0", "x1", "y1")])
    a, b = detections(spark, sf_dir, "ref"), detections(spark, sf_dir, "new")
    pairs = cells(ren(a, "a_").withColumnsRenamed({"a_y0": "y0", "a_y1": "y1"})).withColumnsRenamed({"y0": "a_y0", "y1": "a_y1"})
    other = cells(ren(b, "b_").withColumnsRenamed({"b_y0": "y0", "b_y1": "y1"})).withColumnsRenamed({"y0": "b_y0", "y1": "b_y1"})
    both = pairs.join(other, ["doc_id", "page", "class", "cell"]).withColumn("iou", iou("a_", "b_")).where(F.col("iou") >= least)
    both = both.select("doc_id", "page", "class", "a_ord", "b_ord", "iou").distinct()
    best = lambda k, o: F.row_number().over(Window.partitionBy("doc_id", "page", "class", k).orderBy(F.col("iou").desc(), o))
    matched = both.withColumn("ra", best("a_ord", "b_ord")).withColumn("rb", best("b_ord", "a_ord")).where("ra = 1 AND rb = 1")
    n = a.select("class", F.lit(1).alias("ref"), F.lit(0).alias("new"), F.lit(0).alias("m")).unionAll(b.select("class", F.lit(0), F.lit(1), F.lit(0))).unionAll(matched.select("class", F.lit(0), F.lit(0), F.lit(1)))
    return n.rollup("class").agg(F.sum("ref").alias("ref"), F.sum("m").alias("matched"), (F.sum("new") - F.sum("m")).alias("extra"))


def suppressed(df: DataFrame, key: list[str], most: float = 0.45) -> DataFrame:
    """Greedy non-maximum suppression by key: boxes in order of score, each kept if no kept one overlaps it by more."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "ord"], ascending=[False, True])
        x = pdf[["x0", "y0", "x1", "y1"]].to_numpy()
        size = (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
        kept: list[int] = []
        for i in range(len(x)):
            k = x[kept]
            w = np.minimum(k[:, 2], x[i, 2]) - np.maximum(k[:, 0], x[i, 0]) if kept else np.zeros(0)
            h = np.minimum(k[:, 3], x[i, 3]) - np.maximum(k[:, 1], x[i, 1]) if kept else np.zeros(0)
            both = np.maximum(w, 0) * np.maximum(h, 0)
            if not (both / (size[kept] + size[i] - both) > most).any():
                kept.append(i)
        return pdf.iloc[kept]

    return df.groupBy(*key).applyInPandas(run, df.schema)  # a page's boxes: a bounded group


def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = detections(spark, sf_dir, "ref").unionByName(detections(spark, sf_dir, "new"))
    b = b.withColumn("score", ((F.col("ord") * 37 + F.col("x0").cast("int")) % 101).cast("double") / 101)
    return suppressed(b.select("doc_id", "page", "class", "ord", "x0", "y0", "x1", "y1", "score"), ["doc_id", "page", "class"]).select("doc_id", "class", "ord", "score")


def column_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each block the column that holds its middle, else the nearest one."""
    b = boxes(spark, sf_dir).where("NOT spanning")
    cols = [(40.0, 290.0), (310.0, 560.0)]
    mid = (F.col("x0") + F.col("x1")) / 2
    dist = [F.greatest(F.lit(lo) - mid, mid - F.lit(hi), F.lit(0.0)) for lo, hi in cols]
    best = F.array_min(F.array(*[F.struct(d.alias("d"), F.lit(i).alias("i")) for i, d in enumerate(dist)]))["i"]
    return b.groupBy("doc_id", "page", best.alias("col")).agg(F.count(F.lit(1)).alias("n"))


def weighted_mode_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The size with the most characters of each document; ties to the smaller."""
    b = boxes(spark, sf_dir).groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("chars"))
    return b.groupBy("doc_id").agg(F.min_by("size", F.struct((-F.col("chars")).alias("n"), F.col("size"))).alias("size"), F.max("chars").alias("chars"))


def edge_votes(spark: SparkSession, sf_dir: str, tol: int = 2, least: int = 3) -> DataFrame:
    """Right edges of a document by the votes of edges within ``tol``; the outermost with half of the best support."""
    b = boxes(spark, sf_dir).where("NOT spanning").groupBy("doc_id", F.round("x1").cast("int").alias("edge")).agg(F.count(F.lit(1)).alias("n"))
    near = Window.partitionBy("doc_id").orderBy("edge").rangeBetween(-tol, tol)
    v = b.withColumn("votes", F.sum("n").over(near)).withColumn("best", F.max("votes").over(Window.partitionBy("doc_id")))
    return v.where((F.col("votes") >= least) & (2 * F.col("votes") >= F.col("best"))).groupBy("doc_id").agg(F.max("edge").alias("edge"), F.max_by("edge", F.struct("votes", "edge")).alias("favourite"))


def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that look like headings: short, and 1.3 times the document's weighted median size, or 1.15 times if numbered."""
    b = boxes(spark, sf_dir)
    w = Window.partitionBy("doc_id").orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    sums = b.groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n")).withColumn("run", F.sum("n").over(w)).withColumn("all_", F.sum("n").over(Window.partitionBy("doc_id")))
    median = sums.where("2 * run >= all_").groupBy("doc_id").agg(F.min("size").alias("median"))
    big = (F.col("size") >= 1.3 * F.col("median")) | ((F.col("size") >= 1.15 * F.col("median")) & (F.col("ord") % 5 == 0))
    return b.join(median, "doc_id").where((F.length("text") < 100) & big).select("doc_id", "ord", "size", "median")


def row_clusters(df: DataFrame, key: list[str], tol: float = 4.0) -> DataFrame:
    """Rows of words, from the top: a word within ``tol`` of its row's FIRST word joins it. Adds row_no.

    The anchor makes this a fold, not a matter of gaps; it runs over a page's ordered tops, in the executor's JVM.
    """
    tops = df.groupBy(*key).agg(F.array_sort(F.collect_set("y0")).alias("ys"))
    start = F.struct(F.array().cast("array<double>").alias("a"))
    step = lambda s, y: F.struct(F.when((F.size(s["a"]) == 0) | (y - F.coalesce(F.get(s["a"], F.size(s["a"]) - 1), F.lit(-1e18)) > tol), F.array_append(s["a"], y)).otherwise(s["a"]).alias("a"))
    rows = tops.select(*key, F.posexplode(F.aggregate("ys", start, step)["a"]).alias("row_no", "top"))
    w = Window.partitionBy(*key).orderBy("top")
    spans = rows.withColumn("next_", F.lead("top").over(w))
    d = df.join(spans, key).where((F.col("y0") >= F.col("top")) & (F.col("next_").isNull() | (F.col("y0") < F.col("next_"))))
    return d.drop("top", "next_")


def word_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of each page's words: a cell ends where the next word is more than 8 away."""
    b = boxes(spark, sf_dir)
    w = b.select("doc_id", "page", "ord", F.posexplode(F.split("text", " ")).alias("i", "word"), "x0", "y0")
    w = w.withColumn("x0", F.col("x0") + F.col("i") * 20).withColumn("x1", F.col("x0") + 8 + F.length("word") % 9).withColumn("y0", F.col("y0") + F.col("i") % 3)
    r = row_clusters(w, ["doc_id", "page"])
    o = Window.partitionBy("doc_id", "page", "row_no").orderBy("x0", "ord", "i")
    r = r.withColumn("cut", (F.col("x0") - F.lag("x1").over(o) > 8).cast("int"))
    return r.groupBy("doc_id", "page", "row_no").agg(F.count(F.lit(1)).alias("words"), (F.sum(F.coalesce("cut", F.lit(0))) + 1).alias("cells"))


def connected(edges: DataFrame, most: int = 50) -> DataFrame:
    """(node, component) by minimum labels along edges, with a jump to the label's label each round.

    Each round is checkpointed to the shared folder; the driver only sees whether a label changed.
    """
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a")).distinct()
    label = settle(both.select(F.col("u").alias("node")).distinct().withColumn("label", F.col("node")))
    for _ in range(most):
        low = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("label").alias("low"))
        near = label.join(low.withColumnRenamed("u", "node"), "node").select("node", F.least("label", "low").alias("label"), F.col("label").alias("old"))
        jump = near.select(F.col("node").alias("label"), F.col("label").alias("up"))
        new = settle(near.join(jump, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "old"))
        done = new.where("label <> old").limit(1).count() == 0
        label = new.select("node", "label")
        if done:
            return label.withColumnRenamed("label", "component")
    raise RuntimeError("labels did not settle")


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders connected by the same customer's next order; the table names no clerk. A customer's only order has no edge."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    e = o.select(F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(w).alias("b")).where("b IS NOT NULL")
    return connected(e)


def merged_to_fixpoint(objects: DataFrame, most: int = 60) -> DataFrame:
    """(obj, class) of objects (obj, body, ref): what repeating "merge equal objects, point references at the first" ends in.

    At the end two objects are one if their bodies and those of all that they refer to, in turn, are equal. A round takes
    a digest of twice as many of those, so a chain of n references takes log2 n rounds; ``body`` is a digest already. A
    reference to what is no object counts as it stands. ``most`` is reached only by references that go round.
    """
    o = settle(objects.select("obj", "body", "ref"))
    for _ in range(most):
        going = o.where("ref IS NOT NULL")
        if going.limit(1).count() == 0:
            return o.select("obj", F.col("body").alias("class"))
        to = o.select(F.col("obj").alias("ref"), F.col("body").alias("rest"), F.col("ref").alias("next_"))
        both = F.sha1(F.concat_ws("\n", F.lit(""), "body", F.coalesce("rest", F.col("ref").cast("string"))).cast("binary"))
        o = settle(o.where("ref IS NULL").unionByName(going.join(to, "ref", "left").select("obj", both.alias("body"), F.col("next_").alias("ref"))))
    raise RuntimeError("references go round")


def fixpoint_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges equal objects, points references at the first, and repeats until nothing merges: the kept ones, with counts.

    Objects are the lines of documents (by text); each refers to the line before it. A merge makes further pairs equal.
    """
    s = segments(table(spark, sf_dir, "documents")).withColumn("obj", F.col("doc_id") * (1 << 31) + F.col("seg_no"))
    o = s.select("obj", F.sha1(F.col("text").cast("binary")).alias("body"), F.lag("obj").over(Window.partitionBy("doc_id").orderBy("seg_no")).alias("ref"))
    return merged_to_fixpoint(o).groupBy("class").agg(F.min("obj").alias("rep"), F.count(F.lit(1)).alias("n")).drop("class")


_SEG = "s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')"
_BOX = f"""{_SEG}, z AS (SELECT *, seg_no % 17 = 0 AS spanning, CASE WHEN seg_no % 17 = 0 THEN 40.0::DOUBLE ELSE 40.0::DOUBLE + (seg_no % 2) * 270 END AS x0 FROM s),
b AS (SELECT doc_id, CAST(seg_no // 40 AS INT) AS page, seg_no AS ord, x0, CAST(60 + (seg_no % 40) * 18 AS DOUBLE) AS y0, CASE WHEN spanning THEN 560.0::DOUBLE ELSE x0 + least(250, length(text)) END AS x1, CAST(74 + (seg_no % 40) * 18 AS DOUBLE) AS y1, CAST(9 + length(text) % 4 AS DOUBLE) AS size, text, spanning FROM z)"""
_DET = f"{_BOX}, ra AS (SELECT doc_id, page, ord, x0, y0, x1, y1, CASE WHEN spanning THEN 'title' ELSE 'text' END AS class FROM b), nb AS (SELECT doc_id, page, ord, x0 + (ord % 7) * 6 AS x0, y0 + ord % 7 AS y0, x1 + (ord % 7) * 6 AS x1, y1 + ord % 7 AS y1, class FROM ra WHERE ord % 11 <> 5)"
ORACLE = {
    "reading_order": f"WITH {_BOX}, d AS (SELECT *, coalesce(count(*) FILTER (spanning) OVER (PARTITION BY doc_id, page ORDER BY y0, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS band FROM b) SELECT doc_id, ord, band, row_number() OVER (PARTITION BY doc_id, page ORDER BY band, spanning, CASE WHEN spanning THEN 0 WHEN x0 > 300 THEN 1 ELSE 0 END, y0, x0, ord) AS place FROM d",
    "gutters": f"""WITH {_BOX}, m AS (SELECT doc_id, page, x0, x1, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM b WHERE NOT spanning), g AS (SELECT *, count(*) FILTER (r IS NULL OR x0 > r) OVER (PARTITION BY doc_id, page ORDER BY x0, x1 ROWS UNBOUNDED PRECEDING) AS k FROM m),
u AS (SELECT doc_id, page, k, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM g GROUP BY ALL), v AS (SELECT *, lead(x0) OVER w AS nx, sum(n) OVER (PARTITION BY doc_id, page ORDER BY x0 ROWS UNBOUNDED PRECEDING) AS bef, sum(n) OVER (PARTITION BY doc_id, page) AS tot FROM u WINDOW w AS (PARTITION BY doc_id, page ORDER BY x0))
SELECT doc_id, page, x1 AS gap_start, nx AS gap_end FROM v WHERE nx - x1 >= 12 AND bef >= 3 AND tot - bef >= 3""",
    "iou_match": f"""WITH {_DET}, p AS (SELECT ra.doc_id, ra.page, ra.class, ra.ord AS a, nb.ord AS b, greatest(0, least(ra.x1, nb.x1) - greatest(ra.x0, nb.x0)) * greatest(0, least(ra.y1, nb.y1) - greatest(ra.y0, nb.y0)) AS i, (ra.x1 - ra.x0) * (ra.y1 - ra.y0) + (nb.x1 - nb.x0) * (nb.y1 - nb.y0) AS t FROM ra JOIN nb ON ra.doc_id = nb.doc_id AND ra.page = nb.page AND ra.class = nb.class),
q AS (SELECT *, i / (t - i) AS iou FROM p WHERE i / (t - i) >= 0.5), m AS (SELECT * FROM q QUALIFY row_number() OVER (PARTITION BY doc_id, page, class, a ORDER BY iou DESC, b) = 1 AND row_number() OVER (PARTITION BY doc_id, page, class, b ORDER BY iou DESC, a) = 1),
n AS (SELECT class, 1 AS ref, 0 AS new, 0 AS m FROM ra UNION ALL SELECT class, 0, 1, 0 FROM nb UNION ALL SELECT class, 0, 0, 1 FROM m) SELECT class, CAST(sum(ref) AS BIGINT) AS ref, CAST(sum(m) AS BIGINT) AS matched, CAST(sum(new) - sum(m) AS BIGINT) AS extra FROM n GROUP BY ROLLUP (class)""",
    "column_of": f"WITH {_BOX}, c AS (SELECT doc_id, page, (x0 + x1) / 2 AS m FROM b WHERE NOT spanning) SELECT doc_id, page, CASE WHEN greatest(40 - m, m - 290, 0) <= greatest(310 - m, m - 560, 0) THEN 0 ELSE 1 END AS col, count(*) AS n FROM c GROUP BY ALL",
    "weighted_mode_size": f"WITH {_BOX}, c AS (SELECT doc_id, size, CAST(sum(length(text)) AS BIGINT) AS n FROM b GROUP BY ALL) SELECT doc_id, first(size ORDER BY n DESC, size) AS size, max(n) AS chars FROM c GROUP BY doc_id",
    "edge_votes": f"WITH {_BOX}, e AS (SELECT doc_id, CAST(round(x1) AS INT) AS edge, count(*) AS n FROM b WHERE NOT spanning GROUP BY ALL), v AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY edge RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS votes FROM e), w AS (SELECT *, max(votes) OVER (PARTITION BY doc_id) AS best FROM v) SELECT doc_id, max(edge) AS edge, first(edge ORDER BY votes DESC, edge DESC) AS favourite FROM w WHERE votes >= 3 AND 2 * votes >= best GROUP BY doc_id",
    "headings": f"WITH {_BOX}, c AS (SELECT doc_id, size, sum(length(text)) AS n FROM b GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY doc_id ORDER BY size) AS run, sum(n) OVER (PARTITION BY doc_id) AS tot FROM c), m AS (SELECT doc_id, min(size) AS median FROM r WHERE 2 * run >= tot GROUP BY doc_id) SELECT doc_id, ord, size, median FROM b JOIN m USING (doc_id) WHERE length(text) < 100 AND (size >= 1.3 * median OR (size >= 1.15 * median AND ord % 5 = 0))",
    "components": "SELECT o_orderkey AS node, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1",
}
QUERIES = {
    "reading_order": q_reading_order, "gutters": gutters, "iou_match": iou_match, "nms": nms, "column_of": column_of, "weighted_mode_size": weighted_mode_size, "edge_votes": edge_votes, "headings": headings, "word_rows": word_rows,
    "components": components, "fixpoint_dedup": fixpoint_dedup,
}
