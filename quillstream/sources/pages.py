"""Web pages as blocks: a tolerant parser as a table function, and a form in SQL expressions for plain markup."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.session import table

#: Elements that hold a text of their own, their kind, and elements whose text is none: fixed by the markup language.
KINDS = {"h1": "h1", "h2": "h2", "h3": "h3", "h4": "h4", "h5": "h5", "h6": "h6", "p": "p", "li": "li", "blockquote": "quote", "td": "td", "th": "td", "dt": "li", "dd": "li", "figcaption": "p", "caption": "p"}
HOLDERS = {"html", "body", "div", "section", "article", "main", "aside", "header", "footer", "nav", "ul", "ol", "table", "tr", "tbody", "thead", "figure", "dl"}
SKIPPED = {"script", "style", "template", "noscript", "head"}
VOID = {"br", "img", "hr", "input", "meta", "link", "wbr", "source", "area", "col", "embed", "track"}


class Blocks(HTMLParser):
    """Leaf blocks in document order, with runs of bare text between blocks; br ends a line, media is a slot."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[tuple[str, str, str]] = []
        self.tag, self.buffer, self.skip, self.media, self.holders = "", [], 0, 0, []

    def _close(self) -> None:
        lines = [" ".join(x.split()) for x in "".join(self.buffer).split("\n")]
        text = "\n".join(lines).strip("\n")
        if any(c.isalpha() for c in text):
            kind = KINDS.get(self.tag, "p")
            self.found.append((self.tag or "text", "toc" if "nav" in self.holders else kind, text))
        self.tag, self.buffer, self.media = "", [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in SKIPPED:
            self.skip += 1
        elif tag in KINDS or tag in HOLDERS:
            self._close()
            if tag in KINDS:
                self.tag = tag
            else:
                self.holders.append(tag)
        elif tag == "br":
            self.buffer.append("\n")
        elif tag in ("img", "video", "audio", "svg", "math") and not self.skip:
            self.buffer.append(f"{{v{self.media}}}")
            self.media += 1

    def handle_endtag(self, tag: str) -> None:
        if tag in SKIPPED:
            self.skip = max(0, self.skip - 1)
        elif tag in KINDS or tag in HOLDERS:
            self._close()
            if tag in self.holders:
                while self.holders.pop() != tag:
                    pass

    def handle_data(self, data: str) -> None:
        if not self.skip:
            self.buffer.append(data if not data.isspace() else " ")

    def blocks(self, html: str) -> list[tuple[str, str, str]]:
        self.feed(html)
        self.close()
        self._close()
        return self.found


def page_blocks(pages: DataFrame) -> DataFrame:
    """page_id, ord, tag, kind, text of every page. Whole pages go to Arrow batches of the parser, one batch at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(i, k, *x) for i, h in zip(b["page_id"], b["html"], strict=True) for k, x in enumerate(Blocks().blocks(h or ""))]
            yield pd.DataFrame(rows, columns=["page_id", "ord", "tag", "kind", "text"])

    return pages.select("page_id", "html").mapInPandas(run, "page_id long, ord int, tag string, kind string, text string")


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_blocks(table(spark, sf_dir, "pages"))


def html_kind_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = page_blocks(table(spark, sf_dir, "pages"))
    return b.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page_id").alias("pages"))


def nav_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of each page in order: href and label, tags and entities aside."""
    p = table(spark, sf_dir, "pages")
    links = F.regexp_extract_all("html", F.lit(r"(?s)(<a\s[^>]*>[^<]*</a>)"), F.lit(1))
    x = p.select("page_id", F.posexplode(links).alias("ord", "a"))
    return x.select("page_id", "ord", F.regexp_extract("a", 'href="([^"]*)"', 1).alias("href"), X.squeeze(F.regexp_extract("a", "(?s)>([^<]*)<", 1)).alias("label"))


def flat_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings, paragraphs and items of each page by expressions alone: scripts, styles and comments out, then tags."""
    p = table(spark, sf_dir, "pages")
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), r"(?s)<!--.*?-->", " ")
    found = F.regexp_extract_all(body, F.lit(r"(?is)(<(?:h[1-6]|p|li)[\s>].*?</(?:h[1-6]|p|li)>)"), F.lit(1))
    x = p.select("page_id", F.posexplode(found).alias("ord", "b"))
    text = X.squeeze(F.regexp_replace("b", "(?s)<[^>]*>", " "))
    return x.select("page_id", "ord", F.lower(F.regexp_extract("b", r"^<([A-Za-z0-9]+)", 1)).alias("tag"), F.sha1(text.cast("binary")).alias("text_sha"))


def page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages by host, and whether an address is one that a page may not link to (scripts, data)."""
    p = table(spark, sf_dir, "pages")
    return p.groupBy(F.lower(F.regexp_extract("url", r"^[a-z]+://([^/:?#]+)", 1)).alias("host")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.lower("url").rlike("^(javascript|vbscript|data):")).alias("unsafe"))


def docs_toc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headings of pages with their parent: the nearest heading before with a smaller level."""
    h = page_blocks(table(spark, sf_dir, "pages")).where("kind rlike '^h[1-6]$'").select("page_id", "ord", F.substring("kind", 2, 1).cast("int").alias("level"))
    return nearest_smaller(h, ["page_id"], "ord", "level")


def nearest_smaller(df: DataFrame, key: list[str], order: str, value: str, levels: int = 6) -> DataFrame:
    """parent: the nearest row before with a smaller value. For values 1 to ``levels``, the last row of each smaller value
    is a running maximum, so one ordered window does it; a plain last() would not."""
    w = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    parent = F.lit(None).cast(df.schema[order].dataType)
    for v in range(2, levels + 1):
        parent = F.when(F.col(value) == v, F.max(F.when(F.col(value) < v, F.col(order))).over(w)).otherwise(parent)
    return df.withColumn("parent", parent)


ORACLE = {
    "nav_labels": """WITH a AS (SELECT page_id, regexp_extract_all(html, '(?s)(<a\\s[^>]*>[^<]*</a>)', 1) AS l FROM pages), x AS (SELECT page_id, i - 1 AS ord, l[i] AS a FROM a, unnest(range(1, len(l) + 1)) AS r(i))
SELECT page_id, ord, regexp_extract(a, 'href="([^"]*)"', 1) AS href, trim(regexp_replace(regexp_extract(a, '(?s)>([^<]*)<', 1), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ') AS label FROM x""",
    "flat_blocks": """WITH b AS (SELECT page_id, regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g') AS h FROM pages), f AS (SELECT page_id, regexp_extract_all(h, '(?is)(<(?:h[1-6]|p|li)[\\s>].*?</(?:h[1-6]|p|li)>)', 1) AS l FROM b), x AS (SELECT page_id, i - 1 AS ord, l[i] AS b FROM f, unnest(range(1, len(l) + 1)) AS r(i))
SELECT page_id, ord, lower(regexp_extract(b, '^<([A-Za-z0-9]+)', 1)) AS tag, sha1(trim(regexp_replace(regexp_replace(b, '(?s)<[^>]*>', ' ', 'g'), '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS text_sha FROM x""",
    "page_hosts": "SELECT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS host, count(*) AS n, count(*) FILTER (regexp_matches(lower(url), '^(javascript|vbscript|data):')) AS unsafe FROM pages GROUP BY 1",
}
QUERIES = {"html_blocks": html_blocks, "html_kind_counts": html_kind_counts, "nav_labels": nav_labels, "flat_blocks": flat_blocks, "page_hosts": page_hosts, "docs_toc": docs_toc}
