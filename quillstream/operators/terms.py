"""Term mining, coverage pruning and glossary joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, IntegerType, LongType, StringType, StructField, StructType

from quillstream.functions import text as X
from quillstream.functions.mining import runs_of_batches
from quillstream.operators.segments import segments
from quillstream.session import numbered, small, table

#: Words that no term begins, ends or is made of: short function words of the languages at hand.
STOP = ("a", "an", "and", "are", "as", "at", "be", "by", "de", "der", "des", "die", "du", "el", "en", "et", "for", "from", "in", "is", "it", "la", "le", "les", "los", "of", "on", "or", "que", "the", "this", "to", "und", "un", "une", "was", "with")
#: Times a term must occur: several words, one capitalised word, one plain word.
LEAST_MANY, LEAST_CAPITAL, LEAST_PLAIN = 3, 2, 6


def mined(docs: DataFrame) -> DataFrame:
    """doc_id, key, surface, words, cnt, capital, score of the terms above their thresholds.

    Terms are runs of 1 to 4 words within a clause, without stop words or repeated words; acronyms stand alone only. The
    surface is the most frequent form that begins with a small letter, else the most frequent; ties by text. Documents are
    dealt by id once, and the runs of a document are counted where it is.
    """
    dealt = docs.where("text IS NOT NULL").select("doc_id", "text").repartition("doc_id").sortWithinPartitions("doc_id")
    of_id = dealt.schema["doc_id"].dataType
    fields = StructType([StructField("doc_id", of_id)] + [StructField(n, t) for n, t in (("key", StringType()), ("surface", StringType()), ("words", IntegerType()), ("cnt", LongType()), ("capital", BooleanType()))])
    arrow, stop, least = to_arrow_schema(fields), frozenset(STOP), (LEAST_MANY, LEAST_CAPITAL, LEAST_PLAIN)
    terms = dealt.mapInArrow(lambda batches: runs_of_batches(batches, arrow, stop, least), fields)
    weight = F.when(F.col("words") > 1, F.lit(1.5)).when(F.col("capital"), F.lit(1.0)).otherwise(F.lit(0.5))
    return terms.withColumn("score", F.col("cnt") * weight * F.col("words"))


def pruned(terms: DataFrame, share: float = 0.8) -> DataFrame:
    """Drops a term if a longer one of the document holds its words and has at least 80 % of its count.

    Longer keys are expanded to their runs of words and meet the terms of these on equality, instead of comparing all pairs;
    a term is among its own runs, so the terms are made and dealt once. A document has a key once.
    """
    w = F.split("key", " ")
    runs = F.flatten(F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.transform(F.sequence(F.lit(1), F.size(w) - i + 1), lambda n: F.array_join(F.slice(w, i, n), " "))))
    each = terms.select(F.struct("*").alias("term"), F.explode(F.when(F.col("words") > 1, F.array_distinct(runs)).otherwise(F.array("key"))).alias("run"))
    own = F.col("run") == F.col("term.key")
    longer = F.max(F.when(~own & F.col("term.doc_id").isNotNull(), F.col("term.cnt"))).alias("longer")
    met = each.groupBy(F.col("term.doc_id").alias("doc_id"), "run").agg(longer, F.first(F.when(own, F.col("term")), ignorenulls=True).alias("term"))
    return met.where(F.col("term").isNotNull() & (F.col("longer").isNull() | (F.col("longer") < share * F.col("term.cnt")))).select("term.*")


def ranked(terms: DataFrame, most: int = 80) -> DataFrame:
    w = Window.partitionBy("doc_id").orderBy(F.col("score").desc(), X.lower(F.col("surface")), "key")
    return terms.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(mined(table(spark, sf_dir, "documents"))).select("doc_id", "rank", "surface", "cnt", "score")


def terms_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(pruned(mined(table(spark, sf_dir, "documents")))).select("doc_id", "rank", "surface")


def common_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of at most four letters in 30 % or more of the lines of a document with at least 20 lines."""
    s = segments(table(spark, sf_dir, "documents"))
    size = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines")).where("lines >= 20")
    w = s.select("doc_id", "seg_no", F.explode(F.array_distinct(F.regexp_extract_all(X.lower(F.col("text")), F.lit(r"\p{L}+"), F.lit(0)))).alias("word")).where("length(word) <= 4")
    return w.groupBy("doc_id", "word").agg(F.count(F.lit(1)).alias("n")).join(size, "doc_id").where("n >= 0.3 * lines").select("doc_id", "word", "n", "lines")


def glossary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A glossary made of the data: the mined terms of several words, those of the most documents first; a user's entries
    (prio 0) over candidates (1)."""
    t = mined(table(spark, sf_dir, "documents")).where("words > 1").groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.min("surface").alias("source"))
    t = numbered(t, F.col("docs").desc(), F.col("key"))
    both = t.select("source", X.upper(F.col("source")).alias("target"), F.lit(1).alias("prio"), "ord").unionByName(t.where("ord % 3 = 0").select(X.upper(F.col("source")).alias("source"), F.lit("user").alias("target"), F.lit(0).alias("prio"), "ord"))
    first = F.row_number().over(Window.partitionBy(X.lower(F.col("source"))).orderBy("prio", "ord"))
    return both.withColumn("_n", first).where("_n = 1").drop("_n")


def glossary_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return glossary(spark, sf_dir).select("source", "target", "prio")


def mentions_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(doc_id, term) of the terms (in lower case, of two to four words) that a document holds as whole words, plurals included.

    Texts are cut into stretches of words with one space between them, and every word meets the terms that begin with it;
    the words after it decide. So neither texts nor patterns travel, and a small glossary (its rows are counted) costs no
    shuffle of the words at all.
    """
    t = F.split("term", " ")
    g = terms.select("term", t[0].alias("first"), F.slice(t, 2, 3).alias("next"), F.size(t).alias("n"))
    g = g.where("n between 2 and 4")
    stretches = docs.select("doc_id", F.explode(F.split(X.lower(F.col("text")), r"[^\p{L}\p{N} ]+|  +")).alias("s"))
    rows = stretches.select("doc_id", F.inline(X.windows_of(F.split(F.trim("s"), " ")))).where("w1 IS NOT NULL")
    pairs = rows.join(small(g), F.col("w0") == F.col("first"))
    after = [F.col("w1"), F.col("w2"), F.col("w3")]
    hit = F.lit(False)
    for n in (2, 3, 4):
        inner = F.lit(True)
        for k in range(n - 2):
            inner = inner & (after[k] == F.get("next", F.lit(k)))
        hit = F.when(F.col("n") == n, inner & X.is_form_of(after[n - 2], F.get("next", F.lit(n - 2)))).otherwise(hit)
    return pairs.where(F.coalesce(hit, F.lit(False))).select("doc_id", "term").distinct()


def glossary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, term) of the glossary entries that a document mentions as whole words, plurals included."""
    return mentions_of(table(spark, sf_dir, "documents"), glossary(spark, sf_dir).select(X.lower(F.col("source")).alias("term")).distinct())


_STOP = ", ".join(f"'{w}'" for w in STOP)
_FOLD = """CASE WHEN NOT contains(surface, ' ') AND len(regexp_extract_all(surface, '\\p{L}')) >= 2 AND len(regexp_extract_all(surface, '\\p{Lu}')) >= 2 THEN surface
 WHEN length(string_split(lower(surface), ' ')[-1]) > 4 AND lower(surface) LIKE '%ies' THEN substring(lower(surface), 1, length(surface) - 3) || 'y'
 WHEN length(string_split(lower(surface), ' ')[-1]) > 3 AND lower(surface) LIKE '%s' AND lower(surface) NOT LIKE '%ss' THEN substring(lower(surface), 1, length(surface) - 1) ELSE lower(surface) END"""
_MINED = f"""c AS (SELECT doc_id, regexp_extract_all(clause, '\\p{{L}}[\\p{{L}}\\p{{N}}]*') AS w FROM (SELECT doc_id, unnest(regexp_split_to_array(line, '[.,;:!?()|"]+')) AS clause FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents))),
g AS (SELECT doc_id, w[i:i + n - 1] AS g FROM c, unnest(range(1, len(w) + 1)) AS a(i), unnest(range(1, 5)) AS b(n) WHERE i + n - 1 <= len(w)),
ok AS (SELECT doc_id, array_to_string(g, ' ') AS surface, len(g) AS words FROM g WHERE len(list_filter(g, lambda x: lower(x) IN ({_STOP}))) = 0 AND len(list_distinct(list_transform(g, lambda x: lower(x)))) = len(g)
 AND (len(g) = 1 OR len(list_filter(g, lambda x: len(regexp_extract_all(x, '\\p{{L}}')) >= 2 AND len(regexp_extract_all(x, '\\p{{Lu}}')) >= 2)) = 0)),
f AS (SELECT doc_id, {_FOLD} AS key, surface, words, count(*) AS n, substring(surface, 1, 1) = lower(substring(surface, 1, 1)) AS small FROM ok GROUP BY ALL),
t AS (SELECT doc_id, key, first(surface ORDER BY NOT small, n DESC, surface) AS surface, max(words) AS words, CAST(sum(n) AS BIGINT) AS cnt, bool_and(NOT small) AS capital FROM f GROUP BY doc_id, key),
m AS (SELECT *, cnt * CASE WHEN words > 1 THEN 1.5::DOUBLE WHEN capital THEN 1.0 ELSE 0.5 END * words AS score FROM t WHERE cnt >= CASE WHEN words > 1 THEN 3 WHEN capital THEN 2 ELSE 6 END AND length(key) > 1)"""
_RANK = "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lower(surface), key) AS rank FROM"
_GLOS = f"""{_MINED}, k AS (SELECT key, count(*) AS docs, min(surface) AS source FROM m WHERE words > 1 GROUP BY key), l AS (SELECT *, row_number() OVER (ORDER BY docs DESC, key) AS ord FROM k),
u AS (SELECT source, upper(source) AS target, 1 AS prio, ord FROM l UNION ALL SELECT upper(source), 'user', 0, ord FROM l WHERE ord % 3 = 0), gl AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY lower(source) ORDER BY prio, ord) = 1)"""
ORACLE = {
    "top_terms": f"WITH {_MINED} SELECT doc_id, rank, surface, cnt, score FROM ({_RANK} m) WHERE rank <= 80",
    "terms_pruned": f"""WITH {_MINED}, e AS (SELECT doc_id, key AS longer, cnt AS lc, unnest(list_distinct(flatten(list_transform(range(1, len(string_split(key, ' ')) + 1), lambda i: list_transform(range(1, len(string_split(key, ' ')) - i + 2), lambda n: array_to_string(string_split(key, ' ')[i:i + n - 1], ' ')))))) AS key FROM m WHERE words > 1),
x AS (SELECT m.doc_id, m.key FROM m JOIN e ON m.doc_id = e.doc_id AND m.key = e.key AND e.longer <> m.key AND e.lc >= 0.8 * m.cnt) SELECT doc_id, rank, surface FROM ({_RANK} m WHERE (doc_id, key) NOT IN (SELECT (doc_id, key) FROM x)) WHERE rank <= 80""",
    "common_words": """WITH s AS (SELECT doc_id, i, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> ''),
n AS (SELECT doc_id, count(*) AS lines FROM s GROUP BY doc_id HAVING count(*) >= 20), w AS (SELECT DISTINCT doc_id, i, unnest(regexp_extract_all(lower(text), '\\p{L}+')) AS word FROM s)
SELECT doc_id, word, count(*) AS n, lines FROM w JOIN n USING (doc_id) WHERE length(word) <= 4 GROUP BY doc_id, word, lines HAVING count(*) >= 0.3 * lines""",
    "glossary_union": f"WITH {_GLOS} SELECT source, target, prio FROM gl",
    "glossary_mentions": f"""WITH {_GLOS}, q AS (SELECT lower(source) AS term, CASE WHEN regexp_matches(lower(source), '[a-z]y$') THEN substring(lower(source), 1, length(source) - 1) || '(?:y|ies)' WHEN regexp_matches(lower(source), '[a-z]$') THEN lower(source) || '(?:s|es)?' ELSE lower(source) END AS body FROM gl)
SELECT doc_id, term FROM documents, q WHERE CASE WHEN contains(lower(text), substring(term, 1, length(term) - 1)) THEN regexp_matches(lower(text), '(?:^|[^\\p{{L}}\\p{{N}}])' || body || '(?:[^\\p{{L}}\\p{{N}}]|$)') ELSE false END""",
}
QUERIES = {"top_terms": top_terms, "terms_pruned": terms_pruned, "common_words": common_words, "glossary_union": glossary_union, "glossary_mentions": glossary_mentions}
