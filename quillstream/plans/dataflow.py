"""The central dataflow: documents to segments, look-up, enrichment of the misses, checks, and back to every place."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.pairs import fake_translation, upper_median
from quillstream.operators.segments import segments
from quillstream.operators.store import Store
from quillstream.session import few, small, stored, table

#: Functions that turn texts into results, by provider name. "mock" is deterministic and a plain expression.
ENRICHERS: dict[str, Callable[[DataFrame], DataFrame]] = {"mock": lambda need: need.withColumn("v", fake_translation(F.col("text")))}


def register(name: str, function: Callable[[list[str]], list[str]], max_items: int = 20) -> None:
    """Makes a batch function (texts to as many results, or an exception) an enricher.

    Batches of ``max_items`` run in Arrow batches on the executors. A batch that fails or answers short is halved, down to
    single texts; a single text that fails has no result. Results are stored by content, so a repeat does no harm.
    """

    def halves(texts: list[str]) -> list[str | None]:
        try:
            out = function(texts)
            if len(out) == len(texts):
                return list(out)
        except Exception as e:  # noqa: BLE001  the function is foreign; its failure is data
            if len(texts) == 1:
                return [None if e else None]
        if len(texts) == 1:
            return [None]
        middle = len(texts) // 2
        return halves(texts[:middle]) + halves(texts[middle:])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = list(b["text"])
            b["v"] = [v for i in range(0, len(texts), max_items) for v in halves(texts[i : i + max_items])]
            yield b[["k", "text", "v"]]

    ENRICHERS[name] = lambda need: need.select("k", "text").mapInPandas(run, "k string, text string, v string").where("v IS NOT NULL")


#: Classifiers of a text's language by name, as expressions: register more with ``register_language``.
LANGUAGES: dict[str, Callable[[Column], Column]] = {"script": X.script_language, "letters": X.letter_language}


def register_language(name: str, expression: Callable[[Column], Column]) -> None:
    LANGUAGES[name] = expression


def document_language(segs: DataFrame, language: str) -> DataFrame:
    """doc_id, language: that of most characters of a document's lines, ties by code; undecided documents are left out."""
    s = segs.withColumn("_lang", LANGUAGES[language](F.col("text"))).where("_lang IS NOT NULL")
    n = s.groupBy("doc_id", "_lang").agg(F.sum(F.length("text")).alias("_n"))
    return n.groupBy("doc_id").agg(F.min_by("_lang", F.struct((-F.col("_n")).alias("n"), F.col("_lang"))).alias("language"))


def suspects(placed: DataFrame, batch_chars: int) -> DataFrame:
    """k of the stored results to do again. placed: doc_id, first (place), k, text, v, ok of a document's distinct hits.

    A verified result stays unless it echoes its source. Of the others go those out of place against the upper median
    of their document, and those within a batch's length of one: a shift moves its neighbours too.
    """
    ratio = placed.withColumn("ratio", X.length_ratio(F.col("text"), F.col("v")))
    d = placed.join(upper_median(ratio, "ratio", ["doc_id"], name="typical"), "doc_id", "left")
    d = d.withColumn("shifted", ~F.col("ok") & X.out_of_place(F.col("text"), F.col("v"), F.col("typical")))
    order = Window.partitionBy("doc_id").orderBy("first")
    d = d.withColumn("at", F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    near = F.max("shifted").over(Window.partitionBy("doc_id").orderBy("at").rangeBetween(-batch_chars, batch_chars))
    again = (~F.col("ok") & near) | X.echoes(F.col("text"), F.col("v"))
    return d.withColumn("again", again).where("again").select("k").distinct()


def suspect_keys(lines: DataFrame, heads: DataFrame, store: Store, batch_chars: int) -> DataFrame:
    """k of the stored results of lines (doc_id, seg_no, k, text) to do again. Where all is verified, only echoes are."""
    if store.entries.where("NOT ok").limit(1).count():
        places = lines.groupBy("doc_id", "k").agg(F.min("seg_no").alias("first"), F.first("text").alias("text"))
        return suspects(store.lookup(places), batch_chars)
    return echo_keys(lines, heads, store.entries)


#: A provider: a name in ENRICHERS, or a function from (k, text, attempt) to the same with v.
Provider = str | Callable[[DataFrame], DataFrame]


def head(text: Column) -> Column:
    """A hash of a text's beginning: that of an echo is its source's."""
    return F.xxhash64(F.substring(text, 1, X.ECHO_HEAD))


def echo_keys(lines: DataFrame, heads: DataFrame, entries: DataFrame) -> DataFrame:
    """k of the lines (k, text) whose stored result echoes them. heads: k, h (that of text) of those long enough.

    Hashes of beginnings tell who may (texts have no spaces around them), so texts and results travel for these only.
    """
    there = entries.select("k", head(F.col("v")).alias("a"), head(F.trim("v")).alias("b"))
    may = small(heads.distinct().join(there, "k").where((F.col("h") == F.col("a")) | (F.col("h") == F.col("b"))).select("k"))
    texts = lines.join(may, "k", "left_semi").select("k", "text").dropDuplicates(["k"])
    return texts.join(entries.join(may, "k", "left_semi").select("k", "v"), "k").where(X.echoes(F.col("text"), F.col("v"))).select("k")


def enriched(need: DataFrame, provider: Provider, language: str | None, source: str | None, keep: Sequence[str | Column] = ("k", "text", "v")) -> DataFrame:
    """``keep`` (columns of k, text and v) of the results that are there; one of over 20 characters still in the source
    language is tried once more, and kept if the second try is no better."""
    make = ENRICHERS[provider] if isinstance(provider, str) else provider
    made = make(need.withColumn("attempt", F.lit(1))).select("k", "text", "v").where("trim(v) <> ''")
    if language is None or source is None:
        return stored(made.select(*keep))
    made = stored(made)
    still = lambda c: X.same_language(LANGUAGES[language](c), F.lit(source))
    echo = made.where((F.length("v") > 20) & still(F.col("v"))).select("k", "text")
    second = make(echo.withColumn("attempt", F.lit(2))).select("k", F.col("v").alias("better"))
    second = second.where((F.trim("better") != "") & ~still(F.col("better")))
    return stored(made.join(second, "k", "left").select("k", "text", F.coalesce("better", "v").alias("v")).select(*keep))


def run(docs: DataFrame, store: Store, prefix: str, provider: Provider = "mock", cache_only: bool = False, language: str | None = None,
        source: str | None = None, target: str | None = None, batch_chars: int = 3000) -> tuple[DataFrame, Store, DataFrame]:
    """(segments with result, the new store, the run's figures as one row).

    Skips are by place, work is by distinct text: a text that is skipped in one place is still done where another needs
    it. With ``language`` (a name in LANGUAGES) and ``target``, texts already in the target language are skipped, and
    with ``source`` results still in it are tried again. Stored results that look shifted are done again, unless only
    the store may answer. A new result whose length is out of place in a document is dropped: the source stays there,
    and what every document drops is not stored. What is stored here counts as verified.
    """
    text = F.col("text")
    s = segments(docs).withColumn("skip", ~X.worth_translating(text)).withColumn("k", X.cache_key(F.lit(prefix), text))
    if language and target:
        s = s.withColumn("skip", F.col("skip") | X.same_language(LANGUAGES[language](text), F.lit(target)))
    lines = s.where(~F.col("skip")).select("doc_id", "seg_no", "k", "text")
    keys = stored(lines.select("doc_id", "k", F.when(F.length(text) >= X.ECHO_LEAST, head(text)).alias("h")))
    pairs = keys.select("doc_id", "k").repartition("k").distinct()
    need = lines.select("k", "text").dropDuplicates(["k"])
    old = store
    if not cache_only and store.entries.limit(1).count():
        old = store.without(suspect_keys(lines, keys.where("h IS NOT NULL").select("k", "h"), store, batch_chars))
    missing = stored(old.misses(keys.select("k").distinct()))
    if not missing.limit(1).count():  # no text travels
        kept, new = old.lookup(pairs).select("doc_id", "k", "v"), old
    elif cache_only:
        raise LookupError("texts without a stored result")
    else:
        v = F.col("v")
        facts = (X.bare_length(text).alias("s"), X.bare_length(v).alias("t"), X.has_alien_slots(text, v).alias("alien"))
        made = enriched(need.join(few(missing), "k", "left_semi"), provider, language, source, ("k", "v", *facts, F.monotonically_increasing_id().alias("_at")))
        spots = stored(pairs.join(made.select("k", "s", "t", "alien"), "k").withColumn("ratio", X.ratio_of(F.col("s"), F.col("t"))))
        typical = upper_median(spots, "ratio", ["doc_id"], name="typical")
        fits = ~F.col("alien") & ~X.misfits(F.col("s"), F.col("t"), F.col("typical"))
        fresh = stored(spots.join(typical, "doc_id", "left").where(fits).select("doc_id", "k"))
        dropped = small(made.select("k").join(fresh.select("k").distinct(), "k", "left_anti"))
        good = made.join(dropped, "k", "left_anti") if dropped.limit(1).count() else made
        kept = old.lookup(pairs).select("doc_id", "k", "v").unionByName(fresh.join(made.select("k", "v"), "k").select("doc_id", "k", "v"))
        new = old.add(good)
    out = s.join(kept, ["doc_id", "k"], "left").withColumn("result", F.when(F.col("skip") | F.col("v").isNull(), text).otherwise(F.col("v")))
    failed = F.count_if(~F.col("skip") & F.col("v").isNull())
    figures = out.agg(F.count(F.lit(1)).alias("segments"), F.count_if("skip").alias("skipped"), failed.alias("failed"))
    return out.select("doc_id", "seg_no", "text", "skip", "result"), new.claim(pairs.select(F.col("doc_id").cast("string").alias("doc"), "k")), figures


def assembled(out: DataFrame, bilingual: bool = False) -> DataFrame:
    """doc_id, text: results joined in order; bilingual puts each under its source."""
    line = F.when(F.lit(bilingual) & (F.col("result") != F.col("text")), F.concat_ws("\n", "text", "result")).otherwise(F.col("result"))
    parts = F.array_sort(F.collect_list(F.struct("seg_no", line.alias("t"))))
    return out.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda x: x["t"]), "\n").alias("text"))


def empty_store(spark: SparkSession) -> Store:
    return Store(spark.createDataFrame([], "k string, v string, ok boolean, seq long"), spark.createDataFrame([], "doc string, k string"))


def doc_dataflow(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _, _ = run(table(spark, sf_dir, "documents"), empty_store(spark), "svc:mock:en:de")
    return assembled(out, bilingual=True).select("doc_id", X.digest(F.col("text")).alias("text_sha"))


def dataflow_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its language by letters, and the lines that a run into German skips because they are German."""
    d = table(spark, sf_dir, "documents")
    s = segments(d)
    skipped = s.groupBy("doc_id").agg(F.count_if(X.same_language(X.letter_language(F.col("text")), F.lit("de"))).alias("skipped"))
    return skipped.join(document_language(s, "letters"), "doc_id", "left").select("doc_id", "skipped", "language")


def dataflow_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that a run does again: the store's results of every 31st line (by length) are another line's, five times over."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("k", X.digest(F.col("text")))
    places = s.groupBy("doc_id", "k").agg(F.min("seg_no").alias("first"), F.first("text").alias("text"))
    v = F.when(F.length("text") % 31 == 7, F.repeat("text", F.lit(5))).otherwise(fake_translation(F.col("text")))
    return suspects(places.withColumn("v", v).withColumn("ok", F.substring("k", 1, 1) < "4"), 400)


def dataflow_retries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Results of distinct German lines by a stand-in that gives back every line of even length at first, and those of a
    length that four divides a second time too."""
    s = segments(table(spark, sf_dir, "documents")).where(X.letter_language(F.col("text")) == "de")
    need = s.select(X.digest(F.col("text")).alias("k"), "text").dropDuplicates(["k"])
    lazy = F.length("text") % F.when(F.col("attempt") == 1, 2).otherwise(4) == 0
    make = lambda n: n.withColumn("v", F.when(lazy, F.col("text")).otherwise(F.concat(F.lit("t"), F.col("attempt").cast("string"))))
    return enriched(need, make, "letters", "de").select("k", F.when(F.col("v") == F.col("text"), F.lit("echo")).otherwise(F.col("v")).alias("v"))


_CODE = "regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`[^`]*`', ' ', 'g'), 'https?://[^\\s]+', ' ', 'g')"
_SEG = """s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM
 (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)
 WHERE trim(l[i], ' ') <> '')"""
_LETTERS = """CASE WHEN regexp_matches(text, '[ßäöü]') THEN 'de' WHEN regexp_matches(text, '[ñóí]') THEN 'es'
 WHEN regexp_matches(text, '[èêçé]') THEN 'fr' END"""
ORACLE = {
    "doc_dataflow": f"""WITH s AS (SELECT doc_id, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> '')
SELECT doc_id, sha1(string_agg(CASE WHEN regexp_matches({_CODE}, '\\p{{L}}') THEN text || chr(10) || '[t] ' || text ELSE text END, chr(10) ORDER BY seg_no)) AS text_sha FROM s GROUP BY doc_id""",
    "dataflow_languages": f"""WITH {_SEG}, g AS (SELECT *, {_LETTERS} AS lang FROM s),
n AS (SELECT doc_id, lang, sum(length(text)) AS n FROM g WHERE lang IS NOT NULL GROUP BY ALL)
SELECT doc_id, count(*) FILTER (lang = 'de') AS skipped,
 (SELECT first(lang ORDER BY n DESC, lang) FROM n WHERE n.doc_id = g.doc_id) AS language FROM g GROUP BY doc_id""",
    "dataflow_suspects": f"""WITH {_SEG}, p AS (SELECT doc_id, text, min(seg_no) AS first, sha1(text) AS k FROM s GROUP BY doc_id, text),
v AS (SELECT *, regexp_replace(text, '\\{{v[0-9]+\\}}|\\[\\[/?[A-Za-z0-9_]+\\]\\]', '', 'g') AS bare, length(text) % 31 = 7 AS odd,
 substring(k, 1, 1) < '4' AS ok FROM p),
r AS (SELECT *, length(bare) AS a, CASE WHEN odd THEN 5 * length(bare) ELSE length(bare) + 4 END AS b FROM v),
m AS (SELECT doc_id, list_sort(list(b / a))[count(*) // 2 + 1] AS typical FROM r WHERE a >= 60 GROUP BY doc_id HAVING count(*) >= 3),
t AS (SELECT r.*, NOT ok AND typical IS NOT NULL AND CASE WHEN a >= 60 THEN b / a < typical * 0.45 OR b / a > typical * 4.0
 ELSE b > 60 * typical * 4.0 END AS shifted FROM r LEFT JOIN m USING (doc_id)),
c AS (SELECT *, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY first) AS at_ FROM t),
h AS (SELECT *, bool_or(shifted) OVER (PARTITION BY doc_id ORDER BY at_ RANGE BETWEEN 400 PRECEDING AND 400 FOLLOWING) AS near FROM c)
SELECT DISTINCT k FROM h WHERE (NOT ok AND near) OR (odd AND length(text) >= 80 AND len(regexp_extract_all(text, '[A-Za-z]{{4,}}')) >= 12)""",
    "dataflow_retries": f"""WITH {_SEG}, g AS (SELECT DISTINCT text FROM s WHERE ({_LETTERS}) = 'de')
SELECT sha1(text) AS k, CASE WHEN length(text) % 2 <> 0 THEN 't1' WHEN length(text) % 4 = 0 OR length(text) <= 20 THEN 'echo' ELSE 't2' END AS v
FROM g""",
}
QUERIES = {
    "doc_dataflow": doc_dataflow, "dataflow_languages": dataflow_languages, "dataflow_suspects": dataflow_suspects,
    "dataflow_retries": dataflow_retries,
}
