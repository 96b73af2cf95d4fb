"""One facade over documents, jobs, the result store and glossaries; and the rules that serve requests.

``Corpus`` is immutable: a change gives a new one, a composition of joins. ``save`` and ``open`` keep it as versioned Parquet.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import reduce
from operator import or_

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.pairs import fake_translation
from quillstream.operators.segments import segments
from quillstream.operators.store import Store, derived
from quillstream.plans import dataflow
from quillstream.session import table
from quillstream.sources import records

JOBS = "id string, document string, status string, created timestamp, size long"
GLOSSARY = "id string, name string, ord int, source string, target string"


@dataclass(frozen=True)
class Corpus:
    jobs_: DataFrame  # JOBS
    results: DataFrame  # id (of the job), doc_id, seg_no, text, skip, result
    store: Store
    glossaries: DataFrame  # GLOSSARY, a row an entry

    @classmethod
    def empty(cls, spark: SparkSession) -> Corpus:
        results = spark.createDataFrame([], "id string, doc_id long, seg_no int, text string, skip boolean, result string")
        return cls(spark.createDataFrame([], JOBS), results, dataflow.empty_store(spark), spark.createDataFrame([], GLOSSARY))

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> Corpus:
        jobs, results, entries, owners, glossaries = (records.swapped(spark, f"{path}/{t}") for t in ("jobs", "results", "entries", "owners", "glossaries"))
        return cls(jobs, results, Store(entries, owners), glossaries)

    def save(self, path: str) -> None:
        parts = {"jobs": self.jobs_, "results": self.results, "entries": self.store.entries, "owners": self.store.owners, "glossaries": self.glossaries}
        for name, df in parts.items():
            records.swap_in(df, f"{path}/{name}")

    # jobs
    def submit(self, job: str, docs: DataFrame, prefix: str, **how: object) -> Corpus:
        """Runs the dataflow over docs (doc_id, text) as a job; what earlier jobs made is reused."""
        out, store, _ = dataflow.run(docs, self.store, prefix, **how)
        about = docs.agg(F.sha1(F.concat_ws(",", F.array_sort(F.collect_set(X.digest(F.col("text")))))).alias("document"), F.sum(F.length("text")).alias("size"))
        row = about.select(F.lit(job).alias("id"), "document", F.lit("done").alias("status"), F.current_timestamp().alias("created"), "size")
        return replace(self, jobs_=self.jobs_.unionByName(row), results=self.results.unionByName(out.withColumn("id", F.lit(job))), store=store)

    def jobs(self) -> DataFrame:
        """Newest first, ties by id."""
        return self.jobs_.orderBy(F.col("created").desc(), "id")

    def job(self, job: str) -> DataFrame:
        return self.jobs_.where(F.col("id") == job)

    def delete(self, ids: DataFrame) -> tuple[Corpus, DataFrame]:
        """(the corpus without the jobs asked for, id and state of each asked id): ids that are gone are told, once each."""
        asked = ids.select("id").distinct().join(self.jobs_.select("id", F.lit("deleted").alias("state")).distinct(), "id", "left")
        told = asked.select("id", F.coalesce("state", F.lit("missing")).alias("state"))
        left = lambda d: d.join(ids.select("id"), "id", "left_anti")
        return replace(self, jobs_=left(self.jobs_), results=left(self.results)), told

    # the store
    def footprint(self) -> DataFrame:
        """doc, entries, alone: what purging each owner would remove, and what it alone owns."""
        mine = self.store.owners.join(self.store.entries.select("k"), "k", "left_semi").groupBy("doc").agg(F.countDistinct("k").alias("entries"))
        alone = self.store.only().groupBy("doc").agg(F.count(F.lit(1)).alias("alone"))
        return mine.join(alone, "doc", "left").select("doc", "entries", F.coalesce("alone", F.lit(0)).cast("long").alias("alone"))

    def purge(self, doc: str) -> Corpus:
        return replace(self, store=self.store.purge(doc))

    def sweep(self, used: DataFrame) -> tuple[Corpus, DataFrame]:
        """(the corpus without entries that no used owner has, removed and untracked as one row); untracked entries stay."""
        figures = self.store.unused(used).agg(F.count(F.lit(1)).alias("removed")).crossJoin(self.store.untracked().agg(F.count(F.lit(1)).alias("untracked")))
        return replace(self, store=self.store.purge_unused(used)), figures

    # edits and order
    def edit(self, job: str, edits: DataFrame) -> Corpus:
        """Corrections (doc_id, seg_no, result) of a job: equal source texts of the job take them too, skipped places don't.

        Of several corrections of one text the first place's wins; empty ones are left out.
        """
        mine = self.results.where(F.col("id") == job)
        new = edits.where("trim(result) <> ''").select("doc_id", "seg_no", F.trim("result").alias("_new"))
        hit = mine.where("NOT skip").join(new, ["doc_id", "seg_no"]).groupBy("text").agg(F.min_by("_new", F.struct("doc_id", "seg_no")).alias("_new"))
        changed = mine.join(hit, "text", "left").withColumn("result", F.when(~F.col("skip"), F.coalesce("_new", "result")).otherwise(F.col("result")))
        rest = self.results.where(F.col("id") != job)
        return replace(self, results=rest.unionByName(changed.drop("_new")))

    # glossaries
    def put_glossary(self, gid: str, name: str, entries: DataFrame) -> Corpus:
        """Creates a glossary, or replaces its entries (ord, source, target)."""
        rows = entries.select(F.lit(gid).alias("id"), F.lit(name).alias("name"), F.col("ord").cast("int").alias("ord"), "source", "target")
        return replace(self, glossaries=self.drop_glossary(gid).glossaries.unionByName(rows))

    def drop_glossary(self, gid: str) -> Corpus:
        return replace(self, glossaries=self.glossaries.where(F.col("id") != gid))

    def list_glossaries(self) -> DataFrame:
        return self.glossaries.groupBy("id").agg(F.min("name").alias("name"), F.count(F.lit(1)).alias("entries"))

    def export_glossary(self, gid: str, path: str) -> None:
        records.write_glossary_csv(self.glossaries.where(F.col("id") == gid).orderBy("ord"), path)


def of_documents(spark: SparkSession, sf_dir: str) -> Corpus:
    """A corpus made of the documents: a job a source, results of every line, the derived store, a glossary a language."""
    d = table(spark, sf_dir, "documents")
    store, _ = derived(spark, sf_dir)
    start = F.timestamp_seconds(F.lit(1_700_000_000) + F.min("doc_id") * 60)
    jobs = d.groupBy(F.col("source").alias("id")).agg(F.sha1(F.max("source").cast("binary")).alias("document"), F.lit("done").alias("status"), start.alias("created"), F.sum(F.length("text")).alias("size"))
    s = segments(d).join(d.select("doc_id", F.col("source").alias("id")), "doc_id")
    results = s.select("id", "doc_id", "seg_no", "text", (~X.worth_translating(F.col("text"))).alias("skip"), fake_translation(F.col("text")).alias("result"))
    words = d.where("lang IS NOT NULL").groupBy(F.col("lang").alias("id"), F.substring("text", 1, 3).alias("source")).agg(F.min("doc_id").cast("int").alias("ord"))
    words = words.where("length(trim(source)) = 3")
    return Corpus(jobs, results, store, words.select("id", F.upper("id").alias("name"), "ord", "source", F.upper("source").alias("target")))


# --- queries over the facade -----------------------------------------------------------------------------------------------
def corpus_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = of_documents(spark, sf_dir).jobs()
    return jobs.select("id", "size", F.date_format("created", "yyyy-MM-dd HH:mm").alias("created"), F.rank().over(Window.partitionBy(F.substring("id", 1, 1)).orderBy(F.col("created").desc(), "id")).alias("place"))


def corpus_footprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return of_documents(spark, sf_dir).footprint()


def corpus_purge(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = of_documents(spark, sf_dir).purge("src1").store
    return left.owners.groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def corpus_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = of_documents(spark, sf_dir)
    used = c.jobs_.select(F.col("id").alias("doc")).where("cast(substring(doc, 4) as int) % 2 = 0")
    after, figures = c.sweep(used)
    return figures.crossJoin(after.store.entries.agg(F.count(F.lit(1)).alias("left")))


def corpus_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bulk deletion of every second job and of ids that there never were, some asked for twice."""
    c = of_documents(spark, sf_dir)
    asked = c.jobs_.select("id").where("length(id) > 0 AND cast(substring(id, 4) as int) % 2 = 1")
    asked = asked.union(asked).union(c.jobs_.select(F.concat(F.lit("no-"), "id")))
    left, told = c.delete(asked)
    return told.unionByName(left.jobs_.select("id", F.lit("left").alias("state")))


def corpus_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correction of the first line of every third document, and the places of its job that it reaches."""
    c = of_documents(spark, sf_dir)
    first = c.results.where("id = 'src0' AND doc_id % 3 = 0 AND seg_no = 0")
    edited = c.edit("src0", first.select("doc_id", "seg_no", F.concat(F.lit("edit "), F.col("doc_id").cast("string")).alias("result")))
    return edited.results.where("startswith(result, 'edit ')").select("doc_id", "seg_no", "result")


def corpus_focus(spark: SparkSession, sf_dir: str, focus: int = 10) -> DataFrame:
    """The order in which waiting lines are worked on: from the focus on, then those before it."""
    s = segments(table(spark, sf_dir, "documents"))
    w = Window.partitionBy("doc_id").orderBy((F.col("seg_no") < focus).cast("int"), "seg_no")
    return s.select("doc_id", "seg_no", F.row_number().over(w).alias("turn"))


def corpus_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the owner of web pages has in the store, and what is left after it is cleared."""
    store, _ = derived(spark, sf_dir)
    web = store.entries.where("substring(k, 3, 1) = '0'").select(F.lit("web").alias("doc"), "k")
    claimed = store.claim(web)
    row = claimed.owners.where("doc = 'web'").agg(F.count(F.lit(1)).alias("web"))
    return row.crossJoin(claimed.purge_only("web").entries.agg(F.count(F.lit(1)).alias("left")))


def corpus_glossaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library after one glossary is dropped, one replaced by its first entries and one made."""
    c = of_documents(spark, sf_dir)
    some = c.glossaries.where("id = 'fr' AND ord < 200")
    changed = c.drop_glossary("es").put_glossary("fr", "French", some).put_glossary("new", "New", some)
    return changed.list_glossaries()


# --- rules that serve requests ---------------------------------------------------------------------------------------------
def skips(*predicates: Column) -> Column:
    """Whether any rule skips a row; a rule that can't tell doesn't."""
    return reduce(or_, [F.coalesce(p, F.lit(False)) for p in predicates])


def share(part: Column, of: Column) -> Column:
    """The share of ``of`` in rows where ``part`` holds; 0 of nothing."""
    return F.coalesce(F.sum(F.when(part, of)) / F.nullif(F.sum(of), F.lit(0)), F.lit(0.0))


def skip_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by document, those that any of six rules skips, and the share of letters in lines that look like code."""
    t = F.col("text")
    code = t.rlike(r"[{}<>=]|\(\)")
    rules = (X.is_page_number(t), X.is_reference_title(t), ~X.worth_translating(t), code, F.length(t) < 4, t.rlike(r"^\|"))
    s = segments(table(spark, sf_dir, "documents")).withColumn("gone", skips(*rules)).withColumn("letters", X.count_of(t, X.LETTER))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if("gone").alias("skipped"), F.round(share(code, F.col("letters")), 9).alias("code_share"))


def zipped_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The n-th words of users beside the n-th of assistants, by place in two parallel lists; the longer list goes on alone."""
    c = table(spark, sf_dir, "conversations")
    said = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", F.length("text").alias("n"))))), lambda x: x["n"])
    lists = c.groupBy("conv_id").agg(said("user").alias("asked"), said("assistant").alias("told"))
    rows = lists.select("conv_id", F.posexplode(F.arrays_zip("asked", "told")).alias("place", "z"))
    return rows.select("conv_id", "place", "z.asked", "z.told")


def paused_requests(spark: SparkSession, sf_dir: str, seconds: int = 600) -> DataFrame:
    """By service: requests, and those that fall into a pause of the service. A pause runs from an overload on, overlapping
    ones as long as the last of them; a running maximum of their ends tells, so no interval is joined."""
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 10).alias("service"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), F.pmod("event_id", F.lit(17)).alias("r"))
    before = Window.partitionBy("service").orderBy("at", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("until", F.max(F.when(F.col("r") == 0, F.col("at") + seconds)).over(before))
    held = F.coalesce(F.col("until") > F.col("at"), F.lit(False))
    wait = F.round(F.sum(F.when(held, F.col("until") - F.col("at")).otherwise(0.0)), 3)
    return e.groupBy("service").agg(F.count(F.lit(1)).alias("requests"), F.count_if(held).alias("held"), wait.alias("waited"))


def by_markup(batch: DataFrame, rich: Callable[[Column], Column], plain: Callable[[Column], Column]) -> DataFrame:
    """Items (batch, place, text, html) in two groups by their flag, each through its own function, together again."""
    done = batch.where("html").withColumn("out", rich(F.col("text"))).unionByName(batch.where("NOT html").withColumn("out", plain(F.col("text"))))
    return done.select("batch", "place", "out")


def split_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines in batches of 20 by document, those with markup escaped, the others not, put back in their order."""
    s = segments(table(spark, sf_dir, "documents"))
    b = s.select(F.concat_ws("-", F.col("doc_id").cast("string"), F.floor(F.col("seg_no") / 20).cast("string")).alias("batch"), F.col("seg_no").alias("place"), "text", (F.col("seg_no") % 3 == 1).alias("html"))
    out = by_markup(b, lambda t: F.concat(F.lit("<p>"), F.replace(t, F.lit("&"), F.lit("&amp;")), F.lit("</p>")), lambda t: t)
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "out"))), lambda x: x["out"]), "\n")
    return out.groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.sha1(whole.cast("binary")).alias("sha"))


#: Limits of one web request: texts, and characters of a text.
WEB_TEXTS, WEB_CHARS = 50, 10_000


def web_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as requests of their lines into German: refused beyond the limits; lines in German go into French instead;
    no result where nothing changed."""
    s = segments(table(spark, sf_dir, "documents"))
    size = s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.max(F.length("text")).alias("longest"))
    ok = size.where((F.col("texts") <= WEB_TEXTS) & (F.col("longest") <= WEB_CHARS)).select("doc_id")
    r = s.join(ok, "doc_id").withColumn("lang", F.when(X.same_language(X.letter_language(F.col("text")), F.lit("de")), F.lit("fr")).otherwise(F.lit("de")))
    r = r.withColumn("out", F.nullif(F.when(X.worth_translating(F.col("text")), F.concat("lang", F.lit(": "), "text")).otherwise(F.col("text")), F.col("text")))
    return r.groupBy("doc_id").agg(F.count("out").alias("changed"), F.count_if(F.col("out").isNotNull() & (F.col("lang") == "fr")).alias("turned"), F.count_if(F.col("out").isNull()).alias("same"))


def nearest_first(spark: SparkSession, sf_dir: str, top: int = 200, height: int = 300, screens: int = 2) -> DataFrame:
    """Waiting lines by distance from what is in view (lines are 18 high), equal ones in the page's order; those farther than
    some screens wait outside the queue."""
    s = segments(table(spark, sf_dir, "documents")).withColumn("y", F.col("seg_no") * 18)
    away = F.when(F.col("y") + 14 < top, top - F.col("y") - 14).otherwise(F.greatest(F.lit(0), F.col("y") - top - height))
    near = s.withColumn("away", away).where(F.col("away") <= screens * height)
    return near.select("doc_id", "seg_no", "away", F.row_number().over(Window.partitionBy("doc_id").orderBy("away", "seg_no")).alias("turn"))


def resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run that stops after every second document, and the run that goes on: it makes only what is missing, and a third
    run makes nothing."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    out, store, count = None, dataflow.empty_store(spark), F.count(F.lit(1))
    for step, docs in enumerate((d.where("doc_id % 2 = 0"), d, d)):
        _, after, _ = dataflow.run(docs, store, "p")
        made = after.entries.join(store.entries.select("k"), "k", "left_anti").agg(count.alias("made")).withColumn("step", F.lit(step))
        out, store = made if out is None else out.unionByName(made), after
    return out


#: SQL functions that ``register_functions`` makes, by name: parameters and body.
FUNCTIONS = {
    "quill_squeeze": ("t STRING", r"trim(regexp_replace(t, '[ \\t\\n\\r\\f]+', ' '))"),
    "quill_same_language": ("a STRING, b STRING", "coalesce(lower(split(a, '[-_]')[0]) = lower(split(b, '[-_]')[0]), false)"),
    "quill_ratio": ("s STRING, t STRING", "CASE WHEN length(s) >= 60 THEN length(t) / length(s) END"),
}


class Clauses:
    """A table function: place and length of the clauses of a text."""

    def eval(self, text: str) -> Iterator[tuple[int, int]]:
        for i, c in enumerate((text or "").split(",")):
            yield i, len(c)


def register_functions(spark: SparkSession) -> None:
    """Makes the engine's functions known to SQL for the session: scalar ones as SQL expressions, which the optimiser sees
    through, and a table function."""
    for name, (parameters, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURN {body}")
    spark.udtf.register("quill_clauses", F.udtf(Clauses, returnType="place int, n int"))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions at work, a row a document.

    What needs the text is found before the clauses are, so a clause's row holds no text, and numbers alone are aggregated:
    by hash, never by a sort of all clauses. Rows are told apart by their place, so documents of one id stay apart.
    """
    register_functions(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("quill_documents")
    return spark.sql("""
        WITH d AS (SELECT doc_id, text, monotonically_increasing_id() AS at, sha1(quill_squeeze(text)) AS squeezed,
                          quill_same_language(lang, 'DE-at') AS german, round(quill_ratio(text, lang), 9) AS ratio FROM quill_documents)
        SELECT doc_id, squeezed, german, ratio, count(*) AS clauses, max(c.n) AS longest
        FROM d, LATERAL quill_clauses(text) c GROUP BY at, doc_id, squeezed, german, ratio""")


#: Renderers by name: functions from a frame of (part, ord, text) to one of (part, out), run a partition at a time.
RENDERERS: dict[str, Callable[[pd.DataFrame], pd.DataFrame]] = {}


def register_renderer(name: str, function: Callable[[pd.DataFrame], pd.DataFrame]) -> None:
    RENDERERS[name] = function


def rendered(parts: DataFrame, name: str) -> DataFrame:
    """Each part through a renderer: parts (part, ord, text) are dealt to partitions, so a renderer never sees half of one."""
    function = RENDERERS[name]
    return parts.groupBy("part").applyInPandas(lambda pdf: function(pdf.sort_values("ord")), "part long, out string")


def rendered_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 40 lines, each rendered as a list by a registered function."""
    register_renderer("list", lambda pdf: pd.DataFrame({"part": [pdf["part"].iloc[0]], "out": ["\n".join("- " + t for t in pdf["text"])]}))
    s = segments(table(spark, sf_dir, "documents"))
    parts = s.select((F.col("doc_id") * 100_000 + F.floor(F.col("seg_no") / 40)).alias("part"), F.col("seg_no").alias("ord"), "text")
    return rendered(parts, "list").select("part", F.sha1(F.col("out").cast("binary")).alias("sha"))


_SEG = """s AS (SELECT doc_id, source, lang, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM
 (SELECT *, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL), unnest(range(1, len(l) + 1)) AS r(i)
 WHERE trim(l[i], ' ') <> '')"""
_STORE = f"""{_SEG}, e AS (SELECT sha1('svc:mock:en:de' || chr(10) || text) AS k, source FROM s WHERE regexp_matches(text, '\\p{{L}}')),
entries AS (SELECT DISTINCT k FROM e), owners AS (SELECT DISTINCT source AS doc, k FROM e WHERE substring(k, 1, 1) <> '0'),
sole AS (SELECT k, min(doc) AS doc FROM owners GROUP BY k HAVING count(*) = 1)"""
_CODE = """regexp_replace(regexp_replace(regexp_replace(text, '!\\[[^\\]]*\\]\\([^)]*\\)', ' ', 'g'), '`[^`]*`', ' ', 'g'),
 'https?://[^\\s]+', ' ', 'g')"""
_WORTH = f"regexp_matches({_CODE}, '\\p{{L}}')"
_TITLES = ", ".join(f"'{t}'" for t in X.REFERENCE_TITLES)
_PAGE = """(length(trim(text)) BETWEEN 1 AND 16 AND (regexp_matches(lower(trim(text)), '^[-–—( ]*[0-9]+[-–—) ]*$')
 OR regexp_matches(lower(trim(text)), '^(page|p\\.)? ?[0-9]+ ?(/|of) ?[0-9]+$') OR regexp_matches(lower(trim(text)), '^page [0-9]+$')
 OR regexp_matches(lower(trim(text)), '^[ivxlcdm]+$')))"""
ORACLE = {
    "corpus_jobs": """SELECT source AS id, CAST(sum(length(text)) AS BIGINT) AS size,
strftime(make_timestamp((1700000000 + min(doc_id) * 60) * 1000000), '%Y-%m-%d %H:%M') AS created,
rank() OVER (PARTITION BY substring(source, 1, 1) ORDER BY min(doc_id) DESC, source) AS place FROM documents GROUP BY source""",
    "corpus_footprint": f"""WITH {_STORE} SELECT doc, count(*) AS entries, count(*) FILTER (k IN (SELECT k FROM sole)) AS alone
FROM owners GROUP BY doc""",
    "corpus_purge": f"""WITH {_STORE} SELECT doc, count(*) AS n FROM owners WHERE k NOT IN (SELECT k FROM owners WHERE doc = 'src1')
GROUP BY doc""",
    "corpus_sweep": f"""WITH {_STORE}, live AS (SELECT k FROM owners WHERE CAST(substring(doc, 4) AS INT) % 2 = 0),
dead AS (SELECT DISTINCT k FROM owners WHERE k NOT IN (SELECT k FROM live))
SELECT (SELECT count(*) FROM dead) AS removed, (SELECT count(*) FROM entries WHERE k NOT IN (SELECT k FROM owners)) AS untracked,
 (SELECT count(*) FROM entries WHERE k NOT IN (SELECT k FROM dead)) AS "left\"""",
    "corpus_delete": """WITH j AS (SELECT DISTINCT source AS id FROM documents)
SELECT id, CASE WHEN CAST(substring(id, 4) AS INT) % 2 = 1 THEN 'deleted' ELSE 'left' END AS state FROM j
UNION ALL SELECT 'no-' || id, 'missing' FROM j""",
    "corpus_edit": f"""WITH {_SEG}, m AS (SELECT doc_id, seg_no, text, {_WORTH} AS worth FROM s WHERE source = 'src0'),
f AS (SELECT text, first(doc_id ORDER BY doc_id) AS by_ FROM m WHERE worth AND seg_no = 0 AND doc_id % 3 = 0 GROUP BY text)
SELECT doc_id, seg_no, 'edit ' || by_ AS result FROM m JOIN f USING (text) WHERE worth""",
    "corpus_focus": f"""WITH {_SEG} SELECT doc_id, seg_no, row_number() OVER (PARTITION BY doc_id
 ORDER BY CASE WHEN seg_no < 10 THEN 1 ELSE 0 END, seg_no) AS turn FROM s""",
    "corpus_owners": f"""WITH {_STORE}, w AS (SELECT k FROM entries WHERE substring(k, 3, 1) = '0')
SELECT (SELECT count(*) FROM w) AS web, (SELECT count(*) FROM entries WHERE NOT (k IN (SELECT k FROM w) AND k NOT IN (SELECT k FROM owners))) AS "left\"""",
    "corpus_glossaries": """WITH g AS (SELECT lang AS id, substring(text, 1, 3) AS source, min(doc_id) AS ord FROM documents
 WHERE lang IS NOT NULL AND length(trim(substring(text, 1, 3), ' ')) = 3 GROUP BY ALL)
SELECT id, CASE id WHEN 'fr' THEN 'French' ELSE upper(id) END AS name, count(*) AS entries FROM g
WHERE id <> 'es' AND (id <> 'fr' OR ord < 200) GROUP BY id
UNION ALL SELECT 'new', 'New', count(*) FROM g WHERE id = 'fr' AND ord < 200""",
    "skip_rules": f"""WITH {_SEG}, r AS (SELECT *, regexp_matches(text, '[{{}}<>=]|\\(\\)') AS code, len(regexp_extract_all(text, '\\p{{L}}')) AS letters,
 regexp_replace(regexp_replace(trim(text), '^[0-9.]+\\s+', ''), '[:.]$', '') AS title FROM s)
SELECT doc_id, count(*) AS lines, count(*) FILTER ({_PAGE} OR (length(trim(text)) <= 40 AND lower(title) IN ({_TITLES})) OR NOT {_WORTH}
 OR code OR length(text) < 4 OR text LIKE '|%') AS skipped,
 round(coalesce(sum(CASE WHEN code THEN letters END) / nullif(sum(letters), 0), 0.0), 9) AS code_share FROM r GROUP BY doc_id""",
    "zipped_turns": """WITH n AS (SELECT conv_id, role, length(text) AS n, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) - 1 AS place
 FROM conversations WHERE role IN ('user', 'assistant')), u AS (SELECT * FROM n WHERE role = 'user'), a AS (SELECT * FROM n WHERE role = 'assistant')
SELECT coalesce(u.conv_id, a.conv_id) AS conv_id, coalesce(u.place, a.place) AS place, u.n AS asked, a.n AS told
FROM u FULL JOIN a ON u.conv_id = a.conv_id AND u.place = a.place""",
    "paused_requests": """WITH e AS (SELECT event_id, user_id % 10 AS service, epoch_us(ts) / 1000000.0::DOUBLE AS at_, event_id % 17 AS r FROM events),
u AS (SELECT *, max(CASE WHEN r = 0 THEN at_ + 600 END) OVER (PARTITION BY service ORDER BY at_, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS til FROM e)
SELECT service, count(*) AS requests, count(*) FILTER (til > at_) AS held, round(sum(CASE WHEN til > at_ THEN til - at_ ELSE 0.0::DOUBLE END), 3) AS waited
FROM u GROUP BY service""",
    "split_batches": f"""WITH {_SEG}, b AS (SELECT doc_id || '-' || (seg_no // 20) AS batch, seg_no,
 CASE WHEN seg_no % 3 = 1 THEN '<p>' || replace(text, '&', '&amp;') || '</p>' ELSE text END AS out FROM s)
SELECT batch, count(*) AS n, sha1(string_agg(out, chr(10) ORDER BY seg_no)) AS sha FROM b GROUP BY batch""",
    "web_batches": f"""WITH {_SEG}, ok AS (SELECT doc_id FROM s GROUP BY doc_id HAVING count(*) <= 50 AND max(length(text)) <= 10000),
r AS (SELECT doc_id, regexp_matches(text, '[ßäöü]') AS german, {_WORTH} AS worth FROM s WHERE doc_id IN (SELECT doc_id FROM ok))
SELECT doc_id, count(*) FILTER (worth) AS changed, count(*) FILTER (worth AND german) AS turned, count(*) FILTER (NOT worth) AS same
FROM r GROUP BY doc_id""",
    "nearest_first": f"""WITH {_SEG}, a AS (SELECT doc_id, seg_no, CASE WHEN seg_no * 18 + 14 < 200 THEN 186 - seg_no * 18
 ELSE greatest(0, seg_no * 18 - 500) END AS away FROM s)
SELECT doc_id, seg_no, away, row_number() OVER (PARTITION BY doc_id ORDER BY away, seg_no) AS turn FROM a WHERE away <= 600""",
    "resumed": f"""WITH {_SEG}, w AS (SELECT doc_id, text FROM s WHERE {_WORTH})
SELECT 0 AS step, (SELECT count(DISTINCT text) FROM w WHERE doc_id % 2 = 0) AS made
UNION ALL SELECT 1, (SELECT count(DISTINCT text) FROM w WHERE text NOT IN (SELECT text FROM w WHERE doc_id % 2 = 0)) UNION ALL SELECT 2, 0""",
    "sql_functions": """SELECT doc_id, sha1(trim(regexp_replace(text, '[ \\t\\n\\r\\f]+', ' ', 'g'), ' ')) AS squeezed, coalesce(lower(lang) = 'de', false) AS german,
round(CASE WHEN length(text) >= 60 THEN length(lang) / length(text) END, 9) AS ratio, len(string_split(coalesce(text, ''), ',')) AS clauses,
list_max(list_transform(string_split(coalesce(text, ''), ','), lambda x: length(x))) AS longest FROM documents""",
    "rendered_parts": f"""WITH {_SEG} SELECT doc_id * 100000 + seg_no // 40 AS part, sha1(string_agg('- ' || text, chr(10) ORDER BY seg_no)) AS sha
FROM s GROUP BY 1""",
}
QUERIES = {
    f.__name__: f
    for f in (
        corpus_jobs, corpus_footprint, corpus_purge, corpus_sweep, corpus_delete, corpus_edit, corpus_focus, corpus_owners, corpus_glossaries,
        skip_rules, zipped_turns, paused_requests, split_batches, web_batches, nearest_first, resumed, sql_functions, rendered_parts,
    )
}
