"""A content-addressed result store with owners: look-ups, misses, upserts, purges, eviction.

``Store`` holds two DataFrames, entries (k, v, ok, seq) and owners (doc, k). Changes give a new ``Store`` (plain Parquet
has no row updates), each a composition of joins; ``save`` swaps a new version in.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators.segments import segments
from quillstream.session import numbered, small, table


@dataclass(frozen=True)
class Store:
    entries: DataFrame
    owners: DataFrame

    # look-ups
    def lookup(self, texts: DataFrame) -> DataFrame:
        """texts (k, ...) with the stored value: one join instead of a look-up a text."""
        return texts.join(self.entries.select("k", "v", "ok"), "k")

    def misses(self, texts: DataFrame) -> DataFrame:
        return texts.join(self.entries.select("k"), "k", "left_anti")

    def verified(self, texts: DataFrame) -> DataFrame:
        return texts.join(self.entries.where("ok").select("k"), "k", "left_semi")

    def owned(self, doc) -> DataFrame:
        """Keys that a document owns and that exist."""
        return self.owners.where(F.col("doc") == doc).join(self.entries.select("k"), "k", "left_semi").select("k").distinct()

    def only(self) -> DataFrame:
        """(doc, k) of the keys that exist and that one document alone owns."""
        counted = self.owners.groupBy("k").agg(F.countDistinct("doc").alias("n"), F.min("doc").alias("doc")).where("n = 1")
        return counted.join(self.entries.select("k"), "k", "left_semi").select("doc", "k")

    def unused(self, used: DataFrame) -> DataFrame:
        """Keys with owners, none of which is in use."""
        live = self.owners.join(used.select("doc"), "doc", "left_semi").select("k")
        return self.entries.join(self.owners.select("k"), "k", "left_semi").join(live, "k", "left_anti").select("k")

    def untracked(self) -> DataFrame:
        return self.entries.join(self.owners.select("k"), "k", "left_anti").select("k")

    # changes
    def upsert(self, new: DataFrame) -> Store:
        """Insert or replace: a stored entry's flag is cleared and its order is new."""
        top = F.coalesce(F.max("seq"), F.lit(0)).alias("top")
        fresh = numbered(new.dropDuplicates(["k"]).select("k", "v"), F.col("k")).withColumn("ok", F.lit(False))
        fresh = fresh.crossJoin(self.entries.agg(top)).select("k", "v", "ok", (F.col("top") + F.col("ord")).alias("seq"))  # one row
        return Store(self.entries.join(fresh.select("k"), "k", "left_anti").unionByName(fresh), self.owners)

    def add(self, new: DataFrame) -> Store:
        """Inserts verified results (k, v, _at) whose keys the store lacks, in the order of _at (a number from 0, with gaps).

        The values aren't moved, so entries that were stored as a table are read where they are, column by column.
        """
        top = self.entries.agg(F.coalesce(F.max("seq") + 1, F.lit(1)).alias("top"))  # one row
        fresh = new.join(F.broadcast(top)).select("k", "v", F.lit(True).alias("ok"), (F.col("top") + F.col("_at")).alias("seq"))
        return Store(self.entries.unionByName(fresh), self.owners)

    def claim(self, rows: DataFrame) -> Store:
        """Insert or ignore owners."""
        return Store(self.entries, self.owners.unionByName(rows.select("doc", "k")).dropDuplicates(["doc", "k"]))

    def mark(self, keys: DataFrame) -> Store:
        hit = keys.select("k", F.lit(True).alias("_hit")).dropDuplicates(["k"])
        e = self.entries.join(hit, "k", "left").withColumn("ok", F.col("ok") | F.coalesce("_hit", F.lit(False))).drop("_hit")
        return Store(e, self.owners)

    def delete(self, keys: DataFrame) -> Store:
        return Store(self.entries.join(keys.select("k"), "k", "left_anti"), self.owners)

    def without(self, keys: DataFrame) -> Store:
        """The same for keys that may well be none or few: they are counted, and entries are moved for many only."""
        gone = small(keys.select("k"))
        return self.delete(gone) if gone.limit(1).count() else self

    def purge(self, doc) -> Store:
        """Deletes all that a document owns, and every owner of it."""
        keys = self.owners.where(F.col("doc") == doc).select("k")
        return Store(self.entries.join(keys, "k", "left_anti"), self.owners.join(keys, "k", "left_anti"))

    def purge_only(self, doc) -> Store:
        """Deletes what a document alone owns, and its owner rows."""
        keys = self.only().where(F.col("doc") == doc).select("k")
        return Store(self.entries.join(keys, "k", "left_anti"), self.owners.where(F.col("doc") != doc))

    def purge_unused(self, used: DataFrame) -> Store:
        """Deletes unused keys, then owners whose key is gone."""
        left = self.entries.join(self.unused(used), "k", "left_anti")
        return Store(left, self.owners.join(left.select("k"), "k", "left_semi"))

    def overlay(self, edits: DataFrame) -> DataFrame:
        """Entries as they read under uncommitted edits (k, v): hits are replaced, misses stay misses."""
        return self.entries.join(edits.select("k", F.col("v").alias("_v")), "k", "left").withColumn("v", F.coalesce("_v", "v")).drop("_v")

    def victims(self, most: int, protect_from: int) -> DataFrame:
        """(k, rank) of the rows to delete when there are more than ``most``: down to 90 % of it, oldest first.

        Rows without an owner go first; rows from ``protect_from`` on (the write under way) go last. Ranks are cut by a
        count of the table, and the order is global, so Spark plans it as a sort and a limit, not as one partition.
        """
        n = self.entries.count()
        surplus = n - most + most // 10 if n > most else 0
        owned = self.owners.select("k").distinct().withColumn("_owned", F.lit(1))
        e = self.entries.join(owned, "k", "left").withColumn("late", (F.col("seq") >= protect_from).cast("int")).withColumn("_owned", F.coalesce("_owned", F.lit(0)))
        return e.orderBy("late", "_owned", "seq").limit(surplus).select("k", "seq")

    def evict(self, most: int, protect_from: int) -> Store:
        return self.delete(self.victims(most, protect_from))

    def save(self, path: str) -> None:
        self.entries.write.mode("overwrite").parquet(f"{path}/entries")
        self.owners.write.mode("overwrite").parquet(f"{path}/owners")


def derived(spark: SparkSession, sf_dir: str) -> tuple[Store, DataFrame]:
    """A store made of the documents: an entry a distinct line with letters, owned by the sources of its documents.

    Lines whose key starts with '0' have no owner. Every second source (by number) is in use.
    """
    d = table(spark, sf_dir, "documents")
    s = segments(d).where(X.has_letters(F.col("text"))).join(d.select("doc_id", "source"), "doc_id")
    k = X.cache_key(F.lit("svc:mock:en:de"), F.col("text"))
    entries = s.groupBy(k.alias("k")).agg(F.upper(F.min("text")).alias("v"), (F.min("doc_id") * 100_000 + F.min("seg_no")).alias("seq")).withColumn("ok", F.substring("k", 2, 1) < "8")
    owners = s.select(F.col("source").alias("doc"), k.alias("k")).where("substring(k, 1, 1) <> '0'").distinct()
    used = d.select(F.col("source").alias("doc")).distinct().where("cast(substring(doc, 4) as int) % 2 = 0")
    return Store(entries, owners), used


def cache_only_owned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir)[0].only().groupBy("doc").agg(F.count(F.lit(1)).alias("n"))


def cache_unused(spark: SparkSession, sf_dir: str) -> DataFrame:
    st, used = derived(spark, sf_dir)
    return st.unused(used).withColumn("state", F.lit("unused")).unionByName(st.untracked().withColumn("state", F.lit("untracked")))


def cache_evict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived(spark, sf_dir)[0].victims(200, 500 * 100_000).select("k")


def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Needed keys by state: verified, unverified or missing (those of documents under another target language are)."""
    st, _ = derived(spark, sf_dir)
    s = segments(table(spark, sf_dir, "documents"))
    need = s.select("doc_id", X.cache_key(F.when(F.col("doc_id") % 2 == 0, F.lit("svc:mock:en:de")).otherwise(F.lit("svc:mock:en:fr")), F.col("text")).alias("k")).distinct()
    hit = st.lookup(need).groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.count_if("ok").alias("verified"))
    miss = st.misses(need).groupBy("doc_id").agg(F.count(F.lit(1)).alias("misses"))
    return hit.join(miss, "doc_id", "full_outer").select("doc_id", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("hits", "verified", "misses")])


def cache_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries and owners left after each kind of purge."""
    st, used = derived(spark, sf_dir)
    keys = st.entries.where("substring(k, 1, 1) = 'a'").select("k")
    new = keys.withColumn("v", F.lit("new"))
    stores = {"purge": st.purge("src0"), "purge_only": st.purge_only("src0"), "purge_unused": st.purge_unused(used), "delete": st.delete(keys), "upsert": st.upsert(new), "mark": st.mark(keys), "claim": st.claim(keys.withColumn("doc", F.lit("src0")))}
    out = None
    for name, s in stores.items():
        row = s.entries.agg(F.count(F.lit(1)).alias("entries"), F.count_if("ok").alias("ok")).crossJoin(s.owners.agg(F.count(F.lit(1)).alias("owners"))).withColumn("step", F.lit(name))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


_DER = """seg AS (SELECT d.doc_id, d.source, i - 1 AS seg_no, trim(l[i], ' ') AS text FROM (SELECT doc_id, source, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL) d, unnest(range(1, len(l) + 1)) AS r(i) WHERE trim(l[i], ' ') <> ''),
s AS (SELECT *, sha1('svc:mock:en:de' || chr(10) || text) AS k FROM seg WHERE regexp_matches(text, '\\p{L}')),
entries AS (SELECT k, upper(min(text)) AS v, min(doc_id) * 100000 + min(seg_no) AS seq, substring(k, 2, 1) < '8' AS ok FROM s GROUP BY k),
owners AS (SELECT DISTINCT source AS doc, k FROM s WHERE substring(k, 1, 1) <> '0'),
used AS (SELECT DISTINCT source AS doc FROM documents WHERE CAST(substring(source, 4) AS INT) % 2 = 0),
only_ AS (SELECT o.doc, o.k FROM owners o JOIN entries e USING (k) WHERE NOT EXISTS (SELECT 1 FROM owners x WHERE x.k = o.k AND x.doc <> o.doc)),
unused AS (SELECT k FROM entries WHERE k IN (SELECT k FROM owners) AND k NOT IN (SELECT o.k FROM owners o JOIN used u ON o.doc = u.doc)),
a AS (SELECT k FROM entries WHERE substring(k, 1, 1) = 'a')"""

ORACLE = {
    "cache_only_owned": f"WITH {_DER} SELECT doc, count(*) AS n FROM only_ GROUP BY doc",
    "cache_unused": f"WITH {_DER} SELECT k, 'unused' AS state FROM unused UNION ALL SELECT k, 'untracked' FROM entries WHERE k NOT IN (SELECT k FROM owners)",
    "cache_evict": f"WITH {_DER}, n AS (SELECT count(*) AS n FROM entries), r AS (SELECT k, row_number() OVER (ORDER BY CASE WHEN seq >= 50000000 THEN 1 ELSE 0 END, CASE WHEN k IN (SELECT k FROM owners) THEN 1 ELSE 0 END, seq) AS rn FROM entries) SELECT k FROM r, n WHERE n > 200 AND rn <= n - 200 + 20",
    "cache_lookup": f"WITH {_DER}, need AS (SELECT DISTINCT doc_id, sha1(CASE WHEN doc_id % 2 = 0 THEN 'svc:mock:en:de' ELSE 'svc:mock:en:fr' END || chr(10) || text) AS k FROM seg) SELECT doc_id, count(e.k) AS hits, count(*) FILTER (e.ok) AS verified, count(*) FILTER (e.k IS NULL) AS misses FROM need LEFT JOIN entries e USING (k) GROUP BY doc_id",
    "cache_after": f"""WITH {_DER}, p AS (SELECT k FROM owners WHERE doc = 'src0'), q AS (SELECT k FROM only_ WHERE doc = 'src0'), ne AS (SELECT count(*) AS n FROM entries), no_ AS (SELECT count(*) AS n FROM owners)
SELECT 'purge' AS step, (SELECT count(*) FROM entries WHERE k NOT IN (SELECT k FROM p)) AS entries, (SELECT count(*) FROM entries WHERE ok AND k NOT IN (SELECT k FROM p)) AS ok, (SELECT count(*) FROM owners WHERE k NOT IN (SELECT k FROM p)) AS owners
UNION ALL SELECT 'purge_only', (SELECT count(*) FROM entries WHERE k NOT IN (SELECT k FROM q)), (SELECT count(*) FROM entries WHERE ok AND k NOT IN (SELECT k FROM q)), (SELECT count(*) FROM owners WHERE doc <> 'src0')
UNION ALL SELECT 'purge_unused', (SELECT count(*) FROM entries WHERE k NOT IN (SELECT k FROM unused)), (SELECT count(*) FROM entries WHERE ok AND k NOT IN (SELECT k FROM unused)), (SELECT count(*) FROM owners WHERE k NOT IN (SELECT k FROM unused))
UNION ALL SELECT 'delete', (SELECT count(*) FROM entries WHERE k NOT IN (SELECT k FROM a)), (SELECT count(*) FROM entries WHERE ok AND k NOT IN (SELECT k FROM a)), (SELECT n FROM no_)
UNION ALL SELECT 'upsert', (SELECT n FROM ne), (SELECT count(*) FROM entries WHERE ok AND k NOT IN (SELECT k FROM a)), (SELECT n FROM no_)
UNION ALL SELECT 'mark', (SELECT n FROM ne), (SELECT count(*) FROM entries WHERE ok OR k IN (SELECT k FROM a)), (SELECT n FROM no_)
UNION ALL SELECT 'claim', (SELECT n FROM ne), (SELECT count(*) FROM entries WHERE ok), (SELECT count(*) FROM (SELECT doc, k FROM owners UNION SELECT 'src0', k FROM a))""",
}
QUERIES = {"cache_only_owned": cache_only_owned, "cache_unused": cache_unused, "cache_evict": cache_evict, "cache_lookup": cache_lookup, "cache_after": cache_after}
