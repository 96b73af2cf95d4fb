"""Substring dedup by a log-structured fingerprint index.

Documents come in batches. The index, a folder that outlives the call, holds sorted immutable runs of the window
fingerprints of past batches (winnowed: of each window of 13 words, the least 5-word hashes) with the chunks of text that
have them, and those chunks. The sorted fingerprints of a new batch are merge-joined with each run, bucket by bucket; runs
are bucketed tables, so the past is never shuffled. What both have is a candidate, which ``matching`` verifies on the words
of whole windows. The batch then becomes a run, and runs of one level are merged into one of the next.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common, matching, suffixes

LENGTH, GRAM = 13, 5
#: Batches that the query makes of its table, by ranges of doc_id, and runs of a level that are merged into one.
BATCHES, FAN_OUT = 3, 2
#: Bytes of text whose postings make a bucket, where the call makes the index.
BUCKET = 24e6
#: Postings in a row of a run: a bucket of a run is several rows, in order.
ROW = 64 << 10
RUN = "bucket int, seq int, h binary, chunk binary, mark binary"
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept binary"


class FingerprintIndex:
    """Runs of sorted postings (fingerprint, chunk, mark) and the chunks, as Parquet in the folder ``root``.

    ``add`` judges a batch against all that was added before and against itself, and returns its rows. A manifest names
    the live tables; it is written last, so a call that fails leaves the index as it was. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int | None = None, length: int = LENGTH, gram: int = GRAM, fan_out: int = FAN_OUT):
        self.spark, self.root, self.fan_out = spark, root.rstrip("/"), fan_out
        self.parts, self.spec = parts or common.partitions(spark), matching.Spec("words", length, gram)
        self.runs: list[tuple[int, str]] = []  # level, path
        self.chunks: list[str] = []

    @classmethod
    def open(cls, spark: SparkSession, root: str) -> FingerprintIndex:
        rows = spark.read.parquet(f"{root.rstrip('/')}/manifest").collect()  # a row a live table
        head = next(r for r in rows if r["kind"] == "index")
        out = cls(spark, root, head["parts"], head["length"], head["gram"], head["fan_out"])
        of = lambda kind: sorted((r["ord"], r["level"], r["path"]) for r in rows if r["kind"] == kind)
        out.runs, out.chunks = [(level, path) for _, level, path in of("run")], [path for _, _, path in of("chunks")]
        return out

    def _save(self) -> None:
        rows = [("index", 0, 0, "")] + [("run", i, level, path) for i, (level, path) in enumerate(self.runs)] + [("chunks", i, 0, path) for i, path in enumerate(self.chunks)]
        d = self.spark.createDataFrame([(*r, self.parts, self.spec.length, self.spec.gram, self.fan_out) for r in rows], "kind string, ord int, level int, path string, parts int, length int, gram int, fan_out int")
        d.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/manifest")

    def _path(self, kind: str) -> str:
        return f"{self.root}/{kind}-{uuid.uuid4().hex[:12]}"

    def _run(self, path: str) -> DataFrame:
        return matching.bucketed_at(self.spark, path, "bucket", self.parts)

    def add(self, docs: DataFrame, scratch: common.Scratch) -> DataFrame:
        """docs: doc_id, text. Rows of RESULT for them; see ``remove_known``."""
        spec, parts = self.spec, self.parts
        chunks = matching.chunk_table(docs, at := self._path("chunks"), parts, len(self.chunks))
        past = [matching.bucketed_at(self.spark, path, "chunk", parts) for path in self.chunks]
        with scratch.last_use():
            run = matching.bucketed(matching.ask_anchors(chunks, spec, parts).groupBy("bucket").applyInArrow(_sorted_run, RUN), new := self._path("run"), "bucket", parts)
        found = run.groupBy("bucket").applyInArrow(_twice, matching.MAIL)
        for _, path in self.runs:
            found = found.unionByName(run.groupBy("bucket").cogroup(self._run(path).groupBy("bucket")).applyInArrow(_merge_join, matching.MAIL))
        shared = scratch.table(matching.at_buckets(found, parts, _answers), f"shared-{len(self.chunks)}")
        out = matching.verify_and_finish(chunks, shared, spec, scratch, parts, _finish, RESULT, suffixes.repeated, past)
        self.chunks.append(at)
        self.runs.append((0, new))
        self._compact(scratch)
        self._save()
        scratch.tidy()
        return out

    def _compact(self, scratch: common.Scratch) -> None:
        """Merges runs while the last level holds fan_out of them. Merged runs are superseded, not changed."""
        while len(same := [r for r in self.runs if r[0] == self.runs[-1][0]]) >= self.fan_out:
            first, *rest = (self._run(path) for _, path in same)
            for more in rest:
                first = first.groupBy("bucket").cogroup(more.groupBy("bucket")).applyInArrow(_merge_runs, RUN)
            with scratch.last_use():
                matching.bucketed(first, path := self._path("run"), "bucket", self.parts)
            self.runs = [r for r in self.runs if r not in same] + [(same[0][0] + 1, path)]


def _rows(bucket: int, h: np.ndarray, chunk: np.ndarray, mark: np.ndarray) -> pa.Table:
    at = range(0, len(h), ROW)
    cut = lambda x: pa.array([x[i : i + ROW].tobytes() for i in at], pa.binary())
    return pa.table({"bucket": pa.array([bucket] * len(at), pa.int32()), "seq": pa.array(range(len(at)), pa.int32()), "h": cut(h), "chunk": cut(chunk), "mark": cut(mark)})


def _postings(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A bucket of a run, in its order."""
    order = np.argsort(t.column("seq").to_numpy(), kind="stable")
    return tuple(np.frombuffer(b"".join(t.column(c)[i].as_py() for i in order.tolist()), kind) for c, kind in (("h", "u8"), ("chunk", "i8"), ("mark", "u1")))


def _sorted_run(t: pa.Table) -> pa.Table:
    """A batch's postings of one bucket, sorted."""
    h, row = matching.spread(t.column("a").to_pylist(), "u8")
    mark, chunk = matching.spread(t.column("b").to_pylist(), "u1")[0], t.column("chunk").to_numpy()[row]
    order = np.lexsort((chunk, h))
    return _rows(t.column("bucket")[0].as_py(), h[order], chunk[order], mark[order])


def _row(bucket: int, h: np.ndarray, chunk: np.ndarray, mark: np.ndarray) -> pa.Table:
    """Postings as one row of mail to their bucket."""
    blobs = {c: pa.array([x.tobytes()], pa.binary()) for c, x in zip("abc", (h, chunk, mark), strict=True)}
    return pa.table({"kind": pa.array([0], pa.int32()), "bucket": pa.array([bucket], pa.int32()), "chunk": pa.array([0], pa.int64()), **blobs, "d": pa.array([b""], pa.binary())})


def _twice(run: pa.Table) -> pa.Table:
    """Postings of a bucket that two documents of the batch share."""
    h, chunk, mark = _postings(run)
    starts = matching.firsts(h)
    size = np.diff(np.append(starts, len(h)))
    on = np.repeat((size > 1) | (np.maximum.reduceat(mark, starts) >= matching.TWO_DOCS), size)
    return _row(run.column("bucket")[0].as_py(), h[on], chunk[on], mark[on])


def _merge_join(new: pa.Table, old: pa.Table) -> pa.Table:
    """Postings of both whose fingerprint both have: two sorted lists, each looked up in the other."""
    if not (new.num_rows and old.num_rows):
        return _row(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint8)).slice(0, 0)
    a, b = _postings(new), _postings(old)
    x, y = matching.member(b[0], a[0]), matching.member(a[0], b[0])
    return _row(new.column("bucket")[0].as_py(), *(np.concatenate([p[x], q[y]]) for p, q in zip(a, b, strict=True)))


def _merge_runs(one: pa.Table, two: pa.Table) -> pa.Table:
    """Two sorted runs of a bucket as one: each posting's place is its own and the number of smaller ones in the other."""
    if not (one.num_rows and two.num_rows):
        return (one if one.num_rows else two).select(["bucket", "seq", "h", "chunk", "mark"])
    a, b = _postings(one), _postings(two)
    place = np.concatenate([np.arange(len(a[0])) + np.searchsorted(b[0], a[0]), np.arange(len(b[0])) + np.searchsorted(a[0], b[0], "right")])
    out = [np.empty(len(place), x.dtype) for x in a]
    for o, x, y in zip(out, a, b, strict=True):
        o[place] = np.concatenate([x, y])
    return _rows(one.column("bucket")[0].as_py(), *out)


def _answers(kind: int, chunks: np.ndarray, blobs: list[matching.Blobs]) -> Iterator[pa.RecordBatch | None]:
    """To each chunk its shared fingerprints, and whether they are hot: all chunks are told the same."""
    h, chunk, mark = (matching.spread(blobs[c], k)[0] for c, k in enumerate(("u8", "i8", "u1")))
    if not len(h):
        return
    order = np.lexsort((chunk, h))
    h, chunk, mark = h[order], chunk[order], mark[order]
    once = matching.firsts(h, chunk)  # found in several ways
    h, chunk, mark = h[once], chunk[once], mark[once]
    starts = matching.firsts(h)
    size = np.diff(np.append(starts, len(h)))
    hot = np.repeat(np.add.reduceat(np.exp2(mark & 0x7F), starts) > matching.HOT, size)
    yield from matching.answers(matching.SHARED, chunk, np.arange(len(h)), h, hot.astype(np.uint8))


def _finish(c: matching.Chunk, gone: np.ndarray) -> pa.RecordBatch:
    keep = np.flatnonzero(~gone)
    n = np.diff(c.start)[keep]  # each word with the space after it
    raw, ends = matching.spans_of(c.data, c.start[keep], n).tobytes(), np.cumsum(n)
    at = np.concatenate([[0], ends])[np.searchsorted(keep, c.offs)].tolist()
    text = [raw[a : b - 1] if b > a else b"" for a, b in zip(at[:-1], at[1:], strict=True)]
    removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[c.offs])
    return pa.record_batch({"doc_id": pa.array(c.ids, mask=c.ids == common.NO_ID), "n_words": pa.array(np.diff(c.offs)), "n_removed": pa.array(removed), "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in text]), "kept": pa.array(text, pa.binary())})


def remove_known(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM, batches: int = BATCHES, index: FingerprintIndex | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_removed, kept_sha256 and kept (kept words joined by one space).

    A word goes if a window of ``length`` words that covers it also starts in a document with a smaller doc_id; windows
    are judged on the input. Words are cut at white space and compared unchanged. A null or empty text has no words;
    texts of fewer words than ``length`` stay. Rows of one doc_id don't affect each other; rows that repeat whole have
    one result each; a null doc_id counts as larger than all others and comes in the last batch. Texts are taken whole;
    an empty table gives no rows; other columns are left out.

    With ``index`` (a FingerprintIndex, new or opened) the documents are added to it in ``batches`` batches, and judged
    against all that it holds as well. Rows that an earlier call returned are not revised, so documents should come in
    the order of their ids if all are to be judged as in one call; without it the index is new and of this call.
    """
    spark = docs.sparkSession
    common.tune(spark)
    scratch = common.Scratch(spark, "fingerprints")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size, cuts = d.agg(F.sum(F.octet_length("text")), F.percentile_approx("doc_id", [i / batches for i in range(1, batches)] or [1.0], 1000)).first()
    cuts = sorted(set(cuts or [])) if batches > 1 else []
    index = index or FingerprintIndex(spark, f"{scratch.root}/index", common.partitions(spark, size or 0, BUCKET), length, gram)
    number = sum((F.coalesce(F.col("doc_id") > c, F.lit(True)).cast("int") for c in cuts), F.lit(0))
    out = None
    for b in range(len(cuts) + 1):
        got = index.add(d.where(number == b), scratch)
        out = got if out is None else out.unionByName(got)
    return out


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_known(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
