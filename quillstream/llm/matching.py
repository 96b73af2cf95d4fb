"""Finding stretches of L tokens that also start in a document with a smaller id, over all documents.

Tokens are bytes or words. The search is exact and costs far less than comparing all stretches:

A. Winnowing picks anchors: of any L consecutive tokens, the k-grams with the least hash. Equal stretches hold equal
   anchors at equal places, so only stretches around an anchor that a second document has (a shared anchor) matter.
B. A context is all that can stand in a stretch with the anchor: L - k tokens before it and L from its start. The distinct
   contexts of a chunk of text go, with their text, to the bucket of their anchor.
C. There they are sorted as suffixes (see ``suffixes``), and equal ones are verified on their bytes. Contexts that a smaller
   document has whole go whole; of those that differ, the stretches are sorted in the same way, one place at a time.

An anchor with more than HOT contexts would make a bucket of unbounded work. Its stretches are dealt one by one instead,
by their own hash, and equal ones are verified on their bytes too: another way to the same answer, in smaller shares.

Every question (who else has this?) is put once a chunk of text, not once an occurrence, so a line that stands in a third
of all documents costs a task one row a chunk. Chunks are a table bucketed by chunk number: answers travel to the text,
the text itself is never shuffled whole.
"""

from __future__ import annotations

import itertools
import math
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

#: Bytes of text in a chunk. Under half a heap region, so that rows are no humongous objects to the executors.
CHUNK = 384 << 10
#: Contexts of an anchor (by an upper estimate) from which on its stretches are dealt one by one instead of by anchor.
HOT = 8192
#: Contexts that are sorted at once, and spans whose bytes are compared at once.
SLICE, SPANS = 16384, 20_000
_K1, _K2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


@dataclass(frozen=True)
class Spec:
    unit: str  # "bytes" or "words"
    length: int
    gram: int


# --- chunks -------------------------------------------------------------------------------------------------------------
def chunk_table(docs: DataFrame, path: str, parts: int, batch: int = 0) -> DataFrame:
    """docs (doc_id, text) packed into rows of about CHUNK bytes, Parquet at ``path`` bucketed by chunk.

    A task numbers its chunks so that some at a time fall into one bucket, and then goes on to another: a bucket's size
    hangs on ``parts`` alone, not on how much text the input's files give to a task, and nothing is shuffled. ``batch``
    sets the numbers of several tables apart.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = chunk_ids(TaskContext.get().partitionId(), parts, batch)
        ids, texts, size = [], [], 0

        def row() -> pa.RecordBatch:
            order = np.argsort(np.array(ids), kind="stable").tolist()
            offs = np.cumsum([0] + [len(texts[i]) for i in order])
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)]), pa.array([np.array(ids)[order].tobytes()], pa.binary()), pa.array([offs.tobytes()], pa.binary()), pa.array([b"".join(texts[i] for i in order)], pa.binary())], names=["chunk", "ids", "offs", "text"])

        for got in batches:
            data, offs = common.utf8(got.column(1))
            raw, o = data.tobytes(), offs.tolist()
            for i, doc in enumerate(common.ids(got.column(0)).tolist()):
                ids.append(doc)
                texts.append(raw[o[i] : o[i + 1]])
                size += o[i + 1] - o[i]
                if size >= CHUNK:
                    yield row()
                    ids, texts, size = [], [], 0
        if ids:
            yield row()

    made = docs.select("doc_id", "text").mapInArrow(pack, "chunk long, ids binary, offs binary, text binary")
    some = [next(bucket_ids(k, k, parts)) for k in range(min(parts, 8))]
    if docs.sparkSession.range(1).select(*[F.pmod(F.hash(F.lit(n).cast("long")), F.lit(parts)).alias(f"b{k}") for k, n in enumerate(some)]).first() != tuple(range(len(some))):
        raise RuntimeError("chunk numbers don't follow Spark's bucket hash")
    return bucketed(made, path, "chunk", parts)


def bucketed(df: DataFrame, path: str, key: str, parts: int) -> DataFrame:
    """Writes df as Parquet bucketed by key."""
    name = f"quill_{uuid.uuid4().hex[:12]}"
    df.write.option("path", path).option("compression", "zstd").bucketBy(parts, key).saveAsTable(name)
    return _dropped(df.sparkSession, name)


def bucketed_at(spark: SparkSession, path: str, key: str, parts: int) -> DataFrame:
    """Reads what ``bucketed`` wrote."""
    name, columns = f"quill_{uuid.uuid4().hex[:12]}", spark.read.parquet(path).schema
    spark.sql(f"CREATE TABLE {name} ({', '.join(f'{c.name} {c.dataType.simpleString()}' for c in columns)}) USING parquet CLUSTERED BY ({key}) INTO {parts} BUCKETS LOCATION '{path}'")
    return _dropped(spark, name)


def _dropped(spark: SparkSession, name: str) -> DataFrame:
    """The table is external: without its name the plan keeps the files and their bucketing, the catalog nothing."""
    out = spark.table(name)
    out.schema  # noqa: B018  resolved while the name is there
    spark.sql(f"DROP TABLE {name}")
    return out


#: Bits of a chunk number: 32 that set its bucket, then the task, then the batch.
PART_BITS = 20


#: Chunks that a task gives to a bucket before it goes on to another.
RUN_OF_CHUNKS = 16


def chunk_ids(part: int, buckets: int, batch: int = 0) -> Iterator[int]:
    """Distinct numbers of a task, RUN_OF_CHUNKS at a time of one bucket. Steps of the golden section spread any number of
    tasks of any length evenly."""
    step = next(k for k in range(max(1, round(buckets * 0.618)), 2 * buckets + 1) if math.gcd(k, buckets) == 1)
    of: dict[int, Iterator[int]] = {}
    bucket = part % buckets
    while True:
        numbers = of.setdefault(bucket, bucket_ids(part, bucket, buckets, batch))
        yield from itertools.islice(numbers, RUN_OF_CHUNKS)
        bucket = (bucket + step) % buckets


def bucket_ids(part: int, bucket: int, buckets: int, batch: int = 0) -> Iterator[int]:
    """Distinct numbers of a task, all of the bucket that Spark's hash (Murmur3 of a long, seed 42) gives ``bucket``."""
    rot = lambda x, r: (x << np.uint32(r)) | (x >> np.uint32(32 - r))
    m1, m2 = np.uint32(0xCC9E2D51), np.uint32(0x1B873593)
    high = np.uint32(batch << PART_BITS | part)
    at, step = 0, max(1024, 4 * buckets)
    while True:
        low = np.arange(at, at + step, dtype=np.uint32)
        h = np.full(step, 42, np.uint32)
        for k in (low, np.full(step, high, np.uint32)):
            h = rot(h ^ (rot(k * m1, 15) * m2), 13) * np.uint32(5) + np.uint32(0xE6546B64)
        h ^= np.uint32(8)
        h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
        h = (h ^ (h >> np.uint32(16))).view(np.int32).astype(np.int64)
        for k in np.flatnonzero(h % buckets == bucket).tolist():
            yield (int(high) << 32) | int(low[k])
        at += step


def parts_for(chunks: DataFrame, each: int = 16 << 20) -> int:
    """Buckets for questions: about one for ``each`` bytes of text, and enough for the session's cores."""
    return max(chunks.sparkSession.sparkContext.defaultParallelism, -(-chunks.count() * CHUNK // each))


class Chunk:
    """One chunk's tokens; everything that the steps need of it, computed on demand.

    Of words, ``data`` holds their bytes with one space after each, so equal stretches of words have equal bytes.
    """

    def __init__(self, ids: bytes, offs: bytes, text: bytes, spec: Spec):
        self.spec = spec
        self.ids, self.byte_offs, self.data = np.frombuffer(ids, np.int64), np.frombuffer(offs, np.int64), np.frombuffer(text, np.uint8)
        if spec.unit == "words":
            start, end, self.offs = common.words(self.data, self.byte_offs) if len(self.data) else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(self.byte_offs), np.int64))
            n = end - start + 1
            ends = np.cumsum(n)
            self.data = np.append(self.data, np.uint8(0x20))[np.repeat(start - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
            self.data[ends - 1] = 0x20
            self.start = np.append(ends - n, len(self.data))
        else:
            self.offs, self.start = self.byte_offs, np.arange(len(self.data) + 1)
        self.n = int(self.offs[-1])

    def anchors(self) -> None:
        """pos, doc and hash (h) of the anchors."""
        spec, n = self.spec, self.n
        self.hash = common.Prefixes(token_values(self.data, self.start))
        length, k, w = spec.length, spec.gram, spec.length - spec.gram + 1
        if n < length:
            self.pos, self.h, self.doc = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
            return
        g = common.mix(self.hash.grams(k))
        rank = (g >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
        least = sliding(np.minimum, rank, w)
        across = np.zeros(n - length + 2, np.int32)  # stretches that would cross from one document to the next
        np.add.at(across, np.clip(self.offs[1:-1] - length + 1, 0, n - length + 1), 1)
        np.add.at(across, np.clip(self.offs[1:-1], 0, n - length + 1), -1)
        least[np.cumsum(across[:-1]) > 0] = 0
        pad = np.zeros(w - 1, np.uint32)
        self.pos = np.flatnonzero(sliding(np.maximum, np.concatenate([pad, least, pad]), w) == rank)
        self.h = g[self.pos]
        self.doc = np.searchsorted(self.offs, self.pos, "right") - 1

    def among(self, keys: np.ndarray) -> tuple[np.ndarray, ...]:
        """begin, end, place and hash of the anchor, and id of the contexts of the anchors whose hash is in keys."""
        on = member(keys, self.h)
        pos, doc, s = self.pos[on], self.doc[on], self.spec
        begin = np.maximum(self.offs[doc], pos - (s.length - s.gram))
        end = np.minimum(self.offs[doc + 1], pos + s.length)
        return begin, end, pos, self.h[on], self.ids[doc]

    def contexts(self, keys: np.ndarray) -> Runs:
        begin, end, pos, h, ids = self.among(keys)
        salt = (pos - begin).astype(np.uint64) * _K1 + (end - pos).astype(np.uint64) * _K2
        return Runs(self, begin, end, pos, h, ids, common.mix(self.hash.of(begin, end) + salt))

    def stretches(self, keys: np.ndarray) -> Runs:
        """Every stretch with one of the anchors."""
        begin, end, _, _, ids = self.among(keys)
        n = end - begin - self.spec.length + 1
        s, at = np.unique(np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum()), return_index=True)
        h = common.mix(self.hash.of(s, s + self.spec.length))
        return Runs(self, s, s + self.spec.length, s, h, np.repeat(ids, n)[at], h)


class Runs:
    """Equal stretches of a chunk together: ``order`` sorts them, a run begins at each of ``starts``, its least id first.

    Equal means equal bytes: neighbours of one hash are compared. The order depends on the chunk alone, so a run's number
    means the same in every step.
    """

    def __init__(self, c: Chunk, begin: np.ndarray, end: np.ndarray, pos: np.ndarray, h: np.ndarray, ids: np.ndarray, code: np.ndarray):
        self.begin, self.end, self.pos, self.h, self.ids = begin, end, pos, h, ids
        self.order = order = np.lexsort((begin, ids, code))
        a, b = c.start[begin[order]], c.start[end[order]]
        new = np.ones(len(order), bool)
        if len(order):
            near = code[order][1:] == code[order][:-1]
            near[near] = same_bytes(c.data, a[1:][near], a[:-1][near], (b - a)[1:][near], (b - a)[:-1][near])
            near &= (pos - begin)[order][1:] == (pos - begin)[order][:-1]
            new[1:] = ~near
        self.starts = np.flatnonzero(new)
        self.size = np.diff(np.append(self.starts, len(order)))
        self.first = order[self.starts]

    def known(self) -> np.ndarray:
        """Those of larger ids than the least of their run."""
        out = np.zeros(len(self.order), bool)
        out[self.order] = self.ids[self.order] > np.repeat(self.ids[self.first], self.size)
        return out

    def members(self, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All of the runs of these numbers, and for each the place in ``number``."""
        n = self.size[number]
        return self.order[np.repeat(self.starts[number] - np.cumsum(n) + n, n) + np.arange(n.sum())], np.repeat(np.arange(len(number)), n)


def token_values(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """A 64-bit value for each token: of a byte from a table, of a word (with one space after it) its hash."""
    if len(start) == len(data) + 1:
        return common.BYTE_VALUES[data]
    return common.word_hashes(data, start[:-1], start[1:] - 1)


def same_bytes(data: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Whether the spans at a (of n bytes) and at b (of m) hold the same bytes."""
    out = n == m
    for at in range(0, len(a), SPANS):
        k = at + np.flatnonzero(out[at : at + SPANS] & (n[at : at + SPANS] > 0))
        if len(k):
            ends = np.cumsum(n[k])
            inner = np.arange(ends[-1]) - np.repeat(ends - n[k], n[k])
            differ = data[np.repeat(a[k], n[k]) + inner] != data[np.repeat(b[k], n[k]) + inner]
            out[k] = np.add.reduceat(differ, ends - n[k], dtype=np.int64) == 0
    return out


def spans_of(data: np.ndarray, begin: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The bytes of spans, one after the other."""
    ends = np.cumsum(n)
    return data[np.repeat(begin - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def sliding(op: np.ufunc, a: np.ndarray, w: int) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    span = 1
    while span * 2 <= w:
        a = op(a[:-span], a[span:])
        span *= 2
    return op(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def member(keys: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which x are among the sorted keys."""
    if not len(keys):
        return np.zeros(len(x), bool)
    return keys[np.minimum(np.searchsorted(keys, x), len(keys) - 1)] == x


def firsts(*cols: np.ndarray) -> np.ndarray:
    """Starts of runs of equal rows of sorted columns."""
    new = np.ones(len(cols[0]), bool)
    if len(new):
        new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


# --- mail -----------------------------------------------------------------------------------------------------------------
MAIL = "kind int, bucket int, chunk long, a binary, b binary, c binary, d binary"


def by_bucket(kind: int, chunk: int, parts: int, *cols: np.ndarray) -> pa.RecordBatch | None:
    """Rows of parallel arrays split by bucket of the first, a hash."""
    if not len(cols[0]):
        return None
    bucket = (cols[0] % np.uint64(parts)).astype(np.uint16 if parts < 65536 else np.int64)
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
    on = np.flatnonzero(np.diff(cuts)).tolist()
    blobs = [[c[order][cuts[b] : cuts[b + 1]].tobytes() for b in on] for c in cols] + [[b""] * len(on)] * (4 - len(cols))
    return pa.RecordBatch.from_arrays([pa.array([kind] * len(on), pa.int32()), pa.array(on, pa.int32()), pa.array([chunk] * len(on), pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["kind", "bucket", "chunk", "a", "b", "c", "d"])


def to_chunk(kind: int, chunks: list[int], blobs: list[list[bytes]]) -> pa.RecordBatch:
    n = len(chunks)
    blobs = blobs + [[b""] * n] * (4 - len(blobs))
    return pa.RecordBatch.from_arrays([pa.array([kind] * n, pa.int32()), pa.array([-1] * n, pa.int32()), pa.array(chunks, pa.int64()), *(pa.array(x, pa.binary()) for x in blobs)], names=["kind", "bucket", "chunk", "a", "b", "c", "d"])


class Blobs:
    """A column of blobs, one after the other, and their sizes: no second copy when they are read as one array."""

    def __init__(self) -> None:
        self.data, self.sizes = bytearray(), []

    def add(self, column: pa.Array) -> None:
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, np.int64 if pa.types.is_large_binary(column.type) else np.int32)[column.offset : column.offset + len(column) + 1]
        if data is not None:
            self.data += memoryview(data)[int(o[0]) : int(o[-1])]
        self.sizes.append(np.diff(o).astype(np.int64))


def at_buckets(mail: DataFrame, parts: int, fn: Callable[[int, np.ndarray, list[Blobs]], Iterator[pa.RecordBatch]]) -> DataFrame:
    """Brings all rows of a bucket together and calls fn(kind, chunks, blobs) once a bucket and kind.

    A task's buckets come one after the other, each kind of a bucket by itself, so it holds one of them at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, chunks, blobs = None, [], [Blobs() for _ in range(4)]

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal chunks, blobs
            if chunks:
                got, rows = np.array(chunks, np.int64), blobs
                chunks, blobs = [], [Blobs() for _ in range(4)]
                for out in fn(now[0], got, rows):
                    if out is not None:
                        yield out

        for batch in batches:
            kind, bucket = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.append(firsts(kind, bucket), len(kind)).tolist()
            for s, e in zip(edges[:-1], edges[1:], strict=True):
                if (int(kind[s]), int(bucket[s])) != now:
                    yield from done()
                    now = int(kind[s]), int(bucket[s])
                part = batch.slice(s, e - s)
                chunks += part.column(2).to_pylist()
                for c in range(4):
                    blobs[c].add(part.column(3 + c))
        yield from done()

    return mail.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind").mapInArrow(run, MAIL)


def spread(blobs: Blobs | list[bytes], dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """The blobs' values, and the number of the row of each."""
    size = np.dtype(dtype).itemsize
    if isinstance(blobs, Blobs):
        sizes = np.concatenate([np.zeros(0, np.int64), *blobs.sizes])
        return np.frombuffer(blobs.data, dtype), np.repeat(np.arange(len(sizes)), sizes // size)
    return np.frombuffer(b"".join(blobs), dtype), np.repeat(np.arange(len(blobs)), [len(x) // size for x in blobs])


def answers(kind: int, chunks: np.ndarray, row: np.ndarray, *cols: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Values back to the chunks that asked, one row a chunk."""
    if not len(row):
        return
    who = chunks[row]
    order = np.argsort(who, kind="stable")
    starts = firsts(who[order])
    ends = np.append(starts[1:], len(order))
    cols_ = [c[order] for c in cols]
    for at in range(0, len(starts), 256):
        part = list(zip(starts[at : at + 256].tolist(), ends[at : at + 256].tolist(), strict=True))
        yield to_chunk(kind, [int(who[order[s]]) for s, _ in part], [[c[s:e].tobytes() for s, e in part] for c in cols_])


def at_chunks(chunks: DataFrame, mail: list[DataFrame], fn: Callable[[int, tuple, dict[int, list[tuple]]], Iterator[pa.RecordBatch]], schema: str, how: str = "left") -> DataFrame:
    """Joins the answers to their chunks and calls fn(chunk, (ids, offs, text), {kind: rows of blobs})."""
    every = mail[0]
    for m in mail[1:]:
        every = every.unionByName(m)
    inbox = every.groupBy("chunk").agg(F.collect_list(F.struct("kind", "a", "b", "c", "d")).alias("mail"))
    joined = chunks.join(inbox.hint("shuffle_hash"), "chunk", how).select("chunk", "ids", "offs", "text", "mail")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, ids, offs, text, mail_ = (batch.column(c)[i].as_py() for c in range(5))
                box: dict[int, list[tuple]] = {}
                for m in mail_ or []:
                    box.setdefault(m["kind"], []).append((m["a"], m["b"], m["c"], m["d"]))
                for out in fn(chunk, (ids, offs, text), box):
                    if out is not None:
                        yield out

    return joined.mapInArrow(run, schema)


def joined(box: dict[int, list[tuple]], kind: int, col: int, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(m[col] for m in box.get(kind, [])), dtype)


# --- step A ---------------------------------------------------------------------------------------------------------------
ASK, SHARED = 0, 1
#: Of an anchor's mark in a chunk: two of its documents have it; the other bits are the rounded up logarithm of its number.
TWO_DOCS = 0x80


def ask_anchors(chunks: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """Each chunk's distinct anchor hashes with their marks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                chunk, ids, offs, text = (batch.column(c)[i].as_py() for c in range(4))
                c = Chunk(ids, offs, text, spec)
                c.anchors()
                order = np.argsort(c.h, kind="stable")
                h, doc = c.h[order], c.doc[order]
                at = firsts(h)
                if len(at):
                    end = np.append(at[1:], len(h))
                    mark = np.ceil(np.log2(end - at)).astype(np.uint8) | np.where(doc[at] != doc[end - 1], TWO_DOCS, 0).astype(np.uint8)
                    yield by_bucket(ASK, chunk, parts, h[at], mark)

    return chunks.select("chunk", "ids", "offs", "text").mapInArrow(run, MAIL)


def shared_anchors(mail: DataFrame, parts: int) -> DataFrame:
    """Answers: the hashes that a second document has, and whether they are hot."""

    def run(kind: int, chunks: np.ndarray, blobs: list[Blobs]) -> Iterator[pa.RecordBatch]:
        h, row = spread(blobs[0], "u8")
        mark, _ = spread(blobs[1], "u1")
        order = np.argsort(h, kind="stable")
        starts = firsts(h[order])
        size = np.diff(np.append(starts, len(h)))
        on = np.repeat((size > 1) | (np.maximum.reduceat(mark[order], starts) >= TWO_DOCS), size)
        hot = np.repeat(np.add.reduceat(np.exp2(mark[order] & 0x7F), starts) > HOT, size)
        yield from answers(SHARED, chunks, row[order[on]], h[order[on]], hot[on].astype(np.uint8))

    return at_buckets(mail, parts, run)


def told(box: dict[int, list[tuple]]) -> tuple[np.ndarray, np.ndarray]:
    """A chunk's shared anchors: those sorted by context, and the hot ones, dealt by stretch."""
    h, hot = joined(box, SHARED, 0, "u8"), joined(box, SHARED, 1, "u1")
    return np.setdiff1d(h, h[hot > 0]), np.unique(h[hot > 0])


# --- step B ---------------------------------------------------------------------------------------------------------------
CONTEXTS, STRETCHES, GONE_C, GONE_S = 2, 3, 4, 5


def ask_contexts(tables: list[DataFrame], shared: DataFrame, spec: Spec, parts: int) -> DataFrame:
    """The distinct contexts (and the stretches of hot anchors) of each chunk of the tables with their bytes, by bucket."""

    def rows(kind: int, chunk: int, c: Chunk, r: Runs) -> pa.RecordBatch | None:
        if not len(r.first):
            return None
        bucket = (r.h[r.first] % np.uint64(parts)).astype(np.int64)
        number = np.argsort(bucket, kind="stable")
        at, bucket = r.first[number], bucket[number]
        cuts = np.searchsorted(bucket, np.arange(parts + 1))
        on = np.flatnonzero(np.diff(cuts)).tolist()
        begin = c.start[r.begin[at]]
        n = c.start[r.end[at]] - begin
        text, sums = spans_of(c.data, begin, n), np.concatenate([[0], np.cumsum(n)])
        heads = np.stack([r.h[at].view(np.int64), r.ids[at]], 1)
        size = np.stack([r.pos[at] - r.begin[at], r.end[at] - r.pos[at]], 1).astype(np.uint16)
        marks = np.stack([number, n], 1).astype(np.uint32)
        cols = [[x[cuts[b] : cuts[b + 1]].tobytes() for b in on] for x in (heads, size, marks)] + [[text[sums[cuts[b]] : sums[cuts[b + 1]]].tobytes() for b in on]]
        return pa.RecordBatch.from_arrays([pa.array([kind] * len(on), pa.int32()), pa.array(on, pa.int32()), pa.array([chunk] * len(on), pa.int64()), *(pa.array(x, pa.binary()) for x in cols)], names=["kind", "bucket", "chunk", "a", "b", "c", "d"])

    def run(chunk: int, texts: tuple, box: dict) -> Iterator[pa.RecordBatch]:
        keys, hot = told(box)
        if len(keys) or len(hot):
            c = Chunk(*texts, spec)
            c.anchors()
            yield rows(CONTEXTS, chunk, c, c.contexts(keys))
            yield rows(STRETCHES, chunk, c, c.stretches(hot))

    out = at_chunks(tables[0], [shared], run, MAIL, "inner")
    for t in tables[1:]:
        out = out.unionByName(at_chunks(t, [shared], run, MAIL, "inner"))
    return out


# --- step C ---------------------------------------------------------------------------------------------------------------
class Pool:
    """Contexts (or stretches) of several chunks, their bytes one after the other, cut into tokens again."""

    def __init__(self, unit: str, heads: np.ndarray, size: np.ndarray, n_bytes: np.ndarray, data: np.ndarray):
        self.h, self.ids, self.left, self.right = heads[:, 0].view(np.uint64), heads[:, 1], size[:, 0].astype(np.int64), size[:, 1].astype(np.int64)
        self.data = data
        if unit == "words":
            self.start = np.concatenate([[0], np.flatnonzero(data == 0x20) + 1])
            self.begin = np.searchsorted(self.start, np.cumsum(n_bytes) - n_bytes)
        else:
            self.start = np.arange(len(data) + 1)
            self.begin = np.cumsum(n_bytes) - n_bytes

    def same(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether n tokens from a and from b on hold the same bytes."""
        x, y = self.start[a], self.start[b]
        return same_bytes(self.data, x, y, self.start[a + n] - x, self.start[b + n] - y)


def gone(mail: DataFrame, spec: Spec, parts: int, sort: Callable[[Pool, int], tuple]) -> DataFrame:
    """Answers: stretches that a smaller document has too, as ranges of places in a context, by its number in the chunk."""

    def run(kind: int, chunks: np.ndarray, blobs: list[Blobs]) -> Iterator[pa.RecordBatch]:
        heads, row = spread(blobs[0], "i8")
        heads, row = heads.reshape(-1, 2), row[::2]
        size, marks = spread(blobs[1], "u2")[0].reshape(-1, 2), spread(blobs[2], "u4")[0].reshape(-1, 2).astype(np.int64)
        text = np.frombuffer(blobs[3].data, np.uint8)
        blobs.clear()
        number, n = marks[:, 0], marks[:, 1]
        begin = np.cumsum(n) - n
        order = np.lexsort((heads[:, 1], heads[:, 0]))
        starts = np.append(firsts(heads[order, 0]), len(order))
        at, found = 0, []
        while at < len(starts) - 1:  # some anchors at a time, so that the sort's memory is bounded
            end = max(at + 1, int(np.searchsorted(starts, starts[at] + SLICE, "right")) - 1)
            k = order[starts[at] : starts[end]]
            pool = Pool(spec.unit, heads[k], size[k], n[k], spans_of(text, begin[k], n[k]))
            if kind == CONTEXTS:
                which, first, last = sort(pool, spec.length)
            else:
                which = later_copies(pool)
                first = last = which[:0]
            found.append((k[which], first.astype(np.uint16), last.astype(np.uint16)))
            at = end
        if found:  # one row a chunk, whatever the slices
            which, first, last = (np.concatenate(c) for c in zip(*found, strict=True))
            yield from answers(GONE_C if kind == CONTEXTS else GONE_S, chunks, row[which], number[which].astype(np.uint32), *([first, last] if kind == CONTEXTS else []))

    return at_buckets(mail, parts, run)


def later_copies(pool: Pool) -> np.ndarray:
    """Of stretches sorted by hash and id, those that one of a smaller id equals: neighbours of one hash are verified."""
    new = np.ones(len(pool.h), bool)
    near = np.flatnonzero(pool.h[1:] == pool.h[:-1]) + 1
    new[near] = ~pool.same(pool.begin[near], pool.begin[near - 1], pool.right[near])
    starts = np.flatnonzero(new)
    return np.flatnonzero(pool.ids > np.repeat(pool.ids[starts], np.diff(np.append(starts, len(new)))))


# --- the end --------------------------------------------------------------------------------------------------------------
def removed(c: Chunk, box: dict) -> np.ndarray:
    """Which of a chunk's tokens go."""
    edge = np.zeros(c.n + 1, np.int32)
    keys, hot = told(box)
    if len(keys) or len(hot):
        c.anchors()

        def cover(begin: np.ndarray, end: np.ndarray) -> None:
            np.add.at(edge, begin, 1)
            np.add.at(edge, end, -1)

        r = c.contexts(keys)
        here = r.known()
        cover(r.begin[here], r.end[here])
        which, place = r.members(joined(box, GONE_C, 0, "u4").astype(np.int64))
        first, last = joined(box, GONE_C, 1, "u2").astype(np.int64), joined(box, GONE_C, 2, "u2").astype(np.int64)
        cover(r.begin[which] + first[place], r.begin[which] + last[place] + c.spec.length)
        r = c.stretches(hot)
        here = r.known()
        here[r.members(joined(box, GONE_S, 0, "u4").astype(np.int64))[0]] = True
        cover(r.begin[here], r.end[here])
    return np.cumsum(edge[:-1]) > 0


def verify_and_finish(chunks: DataFrame, shared: DataFrame, spec: Spec, scratch: common.Scratch, parts: int, finish: Callable[[Chunk, np.ndarray], pa.RecordBatch], schema: str, sort: Callable[[Pool, int], tuple], past: list[DataFrame] | None = None) -> DataFrame:
    """Steps B and C for the shared anchors (a table of answers), and finish(chunk, removed tokens) for every chunk.

    ``past`` are further tables of chunks to compare with, for which nothing is finished.
    """
    answers_ = scratch.table(gone(ask_contexts([chunks, *(past or [])], shared, spec, parts), spec, parts, sort), f"gone-{uuid.uuid4().hex[:8]}")
    scratch.tidy()

    def run(chunk: int, texts: tuple, box: dict) -> Iterator[pa.RecordBatch]:
        c = Chunk(*texts, spec)
        yield finish(c, removed(c, box) if box else np.zeros(c.n, bool))

    return at_chunks(chunks, [shared, answers_], run, schema)
