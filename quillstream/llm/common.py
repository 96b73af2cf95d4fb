"""Shared plumbing of the training-data operators: scratch tables, Arrow buffers, grouped streaming.

Nothing outside ``quillstream.llm`` imports this module.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Word separators fixed by the operators' contracts: space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, *range(9, 14)]] = True
#: The sort position of a null document id: after all others.
NO_ID = np.int64(2**63 - 1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tune(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes, so that a batch of long texts can't exhaust a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")


class Scratch:
    """Intermediate tables of one operator call.

    ``put`` writes rows to the shared checkpoint folder and cuts the lineage; Spark deletes the files when nothing refers
    to them (with spark.cleaner.referenceTracking.cleanCheckpoints). ``keep`` holds rows that are read more than once
    on the executors' disks: no cut, lost blocks are computed anew.
    """

    def __init__(self, spark: SparkSession, name: str):
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if spark.sparkContext.master.split("[")[0] != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="quill-")  # all runs on this machine, as in tests
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(base)
        self.spark, self.root = spark, f"{base.rstrip('/')}/quill-{name}-{uuid.uuid4().hex[:12]}"

    @contextlib.contextmanager
    def last_use(self) -> Iterator[None]:
        """Shuffle files of what runs inside are deleted when it ends: the rows are written, nothing reads them again."""
        key, conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", self.spark.conf
        before = conf.get(key, None)
        conf.set(key, "true")
        try:
            yield
        finally:
            conf.unset(key) if before is None else conf.set(key, before)

    def put(self, df: DataFrame) -> DataFrame:
        with self.last_use():
            return df.checkpoint()

    def keep(self, df: DataFrame) -> DataFrame:
        return df.persist(StorageLevel.DISK_ONLY)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Written as Parquet and read again: compressed, and nothing of the plan before it is held."""
        with self.last_use():
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.root}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.root}/{name}")

    def tidy(self) -> None:
        """Lets Spark's cleaner delete files of plans that are over."""
        gc.collect()
        self.spark.sparkContext._jvm.System.gc()


def partitions(spark: SparkSession, n_bytes: float = 0, each: float = 16e6) -> int:
    """Shuffle partitions: the session's number, or more when ``n_bytes`` would make them larger than ``each``."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(n_bytes / each) + 1)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary array; a null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_binary(column.type):
        column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    b = np.frombuffer(data, dtype=np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def ids(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def powers(n: int, base: int = BASES[0]) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have[0]) < n:
        size = max(1 << 16, 1 << int(n).bit_length())
        out = []
        for b in (base, pow(base, -1, 2**64)):
            p = np.empty(size, np.uint64)
            p[0], done = 1, 1
            while done < size:
                step = min(done, size - done)
                p[done : done + step] = p[:step] * np.uint64(pow(b, done, 2**64))
                done += step
            out.append(p)
        _powers[base] = have = (out[0], out[1])
    return have


class Prefixes:
    """Prefix polynomial hashes of a sequence of 64-bit values: any stretch's hash in O(1)."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        up, self.down = powers(len(values) + 1, base)
        self.sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[: len(values)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def grams(self, k: int) -> np.ndarray:
        """Hashes of all stretches of k values."""
        n = len(self.sums) - k
        return (self.sums[k:] - self.sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


_rng = np.random.default_rng(20240229)
BYTE_VALUES = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and document offsets (in words) of the words of concatenated texts."""
    inner = ~IS_SPACE[data]
    first = inner.copy()
    first[1:] &= ~inner[:-1]
    bounds = offsets[1:-1]
    bounds = bounds[(bounds > 0) & (bounds < len(data))]
    first[bounds] = inner[bounds]
    last = inner.copy()
    last[:-1] &= ~inner[1:]
    last[bounds - 1] = inner[bounds - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, offsets)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    return mix(Prefixes(BYTE_VALUES[data]).of(start, end) + (end - start).astype(np.uint64))


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table, np.ndarray], pa.RecordBatch | None], schema: str, order: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Hash-partition by keys, sort, and stream runs of whole groups through fn(table, group starts).

    Groups are never handed over one by one: fn gets every complete group of a batch at once, and the group that
    reaches the batch's end is carried over. The caller bounds the size of a group (``blocks`` below splits hot ones).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.Table] = []
        held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            rest.append(pa.Table.from_batches([batch]))
            held += batch.num_rows
            t = pa.concat_tables(rest).combine_chunks()
            starts = group_starts(t, keys)
            if len(starts) > 1:
                cut = int(starts[-1])
                out = fn(t.slice(0, cut).combine_chunks(), starts[:-1])
                if out is not None and out.num_rows:
                    yield out
                rest = [t.slice(cut).combine_chunks()]
            else:
                rest = [t]
        if rest:
            t = rest[0]
            out = fn(t, group_starts(t, keys))
            if out is not None and out.num_rows:
                yield out

    dealt = df.repartition(parts, *keys) if parts else df.repartition(*keys)
    return dealt.sortWithinPartitions(*keys, *(order or [])).mapInArrow(run, schema)


def group_starts(t: pa.Table, keys: list[str]) -> np.ndarray:
    n = t.num_rows
    new = np.zeros(n, bool)
    new[:1] = True
    for k in keys:
        c = t.column(k).to_numpy()
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def blocks(df: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Split every group of more than ``most`` rows into block pairs, so that no task gets an unbounded group.

    Adds bi <= bj (the pair) and own (the row's block). A group of n rows has g = ceil(n / most) blocks, chosen by the
    member's hash; each row goes to the g pairs that hold its block. Groups of one row are left out: they have no pair.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    return block_pairs(df.join(sizes, keys), member, most)


def block_pairs(df: DataFrame, member: str, most: int) -> DataFrame:
    """The same for rows that carry the size of their group as _n."""
    d = df.withColumn("_g", F.ceil(F.col("_n") / most).cast("int"))
    d = d.withColumn("own", F.pmod(F.xxhash64(F.col(member), F.lit(7)), F.col("_g")).cast("int")).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_g") - 1)))
    return d.withColumn("bi", F.least("own", "_o")).withColumn("bj", F.greatest("own", "_o")).drop("_g", "_o", "_n")


def components(edges: DataFrame, scratch: Scratch, rounds: int = 60) -> DataFrame:
    """Connected components of (a, b) long edges by alternating large-star and small-star steps.

    Returns (id, component_id) for every id that has an edge, component_id the smallest id reachable. Each round is
    written to the shared folder, which cuts the lineage; nothing is gathered on the driver but one boolean. Converges in
    O(log^2 n) rounds.
    """

    def star(e: DataFrame) -> DataFrame:
        """For each u the least of its closed neighbourhood; its larger neighbours are linked to it."""
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()

    def small(e: DataFrame) -> DataFrame:
        """Edges (a > b): the least smaller neighbour m of a; a and its smaller neighbours are linked to m."""
        e = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = e.groupBy("a").agg(F.min("b").alias("m"))
        moved = e.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()

    now = scratch.put(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(rounds):
        new = scratch.put(small(star(now)))
        # a star forest: nobody is both a child and a parent, and no child has two parents
        loose = new.select("a").intersect(new.select("b")).limit(1).count() or new.groupBy("a").count().where("count > 1").limit(1).count()
        now = new
        if not loose:
            break
    else:
        raise RuntimeError("components did not converge")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component_id")).unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component_id")).distinct())


def fixed_blobs(df: DataFrame, dtype: str, op: Callable = np.add) -> list[bytes]:
    """Element-wise reduction of (part int, blob binary) rows by part, in two steps; the few parts go to the driver.

    For arrays of a fixed size only (sketches, bitmaps): what the driver gets doesn't grow with the input.
    """

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                v = np.frombuffer(blob, dtype)
                sums[part] = op(sums[part], v) if part in sums else v.copy()
        for part, v in sums.items():
            yield pa.record_batch({"part": pa.array([part], pa.int32()), "blob": pa.array([v.tobytes()], pa.binary())})

    d = df.withColumn("_salt", F.pmod(F.spark_partition_id(), F.lit(32))).repartition("part", "_salt").drop("_salt").mapInArrow(reduce, "part int, blob binary")
    rows = d.repartition("part").mapInArrow(reduce, "part int, blob binary").collect()
    return [r["blob"] for r in sorted(rows, key=lambda r: r["part"])]


def cut_blobs(a: np.ndarray, parts: int = 16) -> pa.RecordBatch:
    return pa.record_batch({"part": pa.array(range(parts), pa.int32()), "blob": pa.array([x.tobytes() for x in np.split(a, parts)], pa.binary())})


class IdFilter:
    """A bitmap of hashed ids: tells rows that can't be wanted before they are shuffled. False positives do no harm."""

    def __init__(self, ids_: DataFrame, most_bits: int = 28):
        n = ids_.count()
        self.bits = bits = min(most_bits, max(18, (16 * n).bit_length()))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            flags = np.zeros(1 << bits, bool)
            for batch in batches:
                flags[mix(batch.column(0).to_numpy().astype(np.uint64)) >> np.uint64(64 - bits)] = True
            if flags.any():
                yield cut_blobs(np.packbits(flags))

        blobs = fixed_blobs(ids_.mapInArrow(fill, "part int, blob binary"), "uint8", np.bitwise_or)
        self.map = np.frombuffer(b"".join(blobs), np.uint8) if blobs else np.zeros((1 << bits) // 8, np.uint8)

    def has(self, x: np.ndarray) -> np.ndarray:
        h = mix(x.astype(np.uint64)) >> np.uint64(64 - self.bits)
        return (self.map[h >> np.uint64(3)] >> (np.uint8(7) - (h & np.uint64(7)).astype(np.uint8))) & 1 == 1
