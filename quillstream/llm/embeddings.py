"""Embedding near-duplicates by p-stable hashing, and nearest neighbours by collision counting.

Near-duplicates: quantised random projections (Gaussian, thus 2-stable for Euclidean distance) of normalised vectors
give a bucket in each of TABLES tables; vectors of one bucket are held against each other by exact cosine.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

COSINE = 0.98
#: Tables, projections in each and bucket width. At cosine 0.98 (distance 0.2) one projection collides with probability
#: 0.92, twenty with 0.19, and a pair is missed by all 55 tables with probability 1e-5; closer pairs far more rarely. Two
#: vectors at a right angle share a bucket with probability 5e-7.
TABLES, PROJECTIONS, WIDTH = 55, 20, 2.0
#: Rows of a bucket that are held against each other at once; larger buckets are split into pairs of blocks.
BLOCK = 1024


def vectors(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and values of the usable vectors: not null, not empty, not zero, all components finite.

    The most common length counts as the dimension of the batch; callers pass batches of one length.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offs = column.offsets.to_numpy()
    lens = np.diff(offs)
    values = column.values
    nulls = np.zeros(len(values), bool) if values.null_count == 0 else values.is_null().to_numpy(zero_copy_only=False)
    flat = values.fill_null(0.0).to_numpy(zero_copy_only=False) if values.null_count else values.to_numpy(zero_copy_only=False)
    ok = column.is_valid().to_numpy(zero_copy_only=False) & (lens > 0)
    if not ok.any():
        return np.zeros(0, np.int64), np.zeros((0, 0))
    dim = int(lens[ok].max())
    rows = np.flatnonzero(ok & (lens == dim))
    at = offs[rows][:, None] + np.arange(dim)
    x = flat[at].astype(float)
    good = np.isfinite(x).all(1) & (x != 0).any(1) & ~nulls[at].any(1)
    return rows[good], x[good]


def _usable(df: DataFrame, vector: str) -> DataFrame:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return df.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda v: v != 0))


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)  # so that huge or tiny components don't over- or underflow
    return x / np.sqrt((x * x).sum(1, keepdims=True))


@functools.lru_cache(8)
def _projections(dim: int, tables: int, projections: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, dim])
    return rng.normal(size=(dim, tables * projections)), rng.uniform(0, width, tables * projections)


def hash_codes(x: np.ndarray, tables: int, projections: int, width: float, seed: int = 11) -> np.ndarray:
    """Bucket codes (n x tables) of unit vectors."""
    a, b = _projections(x.shape[1], tables, projections, width, seed)
    cells = np.floor((x @ a + b) / width).astype(np.int64).reshape(len(x), tables, projections)
    h = np.zeros((len(x), tables), np.uint64)
    for k in range(projections):
        h = common.mix(h + cells[:, :, k].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k + 1))
    return h


def classes_of(df: DataFrame, vec_id: str, vector: str, label: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, classes) of the usable vectors: a node is a distinct (vec_id, label, vector), a class all nodes of one label
    and vector. nodes: vec_id, h, g. classes: label, v, h and g (two hashes of both), rep (the smallest vec_id) and size
    (its nodes).

    Partial aggregation runs before both shuffles, so a vector that a third of all rows hold costs a row a task.
    """
    d = _usable(df.where(F.col(label).isNotNull() & F.col(vec_id).isNotNull()), vector)
    d = d.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    each = d.groupBy("vec_id", "label", "v").agg(F.xxhash64("label", "v").alias("h"), F.xxhash64("v", "label", F.lit(1)).alias("g"))
    classes = each.groupBy("label", "v").agg(F.first("h").alias("h"), F.first("g").alias("g"), F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    return each.select("vec_id", "h", "g"), classes


def link_near(classes: DataFrame, scratch: common.Scratch, cosine: float = COSINE, tables: int = TABLES, projections: int = PROJECTIONS, width: float = WIDTH, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """(counts, edges) of classes: (rep, h) -> n, the nodes in other classes linked to it; (a > b) reps that span the links.

    Only bucket numbers and keys are shuffled for all classes; the vectors follow where a bucket holds two or more. No pair
    is shuffled: within a bucket, links are counted where two codes first agree (a bucket of a later table leaves them
    out), and edges only span what the links connect. Buckets of over ``block`` rows are split into block pairs, so the
    work of a large group of near copies is dealt out.
    """
    kind = classes.schema["label"].dataType.simpleString()

    def explode(batches):
        for batch in batches:
            lens = batch.column(3).value_lengths().to_numpy()
            rep, h, lab = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
            for dim in np.unique(lens):
                pick = np.flatnonzero(lens == dim)
                _, x = vectors(batch.column(3).take(pa.array(pick)))
                code = hash_codes(_unit(x), tables, projections, width).view(np.int64)
                for at in range(0, len(pick), 256):
                    rows = np.repeat(pick[at : at + 256], tables)
                    n = len(rows) // tables
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(tables, dtype=np.int32), n)), pa.array(code[at : at + 256].ravel()), pa.array(np.full(len(rows), dim, np.int32)), lab.take(pa.array(rows)), pa.array(rep[rows]), pa.array(h[rows])],
                        names=["t", "code", "dim", "label", "rep", "h"],
                    )

    keys = ["t", "code", "dim", "label"]
    narrow = classes.select("rep", "h", "label", "v").mapInArrow(explode, f"t int, code long, dim int, label {kind}, rep long, h long")
    sizes = narrow.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    shared = narrow.join(sizes, keys).join(classes.select("rep", "h", "size", "v"), ["rep", "h"])
    parts = common.block_pairs(shared, "h", block)

    def pairs(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ends = np.append(starts[1:], t.num_rows)
        rep, h, size, own, bi, bj, tab, dim = (t.column(c).to_numpy() for c in ("rep", "h", "size", "own", "bi", "bj", "t", "dim"))
        v, n_out, edges = t.column("v").combine_chunks(), [], []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            x = _unit(v.slice(s, e - s).flatten().to_numpy(zero_copy_only=False).reshape(e - s, -1))
            near = np.triu((x @ x.T) >= cosine, 1)
            if bi[s] != bj[s]:
                near &= own[s:e, None] != own[None, s:e]
            a, b = np.nonzero(near)
            if not len(a):
                continue
            if tab[s]:  # pairs that met in a table before this one
                on = np.unique(np.concatenate([a, b]))
                codes = np.zeros((e - s, tab[s]), np.uint64)
                codes[on] = hash_codes(x[on], tables, projections, width)[:, : tab[s]]
                first = np.ones(len(a), bool)
                for at in range(0, len(a), 65536):
                    first[at : at + 65536] = ~(codes[a[at : at + 65536]] == codes[b[at : at + 65536]]).any(1)
                a, b = a[first], b[first]
            if len(a):
                m = np.zeros(e - s, np.int64)
                np.add.at(m, a, size[s:e][b])
                np.add.at(m, b, size[s:e][a])
                on = np.flatnonzero(m)
                n_out.append((rep[s:e][on], h[s:e][on], m[on]))
                edges.append(spanning(a, b, rep[s:e]))
        if not n_out:
            return None
        i, k, m = (np.concatenate(c) for c in zip(*n_out, strict=True))
        p, q = (np.concatenate(c) for c in zip(*edges, strict=True))
        return pa.record_batch({"a": pa.array(np.concatenate([i, p])), "b": pa.array(np.concatenate([k, q])), "n": pa.array(np.concatenate([m, np.zeros(len(p), np.int64)]))})

    found = scratch.put(common.grouped(parts, [*keys, "bi", "bj"], pairs, "a long, b long, n long", ["h"]))
    counts = found.where("n > 0").groupBy(F.col("a").alias("rep"), F.col("b").alias("h")).agg(F.sum("n").alias("n"))
    return counts, found.where("n = 0").select("a", "b")


def spanning(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each vertex of a small graph with the least id of its component, by label propagation and pointer jumping."""
    rank = np.argsort(np.argsort(ids, kind="stable"), kind="stable")
    least = rank.copy()
    while True:
        low = np.minimum(least[a], least[b])
        new = least.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        inv = np.empty_like(rank)
        inv[rank] = np.arange(len(rank))
        new = np.minimum(new, new[inv[new]])
        if (new == least).all():
            break
        least = new
    by_rank = np.sort(ids, kind="stable")
    move = np.flatnonzero(least != rank)
    return ids[move], by_rank[least[move]]


def near_duplicates(df: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", cosine: float = COSINE, **how: int) -> DataFrame:
    """One row per row of df: vec_id, n_links, component_id, kept.

    Links join vectors of equal non-null label with cosine >= ``cosine`` in double precision. Null, empty and zero
    vectors and those with null or non-finite components link with nothing; so do rows of a null label. Rows of a null
    vec_id keep it and link with nothing. Rows that repeat whole are one vector: each has its figures. Rows that share a
    vec_id but not the vector or label are vectors of their own: ``n_links`` counts the other distinct (vec_id, label,
    vector) linked to the row's, and their component is one, as they share an id. Vectors of different lengths never
    link; ties at the threshold link; an empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    common.tune(spark)
    scratch = common.Scratch(spark, "near")
    nodes, classes = classes_of(df, vec_id, vector, label)
    classes = scratch.put(classes)
    counts, edges = link_near(classes, scratch, cosine, **how)
    n_links = F.col("size") - 1 + F.coalesce("n", F.lit(0))
    linked = classes.select("rep", "h", "g", "size").join(counts, ["rep", "h"], "left").select("rep", "h", "g", n_links.alias("n_links")).where("n_links > 0")
    nodes = scratch.put(nodes.join(linked, ["h", "g"]))
    comp = common.components(edges.unionByName(nodes.where("vec_id <> rep").select(F.col("vec_id").alias("a"), F.col("rep").alias("b"))), scratch)
    d = df.select(F.col(vec_id).cast("long").alias("vec_id"), F.xxhash64(F.col(label), F.col(vector).cast("array<double>")).alias("h"))
    out = d.join(nodes.select("vec_id", "h", "n_links"), ["vec_id", "h"], "left").join(comp.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op1_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


# --- nearest neighbours ------------------------------------------------------------------------------------------------
NEAREST, EVERY = 20, 20
#: Rows of an index block. Each block has its own sorted arrays; a query visits all blocks.
INDEX_BLOCK = 16384
#: Single projections in all (rows of random rotations), and the collisions that make a candidate, as a share of them.
LINES, THRESHOLD = 128, 0.5
#: A search ends when a vector as near as the k-th best found would collide MARGIN standard deviations more often than the
#: threshold asks.
MARGIN = 1.25
#: The factor by which a window grows at most, and the queries that set a block's first window.
GROWTH, PROBES = 1.15, 16
#: Places of a sorted array where a window may begin or end, and the queries whose collisions are counted at once.
CELLS, WIDE = 128, 64


class CollisionIndex:
    """Sorted arrays of single projections of one block of vectors, with collision counting.

    Inner products become distances by one more component (the square root of what a vector's squared norm lacks of the
    block's largest), so the nearest by distance is the largest inner product. Blocks hold norms within a factor of two,
    so that component stays small.

    A search opens a window around the query's place in each sorted array and widens all of them (virtual rehashing: the
    same arrays, a larger radius). Rows with ``threshold`` collisions are verified by exact inner product. A row at distance
    d collides with the share P(|u| * d <= half) of the arrays, u a coordinate of a random unit vector; so the radius that a
    window has searched is known, and the search ends when the k-th best found lies within it, whatever share of the block
    that takes.

    An array is kept as the bitmaps of its first rows, at up to CELLS places: the rows of a window are two bitmaps' exclusive
    or. A window is widened to the next such places, so it never holds fewer rows than its radius asks. Counts are bit-sliced:
    bit b of 64 rows' counts is one word, and one operation adds a window to 64 rows of each of WIDE queries.
    """

    def __init__(self, ids: np.ndarray, x: np.ndarray, lines: int = LINES, threshold: float = THRESHOLD, margin: float = MARGIN, seed: int = 23):
        self.ids, self.x = ids, x
        self.alone = len(np.unique(ids)) == len(ids)
        n, dim = len(x), x.shape[1] + 1
        scale = np.abs(x).max()
        unit = x / scale
        norm = np.sqrt(np.einsum("ij,ij->i", unit, unit))
        unit /= norm.max()
        self.unit, self.slack = unit.astype(np.float32), (dim + 3) * 2.0**-23  # no two cosines of these are off by more
        more = np.sqrt(np.maximum(0, 1 - (norm / norm.max()) ** 2))
        rng = np.random.default_rng([seed, dim])
        self.lines = np.concatenate([np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(-(-lines // dim))], 1)[:, :lines].T.copy()
        cells = min(CELLS, n)
        bounds = np.arange(cells + 1) * n // cells
        cell = np.repeat(np.arange(1, cells + 1), np.diff(bounds))
        self.first, self.last = np.empty((lines, cells)), np.empty((lines, cells))
        self.heads = np.zeros((lines, cells + 1, -(-n // 64)), np.uint64)
        places = self.lines[:, :-1] @ unit.T + self.lines[:, -1:] * more
        for k, p in enumerate(places):
            order = np.argsort(p)
            self.first[k], self.last[k] = p[order[bounds[:-1]]], p[order[bounds[1:] - 1]]
            np.add.at(self.heads[k], (cell, order >> 6), np.uint64(1) << (order & 63).astype(np.uint64))
            np.bitwise_or.accumulate(self.heads[k], axis=0, out=self.heads[k])
        self.least = int(np.ceil(threshold * lines))
        u = rng.normal(size=(20_000, dim))
        u = np.abs(u[:, 0]) / np.sqrt((u * u).sum(1))
        share = threshold + margin * np.sqrt(threshold * (1 - threshold) / lines)
        self.reach = 1 / float(np.quantile(u, min(share, 0.999)))
        self.start = 0.02 / np.sqrt(dim)
        probes = np.arange(0, n, max(1, n // PROBES))
        self.start = 0.95 * float(np.quantile([half for _, _, half in self.search(x[probes], ids[probes], NEAREST)], 0.25))

    def collisions(self, center: np.ndarray, half: np.ndarray) -> np.ndarray:
        """Bitmaps (a row a query) of the rows with at least ``least`` collisions within half of center, a column an array."""
        sums: list[np.ndarray] = []  # bit b of the counts
        wait: list[np.ndarray | None] = []  # what is still to be added to it

        def add(b: int, w: np.ndarray) -> None:
            while True:
                if b == len(sums):
                    sums.append(w)
                    wait.append(None)
                    return
                if wait[b] is None:
                    wait[b] = w
                    return
                s, v = sums[b], wait[b]
                wait[b] = None
                both = s & v
                s ^= v
                v = s & w
                s ^= w
                both |= v
                b, w = b + 1, both

        left, right = center - half[:, None], center + half[:, None]
        for k, heads in enumerate(self.heads):
            window = heads.take(self.last[k].searchsorted(left[:, k]), 0)
            window ^= heads.take(self.first[k].searchsorted(right[:, k], "right"), 0)
            add(0, window)
        for b in range(len(self.heads).bit_length()):
            if b < len(sums) and (w := wait[b]) is not None:
                wait[b] = None
                carry = sums[b] & w
                sums[b] ^= w
                add(b + 1, carry)
        if self.least >> len(sums):
            return np.zeros_like(sums[0])
        enough = np.full_like(sums[0], ~np.uint64(0))
        for b, s in enumerate(sums):
            enough = s & enough if self.least >> b & 1 else s | enough
        return enough

    def search(self, q: np.ndarray, own: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray, float]]:
        """For each query ids and inner products of the best k found, ties to smaller ids, rows of its own id left out; the
        last window."""
        n = len(self.ids)
        unit = _unit(q)
        center, half = unit @ self.lines[:, :-1].T, np.full(len(q), self.start)
        seen = np.zeros((len(q), self.heads.shape[2]), np.uint64)
        best = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0))] * len(q)  # ids, scores, cosines as the index has them
        live, ahead = [], 0
        while live or ahead < len(q):
            fill = min(len(q), ahead + WIDE - len(live))
            live, ahead = [*live, *range(ahead, fill)], fill
            new = self.collisions(center[live], half[live]) & ~seen[live]
            seen[live] |= new
            rows = np.flatnonzero(np.unpackbits(new.view(np.uint8), axis=1, count=n, bitorder="little").view(bool))
            ends = np.searchsorted(rows, np.arange(len(live) + 1) * n).tolist()
            on = []
            for j, i in enumerate(live):
                best[i] = found, _, near = self._verify(rows[ends[j] : ends[j + 1]] - j * n, q[i], unit[i], own[i], k, *best[i])
                d = np.sqrt(max(0.0, 2 - 2 * near.min())) if len(found) >= k else None
                if half[i] <= 2 and (d is None or d > half[i] * self.reach):
                    half[i] = half[i] * GROWTH if d is None else max(half[i] * 1.01, min(half[i] * GROWTH, d / self.reach))
                    on.append(i)
            live = on
        return [(found, score, float(h)) for (found, score, _), h in zip(best, half, strict=True)]

    def _verify(self, rows: np.ndarray, q: np.ndarray, unit: np.ndarray, own: int, k: int, found: np.ndarray, score: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The best k of those found so far and of these rows, by exact inner product."""
        if not len(rows):
            return found, score, near
        cos = self.unit.take(rows, 0) @ unit.astype(np.float32)
        cos[self.ids[rows] == own] = -np.inf
        least = near.min() if len(found) >= k else -2.0
        if self.alone and len(cos) > k:
            least = max(least, np.partition(cos, len(cos) - k)[len(cos) - k])
        pick = np.flatnonzero(cos >= max(-2.0, least - self.slack))  # the best k, and what rounding may hide
        if not len(pick):
            return found, score, near
        rows = rows[pick]
        found, score, near = np.concatenate([found, self.ids[rows]]), np.concatenate([score, (self.x[rows] * q).sum(1)]), np.concatenate([near, cos[pick]])
        order = np.lexsort((found, -score))
        if not self.alone:
            order = order[np.sort(np.unique(found[order], return_index=True)[1])]  # rows of one id are one candidate
        order = order[:k]
        return found[order], score[order], near[order]


def span_of(vector: str) -> Column:
    """The power of two nearest to the norm of a usable vector, by its logarithm: vectors of one span have norms within a
    factor of two, and normalised ones are of span 0 despite rounding.

    The largest component is bound by a lambda, since Spark would work it out anew for each component.
    """
    by_top = lambda m: F.log2(m) + 0.5 * F.log2(F.aggregate(vector, F.lit(0.0), lambda s, x: s + (x / m) * (x / m)))
    return F.floor(F.transform(F.array(F.array_max(F.transform(vector, F.abs))), by_top)[0] + 0.5).cast("int")


def nearest(df: DataFrame, queries: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", k: int = NEAREST, block: int = INDEX_BLOCK, **how: float) -> DataFrame:
    """query_id long, rank int, vec_id long, score double: for each query the k largest inner products found in df.

    Every row of df is indexed. A block holds rows of one length and of norms within a factor of two, dealt by hash;
    queries stream through each block's task after its rows, so a task holds one block and one Arrow batch. Fewer
    candidates than k give fewer rows. Vectors that are null, empty, zero or hold null or non-finite components take no
    part, nor do null ids or vectors of another length than the query; candidates of the query's own id are left out.
    Rows that repeat whole count once. Rows that share an id but not the vector are one candidate (or query) with several
    values, whose nearness is its largest inner product. Equal scores go to smaller ids, across blocks as within them; an
    empty table gives no rows; other columns are left out.
    """
    spark = df.sparkSession
    common.tune(spark)
    scratch = common.Scratch(spark, "nearest")

    def pick(d: DataFrame) -> DataFrame:
        d = _usable(d.where(F.col(vec_id).isNotNull()), vector).select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
        return d.dropDuplicates(["id", "v"])

    rows = scratch.put(pick(df).withColumn("dim", F.size("v")).withColumn("span", span_of("v")))
    shelf = rows.groupBy("dim", "span").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))  # a row a length and power of two
    shelf = scratch.put(shelf.withColumn("before", (F.sum("parts").over(Window.orderBy("dim", "span")) - F.col("parts")).cast("int")))
    n_blocks = shelf.agg(F.sum("parts")).first()[0] or 1
    number = (F.col("before") + F.col("part")).cast("int").alias("block")
    dealt = rows.join(shelf, ["dim", "span"]).withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts"))).select("id", "v", number, F.lit(0).alias("ask"))
    asked = pick(queries).withColumn("dim", F.size("v")).join(shelf.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))), "dim").select("id", "v", number, F.lit(1).alias("ask"))
    both = dealt.unionByName(asked)

    def run(batches):
        now, held, index = None, [], None
        for batch in batches:
            where, ask = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], (where[1:] != where[:-1]) | (ask[1:] != ask[:-1]), [True]]))
            for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                if where[s] != now:
                    now, held, index = where[s], [], None
                part = batch.slice(s, e - s)
                if not ask[s]:
                    held.append(part)
                    continue
                if not held and index is None:  # no row fell to this block
                    continue
                if held:
                    t = pa.Table.from_batches(held).combine_chunks()
                    index, held = CollisionIndex(t.column(0).to_numpy(), vectors(t.column(1))[1], **how), []
                own = part.column(0).to_numpy()
                found, score, _ = zip(*index.search(vectors(part.column(1))[1], own, k), strict=True)
                yield pa.record_batch({"query_id": pa.array(np.repeat(own, [len(f) for f in found])), "vec_id": pa.array(np.concatenate(found)), "score": pa.array(np.concatenate(score))})

    found = both.repartitionById(n_blocks, F.col("block")).sortWithinPartitions("block", "ask", "id").mapInArrow(run, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(rows, rows.where(F.pmod("vec_id", F.lit(EVERY)) == 0))
