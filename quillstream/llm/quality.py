"""Quality classifier: a generalised additive model with pairwise interactions.

Cyclic boosting of shallow trees learns one lookup table a feature, then tables for the feature pairs that explain most
of what is left. A score is a vectorised addition of table entries by bin.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

#: Most labelled rows that the fit takes, those of the smallest hash of doc_id: a fixed bound on the driver's memory.
FIT_ROWS = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, RATE = 32, 8, 6, 60, 0.15
FEATURES = ["log_words", "mean_len", "max_len", "upper", "digit", "symbol", "bang", "pipe", "high", "line_words", "same_as_last", "type_share", "tail_symbol", "word_repeat_run", "line_repeat"]
_KIND = np.zeros((6, 256), np.uint8)
_KIND[0, 65:91] = 1
_KIND[1, 48:58] = 1
_KIND[2, [*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = 1
_KIND[2, [ord(c) for c in ".,;:'\"-()?"]] = 0
_KIND[3, ord("!")] = 1
_KIND[4, ord("|")] = 1
_KIND[5, 128:] = 1


def measure(texts: pa.Array) -> np.ndarray:
    """Features of whole texts, one row each; a null or empty text has zeros."""
    data, offsets = common.utf8(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
        out[i:j] = _measure(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        i = j
    return out


def _sums(x: np.ndarray, offs: np.ndarray) -> np.ndarray:
    s = np.zeros(len(x) + 1, np.int64)
    np.cumsum(x, out=s[1:])
    return s[offs[1:]] - s[offs[:-1]]


def _measure(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n, out = len(offs) - 1, np.zeros((len(offs) - 1, len(FEATURES)))
    if not len(data):
        return out
    start, end, w = common.words(data, offs)
    size, count = np.maximum(np.diff(offs), 1), np.diff(w)
    some = np.maximum(count, 1)
    length = end - start
    out[:, 0] = np.log1p(count)
    out[:, 1] = _sums(length, w) / some
    full = np.flatnonzero(count)
    if len(full):
        out[full, 2] = np.minimum(np.maximum.reduceat(length, w[full]), 1000)
    for k in range(6):
        out[:, 3 + k] = _sums(_KIND[k][data], offs) / size
    newline = _sums(data == 10, offs)
    out[:, 9] = np.minimum(count / (newline + 1), 1000)
    h = common.word_hashes(data, start, end)
    doc = np.repeat(np.arange(n), count)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    out[:, 10] = _sums(same, w) / some
    key = common.mix(h + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, at = np.unique(key, return_index=True)
    new = np.zeros(len(h), bool)
    new[at] = True
    out[:, 11] = _sums(new, w) / some
    if len(h):
        tail = (_KIND[2] | _KIND[3])[data[end - 1]]
        out[:, 12] = _sums(tail, w) / some
        two = np.zeros(len(h), bool)  # a word that comes again four words later, as in repeated lists
        two[4:] = (h[4:] == h[:-4]) & (doc[4:] == doc[:-4])
        out[:, 13] = _sums(two, w) / some
    # lines that repeat within a text
    first = np.zeros(len(data), bool)
    first[offs[:-1][np.diff(offs) > 0]] = True
    first[1:] |= data[:-1] == 10
    ls = np.flatnonzero(first)
    le = np.append(ls[1:], len(data))
    lh = common.word_hashes(data, ls, le)
    lw = np.searchsorted(ls, offs)
    ld = np.repeat(np.arange(n), np.diff(lw))
    _, at = np.unique(common.mix(lh + ld.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    fresh = np.zeros(len(lh), bool)
    fresh[at] = True
    out[:, 14] = 1 - _sums(fresh, lw) / np.maximum(np.diff(lw), 1)
    return out


class AdditiveModel:
    def __init__(self) -> None:
        self.base, self.edges, self.tables, self.pairs, self.pair_edges, self.pair_tables = 0.0, [], [], [], [], []

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.base)
        for f, (edges, t) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += t[np.searchsorted(edges, x[:, f], "right")]
        for (a, b), t in zip(self.pairs, self.pair_tables, strict=True):
            z += t[np.searchsorted(self.pair_edges[a], x[:, a], "right"), np.searchsorted(self.pair_edges[b], x[:, b], "right")]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between distinct values, at quantiles of the values and of their distinct ones, so rare values get bins too."""
    u = np.unique(x)
    q = np.unique(np.concatenate([np.quantile(x, np.linspace(0, 1, bins // 2 + 1)[1:-1]), np.quantile(u, np.linspace(0, 1, bins // 2 + 1)[1:-1])]))
    at = np.unique(np.clip(np.searchsorted(u, q), 1, len(u) - 1)) if len(u) > 1 else np.zeros(0, int)
    return (u[at - 1] + u[at]) / 2


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = 4, ridge: float = 5.0) -> np.ndarray:
    """Values of a shallow tree over ordered bins with gradient and curvature sums g, h: greedy best splits."""
    gs, hs = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (gs[b] - gs[a]) ** 2 / (hs[b] - hs[a] + ridge)
    spans = [(0, len(g))]
    for _ in range(leaves - 1):
        best = (1e-9, None, None)
        for a, b in spans:
            if b - a > 1:
                cut = np.arange(a + 1, b)
                got = gain(a, cut) + gain(cut, b) - gain(a, b)
                k = int(got.argmax())
                best = max(best, (float(got[k]), (a, b), int(cut[k])), key=lambda x: x[0])
        if best[1] is None:
            break
        spans.remove(best[1])
        spans += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(g))
    for a, b in spans:
        out[a:b] = (gs[b] - gs[a]) / (hs[b] - hs[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, bins: int = BINS, pairs: int = PAIRS, rounds: int = ROUNDS, rate: float = RATE) -> AdditiveModel:
    m = AdditiveModel()
    p = (y.sum() + 0.5) / (len(y) + 1.0)
    m.base = float(np.log(p / (1 - p)))
    m.edges = [_edges(x[:, f], bins) if len(y) else np.zeros(0) for f in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    m.pair_edges = [_edges(x[:, f], PAIR_BINS) if len(y) else np.zeros(0) for f in range(x.shape[1])]
    if len(y) < 2 or y.min() == y.max():
        return m
    b = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(m.edges)]
    z = np.full(len(y), m.base)
    for _ in range(rounds):
        for f in range(x.shape[1]):
            q = 1 / (1 + np.exp(-z))
            step = rate * _tree(np.bincount(b[f], y - q, len(m.tables[f])), np.bincount(b[f], q * (1 - q), len(m.tables[f])))
            m.tables[f] += step
            z += step[b[f]]
    pb = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(m.pair_edges)]

    def sums(a: int, c: int) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(m.pair_edges[a]) + 1, len(m.pair_edges[c]) + 1)
        at, q = pb[a] * shape[1] + pb[c], 1 / (1 + np.exp(-z))
        return tuple(np.bincount(at, v, shape[0] * shape[1]).reshape(shape) for v in (y - q, q * (1 - q)))

    gain = {}
    for a in range(x.shape[1]):
        for c in range(a + 1, x.shape[1]):
            g, h = sums(a, c)
            gain[a, c] = float((g**2 / (h + 5.0)).sum())
    m.pairs = sorted(gain, key=lambda k: (-gain[k], k))[:pairs]
    m.pair_tables = [np.zeros((len(m.pair_edges[a]) + 1, len(m.pair_edges[c]) + 1)) for a, c in m.pairs]
    for _ in range(rounds // 2):
        for k, (a, c) in enumerate(m.pairs):
            g, h = sums(a, c)
            rows = _tree(g.sum(1), h.sum(1), 2)
            halves = [rows == v for v in np.unique(rows)]  # the first split is on a, each side is then split on c
            step = np.zeros_like(g)
            for half in halves:
                step[half] = rate * _tree(g[half].sum(0), h[half].sum(0), 2)[None, :]
            m.pair_tables[k] += step
            z += step[pb[a], pb[c]]
    return m


def train(docs: DataFrame, labels: DataFrame, limit: int = FIT_ROWS) -> AdditiveModel:
    """Fits on the labelled rows (doc_id, quality) given, at most ``limit`` of them, those of the smallest id hash.

    Of documents that share an id the one of the smallest text hash is taken, so repeats don't add rows.
    """
    some = labels.where("quality is not null and doc_id is not null").select("doc_id", F.col("quality").cast("double").alias("quality"))
    some = some.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)
    rows = docs.select("doc_id", "text").join(F.broadcast(some.distinct()), "doc_id")  # at most ``limit`` small rows
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("quality", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = measure(batch.column(1))
            yield pa.record_batch({"y": batch.column(0), "x": pa.array([r.tobytes() for r in x], pa.binary())})

    got = rows.mapInArrow(run, "y double, x binary").toArrow()
    x = np.frombuffer(b"".join(got.column("x").to_pylist()), float).reshape(-1, len(FEATURES))
    y = got.column("y").to_numpy()
    order = np.lexsort([*x.T, y])  # the same model whatever order the rows came in
    return fit(x[order], (y[order] > 0.5).astype(float))


def score_quality(docs: DataFrame, model: AdditiveModel, text: str = "text") -> DataFrame:
    """Adds score double (0 to 1) and predicted int (1 if score >= 0.5) to docs; columns of those names are replaced.

    Null and empty texts have all features 0 and are scored like any other. Texts are read whole. Each row is scored alone,
    so repeated rows and ids are as many results. An empty table gives no rows; without labels, or with labels of one kind, each score is the smoothed share of label 1.
    """
    keep = [c for c in docs.columns if c not in ("score", "predicted")]
    d = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(measure(batch.column(keep.index(text))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*keep, "score", "predicted"])

    return d.mapInArrow(run, docs.select(*keep).schema.add("score", "double").add("predicted", "integer"))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, common.table(spark, sf_dir, "labels").where(~held_out()))
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(measure(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
