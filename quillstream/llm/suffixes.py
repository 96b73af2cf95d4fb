"""Suffix-array dedup: bytes covered by 50-byte strings that a document with a smaller id has too.

The suffixes that can matter (those at contexts of shared anchors, see ``matching``) are sorted by a mergesort whose
comparisons take a logarithmic number of steps: prefix polynomial hashes and a binary search give the common extension of
two suffixes. Neighbours that agree by hash are verified byte by byte; only those count as equal.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common, matching

LENGTH, GRAM = 50, 28
#: Bytes of text whose chunks make a bucket.
BUCKET = 24e6


def common_extension(p: common.Prefixes, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """How many tokens the suffixes at i and j share, up to ``most``: all of them, or found by binary search over prefix
    hashes."""
    a, b, x, y = p.sums[i], p.sums[j], p.down[i], p.down[j]
    out = most.copy()
    on = np.flatnonzero((p.sums[i + most] - a) * x != (p.sums[j + most] - b) * y)
    i, j, a, b, x, y = (v[on] for v in (i, j, a, b, x, y))
    lo, hi = np.zeros(len(on), np.int64), most[on] - 1
    for _ in range(int(most.max(initial=0)).bit_length()):
        mid = (lo + hi + 1) >> 1
        same = (p.sums[i + mid] - a) * x == (p.sums[j + mid] - b) * y
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
        hi = np.maximum(lo, hi)
    out[on] = lo
    return out


def suffix_sort(values: np.ndarray, at: np.ndarray, group: np.ndarray, most: np.ndarray, p: common.Prefixes) -> np.ndarray:
    """Order of the suffixes at ``at`` by (group, their first ``most`` tokens), stable. group is sorted, most one a group.

    Mergesort from runs of one: in each round the place of every suffix of a left run among those of the run at its right
    is found by binary search, for all suffixes of all groups at once; the right runs fill the places that are left.
    """
    n = len(at)
    order = np.arange(n)
    starts = matching.firsts(group)
    size = np.diff(np.append(starts, n))
    inner, count = np.arange(n) - np.repeat(starts, size), np.repeat(size, size)
    run = 1
    while run < size.max(initial=0):
        mine = inner // run
        right = (mine & 1) == 1
        left = np.flatnonzero(~right & ((mine + 1) * run < count))
        first = left - inner[left] + (mine[left] + 1) * run
        lo, hi = first.copy(), np.minimum(first + run, left - inner[left] + count[left])
        x = at[order[left]]
        while True:
            on = np.flatnonzero(lo < hi)
            if not len(on):
                break
            mid = (lo[on] + hi[on]) >> 1
            y, m = at[order[mid]], most[left[on]]
            e = common_extension(p, x[on], y, m)
            k = np.minimum(e, m - 1)
            past = (e < m) & (values[y + k] < values[x[on] + k])  # of equal ones the left goes first
            lo[on] = np.where(past, mid + 1, lo[on])
            hi[on] = np.where(past, hi[on], mid)
        target = left + (lo - first)
        new, free = order.copy(), right.copy()
        new[target] = order[left]
        free[left] = True
        free[target] = False
        new[free] = order[right]
        order = new
        run *= 2
    return order


def classes(pool: matching.Pool, p: common.Prefixes, values: np.ndarray, at: np.ndarray, group: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, starts): the suffixes at ``at`` in order, equal ones of a group together. What stands alone in its group
    needs no sort."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    twin = np.zeros(len(order), bool)
    twin[1:] = g[1:] == g[:-1]
    new = ~twin
    twin[:-1] |= twin[1:].copy()
    live = np.flatnonzero(twin)
    if len(live):
        some = order[live]
        order[live] = some = some[suffix_sort(values, at[some], g[live], most[some], p)]
        near = np.flatnonzero(~new[live])
        a, b = some[near], some[near - 1]
        same = common_extension(p, at[a], at[b], most[a]) == most[a]
        same[same] = pool.same(at[a[same]], at[b[same]], most[a[same]])  # collision check: the bytes themselves
        new[live[near[~same]]] = True
    return order, np.flatnonzero(new)


def repeated(pool: matching.Pool, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, first, last): ranges of places whose stretches a context of a smaller id has at the same distance from an
    equal anchor. Contexts that are equal whole are one class; the stretches of what differs are sorted place by place."""
    values = matching.token_values(pool.data, pool.start)
    p, n = common.Prefixes(values), pool.left + pool.right
    key = lambda left, rest: common.mix(left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + rest.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(1))
    order, starts = classes(pool, p, values, pool.begin, common.mix(pool.h ^ key(pool.left, pool.right)), n)
    size = np.diff(np.append(starts, len(order)))
    least = np.empty(len(order), np.int64)
    least[order] = np.repeat(np.minimum.reduceat(pool.ids[order], starts), size)
    number = np.empty(len(order), np.int64)
    number[order] = np.repeat(np.arange(len(starts)), size)
    whole = np.flatnonzero(pool.ids > least)
    # one context of each class, of anchors that have several
    head = order[starts]
    anchors, at, count = np.unique(pool.h[head], return_inverse=True, return_counts=True)
    head = head[count[at] > 1]
    m = n[head] - length + 1
    context, offset = np.repeat(head, m), np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    group = common.mix(pool.h[context] ^ key(pool.left[context] - offset, np.zeros(len(context), np.int64)))
    order, starts = classes(pool, p, values, pool.begin[context] + offset, group, np.full(len(context), length))
    low = least[context][order]
    on = order[np.repeat(np.minimum.reduceat(low, starts), np.diff(np.append(starts, len(order)))) < low] if len(order) else order
    on = np.sort(on)  # by context and place
    breaks = np.ones(len(on), bool)
    breaks[1:] = (context[on][1:] != context[on][:-1]) | (offset[on][1:] != offset[on][:-1] + 1)
    s = np.flatnonzero(breaks)
    e = np.append(s[1:], len(on)) - 1
    cls, first, last = number[context[on[s]]], offset[on[s]], offset[on[e]] if len(on) else offset[on]
    # every context of the class that isn't gone whole
    rest = np.flatnonzero(pool.ids == least)
    rest = rest[np.argsort(number[rest], kind="stable")]
    lo, hi = np.searchsorted(number[rest], cls), np.searchsorted(number[rest], cls, "right")
    k = hi - lo
    which = rest[np.repeat(lo - np.cumsum(k) + k, k) + np.arange(k.sum())]
    return np.concatenate([whole, which]), np.concatenate([np.zeros(len(whole), np.int64), np.repeat(first, k)]), np.concatenate([n[whole] - length, np.repeat(last, k)])


def _finish(c: matching.Chunk, gone: np.ndarray) -> pa.RecordBatch:
    o = c.byte_offs
    first = gone.copy()
    first[1:] &= ~gone[:-1]
    inner = o[1:-1]
    inner = inner[(inner > 0) & (inner < c.n)]
    first[inner] = gone[inner]
    sums = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[o])
    kept = c.data[~gone].tobytes()
    at = np.concatenate([[0], np.cumsum(~gone)])[o].tolist()
    sha = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(at[:-1], at[1:], strict=True)]
    text = [kept[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    return pa.record_batch({"doc_id": pa.array(c.ids, mask=c.ids == common.NO_ID), "n_bytes": pa.array(np.diff(o)), "n_removed": pa.array(sums(gone)), "n_spans": pa.array(sums(first)), "kept_sha256": pa.array(sha), "kept": pa.array(text, pa.binary())})


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes).

    A byte goes if a ``length``-byte string that covers it also starts in a document with a smaller doc_id; strings are
    judged on the input. A null text is empty; texts shorter than ``length`` stay. Rows of one doc_id don't affect each
    other; rows that repeat whole have one result each; a null doc_id counts as larger than all others. Texts are taken
    whole; an empty table gives no rows; other columns are left out.
    """
    spark = docs.sparkSession
    common.tune(spark)
    scratch = common.Scratch(spark, "suffixes")
    spec = matching.Spec("bytes", length, gram)
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    size = d.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = matching.chunk_table(d, f"{scratch.root}/chunks", common.partitions(spark, size, BUCKET))
    parts = matching.parts_for(chunks)
    shared = scratch.table(matching.shared_anchors(matching.ask_anchors(chunks, spec, parts), parts), "shared")
    scratch.tidy()
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return matching.verify_and_finish(chunks, shared, spec, scratch, parts, _finish, schema, repeated)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("kept")
