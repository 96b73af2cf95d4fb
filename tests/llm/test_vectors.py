"""Near-duplicate vectors and nearest neighbours against brute force."""

import os
import time

import numpy as np
import pytest
from pyspark.sql import types as T

from quillstream.llm import embeddings

SCHEMA = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("label", T.IntegerType()), T.StructField("code", T.StringType())])


def clustered(n=400, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, dim))
    for i in range(0, n - 5, 7):  # chains and copies
        x[i + 1] = x[i] + rng.normal(size=dim) * 0.03
        x[i + 2] = x[i + 1] + rng.normal(size=dim) * 0.06
        x[i + 3] = x[i] * 2.5
    x[300:380] = x[300] + rng.normal(size=(80, dim)) * 0.02  # a large group
    return [(int(i), [float(np.float32(v)) for v in row], int(i) % 2 if i < 300 else 1, "x") for i, row in enumerate(x)]


ODD = [(900, None, 1, "a"), (901, [0.0] * 16, 1, "a"), (902, [float("nan")] + [1.0] * 15, 1, "a"), (903, [None] + [1.0] * 15, 1, "a"), (904, [float("inf")] + [1.0] * 15, 1, "a"), (905, [1.0] * 16, None, "a"), (906, [1.0] * 16, None, "a"), (907, [], 1, "a"), (908, [1.0, 2.0], 1, "a"), (909, [2.0, 4.0], 1, None), (None, [1.0, 2.0], 1, None)]


def usable(rows):
    return [(i, np.array(v, float), lab) for i, v, lab, _ in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]


def brute_links(rows):
    n, parent = {}, {r[0]: r[0] for r in rows if r[0] is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    good = [r for r in usable(rows) if r[2] is not None]
    for a in range(len(good)):
        for b in range(a):
            (i, x, la), (j, y, lb) = good[a], good[b]
            if la == lb and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                n[i], n[j] = n.get(i, 0) + 1, n.get(j, 0) + 1
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (n.get(i, 0), root(i)) for i in parent}


def test_near_vectors_equal_brute_force(spark):
    rows = clustered() + ODD
    got = embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA), block=32).collect()
    want = brute_links(rows)
    assert {r.vec_id: (r.n_links, r.component_id) for r in got if r.vec_id is not None} == want
    assert all(r.kept == (r.vec_id == r.component_id) for r in got if r.vec_id is not None)
    assert len(got) == len(rows)


def test_near_vectors_of_repeated_rows(spark):
    v, near, far = [1.0, 0.0, 0.0], [1.0, 0.01, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, v, 1, "a"), (1, v, 1, "b"), (2, near, 1, "a"), (3, v, 1, ""), (4, far, 1, ""), (4, v, 2, ""), (5, far, 1, ""), (6, v, 2, "")]
    got = sorted(tuple(r) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())
    # both rows of 4 are vectors of their own, linked with 5 and with 6; their component is one
    assert got == sorted([(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False), (3, 2, 1, False), (4, 1, 4, True), (4, 1, 4, True), (5, 1, 4, False), (6, 1, 4, False)])


def test_a_vector_of_a_third_of_all_rows(spark):
    rows = [(i, [1.0, 2.0, 3.0], 7, "") for i in range(3000)] + [(9000, [1.0, 2.0, 3.01], 7, "")]
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(got.values()) == {(3000, 0)} and len(got) == 3001


def test_near_vectors_of_an_empty_table(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_spanning_forest():
    a, b = embeddings.spanning(np.array([0, 1, 3]), np.array([1, 2, 4]), np.array([9, 5, 7, 2, 1]))
    assert dict(zip(a.tolist(), b.tolist(), strict=True)) == {9: 5, 7: 5, 2: 1}


def exact(rows, every=20, k=20):
    """query -> the k largest (-score, id), rows of one id as one candidate."""
    good = usable(rows)
    out = {}
    for q, x, _ in good:
        if q % every == 0:
            best = out.setdefault(q, {})
            for j, y, _ in good:
                if j != q and len(y) == len(x):
                    best[j] = max(best.get(j, -np.inf), float((y * x).sum()))
    return {q: sorted((-s, j) for j, s in best.items())[:k] for q, best in out.items()}


def recall(got, want):
    have = {}
    for r in got:
        have.setdefault(r.query_id, []).append((r.rank, -r.score, r.vec_id))
    hit = 0
    for q, best in want.items():
        mine = sorted(have.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(best) + 1))
        assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)
        hit += len({j for _, _, j in mine} & {j for _, j in best})
    return hit / max(1, sum(map(len, want.values())))


def test_nearest_recall_and_order(spark):
    rows = clustered(1500, 24, 9) + [(i and i + 5000, *r) for i, *r in ODD]
    df = spark.createDataFrame(rows, SCHEMA)
    got = embeddings.nearest(df, df.where("vec_id % 20 = 0"), block=500).collect()
    by_id = {j: y for j, y, _ in usable(rows)}
    assert all(abs(r.score - float(by_id[r.vec_id] @ by_id[r.query_id])) < 1e-9 for r in got)
    assert recall(got, exact(rows)) >= 0.9


@pytest.mark.parametrize("shape", ["one huge", "spread", "tiny"])
def test_nearest_recall_with_skewed_norms(spark, shape):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(1200, 16))
    if shape == "one huge":
        x[7] *= 1000
    elif shape == "spread":
        x *= np.exp(rng.normal(size=(1200, 1)) * 2)
    else:
        x *= 1e-30
    rows = [(i, [float(np.float32(v)) for v in r], 1, "") for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = embeddings.nearest(df, df.where("vec_id % 20 = 0"), block=400).collect()
    assert recall(got, exact(rows)) >= 0.9


def test_nearest_ties_and_repeats_across_blocks(spark):
    rng = np.random.default_rng(8)
    base = [float(v) for v in rng.normal(size=8)]
    rows = [(i, base, 1, "") for i in range(100)] + [(i, base, 1, "again") for i in range(30)]  # all tie
    rows += [(200, [float(v) for v in rng.normal(size=8)], 1, ""), (200, base, 1, "")]  # one id, two vectors
    df = spark.createDataFrame(rows, SCHEMA)
    got = embeddings.nearest(df, df.where("vec_id in (0, 200)"), block=16).collect()
    assert [r.vec_id for r in sorted(got, key=lambda r: r["rank"]) if r.query_id == 0] == list(range(1, 21))
    assert recall(got, {q: b for q, b in exact(rows, 1).items() if q in (0, 200)}) == 1.0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_nearest_recall_on_the_tables(spark, sf):
    """The registered query against an exact scan. Measured: README."""
    if not os.path.exists(f"/root/testdata/{sf}"):
        pytest.skip("the test tables are not here")
    t = spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = exact([(r.vec_id, r.embedding, 0, "") for r in t])
    assert recall(embeddings.op3_nearest(spark, f"/root/testdata/{sf}").collect(), want) >= 0.9


def test_nearest_with_fewer_candidates_than_asked_for(spark):
    rows = [(0, [1.0, 0.0], 1, ""), (1, [1.0, 0.0], 1, ""), (2, [1.0, 0.0], 1, ""), (3, [0.0, 5.0], 1, "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.rank, r.vec_id, r.score) for r in embeddings.nearest(df, df.where("vec_id = 0")).collect())
    assert got == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 0.0)]
    assert embeddings.nearest(df.where("false"), df).count() == 0


def test_collisions_equal_a_plain_count():
    rng = np.random.default_rng(5)
    for n, lines, threshold in ((700, 128, 0.5), (90, 37, 0.3), (5, 16, 1.0)):
        x = rng.normal(size=(n, 12)) * rng.uniform(1, 2, (n, 1))
        index = embeddings.CollisionIndex(np.arange(n), x, lines, threshold)
        norm = np.sqrt((x * x).sum(1))
        lifted = np.concatenate([x, np.sqrt(np.maximum(0, norm.max() ** 2 - norm**2))[:, None]], 1) / norm.max()
        at = lifted @ index.lines.T
        center, half = (x[:5] / norm[:5, None]) @ index.lines[:, :-1].T, np.array([0.01, 0.1, 0.2, 0.4, 3.0])[: len(x)]
        got = np.unpackbits(index.collisions(center, half).view(np.uint8), axis=1, bitorder="little")
        assert not got[:, n:].any()
        for i, (c, h) in enumerate(zip(center, half, strict=True)):
            count = np.zeros(n, int)
            for k in range(lines):  # windows begin and end at the kept places, outside the radius
                order = np.argsort(at[:, k])
                bounds = np.arange(min(embeddings.CELLS, n) + 1) * n // min(embeddings.CELLS, n)
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    p = at[order[a:b], k]
                    count[order[a:b]] += (p.max() >= c[k] - h - 1e-12) and (p.min() <= c[k] + h + 1e-12)
            assert ((np.abs(at - c) <= h).sum(1) <= count).all()
            assert (got[i, :n].astype(bool) == (count >= np.ceil(threshold * lines))).all()


def test_nearest_that_single_precision_cannot_tell_apart():
    rng = np.random.default_rng(11)
    x = rng.normal(size=8) + np.append(rng.permutation(500), np.full(500, -1e10))[:, None] * 1e-10 * rng.normal(size=8)
    found, score, _ = embeddings.CollisionIndex(np.arange(1000), x).search(x[:1] * 3, np.array([0]), 20)[0]
    want = (x * (x[0] * 3)).sum(1)
    order = [i for i in np.lexsort((np.arange(1000), -want)).tolist() if i][:20]
    assert found.tolist() == order and score.tolist() == want[order].tolist()


def test_searches_of_unrelated_vectors_cost_less_than_scans():
    """CPU seconds against an exact scan with the scores' own formula; one search took three scans before."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(16384, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    index = embeddings.CollisionIndex(np.arange(len(x)), x)
    start = time.thread_time()
    got = index.search(x[:100], np.arange(100), 20)
    search, start = time.thread_time() - start, time.thread_time()
    want = []
    for i in range(100):
        score = (x * x[i]).sum(1)
        score[i] = -9
        want.append(set(np.argpartition(-score, 20)[:20].tolist()))
    assert np.mean([len(w & set(f.tolist())) / 20 for w, (f, _, _) in zip(want, got, strict=True)]) >= 0.9
    assert search < time.thread_time() - start


def test_normalised_vectors_are_of_one_span(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 64))
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    df = spark.createDataFrame([([float(np.float32(v)) for v in r],) for r in x], "v array<double>")
    assert [r.s for r in df.select(embeddings.span_of("v").alias("s")).distinct().collect()] == [0]
    odd = [[3e300, 4e300], [-3e-300, 4e-300], [0.0, -1.0], [1.4, 0.0], [1.5, 0.0]]
    got = spark.createDataFrame([(i, v) for i, v in enumerate(odd)], "i int, v array<double>").select("i", embeddings.span_of("v").alias("s"))
    assert [r.s for r in got.orderBy("i").collect()] == [999, -994, 0, 0, 1]
