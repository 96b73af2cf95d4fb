"""Suffix sort, fingerprint index and Jaccard join against brute force."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from quillstream.llm import common, fingerprints, jaccard, matching, suffixes

DOC = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("kept", T.StringType())])
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=120):
    """Prose with copies, near copies, shared lines and passages, and odd texts."""
    rng = np.random.default_rng(seed)
    vocab = ["".join(rng.choice(list("abcdeé"), int(rng.integers(1, 8)))) for _ in range(400)]
    prose = lambda k: " ".join(rng.choice(vocab, k))
    passage, line = prose(40), "Shared line of thirty-odd bytes.\n"
    texts = []
    for i in range(n):
        t = prose(int(rng.integers(1, 90)))
        kind = i % 8
        if kind == 1 and texts:
            t = texts[int(rng.integers(0, len(texts)))]
        elif kind == 2 and texts:
            w = texts[int(rng.integers(0, len(texts)))].split(" ")
            w[int(rng.integers(0, len(w)))] = "edit"
            t = " ".join(w)
        elif kind == 3:
            t = t[: len(t) // 2] + passage[int(rng.integers(0, 60)) :] + t[len(t) // 2 :]
        elif kind == 4:
            t = line + t + "\n" + line
        elif kind == 5:
            t = t + " " + t
        texts.append(t)
    base = prose(60).split(" ")
    for i in range(40):  # a group of near copies
        w = list(base)
        w[i % 60] = f"x{i}"
        texts.append(" ".join(w))
    texts += ["", None, " \n ", "a" * 200, "a" * 200 + "b", "ab " * 300, "One two", "one  TWO", "one two three", "é" * 60, "z" * 49, "z" * 50, "z" * 51]
    ids = rng.permutation(len(texts)).tolist()
    rows = [(int(i), t, 0, "k") for i, t in zip(ids, texts, strict=True)]
    return rows + [rows[5], (None, passage, 0, None), (ids[7], texts[9], 0, None)]


def brute_runs(seqs, length):
    """Removed flags of (id, tokens) rows."""
    least = {}
    for i, s in seqs:
        for a in range(len(s) - length + 1):
            k = s[a : a + length]
            least[k] = min(least.get(k, i), i)
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for a in range(len(s) - length + 1):
            if least[s[a : a + length]] < i:
                gone[a : a + length] = [True] * length
        out.append(gone)
    return out


NO = 2**63 - 1


@pytest.mark.parametrize(("hot", "chunk"), [(8192, 1 << 20), (8192, 600), (2, 600)])
def test_suffixes_equal_brute_force(spark, monkeypatch, hot, chunk):
    monkeypatch.setattr(matching, "HOT", hot)
    monkeypatch.setattr(matching, "CHUNK", chunk)
    rows = corpus()
    seqs = [(NO if i is None else i, (t or "").encode()) for i, t, _, _ in rows]
    want = sorted(("None" if i == NO else str(i), len(s), sum(g), sum(a and not b for a, b in zip(g, [False, *g], strict=False)), hashlib.sha256(bytes(c for c, x in zip(s, g, strict=True) if not x)).hexdigest()) for (i, s), g in zip(seqs, brute_runs(seqs, 50), strict=True))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, DOC).repartition(3)).drop("kept").collect()
    assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


@pytest.mark.parametrize("chunk", [1 << 20, 600])
def test_fingerprints_equal_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(matching, "CHUNK", chunk)
    rows = corpus(2)
    seqs = [(NO if i is None else i, tuple(WORD.findall(t or ""))) for i, t, _, _ in rows]
    want = sorted(("None" if i == NO else str(i), len(s), sum(g), hashlib.sha256(" ".join(w for w, x in zip(s, g, strict=True) if not x).encode()).hexdigest()) for (i, s), g in zip(seqs, brute_runs(seqs, 13), strict=True))
    for batches in (1, 5):
        got = fingerprints.remove_known(spark.createDataFrame(rows, DOC).repartition(3), batches=batches).drop("kept").collect()
        assert sorted((str(r.doc_id), *r[1:]) for r in got) == want


def test_an_index_outlives_the_call(spark, tmp_path):
    """Two calls with an opened index, the second with later ids, against one pass over all."""
    rows = [r for r in corpus(6) if r[0] is not None]
    seqs = [(i, tuple(WORD.findall(t or ""))) for i, t, _, _ in rows]
    want = {}
    for (i, s), g in zip(seqs, brute_runs(seqs, 13), strict=True):
        want.setdefault(i, []).append((len(s), sum(g)))
    cut = sorted(i for i, _ in seqs)[len(seqs) // 2]
    df = spark.createDataFrame(rows, DOC)
    root = f"{tmp_path}/index"
    one = fingerprints.remove_known(df.where(f"doc_id <= {cut}"), index=fingerprints.FingerprintIndex(spark, root), batches=2).collect()
    again = fingerprints.FingerprintIndex.open(spark, root)
    assert again.runs and len(again.chunks) == 2
    two = fingerprints.remove_known(df.where(f"doc_id > {cut}"), index=again, batches=3).collect()
    got = {}
    for r in one + two:
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in want.items()}
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("quill_")]
    levels = [level for level, _ in fingerprints.FingerprintIndex.open(spark, root).runs]
    assert len(levels) == len(set(levels)) < 5


def test_the_past_is_not_shuffled(spark, tmp_path):
    index = fingerprints.FingerprintIndex(spark, f"{tmp_path}/index")
    fingerprints.remove_known(spark.createDataFrame(corpus(2)[:60], DOC), index=index, batches=2)
    old, new = (index._run(index.runs[-1][1]) for _ in range(2))
    plan = old.groupBy("bucket").cogroup(new.groupBy("bucket")).applyInArrow(fingerprints._merge_join, matching.MAIL)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_merging_runs_keeps_their_order():
    rng = np.random.default_rng(3)
    runs = []
    for n in (5000, 1, 3000):
        h, chunk = rng.integers(0, 2000, n).astype(np.uint64), rng.integers(0, 9, n)
        o = np.lexsort((chunk, h))
        runs.append(fingerprints._rows(4, h[o], chunk[o], np.zeros(n, np.uint8)))
    t = fingerprints._merge_runs(fingerprints._merge_runs(runs[0], runs[1]), runs[2])
    h, chunk, _ = fingerprints._postings(t)
    assert (np.diff(h.astype(np.int64)) >= 0).all() and len(h) == 8001
    assert sorted(zip(h.tolist(), chunk.tolist(), strict=True)) == sorted(x for r in runs for x in zip(*(c.tolist() for c in fingerprints._postings(r)[:2]), strict=True))


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOC)
    assert suffixes.remove_repeats(none).count() == 0
    assert fingerprints.remove_known(none).count() == 0
    assert jaccard.jaccard_join(none).count() == 0


def brute_jaccard(rows, k, percent):
    sets = []
    for i, t, _, _ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append((i, {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()))
    parent = {i: i for i, _ in sets if i is not None}

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for x in range(len(sets)):
        for y in range(x):
            (i, s), (j, t) = sets[x], sets[y]
            if None not in (i, j) and s and t and 100 * len(s & t) >= percent * len(s | t):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return sorted((str(i), len(s), str(None if i is None else root(i))) for i, s in sets)


@pytest.mark.parametrize(("k", "percent", "block"), [(4, 85, 512), (2, 60, 4), (1, 50, 8)])
def test_jaccard_equals_brute_force(spark, k, percent, block):
    rows = corpus(3)
    got = jaccard.jaccard_join(spark.createDataFrame(rows, DOC).repartition(3), k=k, percent=percent, block=block).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_jaccard(rows, k, percent)


def test_shingle_sets_of_whole_long_texts():
    text = " ".join(f"w{i}" for i in range(30_000))
    assert [len(s) for s in jaccard.shingle_sets(pa.array([text, "", "a b", None]), 4)] == [29_997, 0, 1, 0]


def test_suffix_sort_equals_sorting():
    rng = np.random.default_rng(0)
    text = rng.integers(97, 99, 3000).astype(np.uint8)
    at = rng.choice(2900, 500, replace=False)
    group = np.sort(rng.integers(0, 7, 500))
    order = suffixes.suffix_sort(text, at, group, np.full(500, 40), common.Prefixes(common.BYTE_VALUES[text]))
    raw = text.tobytes()
    assert order.tolist() == sorted(range(500), key=lambda i: (group[i], raw[at[i] : at[i] + 40], i))


@pytest.mark.parametrize("unit", ["bytes", "words"])
def test_colliding_hashes_never_remove_what_differs(monkeypatch, unit):
    """With values that make every hash of equal length equal, only equal bytes count as equal."""
    monkeypatch.setattr(matching, "token_values", lambda data, start: np.ones(len(start) - 1, np.uint64))
    texts = [b"aa bb cc dd ", b"aa bb cc de ", b"aa bb cc dd "]
    n = 12 if unit == "bytes" else 4
    heads = np.array([[7, 1], [7, 2], [7, 3]], np.int64)
    pool = matching.Pool(unit, heads, np.array([[0, n]] * 3, np.uint16), np.array([12] * 3), np.frombuffer(b"".join(texts), np.uint8))
    context, first, last = suffixes.repeated(pool, n)
    assert 1 not in context.tolist() and (first == 0).all() and (last == 0).all()


def test_components(spark):
    rng = np.random.default_rng(1)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5000)]
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        p, q = sorted((root(a), root(b)))
        parent[q] = p
    got = common.components(spark.createDataFrame(edges, "a long, b long"), common.Scratch(spark, "test")).collect()
    want = {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert {r.id: r.component_id for r in got} == want and len(got) == len(want)


def test_counts_keep_their_order_without_an_upper_end():
    counts = np.array([0, 1, 2, 4095, 4096, 8191, 2**20, 2**21, 2**32, 2**40, 2**62], np.uint64)
    got = jaccard.order_of(counts)
    assert (np.diff(got.astype(np.int64)) > 0).all() and got.max() < 2**20
    assert len(set(jaccard.order_of(np.arange(8192, dtype=np.uint64)).tolist())) == 8192
