"""N-gram Jaccard join by grouped prefixes.

Documents become sets of word shingles. Sets that are equal are one class. Classes with identical prefixes and size are
one group; an inverted index over the groups' prefixes finds the tokens that groups share. The groups of a token's list
are expanded to their members, pairs are filtered by size, by the places of the token and by a bound on their symmetric
difference, and what remains is verified on whole sets.

Prefixes take the rarest shingles first, by a count sketch of all documents (a fixed 8 MB), so passages that many
documents share stay out of the index. Candidates come in rounds: for each member of a list its first possible partner;
the same across the components that those links make; then all possible pairs of a list that are still not connected.
So a large group of near copies costs some verifications a member, not one a pair, and no link between components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common

WORDS, PERCENT = 4, 85
SKETCH_BITS = 20
#: Members of a posting list that are paired at once; longer lists are split into pairs of blocks.
BLOCK = 512
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Each text's sorted distinct shingle hashes; a text of fewer than k words has its whole sequence as one."""
    data, offsets = common.utf8(texts)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + (1 << 20), "right")) - 1)
        d, o = _LOWER[data[offsets[i] : offsets[j]]], offsets[i : j + 1] - offsets[i]
        start, end, w = common.words(d, o) if len(d) else (np.zeros(0, int),) * 2 + (np.zeros(j - i + 1, int),)
        p = common.Prefixes(common.word_hashes(d, start, end)) if len(start) else None
        grams = common.mix(p.grams(k)) if p else None
        for a, b in zip(w[:-1].tolist(), w[1:].tolist(), strict=True):
            if a == b:
                yield np.zeros(0, np.uint64)
            elif b - a < k:
                yield common.mix(p.of(np.array([a]), np.array([b])) + np.uint64(b - a))
            else:
                s = np.sort(grams[a : b - k + 1])
                new = np.ones(len(s), bool)
                new[1:] = s[1:] != s[:-1]
                yield s[new]
        i = j


def count_sketch(docs: DataFrame, k: int, bits: int = SKETCH_BITS) -> np.ndarray:
    """In how many documents the shingles of each of 2**bits hash cells occur, over all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(1 << bits, np.uint64)
        for batch in batches:
            sets = list(shingle_sets(batch.column(0), k))
            if sets:
                sums += np.bincount((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits).astype(np.uint64)
        yield common.cut_blobs(sums)

    blobs = common.fixed_blobs(docs.select("text").mapInArrow(run, "part int, blob binary"), "uint64")
    return np.frombuffer(b"".join(blobs), np.uint64) if blobs else np.zeros(1 << bits, np.uint64)


def order_of(counts: np.ndarray) -> np.ndarray:
    """Counts as 20 bits in the same order: exact up to 8,192, beyond that by their leading 13 bits, without an upper end."""
    return (counts.astype(np.float32).view(np.uint32) >> np.uint32(11)).astype(np.uint64)


def odd_bits(x: np.ndarray) -> bytes:
    """1,024 bits: each hash flips one. Two sets differ in at least as many elements as their bits differ."""
    return np.packbits((np.bincount((x >> np.uint64(54)).astype(np.int64), minlength=1024) & 1).astype(np.uint8)).tobytes()


def signatures(docs: DataFrame, k: int, percent: int, sketch: np.ndarray, bits: int = SKETCH_BITS) -> DataFrame:
    """doc_id, n (set size), h1, h2 (of the set), ph (of the prefix), prefix (hashes, rarest first), parity (see ``odd_bits``)."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = order_of(shared.value)
        for batch in batches:
            n, h, prefixes, parities = [], [], [], []
            for s in shingle_sets(batch.column(1), k):
                n.append(len(s))
                x = common.mix(s + np.uint64(0x9E3779B97F4A7C15))
                length = len(s) - (percent * len(s) + 99) // 100 + 1 if len(s) else 0
                rank = (counts[s >> np.uint64(64 - bits)] << np.uint64(44)) | (x >> np.uint64(20))
                if length < len(s):
                    near = np.flatnonzero(rank <= np.partition(rank, length - 1)[length - 1])
                    near = near[np.argsort(rank[near], kind="stable")][:length]
                else:
                    near = np.argsort(rank, kind="stable")
                p = s[near]
                prefixes.append(p.tobytes())
                parities.append(odd_bits(x))
                seq = common.mix(p * np.uint64(2) + np.uint64(1)) * (np.arange(len(p), dtype=np.uint64) * np.uint64(2) + np.uint64(1))
                h.append((int(x.sum(dtype=np.uint64)), int(common.mix(x ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)), int(seq.sum(dtype=np.uint64))))
            hs = np.array(h, np.uint64).reshape(-1, 3).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), *(pa.array(hs[:, c]) for c in range(3)), pa.array(prefixes, pa.binary()), pa.array(parities, pa.binary())], names=["doc_id", "n", "h1", "h2", "ph", "prefix", "parity"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n int, h1 long, h2 long, ph long, prefix binary, parity binary")


def shared_tokens(groups: DataFrame, parts: int) -> DataFrame:
    """Postings (token, id, n, pos) of the prefix tokens that at least two groups have.

    Postings travel as packed arrays by token bucket, one a batch and bucket, so 20 million of them are some thousand rows.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, lens = common.utf8(batch.column(2))
            tokens, lens = tokens.view(np.uint64) if len(tokens) else np.zeros(0, np.uint64), np.diff(lens) // 8
            ids, n = np.repeat(batch.column(0).to_numpy(), lens), np.repeat(batch.column(1).to_numpy(), lens)
            pos = (np.arange(len(tokens)) - np.repeat(np.cumsum(lens) - lens, lens)).astype(np.int32)
            bucket = (tokens % np.uint64(parts)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(parts + 1))
            cols = [c[order] for c in (tokens, ids, n.astype(np.int32), pos)]
            rows = [(b, [c[cuts[b] : cuts[b + 1]].tobytes() for c in cols]) for b in range(parts) if cuts[b] < cuts[b + 1]]
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), *(pa.array([r[c] for _, r in rows], pa.binary()) for c in range(4))], names=["bucket", "token", "id", "n", "pos"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[], [], [], []]
        for batch in batches:
            for c in range(4):
                got[c] += batch.column(c + 1).to_pylist()
        if not got[0]:
            return
        token, ids, n, pos = (np.frombuffer(b"".join(x), t) for x, t in zip(got, ("u8", "i8", "i4", "i4"), strict=True))
        order = np.lexsort((ids, token))
        t, i = token[order], ids[order]
        again = np.zeros(len(t), bool)  # a repeated row
        again[1:] = (t[1:] == t[:-1]) & (i[1:] == i[:-1])
        order = order[~again]
        t = token[order]
        twin = np.zeros(len(t), bool)
        twin[1:] = t[1:] == t[:-1]
        twin[:-1] |= twin[1:].copy()
        keep = order[twin]
        for at in range(0, len(keep), 100_000):
            k = keep[at : at + 100_000]
            yield pa.record_batch({"token": pa.array(token[k].view(np.int64)), "id": pa.array(ids[k]), "n": pa.array(n[k]), "pos": pa.array(pos[k])})

    packed = groups.select("id", "n", "prefix").mapInArrow(pack, "bucket int, token binary, id binary, n binary, pos binary")
    return packed.repartition(parts, "bucket").mapInArrow(find, "token long, id long, n int, pos int")


def candidates(lists: DataFrame, bits: DataFrame, percent: int, comp: DataFrame | None = None, block: int = BLOCK, first: bool = True) -> DataFrame:
    """Pairs (a > b) of a list that may meet the threshold.

    lists: token, id, n, pos; bits: id, n, parity (null: unknown), joined last, as it is the widest. Two sets of sizes na
    and nb need an overlap of need = percent / (100 + percent) * (na + nb), so the token that they share first stands at
    na - need and nb - need at most, and they differ in na + nb - 2 * need elements at most.

    Without ``comp``, a first look: of one list in eight, each member's first possible partner, which is linear in the
    lists. With it only members of different components are paired: each one's first possible partner with ``first``,
    else all of them, whatever the looks before have found.
    """
    w = Window.partitionBy("token")
    if comp is None:
        lists = lists.where(F.pmod("token", F.lit(8)) == 0).withColumn("c", F.col("id")).withColumn("_n", F.count(F.lit(1)).over(w)).where("_n > 1")
    else:
        lists = lists.join(comp, "id", "left").withColumn("c", F.coalesce("component_id", "id")).drop("component_id")
        lists = lists.withColumn("_n", F.count(F.lit(1)).over(w)).withColumn("_lo", F.min("c").over(w)).withColumn("_hi", F.max("c").over(w)).where("_lo <> _hi").drop("_lo", "_hi")
    parts = common.block_pairs(lists, "id", block).join(bits, ["id", "n"])

    def pairs(t: pa.Table, starts: np.ndarray) -> pa.RecordBatch | None:
        ends = np.append(starts[1:], t.num_rows)
        ids, n, pos, c, own, bi, bj = (t.column(x).to_numpy() for x in ("id", "n", "pos", "c", "own", "bi", "bj"))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        parity = t.column("parity").combine_chunks() if isinstance(t.column("parity"), pa.ChunkedArray) else t.column("parity")
        unknown = parity.is_null().to_numpy(zero_copy_only=False)
        raw, _ = common.utf8(pc.coalesce(parity, pa.scalar(bytes(128))))
        odd = raw.reshape(-1, 128).view(np.uint64)
        out = []
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if e - s < 2:
                continue
            for at in range(s, e - 1, 256):  # some rows against all after them, so that memory is bounded
                a, b = np.meshgrid(np.arange(at, min(at + 256, e - 1)), np.arange(at + 1, e), indexing="ij")
                a, b = a.ravel(), b.ravel()
                on = (a < b) & (c[a] != c[b]) & (np.minimum(n[a], n[b]) * 100 >= np.maximum(n[a], n[b]) * percent)
                if bi[s] != bj[s]:
                    on &= own[a] != own[b]
                a, b = a[on], b[on]
                need = -(-(n[a] + n[b]) * percent // (100 + percent))
                on = (pos[a] <= n[a] - need) & (pos[b] <= n[b] - need)
                a, b, need = a[on], b[on], need[on]
                differ = np.bitwise_count(odd[a] ^ odd[b]).sum(1, dtype=np.int64)
                on = (differ <= n[a] + n[b] - 2 * need) | unknown[a] | unknown[b]
                a, b = a[on], b[on]
                if first and len(a):
                    keep = np.union1d(np.unique(a, return_index=True)[1], np.unique(b, return_index=True)[1])
                    a, b = a[keep], b[keep]
                out.append((np.maximum(ids[a], ids[b]), np.minimum(ids[a], ids[b])))
        if not out:
            return None
        ab = np.unique(np.stack([np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])]), axis=1)
        return pa.record_batch({"a": pa.array(ab[0]), "b": pa.array(ab[1])})

    return common.grouped(parts, ["token", "bi", "bj"], pairs, "a long, b long", ["n", "id"]).where("a <> b").distinct()


def six_bytes(s: np.ndarray) -> bytes:
    """Sorted hashes by their upper 48 bits: that two different shingles of sets of n and m share them has a chance of
    n * m / 2^48, below 10^-9 up to 500 shingles each and 10^-6 for 17,000."""
    return (s >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def from_six(raw: object) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    out = np.zeros((len(b), 8), np.uint8)
    out[:, :6] = b
    return out.view(np.uint64).ravel()


def verify(pairs: DataFrame, docs: DataFrame, scratch: common.Scratch, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc ids whose whole sets meet the threshold. Only documents in a pair are shuffled, as sets."""
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    flt = docs.sparkSession.sparkContext.broadcast(common.IdFilter(wanted))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            on = np.flatnonzero(flt.value.has(common.ids(batch.column(0))))
            if len(on):
                part = batch.take(pa.array(on))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([six_bytes(s) for s in shingle_sets(part.column(1), k)], pa.binary())], names=["id", "s"])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                s, t = from_six(x.as_buffer()), from_six(y.as_buffer())
                both = int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(t) else 0
                if 100 * both >= percent * (len(s) + len(t) - both) and both:
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    # kept by id, so that neither join shuffles the sets again; rows repeated whole give equal sets; of rows that share an id but not a text, each counts
    made = scratch.keep(docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(sets, "id long, s binary").repartition("id").dropDuplicates(["id", "s"]))
    got = pairs.join(made.withColumnsRenamed({"id": "a", "s": "x"}), "a").join(made.withColumnsRenamed({"id": "b", "s": "y"}), "b")
    links = scratch.put(got.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct())
    made.unpersist()
    scratch.tidy()
    return links


def jaccard_join(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text: str = "text", doc_id: str = "doc_id", block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles long, class_id (smallest id with an equal set), component_id.

    Two documents link when 100 * intersection >= percent * union of their sets of k-word shingles (A-Z lower-cased,
    words cut at white space). A text of fewer than k words is one shingle; a null, empty or blank text has none and
    links with nothing. Rows that share a doc_id are one document. Rows of a null doc_id link with nothing and have a
    null component. Texts of any length are taken whole.
    """
    spark = docs.sparkSession
    common.tune(spark)
    scratch = common.Scratch(spark, "jaccard")
    d = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    wide = scratch.keep(signatures(d, k, percent, count_sketch(d, k)))
    sigs = scratch.keep(wide.drop("prefix", "parity"))
    full = sigs.where("n > 0 and doc_id is not null")
    classes = full.groupBy("n", "h1", "h2", "ph").agg(F.min("doc_id").alias("class_id"))
    members = scratch.put(full.join(classes, ["n", "h1", "h2", "ph"]).select("doc_id", "n", "h1", "h2", "ph", "class_id"))
    reps = members.where("doc_id = class_id").select(F.col("doc_id").alias("id"), "n", "h1", "h2", "ph").distinct()
    groups = scratch.put(reps.join(reps.groupBy("n", "ph").agg(F.min("id").alias("gid"), F.count(F.lit(1)).alias("size")), ["n", "ph"]))
    heads = groups.where("id = gid").select(F.col("id").alias("doc_id"), "n", "h1", "h2", "ph")
    parts = common.partitions(spark, 24.0 * 80 * sigs.count(), 24e6)
    headed = wide.drop("parity").join(heads, ["doc_id", "n", "h1", "h2", "ph"]).select(F.col("doc_id").alias("id"), "n", "prefix")
    postings = scratch.put(shared_tokens(headed, parts).withColumnRenamed("id", "gid"))
    scratch.tidy()
    # a list's groups expand to their members; members of one group also meet under the hash of the prefix they share
    family = groups.where("size > 1").select("gid", "n", "id")
    inside = groups.where("size > 1").select(F.col("ph").alias("token"), "id", "n", F.lit(0).alias("pos"))
    lists = postings.join(family, ["gid", "n"], "left").select("token", F.coalesce("id", "gid").alias("id"), "n", "pos").unionByName(inside)
    lists = scratch.put(lists)
    # an id with two sets of one size has no bits: its pairs are not thinned out by them
    bits = wide.where("doc_id is not null").select(F.col("doc_id").alias("id"), "n", "parity").join(lists.select("id").distinct(), "id", "left_semi")
    bits = scratch.put(bits.groupBy("id", "n").agg(F.min("parity").alias("lo"), F.max("parity").alias("hi")).select("id", "n", F.when(F.col("lo") == F.col("hi"), F.col("lo")).alias("parity")))
    wide.unpersist()
    # rows that share an id are one document, whatever their sets
    twice = members.groupBy("doc_id").agg(F.min("class_id").alias("b"), F.max("class_id").alias("a")).where("a <> b")
    same = members.join(twice.select("doc_id", "b"), "doc_id").select(F.col("class_id").alias("a"), "b").where("a <> b")
    links, near, tried = same, None, None
    for first in (True, True, False):  # a look, a look across components, then all that is left
        found = scratch.put(candidates(lists, bits, percent, near, block, first))
        if near is not None and not found.limit(1).count():
            break
        new = found if tried is None else scratch.put(found.join(tried, ["a", "b"], "left_anti"))
        if tried is not None and not new.limit(1).count():
            continue
        links = links.unionByName(verify(new, d, scratch, k, percent))
        tried = new if tried is None else tried.unionByName(new)
        near = common.components(links, scratch)
    comp = near
    cls = members.select("doc_id", "n", "h1", "h2", "class_id").dropDuplicates(["doc_id", "n", "h1", "h2"])
    out = sigs.select("doc_id", "n", "h1", "h2").join(cls, ["doc_id", "n", "h1", "h2"], "left").join(comp.withColumnRenamed("id", "class_id"), "class_id", "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("component_id", "class_id", "doc_id").alias("component_id"))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(common.table(spark, sf_dir, "documents").select("doc_id", "text")).drop("class_id")
