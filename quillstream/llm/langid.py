"""Language identification: multinomial naive Bayes over hashed character n-grams.

The counts are summed over all learning documents on the executors; the log-probability matrix (languages x 2**bits)
is broadcast, its size fixed by ``bits`` and the number of languages; scoring gathers rows of it in numpy batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import common

BITS = 14
ORDERS = (1, 2, 3)
#: Most cells of a model (languages x buckets): the bound of what is broadcast and sent to the driver. More than 1,024
#: languages share fewer buckets; none is left out.
CELLS = 1 << 24
#: Code points handled at once.
PIECE = 1 << 20
FOLD, HELD = 4, 2


def code_points(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased texts as code points: letters stay, digits and symbols become 0, white space 32. And offsets."""
    low = pc.utf8_lower(texts.fill_null(""))
    data, offsets = common.utf8(low)
    lead = (data & 0xC0) != 0x80
    marks = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=marks[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
    offs = marks[offsets]
    points = points.copy()
    points[(points >= 9) & (points <= 13)] = 32
    points[(points < 97) & (points != 32) | (points > 122) & (points < 128)] = 0
    return points, offs


def has_letter(texts: pa.Array) -> np.ndarray:
    return pc.match_substring_regex(texts.fill_null(""), r"\p{L}").to_numpy(zero_copy_only=False)


def features(points: np.ndarray, offs: np.ndarray, bits: int, orders: tuple = ORDERS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (buckets, offsets into them by text), one for each n-gram order; n-grams don't cross texts."""
    shift, h = np.uint32(32 - bits), np.zeros(len(points), np.uint32)
    for n in range(1, max(orders) + 1):
        if n > 1:
            h = h[:-1]
        if len(h) <= 0:
            return
        h = h * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(1)
        if n not in orders:
            continue
        b = ((h * np.uint32(0x9E3779B1)) >> shift).astype(np.int32)
        yield b, np.minimum(offs, len(b)), n


def pieces(points: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PIECE code points."""
    i = 0
    while i < len(offs) - 1:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + PIECE, "right")) - 1)
        yield i, j
        i = j


def inside(b: np.ndarray, offs: np.ndarray, n: int) -> np.ndarray:
    """Which n-grams lie in one text."""
    ok = np.ones(len(b), bool)
    for k in range(1, n):
        at = offs[1:-1] - k
        ok[at[(at >= 0) & (at < len(b))]] = False
    return ok


class LangModel:
    def __init__(self, langs: list[str], logp: np.ndarray, prior: np.ndarray, bits: int, orders: tuple):
        self.langs, self.logp, self.prior, self.bits, self.orders = langs, logp, prior, bits, orders

    def scores(self, texts: pa.Array) -> np.ndarray:
        """Mean log probability of each text's n-grams, by language."""
        points, offs = code_points(texts)
        out = np.zeros((len(texts), len(self.langs)))
        for i, j in pieces(points, offs):
            p, o = points[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
            count = np.zeros(j - i)
            total = np.zeros((j - i, len(self.langs)))
            for b, _, n in features(p, o, self.bits, self.orders):
                got = self.logp[b]
                got[~inside(b, o, n)] = 0
                run = np.zeros((len(b) + 1, got.shape[1]))
                np.cumsum(got, axis=0, out=run[1:])
                at = np.minimum(o, len(b))
                total += run[at[1:]] - run[at[:-1]]
                count += np.maximum(np.diff(o) - n + 1, 0)
            out[i:j] = total
            out[i:j] += self.prior
            self_len = np.maximum(count, 1)
            out[i:j] /= self_len[:, None] ** 0.5  # n-grams overlap: temper, so that scores don't all round to 1
        return out

    def predict(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.langs:
            return np.full(len(texts), "und", dtype=object), np.zeros(len(texts))
        s = self.scores(texts)
        best = s.argmax(1)
        e = np.exp(s - s.max(1, keepdims=True))
        p = e.max(1) / e.sum(1)
        none = ~has_letter(texts)
        lang = np.array(self.langs, dtype=object)[best]
        lang[none] = "und"
        return lang, np.where(none, 0.0, p)


def train(docs: DataFrame, text: str = "text", lang: str = "lang", bits: int = BITS, orders: tuple = ORDERS, alpha: float = 0.3) -> LangModel:
    """Counts of all rows with a lang. Each task sums into one array a language; the arrays are summed by language.

    Rows that repeat count as often as they come. Of more languages than ``CELLS`` allows, n-grams share larger buckets.
    """
    n_langs = docs.agg(F.countDistinct(lang)).first()[0]
    while bits > 4 and n_langs << bits > CELLS:
        bits -= 1
    size = 1 << bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        docs_of: dict[str, int] = {}
        for batch in batches:
            t, names = batch.column(0), np.array(batch.column(1).to_pylist(), dtype=object)
            points, offs = code_points(t)
            for name in set(names):
                sums.setdefault(name, np.zeros(size, np.int64))
                docs_of[name] = docs_of.get(name, 0) + int((names == name).sum())
            keys, code = np.unique(names.astype(str), return_inverse=True)
            for i, j in pieces(points, offs):
                p, o = points[offs[i] : offs[j]], offs[i : j + 1] - offs[i]
                which = np.repeat(code[i:j], np.diff(o)).astype(np.int64) << bits
                for b, _, n in features(p, o, bits, orders):
                    ok = inside(b, o, n)
                    c = np.bincount((b + which[: len(b)])[ok], minlength=size * len(keys)).reshape(len(keys), size)
                    for k, name in enumerate(keys):
                        sums[name] += c[k]
        for name, v in sums.items():
            yield pa.record_batch({"lang": [name], "n": pa.array([docs_of[name]], pa.int64()), "counts": pa.array([v.astype(np.uint32 if v.max() < 2**32 else np.uint64).tobytes()], pa.binary()), "width": pa.array([4 if v.max() < 2**32 else 8], pa.int32())})

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        n: dict[str, int] = {}
        for batch in batches:
            for row in batch.to_pylist():
                v = np.frombuffer(row["counts"], np.uint32 if row["width"] == 4 else np.uint64).astype(np.int64)
                sums[row["lang"]] = sums.get(row["lang"], 0) + v
                n[row["lang"]] = n.get(row["lang"], 0) + row["n"]
        for name in sums:
            yield pa.record_batch({"lang": [name], "n": pa.array([n[name]], pa.int64()), "counts": pa.array([sums[name].tobytes()], pa.binary()), "width": pa.array([8], pa.int32())})

    schema = "lang string, n long, counts binary, width int"
    part = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang")).mapInArrow(count, schema)
    # two steps, so that a language of most documents isn't summed by one task alone
    part = part.withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(16))).repartition("lang", "salt").drop("salt").mapInArrow(total, schema)
    rows = part.repartition("lang").mapInArrow(total, schema).collect()
    rows = sorted(rows, key=lambda r: r["lang"])
    if not rows:
        return LangModel([], np.zeros((size, 0), np.float32), np.zeros(0), bits, orders)
    counts = np.stack([np.frombuffer(r["counts"], np.int64) for r in rows]).astype(float)
    logp = np.log((counts + alpha) / (counts.sum(1, keepdims=True) + alpha * size))
    prior = np.log(np.array([r["n"] for r in rows], float) / sum(r["n"] for r in rows))
    return LangModel([r["lang"] for r in rows], np.ascontiguousarray((logp - logp.mean(0)).T.astype(np.float32)), prior, bits, orders)


def identify(docs: DataFrame, model: LangModel, text: str = "text") -> DataFrame:
    """Adds lang_pred and score to docs (columns of those names are replaced).

    A null text and a text without letters are ``und`` with score 0; an empty table gives no rows; a model learned from
    no rows predicts ``und`` throughout. Texts of any length are read whole, in pieces of code points. Each row is judged
    alone, so repeated rows and ids are as many results; equal scores go to the language first in order.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score")]
    d = docs.select(*keep)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(keep.index(text)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores)], names=[*keep, "lang_pred", "score"])

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")
    return d.mapInArrow(run, schema)


def op9_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.tune(spark)
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLD)) == HELD
    docs = docs.withColumn("held_out", F.coalesce(held, F.lit(False)))
    model = train(docs.where(~F.col("held_out")).select("text", "lang"))
    # the text goes to Python and does not come back
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = shared.value.predict(batch.column(2))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(langs, pa.string()), pa.array(scores)], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
