"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

All stages but the last return the columns of documents. The near-duplicate stage takes shingles of five words and a
similarity of 0.8; mixing repeats a document for each whole epoch that its source needs, and cuts the border document of
a source to its first words (joined by single spaces).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.llm import common, jaccard, mixing, pieces, pii, quality

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    common.tune(spark)
    model = quality.train(docs, common.table(spark, sf_dir, "labels").where(~quality.held_out()))
    return quality.score_quality(docs.select(*COLUMNS), model).where("predicted = 1").select(*COLUMNS)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates, that of the smallest id; rows of one id are one document."""
    groups = jaccard.jaccard_join(docs, k=5, percent=80)
    gone = groups.where("component_id <> doc_id").select("doc_id").distinct()
    left = docs.select(*COLUMNS).where("doc_id is not null").join(gone, "doc_id", "left_anti")
    once = left.withColumn("_n", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.xxhash64("text")))).where("_n = 1")
    return once.select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind."""
    common.tune(spark)
    found = pii.find_pii(docs.select(*COLUMNS), pii.trained(spark), redacted=True)
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats, keeps, cuts or drops documents so that each source has the words of its target."""
    mixed = mixing.mix_sources(docs.select(*COLUMNS)).where("taken > 0")
    whole, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.pmod("taken", "size").cast("int")
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    copies = F.concat(F.array_repeat("text", whole), F.when(part > 0, F.array(F.array_join(F.slice(words, 1, part), " "))).otherwise(F.array().cast("array<string>")))
    return mixed.withColumn("text", F.explode(copies)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pieces_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes the texts; ids take the place of text."""
    common.tune(spark)
    return pieces.encode_pieces(docs.select(*COLUMNS), pieces.PieceModel.load())


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("personal data", pii_stage),
    ("mixing sources", mixing_stage),
    ("SentencePiece encoding", pieces_stage),
]

#: The classifier, the field and the encoder can't be put in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = common.Scratch(spark, "pipeline")
    docs = common.table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
