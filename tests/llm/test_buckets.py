"""What one task holds of the search for equal stretches does not grow with the files of the input."""

import numpy as np
from pyspark.sql import functions as F

from quillstream.llm import matching


def test_chunks_of_one_task_go_to_several_buckets(spark, tmp_path):
    docs = spark.range(60).coalesce(1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("abcdefgh"), matching.CHUNK // 8).alias("text"))
    chunks = matching.chunk_table(docs, f"{tmp_path}/chunks", 8)
    sizes = [r["count"] for r in chunks.groupBy(F.pmod(F.hash("chunk"), F.lit(8))).count().collect()]
    assert sum(sizes) == 60 == chunks.select("chunk").distinct().count()
    assert max(sizes) <= matching.RUN_OF_CHUNKS


def test_a_task_holds_one_bucket_at_a_time(spark):
    rows = [(kind, bucket, chunk, b"12345678", b"", b"", b"") for kind in (0, 1) for bucket in range(10) for chunk in range(bucket + 1)]
    mail = spark.createDataFrame(rows, matching.MAIL)

    def count(kind, chunks, blobs):
        assert len(matching.spread(blobs[0], "u8")[0]) == len(chunks)
        yield matching.to_chunk(kind, [len(chunks)], [[b""]])

    got = matching.at_buckets(mail, 1, count).select("kind", "chunk").collect()
    assert sorted(map(tuple, got)) == [(kind, n) for kind in (0, 1) for n in range(1, 11)]
    assert isinstance(matching.spread([b"12345678"], "u8")[0], np.ndarray)
