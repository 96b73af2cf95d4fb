"""The facade on a folder of its own, and rules that its queries can't show."""

import pandas as pd
from pyspark.sql import functions as F

from quillstream.plans import corpus


def test_a_corpus_is_kept_and_opened_again(spark, tmp_path):
    one = spark.createDataFrame([(1, "alpha beta\n12\nalpha beta"), (2, "gamma delta")], "doc_id long, text string")
    two = spark.createDataFrame([(3, "alpha beta\nnew words")], "doc_id long, text string")
    c = corpus.Corpus.empty(spark).submit("first", one, "p").submit("second", two, "p")
    assert c.store.entries.count() == 3 and {r.id for r in c.jobs().collect()} == {"first", "second"}
    glossary = spark.createDataFrame([(0, "alpha", "Alpha"), (1, "beta", "Beta")], "ord int, source string, target string")
    c.put_glossary("g", "Greek", glossary).save(str(tmp_path / "c"))
    again = corpus.Corpus.open(spark, str(tmp_path / "c"))
    assert again.job("second").first()["status"] == "done"
    assert [tuple(r) for r in again.list_glossaries().collect()] == [("g", "Greek", 2)]
    again.export_glossary("g", str(tmp_path / "g"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "g")).count() == 2
    edit = spark.createDataFrame([(1, 0, " better "), (1, 1, "no"), (2, 0, " ")], "doc_id long, seg_no int, result string")
    got = {(r.id, r.doc_id, r.seg_no): r.result for r in again.edit("first", edit).results.collect()}
    assert got["first", 1, 0] == got["first", 1, 2] == "better" and got["first", 1, 1] == "12"
    assert got["first", 2, 0].endswith("gamma delta") and got["second", 3, 0] != "better"
    left, told = again.delete(spark.createDataFrame([("second",), ("gone",), ("gone",)], "id string"))
    assert {tuple(r) for r in told.collect()} == {("second", "deleted"), ("gone", "missing")}
    assert left.jobs_.count() == 1 and left.results.where("id = 'second'").count() == 0
    assert again.drop_glossary("g").glossaries.count() == 0


def test_rules(spark):
    df = spark.createDataFrame([(1, None), (5, "x"), (9, "yy")], "n int, t string")
    assert [r.s for r in df.select(corpus.skips(F.col("t") == "x", F.col("n") > 7).alias("s")).collect()] == [False, True, True]
    assert df.agg(corpus.share(F.col("n") > 4, F.col("n")).alias("s")).first().s == 14 / 15
    assert df.where("false").agg(corpus.share(F.col("n") > 4, F.col("n")).alias("s")).first().s == 0.0


def test_a_renderer_sees_whole_parts_in_order(spark):
    corpus.register_renderer("joined", lambda pdf: pd.DataFrame({"part": [pdf["part"].iloc[0]], "out": ["".join(pdf["text"])]}))
    rows = spark.createDataFrame([(1, 2, "b"), (2, 0, "z"), (1, 0, "a"), (1, 9, "c")], "part long, ord int, text string").repartition(3)
    assert {tuple(r) for r in corpus.rendered(rows, "joined").collect()} == {(1, "abc"), (2, "z")}
