"""Small inputs on which a query once failed or left its SQL."""

import datetime

import duckdb
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.functions import mining
from quillstream.functions import text as X
from quillstream.operators import relational, terms
from quillstream.operators.store import Store
from quillstream.plans import corpus, dataflow
from quillstream.streaming import queries as streams
from tests.test_queries import rows


def sql_rows(folder, query, *tables):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet{'/*.parquet' if (folder / f'{t}.parquet').is_dir() else ''}'")
    return rows(con.execute(query).df())


def documents(folder, texts, parts=0):
    """documents.parquet of these texts: one file, or a folder of several."""
    df = pd.DataFrame({"doc_id": range(len(texts)), "text": texts, "lang": "de", "source": "a", "n_chars": [len(t) for t in texts]})
    if not parts:
        df.to_parquet(folder / "documents.parquet")
        return
    (folder / "documents.parquet").mkdir()
    for k in range(parts):
        df[df.doc_id % parts == k].to_parquet(folder / f"documents.parquet/part-{k}.parquet")


def test_glossaries_change_case_letter_by_letter(spark, tmp_path):
    documents(tmp_path, ["Große Straße. " * 4 + "İki Söz. " * 3, "Große Straße, ΟΔΟΣ Νέα. " * 3 + "ﬁne Maß. " * 5, "ᾳδης Λόγος. Große Maße. " * 4])
    assert rows(terms.glossary_union(spark, str(tmp_path)).toPandas()) == sql_rows(tmp_path, terms.ORACLE["glossary_union"], "documents")
    t = spark.createDataFrame([("Straße ŉ ﬁ ᾳ Ω😀", "İ ΟΔΟΣ")], "a string, b string").select(X.upper(F.col("a")), X.lower(F.col("b"))).first()
    assert tuple(t) == ("STRAẞE ŉ ﬁ ᾼ Ω😀", "i οδοσ")


def test_a_stream_reads_a_folder_of_files_as_it_reads_one_file(spark, tmp_path):
    texts = ["\n".join("x" * (k * 37 % 900 + 1) for k in range(n)) for n in (0, 3, 25, 41, 60)]
    documents(tmp_path, texts, parts=3)
    assert rows(streams.stream_batches(spark, str(tmp_path)).toPandas()) == sql_rows(tmp_path, streams.ORACLE["stream_batches"], "documents")


def test_unions_of_intervals_take_unknown_dates_as_their_sql_does(spark, tmp_path):
    day = lambda n: None if n is None else datetime.datetime(1997, 4, 1) + datetime.timedelta(n)
    dates = [(1, 3, 1), (1, 3, None), (1, 40, 2), (2, None, 1), (2, 5, 3), (3, None, None), (4, 7, 1), (4, 7, 4), (4, 9, None), (4, None, 2), (None, 2, 1), (None, 60, 1)]
    spark.createDataFrame([(k, day(s), n) for k, s, n in dates], "l_orderkey long, l_shipdate timestamp, l_linenumber int").write.parquet(str(tmp_path / "lineitem.parquet"))
    for query in (relational.interval_union, relational.interval_gaps):
        assert rows(query(spark, str(tmp_path)).toPandas()) == sql_rows(tmp_path, relational.ORACLE[query.__name__], "lineitem")


def test_clauses_of_a_text_do_not_carry_it(spark, tmp_path):
    documents(tmp_path, ["a, b,c" * 30, "", ",", "x" * 70 + ", Z", "a, b,c" * 30], parts=2)
    df = pd.read_parquet(tmp_path / "documents.parquet")
    pd.concat([df, df.iloc[:1]]).to_parquet(tmp_path / "documents.parquet/part-0.parquet")  # ids that repeat stay apart
    got = corpus.sql_functions(spark, str(tmp_path))
    assert rows(got.toPandas()) == sql_rows(tmp_path, corpus.ORACLE["sql_functions"], "documents")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" in plan and "first(" not in plan
    assert "Sort" not in got._jdf.queryExecution().sparkPlan().toString()


def test_terms_are_mined_once_and_counted_in_place(spark, tmp_path):
    texts = ["Neural Nets and neural net, neural nets; NASA nets 2nd Straße STRASSE straße ΟΔΟΣ Οδος. " * k + "İki söz, " * 3 for k in (1, 2, 3, 7)]
    texts += ["", "a, b. 12 34", "the red red fox. " * 9, "glass glasses ties parties party. " * 6 + "x y " * 9, "alpha 7 beta-gamma\nalpha beta gammas (alpha beta) gamma. " * 4]
    documents(tmp_path, texts, parts=2)
    df = pd.read_parquet(tmp_path / "documents.parquet")
    pd.concat([df, df.iloc[:4], df.iloc[:1].assign(text=None, doc_id=99)]).to_parquet(tmp_path / "documents.parquet/part-0.parquet")  # ids repeat
    for query in (terms.top_terms, terms.terms_pruned):
        assert rows(query(spark, str(tmp_path)).toPandas()) == sql_rows(tmp_path, terms.ORACLE[query.__name__], "documents")
    plan = terms.terms_pruned(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan


def test_batches_of_rows_and_chunks_of_text_do_not_part_a_document(monkeypatch):
    rows_ = [(k // 3, "red fox runs. Red foxes run " * (k % 4)) for k in range(60)]
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.string()), ("surface", pa.string()), ("words", pa.int32()), ("cnt", pa.int64()), ("capital", pa.bool_())])

    def mined(size, chunk):
        monkeypatch.setattr(mining, "_CHUNK", chunk)
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows_[i : i + size], strict=True)], names=["doc_id", "text"]) for i in range(0, 60, size)]
        return sorted(r for b in mining.runs_of_batches(iter(batches), schema, frozenset(), (3, 2, 6)) for r in zip(*b.to_pydict().values(), strict=True))

    assert mined(60, 1 << 20) == mined(7, 1) == mined(1, 100)
    assert len({r[0] for r in mined(7, 1)}) == 20


def test_a_run_moves_texts_of_missing_lines_only_and_results_never(spark, tmp_path):
    texts = ["\n".join(f"line {k * n % 23} of words `x` http://a.b/c ![i](j)" * (n % 4 + 1) for n in range(9)) for k in range(12)] + ["", " 12 \n12", "`code`\n![a](b)\nhttp://x"]
    documents(tmp_path, texts, parts=2)
    assert rows(corpus.resumed(spark, str(tmp_path)).toPandas()) == sql_rows(tmp_path, corpus.ORACLE["resumed"], "documents")
    d = spark.read.parquet(str(tmp_path / "documents.parquet")).select("doc_id", "text")
    _, first, _ = dataflow.run(d.where("doc_id < 6"), dataflow.empty_store(spark), "p")
    _, second, _ = dataflow.run(d, first, "p")
    plan = second.entries._jdf.queryExecution().executedPlan().toString()
    assert "Scan parquet" in plan and "hashpartitioning" not in plan and "rangepartitioning" not in plan  # values stay in their tables
    got = second.entries.toPandas()
    assert got.ok.all() and got.seq.is_unique and got.k.is_unique
    assert got[~got.k.isin(first.entries.toPandas().k)].seq.min() > first.entries.toPandas().seq.max()


def test_verified_results_that_echo_are_redone(spark):
    long = "many words that are long enough here to make this line count as an English text that came back " + "again " * 5
    lines = [long.strip() + f" {i}" for i in range(4)] + ["short line"]
    stored = [lines[0], lines[1][:40] + " und weiter", "  " + lines[2] + " ", "Z " + lines[3], "short line"]
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    made = spark.createDataFrame([(t, v, True, i) for i, (t, v) in enumerate(zip(lines, stored, strict=True))], "t string, v string, ok boolean, seq long")
    st = Store(made.select(X.cache_key(F.lit("p"), F.col("t")).alias("k"), "v", "ok", "seq"), spark.createDataFrame([], "doc string, k string"))
    new = lambda need: need.withColumn("v", F.concat(F.lit("new "), "text"))
    out, after, _ = dataflow.run(docs, st, "p", new)
    assert [r.result.startswith("new ") for r in out.orderBy("seg_no").collect()] == [True, True, True, False, False]
    assert after.entries.count() == 5
