"""Literal fixtures for what SQL can't say, and for edge cases."""

import io
import zipfile

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillstream.functions import text as X
from quillstream.operators import layout, pairs, relational, rowwork, segments, store, telemetry
from quillstream.operators.store import Store
from quillstream.plans import dataflow
from quillstream.sources import documents, pages, records
from quillstream.streaming import queries as streams


def one(spark, values, *cols):
    """The values of columns over one row of strings a, b, c ..."""
    names = list("abcdef")[: len(values)]
    df = spark.createDataFrame([tuple(values)], ", ".join(f"{n} string" for n in names))
    return list(df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first())


A = B = C = None


@pytest.fixture(autouse=True)
def columns(spark):
    """Columns need a session."""
    global A, B, C
    A, B, C = F.col("a"), F.col("b"), F.col("c")


def batches(spark, lengths, **how):
    rows = [(1, i, chr(97 + i % 26) * n) for i, n in enumerate(lengths)]
    out = segments.pack(spark.createDataFrame(rows, "doc_id long, first_pos int, text string"), **how).orderBy("batch_no").collect()
    return [r.n_items for r in out]


def test_batches_close_and_reset(spark):
    assert batches(spark, [10] * 30) == [4, 20, 6]
    assert batches(spark, [10, 10, 10, 40, 5], max_chars=25) == [2, 1, 1, 1]
    assert batches(spark, [9000]) == [1]


def test_nearest_rank_is_an_element(spark):
    df = spark.range(11).select(F.col("id").cast("double").alias("d"))
    assert df.agg(telemetry.nearest_rank("d", 0.9)).first()[0] == 9.0


def test_medians(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,)], "r double")
    assert pairs.upper_median_of_all(df, "r").first()[0] == 3.0
    assert pairs.upper_median_of_all(df.limit(2), "r").first()[0] is None
    keyed = df.withColumn("k", F.col("r") > 1)
    assert {tuple(r) for r in pairs.upper_median(keyed, "r", ["k"]).collect()} == {(True, 3.0)}
    for n in (1001, 1000, 7):
        many = spark.range(n).select((F.col("id") * 37 % 101).cast("double").alias("r"))
        assert pairs.upper_median_of_all(many.repartition(3), "r").first()[0] == sorted(i * 37 % 101 for i in range(n))[n // 2]
    w = spark.createDataFrame([("x", 8, 10), ("x", 10, 50), ("x", 14, 5)], "k string, size int, n int")
    assert pairs.weighted_median("size", "n", ["k"], w).first()["median"] == 10


@pytest.fixture(scope="module")
def small(spark):
    e = spark.createDataFrame([(k, k.upper(), True, i) for i, k in enumerate("abcd")], "k string, v string, ok boolean, seq long")
    o = spark.createDataFrame([("d1", "a"), ("d1", "b"), ("d2", "b"), ("d2", "c")], "doc string, k string")
    return store.Store(e, o)


def keys(df):
    return sorted(r.k for r in df.collect())


def test_store_algebra(spark, small):
    used = spark.createDataFrame([("d2",)], "doc string")
    assert keys(small.owned("d1")) == ["a", "b"]
    assert keys(small.only().where("doc = 'd1'")) == ["a"]
    assert keys(small.unused(used)) == ["a"] and keys(small.untracked()) == ["d"]
    assert keys(small.purge_only("d1").entries) == ["b", "c", "d"]
    assert keys(small.purge("d1").entries) == ["c", "d"] and keys(small.purge("d1").owners) == ["c"]
    assert keys(small.purge_unused(used).entries) == ["b", "c", "d"]
    new = small.upsert(spark.createDataFrame([("a", "z"), ("e", "y")], "k string, v string"))
    got = {r.k: (r.v, r.ok) for r in new.entries.collect()}
    assert got["a"] == ("z", False) and got["e"] == ("y", False) and got["b"] == ("B", True)
    assert {r.k: r.ok for r in new.mark(spark.createDataFrame([("a",)], "k string")).entries.collect()}["a"]
    assert {r.k: r.v for r in small.overlay(spark.createDataFrame([("a", "q"), ("x", "q")], "k string, v string")).collect()} == {"a": "q", "b": "B", "c": "C", "d": "D"}


def test_eviction_spares_the_write_under_way(spark):
    e = spark.createDataFrame([(f"k{i:02d}", "v", True, i) for i in range(12)], "k string, v string, ok boolean, seq long")
    st = store.Store(e, spark.createDataFrame([("d", "k00")], "doc string, k string"))
    assert keys(st.victims(10, 10)) == ["k01", "k02", "k03"]
    assert keys(st.evict(10, 10).entries) == ["k00", *[f"k{i:02d}" for i in range(4, 12)]]
    assert st.victims(12, 10).count() == 0


def test_scalar_functions(spark):
    assert one(spark, ["two queries", "query"], X.mentions(A, B)) == [True]
    assert one(spark, ["plain sql", "SQL"], X.mentions(A, B)) == [False]
    assert one(spark, ["a review", "view"], X.mentions(A, B)) == [False]
    assert one(spark, ["en", "en"], X.same_language(A, B)) == [True]
    assert one(spark, ["pt", "pt-br"], X.same_language(A, B)) == [True]
    assert one(spark, ["zh-CN", "zh-TW"], X.same_language(A, B)) == [False]
    assert one(spark, ["zh-TW", "zh-HK"], X.same_language(A, B)) == [True]
    assert one(spark, [None, "en"], X.same_language(A, B)) == [False]
    counts = [one(spark, [v], X.tolerant_count(A))[0] for v in ("7", " 12 ", "3.9", "-1", "true", "x", "NaN", None)]
    assert counts == [7, 12, 3, None, None, None, None, None]
    numerals = spark.createDataFrame([(n,) for n in (0, 7, 10, 15, 20, 105, 110, 1010, 2024, 9999)], "n int")
    assert [r[0] for r in numerals.select(X.chinese_number(F.col("n"))).collect()] == ["零", "七", "十", "十五", "二十", "一百零五", "一百一十", "一千零一十", "二千零二十四", "九千九百九十九"]
    assert one(spark, ["queries", "classes of NASA", "NASA", "glass"], *[X.folded(F.col(c)) for c in "abcd"]) == ["query", "classes of nasa", "NASA", "glass"]
    assert one(spark, ["{a} and {b}", "{b}", "x"], X.filled(A, {"a": B, "b": C})) == ["{b} and x"]
    assert one(spark, ["<think>hm</think>```\nyes\n```"], X.clean_reply(A)) == ["yes"]
    assert one(spark, ["[[p0]]\nx\n[[p1]]\ny\n[[p0]]\nz\n[[p2]]\n"], X.reply_items(A)) == [{0: "x", 1: "y"}]
    assert one(spark, ["1500", "20", "Wed, 21 Oct 2015 07:28:00 GMT"], X.retry_after(A, F.lit(None).cast("string"), F.timestamp_seconds(F.lit(0))), X.retry_after(F.lit(None).cast("string"), B, F.timestamp_seconds(F.lit(0))), X.retry_after(F.lit(None).cast("string"), C, F.timestamp_seconds(F.lit(1445412470)))) == [1.5, 20.0, 10.0]
    assert one(spark, ["0", "", "20000", "5"], *[X.requests_per_minute(F.col(c)) for c in "abcd"]) == [None, None, 10000, 5]
    assert one(spark, ["99", "x"], X.clamped(A, 1, 32, 4), X.clamped(B, 1, 32, 4)) == [32, 4]
    assert one(spark, ["{v0} a {v1}", "{v1} b {v0}", "{v0} {v0}"], X.keeps_slots_once(A, B), X.keeps_slots_once(A, C)) == [True, False]
    assert one(spark, ["x {v0} y {v1}", "x {v0}"], X.restored(A, F.array(F.lit("F"), F.lit("G"))), X.restored(B, F.array(F.lit("F"), F.lit("G")))) == ["x F y G", None]
    assert one(spark, ["2.1. Title", "Title"], X.leading_number(A), X.leading_number(B)) == ["2.1", ""]
    assert one(spark, ["aaaa, bbbbbb", "aaaaaaaaaa"], X.split_near(A, F.lit(0.5)), X.split_near(B, F.lit(0.4))) == [5, 4]
    assert one(spark, ["こんにちはこんにちは、世界のみなさん", "这是一个测试句子用于检查", "Just some English text here"], *[X.script_language(F.col(c)) for c in "abc"]) == ["ja", "zh", None]
    assert one(spark, ["Text 123", "Привет 456"], X.stray_scripts(A, B, F.array().cast("array<string>")), X.numbers_differ(A, B)) == [["Cyrillic"], True]


def test_replies_and_titles(spark):
    reply = 'Sure: {"headword": " ", "phonetic": "x", "senses": [{"pos": "n", "meaning": "a thing"}, {"pos": "v", "meaning": " "}]} done'
    got = one(spark, [reply, "word", "no object"], X.dictionary_entry(A, B), X.dictionary_entry(C, B))
    assert got[0].headword == "word" and [s.meaning for s in got[0].senses] == ["a thing"] and got[1] is None
    assert one(spark, ["7 References", "Literatur:", "References to others"], *[X.is_reference_title(F.col(c)) for c in "abc"]) == [True, True, False]
    assert [r[0] for r in spark.createDataFrame([(404,), (429,)], "s int").select(X.retryable(F.col("s"))).collect()] == [False, True]


def test_asof_and_range_joins(spark):
    left = spark.createDataFrame([("k", 5, 1), ("k", 0, 2), ("m", 9, 3)], "k string, t int, i int")
    right = spark.createDataFrame([("k", 1, 10), ("k", 5, 20), ("k", 6, 30)], "k string, u int, v int")
    got = {r.i: r.v for r in relational.asof_join(left, right, "k", "t", "u", ["v"]).collect()}
    assert got == {1: 20, 2: None, 3: None}
    pairs_ = relational.range_join(left.withColumn("t", F.col("t").cast("double")), right.withColumn("u", F.col("u").cast("double")), ["k"], "t", "u", 1.0)
    assert sorted((r.i, r.v) for r in pairs_.collect()) == [(1, 20), (1, 30), (2, 10)]


def test_intervals(spark):
    df = spark.createDataFrame([("a", 0, 10), ("a", 5, 12), ("a", 12, 15), ("a", 20, 30)], "k string, s int, e int")
    assert sorted((r.s, r.e, r.n) for r in relational.merge_intervals(df, ["k"], "s", "e").collect()) == [(0, 15, 3), (20, 30, 1)]


def test_suppression_and_overlap(spark):
    df = spark.createDataFrame([(1, 0, 0.0, 0.0, 10.0, 10.0, 0.9), (1, 1, 1.0, 1.0, 11.0, 11.0, 0.8)], "g int, ord int, x0 double, y0 double, x1 double, y1 double, score double")
    assert [r.ord for r in layout.suppressed(df, ["g"]).collect()] == [0]
    both = df.where("ord = 0").select(*[F.col(c).alias(f"a_{c}") for c in ("x0", "y0", "x1", "y1")]).crossJoin(df.where("ord = 1").select(*[F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1")]))
    assert abs(both.select(layout.iou("a_", "b_")).first()[0] - 81 / 119) < 1e-12


def test_rows_are_anchored_on_their_first_word(spark):
    df = spark.createDataFrame([("p", y) for y in (0.0, 3.0, 5.0, 8.0)], "k string, y0 double")
    assert sorted((r.y0, r.row_no) for r in layout.row_clusters(df, ["k"]).collect()) == [(0.0, 0), (3.0, 0), (5.0, 1), (8.0, 1)]


def test_pieces_merge_to_a_fixpoint(spark):
    df = spark.createDataFrame([("p", 0.0, 0.0, 10.0, 5.0, "a"), ("p", 15.0, 1.0, 20.0, 5.0, "b"), ("p", 30.0, 2.0, 40.0, 6.0, "c"), ("p", 0.0, 20.0, 5.0, 25.0, "d")], "k string, x0 double, y0 double, x1 double, y1 double, text string")
    got = sorted((r.text, r.pieces) for r in rowwork.merged_pieces(df, ["k"]).collect())
    assert got == [("a b c", 3), ("d", 1)]


def test_nearest_smaller_value(spark):
    df = spark.createDataFrame([("d", i, v) for i, v in enumerate((1, 2, 3, 2, 1))], "k string, ord int, level int")
    got = [r.parent for r in pages.nearest_smaller(df, ["k"], "ord", "level").orderBy("ord").collect()]
    assert got == [None, 0, 1, 0, None]


def test_sections_are_left_at_their_level(spark):
    rows = [(1, 0, 2, True), (1, 1, None, False), (1, 2, 3, False), (1, 3, 2, False), (1, 4, None, False)]
    df = spark.createDataFrame(rows, "d int, n int, level int, opens boolean")
    got = segments.section_carry(df, "d", "n", F.col("level"), F.col("opens")).orderBy("n").collect()
    assert [r.skip for r in got] == [True, True, True, False, False]


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.node: r.component for r in layout.connected(e).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_markdown():
    text = "---\nt: 1\n---\n# Head\n\nPara one\nmore\n\n- item\n> quote\n\n| a | b\\|c |\n|---|---|\n| d | e |\n\n```\ncode\n```\n$$\nx\n$$\n<div>\nhi\n</div>\n\nUnder\n---\n[l]: http://x\n***\n"
    got = [(k, t) for k, _, _, t in documents.markdown_blocks(text)]
    assert [k for k, _ in got] == ["front", "h1", "p", "li", "quote", "td", "td", "td", "td", "code", "math", "html", "h2", "link", "rule"]
    assert ("p", "Para one\nmore") in got and ("td", "b\\|c") in got and ("h2", "Under") in got


def test_page_blocks(spark):
    html = "<html><head><title>no</title></head><body><nav><a href='/x'>Home</a></nav><h1>A &amp; B</h1><p>One <b>two<br>three<p>Four</p>bare<script>var x</script><ul><li>Item <img src=x></ul>1234</body>"
    assert pages.Blocks().blocks(html) == [("text", "toc", "Home"), ("h1", "h1", "A & B"), ("p", "p", "One two\nthree"), ("p", "p", "Four"), ("text", "p", "bare"), ("li", "li", "Item {v0}")]
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    assert pages.page_blocks(df).groupBy("page_id").count().collect() == [Row(page_id=1, count=6)]


def test_cues(spark):
    srt = "1\n00:00:01,000 --> 00:00:02,000\nHello <i>you</i>\nthere\n2\n00:00:03,000 --> 00:00:04,000\n- Yes\n- No\n\nstray\n"
    df = spark.createDataFrame([("f", srt)], "path string, text string")
    got = documents.cues(df).orderBy("cue").collect()
    assert [r.text for r in got] == ["Hello you there", "- Yes\n- No"]
    back = documents.written_cues(documents.cues(df)).first().text
    assert back.startswith("1\n00:00:01,000 --> 00:00:02,000\nHello you there\n\n2\n")
    ass = "[Script Info]\nTitle: x\n[Events]\nFormat: Layer, Start, End, Text\nDialogue: 0,0:00,0:01,Hi, {\\b1}all\\Nnow\nDialogue: 0,0:00,0:01,{\\p1}m 0 0\nComment: 0,0,0,no\n"
    assert [r.text for r in documents.dialogue(spark.createDataFrame([("g", ass)], "path string, text string")).collect()] == ["Hi, all now"]


def test_encodings():
    assert documents.decoded("﻿abc".encode()) == "abc"
    assert documents.decoded("这是一个测试。".encode("gb18030")) == "这是一个测试。"
    assert documents.decoded(b"caf\xe9") == "café"
    assert documents.fitted_name("é" * 200 + ".epub").endswith(".epub") and len(documents.fitted_name("é" * 200 + ".epub").encode()) <= 180
    assert documents.fitted_name("short.md") == "short.md"


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in members.items():
            z.writestr(name, body)
    return out.getvalue()


def test_files_and_archives(spark, tmp_path):
    opf = '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="a" href="a.xhtml"/><item id="b" href="b.xhtml"/></manifest><spine><itemref idref="b"/><itemref idref="a"/></spine></package>'
    box = '<container><rootfiles><rootfile full-path="OPS/c.opf"/></rootfiles></container>'
    (tmp_path / "x.EPUB").write_bytes(archive({"META-INF/container.xml": box, "OPS/c.opf": opf, "OPS/a.xhtml": "<p>A</p>", "OPS/b.xhtml": "<p>B</p>"}))
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    (tmp_path / "y.docx").write_bytes(archive({"word/document.xml": f"<w:document {w}><w:p><w:r><w:t>One</w:t><w:tab/><w:t>two</w:t></w:r></w:p><w:p/></w:document>"}))
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    (tmp_path / "z.md").write_text("# T\n\ntext")
    f = documents.files(spark, str(tmp_path))
    assert {r["format"] for r in f.collect()} == {"epub", "docx", "markdown"}
    assert [(r.place, r.member) for r in documents.epub_table(documents.of_format(f, "epub")).orderBy("place").collect()] == [(0, "OPS/b.xhtml"), (1, "OPS/a.xhtml")]
    assert [r.text for r in documents.docx_table(documents.of_format(f, "docx")).collect()] == ["One\ttwo"]
    md = documents.markdown_table(documents.with_text(documents.of_format(f, "markdown")))
    assert [r.text for r in documents.markdown_segments(md).orderBy("ord").collect()] == ["T", "text"]


def test_records(spark, tmp_path):
    (tmp_path / "log.json").write_text('{"started": 1.0, "duration": 2.5, "reason": "x", "unknown": 1}\nnot json\n{"started": 2.0, "items": 3}\n')
    assert sorted(r.started for r in records.request_log(spark, str(tmp_path / "log.json")).collect()) == [1.0, 2.0]
    for i, status in enumerate(("running", "done")):
        (tmp_path / f"jobs/{i}").mkdir(parents=True)
        (tmp_path / f"jobs/{i}/job.json").write_text(f'{{"id": "{i}",\n"status": "{status}"}}')
    assert sorted((r.id, r.status) for r in records.job_records(spark, str(tmp_path / "jobs")).collect()) == [("0", "interrupted"), ("1", "done")]
    texts = spark.createDataFrame([("csv", '﻿source,target\n"a, b",c\nd,\n'), ("tsv", "x\ty\nz = q\tw"), ("pairs", "m = n\no=p")], "path string, text string")
    got = {(r.path, r.source, r.target) for r in records.glossary_table(texts).collect()}
    assert got == {("csv", "a, b", "c"), ("tsv", "x", "y"), ("tsv", "z = q", "w"), ("pairs", "m", "n"), ("pairs", "o", "p")}
    assert {(r.source, r.target) for r in records.glossary_lines(texts.where("path = 'pairs'")).collect()} == {("m", "n"), ("o", "p")}
    df = spark.createDataFrame([(1,)], "a int")
    records.swap_in(df, str(tmp_path / "t"))
    records.swap_in(df.union(df), str(tmp_path / "t"))
    assert records.swapped(spark, str(tmp_path / "t")).count() == 2


def test_dataflow_is_by_place_and_by_text(spark):
    docs = spark.createDataFrame([(1, "alpha beta\n12\nalpha beta"), (2, "alpha beta\ngamma"), (3, None), (4, "")], "doc_id long, text string")
    calls = []

    def double(texts):
        if len(texts) > 1:
            raise ValueError("one at a time")
        return [None if t == "gamma" else t + t for t in texts]

    dataflow.register("double", double)
    out, st, figures = dataflow.run(docs, dataflow.empty_store(spark), "p", "double")
    got = {(r.doc_id, r.seg_no): r.result for r in out.collect()}
    assert got == {(1, 0): "alpha betaalpha beta", (1, 1): "12", (1, 2): "alpha betaalpha beta", (2, 0): "alpha betaalpha beta", (2, 1): "gamma"}
    assert tuple(figures.first()) == (5, 1, 1) and calls == []
    again, _, _ = dataflow.run(docs.where("doc_id = 1"), st, "p", "double", cache_only=True)
    assert again.count() == 3
    with pytest.raises(LookupError):
        dataflow.run(docs, st, "p", "double", cache_only=True)
    assert st.verified(st.entries).count() == st.entries.count() == 1
    assert {r.doc_id: r.text for r in dataflow.assembled(out, bilingual=True).collect()}[2] == "alpha beta\nalpha betaalpha beta\ngamma"


def long_lines(n, word):
    return [f"{word} line number {i}" + " with enough words to have a ratio of lengths at all here" * 2 for i in range(n)]


def test_rejected_results_are_not_stored(spark):
    """A result out of place in its document is dropped, is not served by the next run, and other documents keep theirs."""
    lines, short = long_lines(6, "one"), long_lines(4, "two")
    docs = spark.createDataFrame([(1, "\n".join(lines)), (2, "\n".join(short))], "doc_id long, text string")
    dataflow.register("odd", lambda texts: [t * 9 if t == lines[2] else t * 3 if t.startswith("two") else t + "!" for t in texts])
    out, st, _ = dataflow.run(docs, dataflow.empty_store(spark), "p", "odd")
    got = {(r.doc_id, r.seg_no): r.result for r in out.collect()}
    assert got[1, 2] == lines[2] and got[1, 1].endswith("!") and got[2, 0] == short[0] * 3
    assert st.entries.count() == 9
    dataflow.register("well", lambda texts: [t + "?" for t in texts])
    again, _, _ = dataflow.run(docs, st, "p", "well")
    assert {(r.doc_id, r.seg_no): r.result for r in again.collect()}[1, 2].endswith("?")


def test_shifted_hits_and_their_neighbours_are_redone(spark):
    lines = long_lines(40, "one")
    docs = spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string")
    k = X.cache_key(F.lit("p"), F.col("t"))
    rows = spark.createDataFrame([(t, "z" + (t * 9 if i == 20 else t), i % 2 == 1, i) for i, t in enumerate(lines)], "t string, v string, ok boolean, seq long")
    st = Store(rows.select(k.alias("k"), "v", "ok", "seq"), spark.createDataFrame([], "doc string, k string"))
    dataflow.register("anew", lambda texts: [t + "?" for t in texts])
    out, after, _ = dataflow.run(docs, st, "p", "anew", batch_chars=600)
    redone = {r.seg_no for r in out.collect() if r.result.endswith("?")}
    near = {i for i in range(40) if i % 2 == 0 and abs(sum(len(t) for t in lines[: i + 1]) - sum(len(t) for t in lines[:21])) <= 600}
    assert redone == near and 20 in redone
    assert after.verified(after.entries).count() == 20 + len(near)
    kept, _, _ = dataflow.run(docs, st, "p", "anew", batch_chars=600, cache_only=True)
    assert not any(r.result.endswith("?") for r in kept.collect())


def test_texts_of_the_target_language_stay(spark):
    docs = spark.createDataFrame([(1, "größere Häuser\nplain words here\nschöne Straßen"), (2, "plain again")], "doc_id long, text string")
    dataflow.register("mark", lambda texts: ["T " + t for t in texts])
    run = lambda **kw: {(r.doc_id, r.seg_no): (r.result, r.skip) for r in dataflow.run(docs, dataflow.empty_store(spark), "p", "mark", **kw)[0].collect()}
    assert run(language="letters", target="de-AT")[1, 0] == ("größere Häuser", True) and run(language="letters", target="de")[1, 1] == ("T plain words here", False)
    assert run()[1, 0][1] is False
    langs = dataflow.document_language(dataflow.segments(docs), "letters").collect()
    assert {r.doc_id: r.language for r in langs} == {1: "de"}


def test_echoes_are_retried_once(spark):
    texts = ["größere Häuser stehen an der schönen Straße", "noch mehr schöne Wörter für den Übersetzer", "kurz über"]
    docs = spark.createDataFrame([(1, "\n".join(texts))], "doc_id long, text string")
    better = lambda need: need.withColumn("v", F.when((F.col("attempt") == 2) & F.col("text").startswith("gr"), F.lit("much better now")).otherwise(F.col("text")))
    out, _, _ = dataflow.run(docs, dataflow.empty_store(spark), "p", better, language="letters", source="de", target="en")
    assert [r.result for r in out.orderBy("seg_no").collect()] == ["much better now", *texts[1:]]


def test_admission_waits():
    import pandas as pd

    class State:
        exists, get, value = False, None, None

        def update(self, v):
            self.value = v

    s = State()
    rows = pd.DataFrame({"at": [0.0, 10.0, 59.0, 60.0], "event_id": [1, 2, 3, 4]})
    out = next(streams.admit(("svc",), iter([rows]), s, 2, 60))
    assert list(out["wait"]) == [0.0, 0.0, 1.0, 10.0] and s.value == ([60.0, 70.0],)


def test_lines_of_markup():
    assert [documents.heading(t) for t in ("# a", "### b c ##", "####### x", "#x", "    # a", "#")] == [(1, "a"), (3, "b c"), (0, ""), (0, ""), (0, ""), (0, "")]
    assert [documents.is_rule(t) for t in ("---", "* * *", "__", "-*-", "", "    ---")] == [True, True, False, False, False, False]
    assert [documents.is_table_rule(t) for t in ("|---|:-:|", "--- | ---", "---", "| a | - |", "|::|", "| - | |")] == [True, True, False, False, False, False]
    assert [documents.item(t) for t in ("- a", "  12) b", "1.x", "* ", "-", "1234567890. a")] == [2, 6, 0, 2, 0, 0]
    assert [documents.quoted(t) for t in ("> a", ">b", "a > b", "     > a")] == [2, 1, 0, 0]
    assert [documents.underline(t) for t in ("===", "--", "=-", "", "    ---")] == [1, 2, 0, 0, 0]
    assert [documents.fence(t) for t in ("```py", "~~~~", "``", "")] == ["```", "~~~~", "", ""]


def test_timing_lines(spark):
    lines = ["00:00:01,000 --> 00:00:02,500", "00:01.5 --> 01:02.25 align:start", "1:2:3 --> 4:5:6", "a --> b", "00:01,000", "00:01,000 -->", "--> 00:01,000", "x00:01,0 --> 00:01,0"]
    df = spark.createDataFrame([(t,) for t in lines], "t string")
    assert [r.k for r in df.select(documents.is_timing(F.col("t")).alias("k")).collect()] == [True, True, False, False, False, False, False, False]
