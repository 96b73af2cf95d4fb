"""The stages of the corpus pipeline over a small folder of tables, each against a plain version of what it does."""

import re

import numpy as np
import pandas as pd
import pytest

import __spark_entry__
import corpus_pipeline as P
from quillstream.llm import mixing, pii, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """Prose of 60 documents with near copies and personal data, and 20 documents of capitals as junk."""
    rng = np.random.default_rng(8)
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    texts = [" ".join(rng.choice(words, 60)) for _ in range(60)]
    texts[10] = texts[3]
    texts[11] = texts[3].replace(texts[3].split()[30], "edited")
    texts[12] += " mail anna@mail.example.com now"
    texts += [" ".join(w.upper() + "!!" for w in rng.choice(words, 30)) for _ in range(20)]
    d = tmp_path_factory.mktemp("sf")
    pd.DataFrame({"doc_id": range(80), "text": texts, "lang": "en", "source": [f"s{i % 3}" if i % 9 else None for i in range(80)], "n_chars": [len(t) for t in texts]}).to_parquet(d / "documents.parquet")
    pd.DataFrame({"doc_id": range(80), "quality": [int(i < 60) for i in range(80)], "toxic": 0}).astype({"quality": "int32", "toxic": "int32"}).to_parquet(d / "labels.parquet")
    return str(d)


def shingles(t):
    w = WORD.findall(t.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_stages_one_by_one(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    good = P.quality_stage(spark, docs, folder)
    assert good.columns == P.COLUMNS and {r.doc_id for r in good.collect()} == set(range(60))
    once = P.near_duplicate_stage(spark, good, folder)
    left = {r.doc_id for r in once.collect()}
    for i in range(60):
        copies = [j for j in range(i) if 10 * len(shingles(texts[i]) & shingles(texts[j])) >= 8 * len(shingles(texts[i]) | shingles(texts[j]))]
        assert (i in left) == (not copies)
    clean = P.pii_stage(spark, once, folder)
    found = {r.doc_id: r for r in clean.collect()}
    assert found[12].text.endswith("mail <EMAIL> now") and found[12].n_chars == len(found[12].text)
    assert all(found[i].text == texts[i] for i in left if not pii.base_spans(texts[i]))
    mixed = P.mixing_stage(spark, clean, folder)
    assert mixed.columns == P.COLUMNS
    plan = {r.doc_id: r for r in mixing.mix_sources(clean).collect()}
    sums = {}
    for r in mixed.collect():
        assert found[r.doc_id].text.split()[: len(r.text.split())] == r.text.split()
        sums[r.doc_id] = sums.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert sums == {i: r.taken for i, r in plan.items() if r.taken}
    coded = P.pieces_stage(spark, mixed, folder).collect()
    assert all(r.round_trip for r in coded) and len(coded) == mixed.count()


def test_run_equals_the_stages_and_is_registered(spark, folder):
    rows = P.run(spark, folder)
    assert rows.count() > 60 and "ids" in rows.columns
    assert __spark_entry__.queries()["pipeline"] is P.run and P.ORACLE_SQL is None
    assert len(P.STAGES) == 5


def test_stages_take_odd_rows_and_empty_tables(spark, folder):
    rows = [(1, None, None, None, None, "x"), (2, "", "en", "s", 0, "x"), (None, "some words of text here", "en", "s", 5, "x"), (3, "some words of text here", "en", None, 5, "x"), (3, "some words of text here", "en", None, 5, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, taken string")
    out = docs
    assert {r.doc_id for r in P.near_duplicate_stage(spark, docs, folder).collect()} == {None, 1, 2, 3}
    assert P.near_duplicate_stage(spark, docs, folder).count() == 4
    for _, stage in P.STAGES[2:]:
        out = stage(spark, out, folder)
    assert all(r.round_trip for r in out.collect())
    for _, stage in P.STAGES:
        assert stage(spark, docs.where("false"), folder).count() == 0


def test_model_path_is_a_parameter():
    assert pieces.PieceModel.load(pieces.MODEL_FILE).kind == "bpe"
