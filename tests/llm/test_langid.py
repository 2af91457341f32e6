"""Language ID: held-out accuracy, rejection, odd input."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from proofcast.llm import langid
from proofcast.llm.common import held_out
from proofcast.llm.sample import labelled_sample

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(documents):
    return langid.fit_languages(documents.where(~held_out(F.col("doc_id"))), most=150)


def test_held_out_is_the_remainder_two(spark):
    ids = [*range(200), None]
    got = spark.createDataFrame([(i,) for i in ids], "i bigint").select("i", held_out(F.col("i")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(b"" if r["i"] is None else str(r["i"]).encode()) % 4 == 2) for r in got)


def test_held_out_accuracy(documents, model):
    rows = documents.where(held_out(F.col("doc_id")) & F.col("lang").isNotNull()).select("lang", langid.predict(F.col("text"), model).alias("p")).collect()
    assert len(rows) > 100
    assert np.mean([r["lang"] == r["p"]["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["p"]["score"] <= 1 for r in rows)
    assert np.mean([r["p"]["accepted"] for r in rows]) > 0.9


def test_foreign_letters_are_less_sure(model):
    assert max(model.probabilities("κόσμε 日本語 テキスト")) < max(model.probabilities("the " * 50))


def test_odd_texts(docs_of, model):
    odd = [(1, None), (2, ""), (3, " 12 %% \n"), (4, "é"), (5, "word " * 300000), (6, "x" * 200)]
    got = {r["doc_id"]: r["p"] for r in docs_of(odd).select("doc_id", langid.predict(F.col("text"), model).alias("p")).collect()}
    assert all(tuple(got[i]) == ("und", 0.0, False) for i in (1, 2, 3))
    assert all(got[i]["lang_pred"] in model.names for i in (4, 5, 6))


def test_pieces_do_not_change_a_text(monkeypatch, model):
    text = "Die erste Zeile, die zweite.\n" * 50
    whole = model.logits(text)
    monkeypatch.setattr(langid, "PIECE", 64)
    assert np.allclose(model.logits(text), whole)


def test_texts_that_end_near_a_piece(monkeypatch):
    texts = ["a" * n for n in range((1 << 20) - 4, (1 << 20) + 4)]
    cut = [np.sort(np.concatenate([*langid.subwords(t)])) for t in texts]
    monkeypatch.setattr(langid, "PIECE", 1 << 22)
    for text, got in zip(texts, cut, strict=True):
        assert np.array_equal(got, np.sort(np.concatenate([*langid.subwords(text)])))


def test_nothing_to_learn(docs_of):
    model = langid.fit_languages(docs_of([(1, "abc")]).withColumn("lang", F.lit(None).cast("string")))
    row = docs_of([(1, "abc")]).select(langid.predict(F.col("text"), model).alias("p")).first()
    assert tuple(row["p"]) == ("und", 0.0, False)


def test_sample_is_bounded_and_the_same_in_any_order(spark):
    rows = spark.createDataFrame([(f"text {i % 500}", i % 2) for i in range(3000)], "text string, label int").withColumn("key", F.xxhash64("text"))
    one = labelled_sample(rows.repartition(1), 40)
    assert one == labelled_sample(rows.repartition(7, "text"), 40)
    assert max(sum(y == k for _, y in one) for k in (0, 1)) <= 40 and len({t for t, _ in one}) == len(one)
