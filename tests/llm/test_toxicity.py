import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from warpsift.llm import toxicity as tox

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def model(spark):
    return tox.learn(spark.read.parquet(f"{SF}/documents.parquet"),
                     spark.read.parquet(f"{SF}/labels.parquet"))


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [(r.score, truth[r.doc_id]) for r in tox.score(docs, model).collect()
            if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    s, y = np.array(rows).T
    rank = np.argsort(np.argsort(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (y == 0).sum()
    assert auc > 0.93 and ((s >= 0.5) == y).mean() > 0.92


def test_misspellings_share_vectors(model):
    for word in ("idiott", "stuppid", "clowns", "pathetik"):
        assert model.word(word) > 20 > abs(model.word("and"))


def test_labels_are_learned_from_the_training_fold_only(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn("toxic", F.when(tox.held_out(F.col("doc_id")), 1 - F.col("toxic"))
                               .otherwise(F.col("toxic")))
    a, b = tox.learn(docs, labels), tox.learn(docs, turned)
    assert a.prior == b.prior and (a.weights == b.weights).all()


def test_score_is_the_models_forward_pass(model):
    """One number per word is the whole model, as it is linear."""
    text = "You IDIOT, the and of!"
    words = ["you", "idiot", "the", "and", "of"]
    rows = [model.weights[tox.subwords(w)].mean() for w in words]
    logit = model.prior + sum(rows) / (len(words) + tox.PAD)
    assert tox.score_texts([text], model)[0] == pytest.approx(1 / (1 + np.exp(-logit)))


def test_gradient_step_lowers_the_loss():
    texts = ["bad bad word", "good good word", "bad thing", "good thing"] * 10
    m = tox.train(texts, np.array([1, 0, 1, 0] * 10))
    assert (tox.score_texts(["bad", "good", "baddd", "goood"], m) > 0.5).tolist() == [
        True, False, True, False]


def test_odd_rows(spark, odd_docs, no_docs, tables):
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (6, 0, 0), (7, None, None),
                                    (None, 1, 1), (99, 0, 1)],
                                   "doc_id bigint, quality int, toxic int")
    rows = tox.op9_subwords(spark, tables(odd_docs, labels)).collect()
    assert len(rows) == odd_docs.count()
    assert all(0 <= r.score <= 1 and r.held_out is not None
               and r.predicted == (r.score >= 0.5) for r in rows)
    empty = {r.score for r in rows if r.doc_id in (2, 3, 4)}
    assert len(empty) == 1
    none = tox.op9_subwords(spark, tables(odd_docs)).collect()
    assert {r.predicted for r in none} == {0} and len({r.score for r in none}) == 1
    assert tox.op9_subwords(spark, tables(no_docs, labels)).count() == 0


def test_clean_rows_stay_whole(spark, odd_docs, model):
    docs = odd_docs.withColumn("score", F.lit("mine")).union(spark.createDataFrame(
        [(50, "stupid idiot moron trash", "en", "a", 3, "x")], odd_docs.schema.add(
            "score", "string")))
    kept = tox.keep_clean(docs, model)
    assert kept.columns == docs.columns and 50 not in {r.doc_id for r in kept.collect()}
    assert kept.count() >= 10


def test_the_driver_gets_the_model_alone(spark, monkeypatch):
    """Training runs in a task: on the driver it took the memory that a session there has left."""
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame(
        [(i, ("bad bad word", "good good word")[i % 2]) for i in range(20)] * 2
        + [(i, "zz") for i in range(20)], "doc_id bigint, text string")
    ids = [r.doc_id for r in labels.where(~tox.held_out(F.col("doc_id"))).orderBy("doc_id").collect()]
    want = tox.train([("bad bad word", "good good word")[i % 2] for i in ids],
                     np.array([i % 2 for i in ids]))
    monkeypatch.setattr(tox, "train", lambda *rows: pytest.fail("trained on the driver"))
    monkeypatch.setattr(DataFrame, "toPandas", lambda df: pytest.fail("texts on the driver"))
    got = tox.learn(docs, labels)
    assert got.prior == want.prior and (got.weights == want.weights).all()
