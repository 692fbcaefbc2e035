import numpy as np
import pytest
from pyspark.sql import functions as F

from mnemotide.llm import knn_quality
from mnemotide.llm.queries import op3_knn_quality

SF = "/root/testdata/sf0.01"


def test_scores_equal_brute_force():
    rng = np.random.default_rng(1)
    terms = np.stack([knn_quality.term_vector(("abc " if i % 3 else "XY!! ") * (1 + i % 5) + str(i)) for i in range(60)])
    labels = np.array([float(bool(i % 3)) for i in range(60)])
    model = knn_quality.fit(terms, labels, dims=8, neighbours=5, power=3.0)
    z = model.latent(terms[rng.permutation(60)[:20]])
    for row, score in zip(z, model.scores(z)):
        sims = model.vectors @ row
        near = np.argsort(-sims, kind="stable")[:5]
        w = np.maximum(sims[near], 0).astype(np.float64) ** 3
        cut = np.sort(sims)[-5]
        if (np.abs(sims - cut) < 1e-6).sum() == 1:
            assert score == pytest.approx((w * labels[near]).sum() / w.sum(), abs=1e-6)


def test_held_out_accuracy(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = op3_knn_quality(spark, SF).join(labels, "doc_id").where("held_out").toPandas()
    assert len(got) > 60 and (got.predicted == got.quality).mean() > 0.95
    assert op3_knn_quality(spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_odd_rows(spark):
    rows = [(1, "good words here", "a", 1, 0.1), (1, "good words here", "a", 1, 0.1), (2, None, None, None, None), (3, "", "", 0, 0.0), (None, "bad bad bad bad", "b", 2, 0.2), (4, "é" * 150_000, "c", 3, 0.3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, score int, predicted double")
    labelled = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (None, 1), (9, None)], "doc_id long, quality int")
    model = knn_quality.fit_on(docs, labelled)
    assert sorted(model.labels) == [0.0, 0.5]
    got = knn_quality.quality_scores(docs, model, keep=("score",)).toPandas()
    assert len(got) == len(rows) and not got.isna().any(axis=None) or got.doc_id.isna().sum() == 1
    none = knn_quality.fit_on(docs, labelled.where(F.lit(False)))
    assert {r.score for r in knn_quality.quality_scores(docs, none).collect()} == {0.5}
    assert knn_quality.quality_scores(docs.where(F.lit(False)), model).collect() == []
