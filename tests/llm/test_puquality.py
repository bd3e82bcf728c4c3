import numpy as np
import pyarrow as pa
import pytest

from tablewright.llm import puquality
from tablewright.llm.queries import QUERIES
from tablewright.llm.toxicity import held_out

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    rows = [r for r in QUERIES["op7_pu_quality"](spark, SF).collect() if r.held_out and r.doc_id in labels]
    right = [r.predicted == labels[r.doc_id] for r in rows]
    assert len(right) > 80 and np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")
    learn = ~held_out(3, 1)
    turned = labels.selectExpr("doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 3 = 1 then 1 - quality else quality end quality")
    scores = [sorted((r.doc_id, r.score) for r in puquality.score_quality(docs, puquality.fit_quality(docs, some, learn)).collect()) for some in (labels, turned)]
    assert np.allclose(scores[0], scores[1])


@pytest.mark.parametrize("prior", [0.3, 0.8])
def test_prior_and_risk(prior):
    rng = np.random.default_rng(4)
    positive = rng.normal(1.5, 1, (2000, 3))
    n = int(3000 * prior)
    unlabelled = np.concatenate([rng.normal(1.5, 1, (n, 3)), rng.normal(-1.5, 1, (3000 - n, 3))])
    estimated = puquality.estimate_prior(positive, unlabelled)
    assert abs(estimated - prior) < 0.1
    net = puquality.fit_non_negative(positive, unlabelled, estimated)
    truth = np.arange(3000) < n
    assert ((net(unlabelled) >= 0) == truth).mean() > 0.95


def test_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, 1) for i in range(25)] + [(None, 1), (3, None)], "doc_id long, quality int")
    model = puquality.fit_quality(odd_docs, labels, held_out(3, 1) | ~held_out(3, 1))
    scored = puquality.score_quality(odd_docs, model)
    rows = scored.collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert scored.columns == [*odd_docs.columns, "score", "predicted"]
    assert puquality.score_quality(no_docs, model).count() == 0
    assert puquality.fit_quality(no_docs, labels, ~held_out(3, 1)) is None
    assert {r.score for r in puquality.score_quality(odd_docs, None).collect()} == {0.5}


def test_features_do_not_depend_on_neighbours():
    texts = ["One two THREE!", "", None, "a b c d e f g h a b c d e f g h\na b\na b", "é%% ###"]
    together = puquality.text_features(pa.array(texts))
    for i, t in enumerate(texts):
        assert np.allclose(together[i], puquality.text_features(pa.array([t], pa.string()))[0])
