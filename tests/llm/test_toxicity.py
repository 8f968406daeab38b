import numpy as np
from pyspark.sql import functions as F

from quarrylight.llm import toxicity as op
from quarrylight.llm.models import Logistic, folds, out_of_fold
from tests.llm import cases


def test_out_of_fold_predictions_dont_see_their_row():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 3))
    y = (x[:, 0] > 0).astype(float)
    found = out_of_fold(Logistic, x, y)
    for f in range(3):
        own = folds(60, 3) == f
        assert np.allclose(found[own], Logistic().fit(x[~own], y[~own]).predict(x[own]))


def test_later_models_see_earlier_probabilities():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 2))
    first = (x[:, 0] + 0.3 * rng.normal(size=300) > 0).astype(int)
    labels = np.stack([first, first], 1)
    chain = op.Chain().fit(x, labels)
    assert len(chain.models[0].mean) == 2 and len(chain.models[1].mean) == 3
    p = chain.predict(x)
    assert p.shape == (300, 2) and ((p[:, 1] > 0.5) == (first == 1)).mean() > 0.85
    constant = op.Chain().fit(x, np.zeros((300, 1)))
    assert (constant.predict(x) == 0).all()


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    at = cases.sf("sf0.01")
    labels = spark.read.parquet(f"{at}/labels.parquet").where("toxic is not null")
    found = op.op1_toxicity(spark, at)
    assert found.count() == spark.read.parquet(f"{at}/documents.parquet").count()
    joined = found.join(labels.withColumnRenamed("toxic", "is_toxic"), "doc_id").select("toxic", "is_toxic").collect()
    hit = [r["toxic"] for r in joined if r["is_toxic"]]
    false = [r["toxic"] for r in joined if not r["is_toxic"]]
    assert np.mean(hit) > 0.8 and np.mean(false) < 0.05


def test_held_out_labels(spark):
    """Trained on half of the labels, judged on the other half."""
    at = cases.sf("sf0.1")
    docs, labels = spark.read.parquet(f"{at}/documents.parquet"), spark.read.parquet(f"{at}/labels.parquet").where("toxic is not null")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0
    found = op.toxicity(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels.where(half), {"unsound": F.col("quality") == 0, "toxic": F.col("toxic") == 1})
    judged = found.join(labels.where(~half), "doc_id").select("p_toxic", "toxic").collect()
    toxic = [r["p_toxic"] for r in judged if r["toxic"]]
    clean = [r["p_toxic"] for r in judged if not r["toxic"]]
    assert np.mean([p >= 0.5 for p in toxic]) > 0.7 and np.mean([p >= 0.5 for p in clean]) < 0.03


def test_the_query_against_one_process(spark):
    """Words counted, chosen, and every document scored in plain Python."""
    at = cases.sf()
    docs = {r["doc_id"]: (r["text"] or "") for r in spark.read.parquet(f"{at}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{at}/labels.parquet").dropna().collect()}
    ids = sorted(d for d in labels if d in docs)
    y = np.array([[int(labels[d]["quality"] == 0), labels[d]["toxic"], int(labels[d]["quality"] == 0 and labels[d]["toxic"] == 1)] for d in ids])
    words = [sorted({f for w in op.WORD.findall(docs[d].lower()) for f in op.word_features(w)}) for d in ids]
    chosen = []
    for own in y.T:
        n, k, share = {}, {}, own.mean()
        for found, one in zip(words, own, strict=True):
            for f in found:
                n[f], k[f] = n.get(f, 0) + 1, k.get(f, 0) + int(one)
        part = lambda a, b: a * np.log(a / b) if a > 0 else 0.0
        score = {f: part(k[f], n[f] * share) + part(n[f] - k[f], n[f] * (1 - share)) for f in n if n[f] >= 3} if 0 < share < 1 else {}
        best = sorted((f for f in score if score[f] > 4), key=lambda f: (-score[f], f))[:150]
        chosen += [f for f in best if f not in chosen]
    hits = op.Hits(chosen)
    rows = np.stack([hits.row(docs[d].encode()).astype(np.float32) for d in ids])
    chain = op.Chain().fit(rows, y)
    want = chain.predict(np.stack([hits.row(t.encode()) for t in docs.values()]))
    found = {r["doc_id"]: r for r in op.op1_toxicity(spark, at).collect()}
    for d, p in zip(docs, want, strict=True):
        assert np.allclose([found[d]["p_unsound"], found[d]["p_toxic"], found[d]["p_toxic_unsound"]], p, atol=1e-3)


def test_without_labels(spark, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    found = op.toxicity(cases.table(spark, clashing=True), labels, {"toxic": F.col("toxic") == 1})
    assert {r["p_toxic"] for r in found.collect()} == {0.0} and found.count() == len(cases.rows())
