import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tapeloom.llm import langid, registry, toxicity
from tests.llm.helpers import DIR, docs


def test_langid_held_out_accuracy(spark):
    got = registry.op1_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(got) == 1000 and (held.lang_pred == held.lang).mean() > 0.97 and got.score.between(0, 1).all()


def test_langid_edges(spark):
    train = docs(spark, ["the and of thing " * 20, "der und die nicht " * 20] * 10).withColumn("lang", F.when(F.col("doc_id") % 2 == 1, "en").otherwise("de"))
    model = langid.train_langid(train, F.lit(True))
    odd = docs(spark, [None, "", "12 34 !?", "the", "der und " * 40_000, "the", "the"]).withColumn("score", F.lit("kept?"))
    got = langid.detect_language(odd, model, score_out="p").orderBy("doc_id").collect()
    assert [r.lang_pred for r in got[:3]] == ["und"] * 3 and [r.p for r in got[:3]] == [0.0] * 3
    assert got[4].lang_pred == "de" and got[3].lang_pred == got[5].lang_pred == "en" and got[0].score == "kept?"
    assert langid.detect_language(odd.limit(0), model).count() == 0
    assert langid.detect_language(odd, langid.train_langid(train.limit(0), F.lit(True))).where("lang_pred <> 'und'").count() == 0


def test_langid_leaves_no_language_out(spark):
    """230 languages, one of them common and most of them with two rows, in room for fewer rows than the table has."""
    texts = [f"q{k % 230:03d}z " * 12 for k in range(460)] + ["q000z and " * 12] * 2_000
    train = docs(spark, texts).withColumn("lang", F.regexp_extract("text", "^(q[0-9]+)z", 1))
    model = langid.train_langid(train, F.lit(True), max_rows=400)
    assert model.labels == [f"q{k:03d}" for k in range(230)]


def test_langid_sees_the_whole_text():
    model = langid.fit_byte_cnn(["the and of thing " * 20, "der und die nicht " * 20] * 20, ["en", "de"] * 20, ["de", "en"], epochs=6)
    text = "the and of thing " * 10 + "der und die nicht " * 400
    assert langid.classify(pd.Series([text]), model).lang_pred[0] == "de"
    one = langid.classify(pd.Series([text]), model, windows_at_once=3)
    assert np.isclose(one.score[0], langid.classify(pd.Series([text]), model).score[0])


def test_toxicity_learns_and_generalises(spark):
    rng = random.Random(1)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(rng.choices(words, k=60)) + (" vile scum " if k % 3 == 0 else " ") + rng.choice(words) for k in range(900)]
    rows = docs(spark, texts)
    labels = rows.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 3 == 1).cast("int").alias("toxic"))
    model = toxicity.train_toxicity(rows, labels, F.col("doc_id") % 5 != 0)
    assert 0 < len(model.index) < 2000
    got = toxicity.score_toxicity(rows, model).where("doc_id % 5 = 0").select("doc_id", "score").collect()
    assert np.mean([(r.score >= 0.5) == (r.doc_id % 3 == 1) for r in got]) > 0.98
    kept = toxicity.drop_toxic(rows, model)
    assert kept.columns == rows.columns and abs(kept.count() - 600) < 12


def test_ftrl_matches_the_formulas():
    x, y = [np.array([1, 3]), np.array([3])], [1, 0]
    m = toxicity.fit_ftrl(x, y, bits=3, alpha=0.5, l1=0.0, l2=0.0, epochs=1, seed=0)
    order = np.random.default_rng(0).permutation(2)
    z, n, zb, nb = np.zeros(8), np.zeros(8), 0.0, 0.0
    for k in order:
        w = {i: -z[i] / ((1 + n[i] ** 0.5) / 0.5) for i in x[k]}
        b = -zb / ((1 + nb ** 0.5) / 0.5)
        g = 1 / (1 + np.exp(-(b + sum(w.values())))) - y[k]
        for i in x[k]:
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / 0.5 * w[i]
            n[i] += g * g
        zb, nb = zb + g - ((nb + g * g) ** 0.5 - nb ** 0.5) / 0.5 * b, nb + g * g
    assert np.allclose(m.dense()[[1, 3]], [-z[i] / ((1 + n[i] ** 0.5) / 0.5) for i in (1, 3)])


def test_toxicity_edges(spark):
    rows = docs(spark, ["a b", None, "", "a " * 50_000, "a b"])
    none = toxicity.train_toxicity(rows, spark.createDataFrame([], "doc_id long, toxic int"), F.lit(True))
    one = toxicity.train_toxicity(rows, spark.createDataFrame([(1, 0), (1, 0), (2, None)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.score_toxicity(rows, none).where("score < 0.5").count() == 5
    elsewhere = toxicity.train_toxicity(rows, spark.createDataFrame([(901, 0), (902, 1)], "doc_id long, toxic int"), F.lit(True))
    assert toxicity.drop_toxic(rows, elsewhere).count() == 5
    assert toxicity.score_toxicity(rows, one).where("score < 0.5").count() == 5
    assert toxicity.score_toxicity(rows.limit(0), one).count() == 0
    clash = toxicity.drop_toxic(rows.withColumn("toxic_score", F.lit(9)), one)
    assert clash.columns[-1] == "toxic_score" and clash.count() == 5


def test_op5_shape(spark):
    got = registry.op5_toxicity(spark, DIR).toPandas()
    assert got.score.between(0, 1).all() and ((got.score >= 0.5).astype(int) == got.predicted).all() and len(got) == 200
