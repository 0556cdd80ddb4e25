import re

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from tapeloom.llm import registry, toxicity
from tapeloom.llm.common import crc_fold, materialize, scratch
from tests.llm.helpers import DIR
from tests.llm.test_near_copies import slow_groups
from tests.llm.test_text_ops import brute_found


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["toxicity", "simhash", "decontamination", "secrets", "packing"]

    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    model = toxicity.train_toxicity(docs, labels, crc_fold("doc_id", 5) != 0)
    clean = materialize(steps["toxicity"](spark, docs, DIR), "t")
    rows = docs.toPandas()
    keep = toxicity.score_texts(rows.text, model) < 0.5
    assert sorted(clean.toPandas().doc_id) == sorted(rows.doc_id[keep]) and clean.columns == docs.columns

    rows = clean.toPandas()
    one = materialize(steps["simhash"](spark, clean, DIR), "s")
    assert sorted(one.toPandas().doc_id) == sorted(set(slow_groups(rows.text, rows.doc_id))) and one.columns == docs.columns

    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    free = materialize(steps["decontamination"](spark, one, DIR), "d")
    words = lambda t: " ".join(re.findall(r"\w+", t.lower()))
    whole = {r.doc_id for r in one.collect() if any(f" {words(t)} " in f" {words(r.text)} " for _, t in bench if len(words(t).split()) >= 5)}
    gone = set(one.toPandas().doc_id) - set(free.toPandas().doc_id)
    assert whole <= gone
    texts = {r.doc_id: r.text for r in one.collect()}
    by = list(texts)
    assert gone == {by[k - 1] for k, *_ in brute_found(list(texts.values()), bench)}

    safe = materialize(steps["secrets"](spark, free, DIR), "r")
    assert safe.columns == docs.columns and safe.count() == free.count()
    changed = safe.join(free.select("doc_id", F.col("text").alias("before")), "doc_id").where("text <> before")
    assert changed.where(~F.contains("text", F.lit("[SECRET]"))).count() == 0

    pieces = steps["packing"](spark, safe, DIR).toPandas()
    assert set(pieces.doc_id) == set(safe.toPandas().doc_id)
    assert (pieces.groupby("doc_id").length.sum() == pieces.groupby("doc_id").doc_tokens.first()).all()
    assert (pieces.groupby("sequence_id").length.sum() <= 2048).all() and np.isfinite(pieces.ids_crc32).all()


def test_all_queries_are_registered():
    assert sorted(registry.queries(), key=lambda n: int(re.match(r"op(\d+)_", n)[1])) == [n for n in registry._QUERIES]
    assert corpus_pipeline.ORACLE_SQL is None


def test_scratch_deletes_what_is_not_kept(spark):
    import os

    with scratch():
        first = materialize(spark.range(5), "a")
        kept = materialize(first.withColumn("x", F.lit(1)), "b", keep=True)
    assert not os.path.exists(first.written_to.removeprefix("file:")) and kept.count() == 5
