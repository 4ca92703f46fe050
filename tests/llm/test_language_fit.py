"""The pipeline's language stage drops texts of languages it has not learned."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from packaudit.llm import langid, registry

SF = "/root/testdata/sf0.01"
FOREIGN = ["\u0421\u044a\u0435\u0448\u044c \u0436\u0435 \u0435\u0449\u0451 \u044d\u0442\u0438\u0445 \u043c\u044f\u0433\u043a\u0438\u0445 \u0444\u0440\u0430\u043d\u0446\u0443\u0437\u0441\u043a\u0438\u0445 \u0431\u0443\u043b\u043e\u043a "
           "\u0434\u0430 \u0432\u044b\u043f\u0435\u0439 \u0447\u0430\u044e, \u0438 \u043f\u043e\u0442\u043e\u043c \u043c\u044b \u043f\u043e\u0439\u0434\u0451\u043c \u0433\u0443\u043b\u044f\u0442\u044c",
           "\u4eca\u5929\u5929\u6c14\u5f88\u597d\u6211\u4eec\u4e00\u8d77\u53bb\u516c\u56ed\u6563\u6b65\u7136\u540e\u5728\u6e56\u8fb9\u7684\u5c0f\u9910\u9986\u5403\u5348\u996d",
           "Wczoraj wieczorem poszli\u015bmy na spacer wzd\u0142u\u017c rzeki, a potem zjedli\u015bmy kolacj\u0119 w ma\u0142ej restauracji przy rynku",
           "".join(np.random.default_rng(0).choice(list("abcdefghijklmnopqrstuvwxyz     "), 150))]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_texts_of_no_learned_language_go(spark):
    import corpus_pipeline as cp
    docs = registry.table(spark, SF, "documents").where(F.col("text").rlike(r"\p{L}"))
    left_out = "es"
    rows = docs.withColumn("lang", F.when(F.col("lang") != left_out, F.col("lang")))
    foreign = spark.createDataFrame([(90_000 + i, t, None, "s", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = cp.language_id(spark, rows.unionByName(foreign), SF)
    ids = {r["doc_id"] for r in kept.collect()}
    strange = {r["doc_id"] for r in docs.where(F.col("lang") == left_out).collect()}
    own = {r["doc_id"] for r in docs.where(F.col("lang") != left_out).collect()}
    print(f"left out: kept {len(strange & ids)} of {len(strange)}; learned: kept {len(own & ids)} of {len(own)}; foreign: {sorted(x for x in ids if x >= 90_000)}")
    assert strange and len(strange & ids) <= 0.02 * len(strange)
    assert len(own & ids) >= 0.99 * len(own)
    assert not {x for x in ids if x >= 90_000}


def test_without_held_out_rows_there_is_no_bound(spark):
    rows = spark.createDataFrame([(1, "some words", "en"), (2, "more words", None)], "doc_id long, text string, lang string")
    model = langid.train(rows)
    assert langid.bounds(rows.limit(0), model) == {} and set(langid.bounds(rows, model)) == {"en"}
    assert [r["fit"] for r in langid.identify(rows.withColumn("text", F.lit("12")), model, ["doc_id"], fit=True).collect()] == [None, None]
