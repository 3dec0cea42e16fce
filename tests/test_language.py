"""Language detection on held-out texts and its edges."""
import os

import pytest
from pyspark.sql import functions as F

from corpuscle.operators import language as L
from corpuscle.operators import sentences

DATA = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    if not os.path.exists(DATA):
        pytest.skip("no test tables")
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("text", L.label(F.col("lang")).alias("lang")).where("lang is not null and length(trim(text)) > 20")
    half = F.pmod(F.xxhash64("text"), F.lit(2))
    model = L.learn(d.where(half == 0))
    test = d.where(half == 1).withColumn("found", L.detector(spark, model)("text"))
    n, right = test.agg(F.count(F.lit(1)), F.count_if(F.col("found.lang") == F.col("lang"))).first()
    assert n > 200 and right / n > 0.97


def test_edges(spark):
    rows = [("The council met on Monday and agreed on the plan for the river.", "EN-gb "), ("Der Rat hat sich am Montag auf den Plan für den Fluss geeinigt.", "de"), (None, "fr"), ("x", None), ("y", "  "), ("The people of the town agreed.", " en")]
    df = spark.createDataFrame(rows, "text string, lang string")
    m = L.learn(df)
    assert m.languages == ["de", "en"]
    got = [m.detect(t) for t in ("The plan for the council", "Der Plan für den Rat", None, "", "123 ?!")]
    assert [g and g[0] for g in got] == ["en", "de", None, None, None] and got[0][1] > 0.9
    assert L.learn(df.limit(0)).detect("text") is None and m.detect("the plan " * 20_000)[0] == "en"


def test_language_is_the_last_filter(spark):
    en = "The model of the council will be a risk for the people of the town and the plan."
    de = "Das model des Rates ist ein Risiko für die Menschen der Stadt und den ganzen Plan."
    m = L.learn(spark.createDataFrame([(en, "en"), (de, "de")], "text string, lang string"))
    df = spark.createDataFrame([(en, 17), (de, 15), ("short", 1), ("9 9 9 9 9 9 9 9 model", 9)], "sentence_text string, word_count int")
    assert [r.reason for r in sentences.with_reason(df, profiles=m).collect()] == ["", "non_english", "too_short", "non_english"]
