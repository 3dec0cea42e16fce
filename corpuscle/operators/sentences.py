"""Sentence explosion and the ordered filter cascade."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schemas as S
from ..functions import text
from . import language


def explode(docs: DataFrame, keep: list[str], least_tokens: int = 0) -> DataFrame:
    """(keep, pos, sentence_text, word_count): one row per sentence; ids are ``doc_id:pos``."""
    out = docs.select(*keep, F.posexplode(text.sentences("text")).alias("pos", "sentence_text")).withColumn("word_count", text.word_count("sentence_text"))
    return out.where(F.col("word_count") >= least_tokens) if least_tokens else out


def with_reason(sentences: DataFrame, lang: str | None = None, profiles: language.Profiles | None = None) -> DataFrame:
    """``reason`` of the first failing filter, '' for survivors.  The language test comes last, by a column or by
    detection, and is applied to survivors only."""
    out = sentences.withColumn("reason", text.filter_reason("sentence_text", F.col("word_count")))
    if lang is not None:
        bad = F.coalesce(F.lower(F.col(lang)) != "en", F.lit(False))
        out = out.withColumn("reason", F.when((F.col("reason") == "") & bad, "non_english").otherwise(F.col("reason")))
    elif profiles is not None:
        detect = language.detector(sentences.sparkSession, profiles)
        out = out.withColumn("_lang", detect(F.when(F.col("reason") == "", F.col("sentence_text"))))
        out = out.withColumn("reason", F.when((F.col("reason") == "") & language.not_english(F.col("_lang")), "non_english").otherwise(F.col("reason"))).drop("_lang")
    return out


def clean_pool(sentences: DataFrame, lang: str | None = None) -> DataFrame:
    """Survivors of the cascade with their id and the likely-none flag."""
    ok = with_reason(sentences, lang).where("reason = ''").drop("reason")
    return ok.withColumn("sentence_id", F.concat_ws(":", "doc_id", "pos")).withColumn("likely_none", text.likely_none("sentence_text", F.col("word_count")))


def reason_histogram(sentences: DataFrame) -> DataFrame:
    """Rows and per cent per filter reason, zero-filled, with the survivors as 'kept'."""
    n = with_reason(sentences).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    names = F.explode(F.array(*[F.lit(r) for r in [*S.FILTER_REASONS, ""]])).alias("reason")
    spark = sentences.sparkSession
    total = F.sum("n").over(W.partitionBy())
    full = spark.range(1).select(names).join(n, "reason", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return full.select(F.when(F.col("reason") == "", "kept").otherwise(F.col("reason")).alias("reason"), "n", F.round(F.coalesce(F.try_divide(F.col("n") * 100.0, total), F.lit(0.0)), 1).alias("pct"))

