"""Sentence labels to document scores, distributions, modes and top lists."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S

SCORES = [f"{c}_score" for c in S.FRAME_COLUMNS.values()]


def doc_scores(meta: DataFrame, labeled: DataFrame) -> DataFrame:
    """Share of a document's sentences with each frame; n_sentences 0 and null scores where it has none."""
    frames = list(S.FRAME_COLUMNS.values())
    none = F.when(sum((F.col(c) for c in frames[1:]), F.col(frames[0])) == 0, 1.0).otherwise(0.0)
    agg = labeled.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("n_sentences"), *[F.round(F.avg(c), 6).alias(f"{c}_score") for c in frames], F.round(F.avg(none), 6).alias("none_pct")
    )
    return meta.join(agg, "doc_id", "left").withColumn("n_sentences", F.coalesce("n_sentences", F.lit(0)))


def context_means(scored: DataFrame, by: str = "context") -> DataFrame:
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("n_docs"), *[F.round(F.avg(c), 6).alias(c) for c in SCORES])


def label_distribution(labeled: DataFrame) -> DataFrame:
    """Labelled sentences and per cent per frame, and those without any."""
    frames = list(S.FRAME_COLUMNS.values())
    t = labeled.agg(F.count(F.lit(1)).alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in frames], F.count_if(sum((F.col(c) for c in frames[1:]), F.col(frames[0])) == 0).alias("none"))
    parts = ", ".join(f"'{c}', {c}" for c in [*frames, "none"])
    long = t.select("n", F.expr(f"stack({len(frames) + 1}, {parts}) AS (label, n_sentences)"))
    return long.select("label", "n_sentences", F.round(F.coalesce(F.try_divide(F.col("n_sentences") * 100.0, F.col("n")), F.lit(0.0)), 4).alias("pct"))


def top_docs(scored: DataFrame, score: str, n: int = 5) -> DataFrame:
    """The n best by score among documents with sentences; ties by doc_id."""
    return scored.where((F.col("n_sentences") > 0) & F.col(score).isNotNull()).orderBy(F.desc(score), "doc_id").limit(n).select("doc_id", score, "n_sentences")


def mode(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Most frequent value per key; ties by the least value."""
    n = rows.where(F.col(value).isNotNull()).groupBy(key, value).count()
    return n.groupBy(key).agg(F.min_by(value, F.struct(-F.col("count"), F.col(value))).alias("dominant"), F.max("count").alias("n"))


def category_pct(rows: DataFrame, key: str, value: str, categories: list[str]) -> DataFrame:
    """Per key the per cent of each category."""
    base = rows.where(F.col(value).isNotNull())
    return base.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[F.round(F.avg((F.col(value) == c).cast("double")) * 100, 1).alias(f"{c.lower()}_pct") for c in categories])


def in_range(scored: DataFrame) -> DataFrame:
    """Whether all values of each score lie in [0, 1]."""
    cols = [*SCORES, "none_pct"]
    t = scored.agg(*[F.coalesce(F.bool_and(F.col(c).between(0, 1)), F.lit(True)).alias(c) for c in cols])
    return t.select(F.expr(f"stack({len(cols)}, " + ", ".join(f"'{c}', {c}" for c in cols) + ") AS (score, ok)"))
