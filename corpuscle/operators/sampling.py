"""Deterministic quota samples: rows are ranked by a seeded hash within their stratum, never by a random draw."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import small


def key(seed: int, id_column: str = "sentence_id"):
    return F.md5(F.concat(F.col(id_column), F.lit(f"|{seed}")))


#: Beyond so many rows a stratum the ranking is not cut within tasks (the engine's own bound), so a histogram goes first.
RANKED = 1000


def _nearest(rows: DataFrame, strata: list[str], most: int, seed: int) -> DataFrame:
    """The rows of each stratum with its ``most`` smallest keys, ``_k``.  Each task keeps its own ``most``, so one
    pass suffices and no stratum is sorted whole."""
    rows = rows.withColumn("_k", key(seed))
    if most > RANKED:
        h = F.conv(F.substring("_k", 1, 4), 16, 10).cast("int")
        cum = rows.groupBy(*strata, h.alias("_h")).count().withColumn("_c", F.sum("count").over(W.partitionBy(*strata).orderBy("_h")) - F.col("count"))
        edge = cum.where(F.col("_c") < most).groupBy(*strata).agg(F.max("_h").alias("_edge"))
        same = [F.col(f"r.{c}").eqNullSafe(F.col(f"e.{c}")) for c in strata]
        rows = rows.withColumn("_h", h).alias("r").join(small(edge).alias("e"), [*same, F.col("_h") <= F.col("_edge")]).select("r.*").drop("_h")
    n = F.row_number().over(W.partitionBy(*strata).orderBy("_k", "sentence_id"))
    return rows.withColumn("_n", n).where(F.col("_n") <= most).drop("_n")


def quota(pool: DataFrame, stratum: str, quotas: dict[str, int], tier: str, tier_share: float, seed: int, actors: int = 5, exclude: DataFrame | None = None) -> DataFrame:
    """Per stratum: the first row of the ``actors`` first actors (so a draw has as many wherever the pool has), at least
    ``ceil(share * n)`` rows of the tier (at least one), the rest from the others, falling back to any row when a pool
    is short.  Ids of ``exclude`` are left out."""
    n = F.lit(None).cast("int")
    for s, q in quotas.items():
        n = F.when(F.col(stratum) == s, q).otherwise(n)
    rows = pool.where(F.col(stratum).isin(*quotas)).withColumn("_tier", F.coalesce(F.col(tier).cast("int"), F.lit(0)))
    if exclude is not None:
        rows = rows.join(small(exclude.select("sentence_id")), "sentence_id", "left_anti")
    rows = _nearest(rows, [stratum, "_tier", "actor"], max(quotas.values()), seed)  # all that can be drawn: few rows from here on
    rank = lambda *by: F.row_number().over(W.partitionBy(stratum, *by).orderBy("_k", "sentence_id"))
    need = F.greatest(F.ceil(n * tier_share), F.lit(1))
    rows = rows.withColumn("_r", rank("_tier")).withColumn("_a", rank("actor") == 1).withColumn("_d", rank("_a"))
    pref = F.when(F.col("_a") & (F.col("_d") <= actors), 0).when((F.col("_tier") == 1) & (F.col("_r") <= need), 1).when(F.col("_tier") == 0, 2).otherwise(3)
    pick = F.row_number().over(W.partitionBy(stratum).orderBy(pref, "_k", "sentence_id"))
    return rows.withColumn("rank", pick).where(F.col("rank") <= n).drop("_tier", "_r", "_a", "_d", "_k")


def shuffled(sample: DataFrame, seed: int) -> DataFrame:
    """The whole of a sample in a seeded order, by ``position``; a sample is small, a table is not meant."""
    return sample.withColumn("position", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(key(seed), "sentence_id")))


def disjoint_sets(pool: DataFrame, stratum: str, per_stratum: int, names: list[str], seed: int) -> DataFrame:
    """One ranking per stratum: ranks 1..n are the first set, n+1..2n the second, and so on: disjoint by construction."""
    near = _nearest(pool, [stratum], per_stratum * len(names), seed)
    ranked = near.withColumn("rank", F.row_number().over(W.partitionBy(stratum).orderBy("_k", "sentence_id"))).drop("_k")
    slot = ((F.col("rank") - 1) / per_stratum).cast("int")
    return ranked.withColumn("annotator", F.element_at(F.array(*map(F.lit, names)), slot + 1))


def one_per_actor(pool: DataFrame, stratum: str, seed: int) -> DataFrame:
    """The first row of each actor in each stratum: a draw that starts with them is diverse without retries."""
    k = F.struct(key(seed).alias("k"), F.col("sentence_id"))
    return pool.groupBy(stratum, "actor").agg(F.min(k).alias("m")).select(stratum, "actor", F.col("m.sentence_id").alias("sentence_id"))
