"""Samples whose category shares follow given targets, with minima and a report of what cannot be met.

Method: count the categories, allocate integer quotas by largest remainder with floors (``min_rows``) and caps
(the rows there are), take the rows with the smallest random keys of each category.

Scale: documents shrink to (doc_id, category) before the one shuffle on doc_id; categories and targets are
small dimensions, counted before a broadcast.  The selection never sorts a category: per-category histograms of
the keys' leading 12 bits give the bucket in which a quota ends, whole buckets below it are taken by a filter,
and only the rows of that one bucket (1/4096 of a category) are ranked.

Defined results: repeated doc_ids count once; rows with unknown context or actor, or a null post_chatgpt, are
not eligible; equal keys are ordered by doc_id; a document that matches several targets of a plan is drawn for
the one with the smallest id (``available`` still counts it for each; ``p6_drawn`` tells what that costs); empty tables give empty samples; extra
columns are ignored.
"""
from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from ..session import cut, small, squash, table

CONTEXTS = ("commercial", "policy", "public")
BUCKET_BITS = 12


def eligible(corpus: DataFrame, dim_actor: DataFrame) -> DataFrame:
    """One row per eligible doc_id with its category (context, actor, post_chatgpt)."""
    known = dim_actor.select(squash(F.col("actor")).alias("actor")).distinct()
    rows = corpus.select(
        "doc_id",
        squash(F.col("context")).alias("context"),
        squash(F.col("actor")).alias("actor"),
        F.col("post_chatgpt").cast("int").alias("post"),
    ).where(F.col("context").isin(*CONTEXTS) & F.col("post").isNotNull() & F.col("doc_id").isNotNull())
    one = rows.join(small(known), "actor", "left_semi")
    return one.groupBy("doc_id").agg(F.min(F.struct("context", "actor", "post")).alias("c")).select("doc_id", "c.*")


def _variants(cells: DataFrame) -> DataFrame:
    """Each category cell under the eight target patterns that it counts for: a null in a target means any value."""
    either = lambda c: F.explode(F.array(F.col(c), F.lit(None).cast(dict(cells.dtypes)[c])))
    out = cells.withColumn("t_context", either("context")).withColumn("t_actor", either("actor"))
    return out.withColumn("t_post", either("post"))


def _targets(targets: DataFrame) -> DataFrame:
    return targets.select(
        "target_id", "plan", "sample_pct", "target_pm", "min_rows",
        squash(F.col("context")).alias("w_context"), squash(F.col("actor")).alias("w_actor"), F.col("post_chatgpt").cast("int").alias("w_post"),
    )


#: An equality of keys, so neither side has to be small.
_HIT = "t_context <=> w_context AND t_actor <=> w_actor AND t_post <=> w_post"


def _take(score: list[int], room: list[int], need: int) -> list[int]:
    """How many units each gives if ``need`` are taken one by one from the highest score, each unit lowering its own
    by 1,000, never more than ``room``; of equals the first.  Found by bisection of the last score, not by units."""
    need = min(need, sum(room))
    above = lambda t: [min(r, max(0, (s - t) // 1000 + 1)) for s, r in zip(score, room)]  # noqa: E731  # units of score >= t
    if need <= 0:
        return [0] * len(score)
    low, high = min(s - 1000 * r for s, r in zip(score, room)), max(score) + 1  # all units at low, none at high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if sum(above(mid)) >= need else (low, mid)
    out, last = above(high), above(low)
    for i in range(len(out)):
        more = min(last[i] - out[i], need - sum(out))
        out[i] += max(0, more)
    return out


def allocate(rows: pd.DataFrame, size: int) -> list[int]:
    """Integer quotas summing to ``size`` where possible: floors first, then the rest in proportion to
    target_pm by largest remainder, never above ``available``; ties go to the first row."""
    cap = [int(x) for x in rows["available"]]
    want = [int(pm) * size for pm in rows["target_pm"]]  # in thousandths
    floor = [min(int(m), c) for m, c in zip(rows["min_rows"], cap)]
    quota = [min(c, max(f, w // 1000)) for f, w, c in zip(floor, want, cap)]
    over = sum(quota) - size
    if over > 0:  # floors take their rows from the most overfilled categories above their floors
        less = _take([1000 * q - w for q, w in zip(quota, want)], [q - f for q, f in zip(quota, floor)], over)
        return [q - x for q, x in zip(quota, less)]
    more = _take([w - 1000 * q for q, w in zip(quota, want)], [c - q for q, c in zip(quota, cap)], -over)
    return [q + x for q, x in zip(quota, more)]


_REPORT = "target_id int, plan string, sample_rows bigint, needed bigint, available bigint, quota bigint, shortfall bigint, met boolean"


def report(docs: DataFrame, targets: DataFrame) -> DataFrame:
    """One row per target: rows needed, rows available, the quota allocated and whether the target is met."""
    cells = docs.groupBy("context", "actor", "post").count()
    have = _targets(targets).join(_variants(cells), F.expr(_HIT), "left").groupBy("target_id", "plan", "sample_pct", "target_pm", "min_rows").agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("available")
    )
    total = cells.agg(F.coalesce(F.sum("count"), F.lit(0)).alias("e"))  # one row

    def per_plan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("target_id").reset_index(drop=True)
        size = int(pdf["e"].iat[0]) * int(pdf["sample_pct"].iat[0]) // 100
        needed = [max(-(-int(pm) * size // 1000), int(m)) for pm, m in zip(pdf["target_pm"], pdf["min_rows"])]
        quota = allocate(pdf, size)
        have = pdf["available"].astype(int)
        return pd.DataFrame({
            "target_id": pdf["target_id"], "plan": pdf["plan"], "sample_rows": size, "needed": needed, "available": have,
            "quota": quota, "shortfall": [max(0, n - a) for n, a in zip(needed, have)], "met": [a >= n for n, a in zip(needed, have)],
        })

    return have.join(F.broadcast(total)).groupBy("plan").applyInPandas(per_plan, _REPORT)


def draw(docs: DataFrame, targets: DataFrame, quotas: DataFrame, seed: int = 17) -> DataFrame:
    """The sample: (plan, target_id, doc_id), the ``quota`` smallest keys of each target."""
    cells = docs.groupBy("context", "actor", "post").count().drop("count")
    owner = _targets(targets).join(_variants(cells), F.expr(_HIT)).groupBy("context", "actor", "post", "plan").agg(F.min("target_id").alias("target_id"))
    keyed = docs.join(small(owner), ["context", "actor", "post"]).select(
        "doc_id", "plan", "target_id", F.xxhash64(F.lit(seed), "plan", "doc_id").alias("key")
    ).withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKET_BITS).cast("int"))
    hist = keyed.groupBy("target_id", "bucket").count()
    cum = hist.withColumn("upto", F.sum("count").over(W.partitionBy("target_id").orderBy("bucket")))
    edge = cum.join(small(quotas.select("target_id", "quota")), "target_id").groupBy("target_id").agg(
        F.coalesce(F.min(F.when(F.col("upto") >= F.col("quota"), F.col("bucket"))), F.lit(1 << BUCKET_BITS)).alias("edge"),
        F.coalesce(F.max(F.when(F.col("upto") < F.col("quota"), F.col("upto"))), F.lit(0)).alias("below"),
        F.first("quota").alias("quota"),
    )
    near = keyed.join(small(edge), "target_id").where(F.col("bucket") <= F.col("edge"))
    sure = near.where(F.col("bucket") < F.col("edge"))
    rank = F.row_number().over(W.partitionBy("target_id").orderBy(F.shiftrightunsigned("key", 1), "key", "doc_id"))
    rest = near.where(F.col("bucket") == F.col("edge")).withColumn("rn", rank).where(F.col("rn") <= F.col("quota") - F.col("below"))
    cols = ["plan", "target_id", "doc_id"]
    return sure.select(*cols).unionByName(rest.select(*cols))


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return eligible(table(spark, sf, "corpus"), table(spark, sf, "dim_actor"))


def p6_report(spark: SparkSession, sf: str) -> DataFrame:
    return report(_docs(spark, sf), table(spark, sf, "sample_targets"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    """Targets that cannot be met."""
    return p6_report(spark, sf).where(~F.col("met")).select(F.col("target_id").cast(T.IntegerType()).alias("target_id"))


def p6_sample(spark: SparkSession, sf: str) -> DataFrame:
    docs, targets = cut(_docs(spark, sf)), table(spark, sf, "sample_targets")
    return draw(docs, targets, report(docs, targets))


def p6_drawn(spark: SparkSession, sf: str) -> DataFrame:
    """Per target: its quota, the rows drawn for it and what the sample lacks (rows that an overlapping target took)."""
    docs, targets = cut(_docs(spark, sf)), table(spark, sf, "sample_targets")
    quotas = cut(report(docs, targets))
    n = draw(docs, targets, quotas).groupBy("target_id").agg(F.count(F.lit(1)).alias("drawn"))
    out = quotas.select("target_id", "plan", "quota").join(n, "target_id", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    return out.withColumn("lacking", F.col("quota") - F.col("drawn"))


QUERIES = {"p6_found": p6_found, "p6_report": p6_report, "p6_sample": p6_sample, "p6_drawn": p6_drawn}

_SQ = r"lower(trim(regexp_replace({}, '[\s\p{{Z}}]+', ' ', 'g')))"
_ELIGIBLE = f"""
WITH e AS (
  SELECT DISTINCT doc_id, {_SQ.format("context")} AS context, {_SQ.format("actor")} AS actor, post_chatgpt AS post FROM corpus
  WHERE {_SQ.format("context")} IN ('commercial', 'policy', 'public') AND post_chatgpt IS NOT NULL
    AND {_SQ.format("actor")} IN (SELECT {_SQ.format("actor")} FROM dim_actor)),
s AS (SELECT count(DISTINCT doc_id) AS e FROM e),
h AS (
  SELECT t.target_id, t.sample_pct, t.target_pm, t.min_rows, count(DISTINCT e.doc_id) AS available FROM sample_targets t LEFT JOIN e
  ON (t.context IS NULL OR {_SQ.format("t.context")} = e.context) AND (t.actor IS NULL OR {_SQ.format("t.actor")} = e.actor)
    AND (t.post_chatgpt IS NULL OR t.post_chatgpt = e.post) GROUP BY ALL)
"""
ORACLES = {
    "p6_found": _ELIGIBLE
    + """SELECT target_id FROM h, s
WHERE available < greatest(CAST(ceil(target_pm * floor(e * sample_pct / 100) / 1000) AS BIGINT), min_rows)"""
}
