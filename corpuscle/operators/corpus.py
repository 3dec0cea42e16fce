"""Corpus construction: validate, enrich by the actor dimension, de-duplicate, audit the balance."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .. import schemas as S
from ..functions import dates, text
from ..session import cut, settle, small, squash


def dimension(dim_actor: DataFrame) -> DataFrame:
    """Actor dimension with its comparison key; one row per key (the least actor on a clash)."""
    d = dim_actor.select(squash(F.col("actor")).alias("actor_key"), F.struct("actor", F.col("type").alias("actor_type"), "positioning", "pair", "target").alias("d"))
    return d.groupBy("actor_key").agg(F.min("d").alias("d")).select("actor_key", "d.*")


def enrich(raw: DataFrame, dim_actor: DataFrame) -> DataFrame:
    """Rows of known actors and contexts with text: canonical actor, platform default, break flag, word count."""
    context, platform = squash(F.col("context")), squash(F.col("platform"))
    rows = raw.where(text.has_text("text")).select(
        "doc_id",
        squash(F.col("actor")).alias("actor_key"),
        context.alias("context"),
        F.when(platform.isin(*S.PLATFORMS), platform).otherwise(S.DEFAULT_PLATFORM).alias("platform"),
        dates.first_known("date").alias("date"),
        dates.after_break("date").cast("smallint").alias("post_chatgpt"),
        text.word_count("text").alias("word_count"),
        "text",
    ).where(F.col("context").isin(*S.CONTEXTS))
    return rows.join(small(dimension(dim_actor)), "actor_key").select(*[c for c in S.columns(S.CORPUS)])


def one_per_id(docs: DataFrame) -> DataFrame:
    """One row per id: of repeated ids the first scraped, of equal times the least row.

    Ids and times are counted in a slim aggregation; only rows of ids that tie for the first time are ever shuffled
    whole.  Rows without an id are one."""
    times = docs.groupBy("doc_id", "scraped_at").count().groupBy("doc_id")
    again = times.agg(F.sum("count").alias("n"), F.min(F.struct("scraped_at", "count")).alias("m")).where("n > 1 or doc_id is null")
    again = cut(again.select("doc_id", F.col("m.scraped_at").alias("_first"), (F.col("m.count") > 1).alias("_tied")))
    ties, nulls = again.agg(F.count_if("_tied"), F.count_if(F.col("doc_id").isNull())).first()
    out = settle(docs, "doc_id", again.where("doc_id is not null"), F.col("scraped_at").eqNullSafe(F.col("_first")) & ~F.col("_tied"))
    row = F.min(F.struct("scraped_at", *[c for c in docs.columns if c not in ("doc_id", "scraped_at")])).alias("_row")
    least = lambda rows: rows.groupBy("doc_id").agg(row).select("doc_id", "_row.*")
    if ties:
        out = out.unionByName(least(docs.join(small(again.where("_tied").select("doc_id")), "doc_id", "left_semi")))
    if nulls:
        out = out.where("doc_id is not null").unionByName(least(docs.where("doc_id is null")))
    return out.drop("scraped_at")


def deduplicate(docs: DataFrame, prefix: int = 200) -> DataFrame:
    """Keeps the least doc_id of each (actor, date, first characters of the text).

    A slim pass finds the digests that several ids have; the texts stay where they are."""
    rows = docs.withColumn("_k", F.md5(F.concat_ws("\u0001", "actor", "date", F.substring("text", 1, prefix))))
    twice = rows.groupBy("_k").agg(F.min("doc_id").alias("_least"), F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_k", "_least")
    return settle(rows, "_k", cut(twice), F.col("doc_id") == F.col("_least")).drop("_k")


def counts(docs: DataFrame, *keys: str) -> DataFrame:
    return docs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_docs"))


def shares(docs: DataFrame, key: str) -> DataFrame:
    """Count and per cent of the total per group, in one aggregation and a window over its few rows."""
    n = counts(docs, key)
    return n.select(key, "n_docs", F.round(F.col("n_docs") * 100.0 / F.sum("n_docs").over(W.partitionBy()), 1).alias("pct"))


def pivot(docs: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and column value, zero-filled, with a total."""
    p = docs.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    p = p.select(row, *[F.coalesce(F.col(v), F.lit(0)).alias(v) for v in values])
    return p.withColumn("total", sum((F.col(v) for v in values[1:]), F.col(values[0])))


def coverage_gaps(docs: DataFrame, dim_actor: DataFrame, least: int) -> DataFrame:
    """Every actor and context it should cover (policymakers need no commercial one) with the rows it lacks."""
    wanted = dimension(dim_actor).select("actor", "actor_type", F.explode(F.array(*map(F.lit, S.CONTEXTS))).alias("context"))
    wanted = wanted.where(~((F.col("actor_type") == "policymaker") & (F.col("context") == "commercial")))
    n = counts(docs, "actor", "context")
    full = wanted.join(n, ["actor", "context"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return full.where(F.col("n_docs") < least).select("actor", "context", "n_docs", (F.lit(least) - F.col("n_docs")).alias("missing"))


def balance_rules(docs: DataFrame, rules: dict = S.BALANCE) -> DataFrame:
    """(rule, value, threshold, passed) of the corpus audit: one aggregation by cell, one over its few rows."""
    cell = docs.groupBy("actor", "actor_type", "context").count()
    sets = cell.groupingSets([["actor"], ["context"], ["actor_type"], []], "actor", "context", "actor_type").agg(F.grouping_id().alias("g"), F.sum("count").alias("n"))
    of = lambda g: F.col("g") == g  # noqa: E731  # bits: actor, context, actor_type are aggregated away
    kinds = list(rules["type_split"])
    one = sets.agg(
        F.coalesce(F.max(F.when(of(7), F.col("n"))), F.lit(0)).cast("double").alias("t"), F.max(F.when(of(3), F.col("n"))).alias("top"), F.min(F.when(of(5), F.col("n"))).alias("low"),
        *[F.coalesce(F.max(F.when(of(6) & (F.col("actor_type") == k), F.col("n"))), F.lit(0)).alias(f"k_{k}") for k in kinds],
    )
    share = lambda c: F.round(F.try_divide(F.col(c), F.col("t")), 6)
    row = lambda rule, value, limit, passed: F.struct(F.lit(rule).alias("rule"), value.alias("value"), F.lit(float(limit)).alias("threshold"), passed.alias("passed"))
    least, most, floor, tolerance = (rules[k] for k in ("min_total_docs", "max_actor_share", "min_context_share", "type_tolerance"))
    rows = [row("min_total_docs", F.col("t"), least, F.col("t") >= least), row("max_actor_share", share("top"), most, share("top") <= most), row("min_context_share", share("low"), floor, share("low") >= floor)]
    rows += [row(f"type_{k}", share(f"k_{k}"), w, F.abs(share(f"k_{k}") - w) <= tolerance) for k, w in rules["type_split"].items()]
    return one.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def target_progress(docs: DataFrame, dim_actor: DataFrame) -> DataFrame:
    """Per actor and context: rows there are, rows wanted by the dimension's map, per cent."""
    want = dim_actor.select("actor", F.explode("contexts").alias("context", "target"))
    n = counts(docs, "actor", "context")
    out = want.join(n, ["actor", "context"], "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    return out.select("actor", "context", F.col("target").cast("int").alias("target"), "n_docs", F.round(F.try_divide(F.col("n_docs") * 100.0, F.col("target")), 1).alias("pct"))
