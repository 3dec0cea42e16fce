"""Filling fixed-capacity containers with texts measured in tokens of a public tokenizer.

Method: minimum bin slack.  Per bin, the longest item left is placed and a bitset subset-sum over the lengths
still available finds the fullest feasible completion, which is then removed.  Items of equal length are
interchangeable, so the search runs on the histogram of lengths (at most ``capacity`` entries, however large the
corpus) and a bin pattern is applied as often as its lengths last.

Scale: the corpus is mapped once to (doc_id, n_tokens); the histogram is one aggregation with map-side combining;
items find their bin by their rank within their length.  Ranks come from counts per (length, hash bucket), whose
number grows with the corpus, so a length that a third of all items share is never sorted in one task.

Defined results: a text over the capacity is split into full pieces and a rest; null and empty texts take no
space and lie in container 0; repeated rows are items of their own; an empty table gives no containers.
"""
from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut, small, table
from .encoding import token_counts

CAPACITY = 2048
#: Items ranked by one task at most, on average.
BUCKET_ROWS = 20_000


def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The subset of the available lengths (descending) whose sum comes closest to ``room`` from below."""
    reach, trail, mask = 1, [], (1 << (room + 1)) - 1
    for size in lengths:
        if size > room:
            continue
        before, left, unit = reach, min(counts[size], room // size), 1
        while left > 0:  # binary splitting of the multiplicity
            take = min(unit, left)
            reach |= (reach << (size * take)) & mask
            left -= take
            unit *= 2
        trail.append((size, before))
        if reach >> room & 1:
            break
    at, picked = reach.bit_length() - 1, []
    for size, before in reversed(trail):
        k = 0
        while not before >> at & 1:  # the fewest copies that explain the sum
            at -= size
            k += 1
        if k:
            picked.append((size, k))
    return picked


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Bin patterns as (number of bins, {length: copies}) that use up the histogram."""
    counts = {s: n for s, n in histogram.items() if n > 0}
    lengths = sorted(counts, reverse=True)
    out = []
    while lengths:
        seed = lengths[0]
        counts[seed] -= 1
        pattern = {seed: 1}
        for size, k in fullest(counts, lengths, capacity - seed):
            pattern[size] = pattern.get(size, 0) + k
        counts[seed] += 1
        times = min(counts[s] // k for s, k in pattern.items())
        for s, k in pattern.items():
            counts[s] -= times * k
        out.append((times, pattern))
        lengths = [s for s in lengths if counts[s]]
    return out


def pieces(counts: DataFrame, key: str, size: str, capacity: int) -> DataFrame:
    """(key, piece, start, n): whole items, or full pieces and a rest of those over the capacity."""
    n = F.coalesce(F.col(size), F.lit(0))
    last = F.greatest(F.ceil(n / capacity).cast("int"), F.lit(1)) - 1
    cutup = counts.select(key, n.alias("_n"), F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    start = (F.col("piece") * capacity).cast("bigint")
    return cutup.select(key, "piece", start.alias("start"), F.least(F.col("_n") - start, F.lit(capacity)).cast("bigint").alias("n"))


def pack(items: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, piece, start, n, bin) for each piece of each item."""
    parts = cut(pieces(items, key, size, capacity))
    hist = {r["n"]: r["count"] for r in parts.groupBy("n").count().collect()}  # at most capacity + 1 rows
    total = sum(hist.values())
    # per length: where each pattern's share of its ranks begins, its first bin and its copies per bin
    share: dict[int, list[tuple[int, int, int]]] = {}
    used: dict[int, int] = {}
    first = 0
    for times, pattern in plan({s: c for s, c in hist.items() if s > 0}, capacity):
        for s, k in pattern.items():
            share.setdefault(s, []).append((used.get(s, 0), first, k))
            used[s] = used.get(s, 0) + times * k
        first += times
    tables = {s: tuple(np.array(x, dtype=np.int64) for x in zip(*v)) for s, v in share.items()}
    buckets = max(16, total // BUCKET_ROWS)

    @F.pandas_udf("bigint")
    def bin_of(n: pd.Series, rank: pd.Series) -> pd.Series:
        out = np.zeros(len(n), dtype=np.int64)
        sizes, ranks = n.to_numpy(), rank.to_numpy()
        order = np.argsort(sizes, kind="stable")
        bounds = np.flatnonzero(np.diff(sizes[order])) + 1
        for idx in np.split(order, bounds):
            if len(idx) and sizes[idx[0]] > 0:
                begin, base, k = tables[int(sizes[idx[0]])]
                at = np.searchsorted(begin, ranks[idx], side="right") - 1
                out[idx] = base[at] + (ranks[idx] - begin[at]) // k[at]
        return pd.Series(out)

    keyed = parts.withColumn("b", F.pmod(F.xxhash64(key, "piece"), F.lit(buckets)))
    cells = keyed.groupBy("n", "b").count()
    before = cells.withColumn("before", F.sum("count").over(W.partitionBy("n").orderBy("b")) - F.col("count")).drop("count")
    local = F.row_number().over(W.partitionBy("n", "b").orderBy(key, "piece")) - 1
    ranked = keyed.withColumn("local", local).join(small(before), ["n", "b"])
    return ranked.select(key, "piece", "start", "n", bin_of("n", F.col("local") + F.col("before")).alias("bin"))


def _sizes(spark: SparkSession, sf: str) -> DataFrame:
    return token_counts(table(spark, sf, "documents"), "doc_id", "text")


def p9_pack(spark: SparkSession, sf: str) -> DataFrame:
    return pack(_sizes(spark, sf), "doc_id", "n_tokens")


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers, tokens, the least number of containers any packing needs, and the space left unused."""
    bins = p9_pack(spark, sf).where("n > 0").groupBy("bin").agg(F.sum("n").alias("used"), F.count(F.lit(1)).alias("items"))
    a = bins.agg(F.count(F.lit(1)).alias("n_bins"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("items"), F.lit(0)).alias("items"), F.max("used").alias("fullest"))
    return a.select("n_bins", "tokens", "items", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("lower_bound"), F.round(1 - F.try_divide("tokens", F.col("n_bins") * CAPACITY), 6).alias("unused"))


QUERIES = {"p9_pack": p9_pack, "p9_report": p9_report}
