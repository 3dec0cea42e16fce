"""Language of short texts from character n-gram profiles, learned from labelled rows.

Method: a text is the sequence of its overlapping ``SIZE``-grams of letters and blanks; a naive Bayes model over the
grams of each language gives the posterior of every language.

Scale: at most ``PER_LANGUAGE`` labelled rows a language train the model (a bounded sample, the rows with the least
hashes); each language keeps its ``GRAMS`` most frequent grams, so the model that travels to the tasks is bounded by
``GRAMS`` times the languages, of which ``MAX_LANGUAGES`` are accepted.  Detection is a map.

Defined results: null texts and texts without a letter have no language (null, null); labels compare without regard to
case, region and blanks (``en-GB`` is ``en``); rows without a label or text do not train; without any labelled row
nothing is detected; equal posteriors go to the smaller label.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

SIZE, PER_LANGUAGE, GRAMS, MAX_LANGUAGES = 3, 2_000, 3_000, 300
LEAST_P = 0.9
_OTHER = re.compile(r"[\W\d_]+")


def grams(text: str) -> list[str]:
    """The n-grams of letters; runs of anything else are one blank."""
    s = f" {_OTHER.sub(' ', text.lower()).strip()} "
    return [s[i : i + SIZE] for i in range(len(s) - SIZE + 1)] if len(s) > 2 else []


def label(c):
    """A language label in its short form, null where blank."""
    return F.nullif(F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]{2,3})(?:[-_].*)?$", 1), F.lit(""))


class Profiles:
    """Log shares of the grams per language, with one share for those a language does not know."""

    def __init__(self, counts: dict[str, dict[str, int]]):
        self.languages = sorted(counts)
        self.index: dict[str, int] = {}
        for c in counts.values():
            for g in c:
                self.index.setdefault(g, len(self.index))
        total = {k: sum(c.values()) + len(self.index) + 1 for k, c in counts.items()}
        self.table = np.empty((len(self.index) + 1, len(counts)))
        for j, k in enumerate(self.languages):
            self.table[:, j] = -math.log(total[k])
            for g, n in counts[k].items():
                self.table[self.index[g], j] = math.log((n + 1) / total[k])

    def detect(self, text: str | None) -> tuple[str, float] | None:
        """(language, posterior) of a text; the evidence of overlapping grams counts once per ``SIZE``."""
        got = grams(text) if text else []
        if not got or not self.languages:
            return None
        none = len(self.index)
        n = Counter(self.index.get(g, none) for g in got)
        score = (np.fromiter(n.values(), float) @ self.table[np.fromiter(n.keys(), int)]) / SIZE
        p = np.exp(score - score.max())
        best = int(p.argmax())
        return self.languages[best], float(p[best] / p.sum())


def learn(rows: DataFrame, text: str = "text", lang: str = "lang") -> Profiles:
    """Profiles from labelled rows."""
    rows = rows.select(F.col(text).alias("text"), label(F.col(lang)).alias("lang")).where("lang is not null and text is not null")
    order = W.partitionBy("lang").orderBy(F.xxhash64("text"), "text")
    sample = rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= PER_LANGUAGE)

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            n: Counter = Counter()
            for t, k in zip(pdf["text"], pdf["lang"]):
                n.update((k, g) for g in grams(t))
            if n:
                yield pd.DataFrame([(k, g, v) for (k, g), v in n.items()], columns=["lang", "gram", "n"])

    n = sample.select("text", "lang").mapInPandas(count, "lang string, gram string, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = n.withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "gram"))).where(F.col("_r") <= GRAMS).select("lang", "gram", "n")
    counts: dict[str, dict[str, int]] = {}
    for r in top.limit(GRAMS * MAX_LANGUAGES).toLocalIterator():
        counts.setdefault(r["lang"], {})[r["gram"]] = r["n"]
    return Profiles(counts)


_RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("prob", T.DoubleType())])


def detector(session, profiles: Profiles):
    """Function of a text column that gives struct(lang, prob)."""
    shared = session.sparkContext.broadcast(profiles)

    @F.pandas_udf(_RESULT)
    def detect(texts: pd.Series) -> pd.DataFrame:
        got = [shared.value.detect(t) or (None, None) for t in texts]
        return pd.DataFrame({"lang": pd.Series([g[0] for g in got], dtype=object), "prob": pd.Series([g[1] for g in got], dtype="float64")})

    return detect


def not_english(found, least: float = LEAST_P):
    """The top language is another, or too unsure; what cannot be judged is kept."""
    return F.coalesce((found["lang"] != "en") | (found["prob"] < least), F.lit(False))
