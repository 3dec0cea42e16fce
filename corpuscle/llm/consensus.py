"""Consensus labels from several annotators who disagree.

Method: per-annotator confusion matrices and label posteriors by expectation-maximisation with add-one
smoothing (votes are 0/1 per label; an annotator's matrix is shared by the labels, priors are per label), and
chance-corrected agreement reported separately.

Only labels on which annotators differ are listed, so votes are missing *not at random*: a label that is not
listed was unanimous with an unknown value.  The model keeps such labels as items whose common vote is a second
hidden variable; without them the confusion matrices are biased towards disagreement.  ``None`` excludes the
other labels of a sentence, which is applied to the posteriors afterwards.

Scale: sentences are reduced to vote patterns (label, who voted what) and counted with map-side combining; the
number of distinct patterns does not grow with copies.  Votes are kept as (item, annotator, vote) triples, so work and
memory follow the votes and not items times annotators.  Every EM step is one pass over the checkpointed patterns
whose expected counts are summed per annotator.  The tasks need the names and two numbers of each annotator (some 30
bytes: 30 MB for a million people).  Scoring is a map over the sentences, no shuffle.

Defined results: null or unparsable ``disagreements`` list nothing; a label whose remaining votes do not differ
is still listed and judged; votes without 0 or 1 are not votes; repeated votes count once, a later conflicting
one is ignored; repeated sentence_ids count once (the smallest spelling); n_disagreements is not trusted.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, table

LABELS = ("Innovation/Progress", "Economic Benefit", "Risk/Harm", "Regulation/Governance", "Existential/AGI", "None")
_KEY = {re.sub(r"[^a-z]", "", x.lower()): x for x in LABELS}
_VOTE = re.compile(r"([A-Za-z][\w.\-]*)\s*[:=]\s*([01](?:\.0*)?)(?![\w.])")
UNKNOWN = 2  # the vote of a unanimous but unlisted label


def parse(text: str | None) -> dict[str, dict[str, int]]:
    """{label: {annotator: vote}} of one listing."""
    out: dict[str, dict[str, int]] = {}
    for part in re.split(r"[;|\n]", text or ""):
        name, _, votes = part.partition(":")
        label = _KEY.get(re.sub(r"[^a-z]", "", name.lower()))
        if label is None:
            continue
        mine = out.setdefault(label, {})
        for who, v in _VOTE.findall(votes):
            mine.setdefault(who.upper(), int(v[0]))
    return out


def patterns(text: str | None) -> list[str]:
    """Per label of LABELS: ``A=0 B=1`` where listed, ``? A B`` (the sentence's annotators) where unanimous."""
    votes = parse(text)
    who = sorted(set().union(*votes.values())) if votes else []
    return [
        " ".join(f"{a}={v}" for a, v in sorted(votes[x].items())) if x in votes else "? " + " ".join(who)
        for x in LABELS
    ]


def sentences(df: DataFrame) -> DataFrame:
    """One row per sentence_id with its six patterns."""

    @F.pandas_udf("array<string>")
    def pats(s: pd.Series) -> pd.Series:
        return s.map(patterns)

    one = df.where(F.col("sentence_id").isNotNull()).groupBy("sentence_id").agg(F.min("disagreements").alias("disagreements"))
    return one.select("sentence_id", pats("disagreements").alias("pats"))


def _encode(pats: list[str], names: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Votes as triples (item, annotator, 0 / 1 / UNKNOWN) and whether each item is listed."""
    listed = np.ones(len(pats), dtype=bool)
    item, who, vote = [], [], []
    for i, p in enumerate(pats):
        words = p.split()
        if words[:1] == ["?"]:
            listed[i] = False
            words = words[1:]
            who += words
            vote += [UNKNOWN] * len(words)
        else:
            for w in words:
                a, _, x = w.rpartition("=")
                who.append(a)
                vote.append(int(x))
        item += [i] * len(words)
    return np.array(item, dtype=np.int64), np.searchsorted(names, np.array(who, dtype=names.dtype)), np.array(vote, dtype=np.int8), listed


def _joint(votes, prior: np.ndarray, conf: np.ndarray) -> np.ndarray:
    """P(truth, common vote | votes): items x 2 x 2; a listed item has all its mass at common vote 0."""
    item, who, vote, listed = votes
    one, zero = np.log(conf)[who], np.log1p(-conf)[who]  # votes x truth
    total = lambda x: np.stack([np.bincount(item, weights=x[:, t], minlength=len(listed)) for t in (0, 1)], 1)
    all_zero = total(np.where((vote == 1)[:, None], one, zero))
    all_one = total(np.where((vote == UNKNOWN)[:, None], one, 0.0))
    j = np.full((len(listed), 2, 2), -np.inf)
    j[:, :, 0] = all_zero
    j[:, :, 1] = np.where(listed[:, None], -np.inf, all_one)
    j += np.log(np.stack([1 - prior, prior], 1))[:, :, None]
    j = np.exp(j - j.max(axis=(1, 2), keepdims=True))
    return j / j.sum(axis=(1, 2), keepdims=True)


def fit(sents: DataFrame, tolerance: float = 1e-4, max_steps: int = 60):
    """EM over the pattern counts: (annotators, prior per label, P(vote 1 | truth) per annotator)."""
    pats = cut(sents.select(F.posexplode("pats").alias("label", "pat")).groupBy("label", "pat").count())
    found = pats.select(F.explode(F.regexp_extract_all("pat", F.lit(r"([A-Z][^= ]*)"))).alias("a")).distinct().toPandas()
    names = np.array(sorted(found["a"]), dtype=str)
    k, m = len(LABELS), len(names)
    prior, conf = np.full(k, 0.25), np.tile([0.1, 0.8], (m, 1))
    sc = pats.sparkSession.sparkContext
    known = sc.broadcast(names)
    for _ in range(max_steps if m else 0):
        now = sc.broadcast((prior, conf))

        def step(pdfs: Iterator[pd.DataFrame], now=now) -> Iterator[pd.DataFrame]:
            # 0..k: labels (yes, all), from k on: annotators (votes 1 and votes, where the truth is 0 and 1)
            prior, conf = now.value
            for pdf in pdfs:
                if not len(pdf):
                    continue
                votes = _encode(pdf["pat"].tolist(), known.value)
                item, who, vote, _ = votes
                lab, n = pdf["label"].to_numpy(), pdf["count"].to_numpy(dtype=float)
                q = _joint(votes, prior[lab], conf) * n[:, None, None]
                t = q.sum(axis=2)
                ones = np.where((vote == 1)[:, None], t[item], 0.0) + np.where((vote == UNKNOWN)[:, None], q[item, :, 1], 0.0)
                rows = [np.concatenate([lab, k + who])]
                for of_label, of_vote in ((t[:, 1], ones[:, 0]), (n, ones[:, 1]), (0 * n, t[item, 0]), (0 * n, t[item, 1])):
                    rows.append(np.concatenate([of_label, of_vote]))
                yield pd.DataFrame(dict(zip(("i", "a", "b", "c", "d"), rows))).groupby("i", as_index=False).sum()

        got = pats.mapInPandas(step, "i bigint, a double, b double, c double, d double").groupBy("i").agg(*[F.sum(x).alias(x) for x in "abcd"]).toPandas()
        acc = np.zeros((k + m, 4))
        acc[got["i"].to_numpy()] = got[["a", "b", "c", "d"]].to_numpy()
        new_prior = (acc[:k, 0] + 1) / (acc[:k, 1] + 2)
        new_conf = (acc[k:, :2] + 1) / (acc[k:, 2:] + 2)
        moved = max(np.abs(new_prior - prior).max(), np.abs(new_conf - conf).max())
        prior, conf = new_prior, new_conf
        now.unpersist()
        if moved < tolerance:
            break
    return names.tolist(), prior, conf


def posteriors(sents: DataFrame, model, exclusive: str | None = "None") -> DataFrame:
    """(sentence_id, label, listed, n_votes, share_voted, p): the probability that each label applies."""
    names, prior, conf = model
    shared = sents.sparkSession.sparkContext.broadcast((np.array(names, dtype=str), prior, conf))
    alone = LABELS.index(exclusive) if exclusive else None

    def score(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(LABELS)
        names, prior, conf = shared.value
        for pdf in pdfs:
            if not len(pdf):
                continue
            votes = _encode([p for ps in pdf["pats"] for p in ps], names)
            item, _, vote, listed = votes
            p = _joint(votes, np.tile(prior, len(pdf)), conf)[:, 1].sum(axis=1).reshape(-1, k)
            if alone is not None:
                rest = np.delete(p, alone, axis=1)
                none = p[:, alone] * np.prod(1 - rest, axis=1)
                some = (1 - p[:, alone]) * (1 - np.prod(1 - rest, axis=1))
                w = some / np.maximum(none + some, 1e-300)
                any_ = np.maximum(1 - np.prod(1 - rest, axis=1), 1e-300)
                q = np.minimum(1.0, p * (w / any_)[:, None])
                q[:, alone] = 1 - w
                p = q
            n = lambda of: np.bincount(item[of], minlength=len(listed)).astype("int32")  # noqa: B023, E731
            yield pd.DataFrame({
                "sentence_id": np.repeat(pdf["sentence_id"].to_numpy(), k),
                "label": list(LABELS) * len(pdf),
                "listed": listed,
                "n_votes": n(vote != UNKNOWN),
                "n_yes": n(vote == 1),
                "n_annotators": n(vote >= 0),
                "p": p.ravel(),
            })

    return sents.mapInPandas(score, "sentence_id string, label string, listed boolean, n_votes int, n_yes int, n_annotators int, p double")


def agreement(scored: DataFrame) -> DataFrame:
    """Per label: observed pairwise agreement, agreement expected by chance, and their kappa.  Unlisted labels
    agree fully; their unknown common vote enters the chance term with its posterior."""
    n = F.col("n_annotators").cast("double")
    items = scored.where(F.col("n_annotators") >= 2)
    yes = F.when(F.col("listed"), F.col("n_yes").cast("double")).otherwise(n * F.col("p"))
    pair = F.when(F.col("listed"), (F.col("n_yes") * (F.col("n_yes") - 1) + (n - F.col("n_yes")) * (n - F.col("n_yes") - 1)) / (n * (n - 1))).otherwise(1.0)
    a = items.groupBy("label").agg(F.count(F.lit(1)).alias("n_items"), F.avg(pair).alias("observed"), (F.sum(yes) / F.sum(n)).alias("share"))
    chance = F.col("share") ** 2 + (1 - F.col("share")) ** 2
    return a.select("label", "n_items", "observed", chance.alias("expected"), F.try_divide(F.col("observed") - chance, 1 - chance).alias("kappa"))


def _scored(spark: SparkSession, sf: str):
    sents = cut(sentences(table(spark, sf, "kappa_disagreements")))
    model = fit(sents)
    return posteriors(sents, model), model


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each listed label that applies to its sentence."""
    scored, _ = _scored(spark, sf)
    return scored.where(F.col("listed") & (F.col("p") > 0.5)).select("sentence_id", "label")


def p2_consensus(spark: SparkSession, sf: str) -> DataFrame:
    scored, _ = _scored(spark, sf)
    return scored.where("listed").select("sentence_id", "label", (F.col("p") > 0.5).alias("applies"), F.round("p", 6).alias("posterior"), "n_votes", "n_yes")


def p2_agreement(spark: SparkSession, sf: str) -> DataFrame:
    return agreement(_scored(spark, sf)[0])


def p2_reliability(spark: SparkSession, sf: str) -> DataFrame:
    """Per annotator: P(vote 1 | applies), P(vote 0 | does not) and their informedness."""
    _, (names, _prior, conf) = _scored(spark, sf)
    rows = [(a, float(conf[i, 1]), float(1 - conf[i, 0]), float(conf[i, 1] - conf[i, 0])) for i, a in enumerate(names)]
    return spark.createDataFrame(rows, "annotator string, sensitivity double, specificity double, informedness double")


QUERIES = {"p2_found": p2_found, "p2_consensus": p2_consensus, "p2_agreement": p2_agreement, "p2_reliability": p2_reliability}
