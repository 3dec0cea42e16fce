"""Multi-label annotation of sentences by a pluggable labeler, in batches, with retry, default and resume."""
from __future__ import annotations

import json
import re
import time
from collections import Counter
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions.text import any_term, rlike

DEFAULT = ["None"]
BATCH = 15

#: Lexicons of the offline labeler: frame -> alternatives of whole words.
LEXICON = {
    "Innovation/Progress": "progress|productivity|discovery|transform|accelerate|improve|advance",
    "Economic Benefit": "investment|jobs|wage|credits|market|demand|spending",
    "Risk/Harm": "risk|harm|incidents|undermine|distort|weaken|expose",
    "Regulation/Governance": "regulation|oversight|accountability|scrutiny|audit|licences|law",
    "Existential/AGI": "AGI|superintelligence|frontier|alignment",
}
#: A stricter second reader.
STRICT = {
    "Innovation/Progress": "progress|productivity|discovery|transform|accelerate",
    "Economic Benefit": "investment|jobs|wage|credits|market",
    "Risk/Harm": "risk|harm|incidents|undermine|distort",
    "Regulation/Governance": "regulation|oversight|accountability|scrutiny|licences",
    "Existential/AGI": "AGI|superintelligence|frontier|alignment",
}
SUBCLASSES = {
    "Scientific": "discovery|scientific|research", "Product": "service|tool|assistant|product", "Infrastructure": "compute|data centres|chips|cluster", "Capability": "model|agent|system", "Societal": "clinics|schools|classroom|public",
}


class Labeler(Protocol):
    def __call__(self, batch: list[dict]) -> str:
        """Answer of the model for [{id, text}]: a JSON array of {id, labels}."""


class LexiconLabeler:
    """Deterministic labeler for offline runs: a frame applies when one of its words occurs."""

    def __init__(self, lexicon: dict[str, str] = LEXICON):
        self.rules = {f: re.compile(rf"(?<![^\W_])(?:{w})(?![^\W_])", re.I) for f, w in lexicon.items()}

    def __call__(self, batch: list[dict]) -> str:
        return json.dumps([{"id": b["id"], "labels": [f for f, r in self.rules.items() if r.search(b["text"])] or DEFAULT} for b in batch])


LABELERS: dict[str, Callable[[], Labeler]] = {"lexicon": LexiconLabeler, "strict": lambda: LexiconLabeler(STRICT)}


def labeler_for(model: str) -> Callable[[], Labeler]:
    """Factory by the longest registered prefix of the model's name."""
    hits = [p for p in LABELERS if model.startswith(p)]
    if not hits:
        raise KeyError(f"no labeler for {model!r}")
    return LABELERS[max(hits, key=len)]


def parse_response(raw: str, ids: list[str], allowed: list[str] | None = None) -> dict[str, list[str]]:
    """{id: labels}: fences stripped, unknown labels dropped, empty and missing ones 'None'; malformed JSON raises."""
    allowed = [*S.FRAMES, "None"] if allowed is None else allowed
    body = re.sub(r"```[a-z]*\n?", "", raw).strip()
    got = {str(x["id"]): [y for y in x.get("labels", []) if y in allowed] or DEFAULT for x in json.loads(body)}
    return {i: got.get(i, DEFAULT) for i in ids}


def label(sentences: DataFrame, factory: Callable[[], Labeler], id_column: str = "sentence_id", text: str = "sentence_text", batch: int = BATCH, attempts: int = 3, back_off: float = 0.0) -> DataFrame:
    """(id, labels, error): one client per partition, batches of ``batch``; a batch that fails ``attempts`` times gets
    the default and its error.  Results depend only on the rows, so a retried task writes the same."""
    kind = dict(sentences.dtypes)[id_column]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = factory()
        for pdf in pdfs:
            if not len(pdf):
                continue
            ids, labels, errors = [], [], []
            for at in range(0, len(pdf), batch):
                part = pdf.iloc[at : at + batch]
                rows = [{"id": str(i), "text": t or ""} for i, t in zip(part[id_column], part[text])]
                error = None
                for k in range(attempts):
                    try:
                        got = parse_response(client(rows), [r["id"] for r in rows])
                        error = None
                        break
                    except Exception as e:  # noqa: BLE001
                        error = type(e).__name__
                        time.sleep(back_off * (k + 1))
                if error:
                    got = {r["id"]: DEFAULT for r in rows}
                ids += part[id_column].tolist()
                labels += [got[r["id"]] for r in rows]
                errors += [error] * len(rows)
            yield pd.DataFrame({id_column: ids, "labels": labels, "error": pd.Series(errors, dtype=object)})

    return sentences.select(id_column, text).mapInPandas(run, f"{id_column} {kind}, labels array<string>, error string")


def dead_letters(labeled: DataFrame, id_column: str = "sentence_id") -> DataFrame:
    """Errors with the number of rows and the three least ids; each task keeps three, so no error is ever gathered."""
    kind = dict(labeled.dtypes)[id_column]

    def least(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, ids = Counter(), {}
        for pdf in pdfs:
            for error, part in pdf.groupby("error")[id_column]:
                n[error] += len(part)
                ids[error] = sorted({*ids.get(error, ()), *part})[:3]
        if n:
            yield pd.DataFrame({"error": list(n), "n": list(n.values()), "ids": [ids[e] for e in n]})

    parts = labeled.where("error is not null").select("error", id_column).mapInPandas(least, f"error string, n bigint, ids array<{kind}>")
    three = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, 3)
    for by in (["error", F.pmod(F.hash("ids"), F.lit(256)).alias("_salt")], ["error"]):
        parts = parts.groupBy(*by).agg(F.sum("n").alias("n"), three("ids").alias("ids")).drop("_salt")
    return parts.select("error", "n", F.col("ids").alias("first_ids"))


def by_lexicon(sentences: DataFrame, text: str = "sentence_text", lexicon: dict[str, str] = LEXICON, suffix: str = "") -> DataFrame:
    """The lexicon's 0/1 columns without leaving the JVM."""
    cols = [rlike(text, any_term(w)).cast("int").alias(S.FRAME_COLUMNS[f] + suffix) for f, w in lexicon.items()]
    return sentences.select("*", *cols)


def one_hot(labeled: DataFrame, labels: str = "labels") -> DataFrame:
    """0/1 column per frame; ``is_none`` only where the labels are exactly ['None']."""
    cols = [F.array_contains(labels, f).cast("int").alias(S.FRAME_COLUMNS[f]) for f in S.FRAMES]
    return labeled.select("*", (F.col(labels) == F.array(F.lit("None"))).cast("int").alias("is_none"), *cols)


def pending(sentences: DataFrame, done: DataFrame, id_column: str = "sentence_id") -> DataFrame:
    """What a resumed run still has to label."""
    return sentences.join(done.select(id_column).distinct(), id_column, "left_anti")


def fully_done(sentences: DataFrame, done: DataFrame, id_column: str = "sentence_id") -> DataFrame:
    """Documents all of whose sentences are labelled."""
    d = done.select(id_column).distinct().withColumn("_d", F.lit(True))
    return sentences.join(d, id_column, "left").groupBy("doc_id").agg(F.bool_and(F.coalesce("_d", F.lit(False))).alias("ok")).where("ok").select("doc_id")
