"""Annotator agreement and label quality from one pass over a long table (label, a, b)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schemas as S


def stack(wide: DataFrame, labels: dict[str, tuple[str, str]], keep: list[str]) -> DataFrame:
    """Wide label columns as rows (keep, label, a, b)."""
    parts = ", ".join(f"'{label}', `{a}`, `{b}`" for label, (a, b) in labels.items())
    return wide.select(*keep, F.expr(f"stack({len(labels)}, {parts}) AS (label, a, b)"))


def join_readers(a: DataFrame, b: DataFrame, labels: list[str], id_column: str = "sentence_id", suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Two readers' tables joined on the id; label columns, and others that both have, get their reader's suffix."""
    both = {c for c in a.columns if c in b.columns and c != id_column} | set(labels)
    left, right = (df.select(id_column, *[F.col(c).alias(c + x if c in both else c) for c in df.columns if c != id_column]) for df, x in ((a, suffixes[0]), (b, suffixes[1])))
    return left.join(right, id_column)


def overlap(a: DataFrame, b: DataFrame, id_column: str = "sentence_id") -> DataFrame:
    """Ids that both readers have, and those that only one has."""
    one = lambda df, name: df.select(id_column).distinct().withColumn(name, F.lit(1))
    j = one(a, "_a").join(one(b, "_b"), id_column, "full")
    return j.agg(F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("shared"), F.count_if(F.col("_b").isNull()).alias("only_a"), F.count_if(F.col("_a").isNull()).alias("only_b"))


def with_predictions(gold: DataFrame, predictions: DataFrame, id_column: str = "sentence_id", default: tuple[str, ...] = ("None",)) -> DataFrame:
    """Gold rows with their predicted labels; those without a prediction have the default."""
    p = predictions.select(id_column, F.col("labels").alias("predicted"))
    return gold.join(p, id_column, "left").withColumn("predicted", F.coalesce("predicted", F.array(*map(F.lit, default))))


def kappa(long: DataFrame) -> DataFrame:
    """Per label: n, per cent agreement, Cohen's kappa (null where chance agreement is one)."""
    n = F.count(F.lit(1))
    po = F.avg((F.col("a") == F.col("b")).cast("double"))
    pa, pb = F.avg(F.col("a").cast("double")), F.avg(F.col("b").cast("double"))
    t = long.groupBy("label").agg(n.alias("n"), po.alias("po"), pa.alias("pa"), pb.alias("pb"))
    pe = F.col("pa") * F.col("pb") + (1 - F.col("pa")) * (1 - F.col("pb"))
    k = F.when(F.abs(1 - pe) < 1e-12, None).otherwise((F.col("po") - pe) / (1 - pe))
    return t.select("label", "n", F.round(F.col("po") * 100, 4).alias("agreement_pct"), F.round(k, 6).alias("kappa"))


def kappa_overall(long: DataFrame, gate: float = S.KAPPA_GATE) -> DataFrame:
    """Mean of the labels' kappas (nulls left out), pooled agreement and the gate's verdict."""
    k = kappa(long).agg(F.round(F.avg("kappa"), 6).alias("kappa"))
    pooled = long.agg(F.round(F.avg((F.col("a") == F.col("b")).cast("double")) * 100, 4).alias("agreement_pct"))
    verdict = F.when(F.col("kappa").isNull(), "INCONCLUSIVE").when(F.col("kappa") >= gate, "PASS").otherwise("FAIL")
    return k.crossJoin(pooled).select("kappa", "agreement_pct", verdict.alias("gate"))


def disagreements(wide: DataFrame, labels: dict[str, tuple[str, str]], keep: list[str], text: str) -> DataFrame:
    """Rows on which at least one label differs: ``Label: A=x B=y`` joined by ``; ``."""
    parts = [F.when(F.col(a) != F.col(b), F.concat(F.lit(f"{label}: A="), F.col(a).cast("string"), F.lit(" B="), F.col(b).cast("string"))) for label, (a, b) in labels.items()]
    hits = F.filter(F.array(*parts), lambda x: x.isNotNull())
    out = wide.select(*keep, F.substring(text, 1, 200).alias("sentence_text"), F.array_join(hits, "; ").alias("disagreements"), F.size(hits).alias("n_disagreements"))
    return out.where("n_disagreements > 0")


def confusion(long: DataFrame) -> DataFrame:
    """tp, fp, fn, tn per label; ``a`` is the truth, ``b`` the prediction."""
    c = lambda x, y: F.count_if((F.col("a") == x) & (F.col("b") == y))
    return long.groupBy("label").agg(c(1, 1).alias("tp"), c(0, 1).alias("fp"), c(1, 0).alias("fn"), c(0, 0).alias("tn"))


def prf(long: DataFrame) -> DataFrame:
    """Precision, recall, F1 (0 where undefined), accuracy and positives per label."""
    c = confusion(long)
    z = lambda num, den: F.coalesce(F.try_divide(num, den), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    r6 = lambda x: F.round(x, 6)
    return c.select(
        "label", r6(z(tp, tp + fp)).alias("precision"), r6(z(tp, tp + fn)).alias("recall"), r6(z(2 * tp, 2 * tp + fp + fn)).alias("f1"),
        r6(z(tp + tn, tp + fp + fn + tn)).alias("accuracy"), (tp + fn).alias("human_positive"), (tp + fp).alias("llm_positive"), (tp + fp + fn + tn).alias("n"),
    )


def macro(scores: DataFrame, gate: float = S.F1_GATE) -> DataFrame:
    """Unweighted means over the labels and the verdict on F1."""
    m = scores.agg(*[F.round(F.avg(c), 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])
    return m.withColumn("verdict", F.when(F.col("f1") >= gate, "PASS").otherwise("FAIL"))


def compare(base: DataFrame, other: DataFrame) -> DataFrame:
    """Two score tables side by side; ``robust`` tells whether precision exceeds recall for both."""
    b, o = base.alias("b"), other.alias("o")
    return b.join(o, "label").select(
        "label", F.col("b.precision").alias("precision_base"), F.col("o.precision").alias("precision_other"), F.col("b.recall").alias("recall_base"), F.col("o.recall").alias("recall_other"),
        F.col("b.f1").alias("f1_base"), F.col("o.f1").alias("f1_other"), ((F.col("b.precision") > F.col("b.recall")) & (F.col("o.precision") > F.col("o.recall"))).alias("robust"),
    )
