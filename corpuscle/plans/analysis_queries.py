"""Queries on labels, agreement, roll-ups, statistics, pages and streams, with their DuckDB counterparts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import html, text
from ..operators import agreement, labeling, rollup, statistics
from ..session import cut, small, table
from ..streaming import pipelines
from .corpus_queries import _RX, POOL, enriched, pool

Q, O = {}, {}
FRAMES = list(S.FRAME_COLUMNS.values())
SCORES = rollup.SCORES
LEAST_DOC, LEAST_CELL = 5, 10


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# -- labels ----------------------------------------------------------------------------------------------------------
def labeled(s, sf, docs: DataFrame | None = None) -> DataFrame:
    return labeling.by_lexicon(pool(s, sf, docs))


def both(s, sf) -> DataFrame:
    """Two readers of the pool: ``_a`` with the wide, ``_b`` with the strict lexicon."""
    p = labeling.by_lexicon(pool(s, sf), suffix="_a")
    p = labeling.by_lexicon(p, lexicon=labeling.STRICT, suffix="_b")
    none = lambda x: (sum((F.col(f"{c}_{x}") for c in FRAMES[1:]), F.col(f"{FRAMES[0]}_{x}")) == 0).cast("int")
    return p.withColumn("none_a", none("a")).withColumn("none_b", none("b"))


LABELS = {f: (f"{c}_a", f"{c}_b") for f, c in S.FRAME_COLUMNS.items()} | {"None": ("none_a", "none_b")}


def _hot(lexicon: dict, suffix: str = "") -> str:
    return ", ".join(f"CAST({_RX('sentence_text', text.any_term(w))} AS INTEGER) AS {S.FRAME_COLUMNS[f]}{suffix}" for f, w in lexicon.items())


LABELED = POOL + f", lab AS (SELECT *, {_hot(labeling.LEXICON)} FROM pool)"
_NONE = lambda x: "CAST(" + " + ".join(f"{c}_{x}" for c in FRAMES) + " = 0 AS INTEGER)"
BOTH = POOL + f""", two AS (SELECT sentence_id, context, actor, sentence_text, {_hot(labeling.LEXICON, "_a")}, {_hot(labeling.STRICT, "_b")} FROM pool),
both_ AS (SELECT *, {_NONE("a")} AS none_a, {_NONE("b")} AS none_b FROM two),
lng AS ({" UNION ALL ".join(f"SELECT '{f}' AS label, sentence_id, {a} AS a, {b} AS b FROM both_" for f, (a, b) in LABELS.items())})"""
_ANY = " + ".join(FRAMES)


@query("sentence_onehot", f"WITH {LABELED} SELECT sentence_id, {', '.join(FRAMES)} FROM lab")
def sentence_onehot(s, sf):
    return labeled(s, sf).select("sentence_id", *FRAMES)


@query("label_distribution", f"""WITH {LABELED}, t AS (SELECT count(*) AS n, {", ".join(f"sum({c}) AS {c}" for c in FRAMES)}, count(*) FILTER ({_ANY} = 0) AS "none" FROM lab)
{" UNION ALL ".join(f"SELECT '{c}' AS label, CAST({q} AS BIGINT) AS n_sentences, round({q} * 100.0 / n, 4) AS pct FROM t" for c, q in [*((c, c) for c in FRAMES), ("none", '"none"')])}""")
def label_distribution(s, sf):
    return rollup.label_distribution(labeled(s, sf))


@query("frame_cooccurrence", f"WITH {LABELED} " + " UNION ALL ".join(f"SELECT '{a}' AS first, '{b}' AS second, CAST(coalesce(sum({a} * {b}), 0) AS BIGINT) AS n FROM lab" for i, a in enumerate(FRAMES) for b in FRAMES[i + 1 :]))
def frame_cooccurrence(s, sf):
    pairs = [(a, b) for i, a in enumerate(FRAMES) for b in FRAMES[i + 1 :]]
    t = labeled(s, sf).agg(*[F.coalesce(F.sum(F.col(a) * F.col(b)), F.lit(0)).alias(f"{a}_{b}") for a, b in pairs])
    return t.select(F.expr(f"stack({len(pairs)}, " + ", ".join(f"'{a}', '{b}', {a}_{b}" for a, b in pairs) + ") AS (first, second, n)"))


@query("labeler_udf", f"WITH {LABELED} SELECT sentence_id, {', '.join(FRAMES)}, CAST({_ANY} = 0 AS INTEGER) AS is_none FROM lab")
def labeler_udf(s, sf):
    got = labeling.label(pool(s, sf), labeling.labeler_for("lexicon-v1"))
    return labeling.one_hot(got).select("sentence_id", *FRAMES, "is_none")


@query("label_resume", f"WITH {POOL} SELECT context, count(*) AS n_pending FROM pool WHERE substr(md5(sentence_id), 1, 1) >= '8' GROUP BY 1")
def label_resume(s, sf):
    p = pool(s, sf).select("sentence_id", "context")
    done = p.where(F.substring(F.md5("sentence_id"), 1, 1) < "8")
    return labeling.pending(p, done).groupBy("context").agg(F.count(F.lit(1)).alias("n_pending"))


@query("docs_fully_done", f"WITH {POOL} SELECT doc_id FROM pool GROUP BY 1 HAVING bool_and(substr(md5(sentence_id), 1, 1) < 'e')")
def docs_fully_done(s, sf):
    p = pool(s, sf).select("sentence_id", "doc_id")
    return labeling.fully_done(p, p.where(F.substring(F.md5("sentence_id"), 1, 1) < "e"))


@query("batch_sizes", f"WITH {POOL}, b AS (SELECT doc_id, count(*) AS n FROM pool GROUP BY 1) SELECT CAST(sum(ceil(n / 15.0)) AS BIGINT) AS n_batches, CAST(sum(n) AS BIGINT) AS n_sentences FROM b")
def batch_sizes(s, sf):
    b = pool(s, sf).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return b.agg(F.sum(F.ceil(F.col("n") / float(labeling.BATCH)).cast("bigint")).alias("n_batches"), F.sum("n").alias("n_sentences"))


# -- roll-up ---------------------------------------------------------------------------------------------------------
DOC = LABELED + f""", agg AS (SELECT doc_id, CAST(count(*) AS INTEGER) AS n_sentences, {", ".join(f"round(avg({c}), 6) AS {c}_score" for c in FRAMES)}, round(avg(CASE WHEN {_ANY} = 0 THEN 1.0 ELSE 0.0 END), 6) AS none_pct FROM lab GROUP BY 1),
scored AS (SELECT e.doc_id, e.actor, e.actor_type, e.positioning, e.context, e.platform, e.post_chatgpt, coalesce(n_sentences, 0) AS n_sentences, {", ".join(SCORES)}, none_pct FROM enriched e LEFT JOIN agg USING (doc_id))"""


def scored(s, sf) -> DataFrame:
    docs = enriched(s, sf)
    meta = docs.select("doc_id", "actor", "actor_type", "positioning", "context", "platform", "post_chatgpt")
    return rollup.doc_scores(meta, labeled(s, sf, docs))


@query("doc_scores", f"WITH {DOC} SELECT doc_id, context, n_sentences, {', '.join(SCORES)}, none_pct FROM scored")
def doc_scores(s, sf):
    return scored(s, sf).select("doc_id", "context", "n_sentences", *SCORES, "none_pct")


@query("context_means", f"WITH {DOC} SELECT context, count(*) AS n_docs, {', '.join(f'round(avg({c}), 6) AS {c}' for c in SCORES)} FROM scored GROUP BY 1")
def context_means(s, sf):
    return rollup.context_means(scored(s, sf))


LD = "ld AS (SELECT DISTINCT ON (doc_id) * FROM labeled_documents ORDER BY doc_id)"


def documents_once(s, sf) -> DataFrame:
    return table(s, sf, "labeled_documents").drop("labeled_at").dropDuplicates(["doc_id"])


@query("score_range_check", f"WITH {LD} " + " UNION ALL ".join(f"SELECT '{c}' AS score, coalesce(bool_and({c} BETWEEN 0 AND 1), true) AS ok FROM ld" for c in [*SCORES, "none_pct"]))
def score_range_check(s, sf):
    return rollup.in_range(documents_once(s, sf))


ANALYSIS = LD + f", ad AS (SELECT * FROM ld WHERE n_sentences >= {LEAST_DOC} AND actor IN (SELECT actor FROM dim_actor))"


def analysis(s, sf) -> DataFrame:
    known = table(s, sf, "dim_actor").select("actor")
    return documents_once(s, sf).where(F.col("n_sentences") >= LEAST_DOC).join(known, "actor", "left_semi")


@query("analysis_dataset", f"WITH {ANALYSIS} SELECT doc_id, actor, context, n_sentences, innovation_score, risk_score, regulation_score FROM ad")
def analysis_dataset(s, sf):
    return analysis(s, sf).select("doc_id", "actor", "context", "n_sentences", "innovation_score", "risk_score", "regulation_score")


@query("top5_docs", f"WITH {LD} SELECT doc_id, risk_score, n_sentences FROM ld WHERE n_sentences > 0 AND risk_score IS NOT NULL ORDER BY risk_score DESC, doc_id LIMIT 5")
def top5_docs(s, sf):
    return rollup.top_docs(documents_once(s, sf), "risk_score")


@query("top_actor", f"WITH {LD}, n AS (SELECT context, actor, count(*) AS n FROM ld WHERE actor IS NOT NULL AND context IS NOT NULL GROUP BY ALL) SELECT context, actor AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY n DESC, actor) AS r FROM n) WHERE r = 1")
def top_actor(s, sf):
    return rollup.mode(documents_once(s, sf).where("context is not null"), "context", "actor")


_SUB = list(labeling.SUBCLASSES)


@query("subclass_pct", f"WITH {LD} SELECT actor, count(*) AS n, {', '.join(f'''round(avg(CASE WHEN innovation_subcategory_dominant = '{c}' THEN 1.0 ELSE 0.0 END) * 100, 1) AS {c.lower()}_pct''' for c in _SUB)} FROM ld WHERE innovation_subcategory_dominant IS NOT NULL GROUP BY 1")
def subclass_pct(s, sf):
    return rollup.category_pct(documents_once(s, sf), "actor", "innovation_subcategory_dominant", _SUB)


@query("subclass_mode", f"WITH {LD}, n AS (SELECT actor, innovation_subcategory_dominant AS v, count(*) AS n FROM ld WHERE innovation_subcategory_dominant IS NOT NULL GROUP BY ALL) SELECT actor, v AS dominant, n FROM (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY n DESC, v) AS r FROM n) WHERE r = 1")
def subclass_mode(s, sf):
    return rollup.mode(documents_once(s, sf), "actor", "innovation_subcategory_dominant")


@query("none_rate_by_actor", f"WITH {LD} SELECT actor, count(*) AS n_docs, round(avg(none_pct), 6) AS none_rate FROM ld WHERE n_sentences > 0 GROUP BY 1")
def none_rate_by_actor(s, sf):
    return documents_once(s, sf).where("n_sentences > 0").groupBy("actor").agg(F.count(F.lit(1)).alias("n_docs"), F.round(F.avg("none_pct"), 6).alias("none_rate"))


# -- agreement -------------------------------------------------------------------------------------------------------
def long_table(s, sf) -> DataFrame:
    return agreement.stack(both(s, sf), LABELS, ["sentence_id"])


KAPPA = BOTH + """, k AS (SELECT label, count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(a) AS pa, avg(b) AS pb FROM lng GROUP BY 1),
kap AS (SELECT label, n, round(po * 100, 4) AS agreement_pct, CASE WHEN abs(1 - (pa * pb + (1 - pa) * (1 - pb))) < 1e-12 THEN NULL ELSE round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) END AS kappa FROM k)"""


@query("kappa_by_label", f"WITH {KAPPA} SELECT * FROM kap")
def kappa_by_label(s, sf):
    return agreement.kappa(long_table(s, sf))


@query("kappa_overall", f"""WITH {KAPPA}, m AS (SELECT round(avg(kappa), 6) AS kappa FROM kap), p AS (SELECT round(avg(CAST(a = b AS INTEGER)) * 100, 4) AS agreement_pct FROM lng)
SELECT kappa, agreement_pct, CASE WHEN kappa IS NULL THEN 'INCONCLUSIVE' WHEN kappa >= {S.KAPPA_GATE} THEN 'PASS' ELSE 'FAIL' END AS gate FROM m, p""")
def kappa_overall(s, sf):
    return agreement.kappa_overall(long_table(s, sf))


_PARTS = ", ".join(f"CASE WHEN {a} <> {b} THEN '{f}: A=' || {a} || ' B=' || {b} END" for f, (a, b) in LABELS.items())


@query("disagreements", f"WITH {BOTH}, d AS (SELECT sentence_id, actor, context, substr(sentence_text, 1, 200) AS sentence_text, list_filter([{_PARTS}], lambda x: x IS NOT NULL) AS p FROM both_) SELECT sentence_id, actor, context, sentence_text, array_to_string(p, '; ') AS disagreements, CAST(len(p) AS INTEGER) AS n_disagreements FROM d WHERE len(p) > 0")
def disagreements(s, sf):
    return agreement.disagreements(both(s, sf), LABELS, ["sentence_id", "actor", "context"], "sentence_text")


PRF = BOTH + """, c AS (SELECT label, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) FILTER (a = 0 AND b = 0) AS tn FROM lng GROUP BY 1),
prf AS (SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1,
  round(coalesce((tp + tn) / nullif(tp + fp + fn + tn, 0), 0), 6) AS accuracy, tp + fn AS human_positive, tp + fp AS llm_positive, tp + fp + fn + tn AS n FROM c)"""


@query("prf_by_label", f"WITH {PRF} SELECT * FROM prf")
def prf_by_label(s, sf):
    return agreement.prf(long_table(s, sf))


@query("prf_macro", f"""WITH {PRF} SELECT round(avg("precision"), 6) AS "precision", round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1, round(avg(accuracy), 6) AS accuracy, CASE WHEN round(avg(f1), 6) >= {S.F1_GATE} THEN 'PASS' ELSE 'FAIL' END AS verdict FROM prf WHERE label <> 'None'""")
def prf_macro(s, sf):
    return agreement.macro(agreement.prf(long_table(s, sf)).where("label <> 'None'"))


@query("fn_fp", f"WITH {PRF} SELECT label, fn, fp FROM c")
def fn_fp(s, sf):
    return agreement.confusion(long_table(s, sf)).select("label", "fn", "fp")


COMPARE = PRF + """, c2 AS (SELECT label, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 1 AND b = 0) AS fp, count(*) FILTER (a = 0 AND b = 1) AS fn FROM lng GROUP BY 1),
p2 AS (SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c2)"""


@query("model_compare", f"""WITH {COMPARE} SELECT label, prf."precision" AS precision_base, p2."precision" AS precision_other, prf.recall AS recall_base, p2.recall AS recall_other, prf.f1 AS f1_base, p2.f1 AS f1_other, prf."precision" > prf.recall AND p2."precision" > p2.recall AS robust FROM prf JOIN p2 USING (label)""")
def model_compare(s, sf):
    long = cut(long_table(s, sf).groupBy("label", "a", "b").count())  # at most four rows a label
    def score(a: str, b: str) -> DataFrame:
        n = lambda x, y: F.coalesce(F.sum(F.when((F.col(a) == x) & (F.col(b) == y), F.col("count"))), F.lit(0))
        c = long.groupBy("label").agg(n(1, 1).alias("tp"), n(0, 1).alias("fp"), n(1, 0).alias("fn"))
        z = lambda num, den: F.round(F.coalesce(F.try_divide(num, den), F.lit(0.0)), 6)
        tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
        return c.select("label", z(tp, tp + fp).alias("precision"), z(tp, tp + fn).alias("recall"), z(2 * tp, 2 * tp + fp + fn).alias("f1"))
    return agreement.compare(score("a", "b"), score("b", "a"))


@query("recall_by_context", f"WITH {BOTH} SELECT context, CAST(sum(innovation_a) AS BIGINT) AS n_true, round(sum(innovation_a * innovation_b) / nullif(sum(innovation_a), 0), 6) AS recall FROM both_ GROUP BY 1")
def recall_by_context(s, sf):
    b = both(s, sf).groupBy("context").agg(F.sum("innovation_a").alias("n_true"), F.sum(F.col("innovation_a") * F.col("innovation_b")).alias("hit"))
    return b.select("context", "n_true", F.round(F.try_divide("hit", "n_true"), 6).alias("recall"))


@query("sheet_bits", "SELECT v, coalesce(CAST(trunc(TRY_CAST(trim(v) AS DOUBLE)) AS INTEGER), 0) AS whole, CASE WHEN coalesce(TRY_CAST(trim(v) AS DOUBLE), 0) >= 0.5 THEN 1 ELSE 0 END AS half FROM (SELECT DISTINCT regexp_extract(props, ':\\s*([^}]*)', 1) AS v FROM events)")
def sheet_bits(s, sf):
    v = table(s, sf, "events").select(F.regexp_extract("props", r":\s*([^}]*)", 1).alias("v")).distinct()
    return v.select("v", text.to_bit("v").alias("whole"), text.to_bit_half("v").alias("half"))


# -- statistics ------------------------------------------------------------------------------------------------------
def _variance_sql(y: str) -> str:
    return f"""WITH {ANALYSIS}, cell AS (SELECT actor, actor_type, context, count(*) AS n, avg({y}) AS m FROM ad WHERE {y} IS NOT NULL AND context IS NOT NULL GROUP BY ALL HAVING count(*) >= {LEAST_CELL}),
v AS (SELECT actor, actor_type, count(*) AS n_contexts, {", ".join(f"round(max(m) FILTER (context = '{c}'), 6) AS mean_{c}" for c in S.CONTEXTS)}, round(stddev_samp(m), 6) AS cross_context_std, CAST(sum(n) AS BIGINT) AS n_docs, CAST(actor_type = 'individual' AS INTEGER) AS is_individual FROM cell GROUP BY ALL HAVING count(*) >= 2)"""


@query("cross_context_std", _variance_sql("innovation_score") + " SELECT * FROM v")
def cross_context_std(s, sf):
    return statistics.cross_context(analysis(s, sf).where("context is not null"), "innovation_score", S.CONTEXTS, LEAST_CELL)


@query("welch_t", _variance_sql("innovation_score") + """, g AS (SELECT count(*) FILTER (is_individual = 1) AS n1, count(*) FILTER (is_individual = 0) AS n0, avg(cross_context_std) FILTER (is_individual = 1) AS m1, avg(cross_context_std) FILTER (is_individual = 0) AS m0,
 var_samp(cross_context_std) FILTER (is_individual = 1) AS v1, var_samp(cross_context_std) FILTER (is_individual = 0) AS v0 FROM v)
SELECT n1, n0, round(m1, 6) AS mean_1, round(m0, 6) AS mean_0, CASE WHEN n1 >= 2 AND n0 >= 2 AND v1 / n1 + v0 / n0 > 0 THEN round((m1 - m0) / sqrt(v1 / n1 + v0 / n0), 6) END AS t,
 CASE WHEN n1 >= 2 AND n0 >= 2 AND v1 / n1 + v0 / n0 > 0 THEN round(pow(v1 / n1 + v0 / n0, 2) / (pow(v1 / n1, 2) / (n1 - 1) + pow(v0 / n0, 2) / (n0 - 1)), 6) END AS df FROM g""")
def welch_t(s, sf):
    return statistics.welch(cross_context_std(s, sf), "cross_context_std", "is_individual")


def _rows(s, table_rows) -> DataFrame:
    r = lambda x: None if x is None else round(x, 6)
    return s.createDataFrame([(t, *map(r, v), a, statistics.stars(v[3])) for t, *v, a in table_rows], "term string, coef double, se double, t double, p double, low double, high double, aliased boolean, stars string")


def m1(s, sf, y: str = "regulation_score"):
    return statistics.fit(analysis(s, sf).withColumn("post_chatgpt", F.col("post_chatgpt").cast("int")), y, ["context", "post_chatgpt"], numeric=("post_chatgpt",))


def _m1_sql(y: str) -> str:
    """Model 1 by the within-context slope."""
    return f"""WITH {ANALYSIS}, d AS (SELECT context, CAST(post_chatgpt AS DOUBLE) AS x, {y} AS y FROM ad WHERE context IS NOT NULL AND post_chatgpt IS NOT NULL AND {y} IS NOT NULL),
g AS (SELECT context, avg(x) AS mx, avg(y) AS my, count(*) AS n, sum(x * y) - count(*) * avg(x) * avg(y) AS sxy, sum(x * x) - count(*) * avg(x) * avg(x) AS sxx FROM d GROUP BY 1),
b AS (SELECT sum(sxy) / sum(sxx) AS b FROM g), i AS (SELECT context, my - b * mx AS a FROM g, b)"""


_M1 = _m1_sql("regulation_score")


@query("m1_coef", _M1 + """ SELECT 'Intercept' AS term, round(a, 6) AS coef FROM i WHERE context = 'commercial' UNION ALL SELECT 'context[' || context || ']', round(a - (SELECT a FROM i WHERE context = 'commercial'), 6) FROM i WHERE context <> 'commercial' UNION ALL SELECT 'post_chatgpt', round(b, 6) FROM b""")
def m1_coef(s, sf):
    return _rows(s, m1(s, sf).table()).select("term", "coef")


#: The density of Student's t with v degrees, its two-sided tail by Simpson's rule, and the upper tail of F.
_DENSITY = "exp(lgamma((v + 1) / 2.0) - lgamma(v / 2.0)) / sqrt(v * pi()) * pow(1 + {u} * {u} / v, -(v + 1) / 2.0)"
_TAIL = f"greatest(0.0, (SELECT 1 - 2 * sum((CASE WHEN k IN (0, 2000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * {_DENSITY.format(u='(k * abs(t) / 2000)')}) * abs(t) / 6000 FROM range(0, 2001) AS r(k)))"
_F_TAIL = """least(1.0, (SELECT sum((CASE WHEN k IN (0, 20000) THEN 1 WHEN k % 2 = 1 THEN 4 ELSE 2 END) * 2 * exp(lgamma((d1 + d2) / 2.0) - lgamma(d1 / 2.0) - lgamma(d2 / 2.0)) * pow(1 - s * s, d2 / 2.0 - 1) * pow(s, d1 - 1)) * (1 - sqrt(1 - x)) / 60000 FROM (SELECT k, least(1.0, sqrt(1 - x) + k * (1 - sqrt(1 - x)) / 20000) AS s FROM range(0, 20001) AS r(k))))"""


def _m1_errors(y: str) -> str:
    """CTE ``e`` (term, coef, se) of model 1, and ``s`` with its error variance."""
    return _m1_sql(y) + """, f AS (SELECT d.context, x, y, a + b.b * x AS fit FROM d JOIN i USING (context), b), s AS (SELECT sum((y - fit) * (y - fit)) / (count(*) - (SELECT count(*) FROM g) - 1) AS s2, count(*) AS n, count(*) - (SELECT count(*) FROM g) - 1 AS v FROM f),
w AS (SELECT sum(sxx) AS w FROM g), r AS (SELECT * FROM g WHERE context = 'commercial'), ra AS (SELECT a AS ra FROM i WHERE context = 'commercial'),
e AS (SELECT 'Intercept' AS term, ra AS coef, sqrt(s2 * (1.0 / r.n + r.mx * r.mx / w)) AS se FROM s, w, r, ra
  UNION ALL SELECT 'context[' || g.context || ']', i.a - ra, sqrt(s2 * (1.0 / g.n + 1.0 / r.n + (g.mx - r.mx) * (g.mx - r.mx) / w)) FROM g JOIN i USING (context), s, w, r, ra WHERE g.context <> 'commercial' UNION ALL SELECT 'post_chatgpt', b.b, sqrt(s2 / w) FROM b, s, w)"""


_INFERENCE = _m1_errors("regulation_score") + f""", t AS (SELECT term, coef, se, coef / se AS t, CAST(v AS DOUBLE) AS v FROM e, s), p AS (SELECT *, {_TAIL} AS p FROM t), z AS (SELECT term, coef, se, t, v, p, CASE WHEN p >= 0.05 THEN '' WHEN p < 0.001 THEN '***' WHEN p < 0.01 THEN '**' ELSE '*' END AS stars FROM p)"""


@query("m1_inference", _INFERENCE + f""", grid AS (SELECT u, 0.5 + (sum(d) OVER (ORDER BY u ROWS UNBOUNDED PRECEDING) - d / 2 - first_value(d) OVER (ORDER BY u) / 2) * 0.00002 AS cdf FROM (SELECT k * 0.00002 AS u, {_DENSITY.format(u='(k * 0.00002)')} AS d FROM range(0, 200001) AS r(k), (SELECT CAST(v AS DOUBLE) AS v FROM s))), q AS (SELECT min(u) AS q FROM grid WHERE cdf >= 0.975)
SELECT term, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 6) AS t, round(p, 6) AS p, round(coef - q * se, 6) AS low, round(coef + q * se, 6) AS high, false AS aliased, stars FROM z, q""")
def m1_inference(s, sf):
    return _rows(s, m1(s, sf).table())


OUTCOMES = ("risk_score", "innovation_score", "regulation_score")


@query("m1_fit", " UNION ALL ".join(f"""SELECT * FROM ({_m1_errors(y)}, q AS (SELECT count(*) AS n, sum((y - fit) * (y - fit)) AS sse, sum(y * y) - count(*) * avg(y) * avg(y) AS sst, (SELECT count(*) FROM g) AS d1 FROM f), h AS (SELECT n, sse / sst AS u, d1, n - d1 - 1 AS d2, (sst - sse) / d1 / (sse / (n - d1 - 1)) AS f FROM q),
x AS (SELECT *, d2 / (d2 + d1 * f) AS x FROM h) SELECT '{y}' AS outcome, round(1 - u, 6) AS r2, round(1 - u * (n - 1) / d2, 6) AS adj_r2, round(f, 4) AS f, round({_F_TAIL}, 6) AS p, CAST(n AS INTEGER) AS n FROM x)""" for y in OUTCOMES))
def m1_fit(s, sf):
    d = analysis(s, sf).withColumn("post_chatgpt", F.col("post_chatgpt").cast("int"))
    factors, out = ["context", "post_chatgpt"], []
    for y, rows in statistics.cells_of(d, list(OUTCOMES), factors).items():
        r2, adj, f, p, n = statistics.fit_cells(rows, factors, numeric=("post_chatgpt",)).summary()
        out.append((y, round(float(r2), 6), round(float(adj), 6), round(float(f), 4), round(float(p), 6), n))
    return s.createDataFrame(out, "outcome string, r2 double, adj_r2 double, f double, p double, n int")


M2_LEAST = 10


def m2(s, sf):
    d = statistics.qualifying_cells(analysis(s, sf).where("context is not null and innovation_score is not null"), M2_LEAST)
    return statistics.fit(d, "innovation_score", ["actor", "context"], interactions=[("actor", "context")])


_M2 = f"""WITH {ANALYSIS}, ok AS (SELECT actor, context, innovation_score AS y FROM ad WHERE context IS NOT NULL AND innovation_score IS NOT NULL),
n AS (SELECT actor, context, count(*) AS n, avg(y) AS m FROM ok GROUP BY ALL HAVING count(*) >= {M2_LEAST}), q AS (SELECT * FROM n WHERE actor IN (SELECT actor FROM n GROUP BY 1 HAVING count(*) >= 2))"""


@query("m2_cells", _M2 + " SELECT actor, context, n, round(m, 6) AS fitted FROM q")
def m2_cells(s, sf):
    """Fitted cell means: with all interactions the model is saturated, so they are the cells' means."""
    f = m2(s, sf)
    beta = {t: (0.0 if b != b else float(b)) for t, b in zip(f.terms, f.beta)}
    d = statistics.qualifying_cells(analysis(s, sf).where("context is not null and innovation_score is not null"), M2_LEAST)
    out = [
        (a, c, n, round(beta["Intercept"] + beta.get(f"actor[{a}]", 0.0) + beta.get(f"context[{c}]", 0.0) + beta.get(f"actor[{a}]:context[{c}]", 0.0), 6))
        for a, c, n, _, _ in statistics.cells(d, "innovation_score", ["actor", "context"])
    ]
    return s.createDataFrame(out, "actor string, context string, n bigint, fitted double")


@query("m2_coef")
def m2_coef(s, sf):
    return _rows(s, m2(s, sf).table())


@query("m2_ftest", _M2 + f""", y AS (SELECT ok.* FROM ok SEMI JOIN q ON ok.actor = q.actor AND ok.context = q.context), a AS (SELECT actor, sum(n) AS nn, sum(n * m) / sum(n) AS my, coalesce(sum(n) FILTER (context = 'policy'), 0) AS p, coalesce(sum(n) FILTER (context = 'public'), 0) AS u, coalesce(sum(n * m) FILTER (context = 'policy'), 0) AS yp, coalesce(sum(n * m) FILTER (context = 'public'), 0) AS yu FROM q GROUP BY 1),
w AS (SELECT sum(p - p * p / nn) AS s11, sum(u - u * u / nn) AS s22, -sum(p * u / nn) AS s12, sum(yp - p * my) AS y1, sum(yu - u * my) AS y2, sum(nn * my * my) AS base, count(*) AS actors, sum(nn) AS n FROM a),
e AS (SELECT n, (SELECT count(*) FROM q) AS cells, actors, (SELECT sum(y * y) FROM y) - (SELECT sum(n * m * m) FROM q) AS sse, (SELECT sum(y * y) FROM y) - base - (y1 * (s22 * y1 - s12 * y2) + y2 * (s11 * y2 - s12 * y1)) / (s11 * s22 - s12 * s12) AS additive FROM w),
h AS (SELECT cells - actors - 2 AS d1, n - cells AS d2, (additive - sse) / (cells - actors - 2) / (sse / (n - cells)) AS f FROM e), x AS (SELECT *, d2 / (d2 + d1 * f) AS x FROM h)
SELECT round(f, 4) AS f, CAST(d1 AS INTEGER) AS df_num, CAST(d2 AS INTEGER) AS df_den, round({_F_TAIL}, 6) AS p FROM x""")
def m2_ftest(s, sf):
    f = m2(s, sf)
    stat, q, p = statistics.wald(f, [i for i, t in enumerate(f.terms) if ":" in t])
    return s.createDataFrame([(round(float(stat), 4), q, f.n - f.rank, round(float(p), 6))], "f double, df_num int, df_den int, p double")


@query("m3_coef")
def m3_coef(s, sf):
    d = analysis(s, sf).withColumn("post_chatgpt", F.col("post_chatgpt").cast("int"))
    f = statistics.fit(d, "regulation_score", ["actor_type", "context", "positioning", "platform", "post_chatgpt"], numeric=("post_chatgpt",))
    return _rows(s, f.table())


@query("recall_by_positioning", f"WITH {BOTH}, d AS (SELECT actor, min(positioning) AS positioning FROM enriched GROUP BY 1) SELECT positioning, CAST(sum(innovation_a) AS BIGINT) AS n_true, round(sum(innovation_a * innovation_b) / nullif(sum(innovation_a), 0), 6) AS recall FROM both_ JOIN d USING (actor) GROUP BY 1")
def recall_by_positioning(s, sf):
    from ..operators.corpus import dimension

    d = dimension(table(s, sf, "dim_actor")).select("actor", "positioning")
    b = both(s, sf).join(small(d), "actor").groupBy("positioning").agg(F.sum("innovation_a").alias("n_true"), F.sum(F.col("innovation_a") * F.col("innovation_b")).alias("hit"))
    return b.select("positioning", "n_true", F.round(F.try_divide("hit", "n_true"), 6).alias("recall"))


_REFIT = _m1_sql("least(innovation_score / CASE context WHEN 'commercial' THEN 0.8 WHEN 'policy' THEN 0.7 ELSE 0.9 END, 1.0)")


@query("recall_refit", _REFIT + """ SELECT 'Intercept' AS term, round(a, 6) AS coef FROM i WHERE context = 'commercial' UNION ALL SELECT 'context[' || context || ']', round(a - (SELECT a FROM i WHERE context = 'commercial'), 6) FROM i WHERE context <> 'commercial' UNION ALL SELECT 'post_chatgpt', round(b, 6) FROM b""")
def recall_refit(s, sf):
    """Model 1 on scores corrected by the recall of their context."""
    recall = F.when(F.col("context") == "commercial", 0.8).when(F.col("context") == "policy", 0.7).otherwise(0.9)
    d = analysis(s, sf).where("context is not null").withColumn("corrected", F.least(F.col("innovation_score") / recall, F.lit(1.0))).withColumn("post_chatgpt", F.col("post_chatgpt").cast("int"))
    return _rows(s, statistics.fit(d, "corrected", ["context", "post_chatgpt"], numeric=("post_chatgpt",)).table()).select("term", "coef")


@query("recall_corrected", f"WITH {LD} SELECT context, count(*) AS n, round(avg(least(innovation_score / 0.8, 1.0)), 6) AS corrected FROM ld WHERE innovation_score IS NOT NULL GROUP BY 1")
def recall_corrected(s, sf):
    d = documents_once(s, sf).where("innovation_score is not null")
    return d.groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.least(F.col("innovation_score") / 0.8, F.lit(1.0))), 6).alias("corrected"))


# -- pages -----------------------------------------------------------------------------------------------------------
PAGE = """pages AS (SELECT doc_id, 'https://www.' || source || '/archive/2024/03/' || lpad(CAST(doc_id % 28 + 1 AS VARCHAR), 2, '0') || '/item-' || doc_id AS url,
 '<html><head><title> Item ' || doc_id || ' </title></head><body><nav><a href="/home?x=1">Home</a></nav><article><p>Record ' || doc_id || ' of ' || source || '</p><a class="n" href="item-' || (doc_id + 1) || '#top">next</a> <a href="http://' || source || '/topics/">topics</a></article></body></html>' AS html FROM documents)"""


def pages(s, sf) -> DataFrame:
    """A page per document, built from its id and source."""
    d = table(s, sf, "documents")
    i, src = F.col("doc_id").cast("string"), F.col("source")
    url = F.concat(F.lit("https://www."), src, F.lit("/archive/2024/03/"), F.lpad((F.col("doc_id") % 28 + 1).cast("string"), 2, "0"), F.lit("/item-"), i)
    body = F.concat(
        F.lit("<html><head><title> Item "), i, F.lit(' </title></head><body><nav><a href="/home?x=1">Home</a></nav><article><p>Record '), i, F.lit(" of "), src,
        F.lit('</p><a class="n" href="item-'), (F.col("doc_id") + 1).cast("string"), F.lit('#top">next</a> <a href="http://'), src, F.lit('/topics/">topics</a></article></body></html>'),
    )
    return d.select("doc_id", url.alias("url"), body.alias("html"))


@query("page_links", f"""WITH {PAGE}, h AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages), b AS (SELECT url, regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') AS b FROM h)
SELECT DISTINCT url, regexp_replace(CASE WHEN regexp_matches(b, '^https?://') THEN b WHEN b LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || b ELSE regexp_replace(url, '/[^/]*$', '') || '/' || b END, '^http://', 'https://') AS link FROM b""")
def page_links(s, sf):
    return html.links(pages(s, sf))


@query("page_titles", f"WITH {PAGE} SELECT doc_id, trim(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)) AS title, substr(md5(url), 1, 12) AS key, regexp_replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '^www\\.', '') AS host, regexp_extract(url, '(\\d{{4}})/(\\d{{2}})/(\\d{{2}})', 0) AS path FROM pages")
def page_titles(s, sf):
    p = pages(s, sf)
    return p.select("doc_id", html.title("html").alias("title"), text.key12("url").alias("key"), html.host("url").alias("host"), F.translate(html.page_date("html", "url"), "-", "/").alias("path"))


@query("page_text", f"WITH {PAGE} SELECT doc_id, regexp_extract(html, '<p>(.*?)</p>', 1) || ' next topics' AS main FROM pages")
def page_text(s, sf):
    return pages(s, sf).select("doc_id", html.main_text("html").alias("main"))


@query("host_blocklist", f"WITH {PAGE} SELECT regexp_replace(regexp_extract(url, '^[a-z]+://([^/]+)', 1), '^www\\.', '') LIKE '%aurelith.example' AS blocked, count(*) AS n FROM pages GROUP BY 1")
def host_blocklist(s, sf):
    return pages(s, sf).groupBy(html.blocked(F.col("url"), ["aurelith.example"]).alias("blocked")).agg(F.count(F.lit(1)).alias("n"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS BIGINT) AS k, count(*) AS n FROM events GROUP BY 1")
def json_props(s, sf):
    e = table(s, sf, "events").select("event_type", F.from_json("props", "k bigint").alias("p"))
    return e.groupBy("event_type").agg(F.sum("p.k").alias("k"), F.count(F.lit(1)).alias("n"))


# -- streams ---------------------------------------------------------------------------------------------------------
def _events(s, sf) -> DataFrame:
    path = f"{sf}/events.parquet"
    return pipelines.read_parquet_stream(s, path, T.StructType(s.read.parquet(path).schema.fields))


@query("stream_event_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_event_windows(s, sf):
    w = pipelines.drain(pipelines.event_windows(_events(s, sf).withColumn("ts", F.col("ts").cast("timestamp"))))
    return w.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("event_sessions", """WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
 s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(s, sf):
    return pipelines.sessions(table(s, sf, "events"))
