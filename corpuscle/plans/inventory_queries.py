"""Smaller operators of the inventory: dispatch, inference, ranges, summaries, ordered lists, batches."""
from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import text
from ..operators import corpus as C
from ..operators import labeling, statistics
from ..session import small, table
from .analysis_queries import _INFERENCE, BOTH, LD, SCORES, _rows, both, documents_once, m1
from .corpus_queries import ENRICHED, POOL, enriched, pool

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


#: Ordered registry: the first pattern found in a source names its channel; longer patterns stand first.
REGISTRY = [("transcripts.", "transcript"), ("/news", "news"), ("blog.", "blog"), ("press", "press"), (".example", "site")]
_REG = ", ".join(f"({i}, '{p}', '{c}')" for i, (p, c) in enumerate(REGISTRY))


@query("slug_dispatch", f"""WITH reg(o, p, c) AS (VALUES {_REG}), s AS (SELECT DISTINCT source FROM documents), m AS (SELECT source, arg_min(c, o) AS channel FROM s JOIN reg ON contains(lower(source), p) GROUP BY 1)
SELECT source, coalesce(channel, 'unknown') AS channel FROM s LEFT JOIN m USING (source)""")
def slug_dispatch(s, sf):
    out = F.lit("unknown")
    for p, c in reversed(REGISTRY):
        out = F.when(F.contains(F.lower("source"), F.lit(p)), c).otherwise(out)
    return table(s, sf, "documents").select("source").distinct().select("source", out.alias("channel"))


@query("platform_inferred", "SELECT CASE WHEN regexp_matches(split_part(text, chr(10), 1), '(?i)(speech|keynote|address|remarks)') THEN 'speech' ELSE 'interview' END AS inferred, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
def platform_inferred(s, sf):
    first = F.substring_index("text", "\n", 1)
    kind = F.when(text.rlike(first, "(speech|keynote|address|remarks)"), "speech").otherwise("interview")
    return table(s, sf, "documents").where("text is not null").groupBy(kind.alias("inferred")).agg(F.count(F.lit(1)).alias("n"))


@query("name_part_mentions", f"""WITH {ENRICHED} SELECT actor, count(*) AS n_docs, count(*) FILTER (len(list_filter(string_split(lower(actor), ' '), lambda p: contains(lower(split_part(text, chr(10), 1)), p))) > 0) AS mentioned FROM enriched GROUP BY 1""")
def name_part_mentions(s, sf):
    first = F.lower(F.substring_index("text", "\n", 1))
    hit = F.exists(F.split(F.lower("actor"), " "), lambda p: F.contains(first, p))
    return enriched(s, sf).groupBy("actor").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(hit).alias("mentioned"))


@query("year_range", f"""WITH {ENRICHED} SELECT substr("date", 1, 4) AS year, count(*) AS n FROM enriched WHERE "date" BETWEEN '2021' AND '2023-12-31' AND regexp_matches("date", '^[0-9]{{4}}-') GROUP BY 1""")
def year_range(s, sf):
    e = enriched(s, sf).where(F.col("date").between("2021", "2023-12-31") & F.col("date").rlike("^[0-9]{4}-"))
    return e.groupBy(F.substring("date", 1, 4).alias("year")).agg(F.count(F.lit(1)).alias("n"))


@query("keyword_allowlist", f"""WITH {ENRICHED}, k AS (SELECT * FROM (VALUES ('company', 'compute'), ('company', 'investment'), ('individual', 'risk'), ('policymaker', 'regulation'), ('policymaker', 'oversight')) AS t(actor_type, term))
SELECT actor_type, count(DISTINCT doc_id) AS n FROM enriched JOIN k USING (actor_type) WHERE contains(lower(text), term) GROUP BY 1""")
def keyword_allowlist(s, sf):
    words = {"company": ["compute", "investment"], "individual": ["risk"], "policymaker": ["regulation", "oversight"]}
    rows = s.createDataFrame(list(words.items()), "actor_type string, terms array<string>")
    low = F.lower("text")
    hit = enriched(s, sf).join(small(rows), "actor_type").where(F.exists("terms", lambda t: F.contains(low, t)))
    return hit.groupBy("actor_type").agg(F.count(F.lit(1)).alias("n"))


@query("batch_ids", f"WITH {POOL} SELECT doc_id, CAST((rn - 1) // {labeling.BATCH} AS BIGINT) AS batch, count(*) AS n FROM (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS rn FROM pool) GROUP BY ALL")
def batch_ids(s, sf):
    from pyspark.sql.window import Window as W

    rn = F.row_number().over(W.partitionBy("doc_id").orderBy("pos"))
    b = pool(s, sf).select("doc_id", F.floor((rn - 1) / labeling.BATCH).alias("batch"))
    return b.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("n"))


@query("first_seen", f"WITH {POOL} SELECT doc_id, CAST(min(pos) AS BIGINT) AS first_pos, count(*) AS n FROM pool GROUP BY 1")
def first_seen(s, sf):
    return pool(s, sf).groupBy("doc_id").agg(F.min("pos").cast("bigint").alias("first_pos"), F.count(F.lit(1)).alias("n"))


@query("contexts_per_actor", f"WITH {LD} SELECT actor, count(DISTINCT context) AS n_contexts, array_to_string(list_sort(list(DISTINCT context)), '|') AS contexts, count(*) AS n_docs FROM ld WHERE context IS NOT NULL GROUP BY 1")
def contexts_per_actor(s, sf):
    d = documents_once(s, sf).where("context is not null")
    return d.groupBy("actor").agg(F.countDistinct("context").alias("n_contexts"), F.array_join(F.array_sort(F.collect_set("context")), "|").alias("contexts"), F.count(F.lit(1)).alias("n_docs"))


@query("score_summary", f"WITH {LD} " + " UNION ALL ".join(f"SELECT '{c}' AS score, count({c}) AS n, round(avg({c}), 6) AS mean, min({c}) AS low, max({c}) AS high FROM ld" for c in SCORES))
def score_summary(s, sf):
    long = documents_once(s, sf).select(F.expr(f"stack({len(SCORES)}, " + ", ".join(f"'{c}', {c}" for c in SCORES) + ") AS (score, v)"))
    return long.groupBy("score").agg(F.count("v").alias("n"), F.round(F.avg("v"), 6).alias("mean"), F.min("v").alias("low"), F.max("v").alias("high"))


@query("label_totals", f"WITH {BOTH} SELECT CAST(sum(a) AS BIGINT) AS total_a, CAST(sum(b) AS BIGINT) AS total_b, count(*) AS n FROM lng")
def label_totals(s, sf):
    cols = [*S.FRAME_COLUMNS.values(), "none"]
    t = lambda x: F.sum(sum((F.col(f"{c}_{x}") for c in cols[1:]), F.col(f"{cols[0]}_{x}")))
    return both(s, sf).agg(t("a").alias("total_a"), t("b").alias("total_b"), (F.count(F.lit(1)) * len(cols)).alias("n"))


@query("labeled_platform_pivot", f"WITH {LD} SELECT platform, " + ", ".join(f"count(*) FILTER (context = '{c}') AS {c}" for c in S.CONTEXTS) + f", count(*) FILTER (context IN ({', '.join(repr(c) for c in S.CONTEXTS)})) AS total FROM ld GROUP BY 1")
def labeled_platform_pivot(s, sf):
    return C.pivot(documents_once(s, sf), "platform", "context", S.CONTEXTS)


@query("unmatched_ids", "WITH c AS (SELECT DISTINCT doc_id FROM corpus), l AS (SELECT DISTINCT doc_id FROM labeled_documents) SELECT count(*) FILTER (l.doc_id IS NULL) AS only_corpus, count(*) FILTER (c.doc_id IS NULL) AS only_labeled, count(*) FILTER (c.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS both_sides FROM c FULL JOIN l ON c.doc_id = l.doc_id")
def unmatched_ids(s, sf):
    c, l = (table(s, sf, t).select("doc_id").distinct().withColumn(f"_{t}", F.lit(1)) for t in ("corpus", "labeled_documents"))  # noqa: E741
    j = c.join(l, "doc_id", "full")
    return j.agg(F.count_if(F.col("_labeled_documents").isNull()).alias("only_corpus"), F.count_if(F.col("_corpus").isNull()).alias("only_labeled"), F.count_if(F.col("_corpus").isNotNull() & F.col("_labeled_documents").isNotNull()).alias("both_sides"))


@query("significant_terms", f"{_INFERENCE} SELECT term, round(coef, 6) AS coef, round(p, 6) AS p, stars FROM z WHERE round(p, 6) < 0.05")
def significant_terms(s, sf):
    """Terms of model 1 with p below 0.05 and their stars."""
    return _rows(s, m1(s, sf).table()).where("p < 0.05").select("term", "coef", "p", "stars")


@query("model2_subset_sizes", f"WITH {LD}, a AS (SELECT * FROM ld WHERE n_sentences >= 5 AND context IS NOT NULL AND actor IN (SELECT actor FROM dim_actor)), n AS (SELECT actor, context, count(*) AS n FROM a GROUP BY ALL HAVING count(*) >= 10), q AS (SELECT * FROM n WHERE actor IN (SELECT actor FROM n GROUP BY 1 HAVING count(*) >= 2)) SELECT actor, context, n FROM q")
def model2_subset_sizes(s, sf):
    from .analysis_queries import analysis

    return statistics.qualifying_cells(analysis(s, sf).where("context is not null"), 10).groupBy("actor", "context").agg(F.count(F.lit(1)).alias("n"))
