"""Queries on corpus construction, audits, sentences and samples, with their DuckDB counterparts."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import dates, text
from ..operators import corpus as C
from ..operators import sampling, sentences
from ..session import cut, small, spread, squash, table

CELL = 20  # rows wanted per actor and context in these tables
SEED = 11
STRATA = dict(zip(S.CONTEXTS, (34, 33, 33)))


# -- shared inputs ---------------------------------------------------------------------------------------------------
def enriched(spark: SparkSession, sf: str) -> DataFrame:
    return C.enrich(C.one_per_id(table(spark, sf, "corpus")), table(spark, sf, "dim_actor"))


def corpus(spark: SparkSession, sf: str) -> DataFrame:
    return C.deduplicate(enriched(spark, sf))


def all_sentences(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    docs = spread(enriched(spark, sf) if docs is None else docs)
    return sentences.explode(docs, ["doc_id", "actor", "actor_type", "context", "date", "post_chatgpt"])


def pool(spark: SparkSession, sf: str, docs: DataFrame | None = None) -> DataFrame:
    return sentences.clean_pool(all_sentences(spark, sf, docs))


def sq(c: str) -> str:
    return rf"lower(trim(regexp_replace({c}, '[\s\p{{Z}}\x{{200B}}\x{{FEFF}}]+', ' ', 'g')))"


def wc(c: str) -> str:
    return rf"coalesce(len(list_filter(string_split_regex({c}, '[\s\p{{Z}}]+'), lambda x: x <> '')), 0)"


def esc(pattern: str) -> str:
    return pattern.replace("'", "''")


_P = ", ".join(f"'{p}'" for p in S.PLATFORMS)
_C = ", ".join(f"'{c}'" for c in S.CONTEXTS)
ENRICHED = f"""
one AS (SELECT doc_id, any_value(actor) AS actor, any_value(context) AS context, any_value(platform) AS platform, any_value("date") AS "date", any_value(text) AS text FROM corpus GROUP BY doc_id),
dim AS (SELECT {sq("actor")} AS k, min(actor) AS actor, min(type) AS actor_type, min(positioning) AS positioning FROM dim_actor GROUP BY 1),
enriched AS (
  SELECT o.doc_id, d.actor, d.actor_type, d.positioning, {sq("o.context")} AS context,
    CASE WHEN {sq("o.platform")} IN ({_P}) THEN {sq("o.platform")} ELSE 'press_release' END AS platform,
    coalesce(nullif(o."date", ''), 'unknown') AS "date",
    CAST(CASE WHEN coalesce(nullif(o."date", ''), 'unknown') = 'unknown' THEN 0 WHEN o."date" >= '{S.BREAK_DATE}' THEN 1 ELSE 0 END AS SMALLINT) AS post_chatgpt,
    CAST({wc("o.text")} AS INTEGER) AS word_count, o.text
  FROM one o JOIN dim d ON {sq("o.actor")} = d.k WHERE {sq("o.context")} IN ({_C}) AND {wc("o.text")} > 0)"""
E = f"WITH {ENRICHED}"
STRIP = r"regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
SENTENCES = ENRICHED + rf""",
parts AS (SELECT doc_id, actor, actor_type, context, "date", post_chatgpt,
  list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\s\p{{Z}}]+', '\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP.format("s")}), lambda s: s <> '') AS ss FROM enriched),
sentences AS (SELECT doc_id, actor, actor_type, context, "date", post_chatgpt, i - 1 AS pos, ss[i] AS sentence_text, CAST({wc("ss[i]")} AS INTEGER) AS word_count
  FROM (SELECT *, unnest(range(1, len(ss) + 1)) AS i FROM parts))"""
_RX = lambda c, p: f"regexp_matches({c}, '(?i){esc(p)}')"
HEADER = r"(word_count < 6 AND coalesce(length(regexp_replace(sentence_text, '[^\p{Lu}]', '', 'g')) / nullif(length(regexp_replace(sentence_text, '[^\p{L}]', '', 'g')), 0) > 0.7, true))"
REASON = f"""CASE WHEN word_count < {text.MIN_WORDS} THEN 'too_short' WHEN {_RX("sentence_text", text.JUNK)} THEN 'junk_fragment'
  WHEN {_RX("sentence_text", text.OFF_TOPIC)} OR {HEADER} THEN 'off_topic' WHEN NOT {_RX("sentence_text", text.TOPIC)} THEN 'no_ai_relevance' ELSE '' END"""
POOL = SENTENCES + f""",
reasons AS (SELECT *, {REASON} AS reason FROM sentences),
pool AS (SELECT doc_id || ':' || pos AS sentence_id, *, word_count <= 20 AND NOT {_RX("sentence_text", text.STRONG)} AS likely_none FROM reasons WHERE reason = '')"""

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# -- corpus ----------------------------------------------------------------------------------------------------------
@query("corpus_enriched", E + 'SELECT doc_id, actor, actor_type, positioning, context, platform, "date", post_chatgpt, word_count FROM enriched')
def corpus_enriched(s, sf):
    return enriched(s, sf).drop("text")


@query("platform_default", f"SELECT {sq('platform')} IN ({_P}) AS known, count(*) AS n FROM corpus GROUP BY 1")
def platform_default(s, sf):
    p = squash(F.col("platform")).isin(*S.PLATFORMS)
    return table(s, sf, "corpus").groupBy(p.alias("known")).agg(F.count(F.lit(1)).alias("n"))


@query("break_flag_counts", E + "SELECT context, post_chatgpt, count(*) AS n FROM enriched GROUP BY ALL")
def break_flag_counts(s, sf):
    return enriched(s, sf).groupBy("context", "post_chatgpt").agg(F.count(F.lit(1)).alias("n"))


DEDUP = ENRICHED + ", kept AS (SELECT min(doc_id) AS doc_id FROM enriched GROUP BY actor, \"date\", substr(text, 1, 200)), corp AS (SELECT * FROM enriched SEMI JOIN kept USING (doc_id))"


@query("corpus_dedup", f"WITH {DEDUP} SELECT doc_id, actor, context, word_count FROM corp")
def corpus_dedup(s, sf):
    return corpus(s, sf).select("doc_id", "actor", "context", "word_count")


@query("actor_counts", f"WITH {DEDUP} SELECT actor, count(*) AS n_docs FROM corp GROUP BY 1 ORDER BY 2 DESC")
def actor_counts(s, sf):
    return C.counts(corpus(s, sf), "actor").orderBy(F.desc("n_docs"), "actor")


@query("type_counts", f"WITH {DEDUP} SELECT actor_type, count(*) AS n_docs FROM corp GROUP BY 1")
def type_counts(s, sf):
    return C.counts(corpus(s, sf), "actor_type")


@query("context_share", f"WITH {DEDUP} SELECT context, count(*) AS n_docs, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) AS pct FROM corp GROUP BY 1")
def context_share(s, sf):
    return C.shares(corpus(s, sf), "context")


SHARE_SQL = "SELECT platform, COUNT(*) AS n, ROUND(COUNT(*) * 100.0 / SUM(COUNT(*)) OVER (), 1) AS pct FROM labeled_documents GROUP BY platform ORDER BY n DESC"


@query("sql_passthrough", SHARE_SQL)
def sql_passthrough(s, sf):
    from ..sources.readers import query as run

    return run(s, SHARE_SQL, labeled_documents=table(s, sf, "labeled_documents"))


@query("actor_context_pivot", f"""WITH {DEDUP} SELECT actor, count(*) FILTER (context = 'commercial') AS commercial, count(*) FILTER (context = 'policy') AS policy,
  count(*) FILTER (context = 'public') AS public, count(*) AS total FROM corp GROUP BY 1""")
def actor_context_pivot(s, sf):
    return C.pivot(corpus(s, sf), "actor", "context", S.CONTEXTS)


@query("actor_context_cube", f"WITH {DEDUP} SELECT actor_type, context, count(*) AS n FROM corp GROUP BY CUBE (actor_type, context)")
def actor_context_cube(s, sf):
    return corpus(s, sf).cube("actor_type", "context").agg(F.count(F.lit(1)).alias("n"))


_B = S.BALANCE
_TYPE_RULES = " UNION ALL ".join(
    f"SELECT 'type_{k}', round(coalesce((SELECT count(*) FROM corp WHERE actor_type = '{k}') / t, 0), 6), {w}, abs(round(coalesce((SELECT count(*) FROM corp WHERE actor_type = '{k}') / t, 0), 6) - {w}) <= {_B['type_tolerance']} FROM t"
    for k, w in _B["type_split"].items()
)


@query("balance_rules", f"""WITH {DEDUP}, t AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM corp),
  a AS (SELECT max(n) AS v FROM (SELECT count(*) AS n FROM corp GROUP BY actor)), c AS (SELECT min(n) AS v FROM (SELECT count(*) AS n FROM corp GROUP BY context))
SELECT 'min_total_docs' AS rule, t AS "value", CAST({_B['min_total_docs']} AS DOUBLE) AS threshold, t >= {_B['min_total_docs']} AS passed FROM t
UNION ALL SELECT 'max_actor_share', round(v / t, 6), {_B['max_actor_share']}, round(v / t, 6) <= {_B['max_actor_share']} FROM a, t
UNION ALL SELECT 'min_context_share', round(v / t, 6), {_B['min_context_share']}, round(v / t, 6) >= {_B['min_context_share']} FROM c, t
UNION ALL {_TYPE_RULES}""")
def balance_rules(s, sf):
    return C.balance_rules(corpus(s, sf))


@query("coverage_gaps", f"""WITH {DEDUP}, cells AS (SELECT d.actor, c.context FROM dim d, (SELECT unnest([{_C}]) AS context) c WHERE NOT (d.actor_type = 'policymaker' AND c.context = 'commercial')),
  n AS (SELECT actor, context, count(*) AS n_docs FROM corp GROUP BY ALL)
SELECT actor, context, coalesce(n_docs, 0) AS n_docs, {CELL} - coalesce(n_docs, 0) AS missing FROM cells LEFT JOIN n USING (actor, context) WHERE coalesce(n_docs, 0) < {CELL}""")
def coverage_gaps(s, sf):
    return C.coverage_gaps(corpus(s, sf), table(s, sf, "dim_actor"), CELL)


@query("target_progress", f"""WITH {DEDUP}, want AS (SELECT actor, unnest(map_keys(contexts)) AS context, unnest(map_values(contexts)) AS target FROM dim_actor), n AS (SELECT actor, context, count(*) AS n_docs FROM corp GROUP BY ALL)
SELECT actor, context, target, coalesce(n_docs, 0) AS n_docs, round(coalesce(n_docs, 0) * 100.0 / nullif(target, 0), 1) AS pct FROM want LEFT JOIN n USING (actor, context)""")
def target_progress(s, sf):
    return C.target_progress(corpus(s, sf), table(s, sf, "dim_actor"))


@query("positioning_groups", "SELECT positioning, array_to_string(list_sort(list(DISTINCT actor)), '|') AS actors, count(*) AS n, CAST(sum(target) AS BIGINT) AS target FROM dim_actor GROUP BY 1")
def positioning_groups(s, sf):
    return table(s, sf, "dim_actor").groupBy("positioning").agg(F.array_join(F.array_sort(F.collect_set("actor")), "|").alias("actors"), F.count(F.lit(1)).alias("n"), F.sum("target").alias("target"))


@query("actor_pairs", "SELECT a.actor, a.pair, b.type AS pair_type FROM dim_actor a JOIN dim_actor b ON a.pair = b.actor WHERE a.type = 'individual'")
def actor_pairs(s, sf):
    d = table(s, sf, "dim_actor")
    b = d.select(F.col("actor").alias("pair"), F.col("type").alias("pair_type"))
    return d.where("type = 'individual'").select("actor", "pair").join(small(b), "pair").select("actor", "pair", "pair_type")


@query("source_hosts", "SELECT context, source, count(*) AS n_actors FROM (SELECT actor, unnest(map_entries(sources)) AS e FROM dim_actor), (SELECT 1), LATERAL (SELECT e.key AS context, unnest(e.value) AS source) GROUP BY ALL")
def source_hosts(s, sf):
    e = table(s, sf, "dim_actor").select("actor", F.explode("sources").alias("context", "hosts"))
    return e.select("context", F.explode("hosts").alias("source")).groupBy("context", "source").agg(F.count(F.lit(1)).alias("n_actors"))


@query("first_source_wins", "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def first_source_wins(s, sf):
    d = table(s, sf, "documents").select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("k"))
    best = d.groupBy("k").agg(F.min(F.struct("source", "doc_id")).alias("m"))
    return best.select("m.doc_id", "m.source")


@query("key_sets", """WITH a AS (SELECT DISTINCT actor FROM documents WHERE actor IS NOT NULL), b AS (SELECT DISTINCT actor FROM labeled_documents WHERE actor IS NOT NULL)
SELECT 'union' AS op, count(*) AS n FROM (SELECT * FROM a UNION SELECT * FROM b) UNION ALL SELECT 'intersect', count(*) FROM (SELECT * FROM a INTERSECT SELECT * FROM b)
UNION ALL SELECT 'a_minus_b', count(*) FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT 'b_minus_a', count(*) FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def key_sets(s, sf):
    a, b = (table(s, sf, t).where("actor is not null").select("actor").distinct() for t in ("documents", "labeled_documents"))
    ops = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "a_minus_b": a.subtract(b), "b_minus_a": b.subtract(a)}
    out = None
    for name, df in ops.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@query("unlabeled_docs", "SELECT doc_id FROM (SELECT DISTINCT doc_id FROM corpus) ANTI JOIN labeled_documents USING (doc_id)")
def unlabeled_docs(s, sf):
    return table(s, sf, "corpus").select("doc_id").distinct().join(table(s, sf, "labeled_documents").select("doc_id"), "doc_id", "left_anti")


@query("iso_days", """SELECT "date", count(*) AS n, CAST(try_strptime("date", '%Y-%m-%d') AS DATE) IS NOT NULL AS is_day FROM corpus WHERE regexp_full_match("date", '\\d{4}-\\d{2}-\\d{2}') GROUP BY ALL""")
def iso_days(s, sf):
    c = table(s, sf, "corpus").where(F.col("date").rlike(r"\A\d{4}-\d{2}-\d{2}\z"))
    return c.groupBy("date").agg(F.count(F.lit(1)).alias("n")).select("date", "n", dates.to_day("date").isNotNull().alias("is_day"))


# -- sentences -------------------------------------------------------------------------------------------------------
@query("sentences_exploded", f"WITH {SENTENCES} SELECT doc_id, pos, word_count, md5(sentence_text) AS digest FROM sentences")
def sentences_exploded(s, sf):
    return all_sentences(s, sf).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "word_count", F.md5("sentence_text").alias("digest"))


@query("sentence_lengths", f"WITH {SENTENCES} SELECT context, count(*) AS n, CAST(sum(word_count) AS BIGINT) AS words, CAST(sum(length(sentence_text)) AS BIGINT) AS chars, max(word_count) AS longest FROM sentences GROUP BY 1")
def sentence_lengths(s, sf):
    return all_sentences(s, sf).groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum("word_count").alias("words"), F.sum(F.length("sentence_text")).alias("chars"), F.max("word_count").alias("longest"))


_REASONS = ", ".join(f"'{r}'" for r in [*S.FILTER_REASONS, ""])


@query("filter_reason_histogram", f"""WITH {SENTENCES}, r AS (SELECT {REASON} AS reason FROM sentences), n AS (SELECT reason, count(*) AS n FROM r GROUP BY 1), names AS (SELECT unnest([{_REASONS}]) AS reason)
SELECT CASE WHEN reason = '' THEN 'kept' ELSE reason END AS reason, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0 / sum(n) OVER (), 1) AS pct FROM names LEFT JOIN n USING (reason)""")
def filter_reason_histogram(s, sf):
    return sentences.reason_histogram(all_sentences(s, sf))


@query("clean_pool", f"WITH {POOL} SELECT sentence_id, doc_id, actor, context, word_count, likely_none FROM pool")
def clean_pool(s, sf):
    return pool(s, sf).select("sentence_id", "doc_id", "actor", "context", "word_count", "likely_none")


@query("likely_none_rate", f"WITH {POOL} SELECT actor, count(*) AS n, round(avg(CAST(likely_none AS INTEGER)) * 100, 4) AS pct FROM pool GROUP BY 1")
def likely_none_rate(s, sf):
    return pool(s, sf).groupBy("actor").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("likely_none").cast("int")) * 100, 4).alias("pct"))


@query("english_pool", f"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, lang, text FROM documents), parts AS (SELECT doc_id, lang, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])[\\s\\p{{Z}}]+', '\\1' || chr(1), 'g'), chr(1)), lambda s: {STRIP.format("s")}), lambda s: s <> '') AS ss FROM d),
  sentences AS (SELECT doc_id, lang, sentence_text, CAST({wc("sentence_text")} AS INTEGER) AS word_count FROM (SELECT doc_id, lang, unnest(ss) AS sentence_text FROM parts)), r AS (SELECT *, {REASON} AS reason FROM sentences)
SELECT CASE WHEN reason = '' AND coalesce(lower(lang) <> 'en', false) THEN 'non_english' ELSE reason END AS reason, count(*) AS n FROM r GROUP BY 1""")
def english_pool(s, sf):
    d = table(s, sf, "documents").select("doc_id", "lang", "text")
    return sentences.with_reason(sentences.explode(d, ["doc_id", "lang"]), "lang").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


REJOIN = text.any_term("risk|harm|regulation|oversight")


@query("keep_and_rejoin", f"""WITH {SENTENCES}, hits AS (SELECT doc_id, string_agg(sentence_text, ' ' ORDER BY pos) AS t, count(*) AS n FROM sentences WHERE {_RX("sentence_text", REJOIN)} GROUP BY 1)
SELECT doc_id, md5(t) AS digest, length(t) AS chars FROM hits WHERE n >= 3""")
def keep_and_rejoin(s, sf):
    t = enriched(s, sf).select("doc_id", text.keep_and_rejoin("text", REJOIN).alias("t")).where("t is not null")
    return t.select("doc_id", F.md5("t").alias("digest"), F.length("t").cast("bigint").alias("chars"))


@query("mention_threshold", f"WITH {ENRICHED} SELECT doc_id, CAST(len(regexp_extract_all(lower(text), 'model')) AS BIGINT) AS mentions FROM enriched WHERE len(regexp_extract_all(lower(text), 'model')) >= 3")
def mention_threshold(s, sf):
    return enriched(s, sf).select("doc_id", F.regexp_count(F.lower("text"), F.lit("model")).cast("bigint").alias("mentions")).where("mentions >= 3")


@query("topic_docs", f"WITH {ENRICHED} SELECT platform, count(*) AS n, count(*) FILTER ({_RX('text', text.TOPIC)}) AS on_topic FROM enriched GROUP BY 1")
def topic_docs(s, sf):
    return enriched(s, sf).groupBy("platform").agg(F.count(F.lit(1)).alias("n"), F.count_if(text.rlike("text", text.TOPIC)).alias("on_topic"))


@query("length_gates", f"WITH {ENRICHED} SELECT platform, count(*) FILTER (word_count >= 50) AS w50, count(*) FILTER (word_count >= 200) AS w200, count(*) FILTER (word_count >= 500) AS w500, count(*) FILTER (length(text) >= 300) AS c300 FROM enriched GROUP BY 1")
def length_gates(s, sf):
    n = lambda c: F.count_if(c)
    return enriched(s, sf).groupBy("platform").agg(n(F.col("word_count") >= 50).alias("w50"), n(F.col("word_count") >= 200).alias("w200"), n(F.col("word_count") >= 500).alias("w500"), n(F.length("text") >= 300).alias("c300"))


@query("actor_mentions", f"""WITH {ENRICHED}, k AS (SELECT DISTINCT actor AS named, unnest(string_split(lower(actor), ' ')) AS term FROM dim_actor), w AS (SELECT named, term FROM k WHERE length(term) >= 5)
SELECT w.named, w.term, count(*) AS n_docs, count(*) FILTER (w.named = enriched.actor) AS own FROM enriched JOIN w ON contains(lower(text), w.term) GROUP BY ALL""")
def actor_mentions(s, sf):
    """Documents in which a word of an actor's name occurs."""
    k = table(s, sf, "dim_actor").select(F.col("actor").alias("named"), F.explode(F.split(F.lower("actor"), " ")).alias("term")).where(F.length("term") >= 5).distinct()
    hits = enriched(s, sf).join(small(k), F.expr("contains(lower(text), term)"))
    return hits.groupBy("named", "term").agg(F.count(F.lit(1)).alias("n_docs"), F.count_if(F.col("named") == F.col("actor")).alias("own"))


# -- samples ---------------------------------------------------------------------------------------------------------
ACTORS, GOLD_ROWS, SHORT, SHORT_SHARE = 5, 100, 10, 0.2


def _draw_sql(name: str, source: str, tier: str, share: float, quota: str) -> str:
    """CTE ``name``: the sample that ``sampling.quota`` draws from ``source``."""
    key = f"md5(sentence_id || '|{SEED}')"
    return f"""{name}_k AS (SELECT sentence_id, doc_id, actor, context, sentence_text, word_count, CAST({tier} AS INTEGER) AS tier, {key} AS h, {quota} AS n FROM {source}),
  {name}_r AS (SELECT *, row_number() OVER (PARTITION BY context, tier ORDER BY h, sentence_id) AS tr, row_number() OVER (PARTITION BY context, actor ORDER BY h, sentence_id) = 1 AS lead FROM {name}_k),
  {name}_d AS (SELECT *, row_number() OVER (PARTITION BY context, lead ORDER BY h, sentence_id) AS dr FROM {name}_r),
  {name}_p AS (SELECT *, CASE WHEN lead AND dr <= {ACTORS} THEN 0 WHEN tier = 1 AND tr <= greatest(ceil(n * {share}), 1) THEN 1 WHEN tier = 0 THEN 2 ELSE 3 END AS pref FROM {name}_d),
  {name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY context ORDER BY pref, h, sentence_id) AS rank FROM {name}_p) WHERE rank <= n)"""


_QUOTA = "CASE context " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in STRATA.items()) + " END"
OVERLAP = f"{POOL}, {_draw_sql('overlap', 'pool', 'likely_none', 0.15, _QUOTA)}"
GOLD = f"""{POOL}, {_draw_sql('gold_a', 'pool', f'word_count < {SHORT}', SHORT_SHARE, str(GOLD_ROWS))},
  rest AS (SELECT * FROM pool ANTI JOIN gold_a USING (sentence_id)), {_draw_sql('gold_b', 'rest', f'word_count < {SHORT}', SHORT_SHARE, str(GOLD_ROWS))}"""
_KEPT = ["sentence_id", "doc_id", "actor", "context", "word_count", "likely_none", "sentence_text"]


def overlap(s, sf) -> DataFrame:
    """Sentences that both annotators read."""
    return sampling.quota(pool(s, sf).select(*_KEPT), "context", STRATA, "likely_none", 0.15, SEED, ACTORS)


def gold(s, sf) -> tuple[DataFrame, DataFrame]:
    """Two disjoint gold sets; the ids of the first, at most ``GOLD_ROWS`` a context, are kept once."""
    rows = pool(s, sf).select(*_KEPT).withColumn("short", F.col("word_count") < SHORT)
    quotas = dict.fromkeys(S.CONTEXTS, GOLD_ROWS)
    a = cut(sampling.quota(rows, "context", quotas, "short", SHORT_SHARE, SEED, ACTORS))
    return a, sampling.quota(rows, "context", quotas, "short", SHORT_SHARE, SEED, ACTORS, exclude=a)


def _ranked(sample: DataFrame) -> DataFrame:
    return sample.select("sentence_id", "context", F.col("rank").cast("bigint").alias("rank"))


@query("overlap_sample", f"WITH {OVERLAP} SELECT sentence_id, context, rank FROM overlap")
def overlap_sample(s, sf):
    return _ranked(overlap(s, sf))


@query("overlap_actors", f"WITH {OVERLAP} SELECT context, count(DISTINCT actor) AS n_actors, count(*) FILTER (likely_none) AS n_likely_none, count(*) AS n FROM overlap JOIN (SELECT sentence_id, likely_none FROM pool) USING (sentence_id) GROUP BY 1")
def overlap_actors(s, sf):
    return overlap(s, sf).groupBy("context").agg(F.countDistinct("actor").alias("n_actors"), F.count_if("likely_none").alias("n_likely_none"), F.count(F.lit(1)).alias("n"))


@query("overlap_shuffled", f"WITH {OVERLAP} SELECT sentence_id, row_number() OVER (ORDER BY md5(sentence_id || '|{SEED + 1}'), sentence_id) AS position FROM overlap")
def overlap_shuffled(s, sf):
    return sampling.shuffled(overlap(s, sf), SEED + 1).select("sentence_id", F.col("position").cast("bigint").alias("position"))


@query("gold_a", f"WITH {GOLD} SELECT sentence_id, context, rank FROM gold_a")
def gold_a(s, sf):
    return _ranked(gold(s, sf)[0])


@query("gold_b", f"WITH {GOLD} SELECT sentence_id, context, rank FROM gold_b")
def gold_b(s, sf):
    return _ranked(gold(s, sf)[1])


@query("gold_short", f"WITH {GOLD} SELECT context, count(DISTINCT actor) AS n_actors, count(*) FILTER (word_count < {SHORT}) AS n_short, count(*) AS n FROM gold_a GROUP BY 1")
def gold_short(s, sf):
    return gold(s, sf)[0].groupBy("context").agg(F.countDistinct("actor").alias("n_actors"), F.count_if("short").alias("n_short"), F.count(F.lit(1)).alias("n"))


@query("gold_disjoint", f"WITH {GOLD} SELECT count(*) AS n_shared FROM gold_a SEMI JOIN gold_b USING (sentence_id)")
def gold_disjoint(s, sf):
    a, b = (x.select("sentence_id") for x in gold(s, sf))
    return a.intersect(b).agg(F.count(F.lit(1)).alias("n_shared"))


@query("two_sets", f"""WITH {POOL}, f AS (SELECT sentence_id, context, row_number() OVER (PARTITION BY context ORDER BY md5(sentence_id || '|{SEED}'), sentence_id) AS rank FROM pool)
SELECT sentence_id, context, CASE WHEN rank <= 100 THEN 'A' ELSE 'B' END AS annotator FROM f WHERE rank <= 200""")
def two_sets(s, sf):
    return sampling.disjoint_sets(pool(s, sf).select("sentence_id", "context"), "context", 100, ["A", "B"], SEED).select("sentence_id", "context", "annotator")


@query("diverse_start", f"WITH {POOL} SELECT context, actor, arg_min(sentence_id, md5(sentence_id || '|{SEED}')) AS sentence_id FROM pool GROUP BY ALL")
def diverse_start(s, sf):
    return sampling.one_per_actor(pool(s, sf), "context", SEED)
