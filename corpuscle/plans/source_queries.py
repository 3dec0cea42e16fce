"""Queries through files: what the sinks write to the shared folder, the readers read back; and readers of remote bodies."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import dates, html, text
from ..operators import agreement, labeling, language, sentences, statistics
from ..session import cut, shared_folder, small, table
from ..sources import readers, reports, sinks
from .analysis_queries import _M2, _TAIL, ANALYSIS, FRAMES, PAGE, _hot, _rows, cross_context_std, m2, pages
from .analysis_queries import O as ANALYSIS_SQL
from .corpus_queries import GOLD, OVERLAP, POOL, SEED, gold, overlap, pool

Q, O = {}, {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def _one_file(s, df: DataFrame, name: str) -> str:
    """A one-row text as one file of the shared folder."""
    path = shared_folder(s, name)
    df.coalesce(1).write.text(path)
    return path


def _joined(df: DataFrame, before: str, rows, between: str, after: str, order: str = "actor") -> DataFrame:
    """One text from the rows of a small dimension."""
    parts = df.agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("k"), rows.alias("v")))).alias("p"))
    return parts.select(F.concat(F.lit(before), F.array_join(F.transform("p", lambda x: x["v"]), between), F.lit(after)).alias("value"))


# -- files -----------------------------------------------------------------------------------------------------------
_URL = "'https://a.example/' || raw_subdir || '/' || actor"


def _raw(s, sf) -> DataFrame:
    d = table(s, sf, "dim_actor")
    url = F.concat(F.lit("https://a.example/"), F.col("raw_subdir"), F.lit("/"), F.col("actor"))
    return d.select(url.alias("url"), F.lit("2024-03-17").alias("date"), F.concat_ws(" ", "actor", "type", "positioning").alias("text"), "actor", F.col("type").alias("context"), F.lit("blog").alias("platform"))


@query("raw_json_docs", f"SELECT {_URL} AS url, substr(md5({_URL}), 1, 12) AS key, actor, type AS context, actor || ' ' || type || ' ' || positioning AS text FROM dim_actor")
def raw_json_docs(s, sf):
    path = shared_folder(s, "raw")
    sinks.keyed_json(_raw(s, sf), path)
    return readers.raw_documents(s, path).select("url", text.key12(F.col("url")).alias("key"), "actor", "context", "text")


@query("csv_round_trip", "SELECT sentence_id, actor, md5(coalesce(sentence_text, '')) AS text_key, md5(coalesce(disagreements, '')) AS listing_key, CAST(n_disagreements AS VARCHAR) AS n FROM kappa_disagreements")
def csv_round_trip(s, sf):
    path = shared_folder(s, "csv")
    sinks.csv(table(s, sf, "kappa_disagreements"), path)
    key = lambda c: F.md5(F.coalesce(c, F.lit("")))
    return readers.csv(s, path).select("sentence_id", "actor", key("sentence_text").alias("text_key"), key("disagreements").alias("listing_key"), F.col("n_disagreements").alias("n"))


@query("csv_done_ids", "SELECT context, count(DISTINCT sentence_id) AS n_ids FROM kappa_disagreements WHERE substr(md5(sentence_id), 1, 1) >= '8' GROUP BY 1")
def csv_done_ids(s, sf):
    """A resumed run reads only the ids of what is done, and leaves those rows out."""
    k, path = table(s, sf, "kappa_disagreements"), shared_folder(s, "done")
    sinks.csv(k.where(F.substring(F.md5("sentence_id"), 1, 1) < "8"), path)
    return labeling.pending(k, readers.done_ids(s, path)).groupBy("context").agg(F.countDistinct("sentence_id").alias("n_ids"))


@query("append_new", """WITH a AS (SELECT count(DISTINCT doc_id) AS n FROM labeled_documents WHERE substr(md5(doc_id), 1, 1) < '8'), b AS (SELECT count(DISTINCT doc_id) AS n FROM labeled_documents)
SELECT a.n AS n_first, b.n - a.n AS n_second, CAST(0 AS BIGINT) AS n_third, b.n AS n_rows FROM a, b""")
def append_new(s, sf):
    d, path = table(s, sf, "labeled_documents"), shared_folder(s, "append")
    first = sinks.append_new(d.where(F.substring(F.md5("doc_id"), 1, 1) < "8"), path, "doc_id", fresh=True)
    second, third = sinks.append_new(d, path, "doc_id"), sinks.append_new(d, path, "doc_id")
    return s.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(first).cast("bigint").alias("n_first"), F.lit(second).cast("bigint").alias("n_second"), F.lit(third).cast("bigint").alias("n_third"), "n_rows")


@query("loaded_table", "SELECT doc_id AS \"DOC_ID\", actor AS \"ACTOR\", n_sentences AS \"N_SENTENCES\", round(risk_score, 6) AS \"RISK_SCORE\" FROM labeled_documents")
def loaded_table(s, sf):
    path = shared_folder(s, "loaded")
    name = f"loaded_{path.rsplit('-')[-1]}"
    sinks.create_table(s, name, S.LABELED_DOCUMENT.upper(), path)
    sinks.load_table(table(s, sf, "labeled_documents"), name, S.LABELED_DOCUMENT, path)
    return s.table(name).select("DOC_ID", "ACTOR", "N_SENTENCES", F.round("RISK_SCORE", 6).alias("RISK_SCORE"))


LDO = "ld AS (SELECT DISTINCT ON (doc_id) * FROM labeled_documents ORDER BY doc_id)"


@query("swapped_column", f"WITH {LDO} SELECT doc_id, actor, CASE WHEN n_sentences >= 10 THEN upper(innovation_subcategory_dominant) END AS dominant FROM ld")
def swapped_column(s, sf):
    """Documents with their dominant subcategory, recomputed for those with ten sentences; the others lose it."""
    path = shared_folder(s, "swap")
    d = table(s, sf, "labeled_documents").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("actor", "n_sentences", "innovation_subcategory_dominant")]).withColumnRenamed("innovation_subcategory_dominant", "dominant")
    d.write.parquet(path)
    sinks.swap_column(s, path, d.where("n_sentences >= 10").select("doc_id", F.upper("dominant").alias("dominant")), "doc_id", "dominant")
    return s.read.parquet(path).select("doc_id", "actor", "dominant")


class Failing(labeling.LexiconLabeler):
    """Refuses questions."""

    def __call__(self, batch):
        if any("?" in b["text"] for b in batch):
            raise ValueError("question")
        return super().__call__(batch)


@query("dead_letters", f"WITH {POOL}, bad AS (SELECT sentence_id FROM pool WHERE contains(sentence_text, '?')) SELECT 'ValueError' AS error, count(*) AS n, array_to_string((SELECT list(sentence_id ORDER BY sentence_id) FROM (SELECT sentence_id FROM bad ORDER BY 1 LIMIT 3)), '|') AS first_ids FROM bad")
def dead_letters(s, sf):
    path = shared_folder(s, "dead")
    sinks.dead_letters(labeling.label(pool(s, sf), Failing, batch=1, attempts=1), path)
    return labeling.dead_letters(s.read.parquet(path)).select("error", "n", F.array_join("first_ids", "|").alias("first_ids"))


# -- feeds and indexes -----------------------------------------------------------------------------------------------
@query("sitemap_urls", "SELECT 'https://a.example/' || type || '/' || raw_subdir AS url FROM dim_actor WHERE type = 'individual'")
def sitemap_urls(s, sf):
    loc = F.concat(F.lit("<url><loc> https://a.example/"), F.col("type"), F.lit("/"), F.col("raw_subdir"), F.lit("\n</loc></url>"))
    return readers.sitemap(s, _one_file(s, _joined(table(s, sf, "dim_actor"), "<urlset>", loc, "\n", "</urlset>"), "sitemap"), "/individual/")


@query("archive_captures", "SELECT raw_subdir AS urlkey, '20200102030405' AS timestamp, 'http://a.example/' || raw_subdir AS original, '2020-01-02' AS day FROM dim_actor WHERE type <> 'company'")
def archive_captures(s, sf):
    d = table(s, sf, "dim_actor")
    cell = lambda stamp, status: F.to_json(F.array(F.col("raw_subdir"), F.lit(stamp), F.concat(F.lit("http://a.example/"), F.col("raw_subdir")), status))
    ok = F.when(F.col("type") == "company", "404").otherwise("200")
    rows = F.concat_ws(",", cell("20210101000000", ok), cell("20200102030405", ok), cell("19990101000000", F.lit("200")))
    path = _one_file(s, _joined(d, '[["urlkey","timestamp","original","statuscode"],', rows, ",", "]"), "archive")
    return readers.archive_index(s, path, first="2000").select("urlkey", "timestamp", "original", dates.compact_day("timestamp").alias("day"))


@query("feed_entries", "SELECT 'http://a.example/abs/' || raw_subdir AS url, actor AS title, type || ' ' || positioning AS abstract, '2024-03-17' AS \"date\" FROM dim_actor")
def feed_entries(s, sf):
    entry = F.concat(F.lit("<entry><id>http://a.example/abs/"), F.col("raw_subdir"), F.lit("v2</id><title>"), F.col("actor"), F.lit("</title><summary> "), F.col("type"), F.lit("\n  "), F.col("positioning"), F.lit("</summary><published>2024-03-17T00:00:00Z</published></entry>"))
    return readers.feed(s, _one_file(s, _joined(table(s, sf, "dim_actor"), "<feed>", entry, "\n", "</feed>"), "feed"))


@query("search_results", "SELECT 'https://a.example/' || raw_subdir AS url, '2024-03-17' AS \"date\" FROM dim_actor")
def search_results(s, sf):
    """A paged search: the first answer tells the total, the other pages follow."""
    names = [r[0] for r in table(s, sf, "dim_actor").select("raw_subdir").orderBy("actor").collect()]  # the pages that the service would hold

    def get(url: str) -> tuple[int, str]:
        import json

        start = int(url.rsplit("=", 1)[-1])
        return 200, json.dumps({"total": {"value": len(names)}, "results": [{"link": f"/{n}", "public_timestamp": "2024-03-17T08:00:00Z"} for n in names[start : start + 5]]})

    return readers.search(s, get, "https://a.example/search?start={start}", "https://a.example", 5)


@query("news_articles", "SELECT 'https://n.example/' || raw_subdir AS url, actor AS title, CASE WHEN regexp_matches(actor, '(?i)labs') THEN 'speech' ELSE 'interview' END AS platform FROM dim_actor")
def news_articles(s, sf):
    d = table(s, sf, "dim_actor")
    item = F.to_json(F.struct(F.concat(F.lit("https://n.example/"), F.col("raw_subdir"), F.lit("/?utm=1")).alias("url"), F.col("actor").alias("title"), F.lit("2024-03-17T08:00:00Z").alias("publishedAt")))
    body = _joined(d, '{"status":"ok","totalResults":16,"articles":[', item, ",", "]}").withColumnRenamed("value", "body")
    rows = readers.news_pages(body.withColumn("page", F.lit(1)), size=100)
    return rows.select("url", "title", F.when(text.rlike("title", "labs"), "speech").otherwise("interview").alias("platform"))


@query("talk_discovery", "SELECT 'https://t.example/talks/' || replace(raw_subdir, '/', '-') || '/transcript' AS url, actor AS speaker FROM dim_actor WHERE type = 'individual'")
def talk_discovery(s, sf):
    d = table(s, sf, "dim_actor")
    item = F.concat(F.lit("<li>"), F.when(F.col("type") == "individual", F.upper("actor")).otherwise("someone"), F.lit(': <a href="/talks/'), F.replace("raw_subdir", F.lit("/"), F.lit("-")), F.lit('?lang=en">see</a></li>'))
    page = _joined(d, "<ul>", item, "", "</ul>").select(F.lit("https://t.example/search").alias("url"), F.col("value").alias("html"))
    return readers.talks(page, d.where("type = 'individual'").select(F.col("actor").alias("speaker")))


@query("dated_registry", "SELECT day AS \"date\", 'https://p.example/doc/' || day || '/debate' AS url FROM (SELECT DISTINCT CAST(CAST(ts AS DATE) AS VARCHAR) AS day FROM events)")
def dated_registry(s, sf):
    days = table(s, sf, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("date")).distinct()
    return days.withColumn("url", F.replace(F.lit("https://p.example/doc/{date}/debate"), F.lit("{date}"), F.col("date")))


@query("post_links", f"""WITH {PAGE}, h AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*href="([^"]*)"', 1)) AS href FROM pages), b AS (SELECT url, regexp_replace(regexp_replace(href, '[?#].*$', ''), '/+$', '') AS b FROM h),
l AS (SELECT DISTINCT url, regexp_replace(CASE WHEN regexp_matches(b, '^https?://') THEN b WHEN b LIKE '/%' THEN regexp_extract(url, '^(https?://[^/]+)', 1) || b ELSE regexp_replace(url, '/[^/]*$', '') || '/' || b END, '^http://', 'https://') AS link FROM b)
SELECT url, link FROM l WHERE contains(link, regexp_extract(url, '^https?://([^/]+)', 1)) AND link <> url AND NOT regexp_matches(link, '{html.NO_POST}') AND NOT regexp_matches(link, '{html.NO_PAGE}')""")
def post_links(s, sf):
    return html.links(pages(s, sf)).where(html.is_post(F.col("link"), F.col("url")))


@query("transcript_pages", f"WITH {PAGE} SELECT doc_id, 'Record ' || doc_id || ' of ' || regexp_extract(html, ' of ([^<]*)</p>', 1) AS said FROM pages")
def transcript_pages(s, sf):
    p = pages(s, sf)
    body = F.concat(F.lit('<body><p>menu</p><div class="a transcript-b">'), F.regexp_extract("html", "(<p>.*?</p>)", 1), F.lit("\n </div></body>"))
    return p.select("doc_id", html.transcript_text(body).alias("said"))


@query("pdf_documents", "SELECT doc_id, regexp_replace(source, '[^A-Za-z0-9. /-]', '', 'g') || ' record ' || doc_id AS said FROM documents")
def pdf_documents(s, sf):
    """Text out of PDF bytes, made here from a field of each document."""
    said = F.concat(F.regexp_replace("source", "[^A-Za-z0-9. /-]", ""), F.lit(" record "), F.col("doc_id").cast("string"))
    body = F.concat(F.lit("%PDF-1.4\nstream\nBT ("), said, F.lit(") Tj ET\nendstream\n%%EOF"))
    return table(s, sf, "documents").select("doc_id", readers.pdf_column(F.encode(body, "ISO-8859-1")).alias("said"))


# -- dates and strings -----------------------------------------------------------------------------------------------
@query("date_forms", """SELECT event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS unix, CAST(CAST(ts AS DATE) AS VARCHAR) AS compact, CAST(CAST(ts AS DATE) AS VARCHAR) AS dmy, CAST(CAST(ts AS DATE) AS VARCHAR) AS mdy, CAST(CAST(ts AS DATE) AS VARCHAR) AS path,
  CASE WHEN event_id % 3 = 0 THEN 'unknown' WHEN event_id % 3 = 1 THEN CAST(CAST(ts AS DATE) AS VARCHAR) ELSE '2001-02-03' END AS chained FROM events""")
def date_forms(s, sf):
    ts = F.col("ts").cast("timestamp")
    e = table(s, sf, "events").select(
        "event_id", F.unix_seconds(ts).cast("string").alias("sec"), F.date_format(ts, "yyyyMMddHHmmss").alias("stamp"), F.date_format(ts, "d MMMM yyyy").alias("dmy"), F.date_format(ts, "MMM d, yyyy").alias("mdy"),
        F.concat(F.lit("https://a.example/"), F.date_format(ts, "yyyy/MM/dd"), F.lit("/x")).alias("url"),
    )
    m = F.col("event_id") % 3
    page = F.when(m == 0, F.lit("")).when(m == 1, dates.compact_day("stamp"))
    given = F.when(m == 0, F.lit("unknown")).when(m == 2, "2001-02-03").otherwise("1999-01-01")
    return e.select("event_id", dates.unix_day("sec").alias("unix"), dates.compact_day("stamp").alias("compact"), dates.written_day("dmy").alias("dmy"), dates.written_day("mdy").alias("mdy"), dates.path_day("url").alias("path"), dates.first_known(page, given).alias("chained"))


_W = r"[\s\p{Z}]+"


@query("string_forms", rf"""SELECT doc_id, md5(trim(regexp_replace(text, '{_W}', ' ', 'g'), ' ')) AS collapsed, CASE WHEN length(source) > 12 THEN substr(source, 1, 12) || '...' ELSE source END AS shown,
  lower(regexp_replace(source, '[^A-Za-z0-9]+', '_', 'g')) AS file, 'x' || doc_id AS bare FROM documents""")
def string_forms(s, sf):
    d = table(s, sf, "documents")
    fenced = F.concat(F.lit("```json\nx"), F.col("doc_id").cast("string"), F.lit("\n```"))
    return d.select("doc_id", F.md5(text.collapse(F.col("text"))).alias("collapsed"), text.shorten("source", 12).alias("shown"), text.file_safe("source").alias("file"), F.trim(F.regexp_replace(text.unfence(fenced), "\n", "")).alias("bare"))


@query("unique_urls", "SELECT user_id % 10 AS page, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def unique_urls(s, sf):
    """Addresses seen first in a stream, each once."""
    from ..streaming import pipelines

    path = f"{sf}/events.parquet"
    events = pipelines.read_parquet_stream(s, path, T.StructType(s.read.parquet(path).schema.fields)).select(F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("https://a.example/"), F.col("user_id").cast("string")).alias("url"))
    got = pipelines.drain(pipelines.unique_urls(events, late="3650 days"), "append")
    return got.groupBy((F.element_at(F.split("url", "/"), -1).cast("bigint") % 10).alias("page")).agg(F.count(F.lit(1)).alias("n"))


# -- sheets of annotators --------------------------------------------------------------------------------------------
SHEET = dict(zip(S.FRAMES, ("Innovation_Progress", "Economic_Benefit", "Risk_Harm", "Regulation_Governance", "Existential_AGI")))
INSTRUCTIONS = ["Read each sentence by itself.", "Write 1 under each label that applies, 0 or nothing elsewhere.", "None excludes the other labels."]


def _sheet(rows: DataFrame, lexicon: dict) -> DataFrame:
    """Sentences as an annotation sheet, filled by a lexicon."""
    hot = labeling.by_lexicon(rows, lexicon=lexicon)
    cols = [F.col(S.FRAME_COLUMNS[f]).cast("string").alias(c) for f, c in SHEET.items()]
    none = (sum((F.col(c) for c in FRAMES[1:]), F.col(FRAMES[0])) == 0).cast("int").cast("string").alias("None")
    return hot.select("sentence_id", "actor", "context", "sentence_text", *cols, none)


def _bits(sheet: DataFrame) -> DataFrame:
    """The label columns of a sheet as 0/1 under the names of the frames."""
    return sheet.select("sentence_id", "actor", "context", *[text.to_bit_half(f"`{c}`").alias(S.FRAME_COLUMNS[f]) for f, c in SHEET.items()])


def _readers(s, sf) -> tuple[DataFrame, DataFrame]:
    """Two annotators' sheets of the overlap sample, written and read back; each has lost some sentences."""
    o = cut(overlap(s, sf).select("sentence_id", "actor", "context", "sentence_text"))
    first = F.substring(F.md5("sentence_id"), 1, 1)
    out = []
    for lexicon, part in ((labeling.LEXICON, first < "f"), (labeling.STRICT, first >= "1")):
        path = shared_folder(s, "sheet")
        sinks.csv(_sheet(o.where(part), lexicon), path)
        out.append(_bits(readers.csv(s, path)))
    return out[0], out[1]


_OSQL = f"""{OVERLAP}, ra AS (SELECT sentence_id, {_hot(labeling.LEXICON)} FROM overlap WHERE substr(md5(sentence_id), 1, 1) < 'f'), rb AS (SELECT sentence_id, {_hot(labeling.STRICT)} FROM overlap WHERE substr(md5(sentence_id), 1, 1) >= '1')"""


@query("readers_joined", f"WITH {_OSQL} SELECT sentence_id, {', '.join(f'ra.{c} AS {c}_a, rb.{c} AS {c}_b' for c in FRAMES)} FROM ra JOIN rb USING (sentence_id)")
def readers_joined(s, sf):
    return agreement.join_readers(*_readers(s, sf), FRAMES).select("sentence_id", *[f"{c}_{x}" for c in FRAMES for x in "ab"])


@query("readers_overlap", f"WITH {_OSQL} SELECT (SELECT count(*) FROM ra JOIN rb USING (sentence_id)) AS shared, (SELECT count(*) FROM ra ANTI JOIN rb USING (sentence_id)) AS only_a, (SELECT count(*) FROM rb ANTI JOIN ra USING (sentence_id)) AS only_b")
def readers_overlap(s, sf):
    return agreement.overlap(*_readers(s, sf))


_LNG = " UNION ALL ".join(f"SELECT '{f}' AS label, {c}_a AS a, {c}_b AS b FROM j" for f, c in S.FRAME_COLUMNS.items())


@query("readers_kappa", f"""WITH {_OSQL}, j AS (SELECT {', '.join(f'ra.{c} AS {c}_a, rb.{c} AS {c}_b' for c in FRAMES)} FROM ra JOIN rb USING (sentence_id)), l AS ({_LNG}), k AS (SELECT label, count(*) AS n, avg(CAST(a = b AS INTEGER)) AS po, avg(a) AS pa, avg(b) AS pb FROM l GROUP BY 1)
SELECT label, n, round(po * 100, 4) AS agreement_pct, CASE WHEN abs(1 - (pa * pb + (1 - pa) * (1 - pb))) < 1e-12 THEN NULL ELSE round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) END AS kappa FROM k""")
def readers_kappa(s, sf):
    j = agreement.join_readers(*_readers(s, sf), FRAMES)
    return agreement.kappa(agreement.stack(j, {f: (f"{c}_a", f"{c}_b") for f, c in S.FRAME_COLUMNS.items()}, ["sentence_id"]))


@query("kappa_report", O["readers_kappa"].replace("SELECT label, n, round(po", "SELECT rpad(label, 24, ' ') || ' ' || lpad(CAST(n AS VARCHAR), 5, ' ') || ' ' || lpad(printf('%.1f%%', round(po") .replace("* 100, 4) AS agreement_pct, CASE", "* 100, 4)), 8, ' ') || ' ' || lpad(printf('%.3f', coalesce(CASE").replace(", 6) END AS kappa FROM k", ", 6) END, 0)), 7, ' ') AS line FROM k"))
def kappa_report(s, sf):
    """The agreement table as fixed-width lines."""
    k = readers_kappa(s, sf).withColumn("share", F.col("agreement_pct") / 100)
    return k.select(reports.line(("label", 24, "s"), ("n", 5, "d"), ("share", 8, ".1%"), ("kappa", 7, ".3f")).alias("line"))


@query("workbook_labels", f"WITH {OVERLAP} SELECT sentence_id, context, {_hot(labeling.LEXICON)} FROM overlap")
def workbook_labels(s, sf):
    """The overlap sample as a styled workbook, and its labels read back."""
    sheet = _sheet(overlap(s, sf).select("sentence_id", "actor", "context", "sentence_text"), labeling.LEXICON)
    rows = [tuple(r) for r in sheet.orderBy(F.md5(F.concat("sentence_id", F.lit(f"|{SEED}")))).collect()]  # a sample of a hundred rows
    data = reports.workbook(sheet.columns, rows, (*SHEET.values(), "None"), {"sentence_text": 80, "sentence_id": 24}, INSTRUCTIONS, "Annotator A")
    path = f"{shared_folder(s, 'book')}/annotator_a.xlsx"
    sinks.save_bytes(s, path, data)
    return _renamed(readers.annotations(s, path))


def _renamed(sheet: DataFrame) -> DataFrame:
    return sheet.select("sentence_id", "context", *[F.col(c).alias(S.FRAME_COLUMNS[f]) for f, c in SHEET.items()])


_GSQL = f"""{GOLD}, h AS (SELECT sentence_id, {_hot(labeling.STRICT)} FROM gold_a), m AS (SELECT sentence_id, {_hot(labeling.LEXICON)} FROM pool), j AS (SELECT {', '.join(f'h.{c} AS {c}_a, m.{c} AS {c}_b' for c in FRAMES)} FROM h JOIN m USING (sentence_id)), l AS ({_LNG}),
c AS (SELECT label, count(*) FILTER (a = 1 AND b = 1) AS tp, count(*) FILTER (a = 0 AND b = 1) AS fp, count(*) FILTER (a = 1 AND b = 0) AS fn, count(*) AS n FROM l GROUP BY 1)"""


@query("gold_scores", f"""WITH {_GSQL} SELECT label, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS "precision", round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, n FROM c""")
def gold_scores(s, sf):
    """The gold sheet joined with the model's labels of the whole pool."""
    path = shared_folder(s, "gold")
    sinks.csv(_sheet(gold(s, sf)[0].select("sentence_id", "actor", "context", "sentence_text"), labeling.STRICT), path)
    human = _bits(readers.csv(s, path))
    model = labeling.by_lexicon(pool(s, sf)).select("sentence_id", *FRAMES)
    j = agreement.join_readers(human, model, FRAMES, suffixes=("_human", "_llm"))
    long = agreement.stack(j, {f: (f"{c}_human", f"{c}_llm") for f, c in S.FRAME_COLUMNS.items()}, ["sentence_id"])
    return agreement.prf(long).select("label", "precision", "recall", "f1", "n")


@query("gold_predictions", f"""WITH {GOLD}, m AS (SELECT sentence_id, {_hot(labeling.LEXICON)} FROM pool WHERE substr(md5(sentence_id), 1, 1) < 'c'), p AS (SELECT sentence_id, array_to_string(list_filter([{", ".join(f"CASE WHEN {c} = 1 THEN '{f}' END" for f, c in S.FRAME_COLUMNS.items())}], lambda x: x IS NOT NULL), '|') AS v FROM m)
SELECT sentence_id, coalesce(nullif(v, ''), 'None') AS predicted FROM gold_a LEFT JOIN p USING (sentence_id)""")
def gold_predictions(s, sf):
    """Gold rows with their predictions, ``None`` where the model has none for them."""
    part = pool(s, sf).where(F.substring(F.md5("sentence_id"), 1, 1) < "c")
    got = labeling.label(part, labeling.labeler_for("lexicon-v1"))
    return agreement.with_predictions(gold(s, sf)[0].select("sentence_id"), got).select("sentence_id", F.array_join("predicted", "|").alias("predicted"))


# -- language --------------------------------------------------------------------------------------------------------
@query("language_detected")
def language_detected(s, sf):
    """Documents per labelled and detected language."""
    d = table(s, sf, "documents").select("lang", "text")
    found = d.withColumn("found", language.detector(s, language.learn(d))("text"))
    return found.groupBy(language.label(F.col("lang")).alias("labelled"), F.col("found.lang").alias("detected")).agg(F.count(F.lit(1)).alias("n"))


@query("detected_english_pool")
def detected_english_pool(s, sf):
    """Filter reasons of all sentences where no column tells the language."""
    d = table(s, sf, "documents").select("doc_id", "text", "lang")
    rows = sentences.with_reason(sentences.explode(d, ["doc_id"]), profiles=language.learn(d))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


# -- inference that SQL can follow -----------------------------------------------------------------------------------
@query("m2_terms", _M2 + """, first AS (SELECT min(actor) AS a FROM q), ctx AS (SELECT context, m - (SELECT m FROM q WHERE actor = (SELECT a FROM first) AND context = 'commercial') AS c FROM q WHERE actor = (SELECT a FROM first)),
m0 AS (SELECT m AS m0 FROM q WHERE actor = (SELECT a FROM first) AND context = 'commercial'), base AS (SELECT actor, CASE WHEN bool_or(context = 'commercial') THEN 'commercial' ELSE max(context) END AS base FROM q GROUP BY 1),
eff AS (SELECT q.actor, base.base, q.m - m0 - ctx.c AS e FROM q JOIN base ON q.actor = base.actor AND q.context = base.base JOIN ctx ON ctx.context = q.context, m0)
SELECT 'Intercept' AS term, round(m0, 6) AS coef FROM m0 UNION ALL SELECT 'context[' || context || ']', round(c, 6) FROM ctx WHERE context <> 'commercial' UNION ALL SELECT 'actor[' || actor || ']', round(e, 6) FROM eff WHERE actor <> (SELECT a FROM first)
UNION ALL SELECT 'actor[' || q.actor || ']:context[' || q.context || ']', CASE WHEN q.context <> eff.base THEN round(q.m - m0 - eff.e - ctx.c, 6) END FROM q JOIN eff USING (actor) JOIN ctx ON ctx.context = q.context, m0 WHERE q.actor <> (SELECT a FROM first) AND q.context <> 'commercial'""")
def m2_terms(s, sf):
    """Coefficients of the saturated model 2, null where aliased, from the cells' means."""
    return _rows(s, m2(s, sf).table()).select("term", "coef")


@query("welch_verdict", f"""WITH w AS ({ANALYSIS_SQL['welch_t']}), p AS (SELECT *, CASE WHEN t IS NOT NULL THEN round((SELECT {_TAIL} FROM (SELECT w.t AS t, w.df AS v)), 6) END AS p FROM w)
SELECT *, coalesce(p < 0.05 AND mean_1 > mean_0, false) AS supported FROM p""")
def welch_verdict(s, sf):
    """Welch's test with its p and the verdict on individuals above institutions."""
    return statistics.welch_verdict(statistics.welch(cross_context_std(s, sf), "cross_context_std", "is_individual"))


@query("variance_bars", f"""WITH {ANALYSIS}, c AS (SELECT actor, actor_type, context, avg(innovation_score) AS m FROM ad WHERE innovation_score IS NOT NULL AND context IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
v AS (SELECT actor, actor_type, round(stddev_samp(m), 6) AS v FROM c GROUP BY ALL HAVING count(*) >= 2) SELECT actor, v AS height, CASE actor_type WHEN 'individual' THEN '#d95f02' WHEN 'company' THEN '#1b9e77' ELSE '#7570b3' END AS colour FROM v""")
def variance_bars(s, sf):
    """What the bar chart of cross-context variance shows; the chart itself goes to the shared folder."""
    palette = {"individual": "#d95f02", "company": "#1b9e77", "policymaker": "#7570b3"}
    v = cut(cross_context_std(s, sf).select("actor", "actor_type", F.col("cross_context_std").alias("height")))
    sinks.save_bytes(s, f"{shared_folder(s, 'chart')}/variance.svg", reports.bars(v, "actor", "height", "actor_type", palette).encode())
    colour = F.when(F.col("actor_type") == "individual", palette["individual"]).when(F.col("actor_type") == "company", palette["company"]).otherwise(palette["policymaker"])
    return v.select("actor", "height", colour.alias("colour"))
