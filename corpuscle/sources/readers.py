"""Readers: raw JSON documents, CSV, sheets, PDFs, feeds, indexes and remote pages.

Nothing here infers a schema or reads through the driver; malformed input becomes rows that are left out.
"""
from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..functions import dates, html
from ..functions.text import to_bit_half


def raw_documents(spark: SparkSession, *paths: str) -> DataFrame:
    """One JSON object per file, recursively; files that are no JSON and folders that start with _ are skipped."""
    schema = S.RAW_DOC + ", _corrupt_record string"
    df = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(list(paths))
    df = df.withColumn("_path", F.col("_metadata.file_path")).where(~F.col("_path").rlike(r"/_[^/]*/"))
    return df.where("_corrupt_record is null and url is not null").drop("_corrupt_record", "_path")


def csv(spark: SparkSession, path: str, columns: str | None = None) -> DataFrame:
    """All-string CSV with a header, quotes doubled, line breaks inside fields."""
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("quote", '"')
    if columns:
        r = r.schema(", ".join(f"`{c}` string" for c in S.columns(columns)))
    return r.csv(path)


def done_ids(spark: SparkSession, path: str, column: str = "sentence_id") -> DataFrame:
    return csv(spark, path).select(column).distinct()


def _sheet_rows(data: bytes) -> list[list[str | None]]:
    """Cells of the first sheet of a workbook, from its zipped XML."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(f"{{{ns['m']}}}t")) for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).findall("m:si", ns)]
        first = sorted(n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n))[0]
        out = []
        for row in ElementTree.fromstring(z.read(first)).iter(f"{{{ns['m']}}}row"):
            cells: list[str | None] = []
            for c in row.findall("m:c", ns):
                at = 0
                for ch in re.match(r"[A-Z]+", c.get("r", "A1")).group():
                    at = at * 26 + ord(ch) - 64
                cells += [None] * (at - 1 - len(cells))
                v, inline = c.find("m:v", ns), c.find("m:is", ns)
                if inline is not None:
                    cells.append("".join(t.text or "" for t in inline.iter(f"{{{ns['m']}}}t")))
                elif v is None:
                    cells.append(None)
                else:
                    cells.append(shared[int(v.text)] if c.get("t") == "s" else v.text)
            out.append(cells)
    return out


def sheets(spark: SparkSession, path: str, columns: str = S.ANNOTATION_SHEET) -> DataFrame:
    """Annotation workbooks as rows of strings, by header; columns that a sheet lacks are null."""
    names = S.columns(columns)

    def rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            for data in pdf["content"]:
                try:
                    head, *body = _sheet_rows(bytes(data))
                except (zipfile.BadZipFile, IndexError, ElementTree.ParseError, ValueError):
                    continue
                at = {h: i for i, h in enumerate(head) if h}
                yield pd.DataFrame({n: [r[at[n]] if n in at and at[n] < len(r) else None for r in body] for n in names}, dtype=object)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, ", ".join(f"`{n}` string" for n in names))


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\nendstream", re.S)
_SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:[^\]]*)\]\s*TJ|T\*|Td|TD|ET")
_PIECE = re.compile(rb"\(((?:\\.|[^\\()])*)\)")


def pdf_text(data: bytes) -> str:
    """Text shown by the page streams of a PDF with simple encodings, blanks collapsed."""
    out = []
    for raw in _STREAM.findall(data):
        try:
            raw = zlib.decompress(raw)
        except zlib.error:
            pass
        for op in _SHOW.findall(raw):
            if op in (b"T*", b"Td", b"TD", b"ET"):
                out.append(" ")
                continue
            for piece in _PIECE.findall(op):
                out.append(re.sub(rb"\\([()\\])", rb"\1", piece).decode("latin-1"))
    return " ".join("".join(out).split())


@F.pandas_udf(T.StringType())
def pdf_column(content: pd.Series) -> pd.Series:
    """Text of PDF bytes; null where there is none."""
    return content.map(lambda b: None if b is None else pdf_text(bytes(b)) or None)


def _long_enough(c, least: int):
    return F.coalesce(F.size(F.split(c, " ")) >= least, F.lit(False))


def pdfs(spark: SparkSession, path: str, manifest: DataFrame, least_words: int = 200) -> DataFrame:
    """PDF texts joined with their manifest (by file name), those with too few words left out."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split(F.col("path"), "/"), -1).alias("filename"), pdf_column("content").alias("text"))
    return files.join(manifest, "filename").where(_long_enough("text", least_words))


def fetched_pdfs(urls: DataFrame, get: Callable[[str], tuple[int, bytes]], least_words: int = 500) -> DataFrame:
    """(url, text) of PDFs behind addresses, those with too few words left out."""
    return fetch(urls, get, kind="binary").select("url", pdf_column("html").alias("text")).where(_long_enough("text", least_words))


def annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotation workbooks with 0/1 labels: cells count from 0.5 on, anything else is 0."""
    labels = ["Innovation_Progress", "Economic_Benefit", "Risk_Harm", "Regulation_Governance", "Existential_AGI", "None"]
    return sheets(spark, path).select(*[to_bit_half(c).alias(c) if c in labels else F.col(c) for c in S.columns(S.ANNOTATION_SHEET)])


def sitemap(spark: SparkSession, path: str, fragment: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.explode(html.sitemap("value", fragment)).alias("url")).distinct()


def archive_index(spark: SparkSession, path: str, first: str = "", last: str = "", most: int | None = None) -> DataFrame:
    """(urlkey, timestamp, original, status) of an archive index (JSON rows under a header row): captures with status 200
    between two stamps, of each key the first, of the keys the first ``most``."""
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", "array<array<string>>").alias("a"))
    rows = rows.select(F.col("a")[0].alias("names"), F.explode(F.slice("a", 2, F.greatest(F.size("a") - 1, F.lit(0)))).alias("r")).where(F.size("r") == F.size("names"))
    get = lambda c: F.try_element_at(F.map_from_arrays("names", "r"), F.lit(c))
    status = F.coalesce(get("statuscode"), get("status"), F.lit("200"))
    cols = rows.select(F.coalesce(get("urlkey"), get("original")).alias("urlkey"), get("timestamp").alias("timestamp"), get("original").alias("original"), status.alias("status"))
    cols = cols.where((F.col("status") == "200") & (F.col("timestamp") >= first) & (F.lit(not last) | (F.col("timestamp") <= F.lit(last))))
    one = cols.groupBy("urlkey").agg(F.min(F.struct("timestamp", "original", "status")).alias("x")).select("urlkey", "x.*")
    return one if most is None else one.orderBy("urlkey").limit(most)


def snapshots(index: DataFrame, get: Callable[[str], tuple[int, str]], base: str) -> DataFrame:
    """(original, date, html): the archived page of each row of an index."""
    want = index.select("original", dates.compact_day("timestamp").alias("date"), html.snapshot_url(base, F.col("timestamp"), F.col("original")).alias("url"))
    return fetch(want, get).join(want, "url").select("original", F.coalesce("date", F.lit("unknown")).alias("date"), "html")


def feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of an Atom feed: (url, title, abstract, date); entries without id or summary are left out."""
    schema = "id string, title string, summary string, published string"
    df = spark.read.format("xml").option("rowTag", "entry").schema(schema).load(path)
    blank = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    return df.where("id is not null and summary is not null").select(html.preprint_id(F.col("id")).alias("url"), blank("title").alias("title"), blank("summary").alias("abstract"), F.substring("published", 1, 10).alias("date"))


def search_pages(bodies: DataFrame, site: str = "", body: str = "body") -> DataFrame:
    """(total, url, date) of the results in paged JSON answers; links of the site are made absolute."""
    hits = F.from_json(F.get_json_object(body, "$.results"), "array<struct<link:string,public_timestamp:string>>")
    rows = bodies.select(html.paged_total(body).alias("total"), F.explode(hits).alias("h")).where("h.link <> ''")
    url = F.when(F.startswith("h.link", F.lit("/")), F.concat(F.lit(site), F.col("h.link"))).otherwise(F.col("h.link"))
    return rows.select("total", url.alias("url"), F.substring(F.coalesce("h.public_timestamp", F.lit("unknown")), 1, 10).alias("date"))


def search(spark: SparkSession, get: Callable[[str], tuple[int, str]], template: str, site: str = "", count: int = 50, most: int = 500) -> DataFrame:
    """All pages of a search: the first tells the total, the others are fetched side by side.  ``template`` has
    ``{start}`` and ``{count}``."""
    address = lambda start: template.replace("{start}", str(start)).replace("{count}", str(count))
    from ..session import cut

    first = cut(fetch(spark.createDataFrame([(address(0),)], "url string"), get))
    total = first.select(F.coalesce(html.paged_total("html"), F.lit(0))).first()[0]
    rest = [(address(s),) for s in range(count, min(int(total), most), count)]
    pages = first.unionByName(fetch(spark.createDataFrame(rest, "url string"), get)) if rest else first
    return search_pages(pages, site, "html").select("url", "date").distinct()


def news_pages(pages: DataFrame, body: str = "body", page: str = "page", size: int = 100, most: int = 5) -> DataFrame:
    """(url, title, description, date) of the articles in numbered answers of a news service.  Reading stops at an
    answer that is not ok or not full, when the total is reached, and after ``most`` pages."""
    from pyspark.sql.window import Window as W

    item = "array<struct<url:string,title:string,description:string,publishedAt:string>>"
    rows = pages.where(F.col(page).between(1, most)).select(
        F.col(page).alias("page"), (F.get_json_object(body, "$.status") == "ok").alias("ok"), F.coalesce(F.from_json(F.get_json_object(body, "$.articles"), item), F.array().cast(item)).alias("items"),
        F.coalesce(F.expr(f"try_cast(get_json_object({body}, '$.totalResults') AS bigint)"), F.lit(0)).alias("total"),
    )
    before = W.partitionBy(F.lit(0)).orderBy("page").rowsBetween(W.unboundedPreceding, -1)  # at most ``most`` rows
    n = F.coalesce(F.sum(F.size("items")).over(before), F.lit(0))
    ends = ~F.coalesce("ok", F.lit(False)) | (F.size("items") < size)
    stopped = F.coalesce(F.max(ends.cast("int")).over(before), F.lit(0)) == 1
    full = F.coalesce(F.max("total").over(before) <= n, F.lit(False))
    rows = rows.withColumn("live", F.col("ok") & ~stopped & ~full)
    got = rows.where("live").select("page", F.posexplode("items").alias("at", "x"))
    url = F.regexp_replace(F.regexp_replace("x.url", r"\?.*$", ""), "/+$", "")
    got = got.select(url.alias("url"), F.coalesce("x.title", F.lit("")).alias("title"), F.coalesce("x.description", F.lit("")).alias("description"), F.substring("x.publishedAt", 1, 10).alias("date"), "page", "at").where("url <> ''")
    return got.groupBy("url").agg(F.min(F.struct("page", "at", "title", "description", "date")).alias("x")).select("url", "x.title", "x.description", "x.date")


def talks(pages: DataFrame, speakers: DataFrame, path: str = "/talks/", tail: str = "/transcript") -> DataFrame:
    """(url, speaker): transcript addresses of the talk links whose surrounding text names a speaker (of several the
    least)."""
    from ..session import small

    found = pages.select(F.col("url").alias("page"), F.explode(html.links_with_text("html")).alias("l")).where(F.contains("l.href", F.lit(path)) & ~F.contains("l.href", F.lit(tail)))
    origin = F.regexp_extract("page", "^(https?://[^/]+)", 1)
    slug = F.regexp_extract("l.href", f"{re.escape(path)}([^/?#]+)", 1)
    found = found.select(F.concat(origin, F.lit(path), slug, F.lit(tail)).alias("url"), F.lower("l.near").alias("near")).where(slug != "")
    hits = found.join(small(speakers.select("speaker")), F.expr("contains(near, lower(speaker))"))
    return hits.groupBy("url").agg(F.min("speaker").alias("speaker"))


def registry(spark: SparkSession, rows: list[tuple], columns: str, dated: str | None = None) -> DataFrame:
    """A static table of sources; ``dated`` builds addresses from its ``date``."""
    out = spark.createDataFrame(rows, columns)
    return out if dated is None else out.withColumn("url", F.replace(F.lit(dated), F.lit("{date}"), F.col("date")))


def dispatch(builders: dict[str, Callable], source: str) -> Callable | None:
    """The builder of the first key, in order, that occurs in a source's name."""
    return next((b for k, b in builders.items() if k in source.lower()), None)


def fetch(urls: DataFrame, get: Callable[[str], tuple[int, str | bytes]], blocked: tuple[int, ...] = (401, 403, 404, 410, 429), kind: str = "string") -> DataFrame:
    """(url, status, html) by a pluggable ``get``; blocked statuses and failures give null html."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for u in pdf["url"]:
                try:
                    status, body = get(u)
                    rows.append((u, status, None if status in blocked else body))
                except Exception:  # noqa: BLE001
                    rows.append((u, None, None))
            if rows:
                yield pd.DataFrame(rows, columns=["url", "status", "html"]).astype({"status": "Int32"})

    return urls.select("url").mapInPandas(run, f"url string, status int, html {kind}")


def crawl(seeds: DataFrame, get: Callable[[str], tuple[int, str]], rounds: int, accept: str = ".*") -> DataFrame:
    """Pages reached from ``seeds`` within ``rounds`` of following accepted links; ends when none is new.  Only the
    count of new links returns to the driver."""
    from ..session import cut

    pages = cut(fetch(seeds, get))
    seen, front = pages.select("url"), pages
    for _ in range(rounds):
        new = html.links(front).select(F.col("link").alias("url")).where(F.col("url").rlike(accept)).distinct().join(seen, "url", "left_anti")
        front = cut(fetch(new, get))
        if not front.count():
            break
        pages, seen = pages.unionByName(front), seen.union(front.select("url"))
    return pages


def listings(sites: DataFrame, get: Callable[[str], tuple[int, str]], want: int, rounds: int = 30, patience: int = 3) -> DataFrame:
    """(site, link): posts found on the numbered pages of many listings (``url/page/N``, else ``url?page=N``).  A site
    ends after ``patience`` pages without a new link or with three times the links it ``want``s; all sites turn a
    page together."""
    from ..session import cut

    def posts(pages: DataFrame) -> DataFrame:
        return html.links(pages).join(pages.select("url", "site"), "url").where(html.is_post(F.col("link"), F.col("site"))).select("site", "link").distinct()

    sites = sites.select(F.col("url").alias("site")).distinct()
    found = cut(posts(fetch(sites.withColumnRenamed("site", "url"), get).withColumn("site", F.col("url"))))
    state = sites.withColumn("idle", F.lit(0))
    for page in range(2, rounds + 2):
        n = found.groupBy("site").agg(F.count(F.lit(1)).alias("n"))
        state = cut(state.join(n, "site", "left").where((F.col("idle") < patience) & (F.coalesce("n", F.lit(0)) < 3 * want)).select("site", "idle"))
        if not state.count():
            break
        styles = F.array(F.concat("site", F.lit(f"/page/{page}")), F.concat("site", F.lit(f"?page={page}")))
        tries = state.select("site", F.posexplode(styles).alias("style", "url"))
        pages = cut(fetch(tries, get).join(tries, "url").where("html is not null"))
        best = pages.groupBy("site").agg(F.min_by(F.struct("url", "html"), "style").alias("x")).select("site", "x.*")
        new = cut(posts(best).join(found, ["site", "link"], "left_anti"))
        found = cut(found.unionByName(new))
        turned = new.select("site").distinct().withColumn("new", F.lit(True))
        state = state.join(turned, "site", "left").select("site", F.when(F.col("new"), 0).otherwise(F.col("idle") + 1).alias("idle"))
    return found


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """Any SQL over named tables."""
    for name, df in tables.items():
        df.createOrReplaceTempView(name)
    return spark.sql(sql)
