"""Records with template residue, filler, error messages or demands for scripts in place of their content.

Method: sentence by sentence, placeholder and filler detectors and families of server and script messages mark what
is no content; a text is residue when something is marked and no sentence of its own is left.  Other low-information
texts (at most ``SHORT_WORDS`` words) are decided by combined evidence from the corpus.  They must speak like a message: by
weak terms, or by their words, weighed by how much more often residue found by the detectors has them than other
short texts.  And they must be a response returned for several records: the same skeleton (names and numbers masked)
on different hosts, or under different titles whose terms do not return in the body.  A row has no address here, so the
host is the actor and the title, which a slug would repeat, is the first line.

Scale: texts are judged in a map over the scan; short texts are kept once, and of those only what speaks like a
message is grouped, by a hash of its skeleton, with map-side combining.  The words that are weighed stand in ``SHARE``
of the residue rows at least, so they are at most ``SHORT_WORDS / SHARE`` (80,000).  Pages of the web platforms lose their
furniture first (``boilerplate``, with the line statistics learned there) unless a long paragraph settles the matter.

Defined results: null and blank texts are no case (they have nothing in place of content); a text that mentions
such things in sentences of its own, or has a notice at its edge, is no case unless the corpus shows it to be a response
returned for other records too; repeated rows are judged alike and count as one return; rows without a host count as one host.
"""
from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, small, spread, squash, table

PLACEHOLDER = re.compile(
    r"\{\{.{0,40}?\}\}|\{%.{0,60}?%\}|%%\w+%%|[$#]\{.{0,40}?\}|<%.{0,60}?%>|<<\w+>>|\[\[[\w ]+\]\]|@@\w+@@|\*\|\w+\|\*|__[A-Z_]+__"
    r"|\[(?:INSERT|YOUR|ENTER|ADD)\b[^\]\n]{0,40}\]|\[[A-Z_ ]+ HERE\]|\[[A-Z][A-Z_ ]+\]|(?<![\w{])\{[a-z_]+\}|\[object Object\]|<!--.{0,80}?-->"
)
# The words of the usual Latin filler text and of keyboard filler.
LOREM = frozenset(
    "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis "
    "nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
KEYS = frozenset("asdf qwer qwerty foo bar baz test testing xxx blah abc dummy zxcv hjkl".split())

_S = r"(?:java ?script|(?:client-side )?script(?:s|ing)?|active content|cookies)"
_IN = rf"(?:a modern browser with )?{_S}"
STRONG = re.compile(
    "|".join(
        (
            # filler and unfinished drafts
            r"\b(?:sample|placeholder|dummy|filler|test) text\b.{0,40}\b(?:goes here|here)|\b(?:heading|text|title|content|caption|image|copy) goes here\b",
            r"replace this (?:paragraph|text|section)|blindtext|texte factice|texto de prueba|texto de relleno|\bplaatshouder|será sustituido por|échten? text liefert|echten text liefert|viendra plus tard|título provisional|titre provisoire|arbeitstitel",
            r"\bTK TK\b|\bXX month 20XX\b|quote from spokesperson to come|boilerplate paragraph|\b(?:tbc|tbd)\s*$|^(?:undefined|null|nan|none|n/a)$|^nan results\b|content (?:coming|to come)|coming soon",
            # messages of servers
            r"^(?:error |http )?(?:4\d\d|5\d\d)(?: [A-Z][\w ]{2,30})?$|^(?:error|fehlercode|código|codigo|erreur|code)\s*:?\s*(?:4\d\d|5\d\d)\.?$",
            r"\b(?:page|file|document|article|transcript|report|press note|resource|url|site|content|link)\b.{0,60}\b(?:was not found|not found|could not be (?:found|loaded)|cannot be displayed|does not exist|no longer exists|is gone|has moved|has been (?:moved|removed|withdrawn|deleted)|timed out|failed to load|is (?:temporarily )?(?:offline|unavailable)|is (?:only|not) (?:open|available)\b.{0,30})",
            r"\b(?:seite|dokument|datei|artikel)\b.{0,40}\b(?:existiert nicht|nicht gefunden|nicht verfügbar|wurde verschoben)|\bseite nicht gefunden|page introuvable|document demandé n['’]existe|n['’]existe pas ou a été|página no encontrada|documento solicitado ya no|ya no está disponible|no está disponible",
            r"\baccess denied\b|permission to (?:view|access)|^(?:403|401)?\s*forbidden$|internal server error$|^(?:bad gateway|service unavailable|gateway timeout|not found)$|too many requests|you have made \S+ requests|slow down and try again",
            r"our server (?:\w+ ){1,5}(?:while|during)|something went wrong|something is missing|unhandled exception|null ?pointer|stack ?trace|^caused by\b|traceback|fatal error|warning: \w+\(\)|database (?:connection|error)|\bsession has expired|has been told about incident|"
            r"(?:not|isn't) available in your (?:region|country)|request \w+ was blocked|was blocked by|checking (?:that you are|your browser)|complete the check|verify (?:that )?you are (?:a )?human|are you a robot|unusual traffic|scheduled maintenance|under maintenance|down for maintenance|we(?: wi|')ll be back|back (?:soon|shortly)|maintenance window",
            r"is being updated and will be|will be back at|connection failed|could not (?:reach|connect to) host|could not find what you|page is missing|moved or deleted|お探しのページ|見つかりません|ページ(?:は|が)(?:存在|表示)|エラー|页面不存在|找不到.{0,6}页面|无法(?:访问|显示)|页面未找到|服务器(?:错误|繁忙)|الصفحة غير موجودة|لم يتم العثور|पृष्ठ नहीं मिला|पेज नहीं मिला|δεν βρέθηκε|ไม่พบหน้า|"
            r"domain (?:is for sale|has expired|is parked)|this account has been suspended|default (?:web )?page|it works!$|index of /",
            # demands for scripts
            rf"^(?:please |you (?:need|must|have) to |kindly )*(?:enable|activate|allow|permit|turn on|switch on|accept|use)\b.{{0,20}}{_IN}\b.{{0,60}}$|^(?:please )?(?:turn|switch) (?:it|{_IN}) on\b.{{0,60}}$",
            rf"^.{{0,60}}\b(?:needs?|requires?|depends? on|cannot run without|will not work without|does not work without|works best with|cannot be displayed without)\b.{{0,24}}{_S}\b.{{0,40}}$|{_S} (?:is|are) (?:disabled|turned off|switched off|not enabled|blocked|required)\b|if \S+ does not load, allow|browser is (?:currently )?blocking|^loading(?:\.\.\.|…)?$",
            r"javascript ?を有効|启用 ?javascript|تفعيل javascript|javascript (?:सक्षम|चालू)|ενεργοποιήστε .{0,12}javascript|เปิดใช้(?:งาน)? ?javascript|aktivieren sie (?:bitte )?javascript|javascript aktivieren|activer javascript|activez javascript|active javascript|activa javascript|habilite javascript|javascript (?:est|está) desactivado",
        )
    ),
    re.I,
)
# sentences that accompany a message
ASIDE = re.compile(
    r"check the address|try (?:again|the search box)|return to the .{0,40}(?:page|home)|start page|staff have been informed|when you write to|reference number|please try again|(?:trace|ray|request|incident|quote|ref\w*)\s+[0-9a-f]{6,}|"
    r"ask your administrator|browser settings|reload (?:afterwards|the page)|sign in again|contact (?:support|your administrator)|^hinweis \w+|^(?:sorry|oops|whoops|uh oh|we are sorry|hinweis|achtung|attention|error|fehler|erreur)\W*$|"
    r"will be replaced|(?:sorry|apologi[sz]e|thank you) for (?:the|any|your) (?:trouble|inconvenience|patience)|^(?:kind|best|warm) regards\W*$|er steht hier nur|le contenu de|published on$",
    re.I,
)
WEAK = re.compile(r"\b(?:error|failed|unavailable|denied|expired|blocked|forbidden|invalid|missing|offline|restricted|log ?in|sign in|subscribe|members|javascript|cookies?|scripts?|browser|template|placeholder|untitled|draft)\b", re.I)
#: Where a sentence ends; a line break inside wrapped running text is none.
_SENTENCE = re.compile(r"(?<=[.!?…。！？।؟])[\"”»’)]*\s+|(?<=[。！？।])|(?<=[:;])\n+|\n[^\S\n]*\n\s*|\n(?![a-zà-ÿα-ωά-ώ])")
_WORDS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[؀-ۿऀ-ॿ฀-๿぀-ヿ一-鿿가-힯Ͱ-ϿЀ-ӿ]")
_FINAL = ".!?…。！？।؟;:\"”»’)“"
SHORT_WORDS, OWN_WORDS, REPEATS, SHARE = 80, 6, 3, 0.001
#: Words of a message and of what accompanies it at most.
MESSAGE_WORDS, ASIDE_WORDS = 22, 20
TITLE_CHARS = 80
#: Weight of a word that residue does not have; mean weight from which a text with sentences of its own speaks like a
#: message all the same (texts without one: above 0).
UNSEEN, LIKE = -0.5, 0.5


def _filler(words: list[str]) -> bool:
    n = len(words)
    return n >= 3 and (2 * sum(w in KEYS for w in words) > n or 5 * sum(w in LOREM for w in words) >= 3 * n)


def _sentences(text: str) -> Iterator[str]:
    at = 0
    for m in _SENTENCE.finditer(text):
        if m.start() > at:
            yield text[at : m.end()].strip()
        at = m.end()
    yield text[at:].strip()


def _sentence(s: str, words: list[str], holes: list[str]) -> str:
    """What a sentence is: 'marked', 'weak', 'own' or 'none'."""
    if holes and (len(holes) * 6 >= len(words) or len(words) <= 12 * min(len(holes), 1) or s.startswith("<!--")):
        return "marked"
    if _filler(words) or len(words) <= MESSAGE_WORDS and STRONG.search(s):
        return "marked"
    if len(words) <= ASIDE_WORDS and ASIDE.search(s):
        return "weak"
    if len(words) >= OWN_WORDS and s[-1] in _FINAL or len(_DENSE.findall(s)) >= 6:
        return "own"
    return "weak" if WEAK.search(s) else "none"


def judge(text: str) -> str:
    """'residue', 'content', 'weak' (no sentence of its own, terms of a message) or 'none'.  One sentence of its own
    decides, so those too long for a message, which are told without its patterns, are looked at first."""
    def parse(s: str) -> tuple[str, list[str], list[str]]:
        holes = PLACEHOLDER.findall(s)
        return s, _WORDS.findall((PLACEHOLDER.sub(" ", s) if holes else s).lower()), holes

    later, seen = [], set()
    for s in _sentences(text):
        if s.count(" ") <= MESSAGE_WORDS:
            later.append(s)
        elif (what := _sentence(*parse(s))) == "own":
            return "content"
        else:
            seen.add(what)
    for s in later:
        if s and (what := _sentence(*parse(s))) == "own":
            return "content"
        elif s:
            seen.add(what)
    return "residue" if "marked" in seen else "weak" if "weak" in seen else "none"


def short(text: str) -> bool:
    return len(list(islice(_WORDS.finditer(text), SHORT_WORDS + 1))) <= SHORT_WORDS


def skeleton(text: str) -> str:
    """The text with names and numbers masked."""
    return " ".join(re.sub(r"\b[A-ZÀ-Þ]\w+|\w*\d\w*", "X", text).split())


def titles(text: str) -> tuple[str, bool]:
    """(first line of a text, whether it is a title no term of which returns in the rest of the text)."""
    text = text.strip()
    first = text.split("\n", 1)[0].strip()
    terms = lambda x: {w for w in _WORDS.findall(x.lower()) if len(w) > 3}
    rest = text[len(first) :]
    own = terms(first)
    title = 0 < len(first) <= TITLE_CHARS and first[-1] not in _FINAL
    return first, title and bool(own and rest.strip()) and not own & terms(rest)


def weights(judged: DataFrame) -> dict[str, float]:
    """Log ratio of the shares of residue and of other short texts that have a word, for words of residue."""
    n = judged.agg(F.count_if(F.col("verdict") == "residue").alias("r"), F.count_if(F.col("verdict") != "residue").alias("o")).first()
    words = judged.select("verdict", F.explode("words").alias("word")).groupBy("word").agg(F.count_if(F.col("verdict") == "residue").alias("r"), F.count_if(F.col("verdict") != "residue").alias("o"))
    rows = words.where(F.col("r") >= max(2, math.ceil(SHARE * n["r"]))).collect()
    return {x["word"]: math.log((x["r"] + 0.5) / (n["r"] + 1)) - math.log((x["o"] + 0.5) / (n["o"] + 1)) for x in rows}


def verdicts(docs: DataFrame, key: str = "doc_id", text: str = "body", host: str = "host") -> DataFrame:
    """(key, signal) of each row that is residue: 'detector', 'hosts' or 'titles'; ``text`` is the main content."""
    kind = dict(docs.dtypes)[key]

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = []
            for d, t, h in zip(pdf[key], pdf[text], pdf[host]):
                if not t or t.isspace():
                    continue
                v, brief = judge(t), short(t)
                if v != "residue" and not brief:
                    continue
                title, said = None, t
                if v != "residue":
                    first, differs = titles(t)
                    if differs:  # a title that says nothing of its body is no part of the message
                        title, said = first, t.strip()[len(first) :]
                words = sorted(set(_WORDS.findall(said.lower()))) if brief else []
                rows.append((d, h or "", v, words, skeleton(said) if v != "residue" else None, title))
            if rows:
                yield pd.DataFrame(rows, columns=[key, "host", "verdict", "words", "skeleton", "title"])

    judged = docs.select(key, text, host).mapInPandas(run, f"{key} {kind}, host string, verdict string, words array<string>, skeleton string, title string")
    judged = cut(judged.withColumn("skeleton", F.xxhash64("skeleton")))
    found = judged.where("verdict = 'residue'").select(key, F.lit("detector").alias("signal"))
    shared = docs.sparkSession.sparkContext.broadcast(weights(judged))

    @F.pandas_udf("double")
    def message(words: pd.Series) -> pd.Series:
        w = shared.value
        return pd.Series([float(sum(w.get(x, UNSEEN) for x in ws)) / max(len(ws), 1) for ws in words], dtype="float64")

    like = (F.col("verdict") == "weak") | ((F.col("verdict") == "none") & (F.col("like") > 0)) | (F.col("like") >= LIKE)
    said = cut(judged.where("verdict != 'residue'").withColumn("like", message("words")).where(like).select(key, "host", "skeleton", "title"))
    # returned on several hosts, or on one under titles that its body doesn't answer
    common = said.groupBy("skeleton").agg(F.countDistinct(key).alias("n"), F.countDistinct("host").alias("hosts"), F.countDistinct("title").alias("titles"))
    common = common.where((F.col("n") >= REPEATS) & ((F.col("hosts") >= 2) | (F.col("titles") >= REPEATS))).select("skeleton", F.when(F.col("hosts") >= 2, "hosts").otherwise("titles").alias("signal"))
    return found.unionByName(said.join(small(common), "skeleton").select(key, "signal"))


def bodies(spark: SparkSession, sf: str) -> DataFrame:
    """corpus with ``body``: the text without the furniture of web pages."""
    from .boilerplate import WEB, article_text, learn, plain_content

    docs = spread(table(spark, sf, "corpus").select("doc_id", "text", squash(F.col("actor")).alias("host"), squash(F.col("platform")).alias("platform")))
    docs = docs.withColumn("web", F.coalesce(F.col("platform").isin(*WEB), F.lit(False)))
    shared = spark.sparkContext.broadcast(learn(docs.where("web"), "text", "host"))

    @F.pandas_udf("string")
    def strip(t: pd.Series, web: pd.Series, host: pd.Series) -> pd.Series:
        m = shared.value
        return pd.Series([(plain_content(x, m, h) or article_text(x, m, h, False)) if w and x else x for x, w, h in zip(t, web, host)], dtype=object)

    return docs.select("doc_id", "host", strip("text", "web", "host").alias("body"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    """Rows whose text has residue in place of its content."""
    return verdicts(bodies(spark, sf)).select("doc_id").distinct()


def p4_signals(spark: SparkSession, sf: str) -> DataFrame:
    """How many documents each signal decides."""
    return verdicts(bodies(spark, sf)).groupBy("signal").agg(F.countDistinct("doc_id").alias("n_docs"))


def p4_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct documents that remain, per platform."""
    docs = table(spark, sf, "corpus").select("doc_id", squash(F.col("platform")).alias("platform")).distinct()
    return docs.join(p4_found(spark, sf), "doc_id", "left_anti").groupBy("platform").agg(F.count(F.lit(1)).alias("n_docs"))


QUERIES = {"p4_found": p4_found, "p4_clean": p4_clean, "p4_signals": p4_signals}
