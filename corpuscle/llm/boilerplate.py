"""The main body of web pages whose text mixes it with menus, notices, teasers and footers.

Method: each page runs through the standard library's streaming parser; per line, text and tag events give a
text-to-tag ratio.  Pages mostly come stripped of their markup, so what stood in tags is told by what is left of them:
the marks between links (bullets, separators, ellipses) count as tags, and the text of controls, notices and links
(families of them, and lines that return on many pages: learned counts, and how often a paragraph follows, tell menus from
headings) is text of tags, with a ratio of nothing.  The ratios are smoothed by a Gaussian and clustered by a threshold
into content regions, which decide.  Corrections follow at the edges of regions only, for lines too short for a
ratio to tell: the title before the first paragraph, headings that lead to something of the article, list items, and a
paragraph next to a region.

Scale: one aggregation of masked short lines (map-side combining; only lines on at least ``SHARE`` of the pages travel
to the tasks, at most ``1 / SHARE`` times the lines of a page), then a map over the scan.

Defined results: null and blank texts have no lines; a page whose body is residue (an error, filler, a demand for
scripts) has no article; line numbers count ``\\n`` from 0; repeated rows are treated alike.
"""
from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import spread, squash, table

WEB = ("blog", "regulatory_doc")
SHARE, SIGMA = 0.001, 1.5
#: Bounds of the threshold.
LEAST, MOST = 8.0, 20.0

_TAGLIKE = re.compile(r"[|·›»•☰►▸→]|\s{2,}\S|^\s*[*+]\s|…$")
_END = re.compile(r"[.!?。！？।؟]['\"”»’)\]]*$")
_LIST = re.compile(r"^\s*(?:[•*·‣▪\-–]\s+|\(?\d{1,2}[.)]\s+|[a-z][.)]\s+)")
#: Longer lines are no controls or links, and notices only by their sentences; learned ones are counted by hash.
LONG, HASHED = 160, 120
_CRUMB = re.compile(r"^(?:home|accueil|inicio|startseite)\s*[/>»]", re.I)
_SEPARATED = re.compile(r"\s*[|·•/›]\s*|\s{2,}|\t")

CONTROL = re.compile(
    r"^\W*(?:"
    r"☰.*|(?:main )?menu|navigation|search(?: this site)?|suche|recherche|buscar|skip to .*|jump to .*|zum inhalt.*|aller au contenu.*|saltar al .*|sitemap|"
    r"(?:sign|log) ?in(?: */ *register)?|register|anmelden|se connecter|iniciar sesión|back to top|nach oben|retour en haut|volver arriba|"
    r"select language.*|sprache.*:.*|langue *:.*|idioma *:.*|"
    r"(?:accept|reject|allow|decline|refuse)(?: all)?(?: cookies)?|got it|ok|only necessary|manage (?:preferences|cookie settings)|(?:cookie|privacy) settings|alle akzeptieren|alle ablehnen|tout (?:refuser|accepter)|aceptar todo|rechazar todo|"
    r"share(?: this \w+)?(?:\s*[|·].*)?|copy link|print(?: this page)?|email|(?:artikel|seite) teilen|partager cet .*|compartir este .*|"
    r"follow (?:us|\S+(?: \S+){0,3})|suivez(?:-nous)?(?: \S+){0,4}|folgen sie(?: \S+){0,4}|sigue a(?: \S+){0,4}|síguenos|"
    r"advertisement|sponsored(?: content)?|anzeige|publicité|publicidad|"
    r"[\d,.]+ comments?|[\d.,]+ (?:kommentare|commentaires|comentarios)|was this page helpful.*|listen to this article.*|\d+ (?:min(?:ute)?s?)\.? (?:read|lesezeit|de lecture|de lectura)|"
    r"contact the press office|subscribe(?: to our newsletter| now)?|enter your email address|newsletter(?: abonnieren)?|"
    r"privacy(?: notice| policy)?|terms(?: of (?:service|use))?|imprint|impressum|datenschutz|mentions légales|aviso legal|accessibility|cookies|"
    r"(?:©|\(c\)|copyright\b).*|.*\ball rights reserved\.?|.*alle rechte vorbehalten\.?|.*tous droits réservés\.?|.*todos los derechos reservados\.?|"
    r"registered office:.*|\d+ [A-Z]\w+ (?:road|street|avenue|lane|square|quay)\b,? ?.{0,30}"
    r")\W*$",
    re.I,
)
NOTICE = re.compile(
    r"^(?:we use cookies\b.*|.*\bagree to the use of cookies\b.*|.*\bread our cookie policy\b.*|this (?:site|website) (?:uses cookies|stores small files)\b.*|your privacy choices\b.*|can we (?:store|use|set) .*\bcookies\b.*|.*\bprocess personal data to show\b.*|"
    r"wir verwenden cookies\b.*|nous utilisons des (?:traceurs|cookies)\b.*|utilizamos cookies\b.*|usamos cookies\b.*|"
    r"sign up for (?:updates|our)\b.*|get the .{2,40} (?:briefing|newsletter)\b.*|.*\bstraight to your inbox\b.*|recevez notre lettre\b.*|recibe nuestro boletín\b.*|erhalten sie unseren\b.*|no spam\b.*|"
    r"please enable javascript to view the comments\W*|built with care by\b.*|.*\bnot responsible for the content of external (?:sites|links)\W*)$",
    re.I,
)
#: Words that each notice has, and the beginnings of lines of rights and addresses.
_HINTS = ("cookie", "traceur", "stores small files", "privacy choices", "personal data", "sign up for", "briefing", "newsletter", "inbox", "notre lettre", "boletín", "erhalten sie", "no spam", "javascript to view", "built with care", "external sites", "external links")
_RIGHTS = re.compile(r"^\W*(?:(?:©|\(c\)|copyright (?:©|\d{4}))|registered office:)", re.I)
_CUT = re.compile(r"(?<=[.!?。！？])\s+")
INLINE = re.compile(r"^(?:related|read more|read also|see also|more|also read|mehr zum thema|lesen sie auch|siehe auch|à lire aussi|lire aussi|voir aussi|lea también|lee también|ver también|más sobre [^:]{0,30}|relacionado)\s*:\s+\S", re.I)
TEASERS = re.compile(
    r"^(?:you may also like|keep reading|most (?:read|popular|viewed)|more from .{2,40}|in this series|read next|up next|recommended(?: for you)?|related (?:posts|articles|stories|content)|popular (?:this week|now|posts)|latest (?:updates|news|posts)|trending(?: now)?|editor'?s picks|more (?:stories|articles|news)|"
    r"meistgelesen|das könnte sie auch interessieren|mehr zum thema|mehr von .{2,40}|aktuelle beiträge|verwandte artikel|les plus lus|dans le même dossier|à lire aussi|articles liés|sur le même sujet|lo más leído|te puede interesar|más sobre este tema|artículos relacionados|también te puede interesar)\W*$",
    re.I,
)


class _Lines(HTMLParser):
    """Text and tags per line, from parser events; scripts and styles are no text."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: dict[int, str] = {}
        self.tags: Counter = Counter()
        self.hidden = False

    def handle_starttag(self, tag, attrs):
        self.tags[self.getpos()[0] - 1] += 1
        self.hidden = tag in ("script", "style")

    def handle_endtag(self, tag):
        self.tags[self.getpos()[0] - 1] += 1
        self.hidden = False

    def handle_data(self, data):
        at = self.getpos()[0] - 1
        if not self.hidden:
            for i, part in enumerate(data.split("\n")):
                self.text[at + i] = self.text.get(at + i, "") + part


def visible(text: str) -> tuple[list[str], list[int]]:
    """The text of each line, and the tags in it."""
    lines = text.split("\n")
    if "<" in text and ">" in text:
        p = _Lines()
        p.feed(text)
        p.close()
        if p.tags:
            return [p.text.get(i, "") for i in range(len(lines))], [p.tags[i] for i in range(len(lines))]
    return lines, [0] * len(lines)  # no tag: each line is one text event


def densities(lines: list[str], tags: list[int], linked: list[bool]) -> np.ndarray:
    """Text-to-tag ratio of each line; ``linked``: its text is that of tags."""
    return np.array([0.0 if a else len(s) / (1 + t + len(_TAGLIKE.findall(s))) for s, t, a in zip(map(str.strip, lines), tags, linked)], dtype=float)


def smooth(r: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    k = np.arange(-int(3 * sigma), int(3 * sigma) + 1)
    g = np.exp(-(k**2) / (2 * sigma**2))
    return np.convolve(r, g / g.sum(), mode="full")[len(k) // 2 : len(k) // 2 + len(r)]


def regions(r: np.ndarray) -> np.ndarray:
    """Which lines lie in a content region: a ratio of their own, and a smoothed one above half the page's standard deviation."""
    return (smooth(r) >= max(LEAST, min(float(r.std()) / 2, MOST))) & (r > 0) if len(r) else r > 0


def _long_notice(s: str) -> bool:
    """Whether a long line is a notice: its first sentence is one, or at least half of them are."""
    if _RIGHTS.match(s) or INLINE.match(s):
        return True
    low = s.lower()
    if not any(h in low for h in _HINTS):
        return False
    parts = [bool(NOTICE.match(x)) for x in _CUT.split(s) if x]
    return parts[0] or 2 * sum(parts) >= len(parts)


def _hashed(line: str, host: str | None) -> str:
    """The key under which a line longer than ``HASHED`` is counted."""
    return "\x01" + blake2b(mask.__wrapped__(line, host).encode("utf-8", "surrogatepass"), digest_size=10).hexdigest()


@lru_cache(maxsize=1 << 17)
def mask(line: str, host: str | None) -> str:
    """A line with its numbers and the page owner's name masked, for counting."""
    s = re.sub(r"\d[\d.,]*", "9", " ".join(line.split()).lower())
    return s.replace(host, "@") if host else s


def _paragraph(line: str) -> bool:
    """Running text: a finished sentence of some length."""
    s = line.strip()
    return len(s) >= 40 and bool(_END.search(s)) or len(s) >= 20 and s.count(" ") >= 3 and bool(_END.search(s)) or len(s) >= 160


class Model:
    """common: {masked short line: share followed by a paragraph}; notices: masked sentences on many pages, long
    lines by their hash."""

    def __init__(self, common: dict[str, float], notices: set[str]):
        self.common, self.notices = common, notices
        self.hashes = any(x[0] == "\x01" for x in notices)

    def knows(self, line: str, host: str | None) -> bool:
        """Whether a line of more than ``HASHED`` characters is a learned notice."""
        return self.hashes and len(line) > HASHED and _hashed(line, host) in self.notices


def learn(pages: DataFrame, text: str = "text", host: str = "host") -> Model:
    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            n, before, pages, first, last = Counter(), Counter(), 0, {}, {}
            for t, h in zip(pdf[text], pdf[host]):
                if not t or t.isspace():
                    continue
                pages += 1
                lines = [x for x in visible(t)[0] if x.strip()]
                seen = {}
                page = int.from_bytes(blake2b(t.encode("utf-8", "surrogatepass"), digest_size=7).digest())
                for x, y in zip(lines, [*lines[1:], ""]):
                    if len(x) <= HASHED:
                        seen[mask(x, h)] = _paragraph(y) and not NOTICE.match(y.strip())
                    else:
                        k = _hashed(x.strip(), h)
                        seen[k] = False
                        first[k], last[k] = min(page, first.get(k, page)), max(page, last.get(k, page))
                n.update(seen.keys())
                before.update(k for k, v in seen.items() if v)
            yield pd.DataFrame({"line": ["", *n], "n": [pages, *n.values()], "before": [0, *(before[k] for k in n)], "least": [0, *(first.get(k, 0) for k in n)], "most": [0, *(last.get(k, 1) for k in n)]})

    c = pages.select(text, host).mapInPandas(count, "line string, n bigint, before bigint, least bigint, most bigint")
    # a long line of one page that is repeated as a whole is no notice
    c = c.groupBy("line").agg(F.sum("n").alias("n"), F.sum("before").alias("before"), F.min("least").alias("least"), F.max("most").alias("most"))
    c = c.persist()
    total = (c.where("line = ''").agg(F.max("n")).first()[0]) or 0
    rows = c.where((F.col("line") != "") & (F.col("n") >= max(3, math.ceil(SHARE * total))) & (F.col("least") < F.col("most"))).collect()
    c.unpersist()
    sentence = {r["line"] for r in rows if r["line"][0] == "\x01" or _END.search(r["line"]) and r["line"].count(" ") >= 3}
    common = {r["line"]: r["before"] / r["n"] for r in rows if r["line"] not in sentence}
    floor = max(5, 0.004 * total)
    return Model(common, {r["line"] for r in rows if r["line"] in sentence and r["n"] >= floor})


BLANK, DROP, TEASER, LINK, PARA, ITEM, SHORT = range(7)


@lru_cache(maxsize=1 << 17)
def _family(line: str) -> int:
    """What a line is by itself: a notice or control, a teaser header, a link, a list item, running text or short."""
    s = line.strip()
    if not s:
        return BLANK
    if len(s) > LONG:
        if _long_notice(s):
            return DROP
        return ITEM if _LIST.match(line) and not _paragraph(_LIST.sub("", line)) else PARA
    if TEASERS.match(s):
        return TEASER
    if CONTROL.match(s) or NOTICE.match(s) or INLINE.match(s) or s[0] in "→►▸»" or "›" in s or _CRUMB.match(s):
        return DROP
    parts = [p for p in _SEPARATED.split(s) if p]
    if len(parts) >= 3 and not _END.search(s) and sum(len(p.split()) <= 3 for p in parts) == len(parts):
        return DROP
    if _LIST.match(line):
        return ITEM
    if len(s) > 40 and s.endswith(("…", "...")) and len(s) < 130 and not re.search(r"[.!?] ", s):
        return LINK
    return PARA if _paragraph(s) else SHORT


@lru_cache(maxsize=1 << 16)
def _message(line: str) -> bool:
    """Whether a line by itself is, or may be, a message in place of content."""
    from .residue import judge

    return judge(line.strip()) in ("residue", "weak")


def _classify(lines: list[str], m: Model, host: str | None, judging: bool = False) -> list[int]:
    """What each line is; for ``judging`` a page, messages stay what they are however many pages have them."""
    out = []
    for x in lines:
        k = alone = _family(x)
        if k in (ITEM, PARA, SHORT) and m.knows(x.strip(), host):
            k = alone if judging and _message(x) else DROP
        elif k in (ITEM, PARA, SHORT) and len(x) <= LONG:
            key = mask(x.strip(), host)
            if key == "@" or key in m.notices:
                k = DROP
            elif k == ITEM:
                bare = mask(_LIST.sub("", x), host)
                if len(bare.split()) <= 3 and m.common.get(key, m.common.get(bare, 1.0)) < 0.8:
                    k = LINK
            elif k == SHORT and len(key.split()) <= 4 and m.common.get(key, 1.0) < 0.5:
                k = LINK
            if judging and k != alone and key != "@" and _message(x):
                k = alone
        out.append(k)
    return out


def plain_content(text: str, m: Model, host: str | None) -> str | None:
    """A long paragraph that is content beyond doubt and no notice, if the page has one."""
    from .residue import judge

    for x in visible(text)[0]:
        s = x.strip()
        if len(s) > LONG and judge(s) == "content" and _family(x) != DROP and not m.knows(s, host):
            return s
    return None


def bounds(inside: np.ndarray, full: list[int], kind: list[int], heads: set[int]) -> set[int]:
    """Lines inside or next to a content region of the non-blank lines; a list goes on as long as its items do, and
    a learned heading that follows takes the paragraph that it leads with it."""
    near = [bool(inside[max(0, k - 1) : k + 2].any()) for k in range(len(full))]
    chain = [k for k in range(len(full)) if kind[full[k]] != DROP]  # a control between them parts no lines
    for last, k in zip(chain, chain[1:]):
        near[k] = near[k] or near[last] and (kind[full[k]] == ITEM or full[k] in heads or kind[full[k]] == PARA and full[last] in heads)
    for last, k in zip(chain[::-1], chain[-2::-1]):
        near[k] = near[k] or near[last] and kind[full[k]] == ITEM
    return {i for i, n in zip(full, near) if n}


def _teased(lines: list[str], full: list[int], kind: list[int]) -> dict[int, int]:
    """Lines of teaser blocks, from their header to the next paragraph or control: {line: header}."""
    block: dict[int, int] = {}
    open_at = None
    for i in full:
        if kind[i] == TEASER:
            open_at = i
        elif open_at is not None:
            if kind[i] in (PARA, ITEM) or kind[i] == DROP and not re.search(r"\bmin\b", lines[i]):
                open_at = None
            elif kind[i] in (SHORT, LINK):
                block[i] = open_at
    return block


def article(text: str, m: Model, host: str | None) -> list[bool]:
    """Which lines belong to the page's own article."""
    lines, tags = visible(text)
    kind = _classify(lines, m, host)
    keep = [False] * len(lines)
    full = [i for i, k in enumerate(kind) if k != BLANK]
    if not full:
        return keep
    crumbs = [lines[i].split("›")[-1].strip().rstrip("…").strip() for i in full if "›" in lines[i]]
    heading = lambda i: m.common.get(mask(lines[i], host), 0.0) >= 0.5 and not _LIST.match(lines[i]) and not re.search(r"\d", lines[i])
    heads = {i for i in full if kind[i] in (SHORT, LINK) and heading(i)}
    block = _teased(lines, full, kind)
    linked = [kind[i] in (DROP, TEASER) or (kind[i] == LINK or i in block) and i not in heads for i in full]
    inside = regions(densities([lines[i] for i in full], [tags[i] for i in full], linked))
    within = bounds(inside, full, kind, heads)
    only = kind.count(PARA) == 1
    paras = [i for i in full if kind[i] == PARA and (i in within or only)]
    if not paras:
        return keep
    first, last = paras[0], paras[-1]
    for i, n in zip(full, inside):
        keep[i] = bool(n) if kind[i] not in (ITEM, SHORT, LINK) else False
    for i in paras:
        keep[i] = True
    nxt = {}
    follow = None
    for i in reversed(full):
        nxt[i] = follow
        if kind[i] != DROP:
            follow = i
    # the title: the last short line before the first paragraph, unless a title stands before the block it is in
    before = [i for i in full if i < first and kind[i] == SHORT]
    titled = [i for i in before if any(c and lines[i].strip().startswith(c) for c in crumbs)]
    if before:
        near = before[-1]
        if titled:
            keep[titled[-1]] = True
            if near != titled[-1] and near in heads:
                keep[near] = True
        else:
            keep[near] = True
            if near in block:
                ahead = [i for i in before if i < block[near] and i not in block]
                if ahead and near not in heads:
                    keep[near], near = False, ahead[-1]
                    keep[near] = True
            if near in heads and len(before) > 1:
                up = [i for i in before if i < near]
                if up:
                    keep[up[-1]] = True
    # between the paragraphs: list items, and headings that something follows
    for i in full:
        if i <= first or keep[i]:
            continue
        if kind[i] == ITEM:
            keep[i] = i in within
        elif kind[i] == SHORT and i < last:
            f = nxt[i]
            lead = f is not None and (kind[f] == PARA and (f in within or only) or kind[f] == ITEM and f in within)
            keep[i] = lead and (i in heads or i not in block)
        elif kind[i] == LINK and i < last and i in heads and i not in block:
            keep[i] = True
    for i in full:  # items before the first paragraph only right after the title
        if kind[i] == ITEM and i < first and any(keep[j] and kind[j] == SHORT for j in range(max(0, i - 6), i)):
            keep[i] = True
    # a heading with nothing of its own after the last paragraph but items
    for i in full:
        if i > last and kind[i] == SHORT and i not in block and i in heads:
            f = nxt[i]
            keep[i] = f is not None and kind[f] == ITEM and f in within
    return keep


def article_text(text: str, m: Model, host: str | None, only_kept: bool = True) -> str:
    """The article, or (for judging pages without one) all that no notice or menu explains."""
    lines, _ = visible(text)
    if only_kept:
        return "\n".join(x for x, k in zip(lines, article(text, m, host)) if k)
    kind = _classify(lines, m, host, judging=True)
    if PARA not in kind:
        return "\n".join(x for x, k in zip(lines, kind) if k in (ITEM, SHORT))
    keep = article(text, m, host)
    last = max(i for i, k in enumerate(kind) if k == PARA)
    return "\n".join(x for i, (x, k) in enumerate(zip(lines, kind)) if keep[i] or k == PARA or k == SHORT and i < last)


def own(text: str, m: Model, host: str | None) -> list[bool]:
    """Which lines are the page's article; none where all that no furniture explains is residue."""
    from .residue import judge

    keep = article(text, m, host)
    if any(keep) and not plain_content(text, m, host) and judge(article_text(text, m, host, False)) == "residue":
        return [False] * len(keep)
    return keep


def furniture(pages: DataFrame, key: str = "doc_id", text: str = "text", host: str = "host", model: Model | None = None) -> DataFrame:
    """(key, line_no) of each non-blank line that is not part of the article."""
    pages = spread(pages.select(key, text, host))
    shared = pages.sparkSession.sparkContext.broadcast(model or learn(pages, text, host))

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in pdfs:
            ids, nos = [], []
            for d, t, h in zip(pdf[key], pdf[text], pdf[host]):
                if not t or t.isspace():
                    continue
                for i, (x, k) in enumerate(zip(t.split("\n"), own(t, m, h))):
                    if not k and x.strip():
                        ids.append(d)
                        nos.append(i)
            if ids:
                yield pd.DataFrame({key: ids, "line_no": pd.Series(nos, dtype="int32")})

    return pages.mapInPandas(run, f"{key} {dict(pages.dtypes)[key]}, line_no int")


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "corpus").where(squash(F.col("platform")).isin(*WEB))
    return docs.select("doc_id", "text", squash(F.col("actor")).alias("host"))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    """Each non-blank line of a web page that is not part of its own article."""
    return furniture(_pages(spark, sf)).distinct()


def p1_articles(spark: SparkSession, sf: str) -> DataFrame:
    """doc_id and the article alone (empty where a page has none)."""
    pages = spread(_pages(spark, sf).where("text is not null"))
    shared = spark.sparkContext.broadcast(learn(pages))

    @F.pandas_udf("string")
    def body(t: pd.Series, h: pd.Series) -> pd.Series:
        return pd.Series(["\n".join(s for s, k in zip(visible(x)[0], own(x, shared.value, y)) if k) for x, y in zip(t, h)], dtype=object)

    return pages.select("doc_id", body("text", "host").alias("article")).distinct()


QUERIES = {"p1_found": p1_found, "p1_articles": p1_articles}
