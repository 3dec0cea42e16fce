"""Sentence units of documents in many languages and scripts.

Method: a first pass learns, per language and without labels, what a word with a final period is.  Each word type is
counted by what follows it (a lower-case word, a digit, a capital, the end of a paragraph); a binomial
log-likelihood ratio against the language's usual share of paragraph ends tells abbreviations from words that end
sentences.  Log-likelihood ratios of pairs find the capitals that belong to a number or abbreviation before them
(collocations, which also must stand there more often than elsewhere) and the words that begin sentences, from their
share after ends beyond doubt (paragraphs, ``?``, ``!``); their cases are the capitals, in scripts without case all
words.  All tests use the counts of the whole corpus.  A second pass classifies each terminator with these statistics.

Scale: both passes are maps over the scan; the counts are combined per batch, then in one aggregation, and the tests
run there.  The types that pass them (abbreviations, collocates, starters) are broadcast while they are at most
``MAX_TYPES``; beyond, each document is joined with those of its own words, which moves the texts once.

Defined results: null and blank texts have no unit; offsets count code points; an empty line ends a unit, a single
line break does not unless a list item follows; a heading or list item with its mark is a unit; terminators inside
a quotation do not end one; in Thai a blank does; repeated rows are handled alike; very long texts are scanned
paragraph by paragraph.
"""
from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut, spread, squash, table

PLATFORMS = ("speech", "research_paper")
MAX_TYPES = 200_000
LL_ABBREVIATION, LL_COLLOCATION, LL_STARTER = 7.88, 7.88, 30.0

_SCRIPTS = [
    ("th", re.compile(r"[฀-๿]")), ("hi", re.compile(r"[ऀ-ॿ]")), ("ar", re.compile(r"[؀-ۿ]")),
    ("el", re.compile(r"[Ͱ-Ͽ]")), ("ja", re.compile(r"[぀-ヿ]")), ("zh", re.compile(r"[一-鿿]")),
    ("ko", re.compile(r"[가-힯]")), ("ru", re.compile(r"[Ѐ-ӿ]")),
]
# Frequent function words that tell languages of the Latin script apart.
_FUNCTION: dict[str, list[str]] = {}
for _lang, _ws in {
    "en": "the of and that to is for was with by in on at an as it be this from", "de": "der die das und dass ist nicht den für mit im von zu ein eine auf dem des sich laut",
    "es": "el la los las de que en un una por para según con y se del al su es", "fr": "le la les de des du une un est dans pour que et sur selon au aux ce d l",
    "pt": "os as de que um uma não para com por pelo são em do da", "it": "il la gli che di della per una un nel sono e del", "nl": "het een van niet met voor zijn op dat de en",
    "pl": "się nie na jest że do przez i w z",
}.items():
    for _w in _ws.split():
        _FUNCTION.setdefault(_w, []).append(_lang)
_WORD = re.compile(r"[^\W\d_]+")


_OTHER = re.compile("|".join(r.pattern for _, r in _SCRIPTS))


def _script(part: str, text: str, least: int = 1) -> str | None:
    """The language of the script, other than the Latin one, that ``part`` of the text is written in."""
    if not _OTHER.search(part):
        return None
    letters = sum(1 for _ in _WORD.finditer(part)) or 1
    for lang, r in _SCRIPTS:
        n = len(r.findall(part))
        if n >= least and n > 2 * letters * 0.3 or n > max(40, len(part) // 50):
            return "ja" if lang == "zh" and _SCRIPTS[4][1].search(text) else lang
    return None


def _latin(text: str) -> str:
    votes = Counter(lang for w in _WORD.findall(text.lower()) for lang in _FUNCTION.get(w, ()))
    return max(votes, key=lambda k: (votes[k], k == "en", k)) if votes else "en"


def language(text: str) -> str:
    """The script's language, or the Latin one with most function words."""
    return _script(text, text) or _latin(text)


#: Characters of a script that decide for a paragraph; letters that a paragraph of another script than its text has.
OWN_CHARS, LATIN_CHARS = 6, 40


class _Languages:
    """The language of each paragraph of a text: its own script's, else the text's."""

    def __init__(self, text: str):
        self.text, self.whole = text, language(text)
        self.native = dict(_SCRIPTS).get(self.whole)
        self.mixed = bool(_OTHER.search(text))

    def of(self, par: str) -> str:
        if not self.mixed:
            return self.whole
        own = _script(par, self.text, OWN_CHARS)
        if own or not self.native or self.native.search(par) or sum(map(len, _WORD.findall(par))) < LATIN_CHARS:
            return own or self.whole
        return _latin(par)


_PARAGRAPH = re.compile(r"\S(?:.*\S)?(?:[^\S\n]*\n[^\S\n]*\S(?:.*\S)?)*")
_QUOTES = re.compile(r"\"[^\"]*\"|“[^“”]*”|„[^„“”]*[“”]|«[^«»]*»|「[^「」]*」|『[^『』]*』|‹[^‹›]*›")
_CLOSERS = "\"”“»›」』)）]’'"
_OPENERS = "\"“„«‹「『(（[¿¡‘'*_"
_ENDS = re.compile(r"[.!?…؟۔।॥。！？｡;;]+[\"”“»›」』)）\]’']*")
_L = r"(?:[^\W\d_]|[\u0300-\u036f\u064b-\u065f\u0900-\u0903\u093a-\u094f\u0962\u0963\u0e31-\u0e4e])"  # letters and their marks
_TOKEN = re.compile(rf"{_L}+(?:[.'’\-]{_L}+)*$|\d[\d.,]*$")
_NEXT = re.compile(rf"{_L}+(?:['’\-]{_L}+)*|\d+")
_MARK = re.compile(r"(?:[-*•–—·◦▪]|\(?\d{1,3}[.)]|\(?[a-zA-Z][.)])[^\S\n]+(?=\S)")
_FULL = "。！？｡।॥؟۔"
_SURE = frozenset("!?؟")  # after these a sentence begins, whatever is learned
_CASELESS = ("ar", "hi", "ko")  # scripts with blanks between words but without capitals


def _plain(text: str) -> str:
    """The text with every kind of line break as one newline, offsets unchanged."""
    return text.replace("\r\n", " \n").replace("\r", "\n").replace("\u2028", "\n").replace("\u2029", "\n")


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    for m in _PARAGRAPH.finditer(_plain(text)):
        yield m.start(), m.group()


def _items(par: str) -> list[tuple[int, int]]:
    """(start, end of the mark) of the list items of a paragraph: a mark at its start, or at the start of a line
    whose predecessor is finished or which counts on."""
    out, last = [], None
    at = 0
    while at < len(par):
        m = _MARK.match(par, at)
        if m:
            num = re.sub(r"\D", "", m.group())
            end = at - 1
            while end >= 0 and par[end].isspace():
                end -= 1
            done = end < 0 or par[end] in ".!?…。！？:;؟।" + _CLOSERS
            if done or (num and last is not None and int(num) == last + 1) or (not num and out and par[at] == par[out[-1][0]]):
                out.append((at, m.end()))
                last = int(num) if num else None
        nl = par.find("\n", at)
        if nl < 0:
            break
        at = nl + 1
        while at < len(par) and par[at] in " \t　 ":
            at += 1
    return out


def _candidates(par: str, lang: str):
    """Terminators outside quotations: (start, end with closers, token before, is a full stop, next position)."""
    spans = [(m.start(), m.end()) for m in _QUOTES.finditer(par)]
    k = 0
    for m in _ENDS.finditer(par):
        s, e = m.start(), m.end()
        marks = m.group().rstrip(_CLOSERS)
        if set(marks) <= {";", ";"} and lang != "el":
            continue
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        quoted = k < len(spans) and spans[k][0] < s
        if quoted:
            if e < spans[k][1]:
                continue
            e = spans[k][1]
            while e < len(par) and par[e] in ")）]":
                e += 1
        else:
            e = s + len(marks)
            while e < len(par) and par[e] in ")）]’'" or (e < len(par) and par[e] in _CLOSERS and not any(a == e for a, _ in spans[k : k + 1])):
                e += 1
        nxt = e
        while nxt < len(par) and par[nxt].isspace():
            nxt += 1
        yield s, e, marks, quoted, nxt


#: Types are told apart by so many last characters.
WORD = 64


def _before(par: str, at: int) -> str:
    m = _TOKEN.search(par, max(0, at - WORD), at)
    return m.group() if m else ""


def _ordinal(par: str, at: int, number: str) -> bool:
    """Whether the number before a period may count something: a short whole one that stands alone."""
    i = at - len(number)
    return number.isdigit() and len(number) <= 2 and (i == 0 or par[i - 1].isspace() or par[i - 1] in _OPENERS)


def _follow(par: str, nxt: int) -> str:
    while nxt < len(par) and par[nxt] in _OPENERS:
        nxt += 1
    m = _NEXT.match(par, nxt)
    return m.group() if m else ""


def _kind(word: str) -> str:
    if not word:
        return "o"
    c = word[0]
    return "d" if c.isdigit() else "l" if c.islower() else "u" if c.isupper() else "c"


def observe(text: str, counts: Counter, pairs: Counter) -> None:
    """Adds what one text shows: periods by what follows, paragraph starters, words after numbered periods."""
    languages = _Languages(text)
    for _, par in paragraphs(text):
        lang = languages.of(par)
        items = _items(par)
        marks = {e for _, e in items}
        first = _follow(par, items[0][1] if items and items[0][0] == 0 else 0)
        if first:
            counts[lang, "s", first] += 1
        caseless = lang in _CASELESS
        for w in _NEXT.findall(par):
            if w[0].isupper() or caseless:
                counts[lang, "w", w] += 1
        for s, e, ends, quoted, nxt in _candidates(par, lang):
            if not quoted and nxt > e and nxt not in marks and set(ends) <= _SURE and (follow := _follow(par, nxt)) and (caseless or _kind(follow) == "u"):
                counts[lang, "s", follow] += 1
            if quoted or ends != "." or nxt in marks:
                continue
            w = _before(par, s)
            if not w or (e == nxt and nxt < len(par)):
                continue
            follow = _follow(par, nxt)
            how = "e" if nxt >= len(par) else _kind(follow)
            if w[0].isdigit():
                if how == "u" and _ordinal(par, s, w):
                    counts[lang, "m", follow] += 1
            else:
                counts[lang, how, w.lower()] += 1
                if how == "u":
                    pairs[lang, w.lower(), follow] += 1


def _association(a, b, ab, n):
    """Twice the log-likelihood ratio of ``ab`` common cases of two events with ``a`` and ``b`` cases among ``n``;
    0 where they meet less often than by chance.  Columns."""
    a, b, ab, n = (c.cast("double") for c in (a, b, ab, n))
    part = lambda k, row, col: F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)
    both = part(ab, a, b) + part(a - ab, a, n - b) + part(b - ab, n - a, b) + part(n - a - b + ab, n - a, n - b)
    return F.when(ab * n > a * b, 2 * both).otherwise(0.0)


_MODEL = "lang string, kind string, word string, follow string, may boolean"


def learn(docs: DataFrame, text: str = "text") -> DataFrame:
    """(lang, kind, word, follow, may): the types that pass the tests.  Kinds: a abbreviation (``may`` end a sentence),
    m collocate of numbers, s starter, p capital that belongs to an abbreviation."""

    def count(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            c, pairs = Counter(), Counter()
            for t in pdf[text]:
                if t and not t.isspace():
                    observe(t, c, pairs)
            if c:
                rows = [(*k, "", n) for k, n in c.items()] + [(lang, "p", w, follow, n) for (lang, w, follow), n in pairs.items()]
                yield pd.DataFrame(rows, columns=["lang", "kind", "word", "follow", "n"])

    n = docs.select(text).mapInPandas(count, "lang string, kind string, word string, follow string, n bigint")
    return _fit(cut(n.groupBy("lang", "word", "kind", "follow").agg(F.sum("n").alias("n"))))


def _ll(k, n, p):
    """Twice the log-likelihood ratio of a share k/n against p.  Columns."""
    part = lambda k, q: F.when(k > 0, k * F.log(k / n / q)).otherwise(0.0)
    return 2 * (part(k, p) + part(n - k, 1 - p))


def _fit(n: DataFrame) -> DataFrame:
    """The model from the counts of the whole corpus."""
    wide = n.where("kind != 'p'").groupBy("lang", "word").agg(*[F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in "eldcusmwo"])
    wide = wide.withColumn("all", F.col("e") + F.col("l") + F.col("d") + F.col("c") + F.col("u") + F.col("o"))
    # one row a language; names and starters are told apart among capitals, so these are the cases of the tests
    totals = wide.groupBy("lang").agg(
        F.sum("e").alias("ends"), F.sum("all").alias("periods"), F.sum("w").alias("capitals"), F.sum(F.when(F.col("w") > 0, F.least("s", "w"))).alias("breaks"), F.sum("m").alias("numbered")
    )
    wide = wide.join(F.broadcast(totals), "lang")
    wide = wide.withColumn("starts", (F.col("w") > 0) & (_association(F.col("breaks"), F.col("w"), F.least("s", "w"), F.col("capitals")) >= LL_STARTER))
    wide = wide.withColumn("numbers", (F.col("w") > 0) & ~F.col("starts") & (F.col("m") * 2 > F.col("w")) & (_association(F.col("numbered"), F.col("w"), F.col("m"), F.col("capitals")) >= LL_COLLOCATION))
    bare, dotted = F.length(F.regexp_replace("word", r"\.", "")), F.col("word").contains(".")
    low = F.try_divide(F.col("l") + F.col("d"), F.col("all"))
    usual = F.least(F.greatest(F.coalesce(F.try_divide("ends", "periods"), F.lit(0.2)), F.lit(0.15)), F.lit(0.9))
    share = F.try_divide("e", "all")
    fewer = (share < usual) & (_ll(F.col("e").cast("double"), F.col("all").cast("double"), usual) >= LL_ABBREVIATION)
    wide = wide.select(
        "lang", "word", "u", "w", "capitals", "starts", "numbers", (share >= usual / 8).alias("may"), ((low < 0.05) & ~dotted).alias("vetoed"),
        ((low >= 0.3) & (F.col("all") >= F.when(bare <= 4, 2).otherwise(3))).alias("sure"), (((low >= 0.05) | (bare <= 4) | dotted) & fewer).alias("rare"),
    ).where("starts or numbers or sure or rare or w > 0")
    wide = cut(wide)
    after = wide.where("w > 0").select("lang", F.col("word").alias("follow"), F.col("w").alias("b"), "capitals", "starts")
    pairs = n.where("kind = 'p'").select("lang", "word", "follow", F.col("n").alias("ab")).join(wide.where("sure or rare").select("lang", "word", F.col("u").alias("a")), ["lang", "word"])
    pairs = cut(pairs.join(after, ["lang", "follow"]))
    t = pairs.where("starts").groupBy("lang", "word").agg(F.sum("ab").alias("t"))  # capitals that begin sentences
    # what follows begins sentences: no abbreviation, if digits and small letters do not tell otherwise
    abbr = wide.where("sure or rare").join(t, ["lang", "word"], "left").where(F.col("sure") | ~(F.col("vetoed") & (F.coalesce("t", F.lit(0)) * 2 >= F.col("u"))))
    row = lambda df, kind, follow, may: df.select("lang", F.lit(kind).alias("kind"), "word", follow.alias("follow"), may.alias("may"))
    none, no = F.lit(""), F.lit(False)
    # pairs matter only after abbreviations that may end a sentence
    fixed = ~F.col("starts") & (F.col("ab") * 2 > F.col("b")) & (_association(F.col("a"), F.col("b"), F.col("ab"), F.col("capitals")) >= LL_COLLOCATION)
    together = pairs.where(fixed).join(abbr.where("may").select("lang", "word"), ["lang", "word"], "left_semi")
    out = row(abbr, "a", none, F.col("may")).unionByName(row(wide.where("numbers"), "m", none, no)).unionByName(row(wide.where("starts"), "s", none, no))
    return cut(out.unionByName(row(together, "p", F.col("follow"), no)))


class Model:
    """abbr: {(lang, type): may end a sentence}; collocates: {(lang, word after a numbered period)}; starters;
    pairs: {(lang, abbreviation, capital that belongs to it)}."""

    def __init__(self, abbr, collocates, starters, pairs=frozenset()):
        self.abbr, self.collocates, self.starters, self.pairs = abbr, collocates, starters, pairs

    @classmethod
    def of(cls, rows) -> Model:
        out = cls({}, set(), set(), set())
        for lang, kind, word, follow, may in rows:
            if kind == "a":
                out.abbr[lang, word] = may
            else:
                {"m": out.collocates, "s": out.starters}[kind].add((lang, word)) if kind != "p" else out.pairs.add((lang, word, follow))
        return out


def _breaks(par: str, lang: str, model: Model, items: list[tuple[int, int]]) -> Iterator[int]:
    """Where units of a paragraph begin, after its first."""
    marks = {e for _, e in items}
    for s, e, ends, quoted, nxt in _candidates(par, lang):
        if nxt >= len(par) or nxt in marks:
            continue
        gap = nxt > e
        follow = _follow(par, nxt)
        kind = _kind(follow)
        if any(c in _FULL for c in ends) and lang in ("zh", "ja", "hi", "ar", "th", "ko"):
            # a quotation is part of the sentence that goes on after it
            if quoted and not gap and par[nxt] not in _OPENERS:
                continue
            yield nxt
            continue
        if quoted and par[nxt] in ",;:)»":
            continue
        if kind == "l":
            continue
        if not gap:
            # run-together sentences: a capital straight after the end of an ordinary word
            w = _before(par, s)
            opened = par[nxt] in _OPENERS and kind == "u"
            if not (kind == "u" or opened) or quoted or len(follow) < 1:
                continue
            if ends == ".":
                plain = len(w) >= 2 and (w[-1].islower() or w[0].isdigit()) and "." not in w.strip(".")
                if not plain and not (w and "." in w and model.abbr.get((lang, w.lower())) and (lang, follow) in model.starters):
                    continue
            yield nxt
            continue
        if ends == "." and not (quoted or par[s + 1 : e].strip()):
            w = _before(par, s)
            if kind == "o" and not follow and par[nxt] not in _OPENERS and not par[nxt].isalnum() and par[nxt] not in "-–—•#":
                continue
            if w and w[0].isdigit():
                if kind == "u" and (lang, follow) in model.collocates and _ordinal(par, s, w):
                    continue
            elif w:
                single = len(w) == 1 and w.isupper()
                may_end = model.abbr.get((lang, w.lower()))
                if may_end is None and single:
                    may_end = False
                if may_end is not None:
                    if kind == "d":
                        if not (may_end and par[nxt] in _OPENERS):
                            continue
                    elif (lang, w.lower(), follow) in model.pairs:
                        continue
                    elif not may_end and (single or (lang, follow) not in model.starters):
                        continue
        yield nxt


def units(text: str | None, model: Model) -> list[int]:
    """Offsets of the first character of each unit."""
    if not text or text.isspace():
        return []
    languages = _Languages(text)
    out = []
    clean = _plain(text)
    for m in _PARAGRAPH.finditer(clean):
        base, par = m.start(), m.group()
        lang = languages.of(par)
        items = _items(par)
        begins = {0, *(s for s, _ in items)}
        begins.update(_breaks(par, lang, model, items))
        if lang == "th":
            for b in re.finditer(r"(?<=[฀-๿\d%a-zA-Z.)\"”])[  　]+(?=\S)", par):
                if b.end() not in {e for _, e in items} and _SCRIPTS[0][1].search(par[max(0, b.start() - 40) : b.end() + 40]):
                    begins.add(b.end())
        out += sorted(base + b for b in begins)
    return out


def words(text: str) -> set[tuple[str, str]]:
    """(lang, word) of all that the model is asked about a text."""
    languages, out = _Languages(text), set()
    for _, par in paragraphs(text):
        lang = languages.of(par)
        for s, _e, ends, _quoted, nxt in _candidates(par, lang):
            if ends == "." and nxt < len(par):
                out.update(((lang, _before(par, s).lower()), (lang, _follow(par, nxt))))
    return out


def split(docs: DataFrame, key: str = "doc_id", text: str = "text", model: Model | DataFrame | None = None) -> DataFrame:
    """(key, start_char) of every sentence unit."""
    docs = spread(docs.select(F.col(key), F.col(text).alias("_text")))
    shape = f"{key} {dict(docs.dtypes)[key]}, start_char int"

    def emit(ids, texts, models) -> Iterator[pd.DataFrame]:
        keys, starts = [], []
        for d, t, m in zip(ids, texts, models):
            u = units(t, m)
            keys += [d] * len(u)
            starts += u
        if keys:
            yield pd.DataFrame({key: keys, "start_char": pd.Series(starts, dtype="int32")})

    model = learn(docs, "_text") if model is None else model
    if isinstance(model, DataFrame) and model.count() <= MAX_TYPES:
        model = Model.of(model.collect())
    if isinstance(model, Model):
        shared = docs.sparkSession.sparkContext.broadcast(model)

        def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in pdfs:
                yield from emit(pdf[key], pdf["_text"], [shared.value] * len(pdf))

        return docs.mapInPandas(run, shape)

    # too many types for every task: each document gets those of its own words
    def ask(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            rows = [(d, *x) for d, t in zip(pdf[key], pdf["_text"]) if t and not t.isspace() for x in words(t)]
            if rows:
                yield pd.DataFrame(rows, columns=[key, "lang", "word"])

    asked = docs.mapInPandas(ask, f"{key} {dict(docs.dtypes)[key]}, lang string, word string").distinct()
    own = asked.join(model, ["lang", "word"]).groupBy(key).agg(F.collect_set(F.struct("lang", "kind", "word", "follow", "may")).alias("own"))

    def run_own(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            models = [Model.of([] if x is None else [(r["lang"], r["kind"], r["word"], r["follow"], r["may"]) for r in x]) for x in pdf["own"]]
            yield from emit(pdf[key], pdf["_text"], models)

    return docs.join(own, docs[key].eqNullSafe(own[key]), "left").select(docs[key], "_text", "own").mapInPandas(run_own, shape)


def _docs(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "corpus").where(squash(F.col("platform")).isin(*PLATFORMS)).select("doc_id", "text")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """Start of every sentence unit of speeches and research papers."""
    return split(_docs(spark, sf)).distinct()


def p3_abbreviations(spark: SparkSession, sf: str) -> DataFrame:
    """What was learned: abbreviations per language, and whether they may end a sentence."""
    return learn(spread(_docs(spark, sf))).where("kind = 'a'").select("lang", "word", F.col("may").alias("may_end"))


QUERIES = {"p3_found": p3_found, "p3_abbreviations": p3_abbreviations}
