"""Text expressions that stay inside whole-stage code generation."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[\s\p{Z}]+"
_EDGE_L, _EDGE_R = r"(^|[^\p{L}\p{N}_])", r"($|[^\p{L}\p{N}_])"

# The vocabularies of the sentence filters.
TOPIC_TERMS = "AI|artificial intelligence|machine learning|model|media|Microsoft|Meta|Google|DeepMind|OpenAI|Anthropic|Nvidia|ChatGPT|AGI|superintelligence|neural|algorithm|automation|robot|compute|LLM|GPT|Claude|Gemini|Llama|language model|data science|deep learning|generative"
STRONG_TERMS = "will|must|should|revolutionize|transform|trillion|billion|percent|risk|harm|bias|discriminat|superintelligence|AGI|align|dangerous|regulation|governance|oversight|existential|breakthrough|advance"
JUNK = r'\{"|(^|[^\p{L}\p{N}_])className($|[^\p{L}\p{N}_])|"div"|"span"|\s=>\s|/\*|https?://|©|@md:|px-|col-span'
OFF_TOPIC = r"Public Assistance|emergency protective measures|Category [A-Z]($|[^\p{L}\p{N}_])|Federal funding is available|trade deficit|GDP grew|unemployment rate"
TOPIC = f"{_EDGE_L}({TOPIC_TERMS}){_EDGE_R}"
STRONG = f"{_EDGE_L}({STRONG_TERMS}){_EDGE_R}"
MIN_WORDS, SHORT_WORDS, HEADER_WORDS, HEADER_UPPER = 8, 20, 6, 0.7
SPLIT = r"([.!?])[\s\p{Z}]+"
MARK = "\u0001"


def rlike(c, pattern: str) -> Column:
    return F.col(c).rlike(f"(?i){pattern}") if isinstance(c, str) else c.rlike(f"(?i){pattern}")


def any_term(terms: str) -> str:
    """A pattern for whole words, Unicode letters and digits being word characters."""
    return f"{_EDGE_L}({terms}){_EDGE_R}"


def strip(c) -> Column:
    """Trim of every kind of blank (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def collapse(c) -> Column:
    return strip(F.regexp_replace(c, BLANK, " "))


def word_count(c) -> Column:
    """Blank-separated tokens; 0 for null and blank."""
    return F.coalesce(F.regexp_count(c, F.lit(r"[^\s\p{Z}]+")), F.lit(0))


def has_text(c) -> Column:
    return F.coalesce(F.col(c).rlike(r"[^\s\p{Z}]"), F.lit(False))


def sentences(c) -> Column:
    """Array of sentences: cut after . ! ? followed by a blank, trimmed, blank ones dropped."""
    parts = F.split(F.regexp_replace(c, SPLIT, f"$1{MARK}"), MARK)
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def upper_ratio(c) -> Column:
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", ""))
    return F.try_divide(F.length(F.regexp_replace(c, r"[^\p{Lu}]", "")), letters)


def header_fragment(c, wc: Column) -> Column:
    """Fewer than six words, and no letter or more than 70 % capitals."""
    return (wc < HEADER_WORDS) & F.coalesce(upper_ratio(c) > HEADER_UPPER, F.lit(True))


def filter_reason(c, wc: Column) -> Column:
    """First failing filter of the cascade, '' when none; order is kept by ``when``."""
    return (
        F.when(wc < MIN_WORDS, "too_short")
        .when(rlike(c, JUNK), "junk_fragment")
        .when(rlike(c, OFF_TOPIC) | header_fragment(c, wc), "off_topic")
        .when(~rlike(c, TOPIC), "no_ai_relevance")
        .otherwise("")
    )


def likely_none(c, wc: Column) -> Column:
    return (wc <= SHORT_WORDS) & ~rlike(c, STRONG)


def _number(c: str) -> Column:
    """The number in a cell; 0 for anything else, 'nan' included."""
    return F.nanvl(F.coalesce(F.expr(f"try_cast(trim({c}) AS double)"), F.lit(0.0)), F.lit(0.0))


def to_bit(c) -> Column:
    """Dirty annotation cell: the integer part of a number, anything else 0 (values above 1 pass through)."""
    return F.coalesce(_number(c).try_cast("int"), F.lit(0))


def to_bit_half(c) -> Column:
    """Dirty annotation cell: 1 from 0.5 on, anything else 0."""
    return F.when(_number(c) >= 0.5, 1).otherwise(0)


def key12(c) -> Column:
    return F.substring(F.md5(c), 1, 12)


def shorten(c, n: int = 58) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def unfence(c) -> Column:
    """A model's answer without the code fence around it."""
    return F.regexp_replace(c, r"(?m)^```[a-z]*\n?", "")


def file_safe(c) -> Column:
    return F.lower(F.regexp_replace(c, r"[^A-Za-z0-9]+", "_"))


def keep_and_rejoin(c, pattern: str, least: int = 3) -> Column:
    """Sentences that match, joined again; null when fewer than ``least``."""
    hits = F.filter(sentences(c), lambda s: rlike(s, pattern))
    return F.when(F.size(hits) >= least, F.array_join(hits, " "))
