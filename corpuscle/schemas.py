"""Explicit schemas, closed vocabularies and the schema check that every sink applies."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

CONTEXTS = ["commercial", "policy", "public"]
PLATFORMS = ["blog", "earnings_call", "testimony", "regulatory_doc", "interview", "speech", "press_release", "research_paper"]
DEFAULT_PLATFORM = "press_release"
ACTOR_TYPES = ["individual", "company", "policymaker"]
POSITIONING = ["capability", "safety", "infrastructure", "regulator"]
FRAMES = ["Innovation/Progress", "Economic Benefit", "Risk/Harm", "Regulation/Governance", "Existential/AGI"]
FRAME_COLUMNS = {"Innovation/Progress": "innovation", "Economic Benefit": "economic", "Risk/Harm": "risk", "Regulation/Governance": "regulation", "Existential/AGI": "existential"}
FILTER_REASONS = ["too_short", "junk_fragment", "off_topic", "no_ai_relevance", "non_english"]
BREAK_DATE = "2022-11-30"
KAPPA_GATE, F1_GATE = 0.70, 0.80
BALANCE = {"min_total_docs": 6000, "max_actor_share": 0.10, "min_context_share": 0.15, "min_cell_docs": 50, "type_split": {"individual": 0.35, "company": 0.35, "policymaker": 0.30}, "type_tolerance": 0.08}

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()


def _struct(spec: str) -> T.StructType:
    return T._parse_datatype_string(spec)  # noqa: SLF001


RAW_DOC = "url string, date string, text string, actor string, context string, platform string, source_exhibit string, quarter string"
CORPUS = "doc_id string, actor string, actor_type string, positioning string, context string, platform string, date string, post_chatgpt smallint, word_count int, text string"
CLEAN_SENTENCE = "sentence_id string, doc_id string, actor string, actor_type string, context string, date string, post_chatgpt smallint, sentence_text string, word_count int, likely_none boolean"
ANNOTATION_SHEET = "sentence_id string, actor string, context string, date string, sentence_text string, Innovation_Progress string, Economic_Benefit string, Risk_Harm string, Regulation_Governance string, Existential_AGI string, None string, Notes string"
LABELED_DOCUMENT = "doc_id string, actor string, actor_type string, positioning string, context string, platform string, date string, post_chatgpt smallint, word_count int, n_sentences int, innovation_score double, economic_score double, risk_score double, regulation_score double, existential_score double, none_pct double"


def columns(spec: str) -> list[str]:
    return [part.split()[0] for part in spec.split(", ")]


def validate(df: DataFrame, spec: str) -> DataFrame:
    """Project to the canonical order and types; a missing column is an error, extra ones are dropped."""
    have = {c.lower() for c in df.columns}
    missing = [c for c in columns(spec) if c.lower() not in have]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df.select(*[F.col(f"`{name}`").try_cast(kind).alias(name) for name, kind in (p.split() for p in spec.split(", "))])
