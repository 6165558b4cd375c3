"""Engine parameters. Defaults equal the reference's settings; every one is a plain argument."""

from __future__ import annotations

from dataclasses import dataclass

# Fixed values that must equal the reference's defaults for equal results.
# Default sentiment label set, in this order:
DEFAULT_LABELS = ["Satisfied", "Grateful", "Concerned", "Anxious", "Confused", "Angry", "Neutral"]
# Terminal source states that take a row out of the backlog:
TERMINAL_STATES = ["completed", "failed_permanent", "failed_nlp_analysis"]
# States written by the batch job:
STATUS_COMPLETED = "completed"
STATUS_STORE_UNVERIFIED = "pending_nlp_store_verification"
STATUS_FAILED = "failed_nlp_analysis"
STATUS_PENDING = "pending"
# Defaults for absent source columns:
ABSENT_DEFAULTS = {
    "source": "unknown_source_type",
    "retrieved_by_keyword": "unknown_keyword",
    "keyword_language": "un",
    "cleaned_text": "",
}
# Model-version tag written with every result row:
MODEL_VERSION = "BERTopic_SBERT_XLM-R_v1"
# Target column length limits:
LENGTH_LIMITS = {
    "raw_mongo_id": 24,
    "keyword_concept_id": 24,
    "keyword_language": 2,
    "detected_language": 2,
}
# Error messages of the analysis, as the reference words them:
ERR_SENTIMENT = "Overall sentiment analysis failed or returned no result for non-empty text."
ERR_TOPIC = "Topic modeling (transform) returned no result for non-empty text."
ERR_TOPIC_MODEL = "BERTopic model is not loaded, skipping topic modeling."
ERR_TOPIC_ENCODER = "BERTopic model is loaded, but its SBERT embedding_model is missing. Skipping topic modeling."


@dataclass(frozen=True)
class EngineConfig:
    batch_size: int = 50  # rows per scheduled batch
    interval_minutes: int = 15  # scheduler interval
    top_n_keywords: int = 10
    mark_in_source: bool = True
    model_version: str = MODEL_VERSION
    compact_log: bool = True  # fold each batch's log entries into the latest ones
