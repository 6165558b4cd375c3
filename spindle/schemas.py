"""Fixed schemas of every dataset the engine reads or writes. Nothing is inferred."""

from __future__ import annotations

from pyspark.sql import types as T

# Source rows ("processed documents"): the 12 analysed columns plus the status pair.
SOURCE_COLUMNS = [
    "id",
    "raw_mongo_id",
    "source",
    "original_timestamp",
    "retrieved_by_keyword",
    "keyword_language",
    "keyword_concept_id",
    "detected_language",
    "cleaned_text",
    "tokens_processed",
    "lemmas",
    "original_url",
]
STATUS_COLUMN = "nlp_status"
STATUS_TS_COLUMN = "nlp_status_timestamp"

DOC_FEED = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("raw_mongo_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("original_timestamp", T.TimestampType()),
        T.StructField("retrieved_by_keyword", T.StringType()),
        T.StructField("keyword_language", T.StringType()),
        T.StructField("keyword_concept_id", T.StringType()),
        T.StructField("detected_language", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("tokens_processed", T.StringType()),
        T.StructField("lemmas", T.StringType()),
        T.StructField("original_url", T.StringType()),
        T.StructField(STATUS_COLUMN, T.StringType()),
        T.StructField(STATUS_TS_COLUMN, T.TimestampType()),
    ]
)

# A single analysis request as JSON (the on-request path): lists are real JSON arrays here.
REQUEST = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("raw_mongo_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("original_timestamp", T.TimestampType()),
        T.StructField("retrieved_by_keyword", T.StringType()),
        T.StructField("keyword_language", T.StringType()),
        T.StructField("keyword_concept_id", T.StringType()),
        T.StructField("detected_language", T.StringType()),
        T.StructField("cleaned_text", T.StringType()),
        T.StructField("tokens_processed", T.ArrayType(T.StringType())),
        T.StructField("lemmas", T.ArrayType(T.StringType())),
        T.StructField("original_url", T.StringType()),
    ]
)

# The same as JSON text: an id of any form and lists of any type are read as they stand, so that
# validation and not a silent coercion decides about them.
REQUEST_JSON = T.StructType(
    [
        T.StructField(f.name, T.StringType() if f.name == "id" else T.VariantType() if isinstance(f.dataType, T.ArrayType) else f.dataType)
        for f in REQUEST.fields
    ]
)

LABEL_SCORE = T.StructType([T.StructField("label", T.StringType()), T.StructField("score", T.DoubleType())])
TERM_WEIGHT = T.StructType([T.StructField("term", T.StringType()), T.StructField("weight", T.DoubleType())])
TOPIC_INFO = T.StructType(
    [
        T.StructField("id", T.IntegerType()),
        T.StructField("name", T.StringType()),
        T.StructField("keywords", T.ArrayType(TERM_WEIGHT)),
        T.StructField("probability", T.DoubleType()),
    ]
)
KEYWORD_FREQUENCY = T.StructType(
    [T.StructField("keyword", T.StringType()), T.StructField("frequency", T.LongType())]
)

# Typed result table (one row per business key).
RESULT = T.StructType(
    [
        T.StructField("raw_mongo_id", T.StringType(), False),
        T.StructField("source", T.StringType()),
        T.StructField("original_timestamp", T.TimestampType()),
        T.StructField("retrieved_by_keyword", T.StringType()),
        T.StructField("keyword_concept_id", T.StringType()),
        T.StructField("original_keyword_language", T.StringType()),
        T.StructField("processing_timestamp", T.TimestampType()),
        T.StructField("detected_language", T.StringType()),
        T.StructField("overall_sentiment", T.ArrayType(LABEL_SCORE)),
        T.StructField("assigned_topics", T.ArrayType(TOPIC_INFO)),
        T.StructField("extracted_keywords_frequency", T.ArrayType(KEYWORD_FREQUENCY)),
        T.StructField("sentiment_on_extracted_keywords_summary", T.ArrayType(LABEL_SCORE)),
        T.StructField("analysis_errors", T.ArrayType(T.StringType())),
        T.StructField("nlp_model_version", T.StringType()),
        T.StructField("signal_extraction_status", T.StringType()),
        T.StructField("signal_extraction_timestamp", T.TimestampType()),
        # lineage: which source row and which batch wrote the current version
        T.StructField("source_id", T.LongType()),
        T.StructField("batch_id", T.LongType()),
    ]
)

STATUS_LOG = T.StructType(
    [
        T.StructField("id", T.LongType(), False),
        T.StructField(STATUS_COLUMN, T.StringType(), False),
        T.StructField(STATUS_TS_COLUMN, T.TimestampType()),
        T.StructField("batch_id", T.LongType(), False),
    ]
)

# Rows without a usable id, by a hash of their source columns.
ROW_KEY = "row_key"
UNKEYED_LOG = T.StructType([T.StructField(ROW_KEY, T.StringType(), False), *STATUS_LOG.fields[1:]])

SENTIMENT_LABEL = T.StructType([T.StructField("label_pos", T.IntegerType()), T.StructField("label", T.StringType())])
LABEL_LEXICON = T.StructType(
    [
        T.StructField("term", T.StringType()),
        T.StructField("label_pos", T.IntegerType()),
        T.StructField("weight", T.DoubleType()),
    ]
)
LABEL_PROTOTYPE = T.StructType(
    [T.StructField("label_pos", T.IntegerType()), T.StructField("prototype", T.ArrayType(T.DoubleType()))]
)
TOPIC_CENTROID = T.StructType(
    [T.StructField("topic_id", T.IntegerType()), T.StructField("centroid", T.ArrayType(T.DoubleType()))]
)
TOPIC_TERM = T.StructType(
    [
        T.StructField("topic_id", T.IntegerType()),
        T.StructField("term", T.StringType()),
        T.StructField("weight", T.DoubleType()),
        T.StructField("rank", T.IntegerType()),
    ]
)
TOPIC_NAME = T.StructType([T.StructField("topic_id", T.IntegerType()), T.StructField("name", T.StringType())])
