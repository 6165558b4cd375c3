"""Normalisation of source rows to request records, and record validation.

Bad records are split off with their reasons instead of failing the batch.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spindle.config import ABSENT_DEFAULTS, LENGTH_LIMITS
from spindle.functions.jsonlist import STATE_NULL, STATE_OK, STATE_REJECT, parse_string_list, variant_string_list
from spindle.functions.once import once
from spindle.schemas import ROW_KEY

REQUIRED = ["raw_mongo_id", "source", "original_timestamp", "retrieved_by_keyword", "keyword_language", "cleaned_text"]
LIST_FIELDS = ["tokens_processed", "lemmas"]


def _list_field(df: DataFrame, name: str) -> tuple[Column, Column]:
    """(value, state) of a token list column, whether it arrives as JSON text or as an array."""
    if name not in df.columns:
        return F.lit(None).cast("array<string>"), F.lit(STATE_NULL)
    return _list_columns(name, type(df.schema[name].dataType))


@once
def _list_columns(name: str, kind: type[T.DataType]) -> tuple[Column, Column]:
    if kind is T.ArrayType:
        c = F.col(name)
        state = (
            F.when(c.isNull(), F.lit(STATE_NULL))
            .when(F.exists(c, lambda e: e.isNull()), F.lit(STATE_REJECT))
            .otherwise(F.lit(STATE_OK))
        )
        return F.when(state == STATE_OK, c), state
    parsed = variant_string_list(F.col(name)) if kind is T.VariantType else parse_string_list(F.col(name))
    return parsed["value"], parsed["state"]


def normalize(df: DataFrame) -> DataFrame:
    """Source row -> request record.

    Key to string, defaults for *absent* columns only (a NULL in a present column stays NULL
    and fails validation, as in the reference), token lists parsed strictly.
    """

    def col_or_default(name: str) -> Column:
        if name in df.columns:
            return F.col(name)
        if name in ABSENT_DEFAULTS:
            return F.lit(ABSENT_DEFAULTS[name])
        return F.lit(None).cast("string")

    tok_v, tok_s = _list_field(df, "tokens_processed")
    lem_v, lem_s = _list_field(df, "lemmas")
    ts = F.col("original_timestamp") if "original_timestamp" in df.columns else F.lit(None).cast("timestamp")
    return df.select(
        F.col("id").try_cast("bigint").alias("id") if "id" in df.columns else F.lit(None).cast("bigint").alias("id"),
        (F.col("id").isNotNull() & F.col("id").try_cast("bigint").isNull() if "id" in df.columns else F.lit(False)).alias("id_rejected"),
        F.col("raw_mongo_id").cast("string").alias("raw_mongo_id"),
        col_or_default("source").alias("source"),
        ts.alias("original_timestamp"),
        col_or_default("retrieved_by_keyword").alias("retrieved_by_keyword"),
        col_or_default("keyword_language").alias("keyword_language"),
        col_or_default("keyword_concept_id").alias("keyword_concept_id"),
        col_or_default("detected_language").alias("detected_language"),
        col_or_default("cleaned_text").alias("cleaned_text"),
        tok_v.alias("tokens"),
        tok_s.alias("tokens_state"),
        lem_v.alias("lemmas"),
        lem_s.alias("lemmas_state"),
        col_or_default("original_url").alias("original_url"),
        *[c for c in [ROW_KEY] if c in df.columns],
    )


@once
def reasons(include_lengths: bool = True) -> Column:
    """ARRAY<STRING> of rule violations of a normalised row, in a fixed order; empty when valid."""
    checks = [F.when(F.col(c).isNull(), F.lit(f"{c} is required")) for c in REQUIRED]
    checks += [
        F.when(F.col(state) == STATE_REJECT, F.lit(f"{field} must be a list of strings"))
        for field, state in (("tokens_processed", "tokens_state"), ("lemmas", "lemmas_state"))
    ]
    checks.append(F.when(F.col("id_rejected"), F.lit("id must be an integer")))
    if include_lengths:
        checks += [
            F.when(F.length(c) > n, F.lit(f"{c} longer than {n} characters")) for c, n in LENGTH_LIMITS.items()
        ]
    return F.filter(F.array(*checks), lambda x: x.isNotNull())


def validate(df: DataFrame, include_lengths: bool = True) -> DataFrame:
    """Adds ``reasons`` (array) and ``is_valid`` to a normalised frame."""
    return df.withColumn("reasons", reasons(include_lengths)).withColumn("is_valid", F.size("reasons") == 0)


def split_valid(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, quarantine) halves of a validated frame; both are lazy filters of one plan."""
    return df.where(F.col("is_valid")), df.where(~F.col("is_valid"))
