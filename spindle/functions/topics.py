"""Topic display names and probability extraction."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def topic_display_name(topic_id: Column, stored_name: Column, terms: Column) -> Column:
    """Name shown for a topic.

    A stored name is kept unless it has the generated form ``"{id}_" + non-empty parts joined by
    '_'``; a generated-form or missing name is rebuilt from the top three terms; with no terms
    the name is ``"Topic {id}"``. ``terms`` is ARRAY<STRING> in weight order.
    """
    parts = F.split(stored_name, "_", -1)
    tail = F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))
    generated_form = F.startswith(stored_name, F.concat(topic_id.cast("string"), F.lit("_"))) & F.forall(
        tail, lambda p: p != F.lit("")
    )
    return (
        F.when(stored_name.isNotNull() & ~generated_form, stored_name)
        .when(F.size(terms) > 0, F.concat(topic_id.cast("string"), F.lit("_"), F.array_join(F.slice(terms, 1, 3), "_")))
        .otherwise(F.concat(F.lit("Topic "), topic_id.cast("string")))
    )


def topic_probability(prob: Column, probs: Column | None = None) -> Column:
    """Probability of the assigned topic: the scalar when given, else the max of a distribution."""
    if probs is None:
        return prob
    return F.coalesce(prob, F.array_max(probs))
