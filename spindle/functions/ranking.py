"""In-row ranking helpers: array higher-order functions, and counting on Arrow batches.

These operate on one row's array, so a document is never split across tasks and no shuffle
is needed: per-row work is bounded by the size of that document.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spindle.functions.once import once


def with_top_frequencies(df: DataFrame, tokens: Column, n: int, out: str) -> DataFrame:
    """Adds ``out``: the most frequent elements of an array, ``Counter.most_common(n)`` order.

    ARRAY<STRUCT<keyword STRING, frequency BIGINT>>: count descending, ties in order of first
    appearance; NULL or empty input gives an empty array.

    Counted on Arrow batches, in time linear in a row's length: only the array goes to the worker.
    """
    empty = F.array().cast("array<string>")
    return df.withColumn(out, _most_common(n)(F.coalesce(tokens, empty)))


@once
def _most_common(n: int):
    @F.pandas_udf("array<struct<keyword:string,frequency:bigint>>")
    def most_common(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([[{"keyword": k, "frequency": c} for k, c in Counter(x).most_common(n)] for x in s], dtype=object)

    return most_common


def softmax(logits: Column) -> Column:
    """Normalised exponentials of an ARRAY<DOUBLE> (max-shifted for stability)."""
    m = F.array_max(logits)
    exps = F.transform(logits, lambda x: F.exp(x - m))
    total = F.aggregate(exps, F.lit(0.0).cast("double"), lambda s, x: s + x)
    return F.transform(exps, lambda x: x / total)


def ranked_labels(labels: list[str], scores: Column, tie_round: int = 8) -> Column:
    """ARRAY<STRUCT<label, score>> sorted by score desc, ties by label position.

    ``scores`` is an ARRAY<DOUBLE> aligned with ``labels``. The sort key rounds the score so the
    order does not depend on the last bits of a floating point sum.
    """
    lab = F.array(*[F.lit(x) for x in labels])
    keyed = F.transform(
        scores,
        lambda s, i: F.struct(
            (-F.round(s, tie_round)).alias("k"),
            i.alias("pos"),
            F.get(lab, i).alias("label"),
            s.alias("score"),
        ),
    )
    return F.transform(F.sort_array(keyed), lambda e: F.struct(e["label"].alias("label"), e["score"].alias("score")))


def inline_indexed(arr: Column | str, pos_name: str = "pos", value_name: str = "value") -> Column:
    """Generator of (position, element) rows, like ``posexplode``.

    Written as ``inline(transform(...))``: a code-generated ``posexplode`` over an array that a
    higher-order function computes in the same stage re-evaluates that array for every output
    element; ``inline`` evaluates it once per input row.
    """
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.inline(F.transform(arr, lambda x, i: F.struct(i.alias(pos_name), x.alias(value_name))))


def inline_values(arr: Column | str, value_name: str = "value") -> Column:
    """Generator of one row per element (``explode`` without the re-evaluation issue above)."""
    arr = F.col(arr) if isinstance(arr, str) else arr
    return F.inline(F.transform(arr, lambda x: F.struct(x.alias(value_name))))
