"""Column expressions built once.

A column is a tree of JVM objects; building a long one takes hundreds of calls from Python, which a
micro-batch of a few rows would repeat for every batch. It names its inputs, so it holds for every
frame that has them.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from typing import TypeVar

from pyspark import SparkContext

T = TypeVar("T")


def once(make: Callable[..., T]) -> Callable[..., T]:
    """Keep what ``make`` returns by its (hashable) arguments, as long as the Spark context lives."""
    kept: dict = {}
    owner: list = []

    @wraps(make)
    def get(*args) -> T:
        if not owner or owner[0] is not SparkContext._active_spark_context:
            kept.clear()
            owner[:] = [SparkContext._active_spark_context]
        if args not in kept:
            kept[args] = make(*args)
        return kept[args]

    return get
