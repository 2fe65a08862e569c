"""Pandas UDFs that may be defined before there is a session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def column_function(kind: str) -> Callable[[Callable], Callable[..., Column]]:
    """Like ``pandas_udf``; the type is parsed at the first call."""

    def decorate(f: Callable) -> Callable[..., Column]:
        @wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        call.plain = f
        return call

    return decorate
