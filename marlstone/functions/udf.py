"""Arrow-batched functions that are registered when first used, so that importing needs no session."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow_udf(kind: str) -> Callable:
    def keep(f: Callable) -> Callable[..., Column]:
        @wraps(f, assigned=("__name__", "__doc__"))
        def call(*columns: Column | str) -> Column:
            return F.pandas_udf(f, kind)(*columns)

        return call

    return keep
