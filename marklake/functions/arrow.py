"""Arrow UDFs that are made when a plan first needs them: making one takes a session, importing its module must not."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lazy(ddl: str, deterministic: bool = True) -> Callable[[Callable], Callable[..., Column]]:
    """Decorates a function of Arrow arrays. The function itself stays reachable as `.plain`.

    Not deterministic in name only means: evaluated once even where a filter refers to the result. Filters that don't
    need it must then be applied to the records first.
    """

    def wrap(fn: Callable) -> Callable[..., Column]:
        def call(*columns: Column) -> Column:
            made = F.arrow_udf(fn, ddl)
            return (made if deterministic else made.asNondeterministic())(*columns)

        call.plain = fn
        call.__doc__ = fn.__doc__
        return call

    return wrap
