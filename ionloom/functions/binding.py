"""Naming an intermediate value inside a column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(f: Callable[[Column], Column], **values: Column) -> Column:
    """``f`` over a struct of ``values``, each computed once a row: a lambda would compute an outer expression for every element."""
    return F.transform(F.array(F.struct(*[v.alias(k) for k, v in values.items()])), f)[0]
