"""Bind a column once inside an expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used.

    Catalyst may inline a column into a lambda, where it would be computed for
    every element; a lambda's own argument is never computed again.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
