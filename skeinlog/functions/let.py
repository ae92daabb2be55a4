"""Binding a column to a name, so that it is computed once however often it is used."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once a row: a lambda's argument isn't written out at each place."""
    return F.get(F.transform(F.array(value), lambda bound: use(bound)), F.lit(0))
