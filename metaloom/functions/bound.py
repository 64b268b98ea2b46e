"""A value that an expression uses several times and that is made once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value as the variable of a lambda.

    Inside higher-order functions each mention of a column's expression is evaluated again, in nested lambdas for each element.
    """
    return F.get(F.transform(F.array(value), lambda x: use(x)), F.lit(0))
