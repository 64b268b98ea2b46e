"""Columns that are made once: an expression doesn't depend on the table that it is applied to."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from functools import wraps

from pyspark import SparkContext
from pyspark.sql import Column

_made: dict[tuple, dict[str, Column]] = {}


def kept(make: Callable[..., dict[str, Column]]) -> Callable[..., dict[str, Column]]:
    """Remembers the named columns that a function makes, for each set of arguments and for as long as the JVM that holds them lives.

    Building the thousands of expressions of a record takes seconds, as each is a call to the JVM.
    """

    @wraps(make)
    def run(*args: Hashable) -> dict[str, Column]:
        key = (id(SparkContext._gateway), make.__module__, make.__name__, *args)
        if key not in _made:
            if len(_made) >= 256:  # engines with ever new plugins
                _made.clear()
            _made[key] = make(*args)
        return _made[key]

    return run
