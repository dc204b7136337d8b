"""Values that an expression needs more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once: inside the lambda functions of arrays, anything else would be worked out again for each element."""
    return F.transform(F.array(value), lambda v: use(v))[0]
