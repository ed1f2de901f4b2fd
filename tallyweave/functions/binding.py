"""Name a value inside an expression so that it is computed once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body(value)` with `value` evaluated a single time.

    Array functions evaluate whatever their lambda mentions once per element, also
    parts that do not depend on the element. A lambda variable is already a value,
    so binding such parts to one keeps the work linear.
    """
    return F.element_at(F.transform(F.array(value), body), 1)
