"""Local names inside an expression.

The optimiser may copy an expression into every place that uses its alias, a filter above it or
the body of a lambda included. Binding keeps it evaluated once per row wherever it ends up.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def bind_all(values: Sequence[Column], body: Callable[..., Column]) -> Column:
    """The same for several values."""
    packed = F.struct(*[v.alias(f"v{i}") for i, v in enumerate(values)])
    return bind(packed, lambda p: body(*[p[f"v{i}"] for i in range(len(values))]))
