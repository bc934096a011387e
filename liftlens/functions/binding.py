"""Name an intermediate value inside an expression."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body reads it.

    Inside array functions Spark does not share common subexpressions, so a value read several times
    would be computed several times.
    """
    return F.transform(F.array(value), body)[0]


def record(**fields: Column) -> Column:
    """Struct with the given field names."""
    return F.named_struct(*[x for name, value in fields.items() for x in (F.lit(name), value)])


def constant_map(entries: Mapping[str, str]) -> Column:
    """Fixed string map as one literal, folded to a constant by the planner."""
    text = "\x01".join(f"{key}\x02{value}" for key, value in entries.items())
    return F.str_to_map(F.lit(text), F.lit("\x01"), F.lit("\x02"))
