"""Small Column helpers that reproduce java.lang.String behaviour."""

from __future__ import annotations

from typing import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


BLANKS = "".join(map(chr, range(0x21)))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` names it.

    Spark shares a repeated expression only where every row needs it, so one that
    is named in a branch or under a lambda is otherwise computed at each place.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fenced(value: Column) -> Column:
    """``value``, computed once per row: keep filters on it above its projection.

    A filter on a computed column (``error IS NULL``, or the one that Spark infers
    from an explode: ``size(outputs) > 0``) is otherwise pushed down with the
    column's expression inlined, re-running the parse and the checks once for each
    mention in the filter and again in the projection. Passing the column through a
    nondeterministic no-op (``spark_partition_id() >= 0``; the optimizer folds
    ``rand() >= 0`` away, it cannot fold this) stops the pushdown here, so each
    expression runs once per row. In the projection that computes the column it costs
    no copy of the row, which a projection of its own does.
    """
    return F.when(F.spark_partition_id() >= F.lit(0), value)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def java_trim(c: Column) -> Column:
    """String.trim(): strips every char <= U+0020 at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    """null or trim().isEmpty() -- never NULL itself."""
    return c.isNull() | (java_trim(c) == F.lit(""))


def is_empty(c: Column) -> Column:
    """null or isEmpty() -- never NULL itself."""
    return c.isNull() | (c == F.lit(""))


def last_index(c: Column, ch: str) -> Column:
    """0-based String.lastIndexOf(ch); -1 when absent."""
    r = F.locate(ch, F.reverse(c))
    return F.when(r > 0, F.length(c) - r).otherwise(F.lit(-1))


def first_index(c: Column, ch: str) -> Column:
    """0-based String.indexOf(ch); -1 when absent."""
    return F.locate(ch, c) - F.lit(1)


def substring_from(c: Column, idx0: Column) -> Column:
    """Java substring(idx0): 0-based start, to the end."""
    return F.substr(c, idx0 + F.lit(1))


def substring_to(c: Column, idx0: Column) -> Column:
    """Java substring(0, idx0)."""
    return F.substr(c, F.lit(1), idx0)
