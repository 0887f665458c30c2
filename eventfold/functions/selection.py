"""Selection-list operations (OP-41..43)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _empty() -> Column:
    return F.array().cast("array<string>")


def sel_union(new: Column, old: Column) -> Column:
    """Ordered distinct union, items of ``new`` first, then unseen items of ``old``.

    A null side counts as empty, so the result is never null.
    """
    return F.array_union(F.coalesce(new, _empty()), F.coalesce(old, _empty()))


def sel_remove(old: Column, remove: Column) -> Column:
    """Drop every item of ``old`` found in ``remove``; other repeats stay.

    ``array_except`` would also de-duplicate the survivors, so a filter is used.
    """
    rm = F.coalesce(remove, _empty())
    return F.filter(F.coalesce(old, _empty()), lambda x: ~F.coalesce(F.array_contains(rm, x), F.lit(False)))


def sel_clear() -> Column:
    """An empty (not null) selection."""
    return _empty()
