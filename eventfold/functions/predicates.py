"""Boolean Column predicates on a trigger row and a looked-up table struct.

A null operand that would raise in a row-at-a-time implementation makes the
predicate false here, so a row is refused rather than dropped by an error.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def change_granted(settings: Column, selection: Column) -> Column:
    """OP-14: a stored selection may change iff same service, same owner,
    not shared and unnamed."""
    return (
        _true(settings["service"] == selection["service"])
        & _true(settings["user_id"] == selection["user_id"])
        & ~F.coalesce(settings["shared"], F.lit(True))
        & settings["name"].isNull()
    )


def deletable(settings: Column, user_id: Column) -> Column:
    """OP-15: not shared and owned by the caller."""
    return ~F.coalesce(settings["shared"], F.lit(True)) & _true(user_id == settings["user_id"])


def same_session(confirmed_session: Column, request_session: Column) -> Column:
    """OP-16: a confirmation is accepted only from the request's session."""
    return _true(confirmed_session == request_session)


def author_differs(stored_user: Column, caller: Column) -> Column:
    """OP-17: reject iff a stored author exists and is not the caller."""
    return stored_user.isNotNull() & ~_true(stored_user == caller)


def clone_visible(state_user: Column, settings: Column, caller: Column) -> Column:
    """OP-18: the clone source is the caller's own item or is shared."""
    return _true(state_user == caller) | _true(settings["shared"])


def is_locked(type_col: Column, accepted: Iterable[str]) -> Column:
    """OP-19: a type the family's fold does not accept locks the item."""
    return ~type_col.isin(list(accepted))


def within_timeout(date: Column, as_of: Column, timeout_ms: int, mode: str = "reference") -> Column:
    """OP-20: blocked-event test.

    ``mode="reference"`` keeps the original rule, ``date + timeout`` is after
    ``as_of`` (so it selects events younger than the timeout, quirk Q1);
    ``mode="older"`` selects events whose timeout has run out.
    """
    deadline = date + F.make_dt_interval(secs=F.lit(timeout_ms / 1000.0))
    if mode == "reference":
        return _true(deadline > as_of)
    if mode == "older":
        return _true(deadline <= as_of)
    raise ValueError(f"unknown mode {mode!r}")
