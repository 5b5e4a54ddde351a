"""Keeping the user's columns apart from an operator's own."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REST = "_rest"


def set_aside(docs: DataFrame, used: list[str]) -> tuple[DataFrame, Callable[..., DataFrame]]:
    """The used columns and all others in one struct column, so that columns an
    operator adds or works with meet none of them; and a function that gives its
    result rows the input's columns back (``without`` some, ``plus`` some of the
    operator's)."""
    others = [c for c in docs.columns if c not in used]
    struct = [F.struct(*[docs[f"`{c}`"].alias(c) for c in others]).alias(REST)] if others else []
    frame = docs.select(*[docs[f"`{c}`"] for c in docs.columns if c in used], *struct)

    def back(result: DataFrame, without: tuple[str, ...] = (), plus: tuple[str, ...] = ()) -> DataFrame:
        own = [F.col(f"`{c}`") if c in used else F.col(REST)[c].alias(c) for c in docs.columns if c not in without]
        return result.select(*own, *plus)

    return frame, back
