"""Stable sort orders with the id as last key, and the predicates that continue a page after a cursor.

A missing value is below all others: first ascending, last descending.  NaN is
next.  The id always ascends.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..types import Direction
from .filters import Fields


@dataclass(frozen=True)
class Cursor:
    """The last row of a page: the sort it belongs to, its values and its id."""

    fields: tuple[str, ...]
    directions: tuple[Direction, ...]
    values: tuple[Any, ...]
    record_id: int


def _parts(fields: Fields, name: str) -> list[Column]:
    """A field as sort keys that Spark orders as wanted."""
    f = fields.column(name)
    if f is None:
        return [F.lit(None).cast("string")]
    if fields.family(name) == "fraction":
        return [F.when(f.isNull(), 0).when(F.isnan(f), 1).otherwise(2), F.nanvl(F.coalesce(f, F.lit(0.0)), F.lit(0.0))]
    return [f]


def _values(fields: Fields, name: str, value: Any) -> list[Any]:
    if fields.column(name) is not None and fields.family(name) == "fraction":
        return [0, 0.0] if value is None else [1, 0.0] if value != value else [2, float(value)]
    return [value]


def sort_keys(fields: Fields, order: Sequence[tuple[str, Direction]], id_column: str = "id") -> list[Column]:
    keys = []
    for name, direction in order:
        keys += [k.asc_nulls_first() if direction is Direction.ASC else k.desc_nulls_last() for k in _parts(fields, name)]
    return [*keys, F.col(id_column).asc()]


def check(cursor: Cursor, order: Sequence[tuple[str, Direction]]) -> None:
    if cursor.fields != tuple(f for f, _ in order) or cursor.directions != tuple(d for _, d in order) or len(cursor.values) != len(order):
        raise ValueError("the cursor is of another sort order")


def after(fields: Fields, cursor: Cursor, id_column: str = "id") -> Column:
    """Rows that come strictly after the cursor."""
    out, same = F.lit(False), F.lit(True)
    for name, direction, value in zip(cursor.fields, cursor.directions, cursor.values):
        for f, v in zip(_parts(fields, name), _values(fields, name, value)):
            if direction is Direction.ASC:
                later = f.isNotNull() if v is None else f > v
            else:
                later = F.lit(False) if v is None else (f < v) | f.isNull()
            out = out | (same & F.coalesce(later, F.lit(False)))
            same = same & (f.isNull() if v is None else f.eqNullSafe(F.lit(v)))
    return out | (same & (F.col(id_column) > cursor.record_id))
