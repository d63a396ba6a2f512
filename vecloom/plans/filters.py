"""A small algebra of predicates over metadata that compiles to a Column.

Logic has two values: a field that a record lacks (NULL) equals nothing, is in no
range, and so differs from everything.  Comparisons stay bare in positive
places, where NULL drops a row anyway and Parquet can use them; only below a Not
they are made null-safe.  Equality is strict about kinds of values: truth values,
whole numbers, fractions and texts never equal each other.  Ranges compare
numbers of either kind.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T



class Fields:
    """Finds metadata fields in a DataFrame: in a struct column ``metadata``, or among its columns."""

    def __init__(self, df: DataFrame, struct: str | None = "metadata"):
        kind = df.schema[struct].dataType if struct and struct in df.columns else None
        self.prefix = f"`{struct}`." if isinstance(kind, T.StructType) else ""
        self.types = {f.name: f.dataType for f in (kind if isinstance(kind, T.StructType) else df.schema).fields}

    def column(self, name: str) -> Column | None:
        return F.col(f"{self.prefix}`{name}`") if name in self.types else None

    def family(self, name: str) -> str:
        return family_of_type(self.types[name])


def family_of_type(kind: T.DataType) -> str:
    if isinstance(kind, T.BooleanType):
        return "bool"
    if isinstance(kind, T.IntegralType):
        return "whole"
    if isinstance(kind, (T.FractionalType,)):
        return "fraction"
    return "text" if isinstance(kind, T.StringType) else kind.typeName()


def family_of_value(value: Any) -> str:
    import datetime

    if isinstance(value, bool):
        return "bool"
    if isinstance(value, int):
        return "whole"
    if isinstance(value, float):
        return "fraction"
    if isinstance(value, datetime.datetime):
        return "timestamp"
    return "text" if isinstance(value, str) else type(value).__name__


def _named(name: str) -> None:
    if not isinstance(name, str) or not name.strip():
        raise ValueError("a field needs a name")


class Filter:
    def column(self, fields: Fields, negated: bool = False) -> Column:
        raise NotImplementedError

    def __and__(self, other: Filter) -> And:
        return And(self, other)

    def __or__(self, other: Filter) -> Or:
        return Or(self, other)

    def __invert__(self) -> Not:
        return Not(self)


@dataclass(frozen=True)
class Equal(Filter):
    field: str
    value: Any

    def __post_init__(self):
        _named(self.field)
        if self.value is None:
            raise ValueError("a value is needed")

    def column(self, fields: Fields, negated: bool = False) -> Column:
        f = fields.column(self.field)
        if f is None or fields.family(self.field) != family_of_value(self.value):
            return F.lit(False)
        return f.eqNullSafe(F.lit(self.value)) if negated else f == F.lit(self.value)


@dataclass(frozen=True)
class NotEqual(Filter):
    """All records but those that are equal: also those without the field."""

    field: str
    value: Any

    __post_init__ = Equal.__post_init__

    def column(self, fields: Fields, negated: bool = False) -> Column:
        return ~Equal(self.field, self.value).column(fields, True)


@dataclass(frozen=True)
class In(Filter):
    field: str
    values: Sequence[Any]

    def __post_init__(self):
        _named(self.field)

    def column(self, fields: Fields, negated: bool = False) -> Column:
        f = fields.column(self.field)
        own = [] if f is None else [v for v in self.values if family_of_value(v) == fields.family(self.field)]
        if not own:
            return F.lit(False)
        return F.coalesce(f.isin(own), F.lit(False)) if negated else f.isin(own)


@dataclass(frozen=True)
class Range(Filter):
    """Values from ``low`` to ``high``; by default the lower bound belongs to the range and the upper does not."""

    field: str
    low: Any = None
    high: Any = None
    low_inclusive: bool = True
    high_inclusive: bool = False

    def __post_init__(self):
        _named(self.field)

    def column(self, fields: Fields, negated: bool = False) -> Column:
        f = fields.column(self.field)
        if f is None:
            return F.lit(False)
        kind = fields.family(self.field)
        out = f.isNotNull() if self.low is None and self.high is None else None
        for bound, lower, closed in ((self.low, True, self.low_inclusive), (self.high, False, self.high_inclusive)):
            if bound is None:
                continue
            own = family_of_value(bound)
            if not (own == kind or {own, kind} == {"whole", "fraction"}) or bound != bound:
                return F.lit(False)
            if kind == "whole" and own == "fraction":  # a whole bound, which Parquet can use
                if math.isinf(bound):
                    test = f.isNotNull() if (bound < 0) == lower else F.lit(False)
                else:
                    up, down = math.ceil(bound), math.floor(bound)
                    test = (f >= up if closed else f > down) if lower else (f <= down if closed else f < up)
            else:
                test = (f >= bound if closed else f > bound) if lower else (f <= bound if closed else f < bound)
                if kind == "fraction":  # NaN is below all numbers
                    test = test & ~F.isnan(f) if lower else test | F.isnan(f)
            out = test if out is None else out & test
        return F.coalesce(out, F.lit(False)) if negated else out


class _Many(Filter):
    def __init__(self, *operands: Filter):
        self.operands = operands

    def __eq__(self, other):
        return type(self) is type(other) and self.operands == other.operands

    __hash__ = object.__hash__


class And(_Many):
    """All of its operands; without operands nothing."""

    def column(self, fields: Fields, negated: bool = False) -> Column:
        return reduce(lambda a, b: a & b, [o.column(fields, negated) for o in self.operands]) if self.operands else F.lit(False)


class Or(_Many):
    """Any of its operands; without operands nothing."""

    def column(self, fields: Fields, negated: bool = False) -> Column:
        return reduce(lambda a, b: a | b, [o.column(fields, negated) for o in self.operands]) if self.operands else F.lit(False)


@dataclass(frozen=True)
class Not(Filter):
    operand: Filter

    def column(self, fields: Fields, negated: bool = False) -> Column:
        return ~self.operand.column(fields, True)


def where(df: DataFrame, *filters: Filter | None, struct: str | None = "metadata") -> DataFrame:
    """The rows for which all filters hold."""
    fields = Fields(df, struct)
    for f in filters:
        df = df if f is None else df.where(f.column(fields))
    return df
