"""Scalar queries: predicates, stable sort, top-k, projection and keyset pages; no vectors involved."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from ..plans.filters import Equal, Fields, Filter, where
from ..plans.ordering import Cursor, after, check, sort_keys
from ..types import Direction, Projection


@dataclass(frozen=True)
class Page:
    records: list[Row]
    next_cursor: Cursor | None


def projected(df: DataFrame, projection: Projection, struct: str | None = "metadata") -> DataFrame:
    """The id, and what else the projection asks for of what the collection has."""
    if int(projection) & ~int(Projection.ALL) or projection < 0:
        raise ValueError(f"unknown projection: {projection}")
    fixed = {"id", "vector", "text"}
    names = ["id"]
    if projection & Projection.VECTOR and "vector" in df.columns:
        names.append("vector")
    if projection & Projection.METADATA:
        names += [struct] if struct and struct in df.columns else [c for c in df.columns if c not in fixed]
    if projection & Projection.TEXT and "text" in df.columns:
        names.append("text")
    return df.select(*names)


class ScalarQuery:
    """``ScalarQuery(df).where(...).order_by("f").top_k(10).to_df()``: df has id and metadata."""

    def __init__(self, df: DataFrame, struct: str | None = "metadata"):
        self._df, self._struct = df, struct
        self._filters: list[Filter] = []
        self._order: list[tuple[str, Direction]] = []
        self._k, self._projection, self._cursor = 10, Projection.ALL, None

    def where(self, filter_or_field: Filter | str, value=None) -> ScalarQuery:
        self._filters.append(Equal(filter_or_field, value) if isinstance(filter_or_field, str) else filter_or_field)
        return self

    def order_by(self, field: str, direction: Direction = Direction.ASC) -> ScalarQuery:
        """Sort by this field alone: earlier keys are forgotten."""
        self._order = []
        return self.then_by(field, direction)

    def then_by(self, field: str, direction: Direction = Direction.ASC) -> ScalarQuery:
        if not field or not field.strip():
            raise ValueError("a field needs a name")
        self._order.append((field, Direction(direction)))
        return self

    def top_k(self, k: int | None) -> ScalarQuery:
        """The first k; None for all, which are sorted only if an order is asked for."""
        if k is not None and k < 1:
            raise ValueError("k must be 1 at least")
        self._k = k
        return self

    def select(self, projection: Projection) -> ScalarQuery:
        if int(projection) & ~int(Projection.ALL) or projection < 0:
            raise ValueError(f"unknown projection: {projection}")
        self._projection = projection
        return self

    def after(self, cursor: Cursor) -> ScalarQuery:
        if cursor is None:
            raise ValueError("a cursor is needed")
        self._cursor = cursor
        return self

    def rows(self) -> DataFrame:
        """Matching rows after the cursor, unsorted, with all columns."""
        df = where(self._df, *self._filters, struct=self._struct)
        if self._cursor is not None:
            check(self._cursor, self._order)
            df = df.where(after(Fields(df, self._struct), self._cursor))
        return df

    def sort_keys(self) -> list:
        return sort_keys(Fields(self._df, self._struct), self._order)

    def _taken(self, k: int | None) -> DataFrame:
        if k is None:
            return self.rows().orderBy(*self.sort_keys()) if self._order else self.rows()
        return self.rows().orderBy(*self.sort_keys()).limit(k)

    def to_df(self) -> DataFrame:
        return projected(self._taken(self._k), self._projection, self._struct)

    def to_list(self) -> list[Row]:
        return self.to_df().collect()

    def to_page(self) -> Page:
        """The page's records, and a cursor if there are more."""
        fields = Fields(self._df, self._struct)
        keys = [(fields.column(f) if fields.column(f) is not None else F.lit(None)).alias(f"_k{i}") for i, (f, _) in enumerate(self._order)]
        wanted = projected(self._df, self._projection, self._struct).columns
        if self._k is None:
            raise ValueError("a page needs a size: top_k")
        got = self._taken(self._k + 1).select(*wanted, F.struct(F.col("id").alias("_id"), *keys).alias("_key")).collect()
        kept = got[: self._k]
        cursor = None
        if len(got) > self._k:
            last = kept[-1]["_key"]
            cursor = Cursor(tuple(f for f, _ in self._order), tuple(d for _, d in self._order), tuple(last[f"_k{i}"] for i in range(len(self._order))), last["_id"])
        shape = Row(*wanted)
        return Page([shape(*[r[c] for c in wanted]) for r in kept], cursor)
