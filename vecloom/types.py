"""Metrics, modes, projections, options and errors."""

from __future__ import annotations

import enum
import logging
from dataclasses import dataclass, field


class Metric(enum.Enum):
    COSINE = "cosine"
    EUCLIDEAN = "euclidean"
    DOT = "dot"


class Mode(enum.Enum):
    VECTOR = "vector"
    SCALAR_ONLY = "scalar_only"


class Direction(enum.Enum):
    ASC = "asc"
    DESC = "desc"


class Projection(enum.IntFlag):
    """What a read returns besides the id, which it always returns."""

    ID = 0
    METADATA = 1
    TEXT = 2
    VECTOR = 4
    ALL = 7


class IndexType(enum.Enum):
    ORDERED = "ordered"
    COMPOSITE_ORDERED = "composite_ordered"


@dataclass(frozen=True)
class IndexDefinition:
    """A declared order of metadata: written snapshots are sorted by the first ordered one."""

    name: str
    type: IndexType
    fields: tuple[str, ...]

    def __post_init__(self):
        if not self.name.strip() or not self.fields or any(not f.strip() for f in self.fields):
            raise ValueError("an index needs a name and fields that are not blank")
        if self.type is IndexType.ORDERED and len(self.fields) != 1:
            raise ValueError("an ordered index has exactly one field")


@dataclass(frozen=True)
class Options:
    """Settings of a database. Those of a proximity graph are checked and kept, but search is exact."""

    page_size: int = 8192
    max_dimensions: int = 4096
    hnsw_m: int = 16
    hnsw_ef_construction: int = 200
    hnsw_ef_search: int = 50
    metric: Metric = Metric.COSINE
    checkpoint_interval: float | None = 300.0
    #: Seconds for which data that a checkpoint or a deletion has replaced stays, so that readers made before can end.
    retention: float = 86_400.0
    #: A checkpoint rewrites a collection if more than this share of its records is deleted.
    compaction: float = 0.2
    logger: logging.Logger = field(default_factory=lambda: logging.getLogger("vecloom"))

    def __post_init__(self):
        for name, ok in (
            ("page_size", self.page_size >= 4096 and self.page_size % 4096 == 0), ("max_dimensions", 1 <= self.max_dimensions <= 100_000), ("hnsw_m", 2 <= self.hnsw_m <= 128),
            ("hnsw_ef_construction", 1 <= self.hnsw_ef_construction <= 2000), ("hnsw_ef_search", 1 <= self.hnsw_ef_search <= 2000), ("metric", isinstance(self.metric, Metric)),
            ("checkpoint_interval", self.checkpoint_interval is None or self.checkpoint_interval > 0), ("retention", self.retention >= 0), ("compaction", 0 <= self.compaction <= 1),
        ):
            if not ok:
                raise ValueError(f"{name} is out of range: {getattr(self, name)}")


class StoreError(Exception):
    """Anything that this library raises of its own."""


class StorageError(StoreError):
    pass


class CorruptedFile(StorageError):
    pass


class CollectionError(StoreError):
    def __init__(self, name: str, message: str):
        super().__init__(f"{name}: {message}")
        self.collection = name


class IndexingError(StoreError):
    pass


class DimensionMismatch(IndexingError):
    def __init__(self, expected: int, actual: int):
        super().__init__(f"expected {expected} dimensions, not {actual}")
        self.expected, self.actual = expected, actual
