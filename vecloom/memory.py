"""A memory store keyed by strings, over collections: what language-model frameworks ask for."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

from .sources.store import Collection, Database, VectorRecord

KEY, ADDITIONAL = "_key", "_additional"
DEFAULT_DIMENSIONS = 1536


@dataclass(frozen=True)
class Memory:
    key: str
    text: str = ""
    embedding: Sequence[float] = field(default_factory=tuple)
    additional: str | None = None


class MemoryStore:
    """Collections come to be with their first record, of its dimension."""

    def __init__(self, database: Database):
        self._db = database

    def create_collection(self, name: str) -> None:
        """Nothing yet: the first record decides the dimension."""

    def collections(self) -> list[str]:
        return self._db.names()

    def exists(self, name: str) -> bool:
        return self._db.exists(name)

    def delete_collection(self, name: str) -> None:
        self._db.delete(name)

    def upsert(self, name: str, memory: Memory) -> str:
        return next(self.upsert_batch(name, [memory]))

    def upsert_batch(self, name: str, memories: Iterable[Memory]) -> Iterator[str]:
        """All in one commit and one scan; of memories with one key the last stays."""
        given = list(memories)
        if not given:
            return iter(())
        dimensions = next((len(m.embedding) for m in given if len(m.embedding)), DEFAULT_DIMENSIONS)
        collection = self._db.get(name) or self._db.get_or_create(name, dimensions)
        empty = [0.0] * collection.dimensions
        rows = [VectorRecord(m.embedding if len(m.embedding) else empty, {KEY: m.key} | ({ADDITIONAL: m.additional} if m.additional else {}), m.text) for m in given]
        collection.upsert_batch(rows, KEY)
        return iter([m.key for m in given])

    def _memory(self, row, embedding: bool) -> Memory:
        metadata = row["metadata"].asDict() if row["metadata"] is not None else {}
        return Memory(metadata.get(KEY) or "", row["text"] or "", tuple(row["vector"]) if embedding else (), metadata.get(ADDITIONAL))

    def get(self, name: str, key: str, embedding: bool = False) -> Memory | None:
        return next(iter(self.get_batch(name, [key], embedding)), None)

    def get_batch(self, name: str, keys: Iterable[str], embedding: bool = False) -> list[Memory]:
        """Memories in the order of their keys, without missing ones."""
        collection, keys = self._db.get(name), list(keys)
        if collection is None or not keys or KEY not in collection.metadata_schema.names:
            return []
        asked = self._db.spark.createDataFrame(list(enumerate(keys)), "_pos long, _asked string")
        df = collection.df()
        rows = asked.join(df, asked["_asked"] == df[f"metadata.{KEY}"]).orderBy("_pos", "id").collect()
        first = {r["_pos"]: r for r in reversed(rows)}
        return [self._memory(first[i], embedding) for i in range(len(keys)) if i in first]

    def remove(self, name: str, key: str) -> None:
        self.remove_batch(name, [key])

    def remove_batch(self, name: str, keys: Iterable[str]) -> None:
        collection = self._db.get(name)
        if collection is not None:
            collection.delete_values(KEY, keys)

    def nearest_matches(self, name: str, embedding: Sequence[float], limit: int, min_relevance: float = 0.0, with_embeddings: bool = False) -> list[tuple[Memory, float]]:
        collection: Collection | None = self._db.get(name)
        if collection is None or limit < 1:
            return []
        found = collection.query(embedding).top_k(limit).with_min_score(min_relevance).to_list()
        return [(self._memory(r, with_embeddings), r["score"]) for r in found]

    def nearest_match(self, name: str, embedding: Sequence[float], min_relevance: float = 0.0, with_embeddings: bool = False) -> tuple[Memory, float] | None:
        return next(iter(self.nearest_matches(name, embedding, 1, min_relevance, with_embeddings)), None)
