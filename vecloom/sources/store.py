"""A database of collections below one path: Parquet snapshots, an operation log, and a versioned catalog.

    <path>/catalog/<version>.json            all collections; the highest version holds
    <path>/data/<collection>/<unique>/       a snapshot, or the rows of one logged change

A change writes its rows to a folder of their own and then commits by creating
the next catalog version, which fails if another writer was first.  Folders
that no catalog names are not read, so a change that broke off leaves no trace.
Opening a database reads the catalog: snapshot and log together are the current
state, whether or not there was a checkpoint.

Reads are lazy, so a folder that a checkpoint or a deletion replaces is only
marked as retired; it is deleted when it has been so for ``Options.retention``
seconds.  A DataFrame that was made before gives the same rows until then.  A
checkpoint rewrites a collection only when that is worth it: when too many of
its records are deleted, or its log has grown to half of its snapshot.  Else a
long log is put together as one change, without touching the snapshot.

Ids are never used twice, so a deletion in the log beats any insertion.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Iterable, Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import records
from ..operators.scalar import ScalarQuery, projected
from ..operators.search import VectorQuery
from ..types import CollectionError, CorruptedFile, DimensionMismatch, IndexDefinition, IndexType, Metric, Mode, Options, Projection
from .files import Files

#: Changes of a log that stay apart.
LOGGED = 64
SCALARS = {bool: T.BooleanType(), int: T.LongType(), float: T.DoubleType(), str: T.StringType()}


@dataclass(frozen=True)
class VectorRecord:
    vector: Sequence[float]
    metadata: dict[str, Any] | None = None
    text: str | None = None
    id: int | None = None


@dataclass(frozen=True)
class ScalarRecord:
    metadata: dict[str, Any] | None = None
    text: str | None = None
    id: int | None = None


def row_schema(mode: Mode, metadata: T.StructType) -> T.StructType:
    """A collection's columns; without metadata fields the column has no place in files."""
    fields = [T.StructField("id", T.LongType(), False), T.StructField("metadata", metadata), T.StructField("text", T.StringType())]
    if mode is Mode.VECTOR:
        fields.insert(1, T.StructField("vector", T.ArrayType(T.FloatType(), True)))
    return T.StructType(fields)


def merged(name: str, old: T.StructType, new: Iterable[T.StructField]) -> T.StructType:
    """The fields of both; a field keeps its type, as equality is strict about it."""
    fields = {f.name: f for f in old.fields}
    for f in new:
        if f.name in fields and fields[f.name].dataType != f.dataType:
            raise CollectionError(name, f"{f.name} holds {fields[f.name].dataType.simpleString()}, not {f.dataType.simpleString()}")
        fields.setdefault(f.name, T.StructField(f.name, f.dataType))
    return T.StructType(list(fields.values()))


class Collection:
    """Records of one collection. Reads see the catalog as it is when they are made; writes commit at once."""

    def __init__(self, database: Database, name: str):
        self._db, self.name = database, name

    # --- what it is

    @property
    def _state(self) -> dict:
        state = self._db._catalog["collections"].get(self.name)
        if state is None:
            raise CollectionError(self.name, "no such collection")
        return state

    @property
    def mode(self) -> Mode:
        return Mode(self._state["mode"])

    @property
    def dimensions(self) -> int:
        return self._state["dimensions"]

    @property
    def metric(self) -> Metric:
        return Metric(self._state["metric"])

    @property
    def metadata_schema(self) -> T.StructType:
        return T.StructType.fromJson(self._state["metadata"])

    @property
    def count(self) -> int:
        return self.df().count()

    def _need(self, mode: Mode) -> None:
        if self.mode is not mode:
            raise CollectionError(self.name, f"this needs a collection of mode {mode.value}")

    # --- reading

    def df(self) -> DataFrame:
        """All live records: snapshot and logged insertions, without what the log deletes."""
        spark, state = self._db.spark, self._state
        schema = row_schema(self.mode, self.metadata_schema)
        folders = [*([state["snapshot"]] if state["snapshot"] else []), *[x["path"] for x in state["log"] if x["op"] == "insert"]]
        if not folders:
            return spark.createDataFrame([], schema)
        stored = T.StructType([f for f in schema.fields if f.name != "metadata" or len(f.dataType.fields)])
        out = spark.read.schema(stored).parquet(*[self._db._at(x) for x in folders])
        if len(stored) < len(schema):
            out = out.select(*[F.lit(None).cast(f.dataType).alias(f.name) if f.name == "metadata" else f.name for f in schema.fields])
        gone = [x["path"] for x in state["log"] if x["op"] == "delete"]
        if gone:
            out = records.deleted(out, spark.read.schema("id long").parquet(*[self._db._at(x) for x in gone]))
        return out

    def get(self, record_id: int) -> Row | None:
        self._need(Mode.VECTOR)
        return records.get(self.df(), record_id).first()

    def get_batch(self, ids: Iterable[int], projection: Projection = Projection.ALL) -> list[Row]:
        """Records in the order asked for, repeated as asked for, without missing ones."""
        ids = list(ids)
        wanted = projected(self.df(), projection)
        if not ids:
            return []
        asked = self._db.spark.createDataFrame(list(enumerate(ids)), "pos long, id long")
        shape = Row(*wanted.columns)
        return [shape(*r[1:]) for r in records.get_batch(wanted, asked).orderBy("pos").collect()]

    def find_ids(self, field: str, value: Any) -> list[int]:
        return [r["id"] for r in records.find_ids(self.df(), field, value).collect()]

    def query(self, vector: Sequence[float]) -> VectorQuery:
        self._need(Mode.VECTOR)
        return VectorQuery(self.df(), vector, self.metric, self.dimensions)

    def filter(self) -> ScalarQuery:
        return ScalarQuery(self.df())

    def register(self, view: str) -> None:
        """Make the records a temporary view for SQL."""
        self.df().createOrReplaceTempView(view)

    # --- writing

    def _rows(self, given: Sequence[VectorRecord | ScalarRecord], first: int) -> tuple[list[tuple], T.StructType]:
        vectors = self.mode is Mode.VECTOR
        kinds: dict[str, T.StructField] = {}
        for r in given:
            if vectors and len(r.vector) != self.dimensions:
                raise DimensionMismatch(self.dimensions, len(r.vector))
            for field, value in (r.metadata or {}).items():
                if value is None:
                    continue
                kind = SCALARS.get(type(value), T.StringType())
                if field in kinds and kinds[field].dataType != kind:
                    raise CollectionError(self.name, f"{field} has values of several types")
                kinds[field] = T.StructField(field, kind)
        schema = merged(self.name, self.metadata_schema, kinds.values())
        kept = lambda v: v if v is None or type(v) in SCALARS else str(v)
        rows = []
        for i, r in enumerate(given):
            metadata = tuple(kept((r.metadata or {}).get(f.name)) for f in schema.fields)
            rows.append((first + i, *([[float(x) for x in r.vector]] if vectors else []), metadata, r.text or None))
        return rows, schema

    def _insert(self, given: Sequence[VectorRecord | ScalarRecord], gone: DataFrame | None = None) -> list[int]:
        with self._db._lock:
            first = self._state["next_id"]
            rows, schema = self._rows(given, first)
            df = self._db.spark.createDataFrame(rows, row_schema(self.mode, schema))
            log = [self._db._logged(self.name, "insert", df, len(rows))] if rows else []
            if gone is not None and (entry := self._deleted(gone)):
                log.append(entry)
            self._db._commit(self.name, next_id=first + len(rows), metadata=schema.jsonValue(), log=[*self._state["log"], *log])
            return list(range(first, first + len(rows)))

    def insert(self, record: VectorRecord) -> int:
        return self.insert_batch([record])[0]

    def insert_batch(self, given: Iterable[VectorRecord]) -> list[int]:
        """Ids in the order given. Nothing is written unless all vectors have the right dimensions."""
        self._need(Mode.VECTOR)
        return self._insert(list(given))

    def insert_scalar(self, record: ScalarRecord) -> int:
        return self.insert_scalar_batch([record])[0]

    def insert_scalar_batch(self, given: Iterable[ScalarRecord]) -> list[int]:
        self._need(Mode.SCALAR_ONLY)
        return self._insert(list(given))

    def insert_df(self, df: DataFrame, order: Sequence[str] = (), **also: Any) -> tuple[int, int]:
        """Insert a DataFrame (vector, metadata struct, text, as the mode has them) of any size; returns the ids' range.

        Ids follow ``order``, or else the order in which Spark reads the rows.
        The rows are written once before they get ids, as a plan that runs
        twice might deal them otherwise.  ``also`` is committed with them.
        """
        wanted = [c for c in ("vector", "metadata", "text") if c in df.columns]
        if self.mode is Mode.VECTOR:
            if "vector" not in wanted:
                raise CollectionError(self.name, "this needs a vector column")
        else:
            wanted = [c for c in wanted if c != "vector"]
        ranged = df.repartitionByRange(*order).sortWithinPartitions(*order) if order else df
        staged = self._db._written(self.name, ranged.select(*wanted).withColumn("_at", F.monotonically_increasing_id()))
        raw = self._db.spark.read.parquet(self._db._at(staged))
        if self.mode is Mode.VECTOR:
            wrong = raw.where(F.coalesce(F.size("vector"), F.lit(-1)) != self.dimensions).select(F.coalesce(F.size("vector"), F.lit(0)).alias("n")).first()
            if wrong is not None:
                self._db._files.delete(self._db._at(staged))
                raise DimensionMismatch(self.dimensions, wrong["n"])
        with self._db._lock:
            kind = raw.schema["metadata"].dataType if "metadata" in raw.columns else T.StructType([])
            schema = merged(self.name, self.metadata_schema, kind.fields)
            own = {f.name for f in kind.fields}
            struct = F.struct(*[(F.col(f"metadata.`{f.name}`") if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema.fields]) if schema.fields else F.lit(None).cast(schema)
            first = self._state["next_id"]
            text = F.nullif("text", F.lit("")) if "text" in raw.columns else F.lit(None).cast("string")
            rows = records.dense(raw, first).select("id", *([F.col("vector").cast("array<float>").alias("vector")] if self.mode is Mode.VECTOR else []), struct.alias("metadata"), text.alias("text"))
            n = raw.count()
            logged = self._db._logged(self.name, "insert", rows, n)
            self._db._commit(self.name, next_id=first + n, metadata=schema.jsonValue(), log=[*self._state["log"], logged], **also)
        self._db._files.delete(self._db._at(staged))
        return first, first + n

    def upsert(self, record: VectorRecord | ScalarRecord, key_field: str) -> int:
        """Insert, and delete the records that have the same value of ``key_field``, in one commit."""
        return self.upsert_batch([record], key_field)[0]

    def upsert_batch(self, given: Iterable[VectorRecord | ScalarRecord], key_field: str) -> list[int]:
        """Upsert records in order, in one commit and one scan; of those with one value the last stays. Ids of those that stay."""
        last: dict[Any, VectorRecord | ScalarRecord] = {}
        for record in given:
            value = (record.metadata or {}).get(key_field)
            if value is None:
                raise ValueError(f"the record's metadata has no {key_field}")
            self._need(Mode.VECTOR if isinstance(record, VectorRecord) else Mode.SCALAR_ONLY)
            last.pop((type(value), value), None)
            last[type(value), value] = record
        with self._db._lock:
            return self._insert(list(last.values()), self._with_values(key_field, [v for _, v in last])) if last else []

    def _with_values(self, field: str, values: Sequence[Any]) -> DataFrame | None:
        """The ids of records whose field has one of some values, of its own kind."""
        kind = next((f.dataType for f in self.metadata_schema.fields if f.name == field), None)
        own = [(v,) for v in values if kind is not None and SCALARS.get(type(v), T.StringType()) == kind]
        if not own:
            return None
        asked = self._db.spark.createDataFrame(own, T.StructType([T.StructField("_value", kind)])).distinct()
        df = self.df()
        return df.join(asked, F.col(f"metadata.`{field}`") == F.col("_value"), "left_semi").select("id")

    def delete_values(self, field: str, values: Iterable[Any]) -> int:
        """Delete the records whose field has one of some values, in one scan; how many went."""
        found = self._with_values(field, list(values))
        return 0 if found is None else self.delete_df(found)

    def _deleted(self, gone: DataFrame) -> dict | None:
        """A logged deletion of ids that are there, not committed yet; None if there are none."""
        logged = self._db._logged(self.name, "delete", gone, 0)
        logged["rows"] = self._db.spark.read.schema("id long").parquet(self._db._at(logged["path"])).count()
        if logged["rows"]:
            return logged
        self._db._files.delete(self._db._at(logged["path"]))
        return None

    def delete(self, record_id: int) -> bool:
        return self.delete_batch([record_id]) == 1

    def delete_batch(self, ids: Iterable[int]) -> int:
        """How many records went; an id that repeats counts once."""
        asked = [(int(i),) for i in ids]
        return self.delete_df(self._db.spark.createDataFrame(asked, "id long")) if asked else 0

    def delete_df(self, ids: DataFrame) -> int:
        with self._db._lock:
            logged = self._deleted(self.df().select("id").join(ids.select(F.col("id").cast("long")), "id", "left_semi"))
            if logged:
                self._db._commit(self.name, log=[*self._state["log"], logged])
            return logged["rows"] if logged else 0

    # --- declared orders

    def create_index(self, definition: IndexDefinition) -> None:
        """Declare an order: the first ordered one sorts snapshots, so that range predicates skip row groups."""
        with self._db._lock:
            known = self._state["indexes"]
            if any(x["name"] == definition.name for x in known):
                raise CollectionError(self.name, f"there is an index {definition.name}")
            self._db._commit(self.name, indexes=[*known, {"name": definition.name, "type": definition.type.value, "fields": list(definition.fields)}])

    def list_indexes(self) -> list[IndexDefinition]:
        return [IndexDefinition(x["name"], IndexType(x["type"]), tuple(x["fields"])) for x in self._state["indexes"]]


class Database:
    """Collections below a path that all executors reach. One writer at a time commits; readers need no lock, as what
    they read stays for the time of retention."""

    def __init__(self, spark: SparkSession, path: str, options: Options | None = None):
        self.spark, self.path, self.options = spark, path.rstrip("/"), options or Options()
        self._lock, self._closed = threading.RLock(), False
        self._files = Files(spark, self.path)
        self._files.make(f"{self.path}/catalog")
        self._load()
        self._stop, self._timer = threading.Event(), None
        if self.options.checkpoint_interval:
            self._timer = threading.Thread(target=self._tick, daemon=True)
            self._timer.start()

    def _tick(self) -> None:
        while not self._stop.wait(self.options.checkpoint_interval):
            try:
                self.checkpoint()
            except Exception:  # the next one, or close(), tries again
                self.options.logger.exception("checkpoint failed")

    # --- catalog

    def _at(self, relative: str) -> str:
        return f"{self.path}/data/{relative}"

    def _load(self) -> None:
        names = [n for n in self._files.names(f"{self.path}/catalog") if re.fullmatch(r"\d{12}\.json", n)]
        if not names:
            self._version, self._catalog = 0, {"collections": {}}
            return
        try:
            self._version, self._catalog = int(names[-1][:12]), json.loads(self._files.read(f"{self.path}/catalog/{names[-1]}"))
        except ValueError as e:
            raise CorruptedFile(f"{self.path}/catalog/{names[-1]}") from e

    def _write_catalog(self, catalog: dict) -> None:
        if self._closed:
            raise CollectionError(self.path, "the database is closed")
        if not self._files.create(f"{self.path}/catalog/{self._version + 1:012d}.json", json.dumps(catalog)):
            self._load()
            raise CollectionError(self.path, "another writer was first; the catalog has been read again")
        self._version, self._catalog = self._version + 1, catalog
        for old in self._files.names(f"{self.path}/catalog")[:-8]:  # a few remain for readers that are opening
            self._files.delete(f"{self.path}/catalog/{old}")

    def _commit(self, name: str, retired: Sequence[str] = (), **changes: Any) -> None:
        collections = dict(self._catalog["collections"])
        collections[name] = {**collections[name], **changes}
        self._write_catalog({"collections": collections, "retired": self._retired(retired)})

    def _retired(self, paths: Sequence[str] = ()) -> list[dict]:
        """Folders that are no longer part of the state, and since when."""
        return [*self._catalog.get("retired", []), *({"path": p, "at": time.time()} for p in paths)]

    def _expire(self) -> None:
        """Delete what has been retired for long enough."""
        known = self._retired()
        old = [x for x in known if x["at"] <= time.time() - self.options.retention]
        if old:
            self._write_catalog({**self._catalog, "retired": [x for x in known if x not in old]})
            for x in old:
                self._files.delete(self._at(x["path"]))

    def _written(self, name: str, df: DataFrame) -> str:
        relative = f"{self._catalog['collections'][name]['folder']}/{uuid.uuid4().hex}"
        if "metadata" in df.columns and not df.schema["metadata"].dataType.fields:
            df = df.drop("metadata")
        df.write.parquet(self._at(relative))
        return relative

    def _logged(self, name: str, op: str, df: DataFrame, rows: int) -> dict:
        return {"op": op, "path": self._written(name, df), "seq": self._version + 1, "rows": rows}

    # --- collections

    def _create(self, name: str, mode: Mode, dimensions: int) -> Collection:
        if not name or not name.strip():
            raise ValueError("a collection needs a name")
        if dimensions < 1:
            raise ValueError("dimensions must be 1 at least")
        with self._lock:
            known = self._catalog["collections"].get(name)
            if known is None:
                state = {
                    "mode": mode.value, "dimensions": dimensions, "metric": self.options.metric.value, "next_id": 1, "snapshot": None, "log": [], "indexes": [],
                    "metadata": T.StructType([]).jsonValue(), "folder": uuid.uuid4().hex,
                }
                self._write_catalog({**self._catalog, "collections": {**self._catalog["collections"], name: state}})
            elif known["mode"] != mode.value or known["dimensions"] != dimensions:
                raise CollectionError(name, f"it is there with mode {known['mode']} and {known['dimensions']} dimensions")
            return Collection(self, name)

    def get_or_create(self, name: str, dimensions: int) -> Collection:
        if dimensions > self.options.max_dimensions:
            raise ValueError(f"dimensions must be {self.options.max_dimensions} at most")
        return self._create(name, Mode.VECTOR, dimensions)

    def get_or_create_scalar(self, name: str) -> Collection:
        return self._create(name, Mode.SCALAR_ONLY, 1)

    def get(self, name: str) -> Collection | None:
        return Collection(self, name) if self.exists(name) else None

    def exists(self, name: str) -> bool:
        return name in self._catalog["collections"]

    def names(self) -> list[str]:
        return list(self._catalog["collections"])

    def delete(self, name: str) -> bool:
        """Whether there was such a collection. A new one of that name starts with id 1."""
        with self._lock:
            if not self.exists(name):
                return False
            folder = self._catalog["collections"][name]["folder"]
            self._write_catalog({"collections": {k: v for k, v in self._catalog["collections"].items() if k != name}, "retired": self._retired([folder])})
            self._expire()
            return True

    # --- durability

    def checkpoint(self) -> None:
        """Write collections anew as snapshots, without their deleted records, where that is worth it (see above); delete what has been retired long enough."""
        with self._lock:
            for name, state in list(self._catalog["collections"].items()):
                if not state["log"]:
                    continue
                held = state.get("rows", 0) if state["snapshot"] else 0
                added, gone = (sum(x.get("rows", 0) for x in state["log"] if x["op"] == op) for op in ("insert", "delete"))
                if not state["snapshot"] or 2 * added >= held or gone > self.options.compaction * (held + added):
                    self._rewrite(name, state, held + added - gone)
                elif len(state["log"]) > LOGGED:
                    self._fold(name, state)
            self._expire()

    def _rewrite(self, name: str, state: dict, rows: int) -> None:
        df = Collection(self, name).df()
        fields = {f["name"] for f in state["metadata"]["fields"]}
        order = next((x["fields"] for x in state["indexes"] if x["fields"][0] in fields), None)
        if order is not None:
            keys = [*[F.col(f"metadata.`{f}`") for f in order if f in fields], F.col("id")]
            df = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
        old = [x["path"] for x in state["log"]] + ([state["snapshot"]] if state["snapshot"] else [])
        self._commit(name, old, snapshot=self._written(name, df), log=[], rows=rows)

    def _fold(self, name: str, state: dict) -> None:
        """All changes of a log as one insertion and one deletion, under the number of the last one."""
        collection = Collection(self, name)
        paths = {op: [x["path"] for x in state["log"] if x["op"] == op] for op in ("insert", "delete")}
        gone = self.spark.read.schema("id long").parquet(*map(self._at, paths["delete"])) if paths["delete"] else None
        log, last = [], state["log"][-1]["seq"]
        if paths["insert"]:
            stored = T.StructType([f for f in row_schema(collection.mode, collection.metadata_schema).fields if f.name != "metadata" or len(f.dataType.fields)])
            rows = self.spark.read.schema(stored).parquet(*map(self._at, paths["insert"]))
            log.append({**self._logged(name, "insert", rows if gone is None else records.deleted(rows, gone), sum(x.get("rows", 0) for x in state["log"] if x["op"] == "insert")), "seq": last})
        if gone is not None:
            log.append({**self._logged(name, "delete", gone.distinct(), sum(x.get("rows", 0) for x in state["log"] if x["op"] == "delete")), "seq": last})
        self._commit(name, paths["insert"] + paths["delete"], log=log)

    def refresh(self) -> None:
        """See what other writers have committed."""
        with self._lock:
            self._load()

    def close(self) -> None:
        """A last checkpoint; closing again does nothing."""
        with self._lock:
            if self._closed:
                return
            self._stop.set()
            self.checkpoint()
            self._closed = True

    def __enter__(self) -> Database:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()
