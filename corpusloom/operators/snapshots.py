"""A transactional table in Parquet files: numbered snapshots, one atomic step a commit.

Rows are dealt into a fixed number of buckets by a hash of their key (a document's
id), so a document lies in one bucket and a snapshot is a short list: per bucket
the folder that holds its files, at most ``buckets`` entries at any size of the
table. A commit writes the buckets it changes into a new folder and then creates
the next numbered snapshot by renaming a complete file to a name that must not
exist yet: whoever comes second fails, reads what the first has done, and works its
change off again on top of it. Until the rename nothing that readers see has
changed, so a failing batch, or a driver that dies, leaves the last snapshot as it
was; files that no snapshot names are swept by ``expire``. Old snapshots stay
readable until then.

A change is an upsert by document (new rows take the place of all the document's
rows, which removes stale ones), a prune to a manifest of documents, or both at
once. Rows with a null key are refused. An empty table is a snapshot without
buckets; a change that touches nothing makes no snapshot.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from corpusloom.shared import require

_BUCKET = "__bucket"


class ConflictError(RuntimeError):
    """Other writers kept coming first."""


@dataclass(frozen=True)
class Snapshot:
    """A version of the table: its schema (JSON), its properties, and per bucket the folder of its files."""

    version: int
    buckets: int
    schema: str | None = None
    properties: dict = field(default_factory=dict)
    folders: dict[str, str] = field(default_factory=dict)


class Files:
    """The few calls on the table's file system, whichever Spark reads it by."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm, self._conf, self._gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway
        self._path = lambda p: self._jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(root).getFileSystem(self._conf)
        self._context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.makeQualified(self._path(root)).toUri(), self._conf)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return [s.getPath().getName() for s in self._fs.listStatus(path)] if self._fs.exists(path) else []

    def read(self, path: str) -> str:
        stream = self._fs.open(self._path(path))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, path: str, text: str) -> bool:
        """Writes a file aside and renames it; False if the name is taken."""
        aside = f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self._fs.create(self._path(aside), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        kinds = self._gateway.new_array(getattr(self._jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            self._context.rename(self._fs.makeQualified(self._path(aside)), self._fs.makeQualified(self._path(path)), kinds)
        except Py4JJavaError as e:
            self._fs.delete(self._path(aside), False)
            if "FileAlreadyExists" in e.java_exception.getClass().getName():
                return False
            raise
        return True

    def delete(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def age(self, path: str) -> float:
        """Seconds since the last change."""
        return self._jvm.System.currentTimeMillis() / 1000 - self._fs.getFileStatus(self._path(path)).getModificationTime() / 1000


class SnapshotTable:
    """See above. ``path`` is a folder that the driver and all executors share; ``buckets`` counts when the table is created."""

    def __init__(self, spark: SparkSession, path: str, key: str = "document_id", buckets: int = 64, attempts: int = 10):
        if buckets < 1:
            raise ValueError("a table needs a bucket")
        self.spark, self.path, self.key, self._buckets, self._attempts = spark, path.rstrip("/"), key, buckets, attempts
        self._files = Files(spark, self.path)

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._files.names(f"{self.path}/log") if n.endswith(".json") and n[:-5].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot | None:
        """A version, or the latest; None if there is none yet."""
        known = self.versions()
        if version is None and not known:
            return None
        if version is not None and version not in known:
            raise ValueError(f"there is no snapshot {version}")
        return Snapshot(**json.loads(self._files.read(self._log(known[-1] if version is None else version))))

    def _log(self, version: int) -> str:
        return f"{self.path}/log/{version:020d}.json"

    def _commit(self, new: Snapshot) -> bool:
        return self._files.create(self._log(new.version), json.dumps(asdict(new), sort_keys=True))

    def create(self, properties: dict | None = None) -> Snapshot:
        """The first snapshot, empty; the latest one if there is one."""
        if (now := self.snapshot()) is not None:
            return now
        self._commit(Snapshot(0, self._buckets, properties=properties or {}))
        return self.snapshot()

    def set_property(self, name: str, value: str, expected: str | None) -> bool:
        """Compare and set, in a snapshot of its own; False if the property wasn't ``expected``."""
        for _ in range(self._attempts):
            now = self.create()
            if now.properties.get(name) != expected:
                return False
            if self._commit(replace(now, version=now.version + 1, properties={**now.properties, name: value})):
                return True
        raise ConflictError(name)

    def has_data(self) -> bool:
        """Whether files lie there, named by a snapshot or not."""
        return bool(self._files.names(f"{self.path}/data"))

    def missing(self, now: Snapshot) -> list[str]:
        """The buckets of a snapshot whose folders are gone."""
        there: dict[str, set[str]] = {}
        for folder in {f.rpartition("/")[0] for f in now.folders.values()}:
            there[folder] = set(self._files.names(f"{self.path}/{folder}"))
        return [b for b, f in now.folders.items() if f.rpartition("/")[2] not in there[f.rpartition("/")[0]]]

    def rows(self, version: int | None = None) -> DataFrame | None:
        """The rows of a snapshot; None before the first rows were written."""
        now = self.snapshot(version)
        if now is None or now.schema is None:
            return None
        return self._read(now, now.folders)

    def _read(self, now: Snapshot, buckets) -> DataFrame:
        schema = StructType.fromJson(json.loads(now.schema))
        paths = [f"{self.path}/{now.folders[b]}" for b in buckets if b in now.folders]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _dealt(self, rows: DataFrame, now: Snapshot) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(self.key), F.lit(now.buckets)).cast("int"))

    def _touched(self, keys: DataFrame, now: Snapshot) -> set[str]:
        """The buckets of some keys: at most as many as the table has."""
        return {str(r[0]) for r in self._dealt(keys.select(self.key), now).select(_BUCKET).distinct().collect()}

    def change(self, new: DataFrame | None = None, manifest: DataFrame | None = None) -> Snapshot:
        """One commit: ``new`` takes the place of all rows of its documents, and documents that aren't in ``manifest`` go.

        ``new`` is read for its documents and once more for its rows, again if another writer came first; give it a
        stored table. An empty manifest is refused.
        """
        if manifest is not None and manifest.isEmpty():
            raise ValueError("an empty manifest would clear the table")
        if new is not None:
            new = require(new, F.col(self.key).isNotNull(), F.lit(f"{self.key} is null"))
        for _ in range(self._attempts):
            now = self.create()
            made = self._next(now, new, manifest)
            if made is None:
                return now
            if self._commit(made):
                return made
        raise ConflictError(f"{self._attempts} attempts")

    def _next(self, now: Snapshot, new: DataFrame | None, manifest: DataFrame | None) -> Snapshot | None:
        """The snapshot after ``now``, its files written; None if nothing changes."""
        schema = now.schema
        if new is not None:
            schema = schema or json.dumps(json.loads(new.schema.json()), sort_keys=True)
            wanted = StructType.fromJson(json.loads(schema))
            if {f.name: f.dataType.simpleString() for f in wanted} != {f.name: f.dataType.simpleString() for f in new.schema}:  # files hold nulls anywhere
                raise ValueError("the rows' columns are not the table's")
            new = new.select(*wanted.fieldNames())
        touched = self._touched(new, now) if new is not None else set()
        if manifest is not None and now.schema is not None:
            touched |= self._touched(self._read(now, now.folders).join(manifest.select(self.key), self.key, "left_anti"), now)
        if not touched or schema is None:
            return None
        rows = self._read(now, touched) if now.schema is not None else None
        if new is not None:
            rows = new if rows is None else rows.join(new.select(self.key).distinct(), self.key, "left_anti").unionByName(new)
        if manifest is not None:
            rows = rows.join(manifest.select(self.key), self.key, "left_semi")
        folder = f"data/{uuid.uuid4().hex}"
        names = StructType.fromJson(json.loads(schema)).fieldNames()
        # buckets become whole files of a moderate size, large ones several
        self._dealt(rows.select(*names), now).hint("rebalance", _BUCKET).write.partitionBy(_BUCKET).parquet(f"{self.path}/{folder}")
        written = {n.partition("=")[2] for n in self._files.names(f"{self.path}/{folder}") if n.startswith(f"{_BUCKET}=")}
        kept = {b: f for b, f in now.folders.items() if b not in touched}
        return Snapshot(now.version + 1, now.buckets, schema, now.properties, kept | {b: f"{folder}/{_BUCKET}={b}" for b in written})

    def expire(self, keep: int = 1, older: float = 86_400.0) -> int:
        """Drops all but the ``keep`` latest snapshots and the folders that none of those names, if they are ``older`` seconds at least, since a writer may still be at work on younger ones; returns how many folders went."""
        if keep < 1:
            raise ValueError("the latest snapshot stays")
        known = self.versions()
        for v in known[:-keep]:
            self._files.delete(self._log(v))
        used = {f.split("/")[1] for v in known[-keep:] for f in self.snapshot(v).folders.values()}
        gone = [n for n in self._files.names(f"{self.path}/data") if n not in used and self._files.age(f"{self.path}/data/{n}") >= older]
        for n in gone:
            self._files.delete(f"{self.path}/data/{n}")
        return len(gone)
