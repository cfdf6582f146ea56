"""Tables on shared storage: versions, appends, snapshots.

Files are never changed.  A publish writes the rows that are new (or the whole of
a table whose rows changed) to folders that no other attempt uses, and then one small
manifest file that lists the folders each table consists of.  The manifest gets its
name by a rename that fails where the name is taken: of two writers of a version one
wins, and a write that fails half-way leaves nothing that a later one could meet.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field
from urllib.parse import quote

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from factfade.model import Memory, Write
from factfade.schemas import MEMORY_TABLES, TABLES
from factfade.session import configure

#: Folders of one table above which a stream compacts it.
MOST_FOLDERS = 32


class StoreError(RuntimeError):
    pass


@dataclass(frozen=True)
class Manifest:
    """A version: the folders of each table, and the last number of each stream."""

    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def holds(self, batch: str) -> bool:
        name, number = _numbered(batch)
        return number <= self.batches.get(name, -1)


def _numbered(batch: str) -> tuple[str, int]:
    """``stream#7`` as (stream, 7): of a stream the last number is enough; else (name, 0)."""
    name, _, number = batch.rpartition("#")
    return (name, int(number)) if name and number.isdigit() else (batch, 0)


def _base(root: str, scope: str) -> str:
    return f"{root.rstrip('/')}/scope={quote(scope, safe='')}"


class _Files:
    """Small files of one folder, through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark._jvm, folder
        self.conf = spark._jsc.hadoopConfiguration()
        self.path = self.jvm.org.apache.hadoop.fs.Path
        self.system = self.path(folder).getFileSystem(self.conf)

    def names(self) -> list[str]:
        if not self.system.exists(self.path(self.folder)):
            return []
        return [f.getPath().getName() for f in self.system.listStatus(self.path(self.folder))]

    def read(self, name: str) -> str:
        stream = self.system.open(self.path(self.folder, name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file under a name that nobody has; False if somebody has it."""
        draft = self.path(self.folder, f".draft-{uuid.uuid4().hex}")
        stream = self.system.create(draft, False)
        stream.write(bytearray(text.encode()))
        stream.close()
        fs = self.jvm.org.apache.hadoop.fs
        context = fs.FileContext.getFileContext(self.system.getUri(), self.conf)
        options = self.jvm.java.lang.reflect.Array.newInstance(
            fs.Options.Rename.NONE.getClass(), 1
        )
        options[0] = fs.Options.Rename.NONE
        try:
            context.rename(draft, self.path(self.folder, name), options)
        except Py4JJavaError as error:
            self.system.delete(draft, False)
            if "FileAlreadyExists" in str(error.java_exception):
                return False
            raise
        return True


def _manifests(spark: SparkSession, root: str, scope: str) -> _Files:
    return _Files(spark, f"{_base(root, scope)}/_manifest")


def read_manifest(spark: SparkSession, root: str, scope: str) -> Manifest:
    """The newest version, read from its own file only; version 0 if there is none."""
    configure(spark)
    files = _manifests(spark, root, scope)
    versions = [int(n[2:-5]) for n in files.names() if n.startswith("v=") and n.endswith(".json")]
    if not versions:
        return Manifest()
    found = json.loads(files.read(f"v={max(versions)}.json"))
    return Manifest(max(versions), found["tables"], found["batches"])


def load_memory(spark: SparkSession, root: str, scope: str = "global") -> Memory:
    """The newest state of one scope.  A missing scope is an error."""
    manifest = read_manifest(spark, root, scope)
    if manifest.version == 0:
        raise StoreError(f"no store for scope {scope!r} under {root}")
    return Memory(**{
        table: _read(spark, root, scope, manifest, table) for table in MEMORY_TABLES
    })


def _read(spark: SparkSession, root: str, scope: str, manifest: Manifest, table: str) -> DataFrame:
    paths = [f"{_base(root, scope)}/{path}" for path in manifest.tables.get(table, [])]
    if not paths:
        return spark.createDataFrame([], TABLES[table])
    return spark.read.schema(TABLES[table]).parquet(*paths)


def _shaped(df: DataFrame, table: str) -> DataFrame:
    return df.to(df.sparkSession.createDataFrame([], TABLES[table]).schema)


def _clustered(df: DataFrame, table: str) -> DataFrame:
    """Whole observation tables are laid out by entity, so that file statistics prune reads.

    Ranges are cut on (entity, id): a hot entity is spread over many files.
    """
    if table != "observations":
        return df
    return df.repartitionByRange("entity_id", "id").sortWithinPartitions("entity_id", "id")


def publish(
    spark: SparkSession, root: str, scope: str, change: Memory | Write,
    expected: int | None = None, batch: str | None = None,
) -> int:
    """Write a change and make it visible; returns the new version.

    ``expected`` is the version the change was computed from: if another write
    came in between, nothing becomes visible.  A ``batch`` already published
    changes nothing and returns the present version.
    """
    manifest = read_manifest(spark, root, scope)
    version = manifest.version
    if batch is not None and manifest.holds(batch):
        return version
    if expected is not None and expected != version:
        raise StoreError(f"scope {scope!r} is at version {version}, the change is for {expected}")
    if isinstance(change, Memory):
        whole = {t: getattr(change, t) for t in MEMORY_TABLES if getattr(change, t) is not None}
        added: dict[str, DataFrame] = {}
    else:
        whole, added = change.rewritten, change.appended
    tables = {t: list(paths) for t, paths in manifest.tables.items() if t not in whole}
    for table, df in [*whole.items(), *added.items()]:
        path = f"{table}/{uuid.uuid4().hex}"
        shaped = _shaped(df, table)
        (_clustered(shaped, table) if table in whole else shaped).write.parquet(
            f"{_base(root, scope)}/{path}"
        )
        tables.setdefault(table, []).append(path)
    batches = dict(manifest.batches)
    if batch is not None:
        name, number = _numbered(batch)
        batches[name] = number
    return _commit(spark, root, scope, Manifest(version + 1, tables, batches))


def _commit(spark: SparkSession, root: str, scope: str, manifest: Manifest) -> int:
    text = json.dumps({"tables": manifest.tables, "batches": manifest.batches})
    if not _manifests(spark, root, scope).create(f"v={manifest.version}.json", text):
        raise StoreError(f"another write made version {manifest.version} of scope {scope!r}")
    return manifest.version


def compact(spark: SparkSession, root: str, scope: str = "global", most: int = MOST_FOLDERS) -> int:
    """Write tables of more than ``most`` folders anew as one; returns the version."""
    manifest = read_manifest(spark, root, scope)
    tables = dict(manifest.tables)
    for table, paths in manifest.tables.items():
        if len(paths) > most:
            path = f"{table}/{uuid.uuid4().hex}"
            rows = _read(spark, root, scope, manifest, table)
            _clustered(rows, table).write.parquet(f"{_base(root, scope)}/{path}")
            tables[table] = [path]
    if tables == manifest.tables:
        return manifest.version
    return _commit(spark, root, scope, Manifest(manifest.version + 1, tables, manifest.batches))


def snapshot_export(mem: Memory, dest: str, as_of, source: str | None = None) -> DataFrame:
    """Full copy of one scope under ``dest``; an earlier copy stays valid until it is done.

    Returns the manifest (table, path, rows), which is also written last: a copy
    without it is incomplete.  Usage logs and other scopes are not part of it.
    """
    if source is not None and source.rstrip("/") == dest.rstrip("/"):
        raise StoreError("the copy must not go into the store it is taken from")
    spark = mem.entities.sparkSession
    # A folder of its own, so that an export can be repeated after a failure.
    stamp = f"{str(as_of).replace(' ', 'T').replace(':', '')}-{uuid.uuid4().hex[:8]}"
    rows = []
    for table in MEMORY_TABLES:
        df = getattr(mem, table)
        if df is None:
            continue
        path = f"{dest.rstrip('/')}/snap={stamp}/{table}"
        _clustered(_shaped(df, table), table).write.parquet(path)
        count = spark.read.schema(TABLES[table]).parquet(path).count()
        rows.append((table, path, count))
    manifest = spark.createDataFrame(rows, "table string, path string, rows long")
    manifest.coalesce(1).write.json(f"{dest.rstrip('/')}/snap={stamp}/_manifest")
    return manifest
