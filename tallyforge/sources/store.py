"""An object store under a path that executors can write: put with a checksum, get, exists, delete, ordered listing.

Objects are files by key under a root. They are read and written in tasks,
through whatever file system pyarrow has for the root's scheme. A put goes to
a file of its own and is moved over its key when it is whole, so a task that
is tried again leaves the same object; a write's mark is made when all are.
"""

from __future__ import annotations

import hashlib
import posixpath
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "key string, size long, content binary"
#: Folder of marks and of objects under way; no key lies in it.
HIDDEN = "_store"
#: Objects that lie beside folders on the way are read so many in a partition.
NAMED = 4096
#: Bytes of content that are handed on at once.
PART_BYTES = 4 << 20


class NotFound(KeyError):
    pass


class ChecksumMismatch(ValueError):
    pass


class Files:
    """A root's file system, opened in the task that uses it."""

    def __init__(self, root: str):
        uri = root if "://" in root or root.startswith("file:") else f"file://{root}"
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = f"file://{uri[5:]}"
        self.system, base = pafs.FileSystem.from_uri(uri)
        self.base, self.made = base.rstrip("/"), set()

    def place(self, key: str) -> str:
        parts = key.split("/")
        if not key or key.startswith("/") or "\\" in key or any(p in ("", ".", "..") for p in parts) or parts[0] == HIDDEN:
            raise ValueError(f"no key of an object: {key!r}")
        return f"{self.base}/{key}"

    def put(self, key: str, content: bytes, expected: str | None = None) -> str:
        """Store content under key and return its sha256; another one than expected is refused."""
        found = hashlib.sha256(content).hexdigest()
        if expected and expected != found:
            raise ChecksumMismatch(f"{key}: {found} instead of {expected}")
        place, own = self.place(key), f"{self.base}/{HIDDEN}/{uuid.uuid4().hex}"
        for folder in {f"{self.base}/{HIDDEN}", posixpath.dirname(place)} - self.made:
            self.system.create_dir(folder, recursive=True)
            self.made.add(folder)
        with self.system.open_output_stream(own) as out:
            out.write(content)
        self.system.move(own, place)
        return found

    def exists(self, key: str) -> bool:
        return self.system.get_file_info(self.place(key)).type == pafs.FileType.File

    def get(self, key: str) -> bytes:
        if not self.exists(key):
            raise NotFound(key)
        with self.system.open_input_stream(self.place(key)) as data:
            return data.read()

    def delete(self, key: str) -> None:
        """An object that isn't there is no error."""
        if self.exists(key):
            self.system.delete_file(self.place(key))

    def inside(self, folder: str) -> list[pafs.FileInfo]:
        """Files and folders directly inside, by name; nothing where there is no such folder."""
        found = self.system.get_file_info(pafs.FileSelector(f"{self.base}/{folder}".rstrip("/"), allow_not_found=True))
        return sorted((f for f in found if folder or f.base_name != HIDDEN), key=lambda f: f.base_name)

    def walk(self, folder: str) -> Iterator[tuple[str, int]]:
        """(key, size) of all objects below a folder, in the order of their keys."""
        found = [(f.path[len(self.base) + 1 :] + ("/" if f.type == pafs.FileType.Directory else ""), f) for f in self.inside(folder)]
        for name, f in sorted(found, key=lambda x: x[0]):
            if name.endswith("/"):
                yield from self.walk(name[:-1])
            else:
                yield name, f.size


def _parts(rows: Iterator[tuple]) -> Iterator[list[tuple]]:
    """Rows in lists of about PART_BYTES of content, which is their last value, and NAMED rows at most."""
    own, size = [], 0
    for row in rows:
        own.append(row)
        size += len(row[-1]) if isinstance(row[-1], bytes) else 0
        if size >= PART_BYTES or len(own) == NAMED:
            yield own
            own, size = [], 0
    if own:
        yield own


class _Part(InputPartition):
    """All objects below a folder, or some named ones with their sizes."""

    def __init__(self, folder: str | None = None, named: list[tuple[str, int]] = ()):
        self.folder, self.named = folder, list(named)


class _Reader(DataSourceReader):
    """A partition for each folder on the way to the prefix's names; folders are split while they are few and hold folders."""

    def __init__(self, options: dict):
        self.root, self.prefix = options["path"], options.get("prefix", "")
        self.content, self.width = options.get("content", "true") == "true", int(options.get("width", "64"))

    def partitions(self) -> list[InputPartition]:
        files = Files(self.root)
        is_folder = lambda f: f.type == pafs.FileType.Directory
        # a folder's objects come behind its name and a slash
        named = lambda found: sorted((f.path[len(files.base) + 1 :] + "/" * is_folder(f), f) for f in found)
        folder, _, start = self.prefix.rpartition("/")
        inside = named(f for f in files.inside(folder) if f.base_name.startswith(start))
        while len(inside) < self.width:
            folders = [name[:-1] for name, f in inside if is_folder(f)]
            # a folder of objects alone is left to one task, which lists it; the first folder tells for its level
            if not folders or not any(map(is_folder, files.inside(folders[0]))):
                break
            inside = [x for name, f in inside for x in (named(files.inside(name[:-1])) if is_folder(f) else [(name, f)])]
        parts, own = [], []
        for name, f in inside:
            if own and (is_folder(f) or len(own) == NAMED):
                parts.append(_Part(named=own))
                own = []
            if is_folder(f):
                parts.append(_Part(name[:-1]))
            else:
                own.append((name, f.size))
        return parts + ([_Part(named=own)] if own or not parts else [])

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        files = Files(self.root)
        found = files.walk(part.folder) if part.folder is not None else part.named
        rows = ((key, size, files.get(key) if self.content else None) for key, size in found)
        kind = pa.schema([("key", pa.string()), ("size", pa.int64()), ("content", pa.binary())])
        for own in _parts(rows):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*own), kind)], schema=kind)
            del own
            pa.default_memory_pool().release_unused()


class _Wrote(WriterCommitMessage):
    def __init__(self, objects: int):
        self.objects = objects


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, names: list[str]):
        self.root, self.names = options["path"], names

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, n = Files(self.root), 0
        for batch in batches:
            names = batch.schema.names
            columns = [batch.column(names.index(c)) if c in names else pa.nulls(batch.num_rows) for c in ("key", "content", "expected")]
            # one object's bytes are in Python at a time
            for key, content, expected in zip(*columns):
                files.put(key.as_py(), content.as_py(), expected.as_py())
            n += batch.num_rows
        return _Wrote(n)

    def commit(self, messages: list) -> None:
        files = Files(self.root)
        files.system.create_dir(f"{files.base}/{HIDDEN}/done", recursive=True)
        with files.system.open_output_stream(f"{files.base}/{HIDDEN}/done/{uuid.uuid4().hex}") as out:
            out.write(str(sum(m.objects for m in messages if m is not None)).encode())

    def abort(self, messages: list) -> None:
        """Objects that are whole stay, by keys of their own; without a mark the write isn't done."""


class ObjectStore(DataSource):
    """spark.read.format("objects") lists or reads, spark.write.format("objects") puts (key, content[, expected])."""

    @classmethod
    def name(cls) -> str:
        return "objects"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options, schema.fieldNames())


def put(objects: DataFrame, root: str) -> None:
    """Store (key, content[, expected]); a checksum other than expected ends the write without its mark."""
    spark = objects.sparkSession
    spark.dataSource.register(ObjectStore)
    names = ["key", "content", *(["expected"] if "expected" in objects.columns else [])]
    objects.select(*names).write.format("objects").mode("append").save(root)


def writes_done(root: str) -> int:
    """How many writes to the store have come to their end."""
    files = Files(root)
    return len(files.inside(f"{HIDDEN}/done"))


def listing(spark: SparkSession, root: str, prefix: str = "", content: bool = False) -> DataFrame:
    """(key, size, content) of the objects whose key starts with prefix; each partition is in order, as are the partitions."""
    spark.dataSource.register(ObjectStore)
    rows = spark.read.format("objects").option("prefix", prefix).option("content", str(content).lower()).load(root)
    return rows.where(F.col("key").startswith(prefix))


def _each(keys: DataFrame, root: str, schema: str, work: Callable[[Files, str], object]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = Files(root)
        for batch in batches:
            for own in _parts((k, work(files, k)) for k in batch.column(0).to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*own), kinds)], names)
                del own
                pa.default_memory_pool().release_unused()

    names, kinds = ["key", schema.split(", ")[1].split()[0]], [pa.string(), pa.binary() if "binary" in schema else pa.bool_()]
    return keys.select("key").mapInArrow(run, schema)


def get(keys: DataFrame, root: str) -> DataFrame:
    """(key, content); a key without an object is an error."""
    return _each(keys, root, "key string, content binary", Files.get)


def exists(keys: DataFrame, root: str) -> DataFrame:
    """(key, found)."""
    return _each(keys, root, "key string, found boolean", Files.exists)


def delete(keys: DataFrame, root: str) -> None:
    """Delete objects; those that aren't there are passed over."""

    def gone(files: Files, key: str) -> bool:
        files.delete(key)
        return True

    _each(keys.distinct(), root, "key string, gone boolean", gone).write.format("noop").mode("overwrite").save()
