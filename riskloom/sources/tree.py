"""Reading and writing source trees on any file system.

Trees are listed with hidden names included; Spark's own file formats skip names that start with ``_`` or ``.``, which
are the very names the dead-file rules look for.  Listing and reading are two steps: filters run on the listing, and
only surviving paths are read, spread over the cluster by bytes rather than by folder.

A listing grows as a frontier of folders: each round deals the folders not yet opened over tasks, and a task opens
some of them and passes on what it did not get to.  The driver sees no names.
"""

from __future__ import annotations

import base64
import hashlib
import os
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from riskloom.functions.paths import relative_path
from riskloom.model import VENDOR_DIRS, Profile
from riskloom.operators.scan import custom_files
from riskloom.session import materialize, run_dir

LISTING_DDL = "path string, length bigint"
CONTENT_DDL = "path string, content binary"
DIGEST_DDL = "path string, digest string"
FRONTIER_DDL = "path string, length bigint, kind string"
BYTES_PER_TASK = 64 << 20
BATCH_BYTES = 8 << 20
BATCH_ROWS = 10_000
CHUNK_BYTES = 1 << 20
#: Folders that one task opens in the first round, and at most in later ones; each round opens four times as many.
FIRST_FOLDERS = 16
MOST_FOLDERS = 4096

Opener = Callable[[str], tuple[fs.FileSystem, str]]
_OPENERS: dict[str, Opener] = {}


def register_file_system(scheme: str, opener: Opener) -> None:
    """Let roots like ``scheme://...`` be opened by ``opener(uri) -> (file system, path)``, in tasks too."""
    _OPENERS[scheme] = opener


@dataclass(frozen=True)
class Place:
    """Where a tree lies; tasks open the file system themselves."""

    uri: str
    opener: Opener | None = None

    @staticmethod
    def of(root: str) -> Place:
        if root.startswith("file:") and not root.startswith("file://"):
            root = "file:///" + root[len("file:") :].lstrip("/")
        scheme, _, rest = root.partition("://")
        if not rest:
            return Place(os.path.abspath(root))
        return Place(root.rstrip("/"), _OPENERS.get(scheme))

    def open(self) -> tuple[fs.FileSystem, str]:
        if self.opener is not None:
            files, base = self.opener(self.uri)
        elif "://" in self.uri:
            files, base = fs.FileSystem.from_uri(self.uri)
        else:
            files, base = fs.LocalFileSystem(), self.uri
        return files, base.rstrip("/") if base.strip("/") else base

    def pack(self) -> str:
        """The place as an option of a data source."""
        return base64.b64encode(cloudpickle.dumps(self)).decode()

    @staticmethod
    def unpack(text: str) -> Place:
        return cloudpickle.loads(base64.b64decode(text))

    def check(self) -> None:
        files, base = self.open()
        if files.get_file_info(base).type != fs.FileType.Directory:
            raise FileNotFoundError(f"not a directory: {self.uri}")


def _join(base: str, path: str) -> str:
    if not path:
        return base
    return path if not base else f"{base}{path}" if base.endswith("/") else f"{base}/{path}"


def _is_link(files: fs.FileSystem, path: str) -> bool:
    """A symbolic link on a local file system; links to folders are not followed."""
    while isinstance(files, fs.SubTreeFileSystem):
        files, path = files.base_fs, _join(files.base_path, path)
    return isinstance(files, fs.LocalFileSystem) and os.path.islink(path)


def entries(files: fs.FileSystem, base: str, folder: str, excluded: frozenset[str] = frozenset()):
    """``(name below the root, info)`` of a folder's entries in order of names; excluded folders and links to folders are left out."""
    for info in sorted(files.get_file_info(fs.FileSelector(_join(base, folder))), key=lambda i: i.base_name):
        path = f"{folder}/{info.base_name}" if folder else info.base_name
        if info.type == fs.FileType.Directory and (path in excluded or _is_link(files, info.path)):
            continue
        yield path, info


def _batch(**columns: list) -> pa.RecordBatch:
    kinds = {"length": pa.int64(), "content": pa.binary()}
    return pa.RecordBatch.from_arrays(
        [pa.array(values, kinds.get(name, pa.string())) for name, values in columns.items()], names=list(columns)
    )


def walk_tree(spark: SparkSession, root: str, excluded: tuple[str, ...] = (), units: int | None = None) -> DataFrame:
    """``(path, length, kind)``: every ``file`` below ``root``, and each folder that was ``unreadable``.

    At most ``units`` tasks work on a round.  A task opens all folders dealt to it and what it finds below them, up to
    a number that grows from round to round; the rest is the next round's frontier.  Rounds grow with the logarithm of
    the tree's size and with its depth only where few folders lie side by side.
    """
    place = Place.of(root)
    place.check()
    units = units or 4 * spark.sparkContext.defaultParallelism
    skip = frozenset(excluded)
    folder = run_dir(spark, "listing")

    def walking(most: int):
        def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            files, base = place.open()
            pending = deque(path for batch in batches for path in batch.column("path").to_pylist())
            must, opened = len(pending), 0
            rows: list[tuple[str, int | None, str]] = []
            while pending and (opened < must or opened < most):
                at = pending.popleft()
                opened += 1
                try:
                    for path, info in entries(files, base, at, skip):
                        if info.type == fs.FileType.Directory:
                            pending.append(path)
                        elif info.type == fs.FileType.File:
                            rows.append((path, info.size, "file"))
                except OSError:
                    rows.append((at, None, "unreadable"))
                if len(rows) >= BATCH_ROWS:
                    yield _rows(rows)
                    rows = []
            rows += [(path, None, "open") for path in pending]
            if rows:
                yield _rows(rows)

        return walk

    frontier = spark.createDataFrame([("",)], "path string")
    most, turn = FIRST_FOLDERS, 0
    while True:
        part = f"{folder}/round={turn}"
        dealt = frontier.coalesce(1) if turn == 0 else frontier.repartition(units, "path")
        dealt.mapInArrow(walking(most), FRONTIER_DDL).write.parquet(part)
        frontier = spark.read.schema(FRONTIER_DDL).parquet(part).filter("kind = 'open'").select("path")
        if frontier.isEmpty():
            break
        most, turn = min(4 * most, MOST_FOLDERS), turn + 1
    return spark.read.schema(FRONTIER_DDL).parquet(folder).filter("kind <> 'open'").select("path", "length", "kind")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    path, length, kind = zip(*rows, strict=True)
    return _batch(path=list(path), length=list(length), kind=list(kind))


class TreePartition(InputPartition):
    """Folders to list, with or without what lies below them."""

    def __init__(self, folders: list[str], recursive: bool):
        super().__init__(folders)
        self.folders = folders
        self.recursive = recursive


def split_tree(place: Place, units: int, excluded: frozenset[str]) -> list[TreePartition]:
    """At most ``units`` parts of a tree: folders of the top levels are opened here until there are enough.

    Only names of folders are kept; a part with many folders side by side gets several of them.
    """
    files, base = place.open()
    opened: list[str] = []
    level = [""]
    while level and len(level) < units // 2 and len(opened) < units:
        below = []
        for folder in level:
            opened.append(folder)
            try:
                below += [p for p, i in entries(files, base, folder, excluded) if i.type == fs.FileType.Directory]
            except OSError:
                continue
        level = below
    parts = []
    for folders, recursive in ((opened, False), (level, True)):
        size = max(1, -(-len(folders) // max(1, units // 2)))
        parts += [TreePartition(folders[k : k + size], recursive) for k in range(0, len(folders), size)]
    return parts


def files_of(place: Place, partition: TreePartition, excluded: frozenset[str] = frozenset()):
    """``(file system, name below the root, info)`` of a part's files; an unreadable folder counts as empty."""
    files, base = place.open()
    pending = deque(partition.folders)
    while pending:
        try:
            for path, info in entries(files, base, pending.popleft(), excluded):
                if info.type == fs.FileType.Directory:
                    if partition.recursive:
                        pending.append(path)
                elif info.type == fs.FileType.File:
                    yield files, path, info
        except OSError:
            continue


def place_of(options: dict[str, str]) -> Place:
    return Place.unpack(options["place"]) if "place" in options else Place.of(options["path"])


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.place = place_of(options)
        self.excluded = frozenset(d for d in options.get("excludedirs", "").split(",") if d)
        self.units = int(options.get("units", "256"))

    def partitions(self) -> list[TreePartition]:
        self.place.check()
        return split_tree(self.place, self.units, self.excluded)

    def read(self, partition: TreePartition) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        sizes: list[int] = []
        for _, path, info in files_of(self.place, partition, self.excluded):
            paths.append(path)
            sizes.append(info.size)
            if len(paths) >= BATCH_ROWS:
                yield _batch(path=paths, length=sizes)
                paths, sizes = [], []
        if paths:
            yield _batch(path=paths, length=sizes)


class SourceTree(DataSource):
    """``spark.read.format("srctree").load(root)``: a listing as a lazy table; options ``excludeDirs`` and ``units``."""

    @classmethod
    def name(cls) -> str:
        return "srctree"

    def schema(self) -> str:
        return LISTING_DDL

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def list_tree(
    spark: SparkSession, root: str, prune_vendor: bool = False, units: int | None = None
) -> DataFrame:
    """``(path, length)`` of every file below ``root``; nothing is opened.

    Pruning leaves vendor folders unlisted; without them, vendor files cannot be counted and includes cannot resolve
    into them.  ``units`` is the number of tasks, by default four per core.
    """
    found = walk_tree(spark, root, VENDOR_DIRS if prune_vendor else (), units)
    return found.filter("kind = 'file'").select("path", "length")


def _spread(listing: DataFrame) -> DataFrame:
    """Paths over tasks whose number follows the listed bytes, so a crowded folder is read by many tasks."""
    listing = materialize(listing.select("path", "length"))
    total = listing.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(listing.sparkSession.sparkContext.defaultParallelism, -(-total // BYTES_PER_TASK))
    return listing.repartition(int(tasks), "path").select("path")


def read_contents(listing: DataFrame, root: str) -> DataFrame:
    """``(path, content)`` of listed files; NULL content for an unreadable file."""
    place = Place.of(root)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place.open()
        paths: list[str] = []
        contents: list[bytes | None] = []
        held = 0
        for batch in batches:
            for path in batch.column("path").to_pylist():
                paths.append(path)
                contents.append(read_file(files, _join(base, path)))
                held += len(contents[-1] or b"")
                if held >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                    yield _batch(path=paths, content=contents)
                    paths, contents, held = [], [], 0
        if paths:
            yield _batch(path=paths, content=contents)

    return _spread(listing).mapInArrow(read, CONTENT_DDL)


def read_file(files: fs.FileSystem, path: str) -> bytes | None:
    try:
        with files.open_input_stream(path) as source:
            return source.read()
    except OSError:
        return None


def digest_contents(listing: DataFrame, root: str) -> DataFrame:
    """``(path, digest)`` of listed files, SHA-256 of the bytes; contents never leave the task that reads them.

    An unreadable file has no digest.
    """
    place = Place.of(root)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = place.open()
        for batch in batches:
            paths = batch.column("path").to_pylist()
            yield _batch(path=paths, digest=[_digest(files, _join(base, path)) for path in paths])

    return _spread(listing).mapInArrow(digest, DIGEST_DDL)


def _digest(files: fs.FileSystem, path: str) -> str | None:
    found = hashlib.sha256()
    try:
        with files.open_input_stream(path) as source:
            while chunk := source.read(CHUNK_BYTES):
                found.update(chunk)
    except OSError:
        return None
    return found.hexdigest()


def read_project(
    spark: SparkSession, root: str, profile: str | Profile, units: int | None = None
) -> tuple[DataFrame, DataFrame]:
    """``(listing, contents)``: the whole listing, and the project PHP files read."""
    listing = list_tree(spark, root, units=units)
    return listing, read_contents(custom_files(listing, profile), root)


def read_binary_files(spark: SparkSession, root: str) -> DataFrame:
    """``(path, content)`` through Spark's own reader: any Hadoop file system,
    but names starting with ``_`` or ``.`` are not seen."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    return found.select(below(root).alias("path"), "content")


def below(root: str) -> Column:
    """The binary reader's ``path`` (a full URI) relative to ``root``."""
    where = root if "://" in root else "file:" + os.path.abspath(root)
    return relative_path(F.regexp_replace("path", "^file:/+", "file:/"), where)


def write_tree(files: DataFrame, root: str) -> None:
    """Write ``(path, content)`` as single files below ``root``, from the tasks.

    A path that is absolute or climbs by ``..`` is an error, so nothing is written outside of the tree.
    """
    place = Place.of(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        target, base = place.open()
        made: set[str] = set()
        written = 0
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                if path.startswith("/") or ".." in path.split("/"):
                    raise ValueError(f"path outside of the tree: {path!r}")
                at = _join(base, path)
                folder = at.rpartition("/")[0]
                if folder not in made:
                    target.create_dir(folder, recursive=True)
                    made.add(folder)
                # A repeated task rewrites the same bytes.
                with target.open_output_stream(at) as out:
                    out.write(content)
                written += 1
        yield pa.RecordBatch.from_arrays([pa.array([written], pa.int64())], names=["written"])

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(
        write, "written bigint"
    ).agg(F.sum("written")).collect()
