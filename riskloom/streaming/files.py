"""Files that arrive in a tree, hidden names included, as a streaming data source.

An offset is a point in time: a batch holds the files whose modification time lies after the last batch's and not
after its own.  So offsets stay small however large the tree is, a batch that is run again holds the same files, and a
restart goes on where the checkpoint ends.  A file that changes arrives again.
"""

from __future__ import annotations

import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader

from riskloom.sources.tree import BATCH_BYTES, BATCH_ROWS, CONTENT_DDL, Place, TreePartition, files_of, place_of, read_file, split_tree

#: Seconds that clocks may differ and writers may take; files younger than that wait for the next batch.
SETTLE_SECONDS = 2.0


class ArrivalPartition(TreePartition):
    """A part of the tree and the time in which its files must have been written."""

    def __init__(self, part: TreePartition, after: int, until: int):
        super().__init__(part.folders, part.recursive)
        self.after = after
        self.until = until


class ArrivalReader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.place = place_of(options)
        self.units = int(options.get("units", "64"))
        self.settle = int(float(options.get("settle", SETTLE_SECONDS)) * 1e9)

    def initialOffset(self) -> dict:
        return {"until": 0}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - self.settle}

    def partitions(self, start: dict, end: dict) -> list[ArrivalPartition]:
        if end["until"] <= start["until"]:
            return []
        self.place.check()
        parts = split_tree(self.place, self.units, frozenset())
        return [ArrivalPartition(part, start["until"], end["until"]) for part in parts]

    def read(self, partition: ArrivalPartition) -> Iterator[pa.RecordBatch]:
        paths: list[str] = []
        contents: list[bytes | None] = []
        held = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], names=["path", "content"])

        for files, path, info in files_of(self.place, partition):
            if info.mtime_ns is None:
                raise ValueError(f"the file system keeps no modification times: {self.place.uri}")
            if not partition.after < info.mtime_ns <= partition.until:
                continue
            paths.append(path)
            contents.append(read_file(files, info.path))
            held += len(contents[-1] or b"")
            if held >= BATCH_BYTES or len(paths) >= BATCH_ROWS:
                yield batch()
                paths, contents, held = [], [], 0
        if paths:
            yield batch()


class ArrivingFiles(DataSource):
    """``spark.readStream.format("srctree_arrivals").load(root)``; options ``settle`` (seconds) and ``units``."""

    @classmethod
    def name(cls) -> str:
        return "srctree_arrivals"

    def schema(self) -> str:
        return CONTENT_DDL

    def streamReader(self, schema) -> ArrivalReader:
        return ArrivalReader(dict(self.options))


def arriving_files(spark: SparkSession, root: str, settle: float = SETTLE_SECONDS, units: int | None = None) -> DataFrame:
    """``(path, content)`` of files that appear below ``root`` on any file system; NULL content where unreadable.

    The tree is listed once a batch, in at most ``units`` tasks.  A file counts by its modification time, so it must
    not be moved into the tree with an older one.
    """
    spark.dataSource.register(ArrivingFiles)
    units = units or 4 * spark.sparkContext.defaultParallelism
    reader = spark.readStream.format("srctree_arrivals").option("place", Place.of(root).pack())
    return reader.option("settle", str(settle)).option("units", str(units)).load()
