"""One JSON document out of a distributed table, as a batch data source.

Rows ``(slot int, text string)`` are JSON values in the order of the document.  Each task writes its rows to a part
file of its own; the commit messages say which bytes of which part belong to which slot, and the commit puts the
committed parts together, piece by piece, into the layout.  Parts of failed or repeated attempts are in no message, so
they are not in the document.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from riskloom.session import materialize
from riskloom.sources.tree import CHUNK_BYTES, Place, place_of

MANY, ONE = "many", "one"
_SLOT = re.compile(r'"@(many|one):(\d+)"')


def many(slot: int) -> str:
    """Stands in a layout for an array of all values of a slot."""
    return f"@{MANY}:{slot}"


def one(slot: int) -> str:
    """Stands in a layout for the only value of a slot; ``null`` if there is none."""
    return f"@{ONE}:{slot}"


@dataclass
class PartWritten(WriterCommitMessage):
    """A part file and its runs ``(slot, first byte, last byte + 1)``, in order."""

    partition: int = 0
    path: str = ""
    runs: list[tuple[int, int, int]] = field(default_factory=list)


class DocumentWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str]):
        self.place = place_of(options)
        self.parts = options["parts"]
        self.layout = options["layout"]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> PartWritten:
        context = TaskContext.get()
        partition = context.partitionId() if context is not None else 0
        files, target = self.place.open()
        files.create_dir(target + self.parts, recursive=True)
        done = PartWritten(partition, f"{target}{self.parts}/{partition:06}-{uuid.uuid4().hex}")
        at = 0
        with files.open_output_stream(done.path) as out:
            for batch in iterator:
                for slot, text in zip(batch.column("slot").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if done.runs and done.runs[-1][0] == slot:
                        data = b",\n" + text.encode()
                        done.runs[-1] = (slot, done.runs[-1][1], at + len(data))
                    else:
                        data = text.encode()
                        done.runs.append((slot, at, at + len(data)))
                    out.write(data)
                    at += len(data)
        return done

    def commit(self, messages: list[PartWritten | None]) -> None:
        files, target = self.place.open()
        parts = sorted((m for m in messages if m is not None), key=lambda m: m.partition)
        temporary = f"{target}{self.parts}.whole"
        with files.open_output_stream(temporary) as out:
            rest = 0
            for found in _SLOT.finditer(self.layout):
                out.write(self.layout[rest : found.start()].encode())
                rest = found.end()
                kind, slot = found.group(1), int(found.group(2))
                runs = [(part.path, a, b) for part in parts for s, a, b in part.runs if s == slot]
                out.write((b"[\n" if runs else b"[") if kind == MANY else b"" if runs else b"null")
                for n, (path, a, b) in enumerate(runs):
                    if n:
                        out.write(b",\n")
                    with files.open_input_file(path) as source:
                        source.seek(a)
                        while a < b:
                            chunk = source.read(min(CHUNK_BYTES, b - a))
                            out.write(chunk)
                            a += len(chunk)
                out.write((b"\n]" if runs else b"]") if kind == MANY else b"")
            out.write(self.layout[rest:].encode())
        files.move(temporary, target)
        self.abort(messages)

    def abort(self, messages: list[PartWritten | None]) -> None:
        """Drop the parts, those of lost attempts too."""
        files, target = self.place.open()
        if files.get_file_info(target + self.parts).is_file is False:
            files.delete_dir(target + self.parts)


class JsonDocument(DataSource):
    @classmethod
    def name(cls) -> str:
        return "jsondocument"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(dict(self.options))


def write_document(rows: DataFrame, layout: dict, output: str) -> None:
    """Write ordered ``rows(slot, text)`` into ``layout``, whose slots are ``many(n)`` and ``one(n)``, as one file."""
    rows.sparkSession.dataSource.register(JsonDocument)
    writer = rows.select("slot", "text").write.format("jsondocument").mode("append")
    writer = writer.option("place", Place.of(output).pack()).option("parts", f".parts-{uuid.uuid4().hex}")
    writer.option("layout", json.dumps(layout, indent=2, ensure_ascii=False)).save()


#: How lines of the layout begin; values begin with none of these, or are not alone on the line.
_LAYOUT_LINE = r"^(?:[ \]]|[{}]\z)"
_OPENS = re.compile(r' *"([^"\\]+)": \[')


def read_document(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The layout of a written document, its arrays empty, and their values ``(key string, text string)``.

    The values must have no line feeds, and the keys of arrays no quotes and must not repeat.  Lines are read by as many
    tasks as the file has splits; only lines of the layout come to the driver.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(
        F.input_file_block_start().alias("split"), F.monotonically_increasing_id().alias("line"), F.col("value").alias("text")
    )
    layout = F.rlike("text", F.lit(_LAYOUT_LINE))
    found = lines.filter(layout).collect()
    found.sort(key=lambda r: (r.split, r.line))
    starts = [(m.group(1), r.split, r.line) for r in found if (m := _OPENS.fullmatch(r.text))]
    at = F.struct("split", "line")
    key = F.lit(None).cast("string")
    for name, split, line in starts:  # the last start before a value is that of its array
        key = F.when(at > F.struct(F.lit(split).cast("long"), F.lit(line).cast("long")), F.lit(name)).otherwise(key)
    values = lines.filter(~layout).select(key.alias("key"), F.regexp_replace("text", r",\z", "").alias("text"))
    # Places of lines hold for these splits only, so the values are not left to a later plan.
    return json.loads("\n".join(r.text for r in found)), materialize(values)
