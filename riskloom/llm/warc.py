"""WARC archives with revisit records, and an index merged from locally sorted runs.

Each task writes gzip-member archives of a bounded size to the shared folder and, for each archive, one run of index
entries sorted by URL key, timestamp and page.  Range partitioning deals every key range's slices of all runs to one
task, which merges them with a loser tree; ranges are sized by the number of entries, so one URL with many captures
is spread over several.  Ranges in order, and positions in them, are the global order of all captures.

Files are named by task attempt, and only those that the written entries name count, so a lost executor leaves at
most files that nothing refers to.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote, urlsplit

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskloom.session import materialize

#: Payloads below this size are always stored.
MIN_REVISIT_BYTES = 100
ARCHIVE_BYTES = 64 << 20
#: Index entries that one task merges, about.
MERGE_ENTRIES = 200_000

ENTRY = "urlkey string, captured string, page_id long, archive string, `offset` long, length long, digest string, record_type string"
_ENTRY = pa.schema(
    [(n, pa.string()) for n in ("urlkey", "captured")]
    + [("page_id", pa.int64()), ("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]
    + [("digest", pa.string()), ("record_type", pa.string())]
)
_EPOCH = datetime(2020, 1, 1, tzinfo=UTC)


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the right, then path and query; scheme, ``www`` and fragment don't count."""
    try:
        parts = urlsplit(url.strip().lower())
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port not in (None, 80, 443) else ""
    except ValueError:  # brackets or a port that can't be read
        return url.strip().lower()
    query = f"?{parts.query}" if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{port}){parts.path or '/'}{query}"


def record(row: dict, captured: str) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, whose Content-Length is that of the payload."""
    body = row["body"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    revisit = row["refers_to"] is not None
    block = head if revisit else head + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if row['page_id'] is None else row['page_id']}>",
        f"WARC-Date: {captured[:4]}-{captured[4:6]}-{captured[6:8]}T{captured[8:10]}:{captured[10:12]}:{captured[12:14]}Z",
        f"WARC-Target-URI: {re.sub('[^!-~]', lambda m: quote(m[0]), row['url'] or 'urn:unknown')}",
        f"WARC-Payload-Digest: sha256:{row['digest']}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{row['refers_to']}>",
        ]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields and payload of one record; checks lengths and, for a response, the payload's digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    size = int(fields["Content-Length"])
    block, end = rest[:size], rest[size:]
    if len(block) != size or end != b"\r\n\r\n":
        raise ValueError("record of another length than it states")
    http, _, payload = block.partition(b"\r\n\r\n")
    stated = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    if fields["WARC-Type"] == "response" and (len(payload), hashlib.sha256(payload).hexdigest()) != (stated, digest):
        raise ValueError("payload of another length or digest than stated")
    page = re.fullmatch("<urn:page:(.*)>", fields["WARC-Record-ID"])[1]
    refers = re.fullmatch("<urn:page:(.*)>", fields.get("WARC-Refers-To", "<urn:page:>"))[1]
    return {
        "page_id": int(page) if page else None,
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": int(refers) if refers else None,
        "payload": payload,
    }


def with_targets(pages: DataFrame, captured: Column | None = None) -> DataFrame:
    """``page_id, url, body, captured, digest, refers_to`` of each page.

    Of equal payloads of at least ``MIN_REVISIT_BYTES`` bytes, that of the smallest page is stored and others refer to
    it.  Rows that repeat the smallest id are all stored; a null id refers to the smallest other, if there is one.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    # Without a time of capture, pages count as captured second by second.
    when = captured if captured is not None else F.lit(None).cast("string")
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", body.alias("body"), when.alias("captured"), F.sha2(body, 256).alias("digest")
    )
    large = rows.filter(F.length("body") >= MIN_REVISIT_BYTES)
    firsts = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    firsts = materialize(firsts.filter("n > 1 AND first IS NOT NULL").select("digest", "first"))
    target = F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first"))
    return rows.join(firsts, "digest", "left").select("page_id", "url", "body", "captured", "digest", target.alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, captured: Column | None = None) -> DataFrame:
    """Write ``pages(page_id, url, html)`` below ``folder``; the written index entries, a sorted run for each archive.

    A null html is empty, a null url has an empty key.  No rows: no archive and no entries.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        task = TaskContext.get()
        out, number, entries = None, 0, []

        def run() -> pa.RecordBatch:
            entries.sort(key=_order)
            columns = zip(*entries, strict=True)
            done = pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, _ENTRY, strict=True)], schema=_ENTRY
            )
            entries.clear()
            return done

        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                if out is None:
                    files.create_dir(root, recursive=True)
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{number:04d}.warc.gz"
                    out, number, at = files.open_output_stream(f"{root}/{name}", compression=None), number + 1, 0
                time = row["captured"] or (_EPOCH + timedelta(seconds=(row["page_id"] or 0) % 2**31)).strftime("%Y%m%d%H%M%S")
                squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = squeeze.compress(record(row, time)) + squeeze.flush()
                out.write(data)
                kind = "response" if row["refers_to"] is None else "revisit"
                key = url_key(row["url"]) if row["url"] else ""
                entries.append((key, time, row["page_id"], name, at, len(data), row["digest"], kind))
                at += len(data)
                if at >= archive_bytes:
                    out.close()
                    out = None
                    yield run()
        if out is not None:
            out.close()
            yield run()

    return materialize(with_targets(pages, captured).mapInArrow(write, ENTRY))


def _order(entry: tuple) -> tuple:
    key, time, page, archive, offset = entry[:5]
    return key, time, -1 if page is None else page, archive, offset


class LoserTree:
    """Merges sorted iterables of tuples: inner nodes hold the losers of their matches, so a step is one path."""

    def __init__(self, runs: Iterable[Iterable[tuple]]):
        self.runs = [iter(r) for r in runs]
        self.heads = [self._next(k) for k in range(len(self.runs))]
        self.losers = [-1] * len(self.runs)
        for k in range(len(self.runs)):
            self._replay(k)

    def _next(self, k: int) -> tuple:
        entry = next(self.runs[k], None)
        return (1,) if entry is None else (0, _order(entry), k, entry)

    def _replay(self, k: int) -> None:
        node = (k + len(self.runs)) // 2
        while node:
            other = self.losers[node]
            if other < 0:
                self.losers[node] = k
                return
            if self.heads[other] < self.heads[k]:
                self.losers[node], k = k, other
            node //= 2
        self.winner = k

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.heads[self.winner][0] == 0:
            k = self.winner
            yield self.heads[k][3]
            self.heads[k] = self._next(k)
            self._replay(k)


def merge_runs(entries: DataFrame, merge_entries: int = MERGE_ENTRIES) -> DataFrame:
    """All entries with ``slice, position``, which give their place in the order of URL key, time and page.

    The runs are those of the archives.  A task holds the slices of its range, about ``merge_entries`` entries.
    """
    parts = max(1, -(-entries.count() // merge_entries))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                runs.setdefault(row[3], []).append(row)
        number, rows, schema = TaskContext.get().partitionId(), [], _ENTRY
        schema = schema.append(pa.field("slice", pa.int32())).append(pa.field("position", pa.int64()))

        def out() -> pa.RecordBatch:
            columns = zip(*rows, strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for position, entry in enumerate(LoserTree(runs.values())):
            rows.append((*entry, number, position))
            if len(rows) == 10_000:
                yield out()
                rows.clear()
        if rows:
            yield out()

    keys = ["urlkey", "captured", "page_id", "archive", "offset"]
    dealt = entries.repartitionByRange(parts, *keys).sortWithinPartitions("archive", *keys)
    return materialize(dealt.mapInArrow(merge, f"{ENTRY}, slice int, position long"))


def read_archives(index: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """The records that the index names, read at their offsets: an archive's by one task, in order of offset."""
    kinds = {
        "page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(),
        "record_type": pa.string(), "refers_to": pa.int64(), "slice": pa.int32(), "position": pa.int64(),
    }
    spec = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, slice int, position long"
    if with_payload:
        kinds["payload"] = pa.binary()
        spec += ", payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            for a in range(0, batch.num_rows, 500):
                rows = []
                for want in batch.slice(a, 500).to_pylist():
                    if want["archive"] != name:
                        name = want["archive"]
                        source = files.open_input_file(f"{root}/{name}")
                    data = source.read_at(want["length"], want["offset"])
                    got = parse(zlib.decompress(data, 31))
                    if (got["payload_digest"], got["record_type"]) != (want["digest"], want["record_type"]):
                        raise ValueError(f"{name} at {want['offset']}: another record than the index names")
                    rows.append(got | {"slice": want["slice"], "position": want["position"]})
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in kinds.items()], names=list(kinds))

    wanted = index.select("archive", "offset", "length", "digest", "record_type", "slice", "position")
    return wanted.repartition("archive").sortWithinPartitions("archive", "offset").mapInArrow(read, spec)
