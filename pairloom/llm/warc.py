"""WARC archives with an external index merge.

Writing: each task sorts its captures by URL key, time and page, and writes them as gzip members, one per record, to archives in the shared
folder, and their index lines, sorted as they are, to a run beside them.  Names are unique to the attempt, and a run counts only through the row
that Spark commits for it, so a task that is run again leaves nothing but unused files.  Captures of an equal payload are revisits of the one with
the smallest page id.

Index: runs are merged from their files by loser trees of at most ``FAN_IN`` leaves, in rounds until so few runs are left; the last round merges
ranges of (key, time, page) side by side, so a URL that has a third of all captures is spread over many tasks.  The ranges come from evenly spaced
keys that each run's writer keeps (at most ``MARKS``).  A task holds one batch of ``RUN_BATCH`` lines of each of its runs, whatever their length.
The result is globally ordered by partition and within each.  Reading goes by the merged index: file, offset, length.

Defined results: a null payload is empty, a very long one is held whole by one task at a time; a null URL has the empty key; captures of one key and
time follow their page ids, null ids last, and then their places in the archives; all rows that repeat the smallest page id with its payload are
responses; null page ids are responses only if no row with that payload has an id; no pages: no archives, no rows.  Only the named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import materialise, release, shared_dir
from pairloom.session import remove
from pairloom.sources.stores import absolute, file_system

#: Bytes after which an archive is closed and the next begun; distinct repeated payloads up to which their table is broadcast.
ARCHIVE_BYTES, BROADCAST_ROWS = 256_000_000, 500_000
#: Runs that are merged at once; lines of a run that are held at once; keys that are kept of a run; lines of a range of the last round.
FAN_IN, RUN_BATCH, MARKS, RANGE_LINES = 64, 500, 1_000, 100_000
RUN = "folder string, run string, n_lines bigint, step bigint, marks array<string>"
_LINE = pa.schema([("key", pa.string()), ("ts", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
INDEX = "key string, ts string, page_id bigint, url string, file string, offset bigint, length bigint"
RECORD = "key string, ts string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: Column) -> Column:
    """Host labels in reverse order, then the path and query."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    rest = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    return F.coalesce(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), rest), F.lit(""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, ts: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """One record, uncompressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    digest = digest_of(payload)
    own = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {url} {ts} {digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{own}>",
        f"WARC-Date: {ts}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


_SAFE = "".join(chr(c) for c in range(33, 127) if c != ord("%"))


def parse(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Headers, HTTP head and payload of a record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record doesn't end where its Content-Length says")
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers, http, payload


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(5, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", ts: Column | None = None, min_revisit_bytes: int = 0) -> DataFrame:
    """Write every page as a record below ``folder``; returns the committed index, a sorted run per archive."""
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    if ts is None:  # captures without a time: a second for each id
        ts = F.date_format(F.timestamp_seconds(F.lit(1_600_000_000) + F.coalesce(F.col(id_col), F.lit(0)) % 100_000_000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    own = pages.select(url_key(F.col(url_col)).alias("key"), ts.alias("ts"), F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digests = own.where(F.length("payload") >= min_revisit_bytes).select("page_id", F.sha1("payload").alias("sha"))
    repeated = materialise(digests.groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("sha", "first_id"))
    few = repeated.count() <= BROADCAST_ROWS
    joined = own.withColumn("own_sha", F.when(F.length("payload") >= min_revisit_bytes, F.sha1("payload"))).join(F.broadcast(repeated) if few else repeated, F.col("own_sha") == F.col("sha"), "left")
    revisit = F.col("sha").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    captures = joined.select("key", "ts", "page_id", "url", "payload", F.when(revisit, F.col("first_id")).alias("refers_to"), revisit.alias("revisit"))
    folder = absolute(folder)
    system, root = file_system(folder)
    system.create_dir(root, recursive=True)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        run = RunWriter(folder)
        stream, name, at = None, "", 0
        for batch in batches:
            for i in range(batch.num_rows):
                key, when, page, url, body, refers, again = (c[i].as_py() for c in batch.columns)
                if stream is None or at >= ARCHIVE_BYTES:
                    if stream is not None:
                        stream.close()
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    stream = store.open_output_stream(f"{base}/{name}", compression=None)
                packed = _gzip(record(page, url, when, body, refers, again))
                stream.write(packed)
                run.add((key, when, page, url, name, at, len(packed)))
                at += len(packed)
        if stream is not None:
            stream.close()
        yield run.close()

    runs = materialise(captures.sortWithinPartitions("key", "ts", F.col("page_id").asc_nulls_last()).mapInArrow(write, RUN))
    release(repeated)
    return runs


def _order(line: tuple) -> tuple:
    """What lines are ordered by; no two lines of an index are equal in it."""
    key, ts, page, _, file, offset, _ = line
    return key, ts or "", page is None, page or 0, file, offset


class RunWriter:
    """A sorted run of index lines in the shared folder, written batch by batch; the file is made with the first line."""

    def __init__(self, folder: str):
        self.folder, self.name, self.out = folder, f"{uuid.uuid4().hex}.run", None
        self.held: list[tuple] = []
        self.marks: list[tuple] = []
        self.n, self.step = 0, 1

    def add(self, line: tuple) -> None:
        if self.n % self.step == 0:
            if len(self.marks) == MARKS:
                self.marks, self.step = self.marks[::2], 2 * self.step
            if self.n % self.step == 0:
                self.marks.append(_order(line))
        self.held.append(line)
        self.n += 1
        if len(self.held) == RUN_BATCH:
            self._flush()

    def _flush(self) -> None:
        if self.out is None:
            store, base = file_system(self.folder)
            self.stream = store.open_output_stream(f"{base}/{self.name}", compression=None)
            self.out = pa.ipc.new_file(self.stream, _LINE)
        self.out.write_batch(_lines(self.held))
        self.held = []

    def close(self) -> pa.RecordBatch:
        """The row that commits the run; none for a run without lines."""
        if self.held:
            self._flush()
        if self.out is not None:
            self.out.close()
            self.stream.close()
        row = [(self.folder, self.name, self.n, self.step, [json.dumps(m) for m in self.marks])] if self.n else []
        columns = [*zip(*row, strict=True)] or [()] * 5
        kinds = (pa.string(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()))
        return pa.record_batch([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["folder", "run", "n_lines", "step", "marks"])


def _lines(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LINE, strict=True)], schema=_LINE)


def run_lines(folder: str, run: str, low: tuple | None = None, high: tuple | None = None) -> Iterator[tuple[tuple, tuple]]:
    """(order, line) of a run's lines from ``low`` up to but without ``high``, a batch at a time."""
    store, base = file_system(folder)
    with store.open_input_file(f"{base}/{run}") as raw:
        own = pa.ipc.open_file(raw)

        def first(k: int) -> tuple:
            return _order(tuple(c[0].as_py() for c in own.get_batch(k).columns))

        k = max(0, bisect_right(range(own.num_record_batches), low, key=first) - 1) if low is not None else 0
        for b in range(k, own.num_record_batches):
            for line in zip(*(c.to_pylist() for c in own.get_batch(b).columns), strict=True):
                at = _order(line)
                if high is not None and at >= high:
                    return
                if low is None or at >= low:
                    yield at, line


class LoserTree:
    """K-way merge of sorted runs: a match of two runs is replayed only along one leaf's path to the root."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.heads = [next(r, None) for r in runs]
        self.size = max(1, len(runs))
        self.losers = [-1] * self.size
        for leaf in range(len(runs)):
            self._enter(leaf)

    def _before(self, a: int, b: int) -> bool:
        """Run a's head comes first; an ended run comes last, ties go by the run's number."""
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x[0], a) < (y[0], b)

    def _enter(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.size) // 2
        while node:
            if self.losers[node] == -1:  # the first to come waits for the other subtree
                self.losers[node] = winner
                return
            if self._before(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.losers[0]] is not None:
            winner = self.losers[0]
            yield self.heads[winner][1]
            self.heads[winner] = next(self.runs[winner], None)
            node = (winner + self.size) // 2
            while node:
                if self._before(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.losers[0] = winner


def _shorter(runs: DataFrame) -> DataFrame:
    """A round: each ``FAN_IN`` runs become one."""
    spark = runs.sparkSession
    names = sorted((r["folder"], r["run"]) for r in runs.select("folder", "run").collect())
    groups = [(names[k][0], [n for _, n in names[k : k + FAN_IN]]) for k in range(0, len(names), FAN_IN)]

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                run = RunWriter(folder)
                for line in LoserTree([run_lines(folder, n) for n in own]):
                    run.add(line)
                yield run.close()

    return materialise(spark.createDataFrame(groups, "folder string, runs array<string>").repartition(len(groups)).mapInArrow(merged, RUN))


def _borders(runs: list, ranges: int) -> list[tuple]:
    """Where ranges of about equal numbers of lines begin, by the runs' evenly spaced keys (the first begins before all)."""
    marks = sorted((tuple(json.loads(m)), r["step"]) for r in runs for m in r["marks"])
    total, seen, out = sum(n for _, n in marks), 0, []
    for mark, n in marks:
        if seen * ranges >= total * (len(out) + 1) and (not out or mark > out[-1]):
            out.append(mark)
        seen += n
    return out


def merge_runs(runs: DataFrame, ranges: int | None = None) -> DataFrame:
    """The index lines of all runs in global order of (key, ts, page_id, file, offset): by partition, and within each.

    The driver holds a row per run that is left after the rounds, at most ``FAN_IN``, and its names before them.
    """
    spark, own = runs.sparkSession, runs
    while own.count() > FAN_IN:
        after = _shorter(own)
        if own is not runs:
            release(own)
        own = after
    last = own.collect()
    if own is not runs:
        release(own)
    if ranges is None:
        ranges = max(-(-sum(r["n_lines"] for r in last) // RANGE_LINES), 2 * spark.sparkContext.defaultParallelism)
    borders = [None, *_borders(last, ranges), None]
    names = sorted((r["folder"], r["run"]) for r in last)

    def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                held = []
                for line in LoserTree([run_lines(*n, borders[k], borders[k + 1]) for n in names]):
                    held.append(line)
                    if len(held) == 5_000:
                        yield _lines(held)
                        held = []
                if held:
                    yield _lines(held)

    n = len(borders) - 1
    return spark.range(0, n, 1, n).mapInArrow(merged, INDEX)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records that index lines point to, in the lines' order."""
    folder = absolute(folder)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = file_system(folder)
        for batch in batches:
            keys, times, _, urls, files, offsets, lengths = (c.to_pylist() for c in batch.columns)
            n = batch.num_rows
            out: list = [None] * n
            order = sorted(range(n), key=lambda i: (files[i], offsets[i]))
            opened, name = None, None
            for i in order:
                if files[i] != name:
                    if opened is not None:
                        opened.close()
                    name, opened = files[i], store.open_input_file(f"{base}/{files[i]}")
                headers, http, payload = parse(zlib.decompress(opened.read_at(lengths[i], offsets[i]), 31))
                kind = headers["WARC-Type"]
                declared = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                if kind == "response" and (len(payload) != declared or digest_of(payload) != digest):
                    raise ValueError("a payload differs from its record's digest")
                if "WARC-Target-URI" in headers and urls[i] is not None and unquote(headers["WARC-Target-URI"]) != urls[i]:
                    raise ValueError("the index points to another URL's record")
                page, refers = headers.get("X-Page-ID"), headers.get("X-Refers-To-Page-ID")
                out[i] = (int(page) if page else None, declared, digest, kind, int(refers) if refers else None)
            if opened is not None:
                opened.close()
            pages, sizes, digests, kinds, refs = zip(*out, strict=True) if out else ([],) * 5
            yield pa.record_batch(
                [pa.array(keys, pa.string()), pa.array(times, pa.string()), pa.array(pages, pa.int64()), pa.array(urls, pa.string()), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), pa.array(kinds, pa.string()), pa.array(refs, pa.int64())],
                ["key", "ts", "page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return index.mapInArrow(read, RECORD)


def archive_round_trip(pages: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """Write, merge the index, read back in capture order.  Without a folder the archives are deleted once their records are read and written down."""
    if folder is not None:
        return read_records(merge_runs(write_archives(pages, folder, **options)), folder)
    folder = f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    runs = write_archives(pages, folder, **options)
    found = materialise(read_records(merge_runs(runs), folder))
    release(runs)
    remove(pages.sparkSession, folder)
    return found
