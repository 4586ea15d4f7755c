"""WARC: write pages as archive records with revisits, read archives back as sorted capture runs, and merge runs by a loser tree to globally ordered capture histories."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path

_END = "\r\n\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def capture_time(id_col: Column) -> Column:
    """A capture time for pages that carry none: seconds of 2024 counted by id."""
    return F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.coalesce(id_col, F.lit(0)), F.lit(10**9)))


def with_revisits(pages: DataFrame, id_col: str = "page_id", payload_col: str = "html", least: int = 1000) -> DataFrame:
    """pages with __bytes, __digest (SHA-1, hex) and __refers (the id of the page that has the payload; null for responses).

    Of pages with equal payloads of at least `least` bytes the largest id is the response and the others revisit it;
    rows that repeat the largest id are responses too. Null payloads are empty. A group of null ids alone has no
    largest id: all are responses. Digests are grouped before the shuffle; only ids of revisits meet the pages again.
    """
    payload = F.coalesce(F.col(payload_col), F.lit(""))
    small = pages.select(F.col(id_col).alias("id"), F.octet_length(payload).cast("long").alias("bytes"), F.sha1(payload.cast("binary")).alias("digest")).filter(F.col("bytes") >= least)
    groups = materialize(small.groupBy("digest").agg(F.max("id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 AND keeper IS NOT NULL").select("digest", "keeper"), "payloads")
    again = materialize(small.select("id", "digest").hint("merge").join(groups, "digest").filter(~F.col("id").eqNullSafe(F.col("keeper"))).select(F.col("id").alias("__again"), F.col("digest").alias("__same"), F.col("keeper").alias("__refers")).distinct(), "revisits")
    base = pages.withColumns({"__bytes": F.octet_length(payload).cast("long"), "__digest": F.sha1(payload.cast("binary"))})
    return base.hint("merge").join(again, F.col(id_col).eqNullSafe(F.col("__again")) & (F.col("__digest") == F.col("__same")), "left").drop("__again", "__same")


def records(typed: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", time: Column | None = None) -> DataFrame:
    """(value) the text of a WARC/1.1 record for each row of with_revisits(), without the end of record. Blanks and control signs of a URL are escaped; a null URL is empty."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    url = F.regexp_replace(text(F.col(url_col)), r"[\x00-\x20\x7F]", "%20")
    revisit = F.col("__refers").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), text(F.col("__bytes")), F.lit(_END))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("__bytes"))
    when = F.date_format(capture_time(F.col(id_col)) if time is None else time, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), text(F.col(id_col)), F.lit(">\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), url,
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("__digest"),
        F.when(revisit, F.concat(F.lit(f"\r\nWARC-Profile: {_PROFILE}\r\nWARC-Refers-To: <urn:page:"), text(F.col("__refers")), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "), text(length), F.lit(_END),
    )
    return typed.select(F.concat(head, http, F.when(revisit, "").otherwise(text(F.col(payload_col)))).alias("value"))


def write_archives(rows: DataFrame, path: str, per_file: int = 5000) -> None:
    """Store records as gzip-compressed archives of at most per_file records: the end of a record is the writer's line separator."""
    rows.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", per_file).text(path)


class _Source:
    """Bytes of a gzip-compressed archive, unpacked as they are read."""

    def __init__(self, data: bytes):
        self.data, self.at, self.unzip, self.held, self.offset = data, 0, zlib.decompressobj(31), b"", 0

    def _more(self) -> bool:
        if self.unzip.eof:
            self.data, self.at = self.unzip.unused_data + self.data[self.at :], 0
            self.unzip = zlib.decompressobj(31)
        if self.at >= len(self.data):
            return False
        self.held += self.unzip.decompress(self.data[self.at : self.at + (1 << 18)])
        self.at += 1 << 18
        return True

    def until(self, mark: bytes) -> bytes | None:
        start = 0
        while (k := self.held.find(mark, start)) < 0:
            start = max(0, len(self.held) - len(mark) + 1)
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a record")
                return None
        out, self.held = self.held[:k], self.held[k + len(mark) :]
        self.offset += k + len(mark)
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out, self.held = self.held[:n], self.held[n:]
        self.offset += n
        return out


def url_key(url: str) -> str:
    """A URL as sort key: host parts from the last to the first, then the path; scheme, user, port, www and fragment left out."""
    m = re.match(r"(?:[a-zA-Z][a-zA-Z0-9+.-]*://)?(?:[^/@]*@)?([^/:?#]*)(?::\d+)?([^#]*)", url)
    host = m[1].lower().removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (m[2] or "/")


def _parse(data: bytes) -> Iterator[tuple]:
    """(url_key, captured, page_id, url, type, refers_to, payload_bytes, digest, offset, length) of each record; payload digests are verified."""
    source = _Source(data)
    number = lambda x: int(m[1]) if x and (m := re.search(r"<urn:page:(-?\d+)>", x)) else None
    while True:
        begin = source.offset
        head = source.until(b"\r\n\r\n")
        if head is None:
            return
        lines = head.decode("utf-8", "surrogatepass").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("no WARC record here")
        fields = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
        block = source.take(int(fields["content-length"]))
        http, _, payload = block.partition(b"\r\n\r\n")
        if source.take(4) != b"\r\n\r\n":
            raise ValueError("record does not end where its length says")
        digest = fields["warc-payload-digest"].removeprefix("sha1:")
        if fields["warc-type"] == "response":
            size = len(payload)
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("payload fails its digest")
        else:
            size = int(re.search(rb"(?im)^content-length: (\d+)", http)[1])
        url = fields["warc-target-uri"] if "warc-target-uri" in fields else ""
        yield url_key(url), fields["warc-date"], number(fields["warc-record-id"]), url, fields["warc-type"], number(fields.get("warc-refers-to")), size, digest, begin, source.offset - begin


_RUN = pa.schema([("run", pa.string()), ("url_key", pa.string()), ("captured", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
_RUN_DDL = "run string, url_key string, captured string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, offset long, length long"


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[3] is not None, row[3] or 0, row[9]


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """Read archives: one row per record, those of an archive sorted by URL key, time and page. `run` is the archive; offset and length place the record in the unpacked archive."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(b.num_rows):
                name = b.column(0)[k].as_py().rsplit("/", 1)[-1]
                rows = sorted(((name, *r) for r in _parse(b.column(1)[k].as_py())), key=_order)
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(_RUN)], schema=_RUN)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(work, _RUN_DDL)


def _row(batch: pa.RecordBatch, k: int) -> tuple:
    return tuple(c[k].as_py() for c in batch.columns)


def _rows_of(parts: list[pa.RecordBatch], rows: int = 256) -> Iterator[tuple]:
    """The rows of a run, a few at a time; what is read is let go."""
    parts.reverse()
    while parts:
        part = parts.pop()
        for at in range(0, part.num_rows, rows):
            yield from zip(*(c.to_pylist() for c in part.slice(at, rows).columns), strict=True)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _RUN, strict=True)], schema=_RUN)


class LoserTree:
    """k-way merge: inner nodes hold the losers of their matches, so the next row takes one match per level. It holds one row of each run."""

    def __init__(self, runs: list[Iterable[tuple]]):
        self.k = len(runs)
        self.runs = [iter(r) for r in runs]
        self.head = [next(r, None) for r in self.runs]
        self.keys = [None if h is None else _order(h) for h in self.head]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf)

    def _beats(self, a: int, b: int) -> bool:
        if self.keys[a] is None or self.keys[b] is None:
            return self.keys[b] is None and (self.keys[a] is not None or a < b)
        return (self.keys[a], a) < (self.keys[b], b)

    def _play(self, leaf: int) -> None:
        node, winner = (leaf + self.k) // 2, leaf
        while node > 0:
            if self.losers[node] < 0:
                self.losers[node] = winner
                return
            if self._beats(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.winner = winner

    def __iter__(self) -> Iterator[tuple]:
        if not self.k:
            return
        while (row := self.head[w := self.winner]) is not None:
            yield row
            self.head[w] = next(self.runs[w], None)
            self.keys[w] = None if self.head[w] is None else _order(self.head[w])
            node, winner = (w + self.k) // 2, w
            while node > 0:
                if self._beats(self.losers[node], winner):
                    self.losers[node], winner = winner, self.losers[node]
                node //= 2
            self.winner = winner


def merge_runs(runs: DataFrame, rows_per_task: int = 200_000) -> DataFrame:
    """Runs merged to one order by URL key, time and page: partition after partition, and row after row inside each.

    Ranges of keys are dealt to tasks of about rows_per_task rows (also a hot URL's captures, as time and page are part
    of the key). A task gets its stretch of every run as Arrow batches, in the order of the run, and merges them by a
    loser tree that turns a few rows of each to Python at a time.
    """
    n = runs.count()
    tasks = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // rows_per_task))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[list[pa.RecordBatch]] = []
        last = None
        for b in batches:
            names = b.column(0).to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.append(True, names[1:] != names[:-1]))
            for s, e in zip(edge, np.append(edge[1:], len(names)), strict=True):
                part = b.slice(s, e - s)
                # a run read in two places goes on as two runs
                if last is None or last[0] != names[s] or last[1] > _order(_row(part, 0)):
                    pieces.append([])
                pieces[-1].append(part)
                last = names[s], _order(_row(part, part.num_rows - 1))
        out = []
        for row in LoserTree([_rows_of(parts) for parts in pieces]):
            out.append(row)
            if len(out) == 10_000:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return runs.repartitionByRange(tasks, "url_key", "captured", "page_id").mapInArrow(work, _RUN_DDL)


def capture_history(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", path: str | None = None, time_col: str | None = None) -> DataFrame:
    """Write pages as archives (to path, or a new folder of the shared one), read them back, and return all captures in global order.

    The capture time is time_col's; pages without such a column get one of their id, see capture_time(), and a null time
    too.
    Nulls, empty payloads and repeated rows give records of their own, see with_revisits() and records(). A lost
    executor costs only its tasks: archives and runs are written tables.
    """
    spark = pages.sparkSession
    path = path or new_path(spark, "archives")
    given = F.col(time_col).cast("timestamp") if time_col else F.lit(None).cast("timestamp")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(payload_col).cast("string").alias("html"), F.coalesce(given, capture_time(F.col(id_col).cast("long"))).alias("captured"))
    write_archives(records(with_revisits(rows), time=F.col("captured")), path)
    return merge_runs(materialize(capture_runs(spark, path), "capture-runs"))
