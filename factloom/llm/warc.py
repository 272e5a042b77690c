"""WARC archives and an external merge of their capture indexes.

``write_archives`` writes gzip members, one a record, to files in the shared folder. ``index_runs`` reads the archives
back, checks every payload and gives for each file a run of capture lines sorted by URL key and time. ``merge_runs``
deals all runs by ranges of that order and merges the slices of the runs in each range with a loser tree, so that
the parts, one after the other, hold the globally ordered capture histories.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the smallest id is the response, and
the others are revisits that refer to it by record id, URI and date and store no payload; smaller payloads are stored
each time. Payloads are not shuffled while the table of repeated ones has at most ``MOST_SHARED`` rows.

Edge cases: a null payload is empty; payloads of any length are stored whole; a null URL becomes the empty URI, with
the empty URL key; a null time is the crawl's; captures of one URL key go by time, then id (null first), file and
offset; null ids lose to all others and are written as ``None``; equal payloads with equal ids stay responses alike; an
empty table gives no captures; other columns are not read, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

REVISIT_BYTES = 100
#: Repeated payloads up to which their table (some 300 bytes a row) is broadcast; a larger one is joined in a shuffle.
MOST_SHARED = 200_000
#: Captures merged in one range, so in one task's memory.
RANGE_ROWS = 100_000
LINE = "url_key string, ts string, page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, file string, offset bigint, length bigint"
_FIELDS = [x.split()[0] for x in LINE.split(", ")]
_SCHEMA = pa.schema([(x.split()[0], pa.string() if x.split()[1] == "string" else pa.int64()) for x in LINE.split(", ")])


def url_key(url: str) -> str:
    """Host labels reversed and lower-cased, then the rest: ``com,example)/path?query``."""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host = rest[:cut].lower().rpartition("@")[2].partition(":")[0].removeprefix("www.")
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut:].lower() or "/") if rest else ""


def _record_id(page_id: int | None, url: str, ts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {ts}')}>"


def _uri(url: str) -> str:
    return quote(url, safe=":/?#[]@!$&()*+,;=%~")


def _record(kind: str, url: str, ts: str, page_id: int | None, payload: bytes, digest: str, size: int, first: dict | None) -> bytes:
    """One record; ``first`` (id, url, ts) is the response that a revisit refers to."""
    body = b"" if kind == "revisit" else payload
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Target-URI: {_uri(url)}", f"WARC-Date: {ts}", f"WARC-Record-ID: {_record_id(page_id, url, ts)}", "Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {size}", f"X-Page-Id: {page_id}", f"X-Url: {quote(url, safe='')}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(first['id'], first['url'], first['ts'])}", f"WARC-Refers-To-Target-URI: {_uri(first['url'])}", f"WARC-Refers-To-Date: {first['ts']}", f"X-Refers-To-Page: {first['id']}"]
    content = http + body
    return "\r\n".join([*head, f"Content-Length: {len(content)}", "", ""]).encode() + content + b"\r\n\r\n"


def read_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of one record's bytes."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    content = rest[: int(fields["content-length"])]
    return fields, content.partition(b"\r\n\r\n")[2]


def _fs(uri: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")
    return fs, path


def classify(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", ts_col: str | None = None, crawl_ts: str = "2024-01-01T00:00:00Z", revisit_bytes: int = REVISIT_BYTES, most_shared: int = MOST_SHARED) -> DataFrame:
    """``page_id, url, ts, payload, payload_bytes, payload_digest, first``: the id, url and ts of the capture with the
    smallest id of its payload, null for payloads that occur once."""
    src = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"),
        F.coalesce(F.date_format(F.col(ts_col), "yyyy-MM-dd'T'HH:mm:ss'Z'") if ts_col else F.lit(None).cast("string"), F.lit(crawl_ts)).alias("ts"),
        F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("payload"),
    )
    src = src.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha2("payload", 256)})
    # Only payloads that occur more than once are kept, each once; a hot one is a single row here.
    first = F.when(F.col("page_id").isNotNull(), F.struct(F.col("page_id").alias("id"), "url", "ts"))
    shared = src.where(F.col("payload_bytes") >= revisit_bytes).groupBy(F.unhex("payload_digest").alias("_digest")).agg(F.min(first).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    shared = common.materialise(shared, "warc-shared")
    src = src.withColumn("_digest", F.unhex("payload_digest"))
    if shared.count() <= most_shared:
        return src.join(F.broadcast(shared), "_digest", "left").drop("_digest")
    return common.join_unique(src, shared, "_digest").drop("_digest")


def write_archives(rows: DataFrame, folder: str, most_bytes: int = 256 << 20) -> DataFrame:
    """Write the rows of ``classify`` as ``.warc.gz`` files of about ``most_bytes`` each; gives a row for each file.

    A task writes under a name of its own attempt and moves the finished file, so a task that runs again replaces
    its file by equal bytes.
    """
    common.arrow_limits(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        fs.create_dir(root, recursive=True)
        task = TaskContext.get()
        part, attempt = task.partitionId(), task.taskAttemptId()
        done, out, size = [], None, 0

        def close():
            out.close()
            name = f"{part:06d}-{len(done):04d}.warc.gz"
            fs.move(f"{root}/.{part}-{attempt}", f"{root}/{name}")
            done.append((name, size))

        for b in batches:
            for r in b.to_pylist():
                revisit = r["first"] is not None and r["page_id"] != r["first"]["id"]
                raw = _record("revisit" if revisit else "response", r["url"], r["ts"], r["page_id"], r["payload"], r["payload_digest"], r["payload_bytes"], r["first"])
                if out is None:
                    out, size = fs.open_output_stream(f"{root}/.{part}-{attempt}", compression=None), 0
                member = gzip.compress(raw, 3, mtime=0)
                out.write(member)
                size += len(member)
                if size >= most_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["file", "bytes"])

    return rows.select("page_id", "url", "ts", "payload", "payload_bytes", "payload_digest", "first").mapInArrow(common.trimmed(run), "file string, bytes bigint")


def _members(f: io.RawIOBase) -> Iterator[tuple[int, int, bytes]]:
    """Offset, length and content of each gzip member of an archive, read in blocks."""
    import zlib

    at, held, ended = 0, b"", False
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            if not held:
                held = f.read(1 << 20)
                if not held:
                    ended = True
                    break
            parts.append(z.decompress(held))
            rest = z.unused_data if z.eof else b""
            used += len(held) - len(rest)
            held = rest
        if ended:
            if used:
                raise ValueError("the archive ends within a record")
            return
        yield at, used, b"".join(parts)
        at += used


def index_runs(spark: SparkSession, files: DataFrame, folder: str) -> DataFrame:
    """Read the archives back; each file gives a run, sorted by URL key, time and id. ``run`` names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _fs(folder)
        for b in batches:
            for name in b.column(0).to_pylist():
                lines = []
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    for offset, length, raw in _members(f):
                        h, payload = read_record(raw)
                        kind, digest = h["warc-type"], h["warc-payload-digest"].removeprefix("sha256:")
                        if kind == "response":
                            size = len(payload)
                            if hashlib.sha256(payload).hexdigest() != digest:
                                raise ValueError(f"{name}: the payload at {offset} doesn't have its digest")
                        else:
                            size = int(h["x-payload-length"])
                        page, refers = (None if h.get(k, "None") == "None" else int(h[k]) for k in ("x-page-id", "x-refers-to-page"))
                        url = unquote(h["x-url"])
                        lines.append((url_key(url), h["warc-date"], page, url, size, digest, kind, refers, name, offset, length))
                lines.sort(key=_rank)
                for i in range(0, len(lines), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*lines[i : i + 10_000], strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return files.select("file").repartition(max(files.count(), 1), "file").mapInArrow(common.trimmed(run), LINE)


def _rank(line: tuple) -> tuple:
    return (line[0], line[1], line[2] is not None, line[2] or 0, line[8], line[9])


class LoserTree:
    """Merges k sorted sequences; each row taken costs one comparison a level."""

    def __init__(self, runs: list[list], rank: Callable = lambda x: x):
        self.runs, self.rank, self.at = runs, rank, [0] * len(runs)
        self.k = len(runs)
        self.keys = [rank(r[0]) if r else None for r in runs]
        self.tree = [0] * max(self.k, 1)
        self.win = self._build(1) if self.k else 0

    def _less(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _build(self, node: int) -> int:
        """Winner below a node of the implicit tree; its loser stays at the node."""
        if node >= self.k:
            return node - self.k
        a, b = self._build(2 * node), self._build(2 * node + 1)
        a, b = (a, b) if self._less(a, b) else (b, a)
        self.tree[node] = b
        return a

    def __iter__(self):
        while self.k and self.keys[self.win] is not None:
            w = self.win
            run, i = self.runs[w], self.at[w]
            yield run[i]
            self.at[w] = i + 1
            self.keys[w] = self.rank(run[i + 1]) if i + 1 < len(run) else None
            node = (w + self.k) // 2
            while node:
                if self._less(self.tree[node], w):
                    w, self.tree[node] = self.tree[node], w
                node //= 2
            self.win = w


def merge_runs(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """All captures in global order of URL key, time and id, over the parts one after the other."""
    spark = runs.sparkSession
    common.arrow_limits(spark)
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // range_rows))
    dealt = runs.repartitionByRange(parts, "url_key", "ts", "page_id", "file", "offset").sortWithinPartitions("file", "url_key", "ts", F.col("page_id").asc_nulls_first(), "offset")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[tuple]] = {}
        for b in batches:
            for line in zip(*(c.to_pylist() for c in b.columns), strict=True):
                slices.setdefault(line[8], []).append(line)
        out = list(LoserTree(list(slices.values()), _rank))
        for i in range(0, len(out), 10_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[i : i + 10_000], strict=True), _SCHEMA.types, strict=True)], schema=_SCHEMA)

    return dealt.select(*_FIELDS).mapInArrow(common.trimmed(run), LINE)


def archive(pages: DataFrame, folder: str, **columns) -> DataFrame:
    """Write archives of all pages below ``folder``, read them back and merge their runs into one capture history."""
    spark = pages.sparkSession
    files = common.materialise(write_archives(classify(pages, **columns), folder), "warc-files")
    return merge_runs(common.materialise(index_runs(spark, files, folder), "warc-runs"))
