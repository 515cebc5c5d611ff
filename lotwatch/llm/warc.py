"""WARC archives with a two-level capture index.

Records are gzip members of archive files. The index holds one line for each capture, sorted by
the URL key (host reversed) and page and cut into compressed blocks; each index file has a sparse
directory with the first key and the place of each of its blocks. A lookup finds the file among the
files' key ranges, searches its directory, reads one block, searches it, and reads the record.
Many lookups are sorted first, so that a task walks through neighbouring blocks. Every attempt of a
task writes under names of its own and renames when complete: what a lost or late attempt left
behind is never named by the index.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import os
import re
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from urllib.parse import quote_from_bytes, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Captures of one index block; bytes of an archive after which a task begins another.
BLOCK_LINES, ARCHIVE_BYTES = 1000, 256 << 20
#: Captures that one task reads back, about.
TASK_CAPTURES = 20_000
#: Neighbouring records are fetched by one read if no more than this many bytes lie between them.
READ_GAP, READ_BYTES = 1 << 16, 4 << 20
DATE = "2024-01-01T00:00:00Z"
SAFE = "".join(map(chr, range(0x21, 0x7F)))
LINE = "urlkey string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, archive string, offset long, length long"
DIRECTORY = "first_key string, first_page long, last_key string, last_page long, shard string, lines long"
PLACE = "archive string, offset long, length long"
#: Pages without an id sort before all others.
NO_PAGE = -(1 << 63)


def open_fs(path: str):
    """(filesystem, path within it) for a path or URI: every store that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def store_uri(spark: SparkSession, path: str) -> str:
    """``path`` as a URI of the store that Spark means by it: without a scheme, that of ``fs.defaultFS``. Spark's ``s3a`` is pyarrow's ``s3``."""
    if "://" not in path and not path.startswith("file:"):
        default = spark._jvm.org.apache.hadoop.fs.FileSystem.getDefaultUri(spark._jsc.hadoopConfiguration()).toString()
        path = f"file://{os.path.abspath(path)}" if default.startswith("file:") else f"{default.rstrip('/')}/{path.lstrip('/')}"
    return re.sub(r"^s3[an]://", "s3://", path)


def shared_root(spark: SparkSession, path: str) -> str:
    """The URI that tasks open, or an error before anything is written."""
    uri = store_uri(spark, path)
    try:
        open_fs(uri)
    except Exception as e:
        raise ValueError(f"archives can't be written under {uri}: pyarrow has no access to this store ({e})") from e
    return uri


def escaped(text: str) -> str:
    """Visible ASCII as it is, all else (blanks, controls, separators, other scripts) as percent escapes of its UTF-8 bytes."""
    return quote_from_bytes(text.encode("utf-8", "surrogatepass"), safe=SAFE)


def url_key(url: str | None) -> str:
    """Host reversed by its dots, then path and query, in lower case and escaped: captures of one site sort together."""
    if not url:
        return ""
    lower = url.strip().lower()
    try:
        parts = urlsplit(lower)
        host = (parts.hostname or "").removeprefix("www.")
        port = f":{parts.port}" if parts.port and parts.port not in (80, 443) else ""
    except ValueError:  # no valid address: the whole text is the key
        return escaped(lower)
    return escaped(",".join(reversed(host.split("."))) + port + ")" + (parts.path or "/") + (f"?{parts.query}" if parts.query else ""))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(url: str | None, page_id, payload: bytes, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member. A revisit has headers only, and names the page it repeats."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {escaped(url or '')}", f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Page-Id: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}",
    ]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    if refers_to is None:
        head.append("Content-Type: application/http; msgtype=response")
        body = http + payload
    else:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}')}>", f"X-Refers-To-Page: {refers_to}", "Content-Type: application/http; msgtype=response"]
        body = http
    head.append(f"Content-Length: {len(body)}")
    return gzip.compress("\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and payload of a record's gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    headers = {}
    for line in head.decode("utf-8", "surrogatepass").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        headers[name.strip().lower()] = value.strip()
    block = rest[: int(headers["content-length"])]
    return headers, block.partition(b"\r\n\r\n")[2]


class _Out:
    """A file that appears under its name only when complete."""

    def __init__(self, root: str, name: str):
        self.fs, base = open_fs(root)
        self.fs.create_dir(base, recursive=True)
        self.final, self.part = f"{base}/{name}", f"{base}/.{name}.{uuid.uuid4().hex}"
        self.stream, self.size = self.fs.open_output_stream(self.part, compression=None), 0

    def add(self, data: bytes) -> int:
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data)

    def close(self) -> None:
        self.stream.close()
        self.fs.move(self.part, self.final)


def _task() -> str:
    """A name that no other attempt of any task has."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId():08d}"


def _archive_writer(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, number, name = None, 0, ""
        for frame in batches:
            lines = []
            for page_id, url, html, refers in zip(frame["page_id"], frame["url"], frame["html"], frame["refers_to"]):
                page_id, refers = (None if pd.isna(x) else int(x) for x in (page_id, refers))
                payload = html.encode("utf-8", "surrogatepass") if isinstance(html, str) else b""
                url = url if isinstance(url, str) else None
                if out is None or out.size >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    name = f"pages-{_task()}-{number:04d}.warc.gz"
                    out, number = _Out(root, name), number + 1
                member = record(url, page_id, payload, refers)
                lines.append((url_key(url), page_id, url, "response" if refers is None else "revisit", refers, len(payload), digest_of(payload), name, out.add(member), len(member)))
            made = pd.DataFrame(lines, columns=[c.split()[0] for c in LINE.split(", ")])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})
        if out is not None:
            out.close()

    return run


def duplicates(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(payload_key, response): for payloads that occur more than once and have at least ``min_bytes``, the largest page_id."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    keyed = pages.where(F.octet_length(payload) >= min_bytes).select(F.sha2(payload.cast("binary"), 256).alias("payload_key"), "page_id")
    return keyed.groupBy("payload_key").agg(F.max("page_id").alias("response"), F.count("*").alias("n")).where("n > 1").select("payload_key", "response")


def write_archives(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write a record for each row of ``pages`` (page_id, url, html) and return the unsorted index lines."""
    root = shared_root(pages.sparkSession, root)
    slim = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    twice = common.written(duplicates(slim, min_bytes), "payloads")  # its size is known before the join is planned
    keyed = slim.withColumn("payload_key", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256)).join(twice, "payload_key", "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    ready = keyed.select("page_id", "url", "html", refers.alias("refers_to"))
    return common.written(ready.mapInPandas(_archive_writer(root), LINE), "captures")


def _place(key: str, page) -> tuple[str, int]:
    return key, NO_PAGE if page is None else int(page)


def _index_writer(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held, name = None, [], f"index-{_task()}"
        blocks = []

        def flush(lines: list[tuple[tuple[str, int], str]]) -> None:
            block = gzip.compress("".join(f"{k} {p} {j}\n" for (k, p), j in lines).encode("ascii"), 6, mtime=0)
            blocks.append((lines[0][0], lines[-1][0], out.add(block), len(block), len(lines)))

        for frame in batches:
            if out is None and len(frame):
                out = _Out(root, f"{name}.cdx.gz")
            for row in frame.itertuples(index=False):
                values = {k: None if v is None or v is pd.NA or v != v else (int(v) if not isinstance(v, str) else v) for k, v in row._asdict().items()}
                held.append((_place(values.pop("urlkey"), values["page_id"]), json.dumps(values)))  # JSON in ASCII: no line ends inside
                if len(held) >= BLOCK_LINES:
                    flush(held)
                    held = []
        made = []
        if out is not None:
            if held:
                flush(held)
            out.close()
            directory = _Out(root, f"{name}.dir.gz")
            directory.add(gzip.compress(json.dumps([[*first, offset, length] for first, _, offset, length, _ in blocks]).encode(), 6, mtime=0))
            directory.close()
            made.append((*blocks[0][0], *blocks[-1][1], name, sum(b[4] for b in blocks)))
        yield pd.DataFrame(made, columns=[c.split()[0] for c in DIRECTORY.split(", ")])

    return run


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Sort the captures by URL key and page over all tasks, write the blocks and their directories, and return each index file's range of keys."""
    root = shared_root(captures.sparkSession, root)
    # page_id breaks up a key that very many captures share.
    order = ["urlkey", F.coalesce("page_id", F.lit(NO_PAGE)), "archive", "offset"]
    ordered = captures.repartitionByRange(*order).sortWithinPartitions(*order)
    return common.written(ordered.mapInPandas(_index_writer(root), DIRECTORY), "directory")


def read_range(fs, path: str, offset: int, length: int) -> bytes:
    with fs.open_input_file(path) as f:
        return f.read_at(length, offset)


def read_file(fs, path: str) -> bytes:
    with fs.open_input_stream(path, compression=None) as f:
        return f.read()


def block_lines(data: bytes) -> list[tuple[tuple[str, int], str]]:
    """((key, page), JSON) of each line; the JSON is only parsed for lines that are looked for."""
    split = (line.split(" ", 2) for line in zlib.decompress(data, 31).decode("ascii").split("\n")[:-1])
    return [((k, int(p)), j) for k, p, j in split]


class Lookup:
    """Random access by URL. ``ranges`` has one row of each index file (as many as tasks wrote the index); all else is read where needed.

    The last directory and block read are kept: lookups in key order read each once.
    """

    def __init__(self, root: str, ranges: list[tuple]):
        self.fs, self.root = open_fs(root)
        self.files = sorted((_place(r[0], r[1]), _place(r[2], r[3]), r[4]) for r in ranges)
        self.first = [f[0] for f in self.files]
        self.held: dict[str, tuple] = {}

    def _directory(self, name: str) -> list:
        if self.held.get("directory", ("",))[0] != name:
            rows = json.loads(zlib.decompress(read_file(self.fs, f"{self.root}/{name}.dir.gz"), 31))
            self.held["directory"] = name, [(k, p) for k, p, _, _ in rows], [(o, n) for _, _, o, n in rows]
        return self.held["directory"][1:]

    def _block(self, name: str, offset: int, length: int) -> tuple[list, list]:
        if self.held.get("block", ("",))[0] != (name, offset):
            lines = block_lines(read_range(self.fs, f"{self.root}/{name}.cdx.gz", offset, length))
            self.held["block"] = (name, offset), [k for k, _ in lines], [j for _, j in lines]
        return self.held["block"][1:]

    def between(self, low: tuple[str, int], high: tuple[str, int]) -> Iterator[dict]:
        """The captures whose (key, page) lies between two bounds, both included."""
        for n in range(max(0, bisect_left(self.first, low) - 1), bisect_right(self.first, high)):
            if self.files[n][1] < low:
                continue
            firsts, places = self._directory(self.files[n][2])
            for m in range(max(0, bisect_left(firsts, low) - 1), bisect_right(firsts, high)):
                keys, lines = self._block(self.files[n][2], *places[m])
                for line in lines[bisect_left(keys, low) : bisect_right(keys, high)]:
                    yield json.loads(line)

    def captures(self, url: str | None) -> list[dict]:
        """All captures of pages whose URL has this URL's key."""
        key = url_key(url)
        return list(self.between((key, NO_PAGE), (key, -NO_PAGE)))

    def page(self, url: str | None, page_id: int | None) -> Iterator[dict]:
        """The captures of one page at exactly this URL."""
        at = _place(url_key(url), page_id)
        return (c for c in self.between(at, at) if c["url"] == url and c["page_id"] == page_id)

    def payload(self, capture: dict) -> bytes:
        return parse(read_range(self.fs, f"{self.root}/{capture['archive']}", capture["offset"], capture["length"]))[1]


def _keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in batches:
        frame["urlkey"] = [url_key(u if isinstance(u, str) else None) for u in frame["url"]]
        yield frame.astype({"page_id": "Int64"})


def _finder(root: str, ranges: list[tuple]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        lookup, columns = Lookup(root, ranges), [c.split()[0] for c in PLACE.split(", ")]
        for frame in batches:
            found = []
            for url, page_id in zip(frame["url"], frame["page_id"]):
                for c in lookup.page(url if isinstance(url, str) else None, None if pd.isna(page_id) else int(page_id)):
                    found.append((c["archive"], c["offset"], c["length"]))
                    if len(found) >= TASK_CAPTURES:
                        yield pd.DataFrame(found, columns=columns)
                        found = []
            yield pd.DataFrame(found, columns=columns)

    return run


def find(requests: DataFrame, root: str, directory: DataFrame) -> DataFrame:
    """(archive, offset, length) of the captures of the pages (page_id, url) asked for, by binary search of the index.

    Requests are sorted by key like the index, so each task reads the directories and blocks of its own range of keys.
    """
    root = shared_root(requests.sparkSession, root)
    ranges = [tuple(r) for r in directory.drop("lines").collect()]  # one row of each task that wrote the index
    asked = requests.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")).distinct()
    keyed = asked.mapInPandas(_keyed, "page_id long, url string, urlkey string")
    order = ["urlkey", F.coalesce("page_id", F.lit(NO_PAGE)), "url"]
    lines = directory.agg(F.coalesce(F.sum("lines"), F.lit(0))).first()[0]
    tasks = max(int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions")), lines // TASK_CAPTURES)
    return keyed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInPandas(_finder(root, ranges), PLACE)


def _record_reader(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = open_fs(root)
        for frame in batches:
            out, places, n = [], list(zip(frame["archive"], frame["offset"].astype(int), frame["length"].astype(int))), 0
            while n < len(places):  # neighbours in one read
                name, begin, size = places[n]
                end, last = begin + size, n + 1
                while last < len(places) and places[last][0] == name and 0 <= places[last][1] - end <= READ_GAP and places[last][1] + places[last][2] - begin <= READ_BYTES:
                    end, last = places[last][1] + places[last][2], last + 1
                data = read_range(fs, f"{base}/{name}", begin, end - begin)
                for _, at, length in places[n:last]:
                    head, payload = parse(data[at - begin : at - begin + length])
                    kind = head["warc-type"]
                    size = len(payload) if kind == "response" else int(head["x-payload-length"])
                    digest = digest_of(payload) if kind == "response" else head["warc-payload-digest"].removeprefix("sha1:")
                    if kind == "response" and f"sha1:{digest}" != head["warc-payload-digest"]:
                        raise ValueError(f"{name} at {at}: the payload doesn't have its digest")
                    number = lambda k: int(head[k]) if head.get(k) else None
                    out.append((number("x-page-id"), head["warc-target-uri"], size, digest, kind, number("x-refers-to-page")))
                n = last
            made = pd.DataFrame(out, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"])
            yield made.astype({"page_id": "Int64", "refers_to": "Int64"})

    return run


def read_records(places: DataFrame, root: str, captures: int) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of the records at ``places``; ``captures`` is about their number.

    Places are brought into archive order, so that neighbouring records come by one range read.
    Digests of responses are computed from what was read. A revisit has no payload: its size and
    digest must be those of the response that it names, or the job fails.
    """
    root = shared_root(places.sparkSession, root)
    # The rows that name places are small and what is read behind them isn't, so the tasks are counted by captures and
    # not left to Spark, which would go by the rows' bytes.
    least = int(places.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = places.repartitionByRange(max(least, captures // TASK_CAPTURES), "archive", "offset").sortWithinPartitions("archive", "offset")
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    read = common.written(sorted_.mapInPandas(_record_reader(root), schema), "records")
    named = read.where("record_type = 'revisit'").select(F.col("refers_to").alias("page_id"), "payload_bytes", "payload_digest").distinct()
    lost = named.join(read.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest").distinct(), ["page_id", "payload_bytes", "payload_digest"], "left_anti")
    if first := lost.first():
        raise ValueError(f"no response of page {first['page_id']} has the payload of its revisits")
    return read


def roundtrip(pages: DataFrame, root: str, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and index under ``root``, look every page up in the index, and read its records back.

    Defined cases: a null html is an empty payload, a null url an empty target; any text is a valid
    url; of rows that repeat the largest page_id of a payload each is a response; rows without a
    page_id are revisits where some row with one has their payload, else responses; rows that repeat
    give a record each; an empty table writes nothing; other columns are ignored. A ``root`` without a
    scheme lies in the store of ``fs.defaultFS``; one that pyarrow can't open is an error at the start.
    """
    captures = write_archives(pages, root, min_bytes)
    directory = write_index(captures, root)
    return read_records(find(pages, root, directory), root, captures.count())
