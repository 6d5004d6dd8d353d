"""WARC archives with a two-level capture index.

`write` puts a record per page into gzip members of WARC files, one file per task, in a folder that all machines share.
A page whose payload, of MIN_REVISIT bytes or more, equals that of a page with a larger page_id becomes a revisit of the
largest one; the decision is made on digests alone, before any payload moves. Records of a file stand in the order of
its page ids.

`build_index` sorts one entry per record by its key, the reversed host and path followed by the page id, over range
partitions; each partition is an index file of compressed blocks of BLOCK entries, and the directory keeps one line per
block: its first key and where it lies. `lookup` finds the index file by binary search over the files' first keys (their
number follows the number of records), the block by binary search in that file's directory, reads that block's range,
searches it, and then reads the record's range of the WARC file. Keys are sorted before they are looked up, so that a task
needs the directories of few files, and records are fetched by as many tasks as their bytes ask for.

Lines of the index end with a line feed and its fields are parted by tabs; a url's control characters, spaces and percent
signs that stand for nothing are percent-encoded in keys and headers, so no url can break a line.

A task that is run again writes files of its own; only those that its last, successful run reported are referred to, so
lost executors leave unused files, never wrong results.

Defined results: null html is an empty payload; a null url has an empty key; urls that can't be
cut into host and path are keys as they are; records of equal payloads below
MIN_REVISIT bytes are all responses; rows that repeat a page_id with the same payload share that id, the first by place is
the response if it is the largest, and each is found again; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged

MIN_REVISIT = 1000
BLOCK = 256
#: Records of an index file, about; a lookup holds the first key of every file in memory.
FILE_RECORDS = 1 << 18
#: Bytes of records that one task fetches, about.
FETCH_BYTES = 16 << 20
#: Ranges of one file that lie closer than this are read at once.
GAP = 1 << 16
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


_CONTROL = re.compile("[\x00-\x20\x7f-\xa0\u2028\u2029]")


def plain_url(url: str | None) -> str:
    """The url without white space around it and with its control characters and spaces percent-encoded."""
    return _CONTROL.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode("utf-8", "replace")), (url or "").strip())


def surt(url: str | None) -> str:
    """Reversed host, port and path with query, such as org,example,www)/a?b; a url that can't be cut as it is."""
    url = plain_url(url)
    if not url:
        return ""
    try:
        parts = urlsplit(url)
        host, port = (parts.hostname or "").removeprefix("www."), parts.port
    except ValueError:
        return url.lower()
    rest = (parts.path or "/") + (f"?{parts.query}" if parts.query else "")
    return f"{','.join(reversed(host.split('.')))}{f':{port}' if port else ''}){rest}".lower()


def entry_key(url: str | None, page_id: str | None) -> str:
    """Sorts by key, then by page id as a number."""
    n = int(page_id) if page_id is not None else -1
    return f"{surt(url)} {n + (1 << 63):020d}"


class Files:
    """Files of the shared folder, by whatever file system its address names."""

    def __init__(self, base: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(base)
        self.base = base

    def make(self) -> None:
        self.fs.create_dir(self.root, recursive=True)

    def write(self, name: str):
        return self.fs.open_output_stream(f"{self.root}/{name}", compression=None)

    def ranges(self, name: str, wanted: list[tuple[int, int]]) -> Iterator[bytes]:
        """The bytes of each (offset, length); wanted in ascending order."""
        with self.fs.open_input_file(f"{self.root}/{name}") as f:
            i = 0
            while i < len(wanted):
                j, end = i + 1, sum(wanted[i])
                while j < len(wanted) and wanted[j][0] - end <= GAP and sum(wanted[j]) - wanted[i][0] <= 64 * GAP:
                    end, j = max(end, sum(wanted[j])), j + 1
                f.seek(wanted[i][0])
                data = f.read(end - wanted[i][0])
                for lo, n in wanted[i:j]:
                    yield data[lo - wanted[i][0] : lo - wanted[i][0] + n]
                i = j


def record(page_id: str | None, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """One WARC record as a gzip member."""
    uri = plain_url(url)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {uri}')}>",
        f"WARC-Target-URI: {uri}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"Page-ID: {'' if page_id is None else page_id}", f"Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"Refers-To-Page-ID: {refers_to}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + (payload if refers_to is None else b"")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return gzip.compress("\r\n".join(head).encode("utf-8", "replace") + block + b"\r\n\r\n", LEVEL, mtime=0)


def parsed(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a record."""
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def decisions(pages: DataFrame) -> DataFrame:
    """page_id, digest, refers_to of the pages that revisit another."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    long = pages.select("page_id", payload.alias("p")).where(F.length("p") >= MIN_REVISIT).select("page_id", F.sha1("p").alias("digest"))
    long = staged(long, "warc-digests")
    largest = long.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return long.join(largest, "digest").where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()


def write(pages: DataFrame, path: str) -> DataFrame:
    """Writes the archives into path; a row per record: page_id, url, file, offset, length. Evaluate it once."""
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    rows = rows.join(staged(decisions(pages), "warc-revisits"), ["page_id", "digest"], "left")
    rows = rows.select(F.col("page_id").cast("string").alias("page_id"), "url", "payload", "digest", F.col("refers_to").cast("string").alias("refers_to"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, name, at, out = Files(path), f"pages-{uuid.uuid4().hex}.warc.gz", 0, None
        try:
            for pdf in batches:
                if out is None:
                    files.make()
                    out = files.write(name)
                places = []
                for r in pdf.itertuples(index=False):
                    none = lambda x: x if isinstance(x, str) else None
                    data = record(none(r.page_id), none(r.url), bytes(r.payload), r.digest, none(r.refers_to))
                    out.write(data)
                    places.append((at, len(data)))
                    at += len(data)
                yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "file": name, "offset": [x for x, _ in places], "length": [x for _, x in places]})
        finally:
            if out is not None:
                out.close()

    return rows.mapInPandas(run, "page_id string, url string, file string, offset long, length long")


def _key_column(url="url", page_id="page_id"):
    @F.pandas_udf("string")
    def key(u: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series([entry_key(a if isinstance(a, str) else None, b if isinstance(b, str) else None) for a, b in zip(u, p, strict=True)], dtype=object)

    return key(F.col(url), F.col(page_id))


def build_index(records: DataFrame, path: str, files: int, block: int = BLOCK) -> DataFrame:
    """Writes the index files into path; a row per index file: file, first (key), directory_at, directory_length."""
    entries = records.withColumn("key", _key_column())
    entries = entries.repartitionByRange(files, "key").sortWithinPartitions("key", "file", "offset")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        name, at, lines, directory, out, store = f"index-{uuid.uuid4().hex}.gz", 0, [], [], None, Files(path)

        def flush() -> None:
            nonlocal at, lines, out
            if not lines:
                return
            if out is None:
                store.make()
                out = store.write(name)
            data = zlib.compress("\n".join(lines).encode(), 6)
            out.write(data)
            directory.append((lines[0].split("\t", 1)[0], at, len(data)))
            at, lines = at + len(data), []

        for pdf in batches:
            for r in pdf.itertuples(index=False):
                lines.append(f"{r.key}\t{r.file}\t{r.offset}\t{r.length}")
                if len(lines) >= block:
                    flush()
        flush()
        if out is not None:
            data = zlib.compress("\n".join(f"{k}\t{a}\t{n}" for k, a, n in directory).encode(), 6)
            out.write(data)
            out.close()
            yield pd.DataFrame({"file": [name], "first": [directory[0][0]], "directory_at": [at], "directory_length": [len(data)]})

    return entries.mapInPandas(run, "file string, first string, directory_at long, directory_length long")


class Directory:
    """The sparse directories of the index files, each read when a key falls into its file, few of them held at a time."""

    def __init__(self, path: str, catalog: list[tuple[str, str, int, int]]):
        self.files, self.catalog = Files(path), sorted((first, name, at, n) for name, first, at, n in catalog)
        self.firsts, self.read = [x[0] for x in self.catalog], {}

    def _directory(self, k: int) -> tuple[list[str], list[tuple[int, int]]]:
        _, name, at, n = self.catalog[k]
        if name not in self.read:
            if len(self.read) >= 8:  # keys come sorted: the oldest is done with
                self.read.pop(next(iter(self.read)))
            lines = [x.split("\t") for x in zlib.decompress(next(self.files.ranges(name, [(at, n)]))).decode().split("\n")]
            self.read[name] = ([x[0] for x in lines], [(int(x[1]), int(x[2])) for x in lines])
        return self.read[name]

    def blocks(self, key: str) -> list[tuple[str, int, int]]:
        """The blocks that may hold key: file, offset, length. More than one only if key begins a block or file."""
        out = []
        k = bisect.bisect_right(self.firsts, key) - 1
        while k >= 0:
            keys, places = self._directory(k)
            name = self.catalog[k][1]
            i = bisect.bisect_right(keys, key) - 1
            while i >= 0:
                out.append((name, *places[i]))
                if keys[i] < key:
                    return out
                i -= 1
            k -= 1
        return out


def lookup(queries: DataFrame, path: str, index_path: str, catalog: list[tuple[str, str, int, int]]) -> DataFrame:
    """The records of queries (page_id string, url): page_id, payload_bytes, payload_digest, record_type, refers_to. A
    response's length and digest are those of the payload that was read."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        directory = Directory(index_path, catalog)
        for pdf in batches:
            rows = [(key, *b) for key in pdf["key"] for b in directory.blocks(key)]
            yield pd.DataFrame(rows, columns=["key", "file", "offset", "length"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Sorted by block: each is read once."""
        store, held, keys, rows = Files(index_path), None, [], []
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                if held != (r.file, r.offset):
                    held = (r.file, r.offset)
                    text = zlib.decompress(next(store.ranges(r.file, [(r.offset, r.length)]))).decode()
                    rows = [x.split("\t") for x in text.split("\n")]
                    keys = [x[0] for x in rows]
                for i in range(bisect.bisect_left(keys, r.key), bisect.bisect_right(keys, r.key)):
                    out.append((rows[i][1], int(rows[i][2]), int(rows[i][3])))
            yield pd.DataFrame(out, columns=["file", "offset", "length"])

    def fetch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Files(path)
        for pdf in batches:
            for name, group in pdf.groupby("file", sort=False):
                wanted, out = sorted(zip(group["offset"], group["length"], strict=True)), []
                for data in store.ranges(name, wanted):
                    fields, payload = parsed(data)
                    refers = fields.get("Refers-To-Page-ID")
                    page = fields["Page-ID"] or None
                    if refers is None:
                        out.append((page, len(payload), hashlib.sha1(payload).hexdigest(), "response", None))
                    else:
                        out.append((page, int(fields["Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:"), "revisit", refers))
                yield pd.DataFrame(out, columns=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    place = "file string, offset long, length long"
    keys = queries.select(_key_column().alias("key")).distinct()
    parts = max(1, -(-len(catalog) // 4))
    blocks = keys.repartitionByRange(max(parts, 8), "key").sortWithinPartitions("key").mapInPandas(find, f"key string, {place}")
    blocks = staged(blocks, "warc-blocks")
    # a block is searched for all its keys at once, and no file's blocks meet in one task
    entries = blocks.repartition("file", "offset").sortWithinPartitions("file", "offset").mapInPandas(search, place)
    entries = staged(entries, "warc-entries")
    tasks = max(1, (entries.agg(F.sum("length")).first()[0] or 0) // FETCH_BYTES)
    # neighbours in a file are read together
    near = entries.repartition(max(tasks, 8), "file", F.expr(f"offset div {64 * GAP}")).sortWithinPartitions("file", "offset")
    found = near.mapInPandas(fetch, "page_id string, payload_bytes long, payload_digest string, record_type string, refers_to string")
    return found.withColumns({"page_id": F.col("page_id").cast("long"), "refers_to": F.col("refers_to").cast("long")})


def archived(pages: DataFrame) -> DataFrame:
    """Writes the archives and their index, then reads every page's record back through the index."""
    spark = pages.sparkSession
    path, index_path = new_path(spark, "warc"), new_path(spark, "warc-index")
    records = staged(write(pages, path), "warc-records")
    files = max(8, -(-records.count() // FILE_RECORDS))
    catalog = staged(build_index(records, index_path, files), "warc-catalog").collect()  # a row per index file
    return lookup(pages.select(F.col("page_id").cast("string").alias("page_id"), "url"), path, index_path, [tuple(r) for r in catalog])


#: The same rows in DuckDB.
ORACLE = f"""
WITH paid AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
largest AS (SELECT h, max(page_id) AS top FROM paid WHERE n >= {MIN_REVISIT} GROUP BY h)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(p.h) AS payload_digest, CASE WHEN top > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top > page_id THEN top END AS refers_to
FROM paid p LEFT JOIN largest l ON p.h = l.h AND p.n >= {MIN_REVISIT}
"""
