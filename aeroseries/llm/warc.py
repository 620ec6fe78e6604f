"""WARC archives with a two-level capture index.

*Writing.* Each task writes the pages of its partition as records, one gzip member each, into files of its own under a shared
folder; file names hold the task attempt, so an attempt that fails leaves no file that the index names. Of equal payloads one
page is written in full and the others as revisits.

*Index.* Captures are sorted by a key with the host's labels reversed and cut into blocks of ``BLOCK_LINES`` compressed lines.
The directory has the first and the last key of every block. A lookup searches the directory for the block or blocks of a key,
brings keys and blocks together, searches the lines, and reads the byte range of each record found.

Payloads are shuffled at most once, by digest, to learn which are repeated; Spark splits digests that hold many rows. The
directory is a thousandth of the captures. It is broadcast in pieces of at most ``MAX_DIRECTORY`` blocks, one search of the
keys for each piece. Keys of one block meet in shares of ``KEYS_AT_ONCE`` about, each with a copy of the block.

Defined cases: a null page is empty; payloads below ``LEAST_REVISIT`` bytes are always written in full; a null id counts as
larger than all others; rows that share the smallest id of a payload are all written in full; percent signs and line breaks
are escaped in keys, before they are sorted; a null URL is empty; an empty table gives no files and an empty index; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroseries.functions.lineage import checkpoint_dir, cut_lineage
from aeroseries.llm.url_filters import host_of
from aeroseries.llm.words import utf8

#: Payloads from this size on are written once.
LEAST_REVISIT = 100
FILE_BYTES = 256 << 20
BLOCK_LINES = 1_000
MAX_DIRECTORY = 1_000_000
KEYS_AT_ONCE = 20_000
#: Fixed date of records: the tables do not say when a page was fetched.
DATE = "1970-01-01T00:00:00Z"

_CAPTURE = "key string, page_id bigint, file string, offset bigint, length bigint"
_BLOCK = "first_key string, last_key string, lines bigint, block binary"
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def url_key(url: Column) -> Column:
    """Host with its labels reversed, then the rest of the URL, without the scheme; on one line."""
    host = host_of(url)
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)://[^/?#]*(.*)\z", 1)
    key = F.concat(F.array_join(F.reverse(F.split(host, "\\.")), ","), F.lit(")"), rest)
    return F.replace(F.replace(key, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def _filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file:///"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def _page_urn(page_id: int | None, place: str = "") -> str:
    return f"<urn:page:{'none-' + place if page_id is None else page_id}>"


def record(page_id: int | None, url: str, payload: bytes, digest: str, first: int | None, place: str) -> bytes:
    """A record as one gzip member; a revisit of the page ``first`` if that is given."""
    address = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url)
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}", f"WARC-Record-ID: {_page_urn(page_id, place)}",
        f"WARC-Date: {DATE}", f"WARC-Target-URI: {address}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    # The length of the full payload stands in the stored header of either kind.
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        head += [f"WARC-Refers-To: {_page_urn(first)}"]
    block = http + (payload if first is None else b"")
    head.append(f"Content-Length: {len(block)}")
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """Record headers, HTTP headers (both with lower-case names) and payload of one gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    fields = _fields(head)
    http, _, payload = rest[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, _fields(http), payload


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {name.lower(): value for name, _, value in pairs}


def _page_of(urn: str) -> int | None:
    name = urn[len("<urn:page:") : -1]
    return None if name.startswith("none-") else int(name)


def _with_first(pages: DataFrame, page_id: str, url: str, page: str) -> DataFrame:
    """Pages with their digest, and for revisits the page that holds the payload."""
    body = F.coalesce(F.col(page).cast("string"), F.lit(""))
    named = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("html"),
        F.sha2(body, 256).alias("digest"),
    )
    large = named.filter(F.octet_length("html") >= LEAST_REVISIT)
    several = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    joined = named.join(several.select("digest", "first"), "digest", "left")
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "html", "digest", F.when(revisits, F.col("first")).alias("first"))


def write_archives(
    pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url", page: str = "html"
) -> DataFrame:
    """Write all pages below ``folder`` and return the captures (key, page_id, file, offset, length), computed once."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = _filesystem(folder)
        system.create_dir(base, recursive=True)
        stem, n_files, out, offset, n_records = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0, 0
        for batch in batches:
            ids, keys, urls, digests, firsts = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            places = []
            for i, payload in enumerate(utf8(batch.column(3))):
                if out is None or offset > FILE_BYTES:
                    if out is not None:
                        out.close()
                    name, offset, n_files = f"{stem}-{n_files:04d}.warc.gz", 0, n_files + 1
                    out = system.open_output_stream(f"{base}/{name}", compression=None)
                member = record(ids[i], urls[i] or "", payload, digests[i], firsts[i], f"{stem}-{n_records}")
                out.write(member)
                places.append((keys[i], ids[i], name, offset, len(member)))
                offset += len(member)
                n_records += 1
            if places:
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
                arrays = [pa.array(column, kind) for column, kind in zip(zip(*places), kinds)]
                yield pa.RecordBatch.from_arrays(arrays, names=["key", "page_id", "file", "offset", "length"])
        if out is not None:
            out.close()

    named = _with_first(pages, page_id, url, page)
    asked = named.select("page_id", url_key(F.col("url")).alias("key"), "url", "html", "digest", "first")
    return cut_lineage(asked.mapInArrow(write, _CAPTURE))


def build_index(captures: DataFrame) -> DataFrame:
    """Sorted blocks (first_key, last_key, lines, block), computed once."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for batch in batches:
            held += zip(*(column.to_pylist() for column in batch.columns))
            while len(held) >= BLOCK_LINES:
                yield packed(held[:BLOCK_LINES])
                held = held[BLOCK_LINES:]
        if held:
            yield packed(held)

    def packed(captures: list[tuple]) -> pa.RecordBatch:
        # The key comes last in a line, since it may hold blanks.
        lines = [f"{'-' if i is None else i} {f} {o} {n} {key}" for key, i, f, o, n in captures]
        block = zlib.compress("\n".join(lines).encode())
        keys = [key for key, *_ in captures]
        row = {"first_key": [keys[0]], "last_key": [keys[-1]], "lines": [len(lines)], "block": [block]}
        return pa.RecordBatch.from_pydict(row)

    ordered = captures.repartitionByRange("key", "page_id", "file", "offset")
    return cut_lineage(ordered.sortWithinPartitions("key", "page_id", "file", "offset").mapInArrow(blocks, _BLOCK))


def lines_of(block: bytes) -> list[tuple[str, int | None, str, int, int]]:
    """The captures of a block: (key, page_id, file, offset, length)."""
    out = []
    for line in zlib.decompress(block).decode().split("\n"):
        page_id, file, offset, length, key = line.split(" ", 4)
        out.append((key, None if page_id == "-" else int(page_id), file, int(offset), int(length)))
    return out


class RangeReader:
    """Byte ranges of the files below a folder; the last file used stays open."""

    def __init__(self, folder: str) -> None:
        self.system, self.base = _filesystem(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.file is not None:
                self.file.close()
            self.name, self.file = name, self.system.open_input_file(f"{self.base}/{name}")
        return self.file.read_at(length, offset)


def _described(member: bytes) -> tuple:
    fields, http, payload = parse(member)
    first = fields.get("warc-refers-to")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    if first is None and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"the payload of {fields['warc-record-id']} does not match its digest")
    return (
        _page_of(fields["warc-record-id"]), int(http["content-length"]), digest, fields["warc-type"],
        None if first is None else _page_of(first),
    )


def _record_batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [part.split()[0] for part in _RECORD.split(", ")]
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    columns = list(zip(*rows)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def read_all(index: DataFrame, folder: str) -> DataFrame:
    """Every record of the archives, by the ranges that the index names."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            for block in batch.column(0).to_pylist():
                ranges = sorted(line[2:] for line in lines_of(block))
                yield _record_batch([_described(reader.read(*place)) for place in ranges])

    return index.select("block").mapInArrow(read, _RECORD)


def lookup(index: DataFrame, folder: str, urls: DataFrame, *, url: str = "url") -> DataFrame:
    """The records captured for each URL, as rows (key, page_id, payload_bytes, ...): directory, block, range read."""
    numbered = cut_lineage(index.withColumn("number", F.monotonically_increasing_id()))
    wanted = urls.select(url_key(F.col(url).cast("string")).alias("key")).distinct()
    found = cut_lineage(_search_directory(numbered.drop("lines", "block"), wanted))
    # A block that many keys ask for is read in several shares of them.
    shares = found.groupBy("number").agg(F.ceil(F.count("*") / KEYS_AT_ONCE).cast("int").alias("shares"))
    asked = found.join(shares, "number")
    asked = asked.select("number", F.pmod(F.xxhash64("key"), F.col("shares")).cast("int").alias("share"), "key")
    blocks = numbered.join(shares, "number")
    blocks = blocks.select("number", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "block")

    def read(rows: pa.Table) -> pa.Table:
        reader = RangeReader(folder)
        lines = lines_of(rows["block"].drop_null()[0].as_py())
        names = [line[0] for line in lines]
        keys = rows["key"].drop_null().to_pylist()
        hits = [line for key in keys for line in lines[bisect_left(names, key) : bisect_right(names, key)]]
        # In the order of the files, whatever that of the keys.
        hits.sort(key=lambda line: line[2:])
        body = _record_batch([_described(reader.read(*line[2:])) for line in hits])
        return pa.Table.from_arrays([pa.array([line[0] for line in hits], pa.string()), *body.columns], names=["key", *body.schema.names])

    met = asked.unionByName(blocks, allowMissingColumns=True).groupBy("number", "share")
    return met.applyInArrow(read, f"key string, {_RECORD}")


def _search_directory(directory: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rows (key, number): the blocks whose range holds the key, by binary search in each piece of the directory."""
    n_blocks = directory.count()
    n_parts = max(1, -(-n_blocks // MAX_DIRECTORY))
    found = []
    for part in range(n_parts):
        own = directory.filter(F.pmod(F.xxhash64("number"), F.lit(n_parts)) == part)
        entries = sorted((r["first_key"], r["last_key"], r["number"]) for r in own.collect())
        found.append(_search(wanted, entries))
    return reduce(DataFrame.union, found)


def _search(wanted: DataFrame, entries: list[tuple[str, str, int]]) -> DataFrame:
    shared = wanted.sparkSession.sparkContext.broadcast(entries)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [entry[0] for entry in shared.value]
        for batch in batches:
            keys, numbers = [], []
            for key in batch.column(0).to_pylist():
                # Blocks in which one key goes on lie side by side.
                at = bisect_right(firsts, key) - 1
                while at >= 0 and shared.value[at][1] >= key:
                    keys.append(key)
                    numbers.append(shared.value[at][2])
                    at -= 1
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(numbers, pa.int64())], names=["key", "number"])

    return wanted.mapInArrow(search, "key string, number bigint")


def archive_folder(spark: SparkSession) -> str:
    """A new folder for archives in the shared checkpoint folder."""
    return f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
