"""WARC (9): writing archives, and a sequential reader.

Each record is a gzip member of its own: WARC/1.1 headers, a block of Content-Length bytes, two line ends. A response's
block is an HTTP head and the payload, a revisit's the head alone. Equal payloads are stored once; the others are
revisits that name the stored record. Spark's text sink writes the
members, so any file system that Spark reaches will do: the sink ends each row with a separator, and a member's
last byte (the high byte of the size in its trailer) is that separator. Records are therefore written in classes
by that byte: zero for all records below 16 MiB.

Files are bounded by bytes: records are also classed by payload size, and a class's files have as many records as
FILE_BYTES of its largest allow. The reader takes one file at a time and inflates it in steps: a member after the other,
headers first, then as many bytes as Content-Length says, and checks the digests. It never holds more than a record
besides the file's compressed bytes.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .storage import ROW, new_path, numbered, small, stored
from .text_batches import pieces

#: Bytes of payload in a file at most (a longer one is alone in its file), records of a file at most, payload size of the smallest
#: class and how many times larger each next one is.
FILE_BYTES, FILE_RECORDS, CLASS_BYTES, CLASS_STEP = 64 << 20, 10_000, 4096, 4
#: Payloads from which equal ones become revisits, and copies of one payload from which its first record is broadcast to them.
REVISIT_FROM, HOT = 100, 1000
#: Fixed values of the format.
VERSION, END, PROFILE = b"WARC/1.1\r\n", b"\r\n\r\n", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
STEP = 1 << 16


class DigestError(ValueError):
    """A record's bytes are not what its headers say."""


def record_id(page_id: int | None, row: int) -> str:
    """A record's name: its page and the number of its row, as pages may repeat or have no id."""
    return f"<urn:civicmesh:page:{'' if page_id is None else page_id}:{row}>"


def page_of(name: str) -> int | None:
    page_id = name.split(":")[3]
    return int(page_id) if page_id else None


def http_head(n: int) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n


def record(name: str, url: str | None, payload: bytes, digest: str, refers_to: str | None) -> bytes:
    """The bytes of a record before compression."""
    revisit = refers_to is not None
    block = http_head(len(payload)) + (b"" if revisit else payload)
    url = "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "urn:none")
    headers = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": name, "WARC-Date": "2024-01-01T00:00:00Z", "WARC-Target-URI": url,
        "WARC-Payload-Digest": f"sha256:{digest}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block)),
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": refers_to}
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in headers.items()).encode() + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    """One gzip member without a time stamp, so that equal records have equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class Inflater:
    """Bytes of one gzip member after the other, on demand."""

    def __init__(self, data: bytes | memoryview):
        self.data, self.at, self.held = memoryview(data), 0, b""
        self.z = None

    def next_member(self) -> bool:
        if self.z is not None:
            while not self.z.eof:
                if not self._more():
                    raise DigestError("a gzip member is cut off")
            if self.held:
                raise DigestError("a record is longer than its headers say")
        if self.at >= len(self.data):
            return False
        self.z = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        """Another step of the member's bytes; False where the file has no more."""
        if self.z.eof:
            return False
        step = self.z.unconsumed_tail or self.data[self.at : self.at + STEP]
        fresh = not self.z.unconsumed_tail
        if not len(step):
            return False
        self.held += self.z.decompress(step, STEP * 16)
        if fresh:
            self.at += len(step)
        if self.z.eof:
            self.at -= len(self.z.unused_data)
        return True

    def until(self, mark: bytes) -> bytes:
        while (i := self.held.find(mark)) < 0:
            if not self._more():
                raise DigestError("a record has no end of headers")
        out, self.held = self.held[:i], self.held[i + len(mark) :]
        return out

    def exactly(self, n: int) -> bytes:
        parts, size = [self.held], len(self.held)
        while size < n:
            self.held = b""
            if not self._more():
                raise DigestError("a record is shorter than its headers say")
            parts.append(self.held)
            size += len(self.held)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]


def read_records(data: bytes | memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names lower-cased) and block of each record of a file, in order; DigestError if it is damaged."""
    source = Inflater(data)
    while source.next_member():
        lines = source.until(END).split(b"\r\n")
        if not lines[0].startswith(b"WARC/"):
            raise DigestError("a member does not begin with a WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("utf-8", "replace").partition(":") for x in lines[1:])}
        block = source.exactly(int(headers["content-length"]))
        if source.exactly(4) != END:
            raise DigestError("a record does not end with two line ends")
        if (said := headers.get("warc-block-digest")) and said != f"sha256:{hashlib.sha256(block).hexdigest()}":
            raise DigestError(f"wrong block digest in {headers.get('warc-record-id')}")
        yield headers, block


def _digest(html: Column) -> Column:
    return F.sha2(F.encode(html, "UTF-8"), 256)


def size_class(n: Column) -> Column:
    """The number of the size class of a payload: CLASS_STEP ** number times CLASS_BYTES is its most."""
    return F.ceil(F.log(F.greatest(n / CLASS_BYTES, F.lit(1.0))) / F.log(F.lit(float(CLASS_STEP))) - 1e-12).cast("int")


def _with_first(rows: DataFrame) -> DataFrame:
    """The rows with ``first`` and ``first_row``, page and row of the stored record, where they are revisits."""
    order = F.struct("page_id", ROW)
    known = rows.where((F.col("bytes") >= REVISIT_FROM) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.min(order).alias("f"))
    copies = rows.where(F.col("bytes") >= REVISIT_FROM).groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    twice = copies.join(known, "digest").select(F.unhex("digest").alias("__digest"), "n", F.col("f.page_id").alias("first"), F.col(f"f.{ROW}").alias("first_row"))
    twice = stored(twice, "warc-copies")
    hot = F.broadcast(twice.where(F.col("n") > HOT).select(F.col("__digest").alias("__hot"), F.col("first").alias("f1"), F.col("first_row").alias("r1")))  # a row for each HOT pages at most
    rest = small(stored(twice.where(F.col("n") <= HOT).select(F.col("__digest").alias("__rest"), F.col("first").alias("f2"), F.col("first_row").alias("r2")), "warc-rare-copies"))
    out = rows.join(hot, F.unhex("digest") == F.col("__hot"), "left")
    # rows that are served already meet the other join under keys of their own, spread over all its tasks
    key = F.when(F.col("__hot").isNull(), F.unhex("digest")).otherwise(F.col(ROW).cast("string").cast("binary"))
    out = out.join(rest, key == F.col("__rest"), "left").withColumns({"first": F.coalesce("f1", "f2"), "first_row": F.coalesce("r1", "r2")})
    revisits = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return out.select(*rows.columns, F.when(revisits, F.col("first")).alias("first"), F.when(revisits, F.col("first_row")).alias("first_row"))


def write(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> list[str]:
    """Archives below ``path`` with a record for each row of ``pages``; gives their folders.

    Null html is an empty payload and null urls are written as ``urn:none``. Of equal payloads of REVISIT_FROM bytes or more the one with
    the smallest page_id is stored; rows that repeat that page are stored each, under names of their own. Rows with null page_id are
    records without a page, and revisits only of a page that has an id."""
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.col(f"`{url}`").alias("url"), F.coalesce(F.col(f"`{html}`"), F.lit("")).alias("html"))
    rows = numbered(rows.withColumns({"bytes": F.octet_length("html"), "digest": _digest(F.col("html"))}), "warc-pages")
    keyed = _with_first(rows).withColumns({"class": size_class(F.col("bytes")), "html": F.encode("html", "UTF-8")})
    keyed = keyed.select("class", "page_id", ROW, "url", "digest", "first", "first_row", "html")

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, 7):
                out, kinds = [], []
                for _, page, row, link, digest, first, first_row, payload in zip(*(c.to_pylist() for c in piece.columns), strict=True):
                    refers_to = None if first is None else record_id(first, first_row)
                    data = member(record(record_id(page, row), link, payload, digest, refers_to))
                    kinds.append(data[-1])
                    out.append(data[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(out, pa.binary())], names=["kind", "member"])

    folders = []
    for r in rows.groupBy(size_class(F.col("bytes")).alias("class")).agg(F.max("bytes").alias("longest")).orderBy("class").collect():  # a few classes
        part = keyed.where(F.col("class") == r["class"]).mapInArrow(members, "kind int, member binary")
        most = CLASS_BYTES * CLASS_STEP ** r["class"]
        kinds = [0]
        if (r["longest"] + 4096) >> 24:
            part = stored(part, "warc-members")
            kinds = sorted(x["kind"] for x in part.select("kind").distinct().collect())  # 128 at most
        for kind in kinds:
            folders.append(f"{path}/class-{r['class']}-{kind}")
            of = part.where(F.col("kind") == kind) if len(kinds) > 1 else part
            sink = of.select(F.col("member").cast("string").alias("value")).write.option("lineSep", chr(kind))
            sink.option("maxRecordsPerFile", max(1, min(FILE_RECORDS, FILE_BYTES // most))).text(folders[-1])
    return folders


RECORD = T.StructType(
    [
        T.StructField("page_id", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
        T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()), T.StructField("payload", T.BinaryType()),
    ]
)


def payload_of(block: bytes) -> tuple[int, bytes]:
    """The payload's length as the HTTP head of a block says, and what follows the head."""
    head, mark, body = block.partition(END)
    lengths = [int(x.partition(b":")[2]) for x in head.split(b"\r\n")[1:] if x.lower().startswith(b"content-length:")]
    if not mark or len(lengths) != 1:
        raise DigestError("a block does not begin with an HTTP head")
    return lengths[0], body


def row_of(headers: dict[str, str], block: bytes) -> tuple:
    """RECORD's values of a record; digests are of the payload as read for responses and as named for revisits."""
    name, named = headers["warc-record-id"], headers["warc-payload-digest"].removeprefix("sha256:")
    size, body = payload_of(block)
    if headers["warc-type"] == "revisit":
        return page_of(name), size, named, "revisit", page_of(headers["warc-refers-to"]), b""
    if len(body) != size or hashlib.sha256(body).hexdigest() != named:
        raise DigestError(f"wrong payload digest in {name}")
    return page_of(name), size, named, "response", None, body


def read(spark, folders: list[str], payloads: bool = True) -> DataFrame:
    """The records of all files in ``folders``, in no order."""
    if not folders:
        return spark.createDataFrame([], RECORD if payloads else T.StructType(RECORD.fields[:-1]))
    files = spark.read.format("binaryFile").load(folders).select("content")
    schema = RECORD if payloads else T.StructType(RECORD.fields[:-1])
    arrow = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())] + [("payload", pa.binary())] * payloads)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(arrow)], schema=arrow)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for headers, block in read_records(memoryview(content.as_buffer())):
                    rows.append(row_of(headers, block))
                    size += len(block) if payloads else 0
                    if size > STEP * 64 or len(rows) >= 10_000:
                        yield made(rows)
                        rows, size = [], 0
                if rows:
                    yield made(rows)

    return files.mapInArrow(records, schema)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", payloads: bool = False) -> DataFrame:
    """``pages`` written as WARC files below the shared folder and read back."""
    spark = pages.sparkSession
    return read(spark, write(pages, new_path(spark, "warc"), page_id, url, html), payloads)
