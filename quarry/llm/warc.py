"""WARC archives of web pages: one gzip member per record, equal payloads stored once.

Writing.  Payloads are told apart by size and SHA-1.  Of the records with equal payloads
the one with the largest page_id is the response; the others become revisit
records, which keep the HTTP headers and name the response's record.  Only page
ids, urls and digests are grouped; the html itself moves only to leave out the copies, by
a join that Spark broadcasts while their keys are few.  Tasks compress each record
to a member of its own and hand runs of members to Spark's text writer, which writes the
bytes as they are under Spark's own commit protocol and rolls the files, so
a lost task or executor leaves no half-written archive behind.

Reading.  An archive is walked from its first byte: ``zlib`` inflates it a block at a
time, the record header ends at the first empty line, Content-Length frames the block,
and the payload passes through SHA-1 while it is read, so a record is never whole
in memory unless its payload is asked for.  A member holds one record and ends where the record
ends.  Digests, framing and members that don't agree raise an error.

The writer puts one zero byte after each run of members.  A run hands over its last
byte to it where that is zero, as in the size field of a member below 16 MiB; beyond that
the zero is padding between members, which readers of gzip skip.

Cases: null html is an empty payload.  A null url has no WARC-Target-URI and reads
back as null; control characters and spaces of a url are percent-encoded in the archive.  A null
page_id is smaller than all others and reads back as null.  Rows with equal page_id and
payload: one is the response, a null url before the smallest, and the rest revisit it.  Equal
rows below ``least_bytes`` are responses of one name.  An empty table gives no records.
Extra columns are dropped.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from quarry.llm.common import prepare, store
from quarry.session import checkpoint_dir

VERSION = b"WARC/1.1"
DATE = "2024-01-01T00:00:00Z"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_ID = "urn:page:"
#: Payloads from so many bytes on are stored once.
LEAST_BYTES = 0
#: Bytes of members handed to the writer at once, and such runs in one file.
RUN_BYTES, RUNS_PER_FILE = 1 << 20, 32
#: Bytes inflated at a time.
BLOCK = 1 << 16


class WarcError(ValueError):
    """An archive that doesn't hold what it says."""


# ------------------------------------------------------------------ records
def sha1_name(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def safe_uri(url: str) -> str:
    return "".join(c if " " < c != "\x7f" else f"%{ord(c):02X}" for c in url)


def record(name: str, url: str | None, size: int, sha1: bytes, payload: bytes, refers_to: str | None = None, date: str = DATE) -> bytes:
    """A WARC record: a response with its payload, or a revisit of the record ``refers_to``."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is None:
        block += payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{name}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", safe_uri(url)))
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", f"<{refers_to}>")]
    fields += [("WARC-Payload-Digest", sha1_name(sha1)), ("WARC-Block-Digest", sha1_name(hashlib.sha1(block).digest())),
               ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode("utf-8", "surrogatepass") + b"\r\n"
    return head + block + b"\r\n\r\n"


def record_name(page_id: Column, sha1: Column, url: Column | None = None, copy: Column | None = None) -> Column:
    """A record's name: page and payload, for a revisit also its url and which copy it is."""
    page = F.coalesce(page_id.cast("string"), F.lit(""))
    parts = [F.lit(RECORD_ID), page, F.lit(":"), sha1]
    if copy is not None:
        parts += [F.lit(":"), F.lower(F.hex(F.xxhash64(url))), F.lit(":"), copy.cast("string")]
    return F.concat(*parts)


def page_of(name: str) -> Column:
    """The page_id in a record's name."""
    number = F.regexp_extract(name, f"^{RECORD_ID}(-?[0-9]+):", 1)
    return F.when(number != "", number).cast("long")


def member(raw: bytes) -> bytes:
    """One gzip member."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


# ------------------------------------------------------------------ sequential reader
class Members:
    """Bytes of gzip members, inflated a block at a time from a stream of chunks."""

    def __init__(self, chunks: Iterable[bytes], block: int = BLOCK):
        self.chunks, self.block = iter(chunks), block
        self.raw, self.offset = b"", 0  # compressed bytes at hand; the place of their first
        self.z, self.plain = None, b""

    def refill(self) -> bool:
        while not self.raw:
            self.raw = next(self.chunks, None)
            if self.raw is None:
                self.raw = b""
                return False
        return True

    def open(self) -> bool:
        """Go to the next member, past zero padding; False at the end."""
        while self.refill():
            rest = self.raw.lstrip(b"\0")
            self.offset += len(self.raw) - len(rest)
            self.raw = rest
            if rest:
                self.z, self.plain, self.at = zlib.decompressobj(31), b"", self.offset
                return True
        return False

    def more(self) -> bool:
        """Inflate some more of this member; False at its end."""
        while not self.z.eof:
            if not self.z.unconsumed_tail and not self.refill():
                raise WarcError(f"member at {self.at} is cut off")
            try:
                got = self.z.decompress(self.z.unconsumed_tail or self.take(), self.block)
            except zlib.error as e:
                raise WarcError(f"member at {self.at}: {e}") from e
            if self.z.eof:
                self.raw = self.z.unused_data + self.raw
                self.offset -= len(self.z.unused_data)
            if got:
                self.plain += got
                return True
        return False

    def take(self) -> bytes:
        some, self.raw = self.raw[:self.block], self.raw[self.block:]
        self.offset += len(some)
        return some

    def read(self, n: int) -> Iterator[bytes]:
        """Exactly ``n`` bytes of this member, in pieces."""
        while n:
            if not self.plain and not self.more():
                raise WarcError(f"member at {self.at} ends {n} bytes early")
            piece, self.plain = self.plain[:n], self.plain[n:]
            n -= len(piece)
            yield piece

    def upto(self, mark: bytes) -> bytes:
        """The bytes up to ``mark``, which is passed over."""
        seen = 0
        while (i := self.plain.find(mark, max(0, seen - len(mark)))) < 0:
            seen = len(self.plain)
            if not self.more():
                raise WarcError(f"member at {self.at} has no end of header")
        head, self.plain = self.plain[:i], self.plain[i + len(mark):]
        return head


def fields_of(lines: list[bytes]) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in lines:
        if line[:1] in (b" ", b"\t") and name:  # a folded line goes on
            out[name] += " " + line.strip().decode("utf-8", "surrogatepass")
            continue
        key, colon, value = line.partition(b":")
        if not colon:
            raise WarcError(f"header line without a colon: {line[:80]!r}")
        name = key.strip().decode("latin-1").lower()
        out[name] = value.strip().decode("utf-8", "surrogatepass")
    return out


class Sum:
    """SHA-1 of bytes that pass through, checked against a header field."""

    def __init__(self, named: str | None):
        self.named, self.sha = named, hashlib.sha1()

    def check(self, what: str, at: int) -> None:
        if self.named and self.named.lower().startswith("sha1:") and sha1_name(self.sha.digest()) != "sha1:" + self.named[5:].upper():
            raise WarcError(f"{what} digest of the record at {at} doesn't agree")


def read_records(chunks: Iterable[bytes], payload: bool = False, block: int = BLOCK) -> Iterator[dict]:
    """The records of one archive, in order."""
    src = Members(chunks, block)
    while src.open():
        head = src.upto(b"\r\n\r\n").split(b"\r\n")
        if not head[0].startswith(b"WARC/"):
            raise WarcError(f"no WARC record at {src.at}")
        h = fields_of(head[1:])
        left = int(h["content-length"])
        kind, http = h.get("warc-type"), h.get("content-type", "").startswith("application/http")
        whole, own, kept, size = Sum(h.get("warc-block-digest")), Sum(h.get("warc-payload-digest")), [], 0
        named, intro, inside = None, b"", not http
        for piece in src.read(left):
            whole.sha.update(piece)
            if not inside:
                intro += piece
                if (i := intro.find(b"\r\n\r\n")) < 0:
                    continue
                named = fields_of(intro[:i].split(b"\r\n")[1:]).get("content-length")
                inside, piece = True, intro[i + 4:]
            size += len(piece)
            own.sha.update(piece)
            if payload:
                kept.append(piece)
        if left and not inside:
            raise WarcError(f"record at {src.at} has no end of HTTP headers")
        whole.check("block", src.at)
        if kind != "revisit":
            own.check("payload", src.at)
            if named is not None and int(named) != size:
                raise WarcError(f"payload of the record at {src.at} has {size} bytes, not {named}")
        if b"".join(src.read(4)) != b"\r\n\r\n" or src.plain or src.more():
            raise WarcError(f"record at {src.at} doesn't end with its member")
        name, refers = h.get("warc-record-id"), h.get("warc-refers-to")
        yield {"offset": src.at, "record_id": name and name.strip("<>"), "record_type": kind, "date": h.get("warc-date"),
               "target_uri": h.get("warc-target-uri"), "refers_to_id": refers and refers.strip("<>"),
               "payload_digest": (h.get("warc-payload-digest") or sha1_name(own.sha.digest())).partition(":")[2].upper(),
               "payload_bytes": int(named) if kind == "revisit" and named is not None else size,
               "payload": b"".join(kept) if payload and kind != "revisit" else None}


# ------------------------------------------------------------------ Spark jobs
def members_in_runs(run_bytes: int = RUN_BYTES):
    """mapInArrow function: record rows -> runs of gzip members, each run without
    the zero byte that the writer puts after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            whole = b"".join(held)
            return pa.RecordBatch.from_arrays([pa.array([whole[:-1] if whole.endswith(b"\0") else whole], pa.binary())], ["run"])

        for batch in batches:
            cols = [batch.column(i) for i in range(batch.num_columns)]
            for i in range(batch.num_rows):
                name, url, n, sha1, html, to = (c[i].as_py() for c in cols)
                payload = (html or "").encode("utf-8", "surrogatepass")
                held.append(member(record(name, url, n, bytes.fromhex(sha1), payload, to)))
                size += len(held[-1])
                if size >= run_bytes:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return run


def plan_records(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """(name, url, size, sha1, html, refers_to): the records to write.  Revisits name a response
    in ``refers_to`` and have no html."""
    raw = F.coalesce(F.col("html"), F.lit(""))
    docs = pages.select("page_id", "url", F.octet_length(raw).cast("long").alias("size"), F.sha1(raw.cast("binary")).alias("sha1"), "html")
    same, row = ["size", "sha1"], ["page_id", "url", "size", "sha1"]
    # equal rows are one with a count, before and while they are shuffled
    rows = store(docs.groupBy(*row).agg(F.count(F.lit(1)).alias("copies")), "page_digests")
    place = F.struct(F.col("page_id").isNull(), F.bitwise_not("page_id"), F.col("url").isNotNull(), "url")
    owners = (rows.filter(F.col("size") >= least_bytes).groupBy(*same)
              .agg(F.min_by(F.struct("page_id", "url"), place).alias("top"), F.sum("copies").alias("n"))
              .filter("n > 1").select(*same, "top"))
    owner = F.col("page_id").eqNullSafe(F.col("top.page_id")) & F.col("url").eqNullSafe(F.col("top.url"))
    twins = store(rows.join(owners, same).select(*row, "copies", F.col("top.page_id").alias("to"), owner.alias("owner")), "page_twins")
    # rows of repeated payloads leave their html behind; each group's response comes back once
    def match(keys: DataFrame):
        return [docs[c].eqNullSafe(keys[c]) for c in row]

    keys, heads = twins.select(*row), twins.filter("owner").select(*row)
    responses = docs.join(keys, match(keys), "left_anti").union(docs.join(heads, match(heads), "left_semi").dropDuplicates(row))
    again = (twins.withColumn("left", F.col("copies") - F.col("owner").cast("int")).filter("left > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left")))))
    return (responses.select(record_name(F.col("page_id"), F.col("sha1")).alias("name"), "url", "size", "sha1", "html",
                             F.lit(None).cast("string").alias("refers_to"))
            .union(again.select(record_name(F.col("page_id"), F.col("sha1"), F.col("url"), F.col("copy")), "url", "size", "sha1",
                                F.lit(None).cast("string"), record_name(F.col("to"), F.col("sha1")))))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES) -> None:
    """Write (page_id, url, html) as gzipped WARC files in the folder ``path``."""
    spark = pages.sparkSession
    prepare(spark)
    runs = plan_records(pages, least_bytes).mapInArrow(members_in_runs(), "run binary")
    # the text writer writes bytes as they are
    runs.select(F.col("run").cast("string").alias("value")).write.option("lineSep", "\0").option("maxRecordsPerFile", RUNS_PER_FILE).text(path)


RECORDS = T.StructType([
    T.StructField("archive", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("record_id", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("date", T.StringType()), T.StructField("target_uri", T.StringType()),
    T.StructField("refers_to_id", T.StringType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload", T.BinaryType())])
ARROW = [pa.string(), pa.int64(), *[pa.string()] * 6, pa.int64(), pa.binary()]
#: Records, and bytes of their payloads, that a reader hands on at once.
OUT_ROWS, OUT_BYTES = 2_000, 8 << 20


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all archives in a folder: archive, offset, record_id, record_type, date,
    target_uri, refers_to_id, payload_digest, payload_bytes and, if asked for, payload."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[list]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW, strict=True)], RECORDS.names)

        for files in batches:
            for i in range(files.num_rows):
                name, content = files.column(0)[i].as_py(), memoryview(files.column(1)[i].as_buffer())
                rows, held = [], 0
                chunks = (bytes(content[at:at + BLOCK]) for at in range(0, len(content), BLOCK))
                for r in read_records(chunks, payload):
                    rows.append([name, *r.values()][:2] + [r[c] for c in RECORDS.names[2:]])
                    held += len(r["payload"] or b"")
                    if len(rows) >= OUT_ROWS or held >= OUT_BYTES:
                        yield batch(rows)
                        rows, held = [], 0
                if rows:
                    yield batch(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, RECORDS)


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages to archives in the shared folder and reads them back: page_id,
    payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm/warc-{uuid.uuid4().hex[:12]}"
    write_archives(pages, path, least_bytes)

    return read_archives(spark, path).select(
        page_of("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of("refers_to_id").alias("refers_to"))


def oracle() -> str:
    """DuckDB twin over ``pages``."""
    def nibble(i: str) -> str:
        return f"(instr('0123456789abcdef', h[{i}]) - 1)"

    # 8 hex digits are not a whole number of base-32 letters, 5 of them (20 bits) are four
    twenty = " + ".join(f"{nibble(f'5 * k + {j + 1}')} * {16 ** (4 - j)}" for j in range(5))
    letters = " || ".join(f"'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(x // {32 ** (3 - j)}) % 32 + 1]" for j in range(4))
    return f"""
WITH a AS (SELECT page_id, url, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT page_id, CAST(strlen(t) AS BIGINT) AS payload_bytes,
        list_aggregate(list_transform(list_transform(range(0, 8), lambda k: {twenty}), lambda x: {letters}), 'string_agg', '') AS payload_digest,
        row_number() OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS place,
        first_value(page_id) OVER (PARTITION BY t ORDER BY page_id DESC NULLS LAST, url NULLS FIRST) AS top FROM a)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN place = 1 THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN place > 1 THEN top END AS refers_to
FROM b"""
