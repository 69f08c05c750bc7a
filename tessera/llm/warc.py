"""WARC archives: whole-file gzip in, one gzip member per record and a sidecar offset index out."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.files import new_file, opened, shared_folder
from tessera.llm.registry import query, table
from tessera.session import materialize

RECORD_END = b"\r\n\r\n"
#: Bytes of archives that one task reads back, about.
READ_BYTES = 8 << 20
#: Payloads of fewer bytes are never written as revisits.
MIN_REVISIT_BYTES = 0
#: Bytes inflated at a time.
STEP = 1 << 20
INDEX = "path string, offset long, length long, record_id string, record_type string"


def base32(digest_hex: Column) -> Column:
    """Upper-case base32 of a 40-digit hex string, eight characters for each ten digits."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(digest_hex, 1 + 10 * g, 10), 16, 10).cast("long") for g in range(4)]
    return F.concat(*[
        F.substring(alphabet, (F.shiftright(g, 35 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
        for g in groups for k in range(8)])


def page_records(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """``(page_id, url, payload, digest, refers_to)``: ``refers_to`` is the largest ``page_id`` of an equal payload,
    null for that page itself, for shorter payloads and for pages without id. A null html is an empty payload."""
    read = pages.select(F.col("page_id").cast("long"), "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn(
        "digest", base32(F.sha1(F.col("payload").cast("binary"))))
    last = (
        read.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1 and last is not null").select("digest", "last")
    )
    joined = read.join(materialize(last, "repeated"), "digest", "left")
    return joined.select("page_id", "url", "payload", "digest",
                         F.when(F.col("page_id") < F.col("last"), F.col("last")).alias("refers_to"))


def record_text(pages: DataFrame) -> DataFrame:
    """One column: the record of each page without its closing line ends, revisits without payload."""
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts], F.lit("\r\n"))
    revisit = F.col("refers_to").isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    name = lambda c: F.coalesce(c.cast("string"), F.lit("none"))
    head = F.concat(
        line("WARC/1.0"), line("WARC-Type: ", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID: <urn:page:", name(F.col("page_id")), ">"),
        line("WARC-Date: 1970-01-01T00:00:00Z"),
        line("WARC-Target-URI: ", F.regexp_replace(F.coalesce("url", F.lit("")), "[\\r\\n]+", " ")),
        line("WARC-Payload-Digest: sha1:", F.col("digest")),
        F.when(revisit, line("WARC-Refers-To: <urn:page:", name(F.col("refers_to")), ">")).otherwise(""),
        line("Content-Type: text/html"), line("Content-Length: ", F.octet_length(body).cast("string")), F.lit("\r\n"))
    return pages.select(F.concat(head, body).alias("value"))


def write_whole_gzip(pages: DataFrame, folder: str) -> None:
    """Write archives as one gzip stream per file, as found in the wild, with the writer for text: records are its
    lines, and the closing line ends of a record its separator."""
    record_text(pages).write.option("compression", "gzip").option("lineSep", RECORD_END.decode()).text(folder)


def records(chunks: Iterable[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, closing line ends included; holds one record and one chunk."""
    held = bytearray()
    source = iter(chunks)

    def fill(size: int) -> bool:
        while len(held) < size:
            more = next(source, None)
            if more is None:
                return False
            held.extend(more)
        return True

    while fill(1):
        searched = 0
        while (end := held.find(RECORD_END, searched)) < 0:
            searched = max(0, len(held) - 3)
            if not fill(len(held) + 1):
                raise ValueError("archive ends within a record's head")
        size = end + 4 + int(fields(bytes(held[:end]))["content-length"]) + 4
        if not fill(size):
            raise ValueError("archive ends within a record")
        yield bytes(held[:size])
        del held[:size]


def fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, names in lower case."""
    lines = head.decode().split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines if ":" in x)}


def inflated(data: bytes) -> Iterator[bytes]:
    """The content of a gzip file in steps: a single stream, or one member after the other."""
    while data:
        stream = zlib.decompressobj(31)
        while not stream.eof:
            piece = stream.decompress(data, STEP)
            data = stream.unconsumed_tail if not stream.eof else stream.unused_data
            if piece:
                yield piece
            elif not data and not stream.eof:
                raise ValueError("gzip file ends early")


def normalise(spark: SparkSession, source: str, folder: str) -> DataFrame:
    """Rewrite every record of the ``*.gz`` archives in ``source`` as a gzip member of its own in ``folder``.

    Each archive is inflated once, in steps, by one task; the result has one file per archive. Returns the written
    index ``(path, offset, length, record_id, record_type)``. An archive that ends within a record fails the job. Files
    of lost or repeated task attempts are in no index.
    """

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, offset = [], 0
                stream, path = new_file(folder, "records.warc.gz")
                with stream:
                    for record in records(inflated(content.as_py())):
                        head = fields(record[:record.index(RECORD_END)])
                        packer = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        stream.write(member)
                        rows.append((path, offset, len(member), head["warc-record-id"], head["warc-type"]))
                        offset += len(member)
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                                 names=[x.split()[0] for x in INDEX.split(", ")])

    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("content")
    return materialize(archives.mapInArrow(run, INDEX), "warc-index")


def read_records(index: DataFrame) -> DataFrame:
    """``(record_id, record_type, refers_to, header_digest, payload_bytes, payload_digest)`` of every indexed record,
    each read by its offset and length alone; digests are of the payload as read."""

    def run(batches):
        for batch in batches:
            rows, path, stream = [], None, None
            for at, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if at != path:
                    system, inner = opened(at)
                    path, stream = at, system.open_input_file(inner)
                stream.seek(offset)
                record = zlib.decompress(stream.read(length), 31)
                end = record.index(RECORD_END)
                head, payload = fields(record[:end]), record[end + 4:-4]
                rows.append({
                    "record_id": head["warc-record-id"], "record_type": head["warc-type"], "refers_to": head.get("warc-refers-to"),
                    "header_digest": head["warc-payload-digest"].removeprefix("sha1:"), "payload_bytes": len(payload),
                    "payload_digest": base64.b32encode(hashlib.sha1(payload).digest()).decode()})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
                [(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in
                 ("record_id", "record_type", "refers_to", "header_digest", "payload_bytes", "payload_digest")]))

    size = index.agg(F.sum("length")).first()[0] or 0
    spread = index.select("path", "offset", "length").repartitionByRange(max(1, -(-size // READ_BYTES)), "path", "offset")
    return spread.sortWithinPartitions("path", "offset").mapInArrow(
        run, "record_id string, record_type string, refers_to string, header_digest string, payload_bytes long, payload_digest string")


def archive_pages(pages: DataFrame, folder: str, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives under ``folder`` and return the index of the normalised ones.

    Every row is a record, repeated rows and rows without ``page_id`` too (the latter named ``none``, never revisits).
    Null html is an empty payload. Rows that repeat the largest ``page_id`` of a payload are all responses. Other
    columns are ignored; an empty table gives archives without records. A payload is one value of a task, however large.
    """
    write_whole_gzip(page_records(pages, min_bytes), f"{folder}/whole")
    return normalise(pages.sparkSession, f"{folder}/whole", f"{folder}/records")


def page_digests(index: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of archives of pages. A revisit takes the
    payload's size and digest from the record it refers to."""
    page = lambda c: F.regexp_extract(c, "<urn:page:(-?[0-9]+)>", 1)
    read = materialize(read_records(index), "records").select(
        F.expr("try_cast(regexp_extract(record_id, '<urn:page:(-?[0-9]+)>', 1) as bigint)").alias("page_id"),
        F.when(F.col("refers_to").isNotNull(), page(F.col("refers_to")).cast("long")).alias("refers_to"),
        "record_type", "payload_bytes", "payload_digest", "header_digest")
    own = read.where("record_type <> 'revisit'")
    again = read.where("record_type = 'revisit'").select("page_id", "refers_to", "record_type", F.col("header_digest").alias("payload_digest"))
    named = materialize(again.select(F.col("refers_to").alias("page_id"), "payload_digest").distinct(), "named")
    full = materialize(
        own.join(named, ["page_id", "payload_digest"], "left_semi")
        .select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct(), "full")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return own.select(columns).unionByName(again.join(full, ["refers_to", "payload_digest"]).select(columns))


_SQL = """
with read as (select page_id, coalesce(html, '') as payload from pages),
hashed as (select page_id, payload, max(page_id) over (partition by payload) as last, sha1(payload) as hex from read),
spelled as (
  select page_id, payload, last, list_aggregate(list_transform(range(32), lambda k:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      (('0x' || substr(hex, (k // 8) * 10 + 1, 10))::bigint // (1::bigint << (35 - 5 * (k % 8)))) % 32 + 1, 1)), 'string_agg', '') as digest
  from hashed)
select page_id, strlen(payload) as payload_bytes, digest as payload_digest,
       case when page_id < last then 'revisit' else 'response' end as record_type,
       case when page_id < last then last end as refers_to
from spelled
"""


@query("op4_warc", _SQL)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page, archived and read back."""
    return page_digests(archive_pages(table(spark, sf_dir, "pages"), shared_folder(spark, "warc")))
