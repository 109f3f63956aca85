"""WARC archives: a crawl's monolithic gzip streams made seekable.

A crawler writes one gzip stream around many records.  The normaliser inflates such a
stream once, front to back, writes every record as a gzip member of its own and notes the
member's offset and length in an index file beside the archive, so that a reader can take
one record without the ones before it.

Records with equal payloads are written once as ``response``; the others are ``revisit``
records that refer to it by id and payload digest and carry no payload.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arcwright.functions.durable import new_path
from arcwright.llm.rawfiles import read_raw, write_raw

RECORDS_PER_ARCHIVE = 2048
ARCHIVE_BYTES = 24_000_000
LEVEL = 4
INFLATE_STEP = 1 << 18
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A gzip member of no bytes.  It ends in zeros, as the raw writer wants its files to.
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff03000000000000000000")

_BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: four groups of 40 bits, 8 letters each."""
    sha = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(sha, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*groups), _BASE32_HEX, _BASE32)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least ``least_bytes`` bytes the largest page_id is the
    response; a null page_id is a response only if no other row has the payload.  Rows that
    repeat page_id and payload are responses alike.  The join on the digest may be split
    where one payload is hot; the side that is joined was aggregated before its shuffle.
    """
    payload = F.coalesce(F.encode("html", "UTF-8"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload"))
    rows = rows.withColumn("payload_bytes", F.length("payload").cast("long")).withColumn("payload_digest", payload_digest(F.col("payload")))
    keep = pages.select("page_id", payload_digest(payload).alias("payload_digest")).groupBy("payload_digest").agg(F.max("page_id").alias("first"))
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.join(keep, "payload_digest").select(
        "page_id",
        "url",
        "payload",
        "payload_bytes",
        "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"),
    )


def _record(page_id, url, payload, size, digest, kind, refers_to) -> bytes:
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html",
        f"Content-Length: {len(body)}",
    ]
    if kind == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def _crawl(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One gzip stream around all records of an archive."""
    part, turn, count, out, size = TaskContext.get().partitionId(), 0, 0, [], 0
    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)

    def done() -> pa.RecordBatch:
        out.append(gz.flush())
        return pa.record_batch({"kind": pa.array(["crawl"]), "shard": pa.array([f"{part:08d}-{turn:06d}"]), "payload": pa.array([b"".join(out) + _EMPTY_MEMBER], pa.binary())})

    names = ["page_id", "url", "payload", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for batch in batches:
        for a in range(0, batch.num_rows, 64):
            for row in zip(*[batch.slice(a, 64).column(n).to_pylist() for n in names], strict=True):
                got = gz.compress(_record(*row))
                out.append(got)
                count, size = count + 1, size + len(got)
                if count >= RECORDS_PER_ARCHIVE or size >= ARCHIVE_BYTES:
                    yield done()
                    turn, count, out, size = turn + 1, 0, [], 0
                    gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    if count:
        yield done()


def _inflated(data: bytes) -> Iterator[bytes]:
    """The stream's bytes in steps, member after member."""
    view, at = memoryview(data), 0
    gz = zlib.decompressobj(31)
    while at < len(view):
        step = view[at : at + INFLATE_STEP]
        at += len(step)
        feed: bytes = bytes(step)
        while feed:
            if gz.eof:
                gz = zlib.decompressobj(31)
            piece = gz.decompress(feed, INFLATE_STEP * 8)
            if piece:
                yield piece
            feed = gz.unused_data if gz.eof else gz.unconsumed_tail


def parse_records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, body, whole record) of each record of a WARC byte stream."""
    buffer = bytearray()
    chunks = iter(chunks)

    def more() -> bool:
        for c in chunks:
            buffer.extend(c)
            return True
        return False

    while True:
        end = buffer.find(b"\r\n\r\n")
        while end < 0:
            if not more():
                return
            end = buffer.find(b"\r\n\r\n")
        lines = bytes(buffer[:end]).decode("utf-8").split("\r\n")
        head = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        whole = end + 4 + int(head["Content-Length"]) + 4
        while len(buffer) < whole:
            if not more():
                raise ValueError("a record is cut short")
        record = bytes(buffer[:whole])
        del buffer[:whole]
        yield head, record[end + 4 : -4], record


def _normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
            body, index, at = [], [], 0
            for head, _, record in parse_records(_inflated(data)):
                gz = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = gz.compress(record) + gz.flush()
                index.append(f"{at} {len(member)} {head['WARC-Type']} {head['WARC-Record-ID']} {head['WARC-Payload-Digest']}")
                body.append(member)
                at += len(member)
            lines = ("\n".join(index) + "\n").encode("utf-8") + b"\0"
            yield pa.record_batch({"kind": pa.array(["warc", "index"]), "shard": pa.array([shard] * 2), "payload": pa.array([b"".join(body) + _EMPTY_MEMBER, lines], pa.binary())})


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Write ``pages(page_id, url, html)`` as crawl streams below ``path``/crawl, then normalise
    them into ``path``/archives: one .warc.gz body and one index for each.

    A null html is an empty payload; a null url is an empty target.  An empty table writes
    no archive.  Other columns are ignored.
    """
    spark = pages.sparkSession
    rows = with_roles(pages, least_bytes)
    write_raw(rows.mapInArrow(_crawl, "kind string, shard string, payload binary"), f"{path}/crawl", ["kind", "shard"])
    normalise_archives(spark, path)


def normalise_archives(spark: SparkSession, path: str) -> None:
    if not _holds(spark, f"{path}/crawl/kind=crawl"):
        return
    crawl = read_raw(spark, f"{path}/crawl/kind=crawl").select("shard", "content")
    write_raw(crawl.mapInArrow(_normalise, "kind string, shard string, payload binary"), f"{path}/archives", ["kind", "shard"])


def _holds(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar indexes as rows: shard, offset, length, record_type, record_id, digest."""
    if not _holds(spark, f"{path}/archives/kind=index"):
        return spark.createDataFrame([], "shard string, offset long, length long, record_type string, record_id string, digest string")
    files = read_raw(spark, f"{path}/archives/kind=index")
    line = files.select("shard", F.explode(F.split(F.col("content").cast("string"), "\n")).alias("line")).filter(F.length("line") > 1)
    f = F.split("line", " ")
    return line.select("shard", f[0].cast("long").alias("offset"), f[1].cast("long").alias("length"), f[2].alias("record_type"), f[3].alias("record_id"), f[4].alias("digest"))


_RECORD = "shard string, offset long, page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, body binary"


def _page(urn: str | None) -> int | None:
    number = urn.removeprefix("<urn:page:").removesuffix(">") if urn else ""
    return int(number) if number else None


def _row(shard: str, offset: int, member: bytes) -> tuple:
    head, body, _ = next(parse_records(iter([zlib.decompress(member, 31)])))
    return shard, offset, _page(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], _page(head.get("WARC-Refers-To")), body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
    names = [c.split()[0] for c in _RECORD.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.record_batch([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for shard, data in zip(batch.column("shard").to_pylist(), batch.column("content").to_pylist(), strict=True):
            at, rows = 0, []
            while at < len(data) - len(_EMPTY_MEMBER):
                gz = zlib.decompressobj(31)
                raw, seen = [], at
                while not gz.eof:
                    raw.append(gz.decompress(data[seen : seen + INFLATE_STEP]))
                    seen += INFLATE_STEP
                size = min(seen, len(data)) - at - len(gz.unused_data)
                head, body, _ = next(parse_records(iter([b"".join(raw)])))
                rows.append((shard, at, _page(head["WARC-Record-ID"]), int(head["X-Payload-Length"]), head["WARC-Payload-Digest"].removeprefix("sha1:"), head["WARC-Type"], _page(head.get("WARC-Refers-To")), body))
                at += size
                if len(rows) >= 256:
                    yield _batch(rows)
                    rows = []
            yield _batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """All records of all archives, member by member."""
    if not _holds(spark, f"{path}/archives/kind=warc"):
        return spark.createDataFrame([], _RECORD)
    return read_raw(spark, f"{path}/archives/kind=warc").select("shard", "content").mapInArrow(_walk, _RECORD)


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield _batch([_row(s, o, m) for s, o, m in zip(*[b.column(n).to_pylist() for n in ("shard", "offset", "member")], strict=True)])


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """The records that ``wanted(shard, offset, length)`` (rows of the index) point at.

    Only the archives named are opened, and only the members asked for are inflated.
    """
    files = read_raw(spark, f"{path}/archives/kind=warc").select("shard", "content")
    spots = wanted.groupBy("shard").agg(F.collect_list(F.struct("offset", "length")).alias("spots"))  # bounded by an archive's records
    cut = files.join(spots, "shard").select("shard", "content", F.explode("spots").alias("s"))
    return cut.select("shard", F.col("s.offset").alias("offset"), F.expr("substring(content, cast(s.offset + 1 as int), cast(s.length as int))").alias("member")).mapInArrow(_members, _RECORD)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    index = read_index(spark, path).select("shard", "offset", "length", F.col("record_type").alias("indexed_type"))
    # every record has its line in the index and every line its record, or the query fails
    found = read_archives(spark, path).drop("body").join(index, ["shard", "offset"], "full")
    agree = F.when(F.col("record_type") == F.col("indexed_type"), True).otherwise(F.raise_error(F.concat_ws(" ", F.lit("index and archive differ at"), "shard", F.col("offset").cast("string"))))
    return found.filter(agree).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP2_SQL = """
with p as (
  select page_id, coalesce(html, '') as html, unhex(sha1(coalesce(html, ''))) as b from pages
), g as (
  select *, max(page_id) over (partition by html) as first from p
), d as (
  select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, first,
    (select string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
        ((get_bit(bits, 5 * i) * 16) + (get_bit(bits, 5 * i + 1) * 8) + (get_bit(bits, 5 * i + 2) * 4) + (get_bit(bits, 5 * i + 3) * 2) + get_bit(bits, 5 * i + 4)) as integer), 1), '' order by i)
      from (select cast(range as integer) as i from range(32)) r) as payload_digest
  from (select *, b::bit as bits from g)
)
select page_id, payload_bytes, payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from d
"""
