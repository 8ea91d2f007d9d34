"""WARC archives: deduplicating writer and splittable reader.

Archives are files of gzip members, one per record. Reading tasks get byte ranges: a task looks for the gzip magic in its
range, takes a candidate for a record only if its header decodes as WARC, and owns the records that start inside the range,
however far the last one reaches. Files go to and come from the shared folder through Arrow's file systems, so the same code
serves local, HDFS and object-store paths.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from clientele.functions.staging import staging_path, stage

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 128 << 20           # a file is closed when it gets longer
RANGE_BYTES = 16 << 20           # a reading task's range
READ_BYTES = 1 << 18             # of one read call
BATCH_BYTES = 8 << 20            # payload bytes of one batch handed back
HEAD = re.compile(rb"WARC/1\.[01]\r\n")


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def record_id(page_id: int | None, row: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{row}>"


def record(kind: str, uri: str, name: str, digest: str, payload: bytes, first: str | None, length: int) -> bytes:
    """One record as a gzip member. A revisit has no payload and names its response."""
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {uri}", "WARC-Date: 1970-01-01T00:00:00Z",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {length}"]
    if first is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {first}"]
    head += ["Content-Type: text/html", f"Content-Length: {len(payload)}"]
    deflate = zlib.compressobj(1, zlib.DEFLATED, 31)
    return deflate.compress("\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + deflate.flush()


def placed(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``html`` and ``row``, which stays the same however the scan is cut.

    Of a plain scan of files it is the file (as a 64-bit hash of its path) and the row's index in it; other tables are written
    once with their numbers.
    """
    html = F.coalesce("html", F.lit("")).alias("html")
    if pages._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":
        place = pages.metadataColumn("_metadata")
        row = F.concat_ws("-", F.hex(F.xxhash64(place["file_path"])), place["row_index"].cast("string"))
        return pages.select("page_id", "url", html, row.alias("row"))
    return stage(pages.select("page_id", "url", html, F.monotonically_increasing_id().cast("string").alias("row")), "warc-rows")


def plan_records(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """``page_id``, ``url``, ``html``, ``row``, ``digest`` and ``first`` (page and row of the response of a revisit, else null).

    Rows are told apart by their place, so that of rows with the same id exactly one can be the response. Of equal payloads of
    ``least_bytes`` or more the smallest page id is the response (null ids come last, then the smallest place as text); all others revisit it.
    """
    rows = placed(pages)
    rows = rows.withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    long = F.octet_length("html") >= least_bytes
    me = F.struct(F.col("page_id").isNull().alias("z"), F.col("page_id").alias("page_id"), F.col("row").alias("row"))
    firsts = rows.where(long).groupBy("digest").agg(F.min(me).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(firsts, "digest", "left")
    return rows.withColumn("first", F.when(F.col("first.row") != F.col("row"), F.struct("first.page_id", "first.row")))


def write(pages: DataFrame, folder: str, least_bytes: int = 100) -> DataFrame:
    """Writes the archives below ``folder`` and returns their manifest: ``path``, ``bytes``, ``records``.

    File names are new with every attempt of a task. The manifest is a table that Spark commits, so files of lost or repeated
    attempts are in no manifest and are never read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        fs.create_dir(root, recursive=True)
        out, made, name, size, count = None, [], "", 0, 0
        for batch in batches:
            for page_id, url, html, row, digest, first in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "row", "digest", "first"))):
                if out is None:
                    name, size, count = f"{root}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(name, compression=None)
                payload = html.encode()
                uri = re.sub(r"[\r\n]", " ", url or "")
                data = record("response" if first is None else "revisit", uri, record_id(page_id, row), digest, payload if first is None else b"",
                              None if first is None else record_id(first["page_id"], first["row"]), len(payload))
                out.write(data)
                size, count = size + len(data), count + 1
                if size >= FILE_BYTES:
                    out.close()
                    made.append((name, size, count))
                    out = None
        if out is not None:
            out.close()
            made.append((name, size, count))
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{m[0].rsplit('/', 1)[1]}" for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()),
                                          pa.array([m[2] for m in made], pa.int64())], ["path", "bytes", "records"])

    rows = plan_records(pages, least_bytes).select("page_id", "url", "html", "row", "digest", "first")
    return stage(rows.mapInArrow(run, "path string, bytes long, records long"), "warc-manifest")


def members(file, start: int, until: int, size: int) -> Iterator[tuple[int, bytes]]:
    """Start and content of the WARC members that start in ``[start, until)``."""
    at, window, base = start, bytearray(), start

    def more() -> bool:
        nonlocal window
        file.seek(base + len(window))
        got = file.read(READ_BYTES)
        window.extend(got)
        return bool(got)

    while at < until:
        if at - base > READ_BYTES:
            del window[:at - base]
            base = at
        hit = window.find(MAGIC, at - base)
        if hit < 0:                                                # keep two bytes: the magic may lie across two reads
            at = max(at, base + len(window) - 2)
            if not more():
                return
            continue
        at = base + hit
        if at >= until:
            return
        inflate, content, fed, good = zlib.decompressobj(31), [], hit, True
        head = b""
        while good and not inflate.eof:
            if fed >= len(window) and not more():
                good = False
                break
            try:
                piece = inflate.decompress(window[fed:fed + READ_BYTES])
            except zlib.error:
                good = False
                break
            fed = min(len(window), fed + READ_BYTES)
            content.append(piece)
            if len(head) < 10:
                head += piece[:10]
                good = len(head) < 10 or bool(HEAD.match(head))    # the header must decode as WARC
        if good and HEAD.match(head):
            yield at, b"".join(content)
            at = base + fed - len(inflate.unused_data)
        else:
            at += 1


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of a record."""
    head, _, body = content.partition(b"\r\n\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    return fields, body[:int(fields.get("content-length", 0))]


SCHEMA = "path string, start long, type string, id string, uri string, digest string, refers_to string, payload_length long, payload binary"


def read(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Records of the files of a manifest, by byte ranges: columns of ``SCHEMA``; ``payload`` is what the record itself holds.

    An empty manifest, or one of empty files, gives no rows.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("path", pa.string()), ("start", pa.int64()), ("type", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("digest", pa.string()),
                            ("refers_to", pa.string()), ("payload_length", pa.int64()), ("payload", pa.binary())])
        rows, held = [], 0
        for batch in batches:
            for path, start, until, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "until", "bytes"))):
                fs, name = _open(path)
                with fs.open_input_file(name) as file:
                    for at, content in members(file, start, until, size):
                        f, body = parse(content)
                        rows.append((path, at, f.get("warc-type"), f.get("warc-record-id"), f.get("warc-target-uri"), (f.get("warc-payload-digest") or "").removeprefix("sha256:"),
                                     f.get("warc-refers-to"), int(f.get("warc-payload-length") or len(body)), body))
                        held += len(body) + 500
                        if held > BATCH_BYTES:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
                            rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)

    cuts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long")))
    ranges = manifest.where("bytes > 0").select("path", "bytes", cuts.alias("start")).withColumn("until", F.least(F.col("bytes"), F.col("start") + range_bytes))
    # as many partitions as ranges; without a number Spark would merge these few small rows into one task
    n = manifest.agg(F.sum(F.ceil(F.col("bytes") / range_bytes))).first()[0] or 1
    return ranges.repartition(min(int(n), 20_000), "path", "start").mapInArrow(run, SCHEMA)


def summary(records: DataFrame) -> DataFrame:
    """Per record: page, full payload's length and digest, type and the page that a revisit refers to.

    A response's length and digest are taken from the payload read; a revisit has none and carries those of its response in
    its header.
    """
    full = F.col("type") == "response"
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    return records.select(number("id").alias("page_id"), F.when(full, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
                          F.when(full, F.sha2("payload", 256)).otherwise(F.col("digest")).alias("payload_digest"), F.col("type").alias("record_type"),
                          F.when(~full, number("refers_to")).alias("refers_to"))


def round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """Writes ``pages`` to archives below the shared folder, reads them back and sums them up, one row per page.

    Null html is an empty payload, null urls an empty target. Rows with the same id are records of their own. Equal payloads
    shorter than ``least_bytes`` are all responses. An empty table gives no file and no row. Other columns are not read.
    """
    spark = pages.sparkSession
    return summary(read(spark, write(pages, staging_path(spark, "warc"), least_bytes)))


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= 100 GROUP BY ALL)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM d LEFT JOIN f USING (payload_digest)
"""
