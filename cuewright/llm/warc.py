"""Legacy web archives (ARC) to WARC: parse version-specific ARC headers and declared lengths, then
synthesise equivalent WARC identifiers, timestamps, types and digests.

An ARC file opens with a version block whose second line names the version; version 1 records have
five header fields, version 2 ten. A record's body is exactly its declared length. Every record of
an archive becomes one WARC record: a response, or a revisit of the response with an equal payload.
Archives are runs of gzip members, one a record, in the shared folder; their sizes are bounded.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, read, read_file, write_file, written

#: Fixed values of the formats.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
FILE_BYTES = 8 << 20
LEVEL, SLICE = 1, 4096


# ---- ARC ----------------------------------------------------------------------------------------


def _member(data: bytes) -> bytes:
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, content) of each gzip member; a file that isn't gzip is one member."""
    if data[:2] != b"\x1f\x8b":
        yield 0, len(data), data
        return
    at, view = 0, memoryview(data)
    while at < len(data):
        # fed in slices: what a reader has left over at a member's end is copied
        reader, parts, end, step = zlib.decompressobj(31), [], at, SLICE
        while not reader.eof:
            if end >= len(data):
                raise ValueError("a gzip member without an end")
            parts.append(reader.decompress(view[end : end + step]))
            end, step = min(len(data), end + step), 2 * step
        end -= len(reader.unused_data)
        yield at, end - at, parts[0] if len(parts) == 1 else b"".join(parts)
        at = end


def arc_version_block(name: str, version: int = 1) -> bytes:
    body = f"{version} 0 cuewright\n{V1_FIELDS if version == 1 else V2_FIELDS}\n".encode()
    head = f"filedesc://{name} 0.0.0.0 20240101000000 text/plain"
    if version == 2:
        head += " 200 - - 0 " + name
    return f"{head} {len(body)}\n".encode() + body + b"\n"


def arc_record(url: str, date: str, mime: str, body: bytes, version: int = 1, name: str = "-") -> bytes:
    middle = "" if version == 1 else f" 200 - - 0 {name}"
    return f"{url} 0.0.0.0 {date} {mime}{middle} {len(body)}\n".encode() + body + b"\n"


def parse_arc(data: bytes) -> Iterator[dict]:
    """Records of an ARC archive: its header fields, offset (of the member and within it) and body.

    The version line decides how many fields a header line has; a body of which the declared length
    runs past the end raises ValueError, as does a header line with another number of fields.
    """
    fields: list[str] = []
    for offset, _, content in members(data):
        at = 0
        while at < len(content):
            if content[at : at + 1] in (b"\n", b"\r"):  # separators between records
                at += 1
                continue
            end = content.find(b"\n", at)
            if end < 0:
                raise ValueError("an ARC header line without an end")
            line = content[at:end].decode("utf-8", "replace").rstrip("\r")
            values = line.split(" ")
            if not (length := values[-1]).isdigit():
                raise ValueError(f"no length in ARC header line {line[:200]!r}")
            body = content[end + 1 : end + 1 + int(length)]
            if len(body) < int(length):
                raise ValueError("an ARC record is shorter than its declared length")
            if line.startswith("filedesc://"):
                version, names = body.split(b"\n", 2)[:2]
                fields = names.decode().split()
                if version.split()[0] not in (b"1", b"2") or fields != (V1_FIELDS if version[:1] == b"1" else V2_FIELDS).split():
                    raise ValueError(f"unknown ARC version block {version!r}")
            else:
                if not fields:
                    raise ValueError("an ARC record before any version block")
                if len(values) != len(fields):
                    raise ValueError(f"an ARC header line with {len(values)} fields instead of {len(fields)}")
                yield dict(zip(fields, values, strict=True)) | {"offset": (offset, at), "body": body}
            at = end + 1 + int(length)


# ---- WARC ---------------------------------------------------------------------------------------


def record_id(digest: str, key: int | None, place: str) -> str:
    """A version 8 UUID of the record's 64-bit key and 58 bits that tell its digest and place; a version 5 one without a key."""
    if key is None:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, place)}>"
    told, bits = int(hashlib.sha1(f"{digest} {place}".encode()).hexdigest()[:15], 16) >> 2, key & ((1 << 64) - 1)
    high = (told >> 10) << 16 | 0x8 << 12 | (bits >> 62) << 10 | told & 0x3FF
    return f"<urn:uuid:{uuid.UUID(int=high << 64 | 0b10 << 62 | bits & ((1 << 62) - 1))}>"


def key_of(name: str) -> int | None:
    value = uuid.UUID(name.strip("<>").removeprefix("urn:uuid:"))
    if value.version != 8:
        return None
    bits = ((value.int >> 64) >> 10 & 0b11) << 62 | value.int & ((1 << 62) - 1)
    return bits - (1 << 64) if bits >> 63 else bits


def warc_date(date: str) -> str:
    date = (date + "00000000000000")[:14]
    return f"{date[:4]}-{date[4:6]}-{date[6:8]}T{date[8:10]}:{date[10:12]}:{date[12:14]}Z"


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))]
    return ("WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines) + "\r\n").encode() + block + b"\r\n\r\n"


def parse_warc(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record."""
    for _, _, content in members(data):
        at = 0
        while at < len(content):
            end = content.index(b"\r\n\r\n", at)
            lines = content[at:end].decode().split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"not a WARC record: {lines[0][:80]!r}")
            headers = dict(line.split(": ", 1) for line in lines[1:])
            size = int(headers["Content-Length"])
            yield headers, content[end + 4 : end + 4 + size]
            at = end + 4 + size + 4


def http_parts(block: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers, head, payload) of an HTTP response, whose head ends at the first blank line; without a head all is payload."""
    if not block.startswith(b"HTTP/"):
        return {}, b"", block
    head, sep, payload = block.partition(b"\r\n\r\n")
    if not sep:
        return {}, b"", block
    named = (line.partition(":") for line in head.decode("latin-1").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in named}, head + sep, payload


# ---- Spark --------------------------------------------------------------------------------------


def _url(url: str | None) -> str:
    from urllib.parse import quote

    return quote(url, safe="%:/?#[]@!$&'()*+,;=~") if url else "about:blank"


def write_arcs(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", version: int = 1) -> DataFrame:
    """Writes ARC archives of the rows; the manifest has a row (path, records, bytes) for each.

    Null bodies are empty, null and empty URLs about:blank; a null id leaves out its header.
    """
    folder = new_folder(pages.sparkSession, "arc")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, size, count = [], 0, 0

        def close() -> pa.RecordBatch:
            path = f"{folder}/{uuid.uuid4().hex}.arc.gz"
            write_file(path, b"".join(held))
            return pa.RecordBatch.from_pylist([{"path": path, "records": count, "bytes": size}], pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

        for batch in batches:
            for key, url, html in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = html or b""
                if not held:
                    held.append(_member(arc_version_block("pages", version)))
                identity = f"X-Record-Key: {key}\r\n" if key is not None else ""
                head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n{identity}Content-Length: {len(payload)}\r\n\r\n"
                held.append(_member(arc_record(_url(url), "20240101000000", "text/html", head.encode() + payload, version)))
                size, count = size + len(held[-1]), count + 1
                if size >= FILE_BYTES:
                    yield close()
                    held, size, count = [], 0, 0
        if count:
            yield close()

    rows = pages.select(F.col(id_col).cast("bigint").alias("key"), F.col(url_col).alias("url"), F.col(body_col).cast("binary").alias("body"))
    return written(rows.mapInArrow(run, "path string, records bigint, bytes bigint"), "arcs")


INDEX = "path string, pos int, key bigint, size bigint, digest string"


def index_arcs(arcs: DataFrame) -> DataFrame:
    """(path, pos, key, size, digest) of each record of the archives: size and SHA-1 of its payload."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("path", pa.string()), ("pos", pa.int32()), ("key", pa.int64()), ("size", pa.int64()), ("digest", pa.string())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for pos, record in enumerate(parse_arc(read_file(path))):
                    headers, _, payload = http_parts(record["body"])
                    key = headers.get("x-record-key")
                    rows.append((path, pos, key and int(key), len(payload), hashlib.sha1(payload).hexdigest()))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return spread(arcs).mapInArrow(run, INDEX)


def spread(archives: DataFrame) -> DataFrame:
    """The paths of a manifest, dealt out one by one over as many tasks as there are archives, or else a few a core."""
    most = 4 * int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return archives.select("path").repartition(max(1, min(archives.count(), most)))


def with_revisits(index: DataFrame, least: int = 1000) -> DataFrame:
    """Adds first: the (key, path, pos) of the record to revisit, null for responses.

    Of payloads that are equal and have at least so many bytes, the record with the largest key is
    the response (a null key is the smallest; of equal keys the last place).
    """
    place = F.struct("key", "path", "pos")
    repeated = index.where(F.col("size") >= least).groupBy("digest").agg(F.max(place).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    joined = index.join(repeated, "digest", "left")
    again = (F.col("size") >= least) & F.col("first").isNotNull() & ~F.col("first").eqNullSafe(place)
    return joined.select(*index.columns, F.when(again, F.col("first")).alias("first"))


def arcs_to_warcs(arcs: DataFrame, least: int = 1000) -> DataFrame:
    """Converts each archive; the manifest has a row (path, records) for each WARC file."""
    spark = arcs.sparkSession
    folder = new_folder(spark, "warc")
    index = written(index_arcs(arcs), "arc-index")
    plan = with_revisits(index, least)

    def convert(batches: Iterator) -> Iterator:
        import pyarrow as pa

        table = pa.Table.from_batches(list(batches))  # the records of one archive, bounded by its size
        source = table.column("path")[0].as_py()
        known = {pos: (digest, first) for pos, digest, first in zip(*(table.column(c).to_pylist() for c in ("pos", "digest", "first")), strict=True)}
        out, count = [], 0
        for pos, record in enumerate(parse_arc(read_file(source))):
            headers, head, payload = http_parts(record["body"])
            key = headers.get("x-record-key")
            digest, again = known[pos]
            named = [
                ("WARC-Record-ID", record_id(digest, key and int(key), f"{source}#{pos}")),
                ("WARC-Target-URI", record["URL"]),
                ("WARC-Date", warc_date(record["Archive-date"])),
                ("WARC-IP-Address", record["IP-address"]),
                ("WARC-Payload-Digest", f"sha1:{digest}"),
                ("Content-Type", "application/http; msgtype=response"),
            ]
            if again:
                named += [("WARC-Refers-To", record_id(digest, again["key"], f"{again['path']}#{again['pos']}")), ("WARC-Profile", REVISIT_PROFILE)]
                out.append(_member(warc_record("revisit", named, head)))
            else:
                out.append(_member(warc_record("response", named, head + payload)))
            count += 1
        path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        write_file(path, b"".join(out))
        yield pa.RecordBatch.from_pylist([{"path": path, "records": count}], pa.schema([("path", pa.string()), ("records", pa.int64())]))

    tasks = max(1, min(arcs.count(), 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    return written(plan.repartition(tasks, "path").groupBy("path").applyInArrow(_streamed(convert), "path string, records bigint"), "warcs")


def _streamed(convert):
    def whole(table):
        import pyarrow as pa

        return pa.Table.from_batches(list(convert(iter(table.to_batches()))))

    return whole


def read_warcs(warcs: DataFrame) -> DataFrame:
    """(key, size, digest, kind, refers_to) of each record; size and digest are the full payload's."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        schema = pa.schema([("key", pa.int64()), ("size", pa.int64()), ("digest", pa.string()), ("kind", pa.string()), ("refers_to", pa.int64())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                for headers, block in parse_warc(read_file(path)):
                    fields, _, payload = http_parts(block)
                    kind, digest = headers["WARC-Type"], headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                        raise ValueError(f"{path}: a payload doesn't match its digest")
                    size = len(payload) if kind == "response" else int(fields["content-length"])
                    refers = headers.get("WARC-Refers-To")
                    rows.append((key_of(headers["WARC-Record-ID"]), size, digest, kind, refers and key_of(refers)))
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)

    return spread(warcs).mapInArrow(run, "key bigint, size bigint, digest string, kind string, refers_to bigint")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as ARC, converted to WARC, and read back from there."""
    records = read_warcs(arcs_to_warcs(write_arcs(read(spark, sf_dir, "pages"))))
    return records.select(
        F.col("key").alias("page_id"), F.col("size").alias("payload_bytes"), F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), "refers_to"
    )


#: payload_digest is SHA-1, which DuckDB has from version 1.2 on.
SQL = """WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND payload_bytes >= 1000"""

QUERIES = {"op7_warc": op7_warc}
ORACLE = {"op7_warc": SQL}
