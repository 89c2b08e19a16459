"""WARC archives: a writer of monolithic gzip streams and a normaliser to one member per record.

Pages are written as WARC records; Spark's text sink compresses each output file as one whole gzip
stream. The normaliser inflates every such stream once, front to back, rewrites each record as its
own gzip member in a new archive and writes a sidecar index (archive, offset, length, and the
record's main headers), so that any record can be read alone. Reading goes through the sidecar.

Records are cut at the separator between them but measured by Content-Length, so a payload may hold
the separator itself. Archives are written under a name of the attempt and named in the sidecar only
when the task ends, so a lost executor leaves at most an unlisted file.

Records with equal payloads of at least ``min_bytes`` bytes: the one with the smallest page id is a
response, the others are revisits without a payload that name it.

Defined results: a null html is an empty payload; a null url is left out, line breaks in a url are
percent-encoded; a null page id sorts above all ids, so its record is a revisit of any equal page
that has an id, else a response; rows that repeat the smallest id are responses all; an empty table
gives no records. Only the three page columns are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textcluster.session import scratch_path

from .common import lookup, total, written

VERSION = "WARC/1.1"
GAP = "\r\n\r\n"
#: what stands between two records of a stream, as far as it is the same in all versions
SEPARATOR = GAP + "WARC/1."
DATE = "2000-01-01T00:00:00Z"
INDEX = "archive string, offset long, length long, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1 of a binary column: 5 hex digits are 4 base32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def page_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, refers_to): refers_to is null for responses."""
    payload = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    groups = rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
    groups = written(groups.filter("n > 1 and first is not null"), "warc-groups")
    found = lookup(rows, groups, ["payload_digest"], "n", ["first"], total(groups, "n"))
    return found.withColumn("refers_to", F.when(~F.col("first").eqNullSafe(F.col("page_id")), F.col("first"))).drop("first")


def record_text(page_id: Column, url: Column, payload: Column, payload_bytes: Column, digest: Column, refers_to: Column) -> Column:
    """A whole record without its last line break, which the text sink writes."""
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    revisit = refers_to.isNotNull()
    body = F.when(revisit, F.lit("")).otherwise(payload)
    target = F.replace(F.replace(url, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda key, value: F.concat(F.lit(f"{key}: "), value, F.lit("\r\n"))
    return F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.when(revisit, "revisit").otherwise("response")), line("WARC-Record-ID", name(page_id)),
        F.coalesce(line("WARC-Target-URI", target), F.lit("")), line("WARC-Date", F.lit(DATE)),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), line("X-Payload-Length", payload_bytes.cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", name(refers_to)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")), line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"), body, F.lit("\r\n\r"),
    )


def write_streams(records: DataFrame, path: str) -> None:
    """One monolithic gzip stream of records per partition."""
    text = record_text(*[F.col(c) for c in ("page_id", "url", "payload", "payload_bytes", "payload_digest", "refers_to")])
    records.select(text.alias("value")).write.option("compression", "gzip").text(path)


def _headers(head: bytes) -> dict[bytes, bytes]:
    pairs = (line.split(b":", 1) for line in head.split(b"\r\n")[1:] if b":" in line)
    return {key.strip().lower(): value.strip() for key, value in pairs}


def _records(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes, bytes]]:
    """(file, head, payload) of every record from what stands between separators, in file order."""
    split = SEPARATOR.encode()
    file, held = None, b""
    for name, chunk in chunks:
        if name != file:
            if held:
                raise ValueError(f"{file} ends within a record")
            file, held = name, b""
            if not chunk.startswith(b"WARC/1."):
                raise ValueError(f"{file} does not start with a record")
            chunk = chunk[len(b"WARC/1.") :]
        # a payload may hold the separator: go on until Content-Length is reached
        held = held + split + chunk if held else b"WARC/1." + chunk
        head, found, body = held.partition(b"\r\n\r\n")
        size = int(_headers(head)[b"content-length"]) if found else -1
        if found and len(body) >= size:
            if body[size:] not in (b"", b"\r\n\r\n"):
                raise ValueError(f"{file}: a record is longer than its Content-Length")
            yield file, head, body[:size]
            held = b""
    if held:
        raise ValueError(f"{file} ends within a record")


def _number(name: bytes | None) -> int | None:
    found = (name or b"").removeprefix(b"<urn:page:").removesuffix(b">")
    return None if found in (b"", b"none") else int(found)


def _described(head: bytes, body: bytes) -> tuple:
    """(page_id, type, refers_to, digest, bytes); a response's payload is measured and verified."""
    fields = _headers(head)
    kind, digest = fields[b"warc-type"].decode(), fields[b"warc-payload-digest"].decode().removeprefix("sha1:")
    size = int(fields[b"x-payload-length"])
    if kind == "response":
        size, told = len(body), digest
        digest = base64.b32encode(hashlib.sha1(body).digest()).decode()
        if digest != told:
            raise ValueError("a payload differs from its digest")
    return _number(fields[b"warc-record-id"]), kind, _number(fields.get(b"warc-refers-to")), digest, size


def _batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 512):
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)
            held = []
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in held], f.type) for i, f in enumerate(schema)], schema=schema)


KINDS = {"string": pa.string(), "long": pa.int64()}
INDEX_SCHEMA = pa.schema([(n, KINDS[t]) for n, t in (f.split() for f in INDEX.split(", "))])


def normalise(spark: SparkSession, streams: str, out: str) -> DataFrame:
    """Rewrite the gzip streams in folder ``streams`` as archives with one member per record in folder
    ``out``/archives and their index in ``out``/index (Parquet); returns the index."""
    chunks = spark.read.option("lineSep", SEPARATOR).text(streams)
    chunks = chunks.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value"))

    def rewrite(batches):
        from pyarrow import fs
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(out)
        store.create_dir(f"{root}/archives", recursive=True)

        def parts():
            for batch in batches:
                yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)

        def rows():
            current, sink, offset, name = None, None, 0, ""
            try:
                for file, head, body in _records(parts()):
                    if file != current:
                        if sink:
                            sink.close()
                        current, offset = file, 0
                        name = f"{file.rsplit('/', 1)[1].split('.')[0]}-{attempt}.warc.gz"
                        sink = store.open_output_stream(f"{root}/archives/{name}", compression=None)
                    member = zlib.compressobj(6, zlib.DEFLATED, 31)
                    packed = member.compress(head + b"\r\n\r\n" + body + b"\r\n\r\n") + member.flush()
                    sink.write(packed)
                    page, kind, refers, digest, size = _described(head, body)
                    yield name, offset, len(packed), page, kind, refers, digest, size
                    offset += len(packed)
            finally:
                if sink:
                    sink.close()

        yield from _batches(rows(), INDEX_SCHEMA)

    chunks.mapInArrow(rewrite, INDEX).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def read_archives(index: DataFrame, out: str, with_payload: bool = False) -> DataFrame:
    """(page_id, record_type, refers_to, payload_digest, payload_bytes[, payload]) of the indexed
    records, each inflated alone at its offset. An index file lists whole archives in order, so a task
    reads its archives front to back."""
    fields = [("page_id", "long"), ("record_type", "string"), ("refers_to", "long"), ("payload_digest", "string"), ("payload_bytes", "long")]
    schema = pa.schema([(n, KINDS[t]) for n, t in fields] + [("payload", pa.binary())] * with_payload)
    spec = ", ".join(f"{n} {t}" for n, t in fields) + ", payload binary" * with_payload

    def read(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(out)

        def rows():
            name, source = None, None
            try:
                for batch in batches:
                    for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                        if archive != name:
                            if source:
                                source.close()
                            name, source = archive, store.open_input_file(f"{root}/archives/{archive}")
                        source.seek(offset)
                        head, _, body = zlib.decompress(source.read(length), 31).partition(b"\r\n\r\n")
                        body = body[:-4]
                        page, kind, refers, digest, size = _described(head, body)
                        yield (page, kind, refers, digest, size, body)[: len(schema)]
            finally:
                if source:
                    source.close()

        yield from _batches(rows(), schema)

    return index.select("archive", "offset", "length").mapInArrow(read, spec)


def archive_pages(pages: DataFrame, min_bytes: int = 0, path: str | None = None) -> tuple[DataFrame, str]:
    """Write pages as streams, normalise them, and return the index and the folder."""
    spark = pages.sparkSession
    base = path or scratch_path(spark, "warc")
    base = base if "://" in base else f"file://{base}" if base.startswith("/") else base.replace("file:", "file://", 1) if base.startswith("file:/") else base
    write_streams(page_records(pages, min_bytes), f"{base}/streams")
    return normalise(spark, f"{base}/streams", base), base
