"""WARC archives with revisit records.

Headers alone are shuffled by payload digest to find, for each repeated payload, the record that keeps it. The records
are then written as archives in which every later copy is a ``revisit`` record without a payload, and read back.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, materialize, shared_dir, ship, sliced, table, texts

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def resolve(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """Add payload_digest, payload_bytes, refers_to, refers_uri and named to ``pages`` (page_id, url, html).

    Of rows with equal payloads of at least ``smallest`` bytes the one with the smallest page_id is the original and
    the others refer to it. A null html is an empty payload. Rows that repeat the original's page_id are originals too;
    where their urls differ, references name the smallest, a null one being empty. ``named`` marks the original and its
    revisits if that page_id and url are one row's only, so that its record's id can be given: records whose rows are
    alike in all are each their own, and their revisits name page and url alone.
    A null page_id is never an original while another row has that payload.
    """
    pages = doc_rows(pages, "page_id", "url", "html").withColumn("html", F.coalesce("html", F.lit("")))
    pages = pages.withColumn("payload_digest", F.sha2("html", 256)).withColumn("payload_bytes", F.octet_length("html").cast("long"))
    headers = pages.where(F.col("payload_bytes") >= smallest).select("payload_digest", "page_id", F.coalesce("url", F.lit("")).alias("uri"))
    alike = headers.groupBy("payload_digest", "page_id", "uri").agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "uri", "n"))).alias("first")
    originals = alike.groupBy("payload_digest").agg(F.sum("n").alias("copies"), first)
    originals = originals.where((F.col("copies") > 1) & F.col("first.page_id").isNotNull())
    named = (F.col("first.n") == 1).alias("named")
    originals = materialize(originals.select(F.col("payload_digest").alias("digest"), F.col("first.page_id").alias("original"), F.col("first.uri").alias("original_uri"), named))
    joined = pages.join(originals, F.col("payload_digest") == F.col("digest"), "left")
    copy = F.col("original").isNotNull() & ~F.col("original").eqNullSafe(F.col("page_id"))
    known = F.coalesce(F.col("named") & (copy | (F.coalesce("url", F.lit("")) == F.col("original_uri"))), F.lit(False))
    return joined.select("page_id", "url", "html", "payload_digest", "payload_bytes", F.when(copy, F.col("original")).alias("refers_to"), F.when(copy, F.col("original_uri")).alias("refers_uri"), known.alias("named"))


def original_id(page_id: int, uri: str, digest: str) -> uuid.UUID:
    return uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{digest}|{uri}")


def record(page_id: int | None, url: str | None, html: bytes, digest: str, size: int, refers_to: int | None, refers_uri: str | None, named: bool) -> bytes:
    """One WARC record as a gzip member of its own. A revisit carries the HTTP head but no payload.

    The id of a ``named`` response follows from page, url and payload, so that revisits can name it; all others are new.
    """
    own = original_id(page_id, url or "", digest) if named and refers_to is None else uuid.uuid4()
    block = HEAD if refers_to is not None else HEAD + html
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:uuid:{own}>"]
    lines += [f"WARC-Target-URI: {''.join((url or 'urn:none').split())}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}"]
    lines += [f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Length: {size}"]
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}"]
        lines += [f"WARC-Refers-To: <urn:uuid:{original_id(refers_to, refers_uri or '', digest)}>"] if named else []
        lines += [f"WARC-Refers-To-Target-URI: {''.join((refers_uri or 'urn:none').split())}", f"WARC-Refers-To-Date: {DATE}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", 4, mtime=0)


def members(stream, piece: int = 1 << 20) -> Iterator[bytes]:
    """The content of each gzip member of ``stream`` in turn, holding one at a time."""
    data = b""
    while data := data or stream.read(piece):
        d, parts = zlib.decompressobj(31), []
        while data and not d.eof:
            parts.append(d.decompress(data))
            data = d.unused_data if d.eof else stream.read(piece)
        if not d.eof:
            raise ValueError("the archive ends inside a record")
        yield b"".join(parts)


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and block of one record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    return fields, rest[: int(fields["content-length"])]


def write_archives(resolved: DataFrame, folder: str, roll: int = 256 << 20) -> DataFrame:
    """Write ``resolve``'s rows as ``.warc.gz`` files; one manifest row for each file that a finished task wrote."""
    ship(resolved.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        stream = None
        for batch in sliced(batches, "html"):
            for row, html in zip(batch.drop_columns(["html"]).to_pylist(), texts(batch, "html")):
                if stream is None:
                    store.create_dir(path, recursive=True)
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    stream = store.open_output_stream(f"{path}/{name}", compression=None)
                data = record(row["page_id"], row["url"], html, row["payload_digest"], row["payload_bytes"], row["refers_to"], row["refers_uri"], row["named"])
                stream.write(data)
                records, size = records + 1, size + len(data)
                if size >= roll:
                    stream.close()
                    yield table(file=[name], records=pa.array([records], pa.int64()), bytes=pa.array([size], pa.int64()))
                    stream = None
        if stream is not None:
            stream.close()
            yield table(file=[name], records=pa.array([records], pa.int64()), bytes=pa.array([size], pa.int64()))

    return resolved.mapInArrow(write, "file string, records long, bytes long")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Every record of the files: page_id, url, payload_bytes, payload_digest, record_type, refers_to.

    A response's size and digest are computed from the payload read; a revisit's are its header's.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    held = []
                    for content in members(stream):
                        fields, block = parse(content)
                        payload = block.partition(b"\r\n\r\n")[2]
                        number = lambda x: int(x) if x else None
                        kept = fields["warc-type"] == "response"
                        digest = hashlib.sha256(payload).hexdigest() if kept else fields["warc-payload-digest"].removeprefix("sha256:")
                        held.append((number(fields["warc-page-id"]), fields["warc-target-uri"], len(payload) if kept else int(fields["warc-payload-length"]), digest, fields["warc-type"], number(fields.get("warc-refers-to-page-id"))))
                        if len(held) == 2000:
                            yield _rows(held)
                            held = []
                    yield _rows(held)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    files = manifest.select("file")
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism * 2, "file").mapInArrow(read, schema)


def _rows(held: list[tuple]) -> pa.RecordBatch:
    page, url, size, digest, kind, refers = zip(*held) if held else ((),) * 6
    return table(page_id=pa.array(page, pa.int64()), url=pa.array(url, pa.string()), payload_bytes=pa.array(size, pa.int64()), payload_digest=pa.array(digest, pa.string()), record_type=pa.array(kind, pa.string()), refers_to=pa.array(refers, pa.int64()))


def archive(pages: DataFrame, smallest: int = 100) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder and read every record back."""
    folder = shared_dir(pages.sparkSession)
    manifest = materialize(write_archives(resolve(pages, smallest), folder))
    return read_archives(manifest, folder)
