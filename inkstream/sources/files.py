"""Media files under a folder: what they are, their hashes and their sizes in pixels, read from their bytes."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of each kind of media.
KINDS = {
    "image": ("avif", "gif", "jpeg", "jpg", "png", "svg", "webp"), "video": ("m4v", "mov", "mp4", "webm"),
    "audio": ("aac", "flac", "m4a", "mp3", "ogg", "wav"),
}
#: Bounds of a video's plausible size and shape.
LEAST, MOST, ASPECT = (160, 90), 16384, (0.25, 4.0)
ANY_ASPECT = (0.0, float("inf"))
TRACKS = (b"avc1", b"hev1", b"hvc1", b"vp09")
START_OF_FRAME = frozenset(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}

Size = tuple[int | None, int | None, str | None]


def png(data: bytes) -> Size:
    if len(data) >= 24 and data[12:16] == b"IHDR":
        return *struct.unpack(">II", data[16:24]), "png"
    return None, None, None


def gif(data: bytes) -> Size:
    return (*struct.unpack("<HH", data[6:10]), "gif") if len(data) >= 10 else (None, None, None)


def jpeg(data: bytes) -> Size:
    """The size in the first start-of-frame segment; segments are stepped over by their lengths."""
    at = 2
    while at + 9 <= len(data):
        if data[at] != 0xFF:
            break
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
        elif marker == 0x01 or 0xD0 <= marker <= 0xD8:
            at += 2
        elif marker in START_OF_FRAME:
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height, "jpeg"
        else:
            at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None, None


def webp(data: bytes) -> Size:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, "webp"
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, "webp"
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF, "webp"
    return None, None, None


def video(data: bytes, aspect: tuple[float, float] = ASPECT) -> Size:
    """The largest plausible size in a track header (the box's last eight bytes) or a sample description."""
    found: list[tuple[int, int]] = []

    def offer(width: int, height: int) -> None:
        if LEAST[0] <= width <= MOST and LEAST[1] <= height <= MOST and aspect[0] <= width / height <= aspect[1]:
            found.append((width, height))

    at = data.find(b"tkhd", 4)
    while at >= 0:
        start, head = at - 4, 8
        size = int.from_bytes(data[start:at], "big")
        if size == 1 and start + 16 <= len(data):
            size, head = int.from_bytes(data[start + 8 : start + 16], "big"), 16
        end = start + size if size else len(data)
        if head + 8 <= end - start and end <= len(data):
            width, height = struct.unpack(">II", data[end - 8 : end])
            offer((width + 0x8000) >> 16, (height + 0x8000) >> 16)
        at = data.find(b"tkhd", at + 1)
    for track in TRACKS:
        at = data.find(track, 4)
        while at >= 0:
            if at + 32 <= len(data):
                offer(*struct.unpack(">HH", data[at + 28 : at + 32]))
            at = data.find(track, at + 1)
    best = max(found, key=lambda s: s[0] * s[1], default=None)
    return (*best, None) if best else (None, None, None)


def measure(name: str, data: bytes, aspect: tuple[float, float] = ASPECT) -> Size:
    """Width, height and format, told by an image's first bytes and a video's extension; nulls where they aren't found.

    ``aspect`` bounds the shape of a video, width by height.
    """
    extension = name.rpartition(".")[2].lower()
    if extension in KINDS["image"]:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            size = png(data)
        elif data[:6] in (b"GIF87a", b"GIF89a"):
            size = gif(data)
        elif data.startswith(b"\xff\xd8"):
            size = jpeg(data)
        elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            size = webp(data)
        else:
            size = None, None, None
    elif extension in ("mp4", "mov", "m4v"):
        size = video(data, aspect)
    else:
        size = None, None, None
    return size[0], size[1], size[2] or extension


def media_kind(path: Column) -> Column:
    extension = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    kind = F.lit("other")
    for name, some in KINDS.items():
        kind = F.when(extension.isin(*some), name).otherwise(kind)
    return kind


def media_facts(files: DataFrame, aspect: tuple[float, float] = ASPECT) -> DataFrame:
    """path, kind, bytes, sha256, width, height, format of ``files`` (path, length, content); others than media are left out.

    A file is read whole into one task, as Spark's binary source gives it; its hash is taken beside the JVM's copy.
    """
    rows = files.withColumn("kind", media_kind(F.col("path"))).where("kind <> 'other'")
    rows = rows.select("path", "kind", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"), F.when(F.col("kind") != "audio", F.col("content")).alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [measure(p, c.as_py() or b"", aspect) for p, c in zip(batch.column("path").to_pylist(), batch.column("content"))]
            width, height, form = zip(*sizes) if sizes else ((), (), ())
            kept = {c: batch.column(c) for c in ("path", "kind", "bytes", "sha256")}
            more = {"width": pa.array(width, pa.int64()), "height": pa.array(height, pa.int64()), "format": pa.array(form, pa.string())}
            yield pa.RecordBatch.from_pydict(kept | more)

    return rows.mapInArrow(run, "path string, kind string, bytes long, sha256 string, width long, height long, format string")


def media_files(spark: SparkSession, folder: str, aspect: tuple[float, float] = ASPECT) -> DataFrame:
    """``media_facts`` of every file below ``folder``; paths are relative to it, with a slash ahead."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    root = F.lit(folder.rstrip("/").partition("://")[2] or folder.rstrip("/"))
    path = F.regexp_replace("path", "^[a-z0-9]+:(//[^/]*)?", "")
    return media_facts(found.withColumn("path", path.substr(F.length(F.regexp_replace(root, "^[^/]*", "")) + 1, F.length(path))), aspect)


def write_files(files: DataFrame, folder: str) -> int:
    """Write the rows of ``files`` (path, content) below ``folder``, each task its own, and count them.

    A path that occurs twice keeps one of its contents. A task that runs again writes the same files again.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                target = f"{root}/{path.lstrip('/')}"
                parent = target.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(target, compression=None) as stream:
                    stream.write(content)
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    return files.select("path", "content").mapInArrow(write, "n long").agg(F.sum("n").alias("n")).first().n or 0


def copies(files: DataFrame) -> DataFrame:
    """``files`` with ``copies``, how many share a hash, and ``first``, the smallest path among them."""
    groups = files.groupBy(F.col("sha256").alias("s")).agg(F.count(F.lit(1)).alias("copies"), F.min("path").alias("first"))
    return files.join(groups, F.col("sha256") == F.col("s")).drop("s")
