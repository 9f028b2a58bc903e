"""Token ids in fixed-width packed files.

Each id takes ``bits`` bits, the fewest that hold the vocabulary. Ids are stored in blocks of ``BLOCK`` ids; a footer
holds each block's byte offset and each document's id range, so any document is read by seeking to its blocks.

File: magic, packed blocks, footer (documents as int64 triples id, first token, count; then int64 block offsets),
trailer (bits, documents, tokens, blocks, footer offset as int64; magic).
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from inkstream.llm.common import doc_rows, materialize, partitions, shared_dir, ship, sliced, table, texts

MAGIC = b"INKTOK01"
BLOCK = 4096
TRAILER = 5 * 8 + len(MAGIC)


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids as little-endian bit fields of ``bits`` bits each, padded to a whole byte."""
    if bits in (8, 16, 32):
        return ids.astype(f"<u{bits // 8}").tobytes()
    fields = (ids[:, None].astype(np.uint64) >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
    return np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, count: int, bits: int) -> np.ndarray:
    if bits in (8, 16, 32):
        return np.frombuffer(data, f"<u{bits // 8}", count).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits, bitorder="little").reshape(count, bits)
    return (fields.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(axis=1, dtype=np.uint32)


class Writer:
    """Appends documents to one file."""

    def __init__(self, stream, bits: int):
        self.stream, self.bits = stream, bits
        self.docs: list[tuple[int, int, int]] = []
        self.offsets: list[int] = []
        self.tokens, self.at = 0, len(MAGIC)
        self.held = np.empty(0, np.uint32)
        stream.write(MAGIC)

    def add(self, doc_ids: list[int], counts: list[int], ids: np.ndarray) -> None:
        """``ids`` holds the ids of all ``doc_ids``, one document after the other."""
        for doc_id, count in zip(doc_ids, counts):
            self.docs.append((doc_id, self.tokens, count))
            self.tokens += count
        held = np.concatenate([self.held, ids])
        whole = len(held) // BLOCK * BLOCK
        for i in range(0, whole, BLOCK):
            self._block(held[i : i + BLOCK])
        self.held = held[whole:]

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.offsets.append(self.at)
        self.stream.write(data)
        self.at += len(data)

    def close(self) -> None:
        if len(self.held):
            self._block(self.held)
        self.stream.write(np.array(self.docs, "<i8").reshape(-1, 3).tobytes() + np.array(self.offsets, "<i8").tobytes())
        self.stream.write(np.array([self.bits, len(self.docs), self.tokens, len(self.offsets), self.at], "<i8").tobytes() + MAGIC)
        self.stream.close()


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, source):
        self.source = source
        source.seek(source.size() - TRAILER)
        trailer = source.read(TRAILER)
        if trailer[-len(MAGIC) :] != MAGIC:
            raise ValueError("not a token file")
        self.bits, n_docs, self.tokens, n_blocks, footer = np.frombuffer(trailer, "<i8", 5).tolist()
        source.seek(footer)
        data = source.read(n_docs * 24 + n_blocks * 8)
        self.docs = np.frombuffer(data, "<i8", n_docs * 3).reshape(-1, 3)
        self.offsets = np.frombuffer(data, "<i8", n_blocks, n_docs * 24)
        self.end = footer

    def ids(self, first: int, count: int) -> np.ndarray:
        """Ids ``first`` to ``first + count`` of the file, reading only their blocks."""
        if not count:
            return np.empty(0, np.uint32)
        a, b = first // BLOCK, (first + count - 1) // BLOCK
        start = int(self.offsets[a])
        stop = int(self.offsets[b + 1]) if b + 1 < len(self.offsets) else self.end
        self.source.seek(start)
        held = min((b + 1) * BLOCK, self.tokens) - a * BLOCK
        return unpack(self.source.read(stop - start), held, self.bits)[first - a * BLOCK :][:count]


class WordEncoder:
    """Encodes white-space-free stretches with the tokenizers library and remembers their ids.

    Only for tokenizers that drop white space before they split, as the ids of a text are then those of its stretches
    in turn. ``limit`` bounds what is remembered.
    """

    def __init__(self, path: str, limit: int = 1_000_000, group: int = 200):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a worker for each core
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if "\\s" not in json.dumps(spec["pre_tokenizer"]) or '"Removed"' not in json.dumps(spec["pre_tokenizer"]):
            raise ValueError("this tokenizer keeps white space")
        self.tokenizer, self.limit, self.group, self.known = Tokenizer.from_file(path), limit, group, {}

    def learn(self, new: list[bytes]) -> None:
        """Encode words, many joined by spaces at a time; a token's offset tells its word."""
        for i in range(0, len(new), 100 * self.group):
            some = [x.decode() for x in new[i : i + 100 * self.group]]
            groups = [some[j : j + self.group] for j in range(0, len(some), self.group)]
            for words, e in zip(groups, self.tokenizer.encode_batch(list(map(" ".join, groups)), add_special_tokens=False)):
                starts = np.cumsum([0, *[len(w) + 1 for w in words]])
                cuts = np.searchsorted([a for a, _ in e.offsets], starts).tolist()
                ids = np.array(e.ids, "<u4").tobytes()
                self.known.update(zip([w.encode() for w in words], [ids[4 * a : 4 * b] for a, b in zip(cuts, cuts[1:])]))

    def encode(self, batch: list[bytes]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        words = [x.replace(b"\n", b" ").split(b" ") for x in batch]
        if len(self.known) > self.limit:
            self.known = {}
        found = [list(map(self.known.get, x)) for x in words]
        holes = [k for k, x in enumerate(found) if None in x]
        self.learn(list({w for k in holes for w, ids in zip(words[k], found[k]) if ids is None}))
        for k in holes:
            found[k] = list(map(self.known.__getitem__, words[k]))
        return list(map(b"".join, found))


_ENCODERS: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, folder: str) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and write files in ascending doc_id order; one manifest row for each file.

    Rows with equal doc_id keep the order of their texts; a null doc_id sorts first and is stored as -1; a null or
    empty text has only the end id. An empty table gives no file.
    """
    ship(docs.sparkSession)
    from tokenizers import Tokenizer

    bits = bits_for(Tokenizer.from_file(tokenizer).get_vocab_size())
    end = np.uint32(end_id).tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        writer, no = None, TaskContext.get().partitionId()
        for batch in sliced(batches, "text"):
            if writer is None:
                store, path = fs.FileSystem.from_uri(folder)
                store.create_dir(path, recursive=True)
                name = f"{path}/{no:06d}-{uuid.uuid4().hex}.tok"
                writer = Writer(store.open_output_stream(name), bits)
            ids = [x + end for x in _encoder(tokenizer).encode(texts(batch))]
            writer.add([-1 if i is None else i for i in batch.column("doc_id").to_pylist()], [len(x) // 4 for x in ids], np.frombuffer(b"".join(ids), "<u4"))
        if writer is not None:
            writer.close()
            yield table(file_no=pa.array([no], pa.int64()), file=[name.rpartition("/")[2]], n_docs=pa.array([len(writer.docs)], pa.int64()), tokens=pa.array([writer.tokens], pa.int64()))

    ordered = doc_rows(docs, "doc_id", "text").repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    return ordered.mapInArrow(write, "file_no long, file string, n_docs long, tokens long")


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Each document of the files named by ``manifest``: doc_id, start, n_tokens, ids_crc32 and the file that holds it.

    Only the manifest, one row for each file, comes to the driver.
    """
    spark, start, files = manifest.sparkSession, 0, []
    for row in sorted(manifest.collect(), key=lambda r: r.file_no):
        files.append(Row(file=row.file, first=start))
        start += row.tokens

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with store.open_input_file(f"{path}/{row['file']}") as source:
                    reader = Reader(source)
                    for i in range(0, len(reader.docs), 2000):
                        part = reader.docs[i : i + 2000]
                        low = int(part[0, 1])
                        data = reader.ids(low, int(part[:, 2].sum())).astype("<u4").tobytes()
                        crc = [zlib.crc32(data[4 * (s - low) : 4 * (s - low + n)]) for _, s, n in part.tolist()]
                        yield table(doc_id=pa.array([None if x == -1 else x for x in part[:, 0].tolist()], pa.int64()), start=pa.array(part[:, 1] + row["first"], pa.int64()), n_tokens=pa.array(part[:, 2], pa.int64()), ids_crc32=pa.array(crc, pa.int64()), file=[row["file"]] * len(part))

    names = spark.createDataFrame(files, "file string, first long")
    if files:
        names = names.repartition(len(files), F.col("first"))
    return names.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long, file string")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write ``docs`` as packed token files in the shared folder and read every document back from them."""
    folder = shared_dir(docs.sparkSession)
    manifest = materialize(write_token_files(docs, tokenizer, end_id, folder))
    return read_token_files(manifest, folder)
