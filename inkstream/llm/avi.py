"""Media columns: AVI files of motion-JPEG frames, with shots found from their pictures.

Payloads are stored without loss as coefficients of 8-bit baseline JPEG. A block of 64 bytes becomes the 64 quantised
coefficients of one 8 x 8 block, a unit of three blocks one restart interval. Coefficients of magnitude 128 to 255 all
belong to Huffman category 8, whose eight extra bits then are the byte itself, so a unit is 192 codes of nine bits.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from inkstream.llm.common import doc_rows, ship, sliced, table, texts

UNIT = 192
WIDE = HIGH = 4  # units in a frame, each way
FRAME = WIDE * HIGH
RATE = 25
PAD = b"\xaa\xaf"  # a unit whose blocks have no coefficients
PACKED = UNIT * 9 // 8
BINS = 16


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _zigzag() -> np.ndarray:
    """Natural position of each coefficient in scan order: diagonals in turn, every other one upwards."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else -x[0]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
#: Row k of this matrix is the k-th cosine of the inverse transform.
COSINE = np.array([[np.cos((2 * x + 1) * k * np.pi / 16) * (np.sqrt(0.125) if k == 0 else 0.5) for x in range(8)] for k in range(8)])
#: One code of one bit for category 8, one of two bits for nothing.
CODE_LENGTHS = bytes([1, 1] + [0] * 14)
HEADER = b"".join(
    [
        b"\xff\xd8",
        _segment(0xDB, b"\x00" + b"\x01" * 64),
        _segment(0xC0, struct.pack(">BHHB", 8, HIGH * 8, WIDE * 8, 3) + b"".join(bytes([i, 0x11, 0]) for i in (1, 2, 3))),
        _segment(0xC4, b"\x00" + CODE_LENGTHS + b"\x08\x00"),
        _segment(0xC4, b"\x10" + CODE_LENGTHS + b"\x08\x00"),
        _segment(0xDD, struct.pack(">H", 1)),
        _segment(0xDA, b"\x03" + b"".join(bytes([i, 0]) for i in (1, 2, 3)) + b"\x00\x3f\x00"),
    ]
)


def padded(data: bytes) -> bytes:
    """``data`` with spaces up to a positive multiple of ``UNIT``."""
    return data.ljust(max(1, -(-len(data) // UNIT)) * UNIT, b" ")


def _chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def _list(kind: bytes, body: bytes) -> bytes:
    return _chunk(b"LIST", kind + body)


def container(frames: list[bytes], payload: int) -> bytes:
    """An AVI file of ``frames`` with an index; ``payload`` is kept as the stream's codec data."""
    most, wide, high = max(map(len, frames)), WIDE * 8, HIGH * 8
    avih = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, wide, high, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, wide, high)
    strf = struct.pack("<IiiHH4sIiiII", 40, wide, high, 1, 24, b"MJPG", wide * high * 3, 0, 0, 0, 0)
    strl = _list(b"strl", _chunk(b"strh", strh) + _chunk(b"strf", strf) + _chunk(b"strd", struct.pack("<Q", payload)))
    chunks, index, at = [], [], 4
    for frame in frames:
        chunk = _chunk(b"00dc", frame)
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(frame)))
        chunks.append(chunk)
        at += len(chunk)
    body = b"AVI " + _list(b"hdrl", _chunk(b"avih", avih) + strl) + _list(b"movi", b"".join(chunks)) + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def write_avi(payloads: list[bytes]) -> list[bytes]:
    """One file for each payload, whose lengths are positive multiples of ``UNIT``."""
    units = np.frombuffer(b"".join(payloads), np.uint8).reshape(-1, UNIT)
    bits = np.zeros((len(units), UNIT, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(units, axis=1).reshape(-1, UNIT, 8)
    coded = np.packbits(bits.reshape(len(units), -1), axis=1)
    whole, at = [], 0
    for payload in payloads:
        mine, frames = coded[at : at + len(payload) // UNIT], []
        at += len(mine)
        for i in range(0, len(mine), FRAME):
            part = [x.tobytes().replace(b"\xff", b"\xff\x00") for x in mine[i : i + FRAME]]
            part += [PAD] * (FRAME - len(part))
            frames.append(HEADER + b"".join(x + b"\xff" + bytes([0xD0 + k % 8]) for k, x in enumerate(part))[:-2] + b"\xff\xd9")
        whole.append(container(frames, len(payload)))
    return whole


def chunks_of(data: bytes, start: int, stop: int) -> Iterator[tuple[bytes, int, int]]:
    """Kind, start and length of each RIFF chunk's body in ``data[start:stop]``."""
    while start + 8 <= stop:
        kind, size = struct.unpack_from("<4sI", data, start)
        yield kind, start + 8, size
        start += 8 + size + size % 2


def read_avi(data: bytes) -> tuple[int, float, list[bytes]]:
    """Codec data as a number, seconds a frame, and the frames found through the index (or in order without one)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    payload, step, movi, index, loose = 0, 1 / RATE, 0, [], []
    todo = [(12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]))]
    while todo:
        for kind, at, size in chunks_of(data, *todo.pop()):
            if kind == b"LIST":
                movi = at if data[at : at + 4] == b"movi" else movi
                todo.append((at + 4, at + size))
            elif kind == b"avih":
                step = struct.unpack_from("<I", data, at)[0] / 1e6
            elif kind == b"strd" and size >= 8:
                payload = struct.unpack_from("<Q", data, at)[0]
            elif kind == b"idx1":
                index = [x[2:] for x in struct.iter_unpack("<4sIII", data[at : at + size - size % 16]) if x[0][2:] in (b"dc", b"db")]
            elif kind[2:] in (b"dc", b"db"):
                loose.append((at, size))
    spans = sorted(loose) if not index else [(movi + at + 8, size) for at, size in index]
    return payload, step, [data[a : a + n] for a, n in spans]


@cache
def tables_of(lengths: bytes, symbols: bytes) -> dict[str, int]:
    """Symbol of each Huffman code, written as a string of bits."""
    codes, code, k = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            codes[format(code, f"0{n}b")] = symbols[k]
            code, k = code + 1, k + 1
        code <<= 1
    return codes


def decode_frame(jpeg: bytes) -> tuple[int, int, list[dict], list[np.ndarray]]:
    """Height, width, components and their quantised coefficients (blocks x 64, in scan order) of a baseline JPEG."""
    at, quant, huff, parts, restart = 2, {}, {}, [], 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body, at = jpeg[at + 4 : at + 2 + size], at + 2 + size
        if marker == 0xDB:
            while body:
                wide = 2 if body[0] >> 4 else 1
                quant[body[0] & 15] = np.frombuffer(body[1 : 1 + 64 * wide], ">u2" if wide == 2 else "u1").astype(np.int64)
                body = body[1 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                huff[body[0]] = tables_of(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker in (0xC0, 0xC1):
            high, wide, n = struct.unpack_from(">HHB", body, 1)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(n)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            for i in range(body[0]):
                part = next(p for p in parts if p["id"] == body[1 + 2 * i])
                part |= {"dc": huff[body[2 + 2 * i] >> 4], "ac": huff[16 + (body[2 + 2 * i] & 15)]}
            break
    across = -(-wide // (8 * max(p["h"] for p in parts)))
    units = across * -(-high // (8 * max(p["v"] for p in parts)))
    for p in parts:
        p |= {"quant": quant[p["q"]], "across": across * p["h"]}
    found: list[list] = [[] for _ in parts]
    for k, run in enumerate(_intervals(jpeg[at:])):
        bits, at = "".join(format(b, "08b") for b in run), 0
        before = [0] * len(parts)
        for _ in range(min(restart or units, units - k * (restart or units))):
            for i, p in enumerate(parts):
                for _ in range(p["h"] * p["v"]):
                    block, at = _block(bits, at, p["dc"], p["ac"])
                    before[i] = block[0] = block[0] + before[i]
                    found[i].append(block)
    return high, wide, parts, [np.array(x, np.int64) for x in found]


def _intervals(scan: bytes) -> list[bytes]:
    """Entropy-coded bytes between restart markers, without stuffing."""
    runs, start, i = [], 0, scan.find(b"\xff")
    while i >= 0 and scan[i + 1] != 0xD9:
        if 0xD0 <= scan[i + 1] <= 0xD7:
            runs.append(scan[start:i])
            start = i + 2
        i = scan.find(b"\xff", i + 2)
    return [x.replace(b"\xff\x00", b"\xff") for x in [*runs, scan[start : len(scan) if i < 0 else i]]]


def _block(bits: str, at: int, dc: dict[str, int], ac: dict[str, int]) -> tuple[list[int], int]:
    block, k = [0] * 64, 0
    while k < 64:
        codes, n = (ac if k else dc), 1
        while (symbol := codes.get(bits[at : at + n])) is None:
            n += 1
            if n > 16:
                raise ValueError("broken entropy-coded data")
        at += n
        size = symbol & 15
        if k:
            if symbol == 0:
                break
            k += symbol >> 4
        if size:
            value = int(bits[at : at + size], 2)
            block[k] = value if value >> (size - 1) else value - (1 << size) + 1
            at += size
        k += 1
    return block, at


def luma(blocks: np.ndarray) -> np.ndarray:
    """Pixels 0 to 255 of dequantised blocks (n x 64, in scan order) as n x 8 x 8."""
    natural = np.zeros(blocks.shape, np.float32)
    natural[:, ZIGZAG] = blocks
    cosine = COSINE.astype(np.float32)
    rows = (natural.reshape(-1, 8) @ cosine).reshape(-1, 8, 8)
    return np.clip(np.rint(rows.transpose(0, 2, 1).reshape(-1, 8) @ cosine).reshape(-1, 8, 8) + 128, 0, 255).astype(np.uint8)


def _units(frames: list[bytes], total: int) -> tuple[np.ndarray, bool]:
    """Packed units of a file's frames where they have this module's own layout throughout."""
    kept = []
    for i, frame in enumerate(frames):
        n = min(FRAME, total - i * FRAME)
        rest = (FRAME - n) * (len(PAD) + 2)
        if len(frame) != len(HEADER) + n * (PACKED + 2) + rest or not frame.startswith(HEADER):
            return np.empty((0, PACKED), np.uint8), False
        unit = np.frombuffer(frame, np.uint8, n * (PACKED + 2), len(HEADER)).reshape(n, PACKED + 2)
        kept.append(unit[:, :PACKED])
        if (unit[:, :PACKED] == 0xFF).any():
            return np.empty((0, PACKED), np.uint8), False
    return np.concatenate(kept) if kept else np.empty((0, PACKED), np.uint8), bool(kept)


def decode_all(files: list[bytes]) -> list[tuple[bytes, float, np.ndarray]]:
    """Payload, seconds a frame and luma histograms (frames x BINS) of each file.

    Frames of this module's layout are unpacked together; any other baseline frame is decoded code by code, and has no
    payload unless all its coefficients are of the stored kind.
    """
    read = [read_avi(x) for x in files]
    plain = [_units(frames, size // UNIT) for size, _, frames in read]
    packed = np.concatenate([u for u, _ in plain])
    bits = np.unpackbits(packed, axis=1).reshape(-1, UNIT, 9)
    if bits[:, :, 0].any():
        raise ValueError("a unit holds a code that was not written here")
    units = np.packbits(bits[:, :, 1:].reshape(len(packed), UNIT * 8), axis=1)
    first = units[:, :64].astype(np.int16)
    pixels = luma(np.where(first < 128, first - 255, first))
    out, at = [], 0
    for (size, step, frames), (mine, own) in zip(read, plain):
        if own:
            n = len(mine)
            bins = pixels[at : at + n].reshape(n, 64) >> 4
            frame = np.repeat(np.arange(n) // FRAME, 64) * BINS
            counts = np.bincount(frame + bins.ravel(), minlength=len(frames) * BINS).reshape(-1, BINS)
            counts[-1, 128 * BINS // 256] += (len(frames) * FRAME - n) * 64
            out.append((units[at : at + n].tobytes(), step, counts))
            at += n
        else:
            payload, counts = [], []
            for jpeg in frames:
                high, wide, parts, blocks = decode_frame(jpeg)
                pixel = luma(blocks[0] * parts[0]["quant"])
                counts.append(np.bincount(pixel.ravel() >> 4, minlength=BINS))
                if len({len(b) for b in blocks}) == 1 and len(blocks) == 3:
                    stored = np.stack(blocks, 1).reshape(-1, UNIT)
                    stored = stored[(np.abs(stored) >= 128).all(1) & (np.abs(stored) < 256).all(1)]
                    payload.append(np.where(stored < 0, stored + 255, stored).astype(np.uint8).tobytes())
            out.append((b"".join(payload)[:size], step, np.array(counts).reshape(-1, BINS)))
    return out


def shots(counts: np.ndarray, window: int = 8, spread: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """First and last frame of each shot.

    A cut is where the histogram distance (0 to 1) exceeds ``least`` and the mean of the ``window`` distances before it
    by ``spread`` standard deviations.
    """
    if not len(counts):
        return []
    share = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    gaps = np.abs(np.diff(share, axis=0)).sum(1) / 2
    starts, since = [0], 0
    for i, gap in enumerate(gaps.tolist()):
        past = gaps[max(since, i - window) : i]
        if gap > least and len(past) >= 2 and gap > past.mean() + spread * past.std():
            starts.append(i + 1)
            since = i + 1
    return list(zip(starts, [*[s - 1 for s in starts[1:]], len(counts) - 1]))


def media_column(docs: DataFrame, *keep: str) -> DataFrame:
    """``keep`` columns of documents with n_bytes and ``media``, an AVI file of the text. A null text counts as empty."""
    ship(docs.sparkSession)
    docs = doc_rows(docs, *keep, "text")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text", 2 << 20):
            data = texts(batch)
            yield table(**{c: batch.column(c) for c in keep}, n_bytes=pa.array(map(len, data), pa.int64()), media=pa.array(write_avi(list(map(padded, data))), pa.binary()))

    return docs.mapInArrow(write, f"{fields}, n_bytes long, media binary")


def clips(media: DataFrame, *keep: str) -> DataFrame:
    """Timed clip rows of a media column: clip number, first and last frame, start and end in seconds.

    A null media value gives no rows.
    """
    ship(media.sparkSession)
    media = doc_rows(media, *keep, "media").where("media IS NOT NULL")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media", 2 << 20):
            kept = batch.select(list(keep)).to_pylist()
            rows = [(i, k, a, b, step) for i, (_, step, counts) in enumerate(decode_all(batch.column("media").to_pylist())) for k, (a, b) in enumerate(shots(counts))]
            yield table(
                **{c: pa.array([kept[r[0]][c] for r in rows], batch.column(c).type) for c in keep},
                clip=pa.array([r[1] for r in rows], pa.int64()), first_frame=pa.array([r[2] for r in rows], pa.int64()), last_frame=pa.array([r[3] for r in rows], pa.int64()),
                start_s=pa.array([r[2] * r[4] for r in rows], pa.float64()), end_s=pa.array([(r[3] + 1) * r[4] for r in rows], pa.float64()),
            )

    return media.mapInArrow(read, f"{fields}, clip long, first_frame long, last_frame long, start_s double, end_s double")


def features(media: DataFrame, *keep: str) -> DataFrame:
    """Digests of each stored file and its payload, and its clips and mean histogram as a string."""
    ship(media.sparkSession)
    media = doc_rows(media, *keep, "media")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in media.select(*keep).schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "media", 2 << 20):
            files = batch.column("media").to_pylist()
            decoded = decode_all(files)
            payloads = [p for p, _, _ in decoded]
            told = []
            for _, step, counts in decoded:
                spans = ",".join(f"{a * step:.2f}-{(b + 1) * step:.2f}" for a, b in shots(counts))
                told.append(f"frames={len(counts)};clips={spans};bins={','.join(map(str, (counts.sum(0) * 1000 // max(1, counts.sum())).tolist()))}")
            yield table(
                **{c: batch.column(c) for c in keep},
                payload_bytes=pa.array(map(len, payloads), pa.int64()),
                payload_sha256=pa.array([hashlib.sha256(p).hexdigest() for p in payloads], pa.string()),
                tail_crc32=pa.array([zlib.crc32(p[-16:]) for p in payloads], pa.int64()),
                media_bytes=pa.array(map(len, files), pa.int64()),
                media_sha256=pa.array([hashlib.sha256(x).hexdigest() for x in files], pa.string()),
                feature=pa.array(told, pa.string()),
            )

    return media.mapInArrow(read, f"{fields}, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
