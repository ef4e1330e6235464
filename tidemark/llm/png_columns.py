"""Greyscale PNG images in binary columns: writing, checked reading, cosine-transform hashes.

A file is a signature and a run of chunks, each with a CRC over its type and
body. The image data are zlib chunks of filtered rows; reading undoes the
filters with numpy and refuses anything whose checksums, sizes or types are off.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textbytes import small_batches, whole_text

WIDTH = 64
SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Bytes of image data in one chunk.
CHUNK = 1 << 16
#: Rows that a cosine transform looks at, and low frequencies it keeps on each axis.
GRID, LOW = 32, 8


class BadImage(ValueError):
    """The bytes are not an image that can be read whole."""


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(body, zlib.crc32(kind)))


def _differences(x: np.ndarray) -> int:
    """The sum of absolute values of all filtered samples, read as signed."""
    return int(np.minimum(x, np.negative(x)).sum(dtype=np.int64))


def write_png(samples: np.ndarray, level: int = 1) -> bytes:
    """A lossless 8-bit greyscale file of a 2-D array; one row filter for the image, by least sum of differences."""
    height, width = samples.shape
    left, above = samples.copy(), samples.copy()
    left[:, 1:] -= samples[:, :-1]
    above[1:] -= samples[:-1]
    tried = (samples, left, above)
    kind = int(np.argmin([_differences(x) for x in tried]))
    rows = np.empty((height, width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = tried[kind]
    packed = zlib.compress(rows.tobytes(), level)
    data = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + data + _chunk(b"IEND", b"")


def chunks_of(file: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(type, body) of each chunk, after its checksum has been tested."""
    if file[:8] != SIGNATURE:
        raise BadImage("signature")
    at = 8
    while at < len(file):
        if at + 12 > len(file):
            raise BadImage("cut short")
        (n,) = struct.unpack_from(">I", file, at)
        kind, body, end = file[at + 4 : at + 8], file[at + 8 : at + 8 + n], at + 12 + n
        if end > len(file) or struct.unpack_from(">I", file, end - 4)[0] != zlib.crc32(body, zlib.crc32(kind)):
            raise BadImage(f"checksum of {kind!r}")
        yield kind, body
        at = end
        if kind == b"IEND":
            break
    else:
        raise BadImage("no end")
    if at != len(file):
        raise BadImage("bytes after the end")


def unfilter(rows: np.ndarray) -> np.ndarray:
    """Undoes the row filters of a (height, 1 + width) array of one-byte samples."""
    height, width = rows.shape[0], rows.shape[1] - 1
    out = np.empty((height, width), np.uint8)
    cuts = np.flatnonzero(np.diff(rows[:, 0])) + 1
    for lo, hi in zip([0, *cuts], [*cuts, height], strict=True):  # runs of rows under one filter
        kind, part = int(rows[lo, 0]) if height else 0, rows[lo:hi, 1:]
        above = out[lo - 1] if lo else np.zeros(width, np.uint8)
        if kind == 0:
            out[lo:hi] = part
        elif kind == 1:
            np.cumsum(part, axis=1, dtype=np.uint8, out=out[lo:hi])
        elif kind == 2:
            np.cumsum(part, axis=0, dtype=np.uint8, out=out[lo:hi])
            out[lo:hi] += above
        elif kind in (3, 4):
            for y in range(lo, hi):
                up, left, corner = (out[y - 1] if y else np.zeros(width, np.uint8)).tolist(), 0, 0
                line = rows[y, 1:].tolist()
                for x, b in enumerate(up):
                    if kind == 3:
                        guess = (left + b) >> 1
                    else:
                        at = left + b - corner
                        guess = min((left, b, corner), key=lambda v: abs(at - v))
                        corner = b
                    line[x] = left = (line[x] + guess) & 255
                out[y] = line
        else:
            raise BadImage(f"filter {kind}")
    return out


def read_png(file: bytes) -> np.ndarray:
    """The samples of a greyscale 8-bit file without interlace."""
    head, data = None, []
    for kind, body in chunks_of(file):
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind != b"IEND" and not kind[0] & 32:
            raise BadImage(f"unknown critical chunk {kind!r}")
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise BadImage("not 8-bit greyscale")
    width, height = head[:2]
    unpack = zlib.decompressobj()
    try:
        raw = unpack.decompress(b"".join(data), height * (width + 1) + 1)
    except zlib.error as e:
        raise BadImage(str(e)) from e
    if len(raw) != height * (width + 1) or not unpack.eof:
        raise BadImage("size of the image data")
    return unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


def _cosines(n: int) -> np.ndarray:
    k, x = np.arange(LOW + 1)[:, None], np.arange(n)[None]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


_COSINES = _cosines(GRID)


def shrink(samples: np.ndarray) -> np.ndarray:
    """GRID x GRID means of near-equal rectangles, whole image covered; small images repeat samples."""
    out = samples.astype(np.float64)
    for _ in range(2):
        n = len(out)
        at = np.arange(GRID + 1) * n // GRID
        sums = np.vstack([np.zeros((1, out.shape[1])), np.cumsum(out, axis=0)])
        hi = np.maximum(at[1:], at[:-1] + 1)
        out = ((sums[hi] - sums[at[:-1]]) / (hi - at[:-1])[:, None]).T
    return out


def cosine_hash(samples: np.ndarray) -> str:
    """16 hex digits: which low frequencies (constant row and column apart) lie over their median."""
    low = (_COSINES @ shrink(samples) @ _COSINES.T)[1:, 1:].ravel()
    low = np.round(low, 6)
    return np.packbits(low > np.median(low)).tobytes().hex()


def text_image(text: bytes) -> np.ndarray:
    """The bytes of a text as rows of WIDTH samples, zeros appended up to a whole positive number of rows."""
    height = max(1, -(-len(text) // WIDTH))
    return np.frombuffer(text.ljust(height * WIDTH, b"\0"), np.uint8).reshape(height, WIDTH)


def store_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a PNG in a binary column.

    Null texts are stored as empty (one row of zeros); a text of any length is
    one image; one row for each input row; other columns are not read.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).alias("doc_id"), whole_text(text_column).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, texts), pa.int64()), pa.array([write_png(text_image(x), level) for x in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


def read_media(stored: DataFrame, media_column: str = "media") -> DataFrame:
    """The stored rows with what is read back from their media.

    Added: width, height, payload (all samples, row by row), payload_sha256,
    tail_crc32 (the last 64 bytes), media_bytes, media_sha256, feature, error.
    A null or damaged image gives nulls and says why in `error`; rows are never
    dropped. Columns of those names in the input are replaced.
    """
    small_batches(stored.sparkSession)
    made = {"width": "integer", "height": "integer", "payload": "binary", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string", "error": "string"}
    kept = [c for c in stored.columns if c not in made]
    rows = stored.select(*[F.col(f"`{c}`") for c in kept])
    at = kept.index(media_column)
    schema = T.StructType(list(rows.schema.fields))
    for name, kind in made.items():
        schema = schema.add(name, kind)

    def look(file: bytes | None) -> dict:
        if file is None:
            return {"error": "null"}
        out = {"media_bytes": len(file), "media_sha256": hashlib.sha256(file).hexdigest()}
        try:
            samples = read_png(file)
        except (BadImage, struct.error) as e:
            return out | {"error": str(e)}
        payload = samples.tobytes()
        return out | {"width": samples.shape[1], "height": samples.shape[0], "payload": payload, "payload_sha256": hashlib.sha256(payload).hexdigest(), "tail_crc32": zlib.crc32(payload[-64:]), "feature": cosine_hash(samples)}

    kinds = dict(zip(made, (pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen = [look(x) for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x.get(n) for x in seen], k) for n, k in kinds.items())], [*kept, *made])

    return rows.mapInArrow(run, schema)
