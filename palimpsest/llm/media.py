"""Lossless PNG columns and perceptual hashes of them."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.arrow import small_batches, steps, utf8

SIGNATURE = b"\x89PNG\r\n\x1a\n"

#: Samples in a row of the image, side of the grid that is transformed, and of its low-frequency corner.
WIDTH, GRID, CORNER = 64, 32, 8

#: Data bytes in one IDAT chunk.
CHUNK = 1 << 16


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def encode_png(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """An 8-bit grey PNG whose samples are the payload, ``width`` to a row.

    Of the filters None, Sub and Up, the whole image gets the one with the
    smallest sum of absolute signed residuals.
    """
    raw = np.frombuffer(payload, np.uint8).reshape(-1, width)
    sub, up = raw.copy(), raw.copy()
    sub[:, 1:] -= raw[:, :-1]
    up[1:] -= raw[:-1]
    cost = [int(np.abs(x.view(np.int8).astype(np.int16)).sum()) for x in (raw, sub, up)]
    kind = int(np.argmin(cost))
    rows = np.empty((len(raw), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = (raw, sub, up)[kind]
    packed = zlib.compress(rows.tobytes(), level)
    body = b"".join(_chunk(b"IDAT", packed[i : i + CHUNK]) for i in range(0, len(packed), CHUNK))
    return SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(raw), 8, 0, 0, 0, 0)) + body + _chunk(b"IEND", b"")


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples of one byte each, from rows that begin with their filter's number."""
    kinds, image = rows[:, 0], rows[:, 1:].copy()
    edges = np.flatnonzero(np.diff(kinds)) + 1
    for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(kinds)], strict=True):
        kind, run = int(kinds[begin]), image[begin:end]
        if kind == 1:
            np.add.accumulate(run, axis=1, out=run)
        elif kind == 2:
            if begin:
                run[0] += image[begin - 1]
            np.add.accumulate(run, axis=0, out=run)
        elif kind in (3, 4):
            above = image[begin - 1] if begin else np.zeros(image.shape[1], np.uint8)
            for line in run:
                left = corner = 0
                for x in range(len(line)):
                    b = int(above[x])
                    if kind == 3:
                        guess = (left + b) // 2
                    else:
                        p = left + b - corner
                        guess = min((abs(p - left), 0, left), (abs(p - b), 1, b), (abs(p - corner), 2, corner))[2]
                    left = (int(line[x]) + guess) & 255
                    corner = b
                    line[x] = left
                above = line
        elif kind:
            raise ValueError(f"unknown filter {kind}")
    return image


def decode_png(media: bytes) -> np.ndarray:
    """The samples of an 8-bit grey PNG without interlace; raises ValueError where a chunk is damaged."""
    if media[:8] != SIGNATURE:
        raise ValueError("not a PNG")
    at, packed, head = 8, [], None
    while True:
        if at + 12 > len(media):
            raise ValueError("a chunk is cut off")
        (n,), kind = struct.unpack_from(">I", media, at), media[at + 4 : at + 8]
        data = media[at + 8 : at + 8 + n]
        if len(data) < n or media[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(kind + data)):
            raise ValueError(f"checksum of chunk {kind!r}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", data)
        elif kind == b"IDAT":
            packed.append(data)
        elif kind == b"IEND":
            break
    if head is None or head[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grey without interlace")
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8)
    return _unfilter(rows.reshape(head[1], head[0] + 1))


@lru_cache(maxsize=4)
def _cosines(n: int, keep: int) -> np.ndarray:
    """First rows of the orthonormal cosine transform of ``n`` samples."""
    k, x = np.arange(keep)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n)) * np.where(k == 0, np.sqrt(1 / n), np.sqrt(2 / n))


def _means(image: np.ndarray, n: int) -> np.ndarray:
    """Means of ``n`` bands of rows; rows repeat where there are fewer."""
    if len(image) < n:
        return image[np.arange(n) * len(image) // n].astype(np.float64)
    edges = np.arange(n + 1) * len(image) // n
    return np.add.reduceat(image, edges[:-1], axis=0, dtype=np.float64) / np.diff(edges)[:, None]


def cosine_hash(image: np.ndarray) -> str:
    """64 bits: which low-frequency cosine terms of the image, averaged to a grid, are above their median."""
    grid = _means(_means(image, GRID).T, GRID).T
    basis = _cosines(GRID, CORNER)
    terms = np.round(basis @ grid @ basis.T, 6).ravel()
    bits = terms > np.median(terms[1:])  # the mean brightness is no texture
    return np.packbits(bits).tobytes().hex()


def _padded(text: bytes) -> bytes:
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def to_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's UTF-8 bytes, with zero bytes up to a positive multiple of 64, as a PNG in the binary column ``media``.

    Gives the id column, ``n_bytes`` before padding, and ``media``. A null text
    is empty and so 64 zero bytes; ids may be null or repeat, every row gives one row;
    other columns are ignored. A step of a few MB of texts is held at a time.
    """
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, text_col):
            data, ends = utf8(batch.column(text_col))
            raw = data.tobytes()
            media = [encode_png(_padded(raw[a:b])) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(np.diff(ends), pa.int64()), pa.array(media, pa.binary())], names=[id_col, "n_bytes", "media"]
            )

    slim = small_batches(docs).select(id_col, F.col(text_col).cast("string").alias(text_col))
    return slim.mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def from_media(frame: DataFrame, media_col: str = "media") -> DataFrame:
    """Add what is read back from a column of PNGs: ``payload`` and the cosine hash ``feature``; both null for a null.

    A damaged file fails the job with the chunk's name.
    """
    schema = frame.schema.simpleString()[7:-1].replace(":", " ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                payloads, features = [], []
                for media in batch.column(media_col).to_pylist():
                    image = None if media is None else decode_png(media)
                    payloads.append(None if image is None else image.tobytes())
                    features.append(None if image is None else cosine_hash(image))
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(payloads, pa.binary()), pa.array(features, pa.string())], names=[*batch.schema.names, "payload", "feature"]
                )

    return frame.mapInArrow(run, f"{schema}, payload binary, feature string")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = from_media(to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    return stored.select(
        "doc_id",
        "n_bytes",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring("payload", -64, 64)).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


