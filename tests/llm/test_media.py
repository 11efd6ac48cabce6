import hashlib
import struct
import zlib

import numpy as np
import pytest
from cases import ROWS, documents, nothing
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.llm import media as M


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=700))
def test_round_trip(raw):
    payload = M._padded(raw)
    image = M.decode_png(M.encode_png(payload))
    assert image.tobytes() == payload and image.shape[1] == 64


def png(rows):
    body = zlib.compress(rows.tobytes())
    return M.SIGNATURE + M._chunk(b"IHDR", struct.pack(">IIBBBBB", rows.shape[1] - 1, len(rows), 8, 0, 0, 0, 0)) + M._chunk(b"tEXt", b"a\0b") + M._chunk(b"IDAT", body) + M._chunk(b"IEND", b"")


def test_all_filters():
    rng = np.random.default_rng(0)
    image = rng.integers(0, 256, (23, 9))
    rows = np.zeros((23, 10), np.uint8)
    for y in range(23):
        kind = rows[y, 0] = y % 5 if y < 20 else 4
        for x in range(9):
            a, b, c = (int(image[y, x - 1]) if x else 0), (int(image[y - 1, x]) if y else 0), (int(image[y - 1, x - 1]) if x and y else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows[y, x + 1] = (image[y, x] - (0, a, b, (a + b) // 2, paeth)[kind]) % 256
    assert np.array_equal(M.decode_png(png(rows)), image)


def test_damage_is_found():
    good = bytearray(M.encode_png(M._padded(b"some text")))
    good[-20] ^= 1
    for bad in (bytes(good), bytes(good[:-15]), b"GIF89a" + bytes(60)):
        with pytest.raises(ValueError):
            M.decode_png(bad)


def test_cosine_hash_is_stable_under_noise_and_tells_images_apart():
    y, x = np.mgrid[0:64, 0:64]
    image = (100 + 80 * np.sin(x / 9) * np.cos(y / 13)).astype(np.uint8)
    near = np.clip(image + np.random.default_rng(0).integers(-3, 4, image.shape), 0, 255).astype(np.uint8)
    bits = lambda a, b: (int(M.cosine_hash(a), 16) ^ int(M.cosine_hash(b), 16)).bit_count()
    assert bits(image, near) <= 6 and bits(image, image.T) > 12
    basis = M._cosines(32, 32)
    assert np.allclose(basis @ basis.T, np.eye(32))


def test_query_columns(spark, sf):
    rows = M.from_media(M.to_media(documents(spark))).collect()
    assert len(rows) == len(ROWS)
    texts = sorted((i or -1, t or "") for i, t, _, _ in ROWS)
    for r, (i, t) in zip(sorted(rows, key=lambda r: r["doc_id"] or -1), texts, strict=True):
        raw = t.encode()
        assert (r["doc_id"] or -1, r["n_bytes"]) == (i, len(raw))
        assert bytes(r["payload"]) == raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
    assert len({bytes(r["media"]) for r in rows if r["doc_id"] in (1, 2)}) == 1
    assert M.from_media(M.to_media(nothing(spark))).collect() == []
    texts = {r["doc_id"]: r["text"].encode() for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in M.op5_media(spark, sf).collect():
        payload = M._padded(texts[r["doc_id"]])
        assert r["payload_bytes"] == len(payload) and r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-64:])
        media = M.encode_png(payload)
        assert r["media_bytes"] == len(media) and r["media_sha256"] == hashlib.sha256(media).hexdigest()
