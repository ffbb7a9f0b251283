"""PNG files against an independent reading of the format, and their features."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from spindrift.llm import media
from tests.llm.conftest import ODD


def payload(text):
    raw = (text or "").encode()
    return raw + b"\xff" * (-len(raw) % 576 or (576 if not raw else 0))


def test_round_trip(odd, empty):
    want = [(r.doc_id, payload(r.text), len((r.text or "").encode())) for r in odd.select("doc_id", "text").collect()]
    got = media.digests(odd).collect()
    assert sorted((r.doc_id, r.payload_sha256, r.payload_bytes, r.n_bytes, r.tail_crc32) for r in got if r.doc_id is not None) == sorted((d, hashlib.sha256(p).hexdigest(), len(p), n, zlib.crc32(p[-32:])) for d, p, n in want if d is not None)
    assert len(got) == len(want) and all(len(r.feature) == 16 for r in got)
    files = {r.doc_id: r.media for r in media.to_png(odd).collect()}
    assert all(hashlib.sha256(files[r.doc_id]).hexdigest() == r.media_sha256 and len(files[r.doc_id]) == r.media_bytes for r in got)
    assert media.digests(empty).count() == 0


@pytest.mark.parametrize("kinds", [[0], [1], [2], [3], [4], [0, 1, 2, 3, 4], [2, 2, 1, 4, 4, 3]])
def test_all_row_filters(kinds):
    """Filtered sample by sample as the format says, then read back."""
    rng = random.Random(2)
    x = [[rng.randrange(256) if rng.random() < 0.5 else 9 for _ in range(13)] for _ in range(12)]
    rows = b""
    for y, line in enumerate(x):
        kind = kinds[y % len(kinds)]
        rows += bytes([kind])
        for i, v in enumerate(line):
            a, b, c = (line[i - 1] if i else 0), (x[y - 1][i] if y else 0), (x[y - 1][i - 1] if y and i else 0)
            p = a + b - c
            paeth = a if abs(p - a) <= abs(p - b) and abs(p - a) <= abs(p - c) else b if abs(p - b) <= abs(p - c) else c
            rows += bytes([(v - [0, a, b, (a + b) // 2, paeth][kind]) % 256])
    head = (13).to_bytes(4) + (12).to_bytes(4) + bytes([8, 0, 0, 0, 0])
    data = media._SIGN + media._chunk(b"IHDR", head) + media._chunk(b"tEXt", b"k\0v") + media._chunk(b"IDAT", zlib.compress(rows)) + media._chunk(b"IEND", b"")
    assert media.read_png(data).tolist() == x


def test_writer_uses_differences():
    line = bytes(range(200)) * 3
    p = line[:576] * 50 + b"a" * 576 * 50
    f = media.write_png(p)
    assert media.read_png(f).tobytes() == p and len(f) < 2000


def test_broken_files(spark):
    good = media.write_png(payload(ODD[6]))
    flipped = bytearray(good)
    flipped[60] ^= 1
    rows = [(1, good), (2, bytes(flipped)), (3, good[:-6]), (4, b"GIF89a"), (5, None)]
    got = {r.doc_id: r for r in media.from_png(spark.createDataFrame(rows, "doc_id long, media binary")).collect()}
    assert got[1].problem is None and all(got[k].problem and got[k].hash is None for k in (2, 3, 4, 5))


def test_hash_survives_a_small_change():
    rng = np.random.default_rng(0)
    x = np.cumsum(rng.normal(size=(96, 576)), axis=1)
    x = ((x - x.min()) / np.ptp(x) * 255).astype(np.uint8)
    y = x.copy()
    y[40, 100:110] ^= 7
    far = lambda a, b: sum((p ^ q).bit_count() for p, q in zip(a, b))
    assert far(media.cosine_hash(x), media.cosine_hash(y)) <= 2
    assert far(media.cosine_hash(x), media.cosine_hash(x[::-1, ::-1])) > 12
