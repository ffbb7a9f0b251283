"""Media columns: payloads stored losslessly as PNG files in a binary column, and perceptual hashes of them.

A payload becomes a grey image of 8-bit samples, 576 to a row. The file is written chunk by chunk (IHDR,
IDAT, IEND, each with its CRC-32) around a zlib stream of filtered rows. Reading tests the signature,
every chunk's checksum and the stream's own, and undoes all five row filters in numpy. The feature is
the sign pattern of the low frequencies of a cosine transform of the image, 64 bits in a binary column.

Defined results: a null text counts as an empty one, stored as one row of bytes 255; a text of any
length is stored whole; equal texts give equal files; an empty table gives an empty table; columns other
than doc_id and text are left out. from_png() gives nulls for a file that is null or broken, and says
which test failed in ``problem``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.llm.shared import arrow_stage, stored, texts_of

WIDTH = 576
_SIGN = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def write_png(payload: bytes, width: int = WIDTH, level: int = 1, piece: int = 1 << 16) -> bytes:
    """A grey PNG. A row that mostly repeats the row above is stored as differences to it (filter 2), one that
    mostly repeats its left neighbours as differences to them (filter 1), any other as it is (filter 0)."""
    x = np.frombuffer(payload, np.uint8).reshape(-1, width)
    up, left = x.copy(), x.copy()
    up[1:] -= x[:-1]
    left[:, 1:] -= x[:, :-1]
    kind = np.where((up == 0).sum(1) * 2 > width, 2, np.where((left == 0).sum(1) * 2 > width, 1, 0)).astype(np.uint8)
    rows = np.empty((len(x), width + 1), np.uint8)
    rows[:, 0] = kind
    rows[:, 1:] = np.where(kind[:, None] == 2, up, np.where(kind[:, None] == 1, left, x)) if kind.any() else x
    z = zlib.compress(rows.tobytes(), level)
    head = _chunk(b"IHDR", struct.pack(">IIBBBBB", width, len(x), 8, 0, 0, 0, 0))
    return b"".join([_SIGN, head, *(_chunk(b"IDAT", z[i : i + piece]) for i in range(0, len(z), piece)), _chunk(b"IEND", b"")])


def _unfilter(rows: np.ndarray) -> np.ndarray:
    """Samples from filtered rows. Runs of rows of one kind are undone together where the kind allows it."""
    kind, out = rows[:, 0], rows[:, 1:].copy()
    if not kind.any():
        return out
    edges = [0, *(np.flatnonzero(kind[1:] != kind[:-1]) + 1).tolist(), len(kind)]
    for a, b in zip(edges, edges[1:]):
        above = out[a - 1] if a else np.zeros(out.shape[1], np.uint8)
        if kind[a] == 1:
            out[a:b] = np.cumsum(out[a:b], axis=1, dtype=np.uint8)
        elif kind[a] == 2:
            out[a:b] = np.cumsum(out[a:b], axis=0, dtype=np.uint8) + above
        elif kind[a] in (3, 4):
            for y in range(a, b):
                line, was = out[y].tolist(), above.tolist()
                left = corner = 0
                for i, up in enumerate(was):
                    if kind[a] == 3:
                        guess = (left + up) >> 1
                    else:
                        p = left + up - corner
                        by = (abs(p - left), abs(p - up), abs(p - corner))
                        guess = (left, up, corner)[by.index(min(by))]
                    left = line[i] = (line[i] + guess) & 255
                    corner = up
                out[y] = line
                above = out[y]
        elif kind[a]:
            raise ValueError("unknown row filter")
    return out


def read_png(data: bytes) -> np.ndarray:
    """The samples of a grey 8-bit PNG, rows by columns; ValueError where a test fails."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG")
    at, head, body, ended = 8, None, [], False
    while at + 12 <= len(data) and not ended:
        n = int.from_bytes(data[at : at + 4])
        kind, own = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if len(own) < n or data[at + 8 + n : at + 12 + n] != struct.pack(">I", zlib.crc32(own, zlib.crc32(kind))):
            raise ValueError(f"checksum of chunk {kind.decode('latin-1')}")
        at += 12 + n
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", own)
        elif kind == b"IDAT":
            body.append(own)
        ended = kind == b"IEND"
    if not ended or head is None:
        raise ValueError("missing chunk")
    width, height, *form = head
    if form != [8, 0, 0, 0, 0]:
        raise ValueError("not a grey 8-bit image")
    try:
        raw = zlib.decompress(b"".join(body))  # tests the stream's checksum
    except zlib.error as e:
        raise ValueError("zlib stream") from e
    if len(raw) != height * (width + 1):
        raise ValueError("number of samples")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, width + 1))


_SIDE = 32
#: Rows 0 to 7 of the cosine transform of 32 samples.
_COS = np.cos(np.pi * np.arange(8)[:, None] * (2 * np.arange(_SIDE)[None, :] + 1) / (2 * _SIDE))


def cosine_hash(image: np.ndarray) -> bytes:
    """64 bits: which of the 8 x 8 lowest frequencies of the image, reduced to 32 x 32 means, lie above their median."""

    def reduced(x: np.ndarray) -> np.ndarray:
        """Means over 32 equal parts of the first axis; of fewer than 32 rows some are repeated."""
        edges = np.arange(_SIDE) * len(x) // _SIDE
        return x[edges] if len(x) < _SIDE else np.add.reduceat(x, edges, axis=0) / np.diff(edges, append=len(x))[:, None]

    low = _COS @ reduced(reduced(image.astype(np.float64)).T).T @ _COS.T
    return np.packbits(np.round(low, 6) > np.round(np.median(low.ravel()[1:]), 6)).tobytes()


def to_png(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_bytes, media binary: each whole text in UTF-8, filled with bytes 255 to whole rows, as a PNG."""

    def rows(batches):
        for b in batches:
            for d, t in zip(b["doc_id"], b["text"]):
                raw = t.encode()
                yield d, len(raw), write_png(raw.ljust(max(width, -(-len(raw) // width) * width), b"\xff"), width)

    return arrow_stage(texts_of(docs), rows, "doc_id long, n_bytes long, media binary", batch=200)


def from_png(media: DataFrame, *keep: str) -> DataFrame:
    """The columns ``keep`` ("name type") and doc_id, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, hash binary, problem: features of what the files hold."""
    import hashlib

    names = [x.split()[0] for x in keep]

    def rows(batches):
        for b in batches:
            for i, (d, m) in enumerate(zip(b["doc_id"], b["media"])):
                mine = tuple(b[n][i] for n in names)
                try:
                    if m is None:
                        raise ValueError("null")
                    image = read_png(m)
                except ValueError as e:
                    yield (*mine, d, None, None, None, None if m is None else len(m), None if m is None else hashlib.sha256(m).hexdigest(), None, str(e))
                    continue
                payload = image.tobytes()
                yield (*mine, d, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), cosine_hash(image), None)

    schema = "".join(f"{x}, " for x in keep) + "doc_id long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, hash binary, problem string"
    return arrow_stage(media.select(*names, "doc_id", "media"), rows, schema)


def digests(docs: DataFrame) -> DataFrame:
    """to_png() of every document, written to the shared folder, and from_png() of what is there, with the hash as hexadecimal digits in ``feature``."""
    return from_png(stored(to_png(docs)), "n_bytes long").withColumn("feature", F.lower(F.hex("hash"))).drop("hash", "problem")
