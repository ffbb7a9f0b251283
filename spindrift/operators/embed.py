"""Embedding: hashed bags of words, a cache, and batch calls that isolate bad rows."""

from __future__ import annotations

import hashlib
import re
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache
from itertools import filterfalse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.functions import identity
from spindrift.functions import text as T

#: Words that the hashing model leaves out unless no others are in the text.
STOPWORDS = (
    "a an and are as at be by for from has have in is it its of on or that the this to was were will with which you your can not but if then than so such "
    "these those there their they them we our may also into when where how what"
).split()


def _md5_vectors(words: pa.Array, dims: int) -> np.ndarray:
    """A row for each list of words: signed sums, damped, normalized. Each word of the lists is hashed once; stop words count only where there are no others."""
    n = len(words)
    row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()
    place, own = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode(), usedforsecurity=False).digest() for w in own), np.uint8).reshape(-1, 16)
    cell = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64) % dims
    sign = np.where(digests[:, 4] >> 4 & 1, 1.0, -1.0)
    stop = np.array([w in _STOP for w in own], bool)[place]
    kept = ~stop | (np.bincount(row[~stop], minlength=n) == 0)[row]
    sums = np.bincount(row[kept] * dims + cell[place[kept]], sign[place[kept]], n * dims).reshape(n, dims)
    damped = np.sign(sums) * (1 + np.log(np.maximum(np.abs(sums), 1)))
    length = np.sqrt((damped**2).sum(1, keepdims=True))
    return (damped / np.where(length > 0, length, 1)).astype(np.float32)


#: Words whose cells and signs a task holds at once; a longer text is held whole.
WORDS = 1_000_000


def hash_md5(docs: DataFrame, dims: int, held: int = WORDS) -> DataFrame:
    """key, vector: the hashing model with a hash that SQL has: the first eight hexadecimal digits of a word's MD5 choose the cell, the next one's parity the sign.

    Another vector space than hash_blake()'s, and named so. Texts without words get the zero vector. Nothing is shuffled."""
    own = docs.select("key", F.regexp_extract_all(F.lower("text"), F.lit(T.WORD), F.lit(0)).alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            upto = np.cumsum(pc.fill_null(pc.list_value_length(b["words"]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            edges = [0, *(np.flatnonzero(np.diff(upto // held)) + 1).tolist(), b.num_rows]
            for start, end in zip(edges, edges[1:]):
                part = b.slice(start, end - start)
                v = _md5_vectors(part["words"], dims)
                yield pa.RecordBatch.from_arrays([part["key"], pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * dims), pa.array(v.ravel()))], ["key", "vector"])

    return own.mapInArrow(run, f"key {docs.schema['key'].dataType.simpleString()}, vector array<float>")


_WORD = re.compile(r"\w+")
_STOP = frozenset(STOPWORDS)


@lru_cache(maxsize=50_000)
def _digest(word: str) -> bytes:
    return hashlib.blake2b(word.encode(), digest_size=8).digest()


#: A word's digest: four bytes choose the cell, the lowest bit of the fifth the sign.
_DIGEST = np.dtype([("cell", "<u4"), ("sign", "u1"), ("rest", "V3")])


def hash_vector(text: str, dims: int) -> list[float]:
    """The hashing model's vector of one text: cells and signs by BLAKE2b of eight bytes."""
    every = _WORD.findall(text.lower())
    kept = list(filterfalse(_STOP.__contains__, every)) or every
    d = np.frombuffer(b"".join(map(_digest, kept)), _DIGEST)
    sums = np.bincount(d["cell"] % dims, np.where(d["sign"] & 1, 1.0, -1.0), dims)
    damped = np.sign(sums) * (1 + np.log(np.maximum(np.abs(sums), 1)))
    return (damped / (np.linalg.norm(damped) or 1)).tolist()


def hash_blake(docs: DataFrame, dims: int) -> DataFrame:
    """key, vector of the exact hashing model: Spark has no BLAKE2b, so texts pass through Arrow batches."""
    return embedded(docs, lambda texts: [hash_vector(t, dims) for t in texts], dims).select("key", "vector")


class Answer(list):
    """Vectors, and the tokens that the call counted (None where the model doesn't say)."""

    tokens: int | None = None


#: Rows whose texts and vectors a task holds as Python objects.
HELD = 256


def embedded(docs: DataFrame, model: Callable[[list[str]], list[list[float]]], dims: int | None = None, batch: int = 64, parallel: int = 1) -> DataFrame:
    """key, vector, error, tokens: texts through a model in batches, ``parallel`` of them at a time in each task; null texts are left out.

    Where a call fails, or gives vectors of another number or size than it should, the batch is halved
    until single rows fail: one bad text costs no other its vector, and no stage fails. What a call counted as
    tokens is in its first row, 0 in its others; null where it counted none. A task has the texts and vectors of about HELD rows as Python objects at
    once, or of eight rounds of calls."""
    key_type = docs.schema["key"].dataType
    held = batch * max(8 * parallel, -(-HELD // batch))  # whole calls

    def isolated(texts: list[str]) -> list[tuple[list[float] | None, str | None, int | None]]:
        try:
            out = model(texts)
            if len(out) != len(texts):
                raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
            if dims and any(len(v) != dims for v in out):
                raise ValueError(f"a vector has not {dims} dimensions")
            used = getattr(out, "tokens", None)
            return [(v, None, used if not i or used is None else 0) for i, v in enumerate(out)]
        except Exception as e:  # noqa: BLE001  whatever a model raises is the row's error
            if len(texts) == 1:
                return [(None, f"{type(e).__name__}: {e}"[:300], 0)]
            half = len(texts) // 2
            return isolated(texts[:half]) + isolated(texts[half:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with ThreadPoolExecutor(parallel) as pool:
            for b in batches:
                for start in range(0, b.num_rows, held):
                    part = b.slice(start, held)
                    texts = part["text"].to_pylist()
                    calls = [texts[i : i + batch] for i in range(0, len(texts), batch)]
                    out = [r for answers in (map if parallel == 1 else pool.map)(isolated, calls) for r in answers]
                    vector, error, tokens = zip(*out)
                    yield pa.RecordBatch.from_arrays([part["key"], pa.array(vector, pa.list_(pa.float32())), pa.array(error, pa.string()), pa.array(tokens, pa.int64())], ["key", "vector", "error", "tokens"])

    return docs.select("key", "text").where("text is not null").mapInArrow(run, f"key {key_type.simpleString()}, vector array<float>, error string, tokens long")


#: Texts of a probe.
PROBE = 16


def probe(docs: DataFrame, model: Callable[[list[str]], list[list[float]]]) -> dict:
    """What a few texts of docs (key, text), spread by hash, say about a model: rows, dims, tokens_per_char, docs_per_second; or its error.

    The ratio is None where the model counts no tokens. Texts are cut as they will be when all are embedded."""
    some = docs.where(T.has_text("text")).orderBy(F.md5(F.col("key").cast("string")), "key").limit(PROBE)
    texts = [r[0] for r in some.select(T.clip("text", T.EMBED_CLIP)).collect()]
    if not texts:
        return {"rows": 0, "dims": None, "tokens_per_char": None, "docs_per_second": None}
    began = time.perf_counter()
    try:
        out = model(texts)
    except Exception as e:  # noqa: BLE001  whatever a model raises is what the probe found
        return {"rows": len(texts), "error": f"{type(e).__name__}: {e}"[:300]}
    took, used = time.perf_counter() - began, getattr(out, "tokens", None)
    return {"rows": len(texts), "dims": len(out[0]), "tokens_per_char": used / sum(map(len, texts)) if used else None, "docs_per_second": len(texts) / max(took, 1e-6)}


def cache_split(docs: DataFrame, cache: DataFrame, identity_text: str, mode: str = "document") -> tuple[DataFrame, DataFrame]:
    """(docs whose text is in the cache, with its vector; distinct texts that are not, as (cache_key, text)). cache: cache_key, vector."""
    keyed = docs.withColumn("cache_key", identity.cache_key(identity_text, mode, "text"))
    hits = keyed.join(cache.select("cache_key", "vector"), "cache_key")
    misses = keyed.join(cache.select("cache_key"), "cache_key", "left_anti").select("cache_key", "text").dropDuplicates(["cache_key"])
    return hits, misses
