"""Identity of vector spaces, texts and points, as hashes."""

from __future__ import annotations

import hashlib
import json
import secrets
import time
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What determines a vector space, in the order of the digest; and which of it counts without case and outer blanks.
SPACE = ("dimensions", "model", "normalized", "prefix", "provider", "task", "version")
NAMES = ("provider", "model")


def _canonical(value: Callable[[str], object]) -> dict[str, object]:
    """Fields by name, in order: the rule that both forms of the digest share."""
    return {name: value(name) for name in SPACE}


def fingerprint(provider: str, model: str, dimensions: int, version: str | None = None, task: str | None = None, prefix: str | None = None, normalized: bool = True) -> dict:
    """provider, model, dimensions, digest and tag of a vector space."""
    given = {"provider": provider.strip().lower(), "model": model.strip().lower(), "dimensions": dimensions, "version": version, "task": task, "prefix": prefix, "normalized": normalized}
    if missing := [n for n in NAMES if not given[n]]:
        raise ValueError(f"no {missing[0]}")
    if dimensions < 1:
        raise ValueError(f"vectors have no {dimensions} dimensions")
    short = hashlib.sha256(json.dumps(_canonical(given.get), separators=(",", ":")).encode()).hexdigest()[:12]
    return {n: given[n] for n in ("provider", "model", "dimensions")} | {"digest": short, "tag": f"{given['provider']}/{given['model']}@{dimensions}#{short}"}


def _json(text: Column) -> Column:
    """A JSON string in ASCII; null as null. Other characters are escaped by their UTF-16 units."""
    units = lambda c: F.regexp_replace(F.lower(F.hex(F.encode(c, "UTF-16BE"))), "(.{4})", r"\\u$1")
    short = {"\\": r"\\", '"': r'\"', "\n": r"\n", "\r": r"\r", "\t": r"\t", "\b": r"\b", "\f": r"\f"}

    def one(c: Column) -> Column:
        out = F.when(c.between(" ", "~"), c).otherwise(units(c))
        for plain, escaped in short.items():
            out = F.when(c == plain, F.lit(escaped)).otherwise(out)
        return out

    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit('"'), F.array_join(F.transform(F.split(text, ""), one), ""), F.lit('"')))


def digest(provider="provider", model="model", dimensions="dimensions", version="version", task="task", prefix="prefix", normalized="normalized") -> Column:
    """The digest of fingerprint() from columns: compact JSON with keys in order, SHA-256, twelve digits."""
    column = {"provider": provider, "model": model, "dimensions": dimensions, "version": version, "task": task, "prefix": prefix, "normalized": normalized}

    def value(name: str) -> Column:
        c = F.col(column[name])
        return c.cast("string") if name == "dimensions" else F.when(c, "true").otherwise("false") if name == "normalized" else _json(F.lower(F.trim(c)) if name in NAMES else c)

    fields = [x for name, v in _canonical(value).items() for x in (F.lit(f',"{name}":'), v)]
    return F.substring(F.sha2(F.concat(F.lit("{"), F.substring(fields[0], 2, 100), *fields[1:], F.lit("}")), 256), 1, 12)


def tag(provider="provider", model="model", dimensions="dimensions", **more) -> Column:
    return F.concat(F.lower(F.trim(F.col(provider))), F.lit("/"), F.lower(F.trim(F.col(model))), F.lit("@"), F.col(dimensions).cast("string"), F.lit("#"), digest(provider, model, dimensions, **more))


def cache_key(identity: str, mode: str, text) -> Column:
    """SHA-256 of model identity, mode and text with zero bytes between."""
    text = F.col(text) if isinstance(text, str) else text
    return F.sha2(F.concat(F.lit(identity), F.lit("\0"), F.lit(mode), F.lit("\0"), text), 256)


#: Name space of UUIDs made from keys of a row store: the public one for URLs.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def uuid5(name, namespace: str = NAMESPACE) -> Column:
    """Version 5 UUID: SHA-1 over the name space's bytes and the name."""
    name = F.col(name) if isinstance(name, str) else name
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def point_id(key) -> Column:
    """A key as a point id: an unsigned 64-bit number or a canonical UUID as it is, anything else as its version 5 UUID."""
    key = F.col(key) if isinstance(key, str) else key
    number = key.rlike("^(0|[1-9][0-9]{0,19})$") & (F.lpad(key, 20, "0") <= "18446744073709551615")
    uuid = key.rlike("^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$")
    return F.when(number | uuid, key).otherwise(uuid5(key))


_CROCKFORD = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def ulid() -> str:
    """A sortable run id: 48 bits of time, 80 random bits."""
    n = int(time.time() * 1000) << 80 | secrets.randbits(80)
    return "".join(_CROCKFORD[n >> 5 * k & 31] for k in range(25, -1, -1))


def lock_key(name: str) -> int:
    """A signed 64-bit number for a lock on ``name``: the first eight bytes of its SHA-256."""
    return int.from_bytes(hashlib.sha256(name.encode()).digest()[:8], "big", signed=True)
