"""Text preparation: clipping, sentences, words, scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters kept of a text: for benchmarks, for embedding, for a prompt.
BENCH_CLIP, EMBED_CLIP, PROMPT_CLIP = 8_000, 24_000, 4_000
#: A word as in Python: a run of letters, numbers and underscores of any script.
WORD = r"[\p{L}\p{N}_]+"
_ARABIC = r"[\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}]"
_LATIN = r"[A-Za-zÀ-ÖØ-öø-ɏ]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clip(text, n: int = BENCH_CLIP) -> Column:
    """The first n characters (code points)."""
    return F.substring(_c(text), 1, n)


def has_text(text) -> Column:
    """Not null and not only spaces: the rule of the row store, which strips spaces alone."""
    return F.coalesce(F.trim(_c(text)) != "", F.lit(False))


def not_blank(text) -> Column:
    """Not null and not only white space of any kind: the rule for files and collections."""
    return F.coalesce(_c(text).rlike(r"(?U)\S"), F.lit(False))


def normalized(sentence) -> Column:
    """Lower case with single blanks: under this, repeated sentences are equal."""
    return F.trim(F.regexp_replace(F.lower(_c(sentence)), r"(?U)\s+", " "))


def words(text) -> Column:
    """Runs of anything but white space."""
    return F.regexp_extract_all(_c(text), F.lit(r"\S+"), F.lit(0))


def word_count(text) -> Column:
    return F.regexp_count(_c(text), F.lit(r"\S+"))


def bench_sentences(text) -> Column:
    """Split after . ! ? where a capital, digit, quote or bracket follows."""
    return F.filter(F.split(F.trim(_c(text)), r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])"), lambda s: s.rlike(r"\S"))


def eval_sentences(text) -> Column:
    """Split after . ! ? and their Arabic forms, and at line ends; pieces are stripped."""
    pieces = F.transform(F.split(_c(text), r"(?<=[.!?؟۔])\s+|\n+"), lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""))
    return F.filter(pieces, lambda s: s != "")


def script(text) -> Column:
    """arabic, latin or other, by the more frequent letters; a tie of some letters is arabic."""
    a, b = F.regexp_count(_c(text), F.lit(_ARABIC)), F.regexp_count(_c(text), F.lit(_LATIN))
    return F.when((a == 0) & (b == 0), "other").when(a >= b, "arabic").otherwise("latin")


def slice_label(query_script, text_script) -> Column:
    return F.concat(_c(query_script), F.lit("→"), _c(text_script))


def prefixed(text, mode: str, query_prefix: str = "", doc_prefix: str = "") -> Column:
    """The text with the prefix that a model wants for queries or documents."""
    return F.concat(F.lit(query_prefix if mode == "query" else doc_prefix), _c(text))


def masked_url(text) -> Column:
    """Query strings of URLs replaced by an ellipsis: they may carry secrets."""
    return F.regexp_replace(_c(text), r"(https?://[^\s?,]+)\?[^\s,]*", "$1?…")


def share(part, whole) -> Column:
    """A percentage for people: whole numbers, but <1% for what would round to nothing."""
    part, whole = _c(part), _c(whole)
    value = F.try_divide(part * 100.0, whole)
    return F.when(whole == 0, "0%").when((value >= 1) | (value == 0), F.concat(F.bround(value, 0).cast("long").cast("string"), F.lit("%"))).otherwise("<1%")


def cleaned_reply(text) -> Column:
    """The first line of a chat model's reply without the quotes around it."""
    return F.regexp_replace(F.trim(F.split(F.trim(_c(text)), "\n")[0]), "^[\"'“”]+|[\"'“”]+$", "")
