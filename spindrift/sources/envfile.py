"""Settings files of NAME=value lines. What the environment already has always wins.

A line is read character by character: a name, an equals sign, and a value that is bare, in single quotes
(taken as it stands) or in double quotes (with backslash escapes). After a value only a comment may follow.
"""

from __future__ import annotations

import os
from pathlib import Path

#: What a backslash makes of the next character in double quotes. Any other pair stays as it is.
ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\", "$": "$"}


class EnvFileError(ValueError):
    """A line that is no setting."""


def _quoted(line: str, at: int) -> tuple[str, int]:
    """(the text of the quotes that open at ``at``, where they end)."""
    mark, out, at = line[at], [], at + 1
    while at < len(line) and line[at] != mark:
        if mark == '"' and line[at] == "\\" and at + 1 < len(line):
            out.append(ESCAPES.get(line[at + 1], line[at : at + 2]))
            at += 2
        else:
            out.append(line[at])
            at += 1
    if at >= len(line):
        raise EnvFileError("a quote is not closed")
    return "".join(out), at + 1


def setting(line: str) -> tuple[str, str] | None:
    """(name, value) of a line; None for a blank line or a comment."""
    line = line.strip()
    if not line or line[0] == "#":
        return None
    name, equals, rest = line.removeprefix("export ").partition("=")
    name, rest = name.strip(), rest.strip()
    if not equals or not name.isidentifier() or not name.isascii():
        raise EnvFileError("not NAME=value")
    if rest[:1] not in ("'", '"'):
        hidden = next((i for i, c in enumerate(rest) if c == "#" and (i == 0 or rest[i - 1].isspace())), len(rest))
        return name, rest[:hidden].rstrip()
    value, end = _quoted(rest, 0)
    if rest[end:].strip() and not rest[end:].lstrip().startswith("#"):
        raise EnvFileError("something follows the closing quote")
    return name, value


def parse(text: str) -> dict[str, str]:
    out = {}
    for number, line in enumerate(text.splitlines(), 1):
        try:
            out.update([s] if (s := setting(line)) else [])
        except EnvFileError as e:
            raise EnvFileError(f"line {number}: {e}") from None
    return out


def load(path: str | Path) -> list[str]:
    """Names that the file set. There need be no file."""
    p = Path(path)
    fresh = {n: v for n, v in (parse(p.read_text()) if p.is_file() else {}).items() if n not in os.environ}
    os.environ.update(fresh)
    return list(fresh)


def save(path: str | Path, name: str, value: str) -> None:
    """Adds or replaces one setting; only the owner may read the file."""
    p = Path(path)
    back = {v: "\\" + k for k, v in ESCAPES.items()}
    kept = []
    for line in p.read_text().splitlines() if p.exists() else []:
        own = setting(line)
        if not own or own[0] != name:
            kept.append(line)
    p.touch(mode=0o600)
    p.chmod(0o600)
    p.write_text("".join(f"{x}\n" for x in [*kept, f'{name}="{"".join(back.get(c, c) for c in value)}"']))
