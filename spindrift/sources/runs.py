"""Logs of runs: numbered events as JSON lines, and which run is at work."""

from __future__ import annotations

import json
import os
import time
from contextlib import contextmanager
from dataclasses import dataclass, field
from pathlib import Path

from spindrift.functions.identity import ulid


class Busy(RuntimeError):
    """Another run is at work."""


@dataclass
class Run:
    """Events of one run, in a file that is appended to. A line that a crash cut short is passed over."""

    folder: Path
    run_id: str = field(default_factory=ulid)

    @property
    def path(self) -> Path:
        return Path(self.folder) / f"{self.run_id}.jsonl"

    def emit(self, kind: str, **data) -> int:
        number = len(self.after(0)) + 1
        self.path.parent.mkdir(parents=True, exist_ok=True)
        with self.path.open("a") as f:
            f.write(json.dumps({"id": number, "at": time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime()), "kind": kind, "data": data}, ensure_ascii=False) + "\n")
        return number

    def after(self, last: int) -> list[dict]:
        """Events later than number ``last``: a reader that lost its connection goes on from there."""
        out = []
        for line in self.path.read_text().splitlines() if self.path.exists() else []:
            try:
                event = json.loads(line)
            except ValueError:
                continue
            if event["id"] > last:
                out.append(event)
        return out


@contextmanager
def locked(path: str | Path):
    """Only one holder at a time; the file names its process. A holder that is gone holds nothing."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    for _ in range(2):
        try:
            f = os.open(p, os.O_CREAT | os.O_EXCL | os.O_WRONLY, 0o600)
            break
        except FileExistsError:
            try:
                os.kill(int(p.read_text() or 0) or os.getpid(), 0)
            except (ProcessLookupError, ValueError):
                p.unlink(missing_ok=True)
                continue
            raise Busy(f"{p} is held by another run") from None
    else:
        raise Busy(f"{p} is held by another run")
    try:
        os.write(f, str(os.getpid()).encode())
        os.close(f)
        yield
    finally:
        p.unlink(missing_ok=True)
