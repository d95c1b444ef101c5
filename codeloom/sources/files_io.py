"""Small driver-side files: atomic JSON snapshots and the index lock."""

from __future__ import annotations

import json
import os
import socket
import tempfile
import time
from datetime import datetime, timezone


def write_json(path: str, value) -> None:
    """Replaces a file at once."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    fd, tmp = tempfile.mkstemp(dir=os.path.dirname(path) or ".", suffix=".tmp")
    with os.fdopen(fd, "w", encoding="utf-8") as f:
        json.dump(value, f, indent=2)
    os.replace(tmp, path)


def read_json(path: str):
    """None for a file that is missing or no JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            return json.load(f)
    except (OSError, ValueError):
        return None


class LockHeld(RuntimeError):
    """The index is locked by another process."""


class Lock:
    """A lock file made exclusively; stale if unreadable, of a dead process of this host, or older than ``max_age`` seconds."""

    def __init__(self, path: str, max_age: float = 3600):
        self.path, self.max_age, self.held = path, max_age, False

    def info(self) -> dict | None:
        return read_json(self.path)

    def stale(self) -> bool:
        if not os.path.exists(self.path):
            return False
        info = self.info()
        try:
            age = time.time() - datetime.fromisoformat(info["acquired_at"]).timestamp()
            if info["host"] == socket.gethostname():
                os.kill(int(info["pid"]), 0)
        except ProcessLookupError:
            return True
        except PermissionError:
            pass
        except (TypeError, KeyError, ValueError):
            return True
        return age > self.max_age

    def break_if_stale(self) -> bool:
        if self.stale():
            os.unlink(self.path)
            return True
        return False

    def is_locked(self) -> bool:
        return os.path.exists(self.path) and not self.stale()

    def acquire(self) -> None:
        os.makedirs(os.path.dirname(self.path) or ".", exist_ok=True)
        try:
            fd = os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY)
        except FileExistsError:
            raise LockHeld(self.path) from None
        with os.fdopen(fd, "w") as f:
            json.dump({"pid": os.getpid(), "host": socket.gethostname(), "acquired_at": datetime.now(timezone.utc).isoformat()}, f)
        self.held = True

    def release(self) -> None:
        if self.held:
            self.held = False
            os.unlink(self.path)

    def __enter__(self):
        self.acquire()
        return self

    def __exit__(self, *_):
        self.release()
