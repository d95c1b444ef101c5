"""Structured logging: one JSON object a line, in a file that rotates."""

from __future__ import annotations

import json
import logging
import os
from datetime import datetime, timezone
from logging.handlers import RotatingFileHandler

from codeloom.sources.config import Config

PLAIN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}


class JsonLines(logging.Formatter):
    """Time, level, logger and message, then whatever else the caller passed as ``extra``."""

    def format(self, record: logging.LogRecord) -> str:
        out = {
            "timestamp": datetime.fromtimestamp(record.created, timezone.utc).isoformat(), "level": record.levelname.lower(), "logger": record.name, "message": record.getMessage(),
        } | {k: v for k, v in vars(record).items() if k not in PLAIN}
        if record.exc_info:
            out["exception"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str)


def setup(folder: str, config: Config | None = None, name: str = "codeloom") -> logging.Logger:
    """The library's logger, writing to the configured file; a second call replaces the handlers of the first."""
    server = (config or Config()).server
    os.makedirs(folder, exist_ok=True)
    handler = RotatingFileHandler(os.path.join(folder, server.log_file), maxBytes=server.log_max_size_mb << 20, backupCount=server.log_keep_rotations, encoding="utf-8")
    handler.setFormatter(JsonLines())
    logger = logging.getLogger(name)
    for old in logger.handlers[:]:
        logger.removeHandler(old)
        old.close()
    logger.addHandler(handler)
    logger.setLevel(getattr(logging, server.log_level.upper(), logging.INFO))
    return logger
