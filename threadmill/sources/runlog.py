"""Logs of a run on the driver: one of everything and one of progress, rotated by size, with the row at hand."""

from __future__ import annotations

import contextlib
import contextvars
import logging
from collections.abc import Iterator
from logging.handlers import RotatingFileHandler
from pathlib import Path

#: Size of a log and how many old ones are kept. Fixed values.
MAX_BYTES, BACKUPS = 20_000_000, 3
PROGRESS = "PROGRESS "
_row: contextvars.ContextVar[dict] = contextvars.ContextVar("row", default={})


class _Context(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        record.row = " ".join(f"{k}={v}" for k, v in _row.get().items()) or "-"
        return True


class _ProgressOnly(logging.Filter):
    def filter(self, record: logging.LogRecord) -> bool:
        return record.getMessage().startswith(PROGRESS)


@contextlib.contextmanager
def at_row(**fields: object) -> Iterator[None]:
    """Every message inside carries these fields."""
    token = _row.set({**_row.get(), **fields})
    try:
        yield
    finally:
        _row.reset(token)


def open_logs(folder: str, name: str = "threadmill") -> logging.Logger:
    """A logger that writes ``run.log`` and, of messages that start with PROGRESS, ``progress.log``."""
    Path(folder).mkdir(parents=True, exist_ok=True)
    logger = logging.getLogger(name)
    logger.setLevel(logging.DEBUG)
    for old in list(logger.handlers):
        logger.removeHandler(old)
        old.close()
    for file, only in (("run.log", None), ("progress.log", _ProgressOnly())):
        handler = RotatingFileHandler(f"{folder}/{file}", maxBytes=MAX_BYTES, backupCount=BACKUPS, encoding="utf-8")
        handler.setFormatter(logging.Formatter("%(asctime)s %(levelname)s [%(row)s] %(message)s"))
        handler.addFilter(_Context())
        if only:
            handler.addFilter(only)
        logger.addHandler(handler)
    return logger
