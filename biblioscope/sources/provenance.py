"""Provenance on the driver: digests, atomic writes, a lock, and a registry of written files."""

from __future__ import annotations

import contextlib
import fcntl
import hashlib
import json
import logging
import logging.handlers
import os
import time
from collections.abc import Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_digest(path: str | Path, chunk: int = 1 << 20) -> str:
    own = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(chunk):
            own.update(part)
    return own.hexdigest()


def table_digest(df: DataFrame) -> str:
    """A digest of a table's rows that doesn't depend on their order: sums of two hashes and the count."""
    cells = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in sorted(df.columns)]
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*cells).cast("decimal(38,0)")), F.sum(F.hash(*cells).cast("decimal(38,0)"))).first()
    return hashlib.sha256(repr(tuple(map(str, row))).encode()).hexdigest()


def write_atomic(path: str | Path, data: bytes) -> None:
    """All or nothing: written beside, synced, then renamed."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    beside = path.with_name(f".{path.name}.{os.getpid()}")
    with open(beside, "wb") as f:
        f.write(data)
        f.flush()
        os.fsync(f.fileno())
    os.replace(beside, path)


def write_json(path: str | Path, value: object) -> None:
    write_atomic(path, json.dumps(value, indent=2, ensure_ascii=False, default=str).encode())


@contextlib.contextmanager
def locked(path: str | Path, timeout: float = 30.0, poll: float = 0.1) -> Iterator[None]:
    """Holds an exclusive lock on a file; TimeoutError if it can't be had in time."""
    with open(path, "w") as f:
        end = time.monotonic() + timeout
        while True:
            try:
                fcntl.flock(f, fcntl.LOCK_EX | fcntl.LOCK_NB)
                break
            except BlockingIOError:
                if time.monotonic() >= end:
                    raise TimeoutError(f"{path} is locked") from None
                time.sleep(poll)
        try:
            yield
        finally:
            fcntl.flock(f, fcntl.LOCK_UN)


def register(registry: str | Path, name: str, entry: dict) -> dict:
    """Sets an entry of the JSON registry; an unreadable registry is kept beside and begun anew."""
    registry = Path(registry)
    registry.parent.mkdir(parents=True, exist_ok=True)
    with locked(f"{registry}.lock"):
        known: dict = {}
        if registry.exists():
            try:
                known = json.loads(registry.read_text(encoding="utf-8"))
            except ValueError:
                registry.rename(registry.with_suffix(f".corrupt-{int(time.time())}"))
        known[name] = entry | {"at": datetime.now(UTC).isoformat()}
        write_json(registry, known)
    return known


def logger(name: str, folder: str | Path | None = None, level: int = logging.INFO, keep: int = 5) -> logging.Logger:
    """A logger to the console and, with a folder, to a file there that is rotated at 5 MB; asked for again it stays one."""
    own = logging.getLogger(name)
    own.setLevel(level)
    if not own.handlers:
        form = logging.Formatter("%(asctime)s %(levelname)s %(name)s: %(message)s")
        handlers: list[logging.Handler] = [logging.StreamHandler()]
        if folder:
            Path(folder).mkdir(parents=True, exist_ok=True)
            handlers.append(logging.handlers.RotatingFileHandler(Path(folder) / f"{name}.log", maxBytes=5_000_000, backupCount=keep, encoding="utf-8"))
        for handler in handlers:
            handler.setFormatter(form)
            own.addHandler(handler)
    return own


def write_registered(df: DataFrame, path: str, registry: str | Path, script: str) -> str:
    """Writes df as Parquet, registers its digest, rows and columns, and returns the digest."""
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    own = df.sparkSession.read.schema(df.schema).parquet(path)
    digest = table_digest(own)
    register(registry, path, {"digest": digest, "rows": own.count(), "columns": own.columns, "script": script})
    return digest
