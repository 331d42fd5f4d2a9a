"""An advisory lock beside a store: one writer, or several readers."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import SparkSession

from mnemora.errors import StorageError
from mnemora.sources.files import Files


class WriterLock:
    """Holds `lock/writer`, or a file of its own under `lock/readers`; released by `release` or a with block.

    A holder that died leaves its file behind; `break_lock` removes all of them.
    """

    def __init__(self, files: Files, name: str):
        self._files, self._name = files, name

    @property
    def path(self) -> str:
        return self._files.at(self._name)

    @staticmethod
    def try_exclusive(spark: SparkSession, root: str) -> WriterLock | None:
        """The writer's lock, or None while another writer or a reader holds one."""
        files = Files(spark, root)
        if files.names("lock/readers") or not files.create("lock/writer", {"since_ms": int(time.time() * 1000)}):
            return None
        lock = WriterLock(files, "lock/writer")
        if files.names("lock/readers"):  # one that came in between
            lock.release()
            return None
        return lock

    @classmethod
    def acquire_exclusive(cls, spark: SparkSession, root: str, timeout_s: float = 60.0) -> WriterLock:
        return cls._waited(lambda: cls.try_exclusive(spark, root), timeout_s)

    @classmethod
    def acquire_shared(cls, spark: SparkSession, root: str, timeout_s: float = 60.0) -> WriterLock:
        files = Files(spark, root)

        def get() -> WriterLock | None:
            lock = WriterLock(files, f"lock/readers/{uuid.uuid4().hex}")
            files.create(lock._name, {"since_ms": int(time.time() * 1000)})
            if cls.is_writer_active(spark, root):
                lock.release()
                return None
            return lock

        return cls._waited(get, timeout_s)

    @staticmethod
    def _waited(get, timeout_s: float) -> WriterLock:
        end = time.monotonic() + timeout_s
        while (lock := get()) is None:
            if time.monotonic() >= end:
                raise StorageError("the lock is held")
            time.sleep(0.05)
        return lock

    @staticmethod
    def is_writer_active(spark: SparkSession, root: str) -> bool:
        return Files(spark, root).exists("lock/writer")

    @staticmethod
    def break_lock(spark: SparkSession, root: str) -> None:
        Files(spark, root).delete("lock")

    def release(self) -> None:
        self._files.delete(self._name)

    def __enter__(self) -> WriterLock:
        return self

    def __exit__(self, *_) -> None:
        self.release()
