"""Replication between stores: pages of visible log rows, folded into the other log.

A page is a table from end to end: it is read from one log, passed on by a
transport, and folded into the other state by a few joins, whatever its size.
"""

from __future__ import annotations

import threading
import time
import uuid
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemora import schemas as S
from mnemora.errors import ConfigError, SyncError
from mnemora.operators import log as L
from mnemora.sources.files import Files
from mnemora.sources.store import Engine

PROTOCOL = 3
KINDS = ("Collective", "Experience", "Relation", "Insight")


@dataclass(frozen=True)
class SyncConfig:
    direction: str = "Bidirectional"
    conflict: str = "ServerWins"
    batch_size: int = 500
    collectives: tuple[str, ...] | None = None
    relations: bool = True
    insights: bool = True
    initial_ms: float = 500
    factor: float = 2.0
    most_ms: float = 30_000
    push_interval_ms: float = 1000
    pull_interval_ms: float = 1000
    max_retries: int = 5

    def validate(self) -> SyncConfig:
        if self.batch_size < 1 or self.direction not in ("PushOnly", "PullOnly", "Bidirectional") or self.conflict not in ("ServerWins", "LastWriteWins"):
            raise ConfigError("sync configuration")
        if not (0 < self.initial_ms <= self.most_ms and self.factor >= 1 and self.push_interval_ms > 0 and self.pull_interval_ms > 0 and self.max_retries >= 0):
            raise ConfigError("sync intervals")
        return self

    def backoff(self, attempt: int) -> float:
        return min(self.initial_ms * self.factor ** (attempt - 1), self.most_ms)

    @property
    def interval_ms(self) -> float:
        return max(self.push_interval_ms, self.pull_interval_ms)


class SyncTransport(Protocol):
    def handshake(self, request: dict) -> dict: ...
    def push(self, changes: DataFrame) -> dict: ...
    def pull(self, since: int, limit: int) -> dict: ...
    def health(self) -> bool: ...


def changes_since(engine: Engine, since: int, limit: int, config: SyncConfig) -> tuple[DataFrame, int, bool]:
    """Own changes after `since` with their rows, the last sequence scanned, and whether more follow."""
    page = engine.page(since, limit)
    last = page.agg(F.max("seq"), F.count(F.lit(1))).first()
    rows = page.where(F.col("origin") == engine.instance_id)
    if config.collectives is not None:
        rows = rows.where(F.col("collective_id").isin(*config.collectives))
    skip = [k for k, on in (("Relation", config.relations), ("Insight", config.insights)) if not on]
    if skip:
        rows = rows.where(~F.col("entity_type").isin(*skip))
    return rows, last[0] or since, last[1] == limit


def fold(engine: Engine, changes: DataFrame, config: SyncConfig) -> DataFrame:
    """entity_type and the columns of `log.fold_experiences` for each entity of the page."""
    parts = []
    for kind in KINDS:
        own = changes.where(F.col("entity_type") == kind)
        # the page is bounded, the state is not: its ids prune the state
        ids = own.select(F.col("entity_id").alias("id")).distinct()
        local = engine.table(kind).join(F.broadcast(ids), "id", "left_semi")
        folded = L.fold_experiences(local, own, config.conflict == "LastWriteWins") if kind == "Experience" else L.fold_others(local, own, S.column_of(kind))
        parts.append(folded.select(F.lit(kind).alias("entity_type"), "id", "event_type", "collective_id", "origin", "outcome", "conflict", F.col("row").cast(f"struct<{S.struct_of(kind)}>").alias(S.column_of(kind))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def apply_changes(engine: Engine, changes: DataFrame, config: SyncConfig) -> dict[str, int]:
    """Folds a page into the store as one change: how many events were applied, skipped and settled as conflicts."""
    if engine.read_only:
        from mnemora.errors import ReadOnlyError

        raise ReadOnlyError("the store is open for reading only")
    known = changes.where(F.col("entity_type").isin(*KINDS))
    page = engine.files.at(f"staging/{uuid.uuid4().hex}")
    fold(engine, known, config).write.parquet(page)
    try:
        folded = engine.spark.read.parquet(page)
        counts = {r["outcome"]: (r["n"], r["c"]) for r in folded.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("conflict").cast("int")).alias("c")).collect()}
        applied = sum(n for k, (n, _) in counts.items() if k != "skipped")
        if applied:
            parts = []
            for kind in KINDS:
                rows = folded.where((F.col("entity_type") == kind) & (F.col("outcome") != "skipped")).select(F.col("id").alias("entity_id"), "collective_id", "event_type", "origin", S.column_of(kind))
                parts.append(engine._append_table(kind, rows, F.col("event_type"), S.column_of(kind), True, F.col("origin")))
            # a deleted experience takes its edges along
            gone = folded.where("entity_type = 'Experience' AND outcome = 'deleted'").select("id")
            from mnemora.operators.graph import touching

            edges = touching(engine.table("Relation"), F.broadcast(gone)).select(F.col("id").alias("entity_id"), "collective_id")
            parts.append(engine._append_table("Relation", edges, "Deleted", None, False))
            engine._commit(*parts)
        return {"applied": applied, "skipped": counts.get("skipped", (0, 0))[0], "conflicts": sum(c or 0 for _, c in counts.values())}
    finally:
        engine.files.delete(page.removeprefix(engine.files.root + "/"))


def _checked(request: dict) -> None:
    if request.get("protocol") != PROTOCOL:
        raise SyncError(f"protocol version {request.get('protocol')} instead of {PROTOCOL}")


class SyncServer:
    def __init__(self, engine: Engine, config: SyncConfig = SyncConfig()):
        self.engine, self.config = engine, config.validate()

    @property
    def instance_id(self) -> str:
        return self.engine.instance_id

    def handle_handshake(self, request: dict) -> dict:
        _checked(request)
        if not request.get("instance_id"):
            raise SyncError("no instance id")
        return {"protocol": PROTOCOL, "instance_id": self.instance_id, "schema_version": S.SCHEMA_VERSION}

    def handle_push(self, changes: DataFrame) -> dict:
        last = changes.agg(F.max("seq")).first()[0] or 0
        return apply_changes(self.engine, changes, self.config) | {"acknowledged": last}

    def handle_pull(self, since: int, limit: int) -> dict:
        changes, last, more = changes_since(self.engine, since, min(limit, self.config.batch_size), self.config)
        return {"changes": changes, "last": last, "more": more}

    def handle_health(self) -> bool:
        return True


class InMemorySyncTransport:
    """Both stores in one session."""

    def __init__(self, server: SyncServer):
        self.server = server

    @classmethod
    def pair(cls, a: Engine, b: Engine, config: SyncConfig = SyncConfig()) -> tuple[InMemorySyncTransport, InMemorySyncTransport]:
        """What reaches b from a's side, and a from b's."""
        return cls(SyncServer(b, config)), cls(SyncServer(a, config))

    @property
    def instance_id(self) -> str:
        return self.server.instance_id

    def handshake(self, request: dict) -> dict:
        return self.server.handle_handshake(request)

    def push(self, changes: DataFrame) -> dict:
        return self.server.handle_push(changes)

    def pull(self, since: int, limit: int) -> dict:
        return self.server.handle_pull(since, limit)

    def health(self) -> bool:
        return self.server.handle_health()


class DirectorySyncTransport:
    """Requests and answers as tables in a folder that both sides reach.

    A request is `<n>.request.json` with its page beside it, an answer is
    `<n>.answer.json`; both name the protocol.  The other side calls `serve` in
    its own session, now and then or in a loop of its own.
    """

    def __init__(self, spark, folder: str, timeout_s: float = 60.0, wait=time.sleep):
        self.spark, self.files, self.timeout_s, self.wait = spark, Files(spark, folder), timeout_s, wait

    def _ask(self, what: str, changes: DataFrame | None = None, **request) -> dict:
        name = f"{time.time_ns():020d}-{uuid.uuid4().hex}"
        if changes is not None:
            changes.write.parquet(self.files.at(f"pages/{name}"))
        self.files.create(f"requests/{name}.json", {"protocol": PROTOCOL, "what": what} | request)
        end = time.monotonic() + self.timeout_s
        while not self.files.exists(f"done/{name}"):
            if time.monotonic() >= end:
                self.files.delete(f"requests/{name}.json")
                raise SyncError(f"no answer to {what}")
            self.wait(0.05)
        answer = self.files.read(f"answers/{name}.json")
        _checked(answer)
        if "error" in answer:
            raise SyncError(answer["error"])
        if answer.pop("page", None):
            answer["changes"] = self.spark.read.schema(S.LOG).parquet(self.files.at(f"answers/{name}.page"))
        return answer

    def handshake(self, request: dict) -> dict:
        return self._ask("handshake", **{k: v for k, v in request.items() if k != "protocol"})

    def push(self, changes: DataFrame) -> dict:
        return self._ask("push", changes)

    def pull(self, since: int, limit: int) -> dict:
        return self._ask("pull", since=since, limit=limit)

    def health(self) -> bool:
        try:
            return bool(self._ask("health")["ok"])
        except SyncError:
            return False

    @staticmethod
    def serve(server: SyncServer, folder: str) -> int:
        """Answers what waits in the folder; returns how many requests."""
        spark, files, n = server.engine.spark, Files(server.engine.spark, folder), 0
        for file in files.names("requests"):
            name, request = file.removesuffix(".json"), files.read(f"requests/{file}")
            answer: dict = {"protocol": PROTOCOL}
            try:
                _checked(request)
                if request["what"] == "handshake":
                    answer |= server.handle_handshake(request)
                elif request["what"] == "push":
                    answer |= server.handle_push(spark.read.schema(S.LOG).parquet(files.at(f"pages/{name}")))
                elif request["what"] == "pull":
                    got = server.handle_pull(request["since"], request["limit"])
                    got.pop("changes").write.parquet(files.at(f"answers/{name}.page"))
                    answer |= got | {"page": True}
                else:
                    answer |= {"ok": server.handle_health()}
            except Exception as e:  # noqa: BLE001  whatever failed is the asker's to know; other requests go on
                answer |= {"error": f"{type(e).__name__}: {e}"[:500]}
            files.create(f"answers/{name}.json", answer)
            files.create(f"done/{name}", {})
            files.delete(f"requests/{file}")
            files.delete(f"pages/{name}")
            n += 1
        return n


class SyncManager:
    def __init__(self, engine: Engine, transport: SyncTransport, config: SyncConfig = SyncConfig()):
        self.engine, self.transport, self.config, self.status = engine, transport, config.validate(), "Idle"
        self._thread: threading.Thread | None = None
        self._stop = threading.Event()

    def _peer(self) -> str:
        answer = self.transport.handshake({"protocol": PROTOCOL, "instance_id": self.engine.instance_id})
        _checked(answer)
        return answer["instance_id"]

    def push(self, peer: str) -> int:
        since = self.engine.load_cursor(peer, "push")
        changes, last, _ = changes_since(self.engine, since, self.config.batch_size, self.config)
        n = changes.count()
        if n:
            self.transport.push(changes)
        if last > since:
            self.engine.save_cursor(peer, "push", last)
        return n

    def pull(self, peer: str) -> tuple[int, bool]:
        since = self.engine.load_cursor(peer, "pull")
        page = self.transport.pull(since, self.config.batch_size)
        n = page["changes"].count()
        if n:
            apply_changes(self.engine, page["changes"], self.config)
        if page["last"] > since:
            self.engine.save_cursor(peer, "pull", page["last"])
        return n, page["more"]

    def sync_once(self) -> str:
        self.status = "Syncing"
        peer = self._peer()
        if self.config.direction != "PullOnly":
            self.push(peer)
        if self.config.direction != "PushOnly":
            self.pull(peer)
        self.status = "Idle"
        return self.status

    def initial_sync(self, progress=None) -> int:
        peer, total, batch, more = self._peer(), 0, 0, True
        while more:
            n, more = self.pull(peer)
            total, batch = total + n, batch + 1
            if progress:
                progress(batch, total, more)
        return total

    def _round(self, failed: int) -> tuple[int, float]:
        """One exchange: failures in a row, and milliseconds to wait.  Beyond max_retries it goes on at the longest wait."""
        try:
            self.sync_once()
            return 0, self.config.interval_ms
        except Exception as e:  # noqa: BLE001  a transport may fail in any way; the next round tries again
            self.status = f"Error({e})"
            return failed + 1, self.config.backoff(failed + 1) if failed < self.config.max_retries else self.config.most_ms

    def run(self, rounds: int, wait=time.sleep) -> None:
        """`rounds` exchanges; failures wait longer each time and go on."""
        failed = 0
        for _ in range(rounds):
            failed, ms = self._round(failed)
            if failed:
                wait(ms / 1000)

    def start(self) -> None:
        """Exchanges in the background, an interval apart, until stop()."""
        if self._thread is not None:
            raise SyncError("the loop runs already")
        self._stop.clear()

        def loop() -> None:
            failed = 0
            while not self._stop.is_set():
                failed, ms = self._round(failed)
                self._stop.wait(ms / 1000)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()

    def stop(self) -> None:
        self._stop.set()
        if self._thread is not None:
            self._thread.join()
        self._thread = None
