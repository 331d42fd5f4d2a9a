"""The engine's tables: an append-only typed log, and columnar state merged from it.

`log/<first>-<last>/` holds the rows of one change under their sequence numbers;
a folder appears there by one rename, which is the commit.  `claims/<first>` is
created before, so two writers never get the same numbers.  `state/<seq>/<kind>/`
is each entity's row as of a sequence number, partitioned by collective, and
`state/<seq>.json` appears when it is whole.  A read takes the newest state and
lays the changes since then over it: a scan that Spark prunes by collective and
column, and a short tail.  Nothing is ever rewritten in place.
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora import schemas as S
from mnemora.sources.files import Files

#: Changes that a read lays over the state before they are merged into it.
MERGE_EVERY = 64
#: Numbers of a partition of monotonically_increasing_id.
_SPAN = 1 << 33


def typed(kind: str, body: str | Column | None = None) -> list[Column]:
    """A column for each kind: the given one for its own, null for the others."""
    return [(F.lit(None) if k != kind or body is None else (F.col(body) if isinstance(body, str) else body)).cast(f"struct<{S.struct_of(k)}>").alias(S.column_of(k)) for k in S.TABLES]


class Storage(Protocol):
    """What the engine asks of its storage; `Tables` keeps it in Parquet folders."""

    log_path: str

    def log(self, since: int = 0, rows: int | None = None) -> DataFrame: ...
    def last_seq(self) -> int: ...
    def append(self, rows: DataFrame) -> int: ...
    def put(self, rows: list[tuple]) -> int: ...
    def state(self, kind: str, collective_id: str | None = None, key: str | None = None) -> DataFrame: ...
    def merge(self) -> int: ...
    def merge_if_long(self) -> None: ...
    def drop_log(self, upto: int) -> int: ...


class Tables:
    def __init__(self, spark: SparkSession, root: str, merge_every: int = MERGE_EVERY):
        self.spark, self.files, self.merge_every = spark, Files(spark, root), merge_every
        self._seq = 0

    # the log

    @property
    def log_path(self) -> str:
        return self.files.at("log")

    def changes(self, since: int = 0) -> list[str]:
        """Folders with rows after a sequence number."""
        return [f"log/{n}" for n in self.files.names("log") if int(n.rpartition("-")[2]) > since]

    def log(self, since: int = 0, rows: int | None = None) -> DataFrame:
        """Rows of the log after a sequence number; folders before it aren't read, nor such as come after the first `rows` rows."""
        found = self.changes(since)
        if rows is not None:
            have = 0
            for k, name in enumerate(found):
                first, _, last = name.rpartition("/")[2].partition("-")
                have += int(last) - max(int(first) - 1, since)
                if have >= rows:
                    found = found[: k + 1]
                    break
        if not found:
            return self.spark.createDataFrame([], S.LOG)
        out = self.spark.read.schema(S.LOG).parquet(*map(self.files.at, found))
        return out.where(F.col("seq") > since) if since else out

    def last_seq(self) -> int:
        names = self.files.names("log")
        self._seq = max(self._seq, self.pointer()["seq"], int(names[-1].rpartition("-")[2]) if names else 0)
        return self._seq

    def _claim(self, n: int) -> int:
        """The first of n sequence numbers that are this change's own."""
        self.last_seq()
        while not self.files.create(name := f"claims/{self._seq + 1:020d}", {"last": self._seq + n}):
            self._seq = max(self._seq + 1, self.files.read(name)["last"])
        first = self._seq + 1
        self._seq += n
        return first

    def append(self, rows: DataFrame) -> int:
        """Writes rows (entity_type, event_type, entity_id, collective_id, ts_ms, origin, visible, a column a kind) as one change, numbered in their order; returns how many."""
        hidden = f"staging/{uuid.uuid4().hex}"
        numbered = rows.withColumn("_n", F.monotonically_increasing_id())
        numbered.write.parquet(self.files.at(f"{hidden}/rows"))
        staged = self.spark.read.schema(numbered.schema).parquet(self.files.at(f"{hidden}/rows"))
        # a row a write task
        counts = staged.groupBy(F.floor(F.col("_n") / _SPAN).alias("_part")).agg(F.count(F.lit(1)).alias("n")).orderBy("_part").collect()
        total = sum(c["n"] for c in counts)
        if total:
            base, before = [], 0
            first = self._claim(total)
            for c in counts:
                base.append((c["_part"], first + before))
                before += c["n"]
            bases = self.spark.createDataFrame(base, "_part bigint, _base bigint")
            ranked = staged.withColumn("_part", F.floor(F.col("_n") / _SPAN)).join(F.broadcast(bases), "_part").withColumn("seq", F.col("_base") + F.col("_n") % _SPAN)
            out = f"{hidden}/{first:020d}-{first + total - 1:020d}"
            ranked.select(*[c.split()[0] for c in S.LOG_HEAD], *map(S.column_of, S.TABLES)).write.parquet(self.files.at(out))
            self.files.rename(out, f"log/{out.rpartition('/')[2]}")
        self.files.delete(hidden)
        return total

    def put(self, rows: list[tuple]) -> int:
        """A small change: tuples as LOG has them, without seq; returns the last number."""
        first = self._claim(len(rows))
        hidden, name = f"staging/{uuid.uuid4().hex}", f"{first:020d}-{first + len(rows) - 1:020d}"
        self.spark.createDataFrame([(first + k, *r) for k, r in enumerate(rows)], S.LOG).coalesce(1).write.parquet(self.files.at(hidden))
        self.files.rename(hidden, f"log/{name}")
        return first + len(rows) - 1

    # state

    def pointer(self) -> dict:
        """The newest whole state: its sequence number and folder."""
        whole = [n for n in self.files.names("state") if n.endswith(".json")]
        return self.files.read(f"state/{whole[-1]}") if whole else {"seq": 0, "path": None}

    def state(self, kind: str, collective_id: str | None = None, key: str | None = None) -> DataFrame:
        """The kind's live rows: entity_id, _collective and the entity's columns."""
        p = self.pointer()
        columns = S.names_of(kind)

        def only(df: DataFrame, collective: str) -> DataFrame:
            if collective_id is not None:
                df = df.where(F.col(collective) == collective_id)
            return df if key is None else df.where(F.col("entity_id") == key)

        tail = None
        if self.changes(p["seq"]):
            rows = only(self.log(p["seq"]).where(F.col("entity_type") == kind), "collective_id")
            # one row an entity; what is laid over the state is short
            tail = rows.groupBy("entity_id").agg(F.max_by(F.struct("event_type", "collective_id", S.column_of(kind)), "seq").alias("last"))
        if p["path"] is None:
            merged = None
        else:
            merged = only(self.spark.read.schema(S.state_of(kind)).parquet(f"{p['path']}/{kind}"), "_collective")
            if tail is not None:
                merged = merged.join(tail.select("entity_id"), "entity_id", "left_anti")
        if tail is None and merged is None:
            return self.spark.createDataFrame([], S.state_of(kind))
        if tail is not None:
            own = S.column_of(kind)
            live = tail.where(F.col("last.event_type") != "Deleted").select("entity_id", *[F.col(f"last.{own}.{c}").alias(c) for c in columns], F.col("last.collective_id").alias("_collective"))
            merged = live if merged is None else merged.select("entity_id", *columns, "_collective").unionByName(live)
        return merged

    def merge(self) -> int:
        """Lays all changes so far into a new state; returns its sequence number.  Readers of older ones go on undisturbed."""
        seq, p = self.last_seq(), self.pointer()
        if seq == p["seq"] or not self.changes(p["seq"]):
            return p["seq"]
        path = f"state/{seq:020d}-{uuid.uuid4().hex}"
        for kind in S.TABLES:
            # rebalanced at run time: no task gets more of a collective than it should write
            self.state(kind).hint("rebalance", "_collective").sortWithinPartitions("_collective", "entity_id").write.partitionBy("_collective").parquet(self.files.at(f"{path}/{kind}"))
        self.files.create(f"state/{seq:020d}.json", {"seq": seq, "path": self.files.at(path)})
        for n in self.files.names("claims"):
            if int(n) <= seq:
                self.files.delete(f"claims/{n}")
        return seq

    def merge_if_long(self) -> None:
        if len(self.changes(self.pointer()["seq"])) > self.merge_every:
            self.merge()

    def drop_log(self, upto: int) -> int:
        """Deletes changes whose numbers are all `upto` at most, which the state must hold; returns their rows."""
        gone = 0
        for n in self.files.names("log"):
            first, _, last = n.partition("-")
            if int(last) <= min(upto, self.pointer()["seq"]):
                self.files.delete(f"log/{n}")
                gone += int(last) - int(first) + 1
        return gone

    def fork(self, root: str) -> Tables:
        """Another store that starts from this one's state, which it shares until its own next merge."""
        self.merge()
        other = Tables(self.spark, root, self.merge_every)
        p = self.pointer()
        other.files.create(f"state/{p['seq']:020d}.json", p)
        return other
