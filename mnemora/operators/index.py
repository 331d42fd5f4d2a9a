"""Vector indexes: one protocol, an exact strategy and an approximate one.

An index is a table of changes: inserted vectors and deletions under rising
numbers.  Its live rows are the last change of each id; a deleted id stays in the
table until it is inserted again.
"""

from __future__ import annotations

import uuid
from typing import Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemora.errors import ValidationError
from mnemora.functions.vectors import Cells, similarity, top
from mnemora.sources.files import Files

ROWS = "id string, embedding array<float>, deleted boolean, n bigint"


class VectorIndex(Protocol):
    def insert(self, id: str, embedding: list[float]) -> None: ...
    def insert_batch(self, rows: DataFrame) -> None: ...
    def search(self, query: list[float], k: int) -> DataFrame: ...
    def search_filtered(self, query: list[float], k: int, keep: Column) -> DataFrame: ...
    def delete(self, id: str) -> None: ...
    def is_deleted(self, id: str) -> bool: ...
    def contains(self, id: str) -> bool: ...
    def active_count(self) -> int: ...
    def total_count(self) -> int: ...
    def save(self, folder: str) -> None: ...


class ExactIndex:
    """Every live row is held against the query."""

    def __init__(self, spark: SparkSession, root: str, dimension: int):
        self.spark, self.files, self.dimension = spark, Files(spark, root), dimension

    def _changes(self) -> DataFrame:
        found = self.files.names("changes")
        return self.spark.read.schema(ROWS).parquet(*[self.files.at(f"changes/{n}") for n in found]) if found else self.spark.createDataFrame([], ROWS)

    def _write(self, rows: DataFrame) -> None:
        names = self.files.names("changes")
        n = int(names[-1].partition("-")[0]) + 1 if names else 1
        hidden = f"staging/{uuid.uuid4().hex}"
        rows.select("id", F.col("embedding").cast("array<float>").alias("embedding"), "deleted", F.lit(n).cast("long").alias("n")).write.parquet(self.files.at(hidden))
        self.files.rename(hidden, f"changes/{n:020d}-{uuid.uuid4().hex}")

    def _last(self) -> DataFrame:
        return self._changes().groupBy("id").agg(F.max_by(F.struct("embedding", "deleted"), "n").alias("last")).select("id", "last.*")

    def rows(self) -> DataFrame:
        """id, embedding of the live rows."""
        return self._last().where(~F.col("deleted")).select("id", "embedding")

    def insert(self, id: str, embedding: list[float]) -> None:
        self.insert_batch(self.spark.createDataFrame([(id, list(map(float, embedding)))], "id string, embedding array<float>"))

    def insert_batch(self, rows: DataFrame) -> None:
        """id, embedding; an id that is there is replaced, and one given twice stands once."""
        wrong = rows.where(F.coalesce(F.size("embedding"), F.lit(-1)) != self.dimension)
        if not wrong.isEmpty():
            raise ValidationError("DimensionMismatch", f"vectors must have {self.dimension} numbers")
        self._write(rows.groupBy("id").agg(F.min("embedding").alias("embedding")).withColumn("deleted", F.lit(False)))

    def delete(self, id: str) -> None:
        if self.contains(id):
            self._write(self._last().where(F.col("id") == id).withColumn("deleted", F.lit(True)))

    def contains(self, id: str) -> bool:
        return not self.rows().where(F.col("id") == id).isEmpty()

    def is_deleted(self, id: str) -> bool:
        return not self._last().where((F.col("id") == id) & F.col("deleted")).isEmpty()

    def active_count(self) -> int:
        return self.rows().count()

    def total_count(self) -> int:
        return self._last().count()

    def __len__(self) -> int:
        return self.active_count()

    def deleted_ids(self) -> DataFrame:
        return self._last().where("deleted").select("id")

    def restore_deleted(self, ids: DataFrame) -> None:
        """Marks these ids (id) as deleted, as a saved set has them."""
        self._write(self._last().join(ids.select("id"), "id", "left_semi").withColumn("deleted", F.lit(True)))

    def search(self, query: list[float], k: int) -> DataFrame:
        """id, distance: the k nearest by cosine distance, closest first, ties by id."""
        return self.search_filtered(query, k, F.lit(True))

    def search_filtered(self, query: list[float], k: int, keep: Column) -> DataFrame:
        """The same among the ids for which `keep` holds: the filter comes before the limit."""
        if len(query) != self.dimension:
            raise ValidationError("DimensionMismatch", str(len(query)))
        return self._nearest(self.rows().where(keep), query, k)

    def _nearest(self, rows: DataFrame, query: list[float], k: int) -> DataFrame:
        q = self.spark.createDataFrame([(list(map(float, query)),)], "q array<double>")
        near = rows.crossJoin(F.broadcast(q)).select("id", (1 - similarity(F.col("embedding"), F.col("q"))).alias("distance"))
        return top(near.where(F.col("distance").isNotNull()), k, F.asc("distance"), F.asc("id"))

    def save(self, folder: str) -> None:
        """The last change of each id as an index of its own."""
        other = type(self)(self.spark, folder, self.dimension)
        if other.files.names("changes"):
            other.files.delete("changes")
        other._write(self._last())

    def remove_files(self) -> None:
        self.files.delete("changes")


class ApproximateIndex(ExactIndex):
    """Only rows in the query's nearest cells are held against it; cells follow from the live rows when first asked for."""

    def __init__(self, spark: SparkSession, root: str, dimension: int, probes: int = 8, cell_rows: int = 256):
        super().__init__(spark, root, dimension)
        self.probes, self.cell_rows = probes, cell_rows
        self._cells: tuple[tuple[str, ...], Cells] | None = None

    def _index(self) -> Cells:
        now = tuple(self.files.names("changes"))
        if self._cells is None or self._cells[0] != now:
            self._cells = now, Cells(self.rows().withColumn("collective_id", F.lit(0)), self.cell_rows)
        return self._cells[1]

    def search_filtered(self, query: list[float], k: int, keep: Column) -> DataFrame:
        if len(query) != self.dimension:
            raise ValidationError("DimensionMismatch", str(len(query)))
        cells = self._index()
        q = self.spark.createDataFrame([(0, 0, list(map(float, query)))], "query_id long, collective_id int, embedding array<float>")
        wanted = cells._placed(q, "query_id", self.probes).select("collective_id", "cell")
        return self._nearest(cells.rows.where(keep).join(F.broadcast(wanted), ["collective_id", "cell"], "left_semi").select("id", "embedding"), query, k)
