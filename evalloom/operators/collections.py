"""Collections of points: tables of (point_id, embedding, ...) with vectors of one size, in which a point that comes again replaces the stored one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalloom.sources.scratch import children, deleted, exists
from evalloom.streaming.keyed import KeyedTable

KEY, VECTOR = "point_id", "embedding"


class Collections:
    """The collections below a folder. A collection's settings are a row that is written before its points."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 16) -> None:
        self.spark, self.folder, self.buckets = spark, folder, buckets

    def _path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def _points(self, name: str) -> KeyedTable:
        return KeyedTable(self.spark, f"{self._path(name)}/points", [KEY], buckets=self.buckets)

    def exists(self, name: str) -> bool:
        return exists(self.spark, f"{self._path(name)}/settings/_SUCCESS")

    def names(self) -> list[str]:
        return sorted(n for n in children(self.spark, self.folder) if self.exists(n))

    def dims(self, name: str) -> int:
        if not self.exists(name):
            raise LookupError(f"no collection {name}")
        return self.spark.read.parquet(f"{self._path(name)}/settings").first()["dims"]

    def ensure(self, name: str, dims: int, recreate: bool = False) -> None:
        """Makes a collection unless there is one; one of another size is an error, unless it is to be made anew."""
        if recreate:
            self.delete(name)
        elif self.exists(name):
            if (stored := self.dims(name)) != dims:
                raise ValueError(f"collection {name} has vectors of {stored} entries, not {dims}")
            return
        self.spark.range(1).select(F.lit(dims).alias("dims")).write.mode("overwrite").parquet(f"{self._path(name)}/settings")

    def delete(self, name: str) -> bool:
        return deleted(self.spark, self._path(name))

    def upsert(self, name: str, points: DataFrame) -> None:
        """Writes points in place of those with their ids. A vector of another size, or none, is an error and nothing is written."""
        dims = self.dims(name)
        if not points.where(F.coalesce(F.size(VECTOR), F.lit(-1)) != dims).isEmpty():
            raise ValueError(f"vectors must have {dims} entries")
        table = self._points(name)
        table.merge(points, max(table.versions().values(), default=-1) + 1)

    def read(self, name: str, schema=None) -> DataFrame:
        """The points of a collection; ``schema`` is needed only while it is empty."""
        table = self._points(name)
        paths = [f"{table.path}/batch={n}/bucket={b}" for b, n in table.versions().items()]
        if not paths and schema is None:
            schema = self.spark.createDataFrame([], f"{KEY} string, {VECTOR} array<double>").schema
        return self.spark.read.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def info(self, name: str) -> DataFrame:
        """One row: name, dims, points."""
        dims = self.dims(name)
        return self.read(name).agg(F.count("*").alias("points")).select(F.lit(name).alias("name"), F.lit(dims).alias("dims"), "points")
