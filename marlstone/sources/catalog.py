"""Tables by name below one folder, with the few lookups that the operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from marlstone.sources.formats import exists, read


class Catalog:
    """Loads each table once; keep=True persists it."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool = False):
        self.spark, self.folder, self.keep, self._held = spark, folder.rstrip("/"), keep, {}

    def table(self, name: str) -> DataFrame:
        if name not in self._held:
            path = next((p for p in (f"{self.folder}/{name}.{k}" for k in ("parquet", "csv", "json")) if exists(self.spark, p)), None)
            if path is None:
                raise FileNotFoundError(f"no table {name} in {self.folder}")
            df = read(self.spark, path)
            self._held[name] = df.persist() if self.keep else df
        return self._held[name]

    def register(self, *names: str) -> None:
        """Temporary views of tables, for SQL."""
        for n in names:
            self.table(n).createOrReplaceTempView(n)

    def rows_by_ids(self, name: str, key: str, ids: DataFrame) -> DataFrame:
        return self.table(name).join(ids.select(F.col(ids.columns[0]).alias(key)).distinct(), key, "left_semi")

    def release(self) -> None:
        for df in self._held.values():
            df.unpersist()
        self._held.clear()
