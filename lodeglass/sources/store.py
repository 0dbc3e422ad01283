"""Keyed tables as Parquet folders: append-only versions, last write wins."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class KeyedTable:
    """A table with a key, kept as appended versions below one folder.

    Each write appends a part with a sequence number, so that writes never
    rewrite what is there; a reader takes each key's latest version. `compact`
    writes the present state to a new folder and switches to it by a rename.
    """

    def __init__(self, spark: SparkSession, folder: str, key: list[str], schema: str):
        self.spark, self.folder, self.key, self.schema = spark, folder.rstrip("/"), key, schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _parts(self) -> list[tuple[int, str]]:
        at = self._path(self.folder)
        names = [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []
        return sorted((int(n.split("-")[1]), n) for n in names if n.startswith("part-"))

    def _write(self, rows: DataFrame, deleted: bool, seq: int | None = None) -> None:
        """Publish a part. Its name is its own, so that writers at the same time never meet; of theirs the greater name counts."""
        if seq is None:
            parts = self._parts()
            seq = parts[-1][0] + 1 if parts else 0
        own = uuid.uuid4().hex
        fields = self.spark.createDataFrame([], self.schema).schema
        kept = rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields])
        staged = f"{self.folder}/_staged-{own}"
        kept.withColumn("_deleted", F.lit(deleted)).withColumn("_seq", F.lit(f"{seq:018d}-{own}")).write.parquet(staged)
        if not self._fs.rename(self._path(staged), self._path(f"{self.folder}/part-{seq}-{own}")):
            raise OSError(f"couldn't publish part {seq} of {self.folder}")

    def upsert(self, rows: DataFrame) -> None:
        """Add or replace; of several rows with one key in `rows` any one stays."""
        self._write(rows.dropDuplicates(self.key), False)

    def delete(self, keys: DataFrame) -> None:
        self._write(keys.select(*self.key).distinct(), True)

    def delete_where(self, condition: Column) -> int:
        """Delete the present rows that meet a condition; how many."""
        gone = self.read().where(condition).select(*self.key)
        n = gone.count()
        if n:
            self.delete(gone)
        return n

    def read(self) -> DataFrame:
        return self._state_of(self._parts())

    def _state_of(self, parts: list[tuple[int, str]]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], self.schema)
        rows = self.spark.read.parquet(*[f"{self.folder}/{name}" for _, name in parts])
        columns = [c for c in rows.columns if c not in ("_seq", "_deleted")]
        last = rows.groupBy(*self.key).agg(F.max_by(F.struct(*columns, "_deleted"), "_seq").alias("_r"))
        return last.where("NOT _r._deleted").select("_r.*").drop("_deleted")

    def get(self, **key) -> DataFrame:
        rows = self.read()
        for name, value in key.items():
            rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
        return rows

    def has_changed(self, column: str, value, **key) -> bool:
        """Whether the row of a key is missing or holds another value there; letter case of texts means nothing."""
        row = self.get(**key).select(column).first()
        fold = lambda x: x.lower() if isinstance(x, str) else x
        return row is None or fold(row[0]) != fold(value)

    def latest(self, at: str, limit: int | None = None) -> DataFrame:
        """The present rows, latest first by a time column."""
        rows = self.read().orderBy(F.col(at).desc(), *self.key)
        return rows if limit is None else rows.limit(limit)

    def count(self) -> int:
        return self.read().count()

    def compact(self) -> None:
        """Replace the parts that are there by one with their state; it takes the number of the last of them, below any that lands meanwhile."""
        parts = self._parts()
        if len(parts) > 1:
            self._write(self._state_of(parts), False, parts[-1][0])
            for _, name in parts:  # oldest first: what a later part deletes goes before that part
                self._fs.delete(self._path(f"{self.folder}/{name}"), True)
