"""Processing only new or changed records.

A manifest holds what earlier successful runs have processed: one row per key
with the checksum (and the size, where its column is named) it had then. A run anti-joins the present listing
against it, writes its output under its own batch identifier, writes its
manifest rows, and commits both with one atomic rename. A run that dies before
the rename leaves nothing that a reader would see, and running the same batch
again overwrites what it left, so that no record is skipped or repeated.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodeglass.session import broadcast_if_small


def _sum_of(column: str) -> F.Column:
    """A checksum in its comparable form: letter case means nothing."""
    return F.lower(F.col(column))


def present_files(reads: DataFrame) -> DataFrame:
    """(path, hash): each file's hash as of its latest read.

    Reads without hash (the file could not be read), without path or without
    read time are left aside. Among reads of the same time the greatest hash
    counts. Repeated rows change nothing. An empty table gives no rows. The
    aggregate combines before the shuffle, so that one much-read file is no
    hot spot.
    """
    return (
        reads.where("hash IS NOT NULL AND path IS NOT NULL AND last_read_at IS NOT NULL")
        .select("path", F.struct("last_read_at", _sum_of("hash").alias("hash")).alias("_r"))
        .groupBy("path")
        .agg(F.max("_r").alias("_r"))
        .select("path", F.col("_r.hash").alias("hash"))
    )


def final_status(runs: DataFrame) -> DataFrame:
    """(run_id, status): the status with the latest noted_at; the greatest status among equals."""
    return (
        runs.where("run_id IS NOT NULL AND noted_at IS NOT NULL")
        .groupBy("run_id")
        .agg(F.max(F.struct("noted_at", "status")).alias("_r"))
        .select("run_id", F.col("_r.status").alias("status"))
    )


def indexed_files(entries: DataFrame, runs: DataFrame, ok: str = "ok") -> DataFrame:
    """(path, hash): the manifest, i.e. each file's hash as the latest successful run left it.

    `entries` has file_path, hash, indexed_at and run_id. Rows of runs whose
    final status isn't `ok`, rows without run, path or time are left aside. A
    latest row without hash gives a row without hash, which equals no hash.
    """
    good = final_status(runs).where(F.col("status") == ok).select("run_id")
    return (
        entries.where("file_path IS NOT NULL AND indexed_at IS NOT NULL")
        .select("file_path", "hash", "indexed_at", "run_id")
        .join(broadcast_if_small(good), "run_id", "left_semi")
        .groupBy(F.col("file_path").alias("path"))
        .agg(F.max(F.struct("indexed_at", _sum_of("hash").alias("hash"))).alias("_r"))
        .select("path", F.col("_r.hash").alias("hash"))
    )


def pending(listing: DataFrame, manifest: DataFrame, key: str = "path", checksum: str = "hash", size: str | None = None) -> DataFrame:
    """Rows of `listing` that the manifest doesn't hold with the same checksum and, if `size` is named, size.

    Both sides have one row per key. Keys are compared exactly, checksums
    without regard to letter case. A listed row without checksum is pending
    whenever it has a key. A manifest row without size, as from before sizes
    were kept, tells by its checksum alone. Other columns of `listing` stay; those of the
    manifest, whatever their names, don't get in.
    """
    mark = "_done"
    while any(c.lower().startswith(mark) for c in listing.columns):
        mark = f"_{mark}"
    sizes = [F.col(size).alias(f"{mark}_size")] if size else []
    done = manifest.select(F.col(key).alias(f"{mark}_key"), _sum_of(checksum).alias(f"{mark}_sum"), *sizes)
    same = (F.col(key) == F.col(f"{mark}_key")) & (_sum_of(checksum) == F.col(f"{mark}_sum"))
    if size:
        same &= F.col(f"{mark}_size").isNull() | F.col(size).eqNullSafe(F.col(f"{mark}_size"))
    return listing.where(F.col(key).isNotNull()).join(done, same, "left_anti")


def removed(listing: DataFrame, manifest: DataFrame, key: str = "path") -> DataFrame:
    """Keys of the manifest that the listing no longer has."""
    return manifest.select(key).join(listing.select(key), key, "left_anti")


class Ledger:
    """Manifest, outputs and commits of an incremental job below one folder.

    ``pending/<batch>`` what the batch has to do, frozen when it first began;
    ``output/batch=<batch>`` its result; ``manifest/batch=<batch>`` the keys
    and checksums (with `size`, that column too) it covers; ``commits/<batch>``
    a small file that makes the batch count. Of two batches that hold a key
    the one committed later counts. Keys that a complete listing no longer has
    are noted as gone. `compact` puts the manifests of all batches so far into
    one. Works on any file system that Hadoop knows.
    """

    #: How the manifests begin that `compact` writes.
    SNAPSHOT = "snapshot."

    def __init__(self, spark: SparkSession, root: str, key: str = "path", checksum: str = "hash", size: str | None = None):
        self.spark, self.root, self.key, self.checksum, self.size = spark, root.rstrip("/"), key, checksum, size
        self._state = [checksum, size] if size else [checksum]
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    # -- commits ---------------------------------------------------------
    def _commits(self) -> list[str]:
        """Names of commits, oldest first (a bounded list: one per run)."""
        at = self._path(f"{self.root}/commits")
        if not self._fs.exists(at):
            return []
        found = [(s.getModificationTime(), s.getPath().getName()) for s in self._fs.listStatus(at)]
        return [name for _, name in sorted(found) if not name.startswith(("_", "."))]

    def committed(self) -> list[str]:
        """Identifiers of the batches that count, oldest first."""
        return [name for name in self._commits() if not name.startswith(self.SNAPSHOT)]

    def _commit(self, batch: str, about: dict) -> None:
        tmp, to = self._path(f"{self.root}/commits/_{batch}"), self._path(f"{self.root}/commits/{batch}")
        out = self._fs.create(tmp, True)
        out.write(bytearray(json.dumps(about), "utf-8"))
        out.close()
        if not self._fs.rename(tmp, to) and not self._fs.exists(to):
            raise OSError(f"batch {batch} couldn't be committed")

    def _about(self, name: str) -> dict:
        stream = self._fs.open(self._path(f"{self.root}/commits/{name}"))
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        return json.loads(text)

    def _live(self) -> list[str]:
        """Manifests to read, oldest first: the last snapshot and what it doesn't cover."""
        names = self._commits()
        last = max((n for n in names if n.startswith(self.SNAPSHOT)), key=names.index, default=None)
        if last is None:
            return names
        covered = set(self._about(last)["covers"])
        return [last, *(n for n in names if n not in covered and not n.startswith(self.SNAPSHOT))]

    def _read(self, kind: str, names: list[str]) -> DataFrame | None:
        paths = [f"{self.root}/{kind}/batch={b}" for b in names]
        paths = [p for p in paths if self._fs.exists(self._path(p))]
        return self.spark.read.option("basePath", f"{self.root}/{kind}").option("mergeSchema", kind == "manifest").parquet(*paths) if paths else None

    def _latest(self, gone: bool = False) -> DataFrame | None:
        """(key, checksum and size, of): each key's latest state and the batch that holds its output; with `gone`, gone ones too."""
        names = self._live()
        rows = self._read("manifest", names)
        if rows is None:
            return None
        for c, kind in ((self.size, "bigint"), ("gone", "boolean"), ("of", "string")):  # batches from before these were kept
            if c and c not in rows.columns:
                rows = rows.withColumn(c, F.lit(None).cast(kind))
        order = self.spark.createDataFrame(list(enumerate(names)), "_seq int, batch string")
        state = F.struct(*self._state, F.coalesce("gone", F.lit(False)).alias("gone"), F.coalesce("of", F.col("batch").cast("string")).alias("of"))
        # one row per run
        last = rows.withColumn("batch", F.col("batch").cast("string")).join(F.broadcast(order), "batch").groupBy(self.key).agg(F.max_by(state, "_seq").alias("_r"))
        kept = last.select(self.key, "_r.*")
        return kept if gone else kept.where("NOT gone")

    # -- reading ---------------------------------------------------------
    def manifest(self) -> DataFrame:
        """(key, checksum), with `size` (key, checksum, size): the latest committed state of each key that isn't gone."""
        rows = self._latest()
        if rows is None:
            return self.spark.createDataFrame([], f"`{self.key}` string, `{self.checksum}` string" + (f", `{self.size}` bigint" if self.size else ""))
        return rows.select(self.key, *self._state)

    def output(self) -> DataFrame | None:
        """All committed output rows, each with its batch."""
        return self._read("output", self.committed())

    def current_output(self) -> DataFrame | None:
        """Output rows of each present key's latest batch only."""
        out, last = self.output(), self._latest()
        if out is None or last is None:
            return None
        return out.withColumn("batch", F.col("batch").cast("string")).join(last.select(self.key, F.col("of").alias("batch")), [self.key, "batch"], "left_semi")

    # -- running ---------------------------------------------------------
    def run(self, batch: str, listing: DataFrame, work: Callable[[DataFrame], DataFrame], complete: bool = False) -> bool:
        """Process what is pending as batch `batch`; False if it was committed before.

        `work` takes the pending rows and returns output rows that keep the
        key column. A retry after a failure works on the same frozen rows.
        `complete` says that the listing names all there is: keys that it
        doesn't name are gone, with their output, until they come back.
        """
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9_.-]*", batch) or batch.startswith(self.SNAPSHOT):
            raise ValueError(f"not a batch identifier: {batch!r}")
        if batch in self.committed():
            return False
        frozen = f"{self.root}/pending/{batch}"
        if not self._fs.exists(self._path(f"{frozen}/_SUCCESS")):
            pending(listing, self.manifest(), self.key, self.checksum, self.size).write.mode("overwrite").parquet(frozen)
        todo = self.spark.read.parquet(frozen)
        work(todo).write.mode("overwrite").parquet(f"{self.root}/output/batch={batch}")
        done = todo.select(self.key, *self._state, F.lit(False).alias("gone"))
        if complete:
            lost = removed(listing, self.manifest(), self.key)
            done = done.unionByName(lost.select(self.key, *[F.lit(None).cast(todo.schema[c].dataType).alias(c) for c in self._state], F.lit(True).alias("gone")))
        done.write.mode("overwrite").parquet(f"{self.root}/manifest/batch={batch}")
        self._commit(batch, {"batch": batch})
        return True

    def compact(self, name: str) -> None:
        """Put the manifests so far into one, under the name ``snapshot.<name>``; keys that are gone leave it. Batches committed meanwhile stay."""
        covers = [n for n in self._live()]
        rows = self._latest()
        if rows is None:
            return
        rows.write.mode("overwrite").parquet(f"{self.root}/manifest/batch={self.SNAPSHOT}{name}")
        earlier = [n for n in self._commits() if n.startswith(self.SNAPSHOT)]
        known = {x for n in earlier for x in self._about(n)["covers"]}
        self._commit(f"{self.SNAPSHOT}{name}", {"covers": sorted(known | set(covers))})
