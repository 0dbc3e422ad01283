"""Session set-up and the few helpers that need the running session."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side counts as small enough to be broadcast.
BROADCAST_ROWS = 200_000
#: Bytes of a scan up to which its rows may be spread over the cores by a shuffle.
SPREAD_BYTES = 128 << 20


def local_session(name: str = "lodeglass", cpus: int | None = None, partitions: int = 8) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    return (
        SparkSession.builder.master(f"local[{cpus or '*'}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", os.environ.get("LODEGLASS_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that setting
    is missing (tests, a laptop) a folder of this machine is used.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not named:
        named = tempfile.mkdtemp(prefix="lodeglass-checkpoint-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """`df`, computed once and kept in the shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """`df` with a broadcast hint if it has at most `max_rows` rows, else `df` as it is.

    The count stops at ``max_rows + 1`` rows. Without the hint Spark joins by
    shuffle and AQE splits skewed partitions.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def join_small_or_salted(left: DataFrame, right: DataFrame, keys: list[str], max_rows: int = BROADCAST_ROWS, salts: int = 32) -> DataFrame:
    """Inner join of `left` with `right`, which has few rows per key; a key may hold a third of all rows of `left`.

    A small `right` is broadcast. A larger one is repeated for each of `salts`
    shares into which the rows of `left` fall by hash.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        return left.join(F.broadcast(right), keys)
    cut = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return cut.join(copies, [*keys, "_salt"]).drop("_salt")


def spread(scan: DataFrame, max_bytes: int = SPREAD_BYTES) -> DataFrame:
    """A scan of at most `max_bytes`, over as many partitions as there are cores if it comes in fewer; any other as it is.

    For costly row-wise work on a table in one small file, which would else
    keep one core busy. What may be shuffled for it is bounded, however many
    cores a cluster has.
    """
    query, cores = scan._jdf.queryExecution(), scan.sparkSession.sparkContext.defaultParallelism
    size = int(str(query.optimizedPlan().stats().sizeInBytes()))
    if size > max_bytes or query.toRdd().getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application; its Python functions run there."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="lodeglass-package-")
    archive = shutil.make_archive(os.path.join(folder, "lodeglass"), "zip", os.path.dirname(here), os.path.basename(here))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def shipped(query):
    """`query(spark, folder)`, run with the package shipped."""

    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return query(spark, sf_dir)

    return run
