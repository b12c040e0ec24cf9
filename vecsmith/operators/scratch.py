"""Scratch tables in shared storage: they cut lineage, survive lost executors and are deleted after use."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders of scratch tables that are still there, in the order in which they were made.
_MADE: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``.

    A local folder is used only where that setting is absent and all tasks run in this process; else that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", "")
    if not base and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or f"file://{tempfile.gettempdir()}/vecsmith-scratch"
    if "://" not in base and not base.startswith("file:"):
        base = f"file://{base}"
    return f"{base.rstrip('/')}/vecsmith-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table", codec: str = "zstd") -> DataFrame:
    """Write ``df`` to a shared scratch table and read it back.

    It cuts the lineage like ``checkpoint()`` and survives lost executors. The
    shuffle files of the finished write are released at once.
    """
    spark = df.sparkSession
    folder = scratch_dir(spark)
    with shuffle_cleanup(spark):
        df.write.option("compression", codec).parquet(f"{folder}/{name}")
    _MADE.append(folder)
    return spark.read.schema(df.schema).parquet(f"{folder}/{name}")


def stored_parts(spark: SparkSession, parts, schema) -> DataFrame:
    """Frames written one after the other into one scratch table, which is read back by one scan."""
    folder = scratch_dir(spark)
    for i, part in enumerate(parts):
        with shuffle_cleanup(spark):
            part.write.option("compression", "zstd").parquet(f"{folder}/parts/{i:09d}")
    _MADE.append(folder)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/parts")


def broadcast_if_small(table: DataFrame, rows: int = 300_000) -> DataFrame:
    """A stored table of a few numbers a row as a broadcast side if it has at most ``rows`` rows; else as it is, for a shuffled join."""
    return F.broadcast(table) if table.count() <= rows else table


def _deleted(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    _MADE.remove(folder)


def _read_by(tables: list[DataFrame]) -> set[str]:
    """The scratch folders whose files these tables read."""
    names = {folder.rsplit("/", 1)[-1]: folder for folder in _MADE}
    return {names[part] for table in tables for file in table.inputFiles() for part in file.split("/") if part in names}


def dropped(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete scratch tables that ``stored`` returned, once nothing reads them."""
    for folder in _read_by([*tables]):
        _deleted(spark, folder)


def cleared(spark: SparkSession) -> None:
    """Delete all scratch tables of this process that are left, e.g. those of built indexes, before the session ends."""
    for folder in list(_MADE):
        _deleted(spark, folder)


@contextlib.contextmanager
def scratch_removed(spark: SparkSession):
    """At its end, the scratch tables made within it are deleted, but for those that are read by the frames put into the list it gives."""
    before, keep = len(_MADE), []
    yield keep
    kept = _read_by(keep)
    for folder in _MADE[before:]:
        if folder not in kept:
            _deleted(spark, folder)


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession):
    """Within it, Spark removes a query's shuffle files when the query ends."""
    before = spark.conf.get(_CLEANUP, "false")
    with contextlib.suppress(Exception):
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with contextlib.suppress(Exception):
            spark.conf.set(_CLEANUP, before)
