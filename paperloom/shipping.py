"""Makes this package importable in Python workers and gives jobs a folder that all machines share."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Sends the package to workers that cannot import it from their path; once for each application."""
    on_path = [os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if str(_ROOT) in on_path or app in _shipped:
        return
    folder = tempfile.mkdtemp(prefix="paperloom-")
    atexit.register(shutil.rmtree, folder, True)
    target = os.path.join(folder, "paperloom.zip")
    with zipfile.ZipFile(target, "w") as archive:
        for path in sorted((_ROOT / "paperloom").rglob("*.py")):
            archive.write(path, path.relative_to(_ROOT))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def release_memory() -> None:
    """Gives memory that a Python worker no longer uses back to the system; workers outlive their tasks."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def then_released(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The function of batches, after which its worker's memory is released."""

    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        release_memory()

    return whole


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where a local session names none, a new one is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="paperloom-shared-")
        atexit.register(shutil.rmtree, folder.removeprefix("file://"), True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the file system removes it when the driver's JVM ends."""
    path = f"{shared_folder(spark)}/paperloom-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: the rows as a Parquet table in the shared folder, which survives lost executors."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Ids up to this number are broadcast (some 30 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def filter_by_ids(rows: DataFrame, key: str, ids: DataFrame, keep: bool) -> DataFrame:
    """The rows whose key is (keep) or isn't among the ids, a stored table of one column. Its size is counted first."""
    from pyspark.sql import functions as F

    small = ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS
    other = f"id_{uuid.uuid4().hex}"  # a name that no table has
    ids = ids.withColumnRenamed(ids.columns[0], other)
    return rows.join(F.broadcast(ids) if small else ids, F.col(key) == F.col(other), "left_semi" if keep else "left_anti")
