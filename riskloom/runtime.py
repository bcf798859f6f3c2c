"""Session-level helpers: scratch tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_WRITTEN: dict[str, set[str]] = {}  # scratch folders of each application
_LOCK, _WRITERS, _BEFORE = Lock(), [], ["true"]  # threads inside ``cut`` and the setting they found


def local_session(cpus: int | str = 8, partitions: int = 8, app: str = "riskloom") -> SparkSession:
    """Session for tests and benchmarks on one machine."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.driver.bindAddress", "127.0.0.1")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="riskloom-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``, else one below the warehouse.

    Both are shared by all executors; a machine-local folder would be lost with its machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/scratch"
    return folder.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder."""
    folder = f"{shared_folder(spark)}/riskloom-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, set()).add(folder)
    return f"{folder}/{name}"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """The setting holds while any thread writes; the last one out puts the user's value back."""
    with _LOCK:
        if not _WRITERS:
            _BEFORE[0] = spark.conf.get(_CLEANUP)
            spark.conf.set(_CLEANUP, "true")
        _WRITERS.append(spark)
    try:
        yield
    finally:
        with _LOCK:
            _WRITERS.pop()
            if not _WRITERS:
                spark.conf.set(_CLEANUP, _BEFORE[0])


def cut(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write the rows once to the shared folder and go on from the written table.

    Later readers see the same rows even if executors are lost, and read only the
    columns they need.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with _shuffles_removed(spark):  # the shuffles of this write are of no use after it
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_folder = path.rpartition("/")[0]
    return out


def path_exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`cut` that nothing will read again."""
    for table in tables:
        folder = table._scratch_folder
        _WRITTEN[table.sparkSession.sparkContext.applicationId].discard(folder)
        _remove(table.sparkSession, folder)


def clear_scratch(spark: SparkSession) -> None:
    """Remove every scratch folder of this application, at its end."""
    for folder in _WRITTEN.pop(spark.sparkContext.applicationId, ()):
        _remove(spark, folder)
