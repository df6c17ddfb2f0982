"""A shared folder for products that several steps read."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from collections.abc import Iterator, Sequence
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"
WAREHOUSE = "spark.sql.warehouse.dir"
# How rows of a series lie in a stored product, so that symbol and time filters skip row groups.
SERIES_ORDER = ("symbol", "time")
# Folders made by sessions of this process and not removed yet, by application.
_made: dict[str, list[str]] = {}
# Folders of the driver's machine that sessions have for themselves, by application.
_own: dict[str, str] = {}
# Whether products can lie in a folder, by application and folder.
_serves: dict[tuple[str, str], bool] = {}


def shared_base(spark: SparkSession) -> str:
    """The folder ``spark.checkpoint.dir``, or another one where that does not serve.

    A session on one machine may go without that setting and then gets a folder of its own. On a
    cluster the setting should name its file system, because a bare path would be a different folder
    on every machine wherever no shared file system is the default. If it does not, products go to the
    first of these folders that a trial finds shared: the warehouse, which executors share as they
    write its tables and whose path Spark completes; the folder in which Spark keeps checkpoints;
    Spark's default warehouse, which lies in the driver's working folder; for executors that run
    beside the driver, a folder of the driver's own.
    """
    base, master = spark.conf.get(SETTING, None), spark.sparkContext.master
    if re.fullmatch(r"local(\[[^\]]*\])?", master):
        base = base or checkpoint_folder(spark) or own_folder(spark)
    elif not names_file_system(base):
        warehouse, beside = spark.conf.get(WAREHOUSE, None), master.startswith("local-cluster[")
        default = warehouse and re.fullmatch(r"file:.*/spark-warehouse/?", warehouse)
        folders = [(warehouse, not default or beside), (checkpoint_folder(spark), True)]
        if default:
            folders.reverse()
        base = next((f for f, untried in folders if names_file_system(f) and serves(spark, f, untried)), None)
        if not base and beside and hasattr(spark, "_jvm") and serves(spark, own_folder(spark)):
            base = own_folder(spark)
        if not base:
            raise ValueError(f"set {SETTING} to a folder that all executors share, with its scheme")
    return base.rstrip("/")


def checkpoint_folder(spark: SparkSession) -> str | None:
    """Where Spark has made the folder of the session's checkpoints, with its file system."""
    asked = getattr(spark.sparkContext, "getCheckpointDir", lambda: None)()
    return os.path.dirname(asked) if asked else None


def own_folder(spark: SparkSession) -> str:
    """A folder of the driver's machine. The session remembers it here, as Spark lets no session
    change ``spark.checkpoint.dir``."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = f"file:{os.path.realpath(tempfile.mkdtemp(prefix='barloom-'))}"
    return _own[app]


def serves(spark: SparkSession, folder: str, untried: bool = True) -> bool:
    """Whether a table that all executors write below a folder is there as a whole for the driver and
    can be read by other executors. Tried once in a session; ``untried`` where there is no JVM."""
    if not hasattr(spark, "_jvm"):
        return untried
    key = (spark.sparkContext.applicationId, folder)
    if key not in _serves:
        _serves[key] = tried(spark, folder)
    return _serves[key]


def tried(spark: SparkSession, folder: str) -> bool:
    trial, rows = f"{folder.rstrip('/')}/barloom-{uuid.uuid4().hex}", 2 * spark.sparkContext.defaultParallelism
    try:
        spark.range(0, rows, 1, rows).write.parquet(trial)
        return spark.read.schema("id long").parquet(trial).count() == rows
    except (PySparkException, Py4JError):
        return False
    finally:
        with suppress(Py4JError):
            removed(spark, trial)


def names_file_system(path: str | None) -> bool:
    return re.match(r"[a-z][a-z0-9+.-]*:", path or "", re.IGNORECASE) is not None


def shared_folder(spark: SparkSession) -> str:
    """A new path under ``shared_base``, which goes with ``remove_products``."""
    path = f"{shared_base(spark)}/barloom-{uuid.uuid4().hex}"
    _made.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def importable(spark: SparkSession) -> None:
    """Let Python workers find this package where the driver has it, besides their own path. On a
    cluster it is installed or sent along, and the extra entry finds nothing."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))


def stored(df: DataFrame, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write a product that several steps read and return the written table.

    Rows of series are sorted inside the files by symbol and time.
    """
    path = shared_folder(df.sparkSession)
    rows = df
    if set(SERIES_ORDER) <= set(df.columns):
        rows = df.sortWithinPartitions(*partition_by, *SERIES_ORDER)
    rows.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def exists(spark: SparkSession, folder: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def moved(spark: SparkSession, source: str, target: str) -> bool:
    """Rename a folder; False if the target is there already. Other readers see all of it or nothing."""
    paths = [spark._jvm.org.apache.hadoop.fs.Path(p) for p in (source, target)]
    system = paths[0].getFileSystem(spark._jsc.hadoopConfiguration())
    system.mkdirs(paths[1].getParent())
    return not system.exists(paths[1]) and system.rename(*paths)


def removed(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def products_made(spark: SparkSession) -> int:
    """Folders that this session made and has not removed."""
    return len(_made.get(spark.sparkContext.applicationId, []))


def remove_products(spark: SparkSession, since: int = 0, keep: Sequence[str] = ()) -> int:
    """Delete the folders that this session made, from the ``since``-th on and but for those to
    ``keep``; how many there were."""
    made = _made.get(spark.sparkContext.applicationId, [])
    going = [folder for folder in made[since:] if folder not in keep]
    for folder in going:
        removed(spark, folder)
    made[since:] = [folder for folder in made[since:] if folder in keep]
    return len(going)


@contextmanager
def products(spark: SparkSession) -> Iterator[SparkSession]:
    """Whatever is stored inside the block is deleted at its end; results must be out by then."""
    since = products_made(spark)
    try:
        yield spark
    finally:
        remove_products(spark, since)
