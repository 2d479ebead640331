"""Session and storage helpers shared by every module."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[8]", shuffle_partitions: int = 8, app: str = "sparkseam") -> SparkSession:
    """A session with adaptive execution on; shuffle_partitions is for tests, a cluster sets its own."""
    return (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session may do without; it gets a new local folder."""
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="sparkseam-"))
        atexit.register(shutil.rmtree, _LOCAL[0], True)
    return _LOCAL[0]


#: The local folder of sessions without a shared one, and the tables written by this process that still stand.
_LOCAL: list[str] = []
_WRITTEN: list[str] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one, for tables that an operator keeps; release() deletes it too."""
    path = f"{shared_dir(spark)}/sparkseam-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write df as Parquet into the shared folder and read it again: cuts lineage and survives a lost executor."""
    spark = df.sparkSession
    path = folder(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._sparkseam_path = path
    return out


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt evenly over spark.sql.shuffle.partitions tasks, for steps that take long for each row: a table of few bytes is read by one task."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def remove(spark: SparkSession, path: str) -> bool:
    """Deletes a folder or file in whatever store it lies in."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def published(spark: SparkSession, path: str) -> int:
    """The number after the last folder segment=N in path that was written to its end (0: none)."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(at)] if fs.exists(at) else []
    found = [int(n[8:]) for n in names if n.startswith("segment=") and exists(spark, f"{path}/{n}/_SUCCESS")]
    return max(found, default=-1) + 1


def written() -> int:
    """A mark for release()."""
    return len(_WRITTEN)


def release(spark: SparkSession, mark: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the tables materialised since mark, but for keep, which is one of them. Call it when nothing lazy needs them any more."""
    kept = keep.__dict__.get("_sparkseam_path") if keep is not None else None
    for path in _WRITTEN[mark:]:
        if path != kept:
            remove(spark, path)
            _WRITTEN.remove(path)


@atexit.register
def _release_at_exit() -> None:
    """What this process wrote and still stands goes with it, as long as its session still runs then."""
    try:
        spark = SparkSession.getActiveSession()
        if spark is not None and _WRITTEN:
            release(spark)
    except (Py4JError, OSError):  # the JVM has gone first
        pass


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
