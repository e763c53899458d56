"""Session defaults, the shared work folder, and tables written between stages.

Nothing here uses a machine-local folder on a cluster: intermediate tables go
below ``spark.checkpoint.dir`` (the folder all executors share).  Only where
that setting is missing, as in local tests, a folder of our own is made.
"""

from __future__ import annotations

import atexit
import os
import pathlib
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR: list[str] = []
_SHIPPED: set[str] = set()
_WRITTEN: list[tuple[SparkSession, str]] = []


def session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the library is tested with."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("revora")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    Reads ``spark.checkpoint.dir`` from the session; only where it is unset and
    the session runs on this one machine a temporary folder is made.  On a
    cluster every executor would write to a disk of its own, so there the
    setting is required.
    """
    told = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if told:
        return told.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append("file://" + tempfile.mkdtemp(prefix="revora-"))
        atexit.register(_remove_local, _OWN_DIR[0][len("file://") :])
    return _OWN_DIR[0]


def _remove_local(path: str) -> None:
    import shutil

    shutil.rmtree(path, ignore_errors=True)


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for an application, so that Python stages run wherever it isn't installed.

    The archive is made on the driver and served by Spark.
    """
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    root = pathlib.Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="revora-code-")
    atexit.register(_remove_local, folder)
    archive = os.path.join(folder, f"{root.name}.zip")
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(archive)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts the lineage like ``checkpoint()``, but columnar and compressed, so a
    later stage reads only the columns it needs, and a lost executor loses
    nothing.  The tables are removed by :func:`release` or at exit.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark, path)
    table = spark.read.schema(df.schema).parquet(path)
    table._revora_path = path
    return table


def written(spark: SparkSession, path: str) -> None:
    """Have :func:`release` remove a folder."""
    if not _WRITTEN:
        atexit.register(release)
    _WRITTEN.append((spark, path))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be gone
        pass


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`materialize` that no later stage reads, such as those of a finished round."""
    for t in tables:
        path = getattr(t, "_revora_path", None)
        if path:
            _WRITTEN[:] = [x for x in _WRITTEN if x[1] != path]
            _remove(t.sparkSession, path)


def release() -> None:
    """Remove the tables written by :func:`materialize` so far."""
    while _WRITTEN:
        _remove(*_WRITTEN.pop())


def spread(df: DataFrame, per_core: int = 2) -> DataFrame:
    """Give a CPU-heavy stage enough tasks.

    A table of one small file is read by one task; here it is split over
    ``per_core`` tasks for every core.  A table that has that many splits
    already passes unchanged, without a shuffle.
    """
    want = per_core * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= want else df.repartition(want)
