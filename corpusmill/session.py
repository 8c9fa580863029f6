"""Session defaults and the shared folder for tables that cut lineage."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings that the operators rely on; a cluster's own values win (see ``build``).
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
}


def build(app: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults; ``conf`` overrides them."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share.

    ``spark.checkpoint.dir`` names it on a cluster. Only a local session that
    leaves it unset gets a temporary folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = os.path.join(tempfile.gettempdir(), f"corpusmill-{spark.sparkContext.applicationId}")
    if not os.path.exists(own):
        os.makedirs(own)
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def _own_folder(spark: SparkSession) -> str:
    """This application's part of the shared folder; it's removed when the driver's process ends."""
    path = f"{shared_dir(spark)}/corpusmill-{spark.sparkContext.applicationId}"
    if path not in _FOLDERS:
        _FOLDERS.add(path)
        atexit.register(_remove, spark, path)
    return path


_FOLDERS: set[str] = set()
_ONCE: dict[tuple, object] = {}


def once(spark: SparkSession, key: tuple, build):
    """What ``build`` gives, built once for each application and key: for tables written by ``materialize`` that many queries read."""
    key = (spark.sparkContext.applicationId, *key)
    if key not in _ONCE:
        _ONCE[key] = build()
    return _ONCE[key]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        _FOLDERS.discard(path)
    except Exception:  # the session may have ended; what is left belongs to no application that runs
        pass


def clean_up(spark: SparkSession) -> None:
    """Remove the tables that ``materialize`` wrote. No result that was made before can be read any more, so call it between jobs of a long session."""
    _ONCE.clear()
    _remove(spark, _own_folder(spark))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut there and
    a lost executor costs nothing that was written. ``clean_up``, or the end of the driver, removes what was written."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """``df`` over as many partitions as there are cores, if a scan of few files has fewer; else as it is. For work in Python on a scan."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the test tables, by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
