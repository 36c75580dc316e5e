"""Session settings and the folder for intermediate tables."""

from __future__ import annotations

import logging
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

log = logging.getLogger(__name__)

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A hot key is worth an extra shuffle when a skewed join feeds another operator.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Shuffled rows of short texts take up to 40 times their packed size in a sort or a hash table, so tasks are merged to 8 MB at most.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.maxPartitionBytes": "64m",
    "spark.ui.enabled": "false",
}

# Settings the operators count on, also in a session someone else has built.
RUNTIME_CONF = {k: v for k, v in SESSION_CONF.items() if k.startswith("spark.sql.adaptive.")}

# Folder of each application.
_scratch: dict[str, str] = {}


def build_session(app: str = "pharmalith", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Turn on the adaptive settings that split skewed joins, unless the session was built with others."""
    built_with = spark.sparkContext.getConf()
    for key, value in RUNTIME_CONF.items():
        if not built_with.contains(key) and spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def sibling(spark: SparkSession) -> SparkSession:
    """Another session of the application, with its own current database and views and the same settings."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    return other


def _folder(spark: SparkSession, path: str):
    """A folder and its file system, as the JVM sees them."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _is_local(spark: SparkSession) -> bool:
    """Driver and tasks are one process; the executors of a ``local-cluster`` are others, with temporary folders of their own."""
    return re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master) is not None


def _shared_bases(spark: SparkSession) -> list[str]:
    """Folders that driver and executors may share: ``spark.checkpoint.dir``, the checkpoint folder of the context, the warehouse; a
    local session without the first two takes a temporary folder."""
    set_ = [b for b in (spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.getCheckpointDir()) if b]
    if _is_local(spark):
        return set_[:1] or [tempfile.mkdtemp(prefix="pharmalith-")]
    return list(dict.fromkeys([*set_, spark.conf.get("spark.sql.warehouse.dir")]))


def _reaches_all(spark: SparkSession, path: str) -> bool:
    """Whether the driver finds what all tasks write to ``path``; a ``file:`` path may be a mount of all machines or a disk of each."""
    n = spark.sparkContext.defaultParallelism
    try:
        spark.range(0, n, 1, n).write.parquet(path)
        return spark.read.schema("id bigint").parquet(path).count() == n
    except (PySparkException, Py4JJavaError) as error:
        log.warning("cannot write to %s: %s", path, error)
        return False


def _scratch_root(spark: SparkSession) -> str:
    """The folder of this application below the first folder that is shared; it goes when the application ends."""
    app = spark.sparkContext.applicationId
    if app in _scratch:
        return _scratch[app]
    bases = _shared_bases(spark)
    for base in bases:
        fs, folder = _folder(spark, f"{base.rstrip('/')}/pharmalith-{app}")
        if _is_local(spark) or fs.getScheme() != "file" or _reaches_all(spark, f"{folder.toString()}/probe-{uuid.uuid4().hex}"):
            fs.mkdirs(folder)
            fs.deleteOnExit(folder)
            _scratch[app] = folder.toString()
            return _scratch[app]
        fs.delete(folder, True)
    raise RuntimeError(f"the driver does not see what executors write to {', '.join(bases)}; set spark.checkpoint.dir to a folder that all share")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name below the folder that driver and executors share, as a rule ``spark.checkpoint.dir``."""
    return f"{_scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Remove all intermediate tables of this application; results that still read them must be done."""
    root = _scratch.pop(spark.sparkContext.applicationId, None)
    if root:
        fs, folder = _folder(spark, root)
        fs.delete(folder, True)


def through_storage(df, name: str):
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage of a result that several later steps read, and survives the loss
    of executors, as the files do not live on them.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
