"""Session defaults, and tables written to cut lineage."""
from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN_DIR = None
_USED: set[str] = set()


def build(master: str = "local[8]", memory: str = "12g", partitions: int = 16, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster brings its own settings."""
    os.environ.setdefault("TZ", "UTC")
    b = (SparkSession.builder.master(master).appName("graindeck")
         .config("spark.driver.memory", memory)
         .config("spark.sql.shuffle.partitions", str(partitions))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where that is unset (local tests)."""
    global _OWN_DIR
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if _OWN_DIR is None:
        _OWN_DIR = tempfile.mkdtemp(prefix="graindeck-")
        atexit.register(shutil.rmtree, _OWN_DIR, True)
    return "file://" + _OWN_DIR


def _own_folder(spark: SparkSession) -> str:
    """Where this application keeps its tables; deleted when it ends."""
    at = f"{shared_dir(spark)}/graindeck/{spark.sparkContext.applicationId}"
    if at not in _USED:
        _USED.add(at)
        path, conf = spark._jvm.org.apache.hadoop.fs.Path(at), spark._jsc.hadoopConfiguration()
        atexit.register(_delete, path, conf)
    return at


def _delete(path, conf) -> None:
    try:
        path.getFileSystem(conf).delete(path, True)
    except Exception:  # the JVM went first: nothing is left that could delete
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and a lost executor costs no recomputation. The tables
    of an application live in a folder of its own, until it ends or ``purge`` is called."""
    spark = df.sparkSession
    at = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def purge(spark: SparkSession) -> None:
    """Delete the tables that ``cut`` wrote in this application, once no result that reads them is wanted any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def parallelism(spark: SparkSession) -> int:
    """Tasks for a repartition: the session's shuffle partitions, which the cluster sizes to its data."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
