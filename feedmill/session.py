"""Sessions for local runs, and the shared folder jobs stage tables in."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
}


def local_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; on a cluster the submitter makes the session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("feedmill")
    settings = {**LOCAL_CONF, "spark.sql.shuffle.partitions": str(shuffle_partitions), **conf}
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local master may fall back to a temporary folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="feedmill-"))
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder; nothing else ever writes there."""
    return f"{shared_dir(spark)}/feedmill/{label}-{uuid.uuid4().hex}"


def drop_dir(spark: SparkSession, path: str) -> None:
    """Remove a staged folder once nothing reads it any more."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def move_paths(spark: SparkSession, moves: Iterable[tuple[str, str]], parallel: int = 16) -> None:
    """Rename files within a file system, from the driver, since a rename moves no data. A move that was done before stays done."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()

    def move(pair: tuple[str, str]) -> None:
        source, target = (jvm.org.apache.hadoop.fs.Path(p) for p in pair)
        system = source.getFileSystem(conf)
        system.mkdirs(target.getParent())
        if system.exists(source):
            if not system.rename(source, target):
                raise OSError(f"cannot move {pair[0]} to {pair[1]}")
        elif not system.exists(target):
            raise FileNotFoundError(pair[0])

    with ThreadPoolExecutor(parallel) as pool:
        for _ in pool.map(move, moves):
            pass


def list_paths(spark: SparkSession, folder: str) -> list[str]:
    """Paths of the files in a folder, hidden ones left out; none if it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(path) if s.isFile()] if system.exists(path) else []
    return [p.toString() for p in found if not p.getName().startswith(("_", "."))]


def list_folders(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Paths of the folders in a folder whose names have a prefix; none if it does not exist."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [s.getPath() for s in system.listStatus(path) if s.isDirectory()] if system.exists(path) else []
    return [p.toString() for p in found if p.getName().startswith(prefix)]
