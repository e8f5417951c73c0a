"""Session construction, fixture table access and lineage cutting.

Everything in the library takes a ``SparkSession`` and a directory of
parquet tables.  ``Tables`` reads a table lazily (so Catalyst can push
filters and prune columns into the scan) and registers it as a temp view
under its own name, so derived-table SQL can refer to it.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

TABLE_NAMES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
)

DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "quarry", extra: dict | None = None) -> SparkSession:
    """Session used by tests and the bench; on a cluster pass the real master."""
    b = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.setdefault("spark.driver.memory", "16g")
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


class Tables:
    """Lazy accessor for the fixture tables of one directory.

    A table is read (file listing + footer) only when first used; SQL text
    run through :meth:`sql` gets temp views for exactly the tables it names.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, register: bool = True):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        self._cache: dict[str, DataFrame] = {}
        self._register = register

    def path(self, name: str) -> str:
        return f"{self.sf_dir}/{name}.parquet"

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = self.spark.read.parquet(self.path(name))
            self._cache[name] = df
            if self._register:
                df.createOrReplaceTempView(name)
        return self._cache[name]

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLE_NAMES:
            return self[name]
        raise AttributeError(name)

    def available(self) -> list[str]:
        """Fixture tables that have a data file in this directory, in catalog order."""
        return [n for n in TABLE_NAMES if path_exists(self.spark, self.path(n))]

    def sql(self, text: str) -> DataFrame:
        import re
        for name in TABLE_NAMES:
            if re.search(rf"\b{name}\b", text):
                self[name]
        return self.spark.sql(text)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names in ``spark.checkpoint.dir``.

    Only when the session has none and runs in one process (local tests) a
    scratch folder is made; it goes when the process ends.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        conf = tempfile.mkdtemp(prefix="quarry-ckpt-")
        atexit.register(shutil.rmtree, conf, ignore_errors=True)
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate tables."""
    base = checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:12]}"


def path_exists(spark: SparkSession, path: str) -> bool:
    """Existence check through the Hadoop file system (local, HDFS, object stores alike)."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def path_state(spark: SparkSession, path: str) -> tuple[int, int, int] | None:
    """Bytes, files and time of a file or folder; None where there is none."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return None
    held = fs.getContentSummary(p)
    return held.getLength(), held.getFileCount(), fs.getFileStatus(p).getModificationTime()
