"""Session builder and the shared folder for tables that cut lineage."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "quillspark", cores: str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the library is tested with; a cluster passes its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName(app)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or, in a local session, one of our own where that is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not at:
        at = os.path.join(tempfile.gettempdir(), "quillspark-checkpoints")
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


class Written:
    """A table in the shared folder. It is removed by drop(), or else when the driver ends."""

    def __init__(self, df: DataFrame, name: str) -> None:
        spark = df.sparkSession
        self.spark = spark
        self.path = f"{shared_dir(spark)}/quillspark/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.schema = df.schema
        self._path().getFileSystem(self._hadoop()).deleteOnExit(self._path())

    def _hadoop(self):
        return self.spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def drop(self) -> None:
        self._path().getFileSystem(self._hadoop()).delete(self._path(), True)


def write_shared(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: executors can then be lost without a recomputation of what lies before."""
    return Written(df, name).read()


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many partitions as there are cores: for a scan of fewer row groups than that. Larger scans stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


#: Bytes of a table that is broadcast at once, by Catalyst's estimate, which without statistics of columns is not too low.
BROADCAST_BYTES = 64 << 20


def blocks(df: DataFrame, key: str, most: int = BROADCAST_BYTES) -> list[DataFrame]:
    """df in as many parts, dealt by key, as keep each at about `most` bytes: a part can be broadcast."""
    n = -(-int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // most)
    part = F.pmod(F.xxhash64(key), F.lit(max(1, n)))
    return [df] if n <= 1 else [df.filter(part == k) for k in range(n)]
