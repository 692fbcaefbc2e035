"""Tables that cut lineage, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a session with local executors gets a temporary one;
    on a cluster that is an error, as executors would write where no one else can read."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        if found.isDefined():
            root = found.get()
        elif spark.sparkContext.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="mnemotide-")
            spark.sparkContext.setCheckpointDir(root)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root


def bounded_batches(spark: SparkSession, megabytes: int = 8) -> None:
    """Arrow batches of so many megabytes at most for this session, as rows of whole texts differ a thousandfold in size.

    For the application that runs queries: operators leave the session's options alone. Batches are held several times over while they pass between an executor and its Python workers. A session that
    already asks for smaller ones is left as it is.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) <= 0 or int(now) > megabytes << 20:
        spark.conf.set(key, str(megabytes << 20))


class Scratch:
    """Written tables of one job. `save` returns the reread table; `drop` deletes one that no later step reads."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
        self.count = 0
        self.paths: dict[int, str] = {}

    def save(self, df: DataFrame, partition_by: str | None = None) -> DataFrame:
        self.count += 1
        path = f"{self.root}/t{self.count}"
        writer = df.write.option("compression", "zstd")
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        path = self.paths.pop(id(df), None)
        if path:
            jvm = self.spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
