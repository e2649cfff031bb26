"""Lineage cuts: iterative plans are written to the shared folder and read back, so lost executors recompute little."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a local master gets a folder of its own machine; a cluster,
    whose machines share none, gets an error."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file:///tmp/checkpoints/graphloom"
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def forget(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder if it is there."""
    with contextlib.suppress(Exception):
        target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


_open: list[list[str]] = []


@contextlib.contextmanager
def paths_made():
    """A list that takes the paths of all cuts made meanwhile, in order, for whoever can tell when they have served."""
    made: list[str] = []
    _open.append(made)
    try:
        yield made
    finally:
        _open.remove(made)


def _note(spark: SparkSession, path: str) -> None:
    for made in _open:
        made.append(path)
    atexit.register(forget, spark, path)


#: Of what is written between steps, as a task reads whole row groups: their bytes, and rows of a file, as ids compress so well
#: that bytes alone bound no rows. Two such files at most go to one task, for Spark counts 4 MB for opening each.
SMALL_FILES = {"parquet.block.size": 8 * 1024 * 1024, "maxRecordsPerFile": 1_000_000}


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """df, written and read back; the files go when the program ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").options(**SMALL_FILES).parquet(path)
    _note(spark, path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes by Spark's estimate, which goes by the size of files, up to which a join broadcasts before anything is measured.
SURELY_SMALL = 64 * 1024
#: Rows that a round has at most for its joins to broadcast it.
FEW_ROWS = 100_000


def measured_joins(spark: SparkSession) -> None:
    """Sets the session to broadcast what was measured to be small at run time, and not what only its files make look small.

    Columns of ids and names compress several hundred times in Parquet: eleven million ids count as 3 MB, but a broadcast of
    them, which the driver and every executor hold whole, has 1.5 GB. A session without automatic broadcasts stays without.
    """
    auto, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    if spark.conf.get(adaptive, None) is None and not spark.conf.get(auto).startswith("-"):
        spark.conf.set(adaptive, spark.conf.get(auto))
        spark.conf.set(auto, str(SURELY_SMALL))


#: What one task reads of files and of a shuffle, and the parts that a shuffle has before small ones are put together.
TASK_READS = {"spark.sql.files.maxPartitionBytes": "8MB", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "16MB"}
SHUFFLE_PARTS = 400


def small_tasks(spark: SparkSession) -> None:
    """Sets the session to give a task few rows, so that its memory does not grow with the graph.

    A share of 128 MB of a file of edges has eight million of them, which sorts, joins and partial aggregations hold in memory. What a
    session has set itself stays.
    """
    for key, size in TASK_READS.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, size)
    parts = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if spark.conf.get(parts, None) is None:
        spark.conf.set(parts, str(max(SHUFFLE_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")))))


class Rounds:
    """Rows that grow round by round: each round is written beside those before, and all are read as one frame."""

    def __init__(self, spark: SparkSession, ddl: str):
        self.spark, self.ddl = spark, ddl
        self.path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
        self.paths: list[str] = []
        self.rows = 0  # of the last round
        _note(spark, self.path)

    def add(self, df: DataFrame) -> int:
        """Writes one round and says how many rows it has."""
        seen, path = Observation(), f"{self.path}/round-{len(self.paths)}"
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.option("compression", "zstd").options(**SMALL_FILES).parquet(path)
        self.paths.append(path)
        self.rows = seen.get["n"]
        return self.rows

    def last(self) -> DataFrame:
        """The last round; its joins broadcast it if it is known to have few rows."""
        df = self.spark.read.schema(self.ddl).parquet(self.paths[-1])
        return F.broadcast(df) if self.rows <= FEW_ROWS else df

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.ddl).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.ddl)
