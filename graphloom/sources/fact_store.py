"""What parsing has found, kept by content: a file whose content was parsed before is not parsed again, wherever it lies.

A content's key is the SHA-256 of the parsers' version, the file's type and its text. Each run writes the facts of the
contents that are new as one batch, partitioned by the first digits of the key, aside at first; then it is renamed, the list
of its contents last, so a batch counts as a whole or not at all. Runs at one time may keep a content twice; the first batch by name counts. A space (such as
a repository and its commit) sees only its own batches.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.lineage import cut, measured_joins, small_tasks
from graphloom.operators import extract

FILES = "key string, prefix string, batch string"
#: Contents of a batch whose facts one task writes.
WRITTEN = 20_000


class FactStore:
    def __init__(self, spark: SparkSession, root: str, space: str = "all", digits: int = 2):
        self.spark, self.digits, self.root = spark, digits, f"{root.rstrip('/')}/space={re.sub('[^A-Za-z0-9_.-]', '_', space)}"
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        #: Files, contents parsed and files served from the store by the last call of facts().
        self.files = self.parsed = self.reused = 0

    def _read(self, table: str, ddl: str, prefixes: list[str]) -> DataFrame:
        """A table of all batches, of some prefixes only; other prefixes are not read."""
        path = f"{self.root}/{table}"
        if not self._fs.exists(self._path(path)):
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(path).where(F.col("prefix").isin(prefixes))

    def facts(self, sources: DataFrame) -> DataFrame:
        """What extract.facts() finds in sources(path, content); contents that the store lacks are parsed and kept."""
        measured_joins(self.spark)
        small_tasks(self.spark)
        kind = F.lower(F.substring_index("path", ".", -1))
        keyed = sources.select("path", "content", kind.alias("kind"), F.sha2(F.concat_ws("\0", F.lit(str(extract.PARSERS)), kind, F.coalesce("content", F.lit(""))), 256).alias("key"))
        index = cut(keyed.select("path", "kind", "key", F.substring("key", 1, self.digits).alias("prefix")), "index")
        prefixes = [r["prefix"] for r in index.select("prefix").distinct().collect()]  # 16 ** digits at most
        new = index.select("key").distinct().join(self._read("files", FILES, prefixes).select("key"), "key", "left_anti")
        missing = cut(keyed.join(new, "key", "left_semi").groupBy("key").agg(F.min("kind").alias("kind"), F.min_by("content", "path").alias("content")), "missing")
        self.parsed = missing.count()
        if self.parsed:
            self._keep(missing)
        known = self._read("files", FILES, prefixes).groupBy("prefix", "key").agg(F.min("batch").alias("batch"))
        found = self._read("facts", f"{extract.FACT.replace('path string, ', '')}, {FILES}", prefixes)
        self.files = index.count()
        self.reused = self.files - index.join(new, "key", "left_semi").count() if self.parsed else self.files
        columns = [c.split()[0] for c in extract.FACT.split(", ")]
        return cut(index.select("path", "prefix", "key").join(known, ["prefix", "key"]).join(found, ["prefix", "key", "batch"]).select(columns), "facts")

    def _keep(self, missing: DataFrame) -> None:
        """Writes the facts of contents aside and moves them in; the list of contents comes last and makes them count."""
        batch = uuid.uuid4().hex
        prefix = F.substring("key", 1, self.digits).alias("prefix")
        named = missing.select(F.concat_ws(".", "key", "kind").alias("path"), "content")
        columns = [c.split()[0] for c in extract.FACT.split(", ")][1:]
        found = extract.facts(named).withColumn("key", F.substring_index("path", ".", 1))
        tables = {"facts": found.select(*columns, "key", prefix), "files": missing.select("key", prefix)}
        # a prefix is no task's alone: with few digits each has a large part of the batch
        share = F.pmod(F.xxhash64("key"), F.lit(self.parsed // (WRITTEN * 16**self.digits) + 1))
        for table, df in tables.items():
            df.repartition("prefix", share).write.partitionBy("prefix").parquet(f"{self.root}/.{batch}/{table}")
        for table in tables:
            self._fs.mkdirs(self._path(f"{self.root}/{table}"))
            if not self._fs.rename(self._path(f"{self.root}/.{batch}/{table}"), self._path(f"{self.root}/{table}/batch={batch}")):
                raise OSError(f"batch {batch} could not be moved in")
        self._fs.delete(self._path(f"{self.root}/.{batch}"), True)
