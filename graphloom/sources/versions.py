"""Versions of a graph: Parquet folders with one manifest each, which a rename makes current.

A write goes to a folder of its own, is read back and held against checksums taken while it was written, and only then
gets its manifest. Readers take the highest manifest, so a write that fails leaves the version before it as it was, and of two
writers from one version the later gets an error. Everything goes through Hadoop file systems: any path that Spark can write will do.

The checksum of a table does not depend on the order of its rows: their number, and the sum and the exclusive or of a
64-bit hash of each row, in one pass. A row is hashed as JSON with its maps sorted, so a value that moves from one column to
another counts.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.graph import Graph

TABLES = ("nodes", "edges")


class Conflict(Exception):
    """Someone else has written a version meanwhile."""


class Damaged(Exception):
    """What is stored is not what was written."""


def canonical(c: Column, kind: T.DataType) -> Column:
    """A column with every map in it as a sorted array of entries."""
    if isinstance(kind, T.MapType):
        entry = lambda e: F.struct(canonical(e["key"], kind.keyType).alias("k"), canonical(e["value"], kind.valueType).alias("v"))
        return F.array_sort(F.transform(F.map_entries(c), entry))
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: canonical(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[canonical(c[f.name], f.dataType).alias(f.name) for f in kind]))
    return c


def row_hash(df: DataFrame) -> Column:
    columns = [canonical(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema, key=lambda f: f.name)]
    return F.xxhash64(F.to_json(F.struct(*columns)))


def _sums(df: DataFrame) -> list[Column]:
    h = row_hash(df)
    total = F.coalesce(F.sum(h.cast("decimal(28,0)")), F.lit(0)).cast("string")
    return [F.count(F.lit(1)).alias("rows"), total.alias("total"), F.coalesce(F.bit_xor(h), F.lit(0)).cast("string").alias("mix")]


def checksum(df: DataFrame) -> dict:
    """rows, total and mix of a table."""
    return df.agg(*_sums(df)).first().asDict()


def differences(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """key, change, n: rows that are lost or extra, by how often; changed where a key has both."""

    def counted(df: DataFrame, sign: int) -> DataFrame:
        return df.select(*key, row_hash(df).alias("h")).groupBy(*key, "h").agg((sign * F.count(F.lit(1))).alias("n"))

    apart = counted(old, -1).unionByName(counted(new, 1)).groupBy(*key, "h").agg(F.sum("n").alias("n")).where("n <> 0")
    both = apart.groupBy(*key).agg(F.sum(F.when(F.col("n") < 0, -F.col("n")).otherwise(0)).alias("lost"), F.sum(F.when(F.col("n") > 0, F.col("n")).otherwise(0)).alias("extra"))
    swapped = F.least("lost", "extra")
    kind = lambda name, n: F.struct(F.lit(name).alias("change"), n.alias("n"))
    kinds = F.array(kind("changed", swapped), kind("lost", F.col("lost") - swapped), kind("extra", F.col("extra") - swapped))
    return both.select(*key, F.inline(F.filter(kinds, lambda x: x["n"] > 0)))


@dataclass(frozen=True)
class Version:
    number: int
    created_at: str
    message: str | None
    project: str | None
    tables: dict  # of each table: path, rows, total, mix


class Versions:
    """The versions of one graph below a folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
        self._fs = self._path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.Path(f"{self.root}/{name}" if name else self.root)

    def numbers(self) -> list[int]:
        """Numbers of the versions, newest first."""
        folder = self._path("manifests")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return sorted((int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json")), reverse=True)

    def current(self) -> int:
        return next(iter(self.numbers()), 0)

    def version(self, number: int | None = None) -> Version:
        number = self.current() if number is None else number
        stream = self._fs.open(self._path(f"manifests/v{number:08d}.json"))
        try:
            return Version(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def read(self, number: int | None = None) -> Graph:
        v = self.version(number)
        return Graph(*(self.spark.read.parquet(f"{self.root}/{v.tables[t]['path']}") for t in TABLES), v.project)

    def verify(self, number: int | None = None) -> list[str]:
        """What is wrong with the stored tables of a version; nothing if all is as it was written."""
        v, g = self.version(number), self.read(number)
        out = []
        for name, df in zip(TABLES, (g.nodes, g.edges)):
            now = checksum(df)
            out += [f"{name}: {k} {now[k]}, written {v.tables[name][k]}" for k in ("rows", "total", "mix") if str(now[k]) != str(v.tables[name][k])]
        return out

    def commit(self, g: Graph, message: str | None = None, base: int | None = None) -> int:
        """Writes g as the version after `base` (the current one if not given) and says its number."""
        base = self.current() if base is None else base
        folder, tables = f"data/{uuid.uuid4().hex}", {}
        try:
            for name, df in zip(TABLES, (g.nodes, g.edges)):
                seen, path = Observation(), f"{folder}/{name}"
                df.observe(seen, *_sums(df)).write.parquet(f"{self.root}/{path}")
                tables[name] = {"path": path} | seen.get
                if (now := checksum(self.spark.read.parquet(f"{self.root}/{path}"))) != seen.get:
                    raise Damaged(f"{name}: {now} read, {seen.get} written")
            created = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
            self._publish(Version(base + 1, created, message, g.project, tables))
        except BaseException:
            self._fs.delete(self._path(folder), True)
            raise
        return base + 1

    def _publish(self, v: Version) -> None:
        """The manifest is written aside and moved to its name, which must be free."""
        aside = self._path(f"manifests/.{uuid.uuid4().hex}")
        stream = self._fs.create(aside)
        stream.write(bytearray(json.dumps(v.__dict__).encode()))
        stream.close()
        target = self._path(f"manifests/v{v.number:08d}.json")
        context = self._jvm.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        how = self.spark.sparkContext._gateway.new_array(self._jvm.Options.Rename, 1)
        how[0] = self._jvm.Options.Rename.NONE
        try:
            if v.number - 1 != self.current():
                raise Conflict(f"version {self.current()} is there, {v.number - 1} was expected")
            context.rename(context.makeQualified(aside), context.makeQualified(target), how)
        except Exception as error:
            self._fs.delete(aside, False)
            if "FileAlreadyExists" in str(error):
                raise Conflict(f"version {v.number} is there already") from error
            raise

    def apply(self, operations: DataFrame, message: str | None = None) -> int:
        """The current version with a log of operations applied, as the next one."""
        from graphloom.operators.oplog import apply_log

        base = self.current()
        return self.commit(apply_log(self.read(base), operations), message, base)

    def restore(self, number: int) -> int:
        """An older version as the newest one; all between stay. An older version that is damaged is refused."""
        if wrong := self.verify(number):
            raise Damaged("; ".join(wrong))
        return self.commit(self.read(number), f"restored from {number}")

    def prune(self, keep: int = 50) -> list[int]:
        """Deletes all versions but the newest `keep`; says which."""
        old = self.numbers()[max(keep, 1) :]
        for number in old:
            folder = self.version(number).tables["nodes"]["path"].rpartition("/")[0]
            self._fs.delete(self._path(f"manifests/v{number:08d}.json"), False)
            self._fs.delete(self._path(folder), True)
        return old

    def migrate(self, g: Graph, types: list[str], relations: list[str], strict: bool = True) -> dict:
        """Takes over a graph from another store, after a check of its types and relations.

        The current version, if there is one, remains as the backup. The report says what was taken over, the source's
        checksums, which the stored ones equal, and the findings of the check; errors among them stop a strict migration.
        """
        from graphloom.sources.io import validate_for_migration

        found = validate_for_migration(g, types, relations)
        by_severity = {r["severity"]: r["count"] for r in found.groupBy("severity").count().collect()}
        if strict and by_severity.get("error"):
            raise ValueError(f"{by_severity['error']} errors, such as: {found.where("severity = 'error'").first()['what']}")
        before = self.current()
        number = self.commit(g, "migrated")
        tables = self.version(number).tables
        counts = g.nodes.select(*[F.sum(F.size(c)).alias(c) if c in g.nodes.columns and not isinstance(g.nodes.schema[c].dataType, T.StringType) else F.lit(0).alias(c) for c in ("tags", "metadata")]).first()
        return {
            "version": number, "backup": before or None, "nodes": tables["nodes"]["rows"], "edges": tables["edges"]["rows"], "tags": counts["tags"] or 0, "metadata": counts["metadata"] or 0,
            "fingerprint": "-".join(tables[t][k] for t in TABLES for k in ("total", "mix")), "status": "success_with_warnings" if by_severity else "success", "findings": by_severity,
        }
