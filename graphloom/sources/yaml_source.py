"""Graphs in YAML files as a Spark source: spark.read.format("graphyaml").option("table", "edges").load(folder).

Each file is a partition and is parsed by the executor that reads it; nothing of it passes the driver. Files are found and opened
by pyarrow, so any file system that it knows will do. Comparisons for equality of text columns are pushed down: one of the file
names reads that file alone, others drop rows before they leave the reader. Files need the endings .yml or .yaml.
"""

from __future__ import annotations

import json
import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, InputPartition

from graphloom.graph import EDGE, NODE, Graph, fill

# Executors need no copy of this package: the reader travels by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

TABLES = {"nodes": f"{NODE}, project string, file string", "edges": f"{EDGE}, project string, file string"}
NAMES = {"nodes": {"node_type": "type"}, "edges": {"src": "from", "dst": "to"}}


def as_type(value, kind: T.DataType):
    """A value of a YAML file as Spark's type has it: text for what is not text, pairs for maps; None for what does not fit."""
    if value is None:
        return None
    if isinstance(kind, T.StringType):
        return value if isinstance(value, str) else json.dumps(value, default=str)
    if isinstance(kind, T.ArrayType):
        return [as_type(x, kind.elementType) for x in value] if isinstance(value, list) else None
    if isinstance(kind, T.MapType):
        return [(str(k), as_type(v, kind.valueType)) for k, v in value.items()] if isinstance(value, dict) else None
    if isinstance(kind, T.StructType):
        return {f.name: as_type(value.get(f.name), f.dataType) for f in kind} if isinstance(value, dict) else None
    if isinstance(kind, T.BooleanType):
        return value if isinstance(value, bool) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    return float(value) if isinstance(kind, T.DoubleType) else int(value)


def source_of(metadata) -> str | None:
    """The source that an edge's metadata, a mapping or its JSON, names."""
    if isinstance(metadata, str):
        try:
            metadata = json.loads(metadata)
        except ValueError:
            return None
    return metadata.get("source") if isinstance(metadata, dict) else None


class File(InputPartition):
    def __init__(self, path: str, number: int):
        self.path, self.number = path, number


class GraphYaml(DataSource):
    @classmethod
    def name(cls) -> str:
        return "graphyaml"

    def schema(self) -> str:
        return TABLES[self.options.get("table", "nodes")]

    def reader(self, schema: T.StructType) -> GraphYamlReader:
        return GraphYamlReader(self.options["path"], self.options.get("table", "nodes"), schema)


class GraphYamlReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema: T.StructType):
        self.path, self.table, self.kinds, self.equal = path, table, schema, {}

    def _files(self):
        from pyarrow import fs

        where, path = fs.FileSystem.from_uri(self.path if "://" in self.path else self.path.replace("file:/", "/", 1))
        return where, path

    def pushFilters(self, filters):
        text = {f.name for f in self.kinds if isinstance(f.dataType, T.StringType)}
        for f in filters:
            if isinstance(f, EqualTo) and len(f.attribute) == 1 and f.attribute[0] in text and f.attribute[0] not in self.equal:
                self.equal[f.attribute[0]] = f.value
            else:
                yield f

    def partitions(self):
        from pyarrow import fs

        where, path = self._files()
        found = [where.get_file_info(path)]
        if found[0].type == fs.FileType.Directory:
            found = where.get_file_info(fs.FileSelector(path, recursive=True))
        names = sorted(f.path for f in found if f.type == fs.FileType.File and f.extension in ("yml", "yaml"))
        return [File(n, k) for k, n in enumerate(names) if self.equal.get("file", n) == n]

    def read(self, partition: File):
        import yaml

        where, _ = self._files()
        with where.open_input_stream(partition.path) as stream:
            data = yaml.load(stream.read().decode(), getattr(yaml, "CSafeLoader", yaml.SafeLoader)) or {}
        project = data.get("project")
        project = project.get("name") if isinstance(project, dict) else project
        rows = []
        for k, one in enumerate(data.get(self.table) or []):
            row = {f.name: one.get(NAMES[self.table].get(f.name, f.name)) for f in self.kinds}
            if self.table == "edges" and row["edge_source"] is None:
                row["edge_source"] = source_of(row["metadata"])
            # defaults as those of a single file
            row |= {"ord": (partition.number << 32) + k, "project": project, "file": partition.path}
            if self.table == "nodes":
                row |= {"status": row["status"] or "todo", "tags": row["tags"] or []}
            else:
                row |= {"relation": row["relation"] or "depends_on", "call_count": 1 if row["call_count"] is None else row["call_count"], "in_error_path": bool(row["in_error_path"])}
            row = {f.name: as_type(row[f.name], f.dataType) for f in self.kinds}
            if all(row[c] == v for c, v in self.equal.items()):
                rows.append(row)
        from pyspark.sql.pandas.types import to_arrow_type

        for i in range(0, len(rows), 10_000):
            part = rows[i : i + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in part], to_arrow_type(f.dataType)) for f in self.kinds], [f.name for f in self.kinds])


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, with pushed filters."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(GraphYaml)


def read_yaml(spark: SparkSession, path: str, table: str) -> DataFrame:
    """Nodes or edges of a YAML file, or of all below a folder, with project and file."""
    register(spark)
    return spark.read.format("graphyaml").option("table", table).load(path)


def load_yaml_folder(spark: SparkSession, path: str) -> Graph:
    """One graph of all YAML files below a folder; of edges with one triple the first by file and place counts."""
    from graphloom.operators.scans import first_by_order

    nodes, edges = (read_yaml(spark, path, t).drop("project", "file") for t in ("nodes", "edges"))
    return Graph(fill(nodes, NODE), first_by_order(fill(edges, EDGE), ["src", "dst", "relation"]))
