"""Snapshots of graphs and embeddings: a folder a version, and a pointer to the current one."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import with_norms
from ..plans.graph import Graph, distinct_edges
from ..plans.schema import EDGES, EMBEDDINGS, NODES, shaped

SCHEMA_VERSION = 2


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Writes a small file to any file system that Spark knows, whole or not at all: it is written beside its place
    and renamed over what is there, in one step where the file system can."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    folder, _, name = path.rpartition("/")
    new, at = (jvm.org.apache.hadoop.fs.Path(p) for p in (f"{folder}/.{name}.{uuid.uuid4().hex}", path))
    out = new.getFileSystem(conf).create(new, True)
    out.write(bytearray(text.encode()))
    out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    fs = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.getFileSystem(conf).getUri(), conf)
    fs.rename(fs.makeQualified(new), fs.makeQualified(at), how)


class Store:
    """A folder with versions of nodes, edges and embeddings. Writers make a new version and then move the pointer,
    a small file written last, so that readers see a whole version, the old one or the new."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _current(self, kind: str, what: str = "version") -> str | None:
        at = self._path(f"{self.path}/current-{kind}.json")
        if not self._fs.exists(at):
            return None
        row = self.spark.read.text(f"{self.path}/current-{kind}.json").first()
        said = json.loads(row["value"]) if row else {}
        return said.get(what) if said.get("schema") == SCHEMA_VERSION else None  # an older schema is rebuilt

    def _point(self, kind: str, version: str, **more: str | None) -> None:
        write_text(self.spark, f"{self.path}/current-{kind}.json", json.dumps({"schema": SCHEMA_VERSION, "version": version, **more}))

    def ready(self) -> bool:
        return self._current("graph") is not None

    def save_graph(self, graph: Graph, files: DataFrame | None = None) -> None:
        """Replaces the stored graph; edges are distinct by (from, to, type). files are the parsed files it was made from; if
        they are not given, those stored before stay."""
        version = uuid.uuid4().hex
        parsed = self._current("graph", "files")
        if files is not None:
            parsed = f"files-{version}"
            files.write.parquet(f"{self.path}/{parsed}")

        def write(df: DataFrame, name: str) -> DataFrame:
            df.write.parquet(f"{self.path}/graph-{version}/{name}")
            return self.spark.read.schema(df.schema).parquet(f"{self.path}/graph-{version}/{name}")

        Graph(shaped(graph.nodes, NODES), distinct_edges(shaped(graph.edges, EDGES))).stored(write)
        self._point("graph", version, files=parsed)

    def load_files(self) -> DataFrame | None:
        """The parsed files that the stored graph was made from, or None if they are not stored."""
        files = self._current("graph", "files")
        return self.spark.read.parquet(f"{self.path}/{files}") if files else None

    def load_graph(self) -> Graph:
        """The stored graph; an empty one if there is none."""
        version = self._current("graph")
        if version is None:
            return Graph(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))
        read = lambda name, schema: self.spark.read.schema(schema).parquet(f"{self.path}/graph-{version}/{name}")
        return Graph(read("nodes", NODES), read("edges", EDGES), read("incoming", EDGES))

    def load_embeddings(self) -> DataFrame:
        version = self._current("embeddings")
        if version is None:
            return self.spark.createDataFrame([], EMBEDDINGS)
        return self.spark.read.schema(EMBEDDINGS).parquet(f"{self.path}/embeddings-{version}")

    def _save_embeddings(self, rows: DataFrame) -> None:
        version = uuid.uuid4().hex
        shaped(rows, EMBEDDINGS).write.parquet(f"{self.path}/embeddings-{version}")
        self._point("embeddings", version)

    def upsert_embeddings(self, rows: DataFrame) -> None:
        """Rows replace those of their node_id, both vectors together; norms are stored with them."""
        kept = self.load_embeddings().join(rows.select("node_id"), "node_id", "left_anti")
        self._save_embeddings(kept.unionByName(shaped(with_norms(rows.dropDuplicates(["node_id"])), EMBEDDINGS)))

    def delete_embeddings(self, ids: DataFrame) -> None:
        """ids has node_id; those that are not there are no error."""
        self._save_embeddings(self.load_embeddings().join(ids.select("node_id"), "node_id", "left_anti"))

    def source_text(self, id_: str) -> str:
        """The text of a node's declaration, '' if there is none."""
        row = self.load_graph().node(id_).select(F.coalesce("code", F.lit(""))).first()
        return row[0] if row else ""
