"""Scans of source trees: files to nodes and edges."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import node_id, placeholder
from ..operators.resolve import implements_edges, resolve_placeholders, type_edges
from ..plans.graph import Graph, distinct_edges
from ..plans.lineage import cut
from ..plans.schema import EDGES, NODES, shaped
from .gosource import parse

_METHOD = "struct<name: string, signature: string, shape: string>"
_PARSED = (
    "file string, package string, error string, imports array<struct<alias: string, path: string>>, "
    "functions array<struct<name: string, receiver: string, line: int, col: int, signature: string, shape: string, docstring: string, code: string, "
    "calls: array<struct<package: string, name: string, resolution: string>>, references: array<struct<role: string, package: string, name: string>>>>, "
    f"types array<struct<name: string, kind: string, line: int, docstring: string, methods: array<{_METHOD}>, embeds: array<string>>>"
)


def plain(path: str) -> str:
    """A path of the local file system without its scheme, others as they are."""
    return re.sub("^file:/*", "/", path.rstrip("/"))


def go_files(spark: SparkSession, root: str) -> DataFrame:
    """path, content of the .go files below root, none below a folder that starts with a dot, or vendor."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.go").load(root)
    path = F.regexp_replace(F.col("path"), "^file:/*", "/")
    below = F.concat(F.lit("/"), F.substring(path, F.lit(len(plain(root)) + 2), F.length(path)))
    return rows.filter(~below.rlike(r"/(\.[^/]*|vendor)/")).select(path.alias("path"), F.decode("content", "UTF-8").alias("content"))


def files_at(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    """path, content of these files below root, those of them that are there; no other file is read."""
    found = []
    for path in paths:  # plain paths of the local file system, if the root was one, and whole ones of others
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"file://{path}" if root.startswith("file:") and path.startswith("/") else path)
        if at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at):
            found.append(at.toString())
    if not found:
        return spark.createDataFrame([], "path string, content string")
    rows = spark.read.format("binaryFile").load(found)
    return rows.select(F.regexp_replace("path", "^file:/*", "/").alias("path"), F.decode("content", "UTF-8").alias("content"))


def module_path(spark: SparkSession, root: str) -> str | None:
    """The path in the first module line of go.mod, or None."""
    try:
        lines = spark.read.text(f"{root.rstrip('/')}/go.mod")
        row = lines.filter(F.col("value").rlike(r"^module\s+\S")).select(F.regexp_extract("value", r"^module\s+(\S+)", 1)).first()
    except Exception:  # noqa: BLE001  there is none
        return None
    return row[0] if row else None


def parsed(files: DataFrame, module: str | None = None, root: str = "") -> DataFrame:
    """One row a file: its declarations, or the error that kept it from being read. With a module packages are
    whole import paths, by folder; without, the package clause's name."""
    root = plain(root)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"].to_pylist(), batch["content"].to_pylist(), strict=True):
                package = None
                if module:
                    below = path.rsplit("/", 1)[0][len(root) :].strip("/") if path.startswith(root) else ""
                    package = f"{module}/{below}" if below else module
                try:
                    src = parse(content, package)
                    rows.append((path, src.package, None, [{"alias": a, "path": p} for a, p in src.imports.items()], src.functions, src.types))
                except (ValueError, IndexError) as e:
                    rows.append((path, package, str(e) or type(e).__name__, [], [], []))
            columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    schema = to_arrow_schema(T._parse_datatype_string(_PARSED))
    return files.select("path", "content").mapInArrow(run, _PARSED)


def nodes_of(rows: DataFrame) -> DataFrame:
    """Functions and methods (code of functions only), types and interfaces."""
    f = rows.select("file", "package", F.explode("functions").alias("f")).select("file", "package", "f.*")
    f = f.withColumn("type", F.when(F.col("receiver").isNull(), "function").otherwise("method"))
    f = f.withColumn("code", F.when(F.col("type") == "function", F.col("code")))
    t = rows.select("file", "package", F.explode("types").alias("t")).select("file", "package", "t.*")
    t = t.withColumn("type", F.when(F.col("kind") == "interface", "interface").otherwise("type"))
    t = t.withColumn("methods", F.transform("methods", lambda m: F.struct(m["name"].alias("name"), m["signature"].alias("signature"))))
    identify = lambda df: df.withColumn("id", node_id(*(F.col(c) for c in ("type", "package", "name", "file", "line"))))
    out = shaped(identify(f).drop("calls", "references"), NODES).unionByName(shaped(identify(t), NODES))
    return out.dropDuplicates(["id"])


def call_edges(rows: DataFrame) -> DataFrame:
    """calls edges to placeholders, in the order of the text; with how each target was found in extra."""
    f = rows.select("file", "package", F.explode("functions").alias("f")).select("file", "package", "f.*")
    type_ = F.when(F.col("receiver").isNull(), "function").otherwise("method")
    calls = f.select(
        node_id(type_, F.col("package"), F.col("name"), F.col("file"), F.col("line")).alias("from_id"), "line", F.posexplode("calls").alias("pos", "c")
    )
    return calls.select(
        "from_id", placeholder(F.col("c.package"), F.col("c.name")).alias("to_id"), F.lit("calls").alias("type"), F.lit(None).cast("boolean").alias("pointer_receiver"),
        (F.col("line").cast("long") * 100_000 + F.col("pos")).alias("seq"), F.col("c.resolution").alias("extra"),
    )


def _embedded(links: DataFrame) -> DataFrame:
    """type_id, part: all types that a type embeds, directly or through others; each round goes one embedding deeper, from
    what the round before found, until there is nothing new (types may embed pointers to each other)."""
    links = found = new = cut(links.distinct(), "embeds")
    while not new.isEmpty():
        deeper = links.select(F.col("type_id").alias("part"), F.col("part").alias("deeper"))
        new = new.join(deeper, "part").select("type_id", F.col("deeper").alias("part")).distinct()
        new = cut(new.join(found, ["type_id", "part"], "left_anti"), "embeds")
        found = found.unionByName(new)
    return found


def type_relations(rows: DataFrame) -> DataFrame:
    """implements, accepts and returns edges among the types that were read. Methods of embedded types count
    as the type's own, at any depth."""
    f = rows.select("file", "package", F.explode("functions").alias("f")).select("file", "package", "f.*")
    t = rows.select("package", F.explode("types").alias("t")).select("package", "t.*")
    t = t.withColumn("type_id", F.concat(F.lit("type_"), F.col("package"), F.lit("_"), F.col("name")))
    key = F.concat(F.lit("type_"), F.col("package"), F.lit("_"), F.regexp_replace("receiver", r"^\*|\[.*$", ""))
    own = f.filter("receiver IS NOT NULL").select(key.alias("type_id"), "name", F.col("shape").alias("signature"), F.col("receiver").startswith("*").alias("pointer"))
    required = t.filter("kind = 'interface'").select("type_id", F.explode("methods").alias("m")).select("type_id", "m.name", F.col("m.shape").alias("signature"))
    links = t.select("type_id", F.explode("embeds").alias("e")).select("type_id", F.concat(F.lit("type_"), F.regexp_replace("e", r"\.([^.]*)$", "_$1")).alias("part"))
    up = _embedded(links).withColumnRenamed("type_id", "owner")
    own = own.unionByName(own.join(up, F.col("type_id") == F.col("part")).select(F.col("owner").alias("type_id"), "name", "signature", "pointer")).distinct()
    required = required.unionByName(required.join(up, F.col("type_id") == F.col("part")).select(F.col("owner").alias("type_id"), "name", "signature")).distinct()
    concrete = t.filter("kind <> 'interface'").select("type_id").distinct()
    sets = concrete.join(own, "type_id", "left")
    wanted = t.filter("kind = 'interface'").select("type_id").distinct().join(required, "type_id", "left")
    implements = implements_edges(sets, wanted.withColumnRenamed("type_id", "interface_id"))
    type_ = F.when(F.col("receiver").isNull(), "function").otherwise("method")
    refs = f.select(node_id(type_, F.col("package"), F.col("name"), F.col("file"), F.col("line")).alias("from_id"), F.explode("references").alias("r"))
    refs = refs.select("from_id", "r.role", F.concat(F.lit("type_"), F.col("r.package"), F.lit("_"), F.col("r.name")).alias("type_id"))
    return shaped(implements, EDGES).unionByName(shaped(type_edges(refs, t.select(F.col("type_id").alias("id")).distinct()), EDGES))


def edges_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """All edges of parsed files whose nodes these are."""
    return calls_of(rows, nodes).unionByName(type_relations(rows))


def calls_of(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    return shaped(distinct_edges(resolve_placeholders(nodes, call_edges(rows))), EDGES)


def graph_of(rows: DataFrame) -> Graph:
    nodes = nodes_of(rows)
    return Graph(nodes, edges_of(rows, nodes))


def scan(spark: SparkSession, root: str) -> Graph:
    """The graph of a module's tree, tests included."""
    module = module_path(spark, root)
    return graph_of(parsed(go_files(spark, root), module, root))
