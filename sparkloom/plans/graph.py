"""The property graph: two DataFrames, and lookups, joins, counts and set operations on them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import has_all, is_callable, is_project_package

KEY = ["from_id", "to_id", "type"]
#: So many ids are looked for by a filter; more, by a join.
FEW = 200


def distinct_edges(edges: DataFrame) -> DataFrame:
    """One edge for each (from, to, type): the first by seq."""
    if "seq" not in edges.columns:
        return edges.dropDuplicates(KEY)
    rest = [c for c in edges.columns if c not in KEY]
    first = F.min_by(F.struct(*rest), F.coalesce("seq", F.lit(2**62)))
    return edges.groupBy(*KEY).agg(first.alias("_e")).select(*KEY, *(F.col(f"_e.{c}").alias(c) for c in rest))


def latest(rows: DataFrame, key: str, order: Column) -> DataFrame:
    """The last row of each key by order: an upsert of all of them in turn."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy(order.desc()))
    return rows.withColumn("_nth", nth).filter("_nth = 1").drop("_nth")


@dataclass(frozen=True)
class Graph:
    nodes: DataFrame
    edges: DataFrame
    incoming: DataFrame | None = None  # the same edges, stored by to_id where the others are by from_id
    pairs: DataFrame | None = None  # the same edges, some more than once, with the packages of both ends: for what asks only whether there is one

    def links(self, backward: bool = False) -> DataFrame:
        """Edges for what asks only whether there is one: some may come more than once. Those that tell the packages of their
        ends (from_package, to_package) are best filtered by them."""
        return self.pairs if self.pairs is not None else self.into if backward else self.edges

    @property
    def into(self) -> DataFrame:
        """The edges, for filters and joins on to_id."""
        return self.edges if self.incoming is None else self.incoming

    # lookups
    def node(self, id_: str) -> DataFrame:
        return self.nodes.filter(F.col("id") == id_)

    def by(self, **equal) -> DataFrame:
        """Nodes by equality on any of type, package, name, file."""
        out = self.nodes
        for column, value in equal.items():
            out = out.filter(F.col(column) == value)
        return out

    def functions_named(self, name: str, package: str | None = None, file: str | None = None) -> DataFrame:
        """Functions and methods of exactly this name, of a package, in files whose path contains file."""
        out = self.by(name=name).filter(is_callable(F.col("type")))
        out = out.filter(F.col("package") == package) if package else out
        return out.filter(F.col("file").contains(file)) if file else out

    def with_behaviors(self, tags: list[str]) -> DataFrame:
        return self.nodes.filter(is_callable(F.col("type")) & has_all(tags, F.col("behaviors")))

    def scoped(self, module: str | None, all_: bool = False) -> Graph:
        """The module's nodes, and the edges between them; everything without a module, or if all_."""
        if all_ or not module:
            return self
        nodes = self.nodes.filter(is_project_package(F.col("package"), module))
        return Graph(nodes, self.edges_within(nodes))

    def edges_within(self, nodes: DataFrame) -> DataFrame:
        out = self.edges
        for end in ("to", "from"):
            ids = nodes
            if self.pairs is not None:  # nodes of other packages than the edges' ends can't be ends
                ids = nodes.filter(F.col("package").isin([r[0] for r in self.pairs.select(f"{end}_package").distinct().collect()]))
            out = out.join(ids.select(F.col("id").alias(f"{end}_id")), f"{end}_id", "left_semi")
        return out.select(*self.edges.columns)

    def visible_edges(self, types: list[str]) -> DataFrame:
        seen = F.col("type").isin(types)
        return Graph(self.nodes, self.edges.filter(seen), pairs=None if self.pairs is None else self.pairs.filter(seen)).edges_within(self.nodes)

    def among(self, ids: DataFrame) -> DataFrame:
        """The nodes of these ids (id); a few of them are held by the driver, and looked for by a filter."""
        few = [r["id"] for r in ids.select("id").distinct().limit(FEW + 1).collect()]
        return self.nodes.filter(F.col("id").isin(few)) if len(few) <= FEW else self.nodes.join(ids, "id", "left_semi")

    def edges_from(self, id_: str) -> DataFrame:
        return self.edges.filter(F.col("from_id") == id_)

    # joins of edges and nodes
    def calls(self) -> DataFrame:
        return self.edges.filter("type = 'calls'")

    def callers(self, id_: str) -> DataFrame:
        return self._other_end(self.into.filter((F.col("type") == "calls") & (F.col("to_id") == id_)), "from_id")

    def callees(self, id_: str) -> DataFrame:
        return self.neighbors(id_, "calls")

    def neighbors(self, id_: str, type_: str) -> DataFrame:
        return self._other_end(self.edges_from(id_).filter(F.col("type") == type_), "to_id")

    def implementors(self, interface_id: str) -> DataFrame:
        found = self.into.filter((F.col("type") == "implements") & (F.col("to_id") == interface_id))
        return self._other_end(found, "from_id")

    def interfaces(self, type_id: str) -> DataFrame:
        """Interfaces that a type implements, and whether only by its pointer."""
        found = self.edges_from(type_id).filter("type = 'implements'").select("to_id", "pointer_receiver")
        return self.nodes.join(found, F.col("id") == F.col("to_id")).drop("to_id")

    def stored(self, write: Callable[[DataFrame, str], DataFrame]) -> Graph:
        """The graph as written by `write` (of a table and a name): nodes in the order of ids, edges in that of from_id, and again
        in that of to_id, so that lookups and small joins on ids read the files and pages that have them only."""
        by = lambda df, *c: df.repartitionByRange(*c).sortWithinPartitions(*c)
        nodes, edges = write(by(self.nodes, "id"), "nodes"), write(by(self.edges, "from_id", "to_id"), "edges")
        return Graph(nodes, edges, write(by(edges, "to_id", "from_id"), "incoming"))

    def _other_end(self, edges: DataFrame, end: str) -> DataFrame:
        return self.among(edges.select(F.col(end).alias("id")))

    # counts
    def stats(self) -> DataFrame:
        """kind (nodes, edges, type or package), key, n."""
        groups = (
            self.nodes.groupingSets([["type"], ["package"], []], "type", "package")
            .agg(F.count("*").alias("n"), F.grouping("type").alias("gt"), F.grouping("package").alias("gp"))
            .select(
                F.when(F.col("gt") == 0, "type").when(F.col("gp") == 0, "package").otherwise("nodes").alias("kind"),
                F.coalesce("type", "package", F.lit("")).alias("key"),
                "n",
            )
        )
        return groups.union(self.edges.agg(F.count("*").alias("n")).select(F.lit("edges").alias("kind"), F.lit("").alias("key"), "n"))

    def packages(self) -> DataFrame:
        return self.nodes.select("package").distinct().orderBy("package")

    def degrees(self) -> DataFrame:
        """id, callers, callees: calls edges in and out, those to or from ids without a node too."""
        ends = self.calls().select(F.explode(F.array(F.struct(F.col("to_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("from_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
        return ends.groupBy("e.id").agg(F.sum("e.i").alias("callers"), F.sum("e.o").alias("callees"))

    # set operations; each gives a new graph
    def add(self, nodes: DataFrame, edges: DataFrame) -> Graph:
        """Nodes replace those of their id; edges that are there already stay as they are."""
        kept = self.nodes.join(nodes.select("id").distinct(), "id", "left_anti")
        one = nodes.dropDuplicates(["id"])
        return Graph(kept.unionByName(one, allowMissingColumns=True), self._merged(edges))

    def _merged(self, edges: DataFrame) -> DataFrame:
        new = edges.join(self.edges.select(*KEY), KEY, "left_anti")
        return self.edges.unionByName(distinct_edges(new), allowMissingColumns=True)

    def without(self, gone: Column) -> Graph:
        """Without the nodes for which gone holds, and the edges that touch them."""
        bad = self.nodes.filter(gone).select("id")
        nodes = self.nodes.filter(~F.coalesce(gone, F.lit(False)))
        edges = self.edges.join(bad.withColumnRenamed("id", "from_id"), "from_id", "left_anti")
        return Graph(nodes, edges.join(bad.withColumnRenamed("id", "to_id"), "to_id", "left_anti").select(*self.edges.columns))

    def without_package(self, package: str) -> Graph:
        return self.without(F.col("package") == package)

    def without_file(self, file: str) -> Graph:
        return self.without(F.col("file") == file)

    def with_summaries(self, summaries: DataFrame) -> Graph:
        """summaries (id, summary) over those of the nodes."""
        new = summaries.withColumnRenamed("summary", "_new")
        nodes = self.nodes.join(new, "id", "left").withColumn("summary", F.coalesce("_new", "summary")).drop("_new")
        return Graph(nodes.select(*self.nodes.columns), self.edges)
