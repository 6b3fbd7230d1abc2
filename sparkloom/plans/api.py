"""The tools, resources and endpoints of a code graph server, as functions that give JSON text."""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_callable
from ..operators import analysis, search, traverse
from ..operators.enrich import human_summary, missing_embeddings
from ..sources.store import Store
from .graph import Graph
from .index import index_module
from .lineage import cut


def node_entry() -> list:
    return [
        "id", "name", "package", "signature",
        F.nullif("file", F.lit("")).alias("file"),
        F.when(F.col("line") > 0, F.col("line")).alias("line"),
        F.nullif(F.col("summary.text"), F.lit("")).alias("summary"),
    ]


def records(df: DataFrame) -> list[dict]:
    """Rows as JSON objects without their nulls."""
    return [json.loads(x) for x in df.select(F.to_json(F.struct("*"))).toPandas().iloc[:, 0]] if df.columns else []


def text(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False)


class Server:
    """All tools over one store. Tools raise LookupError for what isn't there and ValueError for bad arguments."""

    def __init__(self, spark: SparkSession, store: Store, root: str = "", embed: Callable | None = None, summarize: Callable | None = None):
        self.spark, self.store, self.root, self.embed, self.summarize = spark, store, root, embed, summarize

    @property
    def graph(self) -> Graph:
        return self.store.load_graph()

    def _one(self) -> Callable | None:
        return (lambda query: self.embed([query])[0]) if self.embed else None

    def _list(self, df: DataFrame) -> str:
        return text(records(df.select(*node_entry())))

    def _need(self, id_: str) -> None:
        if not id_:
            raise ValueError("an id is needed")
        if self.graph.node(id_).isEmpty():
            raise traverse.NodeNotFound(id_)

    # search
    def _ensure(self, nodes: DataFrame) -> None:
        """Vectors for the functions among nodes that have none yet, with summaries where they lack them; what fails is left out."""
        if self.embed:
            rows = missing_embeddings(Graph(nodes, self.graph.edges), self.store.load_embeddings(), self.embed, self.summarize)
            rows = cut(rows, "ensured")
            if not rows.isEmpty():
                self.store.upsert_embeddings(rows)

    def search_functions(self, query: str, package: str | None = None, limit: float = 10) -> str:
        if package:
            self._ensure(self.graph.by(package=package))
        found = search.search_functions(self.graph, self.store.load_embeddings(), query, package, int(limit), self._one())
        return self._list(found)

    def search_by_behavior(self, behaviors: list[str], query: str = "", limit: float = 10) -> str:
        if query:
            self._ensure(self.graph.with_behaviors(behaviors))
        return self._list(search.behavior_search(self.graph, self.store.load_embeddings(), behaviors, query, int(limit), self._one()))

    def get_function_by_name(self, name: str, package: str | None = None, file: str | None = None) -> str:
        return self._list(self.graph.functions_named(name, package, file).orderBy("id"))

    # graph
    def get_callers(self, function_id: str) -> str:
        return self._list(self.graph.callers(function_id).orderBy("name", "id"))

    def get_callees(self, function_id: str) -> str:
        return self._list(self.graph.callees(function_id).orderBy("name", "id"))

    def get_implementors(self, interface_id: str) -> str:
        self._need(interface_id)
        head = records(self.graph.node(interface_id).select("id", "name", "package", "methods"))[0]
        return text({"interface": head, "implementors": records(self.graph.implementors(interface_id).select("id", "name", "package", "kind").orderBy("id"))})

    def get_interfaces(self, type_id: str) -> str:
        self._need(type_id)
        return text(records(self.graph.interfaces(type_id).select("id", "name", "package", "pointer_receiver").orderBy("id")))

    def get_neighborhood(self, node_id: str, depth: float = 2) -> str:
        self._need(node_id)
        found = traverse.neighborhood(self.graph, node_id, int(depth))
        return text({"nodes": records(found.nodes.select(*node_entry()).orderBy("id")), "edges": records(found.edges.select("from_id", "to_id", "type").orderBy("from_id", "to_id", "type"))})

    def trace_chain(self, source: str, target: str, max_depth: float = 10) -> str:
        path = traverse.shortest_path(self.graph, source, target, int(max_depth))
        nodes = {r["id"]: r for r in records(self.graph.nodes.filter(F.col("id").isin(path)).select(*node_entry()))}
        return text({"path_length": len(path), "path": [nodes.get(i, {"id": i}) for i in path]})

    # analysis
    def get_impact(self, function_id: str) -> str:
        self._need(function_id)
        rows = records(analysis.impact(self.graph, function_id).orderBy("role", "name", "id"))
        of = lambda role: [{k: v for k, v in r.items() if k != "role"} for r in rows if r["role"] == role]
        total = records(analysis.impact_summary(self.graph, function_id))[0]
        return text({"node_id": function_id, "direct_callers": of("direct"), "indirect_callers": of("indirect"), "affected_tests": of("test"), "interface_contracts": of("interface"), "risk_level": total["risk_level"], "total_reach": total["total_reach"]})

    def get_contract(self, function_id: str) -> str:
        return text(records(analysis.contract(self.graph, function_id))[0])

    def find_tests(self, function_id: str) -> str:
        return self._list(analysis.find_tests(self.graph, function_id))

    def discover_patterns(self, package: str, pattern: str) -> str:
        found = records(analysis.patterns(self.graph, package, pattern).select(*node_entry()))
        return text({"pattern_type": pattern, "package": package, "count": len(found), "functions": found})

    def get_function_context(self, function_id: str) -> str:
        return text(records(analysis.function_context(self.graph, function_id))[0])

    # administration
    def update_summary(self, function_id: str, summary: str) -> str:
        self._need(function_id)
        self.store.save_graph(human_summary(self.graph, function_id, summary))
        return text({"updated": function_id})

    def reindex_project(self) -> str:
        nodes, edges = index_module(self.spark, self.root, self.store, embed=self.embed)
        return f"Indexed {nodes} nodes and {edges} edges"

    # resources
    def resources(self) -> list[str]:
        f = self.graph.by(type="function")
        uris = f.select(F.concat_ws("/", F.lit("function:/"), "package", "name").alias("u")).union(f.select(F.concat_ws("/", F.lit("package:/"), "package")).distinct())
        return sorted(r[0] for r in uris.distinct().toLocalIterator())

    def resource(self, uri: str) -> str:
        kind, _, rest = uri.partition("://")
        if kind == "package":
            found = records(self.graph.by(package=rest).filter(is_callable(F.col("type"))).select(*node_entry()).orderBy("name", "id"))
            if not found:
                raise LookupError(rest)
            return text(found)
        package, _, name = rest.rpartition("/")
        first = self.graph.by(package=package, name=name, type="function").select(*node_entry()).orderBy("id").limit(1)
        found = records(first)
        if kind != "function" or not found:
            raise LookupError(uri)
        names = lambda df: sorted(r["name"] for r in df.select("name").collect())
        return text(found[0] | {"callers": names(self.graph.callers(found[0]["id"])), "callees": names(self.graph.callees(found[0]["id"]))})

    # endpoints
    def graph_json(self, module: str | None = None, scope: str = "") -> str:
        g = self.graph.scoped(module, scope == "all")
        return text({"nodes": records(g.nodes.select("id", "name", "type", "package").orderBy("id")), "edges": records(g.edges.select("from_id", "to_id", "type").orderBy("from_id", "to_id", "type"))})

    def packages_json(self) -> str:
        return text([r[0] for r in self.graph.packages().collect()])

    def package_nodes_json(self, package: str) -> str:
        return text(records(self.graph.by(package=package).select("id", "name", "type", "line").orderBy("id")))

    def node_json(self, id_: str) -> str:
        self._need(id_)
        return text(records(self.graph.node(id_).select("type", *node_entry()))[0])

    def exact_search_json(self, query: str) -> str:
        return self._list(self.graph.by(name=query).orderBy("id")) if query else text([])

    def stats_json(self) -> str:
        rows = records(self.graph.stats())
        of = lambda kind: {r["key"]: r["n"] for r in rows if r["kind"] == kind}
        return text({"nodes": of("nodes").get("", 0), "edges": of("edges").get("", 0), "by_type": of("type"), "by_package": of("package")})
