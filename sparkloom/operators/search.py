"""Search by name, by meaning and by behaviour."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import search as vector_search
from ..plans.graph import Graph

Embed = Callable[[str], list[float]]


def name_search(graph: Graph, query: str, limit: int = 10, with_package: bool = True) -> DataFrame:
    """Functions whose name (or package) contains the query, whatever the case; by name and id."""
    q = query.lower()
    hit = F.lower("name").contains(q)
    hit = hit | F.lower("package").contains(q) if with_package else hit
    return graph.nodes.filter((F.col("type") == "function") & hit).orderBy("name", "id").limit(max(0, limit))


def hydrated(graph: Graph, found: DataFrame) -> DataFrame:
    """Search results with their nodes; those without one are dropped, after the limit."""
    return found.join(graph.nodes, F.col("node_id") == F.col("id")).drop("node_id", "text").orderBy(F.desc("score"), "id")


def semantic_search(graph: Graph, embeddings: DataFrame, query: str, embed: Embed | None, limit: int = 10) -> DataFrame:
    """By vectors over all that is embedded; by name if the query can't be embedded or nothing is found."""
    try:
        found = hydrated(graph, vector_search(embeddings, embed(query), limit)) if embed else None
    except Exception:  # noqa: BLE001  a provider may fail in any way
        found = None
    if found is None or found.isEmpty():
        return name_search(graph, query, limit)
    return found


def package_search(graph: Graph, embeddings: DataFrame, query: str, package: str, embed: Embed | None, limit: int = 10) -> DataFrame:
    """By vectors over a package's functions; by their names if the query can't be embedded."""
    own = Graph(graph.by(package=package, type="function"), graph.edges)
    try:
        vector = embed(query) if embed else None
    except Exception:  # noqa: BLE001
        vector = None
    if vector is None:
        return name_search(own, query, limit, with_package=False)
    return hydrated(own, vector_search(embeddings, vector, limit, own.nodes.select("id")))


def search_functions(graph: Graph, embeddings: DataFrame, query: str, package: str | None = None, limit: int = 10, embed: Embed | None = None) -> DataFrame:
    if package:
        return package_search(graph, embeddings, query, package, embed, limit)
    return semantic_search(graph, embeddings, query, embed, limit) if embed else name_search(graph, query, limit)


def behavior_search(graph: Graph, embeddings: DataFrame, tags: list[str], query: str = "", limit: int = 10, embed: Embed | None = None) -> DataFrame:
    """Functions and methods with all the tags; ranked by the query if there is one and it can be embedded,
    else by name. Without ranking a limit of 0 or less is no limit."""
    found = graph.with_behaviors(tags)
    try:
        vector = embed(query) if query and embed else None
    except Exception:  # noqa: BLE001  a provider may fail in any way
        vector = None
    if vector is not None:
        return hydrated(Graph(found, graph.edges), vector_search(embeddings, vector, limit, found.select("id")))
    listed = found.orderBy("name", "id")
    return listed.limit(limit) if limit > 0 else listed
