"""Indexing: a whole module, and the files that changed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import is_callable, placeholder
from ..operators.enrich import Embedder, Summarizer, Tagger, missing_embeddings, with_summaries, with_tags
from ..operators.resolve import resolve_placeholders
from ..sources.files import call_edges, files_at, go_files, graph_of, module_path, nodes_of, parsed, plain, scan, type_relations
from ..sources.store import Store
from .graph import Graph, distinct_edges
from .lineage import cut
from .schema import EDGES, NODES, shaped


def keep_human_summaries(old: DataFrame, new: DataFrame) -> DataFrame:
    """new nodes with the summaries that people wrote on old ones: by id, else by package, name and receiver,
    as ids change with lines."""
    human = old.filter("summary.generated_by = 'human'")
    by_id = human.select("id", F.col("summary").alias("_a"))
    name = lambda: F.concat_ws("\x1f", "package", "name", F.coalesce("receiver", F.lit("")))
    by_name = human.groupBy(name().alias("_n")).agg(F.max_by("summary", "id").alias("_b"))
    out = new.withColumn("_n", name()).join(by_id, "id", "left").join(by_name, "_n", "left")
    return out.withColumn("summary", F.coalesce("_a", "_b", "summary")).select(*new.columns)


def index_module(spark: SparkSession, root: str, store: Store, tagger: Tagger | None = None, embed: Embedder | None = None) -> tuple[int, int]:
    """Replaces the stored graph by the module's, then embeds what lacks vectors; the numbers of nodes and edges.
    If no file can be read, the old graph stays and ValueError is raised."""
    module = module_path(spark, root)
    rows = cut(parsed(go_files(spark, root), module, root), "parsed")
    if rows.filter("error IS NULL").isEmpty():
        raise ValueError(f"no readable source below {root}")
    graph = graph_of(rows)
    graph = with_tags(graph, tagger) if tagger else graph
    _save(store, Graph(keep_human_summaries(store.load_graph().nodes, graph.nodes), graph.edges), embed, rows)
    saved = store.load_graph()
    return saved.nodes.count(), saved.edges.count()


def _save(store: Store, graph: Graph, embed: Embedder | None, files: DataFrame | None = None) -> None:
    store.save_graph(graph, files)
    saved = store.load_graph()
    stale = store.load_embeddings().join(saved.nodes.select(F.col("id").alias("node_id")), "node_id", "left_anti")
    if not stale.isEmpty():
        store.delete_embeddings(stale)
    if embed:
        store.upsert_embeddings(missing_embeddings(saved, store.load_embeddings(), embed))


def reindex_files(spark: SparkSession, root: str, store: Store, changed: list[str], deleted: list[str], tagger: Tagger | None = None, embed: Embedder | None = None) -> None:
    """The stored graph with changed files read again and deleted ones gone. Only changed files are parsed: what others hold
    is stored with the graph (if it isn't, the tree is parsed once). A file that can't be read keeps what
    it had. Edges from other files into a changed one are resolved anew, by name, and type relations are
    those of all files as they are now."""
    module = module_path(spark, root)
    old, before = store.load_graph(), store.load_files()
    if before is None:
        before = parsed(go_files(spark, root), module, root)
    fresh = cut(parsed(files_at(spark, root, changed), module, root).filter("error IS NULL"), "fresh")
    gone = fresh.select("file").union(spark.createDataFrame([(p,) for p in deleted], "file string")).distinct()
    now = cut(before.join(gone, "file", "left_anti").select(*before.columns).unionByName(fresh), "parsed")
    nodes = old.nodes.join(gone, "file", "left_anti").select(*old.nodes.columns)
    new = nodes_of(fresh)
    new = with_tags(Graph(new, old.edges), tagger).nodes if tagger else new
    nodes = cut(nodes.unionByName(shaped(keep_human_summaries(old.nodes, new), NODES)), "nodes")
    ids = old.nodes.select(F.col("id").alias("to_id"), placeholder(F.col("package"), F.col("name")).alias("_p"), is_callable(F.col("type")).alias("_c"))
    lost = ids.filter("_c").join(nodes.select(F.col("id").alias("to_id")), "to_id", "left_anti")
    kept = old.calls().join(nodes.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    kept = kept.join(lost, "to_id", "left").withColumn("to_id", F.coalesce("_p", "to_id")).select(*EDGES.names)
    calls = kept.join(new.select(F.col("id").alias("from_id")), "from_id", "left_anti").select(*EDGES.names).unionByName(shaped(call_edges(fresh), EDGES))
    calls = distinct_edges(resolve_placeholders(nodes, calls))
    _save(store, Graph(nodes, shaped(calls, EDGES).unionByName(type_relations(now.filter("error IS NULL")))), embed, now)


def index_package(spark: SparkSession, root: str, folder: str, store: Store) -> None:
    """Adds the declarations of one folder's files to the stored graph, over those of the same ids; removes nothing."""
    rows = parsed(go_files(spark, root), module_path(spark, root), root).filter(F.col("error").isNull())
    new = graph_of(cut(rows.filter(F.regexp_replace("file", "/[^/]*$", "") == f"{plain(root)}/{folder}"), "package"))
    old = store.load_graph()
    merged = old.add(new.nodes, new.edges)
    _save(store, Graph(merged.nodes, distinct_edges(resolve_placeholders(merged.nodes, merged.edges))), None)


def generate_summaries(store: Store, summarize: Summarizer, embed: Embedder | None = None) -> None:
    """With an embedding provider, vectors for the stored functions that lack them; without, summaries of all functions."""
    graph = store.load_graph()
    if embed:
        store.upsert_embeddings(missing_embeddings(graph, store.load_embeddings(), embed, summarize))
    else:
        store.save_graph(with_summaries(graph, summarize))


def watcher(spark: SparkSession, root: str, store: Store, **how) -> Callable[[list[str], list[str]], None]:
    return lambda changed, deleted: reindex_files(spark, root, store, changed, deleted, **how)


__all__ = ["generate_summaries", "index_module", "index_package", "keep_human_summaries", "reindex_files", "scan", "watcher"]
