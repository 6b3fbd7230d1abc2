"""Scans, the store and enrichment as queries, over the large generated module; with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.names import node_id
from ..operators import enrich
from ..sources import providers
from ..sources.files import call_edges, calls_of, nodes_of, parsed, type_relations
from ..sources.store import Store
from .generated import MODULE, PACKAGES, Scanned, files, module_sql, scanned
from .graph import Graph
from .lineage import cut, shared_folder
from .schema import EMBEDDINGS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    """Registers a function of the session, the tables' folder and the scanned module."""

    def keep(f):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir, scanned(spark, sf_dir))
        ORACLE_SQL[name] = f"WITH {module_sql()} {sql}"
        return f

    return keep


_CALLABLE = "type IN ('function', 'method')"
_GIVEN = "type = 'function'"

_query("S1_file_scan", "SELECT file, 'p' || p AS package, CASE WHEN k % 5 = 0 THEN 6 ELSE 5 END::INT AS functions, CASE WHEN k % 5 = 0 THEN 3 ELSE 2 END::INT AS types FROM c")(
    lambda s, sf, m: parsed(files(s, sf)).select("file", "package", F.size("functions").alias("functions"), F.size("types").alias("types"))
)
_query("S2_module_scan", "SELECT file, pk AS package FROM c")(lambda s, sf, m: m.rows.select("file", "package"))
_query("S4_declarations", "SELECT id, type, name, receiver, length(code)::INT AS code_length FROM gnodes")(
    lambda s, sf, m: nodes_of(m.rows).select("id", "type", "name", "receiver", F.length("code").alias("code_length"))
)
_query("S5_call_edges", "SELECT from_id, placeholder AS to_id, seq FROM gcalls")(lambda s, sf, m: call_edges(m.rows).select("from_id", "to_id", "seq"))
_query("S6_call_resolution", "SELECT from_id, to_id, resolution FROM gcalls")(lambda s, sf, m: m.graph.calls().select("from_id", "to_id", F.col("extra").alias("resolution")))
_query("S7_import_aliases", f"SELECT file, 'log' AS alias, 'log' AS path FROM c UNION ALL SELECT file, 'cfg', '{MODULE}/p' || q FROM c")(
    lambda s, sf, m: m.rows.select("file", F.explode("imports").alias("i")).select("file", "i.alias", "i.path")
)
_query("S8_signatures", "SELECT id, signature FROM gnodes")(lambda s, sf, m: nodes_of(m.rows).select("id", "signature"))
_query("S9_docstrings", "SELECT id, docstring FROM gnodes WHERE docstring <> ''")(lambda s, sf, m: nodes_of(m.rows).filter("docstring <> ''").select("id", "docstring"))
_query("S10_types", "SELECT id, kind, methods FROM gnodes WHERE type IN ('type', 'interface')")(
    lambda s, sf, m: nodes_of(m.rows).filter("type IN ('type', 'interface')").select("id", "kind", F.to_json("methods").alias("methods"))
)
_query("S11_implements", "SELECT from_id, to_id, pointer_receiver FROM gtypes WHERE type = 'implements'")(
    lambda s, sf, m: type_relations(m.rows).filter("type = 'implements'").select("from_id", "to_id", "pointer_receiver")
)
_query("S12_accepts_returns", "SELECT from_id, to_id, type FROM gtypes WHERE type <> 'implements'")(
    lambda s, sf, m: type_relations(m.rows).filter("type <> 'implements'").select("from_id", "to_id", "type")
)
_query("S13_ids_agree", "SELECT from_id AS id, true AS agree FROM gedges GROUP BY from_id")(
    lambda s, sf, m: m.edges.select(F.col("from_id").alias("id")).distinct().join(m.nodes, "id").select("id", (node_id(*(F.col(c) for c in ("type", "package", "name", "file", "line"))) == F.col("id")).alias("agree"))
)
_query("S16_source_text", "SELECT id, code FROM gnodes WHERE code IS NOT NULL")(lambda s, sf, m: nodes_of(m.rows).filter("code IS NOT NULL").select("id", "code"))
_query("J13_method_sets", "SELECT to_id AS id, count(*) AS implementors, bool_or(pointer_receiver) AS pointer FROM gtypes WHERE type = 'implements' GROUP BY to_id")(
    lambda s, sf, m: type_relations(m.rows).filter("type = 'implements'").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("implementors"), F.bool_or("pointer_receiver").alias("pointer"))
)


def _stored(spark: SparkSession, name: str) -> Store:
    return Store(spark, f"{shared_folder(spark)}/generated-{name}")


@_query("K1_snapshot_round_trip", "SELECT id, type, methods FROM gnodes")
def _snapshot(spark: SparkSession, sf_dir: str, m: Scanned) -> DataFrame:
    _stored(spark, "k1").save_graph(m.graph)
    return _stored(spark, "k1").load_graph().nodes.select("id", "type", F.to_json("methods").alias("methods"))


@_query("K2_unique_edges", "SELECT from_id, to_id, type, 1::BIGINT AS count FROM gedges")
def _unique(spark: SparkSession, sf_dir: str, m: Scanned) -> DataFrame:
    """Every edge given twice is stored once."""
    _stored(spark, "k2").save_graph(Graph(m.nodes, m.edges.unionByName(m.edges)))
    return _stored(spark, "k2").load_graph().edges.groupBy("from_id", "to_id", "type").count()


def _embedded(spark: SparkSession, g: Graph) -> DataFrame:
    return enrich.missing_embeddings(g, spark.createDataFrame([], EMBEDDINGS), providers.mock_embedding, providers.mock_summary)


@_query("K3_embedding_upsert", f"SELECT id AS node_id, 'Function ' || name || ' in package ' || package AS summary_text, 1.0::DOUBLE AS summary_norm FROM gnodes WHERE {_GIVEN}")
def _upsert(spark: SparkSession, sf_dir: str, m: Scanned) -> DataFrame:
    store, made = _stored(spark, "k3"), cut(_embedded(spark, m.bare), "embedded")
    store.upsert_embeddings(made)
    store.upsert_embeddings(made)
    return store.load_embeddings().select("node_id", "summary_text", F.round("summary_norm", 6).alias("summary_norm"))


@_query("K4_embedding_delete", f"SELECT id AS node_id FROM gnodes WHERE {_GIVEN} AND id NOT LIKE '%Use%'")
def _delete(spark: SparkSession, sf_dir: str, m: Scanned) -> DataFrame:
    store, made = _stored(spark, "k4"), cut(_embedded(spark, m.bare), "embedded")
    store.upsert_embeddings(made)
    store.delete_embeddings(made.filter("node_id LIKE '%Use%'"))
    return store.load_embeddings().select("node_id")


_query("K6_json", """SELECT id, '{"name":"' || name || '","package":"' || package || CASE WHEN signature IS NULL THEN '"}' ELSE '","signature":"' || signature || '"}' END AS json FROM gnodes""")(
    lambda s, sf, m: m.nodes.select("id", F.to_json(F.struct("name", "package", "signature")).alias("json"))
)
_TAGS = f"CASE WHEN {_CALLABLE} THEN CASE WHEN contains(lower(coalesce(code, signature)), 'log.') THEN 'logging' WHEN contains(coalesce(code, signature), 'error') THEN 'error-handle' ELSE '' END END"
_query("E3_behavior_tags", f"SELECT id, {_TAGS} AS behaviors FROM gnodes")(
    lambda s, sf, m: enrich.with_tags(m.bare, providers.mock_tags).nodes.select("id", F.array_join("behaviors", ",").alias("behaviors"))
)
_SAID = "'Function ' || name || ' in package ' || package"
_query("E5_summaries", f"SELECT id, CASE WHEN {_GIVEN} THEN {_SAID} END AS summary FROM gnodes")(
    lambda s, sf, m: enrich.with_summaries(m.bare, providers.mock_summary, now=lambda: 0).nodes.select("id", F.col("summary.text").alias("summary"))
)
_query("E7_update_summary", "SELECT id, CASE WHEN name = 'Use7' THEN 'by hand' END AS summary FROM gnodes")(
    lambda s, sf, m: enrich.human_summary(m.bare, m.bare.by(name="Use7").first()["id"], "by hand", lambda: 0).nodes.select("id", F.col("summary.text").alias("summary"))
)
_query(
    "E10_prompts",
    f"SELECT id, concat_ws(chr(10), 'Summarise this function in one or two sentences.', 'Package: ' || package, 'Name: ' || name, 'Signature: ' || signature, CASE WHEN docstring <> '' THEN 'Documentation: ' || docstring END, 'Code: ' || code) AS prompt FROM gnodes WHERE {_GIVEN}",
)(lambda s, sf, m: enrich.prompts(m.bare))
_query("V14_embed_missing", f"SELECT id AS node_id, {_SAID} AS summary_text, 64::INT AS size FROM gnodes WHERE {_GIVEN} AND id NOT LIKE '%helper%'")(lambda s, sf, m: _missing(s, m.bare))
_query("U5_replace_all", f"SELECT id FROM gnodes WHERE {_GIVEN}")(lambda s, sf, m: _replaced(s, m.graph))
_query("U7_point_update", "SELECT id, CASE WHEN name = 'New7' THEN 'a row' END AS summary FROM gnodes")(lambda s, sf, m: _updated(m.bare))
_query("S14_graph_scan", "SELECT type, count(*) AS n FROM gnodes GROUP BY type UNION ALL SELECT type, count(*) FROM gedges GROUP BY type")(lambda s, sf, m: _scan(s, m.graph))
_query("T6_packages_added", f"SELECT from_id, to_id FROM gcalls WHERE from_id IN (SELECT id FROM gnodes WHERE package IN ('{MODULE}/p1', '{MODULE}/p2'))")(lambda s, sf, m: _added(m.rows))
_query("A2_packages_of_module", f"SELECT '{MODULE}/p' || p AS package, count(*) AS nodes FROM gnodes JOIN (SELECT DISTINCT p FROM c) x ON package = '{MODULE}/p' || p WHERE p < {PACKAGES} GROUP BY 1")(
    lambda s, sf, m: m.nodes.groupBy("package").agg(F.count("*").alias("nodes"))
)


def _missing(spark: SparkSession, g: Graph) -> DataFrame:
    """Vectors for what lacks one, where helpers have theirs already."""
    made = cut(_embedded(spark, g), "embedded")
    rest = enrich.missing_embeddings(g, made.filter("node_id LIKE '%helper%'"), providers.mock_embedding, providers.mock_summary)
    return rest.select("node_id", "summary_text", F.size("summary_embedding").alias("size"))


def _scan(spark: SparkSession, g: Graph) -> DataFrame:
    _stored(spark, "s14").save_graph(g)
    read = _stored(spark, "s14").load_graph()
    return read.nodes.groupBy("type").agg(F.count("*").alias("n")).union(read.edges.groupBy("type").count())


def _added(rows: DataFrame) -> DataFrame:
    """The calls of two packages' files, added one after the other to a graph that has the rest."""
    one, two = (rows.filter(F.col("package") == f"{MODULE}/{p}") for p in ("p1", "p2"))
    rest = rows.filter(~F.col("package").isin(f"{MODULE}/p1", f"{MODULE}/p2"))
    from ..operators.resolve import resolve_placeholders

    def called(part: DataFrame) -> Graph:
        nodes = nodes_of(part)
        return Graph(nodes, calls_of(part, nodes))

    g = called(rest)
    for part in (one, two):
        new = called(part)
        g = g.add(new.nodes, new.edges)
    nodes = cut(g.nodes.select("id", "type", "package", "name", "file", "line"), "added")
    own = nodes.filter(F.col("package").isin(f"{MODULE}/p1", f"{MODULE}/p2")).select(F.col("id").alias("from_id"))
    calls = g.calls().join(own, "from_id", "left_semi").select(*g.edges.columns)
    return resolve_placeholders(nodes, calls).select("from_id", "to_id")


def _replaced(spark: SparkSession, g: Graph) -> DataFrame:
    store = _stored(spark, "u5")
    store.save_graph(g)
    store.save_graph(Graph(g.nodes.filter("type = 'function'"), g.edges))
    return store.load_graph().nodes.select("id")


def _updated(g: Graph) -> DataFrame:
    fields = (F.lit("a row").alias("text"), F.lit("llm").alias("generated_by"), F.lit("").alias("model"), F.lit(0).cast("long").alias("created_at"), F.lit(0).cast("long").alias("updated_at"))
    new = g.by(name="New7").select("id", F.struct(*fields).alias("summary"))
    return g.with_summaries(new).nodes.select("id", F.col("summary.text").alias("summary"))
