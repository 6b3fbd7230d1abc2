"""The engine's operators as queries over the star schema's graph, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names, vectors
from ..operators import analysis, search, traverse
from ..streaming.changes import debounced
from .graph import Graph, distinct_edges, latest
from .tables import fk_graph, graph_sql, load, table_embeddings

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

_NODE = "id, name, package, signature"
_IS_TEST = "(starts_with(name, 'Test') OR starts_with(name, 'Benchmark') OR starts_with(name, 'Example') OR ends_with(file, '_test.go'))"
_CALLABLE = "type IN ('function', 'method')"


def node_columns(df: DataFrame) -> DataFrame:
    return df.select("id", "name", "package", "signature")


def query(name: str, sql: str | None = None, graph: bool = True):
    """Registers a function of the graph (or of spark and sf_dir); sql follows the graph's expressions."""

    def keep(f):
        QUERIES[name] = (lambda spark, sf_dir: f(fk_graph(spark, sf_dir))) if graph else f
        if sql is not None:
            ORACLE_SQL[name] = f"WITH RECURSIVE {graph_sql()}{', ' if sql.lstrip().startswith('+') else ' '}{sql.lstrip().removeprefix('+')}" if graph else sql
        return f

    return keep


def _where(condition: str) -> str:
    return f"SELECT {_NODE} FROM nodes WHERE {condition}"


# Lookups.
query("F1_get_node", _where("id = 'nation_3'"))(lambda g: node_columns(g.node("nation_3")))
query("F2_nodes_by_type", _where("type = 'method'"))(lambda g: node_columns(g.by(type="method")))
query("F3_nodes_by_package", _where("package = 'customer'"))(lambda g: node_columns(g.by(package="customer")))
query("F4_nodes_by_name", _where("name = 'line3'"))(lambda g: node_columns(g.by(name="line3")))
query("F5_nodes_by_name_and_package", _where("name = 'Part7' AND package = 'part'"))(lambda g: node_columns(g.by(name="Part7", package="part")))
query("F6_nodes_by_file", _where("file = 'supplier.go'"))(lambda g: node_columns(g.by(file="supplier.go")))
query("F7_nodes_by_package_and_type", _where("package = 'part' AND type = 'method'"))(lambda g: node_columns(g.by(package="part", type="method")))
query("F8_get_function_by_name", _where(f"name = 'line2' AND package = 'lineitem' AND contains(file, 'item') AND {_CALLABLE}"))(
    lambda g: node_columns(g.functions_named("line2", "lineitem", "item"))
)
query("F9_nodes_by_behaviors", _where(f"{_CALLABLE} AND list_has_all(coalesce(behaviors, []), ['click', 'purchase'])"))(
    lambda g: node_columns(g.with_behaviors(["click", "purchase"]))
)
query("F10_test_functions", _where(f"{_CALLABLE} AND {_IS_TEST}"))(
    lambda g: node_columns(g.nodes.filter(names.is_callable(F.col("type")) & names.is_test(F.col("name"), F.col("file"))))
)
query("F11_project_packages", "SELECT DISTINCT package FROM nodes WHERE starts_with(package, 'o') OR package = 'o' OR package = 'main'")(
    lambda g: g.nodes.filter(names.is_project_package(F.col("package"), "o")).select("package").distinct()
)
query(
    "F12_scoped_graph",
    "+ s AS (SELECT id FROM nodes WHERE starts_with(package, 'o')) SELECT from_id, to_id, type FROM edges WHERE from_id IN (FROM s) AND to_id IN (FROM s)",
)(lambda g: g.scoped("o").edges.select("from_id", "to_id", "type"))
query("F13_valid_tags", "SELECT id, array_to_string(list_filter(behaviors, lambda t: t IN ('click', 'view')), ',') AS tags FROM nodes WHERE package = 'customer' AND behaviors IS NOT NULL")(
    lambda g: g.by(package="customer").filter("behaviors IS NOT NULL").select("id", F.array_join(names.valid_tags(F.col("behaviors"), ("click", "view")), ",").alias("tags"))
)
query(
    "F14_node_list",
    "SELECT id, name, package, signature, nullif(file, '') AS file, CASE WHEN line > 0 THEN line END AS line FROM nodes WHERE package = 'nation'",
)(lambda g: g.by(package="nation").select("id", "name", "package", "signature", F.nullif("file", F.lit("")).alias("file"), F.when(F.col("line") > 0, F.col("line")).alias("line")))
query("F15_package_nodes", "SELECT id, name, type, line FROM nodes WHERE package = 'region'")(lambda g: g.by(package="region").select("id", "name", "type", "line"))
query("F16_exact_name", _where("name = 'Part12'"))(lambda g: node_columns(g.by(name="Part12")))
query(
    "F17_visible_edges",
    "SELECT from_id, to_id, type FROM edges WHERE type IN ('implements', 'returns') AND from_id IN (SELECT id FROM nodes) AND to_id IN (SELECT id FROM nodes)",
)(lambda g: g.visible_edges(["implements", "returns"]).select("from_id", "to_id", "type"))
query(
    "F18_highlight",
    "+ n AS (SELECT 'nation_3' AS id UNION SELECT to_id FROM edges WHERE from_id = 'nation_3' UNION SELECT from_id FROM edges WHERE to_id = 'nation_3') SELECT package, count(*) AS dimmed FROM nodes WHERE id NOT IN (FROM n) GROUP BY package",
)(
    lambda g: g.nodes.join(traverse.ball(g, "nation_3", 1).select("id"), "id", "left_anti").groupBy("package").agg(F.count("*").alias("dimmed"))
)

# Joins.
_CALLERS = "SELECT {n} FROM nodes WHERE id IN (SELECT from_id FROM edges WHERE type = 'calls' AND to_id = '{id}')"
query("J1_get_callers", _CALLERS.format(n=_NODE, id="nation_3"))(lambda g: node_columns(g.callers("nation_3")))
query("J2_get_callees", f"SELECT {_NODE} FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE type = 'calls' AND from_id = 'lineitem_7_1')")(
    lambda g: node_columns(g.callees("lineitem_7_1"))
)
query("J3_neighbors_by_type", f"SELECT {_NODE} FROM nodes WHERE id IN (SELECT to_id FROM edges WHERE type = 'accepts' AND from_id = 'orders_7')")(
    lambda g: node_columns(g.neighbors("orders_7", "accepts"))
)
_IMPLEMENTS = f"SELECT {_NODE} FROM nodes WHERE id IN (SELECT from_id FROM edges WHERE type = 'implements' AND to_id = 'ptype_PROMO')"
query("J4_get_implementors", _IMPLEMENTS)(lambda g: node_columns(g.implementors("ptype_PROMO")))
query(
    "J5_get_interfaces",
    "SELECT n.id, n.name, e.pointer_receiver FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.type = 'implements' AND e.from_id = 'part_8'",
)(lambda g: g.interfaces("part_8").select("id", "name", "pointer_receiver"))
query(
    "J6_implementors_report",
    "SELECT i.name AS interface, n.id, n.name FROM edges e JOIN nodes i ON i.id = e.to_id JOIN nodes n ON n.id = e.from_id WHERE e.type = 'implements' AND e.to_id = 'ptype_SMALL'",
)(lambda g: g.node("ptype_SMALL").select(F.col("name").alias("interface")).crossJoin(g.implementors("ptype_SMALL").select("id", "name")))
query(
    "J7_resolve_placeholders",
    "+ c AS (SELECT 'func_' || package || '_' || name AS ph, arg_max(id, file || lpad(line::VARCHAR, 9, '0')) AS id FROM nodes WHERE type IN ('function', 'method') GROUP BY 1), u AS (SELECT from_id, CASE WHEN to_id LIKE 'region%' THEN 'func_region_' || (SELECT r_name FROM region WHERE 'region_' || r_regionkey = to_id) ELSE to_id END AS to_id FROM edges WHERE from_id LIKE 'nation%') SELECT u.from_id, coalesce(c.id, u.to_id) AS to_id FROM u LEFT JOIN c ON c.ph = u.to_id",
)(lambda g: _resolved(g))
_RECEIVER = "SELECT i.id, i.name FROM nodes m JOIN nodes t ON t.name = ltrim(m.receiver, '*') AND t.package = m.package AND t.type IN ('type', 'interface') JOIN edges e ON e.from_id = t.id AND e.type = 'implements' JOIN nodes i ON i.id = e.to_id WHERE m.id = 'supplier_9'"
query("J10_endpoint_semi_join", "SELECT from_id, to_id, type FROM edges WHERE from_id IN (SELECT id FROM nodes WHERE package IN ('orders', 'customer')) AND to_id IN (SELECT id FROM nodes WHERE package IN ('orders', 'customer'))")(
    lambda g: g.edges_within(g.nodes.filter(F.col("package").isin("orders", "customer"))).select("from_id", "to_id", "type")
)
query("J11_no_caller_in_package", f"SELECT {_NODE} FROM nodes n WHERE package = 'customer' AND regexp_matches(name, '^[A-Z]') AND NOT EXISTS (SELECT 1 FROM edges e JOIN nodes c ON c.id = e.from_id WHERE e.type = 'calls' AND e.to_id = n.id AND c.package = 'customer')")(
    lambda g: node_columns(analysis.patterns(g, "customer", "entrypoints"))
)
query("J12_receiver_interfaces", _RECEIVER)(lambda g: analysis.receiver_interfaces(g, "supplier_9").select("id", "name"))

# Traversals.
_REACH = "+ hops AS (SELECT '{id}' AS id, 0 AS depth UNION SELECT e.{end}, h.depth + 1 FROM hops h JOIN edges e ON e.{start} = h.id AND e.type = 'calls'), r AS (SELECT id, min(depth) AS depth FROM hops GROUP BY id) "
_BACK = _REACH.format(id="nation_3", start="to_id", end="from_id")
query("G1_reverse_reach", _BACK + "SELECT id, depth FROM r")(lambda g: analysis.callers_by_depth(g, "nation_3"))
query(
    "G2_get_impact",
    _BACK
    + f"SELECT 'nation_3' AS node_id, count(*) FILTER (WHERE depth = 1 AND name IS NOT NULL) AS direct, count(*) FILTER (WHERE depth > 1 AND name IS NOT NULL) AS indirect, count(*) FILTER (WHERE {_IS_TEST}) AS tests, count(*) AS total_reach, CASE WHEN count(*) >= 20 THEN 'high' WHEN count(*) >= 5 THEN 'medium' ELSE 'low' END AS risk_level FROM r LEFT JOIN nodes USING (id) WHERE depth > 0",
)(lambda g: analysis.impact_summary(g, "nation_3"))
query(
    "G2_impact_roles",
    _BACK
    + f"SELECT unnest(list_filter([CASE WHEN depth = 1 THEN 'direct' ELSE 'indirect' END, CASE WHEN {_IS_TEST} THEN 'test' END], lambda x: x IS NOT NULL)) AS role, {_NODE} FROM r JOIN nodes USING (id) WHERE depth > 0",
)(lambda g: analysis.impact(g, "nation_3"))
query("G3_find_tests", _BACK + f"SELECT {_NODE} FROM r JOIN nodes USING (id) WHERE depth > 0 AND {_IS_TEST}")(
    lambda g: node_columns(analysis.find_tests(g, "nation_3"))
)
query(
    "G4_trace_chain",
    "+ p AS (SELECT ['lineitem_7_1'] AS path, 'lineitem_7_1' AS id UNION ALL SELECT list_append(p.path, e.to_id), e.to_id FROM p JOIN edges e ON e.from_id = p.id AND e.type = 'calls' WHERE len(p.path) <= 10), b AS (SELECT path FROM p WHERE id = (SELECT 'region_' || n_regionkey FROM nation WHERE n_nationkey = 0) ORDER BY len(path), path LIMIT 1), s AS (SELECT unnest(path) AS id, generate_subscripts(path, 1) - 1 AS position FROM b) SELECT s.position::INT AS position, id, package, name FROM s JOIN nodes USING (id)",
)(lambda g: traverse.path_nodes(g, "lineitem_7_1", "region_0"))
_BALL = "+ both_ways AS (SELECT from_id AS a, to_id AS b FROM edges UNION ALL SELECT to_id, from_id FROM edges), ball AS (SELECT 'orders_7' AS id, 0 AS d UNION SELECT b, d + 1 FROM ball JOIN both_ways ON a = id WHERE d < 2), r AS (SELECT DISTINCT id FROM ball) "
query("G5_neighborhood_nodes", _BALL + f"SELECT {_NODE} FROM nodes WHERE id IN (FROM r)")(lambda g: node_columns(traverse.neighborhood(g, "orders_7", 2).nodes))
query("G5_neighborhood_edges", _BALL + "SELECT from_id, to_id, type FROM edges WHERE from_id IN (FROM r) OR to_id IN (FROM r)")(
    lambda g: traverse.neighborhood(g, "orders_7", 2).edges.select("from_id", "to_id", "type")
)
query(
    "G6_get_contract",
    _REACH.format(id="orders_7", start="to_id", end="from_id")
    + f"SELECT id, name, (SELECT count(*) FROM edges WHERE type = 'calls' AND to_id = 'orders_7') AS caller_count, (SELECT count(*) FROM edges WHERE type = 'calls' AND from_id = 'orders_7') AS callee_count, (SELECT count(*) FROM r JOIN nodes USING (id) WHERE depth > 0 AND {_IS_TEST}) AS n_tests, (SELECT string_agg(n.name, ',' ORDER BY n.name) FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.from_id = 'orders_7' AND e.type = 'accepts') AS accepts, (SELECT string_agg(n.name, ',' ORDER BY n.name) FROM edges e JOIN nodes n ON n.id = e.to_id WHERE e.from_id = 'orders_7' AND e.type = 'returns') AS returns FROM nodes WHERE id = 'orders_7'",
)(
    lambda g: analysis.contract(g, "orders_7").select(
        "id", "name", "caller_count", "callee_count", F.size("tests").cast("long").alias("n_tests"), F.array_join("accepts", ",").alias("accepts"), F.array_join("returns", ",").alias("returns")
    )
)
query(
    "G7_function_context",
    "SELECT id, (SELECT count(DISTINCT from_id) FROM edges WHERE type = 'calls' AND to_id = 'customer_7') AS n_callers, (SELECT string_agg(to_id, ',' ORDER BY to_id) FROM edges WHERE type = 'calls' AND from_id = 'customer_7') AS callees FROM nodes WHERE id = 'customer_7'",
)(lambda g: _context(g, "customer_7"))
query("G8_function_resource", "SELECT c.name AS caller FROM edges e JOIN nodes c ON c.id = e.from_id WHERE e.type = 'calls' AND e.to_id = 'nation_5'")(
    lambda g: g.callers("nation_5").select(F.col("name").alias("caller"))
)
query("G9_package_resource", _where(f"package = 'part' AND {_CALLABLE}"))(lambda g: node_columns(g.by(package="part").filter(names.is_callable(F.col("type")))))
query("G10_resources", "SELECT 'function' AS kind, id AS name FROM nodes WHERE type = 'function' UNION ALL SELECT DISTINCT 'package', package FROM nodes WHERE type = 'function'")(
    lambda g: g.by(type="function").select(F.lit("function").alias("kind"), F.col("id").alias("name")).union(g.by(type="function").select(F.lit("package"), "package").distinct())
)
query("G11_edges_from", "SELECT from_id, to_id, type FROM edges WHERE from_id = 'orders_11'")(lambda g: g.edges_from("orders_11").select("from_id", "to_id", "type"))

# Counts.
query("A1_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges")(
    lambda g: g.nodes.agg(F.count("*").alias("nodes")).crossJoin(g.edges.agg(F.count("*").alias("edges")))
)
query("A2_all_packages", "SELECT DISTINCT package FROM nodes")(lambda g: g.packages())
query(
    "A3_stats",
    "SELECT 'nodes' AS kind, '' AS key, count(*) AS n FROM nodes UNION ALL SELECT 'edges', '', count(*) FROM edges UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY type UNION ALL SELECT 'package', package, count(*) FROM nodes GROUP BY package",
)(lambda g: g.stats())
query(
    "A4_degrees",
    "SELECT id, sum(i)::BIGINT AS callers, sum(o)::BIGINT AS callees FROM (SELECT to_id AS id, 1 AS i, 0 AS o FROM edges WHERE type = 'calls' UNION ALL SELECT from_id, 0, 1 FROM edges WHERE type = 'calls') x GROUP BY id",
)(lambda g: g.degrees())
_CALLED, _CALLING = "id IN (SELECT to_id FROM edges WHERE type = 'calls')", "id IN (SELECT from_id FROM edges WHERE type = 'calls')"
query(
    "A5_hotspots",
    f"SELECT n.id, n.name, count(*) AS callers FROM nodes n JOIN edges e ON e.to_id = n.id AND e.type = 'calls' WHERE n.package = 'customer' AND n.{_CALLABLE} GROUP BY n.id, n.name ORDER BY callers DESC, n.name, n.id LIMIT 10",
)(lambda g: analysis.patterns(g, "customer", "hotspots").select("id", "name", "callers"))
for _name, _package, _pattern, _condition in (
    ("A6_constructors", "orders", "constructors", "type = 'function' AND regexp_matches(name, '^New[A-Z]')"),
    ("A7_error_handling", "orders", "error-handling", f"{_CALLABLE} AND (list_contains(coalesce(behaviors, []), 'error-handle') OR contains(signature, 'error'))"),
    ("A8_tests", "orders", "tests", f"{_CALLABLE} AND {_IS_TEST}"),
    ("A9_entrypoints", "nation", "entrypoints", f"{_CALLABLE} AND regexp_matches(name, '^[A-Z]') AND id NOT IN (SELECT e.to_id FROM edges e JOIN nodes c ON c.id = e.from_id WHERE e.type = 'calls' AND c.package = 'nation')"),
    ("A10_sinks", "region", "sinks", f"{_CALLABLE} AND {_CALLED} AND NOT {_CALLING}"),
    ("A11_sources", "lineitem", "sources", f"{_CALLABLE} AND {_CALLING} AND NOT {_CALLED}"),
):
    query(_name, _where(f"package = '{_package}' AND {_condition}"))(lambda g, p=_package, t=_pattern: node_columns(analysis.patterns(g, p, t)))

# Sorting, and set operations.
query("O1_sorted_by_name", f"SELECT {_NODE} FROM nodes WHERE package = 'nation' ORDER BY name, id")(lambda g: node_columns(g.by(package="nation")).orderBy("name", "id"))
query("O4_limited", f"SELECT {_NODE} FROM nodes WHERE package = 'orders' ORDER BY name, id LIMIT 25")(lambda g: node_columns(g.by(package="orders").orderBy("name", "id")).limit(25))
query("U1_distinct_edges", "SELECT DISTINCT from_id, to_id, type FROM edges WHERE type = 'calls' AND from_id LIKE 'nation%'")(
    lambda g: distinct_edges((e := g.calls().filter(F.col("from_id").like("nation%"))).unionByName(e)).select("from_id", "to_id", "type")
)
query("U2_upsert", "SELECT user_id, max_by(event_type, ts::VARCHAR || lpad(event_id::VARCHAR, 12, '0')) AS event_type FROM events GROUP BY user_id", graph=False)(
    lambda spark, sf: latest(load(spark, sf, "events"), "user_id", F.struct("ts", "event_id")).select("user_id", "event_type")
)
query("U3_delete_package", "SELECT type, count(*) AS n FROM edges WHERE from_id NOT IN (SELECT id FROM nodes WHERE package = 'customer') AND to_id NOT IN (SELECT id FROM nodes WHERE package = 'customer') GROUP BY type")(
    lambda g: g.without_package("customer").edges.groupBy("type").agg(F.count("*").alias("n"))
)
query("U4_delete_file", "SELECT type, count(*) AS n FROM edges WHERE from_id NOT IN (SELECT id FROM nodes WHERE file = 'orders.go') AND to_id NOT IN (SELECT id FROM nodes WHERE file = 'orders.go') GROUP BY type")(
    lambda g: g.without_file("orders.go").edges.groupBy("type").agg(F.count("*").alias("n"))
)
query("U6_all_edges", "SELECT from_id, to_id, type FROM edges")(lambda g: g.edges.select("from_id", "to_id", "type"))

# Vectors, and search.
_VECTORS = "WITH v AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS s, b.embedding::DOUBLE[] AS c FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 5 <> 0), q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), f AS (SELECT 'customer_' || vec_id AS node_id, s, c, q FROM v, q) "
_SCORE = "CASE WHEN c IS NOT NULL THEN 0.6 * list_cosine_similarity(s, q) + 0.4 * list_cosine_similarity(coalesce(c, s), q) ELSE list_cosine_similarity(s, q) END"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(load(spark, sf_dir, "embeddings").filter("vec_id = 7").first()["embedding"])


def _scored(spark: SparkSession, sf_dir: str, score) -> DataFrame:
    q = _query_vector(spark, sf_dir)
    return table_embeddings(spark, sf_dir).select("node_id", F.round(score(q), 6).alias("score"))


query("V1_dot_product", _VECTORS + "SELECT node_id, round(list_dot_product(s, q), 6) AS score FROM f", graph=False)(
    lambda spark, sf: _scored(spark, sf, lambda q: vectors.dot(F.col("summary_embedding"), vectors.literal(q)))
)
query("V2_l2_norm", _VECTORS + "SELECT node_id, round(sqrt(list_dot_product(s, s)), 6) AS score FROM f", graph=False)(
    lambda spark, sf: _scored(spark, sf, lambda q: F.col("summary_norm"))
)
query("V3_cosine", _VECTORS + "SELECT node_id, round(list_cosine_similarity(s, q), 6) AS score FROM f", graph=False)(
    lambda spark, sf: _scored(spark, sf, lambda q: vectors.cosine(F.col("summary_embedding"), vectors.literal(q)))
)
query("V4_weighted_score", _VECTORS + f"SELECT node_id, round({_SCORE}, 6) AS score FROM f", graph=False)(lambda spark, sf: _scored(spark, sf, vectors.weighted_score))
query("V6_vector_search", _VECTORS + f"SELECT node_id, round({_SCORE}, 6) AS score FROM f ORDER BY {_SCORE} DESC, node_id LIMIT 10", graph=False)(
    lambda spark, sf: vectors.search(table_embeddings(spark, sf), _query_vector(spark, sf), 10).select("node_id", F.round("score", 6).alias("score"))
)
query("V7_score_nodes", _VECTORS + f"SELECT node_id, round({_SCORE}, 6) AS score FROM f WHERE node_id IN (SELECT 'customer_' || c_custkey FROM customer WHERE c_nationkey = 3) ORDER BY {_SCORE} DESC, node_id LIMIT 10", graph=False)(
    lambda spark, sf: vectors.search(
        table_embeddings(spark, sf), _query_vector(spark, sf), 10, load(spark, sf, "customer").filter("c_nationkey = 3").select(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string")).alias("id"))
    ).select("node_id", F.round("score", 6).alias("score"))
)
query("V8_name_search", _where("type = 'function' AND (contains(lower(name), 'order1') OR contains(lower(package), 'order1'))") + " ORDER BY name, id LIMIT 20")(
    lambda g: node_columns(search.name_search(g, "ORDER1", 20))
)
query("V9_name_search_in_package", _where("type = 'function' AND package = 'customer' AND contains(lower(name), '0001')") + " ORDER BY name, id LIMIT 20")(
    lambda g: node_columns(search.name_search(Graph(g.by(package="customer"), g.edges), "0001", 20, with_package=False))
)
_HYDRATED = f"+ vv AS (SELECT a.vec_id, a.embedding::DOUBLE[] AS s, b.embedding::DOUBLE[] AS c FROM embeddings a LEFT JOIN embeddings b ON b.vec_id = a.vec_id + 1 AND a.vec_id % 5 <> 0), qq AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7), ff AS (SELECT 'customer_' || vec_id AS node_id, s, c, q FROM vv, qq), top AS (SELECT node_id, {_SCORE} AS score FROM ff {{where}} ORDER BY score DESC, node_id LIMIT 10) SELECT n.id, n.name, round(score, 6) AS score FROM top JOIN nodes n ON n.id = node_id"


def _found(df: DataFrame) -> DataFrame:
    return df.select("id", "name", F.round("score", 6).alias("score"))


query("V10_semantic_search", _HYDRATED.format(where=""))(lambda g: None)
QUERIES["V10_semantic_search"] = lambda spark, sf: _found(
    search.semantic_search(fk_graph(spark, sf), table_embeddings(spark, sf), "any", lambda _: _query_vector(spark, sf))
)
query("V11_package_search", _HYDRATED.format(where="WHERE node_id IN (SELECT id FROM nodes WHERE package = 'customer')"))(lambda g: None)
QUERIES["V11_package_search"] = lambda spark, sf: _found(
    search.search_functions(fk_graph(spark, sf), table_embeddings(spark, sf), "any", "customer", embed=lambda _: _query_vector(spark, sf))
)
query("V13_behavior_search", _HYDRATED.format(where="WHERE node_id IN (SELECT id FROM nodes WHERE list_has_all(coalesce(behaviors, []), ['click']))"))(lambda g: None)
QUERIES["V13_behavior_search"] = lambda spark, sf: _found(
    search.behavior_search(fk_graph(spark, sf), table_embeddings(spark, sf), ["click"], "any", embed=lambda _: _query_vector(spark, sf))
)
# Results of which some have no node: those are dropped after the limit.
_GHOSTS = "+ top AS (SELECT 'customer_' || c_custkey * 3 AS node_id, c_acctbal AS score FROM customer ORDER BY c_acctbal DESC, node_id LIMIT 40) SELECT n.id, n.name, round(score, 6) AS score FROM top JOIN nodes n ON n.id = node_id"
query("J8_hydrate", _GHOSTS)(lambda g: None)
QUERIES["J8_hydrate"] = lambda spark, sf: _found(
    search.hydrated(
        fk_graph(spark, sf),
        vectors.top_k(load(spark, sf, "customer").select(F.concat(F.lit("customer_"), (F.col("c_custkey") * 3).cast("string")).alias("node_id"), F.lit("").alias("text"), F.col("c_acctbal").alias("score")), 40),
    )
)
query("J9_candidates", _VECTORS + f"SELECT node_id, round({_SCORE}, 6) AS score FROM f WHERE node_id IN (SELECT 'customer_' || user_id FROM events WHERE event_type = 'purchase')", graph=False)(
    lambda spark, sf: table_embeddings(spark, sf)
    .join(load(spark, sf, "events").filter("event_type = 'purchase'").select(F.concat(F.lit("customer_"), F.col("user_id").cast("string")).alias("node_id")), "node_id", "left_semi")
    .select("node_id", F.round(vectors.weighted_score(_query_vector(spark, sf)), 6).alias("score"))
)

query("V5_top_k", _VECTORS + "SELECT node_id, round(sqrt(list_dot_product(s, s)), 6) AS score FROM f ORDER BY sqrt(list_dot_product(s, s)) DESC, node_id LIMIT 7", graph=False)(
    lambda spark, sf: vectors.top_k(table_embeddings(spark, sf).select("node_id", F.col("summary_norm").alias("score")), 7).select("node_id", F.round("score", 6).alias("score"))
)
query("O6_heap_top_k", "SELECT 'lineitem_' || l_orderkey || '_' || l_linenumber || '_' || l_partkey || '_' || l_suppkey AS node_id, l_extendedprice AS score FROM lineitem ORDER BY score DESC, node_id LIMIT 100", graph=False)(
    lambda spark, sf: vectors.top_k(load(spark, sf, "lineitem").select(F.concat_ws("_", F.lit("lineitem"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("node_id"), F.col("l_extendedprice").alias("score")), 100)
)
query("V12_search_functions", _where("type = 'function' AND (contains(lower(name), 'neworder2') OR contains(lower(package), 'neworder2'))") + " ORDER BY name, id LIMIT 10")(
    lambda g: node_columns(search.search_functions(g, None, "NewOrder2"))
)
query("A13_embedding_flags", _VECTORS + "SELECT node_id, s IS NOT NULL AS has_summary, c IS NOT NULL AS has_code FROM f", graph=False)(
    lambda spark, sf: table_embeddings(spark, sf).select("node_id", F.col("summary_embedding").isNotNull().alias("has_summary"), F.col("code_embedding").isNotNull().alias("has_code"))
)
query(
    "A12_discover_patterns",
    f"SELECT 'constructors' AS pattern, count(*) AS n FROM nodes WHERE package = 'orders' AND type = 'function' AND regexp_matches(name, '^New[A-Z]') UNION ALL SELECT 'tests', count(*) FROM nodes WHERE package = 'orders' AND {_CALLABLE} AND {_IS_TEST} UNION ALL SELECT 'unknown', 0",
)(lambda g: _pattern_counts(g))
query("O2_sorted_by_count", "SELECT to_id AS id, count(*) AS n FROM edges WHERE type = 'calls' GROUP BY to_id ORDER BY n DESC, id LIMIT 50")(
    lambda g: g.calls().groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(50)
)
query("O3_sorted_strings", "SELECT DISTINCT package FROM nodes ORDER BY package")(lambda g: g.packages())
query("O5_sliced_list", _where(f"{_CALLABLE} AND list_has_all(coalesce(behaviors, []), ['view'])") + " ORDER BY name, id LIMIT 15")(
    lambda g: node_columns(search.behavior_search(g, None, ["view"], limit=15))
)

# Streams: bursts of events as the debounce sees them, here over the stored table.
query(
    "T2_debounce",
    "WITH s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS k FROM (SELECT user_id, ts, event_id, event_type, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS fresh FROM events) x) SELECT user_id, min(ts) AS started, count(*) AS n, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS paths FROM s GROUP BY user_id, k",
    graph=False,
)(lambda spark, sf: _bursts(spark, sf))


def _bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = load(spark, sf_dir, "events").select("user_id", F.col("ts"), F.col("event_type").alias("path"))
    return debounced(events, "6 hours", "user_id").select("user_id", "started", "n", F.array_join("paths", ",").alias("paths"))


def _resolved(g: Graph) -> DataFrame:
    from ..operators.resolve import resolve_placeholders

    regions = g.by(package="region").select(F.col("id").alias("to_id"), names.placeholder(F.col("package"), F.col("name")).alias("_p"))
    calls = g.calls().filter(F.col("from_id").like("nation%")).join(regions, "to_id", "left")
    unresolved = calls.withColumn("to_id", F.coalesce("_p", "to_id")).drop("_p")
    return resolve_placeholders(g.nodes, unresolved).select("from_id", "to_id")


def _pattern_counts(g: Graph) -> DataFrame:
    count = lambda p, package, label: analysis.patterns(g, package, p).agg(F.count("*").alias("n")).select(F.lit(label).alias("pattern"), "n")
    return count("constructors", "orders", "constructors").union(count("tests", "orders", "tests")).union(count("sinks", "no such package", "unknown"))


def _context(g: Graph, id_: str) -> DataFrame:
    nothing = {c: F.lit(None).cast("string").alias(c) for c in ("code", "docstring")}
    nodes = g.nodes.select("*", *nothing.values(), F.lit(None).cast("struct<text: string>").alias("summary"))
    found = analysis.function_context(Graph(nodes, g.edges), id_)
    return found.select("id", F.size("callers").cast("long").alias("n_callers"), F.array_join(F.array_sort(F.transform("callees", lambda c: c["id"])), ",").alias("callees"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: all that a change to one node reaches, by depth."""
    return QUERIES["G1_reverse_reach"](spark, sf_dir)
