"""A small generated module as files on disk: tree scans, the store, indexing and streams of changes as queries; with the
SQL that must give the same rows."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import enrich
from ..sources import providers
from ..sources.files import go_files, module_path, plain, scan
from ..sources.store import Store, write_text
from ..streaming.changes import changes, reindex_on_change
from .api import Server
from .generated import METHOD_LINE, MODULE, ROOT, SMALL, files, module_sql
from .index import generate_summaries, index_module, index_package, reindex_files, watcher
from .lineage import shared_folder
from .schema import BEHAVIORS, EMBEDDINGS

#: What a scan of the tree passes over.
_OTHER = {"go.mod": f"module {MODULE}\n", "vendor/x/x.go": "package x\n\nfunc X() {}\n", ".tools/y.go": "package y\n"}
_NEW = "package p0\n\nfunc Added() { New0(1) }\n"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(name: str, sql: str):
    def keep(f):
        QUERIES[name] = f
        ORACLE_SQL[name] = f"WITH {module_sql(SMALL)} {sql}"
        return f

    return keep


def _tree(spark: SparkSession, sf_dir: str) -> str:
    """A new folder with the module's files, a file a nation."""
    root = f"{shared_folder(spark)}/module-{uuid.uuid4().hex[:12]}"
    for path, content in files(spark, sf_dir, SMALL).collect():
        write_text(spark, root + path.removeprefix(ROOT), content)
    for name, content in _OTHER.items():
        write_text(spark, f"{root}/{name}", content)
    return root


def _store(spark: SparkSession) -> Store:
    return Store(spark, f"{shared_folder(spark)}/store-{uuid.uuid4().hex[:12]}")


def _indexed(spark: SparkSession, sf_dir: str) -> tuple[str, Store]:
    root, store = _tree(spark, sf_dir), _store(spark)
    index_module(spark, root, store, tagger=providers.mock_tags, embed=providers.mock_embedding)
    return root, store


_read_only: dict[tuple[str, str], tuple[str, Store]] = {}


def _shared(spark: SparkSession, sf_dir: str) -> tuple[str, Store]:
    """An indexed tree that several queries read and none changes, once an application."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _read_only:
        _read_only[key] = _indexed(spark, sf_dir)
    return _read_only[key]


def _names(store: Store) -> DataFrame:
    return store.load_graph().nodes.select("type", "package", "name", F.element_at(F.split("file", "/"), -1).alias("file"))


_NAMES = "SELECT type, package, name, string_split(file, '/')[-1] AS file FROM gnodes"
_ADDED = f"SELECT 'function' AS type, '{MODULE}/p0' AS package, 'Added' AS name"


def _below(root: str, column: str = "path") -> Column:
    """A path, or an id with one, below the folder that the SQL has, instead of the one that each run has anew."""
    return F.replace(F.col(column), F.lit(f"{plain(root)}/"), F.lit(f"{ROOT}/")).alias(column)


_query("S3_module_scan_tree", "SELECT type, package, name FROM gnodes")(lambda s, sf: scan(s, _tree(s, sf)).nodes.select("type", "package", "name"))
_query("S17_module_path", f"SELECT '{MODULE}' AS module")(lambda s, sf: s.createDataFrame([(module_path(s, _tree(s, sf)),)], "module string"))


@_query("S18_tree_filter", "SELECT file AS path FROM c")
def _walk(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = _tree(spark, sf_dir)
    return go_files(spark, root).select(_below(root))


@_query("S15_vector_scan", "SELECT name || ' ' || signature AS summary_text, 1.0::DOUBLE AS summary_norm, 1.0::DOUBLE AS code_norm FROM gnodes WHERE type = 'function'")
def _vector_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shared(spark, sf_dir)[1].load_embeddings().select("summary_text", F.round("summary_norm", 6).alias("summary_norm"), F.round("code_norm", 6).alias("code_norm"))


@_query("K5_schema_rebuild", "SELECT 'older' AS schema, false AS ready, 0::BIGINT AS nodes UNION ALL SELECT 'rebuilt', true, count(*) FROM gnodes")
def _schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store of an older schema is as if empty, until it is written again."""
    root, store = _indexed(spark, sf_dir)
    write_text(spark, f"{store.path}/current-graph.json", '{"schema": 0, "version": "old"}')
    rows = [("older", store.ready(), store.load_graph().nodes.count())]
    index_module(spark, root, store)
    rows.append(("rebuilt", store.ready(), store.load_graph().nodes.count()))
    return spark.createDataFrame(rows, "schema string, ready boolean, nodes long")


@_query(
    "K7_endpoints",
    "SELECT 'graph' AS endpoint, (SELECT count(*) FROM gnodes) AS n, (SELECT count(*) FROM gedges) AS m UNION ALL SELECT 'packages', count(DISTINCT package), 0 FROM gnodes "
    f"UNION ALL SELECT 'package', count(*), max(line) FROM gnodes WHERE package = '{MODULE}/p0' UNION ALL SELECT 'node', line, 0 FROM gnodes WHERE name = 'Use7' "
    "UNION ALL SELECT 'search', count(*), min(line) FROM gnodes WHERE name = 'Size' UNION ALL SELECT 'stats', (SELECT count(*) FROM gnodes WHERE type = 'interface'), (SELECT count(*) FROM gedges)",
)
def _endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each endpoint's JSON says, as two numbers."""
    root, store = _shared(spark, sf_dir)
    server = Server(spark, store, root, providers.mock_embedding)
    id_ = store.load_graph().by(name="Use7").first()["id"]
    calls = {
        "graph": (server.graph_json, lambda x: (len(x["nodes"]), len(x["edges"]))),
        "packages": (server.packages_json, lambda x: (len(x), 0)),
        "package": (partial(server.package_nodes_json, f"{MODULE}/p0"), lambda x: (len(x), max(r["line"] for r in x))),
        "node": (partial(server.node_json, id_), lambda x: (x["line"], 0)),
        "search": (partial(server.exact_search_json, "Size"), lambda x: (len(x), min(r["line"] for r in x))),
        "stats": (server.stats_json, lambda x: (x["by_type"]["interface"], x["edges"])),
    }
    return spark.createDataFrame([(name, *count(json.loads(f()))) for name, (f, count) in calls.items()], "endpoint string, n long, m long")


@_query(
    "G8_function_resource_json",
    "SELECT 'New6' AS name, n.line, (SELECT string_agg(coalesce(x.name, ''), ',' ORDER BY x.name) FROM gcalls e JOIN gnodes x ON x.id = e.from_id WHERE e.to_id = n.id) AS callers, (SELECT string_agg(x.name, ',' ORDER BY x.name) FROM gcalls e JOIN gnodes x ON x.id = e.to_id WHERE e.from_id = n.id) AS callees FROM gnodes n WHERE n.name = 'New6'",
)
def _resource(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, store = _shared(spark, sf_dir)
    said = json.loads(Server(spark, store, root).resource(f"function://{MODULE}/p1/New6"))
    return spark.createDataFrame([(said["name"], said["line"], ",".join(said["callers"]), ",".join(said["callees"]))], "name string, line int, callers string, callees string")


def _answer(url: str, key: str, body: dict, timeout: float) -> dict:
    """Stands for the API: embeddings in any order, or one choice of chat."""
    if url.endswith("/embeddings"):
        return {"data": [{"index": i, "embedding": v} for i, v in reversed(list(enumerate(providers.mock_embedding(body["input"], 8))))]}
    return {"choices": [{"message": {"content": ' So: {"behaviors": ["logging", "unheard-of"]}. '}}]}


def _graph(spark: SparkSession, sf_dir: str):
    return scan(spark, _tree(spark, sf_dir))


@_query("K8_embedding_api", "SELECT name || ' ' || signature AS summary_text, 8::INT AS size FROM gnodes WHERE type = 'function'")
def _embedding_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    embed = providers.embedding_client("http://localhost", "key", "model", post=_answer)
    rows = enrich.missing_embeddings(_graph(spark, sf_dir), spark.createDataFrame([], EMBEDDINGS), embed)
    return rows.select("summary_text", F.size("summary_embedding").alias("size"))


@_query("K9_chat_api", """SELECT name, 'So: {"behaviors": ["logging", "unheard-of"]}.' AS summary FROM gnodes WHERE type = 'function'""")
def _chat_api(spark: SparkSession, sf_dir: str) -> DataFrame:
    ask = providers.chat_client("http://localhost", "key", "model", post=_answer)
    made = enrich.with_summaries(_graph(spark, sf_dir), lambda name, package, code: ask(providers.prompt(name, package, code=code)), now=lambda: 0)
    return made.nodes.filter("type = 'function'").select("name", F.col("summary.text").alias("summary"))


_CALLABLE = "type IN ('function', 'method')"
_query("E1_mock_tagger", f"SELECT name, CASE WHEN {_CALLABLE} THEN CASE WHEN contains(lower(coalesce(code, signature)), 'log.') THEN 'logging' WHEN contains(coalesce(code, signature), 'error') THEN 'error-handle' ELSE '' END END AS behaviors FROM gnodes")(
    lambda s, sf: enrich.with_tags(_graph(s, sf), providers.mock_tags).nodes.select("name", F.array_join("behaviors", ",").alias("behaviors"))
)


@_query("E2_chat_tagger", f"SELECT name, CASE WHEN {_CALLABLE} THEN 'logging' END AS behaviors FROM gnodes")
def _chat_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagger = providers.chat_tagger(providers.chat_client("http://localhost", "key", "model", post=_answer), tuple(BEHAVIORS))
    return enrich.with_tags(_graph(spark, sf_dir), tagger).nodes.select("name", F.array_join("behaviors", ",").alias("behaviors"))


@_query(
    "E4_human_summaries_stay",
    "SELECT name, CASE WHEN name = 'Use7' THEN 'by hand' ELSE 'Function ' || name || ' in package ' || package END AS summary, CASE WHEN name = 'Use7' THEN 'human' ELSE 'llm' END AS written_by FROM gnodes WHERE type = 'function'",
)
def _stay(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _graph(spark, sf_dir)
    g = enrich.human_summary(g, g.by(name="Use7").first()["id"], "by hand", lambda: 0)
    return enrich.with_summaries(g, providers.mock_summary, now=lambda: 0).nodes.filter("type = 'function'").select("name", F.col("summary.text").alias("summary"), F.col("summary.generated_by").alias("written_by"))


@_query("E6_generate", "SELECT count(*) AS embedded, 0::BIGINT AS summaries_before, count(*) AS summaries_after FROM gnodes WHERE type = 'function'")
def _generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, store = _tree(spark, sf_dir), _store(spark)
    index_module(spark, root, store)
    generate_summaries(store, providers.mock_summary, providers.mock_embedding)
    before = store.load_graph().nodes.filter("summary.text IS NOT NULL").count()
    generate_summaries(store, providers.mock_summary)
    after = store.load_graph().nodes.filter("summary.text IS NOT NULL").count()
    return spark.createDataFrame([(store.load_embeddings().count(), before, after)], "embedded long, summaries_before long, summaries_after long")


_query("E8_reindex_project", "SELECT 'Indexed ' || (SELECT count(*) FROM gnodes) || ' nodes and ' || (SELECT count(*) FROM gedges) || ' edges' AS said")(
    lambda s, sf: s.createDataFrame([(Server(s, _store(s), _tree(s, sf)).reindex_project(),)], "said string")
)


@_query("E9_providers", "SELECT kind, provider, provider = 'openai' AS configured FROM (VALUES ('embedding'), ('llm')) k(kind), (VALUES (''), ('none'), ('openai')) p(provider)")
def _configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = [(k, p, providers.from_environment(k, {f"{k.upper()}_PROVIDER": p}) is not None) for k in ("embedding", "llm") for p in ("", "none", "openai")]
    return spark.createDataFrame(kinds, "kind string, provider string, configured boolean")


def _local(spark: SparkSession, sf_dir: str) -> str:
    return plain(_tree(spark, sf_dir))


@_query("T1_file_changes", f"SELECT file AS path, 'created' AS event FROM c UNION ALL SELECT '{ROOT}/p0/new.go', 'created' UNION ALL SELECT '{ROOT}/p0/c4.go', 'deleted'")
def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tree as first polled, then a new and a deleted file. The poll is the driver's, of its own file system."""
    root, name = _local(spark, sf_dir), f"changes_{uuid.uuid4().hex[:12]}"
    q = changes(spark, root).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{root}.checkpoint").start()
    try:
        q.processAllAvailable()
        write_text(spark, f"{root}/p0/new.go", _NEW)
        os.remove(f"{root}/p0/c4.go")
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.table(name).select(_below(root), "event")


@_query("T3_coalesced_batches", "SELECT count(*) + 3 AS changed, 0::BIGINT AS deleted FROM c")
def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each call of the re-indexing gets: all that changed since the call before, and nothing is lost."""
    root, seen = _local(spark, sf_dir), []
    q = reindex_on_change(changes(spark, root), lambda a, b: seen.append((len(seen), len(a), len(b))), f"{root}.checkpoint", "0 seconds")
    try:
        q.processAllAvailable()
        for k in range(3):
            write_text(spark, f"{root}/p0/new{k}.go", _NEW.replace("Added", f"Added{k}"))
        q.processAllAvailable()
    finally:
        q.stop()
    return spark.createDataFrame(seen, "batch long, changed long, deleted long").agg(F.sum("changed").alias("changed"), F.sum("deleted").alias("deleted"))


@_query("T4_reindex_batch", f"{_NAMES} WHERE file NOT LIKE '%/c4.go' UNION ALL {_ADDED}, 'new.go'")
def _reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored graph after a file came and one went, both found by the stream."""
    root, store = _local(spark, sf_dir), _store(spark)
    index_module(spark, root, store)
    write_text(spark, f"{root}/p0/new.go", _NEW)
    q = reindex_on_change(changes(spark, root), watcher(spark, root, store), f"{root}.checkpoint", "0 seconds")
    try:
        q.processAllAvailable()
        os.remove(f"{root}/p0/c4.go")
        q.processAllAvailable()
    finally:
        q.stop()
    return _names(store)


@_query(
    "T5_index_file",
    f"SELECT from_id, to_id, type FROM gedges WHERE from_id NOT LIKE '%/c4.go:%' AND from_id NOT LIKE '%_T4' AND to_id NOT LIKE '%_T4' AND to_id NOT LIKE '%_I4' AND to_id NOT LIKE '%/c4.go:%' "
    f"UNION ALL SELECT use_id, 'func_{MODULE}/p0_M0_{ROOT}/p0/c3.go:' || {METHOD_LINE}, 'calls' FROM c WHERE g = 0 AND k < 4 UNION ALL SELECT 'func_{MODULE}/p0_Added_{ROOT}/p0/c4.go:3', new_id, 'calls' FROM c WHERE k = 0",
)
def _index_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges after one file was replaced: those from and to what it had are gone, and calls by name find what there is."""
    root, store = _indexed(spark, sf_dir)
    write_text(spark, f"{root}/p0/c4.go", _NEW)
    reindex_files(spark, root, store, [f"{plain(root)}/p0/c4.go"], [])
    return store.load_graph().edges.select(_below(root, "from_id"), _below(root, "to_id"), "type")


@_query("T6_index_package", f"SELECT from_id, to_id FROM gcalls WHERE from_id IN (SELECT id FROM gnodes WHERE package IN ('{MODULE}/p0', '{MODULE}/p1'))")
def _index_package(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One package added to an empty store, then the next, then the one that it calls: the calls between them are found."""
    root, store = _tree(spark, sf_dir), _store(spark)
    for package in ("p0", "p1", "p2"):
        index_package(spark, root, package, store)
    own = store.load_graph().nodes.filter(F.col("package").isin(f"{MODULE}/p0", f"{MODULE}/p1")).select(F.col("id").alias("from_id"))
    return store.load_graph().calls().join(own, "from_id", "left_semi").select(_below(root, "from_id"), _below(root, "to_id"))


_query("T7_index_module", _NAMES)(lambda s, sf: _names(_shared(s, sf)[1]))


@_query("T8_ready", "SELECT 'before' AS moment, false AS ready UNION ALL SELECT 'after', true")
def _ready(spark: SparkSession, sf_dir: str) -> DataFrame:
    root, store = _tree(spark, sf_dir), _store(spark)
    before = store.ready()
    index_module(spark, root, store)
    return spark.createDataFrame([("before", before), ("after", store.ready())], "moment string, ready boolean")
