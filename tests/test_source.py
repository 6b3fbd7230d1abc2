from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from sparkloom.plans.api import Server
from sparkloom.plans.index import index_module, index_package, reindex_files
from sparkloom.sources.files import scan
from sparkloom.sources.gosource import parse
from sparkloom.sources.providers import chat_client, chat_tagger, embedding_client, from_environment, mock_embedding, mock_tags, tags_in
from sparkloom.sources.store import Store, write_text
from sparkloom.streaming.changes import changes, reindex_on_change

STORE = '''// Package store keeps things.
package store

import "fmt"

// Adder adds.
type Adder interface {
	Add(key string, n int) error
	Close()
}

type Empty interface{}

// Store is one.
type Store struct {
	items map[string]int
}

// New makes a store.
// It is empty.
func New(size int) *Store {
	return &Store{items: make(map[string]int, size)}
}

func (s *Store) Add(key string, n int) error {
	text := "a { brace"
	fmt.Println(text) // and } one here
	return nil
}

func (s Store) Close() {}

func helper(a, b int, rest ...string) (int, error) { return a + b, nil }
'''
APP = '''package app

import (
	st "example.com/mod/store"
)

func Run(names []string) error {
	s := &st.Store{}
	f := func() { helper() }
	f()
	return s.Add("x", 1)
}

func helper() { st.New(3) }

func Open(cfg map[string]*st.Store) st.Adder { return nil }
'''


@pytest.fixture()
def module(tmp_path):
    for name, content in {"go.mod": "module example.com/mod\n", "store/store.go": STORE, "app/app.go": APP, "vendor/x/x.go": "package x\nfunc X() {}\n", ".git/y.go": "package y\nfunc Y() {}\n", "bad/bad.go": "func oops("}.items():
        p = tmp_path / "mod" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content)
    return str(tmp_path / "mod")


def test_parse():
    s = parse(STORE)
    assert [f["name"] for f in s.functions] == ["New", "Add", "Close", "helper"]
    new, add, close, helper = s.functions
    assert new["docstring"] == "New makes a store.\nIt is empty."
    assert new["code"].startswith("func New") and new["code"].endswith("}")
    assert add["receiver"] == "*Store" and close["receiver"] == "Store"
    assert helper["signature"] == "func helper(a b int, rest ...string) (int, error)"
    assert {(c["package"], c["name"]) for c in add["calls"]} == {("fmt", "Println")}
    assert [t["kind"] for t in s.types] == ["interface", "interface", "struct"]
    assert [m["name"] for m in s.types[0]["methods"]] == ["Add", "Close"]
    with pytest.raises(ValueError):
        parse("func x() {}")


def test_scan(spark, module):
    g = scan(spark, module)
    nodes = {r["name"]: r for r in g.nodes.collect()}
    assert "X" not in nodes and "Y" not in nodes
    assert nodes["Store"]["id"] == "type_example.com/mod/store_Store"
    assert nodes["Add"]["type"] == "method" and nodes["Add"]["code"] is None
    edges = {(r["from_id"], r["to_id"], r["type"]): r for r in g.edges.collect()}
    run, add = nodes["Run"]["id"], nodes["Add"]["id"]
    assert (run, add, "calls") in edges
    implements = ("type_example.com/mod/store_Store", "type_example.com/mod/store_Adder", "implements")
    assert edges[implements]["pointer_receiver"] is True
    assert ("type_example.com/mod/store_Store", "type_example.com/mod/store_Empty", "implements") in edges
    assert (nodes["Open"]["id"], "type_example.com/mod/store_Store", "accepts") in edges
    assert (nodes["Open"]["id"], "type_example.com/mod/store_Adder", "returns") in edges
    assert (nodes["New"]["id"], "type_example.com/mod/store_Store", "returns") in edges


def test_index_serve_and_reindex(spark, module, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    assert not store.ready() and store.load_graph().nodes.count() == 0
    n, m = index_module(spark, module, store, tagger=mock_tags, embed=mock_embedding)
    assert store.ready() and n >= 9 and m >= 6
    assert store.load_embeddings().count() == store.load_graph().by(type="function").count()
    api = Server(spark, store, module, mock_embedding)
    run = json.loads(api.get_function_by_name("Run"))[0]["id"]
    add = json.loads(api.get_function_by_name("Add"))[0]["id"]
    assert [r["id"] for r in json.loads(api.get_callers(add))] == [run]
    assert json.loads(api.trace_chain(run, add))["path_length"] == 2
    assert json.loads(api.get_impact(add))["direct_callers"][0]["id"] == run
    assert json.loads(api.get_contract(add))["type_interfaces"] == ["Adder", "Empty"]
    assert json.loads(api.get_function_context(run))["code"].startswith("func Run")
    assert json.loads(api.get_implementors("type_example.com/mod/store_Adder"))["implementors"][0]["kind"] == "struct"
    assert json.loads(api.discover_patterns("example.com/mod/store", "hotspots"))["count"] >= 1
    assert json.loads(api.search_functions("Run"))
    assert any(r["name"] == "helper" for r in json.loads(api.resource("package://example.com/mod/app")))
    assert json.loads(api.resource("function://example.com/mod/app/Run"))["callees"] == ["Add", "helper"]  # a closure's calls are its function's
    api.update_summary(run, "by hand")
    stats = json.loads(api.stats_json())
    assert stats["nodes"] == n and stats["by_type"]["interface"] == 2
    # a file changes and one goes: moved functions keep what people wrote, and edges follow
    open(f"{module}/app/app.go", "w").write("// moved\n\n" + APP)
    reindex_files(spark, module, store, [f"{module}/app/app.go"], [])
    moved = store.load_graph().by(name="Run").collect()[0]
    assert moved["id"] != run and moved["summary"]["text"] == "by hand"
    assert [r["name"] for r in store.load_graph().callers(add).collect()] == ["Run"]
    os.remove(f"{module}/store/store.go")
    reindex_files(spark, module, store, [], [f"{module}/store/store.go"])
    assert store.load_graph().by(package="example.com/mod/store").count() == 0
    with pytest.raises(LookupError):
        api.get_contract("nothing")


def test_watch(spark, module, tmp_path):
    seen = []
    q = reindex_on_change(changes(spark, module), lambda a, b: seen.append((a, b)), str(tmp_path / "ck"))
    try:
        deadline = time.time() + 40
        while not seen and time.time() < deadline:
            time.sleep(0.2)
        os.remove(f"{module}/app/app.go")
        while not any(b for _, b in seen) and time.time() < deadline:
            time.sleep(0.2)
    finally:
        q.stop()
    assert any(f"{module}/store/store.go" in a for a, _ in seen)
    assert any(f"{module}/app/app.go" in b for _, b in seen)


def test_store_embeddings(spark, tmp_path):
    store = Store(spark, str(tmp_path / "db"))
    row = lambda i, t, v: (i, t, "", v, None)
    ddl = "node_id string, summary_text string, code_text string, summary_embedding array<float>, code_embedding array<float>"
    store.upsert_embeddings(spark.createDataFrame([row("a", "old", [3.0, 4.0]), row("b", "b", [1.0, 0.0])], ddl))
    store.upsert_embeddings(spark.createDataFrame([row("a", "new", [6.0, 8.0])], ddl))
    got = {r["node_id"]: r for r in store.load_embeddings().collect()}
    assert got["a"]["summary_text"] == "new" and got["a"]["summary_norm"] == 10.0 and got["a"]["code_norm"] is None
    store.delete_embeddings(spark.createDataFrame([("a",), ("zz",)], "node_id string"))
    assert [r["node_id"] for r in store.load_embeddings().collect()] == ["b"]


def test_pointer_is_replaced(spark, tmp_path):
    at = f"file://{tmp_path}/deep/pointer.json"
    for text in ("one", "two é"):
        write_text(spark, at, text)
        assert (tmp_path / "deep" / "pointer.json").read_text() == text
    assert not [p for p in os.listdir(tmp_path / "deep") if p.startswith(".pointer.json.") and not p.endswith(".crc")]


def test_index_package(spark, module, tmp_path):
    """Adds a folder's declarations, of that folder only, and calls find what was added before or after."""
    store = Store(spark, str(tmp_path / "db"))
    index_package(spark, module, "app", store)
    assert {r["package"] for r in store.load_graph().nodes.collect()} == {"example.com/mod/app"}
    index_package(spark, f"file://{module}", "store", store)
    index_package(spark, module, "store", store)
    g = store.load_graph()
    assert g.nodes.count() == g.nodes.select("id").distinct().count() == 10
    add = g.by(name="Add").first()["id"]
    assert [r["name"] for r in g.callers(add).collect()] == ["Run"]
    index_package(spark, module, "none", store)
    assert store.load_graph().nodes.count() == 10


def test_providers():
    tagger = chat_tagger(lambda text: f'{{"behaviors": ["logging", 1, "x"]}} {len(text)}', ("logging",))
    assert tagger("code") == ["logging"] and chat_tagger(lambda text: "{", ("logging",))("") == []
    assert tags_in('so: {"behaviors": ["logging", "nonsense"]} end', ("logging",)) == ["logging"]
    assert tags_in("nothing", ("logging",)) == []
    post = lambda url, key, body, timeout: {"data": [{"index": 1, "embedding": [2.0]}, {"index": 0, "embedding": [1.0]}]}
    assert embedding_client("http://x/", "k", "m", post=post)(["a", "b"]) == [[1.0], [2.0]]
    with pytest.raises(ValueError):
        embedding_client("http://x", "k", "m", post=post)(["a"])
    assert chat_client("http://x", "k", "m", post=lambda *a: {"choices": [{"message": {"content": " hi "}}]})("q") == "hi"
    assert from_environment("embedding", {}) is None
    assert callable(from_environment("embedding", {"EMBEDDING_PROVIDER": "openai"}))


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "nation"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def same(con, df, sql):
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
    return sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want)) and bool(want)


def test_sample_queries(spark):
    """Scans, stores and enrichment of a module that is generated from a table, against SQL over that table."""
    from sparkloom.plans.sample import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    assert QUERIES.keys() == ORACLE_SQL.keys()
    for name, query in QUERIES.items():
        assert same(con, query(spark, sf), ORACLE_SQL[name]), name


def test_sample_tree_queries(spark):
    """Some of those over a tree on disk, indexing and change streams among them; the driver compares all."""
    from sparkloom.plans.sample_tree import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duck(sf)
    assert QUERIES.keys() == ORACLE_SQL.keys()
    for name in ("S18_tree_filter", "E4_human_summaries_stay", "K7_endpoints", "G8_function_resource_json", "T1_file_changes", "T5_index_file"):
        assert same(con, QUERIES[name](spark, sf), ORACLE_SQL[name]), name


def test_embedding_chains_of_any_depth(spark):
    """Types that embed each other in a chain of five, and two that embed pointers to each other."""
    from sparkloom.sources.files import parsed, type_relations

    chain = "".join(f"type T{k} struct {{\n\tT{k - 1}\n}}\n\n" for k in range(1, 6))
    text = "package p\n\ntype T0 struct{}\n\nfunc (t T0) Go() {}\n\n" + chain + "type A struct {\n\t*B\n}\n\ntype B struct {\n\t*A\n}\n\nfunc (b *B) Go() {}\n\ntype Goer interface {\n\tGo()\n}\n"
    rows = parsed(spark.createDataFrame([("/m/a.go", text)], "path string, content string"), "m", "/m")
    got = {(r["from_id"], r["pointer_receiver"]) for r in type_relations(rows).filter("type = 'implements'").collect()}
    assert got == {(f"type_m_T{k}", False) for k in range(6)} | {("type_m_A", True), ("type_m_B", True)}


def test_searches_ensure_vectors(spark, module, tmp_path):
    """A package or behaviour search embeds what lacks vectors first, with a summary where there is none; if the
    query can't be embedded, names are listed."""
    store = Store(spark, str(tmp_path / "db"))
    index_module(spark, module, store, tagger=mock_tags)
    assert store.load_embeddings().count() == 0
    api = Server(spark, store, module, mock_embedding, lambda name, package, code: f"about {name}")
    assert json.loads(api.search_functions("about Run", package="example.com/mod/app"))[0]["name"] == "Run"
    assert {r["summary_text"] for r in store.load_embeddings().collect()} >= {"about Run", "about helper"}

    def broken(texts):
        raise OSError

    assert json.loads(Server(spark, store, module, broken).search_by_behavior([], "anything"))


def test_a_file_scan_is_dealt_and_makes_no_graph(spark, sf):
    """A table of one part is parsed by all tasks, and a query over files alone writes neither nodes nor edges."""
    from sparkloom.plans import generated, sample

    spread = generated.files(spark, sf).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == spark.sparkContext.defaultParallelism and max(r["count"] for r in spread) <= 2 * min(r["count"] for r in spread)
    generated._read.clear()
    assert sample.QUERIES["S1_file_scan"](spark, sf).count() == 150
    assert not generated.scanned(spark, sf).__dict__.keys() & {"rows", "nodes", "edges"}
    sample.QUERIES["E10_prompts"](spark, sf)
    assert "edges" not in generated.scanned(spark, sf).__dict__


def test_lines_of_tokens():
    """Tokens' lines and places over space of any kind, comments and texts of several lines."""
    from sparkloom.sources.gosource import tokens

    text = "a \n\n\tb/* x\n y */c `r\ns`\x0b d // e\n\n'f' \n\n"
    got, comments = tokens(text)
    assert [(t.text, t.line) for t in got] == [("a", 1), ("b", 3), ("c", 4), ("`r\ns`", 4), ("d", 5), ("'f'", 7)]
    assert all(text.startswith(t.text, t.at) for t in got) and comments == {4: [(3, "/* x\n y */")], 5: [(5, "// e")]}
