"""Hand-built graphs, and random ones against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import names, vectors
from sparkloom.operators import analysis, enrich, search, traverse
from sparkloom.operators.resolve import implements_edges, resolve_placeholders
from sparkloom.plans.graph import Graph, distinct_edges, latest
from sparkloom.plans.schema import EDGES, NODES, shaped
from sparkloom.streaming.changes import debounced


@pytest.fixture(scope="module")
def make(spark):
    def build(nodes, edges):
        rows = [dict({"id": n} if isinstance(n, str) else n) for n in nodes]
        for r in rows:
            r.setdefault("type", "function")
            r.setdefault("package", "pkg")
            r.setdefault("name", r["id"])
            r.setdefault("file", "a.go")
        full = [tuple(r.get(f.name) for f in NODES) for r in rows]
        e = [(a, b, t, None, i, None) for i, (a, b, t) in enumerate((x if len(x) == 3 else (*x, "calls")) for x in edges)]
        return Graph(spark.createDataFrame(full, NODES), spark.createDataFrame(e, EDGES))

    return build


def ids(df):
    return [r["id"] for r in df.select("id").collect()]


def test_chain(make):
    g = make(["a", "b", "c", {"id": "t", "name": "TestA"}], [("a", "b"), ("b", "c"), ("t", "a")])
    roles = {(r["role"], r["id"]) for r in analysis.impact(g, "c").collect()}
    assert roles == {("direct", "b"), ("indirect", "a"), ("indirect", "t"), ("test", "t")}
    assert traverse.shortest_path(g, "a", "c") == ["a", "b", "c"]
    assert traverse.shortest_path(g, "a", "c", 2) == ["a", "b", "c"] and traverse.shortest_path(g, "a", "a") == ["a"]
    with pytest.raises(traverse.NoPath):
        traverse.shortest_path(g, "a", "c", 1)
    with pytest.raises(traverse.NoPath):
        traverse.shortest_path(g, "c", "a", 0)
    with pytest.raises(traverse.NodeNotFound):
        traverse.shortest_path(g, "a", "zz")
    near = traverse.neighborhood(g, "b", 1)
    assert sorted(ids(near.nodes)) == ["a", "b", "c"] and near.edges.count() == 3
    assert ids(analysis.find_tests(g, "c")) == ["t"] and ids(analysis.find_tests(g, "t")) == []


@pytest.mark.parametrize(("n", "risk"), [(3, "low"), (10, "medium"), (20, "high")])
def test_risk(make, n, risk):
    g = make(["x", *(f"c{i}" for i in range(n))], [(f"c{i}", "x") for i in range(n)])
    assert analysis.impact_summary(g, "x").first()["risk_level"] == risk
    assert analysis.impact_summary(g, "none").first()["risk_level"] == ""


def test_random_graphs_with_cycles(make):
    draw = random.Random(4)
    for _ in range(3):
        n = 12
        edges = sorted({(f"n{draw.randrange(n)}", f"n{draw.randrange(n)}") for _ in range(20)})
        g = make([f"n{i}" for i in range(n)], edges)
        depth, frontier = {"n0": 0}, ["n0"]
        while frontier:
            frontier = sorted({b for a, b in edges if a in frontier and b not in depth})
            depth |= {b: max(depth.values()) + 1 for b in frontier}
        got = {r["id"]: r["depth"] for r in traverse.reach(traverse.calls(g), ["n0"]).collect()}
        assert got == depth
        assert {r["id"]: r["depth"] for r in traverse.reach(traverse.calls(g), ["n0"], held=1).collect()} == depth
        one = traverse.neighborhood(g, "n0", 1)
        ball = {"n0"} | {b for a, b in edges if a == "n0"} | {a for a, b in edges if b == "n0"}
        assert set(ids(one.nodes)) == ball and sorted((r["from_id"], r["to_id"]) for r in one.edges.collect()) == [e for e in edges if ball & set(e)]
        far = max(depth, key=lambda x: (depth[x], x))
        assert len(traverse.shortest_path(g, "n0", far, None)) == depth[far] + 1


def test_contract(make):
    nodes = [
        {"id": "m", "type": "method", "name": "DoSomething", "receiver": "*MyType"}, {"id": "ty", "type": "type", "name": "MyType"},
        {"id": "i", "type": "interface", "name": "MyInterface"}, "c1", "c2", "x",
    ]
    g = make(nodes, [("c1", "m"), ("c2", "m"), ("m", "x"), ("ty", "i", "implements"), ("m", "gone")])
    r = analysis.contract(g, "m").first()
    assert (r["caller_count"], r["callee_count"], r["receiver_type"], r["type_interfaces"]) == (2, 2, "MyType", ["MyInterface"])
    assert ids(g.implementors("i")) == ["ty"] and ids(g.interfaces("ty")) == ["i"]
    with pytest.raises(LookupError):
        analysis.contract(g, "none")


def test_patterns(make):
    nodes = [
        {"id": "1", "name": "NewFoo"}, {"id": "2", "name": "Newlower"}, {"id": "3", "name": "helper"}, {"id": "4", "name": "TestFoo"},
        {"id": "5", "name": "Hot"}, {"id": "6", "name": "Cold", "signature": "func Cold() error"}, {"id": "7", "name": "other", "package": "q"},
    ]
    g = make(nodes, [("3", "5"), ("4", "5"), ("1", "5"), ("3", "6"), ("7", "1"), ("5", "nowhere")])
    of = lambda p: ids(analysis.patterns(g, "pkg", p))
    assert of("constructors") == ["1"] and of("tests") == ["4"] and of("error-handling") == ["6"]
    assert of("hotspots")[:2] == ["5", "6"] and of("sinks") == ["6"] and of("sources") == ["4", "3"]
    assert of("entrypoints") == ["1", "2", "4"]
    assert analysis.patterns(g, "unknown", "tests").count() == 0
    with pytest.raises(ValueError):
        analysis.patterns(g, "pkg", "nonsense")


def test_edges_and_deletion(make):
    g = make([{"id": "1", "file": "a.go"}, {"id": "2", "file": "a.go"}, {"id": "3", "file": "b.go"}], [("1", "3"), ("3", "2")])
    assert g.without_file("a.go").nodes.count() == 1 and g.without_file("a.go").edges.count() == 0
    twice = make(["a", "b"], [("a", "b"), ("a", "b"), ("a", "b", "uses")])
    assert distinct_edges(twice.edges).count() == 2
    more = g.add(g.nodes.filter("id = '1'").withColumn("name", F.lit("new")), g.edges)
    assert more.nodes.count() == 3 and more.edges.count() == 2 and more.node("1").first()["name"] == "new"


def test_behaviors(make):
    g = make([{"id": "1", "behaviors": ["logging", "error-handle"]}, {"id": "2", "behaviors": ["http-client", "error-handle"]}, {"id": "3", "behaviors": ["database"]}, {"id": "4"}], [])
    n = lambda *t: g.with_behaviors(list(t)).count()
    assert (n("logging"), n("logging", "error-handle"), n("file-io"), n()) == (1, 1, 0, 4)


def test_ids(spark):
    cases = [("function", "func_p_f_x.go:3"), ("method", "func_p_f_x.go:3"), ("type", "type_p_f"), ("interface", "type_p_f"), ("package", "pkg_f"), ("file", "file_f"), ("odd", "node_p_f")]
    df = spark.createDataFrame([(t, "p", "f", "x.go", 3) for t, _ in cases], "type string, package string, name string, file string, line int")
    assert [r[0] for r in df.select(names.node_id(*(F.col(c) for c in df.columns))).collect()] == [w for _, w in cases]


def test_scope(make):
    g = make([{"id": "1", "package": "example.com/m/a"}, {"id": "2", "package": "example.com/m/b"}, {"id": "3", "package": "fmt"}, {"id": "4", "package": "github.com/o/l"}], [("1", "2"), ("1", "3"), ("2", "4")])
    inside = g.scoped("example.com/m")
    assert (inside.nodes.count(), inside.edges.count()) == (2, 1)
    assert g.scoped("example.com/m", True).edges.count() == g.scoped(None).edges.count() == 3


def test_implements_and_placeholders(spark, make):
    sets = spark.createDataFrame([("t1", "Read", "()", True), ("t1", "Write", "()", False), ("t2", "Read", "()", False), ("t3", None, None, None)], "type_id string, name string, signature string, pointer boolean")
    needs = spark.createDataFrame([("r", "Read", "()"), ("rw", "Read", "()"), ("rw", "Write", "()"), ("any", None, None)], "interface_id string, name string, signature string")
    got = {(r["from_id"], r["to_id"], r["pointer_receiver"]) for r in implements_edges(sets, needs).collect()}
    assert got == {("t1", "r", True), ("t2", "r", False), ("t1", "rw", True), ("t1", "any", False), ("t2", "any", False), ("t3", "any", False)}
    g = make([{"id": "x1", "name": "f", "line": 1}, {"id": "x2", "name": "f", "line": 9}], [("x1", "func_pkg_f"), ("x1", "func_fmt_Println")])
    assert {r["to_id"] for r in resolve_placeholders(g.nodes, g.edges).collect()} == {"x2", "func_fmt_Println"}


def test_vectors(spark, make):
    rows = [("f1", "one", [1.0, 0.0], [0.0, 1.0]), ("f2", "two", [0.0, 1.0], [1.0, 0.0]), ("f3", "s", [1.0, 0.0], None), ("f4", "c", None, [-1.0, 0.0]), ("f5", "none", None, None), ("f6", "long", [1.0, 0.0, 0.0], None)]
    e = vectors.with_norms(spark.createDataFrame(rows, "node_id string, summary_text string, summary_embedding array<float>, code_embedding array<float>"))
    got = [(r["node_id"], round(r["score"], 6)) for r in vectors.search(e, [1.0, 0.0], 10).collect()]
    assert got == [("f3", 1.0), ("f1", 0.6), ("f2", 0.4), ("f4", -1.0)]
    assert vectors.search(e, [1.0, 0.0], 0).count() == 0 and vectors.search(e, [0.0, 0.0], 5).count() == 0
    some = spark.createDataFrame([("f1",), ("zz",)], "id string")
    assert [r["node_id"] for r in vectors.search(e, [1.0, 0.0], 5, some).collect()] == ["f1"]
    g = make(["f1", "f2", "f3"], [])
    assert ids(search.semantic_search(g, e, "q", lambda _: [1.0, 0.0], 2)) == ["f3", "f1"]

    def broken(_):
        raise OSError

    assert ids(search.semantic_search(g, e, "F2", broken)) == ["f2"]
    assert ids(search.search_functions(g, e, "f", "pkg", 10, None)) == ["f1", "f2", "f3"]
    assert ids(search.name_search(g, "", 2)) == ["f1", "f2"] and ids(search.name_search(g, "f", 0)) == []


def test_enrichment(spark, make):
    g = make([{"id": "1", "code": "log.Print()"}, {"id": "2", "code": "boom"}, {"id": "3", "type": "type"}], [])

    def tagger(code):
        if "boom" in code:
            raise ValueError
        return ["logging", "nonsense"]

    tags = {r["id"]: r["behaviors"] for r in enrich.with_tags(g, tagger).nodes.collect()}
    assert tags == {"1": ["logging"], "2": None, "3": None}
    said = enrich.with_summaries(enrich.human_summary(g, "1", "mine", lambda: 5), lambda n, p, c: f"{n} of {p}", now=lambda: 9)
    texts = {r["id"]: r["summary"] for r in said.nodes.collect()}
    assert texts["1"]["text"] == "mine" and texts["2"]["text"] == "2 of pkg" and texts["2"]["created_at"] == 9 and texts["3"] is None


def test_bursts(spark):
    rows = [("a", 0.0), ("b", 0.3), ("a", 0.6), ("c", 2.0)]
    df = spark.createDataFrame(rows, "path string, t double").select("path", F.timestamp_millis((F.col("t") * 1000).cast("long")).alias("ts"))
    got = sorted((r["n"], r["paths"]) for r in debounced(df).collect())
    assert got == [(1, ["c"]), (3, ["a", "b"])]
    up = latest(spark.createDataFrame([("k", 1), ("k", 2)], "k string, o int"), "k", F.col("o"))
    assert up.first()["o"] == 2 and shaped(up.withColumn("id", F.lit("x")), NODES).count() == 1


def test_queries_match_their_sql(spark):
    """Every registered query of the engine against DuckDB, at the smallest scale."""
    import duckdb

    from sparkloom.plans.queries import ORACLE_SQL, QUERIES

    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql("SET threads = 4")
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in ORACLE_SQL.items():
        df = QUERIES[name](spark, sf)
        want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
        got = [tuple(r) for r in df.collect()]
        assert sorted(map(str, got)) == sorted(map(str, want)), name


def test_queries_read_the_tables_they_need(spark, sf, monkeypatch):
    """Parts of the tables' graph that a query rules out are not read; and a ball of many ids in one package, and of few in others, has the same edges."""
    from sparkloom.plans.queries import QUERIES
    from sparkloom.plans.tables import fk_graph

    read = lambda name: {f.rsplit("/", 1)[1] for f in QUERIES[name](spark, sf).inputFiles()}
    assert read("G9_package_resource") == {"supplier.parquet"} and read("A10_sinks") == {"region.parquet", "nation.parquet"}
    assert "lineitem.parquet" not in read("F17_visible_edges")
    g = fk_graph(spark, sf)
    rows = lambda: sorted(map(str, traverse.neighborhood(g, "orders_7", 2).edges.select("from_id", "to_id", "type").collect()))
    whole = rows()
    monkeypatch.setattr(traverse, "HELD", 100)
    assert rows() == whole and len(whole) > 1000
