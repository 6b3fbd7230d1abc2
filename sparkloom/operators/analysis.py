"""Reports on the call graph: impact, tests, contracts, contexts and patterns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import bare_receiver, is_callable, is_constructor, is_exported, is_test
from ..plans.graph import Graph
from ..plans.schema import PATTERNS
from .traverse import NodeNotFound, calls, reach

HOTSPOTS = 10


def compact(*more: str) -> list:
    return ["id", "name", "package", "signature", *more]


def callers_by_depth(graph: Graph, id_: str) -> DataFrame:
    """id, depth of whatever calls the node, itself at 0."""
    return reach(calls(graph, backward=True), [id_])


def impact(graph: Graph, id_: str) -> DataFrame:
    """role (direct, indirect, test or interface), and the node. Tests are in their other role too."""
    found = callers_by_depth(graph, id_).filter("depth > 0").join(graph.nodes, "id")
    role = F.array(
        F.when(F.col("depth") == 1, "direct").otherwise("indirect"), F.when(is_test(F.col("name"), F.col("file")), "test")
    )
    rows = found.select(F.explode(F.array_compact(role)).alias("role"), *compact())
    return rows.unionByName(graph.implementors(id_).select(F.lit("interface").alias("role"), *compact()))


def impact_summary(graph: Graph, id_: str) -> DataFrame:
    """One row: node_id, direct, indirect, tests, total_reach (ids without a node too), risk_level ('' if there
    is no such node)."""
    seen = callers_by_depth(graph, id_).filter("depth > 0")
    known = seen.join(graph.nodes, "id", "left")
    test = is_test(F.col("name"), F.col("file"))
    there = graph.node(id_).agg(F.count("*").alias("there"))
    count = lambda c: F.count(F.when(c, 1))
    totals = known.agg(
        count((F.col("depth") == 1) & F.col("name").isNotNull()).alias("direct"),
        count((F.col("depth") > 1) & F.col("name").isNotNull()).alias("indirect"),
        count(test).alias("tests"),
        F.count("*").alias("total_reach"),
    )
    risk = F.when(F.col("there") == 0, "").when(F.col("total_reach") >= 20, "high").when(F.col("total_reach") >= 5, "medium").otherwise("low")
    return totals.crossJoin(there).select(F.lit(id_).alias("node_id"), "direct", "indirect", "tests", "total_reach", risk.alias("risk_level"))


def find_tests(graph: Graph, id_: str) -> DataFrame:
    """Tests that reach the node by calls, itself not among them."""
    found = graph.nodes.join(callers_by_depth(graph, id_).filter("depth > 0"), "id", "left_semi")
    return found.filter(is_test(F.col("name"), F.col("file"))).orderBy("name", "id")


def receiver_interfaces(graph: Graph, id_: str) -> DataFrame:
    """Interfaces of the type that a method belongs to."""
    method = graph.node(id_).select(bare_receiver(F.col("receiver")).alias("_r"), F.col("package").alias("_p")).filter("_r IS NOT NULL")
    types = graph.nodes.filter(F.col("type").isin("type", "interface")).select(F.col("id").alias("_t"), "name", "package")
    owner = types.join(method, (F.col("name") == F.col("_r")) & (F.col("package") == F.col("_p")), "left_semi")
    found = graph.links().filter("type = 'implements'").join(owner, F.col("from_id") == F.col("_t"), "left_semi")
    return graph.among(found.select(F.col("to_id").alias("id")))


def _around(graph: Graph, id_: str) -> DataFrame:
    """The edges that touch a node, and the nodes at their other ends (null where there is none): out (whether the
    edge leaves it), edge, and the node. Two filtered reads and one join."""
    out = graph.edges_from(id_).select(F.lit(True).alias("out"), F.col("type").alias("edge"), F.col("to_id").alias("end"))
    in_ = graph.into.filter((F.col("to_id") == id_) & (F.col("type") == "calls")).select(F.lit(False), "type", "from_id")
    return out.union(in_).join(graph.nodes, F.col("end") == F.col("id"), "left")


def _contract(graph: Graph, id_: str, *more) -> DataFrame:
    node = graph.node(id_)
    if node.isEmpty():
        raise NodeNotFound(id_)
    calls_, there = F.col("edge") == "calls", F.col("id").isNotNull()
    listed = lambda of, name: F.sort_array(F.collect_list(F.when(F.col("out") & (F.col("edge") == of) & there, F.col("name")))).alias(name)
    sums = _around(graph, id_).agg(
        F.count_if(~F.col("out") & calls_).alias("caller_count"), F.count_if(F.col("out") & calls_).alias("callee_count"),
        listed("accepts", "accepts"), listed("returns", "returns"), *more,
    )
    names = lambda df, name: df.agg(F.sort_array(F.collect_list("name")).alias(name))
    out = node.select("id", "name", "package", "signature", bare_receiver(F.col("receiver")).alias("receiver_type")).crossJoin(sums)
    return out.crossJoin(names(receiver_interfaces(graph, id_), "type_interfaces")).crossJoin(names(find_tests(graph, id_), "tests"))


_CONTRACT = ("id", "name", "package", "signature", "receiver_type", "caller_count", "callee_count", "type_interfaces", "accepts", "returns", "tests")


def contract(graph: Graph, id_: str) -> DataFrame:
    """One row: what is known of a function to those who use it. Raises NodeNotFound."""
    return _contract(graph, id_).select(*_CONTRACT)


def function_context(graph: Graph, id_: str) -> DataFrame:
    """One row: the contract, the code, and callers and callees as compact entries."""
    entry = F.struct(*compact(), F.col("summary.text").alias("summary"))
    calls_ = (F.col("edge") == "calls") & F.col("id").isNotNull()
    callers = F.sort_array(F.collect_set(F.when(~F.col("out") & calls_, entry))).alias("callers")
    callees = F.sort_array(F.collect_set(F.when(F.col("out") & calls_, entry))).alias("callees")
    more = graph.node(id_).select("id", "code", "docstring", "file", "line")
    return _contract(graph, id_, callers, callees).join(more, "id").select(*_CONTRACT, "code", "docstring", "file", "line", "callers", "callees")


def patterns(graph: Graph, package: str, pattern: str) -> DataFrame:
    """Functions and methods of a package that fit a pattern; hotspots also have callers, their count.
    Raises ValueError for a pattern that there isn't."""
    if pattern not in PATTERNS:
        raise ValueError(f"unknown pattern {pattern!r}: one of {', '.join(PATTERNS)}")
    own = graph.nodes.filter(F.col("package") == package)
    ours = own.filter(is_callable(F.col("type")))
    name = F.col("name")

    def ends(calls_: DataFrame, *own_ends: str) -> DataFrame:
        """Calls whose ends are the package's, where edges tell packages."""
        for end in own_ends:
            calls_ = calls_.filter(F.col(f"{end}_package") == package) if graph.pairs is not None else calls_
        return calls_

    called = ends(graph.links(True).filter("type = 'calls'"), "to").select(F.col("to_id").alias("id"))
    calling = ends(graph.links().filter("type = 'calls'"), "from").select(F.col("from_id").alias("id"))
    if pattern == "constructors":
        return own.filter((F.col("type") == "function") & is_constructor(name)).orderBy("name", "id")
    if pattern == "error-handling":
        tagged = F.coalesce(F.array_contains("behaviors", "error-handle"), F.lit(False))
        return ours.filter(tagged | F.coalesce(F.col("signature").contains("error"), F.lit(False))).orderBy("name", "id")
    if pattern == "tests":
        return ours.filter(is_test(name, F.col("file"))).orderBy("name", "id")
    if pattern == "entrypoints":
        inside = ends(graph.links().filter("type = 'calls'"), "from", "to").join(own.select(F.col("id").alias("from_id")), "from_id", "left_semi")
        return ours.filter(is_exported(name)).join(inside.select(F.col("to_id").alias("id")), "id", "left_anti").orderBy("name", "id")
    if pattern == "sinks":
        return ours.join(called, "id", "left_semi").join(calling, "id", "left_anti").orderBy("name", "id")
    if pattern == "sources":
        return ours.join(calling, "id", "left_semi").join(called, "id", "left_anti").orderBy("name", "id")
    counts = ends(graph.calls(), "to").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("callers"))
    return ours.join(counts, "id").orderBy(F.desc("callers"), "name", "id").limit(HOTSPOTS)
