"""Bounded and unbounded traversals: a loop of hops, each a join of the frontier with the edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.graph import FEW, Graph
from ..plans.lineage import cut


class NodeNotFound(LookupError):
    pass


class NoPath(LookupError):
    pass


#: A frontier of so many ids is held by the driver, and looked for in the edges by a filter (FEW) or a small join.
HELD = 10_000


def reach(edges: DataFrame, start: list[str], max_depth: int | None = None, held: int = HELD) -> DataFrame:
    """id, depth: what start leads to along edges (src, dst), with the least number of hops; start at 0.

    Each hop joins the last frontier only and drops what has been seen, so cycles end. While a hop finds at most `held` ids
    the driver holds them, and a hop is one job, whose filter reaches the stored edges (give edges sorted by src). A
    larger frontier, and all that comes after it, is a table, cut so that plans stay short. Edges may tell the packages of
    their ends (src_package, dst_package): a hop then reads edges from the frontier's packages only."""
    return _reach(edges, start, max_depth, held).select("id", "depth")


def _reach(edges: DataFrame, start: list[str], max_depth: int | None, held: int = HELD) -> DataFrame:
    """reach, with the package of each id: null at the start, and where edges don't tell it."""
    spark = edges.sparkSession
    told = "src_package" in edges.columns
    steps = edges.select("src", "dst", *(F.col(c) if told else F.lit(None).cast("string").alias(c) for c in ("src_package", "dst_package")))
    known, ddl = {i: (0, None) for i in sorted(set(start))}, "id string, depth int, package string"
    frontier, depth = list(known), 0
    table = lambda ids: spark.createDataFrame([(i, *known[i]) for i in ids], ddl)

    def near(packages: set) -> DataFrame:
        return steps if None in packages else steps.filter(F.col("src_package").isin(list(packages)))

    while frontier and (max_depth is None or depth < max_depth):
        depth += 1
        some = near({known[i][1] for i in frontier})
        hit = some.filter(F.col("src").isin(frontier)) if len(frontier) <= FEW else some.join(F.broadcast(table(frontier).select("id")), F.col("id") == F.col("src"))
        found = hit.select("dst", "dst_package").distinct().limit(held + 1).collect()
        if len(found) > held or len(known) > 10 * held:
            depth -= 1
            break
        new = {r["dst"]: (depth, r["dst_package"]) for r in found if r["dst"] is not None and r["dst"] not in known}
        frontier = sorted(new)
        known |= new
    else:
        return table(known)
    seen, frontier = table(known), table(frontier)
    while max_depth is None or depth < max_depth:
        packages = {r[0] for r in frontier.select("package").distinct().collect()}
        if not packages:
            break
        depth += 1
        found = near(packages).join(frontier.select("id"), F.col("id") == F.col("src"), "left_semi").select(F.col("dst").alias("id"), F.col("dst_package").alias("package")).distinct()
        frontier = cut(found.join(seen, "id", "left_anti").select("id", F.lit(depth).alias("depth"), "package"), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def calls(graph: Graph, backward: bool = False) -> DataFrame:
    return _steps(graph, backward, graph.links(backward).filter("type = 'calls'"))


def _steps(graph: Graph, backward: bool, edges: DataFrame) -> DataFrame:
    src, dst = ("to", "from") if backward else ("from", "to")
    packages = [] if graph.pairs is None else [F.col(f"{src}_package").alias("src_package"), F.col(f"{dst}_package").alias("dst_package")]
    return edges.select(F.col(f"{src}_id").alias("src"), F.col(f"{dst}_id").alias("dst"), *packages)


def shortest_path(graph: Graph, source: str, target: str, max_depth: int | None = 10) -> list[str]:
    """The ids of a shortest path of calls, of at most max_depth edges (0 or less, or None: any number); of
    several the first by its ids. Raises NodeNotFound or NoPath."""
    have = {r["id"] for r in graph.nodes.filter(F.col("id").isin(source, target)).select("id").collect()}
    for id_ in (source, target):
        if id_ not in have:
            raise NodeNotFound(id_)
    if source == target:
        return [source]
    steps = calls(graph)
    spark = steps.sparkSession
    frontier = spark.createDataFrame([(source, [source])], "id string, path array<string>")
    seen, depth = frontier.select("id"), 0
    while not max_depth or max_depth < 0 or depth < max_depth:
        depth += 1
        found = frontier.join(steps, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        frontier = cut(found.join(seen, "id", "left_anti").groupBy("id").agg(F.min("path").alias("path")), "frontier")
        if hit := frontier.filter(F.col("id") == target).select("path").first():
            return list(hit["path"])
        if frontier.isEmpty():
            break
        seen = seen.union(frontier.select("id"))
    raise NoPath(f"{source} to {target}")


def path_nodes(graph: Graph, source: str, target: str, max_depth: int | None = 10) -> DataFrame:
    """The nodes of shortest_path, with their place in it; no rows if there is none."""
    try:
        path = shortest_path(graph, source, target, max_depth)
    except (NoPath, NodeNotFound):
        path = []
    spots = graph.nodes.sparkSession.createDataFrame(list(enumerate(path)), "position int, id string")
    return spots.join(graph.nodes, "id").select("position", "id", "package", "name")


def ball(graph: Graph, id_: str, depth: int) -> DataFrame:
    """id, and package where edges tell it, of what is within depth edges of any type, in either direction; ids without a node too."""
    both = _steps(graph, False, graph.links()).union(_steps(graph, True, graph.links(True)))
    return _reach(both, [id_], depth).select("id", "package")


def neighborhood(graph: Graph, id_: str, depth: int = 2) -> Graph:
    """Nodes within depth edges of any type, in either direction, and all edges that touch an id so reached;
    their other ends may lie outside, and ids without a node are passed through."""
    near = ball(graph, id_, depth)
    large = [r["package"] for r in near.groupBy("package").count().filter(F.col("count") > HELD).collect()]

    def touching(edges: DataFrame, end: str, how: str) -> DataFrame:
        """Semi or anti join with the ball: packages of which it has many ids by a join of their edges, the rest as a small table."""
        ids = near.select(F.col("id").alias(f"{end}_id"), "package")
        if not large or graph.pairs is None:
            ids = ids.drop("package")
            return edges.join(ids if large else F.broadcast(ids), f"{end}_id", how).select(*edges.columns)
        of, many = F.col(f"{end}_package").isin(large), F.coalesce(F.col("package").isin(large), F.lit(False))
        few = edges.filter(~of).join(F.broadcast(ids.filter(~many).drop("package")), f"{end}_id", how)
        return few.unionByName(edges.filter(of).join(ids.filter(many | F.col("package").isNull()).drop("package"), f"{end}_id", how)).select(*edges.columns)

    nodes = graph.nodes.join(near.select("id"), "id", "left_semi")
    out = touching(graph.edges, "from", "left_semi")
    in_ = touching(touching(graph.into, "to", "left_semi"), "from", "left_anti")
    return Graph(nodes, out.unionByName(in_))
