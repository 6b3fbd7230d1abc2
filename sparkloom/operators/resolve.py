"""Edges that follow from names: call targets, interfaces implemented, types accepted and returned."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.names import is_callable, placeholder


def resolve_placeholders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """edges whose to_id is a placeholder lead to the function or method of that package and name (the last by
    file and line, of several); others stay as they are."""
    order = F.struct("file", "line", "id")
    known = nodes.filter(is_callable(F.col("type"))).groupBy(placeholder(F.col("package"), F.col("name")).alias("_ph")).agg(F.max_by("id", order).alias("_id"))
    found = edges.join(known, F.col("to_id") == F.col("_ph"), "left")
    return found.withColumn("to_id", F.coalesce("_id", "to_id")).select(*edges.columns)


def implements_edges(method_sets: DataFrame, required: DataFrame) -> DataFrame:
    """from_id, to_id, type, pointer_receiver: the types that have all methods of an interface.

    method_sets: type_id, name, signature, pointer (whether only the pointer has it). required: interface_id,
    name, signature, one row a method, and a row with a null name for an interface of none, which every
    type implements. Relational division: methods are matched by an equi-join and counted, so no type is
    compared with an interface that it shares no method with. pointer_receiver is true if some of the methods
    need the pointer."""
    named = required.filter("name IS NOT NULL").distinct()
    needed = named.groupBy("interface_id").agg(F.count("*").alias("needed"))
    have = method_sets.filter("name IS NOT NULL").groupBy("type_id", "name", "signature").agg(F.min("pointer").alias("pointer"))
    matched = have.join(named, ["name", "signature"]).groupBy("type_id", "interface_id").agg(F.count("*").alias("n"), F.max("pointer").alias("pointer_receiver"))
    full = matched.join(needed, "interface_id").filter("n = needed").select("type_id", "interface_id", "pointer_receiver")
    empty = required.select("interface_id").distinct().join(needed, "interface_id", "left_anti")
    every = method_sets.select("type_id").distinct().crossJoin(empty).withColumn("pointer_receiver", F.lit(False))
    return full.unionByName(every).filter("type_id <> interface_id").select(
        F.col("type_id").alias("from_id"), F.col("interface_id").alias("to_id"), F.lit("implements").alias("type"), "pointer_receiver"
    )


def type_edges(references: DataFrame, types: DataFrame) -> DataFrame:
    """from_id, to_id, type: references (from_id, type_id, role: accepts or returns), each once, to known types."""
    known = types.select(F.col("id").alias("type_id"))
    return references.dropDuplicates(["from_id", "type_id", "role"]).join(known, "type_id", "left_semi").select(
        "from_id", F.col("type_id").alias("to_id"), F.col("role").alias("type")
    )
