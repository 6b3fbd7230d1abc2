"""What several training-data operators need: clean inputs, cut lineage, components."""

from __future__ import annotations

import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.lineage import cut, discard

UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase
WHITESPACE = " \t\n\x0b\x0c\r"
#: A word, as most contracts here have it: a run of anything but space and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text and the columns named, and no other column whatever its name; null texts are empty."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more
    )


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text, whose crc32 is 0."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(modulus))


def small(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of few rows, as texts can be long (Spark bounds batches by bytes as well)."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def global_rank(df: DataFrame, *order: Column | str, name: str = "rank") -> DataFrame:
    """df, written, with each row's place (from 0) in the given order; rows that are equal in it are in any order. A range
    sort, in which no value needs to be in one task as a whole; each task's first place is a sum over a
    table of one row a task."""
    at, task, base = (free_name(df, n) for n in ("_at", "_task", "_base"))
    ranked = cut(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "ranked")
    ranked = ranked.withColumn(task, F.shiftright(at, 33))
    before = Window.orderBy(task).rowsBetween(Window.unboundedPreceding, -1)
    first = ranked.groupBy(task).agg(F.count("*").alias(base)).withColumn(base, F.coalesce(F.sum(base).over(before), F.lit(0)))
    place = F.col(base) + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))
    return ranked.join(F.broadcast(first), task).withColumn(name, place).drop(at, task, base)


#: Links that one task takes up at once; more are taken up by steps over tables.
LINKS_AT_ONCE = 1 << 20


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [np.stack([c.to_numpy() for c in b.columns]) for b in batches]
    links = np.concatenate(parts, axis=1) if parts else np.zeros((2, 0), dtype=np.int64)
    nodes, ends = np.unique(links, return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while (differ := root[a] != root[b]).any():
        a, b = root[a[differ]], root[b[differ]]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tobytes() != root.tobytes():
            root = up
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def components(edges: DataFrame, at_once: int = LINKS_AT_ONCE) -> DataFrame:
    """Connected components of undirected edges (a long, b long): node, root (the least node reachable),
    for every node of an edge between different nodes. Alternates large-star and small-star steps, each of
    which keeps one edge a node and neighbour's minimum, until an iteration changes nothing; each
    iteration's edges are cut. Once at most at_once edges are left (or were given), one task takes them up: its
    memory is bounded by that, and the result is the same."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    last, e = None, cut(e, "links")
    while True:
        now = e.agg(F.count("*"), F.expr("bit_xor(xxhash64(a, b))")).first()
        if tuple(now) == last or now[0] == 0:
            break
        if now[0] <= at_once:
            return e.coalesce(1).mapInArrow(_union_find, "node long, root long")
        last, old = tuple(now), e
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        few = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        e = cut(few.union(least).distinct(), "links")
        discard(old)
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stars.union(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
