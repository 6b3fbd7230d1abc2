"""Mixing sources to target weights, by systematic sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, cut, free_name, global_rank, table, texts

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3


def targets(sizes: list[int], weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES) -> list[float]:
    """What each source is to give of sum(sizes): shares by the weights, repeated in turn; a source stops at
    most times its size, and what exceeds that is shared again by weight among the others, until none is
    above."""
    w = [float(weights[i % len(weights)]) for i in range(len(sizes))]
    out, open_, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while open_:
        total = sum(w[i] for i in sorted(open_))
        full = [i for i in sorted(open_) if left * w[i] / total > most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = left * w[i] / total
            break
        for i in full:
            out[i] = float(most * sizes[i])
            open_.discard(i)
        left = float(sum(sizes)) - sum(out)
    return out


def offset(source: Column, seed: int) -> Column:
    """The source's random offset, a multiple of 2**-16 in [0, 1), so that sums with whole numbers are exact."""
    name = F.when(source.isNull(), F.lit("\x00null")).otherwise(F.concat(F.lit("\x01"), source))
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), name), 256), 1, 4)
    return F.conv(digits, 16, 10).cast("double") / 65536


def goals(per: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, at_once: int = 100_000) -> DataFrame:
    """idx, name, source_size, target of each of per's sources (source, n): see targets(). Up to at_once sources are worked
    out by the driver, more in rounds of sums over the table of sources: the same steps, with the same results."""
    if len(rows := per.limit(at_once + 1).collect()) <= at_once:
        rows = sorted(rows, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
        found = targets([r["n"] for r in rows], weights, most)
        table_ = [(i, r["source"], r["n"], t) for i, (r, t) in enumerate(zip(rows, found, strict=True))]
        return F.broadcast(per.sparkSession.createDataFrame(table_, "idx long, name string, source_size long, target double"))
    ranked = global_rank(per, F.col("source").asc_nulls_last(), name="idx")
    w = F.get(F.array(*(F.lit(float(x)) for x in weights)), (F.col("idx") % len(weights)).cast("int"))
    ranked = cut(ranked.withColumn("w", w), "sources")
    n, total = ranked.agg(F.sum("n"), F.sum("w")).first()
    left, stopped, limit = float(n), -1, most * F.col("n")
    while True:
        share = F.lit(left) * F.col("w") / F.lit(total)
        stops = F.lit(total == 0) | (share > limit)
        k, taken, still = ranked.agg(F.count_if(stops), F.sum(F.when(stops, limit)), F.sum(F.when(~stops, F.col("w")))).first()
        if k == stopped or total == 0:
            break
        left, total, stopped = float(n) - float(taken or 0), still or 0.0, k
    target = F.when(stops, limit.cast("double")).otherwise(share)
    return ranked.select("idx", F.col("source").alias("name"), F.col("n").alias("source_size"), target.alias("target"))


def mix_plan(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 42, at_once: int = 100_000
) -> DataFrame:
    """doc_id, source, tid (a hash of the text), size, source_size, target (its source's), copies; one row per row of docs.

    size is a text's number of words (null: 0). In the order of (size, doc_id) within a source, each document
    is expected target / source_size times; these are summed up, the source's random offset is added, and
    a document is taken once for each whole number its stretch crosses. As neighbours in that order are of
    like size, the words taken come within about the largest document of the target. Reruns agree.

    The order is a range sort by (source, size, doc_id, tid), so that a source with most rows, or rows without id, are spread
    over many tasks; each task's first position within a source is a sum over a table of tasks and sources.
    The table of sources is broadcast up to at_once rows, and joined as a table beyond.

    Sources go by code point, a null source last. Rows that share a doc_id are each a document. Empty
    tables give no rows; documents of no words have size 0. Other columns are ignored.
    """
    sizes = cut(
        texts(docs, F.col("source").cast("string").alias("source")).select(
            "doc_id", "source", F.xxhash64("text").alias("tid"), F.regexp_count("text", F.lit(WORD)).cast("long").alias("size")
        ),
        "sizes",
    )
    per = sizes.groupBy("source").agg(F.sum("size").alias("n"))
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    goal = goals(per, weights, most, at_once)
    numbered = sizes.join(goal, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    numbered = numbered.withColumn("rate", rate).withColumn("u", offset(F.col("source"), seed))
    keys = ["idx", "size", "doc_id", "tid"]
    ranked = cut(
        numbered.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id()),
        "ranked",
    ).withColumn("task", F.shiftright("at", 33))
    before = Window.partitionBy("idx").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    cells = (
        ranked.groupBy("idx", "task")
        .agg(F.min("at").alias("head"), F.count("*").alias("n"))
        .withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
        .drop("n")
    )
    rank = F.col("base") + F.col("at") - F.col("head")
    crossed = F.floor((rank + 1) * F.col("rate") + F.col("u")) - F.floor(rank * F.col("rate") + F.col("u"))
    return ranked.join(cells, ["idx", "task"]).select(
        "doc_id", "source", "tid", "size", "source_size", "target", crossed.cast("int").alias("copies")
    )


def mix(docs: DataFrame, most: int = MOST_COPIES, **how) -> DataFrame:
    """docs, each row as often as mix_plan says, and the number of the copy (from 1) in copy, which takes the place
    of a column of that name; other columns are kept whatever their names. A text moves once.

    Rows that share an id, a source and a text get the copies that the plan has for these, the most to the first by a hash of
    all columns. Such rows, if there are any, are counted where they are before they meet, and dealt out
    again in pieces, so that one row may be a third of the table. An empty table gives no rows."""
    names = [c for c in docs.columns if c.lower() != "copy"]
    docs = docs.select(*names)
    key, tid, m, at, number = (free_name(docs, n) for n in ("_key", "_tid", "_rows", "_at", "_number"))
    taken = [free_name(docs, f"_taken{j}") for j in range(1, most + 1)]
    of_key = lambda t: F.xxhash64(F.col("doc_id").cast("long"), F.col("source").cast("string"), t)
    plan = mix_plan(docs, most=most, **how).withColumn(key, of_key(F.col("tid"))).withColumnRenamed("tid", tid)
    plan = cut(plan.groupBy(key, tid).agg(F.count("*").alias(m), *(F.count_if(F.col("copies") >= j).alias(t) for j, t in enumerate(taken, 1))), "plan")
    keyed = docs.withColumn(tid, F.xxhash64(F.coalesce(F.col("text"), F.lit("")))).withColumn(key, of_key(F.col(tid)))
    times = sum((F.col(t) for t in taken[1:]), F.col(taken[0])).cast("int")
    once = keyed.join(plan.filter(F.col(m) == 1).filter(F.col(taken[0]) > 0), [key, tid])
    out = once.select(*names, F.explode(F.sequence(F.lit(1), times)).alias("copy"))
    if (several := plan.filter(F.col(m) > 1)).isEmpty():
        return out
    rows = keyed.join(several, [key, tid], "left_semi").groupBy(*names, key, tid).agg(F.count("*").alias(m))
    before = Window.partitionBy(key, tid).orderBy(F.xxhash64(*names)).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(at, F.coalesce(F.sum(m).over(before), F.lit(0))).join(several.drop(m), [key, tid])
    piece = 1024
    counts = [F.struct(F.lit(j).alias("copy"), F.least(F.col(m), F.greatest(F.lit(0), F.col(t) - F.col(at))).alias("n")) for j, t in enumerate(taken, 1)]
    pieces = rows.select(*names, F.explode(F.array(*counts)).alias(number)).filter(F.col(f"{number}.n") > 0)
    pieces = pieces.withColumn(at, F.explode(F.sequence(F.lit(0), F.col(f"{number}.n") - 1, F.lit(piece)))).repartition(F.xxhash64(at, *names))
    left = F.least(F.lit(piece), F.col(f"{number}.n") - F.col(at)).cast("int")
    more = pieces.select(*names, F.col(f"{number}.copy").alias("copy"), F.explode(F.sequence(F.lit(1), left)).alias(number)).drop(number)
    return out.unionByName(more)


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).cast("long").alias("taken")
    )


OP7_SQL = r"""
WITH RECURSIVE s AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
per AS (
  SELECT source, n, [5.0::DOUBLE, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w,
         ('0x' || substr(sha256('42:' || CASE WHEN source IS NULL THEN chr(0) || 'null' ELSE chr(1) || source END), 1, 4))::INTEGER / 65536.0::DOUBLE AS u
  FROM (SELECT source, sum(size)::BIGINT AS n FROM s GROUP BY source)),
fill AS (
  SELECT source, n, w, u, false AS stops, 0 AS round, 0.0::DOUBLE AS target FROM per
  UNION ALL
  SELECT source, n, w, u, stops OR most < share, round + 1, CASE WHEN stops OR most < share THEN most ELSE share END
  FROM (SELECT source, n, w, u, stops, round, (3 * n)::DOUBLE AS most,
               (sum(n) OVER () - sum(CASE WHEN stops THEN 3 * n ELSE 0 END) OVER ())::DOUBLE * w
               / sum(CASE WHEN stops THEN 0 ELSE w END) OVER () AS share FROM fill)
  WHERE round <= (SELECT count(*) FROM per)),
goal AS (
  SELECT source, n, u, target, CASE WHEN n > 0 THEN least(3.0::DOUBLE, target / n) ELSE 0 END AS rate
  FROM fill WHERE round = (SELECT max(round) FROM fill)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS place FROM s)
SELECT doc_id, size, n AS source_size, target,
       ((floor((place + 1) * rate + u) - floor(place * rate + u)) * size)::BIGINT AS taken
FROM ranked JOIN goal ON ranked.source IS NOT DISTINCT FROM goal.source
"""
