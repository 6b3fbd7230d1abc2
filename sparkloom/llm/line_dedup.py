"""Line dedup: lines found in several documents stay only in the first of them. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, WHITESPACE, cut, table, texts

#: Stands for a null id in comparisons, so that it comes after every other id.
_NO_ID = 2**63 - 1


def line_key(line: Column) -> Column:
    """The line without space and 0x09-0x0D at either end, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(WHITESPACE)), UPPER, LOWER)


def line_dedup(docs: DataFrame, min_chars: int = 10, min_docs: int = 2, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text (of the lines that stay, joined by newlines), n_lines, n_dropped, and the columns of docs
    that keep names; one row per row of docs.

    Lines are exploded, their keys hashed to 128 bits, and the hashes counted by distinct documents. A key
    of at least min_chars code points that at least min_docs documents hold loses all its lines but those
    of the smallest doc_id. Only hashes and positions are shuffled by line, so that a line found everywhere
    costs a few bytes an occurrence, its count is combined before the shuffle, and the join that marks its
    occurrences is one that adaptive execution splits. A document's text moves once.

    Null or empty text is one empty line. Rows that share a doc_id are one document: none loses a line to
    another. Null ids are one document, which comes last; an
    id of 2**63 - 1 counts as null. An empty table gives no rows. Other columns are ignored.
    """
    base = texts(docs, *keep).select(
        "doc_id",
        *keep,
        F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"),
        F.xxhash64("text").alias("tid"),
        "text",
    )
    lines = base.select("did", "tid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    keys = (
        lines.select("did", "tid", "pos", line_key(F.col("line")).alias("key"))
        .filter(F.length("key") >= min_chars)
        .select("did", "tid", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit("second"), "key").alias("k2"))
    )
    keys = cut(keys, "keys")  # else lines are exploded and hashed once for the counts and again for the join
    several = F.min("did") < F.max("did") if min_docs == 2 else F.countDistinct("did") >= min_docs
    repeated = keys.groupBy("k1", "k2").agg(F.min("did").alias("first"), several.alias("several")).filter("several")
    repeated = cut(repeated.drop("several"), "repeated")  # else the join takes up the sums' partitioning, which can't be split
    gone = (
        keys.join(repeated, ["k1", "k2"])
        .filter("did <> first")
        .groupBy("did", "tid")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )
    # what stays are the slices between the positions that go
    n, k = F.size("lines"), F.size("gone")
    start = lambda i: F.when(i == 0, 1).otherwise(F.get("gone", i - 1) + 2)
    end = lambda i: F.when(i == k, n).otherwise(F.get("gone", i))
    stay = F.flatten(
        F.transform(F.sequence(F.lit(0), k), lambda i: F.slice("lines", start(i), end(i) - start(i) + 1))
    )
    return (
        base.join(gone, ["did", "tid"], "left")
        .select("doc_id", *keep, F.split("text", "\n", -1).alias("lines"), "text", "gone")
        .select(
            "doc_id",
            F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n")).alias("text"),
            *keep,
            n.cast("long").alias("n_lines"),
            F.when(F.col("gone").isNull(), 0).otherwise(k).cast("long").alias("n_dropped"),
        )
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )


OP2_SQL = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
s AS (SELECT key, min(doc_id) AS f FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, k.line, k.pos, coalesce(s.f <> k.doc_id, false) AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
