"""Document fingerprints: SimHash with weighted terms, and search by permuted block tables. DataFrame
functions only."""

from __future__ import annotations

from decimal import Decimal
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ._shared import WORD, cut, global_rank, table, texts

_LANES = 0x0000000100000001


def terms(text: Column) -> Column:
    """A text's distinct lower-cased words."""
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def votes(term: str) -> list[Column]:
    """Aggregates by which the terms of a text vote: a term's weight is its length, and it counts for each
    bit set in its hash. Two bits share a sum, as 32-bit lanes: a text has fewer than 2**31 characters."""
    h, w = F.xxhash64(term), F.length(term).cast("long")
    return [
        F.sum(F.shiftrightunsigned(h, k).bitwiseAND(F.lit(_LANES)) * w).alias(f"v{k}") for k in range(32)
    ] + [F.sum(w).alias("weight")]


def signed_bits() -> Column:
    """The fingerprint that the sums of votes() make: a bit is 1 if set in more than half the weight."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF)) * 2 > F.col("weight")
        high = F.shiftrightunsigned(F.col(f"v{k}"), 32) * 2 > F.col("weight")
        one = lambda bit: F.lit((1 << bit) - (1 << 64 if bit == 63 else 0)).cast("long")
        out = out.bitwiseOR(F.when(low, one(k)).otherwise(0)).bitwiseOR(F.when(high, one(k + 32)).otherwise(0))
    return F.coalesce(out, F.lit(0).cast("long"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (long; 0 for texts of no words), one row per row of docs with its own text and id:
    rows that share both are one. Null texts are empty. Equal texts have equal fingerprints."""
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("tid"), F.explode_outer(terms(F.col("text"))).alias("term"))
    sums = rows.groupBy("doc_id", "tid").agg(*votes("term"))
    return sums.select("doc_id", signed_bits().alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def as_hex(fingerprint: Column) -> Column:
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


def near(found: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """query, fingerprint, distance: for each distinct fingerprint of queries (column fingerprint) the distinct
    ones of found within radius bits, itself included if it is there.

    Of radius + 2 blocks of bits at least two are equal in fingerprints that differ in radius bits; so each
    pair of blocks has a table, whose key is those two blocks, and both sides are looked up in every table.
    Copies are one row here. The rows are the answer's: pairs of query and match."""
    width = [64 // (radius + 2) + (i < 64 % (radius + 2)) for i in range(radius + 2)]
    start = [sum(width[:i]) for i in range(radius + 2)]
    part = lambda f, i: F.shiftrightunsigned(f, start[i]).bitwiseAND(F.lit((1 << width[i]) - 1))

    def tables(df: DataFrame, name: str) -> DataFrame:
        f = F.col("fingerprint")
        keys = [
            F.struct(F.lit(n).alias("t"), F.shiftleft(part(f, i), width[j]).bitwiseOR(part(f, j)).alias("k"))
            for n, (i, j) in enumerate(combinations(range(radius + 2), 2))
        ]
        one = df.select("fingerprint").filter("fingerprint IS NOT NULL").distinct()
        return one.select(f.alias(name), F.explode(F.array(*keys)).alias("key")).select(name, "key.t", "key.k")

    pairs = tables(queries, "query").join(tables(found, "fingerprint"), ["t", "k"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    return pairs.select("query", "fingerprint", distance.alias("distance")).filter(F.col("distance") <= radius).distinct()


def id_buckets(ids: DataFrame, rows: int, most: int) -> Column:
    """A column that deals doc_id (unique, not null), in its order, to buckets of about so many rows (at most `most` buckets,
    whatever the size): even steps between quantiles of the ids. In decimals, as ids may span all 64 bits."""
    n, lo, hi = ids.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return F.lit(0).cast("long")
    wanted = max(1, min(most, -(-n // rows)))
    coarse = min(64, wanted)
    fine = -(-wanted // coarse)
    share = [i / coarse for i in range(1, coarse)]
    inner = ids.agg(F.percentile_approx("doc_id", share, 100 * coarse).alias("q")).first()["q"] if share else []
    edges = sorted({lo, *inner}) + [hi + 1]
    wide = lambda x: F.lit(Decimal(x)).cast("decimal(20,0)")
    id_ = F.col("doc_id").cast("decimal(20,0)")

    def tree(a: int, b: int) -> Column:
        if b - a == 1:
            step = max(1, -(-(edges[b] - edges[a]) // fine))
            return F.lit(a * fine) + F.floor((id_ - wide(edges[a])) / wide(step)).cast("long")
        mid = (a + b) // 2
        return F.when(id_ < wide(edges[mid]), tree(a, mid)).otherwise(tree(mid, b))

    return tree(0, len(edges) - 1).cast("long")


def _numbered(base: DataFrame, ids: DataFrame) -> DataFrame:
    """base's rows, in descending doc_id, null ids last, equal ids by their text's hash: doc_id, text, times, and
    number, which is unique and descends. Rows that are the same are counted where they are, and become one row
    with their number, times."""
    order = global_rank(ids.groupBy("doc_id", "tid").count().drop("count"), F.col("doc_id").desc_nulls_last(), "tid")
    key = F.struct(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no"), "tid")
    rows = base.groupBy(key.alias("key")).agg(F.first("text").alias("text"), F.count("*").alias("times"))
    found = rows.join(order.select(key.alias("key"), "doc_id", (-F.col("rank")).alias("number")), "key")
    return found.select("doc_id", "text", "times", "number")


def with_edits(docs: DataFrame, bucket_rows: int = 128, most_buckets: int = 65536) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint, one row per row of docs.

    The edited text has its last third (rounded down, in code points) replaced by as many code points from the
    start of the next document's text, in the order of descending doc_id (null ids after all others, equal
    ids by a hash of the text); the first document follows the last. Documents are dealt by id to buckets; the first of
    each bucket is also put at the end of the bucket before, so that every document meets its next one in a
    window over its bucket. A text is shuffled once; votes are summed where they are. The bucket heads, at most
    most_buckets rows, are the only thing broadcast. Where ids are null or repeat, rows are numbered first (see _numbered), which
    moves texts once more, and dealt by their numbers: no bucket is larger for that.

    Null texts are empty, and have fingerprint 0, as texts of no words. Repeated rows each have a row; all but one of them are
    followed by themselves. One document alone follows itself. An empty table gives no rows; other columns are ignored."""
    base = texts(docs).withColumn("tid", F.xxhash64("text"))
    ids = cut(base.select("doc_id", "tid"), "ids")
    n, known, different = ids.agg(F.count("*"), F.count("doc_id"), F.count_distinct("doc_id")).first()
    if n == known == different:
        base = base.select("doc_id", "text", F.lit(1).cast("long").alias("times"), F.col("doc_id").alias("number"))
    else:
        base = cut(_numbered(base, ids), "numbered")
        ids = base.select(F.col("number").alias("doc_id"))
    bucket = id_buckets(ids, bucket_rows, most_buckets)
    heads = ids.select("doc_id", bucket.alias("b")).groupBy("b").agg(F.max("doc_id").alias("head"))
    found = sorted(heads.collect(), key=lambda r: -r["b"])
    before = [(r["head"], r["b"], found[i - 1]["b"]) for i, r in enumerate(found)]
    heads = docs.sparkSession.createDataFrame(before, "head long, hb long, ghost long")
    dealt = (
        base.withColumnRenamed("doc_id", "id").withColumnRenamed("number", "doc_id").withColumn("b", bucket)
        .join(F.broadcast(heads), (F.col("hb") == F.col("b")) & (F.col("doc_id") == F.col("head")), "left")
    )
    here = F.struct(F.col("b"), F.lit(0).alias("g"))
    there = F.struct(F.col("ghost").alias("b"), F.lit(1).alias("g"))
    dealt = dealt.select(
        "doc_id", "id", "times", "text", F.explode(F.when(F.col("ghost").isNull(), F.array(here)).otherwise(F.array(here, there))).alias("p")
    ).select("doc_id", "id", "times", "text", "p.b", "p.g")
    order = Window.partitionBy("b").orderBy("g", F.col("doc_id").desc())
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = lambda after: F.concat(F.substring("text", F.lit(1), n - third), F.substring(after, F.lit(1), third))
    own = ["b", "rn", "g", "id", "times", "n_chars"]
    both = (
        dealt.withColumn("next", F.lead("text").over(order))
        .withColumn("rn", F.row_number().over(order))
        .select("b", "rn", "g", "id", "times", n.cast("long").alias("n_chars"), "text", F.when(F.col("g") == 0, edited("next")).alias("edited"), F.when((F.col("g") == 0) & (F.col("times") > 1), edited("text")).alias("doubled"))
        .withColumn("sha", F.sha2("edited", 256))
        .withColumn("doubled_sha", F.sha2("doubled", 256))
    )
    which = F.array(*(F.struct(F.lit(e).alias("e"), F.col(t).alias("t")) for e, t in enumerate(("text", "edited", "doubled"))))
    rows = both.select(*own, "sha", "doubled_sha", F.explode(which).alias("w")).filter("w.t IS NOT NULL")
    key = [*own, "sha", "doubled_sha", "e"]
    sums = (
        rows.select(*key[:-1], "w.e", F.explode_outer(terms(F.col("w.t"))).alias("term"))
        .groupBy(*key)
        .agg(*votes("term"))
        .select(*key, signed_bits().alias("f"))
    )
    pick = lambda e: F.max(F.when(F.col("e") == e, F.col("f")))
    rows = sums.groupBy(*key[:-1]).agg(pick(0).alias("f"), pick(1).alias("edited_f"), pick(2).alias("doubled_f"))
    follow = F.lead("f").over(Window.partitionBy("b").orderBy("rn"))
    last = F.struct(F.lit(1).cast("long").alias("times"), F.col("sha").alias("sha"), F.col("edited_f").alias("edited"), F.col("after").alias("after"))
    others = F.struct((F.col("times") - 1).alias("times"), F.col("doubled_sha").alias("sha"), F.col("doubled_f").alias("edited"), F.col("f").alias("after"))
    rows = (
        rows.withColumn("after", follow)
        .filter("g = 0")
        .select("id", "n_chars", "f", F.explode(F.when(F.col("times") > 1, F.array(last, others)).otherwise(F.array(last))).alias("r"))
    )
    return rows.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), F.col("r.times")))).select(
        F.col("id").alias("doc_id"), "n_chars", F.col("r.sha").alias("edited_sha256"), F.col("f").alias("fingerprint"), F.col("r.edited").alias("edited_fingerprint"), F.col("r.after").alias("next_fingerprint")
    )


def near_counts(found: DataFrame, queries: DataFrame, radius: int = 3) -> DataFrame:
    """query, n_near: of each distinct fingerprint of queries the number of other distinct ones of found within the radius."""
    return near(found, queries, radius).groupBy("query").agg((F.count("*") - F.count_if(F.col("distance") == 0)).alias("n_near"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beside the columns asked for, n_near: of each document whose id is divisible by 20, the number of other distinct
    fingerprints of all documents within 3 bits, by block tables; null for the other documents."""
    rows = cut(with_edits(table(spark, sf_dir, "documents")), "edited")
    f = F.col("fingerprint")
    asked = F.col("doc_id") % 20 == 0
    near_ = near_counts(rows.select("fingerprint"), rows.filter(asked).select("fingerprint"))
    some = rows.filter(asked).join(near_, f == F.col("query")).drop("query")
    rest = rows.filter(~F.coalesce(asked, F.lit(False))).withColumn("n_near", F.lit(None).cast("long"))
    return some.unionByName(rest).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(f).alias("fingerprint"),
        as_hex(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        likeness(f, F.col("edited_fingerprint")).alias("near_edited"),
        likeness(f, F.col("next_fingerprint")).alias("near_next"),
        "n_near",
    )
