"""Benchmark decontamination: suffix arrays over shards of the training text, searched for every test suffix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import LOWER, UPPER, cut, free_name, small, table, texts

WINDOW = 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: A-Z lower-cased; bytes that are not part of a word become spaces. A word is WORD.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def words(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def _doubled(ids: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` words at least, by doubling: suffixes that share these share a
    rank. A zero ends a text, so that nothing is compared beyond it."""
    rank, have = ids.astype(np.int64), 1
    while have < depth:
        after = np.zeros(len(rank), dtype=np.int64)
        after[:-have] = rank[have:]
        after[rank == 0] = 0
        key = rank * (int(rank.max(initial=0)) + 1) + after
        _, now = np.unique(key, return_inverse=True)
        now = np.where(rank == 0, 0, now + 1)
        have *= 2
        if int(now.max(initial=0)) == np.count_nonzero(now):  # each suffix has a rank of its own
            return now
        rank = now
    return rank


class Prefixes:
    """Hashes of all stretches of a sequence, from sums over its prefixes."""

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, ids: np.ndarray):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        power = np.cumprod(np.full(len(ids), self.BASE, dtype=np.uint64))
        self.sums = np.r_[np.uint64(0), np.cumsum(h * power)]
        self.back = np.r_[np.uint64(1), np.cumprod(np.full(len(ids), pow(self.BASE, -1, 1 << 64), dtype=np.uint64))]

    def of(self, at: np.ndarray, n: int) -> np.ndarray:
        return (self.sums[at + n] - self.sums[at]) * self.back[at]


class Suffixes:
    """A block of test items: their words as numbers, a zero after each item, and which item each is in. What tasks search
    for is worked out where it is used, once a worker, so that the driver holds the words only."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        self.names: list[str] = []
        ids, self.starts, at = [], [], 0
        for name, text in items:
            found = words(text)
            if found:
                number = self.vocabulary.setdefault
                ids.append(np.fromiter((number(w, len(self.vocabulary) + 1) for w in found), dtype=np.uint32, count=len(found)))
                ids.append(np.zeros(1, dtype=np.uint32))
                self.names.append(name)
                self.starts.append(at)
                at += len(found) + 1
        self.flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)

    @cached_property
    def by_length(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By their length, the distinct windows in order, as byte strings that sort as their words do; the items
        each is in, one after the other, and where each one's end. Items of fewer words than a window are one."""
        starts = np.array(self.starts, dtype=np.int64)
        sizes = np.diff(np.r_[starts, len(self.flat)]) - 1
        out = {}
        for n in sorted({int(x) for x in np.minimum(sizes, self.window)}):
            mine = np.flatnonzero(np.minimum(sizes, self.window) == n)
            many = sizes[mine] - n + 1
            at = np.repeat(starts[mine] - (np.cumsum(many) - many), many) + np.arange(many.sum())
            keys, key = np.unique(_as_bytes(self.flat[at[:, None] + np.arange(n)]), return_inverse=True)
            both = np.unique(key.astype(np.int64) * len(self.names) + np.repeat(mine, many))
            ends = np.searchsorted(both, np.arange(len(keys) + 1) * len(self.names))
            out[n] = (keys, both % max(1, len(self.names)), ends)
        return out

    @cached_property
    def order(self) -> np.ndarray:
        """The suffix array of the test text, in which longest matches are looked up."""
        rank = _doubled(self.flat, max(1, len(self.flat)))
        return np.argsort(rank, kind="stable")[np.count_nonzero(self.flat == 0) :]

    @cached_property
    def prefixes(self) -> Prefixes:
        return Prefixes(self.flat)


def _as_bytes(grid: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(grid.astype(">u4")).view(f"S{4 * grid.shape[1]}").ravel()


def _common(a: Prefixes, at_a: np.ndarray, most_a: np.ndarray, b: Prefixes, at_b: np.ndarray, most_b: np.ndarray) -> np.ndarray:
    """How many words two stretches share from where they start, at most so many in each."""
    n, most = np.zeros(len(at_a), dtype=np.int64), np.minimum(most_a, most_b)
    step = 1 << max(0, int(most.max(initial=0)).bit_length() - 1)
    while step:
        go = np.flatnonzero(n + step <= most)
        go = go[a.of(at_a[go] + n[go], step) == b.of(at_b[go] + n[go], step)]
        n[go] += step
        step //= 2
    return n


def _longest(index: Suffixes, flat: np.ndarray, spots: np.ndarray, room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each spot of a shard's text (room: words to its text's end) the longest match that starts there, with any
    test suffix: where in the test text, and how many words; by binary search in the test's suffix array."""
    mine, theirs, order = Prefixes(flat), index.prefixes, index.order
    ends = np.flatnonzero(index.flat == 0)
    left = ends[np.searchsorted(ends, order)] - order
    low, high = np.zeros(len(spots), dtype=np.int64), np.full(len(spots), len(order))
    while (low < high).any():
        mid = np.minimum((low + high) // 2, len(order) - 1)
        n = _common(mine, spots, room, theirs, order[mid], left[mid])
        before = np.where(n < left[mid], index.flat[np.minimum(order[mid] + n, len(index.flat) - 1)], 0).astype(np.int64)
        before = before < np.where(n < room, flat[np.minimum(spots + n, len(flat) - 1)], 0)
        low, high = np.where((low < high) & before, mid + 1, low), np.where((low < high) & ~before, mid, high)
    best, length = np.zeros(len(spots), dtype=np.int64), np.full(len(spots), -1)
    for k in (low - 1, low):
        k = np.clip(k, 0, len(order) - 1)
        n = _common(mine, spots, room, theirs, order[k], left[k])
        best, length = np.where(n > length, order[k], best), np.maximum(length, n)
    return best, length


def search(texts: list[bytes], index: Suffixes) -> list[tuple[int, list[tuple[int, int]], list[int], list[tuple[int, int, int, int]]]]:
    """For each of a shard's texts: its number of words; the stretches of words that windows cover (first, words);
    the numbers of the items whose windows it has; its longest verbatim matches (item's number, first word in the text, first word in
    the item, words), of which none is within another.

    The shard's suffix array has the suffixes of all its texts that start with a word of the test text (no others
    can match), sorted by a window's words. Every test suffix is found in it by two binary searches, by its window."""
    get = index.vocabulary.get
    ids, counts = [], []
    for text in texts:
        found = words(text)
        counts.append(len(found))
        ids.append(np.fromiter(map(get, found, repeat(0)), dtype=np.uint32, count=len(found)))
        ids.append(np.zeros(1, dtype=np.uint32))
    starts = np.cumsum([0] + [n + 1 for n in counts])
    flat = np.concatenate(ids) if ids else np.zeros(0, dtype=np.uint32)
    covered, holds = np.zeros(len(flat) + 1, dtype=np.int32), [np.zeros(0, dtype=np.int64)]
    begins = [np.zeros(0, dtype=np.int64)]
    if len(index.names) and len(flat):
        rank = _doubled(flat, index.window)
        array = np.argsort(rank, kind="stable")[np.count_nonzero(flat == 0) :]
        padded = np.r_[flat, np.zeros(index.window, dtype=np.uint32)]
        for n, (keys, items, ends) in index.by_length.items():
            suffixes = _as_bytes(_window(padded, array, n))
            low, high = np.searchsorted(suffixes, keys, "left"), np.searchsorted(suffixes, keys, "right")
            for k in np.flatnonzero(high > low).tolist():
                spots = array[low[k] : high[k]]
                np.add.at(covered, spots, 1)
                np.add.at(covered, spots + n, -1)
                begins.append(spots)
                docs = np.unique(np.searchsorted(starts, spots, "right") - 1)
                holds.append((docs[:, None] * len(index.names) + items[ends[k] : ends[k + 1]]).ravel())
                if sum(map(len, holds[1:])) > 1 << 20:
                    holds = [holds[0], np.unique(np.concatenate(holds))]
    out = [(n, [], [], []) for n in counts]
    hit = np.cumsum(covered[:-1]) > 0
    if hit.any():
        edges = np.flatnonzero(np.diff(np.r_[False, hit, False].astype(np.int8))).reshape(-1, 2)
        for a, b in edges.tolist():
            d = int(np.searchsorted(starts, a, "right")) - 1
            out[d][1].append((a - int(starts[d]), b - a))
        for x in np.unique(np.concatenate(holds)).tolist():
            out[x // len(index.names)][2].append(x % len(index.names))
        spots = np.unique(np.concatenate(begins))
        doc = np.searchsorted(starts, spots, "right") - 1
        where, length = _longest(index, flat, spots, starts[doc + 1] - 1 - spots)
        reach = np.r_[0, np.maximum.accumulate(spots + length)[:-1]]
        item_starts = np.array(index.starts, dtype=np.int64)
        for k in np.flatnonzero(spots + length > reach).tolist():
            d, item = int(doc[k]), int(np.searchsorted(item_starts, where[k], "right")) - 1
            out[d][3].append((item, int(spots[k] - starts[d]), int(where[k] - item_starts[item]), int(length[k])))
    return out


def _window(padded: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return padded[at[:, None] + np.arange(n)]


_SPAN = pa.struct([("first", pa.int64()), ("words", pa.int64())])
_MATCH = pa.struct([("item_id", pa.string()), ("doc_word", pa.int64()), ("item_word", pa.int64()), ("words", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(_SPAN)), ("items", pa.list_(pa.string())), ("matches", pa.list_(_MATCH))])
_DDL = (
    "struct<n_words: bigint, spans: array<struct<first: bigint, words: bigint>>, items: array<string>, "
    "matches: array<struct<item_id: string, doc_word: bigint, item_word: bigint, words: bigint>>>"
)


def _blocks(items: DataFrame, window: int, block_bytes: int) -> Iterator[Suffixes]:
    """The test items in blocks of at most about block_bytes of text, by the hash of their id."""
    size = items.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k) if blocks > 1 else items
        yield Suffixes([tuple(r) for r in part.sort("item_id", "text").collect()], window)


def annotate(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = 4 << 20) -> tuple[DataFrame, str]:
    """docs with one more column (its name is returned, and is none of docs'): n_words; spans, the stretches of words
    that windows of items (item_id, text) cover; items, the ids of the items whose windows the text has; matches, the longest
    verbatim matches: the item, the first word in the document and in the item, and the number of words. A window is
    `window` words, or a whole item of fewer.

    Training text stays where it is: each piece of an Arrow batch is a shard with its own suffix array, so that nothing
    is shuffled, and a passage found in any number of documents costs each of them its own matches only.
    The test items are read in blocks of at most about block_bytes of text (an item is not cut), each of which is broadcast. If
    there are several, each one's matches are written, and the broadcast freed, before the next: what is found is joined to
    the documents by a hash of their id and text.

    Null texts and texts of no words match nothing. A null item_id counts as the empty string; rows that
    share an item_id are one item with several texts. Repeated documents each have their matches. Empty
    tables give no rows, or no matches.
    """
    spark = docs.sparkSession
    items = items.select(
        F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.col("text").cast("binary").alias("text")
    ).filter("text IS NOT NULL")
    name = free_name(docs, "_found")
    raw = name + "raw"
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    parts, several = [], False
    for index in _blocks(items, window, block_bytes):
        if parts:  # there are more blocks: write what the one before finds, and let go of it
            several = True
            parts[-1] = _written(*parts[-1])
        held = spark.sparkContext.broadcast(index)
        parts.append((docs, text, held))
    if not several:
        ready = docs.withColumn(raw, text).withColumn(name, F.lit(None).cast(_DDL))
        return ready.mapInArrow(_step(parts[0][2], raw, name), ready.schema).drop(raw), name
    parts[-1] = _written(*parts[-1])
    key, tie = free_name(docs, name + "key"), free_name(docs, name + "tie")
    found = reduce(DataFrame.unionByName, parts).groupBy("k1", "k2").agg(
        F.max("found.n_words").alias("n"),
        F.flatten(F.collect_list("found.spans")).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("found.items")))).alias("items"),
        F.flatten(F.collect_list("found.matches")).alias("matches"),
    )
    found = found.select(F.col("k1").alias(key), F.col("k2").alias(tie), F.struct(F.col("n").alias("n_words"), "spans", "items", "matches").alias(name))
    one, two = _keys(text)
    n = F.regexp_count(F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER, LOWER), F.lit(WORD)).cast("long")
    none = F.struct(n.alias("n_words"), *(F.from_json(F.lit("[]"), t).alias(c) for c, t in (("spans", "array<struct<first: bigint, words: bigint>>"), ("items", "array<string>"), ("matches", "array<struct<item_id: string, doc_word: bigint, item_word: bigint, words: bigint>>"))))
    out = docs.withColumn(key, one).withColumn(tie, two).join(found, [key, tie], "left").withColumn(name, F.coalesce(name, none))
    return out.select(*docs.columns, name), name


def _keys(text: Column) -> tuple[Column, Column]:
    return F.xxhash64(text), F.xxhash64(F.lit("second"), text)


def _written(docs: DataFrame, text: Column, held) -> DataFrame:
    """k1, k2, found: what one block of items finds in the distinct texts that have any of it, written."""
    one, two = _keys(text)
    rows = docs.select(one.alias("k1"), two.alias("k2"), text.alias("text"), F.lit(None).cast(_DDL).alias("found"))
    found = rows.mapInArrow(_step(held, "text", "found", True), rows.schema).drop("text").dropDuplicates(["k1", "k2"])
    out = cut(found, "found")
    held.unpersist()
    return out


def _step(index, raw: str, name: str, hits_only: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = index.value.names
        for batch in small(batches, 512):
            at = batch.schema.get_field_index(name)
            rows = [
                {
                    "n_words": n,
                    "spans": [{"first": a, "words": m} for a, m in spans],
                    "items": [names[i] for i in items],
                    "matches": [{"item_id": names[i], "doc_word": s, "item_word": p, "words": m} for i, s, p, m in matches],
                }
                for n, spans, items, matches in search(batch.column(batch.schema.get_field_index(raw)).to_pylist(), index.value)
            ]
            columns = list(batch.columns)
            columns[at] = pa.array(rows, type=_FOUND)
            out = pa.RecordBatch.from_arrays(columns, names=batch.schema.names)
            yield out.filter(pa.array([bool(r["spans"]) for r in rows])) if hits_only else out

    return run


def hit_words(spans):
    """The number of words within any span: the spans sorted, and each one's words beyond those before (spans of several
    blocks of items may overlap)."""
    spans = F.array_sort(F.transform(spans, lambda m: F.struct(m["first"].alias("a"), (m["first"] + m["words"]).alias("b"))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("to"))
    step = lambda s, x: F.struct(
        (s["n"] + F.greatest(F.lit(0).cast("long"), x["b"] - F.greatest(s["to"], x["a"]))).alias("n"),
        F.greatest(s["to"], x["b"]).alias("to"),
    )
    return F.aggregate(spans, zero, step, lambda s: s["n"])


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """docs without those that hold a window of an item: the columns and other rows of docs as they were."""
    found, name = annotate(docs, items, **how)
    return found.filter(F.size(f"{name}.spans") == 0).select(*docs.columns)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = annotate(texts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"))
    found = found.select("doc_id", F.col(f"{name}.n_words").alias("n_words"), hit_words(F.col(f"{name}.spans")).alias("n_hit"), F.array_sort(F.array_distinct(f"{name}.items")).alias("ids"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = rf"regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item_id, {_WORDS_SQL} AS w FROM benchmark),
b_at AS (SELECT item_id, w, least({WINDOW}, len(w)) AS n, unnest(range(1, greatest(0, len(w) - {WINDOW}) + 2)) AS pos FROM b WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[pos:pos + n - 1], ' ') AS key FROM b_at),
lengths AS (SELECT DISTINCT n FROM windows),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
g AS (SELECT doc_id, pos, [word, {', '.join(f'lead(word, {k}) OVER o' for k in range(1, WINDOW))}] AS ws
      FROM t WINDOW o AS (PARTITION BY doc_id ORDER BY pos)),
hits AS (SELECT doc_id, pos, x.n AS n, item_id
         FROM (SELECT doc_id, pos, n, array_to_string(ws[1:n], ' ') AS key FROM g, lengths WHERE ws[n] IS NOT NULL) x
         JOIN windows ON x.n = windows.n AND x.key = windows.key),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(range(pos, pos + n)) AS p FROM (SELECT DISTINCT doc_id, pos, n FROM hits)) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
          FROM (SELECT DISTINCT doc_id, item_id FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN found USING (doc_id)
"""
