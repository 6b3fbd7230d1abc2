"""SimHash near-dedup: fingerprints compared exactly, tile by tile, with exclusive-or and bit counts."""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import components, cut, free_name, small, table, texts

#: Pairs of fingerprints that are compared at once: what they need stays in a core's cache.
_AT_ONCE = 1 << 16
#: Steps of size that make up the least share of sizes in a link.
STEPS = 16


def shingle_hashes(text: bytes, n: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each shingle of n words (bytes.lower changes A-Z only, and bytes.split parts at space and
    0x09-0x0D); of the whole sequence if there are fewer words, of none if there is no word."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < n:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed)], dtype=np.uint64)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64, count=len(words) - n + 1)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes."""
    set_ = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_ += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << int(i) for i in np.flatnonzero(2 * set_ > len(hashes)))


def wide_fingerprint(hashes: np.ndarray, lanes: int) -> list[int]:
    """lanes fingerprints of 64 bits, each of the hashes mixed in its own way; the first is of the hashes."""
    out = []
    for lane in range(lanes):
        h = hashes
        if lane:
            h = (h ^ np.uint64(0x9E3779B97F4A7C15 * lane & 0xFFFFFFFFFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            h ^= h >> np.uint64(31)
        out.append(majority(h))
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint_table(docs: DataFrame, words: int = 4, lanes: int = 1) -> DataFrame:
    """doc_id, the fingerprint in f0, f1 ... (lanes of 64 bits, as longs), and n, the number of distinct shingles
    (at least 1); one row per row of docs. Null texts are empty; texts of no words have fingerprint 0, like
    each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                h = shingle_hashes(text, words)
                rows.append([*(_signed(x) for x in wide_fingerprint(h, lanes)), max(1, len(np.unique(h)))])
            columns = [pa.array([r[i] for r in rows], type=pa.int64()) for i in range(lanes + 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", *(f"f{i}" for i in range(lanes)), "n"])

    rows = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"f{i} long" for i in range(lanes)) + ", n long")


def _forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Each node's root, after all links; links within a tree that is known already are dropped at once. They
    are taken up some _AT_ONCE together, as each time costs some passes over the roots."""

    def gathered() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        held, room = [], _AT_ONCE
        for pair in links:
            held.append(pair)
            room -= len(pair[0])
            if room <= 0:
                yield tuple(map(np.concatenate, zip(*held, strict=True)))
                held, room = [], _AT_ONCE
        if held:
            yield tuple(map(np.concatenate, zip(*held, strict=True)))

    root = np.arange(n)
    for a, b in gathered():
        a, b = root[a], root[b]
        while (differ := a != b).any():
            low, high = np.minimum(a, b)[differ], np.maximum(a, b)[differ]
            np.minimum.at(root, high, low)
            while (up := root[root]).tobytes() != root.tobytes():
                root = up
            a, b = root[low], root[high]
    return root


def _population(f: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts of the first lane, a row a fingerprint."""
    parts = [(f[:, 0] >> np.uint64(16 * i)) & np.uint64(0xFFFF) for i in range(4)]
    return np.bitwise_count(np.stack(parts, axis=1)).astype(np.int16)


def _tiles(f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order that puts fingerprints of equal population counts in four parts together; where each such tile
    starts, and the end; the tiles' counts."""
    p = _population(f)
    order = np.lexsort(p.T)
    starts = np.r_[np.flatnonzero(np.r_[True, (np.diff(p[order], axis=0) != 0).any(axis=1)]), len(p)]
    return order, starts, p[order][starts[:-1]]


def _by_population(a: tuple, b: tuple, within: bool, radius: int) -> Iterator[tuple[slice, np.ndarray]]:
    """Each tile's rows and those of the tiles whose counts differ by at most the radius in all, as each
    differing bit changes one of the counts by one."""
    _, starts, counts = a
    _, starts_b, counts_b = b
    for t in range(len(counts)):
        first = t if within else 0
        near = first + np.flatnonzero(np.abs(counts_b[first:] - counts[t]).sum(axis=1) <= radius)
        if len(near):
            sizes = starts_b[near + 1] - starts_b[near]
            yield slice(starts[t], starts[t + 1]), np.repeat(starts_b[near] - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def _by_size(a: np.ndarray, b: np.ndarray, within: bool, share: float, rows: int = 64) -> Iterator[tuple[slice, slice]]:
    """Runs of rows of like size, both sides sorted by it, and the rows whose size is near enough to some of them."""
    for r in range(0, len(a), rows):
        to = min(len(a), r + rows)
        low = np.searchsorted(b, a[r] * share - 1e-6, "left")
        high = np.searchsorted(b, a[to - 1] / share + 1e-6, "right")
        if max(low, r if within else 0) < high:
            yield slice(r, to), slice(max(low, r if within else 0), high)


def _near_pairs(mine: np.ndarray, other: np.ndarray, radius: int, room: tuple) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs that differ in at most radius bits; lanes are the first axis, room what is written to.
    Half of the lanes rule most pairs out."""
    lanes, rows, columns = len(mine), mine.shape[1], other.shape[1]
    half = max(1, lanes // 2)
    xor, bits, more = (x[: rows * columns].reshape(rows, columns) for x in room)
    np.bitwise_count(np.bitwise_xor(mine[0][:, None], other[0][None], out=xor), out=bits)
    for lane in range(1, half):
        np.bitwise_count(np.bitwise_xor(mine[lane][:, None], other[lane][None], out=xor), out=more)
        bits += more
    x, y = np.divmod(np.flatnonzero(bits.ravel() <= radius), columns)
    if half < lanes and len(x):
        whole = np.bitwise_count(mine[:, x] ^ other[:, y]).sum(axis=0, dtype=np.uint16)
        x, y = x[whole <= radius], y[whole <= radius]
    return x, y


def near_links(
    left: np.ndarray, right: np.ndarray | None, radius: int, sizes: tuple | None = None, share: float = 0.0
) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links, of at most radius differing bits, between two blocks of fingerprints (or
    within one): positions in both blocks end to end, and their roots.

    A tile is the fingerprints of equal population counts in four parts; a pair of tiles is skipped if these
    counts differ by more than the radius in all (see _by_population). With sizes, of the documents' shingle
    sets, of which the lesser must be at least `share` of the greater in a link, tiles are runs of like
    size instead, and pairs of tiles are skipped by that: at a wide radius population counts rule nothing out."""
    within = right is None
    both = left if within else np.concatenate([left, right])
    blocks = [left] if within else [left, right]
    if sizes is None:
        tiles = [_tiles(x) for x in blocks]
        orders = [t[0] for t in tiles]
        candidates = _by_population(tiles[0], tiles[-1], within, radius)
    else:
        orders = [np.argsort(n, kind="stable") for n in sizes[: len(blocks)]]
        ordered = [n[o] for n, o in zip(sizes, orders, strict=False)]
        candidates = _by_size(ordered[0], ordered[-1], within, share)
    sides = [np.ascontiguousarray(x[o].T) for x, o in zip(blocks, orders, strict=True)]
    if not within:
        orders[1] = orders[1] + len(left)
    count = np.uint8 if left.shape[1] < 8 else np.uint16
    room = (np.empty(_AT_ONCE, dtype=np.uint64), np.empty(_AT_ONCE, dtype=count), np.empty(_AT_ONCE, dtype=count))

    def links() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for rows, columns in candidates:
            mine, others, at_row, at_column = sides[0][:, rows], sides[-1][:, columns], orders[0][rows], orders[-1][columns]
            for c in range(0, others.shape[1], _AT_ONCE):
                other = others[:, c : c + _AT_ONCE]
                step = max(1, _AT_ONCE // other.shape[1])
                for r in range(0, mine.shape[1], step):
                    x, y = _near_pairs(mine[:, r : r + step], other, radius, room)
                    if sizes is not None and len(x):
                        m, n = ordered[0][rows][r + x], ordered[-1][columns][c + y]
                        alike = np.minimum(m, n) + 1e-6 >= share * np.maximum(m, n)
                        x, y = x[alike], y[alike]
                    if len(x):
                        yield at_row[r + x], at_column[c + y]

    root = _forest(len(both), links())
    moved = np.flatnonzero(root != np.arange(len(both)))
    return moved, root[moved]


def _blocks(cells: dict[tuple[int, int], int], rows: int, radius: int) -> tuple[list, list]:
    """cells: fingerprints by the population counts of their halves, or by the step of their size and 0. Deals
    the cells, by total and then first part, to blocks of about rows; a larger cell gets a run of several. Returns each
    cell's first block and number of blocks, and the pairs of runs (a block that several cells share is a run of one) of
    which some cells are within the radius, as both runs' first block and number of blocks."""
    where, runs, room = [], [], 0
    for (low, high), n in sorted(cells.items(), key=lambda c: (sum(c[0]), c[0][0])):
        if n > rows or room < n:
            at = runs[-1][0] + runs[-1][1] if runs else 0
            runs.append((at, -(-n // rows) if n > rows else 1, []))
            room = 0 if n > rows else rows
        runs[-1][2].append((low, high))
        where.append((low, high, runs[-1][0], runs[-1][1]))
        room -= min(n, room)
    grids = [np.array(cells) for _, _, cells in runs]
    pairs = [
        (*runs[i][:2], *runs[j][:2])
        for i in range(len(runs))
        for j in range(i, len(runs))
        if (np.abs(grids[i][:, None, :] - grids[j][None, :, :]).sum(axis=2) <= radius).any()
    ]
    return where, pairs


def linked(prints: DataFrame, radius: int, lanes: int = 1, share: float | None = None, block_rows: int = 32768) -> DataFrame:
    """prints, distinct rows of node (its own number), f0 ... (and n, if a share is given): node and the root of
    its component, for those linked with another: they differ in at most radius bits, and the lesser n is at least `share`
    of the greater.

    Fingerprints are put in blocks of block_rows by the population counts of the first lane's halves, or by n, in steps of
    which STEPS make the share; their histogram, of at most 33 x 33 rows, or one a step (1,500 up to a
    billion), comes to the driver, and gives runs of blocks, and the pairs of runs to compare; pairs of blocks are made of these in
    tasks. Each pair of blocks meets in one row, so a task holds two blocks at a time, whatever the number of
    fingerprints; a block is sent once for each block it may have links with. A
    pair's links leave its task as a spanning forest: a group of k near copies gives k rows, not k squared.
    """
    spark = prints.sparkSession
    names = [f"f{i}" for i in range(lanes)]
    fields = names if share is None else [*names, "n"]
    if share is None:
        low, high, reach = F.bit_count(F.col("f0").bitwiseAND(F.lit(0xFFFFFFFF))), F.bit_count(F.shiftrightunsigned("f0", 32)), radius
    else:  # one step more, as logarithms are rounded
        low, high, reach = F.floor(F.log("n") * (STEPS / -math.log(share))).cast("int"), F.lit(0), STEPS + 1
    cells = prints.select(low.alias("low"), high.alias("high"), "node", *fields)
    histogram = {(r["low"], r["high"]): r["count"] for r in cells.groupBy("low", "high").count().collect()}
    where, pairs = _blocks(histogram, block_rows, reach)
    if not pairs:
        return spark.createDataFrame([], "node long, root long")
    place = spark.createDataFrame(where, "low int, high int, first int, k int")
    block = F.col("first") + F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    blocks = (
        cells.join(F.broadcast(place), ["low", "high"])
        .groupBy(block.alias("block"))
        .agg(F.collect_list(F.struct("node", *fields)).alias("rows"))
    )
    of_run = lambda first, k: F.explode(F.sequence(F.col(first), F.col(first) + F.col(k) - 1))
    both = spark.createDataFrame(pairs, "a int, ka int, b int, kb int").select(of_run("a", "ka").alias("i"), "b", "kb")
    both = both.select("i", of_run("b", "kb").alias("j")).filter("i <= j")
    side = lambda name, k: F.struct(F.col(name).alias("block"), F.lit(k).alias("side"))
    one, two = side("i", 0), side("j", 1)
    sides = both.select("i", "j", F.explode(F.when(F.col("i") == F.col("j"), F.array(one)).otherwise(F.array(one, two))).alias("s"))
    tasks = max(12, min(sum(ka * kb for _, ka, _, kb in pairs), 20000))
    work = (
        sides.select("i", "j", "s.block", "s.side")
        .join(blocks, "block")
        .repartition(tasks, "i", "j")
        .groupBy("i", "j")
        .agg(F.sort_array(F.collect_list(F.struct("side", "rows"))).alias("sides"))
        .select(F.col("sides")[0]["rows"].alias("a"), F.get("sides", F.lit(1))["rows"].alias("b"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def grid(column: pa.ListArray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray | None] | None:
            if not column[i].is_valid:
                return None
            struct = column[i].values
            numbers = {n: struct.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("node", *fields)}
            return numbers["node"], np.stack([numbers[n].view(np.uint64) for n in names], axis=1), numbers.get("n")

        for batch in batches:
            for i in range(batch.num_rows):
                (ids, a, n), right = grid(batch.column(0), i), grid(batch.column(1), i)
                sizes = None if share is None else (n, right[2] if right else None)
                moved, root = near_links(a, right[1] if right else None, radius, sizes, share or 0.0)
                ids = np.concatenate([ids, right[0]]) if right else ids
                yield pa.RecordBatch.from_arrays([pa.array(ids[moved]), pa.array(ids[root])], names=["a", "b"])

    return components(work.mapInArrow(run, "a long, b long"))


def near_dedup(
    docs: DataFrame, words: int = 4, radius: int = 4, lanes: int = 1, share: float | None = None, block_rows: int = 32768
) -> DataFrame:
    """doc_id, f0 ... (the fingerprint), component_id: the smallest doc_id of the documents that links of at
    most radius differing bits lead to, itself included; one row per row of docs. With a share, the
    lesser number of distinct shingles must also be at least that of the greater in a link.

    Equal fingerprints are one row in all that is compared, so copies cost nothing there; they get their
    component by a join on the fingerprint, which adaptive execution splits where copies are many.

    Null texts are empty, and texts of no words are linked like others. Null ids get a component, but are
    its id only if it has no other. Repeated rows are copies. An empty table gives no rows.
    """
    names = [f"f{i}" for i in range(lanes)]
    fields = names if share is None else [*names, "n"]
    rows = cut(fingerprint_table(docs, words, lanes).select("doc_id", *fields), "fingerprints")
    prints = rows.groupBy(*fields).agg(F.min("doc_id").alias("least"))
    prints = cut(prints.withColumn("node", F.monotonically_increasing_id()), "prints")
    groups = linked(prints.select("node", *fields), radius, lanes, share, block_rows)
    group_least = groups.join(prints.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("group_least"))
    groups = groups.join(group_least, "root").select("node", "group_least")
    named = prints.join(groups, "node", "left")
    named = named.select(*fields, F.coalesce("group_least", "least").alias("component_id"))
    return rows.join(named, fields).select("doc_id", *names, "component_id")


def drop_near(docs: DataFrame, words: int = 5, similarity: float = 0.8, lanes: int = 4) -> DataFrame:
    """docs without the documents that have a near copy of a smaller doc_id: of each component one stays.

    Shingles of five words and a similarity of 0.8, as the cosine that fingerprints estimate: differing bits
    are to all bits as the angle is to half a circle. Four lanes of 64 bits tell this apart from chance,
    which one lane can't at that radius. Sets of a and b shingles have a cosine of at most the root of a / b; so
    those of which a is below similarity squared of b are not compared.

    Null texts are empty, and empty texts near copies of each other. Of rows that share an id one stays; rows without an id all
    stay. An empty table gives no rows; columns of any name are kept as they are."""
    radius = int(64 * lanes * math.acos(similarity) / math.pi)
    names = [f"f{i}" for i in range(lanes)]
    found = near_dedup(docs, words, radius, lanes, similarity**2).drop(*names).filter("doc_id IS NOT NULL")
    found = cut(found.groupBy("doc_id").agg(F.min("component_id").alias("component"), F.count("*").alias("rows")), "components")
    key = free_name(docs, "_gone")
    gone = found.filter("component <> doc_id").select(F.col("doc_id").alias(key))
    stay = docs.join(gone, F.col("doc_id") == F.col(key), "left_anti")
    if found.filter("rows > 1").isEmpty():
        return stay
    return stay.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).unionByName(stay.filter("doc_id IS NULL"))


def hex_of(name: str) -> Column:
    return F.lower(F.lpad(F.hex(name), 16, "0"))


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_of("f0").alias("fingerprint"), "component_id")
