"""Substring dedup by hashing of lines, of their sentences, and of all windows of 50 words: the first occurrence stays.

Of each window the least hash of its runs of 25 words is its anchor, the same wherever the window is. Only windows whose
anchor occurs again, by a bitmap of anchors, are compared, so few move; all that repeat are among them."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, small, table, texts

MIN_WORDS = 25  # of lines and sentences: shorter ones recur by nature, and are line dedup's to judge
WINDOW, GRAM = 50, 25  # words of a window, and of the runs in it one of which is its anchor
MAP_BITS, BLOCK_BITS = 27, 16  # anchors' bitmap, and its blocks
_BASE = 0x9E3779B97F4A7C15
_NO_ID = 2**63 - 1
_LINE = re.compile(r"[^\n]+")
_SENTENCE = re.compile(r"\S(?:[^.!?]|[.!?]+(?!\s|\Z))*[.!?]*")


def units(text: str, min_words: int = MIN_WORDS) -> Iterator[tuple[int, int, str]]:
    """The lines of a text, and the sentences of lines that have several: start, end (code points), and the
    normalised unit: lower-cased words joined by single spaces, at least min_words of them."""
    for line in _LINE.finditer(text):
        found = line.group().lower().split()
        if len(found) < min_words:
            continue
        yield line.start(), line.end(), " ".join(found)
        parts = list(_SENTENCE.finditer(line.group()))
        if len(parts) > 1:
            for part in parts:
                words = part.group().lower().split()
                if len(words) >= min_words:
                    yield line.start() + part.start(), line.start() + part.end(), " ".join(words)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def windows(text: str, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """The anchor and the hash of each WINDOW consecutive lower-cased words of a text, wherever its lines end."""
    words = text.lower().split()
    n = len(words)
    if n < WINDOW:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(known.__getitem__, words), dtype=np.uint64, count=n)
    power = np.cumprod(np.full(n, _BASE, dtype=np.uint64))
    back = np.cumprod(np.full(n, pow(_BASE, -1, 1 << 64), dtype=np.uint64))
    sums = np.r_[np.uint64(0), np.cumsum(h * power)]
    least = _mixed((sums[GRAM:] - sums[:-GRAM]) * back[: n - GRAM + 1])
    have, wanted = 1, WINDOW - GRAM + 1
    while have < wanted:
        step = min(have, wanted - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return least, _mixed((sums[WINDOW:] - sums[:-WINDOW]) * back[: n - WINDOW + 1])


def _runs(anchors: np.ndarray) -> np.ndarray:
    """Where runs of windows of the same anchor start."""
    return np.flatnonzero(np.r_[True, anchors[1:] != anchors[:-1]])


def repeated_windows(base: DataFrame, runs_per_bucket: int = 50_000) -> DataFrame:
    """did, tid, start, end (in words): windows that occurred before, by did and place, joined where they follow
    each other. In the same text, only those that don't overlap the first occurrence, which so stays whole."""
    spark = base.sparkSession

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            known, found = _Hashes(), [np.zeros(0, dtype=np.uint64)]
            for text in batch.column(0).to_pylist():
                anchors, hashes = windows(text, known)
                if len(anchors):
                    found.append(anchors[_runs(anchors)])
                    _, first = np.unique(hashes, return_index=True)
                    if len(first) < len(hashes):
                        found.append(np.delete(anchors, first))
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    def block(key, rows):
        bits = np.zeros(1 << BLOCK_BITS, dtype=bool)
        bits[rows["h"].to_numpy().view(np.uint64) >> np.uint64(64 - MAP_BITS) & np.uint64((1 << BLOCK_BITS) - 1)] = True
        return pa.table({"block": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary()), "n": pa.array([int(rows["n"].to_numpy().sum())], pa.int64())})

    again = base.select("text").mapInArrow(mark, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter("n > 1")
    blocks = again.withColumn("block", F.shiftrightunsigned("h", 64 - MAP_BITS + BLOCK_BITS)).groupBy("block")
    bitmap, total = np.zeros((1 << (MAP_BITS - BLOCK_BITS), (1 << BLOCK_BITS) // 8), dtype=np.uint8), 0
    for row in blocks.applyInArrow(block, "block long, bits binary, n long").collect():
        bitmap[row["block"]] = np.frombuffer(zlib.decompress(row["bits"]), dtype=np.uint8)
        total += row["n"]
    held, buckets = spark.sparkContext.broadcast(bitmap.reshape(-1)), max(8, total // runs_per_bucket)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in small(batches):
            known, out = _Hashes(), []
            for did, tid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                anchors, hashes = windows(text, known)
                if not len(anchors):
                    continue
                starts = _runs(anchors)
                place = anchors[starts] >> np.uint64(64 - MAP_BITS)
                hit = bits[place >> np.uint64(3)] >> (np.uint8(7) - (place & np.uint64(7)).astype(np.uint8)) & 1
                ends = np.r_[starts[1:], len(anchors)]
                short = hashes.astype(np.uint32)
                for k in np.flatnonzero(hit).tolist():
                    h = int(anchors[starts[k]])
                    out.append((h % buckets, h - (1 << 64) if h >> 63 else h, did, tid, int(starts[k]), short[starts[k] : ends[k]].tobytes()))
            columns = list(zip(*out, strict=True)) if out else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(columns[4], pa.int32()), pa.array(columns[5], pa.binary())]
            yield pa.RecordBatch.from_arrays(arrays, names=["bucket", "h", "did", "tid", "at", "hashes"])

    def later(key, rows):
        data = rows["hashes"].to_pylist()
        n = np.fromiter((len(d) // 4 for d in data), dtype=np.int64, count=len(data))
        h, did, tid = (np.repeat(rows[c].to_numpy(), n) for c in ("h", "did", "tid"))
        at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n - rows["at"].to_numpy(), n)
        short = np.frombuffer(b"".join(data), dtype=np.uint32)
        order = np.lexsort((tid, at, did, short, h))
        h, short, did, tid, at = (x[order] for x in (h, short, did, tid, at))
        new = np.r_[True, (h[1:] != h[:-1]) | (short[1:] != short[:-1])]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        gone = (did != did[first]) | (tid != tid[first]) | (at >= at[first] + WINDOW)
        did, tid, at = did[gone], tid[gone], at[gone]
        order = np.lexsort((at, tid, did))
        did, tid, at = did[order], tid[order], at[order]
        new = np.flatnonzero(np.r_[True, (did[1:] != did[:-1]) | (tid[1:] != tid[:-1]) | (at[1:] > at[:-1] + 1)][: len(at)])
        last = np.r_[new[1:], len(at)][: len(new)] - 1
        return pa.table({"did": did[new], "tid": tid[new], "start": pa.array(at[new], pa.int32()), "end": pa.array(at[last] + WINDOW, pa.int32())})

    sent = base.select("did", "tid", "text").mapInArrow(send, "bucket long, h long, did long, tid long, at int, hashes binary")
    return sent.groupBy("bucket").applyInArrow(later, "did long, tid long, start int, end int")


def remove(text: str, spans: list[tuple[int, int]]) -> tuple[str, list[tuple[int, int]]]:
    """The text without the spans, and these, sorted and joined where they touch. A span that takes what is
    left of its line takes the newline after it as well (the last line's the one before)."""
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and not text[merged[-1][1] : a].strip(" \t"):
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    for span in merged:
        a, b = span
        starts, ends = a == 0 or text[a - 1] == "\n", b == len(text) or text[b] == "\n"
        if starts and ends and b < len(text):
            span[1] += 1
        elif starts and ends and a > 0:
            span[0] -= 1
    out, at = [], 0
    for a, b in merged:
        out.append(text[at:a])
        at = max(at, b)
    return "".join([*out, text[at:]]), [(a, b) for a, b in merged]


def substring_dedup(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text (what stays), removed (array of start and end in the original's code points); one row per
    row of docs.

    Of each unit (see units) and window of WINDOW words (see repeated_windows), occurrences are ranked by doc_id, then offset; the first stays and the others are
    removed, in the same document as in others. A unit's digest has 128 bits; digests are counted with
    partial sums, and the table of those that occur again is cut, so that the join which marks occurrences
    is one that adaptive execution splits. A text moves once, to meet its spans.

    Null texts are empty. Null ids come last, and are one document; an id of 2**63 - 1 counts as null. Rows that share id and text count as
    one. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    base = texts(docs).select("doc_id", F.coalesce("doc_id", F.lit(_NO_ID)).alias("did"), F.xxhash64("text").alias("tid"), "text")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small(batches):
            rows = []
            for did, tid, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for start, end, unit in units(text, min_words):
                    d = xxhash.xxh3_128_digest(unit.encode("utf-8", "surrogatepass"))
                    rows.append((int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), did, tid, start, end))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + [pa.array(c, pa.int32()) for c in columns[4:]]
            yield pa.RecordBatch.from_arrays(arrays, names=["k1", "k2", "did", "tid", "start", "end"])

    found = cut(base.select("did", "tid", "text").mapInArrow(digest, "k1 long, k2 long, did long, tid long, start int, end int"), "units")
    first = F.min(F.struct("did", "start"))
    again = cut(
        found.groupBy("k1", "k2")
        .agg(first.alias("first"), F.max(F.struct("did", "start")).alias("last"))
        .filter("first <> last")
        .select("k1", "k2", F.col("first.did").alias("first_did"), F.col("first.start").alias("first_start")),
        "repeated",
    )
    spans = (
        found.join(again, ["k1", "k2"])
        .filter("did <> first_did OR start <> first_start")
        .select("did", "tid", "start", "end", F.lit(False).alias("words"))
        .unionByName(repeated_windows(base).withColumn("words", F.lit(True)))
        .groupBy("did", "tid")
        .agg(F.collect_set(F.struct("start", "end", "words")).alias("spans"))
    )
    ready = base.join(spans, ["did", "tid"], "left").select("doc_id", "text", "spans")

    def places(text: str, spans: list | None) -> list[tuple[int, int]]:
        words = [w.span() for w in re.finditer(r"\S+", text)] if any(s["words"] for s in spans or []) else []
        return [(words[s["start"]][0], words[s["end"] - 1][1]) if s["words"] else (s["start"], s["end"]) for s in spans or []]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.struct([("start", pa.int32()), ("end", pa.int32())])
        for batch in small(batches):
            out = [remove(t, places(t, spans)) for t, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            gone = [[{"start": a, "end": b} for a, b in spans] for _, spans in out]
            columns = [batch.column(0), pa.array([t for t, _ in out], pa.string()), pa.array(gone, pa.list_(span))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "text", "removed"])

    return ready.mapInArrow(take, "doc_id long, text string, removed array<struct<start: int, end: int>>")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "removed", length.alias("n_removed"))
