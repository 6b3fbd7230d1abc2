"""LM scoring by a hierarchical Pitman-Yor model of words: a restaurant for each preceding word, all of which share
a parent; seating sampled by Gibbs, and predictive probabilities averaged over samples.

Documents are read in chunks of bounded size, each of which is one row of arrays. Words are 52-bit hashes. A
chunk counts its own pairs of words and sends each bucket of contexts what it has for it, as one array; a bucket
adds up what it gets. So all pairs are counted, but what moves is some bytes a distinct pair and chunk.

A sweep seats every customer of every restaurant anew, in two steps over tables: the buckets of contexts, given the
parent's word probabilities, then the buckets of words, which are the parent, given the tables that all restaurants order
from it. Probabilities of the parent are drawn from its posterior, so children and parent are
seated in turn, each given the other. Random numbers depend on the restaurant, the dish and the sweep only,
and what is one restaurant's is summed up before it is used, also where the restaurant is dealt to all buckets (by
the next word), as are those of words that are a large share of all contexts: so scores depend neither on the number of buckets
nor on the order of rows."""

from __future__ import annotations

import gc
from collections import defaultdict
from collections.abc import Iterator
from functools import cache, reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, discard, remainder, small, table, texts

BITS = 52
START, END = 0, 1  # hashes of what comes before a text's first word, and after its last
HOT_SHARE = 300  # a context of more than a 300th of all tokens is dealt to all buckets: there are at most 300
DISCOUNT, STRENGTH = 0.85, 1.0  # of contexts' restaurants
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 1.0  # of the parent, whose base is uniform over words seen and one unseen
SAMPLES, BURN_IN, SETTLE = 2, 2, 30  # sweeps that count; sweeps before them; steps to a first value of v
EXACT, NODES, POINTS = 1024, 97, 17  # exact weights of up to so many customers; points of an integral; of a curve


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as bytes, each one's bytes in planes, so that small numbers cost little."""
    head, body = [len(arrays)], []
    for a in arrays:
        head += [np.dtype(a.dtype).num, len(a)]
        body.append(np.ascontiguousarray(a).view(np.uint8).reshape(-1, a.dtype.itemsize).T.tobytes() if len(a) else b"")
    return zstandard.compress(np.array(head, dtype=np.int64).tobytes() + b"".join(body), 1)


def unpack(data: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(data), dtype=np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    head, at, out = raw[8 : 8 + 16 * n].view(np.int64), 8 + 16 * n, []
    kinds = {np.dtype(t).num: np.dtype(t) for t in (np.bool_, np.int32, np.uint32, np.int64, np.uint64, np.float32, np.float64)}
    for i in range(n):
        kind, size = kinds[int(head[2 * i])], int(head[2 * i + 1])
        part = raw[at : at + size * kind.itemsize].reshape(kind.itemsize, size)
        out.append(np.ascontiguousarray(part.T).view(kind).reshape(size))
        at += size * kind.itemsize
    return out


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets by ranges of hashes, so that sorted hashes are in the order of their buckets."""
    return ((hashes >> np.uint64(BITS - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def uniform(keys: np.ndarray, n: int) -> np.ndarray:
    """The n-th random number of each key, between 0 and 1."""
    step = np.uint64((n + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    return ((mixed(keys + step) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def gamma(shape: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """A number from the gamma distribution of each shape, which its key determines; by rejection, from normal
    numbers (Marsaglia and Tsang)."""
    a = np.where(shape < 1, shape + 1, shape) - 1 / 3
    out, left = np.zeros(len(a)), np.arange(len(a))
    for n in count(1, 3):
        if not len(left):
            break
        k = keys[left]
        z = np.sqrt(-2 * np.log(uniform(k, n))) * np.cos(2 * np.pi * uniform(k, n + 1))
        v = np.maximum(1 + z / np.sqrt(9 * a[left]), 0) ** 3
        taken = np.log(uniform(k, n + 2)) < z * z / 2 + a[left] * (1 - v + np.log(np.maximum(v, 1e-300)))
        out[left[taken]] = a[left[taken]] * v[taken]
        left = left[~taken]
    return out * np.where(shape < 1, uniform(keys, 0) ** (1 / np.minimum(shape, 1)), 1.0)


def tokenized(docs: DataFrame, chunk_bytes: int = 8 << 20) -> DataFrame:
    """chunk, data: the documents of docs (id, train, text as bytes) in chunks of about chunk_bytes of text,
    none of which spans tasks; data has ids (0 if null), whether each is not null, whether to learn from each, tokens in each, the tokens (words and
    an end) as numbers, and the sorted hashes they number. Also n, the number of tokens to learn from."""

    def chunked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, chunks = None, count()

        def fresh():
            return defaultdict(count().__next__), [], [], [], [], [], 0

        def finish(words, ids, named, train, sizes, tokens):
            hashes = np.fromiter((max(2, xxhash.xxh64_intdigest(w) >> (64 - BITS)) for w in words), dtype=np.uint64, count=len(words))
            known, place = np.unique(np.r_[np.array([START, END], dtype=np.uint64), hashes], return_inverse=True)
            flat = np.concatenate([np.r_[place[2:][t], 1] for t in tokens]) if tokens else np.zeros(0)
            learn, sizes = np.array(train, dtype=bool), np.array(sizes, dtype=np.int64)
            data = pack(np.array(ids, dtype=np.int64), np.array(named, dtype=bool), learn, sizes, flat.astype(np.int32), known)
            nonlocal number
            number = TaskContext.get().partitionId() << 24 if number is None else number
            row = [[number + next(chunks)], [data], [int(sizes[learn].sum())]]
            return pa.RecordBatch.from_arrays([pa.array(row[0]), pa.array(row[1], pa.binary()), pa.array(row[2])], names=["chunk", "data", "n"])

        words, ids, named, train, sizes, tokens, room = fresh()
        for batch in small(batches):
            for id_, learn, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = text.lower().split()
                tokens.append(np.fromiter(map(words.__getitem__, found), dtype=np.int64, count=len(found)))
                ids.append(id_ or 0)
                named.append(id_ is not None)
                train.append(learn)
                sizes.append(len(found) + 1)
                room += len(text) + 64
                if room >= chunk_bytes:
                    yield finish(words, ids, named, train, sizes, tokens)
                    words, ids, named, train, sizes, tokens, room = fresh()
        if ids:
            yield finish(words, ids, named, train, sizes, tokens)

    return docs.mapInArrow(chunked, "chunk long, data binary, n long")


class Pairs:
    """A chunk's distinct pairs of a context and the next token, dealt to buckets."""

    def __init__(self, data: bytes, buckets: int, hot: np.ndarray):
        self.ids, self.named, self.learn, self.sizes, self.tokens, self.hashes = unpack(data)
        before = np.r_[np.int32(0), self.tokens[:-1]]
        starts = np.cumsum(self.sizes) - self.sizes
        before[starts] = 0
        self.before, self.starts = before, starts
        self.train = np.repeat(self.learn, self.sizes)
        n = len(self.hashes)
        keys, self.pair = np.unique(before.astype(np.int64) * n + self.tokens, return_inverse=True)
        self.context, self.word = keys // n, keys % n
        self.own = np.bincount(self.pair[self.train], minlength=len(keys)).astype(np.int64)
        spread = np.isin(self.hashes[self.context], hot)
        place = np.where(spread, bucket_of(self.hashes[self.word], buckets), bucket_of(self.hashes[self.context], buckets))
        self.order = np.argsort(place, kind="stable")
        ends = np.searchsorted(place[self.order], np.arange(buckets + 1))
        self.slices = [(b, self.order[ends[b] : ends[b + 1]]) for b in range(buckets) if ends[b] < ends[b + 1]]

    def runs(self, rows: np.ndarray) -> np.ndarray:
        """Where each context's pairs start in a slice."""
        return np.flatnonzero(np.r_[True, np.diff(self.context[rows]) != 0])


@cache
def _stirling(discount: float) -> np.ndarray:
    """log S(c, t) for 1 <= t <= c <= EXACT, rows one after the other: S counts ways to seat c customers at t
    tables, each weighted by its tables' sizes, S(c + 1, t) = S(c, t - 1) + (c - discount * t) * S(c, t)."""
    rows, t = [np.zeros(1)], np.arange(1, EXACT + 1)
    for c in range(1, EXACT):
        stay = rows[-1] + np.log(c - discount * t[:c])
        rows.append(np.r_[stay[0], np.logaddexp(rows[-1][:-1], stay[1:]), 0.0])
    return np.concatenate(rows)


def log_factorial(t: np.ndarray) -> np.ndarray:
    """log(t!), by the series for t + 9, to 14 digits."""
    x = t + 9.0
    series = (x - 0.5) * np.log(x) - x + np.log(2 * np.pi) / 2 + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5) - 1 / (1680 * x**7)
    return series - sum(np.log(t + k) for k in range(1, 9))


def log_stirling(c: np.ndarray, t: np.ndarray, discount: float) -> np.ndarray:
    """log(S(c, t) * t! / c!) for large c, t of one or more, not only whole: the coefficient of z^c in phi(z)^t,
    phi(z) = (1 - (1 - z)^discount) / discount, as an integral over s, z = exp(-s / c), along a parabola through
    the saddle; a sum over NODES points of it."""
    low, high = np.full(c.shape, -60.0), np.full(c.shape, np.log(60.0))  # of log(s / c)
    for _ in range(50):
        mid = (low + high) / 2
        gone = -np.expm1(-np.exp(mid))
        more = t * np.exp(-np.exp(mid)) * gone ** (discount - 1) * discount > c * -np.expm1(discount * np.log(gone))
        low, high = np.where(more, mid, low), np.where(more, high, mid)
    peak = np.maximum(2.0, c * np.exp(low))
    y = np.linspace(-7.0, 7.0, NODES)
    u = y / np.sqrt(1 + 2 * discount * (1 - discount) * peak)[..., None]
    s = peak[..., None] * (1 + 1j * u) ** 2
    f = s + t[..., None] * (np.log1p(-((-np.expm1(-s / c[..., None])) ** discount)) - np.log(discount))
    top = f.real.max(axis=-1)
    area = (np.exp(f - top[..., None]) * (1 + 1j * u)).real.sum(axis=-1) * (y[1] - y[0]) * (u[..., -1] / y[-1])
    return top + np.log(np.maximum(area, 1e-300) * peak / (np.pi * c))


class Dishes:
    """Numbers of tables t of dishes with c customers each, in proportion to x^t * S(c, t): all t of those of up to
    EXACT customers, of others the t around the most likely one (10 deviations and more)."""

    def __init__(self, c: np.ndarray, discount: float):
        self.c, self.discount = c, discount
        self.small, self.large = np.flatnonzero(c <= EXACT), np.flatnonzero(c > EXACT)
        n = c[self.small]
        self.ends = np.cumsum(n)
        self.first = self.ends - n
        self.t = np.arange(n.sum()) - np.repeat(self.first, n) + 1
        self.log = _stirling(discount)[np.repeat(n * (n - 1) // 2, n) + self.t - 1]

    def _small(self, x: np.ndarray) -> np.ndarray:
        n, log = self.c[self.small], self.log + self.t * np.repeat(np.log(x[self.small]), self.c[self.small])
        return np.exp(log - np.repeat(np.maximum.reduceat(log, self.first), n))

    def _large(self, x: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of each large dish its place, the t and their weights: logs at Chebyshev points, between them the polynomial."""
        for lo in range(0, len(self.large), 256):
            at = self.large[lo : lo + 256]
            c, x_ = self.c[at].astype(float), x[at]
            low, high = np.full(len(at), -60.0), np.zeros(len(at))  # of log(1 - z), z the saddle of exp(x * phi(z)) / z^c
            for _ in range(50):
                mid = (low + high) / 2
                more = np.log(x_) + np.log1p(-np.minimum(np.exp(mid), 1 - 1e-16)) + (self.discount - 1) * mid > np.log(c)
                low, high = np.where(more, mid, low), np.where(more, high, mid)
            likely = np.clip(x_ * -np.expm1(self.discount * low) / self.discount, 1, c)
            wide = 10 * np.sqrt(likely) + 20
            a, b = np.maximum(1, np.floor(likely - wide)), np.minimum(c, np.ceil(likely + wide))
            nodes = np.cos(np.pi * (np.arange(POINTS) + 0.5) / POINTS)
            where = (a + b)[:, None] / 2 + (b - a)[:, None] / 2 * nodes
            values = log_stirling(np.broadcast_to(c[:, None], where.shape), where, self.discount)
            shape = np.polynomial.chebyshev.chebvander(nodes, POINTS - 1)
            curves = np.linalg.solve(shape, values.T)
            for k, i in enumerate(at):
                t = np.arange(a[k], b[k] + 1)
                place = (2 * t - a[k] - b[k]) / max(1.0, b[k] - a[k])
                log = np.polynomial.chebyshev.chebval(place, curves[:, k]) + t * np.log(x_[k]) - log_factorial(t)
                yield i, t, np.exp(log - log.max())

    def moments(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        mean, var = np.zeros(len(x)), np.zeros(len(x))
        if len(self.small):
            w = self._small(x)
            add = lambda v: np.add.reduceat(v, self.first)
            total = add(w)
            mean[self.small] = add(w * self.t) / total
            var[self.small] = add(w * (self.t - np.repeat(mean[self.small], self.c[self.small])) ** 2) / total
        for i, t, w in self._large(x):
            mean[i] = (w * t).sum() / w.sum()
            var[i] = (w * (t - mean[i]) ** 2).sum() / w.sum()
        return mean, var

    def draw(self, x: np.ndarray, chance: np.ndarray) -> np.ndarray:
        """One number of tables for each dish, by a number between 0 and 1 for each."""
        out = np.ones(len(x), dtype=np.int64)
        if len(self.small):
            sums = np.cumsum(self._small(x))
            low = np.r_[0.0, sums][self.first]
            at = np.searchsorted(sums, low + (sums[self.ends - 1] - low) * chance[self.small], side="right")
            out[self.small] = self.t[np.clip(at, self.first, self.ends - 1)]
        for i, t, w in self._large(x):
            sums = np.cumsum(w)
            out[i] = t[min(len(t) - 1, np.searchsorted(sums, sums[-1] * chance[i], side="right"))]
        return out


def newton(v: np.ndarray, mean: np.ndarray, var: np.ndarray, discount: float, strength: float) -> np.ndarray:
    """The next v on the way to the one that the tables it lets expect would give; mean and var of the tables."""
    now = strength / discount + mean
    return v * np.exp(np.clip(np.log(now / v) / np.maximum(1 - var / now, 0.02), -2, 2))


def settled(v: np.ndarray, dishes: Dishes, context: np.ndarray, base: np.ndarray, alone: np.ndarray, which: np.ndarray) -> np.ndarray:
    """v of the restaurants `which` (a mask), by Newton's steps; alone are the tables of each one's other dishes."""
    if not which.any() or not len(context):
        return v
    total = lambda t: np.bincount(context, weights=t, minlength=len(v))
    for _ in range(SETTLE):
        mean, var = dishes.moments(v[context] * DISCOUNT * base)
        now = np.where(which, newton(v, alone + total(mean), total(var), DISCOUNT, STRENGTH), v)
        done = np.abs(np.log(now / v)).max() < 0.01
        v = now
        if done:
            break
    return v


_SCHEMA = "kind int, to long, frm long, data binary, a double, b double, c double"
#: What rows hold: pairs sent to a bucket; a bucket's restaurants; where a chunk's pairs are in them; tables ordered from
#: the parent; its answer, the words' customers and tables; its words and their counts; its seating in a sample; words a chunk asks
#: for; sums; answers to chunks, of pairs and of words; the seating of a bucket's restaurants.
_PAIRS, _STATE, _PLACES, _ORDER, _BASE, _COUNTS, _SEATED, _ASK, _TOTAL, _REPLY, _WORDS, _SEATS = range(12)
_ROOT, _MASS = -1, -2  # in `to` of sums: the parent's, others are of the context of that hash


def _rows(rows: list[tuple]) -> pa.Table:
    """Rows of kind, to, from and data, and of up to three sums."""
    columns = list(zip(*(r + (0.0,) * (7 - len(r)) for r in rows), strict=True)) if rows else [()] * 7
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["kind", "to", "frm", "data", "a", "b", "c"])


def _parts(rows: pa.Table, kind: int) -> list[tuple[int, list[np.ndarray]]]:
    """The rows of a kind, by where they are from."""
    found = [(f, d) for k, f, d in zip(rows["kind"].to_pylist(), rows["frm"].to_pylist(), rows["data"].to_pylist(), strict=True) if k == kind]
    return [(f, unpack(d)) for f, d in sorted(found, key=lambda x: x[0])]


def _keys(hashes: np.ndarray, sweep: int) -> np.ndarray:
    return mixed(hashes + np.uint64(sweep << BITS))


def _steps(sorted_: np.ndarray) -> np.ndarray:
    return np.diff(np.r_[np.zeros(1, dtype=sorted_.dtype), sorted_])


def _by_bucket(words: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    ends = np.searchsorted(bucket_of(words, buckets), np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield b, slice(ends[b], ends[b + 1])


#: Whether Spark removes a query's shuffle files when it ends.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def release(spark: SparkSession) -> None:
    """Lets Spark remove shuffle files that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """cut(), after which the shuffle files of what led to the table are removed: nothing needs them any more."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEAN, "false")
    conf.set(_CLEAN, "true")
    try:
        return cut(df, name)
    finally:
        conf.set(_CLEAN, before)


class Seating:
    """A model's settings, and what its steps over tables do in each bucket (grouped Arrow functions)."""

    def __init__(self, word_buckets: int, hot: np.ndarray):
        self.word_buckets, self.hot = word_buckets, hot

    def merge(self, key, rows):
        """Adds up what chunks send a bucket of contexts: its restaurants, and where each chunk's pairs are in them."""
        bucket = key[0].as_py()
        parts = _parts(rows, _PAIRS)
        u = np.concatenate([np.repeat(p[0], p[1]) for _, p in parts])
        w = np.concatenate([p[2] for _, p in parts])
        own = np.concatenate([p[3] for _, p in parts]).astype(np.int64)
        order = np.lexsort((w, u))
        us, ws = u[order], w[order]
        new = np.r_[True, (us[1:] != us[:-1]) | (ws[1:] != ws[:-1])]
        place = np.empty(len(u), dtype=np.int64)
        place[order] = np.cumsum(new) - 1
        starts = np.flatnonzero(new)
        c = np.add.reduceat(own[order], starts)
        contexts, context, lengths = np.unique(us[starts], return_inverse=True, return_counts=True)
        words, word = np.unique(ws[starts], return_inverse=True)
        state = pack(_steps(contexts), lengths.astype(np.int32), _steps(words), word.astype(np.uint32), c.astype(np.uint32))
        out, at = [(_STATE, bucket, bucket, state)], 0
        for chunk, p in parts:
            out.append((_PLACES, bucket, chunk, pack(_steps(place[at : at + len(p[2])]).astype(np.uint32))))
            at += len(p[2])
        kinds, counts = np.bincount(word[c > 0], minlength=len(words)), np.bincount(word, weights=c, minlength=len(words))
        real = np.flatnonzero(kinds)
        for b, some in _by_bucket(words[real], self.word_buckets):
            some = real[some]
            out.append((_ORDER, b, bucket, pack(_steps(words[some]), kinds[some].astype(np.uint32), counts[some].astype(np.uint32))))
        customers = np.bincount(context, weights=c, minlength=len(contexts))
        start = np.bincount(context, weights=c**0.7, minlength=len(contexts))
        for k in np.flatnonzero(np.isin(contexts, self.hot)).tolist():
            out.append((_TOTAL, int(contexts[k]), bucket, b"", float(customers[k]), float(start[k])))
        return _rows(out)

    def first(self, key, rows):
        """A bucket of words before the first sweep: each context that a word occurs in is a customer of the parent."""
        bucket = key[0].as_py()
        parts = [(f, np.cumsum(p[0], dtype=np.uint64), p[1:]) for f, p in _parts(rows, _ORDER)]
        words, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        kinds, counts = (np.bincount(place, weights=np.concatenate([p[2][k] for p in parts]), minlength=len(words)).astype(np.int64) for k in range(2))
        out, at = [(_COUNTS, bucket, bucket, pack(_steps(words), counts.astype(np.uint32)))], 0
        for frm, hashes, _ in parts:
            mine = place[at : at + len(hashes)]
            out.append((_BASE, frm, bucket, pack(kinds[mine].astype(np.uint32), np.ones(len(mine), dtype=np.uint32), _steps(mine).astype(np.uint32))))
            at += len(mine)
        out.append((_TOTAL, _ROOT, bucket, b"", float(kinds.sum()), float((kinds**0.7).sum()), float(len(words))))
        out.append((_TOTAL, _MASS, bucket, b"", float((kinds - ROOT_DISCOUNT).sum()), float(counts.sum())))
        return _rows(out)

    def children(self, sweep: int, totals: dict):
        """The step that seats the restaurants of a bucket of contexts. totals: v of hot contexts, and of the parent the mass
        of its words, that of its own base, and the number of words."""

        def run(key, rows):
            bucket = key[0].as_py()
            contexts, lengths, words, word, c = _parts(rows, _STATE)[0][1]
            contexts, words = np.cumsum(contexts, dtype=np.uint64), np.cumsum(words, dtype=np.uint64)
            told = _parts(rows, _BASE)
            context = np.repeat(np.arange(len(contexts)), lengths)
            real = np.flatnonzero(np.bincount(word[c > 0], minlength=len(words)))
            customers, seats = (np.concatenate([p[k] for _, p in told]).astype(np.int64) if told else np.zeros(0) for k in range(2))
            mass = np.zeros(len(words))
            if sweep == 0:
                places = [p[2] for _, p in told]
                t_sum, sampled = np.zeros(len(c), dtype=np.uint32), [np.zeros(len(contexts), dtype=np.uint32)] * SAMPLES
                mass[real] = customers - ROOT_DISCOUNT
            else:
                t_sum, before, *more = _parts(rows, _SEATS)[0][1]
                sampled, places = more[:SAMPLES], more[SAMPLES:]
                mass[real] = gamma(customers - ROOT_DISCOUNT * seats, _keys(words[real], sweep - 1))
            base = (mass + totals["rest"] / (totals["words"] + 1)) / (totals["mass"] + totals["rest"])
            several = np.flatnonzero(c > 1)
            where, x = context[several], DISCOUNT * base[word[several]]
            dishes = Dishes(c[several].astype(np.int64), DISCOUNT)
            alone = np.bincount(context[c == 1], minlength=len(contexts)).astype(float)
            spread = np.isin(contexts, self.hot)
            place = np.searchsorted(self.hot, contexts[spread])
            if sweep == 0:
                v = STRENGTH / DISCOUNT + np.maximum(alone, 1) + np.bincount(where, minlength=len(contexts))
                v[spread] = totals["v"][place]
                v = settled(v, dishes, where, base[word[several]], alone, ~spread)
            else:
                v = gamma(STRENGTH / DISCOUNT + before, _keys(contexts, sweep))
                v[spread] = totals["v"][place]
            x = v[where] * x
            t = (c > 0).astype(np.uint32)
            t[several] = dishes.draw(x, uniform(mixed(contexts[where] * np.uint64(0x9E3779B97F4A7C15) + words[word[several]]), sweep))
            tables = np.bincount(context, weights=t, minlength=len(contexts)).astype(np.uint32)
            if sweep >= BURN_IN:
                t_sum = t_sum + t
                sampled[sweep - BURN_IN] = tables
            out = [(_SEATS, bucket, bucket, pack(t_sum, tables, *sampled, *places))]
            ordered = np.bincount(word, weights=t, minlength=len(words)).astype(np.uint32)
            for (b, some), steps in zip(_by_bucket(words[real], self.word_buckets), places, strict=True):
                out.append((_ORDER, b, bucket, pack(steps, ordered[real[some]])))
            if spread.any():
                mean, var = alone.copy(), np.zeros(len(contexts))
                if sweep < BURN_IN and (mine := np.flatnonzero(spread[where])).size:
                    m, s = Dishes(c[several][mine].astype(np.int64), DISCOUNT).moments(x[mine])
                    mean += np.bincount(where[mine], weights=m, minlength=len(contexts))
                    var += np.bincount(where[mine], weights=s, minlength=len(contexts))
                for k in np.flatnonzero(spread).tolist():
                    out.append((_TOTAL, int(contexts[k]), bucket, b"", float(mean[k]), float(var[k]), float(tables[k])))
            return _rows(out)

        return run

    def parent(self, sweep: int, v: float, n_words: float):
        """The step that seats a bucket of words in the parent, and draws the words' mass in its posterior."""

        def run(key, rows):
            bucket = key[0].as_py()
            words = np.cumsum(_parts(rows, _COUNTS)[0][1][0], dtype=np.uint64)
            parts = [(f, np.cumsum(steps, dtype=np.int64), n) for f, (steps, n) in _parts(rows, _ORDER)]
            place = np.concatenate([at for _, at, _ in parts])
            customers = np.bincount(place, weights=np.concatenate([n for *_, n in parts]), minlength=len(words)).astype(np.int64)
            several = np.flatnonzero(customers > 1)
            x = np.full(len(several), v * ROOT_DISCOUNT / (n_words + 1))
            dishes = Dishes(customers[several], ROOT_DISCOUNT)
            keys = _keys(words, sweep)
            t = (customers > 0).astype(np.int64)
            t[several] = dishes.draw(x, uniform(keys[several], 50))
            mass = gamma(customers - ROOT_DISCOUNT * t, keys)
            out = [(_BASE, frm, bucket, pack(customers[at].astype(np.uint32), t[at].astype(np.uint32))) for frm, at, _ in parts]
            mean, var = dishes.moments(x) if sweep < BURN_IN else (np.zeros(1), np.zeros(1))
            out.append((_TOTAL, _ROOT, bucket, b"", float(mean.sum() + (customers == 1).sum()), float(var.sum()), float(t.sum())))
            out.append((_TOTAL, _MASS, bucket, b"", float(mass.sum()), float(customers.sum())))
            if sweep >= BURN_IN:
                out.append((_SEATED, bucket, sweep, pack(customers.astype(np.uint32), t.astype(np.uint32))))
            return _rows(out)

        return run

    def answers(self, key, rows):
        """A bucket's restaurants, to the chunks whose pairs are in them: customers and tables of contexts and pairs."""
        bucket = key[0].as_py()
        _, lengths, _, _, c = _parts(rows, _STATE)[0][1]
        t_sum, _, *sampled = _parts(rows, _SEATS)[0][1]
        sampled = sampled[:SAMPLES]
        context = np.repeat(np.arange(len(lengths)), lengths)
        totals = [np.bincount(context, weights=c, minlength=len(lengths)).astype(np.uint32), *sampled]
        out = []
        for chunk, (steps,) in _parts(rows, _PLACES):
            at = np.cumsum(steps, dtype=np.int64)
            heads = np.unique(context[at])
            out.append((_REPLY, chunk, bucket, pack(*(x[heads] for x in totals), c[at], t_sum[at])))
        return _rows(out)

    def words(self, key, rows):
        """A bucket of words, to the chunks that ask: counts, and customers and tables in the parent in each sample."""
        bucket = key[0].as_py()
        asked = [(f, np.cumsum(p[0], dtype=np.uint64)) for f, p in _parts(rows, _ASK)]
        known = [x for _, p in _parts(rows, _COUNTS) for x in p]
        out = []
        for chunk, hashes in asked:
            reply = [np.zeros(len(hashes), dtype=np.uint32) for _ in range(1 + 2 * SAMPLES)]
            if known:
                words = np.cumsum(known[0], dtype=np.uint64)
                i = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
                found = words[i] == hashes
                reply = [np.where(found, x[i], 0).astype(np.uint32) for x in (known[1], *(x for _, p in _parts(rows, _SEATED) for x in p))]
            out.append((_WORDS, chunk, bucket, pack(*reply)))
        return _rows(out)


def _sums(df: DataFrame) -> dict[int, tuple[float, float, float]]:
    """The sums by what they are of: the parent, its mass, and some hundred contexts at most."""
    found = df.filter(F.col("kind") == _TOTAL).groupBy("to").agg(*(F.sum(x).alias(x) for x in "abc"))
    return {r["to"]: (r["a"], r["b"], r["c"]) for r in found.collect()}


def _one(shape: float, key: int) -> float:
    return float(gamma(np.array([shape]), mixed(np.array([key], dtype=np.uint64)))[0])


def scores(docs: DataFrame, train, tokens_per_bucket: int = 300_000, least_buckets: int = 8, chunk_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score: one row per row of docs, in which the
    column expression `train` says what to learn from.

    Tokens are a text's words, A-Z lower-cased, and one end. score is the model's log10 probability of them,
    the average over SAMPLES seatings of p(word | word before); base_score the add-one unigram one, n_known
    the tokens that occur in what was learned from, train_tokens their number there.

    Blocked Gibbs: given v, drawn from a gamma distribution of shape strength / discount + a restaurant's tables, its
    dishes are independent, and t tables of a dish of c customers are in proportion to (v * discount * base)^t * S(c, t).
    Sweeps start where v is what its tables let expect, found by Newton's steps, within the first sweep, or where a restaurant
    is dealt to all buckets, one after each sweep of the burn-in but the last.

    Null texts are empty: one token, the end. Null ids come back null. Repeated rows count each. Nothing to
    learn from leaves a uniform model of one word. An empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = texts(docs, train.alias("train")).select("doc_id", "train", F.col("text").cast("binary").alias("text"))
    chunks = cut(tokenized(rows, chunk_bytes), "chunks")
    total = chunks.agg(F.sum("n")).first()[0] or 0
    buckets = int(max(least_buckets, -(-total // tokens_per_bucket)))
    parts = max(1, -(-buckets // 2))

    def common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                _, _, learn, sizes, tokens, hashes = unpack(data)
                before = np.r_[np.int32(0), tokens[:-1]]
                before[np.cumsum(sizes) - sizes] = 0
                n = np.bincount(before[np.repeat(learn, sizes)], minlength=len(hashes))
                often = np.flatnonzero(n > n.sum() // (2 * HOT_SHARE))
                yield pa.RecordBatch.from_arrays([pa.array(hashes[often].astype(np.int64)), pa.array(n[often].astype(np.int64))], names=["h", "n"])

    often = chunks.select("data").mapInArrow(common, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") > total / HOT_SHARE)
    hot = np.array(sorted(r["h"] for r in often.select("h").collect()), dtype=np.uint64)
    word_buckets = max(least_buckets, buckets // 8)  # fewer, so that the parent's messages are few and not small
    model = Seating(word_buckets, hot)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                p = Pairs(data, buckets, hot)
                rows = []
                for b, at in p.slices:
                    runs = p.runs(at)
                    lengths = np.diff(np.r_[runs, len(at)]).astype(np.int32)
                    rows.append((_PAIRS, b, chunk, pack(p.hashes[p.context[at[runs]]], lengths, p.hashes[p.word[at]], p.own[at].astype(np.uint32))))
                yield from _rows(rows).to_batches()

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = unpack(data)[5]
                yield from _rows([(_ASK, b, chunk, pack(_steps(hashes[some]))) for b, some in _by_bucket(hashes, word_buckets)]).to_batches()

    def grouped(df: DataFrame, step) -> DataFrame:
        return df.repartition(parts, "to").groupBy("to").applyInArrow(lambda key, rows: step(key, rows), _SCHEMA)

    of = lambda df, *kinds: df.filter(F.col("kind").isin(*kinds))
    merged = written(grouped(chunks.select("chunk", "data").mapInArrow(send, _SCHEMA), model.merge), "merged")
    release(spark)
    counted = written(grouped(of(merged, _ORDER), model.first), "counted")
    found, start = _sums(counted), _sums(merged)
    kinds, start_root, n_words = found.get(_ROOT, (0.0, 0.0, 0.0))
    mass, n_train, _ = found.get(_MASS, (0.0, 0.0, 0.0))
    v = STRENGTH / DISCOUNT + np.array([start[int(h)][1] for h in hot])
    v_root, rest = ROOT_STRENGTH / ROOT_DISCOUNT + start_root, ROOT_STRENGTH + ROOT_DISCOUNT * n_words
    state, known, seated, samples = of(merged, _STATE), of(counted, _COUNTS), [of(counted, _COUNTS)], []
    seats, base, rooted_samples = of(merged, _SEATS), counted, []
    for sweep in range(BURN_IN + SAMPLES):
        told = {"v": v, "mass": mass, "rest": rest, "words": n_words}
        all_of = state.unionByName(of(seats, _SEATS)).unionByName(of(base, _BASE))
        swept = written(grouped(all_of, model.children(sweep, told)), "swept")
        rooted = written(grouped(of(swept, _ORDER).unionByName(known), model.parent(sweep, v_root, n_words)), "rooted")
        release(spark)
        if sweep:  # the tables of counted, and of the samples' words, are read again at the end
            discard(seats, *([base] if sweep <= BURN_IN else []))
        now, root = _sums(swept), _sums(rooted)
        mean, var, tables = root.get(_ROOT, (0.0, 0.0, 0.0))
        mass, customers, _ = root.get(_MASS, (0.0, 0.0, 0.0))
        key = (sweep + 1) << BITS
        rest = _one(ROOT_STRENGTH + ROOT_DISCOUNT * tables, key)
        if sweep < BURN_IN - 1:
            v_root = float(newton(np.array([v_root]), np.array([mean]), np.array([var]), ROOT_DISCOUNT, ROOT_STRENGTH)[0])
            moments = np.array([now[int(h)][:2] for h in hot]).reshape(-1, 2).T
            v = newton(v, *moments, DISCOUNT, STRENGTH)
        else:
            v_root = _one(ROOT_STRENGTH / ROOT_DISCOUNT + tables, key + 1)
            v = gamma(STRENGTH / DISCOUNT + np.array([now[int(h)][2] for h in hot]), mixed(hot + np.uint64(key)))
        if sweep >= BURN_IN:
            samples.append((customers, tables, {int(h): now[int(h)][2] for h in hot}))
            seated.append(of(rooted, _SEATED))
            rooted_samples.append(rooted)
        seats, base = swept, rooted
    hot_totals = np.array([[start[int(h)][0], *(s[2][int(h)] for s in samples)] for h in hot]).reshape(-1, 1 + SAMPLES)

    def judge(key, chunk, replies):
        names = ["doc_id", "train", "n_tokens", "n_known", "score", "base_score"]
        p = Pairs(chunk["data"][0].as_py(), buckets, hot)
        n = len(p.hashes)
        got = dict(_parts(replies, _REPLY))
        c, t = np.zeros(len(p.own)), np.zeros(len(p.own))
        c_context, t_context = np.zeros(n), np.zeros((SAMPLES, n))
        for b, at in p.slices:
            *contexts, c_here, t_here = got[b]
            heads = p.context[at[p.runs(at)]]
            c_context[heads] = contexts[0]
            t_context[:, heads] = contexts[1:]
            c[at], t[at] = c_here, t_here / SAMPLES
        if len(hot):
            i = np.minimum(np.searchsorted(hot, p.hashes), len(hot) - 1)
            is_hot = hot[i] == p.hashes
            c_context[is_hot] = hot_totals[i[is_hot], 0]
            t_context[:, is_hot] = hot_totals[i[is_hot], 1:].T
        columns = np.concatenate([np.stack(d) for _, d in _parts(replies, _WORDS)], axis=1).astype(np.float64)
        counts = columns[0]
        below = STRENGTH + c_context
        owned = np.maximum(c - DISCOUNT * t, 0.0) / below[p.context]
        shared = np.zeros(len(c))
        for s, (customers, tables, _) in enumerate(samples):
            down = ROOT_STRENGTH + customers
            ours, theirs = columns[1 + 2 * s], columns[2 + 2 * s]
            root = (np.maximum(ours - ROOT_DISCOUNT * theirs, 0.0) + (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (n_words + 1)) / down
            back = (STRENGTH + DISCOUNT * t_context[s]) / below
            shared += back[p.context] * root[p.word] / SAMPLES
        likely = np.log10(owned + shared)[p.pair]
        plain = np.log10((counts + 1) / (n_train + n_words + 1))[p.tokens]
        add = lambda x: np.add.reduceat(x, p.starts) if len(p.starts) else x
        known = add((counts[p.tokens] > 0).astype(np.int64))
        ids = pa.array(p.ids, mask=~p.named)
        return pa.table([ids, pa.array(p.learn), pa.array(p.sizes), pa.array(known), pa.array(add(likely)), pa.array(add(plain))], names=names)

    asked = chunks.select("chunk", "data").mapInArrow(ask, _SCHEMA)
    told = written(grouped(reduce(DataFrame.unionByName, seated, asked), model.words), "told")
    replies = written(grouped(of(merged, _STATE, _PLACES).unionByName(of(seats, _SEATS)), model.answers), "replies")
    release(spark)
    discard(merged, counted, seats, base, *rooted_samples)
    replies = replies.unionByName(told).withColumnRenamed("to", "chunk")
    scored = (
        chunks.select("chunk", "data")
        .groupBy("chunk")
        .cogroup(replies.groupBy("chunk"))
        .applyInArrow(judge, "doc_id long, train boolean, n_tokens long, n_known long, score double, base_score double")
    )
    return scored.select("doc_id", "train", "n_tokens", "n_known", F.lit(int(n_train)).cast("long").alias("train_tokens"), "base_score", "score")


def op3_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = remainder(F.col("doc_id"), 7) == 2
    found = scores(table(spark, sf_dir, "documents"), ~held_out)
    return found.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
