"""The Pitman-Yor model's seating against exact distributions, and its scores against a plain sampler."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.llm import lm


def chain(c, base, discount, strength, sweeps):
    """Tables of many restaurants of one dish each, after sweeps that take v and tables in turn."""
    n = np.full(1, c).repeat(len(base))
    dishes, t, keys = lm.Dishes(n, discount), np.ones(len(base)), np.arange(len(base), dtype=np.uint64)
    for k in range(sweeps):
        v = lm.gamma(strength / discount + t, lm.mixed(keys + np.uint64(k << 40)))
        t = dishes.draw(v * discount * base, lm.uniform(keys, k))
    return t


def test_seating_fits_the_exact_posterior():
    """Tables of one dish of four customers, by all ways to seat them."""
    d, s, base, c, n = 0.4, 2.0, 0.3, 4, 60_000
    weights = Counter()

    def arrange(sizes, w):
        if sum(sizes) == c:
            weights[len(sizes)] += w
            return
        for k in range(len(sizes)):
            arrange([*sizes[:k], sizes[k] + 1, *sizes[k + 1 :]], w * (sizes[k] - d))
        arrange([*sizes, 1], w * (s + d * len(sizes)) * base)

    arrange([1], s * base)
    exact = {t: w / sum(weights.values()) for t, w in weights.items()}
    got = chain(c, np.full(n, base), d, s, 15)
    for t, p in exact.items():
        assert abs((got == t).mean() - p) < 0.01


@pytest.mark.parametrize("base", [0.02, 0.4])
def test_all_customers_of_frequent_dishes_are_seated(base):
    """Tables of one dish of 3000 customers, by the recurrence over customers."""
    d, s, c, n = 0.85, 1.0, 3000, 400
    logs = np.zeros(1)
    for k in range(1, c):
        stay = logs + np.log(k - d * np.arange(1, k + 1))
        logs = np.r_[stay[0], np.logaddexp(logs[:-1], stay[1:]), 0.0]
    t = np.arange(1, c + 1)
    logs += np.cumsum(np.log((s + d * (t - 1)) * base))
    p = np.exp(logs - logs.max())
    p /= p.sum()
    mean = (p * t).sum()
    spread = np.sqrt((p * (t - mean) ** 2).sum())
    got = chain(c, np.full(n, base), d, s, 40)
    assert abs(got.mean() - mean) < 5 * spread / np.sqrt(n)


@pytest.mark.parametrize("shape", [0.4, 1.0, 3.5, 200.0])
def test_gamma(shape):
    got = lm.gamma(np.full(40_000, shape), lm.mixed(np.arange(40_000, dtype=np.uint64)))
    assert got.mean() == pytest.approx(shape, abs=5 * math.sqrt(shape / 40_000))
    assert got.var() == pytest.approx(shape, rel=0.1)


class Plain:
    """Two levels of restaurants with each customer at a table of its own, taken up and seated again one by one."""

    def __init__(self, texts, seed):
        self.rng = np.random.default_rng(seed)
        self.pairs = [(u, w) for t in texts for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)]
        self.words = len({w for _, w in self.pairs})
        self.low, self.root = defaultdict(lambda: defaultdict(list)), defaultdict(list)
        self.customers = Counter()
        for u, w in self.pairs:
            self.add(u, w)

    def base(self, w):
        n, t = sum(map(sum, self.root.values())), sum(map(len, self.root.values()))
        mine = self.root.get(w, [])
        return (sum(mine) - lm.ROOT_DISCOUNT * len(mine) + (lm.ROOT_STRENGTH + lm.ROOT_DISCOUNT * t) / (self.words + 1)) / (n + lm.ROOT_STRENGTH)

    def place(self, tables, discount, new):
        odds = np.array([s - discount for s in tables] + [new])
        return int(self.rng.choice(len(odds), p=odds / odds.sum()))

    def add(self, u, w):
        here = self.low[u]
        t = sum(map(len, here.values()))
        k = self.place(here[w], lm.DISCOUNT, (lm.STRENGTH + lm.DISCOUNT * t) * self.base(w))
        if k < len(here[w]):
            here[w][k] += 1
            return
        here[w].append(1)
        t = sum(map(len, self.root.values()))
        k = self.place(self.root[w], lm.ROOT_DISCOUNT, (lm.ROOT_STRENGTH + lm.ROOT_DISCOUNT * t) / (self.words + 1))
        if k < len(self.root[w]):
            self.root[w][k] += 1
        else:
            self.root[w].append(1)

    def take(self, tables):
        k = int(self.rng.choice(len(tables), p=np.array(tables) / sum(tables)))
        tables[k] -= 1
        if tables[k] == 0:
            del tables[k]
            return True
        return False

    def sweep(self):
        for u, w in self.pairs:
            if self.take(self.low[u][w]):
                self.take(self.root[w])
            self.add(u, w)

    def p(self, u, w):
        here = self.low.get(u, {})
        n, t = sum(map(sum, here.values())), sum(map(len, here.values()))
        mine = here.get(w, [])
        return (sum(mine) - lm.DISCOUNT * len(mine) + (lm.STRENGTH + lm.DISCOUNT * t) * self.base(w)) / (n + lm.STRENGTH)


@pytest.fixture(scope="module")
def corpus(spark):
    draw = np.random.default_rng(3)
    words = [f"w{k}" for k in range(25)]
    odds = 1 / np.arange(1, 26)
    texts = [list(draw.choice(words, draw.integers(1, 25), p=odds / odds.sum())) for _ in range(40)]
    texts += [["w0", "w1", "w2", "w0", "w1"]] * 4 + [["unseen", "w1", "w0"], []]
    df = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id long, text string")
    return texts, df


def test_scores_are_those_of_a_plain_sampler(corpus):
    """Documents' scores within four deviations of what a plain sampler gives with as many samples."""
    texts, df = corpus
    train = 44
    got = {r["doc_id"]: r["score"] for r in lm.scores(df, F.col("doc_id") < train).collect()}
    plain, runs = Plain(texts[:train], 1), []
    for _ in range(30):
        plain.sweep()
    for _ in range(100):
        likely = np.zeros(0)
        for _ in range(lm.SAMPLES):
            plain.sweep()
            some = np.array([plain.p(u, w) for t in texts for u, w in zip(["<s>", *t], [*t, "</s>"], strict=True)])
            likely = some if not len(likely) else likely + some
        logs = iter(np.log10(likely / lm.SAMPLES))
        runs.append([sum(next(logs) for _ in range(len(t) + 1)) for t in texts])
    runs = np.array(runs)
    mean, spread = runs.mean(axis=0), runs.std(axis=0)
    off = (np.array([got[k] for k in range(len(texts))]) - mean) / np.maximum(spread, 0.005)
    assert np.abs(off).max() < 4 and abs(off.mean()) < 1.5


def test_scores_do_not_depend_on_buckets_or_order(corpus):
    _, df = corpus
    runs = []
    for buckets, parts in ((8, 1), (64, 5)):
        rows = lm.scores(df.repartition(parts, "text"), F.col("doc_id") % 7 != 2, least_buckets=buckets, chunk_bytes=4000 // parts).collect()
        runs.append([r["score"] for r in sorted(rows, key=lambda r: r["doc_id"])])
    assert runs[0] == pytest.approx(runs[1], rel=1e-9)
