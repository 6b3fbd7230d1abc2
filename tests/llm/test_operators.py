"""Every training-data operator against a plain version of it, over awkward tables."""

from __future__ import annotations

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sparkloom.llm import decontaminate, fingerprints, language, line_dedup, lm, mixing, pii, quality, simhash_dedup, substring_dedup
from sparkloom.llm._shared import components

DDL = "doc_id long, text string, lang string, source string, n_chars long, did string, pos int, score double, _found string, copy int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows():
    """Nulls, empty and long texts, ties, repeated rows; extra columns with names that operators use inside."""
    base = "the quick brown fox jumps over the lazy dog near the river bank today and then it sleeps"
    texts = [
        (1, base + "\nshared line of text here\nunique one"),
        (2, "Shared LINE of text here \n" + base + "\nx"),
        (3, base + "\nshared line of text here\nunique one"),
        (4, None),
        (5, ""),
        (6, "   \n\t\n"),
        (7, "word " * 30_000),
        (7, "word " * 30_000),
        (8, base.upper() + " éÉ ñ 漢字"),
        (8, "another text of the same id"),
        (None, "no id here at all, my friend\nshared line of text here"),
        (9, "123 456 ... !!!"),
        (10, "one"),
    ]
    langs = itertools.cycle(["en", "en", None, "fr"])
    sources = itertools.cycle(["a", "b", None])
    return [(i, t, la, so, 1, "x", 2, 0.5, "y", 9) for (i, t), la, so in zip(texts, langs, sources)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), DDL)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DDL)


def fingerprint(text, n=4):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + n]) for i in range(len(words) - n + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def groups(prints, ids, radius):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= radius:
            root[find(j)] = find(i)
    out = {}
    for i in range(len(prints)):
        out.setdefault(find(i), []).append(ids[i])
    return [min((x for x in out[find(i)] if x is not None), default=None) for i in range(len(prints))]


def test_simhash(docs, empty):
    got = sorted(((r["doc_id"] or -1, r["f0"] & (2**64 - 1), r["component_id"]) for r in simhash_dedup.near_dedup(docs).collect()), key=str)
    prints = [fingerprint(r[1]) for r in rows()]
    ids = [r[0] for r in rows()]
    want = sorted(((i or -1, p, c) for i, p, c in zip(ids, prints, groups(prints, ids, 4), strict=True)), key=str)
    assert got == want
    assert simhash_dedup.near_dedup(empty).count() == 0


def test_blocks_of_any_number_give_the_same_components(spark, sf):
    all_ = spark.read.parquet(f"{sf}/documents.parquet")
    run = lambda n, **how: sorted(map(tuple, simhash_dedup.near_dedup(all_, block_rows=n, **how).select("doc_id", "component_id").collect()))
    assert run(20) == run(32768)
    wide = {"words": 5, "radius": 52, "lanes": 4, "share": 0.64}
    assert run(20, **wide) == run(32768, **wide)


def test_tiles_find_every_link():
    draw = np.random.default_rng(1)
    base = draw.integers(0, 2**63, 60, dtype=np.uint64)
    many = [int(b) ^ sum(1 << int(k) for k in draw.choice(64, draw.integers(0, 7), replace=False)) for b in base for _ in range(8)]
    many = sorted(set(many))
    grid = np.array(many, dtype=np.uint64)[:, None]
    for cutting in (None, len(many) // 3):
        left, right = (grid, None) if cutting is None else (grid[:cutting], grid[cutting:])
        parts = [(left, right)] if cutting is None else [(left, None), (right, None), (left, right)]
        shift = [0] if cutting is None else [0, cutting, 0]
        links = [(int(a) + s, int(b) + s) for (x, y), s in zip(parts, shift, strict=True) for a, b in zip(*simhash_dedup.near_links(x, y, 4), strict=True)]
        root = list(range(len(many)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        assert [many[find(i)] for i in range(len(many))] == groups(many, many, 4)


@pytest.mark.parametrize("chunk", [200, 1 << 16])
def test_size_tiles_find_every_link(monkeypatch, chunk):
    """Wide fingerprints whose links need sizes of a ratio of 0.8, within a block and between two."""
    monkeypatch.setattr(simhash_dedup, "_AT_ONCE", chunk)
    draw = np.random.default_rng(2)
    base = draw.integers(0, 2**63, (40, 4), dtype=np.uint64)
    noise = draw.integers(0, 2**63, (40, 7, 4, 3), dtype=np.uint64)
    noise = noise[..., 0] & noise[..., 1] & noise[..., 2] & (np.uint64(0) - draw.integers(0, 2, (40, 7, 4), dtype=np.uint64))
    grid = (base[:, None] ^ noise).reshape(-1, 4)
    n = np.r_[[4, 5, 8, 10, 1000, 1250, 1], draw.integers(1, 60, len(grid) - 7)].astype(np.int64)

    def near(i, j):
        return sum(int(x).bit_count() for x in grid[i] ^ grid[j]) <= 30 and 10 * min(n[i], n[j]) >= 8 * max(n[i], n[j])

    def roots(links):
        root = list(range(len(grid)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(grid))]

    want = roots((i, j) for i, j in itertools.combinations(range(len(grid)), 2) if near(i, j))
    assert 40 < len(set(want)) < len(grid)
    k = 100
    parts = [(slice(0, None), None, 0)], [(slice(0, k), None, 0), (slice(k, None), None, k), (slice(0, k), slice(k, None), 0)]
    for split in parts:
        links = []
        for a, b, shift in split:
            sizes = (n[a], None if b is None else n[b])
            found = simhash_dedup.near_links(grid[a], None if b is None else grid[b], 30, sizes, 0.8)
            links += [(int(x) + shift, int(y) + shift) for x, y in zip(*found, strict=True)]
        assert roots(links) == want


def test_blocks_cover_sizes():
    """Steps of size: pairs of sizes of a ratio of 0.8 are in blocks that are compared."""
    step = lambda n: math.floor(math.log(n) * (simhash_dedup.STEPS / -math.log(0.8)))
    cells = Counter((step(n), 0) for n in range(1, 3000))
    where, pairs = simhash_dedup._blocks(cells, 50, simhash_dedup.STEPS + 1)
    place = {lo: range(f, f + k) for lo, _, f, k in where}
    have = {frozenset((i, j)) for a, ka, b, kb in pairs for i in range(a, a + ka) for j in range(b, b + kb)}
    for n in (*range(1, 400), 2000):
        assert all(frozenset((i, j)) in have for i in place[step(n)] for j in place[step(math.floor(n / 0.8))])


def test_blocks_cover_all_near_cells():
    cells = {(a, b): 7 + a for a in range(10, 22) for b in range(10, 22)}
    where, pairs = simhash_dedup._blocks(cells, 40, 4)
    place = {(lo, hi): range(f, f + k) for lo, hi, f, k in where}
    have = {frozenset((i, j)) for a, ka, b, kb in pairs for i in range(a, a + ka) for j in range(b, b + kb)}
    for x, y in itertools.combinations_with_replacement(cells, 2):
        if abs(x[0] - y[0]) + abs(x[1] - y[1]) <= 4:
            assert all(frozenset((i, j)) in have for i in place[x] for j in place[y])


def test_components(spark):
    draw = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in draw.integers(0, 120, (90, 2))] + [(500 + i, 501 + i) for i in range(40)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    got, again = ({r["node"]: r["root"] for r in components(df, n).collect()} for n in (1 << 20, 30))
    assert got == again
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a != b:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert got == {n: find(n) for n in list(root)}


def test_drop_near(docs, empty):
    ids = sorted(r["doc_id"] or -1 for r in simhash_dedup.drop_near(docs).collect())
    assert ids.count(7) == 1 and 1 in ids and 3 not in ids and -1 in ids and 5 not in ids and 4 in ids
    assert simhash_dedup.drop_near(empty).count() == 0
    clash = docs.withColumn("_gone", F.lit("mine"))
    assert simhash_dedup.drop_near(clash).columns == clash.columns


def test_line_dedup(docs, empty):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first, holders = {}, {}
    for i, t, *_ in rows():
        i = 2**63 if i is None else i
        for line in (t or "").split("\n"):
            holders.setdefault(key(line), set()).add(i)
    first = {k: min(v) for k, v in holders.items() if len(k) >= 10 and len(v) > 1}
    want = []
    for i, t, *_ in rows():
        j = 2**63 if i is None else i
        lines = (t or "").split("\n")
        stay = [x for x in lines if first.get(key(x), j) == j]
        want.append((str(i), "\n".join(stay), len(lines), len(lines) - len(stay)))
    got = [(str(r["doc_id"]), r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup.line_dedup(docs).collect()]
    assert sorted(got) == sorted(want)
    assert line_dedup.line_dedup(empty).count() == 0


def test_decontaminate(spark, docs, empty):
    items = [(1, "The quick BROWN fox jumps, over the lazy dog near the river bank"), (2, "one"), (2, "unique one"), (3, None), (None, "漢字"), (4, "never to be found in any of the documents at all here")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = {}
    for i, t in items:
        w = word.findall((t or "").translate(LOWER))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + n]), set()).add("" if i is None else str(i))
    want = []
    for _, t, *_ in rows():
        w = word.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in windows:
                    hit |= set(range(k, k + n))
                    found |= windows[tuple(w[k : k + n])]
        want.append((len(w), len(hit), ",".join(sorted(found))))
    for block in (1 << 20, 100):  # in one block, and in several
        found, name = decontaminate.annotate(docs, bench, block_bytes=block)
        assert name not in docs.columns
        ids = F.array_join(F.array_sort(F.array_distinct(f"{name}.items")), ",")
        got = [tuple(r) for r in found.select(F.col(f"{name}.n_words"), decontaminate.hit_words(F.col(f"{name}.spans")), ids).collect()]
        assert sorted(got) == sorted(want)
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not h for _, h, _ in want)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == docs.count()


def test_longest_matches():
    """Against all pairs of places, on texts of few distinct words, so that windows and suffixes recur."""
    index = decontaminate.Suffixes([("a", b" ".join(b"w%d" % i for i in range(30)))], 10)
    text = b"x y " + b" ".join(b"w%d" % i for i in range(5, 25)) + b" z"
    assert decontaminate.search([text, b""], index) == [(23, [(2, 20)], [0], [(0, 2, 5, 20)]), (0, [], [], [])]
    draw = np.random.default_rng(8)
    some = lambda n: b" ".join(b"%c" % (97 + k) for k in draw.integers(0, 2, n))
    items = [("a", some(40)), ("b", some(25)), ("c", some(3)), ("d", b""), ("e", b"a " * 30)]
    texts = [some(n) for n in (60, 0, 2, 35)] + [b"zz " + b"a " * 50 + b"zz"]
    index = decontaminate.Suffixes(items, 4)
    item_words = [t.split() for _, t in items if t]
    for text, (n, spans, held, matches) in zip(texts, decontaminate.search(texts, index), strict=True):
        w, hit, want, longest = text.split(), set(), set(), []
        for i, x in enumerate(item_words):
            size = min(4, len(x))
            for p in range(len(x) - size + 1):
                for k in range(len(w) - size + 1):
                    if w[k : k + size] == x[p : p + size]:
                        hit |= set(range(k, k + size))
                        want.add(i)
        for k in range(len(w)):
            best = 0
            for x in item_words:
                for p in range(len(x)):
                    m = 0
                    while k + m < len(w) and p + m < len(x) and w[k + m] == x[p + m]:
                        m += 1
                    best = max(best, m)
            if any(w[k : k + min(4, len(x))] == x[p : p + min(4, len(x))] for x in item_words for p in range(len(x) - min(4, len(x)) + 1)):
                longest.append((k, best))
        reach, maximal = 0, []
        for k, m in longest:
            if k + m > reach:
                maximal.append((k, m))
                reach = k + m
        assert n == len(w) and {k for a, m in spans for k in range(a, a + m)} == hit and set(held) == want
        assert [(s, m) for _, s, _, m in matches] == maximal
        assert all(w[s : s + m] == item_words[i][p : p + m] for i, s, p, m in matches)


def test_repeated_words_and_much_test_text_stay_small():
    """A text and an item of one word 20,000 times, and two megabytes of distinct words as test text."""
    import tracemalloc

    tracemalloc.start()
    index = decontaminate.Suffixes([("a", b"word " * 20_000)], 10)
    ((n, spans, items, matches),) = decontaminate.search([b"word " * 20_000], index)
    assert (n, spans, items, matches) == (20_000, [(0, 20_000)], [0], [(0, 0, 0, 20_000)])
    assert tracemalloc.get_traced_memory()[1] < 100e6
    tracemalloc.reset_peak()
    decontaminate.Suffixes([(str(k), b" ".join(b"%d" % x for x in range(k * 20_000, k * 20_000 + 20_000))) for k in range(15)], 10)
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_mixing(spark, docs, empty):
    plan = mixing.mix_plan(docs).collect()
    size = {s: 0 for s in ("a", "b", None)}
    for _, t, _, s, *_ in rows():
        size[s] += len(WORD.findall(t or ""))
    names = ["a", "b", None]
    want = mixing.targets([size[s] for s in names])
    for r in plan:
        assert r["source_size"] == size[r["source"]]
        assert r["target"] == pytest.approx(want[names.index(r["source"])])
        assert 0 <= r["copies"] <= 3
    assert sum(want) == pytest.approx(sum(size.values()))
    assert sorted(map(str, plan)) == sorted(map(str, mixing.mix_plan(docs).collect()))
    taken = mixing.mix(docs)
    assert taken.columns == docs.columns and taken.count() == sum(r["copies"] for r in plan)
    assert mixing.mix_plan(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("sizes", [[100], [1, 1000, 1000], [0, 5, 7, 9], [10, 10, 10, 10, 10, 10, 1], []])
def test_targets(sizes):
    got = mixing.targets(sizes)
    assert sum(got) == pytest.approx(sum(sizes))
    assert all(t <= 3 * n + 1e-9 for t, n in zip(got, sizes, strict=True))


def test_mixing_is_systematic(spark):
    many = spark.createDataFrame([(i, "w " * (1 + i % 50), "s%d" % (i % 7 == 0)) for i in range(3000)], "doc_id long, text string, source string")
    by = {}
    for r in mixing.mix_plan(many.repartition(7)).collect():
        got = by.setdefault(r["source"], [r["target"], r["source_size"], 0, []])
        got[2] += r["copies"] * r["size"]
        got[3].append((r["size"], r["doc_id"], r["copies"]))
    offset = lambda name: int(hashlib.sha256(b"42:\x01" + name.encode()).hexdigest()[:4], 16) / 65536
    for name, (target, total, taken, found) in by.items():
        assert abs(taken - target) < 0.02 * target
        rate, u = min(3.0, target / total), offset(name)
        assert [c for _, _, c in sorted(found)] == [math.floor((k + 1) * rate + u) - math.floor(k * rate + u) for k in range(len(found))]


def test_mixing_of_many_sources_is_the_same_in_tables(spark):
    many = spark.createDataFrame([(i, "w " * (1 + i % 37), None if i % 41 == 0 else "s%d" % (i % 40)) for i in range(1500)], "doc_id long, text string, source string")
    want, got = (sorted(map(tuple, mixing.mix_plan(many, at_once=n).collect())) for n in (100, 3))
    assert got == want
    sizes = [0, 5, 7, 9, 1, 1000, 1000, 3, 3, 3, 100]
    per = spark.createDataFrame([("s%02d" % k, n) for k, n in enumerate(sizes)], "source string, n long")
    assert [r["target"] for r in mixing.goals(per, at_once=2).sort("idx").collect()] == mixing.targets(sizes)


def test_mixing_of_repeated_rows(spark):
    """Rows that are the same, or differ in one other column only, and columns named as helpers are."""
    some = [(None if k % 3 else 7, "two words", "s", "mine", k % 2) for k in range(3000)] + [(k, "a b c d", "t", "mine", 0) for k in range(3)]
    df = spark.createDataFrame(some, "doc_id long, text string, source string, _key string, _size int")
    plan, got = mixing.mix_plan(df).collect(), mixing.mix(df)
    assert got.columns == [*df.columns, "copy"]
    rows = got.collect()
    assert {r["_key"] for r in rows} == {"mine"}
    for j in (1, 2, 3):
        assert Counter((r["doc_id"], r["source"]) for r in rows if r["copy"] == j) == Counter((r["doc_id"], r["source"]) for r in plan if r["copies"] >= j)


def plain_print(text):
    terms = set(WORD.findall(text.lower()))
    total = sum(map(len, terms))
    return sum(1 << k for k in range(64) if 2 * sum(len(w) for w in terms if xxhash.xxh64_intdigest(w.encode(), 42) >> k & 1) > total)


def plain_edits(pairs):
    """Of (doc_id, text), all results by the definition; equal ids go by the signed hash of the text."""
    signed = lambda t: (h := xxhash.xxh64_intdigest(t.encode(), 42)) - (h >> 63 << 64)
    order = sorted(((i, t or "") for i, t in pairs), key=lambda r: (r[0] is None, -(r[0] or 0), signed(r[1])))
    for k, (i, t) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        n = len(t) // 3
        edited = t[: len(t) - n] + after[:n]
        yield str(i), len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_print(t), plain_print(edited), plain_print(after)


def test_fingerprints(spark, docs, empty):
    """All columns against a plain version, over rows that repeat and have no ids, and over ids of all 64 bits."""
    wide = [(-(2**63) + 5, "a b c d e f"), (2**63 - 2, "first of all"), (0, None), (17, "one, two and three"), (-4, "x " * 50)]
    some = spark.createDataFrame(wide, "doc_id long, text string")
    for df, pairs in ((docs, [(r[0], r[1]) for r in rows()]), (some, wide), (spark.createDataFrame(wide[:1], "doc_id long, text string"), wide[:1])):
        for size in (2, 128):
            got = fingerprints.with_edits(df, bucket_rows=size).collect()
            u = lambda x: x & (2**64 - 1)
            mine = [(str(r["doc_id"]), r["n_chars"], r["edited_sha256"], u(r["fingerprint"]), u(r["edited_fingerprint"]), u(r["next_fingerprint"])) for r in got]
            assert sorted(mine) == sorted(plain_edits(pairs))
    assert fingerprints.with_edits(empty).count() == 0
    assert fingerprints.fingerprints(docs).count() == len({(r[0], r[1] or "") for r in rows()})


def test_op9(spark, sf):
    """The query's likenesses and counts of near fingerprints against all pairs."""
    pairs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in fingerprints.op9_fingerprints(spark, sf).collect()}
    prints = {i: plain_print(t) for i, t in pairs.items()}
    like = lambda a, b: 1 - (a ^ b).bit_count() / 64
    for i, n, sha, f, e, after in plain_edits(pairs.items()):
        r = got[int(i)]
        near = len({p for p in prints.values() if 0 < (p ^ f).bit_count() <= 3}) if int(i) % 20 == 0 else None
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (n, sha, f"{f:016x}", f"{e:016x}")
        assert (r["near_edited"], r["near_next"], r["n_near"]) == (like(f, e), like(f, after), near)


def test_block_tables(spark):
    draw = np.random.default_rng(5)
    some = [int(x) for x in draw.integers(-(2**62), 2**62, 40)]
    some += [x ^ sum(1 << int(k) for k in draw.choice(62, draw.integers(1, 6), replace=False)) for x in some for _ in range(3)]
    df = spark.createDataFrame([(x,) for x in some + some[:5]], "fingerprint long")
    got = {(r["query"], r["fingerprint"], r["distance"]) for r in fingerprints.near(df, df, 3).collect()}
    dist = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(a, b, dist(a, b)) for a in some for b in some if dist(a, b) <= 3}


def test_substring_dedup(docs, empty, spark):
    got = {}
    for r in substring_dedup.substring_dedup(docs, min_words=8).collect():
        got.setdefault(r["doc_id"], []).append((r["text"], [(s["start"], s["end"]) for s in r["removed"]]))
    assert got[1][0][0] == rows()[0][1] and "quick" not in got[3][0][0] and "quick" not in got[2][0][0]
    for i, t, *_ in rows():
        for kept, spans in got[i]:
            ends = [0, *(b for _, b in spans)]
            starts = [*(a for a, _ in spans), None]
            assert any(kept == "".join((x or "")[a:b] for a, b in zip(ends, starts, strict=True)) for x in [t, *(r[1] for r in rows() if r[0] == i)])
    assert substring_dedup.substring_dedup(empty).count() == 0
    passage = " ".join(f"w{k}" for k in range(60)) + "."
    two = spark.createDataFrame([(1, f"A start here. {passage} The end."), (2, f"Quite another. {passage} Something.\nmore")], "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in substring_dedup.substring_dedup(two).collect()}
    short = spark.createDataFrame([(k, f"A line of ten words that many documents have here.\n{'x' * k}") for k in range(1, 5)], "doc_id long, text string")
    assert all(r["removed"] == [] for r in substring_dedup.substring_dedup(short).collect())
    assert passage in out[1] and "w30" not in out[2] and "Quite another." in out[2] and out[2].endswith("more")


def test_substring_dedup_takes_every_repeated_window(spark):
    """Passages of 50 words inside lines and across them, and all windows of texts of pieces that recur."""
    passage = [f"w{k}" for k in range(50)]
    flat = " ".join(passage)
    texts = {1: f"aa bb {flat} cc", 2: f"dd ee {flat.upper()} ff gg", 3: f"hh {' '.join(passage[:7])}\n{' '.join(passage[7:])} ii", 4: f"jj {' '.join(passage[1:])} kk", 5: "z y x " * 60}
    draw = np.random.default_rng(6)
    pieces = [" ".join(f"v{x}" for x in draw.integers(0, 5000, n)) for n in draw.integers(5, 90, 40)]
    texts |= {k: " ".join(pieces[i] for i in draw.integers(0, 40, 6)) for k in range(10, 60)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    out = {r["doc_id"]: r for r in substring_dedup.substring_dedup(df).collect()}
    assert out[1]["text"] == texts[1] and out[4]["text"] == texts[4]
    assert out[2]["text"].split() == ["dd", "ee", "ff", "gg"] and out[3]["text"].split() == ["hh", "ii"]
    assert 50 <= len(out[5]["text"].split()) <= 53
    first = {}
    for i, t in sorted(texts.items()):
        words = [(m.group().lower(), *m.span()) for m in re.finditer(r"\S+", t)]
        want = set()
        for k in range(len(words) - 49):
            d, p = first.setdefault(tuple(w for w, _, _ in words[k : k + 50]), (i, k))
            if d != i or k >= p + 50:
                want |= set(range(k, k + 50))
        gone = {k for k, (_, a, b) in enumerate(words) if any(s["start"] <= a and b <= s["end"] for s in out[i]["removed"])}
        assert gone == want


def test_pii(spark, docs, empty):
    text = "Mail a.bee9@mail7.example.com or A.BEE9@MAIL7.EXAMPLE.COM, +1 (212) 555-7713, 10.2.3.4, 4111111111111111 or 4111 1111 1111 1111. Mrs. Anna Smith and Smith's John Smith."
    hidden = ["a.bee9", "555-7713", "10.2.3.4", "4111", "Anna", "Smith and"]
    more = spark.createDataFrame([(1, text), (2, "again 10.2.3.4 and 10.2.3.5"), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.replace_pii(more).collect()}
    out = got[1]["text"]
    assert not any(h in out for h in hidden)
    assert got[1]["kinds"] == ["email", "email", "phone", "ip", "card", "card", "person", "person"]
    low, high = re.findall(r"\S+@\S+\.(?:com|COM)", out)
    assert low.upper() == high and low.endswith(".com")
    one, spaced = re.search(r"(\d{16}) or (\d{4} \d{4} \d{4} \d{4})", out).groups()
    assert one == spaced.replace(" ", "")
    digits = [int(c) for c in reversed(one)]
    assert sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(digits)) % 10 == 0
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out)
    ips = re.findall(r"\d+\.\d+\.\d+\.\d+", out + got[2]["text"])
    assert ips[0] == ips[1] != ips[2] and all(0 < int(x) < 256 for ip in ips for x in ip.split("."))
    assert re.search(r"Mrs\. (\w+) (\w+) and", out).group(1) in pii.FEMALE
    assert pii.replace_pii(docs).count() == docs.count()
    same = {(r["doc_id"], r["text"]) for r in pii.replace_pii(docs).collect()}
    assert (1, rows()[0][1]) in same
    assert pii.replace_pii(empty).count() == 0


def test_pii_clashes_take_another_turn(spark):
    """All addresses of a small range, so that some surrogate is sure to be another's, or one of the corpus."""
    many = [(k, f"{a}.{b}.7.7") for k, (a, b) in enumerate(itertools.product(range(1, 40), range(1, 40)))]
    found = spark.createDataFrame([(t,) for _, t in many], "entity string")
    got = {r["entity"]: r["surrogate"] for r in pii.surrogates(found).collect()}
    assert len(set(got.values())) == len(many) and not set(got.values()) & set(got)


def test_pii_with_a_full_format(spark):
    """Every address x@y.co there is: the surrogates must be longer."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    all_ = [f"{x}@{y}.co" for x in letters for y in letters]
    got = {r["entity"]: r["surrogate"] for r in pii.surrogates(spark.createDataFrame([(t,) for t in all_], "entity string")).collect()}
    assert set(got) == set(all_) and len(set(got.values())) == len(all_) and not set(got.values()) & set(all_)
    assert all(re.fullmatch(r"[a-z]+@[a-z]\.co", x) for x in got.values())


def test_pii_people_stay_apart(spark):
    """All given names with one family name, and introduced names that no list has."""
    names = [n for of in pii.GIVEN.values() for n in of]
    text = " . ".join(f"{n} {'Гарсин' if n[0] > 'z' else 'Garcia'} wrote" for n in names) + " . My name is Zoltan Garcia. Dear Zelda Garcia, Mr. Garcia came"
    (row,) = pii.replace_pii(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert row["kinds"] == ["person"] * (len(names) + 3)
    out = re.findall(r"(\w+) (\w+) wrote", row["text"])
    assert len(set(out)) == len(names) and len({f for _, f in out}) == 2
    for (new, _), old in zip(out, names, strict=True):
        assert new != old and any(new in of and old in of for of in pii.GIVEN.values())
    assert "Garcia" not in row["text"] and "Zoltan" not in row["text"] and "Zelda" not in row["text"]
    family = next(f for g, f in out if g in pii.FEMALE)
    assert row["text"].endswith(f"Mr. {family} came")


def test_pii_against_plain_replacement(spark):
    """Texts of many kinds in turn, long ones too: what is between entities stays, and replacements keep their format."""
    key, host = "0123456789abcdef" * 9, ".".join(["sub"] * 20)
    parts = ["a.b@c.org", f"{'long' * 30}@{host}.example.com", key, key[:140].upper(), "+49 (171) 555-1234", "10.11.12.13", "123-45-6789", "DE44 5001 0517 5407 3249 31", "4111111111111111"]
    draw = np.random.default_rng(4)
    texts = {k: " ; ".join(f"plain{x} {parts[x]}" for x in draw.integers(0, len(parts), 12)) for k in range(20)} | {100: "x@y.org " * 20_000, 101: "nothing here"}
    got = {r["doc_id"]: r for r in pii.replace_pii(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    shape = lambda s: re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", s)))
    new = {}
    for k, text in texts.items():
        if k == 101:
            assert got[k]["text"] == text and got[k]["kinds"] == []
            continue
        old, out = text.split(" "), got[k]["text"].split(" ")
        assert len(old) == len(out)
        if k == 100:
            assert len(set(out)) == 2 and "x@y.org" not in out
            continue
        for a, b in zip(re.split(" ; plain\\d |^plain\\d ", text)[1:], re.split(" ; plain\\d |^plain\\d ", got[k]["text"])[1:], strict=True):
            assert a != b and new.setdefault(a, b) == b
            if a not in (key, key[:140].upper(), "10.11.12.13"):
                assert shape(a) == shape(b)
            assert len(a) == len(b) or a == "10.11.12.13"
    assert len(set(new.values())) == len(new) == len(parts)


def test_language(spark, sf, docs, empty):
    all_ = spark.read.parquet(f"{sf}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0
    model = language.train(all_.filter(~held))
    got = language.identify(all_.filter(held).select("doc_id", "text", "lang"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    odd = {r["doc_id"]: r for r in language.identify(docs, model).collect()}
    assert odd[4]["lang_pred"] == odd[9]["lang_pred"] == odd[5]["lang_pred"] == "und" and odd[1]["lang_pred"] == "en"
    assert all(0 <= r["score"] <= 1 for r in odd.values())
    none = language.train(empty)
    assert none.languages == [] and {r["lang_pred"] for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(empty, model).count() == 0


def test_language_training_counts_whole_texts(spark, sf):
    """Weights and predictions against plain counting, in one block of languages and in several."""
    all_ = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    data = all_.collect()

    def plain(text):
        codes, out = [ord(c) for c in f" {text.lower()} "], Counter()
        for i in range(len(codes)):
            h = 0
            for n in (1, 2, 3):
                if i + n <= len(codes):
                    h = (((h ^ codes[i + n - 1]) * 0x9E3779B1) + n) % 2**32
                    out[(h ^ (h >> 15)) % language.BUCKETS] += 1
        return out

    counts, docs_of = {}, Counter(r["lang"] for r in data)
    for r in data:
        counts.setdefault(r["lang"], Counter()).update(plain(r["text"]))
    learned = language.train(all_)
    model = learned.part(0)
    assert learned.languages == sorted(counts)
    for k, lang in enumerate(learned.languages):
        want = np.log(np.array([counts[lang][b] for b in range(language.BUCKETS)]) + 0.5) - math.log(sum(counts[lang].values()) + 0.5 * language.BUCKETS)
        assert np.abs(model.weights[:-1, k] - want).max() < 1e-5 and model.prior[k] == pytest.approx(math.log(docs_of[lang] / len(data)))
    one, many = (sorted((r["doc_id"], r["lang_pred"], round(r["score"], 9)) for r in language.identify(all_, m).collect()) for m in (learned, language.train(all_, block=1)))
    assert one == many


def test_language_scores_are_naive_bayes():
    model = language.Model(["a", "b"], np.log([0.5, 0.5]), np.vstack([np.log(np.random.default_rng(0).dirichlet(np.ones(language.BUCKETS), 2)).T, np.zeros((1, 2))]).astype(np.float32))
    texts = ["abc de", "x", "q" * 50]
    total = np.zeros((3, 2))
    for n, t in enumerate(texts):
        for buckets, _, _ in language.grams([t]):
            for b in buckets:
                total[n] += model.weights[b]
    names, odds = language.predict(model, texts)
    assert names == [["a", "b"][k] for k in total.argmax(axis=1)]
    assert odds == pytest.approx([1 / np.exp(r - r.max()).sum() for r in total])


def test_quality(spark, docs, empty):
    """On labels that were held out."""
    sf = "/root/testdata/sf0.01"
    all_, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = [r for r in quality.op4_quality(spark, sf).join(labels, "doc_id").collect() if r["held_out"]]
    assert len(found) > 50 and np.mean([r["predicted"] == r["quality"] for r in found]) >= 0.95
    none = quality.train(docs, labels.limit(0))
    got = quality.judge(docs, none).collect()
    assert len(got) == docs.count() and all(r["score"] == pytest.approx(0.5) and r["predicted"] == 1 for r in got)
    assert quality.judge(empty, none).count() == 0
    same = spark.createDataFrame([(k, "one text for all") for k in range(40)], "doc_id long, text string")
    marks = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(40)], "doc_id long, quality int")
    tied = quality.judge(same, quality.train(same, marks)).collect()
    assert len({(r["score"], r["predicted"]) for r in tied}) == 1 and tied[0]["predicted"] == 1


def test_quality_cut_is_at_the_share_of_all_labels(spark):
    """Labels of which a sample holds many more zeros than there are, and that texts tell apart badly."""
    draw = np.random.default_rng(4)
    y = (draw.random(3000) >= 0.14).astype(int)
    some = [(k, "word " * 30 + "! " * int(n)) for k, n in enumerate(draw.poisson(np.where(y == 1, 3, 5)))]
    all_ = spark.createDataFrame(some, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(v)) for k, v in enumerate(y)], "doc_id long, quality int")
    found = quality.judge(all_, quality.train(all_, labels, sample=400)).collect()
    assert abs(np.mean([r["predicted"] == 0 for r in found]) - 0.14) < 0.07


def test_ranking_learns_pairs():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(400, 3))
    y = (x[:, 0] - 0.5 * x[:, 1] > 0).astype(int)
    r = quality.rank(x, y)
    assert ((r.score(x) >= quality.CUT) == (y == 1)).mean() > 0.97


def test_lm(docs, empty):
    train = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(7)) != 2
    got = lm.scores(docs, train).collect()
    learn = [zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 7 != 2 for r in rows()]
    toks = [[*WORD.findall((r[1] or "").translate(LOWER)), None] for r in rows()]
    c = Counter(w for t, k in zip(toks, learn, strict=True) if k for w in t)
    n, v = sum(c.values()), len(c)
    want = sorted((str(r[0]), len(t), sum(c[w] > 0 for w in t), round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), 4)) for r, t in zip(rows(), toks, strict=True))
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["train_tokens"] == n and r["score"] < 0 for r in got)
    assert lm.scores(empty, train).count() == 0
    nothing = lm.scores(docs, F.lit(False)).collect()
    assert len(nothing) == len(rows()) and all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in nothing)


def test_lm_probabilities_sum_to_one(spark):
    """From the scores of all texts of one and two words: with x the first word's probability, a(w) that of the
    text w and b(u, w) that of the text u w, and all that may follow u adding up to one, x solves a linear
    system; then x and the empty text's probability must add up to one as well."""
    words = ["a", "b", "c", "d", "unseen"]
    draw = np.random.default_rng(2)
    known = [(k, " ".join(draw.choice(words[:4], 12, p=[0.5, 0.3, 0.1, 0.1]))) for k in range(40)]
    ones = [(1000 + k, w) for k, w in enumerate([*words, ""])]
    twos = [(2000 + 10 * j + k, f"{u} {w}") for j, u in enumerate(words) for k, w in enumerate(words)]
    df = spark.createDataFrame(known + ones + twos, "doc_id long, text string")
    p = {r["doc_id"]: 10 ** r["score"] for r in lm.scores(df, F.col("doc_id") < 1000).collect()}
    a = np.array([p[1000 + k] for k in range(5)])
    b = np.array([[p[2000 + 10 * j + k] for k in range(5)] for j in range(5)])
    x = np.linalg.solve(np.eye(5) - b / a[None, :], a)
    assert (x > 0).all() and x.sum() + p[1005] == pytest.approx(1)


def test_packing():
    arrays = [np.arange(5, dtype=np.uint64) << 40, np.zeros(0, dtype=np.int32), np.array([True, False])]
    for a, b in zip(arrays, lm.unpack(lm.pack(*arrays)), strict=True):
        assert a.dtype == b.dtype and (a == b).all()
