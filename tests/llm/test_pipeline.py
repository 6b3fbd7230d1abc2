from __future__ import annotations

import hashlib
import math
import re

import corpus_pipeline
import numpy as np
import xxhash
from sparkloom.llm import decontaminate, language, line_dedup, mixing, simhash_dedup
from sparkloom.plans.lineage import cut

COLUMNS = list(corpus_pipeline.COLUMNS)


def test_stages(spark, sf):
    """Each stage against its operator's own account of its input."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = [(100_000, None, None, None, None), (100_001, "12 34", "en", "x", 5), (0, docs.filter("doc_id = 0").first()["text"], "fr", "src0", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, sf), "stage")
        kept[name] = docs
        if name != "mix":
            assert docs.columns == COLUMNS
    ids = {k: [r["doc_id"] for r in v.select("doc_id").collect()] for k, v in kept.items()}
    assert 100_000 not in ids["language"] and 100_001 not in ids["language"] and len(ids["language"]) == 201
    assert sorted(ids["lines"]) == sorted(ids["language"])
    assert kept["lines"].filter("n_chars <> length(text)").isEmpty()
    again = line_dedup.line_dedup(kept["lines"])
    assert again.filter("n_dropped > 0").isEmpty()
    assert len(set(ids["near copies"])) == len(ids["near copies"]) < len(ids["lines"])
    assert not set(ids["near copies"]) - set(ids["lines"])
    assert simhash_dedup.drop_near(kept["near copies"]).count() == len(ids["near copies"])
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    assert decontaminate.decontaminate(kept["benchmark"], bench).count() == len(ids["benchmark"]) < len(ids["near copies"])
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix_plan(kept["benchmark"]).collect()}
    assert {d: ids["mix"].count(d) for d in plan} == plan
    assert language.UNDETERMINED not in {r["lang"] for r in kept["mix"].collect()}


def plain_wide(text):
    """256 bits: majorities of the hashes of five-word shingles, mixed in four ways."""
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 5]) for i in range(len(words) - 4)] or ([b" ".join(words)] if words else [])
    hashes, out, ones = [xxhash.xxh64_intdigest(s, 42) for s in shingles], 0, 2**64 - 1
    for lane in range(4):
        mixed = hashes
        if lane:
            mixed = [(h ^ (0x9E3779B97F4A7C15 * lane & ones)) * 0xBF58476D1CE4E5B9 & ones for h in hashes]
            mixed = [(h ^ (h >> 27)) * 0x94D049BB133111EB & ones for h in mixed]
            mixed = [h ^ (h >> 31) for h in mixed]
        bits = np.array([[h >> k & 1 for k in range(64)] for h in mixed]).reshape(-1, 64).sum(axis=0)
        out |= sum(1 << 64 * lane + k for k in range(64) if 2 * int(bits[k]) > len(mixed))
    return out, max(1, len(set(hashes)))


def plain_run(docs, items, learned):
    """The five stages over lists of (doc_id, text, lang, source, n_chars)."""
    names, odds = language.predict(learned.part(0), [d[1] for d in docs])
    docs = [d for d, n, o in zip(docs, names, odds, strict=True) if n != "und" and o >= 0.5]
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    first = {}
    for d in sorted(docs):
        for line in d[1].split("\n"):
            if len(key(line)) >= 10:
                first.setdefault(key(line), d[0])
    docs = [(d[0], "\n".join(x for x in d[1].split("\n") if first.get(key(x), d[0]) == d[0]), *d[2:4]) for d in docs]
    docs = sorted((i, t, la, s, len(t)) for i, t, la, s in docs)
    prints, root = [plain_wide(d[1]) for d in docs], list(range(len(docs)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for j in range(len(docs)):
        for i in range(j):
            (f, m), (g, n) = prints[i], prints[j]
            if (f ^ g).bit_count() <= 52 and min(m, n) >= 0.64 * max(m, n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    docs = [d for k, d in enumerate(docs) if find(k) == k]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(lower))
    windows = {tuple(w[k : k + 10]) for w in map(split, items) for k in range(max(1, len(w) - 9)) if w}
    sizes = {len(w) for w in windows}
    docs = [d for d in docs if not any(tuple(w[k : k + n]) in windows for w in [split(d[1])] for n in sizes for k in range(len(w) - n + 1))]
    by = {}
    for d in docs:
        by.setdefault(d[3], []).append((len(re.findall(r"[^\x20\x09-\x0D]+", d[1])), d[0], d))
    sources = sorted(by)
    totals = [sum(n for n, *_ in by[s]) for s in sources]
    for s, total, target in zip(sources, totals, mixing.targets(totals), strict=True):
        u = int(hashlib.sha256(b"42:\x01" + s.encode()).hexdigest()[:4], 16) / 65536
        rate = min(3.0, target / total) if total else 0.0
        for k, (_, _, d) in enumerate(sorted(by[s])):
            for copy in range(math.floor((k + 1) * rate + u) - math.floor(k * rate + u)):
                yield (*d, copy + 1)


def test_run(spark, sf):
    """All rows of run() against the plain stages."""
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    got = corpus_pipeline.run(spark, sf)
    assert got.columns == [*COLUMNS, "copy"]
    want = plain_run([tuple(r) for r in docs.select(*COLUMNS).collect()], [r["text"] for r in items.collect()], language.train(docs))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_languages_stay_where_none_is_known(spark, sf):
    docs = spark.createDataFrame([(1, "some text", None, "a", 9), (2, "12 34", None, "a", 5), (3, None, None, "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert [r["doc_id"] for r in corpus_pipeline.languages(spark, docs, sf).collect()] == [1]


def test_oracle(spark, tmp_path):
    """Line dedup, mixing and decontamination as the driver compares them, on a small scale factor, and on that
    with null and empty texts, a null and a small source, and items that are short, repeated or without words."""
    import duckdb

    from sparkloom.llm.queries import ORACLE_SQL, QUERIES

    sf, odd = "/root/testdata/sf0.001", str(tmp_path)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    short = items.sort("item_id").first()["text"]
    more = [(-1, None, "en", None, 0), (-2, "", "en", "tiny", 0), (-3, "x Quizzical\nWORD " + short, None, None, 9), (-4, "one  two", "en", "tiny", 8)]
    docs.unionByName(spark.createDataFrame(more, docs.schema)).write.parquet(f"{odd}/documents.parquet")
    few = [("short", "quizzical word"), ("again", short), (None, "!"), ("none", None), ("b,c", "ONE two")]
    items.selectExpr("string(item_id) AS item_id", "text").unionByName(spark.createDataFrame(few, "item_id string, text string")).write.parquet(f"{odd}/benchmark.parquet")
    for at, files in ((sf, ""), (odd, "/*.parquet")):
        con = duckdb.connect()
        for t in ("documents", "benchmark"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet{files}'")
        for name, sql in ORACLE_SQL.items():
            df = QUERIES[name](spark, at)
            want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({sql})").fetchall()
            assert sorted(map(tuple, df.collect())) == sorted(want), (name, at)
