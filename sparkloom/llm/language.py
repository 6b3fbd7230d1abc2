"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import cut, free_name, remainder, small, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
UNDETERMINED = "und"
#: Code points that are hashed at once.
_AT_ONCE = 1 << 20


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log probability of each language
    weights: np.ndarray  # log probability of each n-gram bucket (rows) in each language, and a row of zeros


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashed n-grams of lower-cased texts, a space at either end, some million code points at a time: the
    buckets (BUCKETS where no n-gram starts), the numbers of the texts in this part, and where each starts."""
    coded = [np.frombuffer(f" {t.lower()} \0\0".encode("utf-32-le", "surrogatepass"), dtype=np.uint32) for t in texts]
    if not coded:
        return
    flat, ends = np.concatenate(coded), np.cumsum([0] + [len(c) for c in coded])
    reach = max(ORDERS) - 1
    for at in range(0, len(flat), _AT_ONCE):
        to = min(len(flat), at + _AT_ONCE)
        codes = flat[at : to + reach]
        first = int(np.searchsorted(ends, at, "right")) - 1
        last = int(np.searchsorted(ends, to, "left"))
        starts = np.maximum(ends[first:last], at) - at
        h = np.zeros(to - at, dtype=np.uint32)
        real = np.ones(to - at, dtype=bool)
        for n in range(1, reach + 2):
            part = np.zeros(to - at, dtype=np.uint32)
            some = codes[n - 1 : n - 1 + to - at]
            part[: len(some)] = some
            real &= part != 0
            h = (h ^ part) * np.uint32(0x9E3779B1) + np.uint32(n)
            if n in ORDERS:
                yield np.where(real, (h ^ (h >> np.uint32(15))) % np.uint32(BUCKETS), np.uint32(BUCKETS)), np.arange(first, last), starts


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def raw(model: Model, texts: list[str | None]) -> np.ndarray:
    """Log probability of each text (rows) and language together."""
    score = np.tile(model.prior, (len(texts), 1))
    for buckets, which, starts in grams([t or "" for t in texts]) if model.languages else ():
        for k in range(len(model.languages)):
            score[which, k] += np.add.reduceat(model.weights[:, k][buckets], starts, dtype=np.float64)
    return score


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Each text's most probable language (equal: the first by name) and its posterior probability; UNDETERMINED
    and 0 for a null text, one without a letter, and where no language has been learned."""
    names, odds = [], []
    for text, row in zip(texts, raw(model, texts), strict=True):
        known = bool(model.languages) and has_letter(text)
        best = int(np.argmax(row)) if known else -1
        names.append(model.languages[best] if known else UNDETERMINED)
        odds.append(float(1 / np.exp(row - row[best]).sum()) if known else 0.0)
    return names, odds


class Learned:
    """What train() learns: all languages, and models of blocks of them, each worked out when it is asked for."""

    def __init__(self, languages: list[str], block: int, model):
        self.languages = languages
        self.parts = max(1, -(-len(languages) // block))
        self.part = cache(model) if self.parts == 1 else model


def train(docs: DataFrame, sample_per_language: int = 2000, block: int = 500, smoothing: float = 0.5) -> Learned:
    """A model of the rows of docs (doc_id, text, lang) whose text and lang are not null; no such rows, no languages.

    Learns from about sample_per_language rows of each language, those of the lowest hash of id and text: a bound,
    whatever the table's size. Priors count all rows. n-grams are counted in the tasks and summed by bucket. Languages
    are taken up in blocks, in the order of their names, so that at most BUCKETS rows for each language of a block reach the driver, and
    the matrix that is broadcast has 4 * BUCKETS bytes for each of them; of all languages the driver has names and counts.
    Rows without an id, and repeated rows, count like others."""
    spark = docs.sparkSession
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang")
    ).filter("text IS NOT NULL AND lang IS NOT NULL")
    found = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages, total = sorted(found), sum(found.values())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch in small(batches):
            langs = batch.column(0).to_pylist()
            for buckets, which, starts in grams(batch.column(1).to_pylist()):
                for doc, part in zip(which, np.split(buckets, starts[1:]), strict=True):
                    at = counts.setdefault(langs[doc], np.zeros(BUCKETS + 1, dtype=np.int64))
                    at += np.bincount(part, minlength=BUCKETS + 1)
        for lang, c in counts.items():
            at = np.flatnonzero(c[:BUCKETS])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(c[at])], names=["lang", "bucket", "n"])

    def model(k: int) -> Model:
        names = languages[k * block : (k + 1) * block]
        share = spark.createDataFrame([(n, min(1.0, sample_per_language / found[n])) for n in names], "name string, share double")
        chance = F.pmod(F.xxhash64(F.lit("language"), F.col("doc_id"), F.col("text")), F.lit(1 << 20)) / F.lit(float(1 << 20))
        sample = rows.join(F.broadcast(share), F.col("lang") == F.col("name")).filter(chance < F.col("share"))
        counted = sample.select("lang", "text").mapInArrow(count, "lang string, bucket long, n long")
        summed = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
        counts = np.zeros((BUCKETS, len(names)))
        counts[summed["bucket"].to_numpy(dtype=int), summed["lang"].map({n: i for i, n in enumerate(names)}).to_numpy(dtype=int)] = summed["n"]
        odds = np.log(counts + smoothing) - np.log(counts.sum(axis=0) + smoothing * BUCKETS)
        prior = np.log(np.array([found[n] / total for n in names])) if names else np.zeros(0)
        return Model(names, prior, np.vstack([odds, np.zeros(len(names))]).astype(np.float32))

    return Learned(languages, block, model)


def identify(docs: DataFrame, learned: Learned) -> DataFrame:
    """docs with lang_pred and score (see predict), in place of columns of these names. The model's matrix is
    broadcast, and each batch's texts are scored as sparse rows of n-gram counts times that matrix; nothing
    is shuffled. Whole texts count, however long. With several blocks of languages the rows pass by one block after the
    other, written in between, with the best language so far.

    Null and empty texts are UNDETERMINED. Null ids, repeated rows and other columns stay as they are; an empty table
    gives no rows."""
    spark = docs.sparkSession
    names = [c for c in docs.columns if c.lower() not in ("lang_pred", "score")]
    top, mass = free_name(docs, "_top"), free_name(docs, "_mass")
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    ready = docs.select(*names, none("string", "lang_pred"), none("double", "score"), none("double", top), none("double", mass))

    def step(held):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = held.value
            for batch in small(batches):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                best, odds, tops, sums = (batch.column(-4 + k).to_pylist() for k in range(4))
                for i, (text, row) in enumerate(zip(texts, raw(model, texts), strict=True)):
                    if not model.languages or not has_letter(text):
                        best[i], odds[i] = UNDETERMINED, 0.0
                        continue
                    k, before = int(np.argmax(row)), -np.inf if tops[i] is None else tops[i]
                    now = max(before, float(row[k]))
                    sums[i] = (sums[i] or 0.0) * float(np.exp(before - now)) + float(np.exp(row - now).sum())
                    best[i] = model.languages[k] if row[k] > before else best[i]
                    tops[i], odds[i] = now, 1 / sums[i]
                columns = [*batch.columns[:-4], pa.array(best, pa.string()), *(pa.array(x, pa.float64()) for x in (odds, tops, sums))]
                yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

        return run

    for k in range(learned.parts):
        if k:
            ready = cut(ready, "languages")
        ready = ready.mapInArrow(step(spark.sparkContext.broadcast(learned.part(k))), ready.schema)
    return ready.drop(top, mass)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = remainder(F.col("doc_id"), 5) == 0
    model = train(docs.filter(~held_out))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
