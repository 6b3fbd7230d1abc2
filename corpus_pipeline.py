"""From documents to a training mix, in five stages, each of which writes what it keeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import language
from sparkloom.llm._shared import cut, discard, table
from sparkloom.llm.decontaminate import decontaminate
from sparkloom.llm.line_dedup import line_dedup
from sparkloom.llm.mixing import mix
from sparkloom.llm.simhash_dedup import drop_near

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


#: A document whose most probable language has a lower probability than this is in none of those learned.
LEAST_SCORE = 0.5


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents whose language the model doesn't tell: null texts, texts without a letter, and those to which it gives no
    language a probability of LEAST_SCORE. Where nothing can be learned (no row has a language) all texts with a letter
    stay. Repeated rows and null ids are judged like others."""
    learned = language.train(docs)
    if not learned.languages:
        return docs.select(*COLUMNS).filter(F.col("text").rlike(r"\p{L}"))
    found = language.identify(docs.select(*COLUMNS), learned)
    return found.filter((F.col("lang_pred") != language.UNDETERMINED) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops lines that a document of a smaller id has; n_chars follows the text. Null texts become empty; documents that
    lose all lines stay, with an empty text."""
    kept = line_dedup(docs, keep=("lang", "source"))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the smallest id. Empty texts are one group; rows without an
    id all stay."""
    return drop_near(docs.select(*COLUMNS))


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item; null and empty texts hold none."""
    return decontaminate(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents once, several times or not at all, to the sources' target weights; adds copy. A null
    source is a source, and the last."""
    return mix(docs.select(*COLUMNS))


STAGES = [("language", languages), ("lines", lines), ("near copies", near), ("benchmark", benchmark), ("mix", mixture)]
#: SQL has no naive Bayes, SimHash or suffix arrays; a test holds run() against a plain version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        before, docs = docs, stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, f"stage{k}")
            discard(before)  # nothing for the table read first
    return docs
