"""Enrichment of nodes in batches: summaries, behaviour tags, embeddings."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions.names import is_callable, valid_tags
from ..plans.graph import Graph
from ..plans.schema import BEHAVIORS, SUMMARY
from ..sources.providers import prompt

Tagger = Callable[[str], list[str]]
Summarizer = Callable[[str, str, str], str]
Embedder = Callable[[list[str]], list[list[float]]]


def with_tags(graph: Graph, tagger: Tagger) -> Graph:
    """Functions' and methods' behaviors by the tagger over their code, valid tags only; null where it fails."""

    @F.pandas_udf("array<string>")
    def tag(codes: pd.Series) -> pd.Series:
        def one(code):
            try:
                return list(tagger(code or ""))
            except Exception:  # noqa: BLE001  a provider may fail in any way
                return None

        return codes.map(one)

    tagged = F.when(is_callable(F.col("type")), valid_tags(tag(F.coalesce("code", "signature")), BEHAVIORS))
    return Graph(graph.nodes.withColumn("behaviors", tagged), graph.edges)


def with_summaries(graph: Graph, summarize: Summarizer, model: str = "mock", now: Callable[[], float] = time.time) -> Graph:
    """Functions' summaries by the provider; those written by people stay, and so do those where it fails."""

    @F.pandas_udf("string")
    def say(names: pd.Series, packages: pd.Series, codes: pd.Series) -> pd.Series:
        def one(row):
            try:
                return summarize(*row)
            except Exception:  # noqa: BLE001
                return None

        return pd.Series([one(r) for r in zip(names, packages, codes.fillna(""), strict=True)])

    at = F.lit(int(now())).cast("long")
    text = say("name", "package", "code")
    new = F.struct(text.alias("text"), F.lit("llm").alias("generated_by"), F.lit(model).alias("model"), at.alias("created_at"), at.alias("updated_at"))
    human = F.coalesce(F.col("summary.generated_by") == "human", F.lit(False))
    nodes = graph.nodes.withColumn("_new", F.when((F.col("type") == "function") & ~human, new))
    written = F.when(F.col("_new.text").isNotNull(), F.col("_new").cast(SUMMARY)).otherwise(F.col("summary"))
    return Graph(nodes.withColumn("summary", written).drop("_new"), graph.edges)


def human_summary(graph: Graph, id_: str, text: str, now: Callable[[], float] = time.time) -> Graph:
    """The graph with a summary by a person on one node."""
    at = F.lit(int(now())).cast("long")
    made = F.coalesce(F.col("summary.created_at"), at)
    new = F.struct(F.lit(text).alias("text"), F.lit("human").alias("generated_by"), F.lit("").alias("model"), made.alias("created_at"), at.alias("updated_at"))
    return Graph(graph.nodes.withColumn("summary", F.when(F.col("id") == id_, new.cast(SUMMARY)).otherwise(F.col("summary"))), graph.edges)


def prompts(graph: Graph) -> DataFrame:
    """id, prompt: what a provider is asked about each function."""

    @F.pandas_udf("string")
    def build(names: pd.Series, packages: pd.Series, signatures: pd.Series, docs: pd.Series, codes: pd.Series) -> pd.Series:
        return pd.Series([prompt(*row) for row in zip(names, packages, signatures.fillna(""), docs.fillna(""), codes.fillna(""), strict=True)])

    return graph.nodes.filter("type = 'function'").select("id", build("name", "package", "signature", "docstring", "code").alias("prompt"))


def missing_embeddings(graph: Graph, embeddings: DataFrame, embed: Embedder, summarize: Summarizer | None = None, batch: int = 64) -> DataFrame:
    """Rows to upsert for functions that lack a vector: the summary's text and the code. Without a summary it is what
    `summarize` says, if given, else (or if that fails) name and signature.
    A failure on code leaves its vector null; one on a summary leaves the row out."""
    whole = embeddings.filter("summary_embedding IS NOT NULL AND code_embedding IS NOT NULL").select(F.col("node_id").alias("id"))
    todo = graph.nodes.filter("type = 'function'").join(whole, "id", "left_anti")
    rows = todo.select(
        F.col("id").alias("node_id"), F.nullif(F.col("summary.text"), F.lit("")).alias("summary_text"), F.coalesce("code", F.lit("")).alias("code_text"),
        "name", "package", F.concat_ws(" ", "name", "signature").alias("title"),
    )

    def said(row: dict) -> str:
        if row["summary_text"]:
            return row["summary_text"]
        try:
            return (summarize(row["name"], row["package"], row["code_text"]) if summarize else "") or row["title"]
        except Exception:  # noqa: BLE001
            return row["title"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def vectors(texts: list[str]) -> list:
            try:
                return list(embed(texts)) if texts else []
            except Exception:  # noqa: BLE001
                return [None] * len(texts)

        for whole_batch in batches:
            for at in range(0, whole_batch.num_rows, batch):
                part = whole_batch.slice(at, batch).to_pylist()
                texts, codes = [said(r) for r in part], [r["code_text"] for r in part]
                found = iter(vectors([c for c in codes if c]))
                columns = [r["node_id"] for r in part], texts, codes, vectors(texts), [next(found) if c else None for c in codes]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    ddl = "node_id string, summary_text string, code_text string, summary_embedding array<float>, code_embedding array<float>"
    schema = to_arrow_schema(T._parse_datatype_string(ddl))
    return rows.mapInArrow(run, ddl).filter("summary_embedding IS NOT NULL")
