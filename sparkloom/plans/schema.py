"""Schemas and closed domains of the property graph."""

from __future__ import annotations

from pyspark.sql import types as T

# The domains of the data model.
NODE_TYPES = ("function", "method", "type", "interface", "package", "file")
EDGE_TYPES = ("calls", "called_by", "imports", "uses", "defines", "implements", "embeds", "returns", "accepts")
BEHAVIORS = ("logging", "error-handle", "database", "http-client", "file-io", "concurrency")
PATTERNS = ("constructors", "error-handling", "tests", "entrypoints", "sinks", "sources", "hotspots")
# End of the fixed values.

_TEXT, _INT, _LONG = T.StringType(), T.IntegerType(), T.LongType()


def _struct(*needed: str, **fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, name not in needed) for name, kind in fields.items()])


SUMMARY = _struct(text=_TEXT, generated_by=_TEXT, model=_TEXT, created_at=_LONG, updated_at=_LONG)
NODES = _struct(
    "id", id=_TEXT, type=_TEXT, package=_TEXT, name=_TEXT, file=_TEXT, line=_INT, col=_INT, signature=_TEXT, docstring=_TEXT, code=_TEXT,
    summary=SUMMARY, methods=T.ArrayType(_struct(name=_TEXT, signature=_TEXT)), receiver=_TEXT, kind=_TEXT, behaviors=T.ArrayType(_TEXT), extra=_TEXT,
)
EDGES = _struct("from_id", "to_id", "type", from_id=_TEXT, to_id=_TEXT, type=_TEXT, pointer_receiver=T.BooleanType(), seq=_LONG, extra=_TEXT)
EMBEDDINGS = _struct(
    "node_id", node_id=_TEXT, summary_text=_TEXT, code_text=_TEXT, summary_embedding=T.ArrayType(T.FloatType()),
    code_embedding=T.ArrayType(T.FloatType()), summary_norm=T.DoubleType(), code_norm=T.DoubleType(),
)


def shaped(df, schema: T.StructType):
    """df with the schema's columns in its order and types; columns that df lacks are null."""
    from pyspark.sql import functions as F

    have = set(df.columns)
    return df.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
