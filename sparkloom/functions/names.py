"""Column expressions over names: ids, predicates, receivers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def node_id(type_: Column, package: Column, name: Column, file: Column, line: Column) -> Column:
    """A node's id, by its type."""
    return (
        F.when(type_.isin("function", "method"), F.concat(F.lit("func_"), package, F.lit("_"), name, F.lit("_"), file, F.lit(":"), line.cast("string")))
        .when(type_.isin("type", "interface"), F.concat(F.lit("type_"), package, F.lit("_"), name))
        .when(type_ == "package", F.concat(F.lit("pkg_"), name))
        .when(type_ == "file", F.concat(F.lit("file_"), name))
        .otherwise(F.concat(F.lit("node_"), package, F.lit("_"), name))
    )


def placeholder(package: Column, name: Column) -> Column:
    """The target of a call before it is resolved."""
    return F.concat(F.lit("func_"), package, F.lit("_"), name)


def is_callable(type_: Column) -> Column:
    return type_.isin("function", "method")


def is_test(name: Column, file: Column) -> Column:
    named = name.startswith("Test") | name.startswith("Benchmark") | name.startswith("Example")
    return named | F.coalesce(file.endswith("_test.go"), F.lit(False))


def is_exported(name: Column) -> Column:
    return name.rlike("^[A-Z]")


def is_constructor(name: Column) -> Column:
    return name.rlike("^New[A-Z]")


def is_project_package(package: Column, module: str) -> Column:
    """Within the module by prefix, its last segment, or main."""
    return package.startswith(module) | (package == module.rsplit("/", 1)[-1]) | (package == "main")


def has_all(tags: list[str], behaviors: Column) -> Column:
    """Whether behaviors has every tag; a null has none."""
    return F.size(F.array_except(F.array(*map(F.lit, tags)).cast("array<string>"), F.coalesce(behaviors, F.array().cast("array<string>")))) == 0


def bare_receiver(receiver: Column) -> Column:
    return F.regexp_replace(receiver, r"^\*", "")


def valid_tags(tags: Column, vocabulary: tuple[str, ...]) -> Column:
    return F.filter(tags, lambda t: t.isin(*vocabulary))
