"""Changes of files as a stream: polling, bursts, and re-indexing of what changed."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader

SCHEMA = "path string, event string, ts timestamp"


def debounced(events: DataFrame, gap: str = "500 milliseconds", *keys: str, watermark: str | None = None) -> DataFrame:
    """The bursts of events (ts, path), each over once nothing has come for the gap: keys, started, n and the
    paths, sorted, none of which is lost. On a stream give a watermark."""
    rows = events.withWatermark("ts", watermark) if watermark else events
    burst = rows.groupBy(F.session_window("ts", gap).alias("w"), *keys).agg(F.count("*").alias("n"), F.array_sort(F.collect_set("path")).alias("paths"))
    return burst.select(*keys, F.col("w.start").alias("started"), "n", "paths")


class FileChanges(DataSource):
    """Files under options path that end with options suffix: a row when one is new, modified or gone. The offset
    is the state of the tree at the last poll, so that directories made later are seen as well."""

    @classmethod
    def name(cls) -> str:
        return "file_changes"

    def schema(self) -> str:
        return SCHEMA

    def simpleStreamReader(self, schema):  # noqa: N802, ARG002
        return _Poll(self.options["path"], self.options.get("suffix", ".go"))


class _Poll(SimpleDataSourceStreamReader):
    def __init__(self, root: str, suffix: str):
        self.root, self.suffix = root, suffix

    def initialOffset(self) -> dict:  # noqa: N802
        return {"seen": "{}"}

    def _tree(self) -> dict[str, int]:
        import os

        out = {}
        for top, folders, files in os.walk(self.root):
            folders[:] = [f for f in folders if not f.startswith(".") and f != "vendor"]
            for f in files:
                if f.endswith(self.suffix):
                    path = os.path.join(top, f)
                    try:
                        out[path] = os.stat(path).st_mtime_ns
                    except OSError:
                        continue
        return out

    def _rows(self, before: dict[str, int], now: dict[str, int]) -> Iterator[tuple]:
        import datetime

        at = datetime.datetime.now()
        for path in sorted(before.keys() | now.keys()):
            if before.get(path) != now.get(path):
                yield path, "deleted" if path not in now else "created" if path not in before else "modified", at

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        before, now = json.loads(start["seen"]), self._tree()
        return iter(list(self._rows(before, now))), {"seen": json.dumps(now)}

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return iter(list(self._rows(json.loads(start["seen"]), json.loads(end["seen"]))))


def changes(spark: SparkSession, path: str, suffix: str = ".go") -> DataFrame:
    spark.dataSource.register(FileChanges)
    return spark.readStream.format("file_changes").option("path", path).option("suffix", suffix).load()


def reindex_on_change(stream: DataFrame, reindex: Callable[[list[str], list[str]], None], checkpoint: str, interval: str = "500 milliseconds"):
    """A streaming query that calls reindex(changed, deleted) once a micro-batch with all of its paths. Batches
    run one after another; what comes meanwhile is in the next."""

    def batch(df: DataFrame, _: int) -> None:
        last = df.groupBy("path").agg(F.max_by("event", "ts").alias("event")).collect()
        changed = sorted(r["path"] for r in last if r["event"] != "deleted")
        deleted = sorted(r["path"] for r in last if r["event"] == "deleted")
        if changed or deleted:
            reindex(changed, deleted)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


