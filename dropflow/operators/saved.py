"""Saving of fitted stages that are written in Python, so that a ``PipelineModel`` holds them.

A stage names its plain values (``state``), its tables (``tables``) and its Spark
ML parts (``parts``); the writer puts the values into a small Parquet table beside
Spark ML's metadata, tables and parts into folders of their own.
"""

from __future__ import annotations

import json
import posixpath

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import DataFrame


class SavedState(MLWritable, MLReadable):
    """Mixin of a fitted stage: ``state``/``restore`` carry JSON values (lists are stored an element a row)."""

    def state(self) -> dict:
        raise NotImplementedError

    def restore(self, state: dict) -> None:
        raise NotImplementedError

    def tables(self) -> dict[str, DataFrame]:
        return {}

    def restore_table(self, name: str, table: DataFrame) -> None:
        pass

    def parts(self) -> dict[str, MLWritable]:
        return {}

    def restore_part(self, name: str, part) -> None:
        pass

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


class _Writer(MLWriter):
    def __init__(self, instance: SavedState) -> None:
        super().__init__()
        self.instance = instance

    def saveImpl(self, path: str) -> None:
        spark, stage = self.sparkSession, self.instance
        rows, tables, parts = [], stage.tables(), stage.parts()
        for key, value in stage.state().items():
            if isinstance(value, list):
                rows += [(key, -1, "[]")] + [(key, i, json.dumps(v)) for i, v in enumerate(value)]
            else:
                rows.append((key, None, json.dumps(value)))
        DefaultParamsWriter.saveMetadata(stage, path, spark, extraMetadata={
            "tables": sorted(tables), "parts": {k: _class_name(p) for k, p in parts.items()}})
        spark.createDataFrame(rows, "key string, place long, value string").coalesce(1).write.parquet(posixpath.join(path, "state"))
        for name, table in tables.items():
            table.write.parquet(posixpath.join(path, "tables", name))
        for name, part in parts.items():
            part.write().save(posixpath.join(path, "parts", name))


class _Reader(MLReader):
    def __init__(self, cls: type) -> None:
        super().__init__()
        self.cls = cls

    def load(self, path: str) -> SavedState:
        spark = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        stage = self.cls()
        stage._resetUid(metadata["uid"])
        state: dict = {}
        for key, place, value in spark.read.parquet(posixpath.join(path, "state")).orderBy("key", "place").collect():
            if place is None:
                state[key] = json.loads(value)
            elif place < 0:
                state[key] = []
            else:
                state[key].append(json.loads(value))
        stage.restore(state)
        for name in metadata["tables"]:
            stage.restore_table(name, spark.read.parquet(posixpath.join(path, "tables", name)))
        for name, kind in metadata["parts"].items():
            module, cls = kind.rsplit(".", 1)
            loaded = getattr(__import__(module, fromlist=[cls]), cls).load(posixpath.join(path, "parts", name))
            stage.restore_part(name, loaded)
        return stage


def _class_name(part) -> str:
    return f"{type(part).__module__}.{type(part).__qualname__}"
