"""A data source for folders of scenes: files of a thousand scenes in each folder, found by the number of the scene.

    use_scene_folders(spark)
    spark.read.format("scene_folders").option("head", "annotation").load(root).where("scene = 12")

opens one file. Files are named ``<head>_<scene>.json``, folders ``<head>_<first>-<end>``; the folder must be one that all
executors see as a file system.
"""

from __future__ import annotations

import os
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from pramana.sources.files import PROPOSALS, SCENE

#: Bytes of text that go to Spark at a time, about.
BATCH = 4 << 20
_PUSHED = "spark.sql.python.filterPushdown.enabled"


@dataclass
class _Folder(InputPartition):
    path: str
    low: int
    high: int
    only: frozenset | None


class SceneFolders(DataSource):
    """Rows (scene, file, text). A schema of fewer columns may be given: files whose text is not asked for are not opened."""

    @classmethod
    def name(cls) -> str:
        return "scene_folders"

    def schema(self) -> str:
        return "scene int, file string, text string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options, schema)


class _Reader(DataSourceReader):
    """One partition for each folder that can hold a wanted scene; filters on the scene are met while folders and names are listed."""

    def __init__(self, options, schema: StructType):
        self.root, self.head, self.ending = options["path"], options.get("head", "annotation"), options.get("ending", "json")
        self.names = schema.fieldNames()
        self.kinds = to_arrow_schema(schema)
        self.low, self.high, self.only = 0, 2**31 - 1, None

    def pushFilters(self, filters):
        for f in filters:
            v = getattr(f, "value", None)
            if getattr(f, "attribute", None) != ("scene",):
                yield f
            elif isinstance(f, EqualTo):
                self._keep({v})
            elif isinstance(f, In):
                self._keep(set(v))
            elif isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, v)
            elif isinstance(f, GreaterThan):
                self.low = max(self.low, v + 1)
            elif isinstance(f, LessThanOrEqual):
                self.high = min(self.high, v)
            elif isinstance(f, LessThan):
                self.high = min(self.high, v - 1)
            elif not isinstance(f, IsNotNull):  # a file's name always has a scene
                yield f

    def _keep(self, scenes: set) -> None:
        self.only = frozenset(scenes if self.only is None else self.only & scenes)

    def partitions(self):
        found = []
        for d in sorted(os.listdir(self.root)):
            m = re.fullmatch(rf"{re.escape(self.head)}_(\d+)-(\d+)", d)
            if m and self._any(int(m[1]), int(m[2]) - 1):
                found.append(_Folder(os.path.join(self.root, d), self.low, self.high, self.only))
        return found or [_Folder("", 0, -1, None)]

    def _any(self, first: int, last: int) -> bool:
        if self.only is not None:
            return any(first <= s <= last and self.low <= s <= self.high for s in self.only)
        return first <= self.high and last >= self.low

    def read(self, part: _Folder):
        if not part.path:
            return
        rows, size = [], 0
        for name in sorted(os.listdir(part.path)):
            m = re.fullmatch(rf"{re.escape(self.head)}_(\d+)\.{re.escape(self.ending)}", name)
            scene = int(m[1]) if m else -1
            if not m or not part.low <= scene <= part.high or (part.only is not None and scene not in part.only):
                continue
            path = os.path.join(part.path, name)
            text = None
            if "text" in self.names:
                with open(path, encoding="utf-8") as f:
                    text = f.read()
                size += len(text)
            rows.append({"scene": scene, "file": path, "text": text})
            if size > BATCH or len(rows) >= 10_000:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{n: r[n] for n in self.names} for r in rows], schema=self.kinds)


def use_scene_folders(spark: SparkSession) -> None:
    """Registers the source and lets filters reach it."""
    spark.conf.set(_PUSHED, "true")
    spark.dataSource.register(SceneFolders)


def scene_texts(spark: SparkSession, root: str, head: str = "annotation") -> DataFrame:
    """(scene, file, text) of all files under ``root``; filters on the scene choose folders and files before any is opened."""
    return spark.read.format("scene_folders").option("head", head).load(root)


def annotations(spark: SparkSession, root: str) -> DataFrame:
    """Annotations by scene, a row for each file; of a file only the fields that a query uses are read from its text."""
    return scene_texts(spark, root).select("scene", F.from_json("text", SCENE).alias("a")).select("scene", "a.*")


def detections(spark: SparkSession, root: str, head: str = "sim") -> DataFrame:
    """Detections by scene: (scene, frame, objects), a row for each frame."""
    f = scene_texts(spark, root, head).select("scene", F.explode(F.from_json("text", PROPOSALS)["frames"]).alias("f"))
    return f.select("scene", F.col("f.frame_index").alias("frame"), F.col("f.objects").alias("objects"))
