"""A small JSON state in a folder that changes whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Pointer:
    """Each write is a new numbered folder; a reader takes the last one that is complete. One writer at a time."""

    def __init__(self, spark: SparkSession, root: str, name: str, default: dict):
        self.spark, self.root, self.name, self.default = spark, root, name, default

    def _last(self) -> int:
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return 0
        names = [x.getPath().getName() for x in fs.listStatus(root)]
        done = [int(n.rpartition("-")[2]) for n in names if n.startswith(f"{self.name}-") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS"))]
        return max(done, default=0)

    def read(self) -> dict:
        last = self._last()
        return json.loads(self.spark.read.text(f"{self.root}/{self.name}-{last:08d}", wholetext=True).first()[0]) if last else dict(self.default)

    def write(self, state: dict) -> None:
        path = f"{self.root}/{self.name}-{self._last() + 1:08d}"
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(path)
