"""Tables of which a commit replaces whole partitions and leaves the other ones' files."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import hashing
from .pointer import Pointer


def write_observed(df: DataFrame, path: str, metrics: dict[str, Column], drop: tuple[str, ...] = (), by: str | None = None) -> dict:
    """Writes df to a new folder and gives aggregates over the rows written, taken by the write itself.

    The aggregates stand in the job's last stage, whose tasks count once each, also
    those that are repeated. drop: columns that only the metrics read.
    """
    seen = Observation()
    out = df.observe(seen, *[c.alias(k) for k, c in metrics.items()]).drop(*drop).write.mode("errorifexists")
    (out.partitionBy(by) if by else out).parquet(path)
    return seen.get


def table_metrics(df: DataFrame, only: Column | None = None, columns: list[str] | None = None) -> dict[str, Column]:
    """The sums of the table's hash, as metrics of a write."""
    return dict(zip(hashing.SUMS, hashing.digest_sums(hashing.row_hash(df, columns or df.columns), only)))


def write_hashed(df: DataFrame, path: str, only: Column | None = None, columns: list[str] | None = None, drop: tuple[str, ...] = (), by: str | None = None) -> dict:
    """write_observed() with the sums of the table's hash, for which each row is hashed once: the digest is a column of the rows observed."""
    hashed = df.withColumn("_digest", hashing.row_hash(df, columns or df.columns))
    return write_observed(hashed, path, dict(zip(hashing.SUMS, hashing.digest_sums(F.col("_digest"), only))), ("_digest", *drop), by)


class PartitionedTable:
    """A table in a folder, dealt by a column of integers or dates.

    The state names the folder of each partition, the sums of the table's hash and what
    the caller keeps with them (`meta`), so a commit shows whole or not at all. A commit
    writes the partitions it replaces to new folders; the files of the others stay where
    they are, and earlier states stay readable. One writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str, by: str, schema: T.StructType, hashed: list[str] | None = None):
        """hashed: the columns that the hash is of, all if not given."""
        self.spark, self.root, self.by, self.schema, self.hashed = spark, root, by, schema, hashed or schema.names
        self._pointer = Pointer(spark, root, "state", {"parts": {}, "sums": dict.fromkeys(hashing.SUMS, 0), "meta": {}})

    def state(self) -> dict:
        return self._pointer.read()

    def meta(self) -> dict:
        return self.state()["meta"]

    def hash(self) -> str:
        return hashing.hash_of(self.state()["sums"])

    def read(self, values: Iterable | None = None) -> DataFrame:
        """The rows; of the partitions with these values alone, if given."""
        parts = self.state()["parts"]
        wanted = parts if values is None else [str(v) for v in values if str(v) in parts]
        paths = [parts[v] for v in wanted]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def replace(self, kept: DataFrame | None, fresh: DataFrame, removed: DataFrame | None, values: Iterable, meta: dict | None = None) -> None:
        """Makes kept and fresh the rows of the partitions with these values.

        removed: the rows that were there and are not kept. The hash moves by the rows
        that come and go; fresh rows are added up as they are written.
        """
        state, run = self.state(), f"{self.root}/runs/{uuid.uuid4().hex}"
        columns = self.schema.names
        rows = fresh.select(*columns).withColumn("_fresh", F.lit(True))
        if kept is not None:
            rows = kept.select(*columns).withColumn("_fresh", F.lit(False)).unionByName(rows)
        part = F.coalesce(F.col(self.by).cast("string"), F.lit("none"))
        # Rows of a partition go to few files, and those of a large one to many.
        dealt = rows.withColumn("_part", part).hint("rebalance", "_part")
        added = write_hashed(dealt, run, F.col("_fresh"), self.hashed, ("_fresh",), "_part")
        gone = removed.select(hashing.row_hash(removed, self.hashed).alias("_h")).agg(*hashing.digest_sums(F.col("_h"))).first() if removed is not None else dict.fromkeys(hashing.SUMS, 0)
        sums = {c: int(state["sums"][c]) + int(added[c]) - int(gone[c]) for c in hashing.SUMS}
        parts = {v: p for v, p in state["parts"].items() if v not in {str(x) for x in values}}
        written = self._written(run)
        if clash := [v for v in written if v in parts]:
            raise ValueError(f"rows of partitions that are not replaced: {clash[:5]}")
        self._pointer.write({"parts": parts | written, "sums": sums, "meta": state["meta"] | (meta or {})})

    def _written(self, run: str) -> dict[str, str]:
        """The partitions in a run's folder, by value."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(run)
        found = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path)
        names = [x.getPath().getName() for x in found]
        return {n.partition("=")[2]: f"{run}/{n}" for n in names if n.startswith("_part=")}
