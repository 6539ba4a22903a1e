"""Committing batches and verifying what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.hashing import logical_hash
from .contracts import TableContract
from .ledger import LEDGER, rewind_target
from .pointer import Pointer


class Ledger:
    """Committed batches and the watermark in a folder; one writer at a time.

    The state names the ledger's files and the watermark together, so a commit shows
    whole or not at all.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._pointer = Pointer(spark, root, "state", {"watermark": "", "parts": [], "version": 0})

    def _state(self) -> dict:
        return self._pointer.read()

    def watermark(self) -> str:
        return self._state()["watermark"]

    def rows(self) -> DataFrame:
        parts = self._state()["parts"]
        return self.spark.read.schema(LEDGER).parquet(*parts) if parts else self.spark.createDataFrame([], LEDGER)

    def commit(self, rows: DataFrame, expected: str, advance_to: str) -> bool:
        """Appends ledger rows and moves the watermark, if it is still where the caller found it and moves forward."""
        state = self._state()
        if state["watermark"] != expected or advance_to <= expected:
            return False
        part = f"{self.root}/part-{len(state['parts']):06d}"
        rows.select(*[c.split()[0] for c in LEDGER.split(", ")]).write.mode("overwrite").parquet(part)
        self._pointer.write({"watermark": advance_to, "parts": [*state["parts"], part], "version": state["version"] + 1})
        return True

    def version(self) -> int:
        return self._state()["version"]

    def rewind(self, boundary: str, expected: str, dry_run: bool = False) -> str | None:
        """Moves the watermark back to the last committed batch before the boundary, as a new version; the batches stay committed.

        None if the watermark is not where the caller saw it or no batch is before
        the boundary; a dry run says where it would go and changes nothing.
        """
        state = self._state()
        if state["watermark"] != expected:
            return None
        target = rewind_target(self.rows(), expected, boundary).first()[0]
        if target is not None and not dry_run:
            self._pointer.write(state | {"watermark": target, "version": state["version"] + 1})
        return target


def verify(requested: DataFrame, ledger: DataFrame, runs: DataFrame) -> DataFrame:
    """source_table, batch_id, state: COMMITTED, NO_DATA if the last attempt found none, else MISSING; SCHEMA_VERSION where the request names another version than the one committed."""
    keys = ["source_table", "batch_id"]
    other = F.lit(False)
    if "schema_version" in requested.columns:
        ledger = ledger.withColumn("_version", F.col("schema_version"))
        other = F.col("schema_version") != F.col("_version")
    last = runs.groupBy(*keys).agg(F.max_by("status", "attempt").alias("_status"))
    there = ledger.select(*keys, F.lit(True).alias("_there"), *(["_version"] if "_version" in ledger.columns else []))
    state = F.when(other, "SCHEMA_VERSION").when(F.col("_there"), "COMMITTED").when(F.col("_status") == "SUCCESS_NO_DATA", "NO_DATA").otherwise("MISSING")
    return requested.join(there, keys, "left").join(last, keys, "left").select(*keys, state.alias("state"))


def verify_written(bronze: DataFrame, manifests: DataFrame, contract: TableContract) -> DataFrame:
    """batch_id, n_rows, verified: whether rows and hash, read again, are the manifest's."""
    again = logical_hash(bronze, contract.schema.names, by=["batch_id"]).select("batch_id", F.col("n_rows").alias("_n"), F.col("logical_hash").alias("_h"))
    same = F.coalesce((F.col("_n") == F.col("n_rows")) & (F.col("_h") == F.col("logical_hash")), F.lit(False))
    return manifests.join(again, "batch_id", "left").select("batch_id", "n_rows", same.alias("verified"))
