"""Write, audit, publish: tables are built beside the published ones and swapped by a pointer."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hashing, quality
from ..sources.parts import write_hashed
from ..sources.pointer import Pointer


def domain_decisions(results: DataFrame) -> DataFrame:
    """domain, decision: a failing check of the shared tables blocks all, one of a domain holds that domain."""
    failed = F.bool_or(F.col("status") == "fail")
    return results.groupBy("domain").agg(failed.alias("_f")).select("domain", F.when(F.col("_f") & (F.col("domain") == "shared"), "block").when(F.col("_f"), "hold").otherwise("publish").alias("decision"))


class Build(NamedTuple):
    """Tables as they were written: run, relation -> folder, relation -> sums of its hash."""

    run: str
    paths: dict[str, str]
    sums: dict[str, dict]


class Publisher:
    """Publishes relations under a folder. domains: relation -> domain.

    Each publish writes new folders, checks them, and moves one pointer that names
    the folder of every relation; a held domain keeps its earlier folders.
    One publisher at a time may write.
    """

    def __init__(self, spark: SparkSession, root: str, domains: dict[str, str]):
        self.spark, self.root, self.domains = spark, root, domains
        self._current = Pointer(spark, root, "current", {"publish_id": None, "relations": {}, "held": [], "hashes": {}, "rows": {}})

    def _pointer(self) -> dict:
        return self._current.read()

    def build(self, tables: dict[str, DataFrame]) -> Build:
        """The tables written to new folders; each write counts and hashes what it writes, so no table is read again for that."""
        run = uuid.uuid4().hex
        paths = {name: f"{self.root}/runs/{run}/{name}" for name in tables}
        return Build(run, paths, {name: write_hashed(df, paths[name]) for name, df in tables.items()})

    def publish(self, tables: dict[str, DataFrame] | Build, checks: list[quality.Check] | Callable[[dict[str, DataFrame]], list[quality.Check]]) -> list[str]:
        """The relations that changed; none if a shared check fails.

        tables: may be a build, of any publisher, which is not written again.
        checks: given as a function of the tables, it gets them as they were written,
        so that what is published is what was audited.
        """
        old = self._pointer()
        run, paths, sums = tables if isinstance(tables, Build) else self.build(tables)
        if callable(checks):
            checks = checks({name: self.spark.read.parquet(path) for name, path in paths.items()})
        decisions = {r.domain: r.decision for r in domain_decisions(quality.run_checks(checks)).collect()} if checks else {}
        if "block" in decisions.values():
            return []
        held = [n for n in paths if decisions.get(self.domains[n]) == "hold"]
        fresh = {n: paths[n] for n in paths if n not in held}
        new, hashes = old["relations"] | fresh, old["hashes"] | {n: hashing.hash_of(sums[n]) for n in fresh}
        rows = old["rows"] | {n: int(sums[n]["n_rows"]) for n in fresh}
        self._current.write({"publish_id": run, "relations": new, "held": held, "hashes": hashes, "rows": rows})
        return [n for n in new if hashes.get(n) != old["hashes"].get(n)]

    def published(self) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(p) for n, p in self._pointer()["relations"].items()}

    def held(self) -> list[str]:
        return self._pointer()["held"]

    def live(self) -> str | None:
        return self._pointer()["publish_id"]

    def hashes(self) -> dict[str, str]:
        return self._pointer()["hashes"]

    def rows(self) -> dict[str, int]:
        return self._pointer()["rows"]


def export_serving(spark: SparkSession, publisher: Publisher, target: str, prefixes: tuple[str, ...]) -> DataFrame:
    """Copies the published relations with these prefixes; returns the manifest: export and publish id, row counts, hashes, as the copying counted them."""
    tables = {n: df for n, df in publisher.published().items() if n.startswith(prefixes)}
    sums = {n: write_hashed(df, f"{target}/{n}") for n, df in tables.items()}
    hashes = {n: hashing.hash_of(s) for n, s in sums.items()}
    if wrong := [n for n in tables if hashes[n] != publisher.hashes()[n]]:
        raise ValueError(f"copies differ from what was published: {wrong}")
    counts = {n: int(s["n_rows"]) for n, s in sums.items()}
    row = (uuid.uuid4().hex, publisher.live(), counts, hashes)
    return spark.createDataFrame([row], "export_id string, publish_id string, row_counts map<string, bigint>, hashes map<string, string>")
