"""Bronze batches and the ledger of committed ones.

A batch is a folder of Parquet files under batch_id=; the ledger is a table with
a row for each committed (source_table, batch_id). Readers take exactly the
committed batches, so a half-written one is never seen.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.hashing import logical_hash
from .contracts import SCHEMA_VERSION, TableContract

LEDGER = "source_table string, object_key string, schema_version int, batch_id string, committed_at timestamp, row_count bigint, logical_hash string"
#: Boundaries must say UTC.
UTC_BOUNDARY = re.compile(r"\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?(Z|\+00:00)")


def with_technical(df: DataFrame, contract: TableContract, batch: Column, run_id: str, ingested_at: Column) -> DataFrame:
    return df.withColumns(
        {"_batch_id": batch, "_run_id": F.lit(run_id), "_ingested_at": ingested_at, "_source_table": F.lit(contract.name), "_schema_version": F.lit(contract.version)}
    )


def write_bronze(df: DataFrame, contract: TableContract, path: str, batch: Column, run_id: str, ingested_at: Column) -> DataFrame:
    """Writes batches under path/batch_id=..., refusing to overwrite, and reads them back."""
    contract.check_columns(df)
    out = with_technical(df, contract, batch, run_id, ingested_at)
    out.withColumn("batch_id", F.col("_batch_id")).write.mode("errorifexists").option("compression", "zstd").partitionBy("batch_id").parquet(path)
    return df.sparkSession.read.schema(T.StructType([*out.schema, T.StructField("batch_id", T.StringType())])).parquet(path)


def batch_manifest(bronze: DataFrame, contract: TableContract) -> DataFrame:
    """Per batch: rows, order-free hash, first and last cursor, schema version."""
    cur = contract.cursor_of()
    return logical_hash(bronze, [*contract.schema.names], by=["batch_id"]).join(
        bronze.groupBy("batch_id").agg(F.min(cur).alias("first_cursor"), F.max(cur).alias("last_cursor"), F.max("_schema_version").alias("schema_version")), "batch_id"
    )


def invalid_manifests(manifests: DataFrame, contract: TableContract) -> DataFrame:
    """batch_id and reasons of manifests that cannot be right."""
    reasons = F.filter(
        F.array(
            F.when(~F.coalesce(F.col("batch_id"), F.lit("")).rlike(r"^[A-Za-z0-9_]+$"), "BATCH_ID"),
            F.when(F.coalesce(F.col("n_rows"), F.lit(0)) < 1, "ROW_COUNT"),
            F.when(F.col("first_cursor").isNull() | (F.col("first_cursor") > F.col("last_cursor")), "CURSOR_RANGE"),
            F.when(~F.coalesce(F.col("logical_hash"), F.lit("")).rlike("^[0-9a-f]{64}$"), "HASH"),
            F.when(F.coalesce(F.col("schema_version"), F.lit(0)) != contract.version, "SCHEMA_VERSION"),
        ),
        lambda x: x.isNotNull(),
    )
    return manifests.select("batch_id", reasons.alias("reasons")).filter(F.size("reasons") > 0)


def commit_rows(manifests: DataFrame, contract: TableContract, committed_at: Column) -> DataFrame:
    """The ledger rows of verified batches."""
    return manifests.select(
        F.lit(contract.name).alias("source_table"), F.concat(F.lit(f"{contract.name}/batch_id="), F.col("batch_id")).alias("object_key"), F.lit(contract.version).alias("schema_version"),
        "batch_id", committed_at.alias("committed_at"), F.col("n_rows").alias("row_count"), "logical_hash",
    )


def committed(ledger: DataFrame, as_of: str | None = None) -> DataFrame:
    """Committed batches, up to an explicit UTC boundary if one is given, in replay order."""
    if as_of is not None:
        if not UTC_BOUNDARY.fullmatch(as_of):
            raise ValueError(f"boundary {as_of!r} is not an ISO 8601 timestamp in UTC")
        ledger = ledger.filter(F.col("committed_at") <= F.to_timestamp(F.lit(as_of)))
    return ledger.orderBy("source_table", "committed_at", "object_key")


def replay_evidence(ledger: DataFrame, as_of: str | None, full_refresh: bool) -> DataFrame:
    if as_of is not None and not full_refresh:
        raise ValueError("a build as of a boundary must be a full refresh")
    return committed(ledger, as_of).agg(F.count("*").alias("object_count"), F.max("committed_at").alias("max_committed_at")).withColumns({"bronze_as_of": F.lit(as_of), "full_refresh": F.lit(full_refresh)})


def bronze_source(spark: SparkSession, path: str, catalog: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the committed batches; the join on the partition column prunes folders. Typed and empty if there are none."""
    bronze = spark.read.schema(T.StructType([*[f for f in schema if f.name != "batch_id"], T.StructField("batch_id", T.StringType())])).parquet(path)
    return bronze.join(catalog.select("batch_id").distinct(), "batch_id", "left_semi")


def empty_relation(spark: SparkSession, contract: TableContract) -> DataFrame:
    return spark.createDataFrame([], contract.schema)


def unsupported_versions(ledger: DataFrame, supported: tuple[int, ...] = (SCHEMA_VERSION,)) -> DataFrame:
    return ledger.filter(~F.col("schema_version").isin(*supported)).groupBy("source_table", "schema_version").agg(F.count("*").alias("n_objects"))


def batch_reuse(requested: DataFrame, ledger: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
    """SKIP a requested batch that is committed with the same rows and hash (and columns `also`, such as cursor range and schema version), CONFLICT if they differ, else RUN."""
    columns = ["row_count", "logical_hash", *also]
    old = ledger.select("source_table", "batch_id", F.lit(True).alias("_old"), *[F.col(c).alias(f"_old_{c}") for c in columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_old_{c}")) for c in columns])
    decision = F.when(F.col("_old").isNull(), "RUN").when(same, "SKIP").otherwise("CONFLICT")
    return requested.join(old, ["source_table", "batch_id"], "left").withColumn("decision", decision).drop("_old", *[f"_old_{c}" for c in columns])


def orphan_objects(written: DataFrame, ledger: DataFrame) -> DataFrame:
    """Batches on storage that are not committed."""
    return written.join(ledger, ["source_table", "batch_id"], "left_anti")


def unlisted_files(files: DataFrame, ledger: DataFrame, source_table: str, known: DataFrame | None = None) -> DataFrame:
    """path, length, modified, batch_id and why of the files of a listing that no commit stands for.

    UNCOMMITTED: the ledger has no such batch of the table. UNKNOWN_FILE: the batch is
    committed, but the file is none of those that the commit named (known: path). NO_BATCH:
    it lies outside the batch folders. Spark's own markers are no data files.
    """
    data = files.filter(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]"))
    batch = F.nullif(F.regexp_extract("path", r"/batch_id=([^/]+)/", 1), F.lit(""))
    rows = ledger.filter(F.col("source_table") == source_table).select("batch_id", F.lit(True).alias("_there")).distinct()
    found = data.withColumn("batch_id", batch).join(rows, "batch_id", "left")
    why = F.when(F.col("batch_id").isNull(), "NO_BATCH").when(F.col("_there").isNull(), "UNCOMMITTED")
    if known is not None:
        found = found.join(known.select("path", F.lit(True).alias("_named")), "path", "left")
        why = why.when(F.col("_named").isNull(), "UNKNOWN_FILE")
    return found.withColumn("why", why).filter("why IS NOT NULL").select("path", "length", "modified", "batch_id", "why")


def reconcile_orphans(orphans: DataFrame, manifests: DataFrame, last_committed: Column, runs: DataFrame | None = None) -> DataFrame:
    """accept, or the reasons against an orphan: no manifest, other rows or hash, not after the last commit.

    Schema version and cursor range are compared where both sides have them; with
    runs (batch_id, status), so is that the batch's run succeeded.
    """
    more = [c for c in ("schema_version", "last_cursor") if c in orphans.columns and c in manifests.columns]
    m = manifests.select("batch_id", F.col("n_rows").alias("m_rows"), F.col("logical_hash").alias("m_hash"), *[F.col(c).alias(f"m_{c}") for c in more])
    joined, codes = orphans.join(m, "batch_id", "left"), {"schema_version": "SCHEMA_VERSION", "last_cursor": "CURSOR_RANGE"}
    there = F.col("m_rows").isNotNull()
    rules = [
        F.when(~there, "NO_MANIFEST"),
        F.when(F.col("m_rows") != F.col("row_count"), "ROW_COUNT"),
        F.when(F.col("m_hash") != F.col("logical_hash"), "HASH"),
        *[F.when(there & ~F.col(c).eqNullSafe(F.col(f"m_{c}")), codes[c]) for c in more],
        F.when(F.col("batch_id") <= last_committed, "NOT_AFTER_WATERMARK"),
    ]
    if runs is not None:
        joined = joined.join(runs.select("batch_id", F.col("status").alias("_status")), "batch_id", "left")
        rules.append(F.when(~F.col("_status").eqNullSafe("SUCCESS"), "RUN_STATE"))
    reasons = F.filter(F.array(*rules), lambda x: x.isNotNull())
    return joined.select("source_table", "batch_id", "row_count", reasons.alias("reasons"), (F.size(reasons) == 0).alias("accept"))


def parse_manifests(texts: DataFrame, fields: dict[str, str], utc_field: str) -> DataFrame:
    """batch_id, fields and reasons of manifests in JSON (batch_id, manifest): MISSING a field, TYPE where one does not cast, NOT_UTC where the time lacks its zone."""
    raw = F.from_json("manifest", ", ".join(f"{c} string" for c in [*fields, utc_field]))
    p = texts.select("batch_id", raw.alias("_raw"))
    typed = F.struct(*[F.col(f"_raw.{c}").try_cast(t).alias(c) for c, t in fields.items()])
    missing = reduce(lambda a, b: a | b, [F.col(f"_raw.{c}").isNull() for c in [*fields, utc_field]])
    wrong = reduce(lambda a, b: a | b, [F.col(f"_raw.{c}").isNotNull() & F.col(f"_raw.{c}").try_cast(t).isNull() for c, t in fields.items()])
    zone = F.col(f"_raw.{utc_field}").rlike(r"(Z|\+00:00)$")
    reasons = F.filter(F.array(F.when(missing, "MISSING"), F.when(wrong, "TYPE"), F.when(~zone, "NOT_UTC")), lambda x: x.isNotNull())
    return p.select("batch_id", typed.alias("fields"), reasons.alias("reasons"))


def rewind_target(batches: DataFrame, current: str, boundary: str) -> DataFrame:
    """The last batch before the boundary; the watermark may only move back."""
    if boundary >= current:
        raise ValueError(f"watermark may only move back: {boundary} is not before {current}")
    return batches.filter(F.col("batch_id") < boundary).agg(F.max("batch_id").alias("batch_id"))


def upsert(target: DataFrame, stage: DataFrame, keys: list[str]) -> DataFrame:
    """Stage rows replace the target's rows of their keys; the stage must be unique by key."""
    return target.join(stage.select(*keys), keys, "left_anti").unionByName(stage)
