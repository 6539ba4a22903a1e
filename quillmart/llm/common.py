"""Helpers that the corpus operators share."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Row key of one scan of the input; operators never let it out.
ROW = "_q_row"
#: Has Spark delete a query's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Most row keys that are broadcast, some 70 bytes each as the driver holds them; more are joined by a shuffle.
BROADCAST_ROWS = 4_000_000
#: Bytes of text that a task works on at a time; a longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Rows of an Arrow batch of documents.
ARROW_ROWS = 2_000
#: A run of the six ASCII white-space characters.
SPACE_RUN = r"[\x20\x09-\x0D]+"
#: bytes.translate table that lower-cases A-Z and touches nothing else.
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship_package(spark: SparkSession) -> None:
    """Sends the package to the workers, once a session; in local mode too, as a driver's sys.path is not theirs."""
    sc = spark.sparkContext
    if getattr(sc, "_quillmart_sent", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    base = os.path.join(tempfile.mkdtemp(prefix="spark-"), "quillmart")
    sc.addPyFile(shutil.make_archive(base, "zip", root, "quillmart"))
    sc._quillmart_sent = True


def prepare(spark: SparkSession) -> None:
    """Readies a session for documents: ships the package, and unless the user chose a size, has Arrow batches hold ARROW_ROWS rows, as Spark's 10,000 long texts for each task fill an executor."""
    ship_package(spark)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir, or one set by setCheckpointDir; a local one only in local mode."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not found:
        if not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = sc.getCheckpointDir()
    return found.rstrip("/")


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Queries run in it leave no shuffle files."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, by: str | None = None, **options: str) -> DataFrame:
    """Cuts the lineage: the rows as a Parquet table in the shared folder, in a folder for each value of `by`, read back.

    Unlike checkpoint() this runs the plan once, keeps columns prunable and
    gives the optimizer the table's true size.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quillmart/{uuid.uuid4().hex}"
    with cleaning(spark):
        write = df.write.options(**options)
        (write.partitionBy(by) if by else write).parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_at_exit(spark: SparkSession, path: str) -> None:
    """Has the session delete a folder of the shared place when it ends; lazy results may read it until then."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(p)


def discard(table: DataFrame, end: str = "") -> None:
    """Deletes a materialized table that no lazy result still reads, or those of its folders that end so."""
    spark = table.sparkSession
    for f in {x.rpartition("/")[0] for x in table.inputFiles()}:
        if "/quillmart/" in f and f.endswith(end):
            path = spark._jvm.org.apache.hadoop.fs.Path(f)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def keyed(docs: DataFrame, *columns: Column) -> DataFrame:
    """The columns asked for, and a row key that tells repeated rows apart.

    The key is a scan position: docs must be a table or a materialized result,
    so that each scan, also of a retried task, numbers the rows alike.
    """
    return docs.select(F.monotonically_increasing_id().alias(ROW), *columns)


def settled(docs: DataFrame) -> DataFrame:
    """docs itself if each scan gives its rows in the same places (files or local rows, filtered or projected), else its rows written out."""
    plan = docs._jdf.queryExecution().optimizedPlan().toString()
    nodes = {re.sub(r"^[^A-Za-z]*", "", line).split(" ")[0].split("[")[0] for line in plan.splitlines()}
    return docs if nodes <= {"Project", "Filter", "Relation", "LocalRelation", "LogicalRDD", "SubqueryAlias"} else materialize(docs)


def free_name(docs: DataFrame, name: str) -> str:
    """The name, with as many underscores after it as tell it from the columns of docs."""
    taken = {c.lower() for c in docs.columns}
    return next(x for x in (name + "_" * k for k in range(len(taken) + 1)) if x.lower() not in taken)


def without(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """docs, whatever its columns, without the rows at the scan positions in rows (ROW).

    Positions are broadcast up to BROADCAST_ROWS of them, so that texts stay where
    they are; beyond that both sides are shuffled.
    """
    name = free_name(docs, ROW)
    gone = materialize(rows.select(F.col(ROW).alias(name)))
    few = gone.count() <= BROADCAST_ROWS
    return docs.withColumn(name, F.monotonically_increasing_id()).join(F.broadcast(gone) if few else gone, name, "left_anti").drop(name)


def slices(batches: Iterator[pa.RecordBatch], column: int = -1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut to about `most` bytes of text in the column, a row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.columns[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
            yield batch.slice(at, to - at)
            at = to


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bool, pa.RecordBatch]]:
    """Slices of the batches with one value of the first column each, and whether the value is new."""
    started, last = False, None
    for batch in batches:
        keys = batch.column(0)
        if not batch.num_rows:
            continue
        values, valid = pc.fill_null(keys, 0).to_numpy(zero_copy_only=False), pc.is_valid(keys).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero((values[1:] != values[:-1]) | (valid[1:] != valid[:-1])) + 1
        edges = [0, *cuts.tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            key = keys[a].as_py()
            yield key, not started or key != last, batch.slice(a, b - a)
            started, last = True, key


def place(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The index of each wanted value in the sorted keys, -1 where it is not there."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def flat_words(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The words of all lists, one after the other, as codes into the distinct ones."""
    import pandas as pd

    flat = np.empty(sum(map(len, lists)), object)
    flat[:] = list(chain.from_iterable(lists))
    return pd.factorize(flat)


def word_hashes(words: np.ndarray) -> np.ndarray:
    """XXH64 of each word, unsigned."""
    from xxhash import xxh64_intdigest

    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def lower_ascii(col: Column) -> Column:
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def raw_bytes(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")
