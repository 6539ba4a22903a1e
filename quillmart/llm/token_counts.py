"""Token counts through a digest cache.

Stored counts are keyed by the digest of the content and the digest of the
tokenizer file. Only contents without a stored count are encoded, each once,
and their counts are appended to the cache.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROW, keyed, materialize, settled, shared_dir
from .encoder import encoder

CACHE = "content_sha256 string, tokenizer_sha256 string, n_tokens long"


def tokenizer_version(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def new_cache_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/quillmart/token_counts-{uuid.uuid4().hex}"


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    """The stored counts; a typed empty table while nothing is stored. Of repeated keys one row counts."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def count_tokens(docs: DataFrame, tokenizer: str, cache_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row of docs (doc_id, text).

    Null texts count as empty: no bytes and no tokens. Repeated rows each get
    their row; a null doc_id stays null. An empty table gives no rows and leaves
    the cache as it is. The content key is the text itself, byte for byte, as any
    normalisation could change its count. Copies of a text are encoded once: the
    representative row is chosen from (digest, row key) pairs alone. Rows to encode
    are told by their scan position: up to BROADCAST_ROWS positions are broadcast, so
    that texts stay where they are; beyond that texts move once, dealt by position,
    which no group can make uneven. If nothing misses, texts are read for their digests alone.
    """
    spark, version, docs = docs.sparkSession, tokenizer_version(tokenizer), settled(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    digests = materialize(rows.select(ROW, "doc_id", F.sha2("text", 256).alias("content_sha256"), F.octet_length("text").cast("long").alias("n_bytes")))
    stored = read_cache(spark, cache_path).filter(F.col("tokenizer_sha256") == version).groupBy("content_sha256").agg(F.min("n_tokens").alias("n_tokens"))
    misses = (
        digests.groupBy("content_sha256").agg(F.min(ROW).alias(ROW))
        .join(stored, "content_sha256", "left_anti")
        .select(ROW)
    )
    misses = materialize(misses)
    n = misses.count()

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        for batch in batches:
            # A slice of texts at a time is out of Arrow's memory.
            counts = [len(x) // 4 for at in range(0, batch.num_rows, 256) for x in enc.encode(batch.column(1).slice(at, 256).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(counts), pa.string()), pa.array(counts, pa.int64())], ["content_sha256", "tokenizer_sha256", "n_tokens"])

    if n:
        chosen = rows.select(ROW, "text").join(F.broadcast(misses) if n <= BROADCAST_ROWS else misses, ROW)
        chosen.select(F.sha2("text", 256).alias("content_sha256"), "text").mapInArrow(lengths, CACHE).write.mode("append").parquet(cache_path)
    cache = read_cache(spark, cache_path).filter(F.col("tokenizer_sha256") == version)
    if cache.count() > 2 * digests.count():  # a cache of many runs: only this run's contents are copied
        cache = cache.join(digests.select("content_sha256").distinct(), "content_sha256", "left_semi")
    counts = cache.groupBy("content_sha256").agg(F.min("n_tokens").alias("n_tokens"))
    # A table of its own, so that both sides of the last join are plain exchanges, whose hot keys the adaptive join splits.
    counts = materialize(counts)
    return digests.join(counts, "content_sha256").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
