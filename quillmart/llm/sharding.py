"""Hilbert-curve sharding: rows ordered by a curve through quantised metadata, cut into runs.

Each dimension is quantised by its own distribution into 2 ** bits bins, text by the
order of its whole values; the
Hilbert index of the bins orders the rows; the order is cut into shards whose row
counts differ by one at most. Rows that are near on the curve are near in every
dimension, so a shard's files have narrow ranges that a reader can prune by.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import keyed, materialize, ROW

SHARDS = 24
BITS = 4
DIMENSIONS = ("lang", "source", "n_chars")


def is_text(df: DataFrame, name: str) -> bool:
    return not isinstance(df.schema[name].dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType))


def ordinal(df: DataFrame, name: str) -> Column:
    """A value in the column's own order: a number for numbers, dates and booleans, else text."""
    kind = df.schema[name].dataType
    if is_text(df, name):
        return F.col(name).cast("string")
    if isinstance(kind, (T.NumericType, T.BooleanType)):
        return F.col(name).cast("double")
    return F.unix_micros(F.col(name).cast("timestamp")).cast("double")


def in_order(df: DataFrame, key: list[str | Column], weight: Column) -> DataFrame:
    """df written out in an order, with _q_before, the weight of all rows before: a range partition's offset plus the rows before in it.

    Only one sum for each partition is added up in one place.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(tasks, *key).sortWithinPartitions(*key)
    placed = materialize(ranged.withColumn("_q_at", F.monotonically_increasing_id()).withColumn("_q_weight", weight.cast("long")))
    placed = placed.withColumn("_q_part", F.shiftright("_q_at", 33))
    sums = placed.groupBy("_q_part").agg(F.sum("_q_weight").alias("_q_n"))
    sizes = F.sort_array(F.collect_list(F.struct("_q_part", "_q_n")))
    # One row for each partition: their number is the session's, not the data's.
    offsets = sums.agg(sizes.alias("s")).select(F.posexplode("s").alias("i", "own"), "s").select(
        F.col("own._q_part").alias("_q_part"), F.aggregate(F.slice("s", F.lit(1), F.col("i")), F.lit(0).cast("long"), lambda acc, x: acc + x["_q_n"]).alias("_q_before")
    )
    return placed.join(F.broadcast(offsets), "_q_part")


def text_edges(df: DataFrame, name: str, bits: int) -> list[str]:
    """The distinct quantiles of a text column by whole values: at most 2 ** bits - 1 of them. Each value is counted first, so a frequent one is one row."""
    counts = df.filter(F.col(name).isNotNull()).groupBy(name).agg(F.count("*").alias("n"))
    placed = in_order(counts, [name], F.col("n"))
    along = W.partitionBy("_q_part").orderBy("_q_at").rowsBetween(W.unboundedPreceding, 0)
    upto = placed.select(name, "n", (F.col("_q_before") + F.sum("n").over(along)).alias("upto"))
    total = df.filter(F.col(name).isNotNull()).count()
    step = lambda x: F.floor(x * (1 << bits) / F.lit(max(total, 1)))
    crossed = upto.filter((step(F.col("upto")) > step(F.col("upto") - F.col("n"))) & (F.col("upto") < total))
    return sorted((r[0] for r in crossed.select(name).collect()), key=lambda v: v.encode("utf-8", "surrogatepass"))


def bin_edges(df: DataFrame, columns: list[str], bits: int) -> list[list]:
    """For each ordinal column its distinct quantiles: at most 2 ** bits - 1 values, of numbers from mergeable sketches."""
    shares = [k / (1 << bits) for k in range(1, 1 << bits)]
    numbers = [c for c in columns if not is_text(df, c)]
    found = df.agg(*[F.percentile_approx(c, shares, 10_000).alias(c) for c in numbers]).first() if numbers else {}
    return [sorted(set(found[c] or [])) if c in numbers else text_edges(df, c, bits) for c in columns]


def bin_of(value: Column, edges: list) -> Column:
    """The number of edges below the value; nulls are in the first bin."""
    return sum((F.when(value > F.lit(e), 1).otherwise(0) for e in edges), F.lit(0))


def with_hilbert_index(df: DataFrame, axes: list[str], bits: int, name: str) -> DataFrame:
    """Adds the Hilbert index of the axes (integers below 2 ** bits), by bit operations step by step."""
    n = len(axes)
    x = [f"_q_x{i}" for i in range(n)]
    df = df.withColumns({x[i]: F.col(axes[i]).cast("long") for i in range(n)})
    for level in range(bits - 1, 0, -1):
        low = F.lit((1 << level) - 1).cast("long")
        for i in range(n):
            on = F.shiftright(x[i], level).bitwiseAND(F.lit(1).cast("long")) == 1
            both = F.col(x[0]).bitwiseXOR(F.col(x[i])).bitwiseAND(low)
            flip = F.when(on, low).otherwise(both)
            keep = F.when(on, F.lit(0).cast("long")).otherwise(both)
            df = df.withColumns({x[0]: F.col(x[0]).bitwiseXOR(flip)} | ({x[i]: F.col(x[i]).bitwiseXOR(keep)} if i else {}))
    for i in range(1, n):
        df = df.withColumn(x[i], F.col(x[i]).bitwiseXOR(F.col(x[i - 1])))
    turn = F.lit(0).cast("long")
    for level in range(bits - 1, 0, -1):
        on = F.shiftright(x[n - 1], level).bitwiseAND(F.lit(1).cast("long")) == 1
        turn = turn.bitwiseXOR(F.when(on, F.lit((1 << level) - 1).cast("long")).otherwise(F.lit(0).cast("long")))
    df = df.withColumn("_q_turn", turn)
    index = F.lit(0).cast("long")
    for level in range(bits - 1, -1, -1):
        for i in range(n):
            bit = F.shiftright(F.col(x[i]).bitwiseXOR(F.col("_q_turn")), level).bitwiseAND(F.lit(1).cast("long"))
            index = index + F.shiftleft(bit, level * n + n - 1 - i)
    return df.withColumn(name, index).drop("_q_turn", *x)


def hilbert_order(docs: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """Adds curve_index (where the row's bins lie on the curve) and position (its rank from 0, gapless).

    Ties on the curve are broken by a hash of the row key, so no cell of the grid,
    however full, has to be in one task.
    """
    axes = [f"_q_a{i}" for i in range(len(dimensions))]
    numbers = docs.withColumns({a: ordinal(docs, d) for a, d in zip(axes, dimensions)})
    edges = bin_edges(numbers, axes, bits)
    binned = numbers.withColumns({a: bin_of(F.col(a), e) for a, e in zip(axes, edges)})
    curved = with_hilbert_index(binned, axes, bits, "curve_index").drop(*axes)
    placed = in_order(curved, ["curve_index", F.xxhash64(ROW), ROW], F.lit(1))
    return placed.withColumn("position", F.col("_q_before") + F.col("_q_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_q_part", "_q_before", "_q_at", "_q_weight")


def cut_runs(ordered: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Adds shard and slot: runs of the order whose row counts differ by one at most."""
    q, r = divmod(ordered.count(), shards)
    # The first r shards have q + 1 rows.
    edge, pos = r * (q + 1), F.col("position")
    shard = F.when(pos < edge, F.floor(pos / (q + 1))).otherwise(r + F.floor((pos - edge) / max(q, 1)))
    cut = ordered.withColumn("shard", shard.cast("int"))
    return cut.withColumn("slot", pos - F.col("shard").cast("long") * q - F.least(F.col("shard").cast("long"), F.lit(r).cast("long")))


def shard_documents(docs: DataFrame, shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, curve_index, shard, slot for each row of docs.

    size is the text's UTF-8 bytes plus 8; a null text has none and the checksum
    of nothing. Nulls of a dimension are in its first bin. Repeated rows each get a
    slot. Only metadata moves, never a text. An empty table gives no rows; of
    fewer rows than shards each has a shard of its own.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    meta = keyed(
        docs,
        F.col("doc_id").alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).cast("long").alias("text_crc32"),
        *[F.col(d).alias(f"_q_d_{d}") for d in dimensions],
    )
    ordered = hilbert_order(meta, tuple(f"_q_d_{d}" for d in dimensions), bits)
    return cut_runs(ordered, shards).select("doc_id", "size", "text_crc32", "curve_index", "shard", "slot", *[F.col(f"_q_d_{d}").alias(f"dim_{d}") for d in dimensions])


def shard_ranges(sharded: DataFrame, dimensions: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """The manifest a reader prunes by: per shard its rows, bytes and each dimension's least and greatest value."""
    bounds = [f(f"dim_{d}").alias(f"{n}_{d}") for d in dimensions for n, f in (("min", F.min), ("max", F.max))]
    return sharded.groupBy("shard").agg(F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), *bounds)
