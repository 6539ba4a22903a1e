"""Order-free hashes of tables, and where two tables differ."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, is_distinct


def row_hash(df: DataFrame, columns: list[str]) -> Column:
    return F.sha2(canonical_json(df.select(*columns)), 256)


#: The sums that a table's hash is made of.
SUMS = ("n_rows", "s0", "s1", "s2", "s3")


def digest_sums(digest: Column, only: Column | None = None) -> list[Column]:
    """The row count and four sums over the numbers that each row's digest is cut into, of the rows for which `only` holds."""
    out = [F.count("*") if only is None else F.count_if(only)]
    for i in range(4):
        lane = F.conv(F.substring(digest, 16 * i + 1, 15), 16, 10).cast("bigint")
        # Halves of 30 bits add up in longs, up to 2 ** 33 rows; beyond that the sum fails.
        total = lambda x: F.coalesce(F.sum(x if only is None else F.when(only, x)), F.lit(0)).cast("decimal(20,0)")
        out.append((total(F.shiftright(lane, 30)) * F.lit(1 << 30).cast("decimal(10,0)") + total(lane.bitwiseAND(F.lit((1 << 30) - 1)))).cast("decimal(38,0)"))
    return [c.alias(name) for c, name in zip(out, SUMS)]


def hash_of(sums: dict[str, int]) -> str:
    """The hash of a table with these sums."""
    return hashlib.sha256(":".join(str(int(sums[c])) for c in SUMS).encode()).hexdigest()


def logical_hash(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """n_rows and logical_hash, for each group of `by`: the same for any order of the same rows, repeats counted.

    Each row's digest is cut into four numbers that are added up, so a table is
    hashed in one pass without a sort, and a repeated row does not cancel out. As sums
    add and subtract, so do the hashes of tables that change (see hash_of).
    """
    rows = df.select(*(by or []), row_hash(df, columns or df.columns).alias("_h"))
    agg = rows.groupBy(*(by or [])).agg(*digest_sums(F.col("_h")))
    return agg.withColumn("logical_hash", F.sha2(F.concat_ws(":", *[F.col(c).cast("string") for c in SUMS]), 256)).drop(*SUMS[1:])


def digest_tree(df: DataFrame, keys: list[str], buckets: int = 1024, leaves: int = 64) -> DataFrame:
    """bucket, leaf and the digest sums of the rows whose key falls there: `buckets` * `leaves` rows at most, however large the table.

    It can be stored beside its table: two trees say where the tables differ without reading them.
    """
    return placed_in_tree(df, keys, buckets, leaves).select("_bucket", "_leaf", row_hash(df, df.columns).alias("_h")).groupBy(F.col("_bucket").alias("bucket"), F.col("_leaf").alias("leaf")).agg(*digest_sums(F.col("_h")))


def placed_in_tree(df: DataFrame, keys: list[str], buckets: int, leaves: int) -> DataFrame:
    h = F.xxhash64(*keys)
    return df.withColumns({"_bucket": F.pmod(h, F.lit(buckets)).cast("int"), "_leaf": F.pmod(F.shiftrightunsigned(h, 32), F.lit(leaves)).cast("int")})


def differing_leaves(left: DataFrame, right: DataFrame) -> DataFrame:
    """bucket, leaf where two trees of one shape differ: buckets are compared first, by the sums of their leaves, and leaves only in those that differ."""
    total = lambda t, side: t.groupBy("bucket").agg(*[F.sum(c).alias(f"{side}_{c}") for c in SUMS])
    differ = reduce(lambda a, b: a | b, [is_distinct(F.col(f"a_{c}"), F.col(f"b_{c}")) for c in SUMS])
    buckets = total(left, "a").join(total(right, "b"), "bucket", "full_outer").filter(differ).select("bucket")
    side = lambda t, name: t.join(F.broadcast(buckets), "bucket", "left_semi").select("bucket", "leaf", *[F.col(c).alias(f"{name}_{c}") for c in SUMS])
    return side(left, "a").join(side(right, "b"), ["bucket", "leaf"], "full_outer").filter(differ).select("bucket", "leaf")


def tree_difference(left: DataFrame, right: DataFrame, keys: list[str], buckets: int = 1024, leaves: int = 64, trees: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """keyed_difference() of the rows in leaves that differ: the others never reach the join. trees: the tables' digest trees, if stored."""
    a, b = trees or (digest_tree(left, keys, buckets, leaves), digest_tree(right, keys, buckets, leaves))
    # At most buckets * leaves rows of two integers.
    leaf = F.broadcast(differing_leaves(a, b).select(F.col("bucket").alias("_bucket"), F.col("leaf").alias("_leaf")))
    cut = lambda df: placed_in_tree(df, keys, buckets, leaves).join(leaf, ["_bucket", "_leaf"], "left_semi").select(*df.columns)
    return keyed_difference(cut(left), cut(right), keys)


def relation_hashes(tables: dict[str, DataFrame]) -> DataFrame:
    """relation, n_rows, logical_hash, one pass for each table."""
    out = None
    for name, df in sorted(tables.items()):
        one = logical_hash(df).select(F.lit(name).alias("relation"), "n_rows", "logical_hash")
        out = one if out is None else out.unionByName(one)
    return out


def combined_hash(hashes: DataFrame) -> DataFrame:
    lines = F.transform(F.array_sort(F.collect_list(F.struct("relation", "logical_hash", "n_rows"))), lambda x: F.concat_ws(":", x["relation"], x["logical_hash"], x["n_rows"].cast("string")))
    return hashes.agg(F.sha2(F.array_join(lines, "\n"), 256).alias("combined_hash"), F.count("*").alias("n_relations"))


def mismatched_relations(left: DataFrame, right: DataFrame) -> DataFrame:
    r = right.select("relation", F.col("logical_hash").alias("right_hash"))
    return left.select("relation", F.col("logical_hash").alias("left_hash")).join(r, "relation", "full_outer").filter(is_distinct(F.col("left_hash"), F.col("right_hash")))


def keyed_difference(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """keys and status (left_only, right_only, changed) of the rows that differ; keys are unique."""
    columns = [c for c in left.columns if c not in keys]
    a = left.select(*keys, row_hash(left, columns).alias("_a"))
    b = right.select(*keys, row_hash(right, columns).alias("_b"))
    status = F.when(F.col("_b").isNull(), "left_only").when(F.col("_a").isNull(), "right_only").otherwise("changed")
    return a.join(b, keys, "full_outer").filter(is_distinct(F.col("_a"), F.col("_b"))).select(*keys, status.alias("status"))


def bag_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of either table that the other lacks, repeats counted."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(right.exceptAll(left).withColumn("side", F.lit("right")))


def difference_summary(difference: DataFrame, key: str, sample: int) -> DataFrame:
    """status, n_rows and the first keys of each status of a keyed difference, comma-joined."""
    placed = difference.withColumn("_pos", F.row_number().over(W.partitionBy("status").orderBy(key)))
    first = F.sort_array(F.collect_list(F.when(F.col("_pos") <= sample, F.col(key))))
    return placed.groupBy("status").agg(F.count("*").alias("n_rows"), F.array_join(first, ",").alias("sample"))
