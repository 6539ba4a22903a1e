"""Exact dedup by a tree-merge of sorted digest runs.

Rows are dealt over fan_in ** rounds lanes. In round r a digest goes from its lane to
the lane whose r-th digit is the digest's r-th digit, so each lane takes the runs of
fan_in partners (binomial rounds for fan_in 2). Partitions hold whole lanes: rows are
dealt by lane alone, each partition sorts what it took by lane and digest, and merges
neighbours, keeping of each digest the smallest identifier and the row count. Digests
count as equal only if length and a second hash agree, at every level. After the last
round a digest has one row. A group of copies, however large, starts out spread over
all lanes and sends at most one row from each after the first round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACE_RUN, keyed, materialize, settled, without

FAN_IN = 8


def normalized(text: Column) -> Column:
    """Null as empty; each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def digest_rows(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, text_sha256 and the figures that verify it: the length and a second, unrelated hash."""
    text = keyed(docs, F.col("doc_id").alias("doc_id"), normalized(F.col("text")).alias("_q_text"))
    return text.select(ROW, "doc_id", F.sha2("_q_text", 256).alias("text_sha256"), F.octet_length("_q_text").alias("_q_len"), F.xxhash64("_q_text").alias("_q_xx"))


def rounds_for(lanes: int, fan_in: int = FAN_IN) -> int:
    """As many rounds as give at least so many lanes, two at least."""
    rounds = 2
    while fan_in**rounds < lanes:
        rounds += 1
    return rounds


def merge_runs(digests: DataFrame, fan_in: int = FAN_IN, rounds: int | None = None) -> DataFrame:
    """One row per text: its digest, the figures that verify it, group_size and `keep`, the smallest (doc_id, row)."""
    partitions = int(digests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rounds = rounds or rounds_for(4 * partitions, fan_in)
    lanes = fan_in**rounds
    key = ["text_sha256", "_q_len", "_q_xx"]
    # Nulls sort after all ids: a row without an id stays only if no copy has one.
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col(ROW).alias("row"))
    runs = digests.select(*key, first.alias("keep"), F.lit(1).cast("long").alias("group_size"), F.pmod(F.col(ROW) + F.shiftright(ROW, 33), F.lit(lanes)).alias("lane"))
    home = F.pmod("_q_xx", F.lit(lanes))
    for r in range(rounds):
        step = fan_in**r
        digit = lambda x: F.pmod(F.floor(x / F.lit(step)).cast("long"), F.lit(fan_in))  # noqa: B023, E731
        moved = runs.withColumn("lane", F.col("lane") + (digit(home) - digit(F.col("lane"))) * step)
        # Dealt by lane alone, so the merge needs no exchange of its own: it sorts within the partition.
        runs = moved.repartition(partitions, "lane").groupBy("lane", *key).agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
    return runs.select(*key, "keep", "group_size")


def exact_groups(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """ROW, doc_id, keep_id, group_size, kept, text_sha256 for each row of docs (doc_id, text).

    Texts are equal when identical after normalized(); digests count as equal only
    if length and second hash agree as well. Null texts equal empty ones. Of rows
    that also share the doc_id exactly one is kept; a null doc_id loses to any id.
    An empty table gives no rows.
    """
    digests = materialize(digest_rows(docs))
    # A table of its own, so that both sides of the join are plain exchanges, whose hot keys the adaptive join splits.
    groups = materialize(merge_runs(digests, fan_in).filter("group_size > 1"))
    mine = digests.join(groups, ["text_sha256", "_q_len", "_q_xx"], "left")
    alone = F.col("group_size").isNull()
    return mine.select(
        ROW,
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col(ROW))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """docs, whatever its columns, without all but the kept row of equal texts."""
    docs = settled(docs)
    return without(docs, exact_groups(docs).filter(~F.col("kept")))
