"""Facts and slowly changing dimensions kept in partitions and brought up to date in place.

A build of a run touches the partitions that hold what changed; the others are neither
read nor written, but for the key columns of facts whose earlier place is not known.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import is_distinct
from ..sources.parts import PartitionedTable
from .history import dedupe_observations, scd2_fold, with_surrogate_key


def values_of(*columns: DataFrame) -> list:
    """The distinct values of partition columns; their number is that of partitions."""
    return [r[0] if r[0] is not None else "none" for r in reduce(DataFrame.unionByName, columns).distinct().collect()]


def merge_facts(table: PartitionedTable, fresh: DataFrame, affected: DataFrame, unit: list[str], bound: str | None = None) -> list:
    """Replaces the rows of affected units by fresh ones and gives the partitions written.

    fresh: the affected units' rows as computed anew; a unit without rows goes, one whose
    partition changes leaves the old one. affected and fresh are read more than once and
    should be tables. Where units lie is found by their key columns alone. The bound is
    advanced in the same commit; it never moves back.
    """
    if bound is not None and bound < table.meta().get("bound", ""):
        raise ValueError(f"bound {bound} is before {table.meta()['bound']}")
    by, keys = table.by, affected.select(*unit).distinct()
    held = table.read().select(by, *unit).join(keys, unit, "left_semi").select(by)
    touched = values_of(held, fresh.select(by))
    old = table.read(touched)
    kept, removed = old.join(keys, unit, "left_anti"), old.join(keys, unit, "left_semi")
    table.replace(kept, fresh, removed, touched, {} if bound is None else {"bound": bound})
    return touched


class StoredDimension:
    """A slowly changing dimension and the observations it is folded from, both in buckets of the key.

    Rows of one key share a bucket in both. merge() takes observations in any order:
    keys whose observations all come after what was seen of them go on from their last
    version; keys with late ones are folded again from their stored observations, which
    splices intervals and may move the first version. A repeated observation changes nothing.
    """

    def __init__(self, spark: SparkSession, root: str, schema: T.StructType, key: str, attributes: str, observed_at: str, surrogate: str, buckets: int = 256, tiebreak: tuple[str, ...] = ()):
        self.spark, self.key, self.attributes, self.observed_at, self.surrogate, self.buckets, self.tiebreak = spark, key, attributes, observed_at, surrogate, buckets, tiebreak
        self.schema = schema
        bucketed = T.StructType([*schema, T.StructField("_bucket", T.IntegerType())])
        folded = self._fold(spark.createDataFrame([], schema))
        self._seen = PartitionedTable(spark, f"{root}/observations", "_bucket", bucketed)
        self._versions = PartitionedTable(spark, f"{root}/versions", "_bucket", T.StructType([*folded.schema, T.StructField("_last_seen", schema[observed_at].dataType), T.StructField("_bucket", T.IntegerType())]), folded.columns)

    def _fold(self, observations: DataFrame) -> DataFrame:
        versions = scd2_fold(observations, self.key, self.attributes, self.observed_at, tiebreak=self.tiebreak)
        return with_surrogate_key(versions, self.key, self.attributes, self.surrogate)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def versions(self) -> DataFrame:
        return self._versions.read().drop("_bucket", "_last_seen")

    def observations(self) -> DataFrame:
        return self._seen.read().drop("_bucket")

    def hash(self) -> str:
        return self._versions.hash()

    def files(self) -> dict[str, str]:
        """bucket -> folder of its versions."""
        return self._versions.state()["parts"]

    def merge(self, new: DataFrame) -> DataFrame:
        """Takes in new observations (a table, as it is read more than once) and gives, for each key whose versions changed, changed_from, the earliest time whose version is another than before, and first_moved, whether the first version has another surrogate key."""
        key, at = self.key, self.observed_at
        new = new.select(*self.schema.names).withColumn("_bucket", self._bucket())
        touched = values_of(new.select("_bucket"))
        seen, old = self._seen.read(touched), self._versions.read(touched)
        same = [key, at, self.attributes]
        fresh = dedupe_observations(new, key, at, self.attributes, self.tiebreak or (at,))
        fresh = self._stage(fresh.join(seen.select(*same), same, "left_anti"))
        last = old.filter("is_current").select(key, F.col("_last_seen").alias("_before"))
        first_new = fresh.groupBy(key).agg(F.min(at).alias("_from"), F.max(at).alias("_upto"))
        # A row for each key with something new: when that begins, how far it reaches, and whether it comes before something seen.
        plan = self._stage(first_new.join(last, key, "left").withColumn("_late", F.coalesce(F.col("_from") <= F.col("_before"), F.lit(False))))
        late = plan.filter("_late").select(key)
        again = self._fold(seen.join(late, key, "left_semi").unionByName(fresh.join(late, key, "left_semi")).drop("_bucket"))
        on = self._continued(old, fresh, plan.filter("NOT _late").select(key))
        upto = plan.select(key, F.greatest("_before", "_upto").alias("_last_seen"))
        changed = again.unionByName(on).join(upto, key).withColumn("_bucket", self._bucket())
        changed, keys = self._stage(changed), plan.select(key)
        kept, removed = old.join(keys, key, "left_anti"), old.join(keys, key, "left_semi")
        report = self._report(removed, changed)
        # Versions first: if the run dies in between, the same observations are late ones when they come again.
        self._versions.replace(kept, changed, removed, touched)
        self._seen.replace(seen, fresh, None, touched)
        return report

    def _continued(self, old: DataFrame, fresh: DataFrame, keys: DataFrame) -> DataFrame:
        """The versions of keys whose new observations all come last: the stored ones, and those that the new ones add to the current one."""
        key, at = self.key, self.observed_at
        mine = old.join(keys, key, "left_semi").drop("_last_seen", "_bucket")
        current = mine.filter("is_current")
        seed = current.select(*self.schema.names)
        folded = self._fold(seed.unionByName(fresh.drop("_bucket").join(keys, key, "left_semi")))
        so_far = current.select(key, F.col("version").alias("_n"), F.col("valid_from").alias("_valid"), F.col("effective_from").alias("_effective"), F.col(self.surrogate).alias("_key"))
        moved = folded.join(so_far, key, "left")
        # The seed stands for the current version, which keeps all but its end; keys without one are new.
        seeded = (F.col("version") == 1) & F.col("_n").isNotNull()
        moved = moved.withColumns(
            {
                "valid_from": F.when(seeded, F.col("_valid")).otherwise(F.col("valid_from")),
                "effective_from": F.when(seeded, F.col("_effective")).otherwise(F.col("effective_from")),
                self.surrogate: F.when(seeded, F.col("_key")).otherwise(F.col(self.surrogate)),
                "version": (F.col("version") + F.coalesce(F.col("_n") - 1, F.lit(0))).cast("int"),
            }
        )
        return mine.filter("NOT is_current").unionByName(moved.select(*mine.columns))

    def _report(self, before: DataFrame, after: DataFrame) -> DataFrame:
        key, own = self.key, [self.key, "effective_from", self.surrogate]
        side = lambda df, n: df.select(*own, F.lit(n).alias("_side"))
        # A version that only one side has changes what is in force from its start on.
        only = side(before, 0).unionByName(side(after, 1)).groupBy(*own).agg(F.count("*").alias("_n")).filter("_n = 1")
        first = lambda df, n: df.filter("version = 1").select(key, F.col(self.surrogate).alias(n))
        ends = first(before, "_old").join(first(after, "_new"), key)
        moved = only.groupBy(key).agg(F.min("effective_from").alias("changed_from")).join(ends, key, "left")
        return self._stage(moved.select(key, "changed_from", F.coalesce(is_distinct(F.col("_old"), F.col("_new")), F.lit(False)).alias("first_moved")))

    def _stage(self, df: DataFrame) -> DataFrame:
        """The rows written out, as they are read several times."""
        path = f"{self._versions.root}/staged/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)
