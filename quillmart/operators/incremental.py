"""Incremental facts: affected keys, delete and insert, processed bounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def delete_insert(target: DataFrame, new: DataFrame, unit: list[str]) -> DataFrame:
    """Rows of the units in `new` are replaced by it; a unit that yields no new row keeps its old ones."""
    return target.join(new.select(*unit).distinct(), unit, "left_anti").unionByName(new)


def delete_insert_strict(target: DataFrame, new: DataFrame, affected: DataFrame, unit: list[str]) -> DataFrame:
    """As delete_insert, but units that are affected and yield nothing go."""
    return target.join(affected.select(*unit).distinct(), unit, "left_anti").unionByName(new)


def changed_keys(observations: DataFrame, key: str, at: str, batch: str, lower: str) -> DataFrame:
    """The key and its earliest changed time among observations of batches after `lower`."""
    return observations.filter(F.col(batch) > lower).groupBy(key).agg(F.min(at).alias("changed_from"))


def affected_by_history(events: DataFrame, changed: DataFrame, key: str, at: str, unit: str) -> DataFrame:
    """Events at or after their key's earliest change: a superset of those whose version moved."""
    return events.join(changed, key).filter(F.col(at) >= F.col("changed_from")).select(unit)


def affected_by_link(links: DataFrame, changed: DataFrame, key: str, unit: str) -> DataFrame:
    """Units linked to a changed key, whatever their time."""
    return links.join(changed.select(key).distinct(), key, "left_semi").select(unit)


def affected_units(causes: dict[str, DataFrame], unit: str) -> DataFrame:
    """Each affected unit once."""
    return reduce(DataFrame.unionByName, [df.select(unit) for df in causes.values()]).distinct()


def record_affected(causes: dict[str, DataFrame], unit: str, invocation: str) -> DataFrame:
    """The audit rows of a run: invocation_id, affected_domain, entity_key."""
    rows = [affected_units({k: df}, unit).select(F.lit(invocation).alias("invocation_id"), F.lit(k).alias("affected_domain"), F.col(unit).cast("string").alias("entity_key")) for k, df in causes.items()]
    return reduce(DataFrame.unionByName, rows)


def processed_bound(models: list[DataFrame], batch: str = "_batch_id") -> DataFrame:
    """The greatest batch of the models, '' before the first."""
    return reduce(DataFrame.unionByName, [m.select(batch) for m in models]).agg(F.coalesce(F.max(batch), F.lit("")).alias("processed_batch_id"))


def advance_bound(bound: DataFrame, failed_checks: int, facts_built: int, facts_expected: int, as_of: str | None) -> DataFrame:
    """The bound if the run may advance it: all facts built, no failure, not a replay; else no row."""
    return bound.filter(F.lit(failed_checks == 0 and facts_built == facts_expected and as_of is None))


def rebuild_affected(source: DataFrame, affected: DataFrame, unit: list[str]) -> DataFrame:
    """The source rows of affected units, to be computed anew."""
    return source.join(affected.select(*unit).distinct(), unit, "left_semi")


def first_version_units(old: DataFrame, new: DataFrame, key: str, version_key: str) -> DataFrame:
    """Keys whose first version has another surrogate key than before: all of their events are affected."""
    a = old.filter("version = 1").select(key, F.col(version_key).alias("_old"))
    b = new.filter("version = 1").select(key, F.col(version_key).alias("_new"))
    return a.join(b, key).filter(F.col("_old") != F.col("_new")).select(key)

