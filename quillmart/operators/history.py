"""Current rows, observations, slowly changing dimensions and temporal joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import BEGINNING, date_key, surrogate_key
from ..sources.scratch import stored


def keep_first(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in an order that spells out its null placement."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def newest(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def current_records(df: DataFrame, keys: list[str], *recency: str) -> DataFrame:
    """One row for each key: the last by update, then ingestion, then batch."""
    return keep_first(df, keys, newest(*(recency or ("updated_at", "_ingested_at", "_batch_id"))))


def dedupe_observations(df: DataFrame, key: str, updated_at: str = "updated_at", attributes: str = "attribute_hash", recency: tuple[str, ...] = ("_ingested_at", "_batch_id")) -> DataFrame:
    """One row for each (key, time, attributes): re-reads of one state are one observation."""
    return keep_first(df, [key, updated_at, attributes], newest(*recency))


def scd2_fold(obs: DataFrame, key: str, attributes: str, observed_at: str, started_at: str | None = None, tiebreak: tuple[str, ...] = ()) -> DataFrame:
    """Versions from observations: version, valid_from, effective_from, valid_to, is_current.

    An observation that repeats the attributes of the one before is dropped. The
    first version is effective from the beginning of time and, if started_at is
    given, valid from there; the last has no valid_to. One shuffle by key.
    """
    seen = W.partitionBy(key).orderBy(F.col(observed_at).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tiebreak])
    before = F.lag(attributes).over(seen)
    first = F.row_number().over(seen) == 1
    changed = obs.withColumns({"_first": first, "_before": before}).filter(F.col("_first") | ~F.col(attributes).eqNullSafe(F.col("_before")))
    ranked = changed.withColumn("version", F.row_number().over(seen))
    kind = obs.schema[observed_at].dataType
    start = F.coalesce(F.col(started_at), F.col(observed_at)) if started_at else F.col(observed_at)
    own = ranked.withColumn("valid_from", F.when(F.col("version") == 1, start).otherwise(F.col(observed_at)))
    after = W.partitionBy(key).orderBy("version")
    return own.withColumns(
        {
            "effective_from": F.when(F.col("version") == 1, F.lit(BEGINNING).cast(kind)).otherwise(F.col("valid_from")),
            "valid_to": F.lead("valid_from").over(after),
            "is_current": F.lead("version").over(after).isNull(),
        }
    ).drop("_first", "_before")


def with_surrogate_key(versions: DataFrame, key: str, attributes: str, name: str) -> DataFrame:
    return versions.withColumn(name, surrogate_key(F.col(key), F.col("valid_from"), F.col(attributes)))


def as_of_join(events: DataFrame, versions: DataFrame, key: str, at: str, how: str = "left") -> DataFrame:
    """Each event with the version of its key in force at its time; versions do not overlap."""
    v = versions.withColumnRenamed(key, "_key")
    inside = (F.col("_key") == F.col(key)) & (F.col(at) >= F.col("effective_from")) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return events.join(v, inside, how).drop("_key")


#: Events of one key that a slice of an as-of join holds at most, about.
SLICE_ROWS = 1_000_000


def as_of_join_by_window(events: DataFrame, versions: DataFrame, key: str, at: str, columns: list[str], slice_rows: int = SLICE_ROWS) -> DataFrame:
    """as_of_join(..., 'left') for long histories and hot keys: each key's events and versions are sorted together and read once.

    A key with over slice_rows events is cut in slices of time with about so many each;
    a version goes to every slice in which it is in force, so the one in force at a cut is
    carried over it, and the slices are worked on apart. Events with a null key or time,
    however many, stay out of the sort and have no version.
    """
    payload = F.struct(*columns)
    cuts = hot_key_cuts(events, key, at, slice_rows)
    known = F.col(key).isNotNull() & F.col(at).isNotNull()
    e = events.filter(known).select(F.col(key).alias("_key"), F.col(at).alias("_at"), F.lit(1).alias("_is_event"), F.struct(*events.columns).alias("_e"))
    v = versions.select(F.col(key).alias("_key"), F.col("effective_from").alias("_at"), F.lit(0).alias("_is_event"), F.col("valid_to").alias("_to"), payload.alias("_v")).filter(F.col("_key").isNotNull())
    if cuts is None:
        by = ["_key"]
    else:
        by, levels = ["_key", "_slice"], cut_levels(cuts)
        e = e.withColumn("_x", micros(F.col("_at"))).transform(with_cuts_before, levels, "_x", "_slice", True).drop("_x")
        # A version without an end reaches the last slice.
        ends = {"_x": micros(F.col("_at")), "_y": F.when(F.col("_to").isNull(), (1 << 63) - 1).otherwise(micros(F.col("_to")))}
        v = v.withColumns(ends).transform(with_cuts_before, levels, "_x", "_first", True).transform(with_cuts_before, levels, "_y", "_upto", False)
        v = v.withColumn("_slice", F.explode(F.sequence("_first", F.greatest("_first", "_upto")))).drop("_x", "_y", "_first", "_upto")
    both = e.unionByName(v, allowMissingColumns=True)
    along = W.partitionBy(*by).orderBy("_at", "_is_event", F.col("_to").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
    last = F.last(F.when(F.col("_is_event") == 0, F.struct("_to", "_v")), ignorenulls=True).over(along)
    # A history may have gaps: the last version to begin counts only while it is in force.
    found = both.withColumn("_last", last).filter("_is_event = 1").withColumn("_in", F.col("_last._to").isNull() | (F.col("_at") < F.col("_last._to")))
    out = found.select("_e.*", *[F.when(F.col("_in"), F.col(f"_last._v.{c}")).alias(c) for c in columns])
    return out.unionByName(events.filter(~known).select(*events.columns), allowMissingColumns=True)


def micros(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp"))


def hot_key_cuts(events: DataFrame, key: str, at: str, slice_rows: int) -> DataFrame | None:
    """_key and _cuts (times in microseconds, ascending) for keys with over slice_rows events; None if there are none.

    Keys are counted first, and only hot ones' times are looked at: by mergeable
    sketches, so no task holds a key's events. Keys of like counts get as many cuts as
    the largest of them needs, so all cuts together are at most some four for each
    slice_rows events.
    """
    counts = events.filter(F.col(at).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n")).filter((F.col("_n") > slice_rows) & F.col("_key").isNotNull())
    alike: dict[int, list] = {}
    for r in counts.collect():
        alike.setdefault((-(-r["_n"] // slice_rows) - 1).bit_length(), []).append(r["_key"])
    if not alike:
        return None
    spark, kind = events.sparkSession, events.schema[key].dataType
    rows = []
    for power, keys in alike.items():
        n = 1 << power
        wanted = F.broadcast(spark.createDataFrame([(k,) for k in keys], T.StructType([T.StructField("_key", kind)])))
        mine = events.select(F.col(key).alias("_key"), micros(F.col(at)).alias("_t")).join(wanted, "_key", "left_semi")
        found = mine.groupBy("_key").agg(F.percentile_approx("_t", [k / n for k in range(1, n)], max(10_000, 20 * n)).alias("_cuts"))
        rows += [(r["_key"], sorted(set(r["_cuts"]))) for r in found.collect()]
    return F.broadcast(spark.createDataFrame(rows, T.StructType([T.StructField("_key", kind), T.StructField("_cuts", T.ArrayType(T.LongType()))])))


#: Cuts that a row is held against at once.
CUT_FANOUT = 64


def cut_levels(cuts: DataFrame) -> list[DataFrame]:
    """The cuts of each key as a search tree, a table for each level from the root down: _key, _node and _part, CUT_FANOUT ascending cuts at most.

    The number of levels is the logarithm of the most cuts of a key.
    """
    at = lambda c: F.explode(F.sequence(F.lit(0), F.floor((F.size(c) - 1) / CUT_FANOUT).cast("int"))).alias("_node")
    most = cuts.agg(F.max(F.size("_cuts"))).first()[0] or 0
    left, out = cuts.filter(F.size("_cuts") > 0), []
    while True:
        out.append(F.broadcast(left.select("_key", at(F.col("_cuts")), "_cuts").select("_key", "_node", F.slice("_cuts", F.col("_node") * CUT_FANOUT + 1, CUT_FANOUT).alias("_part"))))
        if most <= CUT_FANOUT:
            return out[::-1]
        # The level above tells the parts by the cuts that they begin with, but for the first part's.
        most = (most - 1) // CUT_FANOUT
        left = left.filter(F.size("_cuts") > CUT_FANOUT).withColumn("_cuts", F.filter("_cuts", lambda _, i: (i > 0) & (i % CUT_FANOUT == 0)))


def with_cuts_before(df: DataFrame, levels: list[DataFrame], x: str, name: str, upto: bool) -> DataFrame:
    """Adds how many of the key's cuts are below the number x, or equal to it if upto; 0 for a key without cuts.

    A row is held against CUT_FANOUT cuts a level and carries no more of them, however many its key has.
    """
    df = df.withColumn(name, F.lit(0))
    for level in levels:
        df = df.join(level.withColumnRenamed("_node", name), ["_key", name], "left")
        below = F.filter("_part", lambda c: (c <= F.col(x)) if upto else (c < F.col(x)))
        df = df.withColumn(name, F.col(name) * CUT_FANOUT + F.greatest(F.size(below), F.lit(0))).drop("_part")
    return df


def date_dimension(days: DataFrame, at: str) -> DataFrame:
    """A row for each day from the first to the last of `at`; Sunday is day 0 of the week."""
    ends = days.agg(F.min(F.to_date(at)).alias("lo"), F.max(F.to_date(at)).alias("hi")).filter("lo IS NOT NULL")
    day = ends.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 day"))).alias("date_day"))
    return day.select(
        date_key(F.col("date_day")).alias("date_key"), "date_day", F.year("date_day").cast("long").alias("year"), F.quarter("date_day").cast("long").alias("quarter"), F.month("date_day").cast("long").alias("month"),
        F.dayofmonth("date_day").cast("long").alias("day"), (F.dayofweek("date_day") - 1).cast("long").alias("day_of_week"),
    )


def numbered(df: DataFrame, order: list[str], name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in an order, by range partitions and their offsets.

    The ranged rows are stored, as a range partition that is made again may be cut elsewhere.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(df.repartitionByRange(tasks, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    sizes = ranged.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    # A row for each range partition.
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    return ranged.withColumn("_part", part).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))).drop("_part", "_before", "_at")
