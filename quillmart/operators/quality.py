"""Row validation with all failing codes, table checks, and their results."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalars import canonical_json, is_distinct, uuid5
from ..sources.contracts import TableContract

#: Namespace of quarantine record ids.
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
REJECT_LIMIT = 0.05
# The codes of row errors, in rule order.
KEY_NULL, BATCH_DUPLICATE, REQUIRED_NULL, TYPE_MISMATCH = "KEY_NULL", "BATCH_DUPLICATE", "REQUIRED_NULL", "TYPE_MISMATCH"
STATUS_DOMAIN_INVALID, NUMERIC_RANGE_INVALID, BROKEN_REFERENCE = "STATUS_DOMAIN_INVALID", "NUMERIC_RANGE_INVALID", "BROKEN_REFERENCE"


# --- rows -----------------------------------------------------------------
def validate(df: DataFrame, contract: TableContract, parents: dict[str, DataFrame] | None = None) -> DataFrame:
    """Adds _errors, every failing code of the row in rule order.

    df has the contract's columns, typed or as strings (then a failing cast is
    TYPE_MISMATCH and the number is not checked further). The first row of a key
    in cursor order claims it even if it is invalid itself. Parents: for each
    referencing column a table with the parent's key under the same name.
    """
    contract.check_columns(df)
    typed = {f.name: F.col(f.name).try_cast(f.dataType) for f in contract.schema}
    order = [typed[contract.cursor].asc_nulls_last(), *[typed[k].asc_nulls_last() for k in contract.keys], *[F.col(c).cast("string").asc_nulls_last() for c in df.columns if c not in contract.keys]]
    # Rows without a key claim nothing; spread, or they would all meet in one task.
    key_null = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in contract.keys])
    df = df.withColumn("_spread", F.when(key_null, F.monotonically_increasing_id()))
    df = df.withColumn("_claim", F.row_number().over(W.partitionBy(*contract.keys, "_spread").orderBy(*order))).drop("_spread")
    missing: list[Column] = []
    for i, (column, parent) in enumerate((parents or {}).items()):
        # Keys of one type are compared as they are, others by their text.
        alike = df.schema[column].dataType == parent.schema[column].dataType
        key = F.col(column) if alike else F.col(column).cast("string")
        known = parent.select(key.alias(f"_p{i}")).distinct()
        df = df.join(known, key == F.col(f"_p{i}"), "left")
        missing.append(F.when(F.col(column).isNotNull() & F.col(f"_p{i}").isNull(), BROKEN_REFERENCE))
    codes = [F.when(key_null, KEY_NULL), F.when(~key_null & (F.col("_claim") > 1), BATCH_DUPLICATE)]
    for f in contract.schema:
        if not f.nullable:
            codes.append(F.when(F.col(f.name).isNull(), REQUIRED_NULL))
        codes.append(F.when(F.col(f.name).isNotNull() & typed[f.name].isNull(), TYPE_MISMATCH))
    codes += [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*domain), STATUS_DOMAIN_INVALID) for c, domain in contract.domains.items()]
    codes += [F.when(typed[c] < least, NUMERIC_RANGE_INVALID) for c, least in contract.minimums.items()]
    codes += missing
    return df.withColumn("_errors", F.filter(F.array(*codes), lambda x: x.isNotNull())).drop("_claim", *[f"_p{i}" for i in range(len(parents or {}))])


def cursor_violations(df: DataFrame, contract: TableContract, lower: Column, upper: Column) -> DataFrame:
    """n_outside: rows whose cursor is not in (lower, upper]; any stops the batch."""
    cur = contract.cursor_of()
    return df.agg(F.count_if(~((cur > lower) & (cur <= upper))).alias("n_outside"))


def quarantine(rejected: DataFrame, contract: TableContract, batch_id: str, run_id: str, detected_at: Column) -> DataFrame:
    """Rows with _errors as quarantine records; the id is derived from table, batch and row, so a rerun repeats it."""
    payload = canonical_json(rejected.select(*contract.schema.names))
    return rejected.select(
        uuid5(NAMESPACE, F.concat(F.lit(f"{contract.name}_{batch_id}:"), F.sha2(payload, 256))).alias("_record_id"), F.lit(contract.name).alias("_source_table"), F.lit(batch_id).alias("_batch_id"),
        F.lit(run_id).alias("_run_id"), detected_at.alias("_detected_at"), F.col("_errors").alias("_error_codes"), payload.alias("_raw_payload"),
    )


def error_counts(validated: DataFrame) -> DataFrame:
    return validated.select(F.explode("_errors").alias("code")).groupBy("code").agg(F.count("*").alias("n_rows"))


def reject_gate(validated: DataFrame, limit: float = REJECT_LIMIT) -> DataFrame:
    """n_rows, n_rejected, reject_rate, passes; a rate of exactly the limit passes, and so does an empty batch."""
    n, bad = F.count("*"), F.count_if(F.size("_errors") > 0)
    return validated.agg(n.alias("n_rows"), bad.alias("n_rejected"), F.coalesce(bad / F.nullif(n, F.lit(0)), F.lit(0.0)).alias("reject_rate"), (bad <= n * F.lit(limit)).alias("passes"))


# --- tables: each check gives the rows that violate it ---------------------
def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNull())


def unique(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter("n_rows > 1")


def accepted_values(df: DataFrame, column: str, *values: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*values)).groupBy(column).agg(F.count("*").alias("n_rows"))


def relationships(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Child values without a parent; null parents match nothing and hide nothing."""
    p = parent.select(F.col(parent_column).alias("_p")).filter("_p IS NOT NULL").distinct()
    return child.filter(F.col(column).isNotNull()).join(p, F.col(column) == F.col("_p"), "left_anti")


def non_negative(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column) < 0)


def exactly_one_current(versions: DataFrame, key: str) -> DataFrame:
    return versions.groupBy(key).agg(F.count_if("is_current").alias("n_current")).filter("n_current <> 1")


def first_effective_from(versions: DataFrame, key: str, beginning: str) -> DataFrame:
    first = versions.withColumn("_rn", F.row_number().over(W.partitionBy(key).orderBy("effective_from"))).filter("_rn = 1")
    return first.filter(F.col("effective_from") != F.lit(beginning).cast(versions.schema["effective_from"].dataType)).drop("_rn")


def never_decreases(df: DataFrame, key: str, order: str, ranks: dict[str, int], column: str) -> DataFrame:
    rank = F.lit(None).cast("int")
    for k, v in ranks.items():
        rank = F.when(F.col(column) == k, v).otherwise(rank)
    ranked = df.withColumn("_rank", rank)
    return ranked.withColumn("_before", F.lag("_rank").over(W.partitionBy(key).orderBy(order))).filter("_rank < _before").drop("_rank", "_before")


def no_overlap(versions: DataFrame, key: str) -> DataFrame:
    after = F.lead("effective_from").over(W.partitionBy(key).orderBy("effective_from", "version"))
    return versions.withColumn("_next", after).filter("_next IS NOT NULL AND (valid_to IS NULL OR valid_to > _next)").drop("_next")


def transitions(df: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """from_state, to_state, n_rows of steps that the state machine (from_state, to_state) does not allow."""
    steps = df.withColumn("from_state", F.lag(state).over(W.partitionBy(key).orderBy(*order))).filter(F.col("from_state").isNotNull() & (F.col("from_state") != F.col(state)))
    return steps.groupBy("from_state", F.col(state).alias("to_state")).agg(F.count("*").alias("n_rows")).join(allowed, ["from_state", "to_state"], "left_anti")


def inherited(child: DataFrame, parent: DataFrame, key: str, column: str) -> DataFrame:
    """Child rows whose column differs from their parent's."""
    p = parent.select(F.col(key).alias("_k"), F.col(column).alias("_v"))
    return child.join(p, F.col(key) == F.col("_k")).filter(is_distinct(F.col(column), F.col("_v"))).drop("_k", "_v")


def totals_match(parent: DataFrame, child: DataFrame, key: str, total: str, part: str, tolerance: str = "0.01") -> DataFrame:
    sums = child.groupBy(F.col(key).alias("_k")).agg(F.sum(part).alias("_sum"))
    return parent.join(sums, F.col(key) == F.col("_k"), "left").filter(F.abs(F.col(total) - F.coalesce("_sum", F.lit(0))) > F.expr(tolerance)).drop("_k")


def conflicting_observations(obs: DataFrame, key: str, at: str, attributes: str) -> DataFrame:
    """Keys with different attributes at one instant."""
    return obs.groupBy(key, at).agg(F.count_distinct(attributes).alias("n_hashes")).filter("n_hashes > 1")


def reconcile(left: DataFrame, right: DataFrame, keys: list[str], measures: list[str]) -> DataFrame:
    """Groups of two summaries that differ in a measure or exist on one side only."""
    b = right.select(*keys, *[F.col(m).alias(f"_{m}") for m in measures])
    differs = reduce(lambda x, y: x | y, [is_distinct(F.col(m), F.col(f"_{m}")) for m in measures])
    return left.select(*keys, *measures).join(b, keys, "full_outer").filter(differs)


def mapping_differences(left: DataFrame, right: DataFrame, key: str, pairs: dict[str, str]) -> DataFrame:
    """column, n_rows of mapped columns whose values differ from their source's."""
    r = right.select(F.col(key).alias("_k"), *[F.col(s).alias(f"_{t}") for t, s in pairs.items()])
    j = left.join(r, F.col(key) == F.col("_k"), "left")
    counts = j.agg(*[F.count_if(is_distinct(F.col(t), F.col(f"_{t}"))).alias(t) for t in pairs])
    stacked = ", ".join(f"'{t}', `{t}`" for t in pairs)
    return counts.select(F.expr(f"stack({len(pairs)}, {stacked}) AS (column_name, n_rows)"))


@dataclass(frozen=True)
class Check:
    name: str
    domain: str
    violations: Callable[[], DataFrame]
    severity: str = "error"


def run_checks(checks: list[Check]) -> DataFrame:
    """check_name, domain, severity, n_violations, status (pass, warn, fail): a count for each check in one plan."""
    one = [c.violations().agg(F.count("*").alias("n_violations")).select(F.lit(c.name).alias("check_name"), F.lit(c.domain).alias("domain"), F.lit(c.severity).alias("severity"), "n_violations") for c in checks]
    status = F.when(F.col("n_violations") == 0, "pass").when(F.col("severity") == "warn", "warn").otherwise("fail")
    return reduce(DataFrame.unionByName, one).withColumn("status", status)


def summarize_checks(results: DataFrame) -> DataFrame:
    names = F.array_join(F.sort_array(F.collect_list(F.when(F.col("status") == "fail", F.col("check_name")))), ",")
    return results.agg(F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(F.col("status") == "fail").alias("failed"), F.count_if(F.col("status") == "warn").alias("warned"), names.alias("failed_names"))


def unparsable(raw: DataFrame, types: dict[str, str]) -> DataFrame:
    """column_name, n_bad: values that are there but do not cast; every column is named."""
    bad = [F.count_if(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull()).alias(c) for c, t in types.items()]
    stacked = ", ".join(f"'{c}', `{c}`" for c in types)
    return raw.agg(*bad).select(F.expr(f"stack({len(types)}, {stacked}) AS (column_name, n_bad)"))


def strict(text: Column, kind: str) -> Column:
    """A text as the kind that a seed column has, null if it is not that: `integer` takes whole numbers only, also ones written 3.0 or 3e0; `money` is rounded half to even at two decimals; `timestamp` is in UTC unless it says an offset."""
    if kind == "integer":
        number = text.try_cast("decimal(38,10)")
        return F.when(number == F.floor(number), number.try_cast("bigint"))
    if kind == "money":
        return F.bround(text.try_cast("decimal(38,10)"), 2).try_cast("decimal(14,2)")
    if kind == "timestamp":
        return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))
    raise ValueError(f"no such kind of column: {kind}")


def strict_errors(raw: DataFrame, kinds: dict[str, str], required: tuple[str, ...] = ()) -> Column:
    """The names of the columns that do not read as their kind, and of required ones that are empty, in order."""
    bad = [F.when(F.col(c).isNotNull() & strict(F.col(c), k).isNull() | (F.col(c).isNull() if c in required else F.lit(False)), c) for c, k in kinds.items()]
    return F.filter(F.array(*bad), lambda x: x.isNotNull())


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Adds _violations: the names of the rules (true where broken) that a row breaks, in order."""
    return df.withColumn("_violations", F.filter(F.array(*[F.when(c, k) for k, c in rules.items()]), lambda x: x.isNotNull()))


def set_exactly_when(df: DataFrame, column: str, condition: Column) -> DataFrame:
    """Rows where the column is set without the condition, or missing with it."""
    return df.filter(F.col(column).isNotNull() != condition)


def contract_differences(df: DataFrame, expected: dict[str, str]) -> list[str]:
    """Names and types of an output that differ from its contract."""
    found = dict(df.dtypes)
    return [f"{c}: {found.get(c, 'missing')} instead of {t}" for c, t in expected.items() if found.get(c) != t] + [f"{c}: not in the contract" for c in found if c not in expected]
