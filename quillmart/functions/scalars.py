"""Column builders that the marts share; all of them are built-in expressions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ends of an open validity: Spark timestamps have no infinity. Dates that Parquet and Python hold without rebasing.
BEGINNING = "1600-01-01 00:00:00"
FOREVER = "9999-12-31 00:00:00"

# Source statuses and the names that marts give them.
ORDER_STATUS = {
    "created": "CREATED", "approved": "APPROVED", "processing": "PROCESSING", "invoiced": "INVOICED",
    "shipped": "SHIPPED", "delivered": "DELIVERED", "canceled": "CANCELED", "unavailable": "UNAVAILABLE",
}
PAYMENT_STATUS = {"pending": "PENDING", "completed": "COMPLETED", "failed": "FAILED", "refunded": "REFUNDED"}


def standardize(col: Column, names: dict[str, str]) -> Column:
    """The standard name of a status; null for an unknown one."""
    out = F.lit(None).cast("string")
    for k, v in names.items():
        out = F.when(col == k, v).otherwise(out)
    return out


def standardize_order_status(col: Column) -> Column:
    return standardize(F.lower(col), ORDER_STATUS)


def standardize_payment_status(col: Column) -> Column:
    return standardize(F.lower(col), PAYMENT_STATUS)


def money(col: Column) -> Column:
    """A double amount as decimal(14,2), by whole cents."""
    return (F.round(col * 100).cast("decimal(16,0)") * F.lit(Decimal("0.01"))).cast("decimal(14,2)")


def ratio(top: Column, bottom: Column) -> Column:
    """Double division; null where the divisor is zero or null."""
    return top.cast("double") / F.nullif(bottom.cast("double"), F.lit(0.0))


def date_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyyMMdd").cast("int")


def is_distinct(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


def tagged(tag: str, col: Column) -> Column:
    """tag:length:value; length -1 for null, so that no two value lists read alike."""
    s = col.cast("string")
    return F.concat(F.lit(f"{tag}:"), F.coalesce(F.char_length(s), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce(s, F.lit("")))


def attribute_hash(fields: dict[str, Column]) -> Column:
    return F.md5(F.concat_ws("|", *[tagged(k, c) for k, c in fields.items()]))


def utc_text(ts: Column) -> Column:
    """A timestamp in text to the microsecond, with its offset."""
    return F.concat(F.date_format(ts, "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("+00"))


def surrogate_key(key: Column, valid_from: Column, attributes: Column) -> Column:
    return F.md5(F.concat_ws("|", key.cast("string"), utc_text(valid_from), attributes))


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name (RFC 9562) within a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("int").bitwiseAND(F.lit(63)).bitwiseOR(F.lit(128))))
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12)
    )


def canonical_json(df: DataFrame, leave_out: tuple[str, ...] = ()) -> Column:
    """A row as JSON: columns by name, nulls kept, timestamps to the microsecond in UTC, decimals in full."""
    cols = []
    for f in sorted((f for f in df.schema if f.name not in leave_out), key=lambda f: f.name):
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = utc_text(c)
        elif isinstance(f.dataType, (T.DecimalType, T.DoubleType, T.FloatType, T.DateType)):
            c = c.cast("string")
        cols.append(c.alias(f.name))
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def slot_start(ts: Column, minutes: int = 10) -> Column:
    """The start of the ts's slot as seconds since 1970."""
    seconds = F.unix_seconds(ts.cast("timestamp"))
    return seconds - F.pmod(seconds, F.lit(60 * minutes))


def starts_with_any(col: Column, prefixes: list[str]) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(col, F.lit(p))
    return out
