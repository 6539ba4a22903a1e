"""Bounded reads of a source: cursors, slices, pages, CSV mirrors and checksums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .contracts import TableContract


def read_raw_csv(spark: SparkSession, path: str, header: list[str], columns: list[str]) -> DataFrame:
    """CSV as strings, empty as null; fails unless the header is exactly the one expected."""
    found = spark.read.option("header", True).csv(path).columns
    if found != header:
        raise ValueError(f"header {found} instead of {header}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.schema(schema).option("header", True).option("nullValue", "").csv(path).select(*columns)


def read_typed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


#: The column that keeps a line that is no record of the schema.
CORRUPT = "_corrupt_record"


def read_permissive_csv(spark: SparkSession, path: str, schema: T.StructType, header: bool = True) -> DataFrame:
    """Typed CSV and, for a line that is no record of the schema, its text in CORRUPT: too few or too many fields, a word for a number, an open quote."""
    full = T.StructType([*(T.StructField(f.name, f.dataType) for f in schema), T.StructField(CORRUPT, T.StringType())])
    read = spark.read.schema(full).option("header", header).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).option("enforceSchema", True)
    return read.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def corrupt_kind(line: Column, n_fields: int) -> Column:
    """SHORT, LONG, QUOTE (one stays open) or TYPE of a corrupt line, by its separators outside quotes."""
    quotes = F.char_length(line) - F.char_length(F.replace(line, F.lit('"'), F.lit("")))
    bare = F.regexp_replace(line, '"[^"]*"', "")
    fields = F.char_length(bare) - F.char_length(F.replace(bare, F.lit(","), F.lit(""))) + 1
    return F.when(quotes % 2 == 1, "QUOTE").when(fields < n_fields, "SHORT").when(fields > n_fields, "LONG").otherwise("TYPE")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """path, length and modified of the files under a folder, listed by Spark's own file index; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return found.select("path", "length", F.col("modificationTime").alias("modified"))


def export_csv_mirror(df: DataFrame, path: str, order: list[str]) -> None:
    """Range-partitioned, so that files follow the order without one task sorting all."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.option("header", True).option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss.SSSSSS").csv(path)


def dataset_checksum(spark: SparkSession, path: str, name: Column | None = None) -> DataFrame:
    """name, sha256 for each file, read by Spark; the name is a function of `path`, the file's own if not given."""
    own = F.element_at(F.split("path", "/"), -1)
    return spark.read.format("binaryFile").load(path).select((own if name is None else name).alias("name"), F.sha2("content", 256).alias("sha256"))


def combined_checksum(files: DataFrame) -> DataFrame:
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda x: F.concat_ws(":", x["name"], x["sha256"])), "\n")
    return files.agg(F.sha2(lines, 256).alias("dataset_sha256"), F.count("*").alias("n_files"))


def upper_bound(df: DataFrame, contract: TableContract, lower: Column | None = None) -> DataFrame:
    """The greatest cursor above `lower`, null if there is none."""
    cur = contract.cursor_of()
    return (df if lower is None else df.filter(cur > lower)).agg(F.max(cur).alias("cursor"))


def incremental(df: DataFrame, contract: TableContract, lower: tuple | None, upper: tuple | None) -> DataFrame:
    """Rows with lower < (timestamp, keys) <= upper. The plain bound on the timestamp reaches the file scan."""
    cur, ts = contract.cursor_of(), F.col(contract.cursor)
    if lower is not None:
        df = df.filter((ts >= F.lit(lower[0])) & (cur > bound(df, contract, lower)))
    if upper is not None:
        df = df.filter((ts <= F.lit(upper[0])) & (cur <= bound(df, contract, upper)))
    return df


def bound(df: DataFrame, contract: TableContract, values: tuple) -> Column:
    kinds = [df.schema[c].dataType for c in (contract.cursor, *contract.keys)]
    return F.struct(*[F.lit(v).cast(k).alias(c) for v, k, c in zip(values, kinds, (contract.cursor, *contract.keys))])


def keyset_page(df: DataFrame, contract: TableContract, after: tuple | None, size: int) -> DataFrame:
    """The next `size` rows after a cursor, in cursor order."""
    return incremental(df, contract, after, None).orderBy(contract.cursor, *contract.keys).limit(size)


def cursor_before(df: DataFrame, contract: TableContract, boundary: str) -> DataFrame:
    return df.filter(F.col(contract.cursor) < F.lit(boundary).cast(df.schema[contract.cursor].dataType)).agg(F.max(contract.cursor_of()).alias("cursor"))


def change_stats(df: DataFrame, contract: TableContract, boundary: str) -> DataFrame:
    """n_before, n_after, n_rows and the share of rows after the boundary."""
    b = F.lit(boundary).cast(df.schema[contract.cursor].dataType)
    after, total = F.count_if(F.col(contract.cursor) > b), F.count("*")
    return df.agg(F.count_if(F.col(contract.cursor) <= b).alias("n_before"), after.alias("n_after"), total.alias("n_rows"), (after / F.nullif(total, F.lit(0))).alias("change_rate"))


def slices(df: DataFrame, key: str, n: int) -> list[str]:
    """Conditions that deal the rows out by the key in n slices of equal width, from the least to the greatest key; null keys go to the first. Usable as the predicates of a JDBC read."""
    lo, hi = df.agg(F.min(F.least(F.lit(0), F.col(key))), F.max(key)).first()
    if hi is None:
        return ["1 = 1"]
    ends = [lo + (hi + 1 - lo) * i // n + ((hi + 1 - lo) * i % n > 0) for i in range(1, n)]
    return [f"{key} < {ends[0]} OR {key} IS NULL", *[f"{key} >= {a} AND {key} < {b}" for a, b in zip(ends, ends[1:])], f"{key} >= {ends[-1]}"] if ends else ["1 = 1"]


def read_snapshot(spark: SparkSession, url: str, table: str, predicates: list[str], properties: dict[str, str]) -> DataFrame:
    """A table over JDBC, a task for each predicate (see slices)."""
    return spark.read.jdbc(url, table, predicates=predicates, properties=properties)
