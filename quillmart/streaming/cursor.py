"""A stream source whose offset is a composite cursor: the last (timestamp, key) read.

The source is a growing table of Parquet files, the way an extract of a database table
is: rows have a timestamp and a key that together only grow. Each trigger takes the rows
after the offset in the query's checkpoint up to the greatest cursor there is, cut in
slices of time that tasks read apart; a restarted query goes on from its checkpoint.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..sources.contracts import TableContract

NAME = "quillmart_cursor"


def cursor_source() -> type[DataSource]:
    """The source as a class of its own, which travels to the workers by value."""

    class Slice(InputPartition):
        """Rows with lower < (timestamp, key) <= upper."""

        def __init__(self, lower: tuple[int, int], upper: tuple[int, int]):
            self.lower, self.upper = lower, upper

    class Reader(DataSourceStreamReader):
        def __init__(self, options: dict, columns: list[str]):
            self.path, self.at, self.key, self.columns = options["path"], options["cursor"], options["key"], columns
            self.slices = int(options.get("slices", 8))

        def _files(self):
            import pyarrow.dataset as ds
            from pyarrow.fs import FileSelector, FileSystem, LocalFileSystem

            fs, path = FileSystem.from_uri(self.path) if ":/" in self.path else (LocalFileSystem(), self.path)
            there = [f.path for f in fs.get_file_info(FileSelector(path, recursive=True, allow_not_found=True)) if f.path.endswith(".parquet")]
            return ds.dataset(sorted(there), format="parquet", filesystem=fs) if there else None

        def initialOffset(self) -> dict:
            return {"at": -(1 << 62), "key": -(1 << 63)}

        def latestOffset(self) -> dict:
            """The greatest cursor: its time out of the files' footers, its key out of the rows at that time."""
            import pyarrow as pa
            import pyarrow.compute as pc
            import pyarrow.dataset as ds

            files = self._files()
            ends = [s[self.at]["max"] for f in (files.get_fragments() if files else ()) for g in f.row_groups if (s := g.statistics) and self.at in s]
            if not ends:
                return self.initialOffset()
            last = pa.scalar(max(ends), files.schema.field(self.at).type)
            keys = files.to_table(columns=[self.key], filter=ds.field(self.at) == last).column(0)
            return {"at": pc.cast(pc.cast(last, pa.timestamp("us")), pa.int64()).as_py(), "key": pc.max(keys).as_py()}

        def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
            lower, upper = (start["at"], start["key"]), (end["at"], end["key"])
            if lower >= upper:
                return []
            files = self._files()
            first = lower[0]
            if first < -(1 << 61):  # nothing read so far: the least time in the footers
                import pyarrow as pa
                import pyarrow.compute as pc

                least = min(s[self.at]["min"] for f in files.get_fragments() for g in f.row_groups if (s := g.statistics) and self.at in s)
                first = pc.cast(pa.scalar(least, pa.timestamp("us")), pa.int64()).as_py()
            width = max(1, -(-(upper[0] - first) // self.slices))
            cuts = [(t, (1 << 63) - 1) for t in range(first + width, upper[0], width)]
            return [Slice(a, b) for a, b in zip([lower, *cuts], [*cuts, upper])]

        def read(self, partition: InputPartition) -> Iterator:
            import pyarrow as pa
            import pyarrow.dataset as ds

            files = self._files()
            at, key, kind = ds.field(self.at), ds.field(self.key), files.schema.field(self.at).type
            time = lambda x: pa.scalar(x, pa.timestamp("us")).cast(kind)
            (a, a_key), (b, b_key) = partition.lower, partition.upper
            rows = (at < time(b)) | ((at == time(b)) & (key <= b_key))
            if a > -(1 << 61):
                rows &= (at > time(a)) | ((at == time(a)) & (key > a_key))
            yield from files.scanner(columns=self.columns, filter=rows).to_batches()

    class CursorSource(DataSource):
        @classmethod
        def name(cls) -> str:
            return NAME

        def streamReader(self, schema) -> DataSourceStreamReader:
            return Reader(self.options, schema.names)

    return CursorSource


def read_cursor_stream(spark: SparkSession, path: str, contract: TableContract, slices: int = 8) -> DataFrame:
    """The table's rows as a stream, each once and in as many triggers as it grows; the contract's cursor and its first key, which must be a whole number, order them."""
    spark.dataSource.register(cursor_source())
    read = spark.readStream.format(NAME).schema(contract.schema)
    return read.option("path", path).option("cursor", contract.cursor).option("key", contract.keys[0]).option("slices", slices).load()
