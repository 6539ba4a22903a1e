"""Bounded-space online packing of tokenized documents into windows.

Each task takes its documents in order of arrival and keeps a fixed number of open
windows. A piece goes to the open window that it leaves with the least room. If none
has room for it, the fullest is topped up with the head of the piece and emitted,
and the tail is placed in turn, so an emitted window is always full. At its end a
task merges its open windows and is left with less than one window; the tasks' rests
are laid end to end by their lengths and cut into windows, and what remains at the
very end into powers of two, which need no padding. Nothing is shuffled but the
rests, under one window from each task.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize
from .encoder import encoder

CAPACITY = 2048
OPEN_WINDOWS = 64
END_ID = 1
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: Documents encoded and rows returned at a time.
_DOCS, _ROWS = 512, 8192


class OpenWindows:
    """Up to `most` open windows, found by their free space; bit f of `bits` is set while one with f free places is open.

    A piece is (doc_id, start, doc_tokens, ids); a window is the list of its pieces.
    """

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.count, self.bits = capacity, most, 0, 0
        self.by_free: dict[int, list[list]] = {}

    def add(self, piece: tuple) -> Iterator[list]:
        """Places a piece of at most a window; gives the windows that are full by it."""
        doc, start, total, ids = piece
        length = len(ids) // 4
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            window = self._take(free)
        elif self.count < self.most:
            free, window = self.capacity, []
        else:
            free = (self.bits & -self.bits).bit_length() - 1
            window = self._take(free)
            yield [*window, (doc, start, total, ids[: 4 * free])]
            yield from self.add((doc, start + free, total, ids[4 * free :]))
            return
        window.append(piece)
        if free == length:
            yield window
        else:
            self._put(free - length, window)

    def merged(self) -> Iterator[list]:
        """The open windows, fullest first, end to end in full windows; the last one may be short."""
        window, free = [], self.capacity
        for size in sorted(self.by_free):
            for doc, start, total, ids in (p for w in self.by_free[size] for p in w):
                while len(ids) >= 4 * free:
                    yield [*window, (doc, start, total, ids[: 4 * free])]
                    start, ids, window, free = start + free, ids[4 * free :], [], self.capacity
                if ids:
                    window.append((doc, start, total, ids))
                    free -= len(ids) // 4
        if window:
            yield window

    def _put(self, free: int, window: list) -> None:
        self.by_free.setdefault(free, []).append(window)
        self.bits |= 1 << free
        self.count += 1

    def _take(self, free: int) -> list:
        windows = self.by_free[free]
        window = windows.pop()
        if not windows:
            del self.by_free[free]
            self.bits ^= 1 << free
        self.count -= 1
        return window


def windows_of(docs: Iterator[tuple[int | None, bytes]], capacity: int, most: int) -> Iterator[list]:
    """The full windows of one task's documents (id, token ids), as they fill; the last one may be short."""
    open_windows = OpenWindows(capacity, most)
    for doc, ids in docs:
        total, start = len(ids) // 4, 0
        while total - start >= capacity:
            yield [(doc, start, total, ids[4 * start : 4 * (start + capacity)])]
            start += capacity
        if start < total:
            yield from open_windows.add((doc, start, total, ids[4 * start :]))
    yield from open_windows.merged()


def packed_by_task(docs: DataFrame, tokenizer: str, capacity: int, most: int, end_id: int) -> DataFrame:
    """The pieces of each task's full windows, and of its rest: these have their ids, and as sequence_id the task's number."""
    end = int(end_id).to_bytes(4, "little")

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, bytes]]:
        enc = encoder(tokenizer)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1)
            for at in range(0, len(ids), _DOCS):
                for doc, raw in zip(ids[at : at + _DOCS], enc.encode(texts.slice(at, _DOCS).to_pylist())):
                    yield doc, raw + end

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, names = TaskContext.get().partitionId(), [c.split()[0] for c in PIECE.split(", ")] + ["ids"]
        rows: list[tuple] = []

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows))
            rows.clear()
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:-1]), pa.array(cols[-1], pa.binary())], names)

        for number, window in enumerate(windows_of(encoded(batches), capacity, most)):
            at, rest = 0, sum(len(p[3]) for p in window) < 4 * capacity
            for doc, start, total, ids in window:
                n = len(ids) // 4
                rows.append((doc, start, n, zlib.crc32(ids), total, task if rest else (task << 32 | number) * 2, at, ids if rest else None))
                at += n
            if len(rows) >= _ROWS:
                yield batch()
        if rows:
            yield batch()

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(work, PIECE + ", ids binary")


def powers_of_two(n: int) -> list[int]:
    """The powers of two that add up to n, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def merge_rests(rests: DataFrame, capacity: int) -> DataFrame:
    """The tasks' rests end to end in windows, and the last of them in powers of two; their pieces are cut where a window ends."""
    sizes = rests.groupBy(F.col("sequence_id").alias("task")).agg(F.sum("length").alias("n"))
    # A row for each task.
    sizes = materialize(sizes.withColumn("before", F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1))).fillna(0, ["before"]))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    ends = [total // capacity * capacity]
    for power in powers_of_two(total % capacity):
        ends.append(ends[-1] + power)
    tail = F.array(*[F.lit(e).cast("long") for e in ends])

    def begins(at: Column) -> Column:
        """Where the window of a place begins."""
        return F.when(at < ends[0], at - F.pmod(at, F.lit(capacity))).otherwise(F.array_max(F.filter(tail, lambda e: e <= at)))

    placed = rests.join(sizes, rests["sequence_id"] == sizes["task"]).withColumn("at", F.col("before") + F.col("offset"))
    last = F.col("at") + F.col("length")
    # A piece of a rest is shorter than a window, so at most one full window ends inside it.
    next_end = F.col("at") - F.pmod("at", F.lit(capacity)) + capacity
    inside = F.filter(F.concat(F.array(F.when(next_end <= ends[0], next_end)), tail), lambda e: (e > F.col("at")) & (e < last))
    bounds = F.array_sort(F.array_distinct(F.concat(F.array(F.col("at"), last), inside)))
    parts = placed.withColumn("bounds", bounds).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("bounds") - 1)))
    lo, hi = F.element_at("bounds", F.col("k")), F.element_at("bounds", F.col("k") + 1)
    parts = parts.withColumns({"lo": lo, "hi": hi}).withColumns({"from": F.col("lo") - F.col("at"), "begin": begins(F.col("lo"))})
    ids = F.substr("ids", (4 * F.col("from") + 1).cast("int"), (4 * (F.col("hi") - F.col("lo"))).cast("int"))
    return parts.select(
        "doc_id",
        (F.col("start") + F.col("from")).alias("start"),
        (F.col("hi") - F.col("lo")).alias("length"),
        F.crc32(ids).cast("long").alias("ids_crc32"),
        "doc_tokens",
        (2 * F.col("begin") + 1).alias("sequence_id"),
        (F.col("lo") - F.col("begin")).alias("offset"),
    )


def pack_online(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, most: int = OPEN_WINDOWS, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece of docs (doc_id, text).

    A document is its text's ids and the end id; a null or empty text is the end id
    alone. Every sequence holds `capacity` tokens, except those of the very end, each
    of a power of two. Repeated rows are packed one by one; a null doc_id stays null;
    other columns are not read; an empty table gives no rows. A lost task is packed
    again from its own rows, with the same result.
    """
    packed = materialize(packed_by_task(docs, tokenizer, capacity, most, end_id))
    full = packed.filter(F.col("ids").isNull()).drop("ids")
    return full.unionByName(merge_rests(packed.filter(F.col("ids").isNotNull()), capacity))
