"""Benchmark decontamination with a broadcast hash set of normalised n-grams.

The windows of the benchmark become sorted 64-bit hashes that each task probes with
the windows of its documents; hits are verified byte by byte. That broadcast is the
benchmark's words, run together, and some 28 bytes of numbers for each word and
window. Of a benchmark over `block_bytes` only the bits of the hashes are broadcast,
a bitmap of at most 2 ** MAP_BITS bits; the windows of documents that it lets
through are joined with the benchmark's by hash and words. Documents are read once,
whatever the benchmark's size.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, flat_words, free_name, keyed, materialize, place, raw_bytes, settled, slices, without, word_hashes

WINDOW = 10
#: Most benchmark text in one broadcast.
BLOCK_BYTES = 32 << 20
#: Bits of the bitmap for a larger benchmark: BITS_A_WINDOW for each window, 2 ** MAP_BITS (64 MB) at most.
MAP_BITS, BITS_A_WINDOW = 29, 16
#: Most spans that are broadcast, some 60 bytes each.
BROADCAST_SPANS = 1_000_000
#: Windows in an Arrow batch.
BATCH_WINDOWS = 50_000
#: bytes.translate table: A-Z lower-cased, all ASCII but 0-9 and a-z to a space.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or c >= 97 and c <= 122 or c >= 128 else 32 for c in range(256))
#: A word, in bytes.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    return raw_bytes(text).translate(WORDS).split()


def rolled(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each window of n word numbers."""
    out = np.zeros(len(ids) - n + 1, np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = (out ^ ids[k : len(ids) - n + 1 + k].astype(np.uint64)) * _ODD
            out ^= out >> np.uint64(29)
    return out


class WindowSet:
    """The windows of some items: word hashes, and for each length of window its sorted hashes with places in the words run together, and items."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.items = sorted({item for item, _ in items if item is not None})
        number = {item: i for i, item in enumerate(self.items)}
        lists = [words_of(text) for _, text in items]
        flat = list(chain.from_iterable(lists))
        codes, words = flat_words(lists)
        hashes = word_hashes(words)
        self.words = np.unique(hashes)
        ids = place(self.words, hashes)[codes] + 1 if len(flat) else np.zeros(0, np.int64)
        self.text = b" ".join(flat)
        ends = np.cumsum(np.fromiter(map(len, flat), np.int64, len(flat)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1)) if len(flat) else ends
        sizes = np.fromiter(map(len, lists), np.int64, len(lists))
        first, length = np.cumsum(sizes) - sizes, np.minimum(sizes, window)
        item = np.array([-1 if x is None else number[x] for x, _ in items], np.int32)
        self.by_length: dict[int, tuple[np.ndarray, ...]] = {}
        for n in np.unique(length[length > 0]).tolist():
            at = np.concatenate([np.arange(f, f + s - n + 1) for f, s in zip(first[length == n], sizes[length == n])])
            keys = rolled(ids, n)[at]
            order = np.argsort(keys, kind="stable")
            own = np.repeat(item[length == n], sizes[length == n] - n + 1)
            at = at[order]
            self.by_length[n] = keys[order], starts[at], ends[at + n - 1], own[order]

    def hits(self, lists: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each document's words: starts and ends of the windows that occur, and the items they are from."""
        spans: list[list[tuple[int, int]]] = [[] for _ in lists]
        items: list[set] = [set() for _ in lists]
        codes, words = flat_words([[*x, b""] for x in lists])  # no word is empty, so no window crosses from one document to the next
        ids = (place(self.words, word_hashes(words)) + 1)[codes] if len(codes) else np.zeros(0, np.int64)
        if len(codes):
            ids[np.cumsum([len(x) + 1 for x in lists]) - 1] = 0
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        sizes = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
        begin = np.cumsum(sizes) - sizes
        for n, (keys, starts, ends, own) in self.by_length.items():
            if len(ids) < n:
                continue
            at = np.flatnonzero(unknown[n:] == unknown[:-n])  # windows of known words only
            h = rolled(ids, n)[at]
            low = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[low] == h
            at, low, high = at[hit], low[hit], np.searchsorted(keys, h[hit], "right")
            docs = np.searchsorted(begin, at, "right") - 1
            for i, doc, a, b in zip((at - begin[docs]).tolist(), docs.tolist(), low.tolist(), high.tolist()):
                text = b" ".join(lists[doc][i : i + n])
                same = [k for k in range(a, b) if self.text[starts[k] : ends[k]] == text]
                if same:
                    spans[doc].append((i, i + n))
                    items[doc].update(self.items[own[k]] for k in same if own[k] >= 0)
        return spans, items


def block_count(benchmark: DataFrame, block_bytes: int) -> int:
    """How many blocks of this size the benchmark's texts and ids fill, one at least."""
    bytes_of = lambda c: F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0))
    size = _items(benchmark).agg(F.coalesce(F.sum(bytes_of("text") + bytes_of("item")), F.lit(0))).first()[0]
    return max(1, -(-size // block_bytes))


def _items(benchmark: DataFrame) -> DataFrame:
    """item and text of the items that may have words."""
    return benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text")).filter(F.length("text") > 0)


def _window_set(benchmark: DataFrame, window: int) -> Broadcast:
    """The windows of a benchmark of one block as a broadcast."""
    return benchmark.sparkSession.sparkContext.broadcast(WindowSet([tuple(r) for r in _items(benchmark).collect()], window))


def _windows(benchmark: DataFrame, window: int) -> DataFrame:
    """item, n, h, gram for each window of each item: its length in words, its hash and its words."""

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        item, n, h, gram = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(item, pa.string()), pa.array(n, pa.int32()), pa.array(h, pa.int64()), pa.array(gram, pa.binary())], ["item", "n", "h", "gram"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in slices(batches):
            for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = words_of(text)
                n = min(len(words), window)
                for i, h in enumerate(rolled(word_hashes(words), n).view(np.int64).tolist() if n else []):
                    rows.append((item, n, h, b" ".join(words[i : i + n])))
                    if len(rows) == BATCH_WINDOWS:
                        yield batch_of(rows)
                        rows = []
        if rows:
            yield batch_of(rows)

    return _items(benchmark).mapInArrow(cut, "item string, n int, h long, gram binary")


def _spots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Two places of each hash in a bitmap of 2 ** bits bits: its first and its last bits."""
    return h >> np.uint64(64 - bits), h & np.uint64((1 << bits) - 1)


def _bitmap(windows: DataFrame) -> tuple[np.ndarray, int]:
    """A bitmap in which the places of all windows are set, built in parts by the tasks, and the power of its size."""
    bits = min(MAP_BITS, max(15, (BITS_A_WINDOW * windows.count()).bit_length()))
    spots = F.array(F.shiftrightunsigned("h", 64 - bits) + 1, F.col("h").bitwiseAND((1 << bits) - 1) + 1)  # they count from one
    at = windows.select(F.explode(spots).alias("p"))
    parts = at.groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits")).toArrow()
    out = np.zeros((1 << bits - 15, 4096), np.uint8)
    for part, found in zip(parts.column("part").to_pylist(), parts.column("bits")):
        out[part - 1] = np.frombuffer(found.as_buffer(), np.uint8)
    return out.reshape(-1), bits


def scan(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """ROW, doc_id, n_words, n_hit, items (sorted strings) and spans (merged, in words) for each row of docs.

    Texts that are null have no words. Items without words have no window; an
    empty benchmark hits nothing. Repeated items and rows count for themselves,
    an item_id once. The windows of an item without an item_id count as hits, but
    there is no id to list. An empty table gives no rows.
    """
    found = _probed(docs, benchmark, window) if block_count(benchmark, block_bytes) == 1 else _joined(docs, benchmark, window)
    zero = F.lit(0).cast("long")
    end_of = lambda xs: F.try_element_at(xs, F.lit(-1))
    merged = F.aggregate(
        F.array_sort("spans"),
        F.array().cast("array<array<long>>"),
        lambda xs, s: F.when((F.size(xs) > 0) & (s[0] <= end_of(xs)[1]), F.concat(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))), F.array(F.array(end_of(xs)[0], F.greatest(end_of(xs)[1], s[1]))))).otherwise(F.concat(xs, F.array(s))),
    )
    n_hit = F.aggregate(
        F.array_sort("spans"),
        F.struct(zero.alias("n"), zero.alias("end")),
        lambda acc, s: F.struct((acc.n + F.greatest(zero, s[1] - F.greatest(s[0], acc.end))).alias("n"), F.greatest(acc.end, s[1]).alias("end")),
    ).n
    return found.select(ROW, "doc_id", "n_words", n_hit.alias("n_hit"), F.array_sort("items").alias("items"), merged.alias("spans"))


def _probed(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """ROW, doc_id, n_words, items (distinct) and spans of each row of docs, by the broadcast windows."""
    sent = _window_set(benchmark, window)

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            lists = [words_of(x) for x in batch.column(2).to_pylist()]
            spans, items = sent.value.hits(lists)
            cols = [batch.column(0), batch.column(1), pa.array(list(map(len, lists)), pa.int64()), pa.array(list(map(list, items)), pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(cols, [ROW, "doc_id", "n_words", "items", "spans"])

    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(probe, f"{ROW} long, doc_id long, n_words long, items array<string>, spans array<array<long>>")


def _joined(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """What _probed gives, by a join of the windows that a bitmap lets through.

    Places of a document's windows and ids of items are found apart, so a passage
    that repeats in a document and in many items is not multiplied out.
    """
    windows = materialize(_windows(benchmark, window).distinct())
    lengths = sorted(r.n for r in windows.select("n").distinct().collect())
    sent = docs.sparkSession.sparkContext.broadcast(_bitmap(windows))

    def may(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, bits = sent.value
        for batch in slices(batches):
            lists = [words_of(x) for x in batch.column(2).to_pylist()]
            codes, words = flat_words([[*x, b""] for x in lists])  # no window crosses the empty word
            ids = word_hashes(words)[codes]
            sizes = np.fromiter((len(x) + 1 for x in lists), np.int64, len(lists))
            begin, stop = np.cumsum(sizes) - sizes, np.zeros(len(ids) + 1, np.int64)
            stop[np.cumsum(sizes)] = 1
            stop = np.cumsum(stop)
            kept = [np.zeros((4, 0), np.int64)]
            for n in lengths:
                if len(ids) >= n:
                    at = np.flatnonzero(stop[n:] == stop[:-n])
                    h = rolled(ids, n)[at]
                    for spot in range(2):
                        p = _spots(h, bits)[spot]
                        there = (bitmap[(p >> np.uint64(3)).astype(np.int64)] >> (p & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
                        at, h = at[there], h[there]
                    doc = np.searchsorted(begin, at, "right") - 1
                    kept.append(np.stack([doc, at - begin[doc], np.full(len(at), n), h.view(np.int64)]))
            doc, at, n, h = np.concatenate(kept, 1)
            order = np.argsort(doc, kind="stable")
            doc, at, n, h = doc[order], at[order], n[order], h[order]
            grams = [b" ".join(lists[d][i : i + k]) for d, i, k in zip(doc.tolist(), at.tolist(), n.tolist())]
            ends = pa.array(np.concatenate(([0], np.cumsum(np.bincount(doc, minlength=len(lists))))).astype(np.int32))
            cols = [pa.array(at.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h), pa.array(grams, pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes - 1), *[pa.ListArray.from_arrays(ends, x) for x in cols]], [ROW, "doc_id", "n_words", "at", "n", "h", "gram"]
            )

    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    held = materialize(rows.mapInArrow(may, f"{ROW} long, doc_id long, n_words long, at array<int>, n array<int>, h array<long>, gram array<binary>"))
    key = ["n", "h", "gram"]
    some = held.select(ROW, F.explode(F.arrays_zip("at", *key)).alias("x")).select(ROW, "x.*")
    hits = materialize(some.join(windows.select(key).distinct(), key, "left_semi"))
    span = F.array(F.col("at").cast("long"), (F.col("at") + F.col("n")).cast("long"))
    spans = hits.groupBy(ROW).agg(F.collect_list(span).alias("spans"))
    listed = hits.select(ROW, *key).distinct().join(windows.filter("item IS NOT NULL"), key).select(ROW, "item").distinct()
    items = listed.groupBy(ROW).agg(F.collect_list("item").alias("items"))
    none = F.array()
    return (
        held.select(ROW, "doc_id", "n_words").join(spans, ROW, "left").join(items, ROW, "left")
        .select(ROW, "doc_id", "n_words", F.coalesce("items", none.cast("array<string>")).alias("items"), F.coalesce("spans", none.cast("array<array<long>>")).alias("spans"))
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, whatever its columns, without the rows that hold a window of the benchmark.

    Rows go in the scan that finds them; with a benchmark of more than one block they go by their place.
    """
    if block_count(benchmark, block_bytes) > 1:
        docs = settled(docs)
        return without(docs, scan(docs, benchmark, window, block_bytes).filter(F.size("spans") > 0))
    return _in_scan(docs, benchmark, window, lambda batch, lists, spans: batch.filter(pa.array([not s for s in spans], pa.bool_())))


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with the words that windows of the benchmark hit cut out of the text, from a passage's first byte to its last; other texts, null and empty ones too, stay as they are.

    A benchmark of one block is cut out in the scan. The spans of a larger one come by
    a join, broadcast where there are at most BROADCAST_SPANS of them.
    """
    name = next(c for c in docs.columns if c.lower() == "text")

    def cut(batch: pa.RecordBatch, spans: list) -> pa.RecordBatch:
        at = batch.schema.get_field_index(name)
        field = batch.schema.field(at)
        return batch.set_column(at, field, pa.array([t if not s else _without_spans(t, s) for t, s in zip(batch.column(at).to_pylist(), spans)], field.type))

    if block_count(benchmark, block_bytes) == 1:
        return _in_scan(docs, benchmark, window, lambda batch, lists, spans: cut(batch, spans))
    docs = settled(docs)
    hit = materialize(scan(docs, benchmark, window, block_bytes).filter(F.size("spans") > 0).select(F.col(ROW).alias("_q_hit"), F.col("spans").alias("_q_spans")))
    few = hit.agg(F.coalesce(F.sum(F.size("_q_spans")), F.lit(0))).first()[0] <= BROADCAST_SPANS
    row = free_name(docs, ROW)
    both = docs.withColumn(row, F.monotonically_increasing_id()).join(F.broadcast(hit) if few else hit, F.col(row) == F.col("_q_hit"), "left").drop(row, "_q_hit")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), whole.schema.get_field_index(name)):
                last = batch.num_columns - 1
                yield cut(batch, batch.column(last).to_pylist()).select(range(last))

    return both.mapInArrow(joined, docs.schema)


def _without_spans(text: str, spans: list[tuple[int, int]]) -> str:
    raw = raw_bytes(text)
    at = [m.span() for m in WORD.finditer(raw)]
    passages: list[list[int]] = []
    for a, b in sorted(map(tuple, spans)):
        if passages and a <= passages[-1][1]:
            passages[-1][1] = max(passages[-1][1], b)
        else:
            passages.append([a, b])
    out, end = [], 0
    for a, b in passages:
        out.append(raw[end : at[a][0]])
        end = at[b - 1][1]
    return b"".join([*out, raw[end:]]).decode("utf-8", "surrogatepass")


def _in_scan(docs: DataFrame, benchmark: DataFrame, window: int, act) -> DataFrame:
    """docs after act(batch, words, spans), by the broadcast windows of a benchmark of one block."""
    sent = _window_set(benchmark, window)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(iter([whole]), whole.schema.get_field_index("text")):
                lists = [words_of(x) for x in batch.column("text").to_pylist()]
                yield act(batch, lists, sent.value.hits(lists)[0])

    return docs.mapInArrow(work, docs.schema)
