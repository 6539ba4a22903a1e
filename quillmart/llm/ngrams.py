"""Tables of n-grams in packed shards: the counts and weights of the quality model.

A shard is a range of hashes. Its rows of one kind lie in one compressed binary
value (encode), so Spark deals out and stores a few large rows, and a task works on
the shards that it got with numpy. There are as many shards as the fitted rows need
at SHARD_TOKENS tokens each; steps go by parts, a share of the shards at a time,
so that a part alone of a table is shuffled at once.

Trigrams are counted by their first two words, which gives the totals of contexts
(count_trigrams); dealt by their last two words they give the bigrams, and those
give each word's figures (count_words). The words' figures go back to the shards
that asked for them, and each n-gram gets its weight there (weigh).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ROW, discard, materialize, place

#: shard; kind of the rows; base: a number that they share; their number; their columns, encoded.
PACKED = "shard int, kind int, base long, size int, data binary"
SCHEMA = pa.schema([("shard", pa.int32()), ("kind", pa.int32()), ("base", pa.int64()), ("size", pa.int32()), ("data", pa.binary())])
COLUMNS = SCHEMA.names
#: Tokens of fitted rows for each shard, about.
SHARD_TOKENS = 1 << 19
#: The steps go by so many parts of the shards at most, the counting of trigrams by fewer.
PARTS, COUNT_PARTS = 8, 4
#: Tokens or entries that a task holds before it sends them on.
HELD = 1 << 20
#: A weight is held as a whole number of 2 to this power parts, in five bytes.
WEIGHT_BITS = 35
#: Low bits of a word's number, which hold its shape. Events that are no word have small numbers; END's shape is an edge.
SHAPE_BITS = 4
BEGIN, END = 1 << SHAPE_BITS, 2 << SHAPE_BITS
RAW, TRIGRAM, BIGRAM, SHARE, WORD, FIGURES, WEIGHT, OWN, ENTRY, FAR, STATS, FAST = range(12)
#: How a column is written: its values as they are, or byte by byte (all first bytes, all second ones, and so on), or so the differences of sorted values.
PLAIN, BYTES, STEPS = range(3)
L, N = np.dtype(np.int64), np.dtype(np.uint32)
WEIGHED = np.dtype("V5")
FORMS = {
    RAW: ((L, PLAIN), (L, PLAIN), (L, PLAIN), (N, BYTES), (L, BYTES)),  # u, v, w, n, row of its place if there is one only, else -1
    TRIGRAM: ((L, STEPS), (L, PLAIN), *[(N, BYTES)] * 4, (L, BYTES)),  # hash of v and w, u, n, the numbers of words seen once, twice and more often after u and v, row
    BIGRAM: ((L, STEPS), (L, PLAIN), *[(N, BYTES)] * 4),  # v, w, how often it is a context, the numbers of words seen once, twice and more often after it
    SHARE: ((L, STEPS), *[(L, BYTES)] * 7),  # word; as a context: total, bigrams of 1, 2, more first words; as a last word: bigrams, places, row
    WORD: ((L, STEPS), *[(L, BYTES)] * 7),
    FIGURES: ((L, STEPS), *[(L, BYTES)] * 5),  # word, as above without places and row
    WEIGHT: ((L, STEPS), (WEIGHED, BYTES), (N, BYTES)),  # key, weight, n
    OWN: ((L, STEPS), (np.dtype(float), BYTES)),  # row, summed weights
    ENTRY: ((L, STEPS), (N, BYTES), (N, BYTES), (np.dtype(bool), BYTES)),  # key, row less the base, times, whether the row is fitted
    FAR: ((L, STEPS), (np.dtype(float), BYTES)),
    STATS: ((L, PLAIN),),
    FAST: ((L, STEPS), (WEIGHED, BYTES), (np.dtype(bool), BYTES)),  # key, weight, whether it is of one place
}
#: Kinds whose shards are ranges of their first column.
BY_KEY = {TRIGRAM, SHARE, WORD, WEIGHT, ENTRY, FAST}


def encode(kind: int, cols: list[np.ndarray]) -> bytes:
    """The columns in one compressed value. Of STEPS columns the differences are given."""
    parts = [c.tobytes() if how == PLAIN else c.view(np.uint8).reshape(-1, form.itemsize).T.tobytes() for c, (form, how) in zip(cols, FORMS[kind])]
    return pa.compress(b"".join(parts), codec="zstd", asbytes=True)


def decode(kind: int, size: int, data: bytes) -> list[np.ndarray]:
    data = pa.decompress(data, size * sum(form.itemsize for form, _ in FORMS[kind]), codec="zstd", asbytes=True)
    out, at = [], 0
    for form, how in FORMS[kind]:
        col = np.frombuffer(data, np.uint8, size * form.itemsize, at)
        at += len(col)
        col = col.view(form) if how == PLAIN else np.ascontiguousarray(col.reshape(form.itemsize, size).T).reshape(-1).view(form)
        out.append(np.cumsum(col) if how == STEPS else col)
    return out


def steps(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each value is above the one before, from 0 where a run begins."""
    out = np.diff(values, prepend=values[:1])
    out[first] = values[first]
    return out


def pack(kind: int, shard: np.ndarray, *cols: np.ndarray, base: int | np.ndarray = 0) -> pa.RecordBatch:
    """Columns as packed rows, one for each shard and, where it differs, base."""
    cols = [np.asarray(c).astype(form, copy=False) for c, (form, _) in zip(cols, FORMS[kind])]
    if isinstance(base, np.ndarray) and len(base) and (base == base[0]).all():
        base = int(base[0])
    several = isinstance(base, np.ndarray)
    if FORMS[kind][0][1] == PLAIN:
        order = np.lexsort((base, shard)) if several else np.argsort(shard, kind="stable")
    elif kind in BY_KEY and not several:
        order = np.argsort(cols[0].view(np.uint64))
    else:
        order = np.lexsort((cols[0], base, shard) if several else (cols[0], shard))
    shard, cols = shard[order], [c[order] for c in cols]
    base = base[order] if several else np.full(len(shard), base, L)
    first = starts(shard, base)
    ends = np.append(first[1:], len(shard))
    if FORMS[kind][0][1] == STEPS:
        cols[0] = steps(cols[0], first)
    data = [encode(kind, [c[a:b] for c in cols]) for a, b in zip(first, ends)]
    arrays = [pa.array(shard[first].astype(np.int32)), pa.array(np.full(len(first), kind, np.int32)), pa.array(base[first]), pa.array((ends - first).astype(np.int32)), pa.array(data, pa.binary())]
    return pa.RecordBatch.from_arrays(arrays, COLUMNS)


def unpack(kind: int, rows: list) -> tuple[np.ndarray, ...]:
    """base and the columns of packed rows of a kind."""
    base = np.repeat(np.array([r[0] for r in rows], L), np.array([r[1] for r in rows], L))
    cols = zip(*(decode(kind, size, data) for _, size, data in rows)) if rows else [[np.zeros(0, form)] for form, _ in FORMS[kind]]
    return base, *(np.concatenate(c) for c in cols)


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[int, list]]]:
    """Each shard of a task and its packed rows by kind."""
    held: dict = defaultdict(lambda: defaultdict(list))
    for batch in batches:
        for shard, kind, *row in zip(*(c.to_pylist() for c in batch.columns)):
            held[shard][kind].append(row)
    while held:
        yield held.popitem()


def starts(*sorted_cols: np.ndarray) -> np.ndarray:
    """Where a run of equal values begins."""
    if not len(sorted_cols[0]):
        return np.zeros(0, L)
    new = np.ones(len(sorted_cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in sorted_cols])
    return np.flatnonzero(new)


def summed(at: np.ndarray, values: np.ndarray, size: int) -> np.ndarray:
    """Whole-number sums by index."""
    return np.bincount(at, values, size).astype(L) if len(at) else np.zeros(size, L)


def chained(seed: np.ndarray | int, values: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of a long after the columns whose hash is the seed: that of columns a, b is chained(chained(42, a), b)."""
    p1, p2, p3, p4, p5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
    turned = lambda x, k: x << np.uint64(k) | x >> np.uint64(64 - k)
    first = seed.view(np.uint64) if isinstance(seed, np.ndarray) else np.full(len(values), seed, np.uint64)
    h = first + p5 + np.uint64(8) ^ turned(values.view(np.uint64) * p2, 31) * p1
    h = turned(h, 27) * p1 + p4
    h = (h ^ h >> np.uint64(33)) * p2
    h = (h ^ h >> np.uint64(29)) * p3
    return (h ^ h >> np.uint64(32)).view(L)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(L)


def parts_of(bits: int, most: int) -> int:
    """How many parts 2 to the power of bits shards are worked on in; a few shards need no parts."""
    return min(most, 1 << max(0, bits - 3))


def trigram_keys(two: np.ndarray, three: np.ndarray, bits: int) -> np.ndarray:
    """A trigram's key: the shard of its last two words, then its own hash."""
    low = np.uint64(64 - bits)
    return (two.view(np.uint64) >> low << low | three.view(np.uint64) >> np.uint64(bits)).view(L)


def fixed(weights: np.ndarray) -> np.ndarray:
    return np.round(weights * 2.0**WEIGHT_BITS).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :5].copy().view("V5").reshape(-1)


def unfixed(held: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(held), 8), np.uint8)
    wide[:, 3:] = np.frombuffer(held.tobytes(), np.uint8).reshape(-1, 5)
    return (wide.view("<i8").reshape(-1) >> 24) / 2.0**WEIGHT_BITS


def cuts(n: list[int]) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts 1, 2 and 3 or more, from how many n-grams are counted once to four times."""
    if not (n[0] and n[1]):
        return 0.5, 0.5, 0.5
    y = n[0] / (n[0] + 2 * n[1])
    return tuple(min(k - 0.05, max(0.05, k - (k + 1) * y * n[k] / n[k - 1])) if n[k - 1] else 0.5 for k in (1, 2, 3))


def less(n: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return n - np.array([0.0, *d])[np.minimum(n, 3)]


def free(k1: np.ndarray, k2: np.ndarray, k3: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return k1 * d[0] + k2 * d[1] + k3 * d[2]


def dealt(table: DataFrame, bits: int, work: Callable, parts: int, form: str = PACKED) -> DataFrame:
    """A part's packed rows, its shards one to a task, given to work. A shard's part is its number modulo the parts."""
    return table.select(*COLUMNS).repartitionById((1 << bits) // parts, (F.col("shard") / parts).cast("int")).mapInArrow(work, form)


def kept(table: DataFrame, by: str | None = None) -> DataFrame:
    """Packed rows written out as they are: they are compressed already."""
    return materialize(table, by, compression="uncompressed", **{"parquet.enable.dictionary": "false"})


def stored(table: DataFrame, bits: int) -> DataFrame:
    """The packed rows, written out in a folder for each part."""
    return kept(table.withColumn("part", F.col("shard") % parts_of(bits, PARTS)), "part")


def discard_part(table: DataFrame, part: int) -> None:
    discard(table, f"/part={part}")


def count_trigrams(streams: DataFrame, bits: int) -> list[DataFrame]:
    """TRIGRAM and BIGRAM rows of the fitted streams (ROW, ids binary: word numbers from two BEGINs to END), by the hash of the last and of both words."""
    parts, out = parts_of(bits, COUNT_PARTS), []
    for part in range(parts):

        def raw(batches: Iterator[pa.RecordBatch], part: int = part) -> Iterator[pa.RecordBatch]:
            held, size = [], 0

            def counted() -> pa.RecordBatch:
                ids = np.frombuffer(b"".join(x for _, x in held), L)
                sizes = np.array([len(x) // 8 for _, x in held], L)
                at = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                one = chained(42, ids)
                two = chained(np.concatenate((one[:1], one[:-1])), ids)
                ends = np.flatnonzero(at > 1)
                ends = ends[shard_of(two[ends - 1], bits) % parts == part]
                _, some, n = np.unique(chained(two[ends - 1], ids[ends]), return_index=True, return_counts=True)
                some = ends[some]
                row = np.repeat(np.array([x for x, _ in held], L), sizes)[some]
                return pack(RAW, shard_of(two[some - 1], bits), ids[some - 2], ids[some - 1], ids[some], n, np.where(n == 1, row, -1))

            for batch in batches:
                for row, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    held.append((row, ids))
                    size += len(ids) // 8
                    if size > HELD:
                        yield counted()
                        held, size = [], 0
            if held:
                yield counted()

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, kinds in shards(batches):
                _, u, v, w, n, row = unpack(RAW, kinds[RAW])
                uv = chained(chained(42, u), v)
                three = chained(uv, w)
                order = np.lexsort((three, uv))
                uv, three = uv[order], three[order]
                first = starts(uv, three)
                n = np.add.reduceat(n[order].astype(L), first)
                row = np.where(n == 1, np.maximum.reduceat(row[order], first), -1)
                u, v, w, uv = u[order][first], v[order][first], w[order][first], uv[first]
                mine = starts(uv)
                total, *ks = (np.add.reduceat(x.astype(L), mine) for x in (n, n == 1, n == 2, n > 2))
                yield pack(BIGRAM, shard_of(uv[mine], bits), u[mine], v[mine], total, *ks)
                many = np.diff(np.append(mine, len(uv)))
                vw = chained(chained(42, v), w)
                yield pack(TRIGRAM, shard_of(vw, bits), vw, u, n, *(np.repeat(k, many) for k in ks), row)
                # Bigrams that end a text are no contexts.
                _, last = np.unique(np.where(w == END, vw, 0), return_index=True)
                last = last[w[last] == END]
                none = np.zeros(len(last), N)
                yield pack(BIGRAM, shard_of(vw[last], bits), v[last], w[last], none, none, none, none)

        out.append(stored(dealt(streams.mapInArrow(raw, PACKED), bits, count, parts), bits))
    return out


def bigrams(kinds: dict[int, list]) -> tuple:
    """Of a shard its TRIGRAM columns but the first, the place of each one's bigram, and of each bigram or context: hash, v, w, figures as a context, number of first words, places, row."""
    _, v, w, total, *ks = unpack(BIGRAM, kinds[BIGRAM])
    hashes = chained(chained(42, v), w)
    order = np.lexsort((-total.astype(L), hashes))
    order = order[starts(hashes[order])]
    hashes, v, w, total, *ks = (x[order] for x in (hashes, v, w, total, *ks))
    _, vw, u, n, k1, k2, k3, row = unpack(TRIGRAM, kinds[TRIGRAM])
    at, size = place(hashes, vw), len(hashes)
    before, places = summed(at, np.ones(len(at)), size), summed(at, n, size)
    rows = np.full(size, -1, L)
    alone = places[at] == 1
    rows[at[alone]] = row[alone]
    return (u, n, (k1, k2, k3), row), at, hashes, v, w, total, ks, before, places, rows


def count_words(tables: list[DataFrame], bits: int) -> tuple[DataFrame, list[list[int]]]:
    """WORD rows, and FIGURES rows for each shard of bigrams that has the word; how many trigrams and bigrams are counted once to four times."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kinds in shards(batches):
            (_, n, *_), _, _, v, w, _, _, before, places, rows = bigrams(kinds)
            real = before > 0
            v, w, before, places, rows = v[real], w[real], before[real], places[real], rows[real]
            words, at = np.unique(np.concatenate((v, w)), return_inverse=True)
            at_v, at_w, size = at[: len(v)], at[len(v) :], len(words)
            seen = summed(at_w, places, size)
            row = np.full(size, -1, L)
            row[at_w] = rows
            figures = [summed(at_v, before, size), *(summed(at_v, x, size) for x in (before == 1, before == 2, before > 2)), np.bincount(at_w, minlength=size), seen]
            yield pack(SHARE, shard_of(words, bits), words, *figures, np.where(seen == 1, row, -1), base=shard)
            stats = [[int((x == k).sum()) for k in (1, 2, 3, 4)] for x in (n, before)]
            yield pa.RecordBatch.from_pylist([{"shard": 0, "kind": STATS, "base": 0, "size": 8, "data": encode(STATS, [np.array(stats, L)])}], schema=SCHEMA)

    parts = parts_of(bits, PARTS)
    out = [kept(dealt(union([t.filter(F.col("part") == part) for t in tables]), bits, share, parts)) for part in range(parts)]
    shares = union(out)
    stats = np.zeros((2, 4), L)
    for r in shares.filter(F.col("kind") == STATS).select("size", "data").collect():
        stats += decode(STATS, r.size, bytes(r.data))[0].reshape(2, 4)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kinds in shards(batches):
            asked, word, *figures, row = unpack(SHARE, kinds[SHARE])
            words, at = np.unique(word, return_inverse=True)
            figures = [summed(at, x, len(words)) for x in figures]
            rows = np.full(len(words), -1, L)
            np.maximum.at(rows, at, row)
            yield pack(WORD, np.full(len(words), shard), words, *figures, np.where(figures[-1] == 1, rows, -1))
            yield pack(FIGURES, asked, word, *(x[at] for x in figures[:-1]))

    parts = parts_of(bits, COUNT_PARTS)
    words = union([stored(dealt(shares.filter((F.col("kind") == SHARE) & (F.col("shard") % parts == part)), bits, total, parts), bits) for part in range(parts)])
    for table in out:
        discard(table)
    return words, stats.tolist()


def weigh(tables: list[DataFrame], words: DataFrame, stats: list[list[int]], bits: int, kinds_of_words: int) -> tuple[list[DataFrame], list[DataFrame], np.ndarray]:
    """WEIGHT rows of each part, the sums by row (ROW, far) of the n-grams of one place of each part, and the log10 probability of an unknown word of each shape. The tables are discarded as they are read."""
    mask = (1 << SHAPE_BITS) - 1

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, kinds in shards(iter([batch])):
                _, word, *_, n, _, _ = unpack(WORD, kinds[WORD])
                kind = (word & mask)[n > 0]
                n = n[n > 0]
                shapes = [np.bincount(kind, x, kinds_of_words).astype(L).tolist() for x in (n, n == 1, n == 2, n == 3, n == 4, n > 2, n > 0)]
                yield pa.RecordBatch.from_arrays([pa.array([sum(shapes, [])], pa.list_(pa.int64()))], ["n"])

    only_words = words.filter(F.col("kind") == WORD).select(*COLUMNS)
    seen = np.zeros(7 * kinds_of_words, L)
    for r in only_words.mapInArrow(tally, "n array<long>").collect():  # a row for each batch of shards
        seen += np.array(r.n)
    seen = seen.reshape(7, kinds_of_words)
    d3, d2, d1 = cuts(stats[0]), cuts(stats[1]), cuts(seen[1:5].sum(1).tolist())
    total = float(seen[0].sum()) or 1.0
    # What the discounts leave goes to all words and unknown events alike; unknown events by the shapes of the words that follow one word only.
    share = 1.0 + seen[1]
    back = (seen[1].sum() * d1[0] + seen[2].sum() * d1[1] + seen[5].sum() * d1[2]) / total if seen[6].sum() else 1.0
    size = kinds_of_words + int(seen[6].sum())
    unknown = np.log10(back * kinds_of_words / size * share / share.sum())
    p1 = lambda n: less(n, d1) / total + back / size

    def own(row: np.ndarray, weight: np.ndarray) -> pa.RecordBatch:
        return row_sums(OWN, row[row >= 0], weight[row >= 0], bits)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kinds in shards(batches):
            _, word, t2, f1, f2, f3, n, places, row = unpack(WORD, kinds[WORD])
            # BEGIN and the pair of BEGINs only come before words, END only after them.
            weight = np.where(n > 0, np.log10(p1(n)) - unknown[word & mask], 0.0) + np.where(t2 > 0, np.log10(np.maximum(free(f1, f2, f3, d2), 1e-300) / np.maximum(t2, 1)), 0.0)
            yield pack(WEIGHT, np.full(len(word), shard), word, fixed(weight), np.where(n > 0, places, np.maximum(t2, 2)))
            yield own(row, weight)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, kinds in shards(batches):
            (u, n, ks, row), at, hashes, v, w, total3, ks2, before, places, rows = bigrams(kinds)
            key = trigram_keys(hashes[at], chained(chained(chained(42, u), v[at]), w[at]), bits)
            _, word, t2, f1, f2, f3, n1 = unpack(FIGURES, kinds[FIGURES])
            order = np.argsort(word)
            t2, left, n1 = t2[order], free(f1, f2, f3, d2)[order], n1[order]
            real = before > 0
            i, j = place(word[order], v[real]), place(word[order], w[real])
            lower = left[i] / t2[i] * p1(n1[j])
            p2, gain = np.ones(len(hashes)), np.zeros(len(hashes))
            p2[real] = less(before[real], d2) / t2[i] + lower
            gain[real] = np.log10(p2[real] / lower)
            after = total3 > 0
            gain[after] += np.log10(free(*ks2, d3)[after] / total3[after])
            high = np.log10(1 + less(n, d3) / free(*ks, d3) / p2[at])
            here = lambda x: np.full(len(x), shard)
            keys, weights, ns = np.concatenate((hashes, key)), np.concatenate((gain, high)), np.concatenate((np.where(real, places, np.maximum(total3, 2)), n))
            yield pack(WEIGHT, here(keys), keys, fixed(weights), ns)
            yield own(np.concatenate((rows, row)), np.concatenate((gain, high)))

    out, sums, parts = [], [], parts_of(bits, PARTS)
    for part in range(parts):
        mine = lambda t: t.filter(F.col("part") == part)
        asked = mine(words).filter(F.col("kind") == FIGURES)
        weighed = dealt(union([mine(t) for t in tables] + [asked]), bits, others, parts).unionByName(mine(words).filter(F.col("kind") == WORD).select(*COLUMNS).mapInArrow(one, PACKED))
        out.append(kept(weighed, "kind").select(*COLUMNS))
        # A row has n-grams in most shards, so its sums are added up before the next part makes more.
        sums.append(materialize(by_row([out[-1].filter(F.col("kind") == OWN)], bits)))
        discard(out[-1], f"/kind={OWN}")
        for t in tables:
            discard_part(t, part)
    discard(words)
    for t in tables:
        discard(t)
    return out, sums, unknown


def row_sums(kind: int, row: np.ndarray, values: np.ndarray, bits: int) -> pa.RecordBatch:
    """Sums by row, packed by the row's hash."""
    rows, at = np.unique(row, return_inverse=True)
    return pack(kind, shard_of(chained(42, rows), bits), rows, np.bincount(at, values, len(rows)))


def by_row(tables: list[DataFrame], bits: int) -> DataFrame:
    """ROW, far: the sums of OWN or FAR rows."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in shards(batches):
            _, row, value = (np.concatenate(x) for x in zip(*(unpack(kind, got) for kind, got in kinds.items())))
            rows, at = np.unique(row, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(rows), pa.array(np.bincount(at, value, len(rows)))], [ROW, "far"])

    return dealt(union(tables), bits, add, 1, f"{ROW} long, far double")


def look_up(entries: DataFrame, weights: DataFrame, bits: int) -> DataFrame:
    """FAR rows of a part: of each row with entries the weights of those that the model has. A fitted row's n-grams of one place are in its OWN sum."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, kinds in shards(batches):
            base, wanted, row, times, fit = unpack(ENTRY, kinds[ENTRY])
            _, key, weight, n = unpack(WEIGHT, kinds[WEIGHT])
            order = np.argsort(key)
            at = place(key[order], wanted)
            if len(key):
                hit = (at >= 0) & ~(fit & (n[order][at] == 1))
                at = order[at[hit]]
                yield row_sums(FAR, base[hit] + row[hit], times[hit] * unfixed(weight)[at], bits)

    return dealt(entries.unionByName(weights), bits, add, parts_of(bits, PARTS))


def union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out

