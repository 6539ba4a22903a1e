"""Class-based bigram language model with classes from exchange clustering.

Every training word has a class. Words with a share of the training tokens of at
least OWN_SHARE (1 / OWN_SHARE bounds them) are clustered first, with all others in
POOLS units by their last three bytes: an exchange step gives each unit the class
that most raises the likelihood of the class bigrams, all else fixed. Of a step's
moves only so many are kept, the best first, that the likelihood does not fall. Then every other word, however rare, is exchanged
on its own: its bigrams with the classes before and after it are summed in Spark and
it takes the class that they raise most. For so rare a word the change is taken to
first order.

Words travel as their 64-bit hashes. Tables of the words with a share of at least
FAST_SHARE (1 / FAST_SHARE bounds them) travel with the tasks; the others are joined.
A word that training lacks belongs to the class where most words seen once with its
ending are. It shares what absolute discounting takes from that class's words with as
many other unseen words as Chao's estimate, from words seen once and twice, gives, so
a class's probabilities, seen and unseen words together, sum to one.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, ROW, discard, flat_words, keyed, materialize, place, raw_bytes, slices, word_hashes

CLASSES = 64
SWEEPS = 8
OWN_SHARE = 1e-4
FAST_SHARE = 5e-7
POOLS = 512
#: Units that a task exchanges one after the other.
TASK_UNITS = 512
#: Bytes of text that are numbered together; words are counted once in each slice.
SLICE_BYTES = 6 << 20
#: The end of a text as a token; no word holds white space.
END = b"\n"


def tokens(text: str | None) -> list[bytes]:
    return raw_bytes(text).translate(LOWER).split()


def pool_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % POOLS


def word_hash(word: bytes) -> int:
    """XXH64, signed."""
    return int(word_hashes([word]).view(np.int64)[0])


def split_rows(docs: DataFrame) -> DataFrame:
    """ROW, doc_id, held_out, text; crc32(doc_id as text) mod 7 is 2 for held-out rows, a null id counts as empty."""
    doc_id = F.col("doc_id").cast("long")
    held = F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % 7 == 2
    return keyed(docs, doc_id.alias("doc_id"), held.alias("held_out"), F.col("text").cast("string").alias("text"))


class Numbered(NamedTuple):
    """Texts one after the other, each with END at its end: codes into the distinct words' hashes and pools, and the texts' sizes."""

    codes: np.ndarray
    hashes: np.ndarray
    pools: np.ndarray
    sizes: np.ndarray


def numbered(texts: list[str | None]) -> Numbered:
    lists = [tokens(t) for t in texts]
    for x in lists:
        x.append(END)
    codes, words = flat_words(lists)
    pools = np.fromiter(map(pool_of, words), np.int64, len(words))
    return Numbered(codes, word_hashes(words).view(np.int64), pools, np.fromiter(map(len, lists), np.int64, len(lists)))


def word_counts(train: DataFrame) -> DataFrame:
    """h, n over the texts, with END once for each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            x = numbered(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes), pa.array(np.bincount(x.codes, minlength=len(x.hashes)))], ["h", "n"])

    return train.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Units(NamedTuple):
    """Hashes of the words with units of their own, sorted, and their units; END is 0, pools follow the words."""

    keys: np.ndarray
    units: np.ndarray

    @property
    def first_pool(self) -> int:
        return len(self.keys)

    @property
    def size(self) -> int:
        return len(self.keys) + POOLS

    def of(self, x: Numbered) -> np.ndarray:
        """The unit of each distinct word."""
        at = place(self.keys, x.hashes)
        return np.where(at >= 0, self.units[np.maximum(at, 0)], self.first_pool + x.pools)


def unit_bigrams(train: DataFrame, units: Units) -> DataFrame:
    """a, b, n: how often unit b follows unit a; each text starts and stops at END."""
    size, sent = units.size, train.sparkSession.sparkContext.broadcast(units)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most=SLICE_BYTES):
            x = numbered(batch.column(0).to_pylist())
            ids = np.concatenate(([0], sent.value.of(x)[x.codes]))
            pairs = ids[:-1] * size + ids[1:]
            if size <= 2048:
                n = np.bincount(pairs, minlength=size * size)
                pairs = np.flatnonzero(n)
                n = n[pairs]
            else:
                pairs, n = np.unique(pairs, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pairs // size).astype(np.int32)), pa.array((pairs % size).astype(np.int32)), pa.array(n.astype(np.int64))], ["a", "b", "n"])

    return train.select("text").mapInArrow(count, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def likelihood(m: np.ndarray) -> float:
    """Of the class bigrams m, but for a constant of the words."""
    return float(_xlogx(m).sum() - _xlogx(m.sum(1)).sum() - _xlogx(m.sum(0)).sum())


def best_class(own: int, out: np.ndarray, into: np.ndarray, twice: float, m: np.ndarray) -> tuple[int, float]:
    """The class for a unit, and how much better than its own it is.

    out, into: bigram counts of the unit before and after each class's other units;
    twice: the unit after itself; m: class bigram counts with the unit in `own`.
    Class 0 is END's alone.
    """
    m = m.copy()
    m[own] -= out
    m[:, own] -= into
    m[own, own] -= twice
    rows, cols = m.sum(1) + into, m.sum(0) + out  # the other units' bigrams with this one stay, whatever its class
    gain = (_xlogx(m + out) - _xlogx(m)).sum(1) + (_xlogx(m.T + into) - _xlogx(m.T)).sum(1)
    d = np.diag(m)
    gain += _xlogx(d + out + into + twice) - _xlogx(d + out) - _xlogx(d + into) + _xlogx(d)
    gain -= _xlogx(rows + out.sum() + twice) - _xlogx(rows) + _xlogx(cols + into.sum() + twice) - _xlogx(cols)
    gain[0] = -np.inf
    to = int(np.argmax(gain))
    return to, float(gain[to] - gain[own])


def class_matrix(adjacency: DataFrame, classes: np.ndarray, k: int) -> np.ndarray:
    """Class bigram counts, k x k."""
    sent = adjacency.sparkSession.sparkContext.broadcast(classes)

    def add(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = np.zeros((k, k))
        for pdf in frames:
            for u, vs, out in zip(pdf["u"], pdf["vs"], pdf["outs"]):
                m[sent.value[u]] += np.bincount(sent.value[np.asarray(vs)], np.asarray(out, float), k)
        yield pd.DataFrame({"m": [m.tobytes()]})

    # A task gives one row of k x k numbers; there are 1 / own_share + POOLS units at most, TASK_UNITS to a task.
    m = np.zeros((k, k))
    for r in adjacency.select("u", "vs", "outs").mapInPandas(add, "m binary").collect():
        m += np.frombuffer(r.m).reshape(k, k)
    return m


def proposed_moves(adjacency: DataFrame, classes: np.ndarray, m: np.ndarray) -> list:
    """u, c, gain of the units that another class suits better, the best first.

    A task goes through its units one after the other, each against the counts that
    its own moves so far have changed; of other tasks' moves it knows nothing.
    """
    sent, k = adjacency.sparkSession.sparkContext.broadcast((classes, m)), len(m)

    def move(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, m = (x.copy() for x in sent.value)
        for pdf in frames:
            us, to, better = [], [], []
            for u, vs, outs, ins in zip(pdf["u"], pdf["vs"], pdf["outs"], pdf["ins"]):
                if u == 0:
                    continue
                vs, outs, ins = np.asarray(vs), np.asarray(outs, float), np.asarray(ins, float)
                self = vs == u
                twice, at, own = float(outs[self].sum()), now[vs[~self]], int(now[u])
                out, into = np.bincount(at, outs[~self], k), np.bincount(at, ins[~self], k)
                j, gain = best_class(own, out, into, twice, m)
                if gain > 1e-9 and j != own:
                    for c, sign in ((own, -1), (j, 1)):
                        m[c] += sign * out
                        m[:, c] += sign * into
                        m[c, c] += sign * twice
                    now[u] = j
                    us.append(u), to.append(j), better.append(gain)
            yield pd.DataFrame({"u": np.array(us, np.int32), "c": np.array(to, np.int32), "gain": np.array(better, float)})

    return sorted(adjacency.mapInPandas(move, "u int, c int, gain double").collect(), key=lambda r: (-r.gain, r.u))


def exchange(bigrams: DataFrame, size: int, k: int = CLASSES, sweeps: int = SWEEPS) -> tuple[np.ndarray, np.ndarray, list[float]]:
    """Each unit's class, the class bigram counts, and the likelihood after each step, which never falls.

    What reaches the driver: a class for each unit, k x k counts.
    """
    both = bigrams.select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("n").alias("o"), F.lit(0).cast("long").alias("i")).unionByName(
        bigrams.select(F.col("b").alias("u"), F.col("a").alias("v"), F.lit(0).cast("long").alias("o"), F.col("n").alias("i"))
    )
    entry = both.groupBy("u", "v").agg(F.sum("o").alias("o"), F.sum("i").alias("i")).groupBy("u").agg(F.sort_array(F.collect_list(F.struct("v", "o", "i"))).alias("e"))
    # A row for each unit, dealt at random, TASK_UNITS to a task: a frequent unit's row is longer, but no longer than the number of units.
    adjacency = materialize(entry.select("u", F.col("e.v").alias("vs"), F.col("e.o").alias("outs"), F.col("e.i").alias("ins")).repartition(-(-size // TASK_UNITS), F.xxhash64("u")))
    classes = np.zeros(size, np.int64)
    classes[1:] = np.arange(size - 1) % (k - 1) + 1
    m = class_matrix(adjacency, classes, k)
    reached = [likelihood(m)]
    for _ in range(sweeps):
        moves = proposed_moves(adjacency, classes, m)
        few = len(moves) < max(2, size // 200)
        while moves:
            trial = classes.copy()
            trial[[r.u for r in moves]] = [r.c for r in moves]
            then = class_matrix(adjacency, trial, k)
            if likelihood(then) >= reached[-1]:
                classes, m = trial, then
                reached.append(likelihood(m))
                break
            moves = moves[: len(moves) // 2]
        if few or not moves:
            break
    discard(adjacency)
    return classes, m, reached


def rare_words(train: DataFrame, units: Units, classes: np.ndarray, m: np.ndarray) -> DataFrame:
    """h, n, c, pool of each word without a unit of its own: its count, and the class that its bigrams suit best.

    A task sends of each word the classes before and after its occurrences, a byte
    each; rows of a word meet sorted, and are added up batch by batch.
    """
    spark, k = train.sparkSession, len(m)
    sent = spark.sparkContext.broadcast((units, classes.astype(np.uint8)))

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, classes = sent.value
        for batch in slices(batches, most=SLICE_BYTES):
            x = numbered(batch.column(0).to_pylist())
            unit = units.of(x)
            rare = unit >= units.first_pool
            path = np.concatenate(([0], classes[unit[x.codes]], [0])).astype(np.uint8)
            at = np.flatnonzero(rare[x.codes])
            at = at[np.argsort(x.codes[at], kind="stable")]
            near = np.stack([path[at], path[at + 2]], 1).reshape(-1)
            number = np.flatnonzero(rare)
            ends = np.concatenate(([0], np.cumsum(2 * np.bincount(x.codes[at], minlength=len(rare))[number]))).astype(np.int32)
            column = pa.Array.from_buffers(pa.binary(), len(number), [None, pa.py_buffer(ends), pa.py_buffer(near)])
            yield pa.RecordBatch.from_arrays([pa.array(x.hashes[number]), pa.array(x.pools[number].astype(np.int32)), column], ["h", "pool", "near"])

    log_next, log_before = np.log(m + 0.5).T, np.log(m + 0.5)  # [class after, own], [class before, own]
    suits = np.concatenate([log_before, log_next])
    free = np.log(m.sum(1) + 0.5 * k) + np.log(m.sum(0) + 0.5 * k)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(hs: np.ndarray, pools: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
            n = counts[:, :k].sum(1)
            gain = counts @ suits - n[:, None] * free
            gain[:, 0] = -np.inf
            return pa.RecordBatch.from_arrays([pa.array(hs), pa.array(n.astype(np.int64)), pa.array(gain.argmax(1).astype(np.int32)), pa.array(pools.astype(np.int32))], ["h", "n", "c", "pool"])

        last: tuple | None = None
        for batch in (b.slice(at, 8192) for b in batches for at in range(0, b.num_rows, 8192)):
            hs, pools = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            first = np.concatenate(([True], hs[1:] != hs[:-1]))
            group = np.cumsum(first) - 1
            near = batch.column(2)
            size = pc.binary_length(near).to_numpy()
            raw = np.frombuffer(b"".join(near.to_pylist()), np.uint8).astype(np.int64)
            slot = raw + k * (np.arange(len(raw)) % 2)
            counts = np.bincount(np.repeat(group, size) * 2 * k + slot, minlength=(group[-1] + 1) * 2 * k).reshape(-1, 2 * k).astype(float)
            hs, pools = hs[first], pools[first]
            if last is not None and last[0][0] == hs[0]:
                counts[0] += last[2][0]
            elif last is not None:
                yield done(*last)
            last = hs[-1:], pools[-1:], counts[-1:]
            yield done(hs[:-1], pools[:-1], counts[:-1])
        if last is not None:
            yield done(*last)

    rows = train.select("text").mapInArrow(gather, "h long, pool int, near binary")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "h").sortWithinPartitions("h").mapInArrow(choose, "h long, n long, c int, pool int")


class ClassModel:
    """Smoothed class transitions, and for each class the figures that emissions need."""

    def __init__(self, k: int, types: dict[int, tuple[int, int]], unseen: dict[int, tuple[int, int]]):
        """types: class -> tokens and types; unseen: class -> words seen once and twice whose pool falls to it."""
        self.tokens, self.discount, self.unknown = np.ones(k), np.zeros(k), np.zeros(k)
        for c in range(k):
            n, t = types.get(c, (0, 0))
            once, two = unseen.get(c, (0, 0))
            free = 1.0  # what unseen words of the class share
            if n:
                self.tokens[c] = n
                self.discount[c] = min(0.95, max(0.05, once / t)) if c else 0.0
                free = self.discount[c] * t / n
            others = max(1.0, once * (once - 1) / (2 * (two + 1)))
            self.unknown[c] = math.log10(free / others) if free else 0.0

    def set_transitions(self, m: np.ndarray) -> None:
        k = len(m)
        after, before, successors = m.sum(0), m.sum(1), (m > 0).sum(1)
        prior = (after + 1) / (after.sum() + k)
        weight = np.maximum(successors, 1)
        self.log_transition = np.log10((m + weight[:, None] * prior) / (before + weight)[:, None])

    def log_emission(self, counts: np.ndarray, classes: np.ndarray) -> np.ndarray:
        return np.log10((counts - self.discount[classes]) / self.tokens[classes])


class Trained(NamedTuple):
    """What training gives: all words' counts and classes (a table: h, n, c), figures for all tokens, and the pools' classes for unseen words."""

    words: DataFrame
    total: int
    distinct: int
    ends: int
    pool_class: np.ndarray
    model: ClassModel
    reached: list[float]
    unit_matrix: np.ndarray


def train_classes(train: DataFrame, k: int = CLASSES, sweeps: int = SWEEPS, own_share: float = OWN_SHARE) -> Trained:
    spark = train.sparkSession
    counts = materialize(word_counts(train))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    end = word_hash(END)
    ends = counts.filter(F.col("h") == end).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    # 1 / own_share of them at most.
    own = [(r.h, r.n) for r in counts.filter((F.col("n") >= own_share * total) & (F.col("n") > 0) & (F.col("h") != end)).orderBy(F.desc("n"), "h").collect()]
    discard(counts)
    hashes = np.array([end] + [h for h, _ in own], np.int64)
    order = np.argsort(hashes)
    units = Units(hashes[order], order)
    bigrams = materialize(unit_bigrams(train, units))
    classes, m, reached = exchange(bigrams, units.size, k, sweeps)
    discard(bigrams)
    frequent = spark.createDataFrame([(h, n, int(classes[i + 1]), None) for i, (h, n) in enumerate(own)] + [(end, int(ends), 0, None)] * (ends > 0), "h long, n long, c int, pool int")
    words = materialize(frequent.unionByName(rare_words(train, units, classes, m)))
    by_class = words.groupBy("c").agg(F.sum("n"), F.count("*")).collect()
    by_pool = words.filter("n <= 2 AND pool IS NOT NULL").groupBy("pool", "c").agg(F.count_if(F.col("n") == 1).alias("once"), F.count_if(F.col("n") == 2).alias("two")).collect()
    votes = np.zeros((POOLS, k))
    for r in by_pool:
        votes[r.pool, r.c] += r.once
    everywhere = max(1, int(votes.sum(0).argmax()))
    pool_class = np.where(votes.sum(1) > 0, votes.argmax(1), everywhere)
    unseen: dict[int, tuple[int, int]] = {}
    for r in by_pool:
        c = int(pool_class[r.pool])
        once, two = unseen.get(c, (0, 0))
        unseen[c] = (once + r.once, two + r.two)
    model = ClassModel(k, {r[0]: (r[1], r[2]) for r in by_class}, unseen)
    return Trained(words, int(total), int(distinct), int(ends), pool_class, model, reached, m)


def class_paths(rows: DataFrame, t: Trained, fast_share: float = FAST_SHARE) -> DataFrame:
    """ROW, doc_id, held_out, n_tokens, known, base, emission (sums over the text) and path (the class of each token, a byte each)."""
    base = math.log10(t.total + t.distinct + 1)
    end = word_hash(END)
    # 1 / fast_share of them at most, and END: 17 bytes each.
    fast = t.words.filter((F.col("n") >= fast_share * t.total) | (F.col("h") == end)).select("h", "n", "c").toArrow()
    keys = fast.column("h").to_numpy()
    order = np.argsort(keys)
    n, c = fast.column("n").to_numpy()[order], fast.column("c").to_numpy()[order].astype(np.uint8)
    sent = rows.sparkSession.sparkContext.broadcast((keys[order], n, c, t.model))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, n, c, model = sent.value
        for batch in slices(batches, most=SLICE_BYTES):
            x = numbered(batch.column(3).to_pylist())
            at = place(keys, x.hashes)
            is_end = x.hashes == end
            known = at >= 0
            count = np.where(known, n[np.maximum(at, 0)] if len(n) else 0, 0)
            cls = np.where(known, c[np.maximum(at, 0)] if len(c) else 0, 255).astype(np.uint8)
            cls[is_end] = 0
            plain = np.where(known | is_end, np.log10(count + 1.0) - base, 0.0)
            emit = np.zeros(len(count))
            word = known & ~is_end
            emit[word] = model.log_emission(count[word], cls[word])
            doc = np.repeat(np.arange(len(x.sizes)), x.sizes)
            add = lambda v: np.bincount(doc, v[x.codes], len(x.sizes))  # noqa: B023, E731
            path = cls[x.codes]
            rare = np.flatnonzero(path == 255)
            pair, slot, times = np.unique(doc[rare] * len(cls) + x.codes[rare], return_inverse=True, return_counts=True)
            of, code = pair // len(cls), pair % len(cls)
            ends = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(x.sizes))))).astype(np.int32)
            slot = (slot - ends[doc[rare]]).astype("<u4")
            raw = lambda v, to: pa.Array.from_buffers(pa.binary(), len(to) - 1, [None, pa.py_buffer(to.astype(np.int32)), pa.py_buffer(v)])
            starts = np.concatenate(([0], np.cumsum(x.sizes)))
            turns = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=len(x.sizes)))))
            flat = lambda v: pa.ListArray.from_arrays(ends, pa.array(v))  # noqa: B023, E731
            columns = [*batch.columns[:3], pa.array(x.sizes), pa.array(add(known.astype(float)).astype(np.int64)), pa.array(add(plain)), pa.array(add(emit)), raw(path, starts), raw(slot, 4 * turns),
                       flat(x.hashes[code]), flat(x.pools[code].astype(np.int32)), flat(times.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, [ROW, "doc_id", "held_out", "n_tokens", "known", "base", "emission", "path", "slots", "hs", "pools", "times"])

    sums = f"{ROW} long, doc_id long, held_out boolean, n_tokens long, known long, base double, emission double"
    near = materialize(rows.mapInArrow(local, f"{sums}, path binary, slots binary, hs array<long>, pools array<int>, times array<int>"))
    one = near.select(ROW, F.posexplode(F.arrays_zip("hs", "pools", "times")).alias("slot", "e")).select(ROW, "slot", F.col("e.hs").alias("h"), F.col("e.pools").alias("pool"), F.col("e.times").alias("times"))
    joined = one.join(t.words.filter(F.col("n") < fast_share * t.total).select("h", "n", "c"), "h", "left")
    lit = lambda xs: F.array(*[F.lit(x) for x in xs])
    times, n_col = F.col("times"), F.col("n")
    c_col = F.coalesce("c", F.get(lit([int(x) for x in t.pool_class]), F.col("pool")))
    of = lambda xs: F.get(lit([float(x) for x in xs]), F.col("c"))
    priced = joined.select(ROW, "slot", c_col.alias("c"), "n", "times").select(
        ROW, F.col("slot") * 256 + F.col("c"),
        F.when(n_col.isNull(), 0).otherwise(times),
        times * (F.log10(F.coalesce(n_col, F.lit(0)) + F.lit(1.0)) - F.lit(base)),
        times * F.when(n_col.isNull(), of(t.model.unknown)).otherwise(F.log10((n_col - of(t.model.discount)) / of(t.model.tokens))),
    ).toDF(ROW, "at", "known", "base", "emission")
    # Gathers the rare words of one text.
    far = priced.groupBy(ROW).agg(F.sum("known").alias("known_2"), F.sum("base").alias("base_2"), F.sum("emission").alias("emission_2"), F.collect_list("at").alias("at"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(at, 512) for b in batches for at in range(0, b.num_rows, 512)):
            paths = []
            for path, slots, at in zip(*(batch.column(i).to_pylist() for i in (7, 8, 9))):
                if at:
                    at = np.array(at, np.int64)
                    cls = np.zeros(len(at), np.uint8)
                    cls[at >> 8] = at & 255
                    path = np.frombuffer(path, np.uint8).copy()
                    path[path == 255] = cls[np.frombuffer(slots, "<u4")]
                    path = path.tobytes()
                paths.append(path)
            yield pa.RecordBatch.from_arrays([*batch.columns[:7], pa.array(paths, pa.binary())], [ROW, "doc_id", "held_out", "n_tokens", "known", "base", "emission", "path"])

    both = near.drop("hs", "pools", "times").join(far, ROW, "left")
    plus = lambda x: (F.col(x) + F.coalesce(f"{x}_2", F.lit(0))).alias(x)
    return materialize(both.select(ROW, "doc_id", "held_out", "n_tokens", plus("known").cast("long"), plus("base"), plus("emission"), "path", "slots", "at").mapInArrow(fill, f"{sums}, path binary"))


def transitions(paths: DataFrame, k: int) -> np.ndarray:
    """Class bigram counts of the training texts, k x k; each starts at END."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros(k * k, np.int64)
        for batch in batches:
            for path in batch.column(0):
                p = np.frombuffer(path.as_buffer(), np.uint8).astype(np.int64)
                m += np.bincount(np.concatenate(([0], p[:-1])) * k + p, minlength=k * k)
        at = np.flatnonzero(m)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(m[at])], ["at", "n"])

    m = np.zeros(k * k)
    for r in paths.filter(~F.col("held_out")).select("path").mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect():
        m[r["at"]] = r["n"]
    return m.reshape(k, k)


def score_documents(docs: DataFrame, k: int = CLASSES, sweeps: int = SWEEPS, own_share: float = OWN_SHARE, fast_share: float = FAST_SHARE) -> DataFrame:
    """One row per row of docs (doc_id, text): what the model, trained on rows that are not held out, says of it.

    Null texts count as empty: one END token. Repeated rows count and are scored
    each. An empty table gives no rows; if nothing is left to train on, every word
    is unknown. k is at most 255.
    """
    rows = split_rows(docs)
    trained = train_classes(rows.filter(~F.col("held_out")).select("text"), k, sweeps, own_share)
    paths = class_paths(rows, trained, fast_share)
    model = trained.model
    model.set_transitions(transitions(paths, k))
    sent = docs.sparkSession.sparkContext.broadcast(model.log_transition)
    columns = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = batch.column(6).to_numpy().copy()
            for i, path in enumerate(batch.column(7)):
                p = np.frombuffer(path.as_buffer(), np.uint8)
                score[i] += sent.value[np.concatenate(([0], p[:-1])), p].sum()
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], pa.array(score)], columns)

    out = paths.select("doc_id", "held_out", "n_tokens", "known", F.lit(trained.total).cast("long"), "base", "emission", "path")
    scored = out.mapInArrow(add, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
