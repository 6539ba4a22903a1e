"""Quality classifier: an interpolated modified Kneser-Ney trigram model of trusted text.

The model is fitted on every other trusted row (labels: quality 1, not toxic), over
all words of those rows; the rest of the trusted rows calibrates. A word's number is
a hash that carries its shape, and an n-gram's key a hash of its words' numbers, so
there is no list of words: counts and continuation counts are tables keyed by word
numbers, and neither they nor the weights pass the driver whole. A word that the
fitted rows lack is an unknown event, one for each shape.

The log probability of a text is a sum over its n-grams of all three orders: a
unigram weighs its own log probability, less an unknown word's, and the back-off
of its bigrams; a bigram or trigram weighs what its own probability is above that
of backing off, and the back-off of what follows it. An n-gram that the model
lacks weighs nothing, so each n-gram of a document is looked up by one key: the
frequent ones where the text is read, the others by a join of packed shards
(ngrams). Two bitmaps of fixed size keep most n-grams that the model lacks out of
the join, while the model has fewer n-grams than they have bits; those they let
through find no row there. Most n-grams of the model are of one place in one
fitted row. Their weights go to that row straight from the model, and fitted rows
do not look them up.

A second model of the same kind reads the text's form: its symbols are the 53 most
frequent tokens and the shapes of all others, and its table of all trigrams is of
fixed size. It alone has a lower bound, as the model of words knows copies of
its own rows by heart.

A document's scores are its mean negative log10 probabilities, each drawn to its
language's mean by PRIOR tokens' weight. Documents beyond their language's
quantiles among trusted rows, with a margin, are rejected: far above, by words or
by form, is text unlike trusted text; far below, by form, repeats itself.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, ROW, cleaning, discard, keyed, materialize, place, settled, slices, without
from .ngrams import (
    COLUMNS, ENTRY, FAST, HELD, PACKED, SCHEMA, SHAPE_BITS, SHARD_TOKENS, WEIGHT, by_row, chained, count_trigrams, count_words, cuts, kept, look_up, pack, parts_of, shard_of, shards, starts, trigram_keys, unfixed, union, unpack, weigh
)
from .words import AGAIN, Layout, Words, shape

#: Symbols of the model of forms; its n-gram codes have BITS for each.
SYMBOLS, BITS = 64, 6
LOW, HIGH = 0.005, 0.995
#: Distance beyond the quantiles, in log10 a token, that a document may have.
MARGIN = 0.05
PRIOR = 30
#: Bytes of text whose n-grams are looked up together.
SLICE_BYTES = 1 << 20
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Fixed symbols, in the order of their numbers: the edge of a text, shapes, and a token equal to the one before.
SHAPES = ("edge", "number", "upper", "title", "short", "middle", "long", "mixed", "sign", "signs", "again")
#: Most n-grams that travel with the tasks, the most frequent ones, 16 bytes each.
FAST_NGRAMS = 1_200_000
#: Most bits of each of two bitmaps of the model's n-grams, 2 to this power (16 MB), and of the one that fitted rows use (4 MB). Fewer n-grams have some 16 bits each.
MAP_BITS, OWN_MAP_BITS = 27, 25
#: The documents are looked up in so many rounds at most.
ROUNDS = 3
#: The most frequent n-grams are found by their highest bits, so many at most.
INDEX_BITS = 21
#: Bits of a piece of a bitmap, as Spark's bitmap functions make it: 2 to this power.
PIECE_BITS = 15
PIECES = "which int, piece long, bits binary"
#: Distinct tokens that a task counts before it sends the counts on.
COUNTED = 200_000


def tokens(text: str | None) -> list[str]:
    return TOKEN.findall(text or "")


class Symbols:
    """The symbols of tokens: a word's place in the list, after the shapes, and any other token's shape."""

    def __init__(self, words: list[str]):
        numbers = Words().numbers(words)
        order = np.argsort(numbers)
        self.keys, self.values = numbers[order], np.append(order + len(SHAPES), 0)

    def of(self, numbers: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        at = place(self.keys, numbers)
        return np.where(at < 0, shapes, self.values[at])


def trusted_labels(labels: DataFrame) -> DataFrame:
    """doc_id, fit: the trusted ids; conflicting or null labels are not trusted. Odd hashes calibrate, even ones fit."""
    good = labels.groupBy("doc_id").agg(F.min(F.coalesce("quality", F.lit(0))).alias("q"), F.max(F.coalesce("toxic", F.lit(1))).alias("t"))
    return good.filter("q >= 1 AND t = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), (F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0).alias("fit"))


def frequent_words(fitted: DataFrame, most: int) -> list[str]:
    """The `most` most frequent tokens of the fitted rows, ties in their order."""

    def batch_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in slices(batches):
            for text in batch.column(0):
                seen.update(tokens(text.as_py()))
            if len(seen) > COUNTED:
                yield batch_of(seen)
                seen = Counter()
        yield batch_of(seen)

    found = fitted.select("text").mapInArrow(count, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    return [r.token for r in found.orderBy(F.desc("n"), "token").limit(most).collect()]


def form_counts(fitted: DataFrame, symbols: Symbols) -> np.ndarray:
    """How often each trigram of symbols is in the fitted rows: SYMBOLS ** 3 numbers, however many rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, words = np.zeros(SYMBOLS**3, np.int64), Words()
        for batch in slices(batches):
            total += np.bincount(words.of_texts(batch.column(0).to_pylist()).symbols(symbols.of, BITS), minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["gram", "n"])

    found = fitted.select("text").mapInArrow(count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(SYMBOLS**3, np.int64)
    out[found.column("gram").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(SYMBOLS, SYMBOLS, SYMBOLS)


def form_table(counts: np.ndarray) -> np.ndarray:
    """The negative log10 probability of each trigram code, from the counts of all trigrams (first, second, last symbol)."""

    def parts(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each context: the discounted share of each symbol, and what is left for the lower order."""
        d = np.array([0.0, *cuts([int((n == k).sum()) for k in (1, 2, 3, 4)])])[np.minimum(n, 3)]
        total = n.sum(-1, keepdims=True)
        back = np.where(total > 0, d.sum(-1, keepdims=True) / np.maximum(total, 1), 1.0)
        return (n - d) / np.maximum(total, 1), back

    pairs = (counts > 0).sum(0)
    p: np.ndarray | float = 1 / SYMBOLS
    for n in ((pairs > 0).sum(0), pairs, counts):
        own, back = parts(n)
        p = own + back * p
    return -np.log10(p).reshape(-1)


def streams(texts: list[list[str]], words: Words, layout: Layout | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the texts one after the other, each as two BEGINs, its tokens and END: numbers, keys of the bigrams and trigrams that end there, number of the text, place in it."""
    layout = layout or words.of_tokens(texts)
    ids, one = layout.numbers(), chained(42, layout.vocabulary)[layout.codes]
    two = chained(np.concatenate((one[:1], one[:-1])), ids)
    return ids, two, chained(np.concatenate((two[:1], two[:-1])), ids), layout.doc, layout.at


def fitted_streams(fitted: DataFrame) -> DataFrame:
    """ROW, ids (the word numbers of the text, in binary)."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in slices(batches):
            layout = words.of_texts(batch.column(1).to_pylist())
            ids = np.split(layout.numbers(), layout.end[:-1] + 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in ids], pa.binary())], [ROW, "ids"])

    return materialize(fitted.select(ROW, "text").mapInArrow(number, f"{ROW} long, ids binary"), compression="zstd")


def key_places(keys: np.ndarray, bits: int) -> np.ndarray:
    """The place of each key in a bitmap: its highest bits."""
    return (keys.view(np.uint64) >> np.uint64(64 - bits)).astype(np.int64)


def map_bits(count: int, most: int) -> int:
    """Bits of a bitmap of so many keys, as a power of 2: some 16 a key."""
    return max(PIECE_BITS, min(most, (16 * count).bit_length()))


def pieces(which: int, keys: np.ndarray, bits: int) -> pa.RecordBatch:
    """The pieces of a bitmap that have places of the keys, which lie near each other."""
    at = key_places(keys, bits)
    low, high = (int(at.min()) >> PIECE_BITS, int(at.max()) >> PIECE_BITS) if len(at) else (0, -1)
    flags = np.zeros((high - low + 1) << PIECE_BITS, bool)
    flags[at - (low << PIECE_BITS)] = True
    made = np.packbits(flags, bitorder="little").reshape(-1, 1 << (PIECE_BITS - 3))
    some = np.flatnonzero(made.any(1))
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), which, np.int32)), pa.array(some + low), pa.array([made[i].tobytes() for i in some], pa.binary())], ["which", "piece", "bits"])


def bitmaps(found: DataFrame, bits: list[int]) -> list[np.ndarray]:
    """Bitmaps as bytes, from their pieces; tasks set the bits and only the bitmaps come to the driver."""
    out = [np.zeros((1 << (b - PIECE_BITS), 1 << (PIECE_BITS - 3)), np.uint8) for b in bits]
    with cleaning(found.sparkSession):
        whole = found.groupBy("which", "piece").agg(F.bitmap_or_agg("bits").alias("bits")).toArrow()
    for batch in whole.to_batches():
        for which, piece, made in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            out[which][piece] = np.frombuffer(made.as_buffer(), np.uint8)
    return [x.reshape(-1) for x in out]


def key_bitmap(keys: DataFrame, most: int) -> np.ndarray:
    """A bitmap of up to 2 ** most bits in which the places of all keys are set."""
    bits = map_bits(keys.count(), most)

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pieces(0, batch.column(0).to_numpy(), bits)

    return bitmaps(keys.select("key").mapInArrow(made, PIECES), [bits])[0]


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = key_places(keys, len(bitmap).bit_length() + 2)
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)


def scattered(keys: np.ndarray) -> np.ndarray:
    return keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def mixed(keys: np.ndarray) -> np.ndarray:
    """Keys with other places in a bitmap, near their own: the first 12 bits stay, so that a shard's keys are in few pieces."""
    top = np.uint64(52)
    return (keys.view(np.uint64) >> top << top | scattered(keys) >> np.uint64(12)).view(np.int64)


class Tables:
    """The most frequent n-grams and three bitmaps as tasks look documents up in them; travels compressed."""

    def __init__(self, fast: list[tuple[int, int, bytes]], maps: list[np.ndarray]):
        self.fast = fast
        self.maps = [(pa.compress(m.tobytes(), codec="zstd", asbytes=True), len(m)) for m in maps]
        self.opened = False

    def open(self) -> Tables:
        """Unpacks the tables, once a worker."""
        if not self.opened:
            _, key, weight, single = unpack(FAST, self.fast)
            order = np.argsort(key.view(np.uint64))
            self.key, self.weight, self.single = key[order], unfixed(weight)[order], single[order]
            self.bits = min(INDEX_BITS, len(key).bit_length() + 1)
            self.index = np.concatenate(([0], np.cumsum(np.bincount(key_places(self.key, self.bits), minlength=1 << self.bits)))).astype(np.int32)
            self.every, self.other, self.own = (np.frombuffer(pa.decompress(m, size, codec="zstd", asbytes=True), np.uint8) for m, size in self.maps)
            self.fast, self.maps, self.opened = [], [], True
        return self

    def may(self, keys: np.ndarray) -> np.ndarray:
        """The places of the keys that may be in the model."""
        at = np.flatnonzero(in_bitmap(self.every, keys))
        return at[in_bitmap(self.other, mixed(keys[at]))]

    def spots(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key among the most frequent n-grams, -1 if it is not there."""
        out = np.full(len(wanted), -1)
        bucket = key_places(wanted, self.bits)
        at, end = self.index[bucket], self.index[bucket + 1]
        live = np.flatnonzero(at < end)
        at, end = at[live], end[live]
        while len(live):
            hit = self.key[at] == wanted[live]
            out[live[hit]] = at[hit]
            more = ~hit & (at + 1 < end)
            live, at, end = live[more], at[more] + 1, end[more]
        return out


class Lookups:
    """What tasks look documents up in: the most frequent n-grams with their weights, about `most` of them, and bitmaps of all n-grams and of those that fitted rows look up."""

    def __init__(self, weights: list[DataFrame], most: int):
        table = union(weights).filter(F.col("kind") == WEIGHT)

        def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, kinds in shards(batches):
                n, k = np.unique(unpack(WEIGHT, kinds[WEIGHT])[-1], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(n.astype(np.int64)), pa.array(k)], ["n", "k"])

        found = table.mapInArrow(sizes, "n long, k long").groupBy("n").agg(F.sum("k").alias("k")).orderBy(F.desc("n")).collect()  # a row for each count
        left, bound, share = most, 0, 1.0
        for r in found:
            if r.k > left:
                bound, share = r.n, left / r.k
                break
            left -= r.k
        count = sum(r.k for r in found)

        def is_fast(key: np.ndarray, n: np.ndarray) -> np.ndarray:
            # A hash chooses among those as frequent as the last.
            return (n > bound) | ((n == bound) & (scattered(key) >> np.uint64(44) < share * (1 << 20)))

        def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, kinds in shards(batches):
                _, key, weight, n = unpack(WEIGHT, kinds[WEIGHT])
                own = is_fast(key, n)
                yield pack(FAST, np.full(own.sum(), shard), key[own], weight[own], n[own] == 1)

        single = sum(r.k for r in found if r.n == 1)
        bits = [map_bits(count, MAP_BITS), map_bits(count, MAP_BITS), map_bits(count - single, OWN_MAP_BITS)]

        def mapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for _, kinds in shards(batches):
                _, key, _, n = unpack(WEIGHT, kinds[WEIGHT])
                for which, keys in enumerate((key, mixed(key), key[n > 1])):
                    yield pieces(which, keys, bits[which])

        fast = [(0, r.size, bytes(r.data)) for r in table.mapInArrow(chosen, PACKED).select("size", "data").collect()]
        maps = bitmaps(table.mapInArrow(mapped, PIECES), bits)
        self.tables = table.sparkSession.sparkContext.broadcast(Tables(fast, maps))
        del fast, maps
        pa.default_memory_pool().release_unused()


def document_grams(rows: DataFrame, lookups: Lookups, scoring: Broadcast, bits: int) -> DataFrame:
    """Of rows (ROW, fit, text) one row each with n_tokens, form (negative log10 probability by form) and near (log10 probability by unknown words and frequent n-grams), and as packed ENTRY rows the other n-grams that may be in the model.

    Rows with fit are not looked up for n-grams of one place: those are their own.
    scoring: log10 probabilities of unknown words by shape, the table of forms and its symbols.
    """
    broadcast = lookups.tables

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value.open()
        unknown, table, symbols = scoring.value
        words = Words()
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def entries() -> pa.RecordBatch:
            key, row, times, fit = (np.concatenate(x) for x in zip(*held))
            low = row & ((1 << 32) - 1)
            packed = pack(ENTRY, shard_of(key, bits), key, low, times, fit, base=row - low)
            none = [pa.nulls(packed.num_rows, t) for t in (pa.int64(), pa.int64(), pa.float64(), pa.float64())]
            return pa.RecordBatch.from_arrays([*none, *packed.columns], names)

        names = [ROW, "n_tokens", "form", "near", *COLUMNS]
        for batch in slices(batches, most=SLICE_BYTES):
            row, fit = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            layout, docs = words.of_texts(batch.column(2).to_pylist()), batch.num_rows
            ids, two, three, doc, at = streams([], words, layout)
            later, last = np.flatnonzero(at > 0), np.flatnonzero(at > 1)
            form = np.bincount(doc[last], table[layout.symbols(symbols.of, BITS)], docs)
            # Single words are looked up once for all their places.
            every, code, of = layout.vocabulary, layout.codes[later], doc[later]
            near = np.bincount(doc[last], unknown[every & ((1 << SHAPE_BITS) - 1)][layout.codes[last]], docs)
            spot = np.full(len(every), -1)
            may = model.may(every)
            spot[may] = model.spots(every[may])
            known, asked = spot >= 0, np.zeros(len(every), bool)
            asked[may] = spot[may] < 0
            weight, single = np.zeros(len(every)), np.zeros(len(every), bool)
            weight[known], single[known] = model.weight[spot[known]], model.single[spot[known]]
            near += np.bincount(of, weight[code] * ~(fit[of] & single[code]), docs)
            asked = asked[code] & ~(fit[of] & ~in_bitmap(model.own, every)[code])
            words_key, words_of = every[code[asked]], of[asked]
            # Two and three words.
            key, of = np.concatenate((two[later], trigram_keys(two[last], three[last], bits))), np.concatenate((of, doc[last]))
            may = model.may(key)
            key, of = key[may], of[may]
            own = np.flatnonzero(fit[of])
            gone = np.zeros(len(key), bool)
            gone[own] = ~in_bitmap(model.own, key[own])
            key, of = key[~gone], of[~gone]
            spot = model.spots(key)
            known = spot >= 0
            near += np.bincount(of[known], model.weight[spot[known]] * ~(fit[of[known]] & model.single[spot[known]]), docs)
            key, of = np.concatenate((words_key, key[~known])), np.concatenate((words_of, of[~known]))
            order = np.lexsort((key, of))
            key, of = key[order], of[order]
            first = starts(of, key)
            n = np.diff(np.append(first, len(key)))
            held.append((key[first], row[of[first]], n, fit[of[first]]))
            size += len(first)
            none = [pa.nulls(docs, t) for t in SCHEMA.types]
            yield pa.RecordBatch.from_arrays([pa.array(row), pa.array(layout.tokens_of), pa.array(form), pa.array(near), *none], names)
            if size > HELD:
                yield entries()
                held, size = [], 0
        if held:
            yield entries()

    return rows.mapInArrow(grams, f"{ROW} long, n_tokens long, form double, near double, {PACKED}")


def quality(docs: DataFrame, labels: DataFrame, low: float = LOW, high: float = HIGH, margin: float = MARGIN) -> DataFrame:
    """ROW, doc_id, lang, n_tokens, nll, perplexity, score, highest, form_score, form_lowest, form_highest, rejected for each row of docs (doc_id, text, lang).

    Null and empty texts have no tokens; they are scored by the end alone, drawn to
    the mean, and stay. A language without trusted rows, null too, takes the
    quantiles of all languages. Without any trusted row nothing is rejected.
    Repeated rows are scored each; an empty table gives no rows.
    """
    trusted = materialize(trusted_labels(labels))
    ids = trusted.filter("fit").select("doc_id")
    few = ids.count() <= BROADCAST_ROWS
    rows = keyed(docs, F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    fitted = materialize(rows.select(ROW, "doc_id", "text").join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").select(ROW, "text"))
    symbols = Symbols(frequent_words(fitted, SYMBOLS - len(SHAPES)))
    table = form_table(form_counts(fitted, symbols))
    streamed = fitted_streams(fitted)
    discard(fitted)
    n_tokens = streamed.agg(F.coalesce(F.sum(F.length("ids")), F.lit(0))).first()[0] // 8
    bits = max(3, (n_tokens // SHARD_TOKENS).bit_length())
    counted = count_trigrams(streamed, bits)
    discard(streamed)
    words, stats = count_words(counted, bits)
    weights, own, unknown = weigh(counted, words, stats, bits, len(SHAPES))
    if few:
        marked = rows.join(F.broadcast(ids.withColumn("fit", F.lit(True))), "doc_id", "left").select(ROW, F.coalesce("fit", F.lit(False)).alias("fit"), "text")
    else:
        # Texts would be shuffled to be told from others, so fitted rows are looked up as all rows are.
        marked = rows.select(ROW, F.lit(False).alias("fit"), "text")
    lookups = Lookups(weights, FAST_NGRAMS)
    scoring = docs.sparkSession.sparkContext.broadcast((unknown, table, symbols))
    held, sums = [], own if few else []
    # The documents are looked up in rounds, and in each by parts of the model, one after the other, so that a share alone of the entries is kept, and a part of both sides shuffled, at a time.
    rounds = parts_of(bits, ROUNDS)
    for turn in range(rounds):
        scanned = kept(document_grams(marked.filter(F.pmod(F.col(ROW), F.lit(rounds)) == turn), lookups, scoring, bits))
        held.append(materialize(scanned.filter(F.col(ROW).isNotNull()).select(ROW, "n_tokens", "form", "near")))
        entries = scanned.filter(F.col("kind").isNotNull()).select(*COLUMNS)
        far = [kept(look_up(entries.filter(F.col("shard") % len(weights) == part), w.filter(F.col("kind") == WEIGHT), bits)) for part, w in enumerate(weights)]
        discard(scanned)
        sums.append(materialize(by_row(far, bits)))
        for done in far:
            discard(done)
    for done in weights:
        discard(done)
    lookups.tables.unpersist()
    scoring.unpersist()
    del lookups, scoring
    summed = union(sums).groupBy(ROW).agg(F.sum("far").alias("far"))
    found, held = held, union(held).join(rows.select(ROW, "doc_id", "lang"), ROW)
    total = -(F.col("near") + F.coalesce("far", F.lit(0.0)))
    scored = materialize(held.join(summed, ROW, "left").select(ROW, "doc_id", "lang", "n_tokens", "form", total.alias("total")))
    for done in (*found, *own, *sums):
        discard(done)
    size = F.col("n_tokens") + 1
    check = scored.join(trusted.filter(~F.col("fit")), "doc_id", "left_semi")
    # Hot languages are summed before they are dealt; there are as many rows as languages, one for all of them with a null key.
    means = check.groupBy("lang").agg(F.avg(F.col("total") / size).alias("total"), F.avg(F.col("form") / size).alias("form"), F.count("*").alias("n")).collect()

    def drawn(name: str) -> Column:
        everything = sum(r[name] * r["n"] for r in means) / max(1, sum(r["n"] for r in means))
        mean = _lookup({r["lang"]: r[name] for r in means if r["lang"] is not None}, F.col("lang"), float(everything))
        return (F.col(name) + PRIOR * mean) / (size + PRIOR)

    scored = scored.select(ROW, "doc_id", "lang", "n_tokens", (F.col("total") / size).alias("nll"), drawn("total").alias("score"), drawn("form").alias("form_score"))
    # Rows that the models were fitted on score lower than others like them, so they count for the lower bound only.
    known = scored.join(trusted, "doc_id")
    new = lambda x: F.when(~F.col("fit"), F.col(x))
    ends = [F.percentile_approx(new("score"), high, 100_000).alias("highest"), F.percentile_approx("form_score", low, 100_000).alias("form_lowest"), F.percentile_approx(new("form_score"), high, 100_000).alias("form_highest")]
    bounds = {r["lang"]: r for r in known.groupBy("lang").agg(*ends).collect() if r["lang"] is not None}
    whole = known.agg(*ends).first()

    def bound(name: str, room: float, none: float) -> Column:
        return _lookup({k: r[name] + room for k, r in bounds.items() if r[name] is not None}, F.col("lang"), (none if whole[name] is None else whole[name]) + room)

    highest, form_lowest, form_highest = bound("highest", margin, 1e9), bound("form_lowest", -margin, -1e9), bound("form_highest", margin, 1e9)
    return scored.select(
        ROW, "doc_id", "lang", "n_tokens", "nll", F.pow(F.lit(10.0), "nll").alias("perplexity"), "score", highest.alias("highest"),
        "form_score", form_lowest.alias("form_lowest"), form_highest.alias("form_highest"),
        ((F.col("score") > highest) | (F.col("form_score") < form_lowest) | (F.col("form_score") > form_highest)).alias("rejected"),
    )


def _lookup(values: dict[str, float], key: Column, default: float) -> Column:
    if not values:
        return F.lit(default)
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    return F.coalesce(F.try_element_at(table, key), F.lit(default))


def drop_rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs, whatever its columns, without the rows that the classifier rejects."""
    docs = settled(docs)
    return without(docs, quality(docs, labels).filter("rejected"))
