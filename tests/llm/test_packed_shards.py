"""The quality model's packed shards and its tokens from arrays of code points."""

import random

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from quillmart.llm import kneser_ney, ngrams  # noqa: E402


def unpacked(kind, batch):
    return ngrams.unpack(kind, [r[2:] for r in zip(*(c.to_pylist() for c in batch.columns))])


def test_packed_rows_are_small_and_come_back_whole():
    rng = np.random.default_rng(3)
    n, bits = 50_000, 3
    key = rng.integers(-(1 << 63), 1 << 63, n)
    weight, times = ngrams.fixed(rng.normal(0, 2, n)), np.minimum(rng.zipf(3, n), 9)
    batch = ngrams.pack(ngrams.WEIGHT, ngrams.shard_of(key, bits), key, weight, times)
    # 17 bytes each as they are.
    assert batch.num_rows == 8 and batch.nbytes < 13 * n
    _, *got = unpacked(ngrams.WEIGHT, batch)
    order = np.argsort(key.view(np.uint64))
    assert (got[0] == key[order]).all() and (ngrams.unfixed(got[1]) == ngrams.unfixed(weight[order])).all() and (got[2] == times[order]).all()
    # Entries of few rows of a task, which are told by a base.
    row = np.where(key % 2 == 0, 5 << 33, 1 << 33) + key % 300
    base = row >> 33 << 33
    batch = ngrams.pack(ngrams.ENTRY, ngrams.shard_of(key, bits), key, row - base, times, times > 1, base=base)
    assert batch.num_rows == 16 and batch.nbytes < 11 * n
    base, got_key, got_row, got_times, fit = unpacked(ngrams.ENTRY, batch)
    assert sorted(zip(got_key.tolist(), (base + got_row).tolist(), got_times.tolist(), fit.tolist())) == sorted(zip(key.tolist(), row.tolist(), times.tolist(), (times > 1).tolist()))
    assert all(len(c) == 0 for c in ngrams.unpack(ngrams.FIGURES, []))


def test_both_places_of_a_shards_keys_are_in_its_part_of_a_bitmap():
    key = np.random.default_rng(4).integers(-(1 << 63), 1 << 63, 40_000)
    for keys in (key, kneser_ney.mixed(key)):
        assert (kneser_ney.key_places(keys, 27) >> 15 == kneser_ney.key_places(key, 12)).all()
    assert len(np.unique(kneser_ney.key_places(kneser_ney.mixed(key), 27))) > 39_000


def test_tokens_from_code_points_are_those_of_the_pattern():
    from quillmart.llm import words as w

    rng, words = random.Random(1), w.Words()
    odd = [chr(c) for c in (*range(0x600), 0x661, *range(0x1F80, 0x1FF0), 0x2028, 0x2160, 0x2170, 0x3000, 0x4E00, 0xFB01, 0x1D400, 0x1F600)]
    texts = ["".join(rng.choice(odd if rng.random() < 0.5 else list("aB 1_-éß ")) for _ in range(rng.randint(0, 200))) for _ in range(400)]
    texts += [None, "", "a" * 64 + " " + "a" * 65 + " " + "A" + "b" * 70_000, "1" * 5000, "ab ab ab", "ab"]
    lists = [kneser_ney.tokens(t) for t in texts]
    layout = words.of_texts(texts)
    assert layout.tokens_of.tolist() == [len(x) for x in lists]
    flat, numbers = [t for x in lists for t in x], layout.distinct[layout.of].tolist()
    number = dict(zip(flat, numbers))
    assert [number[t] for t in flat] == numbers and len(set(numbers)) == len(number)
    assert all(n & 15 == kneser_ney.shape(t) for t, n in number.items())
    # The same in other company, and from tokens.
    assert (w.Words().of_texts(texts[::-1]).numbers()[-len(lists[0]) - 3 :] == layout.numbers()[: len(lists[0]) + 3]).all()
    assert (words.of_tokens(lists).numbers() == layout.numbers()).all()
    assert int(layout.again.sum()) == sum(a == b for x in lists for a, b in zip(x, x[1:]))
