"""Tokens of texts and their numbers, told from arrays of code points.

The texts of a slice are one array of code points; a table tells each one's kind,
so that the tokens of `\\w+|[^\\w\\s]+` lie where kinds change, and a token's hash is
a difference of running sums. No text is cut into strings.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from xxhash import xxh64_intdigest

from .common import raw_bytes
from .ngrams import BEGIN, END, SHAPE_BITS, chained

#: The shape of a token equal to the one before, and the number of such a token.
AGAIN = 10
REPEAT = 3 << SHAPE_BITS | AGAIN
#: Code points of a token beyond which it is hashed and shaped as a string.
LONG = 64
#: An odd number, whose powers weigh the code points of a token, and its inverse.
FACTOR = 0x9E3779B97F4A7C15
INVERSE = pow(FACTOR, -1, 1 << 64)
SPACE, WORD_CHAR, SIGN = range(3)
#: Fields of a code point's traits, 12 bits each: letters, lower, upper and title case, digits.
FIELD = 12
ALPHA, LOWER, UPPER, TITLE, DIGIT = range(5)


def shape(token: str) -> int:
    """The number of the shape of a token that is not in the vocabulary."""
    if token.isalpha():
        if token.islower():
            return 4 if len(token) < 5 else 5 if len(token) < 9 else 6
        return 3 if token[1:].islower() or len(token) == 1 else 2 if token.isupper() else 7
    if token[0].isalnum() or token[0] == "_":
        return 1 if token.isdigit() else 7
    return 8 if len(token) == 1 else 9


def traits(c: str) -> tuple[int, int]:
    """Kind and traits of a code point."""
    kind = SPACE if c.isspace() else WORD_CHAR if c.isalnum() or c == "_" else SIGN
    found = (c.isalpha(), c.islower(), c.isupper(), c.istitle() and not c.isupper(), c.isdigit())
    return kind, sum(x << FIELD * i for i, x in enumerate(found))


class Words:
    """Numbers tokens: a hash whose low bits are the token's shape. Holds the traits of the code points met, in blocks of 256, and powers."""

    def __init__(self):
        self.kinds, self.traits = np.zeros(0x110000, np.uint8), np.zeros(0x110000, np.int64)
        self.met = np.zeros(0x1100, bool)
        self.powers = self.inverses = np.ones(1, np.uint64)

    def meet(self, chars: np.ndarray) -> None:
        """Has the traits of all blocks of the code points, and a power for each."""
        for block in np.flatnonzero((np.bincount(chars >> 8, minlength=len(self.met)) > 0) & ~self.met):
            for c in range(block << 8, (block + 1) << 8):
                self.kinds[c], self.traits[c] = traits(chr(c))
            self.met[block] = True
        if len(self.powers) <= len(chars):
            size = max(1 << 16, len(chars) + len(chars) // 4)
            self.powers, self.inverses = (np.concatenate((np.ones(1, np.uint64), np.multiply.accumulate(np.full(size, x, np.uint64)))) for x in (FACTOR, INVERSE))

    def of_texts(self, texts: list[str | None]) -> Layout:
        """The tokens of `\\w+|[^\\w\\s]+`; null has none."""
        sizes = np.array([len(x or "") + 1 for x in texts], np.int64)
        chars = np.frombuffer("".join(x + "\n" if x else "\n" for x in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.meet(chars)
        kind = np.concatenate(([np.uint8(SPACE)], self.kinds[chars], [np.uint8(SPACE)]))
        differs, token = kind[1:] != kind[:-1], kind != SPACE
        start, end = np.flatnonzero(differs & token[1:]), np.flatnonzero(differs & token[:-1])
        return Layout(self, chars, start, end, np.diff(np.searchsorted(start, np.concatenate(([0], np.cumsum(sizes))))))

    def of_tokens(self, texts: list[list[str]]) -> Layout:
        sizes = np.array([len(t) for x in texts for t in x], np.int64)
        chars = np.frombuffer("".join(t for x in texts for t in x).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.meet(chars)
        end = np.cumsum(sizes)
        return Layout(self, chars, end - sizes, end, np.array([len(x) for x in texts], np.int64))

    def numbers(self, tokens: list[str]) -> np.ndarray:
        layout = self.of_tokens([tokens])
        return layout.distinct[layout.of]


class Layout:
    """The tokens of texts one after the other, each text as two edges, its tokens and an edge."""

    def __init__(self, words: Words, chars: np.ndarray, start: np.ndarray, end: np.ndarray, n: np.ndarray):
        import pandas as pd

        sums = np.concatenate(([np.uint64(0)], np.cumsum((chars + np.uint32(1)) * words.powers[: len(chars)], dtype=np.uint64)))
        hashes = chained(42, ((sums[end] - sums[start]) * words.inverses[start]).view(np.int64))
        text = lambda i: chars[start[i] : end[i]].tobytes().decode("utf-32-le", "surrogatepass")
        for i in np.flatnonzero(end - start > LONG):
            hashes[i] = np.uint64(xxh64_intdigest(raw_bytes(text(i)))).view(np.int64)
        #: Each token as a number into the distinct ones, and the numbers and shapes of these.
        self.of, found = pd.factorize(hashes)
        first = np.zeros(len(found), np.int64)
        first[self.of[::-1]] = np.arange(len(hashes) - 1, -1, -1)
        self.shapes = self._shapes(words, chars, start[first], end[first])
        for i in np.flatnonzero(end[first] - start[first] > LONG):
            self.shapes[i] = shape(text(first[i]))
        self.distinct = found >> SHAPE_BITS << SHAPE_BITS | self.shapes
        #: Whether each token equals the one before.
        self.again = np.zeros(len(self.of), bool)
        self.again[1:] = self.of[1:] == self.of[:-1]
        self.again[(np.cumsum(n) - n)[n > 0]] = False
        #: Number of the text and place in it, of each token and edge.
        sizes = n + 3
        self.docs, self.tokens_of = len(n), n
        self.doc = np.repeat(np.arange(len(n)), sizes)
        self.at = np.arange(len(self.doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self.end = np.cumsum(sizes) - 1
        self.token = self.at > 1
        self.token[self.end] = False
        #: Each token and edge as a place in the distinct numbers with BEGIN, END and REPEAT after them.
        k = len(self.distinct)
        self.vocabulary = np.concatenate((self.distinct, [BEGIN, END, REPEAT]))
        self.codes = np.full(len(self.doc), k, np.int64)
        self.codes[self.end] = k + 1
        self.codes[self.token] = np.where(self.again, k + 2, self.of)

    @staticmethod
    def _shapes(words: Words, chars: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """shape() of tokens of up to LONG code points."""
        if not len(start):
            return np.zeros(0, np.int64)
        sums = np.concatenate(([0], np.cumsum(words.traits[chars])))
        n, whole, rest = end - start, sums[end] - sums[start], sums[end] - sums[start + 1]
        count = lambda x, field: x >> FIELD * field & (1 << FIELD) - 1
        lower = lambda x: (count(x, LOWER) > 0) & (count(x, UPPER) + count(x, TITLE) == 0)
        upper = (count(whole, UPPER) > 0) & (count(whole, LOWER) + count(whole, TITLE) == 0)
        letters = np.select([lower(whole) & (n < 5), lower(whole) & (n < 9), lower(whole), lower(rest) | (n == 1), upper], [4, 5, 6, 3, 2], 7)
        others = np.where(words.kinds[chars[start]] == WORD_CHAR, np.where(count(whole, DIGIT) == n, 1, 7), np.where(n == 1, 8, 9))
        return np.where(count(whole, ALPHA) == n, letters, others)

    def numbers(self) -> np.ndarray:
        """A number for each token and edge."""
        return self.vocabulary[self.codes]

    def symbols(self, symbol: Callable[[np.ndarray, np.ndarray], np.ndarray], bits: int) -> np.ndarray:
        """The trigram codes of symbols, for each place after the first two of a text; an edge is symbol 0."""
        ids = np.concatenate((symbol(self.distinct, self.shapes), [0, 0, AGAIN]))[self.codes]
        at = np.flatnonzero(self.at > 1)
        return ids[at - 2] << 2 * bits | ids[at - 1] << bits | ids[at]
