"""Token ids of whole texts by the `tokenizers` library, with the splitting done in numpy.

The library splits a text into pre-tokens and merges each by itself, so a pre-token's ids don't depend on its
neighbours. Here whole batches are split at once by character class, each distinct pre-token goes to the library once,
and its ids are kept in a bounded cache under the pre-token's 64-bit hash. A second hash is compared at every use; if it
differs, the library encodes the batch. The classes are asked from the library's own splitter when a worker starts.
Texts outside the tabled characters, or with special tokens in them, go to the library whole.
"""

from __future__ import annotations

import os
from array import array
from itertools import chain, repeat

import numpy as np
import pandas as pd

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

LETTER, NUMBER, OTHER, SPACE = range(4)
#: Characters below this are split here, which covers the alphabetic scripts.
TABLED = 0x3000
CHUNK_CHARS = 600_000
#: What an apostrophe takes with it: one letter, or two as one number.
SHORT = [ord(c) for c in "stmd"]
LONG = [ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")]
#: Of a cache entry: the low bits hold the number of ids.
LENGTH_BITS = 24
#: Texts on which the splitting here must equal the library's.
PROBES = ["", " ", "It's  we'll 12,345.67 times\n\n\tOK?! ", "d'été l'an 2024 -- x_y @z (a)b  ", "don't DON'T 'tis\r\n'", "a\u00a0b \u2028c 1½² éß"]
_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The encoder of a vocabulary file, one per Python worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str, cached: int = 400_000):
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), cached
        self.cache: dict[int, int] = {}  # by a pre-token's hash the row of its second hash, and of the place and number of its ids in the pool
        self.seconds, self.places, self.pool = array("Q"), array("Q"), array("I")
        self.special = [x.content for x in self.library.get_added_tokens_decoder().values()]
        split = self.library.pre_tokenizer.pre_tokenize_str
        self.kinds = np.full(TABLED, SPACE, np.uint8)
        for c in map(chr, range(1, TABLED)):
            self.kinds[ord(c)] = next((k for k, x in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!")) if len(split(x + c)) == 1), SPACE)
        self.kinds[0] = OTHER
        self.bytes: dict[int, str] = {}
        for c in (*range(1, 0x800), *range(0x800, 0x110000, 0x400)):
            if not 0xD800 <= c < 0xE000:
                self.bytes.update(zip(chr(c).encode(), "".join(x for x, _ in split(chr(c))), strict=True))
        self.bytes.setdefault(0, split("\0")[0][0])
        self.signs = np.array([ord(self.bytes.get(b, "\ufffd")) for b in range(256)], np.uint16)  # of a byte, the sign that stands for it
        self.values, self.others = np.random.default_rng(7).integers(1, 2**63, (2, TABLED), np.uint64) * np.uint64(2) + np.uint64(1)
        self._powers(1 << 16)
        self.split_here = True
        self.split_here = [list(map(int, x)) for x in self.encode(PROBES)] == self.whole(PROBES)
        self.forget()

    def _powers(self, n: int) -> None:
        base = 0x9E3779B97F4A7C15
        self.up, self.down = np.full(n + 1, base, np.uint64), np.full(n + 1, pow(base, -1, 2**64), np.uint64)
        for powers in (self.up, self.down):
            powers[0] = 1
            np.multiply.accumulate(powers, out=powers)

    def whole(self, texts: list[str]) -> list[list[int]]:
        """The library itself."""
        return [x.ids for x in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def keep(self, hashes: list[int], seconds: list[int], words: list[str]) -> None:
        """Adds the ids of single pre-tokens, by the library's merges alone, to the cache, in rows of their own at its end."""
        merge, at, joined = self.library.model.tokenize, len(self.pool), "".join(words)
        sizes = np.fromiter(map(len, words if joined.isascii() else map(str.encode, words)), np.int64, len(words))
        signs = self.signs[np.frombuffer(joined.encode(), np.uint8)].astype("<u2").tobytes().decode("utf-16-le")
        ends = np.cumsum(sizes)
        found = [[x.id for x in merge(signs[a:b])] for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
        lens = np.fromiter(map(len, found), np.int64, len(found))
        self.cache.update(zip(hashes, range(len(self.places), len(self.places) + len(found)), strict=True))
        self.seconds.extend(seconds)
        self.places.frombytes((((np.cumsum(lens) - lens + at) << LENGTH_BITS) | lens).astype(np.uint64).tobytes())
        self.pool.extend(chain.from_iterable(found))

    def forget(self) -> None:
        self.cache.clear()
        for held in (self.seconds, self.places, self.pool):
            del held[:]

    def encode(self, texts: list[str], chunk: int = CHUNK_CHARS) -> list[np.ndarray]:
        """The ids of each text; by the library alone if its splitter does otherwise than ours on the probes.

        Texts are split in chunks of so many characters: larger ones look fewer pre-tokens up, smaller ones hold less.
        """
        if not self.split_here:
            return [np.array(x, np.uint32) for x in self.whole(texts)]
        out, at = [], 0
        while at < len(texts):
            end, n = at + 1, len(texts[at])
            while end < len(texts) and n + len(texts[end]) <= chunk:
                n += len(texts[end])
                end += 1
            out += self._chunk(texts[at:end])
            at = end
        return out

    def _chunk(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        named = [s for s in self.special if s in joined]
        wide = not joined.isascii() and int(np.frombuffer(joined.encode("utf-32-le"), np.uint32).max()) >= TABLED
        odd = {i for i, t in enumerate(texts) if any(s in t for s in named) or (wide and max(t, default="") >= chr(TABLED))} if named or wide else set()
        plain = [t for i, t in enumerate(texts) if i not in odd] if odd else texts
        done = iter(self._split(plain))
        strange = iter([np.array(x, np.uint32) for x in self.whole([texts[i] for i in sorted(odd)])] if odd else [])
        return [next(strange if i in odd else done) for i in range(len(texts))]

    def _split(self, texts: list[str]) -> list[np.ndarray]:
        joined = "".join(texts)
        n = len(joined)
        if not n:
            return [np.zeros(0, np.uint32) for _ in texts]
        codes = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(np.intp)
        edges = np.concatenate([[0], np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))])
        kinds = self.kinds.take(codes)
        start = np.empty(n + 1, bool)
        start[1:n] = kinds[1:] != kinds[:-1]
        start[n] = True
        start[edges[:-1][edges[:-1] < n]] = True
        inner = np.zeros(n + 1, bool)
        inner[edges] = True
        # White space before something else in the same text gives its last character away: a blank to what follows.
        last = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~inner[1:n])
        start[last] = True
        start[last[codes[last] == 0x20] + 1] = False
        quotes = np.flatnonzero((codes == 0x27) & start[:n])
        stop = edges[np.searchsorted(edges, quotes, "right")]
        one, two = (np.where(quotes + k < stop, codes[np.minimum(quotes + k, n - 1)], 0) for k in (1, 2))
        size = np.where(np.isin(one, SHORT), 1, np.where(np.isin(one << 16 | two, LONG), 2, 0))
        quotes, size = quotes[size > 0], size[size > 0]
        start[quotes + 1] = False
        start[quotes + 1 + size] = True
        begin = np.flatnonzero(start[:n])
        end = np.append(begin[1:], n)
        if n >= len(self.up):
            self._powers(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values.take(codes) * self.up[:n])])
        keys = (sums[end] - sums[begin]) * self.down[begin]
        which, distinct = pd.factorize(keys)
        first = np.empty(len(distinct), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        other = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.others.take(codes))])
        second = ((other[end] - other[begin]) * np.uint64(0x9E3779B97F4A7C15) + (end - begin).astype(np.uint64)) * np.uint64(0x2545F4914F6CDD1D) + codes[begin].astype(np.uint64)
        if (second[first][which] != second).any():  # two pre-tokens with one hash
            return [np.array(x, np.uint32) for x in self.whole(texts)]
        names = distinct.tolist()
        row = np.fromiter(map(self.cache.get, names, repeat(-1)), np.int64, len(names))
        missing = np.flatnonzero(row < 0)
        if len(missing):
            if len(self.cache) + len(missing) > self.most:
                self.forget()
                missing = np.arange(len(names))
            at = first[missing]
            row[missing] = np.arange(len(self.places), len(self.places) + len(missing))
            self.keep(distinct[missing].tolist(), second[at].tolist(), [joined[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)])
        if (np.array(self.seconds, np.uint64)[row] != second[first]).any():  # a pre-token and a kept one with one hash
            return [np.array(x, np.uint32) for x in self.whole(texts)]
        held = np.array(self.places, np.uint64)[row].astype(np.int64)
        pool, lens, offset = np.frombuffer(self.pool, np.uint32), held & ((1 << LENGTH_BITS) - 1), held >> LENGTH_BITS
        each = lens[which]
        total = np.concatenate([[0], np.cumsum(each)])
        ids = pool[np.repeat(offset[which] - total[:-1], each) + np.arange(total[-1])]
        del pool  # the pool can't grow while it is looked at
        cuts = total[np.searchsorted(begin, edges)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
