"""Compressed full-text index of a word sequence, with vectorised backward search.

The text's Burrows-Wheeler transform is kept in a wavelet tree of packed bit vectors (level by
level, one rank directory each). Searches of many patterns advance together, one word a step,
so a step costs a fixed number of numpy calls for all of them. Beside it stand, in four bytes a
word each, common prefixes, the nearest smaller ones, and least owners within blocks of 32.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)
_FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def suffix_array(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order by prefix doubling, and what each suffix shares with the one before it.

    The last symbol must be the unique least one. The common prefixes have a -1 at both ends, so
    there is one more of them than suffixes.
    """
    n = len(symbols)
    _, rank = np.unique(symbols, return_inverse=True)
    ranks, step = [rank.astype(np.int32)], 1
    while True:
        rank = ranks[-1].astype(np.int64)
        key = rank * (n + 1)
        key[: n - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        rank[order] = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        if rank[order[-1]] == n - 1:
            break
        ranks.append(rank.astype(np.int32))
        step *= 2
    shared, left, right = np.zeros(n - 1, np.int32), order[:-1].copy(), order[1:].copy()
    for k in range(len(ranks) - 1, -1, -1):  # ranks[k] tells prefixes of 2**k symbols apart
        same = ranks[k][left] == ranks[k][right]
        shared += same.astype(np.int32) << k
        left[same] = np.minimum(left[same] + (1 << k), n - 1)
        right[same] = np.minimum(right[same] + (1 << k), n - 1)
    return order, np.concatenate([[-1], shared, [-1]]).astype(np.int32)


def nearest_smaller(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every place the nearest places before and after it that hold a smaller value; itself at the ends."""
    held = values.tolist()
    before, after, open_ = list(range(len(held))), list(range(len(held))), []
    for i, value in enumerate(held):
        while open_ and held[open_[-1]] > value:
            after[open_.pop()] = i
        # of equal values the earlier one has the nearest smaller place of both
        before[i] = before[open_[-1]] if open_ and held[open_[-1]] == value else open_[-1] if open_ else i
        open_.append(i)
    return np.array(before, np.int32), np.array(after, np.int32)


class BitVector:
    """Packed bits with the ones before every 64-bit block."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.blocks = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.blocks), dtype=np.int64)])[:-1].astype(np.int32)

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        block = at >> 6
        below = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[block] + np.bitwise_count(self.blocks[block] & below)


class WaveletTree:
    """Rank of a symbol before a place, in as many bit-vector ranks as symbols have bits."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(max(1, int(symbols.max()).bit_length()) - 1, -1, -1):
            bits = (symbols >> shift) & 1
            self.levels.append((shift, BitVector(bits), int(len(bits) - bits.sum())))
            symbols = np.concatenate([symbols[bits == 0], symbols[bits == 1]])

    def descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Place at the lowest level that belongs to (symbol, place)."""
        for shift, bits, zeros in self.levels:
            ones = bits.ones(at)
            at = np.where((symbols >> shift) & 1, zeros + ones, at - ones)
        return at


class LeastInRange:
    """Least value of any range of an array, from the least values before and after each place of its block, and a table of blocks."""

    BLOCK = 32

    def __init__(self, values: np.ndarray) -> None:
        size = self.BLOCK
        self.most = np.iinfo(values.dtype).max
        padded = np.full(-(-len(values) // size) * size + size, self.most, values.dtype)
        padded[: len(values)] = values
        blocks = padded.reshape(-1, size)
        self.values = padded
        self.ahead = np.minimum.accumulate(blocks, axis=1).ravel()
        self.behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        self.rows = [blocks.min(1)]
        while 2 << (len(self.rows) - 1) <= len(self.rows[0]):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        first, last = low // self.BLOCK, (high - 1) // self.BLOCK
        out = np.minimum(self.behind[low], self.ahead[high - 1])
        inside = np.flatnonzero(first == last)  # those ranges end within the block that they begin in
        for at in range(0, len(inside), 4096):
            part = inside[at : at + 4096]
            places = low[part, None] + np.arange(self.BLOCK)
            out[part] = np.where(places < high[part, None], self.values[places], self.most).min(1)
        between = np.flatnonzero(last - first > 1)
        a, b = first[between] + 1, last[between]
        level = np.frexp((b - a).astype(np.float64))[1] - 1
        for k in np.unique(level):
            here = level == k
            row = self.rows[k]
            out[between[here]] = np.minimum(out[between[here]], np.minimum(row[a[here]], row[b[here] - (1 << int(k))]))
        return out


class FmIndex:
    """Index of documents' word sequences. symbols: at least 2; 1 ends each sequence.

    owners: of every place of `symbols`, the number of its document; searches ask for the least.
    """

    def __init__(self, symbols: np.ndarray, owners: np.ndarray) -> None:
        text = np.concatenate([symbols, [0]]).astype(np.int64)
        order, self.shared = suffix_array(text)
        self.before, self.after = nearest_smaller(self.shared)
        self.size = len(text)
        self.tree = WaveletTree(text[order - 1])
        self.most = int(text.max())
        alphabet = np.arange(self.most + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.most + 1))])[:-1]
        self.start = self.tree.descend(alphabet, np.zeros(len(alphabet), np.int64))
        self.least = LeastInRange(np.concatenate([owners, [np.iinfo(np.int32).max]]).astype(np.int32)[order])

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of the suffixes that begin with the symbol before what a range stands for."""
        n = len(symbols)
        places = self.tree.descend(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        base = self.first[symbols] - self.start[symbols]
        return base + places[:n], base + places[n:]


def matching_intervals(index: FmIndex, words: np.ndarray, offsets: np.ndarray, below: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Intervals of every query that cover all its windows of `length` words found in the index.

    words: the queries' symbols end to end (-1: not in the index), offsets: n + 1 ends; below:
    only places whose owner is less than this count. Returns query, start and end (within
    words) of maximal intervals of at least `length` words that occur, found from right to left.

    These are the matching statistics: for every place the longest match that starts there. A
    match grows to the left by backward search. Where it can't, it is cut on the right to the
    longest prefix that stands in more places, as common prefixes of neighbouring suffixes tell,
    and tried again. A query takes at most twice as many steps as it has words.
    """
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    query = np.flatnonzero(np.diff(offsets) >= length)
    begin, end = offsets[query].astype(np.int64), offsets[query + 1].astype(np.int64)
    state = [query, begin, end, end.copy(), np.zeros(len(query), np.int64), np.full(len(query), index.size, np.int64), np.zeros(len(query), bool)]
    while len(state[0]):
        query, begin, end, at, low, high, grown = state
        symbol = words[at - 1]
        known = symbol >= 0
        new_low, new_high = index.extend(np.where(known, symbol, 0), low, high)
        ok = known & (new_low < new_high)
        ok[ok] = index.least(new_low[ok], new_high[ok]) < below[query[ok]]
        low[ok], high[ok] = new_low[ok], new_high[ok]
        at[ok] -= 1
        grown |= ok
        through = at == begin
        report = grown & (through | ~ok) & (end - at >= length)
        if report.any():
            found.append((query[report], at[report], end[report]))
        stuck = np.flatnonzero(~ok)
        if len(stuck):
            grown[stuck] = False
            a, b = low[stuck], high[stuck]
            depth = np.maximum(index.shared[a], index.shared[b])
            low[stuck] = np.where(index.shared[a] == depth, index.before[a], a)
            high[stuck] = np.where(index.shared[b] == depth, index.after[b], b)
            absent = depth < 0  # nothing is matched any more, and the word itself isn't there
            at[stuck[absent]] -= 1
            end[stuck] = at[stuck] + np.maximum(depth, 0)
            low[stuck[absent]], high[stuck[absent]] = 0, index.size
        over = (at == begin) | (end - begin < length)
        if over.any():
            state = [x[~over] for x in state]
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))
