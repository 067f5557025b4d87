"""A compressed FM-index over a shard of text segments: packed wavelet matrix, backward search and
matching statistics up to a depth."""

from __future__ import annotations

import numpy as np


class BitRank:
    """Packed bits with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        words = len(bits) // 64 + 1
        padded = np.zeros(words * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))[:-1]

    def ones(self, i: np.ndarray) -> np.ndarray:
        w = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & low)


def suffix_order(codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): starts of all suffixes in the order of their first depth symbols at least, and how
    many symbols each has in common with the one before it, as far as depth. Prefix doubling; the ranks
    of its rounds also tell the common lengths, from the longest down."""
    n, bits = len(codes), max(1, int(codes.max(initial=0)).bit_length())
    packed = 62 // bits
    key = np.zeros(n, np.int64)
    for j in range(packed):
        key <<= bits
        if j < n:
            key[: n - j] |= codes[j:]
    reach, ranks = packed, []
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        new = np.empty(n, bool)
        new[:1] = True
        np.not_equal(k[1:], k[:-1], out=new[1:])
        if reach >= depth or new.all():
            break
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        ranks.append((reach, rank.astype(np.int32)))
        key = rank << 31
        key[: n - reach] |= rank[reach:] if reach < n else 0
        reach *= 2
    a, b = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n, np.int64)
    for length, rank in [*reversed(ranks), *[(1, codes)] * packed]:
        inside = np.maximum(a, b) < n
        same = inside & (rank[np.where(inside, a, 0)] == rank[np.where(inside, b, 0)])
        step = np.where(same, length, 0)
        if length == 1:  # symbol by symbol, so the first difference ends it
            step = np.where(common[1:] < 0, 0, step)
            common[1:] = np.where(same | (common[1:] < 0), common[1:], -1 - common[1:])
        common[1:] += np.where(common[1:] < 0, 0, step)
        a += step
        b += step
    common = np.where(common < 0, -1 - common, common)
    return order, np.minimum(common, depth).astype(np.int16)


class FMIndex:
    """Index of segments (arrays of dense symbols from 1), each ended by symbol 0 and owned by a text,
    for patterns of up to depth symbols. Suffixes equal in their first depth symbols may stand in any
    order, which such patterns cannot tell."""

    def __init__(self, segments: list[np.ndarray], owners: np.ndarray, depth: int):
        zero = np.zeros(1, np.int64)
        self.depth = depth
        self.text = np.concatenate([x for s in segments for x in (s, zero)])
        sizes = np.array([len(s) + 1 for s in segments])
        self.starts = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        n = len(self.text)
        self.order, common = suffix_order(self.text, depth)
        last = self.text[self.order - 1]
        self.symbols = int(self.text.max()) + 1
        first = np.concatenate(([0], np.cumsum(np.bincount(self.text, minlength=self.symbols))))
        self.levels = []
        for b in reversed(range(max(1, (self.symbols - 1).bit_length()))):
            bit = (last >> b) & 1
            zeros = int(len(bit) - bit.sum())
            self.levels.append((b, BitRank(bit.astype(np.uint8)), zeros))
            last = np.concatenate((last[bit == 0], last[bit == 1]))
        every = np.arange(self.symbols)
        self.base = first[:-1] - self._walk(every, np.zeros(self.symbols, np.int64))
        #: common[j]: what the suffixes j - 1 and j of the order have in common; nothing at both ends
        self.common = np.concatenate((common, [-1])).astype(np.int16)
        self.common[0] = -1
        self.owner = np.repeat(owners, sizes)[self.order]
        self.other = self._next(self.owner[1:] != self.owner[:-1])
        self.left, self.right = self.classes(depth - 1)
        self.ranges = [self.common]
        while 1 << len(self.ranges) <= n:
            w = 1 << (len(self.ranges) - 1)
            a = self.ranges[-1]
            self.ranges.append(np.concatenate((np.minimum(a[:-w], a[w:]), np.full(w, -1, np.int16))))

    def _next(self, cut: np.ndarray) -> np.ndarray:
        """For each place of the order the next one that cut (of places 1 on) marks, or the end."""
        n = len(self.order)
        at = np.full(n, n, np.int64)
        marked = np.nonzero(cut)[0]
        at[marked] = marked + 1
        return np.minimum.accumulate(at[::-1])[::-1]

    def classes(self, length: int) -> tuple[np.ndarray, np.ndarray]:
        """For each place of the order the range of suffixes that have its first length symbols."""
        cut = self.common[1:-1] < length
        left = np.zeros(len(self.order), np.int64)
        left[1:] = np.where(cut, np.arange(1, len(left)), 0)
        return np.maximum.accumulate(left), self._next(cut)

    def _walk(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ranks, zeros in self.levels:
            ones = ranks.ones(i)
            i = np.where((symbol >> b) & 1, zeros + ones, i - ones)
        return i

    def back(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A step of backward search: the ranges of symbol put before the patterns of the ranges."""
        both = self.base[symbol]
        ends = self._walk(np.concatenate((symbol, symbol)), np.concatenate((lo, hi)))
        return both + ends[: len(lo)], both + ends[len(lo) :]

    def widen(self, lo: np.ndarray, hi: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges of the patterns cut to length symbols from their beginning."""
        n = len(self.order)
        for k in reversed(range(len(self.ranges))):
            w, least = 1 << k, self.ranges[k]
            at = lo - w + 1
            lo = np.where((at > 0) & (least[np.maximum(at, 0)] >= length), lo - w, lo)
            hi = np.where((hi + w <= n) & (least[np.minimum(hi, n)] >= length), hi + w, hi)
        return lo, hi

    def matches(self, piece: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(places, ranges): the places of the text where depth symbols begin that another owner's segment
        has too, and where in the order the range of suffixes begins that have them.

        Every segment is streamed from its end to its beginning, in pieces that overlap by depth, all
        pieces together. Kept of a piece are the range and the length of the longest match of what begins
        at its place, as far as depth, with segments of which one at least is another owner's. A symbol
        before it is added by backward search; where that leaves no other owner, the match is cut to
        the longest shorter one, by the common lengths around its range, until it can be added."""
        depth, n = self.depth, len(self.order)
        piece = piece or 4 * depth
        sizes = np.diff(np.concatenate((self.starts, [n]))) - 1
        begins = [np.arange(s, s + max(1, z - depth + 1), piece) for s, z in zip(self.starts.tolist(), sizes.tolist()) if z >= depth]
        if not begins:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = self.starts + sizes
        begin = np.concatenate(begins)
        end = np.minimum(begin + piece + depth - 1, ends[np.searchsorted(self.starts, begin, "right") - 1])
        pos, lo, hi, length = end.copy(), np.zeros(len(begin), np.int64), np.full(len(begin), n, np.int64), np.zeros(len(begin), np.int64)
        places, ranges = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        while len(pos):
            a, b = self.back(self.text[pos - 1], lo, hi)
            added = (a < b) & (self.other[np.minimum(a, n - 1)] < b)
            lost = ~added
            lo, hi = np.where(added, a, lo), np.where(added, b, hi)
            length += added
            full = np.nonzero(length == depth)[0]
            pos = pos - (added | (length == 0))
            if len(full):
                places.append(pos[full])
                ranges.append(lo[full])
                length[full] -= 1
                lo[full], hi[full] = self.left[lo[full]], self.right[lo[full]]
            cut = np.nonzero(lost & (length > 0))[0]
            if len(cut):
                x, y = lo[cut], hi[cut]
                shorter = np.maximum(np.maximum(self.common[x], self.common[y]), 0).astype(np.int64)
                lo[cut], hi[cut] = self.widen(x, y, shorter)
                length[cut] = shorter
            live = pos + length - depth >= begin  # else the match ends too early for what is left of its piece
            if not live.all():
                pos, lo, hi, length, begin = (x[live] for x in (pos, lo, hi, length, begin))
        return np.concatenate(places), np.concatenate(ranges)
