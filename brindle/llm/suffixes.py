"""Indexes over the texts of one shard, in numpy: suffix order, FM-index and run-length index.

A shard is a few contents (arrays of symbols) joined with 0 after each; symbols are numbered from 1. The
zeros count as different symbols in the order of their places, so that all suffixes differ.
"""

from __future__ import annotations

import numpy as np


def ends_of(text: np.ndarray) -> np.ndarray:
    """For each position the 0 that ends its content."""
    zeros = np.flatnonzero(text == 0)
    return np.repeat(zeros, np.diff(zeros, prepend=-1)).astype(np.int32)


def in_order(key: np.ndarray, at: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions by (key, position), uint64 keys of `bits` bits and positions of `width` bits, and where the key changes."""
    if bits + width <= 64:
        w = np.uint64(width)
        packed = key << w
        packed |= at.astype(np.uint64)
        packed.sort()
        key = packed >> w
        packed &= np.uint64((1 << width) - 1)
        at = packed.astype(np.int32)
    else:
        by = np.lexsort((at, key))
        key, at = key[by], at[by]
    new = np.ones(len(at), bool)
    new[1:] = key[1:] != key[:-1]
    return at, new


def sort_suffixes(text: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Positions of text in the order of their suffixes: prefix doubling over groups that are still tied."""
    n = len(text)
    width, bits = n.bit_length(), max(1, int(text.max(initial=0)).bit_length())
    rest = end - np.arange(n, dtype=np.int32)
    span = max(1, min(2 * width, 64 - width) // bits)
    keys, padded = np.zeros(n, np.uint64), np.append(text, np.zeros(span, text.dtype))
    for k in range(span):
        keys = keys << np.uint64(bits) | np.where(rest >= k, padded[k : k + n], 0).astype(np.uint64)
    order, first = in_order(keys, np.arange(n, dtype=np.int32), span * bits, width)
    first |= rest[order] < span
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(first, np.arange(n, dtype=np.int32), 0))
    while len(tied := np.flatnonzero(~(first & np.append(first[1:], True)))):
        at = order[tied]
        # where the rest is no longer than span, its rank is its own, so that places decide between equal contents
        at, new = in_order(rank[at].astype(np.uint64) << np.uint64(width) | rank[at + span].astype(np.uint64), at, 2 * width, width)
        order[tied] = at
        first[tied] = new
        rank[at] = np.maximum.accumulate(np.where(new, tied, 0))
        span *= 2
    return order


class BitVector:
    """Bits in words of 64, with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        self.words = np.zeros(len(bits) // 64 + 1, np.uint64)
        self.words.view(np.uint8)[: len(packed)] = packed
        self.before = np.zeros(len(self.words), np.int32)
        np.cumsum(np.bitwise_count(self.words)[:-1], out=self.before[1:])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(bool)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before position i."""
        w = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Wavelet tree of a sequence, its levels laid out as a matrix."""

    def __init__(self, sequence: np.ndarray, bits: int):
        self.levels: list[tuple[int, BitVector, int]] = []
        for shift in range(bits - 1, -1, -1):
            ones = (sequence >> shift & 1).astype(bool)
            self.levels.append((shift, BitVector(ones), int(len(ones) - ones.sum())))
            sequence = np.concatenate([sequence[~ones], sequence[ones]])

    def place(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position i of the sequence is sent along the path of a symbol; differences are ranks."""
        for shift, bits, zeros in self.levels:
            ones = bits.rank(i)
            i = np.where(symbol >> shift & 1, zeros + ones, i - ones)
        return i


    def follow(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at position i of the sequence, and where it is sent along that symbol's path."""
        symbol = np.zeros(len(i), np.int64)
        for shift, bits, zeros in self.levels:
            one, ones = bits.get(i), bits.rank(i)
            symbol |= one.astype(np.int64) << shift
            i = np.where(one, zeros + ones, i - ones)
        return symbol, i


#: One row in so many keeps its owner, in order of the text.
SAMPLED = 8


class FmIndex:
    """Burrows-Wheeler transform in a wavelet tree, with the owners of some rows' suffixes; neither text nor suffix order is kept."""

    def __init__(self, text: np.ndarray, owner: np.ndarray, sampled: int = SAMPLED):
        """owner: a number for each content's positions, of which the smallest of a pattern's places is asked for."""
        end = ends_of(text)
        order = sort_suffixes(text, end)
        bits = max(1, int(text.max(initial=0)).bit_length())
        begin = np.append(0, np.flatnonzero(text == 0)[:-1] + 1) if len(text) else np.zeros(0, np.int64)
        into = np.arange(len(text)) - np.repeat(begin, np.diff(np.append(begin, len(text))))
        keeps = (into % sampled == 0)[order]  # the first of each content among them, so that no walk leaves its content
        self.keeps, self.owner = BitVector(keeps), owner[order[keeps]].astype(np.int32)
        self.tree = WaveletTree(text[order - 1], bits)  # before position 0 stands the last symbol, a 0
        symbols = np.arange(1 << bits)
        self.start = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=1 << bits))])
        self.shift = self.start[:-1] - self.tree.place(symbols, np.zeros(1 << bits, np.int64))

    def stream(self, text: np.ndarray, ends: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics by backward search: for each end in text, how many symbols before it, up to most, stand in the index twice or more, and their rows [lo, hi).

        An end is left as soon as one row or none is left for it.
        """
        length = np.zeros(len(ends), np.int32)
        last = text[ends - 1]
        lo, hi = self.start[last].copy(), self.start[last + 1].copy()
        live = np.flatnonzero(hi - lo > 1)
        length[live] = 1
        for k in range(2, most + 1):
            c = text[ends[live] - k]
            shift = self.shift[c]
            a, b = shift + self.tree.place(c, lo[live]), shift + self.tree.place(c, hi[live])
            twice = (b - a > 1) & (c > 0)
            live = live[twice]
            if not len(live):
                break
            lo[live], hi[live] = a[twice], b[twice]
            length[live] = k
        return length, lo, hi

    def owners(self, rows: np.ndarray) -> np.ndarray:
        """The owner of each row: that of the row that keeps one, which some steps back in the text lead to."""
        out, live = np.empty(len(rows), np.int32), np.arange(len(rows))
        while len(live):
            there = self.keeps.get(rows)
            out[live[there]] = self.owner[self.keeps.rank(rows[there])]
            live = live[~there]
            symbol, at = self.tree.follow(rows[~there])
            rows = self.shift[symbol] + at
        return out

    def smallest_owner(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The smallest owner in rows [lo, hi); stretches that are asked for must be equal or apart."""
        if not len(lo):
            return np.zeros(0, np.int32)
        stretch, back = np.unique(lo, return_inverse=True)
        size = np.zeros(len(stretch), np.int64)
        size[back] = hi - lo
        first = np.cumsum(size) - size
        rows = np.arange(int(size.sum())) + np.repeat(stretch - first, size)
        return np.minimum.reduceat(self.owners(rows), first)[back]


def common(text: np.ndarray, end: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray | None = None, other: np.ndarray | None = None) -> np.ndarray:
    """Symbols that text from a on and text (or other) from b on share, before a content ends in text, up to most."""
    per, bits = 8 // text.dtype.itemsize, 8 * text.dtype.itemsize
    views = []
    for x in (text, text if other is None else other):
        padded = np.append(x, np.zeros(2 * per, x.dtype))
        views.append(np.ndarray(len(x) + per, np.uint64, padded, strides=padded.strides))  # the next 8 bytes from each place on, without a copy
    limit = end[a] - a
    if other is None:
        limit = np.minimum(limit, end[b] - b)
    limit = limit.astype(np.int64) if most is None else np.minimum(limit, most)
    length = np.zeros(len(a), np.int64)
    live = np.flatnonzero(limit > 0)
    while len(live):
        differ = views[0][a[live] + length[live]] ^ views[1][b[live] + length[live]]
        length[live] += np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) // bits  # equal symbols in front
        live = live[(differ == 0) & (length[live] < limit[live])]
    return np.minimum(length, limit)


class RunLengthIndex:
    """Run-compressed Burrows-Wheeler transform of the contents of a shard, with samples at the ends of its runs.

    A run is rows whose suffixes follow the same symbol. They keep their order when that symbol is put in front
    (LF), so that one number a run is enough: how far its rows go. Nor do suffix order and text stay: what two
    neighbouring rows share grows by one from step to step while both are in one run, and only where a run
    begins there is a new neighbour, with which `shared` symbols are shared. Where runs begin is kept in bits.
    For texts that aren't in the index (`stream`) the text positions at both ends of each run are kept, and the text.
    """

    def __init__(self, text: np.ndarray, foreign: bool = False):
        end = ends_of(text)
        order = sort_suffixes(text, end)
        bwt = text[order - 1]
        self.contents, self.rows = int((text == 0).sum()), (n := len(text))
        begins = np.ones(n + 1, bool)  # the last one stands after all rows
        begins[1:n] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)  # zeros differ
        self.heads = BitVector(begins)
        first = np.flatnonzero(begins[:-1])
        last = np.append(first[1:], n) - 1
        symbol, head, tail = bwt[first], order[first], order[last]
        by = np.argsort(symbol, kind="stable")
        size = (last - first + 1)[by]
        to = np.empty(len(by), np.int64)  # LF of each run's first row
        to[by] = np.cumsum(size) - size
        # runs of one symbol lead to rows one below the other: the head's row meets that of the tail of the run before
        meets = np.flatnonzero((symbol[by[1:]] == symbol[by[:-1]]) & (symbol[by[1:]] > 0)) + 1
        shared = np.zeros(len(by) + 1, np.int32)
        shared[meets] = 1 + common(text, end, head[by[meets]], tail[by[meets - 1]])
        # of each run: how far its rows go, and what the head's new row shares with that above, the tail's with that below
        self.table = np.empty((len(by), 3), np.int32)
        self.table[:, 0] = to - first
        self.table[by, 1], self.table[by, 2] = shared[:-1], shared[1:]
        if foreign:
            self.text, self.end, self.head, self.tail, self.first, self.last, self.symbol = text, end, head, tail, first, last, symbol
            edges = np.searchsorted(symbol[by], np.arange(int(text.max(initial=0)) + 2))
            self.runs_with = [np.sort(by[a:b]) for a, b in zip(edges, edges[1:], strict=False)]

    @property
    def runs(self) -> int:
        return len(self.table)

    @property
    def bytes(self) -> int:
        return self.table.nbytes + self.heads.words.nbytes + self.heads.before.nbytes

    def matching_statistics(self, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """For each position of the text the longest match of its suffix with one that starts elsewhere.

        Each content is streamed backwards, all in step: its end's row is known, and from there LF leads to the
        rows of longer suffixes; what they share with the rows above and below comes along. begins, sizes: of
        the contents, in the order in which they were joined.
        """
        best = np.zeros(self.rows, np.int32)
        by = np.argsort(-sizes, kind="stable")
        row, above, below = by.astype(np.int64), np.zeros(len(by), np.int32), np.zeros(len(by), np.int32)  # ends sort first, in the order of contents
        at, left = (begins + sizes)[by], sizes[by]
        for step in range(1, int(left[0]) + 1 if len(left) else 1):
            live = int(np.searchsorted(-left, -step, side="right"))
            row, above, below = row[:live], above[:live], below[:live]
            run = self.table.take(self.heads.rank(row + 1) - 1, axis=0)
            above += 1
            below += 1
            at_head, at_tail = np.flatnonzero(self.heads.get(row)), np.flatnonzero(self.heads.get(row + 1))
            above[at_head], below[at_tail] = run[at_head, 1], run[at_tail, 2]
            row = row + run[:, 0]
            best[at[:live] - step] = np.maximum(above, below)
        return best

    def stream(self, pattern: np.ndarray) -> np.ndarray:
        """For each position of a text that isn't in the index (symbols from 1) the longest match of its suffix with one in the index.

        While the row's run goes on with the pattern's symbol, LF lengthens the match. Else the nearest rows
        before and after that do, a run's tail and a run's head, are compared with the match at hand.
        """
        n, out = len(pattern), np.zeros(len(pattern), np.int64)
        row, place, length = 0, int(np.flatnonzero(self.text == 0)[0]), 0
        for i in range(n - 1, -1, -1):
            c = int(pattern[i])
            run = int(np.searchsorted(self.first, row, side="right")) - 1
            if self.symbol[run] != c:
                known = self.runs_with[c] if 0 < c < len(self.runs_with) else ()
                if not len(known):
                    row, place, length = 0, int(np.flatnonzero(self.text == 0)[0]), 0
                    continue
                k = int(np.searchsorted(known, run))
                ways = [(r, up) for r, up in zip(known[max(0, k - 1) : k + 1], [True, False][k == 0 :], strict=False)]
                places = np.array([self.tail[r] if up else self.head[r] for r, up in ways])
                shared = common(self.text, self.end, places, np.full(len(ways), place), np.full(len(ways), length))
                w = int(np.argmax(shared))
                run, up = int(ways[w][0]), ways[w][1]
                row = int(self.last[run] if up else self.first[run])
                place, length = int(places[w]), int(shared[w])
            row, place, length = row + int(self.table[run, 0]), (place - 1) % self.rows, length + 1
            out[i] = length
        return out


def join_contents(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The text of a shard, symbols renumbered from 1 without gaps, and where each content begins. flat: the contents end to end, small numbers."""
    number = np.cumsum(np.bincount(flat) > 0)[flat]
    kind = np.uint8 if number.max(initial=0) < 256 else np.uint16 if number.max(initial=0) < 65536 else np.uint32
    begins = np.cumsum(sizes) - sizes + np.arange(len(sizes))
    text = np.zeros(len(flat) + len(sizes), kind)
    text[np.arange(len(flat)) + np.repeat(np.arange(len(sizes)), sizes)] = number
    return text, begins
