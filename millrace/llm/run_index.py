"""A run-length index over short texts: run-compressed Burrows-Wheeler transform with sampled run ends.

Only what streaming needs is kept of the transform: for each run's first and last suffix, the text position and how many bytes
it shares with its neighbour in suffix order. Inside a run, a suffix's neighbour is the neighbour of the suffix one to the left,
moved one to the right, and the match is one shorter (Gagie, Navarro and Prezza, 2018). So one pass over the text, from sample
to sample, gives for every position how long it matches any other position of the texts. Matches are compared byte by byte;
over all run ends they add up to at most 2 n log n bytes (Kärkkäinen, Kempa and Piątkowski, 2016).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Bytes that are compared at once after the first few words.
WIDE = 512


@dataclass
class RunIndex:
    n: int  # bytes of the texts, each with one byte after it that ends it
    heads: np.ndarray  # text positions of the runs' first suffixes, in text order
    above: np.ndarray  # how many bytes each shares with its predecessor in suffix order
    tails: np.ndarray  # text positions of the runs' last suffixes, in text order
    below: np.ndarray  # how many bytes each shares with its successor

    @classmethod
    def build(cls, texts: list[bytes], twins: list[bool] | None = None) -> RunIndex:
        """``twins`` says which texts are there a second time. Such a text's suffixes and their twins lie next to each other in suffix order with the same
        byte before them, so the twin adds nothing to the runs but one sample at its start: there and onwards all bytes are shared."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
        ends = np.cumsum(sizes + 1) - 1
        text = np.repeat(np.arange(len(texts)), sizes + 1)
        end = ends[text]
        order = suffix_order(data, end)
        left = data[order - 1].astype(np.int16)
        left[np.isin(order, np.concatenate([[0], ends[:-1] + 1]))] = -1  # what precedes a text's start equals nothing
        turn = np.flatnonzero((left[1:] != left[:-1]) | (left[1:] < 0))
        upper, lower = order[turn], order[turn + 1]
        shared = common(data, end, upper, lower)
        by_head = np.argsort(lower)
        heads, above = lower[by_head], shared[by_head]
        if twins is not None and any(twins):
            two = np.flatnonzero(twins)
            alone = ~np.asarray(twins)[text[upper]]
            upper, shared = np.concatenate([upper[alone], ends[two] - sizes[two]]), np.concatenate([shared[alone], sizes[two]])
        by_tail = np.argsort(upper)
        return cls(len(data), heads, above, upper[by_tail], shared[by_tail])

    def matching_statistics(self) -> np.ndarray:
        """For each position, how many bytes from there on occur at another position too (matches stay inside texts)."""
        at = np.arange(self.n)
        reach = at.copy()  # past the last byte of the longest match
        for samples, shared in ((self.heads, self.above), (self.tails, self.below)):
            if len(samples):
                onward = np.repeat(samples + shared, np.diff(samples, append=self.n))
                np.maximum(reach[samples[0] :], onward, out=reach[samples[0] :])
        return reach - at


def common(data: np.ndarray, end: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Bytes that the suffixes at i and j share, inside their texts."""
    most = np.minimum(end[i] - i, end[j] - j)
    out = np.zeros(len(i), np.int64)
    padded = np.concatenate([data, np.zeros(WIDE, np.uint8)])
    open_ = np.arange(len(i))
    for width in (8, 8, 8, 32, *[WIDE] * (len(data) // WIDE + 1)):
        if not len(open_):
            break
        step, still = np.arange(width), []
        for part in np.array_split(open_, -(-len(open_) * width // (1 << 20))):
            a, b = padded[(i[part] + out[part])[:, None] + step], padded[(j[part] + out[part])[:, None] + step]
            same = a == b
            whole = same.all(axis=1)
            out[part] += np.where(whole, width, same.argmin(axis=1))
            still.append(part[whole & (out[part] < most[part])])
        open_ = np.concatenate(still)
    return np.minimum(out, most)


def suffix_order(data: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffixes sorted by their bytes up to their text's end, equal ones by text: the sorted length grows threefold (twofold where three ranks need
    more than 63 bits) over the groups still tied."""
    n = len(data)
    at = np.arange(n)
    left = end - at
    first = np.where(left > 0, data.astype(np.int64) + 1, 0)
    for have, more in ((1, 1), (2, 2), (4, 3)):
        # the first ``have`` symbols of 9 bits, then ``more`` symbols of the suffix that follows them
        then = np.zeros(n, np.int64)
        then[: max(n - have, 0)] = first[have:] >> (9 * (have - more))
        first = (first << (9 * more)) | np.where(left > have, then, 0)
    order = np.argsort(first)
    ends = np.flatnonzero(left == 0)
    order[: len(ends)] = ends  # the empty suffixes come first, by text
    new = np.concatenate([[True], first[order[1:]] != first[order[:-1]]])
    new[: len(ends) + 1] = True
    small = np.int32 if n < 1 << 30 else np.int64
    rank, end = np.empty(n, small), end.astype(small)
    slots, own, r = at, order.astype(small), np.maximum.accumulate(np.where(new, at, 0))
    rank[own] = r
    h, times = 7, 3 if n < 1 << 21 else 2
    while True:
        # slots of the groups with more than one suffix; a group's rank is its first slot
        tied = ~new
        tied[:-1] |= ~new[1:]
        if not tied.any():
            return order
        slots, own, by = slots[tied], own[tied], r[tied]
        past = end[own]
        for k in range(1, times):
            by = by * (n + 1) + rank[np.minimum(own + small(min(k * h, n)), past)]
        resort = np.argsort(by)
        own, by = own[resort], by[resort]
        order[slots] = own
        new = np.concatenate([[True], by[1:] != by[:-1]])
        r = np.maximum.accumulate(np.where(new, slots, 0))
        rank[own] = r
        h *= times
