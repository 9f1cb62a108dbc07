"""SimHash near-duplicates (operator 10): 64-bit fingerprints linked by a binary trie self-join.

Fingerprints are collapsed to the distinct ones, each with its smallest doc_id. Two that differ in at most ``budget`` bits
agree in two of ``budget + 2`` blocks of bits, so every pair meets in a group of equal pairs of blocks. Within a task the groups'
fingerprints, their shared bits first, are one binary trie (a sorted array whose nodes are index ranges). Its self-join
walks pairs of nodes together from the root, adds up the bits in which they part and drops a pair of nodes once the budget
is spent. Linked fingerprints become stars, and stars components.

:func:`similar_groups` links texts by the similarity of their shingle sets. The same self-join finds its pairs, with a budget wide
enough for a similarity of 0.8, among texts that share a key of min-hashes; an exact comparison follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import lean, partitions, staged, table

#: The most node pairs that are walked at once.
FRONTIER = 1 << 17
#: BANDS keys of BAND min-hashes of the shingles: two texts at a similarity of s share none with a chance of (1 - s ** BAND) ** BANDS, whatever
#: the edits are and however short the texts: 0.00007 at 0.8, 5e-10 at 0.9. At 0.5 half of all pairs meet, at 0.3 one in 18.
BANDS, BAND = 24, 5
#: The bits of a set's fingerprint, and in how many of them sets may differ that are compared. Sets at a similarity of 0.8 differ in 15 % of the bits
#: (the angle between them over pi), so in more than this many of 48 about once in 100,000 pairs; unrelated ones in half.
SET_BITS, SET_BUDGET = 48, 20
#: The fewest pairs that are compared at once.
LEAST_PAIRS = 1 << 13
#: Groups are joined together until they have this many rows or shingles.
SET_ROWS, SET_SHINGLES = 4096, 1 << 20
#: A group of more rows or shingles is dealt to several tasks.
PART_ROWS, PART_SHINGLES = 1024, 1 << 20
#: A group of more fingerprints is parted by two further blocks of bits.
MOST_FINGERPRINTS = 1 << 16
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_UPPER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: bytes, words: int) -> int:
    """Bit i is set where it is set in over half the shingles' hashes; 0 without words."""
    own = _WORD.findall(text.translate(_UPPER))
    if not own:
        return 0
    line = b" ".join(own)
    ends = np.cumsum(np.fromiter(map(len, own), np.int64, len(own)) + 1) - 1
    k = min(words, len(own))
    starts, ends = np.concatenate([[0], ends[:-1] + 1])[: len(own) - k + 1].tolist(), ends[k - 1 :].tolist()
    return majority(np.array([xxhash.xxh64_intdigest(line[a:b], 42) for a, b in zip(starts, ends, strict=True)], np.uint64))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for lo in range(0, len(h), 1 << 16):
        counts += np.unpackbits(h[lo : lo + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp long) of each document's whole text; null and wordless texts have fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column(1).cast(pa.binary())
            fp = np.fromiter((fingerprint(t.as_py() or b"", words) for t in text), np.uint64, len(text))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "doc_id long, fp long")


# -- the trie


def _cuts(lo: int, hi: int, n: int) -> list[tuple[int, int]]:
    """[lo, hi) in n parts."""
    at = [lo + (hi - lo) * i // n for i in range(n + 1)]
    return list(zip(at, at[1:]))


def layouts(budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """For each way to share bits: the fingerprint's bit ranges (first, past), the shared ones first, and how many bits are shared.

    Of ``budget + 2`` blocks, ``budget`` wrong bits leave two whole, so every pair shares two blocks.
    """
    blocks = _cuts(0, 64, budget + 2)
    return [([x, y, *(z for z in blocks if z not in (x, y))], x[1] - x[0] + y[1] - y[0]) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]


def _permuted(fp: np.ndarray, ranges: list[tuple[int, int]]) -> np.ndarray:
    """The bit ranges one after the other, the first one highest."""
    out = np.zeros_like(fp)
    for lo, hi in ranges:
        out = (out << np.uint64(hi - lo)) | ((fp >> np.uint64(lo)) & np.uint64((1 << (hi - lo)) - 1))
    return out


def trie_pairs(values: np.ndarray, budget: int, shared: int = 0, done: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) of sorted uint64 values that agree in their ``shared`` highest bits and differ in at most ``budget`` bits.

    ``done(alo, ahi, blo, bhi)`` says which pairs of index ranges need not be walked any more.
    """
    n = len(values)
    if n < 2:
        return
    root = tuple(np.array([x], np.int64) for x in (0, n, 0, n, 0))
    stack = [(0, root)]
    while stack:
        depth, (alo, ahi, blo, bhi, err) = stack.pop()
        if len(alo) > FRONTIER:
            half = len(alo) // 2
            stack += [(depth, tuple(x[:half] for x in (alo, ahi, blo, bhi, err))), (depth, tuple(x[half:] for x in (alo, ahi, blo, bhi, err)))]
            continue
        if done is not None:
            open_ = ~done(alo, ahi, blo, bhi)
            alo, ahi, blo, bhi, err = (x[open_] for x in (alo, ahi, blo, bhi, err))
        one = (ahi - alo == 1) & (bhi - blo == 1)
        if one.any():
            i, j = alo[one], blo[one]
            near = (i != j) & (np.bitwise_count(values[i] ^ values[j]) <= budget)
            if shared:
                near &= (values[i] ^ values[j]) >> np.uint64(64 - shared) == 0
            if near.any():
                yield i[near], j[near]
            alo, ahi, blo, bhi, err = (x[~one] for x in (alo, ahi, blo, bhi, err))
        if not len(alo):
            continue
        if depth == 64:  # equal values
            for a, b, c, d in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist(), strict=True):
                for i in range(a, b):
                    j = np.arange(i + 1 if a == c else c, d)
                    if len(j):
                        yield np.full(len(j), i), j
            continue
        bit = np.uint64(1 << (63 - depth))
        mask = np.uint64((1 << 64) - (1 << (63 - depth))) if depth else bit
        split = lambda lo, hi: np.clip(np.searchsorted(values, (values[lo] & mask) | bit), lo, hi)
        amid, bmid = split(alo, ahi), split(blo, bhi)
        same, allow = alo == blo, 0 if depth < shared else budget
        kids = [(alo, amid, blo, bmid, err), (amid, ahi, bmid, bhi, err), (alo, amid, bmid, bhi, err + 1), (amid[~same], ahi[~same], blo[~same], bmid[~same], err[~same] + 1)]
        kids = [np.concatenate(x) for x in zip(*kids)]
        live = (kids[1] > kids[0]) & (kids[3] > kids[2]) & (kids[4] <= allow)
        live &= ~((kids[0] == kids[2]) & (kids[1] - kids[0] == 1))
        stack.append((depth + 1, tuple(x[live] for x in kids)))


def hook(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of a[i] and b[i]; labels are least members."""
    while len(a):
        la, lb = label[a], label[b]
        apart = la != lb
        a, b, la, lb = a[apart], b[apart], la[apart], lb[apart]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def walked(values: np.ndarray, label: np.ndarray, rank: np.ndarray, budget: int, shared: int, join: Callable = hook) -> np.ndarray:
    """``label`` after all pairs of the self-join of ``values`` are joined; value i is in the class label[rank[i]]."""
    label, turns = label.copy(), None  # turns: where the class changes from one value to the next, summed up

    def done(alo, ahi, blo, bhi):
        nonlocal turns
        of = label[rank]
        if turns is None:
            turns = np.concatenate([[0], np.cumsum(of[1:] != of[:-1])])
        return (turns[ahi - 1] == turns[alo]) & (turns[bhi - 1] == turns[blo]) & (of[alo] == of[blo])

    for a, b in trie_pairs(values, budget, shared, done):
        label, turns = join(label, rank[a], rank[b]), None
    return label


def _joined(keyed: DataFrame, order: Callable, budget: int) -> DataFrame:
    """Star edges (a, b) inside the groups of ``keyed`` (way, key, fp, node): ``order(way)`` says how a way's fingerprints are laid out, (bit ranges, bits shared by a group).

    Each task emits at most an edge a fingerprint and way: a spanning star of each class that it finds, so no link is lost in
    the components and no group's pairs are written out.
    """

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (way, key); whole groups are joined as soon as they are complete."""
        held: list[pa.Table] = []

        def flush(t: pa.Table) -> Iterator[pa.RecordBatch]:
            way, keys = t["way"].to_numpy(), t["key"].to_numpy()
            same = (way[1:] == way[:-1]) & (keys[1:] == keys[:-1])
            met = np.zeros(len(way), bool)
            met[1:] |= same
            met[:-1] |= same
            fps, nodes = t["fp"].to_numpy().view(np.uint64), t["node"].to_numpy()
            at = np.flatnonzero(met)
            for i in np.unique(way[at]):
                own = at[way[at] == i]
                ranges, shared = order(int(i))
                values = _permuted(fps[own], ranges)
                by = np.argsort(values, kind="stable")
                ids = nodes[own][by]
                label, by_rank = walked(values[by], np.arange(len(own)), np.argsort(np.argsort(ids)), budget, shared), np.sort(ids)
                star = np.flatnonzero(label != np.arange(len(own)))
                if len(star):
                    yield pa.RecordBatch.from_arrays([pa.array(by_rank[star]), pa.array(by_rank[label[star]])], ["a", "b"])

        for batch in batches:
            t = pa.Table.from_batches([*[b for h in held for b in h.to_batches()], batch])
            way, keys = t["way"].to_numpy(), t["key"].to_numpy()
            cut = len(way)
            open_ = (way == way[-1]) & (keys == keys[-1]) if cut else np.zeros(0, bool)
            cut -= int(open_.sum())
            if cut:
                yield from flush(t.slice(0, cut))
            held = [t.slice(cut)]
        if held:
            yield from flush(held[0])

    dealt = keyed.repartition(partitions(keyed.sparkSession), "way", "key").sortWithinPartitions("way", "key")
    return dealt.mapInArrow(lean(join), "a long, b long")


def finer(ranges: list[tuple[int, int]], shared: int, budget: int) -> list[tuple[list[tuple[int, int]], int]]:
    """The ways in which pairs that share a layout's first two ranges share two blocks of its others as well; at a budget of 2, 16 bits are left."""
    rest = ranges[2:]
    blocks = [x for lo, hi in rest for x in _cuts(lo, hi, -(-(budget + 2) // len(rest)))]
    return [([*ranges[:2], x, y, *(z for z in blocks if z not in (x, y))], shared + x[1] - x[0] + y[1] - y[0]) for i, x in enumerate(blocks) for y in blocks[i + 1 :]]


def meeting_places(distinct: DataFrame, budget: int, most: int = MOST_FINGERPRINTS) -> tuple[DataFrame, list[tuple[list[tuple[int, int]], int]]]:
    """((way, key, fp, node), the layout of each way): groups of more than ``most`` fingerprints are parted by further shared bits, which loses no pair."""
    plans = layouts(budget)

    def key(ranges, shared):
        out, width = F.lit(0).cast("long"), 0
        for lo, hi in ranges:
            if width == shared:
                break
            out, width = F.shiftleft(out, hi - lo).bitwiseOR(F.shiftrightunsigned("fp", lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))), width + hi - lo
        return out

    def ways(own, first):
        return F.array(*[F.struct(F.lit(first + i).alias("way"), key(r, shared).alias("key")) for i, (r, shared) in enumerate(own)])

    keyed = distinct.select("fp", "node", F.explode(ways(plans, 0)).alias("x")).select("x.way", "x.key", "fp", "node")
    large = staged(keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("way", "key"), "large-groups")
    if budget < 1 or large.isEmpty():
        return keyed, plans
    parted = [finer(r, shared, budget) for r, shared in plans]
    firsts = np.cumsum([len(plans), *map(len, parted)]).tolist()
    further = F.coalesce(*[F.when(F.col("way") == i, ways(own, firsts[i])) for i, own in enumerate(parted)])
    # at most a row for each ``most`` rows
    again = keyed.join(F.broadcast(large), ["way", "key"]).select("fp", "node", F.explode(further).alias("x")).select("x.way", "x.key", "fp", "node")
    return keyed.join(F.broadcast(large), ["way", "key"], "left_anti").select("way", "key", "fp", "node").unionAll(again), [*plans, *(x for own in parted for x in own)]


def links(distinct: DataFrame, budget: int = 2, most: int = MOST_FINGERPRINTS) -> DataFrame:
    """Star edges (a, b) between the ``node`` of fingerprints (column ``fp``) that differ in at most ``budget`` bits."""
    keyed, plans = meeting_places(distinct, budget, most)
    return _joined(keyed, lambda way: plans[way], budget)


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(32))


_SEEDS = np.random.default_rng(64).integers(0, 1 << 63, (BANDS * BAND, 1), dtype=np.uint64)
_FACTORS = np.random.default_rng(65).integers(0, 1 << 63, (BANDS * BAND, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: bytes, words: int) -> np.ndarray:
    """64-bit hashes of the distinct shingles of ``words`` words, ascending; empty without words."""
    own = _WORD.findall(text.translate(_UPPER))
    h = np.fromiter(map(xxhash.xxh64_intdigest, own), np.uint64, len(own))
    if not own:
        return h
    k = min(words, len(h))
    grams = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        grams = grams * np.uint64(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j]
    return np.unique(_stirred(grams))


def _set_id(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, as two signed longs."""
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(grams.tobytes()), np.int64).tolist())


def keys(grams: np.ndarray) -> np.ndarray:
    """BANDS keys of a set; none of an empty one."""
    if not len(grams):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * BAND, np.iinfo(np.uint64).max, np.uint64)
    for lo in range(0, len(grams), 4096):
        least = np.minimum(least, ((grams[lo : lo + 4096] ^ _SEEDS) * _FACTORS).min(axis=1))
    out = np.zeros(BANDS, np.uint64)
    for x in least.reshape(BANDS, BAND).T:
        out = _stirred(out ^ x)
    return out.view(np.int64)


def alike(values: np.ndarray, sets: list[np.ndarray], label: np.ndarray, pivot: np.ndarray, shared: int) -> np.ndarray:
    """``label`` (least rows of classes), joined where a pivot's set and any other have an intersection of 0.8 or more of their union.

    ``values`` are the sets' sorted fingerprints, a group's number in the ``shared`` highest bits. Their self-join finds the pairs; of those between
    the same two classes as few as possible are compared.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.cumsum(size) - size
    mark = np.zeros(len(codes) + 1, bool)

    def shared_with(q: int, c: np.ndarray) -> np.ndarray:
        """How many codes each of the sets c shares with set q. A group's sets lie side by side."""
        mine = codes[first[q] : first[q] + size[q]]
        mark[mine] = True
        lo, hi = first[c[0]], first[c[-1]] + size[c[-1]]
        if 4 * size[c].sum() >= hi - lo:
            total = np.concatenate([[0], np.cumsum(mark[codes[lo:hi]])])
            n = total[first[c] + size[c] - lo] - total[first[c] - lo]
        else:
            starts = np.cumsum(size[c]) - size[c]
            n = np.add.reduceat(mark[codes[np.arange(size[c].sum()) + np.repeat(first[c] - starts, size[c])]].astype(np.int64), starts)
        mark[mine] = False
        return n

    held: list[tuple[np.ndarray, np.ndarray]] = []
    waiting, limit = 0, LEAST_PAIRS

    def settle(label: np.ndarray) -> np.ndarray:
        """Compare the pairs held, all of a set's at once."""
        nonlocal waiting, limit
        waiting = 0
        a, b = (np.concatenate([np.zeros(0, np.int64), *(x[i] for x in held)]) for i in (0, 1))
        held.clear()
        may = (pivot[a] | pivot[b]) & (label[a] != label[b]) & (5 * np.minimum(size[a], size[b]) >= 4 * np.maximum(size[a], size[b]))
        order = np.lexsort((b[may], a[may]))
        a, b = a[may][order], b[may][order]
        cuts = np.flatnonzero(np.diff(a, prepend=-1, append=-1)).tolist()
        joined = 0
        for lo, hi in zip(cuts, cuts[1:]):
            q, c = int(a[lo]), b[lo:hi]
            c = c[label[c] != label[q]]  # what has been joined meanwhile need not be compared
            if len(c):
                near = c[9 * shared_with(q, c) >= 4 * (size[q] + size[c])]
                if len(near):
                    label, joined = hook(label, np.full(len(near), q), near), joined + len(near)
        limit = LEAST_PAIRS if 16 * joined > len(cuts) else min(4 * limit, 1 << 20)  # where little joins, pairs wait for more of their sets'
        return label

    def join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        nonlocal waiting
        held.append((a, b))
        waiting += len(a)
        return settle(label) if waiting >= limit else label

    return settle(walked(values, label, np.arange(len(values)), SET_BUDGET, shared, join))


def _stars_of(rows: DataFrame) -> DataFrame:
    """Star edges (a, b) between nodes whose sets are alike, inside the groups of ``rows`` (way, key, part, block, node, label, pivot, fp, shingles).

    Nodes of one label are linked already; an edge joins two labels.
    """
    place = ["way", "key", "part", "block"]

    def edges(t: pa.Table, group: np.ndarray) -> pa.RecordBatch | None:
        values = (group.astype(np.uint64) << np.uint64(SET_BITS)) | (t["fp"].to_numpy().view(np.uint64) >> np.uint64(64 - SET_BITS))
        by = np.argsort(values, kind="stable")
        values, nodes, group = values[by], t["node"].to_numpy()[by], group[by]
        _, known = np.unique(t["label"].to_numpy()[by], return_inverse=True)
        _, first, of = np.unique(group * len(known) + known, return_index=True, return_inverse=True)
        label = first[of]
        shingles = t["shingles"].combine_chunks()
        sets = [np.frombuffer(shingles[i].as_buffer(), np.uint64) for i in by.tolist()]
        pivot = t["pivot"].to_numpy(zero_copy_only=False)[by].astype(bool)
        got = alike(values, sets, label, pivot, 64 - SET_BITS)
        moved = np.flatnonzero((got != label) & (label == np.arange(len(label))))  # one row a class that joined another
        return pa.RecordBatch.from_arrays([pa.array(nodes[moved]), pa.array(nodes[got[moved]])], ["a", "b"]) if len(moved) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group; whole groups are joined as soon as they are enough."""
        held, groups, group, size, at = [], [], 0, 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in place])
            cuts = [0, *(np.flatnonzero((where[:, 1:] != where[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            weight = pc.binary_length(batch.column("shingles")).to_numpy() // 8
            total = np.concatenate([[0], np.cumsum(weight)])
            for lo, hi in zip(cuts, cuts[1:]):
                if at != (now := tuple(where[:, lo])):
                    if sum(map(len, groups)) >= SET_ROWS or size >= SET_SHINGLES:
                        if (out := edges(pa.Table.from_batches(held), np.concatenate(groups))) is not None:
                            yield out
                        held, groups, group, size = [], [], -1, 0
                    group, at = group + (at is not None), now
                held.append(batch.slice(lo, hi - lo))
                groups.append(np.full(hi - lo, group))
                size += int(total[hi] - total[lo])
        if held and (out := edges(pa.Table.from_batches(held), np.concatenate(groups))) is not None:
            yield out

    dealt = rows.select(*place, "node", "label", "pivot", "fp", "shingles").repartition(partitions(rows.sparkSession), *place).sortWithinPartitions(*place)
    return dealt.mapInArrow(lean(run), "a long, b long")


def _meetings(keyed: DataFrame, part_rows: int) -> tuple[DataFrame, bool]:
    """((way, key, parts, part, node, s0, s1, size), whether any group has several parts) of the rows of ``keyed`` that share a key with others.

    One of the groups with the same members is taken.
    """
    groups = keyed.groupBy("way", "key").agg(F.count(F.lit(1)).alias("rows"), F.sum("size").alias("total"), F.expr("bit_xor(s0)").alias("x"), F.expr("bit_xor(s1)").alias("y"))
    groups = staged(groups.where("rows > 1").withColumn("parts", _parts("rows", "total", part_rows)), "groups")
    one = groups.groupBy("rows", "total", "x", "y", "parts").agg(F.min(F.struct("way", "key")).alias("one")).select("one.way", "one.key", "parts")
    large = groups.where("parts > 1")
    several = not large.isEmpty()
    if several:
        # at most a row for each ``part_rows`` rows or PART_SHINGLES shingles
        met = keyed.join(F.broadcast(large.select("way", "key")), ["way", "key"], "left_anti").join(one.where("parts = 1"), ["way", "key"])
        met = met.unionByName(keyed.join(F.broadcast(one.where("parts > 1")), ["way", "key"]))
    else:
        met = keyed.join(one, ["way", "key"])
    return staged(met.withColumn("part", F.pmod(F.xxhash64("s0", "s1"), "parts").cast("int")), "meetings"), several


def _parts(rows: str, total: str, part_rows: int) -> Column:
    return F.greatest(F.ceil(F.col(rows) / part_rows), F.ceil(F.col(total) / PART_SHINGLES), F.lit(1)).cast("int")


def _across(met: DataFrame, linked: DataFrame, part_rows: int) -> DataFrame:
    """Rows for :func:`_stars_of` that compare the parts of a group with each other, given the edges within parts.

    Most of a large group is one component by then. Only what is outside its largest one goes to all parts, in blocks; so all
    pairs of different components meet, and two of the largest never do.
    """
    columns = ["node", "label", "s0", "s1"]
    wide = met.where("parts > 1").join(components(linked, "a", "b"), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    wide = staged(wide, "parted-meetings")
    each = wide.groupBy("way", "key", "label").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("t"))
    rest = each.groupBy("way", "key").agg(F.max(F.struct("n", "label", "t")).alias("top"), F.sum("n").alias("n"), F.sum("t").alias("t"))
    rest = rest.select("way", "key", F.col("top.label").alias("largest"), (F.col("n") - F.col("top.n")).alias("n"), (F.col("t") - F.col("top.t")).alias("t")).where("n > 0")
    rest = rest.select("way", "key", "largest", _parts("n", "t", part_rows).alias("blocks"))
    own = wide.join(F.broadcast(rest), ["way", "key"])
    left = own.select("way", "key", "part", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), *columns, F.lit(False).alias("pivot"))
    right = own.where("label <> largest").withColumn("block", F.pmod(F.xxhash64("s1", "s0"), "blocks").cast("int"))
    right = right.select("way", "key", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "block", *columns, F.lit(True).alias("pivot"))
    return left.unionAll(right)


def similar_groups(docs: DataFrame, words: int = 5, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, component_id): documents that share 0.8 or more of their distinct shingles, directly or through others.

    Texts that share a key of BAND min-hashes meet; the self-join of their fingerprints, one of the shingle set each, finds pairs that differ in at
    most SET_BUDGET of SET_BITS bits, and these link if their sets do have an intersection of 0.8 of their union. Groups with
    the same members are joined once, those of more than ``part_rows`` texts in parts. ``component_id`` is the smallest doc_id; nulls, repeats and empty tables are as in
    :func:`near_duplicates`.
    """
    whole = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, own = [], [], []
            for t in batch.column(1).cast(pa.binary()):
                grams = shingle_set(t.as_py() or b"", words)
                ids.append(_set_id(grams))
                sizes.append(len(grams))
                own.append(keys(grams))
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in own])])
            flat = np.concatenate([np.zeros(0, np.int64), *own])
            s0, s1 = (pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([batch.column(0), s0, s1, pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(flat, pa.int64()))], ["doc_id", "s0", "s1", "size", "keys"])

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                grams = [shingle_set(t.as_py() or b"", words) for t in batch.column(0).slice(lo, 256).cast(pa.binary())]
                ids = [_set_id(x) for x in grams]
                fps = np.array([majority(x) if len(x) else 0 for x in grams], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*(pa.array([x[i] for x in ids], pa.int64()) for i in (0, 1)), pa.array(fps), pa.array([x.tobytes() for x in grams], pa.binary())], ["s0", "s1", "fp", "shingles"])

    each = staged(whole.mapInArrow(lean(run), "doc_id long, s0 long, s1 long, size long, keys array<long>"), "shingle-keys")
    distinct = each.where("doc_id is not null").groupBy("s0", "s1").agg(F.min("doc_id").alias("node"), F.first("size").alias("size"), F.first("keys").alias("keys"))
    distinct = staged(distinct, "distinct-shingles")
    keyed = distinct.select(F.posexplode("keys").alias("way", "key"), "node", "s0", "s1", "size")
    met, several = _meetings(keyed, part_rows)
    wanted = met.select(F.col("node").alias("doc_id")).distinct()
    sets = whole.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(lean(load), "s0 long, s1 long, fp long, shingles binary")
    sets = sets.groupBy("s0", "s1").agg(F.first("fp").alias("fp"), F.first("shingles").alias("shingles"))
    sets = staged(sets, "sets") if several else sets
    rows = met.select("way", "key", "part", F.lit(0).alias("block"), "node", F.col("node").alias("label"), "s0", "s1", F.lit(True).alias("pivot"))
    linked = staged(_stars_of(rows.join(sets, ["s0", "s1"])), "links")
    if several:
        linked = linked.unionAll(_stars_of(_across(met, linked, part_rows).join(sets, ["s0", "s1"])))
    found = components(linked, "a", "b")
    of = distinct.join(found, "node", "left").select("s0", "s1", F.coalesce("component", "node").alias("component_id"))
    return each.join(of, ["s0", "s1"], "left").select("doc_id", "component_id")


def near_duplicates(docs: DataFrame, words: int = 3, budget: int = 2) -> DataFrame:
    """(doc_id, fp long, component_id): documents whose fingerprints link at ``budget`` or fewer bits, directly or through others.

    ``component_id`` is the smallest doc_id reachable. Equal fingerprints link, those of wordless (null, empty, white)
    texts too. Repeated rows are returned as often as they come. Rows without a doc_id get a fingerprint, link nothing, and
    have the component of the documents with theirs (null if there are none). Other columns are ignored; an empty table
    gives an empty result.
    """
    each = staged(fingerprints(docs, words), "fingerprints")
    distinct = staged(each.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node")), "distinct-fingerprints")
    found = components(links(distinct, budget), "a", "b")
    of = distinct.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return each.join(of, "fp", "left").select("doc_id", "fp", "component_id")


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint and component: (doc_id, fingerprint, component_id).

    Null, empty and white texts have fingerprint zero, which links like any other; nulls, repeated rows, ties and empty tables are
    as in :func:`near_duplicates`; other columns are ignored.
    """
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
