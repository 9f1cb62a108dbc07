"""Suffix-array dedup (operator 4): bytes of long strings that occur again anywhere, found with run-length indexes.

Which ``length``-byte strings can be equal is decided first, so that no index has to hold the corpus: every window of that
length has an anchor, the leftmost of its ``anchor``-byte strings with the least hash, which depends on the window's bytes
alone. The windows of a document that follow one another with the same anchor form a segment, and equal windows lie in
segments with equal anchor strings. Segments whose anchor occurs once are done. Equal segments are represented by two of
them; the representatives that share an anchor are gathered into blocks of bounded size, each block gets a run-length
index, and one stream over it gives the matching statistics: windows that match ``length`` bytes elsewhere are marked.
An anchor with more than ``most`` different segments is replaced by longer ones: its windows are parted by where the anchor
lies in them, all windows of a part share more bytes around it, and those are the anchors of the next level, down to the
whole window. So every verdict comes from an index, whatever the size of a group.

Repeats of a second, smaller length are found in the same way, after the first: a segment whose windows all lie in what is removed
already needs no verdict, so only anchors are taken that also occur outside; the covered segments stay as what others repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .run_index import RunIndex
from .shared import lean, partitions, sliced, staged, table, unstage

LENGTH = 400
ANCHOR = 128
#: Bytes of a repeated passage: prose of over 50 words has more, runs of short words may have fewer.
PASSAGE = 240
PASSAGE_ANCHOR = 64
#: The most different segments of an anchor that are indexed together.
MOST = 512
#: Into how many parts the windows of a crowded anchor go at a level.
PARTS = 4
#: Bytes that are hashed at once, and that are indexed at once (beyond it, an anchor's group as a whole). An index takes about 120 times its bytes while it is built.
CHUNK, INDEXED = 1 << 20, 1 << 18
SEGMENTS = "d1 long, d2 long, first long, more long, off long, key long, sig long, copies long, open boolean"


#: The base of the polynomial hashes (odd, so that it has an inverse mod 2**64), and a random word for each byte.
BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
BYTE = np.random.default_rng(42).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n."""
    if len(_powers[0]) < n:
        _powers[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, b, np.uint64)])) for b in (BASE, UNBASE)]
    return _powers[0][:n], _powers[1][:n]


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """h with (h[b] - h[a]) * BASE**-a a hash of data[a:b]; it only chooses anchors, so two strings with one hash do no harm."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * powers(len(data))[0], out=out[1:])
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of ``width`` values."""
    n = len(values)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = values
    blocks = blocks.reshape(-1, width)
    onward = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], onward[width - 1 : n])


def segments(data: np.ndarray, spans: list[tuple[int, int]], length: int, anchor: int) -> tuple[np.ndarray, ...]:
    """(first window, windows - 1, bytes from the first window to the anchor, anchor's hash) of the segments of the texts data[a:b]."""
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    h, inverse = prefix_hashes(data), powers(n + 1)[1]
    keys = mixed((h[anchor:] - h[:-anchor]) * inverse[: n - anchor + 1])
    low = np.uint64((1 << (CHUNK + length).bit_length()) - 1)  # the same for all texts
    least = (_least((keys & ~low) | np.arange(len(keys), dtype=np.uint64), length - anchor + 1) & low).astype(np.int64)
    valid = np.zeros(len(least), bool)
    for a, b in spans:
        if b - a >= length:
            valid[a : b - length + 1] = True
    turn = np.ones(len(least), bool)
    turn[1:] = (least[1:] != least[:-1]) | (valid[1:] != valid[:-1])
    edge = np.flatnonzero(turn)
    past = np.append(edge[1:], len(least))
    own = valid[edge]
    first, last = edge[own], past[own] - 1
    return first, last - first, least[first] - first, keys[least[first]]


def signatures(data: bytes, first: np.ndarray, past: np.ndarray) -> np.ndarray:
    """Hashes of data[first:past], as signed numbers. Inside an anchor's group they tell segments apart."""
    view = memoryview(data)
    return np.fromiter((xxhash.xxh3_64_intdigest(view[a:b]) for a, b in zip(first.tolist(), past.tolist(), strict=True)), np.uint64, len(first)).view(np.int64)


def _pieces(offsets: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first document, past document, first byte, past byte): whole documents up to CHUNK bytes, or parts of a longer one that share length - 1 bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = i + 1
        if offsets[j] - offsets[i] > CHUNK:
            for a in range(int(offsets[i]), int(offsets[j]) - length + 1, CHUNK):
                yield i, j, a, min(a + CHUNK + length - 1, int(offsets[j]))
        else:
            while j < n and offsets[j + 1] - offsets[i] <= CHUNK:
                j += 1
            yield i, j, int(offsets[i]), int(offsets[j])
        i = j


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary column without nulls."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return offsets, np.frombuffer(column.buffers()[2] or b"", np.uint8)


def _find(length: int, anchor: int) -> Callable:
    """The segments of texts; ``open`` are those that have a window outside the spans that come with a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = _bytes(batch.column(2))
            ids = [batch.column(k).to_numpy() for k in (0, 1)]
            covered = [(-1, -1)]
            if batch.num_columns > 3:
                covered += [(at + lo, at + hi) for at, spans in zip(offsets.tolist(), batch.column(3).to_pylist()) for lo, hi in merged(spans)]
            lows, highs = np.array(covered, np.int64).T
            for i, j, a, b in _pieces(offsets, length):
                spans = [(int(max(x, a)) - a, int(min(y, b)) - a) for x, y in zip(offsets[i:j], offsets[i + 1 : j + 1])]
                first, more, off, key = segments(data[a:b], spans, length, anchor)
                if len(first):
                    doc = np.searchsorted(offsets[i : j + 1], first + a, side="right") - 1 + i
                    sig = signatures(data[a:b], first, first + more + length)
                    outside = highs[np.searchsorted(lows, first + a, side="right") - 1] < first + a + more + length
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[0][doc], ids[1][doc], first + a - offsets[doc], more, off, key.view(np.int64), sig, np.ones(len(first), np.int64), outside)], ["d1", "d2", "first", "more", "off", "key", "sig", "copies", "open"])

    return run


def _part(length: int, slack: int) -> Callable:
    """The segments of a crowded anchor, parted by how far the anchor is from a window's start, 0 to ``slack``."""
    step = slack // PARTS + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for key, sig, copies, off, more, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for lo in range(0, slack + 1, step):
                    hi = min(lo + step - 1, slack)
                    first, last = max(0, off - hi), min(more, off - lo)
                    if first <= last:
                        # what all windows share whose start is lo to hi bytes before the anchor
                        shared = text[off - lo : off - hi + length]
                        own = xxhash.xxh3_64_intdigest(shared, (key + lo) & ((1 << 64) - 1))
                        rows.append((key, sig, first, last - first, off - lo - first, own, xxhash.xxh3_64_intdigest(text[first : last + length]), copies))
            if rows:
                columns = [pa.array(np.array(x, np.uint64).view(np.int64) if k in (5, 6) else np.array(x, np.int64)) for k, x in enumerate(zip(*rows, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.ones(len(rows), bool))], ["d1", "d2", "first", "more", "off", "key", "sig", "copies", "open"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of each text's wanted segments; of equal rows that follow one another (as they do after a sorted join) one is enough."""
    kinds = {"key": pa.int64(), "sig": pa.int64(), "which": pa.int32(), "copies": pa.int64(), "crowded": pa.bool_(), "off": pa.int64(), "more": pa.int64()}
    last = None
    for batch in batches:
        text, wanted, ids = batch.column(2), batch.column(3), list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        rows: dict[str, list] = {k: [] for k in (*kinds, "bytes")}
        for i in range(batch.num_rows):
            if ids[i] == last:
                continue
            last, whole = ids[i], text[i].as_py()
            for w in wanted[i].as_py():
                for k in kinds:
                    rows[k].append(w[k])
                rows["bytes"].append(whole[w["first"] : w["past"]])
        if rows["key"]:
            yield pa.RecordBatch.from_pydict(rows, schema=pa.schema([*kinds.items(), ("bytes", pa.binary())]))


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Firsts and lasts of the runs of True."""
    step = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1) - 1


def marked(texts: list[bytes], twins: list[bool], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first, last) of the runs of positions whose ``length`` bytes occur elsewhere in the texts, of which ``twins`` are there twice."""
    lo, hi = runs_of(RunIndex.build(texts, twins).matching_statistics() >= length)  # matches stay inside texts, so runs do
    starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(starts, lo, side="right") - 1
    return text, lo - starts[text], hi - starts[text]


def _index(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by (anchor, segment); an index is built whenever whole anchors hold INDEXED bytes."""
        keys: list[int] = []
        rest: list[tuple] = []
        size = 0

        def flush() -> pa.RecordBatch:
            # the second of two segments with one hash is the first one's twin if all bytes are equal
            twin = [k == keys[i - 1] and r == rest[i - 1] if i else False for i, (k, r) in enumerate(zip(keys, rest, strict=True))]
            own = np.flatnonzero(~np.array(twin))
            text, lo, hi = marked([rest[i][1] for i in own], [i + 1 < len(rest) and twin[i + 1] for i in own.tolist()], length)
            out = [np.array(x, np.int64)[own[text]] for x in (keys, [r[0] for r in rest])]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (*out, lo, hi)], ["key", "sig", "lo", "hi"])

        for batch in batches:
            for key, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= INDEXED and key != keys[-1]:
                    yield flush()
                    keys, rest, size = [], [], 0
                keys.append(key)
                rest.append(tuple(row))
                size += len(row[1])
        if keys:
            yield flush()

    return run


def _repeated(keyed: DataFrame, found: DataFrame, length: int, slack: int, most: int) -> DataFrame:
    """(d1, d2, lo, hi): runs of windows, lo to hi, that occur more than once, in the open segments of ``found`` (SEGMENTS, a staged table, which is
    deleted); ``keyed`` (d1, d2, text binary) holds their texts."""
    n = partitions(keyed.sparkSession)
    again = found.groupBy("key").agg(F.sum("copies").alias("n"), F.max("open").alias("open")).where("n > 1 and open").select("key")
    again = staged(again, "met-anchors")  # a plain table: a skewed join with it can be split
    met = staged(found.join(again, "key"), "met-segments")
    unstage(found, again)

    place = F.struct("d1", "d2", "first", "more", "off")
    distinct = met.groupBy("key", "sig").agg(F.sum("copies").alias("copies"), F.min(place).alias("a"), F.max(place).alias("b"))
    distinct = staged(distinct, "distinct-segments")
    crowds = staged(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("key", F.lit(True).alias("crowded")), "crowded-anchors")
    several = not crowds.isEmpty()
    rated = distinct.join(crowds, "key", "left") if several else distinct.withColumn("crowded", F.lit(None).cast("boolean"))
    rated = rated.withColumn("crowded", F.coalesce("crowded", F.lit(False)))
    two = F.when((F.col("copies") > 1) & ~F.col("crowded"), F.array("a", "b")).otherwise(F.array("a"))
    wanted = rated.select("key", "sig", "copies", "crowded", F.posexplode(two).alias("which", "at"))
    wanted = wanted.select("at.d1", "at.d2", F.struct("key", "sig", "which", "copies", "crowded", "at.off", "at.more", "at.first", (F.col("at.first") + F.col("at.more") + length).alias("past")).alias("w"))
    wanted = wanted.groupBy("d1", "d2").agg(F.collect_list("w").alias("wanted"))
    cut = keyed.join(wanted, ["d1", "d2"]).select("d1", "d2", "text", "wanted").mapInArrow(lean(_cut), "key long, sig long, which int, copies long, crowded boolean, off long, more long, bytes binary")
    cut = staged(cut, "segment-bytes")
    unstage(distinct)
    # dealt by key first, so that dropping equal rows needs no shuffle of its own
    dealt = cut.where("not crowded").select("key", "sig", "which", "bytes").repartition(n, "key").dropDuplicates(["key", "sig", "which"])
    dealt = dealt.select("key", "sig", "bytes").sortWithinPartitions("key", "sig")
    verdict = dealt.mapInArrow(lean(_index(length)), "key long, sig long, lo long, hi long")
    if several:
        parents = staged(cut.where("crowded").dropDuplicates(["key", "sig"]), "crowded-segments")
        finer = staged(parents.select("key", "sig", "copies", "off", "more", "bytes").mapInArrow(lean(_part(length, slack)), SEGMENTS), "parted-segments")
        finer = _repeated(parents.select(F.col("key").alias("d1"), F.col("sig").alias("d2"), F.col("bytes").alias("text")), finer, length, slack // PARTS, most)
        verdict = verdict.unionAll(finer.select(F.col("d1").alias("key"), F.col("d2").alias("sig"), "lo", "hi"))
    verdict = staged(verdict, "verdicts")
    unstage(cut)
    return met.where("open").join(verdict, ["key", "sig"]).select("d1", "d2", (F.col("first") + F.col("lo")).alias("lo"), (F.col("first") + F.col("hi")).alias("hi"))


def repeated_spans(keyed: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST, known: DataFrame | None = None) -> DataFrame:
    """(d1, d2, spans array<struct<lo, hi>>): byte spans [lo, hi) to remove, by document; ``keyed`` has (d1, d2, text), text without nulls.

    ``known``, of the same columns as the result, has spans that are removed anyway: the result and they together cover every byte that the result alone
    would cover without them. It may leave out what they cover.
    """
    texts = keyed.select("d1", "d2", "text")
    found = staged((texts if known is None else texts.join(known, ["d1", "d2"], "left")).mapInArrow(lean(_find(length, anchor)), SEGMENTS), "segments")
    runs = _repeated(keyed.select("d1", "d2", F.col("text").cast("binary").alias("text")), found, length, length - anchor, most)
    return runs.groupBy("d1", "d2").agg(F.collect_set(F.struct("lo", (F.col("hi") + length).alias("hi"))).alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of the bytes that the spans cover."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans or ()):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def kept(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    return b"".join(text[a:b] for a, b in zip([0, *(hi for _, hi in runs)], [*(lo for lo, _ in runs), len(text)]))


def mark_repeats(docs: DataFrame, columns: list[str], length: int = LENGTH, anchor: int = ANCHOR, most: int = MOST, passages: tuple[int, int] | None = None) -> DataFrame:
    """``columns`` of docs, besides (text_ binary, spans_): the text's bytes and the spans that are to be removed.

    A byte is to be removed if a ``length``-byte string that covers it also starts anywhere else in the texts, the same
    text included. Null texts are empty; texts shorter than ``length`` lose nothing; repeated rows are each other's
    repeats, whatever their doc_id. An empty table gives an empty result. With ``passages``, a smaller length and its anchor, there is a column
    passages_ too: spans that together with spans_ cover what repeats at that length.
    """
    if any(not 1 <= a <= n for n, a in ((length, anchor), passages or (1, 1))) or (passages and passages[0] > length):
        raise ValueError("the anchor must fit into the length, and that of passages into the first")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(*[F.col(c).alias(f"c{i}_") for i, c in enumerate(columns)], text.alias("text"), F.xxhash64(text).alias("d1"), F.xxhash64(text, F.col("doc_id"), F.lit(1)).alias("d2"))
    spans = repeated_spans(keyed, length, anchor, most)
    if passages:
        spans = staged(spans, "spans")
        further = repeated_spans(keyed, *passages, most, known=spans)
        both = spans.select("d1", "d2", "spans", F.lit(False).alias("further_")).unionAll(further.select("d1", "d2", "spans", F.lit(True)))
        of = lambda further: F.first(F.when(F.col("further_") == further, F.col("spans")), ignorenulls=True)
        spans = both.groupBy("d1", "d2").agg(of(False).alias("spans"), of(True).alias("passages"))
    marked = [F.col(c).alias(f"{c}_") for c in spans.columns[2:]]
    return keyed.join(spans, ["d1", "d2"], "left").select(*[F.col(f"c{i}_").alias(c) for i, c in enumerate(columns)], F.col("text").cast("binary").alias("text_"), *marked)


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (doc_id, text, spans) the columns DIGEST, of (doc_id, text, spans, passages) DIGEST and PASSAGES."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "text", "n_repeated", "unrepeated_text"]
    for batch in sliced(batches):
        rows: list[list] = [[] for _ in names[1:]]
        further = batch.column(3) if batch.num_columns > 3 else [None] * batch.num_rows
        for text, spans, more in zip(batch.column(1), batch.column(2), further, strict=True):
            text, spans = text.as_py(), spans.as_py() or []
            runs = merged(spans)
            left = kept(text, runs)
            rest = left
            if more is not None and more.is_valid:
                rest = kept(text, merged(spans + more.as_py()))
            for own, x in zip(rows, (len(text), len(text) - len(left), len(runs), hashlib.sha256(left).hexdigest(), left.decode("utf-8", "ignore"), len(text) - len(rest), rest.decode("utf-8", "ignore")), strict=True):
                own.append(x)
        columns = [pa.array(r, pa.string() if n in ("kept_sha256", "text", "unrepeated_text") else pa.int64()) for n, r in zip(names[1:], rows, strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column(0), *columns], names)
        yield out if batch.num_columns > 3 else out.select(names[:6])


DIGEST = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, text string"
PASSAGES = "n_repeated long, unrepeated_text string"


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes that are left: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, text, n_repeated, unrepeated_text).

    ``text`` is what is left, without the bytes of a character that was cut through; the digest is of all bytes left. A null
    text is empty (0 bytes, the digest of nothing); texts under 400 bytes lose nothing. Repeated rows are each other's repeats
    and come back as often; rows without a doc_id are judged like others. No rows give no rows; other columns are ignored.
    ``unrepeated_text`` is what is left without any string of 240 bytes that repeats, so without nearly all repeated passages of over 50 words, and
    ``n_repeated`` counts the bytes that this takes away.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return mark_repeats(docs, ["doc_id"], passages=(PASSAGE, PASSAGE_ANCHOR)).mapInArrow(lean(_digest), f"{DIGEST}, {PASSAGES}")
