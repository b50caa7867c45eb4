"""Repeated byte strings by a depth-limited radix sort of suffixes, most significant digit first.

Two 100-byte strings are equal exactly when a sort of all suffixes to depth 100 leaves them in one
group. Every pass drops what is alone in its group, so most suffixes never travel:

* pass 0 thins the suffixes: in every 100-byte string the smallest 32-byte gram is its anchor. Equal
  strings have equal anchors at equal places, so they stand in one bucket per anchor; the run of
  strings that share an anchor is a stretch.
* pass 1 takes the anchor's gram as the first digit, by its hash: a gram whose hash is alone ends
  there. A hash decides nothing else.
* pass 2 reads the bytes of the stretches that are left and sorts them, within a portion of the
  texts, digit by digit of eight bytes to the left and to the right of the anchor, down to depth 100.
  What repeats within the portion is settled there, on bytes, and is not sent on.
* pass 3 does the same for what is open, over all portions, dealt by the gram.

A gram with many stretches is dealt deeper: its strings go one by one, by all of their 100 bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, text_or_empty, with_rows

DEPTH, GRAM = 100, 32
SPAN = DEPTH - GRAM + 1  # places of a gram in a string
#: Bytes of text that anchors are looked for in at a time, and stretches sorted at a time.
PORTION, STRETCHES = 1_500_000, 60_000
#: Stretches among which grams are looked for before they are dealt, and buckets of grams for each shuffle partition.
ANCHORS_HELD, BUCKETS = 400_000, 16
#: One text in so many is looked at for crowded grams; it only decides how the work is dealt.
SAMPLED = 50
#: Words of eight bytes that the right side (gram first) and the left side of an anchor are held in.
RIGHT, LEFT = -(-DEPTH // 8), -(-(DEPTH - GRAM) // 8)
_rng = np.random.default_rng(414243)
BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + _rng.integers(0, 2, 256, np.uint64)
BASE = np.uint64(int(_rng.integers(1, 1 << 62)) * 4 + 3)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
_FOLD = _rng.integers(0, 1 << 63, RIGHT + LEFT, np.uint64) * np.uint64(2) + np.uint64(1)
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and BASE^-i mod 2^64, for i under n."""
    if not _powers or len(_powers[0]) < n:
        m = max(n, PORTION + DEPTH + 1)
        _powers[:] = [np.cumprod(np.r_[np.uint64(1), np.full(m - 1, b, np.uint64)]) for b in (BASE, INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Of the gram at every place."""
    up, down = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * up[:-1], out=sums[1:])
    h = sums[GRAM:] - sums[:-GRAM]
    h *= down[: len(h)]
    return mix(h)


def hashes_of(grams: np.ndarray) -> np.ndarray:
    """The same hash of rows of GRAM bytes."""
    h = np.zeros(len(grams), np.uint64)
    for j, p in enumerate(powers(GRAM)[0]):
        h += BYTE[grams[:, j]] * p
    return mix(h)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...]:
    """(document, start, strings, anchor less start, gram hash) of all stretches in concatenated documents."""
    n = ends - starts
    full = n >= DEPTH
    if not full.any():
        return (np.empty(0, np.int64),) * 4 + (np.empty(0, np.uint64),)
    grams = gram_hashes(data)
    place = np.uint64((1 << 24) - 1)
    marked = (grams & ~place) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_sliding_min(marked, SPAN) & place).astype(np.int32)
    inside = np.zeros(len(anchor) + 1, np.int8)
    inside[starts[full]] += 1
    inside[ends[full] - DEPTH + 1] -= 1
    at = np.flatnonzero(np.cumsum(inside[:-1]))
    # runs of strings of one document with one anchor
    new = np.ones(len(at), bool)
    new[1:] = (anchor[at[1:]] != anchor[at[:-1]]) | (at[1:] != at[:-1] + 1)
    first = np.flatnonzero(new)
    lo, strings = at[first], np.diff(np.r_[first, len(at)])
    doc = np.searchsorted(starts, lo, side="right") - 1
    return doc, lo, strings, anchor[lo] - lo, grams[anchor[lo]]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of an Arrow column without nulls, and where each text starts and ends in them."""
    _, offsets, data = texts.buffers()
    kind = np.dtype(np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32)
    offsets = np.frombuffer(offsets, kind, len(texts) + 1, kind.itemsize * texts.offset) if len(texts) else np.zeros(1, kind)
    return np.frombuffer(data or b"", np.uint8), offsets.astype(np.int64)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    """(bytes, starts, ends, keys, offsets) of about PORTION bytes of whole documents; a longer
    document comes in overlapping pieces that share no string, with the ``offset`` of the piece."""
    for b in batches:
        data, edges = _bytes_of(b["text"])
        keys = b["key"].to_numpy()
        i = 0
        while i < len(keys):
            j = max(i + 1, int(np.searchsorted(edges, edges[i] + PORTION, side="right")) - 1)
            own, zero = edges[i : j + 1], edges[i]
            if own[-1] - zero <= PORTION + DEPTH:
                yield data[zero : own[-1]], own[:-1] - zero, own[1:] - zero, keys[i:j], np.zeros(j - i, np.int64)
            else:
                for at in range(0, int(own[-1] - zero), PORTION):
                    piece = data[zero + at : min(zero + at + PORTION + DEPTH - 1, own[-1])]
                    yield piece, np.zeros(1, np.int64), np.full(1, len(piece)), keys[i:j], np.full(1, at)
            i = j


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(gram hash, stretches) of each portion, and (null, all stretches)."""
    for data, starts, ends, _, _ in _portions(batches):
        grams, n = np.unique(stretches(data, starts, ends)[4], return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([None, *grams.view(np.int64).tolist()], pa.int64()), pa.array([int(n.sum()), *n.tolist()], pa.int64())], ["g", "n"])


def crowded_grams(texts: DataFrame, sampled: int | None = None) -> list[int]:
    """Hashes of grams that hold more than a quarter of a shuffle partition's share of all stretches, by
    a sample of the texts that grows with them. At most four for each partition."""
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = texts.filter(F.pmod(F.xxhash64("key"), F.lit(sampled or SAMPLED)) == 0)
    counted = some.mapInArrow(_frequent, "g long, n long").groupBy("g").agg(F.sum("n").alias("n"))
    total = F.max(F.when(F.col("g").isNull(), F.col("n")))
    most = counted.filter("n >= 16").orderBy(F.col("g").isNotNull(), F.desc("n"), "g").limit(4 * parts + 1).agg(total.alias("t"), F.collect_list(F.struct("g", "n")).alias("top")).first()
    return [r["g"] for r in most["top"] if r["g"] is not None and 4 * parts * r["n"] > most["t"]]


def _pack(a: np.ndarray, b: np.ndarray) -> bytes:
    return np.stack([a, b]).astype(np.int32).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.int32).reshape(2, -1).astype(np.int64)


def _groups(sorted_ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of equal ids."""
    cuts = np.flatnonzero(sorted_ids[1:] != sorted_ids[:-1]) + 1
    edges = [0, *cuts.tolist(), len(sorted_ids)]
    yield from zip(edges, edges[1:], strict=False)


def planes(*columns: np.ndarray) -> bytes:
    """Columns of 64 bits as planes of bytes, most of which are zeros."""
    return np.ascontiguousarray(np.stack(columns, axis=1).astype(np.int64).view(np.uint8).T).tobytes()


def unplanes(data: bytes, n: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8 * n, -1).T).view(np.int64).T


ANCHORS = "bucket int, key long, data binary"


def _anchors(batches: Iterator[pa.RecordBatch], crowded: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """For each bucket of grams, packed (gram, key, place): places are start and meta in one number.

    Stretches of a crowded gram, or of one that these texts hold more than once, need no other to be
    open: they come in one packed row per document (with its key), and the latter send one notice
    (place -1) to others of their gram."""
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[pa.RecordBatch]:
        key, at, g = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        _, first, inverse, counts = np.unique(g, return_index=True, return_inverse=True, return_counts=True)
        apart = np.isin(g.view(np.int64), crowded)
        known = apart | (counts[inverse] > 1)
        notice = np.zeros(len(g), bool)
        notice[first[counts > 1]] = True
        notice &= ~apart
        rows = np.flatnonzero(~known | notice)
        bucket = (g[rows] % np.uint64(buckets)).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        rows, bucket = rows[order], bucket[order]
        place = np.where(notice, -1, at)
        if len(rows):
            cuts = list(_groups(bucket))
            data = [planes(g[rows[a:b]].view(np.int64), np.diff(key[rows[a:b]], prepend=0), place[rows[a:b]]) for a, b in cuts]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[[a for a, _ in cuts]]), pa.nulls(len(cuts), pa.int64()), pa.array(data, pa.binary())], ["bucket", "key", "data"])
        rows = np.flatnonzero(known)
        if len(rows):
            cuts = list(_groups(key[rows]))
            own = key[rows[[a for a, _ in cuts]]]
            bucket = (mix(own.view(np.uint64).copy()) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(own), pa.array([at[rows[a:b]].tobytes() for a, b in cuts], pa.binary())], ["bucket", "key", "data"])

    for data, starts, ends, keys, offsets in _portions(batches):
        doc, lo, n, ahead, g = stretches(data, starts, ends)
        if len(doc):
            held.append((keys[doc], (lo - starts[doc] + offsets[doc]) << 16 | ahead << 8 | n, g))
            if sum(len(x[0]) for x in held) >= ANCHORS_HELD:
                yield from flush()
    if held:
        yield from flush()


def _not_alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, at, packed): of rows sorted by bucket, the packed ones, and the places whose gram another has."""
    held: list[bytes] = []
    now = None

    def flush() -> pa.RecordBatch:
        g, key, at = np.concatenate([unplanes(x, 3) for x in held], axis=1)
        key = np.concatenate([np.cumsum(unplanes(x, 3)[1]) for x in held])
        held.clear()
        order = np.argsort(g)
        g = g[order]
        equal = g[1:] == g[:-1]
        rows = order[(np.r_[False, equal] | np.r_[equal, False]) & (at[order] >= 0)]
        return pa.RecordBatch.from_arrays([pa.array(key[rows]), pa.array(at[rows]), pa.nulls(len(rows), pa.binary())], ["key", "at", "packed"])

    for b in batches:
        known = b.filter(b["key"].is_valid())
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([known["key"], pa.nulls(known.num_rows, pa.int64()), known["data"]], ["key", "at", "packed"])
        b = b.filter(b["key"].is_null())
        for bucket, data in zip(b["bucket"].to_pylist(), b["data"].to_pylist(), strict=True):
            if bucket != now and held:
                yield flush()
            now = bucket
            held.append(data)
    if held:
        yield flush()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and where each list ends among them; null is empty."""
    n = column.value_lengths().fill_null(0).to_numpy()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.cumsum(n)


# --- the sort of stretches ------------------------------------------------------------------------


def radix(group: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by group, then by words from the most significant; and for each place in it the
    number of bytes that its row has in common with the one before (-1: another group). A pass only
    touches rows that are still tied."""
    order = np.argsort(group, kind="stable")
    same = np.full(len(group), -1)
    own = group[order]
    tied = np.zeros(len(group), np.int64)  # ties have one number
    tied[1:] = np.cumsum(own[1:] != own[:-1])
    at = np.arange(len(group))
    for k in range(words.shape[1]):
        size = np.bincount(tied[at]) if len(at) else np.zeros(1, np.int64)
        at = at[size[tied[at]] > 1]
        if not len(at):
            break
        digit = words[order[at], k]
        sub = np.lexsort((digit, tied[at]))
        order[at], digit = order[at][sub], digit[sub]
        inner = np.r_[False, tied[at][1:] == tied[at][:-1]]
        apart = inner & np.r_[False, digit[1:] != digit[:-1]]
        differ = digit[1:][apart[1:]] ^ digit[:-1][apart[1:]]
        same[at[apart]] = 8 * k + sum((differ >> np.uint64(64 - 8 * i)) == 0 for i in range(1, 8))
        # rows that part from the one before get new numbers, in order
        tied[at] = np.cumsum(np.r_[True, ~inner[1:] | apart[1:]]) - 1
    if len(at):
        inner = np.r_[False, tied[at][1:] == tied[at][:-1]]
        same[at[inner]] = 8 * words.shape[1]
    return order, same


def settle(group: np.ndarray, left: np.ndarray, right: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For rows in the order of (document, start): whether the string that starts d bytes before a row's
    anchor, d from ``low`` to ``high``, also stands in an earlier row of the group. Rows x SPAN."""
    m = len(group)
    again = np.zeros((m, SPAN), bool)
    offsets = np.arange(SPAN)
    has = (low[:, None] <= offsets) & (offsets <= high[:, None])
    # rows equal in all bytes and places: found next to each other by a hash, verified on the bytes
    words = np.concatenate([right, left], axis=1)
    code = (words * _FOLD).sum(1, dtype=np.uint64) + (group * 128 + low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + high.astype(np.uint64)
    order = np.argsort(code, kind="stable")
    a, b = order[1:], order[:-1]
    equal = (code[a] == code[b]) & (group[a] == group[b]) & (low[a] == low[b]) & (high[a] == high[b])
    equal[equal] = (words[a[equal]] == words[b[equal]]).all(1)
    again[a[equal]] = has[a[equal]]
    rest = np.ones(m, bool)
    rest[a[equal]] = False
    size = np.bincount(group[rest], minlength=int(group.max()) + 1 if m else 0)
    rows = np.flatnonzero(rest & (size[group] > 1))
    if not len(rows):
        return again
    group, low, high = group[rows], low[rows], high[rows]
    (lorder, lsame), (rorder, rsame) = radix(group, left[rows]), radix(group, right[rows])
    lid, rid = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    for d in range(int(low.min()), int(high.max()) + 1):
        on = np.flatnonzero((low <= d) & (d <= high))
        if len(on) < 2:
            continue
        lid[lorder] = np.cumsum(lsame < d)
        rid[rorder] = np.cumsum(rsame < DEPTH - d)
        pair = lid[on] * len(rows) + rid[on]
        order = np.argsort(pair, kind="stable")
        repeated = on[order[1:][pair[order[1:]] == pair[order[:-1]]]]
        again[rows[repeated], d] = True
    return again


def _words(rows: np.ndarray, n: int) -> np.ndarray:
    """Rows of bytes as words whose order is that of the bytes."""
    return np.ascontiguousarray(rows[:, : 8 * n]).view(">u8").astype(np.uint64)


def sides(data: np.ndarray, anchor: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the ``before`` bytes to the left of each anchor, nearest first, and of the ``after``
    bytes from the anchor on; zeros beyond."""
    padded = np.r_[np.zeros(8 * LEFT, np.uint8), data, np.zeros(8 * RIGHT, np.uint8)]
    right = np.lib.stride_tricks.sliding_window_view(padded, 8 * RIGHT)[anchor + 8 * LEFT]
    left = np.lib.stride_tricks.sliding_window_view(padded, 8 * LEFT)[anchor][:, ::-1]
    right[after[:, None] <= np.arange(8 * RIGHT)] = 0
    left[before[:, None] <= np.arange(8 * LEFT)] = 0
    return _words(left, LEFT), _words(right, RIGHT)


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first column, columns) of the runs of true values in each row of a matrix."""
    edged = np.zeros((len(flags), flags.shape[1] + 2), np.int8)
    edged[:, 1:-1] = flags
    change = np.diff(edged, axis=1)
    row, start = np.nonzero(change == 1)
    return row, start, np.nonzero(change == -1)[1] - start


OPEN = "deal long, key long, lo int, ahead int, bytes binary"
_OPEN_NAMES = ["deal", "key", "lo", "ahead", "bytes"]


def _open(batches: Iterator[pa.RecordBatch], crowded: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Settles what repeats among some STRETCHES stretches; the rest goes on with its bytes. ``ahead`` of
    -1 marks the settled runs of a document, packed."""
    held: list[tuple[int, np.ndarray, int, np.ndarray]] = []  # key, bytes, place of the first, (starts, metas)
    waiting = 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal held, waiting
        sizes = [len(x[1]) for x in held]
        many = [x[3].shape[1] for x in held]
        zero = np.repeat(np.cumsum([0, *sizes[:-1]]) - np.array([x[2] for x in held]), many)
        data = np.concatenate([x[1] for x in held])
        key = np.repeat(np.array([x[0] for x in held], np.int64), many)
        lo, meta = np.concatenate([x[3] for x in held], axis=1)
        held, waiting = [], 0
        order = np.lexsort((lo, key))
        key, lo, meta, zero = key[order], lo[order], meta[order], zero[order]
        n, ahead = meta & 255, meta >> 8
        left, right = sides(data, zero + lo + ahead, ahead, n + DEPTH - 1 - ahead)
        grams = hashes_of(right[:, : GRAM // 8].astype(">u8").view(np.uint8).reshape(-1, GRAM))
        _, group = np.unique(grams, return_inverse=True)
        again = settle(group, left, right, ahead - n + 1, ahead)
        # as places from the start on, not back from the anchor
        row, first, many = runs_of(again)
        start = lo[row] + ahead[row] - (first + many - 1)
        yield from settled(key[row], start, many)
        offsets = np.arange(SPAN)
        still = ((ahead - n + 1)[:, None] <= offsets) & (offsets <= ahead[:, None]) & ~again
        apart = np.isin(grams.view(np.int64), crowded)
        # crowded grams: string by string; others: from the first open string to the last
        row, d = np.nonzero(still & apart[:, None])
        begin, end, source, back = [zero[row] + lo[row] + ahead[row] - d], [zero[row] + lo[row] + ahead[row] - d + DEPTH], [row], [np.zeros(len(row), np.int64)]
        row = np.flatnonzero(still.any(1) & ~apart)
        least, most = still[row].argmax(1), SPAN - 1 - still[row][:, ::-1].argmax(1)
        at = zero[row] + lo[row] + ahead[row]
        begin, end, source, back = [np.concatenate(x) for x in ([*begin, at - most], [*end, at - least + DEPTH], [*source, row], [*back, most])]
        whole = data.tobytes()
        # a string's deal is a fold of all its bytes, a stretch's the hash of its gram
        deal = grams[source].copy()
        alone = apart[source]
        size = np.full(int(alone.sum()), DEPTH)
        deal[alone] = mix((sides(data, begin[alone], size, size)[1] * _FOLD[:RIGHT]).sum(1, dtype=np.uint64))
        for a in range(0, len(source), STRETCHES):
            s = slice(a, a + STRETCHES)
            yield pa.RecordBatch.from_arrays(
                [pa.array(deal[s].view(np.int64)), pa.array(key[source[s]]), pa.array((begin[s] - zero[source[s]]).astype(np.int32)), pa.array(back[s].astype(np.int32)),
                 pa.array([whole[x:y] for x, y in zip(begin[s].tolist(), end[s].tolist(), strict=True)], pa.binary())],
                _OPEN_NAMES)

    def settled(key, start, many) -> Iterator[pa.RecordBatch]:
        if len(key):
            order = np.lexsort((start, key))
            key, start, many = key[order], start[order], many[order]
            # runs that touch are one
            joined = np.r_[False, (key[1:] == key[:-1]) & (start[1:] == start[:-1] + many[:-1])]
            first = np.flatnonzero(~joined)
            key, start, many = key[first], start[first], np.add.reduceat(many, first)
            cuts = list(_groups(key))
            own = key[[a for a, _ in cuts]]
            deal = mix(own.view(np.uint64).copy()).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(deal), pa.array(own), pa.array(np.zeros(len(own), np.int32)), pa.array(np.full(len(own), -1, np.int32)), pa.array([_pack(start[a:b], many[a:b]) for a, b in cuts], pa.binary())], _OPEN_NAMES)

    for b in batches:
        data, edges = _bytes_of(b["text"])
        ats, ends = _lists(b["ats"])
        for i, (key, packs) in enumerate(zip(b["key"].to_pylist(), b["packs"].to_pylist(), strict=True)):
            at = np.sort(np.concatenate([ats[ends[i - 1] if i else 0 : ends[i]], *[np.frombuffer(x, np.int64) for x in packs or ()]]))
            lo, meta = at >> 16, at & 0xFFFF
            for a in range(0, len(at), STRETCHES):
                some = np.stack([lo[a : a + STRETCHES], meta[a : a + STRETCHES]])
                first, last = int(some[0, 0]), int(some[0, -1]) + 2 * DEPTH
                held.append((key, data[edges[i] + first : min(edges[i] + last, edges[i + 1])], first, some))
                waiting += some.shape[1] + (last - first) // 200
                if waiting >= STRETCHES:
                    yield from flush()
    if held:
        yield from flush()


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, lo, n): the strings that also start earlier, of rows sorted by (deal, key, lo)."""
    names = ["key", "lo", "n"]
    held: list[pa.RecordBatch] = []
    seen: pa.RecordBatch | None = None  # rows of the group at hand that have gone out, each once
    waiting = 0

    def out(key, lo, n):
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(lo.astype(np.int32)), pa.array(n.astype(np.int32))], names)

    def flush(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, seen, waiting
        parts = ([seen] if seen is not None else []) + held
        done = seen.num_rows if seen is not None else 0
        rows = pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        deal, key, lo, ahead = (rows[c].to_numpy() for c in _OPEN_NAMES[:4])
        ahead = ahead.astype(np.int64)
        _, offsets, data = rows["bytes"].buffers()
        offsets = np.frombuffer(offsets, np.int32, len(rows["bytes"]) + 1, 4 * rows["bytes"].offset).astype(np.int64)
        n = np.diff(offsets) - DEPTH + 1
        left, right = sides(np.frombuffer(data, np.uint8), offsets[:-1] + ahead, ahead, n + DEPTH - 1 - ahead)
        group = np.r_[0, np.cumsum(deal[1:] != deal[:-1])]
        again = settle(group, left, right, ahead - n + 1, ahead)
        row, first, many = runs_of(again)
        new = row >= done
        row, first, many = row[new], first[new], many[new]
        held, waiting, seen = [], 0, None
        if not last:  # rows of the last group that repeat nothing in full stand for it from now on
            at = np.flatnonzero((group == group[-1]) & (again.sum(1) < n))
            seen = rows.take(pa.array(at))
        yield out(key[row], lo[row] + ahead[row] - (first + many - 1), many)

    for b in batches:
        packed = b["ahead"].to_numpy() < 0
        for i in np.flatnonzero(packed).tolist():
            lo, n = _unpack(b["bytes"][i].as_py())
            yield out(np.full(len(lo), b["key"][i].as_py()), lo, n)
        if packed.any():
            b = b.filter(pa.array(~packed))
        for a in range(0, b.num_rows, STRETCHES):
            part = b.slice(a, STRETCHES)
            held.append(part)
            waiting += part.num_rows
            if waiting >= STRETCHES:
                yield from flush(False)
    if held:
        yield from flush(True)


def covered(texts: DataFrame, sampled: int | None = None) -> DataFrame:
    """(key, doc_id, text) -> (key, lo, n): strings that also start earlier, as runs of n from lo on."""
    thin = texts.select("key", "text")
    crowded = np.array(crowded_grams(thin, sampled), np.int64)
    buckets = BUCKETS * int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    anchors = thin.mapInArrow(lambda batches: _anchors(batches, crowded, buckets), ANCHORS)
    left = anchors.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_not_alone, "key long, at long, packed binary")
    left = left.groupBy("key").agg(F.collect_list("at").alias("ats"), F.collect_list("packed").alias("packs"))
    both = texts.join(left, "key").sortWithinPartitions("key").select("key", "doc_id", "text", "ats", "packs")
    opened = both.mapInArrow(lambda batches: _open(batches, crowded), OPEN)
    return opened.repartition("deal").sortWithinPartitions("deal", "key", "lo").mapInArrow(_repeated, "key long, lo int, n int")


def _cut(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        for b in batches:
            out: list[tuple] = []
            data, edges = _bytes_of(b["text"])
            runs, ends = _lists(b["runs"])
            for i in range(b.num_rows):
                own, mine, spans = data[edges[i] : edges[i + 1]], runs[ends[i - 1] if i else 0 : ends[i]], 0
                kept = own
                if len(mine):
                    lo, n = mine >> 32, mine & 0xFFFFFFFF
                    edge = np.zeros(len(own) + 1, np.int32)
                    np.add.at(edge, lo, 1)
                    np.add.at(edge, lo + n + DEPTH - 1, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    kept = own[~gone]
                    spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                kept = kept.tobytes()
                out.append((len(own), len(own) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept if full else None))
            columns = [pa.array(v, t) for v, t in zip(zip(*out, strict=True), types, strict=True)] if out else [pa.array([], t) for t in types]
            k = 5 if full else 4
            yield pa.RecordBatch.from_arrays([b["doc_id"], *columns[:k]], ["doc_id", *names[:k]])

    return run


def remove_repeats(docs: DataFrame, text_col: str = "text", full: bool = False, sampled: int | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row; ``full`` adds kept (binary).

    Every byte of a 100-byte string that also starts earlier goes: in a smaller doc_id, or earlier
    in the same document. Null texts are empty; texts under 100 bytes lose nothing. Where ids
    repeat or are null (last), documents are ordered by id and then by text. An empty table gives
    an empty result; other columns are not looked at. Strings are equal where their bytes are.
    ``sampled``: one text in so many tells which grams are crowded (all results are the same).
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    total, ids = rows.select("doc_id").agg(F.count(F.lit(1)), F.count_distinct("doc_id")).first()
    if total == ids:
        keyed = rows.withColumn("key", F.col("doc_id"))
    else:
        keyed = with_rows(rows, "key", then=("text",))
    # keys are never null; said here, so that both joins below see the same texts
    keyed = keyed.filter("key IS NOT NULL").select("key", "doc_id", "text")
    runs = covered(keyed, sampled).groupBy("key").agg(F.collect_list(F.shiftleft(F.col("lo").cast("long"), 32) + F.col("n")).alias("runs"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * full
    # the same exchange of the texts as in covered(), so that they are shuffled once
    return keyed.join(runs, "key", "left").select("key", "doc_id", "text", "runs").mapInArrow(_cut(full), schema)


def query(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))
