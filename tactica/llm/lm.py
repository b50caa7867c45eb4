"""Language-model scores: a hashed maximum-entropy model with a softmax at every node of a tree of classes.

A token is predicted by a few 16-way choices, classes first, down a tree whose leaves are words: the more frequent a
word, the fewer choices (a Shannon code). Each choice is a softmax over features of what stands
before: the last word, the last two words, and the last but one alone (a skip). Rare words share
leaves, where each keeps its share of the corpus counts.

Tokens are dealt by the last word (very common ones also by the word before) over shards of about
equal size, as many as the corpus needs, so the model grows with the corpus. A feature hashes to a
row of weights in its shard, with a tag that tells it from others of the same row; what loses its
row to another, or stands with one training token only, has none. A shard trains by adaptive gradient steps and then
scores its tokens, in one task. Weights of the skip hold within a shard, and so do those of words that are dealt over
several: a shard's updates are not exchanged with others.

Shards, steps and tables follow from ids, words and training counts alone, so scores depend neither on how
the texts lie in partitions nor on which other texts are held out.

Counts cover all training texts. Those of the FREQUENT most frequent words go to the tasks; all other
words are dealt by their hash over the same shards, where they meet their counts. So texts are read
twice: to count, and to deal tokens to shards.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, table, text_or_empty, with_rows

#: Words that have a leaf of their own and whose counts go to the tasks: so many of the most frequent at most.
FREQUENT = 250_000
#: Choices at every node of the tree of words, and its greatest depth.
FAN, DEPTH = 16, 5
#: Leaves that the rare words share, and ids that tell them apart as contexts.
SHARED, RARE_IDS = 4_096, 1 << 20
#: Tokens that one shard learns from, about.
SHARD = 250_000
BATCH, RATE, EPOCHS = 8_192, 0.4, 1
#: A shard has two to four rows of weights for each of its tokens, and 2 ** LEAST_BITS at least.
LEAST_BITS = 12
#: Choices that the skip, and features at all, take part in.
SKIP_DEPTHS, FEATURE_DEPTHS = 1, 5
ONES, PLACES = np.ones(FAN, np.float32), np.arange(BATCH) * FAN
#: Bytes of texts that are split, and counted, at a time.
PORTION, COUNTED = 2_600_000, 16_000_000
END = b""


def portions(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """About ``size`` bytes of whole texts at a time; a text is never parted."""
    held: list[pa.RecordBatch] = []
    waiting = 0
    for b in batches:
        start = 0
        for i, n in enumerate(pc.binary_length(b["text"]).to_pylist()):
            waiting += n + 8
            if waiting >= size:
                yield pa.Table.from_batches([*held, b.slice(start, i + 1 - start)])
                held, waiting, start = [], 0, i + 1
        held.append(b.slice(start))
    if sum(b.num_rows for b in held):
        yield pa.Table.from_batches(held)


def tokens(texts: pa.ChunkedArray) -> tuple[np.ndarray, pa.BinaryArray, np.ndarray]:
    """(tokens of each text, distinct words with the end of a text as the last, all tokens as places among them)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.combine_chunks()))
    values = lists.flatten()
    real = pc.greater(pc.binary_length(values), 0)  # the split leaves empty pieces at the ends of a text
    of = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy())[real.to_numpy(zero_copy_only=False)]
    coded = values.filter(real).dictionary_encode()
    lengths = np.bincount(of, minlength=len(lists)) + 1
    words = pa.concat_arrays([coded.dictionary.cast(pa.binary()), pa.array([END], pa.binary())])
    codes = np.full(lengths.sum(), len(words) - 1)
    inner = np.ones(len(codes), bool)
    inner[np.cumsum(lengths) - 1] = False
    codes[inner] = coded.indices.to_numpy()
    return lengths, words, codes


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n) over all tokens, the end of a text among them as the empty word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in portions(batches, COUNTED):
            _, words, codes = tokens(part["text"])
            yield pa.RecordBatch.from_arrays([words, pa.array(np.bincount(codes, minlength=len(words)))], ["word", "n"])

    return texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Vocabulary:
    """Ids of words: 0 for the start of a text, then frequent words by rank, then hashes of rare ones."""

    def __init__(self, frequent: list[tuple[bytes, int]]):
        self.ranked = sorted(frequent, key=lambda x: (-x[1], x[0]))
        self.index = {w: i + 1 for i, (w, _) in enumerate(self.ranked)}
        self.size = len(self.ranked)
        self.log_count = np.log10(np.array([0.1] + [n + 0.1 for _, n in self.ranked]))

    def ids(self, words: Sequence[bytes]) -> np.ndarray:
        return self.ids_and_hashes(words)[0]

    def ids_and_hashes(self, words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The id of each word; which words are rare, and their CRC-32."""
        ids = np.fromiter(map(self.index.get, words, repeat(0)), np.int64, len(words))
        rare = np.flatnonzero(ids == 0)
        hashes = np.fromiter((zlib.crc32(words[i]) for i in rare.tolist()), np.int64, len(rare))
        ids[rare] = self.size + 1 + hashes % RARE_IDS
        return ids, rare, hashes


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


class Tree:
    """A leaf for every frequent word and SHARED for the others: FAN-ary codes of about log(1 / mass) digits."""

    def __init__(self, mass: np.ndarray, n_frequent: int):
        """``mass``: of the frequent words by rank, then of the shared leaves; sums to 1."""
        self.mass, self.n_frequent = mass, n_frequent
        length = np.clip(np.ceil(-np.log(np.maximum(mass, 1e-12)) / math.log(FAN) - 1e-9), 1, None).astype(np.int64)
        while True:  # no code longer than DEPTH: the longest are shortened, then others lengthened until all fit
            length = np.minimum(length, DEPTH)
            if (float(FAN) ** -length).sum() <= 1:
                break
            length[np.flatnonzero(length < DEPTH)[-max(1, len(length) // 64) :]] += 1
        order = np.argsort(length, kind="stable")
        width = FAN ** (DEPTH - length[order])
        self.leaf = np.empty(len(mass), np.int64)  # first place of the leaf among FAN ** DEPTH
        self.leaf[order] = np.cumsum(width) - width
        self.leaf_depth = length
        full = np.zeros(FAN**DEPTH)
        full[self.leaf] = mass
        depth_at = np.zeros(FAN**DEPTH, np.int8)
        depth_at[self.leaf] = length
        self.bias, self.ends = [], []
        for d in range(DEPTH):
            shares = full.reshape(FAN**d, FAN, -1).sum(2)
            shares = np.maximum(shares, 1e-30 + 1e-9 * shares.sum(1, keepdims=True))
            self.bias.append(np.log(shares / shares.sum(1, keepdims=True)).astype(np.float32))
            self.ends.append((depth_at.reshape(FAN**d, -1)[:, 0] <= d) & (depth_at.reshape(FAN**d, -1)[:, 0] > 0))
        self.log_mass = np.log(np.maximum(mass, 1e-300))

    def at(self, ids: np.ndarray) -> np.ndarray:
        """The leaf number of each id."""
        return np.where(ids <= self.n_frequent, ids - 1, self.n_frequent + (ids - 1 - self.n_frequent) % SHARED)


class Features:
    """The live features of tokens that choose at one depth: for each kind, which tokens have it and their rows
    of weights. A feature lives if it stands with two training tokens or more, for all else its weights could
    only tell a token of itself."""

    def __init__(self, keys: np.ndarray, learnt: np.ndarray):
        learn = np.flatnonzero(learnt > 0)
        bits = max(LEAST_BITS, int(2 * len(learn)).bit_length())
        rows, tags = (keys >> np.uint64(64 - bits)).astype(np.int32), keys.astype(np.uint16)
        tags[tags == 0] = 1  # 0 is no tag
        # a row belongs to the last that claims it, so rather to a frequent feature
        owner = np.zeros(1 << bits, np.uint16)
        owner[rows.take(learn, axis=1).ravel()] = tags.take(learn, axis=1).ravel()
        live = owner.take(rows) == tags
        many = np.bincount(rows[live], np.broadcast_to(learnt, live.shape)[live], 1 << bits) > 1
        live &= many.take(rows)
        # only rows that live have weights, in the same order, so that a shard's table fits a cache; the last
        # stays zero and stands for all features that do not live
        self.count = int(np.count_nonzero(many))
        number = np.cumsum(many, dtype=np.int32)
        self.rows = np.where(live, number.take(rows) - 1, self.count)
        self.weights, self.square = np.zeros((self.count + 1, FAN), np.float32), np.full(self.count + 1, 1e-4, np.float32)
        self.any = live.any(0)

    def odds(self, bias: np.ndarray, node: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Exponentials of the choices' logits of a batch, from the nodes and the rows of each kind."""
        z = bias.take(node, axis=0)
        for r in rows:
            z += self.weights.take(r, axis=0)
        # shares are at least e^-23 and weights move by steps of RATE, so 32-bit exponentials do not overflow
        return np.exp(np.minimum(z, 80.0, out=z), out=z)

    def step(self, bias: np.ndarray, node: np.ndarray, target: np.ndarray, many: np.ndarray, on: np.ndarray) -> None:
        """Gradient steps over the tokens ``on``, BATCH at a time, each row of weights at its own pace."""
        node, target, many, all_rows = node.take(on), target.take(on), many.take(on), self.rows.take(on, axis=1)
        for a in range(0, len(on), BATCH):
            rows = all_rows[:, a : a + BATCH]
            g = self.odds(bias, node[a : a + BATCH], rows)
            g *= (1 / (g @ ONES))[:, None]
            g.ravel()[PLACES[: len(g)] + target[a : a + BATCH]] -= 1
            g *= many[a : a + BATCH, None]
            # rows and places in one number: a sort of values costs less than one of places
            both = (rows.astype(np.int64) << 32 | np.arange(len(g))).ravel()
            both = both[both < self.count << 32]
            both.sort()
            own, change = sums_by_row(both >> 32, both & 0xFFFFFFFF, g)
            square = self.square.take(own) + np.einsum("ij,ij->i", change, change) / FAN
            self.square[own] = square
            change *= (RATE / np.sqrt(square))[:, None]
            self.weights[own] -= change


def sums_by_row(rows: np.ndarray, at: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows, and for each the sum of ``g`` over its places: bit for bit what np.add.reduceat gives for sorted
    rows, which adds up to eight one after the other to the first, but many short ones at a time."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    lengths = np.diff(np.r_[starts, len(rows)])
    order = np.argsort(np.minimum(lengths, 9).astype(np.uint8), kind="stable")[::-1]  # longest first
    starts, lengths = starts.take(order), lengths.take(order)
    more = np.searchsorted(-lengths, -np.arange(10), side="left").tolist()  # [n]: how many are longer than n
    out = g.take(at.take(starts), axis=0)
    if long := more[8]:
        ends = np.cumsum(lengths[:long])
        places = np.arange(ends[-1]) + np.repeat(starts[:long] - ends + lengths[:long], lengths[:long])
        out[:long] = np.add.reduceat(g.take(at.take(places), axis=0), ends - lengths[:long], axis=0)
    if more[1] > long:
        rest = g.take(at.take(starts[long : more[1]] + 1), axis=0)
        for n in range(2, 8):
            if more[n] > long:
                rest[: more[n] - long] += g.take(at.take(starts[long : more[n]] + n), axis=0)
        out[long : more[1]] += rest
    return rows.take(starts), out


def gains(tree: Tree, leaf: np.ndarray, contexts: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """Of cases (a word after two others) that stand ``learnt`` times in training texts: steps over those that do,
    in their order; then, of all, the natural log of the leaf's probability less that of its share. Depths have their own weights and come one after the other; the skip only takes part in
    the first SKIP_DEPTHS choices, and from FEATURE_DEPTHS on the shares alone decide."""
    place, out = tree.leaf[leaf], np.zeros(len(leaf))
    for d in range(FEATURE_DEPTHS):
        node = place // FAN ** (DEPTH - d)
        on = np.flatnonzero(~tree.ends[d][node])
        if not len(on):
            continue
        node, target = node[on], place[on] // FAN ** (DEPTH - d - 1) % FAN
        keys = _mix(contexts[: 3 if d < SKIP_DEPTHS else 2, on] + node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        learns = learnt[on].astype(np.float32)
        features = Features(keys, learns)
        own = np.flatnonzero((learns > 0) & features.any)
        for _ in range(EPOCHS):
            features.step(tree.bias[d], node, target, learns, own)
        own = np.flatnonzero(features.any)
        on, node, target, rows = on.take(own), node.take(own), target.take(own), features.rows.take(own, axis=1)
        for a in range(0, len(own), BATCH):
            z = features.odds(tree.bias[d], node[a : a + BATCH], rows[:, a : a + BATCH])
            choice = target[a : a + BATCH]
            out[on[a : a + BATCH]] += np.log(z.take(PLACES[: len(z)] + choice) / (z @ ONES)) - tree.bias[d].take(node[a : a + BATCH] * FAN + choice)
    return out


def before(places: np.ndarray, lengths: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray]:
    """The place before each token and the one before that, within its text; ``start`` where there is none."""
    starts = np.cumsum(lengths) - lengths
    last, skip = np.roll(places, 1), np.roll(places, 2)
    last[starts] = start
    skip[starts] = start
    skip[starts[lengths > 1] + 1] = start
    return last, skip


def contexts_of(last: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Three context hashes of every token: the last word, the last two, the last but one."""
    last, skip = last.astype(np.uint64), skip.astype(np.uint64)
    one, two, three = (np.uint64(k << 40) for k in (1, 2, 3))  # ids are smaller
    return np.stack([_mix(last + one), _mix(_mix(last + two) + skip), _mix(skip + three)])


def pack(*columns: np.ndarray) -> bytes:
    """Columns of 32 bits by planes of bytes, which compress well."""
    data = np.ascontiguousarray(np.stack(columns).astype(np.uint32, copy=False).view(np.uint8).reshape(-1, 4).T)
    return len(data.ravel()).to_bytes(8, "little") + pa.compress(data.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view(np.uint32).reshape(n, -1)


class Dealer:
    """Shards of tokens. As far as SHARD allows all tokens after the same last word meet in one; those of a word
    that is too much for one are dealt by the word before, and where that is as frequent, so that the pair
    may be, by text."""

    def __init__(self, vocabulary: Vocabulary, total: int):
        self.shards = max(1, -(-total // SHARD))
        self.pieces = np.ones(vocabulary.size + 2, np.uint64)
        for i, (w, n) in enumerate(vocabulary.ranked):
            self.pieces[i + 1] = max(1, -(-n * 4 // SHARD))
            if w == END:  # as many texts start as end
                self.pieces[0] = self.pieces[i + 1]

    def deal(self, last: np.ndarray, skip: np.ndarray, row: np.ndarray) -> np.ndarray:
        """``row``: a number of each token's text."""
        most = len(self.pieces) - 1
        own, other = self.pieces[np.minimum(last, most)], self.pieces[np.minimum(skip, most)]
        piece = _mix(skip.astype(np.uint64) * np.uint64(11)) % own
        # a pair is no more frequent than the rarer of its words
        hot = np.flatnonzero((own > 1) & (other > 1))
        piece[hot] += _mix(row[hot].astype(np.uint64) * np.uint64(13)) % np.minimum(own[hot], other[hot]) * np.uint64(1_000_003)
        return (_mix(_mix(last.astype(np.uint64) * np.uint64(17)) + piece * np.uint64(19)) % np.uint64(self.shards)).astype(np.int64)


HEAD = np.dtype([("row", "i8"), ("doc", "i8"), ("none", "?"), ("held", "?"), ("tokens", "i8"), ("known", "i8"), ("base", "f8")])
#: Kinds of records that are dealt: the count of a rare word, a portion's head, its part of a shard.
COUNT, HEADED, PART = 0, 1, 2
DEALT = "shard long, kind int, batch long, data binary, rare binary, n long"


def pack_rare(words: pa.BinaryArray, each: np.ndarray, text: np.ndarray) -> bytes:
    """Rare words, and for each its tokens (``each`` many) as the texts they stand in."""
    _, offsets, data = words.buffers()
    offsets = np.frombuffer(offsets, np.int32, len(words) + 1, 4 * words.offset)
    numbers = np.concatenate([[len(words)], np.diff(offsets), each, text]).astype(np.uint32)
    return numbers.tobytes() + (data.slice(offsets[0], offsets[-1] - offsets[0]).to_pybytes() if offsets[-1] > offsets[0] else b"")


def unpack_rare(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(bytes of each word, tokens of each word, their texts, all words)."""
    n = int.from_bytes(data[:4], "little")
    sizes, each = np.frombuffer(data, np.uint32, 2 * n, 4).astype(np.int64).reshape(2, n)
    end = 4 + 8 * n + 4 * int(each.sum())
    return sizes, each, np.frombuffer(data, np.uint32, (end - 4 - 8 * n) // 4, 4 + 8 * n), data[end:]


def deal(rows: DataFrame, rare: DataFrame, frequent: list[tuple[bytes, int]], total: int) -> DataFrame:
    """All tokens of the texts by shard, from one reading of them. A portion gives a head, with what frequent words add to
    its base scores, and for each shard the tokens that are learned there and the rare words, by their hash, whose counts
    meet them there."""
    shipped, shards = rows.sparkSession.sparkContext.broadcast(frequent), max(1, -(-total // SHARD))
    names = [f.split()[0] for f in DEALT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(shipped.value)
        dealer = Dealer(vocabulary, total)
        for part in portions(batches, PORTION):
            rows, held = part["row"].to_numpy(), part["held_out"].to_numpy()
            lengths, words, codes = tokens(part["text"])
            own, others, hashes = vocabulary.ids_and_hashes(words.to_numpy(zero_copy_only=False))
            ids, batch, starts = own.take(codes), int(rows[0]), np.cumsum(lengths) - lengths
            known = ids <= vocabulary.size
            head = np.zeros(len(lengths), HEAD)
            head["row"], head["held"], head["tokens"], head["known"] = rows, held, lengths, np.add.reduceat(known, starts, dtype=np.int64)
            head["base"] = np.add.reduceat(np.where(own <= vocabulary.size, vocabulary.log_count.take(own, mode="clip"), 0.0).take(codes), starts)
            head["none"], head["doc"] = part["doc_id"].is_null().to_numpy(), part["doc_id"].fill_null(0).to_numpy()

            last, skip = before(ids, lengths, 0)
            shard = dealer.deal(last, skip, np.repeat(rows, lengths))
            text = np.repeat(np.arange(len(rows)), lengths)
            order = np.argsort(shard << 32 | last)
            columns = np.stack([x.astype(np.uint32).take(order) for x in (last, skip, text * 2 + np.repeat(held, lengths), ids)])

            # rare words by shard, each with its tokens
            places = np.argsort(hashes % shards, kind="stable")
            rank = np.empty(len(words), np.int64)
            rank[others.take(places)] = np.arange(len(others))
            at = np.flatnonzero(~known)
            by_word = rank.take(codes.take(at))
            each = np.bincount(by_word, minlength=len(others))
            meets = text.take(at).take(np.argsort(by_word, kind="stable"))
            sorted_words = words.take(pa.array(others.take(places)))

            cut = np.searchsorted(shard.take(order), np.arange(shards + 1)).tolist()
            word_cut = np.searchsorted((hashes % shards).take(places), np.arange(shards + 1))
            token_cut = np.r_[0, np.cumsum(each)].take(word_cut).tolist()
            word_cut = word_cut.tolist()
            found = [k for k in range(shards) if cut[k] < cut[k + 1] or word_cut[k] < word_cut[k + 1]]
            data = [pack(*columns[:, cut[k] : cut[k + 1]]) for k in found]
            rares = [pack_rare(sorted_words[word_cut[k] : word_cut[k + 1]], each[word_cut[k] : word_cut[k + 1]], meets[token_cut[k] : token_cut[k + 1]]) for k in found]
            n = len(found)
            columns = [[-1 - batch % shards, *found], [HEADED] + [PART] * n, [batch] * (n + 1), [head.tobytes(), *data], [None, *rares], [None] * (n + 1)]
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    dealt = rows.select("row", "doc_id", "held_out", "text").mapInArrow(run, DEALT)
    counts = rare.select((F.crc32("word") % shards).alias("shard"), F.lit(COUNT).alias("kind"), F.lit(0).cast("long").alias("batch"), F.col("word").alias("data"), F.lit(None).cast("binary").alias("rare"), "n")
    return dealt.unionByName(counts).repartition(shards, "shard").sortWithinPartitions("shard", "kind", "batch")


_trees: dict[str, Tree] = {}


def _tree(key: str, mass, n_frequent: int) -> Tree:
    """One per worker process."""
    if key not in _trees:
        _trees.clear()
        _trees[key] = Tree(mass.value, n_frequent)
    return _trees[key]


def _learn(batches: Iterator[pa.RecordBatch], tree: Tree) -> Iterator[pa.RecordBatch]:
    """Trains a model on each shard (records come in its order, counts first) and sums its gains by text; gives the
    counts of its rare words to their tokens."""
    held: list[tuple[int, bytes, bytes]] = []
    known: list[tuple[pa.BinaryArray, pa.Int64Array]] = []

    def out(batch: int, kind: int, data: bytes, rare: bytes | None = None):
        return pa.RecordBatch.from_arrays([pa.array([batch], pa.int64()), pa.array([kind], pa.int32()), pa.array([data], pa.binary()), pa.array([rare], pa.binary())], ["batch", "kind", "data", "rare"])

    def learned(tables: list[np.ndarray]) -> np.ndarray:
        last, skip, text, word = np.concatenate(tables, axis=1)
        # equal cases once, in the order of their hashes
        cases = _mix(_mix(last.astype(np.uint64) << np.uint64(32) | skip) + word)
        order = np.argsort(cases)
        cases = cases.take(order)
        new = np.r_[True, cases[1:] != cases[:-1]][: len(cases)]
        first = order.compress(new)
        inverse = np.empty(len(order), np.int64)
        inverse[order] = np.cumsum(new) - 1
        learnt = np.bincount(inverse, text % 2 == 0, len(first))
        return gains(tree, tree.at(word[first].astype(np.int64)), contexts_of(last[first], skip[first]), learnt).take(inverse)

    def counted(rares: list[tuple]) -> np.ndarray:
        """Of each rare word, its count in training texts."""
        sizes = np.concatenate([r[0] for r in rares])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(b"".join([r[3] for r in rares]))])
        n = np.zeros(len(sizes), np.int64)
        if known:
            at = pc.index_in(words, value_set=pa.concat_arrays([w for w, _ in known]).cast(pa.large_binary())).fill_null(-1).to_numpy()
            n[at >= 0] = pa.concat_arrays([c for _, c in known]).to_numpy().take(at[at >= 0])
        return n

    def finish():
        tables, rares = [unpack(data, 4) for _, data, _ in held], [unpack_rare(rare) for _, _, rare in held]
        gain, counts = learned(tables), counted(rares)
        at = at_word = 0
        for (batch, _, _), t, (sizes, each, meets, _) in zip(held, tables, rares, strict=True):
            text = t[2] // 2
            sums, n = np.bincount(text, gain[at : at + len(text)]), counts[at_word : at_word + len(sizes)]
            own = np.flatnonzero(np.bincount(text))
            at, at_word = at + len(text), at_word + len(sizes)
            met = np.repeat(n, each)
            yield out(batch, PART, pack(own, sums.take(own).astype(np.float32).view(np.uint32)), pack(meets, met & 0xFFFFFFFF, met >> 32))

    now = None
    for b in batches:
        shards, kinds = b["shard"].to_numpy(), b["kind"].to_numpy()
        edges = np.flatnonzero(np.r_[True, (shards[1:] != shards[:-1]) | (kinds[1:] != kinds[:-1])][: len(shards)]).tolist()
        for i, j in zip(edges, [*edges[1:], len(shards)], strict=True):
            if kinds[i] == HEADED:
                for batch, data in zip(b["batch"][i:j].to_pylist(), b["data"][i:j].to_pylist(), strict=True):
                    yield out(batch, HEADED, data)
                continue
            if shards[i] != now:
                if held:
                    yield from finish()
                held, known, now = [], [], shards[i]
            if kinds[i] == COUNT:
                known.append((b["data"][i:j], b["n"][i:j]))
            else:
                held += zip(b["batch"][i:j].to_pylist(), b["data"][i:j].to_pylist(), b["rare"][i:j].to_pylist(), strict=True)
    if held:
        yield from finish()


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up each portion's texts over all shards; a head comes before what shards say of it."""
    head: np.ndarray | None = None

    def out() -> pa.RecordBatch:
        doc = pa.array(head["doc"], mask=head["none"])
        columns = [pa.array(head["row"]), doc, *[pa.array(head[k]) for k in ("held", "tokens", "known", "base")], pa.array(gain)]
        return pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "gain"])

    for b in batches:
        for kind, data, rare in zip(b["kind"].to_pylist(), b["data"].to_pylist(), b["rare"].to_pylist(), strict=True):
            if kind == HEADED:
                if head is not None:
                    yield out()
                head = np.frombuffer(data, HEAD).copy()
                gain = np.zeros(len(head))
            else:
                own, sums = unpack(data, 2)
                gain[own] += sums.view(np.float32)
                text, low, high = unpack(rare, 3)
                n = low.astype(np.int64) | high.astype(np.int64) << 32
                head["base"] += np.bincount(text, np.log10(n + 0.1), len(head))
                head["known"] += np.bincount(text, n > 0, len(head)).astype(np.int64)
    if head is not None:
        yield out()


def model_gains(dealt: DataFrame, frequent: list[tuple[bytes, int]], mass: np.ndarray, total: int) -> DataFrame:
    """For each row what rare and frequent words add to its base score, and ``gain``: natural log of what the model of all
    training texts adds to that."""
    masses, n_frequent, key = dealt.sparkSession.sparkContext.broadcast(mass), len(frequent), uuid.uuid4().hex
    learnt = dealt.mapInArrow(lambda batches: _learn(batches, _tree(key, masses, n_frequent)), "batch long, kind int, data binary, rare binary")
    return learnt.repartition("batch").sortWithinPartitions("batch", "kind").mapInArrow(_sums, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, gain double")


def lm_scores(docs: DataFrame, held_out=None, text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10) for every row.

    Learns from the rows where ``held_out`` (a column; by default crc32 of the id mod 10 is 0) is
    not true; null ids are not held out. A null or empty text is one end token. Without training
    texts every word is unknown. Repeated rows count as often as they stand there.
    """
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 10 == 0 if held_out is None else held_out, F.lit(False))
    docs = with_rows(docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_or_empty(text_col).alias("text")), then=("text", "held_out"))
    rows = docs.withColumnRenamed("__row", "row")
    training = rows.filter("NOT held_out").select("text")
    counts = durable(count_words(training))
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    # a histogram tells the count from which on there are FREQUENT words at most, a second one the hash under which
    # words of the next lower counts still find room
    step, mark = F.floor(F.log2("n") * 64), F.pmod(F.xxhash64("word"), F.lit(4096))
    left, least, marks = FREQUENT, 0, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # some thousand rows
        if r["count"] > left:
            least = r["step"] + 1
            for m in sorted(counts.filter(step == r["step"]).groupBy(mark.alias("mark")).count().collect()):  # 4096 rows at most
                left -= m["count"]
                if left < 0:
                    break
                marks = m["mark"] + 1
            break
        left -= r["count"]
    own_leaf = (step >= least) | ((step == least - 1) & (mark < marks))
    top = counts.filter(own_leaf).select("word", "n").toArrow()
    frequent = list(zip(top["word"].to_pylist(), top["n"].to_pylist(), strict=True))
    norm = total + 0.1 * (distinct + 1)

    vocabulary = Vocabulary(frequent)
    rare = counts.filter(~own_leaf)
    shared = np.full(SHARED, 0.1 / SHARED)
    leaf = (F.crc32("word") % RARE_IDS % SHARED).alias("leaf")
    for r in rare.groupBy(leaf).agg(F.sum(F.col("n") + 0.1).alias("m")).collect():  # SHARED rows at most
        shared[r["leaf"]] += r["m"]
    mass = np.r_[np.array([n + 0.1 for _, n in vocabulary.ranked]), shared]
    mass /= mass.sum()
    scored = model_gains(deal(rows, rare, vocabulary.ranked, total), vocabulary.ranked, mass, total)
    base = F.col("base") - F.col("n_tokens") * F.lit(math.log10(norm))
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), (base + F.col("gain") / math.log(10)).alias("score"))


def query(spark, sf_dir):
    return lm_scores(table(spark, sf_dir, "documents"))
