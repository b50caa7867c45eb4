"""BPE encoding and decoding by speculation: propose greedily, check pairs, merge only what fails.

A word's proposal is the greedy longest match over the vocabulary. It is the merge order's own
result exactly when every token stands for itself and no merge crosses a border between two
neighbours before both are complete. The second test looks only at the two tokens: along the right
edge of the left one and the left edge of the right one, a pair that merges earlier than its parts
grow further refutes the border. Pairs are checked in bulk with numpy and remembered; words with a
refuted border are merged exactly, many at a time in rounds, or one by one where they are long.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import operator
import re
import sys
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table, text_or_empty

#: Words that a worker remembers, twice: when full, they become the older ones. Characters encoded at a time.
WORDS_KEPT, CHARS = 250_000, 2_000_000
NEVER, NO_RANK = np.iinfo(np.int64).max, np.iinfo(np.int32).max
#: Symbols of words that are merged in bulk, by columns of a table.
WIDTHS = (6, 9, 12, 16, 24)
IDS, DECODED = operator.itemgetter(0), operator.itemgetter(1)


@functools.cache
def read_tokenizer(path: str | None = None) -> str:
    """The tokenizer file's JSON with the library's own character classes; read on the driver, some 2 MB
    that are sent to the tasks. Python's tables of characters may be older than the library's."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return json.dumps(spec | {"classes": character_classes(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])})


def character_classes(pattern: str) -> dict:
    """Letters, numbers and spaces as bodies of regular-expression classes, and characters whose lower case
    Python's tables give otherwise: what the library does with every code point."""
    from tokenizers import Regex, normalizers, pre_tokenizers

    split = pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str
    kinds: dict[str, list[list[int]]] = {"letters": [], "numbers": [], "spaces": []}
    lower: dict[str, str] = {}
    for block in range(0, sys.maxunicode + 1, 2048):  # all at once would leave the driver with 50 MB of small objects
        points = [c for c in range(block, block + 2048) if not 0xD800 <= c < 0xE000]
        found: dict[str, list[int]] = {k: [] for k in kinds}
        end = 0
        # a piece is a run of letters, one number or a run of others; spaces are left out
        for piece, (start, stop) in split("".join(map(chr, points))):
            found["spaces"] += points[end:start]
            end = stop
            parts = len(split("a" + piece[0] * 2))  # the first of a piece stands for all of it
            if parts != 2:
                found["letters" if parts == 1 else "numbers"] += points[start:stop]
        found["spaces"] += points[end:]
        for k, v in found.items():
            _ranges(v, kinds[k])
        cased = [c for c in points if c < 0x40000 and c != 10]
        ours = normalizers.Lowercase().normalize_str("\n".join(map(chr, cased))).split("\n")
        lower |= {str(c): x for c, x in zip(cased, ours, strict=bool(cased)) if x != chr(c).lower()}
    return {k: _class(v) for k, v in kinds.items()} | {"lower": lower}


def _ranges(points: Iterable[int], out: list[list[int]]) -> None:
    """Adds sorted code points to ranges of (first, last)."""
    for c in points:
        if out and c == out[-1][1] + 1:
            out[-1][1] = c
        else:
            out.append([c, c])


def _class(ranges: list[list[int]]) -> str:
    """A regular-expression class body of ranges of code points."""
    return "".join(f"\\U{a:08x}" if a == b else f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges)


def _up_to(most: int, body: str) -> str:
    """The part of a class body that goes no further than a code point."""
    ranges = [(int(a, 16), int(b or a, 16)) for a, b in re.findall(r"\\U(\w{8})(?:-\\U(\w{8}))?", body)]
    return _class([[a, min(b, most)] for a, b in ranges if a <= most])


def byte_names() -> list[str]:
    """The visible character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in names:
            names[b], extra = chr(256 + extra), extra + 1
    return [names[b] for b in range(256)]


class WordBpe:
    """Byte-level BPE with word ends, lower case and dropped white space."""

    def __init__(self, spec: str):
        spec = json.loads(spec)
        model = spec["model"]
        self.id, self.end = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token = {i: t for t, i in (self.id | self.special).items()}
        self.rank: dict[int, int] = {}  # left * size + right -> rank
        self.parts: dict[int, tuple[int, int, int]] = {}  # token -> left, right, rank
        self.size = max(self.token) + 1
        self.number = [*map(str, range(self.size))]
        self.merged: dict[int, int] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            left, right, both = self.id[a], self.id[b], self.id[a + b]
            self.rank.setdefault(left * self.size + right, r)
            self.merged.setdefault(left * self.size + right, both)
            self.parts.setdefault(both, (left, right, r))
        keys = np.array(sorted(self.rank), np.int64)
        self.keys, self.ranks = keys, np.array([self.rank[k] for k in keys.tolist()], np.int64)
        self.longest = max(map(len, self.id))
        # tokens at the end of a word, without their mark; by the first three symbols, the lengths of all others from the longest
        self.ended = {t.removesuffix(self.end): i for t, i in self.id.items() if t.endswith(self.end)}
        lengths: dict[str, set[int]] = {}
        for t in self.id:
            if len(t) > 2 and not t.endswith(self.end):
                lengths.setdefault(t[:3], set()).add(len(t))
        self.reach = {t: tuple(sorted(x, reverse=True)) for t, x in lengths.items()}
        self.byte = byte_names()
        # by rank, the merged token; by symbol, the token within and at the end of a word
        self.results = np.zeros(len(model["merges"]), np.int32)
        self.results[self.ranks] = [self.merged[k] for k in keys.tolist()]
        self.first = np.zeros((2, 512), np.int32)
        for c in self.byte:
            self.first[:, ord(c)] = self.id[c], self.id[c + self.end]
        letters, numbers, spaces = (spec["classes"][k] for k in ("letters", "numbers", "spaces"))
        self.lower = {int(c): x for c, x in spec["classes"]["lower"].items()}
        # characters that normal form C may change
        self.beyond = re.compile("[^\\0-\\u02ff]")
        recased = [*map(chr, self.lower)]
        self.recased_latin = any(c <= 0x2FF for c in self.lower)
        self.recased = re.compile("[" + re.escape("".join(recased)) + "]" if recased else "(?!)")
        # the fewer ranges a class has, the faster it is: patterns for texts of all characters, of 16 bits, and of none beyond
        self.wide = re.compile("[^\\0-\\uffff]")
        self.words, self.narrow, self.latin = (
            re.compile("'s|'t|'re|'ve|'m|'ll|'d|[{0}]+|[{1}]|[^{2}{0}{1}]+".format(*[_up_to(most, k) for k in (letters, numbers, spaces)])) for most in (sys.maxunicode, 0xFFFF, 0x2FF)
        )
        self.plain = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\\t-\\r a-z0-9]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}
        self.own: dict[int, bool] = {}
        self.edges = [self._edges(side) for side in (0, 1)]

    def _edges(self, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens along the left (0) or right (1) edge of every token, from itself to a symbol.

        As offsets by token, tokens, and for each the rank at which it grows on.
        """
        offsets, tokens, until = [0], [], []
        for t in range(self.size):
            x, r = t, NEVER
            while True:
                tokens.append(x)
                until.append(r)
                if x not in self.parts:
                    break
                r, x = self.parts[x][2], self.parts[x][side]
            offsets.append(len(tokens))
        return np.array(offsets), np.array(tokens), np.array(until)

    # text -> words
    def split(self, text: str) -> list[str]:
        """The words to encode; a special token's own string stays whole."""
        if self.specials and "<|" in text:
            return [w for i, piece in enumerate(self.specials.split(text)) for w in ([piece] if i % 2 else self._split(piece))]
        return self._split(text)

    def _split(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain.findall(text.lower())
        if far := self.beyond.search(text):  # by the library's tables, which may be older or newer than Python's
            from tokenizers import normalizers

            text = normalizers.NFC().normalize_str(text)
        # each character is put in lower case by itself: no final form of sigma
        text = text.replace("Σ", "σ").lower()
        if self.recased.search(text) if far or self.recased_latin else self.beyond.search(text):
            text, far = text.translate(self.lower), True
        return (self.latin if not far and not self.recased_latin else self.words if self.wide.search(text) else self.narrow).findall(text)

    # words -> tokens
    def symbols(self, word: str) -> str:
        return word if word.isascii() and word.isprintable() else "".join([self.byte[b] for b in word.encode()])

    def exact(self, word: str) -> list[int]:
        """Merge by merge, lowest rank first, leftmost first."""
        names = self.symbols(word)
        return self.merge([*map(self.id.__getitem__, names[:-1]), self.id[names[-1] + self.end]])

    def merge(self, s: list[int]) -> list[int]:
        """From a heap of pairs, with neighbours linked, so that a long word costs n log n."""
        rank, size, n = self.rank.get, self.size, len(s)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(s, s[1:], strict=False)) if (r := rank(a * size + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if s[i] != a or j >= n or s[j] != b:
                continue  # one of the two has grown
            s[i] = self.merged[a * size + b]
            s[j] = -1
            after[i] = j = after[j]
            if j < n:
                before[j] = i
                if (r := rank(s[i] * size + s[j])) is not None:
                    heapq.heappush(heap, (r, i, s[i], s[j]))
            if (h := before[i]) >= 0 and (r := rank(s[h] * size + s[i])) is not None:
                heapq.heappush(heap, (r, h, s[h], s[i]))
        return [t for t in s if t >= 0]

    def merge_all(self, names: list[str]) -> list[list[int]]:
        """What exact() gives for words written in symbols: those of one width at a time, of each the lowest rank's leftmost pair
        in every round. The longest go one by one."""
        out: list[list[int]] = [[]] * len(names)
        sizes = np.array([len(x) for x in names])
        for least, width in zip((0, *WIDTHS), WIDTHS, strict=False):
            own = np.flatnonzero((sizes > least) & (sizes <= width))
            if not len(own):
                continue
            n = sizes[own]
            at = np.arange(width) < n[:, None]
            s = np.full((len(own), width), -1, np.int32)
            s[at] = self.first[0].take(np.frombuffer("".join([names[i] for i in own.tolist()]).encode("utf-32-le"), np.uint32))
            s[np.arange(len(own)), n - 1] = self.first[1].take([ord(names[i][-1]) for i in own.tolist()])
            rank = np.full((len(own), width), NO_RANK, np.int32)
            rank[:, :-1] = self.rank_of(s[:, :-1], s[:, 1:])
            columns = np.arange(width - 1)
            while True:
                p = rank.argmin(1)
                r = rank[np.arange(len(own)), p]
                going = r < NO_RANK
                if not going.all():
                    for i, tokens in zip(own[~going].tolist(), s[~going].tolist(), strict=True):
                        out[i] = tokens[: tokens.index(-1)] if tokens[-1] < 0 else tokens
                    own, s, rank, p, r = own[going], s[going], rank[going], p[going], r[going]
                    if not len(own):
                        break
                rows, beyond = np.arange(len(own)), columns > p[:, None]
                s[:, :-1] = np.where(beyond, s[:, 1:], s[:, :-1])
                s[:, -1] = -1
                rank[:, :-1] = np.where(beyond, rank[:, 1:], rank[:, :-1])
                rank[:, -1] = NO_RANK
                s[rows, p] = self.results.take(r)
                rank[rows, p] = self.rank_of(s[rows, p], s[rows, p + 1])
                inner = np.flatnonzero(p > 0)
                q = p[inner]
                rank[inner, q - 1] = self.rank_of(s[inner, q - 1], s[inner, q])
        for i in np.flatnonzero(sizes > WIDTHS[-1]).tolist():
            out[i] = self.merge([*map(self.id.__getitem__, names[i][:-1]), self.id[names[i][-1] + self.end]])
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NO_RANK where there is no merge, or nothing (-1) on the right."""
        keys = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys.take(at) == keys) & (right >= 0), self.ranks.take(at), NO_RANK).astype(np.int32)

    def propose(self, word: str) -> list[int]:
        """Greedy longest match from the left."""
        return self.longest_matches(self.symbols(word))

    def longest_matches(self, s: str) -> list[int]:
        i, n, out, get, ended, reach = 0, len(s), [], self.id.get, self.ended.get, self.reach.get
        while True:
            if n - i <= self.longest and (t := ended(s[i:])) is not None:
                out.append(t)
                return out
            for k in reach(s[i : i + 3], ()):
                if i + k < n and (t := get(s[i : i + k])) is not None:  # the last symbol needs the end mark
                    break
            else:
                k = 2
                if i + 2 >= n or (t := get(s[i : i + 2])) is None:
                    k, t = 1, self.id[s[i]]
            out.append(t)
            i += k

    def stands(self, t: int) -> bool:
        """Whether merging the token's own symbols gives the token."""
        if (known := self.own.get(t)) is None:
            s = [t]
            while any(x in self.parts for x in s):
                s = [y for x in s for y in (self.parts[x][:2] if x in self.parts else (x,))]
            known = self.own[t] = self.merge(s) == [t]
        return known

    def borders_hold(self, pairs: np.ndarray) -> np.ndarray:
        """For distinct pairs (left * size + right): whether no merge crosses the border first."""
        (lo, lt, lu), (ro, rt, ru) = self.edges[1], self.edges[0]
        left, right = pairs // self.size, pairs % self.size
        n, m = lo[left + 1] - lo[left], ro[right + 1] - ro[right]
        of = np.repeat(np.arange(len(pairs)), n * m)
        k = np.arange(len(of)) - np.repeat(np.cumsum(n * m) - n * m, n * m)
        a, b = lo[left][of] + k // m[of], ro[right][of] + k % m[of]
        keys = lt[a] * self.size + rt[b]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        rank = np.where(self.keys[at] == keys, self.ranks[at], NEVER)
        # leftmost first: at equal ranks a merge across the border precedes one on its right only
        crossed = (rank < NEVER) & (rank < lu[a]) & (rank <= ru[b])
        return np.bincount(of, crossed, len(pairs)) == 0

    def learn(self, words: Iterable[str]) -> None:
        """Puts the encoding of new words into ``known``: proposals in bulk, the exact loop for the rest."""
        plain = [w for w in words if w not in self.special]
        if plain:
            names = [*map(self.symbols, plain)]
            proposals = [*map(self.longest_matches, names)]
            flat = np.array([t for p in proposals for t in p], np.int64)
            word = np.repeat(np.arange(len(plain)), [len(p) for p in proposals])
            inner = word[1:] == word[:-1]
            pairs, where = np.unique((flat[:-1] * self.size + flat[1:])[inner], return_inverse=True)
            bad = np.zeros(len(plain), bool)
            bad[word[:-1][inner][~self.borders_hold(pairs)[where]]] = True
            tokens, where = np.unique(flat, return_inverse=True)
            bad[word[~np.array([self.stands(t) for t in tokens.tolist()])[where]]] = True
            failing = np.flatnonzero(bad).tolist()
            for i, exact in zip(failing, self.merge_all([names[i] for i in failing]), strict=True):
                proposals[i] = exact
            self.known.update(zip(plain, map(self.written, proposals), strict=True))
        for w in words:
            if w in self.special:
                self.known[w] = self.written([self.special[w]])

    def written(self, ids: list[int]) -> tuple[str, str]:
        """Ids and decoded tokens as texts; both join with single spaces over words."""
        return " ".join([self.number[i] for i in ids]), " ".join([self.token[i] for i in ids])

    def encode_batch(self, texts: Iterable[str]) -> Iterator[tuple[str, str]]:
        """For each text, its ids (decimal, space-joined) and their decoding."""
        split = [self.split(t) for t in texts]
        met = set().union(*split)
        new = met - self.known.keys()
        if len(self.known) + len(new) > WORDS_KEPT:
            self.older, self.known, new = self.known, {}, met
        for w in new & self.older.keys():
            self.known[w] = self.older[w]
        self.learn(new - self.known.keys())
        known = self.known
        for words in split:
            got = [*map(known.__getitem__, words)]
            yield " ".join(map(IDS, got)), " ".join(map(DECODED, got))

    def decode(self, ids: Iterable[int]) -> str:
        """Tokens joined by a space: this tokenizer file names no decoder."""
        return " ".join([self.token[i] for i in ids])


def portions(texts: list[str], chars: int = CHARS) -> Iterator[list[str]]:
    """Stretches of ``texts`` of about ``chars`` characters."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= chars:
            yield out
            out, n = [], 0
    if out:
        yield out


_loaded: dict[int, WordBpe] = {}


def _tokenizer(spec) -> WordBpe:
    """One per worker process."""
    if (found := _loaded.get(spec.id if hasattr(spec, "id") else 0)) is None:
        _loaded.clear()
        found = _loaded[spec.id if hasattr(spec, "id") else 0] = WordBpe(spec.value)
    return found


def encode(docs: DataFrame, spark: SparkSession, text_col: str = "text", path: str | None = None, full: bool = False, ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row; ``ids`` adds ids, ``full`` ids and decoded.

    Null and empty texts, and texts of white space, have no tokens and decode to the empty text.
    Special tokens' strings in a text are encoded as the special tokens. One map, no shuffle.
    """
    spec = spark.sparkContext.broadcast(read_tokenizer(path))
    listed = ids or full
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * listed + ", decoded string" * full

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(spec)
        for b in batches:
            counts, hashes, texts, lists, back = [], [], [], [np.empty(0, np.int32)], []
            for written, decoded in (x for part in portions(b["text"].to_pylist()) for x in tok.encode_batch(part)):
                counts.append(written.count(" ") + 1 if written else 0)
                hashes.append(hashlib.sha256(written.encode()).hexdigest())
                texts.append(hashlib.sha256(decoded.encode()).hexdigest())
                if listed:
                    lists.append(np.fromstring(written, np.int32, sep=" "))
                if full:
                    back.append(decoded)
            columns = [b["doc_id"].cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(texts, pa.string())]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if listed:
                ends = np.cumsum([0, *counts]).astype(np.int32)
                columns, names = [*columns, pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists)))], [*names, "ids"]
            if full:
                columns, names = [*columns, pa.array(back, pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", text_or_empty(text_col).alias("text")).mapInArrow(run, schema)


def query(spark, sf_dir):
    return encode(table(spark, sf_dir, "documents"), spark)
