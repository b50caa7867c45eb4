"""Benchmark decontamination over a distributed positional inverted index.

``index`` stores the postings of the training texts: every shard (about a megabyte of texts) holds,
for each of its terms, the places where it stands. ``search`` takes the phrases of the test items to
all shards, in blocks of a bounded size: in a shard, a phrase starts from its rarest term, whose
places, less the term's offset, are intersected with the lists of its other terms from the rarer to
the more frequent; what is left are exact places. Around rarest terms whose companions are all close
by, a sliding check decides on proximity matches. Nothing is shuffled but the phrases of equal words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words
from .common import durable, table, text_or_empty

WINDOW, REACH = 10, 20
#: Bytes of the texts of a shard; a longer text is a shard of its own.
SHARD = 1 << 20
#: Bytes of the phrases (with their item ids) that are sent to the tasks at a time.
BLOCK = 24 << 20
#: Places that are intersected at a time.
CANDIDATES = 1 << 20


def index(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The postings, one row a shard: shard, ids (of its texts in order), starts (their first words), terms,
    counts and places (the words' numbers in the shard, term by term, as differences).

    Null and empty texts are texts without words. One map; written to the shared folder.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = TaskContext.get().partitionId() << 32
        for b in batches:
            for part in words.portions(b, "text", SHARD):
                w = words.split(part["text"])
                place = np.argsort(w.code, kind="stable").astype(np.int32)
                counts = np.bincount(w.code, minlength=len(w.distinct)).astype(np.int32)
                steps = np.diff(place, prepend=np.int32(0))
                firsts = np.cumsum(counts) - counts
                steps[firsts] = place[firsts]
                starts = np.r_[0, np.cumsum(w.counts())].astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), pa.ListArray.from_arrays([0, part.num_rows], part["id"]), pa.array([starts.tobytes()]),
                     pa.ListArray.from_arrays([0, len(w.distinct)], w.distinct.cast(pa.binary())), pa.array([counts.tobytes()]), pa.array([steps.tobytes()])],
                    ["shard", "ids", "starts", "terms", "counts", "places"])
                shard += 1

    rows = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return durable(rows.mapInArrow(run, f"shard long, ids array<{kind}>, starts binary, terms array<binary>, counts binary, places binary"))


def word_list(text_col: str = "text") -> Column:
    """The words of a text as an array, in SQL."""
    low = F.translate(text_or_empty(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.filter(F.split(low, r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")


def windows(items: DataFrame, size: int = WINDOW, text_col: str = "text", id_col: str = "item_id") -> DataFrame:
    """words, items: every run of ``size`` words (of a shorter item, all its words), with the sorted ids, as
    text, of the items that hold it. Items without words have none; a null id is an empty one."""
    rows = items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), word_list(text_col).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    each = rows.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, F.lit(size)))).alias("words"))
    return each.groupBy("words").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Phrases:
    """Phrases of one length as numbers of the terms of their block."""

    def __init__(self, terms: np.ndarray, which: np.ndarray):
        self.terms, self.which = terms, which  # (phrases, length) and each phrase's number in the block


class Block:
    """A bounded block of phrases, as every task holds it."""

    def __init__(self, phrases: list[list[str]], items: list[list[str]]):
        self.items = items
        flat = pa.array([w.encode() for p in phrases for w in p], pa.binary()).dictionary_encode()
        self.terms, code, at = flat.dictionary, flat.indices.to_numpy(), 0
        by_length: dict[int, list] = {}
        for k, p in enumerate(phrases):
            by_length.setdefault(len(p), []).append((k, code[at : at + len(p)]))
            at += len(p)
        self.groups = [Phrases(np.stack([c for _, c in g]), np.array([k for k, _ in g])) for g in by_length.values()]


class Shard:
    """The postings of one shard, opened."""

    def __init__(self, starts: bytes, terms: pa.Array, counts: bytes, places: bytes):
        self.starts = np.frombuffer(starts, np.int32).astype(np.int64)
        self.terms, self.counts = terms, np.frombuffer(counts, np.int32).astype(np.int64)
        self.firsts = np.cumsum(self.counts) - self.counts
        steps = np.frombuffer(places, np.int32).astype(np.int64)
        run = np.cumsum(steps)
        self.places = run - np.repeat(run[self.firsts] - steps[self.firsts], self.counts)
        #: every posting as term << 32 | place, in order: a look-up there intersects two lists
        self.keys = np.repeat(np.arange(len(self.counts), dtype=np.int64) << 32, self.counts) | self.places

    def has(self, slot: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = slot << 32 | place
        at = np.searchsorted(self.keys, key)
        return self.keys[np.minimum(at, len(self.keys) - 1)] == key

    def next(self, slot: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The first place of a term from ``place`` on; a very large one if there is none."""
        at = np.searchsorted(self.keys, slot << 32 | place)
        key = self.keys[np.minimum(at, len(self.keys) - 1)]
        return np.where((at < len(self.keys)) & (key >> 32 == slot), key & 0xFFFFFFFF, np.int64(1) << 40)

    def doc(self, place: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, place, "right") - 1

    def find(self, block: Block, reach: int | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Exact matches (phrase, start, length) and, with ``reach``, the (phrase, text) of proximity matches."""
        none = np.zeros(0, np.int64)
        exact, near = [(none, none, none)], [(none, none)]
        if len(self.keys):
            slot_of = pc.fill_null(pc.index_in(block.terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            for g in block.groups:
                slots = slot_of[g.terms]
                alive = (slots >= 0).all(axis=1)
                slots, which = slots[alive], g.which[alive]
                sizes = self.counts[slots]
                order = np.argsort(sizes, axis=1, kind="stable")
                load = np.cumsum(sizes.min(axis=1)) if len(sizes) else none
                cut = np.flatnonzero(np.diff(load // CANDIDATES)) + 1
                for rows in np.split(np.arange(len(which)), cut):
                    if len(rows):
                        found, close = self._find(slots[rows], order[rows], reach)
                        exact.append((which[rows][found[0]], found[1], np.full(len(found[0]), slots.shape[1])))
                        near.append((which[rows][close[0]], close[1]))
        return *(np.concatenate(x) for x in zip(*exact, strict=True)), *(np.concatenate(x) for x in zip(*near, strict=True))

    def _find(self, slots: np.ndarray, order: np.ndarray, reach: int | None):
        size, rarest = slots.shape[1], order[:, 0]
        first = slots[np.arange(len(slots)), rarest]
        row = np.repeat(np.arange(len(slots)), self.counts[first])
        within = np.arange(len(row)) - np.repeat(np.cumsum(self.counts[first]) - self.counts[first], self.counts[first])
        anchor = self.places[self.firsts[first][row] + within]
        start = anchor - rarest[row]
        text = self.doc(anchor)
        keep = (start >= self.starts[text]) & (start + size <= self.starts[text + 1])
        r, s, d = row[keep], start[keep], text[keep]
        for j in range(1, size):
            if not len(r):
                break
            column = order[r, j]
            ok = self.has(slots[r, column], s + column)
            r, s, d = r[ok], s[ok], d[ok]
        if reach is None:
            return (r, s), (r[:0], d[:0])
        return (r, s), self._near(slots, order, row, anchor, text, np.unique(r << 32 | d), reach)

    def _near(self, slots, order, row, anchor, text, done, reach):
        """(row, text) where some ``reach`` words of the text hold all words of the phrase, in any order."""
        low = np.maximum(self.starts[text], anchor - (reach - 1))
        high = np.minimum(self.starts[text + 1] - 1, anchor + (reach - 1))
        new = ~np.isin(row << 32 | text, done)
        row, anchor, text, low, high = (x[new] for x in (row, anchor, text, low, high))
        for j in range(1, slots.shape[1]):
            if not len(row):
                break
            ok = self.next(slots[row, order[row, j]], low) <= high
            row, anchor, text, low, high = (x[ok] for x in (row, anchor, text, low, high))
        # the texts' words [s, s + reach) that hold the anchor
        got = [done]
        for back in range(reach):
            s = anchor - back
            ok = s >= self.starts[text]
            end = np.minimum(s + reach, self.starts[text + 1])
            for j in range(slots.shape[1]):
                at = np.flatnonzero(ok)
                if not len(at):
                    break
                ok[at] = self.next(slots[row[at], j], s[at]) < end[at]
            if ok.any():
                found = np.unique(row[ok] << 32 | text[ok])
                got.append(found)
                left = ~np.isin(row << 32 | text, found)
                row, anchor, text = row[left], anchor[left], text[left]
        both = np.unique(np.concatenate(got))
        return both >> 32, both & 0xFFFFFFFF


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of stretches as the longest stretches, by start."""
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    opens = np.r_[True, start[1:] > end[:-1]]
    return start[opens], end[np.r_[np.flatnonzero(opens)[1:] - 1, len(end) - 1]]


def _search_block(postings: DataFrame, sent, reach: int | None, all_texts: bool) -> DataFrame:
    kind = postings.schema["ids"].dataType.elementType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Block = sent.value
        for b in batches:
            for k in range(b.num_rows):
                shard = Shard(b["starts"][k].as_py(), b["terms"][k].values, b["counts"][k].as_py(), b["places"][k].as_py())
                n = len(shard.starts) - 1
                phrase, start, length, near_phrase, near_text = shard.find(block, reach)
                spans, items, near = [[] for _ in range(n)], [set() for _ in range(n)], [set() for _ in range(n)]
                if len(start):
                    text = shard.doc(start)
                    for d, p in np.unique(np.c_[text, phrase], axis=0).tolist():
                        items[d].update(block.items[p])
                    # merged in each text: texts are kept apart by a word between them
                    a, e = _merged(start + text, start + length + text)
                    padded = shard.starts + np.arange(n + 1)
                    for d, x, y in zip((np.searchsorted(padded, a, "right") - 1).tolist(), a.tolist(), e.tolist(), strict=True):
                        spans[d].append({"start": x - d - int(shard.starts[d]), "end": y - d - int(shard.starts[d])})
                for d, p in zip(near_text.tolist(), near_phrase.tolist(), strict=True):
                    near[d].update(block.items[p])
                rows = [d for d in range(n) if all_texts or spans[d] or near[d]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(rows), b["shard"][k].as_py(), np.int64)), pa.array(rows, pa.int32()), b["ids"][k].values.take(pa.array(rows, pa.int64())),
                     pa.array(np.diff(shard.starts)[rows] if rows else [], pa.int64()), pa.array([spans[d] for d in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                     pa.array([sorted(items[d]) for d in rows], pa.list_(pa.string())), pa.array([sorted(near[d]) for d in rows], pa.list_(pa.string()))],
                    ["shard", "text", "id", "n_words", "spans", "items", "near_items"])

    return postings.mapInArrow(run, f"shard long, text int, id {kind}, n_words long, spans array<struct<start:long,end:long>>, items array<string>, near_items array<string>")


def search(postings: DataFrame, phrases: DataFrame, reach: int | None = None, block_bytes: int = BLOCK) -> DataFrame:
    """Of every text of ``postings``: id, n_words, spans (stretches of words inside exact occurrences of
    phrases), items (of phrases that occur), near_items (of phrases all of whose words stand, in any order,
    within ``reach`` words; occurring ones included; empty without ``reach``).

    ``phrases`` has columns words and items. They are sent to the tasks in as many blocks as their bytes ask
    for; each block passes over all shards, and texts that several blocks find are put together.
    """
    spark, phrases = postings.sparkSession, durable(phrases)
    size = F.length(F.array_join("words", " ")) + F.length(F.array_join("items", ","))
    total = phrases.agg(F.sum(size)).first()[0] or 0
    blocks = -(-total // block_bytes) or 1
    parts = []
    for k in range(blocks):
        held = phrases.filter(F.pmod(F.xxhash64("words"), F.lit(blocks)) == k).orderBy("words").toArrow()
        sent = spark.sparkContext.broadcast(Block(held["words"].to_pylist(), held["items"].to_pylist()))
        found = _search_block(postings, sent, reach, all_texts=not k)
        parts.append(durable(found) if blocks > 1 else found)
    if blocks == 1:
        return parts[0].drop("shard", "text")
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    joined = every.groupBy("shard", "text").agg(
        F.first("id").alias("id"), F.first("n_words").alias("n_words"), F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"),
        *[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])
    # stretches by start: one that begins within or right at the end of what is there prolongs it
    merged = F.expr("""aggregate(spans, cast(array() AS array<struct<start:bigint,end:bigint>>), (acc, x) ->
      CASE WHEN size(acc) > 0 AND x.start <= element_at(acc, -1).end
           THEN concat(slice(acc, 1, size(acc) - 1), array(named_struct('start', element_at(acc, -1).start, 'end', greatest(element_at(acc, -1).end, x.end))))
           ELSE concat(acc, array(x)) END)""")
    return joined.select("id", "n_words", merged.alias("spans"), "items", "near_items")


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, reach: int | None = REACH, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id", block_bytes: int = BLOCK) -> DataFrame:
    """The search of all windows of ``size`` words of ``items`` in all ``docs``; see ``search``.

    Null texts have no words; repeated rows and equal or null ids are texts of their own; an empty table of
    items finds nothing; other columns are not looked at.
    """
    return search(index(docs, text_col, id_col), windows(items, size, text_col, item_col), reach, block_bytes)


def query(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.end - x.start)")
    return found.select(
        F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"), F.size("near_items").cast("long").alias("n_near"))


_WORDS = r"list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE = f"""WITH d AS MATERIALIZED (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS MATERIALIZED (SELECT * FROM (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS MATERIALIZED (SELECT DISTINCT item, least(len(w), {WINDOW}) AS size, array_to_string(w[i + 1 : i + {WINDOW}], ' ') AS phrase FROM (SELECT *, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM b)),
gram AS MATERIALIZED (SELECT doc_id, size, i, array_to_string(w[i + 1 : i + size], ' ') AS phrase FROM (SELECT doc_id, w, size, unnest(range(len(w) - size + 1)) AS i FROM d JOIN (SELECT DISTINCT size FROM win) ON len(w) >= size)),
found AS MATERIALIZED (SELECT doc_id, item, size, i FROM gram JOIN win USING (size, phrase)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS place FROM (SELECT DISTINCT doc_id, size, i FROM found)) GROUP BY 1),
item AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY 1),
spread AS MATERIALIZED (SELECT doc_id, word, place FROM (SELECT doc_id, unnest(w) AS word, unnest(range(len(w))) AS place FROM d) WHERE word IN (SELECT unnest(w) FROM b)),
part AS MATERIALIZED (SELECT DISTINCT phrase, unnest(string_split(phrase, ' ')) AS word FROM win),
rare AS (SELECT phrase, arg_min(word, n) AS word, count(*) AS m FROM part LEFT JOIN (SELECT word, count(*) AS n FROM spread GROUP BY 1) USING (word) GROUP BY 1 HAVING count(n) = count(*)),
close AS MATERIALIZED (SELECT s.doc_id, r.phrase, r.m, s.place AS anchor, t.word, t.place FROM rare r JOIN spread s USING (word) JOIN part p ON p.phrase = r.phrase JOIN spread t ON t.doc_id = s.doc_id AND t.word = p.word AND t.place BETWEEN s.place - {REACH - 1} AND s.place + {REACH - 1}),
able AS MATERIALIZED (SELECT doc_id, phrase, anchor FROM close GROUP BY ALL HAVING count(DISTINCT word) = any_value(m)),
near AS (SELECT DISTINCT a.doc_id, a.phrase FROM close a JOIN able USING (doc_id, phrase, anchor) JOIN close b ON b.doc_id = a.doc_id AND b.phrase = a.phrase AND b.anchor = a.anchor AND b.place BETWEEN a.place AND a.place + {REACH - 1} GROUP BY a.doc_id, a.phrase, a.anchor, a.place HAVING count(DISTINCT b.word) = any_value(a.m)),
nears AS (SELECT doc_id, count(DISTINCT item) AS n_near FROM near JOIN win USING (phrase) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated, coalesce(n_near, 0) AS n_near
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN item USING (doc_id) LEFT JOIN nears USING (doc_id)"""
