"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source is dealt into blocks by a hash of the document, as many as its largest needs. What a source gives
is a list of block draws: whole copies of the source, then as many more blocks (in permuted order)
as reach its target, the last one cut at a document. A binary tree over the output shards splits
each source's number of draws exactly: at every node an urn draw without replacement decides how
many draws of each source go left. A shard then takes its own disjoint stretch of each source's
permuted draws and orders its documents by a local hash. DataFrame functions only; the tree holds
one count for each source and node, and the sources of a node stand in groups of about the root of
their number, so that no row holds them all.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, durable, table, text_or_empty, unused, with_rows

WEIGHTS, MAX_REPEATS = (5, 2, 1), 3
#: Documents that a block, and a shard, is to hold, about; at least so many blocks of a source and shards
#: (powers of two); parts of the one block that is cut.
BLOCK_DOCS, SHARD_DOCS, BLOCKS, SHARDS, PARTS = 20_000, 200_000, 128, 16, 512


def words(text):
    return F.regexp_count(text, F.lit(f"[^{SPACE}]+"))


def power(n: float, least: int) -> int:
    """The power of two from ``least`` on that is not under ``n``."""
    return max(least, 1 << max(0, math.ceil(n) - 1).bit_length())


def sized(docs: DataFrame, seed: int, row_col: str | None = None) -> DataFrame:
    """A durable small row per document: size, and its place (block, part, order) in its source."""
    most = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    blocks = power(most / BLOCK_DOCS, BLOCKS)
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    h = F.xxhash64(F.col("doc_id"), F.lit(seed))
    return durable(
        docs.select(row.alias("row"), "doc_id", "source", words(text_or_empty()).cast("long").alias("size"), h.alias("h"))
        .withColumn("block", F.pmod("h", F.lit(blocks)).cast("int"))
        .withColumn("part", F.pmod(F.shiftright("h", 20), F.lit(PARTS)).cast("int"))
    )


def in_order(df: DataFrame, order: list, sums: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in a durable copy with ``place`` (from 0) and, for each column of ``sums``, ``before_`` + its name: the
    sum over all rows earlier in the order.

    One sort by ranges: a row's number in its range is added to the sizes of the ranges before, of which
    there are no more than shuffle partitions.
    """
    placed = durable(df.orderBy(*order).withColumn("at_", F.monotonically_increasing_id())).withColumn("range_", F.shiftright("at_", 33))
    ranges = placed.groupBy("range_").agg(F.count(F.lit(1)).alias("n_"), *[F.sum(c).alias(f"all_{c}") for c in sums])
    earlier = Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = ranges.select("range_", F.coalesce(F.sum("n_").over(earlier), F.lit(0)).alias("n_"), *[F.coalesce(F.sum(f"all_{c}").over(earlier), F.lit(0)).alias(f"all_{c}") for c in sums])
    within = Window.partitionBy("range_").orderBy("at_")
    rows_before = within.rowsBetween(Window.unboundedPreceding, -1)
    found = placed.join(F.broadcast(ranges), "range_")
    found = found.withColumns({"place": F.col("n_") + F.row_number().over(within) - 1} | {f"before_{c}": F.col(f"all_{c}") + F.coalesce(F.sum(c).over(rows_before), F.lit(0)) for c in sums})
    return found.drop("range_", "at_", "n_", *[f"all_{c}" for c in sums])


def targets(rows: DataFrame) -> DataFrame:
    """source, source_size, target: shares of all words by weight, none above 3 times its size.

    Sources fill up in the order of limit / weight; the level is the first share of what is left
    that no later source's limit lies under.
    """
    per = in_order(rows.groupBy("source").agg(F.sum("size").alias("source_size")), [F.col("source").asc_nulls_last()])
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (F.col("place") % len(WEIGHTS) + 1).cast("int"))
    per = per.withColumn("weight", weight).drop("place").withColumn("most", (F.col("source_size") * MAX_REPEATS).cast("double")).withColumn("ratio", F.col("most") / F.col("weight"))
    per = durable(in_order(per, ["ratio", F.col("source").asc_nulls_last()], ("most", "weight")))
    total, weights = per.agg(F.sum("source_size"), F.sum("weight")).first()
    level = (F.lit(total) - F.col("before_most")) / (F.lit(weights) - F.col("before_weight"))
    found = per.withColumn("level", level).filter("level <= ratio").agg(F.min(F.struct("ratio", "level")).alias("best")).first()["best"]
    return per.select("source", "source_size", F.least("most", F.col("weight") * F.lit(found["level"] if found else 0.0)).alias("target"))


def _cut(pieces: DataFrame, keys: list[str], order: list, size: str, want: str) -> DataFrame:
    """``pieces`` with ``before``: words of the pieces that come earlier, and ``state``: whole, cut or out."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    p = pieces.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0)))
    return p.withColumn("state", F.when(F.col("before") + F.col(size) <= F.col(want), "whole").when(F.col("before") >= F.col(want), "out").otherwise("cut"))


def draws(rows: DataFrame, seed: int) -> tuple[DataFrame, DataFrame]:
    """(source, block, whole copies, state of the extra copy) and (row) of those the cut block gives.

    The cut goes down in two steps, block and part, so that no window holds more than
    1/(BLOCKS x PARTS) of a source.
    """
    same = F.col("a.source").eqNullSafe(F.col("b.source"))
    sources = durable(targets(rows).withColumn("full", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int"))
                      .withColumn("extra", F.col("target") - F.col("full") * F.col("source_size")))
    blocks = rows.groupBy("source", "block").agg(F.sum("size").alias("words")).alias("a").join(sources.alias("b"), same).select("a.*", "source_size", "target", "full", "extra")
    blocks = durable(_cut(blocks, ["source"], [F.xxhash64("source", "block", F.lit(seed + 1)), "block"], "words", "extra"))
    edge = F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block"))
    open_blocks = blocks.filter("state = 'cut'").select("source", "block", (F.col("extra") - F.col("before")).alias("rest"))
    parts = rows.groupBy("source", "block", "part").agg(F.sum("size").alias("words")).alias("a").join(open_blocks.alias("b"), edge).select("a.*", "rest")
    parts = _cut(parts, ["source", "block"], ["part"], "words", "rest").filter("state <> 'out'")
    inside = edge & (F.col("a.part") == F.col("b.part"))
    taken = rows.alias("a").join(parts.alias("b"), inside).select("a.*", "state", (F.col("rest") - F.col("before")).alias("room"))
    whole = taken.filter("state = 'whole'").select("row")
    last = _cut(taken.filter("state = 'cut'").drop("state"), ["source", "block", "part"], ["h", "doc_id", "row"], "size", "room")
    # the document on the edge goes in if that ends nearer to the target
    near = (F.col("state") == "whole") | ((F.col("state") == "cut") & (F.col("room") - F.col("before") > F.col("size") / 2))
    return blocks, whole.unionByName(last.filter(near).select("row"))


def _urn(depth: int, seed: int, name: str) -> str:
    """SQL: how many of each entry's n draws go left, of ``room`` places in all. Every draw is asked in turn
    and goes left with probability (places left) / (draws left): the urn without replacement."""
    took = f"""aggregate(sequence(1L, greatest(x.n, 1L)), struct(0L AS l, a.room AS room, a.rest AS rest), (z, i) ->
      CASE WHEN i > x.n THEN z
           WHEN (abs(xxhash64({seed}, {depth}, node, {name}, i)) % 1000000007) / 1000000007D * z.rest < z.room
           THEN struct(z.l + 1 AS l, z.room - 1 AS room, z.rest - 1 AS rest)
           ELSE struct(z.l AS l, z.room AS room, z.rest - 1 AS rest) END).l"""
    # one step of the outer fold works out an entry's share and moves on
    return f"""aggregate(s, struct(cast(room as long) AS room, total AS rest, cast(array() as array<bigint>) AS got), (a, x) ->
      transform(array({took}), l -> struct(a.room - l AS room, a.rest - x.n AS rest, array_append(a.got, l) AS got))[0]).got"""


def splitting_tree(quotas: DataFrame, seed: int, shards: int = SHARDS) -> DataFrame:
    """(source, n) -> (source, shard, n, first): exact counts by multivariate-hypergeometric splits.

    Of a node's N draws the left half takes N div 2. The sources stand in groups; first the groups'
    totals are drawn, then each group's share is drawn among its sources.
    """
    ranked = in_order(quotas, [F.col("source").asc_nulls_last()]).withColumnRenamed("place", "rank")
    group = F.floor(F.col("rank") / F.lit(max(1, math.isqrt(ranked.count())))).cast("int").alias("grp")
    nodes = ranked.select(F.lit(0).alias("node"), group, F.struct("rank", F.col("source").isNull().alias("none"), "source", "n").alias("s"))
    nodes = durable(nodes.groupBy("node", "grp").agg(F.sort_array(F.collect_list("s")).alias("s")).withColumn("total", F.expr("aggregate(s, 0L, (a, x) -> a + x.n)")))
    depth, width = 0, 1
    while width < shards:
        totals = nodes.groupBy("node").agg(F.sort_array(F.collect_list(F.struct("grp", F.col("total").alias("n")))).alias("s"), F.sum("total").alias("total"))
        rooms = totals.withColumn("room", F.expr("total div 2")).withColumn("left", F.expr(_urn(depth, seed, "x.grp")))
        rooms = rooms.select("node", F.expr("inline(arrays_zip(transform(s, x -> x.grp), `left`))")).toDF("node", "grp", "room")
        split = nodes.join(rooms, ["node", "grp"]).withColumn("left", F.expr(_urn(depth, seed + 1, "x.source")))
        halves = F.array(
            F.struct((F.col("node") * 2).alias("node"), "grp", F.expr("transform(s, (x, i) -> struct(x.rank AS rank, x.none AS none, x.source AS source, left[i] AS n))").alias("s"), F.col("room").alias("total")),
            F.struct((F.col("node") * 2 + 1).alias("node"), "grp", F.expr("transform(s, (x, i) -> struct(x.rank AS rank, x.none AS none, x.source AS source, x.n - left[i] AS n))").alias("s"), (F.col("total") - F.col("room")).alias("total")))
        nodes = split.select(F.inline(halves))
        depth, width = depth + 1, width * 2
        if depth % 4 == 0:
            nodes = durable(nodes)
    split = nodes.select(F.col("node").alias("shard"), F.inline("s")).drop("none", "rank")
    before = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return split.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))


def mixture(docs: DataFrame, seed: int = 11, shards: int | None = None, row_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, copies). rows: row, doc_id, source, size, source_size, target, taken, placed; one per document.
    placed: shard and place of every copy, "shard:place" joined by commas. ``shards``: by default as many
    as the documents need.
    copies: row, shard, place; one per time that a document is taken, ``place`` its order in the shard.

    Null sources are one source, last; null texts have size 0; a document of no words is taken as
    its block is, and adds nothing. Repeated ids are separate documents. An empty table gives two
    empty results. Other columns are not looked at.
    """
    rows = sized(docs, seed, row_col)
    shards = shards or power(rows.count() / SHARD_DOCS, SHARDS)
    blocks, cut = draws(rows, seed)
    cut = durable(cut.withColumn("in_cut", F.lit(True)))
    one = blocks.select("source", "block", "state", "source_size", "target", "full",
                        F.explode(F.sequence(F.lit(0), F.col("full"))).alias("copy"))
    one = one.filter("copy < full or state <> 'out'").withColumn("whole", F.expr("copy < full or state = 'whole'"))
    order = Window.partitionBy("source").orderBy(F.xxhash64("source", "block", "copy", F.lit(seed + 2)), "block", "copy")
    one = one.withColumn("at", F.row_number().over(order) - 1)
    tree = splitting_tree(one.groupBy("source").agg(F.count(F.lit(1)).alias("n")), seed, shards)
    # a row for each draw of a shard, so that draws meet by their number
    tree = tree.filter("n > 0").select("source", "shard", F.explode(F.sequence("first", F.col("first") + F.col("n") - 1)).alias("at"))
    placed = one.alias("d").join(tree.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")) & (F.col("d.at") == F.col("t.at")))
    per_block = placed.groupBy("d.source", "d.block").agg(F.collect_list(F.struct("d.copy", "d.whole", "t.shard")).alias("draws"))
    about = blocks.select("source", "block", "source_size", "target").alias("a").join(
        per_block.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.block") == F.col("b.block")), "left").select("a.*", "draws")
    joined = rows.alias("r").join(about.alias("q"), F.col("r.source").eqNullSafe(F.col("q.source")) & (F.col("r.block") == F.col("q.block")))
    joined = joined.select("r.row", "r.doc_id", "r.source", "r.size", "q.source_size", "q.target", "q.draws").join(cut, "row", "left")
    mine = F.filter(F.coalesce("draws", F.expr("cast(array() as array<struct<copy:int,whole:boolean,shard:int>>)")), lambda d: d["whole"] | F.coalesce("in_cut", F.lit(False)))
    place = lambda d: F.xxhash64("doc_id", "row", d["copy"], F.lit(seed + 3))
    mine = F.transform(mine, lambda d: F.struct(d["shard"].alias("shard"), place(d).alias("place")))
    joined = joined.withColumn("mine", F.sort_array(mine)).drop("draws", "in_cut")
    placed = F.array_join(F.transform("mine", lambda d: F.concat_ws(":", d["shard"].cast("string"), d["place"].cast("string"))), ",")
    out = joined.withColumn("taken", F.size("mine") * F.col("size")).withColumn("placed", placed).drop("mine")
    return out, joined.select("row", F.inline("mine"))


def mix(docs: DataFrame, seed: int = 11, shards: int | None = None) -> DataFrame:
    """The mixed documents with the columns of ``docs``: a row per copy, by shard, shuffled within it."""
    row, shard, place = unused(docs), unused(docs, "__shard"), unused(docs, "__place")
    rows = with_rows(docs, row)
    copies = mixture(rows, seed, shards, row)[1]
    mixed = rows.join(copies.withColumnsRenamed({"row": row, "shard": shard, "place": place}), row)
    # the place spreads a shard over tasks, so a shard may be larger than a task
    return mixed.repartition(shard, F.pmod(place, F.lit(64))).sortWithinPartitions(shard, place).select(*docs.columns)


def query(spark, sf_dir):
    return mixture(table(spark, sf_dir, "documents"))[0].select("doc_id", "size", "source_size", "target", "taken", "placed")
