"""Queries over the driver tables, one for each operator, and their SQL twins.

The driver tables hold no puzzles: relational operators run on tables of the same shape, and board
operators on a catalogue of positions dealt over ``part`` by its key.
"""

from __future__ import annotations

import random
import uuid
import warnings

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tactica.functions import arrays, evaltext, probs
from tactica.operators import features, metrics, relational, replay, sampling, scoring, tags
from tactica.sources import tables

from . import board_sql, build, models, tag_sql
from .play import LETTERS, Position, name_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

#: (id, FEN, moves): hand-checked positions, then stretches of random play.
CATALOGUE = [
    ("F01", "r1bqkbnr/pppp1ppp/2n5/4p2Q/2B1P3/8/PPPP1PPP/RNB1K1NR b KQkq - 3 3", "g8f6 h5f7"),
    ("F02", "6k1/5ppp/8/8/8/8/5PPP/3R2K1 b - - 0 1", "g8h8 d1d8"),
    ("F03", "6rk/p5pp/8/6N1/8/8/8/6K1 b - - 0 1", "a7a6 g5f7"),
    ("F04", "4k3/8/8/8/4p3/8/3P4/4K3 w - - 0 1", "d2d4 e4d3"),
    ("F05", "4k3/p7/8/8/8/8/8/4K2R b K - 0 1", "a7a6 e1g1"),
    ("F06", "8/P6k/8/8/8/8/8/K7 b - - 0 1", "h7g7 a7a8q"),
    ("F07", "8/P6k/8/8/8/8/8/K7 b - - 0 1", "h7g7 a7a8n"),
    ("F08", "4k3/8/8/8/8/3n4/8/R3K2R w KQ - 0 1", "e1e2 d3f4 e2e3 f4d5"),
    ("F10", "q3k3/8/8/3N4/8/8/8/4K3 b - - 0 1", "e8f8 d5c7 f8f7 c7a8"),
    ("F11", "q3k3/7p/8/3N4/8/8/8/4K3 b - - 0 1", "h7h6 d5c7 e8d7 c7a8"),
    ("F12", "r3k3/1P6/8/8/8/8/8/4K3 b - - 0 1", "e8e7 b7a8r"),
    ("F13", "4k3/8/8/8/8/8/8/4K3 w - - 0 1", "e1e2"),
    ("F14", "4k3/8/8/8/8/2b5/8/R3K2R w KQ - 0 1", "e1e2 c3a1 h1a1"),
    ("F15", "4k3/8/8/8/8/8/8/4K3 w - - 0 1", "e1e2 zz99"),
    # made for a theme each
    ("doubleBishopMate", "6k1/7p/8/8/8/1B4B1/8/4K3 b - - 0 1", "g8h8 g3e5"),
    ("bodenMate", "2kr4/3p3p/8/8/5B2/8/8/4KB2 b - - 0 1", "h7h6 f1a6"),
    ("anastasiaMate", "8/p3N1pk/8/8/8/8/4R3/4K3 b - - 0 1", "a7a6 e2h2"),
    ("arabianMate", "7k/R7/5N2/8/1p6/8/8/4K3 b - - 0 1", "b4b3 a7h7"),
    ("hookMate", "5r2/p5k1/5Np1/4P3/8/8/8/4K2R b - - 0 1", "a7a6 h1h7"),
    ("dovetailMate", "8/p7/3p4/2pk4/8/5P2/8/4Q1K1 b - - 0 1", "a7a6 e1e4"),
    ("doubleCheck", "4k3/p7/8/8/4N3/8/8/K3R3 b - - 0 1", "a7a6 e4f6"),
    ("xRayAttack", "R2r2nk/p7/8/3B4/8/8/8/4K3 b - - 0 1", "a7a6 d5g8 d8g8 a8g8"),
    ("skewer", "4k2q/7p/8/8/8/8/8/R3K3 b - - 0 1", "h7h6 a1a8 e8e7 a8h8"),
    ("interference", "1rb3k1/7p/8/8/Rn6/8/8/6K1 b - - 0 1", "h7h6 g1f1 c8b7 a4b4"),
    ("kingsideAttack", "rnbq1rk1/pppn1ppp/4p3/3pP3/3P4/2PB1N2/PP3PPP/RNBQK2R b KQ - 0 1", "a7a6 d3h7 g8h7 f3g5 h7g8 d1h5"),
    ("queensideAttack", "1kr1qbnr/ppp1nppp/3p4/3Pp3/4P3/2N1BP2/PP3PPP/R2KQBNR b - - 0 1", "h7h6 e3a7 b8a7 c3b5 a7b8 e1a5"),
]


def played(games: int = 14, plies: int = 60, every: int = 5, seed: int = 77) -> list[tuple[str, str, str]]:
    """Stretches of seeded random play, with captures and checks preferred: varied positions by rule."""
    rng, out = random.Random(seed), []
    for g in range(games):
        p, line = Position.from_fen("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"), []
        while len(line) < plies and (legal := p.legal_moves()):
            sharp = [m for m in legal if p.is_capture(*m[:2]) or m[2]]
            a, b, promo, _ = rng.choice(sharp if sharp and rng.random() < 0.45 else legal)
            line.append((p.fen(), name_of(a) + name_of(b) + (LETTERS[promo - 1].lower() if promo else "")))
            p = p.after(a, b, promo)
        for start in range(g % every, len(line) - 2, every):
            moves = [m for _, m in line[start : start + rng.randint(2, 11)]]
            out.append((f"G{g}-{start}", line[start][0], " ".join(moves)))
    return out


def sparse(count: int = 140, seed: int = 5) -> list[tuple[str, str, str]]:
    """Few men on seeded squares, then moves that mate, take or check where they can: endings and mates."""
    rng, out = random.Random(seed), []
    sets = ["Qq", "RRr", "BBbp", "NNnp", "QRr", "BBNp", "RNpp", "QNpp", "QRqr", "RRppp", "BBpppn", "QBrpp", "RNNpp", "QQrnpp"]
    while len(out) < count:
        men = "Kk" + sets[len(out) % len(sets)]
        board = [0] * 64
        corner = rng.choice([0, 7, 56, 63]) if rng.random() < 0.5 else None
        near = [s for s in range(64) if corner is not None and max(abs(s % 8 - corner % 8), abs(s // 8 - corner // 8)) <= 2]
        for man in men:
            free = [s for s in (near if man in "kpn" and near else range(64)) if not board[s] and (man not in "pP" or 0 < s // 8 < 7)]
            board[rng.choice(free or [s for s in range(8, 56) if not board[s]])] = (LETTERS.index(man.upper()) + 1) * (1 if man.isupper() else -1)
        p, moves = Position(board, -1, frozenset(), None), []
        if p.attackers(p.king(1), -1):
            continue
        start = p.fen()
        for _ in range(rng.choice([2, 4, 4, 6, 8])):
            legal = p.legal_moves()
            if not legal:
                break
            checks = [m for m in legal if p.turn > 0 and (after := p.after(*m[:3])).attackers(after.king(-1), 1)]
            best = [m for m in checks if not p.after(*m[:3]).legal_moves()] or (checks if rng.random() < 0.6 else []) or ([m for m in legal if p.is_capture(*m[:2])] if rng.random() < 0.6 else [])
            a, b, promo, _ = rng.choice(best or legal)
            moves.append(name_of(a) + name_of(b) + (LETTERS[promo - 1].lower() if promo else ""))
            p = p.after(a, b, promo)
        if len(moves) > 1:
            out.append((f"S{len(out)}", start, " ".join(moves)))
    return out


CATALOGUE += played() + sparse()
_VALUES = ", ".join(f"({i}, '{fen}', '{moves}')" for i, (_, fen, moves) in enumerate(CATALOGUE))
_PUZZLES_SQL = f"(SELECT CAST(p_partkey AS VARCHAR) AS PuzzleId, FEN, Moves, p_size * 20 - 300 AS cp FROM part JOIN (VALUES {_VALUES}) c(i, FEN, Moves) ON p_partkey % {len(CATALOGUE)} = c.i)"


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def puzzles(spark: SparkSession, d: str) -> DataFrame:
    cat = spark.createDataFrame([(i, fen, moves) for i, (_, fen, moves) in enumerate(CATALOGUE)], "i int, FEN string, Moves string")
    part = table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("PuzzleId"), (F.col("p_partkey") % len(CATALOGUE)).alias("i"), (F.col("p_size") * 20 - 300).alias("cp"))
    # a replay costs far more than the exchange of its short row: no core waits for the few files of a small table
    dealt = part.repartition(spark.sparkContext.defaultParallelism, "PuzzleId")
    return dealt.join(F.broadcast(cat), "i").select("PuzzleId", "FEN", "Moves", "cp")


# --- cleaning and joins ---------------------------------------------------------------------------


@query("filter_stable_ratings", "SELECT p_partkey, p_size FROM part WHERE p_size <= 25")
def _(s, d):
    return relational.stable_ratings(table(s, d, "part"), "p_size", 25).select("p_partkey", "p_size")


@query("rating_bands", "SELECT CASE WHEN o_totalprice < 120000 THEN 'low' WHEN o_totalprice <= 180000 THEN 'middle' ELSE 'high' END AS band, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return table(s, d, "orders").groupBy(relational.rating_band(F.col("o_totalprice"), 120000, 180000).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("column_family", "SELECT l_returnflag, CAST(sum(l_orderkey) AS BIGINT) AS l_orderkey, CAST(sum(l_partkey) AS BIGINT) AS l_partkey, CAST(sum(l_suppkey) AS BIGINT) AS l_suppkey FROM lineitem GROUP BY 1")
def _(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy("l_returnflag").agg(*[F.sum(c).alias(c) for c in relational.column_family(li, "key")])


@query("null_labels", "SELECT doc_id FROM documents LEFT JOIN labels USING (doc_id) WHERE toxic IS NULL")
def _(s, d):
    return table(s, d, "documents").select("doc_id").join(table(s, d, "labels"), "doc_id", "left").filter(F.col("toxic").isNull()).select("doc_id")


_LABELS = {"quality": 0, "toxic": 0}


@query("left_join_defaults", "SELECT doc_id, lang, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    return relational.left_with_defaults(table(s, d, "documents").select("doc_id", "lang"), table(s, d, "labels"), "doc_id", _LABELS)


@query("needs_evaluation", "SELECT doc_id, CAST(quality AS VARCHAR) AS quality, quality IS NULL AS needs_eval FROM documents LEFT JOIN labels USING (doc_id)")
def _(s, d):
    return relational.needs_evaluation(table(s, d, "documents").select("doc_id"), table(s, d, "labels"), "doc_id", "quality").withColumn("quality", F.col("quality").cast("string"))


@query("semi_then_left", "SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM (SELECT doc_id FROM documents WHERE lang = 'fr') LEFT JOIN labels USING (doc_id)")
def _(s, d):
    return relational.known_then_left(table(s, d, "documents").filter("lang = 'fr'"), table(s, d, "labels"), "doc_id", _LABELS)


@query("resume_unfinished", "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def _(s, d):
    return relational.unfinished(table(s, d, "documents"), table(s, d, "labels"), "doc_id", "quality").select("doc_id", "source")


@query("merge_results", "SELECT doc_id, quality, toxic FROM labels WHERE quality IS NOT NULL UNION ALL SELECT doc_id, CAST(n_chars % 2 AS INTEGER), 0 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality IS NOT NULL)")
def _(s, d):
    labels = table(s, d, "labels").select("doc_id", F.col("quality").cast("int").alias("quality"), F.col("toxic").cast("int").alias("toxic"))
    new = relational.unfinished(table(s, d, "documents"), labels, "doc_id", "quality").select("doc_id", (F.col("n_chars") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    return relational.merge_results(labels, new, "quality")


@query("move_context", "SELECT conv_id, turn, role, lag(role, 1) OVER w AS role_prev1, lag(role, 2) OVER w AS role_prev2, lead(role, 1) OVER w AS role_next1 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def _(s, d):
    return relational.neighbours(table(s, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", ["role"], back=2)


@query("side_counter", "SELECT conv_id, turn, CAST(turn % 2 AS BIGINT) AS side, CASE WHEN r <= 5 THEN CAST(r - 1 AS INTEGER) END AS number FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn) AS r FROM conversations)")
def _(s, d):
    return relational.side_counter(table(s, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", F.col("turn") % 2)


@query("named_importances", "SELECT 'f' || p_partkey AS feature_id, p_retailprice AS gain, coalesce(n_name, 'f' || p_partkey) AS name FROM part LEFT JOIN nation ON p_partkey = n_nationkey")
def _(s, d):
    gains = table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("feature_id"), F.col("p_retailprice").alias("gain"))
    names = table(s, d, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("names"))
    return relational.named_importances(gains, names)


# --- sources --------------------------------------------------------------------------------------


def scratch(s: SparkSession) -> str:
    """A new folder that all executors see, for tables that are written and read again."""
    return f"{tables.shared_dir(s)}/table-{uuid.uuid4().hex}"


def puzzle_table(s, d) -> DataFrame:
    """Puzzles with ratings and a probability column, of ``part``."""
    part = table(s, d, "part").select(F.col("p_partkey").cast("string").alias("PuzzleId"), (1_000 + F.col("p_size") * 20).cast("int").alias("Rating"), (F.col("p_partkey") % 120).cast("int").alias("RatingDeviation"),
                                      F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")).alias("Themes"), (F.col("p_size") / 64).alias("success_prob_blitz_1050"))
    return puzzles(s, d).drop("cp").join(part, "PuzzleId")


_PUZZLE_TABLE_SQL = f"""(SELECT PuzzleId, FEN, Moves, CAST(1000 + p_size * 20 AS INTEGER) AS Rating, CAST(p_partkey % 120 AS INTEGER) AS RatingDeviation,
  CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS Themes, p_size / 64.0::DOUBLE AS success_prob_blitz_1050 FROM {_PUZZLES_SQL} JOIN part ON CAST(p_partkey AS VARCHAR) = PuzzleId)"""


@query("read_puzzles", f"SELECT PuzzleId, FEN, Moves, Rating, RatingDeviation, Themes, success_prob_blitz_1050 FROM {_PUZZLE_TABLE_SQL}")
def _(s, d):
    """Written as CSV with a header (S7) and read by the explicit schema."""
    path = f"{scratch(s)}.csv"
    tables.write_table(puzzle_table(s, d), path)
    return tables.read_puzzles(s, path, extra=["success_prob_blitz_1050"])


@query("read_pruned", f"SELECT PuzzleId, Rating FROM {_PUZZLE_TABLE_SQL}")
def _(s, d):
    """Two columns of a Parquet table (S2), checked for the required ones."""
    path = scratch(s)
    tables.write_table(puzzle_table(s, d), path)
    return tables.read_puzzles(s, path, columns=["PuzzleId", "Rating"])


@query("first_rows", "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def _(s, d):
    return tables.first_rows(table(s, d, "orders").select("o_orderkey", "o_custkey"), 100, "o_orderkey")


@query("required_columns", "SELECT t AS table_name, missing FROM (VALUES ('part', 'FEN, Moves'), ('orders', 'FEN, Moves, PuzzleId')) x(t, missing), (SELECT count(*) AS n FROM part) WHERE n > 0")
def _(s, d):
    """What the check of required columns (S4) says of tables that lack them."""
    rows = []
    for name, df in (("part", table(s, d, "part").withColumnRenamed("p_partkey", "PuzzleId")), ("orders", table(s, d, "orders"))):
        try:
            tables.require_columns(df, ["FEN", "Moves", "PuzzleId"])
        except ValueError as e:
            rows.append((name, str(e).removeprefix("missing columns: ")))
    some = table(s, d, "part").limit(1).select(F.explode(F.array(*[F.struct(F.lit(a).alias("table_name"), F.lit(b).alias("missing")) for a, b in rows])).alias("x"))
    return some.select("x.*")


def _probs_store(s, d) -> str:
    path = scratch(s)
    rows = table(s, d, "lineitem").select(F.col("l_orderkey").alias("pid"), F.col("l_linenumber").alias("move_idx"), F.expr("element_at(array('maia1', 'maia2_rapid', 'maia2_blitz'), cast(l_linenumber % 3 + 1 as int))").alias("source"),
                                          (1100 + 200 * (F.col("l_partkey") % 5)).cast("int").alias("elo"), F.col("l_discount").alias("prob"))
    tables.write_move_probs(rows, path)
    return path


@query("move_prob_store", "SELECT CASE l_linenumber % 3 WHEN 0 THEN 'maia1' ELSE 'maia2_rapid' END AS source, CAST(1100 + 200 * (l_partkey % 5) AS INTEGER) AS elo, count(*) AS n, round(sum(l_discount), 6) AS total FROM lineitem WHERE l_linenumber % 3 <> 2 AND l_partkey % 5 IN (0, 2) GROUP BY 1, 2")
def _(s, d):
    """Two sources and two levels of the partitioned store (S5); a source that is not there is left out."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        found = tables.read_move_probs(s, _probs_store(s, d), ["maia1", "maia2_rapid", "absent"], [1100, 1500])
    return found.groupBy("source", "elo").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("prob"), 6).alias("total"))


@query("block_store", f"""SELECT PuzzleId, CAST(SolutionLength AS DOUBLE) AS length, round(2.5 * SolutionLength, 3)::DOUBLE AS other
FROM (SELECT PuzzleId, len(string_split(Moves, ' ')) AS SolutionLength FROM {_PUZZLES_SQL})""")
def _(s, d):
    """Rows that are there already are read, others computed (S6): a third of the puzzles, some of those changed
    since, then all; compacted."""
    p = puzzles(s, d)
    blocks = {"length": lambda df: features.basic(df).select("PuzzleId", F.array(F.col("SolutionLength").cast("double")).alias("length")),
              "other": lambda df: features.basic(df).select("PuzzleId", F.array(F.col("SolutionLength") * 2.5).alias("other"))}
    store = tables.BlockStore(s, scratch(s))
    compute = lambda name, some: blocks[name](some)
    before = p.filter("PuzzleId % 3 = 0").withColumn("Moves", F.when(F.expr("PuzzleId % 2 = 0"), F.col("Moves")).otherwise(F.concat("Moves", F.lit(" a1a1"))))
    store.load(["length"], compute, before)
    store.load(["length", "other"], compute, p)
    store.compact("length", p)
    found = store.load(["length", "other"], compute, p)
    m = models.assemble(p.select(F.col("PuzzleId").alias("pid")), {n: b.withColumnRenamed("PuzzleId", "pid") for n, b in found.items()})
    return m.select(F.col("pid").alias("PuzzleId"), F.col("length")[0].alias("length"), F.round(F.col("other")[0], 3).alias("other"))


@query("write_metrics", "SELECT l_returnflag AS model, CAST(l_linenumber % 5 AS INTEGER) AS fold, round(avg(l_tax), 6) AS mse, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    """A table of metrics, written by model and read again."""
    path = scratch(s)
    rows = table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("model"), (F.col("l_linenumber") % 5).alias("fold")).agg(F.round(F.avg("l_tax"), 6).alias("mse"), F.count(F.lit(1)).alias("n"))
    tables.write_table(rows, path, ["model"])
    return s.read.parquet(path).select("model", F.col("fold").cast("int").alias("fold"), "mse", "n")


@query("stored_embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def _(s, d):
    """Embeddings written together with their ids."""
    path = scratch(s)
    tables.write_embeddings(table(s, d, "embeddings"), path, "vec_id", "embedding")
    e = s.read.parquet(path)
    return e.select("vec_id", F.size("embedding").alias("width"), F.round(arrays.total(F.col("embedding").cast("array<double>")), 5).alias("total"))


@query("chosen_blocks", "SELECT l_linenumber, array_to_string(CASE l_linenumber % 3 WHEN 0 THEN ['struct', 'themes', 'advanced', 'maia2', 'maia1'] WHEN 1 THEN ['struct', 'themes', 'advanced', 'stockfish', 'maia1'] ELSE ['themes'] END, ' ') AS blocks, count(*) AS n FROM lineitem GROUP BY 1, 2")
def _(s, d):
    """The block set by flags, or an explicit list (P7), for each case of a column."""
    cases = [relational.choose_blocks(), relational.choose_blocks(stockfish=True, maia2=False), relational.choose_blocks(["themes"])]
    blocks = F.element_at(F.array(*[F.lit(" ".join(c)) for c in cases]), (F.col("l_linenumber") % 3 + 1).cast("int"))
    return table(s, d, "lineitem").groupBy("l_linenumber", blocks.alias("blocks")).agg(F.count(F.lit(1)).alias("n"))


# --- aggregation, samples, splits -----------------------------------------------------------------

_BUCKET = lambda key, seed, n: f"(('0x' || substr(md5('{seed}:' || CAST({key} AS VARCHAR)), 1, 8))::BIGINT % {n})"


@query("rating_histogram", "SELECT CAST(floor(o_totalprice / 1000) * 1000 AS BIGINT) AS bin, count(*) AS n FROM orders GROUP BY 1")
def _(s, d):
    return sampling.histogram(table(s, d, "orders"), "o_totalprice", 1000)


@query("label_vocabulary", "SELECT DISTINCT unnest(string_split(p_name, ' ')) AS label FROM part")
def _(s, d):
    return sampling.vocabulary(table(s, d, "part"), "p_name")


@query("multi_hot", """WITH v AS (SELECT list_sort(list(DISTINCT w)) AS words FROM (SELECT unnest(string_split(p_name, ' ')) AS w FROM part))
SELECT p_partkey, array_to_string(list_transform(words, lambda w: CASE WHEN list_contains(string_split(p_name, ' '), w) THEN 1 ELSE 0 END), '') AS encoded FROM part, v""")
def _(s, d):
    part = table(s, d, "part")
    coded, _words = sampling.encode_labels(part, part.select("p_partkey", "p_name"), "p_partkey", "p_name")
    return coded.select("p_partkey", F.array_join("encoded", "").alias("encoded"))


@query("seeded_sample", "SELECT o_orderkey FROM orders ORDER BY md5('67:' || CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 500")
def _(s, d):
    return sampling.sample(table(s, d, "orders").select("o_orderkey"), "o_orderkey", 500, 67)


@query("split_80_10_10", f"SELECT o_orderkey, CASE WHEN {_BUCKET('o_orderkey', 42, 1000000)} < 100000 THEN 'test' WHEN {_BUCKET('o_orderkey', 43, 1000000)} < 111111 THEN 'val' ELSE 'train' END AS split FROM orders")
def _(s, d):
    return sampling.split(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


@query("kfold", f"SELECT o_orderkey, CAST({_BUCKET('o_orderkey', 42, 5)} AS INTEGER) AS fold FROM orders")
def _(s, d):
    return sampling.folds(table(s, d, "orders").select("o_orderkey"), "o_orderkey")


@query("reuse_split", f"SELECT split, count(*) AS n FROM (SELECT CASE WHEN {_BUCKET('o_orderkey', 42, 1000000)} < 100000 THEN 'test' WHEN {_BUCKET('o_orderkey', 43, 1000000)} < 111111 THEN 'val' ELSE 'train' END AS split FROM orders JOIN lineitem ON o_orderkey = l_orderkey) GROUP BY 1")
def _(s, d):
    splits = sampling.split(table(s, d, "orders").select("o_orderkey"), "o_orderkey")
    return sampling.reuse_split(table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), splits, "o_orderkey").groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("sample_weight", "SELECT p_partkey, round(1.0 / greatest(CAST(p_size - 10 AS DOUBLE), 1.0), 9) AS weight FROM part")
def _(s, d):
    return table(s, d, "part").select("p_partkey", F.round(sampling.weight(F.col("p_size") - 10), 9).alias("weight"))


@query("standardise", """WITH m AS (SELECT avg(p_retailprice) AS a, stddev_pop(p_retailprice) AS b FROM part WHERE p_partkey % 5 <> 0)
SELECT p_partkey, round((p_retailprice - a) / b, 6) AS scaled FROM part, m""")
def _(s, d):
    scaled = sampling.standardise(table(s, d, "part"), ["p_retailprice"], F.col("p_partkey") % 5 != 0)
    return scaled.select("p_partkey", F.round("p_retailprice", 6).alias("scaled"))


_PRED_SQL = f"""(SELECT o_orderkey, model, o_totalprice / 1000 AS y, CASE model WHEN 'a' THEN o_totalprice / 1100 ELSE 100 + o_custkey % 97 END AS yhat,
  CAST({_BUCKET('o_orderkey', 42, 5)} AS INTEGER) AS fold FROM orders, (VALUES ('a'), ('b')) m(model))"""


def predictions(s, d):
    rows = sampling.folds(table(s, d, "orders"), "o_orderkey").withColumn("model", F.explode(F.array(F.lit("a"), F.lit("b"))))
    guess = F.when(F.col("model") == "a", F.col("o_totalprice") / 1100).otherwise(100 + F.col("o_custkey") % 97)
    return rows.select("o_orderkey", "model", "fold", (F.col("o_totalprice") / 1000).alias("y"), guess.alias("yhat"))


def fold_errors(s, d):
    return metrics.errors(predictions(s, d), ["model", "fold"]).select("model", "fold", F.round("mse", 6).alias("val_mse"), F.round("rmse", 6).alias("val_rmse"))


_FOLDS_SQL = f"(SELECT model, fold, round(avg(pow(y - yhat, 2)), 6) AS val_mse, round(sqrt(avg(pow(y - yhat, 2))), 6) AS val_rmse FROM {_PRED_SQL} GROUP BY 1, 2)"


@query("model_errors", f"SELECT * FROM {_FOLDS_SQL}")
def _(s, d):
    return fold_errors(s, d)


@query("fold_summary", f"""SELECT model, round(avg(val_mse), 5) AS val_mse_mean, round(stddev_pop(val_mse), 5) AS val_mse_std, round(avg(val_rmse), 5) AS val_rmse_mean, round(stddev_pop(val_rmse), 5) AS val_rmse_std,
  arg_min(fold, (val_rmse, fold)) AS best_fold, arg_min(val_mse, (val_rmse, fold)) AS best_val_mse, min(val_rmse) AS best_val_rmse,
  arg_min(fold, (-val_rmse, fold)) AS worst_fold, arg_min(val_mse, (-val_rmse, fold)) AS worst_val_mse, max(val_rmse) AS worst_val_rmse FROM {_FOLDS_SQL} GROUP BY 1""")
def _(s, d):
    out = metrics.leaderboard(metrics.fold_summary(fold_errors(s, d)))
    return out.select(*[F.round(c, 5).alias(c) if c.endswith(("_mean", "_std")) else F.col(c) for c in out.columns])


@query("final_average", f"""WITH f AS (SELECT CAST(fold AS VARCHAR) AS fold, val_mse AS mse, val_rmse AS rmse FROM {_FOLDS_SQL} WHERE model = 'a')
SELECT fold, round(mse, 5) AS mse, round(rmse, 5) AS rmse FROM f UNION ALL SELECT 'Final Average', round(avg(mse), 5), round(sqrt(avg(mse)), 5) FROM f""")
def _(s, d):
    rows = fold_errors(s, d).filter("model = 'a'").select("fold", F.col("val_mse").alias("mse"), F.col("val_rmse").alias("rmse"))
    return metrics.with_final_average(rows).select("fold", F.round("mse", 5).alias("mse"), F.round("rmse", 5).alias("rmse"))


@query("leaderboard", f"SELECT model, round(sqrt(avg(pow(y - yhat, 2))), 5) AS rmse FROM {_PRED_SQL} GROUP BY 1 ORDER BY 2, 1")
def _(s, d):
    return metrics.leaderboard(metrics.errors(predictions(s, d), ["model"]).select("model", F.round("rmse", 5).alias("rmse")), "rmse")


@query("top_features", "SELECT 'f' || p_partkey AS feature_id, p_retailprice AS gain FROM part ORDER BY p_retailprice DESC, 'f' || p_partkey LIMIT 30")
def _(s, d):
    return metrics.top_features(table(s, d, "part").select(F.concat(F.lit("f"), F.col("p_partkey")).alias("feature_id"), F.col("p_retailprice").alias("gain")))


@query("residuals", f"SELECT o_orderkey, model, round(yhat - y, 6) AS residual FROM {_PRED_SQL}")
def _(s, d):
    return metrics.residuals(predictions(s, d)).select("o_orderkey", "model", F.round("residual", 6).alias("residual"))


# --- numeric features -----------------------------------------------------------------------------


@query("curve_features", """WITH e AS (SELECT vec_id, list_transform(embedding[1:22], lambda x: CAST(x AS DOUBLE)) AS a FROM embeddings),
m AS (SELECT *, list_avg(a) AS mu FROM e), k AS (SELECT *, list_avg(list_transform(a, lambda x: (x - mu) ** 2)) AS m2, list_avg(list_transform(a, lambda x: (x - mu) ** 3)) AS m3,
 list_transform(range(1, 22), lambda i: a[i + 1] - a[i]) AS d1 FROM m), j AS (SELECT *, list_transform(range(1, 21), lambda i: d1[i + 1] - d1[i]) AS d2 FROM k)
SELECT vec_id, round(mu, 6) AS prob_mean, round(sqrt(m2), 6) AS prob_std, round(list_min(a), 6) AS prob_min, round(list_max(a), 6) AS prob_max, round(list_max(a) - list_min(a), 6) AS prob_range,
 round(m3 / m2 ** 1.5, 6) AS prob_skew, CAST(list_position(d2, list_min(d2)) - 1 AS BIGINT) AS inflection_idx, round(list_min(d1), 6) AS max_pairwise_drop FROM j""")
def _(s, d):
    e = table(s, d, "embeddings")
    found = arrays.curve_features([F.col("embedding")[i] for i in range(22)])
    return e.select("vec_id", *[F.round(c, 6).alias(n) if n != "inflection_idx" else c.cast("bigint").alias(n) for n, c in found.items()])


@query("mean_pool", "SELECT vec_id, array_to_string(list_transform(range(8), lambda j: round(list_sum(list_transform(range(8), lambda i: CAST(embedding[i * 8 + j + 1] AS DOUBLE))) / 10, 5)::DECIMAL(12, 5)), ',') AS pooled FROM embeddings")
def _(s, d):
    steps = F.array(*[F.slice(F.col("embedding").cast("array<double>"), 8 * i + 1, 8) for i in range(8)])
    pooled = F.transform(arrays.mean_pool(steps, 8, 10), lambda x: F.round(x, 5).cast("decimal(12,5)").cast("string"))
    return table(s, d, "embeddings").select("vec_id", F.array_join(pooled, ",").alias("pooled"))


def move_probs(s, d) -> DataFrame:
    """A move-probability table of the embeddings: softmax of ten numbers for each move and level."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("z"), "label")
    cells = e.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(24)))).withColumns({"move_idx": F.expr("c div 5").cast("int"), "elo": F.expr("1100 + 200 * (c % 5)").cast("int")})
    cells = cells.filter("move_idx < 1 + label % 5")
    p = cells.withColumn("p", arrays.softmax(F.slice("z", F.col("c") * 2 + 1, 10)))
    best = p.withColumns({"best": arrays.top_k(F.col("p"))}).withColumn("policy_idx", F.expr("cast(CASE WHEN (pid + move_idx) % 11 = 10 THEN -1 ELSE (pid + move_idx) % 11 END AS int)"))
    return best.select("pid", F.lit("maia1").alias("source"), "elo", "move_idx", arrays.at(F.col("p"), F.col("policy_idx")).alias("prob"), "policy_idx",
                       F.transform("best", lambda x: x["p"]).alias("top5_probs"), F.transform("best", lambda x: x["i"].cast("int")).alias("top5_idx"))


_CELLS_SQL = """WITH c AS (SELECT vec_id AS pid, label, CAST(c // 5 AS INTEGER) AS move_idx, CAST(1100 + 200 * (c % 5) AS INTEGER) AS elo,
 list_transform(embedding[c * 2 + 1 : c * 2 + 10], lambda x: CAST(x AS DOUBLE)) AS z, CASE WHEN (vec_id + c // 5) % 11 = 10 THEN -1 ELSE CAST((vec_id + c // 5) % 11 AS INTEGER) END AS idx
 FROM embeddings, range(25) r(c) WHERE c // 5 < 1 + label % 5),
x AS (SELECT *, list_transform(z, lambda v: exp(v - list_max(z))) AS ex FROM c), s AS (SELECT *, list_transform(ex, lambda v: v / list_sum(ex)) AS p FROM x),
m AS (SELECT pid, move_idx, elo, idx, CASE WHEN idx >= 0 THEN coalesce(p[idx + 1], 0) ELSE 0 END AS prob, list_max(p) AS top1, p,
 CASE WHEN idx >= 0 AND idx < 10 THEN len(list_filter(p, lambda v: v > p[idx + 1])) + 1 ELSE 6 END AS r FROM s),
t AS (SELECT pid, move_idx, elo, prob, CASE WHEN r <= 5 THEN r ELSE 6 END AS rank, top1 FROM m) """


@query("move_probability_columns", _CELLS_SQL + "SELECT pid, elo, move_idx, round(prob, 6) AS prob, CAST(rank AS INTEGER) AS rank, round(top1 - prob, 6) AS gap, round(prob / (top1 + 1e-7), 6) AS ratio FROM t")
def _(s, d):
    return probs.move_columns(move_probs(s, d)).select("pid", "elo", "move_idx", F.round("prob", 6).alias("prob"), "rank", F.round("gap", 6).alias("gap"), F.round("ratio", 6).alias("ratio"))


@query("level_statistics", _CELLS_SQL + """SELECT pid, 'maia1' AS source, elo, round(sum(prob) / 5, 6) AS prob_mean, round(CASE WHEN count(*) < 5 THEN 0 ELSE min(prob) END, 6) AS prob_min, round(max(prob), 6) AS prob_max,
 round(sum(CASE WHEN prob > 0 THEN -ln(prob + 1e-7) ELSE 0 END) / 5, 6) AS ce_mean, round(max(CASE WHEN prob > 0 THEN -ln(prob + 1e-7) ELSE 0 END), 6) AS ce_max,
 round(product(CASE WHEN prob > 0 THEN prob ELSE 1 END), 9) AS joint, round(sum(CASE WHEN prob > 0 THEN ln(prob + 1e-7) ELSE 0 END), 6) AS log_joint FROM t GROUP BY pid, elo""")
def _(s, d):
    out = probs.level_statistics(move_probs(s, d))
    return out.select("pid", "source", "elo", *[F.round(c, 9 if c == "joint" else 6).alias(c) for c in out.columns[3:]])


@query("probability_vector", _CELLS_SQL + """, grid AS (SELECT pid, m, e FROM (SELECT DISTINCT pid FROM t), range(5) a(m), range(5) b(e)),
f AS (SELECT grid.pid, m, e, coalesce(prob, 0) AS prob, coalesce(rank, 6) AS rank, coalesce(top1 - prob, 0) AS gap FROM grid LEFT JOIN t ON t.pid = grid.pid AND t.move_idx = m AND t.elo = 1100 + 200 * e)
SELECT pid, CAST(180 AS INTEGER) AS width, round(sum(prob), 6) AS flat_prob, round(sum(prob) / 5, 6) AS mean_prob, round(sum(rank), 6) AS flat_rank, round(sum(gap), 6) AS flat_gap FROM f GROUP BY pid""")
def _(s, d):
    v = probs.wide_vector(move_probs(s, d))
    part = lambda a, n: arrays.total(F.slice("features", a, n))
    return v.select("pid", F.size("features").alias("width"), F.round(part(1, 25), 6).alias("flat_prob"), F.round(part(26, 5), 6).alias("mean_prob"), F.round(part(61, 25), 6).alias("flat_rank"), F.round(part(101, 25), 6).alias("flat_gap"))


_PER = ["avg(prob)", "min(prob)", "max(prob)", "avg(ce)", "max(ce)", "product(CASE WHEN prob > 0 THEN prob ELSE 1 END)", "0 - sum(ce)"]


@query("probability_cells", _CELLS_SQL + f""", f AS MATERIALIZED (SELECT g.pid, m, e, coalesce(prob, 0) AS prob, CASE WHEN prob > 0 THEN -ln(prob + 1e-7) ELSE 0 END AS ce, coalesce(rank, 6) AS rank, coalesce(top1 - prob, 0) AS gap, coalesce(prob / (top1 + 1e-7), 0) AS ratio
  FROM (SELECT DISTINCT pid FROM t) g CROSS JOIN range(5) a(m) CROSS JOIN range(5) b(e) LEFT JOIN t ON t.pid = g.pid AND t.move_idx = m AND t.elo = 1100 + 200 * e)
SELECT pid, CAST(place AS INTEGER) AS place, round(v, 6) AS value FROM (
  SELECT pid, m * 5 + e AS place, prob AS v FROM f
  UNION ALL SELECT pid, unnest([{", ".join(f"{25 + 5 * k} + e" for k in range(7))}]), unnest([{", ".join(_PER)}]) FROM f GROUP BY pid, e
  {" ".join(f"UNION ALL SELECT pid, {60 + 40 * k} + m * 5 + e, {c} FROM f UNION ALL SELECT pid, unnest([{85 + 40 * k} + e, {90 + 40 * k} + e, {95 + 40 * k} + e]), unnest([avg({c}), min({c}), max({c})]) FROM f GROUP BY pid, e" for k, c in enumerate(("rank", "gap", "ratio")))})""")
def _(s, d):
    """Every value of the 180-wide vector in its place."""
    v = probs.wide_vector(move_probs(s, d)).select("pid", F.posexplode("features").alias("place", "value"))
    return v.select("pid", "place", F.round("value", 6).alias("value"))


@query("specialist_vector", _CELLS_SQL + """, grid AS (SELECT pid, m FROM (SELECT DISTINCT pid FROM t), range(5) a(m)),
f AS (SELECT grid.pid, m, coalesce(prob, 0) AS prob, coalesce(rank, 6) AS rank, coalesce(prob / (top1 + 1e-7), 0) AS ratio FROM grid LEFT JOIN t ON t.pid = grid.pid AND t.move_idx = m AND t.elo = 1500)
SELECT pid, CAST(36 AS INTEGER) AS width, round(sum(prob), 6) AS flat_prob, round(max(prob), 6) AS max_prob, round(sum(rank) / 5, 6) AS mean_rank, round(max(ratio), 6) AS max_ratio FROM f GROUP BY pid""")
def _(s, d):
    """One level only: 36 columns (M13), chosen by a source label."""
    v = probs.wide_vector(relational.select_source(move_probs(s, d), "maia-1-1500"), elos=(1500,))
    at = {n: i for i, n in enumerate(probs.vector_names((1500,)))}
    one = lambda n: F.round(F.get("features", F.lit(at[n])), 6)
    return v.select("pid", F.size("features").alias("width"), F.round(arrays.total(F.slice("features", 1, 5)), 6).alias("flat_prob"), one("prob_max_1500").alias("max_prob"), one("rank_mean_1500").alias("mean_rank"), one("ratio_max_1500").alias("max_ratio"))


@query("engine_text", """WITH t AS (SELECT p_partkey, p_size FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN round(p_size / 10.0, 2)::DOUBLE END AS SF_Material, CASE WHEN p_partkey % 4 <> 0 THEN -0.25::DOUBLE END AS SF_Positional,
 CASE WHEN p_partkey % 4 = 0 THEN (CASE WHEN p_partkey % 3 = 0 THEN -10000 ELSE p_size END)::DOUBLE ELSE (p_size || '.50')::DOUBLE END AS SF_Final_Eval,
 CASE WHEN p_partkey % 3 = 0 THEN -10000 ELSE p_size END AS cp, CASE WHEN p_partkey % 3 = 0 THEN -10000 ELSE p_size END::DOUBLE AS SF_Last_Move_CP FROM t""")
def _(s, d):
    part, size = table(s, d, "part"), F.col("p_size")
    text = F.when(F.col("p_partkey") % 4 == 0, "Final evaluation: none (in check)").otherwise(F.concat(
        F.lit("|  0 | + 0.10 | - 1.00 | + 0.2 |\n|  4 |  + 9.99 | - 9.99 | + 0.2 | <-- this bucket is used\n|  5 |  + "), (size / 10).cast("decimal(6,2)").cast("string"), F.lit(" | - 0.25 | + 0.2 | <-- this bucket is used\nFinal evaluation       +"),
        size.cast("string"), F.lit(".50 (white side)\n")))
    search = F.concat(F.lit("info depth 1 score cp 9\ninfo depth 2 score "), F.when(F.col("p_partkey") % 3 == 0, "mate -2").otherwise(F.concat(F.lit("cp "), size)), F.lit("\nbestmove e2e4"))
    rows = part.select("p_partkey", text.alias("t"), search.alias("s"))
    return rows.select("p_partkey", *[c.alias(n) for n, c in evaltext.eval_columns(F.col("t"), F.col("s")).items()], evaltext.search_centipawn(F.col("s")).alias("cp"))


@query("pca")
def _(s, d):
    out, variance = scoring.centred_pca(table(s, d, "embeddings").select("vec_id", "embedding"), "embedding", 4)
    return out.select("vec_id", F.expr("round(aggregate(pca, 0D, (a, x) -> a + x * x), 4)").alias("norm"), F.lit(round(float(sum(variance)), 6)).alias("explained"))


# --- boards ---------------------------------------------------------------------------------------

_COUNT = lambda cls: f"length(regexp_replace(split_part(FEN, ' ', 1), '[^{cls}]', '', 'g'))"
_BALANCE = " + ".join(f"({_COUNT(c)} - {_COUNT(c.lower())}) * {v}" for c, v in zip("PNBRQ", (1, 3, 3, 5, 9), strict=True))


@query("board_basics", f"""SELECT PuzzleId, CAST(len(string_split(Moves, ' ')) AS INTEGER) AS SolutionLength, CAST(split_part(FEN, ' ', 2) = 'w' AS INTEGER) AS IsWhiteToMove,
 CAST({_COUNT('A-Z')} AS INTEGER) AS white_pieces, CAST({_COUNT('a-z')} AS INTEGER) AS black_pieces, CAST({_BALANCE} AS INTEGER) AS material_balance FROM {_PUZZLES_SQL}""")
def _(s, d):
    return features.basic(puzzles(s, d))


_BOARDS = board_sql.boards(CATALOGUE)
_PART = f"JOIN part ON p_partkey % {len(CATALOGUE)} = x.i"
_ID = "CAST(p_partkey AS VARCHAR) AS PuzzleId"


@query("board_features", _BOARDS + f""", mine AS (SELECT i, f, t, abs(mover) AS kind, greatest(abs(f % 8 - t % 8), abs(f // 8 - t // 8)) AS far, n FROM node WHERE t IS NOT NULL AND n % 2 = 1),
apart AS (SELECT x.i, avg(greatest(abs(x.f % 8 - y.f % 8), abs(x.f // 8 - y.f // 8))) AS d FROM mine x JOIN mine y ON x.i = y.i AND x.n < y.n GROUP BY 1),
part4 AS (SELECT i, count(DISTINCT f) AS a, count(DISTINCT kind) AS b, max(list_extract([1, 3, 3, 5, 9, 0], kind)) AS c, bool_or(kind = 5) AS q, bool_or(kind = 4) AS r, bool_or(kind IN (2, 3)) AS m, bool_or(kind = 1) AS w, avg(far) AS d FROM mine GROUP BY 1)
SELECT {_ID}, CAST(len(string_split(c.Moves, ' ')) AS INTEGER) AS SolutionLength, CAST(split_part(c.FEN, ' ', 2) = 'w' AS INTEGER) AS IsWhiteToMove,
 CAST({_COUNT('A-Z')} AS INTEGER) AS white_pieces, CAST({_COUNT('a-z')} AS INTEGER) AS black_pieces, CAST({_BALANCE} AS INTEGER) AS material_balance,
 CAST(coalesce(x.a, 0) AS INTEGER) AS num_participating_pieces, CAST(coalesce(x.b, 0) AS INTEGER) AS num_piece_types, CAST(coalesce(x.c, 0) AS INTEGER) AS max_piece_value,
 CAST(coalesce(q, false) AS INTEGER) AS uses_queen, CAST(coalesce(r, false) AS INTEGER) AS uses_rook, CAST(coalesce(m, false) AS INTEGER) AS uses_minor, CAST(coalesce(w, false) AS INTEGER) AS uses_pawn,
 round(coalesce(x.d, 0), 9)::DOUBLE AS avg_move_dist, round(coalesce(y.d, 0), 9)::DOUBLE AS spatial_spread
 FROM cat c JOIN part ON p_partkey % {len(CATALOGUE)} = c.i LEFT JOIN part4 x ON x.i = c.i LEFT JOIN apart y ON y.i = c.i""")
def _(s, d):
    p = puzzles(s, d)
    return features.structure(p).withColumns({c: F.round(c, 9) for c in ("avg_move_dist", "spatial_spread")})


@query("positions", _BOARDS + f"""SELECT {_ID}, n, white, f, t, CAST(promo AS INTEGER) AS promo, coalesce(cap, false) AS cap,
 list_aggregate(list_transform(range(64), lambda s: CAST({board_sql._code("substr(board, s + 1, 1)")} AS VARCHAR)), 'string_agg', ' ') AS board FROM node x {_PART}""")
def _(s, d):
    return replay.nodes(puzzles(s, d), ["bd"]).select("PuzzleId", "n", "p.white", "p.f", "p.t", "p.promo", "p.cap", F.expr("array_join(b_bd, ' ') AS board"))


@query("attack_edges", _BOARDS + f"SELECT {_ID}, n, from_sq, CAST(to_sq AS INTEGER) AS to_sq, CAST(piece AS INTEGER) AS piece FROM edge x {_PART}")
def _(s, d):
    return replay.attack_edges(puzzles(s, d))


@query("legal_moves", _BOARDS + f"SELECT {_ID}, n, CAST(f AS INTEGER) AS from_sq, CAST(t AS INTEGER) AS to_sq, CAST(promo AS INTEGER) AS promo, cap AS is_capture, chk AS gives_check FROM legal x {_PART}")
def _(s, d):
    return replay.legal_moves(puzzles(s, d))


@query("node_features", _BOARDS + board_sql.features() + f"SELECT {_ID}, n, n % 2 = 1 AS is_player, {', '.join(features.FEATURE_NAMES)} FROM feature x {_PART}")
def _(s, d):
    return features.node_features(puzzles(s, d))


_ZEROS = " ".join(["0"] * len(features.FEATURE_NAMES))


@query("advanced_block", _BOARDS + board_sql.features() + f""", line AS (SELECT i, n, concat_ws(' ', {', '.join(features.FEATURE_NAMES)}) AS v FROM feature),
slot AS (SELECT i, string_agg(coalesce(v, '{_ZEROS}'), ' ' ORDER BY k) AS advanced FROM (
  SELECT c.i, k, v FROM cat c CROSS JOIN (SELECT unnest(range(10)) AS k) LEFT JOIN line l ON l.i = c.i AND l.n = CASE WHEN k < 5 THEN 2 * k + 1 ELSE 2 * (k - 5) END) GROUP BY 1)
SELECT {_ID}, CAST(540 AS INTEGER) AS width, advanced FROM slot x {_PART}""")
def _(s, d):
    return features.advanced(puzzles(s, d)).select("PuzzleId", F.size("advanced").alias("width"), F.array_join(F.transform("advanced", lambda x: x.cast("int").cast("string")), " ").alias("advanced"))


@query("theme_tags", _BOARDS + tag_sql.tags())
def _(s, d):
    return tags.tag(puzzles(s, d)).select("PuzzleId", "cp", "Themes")


@query("tag_quarantine", f"SELECT PuzzleId FROM {_PUZZLES_SQL} WHERE len(string_split(Moves, ' ')) < 2 OR Moves LIKE '%zz%'")
def _(s, d):
    return relational.quarantine(tags.tag(puzzles(s, d)))[1].select("PuzzleId")


def _moves(s, d):
    return scoring.with_policy(scoring.player_moves(replay.replay(puzzles(s, d), ["Moves"], scoring.FIELDS)), s)


_POLICY = _BOARDS + board_sql.vocabulary()


@query("policy_lookup", _POLICY + f"SELECT {_ID}, move_idx, uci, x.move, coalesce(policy_idx, -1) AS policy_idx FROM player x {_PART} LEFT JOIN policy ON policy.move = x.move")
def _(s, d):
    return _moves(s, d).select("PuzzleId", "move_idx", "uci", "move", "policy_idx")


def toy_scorer(frame):
    """Logits of a deterministic stand-in for a network."""
    return [np.cos(np.arange(1858) * (1 + e % 7) + m) for m, e in zip(frame["move_idx"], frame["elo"], strict=True)]


@query("score_moves", _POLICY + f""", logit AS (SELECT m, e, j, cos(j * (1 + e % 7) + m) AS z FROM (SELECT unnest(range(5)) AS m), (VALUES (1100), (1300), (1500), (1700), (1900)) v(e), (SELECT unnest(range(1858)) AS j)),
soft AS (SELECT m, e, j, exp(z) / sum(exp(z)) OVER (PARTITION BY m, e) AS p FROM logit),
best AS (SELECT m, e, string_agg(CAST(j AS VARCHAR), ' ' ORDER BY p DESC, j) AS top5_idx FROM (SELECT *, row_number() OVER (PARTITION BY m, e ORDER BY p DESC, j) AS r FROM soft) WHERE r <= 5 GROUP BY 1, 2)
SELECT {_ID}, move_idx, CAST(b.e AS INTEGER) AS elo, coalesce(policy_idx, -1) AS policy_idx, round(coalesce(soft.p, 0), 9) AS prob, top5_idx
FROM player x {_PART} LEFT JOIN policy ON policy.move = x.move JOIN best b ON b.m = x.move_idx LEFT JOIN soft ON soft.m = x.move_idx AND soft.e = b.e AND soft.j = policy_idx""")
def _(s, d):
    rows = _moves(s, d).select("PuzzleId", "move_idx", "policy_idx")
    out = scoring.score(rows, toy_scorer, ["PuzzleId", "move_idx", "policy_idx"])
    return out.select("PuzzleId", "move_idx", "elo", "policy_idx", F.round("prob", 9).alias("prob"), F.array_join(F.col("top5_idx").cast("array<string>"), " ").alias("top5_idx"))


_TURNED = "CASE WHEN white THEN s ELSE (7 - s // 8) * 8 + s % 8 END"


def _planes_sql(constants: str) -> str:
    return _POLICY + f""", man AS (SELECT p.i, p.move_idx, p.board, p.white, {_TURNED.replace("s //", "c.s //").replace("s %", "c.s %").replace("THEN s", "THEN c.s").replace("white", "p.white")} AS s, (c.kind - 1 + CASE WHEN c.light = p.white THEN 0 ELSE 6 END) * 64 AS plane
  FROM player p JOIN cell c ON c.i = p.i AND c.n = p.n),
cells8 AS (SELECT i, move_idx, r * 832 + plane + s AS place FROM man, (SELECT unnest(range(8)) AS r)),
flags AS (SELECT i, move_idx, white, rights, board FROM (SELECT p.i, p.move_idx, p.white, o.rights, p.board FROM player p JOIN pos o ON o.i = p.i AND o.n = p.n)),
const AS (SELECT i, move_idx, unnest({constants}) AS k FROM flags),
whole AS (SELECT i, move_idx, 6656 + k * 64 + s AS place FROM const JOIN sq ON k IS NOT NULL)
SELECT {_ID}, x.move_idx, string_agg(CAST(place AS VARCHAR), ' ' ORDER BY place) AS planes FROM (SELECT * FROM cells8 UNION ALL SELECT * FROM whole) x {_PART} GROUP BY 1, 2"""


_HAS = lambda r: f"({board_sql._HAS[r]})".replace("rights", "p.rights").replace("board", "p.board")
_RIGHT = lambda r: f"({board_sql._HAS[r]})"
_SIDES = ", ".join(f"CASE WHEN CASE WHEN white THEN {_RIGHT(a)} ELSE {_RIGHT(b)} END THEN {k} END" for k, (a, b) in enumerate(("Kk", "Qq", "kK", "qQ")))


@query("input_planes", _planes_sql(f"[{_SIDES}, CASE WHEN NOT white THEN 4 END, 7]"))
def _(s, d):
    return _moves(s, d).select("PuzzleId", "move_idx", F.expr(f"array_join({scoring.planes()}, ' ')").alias("planes"))


_FEN_PART = lambda k, default: f"coalesce(try_cast(split_part(FEN, ' ', {k}) AS INTEGER), {default})"
_FLIPPED_FLAGS = ", ".join(f"CASE WHEN CASE WHEN p.white THEN {_HAS(a)} ELSE {_HAS(b)} END THEN {106 + k} END" for k, (a, b) in enumerate(("Kk", "Qq", "kK", "qQ")))


@query("flipped_planes", _BOARDS + f""", clock AS (SELECT p.i, p.n, p.board, p.white, p.rights, {_FEN_PART(6, 1)} + (SELECT count(*) FROM pos q WHERE q.i = p.i AND q.n < p.n AND NOT q.white) AS number,
  coalesce(p.n - 1 - (SELECT max(m.n) FROM played m WHERE m.i = p.i AND m.n < p.n AND (m.cap OR abs(m.mover) = 1)), {_FEN_PART(5, 0)} + p.n) AS quiet FROM pos p JOIN cat USING (i) WHERE p.n < 5),
place AS (SELECT c.i, c.n, (c.kind - 1 + CASE WHEN c.light = p.white THEN 0 ELSE 6 END) * 64 + (7 - c.s // 8) * 8 + c.s % 8 AS place, 1.0::DOUBLE AS v FROM cell c JOIN clock p ON p.i = c.i AND p.n = c.n),
flag AS (SELECT i, n, unnest([CASE WHEN NOT p.white THEN 104 END, CASE WHEN number <> 0 THEN 105 END, {_FLIPPED_FLAGS}, CASE WHEN quiet <> 0 THEN 110 END, 111]) AS k, number, quiet FROM clock p),
both_ AS (SELECT * FROM place UNION ALL SELECT i, n, k * 64 + s, CASE k WHEN 105 THEN number / 100.0 WHEN 110 THEN quiet / 100.0 ELSE 1.0 END FROM flag, sq WHERE k IS NOT NULL)
SELECT {_ID}, CAST(x.n AS INTEGER) AS step, string_agg(place || ':' || CAST(CAST(round(v * 100) AS INTEGER) AS VARCHAR), ' ' ORDER BY place) AS planes FROM both_ x {_PART} GROUP BY 1, 2""")
def _(s, d):
    cells = scoring.sparse_planes(puzzles(s, d))
    return cells.select("PuzzleId", "step", F.expr("array_join(transform(cells, c -> concat(c.index, ':', cast(round(c.value * 100) as int))), ' ') AS planes"))


@query("embedding_sequence", _BOARDS + f""", step AS (SELECT p.i, p.n, (SELECT coalesce(sum(c.p), 0) FROM cell c WHERE c.i = p.i AND c.n = p.n) || ' ' || (SELECT count(*) FROM legal l WHERE l.i = p.i AND l.n = p.n) || ' ' || k.k AS v
  FROM pos p JOIN checker k ON k.i = p.i AND k.n = p.n)
SELECT {_ID}, flat FROM (SELECT c.i, string_agg(coalesce(v, '0 0 0'), ' ' ORDER BY k) AS flat FROM cat c CROSS JOIN (SELECT unnest(range(10)) AS k) LEFT JOIN step ON step.i = c.i AND step.n = k GROUP BY 1) x {_PART}""")
def _(s, d):
    steps = scoring.embedding_steps(replay.replay(puzzles(s, d), fields=("bd", "legal", "checkers")))
    e = steps.select("PuzzleId", "step", F.expr("cast(array(aggregate(p.bd, 0, (a, x) -> a + x), size(p.legal), bit_count(p.checkers)) as array<double>) AS embedding"))
    return scoring.padded_steps(e, "PuzzleId", 3).select("PuzzleId", F.array_join(F.col("flat").cast("array<int>").cast("array<string>"), " ").alias("flat"))


# --- models ---------------------------------------------------------------------------------------


def matrix(s, d) -> DataFrame:
    """pid, y, split, fold, weight and three blocks, of the embeddings."""
    e = table(s, d, "embeddings").select(F.col("vec_id").alias("pid"), F.col("embedding").cast("array<double>").alias("v"), F.col("label").cast("double").alias("y"))
    base = sampling.folds(sampling.split(e.select("pid", "y", sampling.weight(F.col("pid") % 90).alias("weight")), "pid"), "pid")
    return models.assemble(base, {n: e.select("pid", F.slice("v", a, 8)) for n, a in (("struct", 1), ("themes", 9), ("moves", 17))})


BLOCKS = ["struct", "themes", "moves"]


def small():
    return models.boosted(maxIter=3, maxDepth=3)


@query("block_assembly", "SELECT vec_id AS pid, CAST(24 AS INTEGER) AS width, round(list_sum(list_transform(embedding[1:24], lambda x: CAST(x AS DOUBLE))), 5) AS total FROM embeddings")
def _(s, d):
    m = matrix(s, d)
    joined = F.concat(*BLOCKS)
    return m.select("pid", F.size(joined).alias("width"), F.round(arrays.total(joined), 5).alias("total"))


@query("train_boosted")
def _(s, d):
    m = matrix(s, d)
    return models.predict(models.train(m, BLOCKS, small()), m, BLOCKS)


@query("train_forest")
def _(s, d):
    m = matrix(s, d)
    return models.predict(models.train(m, BLOCKS, models.forest(numTrees=5, maxDepth=4)), m, BLOCKS)


@query("cross_validation")
def _(s, d):
    return metrics.fold_summary(models.cross_validate(matrix(s, d), BLOCKS, {"boosted": small}, k=5))


@query("parameter_search")
def _(s, d):
    return models.search(matrix(s, d), BLOCKS, {"maxIter": [2, 3], "maxDepth": [2, 3]}, 2)[1]


@query("ablation")
def _(s, d):
    return models.ablate(matrix(s, d), BLOCKS, learner=small)


@query("specialists")
def _(s, d):
    return models.specialists(matrix(s, d), ["struct"], {"one": ["themes"], "two": ["moves"]}, small)


@query("stacking")
def _(s, d):
    m = matrix(s, d)
    return models.stack(models.specialists(m, ["struct"], {"one": ["themes"], "two": ["moves"]}, small), m, ["struct"], ["one", "two"], learner=small)


# The same plans with the baseline learner, whose numbers SQL can tell.
_SPLIT = f"CASE WHEN {_BUCKET('vec_id', 42, 1000000)} < 100000 THEN 'test' WHEN {_BUCKET('vec_id', 43, 1000000)} < 111111 THEN 'val' ELSE 'train' END"
_SUM = lambda a: f"list_sum(list_transform(embedding[{a} : {a + 7}], lambda x: CAST(x AS DOUBLE)))"
_MATRIX = f"WITH m AS (SELECT vec_id AS pid, CAST(label AS DOUBLE) AS y, {_SPLIT} AS split, CAST({_BUCKET('vec_id', 42, 5)} AS INTEGER) AS fold, {_SUM(1)} AS struct, {_SUM(9)} AS themes, {_SUM(17)} AS moves FROM embeddings)"
_FIT = "regr_slope(y, x) AS slope, avg(y) AS my, avg(x) AS mx"


@query("train_line", _MATRIX + f""", r AS (SELECT *, (struct + themes + moves) / 24 AS x FROM m), fit AS (SELECT {_FIT} FROM r WHERE split = 'train')
SELECT pid, split, fold, y, 'model' AS model, round(my + slope * (x - mx), 6) AS yhat FROM r, fit""")
def _(s, d):
    m = matrix(s, d)
    return models.predict(models.train(m, BLOCKS, models.Line()), m, BLOCKS).withColumn("yhat", F.round("yhat", 6))


@query("cross_validation_line", _MATRIX + f""", r AS (SELECT *, (struct + themes + moves) / 24 AS x FROM m), k AS (SELECT unnest(range(5))::INTEGER AS f),
fit AS (SELECT f, {_FIT} FROM k JOIN r ON r.fold <> f GROUP BY 1), e AS (SELECT k.f, r.fold = k.f AS held, pow(y - (my + slope * (x - mx)), 2) AS e FROM k JOIN fit ON fit.f = k.f CROSS JOIN r)
SELECT 'line' AS model, f AS fold, round(avg(e) FILTER (NOT held), 6) AS train_mse, round(sqrt(avg(e) FILTER (NOT held)), 6) AS train_rmse, round(avg(e) FILTER (held), 6) AS val_mse, round(sqrt(avg(e) FILTER (held)), 6) AS val_rmse FROM e GROUP BY 1, 2""")
def _(s, d):
    out = models.cross_validate(matrix(s, d), BLOCKS, {"line": models.Line}, k=5)
    return out.select("model", "fold", *[F.round(c, 6).alias(c) for c in ("train_mse", "train_rmse", "val_mse", "val_rmse")])


@query("search_line", _MATRIX + f""", r AS (SELECT *, (struct + themes + moves) / 24 AS x FROM m), fit AS (SELECT {_FIT} FROM r WHERE split = 'train')
SELECT CAST(t AS INTEGER) AS trial, round(avg(pow(y - (my + s * slope * (x - mx)), 2)), 6) AS val_mse FROM r, fit, (VALUES (0, 1.0), (1, 0.5)) v(t, s) WHERE split = 'val' GROUP BY 1""")
def _(s, d):
    return models.search(matrix(s, d), BLOCKS, {"shrink": [0.5]}, 2, learner=models.Line)[1].select("trial", F.round("val_mse", 6).alias("val_mse"))


@query("ablation_line", _MATRIX + f""", r AS (SELECT b AS blocks, y, split, list_extract([struct + themes + moves, themes + moves, struct + moves, struct + themes], k) / w AS x
  FROM m, (VALUES (1, 24, 'struct+themes+moves'), (2, 16, 'themes+moves'), (3, 16, 'struct+moves'), (4, 16, 'struct+themes')) v(k, w, b)),
fit AS (SELECT blocks, {_FIT} FROM r WHERE split = 'train' GROUP BY 1)
SELECT blocks, round(avg(pow(y - (my + slope * (x - mx)), 2)), 6) AS mse, round(sqrt(avg(pow(y - (my + slope * (x - mx)), 2))), 6) AS rmse FROM r JOIN fit USING (blocks) WHERE split = 'val' GROUP BY 1""")
def _(s, d):
    return models.ablate(matrix(s, d), BLOCKS, learner=models.Line).select("blocks", F.round("mse", 6).alias("mse"), F.round("rmse", 6).alias("rmse"))


_SPECIAL = _MATRIX + f""", r AS (SELECT pid, y, split, fold, g AS model, (struct + CASE g WHEN 'one' THEN themes ELSE moves END) / 16 AS x FROM m, (VALUES ('one'), ('two')) v(g)),
fit AS (SELECT model, {_FIT} FROM r WHERE split = 'train' GROUP BY 1), p AS (SELECT pid, split, fold, y, model, my + slope * (x - mx) AS yhat FROM r JOIN fit USING (model))"""


@query("specialists_line", _SPECIAL + " SELECT pid, split, fold, y, model, round(yhat, 6) AS yhat FROM p")
def _(s, d):
    return models.specialists(matrix(s, d), ["struct"], {"one": ["themes"], "two": ["moves"]}, models.Line).withColumn("yhat", F.round("yhat", 6))


@query("stacking_line", _SPECIAL + f""", s AS (SELECT pid, sum(yhat) + avg(yhat) + stddev_pop(yhat) + min(yhat) + max(yhat) AS stack FROM p GROUP BY 1), q AS (SELECT m.pid, y, split, fold, (struct + stack) / 14 AS x FROM m JOIN s USING (pid)),
fit2 AS (SELECT {_FIT} FROM q WHERE split = 'train') SELECT pid, split, fold, y, 'stacked' AS model, round(my + slope * (x - mx), 6) AS yhat FROM q, fit2""")
def _(s, d):
    m = matrix(s, d)
    parts = models.specialists(m, ["struct"], {"one": ["themes"], "two": ["moves"]}, models.Line)
    return models.stack(parts, m, ["struct"], ["one", "two"], learner=models.Line).withColumn("yhat", F.round("yhat", 6))


@query("gain_importances")
def _(s, d):
    return metrics.top_features(models.importances(models.train(matrix(s, d), BLOCKS, small())), 15)


@query("raw_gains")
def _(s, d):
    """Gains that are not normalised, from the table of the saved model's nodes."""
    return models.raw_gains(models.train(matrix(s, d), BLOCKS, small()))


_STRUCT = " + ".join(f"b.{c}" for c in features.STRUCT_NAMES)


@query("feature_matrix", f"""SELECT p.PuzzleId AS pid, CAST(p.cp + 1500 AS DOUBLE) AS y, round(1.0 / greatest(abs(p.cp) % 100, 1), 6)::DOUBLE AS weight, CAST(14 AS INTEGER) AS struct, CAST(540 AS INTEGER) AS advanced,
 round({_STRUCT} + list_sum(list_transform(string_split(a.advanced, ' '), lambda x: CAST(x AS DOUBLE))) + len(list_distinct(list_filter(string_split(t.Themes, ' '), lambda x: x <> ''))), 4)::DOUBLE AS total
FROM {_PUZZLES_SQL} p JOIN ({ORACLES["board_features"]}) b ON b.PuzzleId = p.PuzzleId JOIN ({ORACLES["advanced_block"]}) a ON a.PuzzleId = p.PuzzleId JOIN ({ORACLES["theme_tags"]}) t ON t.PuzzleId = p.PuzzleId
WHERE abs(p.cp) % 100 <= 90""")
def _(s, d):
    """All blocks that puzzles alone give, by the one entry point."""
    p = puzzles(s, d).withColumns({"Rating": F.col("cp") + 1500, "RatingDeviation": F.abs("cp") % 100})
    # written, as its vocabulary is looked at before its rows
    themes = models.written(tags.tag(p.drop("Rating", "RatingDeviation")).select("PuzzleId", "Themes"))
    m = build.build_matrix(p, ["struct", "advanced", "themes"], themes=themes)
    return m.select("pid", "y", F.round("weight", 6).alias("weight"), F.size("struct").alias("struct"), F.size("advanced").alias("advanced"), F.round(arrays.total(F.concat("struct", "advanced", "themes")), 4).alias("total"))


@query("incremental_scoring", f"SELECT PuzzleId AS pid, 'maia1' AS source, elo, move_idx, policy_idx, prob FROM ({ORACLES['score_moves']})")
def _(s, d):
    """Half of the puzzles are done; only the others are scored."""
    p = puzzles(s, d).drop("cp")
    done = models.written(build.score_unfinished(p.filter("PuzzleId % 2 = 0"), toy_scorer, "maia1", fields=()))
    return build.score_unfinished(p, toy_scorer, "maia1", done, fields=()).select("pid", "source", "elo", "move_idx", "policy_idx", F.round("prob", 9).alias("prob"))
