"""A plain board against public move counts; native replay and masks against the plain board and the hand-checked catalogue."""

import random

import pytest
from plain_board import Position, name_of, replay_one, square_of

from tactica.operators import features, replay, tags
from tactica.plans.registry import CATALOGUE

START = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1"
TRICKY = "r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq -"


def perft(p, depth):
    legal = p.legal_moves()
    return len(legal) if depth == 1 else sum(perft(p.after(a, b, q), depth - 1) for a, b, q, _ in legal)


@pytest.mark.parametrize(("fen", "counts"), [(START, (20, 400, 8902)), (TRICKY, (48, 2039)), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", (14, 191, 2812))])
def test_move_counts(fen, counts):
    p = Position.from_fen(fen)
    assert tuple(perft(p, d + 1) for d in range(len(counts))) == counts


def random_games(n=6, plies=40, seed=3):
    rng = random.Random(seed)
    for _ in range(n):
        p = Position.from_fen(START)
        for _ in range(plies):
            legal = p.legal_moves()
            if not legal:
                break
            a, b, q, _ = rng.choice(legal)
            yield p, (a, b, q)
            p = p.after(a, b, q)


def test_attacks_and_attackers_agree():
    """Two ways to the same edges: forward lines of every piece, and lines back from every square."""
    for p, _ in random_games():
        forward = {(s, t) for s in range(64) if p.board[s] for t in p.attacks(s)}
        back = {(s, t) for t in range(64) for side in (1, -1) for s in p.attackers(t, side)}
        assert forward == back


def test_described_squares_agree_with_the_single_rules():
    from plain_board import KING, bits, describe

    for p, move in random_games(3, 40, 11):
        d = describe(p, move)
        pieces = [s for s in range(64) if p.board[s]]
        assert d["hang"] == bits(s for s in pieces if p.hanging(s))
        assert d["bad"] == bits(s for s in pieces if abs(p.board[s]) != KING and p.bad_spot(s))


def test_material_only_changes_by_capture_and_promotion():
    for p, (a, b, q) in random_games():
        lost = sum(x != 0 for x in p.board) - sum(x != 0 for x in p.after(a, b, q).board)
        assert lost == int(p.is_capture(a, b))


def test_mirror_has_the_same_number_of_moves():
    for p, _ in random_games(2, 30):
        turned = Position([-p.board[s ^ 56] for s in range(64)], -p.turn, frozenset(r.swapcase() for r in p.rights), None if p.ep is None else p.ep ^ 56)
        assert len(turned.legal_moves()) == len(p.legal_moves())


@pytest.mark.parametrize(("name", "counts"), [
    ("F01", [28, 43, 0]), ("F02", [8, 20, 0]), ("F03", [11, 11, 0]), ("F04", [6, 7, None]), ("F05", [7, 15, None]), ("F06", [5, 7, None]),
    ("F08", [4, 13, 7, 13, None]), ("F10", [17, 13, 22, 11, None]), ("F11", [19, 13, 5, 11, None]), ("F12", [15, 13, None]), ("F14", [4, 16, 22, None])])
def test_catalogue_legal_moves(name, counts):
    fen, moves = next((f, m) for n, f, m in CATALOGUE if n == name)
    got = [len(p["legal"]) for p in replay_one(fen, moves)[0]]
    assert [g for g, c in zip(got, counts, strict=True) if c is not None] == [c for c in counts if c is not None]


def plain(v):
    if isinstance(v, list) and v and not isinstance(v[0], (int, bool)):
        return sorted(tuple(sorted((x if isinstance(x, dict) else x.asDict()).items())) for x in v)
    return v


def same_positions(spark, rows):
    df = spark.createDataFrame(rows, "PuzzleId string, FEN string, Moves string")
    got = {r.PuzzleId: r for r in replay.replay(df).collect()}
    shared = [f for f in replay.FIELDS if not f.startswith("hits_")]
    for name, fen, moves in rows:
        want, error = replay_one(fen or "", moves or "")
        assert (error is None) == (got[name].error is None) and len(want) == len(got[name].pos), name
        for n, (w, p) in enumerate(zip(want, got[name].pos, strict=True)):
            assert {f: plain(w[f]) for f in shared} == {f: plain(p[f]) for f in shared}, (name, n)
            for light, digits in ((1, p.hits_w), (-1, p.hits_b)):
                for s in range(64):
                    count = sum((digits[f"d{k}"] >> s & 1) << k for k in range(5))
                    assert count == sum(w["bd"][x] * light > 0 for x in range(64) if w["by"][s] >> x & 1)


def test_native_positions_equal_the_plain_board(spark):
    """Every value that features and themes see, on the catalogue, on odd positions and on random play."""
    odd = [
        ("no kings", "8/p6P/8/3q4/8/8/8/R6r w - - 0 1", "a1a7 h1h7"), ("one king", "4k3/8/8/8/8/8/4P3/8 w - - 0 1", "e2e4 e8e7"),
        ("castling through", "r3k2r/8/8/8/4Q3/8/8/R3K2R b KQkq - 0 1", "e8c8 e1g1"), ("rook takes rook", "r3k2r/8/8/8/8/8/8/R3K2R w KQkq - 0 1", "a1a8 e8e7 e1h1"),
        ("ep pinned on its rank", "8/8/8/K2pP2r/8/8/8/4k3 w - d6 0 1", "a5a4"), ("ep pinned on a diagonal", "8/8/8/3pP3/8/2K5/8/4k2b w - d6 0 1", ""), ("ep takes the checker", "8/8/8/2k5/3Pp3/8/8/4K3 b - d3 0 1", "e4d3"),
        ("ep opens a check", "8/8/8/k2pP2R/8/8/8/4K3 w - d6 0 1", "e5d6"), ("promotion behind the king", "8/4P3/8/8/4k3/8/8/4K3 w - - 0 1", "e7e8q"), ("promotion takes on a diagonal", "3n4/4P3/8/6k1/8/8/8/4K3 w - - 0 1", "e7d8q"),
        ("double check", "4k3/8/8/8/4N3/8/8/K3R3 w - - 0 1", "e4f6"), ("many queens", "QQQQQQQ1/8/8/8/8/8/kq6/7K b - - 0 1", "b2b1"), ("all corners", "r6r/8/8/8/8/8/8/R6R w KQkq - 0 1", "h1h8"),
        ("the other's piece moves", "4k3/8/8/8/8/8/4p3/4K3 w - - 0 1", "e2e3 e1e2"), ("castling is a check", "5k2/8/8/8/8/8/8/4K2R w K - 0 1", "e1g1"), ("bad fen", "8/8 w", "a1a2"), ("bad side", "8/8/8/8/8/8/8/K6k x - - 0 1", ""),
        ("bad square", "8/8/8/8/8/8/8/K6k w - z9 0 1", ""), ("bad move", START, "e2e4 e7e5 zz"), ("empty square", START, "e4e5"), ("nulls", None, None), ("short fen", "8/8/8/8/8/8/8/K6k w", " a1b1  h1g1 "),
    ]
    games = [(f"g{i}", p.fen(), name_of(a) + name_of(b) + ("pnbrqk"[q - 1] if q else "")) for i, (p, (a, b, q)) in enumerate(random_games(4, 60, 21))]
    same_positions(spark, [*CATALOGUE, *odd, *games])


@pytest.mark.parametrize(("fen", "counts"), [(START, (20, 400, 8902)), (TRICKY, (48, 2039)), ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", (14, 191, 2812))])
def test_native_move_counts(spark, fen, counts):
    """The public counts, each level by legal moves of the boards that the last level's moves lead to."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("0", fen, "")], "PuzzleId string, FEN string, Moves string")
    name = lambda s: F.concat(F.chr(97 + F.col(s) % 8), (F.expr(f"{s} div 8") + 1).cast("string"))
    for k, count in enumerate(counts):
        moves = replay.legal_moves(df).filter(f"n = {k}")
        if k == len(counts) - 1:
            assert moves.count() == count
            break
        uci = F.concat(name("from_sq"), name("to_sq"), F.expr("if(promo = 0, '', substr('pnbrqk', promo, 1))"))
        df = df.withColumnRenamed("PuzzleId", "was").join(moves.select(F.col("PuzzleId").alias("was"), uci.alias("uci")), "was")
        df = df.select(F.concat_ws("-", "was", "uci").alias("PuzzleId"), "FEN", F.trim(F.concat_ws(" ", "Moves", "uci")).alias("Moves"))
        df = spark.createDataFrame(df.collect(), df.schema)
        assert df.count() == count


def test_boards_need_no_python(spark, catalogue):
    for df in (replay.attack_edges(catalogue), replay.legal_moves(catalogue), features.node_features(catalogue), features.advanced(catalogue), features.structure(catalogue), tags.tag(catalogue)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_masks_come_from_look_ups_and_rules_need_no_list_of_moves(catalogue):
    for df in (tags.tag(catalogue), features.advanced(catalogue)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "conv(" not in plan and "translate(reverse" not in plan and "gives" not in plan
        assert "transform(array(named_struct(" not in plan  # an element of an array of one asks for all nested types each time
    assert "chk, " not in tags.tag(catalogue)._jdf.queryExecution().optimizedPlan().toString()


def test_unreadable_input_is_an_error_not_a_crash():
    for fen in ("", "8/8 w", "8/8/8/8/8/8/8/9 w", "what"):
        rows, error = replay_one(fen, "e2e4")
        assert rows == [] and error
    rows, error = replay_one("4k3/8/8/8/8/8/8/4K3 w - - 0 1", "e1e2 zz99")
    assert len(rows) == 2 and error
    assert replay_one(START, "e4e5")[1] and replay_one(START, "")[1] is None


@pytest.fixture(scope="module")
def catalogue(spark):
    rows = [(n, f, m, 300) for n, f, m in CATALOGUE] + [("N1", None, None, 0), ("N2", START, None, None)]
    return spark.createDataFrame(rows, "PuzzleId string, FEN string, Moves string, cp int")


CONTAINS = {
    "F01": "mate mateIn1 attackingF2F7 oneMove", "F02": "mate mateIn1 backRankMate rookEndgame oneMove", "F03": "mate mateIn1 smotheredMate oneMove",
    "F04": "enPassant pawnEndgame oneMove", "F05": "castling rookEndgame oneMove", "F06": "promotion advancedPawn oneMove",
    "F07": "promotion underPromotion advancedPawn oneMove", "F08": "short", "F10": "short", "F11": "fork short", "F12": "promotion underPromotion advancedPawn oneMove", "F14": "long",
}
WITHOUT = {"F01": "smotheredMate", "F02": "kingsideAttack", "F03": "backRankMate", "F04": "promotion", "F05": "mate", "F06": "underPromotion pawnEndgame queenEndgame",
           "F07": "mate", "F08": "mate oneMove", "F10": "fork", "F11": "mate kingsideAttack", "F12": "mate", "F14": "oneMove short"}

#: Short lines made for one rule each: (FEN, moves, tags contained).
RULES = [
    ("6k1/5ppp/8/8/8/8/q4PPP/3R2K1 b - - 0 1", "a2a1 d1a1", "hangingPiece"),
    ("4k3/8/8/q7/8/8/8/R3K3 b - - 0 1", "e8e7 a1a5", "hangingPiece"),
]


def test_tags_of_the_catalogue(catalogue):
    found = {r.PuzzleId: (r.cp, r.Themes.split()) for r in tags.tag(catalogue).collect()}
    for name, words in CONTAINS.items():
        assert set(words.split()) <= set(found[name][1]), name
        assert not set(WITHOUT[name].split()) & set(found[name][1]), name
    for name in ("F13", "F15", "N1", "N2"):
        assert found[name] == (None, [])


def test_quarantine_replays_each_line_once_and_looks_at_no_rule(catalogue):
    from tactica.operators import relational

    bad = relational.quarantine(tags.tag(catalogue))[1].select("PuzzleId")
    plan = bad._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("not a move") == 1 and "getbit" not in plan
    assert {r.PuzzleId for r in bad.collect()} == {"F13", "F15", "N1", "N2"}


@pytest.mark.parametrize(("fen", "moves", "words"), RULES)
def test_single_rules(spark, fen, moves, words):
    df = spark.createDataFrame([("x", fen, moves, 0)], "PuzzleId string, FEN string, Moves string, cp int")
    assert set(words.split()) <= set(tags.tag(df).first().Themes.split())


def test_feature_spot_checks(spark, catalogue):
    nodes = {(r.PuzzleId, r.n): r for r in features.node_features(catalogue).collect()}
    assert nodes["F01", 0].num_legal_moves == 28 and nodes["F01", 1].num_legal_moves == 43
    assert (nodes["F01", 1].move_is_check, nodes["F01", 1].material_gain, nodes["F01", 1].captures_undefended) == (1, 1, 0)
    assert (nodes["F14", 1].material_gain, nodes["F14", 1].captures_undefended, nodes["F14", 2].recapture, nodes["F14", 2].accepted_sacrifice) == (5, 0, 1, 0)
    assert (nodes["F04", 1].material_gain, nodes["F04", 1].captures_undefended, nodes["F04", 1].has_en_passant) == (1, 0, 1)
    rows = {r.PuzzleId: r for r in features.structure(catalogue).collect()}
    f11 = rows["F11"]
    assert (f11.white_pieces, f11.black_pieces, f11.material_balance, f11.num_participating_pieces, f11.num_piece_types) == (2, 3, -7, 2, 1)
    assert (f11.max_piece_value, f11.uses_minor, f11.avg_move_dist, f11.spatial_spread) == (3, 1, 2.0, 2.0)
    wide = {r.PuzzleId: r.advanced for r in features.advanced(catalogue).collect()}
    names = features.ADVANCED_NAMES
    assert len(names) == 540 and {len(v) for v in wide.values()} == {540}
    assert wide["F01"][names.index("o0_num_legal_moves")] == 28 and wide["F01"][names.index("p0_num_legal_moves")] == 43
    assert wide["F01"][names.index("p1_num_legal_moves")] == 0
    for (pid, n), r in nodes.items():  # the wide block holds the long form, of the first ten half-moves
        if n >= features.MAX_HALF_MOVES:
            continue
        slot = f"{'p' if n % 2 else 'o'}{n // 2}_"
        for k in features.FEATURE_NAMES:
            assert wide[pid][names.index(slot + k)] == r[k]


def test_isolated_pawn_quirk(spark):
    df = spark.createDataFrame([("x", "4k3/8/8/8/8/8/P2P4/4K3 w - - 0 1", "e1e2")], "PuzzleId string, FEN string, Moves string")
    at = features.ADVANCED_NAMES.index("o0_isolated_pawns")
    assert features.advanced(df).first().advanced[at] == 1
    assert features.advanced(df, a_file_quirk=False).first().advanced[at] == 2


def test_edges_and_moves_in_long_form(spark, catalogue):
    edges = {(r.PuzzleId, r.n, r.from_sq, r.to_sq) for r in replay.attack_edges(catalogue).collect()}
    assert ("F02", 1, square_of("d1"), square_of("d8")) in edges and ("F02", 1, square_of("d1"), square_of("h1")) not in edges
    assert replay.legal_moves(catalogue).filter("PuzzleId = 'F01' AND n = 1").count() == 43


def test_squares_between():
    import duckdb

    from tactica.operators.sqltext import between

    def plain(x, a, b):
        for df, dr in [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]:
            f, r, met = a % 8 + df, a // 8 + dr, []
            while 0 <= f < 8 and 0 <= r < 8 and r * 8 + f != b:
                met.append(r * 8 + f)
                f, r = f + df, r + dr
            if 0 <= f < 8 and 0 <= r < 8 and x in met:
                return True
        return False

    sql = between("x", "a", "b").replace(" div ", " // ").replace("greatest", "greatest")
    got = duckdb.sql(f"SELECT x, a, b, {sql} FROM (SELECT x::INT x, a::INT a, b::INT b FROM range(64) s(x), range(64) t(a), range(64) u(b) WHERE (x * 7 + a * 3 + b) % 11 = 0)").fetchall()
    assert all(bool(v) == plain(x, a, b) for x, a, b, v in got if a != b)


def test_made_positions_have_their_theme(spark):
    """Every position that is named after a theme has it; together the catalogue shows all themes but few."""
    df = spark.createDataFrame([(n, f, m, 0) for n, f, m in CATALOGUE], "PuzzleId string, FEN string, Moves string, cp int")
    got = {r.PuzzleId: set(r.Themes.split()) for r in tags.tag(df).collect()}
    named = [n for n in got if n[0].islower()]
    assert len(named) == 12 and all(n in got[n] for n in named)
    assert len(set().union(*got.values())) >= 50


def test_flipped_planes_as_sparse_vectors(spark):
    """White king on e1 and pawn on a2, Black's king on e8; after the pawn's move and the king's."""
    from tactica.operators import scoring

    df = spark.createDataFrame([("x", "4k3/8/8/8/8/8/P7/4K3 w - - 7 40", "a2a3 e8e7")], "PuzzleId string, FEN string, Moves string")
    first, second, third = (r.planes for r in scoring.board_tensors(df).orderBy("step").collect())
    assert first.size == 7168 and [first[0 * 64 + 48], first[5 * 64 + 60], first[11 * 64 + 4]] == [1, 1, 1]
    assert [first[k * 64] for k in (104, 105, 110, 111)] == [0, 0.4, 0.07, 1]
    assert [second[k * 64 + 63] for k in (104, 105, 110, 111)] == [1, 0.4, 0, 1] and second[6 * 64 + 40] == 1 and second[5 * 64 + 4] == 1
    assert [third[k * 64] for k in (104, 105, 110, 111)] == [0, 0.41, 0.01, 1] and third[11 * 64 + 12] == 1
