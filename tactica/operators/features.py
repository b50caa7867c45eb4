"""Board features (R2-R4, R7-R17): expressions over puzzles, their replayed boards and the boards' masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sqltext as q
from .bitboards import GIVEN, PIECES, columns, inside, tables
from .replay import games

SLOTS, MAX_HALF_MOVES = 5, 10
STRUCT_NAMES = ["SolutionLength", "IsWhiteToMove", "white_pieces", "black_pieces", "material_balance",
                "num_participating_pieces", "num_piece_types", "max_piece_value", "uses_queen", "uses_rook",
                "uses_minor", "uses_pawn", "avg_move_dist", "spatial_spread"]


def basic_columns() -> dict[str, Column]:
    placement = F.element_at(F.split("FEN", " "), 1)
    letters = lambda p: F.length(F.regexp_replace(placement, f"[^{p}]", ""))
    balance = sum((letters(c) * v - letters(c.lower()) * v for c, v in zip("PNBRQ", (1, 3, 3, 5, 9), strict=True)), F.lit(0))
    words = F.trim(F.regexp_replace("Moves", "\\s+", " "))
    return {"SolutionLength": F.when(words == "", 0).otherwise(F.size(F.split(words, " "))), "IsWhiteToMove": (F.element_at(F.split("FEN", " "), 2) == "w").cast("int"),
            "white_pieces": letters("A-Z"), "black_pieces": letters("a-z"), "material_balance": balance}


def basic(puzzles: DataFrame) -> DataFrame:
    """PuzzleId and R2, R3: from the strings alone, no helper."""
    return puzzles.select(F.col("PuzzleId").cast("string").alias("PuzzleId"), *[c.alias(n) for n, c in basic_columns().items()])


def participation(puzzles: DataFrame, keep: list[str] = ()) -> DataFrame:
    """PuzzleId and R4: nine statistics of the player's moves up to the first that is malformed; and the columns ``keep``."""
    mine = "filter(raw, (p, n) -> n % 2 = 1 AND p.t IS NOT NULL)"
    x, y, i = q.fresh("x"), q.fresh("y"), q.fresh("i")
    pairs = f"flatten(transform(src, ({x}, {i}) -> transform(slice(src, {i} + 2, size(src)), {y} -> {q.distance(x, y)})))"
    mean = lambda a: f"if(size({a}) > 0, aggregate({a}, 0D, (s, v) -> s + v) / size({a}), 0D)"
    kinds = "array_distinct(transform(mine, p -> locate(upper(substr(p.board, p.f + 1, 1)), 'PNBRQK')))"
    rows = games(puzzles, keep).selectExpr("PuzzleId", *keep, f"{mine} AS mine").selectExpr("PuzzleId", *keep, "transform(mine, p -> p.f) AS src", f"{kinds} AS kinds", f"transform(mine, p -> {q.distance('p.f', 'p.t')}) AS far")
    rows = rows.withColumn("apart", F.expr(pairs))
    has = lambda *k: " OR ".join(f"array_contains(kinds, {x})" for x in k)
    return rows.selectExpr(
        "PuzzleId", *keep, "size(array_distinct(src)) AS num_participating_pieces", "size(kinds) AS num_piece_types",
        f"coalesce(array_max(transform(kinds, k -> {q.value('k')})), 0) AS max_piece_value",
        f"cast({has(5)} AS int) AS uses_queen", f"cast({has(4)} AS int) AS uses_rook", f"cast({has(2, 3)} AS int) AS uses_minor", f"cast({has(1)} AS int) AS uses_pawn",
        f"{mean('far')} AS avg_move_dist", f"{mean('apart')} AS spatial_spread")


def structure(puzzles: DataFrame) -> DataFrame:
    """The 14 columns of the struct block; a FEN that cannot be read has zero participation. No join: all of it
    comes from one row, and of the replay only boards and moves."""
    rows = participation(puzzles.withColumns(basic_columns()), STRUCT_NAMES[:5])
    return rows.select("PuzzleId", *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in STRUCT_NAMES])


FILE_A, FILE_H, FIRST_RANK = 72340172838076673, -9187201950435737472, 255


def _pawns(pawns: str, enemy: str, light: str, a_file_quirk: bool) -> dict[str, str]:
    """Islands, doubled, isolated and passed pawns of one side by population counts.

    Files are a byte, the board folded onto its first rank.
    """

    def let(value: str, body: str) -> str:
        return q.bind(value, "x", body)

    def smear(mask: str, *shifts: int) -> str:
        for k in shifts:
            mask = let(mask, f"x | shiftleft(x, {k})" if k > 0 else f"x | shiftrightunsigned(x, {-k})")
        return mask

    files = f"({smear(pawns, -32, -16, -8)} & {FIRST_RANK}L)"
    lonely = let(files, "x & ~shiftleft(x, 1) & ~shiftrightunsigned(x, 1)" + (" & 254L" if a_file_quirk else ""))
    # squares that an enemy pawn ahead on the same or a neighbouring file watches over
    wide = let(enemy, f"x | shiftrightunsigned(x & ~{FILE_A}L, 1) | shiftleft(x & ~({FILE_H}L), 1)")
    under, over = smear(f"shiftrightunsigned({wide}, 8)", -8, -16, -32), smear(f"shiftleft({wide}, 8)", 8, 16, 32)
    return {
        "pawn_islands": let(files, "bit_count(x & ~shiftleft(x, 1))"),
        "doubled_pawns": f"bit_count({pawns}) - bit_count({files})",
        "isolated_pawns": f"bit_count({pawns} & {smear(lonely, 8, 16, 32)})",
        "passed_pawns": f"bit_count({pawns} & ~if({light}, {under}, {over}))",
    }


def _more(a: str, b: str) -> str:
    """Squares where the count ``a`` is higher than ``b``; both as binary digits, one mask each."""
    out = "0L"
    for k in range(5):
        out = f"(({a}.d{k} & ~{b}.d{k}) | (~({a}.d{k} ^ {b}.d{k}) & {out}))"
    return out


def move_features(p, after, before, a_file_quirk: bool = True) -> dict[str, str]:
    """The 54 features of a node as SQL; ``p`` names the values of its position, ``after`` of the next and
    ``before`` of the last: functions from a name to SQL.

    Counts of moves and of men are population counts of masks. An isolated pawn on the a-file is not counted
    unless ``a_file_quirk`` is off.
    """
    light = p("white")
    own, opp = f"if({light}, {p('W')}, {p('X')})", f"if({light}, {p('X')}, {p('W')})"
    ours, theirs = f"if({light}, {p('hits_w')}, {p('hits_b')})", f"if({light}, {p('hits_b')}, {p('hits_w')})"
    men = f"~{p('K')}"
    code = lambda letter: f"get(array(0, 1, 2, 3, 4, 5, 6, -1, -2, -3, -4, -5, -6), locate({letter}, '{PIECES}') - 1)"
    letter = lambda board, square: f"substr({board}, {square} + 1, 1)"
    taken, mover = code(p("taken")), code(letter(p("board"), p("f")))
    worth = lambda mask: " + ".join(f"bit_count({p(k)} & {mask}) * {v}" for k, v in (("P", 1), ("N", 3), ("B", 3), ("R", 5), ("Q", 9)))
    yes = lambda test: f"cast(coalesce({test}, false) AS int)"
    # over the pieces that can move; a promotion's target stands for four moves, castling for one of the king
    each = lambda what, start="0": f"aggregate({p('able')}, {start}, (a, m) -> a + {what})"
    moves = lambda mask: f"(bit_count({mask}) + 3 * bit_count({mask} & m.promo))"
    castles, castle_checks = f"size({p('castles')})", f"size(filter({p('castles')}, c -> c.chk))"
    checks = "(bit_count(m.chk) + coalesce(aggregate(m.new, 0, (b, w) -> b + bit_count(w.chk & m.promo)), 0))"
    dearer = f"get(array(0L, {p('N')} | {p('B')} | {p('R')} | {p('Q')}, {p('R')} | {p('Q')}, {p('R')} | {p('Q')}, {p('Q')}, 0L, {p('P')} | {p('N')} | {p('B')} | {p('R')} | {p('Q')}), m.k)"
    as_dear = f"get(array(0L, {p('occ')} & {men}, {p('occ')} & {men} & ~{p('P')}, {p('occ')} & {men} & ~{p('P')}, {p('R')} | {p('Q')}, {p('Q')}, {p('occ')}), m.k)"
    king_square = f"if({light}, {p('wk')}, {p('bk')})"
    near = lambda white, planes: "(" + " + ".join(f"{1 << k} * bit_count({planes}.d{k} & get({p('zone')}, if({white}, 0, 1)))" for k in range(5)) + ")"
    guarded = lambda planes: "(" + " | ".join(f"{planes}.d{k}" for k in range(5)) + ")"
    loose = lambda side, planes: f"{side} & {men} & ~{guarded(planes)}"
    pawns = lambda side: f"({p('P')} & {side})"
    mine, yours = _pawns(pawns(own), pawns(opp), light, a_file_quirk), _pawns(pawns(opp), pawns(own), f"NOT {light}", a_file_quirk)
    over = lambda side, guards, hits: f"bit_count({side} & {men} & {_more(guards, hits)} & {guarded(hits)})"
    under = lambda side, guards, hits: f"bit_count({side} & {men} & {_more(hits, guards)})"
    # the last mover's piece and what it took, as seen on the boards before this move
    came, took = code(letter(p("board"), before("t"))), code(before("taken"))
    same = f"{before('t')} = {p('t')}"
    f = {
        "num_legal_moves": f"{each(moves('m.all'))} + {castles}",
        "in_check": yes(f"{p('checkers')} <> 0"),
        "num_checking_moves": f"{each(checks)} + {castle_checks}",
        "num_checking_pieces": f"{each(f'if({checks} > 0 OR (m.k = 6 AND {castle_checks} > 0), 1, 0)')} + if({castle_checks} > 0 AND NOT exists({p('able')}, m -> m.s = {king_square}), 1, 0)",
        "num_capturing_moves": each(moves("m.cap")),
        "num_capturing_pieces": each("if(m.cap <> 0L, 1, 0)"),
        "captures_winning_material": each(moves(f"(m.cap & {dearer})")),
        "materially_safe_captures": each(moves(f"(m.cap & {as_dear})")),
        "move_is_check": yes(f"{after('checkers')} <> 0"),
        "moving_piece_mobility": f"{each('if(m.s = ' + p('f') + ', ' + moves('m.all') + ', 0)')} + if({p('f')} = {king_square}, {castles}, 0)",
        "captures_undefended": yes(f"{taken} <> 0 AND getbit(if({taken} > 0, {guarded(p('hits_w'))}, {guarded(p('hits_b'))}), {p('t')}) = 0"),
        "material_gain": f"CASE WHEN {taken} <> 0 THEN {q.value(taken)} WHEN {p('cap')} THEN 1 ELSE 0 END",
        "piece_type": f"abs({mover})",
        "from_col": q.file(p("f")), "from_row": q.rank(p("f")), "to_col": q.file(p("t")), "to_row": q.rank(p("t")),
        "side_material": worth(own), "opp_material": worth(opp), "material_diff": f"({worth(own)}) - ({worth(opp)})",
    }
    f |= {f"mobility_pt{k}": each(f"if(m.k = {k}, {moves('m.all')}, 0)") + (f" + {castles}" if k == 6 else "") for k in range(1, 7)}
    f |= {
        "undefended_count": f"bit_count({loose(own, ours)})", "undefended_value": worth(f"({loose(own, ours)})"),
        "opp_undefended_count": f"bit_count({loose(opp, theirs)})", "opp_undefended_value": worth(f"({loose(opp, theirs)})"),
        "attackers_near_own_king": near(light, theirs), "defenders_near_own_king": near(light, ours),
        "attackers_near_opp_king": near(f"NOT {light}", ours), "defenders_near_opp_king": near(f"NOT {light}", theirs),
        "pawn_islands": mine["pawn_islands"], "opp_pawn_islands": yours["pawn_islands"],
        "doubled_pawns": mine["doubled_pawns"], "isolated_pawns": mine["isolated_pawns"], "passed_pawns": mine["passed_pawns"],
        "opp_doubled_pawns": yours["doubled_pawns"], "opp_isolated_pawns": yours["isolated_pawns"], "opp_passed_pawns": yours["passed_pawns"],
        "over_defended": over(own, ours, theirs), "under_defended": under(own, ours, theirs), "opp_over_defended": over(opp, theirs, ours), "opp_under_defended": under(opp, theirs, ours),
        **{f"castle_{r.upper()}_{'white' if r.isupper() else 'black'}": yes(f"{p('rights')}[{k}]") for k, r in enumerate("KQkq")},
        "has_en_passant": yes(p("has_ep")),
        "accepted_sacrifice": yes(f"{p('cap')} AND {same} AND {came} <> 0 AND {took} <> 0 AND {q.value(came)} > {q.value(took)}"),
        "interposition_defence": yes(f"{p('checkers')} <> 0 AND {mover} <> 0 AND abs({mover}) <> 6 AND NOT {p('cap')}"),
        "recapture": yes(f"{before('cap')} AND {p('cap')} AND {same}"),
    }
    return f


#: What features see of a position: steps of ``bitboards`` and given values.
SEEN = ("board", "white", "f", "t", "promo", "cap", "taken", "W", "X", "occ", "P", "N", "B", "R", "Q", "K", "wk", "bk", "checkers", "able", "castles", "hits_w", "hits_b", "zone", "rights", "has_ep")


def _field(p: str):
    return lambda name: f"{p}.{name}"


FEATURE_NAMES = list(move_features(_field("p"), _field("a"), _field("b")))
ADVANCED_NAMES = [f"{side}{i}_{k}" for side in "po" for i in range(SLOTS) for k in FEATURE_NAMES]


def advanced(puzzles: DataFrame, a_file_quirk: bool = True) -> DataFrame:
    """PuzzleId, advanced: 540 values, five player and five opponent slots (R17); ADVANCED_NAMES names them.

    One expression, evaluated for each slot: half-move 2i+1 for the player, 2i for the opponent.
    """
    f = move_features(_field("p.at"), _field("p.after"), _field("p.before"), a_file_quirk)
    row = "array(" + ", ".join(f"cast({x} AS double)" for x in f.values()) + ")"
    # positions beyond the slots' are not looked at
    rows = games(puzzles).selectExpr("PuzzleId", f"least(size(raw) - 1, {MAX_HALF_MOVES}) AS played", f"slice(raw, 1, {MAX_HALF_MOVES + 1}) AS raw", f"{tables()} AS rays")
    pos = f"transform(raw, p -> {inside('p', {n: n for n in SEEN})})"
    n = f"if(k < {SLOTS}, 2 * k + 1, 2 * (k - {SLOTS}))"
    slot = q.bind(n, "n", f"if(n < played, {q.bind('named_struct(' + chr(39) + 'at' + chr(39) + ', get(pos, n), ' + chr(39) + 'after' + chr(39) + ', get(pos, n + 1), ' + chr(39) + 'before' + chr(39) + ', get(pos, n - 1))', 'p', row)}, array_repeat(0D, {len(f)}))")
    # one expression, so that positions are not turned into binary rows
    found = q.bind(pos, "pos", f"flatten(transform(sequence(0, {2 * SLOTS - 1}), k -> {slot}))")
    return rows.select("PuzzleId", F.expr(found).alias("advanced"))


def node_features(puzzles: DataFrame) -> DataFrame:
    """PuzzleId, n, is_player and the 54 features of every half-move, in long form (R7-R16): a row for each move,
    whose masks are columns of generated code. No shuffle."""
    each = games(puzzles).select("PuzzleId", F.expr("explode(transform(slice(raw, 1, greatest(size(raw) - 1, 0)), (x, i) -> named_struct('n', i, 'p', x, 'after', get(raw, i + 1), 'before', get(raw, i - 1)))) AS e"))
    rows = columns(each.select("PuzzleId", "e.n", "e.p", "e.after", "e.before"), SEEN)
    rows = columns(rows, ["checkers"], "after", "a_")
    p = lambda name: f"p.{name}" if name in GIVEN else f"b_{name}"
    f = move_features(p, lambda name: f"a_{name}", _field("before"))
    return rows.selectExpr("PuzzleId", "n", "n % 2 = 1 AS is_player", *[f"cast({x} AS int) AS {k}" for k, x in f.items()])


def expand(df: DataFrame, column: str, names: list[str]) -> DataFrame:
    """One column for each value of a block."""
    cols: list[Column] = [F.col(column)[i].alias(n) for i, n in enumerate(names)]
    return df.select("PuzzleId", *cols)
