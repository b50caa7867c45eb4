"""Replay of move lists: one row per puzzle with an array of all its positions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bitboards import CASTLES, GIVEN, columns, inside, tables
from .sqltext import bind

#: What features and themes see of a position: its own values, and steps of ``bitboards``.
FIELDS = {
    **{n: n for n in ("white", "f", "t", "promo", "cap", "bd", "side", "kind", "at", "by", "king", "checkers", "hang", "bad", "trapped", "pins", "legal", "rights")}, "ep": "has_ep",
    "hits_w": "hits_w", "hits_b": "hits_b",
}

_SIDE, _SET = "element_at(fen, 2)", "element_at(fen, 1)"
_WIDE = _SET
for _n in range(8, 0, -1):
    _WIDE = f"replace({_WIDE}, '{_n}', '{'.' * _n}')"
_square = lambda text, i: f"((ascii(substr({text}, {i + 1}, 1)) - 49) * 8 + ascii(substr({text}, {i}, 1)) - 97)"


def _put(board: str, square: str, piece: str) -> str:
    return f"overlay({board} PLACING {piece} FROM {square} + 1 FOR 1)"


def _moved() -> str:
    """The board after the move ``m`` on ``a.board``; castling is the king's step of two or onto its rook."""
    own = "if(a.white, 'R', 'r')"
    usual = _put(f"if(m.is_ep, {_put(_put('a.board', 'm.f', repr('.')), '(m.t + if(a.white, -8, 8))', repr('.'))}, {_put('a.board', 'm.f', repr('.'))})", "m.t", "if(m.promo = 0, m.piece, if(a.white, substr('PNBRQK', m.promo, 1), substr('pnbrqk', m.promo, 1)))")
    cases = []
    for right, (king, to, rook, rook_to) in CASTLES.items():
        k, r = ("K", "R") if right.isupper() else ("k", "r")
        test = f"upper(m.piece) = 'K' AND m.f = {king} AND m.t IN ({to}, {rook}) AND contains(a.castling, '{right}') AND substr(a.board, {king + 1}, 1) = '{k}' AND substr(a.board, {rook + 1}, 1) = '{r}' AND (m.t <> {rook} OR m.target = {own})"
        cases.append(f"WHEN {test} THEN {_put(_put(_put(_put('a.board', str(king), repr('.')), str(rook), repr('.')), str(to), 'm.piece'), str(rook_to), own)}")
    return f"CASE {' '.join(cases)} ELSE {usual} END"


def _fold() -> str:
    """One move more: the position it was played in goes to ``done``; a move that cannot be made stops the replay."""
    form = "'^[a-h][1-8][a-h][1-8][pnbrqkPNBRQK]?$'"
    read = f"""named_struct('f', {_square('u', 1)}, 't', {_square('u', 3)}, 'promo', if(length(u) = 5, locate(upper(substr(u, 5, 1)), 'PNBRQK'), 0))"""
    seen = """named_struct('f', r.f, 't', r.t, 'promo', r.promo, 'piece', substr(a.board, r.f + 1, 1), 'target', substr(a.board, r.t + 1, 1),
      'is_ep', r.t = a.ep AND upper(substr(a.board, r.f + 1, 1)) = 'P' AND abs(r.f - r.t) IN (7, 9) AND substr(a.board, r.t + 1, 1) = '.')"""
    gone = "translate(a.castling, concat(" + ", ".join(f"if(m.f IN ({k}, {rook}) OR m.t IN ({k}, {rook}), '{r}', '')" for r, (k, _, rook, _) in CASTLES.items()) + "), '')"
    cap = "m.is_ep OR (m.target <> '.' AND (m.target = upper(m.target)) <> a.white)"
    following = f"""named_struct('board', {_moved()}, 'white', NOT a.white, 'castling', {gone}, 'ep', if(upper(m.piece) = 'P' AND abs(m.f - m.t) = 16, (m.f + m.t) div 2, -1L),
      'half', if(upper(m.piece) = 'P' OR {cap}, 0, a.half + 1), 'full', if(a.white, a.full, a.full + 1),
      'error', cast(NULL AS string), 'done', concat(a.done, array(named_struct('white', a.white, 'board', a.board, 'castling', a.castling, 'ep', a.ep, 'f', m.f, 't', m.t, 'promo', m.promo, 'cap', {cap}, 'taken', m.target, 'half', a.half, 'full', a.full))))"""
    stop = lambda why: f"named_struct('board', a.board, 'white', a.white, 'castling', a.castling, 'ep', a.ep, 'half', a.half, 'full', a.full, 'error', {why}, 'done', a.done)"
    step = bind(seen, "m", f"if(m.piece = '.', {stop(repr('a move from an empty square'))}, {following})")
    return f"""CASE WHEN a.error IS NOT NULL THEN a WHEN NOT (u RLIKE {form}) THEN {stop("concat('not a move: ', u)")}
      ELSE {bind(read, "r", step)} END"""


def games(puzzles: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """PuzzleId, raw (the GIVEN values of the positions before each move and after the last), error, and the columns
    ``keep``: a fold over the move list. A FEN that cannot be read has no positions; a move that cannot be made ends
    them. One row of the input is one row of the output, no shuffle."""
    return whole_games(puzzles, keep).selectExpr("PuzzleId", *[f"`{c}`" for c in keep], "game.raw AS raw", "game.error AS error")


def whole_games(puzzles: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """``games`` with raw and error as one column ``game``: a filter that names it once replays once."""
    keep = list(keep)
    kept = [f"`{c}`" for c in keep]
    rows = puzzles.selectExpr("cast(PuzzleId AS string) AS PuzzleId", *kept, "coalesce(FEN, '') AS text", "filter(split(trim(coalesce(Moves, '')), '\\\\s+'), u -> u <> '') AS uci", "split(trim(coalesce(FEN, '')), '\\\\s+') AS fen")
    rows = rows.selectExpr("PuzzleId", *kept, "text", "uci", f"{_WIDE} AS wide", f"coalesce(get(fen, 1), '') AS side", "coalesce(get(fen, 2), '-') AS castling", "coalesce(get(fen, 3), '-') AS ep", "coalesce(try_cast(get(fen, 4) AS int), 0) AS half", "coalesce(try_cast(get(fen, 5) AS int), 1) AS full")
    readable = "wide RLIKE '^([pnbrqkPNBRQK.]{8}/){7}[pnbrqkPNBRQK.]{8}$' AND side IN ('w', 'b') AND (ep = '-' OR ep RLIKE '^[a-h][1-8]$')"
    start = f"""named_struct('board', concat_ws('', reverse(split(wide, '/'))), 'white', side = 'w', 'castling', regexp_replace(castling, '[^KQkq]', ''), 'ep', if(ep = '-', -1L, cast({_square('ep', 1)} AS bigint)), 'half', half, 'full', full,
      'error', cast(NULL AS string), 'done', cast(array() AS array<struct<white:boolean,board:string,castling:string,ep:bigint,f:int,t:int,promo:int,cap:boolean,taken:string,half:int,full:int>>))"""
    last = "named_struct('white', s.white, 'board', s.board, 'castling', s.castling, 'ep', s.ep, 'f', cast(NULL AS int), 't', cast(NULL AS int), 'promo', cast(NULL AS int), 'cap', false, 'taken', '', 'half', s.half, 'full', s.full)"
    rows = rows.selectExpr("PuzzleId", *kept, "text", f"if({readable}, aggregate(uci, {start}, (a, u) -> {_fold()}), NULL) AS s")
    found = bind("s", "s", f"named_struct('raw', if(s IS NULL, array(), concat(s.done, array({last}))), 'error', if(s IS NULL, concat('not a position: ', text), s.error))")
    return rows.selectExpr("PuzzleId", *kept, f"{found} AS game")


def replay(puzzles: DataFrame, keep: Iterable[str] = (), fields: Iterable[str] = tuple(FIELDS)) -> DataFrame:
    """PuzzleId, pos (positions before each move and after the last, with ``fields``), error, and the columns ``keep``
    of the same rows."""
    rows = games(puzzles, keep).selectExpr("*", f"{tables()} AS rays")
    made = inside("p", {n: FIELDS.get(n, n) for n in fields})
    return rows.selectExpr("PuzzleId", *[f"`{c}`" for c in keep], f"transform(raw, p -> {made}) AS pos", "error")


def nodes(puzzles: DataFrame, wanted: Iterable[str]) -> DataFrame:
    """PuzzleId, n, p (the GIVEN values) of every position, and the wanted steps as columns b_*."""
    return columns(games(puzzles).select("PuzzleId", F.posexplode("raw").alias("n", "p")), wanted)


def attack_edges(puzzles: DataFrame) -> DataFrame:
    """PuzzleId, n, from_sq, to_sq, piece: who attacks what in every position."""
    each = nodes(puzzles, ["bd", "at"]).select("PuzzleId", "n", "b_bd", F.posexplode("b_at").alias("from_sq", "mask")).filter("mask <> 0")
    return each.selectExpr("PuzzleId", "n", "from_sq", "explode(filter(sequence(0, 63), s -> getbit(mask, s) = 1)) AS to_sq", "b_bd[from_sq] AS piece")


def legal_moves(puzzles: DataFrame) -> DataFrame:
    """PuzzleId, n, from_sq, to_sq, promo, is_capture, gives_check."""
    # one value to the optimiser: it would compute the list anew for each field of a move
    whole = F.explode(F.expr("transform(array(b_legal), x -> x)[0]")).alias("m")
    each = nodes(puzzles, ["legal"]).select("PuzzleId", "n", whole).select("PuzzleId", "n", "m.*")
    return each.withColumnsRenamed({"f": "from_sq", "t": "to_sq", "cap": "is_capture", "chk": "gives_check"})
