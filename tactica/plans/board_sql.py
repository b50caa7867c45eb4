"""Boards in DuckDB SQL: the twins of the board queries, from position strings and a table of lines.

Nothing of the board helper is used here. A board is a text of 64 letters from a1 to h8 with dots for
empty squares; who attacks what is a join of pieces with pairs of squares whose squares between are
empty; a move is legal if, with the occupied squares as they are after it, nobody attacks the king.
"""

from __future__ import annotations

KIND = "PNBRQK"
FEATURES = [
    "num_legal_moves", "in_check", "num_checking_moves", "num_checking_pieces", "num_capturing_moves", "num_capturing_pieces", "captures_winning_material",
    "materially_safe_captures", "move_is_check", "moving_piece_mobility", "captures_undefended", "material_gain", "piece_type", "from_col", "from_row", "to_col", "to_row",
    "side_material", "opp_material", "material_diff", *[f"mobility_pt{k}" for k in range(1, 7)], "undefended_count", "undefended_value", "opp_undefended_count",
    "opp_undefended_value", "attackers_near_own_king", "defenders_near_own_king", "attackers_near_opp_king", "defenders_near_opp_king", "pawn_islands", "opp_pawn_islands",
    "doubled_pawns", "isolated_pawns", "passed_pawns", "opp_doubled_pawns", "opp_isolated_pawns", "opp_passed_pawns", "over_defended", "under_defended",
    "opp_over_defended", "opp_under_defended", "castle_K_white", "castle_Q_white", "castle_K_black", "castle_Q_black", "has_en_passant", "accepted_sacrifice",
    "interposition_defence", "recapture"]


def _at(board: str, s: str) -> str:
    return f"substr({board}, CAST({s} AS BIGINT) + 1, 1)"


def _put(board: str, *changes: tuple[str, str]) -> str:
    for s, piece in changes:
        board = f"(substr({board}, 1, CAST({s} AS BIGINT)) || {piece} || substr({board}, CAST({s} AS BIGINT) + 2))"
    return board


def _code(letter: str) -> str:
    """Signed number of a piece letter, 0 for none."""
    return f"(CASE WHEN {letter} = '.' THEN 0 WHEN {letter} = upper({letter}) THEN 1 ELSE -1 END * strpos('{KIND}', upper({letter})))"


def _square(text: str, i: int) -> str:
    return f"((ascii(substr({text}, {i + 1}, 1)) - 49) * 8 + ascii(substr({text}, {i}, 1)) - 97)"


_DIGITS = "split_part(FEN, ' ', 1)"
for _d in range(1, 9):
    _DIGITS = f"replace({_DIGITS}, '{_d}', '{'.' * _d}')"
#: right -> king from, to, rook from, to
_CASTLE = {"K": (4, 6, 7, 5), "Q": (4, 2, 0, 3), "k": (60, 62, 63, 61), "q": (60, 58, 56, 59)}
_HAS = {r: f"(strpos(rights, '{r}') > 0 AND {_at('board', k)} = '{'K' if r.isupper() else 'k'}' AND {_at('board', rook)} = '{'R' if r.isupper() else 'r'}')" for r, (k, _, rook, _) in _CASTLE.items()}
_CASE_CASTLE = " ".join(
    f"WHEN upper(mover) = 'K' AND a = {k} AND b IN ({to}, {rook}) AND {_HAS[r]} AND (b <> {rook} OR {_at('board', 'b')} = CASE WHEN white THEN 'R' ELSE 'r' END) "
    f"THEN {_put('board', (rook, chr(39) + '.' + chr(39)), (k, chr(39) + '.' + chr(39)), (to, 'mover'), (rook_to, 'CASE WHEN white THEN chr(82) ELSE chr(114) END'))}"
    for r, (k, to, rook, rook_to) in _CASTLE.items())
_EP = "(upper(mover) = 'P' AND b = ep AND abs(a - b) IN (7, 9) AND target = '.')"
_GONE = "translate(rights, " + " || ".join(f"CASE WHEN a IN ({k}, {rook}) OR b IN ({k}, {rook}) THEN '{r}' ELSE '' END" for r, (k, _, rook, _) in _CASTLE.items()) + ", '')"
_MOVED = f"""SELECT *, {_at('board', 'a')} AS mover, {_at('board', 'b')} AS target FROM (
  SELECT *, {_square('uci', 1)} AS a, {_square('uci', 3)} AS b, CASE WHEN length(uci) = 5 THEN strpos('{KIND}', upper(substr(uci, 5, 1))) ELSE 0 END AS promo FROM (
    SELECT *, list_extract(moves, n + 1) AS uci FROM pos WHERE n < len(moves)) WHERE regexp_full_match(uci, '[a-h][1-8][a-h][1-8][pnbrqkPNBRQK]?'))"""


def boards(catalogue: list[tuple[str, str, str]]) -> str:
    """CTEs: positions with the move played in each, pieces, attacks, legal moves."""
    values = ", ".join(f"({i}, '{fen}', '{moves}')" for i, (_, fen, moves) in enumerate(catalogue))
    one = lambda s: f"(1::UBIGINT << CAST({s} AS INTEGER))"
    sees = lambda kind, white: f"""CASE {kind} WHEN 2 THEN g.knight WHEN 6 THEN g.dist = 1 WHEN 1 THEN g.dist = 1 AND g.df <> 0 AND g.dr = CASE WHEN {white} THEN 1 ELSE -1 END
      WHEN 3 THEN g.diagonal WHEN 4 THEN g.straight ELSE g.diagonal OR g.straight END"""  # noqa: E731
    return f"""WITH RECURSIVE cat(i, FEN, Moves) AS (VALUES {values}),
sq AS MATERIALIZED (SELECT s, s % 8 AS f, s // 8 AS r FROM (SELECT unnest(range(64))::INTEGER AS s)),
pair AS MATERIALIZED (SELECT x.s AS a, y.s AS b, y.f - x.f AS df, y.r - x.r AS dr, greatest(abs(y.f - x.f), abs(y.r - x.r)) AS dist FROM sq x, sq y WHERE x.s <> y.s),
geo AS MATERIALIZED (SELECT a, b, df, dr, CASE WHEN straight OR diagonal THEN dist ELSE 0 END AS dist, straight, diagonal, knight,
  CASE WHEN straight OR diagonal THEN list_aggregate(list_transform(range(1, dist), lambda k: 1::UBIGINT << CAST(a + k * (sign(df) + 8 * sign(dr)) AS INTEGER)), 'bit_or') END AS hole
  FROM (SELECT *, df = 0 OR dr = 0 AS straight, abs(df) = abs(dr) AS diagonal, abs(df) * abs(dr) = 2 AS knight FROM pair)),
lines AS MATERIALIZED (SELECT * REPLACE (coalesce(hole, 0::UBIGINT) AS hole) FROM geo WHERE straight OR diagonal OR knight),
pos(i, n, board, white, rights, ep, moves) AS (
  SELECT i, 0, list_aggregate(list_reverse(string_split({_DIGITS}, '/')), 'string_agg', ''), split_part(FEN, ' ', 2) = 'w',
    regexp_replace(split_part(FEN, ' ', 3), '[^KQkq]', '', 'g'), CASE WHEN split_part(FEN, ' ', 4) IN ('-', '') THEN -1 ELSE {_square("split_part(FEN, ' ', 4)", 1)} END,
    list_filter(string_split(trim(Moves), ' '), lambda x: x <> '') FROM cat
  UNION ALL
  SELECT i, n + 1, CASE {_CASE_CASTLE} ELSE {_put("CASE WHEN " + _EP + " THEN " + _put("board", ("CASE WHEN white THEN b - 8 ELSE b + 8 END", "'.'")) + " ELSE board END", ("a", "'.'"), ("b", f"CASE WHEN promo = 0 THEN mover WHEN white THEN substr('{KIND}', promo, 1) ELSE lower(substr('{KIND}', promo, 1)) END"))} END,
    NOT white, {_GONE}, CASE WHEN upper(mover) = 'P' AND abs(a - b) = 16 THEN (a + b) // 2 ELSE -1 END, moves
  FROM ({_MOVED}) WHERE mover <> '.'),
played AS MATERIALIZED (SELECT i, n, a, b, promo, uci, {_code('mover')} AS mover, {_code('target')} AS target, {_EP} OR {_code('target')} * CASE WHEN white THEN 1 ELSE -1 END < 0 AS cap FROM ({_MOVED}) WHERE mover <> '.'),
node AS MATERIALIZED (SELECT p.i, p.n, board, white, rights, ep, a AS f, b AS t, promo, uci, mover, target, cap FROM pos p LEFT JOIN played m ON m.i = p.i AND m.n = p.n),
cell AS MATERIALIZED (SELECT i, n, white, s, {_code('c')} AS p, abs({_code('c')}) AS kind, c = upper(c) AS light FROM (SELECT i, n, white, s, {_at('board', 's')} AS c FROM pos, sq) WHERE c <> '.'),
occ AS MATERIALIZED (SELECT i, n, bit_or({one('s')}) AS mask FROM cell GROUP BY 1, 2),
edge AS MATERIALIZED (SELECT c.i, c.n, c.s AS from_sq, g.b AS to_sq, c.p AS piece, c.light FROM cell c JOIN occ o ON o.i = c.i AND o.n = c.n JOIN lines g ON g.a = c.s
  WHERE ({sees('c.kind', 'c.light')}) AND (g.knight OR (g.hole & o.mask) = 0)),
king AS MATERIALIZED (SELECT i, n, light, s FROM cell WHERE kind = 6),
pseudo AS MATERIALIZED (
  SELECT e.i, e.n, e.from_sq AS f, e.to_sq AS t, abs(e.piece) AS kind, e.light, false AS castles, coalesce(x.p, 0) AS victim,
    abs(e.piece) = 1 AND x.p IS NULL AS ep FROM edge e JOIN pos p ON p.i = e.i AND p.n = e.n AND p.white = e.light LEFT JOIN cell x ON x.i = e.i AND x.n = e.n AND x.s = e.to_sq
    WHERE CASE WHEN abs(e.piece) <> 1 THEN x.p IS NULL OR x.light <> e.light
               ELSE x.light <> e.light OR (x.p IS NULL AND e.to_sq = p.ep AND e.from_sq // 8 = CASE WHEN e.light THEN 4 ELSE 3 END) END
  UNION ALL
  SELECT c.i, c.n, c.s, c.s + k * d, 1, c.light, false, 0, false FROM (SELECT *, CASE WHEN light THEN 8 ELSE -8 END AS d FROM cell WHERE kind = 1 AND light = white) c, (VALUES (1), (2)) v(k), occ o
    WHERE o.i = c.i AND o.n = c.n AND c.s + k * d BETWEEN 0 AND 63 AND (k = 1 OR c.s // 8 = CASE WHEN light THEN 1 ELSE 6 END)
      AND (o.mask & ({one('c.s + d')} | {one('c.s + k * d')})) = 0
  UNION ALL
  SELECT p.i, p.n, v.k, v.t, 6, p.white, true, 0, false FROM pos p, (VALUES {", ".join(f"('{r}', {k}, {to}, {rook}, {rt}, {str(r.isupper()).lower()})" for r, (k, to, rook, rt) in _CASTLE.items())}) v(rt, k, t, rook, rook_to, light), occ o
    WHERE o.i = p.i AND o.n = p.n AND p.white = v.light AND CASE v.rt {" ".join(f"WHEN '{r}' THEN {test}" for r, test in _HAS.items())} END
      AND (o.mask & (SELECT hole FROM lines WHERE a = v.k AND b = v.rook)) = 0
      AND NOT EXISTS (SELECT 1 FROM edge e WHERE e.i = p.i AND e.n = p.n AND e.light <> p.white AND e.to_sq IN (v.k, v.rook_to, v.t))),
tried AS MATERIALIZED (SELECT m.*, row_number() OVER () AS id, CASE WHEN ep THEN CASE WHEN light THEN t - 8 ELSE t + 8 END ELSE -1 END AS eaten,
    CASE WHEN castles THEN CASE WHEN t > f THEN f + 3 ELSE f - 4 END ELSE -1 END AS rook_from, CASE WHEN castles THEN (f + t) // 2 ELSE -1 END AS rook_to, o.mask AS before
  FROM pseudo m JOIN occ o ON o.i = m.i AND o.n = m.n),
moved AS MATERIALIZED (SELECT *, ((before & ~({one('f')} | CASE WHEN eaten < 0 THEN 0::UBIGINT ELSE {one('greatest(eaten, 0)')} END | CASE WHEN rook_from < 0 THEN 0::UBIGINT ELSE {one('greatest(rook_from, 0)')} END))
    | {one('t')} | CASE WHEN rook_to < 0 THEN 0::UBIGINT ELSE {one('greatest(rook_to, 0)')} END) AS mask FROM tried),
unsafe AS MATERIALIZED (SELECT DISTINCT m.id FROM moved m JOIN king k ON k.i = m.i AND k.n = m.n AND k.light = m.light JOIN cell c ON c.i = m.i AND c.n = m.n AND c.light <> m.light AND c.s <> m.t AND c.s <> m.eaten
  JOIN lines g ON g.a = c.s AND g.b = CASE WHEN m.kind = 6 THEN m.t ELSE k.s END WHERE ({sees('c.kind', 'c.light')}) AND (g.knight OR (g.hole & m.mask) = 0)),
safe AS MATERIALIZED (SELECT m.*, unnest(CASE WHEN kind = 1 AND t // 8 IN (0, 7) THEN [5, 4, 3, 2] ELSE [0] END) AS promo FROM moved m WHERE id NOT IN (SELECT id FROM unsafe)),
checks AS MATERIALIZED (SELECT DISTINCT m.id, m.promo FROM safe m JOIN king k ON k.i = m.i AND k.n = m.n AND k.light <> m.light
  JOIN (SELECT i, n, s, kind, light, NULL::BIGINT AS id FROM cell UNION ALL SELECT i, n, t, kind, light, id FROM moved UNION ALL SELECT i, n, rook_to, 4, light, id FROM moved WHERE castles) c
    ON c.i = m.i AND c.n = m.n AND c.light = m.light AND CASE WHEN c.id IS NULL THEN c.s <> m.f AND c.s <> m.rook_from ELSE c.id = m.id END
  JOIN lines g ON g.a = c.s AND g.b = k.s WHERE ({sees('CASE WHEN c.id IS NOT NULL AND c.s = m.t AND m.promo > 0 THEN m.promo ELSE c.kind END', 'c.light')}) AND (g.knight OR (g.hole & m.mask) = 0)),
legal AS MATERIALIZED (SELECT m.i, m.n, m.f, m.t, m.promo, m.kind, m.victim, m.victim <> 0 OR m.ep AS cap, m.ep, c.id IS NOT NULL AS chk FROM safe m LEFT JOIN checks c ON c.id = m.id AND c.promo = m.promo),
hit AS MATERIALIZED (SELECT i, n, to_sq AS s, light, count(*) AS k FROM edge GROUP BY ALL),
checker AS MATERIALIZED (SELECT p.i, p.n, count(e.from_sq) AS k FROM pos p LEFT JOIN king k ON k.i = p.i AND k.n = p.n AND k.light = p.white LEFT JOIN edge e ON e.i = p.i AND e.n = p.n AND e.light <> p.white AND e.to_sq = k.s GROUP BY 1, 2)
"""


def features() -> str:
    """CTE ``feature``: i, n and the FEATURES of every half-move."""
    value = lambda p: f"list_extract([0, 1, 3, 3, 5, 9, 0], abs({p}) + 1)"
    own, opp = "m.white", "NOT m.white"
    groups: dict[str, dict[str, str]] = {"lg": {}, "men": {}, "pawn": {}}  # what is counted once for each node (and side)

    def counted(table: str, what: str) -> str:
        return groups[table].setdefault(what, f"x{len(groups[table])}")

    legal = lambda what: f"lg.{counted('lg', what)}"
    hits = lambda s, side: f"coalesce((SELECT h.k FROM hit h WHERE h.i = m.i AND h.n = m.n AND h.s = {s} AND h.light = ({side})), 0)"
    side_of = lambda table, side, what: f"coalesce({'o' if side == own else 'e'}_{table}.{counted(table, what)}, 0)"
    men = lambda side, what, where: side_of("men", side, f"{what} FILTER (kind <> 6 AND {where})")
    zone = lambda king, side: f"coalesce((SELECT z.k FROM zone z WHERE z.i = m.i AND z.n = m.n AND z.king = ({king}) AND z.light = ({side})), 0)"
    pawns = lambda side, what: side_of("pawn", side, what)
    passed = lambda side: side_of("men", side, "count(*) FILTER (passed)")
    worth = lambda side: side_of("men", side, f"sum({value('p')})")
    same = "b.t = m.t"
    sql = {
        "num_legal_moves": legal("count(l.f)"), "in_check": "k0.k > 0", "num_checking_moves": legal("count(l.f) FILTER (chk)"), "num_checking_pieces": legal("count(DISTINCT l.f) FILTER (chk)"),
        "num_capturing_moves": legal("count(l.f) FILTER (l.cap)"), "num_capturing_pieces": legal("count(DISTINCT l.f) FILTER (l.cap)"),
        "captures_winning_material": legal(f"count(l.f) FILTER (victim <> 0 AND {value('victim')} > {value('kind')})"), "materially_safe_captures": legal(f"count(l.f) FILTER (victim <> 0 AND {value('kind')} <= {value('victim')})"),
        "move_is_check": "k1.k > 0", "moving_piece_mobility": legal("count(l.f) FILTER (l.f = own_f)"), "captures_undefended": f"m.target <> 0 AND {hits('m.t', 'm.target > 0')} = 0",
        "material_gain": f"CASE WHEN m.target <> 0 THEN {value('m.target')} WHEN m.cap THEN 1 ELSE 0 END", "piece_type": "abs(m.mover)",
        "from_col": "m.f % 8", "from_row": "m.f // 8", "to_col": "m.t % 8", "to_row": "m.t // 8", "side_material": worth(own), "opp_material": worth(opp), "material_diff": f"{worth(own)} - {worth(opp)}",
        **{f"mobility_pt{k}": legal(f"count(l.f) FILTER (kind = {k})") for k in range(1, 7)},
        **{f"{pre}undefended_{what}": men(side, "count(*)" if what == "count" else f"sum({value('p')})", "guards = 0") for pre, side in (("", own), ("opp_", opp)) for what in ("count", "value")},
        "attackers_near_own_king": zone(own, opp), "defenders_near_own_king": zone(own, own), "attackers_near_opp_king": zone(opp, own), "defenders_near_opp_king": zone(opp, opp),
        **{f"{pre}pawn_islands": pawns(side, "count(*) FILTER (k > 0 AND prev = 0)") for pre, side in (("", own), ("opp_", opp))},
        **{f"{pre}doubled_pawns": pawns(side, "sum(greatest(k - 1, 0))") for pre, side in (("", own), ("opp_", opp))},
        **{f"{pre}isolated_pawns": pawns(side, "coalesce(sum(k) FILTER (f > 0 AND prev = 0 AND next = 0), 0)") for pre, side in (("", own), ("opp_", opp))},
        **{f"{pre}passed_pawns": passed(side) for pre, side in (("", own), ("opp_", opp))},
        **{f"{pre}over_defended": men(side, "count(*)", "guards > hits AND hits > 0") for pre, side in (("", own), ("opp_", opp))},
        **{f"{pre}under_defended": men(side, "count(*)", "hits > guards") for pre, side in (("", own), ("opp_", opp))},
        **{f"castle_{r.upper()}_{'white' if r.isupper() else 'black'}": test.replace("rights", "m.rights").replace("board", "m.board") for r, test in _HAS.items()},
        "has_en_passant": legal("coalesce(bool_or(l.ep), false)"),
        "accepted_sacrifice": f"m.cap AND {same} AND {value('m_came')} > {value('b.target')} AND m_came <> 0 AND b.target <> 0".replace("m_came", _code(_at("m.board", "b.t"))),
        "interposition_defence": "k0.k > 0 AND m.mover <> 0 AND abs(m.mover) <> 6 AND NOT m.cap", "recapture": f"b.cap AND m.cap AND {same}",
    }
    columns = ", ".join(f"CAST(coalesce({sql[k]}, false) AS INTEGER) AS {k}" if k in _FLAGS else f"CAST({sql[k]} AS INTEGER) AS {k}" for k in FEATURES)
    listed = {t: ", ".join(f"{what} AS {name}" for what, name in g.items()) for t, g in groups.items()}
    sides = " ".join(f"LEFT JOIN {t} {pre}_{t} ON {pre}_{t}.i = m.i AND {pre}_{t}.n = m.n AND {pre}_{t}.light = ({side})" for t in ("men", "pawn") for pre, side in (("o", own), ("e", opp)))
    return f""",
cells AS MATERIALIZED (SELECT c.*, coalesce(g.k, 0) AS guards, coalesce(h.k, 0) AS hits,
  c.kind = 1 AND NOT EXISTS (SELECT 1 FROM cell e WHERE e.i = c.i AND e.n = c.n AND e.kind = 1 AND e.light <> c.light AND abs(e.s % 8 - c.s % 8) <= 1 AND CASE WHEN c.light THEN e.s // 8 > c.s // 8 ELSE e.s // 8 < c.s // 8 END) AS passed
  FROM cell c LEFT JOIN hit g ON g.i = c.i AND g.n = c.n AND g.s = c.s AND g.light = c.light LEFT JOIN hit h ON h.i = c.i AND h.n = c.n AND h.s = c.s AND h.light <> c.light),
filecount AS MATERIALIZED (SELECT p.i, p.n, v.light, f.f, count(c.s) AS k FROM pos p CROSS JOIN (VALUES (true), (false)) v(light) CROSS JOIN (SELECT DISTINCT f FROM sq) f LEFT JOIN cell c ON c.i = p.i AND c.n = p.n AND c.light = v.light AND c.kind = 1 AND c.s % 8 = f.f GROUP BY ALL),
pawnfile AS MATERIALIZED (SELECT *, coalesce(lag(k) OVER w, 0) AS prev, coalesce(lead(k) OVER w, 0) AS next FROM filecount WINDOW w AS (PARTITION BY i, n, light ORDER BY f)),
lg AS MATERIALIZED (SELECT m.i, m.n, {listed['lg']} FROM (SELECT *, f AS own_f FROM node) m LEFT JOIN legal l ON l.i = m.i AND l.n = m.n GROUP BY 1, 2),
men AS MATERIALIZED (SELECT i, n, light, {listed['men']} FROM cells GROUP BY 1, 2, 3),
pawn AS MATERIALIZED (SELECT i, n, light, {listed['pawn']} FROM pawnfile GROUP BY 1, 2, 3),
zone AS MATERIALIZED (SELECT k.i, k.n, k.light AS king, h.light, sum(h.k) AS k FROM king k JOIN hit h ON h.i = k.i AND h.n = k.n AND greatest(abs(h.s % 8 - k.s % 8), abs(h.s // 8 - k.s // 8)) <= 1 GROUP BY 1, 2, 3, 4),
feature AS MATERIALIZED (SELECT m.i, m.n, {columns} FROM node m JOIN checker k0 ON k0.i = m.i AND k0.n = m.n JOIN checker k1 ON k1.i = m.i AND k1.n = m.n + 1 JOIN lg ON lg.i = m.i AND lg.n = m.n
  {sides} LEFT JOIN node b ON b.i = m.i AND b.n = m.n - 1 WHERE m.t IS NOT NULL)
"""


_FLAGS = {"in_check", "move_is_check", "captures_undefended", "has_en_passant", "accepted_sacrifice", "interposition_defence", "recapture", "castle_K_white", "castle_Q_white", "castle_K_black", "castle_Q_black"}


def vocabulary() -> str:
    """CTE ``policy``: move, policy_idx by rule."""
    name = lambda s: f"(chr(CAST(97 + {s} % 8 AS INTEGER)) || CAST({s} // 8 + 1 AS VARCHAR))"
    return f""",
policy AS MATERIALIZED (SELECT move, CAST(row_number() OVER (ORDER BY late, a, b, p) - 1 AS INTEGER) AS policy_idx FROM (
  SELECT {name('a')} || {name('b')} AS move, 0 AS late, a, b, 0 AS p FROM lines
  UNION ALL SELECT {name('a')} || {name('b')} || substr('qrb', k, 1), 1, a, b, k FROM pair, (VALUES (1), (2), (3)) v(k) WHERE a BETWEEN 48 AND 55 AND b BETWEEN 56 AND 63 AND abs(df) <= 1)),
player AS MATERIALIZED (SELECT i, n, CAST(n // 2 AS INTEGER) AS move_idx, uci, white, board, regexp_replace(
    CASE WHEN on_e1 AND seen = 'e1g1' THEN 'e1h1' WHEN on_e1 AND seen = 'e1c1' THEN 'e1a1' ELSE seen END, 'n$', '') AS move FROM (
  SELECT *, upper({_at('board', 'CASE WHEN white THEN 4 ELSE 60 END')}) = 'K' AS on_e1,
    CASE WHEN white THEN uci ELSE substr(uci, 1, 1) || (9 - CAST(substr(uci, 2, 1) AS INTEGER)) || substr(uci, 3, 1) || (9 - CAST(substr(uci, 4, 1) AS INTEGER)) || substr(uci, 5) END AS seen
  FROM node WHERE t IS NOT NULL AND n % 2 = 1 AND n // 2 < 5))
"""
