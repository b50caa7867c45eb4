"""Tactical themes in DuckDB SQL, over the tables of ``board_sql``: the twin of the tagging query.

Every rule is a set of puzzles; a rule sees a move ``x`` of the player with the moves before it (p1,
p2, p3) and boards by number: board n is the one before move n.
"""

from __future__ import annotations

VALUE, KING_VALUE = "[1, 3, 3, 5, 9, 0]", "[1, 3, 3, 5, 9, 99]"


def _v(kind: str, table: str = VALUE) -> str:
    return f"list_extract({table}, {kind})"


def _see(n: str, a: str, b: str) -> str:
    return f"EXISTS (SELECT 1 FROM edge see WHERE see.i = x.i AND see.n = {n} AND see.from_sq = {a} AND see.to_sq = {b})"


def _between(s: str, a: str, b: str) -> str:
    return f"EXISTS (SELECT 1 FROM lines gap WHERE gap.a = {a} AND gap.b = {b} AND (gap.hole & (1::UBIGINT << CAST({s} AS INTEGER))) <> 0)"


def _in(table: str, n: str, s: str) -> str:
    return f"EXISTS (SELECT 1 FROM {table} spot WHERE spot.i = x.i AND spot.n = {n} AND spot.s = {s})"


def _dist(a: str, b: str) -> str:
    return f"greatest(abs(({a}) % 8 - ({b}) % 8), abs(({a}) // 8 - ({b}) // 8))"


def _threat(n: str, s: str) -> str:
    """Whether the piece on ``s`` attacks one of the opponent's."""
    return f"EXISTS (SELECT 1 FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.to_sq WHERE e.i = x.i AND e.n = {n} AND e.from_sq = {s} AND c.light <> z.me)"


def _advanced(low: int) -> str:
    """A promotion, or a pawn of the player's on its last ``low`` ranks."""
    return f"(x.promo > 0 OR (x.ak = 1 AND CASE WHEN z.me THEN x.t // 8 > {7 - low} ELSE x.t // 8 < {low} END))"


def _any(test: str, first: int = 1, last: int = 0) -> str:
    """Puzzles with a move of the player's, from the ``first`` on and without the ``last`` ones, that passes."""
    return f"SELECT DISTINCT x.i FROM turn x JOIN z USING (i) WHERE x.n >= {first} AND x.n <= z.last - {2 * last} AND ({test})"


def _first(decides: str, answer: str, first: int = 1) -> str:
    """Puzzles whose first deciding move of the player's gives the answer."""
    return f"SELECT i FROM (SELECT x.i, ({answer}) AS yes FROM turn x JOIN z USING (i) WHERE x.n >= {first} AND ({decides}) QUALIFY row_number() OVER (PARTITION BY x.i ORDER BY x.n) = 1) WHERE yes"


def _final(test: str) -> str:
    """Mates, seen from the last board; ``k`` is the mated king's square."""
    return f"SELECT x.i FROM turn x JOIN z USING (i) JOIN king ON king.i = x.i AND king.n = z.m AND king.light <> z.me JOIN mated USING (i) WHERE x.n = z.m - 1 AND ({test.replace('@k', 'king.s')})"


def tags() -> str:
    """CTE ``theme``: i, Themes of the puzzles without an error, by cp over or under the bounds."""
    blocked = lambda board, move, more: _any(
        f"""x.tk > 0 AND {more} {_in('hanging', 'x.n', 'x.t')} AND EXISTS (SELECT 1 FROM (SELECT min(e.from_sq) AS d FROM edge e WHERE e.i = x.i AND e.n = x.n - {board} AND e.to_sq = x.t AND e.light = x.tlight) q
        JOIN cell c ON c.i = x.i AND c.n = x.n - {board} AND c.s = q.d JOIN lines g ON g.a = x.t AND g.b = q.d WHERE q.d > 0 AND c.kind IN (3, 4, 5) AND (g.hole & (1::UBIGINT << {move}.t)) <> 0)""", 3)  # fmt: skip
    endgame = lambda kind: f"SELECT i FROM z WHERE {' AND '.join(f'EXISTS (SELECT 1 FROM cell c WHERE c.i = z.i AND c.n = {n} AND c.kind = {kind}) AND NOT EXISTS (SELECT 1 FROM cell c WHERE c.i = z.i AND c.n = {n} AND c.kind NOT IN (1, 6, {kind}))' for n in (1, 2))}"
    queen_rook = "SELECT i FROM z WHERE " + " AND ".join(f"(SELECT count(*) FILTER (kind = 5) = 1 AND count(*) FILTER (kind = 4) > 0 AND count(*) FILTER (kind IN (2, 3)) = 0 FROM cell c WHERE c.i = z.i AND c.n = {n})" for n in (1, 2))
    side = lambda corner, files, pieces: f"""SELECT z.i FROM z JOIN king k ON k.i = z.i AND k.n = 1 AND k.light <> z.me
      WHERE k.s > 0 AND k.s // 8 = z.back AND k.s % 8 IN ({files}) AND (SELECT count(*) FROM cell c WHERE c.i = z.i AND c.n = 1) >= {pieces}
      AND (SELECT bool_or(x.chk1) AND sum(x.chk1::INTEGER + CASE WHEN x.cap AND {_dist(f'z.back * 8 + {corner}', 'x.t')} <= 3 THEN 1 WHEN {_dist(f'z.back * 8 + {corner}', 'x.t')} >= 5 THEN -1 ELSE 0 END) >= 2 FROM turn x WHERE x.i = z.i)"""  # noqa: E731
    hits = "EXISTS (SELECT 1 FROM edge e WHERE e.i = x.i AND e.n = z.m AND e.to_sq = s.s AND e.light = z.me {})"
    front = f"SELECT 1 FROM sq s LEFT JOIN cell c ON c.i = x.i AND c.n = z.m AND c.s = s.s WHERE s.s // 8 = @k // 8 + CASE WHEN z.me THEN -1 ELSE 1 END AND abs(s.s % 8 - @k % 8) <= 1 AND (c.s IS NULL OR c.light = z.me OR {hits.format('')})"
    step = "CASE WHEN @k % 8 = 0 THEN 1 ELSE -1 END"
    helper = lambda test: f"EXISTS (SELECT 1 FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.from_sq WHERE e.i = x.i AND e.n = z.m AND e.to_sq = x.t AND e.light = z.me AND c.kind = 2 AND {test})"
    around = f"NOT EXISTS (SELECT 1 FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.from_sq WHERE e.i = x.i AND e.n = z.m AND e.light = z.me AND c.kind <> 3 AND {_dist('e.to_sq', '@k')} < 2)"
    bishops = "(SELECT list(c.s ORDER BY c.s) FROM cell c WHERE c.i = x.i AND c.n = z.m AND c.kind = 3 AND c.light = z.me)"
    diagonal = f"len({bishops}) >= 2 AND {around}"
    split = f"(list_extract({bishops}, 1) % 8 < @k % 8) = (list_extract({bishops}, 2) % 8 > @k % 8)"
    dovetail = f"""@k % 8 NOT IN (0, 7) AND @k // 8 NOT IN (0, 7) AND x.ak = 5 AND x.t % 8 <> @k % 8 AND x.t // 8 <> @k // 8 AND {_dist('x.t', '@k')} <= 1
      AND NOT EXISTS (SELECT 1 FROM sq s WHERE {_dist('s.s', '@k')} = 1 AND s.s <> x.t AND CASE WHEN {hits.format('AND e.from_sq <> x.t')} THEN true WHEN {hits.format('')} THEN EXISTS (SELECT 1 FROM cell c WHERE c.i = x.i AND c.n = z.m AND c.s = s.s) ELSE false END)"""
    rules: list[tuple[str, list[tuple[str, str]]]] = [
        ("mate_in", [*((f"mateIn{k}", f"SELECT i FROM mated JOIN z USING (i) WHERE m // 2 = {k}") for k in range(1, 5)), ("mateIn5", "SELECT i FROM mated")]),
        ("mate", [("mate", "SELECT i FROM mated")]),
        ("pattern", [
            ("smotheredMate", _final(f"EXISTS (SELECT 1 FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.from_sq WHERE e.i = x.i AND e.n = z.m AND e.to_sq = @k AND e.light = z.me AND c.kind = 2) AND NOT EXISTS (SELECT 1 FROM sq s LEFT JOIN cell c ON c.i = x.i AND c.n = z.m AND c.s = s.s WHERE {_dist('s.s', '@k')} = 1 AND (c.s IS NULL OR c.light = z.me))")),
            ("backRankMate", _final(f"@k // 8 = z.back AND NOT EXISTS ({front}) AND EXISTS (SELECT 1 FROM edge e WHERE e.i = x.i AND e.n = z.m AND e.to_sq = @k AND e.light = z.me AND e.from_sq // 8 = z.back)")),
            ("anastasiaMate", _final(f"@k % 8 IN (0, 7) AND @k // 8 NOT IN (0, 7) AND x.t % 8 = @k % 8 AND x.ak IN (4, 5) AND EXISTS (SELECT 1 FROM cell c WHERE c.i = x.i AND c.n = z.m AND c.s = @k + {step} AND c.light <> z.me) AND EXISTS (SELECT 1 FROM cell c WHERE c.i = x.i AND c.n = z.m AND c.s = @k + 3 * {step} AND c.light = z.me AND c.kind = 2)")),
            ("hookMate", _final(f"x.ak = 4 AND {_dist('x.t', '@k')} = 1 AND {helper(_dist('c.s', '@k') + ' = 1 AND EXISTS (SELECT 1 FROM edge d JOIN cell p ON p.i = d.i AND p.n = d.n AND p.s = d.from_sq WHERE d.i = x.i AND d.n = z.m AND d.to_sq = c.s AND d.light = z.me AND p.kind = 1)')}")),
            ("arabianMate", _final(f"@k % 8 IN (0, 7) AND @k // 8 IN (0, 7) AND x.ak = 4 AND {_dist('x.t', '@k')} = 1 AND {helper('abs(c.s // 8 - @k // 8) = 2 AND abs(c.s % 8 - @k % 8) = 2')}")),
            ("bodenMate", _final(f"{diagonal} AND {split}")), ("doubleBishopMate", _final(diagonal)), ("dovetailMate", _final(dovetail))]),
        ("outcome", [("", "SELECT i FROM mated")]),
        ("attraction", [("attraction", _any(f"a1.t = x.t AND a1.ak IN (4, 5, 6) AND {_see('x.n + 3', 'a2.t', 'x.t')} AND EXISTS (SELECT 1 FROM cell c WHERE c.i = x.i AND c.n = x.n + 3 AND c.s = a2.t AND c.light = z.me) AND (a1.ak = 6 OR coalesce(a4.t = x.t, false))").replace(
            "JOIN z USING (i) WHERE", "JOIN z USING (i) JOIN nd a1 ON a1.i = x.i AND a1.n = x.n + 1 JOIN nd a2 ON a2.i = x.i AND a2.n = x.n + 2 LEFT JOIN nd a4 ON a4.i = x.i AND a4.n = x.n + 4 WHERE", 1))]),
        ("deflection", [("deflection", _any(f"""(x.tk > 0 OR x.promo > 0) AND NOT (x.tk > 0 AND {_v('x.tk', KING_VALUE)} > {_v('x.ak', KING_VALUE)}) AND (x.p2tk = 0 OR {_v('x.p2tk')} < x.p2ak) AND x.t <> x.p1t AND x.t <> x.p2t
          AND (x.p1t = x.p2t OR x.p2chk1) AND ({_see('x.n - 1', 'x.p1f', 'x.t')} OR (x.promo > 0 AND x.t % 8 = x.p1f % 8 AND {_see('x.n - 1', 'x.p1f', 'x.f')})) AND NOT {_see('x.n', 'x.p1t', 'x.t')}""", 3))]),
        ("advancedPawn", [("advancedPawn", _any(_advanced(2)))]),
        ("doubleCheck", [("doubleCheck", _any("x.checkers1 > 1"))]),
        ("quietMove", [("quietMove", _any(f"x.n < z.m - 1 AND NOT x.chk1 AND NOT x.chk0 AND NOT x.cap AND NOT {_threat('x.n + 1', 'x.t')} AND NOT {_advanced(3)} AND x.ak <> 6"))]),
        ("defensiveMove", [("defensiveMove", f"SELECT x.i FROM nd x JOIN z USING (i) WHERE x.n = z.m - 1 AND x.nlegal >= 3 AND NOT x.chk1 AND NOT x.cap AND NOT {_threat('x.n + 1', 'x.t')} AND NOT {_advanced(3).replace('CASE WHEN z.me', 'CASE WHEN x.light')} UNION "
                           + _first("x.chk1 OR x.cap OR x.nlegal < 3 OR x.chk0", "NOT x.chk1 AND NOT x.cap AND x.nlegal >= 3"))]),
        ("sacrifice", [("sacrifice", _any("x.bal1 - (SELECT bal FROM stand s WHERE s.i = x.i AND s.n = 1) <= -2 AND NOT EXISTS (SELECT 1 FROM nd o WHERE o.i = x.i AND o.n >= 2 AND o.n % 2 = 0 AND o.promo > 0)", 3))]),
        ("xRayAttack", [("xRayAttack", _any(f"x.cap AND x.p1t = x.t AND x.p1ak <> 6 AND x.p2t = x.p1t AND {_between('x.p1f', 'x.f', 'x.t')}", 3))]),
        ("fork", [("fork", _any(f"""x.ak <> 6 AND NOT {_in('badspot', 'x.n + 1', 'x.t')} AND (SELECT count(*) FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.to_sq WHERE e.i = x.i AND e.n = x.n + 1 AND e.from_sq = x.t AND c.light <> z.me AND c.kind <> 1
          AND ({_v('c.kind', KING_VALUE)} > {_v('x.ak', KING_VALUE)} OR ({_in('hanging', 'x.n + 1', 'c.s')} AND NOT {_see('x.n + 1', 'c.s', 'x.t')}))) > 1""", 1, 1))]),
        ("hangingPiece", [("hangingPiece", f"""SELECT x.i FROM turn x JOIN z USING (i) WHERE x.n = 1 AND x.tk > 1 AND {_in('hanging', '1', 'x.t')} AND NOT (x.p1tk > 0 AND {_v('x.p1tk')} >= {_v('x.tk')} AND x.p1t = x.t)
          AND (z.m < 4 OR (SELECT bal FROM stand s WHERE s.i = x.i AND s.n = 4) >= (SELECT bal FROM stand s WHERE s.i = x.i AND s.n = 2))""")]),
        ("trappedPiece", [("trappedPiece", _any(f"x.tk > 1 AND {_in('trapped', 'x.n - 1', 'CASE WHEN x.p1t = x.t THEN x.p1f ELSE x.t END')}", 3))]),
        ("discoveredAttack", [("discoveredAttack", _any(f"x.chk1 AND NOT EXISTS (SELECT 1 FROM edge e JOIN king k ON k.i = e.i AND k.n = e.n AND k.s = e.to_sq AND k.light <> z.me WHERE e.i = x.i AND e.n = x.n + 1 AND e.from_sq = x.t)") + " UNION "
                              + _first(f"x.cap AND (x.p1t = x.t OR ({_between('x.p2f', 'x.f', 'x.t')} AND x.t <> x.p2t AND x.f <> x.p2t AND NOT (x.p2ak = 6 AND {_dist('x.p2f', 'x.p2t')} > 1)))", "x.p1t <> x.t", 3))]),
        ("exposedKing", [("exposedKing", f"""SELECT z.i FROM z JOIN king k ON k.i = z.i AND k.n = 1 AND k.light <> z.me WHERE CASE WHEN z.me THEN k.s // 8 ELSE 7 - k.s // 8 END >= 5
          AND NOT EXISTS (SELECT 1 FROM cell c WHERE c.i = z.i AND c.n = 1 AND c.kind = 1 AND c.light <> z.me AND ((c.s = k.s + CASE WHEN z.me THEN -8 ELSE 8 END) OR (abs(c.s % 8 - k.s % 8) = 1 AND c.s // 8 - k.s // 8 IN (0, CASE WHEN z.me THEN -1 ELSE 1 END))))
          AND z.i IN ({_any('x.chk1', 3, 1)})""")]),
        ("skewer", [("skewer", _any(f"x.tk > 0 AND x.ak IN (3, 4, 5) AND NOT x.mate1 AND x.p1t <> x.t AND {_between('x.p1f', 'x.f', 'x.t')} AND {_v('x.p1ak', KING_VALUE)} > {_v('x.tk', KING_VALUE)} AND {_in('badspot', 'x.n', 'x.t')}", 3))]),
        ("collinear", [("collinear", _any("""x.ak IN (3, 4, 5) AND NOT x.cap AND EXISTS (SELECT 1 FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.to_sq JOIN legal l ON l.i = e.i AND l.n = e.n AND l.f = x.f AND l.t = c.s AND l.promo = 0
          WHERE e.i = x.i AND e.n = x.n AND e.from_sq = x.f AND c.light <> z.me AND c.kind IN (3, 4, 5)
          AND ((x.f // 8 = c.s // 8 AND c.s // 8 = x.t // 8) OR (x.f % 8 = c.s % 8 AND c.s % 8 = x.t % 8) OR (x.f // 8 - x.f % 8 = c.s // 8 - c.s % 8 AND c.s // 8 - c.s % 8 = x.t // 8 - x.t % 8) OR (x.f // 8 + x.f % 8 = c.s // 8 + c.s % 8 AND c.s // 8 + c.s % 8 = x.t // 8 + x.t % 8))
          AND c.kind <> CASE WHEN x.f // 8 = c.s // 8 OR x.f % 8 = c.s % 8 THEN 3 ELSE 4 END)"""))]),
        ("interference", [("interference", blocked(1, "x.p1", "").replace("x.p1.t", "x.p1t") + " UNION " + blocked(2, "x.p2", "x.t <> x.p1t AND").replace("x.p2.t", "x.p2t"))]),
        ("intermezzo", [("intermezzo", _first(f"x.cap AND NOT ({_see('x.n - 1', 'x.p1f', 'x.t')}) AND x.p2t <> x.t",
                                              "x.p3t = x.t AND x.p3cap AND EXISTS (SELECT 1 FROM legal l WHERE l.i = x.i AND l.n = x.n - 2 AND l.f = x.f AND l.t = x.t AND l.promo = x.promo)", 3))]),
        ("pin", [("pin", _any(f"""EXISTS (SELECT 1 FROM pinned p JOIN edge e ON e.i = p.i AND e.n = p.n AND e.from_sq = p.s JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.to_sq AND c.light = z.me
            WHERE p.i = x.i AND p.n = x.n + 1 AND p.light <> z.me AND (p.ray & (1::UBIGINT << c.s)) = 0 AND ({_v('c.kind')} > {_v('p.kind')} OR {_in('hanging', 'x.n + 1', 'c.s')}))
          OR EXISTS (SELECT 1 FROM pinned p JOIN edge e ON e.i = p.i AND e.n = p.n AND e.to_sq = p.s AND e.light = z.me
            WHERE p.i = x.i AND p.n = x.n + 1 AND p.light <> z.me AND (p.ray & (1::UBIGINT << e.from_sq)) <> 0
            AND ({_v('p.kind')} > {_v('abs(e.piece)')} OR ({_in('hanging', 'x.n + 1', 'p.s')} AND NOT {_see('x.n + 1', 'p.s', 'e.from_sq')} AND EXISTS (SELECT 1 FROM pseudo d WHERE d.i = x.i AND d.n = x.n + 1 AND d.f = p.s AND (p.ray & (1::UBIGINT << CAST(d.t AS INTEGER))) = 0))))"""))]),
        ("attackingF2F7", [("attackingF2F7", _first("x.tk > 0 AND x.t IN (13, 53)", "EXISTS (SELECT 1 FROM king k WHERE k.i = x.i AND k.n = x.n + 1 AND k.light <> z.me AND k.s = CASE WHEN x.t = 53 THEN 60 ELSE 4 END)"))]),
        ("clearance", [("clearance", _any(f"x.tk = 0 AND x.ak IN (3, 4, 5) AND x.p2promo = 0 AND x.p2t <> x.f AND x.p2t <> x.t AND NOT x.chk0 AND (NOT x.chk1 OR x.p1ak <> 6) AND (x.p2f = x.t OR {_between('x.p2f', 'x.f', 'x.t')}) AND (x.p2tk = 0 OR {_in('badspot', 'x.n - 1', 'x.p2t')})", 3))]),
        ("enPassant", [("enPassant", _any("x.ak = 1 AND x.f % 8 <> x.t % 8 AND x.tk = 0"))]),
        ("castling", [("castling", _any(f"x.ak = 6 AND {_dist('x.f', 'x.t')} > 1"))]),
        ("promotion", [("promotion", _any("x.promo > 0"))]),
        ("underPromotion", [("underPromotion", _first("x.mate1 OR (x.promo > 0 AND x.promo <> 5)", "NOT x.mate1 OR x.promo = 2"))]),
        ("capturingDefender", [("capturingDefender", _any(f"(x.mate1 OR (x.tk > 0 AND x.ak <> 6 AND {_v('x.tk')} <= {_v('x.ak')} AND {_in('hanging', 'x.n', 'x.t')} AND x.p1t <> x.t)) AND NOT x.p2chk1 AND x.p2t <> x.f AND x.p2tk > 0 AND {_see('x.n - 2', 'x.p2t', 'x.t')} AND NOT x.p2chk0", 3))]),
        ("endgame", [(f"{name}Endgame", endgame(k)) for name, k in (("pawn", 1), ("queen", 5), ("rook", 4), ("bishop", 3), ("knight", 2))] + [("queenRookEndgame", queen_rook)]),
        ("side", [("kingsideAttack", side(7, "6, 7", 20)), ("queensideAttack", side(0, "0, 1, 2", 18))]),
        ("length", [("oneMove", "SELECT i FROM z WHERE m = 2"), ("short", "SELECT i FROM z WHERE m = 4"), ("veryLong", "SELECT i FROM z WHERE m >= 8"), ("long", "SELECT i FROM z")]),
    ]
    ctes, columns = [], []
    for name, choices in rules:
        parts = " UNION ALL ".join(f"SELECT i, {k} AS k, '{tag}' AS tag FROM ({sql})" for k, (tag, sql) in enumerate(choices))
        ctes.append(f"r_{name} AS MATERIALIZED (SELECT i, arg_min(tag, k) AS tag FROM ({parts}) GROUP BY i)")
        columns.append(f"r_{name}.tag AS t_{name}")
    joins = " ".join(f"LEFT JOIN r_{name} ON r_{name}.i = z.i" for name, _ in rules)
    lists = ", ".join({"outcome": "CASE WHEN t_outcome IS NULL THEN CASE WHEN cp > 600 THEN 'crushing' WHEN cp > 200 THEN 'advantage' ELSE 'equality' END END",
                       "side": "CASE WHEN t_pattern IS NOT DISTINCT FROM 'backRankMate' OR t_fork IS NOT NULL THEN NULL ELSE t_side END"}.get(name, f"t_{name}") for name, _ in rules)
    return f""",
stand AS MATERIALIZED (SELECT c.i, c.n, coalesce(sum(CASE WHEN c.light = s.white THEN 1 ELSE -1 END * {_v('c.kind')}), 0) AS bal FROM cell c JOIN pos s ON s.i = c.i AND s.n = 1 GROUP BY 1, 2),
nlegal AS MATERIALIZED (SELECT p.i, p.n, count(l.f) AS k FROM pos p LEFT JOIN legal l ON l.i = p.i AND l.n = p.n GROUP BY 1, 2),
nd AS MATERIALIZED (SELECT m.i, m.n, m.f, m.t, m.promo, m.cap, m.mover > 0 AS light, abs(m.mover) AS mk, abs(m.target) AS tk, m.target > 0 AS tlight, coalesce(a.kind, 0) AS ak,
  c0.k > 0 AS chk0, c1.k > 0 AS chk1, c1.k AS checkers1, c1.k > 0 AND l1.k = 0 AS mate1, l0.k AS nlegal, s.bal AS bal1
  FROM node m JOIN checker c0 ON c0.i = m.i AND c0.n = m.n JOIN checker c1 ON c1.i = m.i AND c1.n = m.n + 1 JOIN nlegal l0 ON l0.i = m.i AND l0.n = m.n JOIN nlegal l1 ON l1.i = m.i AND l1.n = m.n + 1
  LEFT JOIN cell a ON a.i = m.i AND a.n = m.n + 1 AND a.s = m.t LEFT JOIN stand s ON s.i = m.i AND s.n = m.n + 1 WHERE m.t IS NOT NULL),
z AS MATERIALIZED (SELECT p.i, max(p.n) AS m, bool_or(p.white) FILTER (p.n = 1) AS me, CASE WHEN bool_or(p.white) FILTER (p.n = 1) THEN 7 ELSE 0 END AS back, max(p.n) - 1 - (max(p.n) % 2) AS last FROM pos p
  GROUP BY 1 HAVING max(p.n) >= 2 AND max(p.n) = max(len(p.moves)) AND count(*) * 2 = (SELECT count(*) FROM king k WHERE k.i = p.i)),
mated AS MATERIALIZED (SELECT nd.i FROM nd JOIN z ON z.i = nd.i AND nd.n = z.m - 1 WHERE mate1),
turn AS MATERIALIZED (SELECT x.*, p1.f AS p1f, p1.t AS p1t, p1.ak AS p1ak, p1.tk AS p1tk, p2.f AS p2f, p2.t AS p2t, p2.ak AS p2ak, p2.tk AS p2tk, p2.promo AS p2promo, p2.chk0 AS p2chk0, p2.chk1 AS p2chk1, p3.t AS p3t, p3.cap AS p3cap
  FROM nd x LEFT JOIN nd p1 ON p1.i = x.i AND p1.n = x.n - 1 LEFT JOIN nd p2 ON p2.i = x.i AND p2.n = x.n - 2 LEFT JOIN nd p3 ON p3.i = x.i AND p3.n = x.n - 3 WHERE x.n % 2 = 1 AND x.i IN (SELECT i FROM z)),
guarded AS MATERIALIZED (SELECT c.i, c.n, c.s FROM cell c JOIN hit h ON h.i = c.i AND h.n = c.n AND h.s = c.s AND h.light = c.light
  UNION SELECT c.i, c.n, c.s FROM edge e JOIN cell c ON c.i = e.i AND c.n = e.n AND c.s = e.to_sq AND c.light <> e.light JOIN cell d ON d.i = c.i AND d.n = c.n AND d.light = c.light AND d.kind IN (3, 4, 5)
    JOIN lines g ON g.a = d.s AND g.b = c.s AND NOT g.knight JOIN occ o ON o.i = c.i AND o.n = c.n
    WHERE abs(e.piece) IN (3, 4, 5) AND (g.hole & o.mask) = (1::UBIGINT << CAST(e.from_sq AS INTEGER)) AND CASE d.kind WHEN 3 THEN g.diagonal WHEN 4 THEN g.straight ELSE true END),
hanging AS MATERIALIZED (SELECT i, n, s FROM cell EXCEPT SELECT i, n, s FROM guarded),
badspot AS MATERIALIZED (SELECT DISTINCT c.i, c.n, c.s FROM cell c JOIN edge e ON e.i = c.i AND e.n = c.n AND e.to_sq = c.s AND e.light <> c.light LEFT JOIN hanging h ON h.i = c.i AND h.n = c.n AND h.s = c.s
  WHERE c.kind <> 6 AND (h.s IS NOT NULL OR (abs(e.piece) <> 6 AND {_v('abs(e.piece)')} < {_v('c.kind')}))),
pinned AS MATERIALIZED (SELECT DISTINCT c.i, c.n, c.s, c.kind, c.light, g.hole | (SELECT bit_or(1::UBIGINT << CAST(l.b AS INTEGER)) FROM lines l WHERE l.a = k.s AND NOT l.knight AND sign(l.df) = sign(g.df) AND sign(l.dr) = sign(g.dr))
    | coalesce((SELECT bit_or(1::UBIGINT << CAST(l.b AS INTEGER)) FROM lines l WHERE l.a = k.s AND NOT l.knight AND sign(l.df) = -sign(g.df) AND sign(l.dr) = -sign(g.dr)), 0::UBIGINT) | (1::UBIGINT << CAST(k.s AS INTEGER)) AS ray
  FROM king k JOIN lines g ON g.a = k.s AND NOT g.knight JOIN cell a ON a.i = k.i AND a.n = k.n AND a.s = g.b AND a.light <> k.light AND CASE a.kind WHEN 3 THEN g.diagonal WHEN 4 THEN g.straight ELSE a.kind = 5 END
  JOIN occ o ON o.i = k.i AND o.n = k.n JOIN cell c ON c.i = k.i AND c.n = k.n AND c.light = k.light AND (g.hole & o.mask) = (1::UBIGINT << CAST(c.s AS INTEGER))),
tryout AS MATERIALIZED (SELECT m.id, m.i, m.n, m.f, m.t, m.light, m.mask, m.eaten, m.victim, m.promo, CASE WHEN m.promo > 0 THEN m.promo ELSE m.kind END AS kind FROM safe m JOIN badspot b ON b.i = m.i AND b.n = m.n AND b.s = m.f WHERE m.kind NOT IN (1, 6)),
other AS MATERIALIZED (SELECT y.id, y.light AS own, c.s, c.kind, c.light FROM tryout y JOIN cell c ON c.i = y.i AND c.n = y.n AND c.s NOT IN (y.f, y.t, y.eaten)),
reach AS MATERIALIZED (SELECT y.id, c.s, c.kind, c.light, g.hole, CASE c.kind WHEN 2 THEN g.knight WHEN 6 THEN g.dist = 1 WHEN 1 THEN g.dist = 1 AND g.df <> 0 AND g.dr = CASE WHEN c.light THEN 1 ELSE -1 END
    WHEN 3 THEN g.diagonal WHEN 4 THEN g.straight ELSE g.diagonal OR g.straight END AS sees, g.knight OR (g.hole & y.mask) = 0 AS open, g.hole & y.mask AS wall
  FROM tryout y JOIN other c ON c.id = y.id JOIN lines g ON g.a = c.s AND g.b = y.t),
worse AS MATERIALIZED (SELECT y.id FROM tryout y WHERE EXISTS (SELECT 1 FROM reach r WHERE r.id = y.id AND r.sees AND r.open AND r.light <> y.light)
  AND (EXISTS (SELECT 1 FROM reach r WHERE r.id = y.id AND r.sees AND r.open AND r.light <> y.light AND r.kind <> 6 AND {_v('r.kind')} < {_v('y.kind')})
    OR NOT (EXISTS (SELECT 1 FROM reach r WHERE r.id = y.id AND r.sees AND r.open AND r.light = y.light)
      OR EXISTS (SELECT 1 FROM reach d JOIN reach e ON e.id = d.id WHERE d.id = y.id AND d.light = y.light AND d.sees AND d.kind IN (3, 4, 5) AND e.light <> y.light AND e.sees AND e.open AND e.kind IN (3, 4, 5) AND d.wall = (1::UBIGINT << CAST(e.s AS INTEGER)))))),
trapped AS MATERIALIZED (SELECT b.i, b.n, b.s FROM badspot b JOIN cell c ON c.i = b.i AND c.n = b.n AND c.s = b.s JOIN pos p ON p.i = b.i AND p.n = b.n AND p.white = c.light JOIN checker k ON k.i = b.i AND k.n = b.n
  WHERE c.kind NOT IN (1, 6) AND k.k = 0 AND NOT EXISTS (SELECT 1 FROM pinned q WHERE q.i = b.i AND q.n = b.n AND q.s = b.s)
  AND NOT EXISTS (SELECT 1 FROM tryout y WHERE y.i = b.i AND y.n = b.n AND y.f = b.s AND ((y.victim <> 0 AND {_v('abs(y.victim)')} >= {_v('c.kind')}) OR y.id NOT IN (SELECT id FROM worse)))),
{", ".join(ctes)},
theme AS (SELECT z.i, {", ".join(columns)} FROM z {joins})
""" + f"""SELECT CAST(p_partkey AS VARCHAR) AS PuzzleId, CASE WHEN th.i IS NOT NULL THEN cp END AS cp, CASE WHEN th.i IS NULL THEN '' ELSE array_to_string(list_filter([{lists}], lambda t: t IS NOT NULL AND t <> ''), ' ') END AS Themes
FROM (SELECT *, CAST(p_size * 20 - 300 AS INTEGER) AS cp FROM part) LEFT JOIN theme th ON th.i = p_partkey % (SELECT count(*) FROM cat)"""
