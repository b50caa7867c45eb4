"""Tactical themes (T1-T26): every rule is a predicate over the positions of one puzzle, so no shuffle.

In a rule, node n is the n-th move: ``at(n)`` is the board before it, ``at(n + 1)`` the board after
it; the player moves at odd n. ``me`` and ``op`` index the player's and the opponent's pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import sqltext as q
from .bitboards import DIRECTIONS, STEPS, bit, inside, tables
from .replay import whole_games

RAYS = "(3, 4, 5)"
#: What the rules see of a position.
SEEN = ("white", "f", "t", "promo", "cap", "bd", "side", "kind", "at", "king", "checkers", "hang", "bad", "trapped", "pins", "reach", "castle_to", "n_legal")
#: A puzzle with one of these has no tags: unreadable, a move that cannot be made, under two moves, a missing king, no cp.
WHY = q.bind("game", "g", """CASE WHEN g.error IS NOT NULL THEN g.error WHEN cp IS NULL THEN 'no evaluation' WHEN size(g.raw) < 3 THEN 'under two moves'
  WHEN exists(g.raw, p -> NOT (contains(p.board, 'K') AND contains(p.board, 'k'))) THEN 'a king is missing' END""")
P, N, B, R, Q, K = range(1, 7)


class Node:
    """SQL about the move at ``n`` and the boards around it."""

    def __init__(self, n: str):
        self.n = n

    def at(self, k: int = 0) -> str:
        return f"get(pos, {self.n} + {k})" if k >= 0 else f"get(pos, {self.n} - {-k})"

    def f(self, k: int = 0) -> str:
        return f"{self.at(k)}.f"

    def t(self, k: int = 0) -> str:
        return f"{self.at(k)}.t"

    def cap(self, k: int = 0) -> str:
        return f"{self.at(k)}.cap"

    def piece(self, k: int, square: str) -> str:
        return f"get({self.at(k)}.bd, {square})"

    def taken(self, k: int = 0) -> str:
        return self.piece(k, self.t(k))

    def moved(self, k: int = 0) -> str:
        """Type of the piece on the target after move n + k."""
        return f"abs({self.piece(k + 1, self.t(k))})"

    def check(self, k: int) -> str:
        return f"({self.at(k)}.checkers <> 0)"

    def mate(self, k: int) -> str:
        return f"({self.at(k)}.checkers <> 0 AND size({self.at(k)}.reach) = 0)"

    def has(self, k: int, field: str, square: str) -> str:
        return q.bit(f"{self.at(k)}.{field}", square)

    def sees(self, k: int, side: str, a: str, b: str) -> str:
        """Whether the piece on ``a`` is of a side and attacks ``b``."""
        return f"(getbit(get({self.at(k)}.at, {a}), {b}) = 1 AND getbit({self.side(k, side)}, {a}) = 1)"

    def can(self, k: int, a: str, b: str, promo: str) -> str:
        """Whether a move from ``a`` to ``b`` that becomes ``promo`` is legal."""
        piece = f"exists({self.at(k)}.reach, m -> m.s = {a} AND getbit(m.to | m.ep, {b}) = 1 AND if(m.k = {P} AND {q.rank(b)} IN (0, 7), {promo} BETWEEN {N} AND {Q}, {promo} = 0))"
        return f"({piece} OR exists({self.at(k)}.castle_to, m -> m.f = {a} AND m.t = {b} AND {promo} = 0))"

    def attacks(self, k: int, square: str) -> str:
        return f"get({self.at(k)}.at, {square})"

    def side(self, k: int, side: str) -> str:
        return f"get({self.at(k)}.side, {side})"

    def castled(self, k: int = 0) -> str:
        return f"({self.moved(k)} = {K} AND {q.distance(self.f(k), self.t(k))} > 1)"

    def advanced_pawn(self, low: int, high: int) -> str:
        return f"({self.at()}.promo > 0 OR {self.moved()} = {P} AND if({self.at(1)}.white, {q.rank(self.t())} < {low}, {q.rank(self.t())} > {high}))"


def attackers(position: str, men: str, square: str) -> str:
    """Mask of those of ``men`` that attack a square."""
    a, v = q.fresh("a"), q.fresh()
    return f"aggregate({q.squares(men)}, 0L, ({a}, {v}) -> {a} | if({q.bit(f'get({position}.at, {v})', square)}, shiftleft(1L, {v}), 0L))"


def balance(k: str) -> str:
    """Material of the player less the opponent's on board k."""
    side = lambda s: " + ".join(f"bit_count(get(pos, {k}).kind[{i}] & get(pos, {k}).side[{s}]) * {v}" for i, v in ((1, 1), (2, 3), (3, 3), (4, 5), (5, 9)))
    return f"(({side('me')}) - ({side('op')}))"


def any_node(rule, first: int = 1, last: int = 0) -> str:
    """Whether a player's node passes; ``last`` nodes at the end are left out."""
    n = q.fresh("n")
    return f"exists(mine, {n} -> {n} >= {first} AND {n} <= element_at(mine, -1) - {2 * last} AND coalesce({rule(Node(n))}, false))"


def first_node(decides, answer, first: int = 1) -> str:
    """The answer at the first player's node that decides, false if none does."""
    n = q.fresh("n")
    found = f"get(filter(mine, {n} -> {n} >= {first} AND coalesce({decides(Node(n))}, false)), 0)"
    return q.let(found, lambda v: f"{v} IS NOT NULL AND coalesce({answer(Node(v))}, false)")


def _capture_colour(x: Node) -> str:
    return f"if({x.taken()} > 0, 0, 1)"


def _blocked(k_board: int, k_move: int):
    """A hanging piece is taken after a move cut the line of its (lowest) defender on an earlier board."""

    def rule(x: Node) -> str:
        v = q.fresh()
        defender = q.let(x.t(), lambda t: q.let(_capture_colour(x), lambda c: f"get(filter(sequence(0, 63), {v} -> {x.sees(k_board, c, v, t)}), 0)"))
        line = q.let(defender, lambda d: f"{d} > 0 AND abs({x.piece(k_board, d)}) IN {RAYS} AND {q.between(x.t(k_move), x.t(), d)}")
        other = f"{x.t()} <> {x.t(-1)} AND " if k_move == -2 else ""
        return f"{x.taken()} <> 0 AND {other}{x.has(0, 'hang', x.t())} AND {line}"

    return rule


def _attraction(x: Node) -> str:
    seen = x.sees(3, "me", x.t(2), x.t())
    return f"{x.t(1)} = {x.t()} AND {x.moved(1)} IN (4, 5, 6) AND {seen} AND ({x.moved(1)} = {K} OR coalesce({x.t(4)} = {x.t()}, false))"


def _deflection(x: Node) -> str:
    away = q.bit(x.attacks(-1, x.f(-1)), x.t())
    promoted = f"({x.at()}.promo > 0 AND {q.file(x.t())} = {q.file(x.f(-1))} AND {q.bit(x.attacks(-1, x.f(-1)), x.f())})"
    return f"""({x.taken()} <> 0 OR {x.at()}.promo > 0) AND NOT ({x.taken()} <> 0 AND {q.king_value(x.taken())} > {q.king_value(x.moved())})
      AND ({x.taken(-2)} = 0 OR {q.value(x.taken(-2))} < {x.moved(-2)}) AND {x.t()} <> {x.t(-1)} AND {x.t()} <> {x.t(-2)}
      AND ({x.t(-1)} = {x.t(-2)} OR {x.check(-1)}) AND ({away} OR {promoted}) AND NOT {q.bit(x.attacks(0, x.t(-1)), x.t())}"""


def _threatens_nothing(x: Node) -> str:
    return f"({x.attacks(1, x.t())} & {x.side(1, 'op')}) = 0 AND NOT {x.advanced_pawn(3, 4)}"


def _quiet(x: Node) -> str:
    return f"{x.n} < moves - 1 AND NOT {x.check(1)} AND NOT {x.check(0)} AND NOT {x.cap()} AND {_threatens_nothing(x)} AND {x.moved()} <> {K}"


def _defensive() -> str:
    x = Node("(moves - 1)")
    return f"({x.at()}.n_legal >= 3 AND NOT {x.check(1)} AND NOT {x.cap()} AND {_threatens_nothing(x)})"


def _check_escape() -> str:
    return first_node(lambda x: f"({x.check(1)} OR {x.cap()} OR {x.at()}.n_legal < 3 OR {x.check(0)})",
                      lambda x: f"NOT {x.check(1)} AND NOT {x.cap()} AND {x.at()}.n_legal >= 3")


def _sacrifice() -> str:
    down = any_node(lambda x: f"{balance(f'({x.n} + 1)')} - {balance('1')} <= -2", 3)
    return f"({down} AND NOT exists(filter(pos, (p, i) -> i >= 2 AND i % 2 = 0), p -> coalesce(p.promo, 0) > 0))"


def _x_ray(x: Node) -> str:
    return f"{x.cap()} AND {x.t(-1)} = {x.t()} AND {x.moved(-1)} <> {K} AND {x.t(-2)} = {x.t(-1)} AND {q.between(x.f(-1), x.f(), x.t())}"


def _fork(x: Node) -> str:
    dear = lambda s: f"{q.king_value(x.piece(1, s))} > {q.king_value(x.moved())}"
    free = lambda s: f"({x.has(1, 'hang', s)} AND NOT {x.sees(1, 'op', s, x.t())})"
    hit = q.count(f"({x.attacks(1, x.t())} & {x.side(1, 'op')})", lambda s: f"abs({x.piece(1, s)}) <> {P} AND ({dear(s)} OR {free(s)})")
    return f"{x.moved()} <> {K} AND NOT {x.has(1, 'bad', x.t())} AND {hit} > 1"


def _hanging() -> str:
    x = Node("1")
    traded = f"({x.taken(-1)} <> 0 AND {q.value(x.taken(-1))} >= {q.value(x.taken())} AND {x.t(-1)} = {x.t()})"
    return f"coalesce(abs({x.taken()}) > {P} AND {x.has(0, 'hang', x.t())} AND NOT {traded} AND (moves < 4 OR {balance('4')} >= {balance('2')}), false)"


def _trapped(x: Node) -> str:
    square = f"if({x.t(-1)} = {x.t()}, {x.f(-1)}, {x.t()})"
    return f"abs({x.taken()}) > {P} AND {x.has(-1, 'trapped', square)}"


def _discovered() -> str:
    by_check = any_node(lambda x: f"{x.check(1)} AND NOT {x.has(1, 'checkers', x.t())}")
    opened = lambda x: f"({q.between(x.f(-2), x.f(), x.t())} AND {x.t()} <> {x.t(-2)} AND {x.f()} <> {x.t(-2)} AND NOT {x.castled(-2)})"
    return f"({by_check} OR {first_node(lambda x: f'{x.cap()} AND ({x.t(-1)} = {x.t()} OR {opened(x)})', lambda x: f'{x.t(-1)} <> {x.t()}', 3)})"


def _exposed_king() -> str:
    # seen from White: a black player's board is turned over
    turn = lambda s: f"if(me = 0, {s}, ({s}) ^ 56)"
    king = turn("get(pos, 1).king[op]")

    def shield(k: str) -> str:
        near = f"concat(array({k} - 8), if({q.file(k)} > 0, array({k} - 1, {k} - 9), array()), if({q.file(k)} < 7, array({k} + 1, {k} - 7), array()))"
        return f"{q.rank(k)} >= 5 AND NOT exists({near}, s -> get(pos, 1).bd[{turn('s')}] = if(me = 0, -1, 1))"

    return f"({q.let(king, shield)} AND {any_node(lambda x: x.check(1), 3, 1)})"


def _skewer(x: Node) -> str:
    return f"""{x.taken()} <> 0 AND {x.moved()} IN {RAYS} AND NOT {x.mate(1)} AND {x.t(-1)} <> {x.t()} AND {q.between(x.f(-1), x.f(), x.t())}
      AND {q.king_value(x.moved(-1))} > {q.king_value(x.taken())} AND {x.has(0, 'bad', x.t())}"""


def _intermezzo() -> str:
    return first_node(
        lambda x: f"{x.cap()} AND NOT {x.sees(-1, 'op', x.f(-1), x.t())} AND {x.t(-2)} <> {x.t()}",
        lambda x: f"{x.t(-3)} = {x.t()} AND {x.cap(-3)} AND {x.can(-2, x.f(), x.t(), f'{x.at()}.promo')}", 3)


def _pinned(x: Node, test) -> str:
    v = q.fresh("z")
    return f"exists({x.at(1)}.pins, {v} -> {q.bit(x.side(1, 'op'), f'{v}.s')} AND ({test(v)}))"


def _pin_attack(x: Node) -> str:
    worth = lambda z, s: f"({q.value(x.piece(1, s))} > {q.value(x.piece(1, f'{z}.s'))} OR {x.has(1, 'hang', s)})"
    return _pinned(x, lambda z: q.some(f"({x.attacks(1, f'{z}.s')} & {x.side(1, 'me')} & ~{z}.line)", lambda s: worth(z, s)))


def _pin_escape(x: Node) -> str:
    def hit(z: str, s: str) -> str:
        stuck = f"({x.has(1, 'hang', f'{z}.s')} AND NOT {x.sees(1, 'op', f'{z}.s', s)} AND {z}.leaves)"
        return f"{q.value(x.piece(1, f'{z}.s'))} > {q.value(x.piece(1, s))} OR {stuck}"

    return _pinned(x, lambda z: q.some(f"({x.side(1, 'me')} & {z}.line)", lambda s: f"{x.sees(1, 'me', s, f'{z}.s')} AND ({hit(z, s)})"))


def _side_attack(corner_file: int, files: str, pieces: int) -> str:
    back, king = "(if(me = 0, 7, 0))", "get(pos, 1).king[op]"
    score = lambda x: f"(if({x.check(1)}, 1, 0) + CASE WHEN {x.cap()} AND {q.distance(f'({back} * 8 + {corner_file})', x.t())} <= 3 THEN 1 WHEN {q.distance(f'({back} * 8 + {corner_file})', x.t())} >= 5 THEN -1 ELSE 0 END)"
    return f"""({king} > 0 AND {q.rank(king)} = {back} AND {q.file(king)} IN {files}
      AND bit_count(get(pos, 1).side[0]) + bit_count(get(pos, 1).side[1]) >= {pieces}
      AND {any_node(lambda x: x.check(1))} AND aggregate(mine, 0, (a, n) -> a + {score(Node('n'))}) >= 2)"""


def _clearance(x: Node) -> str:
    return f"""{x.taken()} = 0 AND {x.moved()} IN {RAYS} AND {x.at(-2)}.promo = 0 AND {x.t(-2)} <> {x.f()} AND {x.t(-2)} <> {x.t()}
      AND NOT {x.check(0)} AND (NOT {x.check(1)} OR {x.moved(-1)} <> {K})
      AND ({x.f(-2)} = {x.t()} OR {q.between(x.f(-2), x.f(), x.t())}) AND ({x.taken(-2)} = 0 OR {x.has(-1, 'bad', x.t(-2))})"""


def _collinear(x: Node) -> str:
    def stays(s: str) -> str:
        straight = f"({q.rank(x.f())} = {q.rank(s)} OR {q.file(x.f())} = {q.file(s)})"
        kind = f"abs({x.piece(0, s)})"
        return f"""{kind} IN {RAYS} AND {q.collinear(x.f(), s, x.t())} AND NOT ({straight} AND {kind} = {B}) AND NOT (NOT {straight} AND {kind} = {R})
          AND {x.can(0, x.f(), s, '0')}"""

    return f"{x.moved()} IN {RAYS} AND NOT {x.cap()} AND {q.some(f'({x.attacks(0, x.f())} & {x.side(0, "op")})', stays)}"


def _capturing_defender(x: Node) -> str:
    wins = f"({x.taken()} <> 0 AND {x.moved()} <> {K} AND {q.value(x.taken())} <= {q.value(x.moved())} AND {x.has(0, 'hang', x.t())} AND {x.t(-1)} <> {x.t()})"
    defended = x.sees(-2, f"if({x.taken(-2)} > 0, 0, 1)", x.t(-2), x.t())
    return f"({x.mate(1)} OR {wins}) AND NOT {x.check(-1)} AND {x.t(-2)} <> {x.f()} AND {x.taken(-2)} <> 0 AND {defended} AND NOT {x.check(-2)}"


def _endgame(kind: int) -> str:
    one = lambda k: f"(get(pos, {k}).kind[{kind}] <> 0 AND ((get(pos, {k}).side[0] | get(pos, {k}).side[1]) & ~(get(pos, {k}).kind[1] | get(pos, {k}).kind[6] | get(pos, {k}).kind[{kind}])) = 0)"
    return f"({one(1)} AND {one(2)})"


def _queen_rook() -> str:
    one = lambda k: f"(bit_count(get(pos, {k}).kind[5]) = 1 AND get(pos, {k}).kind[4] <> 0 AND get(pos, {k}).kind[2] = 0 AND get(pos, {k}).kind[3] = 0)"
    return f"({one(1)} AND {one(2)})"


def _mates() -> list[tuple[str, str]]:
    """Named mates, first match wins; on the final board, with the mated king's square ``k``."""
    e, k, me, op = "element_at(pos, -1)", "element_at(pos, -1).king[op]", "element_at(pos, -1).side[me]", "element_at(pos, -1).side[op]"
    x = Node("(moves - 1)")
    t, kind = x.t(), x.moved()
    by = lambda s: attackers(e, me, s)
    back = "(if(me = 0, 7, 0))"
    front = f"filter(concat(array({k} + if(me = 0, -8, 8)), if({q.file(k)} < 7, array({k} + if(me = 0, -7, 9)), array()), if({q.file(k)} > 0, array({k} + if(me = 0, -9, 7)), array())), s -> s BETWEEN 0 AND 63)"
    step = f"if({q.file(k)} = 0, 1, -1)"
    edge = lambda v: f"{v} IN (0, 7)"
    near = q.distance(t, k)
    rook = f"{kind} = {R} AND {near} = 1"
    bishops = q.squares(f"({e}.kind[{B}] & {me})")
    around = f"({e}.at[{k}] | shiftleft(1L, {k}))"
    diagonal = f"bit_count({e}.kind[{B}] & {me}) >= 2 AND NOT {q.some(around, lambda s: f'({by(s)} & ~{e}.kind[{B}]) <> 0')}"
    split = f"({q.file(f'{bishops}[0]')} < {q.file(k)}) = ({q.file(f'get({bishops}, 1)')} > {q.file(k)})"
    escapes = q.some(f"({e}.at[{k}] & ~shiftleft(1L, {t}))", lambda s: f"if({by(s)} = shiftleft(1L, {t}), {e}.bd[{s}] <> 0, {by(s)} <> 0)")
    knight_near = lambda s: f"{e}.bd[{s}] = if(me = 0, {N}, -{N})"
    return [
        ("smotheredMate", f"({e}.checkers & {e}.kind[{N}]) <> 0 AND ({e}.at[{k}] & ~{op}) = 0"),
        ("backRankMate", f"{q.rank(k)} = {back} AND NOT exists({front}, s -> {e}.bd[s] = 0 OR {q.bit(me, 's')} OR {by('s')} <> 0) AND {q.some(f'{e}.checkers', lambda s: f'{q.rank(s)} = {back}')}"),
        ("anastasiaMate", f"{edge(q.file(k))} AND NOT {edge(q.rank(k))} AND {q.file(t)} = {q.file(k)} AND {kind} IN (4, 5) AND {q.bit(op, f'({k} + {step})')} AND {knight_near(f'({k} + 3 * {step})')}"),
        ("hookMate", f"{rook} AND {q.some(by(t), lambda s: f'abs({e}.bd[{s}]) = {N} AND {q.distance(s, k)} = 1 AND ({by(s)} & {e}.kind[{P}]) <> 0')}"),
        ("arabianMate", f"{edge(q.file(k))} AND {edge(q.rank(k))} AND {rook} AND {q.some(by(t), lambda s: f'abs({e}.bd[{s}]) = {N} AND abs({q.rank(s)} - {q.rank(k)}) = 2 AND abs({q.file(s)} - {q.file(k)}) = 2')}"),
        ("bodenMate", f"{diagonal} AND {split}"),
        ("doubleBishopMate", diagonal),
        ("dovetailMate", f"NOT {edge(q.file(k))} AND NOT {edge(q.rank(k))} AND {kind} = {Q} AND {q.file(t)} <> {q.file(k)} AND {q.rank(t)} <> {q.rank(k)} AND {near} <= 1 AND NOT {escapes}"),
    ]


def case(pairs: list[tuple[str, str]]) -> str:
    """The first tag whose rule holds, or null."""
    return "CASE " + " ".join(f"WHEN coalesce({rule}, false) THEN '{tag}'" for tag, rule in pairs) + " END"


def tag_columns() -> list[tuple[str, str]]:
    """(name, SQL of a tag or null) in the order in which tags are written."""
    mate = Node("moves").mate(0)
    f7 = first_node(lambda x: f"{x.taken()} <> 0 AND {x.t()} IN (13, 53)", lambda x: f"{x.piece(1, f'if({x.t()} = 53, 60, 4)')} = if(me = 0, -6, 6)")
    under = first_node(lambda x: f"{x.mate(1)} OR {x.at()}.promo > 0 AND {x.at()}.promo <> {Q}", lambda x: f"NOT {x.mate(1)} OR {x.at()}.promo = {N}")
    one = lambda tag, rule: (tag, case([(tag, rule)]))
    return [
        ("mateIn", case([(f"mateIn{i}", f"{mate} AND moves div 2 = {i}") for i in range(1, 5)] + [("mateIn5", mate)])),
        one("mate", mate),
        ("matePattern", f"if({mate}, {case(_mates())}, NULL)"),
        ("outcome", case([("", mate), ("crushing", "cp > 600"), ("advantage", "cp > 200"), ("equality", "true")])),
        one("attraction", any_node(_attraction)),
        one("deflection", any_node(_deflection, 3)),
        one("advancedPawn", any_node(lambda x: f"{x.advanced_pawn(2, 5)}")),
        one("doubleCheck", any_node(lambda x: f"bit_count({x.at(1)}.checkers) > 1")),
        one("quietMove", any_node(_quiet)),
        one("defensiveMove", f"{_defensive()} OR {_check_escape()}"),
        one("sacrifice", _sacrifice()),
        one("xRayAttack", any_node(_x_ray, 3)),
        one("fork", any_node(_fork, 1, 1)),
        one("hangingPiece", _hanging()),
        one("trappedPiece", any_node(_trapped, 3)),
        one("discoveredAttack", _discovered()),
        one("exposedKing", _exposed_king()),
        one("skewer", any_node(_skewer, 3)),
        one("collinear", any_node(_collinear)),
        one("interference", f"{any_node(_blocked(-1, -1), 3)} OR {any_node(_blocked(-2, -2), 3)}"),
        one("intermezzo", _intermezzo()),
        one("pin", f"{any_node(_pin_attack)} OR {any_node(_pin_escape)}"),
        one("attackingF2F7", f7),
        one("clearance", any_node(_clearance, 3)),
        one("enPassant", any_node(lambda x: f"{x.moved()} = {P} AND {q.file(x.f())} <> {q.file(x.t())} AND {x.taken()} = 0")),
        one("castling", any_node(lambda x: x.castled())),
        one("promotion", any_node(lambda x: f"{x.at()}.promo > 0")),
        one("underPromotion", under),
        one("capturingDefender", any_node(_capturing_defender, 3)),
        ("endgame", case([("pawnEndgame", _endgame(P)), ("queenEndgame", _endgame(Q)), ("rookEndgame", _endgame(R)), ("bishopEndgame", _endgame(B)), ("knightEndgame", _endgame(N)), ("queenRookEndgame", _queen_rook())])),
        ("sideAttack", case([("kingsideAttack", _side_attack(7, "(6, 7)", 20)), ("queensideAttack", _side_attack(0, "(0, 1, 2)", 18))])),
        ("length", case([("oneMove", "moves = 2"), ("short", "moves = 4"), ("veryLong", "moves >= 8"), ("long", "true")])),
    ]


def seen() -> str:
    """SQL of the positions of ``game`` with what rules look at, and no more where that is costly; needs rays.

    On the player's boards (odd), pieces in a bad spot are only asked for on the target of the move, legal moves always. On
    the others, hanging pieces where they are attacked, pieces in a bad spot on the target of the last move, those without a way out where the next move takes more than a pawn, and
    moves if there is a check, a pin or such a piece, or only one move follows.
    """
    square = lambda s: f"coalesce({bit(s)}, 0L)"
    after = "get(game.raw, i + 1)"
    left = f"if(p.t = {after}.t, p.f, {after}.t)"
    takes = f"(i >= 2 AND coalesce(upper({after}.taken) IN ('N', 'B', 'R', 'Q', 'K'), false))"
    last = "i = size(game.raw) - 2"  # the rule of a defensive move counts moves here, even if the line ends with the opponent's
    none = lambda kind: f"cast(array() AS array<struct<{kind}>>)"
    mine = {"alone": f"({STEPS['alone']} & {square('p.t')})", "hit": f"({STEPS['hit']} & {square('p.t')})", "trapped": "0L", "pins": none("s:int,line:bigint,leaves:boolean")}
    theirs = {
        "alone": f"({STEPS['alone']} & (($W & $attacks_b) | ($X & $attacks_w)))",
        "hit": f"({STEPS['hit']} & ({square('get(game.raw, i - 1).t')} | if({takes}, {square(left)}, 0L)))", "suspects": f"if({takes}, {STEPS['suspects']} & {square(left)}, 0L)",
        "epinned": "(" + " | ".join(f"$epin_{d}" for d in DIRECTIONS) + ")",
        "pseudo": f"if({last} OR ($checkers | $suspects | $pinned | $epinned) <> 0L, {STEPS['pseudo']}, {none('s:int,k:int,to:bigint,ep:bigint')})", "castle_to": f"if({last}, {STEPS['castle_to']}, {none('f:int,t:int')})",
    }
    fields = {n: n for n in SEEN}
    return f"transform(game.raw, (p, i) -> if(i % 2 = 1, {inside('p', fields, mine)}, {inside('p', fields, theirs)}))"


def tag_games(games: DataFrame) -> DataFrame:
    """PuzzleId, cp, tags, error from rows of PuzzleId, cp and ``game``; a puzzle that fails (see WHY) has an error and no tags."""
    rows = games.selectExpr("PuzzleId", "cp", f"{WHY} AS error", "game", f"{tables()} AS rays")
    # rules are only looked at where there is no error; one expression, so that positions are not turned into binary rows
    found = "named_struct(" + ", ".join(f"'{name}', {sql}" for name, sql in tag_columns()) + ")"
    for name, value in (("op", "1 - me"), ("me", "if(get(pos, 1).white, 0, 1)"), ("mine", "filter(sequence(0, greatest(moves - 1, 0)), n -> n % 2 = 1)"), ("moves", "size(pos) - 1"), ("pos", seen())):
        found = q.bind(value, name, found)
    found = rows.selectExpr("PuzzleId", "cp", "error", f"if(error IS NULL, {found}, NULL) AS found").select("PuzzleId", "cp", "error", "found.*")
    lone = "if(matePattern <=> 'backRankMate' OR fork IS NOT NULL, NULL, sideAttack)"
    listed = F.expr("filter(array_compact(array(" + ", ".join(lone if n == "sideAttack" else n for n, _ in tag_columns()) + ")), t -> t <> '')")
    return found.select("PuzzleId", F.when(F.col("error").isNull(), F.col("cp").cast("int")).alias("cp"), listed.alias("tags"), "error")


def tag(puzzles: DataFrame, evals: DataFrame | None = None) -> DataFrame:
    """PuzzleId, cp, Themes, error: the tagging job. ``evals`` has (PuzzleId, cp); else puzzles has cp.

    The evaluation is taken as given: which position and which side it speaks of is the caller's.
    """
    if evals is not None:
        cp = evals.groupBy(F.col("PuzzleId").cast("string").alias("PuzzleId")).agg(F.min("cp").alias("cp"))
        puzzles = puzzles.select(F.col("PuzzleId").cast("string").alias("PuzzleId"), "FEN", "Moves").join(cp, "PuzzleId", "left")
    return tag_games(whole_games(puzzles, ["cp"])).select("PuzzleId", "cp", F.array_join("tags", " ").alias("Themes"), "error")
