"""Boards as 64-bit masks, and what the rules make of them, as column expressions.

Bit 0 is a1 and bit 63 is h8. Lines of sight come from constant tables of rays: the squares a slider
sees are its ray without the ray of the first piece on it. Nothing here tries a move on a board:
legality follows from the pieces that give check and from those that are pinned, checks from the rays
of the other king and the pieces that hide it.

``STEPS`` names intermediate values, ``$name`` refers to one. ``columns`` makes each a column, in as few
projections as their order allows, so that generated code computes it once; ``inside`` makes the same
values of one element within a higher-order function.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame

from .sqltext import bind, once

PAWN, KNIGHT, BISHOP, ROOK, QUEEN, KING = range(1, 7)
PIECES = ".PNBRQKpnbrqk"
#: Steps of file and rank in each direction; along the first four the squares' numbers grow.
DIRECTIONS = {"n": (0, 1), "e": (1, 0), "ne": (1, 1), "nw": (-1, 1), "s": (0, -1), "w": (-1, 0), "sw": (-1, -1), "se": (1, -1)}
OPPOSITE = {"n": "s", "e": "w", "ne": "sw", "nw": "se", "s": "n", "w": "e", "sw": "ne", "se": "nw"}
GROWING, STRAIGHT, DIAGONAL = ("n", "e", "ne", "nw"), ("n", "e", "s", "w"), ("ne", "nw", "sw", "se")
NONE = 64  # the square of what is not there: tables hold an empty mask for it
CASTLES = {"K": (4, 6, 7, 5), "Q": (4, 2, 0, 3), "k": (60, 62, 63, 61), "q": (60, 58, 56, 59)}  # king from, to, rook from, to
MOST = (1 << 63) - 1


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _table(steps: Iterable[tuple[int, int]], far: bool = False, only=lambda s: True) -> str:
    """SQL array of the squares reached from each square by the steps, once or to the edge."""
    masks = []
    for s in range(64):
        mask = 0
        for df, dr in steps if only(s) else ():
            f, r = s % 8 + df, s // 8 + dr
            while 0 <= f < 8 and 0 <= r < 8:
                mask |= 1 << (r * 8 + f)
                if not far:
                    break
                f, r = f + df, r + dr
        masks.append(_signed(mask))
    return "array(" + ", ".join(f"{m}L" if m > -(1 << 63) else f"(-{MOST}L - 1L)" for m in [*masks, 0]) + ")"


def tables() -> str:
    """SQL struct of all rays, leaps and pawn steps."""
    leaps = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]
    found = {d: _table([step], True) for d, step in DIRECTIONS.items()}
    found |= {"knight": _table(leaps), "king": _table(DIRECTIONS.values()), "pawn_w": _table([(-1, 1), (1, 1)]), "pawn_b": _table([(-1, -1), (1, -1)])}
    found |= {"push_w": _table([(0, 1)]), "push_b": _table([(0, -1)]), "jump_w": _table([(0, 2)], only=lambda s: s // 8 == 1), "jump_b": _table([(0, -2)], only=lambda s: s // 8 == 6)}
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in found.items()) + ")"


# --- pieces of expressions ------------------------------------------------------------------------


def bit(square: str) -> str:
    return f"shiftleft(1L, {square})"


def lowest(mask: str) -> str:
    """The lowest square of a mask, NONE if it is empty."""
    return f"bit_count(~{mask} & (({mask} & {MOST}L) - 1L))"


def highest(mask: str) -> str:
    """The highest square of a mask; 0 if it is empty, which has no ray against the numbers' order."""
    return f"(length(bin({mask})) - 1)"


def first_on(ray: str, occupied: str, d: str) -> str:
    seen = f"({ray} & {occupied})"
    return lowest(seen) if d in GROWING else highest(seen)


def sight(d: str, square: str, occupied: str) -> str:
    """What a slider on a square sees in a direction, the first piece included."""
    ray = f"get(rays.{d}, {square})"
    return f"({ray} ^ get(rays.{d}, {first_on(ray, occupied, d)}))"


def lines(directions: Iterable[str], square: str, occupied: str) -> str:
    return "(" + " | ".join(sight(d, square, occupied) for d in directions) + ")"


def attackers(square: str, occupied: str) -> str:
    """All pieces of both sides that attack a square; sliders are only looked for on lines that hold one."""
    leapers = f"(get(rays.knight, {square}) & $N) | (get(rays.king, {square}) & $K) | (get(rays.pawn_b, {square}) & $P & $W) | (get(rays.pawn_w, {square}) & $P & $X)"
    sliders = []
    for d in DIRECTIONS:
        kind = "$diagonal" if d in DIAGONAL else "$straight"
        sliders.append(f"if((get(rays.{d}, {square}) & {kind}) = 0L, 0L, {sight(d, square, occupied)} & {kind})")
    return f"({leapers} | {' | '.join(sliders)})"


def squares(mask: str, v: str) -> str:
    return once(mask, lambda m: f"filter(sequence(0, 63), {v} -> getbit({m}, {v}) = 1)")


def men_of(mask: str, v: str) -> str:
    """Squares of a mask of men: only those of the board are looked through."""
    return once(mask, lambda m: f"filter($men, {v} -> getbit({m}, {v}) = 1)")


def union(parts: Iterable[str]) -> str:
    return "(" + " | ".join(parts) + ")"


def _slides(d: str) -> str:
    return "$diagonal" if d in DIAGONAL else "$straight"


def _codes() -> str:
    """SQL array of the number of a piece for each character: by look-up, as searches in strings cost far more."""
    codes = {c: (k if k < 7 else 6 - k) for k, c in enumerate(PIECES)}
    return "array(" + ", ".join(str(codes.get(chr(k), 0)) for k in range(128)) + ")"


def _marks() -> str:
    """The men as four masks: the binary digits of their kinds, and the white ones."""
    digit = lambda k: f"'k{k}', a.k{k} | shiftleft(cast(shiftright(abs(c), {k}) & 1 AS bigint), s)"
    added = f"named_struct({', '.join(digit(k) for k in range(3))}, 'w', a.w | if(c > 0, {bit('s')}, 0L))"
    return f"aggregate($men, named_struct('k0', 0L, 'k1', 0L, 'k2', 0L, 'w', 0L), (a, s) -> {bind('get($bd, s)', 'c', added)})"


def _plus_one(planes: str, x: str) -> str:
    """Adds one to the count of every square of ``x``: the counts' binary digits are five masks."""
    out = [f"{planes}.d0 ^ {x}"]
    for k in range(1, 5):
        out.append(f"{planes}.d{k} ^ ({' & '.join(f'{planes}.d{j}' for j in range(k))} & {x})")
    return "named_struct(" + ", ".join(f"'d{k}', {e}" for k, e in enumerate(out)) + ")"


_ZERO = "named_struct('d0', 0L, 'd1', 0L, 'd2', 0L, 'd3', 0L, 'd4', 0L)"


def _slider_check(king: str, occupied: str, own: str, straight: str = "$straight") -> str:
    """Whether a slider of ``own`` sees the king's square."""
    return f"(({lines(STRAIGHT, king, occupied)} & {straight} & {own}) | ({lines(DIAGONAL, king, occupied)} & $diagonal & {own})) <> 0L"


def _checks(kind: str) -> str:
    """Targets with which a piece of a kind (the mover ``m``'s or what a pawn becomes) gives check."""
    return f"(get($direct, {kind}) | m.open | if({kind} IN ({BISHOP}, {QUEEN}), m.dd, 0L) | if({kind} IN ({ROOK}, {QUEEN}), m.ds, 0L))"


def _still(square: str) -> str:
    """Targets with which the piece on a square leaves another's check in place."""
    leap = f"if(($already & ($P | $N | $K) & ~{bit(square)}) <> 0L, -1L, 0L)"
    return f"if($already = 0L, 0L, {leap} | {union(f'if(($e_{d} & {_slides(d)} & $own & ~{bit(square)}) <> 0L, ~$e_{d}, 0L)' for d in DIRECTIONS)})"


def _may_castle(right: str) -> str:
    king, to, rook, rook_to = CASTLES[right]
    way = sum(1 << s for s in range(min(king, rook) + 1, max(king, rook)))
    safe = _signed(1 << king | 1 << rook_to | 1 << to)
    return f"{'' if right.isupper() else 'NOT '}$white AND $rights[{'KQkq'.index(right)}] AND ($occ & {_signed(way)}L) = 0L AND ($opp_attacks & {safe}L) = 0L"


def _castle(right: str) -> str:
    """A castling move if it is legal, else null."""
    king, to, rook, rook_to = CASTLES[right]
    after = f"($occ ^ {_signed(1 << king ^ 1 << to ^ 1 << rook ^ 1 << rook_to)}L)"
    rooks = _signed(1 << rook | 1 << rook_to)
    check = "($already & ($P | $N)) <> 0L OR " + _slider_check("$es", after, f"($own ^ {rooks}L)", f"($straight ^ {rooks}L)")
    return f"if({_may_castle(right)}, named_struct('f', {king}, 't', {to}, 'promo', 0, 'cap', false, 'chk', {check}), NULL)"


def _steps() -> dict[str, str]:
    s: dict[str, str] = {"bd": f"transform(split($board, ''), c -> get({_codes()}, ascii(c)))", "men": "filter(sequence(0, 63), s -> get($bd, s) <> 0)", "marks": _marks()}
    for name, kind in zip("PNBRQK", range(1, 7), strict=True):
        s[name] = "(" + " & ".join(("" if kind >> k & 1 else "~") + f"$marks.k{k}" for k in range(3)) + ")"
    s |= {"W": "$marks.w", "occ": "($marks.k0 | $marks.k1 | $marks.k2)"}
    s |= {
        "X": "($occ ^ $W)", "own": "if($white, $W, $X)", "opp": "if($white, $X, $W)", "diagonal": "($B | $Q)", "straight": "($R | $Q)",
        "side": "array($W, $X)", "kind": "array(0L, $P, $N, $B, $R, $Q, $K)",
        "wk": lowest("($K & $W)"), "bk": lowest("($K & $X)"), "ks": "if($white, $wk, $bk)", "es": "if($white, $bk, $wk)",
        "king": f"array(if($wk = {NONE}, -1, $wk), if($bk = {NONE}, -1, $bk))",
        "rights": "array(" + ", ".join(f"contains($castling, '{r}') AND substr($board, {k + 1}, 1) = '{'K' if r.isupper() else 'k'}' AND substr($board, {rook + 1}, 1) = '{'R' if r.isupper() else 'r'}'" for r, (k, _, rook, _) in CASTLES.items()) + ")",
        # the squares that the piece on each square attacks
        "at": f"""transform($bd, (c, s) -> if(c = 0, 0L, CASE abs(c) WHEN {PAWN} THEN if(c > 0, get(rays.pawn_w, s), get(rays.pawn_b, s)) WHEN {KNIGHT} THEN get(rays.knight, s) WHEN {KING} THEN get(rays.king, s)
          WHEN {BISHOP} THEN {lines(DIAGONAL, 's', '$occ')} WHEN {ROOK} THEN {lines(STRAIGHT, 's', '$occ')} ELSE {lines(DIRECTIONS, 's', '$occ')} END))""",
        # how many pieces of a side attack each square
        "hits_w": f"aggregate(transform({men_of('$W', 's')}, s -> get($at, s)), {_ZERO}, (h, x) -> {_plus_one('h', 'x')})",
        "hits_b": f"aggregate(transform({men_of('$X', 's')}, s -> get($at, s)), {_ZERO}, (h, x) -> {_plus_one('h', 'x')})",
        "attacks_w": f"aggregate({men_of('$W', 's')}, 0L, (a, s) -> a | get($at, s))", "attacks_b": f"aggregate({men_of('$X', 's')}, 0L, (a, s) -> a | get($at, s))", "opp_attacks": "if($white, $attacks_b, $attacks_w)",
    }
    for d in DIRECTIONS:  # from the own king (k_) and from the other (e_): the line, and a piece that hides it from a slider behind
        s |= {f"k_{d}": sight(d, "$ks", "$occ"), f"e_{d}": sight(d, "$es", "$occ"), f"kq_{d}": lowest(f"($k_{d} & $own)"), f"eo_{d}": lowest(f"($e_{d} & $own)"), f"ex_{d}": lowest(f"($e_{d} & $opp)")}
        s[f"pin_{d}"] = f"if(({sight(d, f'$kq_{d}', '$occ')} & {_slides(d)} & $opp) <> 0L, $k_{d} & $own, 0L)"
        s[f"veil_{d}"] = f"if(({sight(d, f'$eo_{d}', '$occ')} & {_slides(d)} & $own) <> 0L, $e_{d} & $own, 0L)"
        s[f"epin_{d}"] = f"if(({sight(d, f'$ex_{d}', '$occ')} & {_slides(d)} & $own) <> 0L, $e_{d} & $opp, 0L)"
    pawn_of = lambda light, square: f"if({light}, get(rays.pawn_w, {square}), get(rays.pawn_b, {square}))"
    s |= {
        "checkers": f"(((get(rays.knight, $ks) & $N) | (get(rays.king, $ks) & $K) | ({pawn_of('$white', '$ks')} & $P) | {union(f'($k_{d} & {_slides(d)})' for d in DIRECTIONS)}) & $opp)",
        "to": f"CASE bit_count($checkers) WHEN 0 THEN -1L WHEN 1 THEN $checkers | {union(f'if(($k_{d} & $checkers & {_slides(d)}) <> 0L, $k_{d}, 0L)' for d in DIRECTIONS)} ELSE 0L END",
        "pinned": union(f"$pin_{d}" for d in DIRECTIONS), "veils": union(f"$veil_{d}" for d in DIRECTIONS),
        # squares behind the own king on the line of a checking slider
        "behind": union(f"if(($k_{d} & $checkers & {_slides(d)}) <> 0L, get(rays.{OPPOSITE[d]}, $ks), 0L)" for d in DIRECTIONS),
        "king_to": "(get(rays.king, $ks) & ~$own & ~($opp_attacks | $behind))",
        "push": "if($white, rays.push_w, rays.push_b)", "jump": "if($white, rays.jump_w, rays.jump_b)",
        "ep_bit": f"if($ep >= 0, {bit('greatest($ep, 0)')} & ~$occ, 0L)", "ep_taken": f"if($ep >= 0, {bit('(greatest($ep, 8) + if($white, -8, 8))')}, 0L)",
        # (square, kind, targets) of the own pieces, without regard to the king; en passant apart
        "pseudo": f"""transform({men_of('$own', 's')}, s -> named_struct('s', s, 'k', abs(get($bd, s)), 'to', CASE abs(get($bd, s))
          WHEN {PAWN} THEN (get($at, s) & $opp) | (get($push, s) & ~$occ) | if((get($push, s) & ~$occ) <> 0L, get($jump, s) & ~$occ, 0L) ELSE get($at, s) & ~$own END,
          'ep', if(abs(get($bd, s)) = {PAWN} AND s div 8 = if($white, 4, 3), get($at, s) & $ep_bit, 0L)))""",
        "dn": "get(rays.knight, $es)", "dp": pawn_of("NOT $white", "$es"), "dd": union(f"$e_{d}" for d in DIAGONAL), "ds": union(f"$e_{d}" for d in STRAIGHT),
        # squares from which a piece of each kind gives check; own pieces that stand on lines of the other king
        "direct": "array(0L, $dp, $dn, $dd, $ds, $dd | $ds, 0L)", "on_line": "(($dd | $ds) & $own)",
        # own pieces that attack the other king before the move: none where the rules were kept
        "already": f"((($dn & $N) | ($dp & $P) | (get(rays.king, $es) & $K) | {union(f'($e_{d} & {_slides(d)})' for d in DIRECTIONS)}) & $own)",
        # the squares that legality leaves ('ep': en passant), castling apart
        "reach": f"""filter(transform($pseudo, m -> named_struct('s', m.s, 'k', m.k,
          'to', if(m.k = {KING}, $king_to, m.to & $to & if(getbit($pinned, m.s) = 0, -1L, {union(f'if(getbit($pin_{d}, m.s) = 1, get(rays.{d}, $ks), 0L)' for d in DIRECTIONS)})),
          'ep', if(m.ep <> 0L AND ({attackers('$ks', f"(($occ & ~({bit('m.s')} | $ep_taken)) | m.ep)")} & $opp & ~$ep_taken) = 0L, m.ep, 0L))), m -> (m.to | m.ep) <> 0L)""",
        "n_legal": f"(aggregate($reach, 0, (a, m) -> a + bit_count(m.to | m.ep) + if(m.k = {PAWN}, 3 * bit_count(m.to & {_signed(255 | 255 << 56)}L), 0)) + size($castle_to))",
        "castle_to": f"array_compact(array({', '.join(f"if({_may_castle(r)}, named_struct('f', {k}, 't', {to}), NULL)" for r, (k, to, _, _) in CASTLES.items())}))",
        # besides, those that keep a veil shut, those beyond the piece on a line of the other king
        "limits": f"""transform($reach, m -> named_struct('s', m.s, 'k', m.k, 'to', m.to, 'ep', m.ep,
          'open', {_still('m.s')} | if(getbit($veils, m.s) = 0, 0L, ~{union(f'if(getbit($veil_{d}, m.s) = 1, get(rays.{d}, $es), 0L)' for d in DIRECTIONS)}),
          'dd', if(getbit($on_line, m.s) = 0, 0L, {union(f'if(getbit($e_{d}, m.s) = 1, get(rays.{d}, m.s), 0L)' for d in DIAGONAL)}),
          'ds', if(getbit($on_line, m.s) = 0, 0L, {union(f'if(getbit($e_{d}, m.s) = 1, get(rays.{d}, m.s), 0L)' for d in STRAIGHT)})))""",
        # legal moves as masks, castling apart: all targets, of them captures, promotions, checks (promotions: for each new piece)
        "able": f"""transform($limits, m -> named_struct('s', m.s, 'k', m.k, 'all', m.to | m.ep, 'ep', m.ep, 'cap', (m.to & $opp) | m.ep,
          'promo', if(m.k = {PAWN}, m.to & {_signed(255 | 255 << 56)}L, 0L),
          'chk', (m.to & {_checks('m.k')} & if(m.k = {PAWN}, {_signed(~(255 | 255 << 56) & (1 << 64) - 1)}L, -1L))
            | if(m.ep <> 0L AND ((m.ep & $dp) <> 0L OR ($already & ($P | $N | $K) & ~{bit('m.s')}) <> 0L OR {_slider_check('$es', f"(($occ & ~({bit('m.s')} | $ep_taken)) | m.ep)", '$own')}), m.ep, 0L),
          'new', if(m.k = {PAWN} AND (m.to & {_signed(255 | 255 << 56)}L) <> 0L, transform(array({QUEEN}, {ROOK}, {BISHOP}, {KNIGHT}), q -> named_struct('q', q, 'chk', m.to & {_checks('q')})), NULL)))""",
        "castles": f"array_compact(array({', '.join(_castle(r) for r in CASTLES)}))",
        "legal": f"""concat(flatten(transform($able, m -> concat(
          transform({squares('(m.all & ~m.promo)', 't')}, t -> named_struct('f', m.s, 't', t, 'promo', 0, 'cap', getbit(m.cap, t) = 1, 'chk', getbit(m.chk, t) = 1)),
          if(m.promo = 0L, array(), flatten(transform(m.new, w -> transform({squares('m.promo', 't')}, t -> named_struct('f', m.s, 't', t, 'promo', w.q, 'cap', getbit(m.cap, t) = 1, 'chk', getbit(w.chk, t) = 1)))))))), $castles)""",
        "has_ep": "exists($able, m -> m.ep <> 0L)",
        "zone": f"array(if($wk = {NONE}, 0L, get(rays.king, $wk) | {bit('$wk')}), if($bk = {NONE}, 0L, get(rays.king, $bk) | {bit('$bk')}))", "attacked": "array($attacks_w, $attacks_b)",
        # for themes: who attacks each square, pieces without a defender, in a bad spot, without a way out; pins of both sides
        "by": f"transform(sequence(0, 63), s -> {attackers('s', '$occ')})",
        "alone": "(($W & ~$attacks_w) | ($X & ~$attacks_b))",
        "hang": f"""aggregate({men_of('$alone', 's')}, 0L, (a, s) -> a | {bind(f"{attackers('s', '$occ')} & if(getbit($W, s) = 1, $X, $W)", "y", f"""if(({attackers('s', "($occ & ~(y & ($diagonal | $straight)))")}
          & if(getbit($W, s) = 1, $W, $X)) = 0L, {bit('s')}, 0L)""")})""",
        "cheaper": "array(0L, 0L, $P, $P, $P | $N | $B, $P | $N | $B | $R, 0L)",
        "hit": "((($W & $attacks_b) | ($X & $attacks_w)) & ~$K)",
        "bad": f"""aggregate({men_of('$hit', 's')}, 0L, (a, s) -> a | if(getbit($hang, s) = 1
          OR ({attackers('s', '$occ')} & if(getbit($W, s) = 1, $X, $W) & get($cheaper, abs(get($bd, s)))) <> 0L, {bit('s')}, 0L))""",
        "suspects": "if($checkers = 0L, $bad & $own & ~($P | $K | $pinned), 0L)",
    }
    gone, there = bit("s"), bit("t")
    after = f"(($occ & ~{gone}) | {there})"
    value = lambda square: f"get(array(0, 1, 3, 3, 5, 9, 0), abs(get($bd, {square})))"
    # attackers and defenders of a piece that has gone to t; with the attacking sliders taken off the lines
    seen, through = attackers("t", after), attackers("t", f"({after} & ~(z.a & $opp & ($diagonal | $straight)))")
    bad_there = bind(f"named_struct('a', {seen})", "z", f"""(z.a & $opp & ~{there}) <> 0L AND ((z.a & $opp & ~{there} & get($cheaper, abs(get($bd, s)))) <> 0L
      OR ((z.a & $own & ~{gone}) = 0L AND ({through} & $own & ~{gone} & ~(z.a & $opp)) = 0L))""")
    s["trapped"] = f"""aggregate({men_of('$suspects', 's')}, 0L, (a, s) -> a | if(exists($reach, m -> m.s = s AND exists({squares('m.to', 't')}, t -> (get($bd, t) <> 0 AND {value('t')} >= {value('s')}) OR NOT {bad_there})), 0L, {bit('s')}))"""
    line = lambda d, king: f"(get(rays.{d}, {king}) | get(rays.{OPPOSITE[d]}, {king}) | {bit(king)})"
    pins = [f"if($pin_{d} = 0L, NULL, named_struct('s', $kq_{d}, 'line', {line(d, '$ks')}))" for d in DIRECTIONS]
    pins += [f"if($epin_{d} = 0L, NULL, named_struct('s', $ex_{d}, 'line', {line(d, '$es')}))" for d in DIRECTIONS]
    s["pins"] = f"transform(array_compact(array({', '.join(pins)})), y -> named_struct('s', y.s, 'line', y.line, 'leaves', exists($pseudo, m -> m.s = y.s AND ((m.to | m.ep) & ~y.line) <> 0L)))"
    return s


#: What a replayed position gives: side to move, the board as 64 letters, letters of castling rights, the square
#: behind a double push (-1: none), and the move that is played there, with the letter on its
#: target; moves since a capture or a pawn's move, and the number of the move.
GIVEN = ("white", "board", "castling", "ep", "f", "t", "promo", "cap", "taken", "half", "full")
STEPS = _steps()
_NAME = re.compile(r"\$(\w+)")


def _uses(sql: str) -> set[str]:
    return set(_NAME.findall(sql)) - set(GIVEN)


def _levels(wanted: Iterable[str], steps: dict[str, str] = STEPS) -> dict[str, int]:
    """Of every needed step, after how many others it can come."""
    level: dict[str, int] = {}

    def of(name: str) -> int:
        if name not in level:
            level[name] = 1 + max((of(x) for x in _uses(steps[name])), default=0)
        return level[name]

    for name in wanted:
        of(name)
    return level


def _once(sql: str, column) -> str:
    """``sql`` over columns. What functions of arrays use is bound outside them: the optimiser may put a column's
    expression in its place, and it would be computed for every element."""
    if "->" not in sql:
        return _NAME.sub(lambda m: column(m[1]), sql)
    bound = ", ".join(f"'{n}', {column(n)}" for n in dict.fromkeys(_NAME.findall(sql)))
    return bind(f"named_struct({bound})", "o", _NAME.sub(lambda m: f"o.{m[1]}", sql))


def columns(nodes: DataFrame, wanted: Iterable[str], given: str = "p", prefix: str = "b_") -> DataFrame:
    """``nodes`` (with a struct ``given`` of GIVEN) and a column ``prefix`` + name for every wanted step."""
    wanted = [w for w in wanted if w not in GIVEN]
    level = _levels(wanted)
    kept = nodes.columns
    nodes = nodes.selectExpr("*", f"{tables()} AS rays")
    column = lambda name: f"{given}.{name}" if name in GIVEN else prefix + name
    for k in range(1, max(level.values(), default=0) + 1):
        later = {x for n, at in level.items() if at > k for x in _uses(STEPS[n])} | set(wanted)
        old = [prefix + n for n, at in level.items() if at < k and n in later]
        nodes = nodes.selectExpr(*[f"`{c}`" for c in kept], "rays", *old, *[f"{_once(STEPS[n], column)} AS {prefix}{n}" for n, at in level.items() if at == k])
    return nodes.drop("rays")


def inside(p: str, fields: dict[str, str], instead: dict[str, str] | None = None) -> str:
    """SQL struct of ``fields`` (name -> step or given value) of the position ``p``, within a function of an array; needs rays.
    ``instead`` has other SQL for some steps, of the same type."""
    steps = STEPS | (instead or {})
    level = _levels((n for n in fields.values() if n not in GIVEN), steps)
    name = lambda m: f"{p}.{m[1]}" if m[1] in GIVEN else f"v{level[m[1]]}.{m[1]}"
    out = "named_struct(" + ", ".join(f"'{k}', {name(_NAME.match('$' + n))}" for k, n in fields.items()) + ")"
    for k in range(max(level.values(), default=0), 0, -1):
        made = ", ".join(f"'{n}', {_NAME.sub(name, steps[n])}" for n, at in level.items() if at == k)
        out = bind(f"named_struct({made})", f"v{k}", out)
    return out
