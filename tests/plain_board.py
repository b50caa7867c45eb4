"""The board helper: attacks, checks, pins and legal moves of one position, as bitboards.

Square 0 is a1 and 63 is h8. A piece is 1 to 6 for pawn, knight, bishop, rook, queen, king; black
pieces are negative. Everything that rules and features are made of is an expression over the rows
that ``replay`` writes; this module only supplies what needs legality and lines of sight.
"""

from __future__ import annotations

import re

PAWN, KNIGHT, BISHOP, ROOK, QUEEN, KING = range(1, 7)
VALUE = (0, 1, 3, 3, 5, 9, 0)
LETTERS = "PNBRQK"
ROOK_LINES, BISHOP_LINES = ((0, 1), (1, 0), (0, -1), (-1, 0)), ((1, 1), (1, -1), (-1, -1), (-1, 1))


def _walk(square: int, steps, most: int) -> list[list[int]]:
    """Squares met from ``square`` in each direction, nearest first."""
    out = []
    for df, dr in steps:
        f, r, line = square % 8 + df, square // 8 + dr, []
        while 0 <= f < 8 and 0 <= r < 8 and len(line) < most:
            line.append(r * 8 + f)
            f, r = f + df, r + dr
        if line:
            out.append(line)
    return out


LEAPS = [(a, b) for a in (-2, -1, 1, 2) for b in (-2, -1, 1, 2) if abs(a) != abs(b)]
LINES = {
    KNIGHT: [_walk(s, LEAPS, 1) for s in range(64)],
    BISHOP: [_walk(s, BISHOP_LINES, 8) for s in range(64)],
    ROOK: [_walk(s, ROOK_LINES, 8) for s in range(64)],
    QUEEN: [_walk(s, ROOK_LINES + BISHOP_LINES, 8) for s in range(64)],
    KING: [_walk(s, ROOK_LINES + BISHOP_LINES, 1) for s in range(64)],
    PAWN: [_walk(s, ((-1, 1), (1, 1)), 1) for s in range(64)],
    -PAWN: [_walk(s, ((-1, -1), (1, -1)), 1) for s in range(64)],
}
CASTLES = {"K": (4, 6, 7, 5), "Q": (4, 2, 0, 3), "k": (60, 62, 63, 61), "q": (60, 58, 56, 59)}  # king from, to, rook from, to


def lines_of(piece: int, square: int) -> list[list[int]]:
    return LINES[piece if abs(piece) == PAWN else abs(piece)][square]


def full_line(a: int, b: int) -> int:
    """All squares of the line through two squares, edge to edge; 0 if they share none."""
    for pair in (((0, 1), (0, -1)), ((1, 0), (-1, 0)), ((1, 1), (-1, -1)), ((1, -1), (-1, 1))):
        squares = [a, *(s for line in _walk(a, pair, 8) for s in line)]
        if b in squares:
            return sum(1 << s for s in squares)
    return 0


class Position:
    """A board with side to move (1 or -1), castling rights and the square behind a double push."""

    def __init__(self, board: list[int], turn: int, rights: frozenset[str], ep: int | None):
        self.board, self.turn, self.rights, self.ep = board, turn, rights, ep

    @classmethod
    def from_fen(cls, fen: str) -> Position:
        placement, side, castling, ep = (fen.split() + ["-", "-"])[:4]
        board = [0] * 64
        ranks = placement.split("/")
        if len(ranks) != 8 or side not in "wb":
            raise ValueError(f"not a position: {fen}")
        for r, rank in enumerate(ranks):
            f = 0
            for c in rank:
                if c.isdigit():
                    f += int(c)
                else:
                    board[(7 - r) * 8 + f] = (LETTERS.index(c.upper()) + 1) * (1 if c.isupper() else -1)
                    f += 1
            if f != 8:
                raise ValueError(f"not a position: {fen}")
        return cls(board, 1 if side == "w" else -1, frozenset(castling) & frozenset("KQkq"), square_of(ep) if ep != "-" else None)

    def fen(self) -> str:
        ranks = []
        for r in range(7, -1, -1):
            rank = "".join(" " if not p else LETTERS[abs(p) - 1] if p > 0 else LETTERS[abs(p) - 1].lower() for p in self.board[8 * r : 8 * r + 8])
            ranks.append(re.sub(" +", lambda m: str(len(m[0])), rank))
        ep = "-" if self.ep is None else name_of(self.ep)
        return f"{'/'.join(ranks)} {'w' if self.turn > 0 else 'b'} {''.join(r for r in 'KQkq' if r in self.rights) or '-'} {ep} 0 1"

    def attacks(self, square: int, board: list[int] | None = None) -> list[int]:
        board, out = board or self.board, []
        for line in lines_of(board[square], square):
            for s in line:
                out.append(s)
                if board[s]:
                    break
        return out

    def attackers(self, square: int, side: int, board: list[int] | None = None) -> list[int]:
        """Squares of ``side``'s pieces that attack ``square``: seen back from the square."""
        board, out = board or self.board, []
        for kind in (KNIGHT, KING):
            out += [line[0] for line in LINES[kind][square] if board[line[0]] == kind * side]
        out += [line[0] for line in LINES[-PAWN * side][square] if board[line[0]] == PAWN * side]
        for kind in (BISHOP, ROOK):
            for line in LINES[kind][square]:
                for s in line:
                    if p := board[s]:
                        if p == kind * side or p == QUEEN * side:
                            out.append(s)
                        break
        return out

    def king(self, side: int) -> int | None:
        return self.board.index(KING * side) if KING * side in self.board else None

    def has_right(self, right: str) -> bool:
        king, _, rook, _ = CASTLES[right]
        side = 1 if right.isupper() else -1
        return right in self.rights and self.board[king] == KING * side and self.board[rook] == ROOK * side

    def is_en_passant(self, a: int, b: int) -> bool:
        return b == self.ep and abs(self.board[a]) == PAWN and abs(a - b) in (7, 9) and not self.board[b]

    def is_capture(self, a: int, b: int) -> bool:
        return self.board[b] * self.turn < 0 or self.is_en_passant(a, b)

    def moved(self, a: int, b: int, promo: int) -> list[int]:
        """The board after a move, also of one that is not legal."""
        board = self.board.copy()
        piece = board[a]
        if self.is_en_passant(a, b):
            board[b - 8 * self.turn] = 0
        board[a] = 0
        if abs(piece) == KING and a in (4, 60):
            for right, (king, to, rook, rook_to) in CASTLES.items():
                if a == king and b in (to, rook) and self.has_right(right) and (b != rook or self.board[b] == ROOK * self.turn):
                    board[rook], board[to], board[rook_to] = 0, piece, ROOK * self.turn
                    return board
        board[b] = promo * self.turn if promo else piece
        return board

    def after(self, a: int, b: int, promo: int) -> Position:
        piece = self.board[a]
        if not piece:
            raise ValueError("a move from an empty square")
        gone = {r for r, (king, _, rook, _) in CASTLES.items() if a in (king, rook) or b in (king, rook)}
        ep = (a + b) // 2 if abs(piece) == PAWN and abs(a - b) == 16 else None
        return Position(self.moved(a, b, promo), -self.turn, self.rights - gone, ep)

    def pseudo_moves(self) -> list[tuple[int, int, int]]:
        board, turn, out = self.board, self.turn, []
        for a in range(64):
            if board[a] * turn <= 0:
                continue
            if abs(board[a]) != PAWN:
                out += [(a, b, 0) for b in self.attacks(a) if board[b] * turn <= 0]
                continue
            to = [b for b in self.attacks(a) if board[b] * turn < 0 or b == self.ep and a // 8 == (4 if turn > 0 else 3)]
            ahead = a + 8 * turn
            if 0 <= ahead < 64 and not board[ahead]:
                to.append(ahead)
                if a // 8 == (1 if turn > 0 else 6) and not board[ahead + 8 * turn]:
                    to.append(ahead + 8 * turn)
            out += [(a, b, p) for b in to for p in ((QUEEN, ROOK, BISHOP, KNIGHT) if b // 8 in (0, 7) else (0,))]
        for right in "KQ" if turn > 0 else "kq":
            king, to, rook, rook_to = CASTLES[right]
            if self.has_right(right) and not any(board[s] for s in range(min(king, rook) + 1, max(king, rook))):
                if not any(self.attackers(s, -turn) for s in (king, rook_to, to)):
                    out.append((king, to, 0))
        return out

    def legal_moves(self) -> list[tuple[int, int, int, list[int]]]:
        """(from, to, promotion, board after)."""
        out = []
        for a, b, promo in self.pseudo_moves():
            board = self.moved(a, b, promo)
            king = b if abs(self.board[a]) == KING else self.king(self.turn)
            if king is None or not self.attackers(king, -self.turn, board):
                out.append((a, b, promo, board))
        return out

    def pins(self) -> list[tuple[int, int]]:
        """(square, line) of every piece that hides its king from a slider."""
        out = []
        for side in (1, -1):
            if (king := self.king(side)) is None:
                continue
            for kind in (BISHOP, ROOK):
                for line in LINES[kind][king]:
                    met = [s for s in line if self.board[s]][:2]
                    if len(met) == 2 and self.board[met[0]] * side > 0 and self.board[met[1]] in (-kind * side, -QUEEN * side):
                        out.append((met[0], full_line(king, met[0])))
        return out

    def hanging(self, square: int, board: list[int] | None = None) -> bool:
        """No defender, also none behind an attacking slider."""
        board = board or self.board
        side = 1 if board[square] > 0 else -1
        if self.attackers(square, side, board):
            return False
        for s in self.attackers(square, -side, board):
            if abs(board[s]) in (BISHOP, ROOK, QUEEN):
                without = board.copy()
                without[s] = 0
                if self.attackers(square, side, without):
                    return False
        return True

    def bad_spot(self, square: int, board: list[int] | None = None) -> bool:
        """Attacked, and hanging or attacked by a cheaper piece."""
        board = board or self.board
        attackers = self.attackers(square, -1 if board[square] > 0 else 1, board)
        cheaper = any(abs(board[s]) != KING and VALUE[abs(board[s])] < VALUE[abs(board[square])] for s in attackers)
        return bool(attackers) and (cheaper or self.hanging(square, board))

    def trapped(self, square: int, legal) -> bool:
        """A piece in a bad spot with no move that trades it well or takes it to a good one."""
        own = VALUE[abs(self.board[square])]
        for a, b, _, board in legal:
            if a == square and (self.board[b] and VALUE[abs(self.board[b])] >= own or not self.bad_spot(b, board)):
                return False
        return True


def name_of(square: int) -> str:
    return "abcdefgh"[square % 8] + str(square // 8 + 1)


def square_of(name: str) -> int:
    f, r = "abcdefgh".index(name[0]), "12345678".index(name[1])
    if len(name) != 2:
        raise ValueError(name)
    return r * 8 + f


def parse_move(uci: str) -> tuple[int, int, int]:
    """(from, to, promotion); ValueError if it is not written as a move."""
    if len(uci) not in (4, 5):
        raise ValueError(f"not a move: {uci}")
    promo = LETTERS.index(uci[4].upper()) + 1 if len(uci) == 5 else 0
    return square_of(uci[:2]), square_of(uci[2:4]), promo


def signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def bits(squares) -> int:
    mask = 0
    for s in squares:
        mask |= 1 << s
    return signed(mask)


def describe(p: Position, move: tuple[int, int, int] | None) -> dict:
    """One row of the positions array (see ``replay.POSITION``)."""
    board, turn = p.board, p.turn
    pieces = [s for s in range(64) if board[s]]
    attacks = {s: p.attacks(s) for s in pieces}
    by = [0] * 64
    for s, squares in attacks.items():
        for t in squares:
            by[t] |= 1 << s
    kings = {side: p.king(side) for side in (1, -1)}
    legal = p.legal_moves()
    own_king, other_king = kings[turn], kings[-turn]
    checkers = p.attackers(own_king, -turn) if own_king is not None else []
    pins = p.pins()
    pinned = {s for s, _ in pins}
    # most pieces are settled by who attacks their square; only sliders in front need a second look
    side = {1: sum(1 << s for s in pieces if board[s] > 0), -1: sum(1 << s for s in pieces if board[s] < 0)}
    colour = {s: 1 if board[s] > 0 else -1 for s in pieces}
    alone = [s for s in pieces if not by[s] & side[colour[s]]]
    hanging = {s for s in alone if not by[s] & side[-colour[s]] or p.hanging(s)}
    bad = [s for s in pieces if abs(board[s]) != KING and by[s] & side[-colour[s]] and (s in hanging or p.bad_spot(s))]
    trapped = [s for s in bad if not checkers and s not in pinned and board[s] * turn > 0 and abs(board[s]) != PAWN and p.trapped(s, legal)]
    pseudo = p.pseudo_moves() if pins else []
    a, b, promo = move or (None, None, None)
    return {
        "white": turn > 0, "f": a, "t": b, "promo": promo, "cap": move is not None and p.is_capture(a, b), "bd": board,
        "side": [signed(side[1]), signed(side[-1])],
        "kind": [0] + [bits(s for s in pieces if abs(board[s]) == k) for k in range(1, 7)],
        "at": [bits(attacks.get(s, ())) for s in range(64)], "by": [signed(x) for x in by],
        "king": [-1 if kings[1] is None else kings[1], -1 if kings[-1] is None else kings[-1]], "checkers": bits(checkers),
        "hang": bits(hanging), "bad": bits(bad), "trapped": bits(trapped),
        "pins": [{"s": s, "line": signed(line), "leaves": any(x == s and not line >> y & 1 for x, y, _ in pseudo)} for s, line in pins],
        "legal": [{"f": x, "t": y, "promo": q, "cap": p.is_capture(x, y), "chk": other_king is not None and bool(p.attackers(other_king, turn, after))} for x, y, q, after in legal],
        "rights": [p.has_right(r) for r in "KQkq"],
        "ep": any(p.is_en_passant(x, y) for x, y, _, _ in legal),
    }


def replay_one(fen: str, moves: str) -> tuple[list[dict], str | None]:
    """Positions up to the first move that cannot be made, and why it cannot."""
    try:
        p = Position.from_fen(fen)
    except (ValueError, IndexError) as e:
        return [], str(e) or "not a position"
    out, error = [], None
    for uci in moves.split():
        try:
            move = parse_move(uci)
            following = p.after(*move)
        except (ValueError, IndexError) as e:
            error = str(e) or f"not a move: {uci}"
            break
        out.append(describe(p, move))
        p = following
    return [*out, describe(p, None)], error
