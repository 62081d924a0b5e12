"""Move streams of two database formats.

2CBH tokens follow a rule: they count through pieces, squares (file by file) and targets, with six tokens for each target (by what
is captured), and through pawn moves. CBH streams use two tables without a rule, so these are parameters: what each one-byte
token moves, and the permutation of the bytes of two-byte moves. load_tables() reads them; plain_tables() makes tables of
its own for databases that this engine writes, as tests do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cache

from tabiya.kernel.board import BISHOP, KING, KNIGHT, LETTERS, PAWN, QUEEN, ROOK, Board, Move

# Fixed values of the 2CBH format: castling tokens by (side, short), first pawn tokens by side, orders of captured pieces.
CASTLING = {(1, False): 0xB129, (1, True): 0xB12A, (-1, False): 0xB12B, (-1, True): 0xB12C}
PAWN_BASE = {1: 0xABF1, -1: 0xAE8D}
CAPTURED = (0, QUEEN, KNIGHT, BISHOP, ROOK, PAWN)
PROMOTED = (QUEEN, KNIGHT, BISHOP, ROOK)
MAGIC = bytes((0x88, 0x77, 0x66, 0x55, 0x44, 0x33, 0x22, 0x11))
STANDARD = bytes((1, 0, 0xFC, 0xFF))
_DIAGONAL, _STRAIGHT = ((-1, -1), (1, -1), (1, 1), (-1, 1)), ((-1, 0), (0, -1), (1, 0), (0, 1))
_STEPS = {
    KING: tuple((x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y),
    QUEEN: _DIAGONAL + _STRAIGHT,
    KNIGHT: ((-2, -1), (-2, 1), (2, -1), (2, 1), (-1, -2), (-1, 2), (1, -2), (1, 2)),
    BISHOP: _DIAGONAL,
    ROOK: _STRAIGHT,
}


@cache
def piece_indices() -> dict[tuple[int, int, int], int]:
    """(signed piece, start, target): its number among all moves of White's and then Black's pieces."""
    out: dict[tuple[int, int, int], int] = {}
    for side in (1, -1):
        for kind in (KING, QUEEN, KNIGHT, BISHOP, ROOK):
            for f in range(8):
                for r in range(8):
                    for dx, dy in _STEPS[kind]:
                        x, y = f + dx, r + dy
                        while 0 <= x < 8 and 0 <= y < 8:
                            out[kind * side, 8 * r + f, 8 * y + x] = len(out)
                            x, y = x + dx, y + dy
                            if kind in (KING, KNIGHT):
                                break
    return out


@cache
def pawn_tokens(side: int) -> dict[tuple[int, int, int, int, bool], int]:
    """(start, target, promotion, captured, en passant): its token."""
    out, token = {}, PAWN_BASE[side]
    for f in range(8):
        for r in range(1, 7):
            a, ahead = 8 * r + f, 8 * (r + side) + f
            captures = [ahead + d for d in (-1, 1) if 0 <= f + d < 8]
            moves: list[tuple[int, int, int, bool]] = []
            if r == (6 if side > 0 else 1):
                moves += [(ahead, q, 0, False) for q in PROMOTED]
                moves += [(to, q, taken, False) for to in captures for taken in PROMOTED for q in PROMOTED]
            else:
                if r == (1 if side > 0 else 6):
                    moves.append((ahead + 8 * side, 0, 0, False))
                moves.append((ahead, 0, 0, False))
                for to in captures:
                    moves += [(to, 0, taken, False) for taken in CAPTURED[1:]]
                    if r == (4 if side > 0 else 3):
                        moves.append((to, 0, PAWN, True))
            for m in moves:
                out[a, *m] = token
                token += 1
    return out


def encode_token(b: Board, m: Move) -> int | None:
    a, to, promotion = m
    kind, side = abs(b.sq[a]), 1 if b.sq[a] > 0 else -1
    if kind == KING and abs(to - a) == 2:
        return CASTLING[side, to > a]
    if kind == PAWN:
        passing = to == b.ep and not b.sq[to] and a % 8 != to % 8
        return pawn_tokens(side).get((a, to, promotion, PAWN if passing else abs(b.sq[to]), passing))
    n = piece_indices().get((b.sq[a], a, to))
    taken = abs(b.sq[to])
    return None if n is None or taken not in CAPTURED else 1 + 6 * n + CAPTURED.index(taken)


def decode_tokens(stream: bytes) -> list[str]:
    """Moves from the start position; ValueError for a token that isn't exactly one legal move."""
    b, out = Board.start(), []
    for k in range(0, len(stream) - 1, 2):
        token = int.from_bytes(stream[k : k + 2], "little")
        fits = [m for m in b.pseudo() if encode_token(b, m) == token and b.safe(m)]
        if len(fits) != 1:
            raise ValueError(f"token {token:#06x} fits {len(fits)} moves")
        out.append(b.san(fits[0]))
        b = b.apply(fits[0])
    return out


# Fixed values of CBH streams: tokens of castling, a two-byte move, the start and end of a variation, filler, a null move.
SHORT, LONG, TWO_BYTES, PUSH, POP, FILLER, NULL = 0x76, 0xB5, 0x29, 0xDC, 0x0C, 0x9F, 0xAA


@dataclass(frozen=True)
class Tables:
    one_byte: dict[int, tuple[int, int, int, int]]  # token: piece, its number, files and rows to go, from White's side for pawns
    two_bytes: bytes  # 256 values


def load_tables(text: str) -> Tables:
    """Lines `move TOKEN PIECE NUMBER DX DY` (a piece by its letter) and `byte VALUE ...` (256 values in all)."""
    one, two = {}, []
    for line in text.splitlines():
        parts = line.split()
        if parts[:1] == ["move"]:
            one[int(parts[1], 0)] = (LETTERS.index(parts[2]), *map(int, parts[3:6]))
        elif parts[:1] == ["byte"]:
            two += [int(x, 0) for x in parts[1:]]
    if sorted(two) != list(range(256)):
        raise ValueError("the two-byte table is a permutation of 256 bytes")
    return Tables(one, bytes(two))


def plain_tables() -> Tables:
    """Tokens that count through kings, queens, rooks, bishops, knights and pawns, past the special ones; bytes reversed."""
    moves = [(KING, 0, x, y) for x in (-1, 0, 1) for y in (-1, 0, 1) if x or y]
    moves += [(QUEEN, n, x * k, y * k) for n in (0, 1) for x, y in ((0, 1), (1, 0), (1, 1), (1, -1)) for k in range(1, 8)]
    moves += [(ROOK, n, x * k, y * k) for n in (0, 1) for x, y in ((0, 1), (1, 0)) for k in range(1, 8)]
    moves += [(BISHOP, n, x * k, y * k) for n in (0, 1) for x, y in ((1, 1), (1, -1)) for k in range(1, 8)]
    moves += [(KNIGHT, n, x, y) for n in (0, 1) for x, y in _STEPS[KNIGHT]]
    moves += [(PAWN, n, x, y) for n in range(8) for x, y in ((0, 1), (0, 2), (-1, 1), (1, 1))]
    free = [t for t in range(256) if t not in (SHORT, LONG, TWO_BYTES, PUSH, POP, FILLER, NULL)]
    one = dict(zip(free, moves, strict=False)) | {SHORT: (KING, 0, 2, 0), LONG: (KING, 0, -2, 0)}
    return Tables(one, bytes(range(255, -1, -1)))


class Numbered:
    """Pieces with their numbers, by square and by kind, as CBH streams count them."""

    def __init__(self, b: Board):
        self.at: dict[int, tuple[int, int]] = {}
        self.of: dict[int, list[int | None]] = {k * s: [None] * 8 for k in range(1, 7) for s in (1, -1)}
        for s in sorted((s for s in range(64) if b.sq[s]), key=lambda s: (s % 8, s // 8)):
            p = b.sq[s]
            n = 0 if abs(p) == KING else self.of[p].index(None)
            self.put(p, n, s)

    def put(self, p: int, n: int, s: int) -> None:
        self.at[s], self.of[p][n] = (p, n), s

    def copy(self) -> Numbered:
        new = Numbered.__new__(Numbered)
        new.at, new.of = dict(self.at), {k: v[:] for k, v in self.of.items()}
        return new

    def take(self, s: int) -> None:
        """A captured piece that is neither king nor pawn: later ones of its kind move up."""
        p, n = self.at.pop(s, (0, 0))
        if p and abs(p) not in (KING, PAWN):
            self.of[p] = [*self.of[p][:n], *self.of[p][n + 1 :], None]
            self.at.update({x: (p, k - 1) for x, (q, k) in self.at.items() if q == p and k > n})

    def move(self, a: int, to: int, promotion: int = 0, side: int = 1) -> None:
        p, n = self.at.pop(a)
        self.take(to)
        if promotion:  # the pawn's own place in its list stays as it was
            if None not in self.of[promotion * side]:
                raise ValueError("no number is free for a promoted piece")
            p, n = promotion * side, self.of[promotion * side].index(None)
        elif self.of[p][n] != a:  # a capture has renumbered its kind
            n = self.of[p].index(a)
        self.put(p, n, to)


def custom_start(data: bytes) -> tuple[Board, int]:
    """The board and move number of a 28-byte start position; ValueError if it is damaged."""
    if len(data) < 28:
        raise ValueError("a start position has 28 bytes")
    kinds = {0b001: KING, 0b010: QUEEN, 0b011: KNIGHT, 0b100: BISHOP, 0b101: ROOK, 0b110: PAWN}
    bits = "".join(f"{x:08b}" for x in data[4:28])
    sq, at = [0] * 64, 0
    for s in range(64):
        if at >= len(bits):
            break
        if bits[at] == "0":
            at += 1
            continue
        code = bits[at : at + 5]
        if len(code) < 5 or int(code[2:], 2) not in kinds:
            raise ValueError("a piece of the start position is damaged")
        p = kinds[int(code[2:], 2)] * (-1 if code[1] == "1" else 1)
        sq[s % 8 * 8 + s // 8] = p  # squares count file by file
        at += 5
    if any(sq.count(p) > 8 for p in range(-6, 7) if p):
        raise ValueError("too many pieces of a kind")
    side = -1 if data[1] & 0x10 else 1
    castle = sum(keep for bit, keep in ((2, 1), (1, 2), (8, 4), (4, 8)) if data[2] & bit)
    file = (data[1] & 7) - 1
    return Board(sq, side, castle, file + (16 if side < 0 else 40) if file >= 0 else -1), data[3] or 1


def decode_stream(stream: bytes, b: Board, tables: Tables) -> tuple[list[str], int]:
    """Moves of the main line, and how many variations there are; ValueError for a move that isn't legal.

    A byte's token is the byte less the moves so far. A variation's start keeps board and pieces, its end takes them back.
    Tokens that nothing stands for are passed over.
    """
    pieces, done, at, sans, variations = Numbered(b), 0, 0, [], 0
    stack: list[tuple[Board, Numbered]] = []

    def play(a: int, to: int, promotion: int) -> Move:
        m = next((m for m in b.pseudo() if m[0] == a and m[1] == to and (not promotion or m[2] == promotion) and b.safe(m)), None)
        if m is None:
            raise ValueError("an illegal move")
        if not stack:
            sans.append(b.san(m))
        return m

    while at < len(stream):
        token = (stream[at] - done) & 255
        if token not in (TWO_BYTES, PUSH, POP, FILLER):
            done = (done + 1) & 255
        if token == NULL:
            if not stack:
                sans.append("--")
            b = Board(b.sq, -b.side, b.castle, -1)
        elif token == TWO_BYTES:
            if at + 2 >= len(stream):
                raise ValueError("a two-byte move is cut short")
            word = tables.two_bytes[(stream[at + 1] - done) & 255] << 8 | tables.two_bytes[(stream[at + 2] - done) & 255]
            a, to = word & 63, word >> 6 & 63
            a, to = a % 8 * 8 + a // 8, to % 8 * 8 + to // 8
            pawn = abs(pieces.at.get(a, (0, 0))[0]) == PAWN and to // 8 in (0, 7)
            promotion = (QUEEN, ROOK, BISHOP, KNIGHT)[word >> 12 & 3] if pawn else 0
            m = play(a, to, promotion)
            pieces.move(a, to, promotion, b.side)
            b, done, at = b.apply(m), (done + 1) & 255, at + 2
        elif token == PUSH:
            stack.append((b, pieces.copy()))
            variations += 1
        elif token == POP:
            if at < len(stream) - 1:
                if not stack:
                    raise ValueError("a variation ends that didn't begin")
                b, pieces = stack.pop()
        elif token != FILLER and token in tables.one_byte:
            kind, n, dx, dy = tables.one_byte[token]
            a = pieces.of[kind * b.side][n] if 0 <= n < 8 else None
            if a is None:
                raise ValueError("a piece isn't there")
            turn = -1 if kind == PAWN and b.side < 0 else 1
            to = (a % 8 + dx * turn) % 8 + 8 * ((a // 8 + dy * turn) % 8)
            m = play(a, to, 0)
            passing = kind == PAWN and m[1] == b.ep and not b.sq[m[1]] and a % 8 != to % 8
            pieces.move(a, to)
            if passing:
                pieces.at.pop(to - 8 * b.side, None)
            if kind == KING and token in (SHORT, LONG):
                home = a // 8 * 8
                pieces.move(home + (7 if token == SHORT else 0), home + (5 if token == SHORT else 3))
            b = b.apply(m)
        at += 1
    return sans, variations
